"""Removal of lines whose template recurs across documents.  DataFrame functions only.

Lines go down a tree of fixed depth: the number of tokens, then the first DEPTH tokens.  A token with a digit is a
variable field, written `<*>` from the start.  Behind the leading tokens a leaf generalises in two steps, over the
templates that do not recur as they are:

1. A token that fewer than MIN_TEXTS texts have at its place in the leaf is written `<*>`, in any number of places up
   to one in MASKED of the template's tokens; beyond that the template stays as it was.
2. Templates that are equal now, or equal but for one place (whatever stands there), form a group.  A token hashed
   with its place and taken out of the exclusive-or of all of a line's tokens gives every "all but this place".

A template recurs if it, or a group of MIN_VARIANTS or more templates that it belongs to, stands in MIN_TEXTS or more
different texts, wherever it stands in them and whatever stands beside it.  Near copies count as one text: a text of
whose characters NEAR or more lie in lines that MIN_TEXTS texts hold goes by the longest such line (the first of equals),
which its near copies share, instead of by its own digest.  All lines of recurring templates go.

Counting is an aggregate that tasks combine before the shuffle; rows carry hashes, not lines.  The texts are shuffled
once, by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import store

DEPTH = 3
MIN_TEXTS = 10
MIN_VARIANTS = 3
#: One in so many of a template's tokens may become a variable field because it is rare at its place.
MASKED = 3
#: Share of a text in common lines from which it counts as a near copy.
NEAR = 0.8

_BLANK = r"\x20\x09-\x0D"
#: A token with a digit.  Only the start of a token can match, so long tokens are read twice at most.
_FIELD = rf"(?<![^{_BLANK}])(?=[^{_BLANK}0-9]*+[0-9])[^{_BLANK}]++"


def template(line: Column) -> Column:
    """The line's tokens, joined by one space, with `<*>` for those that hold a digit."""
    # Most lines have no digit and single spaces only; one search is far cheaper than two replacements.
    masked = F.trim(F.regexp_replace(F.regexp_replace(line, _FIELD, "<*>"), rf"[{_BLANK}]+", " "))
    return F.when(line.rlike(r"[0-9\x09-\x0D]|\x20\x20"), masked).otherwise(F.trim(line))


def _rows(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def _key() -> Column:
    return F.xxhash64("doc_id", "text")


def _leaf(t: Column) -> Column:
    count = F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit("")))
    return F.xxhash64(count, F.substring_index(t, " ", DEPTH))


def _lines(rows: DataFrame) -> DataFrame:
    """A row of hashes for each line that has a token."""
    templates = F.transform(F.split("text", "\n", -1), template)
    kept = rows.select(_key().alias("key"), F.xxhash64("text").alias("digest"), templates.alias("templates"))
    kept = kept.withColumn("total", F.length(F.array_join("templates", "")))
    each = F.transform("templates", lambda t, i: F.struct(i.alias("pos"), F.xxhash64(t).alias("tid"), _leaf(t).alias("leaf"), F.length(t).alias("size")))
    return kept.select("key", "digest", "total", F.explode(each).alias("x")).where("x.size > 0").select("key", "digest", "total", "x.pos", "x.tid", "x.leaf", "x.size")


def near_copies(often: DataFrame) -> DataFrame:
    """(digest, copy) of the texts that are mostly common lines; `often` has the lines that enough texts hold."""
    once = often.groupBy("digest", "pos").agg(F.first("total").alias("total"), F.first("size").alias("size"), F.first("tid").alias("tid"))
    own = once.groupBy("digest").agg(F.first("total").alias("total"), F.sum("size").alias("common"), F.max(F.struct("size", -F.col("pos"), "tid")).alias("longest"))
    return own.where(F.col("common") >= NEAR * F.col("total")).select("digest", F.xxhash64("longest.tid").alias("copy"))


def _texts(lines: DataFrame, copies: DataFrame) -> DataFrame:
    """(leaf, tid, own) for each line: `own` tells texts apart, near copies not."""
    # Merged, never broadcast: near copies grow with the corpus.
    return lines.select("leaf", "tid", "digest").distinct().hint("merge").join(copies, "digest", "left").select("leaf", "tid", F.coalesce("copy", "digest").alias("own"))


def recurring(rows: DataFrame, lines: DataFrame, min_texts: int, min_variants: int) -> DataFrame:
    """(tid) of the recurring templates."""
    stats = store.keep(lines.groupBy("leaf", "tid").agg(F.count_distinct("digest").alias("texts")), "templates")
    often = store.keep(lines.join(stats.where(F.col("texts") >= min_texts).select("tid"), "tid", "left_semi"), "often")
    copies = store.keep(near_copies(often), "copies")
    exact = store.keep(_texts(often, copies).groupBy("tid").agg(F.count_distinct("own").alias("n")).where(F.col("n") >= min_texts).select("tid"), "exact")
    rare = stats.join(exact, "tid", "left_anti")
    # Only leaves that hold enough different templates can have a variable field.
    leaves = store.keep(
        rare.groupBy("leaf").agg(F.count("*").alias("variants"), F.sum("texts").alias("texts")).where((F.col("variants") >= min_variants) & (F.col("texts") >= min_texts)).select("leaf"),
        "leaves",
    )
    split = rows.select(F.explode(F.transform(F.split("text", "\n", -1), template)).alias("t")).where("t <> ''").withColumn("leaf", _leaf(F.col("t")))
    some = split.join(leaves, "leaf", "left_semi").select("leaf", "t").distinct().withColumn("tid", F.xxhash64("t"))
    groups = _generalised(some.join(rare.select("tid", "texts"), "tid"), min_texts)
    by = ["leaf", "place", "rest"]
    several = groups.groupBy(*by).agg(F.count("*").alias("variants"), F.sum("texts").alias("texts"))
    several = several.where((F.col("variants") >= min_variants) & (F.col("texts") >= min_texts)).select(*by)
    groups = store.keep(groups.drop("texts").join(several, by, "left_semi"), "several")
    texts = _texts(lines.join(groups.select("tid").distinct(), "tid", "left_semi"), copies)
    general = groups.join(texts.select("tid", "own"), "tid").groupBy(*by).agg(F.count_distinct("own").alias("n"))
    general = store.keep(general.where(F.col("n") >= min_texts).select(*by), "fields")
    return exact.unionByName(groups.join(general, by, "left_semi").select("tid")).distinct()


def _generalised(some: DataFrame, min_texts: int) -> DataFrame:
    """(leaf, tid, texts, place, rest) for the templates (leaf, t, tid, texts): `rest` is the template with its rare
    tokens as `<*>`, whole (place -1) and without each place behind the leading ones."""
    tokens = F.split("t", " ")
    each = F.posexplode(F.transform(F.slice(tokens, DEPTH + 1, F.size(tokens)), lambda x, i: F.xxhash64(i + DEPTH, x)))
    placed = some.where(F.size(tokens) > DEPTH).select("leaf", "tid", "texts", F.size(tokens).alias("size"), each.alias("place", "own")).withColumn("place", F.col("place") + DEPTH)
    placed = store.keep(placed, "tokens")
    common = placed.groupBy("leaf", "own").agg(F.sum("texts").alias("n")).where(F.col("n") >= min_texts).select("leaf", "own", F.lit(True).alias("common"))
    # A token that very many templates of one leaf share can be split over tasks: two plain tables meet.
    known = placed.join(store.keep(common, "common"), ["leaf", "own"], "left")
    known = known.select("leaf", "tid", "texts", "size", "place", "own", F.when(F.col("common"), F.col("own")).otherwise(F.xxhash64("place", F.lit("<*>"))).alias("masked"))
    one = known.groupBy("leaf", "tid").agg(
        F.first("texts").alias("texts"), (MASKED * F.count_if(F.col("own") != F.col("masked")) <= F.first("size")).alias("enough"), F.collect_list(F.struct("place", "own", "masked")).alias("x")
    )
    chosen = F.transform("x", lambda x: F.struct(x["place"].alias("place"), F.when(F.col("enough"), x["masked"]).otherwise(x["own"]).alias("own")))
    all_ = F.aggregate("chosen", F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x["own"]))
    whole = F.array(F.struct(F.lit(-1).alias("place"), F.lit(0).cast("long").alias("own")))
    out = one.withColumn("chosen", chosen).withColumn("all", all_).select("leaf", "tid", "texts", "all", F.explode(F.concat("chosen", whole)).alias("x"))
    return store.keep(out.select("leaf", "tid", "texts", "x.place", F.col("all").bitwiseXOR(F.col("x.own")).alias("rest")), "variants")


def drop_recurring_lines(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", min_texts: int = MIN_TEXTS, min_variants: int = MIN_VARIANTS) -> DataFrame:
    """One row per input row: `row` (a struct of all its columns), doc_id, n_lines, n_removed and kept_text.

    Lines end at "\\n"; tokens lie between blanks.  Lines without a token stay.  A null text stays null and has no
    lines; an empty one has one line and stays.  A text that loses every line becomes empty.  Equal texts count as one
    text, whatever their number, so repeated rows change nothing and get equal results; an empty table gives no rows.
    Other columns of any name pass through inside `row`.
    """
    store.prepare(docs.sparkSession)
    rows = _rows(docs, text, doc_id)
    lines = store.keep(_lines(rows), "lines")
    gone = store.keep(recurring(rows, lines, min_texts, min_variants), "recurring")
    # A common template's lines can be split over tasks: plain tables meet here.
    hits = lines.join(gone, "tid", "left_semi").groupBy("key").agg(F.collect_set("pos").alias("gone")).withColumnRenamed("key", "hit")
    hits = store.keep(hits, "hits")
    whole = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), *(F.col(c).cast(t).alias(a) for c, t, a in ((doc_id, "long", "doc_id"), (text, "string", "text"))))
    whole = whole.withColumn("key", _key())
    split = F.split("text", "\n", -1)
    n = F.coalesce(F.size(split), F.lit(0))
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), "gone"), lambda i: F.get(F.col("split"), i)), "\n")
    return (
        # Merged, never broadcast: what is hit grows with the corpus.
        whole.hint("merge").join(hits, whole.key == hits.hit, "left")
        .withColumn("split", split)
        .select(
            "row", "doc_id", F.when(F.col("text").isNull(), 0).otherwise(n).cast("long").alias("n_lines"),
            F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
            F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("kept_text"),
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_recurring_lines(store.read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "kept_text")


ORACLE_SQL = r"""
WITH docs AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents
), each AS (
  SELECT text, ls, i, array_to_string(list_transform(regexp_extract_all(ls[i], '[^\x20\x09-\x0D]+'), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END), ' ') AS t
  FROM (SELECT text, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT DISTINCT text, ls FROM docs))
), lines AS (
  SELECT text, i, t, string_split(t, ' ') AS tok, CAST(len(string_split(t, ' ')) AS VARCHAR) || chr(2) || array_to_string(string_split(t, ' ')[1:3], ' ') AS leaf FROM each WHERE t <> ''
), stats AS (
  SELECT leaf, t, any_value(tok) AS tok, count(DISTINCT text) AS texts FROM lines GROUP BY leaf, t
), often AS (
  SELECT t FROM stats WHERE texts >= 10
), copies AS (
  SELECT text, first(t ORDER BY length(t) DESC, i) FILTER (t IN (SELECT t FROM often)) AS longest
  FROM lines GROUP BY text HAVING sum(length(t)) FILTER (t IN (SELECT t FROM often)) >= CAST(0.8 AS DOUBLE) * sum(length(t))
), owned AS (
  SELECT DISTINCT t, CASE WHEN longest IS NULL THEN lines.text ELSE chr(2) || longest END AS own FROM lines LEFT JOIN copies ON lines.text = copies.text
), exact AS (
  SELECT t FROM owned WHERE t IN (SELECT t FROM often) GROUP BY t HAVING count(DISTINCT own) >= 10
), rare AS (
  SELECT * FROM stats ANTI JOIN exact ON stats.t = exact.t
), leaves AS (
  SELECT leaf FROM rare GROUP BY leaf HAVING count(*) >= 3 AND sum(texts) >= 10
), placed AS (
  SELECT leaf, t, texts, len(tok) AS size, p, tok[p] AS x
  FROM (SELECT *, unnest(range(4, len(tok) + 1)) AS p FROM rare WHERE leaf IN (SELECT leaf FROM leaves))
), common AS (
  SELECT leaf, p, x FROM placed GROUP BY leaf, p, x HAVING sum(texts) >= 10
), masked AS (
  SELECT placed.*, CASE WHEN common.x IS NULL THEN '<*>' ELSE placed.x END AS m
  FROM placed LEFT JOIN common ON placed.leaf = common.leaf AND placed.p = common.p AND placed.x = common.x
), chosen AS (
  SELECT leaf, t, texts, CASE WHEN 3 * count(*) FILTER (m <> x) <= any_value(size) THEN list(m ORDER BY p) ELSE list(x ORDER BY p) END AS c
  FROM masked GROUP BY leaf, t, texts
), grouped AS (
  SELECT leaf, t, texts, 0 AS p, array_to_string(c, ' ') AS rest FROM chosen
  UNION ALL
  SELECT leaf, t, texts, p, array_to_string(c[1:p - 1], ' ') || chr(2) || array_to_string(c[p + 1:], ' ') FROM (SELECT *, unnest(range(1, len(c) + 1)) AS p FROM chosen)
), several AS (
  SELECT leaf, p, rest FROM grouped GROUP BY leaf, p, rest HAVING count(*) >= 3 AND sum(texts) >= 10
), members AS (
  SELECT grouped.* FROM grouped SEMI JOIN several ON grouped.leaf = several.leaf AND grouped.p = several.p AND grouped.rest = several.rest
), fields AS (
  SELECT leaf, p, rest FROM members JOIN owned USING (t) GROUP BY leaf, p, rest HAVING count(DISTINCT own) >= 10
), gone AS (
  SELECT t FROM exact UNION SELECT t FROM members SEMI JOIN fields ON members.leaf = fields.leaf AND members.p = fields.p AND members.rest = fields.rest
), per_text AS (
  SELECT text, count(*) FILTER (t IN (SELECT t FROM gone)) AS n_removed, string_agg(ls[i], chr(10) ORDER BY i) FILTER (t NOT IN (SELECT t FROM gone)) AS kept
  FROM each GROUP BY text
)
SELECT docs.doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CASE WHEN docs.text IS NULL THEN NULL ELSE coalesce(kept, '') END AS kept_text
FROM docs LEFT JOIN per_text ON docs.text = per_text.text
"""
