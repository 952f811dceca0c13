"""URL filters: rules on hosts and paths, and a character language-model ratio for the URLs that no rule decides.

The URLs that rules allow and block are the accepted and the rejected ones.  For each of the two a Markov model of
variable order is counted: the probability of a byte after a context is smoothed towards that after the context
without its first byte, and so on down to the uniform one, so a context counts for as much as it has been seen.  A
URL's score is the difference of the two log-likelihoods over its length.  Every fifth decided URL is left out of the
counts and calibrates the threshold.

Contexts are kept whole, in tables that grow with the corpus.  A window (a byte after its longest context) is a number,
so nothing clashes.  The score of a window is worked out once, from the shortest context up, by joins between tables
of distinct windows; a URL's score is the sum of its windows' scores.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import store

#: Longest context in bytes; with the byte after it it must fit a long.
ORDER = 5
#: How much the shorter context's probability weighs against the counts of the longer one.
WEIGHT = 2.0
#: Every so manieth decided URL calibrates.
CALIBRATE_EACH = 5
#: URLs that become windows at once.
URLS = 5_000
#: Scores are counted in steps of this size, up to LIMIT on either side.
STEP, LIMIT = 0.01, 10.0

#: The rules of the query, as (what to do, host and path).
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for a null or a URL without `://`."""
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    stop = min((i for i in (rest.find("?", end), rest.find("#", end)) if i >= 0), default=len(rest))
    return rest[:end].translate(_LOWER), rest[end:stop]


_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


class Rules:
    """Looks a URL's host up suffix by suffix; of the rules that fit, the longest wins.

    Of rules of one length the one with the longer host wins, and of equal rules `block`."""

    def __init__(self, rules):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for action, rule in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((slash + path, rule, action))

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        best = None
        own = host
        while True:
            for prefix, rule, action in self.by_host.get(own, ()):
                rank = (len(rule), len(own), action == "block")
                if path.startswith(prefix) and (best is None or rank > best[0]):
                    best = (rank, rule, action)
            if "." not in own:
                break
            own = own.partition(".")[2]
        return (best[1], best[2]) if best else (None, None)


def _windows_of(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of every text: it and the `order` bytes before it as a number; and the text it is in."""
    buf = np.frombuffer(b"".join(b"\0" * order + t for t in texts), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), size)
    at = np.arange(len(owner)) + (owner + 1) * order
    window = np.zeros(len(at), np.int64)
    for k in range(order, -1, -1):
        window = window << 8 | buf[at - k]
    return window, owner


def _text(url: str | None) -> bytes:
    """What the models read: the URL after its scheme."""
    if url is None:
        return b""
    return url.rpartition("://")[2].encode("utf-8", "surrogatepass") if url.count("://") == 1 else url.encode("utf-8", "surrogatepass")


def _in_calibration(url: str) -> bool:
    return zlib.crc32(url.encode("utf-8", "surrogatepass")) % CALIBRATE_EACH == 0


def _windows(rules: Rules, order: int):
    """(uid, part, n, length, window) of each byte of distinct URLs; part: what the URL is for, null if undecided."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, URLS):
                some = batch.slice(i, URLS)
                urls = some.column(0).to_pylist()
                texts = [_text(u) for u in urls]
                window, owner = _windows_of(texts, order)
                actions = [rules.find(*split_url(u))[1] for u in urls]
                part = pa.array([a and f"{a} {'later' if _in_calibration(u) else 'now'}" for a, u in zip(actions, urls, strict=True)], pa.string())
                length = pa.array([len(t) for t in texts], pa.int64())
                at = pa.array(owner)
                yield pa.RecordBatch.from_arrays([some.column(1).take(at), part.take(at), some.column(2).take(at), length.take(at), pa.array(window)], ["uid", "part", "n", "length", "window"])

    return work


def window_scores(windows: DataFrame, order: int) -> DataFrame:
    """(window, score) of each distinct window: how much likelier its last byte is in the rejected URLs' model.

    Of one window at most 256 are longer by a byte, so no key of these joins is common."""
    weight = lambda a: F.sum(F.when(F.col("part") == f"{a} now", F.col("n")).otherwise(0)).alias(a)
    level = store.keep(windows.groupBy("window").agg(weight("allow"), weight("block")), "windows")
    levels = [level]
    for k in range(order - 1, -1, -1):
        # Without the byte farthest back.
        short = F.col("window").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1))
        level = store.keep(level.groupBy(short.alias("window")).agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")), "windows")
        levels.append(level)
    shorter = None
    for k, level in enumerate(reversed(levels)):
        context = F.shiftright("window", 8)
        seen = level.groupBy(context.alias("context")).agg(F.sum("allow").alias("allow_all"), F.sum("block").alias("block_all"))
        own = level.withColumn("context", context).join(seen, "context")
        if shorter is None:
            own = own.withColumns({f"p_{a}": F.lit(1 / 256) for a in ("allow", "block")})
        else:
            own = own.withColumn("short", F.col("window").bitwiseAND(F.lit((1 << 8 * k) - 1))).join(shorter.withColumnRenamed("window", "short"), "short")
        p = {a: ((F.col(a) + WEIGHT * F.col(f"p_{a}")) / (F.col(f"{a}_all") + WEIGHT)).alias(f"p_{a}") for a in ("allow", "block")}
        shorter = store.keep(own.select("window", p["allow"], p["block"]), "chances")
    return shorter.select("window", (F.log("p_block") - F.log("p_allow")).alias("score"))


def best_threshold(counts: pa.Table) -> float:
    """The score above which to block: the right parts of both kinds add up to most (the middle of the best range)."""
    bins = int(2 * LIMIT / STEP) + 1
    total = {a: np.zeros(bins) for a in ("allow", "block")}
    for a, t in total.items():
        t[counts["bin"].to_numpy()] = counts[a].to_numpy()
    if not all(t.any() for t in total.values()):
        return 0.0
    right = np.cumsum(total["allow"]) / total["allow"].sum() + 1 - np.cumsum(total["block"]) / total["block"].sum()
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return float((best[0] + best[-1]) / 2 + 0.5) * STEP - LIMIT


def _judge(rules: Rules, ready: bool, threshold: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [split_url(u) for u in batch.column(0).to_pylist()]
            found = [rules.find(*p) for p in parts]
            score = batch.column(2).to_pylist()
            verdict = [a or ("block" if ready and s > threshold else "allow") for (_, a), s in zip(found, score, strict=True)]
            cols = [batch.column(1), *(pa.array(x, pa.string()) for x in ([h for h, _ in parts], [p for _, p in parts], [r for r, _ in found], verdict)), batch.column(2)]
            yield pa.RecordBatch.from_arrays(cols, ["page_id", "host", "path", "rule", "verdict", "score"])

    return work


def judge(pages: DataFrame, rules=RULES, *, url: str = "url", page_id: str = "page_id", order: int = ORDER) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict (allow or block) and score.

    A rule fits its host and all subdomains of it, if the path starts with the rule's.  Where a rule fits, its word
    is the verdict; else a URL is blocked if its score exceeds the calibrated threshold.  A null or empty URL scores
    0.  Where rules block nothing, or allow nothing, there is no model, and what no rule decides is allowed.  Repeated
    rows count, and are judged, each for itself; an empty table gives no rows.  Only `url` and `page_id` are read.
    """
    spark = pages.sparkSession
    store.prepare(spark)
    own = Rules(rules)
    rows = pages.select(F.col(url).cast("string"), F.col(page_id).cast("long").alias("page_id"))
    # Equal URLs are read once, with their number.
    urls = rows.where("url <> ''").groupBy("url").agg(F.count("*").alias("n")).select("url", F.xxhash64("url").alias("uid"), "n")
    windows = store.keep(urls.mapInArrow(_windows(own, order), "uid long, part string, n long, length long, window long"), "urls")
    parts = {r.part for r in windows.select("part").distinct().collect()}
    ready = {"allow now", "block now"} <= parts
    threshold = 0.0
    if ready:
        # Plain tables meet: a common window is split over tasks.
        each = windows.hint("merge").join(window_scores(windows, order), "window")
        scores = store.keep(each.groupBy("uid").agg((F.sum("score") / F.first("length")).alias("score"), F.first("part").alias("part"), F.first("n").alias("n")), "scores")
        bins = int(2 * LIMIT / STEP) + 1
        at = F.least(F.greatest(F.round((F.col("score") + LIMIT) / STEP), F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin")
        sums = [F.sum(F.when(F.col("part") == f"{a} later", F.col("n")).otherwise(0)).alias(a) for a in ("allow", "block")]
        threshold = best_threshold(scores.where("part like '% later'").groupBy(at).agg(*sums).toArrow())
        rows = rows.withColumn("uid", F.xxhash64("url")).hint("merge").join(scores.select("uid", "score"), "uid", "left").select("url", "page_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    else:
        rows = rows.withColumn("score", F.lit(0.0))
    return rows.mapInArrow(_judge(own, ready, threshold), "page_id long, host string, path string, rule string, verdict string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(store.read(spark, sf_dir, "pages"))
