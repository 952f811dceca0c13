"""Each operator against a brute-force version, on rows with nulls, empty and long texts, ties, repeats and odd columns."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from vellum.llm import components, decontaminate, kernels, line_dedup, packing, quality_classifier, quality_rules, sharding, simhash, store, substring_dedup, url_filter, warc

rng = random.Random(7)
BLANK = "[^\x20\x09-\x0d]+"
VOCAB = ["alpha", "beta", "gamma", "delta", "été", "naïve", "Zeit", "x9", "ein", "日本", "b-b", "c,"]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) + str(r.randint(0, 30)) for _ in range(n))


SHARED, NEAR = prose(60, 1), prose(300, 2)
TEXTS = [
    None, "", " \t\n ", "one", "one two", prose(80, 3), prose(80, 3), SHARED, prose(20, 4) + "\n" + SHARED + "  " + prose(15, 5),
    prose(7, 6) + " " + SHARED, NEAR, NEAR.replace("alpha1 ", "alpha2 ", 1), NEAR + " end", "a b " * 200, prose(4000, 8), "\x00\u2003 odd\u00a0space",
    "x" * 20000, prose(35, 9), prose(34, 10), prose(35, 9).upper(),
]


def docs(spark, texts=TEXTS, ids=None):
    rows = [((i if ids is None else ids[i]), t, f"k{i}", i * 1.5, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, row double, n long")


@pytest.fixture(scope="module")
def table(spark):
    # A row twice, a second row of an id, and a row without id.
    ids = list(range(len(TEXTS)))
    extra = [(5, TEXTS[5]), (5, "another text of five"), (None, TEXTS[8])]
    made = docs(spark, [*TEXTS, *[t for _, t in extra]], [*ids, *[i for i, _ in extra]]).repartition(3)
    return made.cache()


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


# -- kernels ------------------------------------------------------------------------------------------------------


def test_words_match_the_regex():
    import pyarrow as pa

    texts = [t or "" for t in TEXTS]
    buf, off = kernels.text_buffer(pa.array(texts))
    words = kernels.Words(buf, off, kernels.NOT_BLANK)
    for d, t in enumerate(texts):
        own = [words.slice(i, i + 1).decode() for i in range(words.first[d], words.first[d + 1])]
        assert own == re.findall(BLANK, t)


def test_window_hashes_depend_on_words_alone():
    import pyarrow as pa

    buf, off = kernels.text_buffer(pa.array([SHARED, "q " + SHARED, SHARED.replace(" ", "\n")]))
    words = kernels.Words(buf, off, kernels.NOT_BLANK)
    h = kernels.window_hashes(words.hashes(), 10)
    ok = kernels.within(words, 10)
    sets = [set(h[words.first[d] : words.first[d + 1]][ok[words.first[d] : words.first[d + 1]][: len(h) - words.first[d]]].tolist()) for d in range(3)]
    assert sets[0] == sets[2] and sets[0] < sets[1]


# -- substring dedup ----------------------------------------------------------------------------------------------


def brute_repeats(texts, window):
    split = [re.findall(BLANK, t or "") for t in texts]
    count = {}
    for w in split:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            count[k] = count.get(k, 0) + 1
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_difference_cover():
    assert substring_dedup.is_difference_cover(substring_dedup.COVER, substring_dedup.PERIOD)
    assert not substring_dedup.is_difference_cover((0, 1, 2), 21)


def test_substring_dedup(table):
    src = [(r.doc_id, r.text) for r in table.collect()]
    want = sorted(((i, *x) for (i, _), x in zip(src, brute_repeats([t for _, t in src], 35))), key=repr)
    got = substring_dedup.remove_repeats(table)
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == want
    for r in got.collect():
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256
        assert sum(s.end - s.start for s in r.spans) == r.n_removed


def test_substring_dedup_joins_many_anchors(table):
    src = [(r.doc_id, r.text) for r in table.collect()]
    want = sorted(((i, *x) for (i, _), x in zip(src, brute_repeats([t for _, t in src], 35))), key=repr)
    got = substring_dedup.remove_repeats(table, max_anchors=0)
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == want


def test_substring_dedup_across_batches(spark, table, monkeypatch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        src = [(r.doc_id, r.text) for r in table.collect()]
        want = sorted(((i, *x) for (i, _), x in zip(src, brute_repeats([t for _, t in src], 35))), key=repr)
        assert rows_of(substring_dedup.remove_repeats(table), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_substring_dedup_hands_on_small_batches():
    # Whole, the windows and anchors of this text make batches of 10 and 1 MB.
    text = prose(400_000, 11)
    rows = pa.RecordBatch.from_arrays([pa.array([text]), pa.array([5])], ["text", "key"])

    class Full:
        value = np.full(1 << 10, -1, np.int64).view(np.uint64)

    of = (15, substring_dedup.PERIOD, substring_dedup.COVER)
    anchors = list(substring_dedup._task_anchors(*of)(iter([rows])))
    windows = list(substring_dedup._candidates(Full, 16, 35, *of)(iter([rows])))
    assert max(b.num_rows for b in anchors + windows) <= substring_dedup.OUT_ROWS
    assert max(b.nbytes for b in anchors + windows) < 2_000_000
    places = sorted(s >> 32 for b in windows for s in b["span"].to_pylist())
    assert places == list(range(400_000 - 34))
    assert sum(b.num_rows for b in anchors) == sum(p % 21 in substring_dedup.COVER for p in range(400_000 - 14))


def test_substring_dedup_repeated_anchors():
    # Runs of equal hashes within, across and over whole batches; those of one row are left out.
    h = [-9, -9, -9, -4, 0, 0, 1, 2, 2, 2, 2, 2, 7, 8, 8]
    for n in (1, 2, 3, 4, 20):
        parts = [h[a : a + n] for a in range(0, len(h), n)] + [[]]
        got = substring_dedup._repeated(pa.RecordBatch.from_arrays([pa.array(p, pa.int64())], ["h"]) for p in parts)
        assert [x for b in got for x in b["h"].to_pylist()] == [-9, 0, 2, 8]
    of = (15, substring_dedup.PERIOD, substring_dedup.COVER)
    rows = pa.RecordBatch.from_arrays([pa.array([prose(80, 12)] * 3 + [prose(60, 13)])], ["text"])
    found = [x for b in substring_dedup._task_anchors(*of)(iter([rows])) for x in b["h"].to_pylist()]
    assert sorted(found.count(x) for x in set(found)) == [1] * 12 + [2] * 17


def test_substring_dedup_keeps_anchors_in_few_files(table, monkeypatch):
    kept = {}
    monkeypatch.setattr(store, "keep", lambda df, name, keep=store.keep: kept.setdefault(name, (df, keep(df, name)))[1])
    substring_dedup.remove_repeats(table)
    plan, stored = kept["anchors"][0]._jdf.queryExecution().executedPlan().toString(), kept["anchors"][1]
    assert "Aggregate" not in plan
    assert plan.index("REBALANCE_PARTITIONS_BY_COL") < plan.index("MapInArrow")
    assert len(stored.inputFiles()) == 1 < store.partitions(table.sparkSession, table)
    assert stored.count() == stored.distinct().count() > 0


# -- simhash ------------------------------------------------------------------------------------------------------


def brute_fp(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(BLANK, low)
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("bucket", [2048, 2])
def test_simhash(table, bucket):
    src = [(r.doc_id, r.text) for r in table.collect()]
    fps = [brute_fp(t) for _, t in src]
    groups = brute_groups(fps)
    least = {g: min((i for (i, _), x in zip(src, groups) if x == g and i is not None), default=None) for g in groups}
    want = sorted(((i, f"{f:016x}", least[g]) for (i, _), f, g in zip(src, fps, groups)), key=repr)
    assert rows_of(simhash.near_duplicates(table, bucket=bucket), "doc_id", "fingerprint", "component_id") == want


@pytest.mark.parametrize("bucket", [4096, 20])
def test_simhash_links_join_all_near_pairs(spark, bucket):
    r = random.Random(3)
    centre = r.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 6))) for _ in range(150)} | {r.getrandbits(64) for _ in range(100)}
    fps = sorted(fps)
    frame = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    groups = brute_groups(fps)
    roots = {r.node % (1 << 64): r.root for r in components.components(simhash.links(frame, bucket=bucket)).collect()}
    own = [roots.get(f, f) for f in fps]
    assert all((own[i] == own[j]) == (groups[i] == groups[j]) for i in range(len(fps)) for j in range(i))


def test_every_near_pair_shares_a_first_key():
    r, masks = random.Random(5), simhash.level_masks()
    for _ in range(3000):
        differ = sum(1 << b for b in r.sample(range(64), r.randint(0, 3)))
        assert any(not differ & m for _, m in masks)


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 400), (400, 500), (7, 7), (None, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 400: 400, 500: 400}


def shingles(text, size=5):
    w = re.findall(BLANK, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))}


def jaccard(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def similar_groups(texts):
    """The least place that each text reaches by links of similarity 0.8."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i, x in enumerate(sets):
        for j in range(i):
            if len(x & sets[j]) >= 0.8 * len(x | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def test_similar_texts(spark):
    r, texts = random.Random(9), []
    for group in range(30):
        words = prose(r.choice([30, 80, 200, 600]), 900 + group).split()
        for _ in range(r.randint(1, 9)):
            own = list(words)
            for _ in range(int(len(own) * r.choice([0, 0.004, 0.01, 0.02, 0.05, 0.2]))):
                own[r.randrange(len(own))] = f"new{r.randrange(10**6)}"
            texts.append(" ".join(own))
    texts += ["few words", "few  WORDS", "few other", "one", "", None]
    got = {x.doc_id: x.component_id for x in simhash.similar_texts(docs(spark, texts).repartition(3)).collect()}
    assert sorted(got) == list(range(len(texts))) and got[len(texts) - 1] == got[len(texts) - 2] == len(texts) - 2
    n = len(texts) - 2
    near = {(i, j) for i in range(n) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8}
    # What is joined is joined by links that brute force has too; what has them is joined, but for few that samples miss.
    root = {i: i for i in range(n)}
    for _ in range(n):
        for i, j in near:
            root[i] = root[j] = min(root[i], root[j])
    assert all(root[i] == root[got[i]] for i in range(n))
    missed = [p for p in near if got[p[0]] != got[p[1]]]
    assert len(near) > 100 and len(missed) <= 0.02 * len(near)
    assert got[n - 4] == got[n - 3] == n - 4 and got[n - 2] == n - 2


@pytest.mark.parametrize("similarity", [0.7, 0.8, 0.9])
def test_widest(similarity):
    r, n = np.random.default_rng(3), 400
    common = round(2 * n * similarity / (1 + similarity))
    for _ in range(300):
        x = r.integers(0, 2**63, 2 * n - common, dtype=np.uint64)
        a, b = (simhash._majority(kernels.mix64(y), np.array([0]))[0] for y in (x[:n], x[n - common :]))
        assert int(np.bitwise_count(a ^ b)) <= simhash.widest(similarity)


def test_keep_one(table):
    src = [(r.doc_id, r.text) for r in table.collect()]
    kept = simhash.keep_one(table)
    assert kept.columns == table.columns
    assert kept.count() == len(set(brute_groups([brute_fp(t) for _, t in src])))


def test_keep_one_of_similar_texts(table):
    src = [(r.doc_id, r.text) for r in table.collect()]
    kept = simhash.keep_one(table, by=simhash.similar_texts)
    distinct = {t or "" for _, t in src}
    assert kept.columns == table.columns
    groups = {t: {x for x in distinct if jaccard(t, x) >= 0.8} for t in distinct}
    assert kept.count() == len({frozenset(g) for g in groups.values()})


# -- decontamination ----------------------------------------------------------------------------------------------

ITEMS = [(1, prose(15, 20)), (2, prose(10, 21)), (3, "Solo"), (4, "two Words"), (5, None), (6, " ,;"), (7, prose(15, 20)), (None, prose(25, 22)), (10, SHARED), (2, prose(12, 23))]
ALNUM = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def brute_hits(texts, items):
    lower = {c: c + 32 for c in range(65, 91)}
    windows = {}
    for i, t in items:
        w = re.findall(ALNUM, (t or "").translate(lower))
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[k : k + n]), set()).add("null" if i is None else str(i))
    out = []
    for t in texts:
        w = re.findall(ALNUM, (t or "").translate(lower))
        hit, ids = set(), set()
        for n in range(1, 11):
            for k in range(len(w) - n + 1):
                own = windows.get(tuple(w[k : k + n]))
                if own:
                    hit.update(range(k, k + n))
                    ids |= own
        out.append((len(w), len(hit), tuple(sorted(ids)), bool(hit)))
    return out


@pytest.mark.parametrize("block", [8_000_000, 150])
def test_contamination(spark, table, block):
    src = [(r.doc_id, r.text) for r in table.collect()]
    texts = [(100, "x " + prose(15, 20) + " y"), (101, "solo TWO words " + prose(25, 22)[10:]), (102, "clean text")]
    both = table.unionByName(docs(spark, [t for _, t in texts], [i for i, _ in texts]))
    want = sorted(((i, *x) for (i, _), x in zip(src + texts, brute_hits([t for _, t in src + texts], ITEMS))), key=repr)
    found = decontaminate.contamination(both, spark.createDataFrame(ITEMS, "item_id long, text string"), block_bytes=block, with_row=True)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids), r.contaminated) for r in found.collect()), key=repr)
    assert got == want
    assert found.where(sum_of_spans() != F.col("n_hit")).isEmpty()
    assert found.select("row.*").columns == table.columns


def sum_of_spans():
    return F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


def test_winnowing_keeps_a_gram_of_every_window():
    grams = np.array([rng.getrandbits(20) for _ in range(500)], np.uint64)
    kept = decontaminate.winnow(grams, 6)
    assert all(kept[i : i + 6].any() for i in range(495)) and kept.mean() < 0.5


# -- packing ------------------------------------------------------------------------------------------------------


def test_packing(table):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    for t in [x for x in TEXTS if x] + ["it's <|endoftext|> they'll  \n\n x ½ ²\u2003'S \U0001f600"]:
        assert packing.encoder(path).encode(t).tolist() == plain.encode(t, add_special_tokens=False).ids
    got = packing.pack(table, path).toPandas()
    src = table.collect()
    lengths = [len(plain.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in src]
    assert got.length.sum() == sum(lengths) and len(got) == sum(-(-n // 1024) for n in lengths)
    assert all(zlib.crc32(np.array(i, "<u4").tobytes()) == c and len(i) == n for i, c, n in zip(got.ids, got.ids_crc32, got.length))
    one = got[(got.doc_id == 14)].sort_values("piece")
    assert one.length.tolist()[1:] == [1024] * (len(one) - 1) and one.start.tolist() == [0, *one.length.cumsum().tolist()[:-1]]
    assert sum(one.ids.tolist(), []) if False else [x for i in one.ids for x in i] == [*plain.encode(TEXTS[14], add_special_tokens=False).ids, 2]
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() <= 1024
    assert got.sequence_id.nunique() <= -(-sum(lengths) // 1024) + 1


@pytest.mark.parametrize("pool", [3_000, 40_000])
def test_packing_in_tasks_and_of_the_rest(spark, pool):
    import public_tokenizers

    r = random.Random(5)
    texts = [" ".join(["word"] * r.choice([0, 5, 90, 300, 700, 1100, 2500])) for _ in range(400)]
    got = packing.pack(docs(spark, texts).repartition(3), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False, pool_tokens=pool).toPandas()
    assert (got.sequence_id >= 0).any() and got.length.sum() == sum(len(t.split()) + 1 for t in texts)
    assert got.groupby("doc_id").length.sum().tolist() == [len(t.split()) + 1 for t in texts]
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() <= 1024
    # As few sequences as when all pieces are packed at once, or nearly so.
    at_once = sum(n for _, n in packing.minimum_bin_slack(got.length.value_counts().to_dict(), 1024))
    assert got.sequence_id.nunique() <= at_once * 1.01 + 1


def test_long_white_space(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    texts = [" " * 2_000_000, "\n" * 2_000_000, "a" + " \n\t\u2003" * 500_000 + "b", "x" * 300_000 + " " * 4096 + "!" * 300_000, "\u00e9" * 300_000]
    got = packing.pack(docs(spark, texts), path).orderBy("doc_id", "piece").collect()
    for i, t in enumerate(texts):
        assert [x for r in got if r.doc_id == i for x in r.ids] == [*plain.encode(t, add_special_tokens=False).ids, 2]


def test_fullest_is_the_best_sum():
    from itertools import product

    for seed in range(30):
        r = random.Random(seed)
        have = {r.randint(1, 40): r.randint(1, 3) for _ in range(4)}
        room = r.randint(1, 100)
        best = max(s for s in (sum(k * m for k, m in zip(have, c)) for c in product(*[range(n + 1) for n in have.values()])) if s <= room)
        out = packing.fullest(have, room)
        assert sum(out) == best and all(out.count(k) <= have.get(k, 0) for k in out)


def test_minimum_bin_slack_places_all():
    counts = {rng.randint(1, 64): rng.randint(1, 50) for _ in range(30)}
    plan = packing.minimum_bin_slack(counts, 64)
    placed = {}
    for lengths, times in plan:
        assert sum(lengths) <= 64
        for x in lengths:
            placed[x] = placed.get(x, 0) + times
    assert placed == counts
    # No more bins than first-fit decreasing opens.
    bins = []
    for x in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
        spot = next((i for i, b in enumerate(bins) if b + x <= 64), None)
        if spot is None:
            bins.append(x)
        else:
            bins[spot] += x
    assert sum(t for _, t in plan) <= len(bins)


# -- sharding -----------------------------------------------------------------------------------------------------


def test_sharding(spark, table):
    got = sharding.shard(table, 4).toPandas()
    src = table.collect()
    want = sorted(((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in src), key=repr)
    assert sorted(zip([None if x != x else int(x) for x in got.doc_id.astype(object).where(got.doc_id.notna(), float("nan"))], got["size"], got.text_crc32), key=repr) == want
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))


def test_slot_map(spark):
    r = np.random.default_rng(1)
    sizes = r.integers(10, 3000, 4096)
    first = sharding.SlotMap.even(24, 4096)
    second = first.rebalance(sizes)
    load = np.bincount(second.shard_of, weights=sizes)
    assert second.version == 2 and load.max() / load.mean() < 1.001
    grown = second.grow(sizes)
    moved = grown.shard_of != second.shard_of
    assert set(grown.shard_of[moved]) == {24} and 0.03 < np.bincount(grown.shard_of, weights=sizes)[24] / sizes.sum() <= 0.04
    path = store.new_path(spark, "map")
    for m in (first, second, grown):
        m.save(spark, path)
    assert (sharding.SlotMap.load(spark, path).shard_of == grown.shard_of).all()
    assert (sharding.SlotMap.load(spark, path, 2).shard_of == second.shard_of).all()
    with pytest.raises(Exception, match="(?i)exist"):
        second.save(spark, path)
    for absent in (dict(path=path, version=9), dict(path=path + "-none")):
        with pytest.raises(ValueError):
            sharding.SlotMap.load(spark, **absent)


def test_stored_map_is_edited_again(spark, tmp_path):
    path = str(tmp_path / "map")
    texts = [prose(5 + i % 60, i) for i in range(1500)]
    load = sharding.SlotMap.load

    def run(n, shards):
        got = sharding.shard(docs(spark, texts[:n]), shards, slots=512, map_path=path).toPandas()
        sizes = got.groupby("shard")["size"].sum()
        assert len(sizes) == shards and sizes.max() / sizes.mean() < 1.02
        assert all(sorted(own) == list(range(len(own))) for _, own in got.groupby("shard").slot)
        assert (got["shard"] == load(spark, path).shard_of[got.virtual_slot]).all() and set(got.map_version) == {load(spark, path).version}

    run(1000, 6)
    assert sharding.SlotMap.versions(spark, path) == [1, 2]
    second = load(spark, path)
    # Nothing to move, nothing written.
    run(1000, 6)
    assert sharding.SlotMap.versions(spark, path) == [1, 2]
    # A grown table edits the stored map: far fewer slots move than when a map is made anew.
    run(1100, 6)
    third = load(spark, path)
    assert third.version == 3 and (third.shard_of != second.shard_of).mean() < 0.2
    assert len(third.shard_of) == 512
    # One more shard takes slots only into itself, then the sizes are evened.
    run(1500, 7)
    grown = load(spark, path, 4)
    assert set(grown.shard_of[grown.shard_of != third.shard_of]) == {6}
    for other in (dict(shards=3), dict(shards=7, slots=256)):
        with pytest.raises(ValueError):
            sharding.shard(docs(spark, texts), **{"slots": 512, **other}, map_path=path)


# -- URL filter ---------------------------------------------------------------------------------------------------


def test_split_url_and_rules():
    cases = {None: ("", ""), "": ("", ""), "no scheme/x": ("", ""), "HTTP://A.Com/P?q#f": ("a.com", "/P"), "x://h": ("h", ""), "x://h?a://b/c": ("h", ""), "x://h#/p": ("h", ""), "a://b://c/d": ("b:", "//c/d")}
    assert {u: url_filter.split_url(u) for u in cases} == cases
    rules = url_filter.Rules(url_filter.RULES)
    assert rules.find("m.example.com", "/en/71") == ("example.com/en/7", "allow")
    assert rules.find("example.com", "/en/81") == ("com/en/", "block")
    assert rules.find("example.net", "/de/81") == ("example.net/de/8", "block")
    assert rules.find("notexample.net", "/de/81") == ("net/de/", "allow")
    assert rules.find("xcom", "/en/1") == (None, None)


def test_url_filter(spark):
    r = random.Random(2)
    good = [f"http://site{r.randint(0, 99)}.net/de/garden-{r.choice(['rose', 'tulip'])}-{i}" for i in range(150)]
    bad = [f"http://win{r.randint(0, 99)}.com/en/casino-{r.choice(['slots', 'poker'])}-{i}" for i in range(150)]
    new = [f"http://win{i}.info/casino-slots-{i}" for i in range(9)] + [f"http://site{i}.info/garden-rose-{i}" for i in range(9)]
    urls = [None, "", *good, *bad, *new, good[0]]
    got = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    assert len(got) == len(urls)
    by = {x.page_id: x for x in got}
    start = 2 + len(good) + len(bad)
    assert [by[start + i].verdict for i in range(18)] == ["block"] * 9 + ["allow"] * 9
    assert (by[0].host, by[0].path, by[0].rule) == ("", "", None) and by[2].rule == "net/de/"
    # Without a kind of rule there is no model.
    assert {x.verdict for x in url_filter.judge(spark.createDataFrame(list(enumerate(new)), "page_id long, url string")).collect()} == {"allow"}


def test_url_scores_are_exact(spark):
    r = random.Random(3)
    path = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(90))
    urls = [f"http://a.net/de/{path()}" for _ in range(1500)] + [f"http://a.com/en/{path()}" for _ in range(1500)] + [f"http://a.info/{path()}" for _ in range(5)]
    urls += urls[:3] + urls[-1:]
    count = {"allow": {}, "block": {}}
    rules = url_filter.Rules(url_filter.RULES)
    padded = lambda u: b"\0" * url_filter.ORDER + u.split("://")[1].encode()
    for u in urls:
        action = rules.find(*url_filter.split_url(u))[1]
        if action and zlib.crc32(u.encode()) % url_filter.CALIBRATE_EACH:
            t = padded(u)
            for i in range(url_filter.ORDER, len(t)):
                for k in range(url_filter.ORDER + 1):
                    for x in (t[i - k : i + 1], (t[i - k : i],)):
                        count[action][x] = count[action].get(x, 0) + 1
    got = {x.page_id: x.score for x in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert len(got) == len(urls)
    for at in (*range(0, 3000, 300), *range(3000, len(urls))):
        t, want = padded(urls[at]), 0.0
        for i in range(url_filter.ORDER, len(t)):
            for sign, c in ((-1, count["allow"]), (1, count["block"])):
                p = 1 / 256
                for k in range(url_filter.ORDER + 1):
                    p = (c.get(t[i - k : i + 1], 0) + url_filter.WEIGHT * p) / (c.get((t[i - k : i],), 0) + url_filter.WEIGHT)
                want += sign * np.log(p)
        assert abs(got[at] - want / (len(t) - url_filter.ORDER)) < 1e-6


# -- quality rules ------------------------------------------------------------------------------------------------


def brute_measure(text):
    t = text or ""
    w = re.findall(BLANK, t)
    seen, dup, count, cover = set(), 0, {}, set()
    for line in t.split("\n"):
        if re.search(BLANK, line):
            dup += line in seen
            seen.add(line)
    for i in range(len(w) - 2):
        count.setdefault(tuple(w[i : i + 3]), []).append(i)
    for at in count.values():
        if len(at) > 1:
            cover |= {i + k for i in at for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover)


def test_quality_rules(spark, table):
    trusted = spark.createDataFrame([(i,) for i in (5, 8, 14, None, 999)], "doc_id long")
    got = quality_rules.assess(table.unionByName(docs(spark, ["%$#| <> " * 60, "a\nb\n\na\n a\n" * 3], [50, 51])), trusted).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_measure(r.row.text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.score >= quality_rules.THRESHOLD)
    # The score, counted plainly, one n-gram at a time.
    bucket = {}

    def cut(text):
        b = (text or "").encode()
        parts = [b[i : i + 4] for i in range(len(b) - 3)]
        for p in parts:
            if p not in bucket:
                bucket[p] = int(quality_rules.grams(np.frombuffer(p, np.uint8), np.array([0, 4]))[0][0])
        return [bucket[p] for p in parts]

    raw, target = {}, {}
    for r in got:
        for x in cut(r.row.text):
            raw[x] = raw.get(x, 0) + 1
            if r.row.doc_id in (5, 8, 14):
                target[x] = target.get(x, 0) + 1
    n, m = sum(raw.values()), sum(target.values())
    own = {k: np.log((target.get(k, 0) + 1) / (m + 65536)) - np.log((v + 1) / (n + 65536)) for k, v in raw.items()}
    for r in got:
        x = cut(r.row.text)
        assert r.score == pytest.approx(np.mean([own[i] for i in x]) if x else 0.0)


# -- quality classifier -------------------------------------------------------------------------------------------


def test_quality_classifier(spark):
    r = random.Random(11)
    texts = [prose(r.randint(3, 90), i) if i % 3 else " ".join(r.choice(["BUY", "NOW!!", "$$$", "click"]) for _ in range(r.randint(3, 60))) for i in range(300)]
    frame = docs(spark, [*texts, None, "", "x" * 30000])
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(None, 1, 0), (7, None, 0), (4000, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality_classifier.train(frame, labels)
    got = quality_classifier.classify(frame, model).collect()
    assert len(got) == 303 and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got)
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got)
    held = [x for x in got if x.held_out and x.doc_id < 300]
    assert np.mean([x.predicted == int(x.doc_id % 3 > 0) for x in held]) > 0.95
    # Held-out labels change nothing.
    other = labels.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {x.doc_id: x.score for x in quality_classifier.classify(frame, quality_classifier.train(frame, other)).collect()}
    assert all(again[x.doc_id] == pytest.approx(x.score) for x in got)
    flat = quality_classifier.classify(frame, quality_classifier.train(frame, labels.where("quality = 1"))).select("score").distinct().collect()
    assert len(flat) == 1 and flat[0].score > 0.9


def test_classifier_sample_is_of_ids(spark):
    # One bad id of very many rows must not push the other class, or other ids, out of the sample.
    bad = [f"BUY now {i}!! click" for i in range(40)]
    good = [prose(40, i) for i in range(40)]
    rows = [(i, t) for i, t in enumerate(bad + good)] + [(0, bad[0])] * 10_000
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 40)) for i in range(80)], "doc_id long, quality int")
    for most in (2, 10):
        got = quality_classifier.classify(frame, quality_classifier.train(frame, labels, max_fit_rows=most)).distinct().collect()
        assert np.mean([r.score for r in got if r.doc_id >= 40]) > 0.2 + np.mean([r.score for r in got if r.doc_id < 40])


def test_log_count_ratios(spark):
    texts = [(prose(6, i), i % 2) for i in range(20)] + [("", 0), ("ab", 1)]
    counted = next(quality_classifier._count(iter([pa.RecordBatch.from_arrays([pa.array([t for t, _ in texts]), pa.array([y for _, y in texts])], ["text", "label"])])))
    got = quality_classifier.log_count_ratios(pa.Table.from_batches([counted]))
    have = {0: {}, 1: {}}
    for (_, y), features in zip(texts, quality_classifier.text_features(pa.array([t for t, _ in texts])), strict=True):
        assert sorted(set(features.tolist())) == features.tolist()
        for f in features.tolist():
            have[y][f] = have[y].get(f, 0) + 1
    every = [sum(h.values()) + quality_classifier.FEATURES for h in have.values()]
    for f in [*have[0], *have[1], 99_999]:
        want = np.log((have[1].get(f, 0) + 1) / every[1]) - np.log((have[0].get(f, 0) + 1) / every[0])
        assert got[f] == pytest.approx(want)


def test_dual_coordinate_descent_reaches_the_optimum():
    r = np.random.default_rng(2)
    ratios = np.zeros(quality_classifier.FEATURES)
    ratios[:50] = r.normal(size=50)
    rows = [np.sort(r.choice(50, r.integers(3, 12), replace=False)) for _ in range(24)]
    y = (np.arange(24) % 3 > 0).astype(int)
    w = quality_classifier.dual_coordinate_descent(rows, y, ratios, cost=1.0, epochs=3000)
    x = np.zeros((24, 51))
    for i, f in enumerate(rows):
        x[i, f], x[i, 50] = ratios[f] / np.sqrt(len(f)), 1.0
    sign, cost = 2 * y - 1, np.where(y == 1, 24 / (2 * y.sum()), 24 / (2 * (1 - y).sum()))
    primal = lambda v: v @ v / 2 + cost @ np.maximum(0, 1 - sign * (x @ v))
    own = np.append(w[:50], w[-1])
    # A plain projected gradient on the dual bounds the optimum from below.
    q, alpha = (sign[:, None] * x) @ (sign[:, None] * x).T, np.zeros(24)
    step = 1 / np.linalg.eigvalsh(q)[-1]
    for _ in range(60_000):
        alpha = np.clip(alpha + step * (1 - q @ alpha), 0, cost)
    dual = alpha.sum() - alpha @ q @ alpha / 2
    assert primal(own) - dual < 1e-3 * abs(dual) and not w[51:-1].any()


# -- WARC ---------------------------------------------------------------------------------------------------------

PAGES = [(1, "http://a/1", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u\r\nv", ""), (4, "u4", None), (5, "u5", "é" * 5000), (6, "u6", "WARC/1.1\r\n\r\nfake"), (6, "again", "<p>x</p>"), (6, "again", "<p>x</p>"), (None, "u7", "<p>x</p>")]


@pytest.mark.parametrize("least", [0, 9])
def test_warc_round_trip(spark, least):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(2)
    path = store.new_path(spark, "warc")
    warc.write_archives(pages, path, min_bytes=least, frame_bytes=64, bundle_bytes=600)
    got = warc.read_archives(spark, path).collect()
    want = []
    for i, _, html in PAGES:
        payload = (html or "").encode()
        last = max((j for j, _, h in PAGES if (h or "") == (html or "") and j is not None), default=None)
        revisit = len(payload) >= least and last is not None and i != last
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        want.append((i, len(payload), digest, "revisit" if revisit else "response", last if revisit else None, None if revisit else payload))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got), key=repr) == sorted(want, key=repr)
    # The whole file is plain Zstandard, and the index finds each record in its frame.
    import zstandard

    files = {r.path: bytes(r.content) for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).collect() if len(r.content) > 4}
    assert len(files) > 1
    for raw in files.values():
        reader = warc.BundleReader(raw)
        whole = b"".join(reader.frame(i) for i in range(len(reader.frames)))
        assert zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(raw) == whole
    index = warc.archive_index(spark, path).collect()
    assert len(index) == len(PAGES)
    for r in index:
        fields, _ = warc.BundleReader(files[r.path]).record(r.frame, r.offset)
        assert fields["WARC-Record-ID"] == r.record_id


# -- line dedup ---------------------------------------------------------------------------------------------------


def test_line_dedup_templates(spark):
    word = lambda i, j: prose(9, 1000 * i + j).translate({48 + k: "abcdefghij"[k] for k in range(10)})
    texts = []
    for i in range(40):
        lines = [f"own first {chr(97 + i % 26)} {word(i, 1)}", f"Page {i} of 99", f"Posted by user {('anna', 'ben', 'cy', 'dora')[i % 4]} today", f"mid {chr(97 + i // 2)}{i} {word(i, 2)}", "", "  All rights\treserved.", word(i, 3)]
        texts.append("\n".join(lines))
    texts += [texts[0]] * 30 + [None, "", "\n\n", "All rights reserved."]
    got = line_dedup.drop_recurring_lines(docs(spark, texts)).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.row.text == texts[r.doc_id]
        if r.doc_id < 70:
            lines = texts[r.doc_id].split("\n")
            assert r.kept_text == "\n".join(lines[i] for i in (0, 3, 4, 6)) and (r.n_lines, r.n_removed) == (7, 3)
    last = {r.doc_id: (r.kept_text, r.n_lines, r.n_removed) for r in got if r.doc_id >= 70}
    assert last == {70: (None, 0, 0), 71: ("", 1, 0), 72: ("\n\n", 3, 0), 73: ("", 1, 1)}


def test_line_dedup_spares_copies(spark):
    base = [f"{prose(12, 50 + i)}" for i in range(12)]
    base = [re.sub("[0-9]", "", x) for x in base]
    r = random.Random(1)
    texts = ["\n".join(base)] * 50
    for _ in range(100):
        own = list(base)
        own[r.randrange(12)] += " changed" + r.choice("abcdefgh")
        texts.append("\n".join(own))
    assert line_dedup.drop_recurring_lines(docs(spark, texts)).where("n_removed > 0").isEmpty()


def test_line_dedup_counts_texts_whatever_surrounds(spark):
    word = lambda i, j: re.sub("[0-9]", "", prose(9, 1000 * i + j)) + " " + "".join("abcdefghij"[int(d)] for d in f"{i}{j}")
    block = ["Home", "News", "Contact us", "About this site"]
    texts = ["\n".join([*block, word(i, 1), "", "Set off by blank lines", "", word(i, 2), word(i, 3), word(i, 4)]) for i in range(60)]
    # A line always between the same two neighbours, in many more texts than there are pairs of neighbours.
    texts += ["\n".join([word(i, 5), word(i, 6), f"pre {'ab'[i % 2]}", "One line below them", f"post {'xyz'[i % 3]}", word(i, 7)]) for i in range(60, 260)]
    for r in line_dedup.drop_recurring_lines(docs(spark, texts)).collect():
        lines = texts[r.doc_id].split("\n")
        own = (4, 5, 7, 8, 9, 10) if r.doc_id < 60 else (0, 1, 5)
        assert r.kept_text == "\n".join(lines[i] for i in own)


def test_line_dedup_spares_many_copies(spark):
    base = [re.sub("[0-9]", "", prose(12, 50 + i)) for i in range(12)]
    name = lambda i: "".join("abcdefghij"[int(d)] for d in str(i))
    texts = ["\n".join(x + f" changed {name(i)}" if j == i % 12 else x for j, x in enumerate(base)) for i in range(600)]
    assert line_dedup.drop_recurring_lines(docs(spark, texts)).where("n_removed > 0").isEmpty()


NAMES = [a + b for a in ("an", "ber", "cor", "dun", "el", "fir") for b in ("a", "ot", "ius", "wick", "sa")]


def test_line_dedup_many_fields(spark):
    r = random.Random(3)
    own = lambda i: re.sub("[0-9]", "", prose(9, 700 + i)) + " " + "".join("abcdefghij"[int(d)] for d in str(i))
    unique = lambda i, c: c + "".join("abcdefghij"[int(d)] for d in f"{i:03}")
    texts = []
    for i in range(120):
        # Two fields whose values never come twice, and two whose values are few, so that no pair of them is rare.
        free = f"Article published by {unique(i, 'n')} under {unique(i, 't')} today"
        few = f"Filed in section {r.choice(NAMES[:9])} by {r.choice(NAMES[9:18])} this week"
        # As many leading words in common, but all else is prose.
        texts.append("\n".join([own(i), free, few, f"It is a {own(i)}"]))
    for row in line_dedup.drop_recurring_lines(docs(spark, texts)).collect():
        lines = texts[row.doc_id].split("\n")
        assert row.kept_text == "\n".join([lines[0], lines[3]])


def test_line_dedup_long_lines(spark):
    long = prose(60_000, 5)
    texts = [f"{long}\nown {'abcdefghijklm'[i]}\nfoot of all" for i in range(12)] + ["x" * 1_000_000 + "\nfoot of all", " " * 1_000_000]
    got = {r.doc_id: r for r in line_dedup.drop_recurring_lines(docs(spark, texts)).collect()}
    # Twelve texts that are mostly one line are near copies, so nothing of theirs recurs.
    assert [got[i].n_removed for i in range(14)] == [0] * 14 and got[13].kept_text == texts[13]


def test_native_plan_has_no_python(table):
    plan = line_dedup.drop_recurring_lines(table)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# -- empty tables -------------------------------------------------------------------------------------------------


def test_empty_tables(spark):
    import public_tokenizers

    none = docs(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    items = spark.createDataFrame([], "item_id long, text string")
    path = store.new_path(spark, "warc")
    warc.write_archives(pages, path)
    for df in (
        line_dedup.drop_recurring_lines(none), packing.pack(none, public_tokenizers.path("byte_bpe_50k.json")), sharding.shard(none, 3), simhash.near_duplicates(none),
        url_filter.judge(pages), quality_rules.assess(none, labels.select("doc_id")), warc.read_archives(spark, path), decontaminate.contamination(none, items),
        quality_classifier.classify(none, quality_classifier.train(none, labels)), substring_dedup.remove_repeats(none), simhash.keep_one(none),
    ):
        assert df.collect() == []
    one = docs(spark, ["just a text"])
    assert [r.contaminated for r in decontaminate.contamination(one, items).collect()] == [False]


# -- pipeline -----------------------------------------------------------------------------------------------------


def test_pipeline(spark, sf):
    import corpus_pipeline as P

    docs_ = store.read(spark, sf, "documents")
    kept = {}
    for name, stage in P.STAGES:
        out = store.keep(stage(spark, docs_, sf), name)
        if name != P.STAGES[-1][0]:
            assert out.columns == docs_.columns
        kept[name] = (docs_, out)
        docs_ = out
    before, after = kept["simhash_near_dedup"]
    texts = {r.doc_id: r.text for r in before.collect()}
    ids = sorted(texts)
    groups = similar_groups([texts[i] for i in ids])
    stay = {r.doc_id for r in after.collect()}
    for g in set(groups):
        assert len(stay & {i for i, x in zip(ids, groups) if x == g}) == 1
    before, after = kept["benchmark_decontamination"]
    items = [(r.item_id, r.text) for r in store.read(spark, sf, "benchmark").collect()]
    src = [(r.doc_id, r.text) for r in before.collect()]
    clean = {i for (i, _), x in zip(src, brute_hits([t for _, t in src], items)) if not x[3]}
    assert {r.doc_id for r in after.collect()} == clean
    before, after = kept["line_dedup"]
    lines = {r.doc_id: r.text for r in before.collect()}
    for r in after.collect():
        assert set(r.text.split("\n")) <= {*lines[r.doc_id].split("\n"), ""} and r.n_chars == len(r.text)
