"""The near-dedup stage's links in one large bucket."""

import random

import pytest

from vellum.llm import simhash as S
from vellum.llm import store


@pytest.mark.parametrize("bucket", [2048, 16])
def test_every_similar_pair_of_a_bucket_is_linked(spark, bucket):
    """Forty pairs of similar texts with one sample: three centres see few of them; the rest is compared as well."""
    rng, texts = random.Random(7), []
    for g in range(40):
        words = [f"w{rng.randrange(100_000)}" for _ in range(200)]
        texts += [(2 * g, " ".join(words)), (2 * g + 1, " ".join([*words[:-1], "end"]))]
    store.prepare(spark)
    rows = spark.createDataFrame([(t, i) for i, t in texts], "text string, doc_id long")
    sketches = {r.doc_id: r for r in rows.mapInArrow(S._sketches(5), "doc_id long, fp long, n long, samples array<long>").collect()}
    # Some pairs have one fingerprint, which needs no link.
    known = spark.createDataFrame([(fp, i, n, [7]) for fp, (i, n) in {r.fp: (i, r.n) for i, r in sketches.items()}.items()], "fp long, least long, n long, samples array<long>")
    near = spark.createDataFrame([], "a long, b long")
    got = {frozenset(r) for r in S.similar_links(known, rows, near, size=5, similarity=0.8, bucket=bucket).collect()}
    want = {frozenset((sketches[2 * g].fp, sketches[2 * g + 1].fp)) for g in range(40)}
    assert got == {x for x in want if len(x) == 2} and len(got) > 30


def test_a_forest_by_distance_that_fails_by_similarity(spark):
    """Two similar texts that only a third one, similar to neither, links in `near`."""
    words = [f"w{i}" for i in range(200)]
    texts = {1: " ".join(words), 2: " ".join([*words[:-1], "end"]), 3: " ".join(f"x{i}" for i in range(200))}
    rows = spark.createDataFrame([(t, i) for i, t in texts.items()], "text string, doc_id long")
    store.prepare(spark)
    fps = {r.doc_id: r for r in rows.mapInArrow(S._sketches(5), "doc_id long, fp long, n long, samples array<long>").collect()}
    known = spark.createDataFrame([(r.fp, i, r.n, [i]) for i, r in fps.items()], "fp long, least long, n long, samples array<long>")
    near = spark.createDataFrame([(fps[1].fp, fps[3].fp), (fps[2].fp, fps[3].fp)], "a long, b long")
    got = {frozenset(r) for r in S.similar_links(known, rows, near, size=5, similarity=0.8).collect()}
    assert got == {frozenset((fps[1].fp, fps[2].fp))}


def _known(spark, texts, sample):
    """What similar_links takes: the sketches, with `sample` of each text as its only sample, and the texts by id."""
    store.prepare(spark)
    rows = store.keep(spark.createDataFrame([(t, i) for i, t in texts.items()], "text string, doc_id long"), "texts")
    fps = {r.fp: r for r in rows.mapInArrow(S._sketches(5), "doc_id long, fp long, n long, samples array<long>").collect()}
    known = spark.createDataFrame([(r.fp, r.doc_id, r.n, sample(r.doc_id)) for r in fps.values()], "fp long, least long, n long, samples array<long>")
    return store.keep(known, "known"), rows, {r.doc_id: fp for fp, r in fps.items()}


def _shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_tasks_follow_the_rows_not_the_estimate(spark, monkeypatch):
    """Spark takes what `near` joins for the product of two tables; every task of that estimate would be run."""
    seen, real = [], type(spark.range(1)).repartition
    monkeypatch.setattr(type(spark.range(1)), "repartition", lambda self, n, *by: seen.append(n) or real(self, n, *by))
    texts = {i: " ".join(f"w{i}x{k}" for k in range(20)) for i in range(500)}
    known, rows, fps = _known(spark, texts, lambda i: [i // 10])
    near = store.keep(spark.createDataFrame([(fps[0], fps[i]) for i in range(1, 400)], "a long, b long"), "near")
    assert S.similar_links(known, rows, near, size=5, similarity=0.8).isEmpty()
    assert seen and max(seen) <= int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("bucket", [2048, 7])
def test_links_of_one_bucket_against_brute_force(spark, bucket):
    """One large group, smaller ones and texts that are like no other: in one block, and in blocks of strays and others."""
    rng, texts = random.Random(11), {}
    for size in [60, 9, 9, 4, 2, 2, *[1] * 20]:
        words = [f"w{rng.randrange(100_000)}" for _ in range(120)]
        for _ in range(size):
            texts[len(texts)] = " ".join(words)
            words[rng.randrange(len(words))] = f"w{rng.randrange(100_000)}"
    known, rows, fps = _known(spark, texts, lambda i: [7])
    near = spark.createDataFrame([], "a long, b long")
    links = [tuple(r) for r in S.similar_links(known, rows, near, size=5, similarity=0.8, bucket=bucket).collect()]
    sets = {fps[i]: _shingles(texts[i]) for i in fps}
    similar = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert {tuple(sorted(x)) for x in links} <= set(similar)

    def groups(pairs):
        root = {x: x for x in sets}
        for a, b in pairs:
            old, new = root[a], root[b]
            root = {x: new if r == old else r for x, r in root.items()}
        return {frozenset(x for x in sets if root[x] == r) for r in root.values()}

    assert groups(links) == groups(similar)


def test_blocks_return_links_not_pairs(spark):
    """A bucket of similar texts that nothing has joined: all its pairs are candidates, one fewer than texts are links."""
    words = [f"w{i}" for i in range(300)]
    texts = {i: " ".join([*words[:-1], f"end{i}"]) for i in range(50)}
    known, rows, _ = _known(spark, texts, lambda i: [7])
    groups = known.selectExpr("0 as kind", "samples[0] as sample", "fp", "n")
    none = spark.createDataFrame([], "a long, b long")
    assert S._other_links(groups, none, known, rows, size=5, similarity=0.8, block=2048).count() == known.count() - 1
