"""A quality classifier: naive Bayes support vectors.

A text is the set of its n-grams of bytes, hashed into a fixed number of features, and of its n-grams of repeats
(whether a word equals the one before).  Each feature is scaled by its
class log-count ratio, which is counted over all training rows.  A linear model with hinge loss is then fitted by dual
coordinate descent on a bounded sample of those rows, and its margins are mapped to probabilities on a part of the
sample that the fit did not see.  Labels, languages, sources and ids are never features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import kernels as K
from vellum.llm import store
from vellum.llm.quality_rules import BROADCAST_BYTES, grams

FEATURES = 1 << 17
ORDERS = (2, 4)
#: N-grams of whether a word equals the one before it, of this order.
REPEAT_ORDER = 4
#: Labelled rows in the sample that the linear model is fitted on, of each class; a row takes FEATURES / 8 bytes at most.
MAX_FIT_ROWS = 2000
#: Every row in so many of the sample calibrates the probabilities instead.
CALIBRATE_EACH = 5
#: What a hinge loss of one costs, against the squared length of the weights.
COST = 1.0
EPOCHS = 20


def _repeats(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Like grams(): for REPEAT_ORDER words in a row, which of them equal the word before."""
    words = K.Words(buf, off, K.NOT_BLANK)
    h = words.hashes()
    same = np.zeros(len(words), bool)
    same[1:] = h[1:] == h[:-1]
    first = words.first
    same[first[:-1][words.count > 0]] = False
    n = max(0, len(words) - REPEAT_ORDER + 1)
    code = np.zeros(n, np.int64)
    for i in range(REPEAT_ORDER):
        code = 2 * code + same[i : n + i]
    ends = np.maximum(first[1:] - REPEAT_ORDER + 1, first[:-1])
    return code, np.stack([np.minimum(first[:-1], n), np.minimum(ends, n)])


def text_features(column: pa.Array) -> Iterator[np.ndarray]:
    """The features of each text, in order and without repeats."""
    seen = np.zeros(FEATURES, bool)
    for a, b, buf, off in K.text_chunks(column):
        sets = [*(grams(buf, off, order, FEATURES) for order in ORDERS), _repeats(buf, off)]
        for d in range(b - a):
            found = [x[begin[d] : end[d]] for x, (begin, end) in sets]
            for f in found:
                seen[f] = True
            out = np.flatnonzero(seen)
            seen[out] = False
            yield out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, FEATURES), np.int64)
    for batch in batches:
        for label, f in zip(batch.column(1).to_pylist(), text_features(batch.column(0)), strict=True):
            total[label][f] += 1
    some = np.flatnonzero(total.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[0][some]), pa.array(total[1][some])], ["feature", "bad", "good"])


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for f in text_features(batch.column(0)):
            mark = np.zeros(FEATURES, bool)
            mark[f] = True
            rows.append(np.packbits(mark).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(3), pa.array(rows, pa.binary())], ["label", "place", "id", "bits"])


def log_count_ratios(counts: pa.Table) -> np.ndarray:
    """Log of a feature's part in good texts over that in bad ones, with one added to every count."""
    total = np.ones((2, FEATURES))
    at = counts["feature"].to_numpy()
    total[0][at] += counts["bad"].to_numpy()
    total[1][at] += counts["good"].to_numpy()
    share = total / total.sum(axis=1, keepdims=True)
    return np.log(share[1] / share[0])


def _scaled(f: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """The values of a text's features: the ratios, over the root of their number."""
    return ratios[f] / np.sqrt(max(len(f), 1))


def dual_coordinate_descent(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, cost: float = COST, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (the last is the constant) of the least |w|^2 / 2 + cost * hinge losses.  A class weighs as much as the other."""
    w = np.zeros(FEATURES + 1)
    values = [_scaled(f, ratios) for f in rows]
    norm = np.array([v @ v + 1.0 for v in values])
    y = np.where(labels == 1, 1.0, -1.0)
    upper = np.where(labels == 1, cost * len(y) / (2 * max((labels == 1).sum(), 1)), cost * len(y) / (2 * max((labels == 0).sum(), 1)))
    alpha, order = np.zeros(len(y)), np.random.default_rng(0)
    for _ in range(epochs):
        most = 0.0
        for i in order.permutation(len(y)):
            f, v = rows[i], values[i]
            slope = y[i] * (w[f] @ v + w[-1]) - 1
            new = min(max(alpha[i] - slope / norm[i], 0.0), upper[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[f] += step * v
                w[-1] += step
                alpha[i] = new
                most = max(most, abs(step))
        if most < 1e-4:
            break
    return w


def calibrate(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and constant of the logistic curve from margins to the probability of label 1 (Newton's method)."""
    good, bad = (labels == 1).sum(), (labels == 0).sum()
    target = np.where(labels == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, np.log((good + 1) / (bad + 1))
    x = np.stack([margins, np.ones(len(margins))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -40, 40)))
        slope = x @ (p - target)
        curve = (x * (p * (1 - p))) @ x.T + 1e-6 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        size = np.abs(step).max()
        step /= max(1.0, size / 2)
        a, b = a - step[0], b - step[1]
        if size < 1e-9:
            break
    return max(float(a), 0.0), float(b)


class Model:
    """Weights by feature, and the curve that makes a margin a probability."""

    def __init__(self, weights: np.ndarray, constant: float, slope: float, shift: float):
        self.weights, self.constant, self.slope, self.shift = weights.astype(np.float32), constant, slope, shift

    def margin(self, f: np.ndarray) -> float:
        return float(self.weights[f].sum(dtype=np.float64)) / np.sqrt(max(len(f), 1)) + self.constant

    def score(self, f: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(f) + self.shift, -40, 40))))


def _score(model):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            scores = [own.score(f) for f in text_features(batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return work


def is_held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "quality", max_fit_rows: int = MAX_FIT_ROWS) -> Model:
    """Fit on the labelled rows that are not held out.

    A doc_id with several labels takes their mean, rounded (ties up); null ids and labels are left out.  The sample
    takes the `max_fit_rows` ids of each class with the least hash, and of each id one text (that with the least hash),
    however often its rows repeat.  Counts and ratios take all rows, shares of the classes all ids.  Without both
    classes the score of every text is the share of good ones, with one added to either count.
    """
    spark = docs.sparkSession
    store.prepare(spark)
    ids = (
        labels.select(F.col(doc_id).cast("long").alias("id"), F.col(label).alias("y")).where("id is not null and y is not null").where(~is_held_out("id"))
        .groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("label"))
    )
    ids = store.keep(ids, "labelled")
    # Ids and labels go to every task while they are few; else the texts meet them in a shuffle.
    ids = F.broadcast(ids) if ids.count() * 16 <= BROADCAST_BYTES else ids
    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(doc_id).cast("long").alias("id")).join(ids, "id")
    counts = rows.select("text", "label").mapInArrow(_count, "feature int, bad long, good long").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    ratios = log_count_ratios(counts.toArrow())
    known = docs.select(F.col(doc_id).cast("long").alias("id")).distinct().join(ids, "id")
    sizes = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        good, every = sizes.get(1, 0), sum(sizes.values())
        return Model(np.zeros(FEATURES), 0.0, 0.0, float(np.log((good + 1) / (every - good + 1))))
    place = F.xxhash64(F.col("id"), F.lit(9))
    parts = [known.where(F.col("label") == y).select("id", "label", place.alias("place")).orderBy("place", "id").limit(max_fit_rows) for y in (0, 1)]
    sample = store.keep(parts[0].unionByName(parts[1]), "sample")
    chosen = docs.select(F.col(text).cast("string").alias("text"), F.col(doc_id).cast("long").alias("id")).join(F.broadcast(sample), "id")
    # One row an id: the sample is bounded by its ids, and an id that very many rows repeat weighs as much as any other.
    # Tasks find the least hash before the shuffle; what passes it is a table of at most as many rows as ids.
    least = F.broadcast(store.keep(chosen.groupBy("id").agg(F.min(F.xxhash64("text")).alias("least")), "least"))
    one = chosen.join(least, "id").where(F.xxhash64("text") == F.col("least")).dropDuplicates(["id"])
    got = one.select("text", "label", "place", "id").mapInArrow(_bits, "label int, place long, id long, bits binary").orderBy("place", "id").toArrow()
    features = [np.flatnonzero(np.unpackbits(np.frombuffer(x.as_py(), np.uint8))).astype(np.int32) for x in got["bits"]]
    y = got["label"].to_numpy()
    # Rows go in turn, within each class, to the part that calibrates.
    turn = np.empty(len(y), np.int64)
    for c in (0, 1):
        turn[y == c] = np.arange((y == c).sum())
    apart = turn % CALIBRATE_EACH == CALIBRATE_EACH - 1
    fit = np.flatnonzero(~apart)
    w = dual_coordinate_descent([features[i] for i in fit], y[fit], ratios)
    test = np.flatnonzero(apart) if len(set(y[apart].tolist())) == 2 else np.arange(len(y))
    margins = np.array([w[features[i]] @ _scaled(features[i], ratios) + w[-1] for i in test])
    # The sample has the classes in other shares than all ids: the curve is shifted to their shares.
    slope, shift = calibrate(margins, y[test])
    shift += np.log(sizes[1] / sizes[0]) - np.log((y[test] == 1).sum() / (y[test] == 0).sum())
    return Model(w[:-1] * ratios, float(w[-1]), slope, float(shift))


def classify(docs: DataFrame, model: Model, *, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.3) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1) and predicted (1 from `threshold` on).

    A null or empty text has no feature; its score is that of the model's constant.  A null id is not held out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(text).cast("string"), F.col(doc_id).cast("long"))
    return rows.mapInArrow(_score(shared), "doc_id long, score double").select(
        "doc_id", is_held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.read(spark, sf_dir, "documents")
    return classify(docs, train(docs, store.read(spark, sf_dir, "labels")))
