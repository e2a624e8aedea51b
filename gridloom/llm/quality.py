"""Quality classifier: histogram gradient-boosted trees over document statistics.

Each whole text becomes a short vector of statistics in its task. Trees are grown by logistic
boosting over histograms of binned statistics, from the vectors of a bounded sample of labelled rows
(``TRAIN_ROWS``, taken by hash over all of them), and flattened into arrays of features, thresholds
and leaf values, which numpy walks for a block of documents at once, one step a level.

A null text counts as empty; it has a vector and a score like any other. Labels that disagree about a document are
averaged; null labels teach nothing; very long texts are read whole; without labels every score is 0.5. Repeated rows are scored row by
row. An empty table gives an empty result. Records travel in a struct, so column names cannot clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import register, schema_of, slices, table, utf8
from .language_id import fold

TRAIN_ROWS = 20_000
BINS = 64
TREES, DEPTH, RATE, RIDGE, LEAST_HESSIAN = 80, 4, 0.15, 2.0, 2.0
ACCEPT = 0.3

_CLASS = np.zeros(256, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4
_CLASS[[32, 9, 11, 12, 13]], _CLASS[10] = 5, 6
for _i, _c in enumerate(b".,!?|-'\"#$%&*"):
    _CLASS[_c] = 7 + _i
_CLASSES = 7 + 13


def statistics(text: bytes | None) -> list[float]:
    """The vector of one text: sizes, shares of character classes, word and line statistics, repetition."""
    text = text or b""
    n = len(text)
    share = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=_CLASSES) / max(n, 1)
    words = text.split()
    m = max(len(words), 1)
    seen = Counter(words)
    top = [c for _, c in seen.most_common(3)]
    runs = sum(a == b for a, b in zip(words, words[1:]))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    lines = [x for x in text.split(b"\n") if x.strip()]
    k = max(len(lines), 1)
    lengths = np.array([len(x) for x in lines] or [0])
    closed = sum(x.rstrip()[-1:] in b".!?:;" for x in lines)
    pairs = len(set(zip(words, words[1:]))) / max(len(words) - 1, 1)
    return [
        np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)), *share.tolist(),
        float(sizes.mean()), float(sizes.std()), float(sizes.max()), len(seen) / m, top[0] / m if top else 0.0, sum(top) / m,
        runs / m, pairs, len(set(lines)) / k, float(lengths.mean()), float(lengths.std()), closed / k,
        sum(c for c in seen.values() if c == 1) / m, sum(w.isupper() for w in seen) / max(len(seen), 1),
        sum(w[:1].isupper() for w in seen) / max(len(seen), 1),
    ]


FEATURES = len(statistics(b""))


class Trees:
    """Complete trees of one depth as arrays: node i has children 2i+1 and 2i+2, the leaves come last."""

    def __init__(self, base: float):
        self.base = base
        self.feature, self.threshold, self.leaf = [], [], []

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += leaf[at - (2**DEPTH - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def grow(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees for vectors ``x`` and labels ``y`` in 0..1."""
    if not len(y):
        return Trees(0.0)
    mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    trees = Trees(float(np.log(mean / (1 - mean))))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    raw, inner = np.full(len(y), trees.base), 2**DEPTH - 1
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, many = 2**level - 1, 2**level
            best = np.zeros(many)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                cell = (at - first) * BINS + binned[:, f]
                gl = np.bincount(cell, g, many * BINS).reshape(many, BINS).cumsum(1)
                hl = np.bincount(cell, h, many * BINS).reshape(many, BINS).cumsum(1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
                gain[(hl < LEAST_HESSIAN) | (ht - hl < LEAST_HESSIAN)] = 0
                gain = gain[:, : len(c)]
                cut = gain.argmax(1)
                better = gain[np.arange(many), cut] > best + 1e-9
                best = np.where(better, gain[np.arange(many), cut], best)
                feature[first:first + many][better] = f
                threshold[first:first + many][better] = c[cut[better]]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > threshold[at])
        of = at - inner
        leaf = -RATE * np.bincount(of, g, inner + 1) / (np.bincount(of, h, inner + 1) + RIDGE)
        trees.feature.append(feature)
        trees.threshold.append(threshold)
        trees.leaf.append(leaf)
        raw += leaf[of]
    return trees


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAIN_ROWS) -> Trees:
    """Trees from at most ``rows`` labelled documents, those of least hash."""
    given = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("double").alias("y")).where("id is not null and y is not null")
    given = given.groupBy("id").agg(F.avg("y").alias("y"))
    sample = given.orderBy(F.xxhash64("id"), "id").limit(rows)
    held = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    joined = held.join(F.broadcast(sample), "id").select("id", "y", "text")  # at most ``rows`` rows of two numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = [np.array(statistics(t)).tobytes() for t in utf8(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.binary())], names=["id", "y", "x"])

    vectors = joined.mapInArrow(run, schema_of(joined.select("id", "y").schema, "x binary")).groupBy("id").agg(F.first("y").alias("y"), F.min("x").alias("x"))
    taken = sorted(vectors.toLocalIterator(), key=lambda r: r["id"])
    x = np.array([np.frombuffer(r["x"]) for r in taken]).reshape(len(taken), FEATURES)
    return grow(x, np.array([r["y"] for r in taken]))


def score(docs: DataFrame, trees: Trees, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(rec, score) of each record."""
    kept = [F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]
    rows = docs.select(F.struct(*kept).alias("rec"), F.col(text).cast("string").alias("text"))
    shipped = docs.sparkSession.sparkContext.broadcast(trees)
    schema = schema_of(rows.select("rec").schema, "score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            x = np.array([statistics(t) for t in utf8(batch)]).reshape(batch.num_rows, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shipped.value.score(x))], names=["rec", "score"])

    return rows.mapInArrow(run, schema)


@register("op3_quality_trees")
def op3(spark, sf_dir):
    """Every document's quality, learned from four folds of five of the labels."""
    docs = table(spark, sf_dir, "documents")
    trees = train(docs, table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) != 0))
    found = score(docs, trees, keep=["doc_id"])
    return found.select(
        F.col("rec.doc_id").alias("doc_id"), (fold(F.col("rec.doc_id"), 5) == 0).alias("held_out"), "score",
        F.when(F.col("score") >= ACCEPT, 1).otherwise(0).alias("predicted"),
    )
