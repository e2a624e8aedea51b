"""Language identification by error-correcting output codes.

Every language gets a codeword of +1 and -1. One binary classifier a bit, over hashed byte trigrams, tells the
languages with +1 from those with -1: its weights are the log odds of the trigram counts of all labelled texts,
summed over the executors. A text's bit margins are decoded to the codeword of least weighted logistic
loss; a bit weighs as much as it parts its two sides. The score is the share of the best codeword in
the softmax of the negative losses, and a text whose best two codewords lie close is flagged ambiguous.

A null text, one without a letter, and any text when nothing was learned are ``und`` with score 0. Texts
with a null label teach nothing. Of codewords equally near, the language first by name is taken, and the text is
ambiguous. Very long texts are read whole. Repeated rows count as often as they occur. An empty table gives an empty
result. Records travel in a struct, so column names cannot clash. The model's size is fixed by the number of
languages, which is taken to be a list of languages and not data.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pylist, register, schema_of, slices, table, utf8

CELLS = 1 << 14
SCALE = 1024
SMOOTHING = 0.5
AMBIGUOUS = 0.2
UNKNOWN = "und"
TASKS_SUMMED = 256

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def trigrams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of all trigrams of the texts, where each text starts in them, and which of them lie in one text."""
    padded = [b" " + (t or b"").translate(_LETTERS) + b"  " for t in texts]
    a = np.frombuffer(b"".join(padded), np.uint8).astype(np.uint32)
    ends = np.cumsum([len(p) for p in padded])
    h = np.zeros(len(a), np.uint32)
    h[:-2] = (a[:-2] * np.uint32(0x9E3779B1)) ^ (a[1:-1] * np.uint32(0x85EBCA77) + (a[2:] * np.uint32(0xC2B2AE3D) >> np.uint32(7)))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x27D4EB2F)
    inside = np.ones(len(a), bool)
    inside[ends - 1] = inside[ends - 2] = False
    return (h >> np.uint32(18)).astype(np.int32), np.concatenate(([0], ends[:-1])), inside


def counts_by_language(texts: DataFrame) -> DataFrame:
    """(lang, counts): hashed trigram counts of ``texts`` (lang, text), a text giving log(1 + count) of each cell."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        part = 0
        for batch in slices(batches):
            part = batch.column(2)[0].as_py()
            cells, starts, inside = trigrams(utf8(batch))
            for lang, a, b in zip(pylist(batch, "lang"), starts, [*starts[1:], len(cells)]):
                c = np.bincount(cells[a:b][inside[a:b]], minlength=CELLS)
                total.setdefault(lang, np.zeros(CELLS, np.int64))[:] += np.rint(np.log1p(c) * SCALE).astype(np.int64)
        for lang, c in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang]), pa.array([part % TASKS_SUMMED], pa.int32()), pa.array([c.tobytes()], pa.binary())], names=["lang", "part", "counts"]
            )

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(CELLS, np.int64)
        for blob in group.column("counts"):
            total += np.frombuffer(blob.as_py(), np.int64)
        return pa.table([group.column("lang")[:1], pa.array([total.tobytes()], pa.binary())], names=["lang", "counts"])

    rows = texts.select("lang", "text", F.spark_partition_id().alias("part"))
    some = rows.mapInArrow(count, "lang string, part int, counts binary")
    some = some.groupBy("lang", "part").applyInArrow(add, "lang string, counts binary")
    return some.groupBy("lang").applyInArrow(add, "lang string, counts binary")


def codewords(languages: int, seed: int = 11) -> np.ndarray:
    """A row of +1 and -1 for each language: every split of few languages, else the best of some random codes."""
    if languages < 2:
        return np.ones((languages, 1))
    if languages <= 5:
        columns = [(1.0, *bits) for bits in itertools.product((1.0, -1.0), repeat=languages - 1)][1:]
        return np.array(columns).T
    rng = np.random.default_rng(seed)
    bits = 5 * int(np.ceil(np.log2(languages)))

    def apart(code: np.ndarray) -> float:
        return -np.max(np.where(np.eye(languages, dtype=bool), -bits, code @ code.T))

    codes = [np.where(rng.random((languages, bits)) < 0.5, 1.0, -1.0) for _ in range(200)]
    codes = [c for c in codes if (np.abs(c.sum(0)) < languages).all()] or codes
    return max(codes, key=apart)


class Model:
    """Languages, codewords, a weight for each bit and cell, and each bit's weight in the loss."""

    def __init__(self, counted: list[tuple[str, bytes]]):
        counted = sorted(counted)
        self.languages = [lang for lang, _ in counted]
        self.code = codewords(len(counted))
        if not counted:
            return
        p = np.array([np.frombuffer(c, np.int64) for _, c in counted], float) / SCALE + SMOOTHING
        p /= p.sum(1, keepdims=True)
        weights, bits = [], []
        for column in self.code.T:
            one, other = p[column > 0], p[column < 0]
            if not len(other):
                weights.append(np.zeros(CELLS))
                bits.append(1.0)
                continue
            one, other = one.mean(0), other.mean(0)
            w = np.log(one) - np.log(other)
            weights.append(w)
            bits.append(float(((one - other) * w).sum()))
        self.weights = np.array(weights, np.float32)
        self.bits = np.array(bits) / np.mean(bits)

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shares of the languages (texts x languages), and whether the best two lie close."""
        loss = np.stack([(self.bits * np.logaddexp(0, -margins * word)).sum(1) for word in self.code], 1)
        share = np.exp(loss.min(1, keepdims=True) - loss)
        share /= share.sum(1, keepdims=True)
        top = np.sort(share, 1)
        close = top[:, -1] - top[:, -2] < AMBIGUOUS if share.shape[1] > 1 else np.zeros(len(share), bool)
        return share, close

    def margins(self, texts: list[bytes | None]) -> np.ndarray:
        cells, starts, inside = trigrams(texts)
        n = np.add.reduceat(inside.astype(np.int64), starts)
        out = np.empty((len(texts), len(self.weights)))
        for b, w in enumerate(self.weights):
            v = w[cells]
            v[~inside] = 0
            out[:, b] = np.add.reduceat(v.astype(np.float64), starts)
        return out / np.sqrt(np.maximum(n, 1))[:, None]


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    rows = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    rows = rows.where("lang is not null and text is not null")
    return Model([tuple(r) for r in counts_by_language(rows).collect()])  # a row for each language


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(rec, lang_pred, score, ambiguous) of each record."""
    kept = [F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]
    value = F.col(text).cast("string")
    rows = docs.select(F.struct(*kept).alias("rec"), F.coalesce(value.rlike(r"\p{L}"), F.lit(False)).alias("letters"), value.alias("text"))
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    schema = schema_of(rows.select("rec").schema, "lang_pred string, score double, ambiguous boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in slices(batches):
            letters = np.array(pylist(batch, "letters"), bool)
            if not model.languages:
                letters[:] = False
            lang, score, close = np.full(len(letters), UNKNOWN, object), np.zeros(len(letters)), np.ones(len(letters), bool)
            if letters.any():
                share, near = model.decode(model.margins(utf8(batch)))
                best = share.argmax(1)
                lang = np.where(letters, np.array(model.languages, object)[best], UNKNOWN)
                score = np.where(letters, share[np.arange(len(best)), best], 0.0)
                close = near | ~letters
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(lang.tolist(), pa.string()), pa.array(score), pa.array(close)
            ], names=["rec", "lang_pred", "score", "ambiguous"])

    return rows.mapInArrow(run, schema)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


@register("op4_language_id")
def op4(spark, sf_dir):
    """Every document's language, learned from three folds of four."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(fold(F.col("doc_id"), 4) != 2))
    found = identify(docs, model, keep=["doc_id"])
    return found.select(
        F.col("rec.doc_id").alias("doc_id"), (fold(F.col("rec.doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous"
    )
