"""Embedding whitening by a polarisation covariance.

Vectors become integer vectors x = floor(256 * entry). The fit list holds each distinct x once. Its entries are centred
at a whole number near their mean; then the squared centred value of every dimension, and of the sum of every pair of
dimensions, is added up exactly over all tasks. Sums of squares less the squared sums are variances, and
Cov(i, j) = (Var(i + j) - Var(i) - Var(j)) / 2 recovers all cross-covariances, so rows are only ever squared and added:
each task sends one number for each dimension and pair, however many rows it has read. The matrix is assembled for
``eigh`` on the driver; its size depends on the dimension alone.

The distinct vectors are found by a group-by on their packed bytes, which combines copies before the shuffle, so a
vector that a third of the rows share is one row of each task. Packed vectors take one to eight bytes an entry.

Rows whose vector is null, or holds a null, NaN or infinite entry, are dropped; so are vectors without entries. The
dimension is the length that most remaining rows have (the longer one of equally many); rows of another length are
dropped. Products beyond 64-bit integers end at their bounds. Repeated rows are all returned, with the same numbers. An
empty table gives no rows. A component without variance (equal vectors, fewer vectors than dimensions) is returned with
null for ``whitened``. A deviation beyond 64 bits is null there and exact in ``deviation_text``. The record travels in a
struct, so column names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import stage
from gridloom.types import column

from .common import register, schema_of, table

SCALE = 256
COMPONENTS = 4
#: Partial sums travel in digits of this many bits, so that no sum of theirs overflows.
DIGIT = 40
#: Rows squared at a time; with entries below 2**SAFE_BITS their sums stay in 64 bits.
ROWS = 1 << 12
SAFE_BITS = 23


def whole(values: np.ndarray) -> np.ndarray:
    """floor(256 * value) as 64-bit integers, ending at their bounds."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * SCALE)
    top = scaled >= 2.0**63
    out = np.where(top, 0, np.maximum(scaled, -(2.0**63))).astype(np.int64)
    out[top] = np.iinfo(np.int64).max
    return out


def usable(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, start, length) of the lists that are there, have entries, and hold finite numbers only."""
    offsets = lists.offsets.to_numpy()
    start, length = offsets[:-1].astype(np.int64), np.diff(offsets).astype(np.int64)
    flat = lists.values
    bad = np.zeros(len(flat) + 1, np.int64)
    bad[1:] = np.cumsum(~np.isfinite(flat.fill_null(np.nan).to_numpy(zero_copy_only=False)))
    there = lists.is_valid().to_numpy(zero_copy_only=False) & (length > 0) & (bad[offsets[1:]] == bad[offsets[:-1]])
    rows = np.flatnonzero(there)
    return rows, start[rows], length[rows]


def vectors(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, x) for the usable lists of a column, lists of one length at a time."""
    rows, start, length = usable(lists)
    flat = lists.values.fill_null(np.nan).to_numpy(zero_copy_only=False)
    for d in np.unique(length).tolist():
        of = length == d
        yield rows[of], whole(flat[start[of][:, None] + np.arange(d)])


def packed(x: np.ndarray) -> list[bytes]:
    """Each row as bytes: the bytes an entry takes, then the entries; equal for equal rows only."""
    out: list[bytes] = [b""] * len(x)
    least, most = x.min(axis=1), x.max(axis=1)
    left = np.ones(len(x), bool)
    for width in (1, 2, 4, 8):
        kind = np.iinfo(f"i{width}")
        fits = np.flatnonzero(left & (least >= kind.min) & (most <= kind.max))
        left[fits] = False
        raw, step = x[fits].astype(f"<i{width}").tobytes(), x.shape[1] * width
        for i, r in enumerate(fits.tolist()):
            out[r] = bytes([width]) + raw[i * step:(i + 1) * step]
    return out


def unpacked(rows: list[bytes], d: int) -> np.ndarray:
    """The matrix of packed rows, in any order."""
    parts = []
    for width in (1, 2, 4, 8):
        mine = [r for r in rows if r[0] == width]
        if mine:
            raw = np.frombuffer(b"".join(mine), np.uint8).reshape(len(mine), 1 + width * d)[:, 1:]
            parts.append(np.ascontiguousarray(raw).view(f"<i{width}").astype(np.int64))
    return np.concatenate(parts) if parts else np.zeros((0, d), np.int64)


def digits(value: int) -> Iterator[tuple[int, int]]:
    """(place, digit) of a whole number; only the last digit may be negative."""
    place = 0
    while abs(value) >> DIGIT:
        yield place, value & ((1 << DIGIT) - 1)
        value >>= DIGIT
        place += 1
    yield place, value


def exact_sum(x: np.ndarray, bits: int) -> np.ndarray:
    """Column sums as Python integers, of rows whose entries stay below 2**bits."""
    if bits + max(len(x), 1).bit_length() < 63:
        return x.sum(axis=0).astype(object)
    return x.astype(object).sum(axis=0)


def bits_of(x: np.ndarray) -> int:
    return max(int(x.max(initial=0)), -int(x.min(initial=0))).bit_length()


def polarised(y: np.ndarray) -> np.ndarray:
    """Sums of y_i, of y_i squared, and of (y_i + y_j) squared for i < j, one after the other, as Python integers."""
    d = y.shape[1]
    bits = bits_of(y)
    if bits > SAFE_BITS:
        y = y.astype(object)
    squares = [exact_sum(y * y, 2 * bits)]
    for i in range(d - 1):
        pair = y[:, i + 1:] + y[:, i:i + 1]
        squares.append(exact_sum(pair * pair, 2 * bits + 2))
    return np.concatenate([exact_sum(y, bits), *squares])


def _summed(distinct: DataFrame, d: int, centre: list[int], squares: bool) -> list[int]:
    """Exact sums over the packed rows, added by Spark."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        middle = np.array(centre, object)
        wide = any(abs(c) >> 61 for c in centre)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                x = unpacked(batch.column(0).slice(at, ROWS).to_pylist(), d)
                if squares:
                    wide_now = wide or bits_of(x) > 61
                    part = polarised(x.astype(object) - middle if wide_now else x - middle.astype(np.int64))
                else:
                    part = exact_sum(x, bits_of(x))
                total = part if total is None else total + part
        if total is not None:
            rows = [(k, place, digit) for k, v in enumerate(total.tolist()) for place, digit in digits(v)]
            yield pa.RecordBatch.from_pydict(
                {n: pa.array(c, t) for n, c, t in zip(("k", "place", "digit"), zip(*rows), (pa.int32(), pa.int32(), pa.int64()))}
            )

    parts = distinct.select("x").mapInArrow(run, "k int, place int, digit bigint")
    sums = parts.groupBy("k", "place").agg(F.sum(F.col("digit").cast("decimal(38,0)")).alias("digit")).collect()
    out = [0] * (1 + max((r["k"] for r in sums), default=-1))
    for r in sums:
        out[r["k"]] += int(r["digit"]) << (DIGIT * r["place"])
    return out


class Whitening:
    """What was fitted: n, the sums, the mean, the components and their eigenvalues, and how close to the identity."""

    def __init__(self, n: int, sums: list[int], covariance: list[list[Fraction]], components: int):
        self.n, self.sums, self.d = n, sums, len(sums)
        self.mean = np.array([float(Fraction(s, n)) for s in sums])
        self.covariance = np.array([[float(v) for v in row] for row in covariance])
        values, axes = np.linalg.eigh(self.covariance)
        order = np.argsort(-values, kind="stable")[:components]
        self.values, self.axes = values[order], axes[:, order]
        turn = np.sign(self.axes[np.abs(self.axes).argmax(axis=0), np.arange(len(order))])
        self.axes = self.axes * np.where(turn == 0, 1, turn)
        trace = float(sum(covariance[i][i] for i in range(self.d)))
        self.live = self.values > trace * self.d * np.finfo(float).eps
        self.explained = self.values / trace if trace else np.full(len(order), np.nan)
        self.identity_error = 0.0

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates; NaN in a component without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(self.live, 1 / np.sqrt(np.where(self.live, self.values, 1)), np.nan)
        return ((x.astype(float) - self.mean) @ self.axes) * scale

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sum over dimensions of (n * x - S)**2, exactly."""
        sums = np.array(self.sums, object)
        bits = bits_of(x) + self.n.bit_length() + 1
        if max(bits, max(abs(s) for s in self.sums).bit_length() + 1) * 2 + self.d.bit_length() < 62:
            off = x * self.n - sums.astype(np.int64)
        else:
            off = x.astype(object) * self.n - sums
        return (off * off).sum(axis=1).tolist()


def covariance(n: int, sums: list[int], d: int) -> list[list[Fraction]]:
    """The exact matrix from the polarised sums: y_i, then squares of y_i, then of y_i + y_j."""
    first, square, pair = sums[:d], sums[d:2 * d], iter(sums[2 * d:])
    spread = [n * q - s * s for q, s in zip(square, first)]
    out = [[Fraction(0)] * d for _ in range(d)]
    for i in range(d):
        out[i][i] = Fraction(spread[i], n * n)
        for j in range(i + 1, d):
            both = n * next(pair) - (first[i] + first[j]) ** 2
            out[i][j] = out[j][i] = Fraction(both - spread[i] - spread[j], 2 * n * n)
    return out


def pack(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """(d, x): the length and the packed whole numbers of each usable vector."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in vectors(batch.column(0)):
                yield pa.RecordBatch.from_pydict({
                    "d": pa.array(np.full(len(x), x.shape[1], np.int32)), "x": pa.array(packed(x), pa.binary()),
                })

    return df.select(column(vector).cast("array<double>").alias("v")).mapInArrow(run, "d int, x binary")


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Fit on each distinct vector of ``df`` once; None where no vector is usable."""
    distinct = stage(pack(df, vector).groupBy("d", "x").agg(F.count(F.lit(1)).alias("rows")), "distinct-vectors")
    lengths = distinct.groupBy("d").agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("n"))
    most = lengths.orderBy(F.desc("rows"), F.desc("d")).first()
    if most is None:
        return None
    d, n = most["d"], most["n"]
    fitted = distinct.where(F.col("d") == d)
    sums = _summed(fitted, d, [0] * d, squares=False)
    polar = _summed(fitted, d, [s // n for s in sums], squares=True)
    model = Whitening(n, sums, covariance(n, polar, d), components)
    model.identity_error = _identity_error(fitted, model)
    return model


def _identity_error(fitted: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the covariance of what is whitened, less the identity."""
    live = np.flatnonzero(model.live)
    if not len(live):
        return 0.0

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 + len(live), len(live)))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                w = model.project(unpacked(batch.column(0).slice(at, ROWS).to_pylist(), model.d))[:, live]
                total[0] += w.sum(axis=0)
                total[1:] += w.T @ w
        yield pa.RecordBatch.from_pydict({"k": pa.array(np.arange(total.size, dtype=np.int32)), "v": pa.array(total.ravel())})

    parts = fitted.select("x").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((1 + len(live)) * len(live))
    for r in parts:
        total[r["k"]] = r["v"]
    total = total.reshape(1 + len(live), len(live)) / model.n
    return float(np.abs(total[1:] - np.outer(total[0], total[0]) - np.eye(len(live))).max())


def transform(df: DataFrame, model: Whitening, vector: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """(rec, whitened, deviation, deviation_text) for each row with a usable vector of the model's dimension."""
    kept = [column(c).alias(c) for c in (df.columns if keep is None else keep)]
    rows = df.select(F.struct(*kept).alias("rec"), column(vector).cast("array<double>").alias("v"))
    schema = schema_of(rows.select("rec").schema, "whitened array<double>, deviation bigint, deviation_text string")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for of, x in vectors(batch.column(1)):
                if x.shape[1] != model.d:
                    continue
                w = model.project(x)
                offsets = pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1], pa.int32())
                flat = pa.array(w.ravel(), mask=np.isnan(w.ravel()))
                far = model.deviations(x)
                arrays = [
                    batch.column(0).take(pa.array(of)), pa.ListArray.from_arrays(offsets, flat),
                    pa.array([v if v < 1 << 63 else None for v in far], pa.int64()), pa.array(map(str, far), pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["rec", "whitened", "deviation", "deviation_text"])

    return rows.mapInArrow(run, schema)


@register("op11_embedding_whitening")
def op11(spark, sf_dir):
    """Every embedding, whitened by the covariance of the distinct ones."""
    rows = table(spark, sf_dir, "embeddings")
    model = fit(rows)
    if model is None:
        return spark.createDataFrame(
            [], "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, "
            "identity_error double, deviation_text string",
        )
    out = transform(rows, model, keep=["vec_id"])
    share = F.array(*[F.lit(None if np.isnan(v) else float(v)).cast("double") for v in model.explained])
    return out.select("*", F.posexplode("whitened").alias("at", "w")).select(
        F.col("rec.vec_id").alias("vec_id"), (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("bigint").alias("n"),
        "deviation", F.col("w").alias("whitened"), F.get(share, F.col("at")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"), "deviation_text",
    )
