"""Helpers shared by the operators: walking Arrow batches, tables of named queries, component labels."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql import functions as F

from gridloom.session import stage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: Rows turned into Python objects at a time; bounds a worker's memory however large Spark's batches are.
SLICE = 128


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLE[name] = sql
        return query

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def schema_of(*parts: T.StructType | str) -> T.StructType:
    """One schema of the fields of several, each a schema or a DDL text; every field may be null."""
    fields = [f for p in parts for f in (T.StructType.fromDDL(p) if isinstance(p, str) else p).fields]
    return T.StructType([T.StructField(f.name, nullable(f.dataType)) for f in fields])


def nullable(kind: T.DataType) -> T.DataType:
    """The type with nulls allowed all the way down."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, nullable(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(nullable(kind.elementType))
    if isinstance(kind, T.MapType):
        return T.MapType(nullable(kind.keyType), nullable(kind.valueType))
    return kind


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of a few rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def blocks(
    batches: Iterable[pa.RecordBatch], weight: Callable[[pa.RecordBatch], int], limit: int, rows: int = SLICE
) -> Iterator[list[pa.RecordBatch]]:
    """Runs of slices whose weights reach ``limit`` together; one heavy slice is a run of its own."""
    run: list[pa.RecordBatch] = []
    held = 0
    for piece in slices(batches, rows):
        run.append(piece)
        held += weight(piece)
        if held >= limit:
            yield run
            run, held = [], 0
    if run:
        yield run


Batches = Iterator[pa.RecordBatch]


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` for mapInArrow, which gives the memory that it has freed back to the system; workers outlive their tasks."""

    def tidied(batches: Batches) -> Batches:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return tidied


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> int:
    return batch.column(batch.schema.get_field_index(name)).nbytes


def pylist(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def utf8(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """A text column as UTF-8 bytes, without decoding it."""
    column = batch.column(batch.schema.get_field_index(name))
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


#: Bits of a key filter, and of each piece of one: its size is fixed, whatever the number of keys.
FILTER_BITS, PIECE_BITS = 1 << 26, 1 << 15


class KeyFilter:
    """A test whether a 64-bit key may be among ``keys`` (one column); it never misses one of them.

    Each task packs its keys into pieces of a bitmap, pieces are joined by Spark, and the whole is broadcast. With so many
    keys that most bits are set the test lets everything through; whoever uses it joins exactly afterwards.
    """

    def __init__(self, keys: DataFrame):
        self.shipped, self.mark = keys.sparkSession.sparkContext.broadcast(_bitmap(keys)), uuid.uuid4().hex

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        """For each of some keys, in a task."""
        held = _filters.get(self.mark)
        if held is None:
            _filters.clear()
            held = _filters[self.mark] = np.frombuffer(zstandard.decompress(self.shipped.value), np.uint8)
        bit = keys.astype(np.int64, copy=False).view(np.uint64) % np.uint64(FILTER_BITS)
        return (held[bit >> np.uint64(3)] >> (np.uint64(7) - (bit & np.uint64(7))).astype(np.uint8)) & 1 == 1

    def column(self, key: Column) -> Column:
        """As a column; only the keys go to Python."""
        test = self.may_hold

        @F.arrow_udf("boolean")
        def may_hold(key: pa.Array) -> pa.Array:
            return pa.array(test(key.to_numpy(zero_copy_only=False)))

        return may_hold(key)


#: The filter a worker has unpacked last.
_filters: dict[str, np.ndarray] = {}


def _bitmap(keys: DataFrame) -> bytes:
    name = keys.columns[0]

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [np.unique(b.column(0).to_numpy().view(np.uint64) % np.uint64(FILTER_BITS)) for b in batches]
        if not bits:
            return
        whole = np.unique(np.concatenate(bits)).astype(np.int64)
        piece, first = np.unique(whole // PIECE_BITS, return_index=True)
        blobs = []
        for mine in np.split(whole % PIECE_BITS, first[1:]):
            flags = np.zeros(PIECE_BITS, np.uint8)
            flags[mine] = 1
            blobs.append(zstandard.compress(np.packbits(flags).tobytes(), 1))
        yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(blobs, pa.binary())], names=["piece", "bits"])

    def join(group: pa.Table) -> pa.Table:
        total = np.zeros(PIECE_BITS // 8, np.uint8)
        for b in group.column("bits"):
            total |= np.frombuffer(zstandard.decompress(b.as_py()), np.uint8)
        return pa.table([group.column("piece")[:1], pa.array([zstandard.compress(total.tobytes(), 1)], pa.binary())], names=["piece", "bits"])

    schema = "piece int, bits binary"
    parts = keys.where(F.col(name).isNotNull()).mapInArrow(pack, schema).groupBy("piece").applyInArrow(join, schema)
    whole = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in parts.collect():  # FILTER_BITS / PIECE_BITS rows at most
        start = row["piece"] * (PIECE_BITS // 8)
        whole[start:start + PIECE_BITS // 8] = np.frombuffer(zstandard.decompress(row["bits"]), np.uint8)
    return zstandard.compress(whole.tobytes(), 1)


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for each node of the undirected ``edges`` (a, b); root is the component's least node.

    Alternates the large-star and small-star steps of Kiveris et al. until no edge moves. Each step is
    aggregations and joins whose hot nodes Spark may split; each round is written to the shared folder.
    """
    ordered = F.col("a") != F.col("b")
    now = stage(
        edges.where(ordered).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label
    )
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        if not state[0]:
            break
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stage(large.where(ordered), label)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(small.select("a", F.col("m").alias("b")))
        now = stage(small.where(ordered).distinct(), label)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)
