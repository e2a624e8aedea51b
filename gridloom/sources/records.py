"""CSV records with line breaks inside quotes, from files that are still split freely.

A quote parity scan: every split counts its quotes, and the parity of all quotes before a split tells whether it starts
inside a quoted cell. One pass walks the lines of each split under both assumptions at once, numbering the records that
start in it; the few facts of each split (its parity, its record counts) then decide which assumption holds, and
which record the lines before its first start belong to. Records of one line are used where they are; only
lines of longer records are shuffled, by record. The records are written once to the shared folder, as header, types and
cells are read from them in turn. Cells are parsed by Spark's own CSV parser.

Doubled quotes leave the parity as it is. A line that opens a quote anywhere but at the start of a cell, or a file that ends
inside quotes, is refused with ``file_parse_failed``. Lines of white space between records are skipped. A record lies in one
row, so its length is what bounds a task's memory. Compressed files are one split each.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import WorkspaceError
from ..functions.names import normalize_headers
from ..operators.row_id import BLOCK, MARK, PATH
from ..session import stage, stored_bytes
from ..types import Field, validate_fields

LINE_SCHEMA = "path string, block bigint, mark bigint, line string, inside boolean, odd boolean, blank boolean, bad boolean, p0 bigint, p1 bigint"

#: A task takes several splits that are smaller than this together, in which starting it would cost more than its lines.
TASK_BYTES = 4 << 20

#: A line that opens a quoted cell which it does not close: whole cells, then a quote at the start of a cell.
_OPENS = re.compile(r'(?:(?:"(?:[^"]|"")*+"|[^",]*+),)*+"(?:[^"]|"")*+\Z', re.DOTALL)


def _walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in order: whether an odd number of quotes lies before each in its split, and how many records have started.

    ``p0`` and ``p1`` count the starts up to and with the line, if the split begins outside or inside quotes.
    """
    now, parity, started = None, 0, [0, 0]
    for batch in batches:
        path, block = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        odd = pc.count_substring(batch.column(0), '"').to_numpy() & 1
        blank = pc.equal(pc.utf8_trim_whitespace(batch.column(0)), "").to_numpy(zero_copy_only=False)
        n = batch.num_rows
        keys = list(zip(path, block))
        cuts = [0, *[i for i in range(1, n) if keys[i] != keys[i - 1]], n] if n else [0]
        inside, counts = np.zeros(n, np.int64), np.zeros((2, n), np.int64)
        for a, b in zip(cuts, cuts[1:]):
            if keys[a] != now:
                now, parity, started = keys[a], 0, [0, 0]
            total = parity + np.cumsum(odd[a:b])
            inside[a:b] = (total - odd[a:b]) & 1
            for assumed in (0, 1):
                starts = (inside[a:b] == assumed) & ~blank[a:b]
                counts[assumed, a:b] = started[assumed] + np.cumsum(starts)
                started[assumed] = int(counts[assumed, b - 1])
            parity = int(total[-1]) & 1
        bad = np.zeros(n, bool)
        for i in np.flatnonzero(odd).tolist():
            bad[i] = _OPENS.match(batch.column(0)[i].as_py()) is None
        yield pa.RecordBatch.from_arrays([
            batch.column(1), batch.column(2), batch.column(3), batch.column(0), pa.array(inside == 1), pa.array(odd == 1), pa.array(blank),
            pa.array(bad), pa.array(counts[0]), pa.array(counts[1]),
        ], names=["path", "block", "mark", "line", "inside", "odd", "blank", "bad", "p0", "p1"])


def walked_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(list(paths)).select(
        F.coalesce("value", F.lit("")).alias("line"), F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("mark"),
    )
    tasks = max(spark.sparkContext.defaultParallelism, stored_bytes(lines) // TASK_BYTES)
    return lines.coalesce(tasks).mapInArrow(_walk, LINE_SCHEMA)


def split_facts(lines: DataFrame) -> DataFrame:
    """(path, block, inside_first, rows, before, last_block, last_place): a row for each split, placed among the others.

    Raises where a quote opens in the middle of a cell or is never closed.
    """
    raw = stage(lines.groupBy("path", "block").agg(
        F.bit_xor(F.col("odd").cast("int")).alias("parity"), F.max("p0").alias("n0"), F.max("p1").alias("n1"),
        F.max(F.col("bad") & ~F.col("inside")).alias("bad0"), F.max(F.col("bad") & F.col("inside")).alias("bad1"),
    ), "csv-splits")
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("parity").over(earlier), F.lit(0)) % 2 == 1
    placed = raw.withColumn("inside_first", inside).withColumn("rows", F.when(F.col("inside_first"), F.col("n1")).otherwise(F.col("n0")))
    holder = F.last(F.when(F.col("rows") > 0, F.struct("block", "rows")), ignorenulls=True).over(earlier)
    placed = placed.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0))).withColumn("holder", holder)
    placed = stage(placed, "csv-splits")
    torn = F.max(F.when(F.col("inside_first"), F.col("bad1")).otherwise(F.col("bad0")))
    open_end = placed.groupBy("path").agg((F.sum("parity") % 2 == 1).alias("open"), torn.alias("torn"))
    if not open_end.where("open OR torn").isEmpty():
        raise WorkspaceError("file_parse_failed", "A quote opens inside a cell or is never closed")
    return placed.select(
        "path", "block", "inside_first", "rows", "before", F.col("holder.block").alias("last_block"), F.col("holder.rows").alias("last_place"),
    )


def records(lines: DataFrame, splits: DataFrame) -> DataFrame:
    """(path, block, place, before, record): each record with the split it starts in and its place there, from 1."""
    facts = lines.join(F.broadcast(splits), ["path", "block"])  # the driver lists the splits anyway
    inside = F.col("inside") != F.col("inside_first")
    own = F.when(F.col("inside_first"), F.col("p1")).otherwise(F.col("p0"))
    facts = facts.select(
        "path", "line", "mark", inside.alias("goes_on"), "odd", F.col("block").alias("lies_in"),
        F.when(own > 0, F.col("block")).otherwise(F.col("last_block")).alias("block"),
        F.when(own > 0, own).otherwise(F.col("last_place")).alias("place"),
        F.when(own > 0, F.col("before")).otherwise(F.lit(None)).alias("before"), "blank",
    ).where(F.col("goes_on") | ~F.col("blank"))
    whole = ~F.col("goes_on") & ~F.col("odd")
    single = facts.where(whole).select("path", "block", "place", "before", F.col("line").alias("record"))
    parts = F.sort_array(F.collect_list(F.struct("lies_in", "mark", "line")))
    longer = facts.where(~whole).groupBy("path", "block", "place").agg(parts.alias("parts"), F.max("before").alias("before"))
    joined = F.array_join(F.transform("parts", lambda p: p["line"]), "\n")
    return single.unionByName(longer.select("path", "block", "place", "before", joined.alias("record")))


def read_records(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """CSV files that share one header: all cells as text, with the marks that number rows in file order."""
    from .delimited import OPTIONS, check_file_type, suffix_of

    paths = [paths] if isinstance(paths, str) else list(paths)
    for path in paths:
        if suffix_of(path) and not path.endswith("/"):
            check_file_type(path)
    lines = walked_lines(spark, paths)
    splits = split_facts(lines)
    found = records(lines, splits).withColumn("record", F.regexp_replace("record", r"\r$", ""))
    found = stage(found, "csv-records")
    is_header = (F.col("before") == 0) & (F.col("place") == 1)
    headers = found.where(is_header).groupBy("record").agg(F.count(F.lit(1)).alias("files")).limit(2).collect()
    if not headers:
        raise WorkspaceError("empty_file", "The file has no rows")
    if len(headers) > 1:
        raise WorkspaceError("file_header_mismatch", "The files do not share one header")
    raw = next(csv.reader([headers[0]["record"].removeprefix("﻿")], strict=False))
    names = normalize_headers([name or None for name in raw])
    validate_fields([Field(n, "text") for n in names])
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    cells = found.where(~is_header).select(
        F.from_csv("record", schema, OPTIONS).alias("cell"), F.col("path").alias(PATH), F.col("block").alias(BLOCK), F.col("place").alias(MARK),
    )
    return cells.select(*[F.col(f"cell.c{i}").alias(n) for i, n in enumerate(names)], PATH, BLOCK, MARK)


__all__ = ["read_records", "records", "split_facts", "walked_lines"]
