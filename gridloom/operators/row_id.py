"""Dense row numbers 1..n without a global window.

The rows are already in order inside pieces (file splits, or written files).  Each piece is counted
once, the few counts are summed up in order, and every row adds the offset of its piece to its place
in it.  The table is neither sorted nor shuffled for it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from ..types import ROW_ID, column

PATH, BLOCK, MARK = "_split_path", "_split_block", "_split_mark"


def with_split_marks(df: DataFrame) -> DataFrame:
    """Add the file split of each row and its rising mark; ``df`` must be a plain file scan."""
    return df.select(
        "*",
        F.col("_metadata.file_path").alias(PATH),
        F.col("_metadata.file_block_start").alias(BLOCK),
        F.monotonically_increasing_id().alias(MARK),
    )


def file_order() -> list[Column]:
    """Source order of files: by folder, then by part number where Spark wrote them, then by name.

    Part numbers have five digits at least, so their names alone do not sort from 100 000 on.
    """
    folder = F.regexp_replace(F.col(PATH), r"[^/]*$", "")
    part = F.regexp_extract(F.col(PATH), r"/part-([0-9]+)[^/]*$", 1).try_cast("long")
    return [folder, part, F.col(PATH)]


def offsets(pieces: DataFrame, order: Sequence[Column], count: str) -> DataFrame:
    """Running count over the pieces: how many rows come before each.

    One row per piece, so the window holds as many rows as the table has files or splits.
    """
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return pieces.withColumn("offset", F.coalesce(F.sum(count).over(before), F.lit(0)))


def join_offsets(df: DataFrame, pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach the piece's columns to its rows; the size of the pieces decides how."""
    return df.join(pieces, list(keys), "left")


def join_listed(df: DataFrame, pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same for files and splits, which the driver lists anyway: they go to the rows.

    Dealt out by file, all rows of a large file would meet in one task.
    """
    return join_offsets(df, F.broadcast(pieces), keys)


def _checked(offset):
    return F.when(offset.isNull(), F.raise_error(F.lit("row numbering: the file splits changed between the two scans; keep the split settings and run again"))).otherwise(offset)


def number_splits(df: DataFrame, splits: DataFrame) -> DataFrame:
    """Number the rows of a marked scan, given (path, block, rows, first mark) per split.

    A mark tells a row's place only where this scan packs the splits into tasks as the counting scan did. Were a
    split moved, the places of its rows would all shift, so at least one of them would lie outside the
    split's count, which fails the query.
    """
    placed = offsets(splits, [*file_order(), F.col(BLOCK)], "rows").select(PATH, BLOCK, "offset", "first_mark", "rows")
    joined = join_listed(df, placed, [PATH, BLOCK])
    place = F.col(MARK) - F.col("first_mark")
    within = F.when((place >= 0) & (place < F.col("rows")), F.col("offset"))
    row_id = _checked(within) + place + 1
    names = [c for c in df.columns if c not in (PATH, BLOCK, MARK)]
    return joined.select(row_id.alias(ROW_ID), *[column(c) for c in names])


def number_files(df: DataFrame) -> DataFrame:
    """Number the rows of a plain Parquet scan in file order.

    Parquet gives each row its place in its file, so only the row count per file is needed, which
    is read from the footers alone.
    """
    located = df.select("*", F.col("_metadata.file_path").alias(PATH), F.col("_metadata.row_index").alias(MARK))
    per_file = located.groupBy(PATH).agg(F.count(F.lit(1)).alias("rows"))
    pieces = offsets(per_file, file_order(), "rows").select(PATH, "offset")
    joined = join_listed(located, pieces, [PATH])
    row_id = _checked(F.col("offset")) + F.col(MARK) + 1
    return joined.select(row_id.alias(ROW_ID), *[column(c) for c in df.columns])


def number(df: DataFrame, order_by: Sequence | None = None) -> DataFrame:
    """Number any DataFrame: by the given keys, else in the order it produces its rows.

    ``df`` is written once to the shared folder, range-partitioned and sorted by the keys, and the
    written files are numbered.  The keys must be unique, or complete enough that ties are equal
    rows; a hot leading key is split over partitions by the keys that follow it.
    """
    if order_by:
        df = df.orderBy(*order_by)
    return number_files(stage(df, "numbering"))


# Rows per numbering bucket: bounds what one window partition holds, whatever the data.
BUCKET_ROWS = 1_000_000


def renumber(df: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Close the gaps in the row ids of a filtered table, order kept.

    Ids are unique integers, so cutting their range into equal buckets gives evenly bounded groups:
    the buckets are counted (only the columns the filters need are read), then each bucket numbers
    its rows behind its offset.  One shuffle, on the bucket; no sampling and no second copy.
    """
    bucketed = df.withColumn("_bucket", F.floor((column(ROW_ID) - 1) / F.lit(bucket_rows)).cast("long"))
    counts = stage(bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("rows")), "buckets")
    placed = offsets(counts, [F.col("_bucket")], "rows").select("_bucket", "offset")
    inside = Window.partitionBy("_bucket").orderBy(column(ROW_ID))
    joined = join_offsets(bucketed, placed, ["_bucket"])
    new_id = _checked(F.col("offset")) + F.row_number().over(inside)
    names = [c for c in df.columns if c != ROW_ID]
    return joined.select(new_id.alias(ROW_ID), *[column(c) for c in names])
