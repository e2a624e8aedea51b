"""Materialized tables: create-only Parquet sink with row identity, paging, full reads, export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..errors import WorkspaceError
from ..operators import row_id
from ..types import ROW_ID, Field, annotate, column, fields_of, validate_fields

MAX_PAGE_SIZE = 200  # fixed value
EXPORT_FORMATS = ("csv", "parquet", "json")


def write(
    df: DataFrame,
    path: str,
    *,
    fields: Sequence[Field] | None = None,
    order_by: Sequence | None = None,
    kind: str = "dataset",
) -> tuple[DataFrame, int]:
    """Create a table at ``path``: row id first, declared fields kept; returns (table, row count).

    A frame that already carries row ids is written as it is.  An existing path is an error.  The
    commit protocol publishes all files or none.
    """
    declared = list(fields) if fields is not None else fields_of(df)
    validate_fields(declared, kind)
    if ROW_ID not in df.columns:
        df = row_id.number(df, order_by)
    df = annotate(df.select(column(ROW_ID), *[column(f.name) for f in declared]), declared)
    for f in declared:
        if not f.nullable and df.schema[f.name].nullable:
            guard = F.raise_error(F.lit(f"null in non-nullable field {f.name}"))
            df = df.withColumn(
                f.name, F.when(column(f.name).isNull(), guard).otherwise(column(f.name)).alias(f.name, metadata=f.metadata)
            )
    counted = Observation()
    try:
        df.observe(counted, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists").parquet(path)
    except AnalysisException as error:
        if "PATH_ALREADY_EXISTS" in str(error):
            raise WorkspaceError("physical_table_exists", f"A table exists at {path}") from None
        raise
    return open_table(df.sparkSession, path), counted.get["rows"]


def open_table(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise WorkspaceError("physical_table_not_found", f"No table at {path}") from None
        raise


def check_page(page: int, page_size: int) -> None:
    if page < 1:
        raise WorkspaceError("invalid_page", "Pages are counted from 1")
    if not 1 <= page_size <= MAX_PAGE_SIZE:
        raise WorkspaceError("invalid_page_size", f"A page holds 1 to {MAX_PAGE_SIZE} rows")


def page(df: DataFrame, page: int = 1, page_size: int = 20) -> DataFrame:
    """One page by row id.  Ids are dense, so this is a range filter that Parquet statistics prune,
    not a sort of the table; only the page itself is sorted.
    """
    check_page(page, page_size)
    low = (page - 1) * page_size
    wanted = (column(ROW_ID) > low) & (column(ROW_ID) <= low + page_size)
    return df.filter(wanted).orderBy(column(ROW_ID))


def rows(df: DataFrame, *, ordered: bool = False) -> DataFrame:
    """The whole table; sorted by row id only when asked, as a sort is a shuffle."""
    return df.orderBy(column(ROW_ID)) if ordered else df


def export(df: DataFrame, path: str, file_format: str = "csv") -> None:
    """Write a view for use elsewhere, without the row id."""
    if file_format not in EXPORT_FORMATS:
        raise WorkspaceError("unsupported_file_type", f"Export formats: {', '.join(EXPORT_FORMATS)}")
    out = df.drop(ROW_ID)
    options = {"header": "true", "escape": '"'} if file_format == "csv" else {}
    out.write.mode("errorifexists").format(file_format).options(**options).save(path)
