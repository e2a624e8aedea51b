"""File import: scan, infer, cast, number, write, in two passes over the files.

Pass 1 is one aggregation per file split that yields the inference facts and the split's row count
together.  Pass 2 casts, numbers and writes.  No row is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import WorkspaceError
from ..operators import infer, row_id
from ..session import stage
from ..sources import delimited, records, tables
from ..types import ROW_ID, Field, validate_fields

PREVIEW_ROWS = 20  # fixed value
HEADER_ERRORS = ("CSV header does not conform to the schema", "Number of column in CSV header is not equal")


@dataclass(frozen=True)
class Scan:
    """A text scan with what pass 1 learned about it."""

    data: DataFrame
    fields: list[Field]
    row_count: int
    splits: DataFrame

    def numbered(self) -> DataFrame:
        """The typed rows with their row ids, lazily."""
        return infer.typed(row_id.number_splits(_marked(self.data), self.splits), self.fields)


def _marked(df: DataFrame) -> DataFrame:
    """With split marks; a scan of records has its own."""
    return df if row_id.MARK in df.columns else row_id.with_split_marks(df)


def scan(df: DataFrame) -> Scan:
    """Pass 1 over a plain file scan of text (or workbook cell) columns."""
    keys = [row_id.PATH, row_id.BLOCK]
    names = [c for c in df.columns if c not in (*keys, row_id.MARK)]
    facts = infer.column_facts(_marked(df), names, keys, F.min(row_id.MARK).alias("first_mark"))
    facts = stage(facts, "splits")  # one small row per split and column
    splits = facts.filter("field = '0'").select(*keys, "rows", "first_mark")
    total = splits.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    return Scan(df, infer.decide_fields(names, infer.merge_facts(facts)), total, splits)


def scan_csv(spark: SparkSession, paths: str | Sequence[str], multi_line: bool | str = False) -> Scan:
    """Pass 1 over CSV files; files with different headers are refused.

    ``multi_line`` allows line breaks inside quotes: True reads each file in one task, "split" keeps files split and joins
    the lines of a record by the parity of quotes. Without it such a line break ends the import.
    """
    if multi_line == "split":
        return scan(records.read_records(spark, paths))
    try:
        data = delimited.read_csv(spark, paths, bool(multi_line))
        if not multi_line and delimited.has_torn_line(spark, paths):
            raise WorkspaceError("file_parse_failed", 'A line break inside quotes; read the files with multi_line="split"')
        return scan(data)
    except WorkspaceError:
        raise
    except Exception as error:  # Spark's reader names the file that differs
        if any(text in str(error) for text in HEADER_ERRORS):
            raise WorkspaceError("file_header_mismatch", "The files do not share one header") from error
        raise


def preview(spark: SparkSession, paths: str | Sequence[str], multi_line: bool | str = False) -> tuple[list[Field], int, DataFrame]:
    """Import preview: inferred fields, row count, first rows."""
    found = scan_csv(spark, paths, multi_line)
    head = found.numbered().filter(F.col(ROW_ID) <= PREVIEW_ROWS).orderBy(ROW_ID).drop(ROW_ID)
    return found.fields, found.row_count, head


def import_csv(
    spark: SparkSession,
    paths: str | Sequence[str],
    target: str,
    *,
    fields: Sequence[Field] | None = None,
    multi_line: bool | str = False,
) -> tuple[DataFrame, int]:
    """CSV files to a table; ``fields`` is the edited schema, matched to the inferred one by order."""
    found = scan_csv(spark, paths, multi_line)
    data = found.numbered()
    if fields is not None:
        validate_fields(fields)
        data = infer.remap(data, found.fields, fields)
    try:
        return tables.write(data, target)
    except Exception as error:
        if "invalid_field_value" in str(error):
            raise WorkspaceError("invalid_field_value", "A value does not fit its field type") from error
        raise


__all__ = ["Scan", "import_csv", "preview", "scan"]
