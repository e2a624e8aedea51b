"""CSV scan: every column as text, names cleaned, files split freely."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, DataFrameReader, SparkSession, types as T
from pyspark.sql import functions as F

from ..errors import WorkspaceError
from ..functions.names import normalize_headers
from ..types import Field, validate_fields

# The file types an import takes.
CSV_SUFFIXES, WORKBOOK_SUFFIXES = (".csv",), (".xlsx", ".xlsm")
OPTIONS = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "encoding": "UTF-8"}


def suffix_of(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""


def check_file_type(path: str) -> str:
    """``csv``, ``xlsx`` or ``xlsm``; any other suffix is refused."""
    suffix = suffix_of(path)
    if suffix not in CSV_SUFFIXES + WORKBOOK_SUFFIXES:
        raise WorkspaceError("unsupported_file_type", "Only CSV and Excel files are supported")
    return suffix[1:]


def read_header(spark: SparkSession, path: str, multi_line: bool = False) -> list[str | None]:
    """The first row of one file, as it stands there."""
    first = spark.read.options(**OPTIONS).option("multiLine", multi_line).csv(path, header=False).first()
    if first is None:
        raise WorkspaceError("empty_file", "The file has no rows")
    return list(first)


def text_schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def has_torn_line(spark: SparkSession, paths: str | Sequence[str]) -> bool:
    """Whether any line has an odd number of quotes: a line break inside quotes cut it off.

    Looks at the raw lines, whatever cells they fall into; one scan without parsing.
    """
    lines = spark.read.text([paths] if isinstance(paths, str) else list(paths))
    odd = F.length(F.regexp_replace("value", '[^"]', "")) % 2 == 1
    return bool(lines.agg(F.max(odd)).first()[0])


def read_csv(spark: SparkSession, paths: str | Sequence[str], multi_line: bool = False) -> DataFrame:
    """Read CSV files that share one header, all cells as text.

    Short rows are padded with null, extra cells dropped, empty lines skipped.  ``multi_line`` allows
    line breaks inside quotes at the price of one task per file; without it files are split.
    ``records.read_records`` allows both.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    for path in paths:
        if suffix_of(path) and not path.endswith("/"):
            check_file_type(path)
    located = spark.read.options(**OPTIONS).csv(paths, header=False, schema="c string")
    files = located.inputFiles()
    if not files:
        raise WorkspaceError("empty_file", "No files to read")
    raw = read_header(spark, min(files), multi_line)
    names = normalize_headers(raw)
    validate_fields([Field(n, "text") for n in names])
    reader = spark.read.options(**OPTIONS).option("multiLine", multi_line)
    if len(files) > 1 and names != raw:
        _check_headers(reader, paths, raw)
    # unchanged names can be checked by Spark, file by file, as it reads
    return reader.schema(text_schema(names)).csv(paths, header=True, enforceSchema=names != raw)


def _check_headers(reader: DataFrameReader, paths: list[str], raw: Sequence[str | None]) -> None:
    """Cleaned names are not those in the files, so the files' first rows are compared here."""
    cells = [f"c{i}" for i in range(len(raw))]
    rows = reader.schema(text_schema(cells)).csv(paths, header=False)
    starts = rows.select(
        F.struct(*cells).alias("header"), F.col("_metadata.file_path").alias("path"),
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("place"),
    )
    headers = starts.groupBy("path").agg(F.min_by("header", "place").alias("header"))
    first = F.struct(*[F.lit(v).cast("string").alias(c) for c, v in zip(cells, raw)])
    if not headers.filter(~F.col("header").eqNullSafe(first)).isEmpty():
        raise WorkspaceError("file_header_mismatch", "The files do not share one header")
