"""The six field types, field lists and the schema rules.

A field list travels with its DataFrame as ``StructField.metadata``, which Parquet keeps, so a
table written by the workspace still knows its declared types and nullability when it is read
back (Parquet itself reads every column as nullable).
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, types as T
from pyspark.sql import functions as F

from .errors import WorkspaceError

# The reserved row-identity column, the name length limit, the type names.
ROW_ID = "_das_row_id"
MAX_NAME_BYTES = 63
INTEGER, DECIMAL, BOOLEAN = "integer", "decimal", "boolean"
DATE, DATETIME, TEXT = "date", "datetime", "text"

SPARK_TYPES: dict[str, T.DataType] = {
    INTEGER: T.LongType(),
    DECIMAL: T.DoubleType(),
    BOOLEAN: T.BooleanType(),
    DATE: T.DateType(),
    DATETIME: T.TimestampNTZType(),
    TEXT: T.StringType(),
}

NULLABLE_KEY, ORDER_KEY = "nullable", "order"


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    nullable: bool = True
    order: int = 0

    @property
    def spark_type(self) -> T.DataType:
        return SPARK_TYPES[self.type]

    @property
    def metadata(self) -> dict:
        return {ORDER_KEY: self.order, NULLABLE_KEY: self.nullable}


def field_type(data_type: T.DataType) -> str:
    """Map any Spark type to one of the six; whatever has no counterpart is text."""
    if isinstance(data_type, T.BooleanType):
        return BOOLEAN
    if isinstance(data_type, T.IntegralType):
        return INTEGER
    if isinstance(data_type, (T.FractionalType, T.DecimalType)):
        return DECIMAL
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return DATETIME
    if isinstance(data_type, T.DateType):
        return DATE
    return TEXT


def fields_of(schema: T.StructType | DataFrame) -> list[Field]:
    """The declared fields of a table, row identity left out."""
    if isinstance(schema, DataFrame):
        schema = schema.schema
    columns = [f for f in schema.fields if f.name != ROW_ID]
    return [
        Field(f.name, field_type(f.dataType), f.metadata.get(NULLABLE_KEY, f.nullable), i)
        for i, f in enumerate(columns)
    ]


def annotate(df: DataFrame, fields: Iterable[Field]) -> DataFrame:
    """Attach the declared order and nullability to the columns of ``df``."""
    by_name = {f.name: f for f in fields}
    return df.select(
        *[
            F.col(quoted(c)).alias(c, metadata=by_name[c].metadata) if c in by_name else F.col(quoted(c))
            for c in df.columns
        ]
    )


def reorder(fields: Iterable[Field]) -> list[Field]:
    return [replace(f, order=i) for i, f in enumerate(fields)]


def quoted(name: str) -> str:
    """Back-quote a column name so that dots and quotes in it stay part of the name."""
    return "`" + name.replace("`", "``") + "`"


def column(name: str):
    return F.col(quoted(name))


def validate_fields(fields: Iterable[Field | T.StructField], kind: str = "dataset") -> None:
    """Schema rules; ``kind`` (``dataset`` or ``data_view``) only picks the error code."""
    names = [f.name for f in fields]
    for name in names:
        if not name.strip():
            raise WorkspaceError(f"invalid_{kind}_fields", "A field name is blank")
        if name == ROW_ID:
            raise WorkspaceError(f"reserved_{kind}_field_name", f"{ROW_ID} is a reserved name")
        if len(name.encode("utf-8")) > MAX_NAME_BYTES:
            raise WorkspaceError(
                f"{kind}_field_name_too_long", f"{name!r} is longer than {MAX_NAME_BYTES} bytes"
            )
    if len(set(names)) < len(names):
        raise WorkspaceError(f"duplicate_{kind}_fields", "Two fields share one name")
    # Spark resolves names without case, so names that differ in case alone cannot be told apart.
    if len({n.lower() for n in names}) < len(names):
        raise WorkspaceError(f"duplicate_{kind}_fields", "Field names differ only in case")
