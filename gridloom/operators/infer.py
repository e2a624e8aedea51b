"""Type inference over whole columns, typed projection, schema edit.

Inference never samples: one aggregation evaluates, for every column, whether *all* its values
read as each type.  The aggregation may be grouped by file split, so that one scan of a file source
serves both inference and row numbering (see ``plans.imports``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, types as T
from pyspark.sql import functions as F

from ..errors import WorkspaceError
from ..functions import cells
from ..types import (
    BOOLEAN, DATE, DATETIME, DECIMAL, INTEGER, ROW_ID, TEXT, Field, annotate, column, reorder,
)

# Fixed value: the order in which types are tried; text takes whatever is left.
PRECEDENCE = (BOOLEAN, INTEGER, DECIMAL, DATE, DATETIME)

# A cell of a workbook is (kind, text): spreadsheets type their cells, text files do not.
CELL = T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType())])
NATIVE_BITS = {
    BOOLEAN: cells.BITS[BOOLEAN],
    INTEGER: cells.BITS[INTEGER] | cells.BITS[DECIMAL],
    DECIMAL: cells.BITS[DECIMAL],
    DATE: cells.BITS[DATE],
    DATETIME: cells.BITS[DATETIME],
}


def _value(df: DataFrame, name: str) -> tuple[Column, Column | None]:
    """The stripped text of a column, and its cell kind where it has one."""
    if isinstance(df.schema[name].dataType, T.StructType):
        cell = column(name)
        return cells.normalize_cell(cell["text"]), cell["kind"]
    if not isinstance(df.schema[name].dataType, T.StringType):
        raise WorkspaceError("invalid_dataset_fields", f"{name!r} is not a text column")
    return cells.normalize_cell(column(name)), None


def _mask(value: Column, kind: Column | None) -> Column:
    if kind is None:
        return cells.type_mask(value)
    native = F.when(kind == TEXT, cells.type_mask(value))
    for name, bits in NATIVE_BITS.items():
        native = native.when(kind == name, bits)
    return F.when(value.isNotNull(), native.otherwise(0))


def column_facts(df: DataFrame, names: Sequence[str], by: Sequence[str] = (), *more: Column) -> DataFrame:
    """Per column (``field``, by position): rows, values, broken texts and the types all values share.

    The table is turned into (field, cell) rows first, so one small expression serves every column and
    the generated code does not grow with the width of the table.  ``by`` groups the facts further.
    """
    kind = df.schema[names[0]].dataType
    nested = isinstance(kind, T.StructType)
    if any(df.schema[n].dataType != kind for n in names) or not (nested or isinstance(kind, T.StringType)):
        raise WorkspaceError("invalid_dataset_fields", "Inference reads columns of text")
    kept = [c for c in df.columns if c not in names]
    numbered = df.select(*[column(c) for c in kept], *[column(n).alias(str(i)) for i, n in enumerate(names)])
    long = numbered.unpivot([column(c) for c in kept], [str(i) for i in range(len(names))], "field", "cell")
    text = F.col("cell")["text"] if nested else F.col("cell")
    cell = long.withColumn("value", cells.normalize_cell(text))
    masked = cell.withColumn("types", _mask(F.col("value"), F.col("cell")["kind"] if nested else None))
    return masked.groupBy(*by, "field").agg(
        F.count(F.lit(1)).alias("rows"),
        # the mask is used twice, so Spark computes it below the aggregation, once per cell
        F.count("types").alias("values"),
        F.bit_and("types").alias("types"),
        F.count_if(F.contains(F.col("value"), F.lit("\ufffd"))).alias("broken"),
        *more,
    )


def merge_facts(facts: DataFrame) -> DataFrame:
    """Combine the facts of several groups into one row per column."""
    return facts.groupBy("field").agg(
        F.sum("rows").alias("rows"), F.sum("values").alias("values"),
        F.bit_and("types").alias("types"), F.sum("broken").alias("broken"),
    )


def decide_fields(names: Sequence[str], facts: DataFrame) -> list[Field]:
    """Read the facts (one row per column) and decide on the fields."""
    found = {int(row["field"]): row for row in facts.collect()}
    fields = []
    for i, name in enumerate(names):
        row = found.get(i)
        if row is None:  # a table without rows
            fields.append(Field(name, TEXT, False, i))
            continue
        if row["broken"]:
            raise WorkspaceError("file_parse_failed", f"{name!r} holds bytes that are not UTF-8")
        types = row["types"] or 0
        kind = next((t for t in PRECEDENCE if types & cells.BITS[t]), TEXT)
        fields.append(Field(name, kind, row["values"] < row["rows"], i))
    return fields


def infer_fields(df: DataFrame) -> list[Field]:
    """Infer type and nullability of every (text or workbook cell) column in one job."""
    names = [c for c in df.columns if c != ROW_ID]
    return decide_fields(names, column_facts(df.select(*map(column, names)), names))


def inferred_table(df: DataFrame) -> DataFrame:
    """The same inference as a lazy DataFrame: (order, name, inferred_type, nullable)."""
    names = [c for c in df.columns if c != ROW_ID]
    kind = F.lit(TEXT)
    for target in reversed(PRECEDENCE):
        fits = F.col("types").bitwiseAND(F.lit(cells.BITS[target])) != 0
        kind = F.when(fits, target).otherwise(kind)
    order = F.col("field").cast("int")
    facts = column_facts(df.select(*map(column, names)), names)
    return facts.select(
        order.alias("order"),
        F.get(F.array(*map(F.lit, names)), order).alias("name"),
        kind.alias("inferred_type"),
        (F.col("values") < F.col("rows")).alias("nullable"),
    )


def coerce(col: Column, field_type: str, source: T.DataType = T.StringType()) -> Column:
    return cells.coerce(col, source, field_type)


def typed(df: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """Cast text (or cell) columns to the given fields, row identity kept."""
    keep = [column(ROW_ID)] if ROW_ID in df.columns else []
    pairs = [_value(df, f.name) for f in fields]
    # stripped first, in a projection of its own: the casts read each cell several times
    stripped = df.select(
        *keep,
        *[value.alias(f"v{i}") for i, (value, _) in enumerate(pairs)],
        *[kind.alias(f"k{i}") for i, (_, kind) in enumerate(pairs) if kind is not None],
    )
    projected = []
    for i, (f, (_, kind)) in enumerate(zip(fields, pairs)):
        value = F.col(f"v{i}")
        cast = cells.cast_text(value, f.type)
        if kind is not None and f.type == BOOLEAN:
            cast = F.when(F.col(f"k{i}") == BOOLEAN, value == "true").otherwise(cast)
        projected.append(cast.alias(f.name, metadata=f.metadata))
    return stripped.select(*keep, *projected)


def _sources(source_fields: Sequence[Field], target_fields: Sequence[Field], code: str) -> list[tuple[Field, Field]]:
    by_order = {f.order: f for f in source_fields}
    for f in target_fields:
        if f.order not in by_order:
            raise WorkspaceError(code, f"No source field has order {f.order}")
    return [(by_order[f.order], f) for f in target_fields]


def count_bad(
    df: DataFrame, source_fields: Sequence[Field], target_fields: Sequence[Field]
) -> dict[str, int]:
    """How many values do not fit their target field, per target field; one job."""
    pairs = _sources(source_fields, target_fields, "invalid_dataset_field_order")
    checks = []
    for i, (source, target) in enumerate(pairs):
        c = column(source.name)
        cast = cells.coerce(c, df.schema[source.name].dataType, target.type)
        checks.append(F.count_if(c.isNotNull() & cast.isNull()).alias(f"b{i}"))
    row = df.agg(*checks).first()
    return {target.name: row[i] for i, (_, target) in enumerate(pairs)}


def remap(
    df: DataFrame,
    source_fields: Sequence[Field],
    target_fields: Sequence[Field],
    *,
    code: str = "invalid_dataset_field_order",
) -> DataFrame:
    """Schema edit: pick source columns by order, rename and recast them, drop the rest.

    A value that does not fit makes the query fail, as the whole import fails in the workspace;
    ``count_bad`` tells beforehand how many there are.
    """
    keep = [column(ROW_ID)] if ROW_ID in df.columns else []
    projected = []
    for order, (source, target) in enumerate(_sources(source_fields, target_fields, code)):
        c = column(source.name)
        data_type = df.schema[source.name].dataType
        cast = cells.coerce(c, data_type, target.type)
        if field_can_fail(data_type, target.type):
            message = F.concat(F.lit(f"invalid_field_value: {target.name}: "), cells.to_text(c, data_type))
            cast = F.when(c.isNotNull() & cast.isNull(), F.raise_error(message)).otherwise(cast)
        metadata = Field(target.name, target.type, target.nullable, order).metadata
        projected.append(cast.alias(target.name, metadata=metadata))
    return df.select(*keep, *projected)


def field_can_fail(data_type: T.DataType, kind: str) -> bool:
    """Can a non-null value of this Spark type fail to fit the field type?"""
    if kind in (TEXT, BOOLEAN):
        return False
    if kind == DECIMAL:
        return not isinstance(data_type, (T.NumericType, T.BooleanType))
    if kind == INTEGER:
        return not isinstance(
            data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)
        )
    return not isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType))


def drop_row_id(df: DataFrame) -> DataFrame:
    return df.drop(ROW_ID)


__all__ = [
    "CELL", "annotate", "coerce", "column_facts", "count_bad", "decide_fields", "drop_row_id",
    "infer_fields", "inferred_table", "merge_facts", "remap", "reorder", "typed",
]
