"""External tables over JDBC: table and query reads, schema discovery, value normalization."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, types as T
from pyspark.sql import functions as F

from ..errors import WorkspaceError
from ..functions import cells
from ..operators import guard, infer
from ..types import SPARK_TYPES, Field, column, field_type

# Hidden system schemas, timeout of connecting, reading and writing.
SYSTEM_SCHEMAS = ("information_schema", "pg_catalog")
CONNECT_SECONDS = 5
FETCH_ROWS = "10000"

# Database type names per field type; any other name is text.
TYPE_NAMES = {
    "boolean": ("boolean", "bool", "bit"),
    "integer": ("smallint", "integer", "int", "bigint", "tinyint", "mediumint", "serial", "bigserial"),
    "decimal": ("numeric", "decimal", "real", "float", "double", "double precision", "money"),
    "datetime": ("timestamp", "timestamp without time zone", "timestamp with time zone", "datetime"),
    "date": ("date",),
}


@dataclass(frozen=True)
class Partitioning:
    """How to read a table in parallel: a number or date column and its range."""

    column: str
    lower: object
    upper: object
    count: int


def dialect(options: Mapping[str, str]) -> str:
    """``postgresql``, ``mysql`` or whatever else the URL names."""
    parts = str(options.get("url", "")).split(":")
    if len(parts) < 3 or parts[0] != "jdbc":
        raise WorkspaceError("invalid_connection", "options need a jdbc url")
    return parts[1]


def quote_name(name: str, kind: str) -> str:
    mark = "`" if kind == "mysql" else '"'
    return mark + name.replace(mark, mark * 2) + mark


def capped(query: str, limit: int | None, kind: str) -> str:
    """A remote query with its row cap inside: Spark does not push a later ``limit`` to the server."""
    if limit is None:
        return query
    tail = f"LIMIT {int(limit)}" if kind in ("postgresql", "mysql") else f"FETCH FIRST {int(limit)} ROWS ONLY"
    return f"SELECT * FROM ({query}) q {tail}"


def table_options(schema: str | None, table: str, kind: str, limit: int | None, partition: Partitioning | None) -> dict[str, str]:
    """The reader options that name what to read."""
    name = ".".join(quote_name(p, kind) for p in (schema, table) if p)
    if limit is not None and partition:
        raise WorkspaceError("invalid_connection", "A row limit is one query; give a limit or a partitioning")
    if limit is not None:
        return {"query": capped(f"SELECT * FROM {name}", limit, kind)}
    options = {"dbtable": name}
    if partition:
        options |= {
            "partitionColumn": partition.column,
            "lowerBound": str(partition.lower),
            "upperBound": str(partition.upper),
            "numPartitions": str(partition.count),
        }
    return options


def connect_options(options: Mapping[str, str]) -> dict[str, str]:
    """The caller's options over the defaults."""
    kind = dialect(options)
    timeouts = {
        "postgresql": {"connectTimeout": str(CONNECT_SECONDS)},
        "mysql": {"connectTimeout": str(CONNECT_SECONDS * 1000), "socketTimeout": str(CONNECT_SECONDS * 1000)},
    }
    return {"fetchsize": FETCH_ROWS, **timeouts.get(kind, {}), **options}


def _load(spark: SparkSession, options: Mapping[str, str], extra: Mapping[str, str]) -> DataFrame:
    return spark.read.format("jdbc").options(**connect_options(options), **extra).load()


def read_table(
    spark: SparkSession, options: Mapping[str, str], schema: str | None, table: str,
    limit: int | None = None, partition: Partitioning | None = None,
) -> DataFrame:
    """A table of an external database in workspace types; filters and columns are pushed down.

    Without ``partition`` the read is one task, so give one for any large table.
    """
    wanted = table_options(schema, table, dialect(options), limit, partition)
    return normalize(_load(spark, options, wanted))


def read_sql(spark: SparkSession, options: Mapping[str, str], sql: str, limit: int | None = None) -> DataFrame:
    """The result of a read-only query run by the external database."""
    query = capped(guard.validate(sql), limit, dialect(options))
    return normalize(_load(spark, options, {"query": query}))


def normalize_value(c: Column, data_type: T.DataType) -> Column:
    """Any external value as one of the six types."""
    kind = field_type(data_type)
    if kind != "text":
        return c.cast(SPARK_TYPES[kind])
    if isinstance(data_type, (T.BinaryType, T.StringType)):
        return cells.to_text(c, data_type)
    if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")


def normalize(df: DataFrame) -> DataFrame:
    """Map every column to a workspace type, order and nullability noted."""
    projected = []
    for order, f in enumerate(df.schema.fields):
        metadata = Field(f.name, field_type(f.dataType), f.nullable, order).metadata
        projected.append(normalize_value(column(f.name), f.dataType).alias(f.name, metadata=metadata))
    return df.select(*projected)


def import_fields(df: DataFrame, source: Sequence[Field], target: Sequence[Field]) -> DataFrame:
    """Edited fields over an external result, matched by order."""
    return infer.remap(df, source, target, code="invalid_external_import_field_order")


def map_type_name(name: Column) -> Column:
    """A database type name as a workspace type."""
    plain = F.btrim(F.regexp_replace(F.lower(name), r"\(.*\)|unsigned", ""))
    mapped = F.lit("text")
    for kind, words in reversed(TYPE_NAMES.items()):
        mapped = F.when(plain.isin(*words), kind).otherwise(mapped)
    return mapped


def describe_columns(catalog: DataFrame) -> DataFrame:
    """Catalog rows (table_schema, table_name, column_name, data_type, is_nullable, ordinal_position)
    as one row per table with its ordered columns.
    """
    entry = F.struct(
        (F.col("ordinal_position").cast("int") - 1).alias("order"),
        F.col("column_name").alias("name"),
        F.col("data_type"),
        (F.upper("is_nullable") == "YES").alias("nullable"),
        map_type_name(F.col("data_type")).alias("inferred_type"),
    )
    visible = catalog.filter(~F.lower("table_schema").isin(*SYSTEM_SCHEMAS))
    return visible.groupBy(F.col("table_schema").alias("schema_name"), "table_name").agg(
        F.sort_array(F.collect_list(entry)).alias("columns")
    )


def catalog_query(kind: str) -> str:
    """Base tables and their columns; MySQL lists the current database only."""
    base = (
        "SELECT c.table_schema, c.table_name, c.column_name, c.data_type, c.is_nullable, c.ordinal_position "
        "FROM information_schema.columns c JOIN information_schema.tables t "
        "ON t.table_schema = c.table_schema AND t.table_name = c.table_name "
        "WHERE t.table_type = 'BASE TABLE'"
    )
    return base + (" AND c.table_schema = DATABASE()" if kind == "mysql" else "")


def inspect(spark: SparkSession, options: Mapping[str, str]) -> DataFrame:
    """Schemas, tables and columns of an external database."""
    found = _load(spark, options, {"query": catalog_query(dialect(options))})
    lower = found.toDF(*[c.lower() for c in found.columns])
    return describe_columns(lower)
