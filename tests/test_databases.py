"""The parts of external reads that need no database: remote text, options, types, values."""

import datetime as dt
import decimal

from conftest import code_of
from pyspark.sql import types as T

from gridloom import Field, databases
from gridloom.types import field_type, fields_of

PG = {"url": "jdbc:postgresql://db/shop", "user": "u"}


def test_dialects_and_options():
    assert databases.dialect(PG) == "postgresql" and databases.dialect({"url": "jdbc:mysql://db/x"}) == "mysql"
    assert code_of(databases.dialect, {"url": "db/shop"}) == "invalid_connection"
    assert databases.connect_options(PG)["connectTimeout"] == "5"
    assert databases.connect_options({**PG, "connectTimeout": "9"})["connectTimeout"] == "9"


def test_remote_text_carries_the_cap():
    assert databases.capped("SELECT 1", None, "mysql") == "SELECT 1"
    assert databases.capped("SELECT 1", 5, "postgresql") == "SELECT * FROM (SELECT 1) q LIMIT 5"
    assert databases.capped("SELECT 1", 5, "derby") == "SELECT * FROM (SELECT 1) q FETCH FIRST 5 ROWS ONLY"
    assert databases.table_options("s", 'o"d', "postgresql", 7, None) == {"query": 'SELECT * FROM (SELECT * FROM "s"."o""d") q LIMIT 7'}
    assert databases.table_options(None, "t", "mysql", None, None) == {"dbtable": "`t`"}


def test_partitioned_reads():
    options = databases.table_options("s", "t", "postgresql", None, databases.Partitioning("id", 1, 1000, 8))
    assert options == {"dbtable": '"s"."t"', "partitionColumn": "id", "lowerBound": "1", "upperBound": "1000", "numPartitions": "8"}


def test_remote_sql_is_guarded(spark):
    assert code_of(databases.read_sql, spark, PG, "DROP TABLE t") == "sql_not_read_only"


def test_values_and_types(spark):
    schema = T.StructType([
        T.StructField("n", T.DecimalType(10, 2)), T.StructField("raw", T.BinaryType()), T.StructField("i", T.ShortType(), False),
        T.StructField("at", T.TimestampNTZType()), T.StructField("list", T.ArrayType(T.IntegerType())), T.StructField("f", T.FloatType()),
    ])
    row = (decimal.Decimal("1.50"), b"caf\xc3\xa9 \xff", 3, dt.datetime(2026, 1, 5), [1, 2], 0.5)
    out = databases.normalize(spark.createDataFrame([row], schema))
    assert tuple(out.first()) == (1.5, "café �", 3, dt.datetime(2026, 1, 5), "[1,2]", 0.5)
    assert [(f.type, f.nullable) for f in fields_of(out)] == [
        ("decimal", True), ("text", True), ("integer", False), ("datetime", True), ("text", True), ("decimal", True),
    ]


def test_type_map():
    kinds = {T.BooleanType(): "boolean", T.ByteType(): "integer", T.FloatType(): "decimal", T.DecimalType(5): "decimal", T.DateType(): "date", T.TimestampType(): "datetime", T.BinaryType(): "text"}
    assert {k: field_type(k) for k in kinds} == kinds


def test_schema_discovery_from_catalog_rows(spark):
    rows = [
        ("shop", "orders", "amount", "numeric(10,2)", "YES", 2), ("shop", "orders", "id", "bigint", "NO", 1),
        ("pg_catalog", "x", "y", "text", "NO", 1), ("shop", "orders", "at", "timestamp without time zone", "YES", 3),
    ]
    names = "table_schema string, table_name string, column_name string, data_type string, is_nullable string, ordinal_position int"
    found = databases.describe_columns(spark.createDataFrame(rows, names)).collect()
    assert [(r.schema_name, r.table_name) for r in found] == [("shop", "orders")]
    assert [(c["order"], c.name, c.nullable, c.inferred_type) for c in found[0].columns] == [
        (0, "id", False, "integer"), (1, "amount", True, "decimal"), (2, "at", True, "datetime"),
    ]
    assert "DATABASE()" in databases.catalog_query("mysql") and "DATABASE()" not in databases.catalog_query("postgresql")


def test_edited_external_fields(spark):
    df = spark.createDataFrame([("Ann", 10.0)], "customer string, amount double")
    source = fields_of(df)
    out = databases.import_fields(df, source, [Field("buyer_name", "text", True, 0), Field("order_amount", "integer", True, 1)])
    assert [tuple(r) for r in out.collect()] == [("Ann", 10)] and out.columns == ["buyer_name", "order_amount"]
    bad = [Field("x", "text", True, 9)]
    assert code_of(databases.import_fields, df, source, bad) == "invalid_external_import_field_order"
