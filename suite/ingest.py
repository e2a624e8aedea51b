"""Files to tables and back: CSV and workbook scans, inference, typing, row ids, paging, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom import ROW_ID, Catalog, Field, databases, delimited, imports, infer, row_id, tables, workbooks
from gridloom.plans.catalog import newest_first
from gridloom.session import fresh_path, stored_bytes

from .registry import dataset, register, table
from .workbook_bytes import group_workbook


#: One more CSV file for so many bytes of the table's own files.
FILE_BYTES = 32 << 20


def drop_csv(df, order: str, files: int = 6, header: bool = True) -> str:
    """Write a table as several CSV files in key order, more of them as it grows: a task writes each."""
    path = fresh_path(df.sparkSession, "csv")
    files = max(files, stored_bytes(df) // FILE_BYTES)
    sorted_df = df.repartitionByRange(files, order).sortWithinPartitions(order)
    sorted_df.write.option("header", header).option("escape", '"').csv(path)
    return path


CUSTOMER_SQL = "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer"


@register("a1_csv_scan", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment FROM customer")
def a1(spark, sf):
    df = table(spark, sf, "customer").drop("c_acctbal")
    return delimited.read_csv(spark, drop_csv(df, "c_custkey"))


@register(
    "a1_csv_multi_line",
    "SELECT CAST(doc_id AS VARCHAR) AS doc_id, sha256(text) AS digest FROM documents",
)
def a1_multi_line(spark, sf):
    """Whole texts with line breaks and quotes survive the round trip."""
    path = drop_csv(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    df = delimited.read_csv(spark, path, multi_line=True)
    return df.select("doc_id", F.sha2("text", 256).alias("digest"))


@register(
    "a1_csv_multi_line_split",
    """SELECT row_number() OVER (ORDER BY doc_id) AS _das_row_id, doc_id, sha256(nullif(trim(text, chr(32) || chr(9) || chr(10) || chr(13)), '')) AS digest,
    lang, source, n_chars FROM documents""",
)
def a1_multi_line_split(spark, sf):
    """All documents from two large files (more where they grow), cut into many tasks inside their quoted texts, typed and numbered in file order."""
    path = drop_csv(table(spark, sf, "documents"), "doc_id", files=2)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
        out, _ = imports.import_csv(spark, path, fresh_path(spark, "table"), multi_line="split")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    return out.withColumn("digest", F.sha2("text", 256)).drop("text")


@register("a2_header_names", "SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS name, c_mktsegment AS name_2, CAST(c_nationkey AS VARCHAR) AS column_4 FROM customer")
def a2(spark, sf):
    df = table(spark, sf, "customer")
    odd = df.select(F.col("c_custkey").alias(" key "), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("name "), F.col("c_nationkey").alias("  "))
    return delimited.read_csv(spark, drop_csv(odd, " key "))


@register("a3_workbook_scan", "SELECT row_number() OVER (ORDER BY o_orderkey) AS _das_row_id, * FROM orders")
def a3(spark, sf):
    """Workbooks of bounded size made from the orders, read back with inferred types."""
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("content", T.BinaryType())])
    df = table(spark, sf, "orders").withColumn("book", F.floor(F.col("o_orderkey") / 4000))
    files = df.select("book", *[c for c in df.columns if c != "book"]).groupBy("book").applyInPandas(group_workbook, schema)
    return imports.scan(workbooks.parse_workbooks(files)).numbered()


@register(
    "a7_external_values",
    """SELECT c_custkey, c_name, CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS DOUBLE) AS balance,
    CAST(c_nationkey AS BIGINT) AS c_nationkey, '{"segment":"' || c_mktsegment || '"}' AS details FROM customer""",
)
def a7(spark, sf):
    df = table(spark, sf, "customer").select(
        "c_custkey", F.col("c_name").cast("binary").alias("c_name"),
        F.col("c_acctbal").cast("decimal(12,2)").alias("balance"), "c_nationkey",
        F.struct(F.col("c_mktsegment").alias("segment")).alias("details"),
    )
    return databases.normalize(df)


@register("a7_external_arrays", "SELECT vec_id, len(embedding) AS n, CAST(label AS BIGINT) AS label FROM embeddings")
def a7_arrays(spark, sf):
    """Array columns become text and keep all their elements."""
    df = databases.normalize(table(spark, sf, "embeddings"))
    size = F.size(F.from_json("embedding", "array<double>")).cast("long")
    return df.select("vec_id", size.alias("n"), "label")


@register("a10_table_sink", "SELECT row_number() OVER (ORDER BY o_orderkey) AS _das_row_id, * FROM orders")
def a10(spark, sf):
    out, count = tables.write(table(spark, sf, "orders"), fresh_path(spark, "table"), order_by=["o_orderkey"])
    return out.filter(F.lit(count) > 0)


@register("a10_row_count", "SELECT 'lineitem' AS name, count(*) AS row_count FROM lineitem")
def a10_count(spark, sf):
    """The count the write itself observed."""
    _, count = tables.write(table(spark, sf, "lineitem"), fresh_path(spark, "table"))
    return spark.createDataFrame([("lineitem", count)], "name string, row_count long")


def _export(spark, sf, kind: str):
    path = fresh_path(spark, "export")
    tables.export(dataset(spark, sf, "part").select(ROW_ID, "p_partkey", "p_name", "p_retailprice"), path, kind)
    reader = spark.read.option("header", "true") if kind == "csv" else spark.read
    return reader.format(kind).schema("p_partkey long, p_name string, p_retailprice double").load(path)


for _kind in tables.EXPORT_FORMATS:
    register(f"a12_export_{_kind}", "SELECT p_partkey, p_name, p_retailprice FROM part")(
        lambda spark, sf, kind=_kind: _export(spark, sf, kind)
    )


@register(
    "b1_cell_normalization",
    r"""SELECT doc_id, sha256(trim(text, E' \t\n\r\x0B\f')) AS digest, CASE WHEN lang = 'fr' THEN NULL ELSE lang END AS lang FROM documents""",
)
def b1(spark, sf):
    """Whole texts with padding put around them; blank cells become null."""
    from gridloom.functions.cells import normalize_cell

    padded = F.concat(F.lit(" \t "), F.col("text"), F.lit(" 　\n"))
    lang = F.when(F.col("lang") == "fr", " \t").otherwise(F.concat(F.lit("  "), F.col("lang")))
    df = table(spark, sf, "documents")
    return df.select("doc_id", F.sha2(normalize_cell(padded), 256).alias("digest"), normalize_cell(lang).alias("lang"))


# Orders as text, with one column per kind of inference case.
TEXT_COLUMNS = {
    "order_key": "CAST(o_orderkey AS VARCHAR)",
    "padded_key": "'0' || CAST(o_orderkey AS VARCHAR)",
    "signed_key": "'-' || CAST(o_orderkey AS VARCHAR)",
    "some_keys": "CASE WHEN o_orderstatus = 'P' THEN '' ELSE CAST(o_custkey AS VARCHAR) END",
    "price": "CAST(o_totalprice AS VARCHAR)",
    "exponent": "CAST(o_custkey AS VARCHAR) || 'e2'",
    "flag": "CASE WHEN o_orderstatus = 'F' THEN 'Yes' WHEN o_orderstatus = 'P' THEN '0' ELSE 'false' END",
    "day": "substring(CAST(o_orderdate AS VARCHAR), 1, 10)",
    "moment": "substring(CAST(o_orderdate AS VARCHAR), 1, 10) || 'T08:30:00'",
    "day_or_moment": "substring(CAST(o_orderdate AS VARCHAR), 1, 10) || CASE WHEN o_orderstatus = 'F' THEN ' 10:00:00' ELSE '' END",
    "priority": "o_orderpriority",
    "nothing": "''",
}
TEXT_ORDERS_SQL = "SELECT o_orderkey, " + ", ".join(f"{e} AS {n}" for n, e in TEXT_COLUMNS.items()) + " FROM orders"


def text_orders(spark, sf):
    df = table(spark, sf, "orders")
    return df.selectExpr(*[f"{e.replace('VARCHAR', 'STRING')} AS {n}" for n, e in TEXT_COLUMNS.items()])


INFER_SQL = f"""WITH t AS ({TEXT_ORDERS_SQL}), longs AS (
    {" UNION ALL ".join(f'SELECT {i} AS "order", {chr(39)}{n}{chr(39)} AS name, nullif(trim({n}), {chr(39)*2}) AS v FROM t' for i, n in enumerate(TEXT_COLUMNS))}
    ), facts AS (SELECT "order", name, count(v) < count(*) AS nullable,
    bool_and(lower(v) IN ('true', 'false', 'yes', 'no', '1', '0')) AS b, bool_and(regexp_full_match(v, '[0-9]+')) AS i,
    bool_and(regexp_full_match(lower(v), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)(e[+-]?[0-9]+)?')) AS d,
    bool_and(regexp_full_match(v, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}')) AS dt,
    bool_and(regexp_full_match(v, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([T ][0-9:]+)?')) AS ts FROM longs GROUP BY ALL)
    SELECT "order", name, CASE WHEN b THEN 'boolean' WHEN i THEN 'integer' WHEN d THEN 'decimal' WHEN dt THEN 'date'
    WHEN ts THEN 'datetime' ELSE 'text' END AS inferred_type, nullable FROM facts"""


@register("b2_b3_inference", INFER_SQL)
def b2(spark, sf):
    return infer.inferred_table(text_orders(spark, sf))


@register(
    "b4_typed_cast",
    f"""SELECT CAST(order_key AS BIGINT) AS order_key, CAST(padded_key AS BIGINT) AS padded_key, CAST(signed_key AS DOUBLE) AS signed_key,
    CAST(nullif(some_keys, '') AS BIGINT) AS some_keys, CAST(price AS DOUBLE) AS price, CAST(exponent AS DOUBLE) AS exponent,
    flag = 'Yes' AS flag, CAST(day AS DATE) AS day, CAST(moment AS TIMESTAMP) AS moment,
    CAST(day_or_moment AS TIMESTAMP) AS day_or_moment, priority, CAST(NULL AS VARCHAR) AS nothing FROM ({TEXT_ORDERS_SQL})""",
)
def b4(spark, sf):
    df = text_orders(spark, sf)
    return infer.typed(df, infer.infer_fields(df))


@register(
    "b5_schema_edit",
    """SELECT CAST(o_orderkey AS VARCHAR) AS label, CAST(trunc(o_totalprice) AS BIGINT) AS whole_price,
    CAST(o_orderdate AS DATE) AS ordered_on, o_custkey = 1 AS is_first FROM orders""",
)
def b5(spark, sf):
    df = table(spark, sf, "orders")
    target = [
        Field("label", "text", False, 0), Field("whole_price", "integer", True, 3),
        Field("ordered_on", "date", True, 4), Field("is_first", "boolean", True, 1),
    ]
    return infer.remap(df, [Field(f.name, "text", True, i) for i, f in enumerate(df.schema)], target)


@register(
    "b5_decimal_to_text",
    """SELECT l_orderkey, l_linenumber, (l_extendedprice * 1000)::VARCHAR AS large, (l_tax / 1000)::VARCHAR AS small FROM lineitem""",
)
def b5_decimals(spark, sf):
    """Decimals from ten million on and below a thousandth as text."""
    df = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_extendedprice") * 1000).alias("large"), (F.col("l_tax") / 1000).alias("small")
    )
    source = [Field(c, "integer" if i < 2 else "decimal", True, i) for i, c in enumerate(df.columns)]
    target = [Field(f.name, f.type if f.order < 2 else "text", True, f.order) for f in source]
    return infer.remap(df, source, target)


@register(
    "b4_datetime_offsets",
    """SELECT o_orderkey, date_trunc('second', o_orderdate) + INTERVAL 123456 MICROSECOND - INTERVAL 8 HOUR AS moment FROM orders""",
)
def b4_offsets(spark, sf):
    """A fraction of 70 digits before the offset."""
    text = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("." + "1234567890" * 7 + "+08:00"))
    df = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("o_orderkey"), text.alias("moment"))
    return infer.typed(df, [Field("o_orderkey", "integer", False, 0), Field("moment", "datetime", False, 1)])


@register(
    "b5_bad_values",
    """SELECT 'o_orderpriority' AS name, count(*) AS bad FROM orders UNION ALL SELECT 'o_custkey', 0 UNION ALL
    SELECT 'o_orderdate', 0""",
)
def b5_bad(spark, sf):
    df = table(spark, sf, "orders").select("o_orderpriority", "o_custkey", "o_orderdate")
    source = [Field(c, "text", True, i) for i, c in enumerate(df.columns)]
    target = [Field("o_orderpriority", "integer", True, 0), Field("o_custkey", "text", True, 1), Field("o_orderdate", "date", True, 2)]
    return spark.createDataFrame(list(infer.count_bad(df, source, target).items()), "name string, bad long")


@register("b7_drop_row_id", "SELECT * FROM nation")
def b7(spark, sf):
    return infer.drop_row_id(dataset(spark, sf, "nation"))


@register("f1_row_id_csv", "SELECT row_number() OVER (ORDER BY o_orderkey) AS _das_row_id, o_orderkey, o_orderpriority FROM orders")
def f1(spark, sf):
    """Row ids over several files and splits follow the source order."""
    path = drop_csv(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", 9)
    return imports.scan(delimited.read_csv(spark, path)).numbered()


@register("f1_row_id_files", "SELECT row_number() OVER (ORDER BY event_id) AS _das_row_id, event_id FROM events")
def f1_files(spark, sf):
    return dataset(spark, sf, "events").select(ROW_ID, "event_id")


LINE_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


@register("f1_row_id_by_keys", f"SELECT row_number() OVER (ORDER BY {LINE_ORDER}) AS _das_row_id, * FROM lineitem")
def f1_keys(spark, sf):
    """No key is unique here, so all columns order the rows."""
    return row_id.number(table(spark, sf, "lineitem"), LINE_ORDER.split(", "))


@register(
    "f1_renumber",
    "SELECT row_number() OVER (ORDER BY event_id) AS _das_row_id, event_id FROM events WHERE event_type <> 'view'",
)
def f1_renumber(spark, sf):
    kept = dataset(spark, sf, "events").filter("event_type <> 'view'").select(ROW_ID, "event_id")
    return row_id.renumber(kept)


@register("f2_page", "SELECT o_orderkey + 1 AS _das_row_id, * FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def f2(spark, sf):
    out, _ = tables.write(dataset(spark, sf, "orders"), fresh_path(spark, "table"))
    return tables.page(out, page=3, page_size=50)


@register("f3_full_read", "SELECT event_id + 1 AS _das_row_id, event_id, user_id FROM events")
def f3(spark, sf):
    return tables.rows(dataset(spark, sf, "events").select(ROW_ID, "event_id", "user_id"), ordered=True)


@register("f4_import_preview", f"SELECT *, (SELECT count(*) FROM customer) AS row_count FROM ({CUSTOMER_SQL}) ORDER BY c_custkey LIMIT 20")
def f4(spark, sf):
    _, count, head = imports.preview(spark, drop_csv(table(spark, sf, "customer"), "c_custkey"))
    return head.withColumn("row_count", F.lit(count).cast("long"))


@register("a1_b4_a10_import", f"SELECT row_number() OVER (ORDER BY c_custkey) AS _das_row_id, * FROM ({CUSTOMER_SQL})")
def full_import(spark, sf):
    """CSV files to a typed, numbered table."""
    path = drop_csv(table(spark, sf, "customer"), "c_custkey")
    return imports.import_csv(spark, path, fresh_path(spark, "table"))[0]


@register(
    "f5_view_from_rows",
    """SELECT row_number() OVER (ORDER BY c_nationkey) AS _das_row_id, c_nationkey AS nation, n AS customers FROM
    (SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, count(*) AS n FROM customer GROUP BY 1)""",
)
def f5(spark, sf):
    counts = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("customers"))
    fields = [Field("nation", "integer", False, 0), Field("customers", "integer", False, 1)]
    source = [Field("nation", "integer", True, 0), Field("customers", "integer", True, 1)]
    rows = infer.remap(counts, source, fields)
    return tables.write(rows, fresh_path(spark, "view"), fields=fields, order_by=["nation"], kind="data_view")[0]


@register(
    "f6_newest_first",
    """SELECT row_number() OVER (ORDER BY o_orderdate DESC, 'a' || o_orderkey DESC) AS position, 'a' || o_orderkey AS id
    FROM orders WHERE o_orderstatus = 'F'""",
)
def f6(spark, sf):
    entries = table(spark, sf, "orders").select(
        F.concat(F.lit("a"), F.col("o_orderkey")).alias("id"), F.col("o_orderstatus").alias("project_id"),
        F.col("o_orderdate").alias("created_at"),
    )
    listed = row_id.number(newest_first(entries, "F").select("id"))
    return listed.withColumnRenamed(ROW_ID, "position")


@register(
    "f6_catalog_listing",
    """SELECT 'orders' AS name, 'dataset' AS kind, count(*) AS row_count, 6 AS field_count FROM orders UNION ALL
    SELECT 'nation', 'dataset', count(*), 3 FROM nation""",
)
def f6_catalog(spark, sf):
    catalog = Catalog(spark, fresh_path(spark, "catalog"))
    for name in ("nation", "orders"):
        df = table(spark, sf, name)
        catalog.register("prj", name, f"{sf}/{name}.parquet", df.count(), [Field(c, "text", True, i) for i, c in enumerate(df.columns)])
    return catalog.listing("prj").select("name", "kind", "row_count", F.size("fields").alias("field_count"))
