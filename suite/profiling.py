"""Quality profiles: every field of whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom import ROW_ID, profile
from gridloom.session import fresh_path

from .registry import dataset, register, table


def flat(df):
    """Lists as text, so that both engines compare plain values."""
    return df.withColumns({
        c: F.array_join(c, "|") for c, kind in df.dtypes if kind == "array<string>"
    })


# Documents with blanks and repeats, and fields declared non-nullable that hold blanks.
DOCS_SQL = """SELECT row_number() OVER (ORDER BY doc_id) AS r, lang,
    CASE WHEN source IN ('src0', 'src1', 'src2') THEN '' ELSE source END AS source,
    CASE WHEN n_chars > 1000 THEN n_chars END AS n_chars, 'fixed' AS fixed,
    CASE WHEN lang <> 'en' THEN lang END AS other FROM documents"""


def docs(spark, sf):
    df = dataset(spark, sf, "documents")
    return df.select(
        ROW_ID, F.col("lang").alias("lang", metadata={"nullable": False}),
        F.when(F.col("source").isin("src0", "src1", "src2"), "").otherwise(F.col("source")).alias("source", metadata={"nullable": False}),
        F.when(F.col("n_chars") > 1000, F.col("n_chars")).alias("n_chars"), F.lit("fixed").alias("fixed"),
        F.when(F.col("lang") != "en", F.col("lang")).alias("other"),
    )


def profile_sql(source: str, row_id: str, fields: list[tuple[str, str, str, bool]]) -> str:
    """The field profile in plain SQL: (name, text expression, type, nullable) per field."""
    longs = " UNION ALL ".join(
        f"""SELECT {i} AS "order", '{name}' AS name, '{kind}' AS inferred_type, {nullable} AS nullable,
        {row_id} AS r, {text} AS v FROM ({source}) t"""
        for i, (name, text, kind, nullable) in enumerate(fields)
    )
    return f"""WITH longs AS ({longs}),
    groups AS (SELECT "order", name, inferred_type, nullable, nullif(v, '') AS v, count(*) AS n, min(r) AS first_row
        FROM longs GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY "order" ORDER BY v IS NULL, first_row, v) AS k FROM groups),
    facts AS (SELECT "order", name, inferred_type, nullable, CAST(sum(n) AS BIGINT) AS row_count,
        CAST(coalesce(sum(n) FILTER (WHERE v IS NULL), 0) AS BIGINT) AS null_count, count(v) AS distinct_count,
        coalesce(string_agg(v, '|' ORDER BY k) FILTER (WHERE k <= 5 AND v IS NOT NULL), '') AS sample_values
        FROM ranked GROUP BY ALL)
    SELECT "order", name, inferred_type, nullable, row_count, null_count,
        round_even(null_count / row_count, 4) AS null_ratio, distinct_count,
        row_count - null_count - distinct_count AS duplicate_count, sample_values,
        concat_ws('|', CASE WHEN null_count > 0 AND NOT nullable THEN 'unexpected_nulls' END,
            CASE WHEN round_even(null_count / row_count, 4) >= 0.5 THEN 'high_null_ratio' END,
            CASE WHEN distinct_count = 1 AND row_count > 1 THEN 'single_distinct_value' END) AS warnings
    FROM facts"""


DOC_FIELDS = [
    ("lang", "lang", "text", False), ("source", "source", "text", False),
    ("n_chars", "CAST(n_chars AS VARCHAR)", "integer", True), ("fixed", "fixed", "text", False),
    ("other", "other", "text", True),
]


@register("d1_d4_field_profile_documents", profile_sql(DOCS_SQL, "r", DOC_FIELDS))
def d1(spark, sf):
    return flat(profile.fields(docs(spark, sf)))


ALL_FIELDS = [
    ("doc_id", "CAST(doc_id AS VARCHAR)", "integer", True), ("text", "text", "text", True), ("lang", "lang", "text", True),
    ("source", "source", "text", True), ("n_chars", "CAST(n_chars AS VARCHAR)", "integer", True),
]


@register(
    "d1_d4_field_profile_all_documents",
    profile_sql("SELECT row_number() OVER (ORDER BY doc_id) AS r, * FROM documents", "r", ALL_FIELDS),
)
def d1_all(spark, sf):
    """All columns, the whole texts among them."""
    return flat(profile.fields(dataset(spark, sf, "documents")))


LINE_FIELDS = [
    (n, f"CAST({n} AS VARCHAR)" if n != "l_shipdate" else "strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S')", k, True)
    for n, k in (
        ("l_orderkey", "integer"), ("l_partkey", "integer"), ("l_suppkey", "integer"), ("l_linenumber", "integer"),
        ("l_quantity", "decimal"), ("l_extendedprice", "decimal"), ("l_discount", "decimal"), ("l_tax", "decimal"),
        ("l_returnflag", "text"), ("l_linestatus", "text"), ("l_shipdate", "datetime"),
    )
]


@register(
    "d1_d4_field_profile_lineitem",
    f"""SELECT "order", name, inferred_type, nullable, row_count, null_count, null_ratio, distinct_count, duplicate_count,
    warnings FROM ({profile_sql('SELECT *, 0 AS r FROM lineitem', 'r', LINE_FIELDS)})""",
)
def d1_lineitem(spark, sf):
    return flat(profile.fields(table(spark, sf, "lineitem"))).drop("sample_values")


@register(
    "d2_approximate_profile",
    """SELECT 0 AS "order", 'o_orderstatus' AS name, count(*) AS row_count, 0::BIGINT AS null_count,
    count(DISTINCT o_orderstatus) AS distinct_count FROM orders UNION ALL
    SELECT 1, 'o_orderpriority', count(*), 0, count(DISTINCT o_orderpriority) FROM orders""",
)
def d2_approximate(spark, sf):
    """The one-pass form; with few distinct values the sketch is exact."""
    df = table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority")
    return profile.fields(df, approximate=True).select("order", "name", "row_count", "null_count", "distinct_count")


ORDER_FIELDS = [("o_custkey", "CAST(o_custkey AS VARCHAR)", "integer", True), ("o_orderstatus", "o_orderstatus", "text", True)]


@register(
    "d3_sample_values",
    f"""SELECT name, sample_values FROM ({profile_sql(
        'SELECT o_orderkey AS r, o_custkey, o_orderstatus FROM orders', 'r', ORDER_FIELDS)})""",
)
def d3(spark, sf):
    df = dataset(spark, sf, "orders").select(ROW_ID, "o_custkey", "o_orderstatus")
    return flat(profile.fields(df)).select("name", "sample_values")


@register(
    "d5_d7_dataset_profile",
    f"""WITH f AS ({profile_sql(DOCS_SQL, 'r', DOC_FIELDS)}),
    d AS (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT lang, source, n_chars, fixed, other FROM ({DOCS_SQL}))) AS n
        FROM documents)
    SELECT max(row_count) AS row_count, count(*) AS field_count, CAST(sum(null_count) AS BIGINT) AS null_cell_count,
    round_even(sum(null_count) / (max(row_count) * count(*)), 4) AS null_cell_ratio, max(n) AS duplicate_row_count,
    concat_ws('|', CASE WHEN max(n) > 0 THEN 'duplicate_rows_detected' END,
        CASE WHEN max(null_ratio) >= 0.5 THEN 'high_null_fields_detected' END) AS warnings FROM f, d""",
)
def d5(spark, sf):
    return flat(profile.dataset(docs(spark, sf)))


@register(
    "d6_duplicate_rows",
    """SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_row_count FROM
    (SELECT count(*) AS n FROM lineitem GROUP BY l_quantity, l_discount, l_tax, l_returnflag, l_linestatus)""",
)
def d6(spark, sf):
    df = table(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    return profile.duplicate_row_count(df)


def _stats(i: int, name: str) -> str:
    return f"""SELECT {i} AS "order", '{name}' AS name, count({name}) AS count, CAST(min({name}) AS DOUBLE) AS min,
    CAST(max({name}) AS DOUBLE) AS max, round(avg({name}), 4) AS mean, round(stddev_samp({name}), 4) AS stddev,
    CAST(quantile_cont({name}, 0.5) AS DOUBLE) AS median FROM lineitem"""


@register(
    "d8_summary_statistics",
    " UNION ALL ".join(
        _stats(i, n) for i, n in enumerate(("l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    ),
)
def d8(spark, sf):
    df = table(spark, sf, "lineitem").select("l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return profile.summary(df).withColumns({c: F.round(c, 4) for c in ("mean", "stddev")})


def _two_parts(spark, sf):
    """The states of two parts of the documents, stored as they arrive, and the whole table."""
    whole, folder = docs(spark, sf), fresh_path(spark, "profile-states")
    for condition in (F.col("n_chars").isNull(), F.col("n_chars").isNotNull()):
        profile.state(whole.where(condition)).write.mode("append").parquet(folder)
    return whole, profile.merge(spark.read.parquet(folder))


@register(
    "d1_d3_merged_profile",
    f"""SELECT "order", name, row_count, null_count, null_ratio, sample_values, true AS distinct_within FROM ({profile_sql(DOCS_SQL, 'r', DOC_FIELDS)})""",
)
def d1_merged(spark, sf):
    """The profile merged from two parts; the distinct counts, which are sketched, lie within 3 % of the exact ones."""
    whole, known = _two_parts(spark, sf)
    exact = profile.fields(whole).select("order", F.col("distinct_count").alias("exact"))
    within = F.abs(F.col("distinct_count") - F.col("exact")) <= F.col("exact") * 0.03
    both = profile.fields_of_state(known).join(exact, "order")
    return flat(both.select("order", "name", "row_count", "null_count", "null_ratio", "sample_values", within.alias("distinct_within")))


@register(
    "d5_merged_dataset_profile",
    f"""SELECT max(row_count) AS row_count, count(*) AS field_count, CAST(sum(null_count) AS BIGINT) AS null_cell_count,
    CAST(0 AS BIGINT) AS duplicate_row_count FROM ({profile_sql(DOCS_SQL, 'r', DOC_FIELDS)})""",
)
def d5_merged(spark, sf):
    """The roll-up of the merged parts; row numbers are left out of the fields, but no row has a copy."""
    whole = docs(spark, sf)
    named = whole.select(ROW_ID, F.col(ROW_ID).alias("id"), *[c for c in whole.columns if c != ROW_ID])
    folder = fresh_path(spark, "profile-states")
    for k in range(2):
        profile.state(named.where(F.col(ROW_ID) % 2 == k), samples=False).write.mode("append").parquet(folder)
    rolled = profile.dataset_of(profile.merge(spark.read.parquet(folder)))
    return rolled.select("row_count", (F.col("field_count") - 1).alias("field_count"), "null_cell_count", "duplicate_row_count")
