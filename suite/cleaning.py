"""Recipe steps, recipe preview and recipe execution."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom import ROW_ID, Step, recipe
from gridloom.functions import conditions
from gridloom.session import fresh_path
from gridloom.types import fields_of

from .registry import dataset, register, table

# Documents with blanks: lang '' for French, source null for src1.
DIRTY_SQL = """SELECT row_number() OVER (ORDER BY doc_id) AS _das_row_id, doc_id,
    CASE WHEN lang = 'fr' THEN '' ELSE lang END AS lang,
    CASE WHEN source = 'src1' THEN NULL ELSE source END AS source, n_chars FROM documents"""


def dirty(spark, sf):
    return dataset(spark, sf, "documents").select(
        ROW_ID, "doc_id",
        F.when(F.col("lang") == "fr", "").otherwise(F.col("lang")).alias("lang"),
        F.when(F.col("source") != "src1", F.col("source")).alias("source"),
        "n_chars",
    )


def plain(df):
    return df.drop(ROW_ID)


def apply(df, *configs, scope=None):
    listed = [Step(op, i, config) for i, (op, config) in enumerate(configs)]
    return plain(recipe.apply_steps(df, listed, scope))


@register("c1_rename_field", f"SELECT doc_id AS id, lang, source AS origin, n_chars FROM ({DIRTY_SQL})")
def c1(spark, sf):
    return apply(
        dirty(spark, sf),
        ("rename_field", {"source_field": "doc_id", "target_field": "id"}),
        ("rename_field", {"source_field": "source", "target_field": "origin"}),
    )


@register(
    "c2_fill_null",
    f"""SELECT doc_id, coalesce(nullif(lang, ''), 'unknown') AS lang, coalesce(source, 'none') AS source, n_chars
    FROM ({DIRTY_SQL})""",
)
def c2(spark, sf):
    return apply(
        dirty(spark, sf),
        ("fill_null", {"field": "lang", "value": "unknown"}),
        ("fill_null", {"field": "source", "value": "none"}),
    )


@register(
    "c3_drop_null_rows",
    f"SELECT doc_id, lang, source, n_chars FROM ({DIRTY_SQL}) WHERE lang <> '' AND lang IS NOT NULL AND source IS NOT NULL",
)
def c3(spark, sf):
    return apply(dirty(spark, sf), ("drop_null_rows", {"fields": ["lang", "source"]}))


@register(
    "c4_deduplicate",
    """SELECT event_id, user_id, event_type, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1""",
)
def c4(spark, sf):
    df = dataset(spark, sf, "events").select(ROW_ID, "event_id", "user_id", "event_type", "value")
    return apply(df, ("deduplicate", {"fields": ["user_id", "event_type"]}))


@register(
    "c4_deduplicate_blank_is_not_null",
    f"""SELECT doc_id, lang, source FROM ({DIRTY_SQL})
    QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY _das_row_id) = 1""",
)
def c4_blank(spark, sf):
    return apply(dirty(spark, sf).drop("n_chars"), ("deduplicate", {"fields": ["lang", "source"]}))


@register(
    "c6_output_schema",
    """SELECT * FROM (VALUES (0, 'key', 'integer', false), (1, 'language', 'text', false),
    (2, 'source', 'text', true), (3, 'n_chars', 'integer', true)) v("order", name, inferred_type, nullable)
    WHERE EXISTS (SELECT 1 FROM documents)""",
)
def c6(spark, sf):
    """The fields a recipe leaves, read back from the table it wrote."""
    listed = [
        Step("fill_null", 0, {"field": "doc_id", "value": 0}),
        Step("rename_field", 1, {"source_field": "doc_id", "target_field": "key"}),
        Step("fill_null", 2, {"field": "lang", "value": "unknown"}),
        Step("rename_field", 3, {"source_field": "lang", "target_field": "language"}),
    ]
    out, _ = recipe.execute(dirty(spark, sf), listed, fresh_path(spark, "c6"))
    rows = [(f.order, f.name, f.type, f.nullable) for f in fields_of(out)]
    return spark.createDataFrame(rows, "`order` int, name string, inferred_type string, nullable boolean")


@register(
    "c7_recipe_preview",
    f"""SELECT * FROM (SELECT _das_row_id, doc_id, lang, coalesce(source, 'none') AS source, n_chars FROM ({DIRTY_SQL})
    WHERE _das_row_id > 50 AND _das_row_id <= 100) WHERE lang <> ''
    QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY _das_row_id) = 1""",
)
def c7(spark, sf):
    listed = [
        Step("deduplicate", 2, {"fields": ["lang", "source"]}),
        Step("fill_null", 0, {"field": "source", "value": "none"}),
        Step("drop_null_rows", 1, {"fields": ["lang"]}),
    ]
    return recipe.preview(dirty(spark, sf), listed, page=2, page_size=50)


@register(
    "c8_recipe_execute",
    f"""SELECT row_number() OVER (ORDER BY _das_row_id) AS _das_row_id, doc_id, lang AS language, source, n_chars
    FROM (SELECT _das_row_id, doc_id, lang, coalesce(source, 'none') AS source, n_chars FROM ({DIRTY_SQL})
    WHERE lang <> '' QUALIFY row_number() OVER (PARTITION BY lang, coalesce(source, 'none'), n_chars ORDER BY _das_row_id) = 1)""",
)
def c8(spark, sf):
    listed = [
        Step("fill_null", 0, {"field": "source", "value": "none"}),
        Step("drop_null_rows", 1, {"fields": ["lang"]}),
        Step("deduplicate", 2, {"fields": ["lang", "source", "n_chars"]}),
        Step("rename_field", 3, {"source_field": "lang", "target_field": "language"}),
    ]
    return recipe.execute(dirty(spark, sf), listed, fresh_path(spark, "c8"))[0]


@register(
    "c8_recipe_execute_sorted",
    """SELECT row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS _das_row_id, c_custkey, c_name, c_acctbal
    FROM customer WHERE c_mktsegment <> 'BUILDING'""",
)
def c8_sorted(spark, sf):
    df = dataset(spark, sf, "customer").select(ROW_ID, "c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    listed = [
        Step("filter_rows", 0, {"condition": {"field": "c_mktsegment", "op": "!=", "value": "BUILDING"}}),
        Step("sort", 1, {"by": [{"field": "c_acctbal", "direction": "desc"}]}),
    ]
    kept = recipe.execute(df, listed, fresh_path(spark, "c8s"))[0]
    return kept.drop("c_mktsegment")


@register(
    "c9_convert_type",
    """SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate,
    CAST(o_custkey AS VARCHAR) AS o_custkey, try_cast(o_orderpriority AS DOUBLE) AS o_orderpriority FROM orders""",
)
def c9(spark, sf):
    df = table(spark, sf, "orders").drop("o_orderstatus")
    return apply(
        df,
        ("convert_type", {"field": "o_totalprice", "type": "integer"}),
        ("convert_type", {"field": "o_orderdate", "type": "date"}),
        ("convert_type", {"field": "o_custkey", "type": "text"}),
        ("convert_type", {"field": "o_orderpriority", "type": "decimal", "on_error": "null"}),
    )


@register(
    "c10_filter_rows",
    """SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders
    WHERE (o_orderstatus IN ('F', 'P') AND o_totalprice BETWEEN 1000 AND 200000)
    OR (o_orderpriority LIKE '1-%' AND NOT o_totalprice < 400000)""",
)
def c10(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    tree = {
        "or": [
            {"and": [
                {"field": "o_orderstatus", "op": "in", "value": ["F", "P"]},
                {"field": "o_totalprice", "op": "between", "value": [1000, 200000]},
            ]},
            {"and": [
                {"field": "o_orderpriority", "op": "like", "value": "1-%"},
                {"not": {"field": "o_totalprice", "op": "<", "value": 400000}},
            ]},
        ]
    }
    return apply(df, ("filter_rows", {"condition": tree}))


@register(
    "c11_top_rows",
    """SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25""",
)
def c11(spark, sf):
    by = [{"field": "o_totalprice", "direction": "desc"}, {"field": "o_orderkey"}]
    return apply(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ("sort", {"by": by, "limit": 25}))


@register(
    "c12_aggregate",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price,
    min(l_shipdate) AS first_ship, max(l_discount) AS max_discount, count(*) AS n, count(DISTINCT l_partkey) AS parts
    FROM lineitem GROUP BY 1, 2""",
)
def c12(spark, sf):
    specs = [
        {"function": "sum", "field": "l_quantity", "name": "sum_qty"},
        {"function": "avg", "field": "l_extendedprice", "name": "avg_price"},
        {"function": "min", "field": "l_shipdate", "name": "first_ship"},
        {"function": "max", "field": "l_discount", "name": "max_discount"},
        {"function": "count", "name": "n"},
        {"function": "count_distinct", "field": "l_partkey", "name": "parts"},
    ]
    return apply(
        table(spark, sf, "lineitem"),
        ("aggregate", {"group_by": ["l_returnflag", "l_linestatus"], "aggregations": specs}),
        ("numeric", {"field": "sum_qty", "action": "round", "digits": 2}),
        ("numeric", {"field": "avg_price", "action": "round", "digits": 4}),
    )


@register(
    "c13_calculate",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem""",
)
def c13(spark, sf):
    df = table(spark, sf, "lineitem")
    kept = df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax")
    expression = "l_extendedprice * (1 - l_discount) * (1 + l_tax)"
    out = apply(kept, ("calculate", {"target": "charge", "expression": expression}))
    return out.drop("l_extendedprice", "l_discount", "l_tax")


@register(
    "c10_fraction_on_integer",
    """SELECT l_orderkey, l_linenumber, l_linenumber < 2.5 AS below, l_linenumber >= 2.5 AS above FROM lineitem
    WHERE (l_linenumber < 2.5 OR l_linenumber BETWEEN 3.5 AND 4.5 OR l_linenumber = 2.5 OR l_linenumber IN (5, 6.5)) AND l_linenumber <> 1.5""",
)
def c10_fraction(spark, sf):
    """Bounds between two integers stay where they are, for every operator."""
    df = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"))
    of = lambda op, value: {"field": "l_linenumber", "op": op, "value": value}
    tree = {"and": [{"or": [of("<", 2.5), of("between", [3.5, 4.5]), of("=", 2.5), of("in", [5, 6.5])]}, of("!=", 1.5)]}
    df = apply(df, ("filter_rows", {"condition": tree}))
    return df.withColumn("below", conditions.build(of("<", 2.5), df.schema)).withColumn("above", conditions.build(of(">=", 2.5), df.schema))


BOUND_OPERATORS = {"eq": "=", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}
BOUNDS_ON_TENTHS = {"between_two": "20.25", "on_one": "20.3", "beyond": "1000000000000"}
TENTHS = "CAST((CAST(l_quantity AS BIGINT) * 10 + l_linenumber)::DECIMAL(12,1) * 0.1::DECIMAL(2,1) AS DECIMAL(12,1))"


def compared(df, field: str, bounds: dict):
    """A boolean column for each operator and bound."""
    build = lambda op, value: conditions.build({"field": field, "op": op, "value": value}, df.schema)
    return df.select("*", *[
        build(op, value).alias(f"{name}_{label}") for label, value in bounds.items() for name, op in BOUND_OPERATORS.items()
    ])


def compared_sql(field: str, bounds: dict) -> str:
    return ", ".join(
        f"{field} {op.replace('!=', '<>')} {value} AS {name}_{label}" for label, value in bounds.items() for name, op in BOUND_OPERATORS.items()
    )


@register(
    "c10_decimal_bounds",
    f"""SELECT l_orderkey, l_linenumber, v IN (20.3, 20.25, 1000000000000) AS listed, v BETWEEN 20.25 AND 30.05 AS between_bounds,
    {compared_sql('v', BOUNDS_ON_TENTHS)} FROM (SELECT l_orderkey, l_linenumber, {TENTHS} AS v FROM lineitem)""",
)
def c10_decimals(spark, sf):
    """Bounds with more places than the field, or beyond its digits, are compared as they are."""
    ten = F.lit(10).cast("decimal(12,0)")
    v = F.col("l_quantity").cast("decimal(12,1)") + F.col("l_linenumber").cast("decimal(12,1)") / ten
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", v.cast("decimal(12,1)").alias("v"))
    one = lambda op, value: conditions.build({"field": "v", "op": op, "value": value}, df.schema)
    out = compared(df, "v", {k: float(b) for k, b in BOUNDS_ON_TENTHS.items()})
    listed, inside = one("in", [20.3, "20.25", 10**12]), one("between", [20.25, "30.05"])
    return out.select("*", listed.alias("listed"), inside.alias("between_bounds")).drop("v")


BOUNDS_ON_INTEGERS = {"above": "5000000000", "below": "-5000000000", "inside": "3"}


@register(
    "c10_int_beyond_range",
    f"""SELECT o_orderkey, v IN (3, 5000000000) AS listed, v NOT IN (3, 5000000000) AS unlisted,
    {compared_sql('v', BOUNDS_ON_INTEGERS)} FROM (SELECT o_orderkey, CAST(o_custkey % 7 AS INTEGER) AS v FROM orders)""",
)
def c10_int(spark, sf):
    """Bounds that the field's type cannot hold are beyond every value; none ends the query."""
    df = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 7).cast("int").alias("v"))
    one = lambda op: conditions.build({"field": "v", "op": op, "value": [3, 5 * 10**9]}, df.schema)
    out = compared(df, "v", {k: int(b) for k, b in BOUNDS_ON_INTEGERS.items()})
    return out.select("*", one("in").alias("listed"), one("not_in").alias("unlisted")).drop("v")


@register(
    "c18_clip_large",
    """SELECT o_orderkey, least(greatest(9007199254740992 + o_orderkey, 9007199254741993), 9007199254742995) AS clipped FROM orders""",
)
def c18_large(spark, sf):
    """Whole-number bounds above 2^53 are kept to the last digit."""
    df = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") + F.lit(2**53)).alias("clipped"))
    return apply(df, ("numeric", {"field": "clipped", "action": "clip", "min": 2**53 + 1001, "max": 2**53 + 2003}))


@register(
    "c14_merge_decimals",
    """SELECT o_orderkey, v::VARCHAR || '/' || o_orderstatus AS merged
    FROM (SELECT o_orderkey, o_orderstatus, round(o_totalprice * 1000) AS v FROM orders)""",
)
def c14_decimals(spark, sf):
    """Decimals of ten million and more keep plain digits in merged text."""
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.round(F.col("o_totalprice") * 1000).alias("v"))
    merge = {"fields": ["v", "o_orderstatus"], "target": "merged", "separator": "/"}
    return apply(df, ("merge_fields", merge)).select("o_orderkey", "merged")


@register(
    "c14_split_merge",
    """SELECT page_id, url, split_part(url, '/', 1) AS scheme, split_part(url, '/', 3) AS host,
    concat_ws('|', split_part(url, '/', 1), split_part(url, '/', 3)) AS origin FROM pages""",
)
def c14(spark, sf):
    out = apply(
        table(spark, sf, "pages").select("page_id", "url"),
        ("split_field", {"field": "url", "separator": "/", "targets": ["scheme", "empty", "host"]}),
        ("merge_fields", {"fields": ["scheme", "host"], "separator": "|", "target": "origin"}),
    )
    return out.drop("empty")


@register(
    "c15_conditional_field",
    """SELECT o_orderkey, CASE WHEN o_totalprice >= 300000 THEN 'large' WHEN o_orderstatus = 'P' THEN 'pending'
    ELSE 'other' END AS class FROM orders""",
)
def c15(spark, sf):
    cases = [
        {"when": {"field": "o_totalprice", "op": ">=", "value": 300000}, "then": "large"},
        {"when": {"field": "o_orderstatus", "op": "=", "value": "P"}, "then": "pending"},
    ]
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    out = apply(df, ("conditional_field", {"target": "class", "cases": cases, "otherwise": "other"}))
    return out.select("o_orderkey", "class")


@register(
    "c16_regex_extract",
    """SELECT page_id, nullif(regexp_extract(url, '^https?://([^/?#]+)', 1), '') AS host,
    nullif(regexp_extract(url, '[?&]page=([0-9]+)', 1), '') AS page_no FROM pages""",
)
def c16(spark, sf):
    out = apply(
        table(spark, sf, "pages").select("page_id", "url"),
        ("extract", {"field": "url", "pattern": "^https?://([^/?#]+)", "target": "host"}),
        ("extract", {"field": "url", "pattern": "[?&]page=([0-9]+)", "target": "page_no"}),
    )
    return out.drop("url")


@register(
    "c17_clean_text",
    """SELECT doc_id, sha256(trim(regexp_replace(replace(lower(text), 'the', 'a'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) AS digest
    FROM documents""",
)
def c17(spark, sf):
    """Whole texts, compared by digest of the cleaned text."""
    actions = ["lower", {"find": "the", "replace": "a"}, "collapse_spaces", "trim"]
    out = apply(table(spark, sf, "documents").select("doc_id", "text"), ("clean_text", {"field": "text", "actions": actions}))
    return out.select("doc_id", F.sha2("text", 256).alias("digest"))


@register(
    "c18_clip_fraction",
    "SELECT l_orderkey, least(greatest(l_linenumber::DOUBLE, 1.5), 4.5) AS clipped FROM lineitem",
)
def c18_fraction(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("clipped"))
    return apply(df, ("numeric", {"field": "clipped", "action": "clip", "min": 1.5, "max": 4.5}))


@register(
    "c18_numeric",
    """SELECT c_custkey, round(greatest(least(abs(c_acctbal), 5000), 100), 1) AS c_acctbal FROM customer""",
)
def c18(spark, sf):
    return apply(
        table(spark, sf, "customer").select("c_custkey", "c_acctbal"),
        ("numeric", {"field": "c_acctbal", "action": "abs"}),
        ("numeric", {"field": "c_acctbal", "action": "clip", "min": 100, "max": 5000}),
        ("numeric", {"field": "c_acctbal", "action": "round", "digits": 1}),
    )


@register(
    "c19_dates",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d') AS day_text, year(o_orderdate) AS y, quarter(o_orderdate) AS q,
    date_part('week', o_orderdate) AS w, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month_start FROM orders""",
)
def c19(spark, sf):
    out = apply(
        table(spark, sf, "orders").select("o_orderkey", "o_orderdate"),
        ("format_date", {"field": "o_orderdate", "format": "yyyy/MM/dd", "target": "day_text"}),
        ("date_part", {"field": "o_orderdate", "part": "year", "target": "y"}),
        ("date_part", {"field": "o_orderdate", "part": "quarter", "target": "q"}),
        ("date_part", {"field": "o_orderdate", "part": "week", "target": "w"}),
        ("truncate_date", {"field": "o_orderdate", "unit": "month", "target": "month_start"}),
    )
    return out.drop("o_orderdate")


@register(
    "c20_join",
    """SELECT o_orderkey, c_name, n_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey
    LEFT JOIN nation ON c_nationkey = n_nationkey""",
)
def c20(spark, sf):
    scope = {
        "customer": table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey"),
        "nation": table(spark, sf, "nation").select("n_nationkey", "n_name"),
    }
    out = apply(
        table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"),
        ("join", {"table": "customer", "on": [{"left": "o_custkey", "right": "c_custkey"}]}),
        ("join", {"table": "nation", "how": "left", "on": [{"left": "c_nationkey", "right": "n_nationkey"}]}),
        scope=scope,
    )
    return out.select("o_orderkey", "c_name", "n_name", "o_totalprice")


@register(
    "c20_join_split_heavy",
    """SELECT k, count(*) AS n, round(sum(o_totalprice), 2) AS total, min(c_name) AS c_name FROM
    (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE o_custkey END AS k, o_totalprice FROM orders) JOIN customer ON k = c_custkey GROUP BY k""",
)
def c20_heavy(spark, sf):
    """A third of the rows have one key, and a grouping by it follows."""
    key = F.when(F.col("o_orderkey") % 3 == 0, F.lit(1).cast("bigint")).otherwise(F.col("o_custkey"))
    out = apply(
        table(spark, sf, "orders").select("o_orderkey", key.alias("k"), "o_totalprice"),
        ("join", {"table": "customer", "on": [{"left": "k", "right": "c_custkey"}], "split_heavy": True}),
        ("aggregate", {"group_by": ["k"], "aggregations": [
            {"function": "count", "name": "n"}, {"function": "sum", "field": "o_totalprice", "name": "total"},
            {"function": "min", "field": "c_name", "name": "c_name"},
        ]}),
        scope={"customer": table(spark, sf, "customer").select("c_custkey", "c_name")},
    )
    return out.withColumn("total", F.round("total", 2))


@register(
    "c20_join_full",
    """SELECT coalesce(a.nation, b.nation) AS nation, c_custkey, s_suppkey FROM
    (SELECT c_nationkey AS nation, min(c_custkey) AS c_custkey FROM customer GROUP BY 1) a FULL JOIN
    (SELECT s_nationkey AS nation, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1) b
    ON a.nation = b.nation""",
)
def c20_full(spark, sf):
    rich = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nation"))
    suppliers = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nation"))
    scope = {"suppliers": suppliers.agg(F.min("s_suppkey").alias("s_suppkey"))}
    on = [{"left": "nation", "right": "nation"}]
    return apply(
        rich.agg(F.min("c_custkey").alias("c_custkey")),
        ("join", {"table": "suppliers", "how": "full", "on": on}), scope=scope,
    )


@register(
    "c20_join_semi_anti",
    """SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
    AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)""",
)
def c20_semi(spark, sf):
    orders = table(spark, sf, "orders")
    scope = {
        "finished": orders.filter("o_orderstatus = 'F'").select("o_custkey"),
        "large": orders.filter("o_totalprice > 450000").select("o_custkey"),
    }
    on = [{"left": "c_custkey", "right": "o_custkey"}]
    return apply(
        table(spark, sf, "customer").select("c_custkey", "c_name"),
        ("join", {"table": "finished", "how": "semi", "on": on}),
        ("join", {"table": "large", "how": "anti", "on": on}),
        scope=scope,
    )


@register(
    "c21_pivot",
    """SELECT user_id, CAST(sum(CASE WHEN event_type = 'click' THEN 1 END) AS BIGINT) AS click,
    CAST(sum(CASE WHEN event_type = 'view' THEN 1 END) AS BIGINT) AS "view",
    CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 END) AS BIGINT) AS purchase FROM events GROUP BY 1""",
)
def c21(spark, sf):
    config = {"group_by": ["user_id"], "column": "event_type", "values": ["click", "view", "purchase"], "function": "count"}
    return apply(table(spark, sf, "events").select("user_id", "event_type"), ("pivot", config))


@register(
    "c21_unpivot",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, measure, amount FROM
    (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax FROM lineitem)
    UNPIVOT (amount FOR measure IN (l_quantity, l_discount, l_tax))""",
)
def c21_unpivot(spark, sf):
    df = table(spark, sf, "lineitem")
    kept = df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax")
    config = {"fields": ["l_quantity", "l_discount", "l_tax"], "name_target": "measure", "value_target": "amount"}
    return apply(kept, ("unpivot", config))


@register(
    "c22_outliers_zscore",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
    l_extendedprice < a - 1.5 * s OR l_extendedprice > a + 1.5 * s AS outlier FROM lineitem JOIN
    (SELECT l_returnflag AS f, avg(l_extendedprice) AS a, stddev_pop(l_extendedprice) AS s FROM lineitem GROUP BY 1)
    ON f = l_returnflag""",
)
def c22(spark, sf):
    df = table(spark, sf, "lineitem")
    kept = df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")
    config = {"field": "l_extendedprice", "group_by": ["l_returnflag"], "threshold": 1.5, "target": "outlier"}
    return apply(kept, ("flag_outliers", config)).drop("l_returnflag")


@register(
    "c22_outliers_iqr",
    """SELECT event_id, value, value < q1 - 0.8 * (q3 - q1) OR value > q3 + 0.8 * (q3 - q1) AS outlier FROM events JOIN
    (SELECT event_type AS t, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
    ON t = event_type""",
)
def c22_iqr(spark, sf):
    config = {
        "field": "value", "group_by": ["event_type"], "method": "iqr", "threshold": 0.8, "target": "outlier",
    }
    kept = table(spark, sf, "events").select("event_id", "event_type", "value")
    return apply(kept, ("flag_outliers", config)).drop("event_type")


@register(
    "c22_outliers_whole_table",
    """SELECT o_orderkey, o_totalprice < a - 1.2 * s OR o_totalprice > a + 1.2 * s AS outlier
    FROM orders, (SELECT avg(o_totalprice) AS a, stddev_pop(o_totalprice) AS s FROM orders)""",
)
def c22_whole(spark, sf):
    config = {"field": "o_totalprice", "threshold": 1.2, "target": "outlier"}
    return apply(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ("flag_outliers", config)).drop("o_totalprice")


@register(
    "c23_batch",
    """SELECT p_partkey, upper(p_name) AS p_name, upper(p_brand) AS p_brand, upper(p_type) AS p_type FROM part""",
)
def c23(spark, sf):
    config = {
        "fields": ["p_name", "p_brand", "p_type"],
        "step": {"operation": "clean_text", "config": {"actions": ["upper", "trim"]}},
    }
    return apply(table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type"), ("batch", config))


@register(
    "c24_mask",
    """SELECT c_custkey, regexp_replace(regexp_replace(regexp_replace(c_name, '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'), '[0-9]', 'n', 'g') AS c_name,
    sha256(c_mktsegment) AS c_mktsegment, CAST(NULL AS DOUBLE) AS c_acctbal,
    repeat('*', length(c_name) - 4) || right(c_name, 4) AS short FROM customer""",
)
def c24(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal", F.col("c_name").alias("short"))
    return apply(
        df,
        ("mask", {"field": "short", "strategy": "last4"}),
        ("mask", {"field": "c_name", "strategy": "mask"}),
        ("mask", {"field": "c_mktsegment", "strategy": "hash"}),
        ("mask", {"field": "c_acctbal", "strategy": "null"}),
    )

