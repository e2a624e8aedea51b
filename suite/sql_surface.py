"""Guarded SQL over the tables of a project: runs, saved views and the families of SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom import Scope
from gridloom.functions import names
from gridloom.operators.range_join import range_join
from gridloom.session import fresh_path

from .registry import dataset, register, table


def scope(spark, sf, *tables):
    return Scope(spark, {f"dataset_{n}": dataset(spark, sf, n) for n in tables})


def family(name: str, tables: str, sql: str, oracle: str | None = None) -> None:
    """A whole-table query of one SQL family, the same text on both sides unless the dialects differ."""

    def query(spark, sf):
        return scope(spark, sf, *tables.split()).query(sql)

    register(name, oracle or sql.replace("dataset_", ""))(query)


REGIONAL = """SELECT r_name AS region, COUNT(*) AS order_count, ROUND(SUM(o_totalprice), 2) AS total_revenue,
    ROUND(AVG(o_totalprice), 4) AS avg_price
    FROM dataset_orders JOIN dataset_customer ON o_custkey = c_custkey JOIN dataset_nation ON c_nationkey = n_nationkey
    JOIN dataset_region ON n_regionkey = r_regionkey GROUP BY r_name ORDER BY total_revenue DESC"""


@register("e3_run_regional_revenue", REGIONAL.replace("dataset_", ""))
def e3(spark, sf):
    return scope(spark, sf, "orders", "customer", "nation", "region").run(REGIONAL)


TOP_CUSTOMERS = """SELECT o_custkey, ROUND(SUM(o_totalprice), 2) AS spent FROM dataset_orders
    GROUP BY o_custkey ORDER BY spent DESC, o_custkey"""


@register("e3_run_with_cap", TOP_CUSTOMERS.replace("dataset_", "") + " LIMIT 100")
def e3_cap(spark, sf):
    return scope(spark, sf, "orders").run(TOP_CUSTOMERS + " -- the cap comes from the run\n;", limit=100)


SAVED = "SELECT o_custkey, o_orderstatus, COUNT(*) AS n FROM dataset_orders GROUP BY ALL ORDER BY o_custkey, o_orderstatus"


@register(
    "e4_save_as_view",
    f"SELECT row_number() OVER (ORDER BY o_custkey, o_orderstatus) AS _das_row_id, * FROM ({SAVED.replace('dataset_', '')})",
)
def e4(spark, sf):
    return scope(spark, sf, "orders").save(SAVED, fresh_path(spark, "view"))[0]


@register(
    "e4_save_first_rows",
    f"""SELECT row_number() OVER (ORDER BY o_custkey, o_orderstatus) AS _das_row_id, * FROM ({SAVED.replace('dataset_', '')} LIMIT 500)""",
)
def e4_cap(spark, sf):
    return scope(spark, sf, "orders").save(SAVED, fresh_path(spark, "view"), limit=500)[0]


@register(
    "e4_save_all_rows",
    "SELECT row_number() OVER (ORDER BY o_orderkey) AS _das_row_id, * FROM (SELECT o_orderkey, o_orderstatus FROM orders)",
)
def e4_all(spark, sf):
    sql = "SELECT o_orderkey, o_orderstatus FROM dataset_orders ORDER BY o_orderkey"
    return scope(spark, sf, "orders").save(sql, fresh_path(spark, "view"))[0]


@register(
    "e5_catalog_metadata",
    """SELECT * FROM (SELECT 'dataset_nation' AS table_alias, (SELECT count(*) FROM nation) AS row_count, * FROM (VALUES
    (0, 'n_nationkey', 'integer', true), (1, 'n_name', 'text', true), (2, 'n_regionkey', 'integer', true))
    v(field_order, field_name, inferred_type, nullable) UNION ALL
    SELECT 'dataset_region', (SELECT count(*) FROM region), * FROM (VALUES
    (0, 'r_regionkey', 'integer', true), (1, 'r_name', 'text', true)) v)""",
)
def e5(spark, sf):
    counts = {f"dataset_{n}": table(spark, sf, n).count() for n in ("nation", "region")}
    return scope(spark, sf, "nation", "region").metadata(counts)


@register("e6_stable_reference", "SELECT doc_id, 'sql_query_' || substr(sha256(text), 1, 24) AS reference FROM documents")
def e6(spark, sf):
    """A stable short id for each whole text."""
    df = table(spark, sf, "documents")
    return df.select("doc_id", names.stable_reference(F.lit("sql_query"), F.col("text")).alias("reference"))


@register(
    "e6_view_source",
    """SELECT page_id, CASE WHEN length(url) <= 40 THEN url WHEN length(html) > 2000
    THEN 'web_page_' || substr(sha256(html), 1, 24) ELSE 'sql_query_' || substr(sha256(url), 1, 24) END AS source FROM pages""",
)
def e6_view(spark, sf):
    """Short ids stay, long ids and SQL texts become references."""
    df = table(spark, sf, "pages")
    short = F.when(F.length("url") <= 40, F.col("url")).when(F.length("html") > 2000, F.col("html"))
    source = names.view_source_id(F.lit("web-page"), short, F.col("url"), F.lit("view"))
    return df.select("page_id", source.alias("source"))


family(
    "e10_projection", "lineitem",
    """SELECT l_orderkey AS k, l_linenumber, l_partkey, l_suppkey, l_quantity * 2 + 1 AS q,
    CASE WHEN l_discount >= 0.05 THEN 'high' WHEN l_discount > 0 THEN 'low' ELSE 'none' END AS level,
    COALESCE(NULLIF(l_returnflag, 'N'), '-') AS flag, CAST(l_quantity AS INT) AS whole FROM dataset_lineitem""",
)
family(
    "e11_filters", "lineitem",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM dataset_lineitem
    WHERE l_shipdate BETWEEN TIMESTAMP_NTZ '1996-01-01' AND TIMESTAMP_NTZ '1998-12-31' AND l_returnflag IN ('A', 'R')
    AND l_linestatus LIKE '%F%' AND NULLIF(l_tax, 0) IS NOT NULL AND l_quantity <> 10""",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem
    WHERE l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31' AND l_returnflag IN ('A', 'R')
    AND l_linestatus LIKE '%F%' AND NULLIF(l_tax, 0) IS NOT NULL AND l_quantity <> 10""",
)
family(
    "e12_join_inner", "lineitem orders part supplier",
    """SELECT p_brand, o_orderpriority, COUNT(*) AS n, ROUND(SUM(l_extendedprice), 2) AS revenue
    FROM dataset_lineitem JOIN dataset_orders ON l_orderkey = o_orderkey JOIN dataset_part ON l_partkey = p_partkey
    JOIN dataset_supplier ON l_suppkey = s_suppkey GROUP BY p_brand, o_orderpriority""",
)
family(
    "e12_join_outer", "customer orders",
    """SELECT c_custkey, COUNT(o_orderkey) AS orders, MIN(o_totalprice) AS least FROM dataset_customer
    LEFT JOIN dataset_orders ON c_custkey = o_custkey GROUP BY c_custkey""",
)
family(
    "e12_join_right_full", "nation supplier",
    """SELECT COALESCE(n_name, 'none') AS nation, s_suppkey FROM dataset_supplier
    RIGHT JOIN dataset_nation ON s_nationkey = n_nationkey UNION ALL
    SELECT COALESCE(n_name, 'gone'), s_suppkey FROM dataset_nation
    FULL JOIN dataset_supplier ON s_nationkey = n_nationkey""",
)
family(
    "e12_join_exists", "customer orders",
    """SELECT c_custkey, c_name FROM dataset_customer c
    WHERE EXISTS (SELECT 1 FROM dataset_orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')
    AND NOT EXISTS (SELECT 1 FROM dataset_orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 450000)""",
)
family(
    "e12_join_range", "customer nation",
    """SELECT n_name, COUNT(*) AS n FROM dataset_customer JOIN dataset_nation
    ON n_nationkey = c_nationkey AND c_acctbal BETWEEN n_nationkey * 100 AND n_nationkey * 100 + 5000 GROUP BY n_name""",
)
family(
    "e13_aggregation", "lineitem",
    """SELECT l_partkey, COUNT(*) AS n, COUNT(DISTINCT l_suppkey) AS suppliers, AVG(l_quantity) AS avg_qty,
    COUNT(*) FILTER (WHERE l_returnflag = 'R') AS returned FROM dataset_lineitem GROUP BY l_partkey HAVING COUNT(*) > 5""",
)
family(
    "e14_cube", "lineitem",
    """SELECT l_returnflag, l_linestatus, GROUPING(l_returnflag) AS g, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS qty
    FROM dataset_lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""",
    """SELECT l_returnflag, l_linestatus, CAST(GROUPING(l_returnflag) AS TINYINT) AS g, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS qty
    FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""",
)
family(
    "e14_rollup_sets", "orders",
    """SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM dataset_orders
    GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderpriority), ()) UNION ALL
    SELECT o_orderstatus, o_orderpriority, COUNT(*) FROM dataset_orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""",
)
family(
    "e15_windows", "events",
    """SELECT event_id, ROW_NUMBER() OVER w AS rn, RANK() OVER (PARTITION BY user_id ORDER BY event_type) AS rk,
    DENSE_RANK() OVER (PARTITION BY user_id ORDER BY event_type) AS dr, NTILE(4) OVER w AS bucket,
    LAG(value) OVER w AS before, LEAD(value, 2) OVER w AS after,
    FIRST_VALUE(event_type) OVER w AS first_type,
    LAST_VALUE(event_type) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS last_type,
    ROUND(SUM(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last3,
    COUNT(*) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 500 PRECEDING AND CURRENT ROW) AS near
    FROM dataset_events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""",
)
family(
    "e16_order_limit_offset", "orders",
    "SELECT o_orderkey, o_totalprice FROM dataset_orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30 OFFSET 20",
)
family(
    "e17_set_operations", "customer supplier orders",
    """(SELECT c_nationkey AS k FROM dataset_customer INTERSECT SELECT s_nationkey FROM dataset_supplier)
    UNION ALL (SELECT c_custkey FROM dataset_customer EXCEPT SELECT o_custkey FROM dataset_orders)
    UNION (SELECT s_suppkey FROM dataset_supplier)""".join(["SELECT k FROM (", ") u"]),
)
family(
    "e18_subqueries", "orders customer",
    """WITH spent AS (SELECT o_custkey, SUM(o_totalprice) AS total FROM dataset_orders GROUP BY o_custkey)
    SELECT c_custkey, ROUND((SELECT MAX(total) FROM spent), 2) AS best,
    (SELECT COUNT(*) FROM dataset_orders o WHERE o.o_custkey = c.c_custkey) AS n
    FROM dataset_customer c WHERE c_acctbal > (SELECT AVG(c_acctbal) FROM dataset_customer)""",
)
family(
    "e18_recursive", "orders",
    """WITH RECURSIVE years(y) AS (SELECT CAST(MIN(YEAR(o_orderdate)) AS INT) FROM dataset_orders UNION ALL
    SELECT y + 1 FROM years WHERE y < 2005)
    SELECT y, COUNT(o_orderkey) AS n FROM years LEFT JOIN dataset_orders ON YEAR(o_orderdate) = y GROUP BY y""",
)
family(
    "e19_strings", "customer",
    """SELECT c_custkey, UPPER(c_name) AS u, LOWER(c_mktsegment) AS l, SUBSTRING(c_name, 1, 8) AS s, LENGTH(c_name) AS n,
    CONCAT(c_mktsegment, '-', c_nationkey) AS tag, REPLACE(c_name, '#', ' no. ') AS r,
    REGEXP_REPLACE(c_name, '0+', '') AS z, TRIM(CONCAT('  ', c_mktsegment, ' ')) AS t FROM dataset_customer""",
    """SELECT c_custkey, UPPER(c_name) AS u, LOWER(c_mktsegment) AS l, SUBSTRING(c_name, 1, 8) AS s, CAST(LENGTH(c_name) AS INT) AS n,
    CONCAT(c_mktsegment, '-', c_nationkey) AS tag, REPLACE(c_name, '#', ' no. ') AS r,
    REGEXP_REPLACE(c_name, '0+', '', 'g') AS z, TRIM(CONCAT('  ', c_mktsegment, ' ')) AS t FROM customer""",
)
family(
    "e20_dates", "orders",
    """SELECT o_orderkey, CAST(DATE_TRUNC('quarter', o_orderdate) AS TIMESTAMP_NTZ) AS quarter_start, DATE_PART('month', o_orderdate) AS m,
    DATE_ADD(CAST(o_orderdate AS DATE), 30) AS due, DATEDIFF(DATE '2005-01-01', CAST(o_orderdate AS DATE)) AS age FROM dataset_orders""",
    """SELECT o_orderkey, CAST(DATE_TRUNC('quarter', o_orderdate) AS TIMESTAMP) AS quarter_start,
    CAST(DATE_PART('month', o_orderdate) AS INT) AS m, CAST(CAST(o_orderdate AS DATE) + 30 AS DATE) AS due,
    CAST(DATE '2005-01-01' - CAST(o_orderdate AS DATE) AS INT) AS age FROM orders""",
)
family(
    "e21_math", "customer",
    """SELECT c_custkey, ROUND(c_acctbal, 1) AS r, FLOOR(c_acctbal) AS f, CEIL(c_acctbal) AS c, ABS(c_acctbal) AS a,
    ROUND(POWER(c_nationkey, 2), 2) AS p, ROUND(LN(ABS(c_acctbal) + 1), 6) AS lg, c_custkey % 7 AS m FROM dataset_customer""",
    """SELECT c_custkey, ROUND(c_acctbal, 1) AS r, CAST(FLOOR(c_acctbal) AS BIGINT) AS f, CAST(CEIL(c_acctbal) AS BIGINT) AS c,
    ABS(c_acctbal) AS a, ROUND(POWER(c_nationkey, 2), 2) AS p, ROUND(LN(ABS(c_acctbal) + 1), 6) AS lg, c_custkey % 7 AS m FROM customer""",
)
family(
    "e22_json", "events",
    """SELECT event_type, COUNT(*) AS n, SUM(CAST(GET_JSON_OBJECT(props, '$.k') AS BIGINT)) AS total,
    MAX(FROM_JSON(props, 'k INT').k) AS most FROM dataset_events GROUP BY event_type""",
    """SELECT event_type, COUNT(*) AS n, CAST(SUM(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total,
    MAX(CAST(json_extract_string(props, '$.k') AS INT)) AS most FROM events GROUP BY event_type""",
)


@register(
    "e12_join_range_bins",
    """SELECT o_orderkey, COUNT(*) AS n, MIN(c_custkey) AS least, MAX(c_custkey) AS most FROM orders
    JOIN customer ON o_totalprice BETWEEN c_acctbal * 50 AND c_acctbal * 50 + c_custkey % 400 GROUP BY o_orderkey""",
)
def e12_range_bins(spark, sf):
    """Values in intervals of many widths, no equal field."""
    lows = table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") * 50).alias("low"))
    intervals = lows.select("c_custkey", "low", (F.col("low") + F.col("c_custkey") % 400).alias("high"))
    met = range_join(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), intervals, "o_totalprice", "low", "high")
    return met.groupBy("o_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("least"), F.max("c_custkey").alias("most")
    )
