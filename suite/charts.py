"""Chart points, metric cards, dashboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom import ROW_ID, chart, lineage
from gridloom.functions import numbers

from .registry import dataset, register, table

# A point rounds to two decimals, halves up.
POINT = "floor({} * 100 + 0.5) / 100"


def by_region(spark, sf):
    """Orders with the region of their customer, as a data view."""
    orders = dataset(spark, sf, "orders").select(ROW_ID, "o_custkey", "o_totalprice", "o_orderstatus")
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf, "region")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    placed = joined.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return placed.select(ROW_ID, "r_name", "c_mktsegment", "o_orderstatus", "o_totalprice")


BY_REGION_SQL = """SELECT o_orderkey + 1 AS r, r_name, c_mktsegment, o_orderstatus, o_totalprice FROM orders
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


@register("g1_chart_sum", f"SELECT r_name AS label, {POINT.format('sum(o_totalprice)')} AS value FROM ({BY_REGION_SQL}) GROUP BY 1")
def g1_sum(spark, sf):
    return chart.aggregate(by_region(spark, sf), "r_name", "o_totalprice", "sum")


@register("g1_chart_count", f"SELECT c_mktsegment AS label, CAST(count(*) AS DOUBLE) AS value FROM ({BY_REGION_SQL}) GROUP BY 1")
def g1_count(spark, sf):
    return chart.aggregate(by_region(spark, sf), "c_mktsegment", "o_totalprice", "count")


@register(
    "g2_labels",
    """SELECT label, CAST(count(*) AS DOUBLE) AS value FROM (SELECT CASE WHEN lang = 'fr' OR lang = 'en' THEN 'NULL' ELSE lang END AS label
    FROM documents) GROUP BY 1""",
)
def g2_labels(spark, sf):
    blank = F.when(F.col("lang") == "fr", "").when(F.col("lang") != "en", F.col("lang"))
    df = dataset(spark, sf, "documents").select(ROW_ID, blank.alias("lang"))
    return chart.aggregate(df, "lang", "lang", "count")


@register(
    "g2_number_labels",
    """SELECT CASE WHEN l_quantity = floor(l_quantity) THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)
    ELSE CAST(l_quantity AS VARCHAR) END AS label, floor(sum(l_discount) * 100 + 0.5) / 100 AS value FROM lineitem GROUP BY 1""",
)
def g2_numbers(spark, sf):
    return chart.aggregate(table(spark, sf, "lineitem"), "l_quantity", "l_discount", "sum")


@register(
    "g3_number_text",
    """SELECT event_type AS label, floor(sum(CASE WHEN event_type = 'view' THEN 0 ELSE value END) * 100 + 0.5) / 100 AS value
    FROM events GROUP BY 1""",
)
def g3(spark, sf):
    """A text metric: numbers in text count, other text is 0."""
    text = F.when(F.col("event_type") == "view", "n/a").otherwise(F.concat(F.lit(" "), F.col("value").cast("string")))
    df = table(spark, sf, "events").select("event_type", text.alias("amount"))
    return chart.aggregate(df, "event_type", "amount", "sum")


@register(
    "g3_long_number_text",
    """SELECT event_type AS label, sum(16.0 ** 20 + (event_id % 16) * 16.0 ** 19) AS value FROM events GROUP BY 1""",
)
def g3_long(spark, sf):
    """Hexadecimal text of 21 digits, beyond a long."""
    digit = F.lower(F.hex(F.col("event_id") % 16))
    df = table(spark, sf, "events").select("event_type", F.concat(F.lit("0x1"), digit, F.repeat(F.lit("0"), F.lit(19))).alias("amount"))
    return chart.aggregate(df, "event_type", "amount", "sum")


@register(
    "g4_average_over_all_rows",
    f"""SELECT r_name AS label, {POINT.format("sum(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE o_totalprice END) / count(*)")} AS value
    FROM ({BY_REGION_SQL}) GROUP BY 1""",
)
def g4(spark, sf):
    df = by_region(spark, sf)
    return chart.aggregate(
        df.withColumn("o_totalprice", F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice"))),
        "r_name", "o_totalprice", "avg",
    )


@register(
    "g5_rounding",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, floor((l_extendedprice * l_discount - 100) * 100 + 0.5) / 100 AS value
    FROM lineitem""",
)
def g5(spark, sf):
    value = numbers.round_point(F.col("l_extendedprice") * F.col("l_discount") - 100)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", value.alias("value"))


@register(
    "g6_first_seen_order",
    """SELECT row_number() OVER (ORDER BY first_row) AS position, label, value FROM (SELECT CAST(o_custkey AS VARCHAR) AS label,
    min(o_orderkey) AS first_row, floor(sum(o_totalprice) * 100 + 0.5) / 100 AS value FROM orders GROUP BY 1)""",
)
def g6(spark, sf):
    """The points with their place in the chart."""
    from gridloom import row_id

    points = chart.aggregate(dataset(spark, sf, "orders").select(ROW_ID, "o_custkey", "o_totalprice"), "o_custkey", "o_totalprice")
    return row_id.number(points).withColumnRenamed(ROW_ID, "position")


@register(
    "g9_chart_of_first_rows",
    f"SELECT r_name AS label, {POINT.format('sum(o_totalprice)')} AS value FROM ({BY_REGION_SQL}) WHERE r <= 200 GROUP BY 1",
)
def g9(spark, sf):
    return chart.aggregate(by_region(spark, sf), "r_name", "o_totalprice", "sum", max_rows=chart.SNAPSHOT_ROWS)


# One dashboard per order, showing a chart per customer (twice, at two depths) and one per status.
def dashboards(spark, sf):
    layout = F.to_json(F.struct(
        F.lit("dashboard").alias("mode"),
        F.array(
            F.to_json(F.struct(F.concat(F.lit("chart_c"), F.col("o_custkey")).alias("chart_id"), F.lit(0).alias("x"))),
        ).alias("ignored"),
        F.array(F.struct(
            F.concat(F.lit("chart_c"), F.col("o_custkey")).alias("chart_id"), F.lit(0).alias("x"),
            F.struct(
                F.concat(F.lit("chart_c"), F.col("o_custkey")).alias("chart_id"),
                F.array(F.struct(F.concat(F.lit("chart_"), F.col("o_orderstatus")).alias("chart_id"))).alias("items"),
            ).alias("group"),
        )).alias("items"),
    ))
    owner = F.when(F.col("o_orderpriority") == "1-URGENT", "prj_urgent").otherwise("prj_main")
    return table(spark, sf, "orders").select(
        F.concat(F.lit("dash_"), F.col("o_orderkey")).alias("dashboard_id"), owner.alias("project_id"), layout.alias("layout")
    )


REFS_SQL = """SELECT 'dash_' || o_orderkey AS dashboard_id,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'prj_urgent' ELSE 'prj_main' END AS project_id,
    unnest(['chart_c' || o_custkey, 'chart_' || o_orderstatus]) AS chart_id FROM orders"""


@register("g10_dashboard_charts", REFS_SQL)
def g10(spark, sf):
    return chart.dashboard_refs(dashboards(spark, sf), "layout")


CHARTS_SQL = """SELECT 'chart_c' || c_custkey AS chart_id, 'prj_main' AS project_id,
    'view_' || c_nationkey AS data_view_id FROM customer"""


def charts(spark, sf):
    return table(spark, sf, "customer").select(
        F.concat(F.lit("chart_c"), F.col("c_custkey")).alias("chart_id"), F.lit("prj_main").alias("project_id"),
        F.concat(F.lit("view_"), F.col("c_nationkey")).alias("data_view_id"),
    )


@register(
    "g10_invalid_references",
    f"""SELECT * FROM ({REFS_SQL}) r WHERE NOT EXISTS (SELECT 1 FROM ({CHARTS_SQL}) c
    WHERE c.project_id = r.project_id AND c.chart_id = r.chart_id)""",
)
def g10_invalid(spark, sf):
    return chart.invalid_refs(chart.dashboard_refs(dashboards(spark, sf), "layout"), charts(spark, sf))


@register(
    "h1_chart_edges",
    f"""SELECT project_id, 'data_view' AS source_type, data_view_id AS source_id, 'chart' AS target_type, chart_id AS target_id,
    'chart_definition' AS transform_type, chart_id AS transform_id FROM ({CHARTS_SQL})""",
)
def h1_charts(spark, sf):
    return lineage.chart_edges(charts(spark, sf))


@register(
    "h1_dashboard_edges",
    f"""SELECT project_id, 'chart' AS source_type, chart_id AS source_id, 'dashboard' AS target_type, dashboard_id AS target_id,
    'dashboard_layout' AS transform_type, dashboard_id AS transform_id FROM ({REFS_SQL})""",
)
def h1_dashboards(spark, sf):
    df = dashboards(spark, sf).withColumn("mode", F.get_json_object("layout", "$.mode"))
    return lineage.dashboard_edges(chart.dashboard_refs(df, "layout"))


@register(
    "g11_charts_out_of_scope",
    f"""SELECT * FROM ({CHARTS_SQL}) c WHERE data_view_id NOT IN
    (SELECT 'view_' || n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA')""",
)
def g11(spark, sf):
    nation = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    views = nation.filter("r_name <> 'ASIA'").select(
        F.lit("prj_main").alias("project_id"), F.concat(F.lit("view_"), F.col("n_nationkey")).alias("data_view_id")
    )
    return chart.charts_out_of_scope(charts(spark, sf), views)


@register(
    "g12_global_filters",
    f"""SELECT r_name AS label, {POINT.format('sum(o_totalprice)')} AS value FROM ({BY_REGION_SQL})
    WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND o_totalprice BETWEEN 50000 AND 250000 GROUP BY 1""",
)
def g12(spark, sf):
    filters = [
        {"field": "c_mktsegment", "type": "multi_select", "value": ["BUILDING", "MACHINERY"]},
        {"field": "o_totalprice", "type": "range", "value": [50000, 250000]},
        {"field": "not_in_this_view", "type": "range", "value": [0, 1]},
    ]
    return chart.aggregate(chart.apply_filters(by_region(spark, sf), filters), "r_name", "o_totalprice", "sum")


@register(
    "g12_fraction_range",
    """SELECT l_returnflag AS label, count(*)::DOUBLE AS value FROM lineitem WHERE l_linenumber BETWEEN 1.5 AND 3.5 GROUP BY 1""",
)
def g12_fraction(spark, sf):
    df = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_linenumber").cast("long").alias("l_linenumber"))
    kept = chart.apply_filters(df, [{"field": "l_linenumber", "type": "range", "value": [1.5, 3.5]}])
    return chart.aggregate(kept, "l_returnflag", None, "count")


@register("g13_metric_card", f"SELECT {POINT.format('sum(o_totalprice) / count(*)')} AS value FROM orders")
def g13(spark, sf):
    return chart.metric_card(table(spark, sf, "orders"), "o_totalprice", "avg")
