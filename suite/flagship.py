"""The whole data path in one query: join, recipe, SQL, chart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom import ROW_ID, Scope, Step, chart, recipe

from .registry import dataset, register, table

# Repeats go before the joins, while the rows are narrow.
STEPS = [
    Step("blank_to_null", 0, {"field": "o_orderpriority"}),
    Step("deduplicate", 1, {"fields": ["o_orderkey"]}),
    Step("join", 2, {"table": "customer", "on": [{"left": "o_custkey", "right": "c_custkey"}]}),
    Step("join", 3, {"table": "nation", "on": [{"left": "c_nationkey", "right": "n_nationkey"}]}),
    Step("join", 4, {"table": "region", "on": [{"left": "n_regionkey", "right": "r_regionkey"}]}),
    Step("fill_null", 5, {"field": "c_mktsegment", "value": "UNKNOWN"}),
    Step("rename_field", 6, {"source_field": "r_name", "target_field": "region"}),
]

REVENUE = """SELECT region, c_mktsegment AS segment, COUNT(*) AS order_count, SUM(o_totalprice) AS revenue,
    AVG(o_totalprice) AS avg_price FROM dataset_orders GROUP BY region, c_mktsegment"""


def orders_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {
        "customer": ["c_custkey", "c_nationkey", "c_mktsegment"],
        "nation": ["n_nationkey", "n_regionkey"],
        "region": ["r_regionkey", "r_name"],
    }
    scope = {name: table(spark, sf_dir, name).select(*kept) for name, kept in columns.items()}
    orders = dataset(spark, sf_dir, "orders").select(ROW_ID, "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    return recipe.apply_steps(orders, STEPS, scope)


@register(
    "flagship_regional_revenue_chart",
    """SELECT r_name AS label, floor(sum(o_totalprice) * 100 + 0.5) / 100 AS value FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""",
)
def regional_revenue_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = Scope(spark, {"dataset_orders": orders_by_region(spark, sf_dir)}).query(REVENUE)
    return chart.aggregate(view, "region", "revenue", "sum")
