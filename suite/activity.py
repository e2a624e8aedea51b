"""Lineage and activity tables, derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom import Scope, Step, Workspace, activity, lineage
from gridloom.plans.scope import view_edges
from gridloom.session import fresh_path

from .registry import register, table


def _id(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column))


# Orders are files, customers datasets, nations views, regions dashboards; regions feed back into the
# orders of their own number, which closes a cycle.
EDGES_SQL = """SELECT 'prj' AS project_id, 'file' AS source_type, 'o' || o_orderkey AS source_id, 'dataset' AS target_type,
    'c' || o_custkey AS target_id, 'dataset_creation' AS transform_type, 'c' || o_custkey AS transform_id FROM orders
    UNION ALL SELECT 'prj', 'dataset', 'c' || c_custkey, 'data_view', 'n' || c_nationkey, 'dataset_materialization', 'n' || c_nationkey FROM customer
    UNION ALL SELECT 'prj', 'data_view', 'n' || n_nationkey, 'dashboard', 'r' || n_regionkey, 'dashboard_layout', 'r' || n_regionkey FROM nation
    UNION ALL SELECT 'prj', 'dashboard', 'r' || r_regionkey, 'file', 'o' || r_regionkey, NULL, NULL FROM region"""


def edges(spark, sf):
    def of(name, source, target, kind):
        return lineage.edge_table(
            table(spark, sf, name), project_id="prj", source=source, target=target,
            transform=(kind, target[1]) if kind else (None, None),
        )

    return (
        of("orders", ("file", _id("o", "o_orderkey")), ("dataset", _id("c", "o_custkey")), "dataset_creation")
        .unionByName(of("customer", ("dataset", _id("c", "c_custkey")), ("data_view", _id("n", "c_nationkey")), "dataset_materialization"))
        .unionByName(of("nation", ("data_view", _id("n", "n_nationkey")), ("dashboard", _id("r", "n_regionkey")), "dashboard_layout"))
        .unionByName(of("region", ("dashboard", _id("r", "r_regionkey")), ("file", _id("o", "r_regionkey")), None))
    )


@register("h1_lineage_edges", EDGES_SQL)
def h1(spark, sf):
    """Edges appended in two goes, read back from the edge table."""
    path, found = fresh_path(spark, "edges"), edges(spark, sf)
    lineage.append(found.filter("source_type = 'file'"), path)
    lineage.append(found.filter("source_type <> 'file'"), path)
    return spark.read.schema(lineage.EDGE_SCHEMA).parquet(path)


@register(
    "h1_view_edges",
    """SELECT 'prj' AS project_id, 'sql_query' AS source_type, 'sql_query_' || substr(sha256(text), 1, 24) AS source_id,
    'data_view' AS target_type, 'view_' || item_id AS target_id, 'sql_query_materialization' AS transform_type,
    'view_' || item_id AS transform_id FROM benchmark""",
)
def h1_views(spark, sf):
    return view_edges(table(spark, sf, "benchmark").select(
        F.lit("prj").alias("project_id"), _id("view_", "item_id").alias("view_id"), F.lit("sql_query").alias("source_type"),
        F.lit(None).cast("string").alias("source_id"), F.col("text").alias("source_sql"),
    ))


def trace_sql(here: str, there: str, start: str) -> str:
    return f"""WITH RECURSIVE e AS ({EDGES_SQL}),
    walk(node_type, node_id) AS (SELECT '{start.split(':')[0]}', '{start.split(':')[1]}' UNION
        SELECT e.{there}_type, e.{there}_id FROM walk JOIN e ON e.{here}_type = walk.node_type AND e.{here}_id = walk.node_id)
    SELECT node_type, node_id FROM walk"""


@register("h2_trace_downstream", trace_sql("source", "target", "dataset:c7"))
def h2_down(spark, sf):
    return lineage.trace(edges(spark, sf), [("dataset", "c7")], "downstream").drop("depth")


@register("h2_trace_upstream", trace_sql("target", "source", "dashboard:r2"))
def h2_up(spark, sf):
    return lineage.trace(edges(spark, sf), [("dashboard", "r2")], "upstream").drop("depth")


TASKS_SQL = """SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'success' WHEN 'view' THEN 'running' WHEN 'signup' THEN 'pending'
    WHEN 'error' THEN 'failed' ELSE 'retryable' END AS status,
    CASE event_type WHEN 'click' THEN 'external_sql_import' WHEN 'view' THEN 'external_table_import' ELSE 'file_import' END AS task_type
    FROM events"""


def tasks(spark, sf):
    kind = F.col("event_type")
    status = (
        F.when(kind == "click", "success").when(kind == "view", "running").when(kind == "signup", "pending")
        .when(kind == "error", "failed").otherwise("retryable")
    )
    task_type = F.when(kind == "click", "external_sql_import").when(kind == "view", "external_table_import").otherwise("file_import")
    payload = F.to_json(F.struct(
        F.concat(F.lit("conn_"), F.col("user_id")).alias("connection_id"),
        F.when(kind == "click", F.col("props")).alias("sql"),
        F.when(kind == "view", F.col("user_id")).alias("table_name"),  # a number: wrong type for a name
        F.col("event_id").alias("limit"),
        F.when(kind == "click", F.array(F.struct(F.lit("a").alias("name")), F.struct(F.lit("b").alias("name")))).alias("fields"),
    ))
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), status.alias("status"), task_type.alias("task_type"), payload.alias("retry_payload")
    )


@register(
    "h3_task_summary",
    f"""SELECT count(*) AS total, count(*) FILTER (WHERE status = 'success') AS success,
    count(*) FILTER (WHERE status IN ('running', 'pending')) AS running, count(*) FILTER (WHERE status = 'failed') AS failed,
    count(*) FILTER (WHERE status = 'retryable') AS retryable FROM ({TASKS_SQL})""",
)
def h3(spark, sf):
    return activity.task_summary(tasks(spark, sf))


@register("h3_task_types", f"SELECT task_type, count(*) AS count FROM ({TASKS_SQL}) GROUP BY 1")
def h3_types(spark, sf):
    return activity.task_types(tasks(spark, sf))


@register(
    "h4_upload_summary",
    """SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS parsed,
    count(*) FILTER (WHERE o_orderstatus = 'P') AS failed FROM orders""",
)
def h4(spark, sf):
    state = F.when(F.col("o_orderstatus") == "F", "parsed").when(F.col("o_orderstatus") == "P", "failed").otherwise("pending")
    return activity.upload_summary(table(spark, sf, "orders").select(state.alias("status")))


@register(
    "h5_import_history",
    """SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'success' ELSE 'running' END AS status,
    CASE event_type WHEN 'click' THEN 'external_sql_import' ELSE 'external_table_import' END AS task_type,
    CASE event_type WHEN 'click' THEN 'external_sql' ELSE 'external_table' END AS source_type, 'conn_' || user_id AS connection_id,
    CAST(NULL AS VARCHAR) AS dataset_name, CAST(NULL AS VARCHAR) AS schema_name, CAST(NULL AS VARCHAR) AS table_name,
    CASE event_type WHEN 'click' THEN props END AS sql, event_id AS "limit", CASE event_type WHEN 'click' THEN 2 END AS field_count
    FROM events WHERE event_type IN ('click', 'view')""",
)
def h5(spark, sf):
    return activity.import_history(tasks(spark, sf))


@register("h6_query_history", "SELECT conv_id, turn, text AS sql, length(text) AS row_count FROM conversations WHERE role = 'user'")
def h6(spark, sf):
    """Whole texts logged as queries, read back from the JSON detail."""
    df = table(spark, sf, "conversations")
    users = df.filter("role = 'user'")
    rows = activity.log_query(users, F.col("text"), F.length("text")).select("conv_id", "turn", "action", "detail")
    other = df.filter("role <> 'user'").select("conv_id", "turn", F.lit("chart.created").alias("action"), F.lit("{}").alias("detail"))
    return activity.query_history(rows.unionByName(other))


RUNS = (
    "SELECT o_orderstatus, count(*) AS n FROM dataset_orders GROUP BY 1",
    "SELECT o_orderkey FROM dataset_orders WHERE o_totalprice > 100000",
    "SELECT o_custkey, max(o_totalprice) AS most FROM dataset_large GROUP BY o_custkey",
)


def published(spark, sf) -> Workspace:
    """Orders and a table derived from them by a recipe with a counter, published by commits."""
    ws = Workspace(spark, fresh_path(spark, "workspace"))
    made = lineage.Edge("p1", "external_database_table", "orders", "dataset", "orders", "external_table_import", "orders")
    orders = table(spark, sf, "orders")
    ws.add("p1", "orders", orders, made, asset_id="orders")
    large = {"condition": {"field": "o_totalprice", "op": ">", "value": 50000}}
    ws.execute("p1", "large", "orders", "recipe-1", [Step("filter_rows", 0, large), Step("deduplicate", 1, {"fields": ["o_custkey", "o_orderpriority"]})], asset_id="large")
    return ws


@register(
    "h6_run_log",
    f"""WITH dataset_orders AS (SELECT * FROM orders),
    dataset_large AS (SELECT DISTINCT ON (o_custkey, o_orderpriority) * FROM orders WHERE o_totalprice > 50000 ORDER BY o_custkey, o_orderpriority, o_orderkey)
    {' UNION ALL '.join(f"SELECT '{q}' AS sql, (SELECT count(*) FROM ({q})) AS row_count" for q in RUNS)}""",
)
def h6_log(spark, sf):
    """Executed queries and their row counts, read back from the commit log."""
    ws = published(spark, sf)
    scope = Scope(spark, {"dataset_orders": ws.open("orders"), "dataset_large": ws.open("large")})
    for sql in RUNS:
        ws.run("p1", scope, sql)
    return ws.history("p1").select("sql", "row_count")


@register(
    "c8_execution_edges",
    """SELECT * FROM (VALUES
    ('external_database_table', 'orders', 'dataset', 'orders', 'external_table_import', 'orders', (SELECT count(*) FROM orders)),
    ('dataset', 'orders', 'dataset', 'large', 'cleaning_recipe_execution', 'recipe-1',
     (SELECT count(*) FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_totalprice > 50000))),
    ('cleaning_recipe', 'recipe-1', 'dataset', 'large', 'cleaning_recipe_execution', 'recipe-1',
     (SELECT count(*) FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_totalprice > 50000))))
    t(source_type, source_id, target_type, target_id, transform_type, transform_id, row_count)""",
)
def c8_edges(spark, sf):
    """The edges of published transforms with the row counts of the tables they made, read back from the commit log."""
    ws = published(spark, sf)
    made = ws.commits.tables().select(F.col("id").alias("target_id"), "row_count")
    return ws.commits.edges().drop("project_id").join(made, "target_id")
