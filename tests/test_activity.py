from pyspark.sql import functions as F

from gridloom import activity, lineage
from gridloom.functions import names


def test_summaries(spark):
    tasks = spark.createDataFrame(
        [(s, t) for s, t in (("success", "a"), ("running", "a"), ("pending", "b"), ("failed", "a"), ("retryable", "b"), ("other", "b"))],
        "status string, task_type string",
    )
    assert activity.task_summary(tasks).first().asDict() == {"total": 6, "success": 1, "running": 2, "failed": 1, "retryable": 1}
    assert {r.task_type: r["count"] for r in activity.task_types(tasks).collect()} == {"a": 3, "b": 3}
    uploads = spark.createDataFrame([("parsed",), ("failed",), ("pending",)], "status string")
    assert activity.upload_summary(uploads).first().asDict() == {"total": 3, "parsed": 1, "failed": 1}


def test_import_history_takes_only_members_of_the_right_type(spark):
    rows = [
        ("1", "external_sql_import", '{"connection_id": "c", "sql": "SELECT 1", "limit": 5, "fields": [{"name": "a"}, {"name": "b"}]}'),
        ("2", "external_table_import", '{"connection_id": 7, "table_name": "t", "limit": "5", "fields": []}'),
        ("3", "external_table_import", None),
        ("4", "external_table_import", "not json"),
        ("5", "file_import", '{"sql": "x"}'),
        ("6", "external_sql_import", '{"fields": [1, {"name": "a"}], "dataset_name": "d", "schema_name": "s"}'),
        ("7", "external_sql_import", '{"fields": {"name": "a"}, "limit": 2.5}'),
    ]
    df = spark.createDataFrame(rows, "id string, task_type string, retry_payload string")
    got = {r.id: r for r in activity.import_history(df).collect()}
    assert set(got) == {"1", "2", "3", "4", "6", "7"}
    one, two, six = got["1"], got["2"], got["6"]
    assert (one.source_type, one.connection_id, one.sql, one.limit, one.field_count) == ("external_sql", "c", "SELECT 1", 5, 2)
    assert (two.source_type, two.connection_id, two.table_name, two.limit, two.field_count) == ("external_table", None, "t", None, None)
    assert (six.field_count, six.dataset_name, six.schema_name) == (1, "d", "s")
    for r in (got["3"], got["4"], got["7"]):
        assert r.limit is None and r.field_count is None and r.sql is None


def test_query_history(spark):
    df = spark.createDataFrame([("p", 'SELECT "a"\n', 3)], "project_id string, q string, n int")
    logged = activity.log_query(df, F.col("q"), F.col("n")).drop("q", "n")
    assert [tuple(r) for r in activity.query_history(logged).collect()] == [("p", 'SELECT "a"\n', 3)]


def test_stable_references(spark):
    long_id = "x" * 129
    rows = [("sql_query", None, "SELECT 1", "v"), ("dataset", "d1", None, "v"), ("web-page!", long_id, None, "v"), ("dataset", None, None, "v"), ("!!", long_id, None, "v")]
    df = spark.createDataFrame(rows, "source_type string, source_id string, source_sql string, view_id string")
    got = [r[0] for r in df.select(names.view_source_id(*[F.col(c) for c in df.columns])).collect()]
    import hashlib

    digest = hashlib.sha256(long_id.encode()).hexdigest()[:24]
    assert got == [f"sql_query_{hashlib.sha256(b'SELECT 1').hexdigest()[:24]}", "d1", f"web_page_{digest}", "v", f"source_{digest}"]


def test_a_long_chain_with_cycles_and_a_hub(spark):
    """Twenty levels, a way back from every fourth node, and a hub whose neighbours lie in parts."""
    chain = [lineage.Edge("p", "n", str(i), "n", str(i + 1)) for i in range(20)]
    back = [lineage.Edge("p", "n", str(i), "n", "0") for i in range(0, 20, 4)]
    hub = [lineage.Edge("p", "n", "20", "leaf", str(i)) for i in range(200)]
    edges = lineage.edges(spark, chain + back + hub + chain)
    for hub_links in (lineage.HUB_LINKS, 30):
        got = {(r.node_type, r.node_id): r.depth for r in lineage.trace(edges, [("n", "0")], hub_links=hub_links).collect()}
        assert got == {("n", str(i)): i for i in range(21)} | {("leaf", str(i)): 21 for i in range(200)}
    up = {(r.node_type, r.node_id): r.depth for r in lineage.trace(edges, [("leaf", "7")], "upstream").collect()}
    assert up == {("leaf", "7"): 0} | {("n", str(i)): 21 - i for i in range(21)}


def test_a_level_moves_no_edges(spark):
    edges = lineage.edges(spark, [lineage.Edge("p", "n", str(i), "n", str(i + 1)) for i in range(50)])
    links = lineage.Adjacency(edges, "downstream")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        nodes = spark.createDataFrame([("n", "3"), ("n", "8")], "node_type string, node_id string")
        plan = links.step(nodes)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    scan = plan[:plan.index(links.table)]
    assert "SortMergeJoin" in scan and "Exchange" not in scan[scan.rindex("SortMergeJoin"):]
    assert sorted(r.node_id for r in links.step(nodes).collect()) == ["4", "9"]
    links.drop()
    assert not spark.catalog.tableExists(links.table)
