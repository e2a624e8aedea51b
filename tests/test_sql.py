import pytest
from conftest import code_of

from gridloom import ROW_ID, Scope, guard


@pytest.mark.parametrize(
    ("sql", "code"),
    [
        ("", "sql_empty"),
        ("  -- nothing\n /* here */ ;", "sql_empty"),
        ("SELECT 1; SELECT 2", "sql_multiple_statements"),
        ("SHOW TABLES", "sql_not_read_only"),
        ("selection", "sql_not_read_only"),
        ("DELETE FROM dataset_a", "sql_not_read_only"),
        ("WITH x AS (SELECT 1) INSERT INTO dataset_a SELECT * FROM x", "sql_forbidden_operation"),
        ("SELECT 1 /* hidden */ UNION SELECT drop", "sql_forbidden_operation"),
        ("SELECT reflect('java.lang.Math', 'abs', -1)", "sql_forbidden_operation"),
        ("SELECT `java_method`('java.lang.Math', 'abs', -1)", "sql_forbidden_operation"),
        ("SELECT try_reflect /* x */ ('java.lang.Math', 'abs', -1)", "sql_forbidden_operation"),
    ],
)
def test_refused(sql, code):
    assert code_of(guard.validate, sql) == code


def test_length_is_free_unless_asked():
    sql = "SELECT '" + "x" * 20_000 + "'"
    guard.validate(sql)
    assert code_of(guard.validate, sql, 1000) == "sql_too_long"


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT 'insert; drop -- table' AS t",
        "select `delete` from dataset_a",
        "WITH a AS (SELECT 1 AS x) SELECT x FROM a;",
        "SELECT 'it''s; fine' /* ; */ AS t -- ; update",
        "SELECT created_at, updated FROM dataset_a",
        "SELECT 'reflect(' AS t",
    ],
)
def test_admitted(sql):
    guard.validate(sql)


@pytest.fixture(scope="module")
def scope(spark):
    rows = [(1, "Ann", 10.0, "north"), (2, "Bo", 20.0, "south")]
    orders = spark.createDataFrame(rows, f"{ROW_ID} long, customer string, amount double, region string")
    return Scope(spark, {"dataset_orders": orders, "dataset_big": spark.range(700)})


def test_run_filters_and_hides_row_ids(scope):
    out = scope.run("SELECT * FROM dataset_orders WHERE region = 'north' -- only one")
    assert out.columns == ["customer", "amount", "region"] and [tuple(r) for r in out.collect()] == [("Ann", 10.0, "north")]


def test_row_ids_can_be_used_inside(scope):
    assert [r.customer for r in scope.run(f"SELECT customer FROM dataset_orders ORDER BY {ROW_ID} DESC").collect()] == ["Bo", "Ann"]


def test_caps_and_order(scope):
    assert scope.run("SELECT id FROM dataset_big ORDER BY id DESC").collect()[0].id == 699
    assert scope.run("SELECT id FROM dataset_big").count() == 700
    assert scope.run("SELECT id FROM dataset_big", limit=100).count() == 100


def test_scope_is_closed(spark, scope, folder):
    spark.range(3).createOrReplaceTempView("outside")
    spark.range(3).createOrReplaceGlobalTempView("shared")
    spark.range(3).write.parquet(folder("file"))
    assert code_of(scope.query, "SELECT * FROM dataset_other") == "sql_unknown_dataset"
    assert code_of(scope.query, "SELECT * FROM outside") == "sql_unknown_dataset"
    assert code_of(scope.query, "SELECT * FROM global_temp.shared") == "sql_unknown_dataset"
    assert code_of(scope.query, "SELECT * FROM `global_temp`.`shared`") == "sql_unknown_dataset"
    assert code_of(scope.query, f"SELECT * FROM parquet.`{folder('file')}`") in ("sql_unknown_dataset", "sql_invalid")
    assert code_of(scope.query, "SELECT absent FROM dataset_orders") == "sql_invalid"
    assert code_of(scope.query, "SELECT FROM WHERE") == "sql_invalid"
    assert code_of(Scope, spark, {}) == "sql_no_project_datasets"


def test_stored_tables_are_outside(spark, scope, folder):
    spark.sql(f"CREATE TABLE stored_one (id BIGINT) USING parquet LOCATION '{folder('stored')}'")
    try:
        assert code_of(scope.query, "SELECT * FROM stored_one") == "sql_unknown_dataset"
        assert code_of(scope.query, "SELECT * FROM default.stored_one") == "sql_unknown_dataset"
        assert code_of(scope.query, "SELECT * FROM spark_catalog.default.stored_one") == "sql_unknown_dataset"
    finally:
        spark.sql("DROP TABLE stored_one")


def test_columns_may_be_named_like_stored_tables(spark, scope, folder):
    spark.sql(f"CREATE TABLE region (id BIGINT) USING parquet LOCATION '{folder('named')}'")
    try:
        assert scope.query("SELECT region FROM dataset_orders").count() == 2
        assert scope.query("WITH region AS (SELECT 1 AS x), y AS (SELECT * FROM region) SELECT * FROM y, region").count() == 1
        assert code_of(scope.query, "SELECT (SELECT count(*) FROM region) AS n FROM dataset_orders") == "sql_unknown_dataset"
        assert code_of(scope.query, "WITH a AS (SELECT * FROM other.db.t) SELECT * FROM a") == "sql_unknown_dataset"
    finally:
        spark.sql("DROP TABLE region")


def test_settings_are_carried_over(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    try:
        spark.conf.set(key, "-1")
        assert Scope(spark, {"dataset_a": spark.range(1)})._session.conf.get(key) == "-1"
    finally:
        spark.conf.set(key, old)


def test_scopes_do_not_see_each_other(spark):
    first, second = Scope(spark, {"dataset_a": spark.range(1)}), Scope(spark, {"dataset_b": spark.range(2)})
    assert first.query("SELECT * FROM dataset_a").count() == 1
    assert code_of(second.query, "SELECT * FROM dataset_a") == "sql_unknown_dataset"


def test_save(scope, folder):
    out, count = scope.save("SELECT customer, amount FROM dataset_orders ORDER BY amount DESC", folder("view"))
    assert count == 2 and [tuple(r) for r in out.orderBy(ROW_ID).collect()] == [(1, "Bo", 20.0), (2, "Ann", 10.0)]
    assert code_of(scope.save, "SELECT 1 AS a, 2 AS a", folder("twice")) == "duplicate_data_view_fields"
    assert code_of(scope.save, "SELECT 1 AS a", folder("view")) == "physical_table_exists"


def test_metadata(scope):
    rows = scope.metadata({"dataset_orders": 2}).filter("table_alias = 'dataset_orders'").collect()
    assert [(r.field_name, r.inferred_type, r.row_count) for r in rows] == [
        ("customer", "text", 2), ("amount", "decimal", 2), ("region", "text", 2),
    ]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """A stored table and a stored view beside the scope."""
    path = str(tmp_path_factory.mktemp("stored") / "secret")
    spark.range(3).write.parquet(path)
    spark.sql(f"CREATE TABLE secret USING parquet LOCATION '{path}'")
    spark.sql("CREATE VIEW secret_view AS SELECT * FROM secret")
    yield "secret"
    spark.sql("DROP VIEW secret_view")
    spark.sql("DROP TABLE secret")


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT * FROM secret",
        "SELECT * FROM secret_view",
        "SELECT * FROM default.secret",
        "SELECT * FROM spark_catalog.default.secret",
        "WITH secret AS (SELECT * FROM secret) SELECT * FROM secret",
        "SELECT * FROM secret WHERE EXISTS (WITH secret AS (SELECT 1 AS k) SELECT * FROM secret)",
        "SELECT * FROM dataset_orders WHERE 1 IN (SELECT id FROM secret)",
        "SELECT (SELECT max(id) FROM secret) AS m",
        "SELECT * FROM dataset_orders, LATERAL (SELECT id FROM secret WHERE id > amount)",
        "WITH a AS (SELECT 1 AS x), b AS (SELECT * FROM secret) SELECT * FROM a",
    ],
)
def test_stored_tables_stay_outside(scope, stored, sql):
    assert code_of(scope.query, sql) == "sql_unknown_dataset"


@pytest.mark.parametrize(
    ("sql", "rows"),
    [
        ("WITH secret AS (SELECT 1 AS k) SELECT * FROM secret", 1),
        ("WITH `odd name` (k) AS (SELECT 1) SELECT * FROM `odd name` WHERE EXISTS (WITH x AS (SELECT 1) SELECT * FROM x)", 1),
        ("SELECT * FROM VALUES (1), (2) AS t(v) JOIN range(2) ON v > id", 3),
        ("WITH RECURSIVE r AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM r WHERE n < 3) SELECT * FROM r", 3),
        ("SELECT customer FROM dataset_orders WHERE amount = (SELECT max(amount) FROM dataset_orders)", 1),
    ],
)
def test_own_names_are_free(scope, stored, sql, rows):
    assert scope.run(sql).count() == rows


def test_views_over_stored_tables_may_be_given(spark, stored):
    assert Scope(spark, {"dataset_given": spark.table(stored)}).run("SELECT * FROM dataset_given").count() == 3
