import pytest
from conftest import code_of
from pyspark.sql import functions as F

from gridloom import ROW_ID, Field, Step, lineage, quantiles, recipe, tables
from gridloom.types import fields_of


@pytest.fixture(scope="module")
def dirty(spark):
    rows = [(1, "Ann", "", 10.0), (2, "Ann", None, 10.0), (3, "Bo", "south", 5.0)]
    return spark.createDataFrame(rows, f"{ROW_ID} long, customer string, region string, amount double")


RECIPE = [
    Step("rename_field", 3, {"source_field": "customer", "target_field": "buyer"}),
    Step("fill_null", 1, {"field": "region", "value": "unknown"}),
    Step("deduplicate", 2, {"fields": ["customer", "region", "amount"]}),
]


def test_fill_deduplicate_rename(dirty):
    rows = recipe.preview(dirty, RECIPE).collect()
    assert [tuple(r) for r in rows] == [(1, "Ann", "unknown", 10.0), (3, "Bo", "south", 5.0)]


def test_execute_numbers_anew_and_keeps_declared_fields(dirty, folder):
    out, count = recipe.execute(dirty, RECIPE, folder("clean"))
    assert count == 2 and out.columns == [ROW_ID, "buyer", "region", "amount"]
    assert [r[0] for r in out.orderBy(ROW_ID).collect()] == [1, 2]
    assert [(f.name, f.nullable) for f in fields_of(out)] == [("buyer", True), ("region", False), ("amount", True)]


def test_execution_leaves_two_edges():
    edges = recipe.execution_edges("p", "rec_1", "dataset_1", "dataset_2")
    assert [(e.source_type, e.target_id) for e in edges] == [("dataset", "dataset_2"), ("cleaning_recipe", "dataset_2")]
    assert recipe.creation_edge("p", "rec_1", "dataset_1").target_type == "cleaning_recipe"


@pytest.mark.parametrize(
    ("operation", "config"),
    [
        ("rename_field", {"source_field": "absent", "target_field": "x"}),
        ("rename_field", {"source_field": "region", "target_field": " "}),
        ("rename_field", {"source_field": "region", "target_field": "amount"}),
        ("rename_field", {"source_field": "region", "target_field": ROW_ID}),
        ("fill_null", {"field": "region"}),
        ("fill_null", {"field": "amount", "value": "many"}),
        ("drop_null_rows", {"fields": []}),
        ("drop_null_rows", {"fields": ["region", ""]}),
        ("deduplicate", {"fields": "region"}),
        ("deduplicate", {"fields": ["absent"]}),
        ("convert_type", {"field": "amount", "type": "money"}),
        ("filter_rows", {"condition": {"field": "absent", "op": "=", "value": 1}}),
        ("filter_rows", {"condition": {"field": "amount", "op": "~", "value": 1}}),
        ("calculate", {"target": "x", "expression": "absent + 1"}),
        ("aggregate", {"group_by": ["region"], "aggregations": [{"function": "median", "field": "amount", "name": "m"}]}),
        ("join", {"table": "absent", "on": [{"left": "region", "right": "region"}]}),
        ("batch", {"fields": ["region"], "step": {"operation": "sort"}}),
        ("shuffle_rows", {}),
    ],
)
def test_bad_steps_are_refused(dirty, operation, config):
    assert code_of(recipe.validate, [Step(operation, 0, config)], dirty.schema) == "invalid_cleaning_step"


def test_steps_see_the_names_left_by_earlier_steps(dirty):
    steps = [
        Step("rename_field", 0, {"source_field": "region", "target_field": "area"}),
        Step("fill_null", 1, {"field": "region", "value": "x"}),
    ]
    assert code_of(recipe.validate, steps, dirty.schema) == "invalid_cleaning_step"
    steps[1] = Step("fill_null", 1, {"field": "area", "value": "x"})
    recipe.validate(steps, dirty.schema)


def test_expression_cannot_reach_outside(dirty):
    step = Step("calculate", 0, {"target": "x", "expression": "reflect('java.lang.System', 'getProperty', 'user.home')"})
    assert code_of(recipe.validate, [step], dirty.schema) == "sql_forbidden_operation"


def test_deduplicate_edges(spark):
    nan = float("nan")
    rows = [(1, None, nan), (2, "", nan), (3, None, nan), (4, "a", 0.0), (5, "a", -0.0), (6, "", nan)]
    df = spark.createDataFrame(rows, f"{ROW_ID} long, k string, v double").repartition(4)
    out = recipe.apply_steps(df, [Step("deduplicate", 0, {"fields": ["k", "v"]})])
    assert sorted(r[0] for r in out.collect()) == [1, 2, 4]


def test_hot_key_is_cut_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") + 1).alias(ROW_ID), F.when(F.col("id") < 999, "hot").otherwise("cold").alias("k"))
    out = recipe.apply_steps(df, [Step("deduplicate", 0, {"fields": ["k"]})])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")
    assert sorted(tuple(r) for r in out.collect()) == [(1, "hot"), (1000, "cold")]


def test_convert_type_fails_or_gives_null(spark):
    df = spark.createDataFrame([(1, " 12 "), (2, "x")], f"{ROW_ID} long, v string")
    strict = recipe.apply_steps(df, [Step("convert_type", 0, {"field": "v", "type": "integer"})])
    with pytest.raises(Exception, match="invalid_field_value"):
        strict.collect()
    lenient = recipe.apply_steps(df, [Step("convert_type", 0, {"field": "v", "type": "integer", "on_error": "null"})])
    assert [r.v for r in lenient.orderBy(ROW_ID).collect()] == [12, None]


def test_split_takes_separators_as_text(spark):
    df = spark.createDataFrame([("a.b.c",), ("a",)], "v string")
    out = recipe.apply_steps(df, [Step("split_field", 0, {"field": "v", "separator": ".", "targets": ["x", "y"]})])
    assert [tuple(r)[1:] for r in out.collect()] == [("a", "b"), ("a", None)]


def test_sorted_recipe_numbers_in_sorted_order(spark, folder):
    df = spark.createDataFrame([(1, 5), (2, 9), (3, 7)], f"{ROW_ID} long, v long")
    out, _ = recipe.execute(df, [Step("sort", 0, {"by": [{"field": "v", "direction": "desc"}]})], folder("sorted"))
    assert [tuple(r) for r in out.orderBy(ROW_ID).collect()] == [(1, 9), (2, 7), (3, 5)]


def test_joined_recipe_numbers_rows_anew(spark, folder):
    left = spark.createDataFrame([(1, "a"), (2, "b")], f"{ROW_ID} long, k string")
    right = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v long")
    step = Step("join", 0, {"table": "r", "on": [{"left": "k", "right": "k"}]})
    out, count = recipe.execute(left, [step], folder("joined"), {"r": right})
    assert count == 3 and [tuple(r) for r in out.orderBy(ROW_ID).collect()] == [(1, "a", 1), (2, "a", 2), (3, "b", 3)]


def test_aggregate_recipe_is_numbered_by_its_groups(spark, folder):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b")], f"{ROW_ID} long, k string")
    spec = {"group_by": ["k"], "aggregations": [{"function": "count", "name": "n"}]}
    out, _ = recipe.execute(df, [Step("aggregate", 0, spec)], folder("agg"))
    assert [tuple(r) for r in out.orderBy(ROW_ID).collect()] == [(1, "a", 1), (2, "b", 2)]


def test_exact_quantiles_of_a_skewed_table(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    data = [("hot", float(v)) for v in rng.integers(0, 40, 4000)] + [("cold", float(v)) for v in rng.normal(size=37)]
    data += [("one", 4.0), (None, 2.0), (None, 8.0), ("gone", None)]
    df = spark.createDataFrame(data, "g string, v double").repartition(6)
    probabilities = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r[0]: list(r)[1:] for r in quantiles.exact(df, ["g"], "v", probabilities).collect()}
    groups: dict = {}
    for g, v in data:
        if v is not None:
            groups.setdefault(g, []).append(v)
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert got[g] == pytest.approx(list(np.quantile(values, probabilities)))
    whole = quantiles.exact(df, [], "v", [0.5]).first()
    assert whole.q0 == pytest.approx(np.median([v for _, v in data if v is not None]))


def test_brackets_are_narrowed_and_exact(spark):
    """A coarse sketch and small brackets: groups far larger than both, with ties, infinities and NaN."""
    import numpy as np

    rng = np.random.default_rng(3)
    data = [("a", float(v)) for v in rng.normal(size=20_000)] + [("ties", float(v)) for v in rng.integers(0, 3, 9000)]
    data += [("nan", v) for v in [float("nan")] * 300 + [float("inf")] * 200 + [1.0] * 500]
    df = spark.createDataFrame(data, "g string, v double").repartition(4)
    probabilities = [0.0, 0.01, 0.25, 0.333, 0.5, 0.75, 0.999, 1.0]
    for few in (False, True):
        found = quantiles.exact(df, ["g"], "v", probabilities, few_groups=few, accuracy=200, bracket_rows=50)
        got = {r[0]: list(r)[1:] for r in found.collect()}
        for g in ("a", "ties"):
            assert got[g] == pytest.approx(list(np.quantile([v for k, v in data if k == g], probabilities)), abs=1e-12)
        assert got["nan"][:3] == [1.0, 1.0, 1.0] and got["nan"][4] == float("inf") and all(np.isnan(got["nan"][5:]))


def test_quantiles_start_no_job_and_sort_nothing(spark):
    df = spark.range(1000).selectExpr("id % 3 AS g", "CAST(id AS DOUBLE) AS v")
    tracker, group = spark.sparkContext.statusTracker(), "quantiles-laziness"
    spark.sparkContext.setJobGroup(group, "")
    try:
        flagged = recipe.apply_steps(df, [Step("flag_outliers", 0, {"field": "v", "method": "iqr", "group_by": ["g"], "target": "far"})])
        assert not tracker.getJobIdsForGroup(group)
        assert "rangepartitioning" not in flagged._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_lineage_trace_ends_on_cycles(spark):
    steps = [("a", "b"), ("b", "c"), ("c", "a"), ("b", "d"), ("x", "d")]
    edges = lineage.edges(spark, [lineage.Edge("p", "t", s, "t", t) for s, t in steps])
    down = {r.node_id: r.depth for r in lineage.trace(edges, [("t", "a")]).collect()}
    assert down == {"a": 0, "b": 1, "c": 2, "d": 2}
    up = {r.node_id: r.depth for r in lineage.trace(edges, [("t", "d")], "upstream").collect()}
    assert up == {"d": 0, "b": 1, "x": 1, "a": 2, "c": 3}
    assert code_of(lineage.trace, edges, [("t", "a")], "sideways") == "invalid_lineage_direction"


def test_view_rows_with_declared_fields(spark, folder):
    from gridloom.plans.catalog import view_schema

    declared = [Field("region", "text", False, 0), Field("revenue", "decimal", True, 1)]
    rows = spark.createDataFrame([("n", 1.0), ("s", None)], view_schema(declared))
    out, count = tables.write(rows, folder("rows"), kind="data_view")
    assert count == 2 and fields_of(out) == declared
