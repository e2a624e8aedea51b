import datetime as dt

from pyspark.sql import functions as F

from gridloom import ROW_ID, profile
from gridloom.types import Field, annotate


def by_name(df):
    return {r.name: r for r in df.collect()}


def test_counts_samples_and_warnings(spark):
    rows = [
        (1, "b", 1.0, 5, True, dt.date(2026, 1, 5), dt.datetime(2026, 1, 5, 1, 2, 3, 500000)),
        (2, "", -0.0, 5, None, None, None),
        (3, "a", 0.0, 5, True, dt.date(1969, 12, 31), dt.datetime(1969, 12, 31, 23, 0)),
        (4, None, float("nan"), 5, False, None, None),
        (5, "b", float("nan"), 5, True, None, None),
    ]
    schema = f"{ROW_ID} long, t string, d double, i long, f boolean, day date, at timestamp_ntz"
    df = spark.createDataFrame(rows, schema).repartition(3)
    df = annotate(df, [Field("t", "text", False, 0)])
    got = by_name(profile.fields(df))
    t = got["t"]
    assert (t.row_count, t.null_count, t.null_ratio, t.distinct_count, t.duplicate_count) == (5, 2, 0.4, 2, 1)
    assert t.sample_values == ["b", "a"] and t.warnings == ["unexpected_nulls"]
    assert got["d"].distinct_count == 3 and got["d"].sample_values[0] == "1.0"
    assert got["i"].warnings == ["single_distinct_value"] and got["i"].sample_values == ["5"]
    assert got["f"].sample_values == ["True", "False"]
    assert got["day"].sample_values == ["2026-01-05", "1969-12-31"] and got["day"].warnings == ["high_null_ratio"]
    assert got["at"].sample_values == ["2026-01-05T01:02:03.5", "1969-12-31T23:00:00"]


def test_only_five_samples_in_first_seen_order(spark):
    df = spark.range(1, 1001).select(F.col("id").alias(ROW_ID), (F.lit(1000) - F.col("id")).alias("v")).repartition(5)
    row = profile.fields(df).first()
    assert row.sample_values == ["999", "998", "997", "996", "995"] and row.distinct_count == 1000


def test_empty_table(spark):
    df = spark.createDataFrame([], f"{ROW_ID} long, a string, b double")
    assert [(r.row_count, r.null_ratio, r.warnings) for r in profile.fields(df).collect()] == [(0, 0.0, ["empty_dataset"])] * 2
    whole = profile.dataset(df).first()
    assert (whole.row_count, whole.field_count, whole.null_cell_ratio, whole.duplicate_row_count) == (0, 2, 0.0, 0)
    assert whole.warnings == ["empty_dataset"]


def test_dataset_roll_up(spark):
    rows = [(1, "a", None), (2, "a", None), (3, "b", None), (4, "a", "x"), (5, None, None), (6, None, None)]
    got = profile.dataset(spark.createDataFrame(rows, f"{ROW_ID} long, a string, b string")).first()
    assert (got.row_count, got.null_cell_count, got.null_cell_ratio, got.duplicate_row_count) == (6, 7, 0.5833, 2)
    assert got.warnings == ["duplicate_rows_detected", "high_null_fields_detected"]


def test_groups_are_shuffled_once(spark):
    df = spark.range(1, 100).select(F.col("id").alias(ROW_ID), (F.col("id") % 7).alias("v"))
    result = profile.fields(df)
    result.collect()
    final = result._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("functions=[partial_count(1), partial_min(r") == 1 and "ReusedExchange" in final


def test_texts_are_not_shuffled(spark):
    rows = [(1, "long text " * 50, None), (2, "", "x"), (3, "long text " * 50, "x"), (4, "other", "")]
    result = profile.fields(spark.createDataFrame(rows, f"{ROW_ID} long, a string, b string"))
    got = {r.name: (r.null_count, r.distinct_count, r.sample_values) for r in result.collect()}
    assert got == {"a": (1, 2, ["long text " * 50, "other"]), "b": (2, 1, ["x"])}
    plan = result._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "hashpartitioning(field" in plan and "value#" not in "".join(x for x in plan.splitlines() if "hashpartitioning" in x)


def test_approximate_profile_and_summary(spark):
    df = spark.range(1, 501).select(F.col("id").alias(ROW_ID), (F.col("id") % 10).alias("v"), F.lit(None).cast("double").alias("n"))
    got = by_name(profile.fields(df, approximate=True))
    assert got["v"].distinct_count == 10 and got["n"].null_ratio == 1.0
    stats = by_name(profile.summary(df))
    assert (stats["v"]["count"], stats["v"].min, stats["v"].max, stats["v"].mean, stats["v"].median) == (500, 0.0, 9.0, 4.5, 4.5)
    assert stats["n"]["count"] == 0 and stats["n"].median is None


def test_merged_states_equal_one_profile(spark):
    rows = [(i + 1, f"v{i % 1500}" if i % 4 else None, i % 3, float(i), "") for i in range(6000)]
    df = spark.createDataFrame(rows, f"{ROW_ID} long, text string, n int, d double, blank string")
    parts = [profile.state(df.where(f"{ROW_ID} % 3 = {k}")) for k in range(3)] + [profile.state(df.where("n > 5"))]
    merged = profile.merge(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]))
    got, want = by_name(profile.fields_of_state(merged)), by_name(profile.fields(df))
    assert set(got) == set(want)
    for name, row in want.items():
        exact = ("order", "row_count", "null_count", "null_ratio", "sample_values", "warnings", "inferred_type", "nullable")
        assert [got[name][c] for c in exact] == [row[c] for c in exact]
        assert abs(got[name]["distinct_count"] - row["distinct_count"]) <= 0.03 * row["distinct_count"]


def test_approximate_roll_up(spark):
    once = spark.range(20_000).selectExpr("id", "if(id % 5 = 0, NULL, id) AS v")
    exact, sketched = (profile.dataset(once, approximate=a).first().asDict() for a in (False, True))
    assert sketched == exact and exact["duplicate_row_count"] == 0
    twice = profile.dataset(once.unionByName(once), approximate=True).first()
    assert abs(twice["duplicate_row_count"] - 20_000) <= 600 and list(twice["warnings"]) == ["duplicate_rows_detected"]
    empty = profile.dataset(once.where("id < 0"), approximate=True).first()
    assert empty["row_count"] == 0 and list(empty["warnings"]) == ["empty_dataset"]
