import statistics
from collections import Counter

import pytest
from conftest import code_of
from pyspark.sql import functions as F

from gridloom import ROW_ID, Step, recipe
from gridloom.operators.steps import Flow, fold

ON = [{"left": "k", "right": "k"}]


def tables(spark):
    left = [(i + 1, 7 if i % 3 == 0 else None if i % 50 == 1 else i % 200, f"l{i % 5}") for i in range(3000)]
    right = [(i % 260 if i % 4 else 3, f"r{i % 9}") for i in range(400)] + [(None, "none")]
    return spark.createDataFrame(left, f"{ROW_ID} long, k int, a string"), spark.createDataFrame(right, "k int, b string")


def joined(left, right, how, **more):
    return fold(Flow(left, tables={"r": right}), [Step("join", 0, {"table": "r", "on": ON, "how": how, **more})]).df


@pytest.mark.parametrize("how", ["inner", "left", "right", "full", "semi", "anti"])
def test_split_joins_give_the_same_rows(spark, how):
    left, right = tables(spark)
    plain, split = joined(left, right, how), joined(left, right, how, split_heavy=True)
    assert split.columns == plain.columns
    assert sorted(map(str, split.collect())) == sorted(map(str, plain.collect()))
    assert joined(left.where("k > 900"), right, how, split_heavy=True).count() == joined(left.where("k > 900"), right, how).count()


def test_a_third_of_the_rows_is_spread(spark):
    left = spark.range(60_000).select(F.col("id").alias(ROW_ID), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 9973).cast("int").alias("k"))
    right = spark.range(9973).select(F.col("id").cast("int").alias("k"), F.lit("x").alias("b"))
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        def sizes(**more):
            return [r["count"] for r in joined(left, right, "inner", **more).groupBy(F.spark_partition_id()).count().collect()]

        split, plain = sizes(split_heavy=True), sizes()
        grouped = joined(left, right, "inner", split_heavy=True).groupBy("k").count()
        assert max(split) < 2 * statistics.median(split) and max(plain) > 2 * statistics.median(plain)
        assert grouped.where("k = 7").first()["count"] == left.where("k = 7").count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_split_keys_need_one_type(spark):
    left, right = tables(spark)
    assert code_of(joined, left, right.withColumn("k", F.col("k").cast("long")), "inner", split_heavy=True) == "invalid_cleaning_step"


def test_outlier_limits_meet_large_groups_in_many_tasks(spark):
    """Groups by null, NaN and zeros of both signs, each too large for one task, and a small one; a map among the fields."""
    keys = [None, float("nan"), 0.0, -0.0]
    data = [(i, keys[i % 4], 100.0 if i < 4 else float(i % 7), {"a": i}) for i in range(4000)] + [(4000, 9.0, 1.0, None)]
    df = spark.createDataFrame(data, "id long, k double, v double, m map<string, int>").repartition(4)
    step = Step("flag_outliers", 0, {"field": "v", "group_by": ["k"], "threshold": 5, "target": "far"})
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "40"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        out = recipe.apply_steps(df, [step])
        assert out.columns == ["id", "k", "v", "m", "far"]
        rows = out.withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r.id, r.far) for r in rows) == [(i, i < 4) for i in range(4001)]
    assert max(Counter(r.task for r in rows).values()) < 400
