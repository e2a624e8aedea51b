"""Config values against field types: compared exactly, refused where they do not fit."""

import decimal

import pytest
from conftest import code_of
from pyspark.sql import functions as F

from gridloom import Step, recipe
from gridloom.functions import conditions


def rows_where(df, op, value):
    return [r["v"] for r in df.filter(conditions.build({"field": "v", "op": op, "value": value}, df.schema)).orderBy("v").collect()]


@pytest.fixture(scope="module")
def tenths(spark):
    return spark.createDataFrame([(decimal.Decimal(x),) for x in ("2.4", "2.5", "2.6")] + [(None,)], "v decimal(10,1)")


@pytest.mark.parametrize(
    ("op", "value", "want"),
    [
        ("=", 2.55, []), ("!=", 2.55, ["2.4", "2.5", "2.6"]), ("<", 2.55, ["2.4", "2.5"]), ("<=", "2.55", ["2.4", "2.5"]),
        (">", 2.55, ["2.6"]), (">=", 2.55, ["2.6"]), ("=", 2.5, ["2.5"]), ("<", 2.5, ["2.4"]), (">=", 2.5, ["2.5", "2.6"]),
        ("<", 10**12, ["2.4", "2.5", "2.6"]), (">", 10**12, []), (">", -(10**12), ["2.4", "2.5", "2.6"]), ("<", float("inf"), ["2.4", "2.5", "2.6"]),
        ("in", [2.55, 2.6, 10**12], ["2.6"]), ("between", [2.45, 2.55], ["2.5"]), ("not_in", [2.55], ["2.4", "2.5", "2.6"]),
    ],
)
def test_decimals(tenths, op, value, want):
    assert rows_where(tenths, op, value) == [decimal.Decimal(w) for w in want]


def test_large_integers(spark):
    big = 2**53
    df = spark.createDataFrame([(big,), (big + 1,), (None,)], "v long")
    assert rows_where(df, "in", [big, 0.5]) == [big]
    assert rows_where(df, "=", big + 1) == [big + 1]
    assert rows_where(df, "<", big + 0.5 if False else str(big + 1)) == [big]
    assert rows_where(df, "<", 1e30) == [big, big + 1]
    small = df.select((F.col("v") % 5).cast("int").alias("v"))
    assert rows_where(small, "<", 5_000_000_000) == [2, 3]
    assert rows_where(small, "in", [5_000_000_000]) == []


def test_values_that_do_not_fit_are_refused(spark):
    df = spark.createDataFrame([(1, True, decimal.Decimal("1.5"))], "i int, b boolean, d decimal(4,1)")
    def refused(operation, config):
        return code_of(recipe.validate, [Step(operation, 0, config)], df.schema) == "invalid_cleaning_step"

    assert refused("fill_null", {"field": "i", "value": 5 * 10**9})
    assert refused("fill_null", {"field": "d", "value": "1.55"})
    assert refused("fill_null", {"field": "i", "value": float("nan")})
    assert refused("filter_rows", {"condition": {"field": "b", "op": "=", "value": "maybe"}})
    assert refused("filter_rows", {"condition": {"field": "i", "op": "<", "value": "x"}})
    assert refused("numeric", {"field": "i", "action": "clip", "min": 5 * 10**9})
    recipe.validate([Step("filter_rows", 0, {"condition": {"field": "b", "op": "=", "value": "yes"}})], df.schema)


def test_clip_keeps_every_digit(spark):
    df = spark.createDataFrame([(2**53,), (2**53 + 5,)], "v long")
    out = recipe.apply_steps(df, [Step("numeric", 0, {"field": "v", "action": "clip", "min": 2**53 + 1, "max": 10**30})])
    assert sorted(r["v"] for r in out.collect()) == [2**53 + 1, 2**53 + 5]
