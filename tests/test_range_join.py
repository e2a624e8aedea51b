import datetime

import pytest
from conftest import code_of

from gridloom.operators.range_join import range_join

INF, NAN = float("inf"), float("nan")


def pairs(spark, points, intervals, kind="double"):
    p = spark.createDataFrame(list(enumerate(points)), f"p int, v {kind}")
    i = spark.createDataFrame([(k, *x) for k, x in enumerate(intervals)], f"i int, lo {kind}, hi {kind}")
    out = range_join(p, i, "v", "lo", "hi")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    return sorted((r["p"], r["i"]) for r in out.collect())


def test_widths_from_points_to_everything(spark):
    points = [None, -5.0, 0.0, -0.0, 1.0, 1.0, 2.5, 1e6, 1e300, -1e300, INF, -INF, 0.1 + 0.2]
    ends = [-INF, -1e300, -1e6, -5.0, 0.0, 0.3, 1.0, 2.5, 7.0, 1e6, 1e300, INF]
    intervals = [(a, b) for a in ends for b in ends] + [(None, 1.0), (1.0, None), (0.0, 1.0)]
    want = [(p, i) for p, v in enumerate(points) for i, (a, b) in enumerate(intervals) if None not in (v, a, b) and a <= v <= b]
    assert pairs(spark, points, intervals) == sorted(want)


def test_not_a_number_is_the_greatest(spark):
    assert pairs(spark, [NAN, 1.0, INF], [(0.0, NAN), (0.0, INF), (NAN, NAN)]) == [(0, 0), (0, 2), (1, 0), (1, 1), (2, 0), (2, 1)]


@pytest.mark.parametrize("kind", ["bigint", "decimal(20,2)"])
def test_many_short_intervals_and_a_hot_value(spark, kind):
    points = [k * 37 % 1000 for k in range(300)] + [500] * 150
    intervals = [(k * 13 % 990, k * 13 % 990 + k % 5) for k in range(200)] + [(0, 999)] * 3
    cast = (lambda x: x) if kind == "bigint" else __import__("decimal").Decimal
    want = [(p, i) for p, v in enumerate(points) for i, (a, b) in enumerate(intervals) if a <= v <= b]
    assert pairs(spark, [cast(v) for v in points], [(cast(a), cast(b)) for a, b in intervals], kind) == sorted(want)
    big = [(2**53 + 1, 2**53 + 1)] if kind == "bigint" else []
    assert pairs(spark, [2**53, 2**53 + 1, 2**53 + 2] if big else [], big, kind) == ([(1, 0)] if big else [])


def test_moments_and_equal_fields(spark):
    day = datetime.datetime(2026, 1, 5)
    hour = datetime.timedelta(hours=1)
    p = spark.createDataFrame([(k % 2, day + k * hour) for k in range(48)], "a int, at timestamp_ntz")
    i = spark.createDataFrame([(k % 3, day + 5 * k * hour, day + (5 * k + 7) * hour) for k in range(9)], "b int, since timestamp_ntz, until timestamp_ntz")
    got = range_join(p, i, "at", "since", "until", equal=[("a", "b")]).collect()
    want = [(x["a"], x["at"], y["since"]) for x in p.collect() for y in i.collect() if y["since"] <= x["at"] <= y["until"] and x["a"] == y["b"]]
    assert sorted((r["a"], r["at"], r["since"]) for r in got) == sorted(want)
    assert code_of(range_join, p, p, "at", "at", "at") == "invalid_cleaning_step"
    assert range_join(p.where("a > 5"), i, "at", "since", "until").count() == range_join(p, i.where("b > 5"), "at", "since", "until").count() == 0
    assert code_of(range_join, spark.range(3), i, "id", "since", "until") == "invalid_cleaning_step"
