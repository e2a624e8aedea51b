import datetime as dt
import json

import pytest
from conftest import code_of

from gridloom import ROW_ID, Field, chart


@pytest.fixture(scope="module")
def view(spark):
    rows = [
        (1, "b", 1.0, "2", True, 1.0), (2, None, None, "x", False, 1.5), (3, "", 2.0, " 3 ", True, 1e21),
        (4, "b", 2.0, None, True, 0.1), (5, "NULL", float("nan"), "0x10", None, -0.0), (6, "a", 3.0, "1e3", True, 12345678.0),
    ]
    return spark.createDataFrame(rows, f"{ROW_ID} long, label string, v double, t string, f boolean, n double").repartition(3)


def points(df):
    return [tuple(r) for r in df.collect()]


def test_labels_sums_and_first_seen_order(view):
    assert points(chart.aggregate(view, "label", "v", "sum")) == [("b", 3.0), ("NULL", 2.0), ("a", 3.0)]


def test_average_counts_rows_without_a_number(view):
    assert points(chart.aggregate(view, "label", "v", "avg")) == [("b", 1.5), ("NULL", 0.67), ("a", 3.0)]


def test_count_ignores_the_metric(view):
    assert points(chart.aggregate(view, "label", "absent", "count")) == [("b", 2.0), ("NULL", 3.0), ("a", 1.0)]


def test_text_metrics_and_booleans(view):
    assert points(chart.aggregate(view, "label", "t", "sum")) == [("b", 2.0), ("NULL", 19.0), ("a", 1000.0)]
    assert points(chart.aggregate(view, "label", "f", "sum")) == [("b", 0.0), ("NULL", 0.0), ("a", 0.0)]


def test_number_and_boolean_labels(view):
    assert [p[0] for p in points(chart.aggregate(view, "n", "v", "count"))] == ["1", "1.5", "1e+21", "0.1", "0", "12345678"]
    assert [p[0] for p in points(chart.aggregate(view, "f", "v", "count"))] == ["true", "false", "NULL"]


def test_date_labels(spark):
    rows = [(1, dt.date(2026, 1, 5), dt.datetime(2026, 1, 5, 1, 2)), (2, None, dt.datetime(2026, 1, 5, 1, 2, 3, 250000))]
    df = spark.createDataFrame(rows, f"{ROW_ID} long, d date, t timestamp_ntz")
    assert [p[0] for p in points(chart.aggregate(df, "d", "d", "count"))] == ["2026-01-05", "NULL"]
    assert [p[0] for p in points(chart.aggregate(df, "t", "t", "count"))] == ["2026-01-05T01:02:00", "2026-01-05T01:02:03.250000"]


@pytest.mark.parametrize(("value", "rounded"), [(1.005, 1.0), (-2.5, -2.5), (-0.125, -0.12), (0.125, 0.13), (2.675, 2.68), (1e17, 1e17)])
def test_rounding(spark, value, rounded):
    df = spark.createDataFrame([(1, "a", value)], f"{ROW_ID} long, l string, v double")
    assert points(chart.aggregate(df, "l", "v")) == [("a", rounded)]


def test_row_scope_empty_dimension_and_bad_aggregation(view):
    assert points(chart.aggregate(view, "label", "v", "sum", max_rows=2)) == [("b", 1.0), ("NULL", 0.0)]
    assert points(chart.aggregate(view, "", "v")) == []
    assert points(chart.aggregate(view, "absent", "v", "count")) == [("NULL", 6.0)]
    assert code_of(chart.aggregate, view, "label", "v", "median") == "invalid_chart_config"


def test_default_fields_and_spec(view):
    fields = [Field("id", "integer"), Field("name", "text"), Field("price", "decimal")]
    assert chart.default_fields(fields) == ("name", "id")
    assert chart.default_fields([Field("day", "date")]) == ("day", "day") and chart.default_fields([]) == ("", "")
    assert chart.spec(view, "donut", aggregation="avg") == {
        "chart_type": "bar", "dimension": "label", "metric": "v", "aggregation": "avg", "title": "AVG(v) by label",
    }


def test_chart_ids_at_any_depth(spark):
    layouts = [
        {"mode": "dashboard", "items": [{"chart_id": "c2", "x": 0}, {"group": [{"chart_id": "c1"}, {"chart_id": "c2"}]}]},
        {"items": [{"chart_id": 7}, {"chart_id": {"chart_id": "deep"}}, {"text": '"chart_id": "no"'}]},
        {"items": [{"chart_id": 'a"b\\c é'}]},
        {},
    ]
    rows = [(str(i), json.dumps(layout)) for i, layout in enumerate(layouts)]
    refs = chart.dashboard_refs(spark.createDataFrame(rows, "dashboard_id string, layout string"), "layout")
    found = {}
    for r in refs.collect():
        found.setdefault(r.dashboard_id, []).append(r.chart_id)
    assert found == {"0": ["c1", "c2"], "1": ["deep"], "2": ['a"b\\c é']}


def test_scope_checks(spark):
    charts = spark.createDataFrame([("p", "c1", "v1"), ("q", "c2", "v1")], "project_id string, chart_id string, data_view_id string")
    views = spark.createDataFrame([("p", "v1")], "project_id string, data_view_id string")
    good = spark.createDataFrame([("p", "d", "c1")], "project_id string, dashboard_id string, chart_id string")
    chart.check_refs(good, charts)
    bad = good.union(spark.createDataFrame([("p", "d", "c2")]))
    assert code_of(chart.check_refs, bad, charts) == "dashboard_chart_project_mismatch"
    assert code_of(chart.check_scope, charts, views) == "chart_data_view_project_mismatch"
    chart.check_scope(charts.filter("project_id = 'p'"), views)


def test_global_filters(view):
    filters = [
        {"field": "label", "type": "multi_select", "value": ["a", "b"]}, {"field": "v", "type": "range", "value": [None, 2]},
        {"field": "v", "type": "range"}, {"field": "absent", "type": "multi_select", "value": ["x"]},
    ]
    assert points(chart.aggregate(chart.apply_filters(view, filters), "label", "v")) == [("b", 3.0)]
    assert code_of(chart.apply_filters, view, [{"field": "v", "type": "slider"}]) == "invalid_dashboard_filter"


def test_metric_card(view):
    assert chart.metric_card(view, "v", "avg").first().value == 1.33
    assert chart.metric_card(view.limit(0), "v").first().value == 0.0
