"""Charts over data views, metric cards, dashboards and their filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import WorkspaceError
from ..functions import conditions, numbers
from ..types import DECIMAL, INTEGER, ROW_ID, TEXT, Field, column, fields_of

# Fixed values.
AGGREGATIONS = ("sum", "avg", "count")
CHART_TYPES = ("bar", "line", "pie", "table")
SNAPSHOT_ROWS = 200
FILTER_TYPES = ("multi_select", "range")
CHART_ID_PATTERN = r'"chart_id"\s*:\s*("(?:[^"\\]|\\.)*")'


def _check(aggregation: str) -> None:
    if aggregation not in AGGREGATIONS:
        raise WorkspaceError("invalid_chart_config", f"Aggregations: {', '.join(AGGREGATIONS)}")


def _point(df: DataFrame, metric: str, aggregation: str) -> tuple[Column, Column]:
    """The value summed up per group, and the value of the finished point."""
    if aggregation == "count":
        return F.lit(1.0), F.col("total")
    if metric not in df.columns:
        return F.lit(0.0), F.col("total") / F.col("rows") if aggregation == "avg" else F.col("total")
    value = numbers.to_number(column(metric), df.schema[metric].dataType)
    # rows without a number weigh in as 0, so the average is over all rows of the group
    return value, F.col("total") / F.col("rows") if aggregation == "avg" else F.col("total")


def aggregate(
    df: DataFrame, dimension: str, metric: str, aggregation: str = "sum", max_rows: int | None = None
) -> DataFrame:
    """The points of a chart, (label, value), in the order in which labels first appear (by label, where
    the rows carry no ids).

    The whole view is aggregated; ``max_rows`` restricts it to its first rows.
    """
    _check(aggregation)
    if max_rows is not None:
        df = df.filter(column(ROW_ID) <= max_rows)
    if not dimension:
        return df.sparkSession.createDataFrame([], "label string, value double")
    if dimension in df.columns:
        label = numbers.group_label(column(dimension), df.schema[dimension].dataType)
    else:
        label = F.lit(numbers.NULL_LABEL)
    value, point = _point(df, metric, aggregation)
    total, rows = F.sum("v").alias("total"), F.count(F.lit(1)).alias("rows")
    if ROW_ID in df.columns:
        cells = df.select(label.alias("label"), value.alias("v"), column(ROW_ID).alias("r"))
        points = cells.groupBy("label").agg(total, rows, F.min("r").alias("r")).orderBy("r")
    else:  # rows without ids have no first one
        cells = df.select(label.alias("label"), value.alias("v"))
        points = cells.groupBy("label").agg(total, rows).orderBy("label")
    return points.select("label", numbers.round_point(point).alias("value"))


def metric_card(df: DataFrame, metric: str, aggregation: str = "sum") -> DataFrame:
    """One value over the whole view, by the rules of the chart points."""
    _check(aggregation)
    value, point = _point(df, metric, aggregation)
    totals = df.select(value.alias("v")).agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("rows"))
    return totals.select(F.coalesce(numbers.round_point(point), F.lit(0.0)).alias("value"))


def default_fields(fields: Sequence[Field]) -> tuple[str, str]:
    """The dimension and metric a new chart starts with."""
    if not fields:
        return "", ""
    first = fields[0].name
    dimension = next((f.name for f in fields if f.type == TEXT), first)
    metric = next((f.name for f in fields if f.type in (DECIMAL, INTEGER)), first)
    return dimension, metric


def spec(view: DataFrame, chart_type: str = "bar", dimension: str | None = None, metric: str | None = None,
         aggregation: str = "sum") -> dict:
    """The settings of a chart, defaults filled in; drawing is up to the caller."""
    picked = default_fields(fields_of(view))
    dimension, metric = dimension or picked[0], metric or picked[1]
    kind = chart_type if chart_type in CHART_TYPES else CHART_TYPES[0]
    wanted = aggregation if aggregation in AGGREGATIONS else AGGREGATIONS[0]
    title = f"{wanted.upper()}({metric}) by {dimension}"
    return {"chart_type": kind, "dimension": dimension, "metric": metric, "aggregation": wanted, "title": title}


# -- dashboards -----------------------------------------------------------------------------


def chart_ids(layout: Column) -> Column:
    """All chart ids anywhere in a layout, distinct and sorted."""
    quoted = F.regexp_extract_all(layout, F.lit(CHART_ID_PATTERN), F.lit(1))
    # the ids are JSON strings: read them as JSON, so escapes are resolved
    read = F.from_json(F.concat(F.lit("["), F.array_join(quoted, ","), F.lit("]")), "array<string>")
    return F.array_sort(F.array_distinct(F.coalesce(read, F.array().cast("array<string>"))))


def dashboard_refs(df: DataFrame, layout_col: str) -> DataFrame:
    """One row per dashboard and chart it shows, next to the dashboard's other columns."""
    others = [column(c) for c in df.columns if c != layout_col]
    return df.select(*others, F.explode(chart_ids(column(layout_col))).alias("chart_id"))


def invalid_refs(refs: DataFrame, charts: DataFrame) -> DataFrame:
    """References to charts that the dashboard's project does not have."""
    return refs.join(charts.select("project_id", "chart_id"), ["project_id", "chart_id"], "left_anti")


def charts_out_of_scope(charts: DataFrame, views: DataFrame) -> DataFrame:
    """Charts whose data view is not in their project."""
    return charts.join(views.select("project_id", "data_view_id"), ["project_id", "data_view_id"], "left_anti")


def check_refs(refs: DataFrame, charts: DataFrame) -> None:
    if not invalid_refs(refs, charts).isEmpty():
        raise WorkspaceError(
            "dashboard_chart_project_mismatch", "The dashboard shows charts outside the project"
        )


def check_scope(charts: DataFrame, views: DataFrame) -> None:
    if not charts_out_of_scope(charts, views).isEmpty():
        raise WorkspaceError("chart_data_view_project_mismatch", "A chart's data view is outside the project")


def apply_filters(df: DataFrame, filters: Sequence[Mapping]) -> DataFrame:
    """Global filters of a dashboard: each ``{field, type, value}``; unset ones and those on fields the
    view does not have leave the view as it is.
    """
    for f in filters:
        kind, name, value = f.get("type"), f.get("field"), f.get("value")
        if kind not in FILTER_TYPES:
            raise WorkspaceError("invalid_dashboard_filter", f"Filter types: {', '.join(FILTER_TYPES)}")
        if value is None or name not in df.columns:
            continue
        if kind == "multi_select":
            op = {"field": name, "op": "in", "value": list(value)}
        else:
            low, high = value
            bounds = [{"field": name, "op": o, "value": v} for o, v in ((">=", low), ("<=", high)) if v is not None]
            if not bounds:
                continue
            op = {"and": bounds}
        df = df.filter(conditions.build(op, df.schema, "invalid_dashboard_filter"))
    return df
