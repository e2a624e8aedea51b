"""Recipes: validate, apply, preview one page, execute into a derived table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, types as T

from ..operators import lineage, row_id
from ..operators.steps import Flow, Step, fold
from ..sources import tables
from ..types import ROW_ID, column, fields_of


def validate(steps: Sequence[Step], schema: T.StructType, scope: Mapping[str, DataFrame] | None = None) -> list[Step]:
    """Check every step against the schema the steps before it leave; no data is read."""
    empty = SparkSession.active().createDataFrame([], schema)
    fold(Flow(empty, tables=dict(scope or {}), dry=True), list(steps))
    return sorted(steps, key=lambda s: s.order)


def apply_steps(df: DataFrame, steps: Sequence[Step], scope: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """The recipe as one lazy plan."""
    return fold(Flow(df, tables=dict(scope or {})), list(steps)).df


def preview(
    df: DataFrame, steps: Sequence[Step], page: int = 1, page_size: int = 20,
    scope: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """The steps applied to one page of the source; its row count is the page's remaining rows."""
    result = apply_steps(tables.page(df, page, page_size), steps, scope)
    return result.orderBy(column(ROW_ID)) if ROW_ID in result.columns else result


def execute(
    df: DataFrame, steps: Sequence[Step], path: str, scope: Mapping[str, DataFrame] | None = None
) -> tuple[DataFrame, int]:
    """Run the recipe over the whole table and write the derived table; returns (table, rows)."""
    flow = fold(Flow(df, tables=dict(scope or {})), list(steps))
    fields = fields_of(flow.df)
    if flow.sorted:
        result = row_id.number(flow.df.drop(ROW_ID))
    elif ROW_ID in flow.df.columns and flow.unique_ids:
        result = row_id.renumber(flow.df)
    else:
        # ids repeat or are gone: order by what is left of them, then by every field
        keys = [column(c) for c in ([ROW_ID] if ROW_ID in flow.df.columns else []) + [f.name for f in fields]]
        result = row_id.number(flow.df.orderBy(*keys).drop(ROW_ID))
    return tables.write(result, path, fields=fields)


def creation_edge(project_id: str, recipe_id: str, source_id: str) -> lineage.Edge:
    return lineage.Edge(
        project_id, "dataset", source_id, "cleaning_recipe", recipe_id, "cleaning_recipe", recipe_id
    )


def execution_edges(project_id: str, recipe_id: str, source_id: str, derived_id: str) -> list[lineage.Edge]:
    """A run links the derived table to its source and to the recipe."""
    run = ("cleaning_recipe_execution", recipe_id)
    return [
        lineage.Edge(project_id, "dataset", source_id, "dataset", derived_id, *run),
        lineage.Edge(project_id, "cleaning_recipe", recipe_id, "dataset", derived_id, *run),
    ]
