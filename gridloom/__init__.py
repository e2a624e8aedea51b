"""A table workspace on Spark: ingest, type, clean, profile, query, chart and trace tables."""

from .errors import WorkspaceError
from .operators import activity, chart, guard, infer, lineage, profile, quantiles, row_id, steps
from .operators.steps import Step
from .plans import catalog, imports, recipe
from .plans.catalog import Catalog
from .plans.scope import Scope
from .plans.workspace import CommitLog, Workspace
from .sources import databases, delimited, records, tables, workbooks
from .streaming import drops
from .types import ROW_ID, Field

__all__ = [
    "Catalog", "CommitLog", "Field", "ROW_ID", "Scope", "Step", "WorkspaceError", "activity", "catalog", "chart",
    "databases", "delimited", "drops", "guard", "imports", "infer", "lineage", "profile", "quantiles",
    "recipe", "records", "row_id", "steps", "tables", "workbooks", "Workspace",
]
