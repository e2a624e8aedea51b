"""Read-only SQL over the tables of one project."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import WorkspaceError
from ..functions import names
from ..operators import guard, lineage
from ..sources import tables
from ..types import ROW_ID, fields_of, quoted, validate_fields

ALIAS_PATTERN = r"\bdataset_[A-Za-z0-9_]+\b"
# Leaves of an analysed plan that hold no stored rows: literals, row generators, references to a CTE of the query.
OWN_LEAVES = ("OneRowRelation", "LocalRelation", "Range", "CTERelationRef", "UnionLoopRef")
# Spark's conditions for a name that stands for no table.
NOT_FOUND = ("TABLE_OR_VIEW_NOT_FOUND", "SCHEMA_NOT_FOUND", "CATALOG_NOT_FOUND", "SINGLE_PART_NAMESPACE")
# Settings of the scope itself, and of where the catalog lies.
KEPT_SETTINGS = ("spark.sql.runSQLOnFiles", "spark.sql.warehouse.dir", "spark.sql.catalogImplementation")


class Scope:
    """A session of its own that knows the given tables and no others."""

    def __init__(self, spark: SparkSession, datasets: Mapping[str, DataFrame], views: Mapping[str, DataFrame] | None = None):
        if not datasets:
            raise WorkspaceError("sql_no_project_datasets", "The project has no datasets to query")
        self.tables = {**datasets, **(views or {})}
        self._session = spark.newSession()
        self._session.conf.set("spark.sql.runSQLOnFiles", "false")
        for key, value in spark.conf.getAll.items():
            if key.startswith("spark.sql.") and key not in KEPT_SETTINGS and spark.conf.isModifiable(key):
                self._session.conf.set(key, value)
        for alias, df in self.tables.items():
            # temp views belong to one session; a short-lived global view hands the plan over
            handover = f"handover_{uuid.uuid4().hex}"
            df.createGlobalTempView(handover)
            self._session.table(f"global_temp.{handover}").createOrReplaceTempView(quoted(alias))
            spark.catalog.dropGlobalTempView(handover)

    def query(self, sql: str) -> DataFrame:
        """The guarded query, lazily and without a row limit."""
        clean = guard.validate(sql)
        unknown = set(re.findall(ALIAS_PATTERN, guard.bare(clean))) - set(self.tables)
        if unknown:
            raise WorkspaceError("sql_unknown_dataset", f"Not in the project: {', '.join(sorted(unknown))}")
        try:
            result = self._session.sql(f"SELECT * FROM (\n{clean}\n) AS query_result")
        except ParseException as error:
            raise WorkspaceError("sql_invalid", _first_line(error)) from None
        except AnalysisException as error:
            missing = any(condition in str(error) for condition in NOT_FOUND)
            raise WorkspaceError("sql_unknown_dataset" if missing else "sql_invalid", _first_line(error)) from None
        _refuse_stored_tables(result._jdf.queryExecution().analyzed())
        return result.drop(ROW_ID)

    def run(self, sql: str, limit: int | None = None) -> DataFrame:
        """The rows of a query, or the first ``limit``; an ORDER BY in it decides which."""
        result = self.query(sql)
        return result if limit is None else result.limit(limit)

    def save(self, sql: str, path: str, limit: int | None = None) -> tuple[DataFrame, int]:
        """Materialize a query as a data view: all its rows, or the first ``limit``."""
        result = self.query(sql)
        validate_fields(fields_of(result), "data_view")
        return tables.write(result if limit is None else result.limit(limit), path, kind="data_view")

    def metadata(self, row_counts: Mapping[str, int] | None = None) -> DataFrame:
        """What can be queried: one row per table and field."""
        rows = [
            (alias, (row_counts or {}).get(alias), f.order, f.name, f.type, f.nullable)
            for alias, df in sorted(self.tables.items())
            for f in fields_of(df)
        ]
        schema = (
            "table_alias string, row_count long, field_order int, "
            "field_name string, inferred_type string, nullable boolean"
        )
        return self._session.createDataFrame(rows, schema)


def _refuse_stored_tables(plan) -> None:
    """A new session still sees the shared catalog; its tables are outside the project.

    Walks the analysed plan, where every name is resolved: whatever is below a temporary view is the scope's own; any
    other leaf is a stored table or file, by whatever name, CTE or subquery the text has come to it.
    """
    kind = plan.getClass().getSimpleName()
    own = kind == "View" and plan.isTempView() and plan.desc().identifier().database().isEmpty()  # a global view has a database
    if own:
        return
    below = [seq.apply(i) for seq in (plan.children(), plan.subqueries()) for i in range(seq.size())]
    if kind == "View" or not below and kind.rstrip("$") not in OWN_LEAVES:
        raise WorkspaceError("sql_unknown_dataset", f"Not in the project: {plan.simpleString(5)}")
    for child in below:
        _refuse_stored_tables(child)


def _first_line(error: Exception) -> str:
    return str(error).strip().splitlines()[0]


def view_edges(views: DataFrame) -> DataFrame:
    """Lineage edges of data views given as (project_id, view_id, source_type, source_id, source_sql)."""
    source = names.view_source_id(F.col("source_type"), F.col("source_id"), F.col("source_sql"), F.col("view_id"))
    return lineage.edge_table(
        views, project_id=F.col("project_id"), source=(F.col("source_type"), source),
        target=("data_view", F.col("view_id")),
        transform=(F.concat(F.col("source_type"), F.lit("_materialization")), F.col("view_id")),
    )
