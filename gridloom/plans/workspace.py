"""A workspace: every transform publishes its table, fields, lineage and log rows in one commit.

Data is written first, to a folder that nothing refers to yet. Then one numbered entry of the commit log makes the
table, its edges and its log rows visible together. An entry is a file that is created only if it is absent, so of two
writers of one number exactly one wins; the other looks at what was committed meanwhile and tries the next number,
unless its table's name has been taken: then it gives up and deletes its own data. Readers see whole commits only.
"""

from __future__ import annotations

import datetime
import json
import re
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import asdict

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..errors import WorkspaceError
from ..operators import activity, lineage
from ..operators.steps import Step
from ..session import create_if_absent, drop_path
from ..sources import tables
from ..types import Field, fields_of
from . import catalog, imports, recipe
from .scope import Scope

TABLE = f"struct<id:string,project_id:string,kind:string,name:string,path:string,row_count:long,fields:array<{catalog.FIELD_STRUCT}>>"
EDGE = "struct<" + ",".join(f"{c}:string" for c in lineage.EDGE_COLUMNS) + ">"
LOG = "struct<project_id:string,action:string,detail:string>"
ENTRY_SCHEMA = f"version long, committed_at string, `table` {TABLE}, edges array<{EDGE}>, log array<{LOG}>"
ENTRY_NAME = re.compile(r"(\d{20})\.json")


class CommitLog:
    """Numbered entries below ``root``/log, from 1 without gaps."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._folder = self._path(f"{self.root}/log")
        self._files = self._folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._files.mkdirs(self._folder)

    def _path(self, text: str):
        return self._jvm.org.apache.hadoop.fs.Path(text)

    def latest(self) -> int:
        """The newest version, 0 before the first."""
        names = (ENTRY_NAME.fullmatch(s.getPath().getName()) for s in self._files.listStatus(self._folder))
        return max((int(m[1]) for m in names if m), default=0)

    def _create(self, version: int, text: str) -> bool:
        """Create the entry with its whole content; False where it is there already."""
        return create_if_absent(self.spark, f"{self.root}/log/{version:020d}.json", text)

    def entries(self, after: int = 0) -> DataFrame:
        """Whole commits: (version, committed_at, table, edges, log)."""
        read = self.spark.read.schema(ENTRY_SCHEMA).option("pathGlobFilter", "*.json")
        return read.json(f"{self.root}/log").where(F.col("version") > after)

    def _refuse_taken(self, table: Mapping, after: int) -> None:
        taken = self.entries(after).where(
            (F.col("table.kind") == "dataset") & (F.col("table.project_id") == table["project_id"]) & (F.col("table.name") == table["name"])
        )
        if not taken.isEmpty():
            raise WorkspaceError("dataset_name_conflict", f"The project has a dataset named {table['name']!r}")

    def commit(self, *, table: Mapping | None = None, edges: Sequence[lineage.Edge] = (), log: Sequence[Mapping] = ()) -> int:
        """Publish all of it or nothing; returns the version."""
        checked = 0
        while True:
            latest = self.latest()
            if table is not None and table["kind"] == "dataset":
                self._refuse_taken(table, checked)
            checked = latest
            now = datetime.datetime.now(datetime.UTC).replace(tzinfo=None).isoformat(timespec="microseconds")
            entry = {"version": latest + 1, "committed_at": now, "table": table, "edges": [asdict(e) for e in edges], "log": list(log)}
            if self._create(latest + 1, json.dumps(entry)):
                return latest + 1

    def tables(self) -> DataFrame:
        """Datasets and data views, as ``catalog.newest_first`` reads them."""
        made = F.col("committed_at").cast("timestamp_ntz").alias("created_at")
        return self.entries().where("`table` is not null").select("table.*", made)

    def edges(self) -> DataFrame:
        return self.entries().select(F.explode("edges").alias("e")).select("e.*")

    def log(self) -> DataFrame:
        """Log rows in the order of their commits."""
        return self.entries().select("version", "committed_at", F.posexplode("log").alias("place", "l")).select("version", "place", "committed_at", "l.*")


class Workspace:
    """Imports, recipes, saved queries and runs of projects, each in one commit."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.commits = spark, CommitLog(spark, root)

    def _fresh(self, kind: str) -> str:
        return f"{self.commits.root}/{kind}/{uuid.uuid4().hex}"

    def _publish(self, project_id: str, kind: str, name: str, asset_id: str | None, write, edges_of, action: str, detail: Mapping) -> tuple[DataFrame, str]:
        name = name.strip()
        if not name:
            raise WorkspaceError(f"invalid_{kind}_name", "A name cannot be blank")
        asset_id = asset_id or f"{'dataset' if kind == 'dataset' else 'view'}_{uuid.uuid4().hex}"
        draft = {"id": asset_id, "project_id": project_id, "kind": kind, "name": name}
        if kind == "dataset":
            self.commits._refuse_taken(draft, 0)  # before the work; the commit looks again
        path = self._fresh(kind)
        try:
            table, rows = write(path)
            described = [{"name": f.name, "inferred_type": f.type, "nullable": f.nullable, "order": f.order} for f in fields_of(table)]
            line = {"project_id": project_id, "action": action, "detail": json.dumps({**detail, "row_count": rows})}
            self.commits.commit(table={**draft, "path": path, "row_count": rows, "fields": described}, edges=edges_of(asset_id), log=[line])
        except Exception:
            drop_path(self.spark, path)
            raise
        return table, asset_id

    def import_csv(
        self, project_id: str, name: str, paths: str | Sequence[str], *, source_id: str, asset_id: str | None = None,
        fields: Sequence[Field] | None = None, multi_line: bool | str = False,
    ) -> tuple[DataFrame, str]:
        """CSV files as a dataset, with the edge from its file."""
        return self._publish(
            project_id, "dataset", name, asset_id,
            lambda path: imports.import_csv(self.spark, paths, path, fields=fields, multi_line=multi_line),
            lambda made: [lineage.origin_edge(project_id, "file", source_id, made)], "dataset.created", {"source": source_id},
        )

    def add(self, project_id: str, name: str, df: DataFrame, edge: lineage.Edge | None = None, asset_id: str | None = None) -> tuple[DataFrame, str]:
        """Any frame as a dataset, with the edge that tells where it is from."""
        return self._publish(
            project_id, "dataset", name, asset_id, lambda path: tables.write(df, path),
            lambda made: [edge] if edge else [], "dataset.created", {},
        )

    def execute(
        self, project_id: str, name: str, source_id: str, recipe_id: str, steps: Sequence[Step], *,
        scope: Mapping[str, DataFrame] | None = None, asset_id: str | None = None,
    ) -> tuple[DataFrame, str]:
        """A recipe over a dataset as a derived dataset, with its edges."""
        source = self.open(source_id)
        return self._publish(
            project_id, "dataset", name, asset_id, lambda path: recipe.execute(source, steps, path, scope),
            lambda made: recipe.execution_edges(project_id, recipe_id, source_id, made), "recipe.executed", {"recipe": recipe_id},
        )

    def save(self, project_id: str, name: str, scope: Scope, sql: str, *, limit: int | None = None, asset_id: str | None = None) -> tuple[DataFrame, str]:
        """A query as a data view, with its edge."""

        def edge(made: str) -> list[lineage.Edge]:
            return [lineage.Edge(project_id, "sql_query", made, "data_view", made, "sql_query_materialization", made)]

        return self._publish(project_id, "data_view", name, asset_id, lambda path: scope.save(sql, path, limit), edge, "sql.query_saved", {"sql": sql})

    def run(self, project_id: str, scope: Scope, sql: str, limit: int | None = None) -> DataFrame:
        """The rows of a query, written once; the run is in the log with its row count."""
        path, counted = self._fresh("runs"), Observation()
        result = scope.run(sql, limit)
        result.observe(counted, F.count(F.lit(1)).alias("rows")).write.parquet(path)
        detail = json.dumps({"sql": sql, "row_count": counted.get["rows"]})
        self.commits.commit(log=[{"project_id": project_id, "action": activity.QUERY_EXECUTED, "detail": detail}])
        return self.spark.read.schema(result.schema).parquet(path)

    def open(self, asset_id: str) -> DataFrame:
        found = self.commits.tables().where(F.col("id") == asset_id).select("path").first()
        if found is None:
            raise WorkspaceError("physical_table_not_found", f"No table {asset_id}")
        return tables.open_table(self.spark, found["path"])

    def listing(self, project_id: str, kind: str = "dataset") -> DataFrame:
        return catalog.newest_first(self.commits.tables().where(F.col("kind") == kind), project_id)

    def history(self, project_id: str) -> DataFrame:
        """The executed queries of a project."""
        return activity.query_history(self.commits.log().where(F.col("project_id") == project_id))
