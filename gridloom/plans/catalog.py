"""The list of a project's tables, itself a table that is only appended to."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql import functions as F

from ..errors import WorkspaceError
from ..types import Field

FIELD_STRUCT = "struct<name:string,inferred_type:string,nullable:boolean,`order`:int>"
SCHEMA = (
    "id string, project_id string, kind string, name string, path string, row_count long, "
    f"fields array<{FIELD_STRUCT}>, created_at timestamp_ntz"
)


class Catalog:
    """Datasets and data views by project."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        spark.createDataFrame([], SCHEMA).write.mode("ignore").parquet(path)

    def entries(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def check_name(self, project_id: str, name: str, kind: str = "dataset") -> str:
        """The stripped name, if it is free."""
        name = name.strip()
        if not name:
            raise WorkspaceError(f"invalid_{kind}_name", "A name cannot be blank")
        same = (F.col("project_id") == project_id) & (F.col("name") == name) & (F.col("kind") == kind)
        if kind == "dataset" and not self.entries().filter(same).isEmpty():
            raise WorkspaceError("dataset_name_conflict", f"The project has a dataset named {name!r}")
        return name

    def register(
        self, project_id: str, name: str, path: str, row_count: int, fields: Sequence[Field],
        *, kind: str = "dataset", asset_id: str | None = None,
    ) -> str:
        name = self.check_name(project_id, name, kind)
        asset_id = asset_id or f"{'dataset' if kind == 'dataset' else 'view'}_{uuid.uuid4().hex}"
        described = [(f.name, f.type, f.nullable, f.order) for f in fields]
        row = (asset_id, project_id, kind, name, path, row_count, described, datetime.datetime.now())
        self.spark.createDataFrame([row], SCHEMA).write.mode("append").parquet(self.path)
        return asset_id

    def listing(self, project_id: str, kind: str = "dataset") -> DataFrame:
        return newest_first(self.entries().filter(F.col("kind") == kind), project_id)


def newest_first(entries: DataFrame, project_id: str) -> DataFrame:
    """A project's assets, newest first; equal times by id."""
    mine = entries.filter(F.col("project_id") == project_id)
    return mine.orderBy(F.col("created_at").desc(), F.col("id").desc())


def view_schema(fields: Sequence[Field]) -> T.StructType:
    """The schema of a data view given as rows."""
    return T.StructType([T.StructField(f.name, f.spark_type, f.nullable, f.metadata) for f in fields])
