"""Lineage: one edge per transform, traced upstream or downstream."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence
from dataclasses import astuple, dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, types as T
from pyspark.sql import functions as F

from ..errors import WorkspaceError
from ..session import fresh_path, stage

EDGE_COLUMNS = (
    "project_id", "source_type", "source_id", "target_type", "target_id", "transform_type", "transform_id"
)
EDGE_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in EDGE_COLUMNS])
NODE_COLUMNS = ("node_type", "node_id")


@dataclass(frozen=True)
class Edge:
    project_id: str
    source_type: str
    source_id: str
    target_type: str
    target_id: str
    transform_type: str | None = None
    transform_id: str | None = None


def edges(spark: SparkSession, items: Iterable[Edge]) -> DataFrame:
    return spark.createDataFrame([astuple(e) for e in items], EDGE_SCHEMA)


def edge_table(
    df: DataFrame, *, project_id: F.Column | str, source: Sequence, target: Sequence, transform: Sequence
) -> DataFrame:
    """Edges computed from rows: ``source``, ``target`` and ``transform`` are (type, id) columns or texts."""

    def value(v):
        return F.lit(v) if isinstance(v, str) or v is None else v

    values = [project_id, *source, *target, *transform]
    return df.select(*[value(v).cast("string").alias(n) for n, v in zip(EDGE_COLUMNS, values)])


# How a table can come about, as source type and transform type.
ORIGINS = {
    "file": ("file_import_preview", "dataset_creation"),
    "external_table": ("external_database_table", "external_table_import"),
    "external_sql": ("external_database_sql", "external_sql_import"),
}


def origin_edge(project_id: str, origin: str, source_id: str, dataset_id: str) -> Edge:
    """A table and where it was imported from."""
    source_type, transform = ORIGINS[origin]
    return Edge(project_id, source_type, source_id, "dataset", dataset_id, transform, dataset_id)


def chart_edges(charts: DataFrame) -> DataFrame:
    """Edges of charts given as (project_id, chart_id, data_view_id)."""
    chart = F.col("chart_id")
    return edge_table(
        charts, project_id=F.col("project_id"), source=("data_view", F.col("data_view_id")),
        target=("chart", chart), transform=("chart_definition", chart),
    )


def dashboard_edges(refs: DataFrame) -> DataFrame:
    """Edges of dashboards given as (project_id, dashboard_id, chart_id, mode); mode may be null."""
    dashboard = F.col("dashboard_id")
    layout = F.concat(F.coalesce(F.col("mode"), F.lit("dashboard")), F.lit("_layout"))
    return edge_table(
        refs, project_id=F.col("project_id"), source=("chart", F.col("chart_id")),
        target=("dashboard", dashboard), transform=(layout, dashboard),
    )


def append(new_edges: DataFrame, path: str) -> None:
    """Add edges to the edge table."""
    new_edges.select(*EDGE_COLUMNS).write.mode("append").parquet(path)


#: A node with more neighbours than this has them dealt over several parts.
HUB_LINKS = 1_000_000


class Adjacency:
    """The links of all edges in one direction, distinct, written once and bucketed by the node they leave.

    A level of a trace joins its frontier to the buckets: only the frontier moves. The neighbours of a hub lie in
    several parts, each in a bucket of its own, and the frontier asks for each part.
    """

    KEYS = ("from_type", "from_id", "part")

    def __init__(self, edge_df: DataFrame, direction: str, hub_links: int = HUB_LINKS):
        if direction not in ("downstream", "upstream"):
            raise WorkspaceError("invalid_lineage_direction", "direction is downstream or upstream")
        here, there = ("source", "target") if direction == "downstream" else ("target", "source")
        self.spark = edge_df.sparkSession
        links = stage(edge_df.select(
            F.col(f"{here}_type").alias("from_type"), F.col(f"{here}_id").alias("from_id"),
            F.col(f"{there}_type").alias("node_type"), F.col(f"{there}_id").alias("node_id"),
        ).distinct(), "links")
        degree = links.groupBy("from_type", "from_id").agg(F.count(F.lit(1)).alias("links")).where(F.col("links") > hub_links)
        self.hubs = stage(degree.select("from_type", "from_id", F.ceil(F.col("links") / hub_links).alias("parts")), "hubs")
        part = F.coalesce(F.pmod(F.xxhash64("node_type", "node_id"), F.col("parts")), F.lit(0))
        dealt = links.join(self.hubs, ["from_type", "from_id"], "left").select(*links.columns, part.alias("part"))
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.table, path = f"lineage_{uuid.uuid4().hex}", fresh_path(self.spark, "adjacency")
        bucketed = dealt.repartition(buckets, *self.KEYS).write.bucketBy(buckets, *self.KEYS).sortBy(*self.KEYS)
        bucketed.option("path", path).saveAsTable(self.table)

    def step(self, nodes: DataFrame) -> DataFrame:
        """The distinct neighbours of some nodes."""
        asked = nodes.select(F.col("node_type").alias("from_type"), F.col("node_id").alias("from_id")).join(self.hubs, ["from_type", "from_id"], "left")
        parts = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)).alias("part")
        asked = asked.select("from_type", "from_id", parts)
        return self.spark.table(self.table).join(asked, list(self.KEYS), "left_semi").select(*NODE_COLUMNS).distinct()

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def trace(edge_df: DataFrame, start: Sequence[tuple[str, str]], direction: str = "downstream", hub_links: int = HUB_LINKS) -> DataFrame:
    """Every asset reachable from ``start`` with its distance: (node_type, node_id, depth).

    The edges are read once, into an adjacency; then level by level the newest nodes ask it for their neighbours,
    without the nodes already seen, so cycles end.  Each level is written to the shared folder, which keeps the plan
    short and the work safe from lost executors.
    """
    links = Adjacency(edge_df, direction, hub_links)
    spark, path = edge_df.sparkSession, fresh_path(edge_df.sparkSession, "lineage")
    depth = 0
    fresh = spark.createDataFrame([(t, i) for t, i in start], "node_type string, node_id string").distinct()
    try:
        while True:
            # one folder per level: the plan of a level does not grow with the depth
            found = Observation()
            level = fresh.observe(found, F.count(F.lit(1)).alias("nodes"))
            level.write.parquet(f"{path}/depth={depth}")
            seen = spark.read.schema("node_type string, node_id string, depth int").parquet(path)
            if not found.get["nodes"]:
                return seen
            newest = spark.read.schema("node_type string, node_id string").parquet(f"{path}/depth={depth}")
            fresh = links.step(newest).join(seen, list(NODE_COLUMNS), "left_anti")
            depth += 1
    finally:
        links.drop()
