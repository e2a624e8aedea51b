"""Incremental ingest and recipes on streams, against the batch result."""

from __future__ import annotations

from gridloom import Step, drops, infer
from gridloom.session import fresh_path

from .registry import register, table

COLUMNS = ["event_id", "user_id", "event_type", "value"]


def _drop(spark, sf, folder: str, condition: str) -> None:
    df = table(spark, sf, "events").select(*COLUMNS).filter(condition)
    df.write.mode("append").option("header", True).csv(folder)


@register("k1_incremental_ingest", "SELECT event_id, user_id, event_type, value FROM events")
def k1(spark, sf):
    """Two drops, three runs: each row arrives once."""
    folder, target, checkpoint = (fresh_path(spark, p) for p in ("drops", "ingested", "ingest-log"))
    fields = infer.infer_fields(table(spark, sf, "events").select(*COLUMNS).selectExpr(*[f"CAST({c} AS STRING) AS {c}" for c in COLUMNS]))
    for condition in ("event_type IN ('click', 'view')", "event_type NOT IN ('click', 'view')"):
        _drop(spark, sf, folder, condition)
        drops.ingest(drops.read_csv_drops(spark, folder, fields), target, checkpoint)
    drops.ingest(drops.read_csv_drops(spark, folder, fields), target, checkpoint)
    return drops.committed(spark, target).select(*COLUMNS)


@register(
    "k2_recipe_on_stream",
    """SELECT event_id AS id, user_id, CASE WHEN event_type = 'view' THEN 'unknown' ELSE event_type END AS event_type, value
    FROM events WHERE event_type <> 'error'""",
)
def k2(spark, sf):
    df = table(spark, sf, "events").selectExpr(
        "event_id", "user_id", "CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS event_type",
        "CASE WHEN event_type <> 'error' THEN value END AS value",
    )
    folder, target, checkpoint = (fresh_path(spark, p) for p in ("drops", "cleaned", "clean-log"))
    df.write.option("header", True).csv(folder)
    fields = infer.infer_fields(spark.read.csv(folder, header=True))
    steps = [
        Step("fill_null", 0, {"field": "event_type", "value": "unknown"}),
        Step("drop_null_rows", 1, {"fields": ["value"]}),
        Step("rename_field", 2, {"source_field": "event_id", "target_field": "id"}),
    ]
    drops.ingest(drops.apply_steps(drops.read_csv_drops(spark, folder, fields), steps), target, checkpoint)
    return drops.committed(spark, target).select("id", "user_id", "event_type", "value")


def _two_drops(spark, sf, deduplicate=()):
    """Events in two drops, the later half of the ids first, so that ids follow arrival and not the values."""
    folder, target, checkpoint = (fresh_path(spark, p) for p in ("drops", "numbered", "number-log"))
    events = table(spark, sf, "events").select(*COLUMNS)
    fields = infer.infer_fields(events.selectExpr(*[f"CAST({c} AS STRING) AS {c}" for c in COLUMNS]))
    for condition in ("event_id % 2 = 1", "event_id % 2 = 0"):
        _drop(spark, sf, folder, condition)
        stream = drops.read_csv_drops(spark, folder, fields)
        drops.ingest(stream, target, checkpoint, deduplicate=deduplicate, order_by=["event_id"])
    return drops.as_table(spark, target, fields)


@register(
    "a11_row_ids_over_drops",
    """SELECT row_number() OVER (ORDER BY event_id % 2 DESC, event_id) AS row_id, event_id, user_id, event_type, value FROM events""",
)
def a11_ids(spark, sf):
    """Rows of a later drop are numbered behind those of an earlier one."""
    df = _two_drops(spark, sf)
    return df.select(df[df.columns[0]].alias("row_id"), *COLUMNS)


@register(
    "k2_stream_deduplicate",
    """SELECT row_number() OVER (ORDER BY event_id % 2 DESC, event_id) AS row_id, event_id, user_id, event_type, value FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 2 DESC, event_id) AS place FROM events
    ) WHERE place = 1""",
)
def k2_deduplicate(spark, sf):
    """The first row of each key over all drops, as the table step gives it."""
    df = _two_drops(spark, sf, ["user_id", "event_type"])
    return df.select(df[df.columns[0]].alias("row_id"), *COLUMNS)
