"""Incremental ingest: files dropped into a folder flow into a table exactly once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..errors import WorkspaceError
from ..functions import cells
from ..operators.steps import Flow, Step, fold
from ..sources.delimited import OPTIONS, text_schema
from ..types import ROW_ID, Field, column
from .batches import BatchTable

BAD = "_bad_cells"

# Steps that look at one row at a time mean the same on a stream as on a table.
ROW_STEPS = (
    "rename_field", "fill_null", "drop_null_rows", "convert_type", "clean_text", "numeric", "mask",
    "blank_to_null", "batch", "filter_rows", "calculate", "split_field", "merge_fields",
    "conditional_field", "extract", "format_date", "date_part", "truncate_date",
)


def read_csv_drops(
    spark: SparkSession, folder: str, fields: Sequence[Field], files_per_trigger: int | None = None,
    check_header: bool = True, on_bad: str = "fail",
) -> DataFrame:
    """New CSV files of a folder as typed rows; the schema is fixed beforehand.

    A file whose header names other fields stops the stream, unless ``check_header`` is off and the
    columns are taken by place. A cell that does not fit its field, or is blank where the field must not
    be, stops the stream with ``invalid_field_value``; with ``on_bad="mark"`` the row keeps its cells as text in
    the column ``BAD`` instead, for ``accepted`` and ``rejected`` to part.
    """
    if on_bad not in ("fail", "mark"):
        raise WorkspaceError("invalid_dataset_fields", "on_bad is fail or mark")
    reader = spark.readStream.options(**OPTIONS).option("header", True).option("enforceSchema", not check_header)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return _checked(reader.schema(text_schema([f.name for f in fields])).csv(folder), fields, on_bad)


def _checked(cells_of: DataFrame, fields: Sequence[Field], on_bad: str) -> DataFrame:
    text = {f.name: cells.normalize_cell(column(f.name)) for f in fields}
    values, faults = [], []
    for f in fields:
        value = cells.cast_text(text[f.name], f.type)
        bad = text[f.name].isNotNull() & value.isNull()
        if not f.nullable:
            bad = bad | text[f.name].isNull()
        shown = F.concat(F.lit(f"{f.name}="), F.coalesce(text[f.name], F.lit("")))
        faults.append(F.when(bad, shown))
        if on_bad == "fail":
            value = F.when(bad, F.raise_error(F.concat(F.lit("invalid_field_value: "), shown))).otherwise(value)
        values.append(value.alias(f.name, metadata=f.metadata))
    if on_bad == "mark":
        found = F.array_compact(F.array(*faults))
        values.append(F.when(F.size(found) > 0, F.array_join(found, "; ")).alias(BAD))
    return cells_of.select(*values)


def accepted(stream: DataFrame) -> DataFrame:
    """The rows of a marked stream whose cells all fit."""
    return stream.where(F.col(BAD).isNull()).drop(BAD)


def rejected(stream: DataFrame) -> DataFrame:
    """The others, with the offending cells in ``BAD``."""
    return stream.where(F.col(BAD).isNotNull())


def as_table(spark: SparkSession, target: str, fields: Sequence[Field]) -> DataFrame:
    """What a stream has written so far as a table: declared fields and row ids, batch by batch."""
    stored = committed(spark, target)
    return stored.select(column(ROW_ID), *[column(f.name).alias(f.name, metadata=f.metadata) for f in fields])


def committed(spark: SparkSession, target: str) -> DataFrame:
    """The committed rows of ``ingest`` with row ids that stay when later batches arrive."""
    return BatchTable(spark, target).rows()


def apply_steps(stream: DataFrame, steps: Sequence[Step], *, event_time: str | None = None, delay: str | None = None) -> DataFrame:
    """A recipe on a stream.

    Row steps are those of the batch.  ``deduplicate`` keeps the row that arrives first among equal
    keys within ``delay`` of event time, and forgets keys behind the watermark.
    """
    flow = Flow(stream)
    for step in sorted(steps, key=lambda s: s.order):
        if step.operation == "deduplicate":
            if not event_time or not delay:
                raise WorkspaceError("invalid_cleaning_step", "deduplicate on a stream needs event_time and delay")
            keys = step.config.get("fields") or []
            if not keys or not set(keys) <= set(flow.df.columns):
                raise WorkspaceError("invalid_cleaning_step", "deduplicate needs existing fields")
            flow = flow.to(_deduplicate(flow.df, keys, event_time, delay))
        elif step.operation in ROW_STEPS:
            flow = fold(flow, [step])
        else:
            raise WorkspaceError("invalid_cleaning_step", f"{step.operation!r} is not defined on a stream")
    return flow.df


def _deduplicate(df: DataFrame, keys: list[str], event_time: str, delay: str) -> DataFrame:
    """Watermarks want an instant; wall-clock times are taken as UTC."""
    moment = column(event_time)
    if isinstance(df.schema[event_time].dataType, T.TimestampNTZType):
        start = F.lit("1970-01-01").cast("timestamp_ntz")
        moment = F.timestamp_micros(F.timestamp_diff("MICROSECOND", start, moment))
    timed = df.withColumn("_event_time", moment).withWatermark("_event_time", delay)
    return timed.dropDuplicatesWithinWatermark(keys).drop("_event_time")


def ingest(
    stream: DataFrame, target: str, checkpoint: str, *, deduplicate: Sequence[str] = (), order_by: Sequence[str] = (),
) -> StreamingQuery:
    """Write what has arrived and stop; a later call goes on with the files that are new since.

    The checkpoint and the ledger of the target make each input row appear once, also after a crash; read it with
    ``committed`` or ``as_table``. ``deduplicate`` names fields of which each combination of values is kept once in the whole table,
    without a watermark: its first row, which is the batch's result over ``as_table``. Rows of a batch are
    numbered in the order of ``order_by``, else as they arrive.
    """
    unknown = {*deduplicate, *order_by} - set(stream.columns)
    if unknown:
        raise WorkspaceError("invalid_cleaning_step", f"No such field: {', '.join(sorted(unknown))}")

    def commit(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        query = session.sparkContext.getLocalProperty("sql.streaming.queryId")
        if not query:
            raise WorkspaceError("stream_unknown", "the batch belongs to no query")
        BatchTable(session, target).append(batch, query, number, keys=deduplicate, order_by=order_by)

    writer = stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query
