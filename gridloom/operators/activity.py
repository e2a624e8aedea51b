"""Roll-ups of the activity tables: tasks, uploads, import history, query history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# States, task types and log actions.
EXTERNAL_IMPORTS = ("external_table_import", "external_sql_import")
QUERY_EXECUTED = "sql.query_executed"


def task_summary(tasks: DataFrame) -> DataFrame:
    state = F.col("status")
    return tasks.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(state == "success").alias("success"),
        F.count_if(state.isin("running", "pending")).alias("running"),
        F.count_if(state == "failed").alias("failed"),
        F.count_if(state == "retryable").alias("retryable"),
    )


def task_types(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("task_type").agg(F.count(F.lit(1)).alias("count"))


def upload_summary(uploads: DataFrame) -> DataFrame:
    return uploads.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "parsed").alias("parsed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )


def _typed(payload: Column, key: str, kind: str) -> Column:
    """A JSON member if it has the wanted type, else null."""
    member = F.try_variant_get(payload, f"$.{key}", "variant")
    schema = F.schema_of_variant(member)
    return F.when(schema == kind, F.try_variant_get(payload, f"$.{key}", kind if kind != "BIGINT" else "long"))


def import_history(tasks: DataFrame) -> DataFrame:
    """External imports with their settings, flattened from the JSON payload of the task.

    A member of the wrong type is null, as is the field count where no field is declared.
    """
    payload = F.try_parse_json(F.col("retry_payload"))
    imports = tasks.filter(F.col("task_type").isin(*EXTERNAL_IMPORTS)).withColumn("_payload", payload)
    p = F.col("_payload")
    members = F.try_variant_get(p, "$.fields", "array<variant>")
    declared = F.filter(members, lambda f: F.schema_of_variant(f).startswith("OBJECT"))
    kind = F.when(F.col("task_type") == "external_sql_import", "external_sql").otherwise("external_table")
    return imports.select(
        *[c for c in tasks.columns if c != "retry_payload"],
        kind.alias("source_type"),
        *[_typed(p, k, "STRING").alias(k) for k in ("connection_id", "dataset_name", "schema_name", "table_name", "sql")],
        _typed(p, "limit", "BIGINT").alias("limit"),
        F.nullif(F.size(declared), F.lit(0)).alias("field_count"),
    )


def log_query(df: DataFrame, sql: Column, row_count: Column) -> DataFrame:
    """Log rows for executed queries: the action and its JSON detail."""
    detail = F.to_json(F.struct(sql.alias("sql"), row_count.cast("long").alias("row_count")))
    return df.select("*", F.lit(QUERY_EXECUTED).alias("action"), detail.alias("detail"))


def query_history(log: DataFrame) -> DataFrame:
    """The executed queries read back from the log."""
    detail = F.from_json(F.col("detail"), "sql string, row_count long")
    executed = log.filter(F.col("action") == QUERY_EXECUTED).withColumn("_d", detail)
    kept = [c for c in log.columns if c not in ("action", "detail")]
    return executed.select(*kept, F.col("_d.sql").alias("sql"), F.col("_d.row_count").alias("row_count"))
