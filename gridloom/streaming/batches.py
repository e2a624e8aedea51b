"""Tables that grow batch by batch, each batch committed once, with row ids that never move.

A batch is written to a folder of its own, which its query and number name, so that a replay overwrites what a lost run
left. Then one numbered entry of the ledger, created only if it is absent, makes it part of the table and fixes the id of its first
row. Readers take the folders that the ledger names. Inside a batch the rows are numbered by file and place, as in
any table, so ids are gapless and those of earlier batches stay when later ones arrive.

With keys, a row is kept only if no earlier row has its key: the first of a batch by ``order_by``, and none whose key an earlier batch
holds. The keys seen are kept as digests of 128 bits beside the rows, so a batch reads two numbers of each row
kept so far.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import WorkspaceError
from ..operators import row_id
from ..operators.profile import digest
from ..session import create_if_absent
from ..types import ROW_ID, column

BATCH, KEYS = "_batch", ("_key0", "_key1")
ENTRY = "seq long, query string, batch long, folder string, first_id long, rows long"


class BatchTable:
    def __init__(self, spark: SparkSession, target: str) -> None:
        self.spark, self.target = spark, target.rstrip("/")
        self._ledger = f"{self.target}/_ledger"

    def exists(self) -> bool:
        context = self.spark.sparkContext
        folder = context._jvm.org.apache.hadoop.fs.Path(self._ledger)
        return folder.getFileSystem(context._jsc.hadoopConfiguration()).exists(folder)

    def ledger(self) -> DataFrame:
        """One row a committed batch: (seq, query, batch, folder, first_id, rows)."""
        if not self.exists():
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).option("pathGlobFilter", "*.json").json(self._ledger)

    def _stored(self) -> DataFrame:
        return self.spark.read.option("basePath", self.target).parquet(f"{self.target}/{BATCH}=*")

    def rows(self) -> DataFrame:
        """The committed rows with their ids."""
        if self.ledger().isEmpty():
            raise WorkspaceError("physical_table_not_found", f"No batch committed at {self.target}")
        stored = self._stored()
        names = [c for c in stored.columns if c not in (BATCH, *KEYS)]
        located = stored.select(
            *[column(c) for c in names], BATCH, F.col("_metadata.file_path").alias(row_id.PATH), F.col("_metadata.row_index").alias(row_id.MARK)
        )
        files = located.groupBy(BATCH, row_id.PATH).agg(F.count(F.lit(1)).alias("rows"))
        before = Window.partitionBy(BATCH).orderBy(*row_id.file_order()).rowsBetween(Window.unboundedPreceding, -1)
        files = files.select(BATCH, row_id.PATH, F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
        committed = self.ledger().select(F.col("folder").alias(BATCH), "first_id")
        starts = files.join(committed, BATCH).select(row_id.PATH, (F.col("first_id") + F.col("offset")).alias("start"))
        joined = located.join(starts, row_id.PATH)
        return joined.select((F.col("start") + F.col(row_id.MARK)).alias(ROW_ID), *[column(c) for c in names])

    def _unseen(self, batch: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
        """The first row of each key that no committed batch holds, in the order given, else as they come."""
        order = [column(c) for c in order_by] or [F.col("_place")]
        placed = batch.withColumn("_place", F.monotonically_increasing_id())
        first = Window.partitionBy(*[column(k) for k in keys]).orderBy(*order)
        once = placed.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank", "_place")
        keyed = once.select("*", *[d.alias(k) for d, k in zip(digest(*[column(k) for k in keys]), KEYS)])
        committed = self.ledger()
        if committed.isEmpty():
            return keyed
        stored = self._stored()
        if not set(KEYS) <= set(stored.columns):
            raise WorkspaceError("invalid_cleaning_step", "the table was begun without deduplication")
        seen = stored.join(committed.select(F.col("folder").alias(BATCH)), BATCH, "left_semi").select(*KEYS)
        return keyed.join(seen, list(KEYS), "left_anti").select(*keyed.columns)

    def append(self, batch: DataFrame, query: str, number: int, *, keys: Sequence[str] = (), order_by: Sequence[str] = ()) -> None:
        """Commit a batch of a query, once however often it is replayed."""
        if not self.ledger().where((F.col("query") == query) & (F.col("batch") == number)).isEmpty():
            return
        clash = {BATCH, *KEYS} & {c.lower() for c in batch.columns}
        if clash:
            raise WorkspaceError("invalid_dataset_fields", f"reserved field names: {', '.join(sorted(clash))}")
        kept = self._unseen(batch, keys, order_by) if keys else batch
        if order_by:
            kept = kept.orderBy(*[column(c) for c in order_by])
        folder = f"{query}-{number}"
        path = f"{self.target}/{BATCH}={folder}"
        kept.write.mode("overwrite").parquet(path)
        rows = self.spark.read.schema(kept.schema).parquet(path).count()  # from the footers
        self._commit({"query": query, "batch": number, "folder": folder, "rows": rows}, deduplicated=bool(keys))

    def _commit(self, entry: dict, deduplicated: bool) -> None:
        done = self.ledger().agg(F.max("seq"), F.max(F.col("first_id") + F.col("rows"))).first()
        seq = (done[0] or 0) + 1
        entry = {"seq": seq, "first_id": done[1] or 1, **entry}
        if create_if_absent(self.spark, f"{self._ledger}/{seq:020d}.json", json.dumps(entry)):
            return
        if deduplicated:  # the other writer's keys were not looked at
            raise WorkspaceError("table_changed", "another query committed to the table; run again")
        self._commit({k: v for k, v in entry.items() if k not in ("seq", "first_id")}, deduplicated)
