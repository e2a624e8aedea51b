"""Sharding by a two-pass external shuffle.

Pass one scatters the records over memory-sized buckets by a seeded hash. Pass two reads each bucket,
puts it into a seeded Fisher-Yates order and writes it. Buckets laid end to end number all records
without a gap; number modulo shards is the shard, so shard sizes are at most one row apart.

The hash takes the record's place in the input besides its key: copies of one row, however many,
spread evenly. The order depends on the seed and on the input's splits, and is fixed once written, so
a lost executor cannot change it. Null keys and texts are records like others; an empty table gives
empty shards. A single record larger than a bucket is a bucket of its own size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import stage

from .common import register, schema_of, table

BUCKET_BYTES = 8 << 20
ROW_BYTES = 64


def external_shuffle(df: DataFrame, text: str = "text", seed: int = 7, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(bucket, place, rec): all records, each bucket in shuffled order and written to the shared folder."""
    held = df.agg(F.sum(F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + F.lit(ROW_BYTES))).first()[0] or 0
    buckets = 1 + int(held // bucket_bytes)
    rows = df.select(F.monotonically_increasing_id().alias("at"), F.struct("*").alias("rec"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "at"), F.lit(buckets)).cast("int"))

    def shuffle(group: pa.Table) -> pa.Table:
        group = group.sort_by("at")  # fetched in any order; the written order must not depend on that
        rng = np.random.default_rng([seed, group.column("bucket")[0].as_py()])
        order = np.arange(group.num_rows)
        for i, j in zip(range(len(order) - 1, 0, -1), rng.integers(0, np.arange(len(order), 1, -1)).tolist()):
            order[i], order[j] = order[j], order[i]
        shuffled = group.take(pa.array(order))
        return pa.table([
            shuffled.column("bucket"), pa.array(np.arange(len(order)), pa.int64()), shuffled.column("rec")
        ], names=["bucket", "place", "rec"])

    schema = schema_of("bucket int, place bigint", rows.select("rec").schema)
    rows = rows.withColumn("rec", F.col("rec").cast(schema["rec"].dataType))
    spread = rows.repartition(max(buckets, 1), "bucket") if buckets > 1 else rows
    return stage(spread.groupBy("bucket").applyInArrow(shuffle, schema), "shards")


def deal(shuffled: DataFrame, shards: int) -> DataFrame:
    """``external_shuffle`` rows with shard and slot; rows per shard differ by one at most."""
    sizes = shuffled.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))  # a row per bucket
    offsets = sizes.select("bucket", F.coalesce(before, F.lit(0)).alias("offset"))
    number = F.col("offset") + F.col("place")
    return shuffled.join(offsets, "bucket").select(
        "*", F.pmod(number, F.lit(shards)).cast("int").alias("shard"), F.floor(number / shards).cast("bigint").alias("slot")
    )


def write_shards(df: DataFrame, path: str, shards: int, text: str = "text", seed: int = 7) -> None:
    """Shuffled records as Parquet, a folder for each shard, in slot order within each file."""
    dealt = deal(external_shuffle(df, text, seed), shards).select("rec.*", "shard", "slot")
    dealt.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


@register("op7_external_shuffle")
def op7(spark, sf_dir):
    """All documents in 24 shards; the digest is taken from the records as they lie in the shards."""
    shuffled = external_shuffle(table(spark, sf_dir, "documents"))
    text = F.coalesce(F.col("rec.text"), F.lit(""))
    digest = shuffled.select(
        "bucket", "place", F.col("rec.doc_id").alias("doc_id"), (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    return deal(digest, 24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
