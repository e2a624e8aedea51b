"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

1. language ID drops the documents whose language cannot be told (``und``, or two codewords too close);
2. the n-gram Jaccard join keeps one document of each group of near copies;
3. benchmark decontamination drops the documents that hold a window of a benchmark item;
4. the secret scan replaces every secret by a mark;
5. BPE encodes what is left, and decodes it again.

All stages but the last return the columns of ``documents``.

A null or empty text has no language and leaves in stage 1. Repeated rows count as copies: one of them stays. Very long
texts are handled whole. Further columns travel on whatever their names, also through stages that make columns of the same
name, which only the last adds (there the made ones win). An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe, decontaminate, jaccard_join, language_id, secret_scan
from gridloom.llm.common import KeyFilter, table
from gridloom.session import drop_staged, fresh_path, small_batches, stage, staged

#: Columns that the last stage makes.
MADE = ("n_tokens", "ids_sha256", "decoded_sha256")


def _columns(docs: DataFrame) -> list:
    """The columns of ``docs`` out of an operator's record."""
    return [F.col(f"rec.`{c}`").alias(c) for c in docs.columns]


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = language_id.identify(docs, language_id.learn(docs))
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & ~F.col("ambiguous")).select(*_columns(docs))


def _key(doc_id, text_hash) -> Column:
    return F.xxhash64(doc_id, text_hash)


def _without(docs: DataFrame, touched: DataFrame) -> DataFrame:
    """``docs`` less the rows that ``touched`` (doc_id, text_hash, stays) names; of rows that stay, repeated ones leave.

    Only documents whose key may be touched are shuffled, as whole records in a struct.
    """
    may_be_touched = KeyFilter(touched.select(_key("doc_id", "text_hash")))
    rows = docs.select(F.struct("*").alias("rec")).withColumn("hash", F.xxhash64("rec.text"))
    maybe = F.coalesce(may_be_touched.column(_key("rec.doc_id", "hash")), F.lit(False))
    named = touched.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("of"), "stays")
    judged = rows.where(maybe).join(named, F.col("rec.doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("of")), "left")
    once = judged.where("stays").withColumn("id", F.col("rec.doc_id")).dropDuplicates(["id", "hash"])
    left = rows.where(~maybe).select("rec").unionAll(judged.where("stays is null").select("rec")).unionAll(once.select("rec"))
    return left.select(*_columns(docs))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The groups are found without carrying the texts along; documents without words are no copies of one another."""
    groups = jaccard_join.join_groups(docs, keep=["doc_id"])
    by_key = groups.groupBy(F.col("rec.doc_id").alias("doc_id"), "text_hash").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("first").alias("stay"),
    )
    touched = by_key.where("stay < rows").select("doc_id", "text_hash", (F.col("stay") > 0).alias("stays"))
    return _without(docs, stage(touched, "copies"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The index carries ids and hashes only."""
    slim = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    judged = decontaminate.decontaminate(slim, table(spark, sf_dir, "benchmark"), keep=["doc_id", "text_hash"])
    hit = judged.where("n_hit > 0").select("rec.doc_id", "rec.text_hash", F.lit(False).alias("stays")).distinct()
    return _without(docs, stage(hit, "contaminated"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(docs)
    old = F.col("rec.text")
    marked = found.select("rec", "spans", secret_scan.redact(old, F.col("spans")).alias("marked"))
    changed = (F.size("spans") > 0) & F.col("marked").isNotNull()
    new = {
        "text": F.when(changed, F.col("marked")).otherwise(old),
        "n_chars": F.when(changed, F.length("marked").cast("bigint")).otherwise(F.col("rec.n_chars")),
    }
    return marked.select(*[new.get(c, F.col(f"rec.`{c}`")).alias(c) for c in docs.columns])


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = bpe.encode(docs, bpe.vocabulary_path(), keep=[c for c in docs.columns if c not in ("text", "n_chars", *MADE)])
    kept = [F.col(f"rec.`{c}`").alias(c) for c in docs.columns if c not in ("text", "n_chars", *MADE)]
    return coded.select(
        *kept, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


_before: list[tuple[int, int]] = []


def _alone(step):
    """A stage that first drops what the stages before it had staged: their results are written by then.

    Its rows travel in small batches, as executors and their workers hold whole texts.
    """

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        while _before:
            drop_staged(spark, *_before.pop())
        start = staged()
        out = step(spark, docs, sf_dir)
        _before.append((start, staged()))
        return out

    return run_stage


STAGES = [
    ("language ID", _alone(keep_known_languages)), ("n-gram Jaccard join", _alone(keep_one_of_each_group)),
    ("benchmark decontamination", _alone(drop_contaminated)), ("secret scan", _alone(mask_secrets)), ("BPE", _alone(tokenize)),
]

#: The output of a trained classifier and of BPE merges is not expressible in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        path = fresh_path(spark, "pipeline-" + name.replace(" ", "-"))
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": run}
ORACLE = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
