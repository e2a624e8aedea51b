"""Ranked lexical search by norm buckets of impact vectors.

A document's vector has an impact for each term that queries ask for; a query's holds how often it has each term;
the score is their inner product. The documents are cut into blocks of bounded bytes. In a block the vectors are
ordered by length and cut into buckets. A query meets the buckets from long to short: once its own length times the
bucket's falls below the query's worst score still held, no later bucket can have a better one (Cauchy-Schwarz). Inside a
bucket it takes its coordinates by falling bound (its own times the bucket's largest impact): while the coordinates
left could still lift an unseen vector over that score, their lists add to partial scores; then only vectors whose
partial score and bound reach it survive, and those are scored exactly, in integers. A task holds the best of each query
over all its blocks, so the bar rises as it reads; the best of all tasks are ranked by a window.

Two passes: the first reads the texts once, writes each block's term counts for the query terms and the numbers that
the weights need; the second reads those counts only. Queries are taken in runs of about RUN_BYTES of text,
dealt by a hash of the text; a run's terms and queries are what is broadcast. Each run meets all documents.

A null text has no terms and scores nowhere; an item without terms has no results. Equal scores are ordered by id, a
null id first. Repeated documents are documents of their own and may follow one another in a ranking; so may repeated
items, whose rankings are then equal. A very long text is a block of its own. Only the named columns are read, so
further columns cannot clash. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import stage
from gridloom.types import column

from .common import blocks, register, schema_of, table, text_bytes, utf8
from .decontaminate import words

BLOCK_BYTES = 8 << 20
RUN_BYTES = 4 << 20
BUCKET_ROWS = 512
#: A bucket also ends where lengths fall below this share of its longest.
BUCKET_SHARE = 0.8
#: Lengths are doubles: bounds made of them are taken this much larger.
ABOVE = 1 + 1e-9

TOTALS = "docs bigint, words bigint"
COUNTS = "ids array<bigint>, n array<bigint>, ends array<bigint>, term array<int>, tf array<bigint>, "


def count_terms(docs: DataFrame, terms: list[bytes], doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each block: its documents that hold a query term, with their counts, and its numbers of documents and words."""
    shipped = docs.sparkSession.sparkContext.broadcast(terms)
    rows = docs.select(column(doc_id).cast("bigint").alias("id"), column(text).cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(shipped.value)}.get
        for pieces in blocks(batches, text_bytes, block_bytes):
            held, lengths, term, tf, ends, docs_n, words_n, at = [], [], [], [], [], 0, 0, 0
            for piece in pieces:
                for i, value in enumerate(utf8(piece)):
                    found = words(value) if value else []
                    if not found:
                        continue
                    docs_n += 1
                    words_n += len(found)
                    mine = [k for k in map(number, found) if k is not None]
                    if mine:
                        ids, count = np.unique(np.array(mine, np.int32), return_counts=True)
                        term.append(ids)
                        tf.append(count)
                        at += len(ids)
                        ends.append(at)
                        lengths.append(len(found))
                        held.append(piece.column(0)[i].as_py())
            whole = np.concatenate(term) if term else np.zeros(0, np.int32)
            distinct, df = np.unique(whole, return_counts=True)
            lists = [
                (held, pa.int64()), (lengths, pa.int64()), (ends, pa.int64()), (whole, pa.int32()),
                (np.concatenate(tf) if tf else np.zeros(0, np.int64), pa.int64()), (distinct, pa.int32()), (df, pa.int64()),
            ]
            arrays = [pa.array([v], pa.list_(t)) for v, t in lists]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array([docs_n], pa.int64()), pa.array([words_n], pa.int64())],
                names=["ids", "n", "ends", "term", "tf", "met", "df", "docs", "words"],
            )

    return stage(rows.mapInArrow(run, schema_of(COUNTS + "met array<int>, df array<bigint>, " + TOTALS)), "term-counts")


class Bucket:
    """Vectors of similar length: a list of (row, impact) for each term, and the longest length."""

    def __init__(self, row: np.ndarray, term: np.ndarray, impact: np.ndarray, longest: float):
        order = np.argsort(term, kind="stable")
        self.row, self.impact, self.longest = row[order], impact[order], longest
        terms, first = np.unique(term[order], return_index=True)
        last = np.append(first[1:], len(order))
        most = np.maximum.reduceat(self.impact, first) if len(first) else first
        self.lists = {t: (a, b, m) for t, a, b, m in zip(terms.tolist(), first.tolist(), last.tolist(), most.tolist())}


def cut_buckets(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """[from, to) of each bucket over falling lengths."""
    at = 0
    while at < len(lengths):
        similar = int(np.searchsorted(-lengths, -lengths[at] * BUCKET_SHARE, "right"))
        end = max(at + 1, min(similar, at + BUCKET_ROWS))
        yield at, end
        at = end


def search_bucket(bucket: Bucket, query: list[tuple[int, int]], rows: int, bar: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, exact scores) of all vectors of the bucket that score ``bar`` or more, and above 0."""
    lists = [(n * held[2], n, held) for t, n in query if (held := bucket.lists.get(t))]
    lists.sort(key=lambda x: -x[0])
    left = sum(bound for bound, _, _ in lists)
    bar = max(bar, 1)
    if left < bar:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    score = np.zeros(rows, np.int64)
    k = 0
    while k < len(lists) and left >= bar:  # what is left could still lift a vector not met so far
        bound, n, (a, b, _) = lists[k]
        score[bucket.row[a:b]] += n * bucket.impact[a:b]
        left -= bound
        k += 1
    alive = np.flatnonzero(score >= max(bar - left, 1))
    exact = score[alive]
    for _, n, (a, b, _) in lists[k:]:
        listed = bucket.row[a:b]
        at = np.minimum(np.searchsorted(listed, alive), b - a - 1)
        exact += np.where(listed[at] == alive, n * bucket.impact[a:b][at], 0)
    good = exact >= bar
    return alive[good], exact[good]


class Ranking:
    """The best documents of one query so far: (score, id), ties to the smaller id, null least."""

    def __init__(self, k: int):
        self.k, self.best, self.bar = k, [], 1

    def add(self, ids: list, scores: list[int]) -> None:
        rows = [(-s, i is not None, i or 0) for i, s in zip(ids, scores)]
        self.best = sorted(self.best + rows)[: self.k]
        if len(self.best) == self.k:
            self.bar = -self.best[-1][0]


def rank(counts: DataFrame, weights: np.ndarray, docs_n: int, words_n: int, queries: list[list[tuple[int, int]]], k: int) -> DataFrame:
    """(query, doc_id, score): the best of each task for each query."""
    shipped = counts.sparkSession.sparkContext.broadcast((weights, queries))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, asked = shipped.value
        lengths_of = [math.sqrt(sum(n * n for _, n in q)) * ABOVE for q in asked]
        held = [Ranking(k) for _ in asked]
        for batch in batches:
            for r in range(batch.num_rows):
                ids, n, ends, term, tf = (batch.column(c)[r].values for c in range(5))
                if not len(ids):
                    continue
                ids = ids.to_pylist()
                n, ends, term, tf = (v.to_numpy() for v in (n, ends, term, tf))
                size = np.diff(ends, prepend=0)
                m = 25 + (75 * n * docs_n) // words_n
                impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, size)))
                length = np.sqrt(np.add.reduceat(impact.astype(float) ** 2, ends - size)) * ABOVE
                order = np.argsort(-length, kind="stable")
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                row = np.repeat(place, size)
                by_row = np.argsort(row, kind="stable")
                row, term, impact = row[by_row], term[by_row], impact[by_row]
                falling = length[order]
                buckets = []
                for a, b in cut_buckets(falling):
                    lo, hi = np.searchsorted(row, [a, b])
                    buckets.append((a, b, Bucket(row[lo:hi] - a, term[lo:hi], impact[lo:hi], float(falling[a]))))
                for query, long, ranking in zip(asked, lengths_of, held):
                    for a, b, bucket in buckets:
                        if long * bucket.longest < ranking.bar:
                            break
                        rows, scores = search_bucket(bucket, query, b - a, ranking.bar)
                        if len(rows):
                            ranking.add([ids[i] for i in order[rows + a].tolist()], scores.tolist())
        found = [(q, i if there else None, -s) for q, r in enumerate(held) for s, there, i in r.best]
        if found:
            query, doc, score = zip(*found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(query, pa.int32()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], names=["query", "doc_id", "score"]
            )

    return counts.select("ids", "n", "ends", "term", "tf").mapInArrow(run, "query int, doc_id bigint, score bigint")


def query_runs(items: DataFrame, item_id: str, text: str, run_bytes: int) -> Iterator[list[tuple]]:
    """(id, text) of the items, in runs of about ``run_bytes``; no run depends on how many items there are."""
    rows = items.select(column(item_id).alias("id"), column(text).cast("string").alias("text")).where("text is not null")
    held = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    runs = 1 + held // run_bytes
    for run in range(runs):
        yield [tuple(r) for r in rows.where(F.pmod(F.xxhash64("text"), F.lit(runs)) == run).collect()]


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", block_bytes: int = BLOCK_BYTES, run_bytes: int = RUN_BYTES,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents that score highest for each item."""
    spark = docs.sparkSession
    id_type = items.select(column(item_id)).schema[0].dataType.simpleString()
    out = None
    for asked in query_runs(items, item_id, item_text, run_bytes):
        number: dict[bytes, int] = {}
        queries = []
        for _, value in asked:
            count: dict[int, int] = {}
            for w in words(value.encode()):
                t = number.setdefault(w, len(number))
                count[t] = count.get(t, 0) + 1
            queries.append(list(count.items()))
        if not number:
            continue
        counts = count_terms(docs, list(number), doc_id, text, block_bytes)
        docs_n, words_n = counts.agg(F.sum("docs"), F.sum("words")).first()
        if not words_n:
            continue
        pairs = counts.select(F.explode(F.arrays_zip("met", "df")).alias("p")).groupBy("p.met").agg(F.sum("p.df").alias("df"))
        weights = np.zeros(len(number), np.int64)
        for r in pairs.collect():  # a row for each term of the run
            weights[r["met"]] = math.floor(1000 * math.log((2 * docs_n + 2) / (2 * r["df"] + 1)))
        best = rank(counts, weights, docs_n, words_n, queries, k)
        names = spark.createDataFrame([(i, a[0]) for i, a in enumerate(asked)], f"query int, item_id {id_type}")
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc("doc_id")))
        top = best.withColumn("rank", place).where(F.col("rank") <= k)
        top = top.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")  # names: a row for each item of the run
        out = top if out is None else out.unionAll(top)
    return spark.createDataFrame([], f"item_id {id_type}, rank int, doc_id bigint, score bigint") if out is None else out


# The word pattern of the query's contract.
PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    f"'{PATTERN}')"
)
SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, row_number() OVER () AS i, {_WORDS} AS w FROM benchmark),
q AS (SELECT i, t, count(*) AS c FROM (SELECT i, unnest(w) AS t FROM b) GROUP BY i, t),
s AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS words FROM d WHERE len(w) > 0),
p AS (
  SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY r, t
), f AS (
  SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight
  FROM (SELECT t, count(*) AS df FROM p GROUP BY t), s
), v AS (
  SELECT r, t, doc_id, weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(w) * docs) // words))) AS impact
  FROM p JOIN d USING (r) JOIN f USING (t), s
), m AS (SELECT i, r, any_value(doc_id) AS doc_id, sum(c * impact)::BIGINT AS score FROM q JOIN v USING (t) GROUP BY i, r),
k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST) AS place FROM m WHERE score > 0)
SELECT item_id, place::INTEGER AS rank, doc_id, score FROM k JOIN b USING (i) WHERE place <= 10"""


@register("op13_ranked_search", SQL)
def op13(spark, sf_dir):
    """The ten best documents for each benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
