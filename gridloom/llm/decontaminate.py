"""Benchmark decontamination by a distributed positional inverted index.

The training texts are cut into blocks of documents. Each task numbers the words of its block in one
line, documents apart by a gap, and writes for every term the sorted list of its places: a posting row
(block, term). Test items become windows of consecutive words. In each block a window is found by
taking the list of its rarest term, adjusting it by the term's offset, and intersecting it with the adjusted
lists of the other terms, rarest first: what is left are the places of the exact phrase. Proximity
matches let each word lie up to ``slack`` places off, as seen from the rarest, whose document has the match.

Only postings of terms that occur in test items leave the index, grouped by block, so a group is bounded by
the block size however common a term is. Test items are taken in runs of bounded size, each run against all
blocks. The index is written to the shared folder once.

A null or wordless text has no words and no hits; a null or wordless item has no window; items with equal ids
count once, and a null id counts as the id "" (empty). A very long text is indexed whole, in one block. Repeated
documents are judged row by row. Empty tables give empty or clean results. Records travel in a struct, so column
names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import stage

from .common import blocks, register, schema_of, table, text_bytes, tidy, utf8

BLOCK_BYTES = 6 << 20
RUN_BYTES = 8 << 20
WINDOW = 10
GAP = 64

#: Bytes that part words become spaces, A-Z lower case.
_WORD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters, A-Z in lower case."""
    return text.translate(_WORD).split()


class _Numbers(dict):
    """Numbers words in the order they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def grouped_places(ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places sorted by id, stably, and where each id's places end. Radix passes of 16 bits."""
    order = np.argsort((ids & 0xFFFF).astype(np.uint16), kind="stable")
    if n > 0x10000:
        order = order[np.argsort((ids[order] >> 16).astype(np.uint16), kind="stable")]
    return order, np.cumsum(np.bincount(ids, minlength=n))


def packed_steps(steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit numbers as bytes of 7 bits, low ones first, all but a number's last marked by their top bit; and where each number ends."""
    more = [np.flatnonzero(steps >= 1 << 7 * i) for i in range(1, 5)]
    sizes = np.ones(len(steps), np.int64)
    for at in more:
        sizes[at] += 1
    ends = np.cumsum(sizes)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    first = ends - sizes
    out[first] = steps & 127
    for i, at in enumerate(more, 1):
        out[first[at] + i - 1] |= 128
        out[first[at] + i] = steps[at] >> 7 * i & 127
    return out, ends


def opened_steps(packed: bytes) -> np.ndarray:
    """The numbers of ``packed_steps``."""
    raw = np.frombuffer(packed, np.uint8)
    ends = np.flatnonzero(raw < 128) + 1
    first = np.concatenate(([0], ends[:-1]))
    out = (raw[first] & 127).astype(np.int64)
    for i in range(1, 5):
        at = np.flatnonzero(ends - first > i)
        out[at] |= (raw[first[at] + i] & 127).astype(np.int64) << 7 * i
    return out


def build_index(docs: DataFrame, text: str = "text", keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, term, n, places, rec, start): a row for each term of each block, and one (null term) for each document.

    ``places`` are differences as ``packed_steps`` writes them. For a document ``n`` counts its words and ``start`` is its first place.
    """
    kept = [F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]
    rows = docs.select(
        F.struct(*kept).alias("rec"), F.col(text).cast("string").alias("text"), F.spark_partition_id().alias("part")
    )
    schema = schema_of("block bigint, term binary, n bigint, places binary", rows.select("rec").schema, "start bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, pieces in enumerate(blocks(batches, text_bytes, block_bytes)):
            number = pieces[0].column(2)[0].as_py() << 32 | k
            ids_of, spread, starts, lengths, at = _Numbers(), [], [], [], 0
            for piece in pieces:
                for value in utf8(piece):
                    found = words(value) if value else []
                    starts.append(at)
                    lengths.append(len(found))
                    if found:
                        spread.append((np.fromiter(map(ids_of.__getitem__, found), np.int32, len(found)), at))
                    at += len(found) + GAP
            rec = pa.concat_arrays([p.column(0) for p in pieces])
            n = len(starts)
            fields = pa.schema([
                ("block", pa.int64()), ("term", pa.binary()), ("n", pa.int64()), ("places", pa.binary()),
                pa.field("rec", rec.type), ("start", pa.int64()),
            ])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n, number)), pa.nulls(n, pa.binary()), pa.array(lengths, pa.int64()), pa.nulls(n, pa.binary()),
                rec, pa.array(starts, pa.int64()),
            ], schema=fields)
            if not spread:
                continue
            ids = np.concatenate([s for s, _ in spread])
            place = np.concatenate([np.arange(a, a + len(s), dtype=np.uint32) for s, a in spread])
            order, ends = grouped_places(ids, len(ids_of))
            place = place[order]
            first = np.concatenate(([0], ends[:-1]))
            steps = np.diff(place, prepend=np.uint32(0))
            steps[first] = place[first]
            terms, count = list(ids_of), np.diff(ends, prepend=0)
            for a in range(0, len(terms), 20_000):
                b = min(a + 20_000, len(terms))
                packed, cut = packed_steps(steps[first[a]:ends[b - 1]])
                offsets = np.concatenate(([0], cut[ends[a:b] - first[a] - 1])).astype(np.int32)
                payload = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(b - a, number)), pa.array(terms[a:b], pa.binary()), pa.array(count[a:b]), payload,
                    pa.nulls(b - a, rec.type), pa.nulls(b - a, pa.int64()),
                ], schema=fields)

    return stage(rows.mapInArrow(tidy(run), schema), "postings")


class Windows:
    """The distinct windows of a run of items, over the run's own term numbers."""

    def __init__(self, window: int):
        self.window, self.numbers, self.items = window, _Numbers(), {}

    def add(self, item: str, text: bytes) -> None:
        ids = [self.numbers[w] for w in words(text)]
        for i in range(max(len(ids) - self.window, 0) + 1 if ids else 0):
            self.items.setdefault(tuple(ids[i:i + self.window]), set()).add(item)


def runs(items: DataFrame, item_id: str, text: str, window: int, run_bytes: int) -> Iterator[Windows]:
    """Items taken a partition at a time, packed into runs of about ``run_bytes`` of text."""
    now, held = Windows(window), 0
    for row in items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")), F.col(text).cast("string")).toLocalIterator():
        value = (row[1] or "").encode()
        now.add(row[0], value)
        held += len(value)
        if held >= run_bytes:
            yield now
            now, held = Windows(window), 0
    if now.items:
        yield now


def phrase_places(window: tuple[int, ...], count: np.ndarray, places: callable, slack: int = 0) -> np.ndarray:
    """Starts of the window: the rarest term's list, adjusted, intersected with the others' from rare to common."""
    order = np.argsort(count[list(window)], kind="stable").tolist()
    starts = places(window[order[0]]) - order[0]
    for j in order[1:]:
        other = places(window[j])
        at = np.searchsorted(other, starts + (j - slack))
        near = other[np.minimum(at, len(other) - 1)]
        starts = starts[(near >= starts + (j - slack)) & (near <= starts + (j + slack))]
        if not len(starts):
            break
    return starts


def _finder(shipped, slack: int) -> Callable[[pa.Table], pa.Table]:
    """Finds a run's windows in the postings of one block."""

    def find(group: pa.Table) -> pa.Table:
        terms, listed = shipped.value
        docs = group.filter(pc.is_null(group.column("term")))
        starts = np.sort(docs.column("start").to_numpy())
        number = {t: i for i, t in enumerate(terms)}
        held = group.filter(pc.is_valid(group.column("term")))
        of_term = [number[t] for t in held.column("term").to_pylist()]
        raw = dict(zip(of_term, held.column("places").to_pylist()))
        count = np.zeros(len(terms), np.int64)
        count[of_term] = held.column("n").to_numpy()
        lists: dict[int, np.ndarray] = {}

        def places(t: int) -> np.ndarray:
            if t not in lists:
                lists[t] = np.cumsum(opened_steps(raw[t]))
            return lists[t]

        exact, near = {}, {}
        for terms_of, of in listed:
            if not count[list(terms_of)].all():
                continue
            found = phrase_places(terms_of, count, places)
            anchor = int(np.argmin(count[list(terms_of)]))  # a start may lie before its document, the rarest word does not
            close = np.setdiff1d(phrase_places(terms_of, count, places, slack), found) if slack else found[:0]
            for many, into, width in ((found, exact, len(terms_of)), (close, near, 0)):
                doc = np.searchsorted(starts, many + anchor, "right") - 1
                for d in np.unique(doc).tolist():
                    inside = np.maximum(many[doc == d] - starts[d], 0)
                    for item in of:
                        into.setdefault((d, item), []).append((inside, inside + width))
        rows = []
        for d, item in sorted(exact.keys() | near.keys()):
            spans = exact.get((d, item), [])
            rows.append({
                "block": group.column("block")[0].as_py(), "start": int(starts[d]), "item": item,
                "spans": merged(np.concatenate([s for s, _ in spans]), np.concatenate([e for _, e in spans])) if spans else [],
                "near": sorted({x for s, _ in near.get((d, item), []) for x in s.tolist()}),
            })
        kind = pa.schema([
            ("block", pa.int64()), ("start", pa.int64()), ("item", pa.string()),
            ("spans", pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))), ("near", pa.list_(pa.int32())),
        ])
        return pa.Table.from_pylist(rows, kind)

    return find


def search(
    index: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW,
    slack: int = 0, run_bytes: int = RUN_BYTES,
) -> DataFrame:
    """(block, start, item, spans, near): for each document and item with a match, the matched word spans and near starts.

    Spans are [from, to) in words of the document, merged where they touch; ``near`` holds where a proximity
    match starts that is no exact one.
    """
    if not 0 <= slack < GAP // 2:
        raise ValueError(f"slack must lie in 0..{GAP // 2 - 1}")
    spark = index.sparkSession
    schema = "block bigint, start bigint, item string, spans array<struct<from:int, to:int>>, near array<int>"
    out = None
    for asked in runs(items, item_id, text, window, run_bytes):
        terms = list(asked.numbers)
        listed = [(w, sorted(of)) for w, of in asked.items.items()]
        shipped = spark.sparkContext.broadcast((terms, listed))  # bounded by run_bytes

        vocabulary = spark.createDataFrame([(bytearray(t),) for t in terms], "term binary")
        wanted = index.select("block", "term", "n", "places", "start")
        wanted = wanted.where("term is null").unionAll(wanted.join(F.broadcast(vocabulary), "term", "left_semi").select(*wanted.columns))
        found = wanted.groupBy("block").applyInArrow(_finder(shipped, slack), schema)
        out = found if out is None else out.unionAll(found)
    return spark.createDataFrame([], schema) if out is None else out


def merged(start: np.ndarray, end: np.ndarray) -> list[dict[str, int]]:
    """Intervals as their union, in order."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], start[1:] > end[:-1]))
    last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(start) - 1]))
    return [{"from": int(a), "to": int(b)} for a, b in zip(start[new], end[last])]


def decontaminate(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    keep: list[str] | None = None, window: int = WINDOW, slack: int = 0,
) -> DataFrame:
    """(rec, n_words, n_hit, items, n_near, near_items): each record, its words, the words inside a match, the ids of the items
    matched, and with a ``slack`` the places where a proximity match starts that is no exact one, and the ids of their items.
    """
    index = build_index(docs, text, keep)
    hits = search(index, items, item_id, item_text, window, slack)
    start = F.struct(F.lit(0).alias("sum"), F.lit(-1).alias("to"))

    def step(done, s):
        fresh = F.greatest(s["to"] - F.greatest(s["from"], done["to"]), F.lit(0))
        return F.struct((done["sum"] + fresh).alias("sum"), F.greatest(done["to"], s["to"]).alias("to"))

    covered = F.aggregate(F.sort_array(F.flatten(F.collect_list("spans"))), start, step, lambda done: done["sum"])
    ids = lambda held: F.sort_array(F.collect_set(F.when(F.size(held) > 0, F.col("item"))))
    by_doc = hits.groupBy("block", "start").agg(
        covered.alias("n_hit"), ids("spans").alias("items"),
        F.size(F.array_distinct(F.flatten(F.collect_list("near")))).alias("n_near"), ids("near").alias("near_items"),
    )
    all_docs = index.where("term is null").select("block", "start", "rec", F.col("n").alias("n_words"))
    return all_docs.join(by_doc, ["block", "start"], "left").select(
        "rec", "n_words", F.coalesce(F.col("n_hit"), F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce(F.col("n_near"), F.lit(0)).cast("bigint").alias("n_near"),
        F.coalesce("near_items", F.array().cast("array<string>")).alias("near_items"),
    )


# The word pattern of the query's contract.
PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{PATTERN}') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{PATTERN}') AS w
  FROM benchmark
), q AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT item_id, w, least({WINDOW}, len(w)) AS k, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), o AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM q) WHERE len(w) >= k)
), m AS (SELECT doc_id, item_id, i, k FROM o JOIN q USING (k, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""


@register("op1_decontamination", SQL)
def op1(spark, sf_dir):
    """Every document against every benchmark item."""
    judged = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return judged.select(
        F.col("rec.doc_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
