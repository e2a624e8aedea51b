"""N-gram Jaccard join, size-aware: small sets by fixed-size subsets, large sets by inverted lists.

A document's set is its distinct shingles of consecutive words. Equal sets are one class. Shingles are ordered
from rare to common by fixed-size count sketches of the whole corpus: first by how far a shingle's cell lies above the
usual load, then by the frequencies of its words. Any order gives exact results.
Two sets of Jaccard at least t overlap in c >= t * n shingles of either, so their (n - c + l)-prefixes in that
order share l shingles. Small sets are keyed by every 2-subset of their prefix (l = 2), large ones by every
shingle of theirs (l = 1): an inverted list. Sets whose partners may lie across the boundary get
both kinds of keys. The boundary minimises keys written plus list entries scanned, over the sizes met.

Keys travel packed, a blob for each task and bucket. A shingle that the sketch shows to be very common is hot: two hot
shingles make no 2-subset, the rarer one is a key by itself, and the entries of a hot key are dealt over many
buckets, so no task holds an unbounded list. Sets that share a key by chance, whose pairs grow with the square of the corpus,
part before any text moves, by two bounds that no link ever exceeds: a set leaves a list in which it stands too far behind in
the order to overlap enough with any other, and lists are split where the sets' odd cells differ too much (``odd_cells``).
Lists with two or more sets left make candidates. Candidates connected by
lists are verified together in one cell where their sets fit. Where they do not, each set is first met in one
of its lists, in chunks that fit a cell and share the list's pivot, so that near copies become connected; then only
lists with sets not yet connected are cut into chunks again, and each pair of chunks that may hold a new link is a
cell. In a cell overlaps are exact, each set against the sets it is not yet connected to. Only a spanning forest of
links leaves a cell, never all pairs of a group.

Null, empty and wordless texts have empty sets and link with nothing. Very long texts have whole sets. Repeated rows fall into one class. An
empty table gives an empty result. Records travel in a struct, so column names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import stage
from gridloom.types import column

from .common import KeyFilter, components, register, schema_of, slices, table, tidy, utf8

WIDTH, PERCENT = 4, 85
SKETCH_CELLS = 1 << 22  # of shingles; a quarter as many for words
SHINGLE_CHUNKS, WORD_CHUNKS = 64, 16
BUCKET_BYTES = 12 << 20
LIST_SETS = 200_000
CELL_SHINGLES = 2_000_000
MOST_SMALL = 512
FLUSH = 400_000
#: Rows (cell, sig) that are broadcast at most, some 80 bytes each.
SHIPPED_CELLS = 200_000
#: ``key`` has 48 bits, ``half`` is the second half of the signature: other sets that share either by chance are further candidates.
#: ``behind``: how many of the set's shingles a pair that first meets under this key cannot share, at least.
ENTRY = np.dtype([("key", "<u8"), ("half", "<u8"), ("n", "<i4"), ("behind", "<u2")])
WORDS_KEPT = 400_000
#: Odd cells of a set, at least; sets of a list all pairs of which are compared at once, at most; pairs of a longer list that are
#: compared, at most: with more it stays whole.
LEAST_CELLS, SHORT_LIST, MOST_PAIRS = 128, 25, 1 << 24
#: Bytes of a list's row with its odd cells, about.
MEMBER_BYTES = 160


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    """Sets of 64-bit shingle hashes, sorted."""

    def __init__(self, width: int = WIDTH):
        self.width, self.hashes = width, _Hashes()

    def words_of(self, text: bytes | None) -> np.ndarray:
        """Hashes of the words, in order."""
        words = text.lower().split() if text else []  # bytes: A-Z only, ASCII white space only
        if len(self.hashes) > WORDS_KEPT:
            self.hashes = _Hashes()
        return np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))

    def rolled(self, w: np.ndarray) -> np.ndarray:
        """Hashes of the shingles, in order."""
        n = len(w)
        if not n:
            return w
        width = min(n, self.width)
        h = np.full(n - width + 1, width, np.uint64)
        for k in range(width):
            h = mix(h + w[k:n - width + 1 + k])
        return h

    def set_of(self, text: bytes | None) -> np.ndarray:
        return np.unique(self.rolled(self.words_of(text)))

    def ranked_set(self, text: bytes | None, word_level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The set, and for each shingle the sum of its words' levels, at most 255."""
        w = self.words_of(text)
        s, first = np.unique(self.rolled(w), return_index=True)
        level = word_level[(w & np.uint64(len(word_level) - 1)).astype(np.int64)]
        width = min(len(w), self.width)
        total = np.convolve(level, np.ones(width, np.int64), "valid") if width else level
        return s, np.minimum(total[first], 255)


def signature(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def least_overlap(n: np.ndarray | int, percent: int):
    return (percent * n + 99) // 100


def least_shared(both: np.ndarray | int, percent: int):
    """The least overlap of two linked sets of so many shingles together."""
    return (percent * both + 99 + percent) // (100 + percent)


def odd_cells(s: np.ndarray) -> bytes:
    """Which cells hold an odd number of the set's shingles, a bit each; cells are a power of two, over half the set's size.

    Two sets differ in as many shingles at least as their odd cells differ in bits; the halves of a longer one, one xor
    the other, are the odd cells of half as many.
    """
    cells = max(LEAST_CELLS, 1 << (len(s).bit_length() - 1) if len(s) else 0)
    at = (s >> np.uint64(24) & np.uint64(cells - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=cells) & 1).tobytes()


def packed_counts(counts: np.ndarray) -> bytes:
    """Numbers of 32 bits byte by byte (all lowest bytes, all second ones, ...): few cells need more than the lowest."""
    return zstandard.compress(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def opened_counts(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def packed_entries(e: np.ndarray) -> bytes:
    """Byte by byte, like counts: most of what can be saved is the high bytes."""
    return zstandard.compress(e.view(np.uint8).reshape(-1, ENTRY.itemsize).T.tobytes(), 1)


def opened_entries(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(ENTRY.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(ENTRY).ravel()


def summarise(docs: DataFrame, text: str, keep: list[str] | None, width: int, cells: int) -> DataFrame:
    """Rows of documents (rec, n, sig, odd, th) and, at each task's end, rows of its sketch (chunk, part, counts)."""
    kept = [F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]
    value = F.col(text).cast("string")
    rows = docs.select(F.struct(*kept).alias("rec"), F.xxhash64(value).alias("th"), F.spark_partition_id().alias("part"), value.alias("text"), F.monotonically_increasing_id().alias("at"))
    schema = schema_of(rows.select("rec").schema, "th bigint, at bigint, n bigint, sig binary, odd binary, chunk int, part int, counts binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, total, part, rec_type, waiting, held = Shingler(width), np.zeros(cells + cells // 4, np.uint32), 0, None, [], 0
        mask, word_mask = np.uint64(cells - 1), np.uint64(cells // 4 - 1)

        def count() -> None:
            total[:] += np.bincount(np.concatenate(waiting), minlength=len(total)).astype(np.uint32)
            waiting.clear()

        for batch in slices(batches, 512):
            sets = []
            for t in utf8(batch):
                w = shingler.words_of(t)
                s = np.unique(shingler.rolled(w))
                sets.append(s)
                waiting += [(s & mask).astype(np.int32), (w & word_mask).astype(np.int32) + np.int32(cells)]
                held += len(w)
                if held > 2_000_000:
                    count()
                    held = 0
            n, part, rec_type = batch.num_rows, batch.column(2)[0].as_py(), batch.schema.field(0).type
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), batch.column(4), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([signature(s) if len(s) else None for s in sets], pa.binary()),
                pa.array([odd_cells(s) if len(s) else None for s in sets], pa.binary()),
                pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()),
            ], names=["rec", "th", "at", "n", "sig", "odd", "chunk", "part", "counts"])
        if rec_type is not None:
            if waiting:
                count()
            parts = [packed_counts(p) for p in np.split(total, SHINGLE_CHUNKS + WORD_CHUNKS)]
            n = len(parts)
            yield pa.RecordBatch.from_arrays([
                pa.nulls(n, rec_type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()),
                pa.array(range(n), pa.int32()), pa.array([part] * n, pa.int32()), pa.array(parts, pa.binary()),
            ], names=["rec", "th", "at", "n", "sig", "odd", "chunk", "part", "counts"])

    return stage(rows.mapInArrow(tidy(run), schema), "jaccard-sets")


def sketch_of(summary: DataFrame, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """The summed sketches of shingles and words; their size is fixed. Tasks are summed by the thousand first."""
    size = cells // SHINGLE_CHUNKS

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(size, np.uint64)
        for b in group.column("counts"):
            total += opened_counts(b.as_py())
        counts = packed_counts(np.minimum(total, 0xFFFFFFFF).astype(np.uint32))
        return pa.table([group.column("chunk")[:1], pa.array([counts], pa.binary())], names=["chunk", "counts"])

    rows = summary.where("chunk is not null").select("chunk", F.floor(F.col("part") / 1000).alias("thousand"), "counts")
    some = rows.groupBy("chunk", "thousand").applyInArrow(add, "chunk int, counts binary")
    counts = np.zeros(cells + cells // 4, np.uint32)
    for row in some.groupBy("chunk").applyInArrow(add, "chunk int, counts binary").collect():
        counts[row["chunk"] * size:(row["chunk"] + 1) * size] = opened_counts(row["counts"])
    return counts[:cells], counts[cells:]


def boundary(sizes: dict[int, int], counts: np.ndarray, percent: int) -> int:
    """The set size up to which sets are keyed by 2-subsets: the least of keys written plus list entries scanned.

    A prefix holds the rarest part of a set, so the length of a list is taken from the cells that hold the
    rarest such part of all shingles, above the usual load of a cell.
    """
    c = np.sort(counts[counts > 0].astype(np.float64))
    rare = c[: max(1, int(np.searchsorted(np.cumsum(c), c.sum() * (101 - percent) / 100)))] if len(c) else np.ones(1)
    scanned = max(1.0, float((rare * rare).sum() / rare.sum() - np.median(c))) if len(c) else 1.0

    def cost(b: int) -> float:
        total = 0.0
        for n, many in sizes.items():
            p = n - least_overlap(n, percent)
            if n * percent <= b * 100:
                total += many * (p + 2) * (p + 1) / 2
            if n > b:
                total += many * (p + 1) * (1 + scanned)
        return total

    return min(range(0, MOST_SMALL + 1), key=cost)


def partnered(e: np.ndarray, run_of: np.ndarray, percent: int) -> np.ndarray:
    """Which entries, in runs by size, may link with another one of their run; all in runs beyond ``SHORT_LIST``.

    Of two linked sets the first shingle that both hold (or the first two) leaves enough behind it in the order in either, so
    there is a list in which neither leaves.
    """
    n, left = e["n"].astype(np.int64), e["n"].astype(np.int64) - e["behind"]
    stay = np.bincount(run_of)[run_of] > SHORT_LIST
    for far in range(1, min(SHORT_LIST, len(e))):
        met = run_of[far:] == run_of[:-far]
        if not met.any():
            break
        met &= np.minimum(left[far:], left[:-far]) >= least_shared(n[far:] + n[:-far], percent)
        stay[far:] |= met
        stay[:-far] |= met
    return stay


def candidate_lists(
    docs: DataFrame, text: str, width: int, percent: int, counts: np.ndarray, word_counts: np.ndarray, edge: int, entries: int,
    classes: DataFrame, list_sets: int = LIST_SETS,
) -> DataFrame:
    """(list, sig, n, pivot): the sets of each list of two or more; the pivot is the list's least signature.

    A list of more than ``list_sets`` sets, by the sketch, is met in parts of about so many, and nowhere as a whole. The
    others are told apart by their sets, each list once, and split by the odd cells of ``classes`` (sig, n, odd).
    """
    buckets = 1 + entries * ENTRY.itemsize // BUCKET_BYTES
    cells = len(counts)
    load = float(counts.mean())
    above = np.maximum(counts.astype(np.float64) - load, 0)
    common = np.ceil(np.log2(above + 1)).astype(np.uint8)  # 0 for a cell of less than the mean load, else the bits of what it has more
    word_level = np.rint(2.0 * np.log2(word_counts + 1.0)).astype(np.int64)
    shipped = docs.sparkSession.sparkContext.broadcast((common, word_level))  # as large as the sketch has cells
    rows = docs.select(F.col(text).cast("string").alias("text"))

    def keys_of(s: np.ndarray, words: np.ndarray, common: np.ndarray, pairs: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The set's keys, into how many parts each key's list is dealt, and what lies behind. A pair's list is no longer than its rarer shingle's."""
        n = len(s)
        cell = (s & np.uint64(cells - 1)).astype(np.int64)
        level = common[cell]
        token = (level.astype(np.uint64) << np.uint64(8) | words.astype(np.uint64)) << np.uint64(50) | s >> np.uint64(14)
        parts = ((1 << level.astype(np.int64)) - 1) // list_sets + 1
        p = n - least_overlap(n, percent)
        keys, dealt, behind = [], [], []
        if n * percent <= edge * 100:
            chosen = np.argsort(token)[:p + 2]
            token2, parts2 = token[chosen], parts[chosen]
            cold = int((parts2 == 1).sum())  # the order is by level first, so hot shingles come last
            if len(token2) not in pairs:
                pairs[len(token2)] = np.triu_indices(len(token2), 1)
            i, j = pairs[len(token2)]
            if cold < len(token2):
                i, j = i[i < cold], j[i < cold]
            keys += [mix(mix(token2[i]) + token2[j]), mix(token2[cold:-1])]  # of two shared shingles one is not the last
            dealt += [np.ones(len(i), np.int64), parts2[cold:-1]]
            behind += [j - 1, np.arange(cold, len(token2) - 1)]  # all before the second but the first of the two
        if n > edge:
            chosen = np.argpartition(token, p)[:p + 1]
            chosen = chosen[np.argsort(token[chosen])]
            keys.append(mix(token[chosen]))
            dealt.append(parts[chosen])
            behind.append(np.arange(p + 1))
        return np.concatenate(keys), np.concatenate(dealt), np.minimum(np.concatenate(behind), 0xFFFF)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, word_level = shipped.value
        shingler, seen, pairs, waiting, held = Shingler(width), set(), {}, [], 0

        def flush() -> pa.RecordBatch:
            e, dealt = np.concatenate([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting])
            bucket = (e["key"] % np.uint64(buckets)).astype(np.int64)
            hot = np.flatnonzero(dealt > 1)  # below 0: lists in parts
            part = mix(e["key"][hot] + mix(e["half"][hot] % dealt[hot].astype(np.uint64)))
            bucket[hot] = -1 - (part % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            e, bucket = e[order], bucket[order]
            cut = np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1))
            blobs = [packed_entries(x) for x in np.split(e, cut[1:])]
            return pa.RecordBatch.from_arrays([pa.array(bucket[cut]), pa.array(blobs, pa.binary())], names=["bucket", "entries"])

        for batch in slices(batches):
            for value in utf8(batch):
                s, words = shingler.ranked_set(value, word_level)
                n = len(s)
                if not n or n * 100 // percent == n:  # no other size is within reach
                    continue
                sig = signature(s)
                if sig in seen:
                    continue
                seen.add(sig)
                keys, dealt, behind = keys_of(s, words, common, pairs)
                e = np.empty(len(keys), ENTRY)
                e["key"], e["n"], e["behind"] = keys >> np.uint64(16), n, behind
                e["half"] = np.frombuffer(sig, ">u8")[1]
                waiting.append((e, dealt))
                held += len(e)
                if held >= FLUSH:
                    yield flush()
                    waiting, held = [], 0
        if held:
            yield flush()

    def once(e: np.ndarray) -> np.ndarray:
        """Equal sets of different tasks are one in a list."""
        return e[np.concatenate(([True], (e["key"][1:] != e["key"][:-1]) | (e["half"][1:] != e["half"][:-1])))]

    def listed(names: np.ndarray, e: np.ndarray, starts: np.ndarray, hot: bool) -> pa.Table:
        """A row for each name, once: the halves, one after the other, of its list, which begins at its place of ``starts``."""
        raw = e["half"].astype(">u8").tobytes()
        ends = np.append(starts[1:], len(e)).tolist()
        halves = {name.astype(">u8").tobytes(): raw[8 * a:8 * b] for name, a, b in zip(names, starts.tolist(), ends)}
        return pa.table([pa.array(list(halves), pa.binary()), pa.array(list(halves.values()), pa.binary()), pa.array([hot] * len(halves), pa.bool_())], names=["list", "halves", "hot"])

    def lists(group: pa.Table) -> pa.Table:
        e = np.concatenate([opened_entries(b.as_py()) for b in group.column("entries")])
        if group.column("bucket")[0].as_py() < 0:  # lists in parts as they are; their partners may be in other buckets
            e = once(e[np.lexsort((e["half"], e["key"]))])
            starts = np.flatnonzero(np.concatenate(([True], e["key"][1:] != e["key"][:-1])))
            return listed(e["key"][starts], e, starts, True)
        order = np.argsort(e["key"])
        key = e["key"][order]
        twice = np.concatenate((key[1:] == key[:-1], [False]))
        twice[1:] |= twice[:-1].copy()
        e = e[order[twice]]
        e = e[np.lexsort((e["behind"], e["half"], e["n"], e["key"]))]
        if len(e):
            e = once(e)
            far = (e["key"][1:] != e["key"][:-1]) | (e["n"][1:].astype(np.int64) * percent > e["n"][:-1].astype(np.int64) * 100)
            run_of = np.concatenate(([0], np.cumsum(far)))
            stay = partnered(e, run_of, percent)
            e, run_of = e[stay], run_of[stay]
            many = np.bincount(run_of)
            e, run_of = e[many[run_of] > 1], run_of[many[run_of] > 1]
        if not len(e):
            return listed(e["key"], e, np.zeros(0, np.int64), False)
        starts = np.flatnonzero(np.diff(run_of, prepend=-1))
        one = mix(e["half"])
        same = np.stack([np.add.reduceat(one, starts), np.add.reduceat(mix(one ^ e["half"]), starts)], 1)
        return listed(same, e, starts, False)  # lists of the same sets are one

    def split(group: pa.Table) -> pa.Table:
        name, sig, n = (group.column(c).to_pylist() for c in ("list", "sig", "n"))
        number = {x: i for i, x in enumerate(dict.fromkeys(name))}
        of, n = np.array([number[x] for x in name]), np.array(n, np.int64)
        raw = np.frombuffer(b"".join(sig), ">u8").reshape(-1, 2)
        odd = group.column("odd").to_pylist()
        order = np.lexsort((raw[:, 1], raw[:, 0], n, of))
        label = parted(of[order], n[order], [odd[i] for i in order.tolist()], percent)
        many = np.bincount(label)[label] > 1
        order, label = order[many], label[many]
        last = np.lexsort((raw[order, 1], raw[order, 0], label))
        order, label = order[last], label[last]
        first = np.flatnonzero(np.diff(label, prepend=-1))
        pivot = order[np.repeat(first, np.diff(np.append(first, len(label))))]
        return pa.table([
            pa.array([name[i] + sig[k] for i, k in zip(order.tolist(), pivot.tolist())], pa.binary()),
            pa.array([sig[i] for i in order.tolist()], pa.binary()), pa.array(n[order]), pa.array([sig[i] for i in pivot.tolist()], pa.binary()),
        ], names=["list", "sig", "n", "pivot"])

    def members(lists: DataFrame, *more: str) -> DataFrame:
        half = F.explode(F.expr("transform(sequence(0, int(length(halves) / 8) - 1), i -> substring(halves, 8 * i + 1, 8))"))
        whole = classes.select(F.substring("sig", 9, 8).alias("half"), "sig", "n", *more)
        return lists.select("list", half.alias("half")).join(whole, "half").drop("half")

    packed = rows.mapInArrow(tidy(run), "bucket bigint, entries binary")
    found = stage(packed.groupBy("bucket").applyInArrow(lists, "list binary, halves binary, hot boolean"), "jaccard-found")
    distinct = stage(found.where("not hot").groupBy("list").agg(F.min("halves").alias("halves")), "jaccard-distinct")
    held = distinct.agg(F.sum(F.length("halves"))).first()[0] or 0
    dealt = F.pmod(F.xxhash64("list"), F.lit(1 + held // 8 * MEMBER_BYTES // BUCKET_BYTES)).alias("dealt")
    near = stage(members(distinct, "odd").groupBy(dealt).applyInArrow(split, "list binary, sig binary, n bigint, pivot binary"), "jaccard-lists")
    hot = found.where("hot")
    if hot.isEmpty():
        return near
    hot = stage(members(hot), "jaccard-hot")
    pivots = hot.groupBy("list").agg(F.min("sig").alias("pivot"), F.count(F.lit(1)).alias("many")).where("many > 1").drop("many")
    return stage(near.unionByName(hot.join(pivots, "list")), "jaccard-lists")


def parted(of: np.ndarray, n: np.ndarray, odd: list[bytes], percent: int) -> np.ndarray:
    """A label for each set of some lists, sorted by list and size: sets of one list that may link have equal labels.

    Sets within reach of each other's size are compared; a list of too many such pairs stays whole.
    """
    words = np.array([len(x) // 8 for x in odd], np.int64)
    flat, at = np.frombuffer(b"".join(odd), np.uint64), np.cumsum(words) - words

    def cells(rows: np.ndarray, many: int) -> np.ndarray:
        """The odd cells of rows, folded into so many words."""
        out = np.zeros((len(rows), many), np.uint64)
        for k in range(int(words[rows].max(initial=0)) // many):
            more = words[rows] > k * many
            out[more] ^= flat[at[rows[more], None] + (k * many + np.arange(many))]
        return out

    def may_link(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = (n[a] * percent <= n[b] * 100) & (n[b] * percent <= n[a] * 100)
        both, least = n[a] + n[b], np.minimum(words[a], words[b])
        for many in np.unique(least[out]).tolist():
            mine = np.flatnonzero(out & (least == many))
            for some in np.split(mine, range(65_536 // many + 1, len(mine), 65_536 // many + 1)):
                differ = np.bitwise_count(cells(a[some], many) ^ cells(b[some], many)).sum(1, dtype=np.int64)
                out[some] = differ <= both[some] - 2 * least_shared(both[some], percent)
        return out

    label = np.arange(len(of))
    starts = np.flatnonzero(np.diff(of, prepend=-1))
    sizes = np.diff(np.append(starts, len(of)))
    short = np.repeat(sizes <= SHORT_LIST, sizes)
    pairs = []
    for far in range(1, min(SHORT_LIST, len(of))):
        a = np.flatnonzero((of[far:] == of[:-far]) & short[far:])
        if len(a):
            a = a[may_link(a, a + far)]
            pairs.append((a, a + far))
    if pairs:
        a, b = (np.concatenate(x) for x in zip(*pairs))
        while (label[a] != label[b]).any():
            least = np.minimum(label[a], label[b])
            np.minimum.at(label, a, least)
            np.minimum.at(label, b, least)
    long = sizes > SHORT_LIST
    for start, size in zip(starts[long].tolist(), sizes[long].tolist()):
        end = start + size
        reach = start + np.searchsorted(n[start:end], n[start:end] * 100 // percent, "right")
        if (reach - np.arange(start, end)).sum() > MOST_PAIRS:
            label[start:end] = start
            continue
        for i, last in zip(range(start, end), reach.tolist()):
            others = np.arange(i + 1, last)
            others = others[label[others] != label[i]]
            hit = others[may_link(np.full(len(others), i), others)]
            if len(hit):
                label[start:end][np.isin(label[start:end], label[hit])] = label[i]
    return label


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """A label for each set: equal labels are connected by links among these sets. Exact."""
    sizes = np.array([len(s) for s in sets], np.int64)
    whole, token = np.unique(np.concatenate(sets), return_inverse=True)
    of = np.repeat(np.arange(len(sets)), sizes)
    often = np.bincount(token)
    shared = often[token] > 1
    token, of = token[shared], of[shared]
    starts = np.searchsorted(of, np.arange(len(sets) + 1))
    degree = np.bincount(of, weights=often[token].astype(float), minlength=len(sets))
    label = np.arange(len(sets))
    flag = np.zeros(len(whole), np.int32)
    for i in np.argsort(-degree, kind="stable").tolist():
        other = label != label[i]
        other &= (sizes * 100 >= sizes[i] * percent) & (sizes * percent <= sizes[i] * 100)
        if not other.any() or starts[i] == starts[i + 1]:
            continue
        own = token[starts[i]:starts[i + 1]]
        flag[own] = 1
        before = np.concatenate(([0], np.cumsum(flag[token], dtype=np.int64)))
        both = before[starts[1:]] - before[starts[:-1]]
        flag[own] = 0
        hit = other & (100 * both >= percent * (sizes + sizes[i] - both))
        for got in np.unique(label[hit]).tolist():
            label[label == got] = label[i]
    return label


def pivot_cells(apart: DataFrame, half: int) -> DataFrame:
    """(cell, sig): each set once, in a chunk of its heaviest list; every chunk of a list holds the list's pivot."""
    weight = apart.groupBy("list").agg(F.sum("n").alias("weight"))
    one = apart.join(weight, "list").groupBy("sig").agg(F.max(F.struct("weight", "list", "pivot")).alias("l"))
    chunk = F.pmod(F.xxhash64("sig"), F.ceil(F.col("l.weight") / half))
    one = one.select(F.concat_ws(":", F.hex("l.list"), chunk).alias("cell"), "sig", "l.pivot")
    return one.select("cell", "sig").unionAll(one.select("cell", F.col("pivot").alias("sig"))).distinct()


def pair_cells(apart: DataFrame, roots: DataFrame, half: int) -> DataFrame:
    """(cell, sig): chunks of the lists, two to a cell, so that sets of one list but different roots meet."""
    rooted = apart.join(roots, F.col("sig") == F.col("node"), "left").select("list", "sig", "n", F.coalesce("root", "sig").alias("root"))
    unlike = rooted.groupBy("list").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least != most")
    rooted = stage(rooted.join(unlike, "list", "left_semi"), "jaccard-open")
    weight = rooted.groupBy("list", "root").agg(F.sum("n").alias("weight"))
    rest = weight.where(F.col("weight") < half).groupBy("list").agg(F.sum("weight").alias("rest"))
    both = rooted.join(weight, ["list", "root"]).join(rest, "list", "left")
    own = F.col("weight") >= half  # chunks of one root; the smaller roots share chunks, each root in one
    chunk = F.when(own, F.concat_ws("-", F.hex("root"), F.pmod(F.xxhash64("sig"), F.ceil(F.col("weight") / half)))).otherwise(
        F.pmod(F.xxhash64("root"), F.ceil(F.col("rest") / half)).cast("string")
    )
    held = stage(both.select("list", "sig", chunk.alias("chunk"), F.when(own, F.col("root")).alias("root")), "jaccard-chunks")
    chunks = held.select("list", "chunk", "root").distinct()
    chunks = chunks.join(chunks.groupBy("list").agg(F.count(F.lit(1)).alias("many")), "list")
    a, b = (chunks.select("list", F.col("chunk").alias(k), F.col("root").alias(f"{k}_root"), F.col("many").alias(f"{k}_many")) for k in "ab")
    unlike = F.col("a_root").isNull() | F.col("b_root").isNull() | (F.col("a_root") != F.col("b_root"))
    pairs = a.join(b, "list").where((F.col("a") < F.col("b")) & unlike | (F.col("a") == F.col("b")) & (F.col("a_many") == 1))
    cell = F.concat_ws(":", F.hex("list"), "a", "b").alias("cell")
    asked = pairs.select(cell, "list", F.explode(F.array_distinct(F.array("a", "b"))).alias("chunk"))
    return asked.join(held, ["list", "chunk"]).select("cell", "sig")


def verify(docs: DataFrame, text: str, width: int, percent: int, lists: DataFrame, classes: DataFrame, doc_id: str, cell_shingles: int) -> DataFrame:
    """Links (a, b) of signatures that connect every two sets which are linked."""
    near = components(lists.where("sig != pivot").select(F.col("sig").alias("a"), F.col("pivot").alias("b")), "jaccard-near")
    near = stage(near, "jaccard-near")
    nodes = lists.select("sig", "n").distinct().join(near, F.col("sig") == F.col("node"))
    weight = nodes.groupBy("root").agg(F.sum("n").alias("weight"))
    fits = F.col("weight") <= cell_shingles
    whole = nodes.join(weight.where(fits), "root").select(F.hex("root").alias("cell"), "sig")
    large = weight.where(~fits).select("root").join(near, "root").select("node")
    apart = stage(lists.join(large, F.col("sig") == F.col("node"), "left_semi").distinct(), "jaccard-apart")
    half = max(1, cell_shingles // 2)
    asked = classes.join(nodes.select("sig"), "sig", "left_semi")
    texts = stage(packed_texts(docs, text, doc_id, width, asked), "jaccard-texts")
    if apart.isEmpty():
        return links_in(stage(whole, "jaccard-cells"), texts, width, percent)
    cells = stage(whole.unionAll(pivot_cells(apart, half)), "jaccard-cells")
    some = stage(links_in(cells, texts, width, percent), "jaccard-some")
    cells = stage(pair_cells(apart, components(some, "jaccard-first"), half), "jaccard-cells")
    return some.unionAll(links_in(cells, texts, width, percent))


def packed_texts(docs: DataFrame, text: str, doc_id: str, width: int, asked: DataFrame) -> DataFrame:
    """(sig, text): the compressed text of each asked set (id, th), and of a few others; no text is shuffled."""
    keys = KeyFilter(asked.select(F.xxhash64("id", "th")))
    value = column(text).cast("string")
    rows = docs.select(value.alias("text"), F.xxhash64(column(doc_id), F.xxhash64(value)).alias("key"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(width), set()
        for batch in slices(batches):
            sigs, texts = [], []
            for t in utf8(batch.filter(pa.array(keys.may_hold(batch.column(1).to_numpy())))):
                s = shingler.set_of(t)
                if len(s) and (sig := signature(s)) not in seen:  # equal sets are one
                    seen.add(sig)
                    sigs.append(sig)
                    texts.append(zstandard.compress(t, 1))
            yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.binary()), pa.array(texts, pa.binary())], names=["sig", "text"])

    return rows.mapInArrow(tidy(pack), "sig binary, text binary")


def links_in(cells: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) that connect every two sets of a cell which are linked there.

    Up to ``SHIPPED_CELLS`` places of sets in cells go to the texts, so that a text is shuffled once, to its cell; more
    are joined by shuffles.
    """

    def links(group: pa.Table) -> pa.Table:
        shingler = Shingler(width)
        by_sig = dict(zip(group.column("sig").to_pylist(), group.column("text")))  # repeated rows are one
        sigs = sorted(by_sig)
        label = linked([shingler.set_of(zstandard.decompress(by_sig[s].as_py())) for s in sigs], percent)
        first: dict[int, bytes] = {}
        pairs = [(s, first.setdefault(x, s)) for s, x in zip(sigs, label.tolist())]
        pairs = [p for p in pairs if p[0] != p[1]]
        return pa.table([pa.array([a for a, _ in pairs], pa.binary()), pa.array([b for _, b in pairs], pa.binary())], names=["a", "b"])

    few = cells.limit(SHIPPED_CELLS + 1).count() <= SHIPPED_CELLS
    placed = texts.join(F.broadcast(cells) if few else cells, "sig")
    return placed.select("cell", "sig", "text").groupBy("cell").applyInArrow(links, "a binary, b binary")


def join_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT, keep: list[str] | None = None,
    sketch_cells: int = SKETCH_CELLS, list_sets: int = LIST_SETS, cell_shingles: int = CELL_SHINGLES,
) -> DataFrame:
    """(rec, n_shingles, component, first, text_hash): each record, its set's size, the least id of its component, whether
    it is the one row of the component to stay, and xxhash64 of its text.

    Two documents link when 100 * intersection >= ``percent`` * union. A record with an empty set is a component of its own.
    """
    summary = summarise(docs, text, sorted({doc_id, *(docs.columns if keep is None else keep)}, key=docs.columns.index), width, sketch_cells)
    found = summary.where("chunk is null").select("rec", F.col(f"rec.`{doc_id}`").alias("id"), "th", "at", "n", "sig", "odd")
    classes = found.where("n > 0").groupBy("sig").agg(F.min(F.struct("id", "th", "at")).alias("row"), F.min("id").alias("least"), F.max("n").alias("n"), F.max("odd").alias("odd"))
    classes = stage(classes.select("sig", F.col("row.id").alias("id"), F.col("row.th").alias("th"), "row", "least", "n", "odd"), "jaccard-classes")
    counts, word_counts = sketch_of(summary, sketch_cells)
    sizes = {r[0]: r[1] for r in classes.where(F.col("n") <= MOST_SMALL * 2).groupBy("n").count().collect()}
    total = classes.agg(F.sum("n")).first()[0] or 0
    entries = total * (101 - percent) // 100
    edge = boundary(sizes, counts, percent)
    lists = candidate_lists(docs, text, width, percent, counts, word_counts, edge, entries, classes, list_sets)
    edges = verify(docs, text, width, percent, lists, classes.select("sig", "id", "th"), doc_id, cell_shingles)
    groups = components(edges, "jaccard-links")
    rooted = classes.join(groups, F.col("sig") == F.col("node"), "left").select(F.coalesce("root", "sig").alias("root"), "sig", "row", "least")
    least = rooted.groupBy("root").agg(F.min("least").alias("component"), F.min("row").alias("stays"))
    of = rooted.join(least, "root").select("sig", "component", F.col("stays.at").alias("stays"))
    some = found.where("n > 0").join(of, "sig").select(
        "rec", F.col("n").alias("n_shingles"), "component", (F.col("at") == F.col("stays")).alias("first"), F.col("th").alias("text_hash")
    )
    none = found.where("n = 0").select(
        "rec", F.col("n").alias("n_shingles"), F.col("id").alias("component"), F.lit(True).alias("first"), F.col("th").alias("text_hash")
    )
    return some.unionAll(none)


SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
r AS (
  WITH RECURSIVE r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
  SELECT a, min(b) AS component_id FROM r GROUP BY a
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM documents LEFT JOIN n USING (doc_id) JOIN r ON r.a = doc_id"""


@register("op10_jaccard_join", SQL)
def op10(spark, sf_dir):
    """Every document with its component of near copies."""
    found = join_groups(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select(F.col("rec.doc_id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))
