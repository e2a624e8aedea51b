"""LM scoring by a hashed maximum-entropy model with a class-factored softmax.

A token's probability is that of its kind times its probability in the kind. The most frequent words share
``TOP_CLASSES`` kinds and are told apart by a softmax of their own. Every other word, met or not, belongs to one of
``RARE_CLASSES`` kinds by its ending and, in it, to one of about sqrt(documents) classes by the first bits of its hash; class
and word are then found by yes-no softmaxes, one a bit. So every token is predicted by featured softmaxes down to its word. Each of them
starts from the counts and adds hashed features of the context: the last word, the one before it (skipping the last), and
both together. A class keeps one word's share for all unknown words; words whose bits are all equal share by their counts.

The weights are trained over all training tokens by distributed gradient steps: in each round every task takes Adagrad
steps over its share. The next start is the mean of the tasks' weights; a weight of the bits is averaged over the tasks that
moved it, in proportion to their gradients. Scoring runs the same sparse batches in numpy.

Texts are kept as word numbers of their block. A block's distinct words go, packed by class, to the task that
counts the class's words over the corpus, and the counts come back as arrays, so no token is shuffled. Counts, vocabulary and
classes grow with the corpus, the table of bit weights with the vocabulary's root up to ``MOST_TREE_BITS``, so that a worker's memory has a
bound; the tables of the kinds have a fixed size.

A null text counts as empty: its one token is the end. Very long texts are handled whole, in one block. Repeated
rows count as often as they occur; equally frequent words rank by their bytes. Without training texts every word is unknown. An empty table gives an
empty result. Records travel in a struct, so column names cannot clash.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T
from pyspark.sql import functions as F

from gridloom.session import drop_staged, small_batches, stage, staged

from .common import blocks, register, schema_of, table, text_bytes, tidy
from .language_id import fold

BLOCK_BYTES = 24 << 20
#: Classes of a kind, as a share of the root of the number of documents; bits of the largest table of bit weights.
CLASS_SHARE, MOST_TREE_BITS = 0.1, 20
TOP_CLASSES, CLASS_WORDS, RARE_CLASSES = 12, 32, 20
CLASSES = TOP_CLASSES + RARE_CLASSES
LAST, SKIP, BOTH = 2048, 1024, 8192
LAST_IN, SKIP_IN = 512, 256
BATCH, ROUNDS, RATE = 8192, 3, 0.15
#: Tokens scored at a time; no score depends on it, and the arrays of so few stay in a core's cache.
SCORED = 4096
#: Tokens whose log probabilities are held at a time, as whole texts.
HELD = 1 << 18
#: Sums of up to so many rows are taken row by row.
FEW = 8
#: Bit weights, and rows of softmaxes, worked on at a time in training; no weight depends on it, and so few stay in a core's cache.
PIECE, SOFT = 1 << 14, 2048
#: Added to the root of a bit weight's squares, so that a feature met once moves little.
TREE_EASE = 1.0
#: Log odds are kept in quarters; ``SURE`` marks a bit that all words of a node share.
ODDS, SURE = 4, -128
MOST_FREQUENT = TOP_CLASSES * CLASS_WORDS
END = b"\n"
TASKS_SUMMED = 64
#: The model's tables in the order they are shipped: (name, rows, columns).
TABLES = (
    ("bias", 1, CLASSES), ("last", LAST, CLASSES), ("skip", SKIP, CLASSES), ("both", BOTH, CLASSES),
    ("bias_in", TOP_CLASSES, CLASS_WORDS), ("last_in", LAST_IN * TOP_CLASSES, CLASS_WORDS), ("skip_in", SKIP_IN * TOP_CLASSES, CLASS_WORDS),
)


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _packed(**arrays: np.ndarray) -> bytes:
    """One blob; numbers lie byte by byte (all first bytes, all second ones, ...), which packs better."""
    head, body = [], []
    for name, x in arrays.items():
        flat = np.ascontiguousarray(x.T if x.ndim == 2 else x)
        head.append((name, x.dtype.str, x.shape))
        body.append(flat.view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(1).compress(json.dumps(head).encode() + b"\n" + b"".join(body))


def _opened(blob: bytes) -> dict[str, np.ndarray]:
    held = zstandard.ZstdDecompressor().decompress(blob)
    at = held.index(b"\n")
    head, at, out = json.loads(held[:at]), at + 1, {}
    for name, kind, shape in head:
        kind, size = np.dtype(kind), math.prod(shape)
        planes = np.frombuffer(held, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, size)
        x = np.ascontiguousarray(planes.T).view(kind).reshape(shape[::-1])
        out[name] = x.T if len(shape) == 2 else x
        at += size * kind.itemsize
    return out


def class_bits(documents: int) -> int:
    """How many bits of a word's hash name its class within a kind."""
    return max(0, round(math.log2(max(1.0, CLASS_SHARE * math.sqrt(documents)))))


def number_blocks(docs: DataFrame, text: str, held_out: Column, keep: list[str] | None) -> DataFrame:
    """Rows of blocks (block, recs, texts, often) and of their words, packed by the first bits of the word's hash (block, bucket, words).

    ``often`` lists the block's most frequent trained words.
    """
    kept = [F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]
    rows = docs.select(
        F.struct(*kept).alias("rec"), held_out.alias("held"), F.spark_partition_id().alias("part"), F.col(text).cast("string").alias("text")
    )
    bits = class_bits(docs.count())
    recs = T.StructType([T.StructField("recs", T.ArrayType(rows.schema["rec"].dataType))])
    schema = schema_of("block bigint", recs, "texts binary, often array<struct<word:binary, c:bigint>>, bits int, bucket bigint, words binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "recs", "texts", "often", "bits", "bucket", "words"]
        list_kind = pa.list_(pa.struct([("word", pa.binary()), ("c", pa.int64())]))
        for k, pieces in enumerate(blocks(batches, text_bytes, BLOCK_BYTES)):
            block = pieces[0].column(2)[0].as_py() << 32 | k
            words, flat, sizes = numbered_words([p.column(3) for p in pieces])
            held = np.concatenate([p.column(1).to_numpy(zero_copy_only=False) for p in pieces]).astype(bool)
            trained = np.bincount(flat[np.repeat(~held, sizes)], minlength=len(words))
            recs = pa.concat_arrays([p.column(0) for p in pieces])
            listed = pa.ListArray.from_arrays(pa.array([0, len(recs)], pa.int32()), recs)
            blob = _packed(ids=flat, sizes=sizes, held=held)
            k = 4 * MOST_FREQUENT
            least = max(1, np.partition(trained, -k)[-k] if len(trained) > k else 1)  # no rarer word is among the k first
            most = heapq.nsmallest(k, ((-int(trained[i]), words[i]) for i in np.flatnonzero(trained >= least)))
            often = pa.array([[{"word": w, "c": -c} for c, w in most]], list_kind)
            yield pa.RecordBatch.from_arrays([
                pa.array([block]), listed, pa.array([blob], pa.binary()), often, pa.array([bits], pa.int32()),
                pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()),
            ], names=names)
            bucket = np.fromiter((word_hash(w) >> (64 - bits) for w in words), np.int64, len(words))
            order = np.argsort(bucket, kind="stable")
            cut = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            packed = [
                _packed(words=np.frombuffer(b" ".join([words[i] for i in held_by.tolist()]), np.uint8), numbers=held_by.astype(np.int32), trained=trained[held_by])
                for held_by in np.split(order, cut[1:])
            ]
            n = len(cut)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n, block)), pa.nulls(n, listed.type), pa.nulls(n, pa.binary()), pa.nulls(n, list_kind), pa.nulls(n, pa.int32()),
                pa.array(bucket[order][cut]), pa.array(packed, pa.binary()),
            ], names=names)

    return stage(rows.mapInArrow(tidy(run), schema), "lm-blocks")


def numbered_words(texts: list[pa.Array]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct tokens as they come, ``END`` first, all tokens as numbers of them, and the tokens of each text."""
    found, sizes = [], []
    for text in texts:
        listed = pc.ascii_split_whitespace(pc.ascii_lower(text))
        n, words = pc.fill_null(pc.list_value_length(listed), 0).to_numpy(), listed.flatten()
        full = pc.binary_length(words).to_numpy() > 0  # white space at either end of a text leaves an empty word there
        sizes.append(np.bincount(np.repeat(np.arange(len(text)), n)[full], minlength=len(text)) + 1)
        found.append(words.filter(pa.array(full)))
    sizes = np.concatenate(sizes).astype(np.int64)
    flat, inner = np.zeros(sizes.sum(), np.uint32), np.ones(sizes.sum(), bool)
    inner[np.cumsum(sizes) - 1] = False
    coded = pa.chunked_array(found).dictionary_encode()
    if not len(coded):
        return [END], flat, sizes
    flat[inner] = np.concatenate([c.indices.to_numpy() for c in coded.chunks])
    flat[inner] += 1
    words = coded.chunk(0).dictionary
    joined = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words.cast(pa.binary())), b" ")
    return [END, *joined[0].as_py().split()], flat, sizes


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def rare_class(word: bytes) -> int:
    """The kind of a word that is not frequent, by its last two bytes."""
    return xxhash.xxh3_64_intdigest(word[-2:]) % RARE_CLASSES


class Shape:
    """What is known of the corpus: tokens, words, the frequent words' counts, and the mass (tokens, words and one unknown) of each class."""

    def __init__(self, tokens: int, words: int, top_counts: np.ndarray, mass: np.ndarray):
        self.tokens, self.words, self.top_counts, self.mass = tokens, words, top_counts, mass
        self.bits = mass.shape[1].bit_length() - 1
        self.tree_bits = min(MOST_TREE_BITS, 8 + round(math.log2(max(words, 1)) / 2))
        top = np.add.reduceat(np.append(top_counts, np.zeros(MOST_FREQUENT - len(top_counts))), np.arange(0, MOST_FREQUENT, CLASS_WORDS))
        self.class_tokens = np.concatenate([top, (mass - 1).sum(1)])
        self.tables = (*TABLES, ("tree", 1 << self.tree_bits, 1))

    def weights(self) -> dict[str, np.ndarray]:
        """Zero weights, the biases at the unigram model."""
        w = {name: np.zeros((rows, columns), np.float32) for name, rows, columns in self.tables}
        w["bias"][0] = np.log((self.class_tokens + 1) / (self.class_tokens.sum() + CLASSES))
        inside = np.full(MOST_FREQUENT, -30.0)
        inside[: len(self.top_counts)] = np.log(self.top_counts)
        w["bias_in"][:] = inside.reshape(TOP_CLASSES, CLASS_WORDS)
        return w

    def class_odds(self, kind: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The log odds of each bit that leads from a rare kind to a word's class, in quarters."""
        table = np.empty((RARE_CLASSES, 1 << self.bits, self.bits), np.int8)
        for bit in range(self.bits):
            sides = self.mass.reshape(RARE_CLASSES, 1 << bit, 2, -1).sum(3)
            table[:, :, bit] = np.repeat(in_quarters(sides[..., 1], sides[..., 0]), 1 << (self.bits - bit), axis=1)
        return table.reshape(RARE_CLASSES << self.bits, self.bits).take(self.classes(kind, hashes), axis=0)

    def classes(self, kind: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The number of each word's class."""
        return kind.astype(np.int64) << self.bits | hashes.astype(np.int64) >> (32 - self.bits)


def in_quarters(right: np.ndarray, left: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        odds = np.round(ODDS * np.log(right / left))
    return np.where((right > 0) & (left > 0), np.clip(np.nan_to_num(odds), -127, 127), SURE).astype(np.int8)


def word_odds(kind: np.ndarray, hashes: np.ndarray, c: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For the known words of one class number: log odds of the bits after the first ``bits``, and the log share among words of equal bits.

    There are as many bits as tell about one word from another in the largest kind.
    """
    key = kind.astype(np.int64) << 32 | hashes.astype(np.int64)
    order = np.argsort(key, kind="stable")
    key, mass = key[order], (c[order] + 1).astype(np.float64)
    most = int(np.bincount(kind).max()) if len(kind) else 1
    depth = min(32 - bits, most.bit_length())
    odds, share = np.empty((len(key), depth), np.int8), np.zeros(len(key), np.float32)
    for level in range(depth + 1 if len(key) else 0):
        node = key >> (32 - bits - level)
        new = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
        sizes = np.diff(np.append(new, len(node)))
        whole = np.add.reduceat(mass, new)
        if level == depth:
            share[order] = np.log(mass / np.repeat(whole, sizes))
        else:
            right = np.add.reduceat(mass * (key >> (31 - bits - level) & 1), new)
            odds[order, level] = np.repeat(in_quarters(right, whole - right), sizes)
    return odds, share


def resolve(numbered: DataFrame) -> tuple[DataFrame, Shape]:
    """Blocks with their words' arrays (block, recs, texts, words), and the corpus's shape."""
    often = numbered.select(F.explode("often").alias("x")).groupBy("x.word").agg(F.sum("x.c").alias("c"))
    top = often.orderBy(F.col("c").desc(), "word").limit(MOST_FREQUENT).collect()
    ranks = {bytes(row["word"]): i for i, row in enumerate(top)}
    bits = numbered.agg(F.max("bits")).first()[0] or 0

    def opened(blob: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        held = _opened(blob)
        return held["words"].tobytes().split(b" "), held["numbers"], held["trained"]

    def count(group: pa.Table) -> pa.Table:
        blobs, owners = group.column("words").to_pylist(), group.column("block").to_pylist()
        number, c = _Numbers(), np.zeros(1024, np.int64)
        places, numbers = [], []
        for blob in blobs:
            words, mine, trained = opened(blob)
            numbers.append(mine)
            at = np.fromiter(map(number.__getitem__, words), np.int32, len(words))
            if len(number) > len(c):
                c = np.concatenate([c, np.zeros(len(number), np.int64)])
            c[at] += trained
            places.append(at)
        n = len(number)
        c = c[:n]
        hashes = np.fromiter((word_hash(w) >> 32 for w in number), np.uint32, n)
        kind = np.fromiter((rare_class(w) for w in number), np.int8, n)
        rank = np.fromiter((ranks.get(w, -1) for w in number), np.int16, n)
        rare = np.flatnonzero((c > 0) & (rank < 0))
        found, shares = word_odds(kind[rare], hashes[rare], c[rare], bits)
        odds, share = np.full((n, found.shape[1]), SURE, np.int8), np.zeros(n, np.float32)
        odds[rare], share[rare] = found, shares
        out = []
        for owner, mine, at in zip(owners, numbers, places):
            arrays = _packed(numbers=mine, c=c[at], kind=kind[at], rank=rank[at], hash=hashes[at], odds=odds[at], share=share[at])
            out.append({"block": owner, "arrays": arrays})
        tokens, kinds = np.bincount(kind[rare], c[rare], RARE_CLASSES), np.bincount(kind[rare], minlength=RARE_CLASSES)
        out.append({
            "bucket": group.column("bucket")[0].as_py(),
            "classes": [{"kind": k, "n": int(tokens[k]), "v": int(kinds[k])} for k in range(RARE_CLASSES) if kinds[k]],
            "top": [{"rank": int(rank[i]), "c": int(c[i])} for i in np.flatnonzero(rank >= 0)],
        })
        return pa.Table.from_pylist(out, pa.schema([
            ("block", pa.int64()), ("arrays", pa.binary()), ("bucket", pa.int64()),
            ("classes", pa.list_(pa.struct([("kind", pa.int32()), ("n", pa.int64()), ("v", pa.int64())]))),
            ("top", pa.list_(pa.struct([("rank", pa.int32()), ("c", pa.int64())]))),
        ]))

    schema = (
        "block bigint, arrays binary, bucket bigint, classes array<struct<kind:int, n:bigint, v:bigint>>, top array<struct<rank:int, c:bigint>>"
    )
    counted = stage(numbered.where("words is not null").select("block", "bucket", "words").groupBy("bucket").applyInArrow(count, schema), "lm-counts")
    mass, words, top_counts = np.ones((RARE_CLASSES, 1 << bits)), len(top), np.zeros(len(top))
    for row in counted.select("bucket", F.explode("classes").alias("x")).select("bucket", "x.*").toLocalIterator():  # a row a class
        mass[row["kind"], row["bucket"]] += row["n"] + row["v"]
        words += row["v"]
    for row in counted.select(F.explode("top").alias("x")).select("x.*").collect():  # the frequent words
        top_counts[row["rank"]] = row["c"]
    tokens = int(top_counts.sum() + (mass - 1).sum()) - (words - len(top))
    shape = Shape(tokens, words, top_counts, mass)

    def merge(group: pa.Table) -> pa.Table:
        parts = [_opened(b.as_py()) for b in group.column("arrays")]
        order = np.argsort(np.concatenate([p["numbers"] for p in parts]))
        depth = max(p["odds"].shape[1] for p in parts)
        for p in parts:
            p["odds"] = np.pad(p["odds"], ((0, 0), (0, depth - p["odds"].shape[1])), constant_values=SURE)
        blob = _packed(**{name: np.concatenate([p[name] for p in parts])[order] for name in ("c", "kind", "rank", "hash", "odds", "share")})
        return pa.table([group.column("block")[:1], pa.array([blob], pa.binary())], names=["at", "words"])

    arrays = counted.where("arrays is not null").select("block", "arrays").groupBy("block").applyInArrow(merge, "at bigint, words binary")
    whole = numbered.where("texts is not null").select("block", "recs", "texts").join(arrays, F.col("block") == F.col("at"))
    return stage(whole.select("block", "recs", "texts", "words"), "lm-resolved"), shape


class Batches:
    """The tokens of one block as features and targets."""

    def __init__(self, texts: bytes, words: bytes, shape: Shape):
        t, w = _opened(texts), _opened(words)
        self.ids, self.sizes, self.held = t["ids"], t["sizes"], t["held"]
        self.c, rank, rare = w["c"], w["rank"].astype(np.int64), w["kind"].astype(np.int64)
        self.kind = np.where(rank < 0, rare + TOP_CLASSES, rank // CLASS_WORDS)
        self.inside = np.maximum(rank, 0) % CLASS_WORDS
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))
        self.one = w["hash"]
        self.two = (self.one * np.uint32(0x9E3779B1)) ^ (self.one >> np.uint32(15))
        self.odds = np.concatenate([shape.class_odds(rare, self.one), w["odds"]], axis=1)
        self.shift = np.uint32(32 - shape.tree_bits)
        mass = shape.mass.ravel().take(shape.classes(rare, self.one))
        with np.errstate(divide="ignore"):
            known = np.log(mass - 1) + w["share"]
        #: What is left of a word's log probability behind all softmaxes.
        self.rest = np.where(rank >= 0, 0.0, np.where(self.c > 0, known, 0.0) - np.log(mass))

    def features(self, tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """Hashes of the last word, the one before, and both, for tokens given by place; ``first`` is their text's start."""
        last = np.where(tokens - 1 >= first, self.one[self.ids[np.maximum(tokens - 1, 0)]], np.uint32(1))
        skip = np.where(tokens - 2 >= first, self.two[self.ids[np.maximum(tokens - 2, 0)]], np.uint32(2))
        both = (last * np.uint32(0x85EBCA6B)) ^ (skip + np.uint32(0x9E3779B9))
        both = (both ^ (both >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        return last, skip, both >> np.uint32(8)

    def bits_of(self, ids: np.ndarray, features: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        """(log odds by counts, the bit, rows of the bit weights by feature) of the given rare tokens: a line a level, a column a token.

        The odds of a bit that is not open are infinite for it, so it takes nothing from a log probability and moves no weight.
        """
        levels = np.arange(self.odds.shape[1], dtype=np.uint32)[:, None]
        hashes = self.one[ids]
        bit = hashes >> (np.uint32(31) - levels)
        bit &= np.uint32(1)
        quarters = np.ascontiguousarray(self.odds.take(ids, axis=0).T)
        odds = quarters.astype(np.float32)
        odds /= ODDS
        sure = np.flatnonzero(quarters.ravel() == SURE)
        odds.ravel()[sure] = np.array([-np.inf, np.inf], np.float32)[bit.ravel()[sure]]
        node = hashes >> (np.uint32(32) - levels)  # a shift by all 32 bits leaves 0
        node *= np.uint32(0x9E3779B1)
        node ^= self.kind[ids].astype(np.uint32) * np.uint32(0x85EBCA6B)
        node ^= levels * np.uint32(0x27D4EB2F)
        node ^= node >> np.uint32(16)
        rows, own = np.empty((len(features), *node.shape), np.int64), np.empty_like(node)
        for i, f in enumerate(features):
            np.bitwise_xor(f * np.uint32(0xC2B2AE35) + np.uint32(i + 1) * np.uint32(0x165667B1), node, out=own)
            own *= np.uint32(0x9E3779B1)
            own >>= self.shift
            rows[i] = own
        return odds, bit, rows

    def places(self, chosen: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The places of the chosen texts' tokens, and where the text of each starts, ``size`` tokens at a time."""
        starts, sizes = self.starts[chosen], self.sizes[chosen]
        ends = np.cumsum(sizes)
        for a in range(0, int(ends[-1]) if len(ends) else 0, size):
            b = min(a + size, int(ends[-1]))
            i, j = np.searchsorted(ends, (a, b - 1), "right")
            of = slice(i, j + 1)
            n = np.minimum(ends[of], b) - np.maximum(ends[of] - sizes[of], a)
            yield np.arange(a, b) + np.repeat(starts[of] - (ends[of] - sizes[of]), n), np.repeat(starts[of], n)

    def runs(self, tokens: int) -> Iterator[np.ndarray]:
        """The texts in runs of about so many tokens."""
        ends = np.cumsum(self.sizes)
        cuts = np.searchsorted(ends, np.arange(tokens, ends[-1], tokens))
        yield from (run for run in np.split(np.arange(len(ends)), cuts) if len(run))

    def of(self, chosen: np.ndarray, size: int = BATCH) -> Iterator[tuple]:
        """(places, kind, inside, rows of the kind tables, frequent tokens, their rows of the inner tables, rare tokens, their bits)."""
        for p, f in self.places(chosen, size):
            last, skip, both = self.features(p, f)
            ids = self.ids[p]
            kind = self.kind[ids]
            outer = {"bias": np.zeros(len(p), np.int64), "last": last % LAST, "skip": skip % SKIP, "both": both % BOTH}
            often, seldom = np.flatnonzero(kind < TOP_CLASSES), np.flatnonzero(kind >= TOP_CLASSES)
            k = kind[often].astype(np.int64)
            inner = {"bias_in": k, "last_in": last[often] % LAST_IN * TOP_CLASSES + k, "skip_in": skip[often] % SKIP_IN * TOP_CLASSES + k}
            yield p, kind, self.inside[ids[often]], outer, often, inner, seldom, self.bits_of(ids[seldom], (last[seldom], skip[seldom], both[seldom]))


def bit_logits(w: dict[str, np.ndarray], odds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    tree, rows, odds, z = w["tree"][:, 0], rows.reshape(len(rows), -1), odds.ravel(), np.empty(odds.size, np.float32)
    for a in range(0, len(z), PIECE):
        part = slice(a, a + PIECE)
        own = tree.take(rows[0, part])
        for at in rows[1:, part]:
            own += tree.take(at)
        np.add(own, odds[part], out=z[part])
    return z


def bit_step(w: dict[str, np.ndarray], squares: dict[str, np.ndarray], odds: np.ndarray, bit: np.ndarray, rows: np.ndarray) -> None:
    """One Adagrad step of the bit weights."""
    z = bit_logits(w, odds, rows)
    np.exp(np.negative(z, out=z), out=z)
    z += 1
    g = np.subtract(np.divide(1, z, out=z), bit.ravel(), dtype=np.float64)
    tree, square, total = w["tree"][:, 0], squares["tree"], np.bincount(rows.ravel(), np.tile(g, len(rows)), len(w["tree"]))
    for a in range(0, len(total), PIECE):
        t, q = total[a:a + PIECE].astype(np.float32), square[a:a + PIECE]
        q += t * t
        t *= RATE
        t /= np.sqrt(q) + TREE_EASE
        tree[a:a + PIECE] -= t


def bit_losses(z: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """What each bit takes from a log probability: log(1 + exp(y)), y its log odds against."""
    y = (z.view(np.uint32) ^ (bit.astype(np.uint32, copy=False) << np.uint32(31))).view(np.float32)  # turns the sign where the bit is 1
    loss = np.abs(y)
    np.exp(np.negative(loss, out=loss), out=loss)
    loss += 1
    np.log(loss, out=loss)
    loss += np.maximum(y, 0, out=y)
    return loss


def row_sums(g: np.ndarray, order: np.ndarray, new: np.ndarray) -> np.ndarray:
    """``np.add.reduceat(g[order], new, axis=0)``, to the bit; sums of few rows, which are most, are taken together."""
    sizes = np.diff(np.append(new, len(order)))
    out = np.empty((len(new), g.shape[1]), g.dtype)
    few = np.argsort(np.where(sizes > FEW, 0, -sizes).astype(np.int8), kind="stable")[:np.count_nonzero(sizes <= FEW)]
    more, at = np.bincount(sizes[few], minlength=FEW + 1)[::-1].cumsum()[::-1], new[few]  # sums of so many rows or more come first
    total = g.take(order[at], axis=0)
    if more[2]:
        rest = g.take(order[at[:more[2]] + 1], axis=0)
        for j in range(3, FEW + 1):
            if more[j]:
                rest[:more[j]] += g.take(order[at[:more[j]] + (j - 1)], axis=0)
        total[:more[2]] += rest
    out[few] = total
    many = np.flatnonzero(sizes > FEW)
    if len(many):
        n = sizes[many]
        starts = np.cumsum(n) - n
        out[many] = np.add.reduceat(g.take(order[np.repeat(new[many] - starts, n) + np.arange(n.sum())], axis=0), starts, axis=0)
    return out


def logits(w: dict[str, np.ndarray], rows: dict[str, np.ndarray]) -> np.ndarray:
    """Below their rows' largest."""
    z = None
    for name, at in rows.items():
        part = w[name].take(at, axis=0)
        z = part if z is None else np.add(z, part, out=z)
    z -= np.ascontiguousarray(z.T).max(0)[:, None]  # column by column, which is faster than along short rows
    return z


def log_softmax_of(w: dict[str, np.ndarray], rows: dict[str, np.ndarray], target: np.ndarray) -> np.ndarray:
    """The log probability of each row's target."""
    z = logits(w, rows)
    own = z[np.arange(len(target)), target]
    return own - np.log(np.exp(z, out=z).sum(1))


def step(w: dict[str, np.ndarray], squares: dict[str, np.ndarray], rows: dict[str, np.ndarray], target: np.ndarray) -> None:
    """One Adagrad step; a table's row has one running square."""
    g = np.empty((len(target), next(iter(w[name] for name in rows)).shape[1]), np.float32)
    for a in range(0, len(g), SOFT):
        z = logits(w, {name: at[a:a + SOFT] for name, at in rows.items()})
        z -= np.log(np.exp(z).sum(1, keepdims=True))
        np.exp(z, out=g[a:a + SOFT])
    g.ravel()[np.arange(0, g.size, g.shape[1]) + target] -= 1
    for name, at in rows.items():
        if name.startswith("bias") and len(w[name]) == 1:
            seen, total = np.zeros(1, np.int64), g.sum(0, keepdims=True)
        else:
            order = np.argsort(at.astype(np.uint16), kind="stable")
            sorted_at = at[order]
            new = np.flatnonzero(np.concatenate(([True], sorted_at[1:] != sorted_at[:-1])))
            seen, total = sorted_at[new], row_sums(g, order, new)
        square = squares[name][seen] + (total * total).mean(1)
        squares[name][seen] = square
        total *= RATE
        total /= np.sqrt(square)[:, None] + 1e-3
        w[name][seen] = np.subtract(w[name].take(seen, axis=0), total, out=total)


def flat(w: dict[str, np.ndarray], squares: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([x[name].ravel() for x in (w, squares) for name in w])


def unflat(x: np.ndarray, tables: tuple) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    w, squares, at = {}, {}, 0
    for name, rows, columns in tables:
        w[name] = x[at:at + rows * columns].reshape(rows, columns).copy()
        at += rows * columns
    for name, rows, _ in tables:
        squares[name] = x[at:at + rows].copy()
        at += rows
    return w, squares


def train(resolved: DataFrame, shape: Shape, rounds: int = ROUNDS) -> np.ndarray:
    """The flat weights after all training tokens were seen once, a part of the texts each round."""
    spark = resolved.sparkSession
    now = flat(shape.weights(), {name: np.zeros(rows, np.float32) for name, rows, _ in shape.tables})
    rows = resolved.select(F.spark_partition_id().alias("part"), "texts", "words")
    for turn in range(rounds):
        shipped = spark.sparkContext.broadcast((now, shape))  # its size has a bound

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped, turn=turn) -> Iterator[pa.RecordBatch]:
            weights, shape = shipped.value
            w, squares = unflat(weights, shape.tables)
            start, gained = w["tree"].copy(), squares["tree"].copy()
            tokens, part = 0, 0
            for batch in batches:
                for i in range(batch.num_rows):
                    part = batch.column(0)[i].as_py()
                    block = Batches(batch.column(1)[i].as_py(), batch.column(2)[i].as_py(), shape)
                    texts = np.flatnonzero(~block.held)
                    for p, kind, inside, outer, _, inner, seldom, (odds, bit, at) in block.of(texts[texts % rounds == turn]):
                        if len(seldom):  # first, while its rows are in the core's cache
                            bit_step(w, squares, odds, bit, at)
                        step(w, squares, outer, kind)
                        if len(inside):
                            step(w, squares, inner, inside)
                        tokens += len(p)
            if tokens:
                squares["tree"] -= gained
                moved = (w["tree"] - start) * squares["tree"][:, None]
                own = {name: x * np.float32(tokens) for name, x in w.items()} | {"tree": moved}
                total = flat(own, {name: x * np.float32(tokens) for name, x in squares.items()} | {"tree": squares["tree"]})
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part % TASKS_SUMMED], pa.int32()), pa.array([tokens], pa.int64()), pa.array([total.tobytes()], pa.binary())],
                    names=["part", "tokens", "weights"],
                )

        def add(group: pa.Table) -> pa.Table:
            total = np.zeros(0)
            for blob in group.column("weights"):
                x = np.frombuffer(blob.as_py(), np.float32)
                total = x.astype(np.float64) if not len(total) else total + x
            return pa.table([
                pa.array([sum(group.column("tokens").to_pylist())], pa.int64()), pa.array([total.astype(np.float32).tobytes()], pa.binary())
            ], names=["tokens", "weights"])

        sums = rows.mapInArrow(tidy(run), "part int, tokens bigint, weights binary").groupBy("part").applyInArrow(add, "tokens bigint, weights binary")
        total, tokens = np.zeros(len(now)), 0
        for row in sums.toLocalIterator():  # at most TASKS_SUMMED rows of a fixed size, one at a time
            total += np.frombuffer(row["weights"], np.float32)
            tokens += row["tokens"]
        if tokens:
            before, gained = unflat(now, shape.tables)
            moved, squares = unflat(total, shape.tables)
            for name in moved:
                if name == "tree":
                    moved[name] = before[name] + moved[name] / np.maximum(squares[name], 1e-12)[:, None]
                    squares[name] += gained[name]
                else:
                    moved[name], squares[name] = moved[name] / tokens, squares[name] / tokens
            now = flat(moved, squares).astype(np.float32)
        shipped.unpersist()  # else executors and workers keep the weights of every round
    return now


def score(resolved: DataFrame, shape: Shape, weights: np.ndarray) -> DataFrame:
    """(rec, n_tokens, n_known, base_score, score) of each record, scores in log10."""
    shipped = resolved.sparkSession.sparkContext.broadcast((weights, shape))
    rec = T.StructType([T.StructField("rec", resolved.schema["recs"].dataType.elementType)])
    schema = schema_of(rec, "n_tokens bigint, n_known bigint, base_score double, score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat_weights, shape = shipped.value
        w, _ = unflat(flat_weights, shape.tables)
        for batch in batches:
            for i in range(batch.num_rows):
                block = Batches(batch.column(1)[i].as_py(), batch.column(2)[i].as_py(), shape)
                base = np.log10((block.c + 1) / (shape.tokens + shape.words + 1))
                known, totals = (block.c > 0).astype(np.int64), []
                for texts in block.runs(HELD):
                    start, end = block.starts[texts[0]], block.starts[texts[-1]] + block.sizes[texts[-1]]
                    ids, log = block.ids[start:end], np.zeros(end - start)
                    for p, kind, inside, outer, often, inner, seldom, (odds, bit, at) in block.of(texts, SCORED):
                        own = log_softmax_of(w, outer, kind).astype(np.float64) + block.rest[block.ids[p]]
                        if len(often):
                            own[often] += log_softmax_of(w, inner, inside)
                        if len(seldom):
                            own[seldom] -= bit_losses(bit_logits(w, odds, at), bit.ravel()).reshape(bit.shape).sum(0, dtype=np.float64)
                        log[p - start] = own
                    totals.append([np.add.reduceat(x, block.starts[texts] - start) for x in (known[ids], base[ids], log)])
                n_known, base_score, score = map(np.concatenate, zip(*totals))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, 1).flatten(), pa.array(block.sizes), pa.array(n_known),
                    pa.array(base_score), pa.array(score / np.log(10)),
                ], names=["rec", "n_tokens", "n_known", "base_score", "score"])

    return resolved.select("recs", "texts", "words").mapInArrow(tidy(run), schema)


@register("op2_maxent_score")
def op2(spark, sf_dir):
    """Every document's probability, learned from six folds of seven; what the resolved blocks were made from is dropped."""
    small_batches(spark)  # a row may be a block of texts
    held_out, start = fold(F.col("doc_id"), 7) == 2, staged()
    resolved, shape = resolve(number_blocks(table(spark, sf_dir, "documents"), "text", held_out, ["doc_id"]))
    drop_staged(spark, start, staged() - 1)
    found = score(resolved, shape, train(resolved, shape))
    return found.select(
        F.col("rec.doc_id").alias("doc_id"), (fold(F.col("rec.doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known",
        F.lit(shape.tokens).cast("bigint").alias("train_tokens"), "base_score", "score",
    )
