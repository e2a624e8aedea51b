"""Byte-level BPE by speculate and verify.

A word is first cut by greedy longest match. The cut is the BPE result exactly when every adjacent pair
of its tokens is compatible: no merge across their border would have come before the merges that built
them. All pairs of all new words of a block are checked at once in numpy; only the words with a failing
pair are merged exactly. Decoding joins the bytes of the tokens, broken UTF-8 becoming U+FFFD.

A null text counts as empty and has no tokens; repeated rows are encoded row by row; an empty table gives
an empty result. Input columns travel in a struct, so names cannot clash. A worker's word cache has two
halves, the older of which is dropped when the newer is full, so memory stays bounded.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pylist, register, schema_of, slices, table, tidy

NONE = np.int64(1) << 40
CACHE_WORDS = 200_000
CACHE_WORD_BYTES = 200
#: Up to so many bytes a plain list is merged sooner than a heap.
SHORT_WORD = 64

# The split pattern, and the characters newer than the Unicode version (16) that the
# vocabulary's library knows, given as first-last.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?\p{N}+| ?[^\s{L}\p{N}]+|\s+(?!\S)|\s+"
NEWER = (
    "558-558 58b-58c 88f-88f c5c-c5c cdc-cdc 208f-208f 209d-209f a7ce-a7cf a7d2-a7d2 a7d4-a7d4 a7dd-a7dd a7e2-a7e2 "
    "a7f1-a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a-11b0a 11db0-11ddb 11de0-11de9 "
    "11df1-11df1 1246f-1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda "
    "18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168-1b168 1d6a6-1d6a6 1df1f-1df24 1df2b-1df81 "
    "1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f "
    "2b81e-2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"
)
_newer = "".join(rf"\U{int(a, 16):08x}-\U{int(b, 16):08x}" for a, b in (r.split("-") for r in NEWER.split()))
HAS_NEWER = regex.compile(f"[{_newer}]")
PLAIN = regex.compile(SPLIT.replace("[^\\s{L}\\p{N}]", r"[^\s\p{L}\p{N}]").replace("{L}", r"\p{L}"))
CAREFUL = regex.compile(
    "(?V1)" + SPLIT.replace("[^\\s{L}\\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||[{_newer}]]")
    .replace("{L}", rf"[\p{{L}}--[{_newer}]]").replace(r"\p{N}+|", rf"[\p{{N}}--[{_newer}]]+|")
)


def words_of(text: str) -> list[str]:
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if HAS_NEWER.search(text):
                return CAREFUL.findall(text)
    return PLAIN.findall(text)


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: each byte that prints is itself, the others follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Token bytes, merges and their ranks, as arrays."""

    def __init__(self, text: str):
        model = json.loads(text)
        letters = _byte_letters()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        ids = model["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.bytes: dict[int, bytes] = {i: as_bytes(t) for t, i in ids.items() if t not in self.special}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        n = max(self.bytes) + 1
        self.left, self.right = np.arange(n), np.arange(n)
        self.rank = np.full(n, -1, np.int64)
        keys, made = [], []
        for rank, pair in enumerate(model["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b, whole = ids[a], ids[b], ids[a + b]
            if self.rank[whole] < 0 and a != whole:
                self.left[whole], self.right[whole], self.rank[whole] = a, b, rank
            keys.append(a << 32 | b)
            made.append((rank, whole))
        #: The rank of a pair's merge, and the token that the merge of a rank makes.
        self.ranks = {k: rank for k, (rank, _) in zip(reversed(keys), reversed(made))}
        self.wholes = [whole for _, whole in made]
        self.keys = np.array(sorted(self.ranks), np.int64)
        self.key_rank = np.array([self.ranks[k] for k in self.keys.tolist()], np.int64)
        self.byte_ids = {v[0]: k for k, v in self.bytes.items() if len(v) == 1 and k not in self.special.values()}
        built = [i for i in range(n) if self.rank[i] >= 0]
        clash = self.conflicts(self.left[built], self.right[built], self.rank[built])
        sound = {i: True for i in self.byte_ids.values()}
        for i, bad in sorted(zip(built, clash.tolist()), key=lambda x: self.rank[x[0]]):
            sound[i] = not bad and sound.get(self.left[i], False) and sound.get(self.right[i], False)
        #: Only tokens that their own bytes are encoded to may be proposed.
        self.longest = {self.bytes[i]: i for i, good in sound.items() if good}
        by_start: dict[bytes, set[int]] = {}
        for token in self.longest:
            if len(token) > 2:
                by_start.setdefault(token[:3], set()).add(len(token))
        #: The lengths of the tokens that begin with given three bytes, longest first.
        self.lengths = {start: tuple(sorted(found, reverse=True)) for start, found in by_start.items()}

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_rank[at], NONE)

    def conflicts(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether, for each pair of neighbours, a merge across the border (before ``limit``) comes first.

        Runs time backwards: (x, y) are the tokens that touch the border, (px, py) the ranks at which
        they were merged further. A merge of rank m of x with y happens when m < px, the left side of equal
        ranks being merged first, and m <= py. Then the younger of the two is taken apart.
        """
        x, y = a.astype(np.int64), b.astype(np.int64)
        px = np.full(len(x), NONE) if limit is None else limit.astype(np.int64)
        py = px.copy()
        bad = np.zeros(len(x), bool)
        live = np.arange(len(x))
        while len(live):
            m = self._pair_rank(x[live], y[live])
            hit = (m < px[live]) & (m <= py[live]) & (m < NONE)
            bad[live[hit]] = True
            live = live[~hit]
            rx, ry = self.rank[x[live]], self.rank[y[live]]
            live, rx, ry = (v[(rx >= 0) | (ry >= 0)] for v in (live, rx, ry))
            first, second = live[rx > ry], live[rx <= ry]
            px[first], x[first] = self.rank[x[first]], self.right[x[first]]
            py[second], y[second] = self.rank[y[second]], self.left[y[second]]
        return bad

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match; only lengths that a token of the same start has are tried."""
        out, at, n = [], 0, len(word)
        token_of, lengths_of = self.longest.get, self.lengths.get
        while at < n:
            for size in lengths_of(word[at:at + 3], ()):
                if (token := token_of(word[at:at + size])) is not None and at + size <= n:
                    break
            else:
                size = 2
                token = token_of(word[at:at + 2])
                if token is None or at + 2 > n:
                    size = 1
                    token = token_of(word[at:at + 1])
            out.append(token)
            at += size
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the least rank first, the leftmost of equal ranks; the ranks of all neighbours are kept in a list."""
        if len(word) > SHORT_WORD:
            return self.merge_long(word)
        ids = [self.byte_ids[b] for b in word]
        rank_of, none = self.ranks.get, len(self.wholes)
        ranks = [rank_of(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            ids[i] = whole = self.wholes[least]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of(ids[i - 1] << 32 | whole, none)
            if i < len(ranks):
                ranks[i] = rank_of(whole << 32 | ids[i + 1], none)
        return ids

    def merge_long(self, word: bytes) -> list[int]:
        """The same over a linked list with a heap."""
        ids = [self.byte_ids[b] for b in word]
        n, wholes = len(ids), self.wholes
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, i) for i in range(n - 1) if (rank := self.ranks.get(ids[i] << 32 | ids[i + 1])) is not None]
        heap = [(rank, i, wholes[rank], ids[i], ids[i + 1]) for rank, i in heap]
        heapq.heapify(heap)
        while heap:
            _, i, whole, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = whole, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (rank := self.ranks.get(ids[left] << 32 | ids[right])) is not None:
                    heapq.heappush(heap, (rank, left, wholes[rank], ids[left], ids[right]))
        return [i for i in ids if i >= 0]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        cuts = [self.propose(w) for w in words]
        flat = np.fromiter((t for c in cuts for t in c), np.int64)
        of = np.repeat(np.arange(len(cuts)), [len(c) for c in cuts])
        inner = np.flatnonzero(of[:-1] == of[1:]) if len(of) else np.zeros(0, np.int64)
        for w in np.unique(of[inner[self.conflicts(flat[inner], flat[inner + 1])]]).tolist():
            cuts[w] = self.merge(words[w])
        return cuts


class Coder:
    """Encodes and decodes texts; keeps the words it has met."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.ids: dict[str, str] = {}
        self.odd: dict[str, bytes] = {}
        self.older: tuple[dict[str, str], dict[str, bytes]] = {}, {}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, vocabulary.special)) + ")") if vocabulary.special else None

    def _learn(self, words: list[str]) -> tuple[dict[str, str], dict[str, bytes]]:
        """The ids of the words, and what they decode to where that is not the word itself."""
        raw = [w.encode() for w in words]
        cuts = self.vocabulary.encode_words(raw)
        token = self.vocabulary.bytes
        back = [b"".join([token[i] for i in c]) for c in cuts]
        return {w: ",".join(map(str, c)) for w, c in zip(words, cuts)}, {w: d for w, r, d in zip(words, raw, back) if r != d}

    def run(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(tokens, ids joined by commas, decoded text) of each text; equal texts are coded once."""
        distinct = list(dict.fromkeys(texts))
        coded = dict(zip(distinct, self._code(distinct)))
        return [coded[t] for t in texts]

    def _code(self, texts: list[str]) -> list[tuple[int, str, str]]:
        split = []
        for text in texts:
            if self.cut is not None and any(s in text for s in self.vocabulary.special):
                words = []
                for part in self.cut.split(text):
                    words += [part] if part in self.vocabulary.special else words_of(part)
            else:
                words = words_of(text)
            split.append(words)
        if len(self.ids) > CACHE_WORDS:  # words met again come back from the older half
            self.older = self.ids, self.odd
            self.ids, self.odd = {}, {}
        for special, i in self.vocabulary.special.items():
            self.ids[special] = str(i)
        fresh = set().union(*split).difference(self.ids)
        for w in fresh.intersection(self.older[0]):
            self.ids[w] = self.older[0][w]
            if w in self.older[1]:
                self.odd[w] = self.older[1][w]
        fresh.difference_update(self.ids)
        long = {w for w in fresh if len(w) > CACHE_WORD_BYTES}
        ids, odd = self._learn(list(fresh - long))
        self.ids |= ids
        self.odd |= odd
        rare_ids, rare_odd = self._learn(list(long))  # long words are not kept
        odd = self.odd | rare_odd
        out = []
        for words in split:
            if rare_ids and any(len(w) > CACHE_WORD_BYTES for w in words):
                joined = ",".join([rare_ids[w] if w in rare_ids else self.ids[w] for w in words])
            else:
                joined = ",".join(map(self.ids.__getitem__, words))
            # each distinct word was decoded from its tokens
            if odd and not odd.keys().isdisjoint(words):
                plain = b"".join([odd[w] if w in odd else w.encode() for w in words]).decode("utf-8", "replace")
            else:
                plain = "".join(words)
            out.append((joined.count(",") + 1 if joined else 0, joined, plain))
        return out


_coders: dict[int, Coder] = {}


def encode(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(rec, n_tokens, ids, decoded): the record, its tokens, their ids joined by commas, the text they decode to.

    ``keep`` names the columns of the record, all by default.

    ``path`` names the vocabulary file, which the driver reads; its size does not depend on the data.
    """
    with open(path, encoding="utf-8") as file:
        shipped = docs.sparkSession.sparkContext.broadcast(file.read())
    kept = [F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]
    rows = docs.select(F.struct(*kept).alias("rec"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    schema = schema_of(rows.select("rec").schema, "n_tokens bigint, ids string, decoded string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(shipped.value)
        coder = _coders.get(key) or _coders.setdefault(key, Coder(Vocabulary(shipped.value)))
        for batch in slices(batches):
            found = coder.run(pylist(batch, "text"))
            n, ids, decoded = zip(*found) if found else ((), (), ())
            fields = [pa.field("n_tokens", pa.int64()), pa.field("ids", pa.string()), pa.field("decoded", pa.string())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                schema=pa.schema([batch.schema.field(0), *fields]),
            )

    return rows.mapInArrow(tidy(run), schema)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op6_bpe_codec")
def op6(spark, sf_dir):
    """Every text encoded and decoded again."""
    coded = encode(table(spark, sf_dir, "documents"), vocabulary_path(), keep=["doc_id"])
    return coded.select(
        F.col("rec.doc_id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
