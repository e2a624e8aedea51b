"""Language ID, quality, LM scoring and neighbours: held-out accuracy, brute force, odd inputs."""

import math
import os
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import language_id, maxent, neighbours, quality

from .conftest import sentence

SF_DIR = "/root/testdata/sf0.01"
data = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def crc(value) -> int:
    return zlib.crc32(("" if value is None else str(value)).encode())


@data
def test_languages_of_held_out_texts(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    fold = language_id.fold(F.col("doc_id"), 4)
    model = language_id.learn(docs.where(fold != 2))
    found = language_id.identify(docs.where(fold == 2), model)
    right = found.agg(F.avg((F.col("rec.lang") == F.col("lang_pred")).cast("double")), F.min("score"), F.max("score")).first()
    assert right[0] > 0.98 and 0 <= right[1] and right[2] <= 1


def test_odd_texts_have_a_language_or_none(spark, odd_docs, no_docs):
    model = language_id.learn(odd_docs)
    assert model.languages == ["en", "fr"]
    got = {r["rec"]["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(odd_docs, model).collect()}
    assert {i for i, v in got.items() if v == ("und", 0.0)} == {4, 5, 6, 10, 11}
    assert language_id.identify(no_docs, model).count() == 0
    nothing = language_id.learn(no_docs)
    assert {r["lang_pred"] for r in language_id.identify(odd_docs, nothing).collect()} == {"und"}
    alone = language_id.learn(odd_docs.where("lang = 'en'"))
    assert {r["lang_pred"] for r in language_id.identify(odd_docs, alone).collect()} == {"und", "en"}


@pytest.mark.parametrize("languages", [2, 3, 4, 5, 6, 40])
def test_codewords_are_apart(languages):
    code = language_id.codewords(languages)
    apart = [(code[i] != code[j]).sum() for i in range(languages) for j in range(i)]
    assert min(apart) >= (1 if languages < 6 else code.shape[1] // 5)
    assert len({tuple(c) for c in code}) == languages


def test_a_wrong_bit_is_corrected():
    model = language_id.Model([])
    model.languages, model.code, model.bits = list("abcd"), language_id.codewords(4), np.ones(7)
    margins = model.code * 2.0
    margins[:, 3] *= -1
    share, close = model.decode(margins)
    assert share.argmax(1).tolist() == [0, 1, 2, 3] and not close.any()
    assert model.decode(np.zeros((1, 7)))[1].all()


@data
def test_quality_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    fold = language_id.fold(F.col("doc_id"), 5)
    trees = quality.train(docs, labels.where(fold != 0))
    judged = quality.score(docs, trees, keep=["doc_id"]).select("rec.doc_id", "score").join(labels.where(fold == 0), "doc_id")
    right = judged.agg(F.avg(((F.col("score") >= 0.3) == (F.col("quality") == 1)).cast("double"))).first()[0]
    assert right > 0.95


def test_odd_documents_have_a_quality(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (None, 1), (3, None), (13, 0), (999, 1)], "doc_id bigint, quality int")
    scores = [r["score"] for r in quality.score(odd_docs, quality.train(odd_docs, labels)).collect()]
    assert len(scores) == odd_docs.count() and all(0 <= s <= 1 for s in scores)
    assert quality.score(no_docs, quality.train(no_docs, labels)).count() == 0
    untaught = quality.train(odd_docs, labels.where("quality > 5"))
    assert {r["score"] for r in quality.score(odd_docs, untaught).collect()} == {0.5}


def test_flat_trees_walk_like_nested_ones():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 6))
    trees = quality.grow(x, (x[:, 1] + x[:, 4] > 0).astype(float))
    for row in x[:40]:
        raw = trees.base
        for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf):
            at = 0
            while at < len(feature):
                at = 2 * at + (2 if row[feature[at]] > threshold[at] else 1)
            raw += leaf[at - len(feature)]
        assert trees.raw(row[None])[0] == pytest.approx(raw)
    assert ((trees.score(x) > 0.5) == (x[:, 1] + x[:, 4] > 0)).mean() > 0.95


def lm(docs):
    held = language_id.fold(F.col("doc_id"), 7) == 2
    resolved, shape = maxent.resolve(maxent.number_blocks(docs, "text", held, ["doc_id", "text"]))
    return maxent.score(resolved, shape, maxent.train(resolved, shape)), shape


def test_unigram_base_agrees_with_brute_force(spark, odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    tokens = [[*(t or "").encode().lower().split(), b"\n"] for _, t in rows]
    counts = Counter(w for (i, _), ws in zip(rows, tokens) if crc(i) % 7 != 2 for w in ws)
    total = sum(counts.values())
    expected = sorted(
        (str(i), len(ws), sum(counts[w] > 0 for w in ws), round(sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in ws), 6))
        for (i, _), ws in zip(rows, tokens)
    )
    found, shape = lm(odd_docs)
    got = found.collect()
    assert shape.tokens == total and shape.words == len(counts)
    assert sorted((str(r["rec"]["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == expected
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_lm_of_nothing(spark, no_docs, odd_docs):
    assert lm(no_docs)[0].count() == 0
    taught_nothing, _ = lm(odd_docs.where("doc_id = 4"))
    assert taught_nothing.count() == 1


def softmax(z):
    e = np.exp(np.array(z, float) - max(z))
    return e / e.sum()


class PlainModel:
    """The language model word by word: counts and nodes in dictionaries, hashes as Python integers."""

    def __init__(self, texts, weights, shape):
        self.w, _ = maxent.unflat(weights, shape.tables)
        self.counts, self.bits, self.tree_bits = Counter(w for t in texts for w in t), shape.bits, shape.tree_bits
        self.frequent = sorted(self.counts, key=lambda w: (-self.counts[w], w))[:384]
        self.rare = [w for w in self.counts if w not in set(self.frequent)]
        self.classes, self.nodes, self.alike = Counter(), Counter(), Counter()
        for w in self.rare:
            kind, path = maxent.rare_class(w), f"{maxent.word_hash(w) >> 32:032b}"
            self.alike[kind, path] += self.counts[w] + 1
            self.classes[kind, path[: self.bits]] += self.counts[w] + 1
            for n in range(self.bits, 33):
                self.nodes[kind, path[:n]] += self.counts[w] + 1
        for kind in range(20):
            for c in range(1 << self.bits):
                path = f"{c:0{self.bits}b}" if self.bits else ""
                for n in range(self.bits):
                    self.nodes[kind, path[:n]] += self.classes[kind, path] + 1
                self.nodes[kind, path[: self.bits], "class"] += self.classes[kind, path] + 1

    def side(self, kind, path):
        return self.nodes[(kind, path, "class")] if len(path) == self.bits else self.nodes[kind, path]

    def log_prob(self, word, context, depth):
        m = 0xFFFFFFFF
        top = [maxent.word_hash(w) >> 32 for w in context]
        last = top[-1] if top else 1
        two = (top[-2] * 0x9E3779B1 & m) ^ (top[-2] >> 15) if len(top) > 1 else 2
        both = (last * 0x85EBCA6B & m) ^ (two + 0x9E3779B9 & m)
        both = ((both ^ both >> 13) * 0xC2B2AE35 & m) >> 8
        w = self.w
        outer = softmax(w["bias"][0] + w["last"][last % 2048] + w["skip"][two % 1024] + w["both"][both % 8192])
        if word in self.frequent:
            k, i = divmod(self.frequent.index(word), 32)
            inner = softmax(w["bias_in"][k] + w["last_in"][last % 512 * 12 + k] + w["skip_in"][two % 256 * 12 + k])
            return math.log(outer[k]) + math.log(inner[i])
        kind, h = maxent.rare_class(word), maxent.word_hash(word) >> 32
        path = f"{h:032b}"
        found = math.log(outer[12 + kind])
        known = self.counts[word] > 0
        for n in range(self.bits + depth[path[: self.bits]] if known else self.bits):
            if n < self.bits:
                left, right = (self.side(kind, path[:n] + x) for x in "01")
            else:
                left, right = (self.nodes[kind, path[:n] + x] for x in "01")
            if not left or not right:
                continue
            z = max(-127, min(127, round(4 * math.log(right / left)))) / 4
            node = (int(path[:n] or "0", 2) * 0x9E3779B1 & m) ^ ((12 + kind) * 0x85EBCA6B & m) ^ (n * 0x27D4EB2F & m)
            node ^= node >> 16
            for i, f in enumerate((last, two, both)):
                z += w["tree"][(((f * 0xC2B2AE35 + (i + 1) * 0x165667B1 & m) ^ node) * 0x9E3779B1 & m) >> 32 - self.tree_bits, 0]
            found -= math.log1p(math.exp(-z if path[n] == "1" else z))
        mass = self.classes[kind, path[: self.bits]] + 1
        if not known:
            return found - math.log(mass)
        last_node = self.nodes[kind, path[: self.bits + depth[path[: self.bits]]]]
        return found + math.log((mass - 1) / mass) + math.log((self.counts[word] + 1) / last_node)


def test_every_word_is_scored_by_features_as_a_plain_model_does(spark):
    rng = np.random.default_rng(11)
    texts = [" ".join(f"w{int(x)}q{int(x) % 37}" for x in rng.zipf(1.25, 60) % 2500) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    held = language_id.fold(F.col("doc_id"), 7) == 2
    resolved, shape = maxent.resolve(maxent.number_blocks(docs, "text", held, ["doc_id"]))
    weights = maxent.train(resolved, shape)
    assert shape.bits == 1 and np.count_nonzero(maxent.unflat(weights, shape.tables)[0]["tree"]) > 1000
    tokens = [[*t.encode().split(), b"\n"] for t in texts]
    plain = PlainModel([t for i, t in enumerate(tokens) if crc(i) % 7 != 2], weights, shape)
    assert len(plain.rare) > 500
    most = Counter()
    for w in plain.rare:
        path = f"{maxent.word_hash(w) >> 32:032b}"[: shape.bits]
        most[path, maxent.rare_class(w)] += 1
    depth = Counter()
    for (path, _), n in most.items():
        depth[path] = max(depth[path], n.bit_length())
    got = {r["rec"]["doc_id"]: r["score"] for r in maxent.score(resolved, shape, weights).collect()}
    for i in range(0, 300, 12):
        expected = sum(plain.log_prob(w, tokens[i][:at], depth) for at, w in enumerate(tokens[i])) / math.log(10)
        assert got[i] == pytest.approx(expected, rel=1e-4)
    unknown = {}
    for n in range(20_000):  # one unknown word of each class
        w = f"x{n}".encode()
        unknown.setdefault((maxent.rare_class(w), maxent.word_hash(w) >> (64 - shape.bits)), w)
    assert len(unknown) == 40
    for context in ([], [b"w1q1"], [b"w2q2", b"w900q12"], [b"never", b"met"]):
        total = sum(math.exp(plain.log_prob(w, context, depth)) for w in [*plain.counts, *unknown.values()])
        assert total == pytest.approx(1, abs=1e-4)


@data
def test_the_model_beats_the_unigrams_on_held_out_texts(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found, _ = lm(docs)
    held = found.where(language_id.fold(F.col("rec.doc_id"), 7) == 2)
    score, base = held.agg(F.sum("score"), F.sum("base_score")).first()
    assert score > base


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")


def test_neighbours_agree_with_brute_force_where_all_leaves_are_met(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 8)).astype(np.float32)
    x[100:400] = x[100]  # one vector held by many rows
    rows = [(i, x[i].tolist()) for i in range(700)]
    odd = [(800, None), (801, []), (802, [0.0] * 8), (803, [1.0, None] + [0.0] * 6), (804, [float("nan")] * 8), (805, [float("inf")] * 8), (None, [1.0] * 8), (806, [1.0, 2.0])]
    df = vectors(spark, rows + rows[:50] + odd)
    index = neighbours.build_index(df, "vec_id", "embedding", 20, block_rows=200)
    found = neighbours.search(index, df.where("vec_id % 20 = 0"), "vec_id", "embedding", 20, share=1e9, chunk_queries=10)
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 700, 20))
    x64 = x.astype(float)
    for q, near in got.items():
        near.sort()
        score = (x64 * x64[q]).sum(1)
        best = sorted((i for i in range(700) if i != q), key=lambda i: (-score[i], i))[:20]
        assert [n[1] for n in near] == best and [n[0] for n in near] == list(range(1, 21))
        assert np.allclose([n[2] for n in near], score[best])


@data
def test_recall(spark):
    df = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    rows = df.collect()
    x, ids = np.array([r["embedding"] for r in rows], float), np.array([r["vec_id"] for r in rows])
    found = {}
    for r in neighbours.nearest(df, df.where("vec_id % 20 = 0")).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    met = []
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        score[q] = -np.inf
        met.append(len(found[ids[q]] & set(ids[np.argsort(-score)[:20]].tolist())) / 20)
    assert np.mean(met) >= 0.9


def test_neighbours_of_nothing(spark):
    assert neighbours.nearest(vectors(spark, []), vectors(spark, [])).count() == 0
    few = vectors(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5])])
    assert [(r["query_id"], r["vec_id"]) for r in neighbours.nearest(few, few.where("vec_id = 0")).collect()] == [(0, 1)]
