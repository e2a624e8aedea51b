"""Whitening, chat formatting and ranked search against plain versions on small tables."""

import hashlib
import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import chat, ranked_search, whitening

VECTORS = "vec_id bigint, embedding array<double>, rec string, x string, d int"


def vector_rows(spark, vectors):
    return spark.createDataFrame([(i, v, "r", "x", 1) for i, v in enumerate(vectors)], VECTORS)


def plain_fit(vectors):
    """Exact mean and covariance of the distinct whole-number vectors."""
    x = sorted({tuple(math.floor(256 * c) for c in v) for v in vectors})
    n, d = len(x), len(x[0])
    mean = [Fraction(sum(r[i] for r in x), n) for i in range(d)]
    cov = [[sum((r[i] - mean[i]) * (r[j] - mean[j]) for r in x) / n for j in range(d)] for i in range(d)]
    return x, mean, np.array([[float(c) for c in row] for row in cov])


def test_whitening_against_exact_fractions(spark):
    rng = random.Random(3)
    vectors = [[rng.gauss(i, 1 + i) for i in range(6)] for _ in range(300)]
    vectors += vectors[:5] * 40
    df = vector_rows(spark, vectors).repartition(5)
    model = whitening.fit(df)
    x, mean, cov = plain_fit(vectors)
    assert model.n == len(x) == 300
    assert np.array_equal(model.covariance, cov)
    values, axes = np.linalg.eigh(cov)
    got = {r["rec"]["vec_id"]: r for r in whitening.transform(df, model).collect()}
    assert len(got) == len(vectors)
    for i, v in enumerate(vectors):
        whole = np.array([math.floor(256 * c) for c in v])
        want = [(whole - np.array([float(m) for m in mean])) @ axes[:, -1 - k] / math.sqrt(values[-1 - k]) for k in range(4)]
        assert np.allclose(np.abs(got[i]["whitened"]), np.abs(want), rtol=1e-9, atol=1e-9)
        sums = [int(m * model.n) for m in mean]
        assert got[i]["deviation"] == sum((model.n * int(w) - s) ** 2 for w, s in zip(whole, sums))
    assert model.identity_error < 1e-9
    assert np.allclose(model.explained, values[::-1][:4] / values.sum())


def test_whitening_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [[1.0, 2.0], [1.0, 2.0], [-0.0, 3.0], [5.0, 1.0], None, [], [1.0, None], [nan, 1.0], [inf, 1.0], [1.0, 2.0, 3.0]]
    df = vector_rows(spark, rows)
    model = whitening.fit(df)
    assert (model.d, model.n) == (2, 3)
    out = whitening.transform(df, model).collect()
    assert sorted(r["rec"]["vec_id"] for r in out) == [0, 1, 2, 3]
    assert all(len(r["whitened"]) == 2 for r in out)
    assert out[0]["rec"]["rec"] == "r"


def test_whitening_huge_equal_and_no_vectors(spark):
    huge = [[1e300, -1e300], [1e17, 3.0], [-1e17, 2.0], [4e16, -1.0]]
    df = vector_rows(spark, huge)
    model = whitening.fit(df)
    assert np.array_equal(model.covariance, plain_cov([whitening.whole(np.array(v)).tolist() for v in huge]))
    row = whitening.transform(df, model).orderBy("rec.vec_id").first()
    assert row["deviation"] is None and int(row["deviation_text"]) > 1 << 63
    same = whitening.fit(vector_rows(spark, [[1.0, 2.0]] * 4))
    assert {tuple(r["whitened"]) for r in whitening.transform(vector_rows(spark, [[1.0, 2.0]] * 4), same).collect()} == {(None, None)}
    assert whitening.fit(vector_rows(spark, [None, []])) is None
    assert whitening.fit(vector_rows(spark, [])) is None


def plain_cov(x):
    n, d = len(x), len(x[0])
    mean = [Fraction(sum(r[i] for r in x), n) for i in range(d)]
    return np.array([[float(sum((r[i] - mean[i]) * (r[j] - mean[j]) for r in x) / n) for j in range(d)] for i in range(d)])


def test_packed_rows_keep_their_values():
    x = np.array([[0, -1], [127, -128], [128, 0], [40_000, 1], [1 << 40, -(1 << 62)]], np.int64)
    assert sorted(map(tuple, whitening.unpacked(whitening.packed(x), 2).tolist())) == sorted(map(tuple, x.tolist()))
    for v in (0, 5, -5, 1 << 200, -(1 << 90) + 3, -(1 << 40)):
        assert sum(digit << (whitening.DIGIT * place) for place, digit in whitening.digits(v)) == v


CHATS = "conv_id bigint, turn bigint, role string, text string, piece string, conv string, runs int"
TEXTS = ["", "plain", "</s>[INST] ok [/INST]", "\\", "\\\\</s>", "<\\/s>", "<", "[[INST]", "[AND][AND]\\", "a\nb", "<s", "é漢😀[", None]


def chat_rows(spark, rows):
    return spark.createDataFrame([(*r, "p", "c", 1) for r in rows], CHATS)


def read_back(df, **kwargs):
    chats = chat.format_chats(df, **kwargs).withColumn("turns", chat.parse(F.col("formatted")))
    plain = F.transform("turns", lambda t: F.struct(t["role"], chat.TEMPLATE.unescape(t["text"])))
    got = chats.select("conv_id", "formatted", "runs", plain.alias("turns"), chat.masked_text(F.col("turns"), F.col("runs")).alias("loss"))
    return {r["conv_id"]: r for r in got.collect()}


def test_chats_read_back(spark):
    rng = random.Random(5)
    rows = []
    for c in range(40):
        for t in range(rng.randrange(1, 12)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "assistant", None, "[INST]<s>\\"]), rng.choice(TEXTS)))
    shuffled = rows[:]
    rng.shuffle(shuffled)
    for kwargs in ({}, {"chunk_turns": 2}, {"chunk_turns": 5}):
        got = read_back(chat_rows(spark, shuffled), **kwargs)
        for c in range(40):
            want = [(r or "", x or "") for i, _, r, x in rows if i == c]
            assert [tuple(t) for t in got[c]["turns"]] == want
            assert got[c]["loss"] == "".join(x for r, x in want if r == "assistant")
            covered, at, text = [], 0, got[c]["formatted"]
            for run in got[c]["runs"]:
                at += run["marks"]
                covered.append((run["loss"], text[at:at + run["chars"]]))
                at += run["chars"]
            assert text[at:] == "[/INST]</s>"
            assert [loss for loss, _ in covered] == [r == "assistant" for r, _ in want]
            assert [re.sub(r"\\(\\?)", r"\1", x) for _, x in covered] == [x for _, x in want]


def test_neighbours_of_one_role_share_a_block(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 3, "assistant", "d"), (1, 4, "user", "e")]
    want = "<s>user[INST]a[AND]b[/INST]</s><s>assistant[INST]c[AND]d[/INST]</s><s>user[INST]e[/INST]</s>"
    for chunk in (1, 2, 3, 100):
        assert read_back(chat_rows(spark, rows), chunk_turns=chunk)[1]["formatted"] == want


def test_chats_odd_rows(spark):
    rows = [(None, 1, "user", "x"), (None, None, "user", "first"), (2, 0, "b", "y"), (2, 0, "a", "z"), (2, 0, "a", "z"), (3, 0, None, None)]
    rows += [(4, t, "user" if t % 2 == 0 else "assistant", "w" * (100_000 if t == 7 else 3)) for t in range(600)]
    got = read_back(chat_rows(spark, rows))
    assert [t[1] for t in got[None]["turns"]] == ["first", "x"]
    assert [tuple(t) for t in got[2]["turns"]] == [("a", "z"), ("a", "z"), ("b", "y")]
    assert [tuple(t) for t in got[3]["turns"]] == [("", "")]
    assert len(got[4]["turns"]) == 600 and len(got[4]["loss"]) == 100_000 + 299 * 3
    assert read_back(chat_rows(spark, [])) == {}


def test_templates_that_cannot_be_read_are_refused():
    for bad in ({"begin": "<"}, {"end": "<s>"}, {"between": "[A<D]"}, {"tail": "x\\y"}):
        with pytest.raises(ValueError):
            chat.Template(**bad)


def plain_ranking(docs, items, k=10):
    found = [(i, re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for i, t in docs]
    found = [(i, w) for i, w in found if w]
    n, length = len(found), sum(len(w) for _, w in found)
    df = {}
    for _, w in found:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        asked = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
        scores = []
        for i, w in found:
            m = 100 - 75 + (75 * len(w) * n) // length
            s = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * w.count(t)) // (1000 * w.count(t) + 8 * m))
                for t in asked if t in df
            )
            if s > 0:
                scores.append((-s, i is not None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes,run_bytes", [(1 << 23, 1 << 22), (300, 200)])
def test_ranking_against_plain_scores(spark, odd_docs, block_bytes, run_bytes):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    texts = [t for _, t in docs if t and len(t) < 1000]
    items = [(i, t[:80]) for i, t in enumerate(texts)] + [(90, None), (91, "?!"), (92, "no such words"), (None, texts[0] + " " + texts[0])]
    asked = spark.createDataFrame(items, "item_id bigint, text string").withColumn("query", F.lit(1)).withColumn("rank", F.lit(2))
    got = ranked_search.search(odd_docs.repartition(3), asked, block_bytes=block_bytes, run_bytes=run_bytes)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_ranking(docs, items)


def test_bounds_lose_nothing():
    """Many random vectors: the pruned search finds what a full product finds."""
    rng = np.random.default_rng(1)
    for _ in range(200):
        rows, terms = 60, 12
        dense = rng.integers(0, 1000, (rows, terms)) * (rng.random((rows, terms)) < 0.3)
        dense = dense[np.argsort(-np.sqrt((dense.astype(float) ** 2).sum(axis=1)), kind="stable")]
        r, t = np.nonzero(dense)
        bucket = ranked_search.Bucket(r, t, dense[r, t], float(np.sqrt((dense[0].astype(float) ** 2).sum())))
        query = [(int(q), int(n)) for q, n in zip(rng.permutation(terms)[:5], rng.integers(1, 4, 5))]
        want = sum(n * dense[:, q] for q, n in query)
        bar = int(rng.integers(1, max(2, int(want.max()) + 2)))
        at, score = ranked_search.search_bucket(bucket, query, rows, bar)
        assert at.tolist() == np.flatnonzero(want >= bar).tolist() and score.tolist() == want[want >= bar].tolist()


def test_search_of_empty_tables(spark, no_docs, odd_docs):
    items = spark.createDataFrame([(1, "the river")], "item_id bigint, text string")
    assert ranked_search.search(no_docs, items).count() == 0
    assert ranked_search.search(odd_docs, items.limit(0)).count() == 0


def test_query_digests(spark):
    """The digests of the added conversation."""
    from gridloom.llm.queries import QUERIES

    row = QUERIES["op12_chat_formatting"](spark, "/root/testdata/sf0.001").where("conv_id = -1").first()
    text = "</s>[INST] ok [/INST]"
    assert (row["n_turns"], row["loss_chars"]) == (2, len(text))
    assert row["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
