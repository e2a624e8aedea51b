"""What bounds memory and shuffled texts: batch sizes, and where cells meet their texts."""

import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import decontaminate, jaccard_join, maxent


def sizes_of(df):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["rows", "bytes"])

    return df.mapInArrow(run, "rows bigint, bytes bigint").collect()


def test_pipeline_stages_hand_texts_over_in_small_batches(spark):
    keys = [f"spark.sql.execution.arrow.{k}" for k in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    before = [spark.conf.get(k) for k in keys]
    try:
        rows = [(i, "a b " * (200_000 if i % 100 == 0 else 2), "en", "s", 8) for i in range(2000)]
        docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1)
        corpus_pipeline.STAGES[-1][1](spark, docs, "")
        met = sizes_of(docs)
        assert sum(r["rows"] for r in met) == 2000
        assert max(r["rows"] for r in met) <= 512 and max(r["bytes"] for r in met) < 6 << 20
        spark.conf.set(keys[0], "7")
        corpus_pipeline.STAGES[-1][1](spark, docs, "")
        assert spark.conf.get(keys[0]) == "7"
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)


def test_cells_go_to_the_texts_while_they_are_few(spark, monkeypatch):
    texts = [f"{'w ' * i} one two three four five six seven eight".encode() for i in range(3)]
    rows = [(bytes([i]), zstandard.compress(t)) for i, t in enumerate(texts)]
    held = spark.createDataFrame(rows, "sig binary, text binary")
    cells = spark.createDataFrame([("x", bytes([0])), ("x", bytes([1])), ("x", bytes([1])), ("y", bytes([2]))], "cell string, sig binary")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = {}
        for most in (4, 3):
            monkeypatch.setattr(jaccard_join, "SHIPPED_CELLS", most)
            links = jaccard_join.links_in(cells, held, 4, 60)
            plan = links._jdf.queryExecution().executedPlan().toString()
            found["BroadcastHashJoin" in plan] = sorted(map(tuple, links.collect()))
        assert found[True] == found[False] == [(b"\x01", b"\x00")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_sketches_pack_by_bytes():
    counts = np.minimum(np.random.default_rng(1).zipf(1.6, 1 << 16), 0xFFFFFFFF).astype(np.uint32)
    blob = jaccard_join.packed_counts(counts)
    assert np.array_equal(jaccard_join.opened_counts(blob), counts)
    assert len(blob) < 0.8 * len(zstandard.compress(counts.tobytes(), 1))


def test_softmax_of_targets_alone():
    rng = np.random.default_rng(2)
    w = {"a": rng.normal(size=(5, 7)), "b": rng.normal(size=(3, 7))}
    rows, target = {"a": rng.integers(0, 5, 40), "b": rng.integers(0, 3, 40)}, rng.integers(0, 7, 40)
    z = w["a"][rows["a"]] + w["b"][rows["b"]]
    want = (z - np.log(np.exp(z).sum(1, keepdims=True)))[np.arange(40), target]
    assert np.allclose(maxent.log_softmax_of(w, rows, target), want)


def test_frequent_words_of_a_block_are_the_first_of_all(spark):
    """More equally frequent words than are listed: the first by their bytes stay, as among all words."""
    words = [f"w{i}" for i in range(5 * maxent.MOST_FREQUENT)]
    often = words[::-1][:100]
    docs = spark.createDataFrame([(0, " ".join(words + often * 2))], "doc_id bigint, text string")
    numbered = maxent.number_blocks(docs, "text", F.lit(False), ["doc_id"])
    got = [(bytes(x["word"]), x["c"]) for x in numbered.where("often is not null").first()["often"]]
    count = {w.encode(): 1 for w in words} | {w.encode(): 3 for w in often} | {maxent.END: 1}
    assert got == sorted(count.items(), key=lambda x: (-x[1], x[0]))[: 4 * maxent.MOST_FREQUENT]


def test_places_take_as_many_bytes_as_their_steps_need(spark):
    edges = np.array([0, 1, *(x for i in range(1, 5) for x in ((1 << 7 * i) - 1, 1 << 7 * i)), (1 << 32) - 1], np.uint32)
    packed, ends = decontaminate.packed_steps(edges)
    assert np.diff(ends, prepend=0).tolist() == [1, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    assert decontaminate.opened_steps(packed.tobytes()).tolist() == edges.tolist()
    rng = np.random.default_rng(4)
    texts = [" ".join(["the", "of"][int(r < 0.3)] if r < 0.6 else f"w{int(r * 1e6)}" for r in rng.random(300)) for _ in range(200)]
    index = decontaminate.build_index(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1))
    held = index.where("term is not null").agg(F.sum(F.length("places")).alias("bytes"), F.sum("n").alias("n")).first()
    assert held["n"] == 200 * 300 and held["bytes"] < 2 * held["n"]


def block_of(texts, words):
    """A block of ``texts`` short texts over so many words, each met and rare."""
    rng = np.random.default_rng(6)
    sizes = rng.integers(1, 60, texts)
    c, hashes = np.ones(words, np.int64), rng.integers(0, 1 << 32, words, dtype=np.uint32)
    held = {"ids": rng.integers(0, words, sizes.sum()).astype(np.uint32), "sizes": sizes, "held": np.zeros(texts, bool)}
    known = {
        "c": c, "kind": rng.integers(0, maxent.RARE_CLASSES, words).astype(np.int8), "rank": np.full(words, -1, np.int16),
        "hash": hashes, "odds": np.zeros((words, 4), np.int8), "share": np.zeros(words, np.float32),
    }
    shape = maxent.Shape(int(sizes.sum()), words, np.zeros(0), np.full((maxent.RARE_CLASSES, 2), 9.0))
    return maxent.Batches(maxent._packed(**held), maxent._packed(**known), shape)


def test_a_block_is_walked_without_arrays_of_all_its_tokens():
    block = block_of(20_000, 500)
    chosen = np.flatnonzero(np.arange(20_000) % 3 != 1)
    want = np.concatenate([np.arange(s, s + n) for s, n in zip(block.starts[chosen], block.sizes[chosen])])
    tracemalloc.start()
    got, most = [], 0
    for p, *_ in block.of(chosen, 1000):
        got.append(p.astype(np.uint32))
        most = max(most, tracemalloc.get_traced_memory()[1] - sum(x.nbytes for x in got))
        tracemalloc.reset_peak()
    tracemalloc.stop()
    assert np.array_equal(np.concatenate(got), want)
    assert all(len(p) == 1000 for p in got[:-1]) and most < 8 * len(want)
    runs = list(block.runs(5000))
    assert np.array_equal(np.concatenate(runs), np.arange(20_000)) and max(block.sizes[r].sum() for r in runs) < 5060
    assert [len(r) for r in block_of(3, 10).runs(1)] == [1, 1, 1]


def test_row_sums_and_bit_losses_are_the_plain_ones():
    rng = np.random.default_rng(8)
    at = np.sort(np.minimum(rng.geometric(0.002, 5000), 1500) // rng.choice([1, 300], 5000))
    g, order = rng.normal(size=(5000, 32)).astype(np.float32), rng.permutation(5000)
    new = np.flatnonzero(np.diff(at, prepend=-1))
    assert np.array_equal(maxent.row_sums(g, order, new), np.add.reduceat(g[order], new, axis=0))
    z, bit = np.linspace(-90, 90, 2001, dtype=np.float32), rng.integers(0, 2, 2001)
    assert np.allclose(maxent.bit_losses(z, bit), np.logaddexp(0, np.where(bit == 1, -1.0, 1.0) * z), rtol=1e-6, atol=3e-7)


def test_words_are_numbered_as_they_come_without_an_object_a_token():
    texts = [
        [None, "", "  ", "B a\tb \x0b\x0cÉ\r\nx y", "\x1cZ\x85 z"], [], ["a" * 300 + " end "], ["q r", None, " c Q"],
    ]
    number, ids, sizes = {maxent.END: 0}, [], []
    for value in (v for piece in texts for v in piece):
        words = [*(value or "").encode().lower().split(), maxent.END]
        ids += [number.setdefault(w, len(number)) for w in words]
        sizes.append(len(words))
    got = maxent.numbered_words([pa.array(piece, pa.string()) for piece in texts])
    assert got[0] == list(number) and got[1].tolist() == ids and got[2].tolist() == sizes
    none = maxent.numbered_words([pa.array([None, " "], pa.string())])
    assert none[0] == [maxent.END] and none[1].tolist() == [0, 0] and none[2].tolist() == [1, 1]
    many = pa.array([" ".join(f"w{i % 97}" for i in range(200_000))])
    tracemalloc.start()
    words, flat, _ = maxent.numbered_words([many])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(words) == 98 and len(flat) == 200_001 and most < 20 * len(flat)


def test_bits_of_tokens_lie_level_by_level_and_closed_ones_weigh_nothing():
    block, rng = block_of(40, 300), np.random.default_rng(9)
    block.odds = rng.integers(-40, 40, block.odds.shape).astype(np.int8)
    block.odds[rng.random(block.odds.shape) < 0.3] = maxent.SURE
    size = 1 << 32 - int(block.shift)
    w, squares = {"tree": rng.normal(size=(size, 1)).astype(np.float32)}, {"tree": np.zeros(size, np.float32)}
    ids = rng.integers(0, 300, 500)
    features = tuple(rng.integers(0, 1 << 32, 500, dtype=np.uint32) for _ in range(3))
    odds, bit, rows = block.bits_of(ids, features)
    assert rows.shape == (3, block.odds.shape[1], 500)
    losses = maxent.bit_losses(maxent.bit_logits(w, odds, rows), bit.ravel()).reshape(bit.shape)
    before, total = w["tree"][:, 0].copy(), np.zeros(size)
    for token, word in enumerate(ids):
        for level, own in enumerate(block.odds[word]):
            if own == maxent.SURE:
                assert losses[level, token] == 0
                continue
            z = float(before[rows[:, level, token]].sum(dtype=np.float64)) + own / maxent.ODDS
            right = int(block.one[word]) >> 31 - level & 1
            assert losses[level, token] == pytest.approx(np.logaddexp(0, -z if right else z), rel=1e-4, abs=1e-6)
            np.add.at(total, rows[:, level, token], 1 / (1 + math.exp(-z)) - right)
    maxent.bit_step(w, squares, odds, bit, rows)
    want = before - maxent.RATE * total / (np.abs(total) + maxent.TREE_EASE)
    assert np.allclose(w["tree"][:, 0], want, atol=1e-5) and np.allclose(squares["tree"], total ** 2, atol=1e-4)


def near_and_far_sets(seed: int):
    """Random sets, half of them near copies of the one before."""
    rng, sets = np.random.default_rng(seed), []
    for i in range(120):
        n = int(rng.integers(20, 400))
        s = rng.integers(0, 2**64, n, np.uint64)
        if i % 2:
            old = sets[-1]
            s = np.concatenate([old[: len(old) - int(rng.integers(0, 1 + len(old) // 8))], s[: int(rng.integers(0, 1 + len(old) // 12))]])
        sets.append(np.unique(s))
    return sets


def linked_pairs(sets, percent):
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            both = len(np.intersect1d(x, y))
            if 100 * both >= percent * (len(x) + len(y) - both):
                yield i, j


@pytest.mark.parametrize("seed, lists, most", [(1, 60, 1 << 24), (2, 8, 1 << 24), (3, 1, 1 << 24), (4, 1, 5)])
def test_odd_cells_part_sets_but_no_links(monkeypatch, seed, lists, most):
    monkeypatch.setattr(jaccard_join, "MOST_PAIRS", most)
    sets = near_and_far_sets(seed)
    of, n = np.arange(120) * lists // 120, np.array([len(s) for s in sets])
    order = np.lexsort((n, of))
    label = np.empty(120, np.int64)
    label[order] = jaccard_join.parted(of[order], n[order], [jaccard_join.odd_cells(sets[i]) for i in order], 85)
    links = [(i, j) for i, j in linked_pairs(sets, 85) if of[i] == of[j]]
    assert len(links) >= 20 and all(label[i] == label[j] for i, j in links)
    assert len(set(label.tolist())) >= 60 if most > 5 else len(set(label.tolist())) == 1, "sets that only share a list part"


def test_linked_sets_stay_in_the_list_of_their_first_common_shingle():
    sets, links = near_and_far_sets(5), 0
    for i, j in linked_pairs(sets, 85):
        x, y = sets[i], sets[j]
        common = np.intersect1d(x, y)
        e = np.zeros(2, jaccard_join.ENTRY)
        e["n"], e["behind"] = [len(x), len(y)], [np.searchsorted(x, common[0]), np.searchsorted(y, common[0])]
        assert jaccard_join.partnered(e, np.zeros(2, np.int64), 85).all()
        two = [np.searchsorted(x, common[1]) - 1, np.searchsorted(y, common[1]) - 1]
        e["behind"] = two
        assert jaccard_join.partnered(e, np.zeros(2, np.int64), 85).all()
        links += 1
    assert links >= 20
    e["n"], e["behind"] = 100, [12, 0]  # 88 shared at most, 92 needed
    assert not jaccard_join.partnered(e, np.zeros(2, np.int64), 85).any()


def test_sets_that_share_a_key_by_chance_ask_for_no_text(spark, monkeypatch):
    """Pairs of documents with a passage in common, and few cells in the sketch, so that it is among the rarest shingles of many."""
    rows = [(i, " ".join([f"own{i}x{k}" for k in range(90)] + [f"both{i // 2}x{k}" for k in range(12)])) for i in range(40)]
    rows += [(100 + i, rows[i][1] + " more") for i in range(3)]
    asked = []

    def keep(df, label="stage", real=jaccard_join.stage):
        out = real(df, label)
        if label == "jaccard-texts":
            asked.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "stage", keep)
    monkeypatch.setattr(jaccard_join, "boundary", lambda *a: 0)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r[0]: r[1] for r in jaccard_join.join_groups(docs, sketch_cells=64).select("rec.doc_id", "component").collect()}
    assert found == {i: i - 100 if i >= 100 else i for i, _ in rows}
    assert sum(asked) == 6, "texts of the three copies and their originals"


def test_entries_of_lists_pack_into_few_bytes():
    rng = np.random.default_rng(3)
    e = np.zeros(20_000, jaccard_join.ENTRY)
    e["key"], e["half"] = rng.integers(0, 1 << 48, 20_000), rng.integers(0, 2**64, 20_000, np.uint64)
    e["n"] = np.repeat(rng.integers(20, 3000, 400), 50)
    e["behind"] = np.arange(20_000) % 50
    blob = jaccard_join.packed_entries(e)
    assert (jaccard_join.opened_entries(blob) == e).all()
    assert len(blob) < 18 * len(e), "28 bytes an entry before, hardly to be compressed"
    assert (jaccard_join.opened_entries(jaccard_join.packed_entries(e[:1])) == e[:1]).all()
