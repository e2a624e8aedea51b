"""Approximate nearest neighbours by a forest of random-projection trees.

The vectors are spread over blocks of bounded size. Each block grows a forest over its distinct vectors: a tree
splits a node at the median of its vectors' projections on the difference of two of them. A query enters the leaves
of all trees in the order of one shared priority queue, whose key is the least signed margin on the way to a
leaf, until it has met a set share of the leaves; the vectors met are reranked by exact inner products in double
precision, and the best of all blocks are merged. Every row is indexed; the queries are a stated set that
meets all blocks, a chunk of queries with a block at a time.

Equal vectors of a block are one entry of the tree with their k + 1 least ids, which is all that can be asked
of them, so a vector that holds any share of the rows costs no more. Vectors that are null, empty, zero, or
hold null or non-finite numbers take no part; vectors of different lengths never meet; rows without an id
are no candidates. Rows of one id and vector are one candidate, and queries of one id are one query where
their vectors agree. An empty table gives an empty result.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import stage

from .common import register, table

BLOCK_ROWS = 16_384
CHUNK_QUERIES = 2_048
TREES, LEAF_ROWS, LEAF_SHARE = 16, 64, 1.4


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & good & F.exists(vector, lambda x: x != 0), F.lit(False))


class Forest:
    """Trees of one block as arrays; node i has children 2i+1 and 2i+2, leaves are numbered from left to right."""

    def __init__(self, vectors: np.ndarray, seed: list[int]):
        rng, n = np.random.default_rng(seed), len(vectors)
        self.depth = max(0, int(np.ceil(np.log2(max(n, 1) / LEAF_ROWS))))
        inner = 2**self.depth - 1
        self.normals = np.zeros((TREES, inner, vectors.shape[1]))
        self.cuts = np.zeros((TREES, inner))
        self.order, self.ends = np.zeros((TREES, n), np.int32), np.zeros((TREES, inner + 2), np.int64)
        for t in range(TREES):
            at = np.zeros(n, np.int64)
            for level in range(self.depth):
                first = 2**level - 1
                order = np.argsort(at, kind="stable")
                ends = np.searchsorted(at[order], np.arange(2**level + 1))
                side = np.zeros(n, bool)
                for k in range(2**level):
                    held = order[ends[k]:ends[k + 1]]
                    if len(held) > 1:
                        a, b = rng.choice(held, 2, replace=False)
                        w = vectors[a] - vectors[b]
                        w /= np.linalg.norm(w)
                        p = vectors[held] @ w
                        self.normals[t, first + k], self.cuts[t, first + k] = w, np.median(p)
                        side[held] = p > self.cuts[t, first + k]
                at = 2 * at + side
            self.order[t] = np.argsort(at, kind="stable")
            self.ends[t] = np.searchsorted(at[self.order[t]], np.arange(2**self.depth + 1))

    def priorities(self, queries: np.ndarray) -> np.ndarray:
        """For each query the queue's key of every leaf of every tree."""
        found = []
        for normals, cuts in zip(self.normals, self.cuts):
            margin = queries @ normals.T - cuts
            key = np.full((len(queries), 1), np.inf)
            for level in range(self.depth):
                m = margin[:, 2**level - 1:2 ** (level + 1) - 1]
                key = np.stack([np.minimum(key, -m), np.minimum(key, m)], 2).reshape(len(queries), -1)
            found.append(key)
        return np.concatenate(found, 1)

    def candidates(self, queries: np.ndarray, share: float) -> Iterator[np.ndarray]:
        """The entries each query meets: whole leaves, best keys first, over all trees."""
        leaves = 2**self.depth
        take = min(TREES * leaves, max(1, int(np.ceil(share * leaves))))
        key = self.priorities(queries)
        best = np.argpartition(-key, take - 1, axis=1)[:, :take] if take < key.shape[1] else np.tile(np.arange(key.shape[1]), (len(queries), 1))
        for chosen in best:
            met = np.zeros(self.order.shape[1], bool)
            for leaf in chosen.tolist():
                t, k = leaf >> self.depth, leaf & (leaves - 1)
                met[self.order[t, self.ends[t, k]:self.ends[t, k + 1]]] = True
            yield np.flatnonzero(met)


def _packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def build_index(vectors: DataFrame, vec_id: str, vector: str, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(dim, block, index): for each block its distinct vectors, their least ids and the forest over them."""
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v")))
    blocks = 1 + (rows.count() - 1) // block_rows if block_rows else 1
    rows = rows.select("id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(max(blocks, 1))).cast("int").alias("block"))

    def build(group: pa.Table) -> pa.Table:
        dim, block = group.column("dim")[0].as_py(), group.column("block")[0].as_py()
        ids = group.column("id").to_numpy()
        x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in group.column("v").chunks]).reshape(-1, dim) + 0.0
        order = np.argsort(ids, kind="stable")
        distinct, of = np.unique(x[order], axis=0, return_inverse=True)
        by = np.argsort(of, kind="stable")
        ids, of = ids[order][by], of[by]
        new = np.concatenate(([True], (of[1:] != of[:-1]) | (ids[1:] != ids[:-1])))
        ids, of = ids[new], of[new]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        ids, of = ids[place <= k], of[place <= k]
        forest = Forest(distinct, [dim, block])
        blob = _packed(vectors=distinct, ids=ids, starts=np.searchsorted(of, np.arange(len(distinct) + 1)), **vars(forest))
        return pa.table([group.column("dim")[:1], group.column("block")[:1], pa.array([blob], pa.binary())], names=["dim", "block", "index"])

    return stage(rows.groupBy("dim", "block").applyInArrow(build, "dim int, block int, index binary"), "ann-index")


def search(
    index: DataFrame, queries: DataFrame, vec_id: str, vector: str, k: int, share: float = LEAF_SHARE, chunk_queries: int = CHUNK_QUERIES
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best found for each query, its own id left out, ties to the smaller id."""
    asked = queries.select(F.col(vec_id).cast("bigint").alias("query_id"), F.col(vector).cast("array<double>").alias("v"))
    asked = asked.where(F.col("query_id").isNotNull() & usable(F.col("v"))).distinct().withColumn("dim", F.size("v"))
    chunks = 1 + (asked.count() - 1) // chunk_queries
    asked = stage(asked.withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(max(chunks, 1))).cast("int")), "ann-queries")
    every = F.explode(F.sequence(F.lit(0), F.lit(max(chunks, 1) - 1)))
    left = index.withColumn("chunk", every)
    met = index.select(F.col("dim").alias("q_dim"), F.col("block").alias("q_block")).distinct()
    right = asked.join(met, F.col("dim") == F.col("q_dim"))  # a chunk of queries goes to each block
    right = right.select("q_dim", "q_block", F.col("chunk").alias("q_chunk"), "query_id", "v")

    def best(block: pa.Table, asking: pa.Table) -> pa.Table:
        names = ("query_id", "vec_id", "score")
        if not block.num_rows or not asking.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        held = np.load(io.BytesIO(block.column("index")[0].as_py()))
        x, ids, starts = held["vectors"], held["ids"], held["starts"]
        forest = Forest.__new__(Forest)
        forest.depth, forest.normals, forest.cuts, forest.order, forest.ends = (held[a] for a in ("depth", "normals", "cuts", "order", "ends"))
        forest.depth = int(forest.depth)
        q = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in asking.column("v").chunks]).reshape(-1, x.shape[1])
        own = asking.column("query_id").to_numpy()
        out = []
        for a in range(0, len(q), 256):
            for i, met in enumerate(forest.candidates(q[a:a + 256], share), a):
                near = x[met] @ q[i]
                if len(near) > k + 1:
                    least = np.partition(near, len(near) - k - 1)[len(near) - k - 1]
                    met = met[near >= least - 1e-9 * max(1.0, abs(least))]
                exact = (x[met] * q[i]).sum(1)  # the same order of additions for each row: equal vectors tie
                many = starts[met + 1] - starts[met]
                found = np.concatenate([ids[s:e] for s, e in zip(starts[met], starts[met + 1])])
                score = np.repeat(exact, many)
                score, found = score[found != own[i]], found[found != own[i]]
                top = np.lexsort((found, -score))[:k]
                out.append((np.full(len(top), own[i]), found[top], score[top]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], names=names)

    pairs = left.groupBy("dim", "block", "chunk").cogroup(right.groupBy("q_dim", "q_block", "q_chunk"))
    found = pairs.applyInArrow(best, "query_id bigint, vec_id bigint, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 20) -> DataFrame:
    return search(build_index(vectors, vec_id, vector, k), queries, vec_id, vector, k)


@register("op5_nearest_neighbours")
def op5(spark, sf_dir):
    """The 20 nearest of every row whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))
