"""Approximate nearest neighbours by a hash-prefix forest.

Each tree of the forest gives every vector a long string of bits, the sides of random hyperplanes it lies on, and
keeps the strings sorted. A query descends each tree to the longest prefix it shares with any string there, then
ascends all trees together, one bit at a time, until the ranges of strings that share the prefix hold enough
candidates; these are measured exactly, in double precision.

Vectors are dealt to shards of bounded size and queries to blocks of bounded size. A task takes one shard and one block, builds
the shard's forest around the shard's median, and returns the nearest few of each query, so what is merged is small. How many
strings a query gathers from a shard is a fixed number, and so is a full shard's size; recall against brute force is measured with these (README). Equal
vectors are one entry that carries its smallest ids, as many as a query can return and one more, so a vector that a third of the
rows hold costs no more than another and ties come out exactly.

Null, zero and non-finite vectors, and vectors of another dimension than the most common one's, take no part. Rows
repeated with one id and vector count once; an id with several vectors counts once for each. With fewer candidates than asked for, all are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, Window

from verdigris.storage import materialise

#: Trees, bits of a string, strings to gather over all trees, distinct vectors of a shard at most (about), queries of a block.
TREES, BITS, WANTED, SHARD, BLOCK = 24, 48, 6_500, 8_192, 4_096


class PrefixForest:
    """Sorted hash strings over one shard."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = 3):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.vectors = vectors
        self.planes = rng.normal(size=(trees, bits, vectors.shape[1]))
        self.centre = np.median(vectors, axis=0)
        self.bits = bits
        codes = self._codes(vectors)
        self.order = np.argsort(codes, axis=1, kind="stable")
        self.sorted = np.take_along_axis(codes, self.order, axis=1)

    def _codes(self, x: np.ndarray) -> np.ndarray:
        weights = np.uint64(1) << np.arange(self.bits - 1, -1, -1, dtype=np.uint64)
        return np.stack([((x - self.centre) @ p.T > 0) @ weights for p in self.planes])

    def candidates(self, queries: np.ndarray, wanted: int) -> Iterator[np.ndarray]:
        """Positions of each query's candidates: the trees ascend together until their ranges hold ``wanted`` strings, counting one for each tree that holds it."""
        codes = self._codes(queries)
        trees, n = self.sorted.shape
        low, high = np.zeros((self.bits + 1, trees, len(queries)), np.int64), np.zeros((self.bits + 1, trees, len(queries)), np.int64)
        for depth in range(self.bits + 1):
            gap = np.uint64(self.bits - depth)
            first = (codes >> gap) << gap
            last = first | ((np.uint64(1) << gap) - np.uint64(1))
            for t in range(trees):
                low[depth, t] = np.searchsorted(self.sorted[t], first[t], side="left")
                high[depth, t] = np.searchsorted(self.sorted[t], last[t], side="right")
        held = (high - low).sum(axis=1)
        # the deepest level at which enough strings share the prefix
        level = self.bits - np.argmax((held >= min(wanted, trees * n))[::-1], axis=0)
        for q in range(len(queries)):
            d = level[q]
            yield np.unique(np.concatenate([self.order[t, low[d, t, q] : high[d, t, q]] for t in range(trees)]))

    def nearest(self, queries: np.ndarray, k: int, wanted: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions, distances) of at least the k nearest candidates of each query; all that tie with the k-th."""
        for at in range(0, len(queries), 256):
            part = queries[at : at + 256]
            for q, own in zip(part, self.candidates(part, wanted)):
                d = np.sqrt(((self.vectors[own] - q) ** 2).sum(axis=1))
                if len(d) > k:
                    near = d <= np.partition(d, k - 1)[k - 1]
                    own, d = own[near], d[near]
                yield own, d


def usable(df: DataFrame, id: str, vector: str) -> DataFrame:
    """(vec_id, v): rows with an id and a finite, non-zero vector."""
    v = F.col(vector).cast("array<double>")
    rows = df.select(F.col(id).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))


def common_dimension(rows: DataFrame) -> int:
    """The dimension that most vectors have; of equally frequent ones the smaller, 0 of none."""
    size = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    return size["n"] if size else 0


def search(df: DataFrame, queries: DataFrame, k: int = 10, id: str = "vec_id", vector: str = "embedding", wanted: int = WANTED, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``queries`` its k nearest of the rows of ``df`` but itself. Both sides take part with the
    dimension that most rows of ``df`` have."""
    rows = usable(df, id, vector)
    size = common_dimension(rows)
    # the k + 1 smallest ids of each distinct vector; the limit is applied before and after the exchange
    own = rows.where(F.size("v") == size).withColumn("__n", F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))).where(f"__n <= {k + 1}")
    entries = materialise(own.groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")), "ann-entries")
    asked = materialise(usable(queries, id, vector).where(F.size("v") == size).select(F.col("vec_id").alias("query_id"), "v").distinct(), "ann-queries")
    shards, blocks = max(1, -(-entries.count() // shard)), max(1, -(-asked.count() // block))
    # a stated set of queries against all rows: every shard meets every block once, in a task of its own
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    of = F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int")
    held = entries.select(of.alias("shard"), numbers(blocks).alias("block"), F.lit(0).alias("asks"), F.lit(0).cast("long").alias("query_id"), "ids", "v")
    met = asked.select(numbers(shards).alias("shard"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(1).alias("asks"), "query_id", F.lit(None).cast("array<bigint>").alias("ids"), "v")
    task = (F.col("shard") * blocks + F.col("block")).cast("int")
    dealt = held.unionByName(met).repartitionById(shards * blocks, task).sortWithinPartitions("shard", "block", "asks")
    found = dealt.mapInPandas(_searcher(k, wanted), "query_id long, vec_id long, score double")
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(f"rank <= {k}")
    return best.select("query_id", "rank", "vec_id", "score")


def _searcher(k: int, wanted: int):
    def nearest(ids: list, vectors: list, asked: list, points: list) -> pd.DataFrame:
        rows = []
        if ids and asked:
            forest = PrefixForest(np.array(vectors, dtype=np.float64))
            for q, (own, d) in zip(asked, forest.nearest(np.array(points, dtype=np.float64), k + 1, wanted)):
                rows += [(q, v, s) for s, v in sorted((float(s), v) for p, s in zip(own.tolist(), d) for v in ids[p] if v != q)[:k]]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, ids, vectors, asked, points = None, [], [], [], []
        for batch in batches:
            for s, b, asks, q, own, v in zip(batch.shard.array, batch.block.array, batch.asks.array, batch.query_id.array, batch.ids.array, batch.v.array):
                if (s, b) != now:
                    yield nearest(ids, vectors, asked, points)
                    now, ids, vectors, asked, points = (s, b), [], [], [], []
                if asks:
                    asked.append(int(q))
                    points.append(v)
                else:
                    ids.append(own.tolist())
                    vectors.append(v)
        yield nearest(ids, vectors, asked, points)

    return run
