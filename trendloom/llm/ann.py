"""Nearest neighbours by collision counting over single projections.

Inner product becomes Euclidean distance by one more coordinate that brings all
vectors to one length.  Rows fall by hash into blocks; a block keeps one sorted array
of row numbers per random projection.  A query finds its place in every array and opens windows
centred there; a row collides in a projection when its place lies inside, and only rows inside are touched.
Windows widen at both ends (virtual rehashing), counting what is new there, until enough rows of the block
collide at least ``votes`` times, and those are verified exactly.  Every row is indexed, every query meets every block of
its dimension, and queries travel by shuffle, so that no table passes through the driver.

The windows cover a share of each block, so work is queries times rows: neighbours in
data without structure need that for the recall asked.

Defined cases: vectors that are null, zero, or that hold nulls or non-finite values take no part; an inner product
needs one dimension, so a query's candidates are the rows of its own dimension; ties go to the smaller
vec_id; fewer candidates than k give fewer rows; repeated rows are candidates each, and one query;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, matrix, runs

SCHEMA = "query_id long, vec_id long, score double"


def projections(dim: int, m: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim + 1, m))


class Block:
    """Sorted arrays of one block and the search in them."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, proj: np.ndarray, top: float):
        self.ids, self.x, self.proj, self.top = ids, x, proj, top
        grown = np.c_[x, np.sqrt(np.maximum(top * top - (x * x).sum(1), 0))] @ proj
        order = np.argsort(grown, axis=0, kind="stable")
        self.sorted = np.take_along_axis(grown, order, 0).T.copy()
        self.order = order.T.copy()  # row numbers in the order of every array
        self.room, self.seen = np.empty(self.order.size, self.order.dtype), np.empty_like(x)  # held, not allocated for every query
        self.verified = self.touched = 0

    def collide(self, mids: np.ndarray, votes: int, enough: int, width: int) -> np.ndarray:
        """Rows with at least ``votes`` collisions, in the first windows that hold enough of them."""
        n = len(self.ids)
        hits, low, high = np.zeros(n, np.int64), mids, mids
        while True:
            left = np.clip(mids - width // 2, 0, n - width)
            right = left + width
            pieces = [a[i:j] for ends in ((left, low), (high, right)) for a, i, j in zip(self.order, *(e.tolist() for e in ends)) if i < j]
            new = np.concatenate(pieces, out=self.room[:sum(map(len, pieces))])
            hits += np.bincount(new, minlength=n)
            self.touched += len(new)
            low, high = left, right
            found = np.flatnonzero(hits >= votes)
            if len(found) >= enough or width >= n:
                return found
            width = min(n, width * 17 // 16 + 1)

    def search(self, qids: np.ndarray, q: np.ndarray, k: int, votes: int, share: float, start: float):
        n = len(self.ids)
        enough = min(n, max(12 * k, int(share * n)))
        asked = np.c_[q / np.linalg.norm(q, axis=1, keepdims=True) * self.top, np.zeros(len(q))] @ self.proj
        mids = np.stack([np.searchsorted(s, asked[:, j]) for j, s in enumerate(self.sorted)])
        for i in range(len(q)):
            found = self.collide(mids[:, i], votes, enough, max(1, min(n, int(start * n))))
            self.verified += len(found)
            found = found[self.ids[found] != qids[i]]
            score = np.einsum("ij,j->i", np.take(self.x, found, 0, self.seen[:len(found)], "clip"), q[i])
            if len(found) > 4 * k:
                edge = np.partition(score, len(score) - k)[len(score) - k]
                found, score = found[score >= edge], score[score >= edge]
            best = np.lexsort((self.ids[found], -score))[:k]
            yield qids[i], self.ids[found[best]], score[best]


def usable(vectors: DataFrame) -> DataFrame:
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter("vec_id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.filter(fine).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).filter("norm > 0")


def search(vectors: DataFrame, every: int = 20, k: int = 20, m: int = 160, votes: int = 44, share: float = 0.22, start: float = 0.24, block: int = 8192, queries: int = 1024, tasks: int = 64, seed: int = 3, max_broadcast: int = 100000) -> DataFrame:
    """``query_id, rank, vec_id, score``; queries are rows whose vec_id is divisible by ``every``.

    ``votes`` of ``m`` collisions, windows of ``start`` of a block at first, until ``share`` of it collides.
    The queries of a block are split among tasks only while there are fewer blocks than ``tasks``, so that
    the copies of vectors this makes stay within ``tasks`` blocks at any size.
    """
    v = usable(vectors).withColumn("dim", F.size("v"))
    is_query = F.pmod("vec_id", F.lit(every)) == 0
    blocks = F.ceil(F.count(F.lit(1)) / block)
    splits = F.greatest(F.lit(1), F.least(F.ceil(F.count_if(is_query) / queries), F.ceil(F.lit(tasks) / blocks)))
    # A row a dimension.
    sizes = checkpointed(v.groupBy("dim").agg(F.max("norm").alias("top"), blocks.cast("int").alias("blocks"), splits.cast("int").alias("splits")))
    v = v.join(F.broadcast(sizes) if sizes.count() <= max_broadcast else sizes, "dim")
    number = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    # Blocks are cut by a hash of the whole row, so that one id held by many rows spreads too.
    rows = v.select("dim", F.pmod(F.xxhash64("vec_id", "v"), "blocks").cast("int").alias("block"), number("splits").alias("split"), F.lit(0).alias("kind"), "top", "vec_id", "v")
    asks = v.filter(is_query).dropDuplicates(["dim", "vec_id"]).select("dim", number("blocks").alias("block"), F.pmod(F.xxhash64("vec_id"), "splits").cast("int").alias("split"), F.lit(1).alias("kind"), "top", "vec_id", "v")
    cells = rows.union(asks).repartition("dim", "block", "split").sortWithinPartitions("dim", "block", "split", "kind")

    def run(batches):
        own, held, index = None, [], None
        for (dim, *place, kind), some in runs(batches, "dim", "block", "split", "kind"):
            ids, x = some.column("vec_id").to_numpy(), matrix(some, "v", int(dim))
            if kind == 0:
                if own != [dim, *place]:
                    own, held, index = [dim, *place], [], None
                held.append((ids, x))
            elif own == [dim, *place]:  # else a block without rows
                index = index or Block(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), projections(int(dim), m, seed), some.column("top")[0].as_py())
                found = list(index.search(ids, x, k, votes, share, start))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64)), pa.array(np.concatenate([f[1] for f in found])), pa.array(np.concatenate([f[2] for f in found]))], names=["query_id", "vec_id", "score"])

    found = cells.mapInArrow(run, SCHEMA)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
