"""Exact inner-product search in buckets of like length.

Vectors are grouped by length (quantiles of the squared norm), longest first, and a group that
holds more than a bucket's rows is dealt by hash into several.  Every query first meets one
bucket of the longest vectors; its k-th product there is a bound that any further
result must reach.  Then a query travels to a bucket only if its length times the
bucket's greatest length reaches that bound.  In a bucket, the bound over both lengths is the
local cosine threshold: a row that is near enough must lie, in every coordinate, within
that angle of the query, so the sorted coordinates give ranges of rows (coordinate pruning); or the
rows long enough form the head of the bucket, which is sorted by length (length
pruning).  Whichever leaves clearly fewer rows is taken, and those rows' products
are computed as whole numbers.  Bounds are widened before they are compared, so none is lost by rounding.

A bucket's rows are copied once per ``queries`` queries, a query once per bucket that its bound lets in.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do rows without vec_id;
zero vectors are candidates; shorter vectors count as having zeros behind; components beyond 2^24 in size are held
there; ties go to the smaller vec_id; several rows of one vec_id are one query (the
least vector) and never each other's result; otherwise repeated rows are candidates each; fewer candidates
than k give fewer rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, integer_vectors, matrix, padded, runs

SCHEMA = "query_id long, vec_id long, score long"
SLACK = 1e-9


class Bucket:
    """Rows of one bucket, longest first, and the search in them; ``verified`` counts products."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, focus: int = 3, gain: int = 4):
        norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
        order = np.lexsort((ids, -norm))
        self.ids, self.norm, self.focus, self.gain = ids[order], norm[order], focus, gain
        self.x = x[order].astype(np.int64)
        top = float(np.abs(self.x).max(initial=0))
        self.exact = top * top * x.shape[1] < 2**53  # doubles hold the products exactly
        self.f = self.x.astype(np.float64)
        self.unit = self.f / np.maximum(self.norm, 1e-300)[:, None]
        self.sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.verified = 0
        self.chosen = {"bucket": 0, "length": 0, "coordinate": 0}

    def products(self, q: np.ndarray, rows) -> np.ndarray:
        self.verified += len(q) * len(self.ids[rows])
        if self.exact and float(np.abs(q).max(initial=0)) * float(np.abs(self.x).max(initial=0)) * q.shape[1] < 2**53:
            return (q.astype(np.float64) @ self.f[rows].T).astype(np.int64)
        return q @ self.x[rows].T

    def coordinate(self, j: int) -> tuple[np.ndarray, np.ndarray]:
        if j not in self.sorted:
            order = np.argsort(self.unit[:, j], kind="stable")
            self.sorted[j] = order, self.unit[order, j]
        return self.sorted[j]

    def ranges(self, q: np.ndarray, size: float, cosine: float):
        """Per focus coordinate, from the narrowest: its rows and the interval that a row of that cosine must lie in."""
        u = q / size
        wide = np.arccos(np.clip(cosine - SLACK, -1, 1)) + 1e-7
        out = []
        for j in np.argsort(-np.abs(u), kind="stable")[: self.focus]:
            mid = np.arccos(np.clip(u[j], -1, 1))
            low, high = np.cos(min(np.pi, mid + wide)) - SLACK, np.cos(max(0.0, mid - wide)) + SLACK
            order, values = self.coordinate(int(j))
            a, z = np.searchsorted(values, low, "left"), np.searchsorted(values, high, "right")
            out.append((z - a, int(j), low, high, order[a:z]))
        return sorted(out, key=lambda r: r[:2])

    def best(self, qid: int, rows: np.ndarray, score: np.ndarray, bound: int | None, k: int):
        fine = self.ids[rows] != qid
        if bound is not None:
            fine &= score >= bound
        rows, score = rows[fine], score[fine]
        if len(rows) > k:
            edge = np.partition(score, len(score) - k)[len(score) - k]
            rows, score = rows[score >= edge], score[score >= edge]
        take = np.lexsort((self.ids[rows], -score))[:k]
        return qid, self.ids[rows[take]], score[take]

    def search(self, qids: np.ndarray, q: np.ndarray, bounds: list, k: int):
        """The k best of the bucket for every query, none below its bound."""
        q, n = q.astype(np.int64), len(self.ids)
        sizes, heads = np.sqrt((q.astype(np.float64) ** 2).sum(1)), []
        for i, bound in enumerate(bounds):
            head = n if bound is None else int(np.searchsorted(-self.norm, -((bound * (1 - SLACK) - SLACK) / max(sizes[i] * (1 + SLACK), 1e-300)), "right")) if bound > 0 else n
            if not head:
                self.chosen["bucket"] += 1
                continue
            if bound is not None and bound > 0:
                (count, j, _, _, rows), *others = self.ranges(q[i], sizes[i], bound / (sizes[i] * self.norm[0]))
                if self.gain * count < head:
                    self.chosen["coordinate"] += 1
                    rows = rows[rows < head]
                    for _, other, low, high, _ in others:
                        rows = rows[(self.unit[rows, other] >= low) & (self.unit[rows, other] <= high)]
                    if len(rows):
                        yield self.best(qids[i], rows, self.products(q[i : i + 1], rows)[0], bound, k)
                    continue
            self.chosen["length"] += 1
            heads.append((head, i))
        heads.sort()
        for a in range(0, len(heads), 128):  # queries of like heads share a matrix product
            some = [i for _, i in heads[a : a + 128]]
            rows = slice(0, heads[a : a + 128][-1][0])
            every = np.arange(rows.stop)
            for i, score in zip(some, self.products(q[some], rows)):
                yield self.best(qids[i], every, score, bounds[i], k)


def _search_cells(cells: DataFrame, dim: int, k: int) -> DataFrame:
    """Cells (bucket, share of queries): the rows of the bucket come first, then its queries, batch by batch."""

    def run(batches):
        own, held, bucket = None, [], None
        for (b, s, kind), part in runs(batches, "bucket", "share", "kind"):
            if own != (b, s):
                own, held, bucket = (b, s), [], None
            ids, x = part.column("vec_id").to_numpy(), matrix(part, "v", dim)
            if kind == 0:
                held.append((ids, x))
                continue
            if not held:
                continue  # a bucket without rows
            bucket = bucket or Bucket(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
            found = list(bucket.search(ids, x, part.column("bound").to_pylist(), k))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64)), pa.array(np.concatenate([f[1] for f in found])), pa.array(np.concatenate([f[2] for f in found]))], names=["query_id", "vec_id", "score"])

    return cells.repartition("bucket", "share").sortWithinPartitions("bucket", "share", "kind").mapInArrow(run, SCHEMA)


def search(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, bucket: int = 4096, ranges: int = 64, queries: int = 16384, first: int = 1024) -> DataFrame:
    """``query_id, rank, vec_id, score``; queries are rows whose vec_id is divisible by ``every``."""
    spark, tables = vectors.sparkSession, Tables(vectors.sparkSession)
    is_query = F.pmod("vec_id", F.lit(every)) == 0
    v = integer_vectors(vectors, scale).filter("vec_id is not null").withColumn("vec_id", F.col("vec_id").cast("long"))
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x)
    v = tables.write(v.withColumn("norm", norm).withColumn("h", F.xxhash64("vec_id", "v", F.monotonically_increasing_id())), "rows")
    marks = F.percentile_approx("norm", [i / ranges for i in range(1, ranges)], 10_000)
    n, asked, least, dim, marks = v.agg(F.count(F.lit(1)), F.count_if(is_query), F.min(F.size("v")), F.max(F.size("v")), marks).head()
    if not n or not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if least != dim:
        v = padded(v, dim)
    groups = min(ranges, -(-n // bucket))
    marks = sorted({marks[i * ranges // groups - 1] for i in range(1, groups)})
    group = F.size(F.filter(F.array(*[F.lit(m).cast("long") for m in marks]), lambda m: m >= F.col("norm"))) if marks else F.lit(0)
    v = v.withColumn("group", group)
    sizes = sorted(tuple(r) for r in v.groupBy("group").agg(F.count(F.lit(1)), F.max("norm")).collect())  # at most ``ranges`` rows, longest first
    base, pieces, longest, total = {}, {}, {}, 0
    for g, count, most in sizes:
        base[g], pieces[g], longest[g] = total, -(-count // bucket), float(most) ** 0.5
        total += pieces[g]
    at = lambda table: F.get(F.array(*[F.lit(table.get(g, 0)) for g in range(len(marks) + 1)]), F.col("group"))
    v = v.withColumn("bucket", (at(base) + F.pmod("h", F.greatest(F.lit(1), at(pieces)))).cast("int"))
    shared = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    own_share = lambda count: F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int")
    none = F.lit(None).cast("long")
    rows = lambda some, count: some.select("bucket", shared(count).alias("share"), F.lit(0).alias("kind"), "vec_id", "v", none.alias("bound"))
    asks = v.filter(is_query).groupBy("vec_id").agg(F.min(F.struct("v", "norm")).alias("q")).select("vec_id", "q.v", "q.norm")
    few, many = -(-asked // first), -(-asked // queries)
    one = asks.select(F.lit(0).alias("bucket"), own_share(few).alias("share"), F.lit(1).alias("kind"), "vec_id", "v", none.alias("bound"))
    head = tables.write(_search_cells(rows(v.filter("bucket = 0"), few).union(one), dim, k), "head")
    found = head
    if total > 1:
        bound = head.groupBy(F.col("query_id").alias("vec_id")).agg(F.min("score").alias("bound"), F.count(F.lit(1)).alias("c")).select("vec_id", F.when(F.col("c") == k, F.col("bound")).alias("bound"))
        lists = F.array(*[F.struct(F.lit(longest[g]).alias("size"), F.lit(max(base[g], 1)).alias("low"), F.lit(base[g] + pieces[g] - 1).alias("high")) for g in base if base[g] + pieces[g] > 1])
        reached = F.filter(lists, lambda b: F.col("bound").isNull() | (F.sqrt("norm") * b["size"] * (1 + SLACK) + SLACK >= F.col("bound")))
        sent = asks.join(bound, "vec_id", "left").withColumn("_b", F.explode(reached)).select(F.explode(F.sequence("_b.low", "_b.high")).alias("bucket"), own_share(many).alias("share"), F.lit(1).alias("kind"), "vec_id", "v", "bound")
        found = head.union(_search_cells(rows(v.filter("bucket > 0"), many).union(sent), dim, k))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    out = tables.write(found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "result")
    tables.drop("rows", "head")
    return out
