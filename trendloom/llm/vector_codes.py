"""Vector codes: integer codebooks of four part positions, nearest entries found by a GNAT.

Each round is one Spark job: tasks assign the parts of their rows and hand on one
row an entry (count and sums), so at most 1,024 rows a task are shuffled and 1,024
in all reach the driver, which floors the means.  The codebooks travel back inside the
task's closure: 1,024 entries, whatever the number of rows.

The tree (geometric near-neighbour access tree) over the 256 entries of a part holds split
points, picked one after the other farthest from those before; every other entry hangs
under its nearest split point.  A node keeps, for each split point and each child, the
least and largest distance from the one to the entries of the other.  A query measures its
split points, and leaves a child out when some split point's range lies more than the best
distance so far away.  Ranges and distances are widened before they are compared, and only
a strictly greater bound leaves out, so no tie is lost; what is compared in the end are whole
squared distances, ties to the lower index.

Defined cases: vectors that are null or hold null or non-finite components go; shorter vectors count
as having zeros behind, up to the longest length, rounded up to a multiple of four; components beyond
2^24 in size are held there; fewer than 256 rows give fewer entries; rows of one
vec_id begin the codebooks in order of their vectors; a null vec_id comes after all others;
repeated rows are coded each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, integer_vectors, matrix, padded

PARTS = 4
SLACK = 1e-9  # far above the rounding of a square root, far below what costs pruning


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all of b, as whole numbers: by matrix product where doubles hold them exactly."""
    top = float(max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)))
    if 4 * top * top * a.shape[1] < 2**53:
        x, y = a.astype(np.float64), b.astype(np.float64)
        return ((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * (x @ y.T)).astype(np.int64)
    out = np.zeros((len(a), len(b)), np.int64)
    for j in range(a.shape[1]):
        out += (a[:, j, None].astype(np.int64) - b[None, :, j]) ** 2
    return out


class Gnat:
    """Tree over the rows of ``points``; ``measured`` counts the distances that queries took."""

    def __init__(self, points: np.ndarray, degree: int = 16, leaf: int = 8):
        self.points, self.degree, self.leaf, self.measured = points.astype(np.int64), degree, leaf, 0
        self.root = self._node(np.arange(len(points)))

    def _node(self, own: np.ndarray) -> dict:
        if len(own) <= self.leaf:
            return {"leaf": own}
        chosen, near = [0], squared(self.points[own], self.points[own[:1]])[:, 0]
        while len(chosen) < self.degree and near.max() > 0:
            chosen.append(int(near.argmax()))
            near = np.minimum(near, squared(self.points[own], self.points[own[chosen[-1:]]])[:, 0])
        if len(chosen) == 1:  # equal points alone
            return {"leaf": own}
        splits = np.sort(own[chosen])
        rest = np.setdiff1d(own, splits)
        d2 = squared(self.points[splits], self.points[rest])
        d, home = np.sqrt(d2), d2.argmin(0)
        low, high = np.full((len(splits),) * 2, np.inf), np.zeros((len(splits),) * 2)
        children = {}
        for j in range(len(splits)):
            under = home == j
            if under.any():
                low[:, j], high[:, j] = d[:, under].min(1) * (1 - SLACK), d[:, under].max(1) * (1 + SLACK)
                children[j] = self._node(rest[under])
        return {"splits": splits, "low": low, "high": high, "children": children}

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest point of every row (ties to the lower index) and the squared distance."""
        q = q.astype(np.int64)
        best, index = np.full(len(q), np.iinfo(np.int64).max), np.full(len(q), len(self.points))
        self._visit(self.root, np.arange(len(q)), q, best, index)
        return index, best

    def _measure(self, own, rows, q, best, index) -> np.ndarray:
        d2 = squared(q[rows], self.points[own])
        self.measured += d2.size
        at = d2.argmin(1)  # own ascends, so the first least is the lowest index
        found, which = d2[np.arange(len(rows)), at], own[at]
        better = (found < best[rows]) | ((found == best[rows]) & (which < index[rows]))
        best[rows[better]], index[rows[better]] = found[better], which[better]
        return d2

    def _visit(self, node, rows, q, best, index) -> None:
        if "leaf" in node:
            self._measure(node["leaf"], rows, q, best, index)
            return
        d = np.sqrt(self._measure(node["splits"], rows, q, best, index))
        nearest = d.argmin(1)
        for own in (True, False):  # first the child of the nearest split point, which brings the best distance down
            for j, child in node["children"].items():
                here = np.flatnonzero((nearest == j) == own)
                radius = np.sqrt(best[rows[here]]) * (1 + SLACK)
                gap = np.maximum(d[here] * (1 - SLACK) - node["high"][:, j], node["low"][:, j] - d[here] * (1 + SLACK)).max(1, initial=0)
                here = here[gap <= radius]
                if len(here):
                    self._visit(child, rows[here], q, best, index)


def start(v: DataFrame, entries: int) -> np.ndarray:
    """Codebooks (part, entry, position) of the smallest ids: as many rows as a codebook has entries."""
    rows = v.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    x = np.array([r[0] for r in rows], np.int64)
    return x.reshape(len(x), PARTS, -1).transpose(1, 0, 2)


def improve(v: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: every entry becomes the floored mean of its parts; unused ones stay."""
    parts, entries, width = books.shape

    def run(batches):
        trees = [Gnat(b) for b in books]
        n, sums = np.zeros((parts, entries), np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            x = matrix(batch, "v", parts * width).reshape(-1, parts, width)
            for p, tree in enumerate(trees):
                index, _ = tree.nearest(x[:, p])
                n[p] += np.bincount(index, minlength=entries)
                np.add.at(sums[p], index, x[:, p])
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))], names=["part", "entry", "n", "s"])

    mine = v.select("v").mapInArrow(run, "part int, entry int, n long, s array<long>")
    out = books.copy()
    for r in mine.groupBy("part", "entry").agg(F.sum("n"), *[F.sum(F.get("s", F.lit(j))) for j in range(width)]).collect():  # a row an entry
        out[r[0], r[1]] = [s // r[2] for s in r[3:]]
    return out


def codebooks(v: DataFrame, entries: int = 256, rounds: int = 4) -> np.ndarray:
    books = start(v, entries)
    for _ in range(rounds):
        books = improve(v, books)
    return books


def coded(v: DataFrame, books: np.ndarray, *keep: str) -> DataFrame:
    """``vec_id, keep.., code, error`` of every row."""
    parts, entries, width = books.shape
    names = ["vec_id", *keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in v.select(*names).schema) + ", code string, error long"

    def run(batches):
        trees = [Gnat(b) for b in books]
        for batch in batches:
            x = matrix(batch, "v", parts * width).reshape(-1, parts, width)
            found = [tree.nearest(x[:, p]) for p, tree in enumerate(trees)]
            codes = np.stack([f[0] for f in found], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(sum(f[1] for f in found), pa.int64())], names=[*names, "code", "error"])

    return v.select(*names, "v").mapInArrow(run, schema)


def print_of(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, label: str = "label", scale: int = 1024, entries: int = 256, rounds: int = 4, salts: int = 16) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256``; the errors of a label meet its rows in ``salts`` shares each."""
    spark, tables = vectors.sparkSession, Tables(vectors.sparkSession)
    if entries > 256:
        raise ValueError("a code digit pair holds 256 entries")
    v = tables.write(integer_vectors(vectors, scale, label).withColumnRenamed(label, "label"), "integers")
    least, most = v.agg(F.min(F.size("v")), F.max(F.size("v"))).head()
    if most is None:
        return spark.createDataFrame([], f"vec_id {v.schema['vec_id'].dataType.simpleString()}, code string, error long, label_error long, codebooks_sha256 string")
    dim = max(PARTS, -(-most // PARTS) * PARTS)
    if least != dim:
        v = padded(v, dim)
    books = codebooks(v, entries, rounds)
    codes = tables.write(coded(v, books, "label").withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(salts)).cast("int")), "codes")
    tables.drop("integers")
    whole = codes.groupBy("label", "_salt").agg(F.sum("error").alias("e")).groupBy("label").agg(F.sum("e").alias("label_error"))
    whole = whole.select(F.col("label").alias("_label"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_s"))
    joined = codes.join(whole, codes["label"].eqNullSafe(whole["_label"]) & (codes["_salt"] == whole["_s"]))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(print_of(books)).alias("codebooks_sha256"))
