"""Many k-means runs side by side: k-means++ starts, Lloyd rounds, labels.

The rows lie in one written table as vectors.  Every pass is one Spark job for all runs
that still move: a task assigns its rows for each run by NumPy and hands on one row a run and
cluster (count, sums), so the driver sees runs times clusters rows, never data.

A run may be limited to the members of a cluster of an earlier labelling, so that the
clusters of all labellings are split in the same passes.

An empty cluster keeps its centre, and the run says how many it has.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import _held

CELLS = 1 << 22  # distances that a task holds at once


@dataclass
class Run:
    """``member``: (place in the row's codes, cluster) that limits the run, or None for all rows."""

    k: int
    seed: int
    member: tuple[int, int] | None = None
    start: np.ndarray | None = None
    centres: np.ndarray | None = None
    rounds: int = 0
    converged: bool = False
    n: np.ndarray | None = None
    inertia: float = float("nan")
    empty: int = 0
    path: list = field(default_factory=list)


def points(df: DataFrame, ids: str, features: list[str], *keep: str) -> DataFrame:
    """``id, h, x, keep..`` as a written table, spread over all tasks, as few rows are much work; rows with a missing or non-finite feature are refused."""
    fine = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")) for c in features]
    checked = F.when(sum((~f).cast("int") for f in fine) > 0, F.raise_error(F.concat(F.lit("missing or non-finite feature in row "), F.col(ids).cast("string"))).cast("array<double>")).otherwise(F.array(*[F.col(c).cast("double") for c in features]))
    return _held(df.select(F.col(ids).alias("id"), F.xxhash64(ids).alias("h"), checked.alias("x"), *keep).repartition("h"))


def uniform(h: np.ndarray, seed: int, step: int) -> np.ndarray:
    """A number in (0, 1) a row, from its hash, the seed and the step: the same wherever the row lies."""
    with np.errstate(over="ignore"):
        z = h.astype(np.uint64) + np.uint64((seed * 1_000_003 + step + 1) % 2**64) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        z ^= z >> np.uint64(31)
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), len(centres)))
    for j in range(x.shape[1]):
        gap = x[:, j, None] - centres[None, :, j]
        out += gap * gap
    return out


def _chunks(batches, codes: str | None, width: int):
    """(vectors, hashes, codes) of a batch, in pieces whose distances fit."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        h = batch.column("h").to_numpy()
        c = batch.column(codes).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if codes else None
        step = max(1, CELLS // max(1, width))
        for a in range(0, len(x), step):
            yield x[a : a + step], h[a : a + step], None if c is None else c[a : a + step]


def _own(member, x, c):
    return np.arange(len(x)) if member is None else np.flatnonzero(c[:, member[0]] == member[1])


def plus_plus(table: DataFrame, runs: list[Run], codes: str | None = None) -> None:
    """Starting centres of all runs, one pass a centre: a row is drawn with probability in proportion to its squared distance to those before.

    The draw is a race: the least of -ln(u) / weight wins, so that it needs no total and no order of rows.
    If no row is away from the centres, the rest repeat the last one.
    """
    for step in range(max(r.k for r in runs)):
        some = [(i, r) for i, r in enumerate(runs) if step < r.k]
        chosen = {i: np.array(r.path) for i, r in some}

        def run(batches, some=[(i, r.seed, r.member) for i, r in some], chosen=chosen, step=step):
            best: dict[int, tuple] = {}
            for x, h, c in _chunks(batches, codes, 1 + step):
                for i, seed, member in some:
                    own = _own(member, x, c)
                    if not len(own):
                        continue
                    with np.errstate(divide="ignore"):
                        key = -np.log(uniform(h[own], seed, step)) / (squares(x[own], chosen[i]).min(1) if step else 1.0)
                    at = int(np.lexsort((h[own], key))[0]) if len(key) else 0
                    found = (float(key[at]), int(h[own[at]]), x[own[at]].tolist())
                    if np.isfinite(found[0]) and (i not in best or found < best[i]):
                        best[i] = found
            k = list(best)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array([best[i][0] for i in k], pa.float64()), pa.array([best[i][1] for i in k], pa.int64()), pa.array([best[i][2] for i in k], pa.list_(pa.float64()))], names=["run", "key", "h", "x"])

        won = table.mapInArrow(run, "run int, key double, h long, x array<double>").groupBy("run").agg(F.min(F.struct("key", "h", "x")).alias("b"))
        won = {r["run"]: r["b"]["x"] for r in won.collect()}  # a row a run
        for i, r in some:
            if i in won:
                r.path.append(won[i])
            elif r.path:
                r.path.append(r.path[-1])
    for r in runs:
        r.start, r.path = np.array(r.path), []


def spread(table: DataFrame, dim: int) -> float:
    """Mean population variance of the components."""
    v = table.agg(*[F.var_pop(F.get("x", F.lit(j))) for j in range(dim)]).head()
    return sum(x or 0.0 for x in v) / dim


def lloyd(table: DataFrame, runs: list[Run], rounds: int = 300, tol: float = 1e-4, codes: str | None = None) -> None:
    """Rounds for all runs that still move, then one pass for sizes and inertia under the final centres.

    A run stands still once its centres move by at most ``tol`` of the mean variance (squared, in all).
    """
    runs = [r for r in runs if r.start is not None and len(r.start)]
    if not runs:
        return
    limit = tol * spread(table, runs[0].start.shape[1])
    for r in runs:
        r.centres = r.start.astype(float)

    def totals(some: list[Run]) -> dict:
        spec = [(i, r.member, r.centres) for i, r in enumerate(some)]
        width = max(len(c) for _, _, c in spec)

        def run(batches):
            n = {i: np.zeros(len(c)) for i, _, c in spec}
            s = {i: np.zeros(c.shape) for i, _, c in spec}
            d = {i: np.zeros(len(c)) for i, _, c in spec}
            for x, _, c in _chunks(batches, codes, width):
                for i, member, centres in spec:
                    own = _own(member, x, c)
                    if not len(own):
                        continue
                    d2 = squares(x[own], centres)
                    label = d2.argmin(1)
                    n[i] += np.bincount(label, minlength=len(centres))
                    d[i] += np.bincount(label, weights=d2[np.arange(len(own)), label], minlength=len(centres))
                    for j in range(x.shape[1]):
                        s[i][:, j] += np.bincount(label, weights=x[own, j], minlength=len(centres))
            rows = [(i, e) for i in n for e in np.flatnonzero(n[i]).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([e for _, e in rows], pa.int32()), pa.array([n[i][e] for i, e in rows], pa.float64()), pa.array([d[i][e] for i, e in rows], pa.float64()), pa.array([s[i][e].tolist() for i, e in rows], pa.list_(pa.float64()))], names=["run", "label", "n", "d", "s"])

        dim = some[0].centres.shape[1]
        sums = table.mapInArrow(run, "run int, label int, n double, d double, s array<double>").groupBy("run", "label").agg(F.sum("n"), F.sum("d"), *[F.sum(F.get("s", F.lit(j))) for j in range(dim)])
        return {(r[0], r[1]): (r[2], r[3], np.array(r[4:])) for r in sums.collect()}

    moving = list(runs)
    for _ in range(rounds):
        if not moving:
            break
        got = totals(moving)
        for i, r in enumerate(moving):
            new = np.array([got[i, e][2] / got[i, e][0] if (i, e) in got else r.centres[e] for e in range(len(r.centres))])
            r.converged, r.rounds = float(((new - r.centres) ** 2).sum()) <= limit, r.rounds + 1
            r.centres = new
        moving = [r for r in moving if not r.converged]
    for r in runs:  # in order of the first component, as labels are given
        r.centres = r.centres[np.lexsort(r.centres.T[::-1])]
    got = totals(runs)
    for i, r in enumerate(runs):
        r.n = np.array([got[i, e][0] if (i, e) in got else 0.0 for e in range(len(r.centres))])
        r.inertia, r.empty = float(sum(got[i, e][1] for e in range(len(r.centres)) if (i, e) in got)), int((r.n == 0).sum())


def best(runs: list[Run], digits: int = 9) -> Run:
    """The run of least inertia, ties to the smaller seed."""
    return min(runs, key=lambda r: (round(r.inertia, digits), r.seed))


def labelled(table: DataFrame, chosen: list[Run]) -> DataFrame:
    """``id, h, x, codes``: the cluster, from 0, in every chosen run; written once."""
    centres = [r.centres for r in chosen]
    kind = table.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            codes = np.stack([squares(x, c).argmin(1) for c in centres], 1).astype(np.int32)
            lists = pa.ListArray.from_arrays(np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32), pa.array(codes.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), batch.column("x"), lists], names=["id", "h", "x", "codes"])

    return _held(table.select("id", "h", "x").mapInArrow(run, f"id {kind}, h long, x array<double>, codes array<int>"))


def starts(df: DataFrame, ids: str, features: list[str], k: int, n: int = 50, seed: int = 0, rounds: int = 300, tol: float = 1e-4) -> list[Run]:
    """``n`` runs from k-means++ starts, all side by side; ``best`` picks one."""
    table, runs = points(df, ids, features), [Run(k, seed + i) for i in range(n)]
    plus_plus(table, runs)
    lloyd(table, runs, rounds, tol)
    return runs


def run_table(spark, runs: list[Run]) -> DataFrame:
    """A row a run: seed, k, inertia, rounds, whether it stood still, empty clusters, sizes, and whether it is the best of its k."""
    top = {id(best([r for r in runs if r.k == k])) for k in {r.k for r in runs}}
    rows = [(r.seed, r.k, round(r.inertia, 6), r.rounds, r.converged, r.empty, ",".join(str(int(x)) for x in sorted(r.n)), id(r) in top) for r in runs]
    return spark.createDataFrame(rows, "seed int, k int, inertia double, rounds int, converged boolean, n_empty int, sizes string, best boolean")
