"""Choosing k: validity indices over k = 2 to 10, votes, tie-break, plausibility.

All k are fitted side by side, and each statistic comes from one pass for all of them: scatter of every
cluster of every k, distances to the means and counts near them, one pass over pairs of
blocks for the pair group, 2-splits of all clusters together.  The rules then work on tables of k
rows.  Every index stands alone: one that fails is a status with its
message, and the others still vote.  Formulas follow the published survey of such indices
(J. Stat. Software 61, 2014); those defined on hierarchical merges use the 2-split of the
cluster that gains most by it.
"""

from __future__ import annotations

import json
import math
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tails import f_quantile
from . import blocks, line, lloyd
from .ranks import average_ranks

# The index names; the last two are graphical and never vote.
INDICES = ["kl", "ch", "hartigan", "ccc", "scott", "marriot", "trcovw", "tracew", "friedman", "rubin", "ratkowsky", "ball", "db", "sdindex", "sdbw", "duda", "pseudot2", "beale",
           "silhouette", "dunn", "cindex", "mcclain", "ptbiserial", "frey", "dindex", "hubert"]
GRAPHICAL = ["dindex", "hubert"]


def _x(batch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _codes(batch) -> np.ndarray:
    return batch.column("codes").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def scatter(rows: DataFrame, centres: list[np.ndarray]) -> list[list[tuple]]:
    """Per labelling and cluster: count, mean and scatter matrix about the mean, from one pass.

    Sums are taken about the fitted centre, so that nothing cancels.
    """
    p = centres[0].shape[1]
    upper = np.triu_indices(p)

    def run(batches):
        n = [np.zeros(len(c)) for c in centres]
        s = [np.zeros(c.shape) for c in centres]
        w = [np.zeros((len(c), p, p)) for c in centres]
        for batch in batches:
            if not batch.num_rows:
                continue
            x, codes = _x(batch), _codes(batch)
            for i, c in enumerate(centres):
                gap = x - c[codes[:, i]]
                for e in range(len(c)):
                    own = gap[codes[:, i] == e]
                    n[i][e] += len(own)
                    s[i][e] += own.sum(0)
                    w[i][e] += own.T @ own
        keys = [(i, e) for i, c in enumerate(centres) for e in range(len(c)) if n[i][e]]
        sums = [np.r_[n[i][e], s[i][e], w[i][e][upper]].tolist() for i, e in keys]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in keys], pa.int32()), pa.array([e for _, e in keys], pa.int32()), pa.array(sums, pa.list_(pa.float64()))], names=["i", "e", "t"])

    one = rows.select("x", "codes").mapInArrow(run, "i int, e int, t array<double>")
    got: dict[tuple, np.ndarray] = {}
    for i, e, at, v in one.select("i", "e", F.posexplode("t").alias("at", "v")).groupBy("i", "e", "at").agg(F.sum("v")).collect():  # as many rows as sums
        got.setdefault((i, e), np.zeros(1 + p + len(upper[0])))[at] = v
    out = []
    for i, c in enumerate(centres):
        own = []
        for e in range(len(c)):
            if (i, e) not in got:
                own.append((0, c[e], np.zeros((p, p))))
                continue
            t = got[i, e]
            n, shift, w = t[0], t[1 : p + 1] / t[0], np.zeros((p, p))
            w[upper] = t[p + 1 :]
            w = w + np.triu(w, 1).T - n * np.outer(shift, shift)
            own.append((int(n), c[e] + shift, w))
        out.append(own)
    return out


def distances_to_means(rows: DataFrame, groups: list[list[tuple]], centres: list[np.ndarray], spots: list[list[np.ndarray]], near: list[float]) -> tuple[list, list, list]:
    """One pass: per labelling, mean distance to the own mean by cluster, mean distance to the own fitted centre, and rows within ``near`` of each spot."""
    means = [np.array([g[1] for g in gs]) for gs in groups]
    width = [len(m) for m in means]

    def run(batches):
        own = [np.zeros(k) for k in width]
        fitted = [0.0 for _ in width]
        inside = [np.zeros(len(s)) for s in spots]
        for batch in batches:
            if not batch.num_rows:
                continue
            x, codes = _x(batch), _codes(batch)
            for i in range(len(width)):
                d = np.sqrt(((x - means[i][codes[:, i]]) ** 2).sum(1))
                own[i] += np.bincount(codes[:, i], weights=d, minlength=width[i])
                fitted[i] += float(np.sqrt(((x - centres[i][codes[:, i]]) ** 2).sum(1)).sum())
                if spots[i]:
                    inside[i] += (lloyd.squares(x, np.array(spots[i])) <= near[i] ** 2).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(width)), pa.int32()), pa.array([np.r_[own[i], fitted[i], inside[i]].tolist() for i in range(len(width))], pa.list_(pa.float64()))], names=["i", "s"])

    one = rows.select("x", "codes").mapInArrow(run, "i int, s array<double>").select("i", F.posexplode("s").alias("at", "v"))
    got = {(r[0], r[1]): r[2] for r in one.groupBy("i", "at").agg(F.sum("v")).collect()}  # a row a cluster or spot
    n = sum(g[0] for g in groups[0])
    own = [[got.get((i, e), 0.0) / max(1, groups[i][e][0]) for e in range(k)] for i, k in enumerate(width)]
    return own, [got.get((i, k), 0.0) / max(1, n) for i, k in enumerate(width)], [[got.get((i, k + 1 + j), 0.0) for j in range(len(spots[i]))] for i, k in enumerate(width)]


def two_splits(rows: DataFrame, ks: list[int], groups: dict[int, list[tuple]], starts: int, seed: int) -> dict[int, tuple]:
    """Per k, of the cluster that gains most by a split in two: its rows, its sum of squares and that of the two parts.

    The clusters of all k are split side by side."""
    wanted = [(i, e) for i, k in enumerate(ks) for e, g in enumerate(groups[k]) if g[0] >= 4 and np.trace(g[2]) > 0]
    runs = {key: [lloyd.Run(2, seed + s, key) for s in range(starts)] for key in wanted}
    every = [r for some in runs.values() for r in some]
    out: dict[int, tuple] = {}
    if every:
        lloyd.plus_plus(rows, every, "codes")
        lloyd.lloyd(rows, every, codes="codes")
    for (i, e), some in runs.items():
        n, one = groups[ks[i]][e][0], float(np.trace(groups[ks[i]][e][2]))
        two = min(r.inertia for r in some)
        if ks[i] not in out or one - two > out[ks[i]][1] - out[ks[i]][2]:
            out[ks[i]] = (n, one, two)
    return out


class Statistics:
    """What the indices are made of: everything that takes a pass over the rows, for all k at once; all pairs of one feature come from running sums."""

    def __init__(self, df: DataFrame, ids: str, features: list[str], ks: list[int], starts: int = 10, seed: int = 0):
        self.ks, self.p = list(ks), len(features)
        self.high = max(ks)
        self.fitted = list(range(1, self.high + 2))
        table = lloyd.points(df, ids, features)
        runs = {k: [lloyd.Run(k, seed + s) for s in range(starts if k > 1 else 1)] for k in self.fitted}
        every = [r for some in runs.values() for r in some]
        lloyd.plus_plus(table, every)
        lloyd.lloyd(table, every)
        self.runs = {k: lloyd.best(some) for k, some in runs.items()}
        self.centres = {k: r.centres for k, r in self.runs.items()}
        self.rows = lloyd.labelled(table, [self.runs[k] for k in self.fitted])
        self.groups = dict(zip(self.fitted, scatter(self.rows, [self.centres[k] for k in self.fitted])))
        self.n = sum(g[0] for g in self.groups[1])
        self.W = {k: sum(g[2] for g in gs) for k, gs in self.groups.items()}
        self.tr = {k: float(np.trace(w)) for k, w in self.W.items()}
        self.det = {k: float(np.linalg.det(w)) for k, w in self.W.items()}
        spots, near = [], []
        for k in self.fitted:
            gs = self.groups[k]
            means = [g[1] for g in gs]
            spots.append([*means, *((means[i] + means[j]) / 2 for i in range(k) for j in range(i))] if k > 1 else [])
            near.append(math.sqrt(sum(np.linalg.norm(np.diag(g[2]) / max(1, g[0])) for g in gs)) / k)
        own, fitted, inside = distances_to_means(self.rows, [self.groups[k] for k in self.fitted], [self.centres[k] for k in self.fitted], spots, near)
        self.own, self.to_centre, self.inside = (dict(zip(self.fitted, v)) for v in (own, fitted, inside))
        self._starts, self._seed = min(3, starts), seed

    # Passes that only some indices need are made when one asks.
    @cached_property
    def _pairs(self) -> tuple[dict, dict]:
        gaps = [np.linalg.norm(c[:, None] - c[None], axis=2) for c in (self.centres[k] for k in self.fitted)]
        whole, stats = (line if self.p == 1 else blocks).label_statistics(self.rows, "id", "x", "codes", gaps)
        return whole, dict(zip(self.fitted, stats))

    @property
    def whole(self) -> dict:
        return self._pairs[0]

    @property
    def pairs(self) -> dict:
        return self._pairs[1]

    @cached_property
    def extremes(self) -> dict:
        counts, n = [self.pairs[k]["nw"] for k in self.fitted], self.whole["n"]
        return dict(zip(self.fitted, line.extreme_sums(self.rows, "x", counts, n) if self.p == 1 else blocks.extreme_sums(self.rows, "id", "x", counts, n)))

    @cached_property
    def silhouette(self) -> dict:
        return dict(zip(self.fitted, blocks.silhouettes(self.rows, "id", "x", "codes", self.fitted)))

    @cached_property
    def splits(self) -> dict:
        return two_splits(self.rows, self.fitted, self.groups, self._starts, self._seed)

    def means(self, k: int) -> np.ndarray:
        return np.array([g[1] for g in self.groups[k]])

    def diff(self, k: int) -> float:
        return (k - 1) ** (2 / self.p) * self.tr[k - 1] - k ** (2 / self.p) * self.tr[k]

    def scat(self, k: int) -> float:
        return float(np.mean([np.linalg.norm(np.diag(g[2]) / g[0]) for g in self.groups[k]]) / np.linalg.norm(np.diag(self.W[1]) / self.n))

    def dis(self, k: int) -> float:
        d = np.linalg.norm(self.means(k)[:, None] - self.means(k)[None], axis=2)
        far = d[~np.eye(k, dtype=bool)]
        return float(far.max() / far.min() * (1 / d.sum(1)).sum())

    def davies_bouldin(self, k: int) -> float:
        d, s = np.linalg.norm(self.means(k)[:, None] - self.means(k)[None], axis=2), np.array(self.own[k])
        return float(np.mean([max((s[i] + s[j]) / d[i, j] for j in range(k) if j != i) for i in range(k)]))

    def ch(self, k: int) -> float:
        return (self.tr[1] - self.tr[k]) / (k - 1) / (self.tr[k] / (self.n - k))

    def density_between(self, k: int) -> float:
        """Rows near the midpoint of two means against those near the denser mean."""
        at, mid, total = self.inside[k][:k], iter(self.inside[k][k:]), 0.0
        for i in range(k):
            for j in range(i):
                total += 2 * next(mid) / max(at[i], at[j], 1)
        return total / (k * (k - 1))

    def mean_within(self, k: int) -> float:
        return self.pairs[k]["sw"] / self.pairs[k]["nw"]

    def mean_between(self, k: int) -> float:
        return (self.whole["s"] - self.pairs[k]["sw"]) / (self.whole["n"] - self.pairs[k]["nw"])

    def split(self, k: int) -> tuple[float, float, float]:
        """Of the best 2-split: ratio of sums, pseudo T2 and Beale's F, each less its critical value."""
        m, one, two = self.splits[k]
        p = self.p
        spread = 1 - 8 / (math.pi**2 * p)
        critical = 1 - 2 / (math.pi * p) - 3.2 * math.sqrt(2 * max(0.0, spread) / (m * p))
        t2 = (one - two) / (two / (m - 2))
        beale = (one / two - 1) / ((m - 1) / (m - 2) * 2 ** (2 / p) - 1)
        return two / one - critical, t2 - (1 - critical) / critical * (m - 2), beale - f_quantile(0.9, p, (m - 2) * p)


def _ccc(w: np.ndarray, n: int, k: int, r2: float) -> float:
    s = np.sqrt(np.linalg.eigvalsh(w / (n - 1))[::-1])
    p, q = len(s), min(len(s), k - 1)
    while q > 1 and s[q - 1] / (np.prod(s[:q]) / k) ** (1 / q) < 1:
        q -= 1
    u = s / (np.prod(s[:q]) / k) ** (1 / q)
    e = 1 - ((1 / (n + u[:q])).sum() + (u[q:] ** 2 / (n + u[q:])).sum()) / (u**2).sum() * (n - k) ** 2 / n * (1 + 4 / n)
    return float(math.log((1 - e) / (1 - r2)) * math.sqrt(n * q / 2) / (0.001 + e) ** 1.2)


def _second(f, k):
    return f(k + 1) - 2 * f(k) + f(k - 1)


def _cindex(s: Statistics, k: int) -> float:
    low, high = s.extremes[k]
    return (s.pairs[k]["sw"] - low) / (high - low)


def _ptbiserial(s: Statistics, k: int) -> float:
    nw, nb = s.pairs[k]["nw"], s.whole["n"] - s.pairs[k]["nw"]
    return (s.mean_between(k) - s.mean_within(k)) * math.sqrt(nw * nb) / s.whole["n"] / s.whole["sd"]


# Value of each index at k.
FORMULAS = {
    "kl": lambda s, k: abs(s.diff(k) / s.diff(k + 1)),
    "ch": lambda s, k: s.ch(k),
    "hartigan": lambda s, k: (s.tr[k - 1] / s.tr[k] - 1) * (s.n - k) - (s.tr[k] / s.tr[k + 1] - 1) * (s.n - k - 1),
    "ccc": lambda s, k: _ccc(s.W[1], s.n, k, 1 - s.tr[k] / s.tr[1]),
    "scott": lambda s, k: s.n * (math.log(s.det[1] / s.det[k]) - math.log(s.det[1] / s.det[k - 1])),
    "marriot": lambda s, k: _second(lambda j: j * j * s.det[j], k),
    "trcovw": lambda s, k: float(np.trace(np.atleast_2d(np.cov(s.W[k - 1]))) - np.trace(np.atleast_2d(np.cov(s.W[k])))) if s.p > 1 else math.nan,
    "tracew": lambda s, k: (s.tr[k - 1] - s.tr[k]) - (s.tr[k] - s.tr[k + 1]),
    "friedman": lambda s, k: float(np.trace(np.linalg.solve(s.W[k], s.W[1] - s.W[k])) - np.trace(np.linalg.solve(s.W[k - 1], s.W[1] - s.W[k - 1]))),
    "rubin": lambda s, k: _second(lambda j: s.det[1] / s.det[j], k),
    "ratkowsky": lambda s, k: float(np.mean(np.sqrt(1 - np.diag(s.W[k]) / np.diag(s.W[1])))) / math.sqrt(k),
    "ball": lambda s, k: s.tr[k - 1] / (k - 1) - s.tr[k] / k,
    "db": lambda s, k: s.davies_bouldin(k),
    "sdindex": lambda s, k: s.dis(s.high) * s.scat(k) + s.dis(k),
    "sdbw": lambda s, k: s.scat(k) + s.density_between(k),
    "duda": lambda s, k: s.split(k)[0],
    "pseudot2": lambda s, k: s.split(k)[1],
    "beale": lambda s, k: s.split(k)[2],
    "silhouette": lambda s, k: s.silhouette[k],
    "dunn": lambda s, k: s.pairs[k]["min_between"] / s.pairs[k]["max_within"],
    "cindex": _cindex,
    "mcclain": lambda s, k: s.mean_within(k) / s.mean_between(k),
    "ptbiserial": _ptbiserial,
    "frey": lambda s, k: (s.mean_between(k + 1) - s.mean_between(k)) / (s.mean_within(k + 1) - s.mean_within(k)),
    "dindex": lambda s, k: s.to_centre[k],
    "hubert": lambda s, k: s.pairs[k]["hubert"],
}


def index_values(s: Statistics) -> tuple[dict[str, dict[int, float]], dict[str, str]]:
    """Value of every index at every k, and the message of each index that failed."""
    for part in ("_pairs", "extremes", "silhouette", "splits"):  # a pass that fails is no failure of an index
        getattr(s, part)
    values, errors = {}, {}
    for name in INDICES:
        values[name] = {}
        for k in s.ks:
            try:
                values[name][k] = float(FORMULAS[name](s, k))
            except (ArithmeticError, ValueError, KeyError, np.linalg.LinAlgError) as e:
                values[name][k] = math.nan
                errors.setdefault(name, f"k={k}: {type(e).__name__}: {e}")
    return values, errors


def votes(values: dict[str, dict[int, float]], ks: list[int], errors: dict[str, str] | None = None) -> list[dict]:
    """One row an index: the k it votes for, or why it has none."""
    first = {"duda": lambda x: x >= 0, "pseudot2": lambda x: x <= 0, "beale": lambda x: x <= 0}
    least = {"db", "sdindex", "sdbw", "cindex", "mcclain", "rubin"}
    out = []
    for name in INDICES:
        v = {k: values[name].get(k, float("nan")) for k in ks}
        fine = {k: x for k, x in v.items() if x is not None and math.isfinite(x)}
        k = None
        if name in first:
            k = next((a for a in ks if a in fine and first[name](fine[a])), None)
        elif name == "frey":
            below = next((a for a in ks if a in fine and fine[a] < 1), None)
            k = None if below is None else below - 1
        elif fine:
            k = min(fine, key=lambda a: (fine[a] if name in least else -fine[a], a))
        message = (errors or {}).get(name)
        status = "GRAPHICAL" if name in GRAPHICAL else "VOTE" if k in ks else "OUT_OF_RANGE" if k is not None else "ERROR" if message and not fine else "NO_RESULT"
        out.append({"index": name, "k": k if status == "VOTE" else None, "status": status, "message": message})
    return out


def cast_table(spark: SparkSession, cast: list[dict]) -> DataFrame:
    return spark.createDataFrame([(v["index"], v["k"], v["status"], v["message"]) for v in cast], "index string, k int, status string, message string")


def diagnostics(s: Statistics, spark: SparkSession) -> DataFrame:
    """Per k: the three metrics, inertia, rounds and sizes of its best run."""
    rows = [(k, round(s.silhouette[k], 6), round(s.davies_bouldin(k), 6), round(s.ch(k), 6), round(s.runs[k].inertia, 6), s.runs[k].rounds, ",".join(str(g[0]) for g in s.groups[k])) for k in s.ks]
    return spark.createDataFrame(rows, "k int, silhouette double, davies_bouldin double, calinski_harabasz double, inertia double, rounds int, sizes string")


def selection(df: DataFrame, ids: str, features: list[str], ks=range(2, 11), starts: int = 10, seed: int = 0, repeats: int = 2) -> dict:
    """The whole choice of k: fits, indices, votes, tie-break, strict decision; all repeated, and refused unless every repeat selects alike.

    Returns ``votes``, ``table``, ``diagnostics``, ``ranks`` and ``decision``.
    """
    spark, ks, seen, first = df.sparkSession, list(ks), [], None
    for _ in range(repeats):
        s = Statistics(df, ids, features, ks, starts, seed)
        values, errors = index_values(s)
        cast = votes(values, ks, errors)
        metrics = diagnostics(s, spark)
        table = vote_table(cast_table(spark, cast), min(ks), max(ks)).orderBy("k")
        rows = [r.asDict() for r in table.collect()]
        seen.append(json.dumps([cast, rows], sort_keys=True))
        first = first or (cast, rows, table, metrics, values)
    cast, rows, table, metrics, values = first
    decision = decide(rows, all(x == seen[0] for x in seen))
    leaders = [r["k"] for r in rows if r["leader"] and r["votes"]]
    tied = tie_break(metrics.filter(F.col("k").isin(leaders)))
    return {"votes": cast_table(spark, cast), "values": values, "table": table, "diagnostics": metrics, "ranks": tied, "decision": decision}


def vote_table(cast: DataFrame, low: int = 2, high: int = 10) -> DataFrame:
    """Votes of every candidate k, zero rows kept, with leader flag, dense place and the count of usable votes."""
    ks = cast.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias("k"))
    t = ks.join(cast.filter("status = 'VOTE'").groupBy("k").agg(F.count(F.lit(1)).alias("votes")), "k", "left").withColumn("votes", F.coalesce("votes", F.lit(0)))
    everything = Window.partitionBy(F.lit(0))  # a row a candidate k
    return t.withColumn("leader", F.col("votes") == F.max("votes").over(everything)).withColumn("place", F.dense_rank().over(everything.orderBy(F.desc("votes")))).withColumn("usable", F.sum("votes").over(everything))


def tie_break(metrics: DataFrame) -> DataFrame:
    """``k, silhouette, davies_bouldin, calinski_harabasz`` to average ranks, rank sum and the chosen k (ties to the smaller)."""
    m = metrics.withColumn("one", F.lit(1))
    for name, down in (("silhouette", True), ("davies_bouldin", False), ("calinski_harabasz", True)):
        m = average_ranks(m, name, "one", down).withColumnRenamed("avg_rank", f"{name}_rank")
    m = m.withColumn("rank_sum", F.col("silhouette_rank") + F.col("davies_bouldin_rank") + F.col("calinski_harabasz_rank"))
    return m.withColumn("selected", F.row_number().over(Window.partitionBy("one").orderBy("rank_sum", "k")) == 1).drop("one")


def decide(table: list[dict], reproduced: bool = True) -> dict:
    """Strict mode: a tie or an unreproduced selection gives no k, and says why."""
    leaders = [r["k"] for r in table if r["leader"] and r["votes"]]
    reasons = [*(["several leaders"] if len(leaders) > 1 else []), *(["no votes"] if not leaders else []), *(["not reproduced"] if not reproduced else [])]
    return {"k": None if reasons else leaders[0], "stop_reasons": reasons}


def metric_ranks(metrics: DataFrame, k: int) -> DataFrame:
    """Rank of a given k by each metric, best k by each (ties to the smaller), and whether k is among the first three in two."""
    m = metrics.select("k", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), (s * F.col(n)).alias("cost")) for n, s in (("silhouette", -1), ("davies_bouldin", 1), ("calinski_harabasz", -1))])).alias("r")).select("k", "r.*")
    own = m.filter(F.col("k") == k).select("metric", F.col("cost").alias("own"))
    g = m.join(own, "metric").groupBy("metric").agg((F.count_if((F.col("cost") < F.col("own")) | ((F.col("cost") == F.col("own")) & (F.col("k") < k))) + 1).alias("rank"), F.min(F.struct("cost", "k")).alias("b"))
    return g.select("metric", "rank", F.col("b.k").alias("best_k"), (F.col("rank") <= 3).alias("in_top_three"))


def plausibility(ranks: list[dict], k: int = 2) -> str:
    """Label of the support for k."""
    best = {r["metric"]: r["best_k"] for r in ranks}
    if set(best.values()) == {k}:
        return f"CONSISTENT_SUPPORT_FOR_K{k}"
    return f"MIXED_SUPPORT_K{k}_IS_SILHOUETTE_WINNER_WITHOUT_MULTI_INDEX_CONSENSUS" if best["silhouette"] == k else f"K{k}_NOT_SELECTED_BY_ANY_PRIMARY_DIAGNOSTIC"


def by_silhouette(values: dict[int, float]) -> int:
    return min(values, key=lambda k: (-values[k], k))
