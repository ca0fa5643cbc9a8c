"""K-means from given or drawn centres, replicated runs, validity, stability, profiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks, lloyd
from .audit import joined
from .ranks import quantiles


def nearest(point, centres: list[list[float]]):
    """Index (from 1) of the nearest centre, ties to the first; inside codegen for small k."""
    d = [F.struct(sum((point[j] - float(x)) ** 2 for j, x in enumerate(c)).alias("d"), F.lit(i + 1).alias("label")) for i, c in enumerate(centres)]
    return F.least(*d) if len(d) > 1 else d[0]


def kmeans(df: DataFrame, features: list[str], seeds: list[list[float]], rounds: int = 300, tol: float = 1e-4) -> tuple[DataFrame, list[list[float]], int]:
    """Lloyd's algorithm from given centres: each round is one map-side aggregation of k rows.

    Rows with a null or non-finite coordinate and empty clusters are refused.  It ends when the centres stand
    still (no label changes) or move by at most ``tol`` of the mean variance.
    """
    point = [F.col(c) for c in features]
    bad = F.count_if(sum(F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 1).otherwise(0) for c in features) > 0)
    *spread, wrong = df.agg(*[F.var_pop(c) for c in features], bad).head()
    if wrong:
        raise ValueError(f"{wrong} rows with missing or non-finite features")
    limit = tol * sum(v or 0.0 for v in spread) / len(features)
    centres = [list(map(float, s)) for s in seeds]
    n = 0
    for n in range(1, rounds + 1):
        means = {r[0]: list(r[1:]) for r in df.groupBy(nearest(point, centres)["label"].alias("label")).agg(*[F.avg(c) for c in features]).collect()}
        if len(means) < len(centres):
            raise ValueError(f"empty clusters: {sorted(set(range(1, len(centres) + 1)) - set(means))}")
        new = [means[i + 1] for i in range(len(centres))]
        shift = sum((a - b) ** 2 for x, y in zip(new, centres) for a, b in zip(x, y))
        centres = new
        if shift <= limit:
            break
    return df.withColumn("cluster", nearest(point, centres)["label"]), centres, n


def inertia(df: DataFrame, features: list[str], centres: list[list[float]]) -> DataFrame:
    return df.agg(F.round(F.sum(nearest([F.col(c) for c in features], centres)["d"]), 6).alias("inertia"))


def random_centres(df: DataFrame, ids: str, features: list[str], k: int, seeds: list[int]) -> dict[int, list[list[float]]]:
    """Per seed, the k rows of least seeded hash: one job for all seeds."""
    each = df.select(ids, F.array(*[F.col(c).cast("double") for c in features]).alias("x"), F.explode(F.array(*[F.lit(s) for s in seeds])).alias("run")).withColumn("h", F.xxhash64(ids, "run"))
    first = each.withColumn("at", F.row_number().over(Window.partitionBy("run").orderBy("h", ids))).filter(F.col("at") <= k)
    out: dict[int, list] = {s: [] for s in seeds}
    for r in first.select("run", "at", "x").orderBy("run", "at").collect():  # k rows a seed
        out[r["run"]].append(list(r["x"]))
    return out


def replicate(df: DataFrame, ids: str, features: list[str], k: int, seeds: list[int], rounds: int = 300, tol: float = 1e-4) -> tuple[DataFrame, dict[int, lloyd.Run]]:
    """Runs of all seeds side by side, from randomly drawn rows: every run is kept.

    Returns ``id, features.., run, label, d2`` (label from 1 by centre order of the first feature) and the runs,
    which say whether they stood still, after how many rounds, and how many clusters are empty.
    """
    table = lloyd.points(df, ids, features)
    drawn = random_centres(df, ids, features, k, seeds)
    runs = {s: lloyd.Run(k, s, start=np.array(drawn[s])) for s in seeds}
    lloyd.lloyd(table, list(runs.values()), rounds, tol)
    at = lambda s: nearest([F.get("x", F.lit(j)) for j in range(len(features))], runs[s].centres.tolist())
    every = table.select("id", "x", F.explode(F.array(*[F.struct(F.lit(s).alias("run"), at(s).alias("n")) for s in seeds])).alias("r"))
    out = every.select(F.col("id").alias(ids), *[F.get("x", F.lit(j)).alias(c) for j, c in enumerate(features)], "r.run", F.col("r.n.label").alias("label"), F.col("r.n.d").alias("d2"))
    return out, runs


def best_start(df: DataFrame, ids: str, features: list[str], k: int, n: int = 50, seed: int = 0) -> tuple[DataFrame, lloyd.Run]:
    """k-means++ with n starts: rows with the labels of the run of least inertia, and that run."""
    table = lloyd.points(df, ids, features)
    runs = [lloyd.Run(k, seed + i) for i in range(n)]
    lloyd.plus_plus(table, runs)
    lloyd.lloyd(table, runs)
    top = lloyd.best(runs)
    return lloyd.labelled(table, [top]).select(F.col("id").alias(ids), *[F.get("x", F.lit(j)).alias(c) for j, c in enumerate(features)], (F.get("codes", F.lit(0)) + 1).alias("label")), top


def run_summary(runs: DataFrame) -> DataFrame:
    per = runs.groupBy("run", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("d2").alias("i"))
    return per.groupBy("run").agg(F.round(F.sum("i"), 6).alias("inertia"), F.array_join(F.array_sort(F.collect_list("n")), ",").alias("sizes"))


def centre_movement(start: list[list[float]], end: list[list[float]]) -> list[dict]:
    return [{"cluster": i + 1, "distance": sum((a - b) ** 2 for a, b in zip(x, y)) ** 0.5} for i, (x, y) in enumerate(zip(start, end))]


def boundary(centres: list[list[float]]) -> float:
    """Midpoint of two one-dimensional centres."""
    return (centres[0][0] + centres[1][0]) / 2


def calinski_harabasz(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """Sums of squares about means (no cancellation), one aggregation by label and one over all."""
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *[(F.var_pop(c) * F.count(c)).alias(f"w_{c}") for c in features])
    inside = g.agg(F.sum(sum(F.col(f"w_{c}") for c in features)).alias("w"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    total = df.agg(sum(F.var_pop(c) * F.count(c) for c in features).alias("t"))
    return inside.crossJoin(total).select(F.round((F.col("t") - F.col("w")) / (F.col("k") - 1) / (F.col("w") / (F.col("n") - F.col("k"))), 6).alias("calinski_harabasz"))  # one row each


def davies_bouldin(df: DataFrame, label: str, features: list[str], max_labels: int = 10_000) -> DataFrame:
    """Mean distance to the own centre, then the worst ratio per cluster over pairs of the k centres (k is checked).

    Two passes in which a task hands on one row a label, so that width costs array work, not compiled expressions."""
    spark, p = df.sparkSession, len(features)
    rows = df.filter(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("g"), F.array(*[F.col(c).cast("double") for c in features]).alias("x")).filter(F.forall("x", lambda v: v.isNotNull()))
    if rows.select("g").distinct().limit(max_labels + 1).count() > max_labels:
        raise ValueError(f"more than {max_labels} clusters")

    def sums(of):
        """Per label, the sum of ``of(label, vectors)`` over its rows, added up by Spark."""

        def run(batches):
            total: dict[str, np.ndarray] = {}
            for batch in batches:
                x, g = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, p), np.array(batch.column("g").to_pylist(), object)
                for own in set(g):
                    total[own] = total.get(own, 0) + of(own, x[g == own])
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], names=["g", "t"])

        out: dict[str, dict] = {}
        for g, at, v in rows.mapInArrow(run, "g string, t array<double>").select("g", F.posexplode("t").alias("at", "v")).groupBy("g", "at").agg(F.sum("v")).collect():  # a row a label and sum
            out.setdefault(g, {})[at] = v
        return {g: np.array([t[i] for i in range(len(t))]) for g, t in out.items()}

    first = sums(lambda _, x: np.r_[len(x), x.sum(0)])
    means = {g: t[1:] / t[0] for g, t in first.items()}
    inside = sums(lambda g, x: np.array([np.sqrt(((x - means[g]) ** 2).sum(1)).sum()]))
    names = sorted(means)
    if len(names) < 2:
        return spark.createDataFrame([(None,)], "davies_bouldin double")
    m, s = np.array([means[g] for g in names]), np.array([inside[g][0] / first[g][0] for g in names])
    worst = []
    for i in range(len(names)):
        with np.errstate(divide="ignore", invalid="ignore"):
            r = (s[i] + s) / np.sqrt(((m - m[i]) ** 2).sum(1))
        worst.append(np.delete(r, i).max())
    return spark.createDataFrame([(round(float(np.mean(worst)), 6),)], "davies_bouldin double")


def silhouette(df: DataFrame, ids: str, vec: str, label: str, max_labels: int = 10_000) -> DataFrame:
    """Exact mean silhouette by Euclidean distance; sums per row and cluster leave the tasks, pairs never (the number of labels is checked)."""
    names = [r[0] for r in df.select(label).distinct().limit(max_labels + 1).collect()]
    if len(names) > max_labels:
        raise ValueError(f"more than {max_labels} clusters")
    code = F.coalesce(*[F.when(F.col(label).eqNullSafe(F.lit(v)), F.lit(i)) for i, v in enumerate(names)], F.lit(-1))
    value = blocks.silhouettes(df.withColumn("_codes", F.array(code)), ids, vec, "_codes", [len(names)])[0] if names else None
    return df.sparkSession.createDataFrame([(None if value is None else round(value, 6),)], "silhouette double")


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def label_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.count_if(F.col(a) == F.col(b)).alias("n_equal"), F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col(a) == F.col(b)).cast("int")) * 100, 6).alias("pct"))


def _ari(cells: DataFrame, keys: list[str]) -> DataFrame:
    """From counts of label pairs: sums by row, by column and in all come from one grouping each."""
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2
    x = cells.groupBy(*keys).agg(F.sum(two("n")).alias("ij"), F.sum("n").alias("total"))
    y = cells.groupBy(*keys, "la").agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.sum(two("n")).alias("ai"))
    z = cells.groupBy(*keys, "lb").agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.sum(two("n")).alias("bj"))
    t = x.join(y, keys).join(z, keys)
    chance = F.col("ai") * F.col("bj") / (F.col("total") * (F.col("total") - 1) / 2)
    half = (F.col("ai") + F.col("bj")) / 2
    return t.select(*keys, F.round(F.when(half == chance, 1.0).otherwise((F.col("ij") - chance) / (half - chance)), 6).alias("ari"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """From the contingency table: pairs are counted, never formed."""
    cells = df.groupBy(F.col(a).alias("la"), F.col(b).alias("lb")).agg(F.count(F.lit(1)).alias("n")).withColumn("one", F.lit(1))
    return _ari(cells, ["one"]).drop("one")


def ordered_labels(df: DataFrame, label: str, value: str, centre: str | None = None) -> DataFrame:
    """Labels renumbered from 1 by mean value: k rows."""
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"))
    return g.select(label, "n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("m", label)).alias("canonical"), *([F.col("m").alias(centre)] if centre else []))


def first_appearance(runs: DataFrame, index: str) -> DataFrame:
    """``run, label, canonical``: labels numbered from 0 by first appearance along a stored index."""
    first = runs.groupBy("run", "label").agg(F.min(index).alias("_f"))
    return first.select("run", "label", (F.row_number().over(Window.partitionBy("run").orderBy("_f")) - 1).alias("canonical"))


def profile(df: DataFrame, label: str, value: str, support: tuple[str, ...] = ()) -> DataFrame:
    """Per cluster: size, share, centre less the mean of all, mean, deviation, range, exact quartiles, and medians of further columns."""
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"), F.sum(value).alias("_s"), F.count(value).alias("_c"))
    everything = Window.partitionBy(F.lit(0))  # a row a cluster
    share = F.col("n") * 100.0 / F.sum("n").over(everything)
    centre = F.col("mean") - F.sum("_s").over(everything) / F.sum("_c").over(everything)
    q = quantiles(df, value, [0.25, 0.5, 0.75], [label]).select(label, F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"))
    g = joined(g.withColumn("percent", share).withColumn("centre_minus_mean", centre), q, [label])
    for c in support:
        g = joined(g, quantiles(df, c, [0.5], [label]).withColumnRenamed("q0", f"median_{c}"), [label])
    return g.select(label, "n", *[F.round(c, 6).alias(c) for c in ("percent", "centre_minus_mean", "mean", "sd", "min", "q1", "median", "q3", "max", *(f"median_{c}" for c in support))])


def assignment_table(df: DataFrame, ids: str, label: str, value: str) -> DataFrame:
    """Rows with the cluster's rank by ascending mean, and that mean as the centre."""
    ranked = ordered_labels(df, label, value, "centre").select(label, F.col("canonical").alias("ordered_rank"), F.round("centre", 6).alias("centre"))
    return df.select(ids, label, value).join(F.broadcast(ranked), label)  # a row a cluster


def check_assignment(df: DataFrame, ids: str, label: str, k: int) -> DataFrame:
    """Rows, distinct ids, null labels, clusters seen, labels within 1 to k."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(ids).alias("n_ids"), F.count_if(F.col(label).isNull()).alias("n_unlabelled"), F.count_distinct(label).alias("n_clusters"), F.coalesce(F.bool_and(F.col(label).between(1, k)), F.lit(True)).alias("labels_in_range"))


def validate_assignment(df: DataFrame, roster: DataFrame, first: str, second: str, label: str, value: str, k: int) -> DataFrame:
    """The ten checks of a finished assignment of pairs of ids: counts of rows, of either id and of pairs, each pair once, non-finite
    values, empty clusters, members in all, centres strictly ascending by label, and the same pairs as the roster."""
    v = F.col(value).cast("double")
    one = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(first).alias("n_first"), F.count_distinct(second).alias("n_second"), F.count_if(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))).alias("n_nonfinite"))
    pairs = df.groupBy(first, second).agg(F.count(F.lit(1)).alias("c")).agg(F.count(F.lit(1)).alias("n_pairs"), F.coalesce(F.max("c") == 1, F.lit(True)).alias("each_once"))
    per = df.filter(F.col(label).between(1, k)).groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("m"))
    before = F.lag("m").over(Window.partitionBy(F.lit(0)).orderBy(label))  # a row a cluster
    groups = per.withColumn("_b", before).agg((F.lit(k) - F.count(F.lit(1))).alias("n_empty"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_members"), F.coalesce(F.bool_and(F.coalesce(F.col("m") > F.col("_b"), F.lit(True))), F.lit(True)).alias("centres_ascend"))
    both = df.select(first, second).distinct().withColumn("_a", F.lit(1)).join(roster.select(first, second).distinct().withColumn("_r", F.lit(1)), [first, second], "full")
    same = both.agg(F.coalesce(F.bool_and(F.col("_a").isNotNull() & F.col("_r").isNotNull()), F.lit(True)).alias("same_pairs"))
    return one.crossJoin(pairs).crossJoin(groups).crossJoin(same)  # one row each


def tail_overlap(primary: DataFrame, refit: DataFrame, ids: str) -> DataFrame:
    """Agreement and adjusted Rand index of a refit on fewer rows."""
    both = primary.select(ids, F.col("label").alias("la")).join(refit.select(ids, F.col("label").alias("lb")), ids)
    return label_agreement(both, "la", "lb").crossJoin(adjusted_rand(both, "la", "lb"))  # one row each
