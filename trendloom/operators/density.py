"""Density-peak seeding: cutoff, density, separation, seeds, sensitivity.

Pairs are measured block against block (``blocks``) and only sums, counts and least
values per row leave a task, so there is no limit of rows but the time that all
pairs take.  In few dimensions, grids do the same work on near pairs alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import distance
from . import blocks, line
from .ranks import _held, global_rank, positions

LADDER = (0, 1, 5, 25, 50, 75, 95, 99, 100)


def cutoff(df: DataFrame, ids: str, vec: str, q: float = 0.02) -> float | None:
    """Linear quantile of the strictly positive distances, by counting: no list of pairs is kept."""
    return blocks.distance_quantiles(df, ids, vec, [q], positive=True).get(q)


def distance_audit(df: DataFrame, ids: str, vec: str) -> DataFrame:
    """Pairs, pairs at distance 0, least positive, greatest and mean distance."""
    r = lambda c: F.round(c, 6).alias(c)
    return blocks.distance_totals(df, ids, vec).select("n_pairs", "n_zero", r("min_positive"), r("max"), r("mean"))


def distance_ladder(df: DataFrame, ids: str, vec: str, percents=LADDER) -> DataFrame:
    """Exact linear percentiles of all pair distances, one row each."""
    got = blocks.distance_quantiles(df, ids, vec, [p / 100 for p in percents])
    return df.sparkSession.createDataFrame([(p, round(got[p / 100], 6) if got else None) for p in percents], "percent int, value double")


def density(df: DataFrame, ids: str, vec: str, d_c: float) -> DataFrame:
    """``id, rho``: other rows strictly nearer than the cutoff."""
    return densities(df, ids, vec, [d_c]).withColumnRenamed("rho0", "rho")


def densities(df: DataFrame, ids: str, vec: str, limits: list[float]) -> DataFrame:
    """``id, rho0, rho1..`` at several cutoffs, from one pass over pairs."""
    near = blocks.counts_within(df, ids, vec, limits)
    return df.select(ids, vec).join(near, ids, "left").select(ids, vec, *[F.coalesce(F.col(f"n{i}"), F.lit(0)).alias(f"rho{i}") for i in range(len(limits))])


def density_grid(df: DataFrame, ids: str, vec: str, dims: int, d_c: float) -> DataFrame:
    """The same in few dimensions.  One dimension: running counts along the order.  Else cells of width d_c, whose places (equal rows are one) meet those of the neighbouring cells."""
    if dims == 1:
        return line.density(df, ids, vec, d_c)
    places = df.groupBy(F.col(vec).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    cell = [F.floor(F.get("v", F.lit(k)) / d_c).alias(f"c{k}") for k in range(dims)]
    rows = places.select("v", "n", *cell)
    near = rows.drop("n")
    for k in range(dims):
        near = near.withColumn(f"c{k}", F.explode(F.array(F.col(f"c{k}") - 1, F.col(f"c{k}"), F.col(f"c{k}") + 1)))
    other = rows.withColumnRenamed("v", "w")
    hit = near.join(other, [f"c{k}" for k in range(dims)]).filter(distance("v", "w") < d_c)
    counts = hit.groupBy(F.col("v").alias(vec)).agg((F.sum("n") - 1).alias("rho"))
    return df.select(ids, vec).join(counts, vec, "left").select(ids, vec, F.coalesce("rho", F.lit(0)).alias("rho"))


def separation(rho: DataFrame, ids: str, vec: str) -> DataFrame:
    """Least distance to a strictly denser row; every row of the greatest density gets its largest distance."""
    return separations(rho, ids, vec, ["rho"]).withColumnRenamed("delta0", "delta")


def separations(rho: DataFrame, ids: str, vec: str, columns: list[str]) -> DataFrame:
    """``id, columns.., delta0..`` for several densities, from one pass over pairs."""
    g = blocks.nearest_greater(rho, ids, vec, columns)
    return rho.select(ids, *columns).join(g, ids, "left").select(ids, *columns, *[F.coalesce(F.col(f"near{i}"), "far", F.lit(0.0)).alias(f"delta{i}") for i in range(len(columns))])


def separation_grid(rho: DataFrame, ids: str, vec: str, dims: int, per_cell: int = 8) -> DataFrame:
    """The same in few dimensions, for any number of rows: rings of cells that grow until a denser row is nearer than the ring.

    Rows of one place have one density, so a round works on distinct places.  A place looks
    into the cells around its own for a strictly denser one; what it finds is final once it is no farther than a cell is
    wide, for anything outside lies farther.  The others go on with cells twice as wide, and of
    a cell only places denser than the asking one are met.  Places of the greatest
    density get their farthest distance: from the ends in one dimension, else from one pass over the places.
    """
    x = lambda j: F.get("v", F.lit(j))
    places = _held(rho.select(F.col(vec).alias("v"), "rho").groupBy("v").agg(F.max("rho").alias("rho")))
    edges = places.agg(F.count(F.lit(1)), F.max("rho"), *[f(x(j)) for j in range(dims) for f in (F.min, F.max)]).head()
    n, top = edges[0], edges[1]
    if not n:
        return rho.select(ids, "rho", F.lit(0.0).alias("delta"))
    low, span = edges[2::2], [b - a for a, b in zip(edges[2::2], edges[3::2])]
    width = max(max(span) / max(1.0, (n / per_cell) ** (1 / dims)), 1e-300)
    around = [[d] for d in (-1, 0, 1)]
    for _ in range(dims - 1):
        around = [[*a, d] for a in around for d in (-1, 0, 1)]
    cell = lambda w: F.array(*[F.floor((x(j) - low[j]) / w).cast("long") for j in range(dims)])
    steps = F.array(*[F.array(*[F.lit(d).cast("long") for d in a]) for a in around])
    open_, final = places.filter(F.col("rho") < top).select("v", "rho", F.lit(None).cast("double").alias("found")), []
    while True:
        asking = open_.withColumn("c", F.explode(F.transform(steps, lambda s: F.zip_with(s, cell(width), lambda a, b: a + b))))
        inside = places.select(cell(width).alias("c"), F.struct("rho", "v").alias("other"))
        met = asking.join(inside, "c").filter(F.col("other.rho") > F.col("rho"))
        near = met.groupBy("v").agg(F.min(distance("v", "other.v")).alias("d"))
        seen = _held(open_.select("v", "rho").join(near, "v", "left"))
        final.append(seen.filter(F.col("d") <= width).select("v", "d"))
        open_ = seen.filter(F.col("d").isNull() | (F.col("d") > width)).select("v", "rho", F.col("d").alias("found"))
        left = open_.count()
        if not left:
            break
        if width > max(span):  # one neighbourhood holds all places: what was found is final
            final.append(open_.select("v", F.col("found").alias("d")))
            break
        width *= 2
    peak = places.filter(F.col("rho") == top).select("v")
    if dims == 1:
        far = peak.select("v", F.greatest(F.abs(x(0) - low[0]), F.abs(x(0) - low[0] - span[0])).alias("d"))
    else:
        far = _farthest(peak, places)
    out = far
    for f in final:
        out = out.unionByName(f)
    return rho.select(ids, "rho", F.col(vec).alias("v")).join(out, "v", "left").select(ids, "rho", F.coalesce("d", F.lit(0.0)).alias("delta"))


def _farthest(peak: DataFrame, places: DataFrame, few: int = 10_000) -> DataFrame:
    """Greatest distance of the peaks to any place: peaks travel to the rows if they are few (which is counted), else all meet in blocks."""
    held = [r[0] for r in peak.limit(few + 1).collect()]
    if len(held) <= few:
        return blocks.farthest(places, "v", held)
    both = peak.withColumn("_peak", F.lit(1)).unionByName(places.select("v").join(peak, "v", "left_anti").withColumn("_peak", F.lit(0)))
    return blocks.nearest_greater(both.withColumn("id", F.col("v")), "id", "v", ["_peak"]).join(peak.withColumnRenamed("v", "id"), "id", "left_semi").select(F.col("id").alias("v"), F.col("far").alias("d"))


def peaks(df: DataFrame, ids: str, vec: str, q: float = 0.02, d_c: float | None = None) -> tuple[DataFrame, float]:
    """``id, rho, delta, gamma`` and the cutoff."""
    limit = cutoff(df, ids, vec, q) if d_c is None else d_c
    return separation(density(df, ids, vec, limit or 0.0), ids, vec).withColumn("gamma", F.col("rho") * F.col("delta")), limit


def ranked(scored: DataFrame, ids: str, k: int = 2) -> DataFrame:
    """All rows with ``gamma_rank`` (descending, ties to the smaller id), whether chosen as a seed, and the seed's order."""
    r = global_rank(scored, [F.desc("gamma"), F.col(ids)], "gamma_rank")
    return r.withColumn("selected_as_seed", F.col("gamma_rank") <= k).withColumn("seed_order", F.when(F.col("gamma_rank") <= k, F.col("gamma_rank").cast("int")))


def candidate_report(scored: DataFrame, values: DataFrame, ids: str, value: str, n: int = 10) -> DataFrame:
    """The n candidates of greatest gamma with their place in the distribution of a value:
    rank, percentile, rows below and above, ties at the same density, and whether they lie in either one-percent tail."""
    top = ranked(scored, ids, 2).filter(F.col("gamma_rank") <= n)
    ties = scored.groupBy("rho").agg(F.count(F.lit(1)).alias("same_rho"))
    return top.join(ties, "rho").join(positions(values, value, ids), ids).select(ids, "gamma_rank", "selected_as_seed", "rho", "same_rho", F.round("delta", 6).alias("delta"), F.round("gamma", 6).alias("gamma"), F.round(value, 6).alias(value), "rank", "percentile", "n_before", "n_after", "low_tail", "high_tail")


def seeds(scored: DataFrame, ids: str, k: int = 2) -> DataFrame:
    return scored.orderBy(F.desc("gamma"), ids).limit(k)


def cutoff_sensitivity(df: DataFrame, ids: str, vec: str, qs=(0.01, 0.02, 0.03), k: int = 2, primary: float = 0.02) -> list[dict]:
    """Seeds at nearby cutoffs: same ordered list, same set.  All cutoffs share the passes over pairs."""
    every = list(dict.fromkeys([*qs, primary]))
    limits = blocks.distance_quantiles(df, ids, vec, every, positive=True)
    if not limits:
        return []
    rho = _held(densities(df, ids, vec, [limits[q] for q in every]))
    both = _held(separations(rho, ids, vec, [f"rho{i}" for i in range(len(every))]))
    chosen = {}
    for i, q in enumerate(every):
        gamma = F.col(f"rho{i}") * F.col(f"delta{i}")
        chosen[q] = [r[0] for r in both.orderBy(F.desc(gamma), ids).limit(k).select(ids).collect()]
    return [{"q": q, "d_c": limits[q], "seeds": chosen[q], "same_order": chosen[q] == chosen[primary], "same_set": set(chosen[q]) == set(chosen[primary])} for q in qs]


def verdict(sensitivity: list[dict], seed_rows: list[dict], max_rho: int, separation_: float, d_c: float) -> dict:
    """Seeds are unsuitable if a nearby cutoff changes them, or if all tie at the greatest density within one cutoff."""
    reasons = []
    if not all(s["same_set"] for s in sensitivity):
        reasons.append("a nearby cutoff changes the seeds")
    if all(r["rho"] == max_rho for r in seed_rows) and separation_ < d_c:
        reasons.append("seeds tie at the greatest density within one cutoff")
    return {"suitable": not reasons, "reasons": reasons, "initialisation": "seeded random" if reasons else "density peaks"}


def density_profile(rho: DataFrame) -> DataFrame:
    """Frequency of every density, with flags of zero and of the greatest."""
    g = rho.groupBy("rho").agg(F.count(F.lit(1)).alias("n"))
    top = g.agg(F.max("rho").alias("top"))
    return g.crossJoin(F.broadcast(top)).select("rho", "n", (F.col("rho") == 0).alias("zero"), (F.col("rho") == F.col("top")).alias("greatest"))  # one row
