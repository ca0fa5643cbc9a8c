"""Run documents, checks, manifests, comparison of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys that would give an entity away.
IDENTIFIERS = ["rid", "ptid", "participant_id", "subject_id"]


def checks(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``check, violations, passed`` from one aggregation."""
    r = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    return r.unpivot([], list(rules), "check", "violations").withColumn("passed", F.col("violations") == 0)


def gate(report: DataFrame) -> DataFrame:
    return report.agg(F.count(F.lit(1)).alias("n_checks"), F.count_if(~F.col("passed")).alias("n_failed"), F.coalesce(F.bool_and("passed"), F.lit(True)).alias("complete"))


def compare_to_baseline(result: DataFrame, runs: DataFrame) -> DataFrame:
    """``metric, value`` against ``run, metric, value``: differences, direction, place in the range of the runs."""
    b = runs.groupBy("metric").agg(F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))
    d = F.col("value") - F.col("mean")
    better = F.when(F.col("metric").isin("davies_bouldin", "inertia"), -d).otherwise(d)
    return result.join(b, "metric").select(
        "metric", F.round("value", 6).alias("value"), F.round("mean", 6).alias("mean"), F.round(d, 6).alias("difference"), F.round(F.when(F.col("mean") != 0, d * 100 / F.col("mean")).otherwise(0.0), 6).alias("pct"),
        F.when(F.abs(d) <= 1e-12, "equal").when(better > 0, "better").otherwise("worse").alias("direction"), F.when(F.col("value") < F.col("low"), "below").when(F.col("value") > F.col("high"), "above").otherwise("within").alias("range"))


def compare_documents(a: DataFrame, b: DataFrame, tolerance: float = 1e-11) -> DataFrame:
    """``key, value`` rows: keys on one side, exact text or number within an absolute tolerance."""
    j = a.select("key", F.col("value").alias("va"), F.lit(1).alias("ia")).join(b.select("key", F.col("value").alias("vb"), F.lit(1).alias("ib")), "key", "full")
    near = F.abs(F.col("va").try_cast("double") - F.col("vb").try_cast("double")) <= tolerance
    return j.select("key", (F.col("ia").isNotNull() & F.col("ib").isNotNull() & (F.col("va").eqNullSafe(F.col("vb")) | F.coalesce(near, F.lit(False)))).alias("same"))


def only_left(a: DataFrame, b: DataFrame, *ids: str) -> DataFrame:
    """Distinct id tuples of the first table that the second lacks."""
    return a.select(*ids).distinct().join(b.select(*ids).distinct(), list(ids), "left_anti")


def same_ids(a: DataFrame, b: DataFrame, *ids: str) -> DataFrame:
    """Set equality of id tuples: both differences counted."""
    j = a.select(*ids).distinct().withColumn("ia", F.lit(1)).join(b.select(*ids).distinct().withColumn("ib", F.lit(1)), list(ids), "full")
    return j.agg(F.count_if(F.col("ib").isNull()).alias("only_left"), F.count_if(F.col("ia").isNull()).alias("only_right"))


def run_document(profiles: DataFrame, seeds: DataFrame, run_id: str, axis: str, k: int) -> DataFrame:
    """One nested row of aggregates alone: profiles, seeds renamed ``candidate-i`` in stated order, member total."""
    p = profiles.agg(F.array_sort(F.collect_list(F.struct("label", "n", "percent", "mean"))).alias("profiles"), F.sum("n").alias("n_members"))
    s = seeds.agg(F.array_sort(F.collect_list(F.struct("place", "gamma"))).alias("s"))
    named = F.transform("s", lambda x: F.struct(F.concat(F.lit("candidate-"), x["place"]).alias("name"), x["gamma"].alias("gamma")))
    return p.crossJoin(s).select(F.lit(run_id).alias("run_id"), F.lit(axis).alias("axis"), F.lit(k).alias("k"), "n_members", "profiles", named.alias("seeds"))  # one row each


def trend_document(profiles: DataFrame, votes: DataFrame, cohort: DataFrame, metrics: DataFrame, run_id: str, k: int, seed: int) -> DataFrame:
    """Run document of the trend axis, aggregates alone, in one nested row: size of the cohort, votes, initialisation, metrics, profiles.

    ``profiles``: ``ordered_cluster, n, percent, centre, mean, median`` and medians of support; ``votes``: ``k, votes``; ``cohort``: one
    row an observation with ``entity``; ``metrics``: one row.  A cluster's medians become its map of means.
    """
    rest = [c for c in profiles.columns if c not in ("ordered_cluster", "n", "percent")]
    as_map = lambda m: F.map_from_arrays(F.array(*[F.lit(c) for c in rest]), F.array(*[m[c] for c in rest]))
    p = profiles.agg(F.sort_array(F.collect_list(F.struct("ordered_cluster", "n", "percent", F.struct(*[F.col(c).cast("double").alias(c) for c in rest]).alias("m")))).alias("profiles"), F.sum("n").alias("n_members"))
    p = p.withColumn("profiles", F.transform("profiles", lambda x: F.struct(x["ordered_cluster"].alias("ordered_cluster"), x["n"].alias("n"), x["percent"].alias("percent"), as_map(x["m"]).alias("variable_means"))))
    v = votes.agg(F.array_sort(F.collect_list(F.struct("k", "votes"))).alias("index_votes"))
    c = cohort.agg(F.count_distinct("entity").alias("participants"), F.count(F.lit(1)).alias("observations"))
    m = metrics.select(F.struct("silhouette", "davies_bouldin", "calinski_harabasz").alias("metrics"))
    one = p.crossJoin(v).crossJoin(c).crossJoin(m)  # one row each
    return one.select(F.lit(run_id).alias("run_id"), F.lit("B").alias("axis"), F.lit(k).alias("k"), F.col("participants").alias("initial_sample_size"), "n_members", "participants", "observations", "index_votes", F.struct(F.lit("fixed_seed_random").alias("method"), F.lit(seed).alias("random_seed"), F.lit(1).alias("n_init")).alias("initialization"), "metrics", "profiles")


def trend_document_rules(doc: DataFrame, candidates: list[int]) -> DataFrame:
    """k among the candidates and voted on, as many profiles as k, members equal to participants, retained at most initial, at
    least three observations each, profiles in order without gaps, and no identifier among any names, maps included."""
    fields = {n.lower() for n in _names(doc.schema)}
    maps = F.flatten(F.transform("profiles", lambda p: F.map_keys(p["variable_means"])))
    clean = ~F.exists(maps, lambda n: F.lower(n).isin(IDENTIFIERS))
    return checks(doc, {"k_in_candidates": F.col("k").isin(candidates), "k_was_voted_on": F.exists("index_votes", lambda v: v["k"] == F.col("k")), "profiles_equal_k": F.size("profiles") == F.col("k"), "members_equal_participants": F.col("n_members") == F.col("participants"),
                        "retained_at_most_initial": F.col("n_members") <= F.col("initial_sample_size"), "enough_observations": F.col("observations") >= 3 * F.col("participants"), "profiles_in_order": F.transform("profiles", lambda p: p["ordered_cluster"].cast("int")) == F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("profiles"))),
                        "no_identifiers": clean & F.lit(not fields & set(IDENTIFIERS))})


def _names(kind) -> list[str]:
    """Names of all fields of a type, at any depth."""
    if hasattr(kind, "fields"):
        return [n for f in kind.fields for n in (f.name, *_names(f.dataType))]
    inner = getattr(kind, "elementType", None) or getattr(kind, "valueType", None)
    return _names(inner) if inner is not None else []


def document_rules(doc: DataFrame, candidates: list[int]) -> DataFrame:
    keys = set(doc.select("profiles.*").columns) if "struct" == dict(doc.dtypes)["profiles"][:6] else {f.name for f in doc.schema["profiles"].dataType.elementType.fields}
    return checks(doc, {"k_in_candidates": F.col("k").isin(candidates), "profiles_equal_k": F.size("profiles") == F.col("k"), "members_add_up": F.aggregate("profiles", F.lit(0).cast("long"), lambda a, p: a + p["n"]) == F.col("n_members"),
                        "no_identifiers": F.lit(not ({x.lower() for x in keys} & set(IDENTIFIERS)))})


def expectations(doc: DataFrame, expected: dict[str, object]) -> DataFrame:
    return checks(doc, {f"expected_{k}": F.col(k) == F.lit(v) for k, v in expected.items()})


def dashboard_metrics(doc: DataFrame) -> DataFrame:
    return doc.select("run_id", F.explode("profiles").alias("p")).select("run_id", F.concat(F.lit("cluster-"), "p.label").alias("name"), F.col("p.percent").alias("value"))


def variable_means(df: DataFrame, label: str, variables: list[str]) -> DataFrame:
    """Mean of each variable as a map, per cluster."""
    g = df.groupBy(label).agg(*[F.round(F.avg(v), 6).alias(v) for v in variables])
    return g.select(label, F.map_from_arrays(F.array(*[F.lit(v) for v in variables]), F.array(*variables)).alias("variable_means"))


def required_hashes(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected ``file, sha256`` that are absent or differ."""
    return expected.join(files.select("file", F.col("sha256").alias("found")), "file", "left").filter(~F.coalesce(F.col("found") == F.col("sha256"), F.lit(False))).select("file", "sha256", "found")
