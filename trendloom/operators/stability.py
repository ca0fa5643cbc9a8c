"""Stability of replicated partitions: pair tables of all runs at once, summaries, growth, repeat gates.

``runs`` has one row an id and run, with its ``label``.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import close_to
from .audit import joined
from .clusters import _ari, first_appearance
from .digests import sorted_digest
from .ranks import quantiles


def run_contingency(runs: DataFrame, ids: str, max_clusters: int = 2_000) -> DataFrame:
    """``run_a, run_b, la, lb, n`` for every pair of runs: one row an id with its clusters (as many as runs), then
    products of 0/1 matrices in the tasks, so that no pair of rows is ever formed.  The clusters of all runs are counted first and limited."""
    spark = runs.sparkSession
    names = runs.filter("label is not null").select("run", "label").distinct().orderBy("run", "label").limit(max_clusters + 1).collect()
    if len(names) > max_clusters:
        raise ValueError(f"more than {max_clusters} clusters in all runs")
    kinds = ", ".join(f"{c} {runs.schema[c].dataType.simpleString()}" for c in ("run", "label"))
    if not names:
        return spark.createDataFrame([], "run_a int, run_b int, la int, lb int, n long")
    code = spark.createDataFrame([(*r, i) for i, r in enumerate(names)], f"{kinds}, code int")
    wide = runs.join(F.broadcast(code), ["run", "label"]).groupBy(ids).agg(F.collect_list("code").alias("codes")).select("codes")
    of_run = pd.factorize(pd.Series([r[0] for r in names]))[0]  # in order, as the names are
    k = len(names)

    def run(batches):
        total = np.zeros((k, k))
        for batch in batches:
            codes = batch.column("codes")
            sizes, flat = codes.value_lengths().to_numpy(), codes.flatten().to_numpy()
            step, at = max(1, (1 << 22) // k), np.r_[0, np.cumsum(sizes)]
            for a in range(0, len(sizes), step):
                z = min(a + step, len(sizes))
                hot = np.zeros((z - a, k), np.float32)
                hot[np.repeat(np.arange(z - a), sizes[a:z]), flat[at[a] : at[z]]] = 1
                total += hot.T @ hot  # at most ``step`` rows: exact in single precision
        i, j = np.nonzero(total)
        keep = of_run[i] < of_run[j]
        yield pa.RecordBatch.from_arrays([pa.array(i[keep], pa.int32()), pa.array(j[keep], pa.int32()), pa.array(total[i, j][keep].astype(np.int64))], names=["i", "j", "n"])

    cells = wide.mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))
    a = code.select(F.col("code").alias("i"), F.col("run").alias("run_a"), F.col("label").alias("la"))
    b = code.select(F.col("code").alias("j"), F.col("run").alias("run_b"), F.col("label").alias("lb"))
    return cells.join(F.broadcast(a), "i").join(F.broadcast(b), "j").select("run_a", "run_b", "la", "lb", "n")


def pairwise_ari(runs: DataFrame, ids: str) -> DataFrame:
    """Adjusted Rand index of every pair of runs."""
    return _ari(run_contingency(runs, ids), ["run_a", "run_b"])


def summary(df: DataFrame, value: str) -> DataFrame:
    """``statistic, value``: mean, sample deviation, minimum, exact median, maximum."""
    g = df.agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("minimum"), F.max(value).alias("maximum"))
    return joined(g, quantiles(df, value, [0.5]).withColumnRenamed("q0", "median"), []).select(*[F.round(F.col(c).cast("double"), 6).alias(c) for c in ("mean", "sd", "minimum", "median", "maximum")]).unpivot([], ["mean", "sd", "minimum", "median", "maximum"], "statistic", "value")


def five_numbers(metrics: DataFrame, names: list[str]) -> DataFrame:
    """A row a metric of replicated runs: the five numbers."""
    long = metrics.unpivot([], names, "metric", "_v")
    g = long.groupBy("metric").agg(F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("sd"), F.min("_v").alias("minimum"), F.max("_v").alias("maximum"))
    g = joined(g, quantiles(long, "_v", [0.5], ["metric"]).withColumnRenamed("q0", "median"), ["metric"])
    return g.select("metric", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "minimum", "median", "maximum")])


def partition_digests(runs: DataFrame, ids: str, index: str) -> DataFrame:
    """``run, n_lines, sha256``: print of each run's partition, over sorted lines ``id|label`` with labels numbered by first appearance."""
    named = runs.join(first_appearance(runs, index), ["run", "label"])
    return sorted_digest(named, ["run"], F.concat_ws("|", F.col(ids).cast("string"), F.col("canonical").cast("string")))


def partition_table(digests: DataFrame, primary: str | None = None) -> DataFrame:
    """A row a partition, most frequent first: runs, share, seeds, whether it holds more than half, and whether it is the primary's."""
    g = digests.groupBy("sha256").agg(F.count(F.lit(1)).alias("n_runs"), F.array_join(F.transform(F.array_sort(F.collect_list("run")), lambda r: r.cast("string")), ",").alias("runs"))
    everything = Window.partitionBy(F.lit(0))  # a row a partition
    share = F.col("n_runs") * 100.0 / F.sum("n_runs").over(everything)
    place = F.row_number().over(everything.orderBy(F.desc("n_runs"), "sha256"))
    return g.select(place.alias("place"), "sha256", "n_runs", "runs", F.round(share, 6).alias("pct"), (share > 50).alias("dominates"), F.col("sha256").eqNullSafe(F.lit(primary)).alias("matches_primary"))


def cumulative(runs: DataFrame, ids: str, index: str, metrics: DataFrame, names: list[str], checkpoints=(10, 20, 30)) -> DataFrame:
    """As runs grow: per checkpoint, runs included, distinct partitions, mean pairwise index, and mean and deviation of each metric.

    Pairs and prints are made once for all runs; a checkpoint only chooses among them (runs are numbered from 0).
    """
    at = lambda df, last: df.withColumn("first_runs", F.explode(F.array(*[F.lit(c) for c in checkpoints]))).filter(F.col(last) < F.col("first_runs"))
    prints = at(partition_digests(runs, ids, index), "run").groupBy("first_runs").agg(F.count(F.lit(1)).alias("n_runs"), F.count_distinct("sha256").alias("n_partitions"))
    ari = at(pairwise_ari(runs, ids), "run_b").groupBy("first_runs").agg(F.round(F.avg("ari"), 6).alias("mean_ari"))
    m = at(metrics, "run").groupBy("first_runs").agg(*[x for n in names for x in (F.round(F.avg(n), 6).alias(f"{n}_mean"), F.round(F.coalesce(F.stddev_samp(n), F.lit(0.0)), 6).alias(f"{n}_sd"))])
    return prints.join(ari, "first_runs", "left").join(m, "first_runs", "left")


def table_gate(a: DataFrame, b: DataFrame, ids: list[str], exact: list[str] = (), close: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Repeat runs of a table: per field the rule, values compared, values that differ, largest difference, passed.

    ``exact`` fields must be equal (two nulls are); ``close`` fields lie within (relative, absolute) tolerance of
    the second table.  The row sets are a field of their own.
    """
    close = close or {}
    side = lambda df, p: df.select(*ids, *[F.col(c).alias(f"{p}_{c}") for c in [*exact, *close]], F.lit(1).alias(f"{p}_in"))
    j = side(a, "a").join(side(b, "b"), ids, "full")
    both = F.col("a_in").isNotNull() & F.col("b_in").isNotNull()
    fields = [F.struct(F.lit("rows").alias("field"), F.lit("same rows on both sides").alias("rule"), F.count(F.lit(1)).alias("n_compared"), F.count_if(~both).alias("n_different"), F.lit(None).cast("double").alias("largest"))]
    for c in exact:
        fields.append(F.struct(F.lit(c).alias("field"), F.lit("equal").alias("rule"), F.count_if(both).alias("n_compared"), F.count_if(both & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))).alias("n_different"), F.lit(None).cast("double").alias("largest")))
    for c, (rel, absolute) in close.items():
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        wrong = F.when(x.isNull() | y.isNull(), ~(x.isNull() & y.isNull())).otherwise(~close_to(x, y, rel, absolute))
        fields.append(F.struct(F.lit(c).alias("field"), F.lit(f"within {absolute:g} + {rel:g} of the second").alias("rule"), F.count_if(both).alias("n_compared"), F.count_if(both & wrong).alias("n_different"), F.max(F.abs(x - y)).cast("double").alias("largest")))
    return j.agg(F.array(*fields).alias("f")).select(F.explode("f").alias("f")).select("f.*", (F.col("f.n_different") == 0).alias("passed"))


def flattened(docs: DataFrame, ids: str, text: str) -> DataFrame:
    """JSON documents as rows ``id, path, kind, value``: every leaf, with its type, numbers as they were written."""

    def leaves(x, path=""):
        if isinstance(x, dict) and x:
            for k in x:
                yield from leaves(x[k], f"{path}.{k}" if path else k)
        elif isinstance(x, list) and x:
            for i, v in enumerate(x):
                yield from leaves(v, f"{path}[{i}]")
        else:
            kind = "boolean" if isinstance(x, bool) else "null" if x is None else "integer" if isinstance(x, Whole) else "real" if isinstance(x, Real) else "text" if isinstance(x, str) else "empty"
            yield path, kind, None if x is None else str(x).lower() if isinstance(x, bool) else "{}" if x == {} else "[]" if x == [] else str(x)

    class Whole(str):
        pass

    class Real(str):
        pass

    def run(batches):
        for batch in batches:
            rows = [(i, *leaf) for i, t in zip(batch["id"], batch["text"]) for leaf in leaves(json.loads(t, parse_int=Whole, parse_float=Real, parse_constant=Real))]
            yield pd.DataFrame(rows, columns=["id", "path", "kind", "value"])

    return docs.select(F.col(ids).cast("string").alias("id"), F.col(text).alias("text")).filter("text is not null").mapInPandas(run, "id string, path string, kind string, value string")


def document_gate(a: DataFrame, b: DataFrame, ids: str, text: str, tolerances: dict[str, float] | None = None, ignored: list[str] = ()) -> DataFrame:
    """Repeat runs of JSON documents: every field with its type, the rule that was applied, and whether it holds.

    Text, whole numbers, booleans and nulls must be equal, and so must reals, as numbers; a real whose last name has a
    tolerance may differ by that much; fields named in ``ignored`` (paths of files, say) are listed but always pass.  A field on one side only fails.
    """
    j = flattened(a, ids, text).withColumnsRenamed({"kind": "kind_a", "value": "a"}).join(flattened(b, ids, text).withColumnsRenamed({"kind": "kind_b", "value": "b"}), ["id", "path"], "full")
    name = F.regexp_extract("path", r"([^.\[\]]+)(\[\d+\])*$", 1)
    limit = F.coalesce(*[F.when(name == n, F.lit(float(t))) for n, t in (tolerances or {}).items()], F.lit(None).cast("double"))
    real = (F.col("kind_a") == "real") & F.col("kind_b").isin("real", "integer") | (F.col("kind_b") == "real") & F.col("kind_a").isin("real", "integer")
    numbers = F.coalesce(real, F.lit(False))
    gap = F.abs(F.col("a").try_cast("double") - F.col("b").try_cast("double"))
    rule = F.when(name.isin(*ignored) if ignored else F.lit(False), "ignored").when(F.col("kind_a").isNull() | F.col("kind_b").isNull(), "on one side only").when(numbers & limit.isNotNull(), F.concat(F.lit("real within "), limit.cast("string"))).when(numbers, "real equal").otherwise(F.concat(F.col("kind_a"), F.lit(" equal")))
    same = F.when(F.col("rule") == "ignored", True).when(F.col("rule") == "on one side only", False).when(numbers & limit.isNotNull(), gap <= limit).when(numbers, gap == 0).otherwise((F.col("kind_a") == F.col("kind_b")) & F.col("a").eqNullSafe(F.col("b")))
    return j.withColumn("rule", rule).select("id", "path", F.coalesce("kind_a", "kind_b").alias("kind"), "rule", "a", "b", F.when(numbers, gap).alias("difference"), F.coalesce(same, F.lit(False)).alias("same"))
