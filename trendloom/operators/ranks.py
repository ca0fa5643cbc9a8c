"""Global ranks and neighbours of whole tables without one task for all rows.

Rows are range-partitioned by the order; each partition numbers its own rows, and
partition counts (one row a partition) give the offsets.  The partitioned rows are
written first, so that both passes see the same partitions.
"""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _held(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-ranks-", dir="/tmp")
    path = f"{folder}/ranks-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _dealt(df: DataFrame, order: list) -> DataFrame:
    return _held(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def _offsets(parts: DataFrame) -> dict:
    out, total = {}, 0
    for p, n in sorted(tuple(r) for r in parts.groupBy("_part").count().collect()):  # a row a partition
        out[p], total = total, total + n
    return out


def global_rank(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """Rank from 1 in a total order."""
    parts = _dealt(df, order)
    offsets = _offsets(parts)
    base = F.create_map(*[F.lit(x) for p, n in offsets.items() for x in (p, n)]) if offsets else F.lit(None).cast("map<int,bigint>")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn(name, (F.try_element_at(base, F.col("_part")) + own).cast("long")).drop("_part")


def positions(df: DataFrame, value: str, ids: str, tail: float = 0.01, n: int = 10) -> DataFrame:
    """Ascending rank, percentile, counts below and above, and tail flags (n lowest and highest, and by share)."""
    total = df.count()
    r = global_rank(df.select(ids, value), [F.col(value), F.col(ids)])
    edge = math.ceil(tail * total)
    return r.select(ids, value, "rank", F.round((F.col("rank") - 1) * 100.0 / F.greatest(F.lit(1), F.lit(total - 1)), 6).alias("percentile"), (F.col("rank") - 1).alias("n_before"), (F.lit(total) - F.col("rank")).alias("n_after"),
                    (F.col("rank") <= n).alias("lowest"), (F.col("rank") > total - n).alias("highest"), (F.col("rank") <= edge).alias("low_tail"), (F.col("rank") > total - edge).alias("high_tail"))


def adjacent_gaps(df: DataFrame, value: str, ids: str) -> DataFrame:
    """Gap of every row to the one before it in sorted order."""
    return _neighbours(df, value, ids).select(ids, value, "gap")


def _neighbours(df: DataFrame, value: str, ids: str) -> DataFrame:
    """``id, value, before, gap``: the value before as it stands, since value less gap would be rounded twice."""
    parts = _dealt(df.select(ids, value), [F.col(value), F.col(ids)])
    tops = sorted(tuple(r) for r in parts.groupBy("_part").agg(F.max(value)).collect())
    above = {p: tops[i - 1][1] for i, (p, _) in enumerate(tops) if i}
    last = F.create_map(*[F.lit(x) for kv in above.items() for x in kv]) if above else F.lit(None).cast("map<int,double>")
    before = F.coalesce(F.lag(value).over(Window.partitionBy("_part").orderBy(value, ids)), F.try_element_at(last, F.col("_part")))
    return parts.withColumn("before", before).withColumn("gap", F.col(value) - F.col("before")).filter("gap is not null").select(ids, value, "before", "gap")


def even_sample(df: DataFrame, order: list, m: int) -> DataFrame:
    """m rows evenly spaced along the order: places floor(i (n - 1) / (m - 1))."""
    n = df.count()
    places = sorted({i * (n - 1) // max(1, m - 1) + 1 for i in range(m)}) if n else []
    return global_rank(df, order).filter(F.col("rank").isin(places))


def average_ranks(df: DataFrame, value: str, by: str, descending: bool, tolerance: float = 1e-12, ties: str = "k") -> DataFrame:
    """Average ranks; a run of values each close to its first one counts as tied.  For the few rows of a metric table.

    Closeness is measured from the first value of the run, by relative and absolute tolerance.
    """
    w = Window.partitionBy(by).orderBy(F.desc(value) if descending else F.asc(value), ties)
    run = F.aggregate(F.collect_list(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.struct(F.lit(0).alias("g"), F.lit(None).cast("double").alias("first")), lambda acc, x: F.when(
        F.abs(x - acc["first"]) <= F.greatest(F.lit(tolerance) * F.greatest(F.abs(x), F.abs(acc["first"])), F.lit(tolerance)), acc).otherwise(F.struct((acc["g"] + 1).alias("g"), x.alias("first"))), lambda acc: acc["g"])
    return df.withColumn("_run", run).withColumn("_n", F.row_number().over(w)).withColumn("avg_rank", F.avg("_n").over(Window.partitionBy(by, "_run"))).drop("_run", "_n")


def quantiles(df: DataFrame, value: str, qs: list[float], by=(), accuracy: int = 10_000, discrete: bool = False) -> DataFrame:
    """``by.., q0, q1..``: exact linear quantiles of every group, all at once, in three scans and without any list of values.

    ``discrete``: in place of a linear quantile the least value with at least a share q of the group's rows up to it.

    A mergeable sketch brackets each rank to within a few parts in ``accuracy``; the next scan counts what lies below
    each bracket and the distinct values inside it, a few parts in ``accuracy`` of a group's rows; ranks then pick among those.
    The sketch's bound makes the bracket hold the rank, or miss it by one neighbour in a small group, which is counted too.
    Null values and NaN are left out.
    """
    by, k = list(by), len(qs)
    rows = df.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], F.col(value).cast("double").alias("_v")).filter("_v is not null and not isnan(_v)")
    keys = [f"_g{i}" for i in range(len(by))]
    near = 3 / accuracy
    marks = [x for q in qs for x in (max(0.0, q - near), min(1.0, q + near))]
    sketch = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", marks, accuracy).alias("_m"))

    def meet(a: DataFrame, b: DataFrame, *more: str) -> DataFrame:
        on = [*keys, *more]
        if not on:
            return a.crossJoin(F.broadcast(b))  # one row
        b = b.withColumnsRenamed({c: f"{c}_r" for c in on})
        return a.join(b, [F.col(c).eqNullSafe(F.col(f"{c}_r")) for c in on]).drop(*[f"{c}_r" for c in on])

    low, high = (lambda i: F.get("_m", F.lit(2 * i))), (lambda i: F.get("_m", F.lit(2 * i + 1)))
    seen = meet(rows, sketch)
    v = F.col("_v")
    counted = seen.groupBy(*keys).agg(F.first("_n").alias("_n"), *[x for i in range(k) for x in (F.count_if(v < low(i)).alias(f"_b{i}"), F.max(F.when(v < low(i), v)).alias(f"_p{i}"), F.min(F.when(v > high(i), v)).alias(f"_x{i}"))])
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q"), F.col(f"_b{i}").alias("below"), F.col(f"_p{i}").alias("before"), F.col(f"_x{i}").alias("after")) for i, q in enumerate(qs)])
    spot = F.greatest(F.ceil(F.col("_e.q") * F.col("_n")) - 1, F.lit(0)).cast("double") if discrete else F.col("_e.q") * (F.col("_n") - 1)
    ranks = counted.select(*keys, "_n", F.explode(each).alias("_e")).select(*keys, "_n", F.col("_e.i").alias("_i"), spot.alias("_spot"), F.col("_e.below").alias("_below"), F.col("_e.before").alias("_before"), F.col("_e.after").alias("_after"))
    inside = seen.select(*keys, "_v", F.explode(F.filter(F.array(*[F.struct(F.lit(i).alias("i"), v.between(low(i), high(i)).alias("in")) for i in range(k)]), lambda e: e["in"])).alias("_e"))
    held = inside.groupBy(*keys, F.col("_e.i").alias("_i"), "_v").agg(F.count(F.lit(1)).alias("_c"))
    to = F.sum("_c").over(Window.partitionBy(*keys, "_i").orderBy("_v"))
    picked = meet(held.withColumn("_to", to), ranks, "_i").withColumn("_to", F.col("_to") + F.col("_below"))
    at = lambda place: F.max(F.when((F.col("_to") - F.col("_c") <= place) & (place < F.col("_to")), v))
    floor, ceil = F.floor("_spot"), F.ceil("_spot")
    each = picked.groupBy(*keys, "_i").agg(at(floor).alias("_lo"), at(ceil).alias("_hi"), F.first("_before").alias("_before"), F.first("_after").alias("_after"), F.first("_spot").alias("_spot"))
    lo, hi = F.coalesce("_lo", "_before"), F.coalesce("_hi", "_after")
    each = each.withColumn("_q", lo + (hi - lo) * (F.col("_spot") - F.floor("_spot")))
    out = each.groupBy(*keys).agg(*[F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(f"q{i}") for i in range(k)])
    return out.withColumnsRenamed(dict(zip(keys, by)))


def exact_quantile(df: DataFrame, value: str, q: float) -> float | None:
    """Linear quantile of a huge column."""
    return quantiles(df, value, [q]).head()[0]


def gap_audit(df: DataFrame, value: str, ids: str, n: int = 10, digits: int | None = None) -> DataFrame:
    """The n largest gaps between neighbours in sorted order, with both values; ties go to the smaller value.

    ``digits``: values and gaps are rounded before they are ordered, so that gaps which differ only by how doubles are subtracted are ties.
    """
    rows = _neighbours(df, value, ids).select(ids, "before", F.col(value).alias("after"), "gap")
    if digits is not None:
        rows = rows.select(ids, *[(F.round(F.col(c) * 10.0**digits) / 10.0**digits).alias(c) for c in ("before", "after", "gap")])
    return rows.orderBy(F.desc("gap"), "after", ids).limit(n)
