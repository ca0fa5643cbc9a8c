"""Dated cohorts, per-entity trends, their reports, scenario comparison."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.cells import classify, month_number, number, strip
from ..functions.guards import join_many_to_one, none_of
from ..functions.tails import student_t
from .audit import joined
from .ranks import quantiles

# Bands of support and of follow-up.
SUPPORT_BANDS = [("exactly_3", 3, 3), ("exactly_4", 4, 4), ("exactly_5", 5, 5), ("at_least_6", 6, None)]
YEAR_BANDS = [("under_1", 0, 1), ("1_to_2", 1, 2), ("2_to_4", 2, 4), ("at_least_4", 4, None)]


def filtering_flow(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Each row is tagged with the first rule that removes it; rows left after every rule, from one aggregation."""
    tag = classify([(~F.coalesce(keep, F.lit(False)), i) for i, (_, keep) in enumerate(rules)], len(rules))
    removed = df.groupBy(tag.alias("step")).agg(F.count(F.lit(1)).alias("n"))
    names = F.array(*[F.lit(name) for name, _ in rules])
    steps = removed.groupBy().pivot("step", list(range(len(rules) + 1))).agg(F.first("n")).select(F.array(*[F.coalesce(F.col(f"`{i}`"), F.lit(0)) for i in range(len(rules) + 1)]).alias("r"))
    rows = F.explode(F.sequence(F.lit(0), F.lit(len(rules) - 1))).alias("i")
    left = F.aggregate(F.slice("r", F.col("i") + 2, F.lit(len(rules) + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    return steps.select("r", rows).select(F.get(names, F.col("i")).alias("rule"), F.get("r", F.col("i")).alias("n_removed"), left.alias("n_left"))


def without_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose compound key is not listed."""
    return df.join(keys.select(*on).distinct(), on, "left_anti")


def same_day(df: DataFrame, entity: str, date: str, value: str) -> DataFrame:
    """Class of each (entity, date) of several rows: conflicting, harmless or incomplete."""
    g = df.groupBy(entity, date).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(value).alias("k"), F.count(value).alias("n_valid")).filter("n_rows > 1")
    return g.select(entity, date, "n_rows", F.when(F.col("k") > 1, "conflicting").when(F.col("n_valid") < F.col("n_rows"), "incomplete").otherwise("harmless").alias("class"))


def conflict_outcome(df: DataFrame, entity: str, date: str, conflicts: DataFrame, least_dates: int = 3) -> DataFrame:
    """Per entity with conflicting days: rows removed, dates left, still eligible."""
    bad = conflicts.select(entity, date).distinct().withColumn("_bad", F.lit(True))
    marked = df.join(bad, [entity, date], "left")
    g = marked.groupBy(entity).agg(F.count("_bad").alias("rows_removed"), F.count_distinct(F.when(F.col("_bad").isNull(), F.col(date))).alias("dates_left")).filter("rows_removed > 0")
    return g.withColumn("eligible", F.col("dates_left") >= least_dates)


def cohort(df: DataFrame, entity: str, date: str, row: str, least_dates: int = 3) -> DataFrame:
    """Rows of entities with enough distinct dates, with number and elapsed time since the first."""
    enough = df.groupBy(entity).agg(F.count_distinct(date).alias("_d"), F.min(date).alias("first_date")).filter(F.col("_d") >= least_dates).drop("_d")
    days = F.date_diff(F.col(date), F.col("first_date"))
    order = Window.partitionBy(entity).orderBy(date, row)
    return df.join(enough, entity).withColumn("observation_number", F.row_number().over(order)).withColumn("elapsed_days", days).withColumn("elapsed_years", F.bround(days / 365.25, 10))


def elapsed_error(df: DataFrame, days: str, years: str) -> DataFrame:
    return df.agg((F.max(F.abs(F.col(years) - F.col(days) / 365.25)) <= 5.1e-11).alias("consistent"))


@F.pandas_udf(DoubleType())
def _t_quantile(n: pd.Series, p: pd.Series) -> pd.Series:
    """Student's t for n - 2 degrees of freedom: once for each count in a batch."""
    table = {c: student_t(float(p.iloc[0]), c - 2) for c in n.unique() if c > 2}
    return n.map(table).astype("float64")


def slopes(df: DataFrame, entity: str, x: str, y: str, date: str | None = None, interval: float = 0.975) -> DataFrame:
    """Least-squares line per entity with interval and a failure reason, residuals summed about the fitted line.

    Means, products and residuals of an entity are windows and one grouping over the same partitioning: one shuffle.
    Entities without spread in x or in y keep their row, with the reason and null figures; ``failures`` lists them,
    ``slopes_or_stop`` fails.
    """
    own = Window.partitionBy(entity)
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    rows = rows.withColumn("_dx", F.col(x) - F.avg(x).over(own)).withColumn("_dy", F.col(y) - F.avg(y).over(own))
    rows = rows.withColumn("_sxx", F.sum(F.col("_dx") * F.col("_dx")).over(own)).withColumn("_sxy", F.sum(F.col("_dx") * F.col("_dy")).over(own))
    rows = rows.withColumn("_slope", F.when(F.col("_sxx") > 0, F.col("_sxy") / F.col("_sxx")))
    r = F.col("_dy") - F.col("_slope") * F.col("_dx")
    dates = [] if date is None else [F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.date_diff(F.max(date), F.min(date)).alias("followup_days")]
    g = rows.groupBy(entity).agg(F.count(F.lit(1)).alias("n_observations"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"), F.max("_sxx").alias("_sxx"), F.sum(F.col("_dy") * F.col("_dy")).alias("_syy"), F.max("_slope").alias("slope"), F.sum(r * r).alias("_sse"), F.min(y).alias("_lo"), F.max(y).alias("_hi"), F.min(x).alias("_x0"), F.max(x).alias("_x1"), *dates)
    flat_x, flat_y = F.col("_x0") == F.col("_x1"), F.col("_lo") == F.col("_hi")
    fine = ~flat_x & ~flat_y
    se = F.when(fine & (F.col("n_observations") > 2), F.sqrt(F.col("_sse") / (F.col("n_observations") - 2) / F.col("_sxx")))
    margin = se * _t_quantile("n_observations", F.lit(interval))
    out = lambda c, name: F.round(F.when(fine, c), 6).alias(name)
    reason = F.when(flat_x, "x has zero variance").when(flat_y, "y has zero variance")
    more = [] if date is None else ["first_date", "last_date", "followup_days"]
    return g.select(entity, "n_observations", *more, out(F.col("slope"), "slope"), out(F.col("_my") - F.col("slope") * F.col("_mx"), "intercept"), out(1 - F.col("_sse") / F.col("_syy"), "r_squared"), out(F.sqrt(F.col("_sse") / F.col("n_observations")), "rmse"),
                    out(se, "se"), out(F.col("slope") - margin, "ci_low"), out(F.col("slope") + margin, "ci_high"), reason.alias("failure"))


def failures(fitted: DataFrame, entity: str) -> DataFrame:
    return fitted.filter("failure is not null").select(entity, "failure")


def slopes_or_stop(df: DataFrame, entity: str, x: str, y: str, date: str | None = None) -> DataFrame:
    """The lines of all entities; one that cannot be fitted fails the job, with their number and five examples."""
    fitted = slopes(df, entity, x, y, date)
    return none_of(fitted, F.col("failure").isNotNull(), "lines that cannot be fitted", [entity, "failure"]).drop("failure")


def longitudinal_cohort(records: DataFrame, roster: DataFrame, ids: list[str], phase: str, allowed: list[str], date: str, value: str, row: str, codes: list[str], conflicts: DataFrame, later: list[str], least_dates: int = 3) -> DataFrame:
    """Observation rows of a cohort under fixed rules, all in one plan.

    Records meet the roster (``ids`` and ``entry_phase``, unique keys) on all ids; kept are rows of allowed phases with a
    numeric value and a valid date whose (first id, date) is no listed conflict.  Any other two rows of one entity and
    date fail the job, with 20 examples.  Entities need ``least_dates`` dates.  Added: number in
    order, elapsed days and years, the value as it was written, and flags: row in a contradiction of month codes and
    dates (by any of ``codes``, among rows of allowed phases), entity with such a row, and record of a later phase.
    """
    entity = ids[0]
    matched = join_many_to_one(records, roster.select(*ids, F.col("entry_phase").alias("study_entry_phase")), ids)
    allowed_rows = matched.filter(F.col(phase).isin(allowed)).withColumn("_number", number(value)).withColumn("_date", F.col(date))
    marked = allowed_rows
    for i, code in enumerate(codes):
        marked = marked.withColumn(f"_m{i}", month_number(code)).withColumn(f"_a{i}", contradicted(entity, f"_m{i}", "_date"))
    anomaly = F.coalesce(reduce(lambda a, b: a | b, [F.coalesce(F.col(f"_a{i}"), F.lit(False)) for i in range(len(codes))]), F.lit(False))
    marked = marked.withColumn("_anomaly", anomaly).withColumn("_own", F.max(F.col("_anomaly").cast("int")).over(Window.partitionBy(entity)))
    dated = marked.filter("_number is not null and _date is not null")
    usable = without_keys(dated, conflicts.select(F.col(entity), F.col(date).alias("_date")), [entity, "_date"])
    twice = F.count(F.lit(1)).over(Window.partitionBy(entity, "_date"))
    per_day = usable.withColumn("_twice", twice)
    kept = none_of(per_day, F.col("_twice") > 1, "rows of one entity and date beyond the known conflicts", [entity, "_date", row], 20)
    kept = kept.withColumn("_dates", F.count(F.lit(1)).over(Window.partitionBy(entity))).filter(F.col("_dates") >= least_dates)  # dates are unique here
    order = Window.partitionBy(entity).orderBy("_date", row)
    days = F.date_diff("_date", F.min("_date").over(Window.partitionBy(entity)))
    return kept.select(*ids, "study_entry_phase", F.col(phase).alias("record_phase"), *codes, F.col("_date").alias("date"), strip(value).alias("value"), row, F.row_number().over(order).alias("observation_number"), days.alias("elapsed_days"), F.bround(days / 365.25, 10).alias("elapsed_years"),
                       F.col("_anomaly").cast("int").alias("visit_code_date_anomaly_flag"), F.col("_own").alias("participant_anomaly_flag"), F.col(phase).isin(later).cast("int").alias("later_phase_flag"))


def contradicted(entity: str, month: str, date: str) -> Column:
    """Whether another row of the entity has a smaller month and a later date, or a greater month and an earlier date."""
    before = Window.partitionBy(entity, F.col(month).isNotNull() & F.col(date).isNotNull()).orderBy(month).rangeBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(entity, F.col(month).isNotNull() & F.col(date).isNotNull()).orderBy(month).rangeBetween(1, Window.unboundedFollowing)
    both = F.col(month).isNotNull() & F.col(date).isNotNull()
    return F.when(both, (F.coalesce(F.max(date).over(before) > F.col(date), F.lit(False))) | F.coalesce(F.min(date).over(after) < F.col(date), F.lit(False)))


def slope_check(df: DataFrame, entity: str, x: str, y: str) -> DataFrame:
    """Independent slope of every entity: covariance over variance."""
    return df.groupBy(entity).agg(F.round(F.covar_samp(x, y) / F.var_samp(x), 6).alias("slope"))


def bands(df: DataFrame, by: str, value: str, limits: list[tuple], whole: bool) -> DataFrame:
    """Count, mean, median and share of positive values per band; ``whole``: bands of integers, both ends in."""
    v = F.col(by)
    inside = lambda lo, hi: (v >= lo) if hi is None else v.between(lo, hi) if whole else (v >= lo) & (v < hi)
    band = classify([(inside(lo, hi), name) for name, lo, hi in limits])
    own = df.withColumn("band", band).filter("band is not null")
    g = own.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.avg((F.col(value) > 0).cast("int")) * 100, 6).alias("pct_positive"))
    # The middle of two values of six digits often ends in a half digit: it is rounded as a product, not by its decimal text.
    median = F.round(F.col("q0") * 1e6) / 1e6
    return joined(g, quantiles(own, value, [0.5], ["band"]), ["band"]).select("band", "n", "mean", median.alias("median"), "pct_positive")


def extremes(df: DataFrame, value: str, ids: str, n: int = 10) -> DataFrame:
    """The n smallest and n largest rows, id tie-break."""
    low = df.orderBy(F.asc(value), ids).limit(n).withColumn("side", F.lit("lowest"))
    return low.union(df.orderBy(F.desc(value), ids).limit(n).withColumn("side", F.lit("highest")))


def trajectories(df: DataFrame, chosen: DataFrame, entity: str, *fields: str) -> DataFrame:
    """Chosen entities with all their observations in order."""
    own = df.join(F.broadcast(chosen.select(entity)), entity, "left_semi")  # as many rows as a report shows
    return own.groupBy(entity).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("trajectory"))


def scenario_compare(df: DataFrame, roster: DataFrame, entity: str, date: str, a: Column, b: Column, least_dates: int = 3) -> DataFrame:
    """The whole roster under two row filters: rows, dates, eligibility and spans gained from a to b, in one grouping."""
    span = lambda w: F.date_diff(F.max(F.when(w, F.col(date))), F.min(F.when(w, F.col(date))))
    per = df.groupBy(entity).agg(F.count_if(a).alias("ra"), F.count_if(b).alias("rb"), F.count_distinct(F.when(a, F.col(date))).alias("da"), F.count_distinct(F.when(b, F.col(date))).alias("db"), span(a).alias("sa"), span(b).alias("sb"))
    per = roster.select(entity).distinct().join(per, entity, "left").fillna(0, ["ra", "rb", "da", "db", "sa", "sb"])
    ok = lambda c: F.col(c) >= least_dates
    return per.agg(F.count(F.lit(1)).alias("n_roster"), F.sum("ra").alias("rows_a"), F.sum("rb").alias("rows_b"), F.count_if(F.col("rb") > F.col("ra")).alias("gained_rows"), F.count_if(F.col("db") > F.col("da")).alias("gained_dates"),
                   F.count_if(ok("da")).alias("eligible_a"), F.count_if(ok("db")).alias("eligible_b"), F.count_if(ok("db") & ~ok("da")).alias("newly_eligible"), F.count_if(F.col("sb") > F.col("sa")).alias("longer_span"))


def worst_fits(fitted: DataFrame, entity: str, n: int = 10) -> DataFrame:
    """The n rows of least R squared, id tie-break."""
    return fitted.filter("r_squared is not null").orderBy("r_squared", entity).limit(n)


def followup_spans(df: DataFrame, entity: str, date: str, short_days: int = 365) -> DataFrame:
    per = df.groupBy(entity).agg(F.date_diff(F.max(date), F.min(date)).alias("days"))
    g = per.agg(F.count_if(F.col("days") < short_days).alias("n_short"))
    q = quantiles(per, "days", [0.0, 0.25, 0.5, 0.75, 1.0])
    return joined(g, q, []).select("n_short", *[F.round(f"q{i}", 6).alias(f"{n}_days") for i, n in enumerate(("min", "q1", "median", "q3", "max"))], F.round(F.col("q2") / 365.25, 6).alias("median_years"))
