"""Audits of raw tables: blanks, sentinels, duplicates, missingness, value ranges.

Every count of cells comes from one wide aggregation a table (``count_if`` for
each column), whose few rows are then turned into long form.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import any_populated, blank, category_of, format_share, kind_of, missing_category, normal_name, number, parsed, strip
from .ranks import quantiles

REASONS = ["blank", "whitespace", "text_code", "sentinel"]
EXPOSURES = ["blank", "minus4", "minus1", "negative", "unusual"]
# Names that mark identifier, visit and date columns, and the order of preference.
ID_NAMES = ["RID", "PTID", "SUBJECT", "SUBJECT_ID", "SUBJECTID", "PARTICIPANT", "PARTICIPANT_ID", "PARTICIPANTID"]
VISIT_NAMES = ["VISCODE", "VISCODE2"]
DATE_NAMES = ["EXAMDATE", "VISDATE", "USERDATE", "USERDATE2", "UPDATE_STAMP"]
KEY_ORDER = {"participant": ["PTID", "RID"], "visit": ["VISCODE2", "VISCODE", "EXAMDATE"]}


def _long(wide: DataFrame, columns: list[str], fields: list[str], *keys: str) -> DataFrame:
    """Aggregates named ``{column}|{field}`` to one row a column."""
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), *[F.col(f"`{c}|{f}`").alias(f) for f in fields]) for c in columns]))
    return wide.select(*keys, rows.alias("_r")).select(*keys, "_r.*")


def unpivoted(df: DataFrame, columns: list[str], *keys: str) -> DataFrame:
    """Long form ``keys, variable, value``: one pass over the table for any number of columns."""
    return df.unpivot(list(keys), columns, "variable", "value")


def column_roles(df: DataFrame, column: str = "column_name") -> DataFrame:
    """Role flags of column names."""
    n = normal_name(column)
    return (df.withColumn("is_identifier", n.isin(ID_NAMES) | n.contains("PARTICIPANT_ID") | n.contains("SUBJECT_ID"))
            .withColumn("is_visit", n.isin(VISIT_NAMES) | n.contains("VISIT")).withColumn("is_date", n.isin(DATE_NAMES) | n.endswith("_DATE") | n.endswith("_STAMP")))


def preferred_column(columns: DataFrame, flag: str, kind: str) -> DataFrame:
    """The column of the earliest preferred name, else the first by position."""
    order = KEY_ORDER[kind]
    place = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in order]), normal_name("column_name")), F.lit(0))
    return columns.filter(flag).agg(F.min_by("column_name", F.struct(F.when(place > 0, place).otherwise(999), F.col("position"))).alias("column_name"))


def file_inventory(df: DataFrame, ids: list[str], visits: list[str]) -> DataFrame:
    values = [F.array_join(F.array_sort(F.collect_set(F.when(~blank(c), strip(c)))), "|").alias(f"values_{c}") for c in visits]
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"), *[F.count_distinct(F.when(~blank(c), strip(c))).alias(f"unique_{c}") for c in ids], *values)


def column_inventory(df: DataFrame, columns: list[str]) -> DataFrame:
    """Position, blanks and distinct non-blank stripped values of each column."""
    aggs = [x for c in columns for x in (F.count(F.lit(1)).alias(f"{c}|n_rows"), F.count_if(blank(c)).alias(f"{c}|n_blank"), F.lit(df.columns.index(c) + 1).alias(f"{c}|position"))]
    counts = _long(df.agg(*aggs), columns, ["position", "n_rows", "n_blank"])
    v = unpivoted(df, columns).withColumn("value", strip("value"))
    unique = v.groupBy("variable").agg(F.count_distinct(F.when(F.col("value") != "", F.col("value"))).alias("n_unique"))
    return counts.join(unique, "variable").withColumn("pct_blank", F.round(F.col("n_blank") * 100.0 / F.col("n_rows"), 6))


def missing_candidates(df: DataFrame, columns: list[str]) -> DataFrame:
    v = unpivoted(df, columns).withColumn("category", missing_category("value")).filter("category is not null")
    return v.groupBy("variable", "category", "value").agg(F.count(F.lit(1)).alias("n_rows"))


def sentinel_exposure(df: DataFrame, columns: list[str], where: Column | None = None) -> DataFrame:
    """Counts of sentinels, other negatives and unusual codes; ``where`` restricts them (baseline rows, say)."""
    held = F.lit(True) if where is None else where
    cells = parsed(df, columns, held.alias("_held"))
    kinds = cells.select(*[F.when(F.col("_held"), kind_of(F.col(f"`{c}|s`"), F.col(f"`{c}|n`"))).alias(c) for c in columns])
    aggs = [F.count_if(F.col(c) == k).alias(f"{c}|n_{k}") for c in columns for k in EXPOSURES]
    return _long(kinds.agg(*aggs), columns, [f"n_{k}" for k in EXPOSURES])


def candidate_mapping(df: DataFrame, columns: list[str]) -> DataFrame:
    """Non-blank and distinct counts, least and greatest number, largest without sentinels, sentinels seen, per column."""
    v = unpivoted(df, columns).withColumn("n", number("value"))
    return v.groupBy("variable").agg(
        F.count_if(~blank("value")).alias("n_nonblank"), F.count_distinct(F.when(~blank("value"), strip("value"))).alias("n_unique"), F.min("n").alias("min"), F.max("n").alias("max"),
        F.max(F.when(~F.col("n").isin(-4, -1), F.col("n"))).alias("max_no_sentinel"), F.bool_or(F.coalesce(F.col("n") == -4, F.lit(False))).alias("has_minus4"), F.bool_or(F.coalesce(F.col("n") == -1, F.lit(False))).alias("has_minus1"))


def missing_policy(df: DataFrame, columns: list[str]) -> DataFrame:
    """Observed count of each policy code (blank, -4, -1) per field; codes never seen stay, with 0."""
    fields = {"blank": lambda c: blank(c), "-4": lambda c: number(c) == -4, "-1": lambda c: number(c) == -1}
    wide = df.agg(*[F.count_if(f(c)).alias(f"{c}|{k}") for c in columns for k, f in fields.items()])
    long = _long(wide, columns, list(fields))
    return long.unpivot(["variable"], list(fields), "code", "observed_count").withColumn("code_observed", F.col("observed_count") > 0)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Complete and incomplete rows, groups, all occurrences, those beyond the first; keys are stripped."""
    own = df.select(*[strip(F.coalesce(F.col(k).cast("string"), F.lit(""))).alias(k) for k in keys])
    full = reduce(lambda a, b: a & b, [F.col(k) != "" for k in keys])
    groups = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("full", full)
    twice = F.col("full") & (F.col("n") > 1)
    return groups.agg(F.coalesce(F.sum(F.when(F.col("full"), F.col("n"))), F.lit(0)).alias("complete_rows"), F.coalesce(F.sum(F.when(~F.col("full"), F.col("n"))), F.lit(0)).alias("incomplete_rows"),
                      F.count_if(twice).alias("n_groups"), F.coalesce(F.sum(F.when(twice, F.col("n"))), F.lit(0)).alias("n_occurrences"), F.coalesce(F.sum(F.when(twice, F.col("n") - 1)), F.lit(0)).alias("n_beyond_first"))


def duplicate_examples(df: DataFrame, keys: list[str], order: list[str], n: int = 5) -> DataFrame:
    """The first rows of duplicated keys in a stated order, with the size of their group: an example report."""
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return df.withColumn("group_rows", size).filter("group_rows > 1").orderBy(*keys, *order).limit(n)


def duplicate_summary(df: DataFrame, keys: list[str], entity: str) -> DataFrame:
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return groups.agg(F.count(F.lit(1)).alias("n_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count_distinct(entity).alias("n_entities"))


def exact_duplicates(df: DataFrame) -> DataFrame:
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return groups.agg(F.count(F.lit(1)).alias("n_groups"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n_beyond_first"))


def missingness(df: DataFrame, columns: list[str], by: str, threshold: float = 20.0) -> DataFrame:
    """Valid and missing cells by group and overall (``level``); EXCLUDE only strictly above the threshold.

    A null group is a group of its own, told from the total by its level.
    """
    fields = ["n_rows", "n_valid", *[f"n_{r}" for r in REASONS]]
    reasons = parsed(df, columns, by).select(by, *[category_of(F.col(c), F.col(f"`{c}|s`"), F.col(f"`{c}|n`")).alias(c) for c in columns])
    aggs = [x for c in columns for x in (F.count(F.lit(1)).alias(f"{c}|n_rows"), F.count_if(F.col(c).isNull()).alias(f"{c}|n_valid"), *[F.count_if(F.col(c) == r).alias(f"{c}|n_{r}") for r in REASONS])]
    wide = reasons.groupingSets([[by], []], by).agg(F.grouping_id().alias("_g"), *aggs).withColumn("level", F.when(F.col("_g") == 0, "group").otherwise("total"))
    g = _long(wide, columns, fields, "level", by)
    pct = (F.col("n_rows") - F.col("n_valid")) * 100.0 / F.col("n_rows")
    return g.withColumn("pct_missing", F.round(pct, 6)).withColumn("decision", F.when(pct > threshold, "EXCLUDE").otherwise("RETAIN"))


def date_audit(df: DataFrame, dates: list[str], valid: Column, parse) -> DataFrame:
    """Per date column: non-missing, parseable, least, greatest, rows with a valid value but no date."""
    aggs = [x for c in dates for x in (F.count_if(~blank(c)).alias(f"{c}|n_nonblank"), F.count(parse(c)).alias(f"{c}|n_parsed"), F.min(parse(c)).alias(f"{c}|first"), F.max(parse(c)).alias(f"{c}|last"), F.count_if(valid & parse(c).isNull()).alias(f"{c}|n_valid_undated"))]
    return _long(df.agg(*aggs), dates, ["n_nonblank", "n_parsed", "first", "last", "n_valid_undated"])


def value_audit(df: DataFrame, value: str, low: float, high: float, dated: Column) -> DataFrame:
    n = number(value)
    return df.agg(F.count_if(blank(value)).alias("n_missing"), F.count(n).alias("n_numeric"), F.count_if(~blank(value) & n.isNull()).alias("n_invalid"), F.count_if(~n.between(low, high)).alias("n_out_of_range"),
                  F.count_if(n.isNotNull() & dated).alias("n_numeric_dated"), F.count_if(n.isNotNull() & ~dated).alias("n_numeric_undated"), F.count_if(n.isNull() & dated).alias("n_dated_without_value"))


def rows_and_entities(df: DataFrame, by: str, entity: str) -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(entity).alias("n_entities"))


def one_to_one(df: DataFrame, a: str, b: str) -> DataFrame:
    """How many values of either identifier go with several of the other."""
    side = lambda x, y: df.groupBy(x).agg(F.count_distinct(y).alias("n")).agg(F.count_if(F.col("n") > 1).alias(f"{x}_with_several_{y}"))
    return side(a, b).crossJoin(side(b, a))  # one row each


def visits_per_entity(df: DataFrame, entity: str, date: str) -> DataFrame:
    """Entities by number of distinct dates: 1, 2, 3, 4, at least 5."""
    per = df.groupBy(entity).agg(F.count_distinct(date).alias("d"))
    return per.groupBy(F.when(F.col("d") >= 5, "at_least_5").otherwise(F.concat(F.lit("exactly_"), F.col("d"))).alias("category")).agg(F.count(F.lit(1)).alias("n_entities"))


def value_histogram(df: DataFrame, value: str, *by: str) -> DataFrame:
    return df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))


def tie_summary(df: DataFrame, value: str) -> DataFrame:
    t = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    return t.agg((F.max("n") > 1).alias("any_tie"), F.count(F.lit(1)).alias("n_distinct"), F.count_if(F.col("n") > 1).alias("n_tied_groups"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n_tied_rows"), F.max("n").alias("largest"))


def sign_counts(df: DataFrame, value: str, below: float) -> DataFrame:
    v = F.col(value)
    return df.agg(F.count_if(v > 0).alias("n_positive"), F.count_if(v < 0).alias("n_negative"), F.count_if(v == 0).alias("n_zero"), F.count_if(v < below).alias("n_below"))


def observed_phases(df: DataFrame, columns: list[str], phase: str) -> DataFrame:
    """Phases in which a field has any non-blank value."""
    wide = df.groupBy(phase).agg(*[F.bool_or(~blank(c)).alias(c) for c in columns])
    return wide.unpivot([phase], columns, "variable", "seen").filter("seen").groupBy("variable").agg(F.array_join(F.array_sort(F.collect_set(phase)), "|").alias("phases"))


def describe(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Count, mean, deviation, range and exact quartiles by group; quartiles by counting, so that no list of values is kept."""
    d = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.when(F.count(value) == 1, 0.0).otherwise(F.stddev_samp(value)).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"))
    r = lambda c: F.round(c, 6)
    d = joined(d, quantiles(df, value, [0.25, 0.5, 0.75], by), by)
    return d.select(*by, "n", r("mean").alias("mean"), r("sd").alias("sd"), r("min").alias("min"), r("q0").alias("q1"), r("q1").alias("median"), r("q2").alias("q3"), r("max").alias("max"), r(F.col("q2") - F.col("q0")).alias("iqr"))


def joined(a: DataFrame, b: DataFrame, by) -> DataFrame:
    """Two tables of a row a group, null groups included (without groups: one row each)."""
    if not by:
        return a.crossJoin(F.broadcast(b))  # one row
    b = b.withColumnsRenamed({c: f"_by{i}" for i, c in enumerate(by)})
    return a.join(b, reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[f"_by{i}"]) for i, c in enumerate(by)]), "left").drop(*[f"_by{i}" for i in range(len(by))])


def percentile_ladder(df: DataFrame, value: str, percents=(0, 1, 5, 25, 50, 75, 95, 99, 100)) -> DataFrame:
    """Exact linear percentiles, one row each."""
    q = quantiles(df, value, [x / 100 for x in percents])
    rows = F.array(*[F.struct(F.lit(x).alias("percent"), F.round(f"q{i}", 6).alias("value")) for i, x in enumerate(percents)])
    return q.select(F.explode(rows).alias("r")).select("r.*")


def column_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """Column inventory with the type that all non-blank cells fit (empty, integer, number or text) and the role flags of the name."""
    cells = parsed(df, columns)
    kinds = cells.agg(*[x for c in columns for x in (F.count_if(F.col(f"`{c}|s`") != "").alias(f"{c}|n"), F.count_if((F.col(f"`{c}|s`") != "") & F.col(f"`{c}|n`").isNull()).alias(f"{c}|t"), F.count_if(F.col(f"`{c}|s`").rlike("[.eE]") & F.col(f"`{c}|n`").isNotNull()).alias(f"{c}|f"))])
    kinds = _long(kinds, columns, ["n", "t", "f"]).select("variable", F.when(F.col("n") == 0, "empty").when(F.col("t") > 0, "text").when(F.col("f") > 0, "number").otherwise("integer").alias("dtype"))
    return column_roles(column_inventory(df, columns).join(kinds, "variable"), "variable")


def visit_frequency(df: DataFrame, entity: str, date: str) -> DataFrame:
    """Full frequency: entities by number of rows and of distinct dates."""
    per = df.groupBy(entity).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(date).alias("n_dates"))
    return per.groupBy("n_dates").agg(F.count(F.lit(1)).alias("n_entities"), F.sum("n_rows").alias("n_rows"), F.min("n_rows").alias("least_rows"), F.max("n_rows").alias("most_rows"))


def format_shares(df: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Per column: non-blank values, the share that matches its pattern in full, and a masked example (digits as 9, letters as A)."""
    mask = lambda c: F.regexp_replace(F.regexp_replace(F.min(F.when(~blank(c), strip(c))), "[0-9]", "9"), "[A-Za-z]", "A")
    wide = df.agg(*[x for c, p in patterns.items() for x in (F.count_if(~blank(c)).alias(f"{c}|n_nonblank"), F.round(format_share(c, p), 6).alias(f"{c}|share"), mask(c).alias(f"{c}|example"))])
    return _long(wide, list(patterns), ["n_nonblank", "share", "example"])


def populated(df: DataFrame, columns: list[str], *by: str) -> DataFrame:
    """Rows with any of the columns filled, and with none."""
    return df.groupBy(*by).agg(F.count_if(any_populated(columns)).alias("n_any"), F.count_if(~any_populated(columns)).alias("n_none"))


def value_counts_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column, the counts of its values as one JSON object, values sorted."""
    g = unpivoted(df, columns).groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n")).filter("value is not null")
    entries = F.array_sort(F.collect_list(F.struct("value", "n")))
    return g.groupBy("variable").agg(F.to_json(F.map_from_entries(entries)).alias("counts"))
