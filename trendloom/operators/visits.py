"""Visit codes: ordered classifiers, dictionary lookups, order contradictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import blank, classify, date_of, normal_name, number, strip
from ..functions.guards import join_many_to_one
from .audit import ID_NAMES, VISIT_NAMES


def visit_class(code: str, code2: str) -> Column:
    """Study-entry classes, first hit wins; other codes have none."""
    a, b = strip(code), strip(code2)
    return classify([
        ((a == "f") | (b == "f"), "screen_failure"), (a.isin("init", "v06", "4_init"), "rollover_or_phase_initial"), ((b == "sc") | a.isin("sc", "v01", "4_sc"), "screening"),
        (a == "t_bl", "phase_specific_baseline"), ((b == "bl") | a.isin("bl", "v03", "4_bl"), "literal_or_translated_baseline"), (a.endswith("_bl"), "phase_specific_or_unresolved")])


def visit_kind(code: str, code2: str) -> Column:
    """Four classes in another order; every code has one."""
    a, b = strip(code), strip(code2)
    return classify([
        (a.isin("sc", "v01", "4_sc") | (b == "sc"), "SCREENING"), (a.isin("bl", "v03", "4_bl", "t_bl") | (b == "bl"), "BASELINE"),
        (a.isin("init", "v06", "4_init"), "ROLLOVER_PHASE_ENTRY_NOT_ORIGINAL_BASELINE")], "SCHEDULED_FOLLOWUP_OR_OTHER")


def visit_semantics(df: DataFrame, phase: str, code: str, code2: str, fields: list[str]) -> DataFrame:
    """Per (phase, code, code2) of a known class and field: rows, non-blank, -4, -1."""
    aggs = [x for c in fields for x in (F.count_if(~blank(c)).alias(f"{c}|nonblank_count"), F.count_if(number(c) == -4).alias(f"{c}|minus4_count"), F.count_if(number(c) == -1).alias(f"{c}|minus1_count"))]
    g = df.groupBy(phase, code, code2).agg(F.count(F.lit(1)).alias("row_count"), *aggs).withColumn("category", visit_class(code, code2)).filter("category is not null")
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), *[F.col(f"`{c}|{k}`").alias(k) for k in ("nonblank_count", "minus4_count", "minus1_count")]) for c in fields]))
    return g.select(phase, code, code2, "category", "row_count", rows.alias("r")).select(phase, code, code2, "category", "row_count", "r.*")


def visit_distribution(df: DataFrame, roster: DataFrame, entity: str, cohort_phase: str, *keys) -> DataFrame:
    return df.join(roster.select(entity, cohort_phase), entity).groupBy(cohort_phase, *keys).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(entity).alias("n_entities"))


def lookup(df: DataFrame, dictionary: DataFrame, keys: list[str], value: str, default: str = "other", max_rows: int = 100_000) -> DataFrame:
    """Left join on a dictionary whose keys must not conflict; unknown keys get the default."""
    own = dictionary.groupBy(*keys).agg(F.min(value).alias(value), F.count_distinct(value).alias("_k"))
    bad = own.filter("_k > 1").limit(5).collect()
    if bad:
        raise ValueError(f"conflicting dictionary rows: {bad}")
    own = own.drop("_k")
    side = F.broadcast(own) if own.count() <= max_rows else own
    return df.join(side, keys, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def dictionary_rows(spec: DataFrame, observed: DataFrame) -> DataFrame:
    """Specification rows with the phases in which their field was seen, if any."""
    return spec.join(observed, "variable", "left").withColumn("field_present", F.col("phases").isNotNull())


def order_anomaly_rows(df: DataFrame, entity: str, month: str, date: str) -> DataFrame:
    """All rows of a contradiction: a smaller month with a later date, or a larger month with an earlier one."""
    w = Window.partitionBy(entity).orderBy(month)
    before, after = w.rangeBetween(Window.unboundedPreceding, -1), w.rangeBetween(1, Window.unboundedFollowing)
    seen = df.filter(F.col(month).isNotNull() & F.col(date).isNotNull()).withColumn("_a", F.max(date).over(before)).withColumn("_b", F.min(date).over(after))
    return seen.filter((F.col("_a") > F.col(date)) | (F.col("_b") < F.col(date))).drop("_a", "_b")


def order_anomalies(df: DataFrame, entity: str, month: str, date: str) -> DataFrame:
    """Later months whose first date precedes a date of an earlier month, with that month: running maximum, no self-join."""
    m = df.groupBy(entity, month).agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"))
    before = Window.partitionBy(entity).orderBy(month).rowsBetween(Window.unboundedPreceding, -1)
    m = m.withColumn("_top", F.max(F.struct(F.col("last_date"), (-F.col(month)).alias("m"))).over(before))
    return m.filter(F.col("first_date") < F.col("_top.last_date")).select(entity, month, "first_date", F.col("_top.last_date").alias("earlier_max"), (-F.col("_top.m")).alias("earlier_month"))


def sequence_checks(df: DataFrame, entity: str, date: str, number_: str, elapsed: str) -> DataFrame:
    """Counts of rows out of date order, misnumbered, or not starting at 0."""
    w = Window.partitionBy(entity).orderBy(number_)
    t = df.withColumn("_d", F.lag(date).over(w)).withColumn("_n", F.row_number().over(w))
    return t.agg(F.count_if(F.col(date) < F.col("_d")).alias("n_decreasing"), F.count_if(F.col("_n") != F.col(number_)).alias("n_misnumbered"), F.count_if((F.col("_n") == 1) & (F.col(elapsed) != 0)).alias("n_first_not_zero"))


def tagged_union(frames: dict[str, DataFrame], tag: str = "file") -> DataFrame:
    """All tables below each other with the name of their file; columns that a table lacks are null."""
    named = [df.withColumn(tag, F.lit(name)) for name, df in frames.items()]
    out = named[0]
    for df in named[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def recommendations(rows: DataFrame, rules: DataFrame, documents: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Visit rows (``field, category``) with the documented definition of the class and what it means for the field.

    ``rules``: ``category, field_kind, recommendation`` (a null kind holds for every field, and goes before a kind's own rule);
    ``documents``: ``category, definition, source``; both dictionaries, whose keys must be unique and whose size is checked.
    Rows have ``field_kind``; without a rule the answer is UNRESOLVED.
    """
    for name, d in (("rules", rules), ("documents", documents)):
        if d.count() > max_rows:
            raise ValueError(f"{name}: more than {max_rows} rows")
    any_kind = rules.filter("field_kind is null").select("category", F.col("recommendation").alias("_any"))
    own = rules.filter("field_kind is not null").select("category", "field_kind", F.col("recommendation").alias("_own"))
    out = join_many_to_one(rows, any_kind, ["category"], "left")
    out = join_many_to_one(out, own, ["category", "field_kind"], "left")
    out = join_many_to_one(out, documents, ["category"], "left")
    return out.withColumn("recommendation", F.coalesce("_any", "_own", F.lit("UNRESOLVED"))).drop("_any", "_own")


def ordering_label(field: Column, outcomes: list[str]) -> Column:
    """Whether a field, by its name, can order an entity's records."""
    n = normal_name(field)
    return classify([(n.isin(outcomes), "OUTCOME_ONLY"), (n.isin(ID_NAMES), "IDENTIFIER_ONLY"), (n.isin(VISIT_NAMES), "WITH_VISIT_CODE_RULES"), (n == "VISDATE", "DATE_CANDIDATE")], "LIKELY_METADATA")


def ordering_fields(df: DataFrame, columns: list[str], outcomes: list[str]) -> DataFrame:
    """Per column: rows, non-blank cells, cells that parse as dates, and the label."""
    wide = df.agg(*[F.struct(F.lit(c).alias("field"), F.count(F.lit(1)).alias("n_rows"), F.count_if(~blank(c)).alias("n_nonblank"), F.count(date_of(c)).alias("n_dates")).alias(f"s{i}") for i, c in enumerate(columns)])
    rows = wide.select(F.explode(F.array(*[f"s{i}" for i in range(len(columns))])).alias("s")).select("s.*")
    return rows.withColumn("label", ordering_label(F.col("field"), outcomes))
