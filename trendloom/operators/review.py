"""Scope audits, collection checks, counterparts of undated rows, evidence on conflicting days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import blank, strip
from .resolve import reason_counts

# States of a cell and classes of a visit, with the short names of their counts.
STATES = {"VALID": "valid", "BLANK": "blank", "MINUS1": "minus1", "MINUS4": "minus4", "UNRESOLVED_DUPLICATE_QC": "unresolved"}


def scope_missingness(resolved: DataFrame, scope: str, inside: Column) -> DataFrame:
    """Missingness of each variable over the rows of a named scope alone."""
    return reason_counts(resolved.filter(inside), ["variable"]).withColumn("scope", F.lit(scope))


def exclusion_preview(audit: DataFrame, threshold: float = 20.0) -> DataFrame:
    """Rows of a scope audit whose variable would be left out; nothing is replaced."""
    return audit.filter(F.col("decision") == "EXCLUDE").select(
        "scope", "variable", "n_eligible", (F.col("n_eligible") - F.col("n_valid")).alias("n_missing"), "pct_missing", F.lit(threshold).alias("threshold"), "decision", F.lit(False).alias("replaced"))


def collection_qc(roster: DataFrame, records: DataFrame, entity: str, kinds: dict[str, str], texts: tuple[str, ...] = ()) -> DataFrame:
    """Why values are missing, by the phase of entry: one row of flags an entity, then conditional sums.

    ``roster``: entity (once each), ``cohort`` (its phase), ``value``.  ``records``: entity, ``phase``, ``category``,
    ``state``, ``number``, ``any_item`` and the columns ``texts``, of few values each.  ``kinds`` maps the roles
    screening, baseline, entry and followup to categories.  Reasons overlap; ``n_unresolved`` counts entities that
    none explains.  Entities outside the roster are not counted; a null entity or cohort has no record and no phase
    in common with anything.
    """
    rows = records.join(roster.select(entity, "cohort"), entity)
    same = F.coalesce(F.col("phase") == F.col("cohort"), F.lit(False))
    role = {r: same & (F.col("category") == c) for r, c in kinds.items()}
    valid, empty = F.col("state") == "VALID", F.col("state") == "BLANK"
    entry = F.col("category").isin(*[kinds[r] for r in ("screening", "baseline", "entry")])
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    flags = rows.groupBy(entity).agg(some(same).alias("in_phase"), *[some(c & valid).alias(f"valid_{r}") for r, c in role.items()], some(same & entry & empty & F.col("any_item")).alias("items_only"))
    whole = roster.select(entity, "cohort", F.col("value").isNull().alias("missing")).join(flags.withColumn("anywhere", F.lit(True)), entity, "left")
    names = ["anywhere", "in_phase", *[f"valid_{r}" for r in kinds], "items_only"]
    whole = whole.select("cohort", "missing", *[F.coalesce(n, F.lit(False)).alias(n) for n in names])
    moved = F.col("valid_screening") | F.col("valid_entry")
    explained = moved | F.col("valid_followup") | ~F.col("anywhere") | F.col("items_only")
    gone = {"missing": F.lit(True), "unavailable": ~moved, "wrong_visit": moved, "followup_only": F.col("valid_followup"), "total_not_filled": F.col("items_only"),
            "absent": ~F.col("anywhere"), "absent_in_phase": ~F.col("in_phase"), "unresolved": ~explained}
    people = whole.groupBy("cohort").agg(F.count(F.lit(1)).alias("n_eligible"), *[F.count_if(n).alias(f"n_{n}") for n in names[:-1]], *[F.count_if(F.col("missing") & c).alias(f"n_{n}") for n, c in gone.items()])
    counted = [F.count_if(where & c).alias(f"{name}_{n}") for name, where in (("base", F.coalesce(role["baseline"], F.lit(False))), ("rows", same)) for n, c in
               {"all": F.lit(True), **{short: F.col("state") == s for s, short in STATES.items()}, "zero": valid & (F.col("number") == 0), "positive": valid & (F.col("number") > 0), "blank_with_items": empty & F.col("any_item")}.items()]
    seen = [F.array_join(F.array_sort(F.collect_set(F.when(same & ~blank(t), strip(t)))), " | ").alias(f"{t}_seen") for t in texts]
    per_phase = rows.groupBy("cohort").agg(*counted, *seen)
    zero = [F.coalesce(c, F.lit(0)).alias(c) if not c.endswith("_seen") else F.coalesce(c, F.lit("")).alias(c) for c in per_phase.columns[1:]]
    return people.join(per_phase, "cohort", "left").select(*people.columns, *zero)


def counterparts(df: DataFrame, entity: str, row: str, date: str, codes: list[str], wanted: Column) -> DataFrame:
    """For every undated row that is ``wanted``: number, first and last date of dated rows of its entity and code.

    One summary of dated rows a code, so that no group is multiplied out; no date is carried over.
    Null and blank codes have no counterparts.
    """
    out = df.filter(F.col(date).isNull() & wanted).select(entity, row, *codes)
    for c in codes:
        key = F.when(~blank(c), F.col(c))
        dated = df.filter(F.col(date).isNotNull()).groupBy(entity, key.alias(c)).agg(F.count(F.lit(1)).alias(f"n_same_{c}"), F.min(date).alias(f"first_same_{c}"), F.max(date).alias(f"last_same_{c}"))
        out = out.join(dated, [entity, c], "left").withColumn(f"n_same_{c}", F.coalesce(f"n_same_{c}", F.lit(0)))
    return out


def counterpart_rows(df: DataFrame, entity: str, date: str, code: str, wanted: Column) -> DataFrame:
    """The dated rows that :func:`counterparts` counts for one code, once each."""
    asked = df.filter(F.col(date).isNull() & wanted & ~blank(code)).select(entity, code)
    return df.filter(F.col(date).isNotNull()).join(asked, [entity, code], "left_semi")


def component_differences(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """Columns in which the two rows of a key differ, as text, a row a column; keys of one or many rows give none.

    Rows of equal ``order`` are told apart by their text, null first.
    """
    place = F.struct(order, *[F.col(c).cast("string").alias(c) for c in columns])
    ends = [F.struct(F.lit(c).alias("component"), F.col("_a")[c].alias("first"), F.col("_b")[c].alias("second")) for c in columns]
    pair = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(place).alias("_a"), F.max(place).alias("_b")).filter("_n = 2").select(*keys, F.array(*ends).alias("_c"))
    kind = F.when(F.upper("component").contains("SCORE"), "score").otherwise("item")
    return pair.select(*keys, F.explode(F.filter("_c", lambda x: ~x["first"].eqNullSafe(x["second"]))).alias("_c")).select(*keys, "_c.*").withColumn("kind", kind)


def supersession_evidence(df: DataFrame, entity: str, date: str, value: str, record: str, same: list[str], blanks: list[str]) -> DataFrame:
    """Per conflicting day: are records distinct, stamps equal, correction flags blank; ``marked`` if a flag is set."""
    g = df.groupBy(entity, date).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(value).alias("n_values"), (F.count_distinct(record) == F.count(F.lit(1))).alias("distinct_records"),
        *[(F.count_distinct(c) == 1).alias(f"same_{c}") for c in same], *[F.bool_and(F.coalesce(blank(c), F.lit(True))).alias(f"blank_{c}") for c in blanks])
    return g.filter("n_values > 1").withColumn("marked", ~sum((F.col(f"blank_{c}").cast("int") for c in blanks[1:]), F.col(f"blank_{blanks[0]}").cast("int")).eqNullSafe(len(blanks)))
