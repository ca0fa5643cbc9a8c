"""Entity resolution: cells under a policy, one value an entity, entry phase, duplicate log, wide table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import blank, in_order, number, strip, unique_join
from ..functions.guards import guarded, message, unique

# Codes of reasons.
VALID, QC, MINUS1, MINUS4, BLANK = "VALID", "UNRESOLVED_DUPLICATE_QC", "MINUS1", "MINUS4", "BLANK"
UNAVAILABLE, FAILED = "UNAVAILABLE_PHASE_INSTRUMENT", "FAILED_DERIVATION"


def normal_cell(c, minus1=True, minus4=True) -> Column:
    """``struct(value, reason)``: sentinels count as missing only where the policy (a flag or a boolean column) says so."""
    v = number(c)
    one, four = (x if isinstance(x, Column) else F.lit(x) for x in (minus1, minus4))
    reason = F.when(blank(c), BLANK).when((v == -1) & one, MINUS1).when((v == -4) & four, MINUS4).when(v.isNull(), QC).otherwise(VALID)
    return F.struct(F.when(reason == VALID, v).alias("value"), reason.alias("reason"))


def with_policy(df: DataFrame, policy: DataFrame, keys: list[str]) -> DataFrame:
    """Flags ``minus1, minus4`` from a policy table ``keys, code, treat_as_missing``; small, as many rows as fields."""
    flags = policy.filter("treat_as_missing = 'YES'").groupBy(*keys).agg(F.bool_or(F.col("code") == "-1").alias("minus1"), F.bool_or(F.col("code") == "-4").alias("minus4"))
    out = df.join(flags, keys, "left")
    return out.withColumn("minus1", F.coalesce("minus1", F.lit(False))).withColumn("minus4", F.coalesce("minus4", F.lit(False)))


def absence(reasons: Column, documented: Column) -> Column:
    """Reason for absence from the set of row reasons, in fixed precedence."""
    has = lambda r: F.array_contains(reasons, r)
    return F.when(~documented, UNAVAILABLE).when(has(QC), QC).when(has(MINUS1), MINUS1).when(has(MINUS4), MINUS4).otherwise(BLANK)


def _resolved(df: DataFrame, keys: list[str], order: list[Column], documented: Column, source: str, vector: Column, result: Column, ok: Column, reasons: Column, derived) -> DataFrame:
    rows = df.select(*keys, F.struct(*order).alias("_o"), documented.alias("_doc"), F.col(source).alias("_src"), vector.alias("_v"), result.alias("_r"), ok.alias("_ok"), reasons.alias("_why"), (F.lit(derived) if isinstance(derived, bool) else derived).alias("_der"))
    # Distinct vectors are told by the least and the greatest, so that no list of them is kept.
    g = rows.groupBy(*keys).agg(
        F.count("_ok").alias("n_candidates"), F.count_if("_ok").alias("n_valid"), F.min(F.when(F.col("_ok"), F.col("_v"))).alias("_lo"), F.max(F.when(F.col("_ok"), F.col("_v"))).alias("_hi"),
        F.max(F.when(F.col("_ok"), F.col("_r"))).alias("_r"), F.min_by(F.when(F.col("_ok"), F.col("_src")), F.when(F.col("_ok"), F.col("_o"))).alias("_best"), F.min_by("_src", "_o").alias("_any"),
        F.array_distinct(F.flatten(F.collect_set("_why"))).alias("_why"), F.bool_and("_doc").alias("_doc"), F.bool_or("_der").alias("_der"))
    conflict = F.col("_lo") != F.col("_hi")
    single = F.col("n_valid") > 0
    none = F.when(F.col("_der"), FAILED).otherwise(absence(F.col("_why"), F.col("_doc")))
    reason = F.when(F.col("n_candidates") == 0, UNAVAILABLE).when(conflict, QC).when(single, F.lit("")).otherwise(none)
    pairs = (("CONFLICTING_COMPONENT_VECTORS", "CONFLICTING_VALUES"), ("IDENTICAL_COMPLETE_COMPONENTS", "IDENTICAL_VALID_VALUES"), ("UNIQUE_COMPLETE_COMPONENT_ROW", "UNIQUE_VALID_VALUE"), ("NO_COMPLETE_COMPONENT_ROW", "NO_VALID_VALUE"))
    word = lambda i, before="": F.when(F.col("_der"), before + pairs[i][0]).otherwise(before + pairs[i][1])
    status = F.when(F.col("n_candidates") < 2, F.lit(None)).when(conflict, word(0, "UNRESOLVED_")).when(F.col("n_valid") > 1, word(1, "RESOLVED_")).when(single, word(2, "RESOLVED_")).otherwise(word(3))
    return g.select(*keys, "n_candidates", "n_valid", F.when(single & ~conflict, F.col("_r")).alias("value"), reason.alias("reason"), F.when(conflict, F.lit(None)).when(single, F.col("_best")).otherwise(F.col("_any")).alias("source"), status.alias("resolution"))


def resolve_direct(df: DataFrame, keys: list[str], cell: Column, order: list[Column], source: str, documented: Column | None = None) -> DataFrame:
    """One value an entity: a conflict of distinct valid values is missing, without source; else the best valid row's."""
    doc = F.lit(True) if documented is None else documented
    return _resolved(df.withColumn("_c", cell), keys, order, doc, source, F.col("_c.value"), F.col("_c.value"), F.col("_c.reason") == VALID, F.array("_c.reason"), False)


def resolve_derived(df: DataFrame, keys: list[str], cells: list[Column], derive, order: list[Column], source: str) -> DataFrame:
    """Complete component vectors are compared, not results; none complete is a failed derivation."""
    df = df.withColumn("_c", F.array(*cells))
    parts = [F.get("_c", F.lit(i)) for i in range(len(cells))]
    ok = F.forall("_c", lambda x: x["reason"] == VALID)
    return _resolved(df, keys, order, F.lit(True), source, F.struct(*[p["value"].alias(f"v{i}") for i, p in enumerate(parts)]), derive(*[p["value"] for p in parts]), ok, F.transform("_c", lambda x: x["reason"]), True)


# What a resolved value carries along, in order.
PROVENANCE = ["SOURCE_FILE", "SOURCE_PHASE", "SOURCE_VISCODE", "SOURCE_VISCODE2", "SOURCE_DATE", "SOURCE_VISIT_CLASS", "MISSING_REASON"]


def candidate_rows(records: DataFrame, entities: DataFrame, spec: DataFrame, entity: str, fields: list[str], max_spec: int = 10_000) -> DataFrame:
    """Candidates of every (entity, variable): records of the variable's file, in the entity's entry phase, of one of its visit classes.

    ``records``: ``entity, file, phase, code, code2, date, visit_class, source_row`` and text fields; ``entities``: ``entity, entry_phase``;
    ``spec``: ``variable, file, classes (array), fields (array), mode`` (direct, sum or difference), whose size is checked before it is
    broadcast.  All variables in one equi-join; the cells are normalised on the way.
    """
    n = spec.count()
    if n > max_spec:
        raise ValueError(f"{n} variables; at most {max_spec} are broadcast")
    cells = F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*[F.col(f) for f in fields]))
    own = records.select(entity, "file", F.trim("phase").alias("phase"), "code", "code2", "date", "visit_class", "source_row", cells.alias("_cells"))
    own = own.join(entities.select(entity, F.col("entry_phase").alias("phase")), [entity, "phase"])
    wanted = spec.select("variable", "file", F.explode("classes").alias("visit_class"), "fields", "mode")
    met = own.join(F.broadcast(wanted), ["file", "visit_class"])
    return met.withColumn("cells", F.transform("fields", lambda f: normal_cell(F.element_at("_cells", f)))).drop("_cells")


def resolve_variables(candidates: DataFrame, entity: str) -> DataFrame:
    """``entity, variable, value, reason`` and the provenance of the row that was used, for all variables in one grouping.

    Direct values and component vectors follow the rules of ``resolve_direct`` and ``resolve_derived``; the best row is the
    earliest dated one, then that of the smallest source row."""
    derived = F.col("mode") != "direct"
    values = F.transform("cells", lambda c: c["value"])
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    result = F.when(F.col("mode") == "difference", F.get(values, F.lit(0)) - F.get(values, F.lit(1))).otherwise(total)
    ok = F.forall("cells", lambda c: c["reason"] == VALID)
    source = F.struct("file", "phase", F.trim("code").alias("code"), F.trim("code2").alias("code2"), "date", "visit_class", "source_row")
    rows = candidates.withColumn("_source", source)
    order = [F.col("date").isNull(), F.col("date"), F.col("source_row")]
    return _resolved(rows, [entity, "variable"], order, F.lit(True), "_source", values, result, ok, F.transform("cells", lambda c: c["reason"]), derived)


def provenance_table(resolved: DataFrame, entities: DataFrame, spec: DataFrame, entity: str) -> DataFrame:
    """One row an entity: each variable's value and its seven provenance columns; a value without source has empty ones."""
    names = [r[0] for r in spec.select("variable").orderBy("variable").collect()]  # the size was checked
    files = {r[0]: r[1] for r in spec.select("variable", "file").collect()}
    own = lambda v, c: F.max(F.when(F.col("variable") == v, c))
    text = lambda v, f: F.coalesce(own(v, F.col(f"source.{f}").cast("string")), F.lit("")).alias(f"{v}_{f}")
    parts = {"SOURCE_PHASE": "phase", "SOURCE_VISCODE": "code", "SOURCE_VISCODE2": "code2", "SOURCE_DATE": "date", "SOURCE_VISIT_CLASS": "visit_class"}
    columns = []
    for v in names:
        columns += [own(v, F.col("value")).alias(v), F.lit(files[v]).alias(f"{v}_SOURCE_FILE"), *[text(v, f).alias(f"{v}_{c}") for c, f in parts.items()], F.coalesce(own(v, F.col("reason")), F.lit(UNAVAILABLE)).alias(f"{v}_MISSING_REASON")]
    return entities.select(entity).join(resolved, entity, "left").groupBy(entity).agg(*columns)


def duplicate_log(resolved: DataFrame, variable: str) -> DataFrame:
    """Rows where several candidates met, and what was done."""
    action = F.when(F.col("resolution").startswith("RESOLVED_"), "USE_VALUE").when(F.col("resolution").startswith("UNRESOLVED_"), "SET_MISSING").otherwise(F.concat(F.lit("SET_MISSING_"), F.col("reason")))
    return resolved.filter("resolution is not null").withColumn("variable", F.lit(variable)).withColumn("action", action)


def duplicate_log_summary(log: DataFrame) -> DataFrame:
    return log.groupBy("variable", "resolution").agg(F.count(F.lit(1)).alias("n_entities"), F.sum("n_candidates").alias("n_candidate_rows"))


def entry_phase(df: DataFrame, entity: str, phase: str, date: str, ids: str, order: list[str]) -> DataFrame:
    """Earliest dated phase, the stated order breaks ties; five status labels; lexically first identifier with its status."""
    place = in_order(phase, order)
    per = df.groupBy(entity, phase).agg(F.min(date).alias("d"), F.count(F.lit(1)).alias("n"), F.min(F.when(~blank(ids), strip(ids))).alias("id_lo"), F.max(F.when(~blank(ids), strip(ids))).alias("id_hi"))
    per = per.withColumn("k", F.struct(F.col("d").isNull().alias("u"), F.col("d").alias("d"), place.alias("o"), F.col(phase).alias("p")))
    g = per.groupBy(entity).agg(F.min_by(F.struct(phase, "d", "n", "id_lo", "id_hi"), "k").alias("b"), F.count(F.lit(1)).alias("phases"), F.count("d").alias("dated"))
    status = (F.when((F.col("dated") == 0) & (F.col("phases") == 1), "SINGLE_UNDATED_PHASE").when(F.col("dated") == 0, "PHASE_ORDER_FALLBACK_ALL_DATES_MISSING")
              .when(F.col("dated") < F.col("phases"), "EARLIEST_DATED_PHASE_WITH_UNDATED_ALTERNATIVE").when(F.col("phases") == 1, "SINGLE_PHASE").otherwise("EARLIEST_DATED_BASELINE_PHASE"))
    id_status = F.when(F.col("b.id_lo").isNull(), "MISSING").when(F.col("b.id_lo") == F.col("b.id_hi"), "UNIQUE").otherwise("MULTIPLE_LEXICAL_FALLBACK")
    return g.select(entity, F.col(f"b.{phase}").alias("entry_phase"), F.col("b.d").alias("entry_date"), F.col("b.n").alias("evidence_rows"), "phases", status.alias("status"), F.coalesce("b.id_lo", F.lit("")).alias("chosen_id"), id_status.alias("id_status"))


def enrolment_evidence(df: DataFrame, entity: str, phase: str, date: str, file: str) -> DataFrame:
    return df.groupBy(entity, phase).agg(F.min(date).alias("first_date"), F.count(F.lit(1)).alias("n_rows"), unique_join(file).alias("files"))


def wide_table(resolved: DataFrame, keys: list[str], variables: list[str]) -> DataFrame:
    """``variable, value, reason, source`` rows to one row an entity with three columns a variable."""
    one = lambda v, c: F.max(F.when(F.col("variable") == v, F.col(c))).alias(v if c == "value" else f"{v}_{c}")
    return resolved.groupBy(*keys).agg(*[one(v, c) for v in variables for c in ("value", "reason", "source")])


def reason_counts(resolved: DataFrame, by: list[str], threshold: float = 20.0) -> DataFrame:
    """Missingness of resolved values: one count a reason; they must add up to the missing."""
    codes = {"n_unavailable": UNAVAILABLE, "n_qc": QC, "n_minus1": MINUS1, "n_minus4": MINUS4, "n_blank": BLANK, "n_failed": FAILED}
    g = resolved.groupBy(*by).agg(F.count(F.lit(1)).alias("n_eligible"), F.count("value").alias("n_valid"), *[F.count_if(F.col("value").isNull() & (F.col("reason") == r)).alias(c) for c, r in codes.items()])
    pct = (F.col("n_eligible") - F.col("n_valid")) * 100.0 / F.col("n_eligible")
    return g.withColumn("reconciles", sum(F.col(c) for c in codes) == F.col("n_eligible") - F.col("n_valid")).withColumn("pct_missing", F.round(pct, 6)).withColumn("decision", F.when(pct > threshold, "EXCLUDE").otherwise("RETAIN"))


def checked_table(table: DataFrame, eligible: DataFrame, entity: str, variables: list[str]) -> DataFrame:
    """The table itself, or a failed job: every variable a column, one row an entity, and exactly the eligible entities."""
    lost = [v for v in variables if v not in table.columns]
    if lost:
        raise ValueError(f"columns missing {lost}")
    own = lambda df, n: df.select(entity).distinct().withColumn(n, F.lit(1))
    other = own(table, "a").join(own(eligible, "b"), entity, "full").filter("a is null or b is null").select(entity, F.when(F.col("a").isNull(), "missing").otherwise("not eligible").alias("problem"))
    return guarded(table, unique(table, [entity]), message(other, "entities", [entity, "problem"]))
