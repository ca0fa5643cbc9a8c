"""Queries of the study's later steps: choice of k, seeds, cohorts under rules, provenance, stability, profiles, gates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import guards
from ..functions.tails import student_t
from ..operators import audit, clusters, density, features, lloyd, ranks, reporting, resolve, selection, stability, trends, visits
from .registry import CELLS, FITS, LONG, N, PAIRS, RHO, RUNS, S, SQL_CODED, SQL_DIRTY, SQL_EVENTS, SQL_ORDERS, XS, _balances, _coded, _cohort, _dirty, _events, _fits, _orders, _runs, _t, _vectors

COHORT_KINDS = ["view", "click", "purchase"]


def _suppliers(s, d) -> DataFrame:
    return _t(s, d, "supplier").select("s_suppkey", "s_acctbal")


def _statistics(s, d):
    return selection.Statistics(_suppliers(s, d), "s_suppkey", ["s_acctbal"], list(range(2, 11)))


def _index_votes(s, d):
    """A row an index: its vote, or why it has none, and its value at that k."""
    stats = _statistics(s, d)
    values, errors = selection.index_values(stats)
    return selection.cast_table(s, selection.votes(values, stats.ks, errors))


def _k_selection(s, d):
    r = selection.selection(_suppliers(s, d), "s_suppkey", ["s_acctbal"], repeats=2)
    return r["table"].withColumn("selected_k", F.lit(r["decision"]["k"]).cast("int")).withColumn("stop_reasons", F.lit("; ".join(r["decision"]["stop_reasons"])))


def _label_scatter(s, d):
    """Count and trace of the scatter of each given label, by the pass that the indices use."""
    v = _t(s, d, "embeddings").select(F.col("embedding").cast("array<double>").alias("x"), F.array("label").alias("codes"))
    k = v.agg(F.max(F.get("codes", F.lit(0)))).head()[0] + 1
    first = v.head()["x"]
    groups = selection.scatter(v, [np.array([first] * k)])[0]
    return s.createDataFrame([(e, g[0], round(float(g[2].trace()), 6)) for e, g in enumerate(groups)], "label int, n long, trace double")


def _scored(s, d):
    return density.peaks(_balances(s, d), "s_suppkey", "v", d_c=250.005)[0]


def _seed_candidates(s, d):
    return density.candidate_report(_scored(s, d), _t(s, d, "supplier").select("s_suppkey", F.round("s_acctbal", 2).alias("balance")), "s_suppkey", "balance")


def _sensitivity(s, d):
    rows = density.cutoff_sensitivity(_balances(s, d), "s_suppkey", "v")
    return s.createDataFrame([(r["q"], round(r["d_c"], 6), ",".join(map(str, r["seeds"])), r["same_order"], r["same_set"]) for r in rows], "q double, d_c double, seeds string, same_order boolean, same_set boolean")


def _roster(s, d):
    """One row a user: a second id, and the kind of the first event as entry phase."""
    return _events(s, d).groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("entry_phase")).withColumn("second_id", F.col("user_id") * 7 % 1009)


def _cohort_rules(s, d):
    records = _coded(s, d).withColumn("second_id", F.col("user_id") * 7 % 1009)
    kept = records.filter(F.col("event_type").isin(*COHORT_KINDS) & F.expr("try_cast(trim(score) as double)").isNotNull())
    conflicts = guards.repeated(kept, ["user_id", "day"])
    return trends.longitudinal_cohort(records, _roster(s, d), ["user_id", "second_id"], "event_type", COHORT_KINDS, "day", "score", "event_id", ["code", "code2"], conflicts, ["purchase"])


SPEC = [("a1", "evens", ["SCREENING"], ["c1"], "direct"), ("a2", "odds", ["BASELINE", "SCREENING"], ["c2"], "direct"), ("diff", "evens", ["BASELINE"], ["c1", "c2"], "difference"), ("total", "odds", ["SCHEDULED_FOLLOWUP_OR_OTHER"], ["c1", "c2"], "sum")]


def _spec(s):
    return s.createDataFrame(SPEC, "variable string, file string, classes array<string>, fields array<string>, mode string")


def _records(s, d):
    o = _orders(s, d).withColumn("code", F.expr("case o_orderkey % 3 when 0 then ' sc' when 1 then 'bl' else 'm06' end")).withColumn("code2", F.lit(""))
    o = o.withColumn("visit_class", visits.visit_kind("code", "code2")).withColumnRenamed("day", "date").withColumn("source_row", F.col("o_orderkey"))
    both = visits.tagged_union({"evens": o.filter("o_orderkey % 2 = 0"), "odds": o.filter("o_orderkey % 2 = 1")})
    return both.select("o_custkey", "file", "phase", "code", "code2", "date", "visit_class", "source_row", "c1", "c2")


def _entities(s, d):
    return resolve.entry_phase(_orders(s, d), "o_custkey", "phase", "day", "pid", ["3-MEDIUM", "1-URGENT", "2-HIGH", "5-LOW"]).select("o_custkey", "entry_phase")


def _provenance(s, d):
    entities, spec = _entities(s, d), _spec(s)
    found = resolve.resolve_variables(resolve.candidate_rows(_records(s, d), entities, spec, "o_custkey", ["c1", "c2"]), "o_custkey")
    table = resolve.provenance_table(found, entities, spec, "o_custkey")
    return resolve.checked_table(table, entities, "o_custkey", [v[0] for v in SPEC])


def _thirty_runs(s, d):
    """Thirty partitions of the vectors: by the signs of two neighbouring components each, so that few coincide."""
    v = _t(s, d, "embeddings")
    sign = lambda i: (F.get("embedding", F.lit(i)) > 0).cast("int")
    return v.select("vec_id", F.explode(F.array(*[F.struct(F.lit(r).alias("run"), (sign(r // 2) + (2 if r % 3 else 0) * sign(r // 2 + 1)).alias("label")) for r in range(30)])).alias("r")).select("vec_id", "r.*")


def _run_metrics(s, d):
    return _t(s, d, "customer").filter("c_nationkey < 30").groupBy(F.col("c_nationkey").cast("int").alias("run")).agg(F.avg("c_acctbal").alias("inertia"), F.max("c_acctbal").alias("silhouette"))


def _gate(s, d):
    a = _t(s, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal", F.round("s_acctbal").alias("rounded"))
    b = a.filter("s_suppkey % 50 <> 7").withColumn("s_nationkey", F.when(F.col("s_suppkey") % 20 == 3, 99).otherwise(F.col("s_nationkey"))).withColumn("s_acctbal", F.col("s_acctbal") + F.when(F.col("s_suppkey") % 10 == 1, 0.5).otherwise(1e-9))
    return stability.table_gate(a, b, ["s_suppkey"], ["s_nationkey", "rounded"], {"s_acctbal": (1e-7, 1e-8)})


def _documents(s, d, changed: bool):
    """One JSON document a nation."""
    g = _t(s, d, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("votes"), F.round(F.avg("s_acctbal"), 4).alias("inertia"), F.round(F.max("s_acctbal"), 2).alias("silhouette"))
    if changed:
        k = F.col("s_nationkey")
        g = g.select("s_nationkey", (F.col("votes") + (k % 5 == 1).cast("int")).alias("votes"), (F.col("inertia") + F.when(k % 5 == 2, 5e-12).when(k % 5 == 3, 0.01).otherwise(0.0)).alias("inertia"), (F.col("silhouette") + F.when(k % 5 == 4, 0.5).otherwise(0.0)).alias("silhouette"))
    return g.select("s_nationkey", F.to_json(F.struct(F.struct("votes", F.lit("/tmp/x" if changed else "/tmp/y").alias("summary_path")).alias("selection"), F.array(F.struct("inertia", "silhouette")).alias("metrics"))).alias("document"))


def _document_gate(s, d):
    return stability.document_gate(_documents(s, d, False), _documents(s, d, True), "s_nationkey", "document", {"inertia": 1e-11}, ["summary_path"]).select("id", "path", "kind", "same")


def _assignment_checks(s, d):
    c = _t(s, d, "customer").select("c_custkey", "c_name", (F.col("c_nationkey") % 5 + 1).alias("label"), "c_acctbal")
    return clusters.validate_assignment(c, _t(s, d, "customer").filter("c_custkey > 1"), "c_custkey", "c_name", "label", "c_acctbal", 6)


RULES = [("screen_failure", None, "confirm enrolment"), ("rollover_or_phase_initial", None, "phase entry"), ("screening", "early", "entry at screening"), ("literal_or_translated_baseline", "late", "entry at baseline")]
MEANINGS = [("screening", "before enrolment", "manual"), ("literal_or_translated_baseline", "after screening", "manual"), ("screen_failure", "not enrolled", "codes")]


def _recommended(s, d):
    rows = visits.visit_semantics(_coded(s, d), "event_type", "code", "code2", ["score"]).select("event_type", "code", "code2", "category", "field").withColumn("field_kind", F.when(F.col("event_type") == "view", "early").otherwise("late"))
    return visits.recommendations(rows, s.createDataFrame(RULES, "category string, field_kind string, recommendation string"), s.createDataFrame(MEANINGS, "category string, definition string, source string"))


def _policy(s, d):
    policy = s.createDataFrame([("O", "-4", "YES"), ("F", "-1", "YES"), ("F", "-4", "NO")], "flag string, code string, treat_as_missing string")
    marked = resolve.with_policy(_dirty(s, d).withColumn("flag", F.trim("flag")), policy, ["flag"])
    return marked.select("l_orderkey", "l_linenumber", resolve.normal_cell("quantity", F.col("minus1"), F.col("minus4")).alias("c")).select("l_orderkey", "l_linenumber", "c.*")


def _dictionary(s, d):
    seen = audit.observed_phases(_orders(s, d), ["c1", "c2", "pid"], "phase")
    return visits.dictionary_rows(s.createDataFrame([("c1", "score one"), ("c2", "score two"), ("c9", "not there")], "variable string, label string"), seen)


def _overlap(s, d):
    c = _t(s, d, "customer")
    refit = c.filter("c_custkey % 10 <> 0").select("c_custkey", F.when(F.col("c_acctbal") > 4400, 2).otherwise(1).alias("label"))
    return clusters.tail_overlap(c.select("c_custkey", F.when(F.col("c_acctbal") > 4500, 2).otherwise(1).alias("label")), refit, "c_custkey")


def _checked_sample(s, d):
    """Slopes of ten entities evenly spaced in order, against an independent formula."""
    fits = trends.slopes(_cohort(s, d), "user_id", "elapsed_years", "value").select("user_id", "slope")
    sample = ranks.even_sample(fits.filter("slope is not null"), [F.col("user_id")], 10)
    other = trends.slope_check(_cohort(s, d), "user_id", "elapsed_years", "value").withColumnRenamed("slope", "independent")
    return sample.select("user_id", "slope").join(other, "user_id").withColumn("agrees", F.abs(F.col("slope") - F.col("independent")) <= 1e-6)


def _trend_document(s, d):
    fits = ranks._held(_fits(s, d).filter("slope is not null").withColumn("label", F.when(F.col("slope") < 0, 1).otherwise(2)))
    p = clusters.profile(fits, "label", "slope", ("n_observations", "followup_days")).select(F.col("label").alias("ordered_cluster"), "n", "percent", F.col("mean").alias("centre"), "median", "median_n_observations", "median_followup_days")
    votes = s.createDataFrame([(2, 9), (3, 4)], "k int, votes int")
    cohort = _cohort(s, d).join(fits.select("user_id"), "user_id", "left_semi").withColumnRenamed("user_id", "entity")
    m = fits.agg(F.avg("r_squared").alias("silhouette"), F.avg("rmse").alias("davies_bouldin"), F.avg("se").alias("calinski_harabasz"))
    return reporting.trend_document(p, votes, cohort, m, "trend-1", 2, 0)


QUERIES = {
    "k_means_plus_plus": lambda s, d: lloyd.run_table(s, lloyd.starts(_suppliers(s, d), "s_suppkey", ["s_acctbal"], 3, 50)),
    "index_votes": _index_votes,
    "k_diagnostics": lambda s, d: selection.diagnostics(_statistics(s, d), s),
    "k_selection": _k_selection,
    "label_scatter": _label_scatter,
    "distance_ladder": lambda s, d: density.distance_ladder(_balances(s, d), "s_suppkey", "v"),
    "separation_grid": lambda s, d: density.separation_grid(density.density_grid(_balances(s, d), "s_suppkey", "v", 1, 250.005), "s_suppkey", "v", 1).select("s_suppkey", "rho", F.round("delta", 6).alias("delta")),
    "seed_candidates": _seed_candidates,
    "cutoff_sensitivity": _sensitivity,
    "largest_gaps": lambda s, d: ranks.gap_audit(_t(s, d, "customer"), "c_acctbal", "c_custkey", digits=6),
    "gap_ladder": lambda s, d: audit.percentile_ladder(ranks.adjacent_gaps(_t(s, d, "customer"), "c_acctbal", "c_custkey"), "gap"),
    "pca_totals": lambda s, d: features.pca_totals(features.components(_vectors(s, d), XS), s),
    "pca_scree": lambda s, d: features.components(_vectors(s, d), XS).scree(s),
    "pca_loadings": lambda s, d: features.components(_vectors(s, d), XS).loadings(s),
    "checked_join": lambda s, d: guards.join_many_to_one(_t(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")), _t(s, d, "customer").select("c_custkey", "c_mktsegment"), ["c_custkey"]),
    "checked_pairs": lambda s, d: guards.join_one_to_one(_t(s, d, "supplier").select("s_suppkey", "s_nationkey"), _t(s, d, "supplier").filter("s_acctbal > 0").select("s_suppkey", "s_acctbal"), ["s_suppkey"]),
    "strict_numbers": lambda s, d: guards.strict(_dirty(s, d).filter("not trim(quantity) in ('.', 'abc')").select("l_orderkey", "l_linenumber", "quantity"), ["quantity"], "double", "l_orderkey", "l_linenumber"),
    "checked_slopes": lambda s, d: trends.slopes_or_stop(_cohort(s, d), "user_id", "elapsed_years", "value").select("user_id", "slope", "rmse"),
    "worst_fits": lambda s, d: trends.worst_fits(_fits(s, d).select("user_id", "r_squared"), "user_id"),
    "slope_sample": _checked_sample,
    "cohort_rules": _cohort_rules,
    "provenance_table": _provenance,
    "partition_table": lambda s, d: stability.partition_table(stability.partition_digests(_runs(s, d), "vec_id", "vec_id")),
    "ari_summary": lambda s, d: stability.summary(stability.pairwise_ari(_thirty_runs(s, d), "vec_id"), "ari"),
    "run_metric_summary": lambda s, d: stability.five_numbers(_run_metrics(s, d), ["inertia", "silhouette"]),
    "cumulative_stability": lambda s, d: stability.cumulative(_thirty_runs(s, d), "vec_id", "vec_id", _run_metrics(s, d), ["inertia", "silhouette"]),
    "repeat_gate": _gate,
    "document_gate": _document_gate,
    "assignment_table": lambda s, d: clusters.assignment_table(_t(s, d, "customer"), "c_custkey", "c_mktsegment", "c_acctbal"),
    "assignment_checks": _assignment_checks,
    "tail_overlap": _overlap,
    "column_report": lambda s, d: audit.column_report(_dirty(s, d), CELLS),
    "visit_frequency": lambda s, d: audit.visit_frequency(_orders(s, d), "o_custkey", "day"),
    "format_shares": lambda s, d: audit.format_shares(_dirty(s, d), {"quantity": "-?[0-9]+", "flag": "[A-Z]", "supp": "[0-9]{2}"}),
    "populated_rows": lambda s, d: audit.populated(_dirty(s, d), ["discount", "flag", "supp"], "grp"),
    "value_counts_text": lambda s, d: audit.value_counts_text(_dirty(s, d), ["flag", "grp"]),
    "policy_cells": _policy,
    "data_dictionary": _dictionary,
    "ordering_fields": lambda s, d: visits.ordering_fields(_coded(s, d).select(F.col("code").alias("VISCODE"), F.col("day").cast("string").alias("VISDATE"), F.col("score").alias("TOTAL13"), F.col("user_id").cast("string").alias("RID"), F.col("event_type").alias("note")), ["VISCODE", "VISDATE", "TOTAL13", "RID", "note"], ["TOTAL13"]),
    "recommendations": _recommended,
    "ids_only_left": lambda s, d: reporting.only_left(_t(s, d, "customer").select(F.col("c_custkey").alias("id")), _t(s, d, "events").select(F.col("user_id").alias("id")), "id"),
    "trend_document_rules": lambda s, d: reporting.trend_document_rules(_trend_document(s, d), [2, 3, 4]),
}

GAPS = "(select c_custkey, lag(c_acctbal) over (order by c_acctbal, c_custkey) as before, c_acctbal as after, c_acctbal - lag(c_acctbal) over (order by c_acctbal, c_custkey) as gap from customer)"
LADDER = "unnest([0, 1, 5, 25, 50, 75, 95, 99, 100]) as percent, unnest(quantile_cont({0}, [0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1])) as v"
PEAKS = f"(with r as {RHO}, p as {PAIRS}, x as (select r.s_suppkey, r.rho, min(d) filter (o.rho > r.rho) as near, max(d) as far from r join p on p.i = r.s_suppkey join r o on o.s_suppkey = p.j group by all) select s_suppkey, rho, coalesce(near, far) as delta, rho * coalesce(near, far) as gamma from x)"
T_TABLE = lambda most: "(values " + ", ".join(f"({n}, {student_t(0.975, n - 2)!r})" for n in range(3, most + 1)) + ") t(n_observations, q)"
SIGN = lambda i: f"(embedding[{i + 1}] > 0)::int"
THIRTY = "(select vec_id, unnest(range(30))::int as run, unnest([" + ", ".join(f"{SIGN(r // 2)} + {2 if r % 3 else 0} * {SIGN(r // 2 + 1)}" for r in range(30)) + "]) as label from embeddings)"
PRINTS = lambda runs: f"(select run, sha256(string_agg(line || chr(10), '' order by line)) as sha256 from (select run, vec_id || '|' || c as line from {runs} join (select run, label, row_number() over (partition by run order by min(vec_id)) - 1 as c from {runs} group by run, label) using (run, label)) group by run)"
ARI = f"""(with r as {THIRTY}, c as (select a.run as run_a, b.run as run_b, a.label as la, b.label as lb, count(*) as n from r a join r b on a.vec_id = b.vec_id and a.run < b.run group by all),
 x as (select run_a, run_b, sum(n * (n - 1) / 2) as ij, sum(n) as total from c group by all), y as (select run_a, run_b, sum(n * (n - 1) / 2) as ai from (select run_a, run_b, la, sum(n) as n from c group by all) group by all), z as (select run_a, run_b, sum(n * (n - 1) / 2) as bj from (select run_a, run_b, lb, sum(n) as n from c group by all) group by all)
 select run_a, run_b, round(case when (ai + bj) / 2 = ai * bj / (total * (total - 1) / 2) then 1 else (ij - ai * bj / (total * (total - 1) / 2)) / ((ai + bj) / 2 - ai * bj / (total * (total - 1) / 2)) end, 6)::double as ari from x join y using (run_a, run_b) join z using (run_a, run_b))"""
FIVE = "round(avg({0}), 6) as mean, round(stddev_samp({0}), 6) as sd, round(min({0}), 6) as minimum, round(median({0}), 6) as median, round(max({0}), 6) as maximum"
METRICS = "(select c_nationkey::int as run, avg(c_acctbal) as inertia, max(c_acctbal) as silhouette from customer where c_nationkey < 30 group by 1)"
MARKED = f"(select *, user_id * 7 % 1009 as second_id, try_cast(regexp_extract(lower({S('code')}), '^m(\\d+)$', 1) as int) as m from {SQL_CODED})"
ALLOWED = f"(select r.*, f.entry_phase as study_entry_phase from {MARKED} r join (select user_id, arg_min(event_type, event_id) as entry_phase from {SQL_EVENTS} group by user_id) f using (user_id) where event_type in ('view', 'click', 'purchase'))"
CLASS = "case o_orderkey % 3 when 0 then 'SCREENING' when 1 then 'BASELINE' else 'SCHEDULED_FOLLOWUP_OR_OTHER' end"
CODE = "case o_orderkey % 3 when 0 then 'sc' when 1 then 'bl' else 'm06' end"
ENTRY = f"(select o_custkey, phase as entry_phase from (select *, row_number() over (partition by o_custkey order by d is null, d, o, phase) as r from (select o_custkey, phase, min(day) as d, case phase when '3-MEDIUM' then 0 when '1-URGENT' then 1 when '2-HIGH' then 2 when '5-LOW' then 3 else 999 end as o from {SQL_ORDERS} group by o_custkey, phase)) where r = 1)"
REASON = lambda c: f"case when {S(c)} = '' then 'BLANK' when {N(c)} = -1 then 'MINUS1' when {N(c)} = -4 then 'MINUS4' when {N(c)} is null then 'UNRESOLVED_DUPLICATE_QC' else 'VALID' end"


def _variable_sql(name: str, file: str, classes: list[str], cells: list[str], mode: str) -> str:
    """One variable of the provenance table: candidates, distinct valid values, best row, reason."""
    ok = " and ".join(f"{REASON(c)} = 'VALID'" for c in cells)
    value = f"{N(cells[0])}" if mode == "direct" else f"{N(cells[0])} {'-' if mode == 'difference' else '+'} {N(cells[1])}"
    vector = " || ',' || ".join(f"cast({N(c)} as varchar)" for c in cells)
    why = "'FAILED_DERIVATION'" if mode != "direct" else f"case when bool_or({REASON(cells[0])} = 'UNRESOLVED_DUPLICATE_QC') then 'UNRESOLVED_DUPLICATE_QC' when bool_or({REASON(cells[0])} = 'MINUS1') then 'MINUS1' when bool_or({REASON(cells[0])} = 'MINUS4') then 'MINUS4' else 'BLANK' end"
    key = "row(day is null, coalesce(day, date '9999-12-31'), o_orderkey)"
    row = "struct_pack(phase := phase, code := code, d := day, c := class)"
    inner = f"""select o_custkey, count(distinct {vector}) filter ({ok}) as k, max({value}) filter ({ok}) as v, {why} as why, arg_min({row}, {key}) filter ({ok}) as best, arg_min({row}, {key}) as anyrow
 from (select *, {CLASS} as class, {CODE} as code from {SQL_ORDERS}) join {ENTRY} e using (o_custkey) where phase = entry_phase and o_orderkey % 2 = {0 if file == 'evens' else 1} and class in ({', '.join(f"'{c}'" for c in classes)}) group by o_custkey"""
    return f"(select o_custkey, case when k = 1 then v end as v, case when k > 1 then 'UNRESOLVED_DUPLICATE_QC' when k = 1 then '' else why end as why, case when k > 1 then null when k = 1 then best else anyrow end as src from ({inner}))"


def _provenance_sql() -> str:
    out, joins = [], []
    for i, (name, file, classes, cells, mode) in enumerate(SPEC):
        joins.append(f"left join {_variable_sql(name, file, classes, cells, mode)} v{i} on v{i}.o_custkey = e.o_custkey")
        out.append(f"""v{i}.v as {name}, '{file}' as "{name}_SOURCE_FILE", coalesce(v{i}.src.phase, '') as "{name}_SOURCE_PHASE", coalesce(v{i}.src.code, '') as "{name}_SOURCE_VISCODE", '' as "{name}_SOURCE_VISCODE2", coalesce(cast(v{i}.src.d as varchar), '') as "{name}_SOURCE_DATE", coalesce(v{i}.src.c, '') as "{name}_SOURCE_VISIT_CLASS", coalesce(v{i}.why, 'UNAVAILABLE_PHASE_INSTRUMENT') as "{name}_MISSING_REASON\"""")
    return f"select e.o_custkey, {', '.join(out)} from {ENTRY} e " + " ".join(joins)


SQL = {
    "label_scatter": "select label, n, round(sum(w), 6) as trace from (select label, i, count(*) as n, var_pop(x) * count(*) as w from (select label, unnest(range(64)) as i, unnest(embedding)::double as x from embeddings) group by all) group by all",
    "distance_ladder": f"select percent, round(v, 6) as value from (select {LADDER.format('d')} from {PAIRS} where i < j)",
    "separation_grid": f"select s_suppkey, rho, round(delta, 6) as delta from {PEAKS}",
    "seed_candidates": f"""with p as {PEAKS}, g as (select *, row_number() over (order by gamma desc, s_suppkey) as gamma_rank, count(*) over (partition by rho) as same_rho from p),
 v as (select s_suppkey, round(s_acctbal, 2) as balance, row_number() over (order by round(s_acctbal, 2), s_suppkey) as r, count(*) over () as n from supplier)
 select s_suppkey, gamma_rank, gamma_rank <= 2 as selected_as_seed, rho, same_rho, round(delta, 6) as delta, round(gamma, 6) as gamma, balance, r as rank, round((r - 1) * 100.0 / greatest(1, n - 1), 6) as percentile, r - 1 as n_before, n - r as n_after, r <= ceil(0.01 * n) as low_tail, r > n - ceil(0.01 * n) as high_tail from g join v using (s_suppkey) where gamma_rank <= 10""",
    "cutoff_sensitivity": f"""with p as {PAIRS}, c as (select unnest([0.01, 0.02, 0.03])::double as q, unnest(quantile_cont(d, [0.01, 0.02, 0.03])) as d_c from p where d > 0 and i < j), r as (select q, d_c, s_suppkey, count(d) filter (d < d_c) as rho from c cross join supplier left join p on i = s_suppkey group by all),
 x as (select r.q, r.d_c, r.s_suppkey, r.rho, min(d) filter (o.rho > r.rho) as near, max(d) as far from r join p on p.i = r.s_suppkey join r o on o.s_suppkey = p.j and o.q = r.q group by all), s as (select q, d_c, s_suppkey, row_number() over (partition by q order by rho * coalesce(near, far) desc, s_suppkey) as g from x),
 t as (select q, d_c, string_agg(s_suppkey, ',' order by g) as seeds, list(s_suppkey order by s_suppkey) as own from s where g <= 2 group by all) select t.q, round(t.d_c, 6) as d_c, t.seeds, t.seeds = m.seeds as same_order, t.own = m.own as same_set from t, t m where m.q = 0.02::double""",
    "largest_gaps": f"select c_custkey, round(before, 6) as before, round(after, 6) as after, round(gap, 6) as gap from {GAPS} where gap is not null order by gap desc, after, c_custkey limit 10",
    "gap_ladder": f"select percent, round(v, 6) as value from (select {LADDER.format('gap')} from {GAPS})",
    "pca_totals": "with l as (select vec_id, unnest(range(64)) as i, unnest(embedding)::double as x from embeddings), c as (select a.i, b.i as j, covar_samp(a.x, b.x) as v from l a join l b on a.vec_id = b.vec_id group by all) select 64 as n_components, round(sum(v) filter (i = j), 6) as total_variance, round(sum(v * v), 6) as squared from c",
    "checked_join": "select o_orderkey, c_custkey, c_mktsegment from orders join customer on o_custkey = c_custkey",
    "checked_pairs": "select a.s_suppkey, a.s_nationkey, b.s_acctbal from supplier a left join supplier b on a.s_suppkey = b.s_suppkey and b.s_acctbal > 0",
    "strict_numbers": f"select l_orderkey, l_linenumber, try_cast(nullif(trim(quantity), '') as double) as quantity from ({SQL_DIRTY}) where trim(quantity) not in ('.', 'abc')",
    "checked_slopes": f"select user_id, round(b, 6) as slope, round(sqrt((syy - sxy * sxy / sxx) / n_observations), 6) as rmse from {FITS}",
    "worst_fits": f"select user_id, round(sxy * sxy / sxx / syy, 6) as r_squared from {FITS} order by round(sxy * sxy / sxx / syy, 6), user_id limit 10",
    "slope_sample": f"select user_id, slope, slope as independent, true as agrees from (select user_id, round(b, 6) as slope, row_number() over (order by user_id) - 1 as r, count(*) over () as n from {FITS}) where r in (select floor(i * (n - 1) / 9) from range(10) t(i))",
    "slope_intervals": f"select user_id, round(b, 6) as slope, round(b - q * se, 6) as ci_low, round(b + q * se, 6) as ci_high from (select *, sqrt((syy - sxy * sxy / sxx) / (n_observations - 2) / sxx) as se from {FITS}) join {T_TABLE(400)} using (n_observations)",
    "cohort_rules": f"""with a as {ALLOWED}, f as (select *, coalesce(m is not null and exists (select 1 from a b where b.user_id = a.user_id and b.m is not null and ((b.m < a.m and b.day > a.day) or (b.m > a.m and b.day < a.day))), false) as wrong from a),
 g as (select *, max(wrong::int) over (partition by user_id) as own, {N('score')} as number from f), u as (select *, count(*) over (partition by user_id, day) as twice from g where number is not null), k as (select *, count(*) over (partition by user_id) as dates, min(day) over (partition by user_id) as first_day from u where twice = 1)
 select user_id, second_id, study_entry_phase, event_type as record_phase, code, code2, day as date, {S('score')} as value, event_id, row_number() over (partition by user_id order by day, event_id) as observation_number, date_diff('day', first_day, day) as elapsed_days, round_even(date_diff('day', first_day, day) / 365.25, 10) as elapsed_years,
 wrong::int as visit_code_date_anomaly_flag, own as participant_anomaly_flag, (event_type = 'purchase')::int as later_phase_flag from k where dates >= 3""",
    "provenance_table": _provenance_sql(),
    "partition_table": f"select row_number() over (order by n_runs desc, sha256) as place, sha256, n_runs, runs, round(n_runs * 100.0 / sum(n_runs) over (), 6) as pct, n_runs * 2 > sum(n_runs) over () as dominates, false as matches_primary from (select sha256, count(*) as n_runs, string_agg(run, ',' order by run) as runs from {PRINTS(RUNS)} group by sha256)",
    "ari_summary": f"select unnest(['mean', 'sd', 'minimum', 'median', 'maximum']) as statistic, unnest([mean, sd, minimum, median, maximum]) as value from (select {FIVE.format('ari')} from {ARI})",
    "run_metric_summary": f"select 'inertia' as metric, {FIVE.format('inertia')} from {METRICS} union all select 'silhouette', {FIVE.format('silhouette')} from {METRICS}",
    "cumulative_stability": f"""with c as (select unnest([10, 20, 30]) as first_runs), p as (select first_runs, count(*) as n_runs, count(distinct sha256) as n_partitions from c join {PRINTS(THIRTY)} on run < first_runs group by all), a as (select first_runs, round(avg(ari), 6) as mean_ari from c join {ARI} on run_b < first_runs group by all),
 m as (select first_runs, round(avg(inertia), 6) as inertia_mean, round(stddev_samp(inertia), 6) as inertia_sd, round(avg(silhouette), 6) as silhouette_mean, round(stddev_samp(silhouette), 6) as silhouette_sd from c join {METRICS} on run < first_runs group by all) select * from p join a using (first_runs) join m using (first_runs)""",
    "repeat_gate": """with a as (select s_suppkey, s_nationkey, s_acctbal, s_suppkey % 50 <> 7 as shared from supplier), b as (select s_suppkey, case when s_suppkey % 20 = 3 then 99 else s_nationkey end as nk, s_acctbal + case when s_suppkey % 10 = 1 then 0.5 else 1e-9 end as x from supplier), j as (select * from a join b using (s_suppkey))
 select 'rows' as field, 'same rows on both sides' as rule, count(*) as n_compared, count(*) filter (not shared) as n_different, null::double as largest, count(*) filter (not shared) = 0 as passed from j union all select 's_nationkey', 'equal', count(*) filter (shared), count(*) filter (shared and s_nationkey <> nk), null, count(*) filter (shared and s_nationkey <> nk) = 0 from j
 union all select 'rounded', 'equal', count(*) filter (shared), 0, null, true from j union all select 's_acctbal', 'within 1e-08 + 1e-07 of the second', count(*) filter (shared), count(*) filter (shared and abs(s_acctbal - x) > 1e-8 + 1e-7 * abs(x)), max(abs(s_acctbal - x)) filter (shared), count(*) filter (shared and abs(s_acctbal - x) > 1e-8 + 1e-7 * abs(x)) = 0 from j""",
    "document_gate": """select s_nationkey::varchar as id, path, kind, same from (select s_nationkey, unnest(['selection.votes', 'selection.summary_path', 'metrics[0].inertia', 'metrics[0].silhouette']) as path, unnest(['integer', 'text', 'real', 'real']) as kind, unnest([s_nationkey % 5 <> 1, true, s_nationkey % 5 <> 3, s_nationkey % 5 <> 4]) as same from (select distinct s_nationkey from supplier))""",
    "assignment_table": "select c_custkey, c_mktsegment, c_acctbal, ordered_rank, centre from customer join (select c_mktsegment, row_number() over (order by avg(c_acctbal), c_mktsegment) as ordered_rank, round(avg(c_acctbal), 6) as centre from customer group by c_mktsegment) using (c_mktsegment)",
    "assignment_checks": """with c as (select c_custkey, c_name, c_nationkey % 5 + 1 as label, c_acctbal from customer), g as (select label, count(*) as n, avg(c_acctbal) as m from c group by label), o as (select *, lag(m) over (order by label) as b from g)
 select count(*) as n_rows, count(distinct c_custkey) as n_first, count(distinct c_name) as n_second, 0 as n_nonfinite, count(distinct (c_custkey, c_name)) as n_pairs, true as each_once, (select 6 - count(*) from g) as n_empty, (select sum(n) from g) as n_members, (select bool_and(coalesce(m > b, true)) from o) as centres_ascend, false as same_pairs from c""",
    "tail_overlap": """with j as (select case when c_acctbal > 4500 then 2 else 1 end as la, case when c_acctbal > 4400 then 2 else 1 end as lb from customer where c_custkey % 10 <> 0), c as (select la, lb, count(*) as n from j group by all), s as (select (select sum(n * (n - 1) / 2) from c) as ij, (select sum(n * (n - 1) / 2) from (select sum(n) as n from c group by la)) as ai, (select sum(n * (n - 1) / 2) from (select sum(n) as n from c group by lb)) as bj, count(*) * (count(*) - 1) / 2 as t from j)
 select (select count(*) filter (la = lb) from j) as n_equal, (select count(*) from j) as n, (select round(avg((la = lb)::int) * 100, 6) from j) as pct, round((ij - ai * bj / t) / ((ai + bj) / 2 - ai * bj / t), 6)::double as ari from s""",
    "column_report": LONG + f""" select variable, case variable when 'quantity' then 6 when 'discount' then 7 else 8 end as position, count(*) as n_rows, count(*) filter ({S('value')} = '') as n_blank, round(count(*) filter ({S('value')} = '') * 100.0 / count(*), 6) as pct_blank, count(distinct nullif({S('value')}, '')) as n_unique,
 case when count(*) filter ({S('value')} <> '') = 0 then 'empty' when count(*) filter ({S('value')} <> '' and {N('value')} is null) > 0 then 'text' when count(*) filter (regexp_matches({S('value')}, '[.eE]') and {N('value')} is not null) > 0 then 'number' else 'integer' end as dtype, false as is_identifier, false as is_visit, false as is_date from cat group by variable""",
    "visit_frequency": f"select n_dates, count(*) as n_entities, sum(n_rows)::bigint as n_rows, min(n_rows) as least_rows, max(n_rows) as most_rows from (select o_custkey, count(*) as n_rows, count(distinct day) as n_dates from {SQL_ORDERS} group by o_custkey) group by n_dates",
    "format_shares": f"with d as ({SQL_DIRTY}) " + " union all ".join(f"select '{c}' as variable, count(*) filter ({S(c)} <> '') as n_nonblank, round(avg(regexp_full_match({S(c)}, '{p}')::int) filter ({S(c)} <> ''), 6) as share, regexp_replace(regexp_replace(min({S(c)}) filter ({S(c)} <> ''), '[0-9]', '9', 'g'), '[A-Za-z]', 'A', 'g') as example from d" for c, p in (("quantity", "-?[0-9]+"), ("flag", "[A-Z]"), ("supp", "[0-9][0-9]"))),
    "populated_rows": f"select grp, count(*) filter (any_) as n_any, count(*) filter (not any_) as n_none from (select grp, {S('discount')} <> '' or {S('flag')} <> '' or {S('supp')} <> '' as any_ from ({SQL_DIRTY})) group by grp",
    "value_counts_text": f"select variable, '{{' || string_agg('\"' || value || '\":' || n, ',' order by value) || '}}' as counts from (select variable, value, count(*) as n from (select 'flag' as variable, flag as value from ({SQL_DIRTY}) union all select 'grp', grp from ({SQL_DIRTY})) where value is not null group by all) group by variable",
    "policy_cells": f"select l_orderkey, l_linenumber, case when reason = 'VALID' then {N('quantity')} end as value, reason from (select *, case when {S('quantity')} = '' then 'BLANK' when {N('quantity')} = -1 and trim(flag) = 'F' then 'MINUS1' when {N('quantity')} = -4 and trim(flag) = 'O' then 'MINUS4' when {N('quantity')} is null then 'UNRESOLVED_DUPLICATE_QC' else 'VALID' end as reason from ({SQL_DIRTY}))",
    "data_dictionary": f"select variable, label, phases, phases is not null as field_present from (values ('c1', 'score one'), ('c2', 'score two'), ('c9', 'not there')) s(variable, label) left join (" + " union all ".join(f"select '{c}' as variable, string_agg(distinct phase, '|' order by phase) as phases from {SQL_ORDERS} where {S(c)} <> ''" for c in ("c1", "c2")) + ") using (variable)",
    "ordering_fields": "select field, count(*) as n_rows, count(*) filter (regexp_replace(v, '^\\s+|\\s+$', '', 'g') <> '') as n_nonblank, count(try_cast(case when regexp_matches(v, '^\\d\\d\\d\\d-\\d\\d-\\d\\d$') then v end as date)) as n_dates, any_value(label) as label from (" + " union all ".join(f"select '{f}' as field, {c} as v, '{label}' as label from {SQL_CODED}" for f, c, label in (("VISCODE", "code", "WITH_VISIT_CODE_RULES"), ("VISDATE", "cast(day as varchar)", "DATE_CANDIDATE"), ("TOTAL13", "score", "OUTCOME_ONLY"), ("RID", "cast(user_id as varchar)", "IDENTIFIER_ONLY"), ("note", "event_type", "LIKELY_METADATA"))) + ") group by field",
    "recommendations": f"""with c as (select distinct event_type, code, code2, case when {S('code')} = 'f' then 'screen_failure' when {S('code')} = 'v06' then 'rollover_or_phase_initial' when code2 = 'sc' or {S('code')} = 'sc' then 'screening' when code = 't_bl' then 'phase_specific_baseline' when code2 = 'bl' or {S('code')} in ('bl', 'v03') then 'literal_or_translated_baseline' when code = 'x_bl' then 'phase_specific_or_unresolved' end as category from {SQL_CODED})
 select event_type, code, code2, category, 'score' as field, case when event_type = 'view' then 'early' else 'late' end as field_kind, definition, source, case when category = 'screen_failure' then 'confirm enrolment' when category = 'rollover_or_phase_initial' then 'phase entry' when category = 'screening' and event_type = 'view' then 'entry at screening' when category = 'literal_or_translated_baseline' and event_type <> 'view' then 'entry at baseline' else 'UNRESOLVED' end as recommendation
 from c left join (values ('screening', 'before enrolment', 'manual'), ('literal_or_translated_baseline', 'after screening', 'manual'), ('screen_failure', 'not enrolled', 'codes')) m(category, definition, source) using (category) where category is not null""",
    "ids_only_left": "select distinct c_custkey as id from customer where c_custkey not in (select user_id from events)",
    "trend_document_rules": "select unnest(['k_in_candidates', 'k_was_voted_on', 'profiles_equal_k', 'members_equal_participants', 'retained_at_most_initial', 'enough_observations', 'profiles_in_order', 'no_identifiers']) as \"check\", 0 as violations, true as passed from (select count(*) from events)",
}
