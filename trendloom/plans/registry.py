"""Registered queries over the given tables, each with its DuckDB equivalent.

Raw cells are derived from the tables by expressions that both engines share;
what the operators do with them is written separately in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cells
from ..operators import audit, clusters, density, features, ranks, reporting, resolve, review, selection, sensitivity, stability, trends, visits
from ..sources import tables

# Shared derivations.
CELLS = ["quantity", "discount", "flag"]
DIRTY = [
    "l_orderkey", "l_linenumber", "l_partkey", "case when l_linenumber = 6 then null else l_returnflag end as grp", "case when l_suppkey % 17 = 0 then ' ' || chr(9) else ' ' || cast(l_suppkey as string) end as supp",
    """case when l_linenumber = 1 and l_quantity < 10 then '' when l_quantity < 12 then '-4' when l_quantity < 14 then '-1.0' when l_quantity < 16 then ' -4.00 ' when l_quantity < 17 then '.' when l_quantity < 18 then '-9'
    when l_quantity < 19 then 'abc' when l_quantity < 20 then '999' when l_quantity < 21 then '-7' else cast(cast(l_quantity as int) as string) end as quantity""",
    "case when l_discount < 0.015 then 'NA' when l_discount < 0.025 then chr(9) when l_discount > 0.095 then ' n/a' else 'd' end as discount",
    "case when l_linestatus = 'F' and l_linenumber > 5 then '  ' else l_linestatus end as flag", "cast(l_shipdate as date) as day"]
EVENTS = ["event_id", "user_id", "event_type", "value", "cast(ts as date) as day", "cast(regexp_extract(props, '[0-9]+', 0) as int) as k"]
CODED = [*EVENTS, """case k % 9 when 0 then 'bl' when 1 then ' sc' when 2 then 't_bl' when 3 then 'v06' when 4 then 'f' when 5 then 'x_bl' when 6 then 'v03' when 7 then 'm06' else 'M' || cast(k as string) end as code""",
         "case when k % 4 = 0 then 'sc' when k % 4 = 1 then 'bl' else '' end as code2", "case when value < 10 then '-4' when value < 20 then '-1.0' when value < 30 then ' ' else cast(cast(floor(value) as int) as string) end as score"]
ORDERS = ["o_orderkey", "o_custkey", "o_orderpriority as phase", "case when o_orderkey % 5 = 0 then null else cast(o_orderdate as date) end as day", "case when o_orderkey % 11 = 0 then '' else ' id' || cast(o_custkey % 3 + o_orderkey % 2 as string) end as pid",
          """case when o_orderkey % 7 = 0 then '-1' when o_orderkey % 7 = 1 then '-4.0' when o_orderkey % 7 = 2 then ' ' when o_orderkey % 7 = 3 then 'bad' else cast(o_orderkey % 3 as string) end as c1""",
          "case when o_orderkey % 13 = 0 then '' else cast(o_custkey % 2 as string) end as c2", "o_orderstatus"]
XS = [f"x{i}" for i in range(64)]


def _t(s, d, name) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def _dirty(s, d):
    return _t(s, d, "lineitem").selectExpr(*DIRTY)


def _events(s, d):
    return _t(s, d, "events").selectExpr(*EVENTS)


def _coded(s, d):
    return _events(s, d).selectExpr(*[c if i > 5 else c.split(" as ")[-1] for i, c in enumerate(CODED)])


def _orders(s, d):
    return _t(s, d, "orders").selectExpr(*ORDERS)


def _cohort(s, d):
    return trends.cohort(_events(s, d), "user_id", "day", "event_id")


def _fits(s, d):
    return trends.slopes(_cohort(s, d), "user_id", "elapsed_years", "value", "day")


def _vectors(s, d, n=64):
    return _t(s, d, "embeddings").select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(f"x{i}") for i in range(n)])


def _whole_vectors(s, d):
    return _t(s, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def _balances(s, d):
    return _t(s, d, "supplier").select("s_suppkey", F.array(F.round("s_acctbal", 2)).alias("v"), "s_acctbal")


def _direct(s, d):
    keys = ["o_custkey"]
    return resolve.resolve_direct(_orders(s, d), keys, resolve.normal_cell("c1"), [F.col("day").isNull(), F.col("day"), F.col("o_orderkey")], "o_orderkey", F.col("phase") != "5-LOW")


def _derived(s, d):
    return resolve.resolve_derived(_orders(s, d), ["o_custkey"], [resolve.normal_cell("c1"), resolve.normal_cell("c2")], lambda a, b: a - b, [F.col("day").isNull(), F.col("day"), F.col("o_orderkey")], "o_orderkey")


def _segments(s, d):
    """Three metrics a nation, as a table of candidates."""
    return _t(s, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.round(F.avg("c_acctbal"), 1).alias("silhouette"), F.round(F.max("c_acctbal"), -2).alias("davies_bouldin"), F.count(F.lit(1)).cast("double").alias("calinski_harabasz"))


def _runs(s, d):
    """Four partitions of the vectors by signs of components, as runs."""
    v = _t(s, d, "embeddings")
    sign = lambda i: (F.get("embedding", F.lit(i)) > 0).cast("int")
    return v.select("vec_id", F.explode(F.array(*[F.struct(F.lit(r).alias("run"), x.alias("label")) for r, x in enumerate((sign(0), 1 - sign(0), sign(0) + 2 * sign(1), F.col("label")))])).alias("r")).select("vec_id", "r.*")


def _flow(s, d):
    rules = [("has_value", F.col("value") >= 20), ("kind", F.col("event_type") != "view"), ("even_k", F.col("k") % 2 == 0)]
    return trends.filtering_flow(_events(s, d), rules)


def _undated(s, d):
    return _coded(s, d).withColumn("day", F.when(F.col("event_id") % 10 != 0, F.col("day")))


def _scope(s, d):
    both = _direct(s, d).withColumn("variable", F.lit("c1")).unionByName(_derived(s, d).withColumn("variable", F.lit("diff")))
    return review.scope_missingness(both, "low_phase_left", F.col("n_candidates") > 2)


def _collection(s, d):
    cell = resolve.normal_cell("score")
    records = _coded(s, d).select("user_id", F.col("event_type").alias("phase"), visits.visit_kind("code", "code2").alias("category"), cell.alias("c"), (F.col("k") % 3 == 0).alias("any_item"), "code2")
    records = records.select("user_id", "phase", "category", F.col("c.reason").alias("state"), F.col("c.value").alias("number"), "any_item", "code2")
    roster = _events(s, d).groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("cohort"), F.when(F.col("user_id") % 3 > 0, F.max("value")).alias("value"))
    kinds = {"screening": "SCREENING", "baseline": "BASELINE", "entry": "ROLLOVER_PHASE_ENTRY_NOT_ORIGINAL_BASELINE", "followup": "SCHEDULED_FOLLOWUP_OR_OTHER"}
    return review.collection_qc(roster, records, "user_id", kinds, ("code2",))


def _refits(s, d):
    fits = _fits(s, d).select("user_id", F.round("slope", 6).alias("slope"), "n_observations", "followup_days").withColumn("label", F.when(F.col("slope") < 0, 1).otherwise(2))
    ranked, tails = sensitivity.tail_subsets(fits, "user_id", "slope")
    return sensitivity.subset_refits(ranked, "user_id", "slope", {"long": F.col("followup_days") >= 28, "many": F.col("n_observations") >= 60} | tails, "label", [-1.0, 1.0], None, 0.0)


def _best_k(s, d):
    m = _t(s, d, "customer").groupBy(F.col("c_mktsegment").alias("subset"), F.col("c_nationkey").alias("k"))
    return sensitivity.best_k(m.agg(F.round(F.avg("c_acctbal"), 1).alias("silhouette"), F.round(F.max("c_acctbal"), -2).alias("davies_bouldin"), F.count(F.lit(1)).cast("double").alias("calinski_harabasz")))


def _final(s, d):
    suppliers = _t(s, d, "supplier").select("s_suppkey", "s_acctbal")
    done = clusters.kmeans(suppliers, ["s_acctbal"], [[0.0], [9000.0]], 3, -1.0)[0].withColumnRenamed("cluster", "label")
    profiles = done.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("s_acctbal").alias("centre"))
    return sensitivity.final_report(suppliers, done, profiles, _t(s, d, "nation").select(F.col("n_nationkey").cast("int").alias("run")), "s_suppkey", 2, 25)


ORDER = ["3-MEDIUM", "1-URGENT", "2-HIGH", "5-LOW"]
QUERIES = {
    "column_inventory": lambda s, d: audit.column_inventory(_dirty(s, d), CELLS),
    "missing_candidates": lambda s, d: audit.missing_candidates(_dirty(s, d), CELLS),
    "sentinel_exposure": lambda s, d: audit.sentinel_exposure(_dirty(s, d), CELLS),
    "sentinel_exposure_first_lines": lambda s, d: audit.sentinel_exposure(_dirty(s, d), CELLS, F.col("l_linenumber") == 1),
    "candidate_mapping": lambda s, d: audit.candidate_mapping(_dirty(s, d), CELLS),
    "missing_policy": lambda s, d: audit.missing_policy(_dirty(s, d), CELLS),
    "duplicate_keys": lambda s, d: audit.duplicate_keys(_dirty(s, d), ["l_orderkey", "supp"]),
    "duplicate_summary": lambda s, d: audit.duplicate_summary(_dirty(s, d), ["l_orderkey", "quantity"], "l_orderkey"),
    "duplicate_examples": lambda s, d: audit.duplicate_examples(_dirty(s, d).select("l_orderkey", "quantity", "l_linenumber"), ["l_orderkey", "quantity"], ["l_linenumber"]),
    "exact_duplicates": lambda s, d: audit.exact_duplicates(_dirty(s, d).select("grp", "quantity", "discount", "flag", "l_partkey")),
    "file_inventory": lambda s, d: audit.file_inventory(_dirty(s, d), ["supp"], ["flag", "discount"]),
    "missingness_by_group": lambda s, d: audit.missingness(_dirty(s, d), CELLS, "grp"),
    "date_audit": lambda s, d: audit.date_audit(_t(s, d, "orders").selectExpr("case when o_orderkey % 6 = 0 then '' when o_orderkey % 6 = 1 then '2020-13-45' else cast(cast(o_orderdate as date) as string) end as seen", "o_totalprice"), ["seen"], F.col("o_totalprice") > 1000, cells.date_of),
    "value_audit": lambda s, d: audit.value_audit(_dirty(s, d), "quantity", 0, 45, F.col("l_linenumber") < 4),
    "rows_and_entities": lambda s, d: audit.rows_and_entities(_orders(s, d), "phase", "o_custkey"),
    "one_to_one": lambda s, d: audit.one_to_one(_orders(s, d), "o_custkey", "pid"),
    "visits_per_entity": lambda s, d: audit.visits_per_entity(_orders(s, d), "o_custkey", "day"),
    "value_histogram": lambda s, d: audit.value_histogram(_dirty(s, d), "quantity", "flag"),
    "tie_summary": lambda s, d: audit.tie_summary(_t(s, d, "part"), "p_retailprice"),
    "sign_counts": lambda s, d: audit.sign_counts(_t(s, d, "customer"), "c_acctbal", -500.0),
    "observed_phases": lambda s, d: audit.observed_phases(_orders(s, d), ["c1", "c2", "pid"], "phase"),
    "describe_by_segment": lambda s, d: audit.describe(_t(s, d, "customer"), "c_acctbal", "c_mktsegment"),
    "percentile_ladder": lambda s, d: audit.percentile_ladder(_t(s, d, "customer"), "c_acctbal"),
    "visit_classes": lambda s, d: _coded(s, d).select("event_id", visits.visit_class("code", "code2").alias("entry_class"), visits.visit_kind("code", "code2").alias("kind"), cells.month_number("code").alias("month")),
    "visit_semantics": lambda s, d: visits.visit_semantics(_coded(s, d), "event_type", "code", "code2", ["score"]),
    "visit_distribution": lambda s, d: visits.visit_distribution(_coded(s, d), _coded(s, d).groupBy("user_id").agg(F.min("event_type").alias("cohort")), "user_id", "cohort", "event_type", "code"),
    "visit_lookup": lambda s, d: visits.lookup(_events(s, d), _coded(s, d).filter("k < 20").groupBy("event_type", "k").agg(F.min("code").alias("meaning")), ["event_type", "k"], "meaning").select("event_id", "meaning"),
    "order_anomalies_all": lambda s, d: visits.order_anomaly_rows(_events(s, d), "user_id", "k", "day").select("user_id", "event_id", "k"),
    "order_anomalies_later": lambda s, d: visits.order_anomalies(_events(s, d), "user_id", "k", "day"),
    "normalised_cells": lambda s, d: _dirty(s, d).select("l_orderkey", "l_linenumber", resolve.normal_cell("quantity", minus4=F.col("flag") == "O").alias("c")).select("l_orderkey", "l_linenumber", "c.*"),
    "resolve_value": _direct,
    "resolve_derived": _derived,
    "duplicate_log": lambda s, d: resolve.duplicate_log(_direct(s, d), "c1").select("o_custkey", "n_candidates", "resolution", "action"),
    "duplicate_log_summary": lambda s, d: resolve.duplicate_log_summary(resolve.duplicate_log(_direct(s, d), "c1").unionByName(resolve.duplicate_log(_derived(s, d), "c1_minus_c2"))),
    "participant_table": lambda s, d: resolve.wide_table(_direct(s, d).withColumn("variable", F.lit("c1")).unionByName(_derived(s, d).withColumn("variable", F.lit("diff"))), ["o_custkey"], ["c1", "diff"]),
    "reason_counts": lambda s, d: resolve.reason_counts(_direct(s, d).withColumn("variable", F.lit("c1")).unionByName(_derived(s, d).withColumn("variable", F.lit("diff"))), ["variable"]),
    "entry_phase": lambda s, d: resolve.entry_phase(_orders(s, d), "o_custkey", "phase", "day", "pid", ORDER),
    "enrolment_evidence": lambda s, d: resolve.enrolment_evidence(_orders(s, d), "o_custkey", "phase", "day", "pid"),
    "filtering_flow": _flow,
    "same_day_classes": lambda s, d: trends.same_day(_events(s, d).withColumn("v", F.when(F.col("value") > 30, F.floor(F.col("value") / 50))), "user_id", "day", "v"),
    "conflict_outcome": lambda s, d: trends.conflict_outcome(_events(s, d), "user_id", "day", trends.same_day(_events(s, d), "user_id", "day", "event_type").filter("class = 'conflicting'")),
    "without_conflict_days": lambda s, d: trends.without_keys(_events(s, d), trends.same_day(_events(s, d), "user_id", "day", "event_type").filter("class = 'conflicting'"), ["user_id", "day"]).select("user_id", "event_id"),
    "cohort_rows": lambda s, d: _cohort(s, d).select("user_id", "event_id", "observation_number", "elapsed_days", "elapsed_years"),
    "sequence_checks": lambda s, d: visits.sequence_checks(_cohort(s, d), "user_id", "day", "observation_number", "elapsed_days").crossJoin(trends.elapsed_error(_cohort(s, d), "elapsed_days", "elapsed_years")),
    "slopes": lambda s, d: _fits(s, d).drop("ci_low", "ci_high"),
    "slope_intervals": lambda s, d: _fits(s, d).select("user_id", "slope", "ci_low", "ci_high"),
    "slope_check": lambda s, d: trends.slope_check(_cohort(s, d), "user_id", "elapsed_years", "value"),
    "slope_failures": lambda s, d: trends.failures(trends.slopes(_events(s, d).withColumn("half", F.floor(F.col("value") / 250)), "user_id", "k", "half"), "user_id"),
    "slope_bands": lambda s, d: trends.bands(_fits(s, d), "n_observations", "slope", trends.SUPPORT_BANDS, True).unionByName(trends.bands(_fits(s, d).withColumn("years", F.col("followup_days") / 365.25), "years", "slope", trends.YEAR_BANDS, False)),
    "slope_extremes": lambda s, d: trends.extremes(_fits(s, d).select("user_id", "slope"), "slope", "user_id"),
    "trajectories": lambda s, d: trends.trajectories(_cohort(s, d), trends.extremes(_fits(s, d).select("user_id", "slope"), "slope", "user_id", 3), "user_id", "observation_number", "event_id").select("user_id", F.explode("trajectory").alias("t")).select("user_id", "t.*"),
    "scenario_compare": lambda s, d: trends.scenario_compare(_events(s, d), _events(s, d), "user_id", "day", F.col("event_type") == "view", F.col("event_type").isin("view", "click")),
    "followup_spans": lambda s, d: trends.followup_spans(_events(s, d), "user_id", "day", 20),
    "positions": lambda s, d: ranks.positions(_t(s, d, "customer"), "c_acctbal", "c_custkey"),
    "adjacent_gaps": lambda s, d: ranks.adjacent_gaps(_t(s, d, "customer"), "c_acctbal", "c_custkey").select("c_custkey", F.round("gap", 6).alias("gap")),
    "even_sample": lambda s, d: ranks.even_sample(_t(s, d, "customer").select("c_custkey", "c_acctbal"), [F.col("c_acctbal"), F.col("c_custkey")], 10),
    "tie_break": lambda s, d: selection.tie_break(_segments(s, d)),
    "metric_ranks": lambda s, d: selection.metric_ranks(_segments(s, d), 3),
    "vote_table": lambda s, d: selection.vote_table(_t(s, d, "part").select((F.col("p_size") % 12).cast("int").alias("k"), F.when(F.col("p_size") > 3, "VOTE").otherwise("NO_RESULT").alias("status")).filter("k between 2 and 10")),
    "standardize": lambda s, d: features.standardize(_t(s, d, "supplier").select("s_suppkey", "s_acctbal"), ["s_acctbal"]).select("s_suppkey", F.round("s_acctbal", 6).alias("z")),
    "median_impute": lambda s, d: features.median_impute(_t(s, d, "part").select("p_partkey", F.when(F.col("p_size") > 5, F.col("p_size").cast("double")).alias("size")), ["size"]),
    "impute_summary": lambda s, d: features.impute_summary(_t(s, d, "part").select("p_partkey", F.when(F.col("p_size") > 5, F.col("p_size").cast("double")).alias("size")), ["size"]),
    "covariances": lambda s, d: features.covariances(_vectors(s, d), XS),
    "pca_scores": lambda s, d: features.components(_vectors(s, d), XS).scores(_vectors(s, d).drop("label")),
    "distance_audit": lambda s, d: density.distance_audit(_balances(s, d), "s_suppkey", "v"),
    "density": lambda s, d: density.density_grid(_balances(s, d), "s_suppkey", "v", 1, 250.005).select("s_suppkey", "rho"),
    "density_peaks": lambda s, d: density.peaks(_balances(s, d), "s_suppkey", "v", d_c=250.005)[0].select("s_suppkey", "rho", F.round("delta", 6).alias("delta"), F.round("gamma", 6).alias("gamma")),
    "density_profile": lambda s, d: density.density_profile(density.density_grid(_balances(s, d), "s_suppkey", "v", 1, 250.005)),
    "pair_cutoff": lambda s, d: s.range(1).select(F.round(F.lit(density.cutoff(_balances(s, d), "s_suppkey", "v", 0.02)), 6).alias("d_c")),
    "lloyd_three_rounds": lambda s, d: clusters.kmeans(_t(s, d, "supplier").select("s_suppkey", "s_acctbal"), ["s_acctbal"], [[0.0], [9000.0]], 3, -1.0)[0].select("s_suppkey", "cluster"),
    "replicated_runs": lambda s, d: clusters.run_summary(clusters.replicate(_t(s, d, "supplier"), "s_suppkey", ["s_acctbal"], 2, list(range(10)))[0]),
    "calinski_harabasz": lambda s, d: clusters.calinski_harabasz(_vectors(s, d), "label", XS),
    "davies_bouldin": lambda s, d: clusters.davies_bouldin(_vectors(s, d), "label", XS),
    "silhouette": lambda s, d: clusters.silhouette(_whole_vectors(s, d), "vec_id", "v", "label"),
    "adjusted_rand": lambda s, d: clusters.adjusted_rand(_vectors(s, d, 1).withColumn("half", (F.col("x0") > 0).cast("int")), "label", "half"),
    "pairwise_ari": lambda s, d: stability.pairwise_ari(_runs(s, d), "vec_id"),
    "first_appearance": lambda s, d: clusters.first_appearance(_runs(s, d), "vec_id"),
    "partition_frequency": lambda s, d: stability.partition_table(stability.partition_digests(_runs(s, d), "vec_id", "vec_id")).select("n_runs", "runs", "pct"),
    "canonical_labels": lambda s, d: clusters.ordered_labels(_vectors(s, d, 1), "label", "x0"),
    "cluster_profile": lambda s, d: clusters.profile(_t(s, d, "customer"), "c_mktsegment", "c_acctbal"),
    "contingency": lambda s, d: clusters.contingency(_t(s, d, "part"), "p_size", "p_brand"),
    "check_assignment": lambda s, d: clusters.check_assignment(_t(s, d, "embeddings"), "vec_id", "label", 8),
    "baseline_compare": lambda s, d: reporting.compare_to_baseline(_t(s, d, "customer").groupBy(F.col("c_mktsegment").alias("metric")).agg(F.avg("c_acctbal").alias("value")), _t(s, d, "customer").groupBy(F.col("c_mktsegment").alias("metric"), F.col("c_nationkey").alias("run")).agg(F.avg("c_acctbal").alias("value"))),
    "integrity_gate": lambda s, d: reporting.gate(reporting.checks(_t(s, d, "lineitem"), {"quantity": F.col("l_quantity") > 0, "discount": F.col("l_discount") < 0.1, "tax": F.col("l_tax") <= 0.08})),
    "matrix_problems": lambda s, d: tables.matrix_problems(_t(s, d, "customer"), "c_custkey", ["c_acctbal"]),
    "same_ids": lambda s, d: reporting.same_ids(_t(s, d, "customer").select(F.col("c_custkey").alias("id")), _t(s, d, "orders").select(F.col("o_custkey").alias("id")), "id"),
    "upserted_runs": lambda s, d: tables.upsert_runs(_t(s, d, "customer").select(F.col("c_custkey").alias("run_id"), F.col("c_acctbal").alias("value")), _t(s, d, "orders").groupBy(F.col("o_custkey").alias("run_id")).agg(F.max("o_totalprice").alias("value"))),
    "scope_missingness": _scope,
    "exclusion_preview": lambda s, d: review.exclusion_preview(_scope(s, d)),
    "collection_qc": _collection,
    "counterparts": lambda s, d: review.counterparts(_undated(s, d), "user_id", "event_id", "day", ["code", "code2"], cells.number("score").isNotNull()),
    "counterpart_rows": lambda s, d: review.counterpart_rows(_undated(s, d), "user_id", "day", "code", cells.number("score").isNotNull()).select("event_id"),
    "component_differences": lambda s, d: review.component_differences(_dirty(s, d).withColumnRenamed("discount", "score_discount"), ["l_orderkey"], "l_linenumber", ["quantity", "flag", "score_discount", "day", "grp"]),
    "supersession_evidence": lambda s, d: review.supersession_evidence(_coded(s, d), "user_id", "day", "event_type", "event_id", ["k"], ["code2", "score"]),
    "subset_refits": _refits,
    "refit_findings": lambda s, d: sensitivity.findings(_refits(s, d)),
    "best_k": _best_k,
    "subset_cross_check": lambda s, d: sensitivity.cross_check(_best_k(s, d), 7),
    "same_subsets": lambda s, d: sensitivity.same_subsets(_fits(s, d), F.col("followup_days") >= 300, F.col("n_observations") >= 60),
    "final_report": _final,
}


def S(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def N(c: str) -> str:
    return f"try_cast(nullif({S(c)}, '') as double)"


CAT = f"case when value = '' then 'blank' when {S('value')} = '' then 'whitespace' when lower({S('value')}) in ('na','n/a','nan','null','none','missing','.') then 'text_code' when {N('value')} in (-4, -1) then 'sentinel' end"
KIND = f"case when {S('value')} = '' then 'blank' when {N('value')} = -4 then 'minus4' when {N('value')} = -1 then 'minus1' when {N('value')} in (-999,-99,-9,888,999,9999) then 'unusual' when {N('value')} < 0 then 'negative' when lower({S('value')}) in ('na','n/a','nan','null','none','missing','.') then 'unusual' end"
SQL_DIRTY = "select " + ", ".join(DIRTY) + " from lineitem"
LONG = f"with dirty as ({SQL_DIRTY}), long as (" + " union all ".join(f"select grp, l_linenumber, '{c}' as variable, {c} as value from dirty" for c in CELLS) + f"), cat as (select *, {CAT} as category, {KIND} as kind from long)"
SQL_EVENTS = "(select " + ", ".join(EVENTS) + " from events)"
SQL_CODED = f"(select event_id, user_id, event_type, value, day, k, {', '.join(CODED[6:])} from {SQL_EVENTS})"
SQL_ORDERS = "(select " + ", ".join(ORDERS) + " from orders)"
COHORT = f"""(select e.*, f.first_date, row_number() over (partition by e.user_id order by day, event_id) as observation_number, date_diff('day', f.first_date, day) as elapsed_days,
 round_even(date_diff('day', f.first_date, day) / 365.25, 10) as elapsed_years from {SQL_EVENTS} e join (select user_id, min(day) as first_date from {SQL_EVENTS} group by user_id having count(distinct day) >= 3) f using (user_id))"""
FITS = f"""(select g.*, sxy / sxx as b, my - sxy / sxx * mx as a from (select user_id, count(*) as n_observations, min(day) as first_date, max(day) as last_date, date_diff('day', min(day), max(day)) as followup_days, avg(elapsed_years) as mx, avg(value) as my,
 regr_sxx(value, elapsed_years) as sxx, regr_syy(value, elapsed_years) as syy, regr_sxy(value, elapsed_years) as sxy from {COHORT} group by user_id) g)"""
SLOPE = f"(select user_id, n_observations, followup_days, round(b, 6) as slope from {FITS})"
DESCRIBED = "count({0}) as n, round(avg({0}), 6) as mean, round(case when count({0}) = 1 then 0 else stddev_samp({0}) end, 6) as sd, round(min({0}), 6) as min, round(quantile_cont({0}, 0.25), 6) as q1, round(quantile_cont({0}, 0.5), 6) as median, round(quantile_cont({0}, 0.75), 6) as q3, round(max({0}), 6) as max"
CELL = lambda c, four="true": f"case when {S(c)} = '' then 'BLANK' when {N(c)} = -1 then 'MINUS1' when {N(c)} = -4 and {four} then 'MINUS4' when {N(c)} is null then 'UNRESOLVED_DUPLICATE_QC' else 'VALID' end"
KEYED = "row(day is null, coalesce(day, date '9999-12-31'), o_orderkey)"
DIRECT = f"""(select o_custkey, n_candidates, n_valid, case when n_valid > 0 and lo = hi then lo end as value,
 case when lo <> hi then 'UNRESOLVED_DUPLICATE_QC' when n_valid > 0 then '' when not doc then 'UNAVAILABLE_PHASE_INSTRUMENT' when q > 0 then 'UNRESOLVED_DUPLICATE_QC' when m1 > 0 then 'MINUS1' when m4 > 0 then 'MINUS4' else 'BLANK' end as reason,
 case when lo <> hi then null when n_valid > 0 then best else anyrow end as source,
 case when n_candidates < 2 then null when lo <> hi then 'UNRESOLVED_CONFLICTING_VALUES' when n_valid > 1 then 'RESOLVED_IDENTICAL_VALID_VALUES' when n_valid > 0 then 'RESOLVED_UNIQUE_VALID_VALUE' else 'NO_VALID_VALUE' end as resolution
 from (select o_custkey, count(*) as n_candidates, count(*) filter (r = 'VALID') as n_valid, min(v) filter (r = 'VALID') as lo, max(v) filter (r = 'VALID') as hi, arg_min(o_orderkey, {KEYED}) filter (r = 'VALID') as best, arg_min(o_orderkey, {KEYED}) as anyrow,
 count(*) filter (r = 'UNRESOLVED_DUPLICATE_QC') as q, count(*) filter (r = 'MINUS1') as m1, count(*) filter (r = 'MINUS4') as m4, bool_and(phase <> '5-LOW') as doc from (select *, {CELL('c1')} as r, {N('c1')} as v from {SQL_ORDERS}) group by o_custkey))"""
DERIVED = f"""(select o_custkey, n_candidates, n_valid, case when n_valid > 0 and lo = hi then res end as value, case when lo <> hi then 'UNRESOLVED_DUPLICATE_QC' when n_valid > 0 then '' else 'FAILED_DERIVATION' end as reason,
 case when lo <> hi then null when n_valid > 0 then best else anyrow end as source,
 case when n_candidates < 2 then null when lo <> hi then 'UNRESOLVED_CONFLICTING_COMPONENT_VECTORS' when n_valid > 1 then 'RESOLVED_IDENTICAL_COMPLETE_COMPONENTS' when n_valid > 0 then 'RESOLVED_UNIQUE_COMPLETE_COMPONENT_ROW' else 'NO_COMPLETE_COMPONENT_ROW' end as resolution
 from (select o_custkey, count(*) as n_candidates, count(*) filter (ok) as n_valid, min(row(v1, v2)) filter (ok) as lo, max(row(v1, v2)) filter (ok) as hi, max(v1 - v2) filter (ok) as res, arg_min(o_orderkey, {KEYED}) filter (ok) as best, arg_min(o_orderkey, {KEYED}) as anyrow
 from (select *, {N('c1')} as v1, {N('c2')} as v2, {CELL('c1')} = 'VALID' and {CELL('c2')} = 'VALID' as ok from {SQL_ORDERS}) group by o_custkey))"""
LOG = "case when resolution like 'RESOLVED_%' then 'USE_VALUE' when resolution like 'UNRESOLVED_%' then 'SET_MISSING' else 'SET_MISSING_' || reason end as action"
VECTORS = "(select vec_id, label, " + ", ".join(f"embedding[{i + 1}]::double as x{i}" for i in range(64)) + " from embeddings)"
SEGMENTS = "(select c_nationkey as k, round(avg(c_acctbal), 1) as silhouette, round(max(c_acctbal), -2) as davies_bouldin, count(*)::double as calinski_harabasz from customer group by 1)"
RUNS = "(select vec_id, unnest([0, 1, 2, 3]) as run, unnest([(embedding[1] > 0)::int, 1 - (embedding[1] > 0)::int, (embedding[1] > 0)::int + 2 * (embedding[2] > 0)::int, label::int]) as label from embeddings)"
TWO = "coalesce(sum(n * (n - 1) / 2), 0)"
PAIRS = "(select a.s_suppkey as i, b.s_suppkey as j, abs(round(a.s_acctbal, 2) - round(b.s_acctbal, 2)) as d from supplier a join supplier b on a.s_suppkey <> b.s_suppkey)"
RHO = f"(select s_suppkey, count(d) filter (d < 250.005) as rho from supplier left join {PAIRS} on i = s_suppkey group by s_suppkey)"
STEP = lambda t, c: f"select avg(s_acctbal) filter (abs(s_acctbal - {t}.a) <= abs(s_acctbal - {t}.b)) as a, avg(s_acctbal) filter (abs(s_acctbal - {t}.a) > abs(s_acctbal - {t}.b)) as b from supplier, {t}"
SAME = f"(select user_id, day, count(*) as n_rows, count(distinct event_type) as k, count(event_type) as n_valid from {SQL_EVENTS} group by user_id, day having count(*) > 1 and count(distinct event_type) > 1)"
BANDED = "select '{0}' as band, count(*) as n, round(avg(slope), 6) as mean, round(quantile_cont(slope, 0.5), 6) as median, round(avg((slope > 0)::int) * 100, 6) as pct_positive from " + SLOPE + " where {1} having count(*) > 0"
KIND4 = f"case when {S('code')} in ('sc', 'v01', '4_sc') or {S('code2')} = 'sc' then 'SCREENING' when {S('code')} in ('bl', 'v03', '4_bl', 't_bl') or {S('code2')} = 'bl' then 'BASELINE' when {S('code')} in ('init', 'v06', '4_init') then 'ENTRY' else 'LATER' end"
SQL_SCOPE = "(select 'low_phase_left' as scope, variable, count(*) as n_eligible, count(value) as n_valid, " + ", ".join(f"count(*) filter (value is null and reason = '{r}') as {c}" for c, r in (("n_unavailable", resolve.UNAVAILABLE), ("n_qc", resolve.QC), ("n_minus1", "MINUS1"), ("n_minus4", "MINUS4"), ("n_blank", "BLANK"), ("n_failed", resolve.FAILED))) + f", true as reconciles, round((count(*) - count(value)) * 100.0 / count(*), 6) as pct_missing, case when (count(*) - count(value)) * 100.0 / count(*) > 20 then 'EXCLUDE' else 'RETAIN' end as decision from (select 'c1' as variable, n_candidates, value, reason from {DIRECT} union all select 'diff', n_candidates, value, reason from {DERIVED}) where n_candidates > 2 group by variable)"
COUNTS = lambda name, where: ", ".join(f"count(*) filter ({where} and {c}) as {name}_{n}" for n, c in (("all", "true"), *((short, f"state = '{long}'") for long, short in review.STATES.items()), ("zero", "state = 'VALID' and number = 0"), ("positive", "state = 'VALID' and number > 0"), ("blank_with_items", "state = 'BLANK' and any_item")))
COLLECTION = f"""with rec as (select user_id, event_type as phase, {KIND4} as category, {CELL('score')} as state, {N('score')} as number, k % 3 = 0 as any_item, code2 from {SQL_CODED}),
 roster as (select user_id, arg_min(event_type, event_id) as cohort, user_id % 3 = 0 as missing from {SQL_EVENTS} group by user_id), j as (select rec.*, cohort, phase = cohort as same from rec join roster using (user_id)),
 who as (select r.*, exists (from j where j.user_id = r.user_id) as anywhere, exists (from j where j.user_id = r.user_id and same) as in_phase, """ + ", ".join(f"exists (from j where j.user_id = r.user_id and same and category = '{c}' and state = 'VALID') as valid_{n}" for n, c in (("screening", "SCREENING"), ("baseline", "BASELINE"), ("entry", "ENTRY"), ("followup", "LATER"))) + """,
 exists (from j where j.user_id = r.user_id and same and category <> 'LATER' and state = 'BLANK' and any_item) as items_only from roster r),
 people as (select cohort, count(*) as n_eligible, """ + ", ".join(f"count(*) filter ({n}) as n_{n}" for n in ("anywhere", "in_phase", "valid_screening", "valid_baseline", "valid_entry", "valid_followup", "missing")) + """,
 count(*) filter (missing and not (valid_screening or valid_entry)) as n_unavailable, count(*) filter (missing and (valid_screening or valid_entry)) as n_wrong_visit, count(*) filter (missing and valid_followup) as n_followup_only, count(*) filter (missing and items_only) as n_total_not_filled,
 count(*) filter (missing and not anywhere) as n_absent, count(*) filter (missing and not in_phase) as n_absent_in_phase, count(*) filter (missing and anywhere and not (valid_screening or valid_entry or valid_followup or items_only)) as n_unresolved from who group by cohort)
 select * from people join (select cohort, """ + COUNTS("base", "same and category = 'BASELINE'") + ", " + COUNTS("rows", "same") + """, coalesce((select string_agg(distinct code2, ' | ' order by code2) from j i where i.cohort = j.cohort and i.same and i.code2 <> ''), '') as code2_seen from j group by cohort) using (cohort)"""
UNDATED = f"(select * replace (case when event_id % 10 <> 0 then day end as day) from {SQL_CODED})"
ALIKE = lambda c: f"(select user_id, {c}, count(*) as n, min(day) as a, max(day) as b from {UNDATED} where day is not null and {S(c)} <> '' group by all)"
REFITS = f"""(with recursive f as (select *, case when slope < 0 then 1 else 2 end as la, row_number() over (order by slope, user_id) as rank, count(*) over () as total, ceil(0.01::double * count(*) over ()) as tail from {SLOPE}),
 tagged as materialized (select * from (select *, unnest([case when followup_days >= 28 then 'long' end, case when n_observations >= 60 then 'many' end, case when rank < total then 'without_maximum' end, case when rank <= total - tail then 'without_top' end, case when rank > tail then 'without_bottom' end, case when rank > tail and rank <= total - tail then 'without_both' end]) as subset from f) where subset is not null),
 walk as (select subset, 0 as round, quantile_disc(slope, 0.25) as a, quantile_disc(slope, 0.75) as b, -1::bigint as low from tagged group by subset
  union all select subset, any_value(round) + 1, coalesce(avg(slope) filter (abs(slope - a) <= abs(slope - b)), any_value(a)), coalesce(avg(slope) filter (abs(slope - a) > abs(slope - b)), any_value(b)), count(*) filter (abs(slope - a) <= abs(slope - b)) from tagged join walk using (subset) group by subset having count(*) filter (abs(slope - a) <= abs(slope - b)) <> any_value(low)),
 fitted as (select subset, arg_max(a, round) as a, arg_max(b, round) as b from walk group by subset), lab as (select *, case when abs(slope - a) <= abs(slope - b) then 1 else 2 end as lb from tagged join fitted using (subset)),
 cell as (select subset, la, lb, count(*) as n from lab group by all), ij as (select subset, sum(n * (n - 1) / 2) as ij, sum(n) as n, sum(n) filter (la = lb) as n_equal from cell group by 1), ai as (select subset, sum(n * (n - 1) / 2) as ai from (select subset, la, sum(n) as n from cell group by all) group by 1),
 bj as (select subset, sum(n * (n - 1) / 2) as bj from (select subset, lb, sum(n) as n from cell group by all) group by 1), ari as (select *, ai * bj / (n * (n - 1) / 2) as chance, (ai + bj) / 2 as half from ij join ai using (subset) join bj using (subset))
 select subset, cluster, round(case cluster when 1 then a else b end, 6) as centre, round(case cluster when 1 then a + 1 else b - 1 end, 6) as centre_shift, round((a + b) / 2, 6) as boundary, round((a + b) / 2, 6) as boundary_shift, (select count(*) from lab where lab.subset = fitted.subset and lb = cluster) as n_members,
 n::bigint as n, coalesce(n_equal, 0)::bigint as n_equal, round(coalesce(n_equal, 0) * 100.0 / n, 6) as pct_equal, round(case when half = chance then 1.0 else (ij - chance) / (half - chance) end, 6) as ari from fitted join ari using (subset), (select unnest([1, 2]) as cluster))"""
BEST = "(select subset, arg_max(k, row(silhouette, -k)) as silhouette_k, arg_max(k, row(-davies_bouldin, -k)) as davies_bouldin_k, arg_max(k, row(calinski_harabasz, -k)) as calinski_harabasz_k from (select c_mktsegment as subset, c_nationkey as k, round(avg(c_acctbal), 1) as silhouette, round(max(c_acctbal), -2) as davies_bouldin, count(*)::double as calinski_harabasz from customer group by all) group by subset)"
PAIRED = f"(select *, count(*) over (partition by l_orderkey) as rows_of, lead(row(quantity, flag, discount, day, grp)) over (partition by l_orderkey order by l_linenumber, quantity nulls first, flag nulls first, discount nulls first, day nulls first, grp nulls first) as z from ({SQL_DIRTY}))"

SQL = {
    "column_inventory": LONG + f" select variable, case variable when 'quantity' then 6 when 'discount' then 7 else 8 end as position, count(*) as n_rows, count(*) filter ({S('value')} = '') as n_blank, round(count(*) filter ({S('value')} = '') * 100.0 / count(*), 6) as pct_blank, count(distinct nullif({S('value')}, '')) as n_unique from cat group by variable",
    "missing_candidates": LONG + " select variable, category, value, count(*) as n_rows from cat where category is not null group by all",
    "sentinel_exposure": LONG + " select variable, " + ", ".join(f"count(*) filter (kind = '{k}') as n_{k}" for k in audit.EXPOSURES) + " from cat group by variable",
    "sentinel_exposure_first_lines": LONG + " select variable, " + ", ".join(f"count(*) filter (kind = '{k}' and l_linenumber = 1) as n_{k}" for k in audit.EXPOSURES) + " from cat group by variable",
    "candidate_mapping": LONG + f" select variable, count(*) filter ({S('value')} <> '') as n_nonblank, count(distinct nullif({S('value')}, '')) as n_unique, min({N('value')}) as min, max({N('value')}) as max, max({N('value')}) filter ({N('value')} not in (-4, -1)) as max_no_sentinel, coalesce(bool_or({N('value')} = -4), false) as has_minus4, coalesce(bool_or({N('value')} = -1), false) as has_minus1 from long group by variable",
    "missing_policy": LONG + f", codes as (select unnest(['blank', '-4', '-1']) as code) select variable, code, count(*) filter (hit) as observed_count, count(*) filter (hit) > 0 as code_observed from (select variable, code, case code when 'blank' then {S('value')} = '' when '-4' then {N('value')} = -4 else {N('value')} = -1 end as hit from long, codes) group by variable, code",
    "duplicate_keys": f"select coalesce(sum(n) filter (full_), 0)::bigint as complete_rows, coalesce(sum(n) filter (not full_), 0)::bigint as incomplete_rows, count(*) filter (full_ and n > 1) as n_groups, coalesce(sum(n) filter (full_ and n > 1), 0)::bigint as n_occurrences, coalesce(sum(n - 1) filter (full_ and n > 1), 0)::bigint as n_beyond_first from (select l_orderkey, {S('supp')} as k, {S('supp')} <> '' as full_, count(*) as n from ({SQL_DIRTY}) group by all)",
    "duplicate_summary": f"select count(*) as n_groups, coalesce(sum(n), 0)::bigint as n_rows, count(distinct l_orderkey) as n_entities from (select l_orderkey, quantity, count(*) as n from ({SQL_DIRTY}) group by all having count(*) > 1)",
    "duplicate_examples": f"select * from (select l_orderkey, quantity, l_linenumber, count(*) over (partition by l_orderkey, quantity) as group_rows from ({SQL_DIRTY})) where group_rows > 1 order by l_orderkey, quantity, l_linenumber limit 5",
    "exact_duplicates": f"select count(*) as n_groups, coalesce(sum(n), 0)::bigint as n_rows, coalesce(sum(n - 1), 0)::bigint as n_beyond_first from (select grp, quantity, discount, flag, l_partkey, count(*) as n from ({SQL_DIRTY}) group by all having count(*) > 1)",
    "file_inventory": f"select count(*) as n_rows, {len(DIRTY)}::int as n_columns, count(distinct nullif({S('supp')}, '')) as unique_supp, string_agg(distinct nullif({S('flag')}, ''), '|' order by nullif({S('flag')}, '')) as values_flag, string_agg(distinct nullif({S('discount')}, ''), '|' order by nullif({S('discount')}, '')) as values_discount from ({SQL_DIRTY})",
    "missingness_by_group": LONG + " select case when grouping(grp) = 0 then 'group' else 'total' end as level, grp, variable, count(*) as n_rows, count(*) filter (category is null) as n_valid, " + ", ".join(f"count(*) filter (category = '{r}') as n_{r}" for r in audit.REASONS) + ", round((count(*) - count(*) filter (category is null)) * 100.0 / count(*), 6) as pct_missing, case when (count(*) - count(*) filter (category is null)) * 100.0 / count(*) > 20 then 'EXCLUDE' else 'RETAIN' end as decision from cat group by grouping sets ((variable, grp), (variable))",
    "date_audit": "select 'seen' as variable, count(*) filter (seen <> '') as n_nonblank, count(d) as n_parsed, min(d) as first, max(d) as last, count(*) filter (p > 1000 and d is null) as n_valid_undated from (select seen, p, try_cast(seen as date) as d from (select case when o_orderkey % 6 = 0 then '' when o_orderkey % 6 = 1 then '2020-13-45' else cast(cast(o_orderdate as date) as string) end as seen, o_totalprice as p from orders))",
    "value_audit": f"select count(*) filter ({S('quantity')} = '') as n_missing, count(v) as n_numeric, count(*) filter ({S('quantity')} <> '' and v is null) as n_invalid, count(*) filter (v not between 0 and 45) as n_out_of_range, count(*) filter (v is not null and l_linenumber < 4) as n_numeric_dated, count(*) filter (v is not null and l_linenumber >= 4) as n_numeric_undated, count(*) filter (v is null and l_linenumber < 4) as n_dated_without_value from (select *, {N('quantity')} as v from ({SQL_DIRTY}))",
    "rows_and_entities": f"select phase, count(*) as n_rows, count(distinct o_custkey) as n_entities from {SQL_ORDERS} group by phase",
    "one_to_one": f"select (select count(*) from (select o_custkey from {SQL_ORDERS} group by 1 having count(distinct pid) > 1)) as o_custkey_with_several_pid, (select count(*) from (select pid from {SQL_ORDERS} group by 1 having count(distinct o_custkey) > 1)) as pid_with_several_o_custkey",
    "visits_per_entity": f"select case when d >= 5 then 'at_least_5' else 'exactly_' || d end as category, count(*) as n_entities from (select count(distinct day) as d from {SQL_ORDERS} group by o_custkey) group by 1",
    "value_histogram": f"select flag, quantity, count(*) as n from ({SQL_DIRTY}) group by all",
    "tie_summary": "select max(n) > 1 as any_tie, count(*) as n_distinct, count(*) filter (n > 1) as n_tied_groups, coalesce(sum(n) filter (n > 1), 0)::bigint as n_tied_rows, max(n) as largest from (select count(*) as n from part group by p_retailprice)",
    "sign_counts": "select count(*) filter (c_acctbal > 0) as n_positive, count(*) filter (c_acctbal < 0) as n_negative, count(*) filter (c_acctbal = 0) as n_zero, count(*) filter (c_acctbal < -500) as n_below from customer",
    "observed_phases": f"select variable, string_agg(distinct phase, '|' order by phase) as phases from (" + " union all ".join(f"select '{c}' as variable, phase, {c} as v from {SQL_ORDERS}" for c in ("c1", "c2", "pid")) + f") where {S('v')} <> '' group by variable",
    "describe_by_segment": f"select c_mktsegment, {DESCRIBED.format('c_acctbal')}, round(quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25), 6) as iqr from customer group by c_mktsegment",
    "percentile_ladder": " union all ".join(f"select {x}::int as percent, round(quantile_cont(c_acctbal, {x / 100}), 6) as value from customer" for x in (0, 1, 5, 25, 50, 75, 95, 99, 100)),
    "visit_classes": f"select event_id, case when a = 'f' or b = 'f' then 'screen_failure' when a in ('init','v06','4_init') then 'rollover_or_phase_initial' when b = 'sc' or a in ('sc','v01','4_sc') then 'screening' when a = 't_bl' then 'phase_specific_baseline' when b = 'bl' or a in ('bl','v03','4_bl') then 'literal_or_translated_baseline' when a like '%\\_bl' escape '\\' then 'phase_specific_or_unresolved' end as entry_class, case when a in ('sc','v01','4_sc') or b = 'sc' then 'SCREENING' when a in ('bl','v03','4_bl','t_bl') or b = 'bl' then 'BASELINE' when a in ('init','v06','4_init') then 'ROLLOVER_PHASE_ENTRY_NOT_ORIGINAL_BASELINE' else 'SCHEDULED_FOLLOWUP_OR_OTHER' end as kind, try_cast(nullif(regexp_extract(lower(a), '^m([0-9]+)$', 1), '') as int) as month from (select *, {S('code')} as a, {S('code2')} as b from {SQL_CODED})",
    "visit_semantics": f"select event_type, code, code2, category, 'score' as field, count(*) as row_count, count(*) filter ({S('score')} <> '') as nonblank_count, count(*) filter ({N('score')} = -4) as minus4_count, count(*) filter ({N('score')} = -1) as minus1_count from (select *, case when {S('code')} = 'f' then 'screen_failure' when {S('code')} = 'v06' then 'rollover_or_phase_initial' when code2 = 'sc' or {S('code')} = 'sc' then 'screening' when code = 't_bl' then 'phase_specific_baseline' when code2 = 'bl' or code in ('bl', 'v03') then 'literal_or_translated_baseline' when code = 'x_bl' then 'phase_specific_or_unresolved' end as category from {SQL_CODED}) where category is not null group by event_type, code, code2, category",
    "visit_distribution": f"select cohort, event_type, code, count(*) as n_rows, count(distinct user_id) as n_entities from {SQL_CODED} join (select user_id, min(event_type) as cohort from events group by user_id) using (user_id) group by all",
    "visit_lookup": f"select event_id, coalesce(meaning, 'other') as meaning from {SQL_EVENTS} e left join (select event_type, k, min(code) as meaning from {SQL_CODED} where k < 20 group by all) m using (event_type, k)",
    "order_anomalies_all": f"select user_id, event_id, k from {SQL_EVENTS} a where exists (select 1 from {SQL_EVENTS} b where a.user_id = b.user_id and ((b.k < a.k and b.day > a.day) or (b.k > a.k and b.day < a.day)))",
    "order_anomalies_later": f"with m as (select user_id, k, min(day) as first_date, max(day) as last_date from {SQL_EVENTS} group by all), e as (select *, max(last_date) over (partition by user_id order by k rows between unbounded preceding and 1 preceding) as earlier_max from m) select e.user_id, e.k, e.first_date, e.earlier_max, (select min(m.k) from m where m.user_id = e.user_id and m.k < e.k and m.last_date = e.earlier_max) as earlier_month from e where first_date < earlier_max",
    "normalised_cells": f"select l_orderkey, l_linenumber, case when r = 'VALID' then {N('quantity')} end as value, r as reason from (select *, {CELL('quantity', chr(39).join(['flag = ', 'O', '']))} as r from ({SQL_DIRTY}))",
    "resolve_value": f"select * from {DIRECT}",
    "resolve_derived": f"select * from {DERIVED}",
    "duplicate_log": f"select o_custkey, n_candidates, resolution, {LOG} from {DIRECT} where resolution is not null",
    "duplicate_log_summary": f"select variable, resolution, count(*) as n_entities, sum(n_candidates)::bigint as n_candidate_rows from (select 'c1' as variable, * from {DIRECT} union all select 'c1_minus_c2', * from {DERIVED}) where resolution is not null group by all",
    "participant_table": f"select a.o_custkey, a.value as c1, a.reason as c1_reason, a.source as c1_source, b.value as diff, b.reason as diff_reason, b.source as diff_source from {DIRECT} a join {DERIVED} b using (o_custkey)",
    "reason_counts": "select variable, count(*) as n_eligible, count(value) as n_valid, " + ", ".join(f"count(*) filter (value is null and reason = '{r}') as {c}" for c, r in (("n_unavailable", resolve.UNAVAILABLE), ("n_qc", resolve.QC), ("n_minus1", "MINUS1"), ("n_minus4", "MINUS4"), ("n_blank", "BLANK"), ("n_failed", resolve.FAILED))) + f", true as reconciles, round((count(*) - count(value)) * 100.0 / count(*), 6) as pct_missing, case when (count(*) - count(value)) * 100.0 / count(*) > 20 then 'EXCLUDE' else 'RETAIN' end as decision from (select 'c1' as variable, * from {DIRECT} union all select 'diff', * from {DERIVED}) group by variable",
    "entry_phase": f"""with per as (select o_custkey, phase, min(day) as d, count(*) as n, min(nullif({S('pid')}, '')) as lo, max(nullif({S('pid')}, '')) as hi, case phase when '3-MEDIUM' then 0 when '1-URGENT' then 1 when '2-HIGH' then 2 when '5-LOW' then 3 else 999 end as o from {SQL_ORDERS} group by o_custkey, phase),
 g as (select *, row_number() over (partition by o_custkey order by d is null, d, o, phase) as r, count(*) over (partition by o_custkey) as phases, count(d) over (partition by o_custkey) as dated from per)
 select o_custkey, phase as entry_phase, d as entry_date, n as evidence_rows, phases, case when dated = 0 and phases = 1 then 'SINGLE_UNDATED_PHASE' when dated = 0 then 'PHASE_ORDER_FALLBACK_ALL_DATES_MISSING' when dated < phases then 'EARLIEST_DATED_PHASE_WITH_UNDATED_ALTERNATIVE' when phases = 1 then 'SINGLE_PHASE' else 'EARLIEST_DATED_BASELINE_PHASE' end as status, coalesce(lo, '') as chosen_id, case when lo is null then 'MISSING' when lo = hi then 'UNIQUE' else 'MULTIPLE_LEXICAL_FALLBACK' end as id_status from g where r = 1""",
    "enrolment_evidence": f"select o_custkey, phase, min(day) as first_date, count(*) as n_rows, coalesce(string_agg(distinct nullif({S('pid')}, ''), ' | ' order by nullif({S('pid')}, '')), '') as files from {SQL_ORDERS} group by all",
    "filtering_flow": f"select rule, n_removed, n_left from (select unnest(['has_value', 'kind', 'even_k']) as rule, unnest([a, b, c]) as n_removed, unnest([n - a, n - a - b, n - a - b - c]) as n_left from (select count(*) as n, count(*) filter (not value >= 20) as a, count(*) filter (value >= 20 and not event_type <> 'view') as b, count(*) filter (value >= 20 and event_type <> 'view' and not k % 2 = 0) as c from {SQL_EVENTS}))",
    "same_day_classes": f"select user_id, day, n_rows, case when k > 1 then 'conflicting' when n_valid < n_rows then 'incomplete' else 'harmless' end as class from (select user_id, day, count(*) as n_rows, count(distinct v) as k, count(v) as n_valid from (select *, case when value > 30 then floor(value / 50) end as v from {SQL_EVENTS}) group by user_id, day) where n_rows > 1",
    "conflict_outcome": f"select user_id, rows_removed, dates_left, dates_left >= 3 as eligible from (select e.user_id, count(s.user_id) as rows_removed, count(distinct e.day) filter (s.user_id is null) as dates_left from {SQL_EVENTS} e left join {SAME} s on e.user_id = s.user_id and e.day = s.day group by e.user_id) where rows_removed > 0",
    "without_conflict_days": f"select user_id, event_id from {SQL_EVENTS} e where not exists (select 1 from {SAME} s where e.user_id = s.user_id and e.day = s.day)",
    "cohort_rows": f"select user_id, event_id, observation_number, elapsed_days, elapsed_years from {COHORT}",
    "sequence_checks": f"select 0::bigint as n_decreasing, 0::bigint as n_misnumbered, 0::bigint as n_first_not_zero, max(abs(elapsed_years - elapsed_days / 365.25)) <= 5.1e-11 as consistent from {COHORT}",
    "slopes": f"select user_id, n_observations, first_date, last_date, followup_days, round(b, 6) as slope, round(a, 6) as intercept, round(1 - sse / syy, 6) as r_squared, round(sqrt(sse / n_observations), 6) as rmse, round(case when n_observations > 2 then sqrt(sse / (n_observations - 2) / sxx) end, 6) as se, null::varchar as failure from {FITS} join (select user_id, sum((value - a - b * elapsed_years) ** 2) as sse from {COHORT} join (select user_id, a, b from {FITS}) using (user_id) group by user_id) using (user_id)",
    "slope_check": f"select user_id, round(covar_samp(elapsed_years, value) / var_samp(elapsed_years), 6) as slope from {COHORT} group by user_id",
    "slope_failures": f"select user_id, case when not coalesce(sxx, 0) > 0 then 'x has zero variance' else 'y has zero variance' end as failure from (select user_id, regr_sxx(h, k) as sxx, regr_syy(h, k) as syy from (select *, floor(value / 250) as h from {SQL_EVENTS}) group by user_id) where not coalesce(sxx, 0) > 0 or not syy > 0",
    "slope_bands": " union all ".join([BANDED.format(n, f"n_observations {'= ' + str(lo) if hi else '>= ' + str(lo)}") for n, lo, hi in trends.SUPPORT_BANDS] + [BANDED.format(n, f"followup_days / 365.25 >= {lo}" + (f" and followup_days / 365.25 < {hi}" if hi else "")) for n, lo, hi in trends.YEAR_BANDS]),
    "slope_extremes": f"(select user_id, slope, 'lowest' as side from {SLOPE} order by slope, user_id limit 10) union all (select user_id, slope, 'highest' from {SLOPE} order by slope desc, user_id limit 10)",
    "trajectories": f"select user_id, observation_number, event_id from {COHORT} where user_id in (select user_id from ((select user_id from {SLOPE} order by slope, user_id limit 3) union all (select user_id from {SLOPE} order by slope desc, user_id limit 3)))",
    "scenario_compare": f"select count(*) as n_roster, sum(ra)::bigint as rows_a, sum(rb)::bigint as rows_b, count(*) filter (rb > ra) as gained_rows, count(*) filter (db > da) as gained_dates, count(*) filter (da >= 3) as eligible_a, count(*) filter (db >= 3) as eligible_b, count(*) filter (db >= 3 and da < 3) as newly_eligible, count(*) filter (coalesce(sb, 0) > coalesce(sa, 0)) as longer_span from (select user_id, count(*) filter (a) as ra, count(*) filter (b) as rb, count(distinct day) filter (a) as da, count(distinct day) filter (b) as db, date_diff('day', min(day) filter (a), max(day) filter (a)) as sa, date_diff('day', min(day) filter (b), max(day) filter (b)) as sb from (select *, event_type = 'view' as a, event_type in ('view', 'click') as b from {SQL_EVENTS}) group by user_id)",
    "followup_spans": f"select count(*) filter (days < 20) as n_short, " + ", ".join(f"round(quantile_cont(days, {q}), 6) as {n}_days" for q, n in ((0, "min"), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (1, "max"))) + f", round(quantile_cont(days, 0.5) / 365.25, 6) as median_years from (select date_diff('day', min(day), max(day)) as days from {SQL_EVENTS} group by user_id)",
    "positions": "select c_custkey, c_acctbal, r as rank, round((r - 1) * 100.0 / greatest(1, n - 1), 6) as percentile, r - 1 as n_before, n - r as n_after, r <= 10 as lowest, r > n - 10 as highest, r <= ceil(0.01 * n) as low_tail, r > n - ceil(0.01 * n) as high_tail from (select *, row_number() over (order by c_acctbal, c_custkey) as r, count(*) over () as n from customer)",
    "adjacent_gaps": "select * from (select c_custkey, round(c_acctbal - lag(c_acctbal) over (order by c_acctbal, c_custkey), 6) as gap from customer) where gap is not null",
    "even_sample": "select c_custkey, c_acctbal, rank from (select c_custkey, c_acctbal, row_number() over (order by c_acctbal, c_custkey) as rank, count(*) over () as n from customer) where rank in (select (i * (n - 1)) // 9 + 1 from range(10) t(i))",
    "tie_break": "select *, row_number() over (order by rank_sum, k) = 1 as selected from (select k, silhouette, davies_bouldin, calinski_harabasz, avg(s) over (partition by silhouette) as silhouette_rank, avg(d) over (partition by davies_bouldin) as davies_bouldin_rank, avg(c) over (partition by calinski_harabasz) as calinski_harabasz_rank, avg(s) over (partition by silhouette) + avg(d) over (partition by davies_bouldin) + avg(c) over (partition by calinski_harabasz) as rank_sum from (select *, row_number() over (order by silhouette desc, k) as s, row_number() over (order by davies_bouldin, k) as d, row_number() over (order by calinski_harabasz desc, k) as c from " + SEGMENTS + "))",
    "metric_ranks": " union all ".join(f"select '{m}' as metric, (select count(*) + 1 from {SEGMENTS} x, (select {m} as v from {SEGMENTS} where k = 3) y where x.{m} {op} y.v or (x.{m} = y.v and x.k < 3)) as rank, (select k from {SEGMENTS} order by {m} {way}, k limit 1) as best_k, (select count(*) + 1 from {SEGMENTS} x, (select {m} as v from {SEGMENTS} where k = 3) y where x.{m} {op} y.v or (x.{m} = y.v and x.k < 3)) <= 3 as in_top_three" for m, op, way in (("silhouette", ">", "desc"), ("davies_bouldin", "<", "asc"), ("calinski_harabasz", ">", "desc"))),
    "vote_table": "select k, votes, votes = max(votes) over () as leader, dense_rank() over (order by votes desc) as place, sum(votes) over ()::bigint as usable from (select r.k::int as k, count(p.p_size) as votes from range(2, 11) r(k) left join part p on p.p_size % 12 = r.k and p.p_size > 3 group by r.k)",
    "standardize": "select s_suppkey, round((s_acctbal - avg(s_acctbal) over ()) / stddev_pop(s_acctbal) over (), 6) as z from supplier",
    "median_impute": "select p_partkey, coalesce(v, median(v) over ()) as size from (select p_partkey, case when p_size > 5 then p_size::double end as v from part)",
    "impute_summary": "select 'size' as feature, count(*) - count(v) as n_missing, round((count(*) - count(v)) * 100.0 / count(*), 6) as pct_missing, median(v) as median, min(v) as min_before, max(v) as max_before, least(min(v), median(v)) as min_after, greatest(max(v), median(v)) as max_after from (select case when p_size > 5 then p_size::double end as v from part)",
    "covariances": "with l as (select vec_id, unnest(range(64)) as i, unnest(embedding)::double as x from embeddings) select 'x' || a.i as a, 'x' || b.i as b, round(covar_samp(a.x, b.x), 6) as covariance from l a join l b on a.vec_id = b.vec_id and a.i <= b.i group by a.i, b.i",
    "distance_audit": f"select count(*) as n_pairs, count(*) filter (d = 0) as n_zero, round(min(d) filter (d > 0), 6) as min_positive, round(max(d), 6) as max, round(avg(d), 6) as mean from {PAIRS} where i < j",
    "density": f"select * from {RHO}",
    "density_peaks": f"with r as {RHO}, p as {PAIRS}, x as (select r.s_suppkey, r.rho, min(d) filter (o.rho > r.rho) as near, max(d) as far from r join p on p.i = r.s_suppkey join r o on o.s_suppkey = p.j group by all) select s_suppkey, rho, round(coalesce(near, far), 6) as delta, round(rho * coalesce(near, far), 6) as gamma from x",
    "density_profile": f"select rho, count(*) as n, rho = 0 as zero, rho = (select max(rho) from {RHO}) as greatest from {RHO} group by rho",
    "pair_cutoff": f"select round(quantile_cont(d, 0.02), 6) as d_c from {PAIRS} where i < j and d > 0",
    "lloyd_three_rounds": f"with c0 as (select 0.0::double as a, 9000.0::double as b), c1 as ({STEP('c0', 1)}), c2 as ({STEP('c1', 2)}), c3 as ({STEP('c2', 3)}) select s_suppkey, case when abs(s_acctbal - c3.a) <= abs(s_acctbal - c3.b) then 1 else 2 end as cluster from supplier, c3",
    "calinski_harabasz": f"with v as {VECTORS}, g as (select label, count(*) as n, " + ", ".join(f"var_pop({x}) * count(*) as w{x}" for x in XS) + " from v group by label) select round((t - w) / (k - 1) / (w / (n - k)), 6) as calinski_harabasz from (select sum(" + " + ".join(f"w{x}" for x in XS) + ") as w, sum(n) as n, count(*) as k from g), (select " + " + ".join(f"var_pop({x}) * count(*)" for x in XS) + " as t from v)",
    "davies_bouldin": f"with v as {VECTORS}, m as (select label, " + ", ".join(f"avg({x}) as m{x}" for x in XS) + " from v group by label), s as (select label, avg(sqrt(" + " + ".join(f"({x} - m{x}) ** 2" for x in XS) + ")) as s, " + ", ".join(f"first(m{x}) as m{x}" for x in XS) + " from v join m using (label) group by label) select round(avg(r), 6) as davies_bouldin from (select max((a.s + b.s) / sqrt(" + " + ".join(f"(a.m{x} - b.m{x}) ** 2" for x in XS) + ")) as r from s a join s b on a.label <> b.label group by a.label)",
    "silhouette": "with p as (select a.vec_id as i, a.label as li, b.label as lj, list_distance(a.embedding::double[], b.embedding::double[]) as d from embeddings a join embeddings b on a.vec_id <> b.vec_id), m as (select i, li, lj, avg(d) as m from p group by all), s as (select i, max(m) filter (li = lj) as a, min(m) filter (li <> lj) as b from m group by i) select round(avg(case when a is null then 0 else (b - a) / greatest(a, b) end), 6) as silhouette from s",
    "adjusted_rand": f"with c as (select label, (x0 > 0)::int as half, count(*) as n from {VECTORS} group by all), t as (select (select {TWO} from c) as ij, (select sum(n) from c) as total, (select {TWO} from (select sum(n) as n from c group by label)) as ai, (select {TWO} from (select sum(n) as n from c group by half)) as bj) select round((ij - ai * bj / (total * (total - 1) / 2)) / ((ai + bj) / 2 - ai * bj / (total * (total - 1) / 2)), 6)::double as ari from t",
    "pairwise_ari": f"with r as {RUNS}, c as (select a.run as run_a, b.run as run_b, a.label as la, b.label as lb, count(*) as n from r a join r b on a.vec_id = b.vec_id and a.run < b.run group by all), x as (select run_a, run_b, {TWO} as ij, sum(n) as total from c group by all), y as (select run_a, run_b, {TWO} as ai from (select run_a, run_b, la, sum(n) as n from c group by all) group by all), z as (select run_a, run_b, {TWO} as bj from (select run_a, run_b, lb, sum(n) as n from c group by all) group by all) select run_a, run_b, round(case when (ai + bj) / 2 = ai * bj / (total * (total - 1) / 2) then 1 else (ij - ai * bj / (total * (total - 1) / 2)) / ((ai + bj) / 2 - ai * bj / (total * (total - 1) / 2)) end, 6)::double as ari from x join y using (run_a, run_b) join z using (run_a, run_b)",
    "first_appearance": f"select run, label, (row_number() over (partition by run order by f) - 1)::int as canonical from (select run, label, min(vec_id) as f from {RUNS} group by run, label)",
    "partition_frequency": f"with r as {RUNS}, f as (select run, label, row_number() over (partition by run order by min(vec_id)) as c from r group by run, label), p as (select run, string_agg(vec_id || ':' || c, ',' order by vec_id) as print from r join f using (run, label) group by run) select count(*) as n_runs, string_agg(run, ',' order by run) as runs, round(count(*) * 100.0 / sum(count(*)) over (), 6) as pct from p group by print",
    "canonical_labels": f"select label, n, row_number() over (order by m, label)::int as canonical from (select label, count(*) as n, avg(x0) as m from {VECTORS} group by label)",
    "cluster_profile": "select c_mktsegment, n, round(n * 100.0 / sum(n) over (), 6) as percent, round((select avg(c_acctbal) from customer c where c.c_mktsegment = x.c_mktsegment) - (select avg(c_acctbal) from customer), 6) as centre_minus_mean, mean, sd, min, max, q1, median, q3 from (select c_mktsegment, " + DESCRIBED.format("c_acctbal") + " from customer group by c_mktsegment) x",
    "contingency": "select p_size, p_brand, count(*) as n from part group by all",
    "check_assignment": "select count(*) as n_rows, count(distinct vec_id) as n_ids, count(*) filter (label is null) as n_unlabelled, count(distinct label) as n_clusters, coalesce(bool_and(label between 1 and 8), true) as labels_in_range from embeddings",
    "baseline_compare": "with a as (select c_mktsegment as metric, avg(c_acctbal) as value from customer group by 1), b as (select metric, avg(value) as mean, min(value) as low, max(value) as high from (select c_mktsegment as metric, c_nationkey, avg(c_acctbal) as value from customer group by all) group by metric) select metric, round(value, 6) as value, round(mean, 6) as mean, round(value - mean, 6) as difference, round(case when mean <> 0 then (value - mean) * 100 / mean else 0 end, 6) as pct, case when abs(value - mean) <= 1e-12 then 'equal' when value > mean then 'better' else 'worse' end as direction, case when value < low then 'below' when value > high then 'above' else 'within' end as range from a join b using (metric)",
    "integrity_gate": "select 3::bigint as n_checks, (a > 0)::bigint + (b > 0)::bigint + (c > 0)::bigint as n_failed, a + b + c = 0 as complete from (select count(*) filter (not l_quantity > 0) as a, count(*) filter (not l_discount < 0.1) as b, count(*) filter (not l_tax <= 0.08) as c from lineitem)",
    "matrix_problems": "select count(*) filter (c_custkey is null) as blank_ids, count(c_custkey) - count(distinct c_custkey) as repeated_ids, count(*) filter (c_acctbal is null or isnan(c_acctbal) or isinf(c_acctbal)) as bad_cells, 0::bigint as row_difference from customer",
    "same_ids": "select (select count(*) from (select c_custkey from customer except select o_custkey from orders)) as only_left, (select count(*) from (select o_custkey from orders except select c_custkey from customer)) as only_right",
    "upserted_runs": "select c_custkey as run_id, c_acctbal as value from customer where c_custkey not in (select o_custkey from orders) union all select o_custkey, max(o_totalprice) from orders group by o_custkey",
    "scope_missingness": f"select * from {SQL_SCOPE}",
    "exclusion_preview": f"select scope, variable, n_eligible, n_eligible - n_valid as n_missing, pct_missing, 20.0::double as threshold, decision, false as replaced from {SQL_SCOPE} where decision = 'EXCLUDE'",
    "collection_qc": COLLECTION,
    "counterparts": f"select u.user_id, u.event_id, u.code, u.code2, coalesce(p.n, 0) as n_same_code, p.a as first_same_code, p.b as last_same_code, coalesce(q.n, 0) as n_same_code2, q.a as first_same_code2, q.b as last_same_code2 from {UNDATED} u left join {ALIKE('code')} p on p.user_id = u.user_id and p.code = u.code left join {ALIKE('code2')} q on q.user_id = u.user_id and q.code2 = u.code2 where u.day is null and {N('u.score')} is not null",
    "counterpart_rows": f"select event_id from {UNDATED} e where day is not null and exists (from {UNDATED} u where u.day is null and {N('u.score')} is not null and {S('u.code')} <> '' and u.user_id = e.user_id and u.code = e.code)",
    "component_differences": " union all ".join(f"select l_orderkey, '{n}' as component, {c}::varchar as first, z[{i}]::varchar as second, '{kind}' as kind from {PAIRED} where rows_of = 2 and z is not null and {c} is distinct from z[{i}]" for i, (n, c, kind) in enumerate((("quantity", "quantity", "item"), ("flag", "flag", "item"), ("score_discount", "discount", "score"), ("day", "day", "item"), ("grp", "grp", "item")), 1)),
    "supersession_evidence": f"select *, not (blank_code2 and blank_score) as marked from (select user_id, day, count(*) as n_rows, count(distinct event_type) as n_values, count(distinct event_id) = count(*) as distinct_records, count(distinct k) = 1 as same_k, bool_and({S('code2')} = '') as blank_code2, bool_and({S('score')} = '') as blank_score from {SQL_CODED} group by user_id, day) where n_values > 1",
    "subset_refits": f"select * from {REFITS}",
    "refit_findings": f"select subset, max(n) as n, string_agg(n_members, ',' order by cluster) as sizes, min(centre) as lowest_centre, max(centre) as highest_centre, max(boundary_shift) as boundary_shift, max(pct_equal) as pct_equal, max(ari) as ari from {REFITS} group by subset",
    "best_k": f"select * from {BEST}",
    "subset_cross_check": f"select count(*) as n_subsets, bool_and(silhouette_k = 7) as all_silhouette, bool_and(silhouette_k = 7 and davies_bouldin_k = 7 and calinski_harabasz_k = 7) as all_metrics from {BEST}",
    "same_subsets": f"select count(*) filter (followup_days >= 300 and n_observations < 60) as only_first, count(*) filter (followup_days < 300 and n_observations >= 60) as only_second, bool_and((followup_days >= 300) = (n_observations >= 60)) as identical from {FITS}",
    "final_report": f"""with c0 as (select 0.0::double as a, 9000.0::double as b), c1 as ({STEP('c0', 1)}), c2 as ({STEP('c1', 2)}), c3 as ({STEP('c2', 3)}), done as (select s_suppkey, s_acctbal, case when abs(s_acctbal - c3.a) <= abs(s_acctbal - c3.b) then 1 else 2 end as label from supplier, c3)
 select 'same_ids' as check, not exists (select s_suppkey from supplier except select s_suppkey from done) as passed union all select 'ids_unique', count(*) = count(distinct s_suppkey) from done union all select 'labels_exact', min(label) = 1 and max(label) = 2 from done
 union all select 'members_add_up', (select count(*) from done) = (select sum(n) from (select count(*) as n from done group by label)) union all select 'profiles_equal_k', count(distinct label) = 2 from done
 union all select 'centres_ascend', avg(s_acctbal) filter (label = 1) < avg(s_acctbal) filter (label = 2) from done union all select 'runs_exact', list_sort(list(n_nationkey)) = range(25) from nation""",
}
