"""Collection checks, counterparts, conflicting pairs, refits and reports on written-out frames."""

from pyspark.sql import functions as F

from trendloom.operators import reporting, review, sensitivity

KINDS = {"screening": "S", "baseline": "B", "entry": "E", "followup": "L"}


def test_collection_qc(spark):
    roster = spark.createDataFrame([(1, "p", 4.0), (2, "p", None), (3, "p", None), (4, "p", None), (5, "p", None), (6, "q", None), (7, None, None)], "id int, cohort string, value double")
    rows = [(1, "p", "B", "VALID", 4.0, True, "bl"), (2, "p", "S", "VALID", 0.0, False, "sc"), (3, "p", "L", "VALID", 2.0, False, "\tm06 "), (4, "p", "B", "BLANK", None, True, "bl"), (6, "p", "B", "VALID", 1.0, True, "bl"), (7, "p", "S", "VALID", 1.0, True, "sc"), (9, "p", "B", "VALID", 1.0, True, "x")]
    records = spark.createDataFrame(rows, "id int, phase string, category string, state string, number double, any_item boolean, code string")
    got = {r.cohort: r for r in review.collection_qc(roster, records, "id", KINDS, ("code",)).collect()}
    p, q = got["p"], got["q"]
    assert (p.n_eligible, p.n_anywhere, p.n_in_phase, p.n_missing, p.n_wrong_visit, p.n_followup_only, p.n_total_not_filled, p.n_absent, p.n_unresolved) == (5, 4, 4, 4, 1, 1, 1, 1, 0)
    assert (p.base_all, p.base_valid, p.base_blank_with_items, p.rows_all, p.rows_zero, p.code_seen) == (2, 1, 1, 4, 1, "bl | m06 | sc")
    assert (q.n_eligible, q.n_anywhere, q.n_in_phase, q.n_absent_in_phase, q.n_unresolved, q.rows_all, q.code_seen) == (1, 1, 0, 1, 1, 0, "")
    assert review.collection_qc(roster.limit(0), records, "id", KINDS).count() == 0


def test_counterparts_without_pairs(spark):
    df = spark.createDataFrame([(1, 10, None, "a"), (1, 11, "2020-01-01", "a"), (1, 12, "2020-02-01", "a"), (1, 13, None, " "), (1, 14, "2020-01-01", " "), (2, 15, None, "a"), (2, 16, None, None)], "id int, row int, day string, code string")
    got = {r.row: (r.n_same_code, r.first_same_code, r.last_same_code) for r in review.counterparts(df, "id", "row", "day", ["code"], F.lit(True)).collect()}
    assert got == {10: (2, "2020-01-01", "2020-02-01"), 13: (0, None, None), 15: (0, None, None), 16: (0, None, None)}
    assert sorted(r.row for r in review.counterpart_rows(df, "id", "day", "code", F.lit(True)).collect()) == [11, 12]


def test_component_differences(spark):
    df = spark.createDataFrame([(1, 1, "a", 2, None), (1, 2, "a", 3, "x"), (2, 1, "a", 1, "x"), (3, 5, "b", 1, "x"), (3, 5, "a", 1, "x"), (4, 1, "a", 1, "x"), (4, 2, "b", 1, "x"), (4, 3, "c", 1, "x")], "id int, at int, q string, score int, z string")
    got = sorted(tuple(r) for r in review.component_differences(df, ["id"], "at", ["q", "score", "z"]).collect())
    assert got == [(1, "score", "2", "3", "score"), (1, "z", None, "x", "item"), (3, "q", "a", "b", "item")]


def test_supersession(spark):
    df = spark.createDataFrame([(1, "d", 5, 1, "s", ""), (1, "d", 6, 2, "s", None), (2, "d", 5, 1, "s", ""), (2, "d", 6, 1, "t", "E"), (3, "d", 5, 1, "s", "")], "id int, day string, value int, record int, stamp string, flag string")
    got = sorted(tuple(r) for r in review.supersession_evidence(df, "id", "day", "value", "record", ["stamp"], ["flag"]).collect())
    assert got == [(1, "d", 2, 2, True, True, True, False), (2, "d", 2, 2, False, False, False, True)]


def test_subset_refits(spark):
    rows = [(i, float(x), 1 if x < 4 else 2) for i, x in enumerate([0, 1, 2, 8, 9, 10, 100])] + [(7, None, None)]
    df = spark.createDataFrame(rows, "id int, x double, label int")
    ranked, tails = sensitivity.tail_subsets(df.filter("x is not null"), "id", "x")
    got = {(r.subset, r.cluster): r for r in sensitivity.subset_refits(ranked, "id", "x", tails | {"none": F.lit(None).cast("boolean")}, "label", [1.0, 31.75]).collect()}
    assert {s for s, _ in got} == {"without_maximum", "without_top", "without_bottom", "without_both"}
    low, high = got["without_maximum", 1], got["without_maximum", 2]
    assert (low.centre, high.centre, low.n_members, high.n_members, low.n_equal, low.ari) == (1.0, 9.0, 3, 3, 6, 1.0)
    assert (high.centre_shift, low.boundary, low.boundary_shift) == (-22.75, 5.0, -11.375)
    found = {r.subset: r.sizes for r in sensitivity.findings(sensitivity.subset_refits(ranked, "id", "x", tails, "label", [1.0, 31.75])).collect()}
    assert found["without_maximum"] == "3,3"
    assert sensitivity.subset_refits(df.limit(0), "id", "x", {"all": F.lit(True)}, "label", [0.0, 1.0]).count() == 0


def test_best_k_and_cross_check(spark):
    m = spark.createDataFrame([("a", 2, 0.5, 0.3, 9.0), ("a", 3, 0.5, 0.3, 8.0), ("b", 2, 0.4, 0.9, 1.0), ("b", 3, 0.3, 0.2, 7.0)], "subset string, k int, silhouette double, davies_bouldin double, calinski_harabasz double")
    best = sensitivity.best_k(m)
    assert sorted(tuple(r) for r in best.collect()) == [("a", 2, 2, 2), ("b", 2, 3, 3)]
    assert tuple(sensitivity.cross_check(best).head()) == (2, True, False)


def test_final_report(spark):
    cohort = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    runs = spark.createDataFrame([(1,), (0,)], "run int")
    profiles = spark.createDataFrame([(1, 2, 0.5), (2, 1, 4.0)], "label int, n int, centre double")
    done = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "id int, label int")
    report = sensitivity.final_report(cohort, done, profiles, runs, "id", 2, 2)
    assert report.filter("not passed").count() == 0 and reporting.gate(report).head()["complete"]
    bad = sensitivity.final_report(cohort, done.filter("id < 3"), profiles.withColumn("centre", F.lit(1.0)), runs.limit(1), "id", 2, 2)
    assert {r.check for r in bad.filter("not passed").collect()} == {"same_ids", "labels_exact", "members_add_up", "centres_ascend", "runs_exact"}
