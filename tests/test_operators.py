"""Operators on small frames with written-out answers, or against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendloom.functions import cells
from trendloom.operators import audit, clusters, density, digests, features, ranks, reporting, selection, trends, visits
from trendloom.plans import registry
from trendloom.sources import tables

SF = "/root/testdata/sf0.01"


def test_cells(spark):
    raw = ["", "  ", "\t", "NA", ".", "-1", "-4", "-1.0", "1e2", "abc", "nan", "-7", " x ", None]
    df = spark.createDataFrame([(x,) for x in raw], "c string")
    got = df.select(cells.missing_category("c"), cells.number("c"), cells.strip("c")).collect()
    assert [r[0] for r in got] == ["blank", "whitespace", "whitespace", "text_code", "text_code", "sentinel", "sentinel", "sentinel", None, None, "text_code", None, None, None]
    assert [r[1] for r in got] == [None, None, None, None, None, -1, -4, -1, 100, None, None, -7, None, None]
    assert got[12][2] == "x"
    names = spark.createDataFrame([(" Vis-Code 2 ",), ("__a",)], "c string").select(cells.normal_name("c")).collect()
    assert [r[0] for r in names] == ["VIS_CODE_2", "A"]
    dates = spark.createDataFrame([("2020-02-29",), ("02/28/2021",), ("2021-02-29",), (" 20200101 ",), ("",)], "c string").select(cells.date_of("c").cast("string")).collect()
    assert [r[0] for r in dates] == ["2020-02-29", "2021-02-28", None, "2020-01-01", None]
    v = spark.createDataFrame([([0.0, 3.0], [4.0, 0.0])], "a array<double>, b array<double>").select(cells.distance("a", "b"), cells.dot("a", "b")).head()
    assert tuple(v) == (5.0, 0.0)


def test_column_roles(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(["VISCODE", "rid", "Subject Id", "EXAMDATE", "x_date", "PTID", "score"])], "position int, column_name string")
    r = audit.column_roles(df)
    got = {x.column_name: (x.is_identifier, x.is_visit, x.is_date) for x in r.collect()}
    assert got["rid"][0] and got["Subject Id"][0] and got["VISCODE"][1] and got["x_date"][2] and got["score"] == (False, False, False)
    assert audit.preferred_column(r, "is_identifier", "participant").head()[0] == "PTID"


def test_student_t():
    for df, want in ((1, 12.7062047364), (2, 4.3026527297), (5, 2.5705818356), (30, 2.0422724563), (1000, 1.9623390808)):
        assert trends.student_t(0.975, df) == pytest.approx(want, abs=1e-8)


def test_slope_intervals(spark):
    df = spark.createDataFrame([(1, float(x), y) for x, y in enumerate((1.0, 3.0, 2.0, 5.0))] + [(2, 1.0, 2.0), (2, 1.0, 3.0), (3, 0.0, 4.0), (3, 1.0, 4.0)], "e int, x double, y double")
    r = {x.e: x for x in trends.slopes(df, "e", "x", "y").collect()}
    b, a = np.polyfit([0, 1, 2, 3], [1, 3, 2, 5], 1)
    sse = ((np.array([1, 3, 2, 5]) - a - b * np.arange(4)) ** 2).sum()
    margin = 4.3026527297 * np.sqrt(sse / 2 / 5)
    assert (r[1].slope, r[1].ci_low, r[1].ci_high) == pytest.approx((b, b - margin, b + margin), abs=1e-5) and r[1].failure is None
    assert r[2].failure == "x has zero variance" and r[3].failure == "y has zero variance" and r[2].slope is None


def test_entry_labels_and_sequence(spark):
    df = spark.createDataFrame([(1, "a", 1, 0), (1, "b", 3, 4), (1, "c", 2, 2)], "e int, d string, n int, t int")
    assert tuple(visits.sequence_checks(df, "e", "d", "n", "t").head()) == (1, 0, 0)


def test_dictionary_conflict(spark):
    d = spark.createDataFrame([("a", "x"), ("a", "y")], "k string, v string")
    with pytest.raises(ValueError):
        visits.lookup(d.select("k"), d, ["k"], "v")


def test_pca(spark):
    df = registry.QUERIES["pca_scores"](spark, SF).toPandas().set_index("vec_id").sort_index()
    raw = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas().set_index("vec_id").sort_index()
    x = np.array(raw.embedding.tolist(), dtype=float)
    x -= x.mean(0)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    share = np.cumsum(s ** 2) / (s ** 2).sum()
    assert df.shape[1] == int(np.searchsorted(share, 0.85)) + 1
    vt = vt * np.sign(vt[range(64), np.abs(vt).argmax(1)])[:, None]
    assert np.allclose(df.to_numpy(), (x @ vt.T)[:, :df.shape[1]], atol=1e-6)


def test_features_refuse(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    with pytest.raises(ValueError):
        features.standardize(df, ["a"])
    features.check_standardized(features.standardize(df, ["b"]), ["b"])
    with pytest.raises(ValueError):
        features.expect_missing(df, {"a": 1})


def test_kmeans(spark):
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate((0, 1, 2, 10, 11, 12))], "i int, x double")
    out, centres, _ = clusters.kmeans(df, ["x"], [[0.0], [1.0]])
    assert centres == [[1.0], [11.0]] and [r.cluster for r in out.orderBy("x").collect()] == [1, 1, 1, 2, 2, 2]
    assert clusters.inertia(df, ["x"], centres).head()[0] == 4.0 and clusters.boundary(centres) == 6.0
    with pytest.raises(ValueError):
        clusters.kmeans(df, ["x"], [[0.0], [100.0], [200.0]])
    with pytest.raises(ValueError):
        clusters.kmeans(df.union(spark.createDataFrame([(9, None)], "i int, x double")), ["x"], [[0.0], [1.0]])
    runs, _ = clusters.replicate(df, "i", ["x"], 2, [0, 1, 2])
    assert runs.count() == 18 and all(r.inertia == 4.0 for r in clusters.run_summary(runs).collect())


def test_replicated_runs_reach_a_fixed_point(spark):
    runs, fitted = clusters.replicate(spark.read.parquet(f"{SF}/supplier.parquet"), "s_suppkey", ["s_acctbal"], 3, [0, 1, 2, 3], tol=0.0)
    for (run, label), m in {(r[0], r[1]): r[2] for r in runs.groupBy("run", "label").agg(F.avg("s_acctbal")).collect()}.items():
        assert m == pytest.approx(fitted[run].centres[label - 1][0])


def test_density_and_quantile(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 2))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, v array<double>")
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    up = d[np.triu_indices(60, 1)]
    assert density.cutoff(df, "i", "v", 0.1) == pytest.approx(np.percentile(up, 10))
    rho = (d < 0.5).sum(1) - 1
    for got in (density.density(df, "i", "v", 0.5), density.density_grid(df, "i", "v", 2, 0.5)):
        assert [r.rho for r in got.orderBy("i").collect()] == rho.tolist()
    scored, _ = density.peaks(df, "i", "v", d_c=0.5)
    for r in scored.collect():
        more = d[r.i][rho > rho[r.i]]
        assert r.delta == pytest.approx(more.min() if len(more) else d[r.i].max())
    checks = density.cutoff_sensitivity(df, "i", "v", (0.1,), primary=0.1)
    assert checks[0]["same_order"] and density.verdict(checks, [{"rho": 5}, {"rho": 5}], 5, 0.1, 0.5)["initialisation"] == "seeded random"


def test_average_ranks_tolerance(spark):
    df = spark.createDataFrame([(1, 2, 1.0), (1, 3, 1.0 + 1e-14), (1, 4, 2.0)], "g int, k int, v double")
    assert [r.avg_rank for r in ranks.average_ranks(df, "v", "g", False).orderBy("k").collect()] == [1.5, 1.5, 3.0]


def test_indices_on_three_squares(spark):
    points = [(x + a, y + b) for a, b in ((0, 0), (10, 0), (5, 9)) for x in (0, 1) for y in (0, 1)]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "i int, a double, b double").repartition(2)
    v, errors = selection.index_values(selection.Statistics(df, "i", ["a", "b"], [2, 3, 4], 4))
    cast = selection.votes(v, [2, 3, 4], errors)
    got = {r["index"]: r["k"] for r in cast}
    assert all(got[i] == 3 for i in ("ch", "db", "silhouette", "dunn", "cindex", "ball") if i != "ball") and got["hubert"] is None
    votes = [r["k"] for r in cast if r["status"] == "VOTE"]
    assert max(set(votes), key=votes.count) == 3
    within = [np.linalg.norm(np.subtract(p, q)) for i, p in enumerate(points) for q in points[:i] if points.index(p) // 4 == points.index(q) // 4]
    between = [np.linalg.norm(np.subtract(p, q)) for i, p in enumerate(points) for q in points[:i] if points.index(p) // 4 != points.index(q) // 4]
    assert v["dunn"][3] == pytest.approx(min(between) / max(within)) and v["cindex"][3] == pytest.approx(0, abs=1e-9)
    assert v["mcclain"][3] == pytest.approx(np.mean(within) / np.mean(between))


def test_selection_rules(spark):
    assert selection.decide([{"k": 2, "votes": 3, "leader": True}, {"k": 3, "votes": 3, "leader": True}])["k"] is None
    assert selection.decide([{"k": 2, "votes": 3, "leader": True}])["k"] == 2 and selection.by_silhouette({2: 0.5, 3: 0.5}) == 2
    assert selection.plausibility([{"metric": m, "best_k": 2} for m in ("silhouette", "a", "b")]) == "CONSISTENT_SUPPORT_FOR_K2"


def test_documents(spark):
    def doc(**change):
        return spark.createDataFrame([(k, str(v)) for k, v in ({"inertia": 1.5, "votes": 3, "k": 2, "hash": "ab"} | change).items()], "key string, value string")

    same = lambda **c: reporting.compare_documents(doc(), doc(**c)).filter("not same").count() == 0
    assert same(inertia=1.5 + 5e-12) and not same(inertia=1.5 + 2e-11) and not same(votes=4) and not same(k=3) and not same(hash="x") and not same(extra=1)
    profiles = spark.createDataFrame([(1, 2, 66.7, 0.5), (2, 1, 33.3, 9.0)], "label int, n long, percent double, mean double")
    seeds = spark.createDataFrame([(1, 16.0), (2, 12.0)], "place int, gamma double")
    d = reporting.run_document(profiles, seeds, "r", "A", 2)
    assert reporting.gate(reporting.document_rules(d, [2, 3])).head()["complete"] and [s["name"] for s in d.head()["seeds"]] == ["candidate-1", "candidate-2"]
    assert not reporting.gate(reporting.document_rules(d, [3])).head()["complete"]
    assert reporting.dashboard_metrics(d).count() == 2 and reporting.expectations(d, {"k": 2}).head()["passed"]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿RID,NOTE\n1,"x, ""y"""\n2,\n3,"  "\n'.encode())
    raw = tables.read_raw_csv(spark, str(tmp_path / "a.csv"))
    assert [tuple(r) for r in tables.with_row_number(raw).orderBy("source_row").collect()] == [("1", 'x, "y"', 2), ("2", "", 3), ("3", "  ", 4)]
    found = tables.check_manifest(spark, str(tmp_path), {"a.csv": ["RID", "SCORE"], "b.csv": []}).collect()
    assert sorted(tuple(r) for r in found) == [("a.csv", "missing column SCORE"), ("b.csv", "missing file")]
    files = digests.file_manifest(spark, str(tmp_path))
    assert files.count() == 1 and digests.tree_digest(files).head()["n_files"] == 1
    assert reporting.required_hashes(files, spark.createDataFrame([("a.csv", "0")], "file string, sha256 string")).count() == 1
    with pytest.raises(ValueError):
        tables.write_json(spark.createDataFrame([(float("nan"),)], "x double"), str(tmp_path / "j"))
    tables.write_csv(raw, str(tmp_path / "out"))
    assert tables.read_raw_csv(spark, str(tmp_path / "out")).count() == 3
    assert tables.key_value_map(spark.createDataFrame([("a", 1.0), ("b", 2.0)], "metric string, value double")).head()[0] == {"a": 1.0, "b": 2.0}
    with pytest.raises(ValueError):
        tables.validate_matrix(spark.createDataFrame([(1, 1.0), (1, None)], "i int, x double"), "i", ["x"])
    run = lambda i, a: spark.createDataFrame([(i, a, 1)], "run_id string, axis string, created_at int")
    store = run("x", "A")
    assert tables.upsert_pair(store, run("x", "A"), run("y", "B")).count() == 2 and tables.list_runs(store).count() == 1
    with pytest.raises(ValueError):
        tables.upsert_pair(store, run("x", "A"), run("x", "B"))


def test_large_numbers_of_rows_rank(spark):
    df = spark.range(5000).select("id", (F.col("id") * 7919 % 5003).cast("double").alias("v"))
    r = ranks.global_rank(df, [F.col("v"), F.col("id")]).orderBy("rank").collect()
    assert [x["rank"] for x in r] == list(range(1, 5001)) and all(a["v"] <= b["v"] for a, b in zip(r, r[1:]))
    assert ranks.exact_quantile(df, "v", 0.37) == pytest.approx(np.percentile([x["v"] for x in r], 37))
