"""Cases of the fourth review: each failed before its finding was settled."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from trendloom.operators import blocks, line, selection, sensitivity
from trendloom.plans import registry, study


def test_gaps_that_round_alike_are_ties(spark, tmp_path):
    cents = np.cumsum(np.r_[-99999, np.random.default_rng(4).permutation(np.repeat([1, 7, 14], 40))])
    rows = [(i, float(c) / 100) for i, c in enumerate(cents)] + [(500, None), (501, float(cents[7]) / 100)]
    spark.createDataFrame(rows, "c_custkey int, c_acctbal double").repartition(3).write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.sql(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    got = study.QUERIES["largest_gaps"](spark, str(tmp_path)).select("c_custkey", "before", "after", "gap").collect()
    assert [tuple(r) for r in got] == con.sql(study.SQL["largest_gaps"]).fetchall()


def test_refits_end_when_no_row_moves(spark):
    x = np.sort(np.round(np.random.default_rng(8).exponential(size=400), 6))
    df = spark.createDataFrame([(i, float(v), 1) for i, v in enumerate(x)], "i int, x double, label int").repartition(5)
    got = sensitivity.subset_refits(df, "i", "x", {"all": F.lit(True)}, "label", [0.0, 0.0], None, 0.0).orderBy("cluster").collect()
    a, b = (float(x[int(np.ceil(q * len(x))) - 1]) for q in (0.25, 0.75))
    sizes = [-1]
    while len(sizes) < 2 or sizes[-1] != sizes[-2]:
        low = x <= (a + b) / 2
        sizes.append(int(low.sum()))
        a, b = x[low].mean(), x[~low].mean()
    assert len(sizes) > 6 and [(r.centre, r.n_members) for r in got] == [(round(a, 6), sizes[-1]), (round(b, 6), 400 - sizes[-1])]


def test_every_refit_has_rows(spark):
    sf = "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{sf}/events.parquet'")
    got = registry.QUERIES["subset_refits"](spark, sf).orderBy("subset", "cluster")
    assert [tuple(r) for r in got.collect()] == con.sql(f"select {', '.join(got.columns)} from ({registry.SQL['subset_refits']}) order by subset, cluster").fetchall()
    assert got.select("subset").distinct().count() == 6


def test_findings_are_of_every_refit(spark):
    sf = "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{sf}/events.parquet'")
    got = registry.QUERIES["refit_findings"](spark, sf).orderBy("subset")
    assert [tuple(r) for r in got.collect()] == con.sql(f"select {', '.join(got.columns)} from ({registry.SQL['refit_findings']}) order by subset").fetchall()
    assert got.count() == 6 and got.filter("n = 0").isEmpty()


def test_sums_of_extreme_distances_measure_no_pairs(spark, monkeypatch):
    x = np.r_[np.round(np.random.default_rng(1).integers(-500, 3000, 500) / 100, 2), 1e9, -0.0, 0.0, 0.0, 1e-9]
    df = spark.createDataFrame([(i, [float(v)]) for i, v in enumerate(x)], "i int, x array<double>").repartition(4)
    d = np.sort(np.abs(x[:, None] - x[None])[np.triu_indices(len(x), 1)])
    counts = [0, 1, len(d) // 9, len(d)]
    plain = line.Places.__init__
    monkeypatch.setattr(line.Places, "__init__", lambda self, df, vec, rows=60: plain(self, df, vec, rows))  # eight blocks
    monkeypatch.setattr(blocks, "run_cells", None)  # no pair of blocks of rows is measured
    got = line.extreme_sums(df, "x", counts, len(d))
    assert np.array(got) == pytest.approx(np.array([(d[:m].sum(), d[len(d) - m :].sum()) for m in counts]), rel=1e-9)
    places = line.Places(df, "x")
    assert len(places.n) > 4 and places.distances([0, 3, len(d) // 2, len(d) - 1]) == {p: d[p] for p in (0, 3, len(d) // 2, len(d) - 1)}
    s = selection.Statistics.__new__(selection.Statistics)
    s.p, s.rows, s.fitted, s._pairs = 1, df, [1, 2], ({"n": len(d)}, {1: {"nw": 5}, 2: {"nw": 0}})
    assert s.extremes[1] == pytest.approx((d[:5].sum(), d[-5:].sum())) and s.extremes[2] == (0.0, 0.0)


def test_silhouettes_write_no_copies_of_blocks(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x, codes = rng.normal(size=(700, 5)), rng.integers(0, [3, 2], (700, 2))
    x[1], x[2] = x[0], x[0] + 1e-9
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    hot = np.c_[np.eye(3)[codes[:, 0]], np.eye(2)[codes[:, 1]]]
    df = spark.createDataFrame([(f"r{i}", v.tolist(), c.tolist()) for i, (v, c) in enumerate(zip(x, codes))], "i string, v array<double>, codes array<int>").repartition(3)
    monkeypatch.setattr(blocks, "run_cells", None)  # which copies every block for each other one
    for df, want in ((df, d @ hot), (df.withColumn("v", F.col("v").cast("array<float>")), None)):
        if want is None:
            y = x.astype(np.float32).astype(float)
            want = np.sqrt(((y[:, None] - y[None]) ** 2).sum(2)) @ hot
        for rows in (65_536, 60):
            got = {r.i: r.s for r in blocks.cluster_sums(df, "i", "v", "codes", [3, 2], rows).collect()}
            assert len(got) == 700 and np.array([got[f"r{i}"] for i in range(700)]) == pytest.approx(want, rel=1e-9)
    monkeypatch.setattr(blocks, "cluster_sums", lambda *a, f=blocks.cluster_sums: f(*a, rows=60))
    assert blocks.cluster_sums(df.limit(0), "i", "v", "codes", [3, 2]).count() == 0
    plan = blocks.cluster_sums(df, "i", "v", "codes", [3, 2])._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan or "NestedLoopJoin" in plan
