"""Cases of the third review: each failed before its finding was settled."""

import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trendloom.llm import jaccard, shingles
from trendloom.operators import blocks, density, line, ranks, selection, sensitivity, trends


def test_gap_keeps_the_value_before(spark):
    df = spark.createDataFrame([(1, 0.1), (2, 1e16)], "i int, x double")
    assert [tuple(r) for r in ranks.gap_audit(df, "x", "i").collect()] == [(2, 0.1, 1e16, 1e16 - 0.1)]


def test_median_of_bands_rounds_as_its_sql(spark):
    df = spark.createDataFrame([(3, 0.000246), (3, 0.000247), (4, 0.000295), (4, 0.000296)], "n int, slope double")
    con = duckdb.connect()
    con.sql("create table t as select * from (values (3, 0.000246::double), (3, 0.000247), (4, 0.000295), (4, 0.000296)) v(n, slope)")
    want = dict(con.sql("select case n when 3 then 'exactly_3' else 'exactly_4' end, round(quantile_cont(slope, 0.5), 6) from t group by n").fetchall())
    assert {r.band: r["median"] for r in trends.bands(df, "n", "slope", trends.SUPPORT_BANDS, True).collect()} == want


def test_refits_start_from_exact_quantiles(spark):
    x = np.random.default_rng(3).normal(size=60_000)
    df = spark.createDataFrame(list(enumerate(x.tolist())), "i int, x double").repartition(40).withColumn("label", F.lit(1))
    at = [float(np.sort(x)[int(np.ceil(q * len(x))) - 1]) for q in (0.25, 0.75)]
    got = sensitivity.subset_refits(df, "i", "x", {"all": F.lit(True), "some": F.col("i") < 3}, "label", [0.0, 0.0], rounds=0)
    assert [r.centre for r in got.filter("subset = 'all'").orderBy("cluster").collect()] == [round(v, 6) for v in at]
    assert [r[0] for r in ranks.quantiles(df.filter("i < 3"), "x", [0.0, 0.5, 1.0], discrete=True).select(F.explode(F.array("q0", "q1", "q2"))).collect()] == sorted(x[:3].tolist())


def test_shingles_hold_little_at_once():
    text = " ".join(f"w{i % 977}x{i}" for i in range(120_000))
    texts = pa.array([text, None, text[:700_000], "a b c d e f"])
    tracemalloc.start()
    got = [len(s) for s in shingles.sets(texts, 5, shingles.Hasher())]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [len(text.split()) - 4, 0, len(text[:700_000].split()) - 4, 2] and peak < 40e6


def _labelled(spark):
    x = np.round(np.random.default_rng(2).normal(size=1500) * 3, 1)
    codes = [[int(v > 0), int(abs(v) > 2) + int(v > 3)] for v in x]
    return x, np.array(codes), spark.createDataFrame([(i, [float(v)], c) for i, (v, c) in enumerate(zip(x, codes))], "i int, v array<double>, codes array<int>").repartition(7)


def test_density_on_a_line_measures_no_pairs(spark, monkeypatch):
    x, _, df = _labelled(spark)
    x[:4] = 0.3, 0.1, 1e300, -0.6
    df = spark.createDataFrame([(i, [float(v)]) for i, v in enumerate(x)], "i int, v array<double>").unionByName(spark.createDataFrame([(-1, None), (-2, [float("nan")])], "i int, v array<double>"))
    monkeypatch.setattr(density, "distance", None)
    for d_c in (0.7, 0.2, 1e-9):
        got = {r.i: r.rho for r in density.density_grid(df, "i", "v", 1, d_c).collect()}
        assert got == {-1: 0, -2: 0} | {i: int((np.abs(x - v) < d_c).sum()) - 1 for i, v in enumerate(x)}


def test_copies_are_one_place_in_the_grid(spark):
    rows = [(i, [0.0, 0.0]) for i in range(3000)] + [(3000, [0.1, 0.0]), (3001, [5.0, 5.0])]
    got = density.density_grid(spark.createDataFrame(rows, "i int, v array<double>"), "i", "v", 2, 0.5)
    assert {(r.i >= 3000, r.rho) for r in got.filter("i <> 3001").collect()} == {(False, 3000), (True, 3000)} and got.filter("i = 3001").head().rho == 0


def test_line_statistics_equal_those_of_pairs(spark, monkeypatch):
    x, codes, df = _labelled(spark)
    d, hot = np.abs(x[:, None] - x[None]), np.c_[np.eye(2)[codes[:, 0]], np.eye(3)[codes[:, 1]]]
    for got in (line.cluster_sums(df, "i", "v", "codes", [2, 3]), blocks.cluster_sums(df, "i", "v", "codes", [2, 3])):
        assert np.array([r.s for r in got.orderBy("i").collect()]) == pytest.approx(d @ hot)
    gaps = [np.abs(np.subtract.outer(c, c)) for c in ([0, 1.5], [0, 2, 5.0])]
    for one, two in zip(line.label_statistics(df, "i", "v", "codes", gaps), blocks.label_statistics(df, "i", "v", "codes", gaps)):
        for a, b in zip(one if isinstance(one, list) else [one], two if isinstance(two, list) else [two]):
            assert a == pytest.approx(b)
    want = blocks.silhouettes(df.withColumn("v", F.array(F.get("v", F.lit(0)), F.lit(0.0))), "i", "v", "codes", [2, 3])
    monkeypatch.setattr(blocks, "run_cells", None)  # no pair of blocks is measured
    assert blocks.silhouettes(df, "i", "v", "codes", [2, 3]) == pytest.approx(want)


def test_distances_by_products_keep_near_rows():
    a = np.random.default_rng(5).normal(size=(300, 64)) + 1e3
    b = np.r_[a[:7], a[:7] + 1e-9, np.random.default_rng(6).normal(size=(20, 64))]
    got = np.concatenate([d for _, d in blocks.product_tiles(a, b)])
    assert got == pytest.approx(np.sqrt(((a[:, None] - b[None]) ** 2).sum(2)), rel=1e-9, abs=0) and (np.diag(got[:7, :7]) == 0).all()


def test_diagnostics_need_no_pairs(spark, monkeypatch):
    df = spark.createDataFrame([(i, float(i % 40 + 100 * (i % 3))) for i in range(240)], "i int, x double")
    monkeypatch.setattr(blocks, "run_cells", None)
    rows = selection.diagnostics(selection.Statistics(df, "i", ["x"], [2, 3], starts=2), spark).collect()
    assert [r.k for r in rows] == [2, 3] and rows[1].silhouette > rows[0].silhouette


def test_texts_reach_workers_in_small_batches(spark, monkeypatch):
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in batches)
    seen, write = [], jaccard.Tables.write

    def noted(self, df, name):
        seen.append((name, spark.range(0, 5000, 1, 1).mapInArrow(sizes, "n long").agg(F.max("n")).head()[0]))
        return write(self, df, name)

    monkeypatch.setattr(jaccard.Tables, "write", noted)
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "A b c d e f"), (3, None)], "doc_id long, text string")
    assert {tuple(r) for r in jaccard.join_components(docs).collect()} == {(1, 2, 1), (2, 2, 1), (3, 0, 3)}
    assert {"cells", "raw", "sets"} <= {name for name, _ in seen} and max(n for _, n in seen) <= 1000
    assert spark.conf.get(setting) == before
    try:
        corpus_pipeline.language_id(spark, docs.selectExpr("doc_id", "text", "'x' lang", "'y' source", "1L n_chars"), None)
        assert spark.range(0, 5000, 1, 1).mapInArrow(sizes, "n long").agg(F.max("n")).head()[0] <= 1000
    finally:
        spark.conf.set(setting, before)
