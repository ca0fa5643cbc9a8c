"""Choice of k, pairs in blocks, seeds, quantiles, guards, cohorts, stability, gates and digests against plain versions."""

import json
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendloom.functions import guards
from trendloom.functions.tails import f_quantile, student_t
from trendloom.operators import audit, blocks, clusters, density, digests, lloyd, ranks, reporting, resolve, selection, stability, trends
from trendloom.sources import tables


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(0, 1, (90, 2)), 1)
    x[:10] = x[10]  # equal rows
    return x, spark.createDataFrame([(i, v.tolist(), [int(i % 3), int(i % 5)]) for i, v in enumerate(x)], "i int, v array<double>, codes array<int>").repartition(3)


def distances(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))


# Pairs in blocks

def run_in_small_blocks(monkeypatch, rows=16):
    plain = blocks.run_cells
    monkeypatch.setattr(blocks, "run_cells", lambda df, ids, vec, kernel, schema, carry=(): plain(df, ids, vec, kernel, schema, carry, rows))


def test_pairs_in_blocks(cloud, monkeypatch):
    run_in_small_blocks(monkeypatch)
    x, df = cloud
    d = distances(x)
    up = d[np.triu_indices(len(x), 1)]
    t = blocks.distance_totals(df, "i", "v").head()
    assert (t.n_pairs, t.n_zero) == (len(up), (up == 0).sum()) and (t.min_positive, t.max, t.mean) == pytest.approx((up[up > 0].min(), up.max(), up.mean()))
    got = blocks.distance_quantiles(df, "i", "v", [0.0, 0.02, 0.37, 1.0])
    assert got == pytest.approx({q: np.quantile(up, q) for q in (0.0, 0.02, 0.37, 1.0)})
    assert blocks.distance_quantiles(df, "i", "v", [0.02], positive=True)[0.02] == pytest.approx(np.quantile(up[up > 0], 0.02))
    near = {r.i: (r.n0, r.n1) for r in blocks.counts_within(df, "i", "v", [0.5, 1.0]).collect()}
    assert near == {i: ((d[i] < 0.5).sum() - 1, (d[i] < 1.0).sum() - 1) for i in range(len(x))}
    own = [[d[i][[j for j in range(len(x)) if j % k == i % k and j != i]].mean() for i in range(len(x))] for k in (3, 5)]
    other = [[min(d[i][[j for j in range(len(x)) if j % k == c]].mean() for c in range(k) if c != i % k) for i in range(len(x))] for k in (3, 5)]
    want = [np.mean([(b - a) / max(a, b) for a, b in zip(own[q], other[q])]) for q in (0, 1)]
    assert blocks.silhouettes(df, "i", "v", "codes", [3, 5]) == pytest.approx(want)


def test_selection_by_bits_with_ties():
    rng = np.random.default_rng(1)
    v = np.r_[rng.random(1000), np.full(5000, 0.25), np.zeros(300), 1e-300, 1e300]

    def counts(shift, prefixes, new):
        return dict(zip(*(x.tolist() for x in blocks.bucket_counts(v, shift, prefixes, new))))

    places = [0, 299, 300, 301, 500, 1500, 4000, len(v) - 1]
    for direct in (0, 10, 10_000):
        assert blocks.select_places(counts, places, direct) == {p: np.sort(v)[p] for p in places}


def test_separation_by_grid_equals_all_pairs(spark):
    rng = np.random.default_rng(4)
    for dims, n in ((1, 5000), (2, 1500)):
        x = np.round(rng.normal(0, 1, (n, dims)) * rng.choice([1, 30], (n, 1)), 3)
        x[: n // 3] = x[0]  # a third of the rows in one place
        rho = (distances(x) < 0.2).sum(1) - 1
        df = spark.createDataFrame([(i, v.tolist(), int(r)) for i, (v, r) in enumerate(zip(x, rho))], "i int, v array<double>, rho int")
        got = {r.i: r.delta for r in density.separation_grid(df, "i", "v", dims).collect()}
        d = distances(x)
        want = {i: d[i][rho > rho[i]].min() if (rho > rho[i]).any() else d[i].max() for i in range(n)}
        assert got == pytest.approx(want)


# k-means++ and many runs

def test_plus_plus_and_lloyd_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = np.round(np.r_[rng.normal(0, 1, (40, 2)), rng.normal(8, 1, (30, 2)), rng.normal((0, 9), 1, (20, 2))], 3)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "i int, a double, b double").repartition(4)
    runs = lloyd.starts(df, "i", ["a", "b"], 3, 50)
    rows = {r.id: (r.h, r.x) for r in lloyd.points(df, "i", ["a", "b"]).collect()}
    h, p = np.array([rows[i][0] for i in range(90)]), np.array([rows[i][1] for i in range(90)])
    limit = 1e-4 * p.var(0).mean()
    for r in runs:
        chosen = []
        for step in range(3):
            w = ((p[:, None] - np.array(chosen)[None]) ** 2).sum(2).min(1) if chosen else np.ones(90)
            with np.errstate(divide="ignore"):
                chosen.append(p[np.argmin(-np.log(lloyd.uniform(h, r.seed, step)) / w)])
        assert np.allclose(chosen, r.start)
        c = np.array(chosen)
        for n in range(1, 301):
            label = ((p[:, None] - c[None]) ** 2).sum(2).argmin(1)
            new = np.array([p[label == e].mean(0) for e in range(3)])
            moved, c = ((new - c) ** 2).sum(), new
            if moved <= limit:
                break
        c = c[np.lexsort(c.T[::-1])]
        assert np.allclose(c, r.centres) and r.rounds == n and r.converged and r.empty == 0
        assert r.inertia == pytest.approx(((p[:, None] - c[None]) ** 2).sum(2).min(1).sum()) and r.n.sum() == 90
    table = lloyd.run_table(spark, runs).collect()
    best = [t for t in table if t.best]
    assert len(table) == 50 and len(best) == 1 and best[0].inertia == min(t.inertia for t in table)
    assert sorted(map(int, best[0].sizes.split(","))) == [20, 30, 40]


def test_draws_follow_squared_distance(spark):
    """Second centres of many seeds: far rows are drawn in proportion."""
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([0, 0, 0, 0, 1, 2])], "i int, a double")
    runs = [lloyd.Run(2, s) for s in range(3000)]
    lloyd.plus_plus(lloyd.points(df, "i", ["a"]), runs)
    seconds = [r.start[1][0] for r in runs if r.start[0][0] == 0]
    assert len(seconds) == pytest.approx(2000, abs=120) and np.mean(np.array(seconds) == 2) == pytest.approx(0.8, abs=0.04)


def test_fewer_places_than_clusters(spark):
    runs = lloyd.starts(spark.createDataFrame([(i, 1.0) for i in range(5)], "i int, a double"), "i", ["a"], 3, 2)
    assert [(r.empty, r.inertia, r.n.sum()) for r in runs] == [(2, 0.0, 5), (2, 0.0, 5)]
    with pytest.raises(Exception, match="missing or non-finite feature in row 2"):
        lloyd.points(spark.createDataFrame([(1, 1.0), (2, None)], "i int, a double"), "i", ["a"])


# Indices of k

def plain_indices(x, labels, ks, splits):
    """Every index from rows and labels alone."""
    n, p = x.shape
    d = distances(x)
    iu = np.triu_indices(n, 1)
    up = d[iu]
    out = {}
    W, tr, mean, sizes = {}, {}, {}, {}
    for k, l in labels.items():
        own = [x[l == e] for e in range(k)]
        mean[k], sizes[k] = np.array([o.mean(0) for o in own]), [len(o) for o in own]
        W[k] = sum((o - o.mean(0)).T @ (o - o.mean(0)) for o in own)
        tr[k] = np.trace(W[k])
    T = W[1]
    same = {k: (labels[k][:, None] == labels[k][None])[iu] for k in labels}
    within, between = {k: up[same[k]].mean() for k in labels}, {k: up[~same[k]].mean() if (~same[k]).any() else np.nan for k in labels}
    cov = np.cov(x.T)
    eig = np.sqrt(np.sort(np.linalg.eigvalsh(cov))[::-1])

    def stddev(k):
        return np.sqrt(sum(np.linalg.norm(x[labels[k] == e].var(0)) for e in range(k))) / k

    def scat(k):
        return np.mean([np.linalg.norm(x[labels[k] == e].var(0)) for e in range(k)]) / np.linalg.norm(x.var(0))

    def dis(k):
        g = distances(mean[k])
        far = g[~np.eye(k, dtype=bool)]
        return far.max() / far.min() * sum(1 / g[i].sum() for i in range(k))

    diff = lambda k: (k - 1) ** (2 / p) * tr[k - 1] - k ** (2 / p) * tr[k]
    det = {k: np.linalg.det(W[k]) for k in labels}
    for k in ks:
        l, m = labels[k], mean[k]
        s = [np.linalg.norm(x[l == e] - m[e], axis=1).mean() for e in range(k)]
        g = distances(m)
        near = lambda c: (np.linalg.norm(x - c, axis=1) <= stddev(k)).sum()
        dens = sum(near((m[i] + m[j]) / 2) / max(near(m[i]), near(m[j]), 1) for i in range(k) for j in range(k) if i != j) / (k * (k - 1))
        sil = []
        for i in range(n):
            a = d[i][(l == l[i]) & (np.arange(n) != i)]
            b = min(d[i][l == e].mean() for e in range(k) if e != l[i])
            sil.append(0 if not len(a) else (b - a.mean()) / max(a.mean(), b))
        nw = int(same[k].sum())
        q = min(p, k - 1)
        while q > 1 and eig[q - 1] / (np.prod(eig[:q]) / k) ** (1 / q) < 1:
            q -= 1
        u = eig / (np.prod(eig[:q]) / k) ** (1 / q)
        e2 = 1 - (sum(1 / (n + u[j]) for j in range(q)) + sum(u[j] ** 2 / (n + u[j]) for j in range(q, p))) / (u ** 2).sum() * (n - k) ** 2 / n * (1 + 4 / n)
        size, one, two = splits[k]
        crit = 1 - 2 / (np.pi * p) - 3.2 * np.sqrt(2 * max(0, 1 - 8 / (np.pi ** 2 * p)) / (size * p))
        out[k] = {
            "kl": abs(diff(k) / diff(k + 1)), "ch": (tr[1] - tr[k]) / (k - 1) / tr[k] * (n - k), "hartigan": (tr[k - 1] / tr[k] - 1) * (n - k) - (tr[k] / tr[k + 1] - 1) * (n - k - 1),
            "ccc": np.log((1 - e2) / (tr[k] / tr[1])) * np.sqrt(n * q / 2) / (0.001 + e2) ** 1.2, "scott": n * np.log(det[k - 1] / det[k]), "marriot": (k + 1) ** 2 * det[k + 1] - 2 * k ** 2 * det[k] + (k - 1) ** 2 * det[k - 1],
            "trcovw": np.trace(np.cov(W[k - 1])) - np.trace(np.cov(W[k])), "tracew": tr[k - 1] - 2 * tr[k] + tr[k + 1], "friedman": np.trace(np.linalg.inv(W[k]) @ (T - W[k])) - np.trace(np.linalg.inv(W[k - 1]) @ (T - W[k - 1])),
            "rubin": det[1] / det[k + 1] - 2 * det[1] / det[k] + det[1] / det[k - 1], "ratkowsky": np.sqrt((np.diag(T) - np.diag(W[k])) / np.diag(T)).mean() / np.sqrt(k), "ball": tr[k - 1] / (k - 1) - tr[k] / k,
            "db": np.mean([max((s[i] + s[j]) / g[i, j] for j in range(k) if j != i) for i in range(k)]), "sdindex": dis(max(ks)) * scat(k) + dis(k), "sdbw": scat(k) + dens,
            "duda": two / one - crit, "pseudot2": (one - two) / (two / (size - 2)) - (1 - crit) / crit * (size - 2), "beale": (one / two - 1) / ((size - 1) / (size - 2) * 2 ** (2 / p) - 1) - f_quantile(0.9, p, (size - 2) * p),
            "silhouette": np.mean(sil), "dunn": up[~same[k]].min() / up[same[k]].max(), "cindex": (up[same[k]].sum() - np.sort(up)[:nw].sum()) / (np.sort(up)[-nw:].sum() - np.sort(up)[:nw].sum()), "mcclain": within[k] / between[k],
            "ptbiserial": (between[k] - within[k]) * np.sqrt(nw * (len(up) - nw)) / len(up) / up.std(), "frey": (between[k + 1] - between[k]) / (within[k + 1] - within[k]), "dindex": np.mean([np.linalg.norm(x[i] - m[l[i]]) for i in range(n)]),
            "hubert": np.mean(up * g[l[iu[0]], l[iu[1]]]),
        }
    return out


def test_every_index_against_rows_and_labels(spark):
    rng = np.random.default_rng(8)
    x = np.round(np.r_[rng.normal(0, 1, (20, 3)), rng.normal(6, 1, (20, 3)), rng.normal((0, 7, 0), 1, (20, 3))], 2)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "i int, a double, b double, c double").repartition(3)
    ks = [2, 3, 4, 5]
    s = selection.Statistics(df, "i", ["a", "b", "c"], ks, 5)
    values, errors = selection.index_values(s)
    codes = {r.id: r.codes for r in s.rows.collect()}
    labels = {k: np.array([codes[i][j] for i in range(60)]) for j, k in enumerate(s.fitted)}
    own = [x[labels[k] == e] for k in s.fitted for e in range(k)]
    for k in ks:  # a split is of the cluster that gains most, and no worse than halving it at its longest axis
        size, one, two = s.splits[k]
        parts = [x[labels[k] == e] for e in range(k)]
        assert any(len(o) == size and one == pytest.approx(((o - o.mean(0)) ** 2).sum()) for o in parts) and 0 < two < one
    want = plain_indices(x, labels, ks, s.splits)
    for k in ks:
        for name in selection.INDICES:
            assert values[name][k] == pytest.approx(want[k][name], rel=1e-7, abs=1e-9), (name, k)
    assert not errors and len(own) == sum(s.fitted)
    cast = {v["index"]: v for v in selection.votes(values, ks, errors)}
    assert all(cast[i]["k"] == 3 for i in ("ch", "silhouette", "db", "hartigan", "dunn")) and all(cast[i]["status"] == "GRAPHICAL" for i in selection.GRAPHICAL)


def test_an_index_that_fails_is_a_status(spark, monkeypatch):
    x = [(i, float(i // 6 * 10 + i % 6)) for i in range(18)]
    s = selection.Statistics(spark.createDataFrame(x, "i int, a double"), "i", ["a"], [2, 3, 4], 4)

    def broken(*_):
        raise ValueError("no value")

    monkeypatch.setitem(selection.FORMULAS, "ch", broken)
    values, errors = selection.index_values(s)
    cast = {v["index"]: v for v in selection.votes(values, s.ks, errors)}
    assert cast["ch"]["status"] == "ERROR" and "no value" in cast["ch"]["message"] and cast["trcovw"]["status"] == "NO_RESULT"
    assert cast["silhouette"]["k"] == 3 and sum(v["status"] == "VOTE" for v in cast.values()) > 10
    assert selection.votes({n: ({2: 0.5} if n == "frey" else {}) for n in selection.INDICES}, [2])[23]["status"] == "OUT_OF_RANGE"


def test_whole_selection_of_the_small_matrix(spark):
    points = [(x + a, y + b) for a, b in ((0, 0), (10, 0), (5, 9)) for x in (0, 1) for y in (0, 1)]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "i int, a double, b double")
    r = selection.selection(df, "i", ["a", "b"], [2, 3, 4], 4)
    assert r["decision"]["k"] in (2, 3) and not r["decision"]["stop_reasons"]
    assert [x.k for x in r["diagnostics"].orderBy("k").collect()] == [2, 3, 4] and r["diagnostics"].filter("k = 3").head().sizes == "4,4,4"
    assert selection.decide([{"k": 2, "votes": 3, "leader": True}], False)["stop_reasons"] == ["not reproduced"]


def test_f_and_t_quantiles():
    for d1, d2, want in ((1, 10, 3.285015), (5, 20, 2.158227), (2, 2, 9.0)):
        assert f_quantile(0.9, d1, d2) == pytest.approx(want, abs=1e-5)
    assert student_t(0.975, 30) == pytest.approx(2.0422724563, abs=1e-8)


# Quantiles

def test_quantiles_of_groups(spark):
    rng = np.random.default_rng(3)
    values = {"many": rng.normal(0, 1, 30000), "ties": np.r_[np.full(20000, 5.0), rng.random(500)], "skewed": np.exp(rng.normal(0, 6, 25000)), "one": np.array([4.0]), "two": np.array([1.0, 2.0]), "three": np.array([3.0, 1.0, 2.0]), None: rng.random(10)}
    rows = [(g, float(x)) for g, v in values.items() for x in v] + [("one", None), ("nothing", None), ("two", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    qs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    for accuracy in (100, 10_000):
        got = {r.g: list(r)[1:] for r in ranks.quantiles(df, "v", qs, ["g"], accuracy).collect()}
        assert set(got) == set(values)
        for g, v in values.items():
            assert got[g] == pytest.approx(list(np.quantile(v, qs)), rel=1e-12), g
    assert list(ranks.quantiles(df.filter("g = 'many'"), "v", qs).head()) == pytest.approx(list(np.quantile(values["many"], qs)))
    d = {r.g: r for r in audit.describe(df, "v", "g").collect()}
    assert d[None].n == 10 and d["nothing"].median is None and d["ties"].iqr == 0


# Checks inside the plan

def test_guards(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, x string")
    right = spark.createDataFrame([(1, 10), (2, 20)], "k int, y int")
    assert guards.join_many_to_one(left, right, ["k"]).count() == 3
    with pytest.raises(Exception, match="repeated keys of the right side: 1, as k=2 rows=2"):
        guards.join_many_to_one(right, left, ["k"]).collect()
    with pytest.raises(Exception, match="repeated keys of the left side"):
        guards.join_one_to_one(left, right, ["k"]).collect()
    cells = spark.createDataFrame([(i, t) for i, t in enumerate([" 1.5 ", "", None, "x", "nan", "y", "z", "w", "v"])], "i int, c string")
    assert [r.c for r in guards.strict(cells.filter("i < 3"), ["c"]).orderBy("i").collect()] == [1.5, None, None]
    with pytest.raises(Exception, match="cells that are no double: 6, as i=3 column=c value=x") as e:
        guards.strict(cells, ["c"], "double", "i").collect()
    assert str(e.value).split("JVM")[0].count("column=c") == 5  # five examples


def test_slopes_stop(spark):
    df = spark.createDataFrame([(e, float(x), float(x * e)) for e in (1, 2) for x in range(3)], "e int, x double, y double")
    assert trends.slopes_or_stop(df, "e", "x", "y").count() == 2
    flat = df.union(spark.createDataFrame([(9, 1.0, 1.0), (9, 1.0, 2.0)], df.schema))
    with pytest.raises(Exception, match="lines that cannot be fitted: 1, as e=9 failure=x has zero variance"):
        trends.slopes_or_stop(flat, "e", "x", "y").collect()


def test_every_count_of_observations_has_an_interval(spark):
    t = spark.range(3, 15003).select(trends._t_quantile("id", F.lit(0.975)).alias("t"))
    assert t.filter("t is null or t < 1.95 or t > 13").count() == 0


def cohort_input(spark, more=()):
    records = [(1, 11, "P1", "2020-01-01", "5", 1, "bl"), (1, 11, "P1", "2020-07-01", "6.50", 2, "m12"), (1, 11, "P2", "2021-01-01", "7", 3, "m06"), (1, 11, "P9", "2022-01-01", "8", 4, "m48"), (1, 11, "P1", "2020-03-01", "x", 5, "m03"),
               (2, 22, "P1", "2020-01-01", "1", 6, "bl"), (2, 22, "P1", "2020-02-01", "1", 7, ""), (3, 33, "P1", "2020-01-01", "1", 8, ""), (4, 40, "P1", "2020-01-01", "1", 9, ""), (1, 11, "P1", "2020-09-01", "1", 10, ""), (1, 11, "P1", "2020-09-01", "2", 11, "")]
    df = spark.createDataFrame([*records, *more], "id int, rid int, phase string, date string, score string, row int, code string").withColumn("date", F.to_date("date"))
    roster = spark.createDataFrame([(1, 11, "P1"), (2, 22, "P1"), (4, 44, "P1")], "id int, rid int, entry_phase string")
    conflicts = spark.createDataFrame([(1, "2020-09-01")], "id int, date string").withColumn("date", F.to_date("date"))
    return lambda r=roster: trends.longitudinal_cohort(df, r, ["id", "rid"], "phase", ["P1", "P2"], "date", "score", "row", ["code"], conflicts, ["P2"])


def test_cohort_rules(spark):
    got = [(r.id, r.row, r.value, r.observation_number, r.elapsed_days, r.elapsed_years, r.visit_code_date_anomaly_flag, r.participant_anomaly_flag, r.later_phase_flag) for r in cohort_input(spark)().orderBy("row").collect()]
    assert got == [(1, 1, "5", 1, 0, 0.0, 0, 1, 0), (1, 2, "6.50", 2, 182, round(182 / 365.25, 10), 1, 1, 0), (1, 3, "7", 3, 366, round(366 / 365.25, 10), 1, 1, 1)]
    with pytest.raises(Exception, match="rows of one entity and date beyond the known conflicts: 2, as id=1 _date=2020-01-01 row=1; id=1 _date=2020-01-01 row=50"):
        cohort_input(spark, [(1, 11, "P1", "2020-01-01", "5", 50, "")])().collect()
    twice = spark.createDataFrame([(1, 11, "P1"), (1, 11, "P2")], "id int, rid int, entry_phase string")
    with pytest.raises(Exception, match="repeated keys of the right side"):
        cohort_input(spark)(twice).collect()


# Provenance

def test_candidates_and_provenance(spark):
    records = spark.createDataFrame([
        (1, "f", "P1", " sc ", "", "2020-01-02", "SC", 5, "3", "1"), (1, "f", "P1", "sc", "", "2020-01-01", "SC", 6, "3", ""), (1, "f", "P2", "sc", "", "2019-01-01", "SC", 7, "9", "9"), (1, "g", "P1", "sc", "", "2020-01-01", "SC", 8, "8", "8"),
        (2, "f", "P1", "sc", "", None, "SC", 9, "-4", "2"), (2, "f", "P1", "sc", "x", "2020-05-01", "SC", 10, " ", "2"), (3, "f", "P1", "sc", "", "2020-01-01", "SC", 11, "1", "2"), (3, "f", "P1", "sc", "", "2020-01-02", "SC", 12, "2", "2")],
        "e int, file string, phase string, code string, code2 string, date string, visit_class string, source_row int, a string, b string")
    entities = spark.createDataFrame([(1, "P1"), (2, "P1"), (3, "P1"), (4, "P1")], "e int, entry_phase string")
    spec = spark.createDataFrame([("v", "f", ["SC"], ["a"], "direct"), ("w", "f", ["SC", "BL"], ["a", "b"], "sum")], "variable string, file string, classes array<string>, fields array<string>, mode string")
    found = resolve.resolve_variables(resolve.candidate_rows(records, entities, spec, "e", ["a", "b"]), "e")
    r = {x.e: x for x in resolve.provenance_table(found, entities, spec, "e").collect()}
    assert len(r[1]) == 1 + 2 * 8
    assert (r[1].v, r[1].v_SOURCE_DATE, r[1].v_SOURCE_VISCODE, r[1].v_MISSING_REASON) == (3, "2020-01-01", "sc", "")
    assert (r[1].w, r[1].w_SOURCE_DATE) == (4, "2020-01-02")  # the only complete row
    assert (r[2].v, r[2].v_MISSING_REASON, r[2].v_SOURCE_VISCODE2, r[2].w_MISSING_REASON) == (None, "MINUS4", "x", "FAILED_DERIVATION")
    assert (r[3].v, r[3].v_MISSING_REASON, r[3].v_SOURCE_PHASE, r[3].v_SOURCE_FILE) == (None, "UNRESOLVED_DUPLICATE_QC", "", "f")
    assert (r[4].v, r[4].v_MISSING_REASON, r[4].w_MISSING_REASON) == (None, "UNAVAILABLE_PHASE_INSTRUMENT", "UNAVAILABLE_PHASE_INSTRUMENT")
    table = resolve.provenance_table(found, entities, spec, "e")
    assert resolve.checked_table(table, entities, "e", ["v", "w"]).count() == 4
    with pytest.raises(Exception, match="entities: 1, as e=4 problem=not eligible"):
        resolve.checked_table(table, entities.filter("e < 4"), "e", ["v"]).collect()
    with pytest.raises(ValueError):
        resolve.candidate_rows(records, entities, spec, "e", ["a", "b"], max_spec=1)


# Stability, digests, gates

def test_pair_tables_of_runs(spark):
    rng = np.random.default_rng(6)
    labels = rng.integers(0, 3, (40, 4))
    rows = [(i, r, int(labels[i, r])) for i in range(40) for r in range(4) if (i, r) != (3, 2)]
    runs = spark.createDataFrame(rows, "i int, run int, label int").repartition(5)
    got = {(r.run_a, r.run_b, r.la, r.lb): r.n for r in stability.run_contingency(runs, "i").collect()}
    want = {}
    for i in range(40):
        for a in range(4):
            for b in range(a + 1, 4):
                if (i, a) != (3, 2) and (i, b) != (3, 2):
                    key = (a, b, labels[i, a], labels[i, b])
                    want[key] = want.get(key, 0) + 1
    assert got == want
    with pytest.raises(ValueError):
        stability.run_contingency(runs, "i", max_clusters=5)


def test_digest_of_sorted_lines(spark):
    rows = [(g, f"{i * 7919 % 1000}|é{i}") for g in ("x", "y") for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, line string").repartition(7)
    want = {g: sha256("".join(sorted(t + "\n" for k, t in rows if k == g)).encode()).hexdigest() for g in ("x", "y")}
    assert {r.g: r.sha256 for r in digests.sorted_digest(df, ["g"], F.col("line")).collect()} == want
    whole = digests.sorted_digest(df, [], F.col("line")).head()
    assert (whole.n_lines, whole.sha256) == (2000, sha256("".join(sorted(t + "\n" for _, t in rows)).encode()).hexdigest())
    assert digests.sorted_digest(df.limit(0), ["g"], F.col("line")).count() == 0


def test_manifest_of_large_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    with (tmp_path / "big").open("wb") as f:  # sparse: beyond what one array of bytes can hold
        f.truncate(3 << 30)
        f.seek(1 << 30)
        f.write(b"x")
    (tmp_path / "sub" / "a b.txt").write_text("hello")
    before = digests.file_manifest(spark, str(tmp_path))
    r = {x.file: x for x in before.collect()}
    state = sha256()
    with (tmp_path / "big").open("rb") as f:
        while piece := f.read(1 << 24):
            state.update(piece)
    assert r["big"].bytes == 3 << 30 and r["big"].sha256 == state.hexdigest()
    assert r["a b.txt"].sha256 == sha256(b"hello").hexdigest()
    (tmp_path / "big").unlink()
    own = spark.createDataFrame(digests.file_manifest(spark, str(tmp_path)).collect())
    (tmp_path / "sub" / "a b.txt").write_text("hullo")
    (tmp_path / "new").write_text("")
    after = digests.file_manifest(spark, str(tmp_path))
    assert sorted(x.change for x in digests.changed_files(own, after).collect()) == ["ADDED", "CHANGED"] and digests.changed_files(after, after).count() == 0
    assert digests.tree_digest(after).head().n_files == 2


DOCUMENT = {"inertia": 1.5, "votes": {"2": 9, "3": 2}, "k": 2, "input_sha256": "ab", "max_nc": 10, "metrics": [{"k": 2, "silhouette": 0.5, "inertia": 3.25}], "summary_path": "/a", "flag": True, "none": None, "empty": []}


@pytest.mark.parametrize("change,passes", [
    (lambda d: d, True), (lambda d: d["metrics"][0].update(inertia=3.25 + 2e-11), False), (lambda d: d["metrics"][0].update(inertia=3.25 + 5e-12), True), (lambda d: d["votes"].update({"3": 3}), False), (lambda d: d.update(k=3), False), (lambda d: d.update(input_sha256="0" * 64), False),
    (lambda d: d.update(max_nc=9), False), (lambda d: d["metrics"][0].update(silhouette=0.5 + 1e-13), False), (lambda d: d.update(summary_path="/b"), True), (lambda d: d.update(flag=False), False), (lambda d: d.update(more=1), False), (lambda d: d.update(k="2"), False), (lambda d: d.update(none=0), False)])
def test_repeat_gate_of_documents(spark, change, passes):
    changed = json.loads(json.dumps(DOCUMENT))
    change(changed)
    doc = lambda d: spark.createDataFrame([("r", json.dumps(d))], "id string, text string")
    gate = stability.document_gate(doc(DOCUMENT), doc(changed), "id", "text", {"inertia": 1e-11}, ["summary_path"])
    rows = {r.path: r for r in gate.collect()}
    assert all(r.same for r in rows.values()) == passes and rows["metrics[0].inertia"].rule == "real within 1.0E-11" and rows["summary_path"].rule == "ignored"


def test_trend_document(spark):
    p = spark.createDataFrame([(1, 2, 66.7, 0.7, 0.6), (2, 1, 33.3, 9.0, 9.0)], "ordered_cluster int, n long, percent double, centre double, median double")
    votes, cohort = spark.createDataFrame([(2, 8)], "k int, votes int"), spark.createDataFrame([(e,) for e in (1, 1, 1, 2, 2, 2, 3, 3, 3, 3)], "entity int")
    m = spark.createDataFrame([(0.7, 0.5, 10.0)], "silhouette double, davies_bouldin double, calinski_harabasz double")
    doc = lambda q=p, k=2: reporting.trend_document(q, votes, cohort, m, "r", k, 0)
    d = doc().head()
    assert (d.participants, d.observations, d.n_members, d.profiles[1].variable_means["centre"]) == (3, 10, 3, 9.0)
    failed = lambda x: [r.check for r in reporting.trend_document_rules(x, [2, 3]).filter("not passed").collect()]
    assert failed(doc()) == []
    assert failed(doc(k=4)) == ["k_in_candidates", "k_was_voted_on", "profiles_equal_k"]
    assert failed(doc(p.withColumnRenamed("median", "PTID"))) == ["no_identifiers"]
    assert failed(doc(p.withColumn("n", F.col("n") + 1))) == ["members_equal_participants", "retained_at_most_initial"]
    assert failed(doc(p.filter("ordered_cluster = 2"))) == ["profiles_equal_k", "members_equal_participants", "profiles_in_order"]


def test_sorted_output_keeps_digits(spark, tmp_path):
    df = spark.createDataFrame([(i, 0.1 * i) for i in range(50)], "i int, x double").repartition(6)
    tables.write_csv(df, str(tmp_path / "o"), ["i"])
    lines = [t for f in sorted((tmp_path / "o").glob("part-*")) for t in f.read_text().split("\n")[1:] if t]
    assert [int(t.split(",")[0]) for t in lines] == list(range(50)) and [float(t.split(",")[1]) for t in lines] == [0.1 * i for i in range(50)]
