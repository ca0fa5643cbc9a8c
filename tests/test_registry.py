"""Every registered query against its SQL in DuckDB."""

import duckdb
import pytest

from trendloom.plans import registry, study

SF = "/root/testdata/sf0.01"
QUERIES, SQL = registry.QUERIES | study.QUERIES, registry.SQL | study.SQL
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


def plain(x):
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) or type(x).__name__ == "Decimal" else str(x)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    rel = con.sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    got, want = (sorted((tuple(map(plain, r)) for r in rows), key=str) for rows in (df.select(*rel.columns).collect(), rel.fetchall()))
    assert len(got) == len(want) > 0
    for g, w in zip(got, want):
        assert all(a == pytest.approx(b, abs=2e-6, rel=1e-9) if isinstance(a, float) and isinstance(b, float) else a == b for a, b in zip(g, w)), (g, w)


def test_others_are_tested_elsewhere():
    assert set(QUERIES) - set(SQL) == {"pca_scores", "pca_scree", "pca_loadings", "replicated_runs", "k_means_plus_plus", "index_votes", "k_diagnostics", "k_selection"}
