"""Feature preparation: median fill, population z-scores, principal components."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import exact_quantile


def medians(df: DataFrame, features: list[str], exact_rows: int = 10_000_000) -> dict[str, float | None]:
    """Exact medians: one aggregation, or rank selection in two passes where a column has many rows."""
    if df.count() > exact_rows:
        return {c: exact_quantile(df, c, 0.5) for c in features}
    return df.agg(*[F.median(c).alias(c) for c in features]).head().asDict()


def median_impute(df: DataFrame, features: list[str]) -> DataFrame:
    m = medians(df, features)
    return df.select(*[F.coalesce(F.col(c), F.lit(m[c])).alias(c) if c in features else F.col(c) for c in df.columns])


def impute_summary(df: DataFrame, features: list[str]) -> DataFrame:
    """Per feature: missing, median, range before and after."""
    m = medians(df, features)
    parts = df.agg(*[F.struct(F.lit(c).alias("feature"), F.count_if(F.col(c).isNull()).alias("n_missing"), F.round(F.count_if(F.col(c).isNull()) * 100.0 / F.count(F.lit(1)), 6).alias("pct_missing"), F.lit(m[c]).cast("double").alias("median"), F.min(c).alias("min_before"), F.max(c).alias("max_before"),
                                F.min(F.coalesce(c, F.lit(m[c]))).alias("min_after"), F.max(F.coalesce(c, F.lit(m[c]))).alias("max_after")).alias(f"s{i}") for i, c in enumerate(features)])
    return parts.select(F.explode(F.array(*[f"s{i}" for i in range(len(features))])).alias("s")).select("s.*")


def expect_missing(df: DataFrame, expected: dict[str, int]) -> None:
    """Per-feature missing counts must be as expected before imputing."""
    got = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in expected]).head().asDict()
    wrong = {c: (got[c], n) for c, n in expected.items() if got[c] != n}
    if wrong:
        raise ValueError(f"missing counts (found, expected): {wrong}")


def standardize(df: DataFrame, features: list[str]) -> DataFrame:
    """Population z-score; a feature without spread is refused."""
    stats = df.agg(*[f for c in features for f in (F.avg(c).alias(f"a_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).head().asDict()
    flat = [c for c in features if (stats[f"s_{c}"] or 0) <= 1e-12]
    if flat:
        raise ValueError(f"no spread in {flat}")
    return df.select(*[((F.col(c) - stats[f"a_{c}"]) / stats[f"s_{c}"]).alias(c) if c in features else F.col(c) for c in df.columns])


def check_standardized(df: DataFrame, features: list[str], tolerance: float = 1e-9) -> None:
    r = df.agg(*[F.greatest(F.abs(F.avg(c)), F.abs(F.stddev_pop(c) - 1)).alias(c) for c in features]).head().asDict()
    bad = {c: v for c, v in r.items() if v is None or v > tolerance}
    if bad:
        raise ValueError(f"mean 0 and deviation 1 missed by {bad}")


def gram(df: DataFrame, features: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and covariance matrix: each task hands on one row with its sums and products, taken about the first
    row of the table, so that little cancels.  Width costs matrix products, not compiled expressions."""
    p = len(features)
    x = df.select(F.array(*[F.col(c).cast("double") for c in features]).alias("x")).filter(F.forall("x", lambda v: v.isNotNull()))
    first = x.head()
    if first is None:
        return 0, np.full(p, np.nan), np.full((p, p), np.nan)
    base, upper = np.array(first[0]), np.triu_indices(p)

    def run(batches):
        n, s, w = 0, np.zeros(p), np.zeros((p, p))
        for batch in batches:
            own = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, p) - base
            n, s, w = n + len(own), s + own.sum(0), w + own.T @ own
        yield pa.RecordBatch.from_arrays([pa.array([np.r_[n, s, w[upper]].tolist()], pa.list_(pa.float64()))], names=["t"])

    total = x.mapInArrow(run, "t array<double>").select(F.posexplode("t").alias("at", "v")).groupBy("at").agg(F.sum("v")).collect()  # as many rows as sums
    t = np.zeros(1 + p + len(upper[0]))
    for at, v in total:
        t[at] = v
    n, s, w = int(t[0]), t[1:p + 1], np.zeros((p, p))
    w[upper] = t[p + 1:]
    w = w + np.triu(w, 1).T - np.outer(s, s) / n
    return n, base + s / n, w / (n - 1) if n > 1 else np.full((p, p), np.nan)


def covariances(df: DataFrame, features: list[str]) -> DataFrame:
    """Upper triangle of the sample covariance matrix, a row a pair of features."""
    _, _, c = gram(df, features)
    rows = [(a, features[j], round(float(c[i, j]), 6)) for i, a in enumerate(features) for j in range(i, len(features))]
    return df.sparkSession.createDataFrame(rows, "a string, b string, covariance double")


@dataclass
class Components:
    """Eigenvalues in falling order, their shares, how many are kept, and the loadings (a column a component)."""

    features: list[str]
    values: np.ndarray
    ratio: np.ndarray
    keep: int
    vectors: np.ndarray
    means: np.ndarray

    def scree(self, spark) -> DataFrame:
        """A row a component: eigenvalue, share, cumulative share, kept."""
        rows = [(f"PC{i + 1}", float(v), float(r), float(c), i < self.keep) for i, (v, r, c) in enumerate(zip(self.values, self.ratio, np.cumsum(self.ratio)))]
        return spark.createDataFrame(rows, "component string, eigenvalue double, ratio double, cumulative double, kept boolean")

    def loadings(self, spark) -> DataFrame:
        """A row a feature and kept component."""
        rows = [(c, f"PC{k + 1}", float(self.vectors[i, k])) for i, c in enumerate(self.features) for k in range(self.keep)]
        return spark.createDataFrame(rows, "feature string, component string, loading double")

    def scores(self, df: DataFrame) -> DataFrame:
        """Other columns, and the kept scores as ``PC1..``: one matrix product a batch."""
        rest = [c for c in df.columns if c not in self.features]
        names, means, weights = [f"PC{k + 1}" for k in range(self.keep)], self.means, self.vectors[:, : self.keep]
        p = len(self.features)
        x = df.select(*rest, F.array(*[F.col(c).cast("double") for c in self.features]).alias("_x"))
        schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*rest).schema] + [f"{n} double" for n in names])

        def run(batches):
            for batch in batches:
                s = (batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(-1, p) - means) @ weights
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *(pa.array(s[:, k]) for k in range(len(names)))], names=[*rest, *names])

        return x.mapInArrow(run, schema)


def components(df: DataFrame, features: list[str], share: float = 0.85) -> Components:
    """The fewest components whose cumulative share reaches ``share``: p*p sums in Spark, the small eigenproblem here."""
    _, means, cov = gram(df, features)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    # Sign rule: the loading of largest magnitude is positive.
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), range(len(features))])
    ratio = values / values.sum()
    keep = min(len(features), int(np.searchsorted(np.cumsum(ratio), share - 1e-12)) + 1)
    return Components(features, values, ratio, keep, vectors, means)


def pca_totals(c: Components, spark) -> DataFrame:
    """What the eigenvalues must add up to: total variance, and the sum of squared covariances."""
    return spark.createDataFrame([(len(c.values), round(float(c.values.sum()), 6), round(float((c.values ** 2).sum()), 6))], "n_components int, total_variance double, squared double")
