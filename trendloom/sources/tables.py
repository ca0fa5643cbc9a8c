"""Raw-text sources, contracts, sinks and a versioned store of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_raw_csv(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Every column a string; blanks stay ``""``; a byte-order mark goes.  ``multiline`` only where a quoted cell holds a line break: it reads a file in one task."""
    df = spark.read.csv(path, header=True, inferSchema=False, escape='"', multiLine=multiline)
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c.lstrip("﻿")) for c in df.columns])


def inferred_types(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    return spark.read.csv(path, header=True, inferSchema=True, escape='"').dtypes


def with_row_number(df: DataFrame, start: int = 2) -> DataFrame:
    """Line numbers of a scan in its own order: numbers within each partition and offsets of a row a partition, JVM-side."""
    parts = df.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    counts = sorted(tuple(r) for r in parts.groupBy("_part").count().collect())
    base, total = [], start
    for p, n in counts:
        base += [F.lit(p), F.lit(total)]
        total += n
    # The id counts from (partition << 33) without gaps, so no window is needed.
    offset = F.try_element_at(F.create_map(*base), F.col("_part")) if base else F.lit(start)
    return parts.withColumn("source_row", (offset + F.col("_at").bitwiseAND((1 << 33) - 1)).cast("long")).drop("_part", "_at")


def read_json_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def key_value_map(df: DataFrame, key: str = "metric", value: str = "value") -> DataFrame:
    """A small key-value artifact as one map; a key that repeats keeps its greatest value."""
    one = df.groupBy(key).agg(F.max(value).alias(value))
    return one.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias("values"))


def contract_violations(columns: list[str], required: list[str]) -> list[str]:
    return [f"missing:{c}" for c in required if c not in columns] + [f"unexpected:{c}" for c in columns if c not in required]


def check_manifest(spark: SparkSession, folder: str, spec: dict[str, list[str]]) -> DataFrame:
    """All violations together: files missing, files unexpected, columns missing."""
    files = spark.read.format("binaryFile").load(folder).select(F.substring_index("path", "/", -1).alias("file")).distinct()
    want = spark.createDataFrame([(f,) for f in spec], "file string")
    found = [r[0] for r in files.join(want, "file", "left_semi").collect()]  # as many as the contract has
    lost = [(f, c) for f in found for c in spec[f] if c not in [x.lstrip("﻿") for x in spark.read.csv(f"{folder}/{f}", header=True).columns]]
    return want.join(files, "file", "left_anti").select("file", F.lit("missing file").alias("violation")).union(
        files.join(want, "file", "left_anti").select("file", F.lit("unexpected file"))).union(
        spark.createDataFrame([(f, f"missing column {c}") for f, c in lost], "file string, violation string"))


def matrix_problems(df: DataFrame, ids: str, features: list[str], expected_rows: int | None = None) -> DataFrame:
    """One row of counts: blank ids, repeated ids, non-finite cells, rows beside the expected number."""
    wrong = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    n = F.count(F.lit(1))
    return df.agg(F.count_if(F.col(ids).isNull() | (F.trim(F.col(ids).cast("string")) == "")).alias("blank_ids"), (F.count(ids) - F.count_distinct(ids)).alias("repeated_ids"), sum(F.count_if(wrong(c)) for c in features).alias("bad_cells"),
                  (F.lit(0) if expected_rows is None else F.abs(n - expected_rows)).cast("long").alias("row_difference"))


def validate_matrix(df: DataFrame, ids: str, features: list[str], expected_rows: int | None = None) -> DataFrame:
    r = matrix_problems(df, ids, features, expected_rows).head().asDict()
    if any(r.values()):
        raise ValueError(f"invalid matrix: {r}")
    return df


def write_csv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """CSV with header, UTF-8, doubles with 17 significant digits; with ``order``, rows in that total order over the files in turn."""
    digits = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.format_string("%.16e", F.col(c))).otherwise(F.col(c).cast("string"))
    exact = df.orderBy(*order) if order else df
    exact = exact.select(*[digits(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
    exact.write.mode("overwrite").csv(path, header=True, encoding="UTF-8")


def write_json(df: DataFrame, path: str) -> None:
    """JSON report; a NaN in any top-level number is refused (one job for all columns)."""
    numbers = [c for c, t in df.dtypes if t in ("double", "float")]
    if numbers:
        bad = [c for c, n in df.agg(*[F.count_if(F.isnan(c)).alias(c) for c in numbers]).head().asDict().items() if n]
        if bad:
            raise ValueError(f"NaN in {bad}")
    df.write.mode("overwrite").json(path)


def list_runs(store: DataFrame) -> DataFrame:
    return store.orderBy(F.desc("created_at"), "run_id")


def get_run(store: DataFrame, run_id: str) -> DataFrame:
    return store.filter(F.col("run_id") == run_id)


def upsert_runs(store: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of the store with new runs in place of those of equal id; written to a new version by the caller."""
    return store.join(new.select("run_id").distinct(), "run_id", "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_pair(store: DataFrame, a: DataFrame, b: DataFrame, slots=("A", "B")) -> DataFrame:
    """Two runs together: ids must differ and axes match their slots."""
    both = [x.select("run_id", "axis").collect() for x in (a, b)]
    if any(len(x) != 1 for x in both) or both[0][0]["run_id"] == both[1][0]["run_id"] or (both[0][0]["axis"], both[1][0]["axis"]) != slots:
        raise ValueError("a pair needs two runs of different ids, one for each axis")
    return upsert_runs(store, a.unionByName(b, allowMissingColumns=True))
