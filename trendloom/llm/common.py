"""Small helpers shared by the corpus operators.

Intermediate tables and checkpoints lie in the shared folder that the session
names in ``spark.checkpoint.dir``.  Only a session with a local master may go
without it (tests); a cluster without a shared folder is refused.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage by a reliable checkpoint in the shared folder of the session."""
    sc = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


#: Texts go to Python workers in batches of so many rows: a batch lies whole in the executor's buffers and in the worker.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> str:
    """From now on the session sends Arrow batches of at most ``rows`` rows; the setting before."""
    before = spark.conf.get(_BATCH)
    if not 0 < int(before) <= rows:
        spark.conf.set(_BATCH, rows)
    return before


@contextmanager
def batches_of(spark: SparkSession, rows: int = BATCH_ROWS):
    """The same for what is run inside."""
    before = small_batches(spark, rows)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


class Tables:
    """Parquet tables of one operator in the shared folder; ``drop`` frees those that are no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.paths = spark, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}", {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        for name in names:
            for path in self.paths.pop(name, []):
                p = hadoop.Path(path)
                p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame) -> DataFrame:
    """Cut lineage by a Parquet table in the shared folder: smaller than a checkpoint, and read by column."""
    return Tables(df.sparkSession).write(df, "table")


def code_point_key(col) -> "F.Column":
    """Order of strings by code point is the order of their UTF-8 bytes; null last."""
    return F.coalesce(F.concat(F.lit("0"), F.hex(F.encode(col, "UTF-8"))), F.lit("1"))


#: Integer components are held within this, so that products and squared distances fit in 64 bits.
INTEGER_LIMIT = 1 << 24


def integer_vectors(vectors: DataFrame, scale: int, *keep: str) -> DataFrame:
    """``vec_id, keep.., v``: components as floor(scale * x); rows with a null vector or a null or non-finite component go."""
    v = vectors.select("vec_id", *keep, F.col("embedding").cast("array<double>").alias("v")).filter("v is not null")
    v = v.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    whole = F.transform("v", lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(float(INTEGER_LIMIT))), F.lit(-float(INTEGER_LIMIT)))).cast("int"))
    return v.withColumn("v", whole)


def padded(v: DataFrame, dim: int) -> DataFrame:
    """Shorter vectors get zeros behind."""
    return v.withColumn("v", F.concat("v", F.array_repeat(F.lit(0), F.lit(dim) - F.size("v"))))


def runs(batches, *keys: str):
    """Slices of consecutive rows of Arrow batches with equal keys: ``(key, slice)``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        edges = [0, *change.tolist(), batch.num_rows]
        for a, z in zip(edges, edges[1:]):
            yield tuple(c[a] for c in columns), batch.slice(a, z - a)


def matrix(batch, name: str, dim: int) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)
