"""SHA-256 prints of sorted lines, and of files in pieces.

A digest of sorted lines is sequential by definition: the lines of a group are sorted by Spark (which spills) and
stream through one task a group, so memory is bounded and groups run side by side.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PIECE = 8 << 20


def sorted_digest(df: DataFrame, by: list[str], line: Column) -> DataFrame:
    """``by.., n_lines, sha256``: of the group's lines, sorted bytewise, each ended by a line feed."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by).schema] + ["n_lines long", "sha256 string"])
    rows = df.select(*by, line.cast("string").alias("_line"))
    rows = rows.repartition(*by) if by else rows.repartition(1)

    def run(batches):
        own, state, n = None, None, 0
        done = lambda: pa.RecordBatch.from_arrays([*(pa.array([v], t) for v, t in zip(own, types)), pa.array([n]), pa.array([state.hexdigest()])], names=[*by, "n_lines", "sha256"])
        for batch in batches:
            types = [batch.schema.field(c).type for c in by]
            lines = batch.column("_line").to_pylist()
            for key, text in zip(zip(*(batch.column(c).to_pylist() for c in by)) if by else [()] * len(lines), lines):
                if key != own or state is None:
                    if state is not None:
                        yield done()
                    own, state, n = key, sha256(), 0
                state.update(((text or "") + "\n").encode())
                n += 1
        if state is not None:
            yield done()

    return rows.sortWithinPartitions(*by, "_line").mapInArrow(run, schema)


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``file, path, bytes, sha256`` of every file below a path, of any size: names and sizes come from a listing, and a
    task reads a file piece by piece."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found, rows = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(hadoop, True), []
    while found.hasNext():  # names and sizes, as a scan lists them too; a scan would leave out empty files
        f = found.next()
        rows.append((f.getPath().toString(), f.getLen()))
    listed = spark.createDataFrame(rows, "path string, bytes long")

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            prints = []
            for p in batch.column("path").to_pylist():
                if p.startswith("file:"):  # Spark writes file:/a as well as file:///a
                    where, name = fs.LocalFileSystem(), "/" + p.removeprefix("file:").lstrip("/")
                else:
                    where, name = fs.FileSystem.from_uri(p)
                state = sha256()
                with where.open_input_stream(name, buffer_size=0) as f:
                    while piece := f.read(PIECE):
                        state.update(piece)
                prints.append(state.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("bytes"), pa.array(prints, pa.string())], names=["path", "bytes", "sha256"])

    hashed = listed.repartition(F.col("path")).mapInArrow(run, "path string, bytes long, sha256 string")
    return hashed.select(F.substring_index("path", "/", -1).alias("file"), "path", "bytes", "sha256")


def tree_digest(files: DataFrame) -> DataFrame:
    """Files, bytes and one print over ``path|sha256`` lines."""
    total = files.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    return total.crossJoin(sorted_digest(files, [], F.concat_ws("|", "path", "sha256")).select(F.col("sha256").alias("tree_sha256")))  # one row each


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files of two manifests that differ: ``ADDED``, ``REMOVED`` or ``CHANGED``; no rows if the trees are equal."""
    j = before.select("path", F.col("sha256").alias("before")).join(after.select("path", F.col("sha256").alias("after")), "path", "full")
    kind = F.when(F.col("before").isNull(), "ADDED").when(F.col("after").isNull(), "REMOVED").when(F.col("before") != F.col("after"), "CHANGED")
    return j.select("path", kind.alias("change"), "before", "after").filter("change is not null")
