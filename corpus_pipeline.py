"""Corpus pipeline: five stages, each written as Parquet and read again by the next.

Defined cases, as in the operators: null or letterless text goes in the first stage; null and repeated doc_ids
stay apart by a hash of the whole row; equal rows are copies; empty tables pass through; columns beside those of
documents are dropped; very long texts are worked on whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trendloom.llm import jaccard, langid, mixing, packing, pii
from trendloom.llm.common import shared_folder, small_batches, table
from trendloom.llm.queries import ranks, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark, docs, sf_dir):
    """Documents without a recognised language go; ``lang`` becomes the predicted one."""
    small_batches(spark)  # stages run when they are written, so the session keeps the setting
    out = langid.identify(docs.select(*COLUMNS))
    return out.filter("lang_pred <> 'und'").withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark, docs, sf_dir):
    """One row of each group of near copies stays: that of the smallest doc_id (null last), then of the smallest row hash.

    Rows are told apart by a hash of all columns, so a null doc_id, or one that
    several texts share, decides nothing; equal rows are copies of each other.
    """
    rows = docs.select(F.xxhash64(*[F.col(c).isNull() for c in COLUMNS], *COLUMNS).alias("_row"), *COLUMNS)
    groups = jaccard.join_components(rows.select(F.col("_row").alias("doc_id"), "text"))
    groups = groups.select(F.col("doc_id").alias("_row"), "component_id").distinct()
    best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row"))
    keep = groups.join(rows.select("_row", "doc_id"), "_row").groupBy("component_id").agg(best.alias("best")).select("best._row")
    return rows.join(keep, "_row", "left_semi").dropDuplicates(["_row"]).select(*COLUMNS)


def redact(spark, docs, sf_dir):
    """Personal data is replaced by its kind."""
    return pii.redact(docs.select(*COLUMNS))


def mix(spark, docs, sf_dir):
    """Each source's documents, in seeded order, as often as its quota of words asks; the last one is cut to it."""
    return mixing.mixed(docs.select(*COLUMNS))


def pack(spark, docs, sf_dir):
    """Pieces of packed sequences."""
    small_batches(spark)
    return packing.pack(docs, tokenizer_path(), **ranks())


STAGES = [("language_id", language_id), ("jaccard_join", near_duplicates), ("pii", redact), ("mixing", mix), ("packing", pack)]
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``; each result lies in the shared checkpoint folder."""
    shared = shared_folder(spark)
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        path = f"{shared}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
