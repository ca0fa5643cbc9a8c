"""Sharding by sampled splitters: ranges of a key with near-equal bytes.

The key's high half hashes the text (copies lie side by side), its low half the
doc_id and the row's place in the written table, so that even one huge group of equal rows can be cut.
A size-weighted sample of keys, bounded by its expected size, is sorted; every so many-th
key is a quantile boundary.  Ranges whose exact bytes exceed twice their share are sampled again and
subdivided, until none is overfull or holds one key alone; exact prefix sums over ranges and inside each range
then place every record.

Defined cases: null text counts 16 bytes and CRC 0; repeated rows keep a row
each; null doc_ids are keys like others; very long texts fill ranges alone; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed


def _range_of(splitters: np.ndarray):
    cuts = np.asarray(splitters, dtype=np.int64)

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, key.to_numpy(np.int64), side="right").astype(np.int32))

    return range_of


def _weighted_sample(rows: DataFrame, m: int, total: int, seed: int) -> np.ndarray:
    """Sorted keys, about m: each row is drawn with probability ``1 - exp(-m size / total)``, so at most m are expected."""
    u = (F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(1 << 40)) + 1) / float(1 << 40)
    drawn = rows.filter(-F.log(u) / F.col("size") < F.lit(m / max(1, total))).select("key")
    return np.sort(np.array([r[0] for r in drawn.collect()], dtype=np.int64))


def _quantiles(keys: np.ndarray, parts: int) -> np.ndarray:
    """Boundaries that cut the sample in parts of equal weight."""
    at = np.arange(1, parts) * len(keys) // max(1, parts)
    return np.unique(keys[at[at < len(keys)]]) if len(keys) else keys


def shard(docs: DataFrame, shards: int = 40, ranges: int = 512, range_bytes: int = 64 << 20, oversample: int = 16, seed: int = 11) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``; there are at least ``ranges``, and more as bytes grow, so that a range's window does not grow with the table."""
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    high = F.shiftleft(F.shiftright(F.xxhash64(F.coalesce("text", F.lit(""))), 32), 32)
    rows = checkpointed(docs.select("doc_id", (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).cast("long").alias("text_crc32"), high.alias("high")))
    low = F.pmod(F.xxhash64(F.lit(seed), "doc_id", F.monotonically_increasing_id()), F.lit(1 << 32))  # places in a written table do not change
    rows = checkpointed(rows.select("doc_id", "size", "text_crc32", F.col("high").bitwiseOR(low).alias("key")))
    total = rows.agg(F.sum("size")).head()[0] or 0
    ranges = max(ranges, -(-total // range_bytes))
    cuts = _quantiles(_weighted_sample(rows, ranges * oversample, total, seed), ranges)
    limit, again = 2 * total / ranges, 0
    while True:
        again += 1
        ranged = rows.withColumn("range", _range_of(cuts)("key"))
        totals = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
        full = totals.filter((F.col("bytes") > limit) & (F.col("n") > 1)).select("range", "bytes").collect()  # of at most twice as many ranges as asked for
        if not full:
            break
        over = ranged.filter(F.col("range").isin([r["range"] for r in full]))
        keys = _weighted_sample(over, len(full) * oversample * 4, sum(r["bytes"] for r in full), seed + again)
        parts = np.searchsorted(cuts, keys, side="right")
        new = [_quantiles(keys[parts == r["range"]], int(-(-2 * r["bytes"] // limit)) + 1) for r in full]
        grown = np.unique(np.concatenate([cuts, *new]))
        if len(grown) == len(cuts):
            break  # what is left over is a few rows larger than any range
        cuts = grown
    ranged = rows.withColumn("range", _range_of(cuts)("key"))
    # Rows of this table are ranges: bounded by the splitters.
    totals = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("range", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("b0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("r0"),
                          F.sum("bytes").over(Window.partitionBy(F.lit(0))).alias("total"))
    inside = Window.partitionBy("range").orderBy("key", "doc_id", "size")
    upto = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = ranged.withColumn("upto", upto).withColumn("row", F.row_number().over(inside)).join(F.broadcast(bases), "range")
    mid = (F.col("b0") + F.col("upto")) * 2 - F.col("size")
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(mid * shards / (F.col("total") * 2))).cast("int")).withColumn("rank", F.col("r0") + F.col("row") - 1)
    placed = checkpointed(placed.select("doc_id", "size", "text_crc32", "shard", "rank"))
    first = placed.groupBy("shard").agg(F.min("rank").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
