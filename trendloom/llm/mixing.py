"""Mixing sources to target weights by Sainte-Lague apportionment (native SQL).

Each source's words, in a seeded order of its documents, form a stream cut into
equal blocks.  Sources get targets by weight (capped at ``max_repeat`` times
their size, excess reshared); whole blocks are awarded by highest quotients
``target / (2 s + 1)``; quotas are then dealt to shards as integers, and blocks picked in seeded
order within each.  Windows without keys hold a row a source.

Defined cases: null text has size 0; null source is a source of its own (last);
an empty table gives no rows; equal rows keep one row each; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, code_point_key

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(per_source: DataFrame, weights=(5.0, 2.0, 1.0), share=1.5, max_repeat=2.0) -> DataFrame:
    """``(source, source_size)`` to targets; water-filling in closed form.

    Sources sorted by size/weight saturate in that order: source i is capped
    exactly if its cap is below its share of what the earlier caps leave.
    One row per source, so the ordered windows see sources, not documents.
    """
    by_name = Window.orderBy("source_key")
    w = F.array(*[F.lit(float(x)) for x in weights])
    t = per_source.withColumn("source_key", code_point_key("source")).withColumn(
        "weight", F.get(w, (F.row_number().over(by_name) - 1) % len(weights)))
    t = t.withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
    everything = Window.partitionBy(F.lit(0))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), "source_key")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    t = t.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
    t = t.withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    t = t.withColumn("level", F.col("left") / F.sum("weight").over(after))
    t = t.withColumn("full", F.col("cap") <= F.col("weight") * F.col("level"))
    t = t.withColumn("free_level", F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), "source_key", "level"))).over(everything)["level"])
    return t.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * F.col("free_level"))).select(
        "source", "source_key", "source_size", "target")


def apportion(targets: DataFrame, block: int, max_repeat: float) -> DataFrame:
    """Exact Sainte-Lague quotas of ``round(sum target / block)`` equal blocks.

    Seats at two divisors, one surely too low and one surely too high, leave at
    most about two open seats a source; the highest quotients take them.
    """
    everything = Window.partitionBy(F.lit(0))
    t = targets.withColumn("w", F.sum("target").over(everything)).withColumn("n", F.count(F.lit(1)).over(everything))
    t = t.withColumn("seats", F.round(F.col("w") / block))
    at = lambda d: F.when(F.col("w") > 0, F.floor(F.greatest(F.lit(0.0), F.col("target") * (F.col("seats") + d) / F.col("w")) + 0.5)).otherwise(F.lit(0)).cast("long")
    t = t.withColumn("low", at(-F.col("n") / 2)).withColumn("high", at(F.col("n") / 2 + 1))
    t = t.withColumn("open", F.col("seats") - F.sum("low").over(everything))
    bids = t.filter("high > low").select("source_key", "open", F.explode(F.sequence(F.col("low"), F.col("high") - 1)).alias("s"), "target")
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.col("target") / (2 * F.col("s") + 1)), "source_key", "s"))
    won = bids.withColumn("r", rank).filter("r <= open").groupBy("source_key").agg(F.count(F.lit(1)).alias("won"))
    t = t.join(won, "source_key", "left").withColumn("blocks", F.ceil(F.col("source_size") / block))
    quota = F.col("low") + F.coalesce("won", F.lit(0))
    return t.withColumn("quota", F.least(quota, (F.col("blocks") * F.lit(max_repeat)).cast("long"))).select(
        "source", "source_key", "source_size", "target", "blocks", "quota")


def shard_quotas(quotas: DataFrame, shards: int = 8) -> DataFrame:
    """Integer quota of every source in every shard; they sum to the source's quota.

    A shard is a run of a source's blocks in seeded order: ``first`` to ``first + n_blocks``.
    """
    p = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    q = quotas.select("source", "source_key", "quota", "blocks", p)
    edge = lambda s: F.floor(s * F.col("blocks") / shards)
    upto = lambda b: F.when(F.col("blocks") > 0, F.floor(b * F.col("quota") / F.col("blocks"))).otherwise(F.lit(0))
    first, last = edge(F.col("shard")), edge(F.col("shard") + 1)
    return q.select("source", "source_key", "shard", first.cast("long").alias("first"), (last - first).cast("long").alias("n_blocks"), upto(first).cast("long").alias("before"), (upto(last) - upto(first)).cast("long").alias("quota"))


def _sized(docs: DataFrame, seed: int, *more) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text")).alias("h"), *more)


def _placed(sized: DataFrame, weights, share, max_repeat, block, rows_per_bucket) -> DataFrame:
    """Rows with ``base + upto``, the place where they end in their source's seeded stream, and its quota; and the quotas."""
    rows = sized.count()
    buckets = max(64, rows // rows_per_bucket)
    sized = sized.withColumn("source_key", code_point_key("source")).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    sums = checkpointed(sized.groupBy("source", "source_key", "bucket").agg(F.sum("size").alias("bucket_size")))
    quotas = apportion(source_targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, share, max_repeat), block, max_repeat)
    # Pass one: offsets of buckets; pass two: offsets within a bucket.
    before = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.withColumn("base", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
    info = bases.select("source_key", "bucket", "base").join(quotas.drop("source"), "source_key")
    within = Window.partitionBy("source_key", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sized.withColumn("upto", F.sum("size").over(within)).join(info, ["source_key", "bucket"]), quotas


def _with_shards(placed: DataFrame, quotas: DataFrame, shards: int) -> DataFrame:
    """The quotas of a source's shards beside each of its rows: ``shards`` structs, in order of their blocks."""
    own = shard_quotas(quotas, shards)
    per = own.groupBy("source_key").agg(F.array_sort(F.collect_list(F.struct("shard", "first", "n_blocks", "before", "quota"))).alias("shards"))  # a row a source
    return placed.join(per, "source_key")


def mixed(docs: DataFrame, weights=(5.0, 2.0, 1.0), share=1.5, max_repeat=2.0, block=16, seed=7, rows_per_bucket=20000, shards: int = 1) -> DataFrame:
    """The rows of the mix itself: of each document the words that ``mix`` takes with the same parameters.

    A document comes whole as often as all its blocks are taken.  What is taken of it
    once more is a run of words in each shard that it lies in, a row each, with the white space before its
    words (and behind the last).  Every shard ends within a document, so one shard a source cuts least.
    A row without words takes nothing and stays once.
    """
    placed, quotas = _placed(_sized(docs, seed, F.struct(*docs.columns).alias("row")), weights, share, max_repeat, block, rows_per_bucket)
    end = F.col("base") + F.col("upto")
    placed = _with_shards(placed, quotas, shards).withColumn("start", end - F.col("size"))
    stop = lambda q: (q["first"] + q["n_blocks"]) * block

    def part(q):
        """A document's words in one shard: ``lo`` to ``hi`` are taken ``each`` times, ``lo`` to ``more`` once more."""
        lo, hi = F.greatest(F.col("start"), q["first"] * block), F.least(end, stop(q))
        each = F.floor(q["quota"] / q["n_blocks"])
        more = (q["first"] + q["quota"] - each * q["n_blocks"]) * block
        inside = lambda x: (x - F.col("start")).cast("long")
        return F.struct(inside(lo).alias("lo"), inside(hi).alias("hi"), each.cast("int").alias("each"), inside(F.greatest(lo, F.least(hi, more))).alias("more"))

    touched = F.filter("shards", lambda q: (q["n_blocks"] > 0) & (q["first"] * block < end) & (stop(q) > F.col("start")))
    placed = placed.withColumn("parts", F.transform(touched, part)).withColumn("whole", F.array_min(F.transform("parts", lambda q: q["each"])))
    span = lambda lo, hi: F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))
    again = F.flatten(F.transform("parts", lambda q: F.concat(F.array_repeat(span(q["lo"], q["hi"]), q["each"] - F.col("whole")), F.filter(F.array(span(q["lo"], q["more"])), lambda x: x["hi"] > x["lo"]))))
    all_words = span(F.lit(0), F.col("size"))
    copies = F.when(F.col("size") == 0, F.array(all_words)).otherwise(F.concat(F.array_repeat(all_words, F.col("whole")), again))
    each = placed.select("row", "size", F.explode(copies).alias("x"))
    words = F.split("row.text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    to_end = F.greatest(F.col("size") + 1, F.lit(1))  # what follows the last word is a piece of its own
    count = F.when(F.col("x.hi") == F.col("size"), to_end).otherwise(F.col("x.hi")) - F.col("x.lo")
    run = F.array_join(F.slice(words, (F.col("x.lo") + 1).cast("int"), count.cast("int")), "")
    cut = F.col("x.hi") - F.col("x.lo") < F.col("size")
    new = {"text": F.when(cut, run).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut, F.char_length(run)).otherwise(F.col("row.n_chars")).cast("long")
    return each.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def mix(docs: DataFrame, weights=(5.0, 2.0, 1.0), share=1.5, max_repeat=2.0, block=16, seed=7, rows_per_bucket=20000, shards: int = 8) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row.

    In each shard of a source every block is taken as often as its quota allows for all, and the first
    ones in seeded order once more, until the shard's integer quota is met.
    """
    placed, quotas = _placed(checkpointed(_sized(docs, seed)), weights, share, max_repeat, block, rows_per_bucket)
    placed = _with_shards(placed, quotas, shards)

    def upto(x):
        """Words taken from the first x words of the stream."""
        b = F.floor(x / block)

        def picks(i):
            s = F.get("shards", F.least(F.lit(shards - 1), F.size(F.filter("shards", lambda q: q["first"] <= i)) - 1))
            each = F.when(s["n_blocks"] > 0, F.floor(s["quota"] / s["n_blocks"])).otherwise(F.lit(0))
            within = i - s["first"]
            return (s["before"] + each * within + F.least(within, s["quota"] - each * s["n_blocks"])).cast("long")

        return picks(b) * block + (x - b * block) * (picks(b + 1) - picks(b))

    end = F.col("base") + F.col("upto")
    taken = F.when(F.col("size") > 0, upto(end) - upto(end - F.col("size"))).otherwise(F.lit(0)).cast("long")
    return placed.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), taken.alias("taken"))
