"""Document fingerprints by closed syncmers (native SQL).

Tokens are words; characters of scripts without spaces, and those of unbroken runs of more than 32 letters,
are tokens each.  A k-mer of k consecutive tokens is an anchor when the least of its inner s-mer
hashes stands first or last in it: a choice that needs no context, so an edit
moves only anchors that it touches.  The fingerprint holds all anchors of the
whole text in order, ``hash@position``.  Two anchors match if they and the
anchors before them have equal hashes at equal distances, wherever the passage
has moved; likeness is the Jaccard similarity of these matches.

Defined cases: null text is empty; in a text of fewer than k tokens every token
is an anchor; where no k-mer is selected the one of least hash is; with no tokens the fingerprint is empty, like only
another empty one; very long texts are taken whole; rows of one doc_id, and null doc_ids, which come last, stand in the
order of their texts' hashes; repeated rows keep a row each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


# Code points of scripts that put no space between words: Thai to Tibetan, Myanmar, Khmer, kana, Han.
SPACELESS = r"\u0E00-\u0FFF\u1000-\u109F\u1780-\u17FF\u3041-\u30FF\u3400-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}"
LETTER = rf"[\p{{L}}\p{{N}}&&[^{SPACELESS}]]"
TOKEN = rf"[{SPACELESS}&&[\p{{L}}\p{{N}}]]|(?<!{LETTER}){LETTER}{{1,32}}+(?!{LETTER})|{LETTER}"
SPECIAL = rf"[{SPACELESS}]|[\p{{L}}\p{{N}}]{{33}}"  # only such texts need more than words


def tokens(text) -> "F.Column":
    words = F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda x: x != "")
    return F.when(F.col(text).rlike(SPECIAL), F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))).otherwise(words)


def anchors(df: DataFrame, text: str, out: str, k: int = 5, s: int = 2) -> DataFrame:
    """Add ``out``: all anchors (position in tokens, hash) of the column ``text``, in order."""
    if not 2 <= k - s <= 2 * s:
        raise ValueError("k - s must lie between 2 and 2 s")
    span, w, m, f = k - s, f"_{out}_w", f"_{out}_s", f"_{out}_f"
    df = df.withColumn(w, F.transform(tokens(text), lambda x: F.xxhash64(x)))
    n = F.size(w)
    df = df.withColumn(m, F.when(n >= k, F.transform(F.sequence(F.lit(0), n - s), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(s)]))))
    at = lambda i, j: F.get(m, i + j)
    inner = lambda i: F.least(*[at(i, j) for j in range(1, span)]) if span > 2 else at(i, 1)
    kmer = lambda i: F.hash(at(i, 0), at(i, span), *([at(i, s)] if s < span else []))
    anchor = lambda i: F.struct(i.alias("at"), kmer(i).alias("h"))
    places = F.sequence(F.lit(0), F.size(m) - span - 1)
    df = df.withColumn(f, F.filter(F.transform(places, lambda i: F.when(F.least(at(i, 0), at(i, span)) <= inner(i), anchor(i))), lambda x: x.isNotNull()))
    least = F.array_min(F.transform(places, lambda i: F.struct(kmer(i).alias("h"), i.alias("at"))))
    single = F.transform(w, lambda x, i: F.struct(i.alias("at"), F.hash(x).alias("h")))
    found = F.when(n < k, single).when(F.size(f) > 0, F.col(f)).otherwise(F.array(F.struct(least["at"].alias("at"), least["h"].alias("h"))))
    return df.withColumn(out, F.coalesce(found, F.array().cast("array<struct<at:int,h:int>>"))).drop(w, m, f)


def matches(a: str) -> "F.Column":
    """Distinct keys by which anchors match: hash, hash of the anchor before, and the distance to it (first: to the start)."""
    before = lambda i: F.get(a, i - 1)
    return F.array_distinct(F.transform(a, lambda x, i: F.xxhash64(x["h"], F.coalesce(before(i)["h"], F.lit(0)), x["at"] - F.coalesce(before(i)["at"], F.lit(-1)))))


def likeness(a: str, b: str) -> "F.Column":
    """Jaccard similarity of two columns of ``matches``."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union).cast("double")


def as_text(a: str) -> "F.Column":
    return F.array_join(F.transform(a, lambda x: F.concat(F.lpad(F.lower(F.hex(x["h"])), 8, "0"), F.lit("@"), x["at"].cast("string"))), ",")


def _bucket(cuts: list[int]) -> "F.Column":
    """Number of cuts below doc_id, by halving an array of cuts; -1 for null."""
    steps = F.sequence(F.lit(1), F.lit(max(1, len(cuts).bit_length())))
    array = F.lit(cuts) if cuts else F.array().cast("array<bigint>")

    def halve(acc, _):
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        above = (acc["lo"] < acc["hi"]) & (F.get(array, mid) < F.col("doc_id"))
        return F.struct(F.when(above, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(above, acc["hi"]).otherwise(F.least(acc["hi"], mid)).alias("hi"))

    found = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi")), halve, lambda acc: acc["lo"])
    return F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(found)


def with_next(docs: DataFrame, rows_each: int = 500) -> DataFrame:
    """Add ``next_text``, the text of the next row by descending doc_id; the last meets the first.

    Rows fall into doc_id ranges of about ``rows_each``; the first row of a range is copied to the end
    of the range above it, so one window a range finds every neighbour.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    buckets = max(1, -(-docs.count() // rows_each))
    cuts = docs.select(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], max(10000, 10 * buckets))).head()[0] if buckets > 1 else []
    cuts = sorted(set(cuts or []))
    ranged = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), _bucket(cuts).alias("bucket"))
    tops = sorted(tuple(r) for r in docs.select("doc_id", _bucket(cuts).alias("bucket")).groupBy("bucket").agg(F.max("doc_id")).collect())
    if not tops:
        return docs.select("doc_id", "text").withColumn("next_text", F.col("text"))
    above = {b: tops[(i + 1) % len(tops)][0] for i, (b, _) in enumerate(tops)}
    # One row a range: doc_id of its first row, and the range above.
    heads = docs.sparkSession.createDataFrame([(b, t, above[b]) for b, t in tops], "bucket int, top long, above int")
    lead = ranged.join(F.broadcast(heads), "bucket").filter(F.col("doc_id").eqNullSafe(F.col("top")))
    heads_of = Window.partitionBy("bucket").orderBy(F.xxhash64("text"), "text")
    copies = lead.withColumn("r", F.row_number().over(heads_of)).filter("r = 1").select("doc_id", "text", F.col("above").alias("bucket"), F.lit(1).alias("copy"))
    both = ranged.withColumn("copy", F.lit(0)).unionByName(copies)
    order = Window.partitionBy("bucket").orderBy("copy", F.desc_nulls_last("doc_id"), F.xxhash64("text"), "text")
    return both.withColumn("next_text", F.lead("text").over(order)).filter("copy = 0")


def fingerprint_edits(docs: DataFrame, k: int = 5, s: int = 2) -> DataFrame:
    """Fingerprints of texts and of texts whose last third comes from the next document."""
    df = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    df = df.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring("next_text", F.lit(1), cut)))
    df = df.withColumn("edited_sha256", F.sha2("edited", 256))
    df = anchors(df, "text", "fp", k, s)
    df = anchors(df, "edited", "efp", k, s)
    df = anchors(df, "next_text", "nfp", k, s)
    for x in ("fp", "efp", "nfp"):
        df = df.withColumn(f"{x}_k", matches(x))
    return df.select("doc_id", "n_chars", "edited_sha256", as_text("fp").alias("fingerprint"), as_text("efp").alias("edited_fingerprint"),
                     likeness("fp_k", "efp_k").alias("near_edited"), likeness("fp_k", "nfp_k").alias("near_next"))
