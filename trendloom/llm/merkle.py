"""Merkle manifest of a dataset: ternary trees a source, one tree over the sources, and a proof for every leaf.

Going up, runs of three nodes become their parent, six levels a Spark job: a chunk of 729 nodes
is built by one task, which stores a record ``digest, children`` for every inner node.  Going
down, requests descend from the root: at each record the rank's base-three digit picks the
child, the other children are collected, and the segments so gathered are reversed into the proof.  The requests of a
chunk share the path above it, so that a path travels once per 729 leaves, and
the join is by chunk: no chunk, hence no task, holds more than 729 leaves of a source, however large the source.

Ranks come from a range partition of the leaves with counts per (source, partition).

Defined cases: a null field is ``-``; a null source comes before all others; null doc_ids come first and are never tampered
with; rows of equal doc_id in a source stand in the order of their leaves; repeated rows are leaves each; a null text stays;
texts are hashed whole, whatever their length; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, runs

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
FAN, LEVELS = 3, 6
CHUNK = FAN**LEVELS
BUILT = "g string, chunk long, n long, digest string, children array<string>, top boolean"
ANSWERS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
STEPS = "g string, idx long, digest string, path string"


def digest_of(texts) -> str:
    return sha256("".join(texts).encode()).hexdigest()


def field(c) -> "F.Column":
    v = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))


def row_digest(**other) -> "F.Column":
    return F.sha2(F.concat(*[field(other.get(c, F.col(c))) for c in FIELDS]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """``g`` (order key of the source), ``doc_id, leaf, tampered``: of rows of even checksum, the text without line feeds."""
    changed = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)) == 0
    bare = row_digest(text=F.translate("text", "\n", ""))
    return docs.select(F.coalesce(F.concat(F.lit("1"), F.col("source")), F.lit("0")).alias("g"), F.col("doc_id").cast("long").alias("doc_id"), row_digest().alias("leaf"), F.when(changed, bare).otherwise(row_digest()).alias("tampered"))


def numbered(df: DataFrame, order: list[str], tables: Tables, name: str) -> DataFrame:
    """``idx`` from 0 in the order within each ``g``, and the number ``n`` of its rows: no window holds more than a range."""
    parts = tables.write(df.repartitionByRange("g", *order).withColumn("_part", F.spark_partition_id()), f"{name}-ranges")
    over = Window.partitionBy("g")
    counts = parts.groupBy("g", "_part").agg(F.count(F.lit(1)).alias("c"))
    before = F.coalesce(F.sum("c").over(over.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("g", "_part", before.alias("_before"), F.sum("c").over(over).alias("n"))
    own = F.row_number().over(Window.partitionBy("g", "_part").orderBy(*order))
    out = tables.write(parts.join(counts, ["g", "_part"]).withColumn("idx", F.col("_before") + own - 1).drop("_part", "_before"), name)
    tables.drop(f"{name}-ranges")
    return out


def depth(n: int) -> int:
    """Levels until one node is left."""
    d = 0
    while n > 1:
        n, d = -(-n // FAN), d + 1
    return d


def build(batches):
    """Inner nodes of each chunk, six levels at most; its last node is marked as the top."""

    def done(key, n, level):
        g, chunk = key
        out, levels = [], min(LEVELS, depth(n))
        for _ in range(levels):
            parents = []
            for i in range(0, len(level), FAN):
                parents.append(digest_of(level[i : i + FAN]))
                out.append((parents[-1], level[i : i + FAN]))
            level = parents
        if not levels:
            out = [(level[0], [])]
        k = len(out)
        return pa.RecordBatch.from_arrays([pa.array([g] * k), pa.array([chunk] * k, pa.int64()), pa.array([n] * k, pa.int64()), pa.array([r[0] for r in out]), pa.array([r[1] for r in out], pa.list_(pa.string())), pa.array([False] * (k - 1) + [True])], names=["g", "chunk", "n", "digest", "children", "top"])

    own, n, level = None, 0, []
    for key, part in runs(batches, "g", "chunk"):
        if own is not None and own != key:
            yield done(own, n, level)
            level = []
        own, n = key, part.column("n")[0].as_py()
        level += part.column("digest").to_pylist()
    if own is not None:
        yield done(own, n, level)


def up(nodes: DataFrame, tables: Tables, name: str) -> list[DataFrame]:
    """Stores of records, lowest levels first; every group ends as one top in the last one."""
    largest, stores = nodes.agg(F.max("n")).head()[0], []
    while True:
        chunked = nodes.select("g", F.floor(F.col("idx") / CHUNK).alias("chunk"), "idx", "n", "digest").repartition("g", "chunk").sortWithinPartitions("g", "chunk", "idx")
        stores.append(tables.write(chunked.mapInArrow(build, BUILT), f"{name}-{len(stores)}"))
        if largest <= CHUNK:
            return stores
        largest = -(-largest // CHUNK)
        nodes = stores[-1].filter("top").select("g", F.col("chunk").alias("idx"), F.ceil(F.col("n") / CHUNK).alias("n"), "digest")


def segment(store: dict, top: str, local: int, levels: int) -> tuple[list, str]:
    """Descend from a chunk's top by the digits of a rank: ``(digit, other children)`` per level, and the node reached."""
    out = []
    for level in reversed(range(levels)):
        digit = local // FAN**level % FAN
        children = store[top]
        out.append((digit, children[:digit] + children[digit + 1 :]))
        top = children[digit]
    return out, top


def written_path(levels: list) -> str:
    return ";".join(f"{digit}{''.join(others)}" for digit, others in levels)


def read_path(path: str) -> list:
    return [(int(x[0]), [x[i : i + 64] for i in range(1, len(x), 64)]) for x in path.split(";")] if path else []


def descend(requests: DataFrame, headers: DataFrame, store: DataFrame, root: str | None) -> DataFrame:
    """Requests ``g, idx, n, digest`` (with ``doc_id, tampered`` at the leaves) below headers ``g, chunk, digest, path, subroot``.

    Without ``root`` the answer is the node's own path, to go on from; with it, the proof of each leaf.
    """
    schema = ANSWERS if root else STEPS
    own = requests.columns
    text = lambda c: F.col(c) if c in own else F.lit(None).cast("string").alias(c)
    doc = F.col("doc_id") if "doc_id" in own else F.lit(None).cast("long").alias("doc_id")
    none, no_list = F.lit(None).cast("string"), F.lit(None).cast("array<string>").alias("children")
    asked = requests.select("g", F.floor(F.col("idx") / CHUNK).alias("chunk"), F.lit(2).alias("kind"), "idx", "n", "digest", none.alias("path"), none.alias("subroot"), no_list, doc, text("tampered"))
    zero, no_doc = F.lit(0).cast("long"), F.lit(None).cast("long").alias("doc_id")
    heads = headers.select("g", "chunk", F.lit(0).alias("kind"), zero.alias("idx"), zero.alias("n"), "digest", "path", "subroot", no_list, no_doc, none.alias("tampered"))
    records = store.select("g", "chunk", F.lit(1).alias("kind"), zero.alias("idx"), zero.alias("n"), "digest", none.alias("path"), none.alias("subroot"), "children", no_doc, none.alias("tampered"))

    def run(batches):
        held, top, above, subroot = {}, None, [], None
        for (g, _, kind), part in runs(batches, "g", "chunk", "kind"):
            if kind == 0:
                held, top, subroot = {}, part.column("digest")[0].as_py(), part.column("subroot")[0].as_py()
                path = part.column("path")[0].as_py()
                above = read_path(path)
                continue
            digests = part.column("digest").to_pylist()
            if kind == 1:
                held.update(zip(digests, part.column("children").to_pylist()))
                continue
            idx, n = part.column("idx").to_pylist(), part.column("n").to_pylist()
            found = [segment(held, top, i % CHUNK, min(LEVELS, depth(n[0]))) for i in idx]
            for (_, node), digest in zip(found, digests):
                if node != digest:
                    raise ValueError(f"the descent reached {node}, not {digest}")
            if root is None:
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(idx)), pa.array(idx, pa.int64()), pa.array(digests), pa.array([";".join(filter(None, (path, written_path(s)))) for s, _ in found])], names=["g", "idx", "digest", "path"])
                continue
            proofs, folded = [], []
            for (s, _), now in zip(found, part.column("tampered").to_pylist()):
                way = [*s[::-1], *above[::-1]]
                proofs.append(digest_of(x for _, others in way for x in others))
                for digit, others in way:
                    now = digest_of([*others[:digit], now, *others[digit:]])
                folded.append(now)
            k = len(idx)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(digests), pa.array([subroot] * k), pa.array([root] * k), pa.array(proofs), pa.array(folded), pa.array([f == root for f in folded])], names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return asked.union(heads).union(records).repartition("g", "chunk").sortWithinPartitions("g", "chunk", "kind", "idx").mapInArrow(run, schema)


def down(headers: DataFrame, stores: list[DataFrame], nodes: DataFrame, tables: Tables, name: str, root: str | None = None) -> DataFrame:
    """From the tops ``g, chunk 0, digest, path, subroot`` to the nodes, store by store."""
    subroots = headers.select("g", "subroot")
    for k in reversed(range(len(stores))):
        if not k:
            return descend(nodes, headers, stores[0], root)
        below = stores[k - 1].filter("top").select("g", F.col("chunk").alias("idx"), F.ceil(F.col("n") / CHUNK).alias("n"), "digest")
        steps = tables.write(descend(below, headers, stores[k], None), f"{name}-steps-{k}")
        headers = steps.join(subroots, "g").select("g", F.col("idx").alias("chunk"), "digest", "path", "subroot")
    raise ValueError("no store")


def manifest(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row."""
    spark, tables = docs.sparkSession, Tables(docs.sparkSession)
    # A number of the written row tells repeated rows apart, so that they spread over ranges as well.
    own = tables.write(leaves(docs).withColumn("_u", F.monotonically_increasing_id()), "leaves")
    nodes = numbered(own, ["doc_id", "leaf", "_u"], tables, "nodes").withColumnRenamed("leaf", "digest").drop("_u")
    tables.drop("leaves")
    if nodes.isEmpty():
        return spark.createDataFrame([], ANSWERS)
    stores = up(nodes, tables, "source")
    subroots = stores[-1].filter("top").select(F.col("g").alias("source"), "digest")
    sources = numbered(subroots.withColumn("g", F.lit("")), ["source"], tables, "sources")
    over = up(sources, tables, "over")
    root = over[-1].filter("top").select("digest").head()[0]
    paths = down(spark.createDataFrame([("", 0, root, "", root)], "g string, chunk long, digest string, path string, subroot string"), over, sources, tables, "over")
    heads = paths.select("idx", "path").join(sources.select("idx", "source", "digest"), "idx").select(F.col("source").alias("g"), F.lit(0).cast("long").alias("chunk"), "digest", "path", F.col("digest").alias("subroot"))
    return down(tables.write(heads, "heads"), stores, nodes, tables, "source", root)
