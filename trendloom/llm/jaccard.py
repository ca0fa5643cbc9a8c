"""N-gram Jaccard join by token-combination prefixes.

A document's set is its distinct 5-word shingles (tokens, 64-bit hashes).  Sets
that are equal form one class.  All tokens of the corpus are counted in a sketch of fixed
size; a token is frequent if its cell holds clearly more than a cell's share.
An over-count only makes a rare token frequent, which costs keys but no link.

Order of tokens: rare before frequent, each by hash.  With at least ``must = ceil(0.8 n)``
tokens shared, two similar sets share a token in their first
``n - must + 1`` tokens.  Classes with that many rare tokens are indexed by
these alone.  The others are also indexed by combinations: pairs of frequent
tokens that follow each other in the set's order.  A missing token spoils two pairs, an
added one spoils one, so the least ``2 (n - must) + 2`` pairs by hash are a prefix that
similar sets share a key in: extended, but linear in the set.

Classes that share a key are first folded around a head drawn for each key; keys whose
classes then all lie in one component are done, so a group of thousands of copies costs
stars, not its pairs.  What is left is paired key by key (rare tokens of few classes) or compared in
blocks (combinations, and tokens that seem rare in a large corpus but that many classes still hold).  Parity maps rule pairs out before whole sets are compared.

Defined cases: null, empty or blank text has the empty set, ``n_shingles`` 0 and
is its own component; fewer than five words are one shingle; repeated rows fall
in one class; rows with a null doc_id take part and get the component's
smallest non-null id (null if there is none); an empty table gives no rows; extra columns are ignored; very long
texts are hashed by stretches, whole.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shingles
from .common import Tables, batches_of
from .components import components

MAP_BITS = 2048  # of the smallest parity map
CELLS = 1 << 23
BLOCKS = 256


def parity_map(s: np.ndarray) -> np.ndarray:
    """Bits that tell how many tokens fall in each cell, odd or even: two maps differ in at most as many bits as the sets in tokens.

    A map has two to four cells a token, ``MAP_BITS`` at least; its halves joined by exclusive or are the map of half the size.
    """
    bits = max(MAP_BITS, 1 << (2 * len(s) - 1).bit_length())
    odd = np.bincount(s & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _halved(m, size):
    """SQL: a map folded to ``size`` words; sets of similar size need at most two folds."""
    fold = lambda x: F.zip_with(F.slice(x, 1, (F.size(x) / 2).cast("int")), F.slice(x, (F.size(x) / 2).cast("int") + 1, (F.size(x) / 2).cast("int")), lambda p, q: p.bitwiseXOR(q))
    once = F.when(F.size(m) > size, fold(m)).otherwise(m)
    return F.when(F.size(once) > size, fold(once)).otherwise(once)


def cell_of(s: np.ndarray) -> np.ndarray:
    return (s >> 20) & (CELLS - 1)


def class_id(s: np.ndarray) -> int:
    x = s.view(np.uint64)
    parts = np.array([len(x), *([np.bitwise_xor.reduce(shingles.mix(x)), x.sum(dtype=np.uint64)] if len(x) else [])], np.uint64)
    return int(np.bitwise_xor.reduce(shingles.mix(parts * shingles.MULTIPLIERS[:len(parts)])).view(np.int64))


def combinations(frequent: np.ndarray, count: int) -> np.ndarray:
    """The least ``count`` keys of neighbouring pairs."""
    x = frequent.view(np.uint64)
    return np.sort(shingles.mix(x[:-1] * shingles.MULTIPLIERS[1] + x[1:] * shingles.MULTIPLIERS[2]).view(np.int64))[:count]


def keys_of(s: np.ndarray, heavy: np.ndarray | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(single tokens, combination keys) that index a set."""
    n = len(s)
    spare = n - -(-n * percent // 100)
    if heavy is None:
        return s[:spare + 1], s[:0]
    cells = cell_of(s)
    frequent = (heavy[cells >> 3] >> (cells & 7).astype(np.uint8) & 1).astype(bool)
    rare = s[~frequent]
    if len(rare) > spare:
        return rare[:spare + 1], s[:0]
    return rare, combinations(s[frequent], 2 * spare + 2)


def frequent_cells(docs: DataFrame, width: int, least: int) -> np.ndarray | None:
    """Bitmap of the cells (1 MB) that hold clearly more tokens than their share; counts cover every text."""

    def count(batches):
        hasher, cells, total = shingles.Hasher(), np.zeros(CELLS, np.uint32), 0
        for batch in batches:
            for s in shingles.sets(batch.column("text"), width, hasher):
                _count(cells, s)
                total += len(s)
        part = np.minimum(cells, 65535, out=cells).reshape(BLOCKS, -1)
        full = [b for b in range(BLOCKS) if part[b].any()]
        if full:
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([zlib.compress(part[b].astype(np.uint16).tobytes(), 1) for b in full], pa.binary()), pa.array([total] + [0] * (len(full) - 1), pa.int64())], names=["block", "counts", "total"])

    def add(batches):
        sums, total = {}, 0
        for batch in batches:
            for b, packed, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
                x = np.frombuffer(zlib.decompress(packed), np.uint16)
                sums[b] = sums[b] + x if b in sums else x.astype(np.int64)
                total += t
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.astype("<i8").tobytes() for x in sums.values()], pa.binary()), pa.array([total] + [0] * (len(sums) - 1), pa.int64())], names=["block", "counts", "total"])

    schema = "block int, counts binary, total long"
    tables = Tables(docs.sparkSession)
    parts = docs.select("text").mapInArrow(count, schema)
    sums = tables.write(parts.repartition(BLOCKS // 8, "block").mapInArrow(add, schema), "cells")
    total = sums.agg(F.sum("total")).head()[0]
    if not total:
        return None
    share = total / CELLS
    limit = least + share + 6 * share ** 0.5

    def mark(batches):
        for batch in batches:
            bits = [np.packbits(np.frombuffer(x, "<i8") > limit, bitorder="little").tobytes() for x in batch.column("counts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(bits, pa.binary())], names=["block", "bits"])

    heavy = np.zeros((BLOCKS, CELLS // BLOCKS // 8), np.uint8)
    for b, bits in sums.mapInArrow(mark, "block int, bits binary").collect():
        heavy[b] = np.frombuffer(bits, np.uint8)
    tables.drop("cells")
    return heavy.ravel()


def _count(cells: np.ndarray, s: np.ndarray) -> None:
    c = cell_of(s)
    c.sort()
    edge = np.flatnonzero(np.r_[True, c[1:] != c[:-1]]) if len(c) else c
    cells[c[edge]] += np.diff(np.r_[edge, len(c)]).astype(np.uint32)


def _lists(arrays) -> pa.ListArray:
    offsets = np.r_[0, np.cumsum([len(a) for a in arrays])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays)))


def _rows(batches, width: int, more, names):
    """Batches of ``doc_id, gid, n`` and the lists that ``more`` makes of a set."""
    hasher = shingles.Hasher()
    for batch in batches:
        docs, at, gids, ns, lists, held = batch.column("doc_id"), 0, [], [], [], 0

        def out(docs, at, gids, ns, lists):
            return pa.RecordBatch.from_arrays([docs.slice(at, len(gids)), pa.array(gids, pa.int64()), pa.array(ns, pa.int64()), *(_lists(x) for x in zip(*lists))], names=names)

        for s in shingles.sets(batch.column("text"), width, hasher):
            gids.append(class_id(s))
            ns.append(len(s))
            lists.append(more(s))
            held += sum(map(len, lists[-1]))
            if held > 1 << 19 or len(gids) >= 4000:
                yield out(docs, at, gids, ns, lists)
                at, gids, ns, lists, held = at + len(gids), [], [], [], 0
        if gids:
            yield out(docs, at, gids, ns, lists)


def _indexed(docs: DataFrame, width: int, percent: int, heavy) -> DataFrame:
    names = ["doc_id", "gid", "n", "rare", "combos", "map"]

    def run(batches):
        own = heavy.value if heavy is not None else None
        yield from _rows(batches, width, lambda s: (*keys_of(s, own, percent), parity_map(s)), names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, gid long, n long, rare array<long>, combos array<long>, map array<long>")


def _whole(docs: DataFrame, width: int) -> DataFrame:
    names = ["doc_id", "gid", "n", "tokens"]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda b: _rows(b, width, lambda s: (s,), names), "doc_id long, gid long, n long, tokens array<long>")


def _small(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """Broadcast tables of a few numbers a row, if counted to be small."""
    return F.broadcast(df) if df.count() <= rows else df


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, percent: int, tables: Tables, best: int | None = None) -> DataFrame:
    """Pairs ``a, b`` of classes that are similar enough: parity maps first, then whole sets.

    ``best`` (folding only): no more than so many partners of each ``a``, those of nearest maps.
    """
    side = lambda x: classes.select(F.col("gid").alias(x), F.col("n").alias(f"n{x}"), F.col("map").alias(f"m{x}"))
    size = F.least(F.size("ma"), F.size("mb"))
    differ = F.aggregate(F.zip_with(_halved(F.col("ma"), size), _halved(F.col("mb"), size), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    both = pairs.join(side("a"), "a").filter(F.col("na") > 0).join(side("b"), "b")
    both = both.select("a", "b", "na", "nb", differ.alias("differ")).filter(F.col("differ") * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent))
    if best:
        both = both.withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy("differ", "b"))).filter(F.col("place") <= best)
    pairs = tables.write(both.select("a", "b"), "possible")
    wanted = pairs.select(F.col("a").alias("gid")).union(pairs.select("b")).distinct()
    ids = tables.write(classes.join(wanted, "gid", "left_semi").select("gid", "doc_id", "empty_id"), "ids")
    plain = _whole(docs.join(_small(ids.filter("not empty_id").select("doc_id").distinct()), "doc_id", "left_semi"), width)
    if not ids.filter("empty_id").isEmpty():  # classes that only rows without doc_id hold
        plain = plain.union(_whole(docs.filter("doc_id is null"), width))
    sets = tables.write(plain.select("gid", "n", "tokens").dropDuplicates(["gid"]), "sets")
    left = sets.select(F.col("gid").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta")).join(_small(pairs), "a")
    right = sets.select(F.col("gid").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb")).join(_small(pairs.select("b").distinct()), "b", "left_semi")
    n = F.size(F.array_intersect("ta", "tb"))
    found = left.join(right, "b").filter(n * 100 >= (F.col("na") + F.col("nb") - n) * percent)
    found = tables.write(found.select("a", "b"), "links")
    tables.drop("possible", "ids", "sets")
    return found


def _block_pairs(open_posts: DataFrame, classes: DataFrame, percent: int, block: int, tables: Tables) -> DataFrame:
    """Pairs ``a, b`` of other components that share a combination, kept only if sizes and parity maps allow.

    Keys that the same classes hold form a region; where that costs fewer comparisons, a region is compared
    once instead of key by key.  A group falls by hash into blocks of about ``block`` classes, and
    each pair of blocks is one array comparison, so that no group meets whole in one task and no pair is a row.
    """
    heads = open_posts.groupBy("key").agg(F.min("gid").alias("b"), F.count(F.lit(1)).alias("m"))
    edges = open_posts.join(heads, "key").filter("gid <> b").select(F.col("gid").alias("a"), "b").distinct()
    region = tables.write(components(edges), "region")
    named = open_posts.join(region, F.col("gid") == F.col("node")).select("key", "gid", "n", open_posts["comp"], region["comp"].alias("region"))
    named = tables.write(named, "named")
    by_key = named.groupBy("region", "key").agg(F.count(F.lit(1)).alias("m")).groupBy("region").agg(F.sum(F.col("m") * F.col("m")).alias("by_key"))
    once = named.select("region", "gid", "n", "comp").distinct()
    whole = once.groupBy("region").agg(F.count(F.lit(1)).alias("m")).join(by_key, "region").filter(F.col("m") * F.col("m") <= F.col("by_key")).select("region", "m")
    sizes = named.join(whole, "region", "left_anti").groupBy("key").agg(F.count(F.lit(1)).alias("m"))
    groups = once.join(whole, "region").select(F.col("region").alias("group"), "m", "gid", "n", "comp").union(
        named.join(sizes, "key").select(F.xxhash64("key").alias("group"), "m", "gid", "n", "comp"))
    blocks = F.ceil(F.col("m") / block).cast("int")
    own = F.pmod(F.xxhash64("gid"), F.ceil(F.col("m") / block)).cast("int")
    cells = groups.select("group", "gid", "n", "comp", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    cells = cells.withColumn("cell", F.struct(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")))
    cells = cells.join(classes.select("gid", "map"), "gid").select("group", "cell.i", "cell.j", "gid", "n", "comp", "own", "map")
    cells = cells.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j")

    def compare(batches):
        held, last = [], None
        for batch in batches:
            where = np.stack([batch.column(c).to_numpy() for c in ("group", "i", "j")])
            edges = np.r_[0, np.flatnonzero((where[:, 1:] != where[:, :-1]).any(0)) + 1, batch.num_rows].tolist()
            for a, z in zip(edges, edges[1:]):
                here = tuple(where[:, a].tolist()) if z > a else last
                if here != last and held:
                    yield from _near(held, last[1], percent)
                    held = []
                last = here
                held.append(batch.slice(a, z - a))
        if held:
            yield from _near(held, last[1], percent)

    return cells.mapInArrow(compare, "a long, b long").distinct()


def _near(held: list, i: int, percent: int):
    """Possible pairs of one pair of blocks."""
    t = pa.Table.from_batches(held).combine_chunks()
    gid, n, comp, own = (t.column(c).to_numpy() for c in ("gid", "n", "comp", "own"))
    lists = t.column("map").combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    least = int(lengths.min())  # sizes differ little among sets that share keys; all are folded to the smallest map
    words = lists.flatten().to_numpy().view(np.uint64)
    maps = np.stack([np.bitwise_xor.reduce(m.reshape(-1, least), axis=0) for m in np.split(words, np.cumsum(lengths)[:-1])])
    left, right = np.flatnonzero(own == i), np.flatnonzero(own != i)
    alone = not len(right)
    right = left if alone else right
    for at in left.tolist():
        may = right[(comp[right] != comp[at]) & (np.minimum(n[right], n[at]) * 100 >= np.maximum(n[right], n[at]) * percent)]
        if alone:
            may = may[gid[may] > gid[at]]
        differ = np.bitwise_count(maps[may] ^ maps[at]).sum(1, dtype=np.int64)
        may = may[differ * (100 + percent) <= (n[may] + n[at]) * (100 - percent)]
        if len(may):
            a = np.full(len(may), gid[at])
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, gid[may])), pa.array(np.maximum(a, gid[may]))], names=["a", "b"])


def join_components(docs: DataFrame, percent: int = 80, width: int = 5, frequent: int = 64, rounds: int = 1, heads_each: int = 4, block: int = 1024, wide_key: int = 256) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row.

    ``frequent``: count above its share from which a cell is frequent.  ``rounds``, ``heads_each``: folding rounds, and
    heads that a class is compared with in each, before all remaining pairs are tested.  ``wide_key``: open classes of one
    token above which they are compared in blocks of ``block``, in place of row pairs.  Any numbers give the same result.
    """
    with batches_of(docs.sparkSession):  # every table is written before this returns
        return _joined(docs, percent, width, frequent, rounds, heads_each, block, wide_key)


def _joined(docs: DataFrame, percent: int, width: int, frequent: int, rounds: int, heads_each: int, block: int, wide_key: int) -> DataFrame:
    spark = docs.sparkSession
    tables = Tables(spark)
    docs = docs.select("doc_id", "text")
    cells = frequent_cells(docs, width, frequent) if percent >= 80 else None
    heavy = spark.sparkContext.broadcast(cells) if cells is not None else None
    raw = tables.write(_indexed(docs, width, percent, heavy), "raw")
    classes = raw.filter("n > 0").groupBy("gid").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("rare").alias("rare"), F.first("combos").alias("combos"), F.first("map").alias("map"))
    classes = tables.write(classes.withColumn("empty_id", F.col("doc_id").isNull()), "classes")
    # Rare tokens have few classes (up to a cell's share of all tokens), so that a list of one is small; combinations may have any number.
    rare = classes.select("gid", "n", F.explode("rare").alias("key"))
    rare = rare.groupBy("key").agg(F.collect_list(F.struct("n", "gid")).alias("own")).filter("size(own) > 1").select("key", F.explode("own").alias("x")).select("key", "x.gid", "x.n", F.lit(False).alias("combo"))
    combos = classes.select("gid", "n", F.explode("combos").alias("key"))
    shared = combos.groupBy("key").count().filter("count > 1").select("key")
    posts = tables.write(rare.union(combos.join(shared, "key").select("key", "gid", "n", F.lit(True))), "open")
    close = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent
    posts = posts.withColumn("comp", F.col("gid"))
    links = None
    for again in range(max(1, rounds)):
        rank = F.xxhash64(F.lit(again), "gid", "key")
        heads = posts.groupBy("key").agg(F.min(F.struct(rank.alias("rank"), F.col("gid").alias("b"), F.col("n").alias("hn"), F.col("comp").alias("hc"))).alias("h"))
        stars = posts.join(heads, "key").filter((F.col("comp") != F.col("h.hc")) & close(F.col("n"), F.col("h.hn"))).select(F.col("gid").alias("a"), "h.b")
        found = _verified(docs, classes, stars.distinct(), width, percent, tables, heads_each)
        links = found if links is None else links.union(found)
        comps = _small(tables.write(components(links), "comps"))
        named = posts.drop("comp").join(comps, F.col("gid") == F.col("node"), "left").select("key", "gid", "n", "combo", F.coalesce("comp", "gid").alias("comp"))
        mixed = named.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 <> c1").select("key")
        posts = tables.write(named.join(mixed, "key", "left_semi"), "open")
    # Tokens of many classes, which a full sketch takes for rare in a very large corpus, go in blocks as well.
    wide = posts.filter("not combo").groupBy("key").count().filter(F.col("count") > wide_key).select("key", F.lit(True).alias("wide"))
    posts = tables.write(posts.join(wide, "key", "left").withColumn("combo", F.col("combo") | F.coalesce("wide", F.lit(False))).drop("wide"), "open")
    x, y = (posts.filter("not combo").alias(c) for c in "xy")
    rest = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.gid") < F.col("y.gid")) & (F.col("x.comp") != F.col("y.comp")) & close(F.col("x.n"), F.col("y.n")))
    rest = rest.select(F.col("x.gid").alias("a"), F.col("y.gid").alias("b")).distinct()
    rest = rest.union(_block_pairs(posts.filter("combo").drop("combo"), classes, percent, block, tables)).distinct()
    links = links.union(_verified(docs, classes, rest, width, percent, tables))
    tables.drop("open", "region", "named")
    whole = components(links)
    named = classes.select("gid", "doc_id").join(whole, F.col("gid") == F.col("node"), "left").select("gid", "doc_id", F.coalesce("comp", "gid").alias("comp"))
    smallest = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    by_class = tables.write(named.join(smallest, "comp").select("gid", "component_id"), "by_class")
    tables.drop("classes", "links", "comps")
    members = raw.select("doc_id", "gid", F.col("n").alias("n_shingles"))
    filled = members.filter("n_shingles > 0").join(by_class, "gid", "left").select("doc_id", "n_shingles", "component_id")
    return filled.union(members.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
