"""One dimension: what all pairs say, from running sums along the order, so that work grows with the rows.

Rows are range-partitioned by the value and written; every partition's totals (one row each) give
its running start, and tasks go on from there.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .ranks import _dealt, _held


def edge(v: np.ndarray, d: float) -> np.ndarray:
    """The least double t above v with t - v >= d as doubles are subtracted: found by halving the list of all doubles."""

    def turn(x):  # bits of doubles to whole numbers of the same order, and back
        return np.where(x < 0, np.iinfo(np.int64).min - x, x)

    low = turn(v.view(np.int64))
    high = turn(np.nextafter(np.maximum(v + 2 * d, v), np.inf).view(np.int64))
    while (low < high - 1).any():
        mid = (low >> 1) + (high >> 1) + (low & high & 1)
        enough = turn(mid).view(np.float64) - v >= d
        high, low = np.where(enough, mid, high), np.where(enough, low, np.minimum(mid, high - 1))
    return turn(high).view(np.float64)


def density(df: DataFrame, ids: str, vec: str, d_c: float) -> DataFrame:
    """``id, vec, rho``: other rows strictly nearer than the cutoff, as rows below the upper edge less rows up to the lower one.

    Equal values are one place, which asks twice: three rows a place are sorted, whatever number of rows lies near.
    """

    @F.pandas_udf(DoubleType())
    def above(v: pd.Series) -> pd.Series:
        return pd.Series(edge(v.to_numpy(np.float64) + 0.0, d_c))

    x = F.get(vec, F.lit(0)).cast("double") + F.lit(0.0)
    rows = df.select(ids, vec, x.alias("_x"))
    fine = F.abs("_x") < float("inf")
    if not d_c > 0:
        return rows.select(ids, vec, F.lit(0).cast("long").alias("rho"))
    places = rows.filter(fine).groupBy("_x").agg(F.count(F.lit(1)).alias("n"))
    asked = places.select("_x", "n", above("_x").alias("hi"), (-above(-F.col("_x"))).alias("lo"))
    row = lambda at, kind, n: F.struct(F.col(at).alias("at"), F.lit(kind).alias("kind"), n.cast("long").alias("n"))
    events = asked.select("_x", F.explode(F.array(row("hi", 0, F.lit(0)), row("_x", 1, F.col("n")), row("lo", 2, F.lit(0)))).alias("e")).select("_x", "e.*")
    parts = _dealt(events, [F.col("at"), F.col("kind"), F.col("_x")])
    total, start = 0, {}
    for p, n in sorted(tuple(r) for r in parts.groupBy("_part").agg(F.sum("n")).collect()):  # a row a partition
        start[p], total = total, total + n
    base = F.create_map(*[F.lit(y) for kv in start.items() for y in kv]) if start else F.lit(None).cast("map<int,bigint>")
    upto = F.sum("n").over(Window.partitionBy("_part").orderBy("at", "kind", "_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.try_element_at(base, F.col("_part"))
    counted = parts.withColumn("c", upto).filter("kind <> 1").groupBy("_x").agg((F.sum(F.when(F.col("kind") == 0, F.col("c")).otherwise(-F.col("c"))) - 1).alias("rho"))
    return rows.join(counted, "_x", "left").select(ids, vec, F.coalesce("rho", F.lit(0)).alias("rho"))


def _running(df: DataFrame, ids: str, vec: str, codes: str, widths: list[int]):
    """Rows in order, and a function of batches to ``(ids, x, codes, s, before)``: ``s`` sums of distances to every cluster of every labelling,
    ``before`` the row before the batch."""
    starts = np.r_[0, np.cumsum(widths)].astype(int)
    wide = int(starts[-1])
    rows = df.select(F.col(ids).alias("id"), F.get(vec, F.lit(0)).cast("double").alias("x"), F.col(codes).cast("array<int>").alias("codes"))
    middle = rows.agg(F.avg("x")).head()[0] or 0.0
    parts = _dealt(rows.withColumn("x", F.col("x") - middle), [F.col("x"), F.col("id")])

    def each(batch):
        x = batch.column("x").to_numpy()
        c = batch.column("codes").flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
        hot = np.zeros((len(x), wide))
        for i in range(len(widths)):
            hot[np.arange(len(x)), starts[i] + c[:, i]] = 1.0
        return x, c, hot

    def totals(batches):
        for batch in batches:
            p = batch.column("_part").to_numpy()
            for own in np.unique(p).tolist():
                b = batch.filter(pa.array(p == own))
                x, c, hot = each(b)
                last = int(x.argmax())
                yield pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([np.r_[hot.sum(0), x @ hot].tolist()], pa.list_(pa.float64())), pa.array([x[last]]), pa.array([c[last].tolist()], pa.list_(pa.int32()))], names=["p", "t", "x", "c"])

    found = parts.mapInArrow(totals, "p int, t array<double>, x double, c array<int>").groupBy("p").agg(F.array(*[F.sum(F.get("t", F.lit(i))) for i in range(2 * wide)]).alias("t"), F.max(F.struct("x", "c")).alias("last")).collect()
    run, before, opening = np.zeros(2 * wide), None, {}
    for r in sorted(found):  # a row a partition
        opening[r["p"]] = (run, before)
        run, before = run + np.array(r["t"]), (r["last"]["x"], list(r["last"]["c"]))
    whole = run

    def walk(batches):
        own, at, last = None, None, None
        for batch in batches:
            p = batch.column("_part").to_numpy()
            edges = [0, *(np.flatnonzero(p[1:] != p[:-1]) + 1).tolist(), len(p)] if len(p) else []
            for a, z in zip(edges, edges[1:]):
                if p[a] != own:
                    own = int(p[a])
                    at, last = opening[own]
                b = batch.slice(a, z - a)
                x, c, hot = each(b)
                n, s = at[:wide] + hot.cumsum(0), at[wide:] + (x[:, None] * hot).cumsum(0)
                yield b.column("id"), x, c, x[:, None] * (2 * n - whole[:wide]) - 2 * s + whole[wide:], last
                at, last = np.r_[n[-1], s[-1]], (float(x[-1]), c[-1].tolist())

    return parts.repartition("_part").sortWithinPartitions("_part", "x", "id"), walk


def cluster_sums(df: DataFrame, ids: str, vec: str, codes: str, widths: list[int]) -> DataFrame:
    """``id, s`` as of :func:`blocks.cluster_sums`."""
    rows, walk = _running(df, ids, vec, codes, widths)

    def run(batches):
        for i, _, _, s, _ in walk(batches):
            yield pa.RecordBatch.from_arrays([i, pa.ListArray.from_arrays(np.arange(0, s.size + 1, s.shape[1], dtype=np.int32), pa.array(np.maximum(s, 0.0).ravel()))], names=["id", "s"])

    return rows.mapInArrow(run, f"id {df.schema[ids].dataType.simpleString()}, s array<double>").withColumnRenamed("id", ids)


def label_statistics(df: DataFrame, ids: str, vec: str, codes: str, gaps: list[np.ndarray]) -> tuple[dict, list[dict]]:
    """As of :func:`blocks.label_statistics`: in order, the least distance between clusters is one of neighbours, the greatest within one of ends."""
    widths = [len(g) for g in gaps]
    starts = np.r_[0, np.cumsum(widths)].astype(int)
    rows, walk = _running(df, ids, vec, codes, widths)

    def run(batches):
        total, square, count = 0.0, 0.0, 0
        sw, product, low = np.zeros(len(gaps)), np.zeros(len(gaps)), np.full(len(gaps), np.inf)
        n, least, most = np.zeros(starts[-1]), np.full(starts[-1], np.inf), np.full(starts[-1], -np.inf)
        for _, x, c, s, before in walk(batches):
            count, total, square = count + len(x), total + float(s[:, : starts[1]].sum()) / 2, square + float(x @ x)
            step = np.diff(x, prepend=x[0] if before is None else before[0])
            past = np.vstack([c[0] if before is None else before[1], c[:-1]])
            for i, gap in enumerate(gaps):
                own = s[:, starts[i] : starts[i + 1]]
                sw[i] += own[np.arange(len(x)), c[:, i]].sum() / 2
                product[i] += (own * gap[c[:, i]]).sum() / 2
                low[i] = min(low[i], step[past[:, i] != c[:, i]].min(initial=np.inf))
                n[starts[i] : starts[i + 1]] += np.bincount(c[:, i], minlength=widths[i])
                np.minimum.at(least, starts[i] + c[:, i], x)
                np.maximum.at(most, starts[i] + c[:, i], x)
        if count:
            yield pa.RecordBatch.from_arrays([pa.array([[count, total, square]]), *[pa.array([a.tolist()]) for a in (sw, product, low, n, least, most)]], names=["w", "sw", "product", "low", "n", "least", "most"])

    lists = {"w": 3, "sw": len(gaps), "product": len(gaps), "low": len(gaps), "n": int(starts[-1]), "least": int(starts[-1]), "most": int(starts[-1])}
    how = {"low": F.min, "least": F.min, "most": F.max}
    got = rows.mapInArrow(run, ", ".join(f"{c} array<double>" for c in lists)).agg(*[F.array(*[how.get(c, F.sum)(F.get(c, F.lit(i))) for i in range(k)]).alias(c) for c, k in lists.items()]).head()
    count, s, square = got["w"]
    pairs = int(count) * (int(count) - 1) // 2
    q = count * square  # values lie about their mean
    whole = {"n": pairs, "s": s, "sd": max(0.0, q / pairs - (s / pairs) ** 2) ** 0.5 if pairs else float("nan")}
    out = []
    for i in range(len(gaps)):
        own = [j for j in range(starts[i], starts[i + 1]) if got["n"][j]]
        out.append({"nw": sum(int(got["n"][j]) * (int(got["n"][j]) - 1) // 2 for j in own), "sw": got["sw"][i], "max_within": max((got["most"][j] - got["least"][j] for j in own if got["n"][j] > 1), default=-float("inf")),
                    "min_between": got["low"][i], "hubert": got["product"][i] / pairs if pairs else float("nan")})
    return whole, out


class Places:
    """Different values of one dimension with their numbers of rows, in order, cut into blocks of about ``rows`` places; the driver holds one row a block.

    Blocks of which all pairs lie within a distance, or none, are counted by their totals.  A pair of blocks that
    the distance cuts goes to a task, and as blocks do not overlap there are at most two of them a block.
    """

    def __init__(self, df: DataFrame, vec: str, rows: int = 16_384):
        x = F.get(vec, F.lit(0)).cast("double") + F.lit(0.0)
        places = df.groupBy(x.alias("x")).agg(F.count(F.lit(1)).alias("n"))
        blocks = max(1, -(-places.count() // rows))

        def pack(batches):
            held = [(b.column("x").to_numpy(), b.column("n").to_numpy()) for b in batches if b.num_rows]
            if held:
                x, n = (np.concatenate(z) for z in zip(*held))
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (x[0], x[-1], int(n.sum()), float((n * (x - x[0])).sum()), x.tobytes(), n.tobytes())], names=["low", "high", "n", "s", "xs", "ns"])

        packed = places.repartitionByRange(blocks, "x").sortWithinPartitions("x").mapInArrow(pack, "low double, high double, n long, s double, xs binary, ns binary")
        self.parts = _held(packed)  # a row a block
        got = sorted(tuple(r) for r in self.parts.select("low", "high", "n", "s").collect())
        self.low, self.high, above = (np.array([r[j] for r in got], float) for j in (0, 1, 3))
        self.n = np.array([r[2] for r in got], np.int64)
        self.s = above + self.n * (self.low - self.low[len(got) // 2])

    def within(self, limits: np.ndarray, sums: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per limit: pairs of rows at most so far apart, and (``sums``) the sums of their distances and of all greater ones."""
        limits, blocks = np.asarray(limits, float), len(self.n)
        count, under, over = np.zeros(len(limits), np.int64), np.zeros(len(limits)), np.zeros(len(limits))
        n, s = np.r_[0, np.cumsum(self.n)], np.r_[0.0, np.cumsum(self.s)]
        cut = set()
        for i, t in enumerate(limits.tolist()):
            # For block a: those before ``whole`` lie within the limit, those from ``none`` beyond it.
            whole, none = _beyond(self.high, self.low, t), _beyond(self.low, self.high, t)
            first = np.arange(blocks) + 1
            inside = np.maximum(whole, first)
            count[i] += int((self.n * (n[inside] - n[first])).sum())
            if sums:
                under[i] += float((self.n * (s[inside] - s[first]) - self.s * (n[inside] - n[first])).sum())
                over[i] += float((self.n * (s[-1] - s[none]) - self.s * (n[-1] - n[none])).sum())
            own = np.flatnonzero((self.high - self.low > t) | sums)  # blocks whose own pairs are to be looked at
            count[i] += int((self.n * (self.n - 1) // 2).sum() - (self.n[own] * (self.n[own] - 1) // 2).sum())
            cut.update((a, a) for a in own.tolist())
            cut.update((a, b) for a in range(blocks) for b in range(inside[a], none[a]))
        for i, c, u, o in self._cut(sorted(cut), limits, sums):
            count[i], under[i], over[i] = count[i] + c, under[i] + u, over[i] + o
        return count, under, over

    def _cut(self, cells: list[tuple[int, int]], limits: np.ndarray, sums: bool) -> list[tuple]:
        spark = self.parts.sparkSession
        plan = [(c, side, float(self.low[cell[side]])) for c, cell in enumerate(cells) for side in ((0,) if cell[0] == cell[1] else (0, 1))]
        wanted = spark.createDataFrame(plan, "c int, side int, low double")
        tasks = max(1, min(len(cells), 4 * spark.sparkContext.defaultParallelism), len(cells) // 64)
        rows = self.parts.join(F.broadcast(wanted), "low").select("c", "side", "xs", "ns").repartition(tasks, "c").sortWithinPartitions("c", "side")  # a few rows a block

        def run(batches):
            total = [np.zeros(len(limits), np.int64), np.zeros(len(limits)), np.zeros(len(limits))]
            now, held = None, []
            for batch in batches:
                for c, x, n in zip(*(batch.column(j).to_pylist() for j in (0, 2, 3))):
                    if held and c != now:
                        _add_cell(total, limits, sums, *held)
                        held = []
                    now, held = c, [*held, (np.frombuffer(x), np.frombuffer(n, np.int64))]
            if held:
                _add_cell(total, limits, sums, *held)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(limits)), pa.int32()), pa.array(total[0]), pa.array(total[1]), pa.array(total[2])], names=["i", "c", "u", "o"])

        return [tuple(r) for r in rows.mapInArrow(run, "i int, c long, u double, o double").groupBy("i").agg(F.sum("c"), F.sum("u"), F.sum("o")).collect()]

    def distances(self, places: list[int], fan: int = 16) -> dict[int, float]:
        """Distances at places (from 0) of the sorted list of all pairs: every pass parts each bracket of doubles into ``fan``, until it is one double."""
        widest = float(self.high[-1] - self.low[0])
        bits = lambda v: int(np.float64(v).view(np.int64))
        value = lambda b: float(np.int64(b).view(np.float64))
        held = {p: (-1, bits(widest)) for p in set(places)}  # up to the first there are too few pairs, up to the second enough
        while open_ := [p for p, (low, high) in held.items() if high - low > 1]:
            asked = {}
            for p in open_:
                low, high = held[p]
                even = {low + (high - low) * j // fan for j in range(1, fan)}
                if high >> 52 > max(low, 0) + (1 << 52) >> 52:  # over several powers of two, evenly by value too
                    even |= {0} | {bits(value(max(low, 0)) + (value(high) - value(max(low, 0))) * j / fan) for j in range(1, fan)}
                asked[p] = sorted(b for b in even if low < b < high)
            every = sorted(set().union(*asked.values()))
            counts = dict(zip(every, self.within(np.array([value(b) for b in every]))[0].tolist()))
            for p in open_:
                low, high = held[p]
                held[p] = max([low, *(b for b in every if low < b < high and counts[b] <= p)]), min([high, *(b for b in every if low < b < high and counts[b] > p)])
        return {p: value(high) for p, (_, high) in held.items()}


def _beyond(edges: np.ndarray, starts: np.ndarray, t: float) -> np.ndarray:
    """For every start, the first place of ascending edges that lies more than t above it as doubles are subtracted."""
    last = len(edges) - 1
    p = np.searchsorted(edges, starts + t, "right")
    while (more := (p <= last) & (edges[np.minimum(p, last)] - starts <= t)).any():
        p = p + more
    while (less := (p > 0) & (edges[np.maximum(p - 1, 0)] - starts > t)).any():
        p = p - less
    return p


def _add_cell(total: list[np.ndarray], limits: np.ndarray, sums: bool, a: tuple, b: tuple | None = None) -> None:
    """Adds a pair of blocks, for every limit that cuts it; b is None for a block's own pairs."""
    xa, na, (xb, nb), own = *a, b or a, b is None
    upto, far = np.r_[0, np.cumsum(nb)], np.r_[0.0, np.cumsum(nb * (xb - xb[0]))]
    after, alike = (np.arange(len(xa)) + 1, int((na * (na - 1) // 2).sum())) if own else (np.zeros(len(xa), int), 0)
    gap, back, ends = xa - xb[0], -xa[::-1], -xb[[0, -1]]
    for i, t in enumerate(limits.tolist()):
        if not (sums or t < xb[-1] - xa[0] if own else xb[0] - xa[-1] <= t < xb[-1] - xa[0]):
            continue
        begin, end = len(xa) - _beyond(back, ends, t)  # rows before have nothing of b within the limit, rows after have all
        p = np.full(len(xa), len(xb))
        p[:begin], p[begin:end] = 0, _beyond(xb, xa[begin:end], t)
        c = upto[p] - upto[after]
        total[0][i] += int((na * c).sum()) + alike
        if sums:
            total[1][i] += float((na * (far[p] - far[after] - gap * c)).sum())
            total[2][i] += float((na * (far[-1] - far[p] - gap * (upto[-1] - upto[p]))).sum())


def extreme_sums(df: DataFrame, vec: str, counts: list[int], n: int) -> list[tuple[float, float]]:
    """As of :func:`blocks.extreme_sums`: for each count m, the sum of the m smallest and of the m largest distances of all n pairs."""
    if not any(counts):
        return [(0.0, 0.0) for _ in counts]
    places = Places(df, vec)
    found = places.distances([p for m in counts if m for p in (m - 1, n - m)])
    limits = sorted(set(found.values()))
    got = dict(zip(limits, zip(*(v.tolist() for v in places.within(np.array(limits), True)))))
    out = []
    for m in counts:
        if not m:
            out.append((0.0, 0.0))
            continue
        low, high = found[m - 1], found[n - m]
        count, under, _ = got[low]
        upto, _, over = got[high]
        out.append((under - (count - m) * low, over + (m - (n - upto)) * high))
    return out
