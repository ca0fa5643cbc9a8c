"""Language identification by prediction by partial matching.

For each language a context tree of bytes is counted: contexts of zero to
``order`` bytes, escape method C with exclusion.  A symbol seen c times in a
context of total t with q different symbols costs ``-log(c / (t + q))``; any other
costs the escape, ``-log(q / (t + q))`` over the share that the shorter context
leaves to unseen symbols, and its cost there; below the empty context all 256 bytes
are alike.  The statistics are then frozen, so the exact code length of a whole
text is a sum over its bytes.  The language of least code length wins.

All trees share one table of keys (context and symbol), whose rows hold the
costs under every language, so that a byte is looked up once for all of them.

The trees are fitted on a bounded sample: about ``sample_bytes`` bytes a language, drawn by a hash of
the doc_id from labelled texts of at most ``longest`` characters that are not held out.

Defined cases: null text, or text with no letter, is ``und`` with score 0; with
no labelled row everything is ``und``; languages tie to the smaller name; repeated rows keep a row each; very long
texts are scored whole, in stretches; columns of the input named like the result's are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

CHUNK = 1 << 18
_U = np.uint64


def held_out() -> "F.Column":
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(3)) == 1, F.lit(False))


def sample_rows(docs: DataFrame, sample_bytes: int, longest: int, seed: int) -> dict[str, list[str]]:
    """Labelled texts by language; what is collected is bounded by ``2 * sample_bytes + longest`` characters a language."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.char_length("text") <= longest) & ~held_out()).select("doc_id", "lang", "text")
    total = rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("total"))
    u = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    picked = rows.join(F.broadcast(total) if total.count() <= 10000 else total, "lang").filter(u * F.col("total") < sample_bytes)
    out: dict[str, list[str]] = {}
    size: dict[str, int] = {}
    for lang, text in sorted(tuple(r) for r in picked.select("lang", "text").collect()):
        if size.get(lang, 0) < 2 * sample_bytes:
            out.setdefault(lang, []).append(text)
            size[lang] = size.get(lang, 0) + len(text)
    return out


def packed(data: np.ndarray, length: int) -> np.ndarray:
    """Each stretch of ``length`` bytes as a number; the first byte is the highest."""
    n = max(0, len(data) - length + 1)
    key = np.zeros(n, np.uint64)
    for j in range(length):
        key = key << _U(8) | data[j:j + n].astype(np.uint64)
    return key


def tree(texts: list[bytes], order: int) -> list[tuple]:
    """Per order: sorted keys of (context, symbol), their cost, sorted contexts, cost of their escape."""
    starts = bytes(order)
    data = [np.frombuffer(starts + t, np.uint8) for t in texts]
    levels: list[tuple] = []
    for d in range(order + 1):
        keys = np.concatenate([packed(x[order - d:], d + 1) for x in data] or [np.empty(0, np.uint64)])
        key, count = np.unique(keys, return_counts=True)
        ctx, at = np.unique(key >> _U(8), return_inverse=True)
        total = np.bincount(at, weights=count, minlength=len(ctx))
        kinds = np.bincount(at, minlength=len(ctx))
        shorter = np.bincount(at, weights=np.exp(-cost_of(levels, key, d - 1)), minlength=len(ctx))
        left = np.maximum(1 - shorter, 1e-12)
        levels.append((key, -np.log(count / (total + kinds)[at]), ctx, -np.log(kinds / (total + kinds) / left)))
    return levels


def cost_of(levels: list[tuple], key: np.ndarray, order: int) -> np.ndarray:
    """Code length of the last byte of each key after the ``order`` bytes before it."""
    cost = np.zeros(len(key))
    todo = np.arange(len(key))
    for d in range(order, -1, -1):
        keys, costs, ctx, escape = levels[d]
        if not len(keys):
            continue
        k = key[todo] & _U((1 << 8 * (d + 1)) - 1)
        i = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
        hit = keys[i] == k
        cost[todo[hit]] += costs[i[hit]]
        todo, k = todo[~hit], k[~hit]
        i = np.minimum(np.searchsorted(ctx, k >> _U(8)), len(ctx) - 1)
        known = ctx[i] == k >> _U(8)
        cost[todo[known]] += escape[i[known]]
    cost[todo] += np.log(256)
    return cost


def fit(texts: dict[str, list[str]], order: int = 4) -> dict:
    """Frozen tables: per order the keys that any language has seen, with their costs under every language, and so for escapes."""
    langs = sorted(texts)
    trees = [tree([lowered(t) for t in texts[x]], order) for x in langs]
    levels = []
    for d in range(order + 1):
        keys = np.unique(np.concatenate([t[d][0] for t in trees] or [np.empty(0, np.uint64)]))
        ctx = np.unique(keys >> _U(8))
        costs = np.stack([cost_of(t, keys, d) for t in trees], 1).astype(np.float32) if trees else np.empty((0, 0), np.float32)
        escape = np.zeros((len(ctx), len(langs)), np.float32)
        for j, t in enumerate(trees):
            i = np.minimum(np.searchsorted(t[d][2], ctx), max(0, len(t[d][2]) - 1))
            if len(t[d][2]):
                escape[:, j] = np.where(t[d][2][i] == ctx, t[d][3][i], 0)
        levels.append((keys, costs, ctx, escape))
    return {"langs": langs, "order": order, "levels": levels}


def lowered(text: str) -> bytes:
    return pc.utf8_lower(pa.scalar(text)).as_py().encode("utf-8", "replace")


class Index:
    """Places of sorted keys by a hash table of several tries; -1 where there is none."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(12, int(4 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        left, self.tries = np.arange(len(keys), dtype=np.int32), 0
        while len(left):
            s = self._slot(keys[left], self.tries)
            free = self.slots[s] < 0
            self.slots[s[free]] = left[free]
            left = left[self.slots[s] != left]
            self.tries += 1

    def _slot(self, k: np.ndarray, i: int) -> np.ndarray:
        return ((k * _U(0x9E3779B97F4A7C15) + _U((i * 0xD6E8FEB86659FD93) & (1 << 64) - 1)) * _U(0xC2B2AE3D27D4EB4F | 1) >> _U(64 - self.bits)).astype(np.int64)

    def find(self, k: np.ndarray) -> np.ndarray:
        out = np.full(len(k), -1, np.int32)
        todo = np.arange(len(k))
        for i in range(self.tries):
            at = self.slots[self._slot(k[todo], i)]
            hit = (at >= 0) & (self.keys[at] == k[todo])
            out[todo[hit]] = at[hit]
            todo = todo[(at >= 0) & ~hit]
            if not len(todo):
                break
        return out


class Scorer:
    """Code lengths of texts under all languages at once."""

    def __init__(self, model: dict):
        self.langs, self.order = model["langs"], model["order"]
        self.levels = [(Index(keys), costs, Index(ctx), escape) for keys, costs, ctx, escape in model["levels"]]

    def bytes_cost(self, data: np.ndarray) -> np.ndarray:
        """Costs (byte by language) of all bytes after the first ``order``."""
        key = packed(data, self.order + 1)
        out = np.zeros((len(key), len(self.langs)), np.float32)
        todo = None
        for d in range(self.order, -1, -1):
            keys, costs, ctx, escape = self.levels[d]
            k = (key if todo is None else key[todo]) & _U((1 << 8 * (d + 1)) - 1)
            at = keys.find(k)
            miss = np.flatnonzero(at < 0)
            if todo is None:
                out = costs[at] if len(costs) else out
                out[miss] = 0
                todo = miss
            else:
                hit = np.flatnonzero(at >= 0)
                out[todo[hit]] += costs[at[hit]]
                todo = todo[miss]
            if not len(todo):
                return out
            up = ctx.find(k[miss] >> _U(8))
            known = np.flatnonzero(up >= 0)
            out[todo[known]] += escape[up[known]]
        out[todo] += np.float32(np.log(256))
        return out

    def code_lengths(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(text by language) code lengths in nats, and lengths in bytes."""
        texts = pc.utf8_lower(pc.fill_null(texts, "")).cast(pa.large_string())
        _, where, data = texts.buffers()
        n = len(texts)
        offsets = np.frombuffer(where, np.int64)[texts.offset:texts.offset + n + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
        total = np.zeros((n, len(self.langs)))
        lead, i = np.zeros(self.order, np.uint8), 0
        chunk = max(1 << 14, CHUNK * 4 // max(4, len(self.langs)))
        while i < n:
            if offsets[i + 1] - offsets[i] > chunk:
                own = np.r_[lead, raw[offsets[i]:offsets[i + 1]]]
                for at in range(0, len(own) - self.order, chunk):
                    total[i] += self.bytes_cost(own[at:at + chunk + self.order]).sum(0, dtype=np.float64)
                i += 1
                continue
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + chunk, "right")) - 1)
            own = offsets[i:j + 1] - offsets[i]
            # Every text is led by zero bytes, so that it does not see the one before.
            data = np.zeros(int(own[-1]) + self.order * (j - i), np.uint8)
            shift = np.repeat(np.arange(1, j - i + 1) * self.order, np.diff(own))
            data[np.arange(own[-1]) + shift] = raw[offsets[i]:offsets[j]]
            cost = self.bytes_cost(data)
            keep = np.arange(own[-1]) + shift - self.order
            full = np.flatnonzero(np.diff(own))
            if len(full):
                total[i + full] = np.add.reduceat(cost[keep], own[:-1][full], axis=0, dtype=np.float64)
            i = j
        return total, np.diff(offsets)


def fit_groups(texts: dict[str, list[str]], order: int = 4, together: int = 8, max_bytes: int = 4 << 30) -> list[dict]:
    """One table for every few languages: a key is stored under the languages of its group alone, so that all tables together
    grow with the number of languages, not with its square.  Their size is checked, since they are broadcast."""
    langs = sorted(texts)
    models = [fit({x: texts[x] for x in langs[i:i + together]}, order) for i in range(0, len(langs), together)] or [fit({}, order)]
    size = model_bytes(models)
    if size > max_bytes:
        raise ValueError(f"tables of {size} bytes for {len(langs)} languages; at most {max_bytes} are broadcast")
    return models


def model_bytes(models: list[dict]) -> int:
    return sum(a.nbytes for m in models for level in m["levels"] for a in level)


class Scorers:
    """All groups of languages, one after the other."""

    def __init__(self, models: list[dict]):
        self.own = [Scorer(m) for m in models]
        self.langs = [x for s in self.own for x in s.langs]

    def code_lengths(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [s.code_lengths(texts) for s in self.own]
        return np.concatenate([f[0] for f in found], 1), found[0][1]


def identify(docs: DataFrame, sample_bytes: int = 1_000_000, longest: int = 50_000, order: int = 4, seed: int = 5) -> DataFrame:
    """``held_out, lang_pred, score`` added to the columns of docs."""
    model = docs.sparkSession.sparkContext.broadcast(fit_groups(sample_rows(docs, sample_bytes, longest, seed), order))
    new = ["held_out", "lang_pred", "score"]
    rest = [c for c in docs.columns if c not in new]
    rows = docs.select(*rest).withColumn("held_out", held_out())
    schema = StructType([*rows.schema.fields[:-1], StructField("held_out", BooleanType()), StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def predict(batches):
        scorer = Scorers(model.value)
        langs = np.array([*scorer.langs, "und"], object)
        for batch in batches:
            text = batch.column("text")
            letters = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            best, score = np.full(len(text), len(scorer.langs)), np.zeros(len(text))
            if scorer.langs and letters.any():
                cost, size = scorer.code_lengths(text.filter(pa.array(letters)))
                best[letters] = cost.argmin(1)
                # Per-byte evidence decays with the root of the length: long texts are not independent bytes.
                z = -(cost - cost.min(1, keepdims=True)) / np.sqrt(np.maximum(1, size))[:, None]
                score[letters] = 1 / np.exp(z).sum(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs[best], pa.string()), pa.array(score)], names=[*batch.schema.names, "lang_pred", "score"])

    return rows.mapInArrow(predict, schema)
