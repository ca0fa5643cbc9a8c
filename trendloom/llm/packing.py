"""Packing by concatenate and cut, with two-pass prefix sums.

Pass one tokenises every text and writes its ids with the running offset inside
its partition; partition totals (one row a partition) give each partition's
global base.  Pass two is a map: pieces are cut at multiples of ``window``.
No shuffle; the written table makes a lost executor cost one task.

Defined cases: null or empty text is the separator alone; repeated rows are
packed once each; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import json
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

_LOADED: dict = {}


def check_ranks(path: str, ranks: dict[bytes, int]) -> None:
    """Raise unless a byte-level tokenizer file holds these ranks, merges in their order, and nothing that changes texts or splits before."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    model, added = told["model"], {t["content"] for t in told["added_tokens"]}
    # Byte-level files write each byte as a character: printable ones as themselves, the others from U+0100 upwards.
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    raw = lambda token: bytes(byte[c] for c in token)
    vocabulary = {raw(t): i for t, i in model["vocab"].items() if t not in added}
    if vocabulary != ranks:
        raise ValueError(f"{len(vocabulary.items() ^ ranks.items())} entries differ between the tokenizer file and its ranks")
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    order = [ranks[raw(a + b)] for a, b in pairs]
    if any(a >= b for a, b in zip(order, order[1:])):
        raise ValueError("merges of the tokenizer file do not follow the ranks")
    before = told["pre_tokenizer"]
    if told["normalizer"] or model["ignore_merges"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"]:
        raise ValueError("the tokenizer file prepares texts in another way")


def _encoder(path: str, ranks: str | None, pattern: str | None):
    """Texts to lists of ids.  With a ranks file of the same vocabulary, a faster library gives the same ids; another vocabulary is refused."""
    key = (path, ranks, pattern)
    if key not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        slow = lambda texts: [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            check_ranks(path, table)
            special = {t.content: i for i, t in tok.get_added_tokens_decoder().items()}
            enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens=special)
            _LOADED[key] = lambda texts: [enc.encode(t, allowed_special="all") for t in texts]
        else:
            _LOADED[key] = slow
    return _LOADED[key]


def _groups(texts: list[str], chars: int):
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= chars:
            yield texts[start:i + 1]
            start, total = i + 1, 0
    if start < len(texts):
        yield texts[start:]


def token_table(docs: DataFrame, tokenizer_path: str, separator: int = 0, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """``doc_id, part, local, n, ids``: little-endian unsigned 32-bit ids with the separator."""

    def run(batches):
        encode, part, local = _encoder(tokenizer_path, ranks, pattern), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
            at = 0
            for some in _groups(texts, 1 << 20):
                ids, ns, locs = [], [], []
                for e in encode(some):
                    a = np.array(e + [separator], dtype="<u4")
                    ids.append(a.tobytes())
                    ns.append(len(a))
                    locs.append(local)
                    local += len(a)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(some)), pa.array([part] * len(some), pa.int32()), pa.array(locs, pa.int64()), pa.array(ns, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "part", "local", "n", "ids"])
                at += len(some)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, part int, local long, n long, ids binary")


def pack(docs: DataFrame, tokenizer_path: str, window: int = 1024, separator: int = 0, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row a piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    tokens = checkpointed(token_table(docs, tokenizer_path, separator, ranks, pattern))
    base, total = {}, 0
    for part, n in sorted(tuple(r) for r in tokens.groupBy("part").agg(F.sum("n")).collect()):
        base[part], total = total, total + n

    def cut(batches):
        for batch in batches:
            out = [[] for _ in range(7)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=names)
            for doc, part, local, n, ids in zip(*(batch.column(i).to_pylist() for i in range(5))):
                at, view = base[part] + local, memoryview(ids)
                start = 0
                while start < n:
                    seq, offset = divmod(at + start, window)
                    length = min(window - offset, n - start)
                    for c, v in zip(out, (doc, start, length, zlib.crc32(view[4 * start:4 * (start + length)]), n, seq, offset)):
                        c.append(v)
                    start += length
            yield flush()

    return tokens.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
