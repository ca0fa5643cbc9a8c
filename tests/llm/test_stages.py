"""Stages of the pipeline for themselves."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from trendloom.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def test_mix_stage_meets_targets(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(40 + 53 * i % 400)) + "  \n", "en", "abcd"[0 if i % 3 else i % 4], None) for i in range(160)]
    rows += [(200, None, "en", "a", None), (None, "two words", "en", None, 9)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = corpus_pipeline.mix(spark, docs, None).collect()
    words = Counter()
    for r in out:
        words[r.source] += len(WORDS.findall(r.text or ""))
    target = {docs_source: t for docs_source, t in {(r.source, r.target) for r in docs.join(mixing.mix(docs).select("doc_id", "target"), "doc_id").select("source", "target").collect()}}
    assert len(target) == 4 and all(abs(words[s] - t) <= 48 for s, t in target.items()), (words, target)
    whole = {r[0]: r[1] for r in rows}
    assert all((whole[r.doc_id] or "").startswith(r.text or "") for r in out)
    assert sum(r.text != whole[r.doc_id] for r in out) <= 5 and [r.text for r in out if r.doc_id == 200] == [None]


def test_near_duplicates_with_null_and_repeated_ids(spark):
    text = lambda k: " ".join(f"t{k}w{j}" for j in range(30))
    rows = [(None, text(0), "en", "a", 1), (5, text(1), "en", "a", 1), (5, text(2), "en", "a", 1), (4, text(2) + " end", "en", "a", 1), (None, text(2), "en", "b", 1),
            (6, text(3), "en", "a", 1), (6, text(3), "en", "a", 1), (6, text(3), "en", None, 1), (7, text(4), None, "en", 1), (None, text(5), "en", "a", 1), (9, None, "en", "a", None)]
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), None).collect()
    got = sorted(((r.doc_id, r.text) for r in out), key=str)
    want = [(None, text(0)), (5, text(1)), (4, text(2) + " end"), (6, text(3)), (7, text(4)), (None, text(5)), (9, None)]
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_mixed_takes_what_mix_says(spark, shards):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(1 + 53 * i % 300)) + "  \n", "en", "abcd"[0 if i % 3 else i % 4], None) for i in range(120)]
    rows += [(200, " " + "long " * 4000, "en", "b", None), (201, None, "en", "a", None), (None, "two words", "en", None, 9), (202, "twice", "en", "e", 5)]
    docs = spark.createDataFrame(rows, SCHEMA)
    taken = Counter({r.doc_id: r.taken for r in mixing.mix(docs, shards=shards).collect()})
    whole, got = {r[0]: r[1] for r in rows}, Counter()
    for r in mixing.mixed(docs, shards=shards).collect():
        got[r.doc_id] += len(WORDS.findall(r.text or ""))
        assert (r.text or "") in (whole[r.doc_id] or "") and (r.text == whole[r.doc_id] or r.n_chars == len(r.text))
    assert +got == +taken and max(taken.values()) > 4000
