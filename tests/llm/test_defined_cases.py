"""Nulls, ties, repeated rows, empty and very long texts, empty tables, and extra columns with clashing names, for every operator."""

import pytest

from pyspark.sql import functions as F

from trendloom.llm import ann, jaccard, langid, licenses, mixing, packing, pii, sharding, syncmers, wrapper_html
from trendloom.llm.queries import ranks, tokenizer_path

CLASHING = ["size", "source_size", "taken", "gid", "bucket", "copy", "top", "fp", "w", "n", "i", "label", "shard", "slot", "start", "length", "spans", "score", "held_out", "words", "ids", "key", "block", "quota", "_row", "_part", "n_words", "component_id", "edited"]
DOCUMENTS = {
    "op1": lambda d: pii.digest(pii.find(d)), "op2": lambda d: packing.pack(d, tokenizer_path(), **ranks()), "op3": sharding.shard, "op4": mixing.mix, "op5": lambda d: langid.identify(d).select("doc_id", "held_out", "lang_pred", "score"),
    "op7": syncmers.fingerprint_edits, "op9": jaccard.join_components, "op10": licenses.scan,
}


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def with_extras(df):
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHING if c not in df.columns])


@pytest.fixture(scope="module")
def hard(spark):
    rows = [
        (None, None, None, None, None), (None, "a null id and mail a@b.cc here", "en", None, 1), (None, "a null id and mail a@b.cc here", "en", None, 1), (2, "", "en", "a", 0),
        (3, "one of two texts of the same id, mit license", "en", "a", 1), (3, "the other of two texts of the same id, call +49 30 1234567", None, "a", 1), (4, " \t\n", "de", "b", 1),
        (5, "lang " * 40000 + "z@y.xx", "en", "b", 1), (6, "y" * 200000, "en", "b", 1), (7, "漢字かな交じり文 " * 20, "ja", "ü", 1), (-8, "tie tie tie tie tie tie", "en", "a", 1), (8, "tie tie tie tie tie tie", "en", "a", 1),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").cache()


@pytest.mark.parametrize("name", sorted(DOCUMENTS))
def test_documents(name, hard):
    run = DOCUMENTS[name]
    got = values(run(hard))
    assert values(run(with_extras(hard))) == got
    if name == "op2":
        starts = [r for r in run(hard).collect() if r.start == 0]
        assert len(starts) == hard.count()
    else:
        assert len(got) == hard.count()
    assert values(run(hard.limit(0))) == []


def test_pages(spark):
    rows = [(None, None, None), (1, None, "<p>no url"), (1, None, "<p>no url"), (2, "not a url", "<article><p>" + "long text " * 50000 + "</article>"), (3, "http://h/a", ""), (4, "http://h/b", "plain & text")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = values(wrapper_html.extract_pages(df))
    extra = df.select("*", *[F.lit("x").alias(c) for c in ("host", "text", "n_chars", "keys", "total", "count", "path", "chain", "template", "_row")])
    assert values(wrapper_html.extract_pages(extra)) == got
    assert [(r[0], r[2]) for r in got if r[0] in (1, 4)] == [(1, "no url"), (1, "no url"), (4, "plain & text")]
    assert [r[3] for r in got if r[0] == 2] == [len("long text " * 50000) - 1] and len(got) == 6
    assert values(wrapper_html.extract_pages(df.limit(0))) == []


def test_vectors_with_ties(spark):
    rows = [(i, [1.0, 0.0]) for i in range(0, 30)] + [(40, [0.0, 1.0]), (None, [1.0, 1.0]), (41, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = values(ann.search(df))
    extra = df.select("*", *[F.lit("x").alias(c) for c in ("label", "query_id", "rank", "score", "block", "x", "v")])
    assert values(ann.search(extra)) == got
    # Copies tie: the twenty smallest ids but the query's own, in order.
    for q in (0, 20):
        assert [r[2] for r in sorted(x for x in got if x[0] == q)] == [i for i in range(22) if i != q][:20]
