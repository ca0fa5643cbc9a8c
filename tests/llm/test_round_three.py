"""Limits that earlier forms had: scripts without spaces, many languages, ranges by bytes, recurring headings, persons and accounts."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendloom.llm import langid, pii, sharding, syncmers, wrapper_html


def test_texts_without_spaces_have_anchors(spark):
    rng = np.random.default_rng(1)
    kana = [chr(c) for c in range(0x3042, 0x3090)] + [chr(c) for c in range(0x4E00, 0x4E80)]
    rows = [(i, "".join(rng.choice(kana, 1120))) for i in range(3)] + [(3, "".join(rng.choice(list("abcdefghij"), 900)))]
    got = {r.doc_id: r for r in syncmers.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for r in got.values():
        assert r.fingerprint.count(",") > 200 and r.near_edited > 0.4 and r.near_next < 0.1
    words = spark.createDataFrame([("Ein Wort, zwei_drei; 4you! " + "x" * 32 + " " + "y" * 33,)], "t string")
    tokens = words.select(syncmers.tokens("t")).head()[0]
    assert tokens == ["Ein", "Wort", "zwei", "drei", "4you", "x" * 32, *"y" * 33]
    assert spark.createDataFrame([("abc漢字、def ไทย",)], "t string").select(syncmers.tokens("t")).head()[0] == ["abc", "漢", "字", "def", *"ไทย"]


def test_many_languages_in_linear_space():
    rng = np.random.default_rng(2)
    texts = {}
    for k in range(200):
        letters = rng.choice(list("abcdefghijklmnopqrstuvwxyzäöüß"), 9, replace=False)
        texts[f"l{k:03d}"] = [" ".join("".join(rng.choice(letters, rng.integers(2, 7))) for _ in range(60)) for _ in range(6)]
    models = langid.fit_groups({x: t[:5] for x, t in texts.items()}, 4)
    few = langid.fit_groups({x: texts[x][:5] for x in sorted(texts)[:40]}, 4)
    assert langid.model_bytes(models) < 6 * langid.model_bytes(few) and langid.model_bytes(models) < 400 << 20
    import pyarrow as pa

    scorer = langid.Scorers(models)
    cost, _ = scorer.code_lengths(pa.array([t[5] for t in texts.values()]))
    assert np.mean([scorer.langs[i] == x for i, x in zip(cost.argmin(1), texts)]) > 0.95
    one, split = langid.Scorer(langid.fit({x: texts[x] for x in sorted(texts)[:10]})), langid.Scorers(langid.fit_groups({x: texts[x] for x in sorted(texts)[:10]}, together=3))
    sample = pa.array([t[0] for t in texts.values()][:30])
    assert one.langs == split.langs and np.allclose(one.code_lengths(sample)[0], split.code_lengths(sample)[0])
    with pytest.raises(ValueError):
        langid.fit_groups({x: texts[x] for x in sorted(texts)[:3]}, max_bytes=1000)


def test_ranges_follow_the_bytes(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"))
    got = sharding.shard(df, 7, ranges=1, range_bytes=100).collect()
    size = [0] * 7
    for r in got:
        size[r.shard] += r.size
    assert len(got) == 3000 and max(size) - min(size) <= 2 * 65
    for k in range(7):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))


def recipe(i):
    return f"<html><body><div class='top'>Tasty pages</div><article><h1>Dish {i}</h1><h2>Ingredients</h2><p>Salt and item {i}</p><h2>Method</h2><p>Stir it {i} times</p></article><div class='legal'>All rights kept</div></body></html>"


def test_recurring_headings_stay_and_two_pages_are_a_host(spark):
    for n in (2, 6):
        rows = [(i, f"http://host{n}/p{i}", recipe(i)) for i in range(n)]
        for r in wrapper_html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
            i = r.page_id
            assert r.text == f"Dish {i}\n\nIngredients\n\nSalt and item {i}\n\nMethod\n\nStir it {i} times"
    bare = lambda i: f"<html><body><div>Home of news</div><div><p>Story number {i} of today</p></div><div>Imprint and contact</div></body></html>"
    rows = [(i, f"http://two/p{i}", bare(i)) for i in range(2)]
    assert sorted(r.text for r in wrapper_html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()) == ["Story number 0 of today", "Story number 1 of today"]


def test_comment_words_in_classes():
    page = "<article><p>Text.</p><section class='comments-policy'><p>How we moderate.</p></section><div class='comments-list'><p>Nice!</p></div><div class='disqus-thread'><p>First!</p></div><div class='comment'>Me too</div></article>"
    assert wrapper_html.extract(page, set()) == "Text.\n\nHow we moderate."


def found(spark, *texts):
    rows = pii.digest(pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).orderBy("doc_id").collect()
    return [[(k, texts[r.doc_id][int(a):int(b)]) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)] for r in rows]


def test_persons_addresses_births_and_accounts(spark):
    got = found(spark, "Contact John Doe at 12 Main Street, born 1980-01-02, IBAN DE89370400440532013000, Maria Lopez lives in Berlin",
                "The The old Mill and Some Thing, The House of Old Stone, IBAN DE89370400440532013001", "wohnhaft Hauptstraße 12, geboren am 3.4.1971; Anna Schmidt; 14 rue de Rivoli", "plain words only")
    assert got[0] == [("person", "John Doe"), ("person", "Maria Lopez"), ("address", "12 Main Street"), ("birth", "born 1980-01-02"), ("iban", "DE89370400440532013000")]
    assert got[1] == [] and got[3] == []
    assert got[2] == [("person", "Anna Schmidt"), ("address", "Hauptstraße 12"), ("address", "14 rue de Rivoli"), ("birth", "geboren am 3.4.1971")]


def test_the_classifier_rejects_candidates(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    n = pii.candidates(docs).select(F.size("spans").alias("n")).agg(F.sum("n")).head()[0]
    kept = pii.find(docs).select(F.size("found").alias("n")).agg(F.sum("n")).head()[0]
    assert 0 < kept < n


def test_learning_against_numpy():
    rng = np.random.default_rng(4)
    patterns = [(tuple(int(x) for x in rng.integers(0, 3, pii.LABELERS)), tuple(int(x) for x in rng.integers(0, 4, 5)), int(rng.integers(1, 40))) for _ in range(60)]
    post, true, false, share = pii.estimate(patterns)
    model = pii.learn(patterns)
    w, n = np.array(post), np.array([p[2] for p in patterns])
    one, zero = (w * n).sum(), ((1 - w) * n).sum()
    base = (one + 1) / (one + zero + 2)
    assert model[0]["prior"] == pytest.approx(math.log(share / (1 - share))) and len(model) == 1 + 5 + pii.LABELERS
    for j in range(5):
        f = np.array([p[1][j] for p in patterns])
        for x in set(f.tolist()):
            a, b = (w * n)[f == x].sum(), ((1 - w) * n)[f == x].sum()
            assert model[1 + j][x] == pytest.approx(np.log((a + 30 * base) / (one + 30 * base)) - np.log((b + 30 * (1 - base)) / (zero + 30 * (1 - base))))
    for j in range(pii.LABELERS):
        for x in range(3):
            assert model[6 + j][x] == pytest.approx(math.log(true[j][x] / false[j][x]))
