"""The whole pipeline against plain Python, stage by stage, on its own written tables."""

import os
from collections import Counter
from glob import glob

import numpy as np
import zlib

import corpus_pipeline
from test_brute_force import WORDS, base_spans, plain_components, shingles, targets
from trendloom.llm import langid
from trendloom.llm.common import shared_folder
from trendloom.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


def test_run_end_to_end(spark):
    from tokenizers import Tokenizer

    folder = shared_folder(spark).removeprefix("file:")
    before = set(glob(f"{folder}/*"))
    out = corpus_pipeline.run(spark, SF).collect()
    made = set(glob(f"{folder}/*")) - before
    stage = {name: spark.read.parquet(next(p for p in made if os.path.basename(p).startswith(f"{name}-"))) for name, _ in corpus_pipeline.STAGES}
    assert all(stage[n].columns == corpus_pipeline.COLUMNS for n in list(stage)[:-1])
    rows = {n: df.collect() for n, df in stage.items()}

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pred = {r.doc_id: r.lang_pred for r in langid.identify(docs).collect()}
    kept = {r.doc_id: r.text for r in docs.collect() if pred[r.doc_id] != "und"}
    assert {r.doc_id: (r.text, r.lang) for r in rows["language_id"]} == {d: (t, pred[d]) for d, t in kept.items()}

    classes = plain_components([(d, shingles(t)) for d, t in kept.items()])
    heads = {c for _, _, c in classes}
    assert sorted(r.doc_id for r in rows["jaccard_join"]) == sorted(heads) and all(r.text == kept[r.doc_id] for r in rows["jaccard_join"])

    assert sorted(r.doc_id for r in rows["pii"]) == sorted(heads) and not any(base_spans(r.text) for r in rows["pii"])
    spans = Counter(bool(base_spans(kept[d])) for d in heads)
    assert sum(r.text != kept[r.doc_id] for r in rows["pii"]) >= spans[True] > 0

    size, got = Counter(), Counter()
    for r in rows["pii"]:
        size[r.source] += len(WORDS.findall(r.text))
    for r in rows["mixing"]:
        got[r.source] += len(WORDS.findall(r.text))
    want = targets(size)
    assert all(abs(got[s] - t) <= 48 for s, t in want.items())

    tok = Tokenizer.from_file(tokenizer_path())
    pieces, texts = Counter(), Counter()
    for r in rows["mixing"]:
        texts[r.doc_id, tuple(tok.encode(r.text, add_special_tokens=False).ids + [0])] += 1
    by_doc = {}
    for (d, ids), n in texts.items():
        by_doc.setdefault(d, []).append(ids)
    for r in out:
        pieces[r.doc_id] += r.length
        assert any(len(ids) == r.doc_tokens and zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for ids in by_doc[r.doc_id])
    assert pieces == Counter({d: sum(len(ids) * texts[d, ids] for ids in all_) for d, all_ in by_doc.items()})
    filled = Counter()
    for r in out:
        filled[r.sequence_id] += r.length
    assert sum(n < 1024 for n in filled.values()) <= 1 and max(filled.values()) <= 1024
