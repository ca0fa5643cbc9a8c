"""Licence scans with a generalised suffix automaton of licence tokens.

The automaton holds the token sequences of all templates and phrases.  Each
file streams through it once; the matching statistic at a word is the length of
the longest licence passage ending there.  For each template, matches of at
least ``min_match`` words, at most ``gap`` words apart and in the template's
order, chain into covered spans; labels and score come from the spans.  Phrase
states give the fixed base places.

Defined cases: null text is empty (no words, score 0, empty labels); repeated
rows keep a row each; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Short openings and conditions of public licences.
TEMPLATES = {
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "apache-text": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
    "gpl-text": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "warranty-text": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
}
WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLDER = Path(__file__).parent / "license_texts"
LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def words_of(text: str) -> list[str]:
    return WORD.findall(text.translate(LOWER) if not text.isascii() else text.lower())


@cache
def whole_texts() -> dict[str, str]:
    """Whole licence texts by name, as words."""
    return {p.stem: " ".join(words_of(p.read_text("utf-8"))) for p in sorted(FOLDER.glob("*.txt"))}


class Automaton:
    """Suffix automaton of several token sequences; ``labels[state]`` are the sequences that hold its strings, each with the first and last place where they end."""

    def __init__(self, sequences: dict[str, list[str]]):
        self.next, self.link, self.len, self.labels = [{}], [-1], [0], [{}]
        self._held: dict = {}
        for label, words in sequences.items():
            last = 0
            for w in words:
                last = self._extend(last, w)
            state = 0
            for i, w in enumerate(words):
                state = up = self.next[state][w]
                while up > 0:
                    self.labels[up][label] = self.labels[up].get(label, (i,))[0], i
                    up = self.link[up]

    def held(self, state: int, least: int) -> list[tuple]:
        """(label, length, first, last) of the longest suffix of a state's strings in each sequence; length None: the whole match."""
        got = self._held.get((state, least))
        if got is None:
            found = {x: (None, *at) for x, at in self.labels[state].items()}
            up = self.link[state]
            while up > 0 and self.len[up] >= least:
                for x, at in self.labels[up].items():
                    found.setdefault(x, (self.len[up], *at))
                up = self.link[up]
            got = self._held[state, least] = [(x, *v) for x, v in sorted(found.items())]
        return got

    def _new(self, length: int, nxt: dict, link: int) -> int:
        self.next.append(nxt)
        self.len.append(length)
        self.link.append(link)
        self.labels.append({})
        return len(self.len) - 1

    def _split(self, p: int, q: int, w: str) -> int:
        clone = self._new(self.len[p] + 1, dict(self.next[q]), self.link[q])
        self.labels[clone] = dict(self.labels[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, p: int, w: str) -> int:
        q = self.next[p].get(w)
        if q is not None:
            return q if self.len[q] == self.len[p] + 1 else self._split(p, q, w)
        cur = self._new(self.len[p] + 1, {}, 0)
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._split(p, q, w)
        return cur

    def statistics(self, words: list[str]):
        """Yield (position, length, state) for each word that ends a match."""
        nxt, link, length = self.next, self.link, self.len
        root, state, n = nxt[0], 0, 0
        for i, w in enumerate(words):
            if n == 0:
                t = root.get(w)
                if t is None:
                    continue
                state, n = t, 1
            else:
                while state and w not in nxt[state]:
                    state = link[state]
                    n = length[state]
                t = nxt[state].get(w)
                state, n = (t, n + 1) if t is not None else (0, 0)
            if n:
                yield i, n, state


def scan_text(text: str, machine: Automaton, phrases: dict, min_match: int, lengths: dict, gap: int) -> tuple:
    words = words_of(text)
    places, base, spans, last = [], set(), [], {}
    for i, n, state in machine.statistics(words):
        if n >= 2:
            for p, label in phrases.get(words[i], ()):
                if n >= len(p) and words[i - len(p) + 1:i + 1] == p:
                    places.append(i - len(p) + 1)
                    base.add(label)
            if n < min_match:
                continue
            for label, length, first, final in machine.held(state, min_match):
                if label not in lengths:
                    continue
                start = i - (length or n) + 1
                chain = last.get(label)
                # A chain goes on over a gap, in the order of the template.
                if chain and (start <= chain[2] or start - chain[2] <= gap + 1 and final > chain[4]):
                    chain[3] += i - max(chain[2], start - 1)
                    chain[2], chain[4] = i, max(first, min(final, chain[4] + 1))
                else:
                    last[label] = chain = [label, start, i, i - start + 1, first]
                    spans.append(chain)
    spans = sorted((x, s, e + 1, c, min(1.0, c / lengths[x])) for x, s, e, c, _ in spans)
    most: dict = {}
    for x, _, _, c, _ in spans:
        most[x] = most.get(x, 0) + c
    score = max(min(1.0, len(base) / 2 if base else 0.0), min(1.0, max(most.values(), default=0) / 40))
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | set(most))), score, [
        dict(zip(("template", "start", "end", "covered", "coverage"), x)) for x in spans]


def scan(docs: DataFrame, phrases=None, templates=None, min_match: int = 8, gap: int = 8) -> DataFrame:
    """One row a document: places, labels, score and covered template spans (word places, end exclusive)."""
    phrases, templates = phrases or PHRASES, templates or TEMPLATES | whole_texts()
    by_last: dict = {}
    for p, label in phrases.items():
        by_last.setdefault(p.split()[-1], []).append((p.split(), label))
    lengths = {k: len(words_of(v)) for k, v in templates.items()}
    sequences = {k: words_of(v) for k, v in templates.items()} | {f"phrase: {p}": p.split() for p in phrases}
    schema = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<template:string,start:long,end:long,covered:long,coverage:double>>"
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    @F.pandas_udf(schema)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        machine = Automaton(sequences)
        for text in texts:
            out = pd.DataFrame([scan_text(t or "", machine, by_last, min_match, lengths, gap) for t in text], columns=names)
            yield out.astype({"n_words": "int64", "n_base": "int64", "first_word": "Int64", "last_word": "Int64", "score": "float64"})

    return docs.select("doc_id", run("text").alias("r")).select("doc_id", "r.*")
