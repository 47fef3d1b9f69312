"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a line of a document; a template is the set of words of a license statement. A template is
found in every block that contains at least ``CONTAINMENT`` of its words (where one template found is
part of another found in the same block, the longer one counts). Words are ordered by how
often the whole corpus has them, rarest first, and three filters leave few pairs to verify, losing none:

* prefix: with n template words of which k must be present, some of the n - k + 1 rarest is;
* length: the block has at least k distinct words;
* position: a match at the i-th rarest word, as the first one, leaves n - i at most.

Statements wrapped over lines are found as well: where as many consecutive words as the template has, and a ninth
more, hold that share of its words, but no line of theirs does. Lines and blank lines between do not matter.

Besides, verbatim phrases are counted at every place where their words stand consecutively.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, U64, Words, slices, small_batches, texts_of

#: Phrases whose every place counts, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Statements by which texts name their license, by label.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at apache org licenses license 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "licensed under the bsd license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("proprietary", "all rights reserved no part may be reproduced without permission"),
)
CONTAINMENT = Fraction(9, 10)
RUN_BYTES = 1 << 19


def _hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return Words(raw, np.array([0, len(raw)]), ALNUM).hash


class _Templates:
    """The templates' words as numbers, in the corpus's order, and their prefixes."""

    def __init__(self, templates: tuple[tuple[str, str], ...], containment: Fraction, counts: dict[int, int]):
        spelled = [_hashes(t) for _, t in templates]
        sets = [np.unique(s) for s in spelled]
        #: consecutive words that a statement wrapped over lines may take
        self.width = [len(s) * containment.denominator // containment.numerator for s in spelled]
        self.labels = [name for name, _ in templates]
        vocabulary = np.unique(np.concatenate(sets)) if sets else np.zeros(0, U64)
        order = sorted(range(len(vocabulary)), key=lambda k: (counts.get(int(vocabulary[k].view(np.int64)), 0), int(vocabulary[k])))
        rank = np.empty(len(vocabulary), np.int64)
        rank[order] = np.arange(len(vocabulary))
        self.vocabulary, self.rank = vocabulary, rank
        self.sets = [np.sort(rank[np.searchsorted(vocabulary, s)]) for s in sets]
        self.need = [-(-len(s) * containment.numerator // containment.denominator) for s in sets]
        self.starts: dict[int, list[tuple[int, int]]] = {}
        for t, (s, k) in enumerate(zip(self.sets, self.need, strict=True)):
            for i, token in enumerate(s[: len(s) - k + 1].tolist()):
                self.starts.setdefault(token, []).append((t, i))
        self.within = {(t, u): set(a) < set(b) for t, a in enumerate(map(tuple, self.sets)) for u, b in enumerate(map(tuple, self.sets))}
        self.prefix = np.zeros(len(vocabulary), bool)
        self.prefix[list(self.starts)] = True

    def wrapped(self, doc: np.ndarray, line: np.ndarray, at: np.ndarray, token: np.ndarray, held: dict[int, dict[int, float]]) -> list[tuple[int, int, float]]:
        """(row, template, share) of each place where a template stands across lines, none of which has it in ``held``.

        ``at`` are the places of words of templates, ascending; ``token`` their numbers.
        """
        found: list[list] = []
        for t, (own, need) in enumerate(zip(self.sets, self.need, strict=True)):
            mine = np.flatnonzero(np.isin(token, own)) if need > 1 and np.isin(own[: len(own) - need + 1], token).any() else []
            if len(mine) < need:
                continue
            p, row, on, word = at[mine], doc[mine], line[mine], token[mine]
            end = np.minimum(np.searchsorted(p, p + self.width[t]), np.searchsorted(row, row, "right"))
            last = None
            for i in np.flatnonzero((end - np.arange(len(p)) >= need) & (on[end - 1] != on)).tolist():
                j = int(end[i])
                n = len(np.unique(word[i:j]))
                if n < need or any(t in held.get(k, ()) for k in on[i:j].tolist()):
                    continue
                if last and last[0] == row[i] and last[3] >= p[i]:
                    last[2:] = max(last[2], n / len(own)), int(p[j - 1]), last[4] | set(on[i:j].tolist())
                else:
                    last = [int(row[i]), t, n / len(own), int(p[j - 1]), set(on[i:j].tolist()), int(p[i])]
                    found.append(last)
        within = lambda x: any(self.within[x[1], u] for k in x[4] for u in held.get(k, ())) or any(
            self.within[x[1], y[1]] and x[5] <= y[3] and y[5] <= x[3] for y in found
        )
        return [(d, t, share) for x in found if not within(x) for d, t, share in [x[:3]]]


def vocabulary_counts(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> dict[int, int]:
    """How often the whole corpus has each word of the templates (as many numbers as those have words)."""
    vocabulary = np.unique(np.concatenate([_hashes(t) for _, t in templates])) if templates else np.zeros(0, U64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary) + 1, np.int64)
        for batch in batches:
            raw, offsets = texts_of(batch.column(0))
            for a, b in slices(offsets, RUN_BYTES):
                w = Words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ALNUM)
                at = np.minimum(np.searchsorted(vocabulary, w.hash), max(0, len(vocabulary) - 1))
                total[: len(vocabulary)] += np.bincount(at[vocabulary[at] == w.hash], minlength=len(vocabulary)) if len(vocabulary) else 0
        yield pa.RecordBatch.from_arrays([pa.array(vocabulary.view(np.int64)), pa.array(total[: len(vocabulary)])], ["word", "n"])

    if not len(vocabulary):
        return {}
    rows = docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r.word: r.n for r in rows}


def scan(spark: SparkSession, docs: DataFrame, *, phrases: dict[str, str] | None = None, templates: tuple[tuple[str, str], ...] = TEMPLATES, containment: Fraction = CONTAINMENT) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks.

    Words are runs of digits, letters and non-ASCII characters after A-Z became a-z. n_base counts the
    places of all phrases, first_word and last_word are the smallest and largest word number where one
    starts (null without one), base_labels are their labels. labels adds those of templates found in some
    line, or wrapped over lines; n_blocks counts pairs of a line and a template found in it, and places of wrapped
    ones. score is the largest share of a template's words that a line or such a place holds, if found, and 1 with
    a phrase; else 0. Null or empty text: no words,
    empty labels, score 0. Null doc_id and repeated rows: each its own row. Extra columns are not read.
    """
    small_batches(spark)
    phrases = PHRASES if phrases is None else phrases
    known = _Templates(templates, containment, vocabulary_counts(docs, templates))
    spelled = [(_hashes(p), label) for p, label in phrases.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = texts_of(batch.column(1))
            for a, b in slices(offsets, RUN_BYTES):
                yield from one(batch.column(0).slice(a, b - a), raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])

    def one(ids: pa.Array, raw: np.ndarray, offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
        w = Words(raw, offsets, ALNUM)
        n = w.n_docs
        places, first, last = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        base: list[set[str]] = [set() for _ in range(n)]
        more: list[set[str]] = [set() for _ in range(n)]
        score, found = np.zeros(n), np.zeros(n, np.int64)
        for words, label in spelled:
            k = len(w.hash) - len(words) + 1
            if k <= 0 or not len(words):
                continue
            hit = w.doc[:k] == w.doc[len(words) - 1 :]
            for i, h in enumerate(words):
                hit &= w.hash[i : i + k] == h
            for at in np.flatnonzero(hit).tolist():
                d = int(w.doc[at])
                nth = at - int(w.first[d])
                places[d] += 1
                first[d] = nth if first[d] < 0 else min(first[d], nth)
                last[d] = max(last[d], nth)
                base[d].add(label)
                score[d] = 1.0
        if len(known.vocabulary) and len(w.hash):
            at = np.minimum(np.searchsorted(known.vocabulary, w.hash), len(known.vocabulary) - 1)
            hits = np.flatnonzero(known.vocabulary[at] == w.hash)
            token = known.rank[at[hits]]
            lines = np.append(0, np.cumsum(raw == 10))
            # a line number that also grows from text to text
            line = lines[w.start] + w.doc
            starts = hits[known.prefix[token]]
            line_holds: dict[int, dict[int, float]] = {}
            if len(starts):
                own = np.unique(line[starts])
                inside = np.isin(line[hits], own)
                rows, tokens = line[hits][inside], token[inside]
                pairs = np.unique(np.stack([rows, tokens], 1), axis=0)
                head = np.flatnonzero(np.append(True, pairs[1:, 0] != pairs[:-1, 0]))
                for i, j in zip(head, np.append(head[1:], len(pairs)), strict=True):
                    have = pairs[i:j, 1]
                    tried: set[int] = set()
                    held: dict[int, float] = {}
                    for at_least, t0 in enumerate(have.tolist()):
                        for t, place in known.starts.get(t0, ()):
                            need, size = known.need[t], len(known.sets[t])
                            # position filter: rarer template words are absent, if this is the first match
                            if t in tried or size - place < need or len(have) - at_least < need:
                                continue
                            tried.add(t)
                            both = len(np.intersect1d(have, known.sets[t], assume_unique=True))
                            if both >= need:
                                held[t] = both / size
                    if held:
                        line_holds[int(pairs[i, 0])] = held
                    d = int(w.doc[np.searchsorted(line, pairs[i, 0])])
                    for t, share in held.items():
                        # a statement within a longer one that was found, too, is not what the line says
                        if not any(known.within[t, u] for u in held):
                            more[d].add(known.labels[t])
                            score[d] = max(score[d], share)
                            found[d] += 1
                for d, t, share in known.wrapped(w.doc[hits], line[hits], hits, token, line_holds):
                    more[d].add(known.labels[t])
                    score[d] = max(score[d], share)
                    found[d] += 1
        none = first < 0
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(np.diff(w.first)), pa.array(places), pa.array(first, mask=none), pa.array(last, mask=none),
             pa.array([",".join(sorted(s)) for s in base], pa.string()),
             pa.array([",".join(sorted(s | m)) for s, m in zip(base, more, strict=True)], pa.string()), pa.array(score), pa.array(found)],
            ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_blocks"],
        )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_blocks long"
    )
