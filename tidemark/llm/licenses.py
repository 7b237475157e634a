"""License scans by a positional index of rare words.

Templates are word sequences with the key phrases they must contain.  The index holds each template's words with their places.  Words' weights (IDF)
come from the document frequencies of the index's words over all documents.  A file looks up its highest-IDF words of each template: their places
in the file less their places in the template are starts, and starts on which enough of these words agree, give or take SLACK words, are
alignments.  Only files with the rarest word of each of a template's key phrases can have one.  An alignment counts if every mandatory key phrase stands word for word where the template has it, give or take SLACK words.  Its score is the share of
the template's weight that is found in place.

A phrase is a template whose one key phrase is the whole of it; its rarest word alone proposes starts, so all of its places are found.

Texts are read in Arrow batches, in slices of about SLICE bytes or one text: bytes are lowered, cut to words and looked up in vectors.  Nothing but counts of
the index's words is shuffled, and texts never are.

Edge cases: null and empty texts have no words, no labels and score 0; only A-Z are lowered; bytes that aren't ASCII are parts of words; repeated
rows each have a result; an empty table gives an empty one; other columns aren't read; words that no document has weigh as if one had them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rare words of a template that a file looks up, and how many of them must agree on a start.
RARE = 6
AGREE = 3
#: Words that may be put in or left out before a word in place.
SLACK = 3
SLICE = 4 << 20


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    keys: tuple[tuple[int, int], ...]  # (place, length) of each mandatory phrase

    @staticmethod
    def of(label: str, text: str, *phrases: str) -> Template:
        words, keys = tuple(text.split()), []
        for p in map(str.split, phrases or (text,)):
            at = next((i for i in range(len(words) - len(p) + 1) if list(words[i : i + len(p)]) == p), None)
            if at is None:
                raise ValueError(f"{label}: the text lacks {' '.join(p)}")
            keys.append((at, len(p)))
        return Template(label, words, tuple(keys))


# The phrases of the base rule, then notices of public licenses, in lower-case words.
PHRASES = (
    Template.of("mit", "under the mit license"),
    Template.of("apache-2", "apache license version 2"),
    Template.of("cc-by-nc", "cc by nc"),
)
NOTICES = (
    Template.of("agpl-3", "licensed under the gnu affero general public license version 3", "gnu affero general public license", "version 3"),
    Template.of("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "except in compliance with the license", "www apache org licenses license 2 0"),
    Template.of("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "unless required by applicable law or agreed to in writing", "without warranties or conditions of any kind"),
    Template.of("bsd-2", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice", "redistribution and use in source and binary forms", "redistributions in binary form must reproduce the above copyright notice"),
    Template.of("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "may be used to endorse or promote products derived from this software"),
    Template.of("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0 international"),
    Template.of("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial 4 0"),
    Template.of("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike 4 0"),
    Template.of("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
    Template.of("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license", "version 2"),
    Template.of("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license", "version 3"),
    Template.of("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gnu general public license as published by the free software foundation", "version 3 of the license"),
    Template.of("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "gnu general public license as published by the free software foundation", "version 2 of the license"),
    Template.of("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "for any purpose with or without fee is hereby granted"),
    Template.of("lgpl-2.1", "licensed under the gnu lesser general public license version 2 1", "gnu lesser general public license", "version 2 1"),
    Template.of("lgpl-3", "licensed under the gnu lesser general public license version 3", "gnu lesser general public license", "version 3"),
    Template.of("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "permission is hereby granted free of charge to any person obtaining a copy", "to deal in the software without restriction"),
    Template.of("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "subject to the terms of the mozilla public license v 2 0"),
    Template.of("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software released into the public domain"),
)


class Words:
    """The words of a slice of texts: where each begins and ends in the bytes, and its text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        """``offsets``: where each text begins in ``data``, and the end of the last."""
        upper = (data >= 65) & (data <= 90)
        self.data = np.where(upper, data | 32, data)
        d = self.data
        inside = ((d >= 48) & (d <= 57)) | ((d >= 97) & (d <= 122)) | (d >= 128)
        first = np.zeros(len(d) + 1, bool)
        first[offsets[:-1]] = True
        first = first[: len(d)]
        before = np.concatenate([[False], inside[:-1]]) & ~first if len(d) else inside
        self.starts = np.flatnonzero(inside & ~before)
        after = np.concatenate([inside[1:] & ~first[1:], [False]]) if len(d) else inside
        self.ends = np.flatnonzero(inside & ~after) + 1
        #: The number of words before each text, and of all.
        self.bounds = np.searchsorted(self.starts, offsets)


class Index:
    """Ids of the templates' words, looked up by their first eight bytes and length, then their bytes."""

    def __init__(self, phrases: tuple[Template, ...] = PHRASES, notices: tuple[Template, ...] = NOTICES):
        self.phrases, self.notices = phrases, notices
        self.vocabulary = sorted({w for t in (*phrases, *notices) for w in t.words})
        self.id = {w: i for i, w in enumerate(self.vocabulary)}
        self.width = max(len(w.encode()) for w in self.vocabulary)
        keys = [self._key(w.encode()) for w in self.vocabulary]
        self._order = np.array(sorted(range(len(keys)), key=lambda i: keys[i]), np.int64)
        self._keys = np.array([keys[i] for i in self._order], np.uint64)
        self._bytes = np.zeros((len(keys), self.width), np.uint8)
        for i, w in enumerate(self.vocabulary):
            self._bytes[i, : len(w.encode())] = np.frombuffer(w.encode(), np.uint8)
        self._sizes = np.array([len(w.encode()) for w in self.vocabulary], np.int64)
        self.sequences = {t: np.array([self.id[w] for w in t.words], np.int32) for t in (*phrases, *notices)}

    @staticmethod
    def _key(w: bytes) -> int:
        """The first seven bytes and the length, in eight."""
        return int.from_bytes(w[:7].ljust(7, b"\0"), "little") | len(w) << 56

    def ids(self, words: Words) -> np.ndarray:
        """The id of every word, -1 for those that no template has."""
        sizes = words.ends - words.starts
        short = np.flatnonzero(sizes <= self.width)
        padded = np.concatenate([words.data, np.zeros(max(self.width, 8), np.uint8)])
        eight = np.ndarray(len(words.data) + 1, "<u8", padded.tobytes(), strides=(1,))  # the eight bytes from each place on
        first = np.uint64(2**56 - 1) >> (np.uint64(8) * (7 - np.minimum(sizes[short], 7)).astype(np.uint64))
        keys = (eight[words.starts[short]] & first) | sizes[short].astype(np.uint64) << np.uint64(56)
        out = np.full(len(sizes), -1, np.int32)
        left, right = np.searchsorted(self._keys, keys), np.searchsorted(self._keys, keys, side="right")
        for step in range(int((right - left).max(initial=0))):  # several words can have one key
            some = np.flatnonzero(left + step < right)
            which, at = self._order[left[some] + step], short[some]
            same = np.ones(len(some), bool)
            for k in range(7, self.width):
                same &= (self._sizes[which] <= k) | (padded[words.starts[at] + k] == self._bytes[which, k])
            out[at[same]] = which[same]
        return out


    def rarest_of_keys(self, ids: np.ndarray, bounds: np.ndarray, weight: np.ndarray) -> Callable[[Template], list[int]]:
        """A function that gives the texts of a slice that have the rarest word of each of a notice's key phrases: no others can have the notice."""
        rarest = {t: {int(max(self.sequences[t][at : at + n], key=lambda w: weight[w])) for at, n in t.keys} for t in self.notices}
        wanted = np.zeros(len(weight) + 1, bool)  # the last is for words that no template has
        wanted[sorted(set().union(*rarest.values()))] = True
        at = np.flatnonzero(wanted[ids])
        doc = np.searchsorted(bounds, at, side="right") - 1
        of: dict[int, set[int]] = {}
        for d, w in {*zip(doc.tolist(), ids[at].tolist(), strict=True)}:
            of.setdefault(w, set()).add(d)
        return lambda t: sorted(set.intersection(*(of.get(w, set()) for w in rarest[t])))


def _slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of stretches of a string column."""
    column = column.cast(pa.large_string())
    column = pa.concat_arrays([column]) if column.offset else column
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def document_frequencies(docs: DataFrame, index: Index, text: str = "text") -> dict[str, int]:
    """Of each of the index's words, the number of documents that have it; and under "" the number of all.  Tasks send a count per word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = np.zeros(len(index.vocabulary), np.int64), 0
        for b in batches:
            rows += b.num_rows
            for _, _, data, offsets in _slices(b.column(0)):
                words = Words(data, offsets)
                ids = index.ids(words)
                at = np.flatnonzero(ids >= 0)
                doc = np.searchsorted(words.bounds, at, side="right") - 1
                counts += np.bincount(np.unique(doc * len(counts) + ids[at]) % len(counts), minlength=len(counts))
        yield pa.RecordBatch.from_pydict({"word": [*index.vocabulary, ""], "n": [*counts.tolist(), rows]})

    own = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).mapInArrow(run, "word string, n long")
    return {r.word: r.n for r in own.groupBy("word").agg(F.sum("n").alias("n")).collect()}  # a row per word of the index


def weights(index: Index, frequencies: dict[str, int]) -> np.ndarray:
    total = frequencies.get("", 0) + 1
    return np.array([math.log(total / max(1, frequencies.get(w, 0))) + 1e-3 for w in index.vocabulary])


def _runs(ids: np.ndarray, sequence: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of ``starts`` have the whole sequence, within texts that end at ``ends``."""
    ok = (starts >= 0) & (starts + len(sequence) <= ends)
    for k, w in enumerate(sequence):
        at = np.flatnonzero(ok)
        ok[at] = ids[starts[at] + k] == w
    return ok


def places(ids: np.ndarray, bounds: np.ndarray, index: Index, weight: np.ndarray, phrase: Template) -> np.ndarray:
    """Where ``phrase`` stands, in words of the slice: its rarest word proposes starts, which are verified."""
    sequence = index.sequences[phrase]
    rarest = int(np.argmax(weight[sequence]))
    at = np.flatnonzero(ids == sequence[rarest])
    doc = np.searchsorted(bounds, at, side="right") - 1
    starts = at - rarest
    inside = starts >= bounds[doc]
    return starts[inside][_runs(ids, sequence, starts[inside], bounds[doc[inside] + 1])]


def alignments(ids: np.ndarray, bounds: np.ndarray, index: Index, weight: np.ndarray, notice: Template, rare: int = RARE, agree: int = AGREE) -> list[tuple[int, int, float]]:
    """(text, start, score) of the verified alignments of ``notice``; starts are words of the slice."""
    sequence = index.sequences[notice]
    own = np.unique(sequence)
    at = np.flatnonzero(np.isin(ids, own))
    if not len(at):
        return []
    doc = np.searchsorted(bounds, at, side="right") - 1
    # each text's rarest words of the template
    rank = np.zeros(len(weight), np.int64)
    rank[own[np.lexsort((own, -weight[own]))]] = np.arange(len(own))
    has = np.unique(doc * len(own) + rank[ids[at]])
    nth = np.arange(len(has)) - np.searchsorted(has, has // len(own) * len(own))
    chosen = has[nth < rare]
    keep = np.isin(doc * len(own) + rank[ids[at]], chosen)
    at, doc = at[keep], doc[keep]
    starts, owner, word = [], [], []
    for place, w in enumerate(sequence):
        hit = ids[at] == w
        starts.append(at[hit] - place)
        owner.append(doc[hit])
        word.append(np.full(hit.sum(), w))
    starts, owner, word = np.concatenate(starts), np.concatenate(owner), np.concatenate(word)
    order = np.lexsort((starts, owner))
    starts, owner, word = starts[order], owner[order], word[order]
    wanted = min(agree, len(own))
    # starts within SLACK after each start: at most so many rows further as words of the template and slack allow
    spread = owner * (ids.size + 4 * len(sequence) + 4 * SLACK) + starts
    far = np.searchsorted(spread, spread + SLACK, side="right")
    found = []
    last = (-1, -(10**9))
    for i in np.flatnonzero(far - np.arange(len(far)) >= wanted):
        if owner[i] == last[0] and starts[i] <= last[1] + SLACK or len(set(word[i : far[i]].tolist())) < wanted:
            continue
        lo, hi = bounds[owner[i]], bounds[owner[i] + 1]
        near = range(int(starts[i]) - SLACK, int(starts[i]) + 2 * SLACK + 1)
        verified = all(_runs(ids, sequence[k : k + n], c := np.array([s + k for s in near if s + k >= lo], np.int64), np.full(len(c), hi)).any() for k, n in notice.keys)
        if verified:
            score = in_place(ids, int(starts[i]), lo, hi, sequence, weight)
            found.append((int(owner[i]), int(starts[i]), score))
            last = (owner[i], starts[i])
    return found


def in_place(ids: np.ndarray, start: int, lo: int, hi: int, sequence: np.ndarray, weight: np.ndarray) -> float:
    """The share of the sequence's weight whose words stand in place, give or take SLACK words."""
    have = 0.0
    for k, w in enumerate(sequence):
        a, b = max(lo, start + k - SLACK), min(hi, start + k + 2 * SLACK + 1)
        have += weight[w] * bool((ids[a:b] == w).any())
    return min(1.0, have / float(weight[sequence].sum()))


RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
ARROW = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")], ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])


def scan_slice(data: np.ndarray, offsets: np.ndarray, index: Index, weight: np.ndarray) -> dict[str, list]:
    """The result's columns but doc_id for the texts of a slice."""
    words = Words(data, offsets)
    ids, bounds = index.ids(words), words.bounds
    count = len(offsets) - 1
    n_base, first, last = np.zeros(count, np.int64), [None] * count, [None] * count
    base, labels, score = [set() for _ in range(count)], [set() for _ in range(count)], [0.0] * count
    for phrase in index.phrases:
        at = places(ids, bounds, index, weight, phrase)
        for d, p in zip((np.searchsorted(bounds, at, side="right") - 1).tolist(), at.tolist(), strict=True):
            p -= int(bounds[d])
            n_base[d] += 1
            first[d] = p if first[d] is None else min(first[d], p)
            last[d] = p if last[d] is None else max(last[d], p)
            base[d].add(phrase.label)
            score[d] = 1.0
    has = index.rarest_of_keys(ids, bounds, weight)
    for notice in index.notices:
        for d in has(notice):
            lo, hi = int(bounds[d]), int(bounds[d + 1])
            for _, _, s in alignments(ids[lo:hi], np.array([0, hi - lo]), index, weight, notice):
                labels[d].add(notice.label)
                score[d] = max(score[d], s)
    join = lambda sets: [",".join(sorted(x)) for x in sets]
    return {"n_words": np.diff(bounds), "n_base": n_base, "first_word": first, "last_word": last, "base_labels": join(base), "labels": join(a | b for a, b in zip(base, labels, strict=True)), "score": score}


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", index: Index | None = None) -> DataFrame:
    """One row per row of ``docs``: RESULT.  Frequencies are counted over all documents first."""
    index = index or Index()
    weight = weights(index, document_frequencies(docs, index, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, data, offsets in _slices(b.column(1)):
                out = scan_slice(data, offsets, index, weight)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, end - first), *[pa.array(out[f.name], f.type) for f in list(ARROW)[1:]]], schema=ARROW)

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).mapInArrow(run, RESULT)
