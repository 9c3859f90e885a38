"""License scans: phrases, and an exact set-similarity join of text blocks with license templates."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import plain_words

#: Phrases whose words stand consecutively, and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Notices of public licenses, and their labels.
TEMPLATES = (
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("agpl", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("gfdl", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation"),
    ("apache", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'),
    ("mit", "Released under the MIT License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("boost", "Distributed under the Boost Software License, Version 1.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
)

#: Templates' words in all, at most; blocks compared at a time.
MOST_WORDS, _BLOCKS = 1_000_000, 4096
_NONE = np.iinfo(np.int32).max
FOUND = "array<struct<label: string, template: int, start: bigint, words: bigint, overlap: int, containment: double>>"


class Template(NamedTuple):
    label: str
    words: frozenset  # distinct, as bytes
    block: int  # words of the blocks that it is compared with
    least: int  # shared words that make a match


def templates(texts=TEMPLATES, threshold: float = 0.8, whole: int = 12) -> list[Template]:
    """Labelled texts as word sets. A block has a power of two of words, 32 or more, of which the text's words are half
    at most: blocks begin at every half, so a text that stands somewhere lies within one of them. Texts of up to whole
    different words have to be contained whole, longer ones to threshold."""
    out = []
    for label, text in texts:
        words = list(itertools.chain.from_iterable(plain_words(text.encode())))
        k = len(set(words))
        if words:
            out.append(Template(label, frozenset(words), max(32, 1 << (2 * len(words) - 1).bit_length()), k if k <= whole else math.ceil(round(threshold * k, 9))))
    if sum(len(t.words) for t in out) > MOST_WORDS:
        raise ValueError(f"templates of more than {MOST_WORDS} words")
    return out


def _known(words) -> dict:
    """word -> its number, -1 for words that are not given."""

    class Known(dict):
        def __missing__(self, word):
            return -1

    return Known((w, k) for k, w in enumerate(words))


def _numbers(body: bytes | None, known: dict) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int32), *(np.fromiter(map(known.__getitem__, words), np.int32, len(words)) for words in plain_words(body))])


def global_order(docs: DataFrame, words: list[bytes], text_col: str = "text") -> list[bytes]:
    """words, the rarest in all of docs first. Tasks count, their counts are added up; words come back, no text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = _known(words), np.zeros(len(words) + 1, np.int64)
        for batch in batches:
            for body in batch.column(0):
                total += np.bincount(_numbers(body.as_py(), known) + 1, minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(words))), pa.array(total[1:])], ["word", "n"])

    counts = docs.select(F.col(text_col).cast("string").cast("binary")).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n")).collect()
    n = dict(counts)
    return [w for _, w in sorted((n.get(k, 0), w) for k, w in enumerate(words))]


class Matcher:
    """Templates under a global order of their words: of each, the words of its prefix, one of which any match holds."""

    def __init__(self, made: list[Template], order: list[bytes]):
        self.templates, self.known = made, _known(order)
        self.compared = 0
        self.scales = {}
        for size in sorted({t.block for t in made}):
            lists: list[list] = [[] for _ in order]
            for k, t in enumerate(made):
                if t.block == size:
                    for i, rank in enumerate(sorted(self.known[w] for w in t.words)[: len(t.words) - t.least + 1]):
                        lists[rank].append((k, i, rank))
            flat = np.array(list(itertools.chain.from_iterable(lists)), np.int64).reshape(-1, 3)
            sizes = np.array([len(x) for x in lists], np.int64)
            self.scales[size] = np.cumsum(sizes) - sizes, sizes, flat
        self.member = np.zeros((len(made), len(order) + 1), bool)  # the last for words of no template
        for k, t in enumerate(made):
            self.member[k, [self.known[w] for w in t.words]] = True
        self.least = np.array([t.least for t in made], np.int64)
        self.length = np.array([len(t.words) for t in made], np.int64)

    def candidates(self, ids: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        """Prefix filter: rows (text, block, template, i, rank): the template's i-th word is its first in the block, and of
        its prefix. ids: numbers of the words of all texts, that begin at starts."""
        first, sizes, flat = self.scales[size]
        at = np.flatnonzero(ids >= 0)
        at = at[sizes[ids[at]] > 0]
        text = np.searchsorted(starts, at, side="right") - 1
        block = (at - starts[text]) // (size // 2)
        rank = ids[at]
        late = block > 0
        text, block, rank = np.concatenate([text, text[late]]), np.concatenate([block, block[late] - 1]), np.concatenate([rank, rank[late]])
        n = sizes[rank]
        which = np.repeat(first[rank] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        rows = np.column_stack([np.repeat(text, n), np.repeat(block, n), flat[which]])
        rows = rows[np.lexsort(rows.T[::-1])]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
        return rows[new]

    def matches(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Rows (text, start, words, template, overlap) of all blocks and templates that share as many words as they need."""
        out = [np.zeros((0, 5), np.int64)]
        for size in self.scales:
            rows = self.candidates(ids, starts, size)
            for a in range(0, len(rows), _BLOCKS):
                text, block, k, i, rank = rows[a : a + _BLOCKS].T
                begin = starts[text] + block * (size // 2)
                end = np.minimum(begin + size, ends[text])
                at = begin[:, None] + np.arange(size)
                words = np.where(at < end[:, None], ids[np.minimum(at, len(ids) - 1)], -1)
                words = np.sort(np.where(words < 0, _NONE, words), axis=1)
                once = words < _NONE
                once[:, 1:] &= words[:, 1:] != words[:, :-1]
                length = once.sum(axis=1)
                j = (once & (words < rank[:, None])).sum(axis=1)
                # Length filter, and positional filter: what follows the first shared word in the global order.
                far = (length >= self.least[k]) & (np.minimum(self.length[k] - i, length - j) >= self.least[k])
                text, begin, end, k, words, once = text[far], begin[far], end[far], k[far], words[far], once[far]
                self.compared += len(k)
                overlap = (self.member[k[:, None], np.minimum(words, self.member.shape[1] - 1)] & once).sum(axis=1)
                hit = overlap >= self.least[k]
                out.append(np.column_stack([text, begin - starts[text], end - begin, k, overlap])[hit])
        return np.concatenate(out)


def _places(ids: np.ndarray, ends_at: np.ndarray, phrase: list[int]) -> np.ndarray:
    """Where the words of phrase follow one another; ends_at: where each word's text ends."""
    n = max(0, len(ids) - len(phrase) + 1)
    same = np.ones(n, bool)
    for k, w in enumerate(phrase):
        same &= ids[k : k + n] == w
    at = np.flatnonzero(same)
    return at[at + len(phrase) <= ends_at[at]]


def scan(docs: DataFrame, made: list[Template] | None = None, phrases=PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs: id, n_words; n_base, first_word, last_word and base_labels (array) of phrases that stand in
    the text; found (array of label, template, start, words, overlap, containment): every block and template that
    match.

    An exact set-similarity join. Words are ordered by their frequency in all texts, the rarest first. Blocks and templates meet
    on words of the templates' prefixes, pairs that are too short, or whose first shared word leaves too few behind it, fall
    away, and the others' words are compared. Words of no template can be in no overlap and have no place in the order.
    Templates are bounded (1,000,000 words) and go to every task; a text is scanned where it is read, so nothing is
    shuffled and a frequent or repeated text weighs no more than its length. Of the templates that match one block,
    only those of the largest containment are found there.

    Null texts count as empty: no words, no labels. Repeated rows and null ids stay as they are. Empty table: no rows.
    Columns besides the two named are not read."""
    made = templates() if made is None else made
    named = [(list(itertools.chain.from_iterable(plain_words(p.encode()))), label) for p, label in phrases]
    order = global_order(docs, sorted({w for t in made for w in t.words} | {w for p, _ in named for w in p}), text_col)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(made, order)
        wanted = [([matcher.known[w] for w in p], label) for p, label in named]
        for batch in batches:
            texts = [_numbers(body.as_py(), matcher.known) for body in batch.column(1)]
            sizes = np.array([len(x) for x in texts], np.int64)
            ids, ends = np.concatenate([np.zeros(0, np.int32), *texts]), np.cumsum(sizes)
            starts = ends - sizes
            of = np.repeat(np.arange(len(sizes)), sizes)
            places, labels = [[] for _ in sizes], [set() for _ in sizes]
            for p, label in wanted:
                for at in _places(ids, ends[of], p).tolist():
                    places[of[at]].append(at - int(starts[of[at]]))
                    labels[of[at]].add(label)
            found: list[list] = [[] for _ in sizes]
            for text, hits in itertools.groupby(sorted(matcher.matches(ids, starts, ends).tolist()), lambda r: r[0]):
                for _, block in itertools.groupby(hits, lambda r: r[1:3]):
                    block = [(r, r[4] / len(made[r[3]].words)) for r in block]
                    best = max(c for _, c in block)
                    found[text] += [{"label": made[k].label, "template": k, "start": start, "words": n, "overlap": o, "containment": c} for (_, start, n, k, o), c in block if c == best]
            kinds = pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("start", pa.int64()), ("words", pa.int64()), ("overlap", pa.int32()), ("containment", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(sizes), pa.array([len(x) for x in places], pa.int64()), pa.array([min(x, default=None) for x in places], pa.int64()),
                    pa.array([max(x, default=None) for x in places], pa.int64()), pa.array([sorted(x) for x in labels], pa.list_(pa.string())), pa.array(found, kinds),
                ],
                ["i", "n_words", "n_base", "first_word", "last_word", "base_labels", "found"],
            )

    read = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").cast("binary").alias("t"))
    kind = read.schema["i"].dataType.simpleString()
    schema = f"i {kind}, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, found {FOUND}"
    return read.mapInArrow(scanned, schema).withColumnRenamed("i", id_col)


def labels(base: str = "base_labels", found: str = "found") -> Column:
    """The labels of phrases and of templates: distinct, sorted, joined by commas."""
    return F.array_join(F.array_sort(F.array_distinct(F.concat(F.col(base), F.col(found)["label"]))), ",")


def score(n_base: str = "n_base", found: str = "found") -> Column:
    """1 where a phrase stands, else the largest containment of a template; 0 without either."""
    return F.when(F.col(n_base) > 0, 1.0).otherwise(F.coalesce(F.array_max(F.col(found)["containment"]), F.lit(0.0)))
