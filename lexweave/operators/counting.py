"""Counts of word sequences, added up within batches of texts before they are shuffled.

Nearly every long n-gram is new to the task that meets it, so a table by n-gram in that task outgrows its memory and is sorted to
disk. Here the words of a batch get numbers, an n-gram is one integer, and sorted integers are counted; only these sums meet by a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that are counted at a time (a longer text by itself), and rows that are handed on at a time.
WORDS, ROWS = 1 << 21, 1 << 17


def slices(lists: pa.ListArray, most: int | None = None) -> Iterator[pa.ListArray]:
    """Runs of whole lists of at most so many elements; a longer list stands alone."""
    ends, most = np.cumsum(np.diff(lists.offsets.to_numpy())), most or WORDS
    a = 0
    while a < len(lists):
        before = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield lists.slice(a, b - a)
        a = b


def numbered_words(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words; each place's word as a number; and how many words its text has from there on."""
    found = lists.flatten().dictionary_encode()
    size = np.diff(lists.offsets.to_numpy())
    return found.dictionary, found.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.cumsum(size), size) - np.arange(size.sum())


def word_at(numbers: np.ndarray, left: np.ndarray, k: int, none: int) -> np.ndarray:
    """The number of the k-th word behind each place, none beyond its text."""
    out = np.full(len(numbers), none, np.int64)
    out[: len(numbers) - k] = numbers[k:]
    out[left <= k] = none
    return out


def _counted(texts: DataFrame, words: Column, add: Callable[[pa.ListArray], list[pa.Array]], kinds: str, by: list[str], value: str, dealt: int | None = None) -> DataFrame:
    """by and the sum of value of what add makes of runs of texts. Sums meet by a shuffle, without another try to add up before it; it
    deals them by the first of by (dealt: how many)."""
    columns = [*by, value]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lists in slices(batch.column(0).drop_null()):
                rows = pa.RecordBatch.from_arrays(add(lists), columns)
                for a in range(0, len(rows), ROWS):
                    yield rows.slice(a, ROWS)

    return texts.select(words.alias("_w")).mapInArrow(run, kinds).repartition(*by[:dealt]).groupBy(*by).agg(F.sum(value).alias(value))


def ngram_counts(texts: DataFrame, words: Column, n: int, ends: bool = False, dealt: int | None = None) -> DataFrame:
    """w1 .. wn, freq of the texts' n-grams (n up to 3); with ends also of the shorter ones at the end of a text, null beyond it. Null texts
    have none; words are not null. dealt: by how many of its words, from the first, an n-gram is dealt to tasks."""
    by = [f"w{k}" for k in range(1, n + 1)]

    def add(lists: pa.ListArray) -> list[pa.Array]:
        names, numbers, left = numbered_words(lists)
        none = len(names)
        if (none + 1) ** n >= 1 << 63:
            raise ValueError("too many distinct words in one text")
        key = numbers
        for k in range(1, n):
            key = key * (none + 1) + word_at(numbers, left, k, none)
        key, count = np.unique(key if ends else key[left >= n], return_counts=True)
        parts = []
        for _ in range(n):
            key, part = np.divmod(key, none + 1)
            parts.insert(0, names.take(pa.array(part, mask=part == none)))
        return [*parts, pa.array(count.astype(np.int64))]

    return _counted(texts, words, add, ", ".join(f"{w} string" for w in by) + ", freq long", by, "freq", dealt)


def pair_weights(texts: DataFrame, words: Column, window: int = 5) -> DataFrame:
    """word, context, weight: 1 / distance summed over the pairs of words at most window apart, each pair once, the smaller word first."""

    def add(lists: pa.ListArray) -> list[pa.Array]:
        names, numbers, left = numbered_words(lists)
        order = np.argsort(np.array([x.encode() for x in names.to_pylist()], dtype=object), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        names, numbers, none = names.take(pa.array(order)), place[numbers], len(order)
        found = []
        for k in range(1, window + 1):
            a, b = numbers[left > k], word_at(numbers, left, k, none)[left > k]
            found.append((np.minimum(a, b) * none + np.maximum(a, b)) * (window + 1) + k)
        # A pair at a distance is counted, then a pair.
        key, count = np.unique(np.concatenate(found), return_counts=True)
        pair, first = np.unique(key // (window + 1), return_index=True)
        weight = np.add.reduceat(count / (key % (window + 1)), first) if len(first) else np.zeros(0)
        return [names.take(pa.array(pair // max(1, none))), names.take(pa.array(pair % max(1, none))), pa.array(weight)]

    return _counted(texts, words, add, "word string, context string, weight double", ["word", "context"], "weight")
