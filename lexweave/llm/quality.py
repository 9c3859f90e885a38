"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import Words, mix

_RUN = re.compile(r"(.)\1+", re.S)
_SAME, _START = np.uint64(0x5A3E), np.uint64(0xB05)
#: Words of one text block held at a time, and distinct words remembered between blocks.
_BLOCK_CHARS, _REMEMBERED = 2_000_000, 300_000
#: Words of no evidence that every text is taken to have besides its own, so that a few odd words decide nothing.
_SMALL = 8


def _shape(word: str) -> str:
    """Letters to X or x, digits to 9, other characters as they are; a run of one class is marked by +."""
    return _RUN.sub(r"\1+", "".join("X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in word))


class Features:
    """Hashed n-grams of whole texts: words (1, 2) and word shapes (1, 2, 3). A word that repeats the word before it
    counts as one fixed word, so that a repeated word is a feature whatever the word."""

    PER_WORD = 5

    def __init__(self, bits: int):
        self.mask, self.words = np.uint64((1 << bits) - 1), Words()
        self.hash, self.shape, self.known = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.uint64), 0

    def _learn(self) -> None:
        n = len(self.words)
        while n > len(self.hash):
            self.hash, self.shape = np.concatenate([self.hash, self.hash]), np.concatenate([self.shape, self.shape])
        new = list(self.words)[self.known :] if self.known < n else []
        self.hash[self.known : n] = [xxhash.xxh64_intdigest(w) for w in new]
        self.shape[self.known : n] = [xxhash.xxh64_intdigest(_shape(w), 1) for w in new]
        self.known = n

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """An array of PER_WORD rows of feature numbers, a column a word; and the number of words of each text."""
        if len(self.words) > _REMEMBERED:
            self.words, self.known = Words(), 0
        split = [t.split() if t else [] for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        n = int(sizes.sum())
        at = np.fromiter(map(self.words.__getitem__, chain.from_iterable(split)), np.int64, n)
        self._learn()
        first = np.zeros(n + 1, bool)
        first[np.concatenate([[0], np.cumsum(sizes)])] = True
        first = first[:n]
        same = np.zeros(n, bool)
        same[1:] = (at[1:] == at[:-1]) & ~first[1:]
        rows = []
        for values, orders, salt in ((self.hash[at], 2, 1), (self.shape[at], 3, 7)):
            values[same] = _SAME
            gram, back, start = values, values, first
            for order in range(orders):
                if order:
                    back = np.concatenate([[_START], back[:-1]])[:n]
                    back[start] = _START
                    gram = mix(gram) + back
                rows.append((mix(gram + np.uint64(salt + order)) & self.mask).astype(np.int64))
        return np.stack(rows), sizes


def _blocks(texts: pa.Array) -> Iterator[list[str | None]]:
    block, size = [], 0
    for x in texts:
        block.append(t := x.as_py())
        size += len(t or "")
        if size >= _BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def _examples(bits: int):
    """Rows a, b, y, t of texts to a, b, y, at, n, size: the distinct features of each text, how often each occurs, and the
    number that makes shares of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Features(bits)
        for whole in batches:
            for lo in range(0, len(whole), 256):
                batch, out = whole.slice(lo, 256), ([], [], [])
                for t in batch.column(3):
                    f, _ = made.of([t.as_py()])
                    at, n = np.unique(f, return_counts=True)
                    for column, x in zip(out, (at.astype(np.int32).tobytes(), n.astype(np.int32).tobytes(), float(f.size + Features.PER_WORD * _SMALL)), strict=True):
                        column.append(x)
                kinds = (pa.binary(), pa.binary(), pa.float64())
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *map(pa.array, out, kinds)], ["a", "b", "y", "at", "n", "size"])

    return run


def _train(examples: list[tuple[np.ndarray, np.ndarray, float]], labels: np.ndarray, bits: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """FTRL-proximal (McMahan et al. 2013) on feature shares; the last weight is the bias, which
    stays the log odds of the labels: a text without evidence is as good as the average."""
    size = 1 << bits
    z, root = np.zeros(size), np.zeros(size)  # root: of the sum of squared gradients
    bias = np.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5))
    for _ in range(epochs):
        for (at, n, total), y in zip(examples, labels, strict=True):
            x = n / total
            zi, was = z[at], root[at]
            wi = (np.minimum(np.maximum(zi, -l1), l1) - zi) / (was / alpha + (beta / alpha + l2))
            g = (1 / (1 + math.exp(-min(max(float(wi @ x + bias), -35.0), 35.0))) - y) * x
            now = np.sqrt(was * was + g * g)
            z[at] = zi + g - (now - was) * (wi / alpha)
            root[at] = now
    w = (np.clip(z, -l1, l1) - z) / (root / alpha + (beta / alpha + l2))
    return np.append(w, bias).astype(np.float32)


def fit(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
    max_rows: int = 8192, bits: int = 18, epochs: int = 6, alpha: float = 1.0, beta: float = 0.1, l1: float = 1e-4, l2: float = 1e-3,
) -> np.ndarray:
    """The weights (2 ** bits of n-grams, and the bias) learned from labelled texts.

    Learns from at most max_rows labelled texts, those with the smallest hashes of their ids. Their features are made where
    they are read; the updates follow one another in one task of an executor; only the weights come to the driver. Null ids, labels and texts teach nothing; of contradicting labels of
    one id the smaller holds. No labelled text at all: zero weights, so every score is 0.5."""
    named = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("i")).agg(F.min(label_col).cast("double").alias("y"))
    named = named.orderBy(F.xxhash64("i"), "i").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t is not null")
    labelled = texts.join(F.broadcast(named), "i").select(F.xxhash64("i").alias("a"), F.crc32("t").alias("b"), "y", "t")
    bounded = labelled.mapInArrow(_examples(bits), "a long, b long, y double, at binary, n binary, size double").orderBy("a", "b").limit(max_rows).select("y", "at", "n", "size")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, examples = [], []
        for b in batches:
            y += b.column(0).to_pylist()
            examples += [(np.frombuffer(at.as_py(), np.int32), np.frombuffer(n.as_py(), np.int32), size) for at, n, size in zip(b.column(1), b.column(2), b.column(3).to_pylist(), strict=True)]
        if examples:
            yield pa.RecordBatch.from_arrays([pa.array([_train(examples, np.array(y), bits, epochs, alpha, beta, l1, l2).tobytes()], pa.binary())], ["w"])

    found = bounded.mapInArrow(train, "w binary").first()
    return np.frombuffer(found[0], np.float32) if found else np.zeros((1 << bits) + 1, np.float32)


def score(text: Column, weights: np.ndarray) -> Column:
    """The probability of label 1 as a double: the sparse dot product of the whole text's n-gram shares and the
    weights, through the logistic function. Null and empty texts have no n-gram: the bias alone decides."""
    bits = (len(weights) - 1).bit_length() - 1

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        made = Features(bits)
        for texts in batches:
            out = []
            for block in _blocks(texts):
                f, sizes = made.of(block)
                each = np.zeros(f.shape[1])
                for row in f:
                    each += weights[row]
                total = np.concatenate([[0.0], np.cumsum(each)])
                ends = np.cumsum(sizes)
                out.append((total[ends] - total[ends - sizes]) / (Features.PER_WORD * (sizes + _SMALL)) + weights[-1])
            z = np.concatenate(out) if out else np.zeros(0)
            yield pa.array(1 / (1 + np.exp(-np.clip(z, -35, 35))))

    return scored(text)
