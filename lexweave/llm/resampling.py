"""Importance resampling towards a target distribution (hashed n-gram features, Gumbel top-k draws)."""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import materialize, plain_words

#: Features whose bucket a task remembers.
_REMEMBERED = 300_000


class _Buckets(dict):
    """feature -> its bucket: crc32 modulo the number of buckets, worked out on first sight."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        self[feature] = n = zlib.crc32(feature) % self.buckets
        return n


def _features(body: bytes | None, known: _Buckets, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """The number of words and the buckets of all runs of 1 to n words, for each piece of a text."""
    last: list[bytes] = []
    for words in plain_words(body):
        out = [np.fromiter(map(known.__getitem__, words), np.int64, len(words))]
        joined = last + words
        for size in range(2, n + 1):
            runs = joined[max(0, len(last) - size + 1) :]
            runs = [b" ".join(runs[i : i + size]) for i in range(len(runs) - size + 1)]
            out.append(np.fromiter(map(known.__getitem__, runs), np.int64, len(runs)))
        last = joined[len(joined) - n + 1 :] if n > 1 else []
        yield len(words), np.concatenate(out)


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = 10_000, n: int = 1) -> np.ndarray:
    """How many features of all texts fall into each bucket: a vector a partition by np.bincount, merged as a tree."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = _Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for body in batch.column(0):
                for _, found in _features(body.as_py(), known, n):
                    total += np.bincount(found, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    vectors = texts.select(F.col(text_col).cast("string").cast("binary")).mapInArrow(count, "counts binary").rdd.map(lambda r: np.frombuffer(r[0], np.int64))
    return vectors.treeReduce(np.add) if vectors.getNumPartitions() else np.zeros(buckets, np.int64)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+B)/((s+1)(T+B)))) by bucket, of B buckets; in doubles."""
    b, s_all, t_all = float(len(source)), float(source.sum()), float(target.sum())
    ratio = [(t + 1) * (s_all + b) / ((s + 1) * (t_all + b)) for s, t in zip(source.astype(float).tolist(), target.astype(float).tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def _summed(gain: np.ndarray, rows: list[int], held: list[np.ndarray], n: int) -> np.ndarray:
    """The gains of the buckets that each of n rows has, summed by row."""
    at = np.repeat(np.array(rows, np.int64), [len(x) for x in held])
    return np.bincount(at, weights=gain[np.concatenate(held)] if held else [], minlength=n).astype(np.int64)


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, seed: int = 2024, least_words: int = 20, buckets: int = 10_000, n: int = 1,
    id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """A draw of percent in a hundred of docs without replacement, likelier the closer their features are to target's:
    id, n_features, weight, score and rank (1, 2, 3... by descending score; null where a row is not drawn), all long.

    Features are runs of 1 to n words, hashed to buckets. Two Arrow passes over docs: the first counts buckets (and one
    over target does), the second gathers the buckets' gains, which are broadcast (8 bytes a bucket), and sums them by
    document. The score adds a Gumbel variate that the id and seed alone decide, so the highest scores are a draw
    in proportion to exp(weight / 1000). Rows of least_words words or more can be drawn. Rows that may be among the
    drawn are found by an approximate quantile of the scores, with its error allowed for, and dealt to partitions
    by ranges of the score; a row's rank is its place in its partition and the sizes of those before it.

    Null texts count as empty: no feature, weight 0, never drawn. A null id takes part under an empty name and comes
    after others of equal score. Repeated rows each count and may each be drawn. Empty tables: no rows; with an empty
    target, or one whose texts are empty, gains prefer rare buckets. Columns besides those named are not read."""
    gain = docs.sparkSession.sparkContext.broadcast(gains(bucket_counts(docs, text_col, buckets, n), bucket_counts(target, target_col, buckets, n)))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Buckets(buckets)
        for batch in batches:
            words, sizes, weights = (np.zeros(len(batch), np.int64) for _ in range(3))
            rows, held, waiting = [], [], 0
            for k, body in enumerate(batch.column(1)):
                for size, found in _features(body.as_py(), known, n):
                    words[k] += size
                    sizes[k] += len(found)
                    rows.append(k)
                    held.append(found)
                    waiting += len(found)
                    if waiting > 1 << 20:
                        weights += _summed(gain.value, rows, held, len(batch))
                        rows, held, waiting = [], [], 0
            weights += _summed(gain.value, rows, held, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (words, sizes, weights))], ["i", "words", "n_features", "weight"])

    uniform = (F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("i").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    read = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").cast("binary").alias("t"))
    weighed = read.mapInArrow(weigh, "i long, words long, n_features long, weight long")
    scored = materialize(
        weighed.select(F.col("i"), "n_features", "weight", (F.col("weight") + F.floor(-1000 * F.log(-F.log(uniform)))).alias("score"), (F.col("words") >= least_words).alias("may")), "scored"
    )
    eligible, error = scored.where("may"), 1000
    total, low = eligible.agg(F.count("*"), F.percentile_approx("score", max(0.0, 1 - percent / 100 - 2 / error), error)).first()
    drawn = total * percent // 100
    may = F.col("may") & (F.col("score") >= F.lit(low or 0))
    found = scored.where(may)
    if (rows := found.count()) < drawn:
        may, rows = F.col("may"), total
        found = eligible
    # Rows of equal scores and ids are interchangeable: a number each lets ranges split them.
    order = [F.desc("score"), F.asc_nulls_last("i"), F.asc("row")]
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, rows // 1_000_000)
    ranged = found.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranges = materialize(ranged.withColumn("at", F.monotonically_increasing_id()).drop("row", "may"), "ranges")
    part, place = F.shiftright("at", 33).cast("int"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = dict(ranges.groupBy(part).count().collect())
    before = list(itertools.accumulate((sizes.get(p, 0) for p in range(max(sizes, default=0))), initial=0))
    ranks = ranges.withColumn("rank", place + 1 + F.get(F.lit(before).cast("array<bigint>"), part))
    ranks = ranks.select("i", "n_features", "weight", "score", F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    rest = scored.where(~may).select("i", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return rest.unionByName(ranks).withColumnRenamed("i", id_col)
