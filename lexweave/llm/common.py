"""Helpers that the operators of this package share: scratch tables, stable hashes, connected components."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.sources.scratch import file_system, scratch


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts the lineage and survives a lost executor."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a table of materialize() that nothing reads any more."""
    made, fs = file_system(df.sparkSession, df._scratch)
    fs.delete(made, True)


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no such column (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def unbound(key: str):
    """key (long) under an expression that hides its partitioning, so that a join with an aggregate gets an exchange
    on either side and adaptive execution may split a hot key of the other side."""
    return F.col(key).bitwiseXOR(F.lit(0).cast("long")).alias(key)


def components(edges: DataFrame) -> DataFrame:
    """Connected components by alternating large-star and small-star steps (Kiveris et al. 2014).

    edges: longs u, v without nulls; direction, repeats and loops do not matter. Returns node, component (the smallest
    node that can be reached); nodes without an edge to another are absent. Each round is a written table; nothing is
    collected but a count and a checksum."""
    cur = materialize(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges"
    )
    mark = None
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(unbound("u"), F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low.select(unbound("u"), "m"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
        ).distinct()
        old, cur = cur, materialize(small, "edges")
        discard(old)
        now = cur.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if now == mark:
            break
        mark = now
    star = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return star.unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(a: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the splitmix64 finaliser)."""
    a = (a ^ (a >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    a = (a ^ (a >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return a ^ (a >> np.uint64(31))


class Words(dict):
    """word -> local index, given out on first sight: list(map(words.__getitem__, tokens))."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


class WordHashes:
    """64-bit hashes of words, each distinct word being hashed once; forgets them all beyond a number of words."""

    def __init__(self, remembered: int = 300_000):
        self.words, self.remembered, self.hash = Words(), remembered, np.zeros(1 << 12, np.uint64)

    def of(self, words: list) -> np.ndarray:
        if len(self.words) > self.remembered:
            self.words = Words()
        known = len(self.words)
        at = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        while len(self.words) > len(self.hash):
            self.hash = np.concatenate([self.hash, self.hash])
        if len(self.words) > known:
            new = itertools.islice(reversed(self.words), len(self.words) - known)
            self.hash[known : len(self.words)] = np.fromiter(map(xxhash.xxh64_intdigest, new), np.uint64)[::-1]
        return self.hash[at]


#: A-Z to a-z; every ASCII character but digits and letters to a space.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def plain_words(body: bytes | None, piece: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text, A-Z in lower case: runs of digits, letters and characters beyond ASCII; in lists of
    about piece bytes each, cut between words."""
    body, at = (body or b"").translate(_PLAIN), 0
    while at < len(body):
        end = body.find(b" ", at + piece) if at + piece < len(body) else -1
        end = len(body) if end < 0 else end
        yield body[at:end].split()
        at = end
