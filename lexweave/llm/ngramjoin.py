"""Similarity join of texts on word n-gram sets: MinHash banding finds candidates, whole sets decide."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import WordHashes, components, materialize, mix, unbound

#: Texts of candidate groups up to this number of rows (of five numbers each) are picked by a broadcast, else a shuffle.
BROADCAST_ROWS = 200_000
_BLOCK_CHARS = 2_000_000


def bands_for(threshold: float, recall: float, most: int = 192) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which a pair at the threshold shares a band with that probability, at
    no more than most hash functions."""
    best = None
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows > most:
            break
        best = bands, rows
    if best is None:
        raise ValueError("no banding reaches this recall with so few hash functions")
    return best


def shingle_sets(texts: list[str | None], hashes: WordHashes, n: int) -> list[np.ndarray]:
    """The set of hashed n-grams of each text's lower-cased words, sorted. A text of 1 to n - 1 words has them all as
    one n-gram; a blank or null one has none."""
    split = [t.lower().split() if t else [] for t in texts]
    h = hashes.of([w for ws in split for w in ws])
    gram = h
    for k in range(1, n):
        gram = mix(gram[:-1]) + h[k:] if len(gram) > 1 else gram[:0]
    out, at = [], 0
    for ws in split:
        if len(ws) >= n:
            out.append(np.unique(gram[at : at + len(ws) - n + 1]))
        elif ws:
            one = h[at : at + 1]
            for k in range(1, len(ws)):
                one = mix(one + np.uint64(len(ws))) + h[at + k : at + k + 1]
            out.append(one)
        else:
            out.append(h[:0])
        at += len(ws)
    return out


def _signatures(docs: DataFrame, id_kind: str, n: int, bands: int, rows: int, id_bits: int) -> DataFrame:
    """i, tf (given), node and more (two fingerprints of the n-gram set; null if it is empty), n (n-grams), bands (array
    of long) of every row."""
    factors = mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sizes, keys, prints = [], [], []
            for lo, hi in _slices(batch.column(2)):
                for s in shingle_sets(batch.column(2).slice(lo, hi - lo).to_pylist(), hashes, n):
                    sizes.append(len(s))
                    if not len(s):
                        keys.append(None)
                        prints.append((None, None))
                        continue
                    one, two = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64).tolist()
                    prints.append((one >> (64 - id_bits), two))
                    low = np.full(bands * rows, np.uint64(2**64 - 1))
                    for k in range(0, len(s), 1024):
                        np.minimum(low, (s[k : k + 1024] * factors[:, None]).min(axis=1), out=low)
                    low, key = low.reshape(bands, rows), np.arange(bands, dtype=np.uint64)
                    for k in range(rows):
                        key = mix(key) + low[:, k]
                    keys.append(mix(key).view(np.int64))
            node, more = (pa.array(x, pa.int64()) for x in zip(*prints, strict=True)) if prints else [pa.array([], pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), node, more, pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["i", "tf", "node", "more", "n", "bands"])

    return docs.mapInArrow(run, f"i {id_kind}, tf long, node long, more long, n long, bands array<long>")


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about _BLOCK_CHARS characters."""
    lo = size = 0
    for k, x in enumerate(texts):
        size += len(x.as_py() or "")
        if size >= _BLOCK_CHARS:
            yield lo, k + 1
            lo, size = k + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def linked(sets: list[np.ndarray], left: int, threshold: float) -> np.ndarray:
    """Which sets are at least so similar by Jaccard, as a symmetric matrix without its diagonal; with left > 0 only
    pairs of one of the first left sets with one of the others."""
    m = len(sets)
    size = np.array([len(s) for s in sets], np.float64)
    owner = np.repeat(np.arange(m), size.astype(np.int64))
    _, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.where(n > 1, np.cumsum(n > 1) - 1, -1)[at]
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((m, m), np.float32)
    width = max(1, 4_000_000 // m)
    for lo in range(0, int((n > 1).sum()), width):
        a, b = np.searchsorted(column, [lo, lo + width])
        part = np.zeros((m, min(width, int((n > 1).sum()) - lo)), np.float32)
        part[owner[a:b], column[a:b] - lo] = 1
        if left:
            both[:left, left:] += part[:left] @ part[left:].T
        else:
            both += part @ part.T
    if left:
        both = both + both.T
    ok = both >= threshold * (size[:, None] + size - both) - 1e-6
    np.fill_diagonal(ok, False)
    return ok & (both > 0)


def lowest(ok: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links the smallest row number that links lead to."""
    label = np.arange(len(ok))
    while True:
        near = np.where(ok, label, len(ok)).min(axis=1, initial=len(ok))
        new = np.minimum(label, near)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _pack_sets(nodes: list[int], copies: list[int], sets: list[np.ndarray]) -> bytes:
    """A block of nodes: their distinct n-grams once, and each set as places among these. Sets that are nearly alike have
    long runs in common, which compress to little."""
    unique, at = np.unique(np.concatenate(sets), return_inverse=True)
    head = np.array([len(nodes), len(unique), *nodes, *copies, *map(len, sets)], np.int64)
    return zstandard.compress(head.tobytes() + unique.tobytes() + at.astype(np.uint32).tobytes(), 3)


def _unpack_sets(raw: bytes) -> tuple[list[int], list[int], list[np.ndarray]]:
    raw = zstandard.decompress(raw)
    m, n = np.frombuffer(raw, np.int64, 2).tolist()
    nodes, copies, sizes = np.frombuffer(raw, np.int64, 3 * m, 16).reshape(3, m)
    unique = np.frombuffer(raw, np.uint64, n, 16 + 24 * m)
    at = np.frombuffer(raw, np.uint32, int(sizes.sum()), 16 + 24 * m + 8 * n)
    return nodes.tolist(), copies.tolist(), np.split(unique[at], np.cumsum(sizes)[:-1])


_DECIDED = "node long, label long, links long"


def _decided(nodes: list[int], copies: list[int], sets: list[np.ndarray], left: int, threshold: float) -> list[dict]:
    """Rows (node, label, links) of the nodes of a piece that have a link in it; left as in linked()."""
    ok = linked(sets, left, threshold)
    links = ok @ np.array(copies, np.int64)
    order = np.argsort(nodes, kind="stable")
    label = np.empty(len(nodes), np.int64)
    label[order] = order[lowest(ok[np.ix_(order, order)])]
    return [{"node": nodes[k], "label": nodes[label[k]], "links": int(links[k])} for k in np.flatnonzero(links).tolist()]


def ngram_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.9995, block: int = 512,
    block_grams: int = 4_000_000, id_bits: int = 64,
) -> DataFrame:
    """Links between texts whose sets of word n-grams have a Jaccard similarity of threshold or more.

    Returns a row for each row of docs: the id, class_id (the smallest id that links lead to, its own included),
    n_links (other rows linked directly, copies counted) and n_shingles. Words are lower-cased and end at white space.

    Rows with equal n-gram sets are one node with a count. Nodes that share a MinHash band (bands_for() gives a pair at
    the threshold the stated recall) are candidates; a band's nodes are tied to its smallest only, so a band of any size
    makes as many rows as it has nodes. Connected candidates form groups. Of a group each node's set is made from one
    text and shipped once; all pairs are decided on whole sets, in one task where the group has at most block nodes and
    about block_grams n-grams. A larger group is cut into blocks; a block becomes one compressed row, in which an n-gram
    that many of its sets have is kept once, and each pair of blocks is a piece of work of bounded memory. So no text or
    set of a large group is shipped again, only blocks are, and pieces return a row a node, never a row a pair.

    Null and blank texts have no n-gram and link with nothing, not even each other; texts of fewer than n words link
    with equal word sequences. A null id is never a class_id while the class has another. Repeated rows are copies.
    Ties do not occur (class_id is a minimum). Empty table: no rows. Columns besides the two named are not read.
    N-grams are 64-bit hashes. Nodes are told apart by two fingerprints: where sets with one first fingerprint (of
    id_bits bits) have different second ones, all of these get other numbers."""
    kind = docs.schema[id_col].dataType.simpleString()
    bands, rows = bands_for(threshold, recall)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("i"), F.xxhash64(text).alias("tf"), text.alias("t"))
    signed = materialize(_signatures(base, kind, n, bands, rows, id_bits), "signatures")

    def counted(signed: DataFrame) -> DataFrame:
        by = signed.where("n > 0").groupBy("node")
        found = by.agg(F.min("i").alias("low"), F.count("*").alias("copies"), F.min("n").alias("n"), F.min(F.struct("tf", "i")).alias("one"), F.min("more").alias("least"), F.max("more").alias("most"))
        return materialize(found, "nodes")

    nodes = counted(signed)
    clash = nodes.where("least <> most").select("node", F.lit(True).alias("clash"))
    if not clash.isEmpty():
        signed = materialize(signed.join(clash, "node", "left").withColumn("node", F.when(F.col("clash"), F.xxhash64("node", "more")).otherwise(F.col("node"))).drop("clash"), "signatures")
        nodes = counted(signed)

    keys = signed.where("n > 0").select("node", "bands").dropDuplicates(["node"]).select("node", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("v"), F.max("node").alias("w")).where("v < w")
    edges = keys.join(shared.select(unbound("key"), "v"), "key").where("node <> v").select(F.col("node").alias("u"), "v")
    groups = components(edges)
    candidates = groups.join(nodes.select("node", "n", "copies", "one"), "node")
    parts = F.ceil(F.greatest(F.count("*") / block, F.sum("n") / F.lit(block_grams))).cast("int").alias("parts")
    sizes = candidates.groupBy("component").agg(F.count("*").alias("size"), parts).where("size > 1")
    members = materialize(candidates.join(sizes.select(unbound("component"), "parts"), "component"), "candidates")
    few = members.count() <= BROADCAST_ROWS

    def sets_of(members: DataFrame) -> DataFrame:
        """component, part, parts, node, copies, grams: a row a node, or a few where rows repeat its id and text."""
        chosen = (F.broadcast(members) if few else members).select(F.col("one.tf").alias("f"), F.col("one.i").alias("j"), "component", "parts", "node", "copies")
        texts = base.join(chosen, (F.col("tf") == F.col("f")) & F.col("i").eqNullSafe(F.col("j")))
        part = F.pmod(F.xxhash64("node", F.lit(7)), "parts").cast("int").alias("part")

        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes, seen = WordHashes(), set()
            for batch in batches:
                for lo, hi in _slices(batch.column(5)):
                    cut = batch.slice(lo, hi - lo)
                    new = []
                    for k, node in enumerate(cut.column(3).to_pylist()):
                        if node not in seen:
                            new.append(k)
                            seen.add(node)
                    cut = cut.take(pa.array(new, pa.int64()))
                    if len(seen) > 1_000_000:
                        seen.clear()
                    sets = shingle_sets(cut.column(5).to_pylist(), hashes, n)
                    yield pa.RecordBatch.from_arrays([*cut.columns[:5], pa.array([s.tobytes() for s in sets], pa.binary())], ["component", "part", "parts", "node", "copies", "grams"])

        return texts.select("component", part, "parts", "node", "copies", "t").mapInArrow(make, "component long, part int, parts int, node long, copies long, grams binary")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[int], list[int], list[np.ndarray]]]:
        """Nodes of one component and part, with their sets."""

        def stream():
            for batch in batches:
                for lo in range(0, len(batch), 256):
                    yield from zip(*(c.to_pylist() for c in batch.slice(lo, 256).columns), strict=True)

        for key, piece in groupby(stream(), key=lambda x: (x[0], x[1])):
            found = {x[3]: (x[4], np.frombuffer(x[5], np.uint64)) for x in piece}
            yield key, list(found), [x for x, _ in found.values()], [x for _, x in found.values()]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, members, copies, sets in pieces(batches):
            if found := _decided(members, copies, sets, 0, threshold):
                yield pa.RecordBatch.from_pylist(found)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (component, part), *piece in pieces(batches):
            yield pa.RecordBatch.from_pylist([{"component": component, "part": part, "block": _pack_sets(*piece)}])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stream():
            for batch in batches:
                for k in range(len(batch)):
                    yield tuple(c[k].as_py() for c in batch.columns)

        for (_, a, b), piece in groupby(stream(), key=lambda x: x[:3]):
            members, copies, sets, left = [], [], [], 0
            for _, _, _, side, raw in sorted(piece, key=lambda x: x[3]):
                ids, counts, own = _unpack_sets(raw)
                left = len(ids) if side == a and a != b else left
                members, copies, sets = members + ids, copies + counts, sets + own
            # A pair of blocks of which one is empty has no pairs.
            if (a == b or len(members) > left > 0) and (found := _decided(members, copies, sets, left, threshold)):
                yield pa.RecordBatch.from_pylist(found)

    by = ("component", "part")
    decided = materialize(sets_of(members.where("parts = 1")).repartition(*by).sortWithinPartitions(*by).mapInArrow(whole, _DECIDED), "links")
    labels = decided.select("node", "label")
    large = members.where("parts > 1")
    if not large.isEmpty():
        made = materialize(sets_of(large).repartition(*by).sortWithinPartitions(*by).mapInArrow(blocks, "component long, part long, block binary"), "blocks")
        of = large.select("component", "parts").distinct()
        pairs = made.join(of, "component").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        pairs = pairs.select("component", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), F.col("part").alias("side"), "block")
        wide = materialize(pairs.repartition("component", "a", "b").sortWithinPartitions("component", "a", "b").mapInArrow(across, _DECIDED), "links")
        decided = decided.unionByName(wide)
        labels = labels.unionByName(components(wide.select(F.col("node").alias("u"), F.col("label").alias("v"))).withColumnRenamed("component", "label"))
    links = decided.groupBy("node").agg(F.sum("links").alias("links"))
    classed = nodes.join(links, "node", "left").join(labels, "node", "left").select("node", "low", "copies", "links", F.coalesce("label", "node").alias("class"))
    classed = materialize(classed, "classes")
    least = classed.groupBy("class").agg(F.min("low").alias("class_id"))
    result = classed.join(least, "class").select(unbound("node"), "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = signed.select("i", "node", F.col("n").alias("n_shingles")).join(result, "node", "left")
    return out.select(F.col("i").alias(id_col), F.when(F.col("n_shingles") > 0, F.col("class_id")).otherwise(F.col("i")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_shingles")
