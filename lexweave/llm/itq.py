"""Near-duplicate vectors: balanced binary codes by iterative quantisation, multi-index Hamming tables, exact rerank."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from lexweave.llm.common import components, materialize, unbound
from lexweave.llm.ngramjoin import lowest
from lexweave.llm.topk import finite

#: Rows (a key and a count) up to which the keys of large buckets are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


#: Words of code beyond those planned, at most, for links of the sample that share no key.
MORE_WORDS = 48


def learn_rotation(sample: np.ndarray, bits: int, rounds: int = 50, seed: int = 0, centred: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) of iterative quantisation (Gong and Lazebnik 2011): principal directions, then the rotation
    that brings the sample closest to the corners of a cube, from a random one. Not centred: the mean is zero, so that a
    bit of two vectors differs with probability angle / pi wherever the sample lies."""
    mean = sample.mean(axis=0) * centred
    x = sample - mean
    _, _, vt = np.linalg.svd(x, full_matrices=False)
    top = vt[:bits].T
    x = x @ top
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(top.shape[1], top.shape[1])))[0]
    for _ in range(rounds):
        u, _, wt = np.linalg.svd(x.T @ np.where(x @ rotation >= 0, 1.0, -1.0))
        rotation = u @ wt
    return mean, top @ rotation


def table_plan(largest: int, columns: int, threshold: float, per_bucket: int = 256, recall: float = 0.97) -> tuple[int, int, int]:
    """(bits of a table's key, tables of a rotation, rotations) for a label of so many vectors.

    The key grows with the logarithm of the vectors, so a bucket holds about per_bucket of them at any size (8 bits at
    least). A wider key is missed more often: a bit of two vectors at the threshold differs with probability angle / pi.
    So many tables are made that independent bits would give the recall; the bits of one rotation, being orthogonal,
    give more (measured in the tests). Tables beyond those of one rotation take further rotations. Where a rotation has
    fewer columns than a key, a key, and a word of code, spans several."""
    key = min(max(8, math.ceil(math.log2(max(1, largest) / per_bucket))), 30)
    hit = (1 - math.acos(threshold) / math.pi) ** key
    tables = columns * _spanned(key, columns) // key
    return key, tables, math.ceil(math.ceil(math.log(1 - recall) / math.log(1 - hit)) / tables)


def _spanned(key: int, columns: int) -> int:
    """The rotations of one word of code."""
    return -(-key // columns)


def _words(x: np.ndarray, learned: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The codes of unit vectors, a word a pair of mean and projection."""
    out = np.zeros((len(x), len(learned)), np.uint64)
    for k, (mean, projection) in enumerate(learned):
        out[:, k] = ((x - mean) @ projection >= 0) @ (np.uint64(1) << np.arange(projection.shape[1], dtype=np.uint64))
    return out


def _share(differ: np.ndarray, key: int, tables: int) -> np.ndarray:
    """Whether words that differ in these bits have a key in common."""
    mask = np.uint64((1 << key) - 1)
    return np.any([(differ >> np.uint64(t * key)) & mask == 0 for t in range(tables)], axis=0)


def learn_words(unit: np.ndarray, labels: np.ndarray, threshold: float, columns: int, key: int, tables: int, words: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """Projections for words of code, and the most bits in which linked vectors of the sample differ.

    words of them are centred; as long as two linked vectors of the sample (rows of unit, with labels) share no key of
    tables a word, one more is learned that is not centred, MORE_WORDS at most. A table that is no larger than its sample
    has all its links found so."""
    span = _spanned(key, columns)

    def word(k: int, centred: bool) -> tuple[np.ndarray, np.ndarray]:
        # In few columns every start leads to the same rotation: after the first they stay random, as do those added.
        learned = [centred and (columns >= 8 or k + j == 0) for j in range(span)]
        made = [learn_rotation(unit, columns, 50 if some else 0, k * span + j, centred) for j, some in enumerate(learned)]
        return made[0][0], np.hstack([p for _, p in made])

    if not len(unit):
        return [(np.zeros(1), np.zeros((1, columns * span)))] * words, 0
    learned = [word(k, True) for k in range(words)]
    linked = [np.zeros((0, 2), np.int32)]
    for a in range(0, len(unit), 512):
        near = (unit[a : a + 512] @ unit.T >= threshold - 1e-9) & (labels[a : a + 512, None] == labels)
        x, y = np.nonzero(np.triu(near, a + 1))
        linked.append(np.column_stack([x + a, y]).astype(np.int32))
    x, y = missed = np.concatenate(linked).T
    codes, apart = _words(unit, learned), np.zeros(len(x), np.int64)
    for k in range(len(learned) + MORE_WORDS):
        if k == len(learned):
            if not missed.shape[1]:
                break
            learned.append(word(k, False))
            codes = np.column_stack([codes, _words(unit, learned[-1:])])
        apart += np.bitwise_count(codes[x, k] ^ codes[y, k])
        missed = missed[:, ~_share(codes[missed[0], k] ^ codes[missed[1], k], key, tables)]
    return learned, int(apart.max(initial=0))


def near_dedup(
    vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    bits: int = 64, key_bits: int | None = None, sample_rows: int = 4096, block: int = 1024, node_bits: int = 64,
) -> DataFrame:
    """Links between vectors of one label whose cosine, in double precision, is threshold or more.

    Returns a row a vector: the id, n_links (others linked directly, copies counted), component_id (the smallest id that
    links lead to) and kept (whether that is its own).

    Equal vectors of a label are one node with a count. Rotations of bits columns are learned from the sample_rows nodes
    with the smallest fingerprints (learn_words(), which adds some until the sample's own links are found); all nodes are
    coded. Codes are cut into keys of Hamming tables by table_plan() (or key_bits), at any size and length. Vectors with
    a key in common are candidates if their codes differ in no more bits than four and a half standard deviations over
    the mean of pairs at the threshold, or than linked vectors of the sample do. Only codes are shuffled to find these; vectors go to
    the buckets where they have a candidate that no earlier table has, and cosines decide. A bucket of more than block
    nodes is cut into blocks, a pair of blocks being a piece of work of bounded memory. Pieces return a row a node,
    never a row a pair. Recall is that of the tables: a pair is missed if its codes differ in every key (tests measure
    it against brute force; pairs below the threshold are never linked).

    Null labels; null, empty and zero vectors; vectors with null or non-finite components: no links, a component of
    their own. Null ids: never a component_id while the component has another; not kept. Repeated rows are copies.
    Vectors of another length than most of the sample share a bucket a length; different lengths never link. Ties do
    not occur. Empty table: no rows. Other columns are not read. Nodes are told apart by two fingerprints, as in
    ngram_join (node_bits: of the first)."""
    kind = vectors.schema[id_col].dataType.simpleString()
    single = isinstance(vectors.schema[vector_col].dataType.elementType, FloatType)
    v = F.col(vector_col) if single else F.transform(vector_col, lambda x: x.cast("double"))
    good = F.coalesce(finite(F.col(vector_col)) & F.exists(vector_col, lambda x: x != 0), F.lit(False)) & F.col(label_col).isNotNull()
    rows = vectors.select(
        F.col(id_col).alias("i"), F.when(good, F.shiftright(F.xxhash64(F.col(label_col), v), 64 - node_bits) if node_bits < 64 else F.xxhash64(F.col(label_col), v)).alias("node"),
        F.when(good, F.xxhash64(F.lit(1), F.col(label_col), v)).alias("more"), F.when(good, v).alias("v"), F.col(label_col).cast("string").alias("l"),
    )

    def counted(rows: DataFrame) -> DataFrame:
        by = rows.where("node is not null").groupBy("node")
        return materialize(by.agg(F.min("i").alias("low"), F.count("*").alias("copies"), F.any_value("v").alias("v"), F.any_value("l").alias("l"), F.min("more").alias("least"), F.max("more").alias("most")), "nodes")

    nodes = counted(rows)
    clash = nodes.where("least <> most").select("node", F.lit(True).alias("clash"))
    if not clash.isEmpty():
        rows = rows.join(clash, "node", "left").withColumn("node", F.when(F.col("clash"), F.xxhash64("node", "more")).otherwise(F.col("node"))).drop("clash")
        nodes = counted(rows)

    sample = [(np.array(r[0], np.float64), r[1]) for r in nodes.orderBy("node").limit(sample_rows).select("v", "l").collect()]
    lengths, n = np.unique([len(x) for x, _ in sample], return_counts=True)
    d = int(lengths[n.argmax()]) if len(sample) else 0
    unit = np.array([x / np.linalg.norm(x) for x, _ in sample if len(x) == d]).reshape(-1, max(1, d))
    labels = np.unique([y for x, y in sample if len(x) == d], return_inverse=True)[1]
    largest = nodes.groupBy("l").count().agg(F.max("count")).first()[0] or 0
    columns = max(1, min(bits, d, len(unit)))
    if key_bits is None:
        key, per_word, planned = table_plan(largest, columns, threshold)
    else:
        key, per_word, planned = key_bits, columns * _spanned(key_bits, columns) // key_bits, 1
    learned, most = learn_words(unit, labels, threshold, columns, key, per_word, planned)
    tables, width, differ = per_word * len(learned), columns * _spanned(key, columns) * len(learned), math.acos(threshold) / math.pi
    radius = max(most, math.ceil(width * differ + 4.5 * math.sqrt(width * differ * (1 - differ))))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.asarray(batch.column(1).value_lengths())
            out = np.zeros((len(size), len(learned)), np.uint64)
            usual = np.flatnonzero(size == d)
            if len(usual):
                x = batch.column(1).take(pa.array(usual)).flatten().to_numpy().astype(np.float64).reshape(len(usual), d)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                out[usual] = _words(x, learned)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(size, pa.int32()), pa.array(list(out.view(np.int64)), pa.list_(pa.int64()))], ["node", "l", "d", "code"])

    coded = materialize(nodes.select("node", "v", "l").mapInArrow(code, "node long, l string, d int, code array<long>"), "codes")
    part = lambda t: F.shiftright(F.get("code", F.lit(t // per_word)), t % per_word * key).bitwiseAND(F.lit((1 << key) - 1))
    keys = F.array(*(F.xxhash64("l", "d", F.lit(t), part(t)) for t in range(tables)))
    indexed = coded.select("node", "code", F.posexplode(keys).alias("table", "key"))
    large = materialize(indexed.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > block), "buckets")
    large = F.broadcast(large) if large.count() <= BROADCAST_ROWS else large
    pieces = indexed.join(large, "key", "left").withColumn("parts", F.coalesce(F.ceil(F.col("size") / block), F.lit(1)).cast("int"))
    pieces = pieces.withColumn("mine", F.pmod(F.xxhash64("node", F.lit(7)), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pieces = pieces.select("key", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), F.col("mine").alias("side"), "table", "node", "code")

    def streamed(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[list[tuple]]:
        """Pieces, in the order of side and node."""

        def stream():
            for batch in batches:
                for lo in range(0, len(batch), rows):
                    yield from zip(*(c.to_pylist() for c in batch.slice(lo, rows).columns), strict=True)

        for _, piece in groupby(stream(), key=lambda x: x[:3]):
            yield sorted(piece, key=lambda x: (x[3], x[5]))

    def near(piece: list[tuple]) -> np.ndarray:
        """Which pairs of a piece are candidates that no earlier table has."""
        a, b, table = piece[0][1], piece[0][2], piece[0][4]
        words = np.array([x[6] for x in piece], np.int64).view(np.uint64)
        distance, ok = np.zeros((len(piece), len(piece)), np.int32), np.ones((len(piece), len(piece)), bool)
        for k in range(len(learned)):
            differ = words[:, None, k] ^ words[:, k]
            distance += np.bitwise_count(differ)
            if (earlier := min(per_word, table - k * per_word)) > 0:
                ok &= ~_share(differ, key, earlier)
        ok &= distance <= radius
        np.fill_diagonal(ok, False)
        if a != b:
            left = sum(x[3] == a for x in piece)
            ok[:left, :left] = ok[left:, left:] = False
        return ok

    names = ["key", "a", "b", "side", "table", "node", "code"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for piece in streamed(batches, 8192):
            if len(piece) > 1:
                found += [x for x, some in zip(piece, near(piece).any(axis=1), strict=True) if some]
            if len(found) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for piece in streamed(batches, 2048):
            ok = near(piece)
            labels = np.unique([x[7] for x in piece], return_inverse=True)[1]
            size = np.array([len(x[8]) for x in piece])
            same = np.zeros(ok.shape, bool)
            for d_ in np.unique(size):
                at = np.flatnonzero(size == d_)
                x = np.array([piece[k][8] for k in at], np.float64)
                norm = np.linalg.norm(x, axis=1)
                same[np.ix_(at, at)] = (x @ x.T) / (norm[:, None] * norm) >= threshold
            ok &= same & (labels[:, None] == labels)
            links = ok @ np.array([x[9] for x in piece], np.int64)
            by_node = np.argsort([x[5] for x in piece], kind="stable")
            label = np.empty(len(piece), np.int64)
            label[by_node] = by_node[lowest(ok[np.ix_(by_node, by_node)])]
            found += [(x[5], piece[label[k]][5], int(links[k])) for k, x in enumerate(piece) if links[k]]
            if len(found) >= 10_000:
                yield pa.RecordBatch.from_pylist([dict(zip(("node", "label", "links"), x, strict=True)) for x in found])
                found = []
        if found:
            yield pa.RecordBatch.from_pylist([dict(zip(("node", "label", "links"), x, strict=True)) for x in found])

    by = ("key", "a", "b")
    picked = pieces.repartition(*by).sortWithinPartitions(*by).mapInArrow(candidates, "key long, a int, b int, side int, table int, node long, code array<long>")
    sent = materialize(picked, "picked").join(nodes.select(unbound("node"), "l", "v", "copies"), "node").select(*names, "l", "v", "copies")
    decided = materialize(sent.repartition(*by).sortWithinPartitions(*by).mapInArrow(rerank, "node long, label long, links long"), "links")
    links = decided.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(decided.select(F.col("node").alias("u"), F.col("label").alias("v")))
    classed = nodes.select("node", "low", "copies").join(links, "node", "left").join(labels, "node", "left").withColumn("class", F.coalesce("component", "node"))
    classed = materialize(classed, "classes")
    least = classed.groupBy("class").agg(F.min("low").alias("component_id"))
    result = classed.join(least, "class").select(unbound("node"), "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.select("i", "node").join(result, "node", "left")
    out = out.select(F.col("i").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "i").cast(kind).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
