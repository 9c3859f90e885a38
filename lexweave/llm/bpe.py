"""Byte-level BPE encoding and decoding by one global shuffle of distinct words."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import Words

#: The split before merging; white space is spelled out, as the Unicode property that the merging library uses.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Characters of text whose pre-tokens make one chunk, the unit in which positions are counted and put together.
CHUNK_CHARS = 12_000_000
#: Characters of text for which there is a bucket of distinct pre-tokens.
BUCKET_CHARS = 64_000_000
#: Pre-tokens of a chunk that are numbered by their frequency.
TOP = 4096


@lru_cache(maxsize=2)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def _merger(path: str):
    import tiktoken

    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=_ranks(path), special_tokens={})._encode_single_piece


@lru_cache(maxsize=2)
def _bytes_of(path: str) -> np.ndarray:
    """Token id -> bytes, an object array as long as the rank file, whatever the texts."""
    ranks = _ranks(path)
    table = np.full(max(ranks.values()) + 1, b"", object)
    for token, i in ranks.items():
        table[i] = token
    return table


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def _squeeze(values: np.ndarray) -> bytes:
    """Numbers below 2 ** 32: the planes of their bytes, each compressed."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    press = zstandard.ZstdCompressor(level=3).compress
    packed = [press(x.tobytes()) if x.any() else b"" for x in planes]
    return np.array([len(values), *map(len, packed)], np.int64).tobytes() + b"".join(packed)


def _expand(raw: bytes) -> np.ndarray:
    n, *sizes = np.frombuffer(raw, np.int64, 5).tolist()
    out, at = np.zeros((4, n), np.uint8), 40
    for k, size in enumerate(sizes):
        if size:
            out[k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[at : at + size], max_output_size=n), np.uint8)
        at += size
    return np.ascontiguousarray(out.T).view("<u4").ravel().astype(np.int64)


def _join(parts: list[bytes]) -> bytes:
    return b"".join(np.int64(len(x)).tobytes() + x for x in parts)


def _cut(raw: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(raw):
        n = int(np.frombuffer(raw, np.int64, 1, at)[0])
        out.append(raw[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def explode_words(docs: DataFrame, buckets: int) -> DataFrame:
    """docs (i, t) -> bucket, chunk, kind, raw, of every chunk: a row of kind 0 for each bucket, the sorted distinct
    pre-tokens of the chunk whose hash is of that bucket; and one of kind 1 (in any bucket), which has for every
    position of the chunk the number of its pre-token, with the ids and sizes of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, find = TaskContext.get().partitionId() << 32, regex.compile(PATTERN).findall
        names = ("bucket", "chunk", "kind", "raw")
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary())

        def rows(keys: list, sizes: list[int], words: Words, at: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            sink = pa.BufferOutputStream()
            ids = pa.table({"i": pa.array(keys, kind), "n": pa.array(sizes, pa.int64())})
            with pa.ipc.new_stream(sink, ids.schema) as f:
                f.write_table(ids)
            flat = np.concatenate(at)
            text = [w.encode() for w in words]
            bucket = np.fromiter((xxhash.xxh64_intdigest(w) % buckets for w in text), np.int64, len(text))
            order = np.array(sorted(range(len(text)), key=text.__getitem__), np.int64)
            order = order[np.argsort(bucket[order], kind="stable")]
            place = np.empty(len(text), np.int64)
            place[order] = np.arange(len(text))
            # The most frequent pre-tokens get the smallest numbers: this is what makes the numbers compress.
            top = np.argsort(-np.bincount(flat, minlength=len(text)), kind="stable")[:TOP] if len(text) else place
            number = place + TOP
            number[top] = np.arange(len(top))
            out = [(int(chunk % buckets), chunk, 1, _join([sink.getvalue().to_pybytes(), _squeeze(place[top]), _squeeze(number[flat])]))]
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            press = zstandard.ZstdCompressor(level=3).compress
            for b in np.flatnonzero(np.diff(ends)).tolist():
                mine = [text[k] for k in order[ends[b] : ends[b + 1]].tolist()]
                out.append((b, chunk, 0, _join([_squeeze(np.fromiter(map(len, mine), np.int64, len(mine))), press(b"".join(mine))])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

        kind = None
        keys, sizes, words, at, held = [], [], Words(), [], 0
        for batch in batches:
            kind = batch.column(0).type
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                found = find(text.as_py())
                keys.append(key.as_py())
                sizes.append(len(found))
                at.append(np.fromiter(map(words.__getitem__, found), np.int32, len(found)))
                held += len(text.as_py())
                if held >= CHUNK_CHARS:
                    yield from rows(keys, sizes, words, at)
                    chunk += 1
                    keys, sizes, words, at, held = [], [], Words(), [], 0
        if keys:
            yield from rows(keys, sizes, words, at)

    return docs.mapInArrow(run, "bucket int, chunk long, kind int, raw binary")


def encode_words(rows: DataFrame, ranks: str, remembered: int = 1_000_000) -> DataFrame:
    """bucket, chunk, kind, raw: in rows of kind 0 the words give way to their ids (number of each, then all). A task
    has all the rows of its buckets and merges a word that many chunks have once (anew after each remembered words,
    which bounds its memory)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge = _merger(ranks)

        class Merged(dict):
            def __missing__(self, word):
                self[word] = ids = np.array(merge(word), np.uint32)
                return ids

        known = Merged()
        for batch in batches:
            out = []
            for kind, raw in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                raw = raw.as_py()
                if kind == 0:
                    sizes, packed = _cut(raw)
                    ends = np.cumsum(_expand(sizes)).tolist()
                    text = zstandard.ZstdDecompressor().decompress(packed, max_output_size=ends[-1])
                    ids = [known[text[a:b]] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                    raw = _join([_squeeze(np.fromiter(map(len, ids), np.int64, len(ids))), _squeeze(np.concatenate(ids))])
                    if len(known) > remembered:
                        known.clear()
                out.append(raw)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], ["bucket", "chunk", "kind", "raw"])

    return rows.mapInArrow(run, "bucket int, chunk long, kind int, raw binary")


def encode(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text", output: str = "ids") -> DataFrame:
    """The token ids of every whole text by a file of ranks, each match of PATTERN merged separately, no special tokens.

    Pre-tokens are exploded with their positions: of a chunk of about CHUNK_CHARS characters each distinct one is sent
    once, to the task that its hash gives, whatever the number of its occurrences, so none is hot; there each distinct
    word of the whole table is merged once. Its ids go back to its chunks by a second shuffle, together with the
    chunk's positions, and are put at these. Rows of both shuffles hold many words, compressed. The ids are decoded by
    the table of token bytes, which has the size of the rank file. Buckets grow in number with the text, chunks do not
    grow. A chunk's number is its place in its task: where the rows of docs come from a stage whose order is not fixed,
    Spark runs that stage's dependents again as a whole.

    Returns the id, n_tokens and, by output, "ids" (array<int>) and text (decoded), or "digest": ids_sha256 (of the ids
    as little-endian unsigned 32-bit integers) and decoded_sha256 (of the decoded bytes).

    Null text: empty; empty text: no ids. Null or repeated ids, repeated rows: a row each. Very long texts: a chunk of
    their own. Ties do not occur. Empty table: no rows. Columns besides the two named are not read."""
    id_kind = docs.schema[id_col].dataType.simpleString()
    typed = docs.select(F.col(id_col).cast(id_kind).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    total = typed.agg(F.sum(F.length("t"))).first()[0] or 0
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1, -(-total // BUCKET_CHARS))
    words = explode_words(typed, tasks)
    coded = encode_words(words.repartitionById(tasks, F.col("bucket")), ranks)
    digest = output == "digest"

    def assemble(group: pa.Table) -> pa.Table:
        table = _bytes_of(ranks)
        group = group.sort_by([("kind", "descending"), ("bucket", "ascending")])
        head, *parts = (x.as_py() for x in group.column("raw"))
        ids_, top, numbers = _cut(head)
        docs_ = pa.ipc.open_stream(ids_).read_all()
        sizes, number, top = docs_.column("n").to_numpy(), _expand(numbers), _expand(top)
        pairs = [_cut(x) for x in parts]
        per = np.concatenate([_expand(a) for a, _ in pairs] or [np.zeros(0, np.int64)])
        ids = np.concatenate([_expand(b) for _, b in pairs] or [np.zeros(0, np.int64)]).astype("<u4")
        at = np.where(number < TOP, top[np.minimum(number, max(0, len(top) - 1))], number - TOP) if len(number) else number
        tokens = per[at]
        ends = _offsets(tokens)
        source = np.repeat(_offsets(per)[:-1][at] - ends[:-1], tokens) + np.arange(ends[-1])
        flat = ids[source]
        bounds = ends[_offsets(sizes)]
        cols: list[list] = [[], []]
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            own = np.ascontiguousarray(flat[a:b])
            text = b"".join(table[own].tolist())
            cols[0].append(hashlib.sha256(own).hexdigest() if digest else own.astype(np.int32))
            cols[1].append(hashlib.sha256(text).hexdigest() if digest else text.decode("utf-8", "replace"))
        kinds = (pa.string(), pa.string()) if digest else (pa.list_(pa.int32()), pa.string())
        names = ("ids_sha256", "decoded_sha256") if digest else ("ids", "text")
        return pa.table({"i": docs_.column("i"), "n_tokens": pa.array(np.diff(bounds), pa.int64())} | {k: pa.array(c, t) for k, c, t in zip(names, cols, kinds, strict=True)})

    out = coded.groupBy("chunk").applyInArrow(assemble, f"i {id_kind}, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, text string"))
    return out.withColumnRenamed("i", id_col)
