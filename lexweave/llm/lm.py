"""Language-model scoring by deleted interpolation of word n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import Words, materialize, mix

_END, _START = np.uint64(xxhash.xxh64_intdigest(b"", 1)), np.uint64(xxhash.xxh64_intdigest(b"", 2))
#: Characters of text that are held as numbers at a time, and whose distinct n-grams are sent together; tokens for which
#: there is a bucket of counts. A row goes from each group to each bucket, so with more memory both should be larger.
CHUNK_CHARS, GROUP_CHARS, BUCKET_TOKENS = 3_000_000, 6_000_000, 600_000
#: Context-frequency buckets: of one word (none, and a power of two each), then of two words (a power of two each).
ONE_WORD, BUCKETS = 65, 130
#: Bits of an n-gram's hash beyond the logarithm of the number of tokens: one in a million shares another's number.
SPARE_BITS = 20


def frequency_bucket(two: np.ndarray, one: np.ndarray) -> np.ndarray:
    """The bucket of a context: by the count of both of its words if that is not 0, else by that of the last word."""
    log = lambda n: 1 + np.floor(np.log2(np.maximum(n, 1)))
    return np.where(two > 0, ONE_WORD + log(two) - 1, np.where(one > 0, log(one), 0)).astype(np.int64)


def _pack(*arrays: np.ndarray) -> bytes:
    """Whole numbers, none negative, compressed; bytes of the same place in the numbers stand together, as most are 0."""
    out = []
    for a in arrays:
        kind = np.dtype("<u1 <u2 <u4 <u8".split()[int(np.searchsorted([1 << 8, 1 << 16, 1 << 32], int(a.max(initial=0)), "right"))])
        planes = np.ascontiguousarray(a.astype(kind)).view(np.uint8).reshape(len(a), kind.itemsize).T.tobytes()
        out.append(np.array([len(a), kind.itemsize], np.int64).tobytes() + planes)
    return zstandard.compress(b"".join(out), 1)


def _unpack(raw: bytes) -> list[np.ndarray]:
    out, at, raw = [], 0, zstandard.decompress(raw)
    while at < len(raw):
        n, size = np.frombuffer(raw, np.int64, 2, at).tolist()
        planes = np.frombuffer(raw, np.uint8, n * size, at + 16).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{size}").reshape(n).astype(np.uint64))
        at += 16 + n * size
    return out


def number_words(docs: DataFrame) -> DataFrame:
    """docs (i, t, train, tune) -> chunk, tune, tokens, ids, raws: a row is a group of texts of one part (tune or not), in
    chunks: the numbers of their words, the most frequent words of the chunk first, and the words' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        class Part:
            """What is held of a part: the texts of the chunk that is filled, and the chunks before it."""

            def __init__(self):
                self.ids, self.raws, self.tokens, self.characters = [], [], 0, 0
                self.begin()

            def begin(self) -> None:
                self.sizes, self.train, self.words, self.at, self.held = [], [], Words(), [], 0

            def add(self, i, text: bytes, train: bool) -> None:
                split = text.lower().split()
                self.ids.append(i)
                self.sizes.append(len(split))
                self.train.append(train)
                self.at.append(np.fromiter(map(self.words.__getitem__, split), np.int64, len(split)))
                self.held += len(text)

            def end(self) -> None:
                if not self.sizes:
                    return
                flat, words = np.concatenate(self.at), self.words
                order = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
                rank = np.empty(len(words), np.int64)
                rank[order] = np.arange(len(words))
                hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))[order]
                self.raws.append(_pack(np.array(self.sizes), np.array(self.train, np.uint8), rank[flat], hashes))
                self.tokens += len(flat) + len(self.sizes)
                self.characters += self.held
                self.begin()

        chunk = TaskContext.get().partitionId() << 32
        parts = {False: Part(), True: Part()}

        def row(tune: bool) -> pa.RecordBatch:
            nonlocal chunk
            part, parts[tune], chunk = parts[tune], Part(), chunk + 1
            sink = pa.BufferOutputStream()
            table = pa.table({"i": pa.array(part.ids, kind)})
            with pa.ipc.new_stream(sink, table.schema) as f:
                f.write_table(table)
            values = (chunk, tune, part.tokens, sink.getvalue().to_pybytes(), part.raws)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, (pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.list_(pa.binary())), strict=True)], ["chunk", "tune", "tokens", "ids", "raws"])

        for batch in batches:
            kind = batch.column(0).type
            for i, text, train, tune in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                part = parts[tune and train]
                part.add(i.as_py(), text.as_py().encode(), train)
                if part.held >= CHUNK_CHARS:
                    part.end()
                    if part.characters >= GROUP_CHARS:
                        yield row(tune and train)
        for tune in (False, True):
            parts[tune].end()
            if parts[tune].ids:
                yield row(tune)

    return docs.mapInArrow(run, "chunk long, tune boolean, tokens long, ids binary, raws array<binary>")


class Chunk:
    """The distinct words, pairs and triples of some texts, each with its hash and its count in training texts; which
    triple stands at each token."""

    def __init__(self, raw: bytes, bits: int):
        sizes, train, plain, hashes = _unpack(raw)
        self.sizes = sizes.astype(np.int64) + 1
        self.stops = np.cumsum(self.sizes)
        self.hash, self.end = np.concatenate([hashes, [_END, _START, mix(_START[None])[0]]]), len(hashes)
        first, width = self.stops - self.sizes, len(self.hash)
        at = np.full(int(self.stops[-1]), self.end, np.int64)
        inner = np.ones(len(at), bool)
        inner[self.stops - 1] = False
        at[inner] = plain.astype(np.int64)
        before = np.concatenate([[0], at[:-1]])
        before[first] = self.end + 1
        pairs, pair = np.unique(before * width + at, return_inverse=True)
        # The context of a triple is a pair, or (at the start of a text) the number of pairs.
        context = np.concatenate([[0], pair[:-1]])
        context[first] = len(pairs)
        triples, some, triple = np.unique(context * width + at, return_index=True, return_inverse=True)
        self.split, slim = len(pairs), lambda x: x.astype(np.int32)
        self.context, self.pair, self.before, self.word, self.triple = map(slim, (triples // width, pair[some], before[some], at[some], triple))
        two = mix(mix(self.hash[pairs // width]) + self.hash[pairs % width])
        three = mix(mix(np.append(two, _START)[self.context] + np.uint64(3)) + self.hash[self.word])
        self.grams, place = np.unique(np.concatenate([two, three]) >> np.uint64(64 - bits), return_inverse=True)
        #: Words stand in the order of their hashes, and so do pairs and triples together.
        self.place, self.words = slim(place), np.argsort(self.hash[: self.end + 1], kind="stable")
        learns = np.repeat(train.astype(bool), self.sizes)
        count = lambda x, n: np.bincount(x[learns], minlength=n)
        self.own_words = count(at, width)[: self.end + 1]
        self.own_grams = np.bincount(place, np.concatenate([count(pair, len(pairs)), count(triple, len(triples))]), len(self.grams)).astype(np.int64)


def edges(hashes: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Where each bucket's range of sorted hashes begins, and where the last one's ends."""
    return np.searchsorted((hashes >> np.uint64(max(0, bits - 32))).astype(np.int64) * buckets >> min(bits, 32), np.arange(buckets + 1))


def questions(raws: list[bytes], bits: int, buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, what a group asks it): of each chunk the hashes of the bucket's words, their counts in its training texts,
    and the same of its pairs and triples."""
    steps, held = (lambda x: np.diff(x, prepend=np.uint64(0))), []
    for raw in raws:
        c = Chunk(raw, bits)
        words = c.hash[c.words]
        held.append((words, c.own_words[c.words], c.grams, c.own_grams, edges(words, 64, buckets), edges(c.grams, bits, buckets)))
    some = sum(np.diff(x[4]) + np.diff(x[5]) for x in held)
    for b in np.flatnonzero(some).tolist():
        arrays = []
        for words, n, grams, m, one, more in held:
            one, more = slice(one[b], one[b + 1]), slice(more[b], more[b + 1])
            arrays += [steps(words[one]), n[one], steps(grams[more]), m[more]]
        yield b, _pack(*arrays)


def answered_counts(raws: list[bytes], answers: dict, bits: int, buckets: int, main: bool) -> Iterator[tuple[Chunk, tuple[np.ndarray, ...]]]:
    """For every triple of each chunk of a group its count, that of its context, of its last two words, of the middle word
    and of the last."""
    found = {b: _unpack(x.as_py()) for b, x in answers.items()}
    for k, raw in enumerate(raws):
        c = Chunk(raw, bits)
        words, grams = np.empty(len(c.words), np.int64), np.empty(len(c.grams), np.int64)
        one, more = edges(c.hash[c.words], 64, buckets), edges(c.grams, bits, buckets)
        for b, x in found.items():
            at = k * (len(x) // len(raws)) + 2 * main
            words[one[b] : one[b + 1]], grams[more[b] : more[b + 1]] = x[at], x[at + 1]
        own = np.zeros(len(c.words) + 1, np.int64)
        own[c.words] = words
        own[-1] = starts = own[c.end]
        two, three = grams[c.place[: c.split]], grams[c.place[c.split :]]
        context = np.append(two, starts)[c.context]
        yield c, (np.minimum(three, context), context, np.minimum(two[c.pair], own[c.before]), own[c.before], own[c.word])


def learn_weights(cells: DataFrame, tokens: int, distinct: int, rounds: int = 30) -> np.ndarray:
    """The weights (of three words, two, one, none) of each context bucket, by expectation-maximisation on tuning tokens:
    each round is a sum over all cells.

    cells: b, c3, ctx, c2, mid, c1, n: bucket, the counts of Chunk.counts() outside the tuning part, number of tokens. A
    bucket without tokens takes the weights of the next lower one of its kind (contexts of one or of two words) that
    has some, else of all cells of its kind."""
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    p = [share("c3", "ctx"), share("c2", "mid"), F.col("c1") / F.lit(max(1, tokens)), F.lit(1.0 / (distinct + 1))]
    kind = (F.col("b") >= ONE_WORD).cast("int") + BUCKETS
    both = cells.select("n", *(x.alias(f"p{k}") for k, x in enumerate(p)), F.explode(F.array("b", F.when(F.col("b") > 0, kind))).alias("b")).where("b is not null")
    weights = np.full((BUCKETS + 2, 4), 0.25)
    weights[[*range(ONE_WORD), BUCKETS]] = [0, 1 / 3, 1 / 3, 1 / 3]
    weights[0] = [0, 0, 0.5, 0.5]
    seen: set[int] = set()
    for _ in range(rounds):
        terms = [F.get(F.array(*map(F.lit, weights[:, k].tolist())), F.col("b")) * F.col(f"p{k}") for k in range(4)]
        each = both.select("b", "n", *(t.alias(f"t{k}") for k, t in enumerate(terms))).withColumn("s", F.col("n") / (F.col("t0") + F.col("t1") + F.col("t2") + F.col("t3")))
        for b, *sums in each.groupBy("b").agg(*(F.sum(F.col(f"t{k}") * F.col("s")) for k in range(4))).collect():
            weights[b] = np.array(sums) / sum(sums)
            seen.add(b)
        if not seen:
            break
    out = weights[:BUCKETS].copy()
    for b in range(1, BUCKETS):
        if b not in seen:
            lowest = ONE_WORD if b >= ONE_WORD else 1
            out[b] = out[b - 1] if b > lowest and any(k in seen for k in range(lowest, b)) else weights[BUCKETS + (b >= ONE_WORD)]
    out = np.maximum(out, [0, 0, 1e-6, 1e-6])
    return out / out.sum(axis=1, keepdims=True)


def interpolated(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", tune_one_in: int = 10) -> DataFrame:
    """Score every whole text with a trigram model learned from the rows where train holds.

    Tokens: the words of the text (A to Z lower-cased, ended by ASCII white space), then an end. P(w | u v) mixes the
    maximum-likelihood estimates c(u v w) / c(u v), c(v w) / c(v), c(w) / N and the uniform 1 / (V + 1). The weights
    depend on the frequency bucket of the context (powers of two of c(u v), or of c(v) where that is 0) and are learned by
    expectation-maximisation on the training rows whose text's crc32 is divisible by tune_one_in, with exact estimates
    from the other training rows; the scores use all. Every n-gram that occurs has its count, however rare, so what is
    learned grows with the input.

    Texts are written once, as word numbers in groups of chunks, tuning rows in groups of their own; a group is a row, so
    nothing later depends on how tasks divide the input. Each chunk's distinct words, pairs and triples go once, as sorted
    hashes with counts, to the buckets that ranges of the hashes give: a frequent n-gram is a number a chunk, so none is
    hot. There the counts of all groups add up and go back to the groups. So no text is shuffled, and no table of n-grams is
    ever in one place or collected. Words have hashes of 64 bits; pairs and triples of SPARE_BITS more than the logarithm
    of the number of tokens (at most 64), so about one in a million has the count of another added to its own.

    Returns the id, n_tokens, n_known, train_tokens, base_score (unigrams with one added to each count) and score, both
    log10 of the whole text's probability. Null or empty text: the end alone. Null train: learns nothing. Null and
    repeated ids, repeated rows: each a text. Very long texts: whole. Ties do not occur. No training rows: the uniform
    estimate over one type. Empty table: no rows. Other columns are not read."""
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).cast(kind).alias("i"), text.alias("t"), F.coalesce(train, F.lit(False)).alias("train"), (F.crc32(text.cast("binary")) % tune_one_in == 0).alias("tune"))
    chunks = materialize(number_words(base), "chunks")
    total = chunks.agg(F.sum("tokens")).first()[0] or 0
    bits, buckets = min(64, max(32, total.bit_length() + SPARE_BITS)), max(1, math.ceil(total / BUCKET_TOKENS))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, tune, raws in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                out = [(b, chunk, tune, x) for b, x in questions(raws.as_py(), bits, buckets)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], ["bucket", "chunk", "tune", "grams"])

    def answer(group: pa.Table) -> pa.Table:
        rows = [_unpack(x.as_py()) for x in group.column("grams")]
        asked = [x[k : k + 4] for x in rows for k in range(0, len(x), 4)]
        tune, stats = np.asarray(group.column("tune")), [0, 0, 0]
        size = [len(x) // 4 for x in rows]
        late = np.repeat(tune, size)
        sets: list[list[np.ndarray]] = []
        for k in (0, 2):
            per = np.cumsum([len(x[k]) for x in asked])
            unique, at = np.unique(np.concatenate([np.cumsum(x[k], dtype=np.uint64) for x in asked]), return_inverse=True)
            n, later = np.concatenate([x[k + 1] for x in asked]).astype(np.int64), np.repeat(late, np.diff(per, prepend=0))
            both = [np.bincount(at, x, len(unique)).astype(np.int64) for x in (n, np.where(later, 0, n))]
            sets += [np.split(x[at], per[:-1]) for x in both]
            if k == 0:
                stats = [int((both[0] > 0).sum()), int(both[0].sum()), int(both[1].sum())]
        out, first = [], np.cumsum(size) - size
        for j, some in enumerate(tune):
            mine = range(first[j], first[j] + size[j])
            out.append(_pack(*(sets[x][i] for i in mine for x in ((0, 2, 1, 3) if some else (0, 2)))))
        column = lambda x: pa.array([None] * len(out) + [x], pa.int64())
        bucket = group.column("bucket")[0].as_py()
        return pa.table({"bucket": pa.array([bucket] * (len(out) + 1), pa.int32()), "chunk": pa.array([*group.column("chunk").to_pylist(), -1], pa.int64()), "counts": pa.array([*out, None], pa.binary())}
                        | {c: column(x) for c, x in zip(("words", "tokens", "main"), stats, strict=True)})

    asked = chunks.select("chunk", "tune", "raws").mapInArrow(ask, "bucket int, chunk long, tune boolean, grams binary")
    answered = materialize(asked.groupBy("bucket").applyInArrow(answer, "bucket int, chunk long, counts binary, words long, tokens long, main long"), "counts")
    distinct, tokens, main = (x or 0 for x in answered.agg(F.sum("words"), F.sum("tokens"), F.sum("main")).first())
    replies = answered.where("chunk >= 0").select("chunk", "bucket", "counts")

    def of(texts: pa.Table, replies: pa.Table, main: bool) -> Iterator[tuple[Chunk, tuple[np.ndarray, ...]]]:
        answers = dict(zip(replies.column("bucket").to_pylist(), replies.column("counts"), strict=True))
        return answered_counts(texts.column("raws")[0].as_py(), answers, bits, buckets, main)

    names = ("c3", "ctx", "c2", "mid", "c1")

    def tune(texts: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        for made, counts in of(texts, replies, True):
            cell = np.stack([frequency_bucket(counts[1], counts[3]), *counts])
            order = np.lexsort(cell)
            cell = cell[:, order]
            new = np.append(True, (cell[:, 1:] != cell[:, :-1]).any(axis=0))
            n = np.bincount(np.cumsum(new) - 1, np.bincount(made.triple, minlength=cell.shape[1])[order]).astype(np.int64)
            out.append(pa.table({k: pa.array(x) for k, x in zip(("b", *names, "n"), (*cell[:, new], n), strict=True)}))
        return pa.concat_tables(out)

    late = chunks.where("tune").select("chunk", "raws").groupBy("chunk").cogroup(replies.join(chunks.where("tune").select("chunk"), "chunk", "left_semi").groupBy("chunk"))
    cells = materialize(late.applyInArrow(tune, "b long, " + ", ".join(f"{c} long" for c in names) + ", n long"), "cells")
    weights = learn_weights(cells, main, distinct)

    def scored(texts: pa.Table, replies: pa.Table) -> pa.Table:
        columns: list[list] = [[], [], [], []]
        for made, (c3, context, c2, middle, c1) in of(texts, replies, False):
            w = weights[frequency_bucket(context, middle)]
            p = w[:, 0] * c3 / np.maximum(1, context) + w[:, 1] * c2 / np.maximum(1, middle) + w[:, 2] * c1 / max(1, tokens) + w[:, 3] / (distinct + 1)
            each = (c1 > 0, np.log10((c1 + 1) / (tokens + distinct + 1)), np.log10(p))
            known, *sums = (np.add.reduceat(x[made.triple], made.stops - made.sizes, dtype=np.float64) for x in each)
            for column, x in zip(columns, (made.sizes, known.astype(np.int64), *sums), strict=True):
                column.append(x)
        ids = pa.ipc.open_stream(texts.column("ids")[0].as_py()).read_all().column("i")
        return pa.table({"i": ids} | {k: pa.array(np.concatenate(x)) for k, x in zip(("n_tokens", "n_known", "base_score", "score"), columns, strict=True)})

    out = chunks.select("chunk", "ids", "raws").groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(scored, f"i {kind}, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("i").alias(id_col), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
