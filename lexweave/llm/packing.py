"""Vector bin packing of tokenised documents into training sequences."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import materialize

#: Turns of one conversation (and range of turns) that one task takes in a row; more are dealt to several.
_TURNS = 4096
#: Turns of a task, with many of them.
_PART_TURNS = 20_000
#: Texts of these characters only are split alike by both tokenizer libraries whatever their Unicode version.
_OTHER = re.compile("[^\t\n\r -~¡-¬®-ɏ‐-‧€]")
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(path: str):
    """text -> ids of the byte-level BPE file at path, special tokens' strings being ordinary text.

    The file's merges are in the order of their ids, so the same ids come from rank-based merging, which takes a sixth
    of the time; that order is checked here. Texts with characters on whose class library versions could differ go
    through the tokenizers library itself."""
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = True
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {x["content"] for x in model["added_tokens"]}
    vocab, merges = model["model"]["vocab"], model["model"]["merges"]
    merged = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in merges]
    own = lambda text: slow.encode(text, add_special_tokens=False).ids
    if merged != sorted(merged) or model["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
        return lambda text: np.array(own(text), np.uint32)
    import tiktoken

    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
    ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in special}
    fast = tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda text: np.array(own(text) if _OTHER.search(text) else fast(text), np.uint32)


class _Pool:
    """Pieces that wait for a sequence. A bin is filled with the fitting piece of the largest dot product between its
    sizes and the room left (both as shares of the limits), until none fits."""

    def __init__(self, limits: tuple[int, int, int], held: int):
        self.limits, self.held = np.array(limits, np.float64), held
        self.sizes, self.items, self.used = np.zeros((2 * held, 3)), [None] * (2 * held), 0

    def add(self, tokens: int, loss: int, item, segments: int = 1) -> None:
        self.sizes[self.used] = tokens, segments, loss
        self.items[self.used] = item
        self.used += 1

    def bins(self, until: int) -> Iterator[list]:
        """Closed bins, until only that many pieces wait."""
        if self.used <= until:
            return
        n, share = self.used, self.sizes[: self.used] / self.limits
        t, s, v = (np.ascontiguousarray(share[:, k]) for k in range(3))
        here, left = np.ones(n, bool), n
        while left > until:
            room, bin_ = np.ones(3), []
            while True:
                fits = here & (t <= room[0] + 1e-12) & (s <= room[1] + 1e-12) & (v <= room[2] + 1e-12)
                k = int(np.argmax(np.where(fits, t * room[0] + s * room[1] + v * room[2], -1.0)))
                if not fits[k]:
                    break
                bin_.append(self.items[k])
                room -= share[k]
                here[k] = False
                left -= 1
            yield bin_
        rest = np.flatnonzero(here)
        self.sizes[: len(rest)] = self.sizes[rest]
        self.items[: len(rest)] = [self.items[k] for k in rest]
        self.used = len(rest)


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", loss_from: str | None = None,
    max_tokens: int = 1024, max_segments: int = 64, max_loss: int = 1024, end_id: int = 0, held: int = 2048, digest: bool = False,
) -> DataFrame:
    """Pack tokenised texts into sequences under limits on tokens, segments and loss-bearing tokens at once.

    A text's ids are those of the tokenizer file, then end_id. Ids bear loss from loss_from (a column with the number
    of leading ids that bear none; null: none of them; by default all bear loss). A text longer than a limit is cut
    into full pieces; what is left of it is placed whole, by the dot-product heuristic, among at most 2 * held waiting
    pieces of its own partition, so memory is bounded, no id is shuffled and a lost task can be run again by itself.

    One row a piece: the id column, start, length, doc_tokens, sequence_id (unique, not gapless), offset, segment, and
    ids (or, with digest, ids_crc32: CRC-32 of the ids as little-endian unsigned 32-bit integers).

    Null text: taken as empty, a piece with end_id alone. Null or repeated ids: each row is a text of its own. Very
    long texts: cut. Ties: the earliest row. Empty table: no rows. Other columns, whatever their names: not read."""
    kind = docs.schema[id_col].dataType.simpleString()
    name = "ids_crc32" if digest else "ids"
    typed = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), (F.coalesce(F.col(loss_from), F.lit(0)).cast("int") if loss_from else F.lit(0)).alias("l"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, pool = encoder(tokenizer), _Pool((max_tokens, max_segments, max_loss), held)
        at = TaskContext.get().partitionId() << 40
        keys: pa.DataType | None = None

        def rows(bins) -> pa.RecordBatch:
            nonlocal at
            cols: list[list] = [[] for _ in range(8)]
            for b in bins:
                offset = 0
                for k, (key, start, ids, total) in enumerate(b):
                    for c, x in zip(cols, (key, start, len(ids), total, at, offset, k, ids), strict=True):
                        c.append(x)
                    offset += len(ids)
                at += 1
            out = [pa.array(zlib.crc32(x.astype("<u4").tobytes()) for x in cols[7])] if digest else [pa.array([x.astype(np.int32) for x in cols[7]], pa.list_(pa.int32()))]
            if digest:
                out = [out[0].cast(pa.int64())]
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], keys), *(pa.array(c, pa.int64()) for c in cols[1:6]), pa.array(cols[6], pa.int32()), *out],
                ["i", "start", "length", "doc_tokens", "sequence_id", "offset", "segment", name],
            )

        for batch in batches:
            keys, done = batch.column(0).type, []
            for key, text, plain in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                ids = np.append(encode(text.as_py()), np.uint32(end_id))
                start, n = 0, len(ids)
                while start < n:
                    size = min(n - start, max_tokens, max(0, plain - start) + max_loss)
                    item = (key, start, ids[start : start + size], n)
                    loss = size - min(size, max(0, plain - start))
                    start += size
                    if start < n and max_segments >= 1 and size == max_tokens:
                        done.append([item])
                    else:
                        pool.add(size, loss, item)
                        if pool.used == 2 * held:
                            done += pool.bins(held)
                if len(done) >= 4096:
                    yield rows(done)
                    done = []
            if done:
                yield rows(done)
        if pool.used:
            yield rows(pool.bins(0))

    out = typed.mapInArrow(run, f"i {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, segment int, {name} {'long' if digest else 'array<int>'}")
    return out.withColumnRenamed("i", id_col)


class _Exchanges:
    """Cuts the turns of a conversation into pieces under the limits. An exchange is a run of turns that bear no loss and
    the run that follows and bears it; pieces end between exchanges, but for an exchange that is beyond a limit itself."""

    def __init__(self, limits: tuple[int, int, int]):
        self.limits, self.piece, self.exchange, self.done = limits, [], [], []
        self.bears = self.free = False

    @staticmethod
    def sizes(segments: list[tuple]) -> tuple[int, int, int]:
        """Tokens, segments, tokens that bear loss of (key, start, ids, total, bears) segments."""
        return sum(len(x[2]) for x in segments), len(segments), sum(len(x[2]) for x in segments if x[4])

    def _fits(self, segments: list[tuple]) -> bool:
        return all(a <= b for a, b in zip(self.sizes(segments), self.limits, strict=True))

    def _close(self) -> None:
        """The exchange is over: it joins the piece, or begins one."""
        if not self._fits(self.piece + self.exchange):
            self._emit()
        self.piece += self.exchange
        self.exchange, self.free = [], False

    def _cut(self, segment: tuple) -> None:
        key, start, ids, total, bears = segment
        while len(ids):
            tokens, segments, loss = self.sizes(self.piece)
            size = min(len(ids), self.limits[0] - tokens, self.limits[2] - loss if bears else len(ids)) if segments < self.limits[1] else 0
            if size > 0:
                self.piece.append((key, start, ids[:size], total, bears))
                start, ids = start + size, ids[size:]
            else:
                self._emit()

    def _emit(self) -> None:
        if self.piece:
            self.done.append(self.piece)
            self.piece = []

    def add(self, key: tuple, ids: np.ndarray, bears: bool) -> None:
        if self.bears and not bears:
            self._close()
        self.bears = bears
        self.exchange.append((key, 0, ids, len(ids), bears))
        if self.free or not self._fits(self.exchange):
            if not self.free:
                self._emit()
            for segment in self.exchange:
                self._cut(segment)
            self.exchange, self.free = [], True

    def end(self) -> list[list[tuple]]:
        """The pieces; the next turn is of another conversation."""
        self._close()
        self._emit()
        self.bears, done, self.done = False, self.done, []
        return done


def pack_conversations(
    turns: DataFrame, tokenizer: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", bearing: tuple[str, ...] = ("assistant",),
    max_tokens: int = 4096, max_segments: int = 64, max_loss: int = 3072, end_id: int = 0, held: int = 512, digest: bool = False,
) -> DataFrame:
    """Pack whole conversations into sequences under limits on tokens, segments (turns) and loss-bearing tokens at once: the
    examples that are placed are conversations, with the tokens, turns and loss-bearing tokens of all their turns.

    A turn's ids are those of the tokenizer file, then end_id; turns of a role in bearing bear loss. A conversation
    beyond a limit is cut between exchanges (a question and its answer), an exchange beyond one is cut freely.
    Conversations are brought together by one shuffle by ranges of conversation and turn: max_segments turns in a row
    stay in one task, the turns of one such range beyond 4,096 rows (a hot key, or none) are dealt to several. Tasks stream
    their rows, so memory is bounded by an exchange and the 2 * held waiting pieces.

    One row a turn's segment: the conversation and turn columns, start, length, turn_tokens, sequence_id (unique, not
    gapless), example (the piece in its sequence, from 0), offset, bears_loss, and ids (or, with digest, ids_crc32, as pack()).

    Null text: end_id alone. Null role: bears no loss. Null conversation: each row is one by itself. Null turns come
    first; equal ones go by a hash of role and text. Very long texts: cut. Empty table: no rows. Other columns are not read."""
    name, limits = "ids_crc32" if digest else "ids", (max_tokens, max_segments, max_loss)
    rows = turns.select(F.col(conv_col).alias("c"), F.col(turn_col).alias("n"), F.coalesce(F.col(role_col).isin(*bearing), F.lit(False)).alias("b"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.withColumn("range", F.floor(F.col("n") / max_segments)).withColumn("h", F.xxhash64("b", "t"))
    large = materialize(rows.groupBy(F.col("c").alias("hot"), F.col("range").alias("at")).agg(F.ceil(F.count("*") / _TURNS).alias("ways")).where("ways > 1"), "large")
    if large.isEmpty():
        rows = rows.withColumn("salt", F.lit(0).cast("long"))
    else:
        rows = rows.join(large, F.col("c").eqNullSafe(F.col("hot")) & F.col("range").eqNullSafe(F.col("at")), "left")
        rows = rows.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("n", "h"), "ways"), F.lit(0))).drop("hot", "at", "ways")
    key = ["c", "range", "salt"]
    count = rows.count()
    parts = max(1, min(turns.sparkSession.sparkContext.defaultParallelism, count // 500), count // _PART_TURNS)
    dealt = rows.repartitionByRange(parts, *key).sortWithinPartitions(*key, "n", "h").select("c", "n", "b", "t", "range", "salt")
    kinds = [turns.schema[x].dataType.simpleString() for x in (conv_col, turn_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, pool, cut = encoder(tokenizer), _Pool(limits, held), _Exchanges(limits)
        at, last, types, done = TaskContext.get().partitionId() << 40, None, None, []

        def table(bins: list[list]) -> pa.RecordBatch:
            nonlocal at
            cols: list[list] = [[] for _ in range(9)]
            for b in bins:
                offset = 0
                for example, piece in enumerate(b):
                    for (c, n), start, ids, total, bears in piece:
                        value = zlib.crc32(ids.astype("<u4").tobytes()) if digest else ids.astype(np.int32)
                        for col, x in zip(cols, (c, n, start, len(ids), total, at, example, offset, bears), strict=True):
                            col.append(x)
                        values.append(value)
                        offset += len(ids)
                at += 1
            out = [pa.array(x, t) for x, t in zip(cols, [*types, *[pa.int64()] * 4, pa.int32(), pa.int64(), pa.bool_()], strict=True)]
            made = pa.array(values, pa.int64() if digest else pa.list_(pa.int32()))
            values.clear()
            return pa.RecordBatch.from_arrays([*out, made], ["c", "n", "start", "length", "turn_tokens", "sequence_id", "example", "offset", "bears_loss", name])

        values: list = []

        def place(pieces: list[list[tuple]]) -> None:
            for piece in pieces:
                tokens, segments, loss = cut.sizes(piece)
                pool.add(tokens, loss, piece, segments)
                if pool.used == 2 * held:
                    done.extend(pool.bins(held))

        for batch in batches:
            types = [batch.column(0).type, batch.column(1).type]
            plain = [batch.column(k).to_pylist() for k in (0, 1, 2, 4, 5)]
            for c, n, bears, range_, salt, text in zip(*plain, batch.column(3), strict=True):
                if (c, range_, salt) != last or c is None:
                    place(cut.end())
                    last = (c, range_, salt)
                cut.add((c, n), np.append(encode(text.as_py()), np.uint32(end_id)), bears)
                place(cut.done)
                cut.done = []
                if len(done) >= 1024:
                    yield table(done)
                    done.clear()
        place(cut.end())
        done.extend(pool.bins(0))
        if done:
            yield table(done)

    schema = f"c {kinds[0]}, n {kinds[1]}, start long, length long, turn_tokens long, sequence_id long, example int, offset long, bears_loss boolean, {name} {'long' if digest else 'array<int>'}"
    return dealt.mapInArrow(run, schema).withColumnsRenamed({"c": conv_col, "n": turn_col})
