"""Compression of vectors to codes: a codebook of integer entries for each part, nearest entries found by Exponion search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import discard, materialize
from lexweave.llm.topk import finite

#: Rows whose parts are compared at a time, entries of a codebook at most, labels whose sums are broadcast at most.
_ROWS, _MOST, _LABELS = 2048, 256, 100_000
_TOP = (1 << 63) - 1


class Codebook:
    """The entries of one part, and for each entry all entries by their distance from it."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        apart = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        self.near = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.near, axis=1)
        self.compared = 0

    def search(self, vectors: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each vector (ties to the smaller index) and the squared distance, beginning at entry start.

        An entry no farther from x than start is, at distance u, lies within 2u of start: so of start's list only
        entries of squared distance 4u^2 or less are compared with x. All numbers are exact integers."""
        entries, k = self.entries, len(self.entries)
        reach = 4 * ((vectors - entries[start]) ** 2).sum(axis=1)
        within = np.zeros(len(vectors), np.int64)
        for a in np.unique(start):
            these = np.flatnonzero(start == a)
            within[these] = np.searchsorted(self.apart[a], reach[these], side="right")
        row = np.repeat(np.arange(len(vectors)), within)
        first = np.cumsum(within) - within
        entry = self.near[start[row], np.arange(len(row)) - first[row]]
        self.compared += len(row)
        # The smallest distance, then the smallest index, as one number.
        best = np.minimum.reduceat(((vectors[row] - entries[entry]) ** 2).sum(axis=1) * k + entry, first)
        return (best % k).astype(np.int64), best // k


def _rows(column: pa.Array, width: int, kind: type) -> np.ndarray:
    """Vectors as rows of a matrix, with zeros after those of less than width components."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), kind)
    out[np.arange(width)[None, :] < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _long(x: int) -> int:
    return min(int(x), _TOP)


def compress(
    vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """id, code, error, label_error and codebooks_sha256 of each vector, whose components x count as floor(scale * x).

    Vectors are cut into equal parts. The codebook of a part begins with that part of the entries vectors of smallest
    ids (ties: the smaller vector; null ids last). Each round finds every part's nearest entry (Codebook.search, from the
    entry that the round before found, 0 at first) and replaces each used entry by the floor of its parts' mean; after the
    rounds, entries are found once more. code has two hexadecimal digits a part, error is the sum of squared distances,
    label_error its sum over rows of the same label (null: the same), both set to the limit of a long beyond it.

    Each round is a written table of integers with codes, and one aggregate of sums by part and entry that a
    task adds up before the shuffle; the driver holds the codebooks alone (entries times components). Sums by label
    are joined as a broadcast up to 100,000 labels, beyond by a shuffle that may split a hot label.

    Vectors that are null or hold null or non-finite components are left out. Repeated rows each count. Vectors shorter
    than the longest count as if zeros followed, as do lengths that parts does not divide. Fewer vectors than
    entries: as many entries. No vector: no rows. Components beyond a long are set to its limits; large ones are exact,
    by slower arithmetic. Columns besides the three named are not read."""
    if not 1 <= entries <= _MOST:
        raise ValueError(f"1 to {_MOST} entries")
    spark = vectors.sparkSession
    kept = vectors.where(finite(F.col(vector_col))).select(
        F.col(id_col).alias("i"), F.col(label_col).alias("l"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale)).alias("v")
    )
    whole = cur = materialize(kept, "integers")
    size = F.when(F.size("v") > 0, F.greatest(F.array_max("v").cast("decimal(38,0)"), -F.array_min("v").cast("decimal(38,0)")))
    longest, largest = whole.agg(F.max(F.size("v")), F.max(size)).first()
    step = -(-(longest or 0) // parts) or 1
    # A distance times the entries' number has to fit a long.
    kind = np.int64 if 4 * step * (int(largest or 0) + 1) ** 2 * 4 * _MOST < _TOP else object
    begun = whole.orderBy(F.asc_nulls_last("i"), "v").limit(entries).select("v").collect()
    book = np.array([r["v"] + [0] * (parts * step - len(r["v"])) for r in begun], kind).reshape(len(begun), parts, step).transpose(1, 0, 2)

    def assigned(table: DataFrame, book: np.ndarray, last: bool) -> DataFrame:
        """table with the codes (bytes) of each row, and the error where last."""
        sent, coded = spark.sparkContext.broadcast(book), "c" in table.columns

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            books = [Codebook(x) for x in sent.value]
            for whole in batches:
                for at in range(0, len(whole), _ROWS):
                    batch = whole.slice(at, _ROWS)
                    x = _rows(batch.column(2), parts * step, kind).reshape(len(batch), parts, step)
                    old = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, parts).astype(np.int64) if coded else np.zeros((len(batch), parts), np.int64)
                    found = [b.search(x[:, p], old[:, p]) for p, b in enumerate(books)]
                    codes = np.stack([a for a, _ in found], axis=1).astype(np.uint8)
                    if last:
                        error = sum(d.astype(object) for _, d in found)
                        columns = [batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([_long(e) for e in error], pa.int64())]
                    else:
                        columns = [batch.column(0), batch.column(1), batch.column(2), pa.array([c.tobytes() for c in codes], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["i", "l", *(("c", "error") if last else ("v", "c"))])

        types = {f.name: f.dataType.simpleString() for f in table.schema}
        return table.mapInArrow(assign, f"i {types['i']}, l {types['l']}, " + ("c binary, error long" if last else "v array<bigint>, c binary"))

    def moved(table: DataFrame, book: np.ndarray) -> np.ndarray:
        """Each used entry replaced by the floor of the mean of its parts."""
        width, count = book.shape[1], book.shape[0] * book.shape[1]

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sizes, sums = np.zeros(count, np.int64), np.zeros((count, step), object)
            for batch in batches:
                for at in range(0, len(batch), _ROWS):
                    part = batch.slice(at, _ROWS)
                    x = _rows(part.column(0), parts * step, kind).reshape(-1, step)
                    codes = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(-1, parts).astype(np.int64)
                    to = (codes + np.arange(parts) * width).ravel()
                    order = np.argsort(to, kind="stable")
                    entry, first = np.unique(to[order], return_index=True)
                    sums[entry] += np.add.reduceat(x[order], first)
                    sizes += np.bincount(to, minlength=count)
            used = np.flatnonzero(sizes)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sizes[used]), pa.array([[str(s) for s in sums[u]] for u in used], pa.list_(pa.string()))], ["e", "n", "s"])

        each = table.select("v", "c").mapInArrow(add, "e long, n long, s array<string>")
        total = each.groupBy("e").agg(F.sum("n").alias("n"), *(F.sum(F.col("s")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(step)))
        new = book.copy()
        for r in total.collect():
            new[r["e"] // width, r["e"] % width] = [int(r[f"s{k}"]) // r["n"] for k in range(step)]
        return new

    for _ in range(rounds if len(begun) else 0):
        old, cur = cur, materialize(assigned(cur, book, False), "codes")
        discard(old)
        book = moved(cur, book)
    digest = hashlib.sha256(",".join(str(int(x)) for x in book.ravel()).encode()).hexdigest()
    if not len(begun):
        out = cur.select("i", "l", F.lit(b"").alias("c"), F.lit(0).cast("long").alias("error"))
    else:
        out = materialize(assigned(cur, book, True), "errors")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_TOP).cast("decimal(38,0)")).cast("long")
    sums = materialize(out.groupBy("l").agg(total.alias("label_error")), "labels")
    few = sums.count() <= _LABELS
    ours = out.select("i", F.col("l").alias("own"), "c", "error")
    joined = ours.join(F.broadcast(sums) if few else sums, F.col("own").eqNullSafe(F.col("l")))
    return joined.select(F.col("i").alias(id_col), F.lower(F.hex("c")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
