"""Sharding by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

from bisect import bisect_left
from collections import deque

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.llm.common import materialize

#: Virtual nodes a ring may have; its tables of arcs and placements are broadcast, a few numbers for each.
MOST_NODES = 1 << 16
_SPACE = 1 << 62


def ring(shards: int, virtual: int) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node, in order. A node's position depends on its shard and number alone, so
    one shard more only adds nodes."""
    if shards * virtual > MOST_NODES or shards < 1 or virtual < 1:
        raise ValueError(f"a ring has 1 to {MOST_NODES} virtual nodes")
    return sorted((xxhash.xxh64_intdigest(f"{s}/{v}") % _SPACE, s) for s in range(shards) for v in range(virtual))


def place(nodes: list[tuple[int, int]], loads: list[int], capacity: list[int]) -> list[tuple[int, int, int, int]]:
    """Where each arc's keys go: (arc, from, shard, slot), meaning that the keys of an arc from its from-th on, until
    the arc's next entry, take slots of shard from slot on.

    Arc k holds the keys between node k - 1 and node k. A node takes its own arc's keys while its shard has room; what
    is left over continues clockwise, first come first served, to the next node whose shard has room."""
    full, out, over = [0] * len(capacity), [], []

    def give(arc: int, start: int, n: int, shard: int) -> int:
        n = min(n, capacity[shard] - full[shard])
        if n > 0:
            out.append((arc, start, shard, full[shard]))
            full[shard] += n
        return max(n, 0)

    for k, (_, shard) in enumerate(nodes):
        done = give(k, 0, loads[k], shard)
        over.append((k, done, loads[k] - done))
    waiting: deque = deque()
    for turn in range(2 * len(nodes)):
        k = turn % len(nodes)
        shard = nodes[k][1]
        if turn < len(nodes) and over[k][2]:
            waiting.append(over[k])
        while waiting and full[shard] < capacity[shard]:
            arc, start, n = waiting.popleft()
            done = give(arc, start, n, shard)
            if n > done:
                waiting.appendleft((arc, start + done, n - done))
    if waiting:
        raise ValueError("the shards' capacities are smaller than the load")
    return sorted(out)


def pieces_of(loads: dict[int, int], most: int) -> dict[int, int]:
    """Into how many pieces the arcs with more than most rows are cut."""
    return {arc: -(-n // most) for arc, n in loads.items() if n > most}


def shard(
    rows: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", virtual: int = 128, slack: float = 0.0, split: float = 32.0
) -> DataFrame:
    """Assign every row to one of shards shards, none of which gets more rows than its bound.

    A row's place on the ring is a hash of its id (of its text where the id is null). The bound is (1 + slack) times
    the mean; with no slack the first shards get one row more than the others where the mean is not whole, and the law
    is "rows": counts are at most one apart. Keys that overflow a full shard go on clockwise, and everything else stays
    where plain consistent hashing has it (home_shard).

    Ids, sizes and places are written once. They are shuffled by arc of the ring: rows of an arc are numbered there,
    and the driver, which gets a count for each arc (at most MOST_NODES), works out which numbers go to which shard and
    slot. An arc with more than split times the mean (one id, or one text without an id, that very many rows have) is
    cut into pieces by a number that its rows were written with; a piece is numbered from the end of the one before.

    Returns the id, size (UTF-8 bytes of the text plus 16), text_crc32, law, shard, slot (gapless from 0 in a shard),
    grown_shard (null under this law), home_shard, overflowed. Null text: no bytes; its crc32 is that of nothing (0).
    Null ids: by text. Repeated rows: one place on the ring, a slot each. Ties on the ring: by id, then text. Empty
    table: no rows. Columns besides the two named are not read."""
    spark = rows.sparkSession
    nodes = ring(shards, virtual)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    base = rows.select(
        F.col(id_col).alias("i"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("crc"),
        F.when(F.col(id_col).isNull(), F.xxhash64(text)).otherwise(F.xxhash64(F.col(id_col))).alias("h"),
    ).withColumn("p", F.shiftrightunsigned("h", 2))
    bits = min(12, len(nodes).bit_length())
    width = _SPACE >> bits
    cells = {c: [] for c in range(1 << bits)}
    for k, (p, _) in enumerate(nodes):
        cells[p // width].append((p, k))
    points = [p for p, _ in nodes]
    table = spark.createDataFrame(
        [(c, [p for p, _ in inside], bisect_left(points, c * width)) for c, inside in cells.items()], "cell long, inside array<long>, before int"
    )
    found = base.withColumn("cell", F.shiftrightunsigned("p", 62 - bits)).join(F.broadcast(table), "cell")
    arc = ((F.col("before") + F.size(F.filter("inside", lambda x: x < F.col("p")))) % len(nodes)).cast("int")
    found = materialize(found.select("i", "size", "crc", "h", arc.alias("arc"), F.monotonically_increasing_id().alias("salt")), "places")

    load = dict(map(tuple, found.groupBy("arc").count().collect()))
    loads, total = [load.get(k, 0) for k in range(len(nodes))], sum(load.values())
    # Numbers of salt fall in pieces by a hash, so pieces are about equal; there are at most 1 / split as many as arcs.
    cut = pieces_of(load, max(1000, int(split * total / len(nodes))))
    first: dict[int, list[int]] = {}
    if cut:
        found = found.join(F.broadcast(spark.createDataFrame(list(cut.items()), "arc int, pieces int")), "arc", "left")
        found = found.withColumn("piece", F.coalesce(F.pmod(F.xxhash64("salt"), F.col("pieces")), F.lit(0)).cast("int"))
        sizes: dict[int, dict[int, int]] = {}
        for k, piece, n in found.where("pieces is not null").groupBy("arc", "piece").count().collect():
            sizes.setdefault(k, {})[piece] = n
        for k, by in sizes.items():
            first[k] = [0]
            for piece in range(cut[k] - 1):
                first[k].append(first[k][-1] + by.get(piece, 0))
    else:
        found = found.withColumn("piece", F.lit(0))
    if slack:
        bound = [int(-(-total * (1 + slack) // shards))] * shards
    else:
        bound = [total // shards + (s < total % shards) for s in range(shards)]
    placed: dict[int, list] = {}
    for k, start, s, slot in place(nodes, loads, bound):
        placed.setdefault(k, []).append((start, s, slot))
    where = spark.createDataFrame(
        [(k, nodes[k][1], x, first.get(k, [0])) for k, x in placed.items()], "arc int, home int, parts array<struct<start: long, shard: int, slot: long>>, first array<long>"
    )

    order = Window.partitionBy("arc", "piece").orderBy("h", "i", "crc", "size")
    numbered = found.select("i", "size", "crc", "h", "arc", "piece").withColumn("n", F.row_number().over(order).cast("long") - 1)
    out = numbered.join(F.broadcast(where), "arc").withColumn("n", F.col("n") + F.get("first", F.col("piece")))
    out = out.withColumn("part", F.element_at(F.filter("parts", lambda x: x["start"] <= F.col("n")), -1))
    return out.select(
        F.col("i").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bounded" if slack else "rows").alias("law"), F.col("part.shard").alias("shard"),
        (F.col("part.slot") + F.col("n") - F.col("part.start")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        F.col("home").alias("home_shard"), (F.col("home") != F.col("part.shard")).alias("overflowed"),
    )
