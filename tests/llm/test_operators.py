"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeats and empty tables."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from lexweave.llm import bpe, itq, lm, quality, sharding, topk, warc
from lexweave.llm.common import components
from lexweave.llm.linededup import boilerplate, line_dedup
from lexweave.llm.ngramjoin import _pack_sets, _unpack_sets, bands_for, ngram_join
from lexweave.llm.packing import _Pool, encoder, pack, pack_conversations

DOCS = "doc_id long, text string, source string, ids long, t string"
JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def words(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice("alpha Beta gamma delta eps zeta eta theta iota kappa lambda mu nu xi".split()) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank, short and long texts, other scripts, repeated rows and ids."""
    rng = random.Random(1)
    long = words(rng, 30_000)
    texts = [None, "", "   ", "one", "two words", "  é̄ 你好 \U0001f600\U0001f600 café x\x1cy ١٢٣", long, "same text of a few words here", "same text of a few words here"]
    rows = [(i, t, "s", 1, "x") for i, t in enumerate(texts)] + [(7, texts[7], "s", 1, "x"), (None, "no id but six words of text", "s", 2, "y"), (None, None, None, None, None)]
    rows += [(100 + i, words(rng, rng.randrange(1, 900)), f"s{i % 5}", 3, "z") for i in range(60)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_ring_adds_shards_without_moving_others():
    few, more = sharding.ring(10, 64), sharding.ring(11, 64)
    assert [x for x in more if x[1] != 10] == few
    with pytest.raises(ValueError):
        sharding.ring(sharding.MOST_NODES, 2)


def test_place_fills_every_shard_and_loses_nothing():
    rng = random.Random(3)
    nodes = sharding.ring(7, 16)
    loads = [rng.randrange(50) for _ in nodes]
    loads[5] = 2000
    total = sum(loads)
    bound = [total // 7 + (s < total % 7) for s in range(7)]
    parts = sharding.place(nodes, loads, bound)
    seen, got = Counter(), Counter()
    for (arc, start, shard, slot), after in zip(parts, [*parts[1:], (None, 0, 0, 0)], strict=True):
        n = (after[1] if after[0] == arc else loads[arc]) - start
        assert slot == 0 or n > 0
        seen[arc] += n
        got[shard] += n
    assert [seen[a] for a in range(len(nodes))] == loads and [got[s] for s in range(7)] == bound


def test_place_is_a_walk_of_the_ring_key_by_key():
    """Each key in its turn goes to its own node while that has room; the rest go clockwise, first come first served."""
    rng = random.Random(9)
    nodes = sharding.ring(5, 8)
    loads = [rng.choice([0, 1, 3, 40, 7]) for _ in nodes]
    total = sum(loads)
    bound = [total // 5 + (s < total % 5) for s in range(5)]
    room, where, over = list(bound), {}, []
    for arc, (_, shard) in enumerate(nodes):
        for n in range(loads[arc]):
            if room[shard]:
                room[shard] -= 1
                where[arc, n] = shard
            else:
                over.append((arc, n))
    at = 0
    waiting = []
    while over or waiting:
        arc = at % len(nodes)
        waiting += [x for x in over if x[0] == arc] if at < len(nodes) else []
        over = [x for x in over if x[0] != arc] if at < len(nodes) else over
        while waiting and room[nodes[arc][1]]:
            room[nodes[arc][1]] -= 1
            where[waiting.pop(0)] = nodes[arc][1]
        at += 1
    got = {}
    parts = sharding.place(nodes, loads, bound)
    for (arc, start, shard, _), after in zip(parts, [*parts[1:], (None, 0, 0, 0)], strict=True):
        for n in range(start, after[1] if after[0] == arc else loads[arc]):
            got[arc, n] = shard
    assert got == where


def test_shard_moves_few_keys(spark):
    table = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    for slack, most in ((0.0, 0.08), (0.05, 0.06)):
        few, more = (sharding.shard(table, n, slack=slack).select("doc_id", F.col("shard").alias(f"s{n}")) for n in (40, 41))
        moved = few.join(more, "doc_id").where("s40 <> s41")
        assert 1 / 41 * 0.8 < moved.count() / 40_000 < most


def test_shard_splits_hot_keys(spark):
    """One row 10,000 times over, and many rows without an id, do not meet in one task."""
    hot = spark.range(10_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("hot").alias("text"))
    none = spark.range(8_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("none").alias("text"))
    table = hot.unionByName(none).unionByName(spark.range(2_000).select(F.col("id").alias("doc_id"), F.lit("y").alias("text"))).repartition(5)
    out = sharding.shard(table, 9, virtual=16, split=4.0)
    rows = out.collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert len(rows) == 20_000 and all(sorted(x) == list(range(len(x))) for x in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sharding.pieces_of({3: 10_000, 4: 5}, 1000) == {3: 10}


def test_shard(odd, empty):
    rows = sharding.shard(odd, 7, virtual=32).collect()
    assert len(rows) == odd.count() and {r.law for r in rows} == {"rows"}
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    want = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in odd.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    assert all(r.overflowed or r.shard == r.home_shard for r in rows)
    assert sharding.shard(empty, 7).count() == 0
    loose = sharding.shard(odd, 7, virtual=32, slack=0.5).collect()
    assert sum(r.overflowed for r in loose) < sum(r.overflowed for r in rows)
    assert max(Counter(r.shard for r in loose).values()) <= -(-len(rows) * 1.5 // 7)


def test_pack(odd, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(JSON)
    rows = pack(odd, JSON, max_segments=5).collect()
    sequences, texts = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
        texts[(r.doc_id, r.doc_tokens)].append(r)
    for group in sequences.values():
        group.sort(key=lambda r: r.offset)
        assert [r.offset for r in group] == np.cumsum([0, *(r.length for r in group)])[:-1].tolist()
        assert sum(r.length for r in group) <= 1024 and len(group) <= 5
    want = Counter((r.doc_id, *tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0) for r in odd.collect())
    got = Counter()
    pieces = Counter((r.doc_id, r.start, r.doc_tokens, tuple(r.ids)) for r in rows)
    for ids, n in want.items():
        for start in range(0, len(ids) - 1, 1024):
            part = ids[1:][start : start + 1024]
            got[(ids[0], start, len(ids) - 1, part)] += n
    assert pieces == got
    digests = pack(odd, JSON, digest=True).collect()
    assert Counter(r.ids_crc32 for r in digests) == Counter(zlib.crc32(np.array(p[3], "<u4").tobytes()) for p in got.elements())
    assert pack(empty, JSON).count() == 0


def test_pack_limits_loss(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, words(rng, rng.randrange(1, 200)), rng.randrange(100)) for i in range(80)], "doc_id long, text string, plain int")
    plain = {r.doc_id: r.plain for r in docs.collect()}
    sequences = defaultdict(list)
    for r in pack(docs, JSON, loss_from="plain", max_tokens=512, max_segments=6, max_loss=200).collect():
        sequences[r.sequence_id].append(r)
    for group in sequences.values():
        loss = sum(r.length - min(r.length, max(0, plain[r.doc_id] - r.start)) for r in group)
        assert loss <= 200 and sum(r.length for r in group) <= 512 and len(group) <= 6


@pytest.mark.parametrize("limits", [(64, 8, 40), (100, 3, 100), (50, 50, 10)])
def test_bins_are_those_of_the_dot_product_heuristic(limits):
    """Piece by piece in Python: of the pieces that fit the one with the largest dot product, the earliest of equal ones."""
    rng = random.Random(sum(limits))
    waiting = []
    for k in range(120):
        t = rng.randrange(1, min(limits[0], 45))
        waiting.append((t, 1, min(rng.randrange(t + 1), limits[2]), k))
    pool = _Pool(limits, 100)
    for t, _, loss, k in waiting:
        pool.add(t, loss, k)
    got, want = list(pool.bins(30)), []
    while len(waiting) > 30:
        room, bin_ = [1.0, 1.0, 1.0], []
        while True:
            best = None
            for piece in waiting:
                share = [x / m for x, m in zip(piece, limits, strict=False)]
                if all(x <= r + 1e-12 for x, r in zip(share, room, strict=True)):
                    dot = share[0] * room[0] + share[1] * room[1] + share[2] * room[2]
                    if best is None or dot > best[0]:
                        best = dot, piece, share
            if best is None:
                break
            waiting.remove(best[1])
            bin_.append(best[1][3])
            room = [r - x for r, x in zip(room, best[2], strict=True)]
        want.append(bin_)
    assert got == want and sorted(pool.items[: pool.used]) == sorted(x[3] for x in waiting)


def pieces_plain(turns, limits, ids_of):
    """Of one conversation (turn, bears loss, text in order): exchanges gathered while they fit, too large ones cut freely."""
    exchanges, pieces, piece = [], [], []
    for n, bears, text in turns:
        if not exchanges or exchanges[-1][-1][1] and not bears:
            exchanges.append([])
        exchanges[-1].append((n, bears, ids_of(text)))

    def size(x):
        return sum(len(i) for *_, i in x), len(x), sum(len(i) for _, b, i in x if b)

    def fits(x):
        return all(a <= b for a, b in zip(size(x), limits))

    for e in exchanges:
        if fits(piece + e):
            piece = piece + e
            continue
        if piece:
            pieces.append(piece)
        piece = e if fits(e) else []
        if not fits(e):
            for n, bears, ids in e:
                for i in ids:
                    grown = [*piece[:-1], (n, bears, [*piece[-1][2], i])] if piece and piece[-1][0] == n else [*piece, (n, bears, [i])]
                    if not fits(grown):
                        pieces.append(piece)
                        grown = [(n, bears, [i])]
                    piece = grown
    return pieces + [piece] * bool(piece)


def test_packing_of_conversations(spark):
    """Pieces against plain Python; limits, order and fill of sequences."""
    rng, limits = random.Random(14), (1024, 12, 600)
    rows = [(c, t, ("user", "assistant", "assistant", "system", None)[rng.randrange(5)] if c % 5 else ("user", "assistant")[t % 2], words(rng, rng.randrange(60 if c % 9 else 400)) if c % 7 else None) for c in range(150) for t in range(rng.randrange(1, 12))]
    rows += [(None, t, "user", "no conversation") for t in range(3)] + [(5000, None, "user", "x"), (5001, 100, "assistant", "later"), (5001, 1, "user", "sooner")]
    table = spark.createDataFrame([(*r, "a", 1) for r in rows], "conv_id long, turn int, role string, text string, c string, n int").repartition(5)
    got = pack_conversations(table, JSON, max_tokens=1024, max_segments=12, max_loss=600).collect()
    encode, sequences, found = encoder(JSON), defaultdict(list), defaultdict(list)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        sequences[r.sequence_id].append(r)
        found[r.sequence_id, r.example].append((r.conv_id, r.turn, r.start, tuple(r.ids)))
    want, by = Counter(), defaultdict(list)
    for k, (c, t, role, text) in enumerate(rows):
        by[(c, t // 12 if t is not None else None) if c is not None else k].append((t, role == "assistant", text, c))
    for turns in by.values():
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0))
        at = defaultdict(int)
        for piece in pieces_plain([x[:3] for x in turns], limits, lambda text: [*encode(text or "").tolist(), 0]):
            segments = []
            for n, _, ids in piece:
                segments.append((turns[0][3], n, at[n], tuple(ids)))
                at[n] += len(ids)
            want[tuple(segments)] += 1
    assert Counter(map(tuple, found.values())) == want
    for s in sequences.values():
        assert sum(r.length for r in s) <= 1024 and len(s) <= 12 and sum(r.length for r in s if r.bears_loss) <= 600
        assert [r.offset for r in s] == [sum(x.length for x in s[:k]) for k in range(len(s))]
    digests = pack_conversations(table, JSON, max_tokens=1024, max_segments=12, max_loss=600, digest=True)
    assert Counter(r.ids_crc32 for r in digests.collect()) == Counter(zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    assert pack_conversations(table.limit(0), JSON).count() == 0


def test_packing_of_conversations_fills_and_deals_hot_ones(spark, monkeypatch):
    from lexweave.llm import packing

    rng = random.Random(15)
    rows = [(c, t, ("user", "assistant")[t % 2], words(rng, rng.randrange(5, 40 if t % 2 == 0 else 120))) for c in range(400) for t in range(6)]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = pack_conversations(table, JSON).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.sum(F.when(F.col("bears_loss"), F.col("length"))).alias("loss")).collect()
    full = [max(r.n / 4096, (r.loss or 0) / 3072) for r in got]
    assert np.mean(full) > 0.9
    monkeypatch.setattr(packing, "_TURNS", 50)
    hot = spark.createDataFrame([(7, 1, "user", f"same {k}") for k in range(2900)] + [(None, None, "assistant", "none")] * 200, "conv_id long, turn int, role string, text string")
    many = pack_conversations(hot, JSON, max_tokens=64).collect()
    assert len({r.sequence_id >> 40 for r in many if r.conv_id == 7}) > 1 and Counter(r.conv_id for r in many if r.start == 0) == {7: 2900, None: 200}


def test_encoder_agrees_with_the_library():
    from tokenizers import Tokenizer

    slow, fast = Tokenizer.from_file(JSON), encoder(JSON)
    for text in ("", "  a\n\n b", "It's 12.5½ café!!", "你好 ١٢", "x  y \x1c z", "ßŁǅ ’s"):
        assert fast(text).tolist() == slow.encode(text, add_special_tokens=False).ids


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, id string, digest string")


def test_warc(spark, tmp_path):
    big, other = "x" * 999 + "é", "y\r\n\r\nWARC/1.1\r\n" * 100
    rows = [(1, "u1", big), (2, "u2", big), (9, None, big), (9, "u9", big), (4, "u4", "short"), (5, "u5", "short"), (6, "u6", None), (7, "u\n7", other), (8, "u8", ""), (None, "n", big), (None, "n", other)]
    table = pages(spark, [(*r, "a", "b") for r in rows]).repartition(2)
    got = warc.revisit(table, f"file://{tmp_path}/a", payload=True).collect()
    digest = {x: hashlib.sha1((x or "").encode()).hexdigest() for x in (big, other, "short", None, "")}
    want = Counter()
    for i, _, x in rows:
        top = {big: 9, other: 7}.get(x)
        again = top is not None and i != top
        want[(i, len((x or "").encode()), digest[x], "revisit" if again else "response", top if again else None)] += 1
    assert Counter((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert all((r.payload is None) == (r.record_type == "revisit") for r in got)
    assert sum(len(r.payload or b"") for r in got) == 2 * len(big.encode()) + len(other) + 10
    ids = {r.record_id: r for r in got}
    assert len(ids) == len(got) and all(ids[r.refers_to_record].payload_digest == r.payload_digest and ids[r.refers_to_record].record_type == "response" for r in got if r.refers_to is not None)
    assert warc.revisit(pages(spark, []), f"file://{tmp_path}/b").count() == 0


def test_warc_of_repeated_ids(spark, tmp_path):
    """One id and url with other payloads, with equal ones, and null ids of one url: a record id each, all references resolved."""
    big = "z" * 1500
    rows = [(1, "u", big), (1, "u", big), (1, "u", big), (1, "u", big + "!"), (1, "v", big), (0, "w", big), (None, "n", "a"), (None, "n", "b"), (None, "n", "a"), (0, "w", big + "!")]
    got = warc.revisit(pages(spark, [(*r, "a", "b") for r in rows]).repartition(3), f"file://{tmp_path}/d", payload=True).collect()
    ids = {r.record_id: r for r in got}
    assert len(ids) == len(got) == len(rows)
    again = [r for r in got if r.record_type == "revisit"]
    assert len(again) == 2 and all((ids[r.refers_to_record].id, len(ids[r.refers_to_record].payload)) == (1, r.payload_bytes) for r in again)
    assert {ids[r.refers_to_record].url for r in again} == {"u", "v"}
    with pytest.raises(ValueError):
        warc.revisit(pages(spark, []), "ftp://host/x")


def test_warc_files_are_of_the_format(spark, tmp_path):
    table = pages(spark, [(i, f"u{i}", "same " * 300 if i % 2 else f"{i} " * 400, "a", "b") for i in range(9)])
    for path in (r.path for r in warc.write_archives(table, f"file://{tmp_path}/e", file_bytes=3000).collect()):
        with gzip.open(path.removeprefix("file://")) as f:
            records = list(warc.parse(f))
        assert records[0][0]["warc-type"] == "warcinfo" and path.endswith(records[0][0]["warc-filename"]) and len(records) > 1
        for head, block in records:
            assert head["warc-block-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
            assert head["warc-type"] != "revisit" or {"warc-refers-to", "warc-refers-to-date", "warc-refers-to-target-uri", "warc-profile"} <= set(head)


def test_warc_rotates_files(spark, tmp_path):
    table = pages(spark, [(i, f"u{i}", f"{i} " * 700, "a", "b") for i in range(50)])
    manifest = warc.write_archives(table, f"file://{tmp_path}/c", file_bytes=10_000)
    assert manifest.count() > 5 and manifest.agg(F.sum("records")).first()[0] == 50
    assert warc.read_archives(manifest).select("id").distinct().count() == 50


def line_brute(rows, min_sites, keep_whole):
    sites = defaultdict(set)
    for _, t, s in rows:
        for x in (t or "").split("\n"):
            if s is not None and t is not None:
                sites[x.strip()].add(s)
    bad = {x for x, s in sites.items() if x and len(s) >= min_sites}
    out = Counter()
    for i, t, _ in rows:
        if t is None:
            out[(i, None, 0, 0, False)] += 1
            continue
        lines = t.split("\n")
        rest = [x for x in lines if x.strip() not in bad]
        exempt = len(rest) < len(lines) and not any(x.strip() for x in rest)
        cut = len(rest) < len(lines) and not (exempt and keep_whole)
        out[(i, "\n".join(rest) if cut else t, len(lines), len(lines) - len(rest) if cut else 0, exempt)] += 1
    return out


def test_line_dedup(spark, empty):
    rng = random.Random(5)
    shared = [f"shared line {k} with some words" for k in range(30)]
    rows = [(None, None, "a"), (1, "", "b"), (1, "x\n\n y ", None), (2, "licence", "s1"), (2, "licence", "s1")]
    for i in range(400):
        body = [words(rng, rng.randrange(5, 30)) for _ in range(rng.randrange(6))]
        for k, x in enumerate(shared):
            if rng.random() < (k + 1) / 150:
                body.insert(rng.randrange(len(body) + 1), x if rng.random() < 0.8 else f" {x} ")
        rows.append((i if i % 9 else None, "\n".join(body), f"site{rng.randrange(2 + i % 40)}" if i % 11 else None))
    table = spark.createDataFrame([(*r, 1, "clash", 5) for r in rows], "doc_id long, text string, source string, n_lines int, k string, r int")
    for whole in (False, True):
        got = line_dedup(table, min_sites=8, keep_whole=whole)
        assert set(got.columns) == {*table.columns, "n_removed", "exempt"}
        assert Counter((r.doc_id, r.text, r.n_lines, r.n_removed, r.exempt) for r in got.collect()) == line_brute(rows, 8, whole)
    named = line_dedup(table, min_sites=8, names=("a", "b", "c"))
    assert set(named.columns) == {*table.columns, "a", "b", "c"} and named.where("n_lines <> 1").count() == 0
    assert 5 < boilerplate(table).count() < 30
    assert line_dedup(empty).count() == 0


def test_line_dedup_of_very_many_shared_lines(spark):
    """40,000 lines on eight sites, and one line of its own, in each text."""
    shared = "\n".join(f"line {k}" for k in range(40_000))
    table = spark.createDataFrame([(i, f"{shared}\nown {i}\n{shared}", f"s{i}") for i in range(8)], "doc_id long, text string, source string")
    began = time.monotonic()
    got = line_dedup(table).collect()
    assert {(r.doc_id, r.text, r.n_removed, r.exempt) for r in got} == {(i, f"own {i}", 80_000, False) for i in range(8)}
    assert time.monotonic() - began < 90


def test_line_dedup_whole_cuts_all_that_keep_own_lines(spark):
    passage = "a long passage on many sites " * 9
    rows = [(i, f"own {i}\n{passage}\n", f"s{i}") for i in range(8)] + [(8, f"{passage}\n  ", "s1"), (9, passage, "s2"), (10, "own\n\nmore", "s3")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.doc_id: (r.text, r.exempt) for r in line_dedup(table).where("doc_id > 7").collect()} == {8: ("  ", True), 9: ("", True), 10: ("own\n\nmore", False)}
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup(table, keep_whole=True).collect()}
    assert got == {**{i: (f"own {i}\n", 1) for i in range(8)}, 8: (f"{passage}\n  ", 0), 9: (passage, 0), 10: ("own\n\nmore", 0)}


def test_pipeline_lines_without_white_space_around(spark):
    import corpus_pipeline

    text = lambda k, end: f"a longer line of the document's own {k}\n\r\nlicence{end}"
    rows = [(k, text(k, "\r" if k % 2 else "\t"), "en", f"s{k}", 0) for k in range(8)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_deduplicated(spark, table, "").collect()}
    assert got == {k: f"a longer line of the document's own {k}\n\r" for k in range(8)}


def test_interpolated(odd, empty):
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 0
    got = lm.interpolated(odd, train).collect()
    rows = odd.withColumn("train", F.coalesce(train, F.lit(False))).collect()
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    counts = Counter(w for r in rows if r.train for w in tokens(r.text))
    total, types = sum(counts.values()), len(counts)
    want = Counter()
    for r in rows:
        w = tokens(r.text)
        want[(r.doc_id, len(w), sum(counts[x] > 0 for x in w), total, round(sum(np.log10((counts[x] + 1) / (total + types + 1)) for x in w), 6))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert lm.interpolated(empty, F.lit(True)).count() == 0
    assert all(r.train_tokens == 0 and np.isfinite(r.score) for r in lm.interpolated(odd, F.lit(False)).collect())


def trigram_brute(rows, train, tune_one_in=10, rounds=30):
    """Scores by counts taken in Python, and expectation-maximisation token by token on exact estimates."""
    tokens = {i: ["<2>", "<1>", *t.split(), "</>"] for i, t in rows}
    tuning = {i for i, t in rows if train(i) and zlib.crc32(t.encode()) % tune_one_in == 0}

    def counts(ids):
        c = [Counter(), Counter(), Counter()]
        for i in ids:
            w = tokens[i]
            c[0].update(w[1:])
            c[1].update(zip(w, w[1:], strict=False))
            c[2].update(zip(w, w[1:], w[2:], strict=False))
        return c, sum(c[0].values()) - c[0]["<1>"]

    every, main = counts([i for i, _ in rows if train(i)]), counts([i for i, _ in rows if train(i) and i not in tuning])
    types = len(every[0][0]) - 1

    def estimates(c, n, u, v, w):
        context = c[1][u, v]
        b = lm.ONE_WORD + int(np.log2(context)) if context else 1 + int(np.log2(c[0][v])) if c[0][v] else 0
        return b, np.array([c[2][u, v, w] / context if context else 0, c[1][v, w] / c[0][v] if c[0][v] else 0, c[0][w] / n, 1 / (types + 1)])

    cells, weights = defaultdict(list), {}
    for i in tuning:
        for gram in zip(tokens[i], tokens[i][1:], tokens[i][2:], strict=False):
            b, p = estimates(*main, *gram)
            cells[b].append(p)
            if b:
                cells["two" if b >= lm.ONE_WORD else "one"].append(p)
    for b, ps in cells.items():
        ps, w = np.array(ps), np.full(4, 0.25)
        w = np.array([0, 0, 0.5, 0.5]) if b == 0 else np.array([0, 1 / 3, 1 / 3, 1 / 3]) if b == "one" or b != "two" and b < lm.ONE_WORD else w
        for _ in range(rounds):
            share = ps * w
            w = (share / share.sum(axis=1, keepdims=True)).sum(axis=0) / len(ps)
        weights[b] = np.maximum(w, [0, 0, 1e-6, 1e-6]) / np.maximum(w, [0, 0, 1e-6, 1e-6]).sum()

    def weight(b):
        low = lm.ONE_WORD if b >= lm.ONE_WORD else 1
        return next((weights[k] for k in range(b, low - 1, -1) if k in weights), weights["two" if b >= lm.ONE_WORD else "one"]) if b else weights[0]

    out = {}
    for i, w in tokens.items():
        found = [estimates(*every, *gram) for gram in zip(w, w[1:], w[2:], strict=False)]
        out[i] = sum(np.log10(weight(b) @ p) for b, p in found)
    return weights, out


def test_interpolated_against_a_trigram_model_in_python(spark, monkeypatch):
    """Weights and scores, over several chunks and buckets; and better than unigrams on held-out texts with order."""
    rng = random.Random(4)
    follow = {(a, b): [rng.choice("abcdefghij") for _ in range(2)] for a in "abcdefghij" for b in "abcdefghij"}

    def text() -> str:
        w = [rng.choice("abcdefghij"), rng.choice("abcdefghij")]
        for _ in range(rng.randrange(80)):
            w.append(rng.choice(follow[w[-2], w[-1]]) if rng.random() < 0.9 else f"rare{rng.randrange(60)}")
            if w[-1][0] == "r":
                w.append(rng.choice("abcdefghij"))
                w.append(rng.choice("abcdefghij"))
        return " ".join(w)

    rows = [(i, text()) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    learned = {}
    original = lm.learn_weights

    def spy(*args, **kw):
        learned["w"] = original(*args, **kw)
        return learned["w"]

    monkeypatch.setattr(lm, "learn_weights", spy)
    weights, want = trigram_brute(rows, lambda i: i % 4 != 0)
    got = {}
    for chars, group, tokens in ((8_000_000, 8_000_000, 1_300_000), (1000, 1000, 200), (500, 3000, 150)):
        monkeypatch.setattr(lm, "CHUNK_CHARS", chars)
        monkeypatch.setattr(lm, "GROUP_CHARS", group)
        monkeypatch.setattr(lm, "BUCKET_TOKENS", tokens)
        got = {r.doc_id: r for r in lm.interpolated(docs, F.col("doc_id") % 4 != 0).collect()}
        assert {i: r.score for i, r in got.items()} == pytest.approx(want, rel=1e-9)
        for b, w in weights.items():
            if isinstance(b, int):
                assert learned["w"][b] == pytest.approx(w, abs=1e-9)
    held = [r for i, r in got.items() if i % 4 == 0]
    assert sum(r.score for r in held) > 0.8 * sum(r.base_score for r in held)


def test_interpolated_splits_hot_rows(spark, monkeypatch):
    """One row many times over, and many rows without id and text, make chunks like any others."""
    monkeypatch.setattr(lm, "CHUNK_CHARS", 2000)
    hot = spark.range(3000).select(F.when(F.col("id") % 2 == 0, 5).cast("long").alias("doc_id"), F.when(F.col("id") % 2 == 0, "one hot text").alias("text"))
    rows = lm.interpolated(hot.repartition(4), F.lit(True)).collect()
    assert len(rows) == 3000 and {(r.doc_id, r.n_tokens, r.n_known) for r in rows} == {(5, 4, 4), (None, 1, 1)} and {r.train_tokens for r in rows} == {7500}
    assert len({r.score for r in rows}) == 2


def test_packed_numbers():
    for x in ([0, 1, 255], [256, 0], [2**32, 2**64 - 1, 3], []):
        assert lm._unpack(lm._pack(np.array(x, np.uint64), np.array([7])))[0].tolist() == x


def test_shape_of_a_whole_word():
    assert quality._shape("a" * 64 + "B9-") == "x+X9-" and quality._shape("你" * 5000 + "7") == "x+9"


def test_quality(spark, odd, empty):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        good = words(rng, rng.randrange(4, 120))
        rows.append((i, good if i % 4 else rng.choice([good.upper().replace(" ", "!! "), (good.split()[0] + " ") * 40, good.replace(" ", " | ")]), int(i % 4 > 0)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 3] + [(None, 1), (1, None), (9999, 0)], "doc_id long, quality int")
    weights = quality.fit(docs, labels, max_rows=200)
    got = docs.withColumn("p", quality.score(F.col("text"), weights)).collect()
    assert np.mean([(r.p >= 0.7) == rows[r.doc_id][2] for r in got if r.doc_id % 3 == 0]) > 0.97
    scores = [r.p for r in odd.withColumn("p", quality.score(F.col("text"), weights)).collect()]
    assert len(scores) == odd.count() and all(0 <= p <= 1 for p in scores)
    assert empty.withColumn("p", quality.score(F.col("text"), weights)).count() == 0
    assert not quality.fit(empty, labels).any()


_ALL = (1 << 64) - 1


def mixed(a: int) -> int:
    a = ((a ^ (a >> 30)) * 0xBF58476D1CE4E5B9) & _ALL
    a = ((a ^ (a >> 27)) * 0x94D049BB133111EB) & _ALL
    return a ^ (a >> 31)


def plain_features(text, bits):
    """Feature -> how often, and the number of words: n-grams of words (1, 2) and of shapes (1 to 3), one at a time."""
    w, out = (text or "").split(), Counter()
    same = [k > 0 and w[k] == w[k - 1] for k in range(len(w))]
    for orders, salt, seed, form in ((2, 1, 0, lambda x: x), (3, 7, 1, quality._shape)):
        h = [int(quality._SAME) if s else xxhash.xxh64_intdigest(form(x), seed) for x, s in zip(w, same, strict=True)]
        for k in range(len(w)):
            gram = h[k]
            for order in range(orders):
                if order:
                    gram = (mixed(gram) + (h[k - order] if k >= order else int(quality._START))) & _ALL
                out[mixed((gram + salt + order) & _ALL) & ((1 << bits) - 1)] += 1
    return out, len(w)


def test_quality_against_plain_ftrl(spark):
    """Weights and scores by dictionaries, an update at a time; contradicting labels and clashing columns."""
    rng = random.Random(15)
    texts = [words(rng, rng.randrange(1, 30)) if i % 3 else ("spam " * rng.randrange(2, 9) + words(rng, 3)) for i in range(60)] + ["", None, " x  x "]
    docs = spark.createDataFrame([(i, t, 7, 0.5, "q") for i, t in enumerate(texts)], "doc_id long, text string, i int, y double, quality string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), "x", 3) for i in range(60)] + [(4, 0, "x", 3), (4, 1, "x", 3)], "doc_id long, quality int, text string, t int")
    bits, epochs, alpha, beta, l1, l2 = 12, 3, 1.0, 0.1, 1e-4, 1e-3
    got = quality.fit(docs, labels, bits=bits, epochs=epochs, alpha=alpha, beta=beta, l1=l1, l2=l2)
    order = [r.doc_id for r in docs.where("doc_id < 60").orderBy(F.xxhash64("doc_id")).collect()]
    y = {i: int(i % 3 > 0 and i != 4) for i in order}
    ones = sum(y.values())
    bias = np.log((ones + 0.5) / (len(order) - ones + 0.5))
    z, n = defaultdict(float), defaultdict(float)
    weight = lambda f: 0.0 if abs(z[f]) <= l1 else -(z[f] - np.sign(z[f]) * l1) / ((beta + n[f] ** 0.5) / alpha + l2)
    share = lambda t: (lambda c, m: {f: k / (5 * (m + 8)) for f, k in c.items()})(*plain_features(t, bits))
    for _ in range(epochs):
        for i in order:
            x = share(texts[i])
            w = {f: weight(f) for f in x}
            p = 1 / (1 + np.exp(-(sum(w[f] * v for f, v in x.items()) + bias)))
            for f, v in x.items():
                g = (p - y[i]) * v
                z[f] += g - ((n[f] + g * g) ** 0.5 - n[f] ** 0.5) / alpha * w[f]
                n[f] += g * g
    want = np.array([*(weight(f) for f in range(1 << bits)), bias])
    assert got == pytest.approx(want, rel=1e-5, abs=1e-6) and np.count_nonzero(got) > 500
    for r in docs.withColumn("p", quality.score(F.col("text"), got)).collect():
        assert r.p == pytest.approx(1 / (1 + np.exp(-(sum(want[f] * v for f, v in share(r.text).items()) + bias))), abs=1e-6)


def vector_rows(spark, rng, n, d=16, spread=0.02):
    rows, centre = [], [rng.normal(size=d) for _ in range(n // 6 + 1)]
    for i in range(n):
        v = centre[rng.integers(len(centre))] + rng.normal(size=d) * (spread if i % 3 else 1.0)
        rows.append((i, [float(x) for x in np.float32(v / np.linalg.norm(v))], int(i % 2)))
    rows += [(n, None, 0), (n + 1, [], 0), (n + 2, [None] * d, 1), (n + 3, [float("nan")] * d, 1), (n + 4, [0.0] * d, 0), (n + 5, rows[0][1], None), (n + 6, rows[1][1], 1), (n + 6, rows[1][1], 1), (n + 7, [1.0, 2.0], 1), (n + 8, [2.0, 4.0], 1), (n + 9, [float("inf")] + [0.0] * (d - 1), 1), (None, rows[2][1], 0)]
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, i int, v string"), rows


def test_topk(spark, monkeypatch):
    monkeypatch.setattr(topk, "PART_ROWS", 300)
    monkeypatch.setattr(topk, "QUERY_ROWS", 9)
    table, rows = vector_rows(spark, np.random.default_rng(0), 1000)
    got = defaultdict(list)
    for r in topk.search(table, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    good = [(i, np.floor(np.array(v, np.float64) * 256).astype(int)) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for i, q in good:
        if i % 50 == 0:
            best = sorted(((-int(q @ v), j) for j, v in good if j != i and len(v) == len(q)))[:5]
            assert got.pop(i) == [(j, -s) for s, j in best]
    assert not got
    assert topk.search(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_block_index_prunes_and_breaks_ties():
    ids = np.arange(100)[::-1].copy()
    index = topk.BlockIndex(ids, np.ones((100, 3)))
    q = np.ones(3)
    got, scores = index.search(0, q, index.bounds(q[None])[0], 5)
    assert got.tolist() == [1, 2, 3, 4, 5] and scores.tolist() == [3.0] * 5
    assert index.search(0, q, index.bounds(q[None])[0], 5, 4.0)[0].tolist() == []


def test_block_index_skips_most_blocks_of_vectors_around_few_directions():
    rng = np.random.default_rng(3)
    centres = np.eye(20)
    v = np.floor(256 * (centres[rng.integers(20, size=12_800)] * rng.uniform(0.5, 1.5, (12_800, 1)) + rng.normal(scale=0.01, size=(12_800, 20))))
    index = topk.BlockIndex(np.arange(len(v)), v)
    bounds = index.bounds(v[:50])
    for k in range(50):
        before = index.scored
        ids, scores = index.search(k, v[k], bounds[k], 5)
        want = sorted(((-s, j) for j, s in enumerate(v @ v[k]) if j != k))[:5]
        assert list(zip((-scores).tolist(), ids.tolist(), strict=True)) == want
        assert index.scored - before <= 200 / 4
        again = index.scored
        assert index.search(k, v[k], bounds[k], 5, scores[-1])[0].tolist() == ids.tolist() and index.scored - again <= index.scored - before


def test_topk_of_very_large_components(spark):
    rows = [(k, [x, 1.0], "a", k) for k, x in enumerate([1.0, 5e9, -5e9, 2.0**50, 1e300, 3.0, -1e300])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string, rank int")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.search(table, F.col("vec_id") == 1, scale=1).collect()}
    exact = [(k, min(max(int(np.floor(x)), -(2**63)), 2**63 - 1) * 5 * 10**9 + 1) for k, (_, (x, _), *_) in enumerate(rows) if k != 1]
    want = sorted((-min(max(-s, -(2**63)), 2**63 - 1), k) for s, k in sorted((-s, k) for k, s in exact)[:5])
    assert got == {(1, n + 1): (k, -s) for n, (s, k) in enumerate(want)}


@pytest.mark.parametrize("bits", [64, 7])
def test_itq(spark, bits):
    table, rows = vector_rows(spark, np.random.default_rng(1), 900)
    got = itq.near_dedup(table, bits=16, key_bits=4, block=40, sample_rows=300, node_bits=bits).collect()
    assert len(got) == len(rows)
    good = [(k, v) for k, (_, v, y) in enumerate(rows) if y is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    pairs, parent = 0, list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    links = Counter()
    for a, (k, x) in enumerate(good):
        for j, y in good[a + 1 :]:
            if rows[k][2] == rows[j][2] and len(x) == len(y) and np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                pairs += 1
                links[k] += 1
                links[j] += 1
                parent[max(root(k), root(j))] = min(root(k), root(j))
    assert pairs > 500 and sum(r.n_links for r in got) >= 0.9 * 2 * pairs
    least = defaultdict(list)
    for k, r in enumerate(rows):
        least[root(k)].append(r[0] if r[0] is not None else 10**9)
    by_id, most = {r.vec_id: r for r in got if r.vec_id is not None}, defaultdict(int)
    for k, r in enumerate(rows):
        most[r[0]] = max(most[r[0]], links[k])
        if r[0] is not None:
            assert by_id[r[0]].component_id >= min(least[root(k)])
    assert all(r.n_links <= most[r.vec_id] for r in got)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert by_id[907].n_links == 1 and by_id[908].component_id == 907 and by_id[906].n_links >= 2
    assert itq.near_dedup(table.limit(0)).count() == 0


def test_itq_finds_all_links_of_a_small_table(spark):
    rng = np.random.default_rng(4)
    for n, d in ((8, 64), (150, 16)):
        rows = []
        for k in range(n):
            x, y = rng.normal(size=(2, d))
            x /= np.linalg.norm(x)
            y -= (y @ x) * x
            rows += [(2 * k, x.tolist(), "a"), (2 * k + 1, (0.935 * x + (1 - 0.935**2) ** 0.5 * y / np.linalg.norm(y)).tolist(), "a")]
        v = np.array([r[1] for r in rows])
        want = ((v @ v.T) / np.outer(*[np.linalg.norm(v, axis=1)] * 2) >= 0.93).sum(1) - 1
        got = itq.near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()
        assert {r.vec_id: r.n_links for r in got} == dict(enumerate(want.tolist())) and min(want) >= 1


@pytest.mark.parametrize("key_bits", [None, 12])
def test_itq_recall_with_the_registered_parameters(spark, monkeypatch, key_bits):
    """Pairs hardly above the threshold, among vectors around centres; the second time with the keys of a larger table."""
    rng = np.random.default_rng(5)
    rows, centres = [], rng.normal(size=(40, 64))
    for k in range(3000):
        x = centres[k % 40] * 0.4 + rng.normal(size=64)
        x /= np.linalg.norm(x)
        y = rng.normal(size=64)
        y -= (y @ x) * x
        c = rng.uniform(0.931, 0.95)
        rows += [(2 * k, x.tolist(), "a"), (2 * k + 1, (c * x + (1 - c * c) ** 0.5 * y / np.linalg.norm(y)).tolist(), "a")]
    v = np.array([r[1] for r in rows], np.float32).astype(np.float64)
    want = ((v @ v.T) / np.outer(*[np.linalg.norm(v, axis=1)] * 2) >= 0.93).sum(1) - 1
    if key_bits:
        plan = itq.table_plan
        monkeypatch.setattr(itq, "table_plan", lambda largest, *args: plan(256 << key_bits, *args))
    got = itq.near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")).collect()
    assert all(r.n_links <= want[r.vec_id] for r in got) and sum(r.n_links for r in got) >= 0.99 * want.sum()


def near_rows(rng, pairs, d, spread=1.0, labels=10):
    """Pairs of cosine 0.93 to 0.97 around one direction (the narrower, the smaller spread), and what is linked."""
    rows, centre = [], rng.normal(size=d)
    for k in range(pairs):
        x = centre * (1 - spread) + rng.normal(size=d) * spread
        x /= np.linalg.norm(x)
        y = rng.normal(size=d)
        y -= (y @ x) * x
        c = rng.uniform(0.931, 0.97)
        rows += [(2 * k, x.tolist(), str(k % labels)), (2 * k + 1, (c * x + (1 - c * c) ** 0.5 * y / np.linalg.norm(y)).tolist(), str(k % labels))]
    v, label = np.array([r[1] for r in rows], np.float32).astype(np.float64), np.array([r[2] for r in rows])
    linked = ((v @ v.T) / np.outer(*[np.linalg.norm(v, axis=1)] * 2) >= 0.93) & (label[:, None] == label)
    return rows, linked.sum(1) - 1


@pytest.mark.parametrize(("pairs", "d", "spread"), [(1, 64, 1.0), (250, 64, 1.0), (700, 64, 1.0), (250, 64, 0.1), (2500, 64, 0.2), (300, 5, 1.0), (40, 2, 1.0), (60, 1, 1.0)])
def test_itq_takes_one_path_at_every_size_length_and_spread(spark, pairs, d, spread):
    """The registered parameters, on tables with links: tiny, small and larger ones, narrow cones, short vectors."""
    rows, want = near_rows(np.random.default_rng(pairs + d), pairs, d, spread) if d > 1 else ([(k, [1.0 + k if k % 3 else -1.0 - k], "a") for k in range(pairs)], np.array([(pairs * 2 // 3 if k % 3 else pairs // 3) - 1 for k in range(pairs)]))
    got = {r.vec_id: r.n_links for r in itq.near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")).collect()}
    assert all(got[k] <= want[k] for k in got) and want.sum() >= pairs
    assert sum(got.values()) >= (1 if len(rows) <= 4096 else 0.97) * want.sum()


def test_table_plan_grows_with_the_vectors():
    assert itq.table_plan(5000, 64, 0.93) == (8, 8, 1)
    key, tables, rotations = itq.table_plan(1 << 28, 64, 0.93)
    assert key == 20 and tables == 3 and tables * rotations >= 40


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(-500, 500), rng.randrange(-500, 500)) for _ in range(350)] + [(k, k + 1) for k in range(1000, 1064)] + [(5, 5)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def jaccard_links(texts):
    """The set of each text, its links and the number of the first text that links lead to."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent, links = list(range(len(texts))), Counter()

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return sets, links, [root(k) for k in range(len(texts))]


def jaccard_classes(texts):
    return jaccard_links(texts)[2]


def jaccard_brute(rows):
    sets, links, roots = jaccard_links([t for _, t in rows])
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[roots[k]] = min(i, low.get(roots[k], i))
    return Counter((i, low.get(roots[k]) if sets[k] else i, links[k], len(sets[k])) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize(("block", "bits"), [(4, 64), (512, 3)])
def test_ngram_join(spark, odd, empty, block, bits):
    rng = random.Random(7)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    base = [words(rng, n).split() for n in (12, 40, 200)]
    for i in range(90):
        w = list(base[i % 3])
        for _ in range(rng.randrange(0, 1 + len(w) // 40)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        rows.append((1000 + i, " ".join(w)))
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, node int, class_id string").repartition(3)
    got = Counter((r.doc_id, r.class_id, r.n_links, r.n_shingles) for r in ngram_join(table, block=block, id_bits=bits).collect())
    assert got == jaccard_brute(rows)
    if block == 4:
        assert ngram_join(empty).count() == 0


def test_ngram_join_of_a_large_group_of_near_copies(spark):
    """Long enough for many blocks; rows without id and rows of one id and text many times over are one node."""
    rng = random.Random(13)
    base, rows = words(rng, 120).split(), []
    for i in range(700):
        w = list(base)
        w[rng.randrange(len(w))] = f"edit{i}"
        rows.append((i, " ".join(w)))
    rows += [(None, rows[3][1])] * 200 + [(5, rows[5][1])] * 200 + [(700, rows[0][1].upper().replace(" ", "  "))]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter((r.doc_id, r.class_id, r.n_links, r.n_shingles) for r in ngram_join(table, block=64).collect())
    assert got == jaccard_brute(rows)


def test_packed_sets_share_what_they_have_in_common():
    rng = np.random.default_rng(0)
    base = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
    sets = [np.unique(np.append(np.delete(base, rng.integers(0, 400, 20)), rng.integers(0, 2**63, 5).astype(np.uint64))) for _ in range(200)]
    raw = _pack_sets(list(range(200)), [1] * 200, sets)
    nodes, copies, again = _unpack_sets(raw)
    assert nodes == list(range(200)) and copies == [1] * 200 and all((a == b).all() for a, b in zip(sets, again, strict=True))
    assert len(raw) < sum(s.nbytes for s in sets) / 8


def test_bands():
    bands, rows = bands_for(0.8, 0.999)
    assert bands * rows <= 192 and 1 - (1 - 0.8**rows) ** bands >= 0.999
    with pytest.raises(ValueError):
        bands_for(0.1, 0.999999, 8)


def test_bpe(odd, empty, monkeypatch):
    import tiktoken

    monkeypatch.setattr(bpe, "CHUNK_CHARS", 20_000)
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter((r.doc_id, tuple(library.encode_ordinary(r.text or "")), r.text or "") for r in odd.collect())
    assert Counter((r.doc_id, tuple(r.ids), r.text) for r in bpe.encode(odd, RANKS).collect()) == want
    digest = Counter((i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, x, t in want.elements())
    assert Counter(map(tuple, bpe.encode(odd, RANKS, output="digest").collect())) == digest
    assert bpe.encode(empty, RANKS).count() == 0


def test_bpe_of_hot_rows_with_ids_of_other_types(spark, monkeypatch):
    """One row many times over in one bucket a few characters wide; struct and text ids, clashing columns."""
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 5000)
    monkeypatch.setattr(bpe, "BUCKET_CHARS", 3000)
    hot = spark.range(2000).select(F.struct(F.lit("a").alias("chunk"), F.lit(1).alias("raw")).alias("kind"), F.when(F.col("id") % 4 != 0, "the hot text, again").alias("text"), F.lit(3).alias("bucket"), F.lit("x").alias("i"))
    rows = bpe.encode(hot.repartition(3), RANKS, "kind").collect()
    assert len(rows) == 2000 and {(tuple(r.kind), r.text) for r in rows} == {(("a", 1), "the hot text, again"), (("a", 1), "")}
    named = bpe.encode(hot.withColumn("kind", F.lit("id")).limit(5), RANKS, "kind", output="digest")
    assert named.dtypes[0] == ("kind", "string") and named.count() == 5


def test_squeeze():
    for x in (np.array([0, 1, 255, 256, 2**24, 2**32 - 1]), np.zeros(0, np.int64), np.zeros(5, np.int64)):
        assert bpe._expand(bpe._squeeze(x)).tolist() == x.tolist()
    assert bpe._cut(bpe._join([b"", b"ab", b"c"])) == [b"", b"ab", b"c"]
