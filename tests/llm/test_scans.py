"""License scans, vector codes and resampling against brute-force versions, and on nulls, empty and long texts, ties, repeats and
empty tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.llm import exponion, licenses, resampling
from lexweave.llm.common import plain_words

DOCS = "doc_id long, text string, i string, t string, l int, found string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return WORD.findall((text or "").translate(LOWER))


def rows_of(df):
    return Counter(map(repr, (r.asDict(recursive=True) for r in df.collect())))


@pytest.fixture(scope="module")
def notices(spark):
    """Whole, edited, cut and near-miss notices among other words, and odd rows."""
    rng = random.Random(4)
    vocabulary = ["alpha", "beta", "license", "under", "the", "version", "software", "of", "é̄", "你好", "free", "to"] + [f"w{k}" for k in range(200)]
    fill = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts = [None, "", " \n\t", "one", "MIT license MIT License", "cc-by CC  by\x00cc\x7fby", "gnu general public licenses", "apache  license.\nSame apache license", " cc byK"]
    for _, text in licenses.TEMPLATES:
        whole = text.split()
        for drop in (0.0, 0.1, 0.2, 0.3):
            kept = [w for w in whole if rng.random() >= drop]
            texts.append(" ".join(fill(rng.randrange(90)) + kept + fill(rng.randrange(90))))
    texts.append(" ".join(fill(20_000) + licenses.TEMPLATES[0][1].split() + fill(5_000)))
    rows = [(k, t, "x", "y", 1, "z") for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, *rows[4:12], (None, texts[4], None, None, None, None), (None, None, None, None, None, None)], DOCS).repartition(3)


def scan_plain(doc_id, text, made, phrases):
    """Every block compared with every template."""
    words = tokens(text)
    places = [(k, label) for p, label in phrases for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
    found: dict[tuple, list] = {}
    for k, t in enumerate(made):
        half, wanted = t.block // 2, {w.decode() for w in t.words}
        for start in range(0, len(words), half):
            shared = len(wanted & set(words[start : start + t.block]))
            if shared >= t.least:
                found.setdefault((start, min(t.block, len(words) - start)), []).append((k, t.label, shared, shared / len(wanted)))
    best = sorted((start, n, k, label, o, c) for (start, n), hits in found.items() for k, label, o, c in hits if c == max(h[3] for h in hits))
    at = [k for k, _ in places]
    return {
        "doc_id": doc_id, "n_words": len(words), "n_base": len(at), "first_word": min(at, default=None), "last_word": max(at, default=None), "base_labels": sorted({x for _, x in places}),
        "found": [{"label": label, "template": k, "start": s, "words": n, "overlap": o, "containment": c} for s, n, k, label, o, c in best],
    }


def test_scan_against_all_blocks_and_templates(notices):
    made = licenses.templates()
    got = rows_of(licenses.scan(notices))
    assert got == Counter(repr(scan_plain(r["doc_id"], r["text"], made, licenses.PHRASES)) for r in notices.collect())
    found = [r for r in licenses.scan(notices).collect() if r["found"]]
    assert len(found) > 60 and {x["label"] for r in found for x in r["found"]} >= {"gpl", "lgpl", "agpl", "mit", "bsd", "cc-by-nc", "zlib", "isc"}


def test_scan_of_an_empty_table_and_of_other_ids(spark):
    assert licenses.scan(spark.createDataFrame([], DOCS)).count() == 0
    named = spark.createDataFrame([("a", "Released under the MIT License."), ("b", "Released under the XYZ license.")], "doc_id string, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(named, phrases=()).select("doc_id", licenses.labels().alias("labels"), licenses.score().alias("score")).collect()}
    assert got == {"a": ("mit", 1.0), "b": ("", 0.0)}
    assert licenses.scan(named, made=[], phrases=()).where("n_words = 5").count() == 2


def test_filters_spare_most_comparisons():
    rng = random.Random(1)
    made = licenses.templates()
    order = sorted({w for t in made for w in t.words}, key=lambda w: (sum(w in t.words for t in made), w))
    matcher = licenses.Matcher(made, order)
    ids = np.array([rng.randrange(-3 * len(order), len(order)) for _ in range(50_000)], np.int32).clip(-1)
    matcher.matches(ids, np.array([0]), np.array([len(ids)]))
    assert matcher.compared * 20 < sum(len(ids) // (t.block // 2) for t in made)
    with pytest.raises(ValueError):
        licenses.templates([("x", " ".join(f"w{k}" for k in range(licenses.MOST_WORDS + 1)))])


def test_plain_words_in_pieces():
    text = "Straße, É x-1 y z" * 50
    for piece in (1, 7, 1 << 20):
        assert [w.decode() for part in plain_words(text.encode(), piece) for w in part] == tokens(text)
    assert not [w for part in plain_words(None) for w in part]


def codes_plain(rows, parts, entries, rounds):
    """rows of (id, label, ints): Lloyd's rounds in plain Python."""
    size = max((len(v) for *_, v in rows), default=0)
    step = -(-size // parts) or 1
    rows = [(i, label, v + [0] * (parts * step - len(v))) for i, label, v in rows]
    cut = lambda v, p: v[p * step : (p + 1) * step]
    first = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    book = [[cut(v, p) for *_, v in first] for p in range(parts)]
    near = lambda x, b: min((sum((c - y) ** 2 for c, y in zip(x, e)), k) for k, e in enumerate(b))
    for turn in range(rounds + 1):
        got = [[near(cut(v, p), book[p]) for p in range(parts)] for *_, v in rows]
        if turn < rounds:
            for p in range(parts):
                for k in range(len(book[p])):
                    own = [cut(rows[r][2], p) for r in range(len(rows)) if got[r][p][1] == k]
                    if own:
                        book[p][k] = [sum(c) // len(own) for c in zip(*own)]
    digest = hashlib.sha256(",".join(str(x) for b in book for e in b for x in e).encode()).hexdigest()
    error = [sum(d for d, _ in g) for g in got]
    by = Counter()
    for (_, label, _), e in zip(rows, error):
        by[label] += e
    top = (1 << 63) - 1
    return Counter(repr((i, "".join(f"{k:02x}" for _, k in g), min(e, top), min(by[label], top), digest)) for (i, label, _), g, e in zip(rows, got, error))


SCHEMA = "vec_id long, embedding array<double>, label int, i string, c string, v int"


def test_codes_against_plain_rounds(spark):
    rng = random.Random(2)
    rows = [(k, [rng.gauss(0, 0.3) for _ in range(10)], rng.choice([1, 1, 1, 2, None])) for k in range(300)]
    rows += [(3, rows[3][1], 1), (5, [0.25] * 10, 2), (None, [0.5] * 10, None), (400, [0.1, 0.2], 9), (401, [], 9), (402, None, 1), (403, [1.0, None], 1), (404, [math.nan] * 10, 1), (405, [math.inf] * 10, None)]
    table = spark.createDataFrame([(*r, "a", "b", 1) for r in rows], SCHEMA).repartition(3)
    good = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for parts, entries, rounds in ((4, 12, 2), (16, 64, 1), (3, 5, 0)):
        got = exponion.compress(table, parts, entries, rounds)
        assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
        assert Counter(repr(tuple(r)) for r in got.collect()) == codes_plain(good, parts, entries, rounds)


def test_codes_of_few_odd_and_very_large_vectors(spark):
    make = lambda rows: spark.createDataFrame([(*r, "a", "b", 1) for r in rows], SCHEMA)
    assert exponion.compress(make([])).collect() == []
    assert exponion.compress(make([(1, None, 2)])).collect() == []
    same = exponion.compress(make([(k, [0.5] * 16, 1) for k in range(70)])).collect()
    assert {(r["code"], r["error"], r["label_error"]) for r in same} == {("00" * 16, 0, 0)}
    empties = exponion.compress(make([(1, [], 1), (2, [], 1)])).collect()
    assert {r["code"] for r in empties} == {"00" * 16}
    rng = random.Random(3)
    large = [(k, [rng.choice([-1, 1]) * float(rng.randrange(1 << 50)) for _ in range(6)], k % 2) for k in range(40)]
    got = Counter(repr(tuple(r)) for r in exponion.compress(make(large), 3, 4, 2).collect())
    assert got == codes_plain([(i, label, [math.floor(256 * x) for x in v]) for i, v, label in large], 3, 4, 2)
    with pytest.raises(ValueError):
        exponion.compress(make([]), entries=257)


def test_search_is_exact_and_spares_comparisons():
    rng = np.random.default_rng(5)
    centres = rng.integers(-1000, 1000, (64, 4))
    x = centres[rng.integers(0, 64, 5000)] + rng.integers(-20, 20, (5000, 4))
    far = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
    book = exponion.Codebook(centres)
    for start in (far.argmin(axis=1), rng.integers(0, 64, 5000)):
        entry, error = book.search(x, start)
        assert (entry == far.argmin(axis=1)).all() and (error == far.min(axis=1)).all()
    book.compared = 0
    book.search(x, far.argmin(axis=1))
    assert book.compared < 64 * 5000 / 20
    tied = exponion.Codebook(np.array([[3], [1], [3], [1]]))
    assert tied.search(np.array([[2], [3], [0]]), np.array([3, 2, 3]))[0].tolist() == [0, 0, 1]


def draw_plain(rows, target, percent, least, buckets, n, seed=2024):
    def features(text):
        w = tokens(text)
        return [zlib.crc32(" ".join(w[k : k + size]).encode()) % buckets for size in range(1, n + 1) for k in range(len(w) - size + 1)]

    s, t = Counter(f for _, x in rows for f in features(x)), Counter(f for x in target for f in features(x))
    S, T = float(s.total()), float(t.total())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (S + buckets) / ((s[b] + 1.0) * (T + buckets)))) for b in range(buckets)]
    out = []
    for i, text in rows:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        f = features(text)
        weight = sum(gain[b] for b in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(tokens(text)) >= least])
    may = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(may[: len(may) * percent // 100], 1):
        r[4] = rank
    return Counter(repr(tuple(r[:5])) for r in out)


@pytest.mark.parametrize(("percent", "n", "buckets"), [(10, 1, 10_000), (35, 3, 64), (100, 2, 1000), (0, 1, 10)])
def test_resample_against_a_plain_draw(spark, percent, n, buckets):
    rng = random.Random(percent)
    rows = [(k, " ".join(rng.choice("Ab é cd 12 xy-z q".split()) + str(rng.randrange(30)) for _ in range(rng.randrange(1, 60)))) for k in range(400)]
    rows += [(500, None), (501, ""), (None, rows[1][1]), (None, None), (7, rows[7][1]), (600, " ".join(["long"] * 90_000))] + [(9, rows[9][1])] * 150
    target = [x for _, x in rows[:400:9]] + [None, ""]
    docs = spark.createDataFrame([(i, t, "a", "b", 1, "c") for i, t in rows], DOCS).repartition(5)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(docs, goal, percent, least_words=12, n=n, buckets=buckets)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(repr(tuple(r)) for r in got.collect()) == draw_plain(rows, target, percent, 12, buckets, n)


def test_resample_of_empty_tables(spark):
    none, goal = spark.createDataFrame([], DOCS), spark.createDataFrame([], "text string")
    assert resampling.resample(none, goal).collect() == []
    one = spark.createDataFrame([(1, "word " * 30, "", "", 1, "")], DOCS)
    assert [tuple(r)[0] for r in resampling.resample(one, goal).where(F.col("rank").isNull()).collect()] == [1]
    assert resampling.bucket_counts(none).tolist() == [0] * 10_000
    assert resampling.bucket_counts(one).sum() == 30


def test_resampling_draws_what_is_like_the_target(spark):
    rng = random.Random(8)
    kinds = {0: [f"a{k}" for k in range(50)], 1: [f"b{k}" for k in range(50)]}
    docs = spark.createDataFrame([(k, " ".join(rng.choices(kinds[k % 10 == 0], k=40)), "", "", 1, "") for k in range(600)], DOCS)
    goal = spark.createDataFrame([(" ".join(rng.choices(kinds[1], k=40)),) for _ in range(20)], "text string")
    drawn = resampling.resample(docs, goal).where("rank is not null").collect()
    assert len(drawn) == 60 and all(r["doc_id"] % 10 == 0 for r in drawn)
