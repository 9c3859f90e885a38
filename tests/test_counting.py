"""Counts that are added up within batches of texts."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lexweave.operators import counting, ngrams, tokens, vectors

DIR = "/root/testdata/sf0.001"
TEXTS = [*("".join(random.Random(k).choice(["а ", "б ", "the ", "of ", "zeta ", "ß "]) for _ in range(k)) for k in range(40)), None, "", "а б а в"]


@pytest.fixture
def texts(spark, monkeypatch):
    monkeypatch.setattr(counting, "WORDS", 25)
    monkeypatch.setattr(counting, "ROWS", 7)
    return spark.createDataFrame([(t,) for t in TEXTS], "text string").repartition(3)


def split(t):
    return (t or "").split()


@pytest.mark.parametrize("n", [1, 2, 3])
def test_ngram_counts(texts, n):
    for ends in (False, True):
        want = Counter()
        for w in map(split, TEXTS):
            padded = w + [None] * (n - 1)
            want.update(tuple(padded[k : k + n]) for k in range(len(w) if ends else len(w) - n + 1))
        got = counting.ngram_counts(texts, tokens.words(F.col("text")), n, ends).collect()
        assert {tuple(r[:n]): r.freq for r in got} == want and len(got) == len(want)


def test_pair_weights(texts):
    want = Counter()
    for w in map(split, TEXTS):
        for i, a in enumerate(w):
            for k, b in enumerate(w[i + 1 : i + 6], 1):
                want[min(a, b, key=str.encode), max(a, b, key=str.encode)] += 1 / k
    got = {(r.word, r.context): r.weight for r in counting.pair_weights(texts, tokens.words(F.col("text"))).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_nothing_to_count(spark):
    none = spark.createDataFrame([(None,), ("",)], "text string")
    assert counting.ngram_counts(none, tokens.words(F.col("text")), 3).count() == 0 and counting.pair_weights(none, tokens.words(F.col("text"))).count() == 0


@pytest.mark.parametrize("name", ["cooccurrences", "trigram_freq", "bigram_freq"])
def test_one_exchange_and_no_table_before_it(spark, name):
    """Rows are added up as integers where the texts are read: no window, and no table of strings that is sorted to disk before the shuffle."""
    plan = entry.queries()[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    lines = [x for x in plan.splitlines() if any(w in x for w in ("Exchange hashpartitioning", "Aggregate", "Window"))]
    assert sum("Exchange" in x for x in lines) == 1 and "Exchange" in lines[-1] and "Window" not in plan


def test_lower_orders_come_from_the_highest(spark, texts):
    of = ngrams.frequencies_to(texts, tokens.words(F.col("text")), 3)
    want = Counter(w for t in TEXTS for w in split(t))
    assert {r.w1: r.freq for r in of[1].collect()} == want


def test_unit_vectors_and_thresholds(spark):
    assert str(vectors.unit(F.col("v"))).count("aggregate") == 1
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<float>").select(vectors.unit(F.col("v")).alias("u")).collect()
    assert [r.u for r in rows] == [[0.6, 0.8], None, None]
    rng = np.random.default_rng(2)
    for n, k in ((5, 5), (40, 3), (3000, 10), (3007, 10), (90, 80)):
        s = rng.normal(size=(20, n)).astype(np.float32)
        least = vectors._at_least(s, k)
        assert (least <= (np.sort(s, axis=1)[:, -k] if k < n else -np.inf)).all()
        assert k >= n or ((s >= least[:, None]).sum(axis=1) < 3 * k + 10).all()


def test_taggers_get_bounded_runs_of_texts(spark, monkeypatch):
    monkeypatch.setattr(tokens, "CHARACTERS", 30)
    texts = [(k, "аб вг " * (k % 7)) for k in range(50)] + [(99, "x " * 400)]

    def make():
        def tag(sentences):
            return [[(str(sum(map(len, sentences))), str(len(sentences)))] + [(w, "N") for w in s.split()] for s in sentences]

        return tag

    got = tokens.tokenize_with(spark.createDataFrame(texts, "doc_id int, text string").coalesce(1), make).collect()
    assert max(int(r.lemma) for r in got if r.pos == 0 and int(r.tag) > 1) <= 72 and sum(r.pos > 0 for r in got) == sum(len(t.split()) for _, t in texts)
    nulls = spark.createDataFrame([(1, None), (2, "a")], "doc_id int, text string")
    assert tokens.tokenize_with(nulls, lambda: lambda found: [[("x", "y")] for _ in found]).count() == 2


def test_suffix_tags_need_no_regular_expression(spark):
    words = ["да", "и", "for", "run", "running", "ed", "бежать", "quickly", "able", "famous", "красный", "дом", "𝔸𝔹", "𝔸𝔹𝔸", ""]
    assert "RLIKE" not in str(tokens.suffix_tag(F.col("w"))).upper()

    def plain(w):
        return next((t for p, t in tokens.SUFFIX_TAGS if re.search(p, w)), "N")

    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", tokens.suffix_tag(F.col("w")).alias("t")).collect()
    assert {r.w: r.t for r in rows} == {w: plain(w) for w in words}


def test_connectors_are_found_without_putting_texts_together(spark):
    plan = entry.queries()["phrases_bridged"](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_patterns_are_summed_where_their_ngrams_are(spark):
    """F12 of round 4: as by joins with the shorter n-grams; nothing is shuffled but the counts, and for the last word."""
    draw = random.Random(12)
    texts = spark.createDataFrame([([draw.choice("abcdé") for _ in range(draw.choice([0, 1, 2, 3, 40]))],) for _ in range(30)] + [(None,)], "ws array<string>")
    of = ngrams.frequencies_to(texts, F.col("ws"), 3)
    size = of[1].agg(F.count("*").alias("n"))
    for least in (1, 3):
        want = sorted(map(tuple, ngrams.statistics(of[3].where(F.col("freq") >= least), of[2], of[1], 3, size).collect()))
        found = ngrams.text_statistics(texts, F.col("ws"), 3, least)
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 3
        got = sorted(map(tuple, found.collect()))
        assert len(got) > 5 and [x[:4] for x in got] == [x[:4] for x in want]
        assert all(a[4:] == pytest.approx(b[4:]) for a, b in zip(got, want, strict=True))
