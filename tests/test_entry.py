"""The registry: every query runs on the smallest data, and has the columns and rows of its SQL."""

from __future__ import annotations

import glob
import os
from collections import Counter
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from lexweave.plans import registry as own

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")


def plain(value):
    """Numbers that both engines have, floating-point ones to six places."""
    return round(float(value), 6) if isinstance(value, float | Decimal) else value


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(own.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(own.QUERIES))
def test_query(spark, db, name):
    got = own.QUERIES[name](spark, DIR)
    columns = sorted(got.columns)
    rows = [tuple(map(plain, r)) for r in got.select(columns).collect()]
    if name in own.SQL:
        want = db.sql(own.SQL[name])
        assert columns == sorted(want.columns)
        at = [want.columns.index(c) for c in columns]
        assert Counter(rows) == Counter(tuple(plain(r[k]) for k in at) for r in want.fetchall())
    assert rows


def test_every_query_has_sql():
    """But for decoding by Viterbi and for trained vectors, which test_learned.py and test_embed.py hold against plain versions."""
    assert set(own.QUERIES) - set(own.SQL) == {"learned_tags", "bag_vectors", "subword_bag_vectors", "glove_vectors"}


def plans(spark, name: str) -> str:
    return own.QUERIES[name](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(("name", "call", "most"), [("unigram_freq", "regexp_extract_all", 1), ("trigram_freq", "regexp_extract_all", 1), ("clean_articles", "regexp_replace", 14), ("star_bigram_freq", "regexp_extract_all", 0)])
def test_a_regular_expression_stands_once_in_a_plan(spark, name, call, most):
    assert plans(spark, name).count(call) == most


@pytest.mark.parametrize(("name", "of"), [("bigram_pmi_all", "bigram_freq"), ("bigram_tscore_all", "bigram_freq"), ("bigram_logdice_all", "bigram_freq"), ("trigram_stats_all", "trigram_freq"), ("c_value_all", "bigram_freq")])
def test_measures_of_every_ngram(spark, name, of):
    got, want = own.QUERIES[name](spark, DIR), own.QUERIES[of](spark, DIR)
    assert got.where("freq = 1").count() > 0 and got.dropna().select(want.columns).exceptAll(want).count() == 0 and got.count() == want.count()


@pytest.mark.parametrize("name", ["bigrams_by_pos_all", "trigrams_by_pos_all"])
def test_rare_ngrams_by_pos(spark, name):
    assert own.QUERIES[name](spark, DIR).where("raw_frequency = 1").count() > 0
