"""N-grams, vectors, suggestions, evaluation sets, readers and streams on small tables."""

from __future__ import annotations

import math
import random
import zipfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.operators import audit, context, evalset, multiway, ngrams, suggest, tokens, vectors
from lexweave.sources import files
from lexweave.streaming import clean_stream, count_words, read_stream, write_stream

TEXTS = {1: "Красный дом, красный дом стоит!", 2: "дом стоит у реки", 3: "река", 4: "", 5: None}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")


def grams(n):
    import re

    out = Counter()
    for t in TEXTS.values():
        w = re.findall(r"[^\W\d_]+", (t or "").lower())
        out.update(zip(*(w[k:] for k in range(n)), strict=False))
    return out


@pytest.mark.parametrize("n", [1, 2, 3])
def test_frequencies(docs, n):
    for occ in (ngrams.array_occurrences(docs, tokens.words(F.col("text")), n), ngrams.occurrences(tokens.tokens(docs), n)):
        assert {tuple(r)[:-1]: r.freq for r in ngrams.frequencies(occ, n).collect()} == grams(n)


def test_lookup_and_attestation(spark, docs):
    two = ngrams.array_occurrences(docs, tokens.words(F.col("text")), 2)
    freq = ngrams.frequencies(two, 2)
    asked = spark.createDataFrame([("красный", "дом"), ("дом", "река"), ("красный", "дом")], "w1 string, w2 string")
    assert sorted(r.freq for r in ngrams.lookup(asked, freq, 2).collect()) == [0, 2, 2]
    words = lambda *w: spark.createDataFrame([(x,) for x in w], "word string")
    assert [tuple(r) for r in ngrams.attested(two, words("красный", "у"), words("дом")).collect()] == [("красный", "дом")]
    assert ngrams.attested(two, words("a")).count() == 0 and ngrams.attested(two, words("a")).columns == ["w1"]
    assert {(r.w1, r.w2): (r.ngram_freq, r.doc_freq) for r in ngrams.attested_frequencies(two, words("красный", "у"), words("дом")).collect()} == {("красный", "дом"): (2, 1)}
    assert ngrams.unattested(asked, freq, 2).count() == 1
    assert {(r.w1, r.w2): (r.ngram_freq, r.doc_freq) for r in ngrams.document_frequencies(two, 2).collect()}["дом", "стоит"] == (2, 2)


def star_tables(spark):
    """Two wordforms of one lemma, a lemma without wordforms, two verbs."""
    make = spark.createDataFrame
    return {
        "pos": make([(1, "NOUN"), (2, "VERB"), (3, "ADP")], "id_pos int, pos string"),
        "lemmas": make([(1, "дом", 1), (2, "видеть", 2), (3, "пусто", 1), (4, "в", 3)], "id_lemmas long, lemma string, id_pos int"),
        "unigrams": make([(1, "дом", 1, 5, "Animacy=Inan"), (2, "дома", 1, 7, "Animacy=Inan"), (3, "вижу", 2, 4, "VerbForm=Fin"), (4, "В", 4, 9, "_"), (5, "в", 4, 2, "_")], "id_unigram long, unigram string, lemma long, freq_all long, morph string"),
        "ngram2": make([(1, 3, 1, 10), (2, 3, 2, 3), (3, 4, 1, 8), (4, 3, 4, 2), (5, 3, 5, 2)], "id_bigram long, wordform_1 long, wordform_2 long, raw_frequency long"),
        "ngram3": make([(1, 4, 1, 6), (2, 5, 2, 5)], "id_trigram long, bigram long, token long, raw_frequency long"),
        "ngram3_tokens": make([(1, 3, 4, 1), (2, 3, 5, 2)], "id_trigram long, w1 long, w2 long, w3 long"),
    }


def test_star(spark):
    t = star_tables(spark)
    assert {r.lemma: r.freq for r in ngrams.lemma_unigrams(t).collect()} == {"дом": 12, "видеть": 4, "пусто": 0, "в": 11}
    assert {(r.w1, r.w2): r.freq for r in ngrams.lemma_bigrams(t).collect()} == {("видеть", "дом"): 13, ("в", "дом"): 8, ("видеть", "в"): 4}
    assert [tuple(r) for r in ngrams.lemma_trigrams(t).collect()] == [("видеть", "в", "дом", 11)]
    assert [r.raw_frequency for r in ngrams.top_bigrams(t, ngrams.by_pos(2)).collect()] == [10, 3]
    assert [r.raw_frequency for r in ngrams.top_bigrams(t, ngrams.by_pos(2), scanned=1).collect()] == [10]
    assert [r.raw_frequency for r in ngrams.top_bigrams(t, ngrams.by_morphology(2)).collect()] == [10, 3]
    assert [r.raw_frequency for r in ngrams.top_trigrams(t, ngrams.by_pos(3)).collect()] == [6, 5]
    assert [r.raw_frequency for r in ngrams.top_trigrams(t, ngrams.by_morphology(3), kept=1).collect()] == [6]


def test_tagged_measures(spark):
    rows = ngrams.read_tagged(spark.createDataFrame([("a b/X Y", "1", 0), ("a b/X Y", "8", 1), ("a/X", "10", 2), ("b/Y", "20", 3)], "ngram string, freq string, line long"))
    got = ngrams.measure_tagged(rows.where("ngram like '% %'"), rows, rows, 1000).collect()
    assert len(got) == 1 and got[0].pmi == pytest.approx(math.log10(1000 * 8 / 200)) and got[0].log_dice == pytest.approx(14 + math.log2(16 / 30))


def conll(*rows):
    return "\n".join(["# text"] + ["\t".join([str(k), t, lemma, pos, "_", feats, "_", "_", "_", misc]) for k, (t, lemma, pos, feats, misc) in enumerate(rows)])


def test_documents_are_counted_before_components_are_joined(spark):
    """no place of an n-gram is dealt by one word alone."""
    rows = spark.createDataFrame([(1, "a b a b"), (2, "a b c b"), (2, "a b"), (None, "a b"), (3, None), (4, "a")], "doc_id long, text string")
    words = lambda *w: spark.createDataFrame([(x,) for x in w], "word string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = ngrams.attested_frequencies(ngrams.array_occurrences(rows, tokens.words(F.col("text")), 2), words("a", "c", "c"), words("b"))
        plan = got._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {(r.w1, r.w2): (r.ngram_freq, r.doc_freq) for r in got.collect()} == {("a", "b"): (5, 3), ("c", "b"): (1, 1)}
    assert plan.count("Join") == 2 and plan.index("Join") < plan.rindex("Join") < plan.index("count(1)")


def test_conllu(spark):
    n, g = "Case=Nom|Number=Sing", "Case=Gen|Number=Sing"
    text = conll(
        ("Анна", "анна", "PROPN", n, "_"), ("Ли", "ли", "PROPN", n, "_"), ("видит", "видеть", "VERB", "_", "_"), ("12", "12", "NUM", "_", "_"), (".", ".", "PUNCT", "_", "_"),
        ("UNK", "unk", "X", "_", "_"), ("Петра", "пётр", "PROPN", g, "SpacesAfter=\\n"), ("Ивана", "иван", "PROPN", g, "_"),
    )
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id int, conllu string")
    get = lambda **k: [r.token for r in tokens.conllu(docs, **k).orderBy("pos").collect()]
    assert get() == ["анна::ли_PROPN", "видеть_VERB", "xx_NUM", "[UNK]_UNK", "пётр_PROPN", "иван_PROPN"]
    assert get(keep_pos=False, keep_punct=True) == ["анна::ли", "видеть", "xx", ".", "[UNK]", "пётр", "иван"]


def test_a_line_of_conllu_is_split_once(spark):
    """no field splits its line again; a case or number that is missing or empty joins nothing."""
    n, e, none = "Case=Nom|Number=Sing", "Case=|Number=Sing", "Number=Sing|X=1"
    text = conll(
        ("А", "а", "PROPN", n, "SpacesAfter=\\s\\n"), ("Б", "б", "PROPN", n, "SpacesAfter=x"), ("В", "«в_»!", "PROPN", n, "_"), ("Г", "г.png", "PROPN", n, "_"), ("Д", "д|", "X", "_", "_"),
        ("Е", "е", "PROPN", e, "_"), ("Ж", "ж", "PROPN", e, "_"), ("З", "з", "PROPN", none, "_"), ("И", "и", "PROPN", none, "_"), ("К", "«к»", "PUNCT", "_", "_"), ("Файл", "м", "X", "_", "SpaceAfter=No"),
    )
    got = tokens.conllu(spark.createDataFrame([(1, text + "\n# a" + "\tb" * 9)], "doc_id int, conllu string"), keep_punct=True)
    assert [r.token for r in got.orderBy("pos").collect()] == ["а_PROPN", "б::в»_PROPN", "е_PROPN", "ж_PROPN", "з_PROPN", "и_PROPN", "«к»_PUNCT"]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 2


def test_tags(spark, docs):
    lexicon = spark.createDataFrame([("дом", "дом", "N"), ("стоит", "стоять", "V")], "wordform string, lemma string, pos string")
    rows = tokens.tag(tokens.tokens(docs), lexicon)
    texts = {r.doc_id: r.text for r in tokens.lemma_text(tokens.keep_tags(rows)).collect()}
    assert texts[2].startswith("дом_N стоять_V у_S")
    assert [r.word for r in tokens.connectors(spark.createDataFrame([("и_c дом_n в_s",)], "text string")).orderBy("word").collect()] == ["в_s", "и_c"]
    spelled = tokens.tokenize_with(docs.where("text is not null"), lambda: lambda texts: [[(w, "X") for w in t.split()] for t in texts])
    assert spelled.count() == 10
    lines = spark.createDataFrame([(k, str(k)) for k in range(5)], "line int, text string")
    assert tokens.line_range(lines, 1, 3).count() == 3 and tokens.line_range(lines, 2).count() == 3


def test_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(40, 8))
    table = spark.createDataFrame([(f"w{k}", [float(x) for x in v[k]]) for k in range(40)] + [("zero", [0.0] * 8)], "word string, vec array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    asked = spark.createDataFrame([("q", "w1"), ("q", "w2"), ("q", "oov"), ("r", "w3"), ("s", "oov")], "query string, word string")
    for block in (1000, 1):
        monkeypatch.setattr(vectors, "QUERY_BLOCK", block)
        cos = {(r.query, r["rank"]): (r.word, r.score) for r in vectors.nearest_cosine(table, asked, 4).collect()}
        mul = {(r.query, r["rank"]): (r.word, r.score) for r in vectors.nearest_cosmul(table, asked, 4).collect()}
        for q, own in (("q", [1, 2]), ("r", [3])):
            mean = u[own].sum(axis=0)
            for got, want in ((cos, u @ (mean / np.linalg.norm(mean))), (mul, np.prod((1 + u @ u[own].T) / 2, axis=1))):
                best = [k for k in np.argsort(-want) if k not in own][:4]
                assert [got[q, r + 1][0] for r in range(4)] == [f"w{k}" for k in best]
                assert got[q, 1][1] == pytest.approx(want[best[0]])
        assert not any(q == "s" for q, _ in cos)


def test_vector_training(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([([f"{'ab'[g]}{rng.integers(6)}" for _ in range(12)], "xy"[g]) for g in rng.integers(2, size=150).tolist()], "words array<string>, field string")
    v = vectors.train_word2vec(rows, size=8, window=4, min_count=1, epochs=2)
    assert v.count() == 12 and len(v.first().vec) == 8
    assert set(vectors.train_by_field(rows, ["x"], size=4, window=2, min_count=1, epochs=1)) == {"", "x"}
    sub = vectors.subword_vectors(v, spark.createDataFrame([("a1",), ("a1b",)], "word string")).collect()
    assert {len(r.vec) for r in sub} == {8}
    pairs = vectors.cooccurrences(tokens.tokens(spark.createDataFrame([(1, "а б а в")], "doc_id int, text string")), 2)
    assert {(r.word, r.context): round(r.weight, 6) for r in pairs.collect()} == {("а", "б"): 2.0, ("а", "а"): 0.5, ("б", "в"): 0.5, ("а", "в"): 1.0}
    assert vectors.train_glove(pairs, 4, 2).count() == 3
    numbers = vectors.numbered(spark.createDataFrame([(f"w{k:03}",) for k in range(300)], "word string").repartition(7), "word").collect()
    assert sorted((r.id, r.word) for r in numbers) == [(k, f"w{k:03}") for k in range(300)]


def test_bags_of_words(spark):
    """Words of two topics: the losses fall, and a word's neighbours are of its topic; parts are averaged."""
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([([f"{'ab'[g]}{rng.integers(5)}" for _ in range(10)],) for g in rng.integers(2, size=300).tolist()] + [(["rare"],), ([],)], "words array<string>")
    for parts in (1, 3):
        v, losses = vectors.train_cbow(rows, size=10, window=4, min_count=2, epochs=6, parts=parts, rate=0.2)
        assert len(losses) == 6 and losses[-1] < losses[0] and v.count() == 10
        near = vectors.nearest_each(v, v.select("word"), 4).collect()
        assert sum(r.query[0] == r.word[0] for r in near) >= 36
    assert vectors.train_cbow(rows.limit(0), epochs=2)[1] == []


@pytest.mark.parametrize(("n", "level", "want"), [(2, 1, [[0, 1], [1, 0]]), (2, 2, [[0, 0]]), (2, 3, [[0, 0]]), (3, 1, [[0, 1, 1], [1, 0, 1], [1, 1, 0]]), (3, 2, [[0, 0, 1], [0, 1, 0], [1, 0, 0]]), (3, 3, [[0, 0, 0]]), (4, 1, []), (2, 0, [])])
def test_masks(n, level, want):
    assert suggest.masks(n, level) == want


def test_suggestions(spark):
    colloc = spark.createDataFrame([("рассматривать_V вопрос_N",), ("одно",)], "colloc string")
    rows = suggest.with_masks(colloc, (1, 2))
    texts = {r[0] for r in rows.select(suggest.masked_text(F.col("tokens"), F.col("mask"))).collect()}
    assert texts == {"<mask>_V вопрос_N", "рассматривать_V <mask>_N", "<mask>_V <mask>_N"}
    both = "рассматривать_V вопрос_N"
    near = spark.createDataFrame(
        [("рассматривать_V", "изучать_V", 1, 0.9), ("рассматривать_V", "осмотр_N", 2, 0.8), ("вопрос_N", "тема_N", 1, 0.7), (both, "изучать_V", 1, 0.6), (both, "тема_N", 2, 0.5), (both, "решать_V", 3, 0.4)],
        "key string, word string, rank int, score double",
    )
    found = suggest.propose(rows, near)
    got = {(r.level, " ".join(r.words)): (r["rank"], round(r.score, 6)) for r in found.collect()}
    assert got == {(1, "изучать_V вопрос_N"): (1, 0.9), (1, "рассматривать_V тема_N"): (1, 0.7), (2, "изучать_V тема_N"): (3, 1.1), (2, "решать_V тема_N"): (5, 0.9)}
    stats = spark.createDataFrame([("изучать", "тема", 4, 1.0, 2.0), ("изучать", "вопрос", 0, 1.0, 2.0)], "w1 string, w2 string, freq long, pmi double, t_score double")
    out = suggest.replacements(found, stats, 2)
    assert [(r.suggested, r.numReplaced, r.ngram_freq) for r in out.collect()] == [("изучать_V тема_N", 2, 4)]
    assert len(suggest.nested(out).first().results) == 1
    assert {(r.position, r.word) for r in suggest.components(colloc, 2).collect()} == {(1, "рассматривать"), (2, "вопрос")}
    model = suggest.propose_with(rows, lambda: lambda texts: [[["да", "нет"]] * t.count("<mask>") for t in texts])
    assert model.count() == 2 + 2 + 4 and model.agg(F.max("rank")).first()[0] == 2


def test_ranked(spark):
    near = spark.createDataFrame([("a", "x", 1, 0.5), ("b", "y", 1, 0.25)], "query string, word string, rank int, score double")
    cands = suggest.original_candidates(spark.createDataFrame([("a b",)], "colloc string"), near)
    facts = spark.createDataFrame([("a", "b", 9, 3), ("x", "y", 2, 1), ("q", "b", 5, 5)], "w1 string, w2 string, ngram_freq long, doc_freq long")
    got = suggest.ranked(cands, facts, 2).collect()
    assert [(r.w1, r.w2, r.sum_of_rank, round(r.log_rank, 6)) for r in got] == [("x", "y", 2, round(math.log(0.125), 6)), ("a", "b", 0, 0.0)]
    one = spark.createDataFrame([("c", "s"), ("c", "t")], "colloc string, suggested string")
    few = suggest.fewest_replacements([one.where("suggested = 's'"), one]).collect()
    assert {(r.suggested, r.num_replacements) for r in few} == {("s", 1), ("t", 2)}


def test_combinations_begin_at_the_cheapest_position(spark):
    """A hundred neighbours a position: what is joined before the last position is decided is no more than the attested
    n-grams of the position that has fewest, never the product of the positions."""
    topn, rng = 100, random.Random(5)
    tokens = [f"{w}_N" for w in "abc"]
    near = [(" ".join(t for t, m in zip(tokens, mask, strict=True) if not m), f"{w}_N", r, 1 / r) for mask in suggest.masks(3, 3) + suggest.masks(3, 2) + suggest.masks(3, 1) for r, w in enumerate(rng.sample([f"n{k}" for k in range(150)], topn), 1)]
    near = spark.createDataFrame(near, "key string, word string, rank int, score double")
    masked = suggest.with_masks(spark.createDataFrame([(" ".join(tokens),)], "colloc string"))
    grams = {("hub", f"n{rng.randrange(150)}", f"n{rng.randrange(150)}") for _ in range(3000)} | {tuple(f"n{rng.randrange(150)}" for _ in range(3)) for _ in range(2000)}
    grams |= {("a", f"n{k}", f"n{(7 * k) % 150}") for k in range(150)} | {("a", "b", f"n{k}") for k in range(150)} | {(f"n{k}", "b", "c") for k in range(150)}
    facts = spark.createDataFrame([(*g, 1 + i % 3, float(i), 2.0) for i, g in enumerate(sorted(grams))], "w1 string, w2 string, w3 string, freq long, pmi double, t_score double")
    cands = suggest.candidates_near(masked, near, topn)
    got = suggest.attested_replacements(cands, facts, 3)
    want = suggest.replacements(suggest.propose(masked, near, topn), facts, 3)
    key = lambda r: (r.original, r.suggested, r["rank"], round(r.cosScore, 9), r.numReplaced, r.pmi, r.ngram_freq)
    assert Counter(map(key, got.collect())) == Counter(map(key, want.collect())) and got.count() > 300
    by = ["level", "mask"]
    cut = multiway.cut_down(cands, facts, 3)
    rows = {tuple(r[:2]): r["count"] for r in multiway.started(cands, cut, 3, by, multiway.costs(cands, cut, 3, by)).groupBy(*by).count().collect()}
    held = {}
    for r in cands.collect():
        held.setdefault((r.level, r.mask), {}).setdefault(r.position, set()).add(r.word)
    known = [tuple(r[:3]) for r in cut.select("w1", "w2", "w3").collect()]
    for k, n in rows.items():
        assert n == min(sum(g[p - 1] in held[k][p] for g in known) for p in (1, 2, 3))
    assert sum(rows.values()) < sum(len(w[1]) * len(w[2]) * len(w[3]) for w in held.values()) / 100


def test_contexts(spark):
    """Against a plain version, held out; gaps at the ends, beside gaps and in unknown company."""
    rng = random.Random(9)
    after = {w: rng.sample("abcdefghij", 3) for w in "abcdefghij"}

    def walk(n):
        out = ["a"]
        while len(out) < n:
            out.append(rng.choice(after[out[-1]]))
        return out

    texts = [walk(30) for _ in range(200)]
    counts = [Counter(tuple(t[k : k + n]) for t in texts[:150] for k in range(len(t) - n + 1)) for n in (1, 2, 3)]
    frames = [spark.createDataFrame([(*g, c) for g, c in table.items()], ", ".join([*(f"w{k} string" for k in range(1, n + 1)), "freq long"])) for n, table in enumerate(counts, 1)]
    one, two, three = counts

    def plain(left, right):
        p = Counter()
        for w in "abcdefghij":
            shares = [0.4 * 0.4 * one[w,] / one.total()]
            if left:
                shares.append(0.4 * two[left, w] / max(1, sum(c for g, c in two.items() if g[0] == left)))
            if right:
                shares.append(0.4 * two[w, right] / max(1, sum(c for g, c in two.items() if g[1] == right)))
            if left and right:
                shares.append(three[left, w, right] / max(1, sum(c for g, c in three.items() if (g[0], g[2]) == (left, right))))
            p[w] = max(shares)
        return sorted(((round(-x, 12), w) for w, x in p.items()))[:4]

    model = context.Contexts.learn(*frames, topn=4)
    asked = {"a <mask> b": [("a", "b")], "<mask> c": [(None, "c")], "d <mask>": [("d", None)], "x <mask> <mask> e": [("x", None), (None, "e")], "<mask>": [(None, None)], "no gap": []}
    got = {}
    for r in model.guesses(spark.createDataFrame([(t,) for t in (*asked, "<mask>", None)], "text string")).collect():
        got.setdefault((r.text, r.k), []).append((r.r, round(-r.p, 12), r.w))
    assert {k: [x[1:] for x in sorted(v)] for k, v in got.items()} == {(t, k): plain(*g) for t, gaps in asked.items() for k, g in enumerate(gaps)}
    held = [(t[k - 1], t[k], t[k + 1]) for t in texts[150:] for k in range(1, 29)]
    best = {r.text: r.w for r in model.guesses(spark.createDataFrame(sorted({(f"{a} <mask> {c}",) for a, _, c in held}), "text string")).where("r = 0").collect()}
    assert sum(best[f"{a} <mask> {c}"] == b for a, b, c in held) > 0.5 * len(held)
    assert context.Contexts.learn(*(f.limit(0) for f in frames), topn=4).guesses(spark.createDataFrame([("<mask> a",)], "text string")).count() == 0


def test_evaluation_sets(spark):
    rows = spark.createDataFrame([("d", k, w, t) for k, (w, t) in enumerate(zip("изучать новый тема в доме тема".split(), "VANSNN", strict=True))], "doc_id string, pos int, word string, tag string")
    got = {(r.pos, r.template, r.ngram) for r in evalset.template_matches(rows).collect()}
    assert got == {(1, "a_n", "новый тема"), (2, "n_s_n", "тема в доме"), (4, "n_n", "доме тема")}
    twice = evalset.template_matches(rows).unionByName(evalset.template_matches(rows))
    assert evalset.frequency_band(twice).count() == 6 and evalset.frequency_band(twice, 3, 4).count() == 0
    m = spark.createDataFrame([("И. Петров изучал новую тему", 1), ("А. изучал В. тему", 1)], "o string, s int")
    guarded = evalset.name_guard(m, F.col("o"), F.col("s"), F.lit(2)).collect()
    assert [(r.o, r.start) for r in guarded] == [("И. Петров изучал новую тему", 2)]
    shown = m.select(evalset.context(F.col("o"), F.lit(3), F.lit(2))).first()[0]
    assert shown == "И. Петров изучал <error> новую тему </error> "
    syn = spark.createDataFrame([("новый", "свежий"), ("тема", "предмет"), ("тема", "тема")], "word string, synonym string")
    pairs = spark.createDataFrame([("новый", "тема")], "w1 string, w2 string")
    assert {(r.w1, r.w2, r.replaced) for r in evalset.synonym_variants(pairs, syn, 2).collect()} == {("свежий", "тема", 1), ("новый", "предмет", 2)}
    last = evalset.originals(spark.createDataFrame([("А", "one", 1), ("а", "two", 2)], "lemma_text string, original string, ordinal int")).collect()
    assert [tuple(r) for r in last] == [("а", "two")]


def test_phrases(spark):
    words = ("a b c " * 10 + "x y z w " * 10).split()
    rows = spark.createDataFrame([("d", k, w) for k, w in enumerate(words)], "doc_id string, pos int, word string")
    found = evalset.phrase_scores(rows, least=5, threshold=0.5)
    assert {"a b", "x y"} <= {f"{r.w1} {r.w2}" for r in found.collect()}
    merged = [r.word for r in evalset.merge_phrases(rows, found.where("w1 in ('a', 'b') and w2 in ('b', 'c')")).orderBy("pos").limit(4).collect()]
    assert merged == ["a b", "c", "a b", "c"]


def test_file_diff(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "k string") for xs in (["1", "2", None], ["2", "3", "3"]))
    assert {(r.k, r.side) for r in audit.file_diff(a, b, "k").collect()} == {("1", "left"), ("3", "right")}


def test_files(spark, tmp_path):
    (tmp_path / "h" / "Law").mkdir(parents=True)
    (tmp_path / "h" / "Law" / "a.b.html").write_text("<p>\nx</p>", encoding="utf-8")
    (tmp_path / "h" / "x.txt").write_text("one\ntwo", encoding="utf-8")
    root = str(tmp_path / "h")
    assert [(r.doc_id, r.field, r.html) for r in files.read_texts(spark, root).collect()] == [("a.b", "Law", "<p>\nx</p>")]
    assert files.list_files(spark, root, ".html").count() == 1 and files.read_lines(spark, f"{root}/x.txt").count() == 2
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("m.txt", " раз \n\nдва\n")
    assert files.read_zips(spark, str(tmp_path / "z.zip")).first().text == " раз \n\nдва\n"
    assert files.read_zips(spark, str(tmp_path / "z.zip"), lines=True).first().text == " раз два"
    (tmp_path / "v.txt").write_text("2 2\nа 1 0.5\nб 0 1\n", encoding="utf-8")
    v = files.read_vectors(spark, str(tmp_path / "v.txt"))
    assert {r.word: r.vec for r in v.collect()} == {"а": [1.0, 0.5], "б": [0.0, 1.0]}
    for folder in ("Law", "Art"):
        (tmp_path / "g" / folder).mkdir(parents=True)
        (tmp_path / "g" / folder / f"{folder}1.html").write_text("<p>y</p>", encoding="utf-8")
    fields = files.read_fields(spark, str(tmp_path / "g"), ["Law", "Art"])
    one = fields.where("field = 'Art'")
    assert fields.count() == 2 and one.first().doc_id == "Art1" and one._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    files.write_by_field(fields, str(tmp_path / "fields"))
    assert "PartitionFilters: [isnotnull(field" in spark.read.parquet(str(tmp_path / "fields")).where("field = 'Art'")._jdf.queryExecution().executedPlan().toString()
    files.write_vectors(v, str(tmp_path / "v2"))
    assert files.read_vectors(spark, str(tmp_path / "v2")).count() == 2
    two = b"2 3\n" + b"".join(w.encode() + b" " + np.array(x, "<f4").tobytes() + b"\n" for w, x in (("слово", [1, 2, 3]), ("b", [0.5, 0, -1])))
    (tmp_path / "v.bin").write_bytes(two)
    assert {r.word: r.vec for r in files.read_binary_vectors(spark, str(tmp_path / "v.bin")).collect()} == {"слово": [1.0, 2.0, 3.0], "b": [0.5, 0.0, -1.0]}
    (tmp_path / "g.txt").write_text("а 1 0.5\nб 0 1\n", encoding="utf-8")
    assert files.read_vectors(spark, str(tmp_path / "g.txt")).count() == 2
    (tmp_path / "n.tsv").write_text("a b\t1\na b\t5\n", encoding="utf-8")
    assert [(r.ngram, r.freq) for r in files.read_ngrams(spark, str(tmp_path / "n.tsv")).orderBy("line").collect()] == [("a b", "1"), ("a b", "5")]
    rows = spark.createDataFrame([("a b", 'c, "d"')], "original string, suggested string")
    files.write_results(rows, str(tmp_path / "r"))
    assert files.read_csv(spark, str(tmp_path / "r")).first().suggested == 'c, "d"'
    files.write_csv(rows, str(tmp_path / "t"), "\t")
    assert files.read_csv(spark, str(tmp_path / "t"), "original string, suggested string", "\t").first().original == "a b"
    batch = lambda *rows: spark.createDataFrame(rows, "doc_id string, text string")
    for as_files, path in ((True, str(tmp_path / "w")), (False, str(tmp_path / "w2"))):
        files.write_texts(batch(("Док 1", "текст")), path, files=as_files)
        files.write_texts(batch(("Док 1", "иной"), ("002", "второй")), path, files=as_files)
        read = spark.read.text(path) if as_files else spark.read.parquet(path).withColumnRenamed("text", "value")
        assert sorted(r.value for r in files.head(read)) == ["второй", "текст"]
        files.write_texts(batch(("002", "снова")), path, "append", files=as_files)
        assert read.sparkSession.read.format("text" if as_files else "parquet").load(path).count() == 3
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.error) for r in files.convert(spark, root, lambda: lambda b: b.decode().upper(), ".txt").collect()}
    assert got == {"x.txt": ("ONE\nTWO", None), "a.b.html": (None, "not .txt")}
    rows.write.parquet(str(tmp_path / "p"))
    assert files.read_table(spark, str(tmp_path / "p")).count() == 1


def test_stream(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Научные исследования показывают интересные (см. [1]) результаты. Да.")], "doc_id int, text string")
    docs.write.parquet(str(tmp_path / "in"))
    rows = clean_stream(read_stream(spark, str(tmp_path / "in"), "doc_id int, text string"))
    write_stream(rows, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_stream_of_windows(spark, tmp_path):
    """Windows that the watermark has passed come out once; a row that is later than the watermark counts nowhere."""
    schema = "ts timestamp, word string"
    batch = lambda *rows: spark.sql("select cast(t as timestamp) as ts, w as word from values " + ", ".join(f"('2024-01-01 {t}', '{w}')" for t, w in rows) + " as x(t, w)")
    run = lambda: write_stream(count_words(read_stream(spark, str(tmp_path / "in"), schema)), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    batch(("00:01:00", "a"), ("00:02:00", "a"), ("00:06:00", "b"), ("01:00:00", "c")).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    batch(("00:03:00", "a"), ("02:00:00", "c")).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    got = {(r.window.start.strftime("%H:%M"), r.word): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("00:00", "a"): 2, ("00:05", "b"): 1, ("01:00", "c"): 1}


def test_matches_of_texts_and_contexts_of_the_band_alone(spark):
    """the next words come from the text's own array; sentences are not carried through the count."""
    from lexweave.operators import evalset, tokens

    texts = spark.createDataFrame([(1, "making word"), (2, "making word now"), (3, ""), (4, None), (5, "a word of making")], "doc_id int, text string")
    got = evalset.text_matches(texts, tokens.words(F.col("text")), tokens.suffix_tag)
    want = evalset.template_matches(tokens.tag(tokens.tokens(texts)))
    key = lambda df: sorted(map(tuple, df.select("doc_id", "pos", "template", "ngram").collect()))
    assert key(got) == key(want) and key(got) and got.columns == ["doc_id", "text", "pos", "template", "ngram"]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    originals = texts.select("doc_id", F.col("text").alias("original"))
    twice = originals.unionByName(originals.where("doc_id = 1"))
    found = evalset.unattested_contexts(got, spark.createDataFrame([], "ngram string"), twice, 3, 3)
    assert sorted(r.context for r in found.where("ngram = 'making word'").collect()) == [" <error> making word </error> "] * 2 + [" <error> making word </error> now"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    window = next(x for x in plan.splitlines() if "Window [" in x)
    assert "original" not in window.split("Window")[1]


def test_combinations_broadcast_nothing_by_the_size_of_files(spark):
    """A compressed file of candidates is far smaller than its rows, so joins with it merge."""
    from lexweave.operators.multiway import combine

    candidates = spark.createDataFrame([("c", p, w, p) for p in (1, 2, 3) for w in "abc"], "colloc string, position int, word string, rank int")
    facts = spark.createDataFrame([("a", "b", "c", 1), ("a", "x", "c", 2), ("c", "c", "a", 3)], "w1 string, w2 string, w3 string, freq int")
    found = combine(candidates, facts, 3, ["colloc"])
    assert sorted(r.freq for r in found.collect()) == [1, 3]
    assert "Broadcast" not in found._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.parametrize("name", ["nearest_cosine", "nearest_cosmul"])
def test_neighbours_of_near_equal_scores(spark, name):
    """what single precision cannot tell apart is told apart in double precision; ties go by the word."""

    rng = np.random.default_rng(5)
    base = rng.normal(size=8)
    rows = [(f"w{k:03d}", (base + (k // 2) * 1e-7 * rng.normal(size=8) if k % 2 == 0 else base * 3).tolist()) for k in range(60)]
    rows += [(f"x{k:03d}", rng.normal(size=8).tolist()) for k in range(200)]
    v = spark.createDataFrame(rows, "word string, vec array<double>")
    asked = spark.createDataFrame([("one", "w000"), ("two", "w001"), ("two", "x003"), ("far", "x001"), ("none", "y")], "query string, word string")
    got = {(r.query, r["rank"]): (r.word, r.score) for r in getattr(vectors, name)(v, asked, 12).collect()}
    unit = {w: np.array(x) / np.sqrt(np.dot(x, x)) for w, x in rows}
    for q, own in (("one", ["w000"]), ("two", ["w001", "x003"]), ("far", ["x001"])):
        if name == "nearest_cosine":
            m = sum(unit[w] for w in own)
            score = {w: round(float(u @ m / np.sqrt(m @ m)), 12) for w, u in unit.items() if w not in own}
        else:
            score = {w: round(float(np.prod([(1 + u @ unit[o]) / 2 for o in own])), 12) for w, u in unit.items() if w not in own}
        want = sorted(score.values(), reverse=True)[:12]
        assert [got[q, k][1] for k in range(1, 13)] == pytest.approx(want, abs=2e-12)
        assert all(score[w] == pytest.approx(s, abs=2e-12) for (p, _), (w, s) in got.items() if p == q)
    assert len(got) == 36


def test_merged_phrases_leave_tokens_where_they_are(spark, monkeypatch):
    """few pairs are sent to all tasks; beyond the count they meet the tokens by a shuffle, with the same rows."""
    rows = [(d, p, w) for d in (1, 2) for p, w in enumerate("a b c d a b x c d c d".split())]
    made = spark.createDataFrame(rows, "doc_id int, pos int, word string")
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "w1 string, w2 string")
    found, want = [], [(d, p, w) for d in (1, 2) for p, w in ((0, "a b"), (2, "c d"), (4, "a b"), (6, "x"), (7, "c d"), (9, "c d"))]
    for most in (evalset.MOST_PHRASES, 0):
        monkeypatch.setattr(evalset, "MOST_PHRASES", most)
        merged = evalset.merge_phrases(made, pairs)
        assert sorted(map(tuple, merged.collect())) == want
        found.append(merged._jdf.queryExecution().sparkPlan().toString())
    assert "BroadcastHashJoin" in found[0] and "SortMergeJoin" not in found[0] and "SortMergeJoin" in found[1]


def test_trigrams_of_the_star_need_no_join_for_their_counts(spark):
    """the tokens' table has the counts; one without them is joined with the frequencies'."""
    words = [(1, k, w, w.lower(), "N") for k, w in enumerate("A b c a B c a b".split())]
    tables = ngrams.star(spark.createDataFrame(words, "doc_id int, pos int, word string, lemma string, tag string"))
    bare = tables | {"ngram3_tokens": tables["ngram3_tokens"].drop("raw_frequency")}
    got = ngrams.lemma_trigrams(tables)
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(map(tuple, ngrams.lemma_trigrams(bare).collect())) == [("a", "b", "c", 2), ("b", "c", "a", 2), ("c", "a", "b", 2)]
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins(got) == joins(ngrams.lemma_trigrams(bare)) - 1


def test_phrases_of_texts_are_merged_where_they_are(spark, monkeypatch):
    """F4, F5 of round 4: as by tokens, with no token shuffled; more pairs than are sent give the same rows."""
    draw = random.Random(4)
    made = [(d, [draw.choice("abcdé") for _ in range(draw.choice([0, 1, 2, 30]))]) for d in range(40)] + [(99, None)]
    texts = spark.createDataFrame(made, "doc_id int, ws array<string>")
    rows = texts.select("doc_id", F.posexplode("ws").alias("pos", "word"))
    scores = [sorted(map(tuple, x.collect())) for x in (evalset.phrase_scores(rows, 2, 0.01), evalset.text_phrase_scores(texts, F.col("ws"), 2, 0.01))]
    assert len(scores[0]) > 3 and [x[:3] for x in scores[0]] == [x[:3] for x in scores[1]] and [x[3] for x in scores[0]] == pytest.approx([x[3] for x in scores[1]])
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "a"), ("é", "d")], "w1 string, w2 string")
    want = sorted(map(tuple, evalset.merge_phrases(rows, pairs).collect()))
    for most in (evalset.MOST_SENT, 0):
        monkeypatch.setattr(evalset, "MOST_SENT", most)
        merged = evalset.merge_texts(texts, F.col("ws"), pairs)
        assert ("Exchange" in merged._jdf.queryExecution().executedPlan().toString()) == (most == 0)
        assert sorted(map(tuple, merged.select("doc_id", F.explode(F.arrays_zip("positions", "words")).alias("x")).select("doc_id", "x.*").collect())) == want


def test_trigrams_of_the_star_are_written_before_they_are_joined(spark):
    """F11 of round 4: what counts them is not on disk beside what joins them."""
    from lexweave.plans import queries

    found = queries.star_trigram_freq(spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join " in plan and "id_trigram" not in plan
