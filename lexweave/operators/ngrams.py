"""N-gram tables: frequencies, attestation, association, and the star schema of wordforms and lemmas."""

from __future__ import annotations

import logging
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import association as A
from lexweave.operators.counting import ngram_counts
from lexweave.sources.scratch import keep

log = logging.getLogger(__name__)

# Abbreviations and marks that are no members of a combination.
NO_WORDS = ("А", "В", "Д", "Л", "И", "УК", "Н", "М", "КС", "Ф", "Оп")
NO_CONNECTORS = ("NUM", "", ",", "…", ":", "(", ")", '"', "©")
# End of fixed values.


def names(n: int) -> list[str]:
    return [f"w{k}" for k in range(1, n + 1)]


def occurrences(tokens: DataFrame, n: int, word: str = "word") -> DataFrame:
    """doc_id, pos, w1 .. wn: the n-gram at every position that has one, from one window by document."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    rows = tokens.select("doc_id", "pos", F.col(word).alias("w1"), *(F.lead(word, k).over(w).alias(f"w{k + 1}") for k in range(1, n)))
    return rows.where(F.col(f"w{n}").isNotNull()) if n > 1 else rows


def array_occurrences(docs: DataFrame, words: Column, n: int, id_col: str = "doc_id") -> DataFrame:
    """As occurrences(), from an array of words, without any exchange: the array is zipped with itself, shifted."""
    count = F.greatest(F.size("_w") - (n - 1), F.lit(0))
    shifted = F.arrays_zip(*(F.slice("_w", k, count).alias(f"w{k}") for k in range(1, n + 1)))
    rows = docs.select(F.col(id_col).alias("doc_id"), words.alias("_w"))
    return rows.select("doc_id", F.posexplode(shifted).alias("pos", "g")).select("doc_id", "pos", *(F.col("g").getField(f"w{k}").alias(f"w{k}") for k in range(1, n + 1)))


def frequencies(grams: DataFrame, n: int) -> DataFrame:
    """w1 .. wn, freq."""
    return grams.groupBy(*names(n)).agg(F.count("*").alias("freq"))


def frequencies_to(docs: DataFrame, words: Column, n: int, id_col: str = "doc_id") -> dict[int, DataFrame]:
    """1 to n: w1 .., freq of the n-grams of each order, from one pass over the texts.

    A row a word, with the n - 1 words behind it (null beyond the end), is counted and written; lower orders are sums over
    that table, which is read in place of the texts."""
    whole = keep(ngram_counts(docs, words, n, ends=True), "grams")
    out = {n: whole.where(F.col(f"w{n}").isNotNull())}
    for k in range(n - 1, 0, -1):
        out[k] = whole.where(F.col(f"w{k}").isNotNull()).groupBy(*names(k)).agg(F.sum("freq").alias("freq"))
    return out


def document_frequencies(grams: DataFrame, n: int) -> DataFrame:
    """w1 .. wn, ngram_freq, doc_freq. Counted by document first, so no set of documents is kept for any n-gram."""
    each = grams.groupBy(*names(n), "doc_id").agg(F.count("*").alias("k"))
    return each.groupBy(*names(n)).agg(F.sum("k").alias("ngram_freq"), F.count("*").alias("doc_freq"))


def domain_size(table: DataFrame, column: str = "word", approximate: bool = False) -> DataFrame:
    """The number of distinct lemmas."""
    count = F.approx_count_distinct if approximate else F.countDistinct
    return table.agg(count(column).alias("domain_size"))


def lookup(candidates: DataFrame, freq: DataFrame, n: int, ordinal: str | None = None) -> DataFrame:
    """Every candidate row (w1 .. wn and others), with freq, 0 where the table has none; duplicates stay. With
    ordinal, a column of the candidates, in its order."""
    found = candidates.join(freq, names(n), "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    return found if ordinal is None else found.orderBy(ordinal)


def attested(grams: DataFrame, *components: DataFrame) -> DataFrame:
    """Distinct n-grams whose k-th word is in the k-th component set (word); for 2 or 3 components. R8: another
    number is logged and gives no rows."""
    w = names(len(components))
    if len(components) not in (2, 3):
        log.warning("attestation is for combinations of two or three words, not %d", len(components))
        return grams.select(*(F.lit(None).cast("string").alias(x) for x in w)).where(F.lit(False))
    return _of_components(grams, components).select(*w).distinct()


def _of_components(grams: DataFrame, components: tuple[DataFrame, ...]) -> DataFrame:
    for k, c in enumerate(components, 1):
        grams = grams.join(c.select(F.col("word").alias(f"w{k}")), f"w{k}", "left_semi")
    return grams


def attested_frequencies(grams: DataFrame, *components: DataFrame) -> DataFrame:
    """R9 with its filters: document_frequencies() of the n-grams whose k-th word is in the k-th component set. Counted first, by n-gram and
    document: joins by one word would bring all places of a frequent word, and then their sums, to one task. Only distinct n-grams are joined, with
    sets whose words are distinct, since Spark would move a semi-join below the count."""
    w = names(len(components))
    out = document_frequencies(grams, len(w))
    for k, c in zip(w, components, strict=True):
        out = out.join(c.select(F.col("word").alias(k)).distinct(), k)
    return out.select(*w, "ngram_freq", "doc_freq")


def unattested(candidates: DataFrame, freq: DataFrame, n: int) -> DataFrame:
    return candidates.join(freq, names(n), "left_anti")


def statistics(grams: DataFrame, lower: DataFrame, single: DataFrame, n: int, size: DataFrame) -> DataFrame:
    """M5, M6: n-grams (w1 .. wn, freq) with pmi, t_score and log_dice. The pattern is all words but the last; lower and
    single hold the frequencies of n - 1 and single words (w1 .., freq); size is one row with n, the domain's size."""
    head = names(n)[:-1]
    out = grams.join(lower.select(*head, F.col("freq").alias("c_pattern")), head, "left")
    out = out.join(single.select(F.col("w1").alias(f"w{n}"), F.col("freq").alias("c_last")), f"w{n}", "left")
    out = out.crossJoin(F.broadcast(size.select(F.col(size.columns[0]).alias("n"))))
    args = F.col("freq"), F.coalesce("c_pattern", F.lit(0)), F.coalesce("c_last", F.lit(0))
    return out.select(*names(n), "freq", A.pmi(*args, F.col("n")).alias("pmi"), A.t_score(*args, F.col("n")).alias("t_score"), A.log_dice(*args).alias("log_dice"))


def text_statistics(docs: DataFrame, words: Column, n: int, least: int = 1) -> DataFrame:
    """statistics() of the texts' n-grams of a frequency of least or more, from the texts. N-grams are dealt to tasks by all words but the
    last, so the pattern's frequency is a sum over rows that stand together, and nothing is shuffled for it."""
    head = names(n)[:-1]
    single = keep(ngram_counts(docs, words, 1), "words")
    whole = ngram_counts(docs, words, n, ends=True, dealt=n - 1).withColumn("c_pattern", F.sum("freq").over(Window.partitionBy(*head)))
    grams = whole.where(F.col(f"w{n}").isNotNull() & (F.col("freq") >= least))
    out = grams.join(single.select(F.col("w1").alias(f"w{n}"), F.col("freq").alias("c_last")), f"w{n}", "left")
    args = F.col("freq"), F.col("c_pattern"), F.coalesce("c_last", F.lit(0))
    size = F.lit(single.count()).cast("long")
    return out.select(*names(n), "freq", A.pmi(*args, size).alias("pmi"), A.t_score(*args, size).alias("t_score"), A.log_dice(*args).alias("log_dice"))


def c_values(shorter: DataFrame, longer: DataFrame, n: int) -> DataFrame:
    """M4: n-grams with c_value, given the (n + 1)-grams, each of which contains two n-grams (one, if they are equal)."""
    w = names(n + 1)
    parts = [longer.select(*(F.col(w[k + s]).alias(w[k]) for k in range(n)), "freq") for s in (0, 1)]
    same = reduce(lambda a, b: a & b, (F.col(w[k]) == F.col(w[k + 1]) for k in range(n)))
    inside = parts[0].unionByName(longer.where(~same).select(*(F.col(w[k + 1]).alias(w[k]) for k in range(n)), "freq"))
    held = inside.groupBy(*names(n)).agg(F.count("*").alias("longer"), F.sum("freq").alias("longer_freq"))
    out = shorter.join(held, names(n), "left")
    return out.select(*names(n), "freq", A.c_value(F.lit(n), F.col("freq"), F.coalesce("longer", F.lit(0)), F.coalesce("longer_freq", F.lit(0))).alias("c_value"))


def star(tokens: DataFrame) -> dict[str, DataFrame]:
    """The wordform star of tagged tokens (doc_id, pos, word, lemma, tag): lemmas, pos, unigrams, ngram2, ngram3,
    ngram3_tokens. Keys are hashes of what they stand for, so no table needs a global numbering. The tokens are written
    once, in the shared scratch folder, and all six tables read what they need of them. Tokens may have their morphology
    (morph), which is then part of a wordform."""
    form = ["word", "lemma", "tag", *(["morph"] if "morph" in tokens.columns else [])]
    tokens = keep(tokens.select("doc_id", "pos", *form), "tokens")
    key = lambda *c: F.xxhash64(*c)
    t = tokens
    w = Window.partitionBy("doc_id").orderBy("pos")
    lemmas = t.select("lemma", "tag").distinct().select(key("lemma", "tag").alias("id_lemmas"), "lemma", key("tag").alias("id_pos"))
    pos = t.select("tag").distinct().select(key("tag").alias("id_pos"), F.col("tag").alias("pos"))
    uni = t.groupBy(*form).agg(F.count("*").alias("freq_all"))
    morph = F.col("morph") if "morph" in form else F.concat(F.lit("Tag="), "tag").alias("morph")
    uni = uni.select(key(*form).alias("id_unigram"), F.col("word").alias("unigram"), key("lemma", "tag").alias("lemma"), "freq_all", morph)
    ids = t.select(key(*form).alias("w1"), "doc_id", "pos")
    ids = ids.select("w1", F.lead("w1", 1).over(w).alias("w2"), F.lead("w1", 2).over(w).alias("w3"))
    two = ids.where("w2 is not null").groupBy("w1", "w2").agg(F.count("*").alias("raw_frequency")).select(key("w1", "w2").alias("id_bigram"), F.col("w1").alias("wordform_1"), F.col("w2").alias("wordform_2"), "raw_frequency")
    three = ids.where("w3 is not null").groupBy("w1", "w2", "w3").agg(F.count("*").alias("raw_frequency")).withColumn("id_trigram", key("w1", "w2", "w3"))
    return {
        "lemmas": lemmas, "pos": pos, "unigrams": uni, "ngram2": two,
        "ngram3": three.select("id_trigram", key("w1", "w2").alias("bigram"), F.col("w3").alias("token"), "raw_frequency"),
        "ngram3_tokens": three.select("id_trigram", "w1", "w2", "w3", "raw_frequency"),
    }


def _forms(tables: dict[str, DataFrame], k: int) -> DataFrame:
    """u{k} (id_unigram), n{k}, morph{k}, l{k}, pos{k}."""
    u, lem, pos = tables["unigrams"], tables["lemmas"].withColumnRenamed("lemma", "_l"), tables["pos"]
    out = u.join(lem, u["lemma"] == lem["id_lemmas"], "left").join(pos, "id_pos", "left")
    return out.select(F.col("id_unigram").alias(f"u{k}"), F.col("unigram").alias(f"n{k}"), F.col("morph").alias(f"morph{k}"), F.col("_l").alias(f"l{k}"), F.col("pos").alias(f"pos{k}"))


def lemma_unigrams(tables: dict[str, DataFrame], candidates: DataFrame | None = None) -> DataFrame:
    """Lemma, freq: the sum over its wordforms, 0 for a lemma without any."""
    lem = tables["lemmas"].select("id_lemmas", "lemma")
    if candidates is not None:
        lem = lem.join(candidates.select(F.col("w1").alias("lemma")), "lemma", "left_semi")
    joined = lem.join(tables["unigrams"].select(F.col("lemma").alias("id_lemmas"), "freq_all"), "id_lemmas", "left")
    return joined.groupBy("lemma").agg(F.coalesce(F.sum("freq_all"), F.lit(0)).alias("freq"))


def _wanted_forms(tables: dict[str, DataFrame], k: int, candidates: DataFrame | None) -> DataFrame:
    """_forms(), of the candidates' k-th lemmas only, so that the facts are cut down by the first joins."""
    forms = _forms(tables, k).select(f"u{k}", f"l{k}")
    return forms if candidates is None else forms.join(candidates.select(F.col(f"w{k}").alias(f"l{k}")), f"l{k}", "left_semi")


def _summed(facts: DataFrame, n: int, candidates: DataFrame | None) -> DataFrame:
    out = facts.groupBy(*(F.col(f"l{k}").alias(f"w{k}") for k in range(1, n + 1))).agg(F.coalesce(F.sum("raw_frequency"), F.lit(0)).alias("freq"))
    return out if candidates is None else out.join(candidates.select(*names(n)), names(n), "left_semi")


def lemma_bigrams(tables: dict[str, DataFrame], candidates: DataFrame | None = None) -> DataFrame:
    """w1, w2, freq by lemma, of the candidates (w1, w2) if given."""
    facts = tables["ngram2"].select(F.col("wordform_1").alias("u1"), F.col("wordform_2").alias("u2"), "raw_frequency")
    for k in (1, 2):
        facts = facts.join(_wanted_forms(tables, k, candidates), f"u{k}")
    return _summed(facts, 2, candidates)


def lemma_trigrams(tables: dict[str, DataFrame], candidates: DataFrame | None = None) -> DataFrame:
    """w1, w2, w3, freq by lemma, of the candidates if given: the tokens' table, joined with the frequencies' by
    id_trigram where it has none of its own, as star() gives it."""
    facts = tables["ngram3_tokens"]
    if "raw_frequency" not in facts.columns:
        facts = facts.join(tables["ngram3"].select("id_trigram", "raw_frequency"), "id_trigram", "left")
    facts = facts.select(*(F.col(f"w{k}").alias(f"u{k}") for k in (1, 2, 3)), "raw_frequency")
    for k in (1, 2, 3):
        facts = facts.join(_wanted_forms(tables, k, candidates), f"u{k}")
    return _summed(facts, 3, candidates)


def _most_frequent(facts: DataFrame, most: int | None) -> DataFrame:
    """The most frequent facts, all of the last one's frequency included, or all. Below the joins this is part of the
    question asked, not only of its speed."""
    if most is None:
        return facts
    least = facts.select("raw_frequency").orderBy(F.desc("raw_frequency")).limit(most).agg(F.min("raw_frequency").alias("_least"))
    return facts.crossJoin(F.broadcast(least)).where("raw_frequency >= _least").drop("_least")


def _kept(rows: DataFrame, n: int, most: int | None) -> DataFrame:
    forms = [f"{c}{k}" for c in ("n", "l", "pos") for k in range(1, n + 1)]
    return rows if most is None else rows.orderBy(F.desc("raw_frequency"), *forms).limit(most)


def _members(tables: dict[str, DataFrame], k: int, member: Callable[[int], Column] | None, scanned: int | None) -> tuple[DataFrame, str]:
    """The forms of position k, and how facts are joined with them: where all facts are scanned those that cannot be
    wanted there are left out before the join."""
    return (_forms(tables, k), "left") if member is None or scanned is not None else (_forms(tables, k).where(member(k)), "inner")


def top_bigrams(tables: dict[str, DataFrame], wanted: Column, scanned: int | None = 10_000, kept: int | None = 300, member: Callable[[int], Column] | None = None) -> DataFrame:
    """Of the scanned most frequent bigrams those for which wanted (on n1, n2, morph1, .., l1, .., pos1, ..)
    holds, the kept most frequent of them; ties go by the words. member(k): what wanted implies for position k alone."""
    facts = _most_frequent(tables["ngram2"].select(F.col("wordform_1").alias("u1"), F.col("wordform_2").alias("u2"), "raw_frequency"), scanned)
    for k in (1, 2):
        forms, how = _members(tables, k, member, scanned)
        facts = facts.join(forms, f"u{k}", how)
    return _kept(facts.where(wanted), 2, kept).drop("u1", "u2")


def top_trigrams(tables: dict[str, DataFrame], wanted: Column, scanned: int | None = 20_000, kept: int | None = 300, member: Callable[[int], Column] | None = None) -> DataFrame:
    """The same for trigrams."""
    facts = _most_frequent(tables["ngram3"], scanned)
    two = tables["ngram2"].select(F.col("id_bigram").alias("bigram"), F.col("wordform_1").alias("u1"), F.col("wordform_2").alias("u2"))
    out = facts.join(two, "bigram", "left").withColumnRenamed("token", "u3")
    for k in (1, 2, 3):
        forms, how = _members(tables, k, member, scanned)
        out = out.join(forms, f"u{k}", how)
    return _kept(out.where(wanted), 3, kept).drop("u1", "u2", "u3", "bigram", "id_trigram")


def by_morphology(n: int, compat: bool = False) -> Column:
    """Verb and verb or noun, or noun or adjective and noun; for three words noun or verb, uninflected word, noun. The
    words of NO_WORDS take part in neither (compat: are only kept out of the second kind)."""
    verb, noun = (lambda k: F.col(f"morph{k}").contains("VerbForm")), (lambda k: F.col(f"morph{k}").contains("Animacy"))
    if n == 3:
        return noun(3) & (F.col("morph2") == "_") & ~F.col("n2").isin(*NO_CONNECTORS) & (verb(1) | noun(1))
    clean = ~F.col("n1").isin(*NO_WORDS) & ~F.col("n2").isin(*NO_WORDS)
    first, second = verb(1) & (verb(2) | noun(2)), noun(2) & (noun(1) | F.col("morph1").contains("Degree"))
    return first | (second & clean) if compat else (first | second) & clean


def by_pos(n: int, verb: str = "VERB", noun: str = "NOUN", adjective: str = "ADJ", adposition: str = "ADP") -> Column:
    one, two = F.col("pos1"), F.col("pos2")
    if n == 3:
        return one.isin(noun, verb) & (two == adposition) & (F.col("pos3") == noun)
    return (one == verb) & two.isin(verb, noun) | one.isin(noun, adjective) & (two == noun)


def read_tagged(lines: DataFrame) -> DataFrame:
    """Tagged n-grams 'w1 w2/t1 t2' (columns ngram, freq as text, line): pattern, last, freq; of repeated ones
    the last line holds."""
    one = lines.groupBy("ngram").agg(F.max_by(F.col("freq").cast("long"), "line").alias("freq"))
    w, t = F.split(F.split("ngram", "/")[0], " "), F.split(F.split("ngram", "/")[1], " ")
    head = lambda x: F.array_join(F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))), " ")
    return one.select("ngram", "freq", F.concat(head(w), F.lit("/"), head(t)).alias("pattern"), F.concat(F.element_at(w, -1), F.lit("/"), F.element_at(t, -1)).alias("last"))


def measure_tagged(ngrams: DataFrame, patterns: DataFrame, unigrams: DataFrame, n: int) -> DataFrame:
    """M5 on read_tagged() tables: ngram, log_dice, pmi, t_score; a pattern that is missing or of frequency 0 counts as
    1, a missing last word as 0."""
    out = ngrams.join(patterns.select(F.col("ngram").alias("pattern"), F.col("freq").alias("p")), "pattern", "left")
    out = out.join(unigrams.select(F.col("ngram").alias("last"), F.col("freq").alias("l")), "last", "left")
    args = F.col("freq"), F.coalesce(F.nullif("p", F.lit(0)), F.lit(1)), F.coalesce("l", F.lit(0))
    return out.select("ngram", A.log_dice(*args).alias("log_dice"), A.pmi(*args, F.lit(n)).alias("pmi"), A.t_score(*args, F.lit(n)).alias("t_score"))
