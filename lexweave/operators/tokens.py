"""Tokens: words of texts with their positions, lemmas and parts of speech."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import text as T

# What the part-of-speech tags and templates are.
KEPT_TAGS = ("A", "C", "I", "M", "N", "P", "Q", "R", "S", "V")
CONNECTOR_TAGS = ("_c", "_s", "_p", "_q")
# End of fixed values.

#: Characters of text that tokenize_with() gives a tagger at a time; a longer text stands alone.
CHARACTERS = 1 << 19

#: A stand-in for a tagger, for any language: (suffix pattern, tag); the first that matches holds.
SUFFIX_TAGS = ((r"^.{1,2}$", "S"), (r"(?:ing|ed|er|en|ar|ать|ить)$", "V"), (r"(?:ly|ment|mente|lich)$", "R"), (r"(?:ous|able|ible|al|ый|ий)$", "A"))


def words(text: Column) -> Column:
    """The letter runs of a text in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, pos, word: a row a word, positions from 0."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(words(F.col(text_col))).alias("pos", "word"))


def suffix_tag(word: Column) -> Column:
    """The tag of SUFFIX_TAGS, N if no pattern matches."""
    out = None
    for pattern, tag in SUFFIX_TAGS:
        out = F.when(_matches(word, pattern), tag) if out is None else out.when(_matches(word, pattern), tag)
    return out.otherwise("N")


def _matches(word: Column, pattern: str) -> Column:
    """Whether a word (without line breaks) matches a pattern of SUFFIX_TAGS; endings and lengths are compared without a regular expression,
    which would try each of the word's letters."""
    if found := re.fullmatch(r"\(\?:([\w|]+)\)\$", pattern):
        return reduce(lambda a, b: a | b, (word.endswith(x) for x in found[1].split("|")))
    if found := re.fullmatch(r"\^\.\{(\d+),(\d+)\}\$", pattern):
        return F.length(word).between(int(found[1]), int(found[2]))
    return word.rlike(pattern)


def tag(rows: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """Tokens (any columns and word) with lemma and tag: from a lexicon (wordform, lemma, pos) where it has the word,
    else the word itself and suffix_tag(). Of a wordform's entries the smallest holds. Which side of the join is sent
    round is left to its size."""
    if lexicon is None:
        return rows.withColumn("lemma", F.col("word")).withColumn("tag", suffix_tag(F.col("word")))
    one = lexicon.groupBy(F.col("wordform").alias("word")).agg(F.min(F.struct("lemma", "pos")).alias("_e"))
    joined = rows.join(one, "word", "left")
    return joined.withColumn("lemma", F.coalesce("_e.lemma", "word")).withColumn("tag", F.coalesce("_e.pos", suffix_tag(F.col("word")))).drop("_e")


def keep_tags(rows: DataFrame, tags: tuple[str, ...] = KEPT_TAGS) -> DataFrame:
    """Tokens with a kept tag; number masks count as numerals."""
    numeral = F.col("word").isin("numarab", "numlat")
    return rows.withColumn("tag", F.when(numeral, "M").otherwise(F.col("tag"))).where(F.substring("tag", 1, 1).isin(*tags))


def lemma_text(rows: DataFrame, with_tags: bool = True, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Keys and the space-joined lemmas (lemma_T with tags) in order of pos."""
    item = F.concat_ws("_", "lemma", "tag") if with_tags else F.col("lemma")
    grouped = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("pos"), item.alias("x")))).alias("_t"))
    return grouped.select(*keys, F.array_join(F.transform("_t", lambda t: t["x"]), " ").alias("text"))


def tokenize_with(rows: DataFrame, make: Callable[[], Callable[[list[str]], list[list[tuple[str, str]]]]], key: str = "doc_id") -> DataFrame:
    """Key, pos, lemma, tag by a tagger of one's own. make() loads it once a Python worker; it takes sentences, about CHARACTERS
    at a time, and gives (lemma, tag) pairs for each. rows: key, text."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = make()
        for batch in batches:
            # The words of a whole batch of long texts, as Python's objects, would be many times its size.
            run = (batch["text"].str.len().fillna(0).cumsum() // CHARACTERS).astype("int64")
            for _, part in batch.groupby(run, sort=False):
                out = [(k, n, *pair) for k, sent in zip(part["k"], tagger(part["text"].tolist()), strict=True) for n, pair in enumerate(sent)]
                yield pd.DataFrame(out, columns=["k", "pos", "lemma", "tag"])

    return rows.select(F.col(key).alias("k"), "text").mapInPandas(run, f"k {kind}, pos int, lemma string, tag string").withColumnRenamed("k", key)


def numerals(text: Column) -> Column:
    """Number masks that the tagger took for proper nouns are numerals."""
    return F.regexp_replace(text, "(numarab|numlat)_PROPN", "$1_NUM")


def word_pairs(conllu_docs: DataFrame) -> DataFrame:
    """T5: doc_id, words: the lower-case lemma_POS tokens of each text of CoNLL-U (as conllu() has them), in order."""
    rows = conllu(conllu_docs).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("_t"))
    return rows.select("doc_id", F.transform("_t", lambda t: F.lower(t["token"])).alias("words"))


def batches(lines: DataFrame, batch: int = 10_000, number: str = "line") -> DataFrame:
    """T4: lines with the batch (from 0) that each is written with; lines are numbered from 1."""
    return lines.withColumn("batch", F.floor((F.col(number) - 1) / batch).cast("long"))


def line_range(lines: DataFrame, start: int = 0, end: int = -1, number: str = "line") -> DataFrame:
    """T4: lines whose number is start to end, both included; end -1: to the last."""
    kept = lines.where(F.col(number) >= start)
    return kept if end == -1 else kept.where(F.col(number) <= end)


def connectors(tagged: DataFrame, text_col: str = "text") -> DataFrame:
    """The distinct lemma_T tokens with a connector's tag."""
    return tagged.select(F.explode(F.split(text_col, " ")).alias("word")).where(F.substring("word", -2, 2).isin(*CONNECTOR_TAGS)).distinct()


def training_words(text: Column, least: int = 2, most: int = 15) -> Column:
    """Lower-case letter runs of least to most characters."""
    return F.filter(words(text), lambda w: (F.length(w) >= least) & (F.length(w) <= most))


def usable_tokens(text: Column) -> Column:
    """lemma_POS tokens that are no punctuation and have none in the lemma."""
    mark = r"[!\"#$%&'()*+,\-./:;<=>?@\[\\\]^`{|}~]"
    return F.filter(F.split(text, " "), lambda t: ~t.contains("PUNCT") & ~F.regexp_extract(t, "^[^_]*", 0).rlike(mark) & (t != ""))


def conllu(docs: DataFrame, keep_pos: bool = True, keep_punct: bool = False, id_col: str = "doc_id", text_col: str = "conllu") -> DataFrame:
    """CoNLL-U text to lemma_POS tokens: doc_id, pos, token.

    Rows of ten fields count. A token with UNK or NUM is [UNK]_UNK or [NUM]_NUM; digits of numerals are masked; a run of
    proper nouns that agree in case and number is one token, joined by ::, which ends at a line's end, before another
    word, and at the end of the text. A proper noun that does not agree ends the run and stands alone."""
    # What is exploded is made once; as plain columns a line would be split, and its lemma cleaned, for each use of a field.
    once = lambda **made: F.explode(F.array(F.struct(*(x.alias(k) for k, x in made.items())))).alias("x")
    f = F.col("f")
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.transform(F.split(text_col, "\n"), lambda x: F.split(x, "\t"))).alias("n", "f")).where((F.size("f") == 10) & ~F.get("f", F.lit(0)).startswith("#"))
    special = F.when(f[1].contains("UNK"), "[UNK]_UNK").when(f[1].contains("NUM"), "[NUM]_NUM")
    named = (f[3] == "PROPN") & special.isNull() & f[5].contains("|")
    feature = lambda name: F.when(named, F.regexp_extract(f[5], rf"(?:^|\|){name}=([^|]*)", 1))
    # A line ends in a line break, or in white space and one, as the tagger spells them.
    ends = f[9].contains(r"SpacesAfter=\n") | f[9].contains(r"SpacesAfter=\s\n")
    rows = lines.select("doc_id", "n", once(special=special, lemma=T.clean_lemma(f[2], f[3]), bare=T.clean_token(f[1], f[9]), upos=f[3], case=feature("Case"), number=feature("Number"), ends=ends)).select("doc_id", "n", "x.*")
    rows = rows.where(F.col("special").isNotNull() | ((F.length("lemma") > 0) & (F.length("bare") > 0)))
    name = F.coalesce((F.length("case") > 0) & (F.length("number") > 0), F.lit(False))
    plain = F.when((F.col("upos") == "NUM") & F.col("bare").rlike(r"^\d+$"), T.mask_digits(F.col("bare"))).otherwise(F.col("lemma"))
    rows = rows.select("doc_id", "n", "special", "upos", "case", "number", "ends", name.alias("name"), F.when(name, F.col("lemma")).otherwise(plain).alias("item"))
    w = Window.partitionBy("doc_id").orderBy("n")
    prev = lambda c: F.lag(c).over(w)
    agree = F.col("name") & prev("name") & (F.col("case") == prev("case")) & (F.col("number") == prev("number")) & ~prev("ends")
    rows = rows.withColumn("start", F.when(F.coalesce(agree, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("start").over(w))
    out = rows.groupBy("doc_id", "run").agg(
        F.min("n").alias("pos"), F.first("special", True).alias("special"), F.first("upos").alias("upos"), F.array_sort(F.collect_list(F.struct("n", "item"))).alias("items")
    )
    lemma = F.array_join(F.transform("items", lambda x: x["item"]), "::")
    if not keep_punct:
        out = out.where(F.col("special").isNotNull() | (F.col("upos") != "PUNCT"))
    whole = F.coalesce("special", F.concat_ws("_", lemma, F.col("upos")))
    return out.select("doc_id", "pos", (whole if keep_pos else F.coalesce(F.split("special", "_")[0], lemma)).alias("token"))
