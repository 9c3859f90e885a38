"""The registered queries and their SQL: each query is an operator on a whole table.

The tables have Latin letters only, and few of the marks that some steps look for; such a step gets another mark (a
parameter), or a text that is made to have it, alike in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions import patterns as P
from lexweave.functions import text as T
from lexweave.operators import audit, counting, evalset, html, ngrams, plain, suggest, tokens, vectors
from lexweave.sources.files import read_wide
from lexweave.sources.scratch import keep, settle

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    return read_wide(spark, path) if name in ("documents", "pages") else spark.read.parquet(path)


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def grams(spark: SparkSession, sf_dir: str, n: int, source: str = "documents", key: str = "doc_id") -> DataFrame:
    return ngrams.array_occurrences(table(spark, sf_dir, source), tokens.words(F.col("text")), n, key)


def frequencies(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    return ngrams.frequencies(grams(spark, sf_dir, n), n) if n == 1 else counting.ngram_counts(docs(spark, sf_dir), tokens.words(F.col("text")), n)


def gram_sql(n: int, source: str = "documents", key: str = "doc_id", words: str = r"regexp_extract_all(lower(text), '\p{L}+')", name: str = "") -> str:
    """A common table expression, g{n} or the name: the n-gram at every position that has one."""
    one = f"select {key} as doc_id, unnest({words}) as w1, generate_subscripts({words}, 1) as i from {source}"
    if n == 1:
        return f"{name or 'g1'} as ({one})"
    more = ", ".join(f"lead(w1, {k}) over (partition by doc_id order by i) as w{k + 1}" for k in range(1, n))
    return f"{name or f'g{n}'} as (select doc_id, i, w1, {more} from ({one}) qualify lead(w1, {n - 1}) over (partition by doc_id order by i) is not null)"


G1, G2, G3 = gram_sql(1), gram_sql(2), gram_sql(3)
F1 = f"{G1}, f1 as (select w1, count(*) as freq from g1 group by all)"
F2 = f"{G2}, f2 as (select w1, w2, count(*) as freq from g2 group by all)"
F3 = f"{G3}, f3 as (select w1, w2, w3, count(*) as freq from g3 group by all)"


# ---- n-gram tables

@query("domain_size", f"with {G1} select count(distinct w1) as domain_size from g1")
def domain_size(spark, sf_dir):
    return ngrams.domain_size(grams(spark, sf_dir, 1), "w1")


@query("unigram_freq", f"with {F1} select w1, freq from f1")
def unigram_freq(spark, sf_dir):
    return frequencies(spark, sf_dir, 1)


@query("bigram_freq", f"with {F2} select w1, w2, freq from f2")
def bigram_freq(spark, sf_dir):
    return frequencies(spark, sf_dir, 2)


@query("trigram_freq", f"with {F3} select w1, w2, w3, freq from f3")
def trigram_freq(spark, sf_dir):
    return frequencies(spark, sf_dir, 3)


@query("ngram_doc_freq", f"with {G2} select w1, w2, count(*) as ngram_freq, count(distinct doc_id) as doc_freq from g2 group by all")
def ngram_doc_freq(spark, sf_dir):
    return ngrams.document_frequencies(grams(spark, sf_dir, 2), 2)


@query("ngram_lookup", f"with {F2}, {gram_sql(2, 'benchmark', 'item_id', name='c')} select c.w1, c.w2, coalesce(freq, 0) as freq from c left join f2 using (w1, w2)")
def ngram_lookup(spark, sf_dir):
    wanted = grams(spark, sf_dir, 2, "benchmark", "item_id").select("w1", "w2")
    return ngrams.lookup(wanted, frequencies(spark, sf_dir, 2), 2)


def _components(spark, sf_dir):
    """Two component sets: the words of the benchmark, and those of the conversations."""
    return [table(spark, sf_dir, t).select(F.explode(tokens.words(F.col("text"))).alias("word")).distinct() for t in ("benchmark", "conversations")]


_C = "c{0} as (select distinct unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) as word from {1})"


@query("attest_bigrams", f"with {G2}, {_C.format(0, 'benchmark')}, {_C.format(1, 'conversations')} select distinct w1, w2 from g2 where w1 in (select word from c0) and w2 in (select word from c1)")
def attest_bigrams(spark, sf_dir):
    return ngrams.attested(grams(spark, sf_dir, 2), *_components(spark, sf_dir))


@query("attest_trigrams", f"with {G3}, {_C.format(0, 'benchmark')}, {_C.format(1, 'conversations')} select distinct w1, w2, w3 from g3 where w1 in (select word from c0) and w2 in (select word from c1) and w3 in (select word from c0)")
def attest_trigrams(spark, sf_dir):
    one, two = _components(spark, sf_dir)
    return ngrams.attested(grams(spark, sf_dir, 3), one, two, one)


@query("unattested_bigrams", f"with {F2}, {gram_sql(2, 'benchmark', 'item_id', name='c')} select distinct w1, w2 from c anti join f2 using (w1, w2)")
def unattested_bigrams(spark, sf_dir):
    wanted = grams(spark, sf_dir, 2, "benchmark", "item_id").select("w1", "w2").distinct()
    return ngrams.unattested(wanted, frequencies(spark, sf_dir, 2), 2)


def _pairs(spark, sf_dir, least: int = 5) -> DataFrame:
    """Bigrams of at least so many occurrences with their measures from the counts of their words and the number of
    distinct words."""
    one = frequencies(spark, sf_dir, 1)
    return ngrams.statistics(frequencies(spark, sf_dir, 2).where(F.col("freq") >= least), one, one, 2, one.agg(F.count("*").alias("n")))


_ALL_PAIRS = f"""with {F1}, {F2}, p as (select f2.w1, f2.w2, f2.freq, cast(a.freq as double) as a, cast(b.freq as double) as b, cast((select count(*) from f1) as double) as n
  from f2 join f1 a on a.w1 = f2.w1 join f1 b on b.w1 = f2.w2)"""
_PAIRS = f"{_ALL_PAIRS[:-1]} where f2.freq >= 5)"


@query("bigram_pmi", f"{_PAIRS} select w1, w2, freq, round(log10(n * freq / (a * b)), 6) as pmi from p")
def bigram_pmi(spark, sf_dir):
    return _pairs(spark, sf_dir).select("w1", "w2", "freq", F.round("pmi", 6).alias("pmi"))


@query("bigram_tscore", f"{_PAIRS} select w1, w2, freq, round((freq - a * b / n) / sqrt(freq), 6) as t_score from p")
def bigram_tscore(spark, sf_dir):
    return _pairs(spark, sf_dir).select("w1", "w2", "freq", F.round("t_score", 6).alias("t_score"))


@query("bigram_logdice", f"{_PAIRS} select w1, w2, freq, round(14 + log2(2.0 * freq / (a + b)), 6) as log_dice from p")
def bigram_logdice(spark, sf_dir):
    return _pairs(spark, sf_dir).select("w1", "w2", "freq", F.round("log_dice", 6).alias("log_dice"))


@query("bigram_pmi_all", f"{_ALL_PAIRS} select w1, w2, freq, round(log10(n * freq / (a * b)), 6) as pmi from p")
def bigram_pmi_all(spark, sf_dir):
    return _pairs(spark, sf_dir, 1).select("w1", "w2", "freq", F.round("pmi", 6).alias("pmi"))


@query("bigram_tscore_all", f"{_ALL_PAIRS} select w1, w2, freq, round((freq - a * b / n) / sqrt(freq), 6) as t_score from p")
def bigram_tscore_all(spark, sf_dir):
    return _pairs(spark, sf_dir, 1).select("w1", "w2", "freq", F.round("t_score", 6).alias("t_score"))


@query("bigram_logdice_all", f"{_ALL_PAIRS} select w1, w2, freq, round(14 + log2(2.0 * freq / (a + b)), 6) as log_dice from p")
def bigram_logdice_all(spark, sf_dir):
    return _pairs(spark, sf_dir, 1).select("w1", "w2", "freq", F.round("log_dice", 6).alias("log_dice"))


@query("top_collocations", f"{_PAIRS} select w1, w2, freq, round(log10(n * freq / (a * b)), 6) as pmi, round((freq - a * b / n) / sqrt(freq), 6) as t_score, round(14 + log2(2.0 * freq / (a + b)), 6) as log_dice from p order by round(14 + log2(2.0 * freq / (a + b)), 6) desc, w1, w2 limit 50")
def top_collocations(spark, sf_dir):
    rounded = _pairs(spark, sf_dir).select("w1", "w2", "freq", *(F.round(c, 6).alias(c) for c in ("pmi", "t_score", "log_dice")))
    return rounded.orderBy(F.desc("log_dice"), "w1", "w2").limit(50)


_TRIPLES = f"""with {F1}, {F2}, {F3}, p as (select f3.w1, f3.w2, f3.w3, f3.freq, cast(f2.freq as double) as a, cast(f1.freq as double) as b, cast((select count(*) from f1) as double) as n
  from f3 join f2 on f2.w1 = f3.w1 and f2.w2 = f3.w2 join f1 on f1.w1 = f3.w3{{}})
  select w1, w2, w3, freq, round(log10(n * freq / (a * b)), 6) as pmi, round((freq - a * b / n) / sqrt(freq), 6) as t_score from p"""


@query("trigram_stats", _TRIPLES.replace("{}", " where f3.freq >= 3"))
def trigram_stats(spark, sf_dir, least: int = 3):
    found = ngrams.text_statistics(docs(spark, sf_dir), tokens.words(F.col("text")), 3, least)
    return found.select("w1", "w2", "w3", "freq", F.round("pmi", 6).alias("pmi"), F.round("t_score", 6).alias("t_score"))


@query("trigram_stats_all", _TRIPLES.replace("{}", ""))
def trigram_stats_all(spark, sf_dir):
    return trigram_stats(spark, sf_dir, 1)


_C_VALUES = f"""with {F2}, {F3}, i as (select w1, w2, freq from f3 union all select w2, w3, freq from f3 where not (w1 = w2 and w2 = w3)),
  h as (select w1, w2, count(*) as longer, sum(freq) as longer_freq from i group by all)
  select w1, w2, freq, round(cast(freq as double) - coalesce(longer_freq / cast(longer as double), 0.0), 6) as c_value from f2 left join h using (w1, w2)"""


@query("c_value", f"{_C_VALUES} where freq >= 3")
def c_value(spark, sf_dir, least: int = 3):
    of = ngrams.frequencies_to(docs(spark, sf_dir), tokens.words(F.col("text")), 3)
    return ngrams.c_values(of[2].where(F.col("freq") >= least), of[3], 2).withColumn("c_value", F.round(F.col("c_value").cast("double"), 6))


@query("c_value_all", _C_VALUES)
def c_value_all(spark, sf_dir):
    return c_value(spark, sf_dir, 1)


# ---- the wordform star: a lemma is the lower-case word, the tag comes from its ending

_TAG = """case when regexp_matches({0}, '^.{{1,2}}$') then 'S' when regexp_matches({0}, '(ing|ed|er|en|ar|ать|ить)$') then 'V' when regexp_matches({0}, '(ly|ment|mente|lich)$') then 'R'
  when regexp_matches({0}, '(ous|able|ible|al|ый|ий)$') then 'A' else 'N' end"""
_FORMS = r"regexp_extract_all(text, '\p{L}+')"


def _tagged(spark, sf_dir) -> DataFrame:
    d = docs(spark, sf_dir)
    forms = d.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("pos", "word"))
    return forms.withColumn("lemma", F.lower("word")).withColumn("tag", tokens.suffix_tag(F.lower("word")))


@query("star_bigram_freq", f"with {gram_sql(2, words=_FORMS)}, x as (select lower(w1) as w1, lower(w2) as w2 from g2) select *, count(*) as freq from x group by all")
def star_bigram_freq(spark, sf_dir):
    return ngrams.lemma_bigrams(ngrams.star(_tagged(spark, sf_dir)))


@query("star_trigram_freq", f"with {gram_sql(3, words=_FORMS)}, x as (select lower(w1) as w1, lower(w2) as w2, lower(w3) as w3 from g3) select *, count(*) as freq from x group by all")
def star_trigram_freq(spark, sf_dir):
    tables = ngrams.star(_tagged(spark, sf_dir))
    # Counted and written before any is joined, so what counts them and what joins them is not on disk together.
    return ngrams.lemma_trigrams(tables | {"ngram3_tokens": settle(tables["ngram3_tokens"].drop("id_trigram"), "ngram3")})


@query("star_unigram_freq", f"select lower(w) as lemma, count(*) as freq from (select unnest({_FORMS}) as w from documents) group by all")
def star_unigram_freq(spark, sf_dir):
    return ngrams.lemma_unigrams(ngrams.star(_tagged(spark, sf_dir)))


def _top_sql(n: int, wanted: str, least: int) -> str:
    words = ", ".join(f"w{k}" for k in range(1, n + 1))
    cols = ", ".join(f"w{k} as n{k}, lower(w{k}) as l{k}, {_TAG.format(f'lower(w{k})')} as pos{k}" for k in range(1, n + 1))
    return f"""with {gram_sql(n, words=_FORMS)}, f as (select {words}, count(*) as raw_frequency from g{n} group by all), t as (select raw_frequency, {cols} from f where raw_frequency >= {least})
  select * from t where {wanted}"""


_POS2, _POS3 = "(pos1 = 'V' and pos2 in ('V', 'N')) or (pos1 in ('N', 'A') and pos2 = 'N')", "pos1 in ('N', 'V') and pos2 = 'S' and pos3 = 'N'"


@query("top_bigrams_by_pos", _top_sql(2, _POS2, 4))
def top_bigrams_by_pos(spark, sf_dir):
    """The scan is cut at a frequency, not a number of rows, so that ties decide nothing in either engine."""
    return _by_pos(spark, sf_dir, 2, 4)


def _by_pos(spark, sf_dir, n, least):
    tables = ngrams.star(_tagged(spark, sf_dir))
    name = f"ngram{n}"
    tables[name] = tables[name].where(F.col("raw_frequency") >= least)
    top = ngrams.top_bigrams if n == 2 else ngrams.top_trigrams
    found = top(tables, ngrams.by_pos(n, "V", "N", "A", "S"), scanned=None, kept=None, member=lambda k: F.col(f"pos{k}").isin("V", "N", "A", "S"))
    return found.select("raw_frequency", *(f"{c}{k}" for k in range(1, n + 1) for c in ("n", "l", "pos")))


@query("top_trigrams_by_pos", _top_sql(3, _POS3, 3))
def top_trigrams_by_pos(spark, sf_dir):
    return _by_pos(spark, sf_dir, 3, 3)


@query("bigrams_by_pos_all", _top_sql(2, _POS2, 1))
def bigrams_by_pos_all(spark, sf_dir):
    return _by_pos(spark, sf_dir, 2, 1)


@query("trigrams_by_pos_all", _top_sql(3, _POS3, 1))
def trigrams_by_pos_all(spark, sf_dir):
    return _by_pos(spark, sf_dir, 3, 1)


@query("top_bigrams_limited")
def top_bigrams_limited(spark, sf_dir):
    """R13 with its own limits, in a total order."""
    found = ngrams.top_bigrams(ngrams.star(_tagged(spark, sf_dir)), ngrams.by_pos(2, "V", "N", "A", "S"))
    return found.select("raw_frequency", *(f"{c}{k}" for c in ("n", "l", "pos") for k in (1, 2)))


# ---- one text at a time

def _changed(spark, sf_dir, step, source: str = "documents", key: str = "doc_id", text: str = "text") -> DataFrame:
    return table(spark, sf_dir, source).select(key, step(F.col(text)).alias("text"))


@query("symbol_unify", "select doc_id, translate(replace(text, '…', '...'), 'ÄäËëÏïÖöÜüŸÿß', 'AaEeIiOoUuYys') as text from documents")
def symbol_unify(spark, sf_dir):
    return _changed(spark, sf_dir, T.unify_symbols)


@query("quote_mask", "select doc_id, regexp_replace(text, '[«“„''\"].*?[»”''\"“]', 'QUOTE', 'gs') as text from documents")
def quote_mask(spark, sf_dir):
    return _changed(spark, sf_dir, T.mask_quotes)


@query("terminal_punct", "select doc_id, regexp_replace(text, '[!?]|:\\s*$', '.', 'g') as text from documents")
def terminal_punct(spark, sf_dir):
    return _changed(spark, sf_dir, T.terminal_periods)


@query("url_mask", "select page_id, regexp_replace(regexp_replace(regexp_replace(html, '[^ ]+@[^ ]+', '', 'gs'), 'https:[^ ]+', 'URL', 'gs'), '[^ ]+?/[^ ]+?/[^ ]+?', 'URL', 'gs') as text from pages")
def url_mask(spark, sf_dir):
    return _changed(spark, sf_dir, T.mask_urls, "pages", "page_id", "html")


@query("tag_mask", "select page_id, regexp_replace(html, '<p>.*?</p>', 'STYLE', 'gs') as text from pages")
def tag_mask(spark, sf_dir):
    return _changed(spark, sf_dir, lambda t: T.mask_styles(t, "p"), "pages", "page_id", "html")


@query("footnote_refs", "select doc_id, regexp_replace(text, '\\d+[.,]|[^\\s\\d]+?\\d+\\s', '', 'g') as text from documents")
def footnote_refs(spark, sf_dir):
    return _changed(spark, sf_dir, T.strip_footnote_references)


@query("hanging_brackets", "select page_id, regexp_replace(regexp_replace(html, '\\([^)]*?\\(', '', 'g'), '\\[[^\\]]*?\\[', '', 'g') as text from pages")
def hanging_brackets(spark, sf_dir):
    return _changed(spark, sf_dir, T.close_hanging, "pages", "page_id", "html")


@query("square_brackets", "with n as (select page_id, html, regexp_replace(html, '\\[(.*?)\\]', '', 'g') as x from pages) select page_id, case when length(x) > 0.7 * length(html) then x else html end as text from n")
def square_brackets(spark, sf_dir):
    return _changed(spark, sf_dir, T.strip_square, "pages", "page_id", "html")


@query("ending_cut", "with n as (select doc_id, text, regexp_replace(text, '(?:token|Licensed)\\.?.*', '', 's') as x from documents) select doc_id, case when length(x) > 0.7 * length(text) then x else text end as text from n")
def ending_cut(spark, sf_dir):
    return _changed(spark, sf_dir, lambda t: T.strip_ending(t, "token|Licensed"))


@query("slugs", "select doc_id, regexp_replace(substr(trim(regexp_replace(regexp_replace(trim(lower(text)), '[^\\p{L}\\p{N}_\\s-]', '', 'g'), '[-\\s]+', '-', 'g'), '-_'), 1, 200), '', '') as slug from documents")
def slugs(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.slug(F.col("text")).alias("slug"))


_FOLD = """list_reduce(list_transform(string_split(text, ''), lambda c: {'s': 0, 'r': 0, 'o': c}), lambda a, x:
  case when x.o = '[' then {'s': a.s + 1, 'r': a.r, 'o': a.o} when x.o = '(' then {'s': a.s, 'r': a.r + 1, 'o': a.o}
    when x.o = ']' and a.s > 0 then {'s': a.s - 1, 'r': a.r, 'o': a.o} when x.o = ')' and a.r > 0 then {'s': a.s, 'r': a.r - 1, 'o': a.o}
    when a.s = 0 and a.r = 0 then {'s': 0, 'r': 0, 'o': a.o || x.o} else a end, {'s': 0, 'r': 0, 'o': ''}).o"""


@query("nested_brackets", f"select doc_id, case when regexp_matches(text, '[\\[(]') then {_FOLD} else text end as text from documents")
def nested_brackets(spark, sf_dir):
    return _changed(spark, sf_dir, T.strip_brackets)


_BREAK = (P.in_class(P.WHITESPACE) + P.in_class(P.PUNCTUATION)).replace("'", "''")
_KNOWN = P.ROMAN + P.ARABIC + P.ALPHABETS["latin"]


@query("oov_mask", f"select doc_id, regexp_replace(text, '[{_KNOWN}]*[^{_BREAK}{_KNOWN}][^{_BREAK}]*', 'UNK', 'g') as text from documents")
def oov_mask(spark, sf_dir):
    return _changed(spark, sf_dir, lambda t: T.mask_unknown(t, "latin"))


@query("number_mask", f"select doc_id, regexp_replace(regexp_replace(text, '[{P.ARABIC}]+($|[{_BREAK}])', 'NUM_arab\\1', 'g'), '[{P.ROMAN}]+($|[{_BREAK}])', 'NUM_lat\\1', 'g') as text from documents")
def number_mask(spark, sf_dir):
    return _changed(spark, sf_dir, T.mask_numbers)


_SENTENCES = """s as (select doc_id, x, generate_subscripts(x, 1) as i, unnest(x) as text from (select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?][)"»”]?)\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '') as x from documents))"""


@query("sentence_split", f"with {_SENTENCES} select doc_id, cast(i - 1 as int) as sent, text from s")
def sentence_split(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sent", "text"))


@query("sentence_quality", f"""with {_SENTENCES}, w as (select doc_id, i, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '' and x <> 'NUM_arab') as w from s)
  select doc_id, cast(i - 1 as int) as sent, text from w where len(w) >= 5 and list_sum(list_transform(w, lambda x: length(x))) > 5.0 * len(w) and regexp_matches(text, '^[A-ZÀ-ÖØ-ÞN]') and text like '%.' and not contains(text, '//')""")
def sentence_quality(spark, sf_dir):
    return sentence_split(spark, sf_dir).where(T.well_formed(F.col("text"), "latin"))


@query("clean_articles")
def clean_articles(spark, sf_dir):
    return plain.clean_articles(docs(spark, sf_dir), "latin")


@query("clean_extracted")
def clean_extracted(spark, sf_dir):
    return plain.clean_extracted(docs(spark, sf_dir).withColumn("text", F.replace(F.replace("text", F.lit("\n"), F.lit("\n\n")), F.lit(". "), F.lit(".\n"))), "latin")


_LINES = "l as (select doc_id, cast(generate_subscripts(string_split(text, chr(10)), 1) - 1 as int) as para, unnest(string_split(text, chr(10))) as text from documents)"


def _lines(spark, sf_dir) -> DataFrame:
    return plain.paragraphs(docs(spark, sf_dir), separator="\n")


@query("good_lines", f"with {_LINES}, t as (select doc_id, para, replace(replace(regexp_replace(text, ' +', ' ', 'g'), ' .', '.'), ' ,', ',') as text from l), w as (select *, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '' and x <> 'NUM_arab') as w from t) select doc_id, para, text from w where len(w) >= 5 and list_sum(list_transform(w, lambda x: length(x))) > 5.0 * len(w)")
def good_lines(spark, sf_dir):
    return plain.good_lines(_lines(spark, sf_dir))


@query("repeated_paragraphs", f"with {_LINES}, n as (select *, count(*) over (partition by doc_id, regexp_replace(text, '[0-9]+', 'NUM', 'g')) as n from l) select doc_id, para, text from n where n = 1")
def repeated_paragraphs(spark, sf_dir):
    return plain.drop_repeated(_lines(spark, sf_dir))


@query("alphabet_paragraphs", f"with {_LINES} select doc_id, para, text from l where length(text) > 0 and length(regexp_replace(text, '[^A-Za-zÀ-ÖØ-öø-ɏ]', '', 'g')) / length(text) > 0.2")
def alphabet_paragraphs(spark, sf_dir):
    return plain.keep_alphabet(_lines(spark, sf_dir), "latin")


@query("trailing_cut", f"with {_LINES}, n as (select *, row_number() over (partition by doc_id order by para desc) as n from l) select doc_id, para, text from n where n > 2")
def trailing_cut(spark, sf_dir):
    return plain.drop_trailing(_lines(spark, sf_dir))


@query("leading_cut", f"with {_LINES}, n as (select *, row_number() over (partition by doc_id order by para) - 1 as n, count(*) over (partition by doc_id) as o, len(regexp_extract_all(text, '[a-zA-Z]+')) as w from l), h as (select *, max(case when n < least(15, o // 4) and w > 35 then n end) over (partition by doc_id) as h from n) select doc_id, para, text from h where case when h > 2 then n > h else n >= 5 end")
def leading_cut(spark, sf_dir):
    return plain.drop_leading(_lines(spark, sf_dir))


@query("restored_paragraphs", f"with {_LINES}, k as (select * from l where text <> ''), s as (select *, row_number() over (partition by doc_id order by para) = 1 or not regexp_matches(text, '^[а-яёa-z]') as s from k), g as (select *, sum(s::int) over (partition by doc_id order by para) as g, coalesce(not lead(s) over (partition by doc_id order by para), false) as j from s) select doc_id, min(para) as para, string_agg(case when j and text like '%-' then left(text, -1) when j then text || ' ' else text end, '' order by para) as text from g group by doc_id, g")
def restored_paragraphs(spark, sf_dir):
    return plain.restore_paragraphs(_lines(spark, sf_dir))


# ---- paragraphs of documents: a line is a paragraph, and ten of them a page

_PAGES = "l as (select doc_id, cast((i - 1) // 10 as int) as page, cast((i - 1) % 10 as int) as para, t as text from (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as i, unnest(string_split(text, chr(10))) as t from documents))"


def _pages(spark, sf_dir) -> DataFrame:
    rows = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "text"))
    return rows.select("doc_id", F.floor(F.col("k") / 10).cast("int").alias("page"), (F.col("k") % 10).alias("para"), "text")


@query("references_cut", f"with {_PAGES}, c as (select *, min(case when contains(text, 'token') then page * 10 + para end) over (partition by doc_id) as c from l) select doc_id, page, para, text from c where c is null or page * 10 + para < c")
def references_cut(spark, sf_dir):
    return html.cut_from(_pages(spark, sf_dir), "token")


@query("keywords_cut", f"with {_PAGES}, c as (select *, max(case when page = 0 and contains(text, 'token') then para end) over (partition by doc_id) as a, max(case when page = 1 and contains(text, 'token') then para end) over (partition by doc_id) as b from l) select doc_id, page, para, text from c where case when a is not null then page > 0 or para > a when b is not null then page > 1 or (page = 1 and para > b) else true end")
def keywords_cut(spark, sf_dir):
    return html.cut_through_keywords(_pages(spark, sf_dir), "token")


@query("headers_drop", f"with {_PAGES}, b as (select doc_id, page, para, case when para % 3 = 2 or (doc_id % 3 = 0 and para = 0) then text || chr(10) || 'x' else text end as text from l), n as (select *, not contains(text, chr(10)) as s, row_number() over w as n, first_value(not contains(text, chr(10))) over w as f from b window w as (partition by doc_id, page order by para)) select doc_id, page, para, text from n where not ((n = 1 and s) or (n = 2 and s and f))")
def headers_drop(spark, sf_dir):
    broken = _pages(spark, sf_dir).withColumn("text", F.when((F.col("para") % 3 == 2) | (F.col("doc_id") % 3 == 0) & (F.col("para") == 0), F.concat("text", F.lit("\nx"))).otherwise(F.col("text")))
    return html.drop_headers(broken)


@query("footnote_cut", f"with {_PAGES}, b as (select doc_id, page, para, case when (doc_id + page + para) % 7 = 0 then '7 ' || text else text end as text from l), c as (select *, min(case when regexp_matches(text, '^[1-9]?[0-9] .+') then para end) over (partition by doc_id, page) as c from b) select doc_id, page, para, text from c where c is null or para < c")
def footnote_cut(spark, sf_dir):
    numbered = F.when((F.col("doc_id") + F.col("page") + F.col("para")) % 7 == 0, F.concat(F.lit("7 "), "text")).otherwise(F.col("text"))
    return html.cut_footnotes(_pages(spark, sf_dir).withColumn("text", numbered))


_RENUMBER = "select doc_id, cast(dense_rank() over (partition by doc_id order by page) - 1 as int) as page, cast(row_number() over (partition by doc_id, page order by para) - 1 as int) as para, text from"


@query("blank_drop", f"with {_PAGES} {_RENUMBER} l where not regexp_matches(text, '^\\s*$')")
def blank_drop(spark, sf_dir):
    return html.drop_blank(_pages(spark, sf_dir))


@query("dehyphenate", f"""with {_PAGES}, b as (select doc_id, page, para, case when (doc_id + para) % 5 = 0 then text || '-' else text end as text from l), h as (select *, text like '%-' and lead(para) over w is not null as h from b window w as (partition by doc_id order by page, para)),
  s as (select *, not coalesce(lag(h) over (partition by doc_id order by page, para), false) as s from h), g as (select *, sum(s::int) over (partition by doc_id order by page, para) as g from s),
  j as (select doc_id, arg_min(page, page * 10 + para) as page, arg_min(para, page * 10 + para) as para, string_agg(case when h then left(text, -1) else text end, '' order by page, para) as text from g group by doc_id, g) {_RENUMBER} j""")
def dehyphenate(spark, sf_dir):
    ended = F.when((F.col("doc_id") + F.col("para")) % 5 == 0, F.concat("text", F.lit("-"))).otherwise(F.col("text"))
    return html.dehyphenate(_pages(spark, sf_dir).withColumn("text", ended))


@query("join_broken", f"""with {_PAGES}, b as ({_RENUMBER} l where not regexp_matches(text, '^\\s*$')),
  s as (select *, coalesce(not regexp_matches(lag(text) over (partition by doc_id, page order by para), '[a-zà-öø-ÿ].*\\.\\s*$'), false) as c from b), g as (select *, sum((not c)::int) over (partition by doc_id, page order by para) as g from s),
  p as (select doc_id, page, min(para) as para, string_agg(text, ' ' order by para) as text from g group by doc_id, page, g), q as ({_RENUMBER} p),
  t as (select *, coalesce(para = 0 and page > 0 and not regexp_matches(lag(text) over (partition by doc_id order by page, para), '\\.\\s*$'), false) as c from q), u as (select *, sum((not c)::int) over (partition by doc_id order by page, para) as g from t),
  j as (select doc_id, arg_min(page, page * 100 + para) as page, arg_min(para, page * 100 + para) as para, string_agg(text, ' ' order by page, para) as text from u group by doc_id, g) {_RENUMBER} j""")
def join_broken(spark, sf_dir):
    return html.join_broken(_pages(spark, sf_dir), "latin")


def shape(pages: DataFrame) -> DataFrame:
    """page_id, html in the expected shape: the text of every paragraph in one div of one div, a sentence a line."""
    bare = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>", "")
    text = lambda x: F.regexp_replace(F.translate(F.regexp_replace(x, r"(?s)<[^>]*>", ""), "&<>", "   "), r"\. ", ".\n")
    found = F.transform(F.regexp_extract_all(bare, F.lit("(?s)<p>(.*?)</p>"), F.lit(1)), lambda x: F.concat(F.lit("<p>"), text(x), F.lit("</p>")))
    return pages.select("page_id", F.concat(F.lit("<body><div><div>"), F.array_join(found, ""), F.lit("</div></div></body>")).alias("html"))


def shaped_pages(spark, sf_dir) -> DataFrame:
    return html.extract_paragraphs(shape(table(spark, sf_dir, "pages")), "page_id", "html")


@query("clean_html")
def clean_html(spark, sf_dir):
    """C1 to C20."""
    return html.preprocess(shaped_pages(spark, sf_dir), "latin")


@query("html_paragraphs", """with b as (select page_id, regexp_replace(regexp_replace(html, '<script\\b.*?</script>', '', 'gis'), '<style\\b.*?</style>', '', 'gis') as h from pages), x as (select page_id, regexp_extract_all(h, '<p>(.*?)</p>', 1, 's') as x from b)
  select page_id as doc_id, cast(generate_subscripts(x, 1) - 1 as int) as para, trim(unnest(x)) as text from x""")
def html_paragraphs(spark, sf_dir):
    return html.flat_paragraphs(table(spark, sf_dir, "pages"), "page_id", "html")


# ---- vectors

_U = "u as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings)"


def _vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("word"), F.col("embedding").alias("vec"), "label")


@query("cosine_topk", f"with {_U}, s as (select q.vec_id as query, c.vec_id as word, list_cosine_similarity(q.v, c.v) as score from u q join u c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id), r as (select *, cast(row_number() over (partition by query order by score desc, word) as int) as rank from s) select query, rank, word, round(score, 6) as score from r where rank <= 10")
def cosine_topk(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    found = vectors.nearest_each(v, v.where("word % 50 = 0").select("word"), 10)
    return found.withColumn("score", F.round("score", 6))


@query("cosmul_topk", f"with {_U}, q as (select a.vec_id as query, a.v as a, b.vec_id as own, b.v as b from u a join u b on a.vec_id % 50 = 0 and b.vec_id = a.vec_id + 1), s as (select query, c.vec_id as word, (1 + list_cosine_similarity(a, v)) / 2 * (1 + list_cosine_similarity(b, v)) / 2 as score from q join u c on c.vec_id <> query and c.vec_id <> own), r as (select *, cast(row_number() over (partition by query order by score desc, word) as int) as rank from s) select query, rank, word, round(score, 6) as score from r where rank <= 5")
def cosmul_topk(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    pairs = v.where("word % 50 = 0").select(F.col("word").alias("query"), F.explode(F.array("word", F.col("word") + 1)).alias("word"))
    return vectors.nearest_cosmul(v, pairs, 5).withColumn("score", F.round("score", 6))


@query("labelled_neighbours", f"with {_U}, s as (select q.vec_id as query, q.label as ql, c.vec_id as word, c.label as cl, list_cosine_similarity(q.v, c.v) as score from u q join u c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id), r as (select *, cast(row_number() over (partition by query order by score desc, word) as int) as rank from s) select query, rank, word, round(score, 6) as score from r where rank <= 20 and ql = cl")
def labelled_neighbours(spark, sf_dir):
    """The label stands for a part of speech: neighbours are ranked first, then only those of the query's label stay."""
    v = _vectors(spark, sf_dir)
    found = vectors.nearest_each(v, v.where("word % 50 = 0").select("word"), 20)
    label = lambda c: v.select(F.col("word").alias(c), F.col("label").alias(f"l_{c}"))
    same = found.join(label("query"), "query").join(label("word"), "word").where("l_query = l_word")
    return same.select("query", "rank", "word", F.round("score", 6).alias("score"))


_NEAR = " union all ".join(f"select w1, lead(w1, {k}) over (partition by doc_id order by i) as c, {k} as k from g1" for k in range(1, 6))


@query("cooccurrences", f"with {G1}, p as ({_NEAR}) select least(w1, c) as word, greatest(w1, c) as context, round(sum(cast(1 as double) / k), 6) as weight from p where c is not null group by all")
def cooccurrences(spark, sf_dir):
    return counting.pair_weights(docs(spark, sf_dir), tokens.words(F.col("text"))).withColumn("weight", F.round("weight", 6))


# ---- suggestions and evaluation sets

_PARTS = "c as (select distinct p_name as colloc, string_split(p_name, ' ') as t from part)"


def _collocations(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("colloc")).distinct()


@query("mask_positions", f"with {_PARTS}, m as (select colloc, t, unnest(case when len(t) = 2 then [{{'l': 1, 'm': [0, 1]}}, {{'l': 1, 'm': [1, 0]}}, {{'l': 2, 'm': [0, 0]}}, {{'l': 3, 'm': [0, 0]}}] end) as x from c) select colloc, x.l as level, array_to_string([case when x.m[1] = 0 then '<mask>' else t[1] end, case when x.m[2] = 0 then '<mask>' else t[2] end], ' ') as masked from m")
def mask_positions(spark, sf_dir):
    rows = suggest.with_masks(_collocations(spark, sf_dir))
    return rows.select("colloc", "level", suggest.masked_text(F.col("tokens"), F.col("mask"), tags=False).alias("masked"))


@query("components", f"with {_PARTS} select distinct i as position, t[i] as word from (select t, cast(unnest([1, 2]) as int) as i from c where len(t) = 2)")
def components(spark, sf_dir):
    return suggest.components(_collocations(spark, sf_dir), 2)


@query("synonym_variants", f"with {_PARTS}, w as (select colloc, t[1] as w1, t[2] as w2 from c where len(t) = 2), s as (select distinct a.w1 as word, b.w1 as synonym from w a join w b on a.w2 = b.w2 and a.w1 <> b.w1 and length(a.w1) = length(b.w1)) select w1, w2, was, replaced from (select s.synonym as w1, w.w2, w.w1 as was, 1 as replaced from w join s on s.word = w.w1 union all select w.w1, s.synonym, w.w2, 2 from w join s on s.word = w.w2)")
def synonym_variants(spark, sf_dir):
    """Synonyms here are first words of one length that share a second word."""
    t = F.split("colloc", " ")
    w = _collocations(spark, sf_dir).where(F.size(t) == 2).select(t[0].alias("w1"), t[1].alias("w2"))
    other = w.select(F.col("w1").alias("synonym"), "w2")
    syn = w.join(other, "w2").where((F.col("w1") != F.col("synonym")) & (F.length("w1") == F.length("synonym"))).select(F.col("w1").alias("word"), "synonym").distinct()
    return evalset.synonym_variants(w, syn, 2)


_MATCH = f"""{gram_sql(1)}, tagged as (select doc_id, i, w1, lower({_TAG.format('w1')}) as t1 from g1),
  t as (select doc_id, cast(i - 1 as int) as pos, w1, t1, lead(w1) over w as w2, lead(t1) over w as t2, lead(w1, 2) over w as w3, lead(t1, 2) over w as t3 from tagged window w as (partition by doc_id order by i)),
  m as (select doc_id, pos, t1 || '_' || t2 as template, w1 || ' ' || w2 as ngram from t union all select doc_id, pos, t1 || '_' || t2 || '_' || t3, w1 || ' ' || w2 || ' ' || w3 from t),
  k as (select * from m where template in ('v_n', 'n_n', 'a_n', 'v_v', 'v_s_n', 'n_s_n'))"""


def _templates(spark, sf_dir) -> DataFrame:
    return evalset.template_matches(tokens.tag(tokens.tokens(docs(spark, sf_dir))))


@query("pos_templates", f"with {_MATCH} select * from k")
def pos_templates(spark, sf_dir):
    return _templates(spark, sf_dir)


@query("freq_band", f"with {_MATCH}, n as (select *, count(*) over (partition by template, ngram) as n from k) select doc_id, pos, template, ngram from n where n between 2 and 3")
def freq_band(spark, sf_dir):
    return evalset.frequency_band(_templates(spark, sf_dir))


@query("phrases", f"with {F1}, {F2}, v as (select (select count(*) from f1) + (select count(*) from f2) as v) select f2.w1, f2.w2, f2.freq, round((f2.freq - 5) * v / cast(a.freq as double) / b.freq, 6) as score from f2 join f1 a on a.w1 = f2.w1 join f1 b on b.w1 = f2.w2, v where f2.freq >= 5 and (f2.freq - 5) * v / cast(a.freq as double) / b.freq > 10")
def phrases(spark, sf_dir):
    return evalset.phrase_scores(tokens.tokens(docs(spark, sf_dir))).withColumn("score", F.round("score", 6))


@query("static_suggest", """with v as (select vec_id, 'w' || vec_id || '_l' || label as word, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings),
  c as (select a.word as w1, b.word as w2, a.label as l1, b.label as l2 from v a join v b on b.vec_id = a.vec_id + 1),
  t as (select w1 as word from c union select w2 from c), s as (select q.word as k, x.word, x.label, list_cosine_similarity(q.e, x.e) as score from t join v q using (word) join v x on x.word <> q.word),
  r as (select *, row_number() over (partition by k order by score desc, word) as rank from s), n as (select * from r where rank <= 50)
  select w1 || ' ' || w2 as colloc, 1 as level, n.word || ' ' || w2 as suggested, rank, round(score, 6) as score from c join n on n.k = w1 and n.label = l1
  union all select w1 || ' ' || w2, 1, w1 || ' ' || n.word, rank, round(score, 6) from c join n on n.k = w2 and n.label = l2""")
def static_suggest(spark, sf_dir):
    """Words are vec_id_label, the label standing for the part of speech; a collocation is a vector and the next."""
    v = table(spark, sf_dir, "embeddings").select(F.concat_ws("_", F.concat(F.lit("w"), "vec_id"), F.concat(F.lit("l"), "label")).alias("word"), F.col("embedding").alias("vec"), "vec_id")
    next_ = v.select(F.col("word").alias("w2"), (F.col("vec_id") - 1).alias("vec_id"))
    colloc = v.join(next_, "vec_id").select(F.concat_ws(" ", "word", "w2").alias("colloc"))
    masked = suggest.with_masks(colloc, (1,))
    words = colloc.select(F.explode(F.split("colloc", " ")).alias("word")).distinct()
    near = vectors.nearest_each(v, words, 50).select(F.col("query").alias("key"), "word", "rank", "score")
    found = suggest.propose(masked, near, 50)
    return found.select("colloc", "level", F.array_join("words", " ").alias("suggested"), "rank", F.round("score", 6).alias("score"))


@query("file_diff", "select coalesce(l, r) as key, case when r is null then 'left' else 'right' end as side from (select distinct o_orderkey as l from orders where o_orderstatus = 'F') full outer join (select distinct l_orderkey as r from lineitem where l_returnflag = 'R') on l = r where l is null or r is null")
def file_diff(spark, sf_dir):
    """Finished orders against orders with a returned line."""
    left = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("key"))
    return audit.file_diff(left, table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("key")), "key")
