"""Registered queries on the cleaning steps, each with a text that has the marks it looks for, made alike in both engines."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.functions import patterns as P
from lexweave.functions import text as T
from lexweave.operators import html, plain, tokens
from lexweave.plans.queries import _BREAK, _FOLD, _KNOWN, _LINES, _PAGES, _RENUMBER, _SENTENCES, SQL, _lines, _pages, docs, query, sentence_split, shaped_pages, table

_UNIFY = "translate(replace({0}, '…', '...'), 'ÄäËëÏïÖöÜüŸÿß', 'AaEeIiOoUuYys')"
_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


# ---- HTML

_BLANKS = r"list_transform(string_split(regexp_replace({0}, '\n+\s+', chr(1), 'g'), chr(1)), lambda x: " + _TRIM.format("x") + ")"


@query("page_paragraphs", f"""with e as (select doc_id, {_UNIFY.format("translate(text, '&<>', '   ')")} as text from documents),
  l as (select doc_id, 0 as page, generate_subscripts(string_split(text, chr(10)), 1) as was, unnest(string_split(text, chr(10))) as text from e
    union all select doc_id, 2, 1, substr(text, 1, 40) || chr(10) || ' ' || chr(10) || 'tail...' from e),
  p as (select doc_id, page, was, generate_subscripts({_BLANKS.format('text')}, 1) as part, unnest({_BLANKS.format('text')}) as text from l)
  select doc_id, cast(page as int) as page, cast(row_number() over (partition by doc_id, page order by was, part) - 1 as int) as para, text from p""")
def page_paragraphs(spark, sf_dir):
    """A page of a document's lines, one without a nested div, one with a blank run; text outside is not read."""
    plain_text = F.translate("text", "&<>", "   ")
    lines = F.replace(plain_text, F.lit("\n"), F.lit('</p>\n<p class="x">'))
    unified = T.unify_symbols(plain_text)
    shaped = F.concat(
        F.lit("<html><body><div><div><p>"), lines, F.lit("</p></div><div><p>not read</p></div></div><p>no page</p><div><p>not nested</p></div><div><div><p>"),
        F.substring(unified, 1, 40), F.lit("\n \ntail…</p></div></div></body></html>"),
    )
    return html.extract_paragraphs(docs(spark, sf_dir).select("doc_id", shaped.alias("html")))


@query("blank_runs", f"with l as (select doc_id, replace(replace(text, chr(10), chr(10) || '  '), '. ', '.' || chr(10)) as text from documents), p as (select doc_id, {_BLANKS.format('text')} as x from l) select doc_id, 0 as page, cast(generate_subscripts(x, 1) - 1 as int) as para, unnest(x) as text from p")
def blank_runs(spark, sf_dir):
    """C2 by itself: a paragraph a document, its lines indented, its sentences on lines."""
    made = F.replace(F.replace("text", F.lit("\n"), F.lit("\n  ")), F.lit(". "), F.lit(".\n"))
    return html.split_paragraphs(docs(spark, sf_dir).select("doc_id", F.lit(0).alias("page"), F.lit(0).alias("para"), F.concat(F.lit("<p>"), made, F.lit("</p>")).alias("text")))


_HEADED = "h as (select doc_id, page, para, case when (doc_id + page * 10 + para) % 23 = 7 then '2.1. <b>References</b> ' || left(text, 20) when (doc_id + para) % 31 = 3 then 'xReferences' when (doc_id * 3 + para) % 37 = 5 then ' Bibliography and more' else text end as text from l)"


@query("reference_headings", f"with {_PAGES}, {_HEADED}, c as (select *, min(case when regexp_matches(text, '(?m)^\\s*(<b>)?(\\d+\\.\\d+\\. )?(<b>)?(References|Bibliography)') then page * 10 + para end) over (partition by doc_id) as c from h) select doc_id, page, para, text from c where c is null or page * 10 + para < c")
def reference_headings(spark, sf_dir):
    """C4 with the real pattern: numbered, styled and indented headings."""
    number = F.col("doc_id") + F.col("page") * 10 + F.col("para")
    text = F.when(number % 23 == 7, F.concat(F.lit("2.1. <b>References</b> "), F.expr("left(text, 20)"))).when((F.col("doc_id") + F.col("para")) % 31 == 3, "xReferences")
    text = text.when((F.col("doc_id") * 3 + F.col("para")) % 37 == 5, " Bibliography and more").otherwise(F.col("text"))
    return html.cut_references(_pages(spark, sf_dir).withColumn("text", text))


@query("keyword_headings", f"with {_PAGES}, h as (select doc_id, page, para, case when (doc_id + para) % 5 = 2 and page < 2 then '<i>KeyWords</i>: ' || text else text end as text from l), c as (select *, max(case when page = 0 and contains(lower(text), 'keywords') then para end) over (partition by doc_id) as a, max(case when page = 1 and contains(lower(text), 'keywords') then para end) over (partition by doc_id) as b from h) select doc_id, page, para, text from c where case when a is not null then page > 0 or para > a when b is not null then page > 1 or (page = 1 and para > b) else true end")
def keyword_headings(spark, sf_dir):
    """C5 with the real pattern, in any case."""
    text = F.when(((F.col("doc_id") + F.col("para")) % 5 == 2) & (F.col("page") < 2), F.concat(F.lit("<i>KeyWords</i>: "), "text")).otherwise(F.col("text"))
    return html.cut_through_keywords(_pages(spark, sf_dir).withColumn("text", text))


@query("line_hyphens", f"with {_PAGES}, h as (select doc_id, page, para, replace(replace(text, ' la ', '-' || chr(10) || ' '), ' de ', ' ' || chr(10)) as text from l) select doc_id, page, para, replace(regexp_replace(text, '(\\S)-\\s*\\n', '\\1', 'g'), chr(10), ' ') as text from h")
def line_hyphens(spark, sf_dir):
    """C9 inside a paragraph."""
    made = F.replace(F.replace("text", F.lit(" la "), F.lit("-\n ")), F.lit(" de "), F.lit(" \n"))
    return _pages(spark, sf_dir).withColumn("text", T.join_lines(made)).select(*html.ROWS)


@query("examples_drop", f"with {_PAGES}, h as (select doc_id, page, para, case when (doc_id + para) % 5 = 0 then '(1) ' || text when (doc_id + para) % 7 = 0 then text || chr(10) || ' - x' when para % 3 = 0 then '(x) (2)' || text else text end as text from l) {_RENUMBER} h where not regexp_matches(text, '(?m)^(\\([1-9]?[0-9]\\)|\\s*[—-])')")
def examples_drop(spark, sf_dir):
    k = F.col("doc_id") + F.col("para")
    text = F.when(k % 5 == 0, F.concat(F.lit("(1) "), "text")).when(k % 7 == 0, F.concat("text", F.lit("\n - x"))).when(F.col("para") % 3 == 0, F.concat(F.lit("(x) (2)"), "text"))
    return html.drop_examples(_pages(spark, sf_dir).withColumn("text", text.otherwise(F.col("text"))))


@query("style_mask", "select doc_id, regexp_replace(replace(replace(replace(text, ' la ', ' <b>la</b> '), ' de ', ' <i>de '), '. ', '</i>. '), '<b>.*?</b>|<i>.*?</i>', 'STYLE', 'gs') as text from documents")
def style_mask(spark, sf_dir):
    """C12 with both tags, across lines."""
    made = F.replace(F.replace(F.replace("text", F.lit(" la "), F.lit(" <b>la</b> ")), F.lit(" de "), F.lit(" <i>de ")), F.lit(". "), F.lit("</i>. "))
    return docs(spark, sf_dir).select("doc_id", T.mask_styles(made).alias("text"))


_MARKED = "m as (select doc_id, i - 1 as sent, case when i % 4 = 1 then text || ' UNK' when i % 6 = 2 then 'QUOTE. 12' when i % 6 = 5 then '12. 7' else text end as text from s)"


def _marked(spark, sf_dir):
    n = F.col("sent") + 1
    return sentence_split(spark, sf_dir).withColumn("text", F.when(n % 4 == 1, F.concat("text", F.lit(" UNK"))).when(n % 6 == 2, "QUOTE. 12").when(n % 6 == 5, "12. 7").otherwise(F.col("text")))


_WANTED = "not regexp_matches(text, 'UNK|QUOTE|STYLE') and regexp_matches(text, '[A-Za-zÀ-ÖØ-öø-ɏ]')"


@query("unwanted_sentences", f"with {_SENTENCES}, {_MARKED} select doc_id, cast(sent as int) as sent, text from m where {_WANTED}")
def unwanted_sentences(spark, sf_dir):
    """C19, K7."""
    return html.drop_unwanted(_marked(spark, sf_dir), "latin")


@query("removed_counts", f"""with {_PAGES}, {_SENTENCES}, {_MARKED}, h as (select *, row_number() over (partition by doc_id, page order by para) as n from l)
  select doc_id, 'blank' as step, count(*) - count(*) filter (where not regexp_matches(text, '^\\s*$')) as n_removed from l group by doc_id
  union all select doc_id, 'headers', count(*) filter (where n <= 2) from h group by doc_id
  union all select doc_id, 'footnotes', count(*) - count(*) filter (where c is null or para < c) from (select *, min(case when regexp_matches(text, '^[1-9]?[0-9] .+') then para end) over (partition by doc_id, page) as c from (select doc_id, page, para, case when (doc_id + page + para) % 7 = 0 then '7 ' || text else text end as text from l)) group by doc_id
  union all select doc_id, 'sentences', count(*) - count(*) filter (where {_WANTED}) from m group by doc_id""")
def removed_counts(spark, sf_dir):
    """The counts of C3, C6, C7 and C19."""
    rows, said = _pages(spark, sf_dir), _marked(spark, sf_dir)
    noted = rows.withColumn("text", F.when((F.col("doc_id") + F.col("page") + F.col("para")) % 7 == 0, F.concat(F.lit("7 "), "text")).otherwise(F.col("text")))
    steps = (("blank", rows, html.drop_blank(rows)), ("headers", rows, html.drop_headers(rows)), ("footnotes", noted, html.cut_footnotes(noted)), ("sentences", said, html.drop_unwanted(said, "latin")))
    out = None
    for name, before, after in steps:
        one = html.removed(before, after).select("doc_id", F.lit(name).alias("step"), "n_removed")
        out = one if out is None else out.unionByName(one)
    return out


_SPLIT = r"list_filter(list_transform(string_split(regexp_replace({0}, '([.!?][)\"»”]?)\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: " + _TRIM.format("s") + "), lambda s: s <> '')"


@query("rendered", f"""with {_PAGES}, s as (select doc_id, page, para, {_SPLIT.format('text')} as x from l), p as (select doc_id, page, para, array_to_string(x, chr(10)) || chr(10) as b from s where len(x) > 0)
  select doc_id, string_agg(b, chr(10) order by page, para) as text from p group by doc_id""")
def rendered(spark, sf_dir):
    """C21."""
    return html.render(html.split_sentences(_pages(spark, sf_dir)))


# ---- plain text

@query("glued_numbers", r"select doc_id, regexp_replace(replace(replace(text, ' de ', 'NUM_arab NUM_arab '), ' la ', ' laNUM_arabNUM_arabx '), '[^ \n]+?NUM_arab', '', 'g') as text from documents")
def glued_numbers(spark, sf_dir):
    """K9."""
    made = F.replace(F.replace("text", F.lit(" de "), F.lit("NUM_arab NUM_arab ")), F.lit(" la "), F.lit(" laNUM_arabNUM_arabx "))
    return docs(spark, sf_dir).select("doc_id", T.strip_glued_numbers(made).alias("text"))


@query("spaced_marks", "select doc_id, regexp_replace(replace(replace(replace(regexp_replace(replace(replace(text, ' de ', ' % * de  '), ' la ', ' , .' || chr(8195)), ' +', ' ', 'g'), chr(8195), ''), ' .', '.'), ' ,', ','), '[%*] ', '', 'g') as text from documents")
def spaced_marks(spark, sf_dir):
    """K8 with the marks of one variant."""
    made = F.replace(F.replace("text", F.lit(" de "), F.lit(" % * de  ")), F.lit(" la "), F.lit(f" , .{T.EM_SPACE}"))
    return docs(spark, sf_dir).select("doc_id", T.tidy_spaces(made, marks=True).alias("text"))


@query("beginning_cut", "select doc_id, regexp_replace(replace(text, '. ', '. Введение. '), '[^\\n]*?Введение\\.?', 'Введение. ', 'g') as text from documents")
def beginning_cut(spark, sf_dir):
    """L1."""
    return docs(spark, sf_dir).select("doc_id", T.strip_beginning(F.replace("text", F.lit(". "), F.lit(". Введение. "))).alias("text"))


_HEAD = "h as (select doc_id, para, case when doc_id % 3 = 0 then 'Journal, page ' || para || chr(10) || text when doc_id % 3 = 1 and para % 2 = 0 then text || chr(10) || para || ' of 9' else text end as text from l)"


def _headed(spark, sf_dir):
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Journal, page "), F.col("para"), F.lit("\n"), "text")).when((F.col("doc_id") % 3 == 1) & (F.col("para") % 2 == 0), F.concat("text", F.lit("\n"), F.col("para"), F.lit(" of 9")))
    return _lines(spark, sf_dir).withColumn("text", text.otherwise(F.col("text")))


_REPEATED = """b as (select doc_id, para, text, string_split(text, chr(10)) as x, case when contains(text, chr(10)) then list_transform(string_split(text, chr(10)), lambda y: regexp_replace(y, '[0-9]+', '#', 'g')) end as m from {0}),
  c as (select *, m[1] is not null and count(m[1]) over (partition by doc_id, m[1]) >= 3 and length(regexp_replace(m[1], '[#\\s]', '', 'g')) > 3 as a, m[-1] is not null and count(m[-1]) over (partition by doc_id, m[-1]) >= 3 and length(regexp_replace(m[-1], '[#\\s]', '', 'g')) > 3 as z from b),
  r as (select doc_id, para, case when a or z then array_to_string(x[(case when a then 2 else 1 end):(case when z then len(x) - 1 else len(x) end)], chr(10)) else text end as text from c)"""


@query("repeated_lines", f"with {_LINES}, {_HEAD}, {_REPEATED.format('h')} select doc_id, para, text from r")
def repeated_lines(spark, sf_dir):
    """L4."""
    return plain.drop_repeated_lines(_headed(spark, sf_dir)).select("doc_id", "para", "text")


_SHORT = "t as (select doc_id, para, case when (doc_id + para) % 3 = 0 then left(text, 12) || chr(10) || 'a row' || chr(10) || text when (doc_id + para) % 3 = 1 and doc_id % 2 = 0 then text || chr(10) || 'short' || chr(10) || 'end' else text end as text from l)"
_TABLES = """x as (select *, string_split(text, chr(10))[:-2] as y from {0}), n as (select *, len(y) > 0 and len(list_filter(y, lambda s: length(s) < 15)) > 0.33 * len(y) as tab from x),
  k as (select *, count(*) filter (where not tab) over (partition by doc_id) > 0.5 * count(*) over (partition by doc_id) as many from n)"""


@query("tables_drop", f"with {_LINES}, {_SHORT}, {_TABLES.format('t')} select doc_id, para, text from k where not many or not tab")
def tables_drop(spark, sf_dir):
    """L9."""
    k = F.col("doc_id") + F.col("para")
    text = F.when(k % 3 == 0, F.concat(F.expr("left(text, 12)"), F.lit("\na row\n"), "text")).when((k % 3 == 1) & (F.col("doc_id") % 2 == 0), F.concat("text", F.lit("\nshort\nend")))
    return plain.drop_tables(_lines(spark, sf_dir).withColumn("text", text.otherwise(F.col("text"))))


_LONG = "case when length({0}) > 0.7 * length({1}) then {0} else {1} end"


@query("quotations_cut", f"with q as (select doc_id, text || ' «' || left(text, 100) || '» «' || left(text, 20) || '»' as x from documents), n as (select doc_id, x, regexp_replace(x, '«[^«»]{{50,500}}»', '', 'g') as y from q) select doc_id, {_LONG.format('y', 'x')} as text from n")
def quotations_cut(spark, sf_dir):
    """L10."""
    made = F.concat("text", F.lit(" «"), F.expr("left(text, 100)"), F.lit("» «"), F.expr("left(text, 20)"), F.lit("»"))
    return docs(spark, sf_dir).select("doc_id", made.alias("text")).select("doc_id", T.strip_quotations(F.col("text")).alias("text"))


_GOOD = "list_filter(string_split({0}, '.'), lambda s: not regexp_matches(s, '(^|\\s)\\S(\\s+\\S){{4}}(\\s|$)') and coalesce(length(regexp_replace(s, '[^A-Za-zÀ-ÖØ-öø-ɏ]', '', 'g')) / nullif(length(s), 0), 0) > 0.3)"


@query("bad_sentences_cut", f"with m as (select doc_id, replace(replace(text, '. ', '. a b c d e. 12345 x. '), ' la ', ' l a l e l ') as text from documents) select doc_id, array_to_string({_GOOD.format('text')}, '.') as text from m")
def bad_sentences_cut(spark, sf_dir):
    """L11."""
    made = F.replace(F.replace("text", F.lit(". "), F.lit(". a b c d e. 12345 x. ")), F.lit(" la "), F.lit(" l a l e l "))
    return docs(spark, sf_dir).select("doc_id", made.alias("text")).select("doc_id", T.strip_bad_sentences(F.col("text"), "latin").alias("text"))


_TIDY = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({{0}}, '[ ]{{{{2,}}}}', ' ', 'g'), '\\s{{{{2,}}}}', chr(10) || chr(10), 'g'), '[{P.FOREIGN_CHARACTERS}]', '', 'g'), '[«»“”„]', '\"', 'g')"


@query("legacy_tidy", f"select doc_id, {_TIDY.format('''replace(replace(text, ' la ', '   «la”   '), '. ', '. ' || chr(10) || chr(9))''')} as text from documents")
def legacy_tidy(spark, sf_dir):
    """L14."""
    made = F.replace(F.replace("text", F.lit(" la "), F.lit("   «la”   ")), F.lit(". "), F.lit(". \n\t"))
    return docs(spark, sf_dir).select("doc_id", T.tidy_legacy(made).alias("text"))


# ---- symbols, tokens

@query("symbols_of_all_kinds", "select doc_id, replace(replace(replace(replace(replace(replace(text, ' la ', ' \"la\" '), ' de ', chr(8195) || '-' || chr(8195)), ' the ', chr(8194) || 'x-y '), ' et ', ' * ∽ '), ' un ', ' .un. '), ' der ', chr(9) || 'der ...') as text from (select doc_id, translate(replace(text, '…', '...'), 'ÄäËëÏïÖöÜüŸÿß', 'AaEeIiOoUuYys') as text from documents)")
def symbols_of_all_kinds(spark, sf_dir):
    """N1 on quotes, dashes, hyphens, spaces, bullets, tildes, tabs and ellipses."""
    t = F.col("text")
    for was, now in ((" la ", " «la” "), (" de ", "—"), (" the ", " x‑y "), (" et ", " ∗ ≋ "), (" un ", " •un× "), (" der ", "\t\tder …")):
        t = F.replace(t, F.lit(was), F.lit(now))
    return docs(spark, sf_dir).select("doc_id", T.unify_symbols(t).alias("text"))


@query("each_replaced", "select doc_id, regexp_replace(text, '[a.é-]', '<>', 'g') as text from documents")
def each_replaced(spark, sf_dir):
    """N2."""
    return docs(spark, sf_dir).select("doc_id", T.replace_each(F.col("text"), "a.é-", "<>").alias("text"))


@query("digit_mask", "select doc_id, repeat('x', cast(length(cast(n_chars as varchar)) as int)) as masked from documents")
def digit_mask(spark, sf_dir):
    """N3."""
    return table(spark, sf_dir, "documents").select("doc_id", T.mask_digits(F.col("n_chars").cast("string")).alias("masked"))


_WORDS = r"w as (select doc_id, cast(generate_subscripts(x, 1) - 1 as int) as pos, unnest(x) as word from (select doc_id, regexp_extract_all(lower(text), '\p{L}+') as x from documents))"


def _tokens(spark, sf_dir):
    return tokens.tokens(docs(spark, sf_dir))


@query("token_clean", f"with {_WORDS} select doc_id, pos, case when pos % 5 = 0 and pos % 2 = 0 then null when pos % 5 = 0 then 'Файл' else word || 'x' end as token from w")
def token_clean(spark, sf_dir):
    """N4."""
    token = F.when(F.col("pos") % 5 == 0, "Файл").otherwise(F.concat(F.lit("  "), "word", F.lit(" x ")))
    return _tokens(spark, sf_dir).select("doc_id", "pos", T.clean_token(token, F.when(F.col("pos") % 2 == 0, "SpaceAfter=No").otherwise("_")).alias("token"))


@query("lemma_clean", f"with {_WORDS} select doc_id, pos, case when pos % 7 = 0 then null when pos % 3 = 0 then '«x' || word || '»!' else word end as lemma from w")
def lemma_clean(spark, sf_dir):
    """N5."""
    k = F.col("pos")
    lemma = F.when(k % 14 == 0, F.concat("word", F.lit("|x"))).when(k % 7 == 0, F.concat("word", F.lit(".JPG"))).when(k % 3 == 0, F.concat(F.lit("«X"), "word", F.lit("»!"))).otherwise(F.concat(F.lit(" «_"), "word", F.lit("»")))
    # A mark after the closing guillemet keeps the guillemet, but for punctuation nothing is cut at all.
    return _tokens(spark, sf_dir).select("doc_id", "pos", T.clean_lemma(lemma, F.when((k % 3 == 0) & (k % 7 != 0), "PUNCT").otherwise("NOUN")).alias("lemma"))


_CONLL = f"""{_WORDS}, k as (select *, case when pos % 9 = 4 then 'NUM' when pos % 5 in (0, 1, 2) then 'PROPN' when pos % 5 = 3 then 'PUNCT' else 'NOUN' end as upos, case when pos % 5 = 2 then 'Gen' else 'Nom' end as cs,
    pos % 10 = 0 as broken, pos % 11 = 6 as special from w),
  r as (select *, case when special then null when upos = 'NUM' then 'xxx' else word end as lemma, upos = 'PROPN' and not special as name from k),
  g as (select *, coalesce(name and lag(name) over o and cs = lag(cs) over o and not lag(broken) over o, false) as joins from r window o as (partition by doc_id order by pos)),
  i as (select *, sum(case when joins then 0 else 1 end) over (partition by doc_id order by pos) as run from g),
  t as (select doc_id, min(pos) as first, arg_min(upos, pos) as upos, bool_or(special) as special, string_agg(lemma, '::' order by pos) as lemma from i group by doc_id, run)"""
_TOKEN = "case when special then '[UNK]_UNK' else lemma || '_' || upos end"


def _conllu(spark, sf_dir):
    """CoNLL-U of made-up tags, a text a document; line numbers start at 1 after a comment."""
    k = F.col("pos")
    upos = F.when(k % 9 == 4, "NUM").when(k % 5 < 3, "PROPN").when(k % 5 == 3, "PUNCT").otherwise("NOUN")
    feats = F.concat(F.lit("Case="), F.when(k % 5 == 2, "Gen").otherwise("Nom"), F.lit("|Number=Sing"))
    token = F.when(k % 11 == 6, "UNKx").when(k % 9 == 4, "123").otherwise(F.col("word"))
    line = F.concat_ws("\t", k.cast("string"), token, "word", upos, F.lit("_"), feats, F.lit("_"), F.lit("_"), F.lit("_"), F.when(k % 10 == 0, r"SpacesAfter=\n").otherwise("_"))
    rows = _tokens(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("x")))).alias("_l"))
    return rows.select("doc_id", F.concat(F.lit("# text\n"), F.array_join(F.transform("_l", lambda x: x["x"]), "\n")).alias("conllu"))


@query("conllu_tokens", f"with {_CONLL} select doc_id, cast(first + 1 as int) as pos, {_TOKEN} as token from t where special or upos <> 'PUNCT'")
def conllu_tokens(spark, sf_dir):
    """N6."""
    return tokens.conllu(_conllu(spark, sf_dir))


@query("word_pairs", f"with {_CONLL} select doc_id, string_agg(lower({_TOKEN}), ' ' order by first) as words from t where special or upos <> 'PUNCT' group by doc_id")
def word_pairs(spark, sf_dir):
    """T5."""
    return tokens.word_pairs(_conllu(spark, sf_dir)).select("doc_id", F.array_join("words", " ").alias("words"))


@query("numerals", "select doc_id, replace(replace(text, ' la ', ' numarab_NUM '), ' de ', ' numlat_NUM xnumlat_NUM ') as text from documents")
def numerals(spark, sf_dir):
    """The mend of the tagger's output."""
    made = F.replace(F.replace("text", F.lit(" la "), F.lit(" numarab_PROPN ")), F.lit(" de "), F.lit(" numlat_PROPN xnumlat_PROPN "))
    return docs(spark, sf_dir).select("doc_id", tokens.numerals(made).alias("text"))


@query("tagged_texts", rf"""with {_WORDS}, b as (select distinct unnest(regexp_extract_all(lower(text), '\p{{L}}+')) as word from benchmark),
  t as (select doc_id, pos, w.word, case when b.word is not null then case when length(w.word) % 2 = 0 then 'X' else 'M' end when regexp_matches(w.word, '^.{{1,2}}$') then 'S' when regexp_matches(w.word, '(ing|ed|er|en|ar|ать|ить)$') then 'V' when regexp_matches(w.word, '(ly|ment|mente|lich)$') then 'R'
    when regexp_matches(w.word, '(ous|able|ible|al|ый|ий)$') then 'A' else 'N' end as tag from w left join b using (word))
  select doc_id, string_agg(word || '_' || tag, ' ' order by pos) as text from t where tag <> 'X' group by doc_id""")
def tagged_texts(spark, sf_dir):
    """A lexicon of the benchmark's words, of which every other has a tag that is not kept."""
    known = table(spark, sf_dir, "benchmark").select(F.explode(tokens.words(F.col("text"))).alias("wordform")).distinct()
    lexicon = known.select("wordform", F.col("wordform").alias("lemma"), F.when(F.length("wordform") % 2 == 0, "X").otherwise("M").alias("pos"))
    return tokens.lemma_text(tokens.keep_tags(tokens.tag(_tokens(spark, sf_dir), lexicon)))


def _tagger():
    """Stands for a tagger that is loaded once a worker."""
    return lambda texts: [[(w.lower(), "N" if len(w) % 2 else "V") for w in t.split(" ")] for t in texts]


@query("plugged_tagger", "select doc_id, cast(generate_subscripts(x, 1) - 1 as int) as pos, lower(unnest(x)) as lemma, case when length(unnest(x)) % 2 = 1 then 'N' else 'V' end as tag from (select doc_id, string_split(text, ' ') as x from documents)")
def plugged_tagger(spark, sf_dir):
    """T1, T3 with a tagger of one's own."""
    return tokens.tokenize_with(docs(spark, sf_dir), _tagger)


@query("line_batches", "select (doc_id - 1) // 50 as batch, count(*) as lines, sum(length(text)) as characters from documents where doc_id between 17 and 733 group by 1")
def line_batches(spark, sf_dir):
    """T4: a range of lines (here documents, by number) in batches."""
    lines = tokens.line_range(docs(spark, sf_dir).withColumnRenamed("doc_id", "line"), 17, 733)
    return tokens.batches(lines, 50).groupBy("batch").agg(F.count("*").alias("lines"), F.sum(F.length("text")).cast("double").alias("characters"))


SQL["line_batches"] = SQL["line_batches"].replace("sum(length(text))", "cast(sum(length(text)) as double)")


@query("connector_words", rf"with {_WORDS} select distinct word || '_s' as word from w where length(word) <= 2")
def connector_words(spark, sf_dir):
    """T6."""
    texts = tokens.lemma_text(tokens.tag(_tokens(spark, sf_dir)))
    return tokens.connectors(texts.select(F.lower("text").alias("text")))


@query("training_words", r"select doc_id, array_to_string(list_filter(regexp_extract_all(lower(text), '\p{L}+'), lambda x: length(x) between 2 and 15), ' ') as words from documents")
def training_words(spark, sf_dir):
    """T7."""
    return docs(spark, sf_dir).select("doc_id", F.array_join(tokens.training_words(F.col("text")), " ").alias("words"))


@query("usable_tokens", r"select doc_id, array_to_string(list_filter(string_split(replace(replace(text, ' la ', ' _PUNCT '), ' de ', ' d-e_N '), ' '), lambda t: not contains(t, 'PUNCT') and not regexp_matches(regexp_extract(t, '^[^_]*', 0), '[!\"#$%&''()*+,\-./:;<=>?@\[\\\]^`{|}~]') and t <> ''), ' ') as words from documents")
def usable_tokens(spark, sf_dir):
    """S10's filter."""
    made = F.replace(F.replace("text", F.lit(" la "), F.lit(" _PUNCT ")), F.lit(" de "), F.lit(" d-e_N "))
    return docs(spark, sf_dir).select("doc_id", F.array_join(tokens.usable_tokens(made), " ").alias("words"))


@query("prefiltered_lines", rf"""with {_LINES}, m as (select doc_id, para, case when para % 4 = 1 then '7 ' || text when para % 4 = 2 then ' Таблица 1' when para % 4 = 3 then 'по-русски книга-то ' || text else text || '  ' end as text from l), t as (select doc_id, para, {_TRIM.format('text')} as text from m)
  select doc_id, para, replace(text, 'по-русски книга-то', 'по-русски книгато') as text from t where text <> '' and not regexp_matches(text, '^(\p{{N}}|Таблица |Фотография )')""")
def prefiltered_lines(spark, sf_dir):
    """G1."""
    k = F.col("para") % 4
    text = F.when(k == 1, F.concat(F.lit("7 "), "text")).when(k == 2, " Таблица 1").when(k == 3, F.concat(F.lit("по-русски книга-то "), "text")).otherwise(F.concat("text", F.lit("  ")))
    return plain.prefilter_lines(_lines(spark, sf_dir).withColumn("text", text))


# ---- whole pipelines

_PERIODS = r"regexp_replace({0}, '[!?]|:\s*$', '.', 'g')"
_QUOTES = "regexp_replace({0}, '[«“„''\"].*?[»”''\"“]', 'QUOTE', 'gs')"
_HANGING = r"regexp_replace(regexp_replace({0}, '\([^)]*?\(', '', 'g'), '\[[^\]]*?\[', '', 'g')"
_NESTED = f"case when regexp_matches(text, '[\\[(]') then {_FOLD} else text end"


def _unknown_and_numbers() -> str:
    """text through C16 and C17."""
    unknown = f"regexp_replace(text, '[{_KNOWN}]*[^{_BREAK}{_KNOWN}][^{_BREAK}]*', 'UNK', 'g')"
    return f"regexp_replace(regexp_replace({unknown}, '(?m)[{P.ARABIC}]+($|[{_BREAK}])', 'NUM_arab\\1', 'g'), '(?m)[{P.ROMAN}]+($|[{_BREAK}])', 'NUM_lat\\1', 'g')"


def _masked_sql(source: str) -> str:
    """m3: the texts of a table through C10, C8, K3, C14, C16 and C17."""
    return f"m1 as (select doc_id, {_HANGING.format(_QUOTES.format(_PERIODS.format('text')))} as text from {source}), m2 as (select doc_id, {_NESTED} as text from m1), m3 as (select doc_id, {_unknown_and_numbers()} as text from m2)"


_FORMED = "len(w) >= 5 and list_sum(list_transform(w, lambda x: length(x))) > 5.0 * len(w) and regexp_matches(text, '^[A-ZÀ-ÖØ-ÞN]') and text like '%.' and not contains(text, '//')"
SQL["clean_articles"] = f"""with {_masked_sql('documents')}, s as (select doc_id, {_SPLIT.format('text')} as x from m3), e as (select doc_id, cast(generate_subscripts(x, 1) - 1 as int) as sent, unnest(x) as text from s),
  t as (select doc_id, sent, regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(text, ' +', ' ', 'g'), chr(8195), ''), ' .', '.'), ' ,', ','), '[%*] ', '', 'g'), '[^ \\n]+?NUM_arab', '', 'g') as text from e where {_WANTED}),
  w as (select *, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '' and x <> 'NUM_arab') as w from t) select doc_id, sent, text from w where {_FORMED}"""


_EXTRACTED = f"""d as (select doc_id, replace(replace(text, chr(10), chr(10) || chr(10)), '. ', '.' || chr(10)) as b from documents), e as (select doc_id, b, regexp_replace(b, '(?s)(?:{P.BIBLIOGRAPHY})\\.?.*', '') as x from d),
  f as (select doc_id, {_LONG.format('x', 'b')} as text, length(x) > 0.7 * length(b) and length(x) < length(b) as ended from e),
  p as (select doc_id, cast(generate_subscripts(string_split(text, chr(10) || chr(10)), 1) - 1 as int) as para, unnest(string_split(text, chr(10) || chr(10))) as text from f),
  q as (select doc_id, para, text from (select *, count(*) over (partition by doc_id, regexp_replace(text, '[0-9]+', 'NUM', 'g')) as n from p) where n = 1),
  {_REPEATED.format('q')}, k1 as (select * from r where text <> ''), s1 as (select *, row_number() over (partition by doc_id order by para) = 1 or not regexp_matches(text, '^[а-яёa-z]') as s from k1),
  g1 as (select *, sum(s::int) over (partition by doc_id order by para) as g, coalesce(not lead(s) over (partition by doc_id order by para), false) as j from s1),
  o as (select doc_id, min(para) as para, string_agg(case when j and text like '%-' then left(text, -1) when j then text || ' ' else text end, '' order by para) as text from g1 group by doc_id, g),
  v as (select *, row_number() over (partition by doc_id order by para) - 1 as n, count(*) over (partition by doc_id) as o, len(regexp_extract_all(text, '[a-zA-Z]+')) as w from o),
  h1 as (select *, max(case when n < least(15, o // 4) and w > 35 then n end) over (partition by doc_id) as h from v), l1 as (select doc_id, para, text from h1 where case when h > 2 then n > h else n >= 5 end),
  t1 as (select l1.*, ended, row_number() over (partition by l1.doc_id order by para desc) as n from l1 join f using (doc_id)), a1 as (select doc_id, para, text from t1 where (ended or n > 2) and coalesce(length(regexp_replace(text, '[^A-Za-zÀ-ÖØ-öø-ɏ]', '', 'g')) / nullif(length(text), 0), 0) > 0.2),
  {_TABLES.format('a1').replace(' n as ', ' n1 as ').replace('from n)', 'from n1)').replace('k as', 'k2 as')}, z as (select doc_id, string_agg(replace(text, chr(10), ' '), chr(10) || chr(10) order by para) as text from k2 where not many or not tab group by doc_id),
  u1 as (select doc_id, text, regexp_replace(text, '«[^«»]{{50,500}}»', '', 'g') as y from z), u2 as (select doc_id, {_LONG.format('y', 'text')} as text from u1), u3 as (select doc_id, array_to_string({_GOOD.format('text')}, '.') as text from u2),
  u4 as (select doc_id, text, regexp_replace(text, '\\[(.*?)\\]', '', 'g') as y from u3), u5 as (select doc_id, {_LONG.format('y', 'text')} as text from u4),
  u6 as (select doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[^ ]+@[^ ]+', '', 'gs'), 'https:[^ ]+', 'URL', 'gs'), '[^ ]+?/[^ ]+?/[^ ]+?', 'URL', 'gs') as text from u5)"""
SQL["clean_extracted"] = f"with {_EXTRACTED} select documents.doc_id, coalesce({_TIDY.format('u6.text')}, '') as text from documents left join u6 using (doc_id)"


_BARE = "regexp_replace(regexp_replace(html, '<script\\b.*?</script>', '', 'gis'), '<style\\b.*?</style>', '', 'gis')"
_PARAGRAPH = _UNIFY.format(r"regexp_replace(translate(regexp_replace(x, '<[^>]*>', '', 'gs'), '&<>', '   '), '\. ', '.' || chr(10), 'g')")
_HTML = f"""x as (select page_id as doc_id, list_transform(regexp_extract_all({_BARE}, '<p>(.*?)</p>', 1, 's'), lambda x: {_PARAGRAPH}) as x from pages),
  r0 as (select doc_id, generate_subscripts(x, 1) as was, unnest(x) as text from x), r1 as (select doc_id, was, generate_subscripts({_BLANKS.format('text')}, 1) as part, unnest({_BLANKS.format('text')}) as text from r0),
  r2 as (select doc_id, 0 as page, row_number() over (partition by doc_id order by was, part) as para, text from r1), b1 as ({_RENUMBER} r2 where not regexp_matches(text, '^\\s*$')),
  r3 as (select *, min(case when regexp_matches(text, '(?m)^\\s*(?:[rR]eference|REFERENCE|[bB]ibliography|BIBLIOGRAPHY)') then para end) over (partition by doc_id) as c, max(case when contains(lower(text), 'keywords') then para end) over (partition by doc_id) as a from b1),
  one as (select doc_id, page, para, text from r3 where (c is null or para < c) and (a is null or para > a)),
  r4 as (select *, row_number() over w as n, not contains(text, chr(10)) as s, first_value(not contains(text, chr(10))) over w as f from one window w as (partition by doc_id order by para)),
  r5 as (select doc_id, page, para, text, min(case when regexp_matches(text, '^[1-9]?[0-9] .+') then para end) over (partition by doc_id) as c from r4 where not ((n = 1 and s) or (n = 2 and s and f))),
  two as ({_RENUMBER} r5 where c is null or para < c), r6 as (select doc_id, page, para, {_QUOTES.format('text')} as text from two), three as ({_RENUMBER} r6 where not regexp_matches(text, '^\\s*$')),
  r7 as (select doc_id, para, replace(regexp_replace(text, '(\\S)-\\s*\\n', '\\1', 'g'), chr(10), ' ') as text from three), r8 as (select *, text like '%-' and lead(para) over (partition by doc_id order by para) is not null as h from r7),
  r9 as (select *, coalesce(lag(h) over (partition by doc_id order by para), false) as j from r8), r10 as (select *, sum((not j)::int) over (partition by doc_id order by para) as g from r9),
  r11 as (select doc_id, 0 as page, min(para) as para, string_agg(case when h then left(text, -1) else text end, '' order by para) as text from r10 group by doc_id, g),
  b2 as ({_RENUMBER} (select doc_id, page, para, {_PERIODS.format('text')} as text from r11) where not regexp_matches(text, '^\\s*$')),
  r12 as (select *, coalesce(not regexp_matches(lag(text) over (partition by doc_id order by para), '[a-zà-öø-ÿ].*\\.\\s*$'), false) as c from b2), r13 as (select *, sum((not c)::int) over (partition by doc_id order by para) as g from r12),
  r14 as (select doc_id, 0 as page, min(para) as para, string_agg(text, ' ' order by para) as text from r13 group by doc_id, g),
  r15 as (select doc_id, page, para, regexp_replace(text, '<b>.*?</b>|<i>.*?</i>', 'STYLE', 'gs') as text from ({_RENUMBER} r14)), r16 as ({_RENUMBER} r15 where not regexp_matches(text, '(?m)^(\\([1-9]?[0-9]\\)|\\s*[—-])')),
  r17 as (select doc_id, page, para, {_NESTED} as text from r16), r18 as (select doc_id, page, para, regexp_replace(text, '\\d+[.,]|[^\\s\\d]+?\\d+\\s', '', 'g') as text from r17),
  r19 as (select doc_id, page, para, {_unknown_and_numbers()} as text from r18), r20 as (select *, {_SPLIT.format('text')} as x from r19),
  r21 as (select doc_id, page, para, cast(generate_subscripts(x, 1) - 1 as int) as sent, unnest(x) as text from r20), four as (select doc_id, page, para, sent, text from r21 where {_WANTED})"""
SQL["clean_html"] = f"with {_HTML} select * from four"


@query("html_status", f"""with {_HTML}, n as (select page_id as doc_id, (select count(*) from one where doc_id = page_id) as a, (select count(*) from two where doc_id = page_id) as b, (select count(*) from three where doc_id = page_id) as c, (select count(*) from four where doc_id = page_id) as d from pages)
  select doc_id, d as n_sentences, a > 0 and b > 0 and c > 0 and d > 0 as kept, case when a = 0 then 'keywords' when b = 0 then 'footnotes' when c = 0 then 'quotations' when d = 0 then 'unwanted sentences' end as emptied from n""")
def html_status(spark, sf_dir):
    """C20's status."""
    return html.status(table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id")), html.checkpoints(shaped_pages(spark, sf_dir), "latin", written=True))


_SUBSET = f"""l2 as (select doc_id, page, para, {_QUOTES.format(_PERIODS.format('text'))} as text from l), b1 as ({_RENUMBER} l2 where not regexp_matches(text, '^\\s*$')), r17 as (select doc_id, page, para, {_NESTED} as text from b1),
  r18 as (select doc_id, page, para, regexp_replace(text, '\\d+[.,]|[^\\s\\d]+?\\d+\\s', '', 'g') as text from r17), r19 as (select doc_id, page, para, {_unknown_and_numbers()} as text from r18), r20 as (select *, {_SPLIT.format('text')} as x from r19),
  r21 as (select doc_id, page, para, cast(generate_subscripts(x, 1) - 1 as int) as sent, unnest(x) as text from r20), r22 as (select *, dense_rank() over (partition by doc_id order by page, para) as n from r21 where {_WANTED})"""


@query("clean_subset", f"with {_PAGES}, {_SUBSET} select doc_id, page, para, sent, regexp_replace(regexp_replace(text, ' [\"#$%&''()*+,\\-/:;<=>@\\[\\]^_`{{|}}~ʹ…〈〉«»—„“]', '', 'g'), ' \\.$', '.') as text from r22 where n > 2")
def clean_subset(spark, sf_dir):
    """G2."""
    return html.clean_subset(_pages(spark, sf_dir), "latin")
