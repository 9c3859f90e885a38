"""Registered queries that write files and read them again: sources, sinks and the jobs that join them.

The files are made of whole small tables (the benchmark's texts, nations), in a scratch folder of the session."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from lexweave.operators import ngrams
from lexweave.plans import jobs, mining
from lexweave.plans.cleaning import _EXTRACTED, _FORMED, _HTML, _SPLIT, _TIDY, _WANTED, _masked_sql
from lexweave.plans.queries import F2, SQL, docs, frequencies, query, shape, table
from lexweave.sources import files
from lexweave.sources.scratch import put, scratch


def _items(spark, sf_dir, text=None) -> list:
    """(id, text) of the benchmark, which is small at any scale."""
    return [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").select("item_id", (F.col("text") if text is None else text).alias("text")).collect()]


def _folder(spark, items, name="item-{}.html", folder=lambda i: ("even", "odd")[i % 2]) -> str:
    root = scratch(spark, "files")
    for i, text in items:
        put(spark, f"{root}/{folder(i)}/{name.format(i)}", text.encode())
    return root


@query("stored_files", "select 'item-' || item_id as name, octet_length(encode(text)) as length from benchmark where item_id % 2 = 1")
def stored_files(spark, sf_dir):
    """Files below a folder by their extension."""
    root = _folder(spark, [(i, t) for i, t in _items(spark, sf_dir)], "item-{}.txt", lambda i: f"x/{i % 3}")
    for i, text in _items(spark, sf_dir)[:1]:
        put(spark, f"{root}/x/other-{i}.csv", text.encode())
    found = files.list_files(spark, root, ".txt").select(F.regexp_extract("path", r"([^/]+)\.txt$", 1).alias("name"), "length")
    return found.where(F.split("name", "-")[1].cast("int") % 2 == 1)


@query("stored_texts", "select 'item-' || item_id as doc_id, case when item_id % 2 = 0 then 'even' else 'odd' end as field, text || chr(10) || 'end' as text from benchmark")
def stored_texts(spark, sf_dir):
    """Whole files by field."""
    root = _folder(spark, [(i, f"{t}\nend") for i, t in _items(spark, sf_dir)])
    return files.read_fields(spark, root, ["even", "odd"], column="text").select("doc_id", "field", "text")


@query("stored_lines", "select 'item-' || item_id as doc_id, unnest(string_split(replace(text, '. ', '.' || chr(10)), chr(10))) as text from benchmark")
def stored_lines(spark, sf_dir):
    """S4."""
    root = _folder(spark, [(i, t.replace(". ", ".\n") + "\n") for i, t in _items(spark, sf_dir)])
    return files.read_lines(spark, f"{root}/*/*.html")


def _archives(spark, items) -> str:
    root = scratch(spark, "archives")
    for part in (0, 1):
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w") as z:
            z.writestr("empty/", b"")
            for i, text in items:
                if i % 2 == part:
                    z.writestr(f"m/{i}.txt", text)
        put(spark, f"{root}/part-{part}.zip", raw.getvalue())
    return root


_LINED = "' ' || array_to_string(list_filter(list_transform(string_split(replace(text, '. ', '.' || chr(10) || chr(10) || ' '), chr(10)), lambda x: trim(x)), lambda x: x <> ''), ' ')"


@query("stored_archives", f"select 'm/' || item_id || '.txt' as member, {_LINED} as text from benchmark")
def stored_archives(spark, sf_dir):
    """The lines of the members of zip archives."""
    root = _archives(spark, [(i, t.replace(". ", ".\n\n ")) for i, t in _items(spark, sf_dir)])
    return files.read_zips(spark, root, lines=True).select("member", "text")


@query("stored_members", SQL["stored_archives"])
def stored_members(spark, sf_dir):
    """S5 by ranges of members: some tasks an archive."""
    root = _archives(spark, [(i, t.replace(". ", ".\n\n ")) for i, t in _items(spark, sf_dir)])
    return files.read_zip_members(spark, root, lines=True, most=4096).select("member", "text")


_ROWS = "select n_nationkey as id, n_name || ', \"x' || n_regionkey || '\"' as name from nation"


def _rows(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.concat("n_name", F.lit(', "x'), "n_regionkey", F.lit('"')).alias("name"))


@query("stored_csv", f"{_ROWS} union all {_ROWS}")
def stored_csv(spark, sf_dir):
    """Appended twice, with commas and quotes in a field."""
    path = scratch(spark, "csv")
    for _ in range(2):
        files.write_csv(_rows(spark, sf_dir), path)
    return files.read_csv(spark, path, "id int, name string")


@query("stored_tsv", _ROWS)
def stored_tsv(spark, sf_dir):
    """S19, and a schema that is inferred."""
    path = scratch(spark, "tsv")
    files.write_csv(_rows(spark, sf_dir), path, "\t")
    return files.read_csv(spark, path, separator="\t")


@query("stored_ngrams", f"with {F2} select w1 || ' ' || w2 as ngram, cast(freq as varchar) as freq from f2")
def stored_ngrams(spark, sf_dir):
    """S8."""
    path = scratch(spark, "ngrams")
    frequencies(spark, sf_dir, 2).select(F.concat_ws("\t", F.concat_ws(" ", "w1", "w2"), "freq").alias("value")).write.text(path)
    return files.read_ngrams(spark, path).select("ngram", "freq")


@query("stored_table", "select n_nationkey, n_name, n_regionkey from nation")
def stored_table(spark, sf_dir):
    """S9, the form without a database."""
    return files.read_table(spark, f"{sf_dir}/nation.parquet")


@query("stored_corpus", r"select doc_id, array_to_string(list_filter(string_split(text, ' '), lambda t: not contains(t, 'PUNCT') and not regexp_matches(t, '[!\"#$%&''()*+,\-./:;<=>?@\[\\\]^`{|}~]') and t <> ''), ' ') as sentence from (select doc_id, unnest(string_split(replace(text, ' la ', ' PUNCT '), chr(10))) as text from documents) where len(list_filter(string_split(text, ' '), lambda t: not contains(t, 'PUNCT') and not regexp_matches(t, '[!\"#$%&''()*+,\-./:;<=>?@\[\\\]^`{|}~]') and t <> '')) > 0")
def stored_corpus(spark, sf_dir):
    """A document of one page with a paragraph for every other line."""
    path = scratch(spark, "corpus")
    lines = F.transform(F.split(F.replace("text", F.lit(" la "), F.lit(" PUNCT ")), "\n"), lambda x: F.array(F.split(x, " ")))
    docs(spark, sf_dir).select("doc_id", F.array(lines).alias("pages")).write.parquet(path)
    corpus = files.read_table(spark, path)
    parts = corpus.select("doc_id", "pages")
    return parts.select("doc_id", F.explode(files.usable_sentences(F.col("pages"))).alias("s")).select("doc_id", F.array_join("s", " ").alias("sentence"))


@query("stored_vectors", "select 'w' || vec_id as word, len(embedding) as size, round(list_sum(list_transform(embedding, lambda x: cast(x as double))), 4) as total from embeddings")
def stored_vectors(spark, sf_dir):
    """Written and read as text."""
    path = scratch(spark, "vectors")
    files.write_vectors(table(spark, sf_dir, "embeddings").select(F.concat(F.lit("w"), "vec_id").alias("word"), F.col("embedding").alias("vec")), path)
    total = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return files.read_vectors(spark, path).select("word", F.size("vec").cast("long").alias("size"), F.round(total, 4).alias("total"))


@query("page_synonyms", "with a as (select distinct split_part(p_name, ' ', 1) as w, split_part(p_name, ' ', 2) as s from part) select distinct w as word, s as synonym from a where w <> s union select distinct w, 'the ' || w from a")
def page_synonyms(spark, sf_dir):
    """Pages with a list before, in and after the section; items with several links, repeats and the word itself."""
    part = table(spark, sf_dir, "part").select(F.split("p_name", " ")[0].alias("word"), F.split("p_name", " ")[1].alias("s"))
    item = F.transform(F.array_sort(F.collect_list("s")), lambda s: F.concat(F.lit('<li> <a href="1">'), s, F.lit('</a>, <a href="2">not this</a></li>')))
    own = F.concat(F.lit("<LI class=x><a href=3><b>"), "word", F.lit("</b></a></LI><li>none</li><li><a href=4> the <i>"), F.col("word"), F.lit("</i> </a></li>"))
    rows = part.groupBy("word").agg(F.array_join(item, "\n").alias("items"))
    html = F.concat(F.lit('<ul><li><a href="0">before</a></li></ul><a name="F_SYN"></a><ul>'), "items", own, F.lit('</ul><a name="F_ANT">x</a><ul><li><a href="9">after</a></li></ul>'))
    return files.synonyms_of_pages(rows.select("word", html.alias("html")))


@query("console_rows", "select doc_id, lang, n_chars from documents order by doc_id limit 10")
def console_rows(spark, sf_dir):
    """The first rows, as they would be printed."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").orderBy("doc_id")
    return spark.createDataFrame(files.head(rows, 10), rows.schema)


@query("converted_files", "select 'item-' || item_id || case when item_id % 2 = 0 then '.pdf' else '.doc' end as name, case when item_id % 2 = 0 and item_id % 3 > 0 then lower(text) end as text, case when item_id % 2 = 1 then 'not .pdf' when item_id % 3 = 0 then 'ValueError: broken' end as error from benchmark")
def converted_files(spark, sf_dir):
    """A converter of one's own; files of another kind, and those that it fails on."""

    def make():
        def convert(content: bytes) -> str:
            if content.startswith(b"broken"):
                raise ValueError("broken")
            return content.decode().lower()

        return convert

    items = [(i, "broken" if i % 3 == 0 else t) for i, t in _items(spark, sf_dir)]
    root = scratch(spark, "files")
    for i, text in items:
        put(spark, f"{root}/item-{i}.{'doc' if i % 2 else 'pdf'}", text.encode())
    return files.convert(spark, root, make).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "text", "error")


@query("stored_documents", "select doc_id, case when doc_id % 3 = 0 then 'first' else text end as text from documents")
def stored_documents(spark, sf_dir):
    """Documents that are there already are left, others of a later batch are added."""
    path = scratch(spark, "documents")
    files.write_texts(docs(spark, sf_dir).where("doc_id % 3 = 0").select("doc_id", F.lit("first").alias("text")), path)
    files.write_texts(docs(spark, sf_dir), path)
    return spark.read.parquet(path)


@query("stored_appended", "select doc_id, text from documents union all select doc_id, text from documents where doc_id % 3 = 0")
def stored_appended(spark, sf_dir):
    """S16."""
    path = scratch(spark, "documents")
    files.write_texts(docs(spark, sf_dir), path)
    files.write_texts(docs(spark, sf_dir).where("doc_id % 3 = 0"), path, "append")
    return spark.read.parquet(path)


@query("stored_as_files", "select n_name as name, case when n_regionkey = 1 then 'first' else 'NATION ' || n_nationkey end as text from nation")
def stored_as_files(spark, sf_dir):
    """A folder of text a document, named by its slug."""
    path = scratch(spark, "texts")
    nations = table(spark, sf_dir, "nation").select(F.col("n_name").alias("doc_id"), F.concat(F.lit("NATION "), "n_nationkey").alias("text"), "n_regionkey")
    files.write_texts(nations.where("n_regionkey = 1").withColumn("text", F.lit("first")), path, files=True)
    files.write_texts(nations, path, files=True)
    found = spark.read.text(path).select("doc", F.col("value").alias("text"))
    return nations.select("doc_id").join(found, F.lower("doc_id") == F.col("doc")).select(F.col("doc_id").alias("name"), "text")


@query("stored_by_field", "select lang as field, count(*) as n, sum(length(text)) as characters from documents where lang in ('en', 'fr') group by 1")
def stored_by_field(spark, sf_dir):
    """Hive folders, of which a filter leaves the others unread."""
    path = scratch(spark, "fields")
    files.write_by_field(table(spark, sf_dir, "documents").withColumnRenamed("lang", "field"), path)
    read = spark.read.parquet(path).where("field in ('en', 'fr')")
    return read.groupBy("field").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("double").alias("characters"))


SQL["stored_by_field"] = SQL["stored_by_field"].replace("sum(length(text))", "cast(sum(length(text)) as double)")


@query("stored_results", "select r_name as original, n_name as suggested, n_nationkey as n from nation join region on n_regionkey = r_regionkey")
def stored_results(spark, sf_dir):
    """CSV a key; a second call replaces the keys that it has."""
    path, n = scratch(spark, "results"), table(spark, sf_dir, "nation")
    rows = n.join(table(spark, sf_dir, "region"), n["n_regionkey"] == F.col("r_regionkey")).select(F.col("r_name").alias("original"), F.col("n_name").alias("suggested"), F.col("n_nationkey").alias("n"))
    files.write_results(rows.withColumn("suggested", F.when(F.col("n") % 5 < 2, "old").otherwise(F.col("suggested"))), path)
    files.write_results(rows.where("n % 5 < 2"), path)
    return files.read_csv(spark, path, "original string, suggested string, n int").select("original", "suggested", "n")


# ---- jobs

_BENCHMARK_PAGES = "pages as (select item_id as page_id, '<p>Title ' || item_id || '</p><p>' || replace(text, '. ', '.</p><p>It is said. ') || '</p><p>One. Two more words of it. And three.</p>' as html from benchmark)"


def _page_files(spark, sf_dir) -> str:
    body = F.concat(F.lit("<p>Title "), "item_id", F.lit("</p><p>"), F.replace("text", F.lit(". "), F.lit(".</p><p>It is said. ")), F.lit("</p><p>One. Two more words of it. And three.</p>"))
    made = shape(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("page_id"), body.alias("html")))
    return _folder(spark, [(r.page_id, r.html) for r in made.collect()])


@query("job_html", f"with {_BENCHMARK_PAGES}, {_HTML}, pa as (select doc_id, page, para, string_agg(text, chr(10) order by sent) || chr(10) as b from four group by all), re as (select doc_id, string_agg(b, chr(10) order by page, para) as text from pa group by 1) select 'item-' || doc_id as doc_id, text from re")
def job_html(spark, sf_dir):
    """A folder of HTML to rendered texts."""
    out = scratch(spark, "rendered")
    jobs.preprocess_folder(spark, _page_files(spark, sf_dir), out, "latin")
    return spark.read.parquet(out)


@query("job_html_status", f"with {_BENCHMARK_PAGES}, {_HTML}, n as (select page_id, count(four.doc_id) as n from pages left join four on page_id = doc_id group by 1) select 'item-' || page_id as doc_id, n as n_sentences, n > 0 as kept from n")
def job_html_status(spark, sf_dir):
    """C22's result for each file; the second run writes nothing again."""
    out, root = scratch(spark, "rendered"), _page_files(spark, sf_dir)
    jobs.preprocess_folder(spark, root, out, "latin")
    return jobs.preprocess_folder(spark, root, out, "latin").select("doc_id", "n_sentences", "kept")


_ARTICLES = f"""src as (select item_id as doc_id, {_LINED} as text from benchmark), {_masked_sql('src')}, s as (select doc_id, {_SPLIT.format('text')} as x from m3), e as (select doc_id, cast(generate_subscripts(x, 1) - 1 as int) as sent, unnest(x) as text from s),
  t as (select doc_id, sent, regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(text, ' +', ' ', 'g'), chr(8195), ''), ' .', '.'), ' ,', ','), '[%*] ', '', 'g'), '[^ \\n]+?NUM_arab', '', 'g') as text from e where {_WANTED}),
  w as (select *, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '' and x <> 'NUM_arab') as w from t)"""


@query("job_articles", f"with {_ARTICLES} select 'm/' || doc_id || '.txt' as member, sent, text from w where {_FORMED}")
def job_articles(spark, sf_dir):
    """Archives to clean sentences."""
    out = scratch(spark, "articles")
    jobs.clean_archives(spark, _archives(spark, [(i, t.replace(". ", ".\n\n ")) for i, t in _items(spark, sf_dir)]), out, "latin")
    return spark.read.parquet(out).select("member", "sent", "text")


@query("job_folder", f"with documents as (select item_id % 8 as doc_id, string_agg(text, chr(10) order by item_id) as text from benchmark group by 1), {_EXTRACTED} select '20' || documents.doc_id as doc_id, coalesce({_TIDY.format('u6.text')}, '') as text from documents left join u6 using (doc_id)")
def job_folder(spark, sf_dir):
    """Texts named by the digits in the files' names."""
    groups: dict[int, list] = {}
    for i, text in sorted(_items(spark, sf_dir)):
        groups.setdefault(i % 8, []).append(text)
    made = [(k, "\n".join(x).replace("\n", "\n\n").replace(". ", ".\n")) for k, x in groups.items()]
    out = scratch(spark, "clean")
    jobs.clean_folder(spark, _folder(spark, made, "paper-20-x{}.txt"), out, "latin")
    return spark.read.parquet(out)


@query("job_suggest", SQL["replacements"])
def job_suggest(spark, sf_dir):
    """F8: files of collocations, vectors and statistics to replacements, written a folder a collocation."""
    root, v = scratch(spark, "suggest"), mining._tagged_vectors(spark, sf_dir)
    mining._vector_collocations(v).select("colloc").write.text(f"{root}/colloc")
    files.write_vectors(v, f"{root}/vectors")
    for n, facts in zip((2, 3), mining._facts(spark, sf_dir), strict=True):
        facts.select(*ngrams.names(n), "freq", "pmi", "t_score").write.parquet(f"{root}/stats{n}")
    jobs.suggest_for(spark, f"{root}/colloc", {n: f"{root}/stats{n}" for n in (2, 3)}, f"{root}/out", f"{root}/vectors", topn=100)
    kinds = "original string, suggested string, rank long, cosScore double, numReplaced int, pmi double, t_score double, ngram_freq long"
    found = files.read_csv(spark, f"{root}/out", kinds).select("original", "suggested", "rank", "cosScore", "numReplaced", "pmi", "t_score", "ngram_freq")
    return found.withColumn("cosScore", F.round("cosScore", 6))
