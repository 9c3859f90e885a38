"""Cleaning of plain text: of sentences line by line, and of whole articles that come from PDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.operators.html import map_text


def clean_articles(docs: DataFrame, alphabet: str = "cyrillic") -> DataFrame:
    """(doc_id, text) to (doc_id, sent, text), sentences that are long-worded and well formed."""
    masked = map_text(docs, T.terminal_periods, T.mask_quotes, T.close_hanging, T.strip_brackets, lambda t: T.mask_unknown(t, alphabet), T.mask_numbers)
    # In the array, before rows are made of it: a filter on the tidied text would repeat the tidying for each of its uses.
    item = lambda s, i: F.struct(i.alias("sent"), s.alias("text"))
    found = F.filter(F.transform(T.sentences(F.col("text")), item), lambda x: T.wanted_sentence(x["text"], alphabet))
    tidy = F.transform(found, lambda x: F.struct(x["sent"].alias("sent"), T.strip_glued_numbers(T.tidy_spaces(x["text"], marks=True)).alias("text")))
    return masked.select("doc_id", F.inline(F.filter(tidy, lambda x: T.well_formed(x["text"], alphabet))))


def good_lines(lines: DataFrame) -> DataFrame:
    """Tidied lines (any columns and text) of at least five words that are long on average."""
    return lines.withColumn("text", T.tidy_spaces(F.col("text"))).where(T.long_worded(F.col("text")))


def paragraphs(docs: DataFrame, text: Column | str = "text", separator: str = "\n\n") -> DataFrame:
    """doc_id, para, text."""
    return docs.select("doc_id", F.posexplode(F.split(text, separator)).alias("para", "text"))


def _doc():
    return Window.partitionBy("doc_id")


def drop_repeated(rows: DataFrame) -> DataFrame:
    """L3: without all copies of paragraphs that occur twice in a document, digits aside."""
    masked = F.regexp_replace("text", "[0-9]+", "NUM")
    return rows.withColumn("_m", masked).withColumn("_n", F.count("*").over(Window.partitionBy("doc_id", "_m"))).where("_n = 1").drop("_m", "_n")


def drop_repeated_lines(rows: DataFrame, least: int = 3) -> DataFrame:
    """L4: paragraphs of several lines without a first or last line (of more than three letters, digits aside) that as
    such occurs at least least times in the document."""
    lines = F.split("text", "\n")
    masked = F.transform(lines, lambda x: F.regexp_replace(x, "[0-9]+", "#"))
    marked = rows.withColumn("_l", lines).withColumn("_m", F.when(F.size(lines) > 1, masked))
    ends = (F.element_at("_m", 1), F.element_at("_m", -1))
    marked = marked.withColumn("_a", ends[0]).withColumn("_z", ends[1])
    for c in ("_a", "_z"):
        n = F.count(c).over(Window.partitionBy("doc_id", c))
        marked = marked.withColumn(c, F.col(c).isNotNull() & (n >= least) & (F.length(F.regexp_replace(c, r"(?U)[#\s]", "")) > 3))
    first = F.when(F.col("_a"), 2).otherwise(1)
    size = F.size("_l") - first + 1 - F.when(F.col("_z"), 1).otherwise(0)
    text = F.when(F.col("_a") | F.col("_z"), F.array_join(F.slice("_l", first, F.greatest(size, F.lit(0))), "\n")).otherwise(F.col("text"))
    return marked.withColumn("text", text).drop("_l", "_m", "_a", "_z")


def restore_paragraphs(rows: DataFrame) -> DataFrame:
    """A paragraph that starts with a lower-case letter joins the one before: without its final hyphen, or after a
    space. Empty paragraphs are left out first."""
    w = _doc().orderBy("para")
    rows = rows.where("text <> ''")
    marked = rows.withColumn("_first", F.row_number().over(w) == 1).withColumn("_start", F.col("_first") | ~F.col("text").rlike("^[а-яёa-z]"))
    marked = marked.withColumn("_next", ~F.coalesce(F.lead("_start").over(w), F.lit(True))).withColumn("_group", F.sum(F.col("_start").cast("int")).over(w))
    hyphen = F.col("text").endswith("-")
    piece = F.when(F.col("_next") & hyphen, F.expr("left(text, length(text) - 1)")).when(F.col("_next"), F.concat("text", F.lit(" "))).otherwise(F.col("text"))
    grouped = marked.withColumn("_p", piece).groupBy("doc_id", "_group").agg(F.array_sort(F.collect_list(F.struct("para", "_p"))).alias("_all"))
    return grouped.select("doc_id", F.col("_all")[0]["para"].alias("para"), F.array_join(F.transform("_all", lambda x: x["_p"]), "").alias("text"))


def drop_leading(rows: DataFrame, most: int = 15, foreign: int = 35, unless: str | None = None) -> DataFrame:
    """Without the paragraphs up to the last of the first min(most, a quarter) that has more than foreign Latin
    words, if that is not among the first three; else without the first five. Documents for which unless (a column)
    holds stay whole."""
    n = F.row_number().over(_doc().orderBy("para")) - 1
    marked = rows.withColumn("_n", n).withColumn("_of", F.count("*").over(_doc()))
    words = F.size(F.regexp_extract_all("text", F.lit("[a-zA-Z]+"), F.lit(0)))
    hit = F.max(F.when((F.col("_n") < F.least(F.lit(most), F.floor(F.col("_of") / 4))) & (words > foreign), F.col("_n"))).over(_doc())
    marked = marked.withColumn("_hit", hit)
    kept = F.when(F.col("_hit") > 2, F.col("_n") > F.col("_hit")).otherwise(F.col("_n") >= 5)
    return marked.where(kept if unless is None else F.col(unless) | kept).drop("_n", "_of", "_hit")


def drop_trailing(rows: DataFrame, n: int = 2, unless: str | None = None) -> DataFrame:
    """Without the last n paragraphs, but for documents for which unless (a column) holds."""
    kept = F.col("_n") > n
    return rows.withColumn("_n", F.row_number().over(_doc().orderBy(F.desc("para")))).where(kept if unless is None else F.col(unless) | kept).drop("_n")


def keep_alphabet(rows: DataFrame, alphabet: str = "cyrillic", share: float = 0.2) -> DataFrame:
    """Paragraphs with more than share letters of the alphabet."""
    return rows.where(F.coalesce(T.share_of(F.col("text"), alphabet), F.lit(0.0)) > share)


def drop_tables(rows: DataFrame, short: int = 15, share: float = 0.33) -> DataFrame:
    """Without paragraphs in which more than share of the lines but the last are short, unless that would leave
    half of the document's paragraphs or fewer."""
    lines = F.split("text", "\n")
    rest = F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0)))
    table = (F.size(rest) > 0) & (F.size(F.filter(rest, lambda x: F.length(x) < short)) > share * F.size(rest))
    marked = rows.withColumn("_t", table).withColumn("_keep", F.count_if(~F.col("_t")).over(_doc()) > 0.5 * F.count("*").over(_doc()))
    return marked.where(~F.col("_keep") | ~F.col("_t")).drop("_t", "_keep")


def clean_extracted(docs: DataFrame, alphabet: str = "cyrillic") -> DataFrame:
    """(doc_id, text) to (doc_id, text). The paragraph steps need no second exchange: all are by doc_id."""
    cut = docs.select("doc_id", F.length("text").alias("_n"), T.strip_beginning(F.col("text")).alias("_b"))
    cut = cut.withColumn("text", T.strip_ending(F.col("_b"))).select("doc_id", "text", (F.length("_b") < F.col("_n")).alias("headed"), (F.length("text") < F.length("_b")).alias("ended"))
    rows = restore_paragraphs(drop_repeated_lines(drop_repeated(paragraphs(cut)))).join(cut.select("doc_id", "headed", "ended"), "doc_id")
    rows = drop_trailing(drop_leading(rows, unless="headed"), unless="ended").select("doc_id", "para", "text")
    rows = drop_tables(keep_alphabet(rows, alphabet)).withColumn("text", F.replace(F.col("text"), F.lit("\n"), F.lit(" ")))
    joined = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("para", "text"))).alias("_p"))
    joined = joined.select("doc_id", F.array_join(F.transform("_p", lambda x: x["text"]), "\n\n").alias("text"))
    joined = map_text(joined, T.strip_quotations, lambda t: T.strip_bad_sentences(t, alphabet), T.strip_square, T.mask_urls, T.tidy_legacy)
    return docs.select("doc_id").join(joined, "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def prefilter_lines(lines: DataFrame) -> DataFrame:
    """G1: trimmed lines that are not blank, do not start with a digit and are no caption of a table or photograph,
    without hyphens at line ends."""
    t = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    kept = lines.withColumn("text", t).where((F.col("text") != "") & ~F.col("text").rlike(r"(?U)^(?:\p{N}|Таблица |Фотография )"))
    return kept.withColumn("text", T.strip_line_hyphens(F.col("text")))


