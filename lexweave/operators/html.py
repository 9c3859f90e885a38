"""Cleaning of HTML documents: rows are paragraphs (doc_id, page, para, text), the numbers from 0.

Every step takes and returns such rows and keeps other columns of the document out. All windows are by document, so
that one exchange by doc_id serves a whole pipeline; a document, however long, is a file and fits a task."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import patterns as P
from lexweave.functions import text as T
from lexweave.sources.scratch import keep

ROWS = ("doc_id", "page", "para", "text")


def _doc():
    return Window.partitionBy("doc_id")


def _page():
    return Window.partitionBy("doc_id", "page")


def _in_doc():
    return _doc().orderBy("page", "para")


def _in_page():
    return _page().orderBy("para")


class _Pages(HTMLParser):
    """The source of each p that is a child of the first div of a div child of body: [[paragraph, ...] of each page]."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.pages: list[list[str]] = []
        self.open: list[str] = []
        self.body = self.inner = self.held = None
        self.parts: list[str] = []

    def handle_starttag(self, tag, attrs):
        if self.held is not None:
            self.parts.append(f"<{tag}>")
        if tag in self.VOID:
            return
        depth = len(self.open)
        if tag == "body" and self.body is None:
            self.body = depth + 1
        elif self.body is not None and tag == "div" and depth == self.body:
            self.pages.append([])
            self.inner = None
        elif self.body is not None and tag == "div" and self.pages and depth > self.body and self.inner is None:
            self.inner = depth + 1
        elif tag == "p" and self.inner == depth and self.held is None:
            self.held, self.parts = depth, ["<p>"]
        self.open.append(tag)

    def handle_endtag(self, tag):
        if tag not in self.open:
            return
        while self.open:
            last = self.open.pop()
            if self.held is not None and len(self.open) > self.held:
                self.parts.append(f"</{last}>")
            if self.held == len(self.open):
                self.pages[-1].append("".join([*self.parts, "</p>"]))
                self.held = None
            if self.inner is not None and len(self.open) < self.inner:
                self.inner = -1
            if last == tag:
                break

    def handle_data(self, data):
        if self.held is not None:
            self.parts.append(data)


def extract_paragraphs(docs: DataFrame, id_col: str = "doc_id", html_col: str = "html") -> DataFrame:
    """Pages (div children of the body) and paragraphs (p children of a page's first div), with unified symbols,
    cut at blank runs. A tree is needed, so this is an Arrow step; null HTML has no paragraphs."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, html in zip(batch["doc_id"], batch["html"], strict=True):
                parser = _Pages()
                parser.feed(html or "")
                parser.close()
                rows += [(key, page, k, p) for page, ps in enumerate(parser.pages) for k, p in enumerate(ps)]
            yield pd.DataFrame(rows, columns=list(ROWS))

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(html_col).alias("html")).mapInPandas(parse, f"doc_id {kind}, page int, para int, text string")
    return split_paragraphs(found.withColumn("text", T.unify_symbols(F.col("text"))))


def split_paragraphs(rows: DataFrame) -> DataFrame:
    """<p>...</p> paragraphs cut where a line break is followed by white space, without their tags."""
    parts = F.split(F.regexp_replace("text", "(?s)^<p>|</p>$", ""), r"(?U)\n+\s+")
    parts = F.transform(parts, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    cut = rows.select("doc_id", "page", F.col("para").alias("was"), F.posexplode(parts).alias("part", "text"))
    number = F.row_number().over(_page().orderBy("was", "part")) - 1
    return cut.select("doc_id", "page", number.alias("para"), "text")


def flat_paragraphs(docs: DataFrame, id_col: str, html_col: str, tag: str = "p") -> DataFrame:
    """C1 for pages of flat markup, without Python: the text inside each <tag>...</tag>, scripts and styles dropped, as
    rows doc_id, para, text."""
    bare = F.regexp_replace(html_col, r"(?is)<(script|style)\b.*?</\1>", "")
    found = F.regexp_extract_all(bare, F.lit(rf"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(found).alias("para", "text")).withColumn("text", F.trim("text"))


def renumber(rows: DataFrame) -> DataFrame:
    """Pages and paragraphs from 0 without gaps."""
    return rows.withColumn("page", F.dense_rank().over(_doc().orderBy("page")) - 1).withColumn("para", F.row_number().over(_in_page()) - 1)


def drop_blank(rows: DataFrame) -> DataFrame:
    """Without blank paragraphs; pages without any vanish with them."""
    return renumber(rows.where(~F.col("text").rlike(r"(?U)^\s*$")))


def cut_from(rows: DataFrame, *headings: str) -> DataFrame:
    """C4: without the first paragraph that matches the first of the patterns that any paragraph matches, and all after."""
    place = F.struct("page", "para")
    first = F.coalesce(*(F.min(F.when(F.col("text").rlike(h), place)).over(_doc()) for h in headings))
    return rows.withColumn("_cut", first).where(F.col("_cut").isNull() | (place < F.col("_cut"))).select(*ROWS)


def cut_references(rows: DataFrame) -> DataFrame:
    return cut_from(rows, P.heading(P.REFERENCES_RU), P.heading(P.REFERENCES_EN))


def cut_through_keywords(rows: DataFrame, pattern: str = P.KEYWORD_HEADING) -> DataFrame:
    """Without the last matching paragraph of the first page, and all before; if there is none, those of the second."""
    hit = lambda page: F.max(F.when((F.col("page") == page) & F.col("text").rlike(pattern), F.col("para"))).over(_doc())
    marked = rows.withColumn("_one", hit(0)).withColumn("_two", hit(1))
    one = (F.col("page") > 0) | (F.col("para") > F.col("_one"))
    two = (F.col("page") > 1) | ((F.col("page") == 1) & (F.col("para") > F.col("_two")))
    return marked.where(F.when(F.col("_one").isNotNull(), one).when(F.col("_two").isNotNull(), two).otherwise(True)).select(*ROWS)


def drop_headers(rows: DataFrame) -> DataFrame:
    """Without a page's first paragraph if it is one line, and its second if both are."""
    single = ~F.replace(F.col("text"), F.lit("\n</i>"), F.lit("")).contains("\n")
    n = F.row_number().over(_in_page())
    marked = rows.withColumn("_n", n).withColumn("_first", F.first(single).over(_in_page()))
    return marked.where(~((F.col("_n") == 1) & single | (F.col("_n") == 2) & single & F.col("_first"))).select(*ROWS)


def cut_footnotes(rows: DataFrame) -> DataFrame:
    """Without each page's first paragraph that starts like a footnote, and the rest of the page."""
    first = F.min(F.when(F.col("text").rlike(P.FOOTNOTE), F.col("para"))).over(_page())
    return rows.withColumn("_cut", first).where(F.col("_cut").isNull() | (F.col("para") < F.col("_cut"))).select(*ROWS)


def _join_islands(rows: DataFrame, window, keys: list[str], continues: Column, glue: Column) -> DataFrame:
    """Rows whose continues holds (on _before, the text before) are joined to the row before, glue between."""
    marked = rows.withColumn("_before", F.lag("text").over(window)).withColumn("_new", F.when(F.coalesce(continues, F.lit(False)), 0).otherwise(1))
    marked = marked.withColumn("_piece", F.when(F.col("_new") == 0, F.concat(glue, F.col("text"))).otherwise(F.col("text"))).withColumn("_island", F.sum("_new").over(window))
    ordered = F.array_sort(F.collect_list(F.struct("page", "para", "_piece")))
    grouped = marked.groupBy(*keys, "_island").agg(ordered.alias("_all"))
    return grouped.select("doc_id", F.col("_all")[0]["page"].alias("page"), F.col("_all")[0]["para"].alias("para"), F.array_join(F.transform("_all", lambda x: x["_piece"]), "").alias("text"))


def dehyphenate(rows: DataFrame, compat: bool = False) -> DataFrame:
    """Words split at line ends joined in a paragraph, then across paragraphs and pages: a paragraph that ends with
    a hyphen absorbs the next, without the hyphen."""
    joined = rows.withColumn("text", T.join_lines(F.col("text"), compat)).withColumn("_hyphen", F.lead("para").over(_in_doc()).isNotNull() & F.col("text").endswith("-"))
    bare = joined.withColumn("_was", F.col("_hyphen")).withColumn("text", F.when(F.col("_hyphen"), F.expr("left(text, length(text) - 1)")).otherwise(F.col("text")))
    bare = bare.withColumn("_after", F.lag("_was").over(_in_doc()))
    return renumber(_join_islands(bare, _in_doc(), ["doc_id"], F.col("_after"), F.lit("")))


def join_broken(rows: DataFrame, alphabet: str = "cyrillic") -> DataFrame:
    """C11: paragraphs joined to the one before on their page unless that has a lower-case letter and a final period;
    pages to the one before unless that ends with a period. Blank paragraphs are left out first."""
    rows = drop_blank(rows)
    paged = _join_islands(rows, _in_page(), ["doc_id", "page"], ~F.col("_before").rlike(P.lowercase_to_period(alphabet)), F.lit(" "))
    paged = renumber(paged)
    last = F.lag("text").over(_in_doc())
    paged = paged.withColumn("_last", last)
    across = (F.col("para") == 0) & (F.col("page") > 0) & ~F.col("_last").rlike(P.ENDS_WITH_PERIOD)
    return renumber(_join_islands(paged, _in_doc(), ["doc_id"], across, F.lit(" ")))


def drop_examples(rows: DataFrame) -> DataFrame:
    """Without paragraphs with a line that starts with a number in parentheses or a dash."""
    return renumber(rows.where(~F.col("text").rlike(P.EXAMPLE)))


def map_text(rows: DataFrame, *steps) -> DataFrame:
    """text through the steps, a projection each: the planner merges those that use their input once, and a step that
    uses it more often does not have it computed as often."""
    for step in steps:
        rows = rows.withColumn("text", step(F.col("text")))
    return rows


def split_sentences(rows: DataFrame) -> DataFrame:
    """Rows doc_id, page, para, sent, text."""
    return rows.select("doc_id", "page", "para", F.posexplode(T.sentences(F.col("text"))).alias("sent", "text"))


def drop_unwanted(rows: DataFrame, alphabet: str = "cyrillic") -> DataFrame:
    """C19."""
    return rows.where(T.wanted_sentence(F.col("text"), alphabet))


#: The checkpoints of C20, after each of which a document may turn out to be empty.
CHECKPOINTS = ("keywords", "footnotes", "quotations", "unwanted sentences")


def checkpoints(rows: DataFrame, alphabet: str = "cyrillic", headings: tuple[str, ...] | None = None, keywords: str = P.KEYWORD_HEADING, written: bool = False) -> list[DataFrame]:
    """C20: the paragraphs, at last the sentences, after each of CHECKPOINTS. The steps' order is part of the result.
    written: each is written and read by the next, so that a status of all of them runs no step twice."""
    held = keep if written else lambda rows, name: rows
    cut = cut_references(drop_blank(rows)) if headings is None else cut_from(drop_blank(rows), *headings)
    one = held(cut_through_keywords(renumber(cut), keywords), "keywords")
    two = held(renumber(cut_footnotes(drop_headers(one))), "footnotes")
    three = held(drop_blank(map_text(two, T.mask_quotes)), "quotations")
    rows = join_broken(map_text(dehyphenate(three), T.terminal_periods), alphabet)
    rows = drop_examples(map_text(rows, T.mask_styles))
    rows = map_text(rows, T.strip_brackets, T.strip_footnote_references, lambda t: T.mask_unknown(t, alphabet), T.mask_numbers)
    return [one, two, three, held(drop_unwanted(split_sentences(rows), alphabet), "sentences")]


def preprocess(rows: DataFrame, alphabet: str = "cyrillic", headings: tuple[str, ...] | None = None, keywords: str = P.KEYWORD_HEADING) -> DataFrame:
    """C20: paragraphs to clean sentences."""
    return checkpoints(rows, alphabet, headings, keywords)[-1]


def clean_subset(rows: DataFrame, alphabet: str = "cyrillic") -> DataFrame:
    """Paragraphs to sentences by C10, C8, C3, C15 to C19, without a document's first two paragraphs (title and
    journal) of those with a sentence; no mark after a space, no space before the final period."""
    rows = drop_blank(map_text(rows, T.terminal_periods, T.mask_quotes))
    rows = map_text(rows, T.strip_brackets, T.strip_footnote_references, lambda t: T.mask_unknown(t, alphabet), T.mask_numbers)
    rows = drop_unwanted(split_sentences(rows), alphabet)
    rows = rows.withColumn("_n", F.dense_rank().over(_in_doc())).where("_n > 2").drop("_n")
    return map_text(rows, lambda t: F.regexp_replace(t, P.LOOSE_MARK, ""), lambda t: F.regexp_replace(t, r"(?d) \.$", "."))


def removed(before: DataFrame, after: DataFrame) -> DataFrame:
    """doc_id, n_removed: how many rows of each document of before a step (C3, C6, C7, C19, ...) has left out."""
    count = lambda rows, name: rows.groupBy("doc_id").agg(F.count("*").alias(name))
    both = count(before, "_b").join(count(after, "_a"), "doc_id", "left")
    return both.select("doc_id", (F.col("_b") - F.coalesce("_a", F.lit(0))).alias("n_removed"))


def status(docs: DataFrame, rows: list[DataFrame]) -> DataFrame:
    """For every document of docs (doc_id) the number of sentences left, whether any is, and (emptied) after which of
    CHECKPOINTS none was; rows: checkpoints(). A count a document and checkpoint is all that is joined."""
    out = docs.select("doc_id").distinct()
    for k, at in enumerate(rows):
        out = out.join(at.groupBy("doc_id").agg(F.count("*").alias(f"_{k}")), "doc_id", "left")
    emptied = F.coalesce(*(F.when(F.col(f"_{k}").isNull(), F.lit(c)) for k, c in enumerate(CHECKPOINTS)))
    return out.select("doc_id", F.coalesce(f"_{len(rows) - 1}", F.lit(0)).alias("n_sentences"), emptied.isNull().alias("kept"), emptied.alias("emptied"))


def render(rows: DataFrame) -> DataFrame:
    """doc_id, text: a sentence a line, a blank line after each paragraph."""
    paragraphs = rows.groupBy("doc_id", "page", "para").agg(F.array_sort(F.collect_list(F.struct("sent", "text"))).alias("_s"))
    block = F.concat(F.array_join(F.transform("_s", lambda x: x["text"]), "\n"), F.lit("\n"))
    texts = paragraphs.withColumn("_b", block).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "para", "_b"))).alias("_p"))
    return texts.select("doc_id", F.array_join(F.transform("_p", lambda x: x["_b"]), "\n").alias("text"))
