"""Files in, files out. All readers are lazy; folders are listed by Spark, so any file system it knows will do."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions.text import slug
from lexweave.operators.audit import stem
from lexweave.operators.tokens import usable_tokens
from lexweave.sources.scratch import exists


def read_wide(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table. Where its files have fewer row groups than there are cores, its rows are dealt to as many tasks
    as cores, so that a few large row groups do not keep the others waiting; larger tables are read as they lie."""
    df, cores = spark.read.parquet(path), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


def list_files(spark: SparkSession, root: str, extension: str) -> DataFrame:
    """Path, modificationTime, length of the files below root that end with extension; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{extension}").load(root)
    return found.select("path", "modificationTime", "length")


def read_texts(spark: SparkSession, root: str, extension: str = ".html", column: str = "html") -> DataFrame:
    """doc_id (the name), field (the folder), path and the whole text of each file."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{extension}").text(root, wholetext=True)
    path = F.col("_metadata.file_path")
    return raw.select(stem(path).alias("doc_id"), F.regexp_extract(path, "([^/]+)/[^/]+$", 1).alias("field"), path.alias("path"), F.col("value").alias(column))


def read_fields(spark: SparkSession, root: str, fields: list[str], extension: str = ".html", column: str = "html") -> DataFrame:
    """read_texts() of a folder for each field. The field of a branch is a constant, so a filter on it leaves the
    other folders unread."""
    parts = [read_texts(spark, f"{root}/{f}", extension, column).withColumn("field", F.lit(f)) for f in fields]
    return reduce(DataFrame.unionByName, parts)


def write_by_field(docs: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet in a folder field=... for each field, which readers prune by."""
    docs.write.mode(mode).partitionBy("field").parquet(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, text: a row a line, without its end."""
    return spark.read.text(path).select(stem(F.col("_metadata.file_path")).alias("doc_id"), F.col("value").alias("text"))


def read_zip_members(spark: SparkSession, path: str, lines: bool = False, most: int = 64 << 20) -> DataFrame:
    """As read_zips(), for large archives: their members are dealt to tasks by ranges of most bytes (zips.read_members())."""
    from lexweave.sources.zips import read_members

    text = F.make_valid_utf8(F.col("content").cast("string"))
    if lines:
        stripped = F.filter(F.transform(F.split(text, r"\r\n|[\n\r\x0b\f\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
        text = F.array_join(F.transform(stripped, lambda x: F.concat(F.lit(" "), x)), "")
    return read_members(spark, path, most).select("archive", "member", text.alias("text"))


def read_zips(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Archive, member, text of the text files in zip archives: whole, or (lines) with the stripped non-empty lines
    each after a space. An archive is read by one task, its members one after the other."""

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for member in archive.namelist():
                        if member.endswith("/"):
                            continue
                        text = archive.read(member).decode("utf-8", "replace")
                        if lines:
                            text = "".join(" " + x.strip() for x in text.splitlines() if x.strip())
                        yield pd.DataFrame([(name, member, text)], columns=["archive", "member", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unzip, "archive string, member string, text string")


def read_csv(spark: SparkSession, path: str, schema: str | None = None, separator: str = ",") -> DataFrame:
    """With a header; a schema saves the pass that infers one."""
    reader = spark.read.option("header", True).option("sep", separator).option("quote", '"').option("escape", '"')
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_ngrams(spark: SparkSession, path: str) -> DataFrame:
    """Ngram, freq, line (its place in the files) of tab-separated lines."""
    f = F.split("value", "\t")
    return spark.read.text(path).select(f[0].alias("ngram"), f[1].alias("freq"), F.monotonically_increasing_id().alias("line"))


def read_table(spark: SparkSession, path: str | None = None, jdbc: dict[str, str] | None = None) -> DataFrame:
    """A Parquet table, or one of a database by JDBC options (url, dbtable, partitionColumn, ...)."""
    return spark.read.format("jdbc").options(**jdbc).load() if jdbc else spark.read.parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Word, vec of a text format: a word and its numbers a line, after a header of two numbers (word2vec, subword
    vectors) or without one (GloVe)."""
    parts = F.split(F.rtrim("value"), " ")
    rows = spark.read.text(path).where(F.size(parts) > 2)
    return rows.select(parts[0].alias("word"), F.transform(F.slice(parts, 2, F.size(parts) - 1), lambda x: x.cast("float")).alias("vec"))


def write_vectors(vectors: DataFrame, path: str) -> None:
    vectors.select(F.concat_ws(" ", "word", F.array_join(F.transform("vec", lambda x: x.cast("string")), " "))).write.text(path)


def read_binary_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Word, vec of the word2vec binary format: a header line, then for each word the word, a space and its numbers
    as little-endian 32-bit floats. A file is read by one task."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                at = content.index(b"\n") + 1
                n, size = map(int, content[:at].split())
                words, vecs = [], []
                for _ in range(n):
                    end = content.index(b" ", at)
                    words.append(content[at:end].strip().decode("utf-8", "replace"))
                    vecs.append(np.frombuffer(content, "<f4", size, end + 1).tolist())
                    at = end + 1 + 4 * size
                yield pd.DataFrame({"word": words, "vec": vecs})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "word string, vec array<float>")


def synonyms_of_pages(pages: DataFrame, anchor: str = "F_SYN") -> DataFrame:
    """Word, synonym of saved dictionary pages (word, html): the text of the first link of each list item between
    the anchor of that name and the next named anchor, each once, the word itself left out. Pages are not fetched."""
    rest = F.regexp_extract("html", rf"(?is)<a\b[^>]*\bname=[\"']?{anchor}\b[^>]*>(.*)", 1)
    section = F.split(rest, r"(?i)<a\b[^>]*\bname=", 2)[0]
    links = F.regexp_extract_all(section, F.lit(r"(?is)<li\b[^>]*>(?:(?!<li\b).)*?<a\b[^>]*>(.*?)</a>"), F.lit(1))
    plain = F.trim(F.regexp_replace(F.col("link"), r"(?s)<[^>]*>", ""))
    return pages.select("word", F.explode(links).alias("link")).select("word", plain.alias("synonym")).where("synonym <> '' and synonym <> word").distinct()


def usable_sentences(pages: Column) -> Column:
    """The sentences (arrays of lemma_POS tokens) of a document of nested pages, paragraphs and sentences, with the
    usable tokens only; sentences without any are left out."""
    usable = F.transform(F.flatten(F.flatten(pages)), lambda s: usable_tokens(F.array_join(s, " ")))
    return F.filter(usable, lambda s: F.size(s) > 0)


def token_sentences(corpus: DataFrame, column: str = "pages") -> DataFrame:
    """A row a sentence of a saved corpus."""
    return corpus.select(F.explode(usable_sentences(F.col(column))).alias("sentence"))


def convert(spark: SparkSession, path: str, make: Callable[[], Callable[[bytes], str]], extension: str = ".pdf") -> DataFrame:
    """Path, text, error of files by a converter of one's own (PDF to text or HTML), loaded once a worker.
    A file of another extension, and one that the converter fails on, has an error and no text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = make()
        for batch in batches:
            out = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    out.append((name, one(content), None) if name.endswith(extension) else (name, None, f"not {extension}"))
                except Exception as e:  # a broken file is a result, not the end of the job
                    out.append((name, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(out, columns=["path", "text", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(run, "path string, text string, error string")


def write_texts(docs: DataFrame, path: str, mode: str = "skip", files: bool = False) -> None:
    """doc_id, text, added to a Parquet table; skip leaves out documents whose doc_id the table has, append
    does not. files: a folder of text a document instead, named by its slug (of few documents: each is a file)."""
    spark, name = docs.sparkSession, slug(F.col("doc_id").cast("string"))
    docs = docs.select(name.alias("doc"), "text") if files else docs.select("doc_id", "text")
    if mode == "skip" and exists(spark, path):
        if files:
            there = list_files(spark, path, ".txt").select(F.regexp_extract("path", "/doc=([^/]+)/", 1).alias("doc")).distinct()
        else:
            there = spark.read.schema(docs.schema).parquet(path).select("doc_id")
        docs = docs.join(there, docs.columns[0], "left_anti")
    writer = docs.write.mode("append")
    writer.partitionBy("doc").text(path) if files else writer.parquet(path)


def write_results(results: DataFrame, path: str, key: str = "original") -> None:
    """A folder of CSV files for each value of key, in place of those of the same values that were there."""
    writer = results.withColumn("_key", slug(F.col(key))).repartition("_key").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.option("header", True).option("escape", '"').partitionBy("_key").csv(path)


def write_csv(rows: DataFrame, path: str, separator: str = ",", mode: str = "append") -> None:
    """Quoted where needed, with a header."""
    rows.write.mode(mode).option("header", True).option("sep", separator).option("escape", '"').csv(path)


def head(rows: DataFrame, n: int = 20) -> list:
    """The first n rows, for printing."""
    return rows.limit(n).collect()
