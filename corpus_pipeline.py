"""The corpus pipeline: quality classifier, line deduplication, n-gram Jaccard join, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; all but the last return the
columns of documents. Null, empty and repeated rows: as each stage's operator defines."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import quality
from lexweave.llm.common import fresh, materialize
from lexweave.llm.linededup import line_dedup
from lexweave.llm.ngramjoin import ngram_join
from lexweave.llm.packing import pack
from lexweave.llm.queries import quality_weights
from lexweave.sources.files import read_wide


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. It is fitted on labelled documents outside the held-out fold, on
    8,192 of them at most (quality.fit's max_rows)."""
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet")
    weights = quality_weights(whole, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(quality.score(F.col("text"), weights) >= 0.7)


def line_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without cross-site boilerplate lines, compared without white space around them; n_chars follows the
    text. A document without a line of its own stays whole: it may be a copy, which the next stage judges."""
    names = tuple(fresh(docs, c) for c in ("n_lines", "n_removed", "exempt"))
    clean = line_dedup(docs, keep_whole=True, names=names)
    return clean.withColumn("n_chars", F.when(F.col(names[1]) > 0, F.length("text")).otherwise(F.col("n_chars"))).select(docs.columns)


def near_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of linked documents: that with the smallest doc_id, a row with an id before one without.
    Rows are told apart by doc_id and text, so neither a null nor a repeated doc_id keeps a copy. Rows without a word
    are no copies of each other, and stay."""
    key, row = fresh(docs, "key"), fresh(docs, "row")
    named = docs.withColumn(key, F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b")))
    found = ngram_join(named, key)
    heads = found.where(F.col(key) == F.col("class_id")).groupBy(F.col(key).alias("key")).agg(F.count("*").alias("rows"), F.first(F.col("n_shingles") > 0).alias("worded"))
    heads = materialize(heads.select(F.struct("key", ((F.col("rows") > 1) & F.col("worded")).alias("repeated")).alias(row)), "heads")
    kept = named.join(heads, named[key] == heads[row]["key"])
    # Of rows with one doc_id and text, which are few, one stays; only these are shuffled once more.
    once = kept.where(F.col(row)["repeated"]).dropDuplicates([key])
    return once.unionByName(kept.where(~F.col(row)["repeated"])).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' pieces in sequences of at most 1024 tokens, as op2_packing returns them."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), digest=True)


STAGES = [("quality", classified), ("lines", line_deduplicated), ("near", near_deduplicated), ("packing", packed)]
#: The classifier and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_wide(spark, f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
