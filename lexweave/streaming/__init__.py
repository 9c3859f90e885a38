"""The steps on one row at a time, over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.operators import plain


def read_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def clean_stream(docs: DataFrame, alphabet: str = "cyrillic") -> DataFrame:
    """Articles (doc_id, text) to clean sentences as they arrive; there is no state to keep."""
    return plain.clean_articles(docs, alphabet)


def count_words(tokens: DataFrame, time: str = "ts", late: str = "10 minutes", every: str = "5 minutes") -> DataFrame:
    """Word counts by window of event time; rows later than late are dropped with the state of their window."""
    return tokens.withWatermark(time, late).groupBy(F.window(time, every), "word").agg(F.count("*").alias("n"))


def write_stream(rows: DataFrame, path: str, checkpoint: str, once: bool = True):
    writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
