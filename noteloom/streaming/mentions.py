"""Mentions of arriving notes, counted as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.functions.text import TOKEN, SENTENCE_BOUNDARY


def arriving_documents(spark: SparkSession, folder: str, schema: str = "doc_id bigint, lang string, text string, received_at timestamp") -> DataFrame:
    """New Parquet files of documents in a folder, as a stream."""
    return spark.readStream.schema(schema).parquet(folder)


def token_counts(documents: DataFrame, window: str = "1 day", late_by: str = "60 days") -> DataFrame:
    """Tokens by language and window of receipt, final once the watermark has passed: rows that come later than
    ``late_by`` behind the newest are dropped by the watermark, all others are counted."""
    words = documents.withWatermark("received_at", late_by).select(
        "received_at", F.coalesce("lang", F.lit("und")).alias("language"),
        F.explode(F.flatten(F.transform(F.split("text", SENTENCE_BOUNDARY, -1), lambda s: F.regexp_extract_all(s, F.lit(TOKEN), F.lit(0))))).alias("token"),
    )
    return words.groupBy(F.window("received_at", window).alias("w"), "language", F.lower("token").alias("token")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "language", "token", "n")
