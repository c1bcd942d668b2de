"""The driver's tables as the engine's records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as facts: seq = id = doc_id, depth_level = doc_id % 4, source_url of page doc_id % pages."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    n = pages.agg(F.count(F.lit(1)).alias("n_pages"))
    rows = docs.crossJoin(F.broadcast(n)).select(F.col("doc_id").alias("seq"), F.col("doc_id").alias("id"), "text", F.col("source").alias("source_title"), (F.col("doc_id") % 4).cast("int").alias("depth_level"), (F.col("doc_id") % F.col("n_pages")).alias("page_id"))
    return rows.join(pages.select("page_id", F.col("url").alias("source_url")), "page_id", "left").drop("page_id")


def bare_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, id and text alone, without the join for URLs."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.col("doc_id").alias("id"), "text")


def queries_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as queries; seq orders them by conversation and turn."""
    rows = table(spark, sf_dir, "conversations").where("role = 'user'")
    return rows.select((F.col("conv_id") * 10_000 + F.col("turn")).alias("seq"), "text")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("post_id"), F.col("user_id").cast("string").alias("author"), F.col("event_type").alias("kind"), F.col("ts").alias("created"), F.col("value").alias("engagement"), F.col("props").alias("text"))
