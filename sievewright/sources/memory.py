"""Memory tables apart by chat, and the findings of search rounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievewright.operators.lineage import cut


def write_memory(rows: DataFrame, path: str) -> None:
    """Append rows (chat_id, ...) to the memory table, a folder a chat."""
    rows.write.mode("append").partitionBy("chat_id").parquet(path)


def read_memory(spark: SparkSession, path: str, chat_id: str) -> DataFrame:
    """One chat's rows; other chats' folders are not read."""
    return spark.read.parquet(path).where(F.col("chat_id") == chat_id)


def merge_rounds(rounds: list[DataFrame], key: str) -> DataFrame:
    """The findings of all rounds (round, key, ...), each key from the first round that found it; columns may differ."""
    every = rounds[0]
    for r in rounds[1:]:
        every = every.unionByName(r, allowMissingColumns=True)
    first = Window.partitionBy(key).orderBy("round")
    return every.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def until_settled(start: DataFrame, find: Callable[[DataFrame, int], DataFrame], key: str, least: int = 3, most: int = 20) -> DataFrame:
    """round and what each round found new: find(frontier, round) is asked again with the news until there is none.

    At least `least` rounds are made while there is anything to ask with, at most `most`.
    """
    known = frontier = cut(start.withColumn("round", F.lit(0)))
    for r in range(1, most + 1):
        found = find(frontier, r).dropDuplicates([key]).join(known.select(key), key, "left_anti")
        news = cut(found.withColumn("round", F.lit(r)).select(known.columns))
        nothing = news.isEmpty()
        if nothing and r >= least:
            break
        known = known.unionByName(news)
        frontier = frontier if nothing else news
    return known
