"""Runs that go deeper as long as it pays: many at once, a depth a round, each depth one commit.

A run asks its seeds at depth 0. What a search finds is facts and open
questions; at each following depth a run asks as many of its open questions,
best first, as the breadth of that depth allows. The stop rule is asked for
each run behind each depth. All that a depth brings, for all runs, is one
commit of a versioned table, so a driver that dies loses at most the depth
that it was in: called again with the same table, research() goes on behind
the last commit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions.planning import DECAY, decision
from sievewright.operators.lineage import cut, release
from sievewright.sources.versions import VersionedTable

#: kind: query, fact, question or decision (of which text says what). seq orders a run's questions.
SCHEMA = "run_id string, depth int, kind string, seq long, text string, priority string"


def urgency(priority: Column) -> Column:
    """high before medium (and unknown) before low."""
    return F.when(priority == "high", 0).when(priority == "low", 2).otherwise(1)


def open_questions(log: DataFrame) -> DataFrame:
    """run_id, seq, text, priority of questions that no query has used."""
    asked = log.where("kind = 'query'").select("run_id", "seq")
    return log.where("kind = 'question'").select("run_id", "seq", "text", "priority").join(asked, ["run_id", "seq"], "left_anti")


def _first_of_each(questions: DataFrame, many: int) -> DataFrame:
    """The `many` best questions of each run; more than that many never come together from one task."""
    order = Window.partitionBy("run_id").orderBy(urgency(F.col("priority")), "seq")
    return questions.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= many).drop("_r")


def _decided(log: DataFrame, depth: int, max_depth: int) -> DataFrame:
    """run_id and what the stop rule says of each run that was asked at this depth."""
    runs = log.where((F.col("kind") == "query") & (F.col("depth") == depth)).select("run_id").distinct()
    n = lambda d: F.count_if((F.col("kind") == "fact") & (F.col("depth") == d))
    counts = log.groupBy("run_id").agg(n(depth).alias("now"), n(depth - 1).alias("before"))
    left = open_questions(log).groupBy("run_id").agg(F.count(F.lit(1)).alias("unused"))
    told = runs.join(counts, "run_id").join(left, "run_id", "left")
    return told.select("run_id", decision(F.lit(depth), F.lit(max_depth), F.coalesce("unused", F.lit(0)), F.col("now"), F.col("before")).alias("text"))


def research(table: VersionedTable, seeds: DataFrame, search: Callable[[DataFrame, int], DataFrame], max_depth: int = 3, base_breadth: int = 4) -> DataFrame:
    """The log (SCHEMA) of all runs, begun with seeds (run_id, seq, text) or taken up where the table ends.

    search(queries, depth) gets run_id, seq, text and returns run_id, kind
    (fact or question), seq, text, priority. A question that a run has
    already counts once.
    """
    last = table.read().agg(F.max("depth").alias("d")).first()["d"]
    for depth in range(0 if last is None else last + 1, max_depth + 1):
        log = table.read()
        if depth == 0:
            asked = seeds.select("run_id", "seq", "text", F.lit(None).cast("string").alias("priority"))
        else:
            going = log.where((F.col("kind") == "decision") & (F.col("depth") == depth - 1) & (F.col("text") == "continue")).select("run_id")
            asked = _first_of_each(open_questions(log).join(going, "run_id", "left_semi"), breadth_at(base_breadth, depth))
        asked = cut(asked)
        if asked.isEmpty():
            release(asked)
            break
        found = search(asked.select("run_id", "seq", "text"), depth).dropDuplicates(["run_id", "kind", "seq"])
        known = log.where("kind = 'question'").select("run_id", "kind", "seq").unionByName(asked.select("run_id", F.lit("question").alias("kind"), "seq"))
        found = found.join(known, ["run_id", "kind", "seq"], "left_anti")
        at = F.lit(depth).alias("depth")
        news = cut(asked.select("run_id", at, F.lit("query").alias("kind"), "seq", "text", "priority").unionByName(found.select("run_id", at, "kind", "seq", "text", "priority")))
        verdict = _decided(log.unionByName(news), depth, max_depth)
        none = F.lit(None)
        table.append(news.unionByName(verdict.select("run_id", at, F.lit("decision").alias("kind"), none.cast("long").alias("seq"), "text", none.cast("string").alias("priority"))))
        release(asked, news)
    return table.read()


def breadth_at(base: int, depth: int) -> int:
    """planning.breadth() of one depth, as a number."""
    return max(2, int(base * DECAY**depth))


def by_depth(log: DataFrame) -> DataFrame:
    """run_id, depth, queries, facts, questions, decision: a row for each depth that a run was asked at."""
    n = lambda kind: F.count_if(F.col("kind") == kind)
    said = F.max(F.when(F.col("kind") == "decision", F.col("text")))
    return log.groupBy("run_id", "depth").agg(n("query").alias("queries"), n("fact").alias("facts"), n("question").alias("questions"), said.alias("decision"))
