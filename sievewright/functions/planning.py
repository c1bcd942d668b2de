"""Planning arithmetic, scores and tiers as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The modes of a run.
MODES = [
    ("quick", 1, 3, ["SCOPE", "SEARCH", "SYNTHESIZE"], 5, "2000-4000"),
    ("standard", 3, 4, ["SCOPE", "PLAN", "SEARCH", "ANALYZE", "SYNTHESIZE"], 10, "4000-8000"),
    ("deep", 5, 5, ["SCOPE", "PLAN", "SEARCH", "ANALYZE", "CRITIQUE", "SYNTHESIZE", "VALIDATE"], 15, "8000-15000"),
]
# Weights of the five scores, and tiers by the kind of a finding.
WEIGHTS = {"impact": 0.3, "novelty": 0.25, "credibility": 0.2, "timeliness": 0.15, "relevance": 0.1}
DECAY, LEAST_GAIN = 0.7, 0.2
DEFAULT_MODE = "standard"


def modes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODES, "mode string, max_depth int, base_breadth int, phases array<string>, min_sources int, target_words string")


def with_mode(rows: DataFrame, mode: str, default: str = DEFAULT_MODE) -> DataFrame:
    """rows with the settings of the mode that a column names; unknown and null names get the default's."""
    known = modes(rows.sparkSession)
    named = F.when(F.col(mode).isin([m[0] for m in MODES]), F.col(mode)).otherwise(default)
    return rows.withColumn(mode, named).join(F.broadcast(known.withColumnRenamed("mode", mode)), mode)


def breadth(base: Column, depth: Column) -> Column:
    """max(2, int(base * 0.7 ** depth))."""
    return F.greatest(F.lit(2), F.floor(base * F.pow(F.lit(DECAY), depth)).cast("int"))


def agents(breadth_: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(breadth_ / 2).cast("int"))


def queries_per_agent(breadth_: Column) -> Column:
    return F.greatest(F.lit(2), F.ceil(breadth_ / agents(breadth_)).cast("int"))


def with_settings(rows: DataFrame, mode: str, depth: str, breadth_: str) -> DataFrame:
    """rows with the settings of their mode, and depth and breadth as asked for, by the mode where that is 0 or null."""
    named = with_mode(rows, mode)
    return named.withColumns({depth: or_mode(F.col(depth), F.col("max_depth")), breadth_: or_mode(F.col(breadth_), F.col("base_breadth"))})


def or_mode(given: Column, of_mode: Column) -> Column:
    """0 and null mean the mode's own value."""
    return F.coalesce(F.nullif(given, F.lit(0)), of_mode)


def decision(depth: Column, max_depth: Column, unused: Column, now: Column, before: Column) -> Column:
    """max_depth_reached, no_followups, diminishing_returns or continue, by the first that holds."""
    return (
        F.when(depth >= max_depth, "max_depth_reached")
        .when((depth > 0) & (unused == 0), "no_followups")
        .when((depth > 0) & (before > 0) & (now / before < LEAST_GAIN), "diminishing_returns")
        .otherwise("continue")
    )


def total_score(impact: Column, novelty: Column, credibility: Column, timeliness: Column, relevance: Column) -> Column:
    scores = dict(zip(WEIGHTS, (impact, novelty, credibility, timeliness, relevance)))
    return reduce(lambda x, y: x + y, (weight * scores[name] for name, weight in WEIGHTS.items()))


def timeliness(day: Column, today: Column) -> Column:
    """5 today, 4 yesterday, 3 within 7 days, 2 within 30, else 1."""
    age = F.datediff(today, day)
    return F.when(age <= 0, 5).when(age == 1, 4).when(age <= 7, 3).when(age <= 30, 2).otherwise(1)


# The tier of each kind of finding.
TIERS = {"breakthrough": "Breakthroughs", "release": "Releases", "research": "Research", "opinion": "Industry & Opinions", "signal": "Trend Signals"}


def tier(kind: Column, total: Column) -> Column:
    """A finding's nature names its tier, the total only ranks it; under 2, or of another kind, it is Unclassified."""
    named = F.lit("Unclassified")
    for k, name in TIERS.items():
        named = F.when(kind == k, name).otherwise(named)
    return F.when(total < 2, "Unclassified").otherwise(named)
