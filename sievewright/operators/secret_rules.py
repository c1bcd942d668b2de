"""Eight rules for credentials in text, and a gate over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The rules; the token rule takes either quote.
RULES = {
    "api_key": r"[Aa][Pp][Ii][-_]?[Kk][Ee][Yy]\s*[:=]",
    "secret_key": r"[Ss][Ee][Cc][Rr][Ee][Tt][-_]?[Kk][Ee][Yy]\s*[:=]",
    "password": r"[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]\s*[:=]",
    "token": r"""[Tt][Oo][Kk][Ee][Nn]\s*[:=]\s*["'][A-Za-z0-9]""",
    "private_key": r"[Pp][Rr][Ii][Vv][Aa][Tt][Ee][-_]?[Kk][Ee][Yy]",
    "sk": r"sk-[A-Za-z0-9]{20,}",
    "ghp": r"ghp_[A-Za-z0-9]{36,}",
    "xoxb": r"xoxb-[0-9]",
}


def hits(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, rule for every rule that a text meets."""
    met = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), name) for name, p in RULES.items()]))
    return docs.select(key, F.explode(met).alias("rule"))


def gate(docs: DataFrame) -> DataFrame:
    """docs_hit, blocked: one row."""
    return hits(docs).agg(F.countDistinct("doc_id").alias("docs_hit")).withColumn("blocked", F.col("docs_hit") > 0)
