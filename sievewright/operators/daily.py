"""The daily report: all of its tables from one scan, by grouping sets.

Findings have id, created, tier, topic, source, author, link and total. A
level is a table of the report: tier, topic, source, author, and all for the
figures of the whole. A key that a third of all findings share is counted in
every task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievewright.operators.lineage import cut

LEVELS = ("tier", "topic", "source", "author")


def levels(findings: DataFrame, since: str) -> DataFrame:
    """level, key, n, n_before, n_now, items, dedup_rate, share, top_id, top_total, heat.

    n_now counts findings from `since` on, items different links; dedup_rate
    is the share of findings that repeat a link, share that of all findings,
    top_id the best finding (the first of equals). heat compares the periods:
    new, gone, rising or falling by a quarter, else stable.
    """
    rows = findings.select("id", *LEVELS, "link", "total", (F.col("created") >= F.lit(since).cast("timestamp")).alias("now"))
    one = F.count(F.lit(1))
    sums = [one.alias("n"), F.count_if(~F.col("now")).alias("n_before"), F.count_if("now").alias("n_now"), F.count_distinct("link").alias("items"), F.max(F.struct("total", (-F.col("id")).alias("before"))).alias("top"), F.grouping_id().alias("gid")]
    counted = cut(rows.groupingSets([*([F.col(c)] for c in LEVELS), []], *(F.col(c) for c in LEVELS)).agg(*sums))
    # of the bits of grouping_id, the first column has the highest; a clear bit says that the row is grouped by it
    every = (1 << len(LEVELS)) - 1
    level, key = F.lit("all"), F.lit(None).cast("string")
    for k, c in enumerate(LEVELS):
        mine = F.col("gid") == every - (1 << len(LEVELS) - 1 - k)
        level, key = F.when(mine, c).otherwise(level), F.when(mine, F.col(c).cast("string")).otherwise(key)
    whole = counted.where(F.col("gid") == every).select(F.col("n").alias("whole"))  # one row
    before, now = F.col("n_before"), F.col("n_now")
    heat = F.when(before == 0, "new").when(now == 0, "gone").when(4 * now >= 5 * before, "rising").when(4 * now <= 3 * before, "falling").otherwise("stable")
    out = counted.crossJoin(F.broadcast(whole))
    return out.where("n > 0").select(level.alias("level"), key.alias("key"), "n", "n_before", "n_now", "items", ((F.col("n") - F.col("items")) / F.col("n")).alias("dedup_rate"), (F.col("n") / F.col("whole")).alias("share"), (-F.col("top.before")).alias("top_id"), F.col("top.total").alias("top_total"), heat.alias("heat"))


#: The report's tables: title, head of the table, level, and how many rows are shown.
TABLES = (
    ("Highlights by tier", "| Tier | Findings | Best | Score |", "tier", 10),
    ("Topics", "| Topic | Findings | Before | Heat |", "topic", 20),
    ("Followed accounts", "| Account | New posts | Best post |", "author", 20),
    ("Coverage", "| Source | Findings | Share |", "source", 20),
    ("Repeats", "| Findings | Different | Repeated |", "all", 1),
)


def lines(told: DataFrame, day: str) -> DataFrame:
    """part, ord, line of the report of a day from levels(): in each table the largest first, equals by key."""
    spark, text = told.sparkSession, lambda c: F.col(c).cast("string")
    percent = lambda c: F.concat(F.format_number(100 * F.col(c), 1), F.lit("%"))
    cells = {
        "tier": ["key", text("n"), text("top_id"), F.format_number("top_total", 2)], "topic": ["key", text("n_now"), text("n_before"), F.col("heat")],
        "author": ["key", text("n_now"), text("top_id")], "source": ["key", text("n"), percent("share")], "all": [text("n"), text("items"), percent("dedup_rate")],
    }
    heads = [(0, 0, f"# Daily report {day}")]
    out = None
    for part, (title, head, level, most) in enumerate(TABLES, start=1):
        heads += [(part, 0, f"## {title}"), (part, 1, head), (part, 2, "|" + "---|" * (head.count("|") - 1))]
        named = [F.coalesce(F.col(c), F.lit("-")) if isinstance(c, str) else c for c in cells[level]]
        by = [F.desc("n_now" if level in ("topic", "author") else "n"), "key"]
        best = told.where(F.col("level") == level).orderBy(*by).limit(most)  # no more rows than are shown are put in order
        row = F.concat(F.lit("| "), F.concat_ws(" | ", *named), F.lit(" |"))
        body = best.select(F.lit(part).alias("part"), (F.row_number().over(Window.orderBy(*by)) + 2).alias("ord"), row.alias("line"))
        out = body if out is None else out.unionByName(body)
    return spark.createDataFrame(heads, "part int, ord int, line string").unionByName(out)
