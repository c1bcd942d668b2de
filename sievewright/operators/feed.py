"""Posts and findings: a search language, scores, history and period comparisons."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.operators.numbering import running

_TOKEN = re.compile(r'\s*(\(|\)|-?"[^"]*"|[^\s()]+)')


def parse(query: str) -> tuple:
    """The tree of a search text: ("and", ...), ("or", ...), ("not", x) and ("term", token)."""
    tokens = _TOKEN.findall(query)
    at = 0

    def either() -> tuple:
        nonlocal at
        parts = [both()]
        while at < len(tokens) and tokens[at] == "OR":
            at += 1
            parts.append(both())
        return parts[0] if len(parts) == 1 else ("or", *parts)

    def both() -> tuple:
        nonlocal at
        parts: list[tuple] = []
        while at < len(tokens) and tokens[at] not in ("OR", ")"):
            token = tokens[at]
            at += 1
            if token == "(":
                parts.append(either())
                if at >= len(tokens):
                    raise ValueError("a bracket is not closed")
                at += 1
            elif token.startswith("-") and len(token) > 1:
                parts.append(("not", ("term", token[1:])))
            else:
                parts.append(("term", token))
        return parts[0] if len(parts) == 1 else ("and", *parts)

    found = either()
    if at < len(tokens):
        raise ValueError("a bracket is closed that was not opened")
    return found


def search(query: str) -> Column:
    """A predicate over posts from a search text.

    Words and "phrases" are looked for in text without regard to case; -x
    excludes; OR and brackets compose, side by side means and. Operators:
    from: to: list: lang: since: (inclusive) until: (exclusive) filter:KIND
    (a boolean column has_KIND or is_KIND) min_retweets: min_faves:
    min_replies:, #tag, $TICKER and @name.
    """
    return column(parse(query))


def column(node: tuple) -> Column:
    """The predicate of a tree that parse() gave."""
    if node[0] == "term":
        return _term(node[1])
    if node[0] == "not":
        return ~F.coalesce(column(node[1]), F.lit(False))
    out = F.lit(node[0] == "and")
    for part in map(column, node[1:]):
        out = out & part if node[0] == "and" else out | part
    return out


_NAMES = ("from", "to", "list", "lang", "since", "until", "filter", "min_retweets", "min_faves", "min_replies")


def is_operator(token: str) -> bool:
    """Whether a term asks for something else than words of the text."""
    name, colon, value = token.partition(":")
    return bool(colon and value and name in _NAMES) or (token[0] in "#$@" and len(token) > 1)


_KINDS = {"links": "has_links", "images": "has_images", "videos": "has_videos", "media": "has_media", "replies": "is_reply", "nativeretweets": "is_retweet", "retweets": "is_retweet"}


def _term(token: str) -> Column:
    name, colon, value = token.partition(":")
    if colon and value and not token.startswith('"'):
        if name in ("from", "to"):
            return F.lower({"from": "author", "to": "reply_to"}[name]) == value.lower()
        if name == "list":
            return F.array_contains("lists", value)
        if name == "lang":
            return F.col("lang") == value
        if name == "since":
            return F.col("created") >= F.to_timestamp(F.lit(value))
        if name == "until":
            return F.col("created") < F.to_timestamp(F.lit(value))
        if name == "filter" and value in _KINDS:
            return F.col(_KINDS[value])
        if name in ("min_retweets", "min_faves", "min_replies"):
            return F.col({"min_retweets": "retweets", "min_faves": "likes", "min_replies": "replies"}[name]) >= int(value)
    if token[0] in "#$@" and len(token) > 1:
        return F.col("text").rlike("(?i)(^|[^\\p{L}\\p{N}_])" + re.escape(token) + "([^\\p{L}\\p{N}_]|$)")
    return F.contains(F.lower("text"), F.lit(token.strip('"').lower()))


def latest(posts: DataFrame, n: int = 20) -> DataFrame:
    return posts.orderBy(F.desc("created"), "post_id").limit(n)


def top(posts: DataFrame, n: int = 20) -> DataFrame:
    return posts.orderBy(F.desc("engagement"), "post_id").limit(n)


def new_items(found: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """What history does not hold."""
    return found.join(history.select(key).distinct(), key, "left_anti")


def period_change(before: DataFrame, now: DataFrame, topic: str) -> DataFrame:
    """topic, n_before, n_now, change: new, gone, hotter, cooler or same."""
    x = before.groupBy(topic).agg(F.count(F.lit(1)).alias("n_before"))
    y = now.groupBy(topic).agg(F.count(F.lit(1)).alias("n_now"))
    both = x.join(y, topic, "full_outer").select(topic, F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("n_now", F.lit(0)).alias("n_now"))
    change = F.when(F.col("n_before") == 0, "new").when(F.col("n_now") == 0, "gone").when(F.col("n_now") > F.col("n_before"), "hotter").when(F.col("n_now") < F.col("n_before"), "cooler").otherwise("same")
    return both.withColumn("change", change)


def heat(before: DataFrame, now: DataFrame, topic: str) -> DataFrame:
    """topic, n_before, n_now, heat: rising or falling by a quarter or more, else high (at least the mean now) or stable."""
    both = period_change(before, now, topic).drop("change")
    mean = both.agg(F.avg("n_now").alias("_mean"))  # one row
    level = F.when(4 * F.col("n_now") >= 5 * F.col("n_before"), "rising").when(4 * F.col("n_now") <= 3 * F.col("n_before"), "falling").when(F.col("n_now") >= F.col("_mean"), "high").otherwise("stable")
    return both.crossJoin(F.broadcast(mean)).withColumn("heat", level).drop("_mean")


def accounts_by_level(levels: list[DataFrame], account: str = "account") -> DataFrame:
    """account and level (from 1) of the accounts of several lists, each by the first list that has it."""
    every = None
    for k, rows in enumerate(levels, start=1):
        own = rows.select(account, F.lit(k).alias("level"))
        every = own if every is None else every.unionByName(own)
    return every.where(F.col(account).isNotNull()).groupBy(account).agg(F.min("level").alias("level"))


def shares(rows: DataFrame, category: str) -> DataFrame:
    """category, n, share of all rows."""
    counts = rows.groupBy(category).agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(counts.agg(F.sum("n").alias("every"))).select(category, "n", (F.col("n") / F.col("every")).alias("share"))


def digest(posts: DataFrame) -> DataFrame:
    """author, n, top_post: the post with most engagement, the first of equals."""
    best = F.max(F.struct(F.col("engagement"), (-F.col("post_id")).alias("before")))
    return posts.groupBy("author").agg(F.count(F.lit(1)).alias("n"), best.alias("best")).select("author", "n", (-F.col("best.before")).alias("top_post"))


def shared_by(rows: DataFrame, item: str, author: str, least: int = 2) -> DataFrame:
    """item, authors: what `least` different authors name."""
    return rows.groupBy(item).agg(F.countDistinct(author).alias("authors")).where(F.col("authors") >= least)


def pruned(history: DataFrame, group: str, order: list[Column], keep: int = 200) -> DataFrame:
    """The newest `keep` records of each group."""
    return history.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_r") <= keep).drop("_r")


def ranked(findings: DataFrame, id_: str = "id") -> DataFrame:
    """findings with rank_in_tier by total, equals sharing a rank.

    Totals are counted by tier and the counts summed up in order, range by
    range, so no task holds a whole tier.
    """
    counts = findings.groupBy("tier", "total").agg(F.count(F.lit(1)).alias("_n"))
    upto = running(counts.withColumn("_less", -F.col("total")), "tier", ["_less"], "_n", "_upto")
    # a total that very many share has one row here: Spark splits the other side of the join where it is skewed
    ranks = upto.select(F.col("tier").alias("_tier"), F.col("total").alias("_total"), (F.col("_upto") - F.col("_n") + 1).alias("rank_in_tier"))
    same = F.col("tier").eqNullSafe(F.col("_tier")) & F.col("total").eqNullSafe(F.col("_total"))
    return findings.join(ranks, same).drop("_tier", "_total")


def most_authoritative(findings: DataFrame, group: str) -> DataFrame:
    """Of each group the finding of highest credibility, the first of equals."""
    order = F.when(F.col("credibility") == "HIGH", 0).when(F.col("credibility") == "MEDIUM", 1).when(F.col("credibility") == "LOW", 2).otherwise(3)
    return findings.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(order, "seq"))).where("_r = 1").drop("_r")


def followable(people: DataFrame, fields: list[str], least: int = 10_000, most: int = 30) -> DataFrame:
    """At most `most` people with over `least` followers or of a wanted field, most followed first."""
    return people.where((F.col("followers") > least) | F.col("field").isin(fields)).orderBy(F.desc("followers"), "user").limit(most)


def url_coverage(findings: DataFrame) -> DataFrame:
    """n, with_url, share, good (70 % at least): one row; counted by findings."""
    has = F.coalesce(F.col("url").rlike("^https?://"), F.lit(False))
    return findings.agg(F.count(F.lit(1)).alias("n"), F.count_if(has).alias("with_url")).withColumn("share", F.when(F.col("n") > 0, F.col("with_url") / F.col("n")).otherwise(0.0)).withColumn("good", F.col("share") >= 0.7)
