"""Search over a positional inverted index of posts.

The index has a row for each word of some hundred posts: which of them hold it,
and where it stands there. It is written in buckets of words, sorted, so a
search reads the buckets of the words that it asks for and of those the row
groups that hold them. Words meet by joins on the
post: side by side they intersect, OR unites, - subtracts, and a "phrase" asks
for places that follow each other. What is no word (from:, since:, min_faves:
and so on) filters the posts; list: keeps posts whose author is a member.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.operators import feed
from sievewright.operators.keys import by_key

WORD = r"[\p{L}\p{N}_]+"
BUCKETS = 64
#: Posts whose words are put together before they move.
GATHERED = 2000
_POSTINGS = "term string, posts array<long>, many array<int>, places array<int>"


def _bucket(term, buckets: int):
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def words(text):
    """The words of a text in order, lower-cased."""
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.lower(w))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every GATHERED posts (post_id, words) a row for each word: the posts that hold it, how often, and its places in each, one after the other."""
    for batch in (b.slice(k, GATHERED) for b in batches for k in range(0, len(b), GATHERED)):
        said = batch.column("words")
        bounds = said.offsets.to_numpy()
        coded = said.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        if not len(coded):
            continue
        bounds = bounds - bounds[0]
        code = coded.indices.to_numpy()
        order = np.argsort(code, kind="stable")  # by word, then post, then place
        row = np.repeat(np.arange(len(batch)), np.diff(bounds))[order]
        code, place = code[order], order - bounds[row]
        word = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        post = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (row[1:] != row[:-1])))
        lists = pa.array(np.append(np.searchsorted(post, word), len(post)), pa.int32())
        many = pa.ListArray.from_arrays(lists, pa.array(np.diff(np.append(post, len(code))), pa.int32()))
        places = pa.ListArray.from_arrays(pa.array(np.append(word, len(code)), pa.int32()), pa.array(place, pa.int32()))
        columns = [coded.dictionary.take(pa.array(code[word])), pa.ListArray.from_arrays(lists, batch.column("post_id").take(pa.array(row[post]))), many, places]
        yield pa.RecordBatch.from_arrays(columns, names=["term", "posts", "many", "places"])


def _each_post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """post_id and places of what _gathered() put together."""
    for batch in batches:
        posts, many, places = (batch.column(c).flatten() for c in ("posts", "many", "places"))
        bounds = np.concatenate([[0], np.cumsum(many.to_numpy())])
        yield pa.RecordBatch.from_arrays([posts, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), places)], names=["post_id", "places"])


def build(posts: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write the index of posts (post_id, text): bucket, term, posts, how many places each has, and these (from 0). Null texts have no words.

    Words are gathered from many posts at once where these are read, so only
    postings move, once, to the bucket and one of eight parts of it, so that a
    word of every post is spread too. Posts of one id are first put together.
    """
    once, several = by_key(posts.select(F.col("post_id").cast("long").alias("post_id"), "text"), "post_id")
    told = lambda rows: rows.select("post_id", words(F.coalesce("text", F.lit(""))).alias("words"))
    rows = told(once).mapInArrow(_gathered, _POSTINGS)
    if several is not None:
        each = told(several).select("post_id", F.posexplode("words").alias("place", "term"))
        merged = each.groupBy("post_id", "term").agg(F.sort_array(F.collect_list("place")).alias("places"))
        rows = rows.unionByName(merged.select("term", F.array("post_id").alias("posts"), F.array(F.size("places")).alias("many"), "places"))
    rows = rows.withColumn("bucket", _bucket(F.col("term"), buckets))
    spread = F.pmod(F.xxhash64(F.col("posts")[0]), F.lit(8))
    rows.repartition("bucket", spread).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(path)


class PostIndex:
    """An index at path, the posts that it was built from, and the members (list_id, account) of lists."""

    def __init__(self, spark: SparkSession, path: str, posts: DataFrame, members: DataFrame | None = None, buckets: int = BUCKETS):
        self.spark, self.posts, self.members, self.buckets = spark, posts, members, buckets
        self.rows = spark.read.schema(f"{_POSTINGS}, bucket int").parquet(path)

    def postings(self, term: str) -> DataFrame:
        """post_id, places of one word; its bucket is found here, so that only this folder is listed."""
        # one value: the same hash as build()
        bucket = self.spark.range(1).select(_bucket(F.lit(term), self.buckets).alias("b")).first()["b"]
        found = self.rows.where((F.col("bucket") == bucket) & (F.col("term") == term))
        return found.select("posts", "many", "places").mapInArrow(_each_post, "post_id long, places array<int>")

    def search(self, query: str) -> DataFrame:
        """post_id of what a search text finds (see feed.search(); words here are whole words)."""
        return self._found(feed.parse(query))

    def _found(self, node: tuple) -> DataFrame:
        kind, rest = node[0], node[1:]
        if kind == "or":
            return reduce(DataFrame.unionByName, map(self._found, rest)).distinct()
        if kind == "and":
            return self._all(rest)
        if kind == "not":
            return self._all((node,))
        if self._is_filter(node):
            return self.posts.where(feed.column(node)).select("post_id")
        token = rest[0]
        if token.startswith("list:"):
            accounts = self.members.where(F.col("list_id") == token[5:]).select(F.lower("account").alias("_account")).distinct()
            return self.posts.join(accounts, F.lower("author") == F.col("_account"), "left_semi").select("post_id")
        return self._phrase(token)

    def _is_filter(self, node: tuple) -> bool:
        """Whether columns of the posts alone decide."""
        if node[0] != "term":
            return all(map(self._is_filter, node[1:]))
        return not node[1].startswith("list:") and feed.is_operator(node[1])

    def _all(self, parts: tuple) -> DataFrame:
        """What all parts hold of: words first, then the filters in one, then what is left out."""
        filters = [p for p in parts if self._is_filter(p)]
        sets = [self._found(p) for p in parts if not self._is_filter(p) and p[0] != "not"]
        less = [self._found(p[1]) for p in parts if not self._is_filter(p) and p[0] == "not"]
        if filters or not sets:
            condition = reduce(lambda x, y: x & y, map(feed.column, filters), F.lit(True))
            sets.append(self.posts.where(condition).select("post_id"))
        out = reduce(lambda x, y: x.join(y, "post_id", "left_semi"), sets)
        return reduce(lambda x, y: x.join(y, "post_id", "left_anti"), less, out)

    def _phrase(self, token: str) -> DataFrame:
        """Posts with the words of the token side by side, in order."""
        said = self.spark.range(1).select(words(F.lit(token.strip('"'))).alias("w")).first()["w"]
        if not said:
            return self.posts.select("post_id")
        out = self.postings(said[0])
        for k, word in enumerate(said[1:], start=1):
            following = self.postings(word).select("post_id", F.transform("places", lambda p: p - k).alias("next"))  # noqa: B023  transform() calls it at once
            out = out.join(following, "post_id").select("post_id", F.array_intersect("places", "next").alias("places")).where(F.size("places") > 0)
        return out.select("post_id")
