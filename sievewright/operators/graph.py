"""Connected components and ordered leaders of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.operators.lineage import cut, release


#: Up to so many open edges are settled by one task, in order.
FEW_EDGES = 200_000
#: Rounds that settle all over the graph before rounds in order begin.
ROUNDS = 6


def components(edges: DataFrame) -> DataFrame:
    """(node, component): component is the smallest node that edges (a, b) reach.

    Each round links the larger neighbours of a node to the smallest one, then
    the smaller neighbours likewise; the edges end up as stars around the
    smallest nodes. Only counts come to the driver. Nodes without edges are
    not in the result.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u < v").distinct())
    while True:
        both = e.unionByName(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).withColumn("m", F.least("m", "v"))
        large = both.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("u < v").distinct()
        small_least = large.groupBy("v").agg(F.min("u").alias("m"))
        linked = large.join(small_least, "v")
        small = linked.where("u != m").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(small_least.select("v", F.col("m").alias("u"))).distinct()
        former, e = e, cut(small)
        release(former)
        # stars around smallest nodes: no node is both someone's larger and someone's smaller neighbour
        if e.join(e.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty():
            return e.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(e.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())


def grown(stored: DataFrame, edges: DataFrame) -> DataFrame:
    """What new edges (a, b) change of stored components: (node, component) of nodes that are new or have another one now.

    Edges become edges between components, and only those components that
    meet are worked on; rows of stored that are not in the result stay as they
    are. With stored from components() over some edges, both together are
    components() over all.
    """
    known = stored.select("node", "component")
    ends = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct().join(known, "node", "left")
    ends = cut(ends.select("node", F.coalesce("component", "node").alias("component"), F.col("component").isNull().alias("fresh")))
    x, y = (ends.select(F.col("node").alias(s), F.col("component").alias(f"c{s}")) for s in "ab")
    met = components(edges.select("a", "b").where("a <> b").join(x, "a").join(y, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    met = cut(met.select(F.col("node").alias("component"), F.col("component").alias("now")))
    fresh = ends.where("fresh").select("node", "component").join(met, "component", "left").select("node", F.coalesce("now", "component").alias("component"))
    # a node that meets nobody, by an edge to itself, is in no component, as in components()
    alone = edges.select(F.col("a").alias("node")).where("a = b").distinct()
    linked = edges.where("a <> b").select(F.explode(F.array("a", "b")).alias("node")).distinct()
    fresh = fresh.join(alone.join(linked, "node", "left_anti"), "node", "left_anti")
    moved = known.join(met.where("component <> now"), "component").select("node", F.col("now").alias("component"))
    return moved.unionByName(fresh)


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges sorted by (b, a): the nodes b that some a which is no duplicate itself makes one, and the first such a."""
    gone: set[int] = set()
    for batch in batches:
        out: dict[int, int] = {}
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            if b not in gone and a not in gone:
                gone.add(b)
                out[b] = a
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.int64())], names=["node", "duplicate_of"])


def leaders(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """(node, duplicate_of) of the duplicates that a pass in order finds.

    edges: a < b (long) are similar. A node is a duplicate if an earlier node
    that is none is similar to it; duplicate_of is the first such. Every round
    settles what it can: nodes without an open or leading earlier neighbour
    lead, and their later neighbours are duplicates; at least the first open
    node of each component is settled. Once at most `few` edges are open, one
    task goes through them in order. While there are more after ROUNDS rounds,
    as long chains have it, every other round takes the nodes up to such a
    place that about `few` edges end there: no later edge decides on them, so
    rounds are as many as the edges divided by `few`, however long the chains.
    """
    open_ = cut(edges.select("a", "b").distinct())
    found: list[DataFrame] = []
    rounds = 0
    while left := open_.count():
        rounds += 1
        if left <= few:
            found.append(cut(open_.coalesce(1).sortWithinPartitions("b", "a").mapInArrow(_in_order, "node long, duplicate_of long")))
            break
        if rounds > ROUNDS and (rounds - ROUNDS) % 2:
            place = open_.approxQuantile("b", [few / left], 0.001)[0]
            gone = cut(open_.where(F.col("b") <= place).coalesce(1).sortWithinPartitions("b", "a").mapInArrow(_in_order, "node long, duplicate_of long"))
            found.append(gone)
            former, open_ = open_, cut(open_.where(F.col("b") > place).join(gone.select(F.col("node").alias("a")), "a", "left_anti").select("a", "b"))
            release(former)
            continue
        # open edges join open nodes only, so a node that is never a later one leads
        lead = open_.select(F.col("a").alias("node")).distinct().join(open_.select(F.col("b").alias("node")).distinct(), "node", "left_anti")
        gone = cut(open_.join(lead.withColumnRenamed("node", "a"), "a", "left_semi").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("duplicate_of")))
        found.append(gone)
        rest = open_.join(lead.withColumnRenamed("node", "a"), "a", "left_anti")
        for side in ("a", "b"):
            rest = rest.join(gone.select(F.col("node").alias(side)), side, "left_anti")
        former, open_ = open_, cut(rest.select("a", "b"))
        release(former)
    if not found:
        return edges.select(F.col("b").alias("node"), F.col("a").alias("duplicate_of")).limit(0)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    # a node settled in an early round may have an earlier leader that only a later round settles
    lead = edges.select("a").distinct().join(out.select(F.col("node").alias("a")), "a", "left_anti")
    return edges.join(lead, "a", "left_semi").join(out.select(F.col("node").alias("b")), "b", "left_semi").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("duplicate_of"))
