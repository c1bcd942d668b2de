"""Approximate nearest neighbours: one graph by NN-descent, searched greedily.

Equal vectors are one node. Each node begins with random neighbours among all
nodes of its length; in each round Spark joins bring together, at every node,
its neighbours and the nearest of those that it is a neighbour of; each learns
there of the others (its neighbours' neighbours), and the DEGREE nearest are
kept. Rounds end when few lists change. The graph's joins carry 8-bit copies of
the vectors.

All queries are searched together. A search holds its BEAM best nodes; in every
round the WIDTH best that were not walked from yet meet their graph neighbours
by a join, and what beats the beam's last enters it. It begins at the best of a
fixed number of entry nodes and, if the query is a node itself, there; it ends
when the whole beam was walked from, so a query's work follows the nodes it
visits, not the table. The beam's nodes are scored with the original vectors in
double precision; nearness is the inner product, ties go to the smaller vec_id.

Vectors that are null, empty, zero or hold null or non-finite components take
no part, neither as queries nor as candidates; nor do rows with a null vec_id.
Vectors meet only vectors of their own length. With at most k candidates all
are returned. A vector given more than once under one id counts once; of
different vectors under one id the first in array order counts, the others take
no part. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievewright.llm._shared import cut, salted_join, sweep, tidy
from sievewright.operators.numbering import with_slots

DEGREE = 24
ROUNDS = 10
#: What a node learns at one meeting: so many of the nearest that beat its list. A node meets others in many places.
LEARNED = 4
#: A round that changes less than this share of the lists is the last.
SETTLED = 0.02
BEAM = 256
WIDTH = 64
#: Nodes of each length that every search looks at first.
ENTRIES = 256
#: Up to so many lengths of vectors their entry nodes are sent to every executor.
BROADCAST_LENGTHS = 64
_NEVER = -3e38


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (array<double>) of the vectors that take part, one for each id."""
    v = F.col("embedding").cast("array<double>")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    fine = vectors.select("vec_id", v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(good)
    return fine.groupBy("vec_id").agg(F.min("v").alias("v"))


def nodes(own: DataFrame, k: int = 20) -> tuple[DataFrame, DataFrame]:
    """(node, dim, v: one for each different vector of usable(); node, ids: its k + 1 smallest ids, in order).

    A vector's later copies can't be among the k nearest of anything before
    its first k + 1, so these are all that a search needs. They are taken from
    partial lists, so a vector may be shared by any number of ids.
    """
    some = own.groupBy("v", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("part")).agg(F.collect_list("vec_id").alias("ids"))
    few = some.select("v", F.slice(F.array_sort("ids"), 1, k + 1).alias("ids")).groupBy("v").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"))
    kept = cut(few.select(F.element_at("ids", 1).alias("node"), F.size("v").alias("dim"), "v", "ids"))
    return kept.select("node", "dim", "v"), kept.select("node", "ids")


def _quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = []
        for x in batch.column("v").to_pylist():
            x = np.array(x)
            raw.append(np.rint(x * (127 / np.abs(x).max())).astype(np.int8).tobytes() + np.float32(np.abs(x).max() / 127).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("dim"), pa.array(raw, pa.binary())], names=["node", "dim", "q"])


def _vector(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int8, len(raw) - 4).astype(np.float32) * np.frombuffer(raw, np.float32, 1, len(raw) - 4)


def _local_joins(batches: Iterator[pa.RecordBatch], learned_most: int) -> Iterator[pa.RecordBatch]:
    """Rows (at, node, q, worst, fresh) sorted by at: what the nodes that met at one node learn of each other."""
    key: object = None
    held: list[tuple] = []

    def learned() -> pa.RecordBatch | None:
        if len(held) < 2:
            return None
        ids = np.array([h[0] for h in held], np.int64)
        ids, first = np.unique(ids, return_index=True)
        x = np.stack([_vector(held[i][1]) for i in first])
        worst = np.array([held[i][2] for i in first], np.float32)
        fresh = np.array([h[3] for h in held], bool)
        new = np.zeros(len(ids), bool)
        new[np.searchsorted(ids, np.array([h[0] for h in held])[fresh])] = True
        score = x @ x.T
        # only pairs that one of two rounds has not seen, and only what beats a list's last entry
        news = (new[:, None] | new[None, :]) & (score > worst[:, None])
        np.fill_diagonal(news, False)
        if len(ids) > learned_most:
            told = np.where(news, score, -np.inf)
            near = np.argpartition(-told, learned_most - 1, axis=1)[:, :learned_most]
            best = np.zeros_like(news)
            np.put_along_axis(best, near, True, 1)
            news &= best
        a, b = np.nonzero(news)
        if not len(a):
            return None
        return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b]), pa.array(score[a, b])], names=["node", "near", "score"])

    out: list[pa.RecordBatch] = []
    for batch in batches:
        for at, *row in zip(*(batch.column(c).to_pylist() for c in ("at", "node", "q", "worst", "fresh"))):
            if at != key:
                if (got := learned()) is not None:
                    out.append(got)
                key, held = at, []
                if len(out) >= 500:
                    yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                    out = []
            held.append(tuple(row))
    if (got := learned()) is not None:
        out.append(got)
    if out:
        yield from pa.Table.from_batches(out).combine_chunks().to_batches()


def descend(own: DataFrame, degree: int = DEGREE, rounds: int = ROUNDS, learned: int = LEARNED) -> DataFrame:
    """node, near, score: the edges of one graph over all nodes (node, dim, q), `degree` from every node (all, where fewer are)."""
    spark = own.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # random neighbours: places in a numbering of all nodes of a length
    numbered = cut(with_slots(own.select("node", "dim"), "dim", ["node"], "place"))
    sizes = numbered.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
    steps = F.transform(F.sequence(F.lit(1), F.lit(degree)), lambda i: F.pmod(F.col("place") + 1 + F.pmod(F.xxhash64("node", i), F.greatest(F.col("n") - 1, F.lit(1))), "n"))
    drawn = salted_join(numbered, sizes, ["dim"], "node").select("node", "dim", F.explode(F.array_distinct(steps)).alias("place"))
    graph = drawn.join(numbered.withColumnRenamed("node", "near"), ["dim", "place"]).where("node != near").select("node", "near", F.lit(-1e30).cast("float").alias("score"), F.lit(True).alias("fresh"))
    graph = cut(graph)
    total = numbered.count()
    by_score = Window.partitionBy("node").orderBy(F.desc("score"), "near")
    never = F.lit(_NEVER).cast("float")
    for _ in range(rounds):
        worst = graph.groupBy("node").agg(F.when(F.count(F.lit(1)) >= degree, F.min("score")).otherwise(never).alias("worst"))
        known = own.select("node", "q").join(worst, "node", "left").withColumn("worst", F.coalesce("worst", never))
        # reverse edges: the nearest `degree`, as a node that very many are near to would meet them all
        reverse = graph.select(F.col("near").alias("at"), F.col("node"), "score", "fresh").withColumn("r", F.row_number().over(Window.partitionBy("at").orderBy(F.desc("score"), F.xxhash64("node")))).where(F.col("r") <= degree)
        meet = graph.select(F.col("node").alias("at"), F.col("near").alias("node"), "fresh").unionByName(reverse.select("at", "node", "fresh"))
        # a node also meets its own neighbours
        itself = graph.select("node").distinct().select(F.col("node").alias("at"), "node", F.lit(False).alias("fresh"))
        rows = meet.unionByName(itself).join(known, "node").select("at", "node", "q", "worst", "fresh")
        found = rows.repartition(parts, "at").sortWithinPartitions("at").mapInArrow(tidy(partial(_local_joins, learned_most=learned)), "node long, near long, score float")
        old = graph.withColumn("fresh", F.lit(False))
        both = old.unionByName(found.withColumn("fresh", F.lit(True))).groupBy("node", "near").agg(F.max("score").alias("score"), F.min("fresh").alias("fresh"))
        graph = cut(both.withColumn("r", F.row_number().over(by_score)).where(F.col("r") <= degree).drop("r"))
        sweep(spark)
        if graph.where("fresh").count() < SETTLED * degree * total:
            break
    return graph.select("node", "near", "score")


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (query, v, worst, ids, codes): the nodes among ids that beat `worst`, a row each."""
    for batch in batches:
        query, node, score = [], [], []
        for q, v, worst, ids, codes in zip(*(batch.column(c).to_pylist() for c in ("query", "v", "worst", "ids", "codes"))):
            own = np.stack([_vector(c) for c in codes]) @ np.array(v, np.float32)
            good = np.flatnonzero(own > worst)
            query += [q] * len(good)
            node += [ids[k] for k in good]
            score.append(own[good])
        yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(node, pa.int64()), pa.array(np.concatenate(score) if score else [], pa.float32())], names=["query", "node", "score"])


_FOUND = "query long, node long, score float"


def search(own: DataFrame, graph: DataFrame, queries: DataFrame, beam: int = BEAM, width: int = WIDTH, entries: int = ENTRIES) -> DataFrame:
    """query, node: the beam of each query, by greedy search of the graph.

    own: node, dim, q; queries: query, dim, v and at, a node to begin at or null.
    """
    spark = own.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # every node with its neighbours' codes; edges are walked both ways, from a node that many are near to by the nearest
    edges = graph.select("node", "near", "score").unionByName(graph.select(F.col("near").alias("node"), F.col("node").alias("near"), "score"))
    near = edges.groupBy("node", "near").agg(F.max("score").alias("score")).withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score"), "near"))).where(F.col("r") <= 2 * DEGREE)
    laid = near.join(own.select(F.col("node").alias("near"), "q"), "near").groupBy("node").agg(F.collect_list(F.struct("near", "q")).alias("n"))
    around = cut(laid.select("node", F.col("n.near").alias("ids"), F.col("n.q").alias("codes")))
    picked = own.withColumn("r", F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("node"), "node"))).where(F.col("r") <= entries)
    first = cut(picked.groupBy("dim").agg(F.collect_list("node").alias("ids"), F.collect_list("q").alias("codes")))
    asked = cut(queries.select("query", "dim", "v", "at"))
    never = F.lit(_NEVER).cast("float")
    begun = asked.join(F.broadcast(first) if first.count() <= BROADCAST_LENGTHS else first, "dim").select("query", "v", never.alias("worst"), "ids", "codes")
    there = asked.join(own.select(F.col("node").alias("at"), "q"), "at").select("query", "v", never.alias("worst"), F.array("at").alias("ids"), F.array("q").alias("codes"))
    found = begun.unionByName(there).mapInArrow(tidy(_scored), _FOUND)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    every = Window.partitionBy("query")
    state = None
    while True:
        new = found.withColumn("walked", F.lit(False))
        both = new if state is None else new.unionByName(state.select("query", "node", "score", "walked"))
        best = both.groupBy("query", "node").agg(F.max("score").alias("score"), F.max("walked").alias("walked")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= beam)
        ahead = F.sum((~F.col("walked")).cast("int")).over(order)
        told = best.withColumn("go", ~F.col("walked") & (ahead <= width)).withColumn("worst", F.when(F.count(F.lit(1)).over(every) >= beam, F.min("score").over(every)).otherwise(never))
        state = cut(told.select("query", "node", "score", (F.col("walked") | F.col("go")).alias("walked"), "go", "worst"))
        sweep(spark)
        going = state.where("go").select("query", "node", "worst")
        if going.isEmpty():
            return state.select("query", "node")
        steps = going.join(asked.select("query", "v"), "query").repartition(parts, "node").join(around, "node")
        found = steps.select("query", "v", "worst", "ids", "codes").mapInArrow(tidy(_scored), _FOUND)


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of every row whose vec_id `every` divides, among all others."""
    own = cut(usable(vectors))
    first, members = nodes(own, k)
    coded = cut(first.mapInArrow(tidy(_quantised), "node long, dim int, q binary"))
    graph = descend(coded)
    # queries with one vector are one search
    ids = own.where(F.col("vec_id") % every == 0)
    asked = cut(ids.groupBy("v").agg(F.min("vec_id").alias("query")))
    at = asked.join(first.select("v", F.col("node").alias("at")), "v").select("query", F.size("v").alias("dim"), "v", "at")
    found = search(coded, graph, at, max(beam, 2 * (k + 1)))
    # exact scores of the beam, then the nearest ids of its nodes
    pairs = found.join(first.select("node", F.col("v").alias("x")), "node").join(asked.select("query", "v"), "query")
    exact = F.aggregate(F.zip_with("v", "x", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    scored = pairs.select("query", "node", exact.alias("score")).join(members, "node")
    listed = scored.select("query", F.explode("ids").alias("vec_id"), (-F.col("score")).alias("far"))
    top = listed.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct("far", "vec_id"))), 1, k + 1).alias("near"))  # at most beam * (k + 1)
    same = salted_join(ids.select(F.col("vec_id").alias("query_id"), "v"), asked, ["v"], "query_id").select("query_id", "query")
    each = salted_join(same, cut(top), ["query"], "query_id")
    others = F.slice(F.filter("near", lambda n: n["vec_id"] != F.col("query_id")), 1, k)
    told = each.select("query_id", F.posexplode(others).alias("place", "n"))
    return told.select("query_id", (F.col("place") + 1).alias("rank"), "n.vec_id", (-F.col("n.far")).alias("score"))
