"""Streaming forms of the incremental checks."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from sievewright.functions.text import filtered_tokens
from sievewright.functions.urls import normalise
from sievewright.operators.analyze import QUERY
from sievewright.operators.graph import leaders
from sievewright.operators.lineage import cut, release


def dedup_urls(urls: DataFrame) -> DataFrame:
    """A stream of (url, ...) with the first row of each normalised URL; identity is for good, so its state grows."""
    return urls.withColumn("normalized", normalise(F.col("url"))).dropDuplicates(["normalized"])


def dedup_urls_within(urls: DataFrame, time: str, delay: str) -> DataFrame:
    """The bounded form: an identity is forgotten `delay` after it was last seen."""
    return urls.withColumn("normalized", normalise(F.col("url"))).withWatermark(time, delay).dropDuplicatesWithinWatermark(["normalized"])


def windowed_counts(posts: DataFrame, time: str = "created", delay: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Posts by kind and window; rows later than the watermark are dropped by Spark."""
    return posts.withWatermark(time, delay).groupBy(F.window(time, width), "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("engagement").alias("engagement")).select(F.col("window.start").alias("start"), "kind", "n", "engagement")


#: Buckets that the terms of the state are kept in.
BUCKETS = 1024
#: Rows of a state's entry at most.
ROWS = 4096
#: Places of a sketch.
PLACES = 128
#: Pairs that are looked at at once.
CELLS = 1_000_000
#: Rows of a term that meet pair by pair; those of a term with more meet as matrices.
FEW = 64
_SLACK = 4e-9
_WORDS = "seq long, term long, place int, whole long, kind binary, t binary, n binary"
#: A state's entry: rows' numbers, and their terms and counts one after the other.
_KNOWN = "term binary, seq binary, whole binary, kind binary, size binary, t binary, n binary"


def _looked_up(least: float) -> Callable:
    """A row for each term in front of a query's vector: what begins there (terms, counts), the whole one's squares, and a digest that equal ones share.

    Long terms are first, equals by hash, so the order needs no statistics.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 2000) for b in batches for k in range(0, len(b), 2000)):
            words, offsets = batch.column("words").flatten(), batch.column("words").offsets.to_numpy()
            size, term = (words.field(c).to_numpy(zero_copy_only=False) for c in ("size", "hash"))
            row = np.repeat(np.arange(len(batch)), np.diff(offsets))
            order = np.lexsort((term, -size, row))
            term, row = term[order], row[order]
            fresh = np.ones(len(term), bool)
            fresh[1:] = (term[1:] != term[:-1]) | (row[1:] != row[:-1])
            begin = np.flatnonzero(fresh)
            t, row, n = term[begin], row[begin], np.diff(np.append(begin, len(term))).astype(np.int32)
            bounds = np.searchsorted(row, np.arange(len(batch) + 1))
            upto = np.concatenate([[0], np.cumsum(n.astype(np.int64) ** 2)])
            whole = upto[bounds[1:]] - upto[bounds[:-1]]
            at = np.flatnonzero(upto[bounds[1:]][row] - upto[:-1] >= (least * least - _SLACK) * whole[row])
            ts, ns = t.tobytes(), n.tobytes()
            kinds = [hashlib.blake2b(ts[8 * x : 8 * y] + ns[4 * x : 4 * y], digest_size=16).digest() for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            ends = bounds[1:][row[at]].tolist()
            # a query without terms is told of once, at no place
            none = np.flatnonzero(bounds[1:] == bounds[:-1])
            of, blank = np.concatenate([row[at], none]), [b""] * len(none)
            seq = batch.column("seq").to_numpy()[of]
            columns = [
                pa.array(seq, pa.int64()), pa.array(np.concatenate([t[at], seq[len(at) :]]), pa.int64()), pa.array(np.concatenate([at - bounds[row[at]], np.full(len(none), -1)]), pa.int32()), pa.array(whole[of], pa.int64()),
                pa.array([kinds[k] for k in of.tolist()], pa.binary()), pa.array([ts[8 * x : 8 * y] for x, y in zip(at.tolist(), ends)] + blank, pa.binary()), pa.array([ns[4 * x : 4 * y] for x, y in zip(at.tolist(), ends)] + blank, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["seq", "term", "place", "whole", "kind", "t", "n"])

    return run


def _stretches(begin: np.ndarray, many: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each stretch, one after the other."""
    return np.repeat(begin - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())


def _told(seq: np.ndarray, earlier: np.ndarray | None = None, copy: bool = False) -> pd.DataFrame:
    none = np.full(len(seq), earlier is None)
    return pd.DataFrame({"seq": np.asarray(seq, np.int64), "earlier": pd.arrays.IntegerArray(np.zeros(len(seq), np.int64) if earlier is None else np.asarray(earlier, np.int64), none), "copy": np.full(len(seq), copy)})


class _Rows:
    """Rows of some terms in the order that they came, each with its vector from the term on."""

    def __init__(self, entries: list[tuple]):
        kinds = (np.int64, np.int64, np.int64, np.int64, np.int64, np.int64, np.int32)
        self.term, self.seq, self.whole, kind, self.size, self.t, self.n = (np.frombuffer(b"".join(c), k) for c, k in zip(zip(*entries), kinds))
        self.kind = kind.reshape(-1, 2)
        self.begin = np.concatenate([[0], np.cumsum(self.size)])

    def __len__(self) -> int:
        return len(self.seq)

    def of(self, rows: np.ndarray) -> _Rows:
        out = object.__new__(_Rows)
        at = _stretches(self.begin[rows], self.size[rows])
        out.term, out.seq, out.whole, out.kind, out.size, out.t, out.n = self.term[rows], self.seq[rows], self.whole[rows], self.kind[rows], self.size[rows], self.t[at], self.n[at]
        out.begin = np.concatenate([[0], np.cumsum(out.size)])
        return out

    def entry(self) -> tuple:
        return tuple(c.tobytes() for c in (self.term, self.seq, self.whole, self.kind, self.size, self.t, self.n))

    def sketches(self) -> np.ndarray:
        """Weights of the vectors, summed up by hashed term: products are never below the cosine."""
        out = np.empty((len(self), PLACES), np.float32)
        place, weight = self.t % PLACES, self.n / np.repeat(np.sqrt(self.whole), self.size)
        for lo in range(0, len(self), 4096):
            hi = min(lo + 4096, len(self))
            x, y = self.begin[lo], self.begin[hi]
            row = np.repeat(np.arange(hi - lo), self.size[lo:hi])
            out[lo:hi] = np.bincount(row * PLACES + place[x:y], weight[x:y], (hi - lo) * PLACES).reshape(hi - lo, PLACES)
        return out

    def dots(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The products of rows i and j."""
        _, number = np.unique(self.t, return_inverse=True)
        key = np.repeat(np.arange(len(self)), self.size) * len(self.t) + number
        order = np.argsort(key)
        key = key[order]
        out = []
        for k in range(0, len(i), 10_000):
            x, y = i[k : k + 10_000], j[k : k + 10_000]
            at, pair = _stretches(self.begin[x], self.size[x]), np.repeat(np.arange(len(x)), self.size[x])
            wanted = y[pair] * len(self.t) + number[at]
            there = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
            out.append(np.bincount(pair, np.where(key[there] == wanted, self.n[at].astype(np.int64) * self.n[order[there]], 0), len(x)))
        return np.concatenate(out)


def _near(rows: _Rows, new: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """New rows, and an earlier one of the same term that each has cosine `least` or more with, found at the first term that both share at the latest.

    What two vectors have from their first shared term on bounds their
    cosine, then their sketches do; what is left is added up.
    """
    rest = np.add.reduceat(np.append(rows.n.astype(np.int64) ** 2, 0), rows.begin[:-1]) / rows.whole
    order = np.lexsort((-rest, rows.term))
    term, rest = rows.term[order], rest[order]
    begin = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
    many = np.diff(np.append(begin, len(term)))
    group = np.repeat(np.arange(len(begin)), many)
    fresh = np.flatnonzero(new[order])
    # rows of a group whose rest is large enough for that of the fresh one are its first ones
    upto = np.searchsorted(2 * group + 1 - rest, 2 * group[fresh] + 1 - (least * least - _SLACK) / rest[fresh] + _SLACK, side="right") - begin[group[fresh]]
    sketch = rows.sketches()[order]
    found: list[tuple] = []
    small = many[group[fresh]] <= FEW
    for k in range(0, int(small.sum()), CELLS // (10 * FEW)):
        at = np.flatnonzero(small)[k : k + CELLS // (10 * FEW)]
        i, j = np.repeat(fresh[at], upto[at]), _stretches(begin[group[fresh[at]]], upto[at])
        earlier = order[j] < order[i]
        i, j = i[earlier], j[earlier]
        fine = np.concatenate([np.einsum("ij,ij->i", sketch[i[x : x + 10_000]], sketch[j[x : x + 10_000]]) for x in range(0, len(i), 10_000)] or [np.zeros(0)]) >= least - 1e-4
        found.append((order[i[fine]], order[j[fine]]))
    large = np.flatnonzero(~small)
    for g in np.unique(group[fresh[large]]).tolist():
        own = large[slice(*np.searchsorted(group[fresh[large]], [g, g + 1]))]
        step = max(1, CELLS // int(many[g]))
        for k in range(0, len(own), step):
            # the first of them has the largest rest, so it meets the most
            i, j = fresh[own[k : k + step]], np.arange(begin[g], begin[g] + upto[own[k]])
            # products of float32 differ from the exact ones by far less than this
            x, y = np.nonzero(sketch[i] @ sketch[j].T >= least - 1e-4)
            x, y = order[i[x]], order[j[y]]
            found.append((x[y < x], y[y < x]))
    i, j = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    if len(i):
        used, number = np.unique(np.concatenate([i, j]), return_inverse=True)
        fine = rows.of(used).dots(number[: len(i)], number[len(i) :]) >= (least - 1e-9) * np.sqrt(rows.whole[i] * rows.whole[j])
        i, j = i[fine], j[fine]
    return i, j


class Alike(StatefulProcessor):
    """For each bucket of terms, the queries that have one of its terms in front; arriving ones meet those of their term, and one another in order."""

    def __init__(self, least: float):
        self.least = least

    def init(self, handle) -> None:
        self.known = handle.getListState("known", _KNOWN)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = pd.concat(rows).sort_values(["seq", "kind"])
        out = [_told(fresh["seq"][fresh["place"] <= 0])]
        fresh = fresh[fresh["place"] >= 0]
        if len(fresh):
            out += self._met(fresh)
        yield pd.concat(out)

    def _met(self, fresh: pd.DataFrame) -> list[pd.DataFrame]:
        held = [tuple(entry) for entry in self.known.get()]
        size = (fresh["t"].str.len() // 8).to_numpy(np.int64)
        numbers = [fresh[c].to_numpy(np.int64).tobytes() for c in ("term", "seq", "whole")]
        rows = _Rows([*held, (*numbers, b"".join(fresh["kind"]), size.tobytes(), b"".join(fresh["t"]), b"".join(fresh["n"]))])
        place = np.full(len(rows), -1)
        place[len(rows) - len(fresh) :] = fresh["place"]
        told = pd.DataFrame({"term": rows.term, "seq": rows.seq, "x": rows.kind[:, 0], "y": rows.kind[:, 1], "new": place >= 0, "place": place, "row": np.arange(len(rows))})
        told = told[told["term"].isin(fresh["term"])]
        told = told[~(told["new"] & told.duplicated(["term", "seq"]))]
        # equal ones are told once, with the first of them, and are not kept
        told["first"] = told.groupby(["term", "x", "y"], sort=False)["seq"].transform("first")
        copy = told["new"] & (told["first"] != told["seq"])
        copies, told = told[copy & (told["place"] == 0)], told[~copy]
        new = told["new"].to_numpy()
        out = [_told(copies["seq"], copies["first"], True)]
        if new.any():
            at = told["row"].to_numpy()
            news = at[new]
            self.known.appendList([rows.of(news[k : k + ROWS]).entry() for k in range(0, len(news), ROWS)])
            rows = rows.of(at)
            i, j = _near(rows, new, self.least)
            out.append(_told(rows.seq[i], rows.seq[j]))
        return out

    def close(self) -> None:
        pass


def alike(queries: DataFrame, least: float = QUERY, buckets: int = BUCKETS) -> DataFrame:
    """Of a stream of queries (seq, text): seq, earlier and copy; each earlier one that a query is alike, and null in one row of every query.

    Of equal vectors only the first meets others: the rest are told as copies of it.

    A query is read once: its vector stays in the state, under the terms that
    anything alike must share one of, from that term on. Terms are kept in
    buckets, since a call of the state costs more than some hundred of its
    rows: there should be as many as the state has thousands of rows, and a
    bucket's rows of all batches are held at once, some 300 bytes each, with
    512 more for those whose term is asked for. There is no watermark, since what was
    asked once is asked for good; the state grows with the queries. Within a
    batch, order is that of seq; batches are taken in the order that they come.
    """
    spark = queries.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    words = F.transform(filtered_tokens(F.coalesce("text", F.lit(""))), lambda t: F.struct(F.length(t).alias("size"), F.xxhash64(t).alias("hash")))
    rows = queries.select("seq", words.alias("words")).mapInArrow(_looked_up(least), _WORDS)
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets))
    return rows.withColumn("bucket", bucket).groupBy("bucket").transformWithStateInPandas(Alike(least), "seq long, earlier long, copy boolean", "Append", "None")


def log_queries(queries: DataFrame, log_path: str, checkpoint: str) -> StreamingQuery:
    """Decide on each query (seq, text) of a stream: log_path gets seq and duplicate_of, which is null for accepted ones.

    A query is a duplicate of the first accepted one before it that it is
    alike. A batch's decisions are one folder, written over if the batch is
    run again, so a restart decides nothing twice. Of former batches only the
    duplicates' numbers are read, and those only for queries that something
    in the batch is alike.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        found = cut(batch.distinct())
        edges = found.where("earlier IS NOT NULL AND NOT copy").select(F.col("earlier").alias("a"), F.col("seq").alias("b"))
        former = None
        if number > 0:
            # all former batches have written a folder by now, so a failure to read is a failure
            former = spark.read.schema("seq long, duplicate_of long").parquet(*(f"{log_path}/{k}" for k in range(number))).where("duplicate_of IS NOT NULL")
            edges = edges.join(former.select(F.col("seq").alias("a")), "a", "left_anti")
        settled = cut(leaders(cut(edges.select("a", "b"))).withColumnRenamed("node", "seq"))
        # a copy goes with the first of its kind, or to it
        of_first = settled if former is None else settled.unionByName(former)
        copies = found.where("copy").select(F.col("seq").alias("node"), F.col("earlier").alias("seq")).join(of_first, "seq", "left").select(F.col("node").alias("seq"), F.coalesce("duplicate_of", "seq").alias("duplicate_of"))
        verdicts = settled.unionByName(copies).groupBy("seq").agg(F.min("duplicate_of").alias("duplicate_of"))
        found.select("seq").distinct().join(verdicts, "seq", "left").write.mode("overwrite").parquet(f"{log_path}/{number}")
        release(found, settled)

    return alike(queries).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
