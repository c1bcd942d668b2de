"""Vector codes by product quantisation, with codebooks from a Lloyd iteration that is kept up by differences.

Components become integers, so sums are exact and independent of order. Every
round writes each vector's assignments beside the former ones to a table;
count and sum of every codebook entry run on from round to round, and only
parts that changed their entry move: plus where they came, minus where they
left, added up in each task before the shuffle. What moves is at most
PARTS * ENTRIES rows a task, and what comes to the driver PARTS * ENTRIES rows.

Dropped are rows whose vector is null, empty, or holds null or non-finite
components, and rows whose vector is not as long as that of the smallest kept
vec_id (the smallest vector, if several have it). Vectors that the number of
parts doesn't divide have their longer parts in front. Integer components lie
within 2**27 of 0; what is beyond counts as that, so that all sums of squares
fit. Repeated rows and rows that share a vec_id are rows of their own, in
order of vector and label where they begin codebooks; null vec_ids come last
there. Fewer rows than entries make as many entries as rows. Rows of equal or null label
are summed up together. An empty table gives no rows. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm._shared import BROADCAST_IDS, cut, release, salted_join, tidy

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256.0
MOST = 1 << 27
#: Vectors whose distances a task holds at once.
BLOCK = 4096


def integers(vectors: DataFrame, vector: str, label: str) -> DataFrame:
    """vec_id, label, v: rows that can be coded, with integer components."""
    x = F.col(vector)
    whole = F.transform(x, lambda c: F.greatest(F.least(F.floor(c.cast("double") * F.lit(SCALE)), F.lit(MOST)), F.lit(-MOST)).cast("int"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(x.isNotNull() & (F.size(x) > 0) & fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.col(label).alias("label"), whole.alias("v"))


class Codebooks:
    """Entries of each part position, with running counts and sums of what is assigned to them."""

    def __init__(self, first: np.ndarray, parts: int):
        """first: the rows that the entries begin as."""
        widths = [len(x) for x in np.array_split(np.arange(first.shape[1]), parts)] if first.size else []
        self.bounds = np.concatenate([np.zeros(1, int), np.cumsum(widths, dtype=int)])
        self.entries = [first[:, a:b].copy() for a, b in self.spans()]
        self.counts = np.zeros((parts, len(first)), np.int64)
        self.sums = [np.zeros_like(e) for e in self.entries]

    def spans(self) -> list[tuple[int, int]]:
        return list(zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist()))

    def add(self, changes: list[tuple[int, int, int, list[int]]]) -> None:
        """Take in (part, entry, count, sums), then put every used entry at the mean."""
        for part, entry, count, sums in changes:
            self.counts[part, entry] += count
            self.sums[part][entry] += np.array(sums, np.int64)
        for part, e in enumerate(self.entries):
            used = self.counts[part] > 0
            e[used] = self.sums[part][used] // self.counts[part][used, None]

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for e in self.entries for x in e.ravel().tolist()).encode()).hexdigest()


def nearest(rows: np.ndarray, entries: list[np.ndarray], spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distances summed over parts) of integer rows, exactly; ties go to the lower entry."""
    codes, error = np.empty((len(rows), len(spans)), np.uint8), np.zeros(len(rows), np.int64)
    for k, ((a, b), e) in enumerate(zip(spans, entries)):
        x = rows[:, a:b]
        most = max(int(np.abs(x).max(initial=0)), int(np.abs(e).max(initial=0)))
        # as floats, products run faster; they are exact while all sums stay below 2**53
        kind = np.float64 if 4 * most * most * max(b - a, 1) < 1 << 53 else np.int64
        x, e = x.astype(kind), e.astype(kind)
        far = (x * x).sum(1)[:, None] - 2 * (x @ e.T) + (e * e).sum(1)
        best = far.argmin(1)
        codes[:, k] = best
        error += far[np.arange(len(rows)), best].astype(np.int64)
    return codes, error


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column that all have `width` components."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)


def _bytes_of(codes: np.ndarray) -> pa.Array:
    return pa.array([c.tobytes() for c in codes], pa.binary())


def _assign(entries: list[np.ndarray], spans: list[tuple[int, int]]) -> Callable:
    """Rows with code, former code (was) and error under the entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, BLOCK) for b in batches for k in range(0, len(b), BLOCK)):
            codes, error = nearest(_matrix(batch.column("v"), spans[-1][1]), entries, spans)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "label", "v")), batch.column("code"), _bytes_of(codes), pa.array(error)], names=["vec_id", "label", "v", "was", "code", "error"])

    return tidy(run)


def _changes(entries: int, spans: list[tuple[int, int]]) -> Callable:
    """(part, entry, count, sums) of what rows of a task whose code changed take away and bring."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(spans), entries), np.int64)
        sums = [np.zeros((entries, b - a), np.int64) for a, b in spans]
        for batch in (b.slice(k, BLOCK) for b in batches for k in range(0, len(b), BLOCK)):
            new = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, len(spans)).astype(np.int64)
            told = batch.column("was").to_pylist()
            former = np.array([w is not None for w in told], bool)
            old = np.frombuffer(b"".join(w or bytes(len(spans)) for w in told), np.uint8).reshape(-1, len(spans)).astype(np.int64)
            rows = _matrix(batch.column("v"), spans[-1][1])
            for k, (a, b) in enumerate(spans):
                came = np.flatnonzero(~former | (old[:, k] != new[:, k]))
                left = came[former[came]]
                for at, code, sign in ((came, new, 1), (left, old, -1)):
                    np.add.at(counts[k], code[at, k], sign)
                    np.add.at(sums[k], code[at, k], sign * rows[at, a:b])
        part, entry = np.nonzero((counts != 0) | np.stack([s.any(1) for s in sums]))
        if len(part):
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(counts[part, entry]), pa.array([sums[p][e].tolist() for p, e in zip(part, entry)], pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    return tidy(run)


def compress(vectors: DataFrame, vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, v, code, error) and the codebooks after `rounds` rounds; codes are one byte a part."""
    if not 1 <= entries <= 256:
        raise ValueError("a code of one byte has 1 to 256 entries")
    rows = integers(vectors, vector, label)
    order = [F.col("vec_id").asc_nulls_last(), "v", F.col("label").asc_nulls_first()]
    first = rows.orderBy(*order).limit(1).collect()  # one row tells the length
    if not first:
        return cut(rows.select("vec_id", "label", "v", F.lit(None).cast("binary").alias("code"), F.lit(0).cast("long").alias("error"))), Codebooks(np.zeros((0, 0), np.int64), parts)
    width = len(first[0]["v"])
    if width < parts:
        raise ValueError("vectors must have a component a part at least")
    rows = cut(rows.where(F.size("v") == width).withColumn("code", F.lit(None).cast("binary")))
    books = Codebooks(np.array([r["v"] for r in rows.orderBy(*order).limit(entries).collect()], np.int64), parts)  # `entries` rows
    schema = rows.select("vec_id", "label", "v", F.col("code").alias("was"), "code").schema.add("error", "long")
    for _ in range(rounds):
        now = cut(rows.mapInArrow(_assign(books.entries, books.spans()), schema))
        release(rows)
        moved = now.select("v", "was", "code").where("was IS NULL OR was <> code").mapInArrow(_changes(len(books.entries[0]), books.spans()), "part int, entry int, n long, sums array<long>")
        at = F.posexplode("sums").alias("i", "x")
        flat = moved.select("part", "entry", "n", at).groupBy("part", "entry", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        told = flat.groupBy("part", "entry").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("sums"))
        books.add([tuple(r) for r in told.collect()])  # parts * entries rows at most
        rows = now
    last = cut(rows.select("vec_id", "label", "v", "code").mapInArrow(_assign(books.entries, books.spans()), schema))
    release(rows)
    return last.select("vec_id", "label", "v", "code", "error"), books


def decompress(codes: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id and the integer vector that each code stands for."""
    spans, entries = books.spans(), books.entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, max(len(spans), 1))
            told = np.concatenate([entries[k][code[:, k]] for k in range(len(spans))], axis=1) if len(code) else np.zeros((0, 0))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(told.tolist(), pa.list_(pa.int64()))], names=["vec_id", "v"])

    return codes.select("vec_id", "code").mapInArrow(tidy(run), "vec_id long, v array<long>")


def digests(vectors: DataFrame) -> DataFrame:
    """vec_id, code (hex), error, label_error (summed over rows of the label), codebooks_sha256."""
    told, books = compress(vectors)
    rows = told.select("vec_id", "error", F.lower(F.hex("code")).alias("code"), F.struct(F.col("label").isNull().alias("none"), F.col("label").cast("string").alias("name")).alias("l"))
    # a struct of no nulls joins null labels with each other
    rows = rows.withColumn("l", F.struct("l.none", F.coalesce("l.name", F.lit("")).alias("name")))
    sums = cut(rows.groupBy("l").agg(F.sum("error").alias("label_error")))
    with_sum = rows.join(F.broadcast(sums), "l") if sums.count() <= BROADCAST_IDS else salted_join(rows, sums, ["l"], "vec_id")
    return with_sum.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
