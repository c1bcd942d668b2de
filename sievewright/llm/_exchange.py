"""Chunks of documents ask buckets of keys about all documents, and get answers.

A chunk deals its keys to buckets, packed, a row a bucket; a bucket sees every
chunk's keys and answers each chunk, packed again; a chunk puts its answers
together. Keys move as numbers in a few long rows, so nothing is sorted row by
row, and a key that very many documents share costs one entry a chunk. Chunks
are numbered by partition and place in it, so a lost executor's are dealt
alike when they are computed again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sievewright.llm._shared import tidy

#: key: the bucket, or buckets + chunk in the row that a chunk keeps for itself; chunk; packed arrays.
TRAVEL = "key long, chunk long, a binary, b binary, c binary, d binary, e binary, f binary"
_NAMES = ["key", "chunk", "a", "b", "c", "d", "e", "f"]
_ROWS = 256


def travel(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows (key, chunk, six arrays or None) in batches."""
    for k in range(0, len(rows), _ROWS):
        key, chunk, *packed = zip(*rows[k : k + _ROWS])
        columns = [pa.array([None if x is None else np.ascontiguousarray(x).tobytes() for x in p], pa.binary()) for p in packed]
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(chunk, pa.int64()), *columns], names=_NAMES)


def buckets_of(buckets: int, columns: tuple[str, ...], answer: Callable[[int, list[tuple]], list[tuple]]) -> Callable:
    """Applies answer(bucket, rows of the columns) to a bucket at a time; rows come sorted by key, the chunks' own pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for batch in batches:
            keys, own = batch.column("key").to_pylist(), [batch.column(c) for c in columns]
            for i, key in enumerate(keys):
                if key != bucket:
                    if held:
                        yield from travel(answer(bucket, held))
                    bucket, held = key, []
                if key < buckets:
                    held.append(tuple(c[i].as_py() for c in own))
                else:
                    yield batch.slice(i, 1)
        if held:
            yield from travel(answer(bucket, held))

    return run


def chunks_of(buckets: int, gather: Callable[[tuple, list[tuple]], pa.RecordBatch]) -> Callable:
    """Applies gather(the chunk's own row, its answers) to a chunk at a time; rows come sorted by chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, own, told = None, None, []
        for batch in batches:
            keys, chunks = batch.column("key").to_pylist(), batch.column("chunk").to_pylist()
            packed = [batch.column(c) for c in _NAMES[2:]]
            for i, (key, at) in enumerate(zip(keys, chunks)):
                if at != chunk:
                    if own is not None:
                        yield gather(own, told)
                    chunk, own, told = at, None, []
                row = tuple(c[i].as_py() for c in packed)
                if key >= buckets:
                    own = row
                else:
                    told.append(row)
        if own is not None:
            yield gather(own, told)

    return run


def exchange(rows: DataFrame, scatter: Callable, count: Callable, gather: Callable, schema: str) -> DataFrame:
    """scatter(buckets), count(buckets) and gather(buckets) one behind the other; four buckets a shuffle partition."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * parts
    dealt = rows.mapInArrow(tidy(scatter(buckets)), TRAVEL)
    answered = dealt.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(tidy(count(buckets)), TRAVEL)
    return answered.repartition(parts, "chunk").sortWithinPartitions("chunk").mapInArrow(tidy(gather(buckets)), schema)
