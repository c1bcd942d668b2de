"""What the operators share: cutting lineage, leaving out ids, tidy workers, and joins that no key can crowd."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.operators.lineage import cut, release, sweep

__all__ = ["BROADCAST_IDS", "cut", "release", "salted_join", "KEPT", "sweep", "tidy", "without"]

#: Up to so many ids are sent to every executor; more are joined by a shuffle.
BROADCAST_IDS = 200_000
#: Parts that the rows of one key are dealt to in a join.
SALTS = 16


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs but those whose doc_id is in ids; null ids stay."""
    gone = cut(ids.select("doc_id").where(F.col("doc_id").isNotNull()).distinct())
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], by: str, how: str = "inner") -> DataFrame:
    """left joined with the one row that right has for each key; a hot key's rows are dealt by `by` to SALTS parts.

    right is repeated for every part, so it should be the small side. `how` is
    inner, left or left_semi.
    """
    part = "_part"
    dealt = left.withColumn(part, F.pmod(F.xxhash64(F.lit("part"), by), F.lit(SALTS)).cast("int"))
    spread = right.withColumn(part, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(spread, [*keys, part], how).drop(part)


#: What operators keep in a worker from task to task: operator -> how to drop it.
KEPT: dict[str, Callable[[], None]] = {}


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: str = "") -> Callable:
    """run for mapInArrow, in workers that later tasks use again.

    Before it, what operators other than `keeps` have kept is dropped; behind it, free memory is given back.
    """

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        others = [x for x in KEPT if x != keeps]
        for name in others:
            KEPT.pop(name)()
        if others:  # before anything new is built beside it
            gc.collect()
            give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return inner


def give_back() -> None:
    """Free memory of Arrow and of the C library goes to the system; elsewhere than with glibc only Arrow's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
