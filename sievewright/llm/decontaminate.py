"""Benchmark decontamination by suffix arrays over the training text.

A shard is SHARD_BYTES of documents, or one longer text. Its suffix array orders the places at which a
window of the benchmark could begin, by the words that follow; every window of
every benchmark item (that is, every test suffix of at least the window's
length) is found in it by binary search, which gives all places of the match,
and matches at consecutive places of the same item join to the longest verbatim
match. Words unknown to the benchmark end a suffix, so places with fewer known
words ahead than the shortest window has cannot match and are left out.

An item with fewer words than a window is one window as a whole; an item
without words matches nothing. Null and empty texts have no words: n_words 0,
not contaminated. An empty benchmark leaves every document clean; an item
without id is one of its own, named by an empty string. Repeated rows, and rows with a null doc_id, are
judged one by one, each by its own text; judge() ignores extra columns, clean()
keeps them. The benchmark, which is small against the corpus, is sent to the
workers in slices of at most SLICE_BYTES of text; all are searched in one scan.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.llm import _bytes
from sievewright.llm._shared import KEPT, tidy

WINDOW = 13
#: Text of a benchmark slice that is held in a worker at once.
SLICE_BYTES = 16 << 20
#: Text whose places are put into one suffix order; it bounds a worker's memory.
SHARD_BYTES = 4 << 20
#: A document is contaminated if at least this share of its words is hit.
SHARE = 20

FOUND = "doc_id long, n_words long, spans array<struct<begin:int,end:int>>, items array<string>, longest int, longest_item string, longest_at int"


class Nameless(str):
    """The name that an item without id goes by; outside it is empty."""


#: Windows that a worker has built, of the last benchmark that it was asked for.
_BUILT: dict[str, list[Windows]] = {}


class Windows:
    """The benchmark's windows, by length, as sorted rows of word numbers."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        texts = pa.array([t or "" for _, t in items], pa.string())
        buf, offs = _bytes.text_bytes(texts)
        start, _, hashed = _bytes.words(buf, offs, _bytes.letter_words())
        bounds = _bytes.per_doc(start, offs)
        self.items = [i for i, _ in items]
        self.vocabulary = np.unique(hashed)
        word = (np.searchsorted(self.vocabulary, hashed) + 1).astype(np.int64)
        # every place of every item that a window begins at; an item of fewer words is one window
        size = np.minimum(window, np.diff(bounds))
        many = np.where(size > 0, np.diff(bounds) - size + 1, 0)
        item = np.repeat(np.arange(len(items)), many)
        place = np.arange(int(many.sum())) - (np.cumsum(many) - many)[item]
        at, size = bounds[:-1][item] + place, size[item]
        self.longest = int(size.max(initial=1))
        #: what windows of two words or more begin with, and windows of one word
        several = at[size > 1]
        self.firsts = np.unique(word[several] << 32 | word[several + 1])
        self.singles = np.unique(word[at[size == 1]])
        #: length -> (least and largest suffix that begins with each window, item, place in the item)
        self.by_length = {}
        for n in np.unique(size).tolist():
            own = np.flatnonzero(size == n)
            low, high = (_keys(word, at[own], self.longest, np.full(len(own), n), rest) for rest in (0, (1 << 32) - 1))
            self.by_length[n] = low, high, item[own], place[own]


def _keys(word: np.ndarray, at: np.ndarray, size: int, ahead: np.ndarray, rest: int = 0) -> np.ndarray:
    """`size` words from each place, `rest` behind the first `ahead`, as byte strings that sort as the words do."""
    steps = np.arange(size)
    rows = np.where(steps < ahead[:, None], word[np.minimum(at[:, None] + steps, max(len(word) - 1, 0))], rest).astype(">u4")
    # a last byte of one keeps numpy from cutting zeros off
    ended = np.ones((len(at), 4 * size + 1), np.uint8)
    ended[:, :-1] = np.ascontiguousarray(rows).view(np.uint8).reshape(len(at), 4 * size)
    return ended.view(f"S{4 * size + 1}").ravel()


def _known_words(buf: np.ndarray, offs: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each word, 0 if the vocabulary lacks it; documents' bounds among the words)."""
    out, bounds, done = [], [np.zeros(1, np.int64)], 0
    for lo, hi in _bytes.chunks(offs):
        own = offs[lo : hi + 1] - offs[lo]
        start, _, hashed = _bytes.words(buf[offs[lo] : offs[hi]], own, _bytes.letter_words())
        at = np.searchsorted(vocabulary, hashed)
        at[at == len(vocabulary)] = 0
        out.append(np.where(vocabulary[at] == hashed, at + 1, 0).astype(np.int32) if len(vocabulary) else np.zeros(len(hashed), np.int32))
        bounds.append(done + _bytes.per_doc(start, own)[1:])
        done += len(start)
    return np.concatenate(out) if out else np.zeros(0, np.int32), np.concatenate(bounds)


def _search(word: np.ndarray, bounds: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, item, place in the item, length) of every occurrence of a window."""
    n = len(word)
    stop = np.zeros(n + 1, bool)  # a run of known words ends before these
    stop[bounds] = True
    stop[:n] |= word == 0
    stop[n] = True
    ends = np.flatnonzero(stop)
    # the first stop after a place tells how many known words lie ahead; an unknown word begins nothing
    at = np.flatnonzero(word)
    ahead = np.minimum(ends[np.searchsorted(ends, at, side="right")] - at, windows.longest)
    pair = word[at].astype(np.int64) << 32 | np.where(ahead > 1, word[np.minimum(at + 1, n - 1)], 0)
    near = np.searchsorted(windows.firsts, pair) if len(windows.firsts) else np.zeros(0, np.int64)
    near[near == len(windows.firsts)] = 0
    begins = windows.firsts[near] == pair if len(windows.firsts) else np.zeros(len(at), bool)
    lone = windows.singles[np.minimum(np.searchsorted(windows.singles, word[at]), len(windows.singles) - 1)] == word[at] if len(windows.singles) else np.zeros(len(at), bool)
    begins |= lone
    at, ahead = at[begins], ahead[begins]
    # the shard's suffix array: places in order of the words that follow, as far as a window reaches
    suffixes = _keys(word, at, windows.longest, ahead)
    order = np.argsort(suffixes, kind="stable")
    suffixes, at = suffixes[order], at[order]
    found = []
    for size, (low, high, item, place) in windows.by_length.items():
        left, right = np.searchsorted(suffixes, low, "left"), np.searchsorted(suffixes, high, "right")
        count = right - left
        hit = np.flatnonzero(count)
        if not len(hit):
            continue
        which = np.repeat(hit, count[hit])
        step = np.arange(count[hit].sum()) - np.repeat(np.cumsum(count[hit]) - count[hit], count[hit])
        found.append((at[left[which] + step], item[which], place[which], np.full(len(which), size)))
    if not found:
        z = np.zeros(0, np.int64)
        return z, z, z, z
    return tuple(np.concatenate(x) for x in zip(*found))


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [(b, e) for b, e in out]


def _document(first: int, hits: tuple, windows: Windows) -> tuple:
    """Spans, items and the longest match of one document whose words begin at `first`."""
    at, item, place, size = hits
    at = at - first
    order = np.lexsort((at, at - place, item))
    at, item, place, size = (x[order] for x in (at, item, place, size))
    # consecutive places of one item, at consecutive places here, are one match
    new = np.ones(len(at), bool)
    new[1:] = (item[1:] != item[:-1]) | (np.diff(at - place) != 0) | (np.diff(at) != 1)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(at)) - 1
    length = at[end] + size[end] - at[begin]
    best = min(range(len(begin)), key=lambda k: (-length[k], at[begin[k]], windows.items[item[begin[k]]]))
    spans = _merge(list({(int(at[b]), int(at[b] + n)) for b, n in zip(begin, length)}))
    return spans, sorted({windows.items[i] for i in set(item.tolist())}), int(length[best]), windows.items[item[begin[best]]], int(at[begin[best]])


def _found(text: pa.Array, slices: list[Windows], shard_bytes: int = SHARD_BYTES) -> tuple[np.ndarray, list[tuple]]:
    """(number of words, (spans, items, longest match, its item, its place)) of each text, a shard at a time."""
    buf, offs = _bytes.text_bytes(text)
    n, out = np.zeros(len(offs) - 1, np.int64), []
    for lo, hi in _bytes.chunks(offs, shard_bytes):
        n[lo:hi], told = _in_shard(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], slices)
        out += told
    return n, out


def _in_shard(buf: np.ndarray, offs: np.ndarray, slices: list[Windows]) -> tuple[np.ndarray, list[tuple]]:
    got: list[list[tuple]] = [[] for _ in range(len(offs) - 1)]
    n = np.zeros(len(offs) - 1, np.int64)
    for windows in slices:
        word, bounds = _known_words(buf, offs, windows.vocabulary)
        n = np.diff(bounds)
        hits = _search(word, bounds, windows)
        doc = np.searchsorted(bounds, hits[0], side="right") - 1
        order = np.argsort(doc, kind="stable")
        hits, doc = [x[order] for x in hits], doc[order]
        cuts = np.searchsorted(doc, np.arange(len(bounds)))
        for d in np.flatnonzero(np.diff(cuts)).tolist():
            own = slice(cuts[d], cuts[d + 1])
            got[d].append(_document(bounds[d], [x[own] for x in hits], windows))
    out = []
    for own in got:
        best = min(own, key=lambda x: (-x[2], x[4], x[3])) if own else ([], [], 0, None, None)
        out.append((_merge([s for x in own for s in x[0]]), sorted({i for x in own for i in x[1]}), *best[2:]))
    return n, out


def _windows(spark: SparkSession, benchmark: DataFrame, window: int, slice_bytes: int):
    """A function that gives the benchmark's slices, one after the other, in a worker."""
    shared = [spark.sparkContext.broadcast(own) for own in _slices(benchmark, slice_bytes)]
    key = uuid.uuid4().hex

    def get() -> list[Windows]:
        if key not in _BUILT:  # once a worker, not once a task
            _BUILT.clear()
            _BUILT[key] = [Windows(own.value, window) for own in shared]
        KEPT["decontaminate"] = _BUILT.clear
        return _BUILT[key]

    return get


def _slices(benchmark: DataFrame, most: int) -> Iterator[list[tuple[str, str | None]]]:
    """Items in order of their ids as text, in slices of at most `most` bytes (or one item)."""
    own, size, nameless = [], 0, 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).orderBy("i").toLocalIterator():
        more = len((r["t"] or "").encode())
        if own and size + more > most:
            yield own
            own, size = [], 0
        nameless += r["i"] is None
        own.append((Nameless(f"\0{nameless:012d}") if r["i"] is None else r["i"], r["t"]))
        size += more
    yield own


def _said(item: str | None) -> str | None:
    return "" if isinstance(item, Nameless) else item


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """A row a document: doc_id, n_words, spans of hit words, items met, the longest match and where it is."""
    slices = _windows(docs.sparkSession, benchmark, window, slice_bytes)
    span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = slices()
        for batch in batches:
            n, found = _found(batch.column("text"), own)
            spans, names, longest, which, where = zip(*found) if found else [()] * 5
            names, which = [[_said(i) for i in x] for x in names], [_said(i) for i in which]
            columns = [batch.column("doc_id"), pa.array(n), pa.array([[{"begin": b, "end": e} for b, e in x] for x in spans], span), pa.array(names, pa.list_(pa.string())), pa.array(longest, pa.int32()), pa.array(which, pa.string()), pa.array(where, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "spans", "items", "longest", "longest_item", "longest_at"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run, "decontaminate"), FOUND)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The rows of docs that aren't contaminated, all columns as they are; each row is judged by its own text, ids don't matter."""
    slices = _windows(docs.sparkSession, benchmark, window, slice_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = slices()
        for batch in batches:
            n, found = _found(batch.column("text"), own)
            hit = np.array([sum(e - b for b, e in x[0]) for x in found], np.int64)
            yield batch.filter(pa.array(~((hit > 0) & (SHARE * hit >= n))))

    return docs.mapInArrow(tidy(run, "decontaminate"), docs.schema)


def judge(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, then the longest match."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["begin"]))
    return find(docs, benchmark, window).select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((hit > 0) & (SHARE * hit >= F.col("n_words"))).alias("contaminated"),
        "longest", "longest_item", "longest_at",
    )
