"""Substring dedup by sliding sentence spans.

A text is cut into sentences at . ! ? and line ends. A run holds at least two
sentences and `least` words (20); with `long`, one sentence of so many words
is a run by itself. The shortest run that begins at each sentence and the shortest that ends at it are
taken: of a longer run that is repeated these lie within it and hold each of
its sentences, so all of it is marked. Runs are hashed to 128 bits over their
lower-cased words and dealt to buckets that see all documents' runs; every
occurrence but the first, in order of doc_id, text digest and sentence, marks
its sentences for removal.

Null and empty texts have no runs and are kept as they are. Texts with fewer
words than a run are never touched. Rows that share doc_id and text stand for
one document; rows that share a doc_id only are told apart by their texts.
Extra columns are ignored. Null doc_ids come first and are left whole. A run
that occurs in a third of all documents costs its bucket one entry a chunk of
documents. Words are parted by ASCII white space, so a text without any is one
sentence. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm import _bytes
from sievewright.llm._exchange import buckets_of, chunks_of, exchange, travel
from sievewright.llm._shared import cut, sweep, tidy

#: Text whose runs are dealt out together; longer texts are a chunk by themselves.
DEALT = 4 << 20
MIN_WORDS = 20
#: Up to so many ids of documents that lose sentences are sent to every executor.
BROADCAST_IDS = 200_000
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
_Q_INVERSE = np.uint64(pow(0xC2B2AE3D27D4EB4F, -1, 1 << 64))


def sentences(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, first byte of each sentence; documents' bounds among them; word hashes).

    A sentence begins at a word and reaches to the next one's first byte, so
    its end marks and the white space behind it are part of it.
    """
    start, end, hashed = _bytes.words(buf, offs, _bytes.space_words())
    if not len(start):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64), hashed
    stop = np.zeros(256, bool)
    stop[[0x0A, 0x0D, 0x21, 0x2E, 0x3F]] = True
    marks = np.concatenate([[0], np.cumsum(stop[buf])])
    last = np.maximum(end - 1, start)
    # a word's last byte and what follows up to the next word tell whether a sentence ends
    new = np.ones(len(start), bool)
    new[1:] = marks[start[1:]] > marks[last[:-1]]
    bounds = _bytes.per_doc(start, offs)
    new[bounds[:-1][bounds[:-1] < len(start)]] = True
    first = np.flatnonzero(new)
    return first, start[first], np.searchsorted(first, bounds), hashed


def runs(buf: np.ndarray, offs: np.ndarray, least: int = MIN_WORDS, long: int | None = None) -> tuple[np.ndarray, ...]:
    """(document, first sentence in it, end sentence, two hashes) of the shortest runs from and to every sentence."""
    first, _, bounds, hashed = sentences(buf, offs)
    n = len(first)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    after = np.append(first[1:], len(hashed))  # the word behind each sentence
    several = np.ones(n, bool) if long is None else after - first < long
    end = np.searchsorted(after, first + least)
    end = np.maximum(end, np.arange(n) + several)
    good = end < bounds[1:][doc]
    # backwards: the last sentence to begin a run that ends here; where that sentence's own run ends here it is taken already
    begin = np.searchsorted(first, after - least, "right") - 1
    begin = np.minimum(begin, np.arange(n) - several)
    back = np.flatnonzero(begin >= bounds[:-1][doc])
    back = back[end[begin[back]] != back]
    at, to = np.concatenate([np.flatnonzero(good), begin[back]]), np.concatenate([end[good], back])
    begin_word, end_word = first[at], after[to]
    size = (end_word - begin_word).astype(np.uint64)
    up, down = _bytes.powers(len(hashed))
    two = np.cumprod(np.full(len(hashed), _Q, np.uint64))
    two_down = np.cumprod(np.full(len(hashed), _Q_INVERSE, np.uint64))
    out = []
    for values, undo in ((hashed * up, down), (_bytes.mix(hashed) * two, two_down)):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
        out.append(_bytes.mix((total[end_word] - total[begin_word]) * undo[begin_word] + size).view(np.int64))
    return doc[at], at - bounds[doc[at]], to + 1 - bounds[doc[at]], *out


_SPANS = "array<struct<begin:int,end:int,first_doc_id:bigint>>"


def _scatter(buckets: int, least: int = MIN_WORDS, long: int | None = None):
    """Deals the runs of each chunk of documents to buckets, one entry for equal runs.

    To each bucket goes: a the hashes, b, c, d doc_id, text digest and first
    sentence of the chunk's first occurrence, e whether the chunk has another,
    f the run's number in the chunk. The chunk's own row has: a, b, c doc_ids,
    digests and whether the id is null, d numbers, e documents, f sentences
    (first, end) of all occurrences.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            buf, offs = _bytes.text_bytes(batch.column("text"))
            missing = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            ids = batch.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False).astype(np.int64)
            digest = batch.column("digest").to_numpy(zero_copy_only=False)
            for lo, hi in _bytes.chunks(offs, DEALT):
                found = []
                for b, e in _bytes.chunks(offs[lo : hi + 1]):
                    doc, *rest = runs(buf[offs[lo + b] : offs[lo + e]], offs[lo + b : lo + e + 1] - offs[lo + b], least, long)
                    found.append((doc + b, *rest))
                yield from _dealt(ids[lo:hi], digest[lo:hi], missing[lo:hi], [np.concatenate(x) for x in zip(*found)], chunk, buckets)
                chunk += 1

    return run


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the one before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return new


def _dealt(ids: np.ndarray, digest: np.ndarray, missing: np.ndarray, found: list[np.ndarray], chunk: int, buckets: int) -> Iterator[pa.RecordBatch]:
    doc, begin, end, one, two = found
    order = np.lexsort((begin, digest[doc], ids[doc], two, one.view(np.uint64)))
    doc, begin, end, one, two = (x[order] for x in (doc, begin, end, one, two))
    new = _changes(one, two)
    number = (np.cumsum(new) - 1).astype(np.uint32)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(one))[: len(first)] - 1  # a chunk may have no run at all
    other = (ids[doc[first]] != ids[doc[last]]) | (digest[doc[first]] != digest[doc[last]]) | (begin[first] != begin[last])
    yield from travel([(buckets + chunk, chunk, ids, digest, missing.astype(np.uint8), number, doc.astype(np.uint32), np.stack([begin, end], 1).astype(np.int32))])
    bucket = ((one[first].view(np.uint64) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    hashes = np.stack([one[first], two[first]], 1)
    parts = (hashes, ids[doc[first]], digest[doc[first]], begin[first].astype(np.int32), other.astype(np.uint8), number[first])
    yield from travel([(k, chunk, *(x[cuts[k] : cuts[k + 1]] for x in parts)) for k in np.flatnonzero(np.diff(cuts)).tolist()])


def _count(buckets: int):
    """Finds each run's first occurrence, a bucket at a time; tells the chunks about runs with others.

    Told are, by chunk: a the runs' numbers there, b, c, d doc_id, digest and sentence of the first occurrence.
    """

    def counted(bucket: int, rows: list[tuple]) -> list[tuple]:
        kinds = (np.int64, np.int64, np.int64, np.int32, np.uint8, np.uint32)
        hashes, ids, digest, begin, other, number = (np.concatenate([np.frombuffer(r[k + 1], kind) for r in rows]) for k, kind in enumerate(kinds))
        one, two = hashes.reshape(-1, 2).T
        source = np.repeat(np.arange(len(rows)), [len(r[5]) for r in rows])
        order = np.lexsort((begin, digest, ids, two, one))
        one, two, ids, digest, begin, other, number, source = (x[order] for x in (one, two, ids, digest, begin, other, number, source))
        new = _changes(one, two)
        first, group = np.flatnonzero(new), np.cumsum(new) - 1
        last = np.append(first[1:], len(one)) - 1
        many = np.logical_or.reduceat(other > 0, first) | (ids[first] != ids[last]) | (digest[first] != digest[last]) | (begin[first] != begin[last])
        keep = np.flatnonzero(many[group])
        keep = keep[np.argsort(source[keep], kind="stable")]
        cuts = np.searchsorted(source[keep], np.arange(len(rows) + 1))
        of = first[group[keep]]
        told = (number[keep], ids[of], digest[of], begin[of])
        return [(bucket, r[0], *(x[cuts[i] : cuts[i + 1]] for x in told), None, None) for i, r in enumerate(rows) if cuts[i + 1] > cuts[i]]

    return buckets_of(buckets, ("chunk", *"abcdef"), counted)


def _gather(buckets: int):
    """The spans of each chunk's documents that occur before; rows come sorted by chunk."""

    def gathered(own: tuple, told: list[tuple]) -> pa.RecordBatch:
        ids, digest, missing, number, doc, places = (np.frombuffer(x, kind) for x, kind in zip(own, (np.int64, np.int64, np.uint8, np.uint32, np.uint32, np.int32)))
        places = places.reshape(-1, 2)
        which, first, first_digest, begin = (np.concatenate([np.frombuffer(t[k], kind) for t in told]) if told else np.zeros(0, kind) for k, kind in enumerate((np.uint32, np.int64, np.int64, np.int32)))
        at = np.full(int(number[-1]) + 1 if len(number) else 0, -1)
        at[which] = np.arange(len(which))
        hit = np.flatnonzero((at[number] >= 0) & (missing[doc] == 0))
        of = at[number[hit]]
        later = (ids[doc[hit]] != first[of]) | (digest[doc[hit]] != first_digest[of]) | (places[hit, 0] != begin[of])
        hit, of = hit[later], of[later]
        order = np.argsort(doc[hit], kind="stable")
        hit, of = hit[order], of[order]
        docs, cuts = np.unique(doc[hit], return_index=True)
        source = first[of]
        span = pa.StructArray.from_arrays([pa.array(places[hit, 0]), pa.array(places[hit, 1]), pa.array(source, mask=source == np.iinfo(np.int64).min)], names=["begin", "end", "first_doc_id"])
        return pa.RecordBatch.from_arrays([pa.array(ids[docs]), pa.array(digest[docs]), pa.ListArray.from_arrays(pa.array(np.append(cuts, len(hit)).astype(np.int32)), span)], names=["doc_id", "digest", "spans"])

    return chunks_of(buckets, gathered)


def _with_digest(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("text").alias("digest"))


def repeated(docs: DataFrame, least: int = MIN_WORDS, long: int | None = None) -> DataFrame:
    """doc_id, digest (xxhash64 of the text) and spans: of each document the runs that are not the first of their kind.

    A span has begin, end (sentences) and first_doc_id, where its run comes first.
    """
    return exchange(_with_digest(docs), lambda buckets: _scatter(buckets, least, long), _count, _gather, f"doc_id long, digest long, spans {_SPANS}").dropDuplicates(["doc_id", "digest"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offs = _bytes.text_bytes(batch.column("text"))
        spans = batch.column("spans")
        hit = np.flatnonzero(~np.asarray(spans.is_null().to_numpy(zero_copy_only=False)))
        n, texts = len(batch), batch.column("text").to_pylist()
        total, removed, gone, froms = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), [[] for _ in range(n)]
        for lo, hi in _bytes.chunks(offs):
            own = offs[lo : hi + 1] - offs[lo]
            part = buf[offs[lo] : offs[hi]]
            first, at, bounds, hashed = sentences(part, own)
            total[lo:hi] = np.diff(bounds)
            after = np.append(first[1:], len(hashed))
            for d in hit[(hit >= lo) & (hit < hi)]:
                b, e = bounds[d - lo], bounds[d - lo + 1]
                bad = np.zeros(e - b, bool)
                sources = set()
                for s in spans[int(d)].as_py():
                    bad[s["begin"] : s["end"]] = True
                    sources.add(s["first_doc_id"])
                # the text before the first sentence stays with it
                edges = np.append(at[b:e], own[d - lo + 1])
                if e > b:
                    edges[0] = own[d - lo]
                texts[d] = b"".join(part[edges[k] : edges[k + 1]].tobytes() for k in np.flatnonzero(~bad)).decode()
                removed[d], gone[d] = bad.sum(), (after[b:e] - first[b:e])[bad].sum()
                froms[d] = sorted(x for x in sources if x is not None)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total), pa.array(removed), pa.array(gone), pa.array(froms, pa.list_(pa.int64())), pa.array(texts, pa.string())], names=["doc_id", "n_sentences", "n_removed", "n_removed_words", "first_doc_ids", "text"])


def dedup(docs: DataFrame, least: int = MIN_WORDS, long: int | None = None) -> DataFrame:
    """doc_id, n_sentences, n_removed, n_removed_words, first_doc_ids (where the removed runs come first) and the text left."""
    marked = cut(repeated(docs, least, long))
    sweep(docs.sparkSession)
    rows, schema = _with_digest(docs), "doc_id long, n_sentences long, n_removed long, n_removed_words long, first_doc_ids array<long>, text string"
    if marked.count() > BROADCAST_IDS:
        return rows.join(marked, ["doc_id", "digest"], "left").mapInArrow(tidy(_cut), schema)
    # only texts that lose sentences move
    ids = F.broadcast(marked.select("doc_id", "digest"))
    whole = rows.join(ids, ["doc_id", "digest"], "left_anti").withColumn("spans", F.lit(None).cast(_SPANS))
    return rows.join(ids, ["doc_id", "digest"], "left_semi").join(marked, ["doc_id", "digest"]).unionByName(whole).mapInArrow(tidy(_cut), schema)
