"""Alignment of two tokenizers: groups of tokens that cover the same bytes, and how often token pairs end together.

Texts are cut at spaces between two characters that are no white space: both
vocabularies begin a token there, so what stands between is tokenised by both
once and remembered, with its groups and the links in them. Chunks of documents
count their links by pair before anything moves. Pairs are striped by the id
of the second vocabulary (B): a stripe's counts are a dense matrix, filled by
np.add.at, and the maximum of each row is the id's best. The counts then meet
the chunks' links in the same stripes, and a chunk adds up its documents.

A stripe's rows are dealt to as many parts as the chunks make necessary, each
with a matrix of its own, whose entries are summed up before the maxima are
taken, so a token that makes up a third of a corpus costs no task more than
its share. Chunks are numbered once, in a table, so a lost executor's are the
same when they are read again.

Null and empty texts, and texts whose tokens' bytes aren't those of a space
and the text (U+2581 in a text reads as a space in B), have no tokens: zeros,
and an empty digest. Every row is a document of its own, doc_ids may repeat or
be null. Ties for the highest count are all best. A text without spaces is
tokenised as a whole. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm import _bytes
from sievewright.llm._agenda import Agenda
from sievewright.llm._exchange import TRAVEL, travel
from sievewright.llm._shared import KEPT, cut, release, tidy
from sievewright.llm.pieces import SPACE, PieceModel, code_points, read_model

#: Text whose links are counted together; longer texts are a chunk by themselves.
DEALT = 4 << 20
#: Ids of B a stripe: with 50,000 ids of A its matrix takes 51 MB.
STRIPE = 128
#: Chunks of which one part of a stripe takes the counts.
CHUNKS_A_PART = 2048
#: A worker forgets its units once they have so many characters, some 16 a unit added; about 75 MB.
MOST_KEPT = 4_000_000
_REGULAR = re.compile(r"(?<=\S)(?= \S)").split


class ByteModel:
    """A byte-level merge vocabulary in the tokenizers library's JSON form."""

    def __init__(self, data: bytes, pattern: str):
        import regex

        model = json.loads(data)["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges"):
            raise ValueError("only plain byte-level merge vocabularies can be used")
        byte = {c: b for b, c in enumerate(_letters())}
        self.bytes_of = {i: bytes(byte[c] for c in token) for token, i in model["vocab"].items() if all(c in byte for c in token)}
        vocab = model["vocab"]
        self.size = max(vocab.values()) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        table = np.array([(vocab[a], vocab[b], k, vocab[a + b]) for k, (a, b) in enumerate(pairs)], np.int64).reshape(-1, 4)
        self.agenda = Agenda(*table.T, self.size)
        self.symbol_of = np.array([vocab[c] for c in _letters()], np.int32)
        self.split = regex.compile(pattern).findall

    def encode(self, units: list[str], regular: np.ndarray) -> np.ndarray:
        """Ids of the units, one behind the other; runs of regular units are split by the pattern together, others one by one."""
        pieces: list[str] = []
        cuts = np.flatnonzero(np.diff(regular, prepend=False, append=False) | ~np.append(regular, True)).tolist()
        for lo, hi in zip(sorted({0, *cuts}), sorted({*cuts, len(units)} - {0})):
            pieces += self.split("".join(units[lo:hi]))
        text = "".join(units)
        ends = _byte_offsets(text)[np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))]
        return self.agenda.run(self.symbol_of[np.frombuffer(text.encode(), np.uint8)], np.diff(ends, prepend=0))[0]


def _byte_offsets(text: str) -> np.ndarray:
    """The first byte of each character in UTF-8, and the end."""
    points = code_points(text)
    return np.concatenate([[0], np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))])


def _letters() -> list[str]:
    """The character that stands for each byte: itself where it prints, else the next one from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in prints else next(rest)) for b in range(256)]


class Aligner:
    """What both vocabularies make of units of text, remembered by number."""

    def __init__(self, a: bytes, pattern: str, b: bytes):
        self.a, self.b = ByteModel(a, pattern), PieceModel(b)
        self.wide = len(self.b.pieces)
        if not self.b.parts_at_spaces or not self.b.prefix:
            raise ValueError("tokens of the second vocabulary must begin at spaces, with one put in front")
        self.clear()

        told = (np.array([self.a.bytes_of.get(i, b"") for i in range(self.a.size)], object), np.array(self.b.bytes_of, object))
        self.told = told
        self.long = [np.array(list(map(len, t))) for t in told]
        # an id in decimal as it stands within a group and at its end: A's part ends with |, B's with ;
        self.marked = [np.array([f"{i}{m}" for i in range(len(t)) for m in (",", last)], object) for t, last in zip(told, "|;")]
        self.marked_long = [np.array(list(map(len, m))) for m in self.marked]

    def clear(self) -> None:
        """Forget all units."""
        self.number: dict[str, int] = {}
        self.said: list[str] = []
        self.kept = 0
        #: of each unit: tokens of A, tokens of B, groups (which are its links too), and whether its bytes come back
        self.sizes = np.zeros((0, 4), np.int64)
        #: the links of all units, b * size of A + a
        self.links = np.zeros(0, np.int64)

    def learn(self, units: list[str]) -> None:
        """Tokenise new units and remember their groups and links."""
        # where a text holds U+2581 itself, B's tokens say a space
        good = [u for u in units if SPACE not in u]
        if len(good) < len(units):
            self._bad([u for u in units if SPACE in u])
        if not good:
            return
        text = "".join(good)
        # regular units begin with a space before something else, and end in something else
        regular = np.fromiter((len(u) > 1 and u[0] == " " and not u[1].isspace() and not u[-1].isspace() for u in good), bool, len(good))
        points = code_points(text.replace(" ", SPACE))
        sizes = np.fromiter(map(len, good), np.int64, len(good))
        ids = [self.a.encode(good, regular), self.b.merged(points, sizes)[0]]
        whole = text.encode()
        if any(b"".join(t[i].tolist()) != whole for t, i in zip(self.told, ids)):
            if len(good) == 1:
                self._bad(good)
            else:
                for u in good:
                    self.learn([u])
            return
        ends = [np.cumsum(n[i]) for n, i in zip(self.long, ids)]
        common = np.intersect1d(*ends, assume_unique=True)
        group = [np.searchsorted(common, e) for e in ends]
        last = [common[g] == e for g, e in zip(group, ends)]
        # A's tokens of a group, then B's
        place = [np.arange(len(group[0])) + np.searchsorted(group[1], group[0]), np.arange(len(group[1])) + np.searchsorted(group[0], group[1], "right")]
        words, widths = np.empty(len(place[0]) + len(place[1]), object), np.empty(len(place[0]) + len(place[1]), np.int64)
        for side in (0, 1):
            kind = ids[side] * 2 + last[side]
            words[place[side]], widths[place[side]] = self.marked[side][kind], self.marked_long[side][kind]
        said = "".join(words.tolist())
        unit_group = np.searchsorted(common, _byte_offsets(text)[np.cumsum(sizes)])
        upto = [np.concatenate([[0], np.searchsorted(g, unit_group, "right")]) for g in group]
        cuts = np.concatenate([[0], np.cumsum(widths)])[upto[0] + upto[1]].tolist()
        groups = np.diff(unit_group, prepend=-1)
        first = len(self.said)
        self.said += [said[x:y] for x, y in zip(cuts, cuts[1:])]
        self.number.update(zip(good, range(first, len(self.said))))
        self.sizes = np.concatenate([self.sizes, np.stack([np.diff(upto[0]), np.diff(upto[1]), groups, np.ones(len(good), np.int64)], 1)])
        self.links = np.concatenate([self.links, ids[1][last[1]].astype(np.int64) * self.a.size + ids[0][last[0]]])
        self.kept += len(text) + 16 * len(good)

    def _bad(self, units: list[str]) -> None:
        self.number.update(zip(units, range(len(self.said), len(self.said) + len(units))))
        self.said += [""] * len(units)
        self.sizes = np.concatenate([self.sizes, np.zeros((len(units), 4), np.int64)])
        self.kept += sum(map(len, units)) + 16 * len(units)

    def chunk(self, texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """(digests of the groups; tokens of A, tokens of B and links of each text; the links in order)."""
        if self.kept > MOST_KEPT:
            self.clear()
        units = [_REGULAR(" " + t) if t else [] for t in texts]
        self.learn(list(set().union(*units).difference(self.number)))
        flat = list(map(self.number.__getitem__, chain.from_iterable(units)))
        at = np.array(flat, np.int64)
        bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))])
        total = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(self.sizes[at], axis=0)])
        counts = total[bounds[1:]] - total[bounds[:-1]]
        bad = counts[:, 3] < np.diff(bounds)
        counts[bad] = 0
        said, cuts = self.said, bounds.tolist()
        digests = [hashlib.sha256("".join(map(said.__getitem__, flat[x:y]))[:-1].encode()).digest() if n else b"" for x, y, n in zip(cuts, cuts[1:], counts[:, 0].tolist())]
        at = at[~np.repeat(bad, np.diff(bounds))]
        begin = np.cumsum(self.sizes[:, 2]) - self.sizes[:, 2]
        many = self.sizes[at, 2]
        return digests, counts[:, :3], self.links[np.repeat(begin[at] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]


_ALIGNERS: dict[str, Aligner] = {}


def _aligner(key: str, a: bytes, pattern: str, b: bytes) -> Aligner:
    if key not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[key] = Aligner(a, pattern, b)
    KEPT["alignment"] = _ALIGNERS.clear
    return _ALIGNERS[key]


def _scatter(a: bytes, pattern: str, b: bytes) -> Callable:
    """A chunk's own row (key -1) and its counted pairs, a row a stripe.

    The own row: a doc_ids, b which are null, c tokens of A and B and links of each, d digests, e the number of each link's pair.
    A stripe's row: a pairs, b counts, c the number of the first.
    """
    key = f"{zlib.crc32(a)} {zlib.crc32(b)} {pattern}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, chunk = _aligner(key, a, pattern, b), TaskContext.get().partitionId() << 32
        stripe = STRIPE * tool.a.size
        for batch in batches:
            _, offs = _bytes.text_bytes(batch.column("text"))
            for lo, hi in _bytes.chunks(offs, DEALT):
                part = batch.slice(lo, hi - lo)
                digests, counts, links = tool.chunk([t or "" for t in part.column("text").to_pylist()])
                pairs, pair_of, n = np.unique(links, return_inverse=True, return_counts=True)
                missing = part.column("doc_id").is_null().to_numpy(zero_copy_only=False)
                ids = part.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                told = np.frombuffer(b"".join(d or bytes(32) for d in digests), np.uint8)
                rows = [(-1, chunk, ids, missing.astype(np.uint8), counts, told, pair_of.astype(np.uint32 if len(pairs) >> 16 else np.uint16), np.array([len(pairs)]))]
                cuts = np.searchsorted(pairs, np.arange(0, tool.wide * tool.a.size + stripe, stripe))
                for k in np.flatnonzero(np.diff(cuts)).tolist():
                    x, y = cuts[k], cuts[k + 1]
                    rows.append((k, chunk, pairs[x:y], n[x:y], np.array([x]), None, None, None))
                yield from travel(rows)
                chunk += 1

    return tidy(run, "alignment")


def _matrix(size: int, best: bool) -> Callable:
    """Adds up pairs and counts of each key (stripe, part), rows sorted by it, in a dense matrix; with `best`, c says which are the best of their row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, np.zeros((STRIPE, size), np.int64)

        def told() -> Iterator[pa.RecordBatch]:
            row, col = np.nonzero(block)
            n = block[row, col]
            top = (n == block.max(axis=1)[row]).astype(np.uint8) if best else None
            stripe = at[0]
            block[row, col] = 0
            return travel([(stripe, at[1], (row + stripe * STRIPE) * size + col, n, top, None, None, None)])

        for batch in batches:
            keys = zip(batch.column("key").to_pylist(), batch.column("part").to_pylist())
            for i, key in enumerate(keys):
                if key != at:
                    if at is not None:
                        yield from told()
                    at = key
                pairs = np.frombuffer(batch.column("a")[i].as_py(), np.int64)
                np.add.at(block, (pairs // size - key[0] * STRIPE, pairs % size), np.frombuffer(batch.column("b")[i].as_py(), np.int64))
        if at is not None:
            yield from told()

    return tidy(run)


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts (a) and whether best (b) of each chunk's pairs, from c on; a stripe's counts come ahead of the chunks that ask."""
    known = counts = top = None
    for batch in batches:
        rows = []
        for i, (key, chunk, first) in enumerate(zip(batch.column("key").to_pylist(), batch.column("chunk").to_pylist(), batch.column("first").to_pylist())):
            pairs = np.frombuffer(batch.column("a")[i].as_py(), np.int64)
            if first:
                known, counts, top = pairs, np.frombuffer(batch.column("b")[i].as_py(), np.int64), np.frombuffer(batch.column("c")[i].as_py(), np.uint8)
                continue
            at = np.searchsorted(known, pairs)
            rows.append((key, chunk, counts[at], top[at], np.frombuffer(batch.column("c")[i].as_py(), np.int64), None, None, None))
        if rows:
            yield from travel(rows)


_SCORED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of each chunk; its own row comes ahead of the answers."""
    own, counts, top = None, None, None

    def told() -> pa.RecordBatch:
        kinds = (np.int64, np.uint8, np.int64, np.uint8)
        ids, missing, sizes, digests = (np.frombuffer(x, k) for x, k in zip(own, kinds))
        sizes = sizes.reshape(-1, 3)
        pair_of = np.frombuffer(own[4], np.uint32 if len(counts) >> 16 else np.uint16)
        cuts = np.concatenate([[0], np.cumsum(sizes[:, 2])])
        total = [np.concatenate([[0], np.cumsum(x[pair_of], dtype=np.int64)]) for x in (top, counts)]
        best, summed = (t[cuts[1:]] - t[cuts[:-1]] for t in total)
        hexed = digests.tobytes().hex()
        said = [hexed[64 * k : 64 * k + 64] if n else "" for k, n in enumerate(sizes[:, 0].tolist())]
        columns = [pa.array(ids, mask=missing > 0), *(pa.array(np.ascontiguousarray(x)) for x in (sizes[:, 0], sizes[:, 1], sizes[:, 2], sizes[:, 2], best, summed)), pa.array(said, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _SCORED.split(", ")])

    for batch in batches:
        for i, key in enumerate(batch.column("key").to_pylist()):
            cell = lambda c: batch.column(c)[i].as_py()  # noqa: B023, E731
            if key < 0:
                if own is not None:
                    yield told()
                own = tuple(cell(c) for c in "abcde")
                n = int(np.frombuffer(cell("f"), np.int64)[0])
                counts, top = np.zeros(n, np.int64), np.zeros(n, np.uint8)
                continue
            found, good, begin = (np.frombuffer(cell(c), k) for c, k in zip("abc", (np.int64, np.uint8, np.int64)))
            counts[begin[0] : begin[0] + len(found)], top[begin[0] : begin[0] + len(found)] = found, good
    if own is not None:
        yield told()


def read_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def align(docs: DataFrame, a_path: str, pattern: str, b_path: str, chunks_a_part: int = CHUNKS_A_PART) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document (see the module)."""
    a, (_, b) = read_bytes(a_path), read_model(b_path)
    size = max(json.loads(a)["model"]["vocab"].values()) + 1
    dealt = cut(docs.select("doc_id", "text").mapInArrow(_scatter(a, pattern, b), TRAVEL))
    own, pairs = dealt.where("key < 0"), dealt.where("key >= 0")
    parts = 1 + own.count() // chunks_a_part
    asked = pairs.withColumn("part", F.pmod(F.xxhash64("chunk"), F.lit(parts)))
    counted = asked
    if parts > 1:  # parts of a stripe are summed up before the whole
        counted = asked.select("key", "part", "a", "b").repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(_matrix(size, False), TRAVEL)
    counted = cut(counted.select("key", F.lit(0).alias("part"), "a", "b").repartition("key").sortWithinPartitions("key").mapInArrow(_matrix(size, True), TRAVEL))
    sent = counted.select("key", F.lit(-1).cast("long").alias("chunk"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), "a", "b", "c", F.lit(True).alias("first"))
    asking = asked.select("key", "chunk", "part", "a", F.lit(None).cast("binary").alias("b"), "c", F.lit(False).alias("first"))
    met = sent.unionByName(asking).repartition("key", "part").sortWithinPartitions("key", "part", F.desc("first"))
    answers = met.select("key", "chunk", "first", "a", "b", "c").mapInArrow(tidy(_answer), TRAVEL)
    told = cut(own.unionByName(answers).repartition("chunk").sortWithinPartitions("chunk", "key").mapInArrow(tidy(_gather), _SCORED))
    release(dealt, counted)
    return told


def best_pairs(docs: DataFrame, a_path: str, pattern: str, b_path: str) -> DataFrame:
    """b, a, n: the ids of A that most often end together with each id of B, ties included, over all documents."""
    a, (_, b) = read_bytes(a_path), read_model(b_path)
    size = max(json.loads(a)["model"]["vocab"].values()) + 1
    pairs = docs.select("doc_id", "text").mapInArrow(_scatter(a, pattern, b), TRAVEL).where("key >= 0").select("key", F.lit(0).alias("part"), "a", "b")
    counted = pairs.repartition("key").sortWithinPartitions("key").mapInArrow(_matrix(size, True), TRAVEL)

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                k, n, top = (np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in zip("abc", (np.int64, np.int64, np.uint8)))
                k, n = k[top > 0], n[top > 0]
                yield pa.RecordBatch.from_arrays([pa.array((k // size).astype(np.int32)), pa.array((k % size).astype(np.int32)), pa.array(n)], names=["b", "a", "n"])

    return counted.mapInArrow(tidy(flat), "b int, a int, n long")
