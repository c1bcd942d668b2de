"""N-gram Jaccard self-join of documents by a prefix tree.

A document's set is its distinct 5-word shingles as 64-bit hashes. One pass
over the texts deals every shingle to a bucket, where the exact number of sets
that hold it is counted; only shingles of two sets or more come back to their
document. All sets are ordered alike, rarest shingle first. A set of n shingles
needs ceil(3n/4) in common with any partner, so one with fewer shared shingles
is done, and partners must meet under one of the rarest n - ceil(3n/4) + 1.

Where few sets meet under a shingle, all pairs are candidates; where many do,
each meets the first one and its neighbour, and pairs that the links so found
leave in different components are candidates afterwards, so no link is lost.
Candidates are settled in groups of one set and up to BLOCK partners: the
partners are stored in a trie from the most frequent shingle on (copies then
share a path almost to its end), and the set walks down once, adding up the
overlap that all sets below share; a branch is left when the shingles that
remain cannot make up the overlap that any set below would need.

Words are [^\\x20\\x09-\\x0D]+ after A-Z are lower-cased. A text with one to four
words has one shingle, the whole sequence; null and empty texts have none and
link with nothing. Documents with equal sets are one set of the join, so groups
of exact copies cost no pairs. Rows that share a doc_id are one document: each
of their sets takes part. Rows with a null doc_id are listed as they are and
take no part in links. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm import _bytes
from sievewright.llm._exchange import buckets_of, chunks_of, exchange, travel
from sievewright.llm._shared import cut, release, salted_join, sweep, tidy
from sievewright.operators.graph import components

SHINGLE = 5
#: Jaccard as a fraction.
NUM, DEN = 3, 4
#: Text whose shingles are dealt out together; longer texts are a chunk by themselves.
DEALT = 4 << 20
#: Up to so many sets that meet under a shingle, all pairs are candidates at once.
FEW = 4
#: Partners of a set that are tried before all others.
LIKELIEST = 3
#: Postings of a key in one part.
PART = 4096
#: Sets of a crowded key in a block.
CROWD = 1024
#: Partners of a set in a trie.
BLOCK = 256
_LOW48 = np.uint64((1 << 48) - 1)


def shingle_sets(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all documents, sorted and distinct within each; bounds)."""
    start, _, hashed = _bytes.words(buf, offs, _bytes.space_words())
    bounds = _bytes.per_doc(start, offs)
    n = np.diff(bounds)
    each = np.where(n == 0, 0, np.maximum(n - SHINGLE + 1, 1))
    to = np.concatenate([[0], np.cumsum(each)])
    doc = np.repeat(np.arange(len(n)), each)
    at = np.arange(to[-1]) - to[doc] + bounds[doc]
    padded = np.concatenate([hashed, np.zeros(SHINGLE, np.uint64)])
    total = np.zeros(len(at), np.uint64)
    for j in range(SHINGLE):
        own = padded[at + j]
        own[j >= n[doc]] = 0  # the whole sequence of a text with fewer words
        total = total * np.uint64(0x9FB21C651E98DF25) + own
    h = _bytes.mix(total)
    for d in np.flatnonzero(each > 1):
        h[to[d] : to[d + 1]].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[keep], doc[keep]
    return h, np.searchsorted(doc, np.arange(len(n) + 1))


def needed(a, b):
    """Least intersection at which sets of sizes a and b link."""
    return -(-NUM * (a + b) // (NUM + DEN))


def _least(n: np.ndarray) -> np.ndarray:
    """Least intersection at which a set of size n links with any other."""
    return -(-NUM * n // DEN)


def _six(x: np.ndarray) -> np.ndarray:
    """The low 48 bits of each number, packed."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])


def _wide(raw: bytes, bucket: int) -> np.ndarray:
    """The shingles that _six() packed, told apart over all buckets."""
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel() | np.uint64((bucket & 0xFFFF) << 48)


def _scatter(buckets: int):
    """Deals the shingles of each chunk of documents to buckets.

    To each bucket goes: a, c shingles that one set of the chunk holds and which
    (its place in the chunk); d, e shingles that several hold and how many. The
    chunk's own row has: a doc_ids, b set sizes, c set numbers (0: no set),
    d whether the set is sent from there, e, f shingles that several sets hold and which.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column("doc_id")
            buf, offs = _bytes.text_bytes(batch.column("text"))
            for lo, hi in _bytes.chunks(offs, DEALT):
                sets, sizes = [], []
                for b, e in _bytes.chunks(offs[lo : hi + 1]):
                    b, e = b + lo, e + lo
                    h, bounds = shingle_sets(buf[offs[b] : offs[e]], offs[b : e + 1] - offs[b])
                    sets.append(h)
                    sizes.append(np.diff(bounds))
                yield from _scattered(ids.slice(lo, hi - lo), np.concatenate(sets), np.concatenate(sizes), chunk, buckets)
                chunk += 1

    return run


def _scattered(ids: pa.Array, h: np.ndarray, n: np.ndarray, chunk: int, buckets: int) -> Iterator[pa.RecordBatch]:
    bounds = np.concatenate([[0], np.cumsum(n)])
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_bytes.mix(h + np.uint64(1)), dtype=np.uint64)])
    number = _bytes.mix(np.diff(total[bounds]) + n.astype(np.uint64))
    number[n == 0] = 0
    missing = ids.is_null().to_numpy(zero_copy_only=False)
    _, first = np.unique(number, return_index=True)
    # equal sets of a chunk are sent once
    sent = np.zeros(len(n), bool)
    usable = np.flatnonzero((n > 0) & ~missing)
    sent[usable[np.unique(number[usable], return_index=True)[1]]] = True
    doc = np.repeat(np.arange(len(n), dtype=np.uint32), n)
    keep = sent[doc]
    h, doc = h[keep], doc[keep]
    bucket = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    token = h & _LOW48
    order = np.lexsort((token, bucket))
    token, doc, bucket = token[order], doc[order], bucket[order]
    fresh = np.ones(len(token), bool)
    fresh[1:] = (token[1:] != token[:-1]) | (bucket[1:] != bucket[:-1])
    begin = np.flatnonzero(fresh)
    held = np.diff(np.append(begin, len(token)))
    several = np.repeat(held > 1, held)
    whole = token | (bucket.astype(np.uint64) & np.uint64(0xFFFF)) << np.uint64(48)
    numbers = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    yield from travel([(buckets + chunk, chunk, numbers, n.astype(np.int32), number, np.where(missing, 2, sent).astype(np.uint8), whole[several], doc[several])])
    one, many = ~several, begin[held > 1]
    times = held[held > 1].astype(np.uint32)
    cuts_one, cuts_many = np.searchsorted(bucket[one], np.arange(buckets + 1)), np.searchsorted(bucket[many], np.arange(buckets + 1))
    token_one, doc_one, token_many = _six(token[one]), doc[one], _six(token[many])
    small = len(n) <= 1 << 16
    doc_one = doc_one.astype(np.uint16) if small else doc_one
    rows = []
    for k in np.flatnonzero((np.diff(cuts_one) > 0) | (np.diff(cuts_many) > 0)).tolist():
        x, y = slice(cuts_one[k], cuts_one[k + 1]), slice(cuts_many[k], cuts_many[k + 1])
        rows.append((k, chunk, token_one[x], None, doc_one[x], token_many[y], times[y], None))
    yield from travel(rows)


def _class(times: np.ndarray) -> np.ndarray:
    """The order's class of a shingle that so many sets hold: exact up to 127, by powers beyond."""
    return np.where(times < 128, times, np.minimum(128 + 8 * (np.log2(np.maximum(times, 128)) - 7), 255)).astype(np.uint8)


def _count(buckets: int):
    """Counts a bucket at a time; tells each chunk which of its shingles two sets or more hold.

    Rows come sorted by key. Told are, by chunk: a, b, c shingles, classes and
    places of those that one of its sets holds; d, e shingles and classes of those that several do.
    """

    def counted(bucket: int, rows: list[tuple]) -> list[tuple]:
        single = [_wide(r[1], bucket) for r in rows]
        multi = [_wide(r[3], bucket) for r in rows]
        token = np.concatenate(single + multi)
        weight = np.concatenate([np.ones(sum(map(len, single)), np.int64), *[np.frombuffer(r[4], np.uint32).astype(np.int64) for r in rows]])
        order = np.argsort(token)
        ordered = token[order]
        fresh = np.ones(len(ordered), bool)
        fresh[1:] = ordered[1:] != ordered[:-1]
        begin = np.flatnonzero(fresh)
        total = np.add.reduceat(weight[order], begin) if len(begin) else np.zeros(0, np.int64)
        times = np.empty(len(token), np.int64)
        times[order] = np.repeat(total, np.diff(np.append(begin, len(ordered))))
        rank, out = _class(times), []
        shared = times > 1
        cuts = np.cumsum([0, *map(len, single), *map(len, multi)])
        for i, r in enumerate(rows):
            x, y = slice(cuts[i], cuts[i + 1]), slice(cuts[len(rows) + i], cuts[len(rows) + i + 1])
            keep = shared[x]
            kind = np.uint16 if len(r[2]) == 2 * len(keep) else np.uint32
            if keep.any() or y.stop > y.start:
                out.append((bucket, r[0], token[x][keep], rank[x][keep], np.frombuffer(r[2], kind)[keep].astype(np.uint32), token[y], rank[y], None))
        return out

    return buckets_of(buckets, ("chunk", "a", "c", "d", "e"), counted)


_SETS = "doc_id long, n_shingles long, number long, size int, shared binary, ranks binary"


def _gather(buckets: int):
    """Puts each chunk's documents together; rows come sorted by chunk.

    `shared` holds the shingles that other sets hold too, rarest first, `ranks`
    their classes; both are null where they are too few for any link, or another document tells the set.
    """

    def gathered(own: tuple, told: list[tuple]) -> pa.RecordBatch:
        ids, n, number, sent, token, doc = (np.frombuffer(x, kind) for x, kind in zip(own, (np.int64, np.int32, np.int64, np.uint8, np.uint64, np.uint32)))
        parts = lambda k, kind: np.concatenate([np.frombuffer(t[k], kind) for t in told]) if told else np.zeros(0, kind)
        several, rank = parts(3, np.uint64), parts(4, np.uint8)
        order = np.argsort(several)
        rank = rank[order][np.searchsorted(several[order], token)] if len(several) else np.zeros(0, np.uint8)
        token, rank, doc = np.concatenate([parts(0, np.uint64), token]), np.concatenate([parts(1, np.uint8), rank]), np.concatenate([parts(2, np.uint32), doc])
        common = np.bincount(doc, minlength=len(n))
        alive = (sent == 1) & (common >= _least(n))
        keep = alive[doc]
        token, rank, doc = token[keep], rank[keep], doc[keep]
        order = np.lexsort((token, rank, doc))
        token, rank = token[order], rank[order]
        ends = np.cumsum(np.where(alive, common, 0))
        spans = [(e - c, e) if ok else None for ok, c, e in zip(alive.tolist(), common.tolist(), ends.tolist())]
        sets, ranks = ([None if x is None else own[x[0] : x[1]].tobytes() for x in spans] for own in (token, rank))
        missing = sent == 2
        return pa.RecordBatch.from_arrays([pa.array(ids, mask=missing), pa.array(n.astype(np.int64)), pa.array(number, mask=missing | (n == 0)), pa.array(n), pa.array(sets, pa.binary()), pa.array(ranks, pa.binary())], names=["doc_id", "n_shingles", "number", "size", "shared", "ranks"])

    return chunks_of(buckets, gathered)


def sets_of(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, number (of the set; null: none), size and shared, a row a document; see _gather()."""
    return exchange(docs.select("doc_id", "text"), _scatter, _count, _gather, _SETS)


def _signatures(h: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Parities of each set's shingles by hash, in a power of two of bits not below its size."""
    out = []
    for b, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        bits = 64
        while bits < e - b:
            bits *= 2
        parity = np.bincount((h[b:e] & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        out.append(np.packbits(parity.astype(np.uint8), bitorder="little").tobytes())
    return out


def apart(x: bytes, y: bytes) -> int:
    """A lower bound of the symmetric difference of two sets, from their signatures.

    Each shingle in one set only turns one parity, so the parities differ in at
    most as many places. Folding a signature in half gives that of half as many bits.
    """
    width = min(len(x), len(y))
    return int(np.bitwise_count(_folded(x, width) ^ _folded(y, width)).sum())


def _folded(marks: bytes, width: int) -> np.ndarray:
    x = np.frombuffer(marks, np.uint64)
    while 8 * len(x) > width:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The signature of what each set shares, and how many shingles are its own."""
    for batch in batches:
        shared = [np.frombuffer(x, np.uint64) for x in batch.column("shared").to_pylist()]
        marks = [_signatures(x, np.array([0, len(x)]))[0] for x in shared]
        own = batch.column("size").to_numpy() - np.array([len(x) for x in shared], np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("number"), batch.column("size"), pa.array(own, pa.int32()), pa.array(marks, pa.binary())], names=["number", "size", "own", "marks"])


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures allow the overlap that a link needs."""
    for batch in batches:
        na, nb, ua, ub = (batch.column(c).to_numpy().astype(np.int64) for c in ("na", "nb", "ua", "ub"))
        most = na + nb - 2 * needed(na, nb) - ua - ub
        keep = [m >= 0 and apart(x, y) <= m for x, y, m in zip(batch.column("ma").to_pylist(), batch.column("mb").to_pylist(), most.tolist())]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _postings(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The shingles under which a set can meet its partners.

    place counts the shingles before, with those that are the set's own. A
    shingle that over `most` sets hold is dealt to parts by the set's number.
    """
    for batch in batches:
        size, number = batch.column("size").to_numpy().astype(np.int64), batch.column("number").to_numpy()
        shared = [np.frombuffer(x, np.uint64) for x in batch.column("shared").to_pylist()]
        ranks = [np.frombuffer(x, np.uint8) for x in batch.column("ranks").to_pylist()]
        common = np.array([len(x) for x in shared], np.int64)
        take = common - _least(size) + 1
        lay = lambda every, kind: np.concatenate([x[:t] for x, t in zip(every, take.tolist())]) if len(every) else np.zeros(0, kind)
        key, rank = lay(shared, np.uint64), lay(ranks, np.uint8)
        doc = np.repeat(np.arange(len(size)), take)
        place = np.arange(len(doc)) - np.repeat(np.cumsum(take) - take, take) + (size - common)[doc]
        times = np.where(rank < 128, rank, np.exp2((rank.astype(np.float64) - 128) / 8 + 7))
        of = np.where(times > most, np.ceil(times / most), 0).astype(np.int64)
        part = np.where(of > 0, (_bytes.mix(number.view(np.uint64))[doc] >> np.uint64(1)).astype(np.int64) % np.maximum(of, 1), -1)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(part.astype(np.int32)), pa.array(number[doc]), pa.array(place.astype(np.int32)), pa.array(size[doc].astype(np.int32))], names=["key", "part", "number", "place", "size"])


def _meetings(batches: Iterator[pa.RecordBatch], few: int) -> Iterator[pa.RecordBatch]:
    """Candidate pairs from postings sorted by key, part and number; `key` is set in postings of crowded keys.

    Only the current key's first `few` postings and its last one are held. A key
    dealt over several parts (part >= 0) is crowded in each of them.
    """
    held: dict | None = None  # an open key: its first postings, the last one, how many
    for batch in batches:
        key, part, *cols = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "part", "number", "place", "size"))
        if not len(key):
            continue
        cut_at = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1, [len(key)]])
        rows: list[tuple] = []
        many: list[tuple] = []
        wanted = (np.diff(cut_at) > 1) | (part[cut_at[:-1]] >= 0)
        wanted[[0, -1]] = True
        for r in np.flatnonzero(wanted).tolist():
            b, e = int(cut_at[r]), int(cut_at[r + 1])
            at = (int(key[b]), int(part[b]))
            if held is None or held["at"] != at:
                if held is not None:
                    _close(held, rows)
                held = {"at": at, "first": [], "n": 0, "last": None, "few": few if at[1] < 0 else 0}
            for p in zip(*(c[b:e].tolist() for c in cols)):
                _add(held, p, rows, many)
        yield _pairs_batch(rows, many)
    if held is not None:
        rows = []
        _close(held, rows)
        yield _pairs_batch(rows, [])


def _add(held: dict, p: tuple, rows: list, many: list) -> None:
    held["n"] += 1
    if held["n"] <= held["few"]:
        held["first"].append(p)
    else:
        if held["n"] == held["few"] + 1:
            many += [(held["at"][0], *x) for x in held["first"]]
            for x, y in zip(held["first"], held["first"][1:]):
                _pair(x, y, rows)
                if x is not held["first"][0]:
                    _pair(held["first"][0], y, rows)
        many.append((held["at"][0], *p))
        if held["first"]:
            _pair(held["first"][0], p, rows)
            _pair(held["last"], p, rows)
        else:
            held["first"].append(p)
    held["last"] = p


def _close(held: dict, rows: list) -> None:
    f = held["first"] if held["n"] <= held["few"] else []
    for i in range(len(f)):
        for j in range(i + 1, len(f)):
            _pair(f[i], f[j], rows)


def _pair(x: tuple, y: tuple, rows: list) -> None:
    """A candidate unless sizes or places rule it out; x and y are (number, place, size)."""
    need = needed(x[2], y[2])
    if need <= min(x[2], y[2]) and min(x[1], y[1]) + min(x[2] - x[1], y[2] - y[1]) >= need and x[0] != y[0]:
        rows.append((x[0], y[0]) if x[0] < y[0] else (y[0], x[0]))


_MEET = "a long, b long, key long, number long, place int, size int"


def _pairs_batch(rows: list, many: list) -> pa.RecordBatch:
    rows = list(set(rows))
    n, m = len(rows), len(many)
    a, b = (np.array(rows, np.int64).reshape(-1, 2).T) if n else (np.zeros(0, np.int64),) * 2
    key, number, place, size = np.array(many, np.int64).reshape(-1, 4).T if m else (np.zeros(0, np.int64),) * 4
    lay = lambda first, second, kind: pa.concat_arrays([first.cast(kind), second.cast(kind)])
    columns = [lay(pa.array(x), pa.nulls(m), pa.int64()) for x in (a, b)] + [lay(pa.nulls(n), pa.array(x), kind) for x, kind in ((key, pa.int64()), (number, pa.int64()), (place, pa.int32()), (size, pa.int32()))]
    return pa.RecordBatch.from_arrays(columns, names=["a", "b", "key", "number", "place", "size"])


def _crossing(batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[pa.RecordBatch]:
    """Pairs of different components that may link, from two blocks of one crowded key at a time.

    Rows come sorted by (key, p, q). With `most`, only a set's so many likeliest
    partners are told, and a row (key, null) names a key where one has more.
    """
    at, held = None, []
    names = ("block", "number", "place", "size", "own", "component", "marks")
    told: set[tuple[int, int | None]] = set()
    for batch in batches:
        for key, p, q, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "p", "q", *names))):
            if (key, p, q) != at:
                if held:
                    told.update(_crossed(at, held, most))
                at, held = (key, p, q), []
                if len(told) > 100_000:
                    yield _told(told)
                    told = set()
            held.append(row)
    if held:
        told.update(_crossed(at, held, most))
    yield _told(told)


def _told(pairs: set) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _crossed(at: tuple, held: list, most: int | None) -> list[tuple[int, int | None]]:
    held.sort(key=lambda row: row[3])
    block, number, place, size, own, component = (np.array([row[k] for row in held], np.int64) for k in range(6))
    width = np.array([len(row[6]) for row in held])
    out: list[tuple[int, int | None]] = []
    for w in np.unique(width).tolist():
        # a possible partner has a signature of this width, of twice or of half
        also = np.flatnonzero((width == w) | (width == 2 * w))
        marks = np.stack([_folded(held[k][6], w) for k in also])
        sizes = size[also]
        for i in np.flatnonzero(width == w).tolist():
            lo, hi = np.searchsorted(sizes, -(-size[i] * NUM // DEN)), np.searchsorted(sizes, size[i] * DEN // NUM, side="right")
            j = also[lo:hi]
            need = needed(size[i], size[j])
            fine = (component[j] != component[i]) & ((width[j] > w) | (number[j] > number[i]))
            if at[1] != at[2]:
                fine &= block[j] != block[i]
            fine &= np.minimum(place[j], place[i]) + np.minimum(size[j] - place[j], size[i] - place[i]) >= need
            if not fine.any():
                continue
            far = np.bitwise_count(marks[lo:hi] ^ _folded(held[i][6], w)).sum(axis=1)
            fine &= far <= size[i] + size[j] - 2 * need - own[i] - own[j]
            near = j[fine][np.argsort(far[fine], kind="stable")].tolist()
            if most is not None and len(near) > most:
                out.append((at[0], None))
            out += [(int(min(number[i], number[k])), int(max(number[i], number[k]))) for k in near[:most]]
    return out


class Trie:
    """Ordered sets with shared beginnings; a node holds a stretch of hashes."""

    def __init__(self, sets: list[np.ndarray], sizes: list[int] | None = None):
        """sets: big-endian hashes, each from its most frequent shingle on; sizes count shingles of their own, too."""
        order = sorted(range(len(sets)), key=lambda k: sets[k].tobytes())
        self.rows = [sets[k].astype(np.uint64) for k in order]
        self.held = np.array([len(r) for r in self.rows])
        self.size = self.held if sizes is None else np.array([sizes[k] for k in order])
        self.which = order

    def linked(self, probe: np.ndarray, size: int | None = None) -> list[int]:
        """Numbers of the sets that link with probe, which has `size` shingles with those of its own."""
        own = np.sort(probe)
        size = len(own) if size is None else size
        out: list[int] = []
        # an entry: rows lo..hi agree on their first `depth` hashes, `overlap` of which the probe has
        stack = [(0, len(self.rows), 0, 0)]
        while stack:
            lo, hi, depth, overlap = stack.pop()
            if lo >= hi:
                continue
            # the probe may still hold len(own) - overlap more, a set its own remainder
            best = overlap + np.minimum(self.held[lo:hi] - depth, len(own) - overlap)
            if not (best >= needed(self.size[lo:hi], size)).any():
                continue
            first, last = self.rows[lo], self.rows[hi - 1]
            m = min(len(first), len(last))
            differ = np.flatnonzero(first[depth:m] != last[depth:m])
            shared = depth + int(differ[0]) if len(differ) else m
            if shared > depth and len(own):
                stretch = first[depth:shared]
                at = np.searchsorted(own, stretch)
                at[at == len(own)] = 0
                overlap += int((own[at] == stretch).sum())
            ended = lo
            while ended < hi and len(self.rows[ended]) == shared:
                if overlap >= needed(self.size[ended], size):
                    out.append(self.which[ended])
                ended += 1
            if ended < hi:
                # children: rows by their next hash
                following = np.array([self.rows[k][shared] for k in range(ended, hi)])
                cuts = [ended, *(np.flatnonzero(following[1:] != following[:-1]) + ended + 1).tolist(), hi]
                for b, e in zip(cuts, cuts[1:]):
                    stack.append((b, e, shared, overlap))
        return out


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each set with a block of partners; rows come sorted by (a, block, b), b null first: the set itself."""
    key, probe, partners, sets, sizes = None, None, [], [], []

    def links() -> pa.RecordBatch:
        hits = Trie(sets, sizes).linked(*probe) if sets and probe is not None else []
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(hits), pa.int64()), pa.array([partners[k] for k in hits], pa.int64())], names=["a", "b"])

    for batch in batches:
        shared = batch.column("shared")
        for i, (a, block, b, size) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "block", "b", "size")))):
            if (a, block) != key:
                if key is not None:
                    yield links()
                key, probe, partners, sets, sizes = (a, block), None, [], [], []
            own = np.frombuffer(shared[i].as_buffer(), np.uint64)
            if b is None:
                probe = own, size
            else:
                partners.append(b)
                sizes.append(size)
                sets.append(own[::-1].astype(">u8"))
    if key is not None:
        yield links()


def _verified(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of set numbers that link."""
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    numbered = pairs.join(blocks, "a").select("a", "b", F.pmod(F.xxhash64("b"), "blocks").cast("int").alias("block"))
    own = sets.select("number", "size", "shared")
    partners = numbered.join(own.withColumnRenamed("number", "b"), "b").select("a", "block", "b", "size", "shared")
    probes = numbered.select("a", "block").distinct().join(own.withColumnRenamed("number", "a"), "a").select("a", "block", F.lit(None).cast("long").alias("b"), "size", "shared")
    laid = partners.unionByName(probes).repartition(parts, "a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())
    return laid.mapInArrow(tidy(_settle), "a long, b long")


def links_of(sets: DataFrame, few: int = FEW, part: int = PART, crowd_block: int = CROWD) -> DataFrame:
    """Links a, b that join the sets (number, size, shared, ranks; each given once) to their components."""
    spark = sets.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    postings = sets.mapInArrow(tidy(partial(_postings, most=part)), "key long, part int, number long, place int, size int")
    met = cut(postings.repartition(parts, "key", "part").sortWithinPartitions("key", "part", "number").mapInArrow(tidy(partial(_meetings, few=few)), _MEET))
    # the parts of a key that was dealt over several meet by their first sets
    heads = postings.where("part >= 0").groupBy("key", "part").agg(F.min(F.struct("number", "place", "size")).alias("h")).select("key", F.lit(0).alias("part"), "h.*")
    heads = heads.repartition(parts, "key").sortWithinPartitions("key", "number").mapInArrow(tidy(partial(_meetings, few=few)), _MEET)
    pairs = met.unionByName(heads).where(F.col("a").isNotNull()).select("a", "b").distinct()
    signs = cut(sets.mapInArrow(tidy(_marked), "number long, size int, own int, marks binary"))
    left, right = (signs.select(F.col("number").alias(c), F.col("size").alias(f"n{c}"), F.col("own").alias(f"u{c}"), F.col("marks").alias(f"m{c}")) for c in "ab")
    possible = cut(pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ua", "ub", "ma", "mb").mapInArrow(tidy(_possible), "a long, b long"))
    links = cut(_verified(sets, possible))
    release(possible)
    found = cut(components(links))

    # what met under a crowded key and is not together yet: first the likeliest partners of each, then all that are left
    keys, used = None, [met, signs]
    for most in (LIKELIEST, None):
        crowd = met.where(F.col("key").isNotNull()).select("key", "number", "place", "size")
        if keys is not None:  # after the first pass only keys where some set has more partners than were tried
            crowd = salted_join(crowd, keys, ["key"], "number", how="left_semi")
        crowd = cut(crowd.join(found.withColumnRenamed("node", "number"), "number", "left").withColumn("component", F.coalesce("component", "number")))
        # a key's sets meet in pairs of blocks, so that no task has a whole key
        sizes = crowd.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.ceil(F.count(F.lit(1)) / crowd_block).cast("int").alias("blocks")).where("x < y").select("key", "blocks")
        open_ = salted_join(crowd, cut(sizes), ["key"], "number").withColumn("block", F.pmod(F.xxhash64("number"), "blocks").cast("int"))
        told = open_.join(signs.select("number", "own", "marks"), "number").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = told.select("key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "number", "place", "size", "own", "component", "marks")
        others = rows.repartition(parts, "key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(tidy(partial(_crossing, most=most)), "a long, b long")
        others = cut(others.distinct())
        release(crowd)
        used.append(others)
        if others.isEmpty():
            break
        keys = others.where(F.col("b").isNull()).select(F.col("a").alias("key"))
        more = cut(_verified(sets, others.where(F.col("b").isNotNull())))
        if not more.isEmpty():
            links = links.unionByName(more)
            used.append(found)
            found = cut(components(links))
        if most is not None and keys.isEmpty():
            break
    release(found, *used)
    return links


def link(docs: DataFrame, few: int = FEW, part: int = PART, crowd_block: int = CROWD) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    every = cut(sets_of(docs))
    sweep(docs.sparkSession)
    sets = cut(every.where(F.col("shared").isNotNull()).select("number", "size", "shared", "ranks").dropDuplicates(["number"]))
    sweep(docs.sparkSession)
    links = links_of(sets, few, part, crowd_block)
    release(sets)
    # rows of one doc_id with different sets link these
    known = every.where(F.col("number").isNotNull()).select("doc_id", "number")
    twice = cut(known.groupBy("doc_id").agg(F.min("number").alias("a"), F.max("number").alias("z")).where("a < z").select("doc_id", "a"))
    same = salted_join(known, twice, ["doc_id"], "number").select("a", F.col("number").alias("b")).where("a < b").distinct()
    found = cut(components(links.unionByName(same)))
    # the smallest doc_id of every set, then of every component; sets of one document need no entry
    least = known.groupBy("number").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    joined = cut(least.join(found.withColumnRenamed("node", "number"), "number", "left").where("n > 1 OR component IS NOT NULL").withColumn("component", F.coalesce("component", "number")))
    smallest = cut(joined.groupBy("component").agg(F.min("least").alias("component_id")))
    table = cut(salted_join(joined, smallest, ["component"], "number").select("number", "component_id"))
    out = salted_join(every.select("doc_id", "n_shingles", "number"), table, ["number"], "doc_id", how="left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
