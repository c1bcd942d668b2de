"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece exactly one token can end its encoding: the one
that fits after the last token of the shorter prefix it leaves. Storing that
token for every prefix gives the encoding by walking back, makes an append
exact (only new prefixes are filled), and limits re-encoding after an edit to
the prefixes near it. Whether two tokens may stand side by side is decided by
undoing their merges around the seam in order of rank.

Null text encodes as empty text: no tokens. Empty text gives no tokens. Texts
of any length are handled piece by piece; a piece costs time in proportion to
its length times the longest token. Repeated rows are encoded alike, extra
columns are ignored by encode_documents().
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sievewright.llm._shared import KEPT, tidy

#: Units, pieces and seams that a worker keeps at most, about 100 MB in all; longer pieces are not kept.
MOST_UNITS, MOST_PIECES, MOST_SEAMS = 250_000, 150_000, 500_000
LONGEST_KEPT = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank from a rank file (base64 and number a line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PrefixBPE:
    """Encodes and decodes single pieces under fixed ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.joined: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        #: Tokens that merging their own bytes really produces.
        self.reachable: set[bytes] = set()
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.parts[rank] = (rank, rank)
                self.reachable.add(token)
                continue
            halves = self._halves(token, rank)
            if halves:
                self.parts[rank] = halves
                self.joined[halves] = rank
                self.reachable.add(token)
        self.fits_memo: dict[int, bool] = {}
        tokens = ahocorasick.Automaton()
        for token in self.reachable:
            tokens.add_word(token.decode("latin-1"), (ranks[token], len(token)))
        tokens.make_automaton()
        #: (end, (rank, length)) of every token in a string, by end
        self.matches = tokens.iter

    def _halves(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The pair whose merge makes the token, or None if merging never gets there."""
        ids = [self.ranks.get(token[i : i + 1], -1) for i in range(len(token))]
        if -1 in ids:
            return None
        while len(ids) > 2:
            best, at = rank, -1
            for i in range(len(ids) - 1):
                r = self.joined.get((ids[i], ids[i + 1]), rank)
                if r < best:
                    best, at = r, i
            if at < 0:
                return None
            ids[at : at + 2] = [best]
        return ids[0], ids[1]

    def fits(self, left: int, right: int) -> bool:
        """Whether merging bytes(left) + bytes(right) ends in just these two tokens.

        Undo the later merge of the two, again and again; the seam breaks if a
        merge across it would have come before the one undone last.
        """
        key = left << 24 | right
        known = self.fits_memo.get(key)
        if known is not None:
            return known
        joined, parts = self.joined, self.parts
        a, b, limit, good = left, right, 1 << 62, True
        while True:
            across = joined.get((a, b))
            if across is not None and across < limit:
                good = False
                break
            pa_, pb_ = parts[a], parts[b]
            single_a, single_b = pa_[0] == a, pb_[0] == b
            if single_a and single_b:
                break
            if single_b or (not single_a and a > b):
                limit, a = a, pa_[1]
            else:
                # an equal rank further left merges first, hence the + 1
                limit, b = b + 1, pb_[0]
        if len(self.fits_memo) > MOST_SEAMS:
            self.fits_memo.clear()
        self.fits_memo[key] = good
        return good

    def last_tokens(self, piece: bytes, known: list[int] | None = None, before: int = 0) -> list[int]:
        """The last token of every prefix of piece; `known` holds those of its first prefixes.

        With `before`, piece is what follows so many bytes; `known` then covers
        the longest token at least, or all that stands before.
        """
        last = list(known or ())
        n, fits, seams, append = len(last), self.fits, self.fits_memo.get, last.append
        skip = max(0, n - self.longest)
        for at, (token, size) in self.matches(piece[skip:].decode("latin-1")):
            at += skip
            if at < n:
                continue
            if at > n:
                break
            if size > at:
                if before:
                    continue  # it would begin before all that is known; a token is never longer than that
                append(token)
                n += 1
                continue
            left = last[at - size]
            good = seams(left << 24 | token)
            if good or good is None and fits(left, token):
                append(token)
                n += 1
        if n != len(piece):
            raise ValueError("a byte of the text has no rank")
        return last

    def walk_back(self, last: list[int]) -> list[int]:
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.bytes_of[last[end - 1]])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        """A piece that is a token as a whole is that token, as in the common library."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        return self.walk_back(self.last_tokens(piece))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Growing:
    """A piece that grows or is edited in place; only prefixes near the change are filled again."""

    def __init__(self, bpe: PrefixBPE, piece: bytes = b""):
        self.bpe, self._bytes, self.last = bpe, bytearray(piece), bpe.last_tokens(piece)
        #: prefixes that the last change filled
        self.filled = len(self.last)

    @property
    def piece(self) -> bytes:
        return bytes(self._bytes)

    def append(self, more: bytes) -> None:
        begin = len(self._bytes)
        self._bytes += more
        self._refill(begin, len(self._bytes))

    def replace(self, begin: int, end: int, new: bytes) -> None:
        """Put new in place of piece[begin:end].

        Prefixes before the edit keep their last tokens. Behind it the last
        token of a prefix hangs on the `longest` prefixes before only, so once
        that many come out as they were, all later ones do.
        """
        self._bytes[begin:end] = new
        self.last[begin:end] = [-1] * len(new)
        self._refill(begin, begin + len(new))

    def _refill(self, begin: int, sure: int) -> None:
        """Fill prefixes behind `begin`, all up to `sure`, then until as many as a token is long are unchanged."""
        longest, at, same = self.bpe.longest, begin, 0
        while at < len(self._bytes) and (at < sure or same < longest):
            skip, stop = max(0, at - longest), min(len(self._bytes), at + max(4 * longest, sure - at))
            fresh = self.bpe.last_tokens(bytes(self._bytes[skip:stop]), self.last[skip:at], skip)
            for token in fresh[at - skip :]:
                known = at < len(self.last)
                same = same + 1 if at >= sure and known and self.last[at] == token else 0
                if known:
                    self.last[at] = token
                else:
                    self.last.append(token)
                at += 1
                if at >= sure and same >= longest:
                    break
        self.filled = at - begin

    def ids(self) -> list[int]:
        whole = self.bpe.ranks.get(self.piece)
        return self.bpe.walk_back(self.last) if whole is None else [whole]


class TextCodec:
    """Whole texts: split by the pattern, encode each piece, remember common ones.

    A space between two characters that aren't white space always begins a
    match of the pattern. A text that has no other spaces is therefore looked
    up by its space-parted units, and only units not met before are split by
    the pattern; any other text is split as a whole.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.bpe = PrefixBPE(ranks)
        self.split = regex.compile(pattern).findall
        self.odd_space = regex.compile(r"^\s| \s|\s |\s$").search
        self.pieces: dict[str, str] = {}
        self.units: dict[str, str] = {}
        self.decoded = {str(rank): token for token, rank in ranks.items()}

    def piece(self, piece: str) -> str:
        found = self.pieces.get(piece)
        if found is None:
            found = self.units.get(piece[1:]) if piece[0] == " " else None
            if found is None:
                found = self._ids(piece)
            if len(piece) <= LONGEST_KEPT:
                if len(self.pieces) > MOST_PIECES:
                    self.pieces.clear()
                self.pieces[piece] = found
        return found

    def _ids(self, piece: str) -> str:
        return " ".join(map(str, self.bpe.encode(piece.encode())))

    def _learn(self, units: list[str]) -> None:
        """Split and encode units together: each begins at a piece that begins with a space."""
        units = list(dict.fromkeys(units))
        at, parts = -1, []
        for piece in [*self.split(" " + " ".join(units)), " "]:
            if piece[0] == " ":
                if at >= 0:
                    # a unit of one piece is kept as a unit only
                    self.units[units[at]] = " ".join(map(self.piece, parts)) if len(parts) > 1 else self._ids(parts[0])
                at, parts = at + 1, []
            parts.append(piece)

    def encoded(self, text: str) -> str:
        """The ids in decimal, joined by a space."""
        if not text:
            return ""
        if self.odd_space(text):
            return " ".join(map(self.piece, self.split(text)))
        first, *rest = text.split(" ")
        known = self.units
        if new := [u for u in rest if u not in known]:
            if len(known) > MOST_UNITS:
                known.clear()
                new = rest
            self._learn(new)
        return " ".join([*map(self.piece, self.split(first)), *map(known.__getitem__, rest)])

    def text(self, text: str | None) -> tuple[int, str, bytes]:
        """Number of ids, the ids in decimal, and the bytes decoded from them."""
        ids = self.encoded(text or "")
        parts = ids.split(" ") if ids else []
        return len(parts), ids, b"".join(map(self.decoded.__getitem__, parts))

    def ids(self, text: str | None) -> list[int]:
        ids = self.encoded(text or "")
        return list(map(int, ids.split(" "))) if ids else []


_CODECS: dict[tuple[str, str], TextCodec] = {}


def codec(key: str, ranks: dict[bytes, int], pattern: str) -> TextCodec:
    """One codec a worker process, for one vocabulary and one pattern; its tables are built once."""
    if (key, pattern) not in _CODECS:
        _CODECS.clear()
        _CODECS[key, pattern] = TextCodec(ranks, pattern)
    KEPT["bpe"] = _CODECS.clear
    return _CODECS[key, pattern]


DIGEST = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_sha256", T.StringType()),
    T.StructField("decoded_sha256", T.StringType()),
])


def _mapper(spark: SparkSession, ranks_path: str, pattern: str, row, schema: pa.Schema):
    table = read_ranks(ranks_path)
    key = f"{ranks_path} {zlib.crc32(repr(sorted(table.items())).encode())}"
    ranks = spark.sparkContext.broadcast(table)  # bounded by the vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(key, ranks.value, pattern)
        for batch in (b.slice(k, 500) for b in batches for k in range(0, max(len(b), 1), 500)):
            texts, rows = batch.column("text"), []
            for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                rows.append((doc, *row(tool, texts[i].as_py())))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)

    return tidy(run, "bpe")


def _digest(tool: TextCodec, text: str | None) -> tuple[int, str, str]:
    n, ids, decoded = tool.text(text)
    return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()


def encode_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded bytes, a row a document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    run = _mapper(docs.sparkSession, ranks_path, pattern, _digest, schema)
    return docs.select("doc_id", "text").mapInArrow(run, DIGEST)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (array<int>) and the digests of encode_digests()."""
    import numpy as np

    def row(tool: TextCodec, text: str | None) -> tuple:
        n, ids, decoded = tool.text(text)
        return n, np.fromstring(ids, np.int32, sep=" ") if ids else np.zeros(0, np.int32), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    run = _mapper(docs.sparkSession, ranks_path, pattern, row, schema)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string")


def decode_documents(ids: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id and the bytes that array<int> ids decode to; null ids decode to no bytes."""
    ranks = ids.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {v: k for k, v in ranks.value.items()}
        for batch in batches:
            out = [b"".join(table[i] for i in x or ()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")
