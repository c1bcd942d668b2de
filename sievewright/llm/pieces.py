"""SentencePiece models of merge type: encoding by an agenda of symbol pairs, decoding, and a check against the library.

A text becomes single characters; every adjacent pair that forms a piece stands
in an agenda ordered by score, equal scores by place, and the best pair is
merged until none is left. No merge crosses the place before a space that
follows another character, so a text is cut there first, and what a stretch
encodes to is remembered. Characters without a piece go by their bytes.

Null text encodes as empty text, which gives the end id alone if one is asked
for. Texts of any length are handled stretch by stretch; a stretch of n
characters costs n log n. Rows are handled one by one, so ties and repeated
rows are encoded alike; null doc_ids stay null; extra columns are ignored; an
empty table gives no rows. Models of another type, with a character map, with
pieces that users defined or that are unused, or without bytes to fall back on
are refused (ValueError).
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sievewright.llm._agenda import Agenda
from sievewright.llm._shared import KEPT, tidy

#: Stretches that a worker remembers at most; longer ones are not remembered.
MOST_UNITS, LONGEST_KEPT = 400_000, 64
#: Texts that are encoded, checked and given out together.
ROWS = 200
#: Of so many slices of ROWS texts one is held against the library, which takes longer than the encoding itself.
CHECKED = 16
SPACE = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            value, at, shift = value | (b & 127) << shift, at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        else:
            size = {1: 8, 5: 4}[kind]
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class PieceModel:
    """Pieces, scores and kinds of a model file, with encoding and decoding of single stretches."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        trainer, normal = {}, {}
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
                self.kinds.append(piece.get(3, _NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normal = dict(_fields(value))
        self.prefix = bool(normal.get(3, 1))
        if trainer.get(3, 1) != 2 or trainer.get(24, 0) or normal.get(2) or normal.get(4, 1) or not normal.get(5, 1):
            raise ValueError("only merge-type models that leave characters and spaces as they are can be used")
        if set(self.kinds) - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE} or self.kinds.count(_BYTE) != 256:
            raise ValueError("only models of plain pieces with bytes to fall back on can be used")
        self.id_of = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == _NORMAL}
        self.byte_id = [0] * 256
        #: what each id stands for
        self.bytes_of: list[bytes] = []
        for i, (p, k) in enumerate(zip(self.pieces, self.kinds)):
            if k == _BYTE:
                self.byte_id[int(p[3:5], 16)] = i
                self.bytes_of.append(bytes([int(p[3:5], 16)]))
            else:
                self.bytes_of.append({_CONTROL: b"", _UNKNOWN: " ⁇ ".encode()}.get(k, p.replace(SPACE, " ").encode()))
        #: whether a merge can't join a space to what stands before it
        self.parts_at_spaces = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.id_of)
        # symbols: the ids of pieces, and n + code point of characters that are none
        n = len(self.pieces)
        self.symbol_of = np.arange(0x110000, dtype=np.int32) + n
        for p, i in self.id_of.items():
            if len(p) == 1:
                self.symbol_of[ord(p)] = i
        order = {s: r for r, s in enumerate(sorted(set(scores), reverse=True))}  # equal scores have equal ranks
        symbol = lambda p: self.id_of.get(p, n + ord(p) if len(p) == 1 else -1)
        pairs = [(a, b, order[scores[i]], i) for p, i in self.id_of.items() for k in range(1, len(p)) if (a := symbol(p[:k])) >= 0 and (b := symbol(p[k:])) >= 0]
        self.agenda = Agenda(*np.array(pairs, np.int64).reshape(-1, 4).T, n + 0x110000)

    def merged(self, points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each text) of normalised texts, by the agenda: code points one behind the other, spaces as SPACE."""
        symbols, counts = self.agenda.run(self.symbol_of[points], sizes)
        n = len(self.pieces)
        odd = np.flatnonzero(symbols >= n)
        if not len(odd):
            return symbols, counts
        told = [[self.byte_id[b] for b in chr(c).encode()] for c in (symbols[odd] - n).tolist()]
        many = np.ones(len(symbols), np.int64)
        many[odd] = list(map(len, told))
        total = np.concatenate([[0], np.cumsum(many)])
        ids = np.repeat(symbols, many)
        ids[np.repeat(symbols >= n, many)] = [i for x in told for i in x]
        ends = np.cumsum(counts)
        return ids, total[ends] - total[ends - counts]

    def encode(self, text: str) -> list[int]:
        """Ids of one normalised text."""
        return self.merged(code_points(text), np.array([len(text)]))[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes that form no character become U+FFFD one by one, the space that encoding put in front goes."""
        out: list[str] = []
        run = bytearray()
        begun = False

        def spend() -> None:
            while run:
                size = 1 if run[0] < 0x80 else 2 if run[0] < 0xE0 else 3 if run[0] < 0xF0 else 4
                try:
                    out.append(run[:size].decode())
                except UnicodeDecodeError:
                    out.append("�")
                    size = 1
                del run[:size]

        for i in ids:
            if self.kinds[i] == _BYTE:
                run += self.bytes_of[i]
                continue
            spend()
            told = self.bytes_of[i].decode()
            if not begun and not any(out) and self.prefix and self.kinds[i] == _NORMAL and told.startswith(" "):
                told, begun = told[1:], True
            out.append(told)
        spend()
        return "".join(out)


class PieceCodec:
    """Whole texts under a model; stretches between spaces are remembered."""

    def __init__(self, model: bytes):
        self.model = PieceModel(model)
        self.known: dict[str, str] = {}
        self.numbers = np.array([f" {i}" for i in range(len(self.model.pieces))], object)
        self.widths = np.array(list(map(len, self.numbers)))
        self.by_number = {str(i): b for i, b in enumerate(self.model.bytes_of)}
        self.apart = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall if self.model.parts_at_spaces else lambda x: [x]

    def encoded(self, texts: list[str]) -> list[str]:
        """The ids of each text in decimal, joined by a space; no end id."""
        front, apart, known = SPACE if self.model.prefix else "", self.apart, self.known
        if len(known) > MOST_UNITS:
            known.clear()
        units = [apart(front + t.replace(" ", SPACE)) if t else [] for t in texts]
        new = list(set().union(*units).difference(known))
        ids, counts = self.model.merged(code_points("".join(new)), np.fromiter(map(len, new), np.int64, len(new)))
        said = "".join(self.numbers[ids].tolist())  # a space before every id
        ends = np.concatenate([[0], np.cumsum(self.widths[ids])])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        known.update(zip(new, (said[a:b] for a, b in zip(ends, ends[1:]))))
        out = ["".join(map(known.__getitem__, u))[1:] for u in units]
        for unit in new:
            if len(unit) > LONGEST_KEPT:
                del known[unit]
        return out

    def decoded(self, numbers: list[str]) -> str:
        """The text of ids that encoded() gave."""
        whole = b"".join(map(self.by_number.__getitem__, numbers))
        if self.model.prefix and whole[:1] == b" " and numbers and self.model.kinds[int(numbers[0])] == _NORMAL:
            try:
                return whole[1:].decode()
            except UnicodeDecodeError:
                pass
        return self.model.decode(list(map(int, numbers)))


_CODECS: dict[str, PieceCodec] = {}
_LIBRARY: dict[str, object] = {}


def codec(key: str, model: bytes) -> PieceCodec:
    """One codec a worker process and model."""
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = PieceCodec(model)
    KEPT["pieces"] = _drop
    return _CODECS[key]


def _drop() -> None:
    _CODECS.clear()
    _LIBRARY.clear()


def read_model(path: str) -> tuple[str, bytes]:
    """A key and the bytes of a model file."""
    with open(path, "rb") as f:
        model = f.read()
    return f"{path} {zlib.crc32(model)}", model


def library(key: str, model: bytes):
    """The sentencepiece library's own processor, one a worker."""
    if key not in _LIBRARY:
        import sentencepiece

        _LIBRARY.clear()
        _LIBRARY[key] = sentencepiece.SentencePieceProcessor(model_proto=model)
    return _LIBRARY[key]


def _compare(tool, docs: list, texts: list[str], numbers: list[list[str]], back: list[str]) -> None:
    """Fails on a text that the library encodes or decodes otherwise."""
    theirs = tool.encode(texts, num_threads=1, add_eos=False)
    for doc, own, their in zip(docs, numbers, theirs):
        if list(map(int, own)) != their:
            raise RuntimeError(f"doc_id {doc}: ids differ from the library's")
    for doc, own, their in zip(docs, back, tool.decode(theirs)):
        if own != their:
            raise RuntimeError(f"doc_id {doc}: the decoded text differs from the library's")


def _mapper(model_path: str, eos: bool, checked: int, row: Callable, schema: pa.Schema) -> Callable:
    key, model = read_model(model_path)  # bounded by the vocabulary file; goes with the tasks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(key, model)
        end = [str(i) for i, p in enumerate(tool.model.pieces) if p == "</s>" and tool.model.kinds[i] == _CONTROL][:1] if eos else []
        slices = (b.slice(k, ROWS) for b in batches for k in range(0, max(len(b), 1), ROWS))
        for at, batch in enumerate(slices):
            docs = batch.column("doc_id").to_pylist()
            texts = [x or "" for x in batch.column("text").to_pylist()]
            numbers = [x.split(" ") if x else [] for x in tool.encoded(texts)]
            back = list(map(tool.decoded, numbers))
            if checked and at % checked == 0 and texts:
                _compare(library(key, model), docs, texts, numbers, back)
            rows = [(doc, *row(own + end, told)) for doc, own, told in zip(docs, numbers, back)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)

    return tidy(run, "pieces")


def _digest(numbers: list[str], told: str) -> tuple[int, str, str]:
    return len(numbers), hashlib.sha256(" ".join(numbers).encode()).hexdigest(), hashlib.sha256(told.encode()).hexdigest()


def encode_digests(docs: DataFrame, model_path: str, eos: bool = True, checked: int = CHECKED) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text, a row a document.

    The first of every `checked` slices of Arrow batches (0: none) is also
    encoded and decoded by the sentencepiece library, and the job fails on the
    first difference. No row of the result comes from the library.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    run = _mapper(model_path, eos, checked, _digest, schema)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_documents(docs: DataFrame, model_path: str, eos: bool = True, checked: int = CHECKED) -> DataFrame:
    """doc_id, n_tokens, ids (array<int>) and the text that they decode to."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
    run = _mapper(model_path, eos, checked, lambda numbers, told: (len(numbers), np.array(numbers, np.int32), told), schema)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded string")


def decode_documents(ids: DataFrame, model_path: str) -> DataFrame:
    """doc_id and the text that array<int> ids decode to; null ids decode to no text."""
    key, model = read_model(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(key, model)
        for batch in batches:
            out = [tool.model.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(tidy(run, "pieces"), "doc_id long, text string")
