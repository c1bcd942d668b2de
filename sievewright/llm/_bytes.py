"""Vectorised views of Arrow text columns: bytes, documents, words and hashes.

Documents are handled in groups of about CHUNK bytes, always whole, so memory
follows the larger of CHUNK and the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if offsets is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about `most` bytes together."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, for positions below n."""
    size = CHUNK + 1
    while size < n:
        size *= 2
    up, down = _powers(size)
    return up[:n], down[:n]


@lru_cache(maxsize=2)
def byte_codes(fold: bool) -> np.ndarray:
    """A fixed 64-bit code for each byte; with fold, A-Z have those of a-z."""
    codes = np.random.default_rng(20240229).integers(1, _MASK, 256, dtype=np.uint64) | np.uint64(1)
    if fold:
        codes[65:91] = codes[97:123]
    return codes


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def words(buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, 64-bit hash of the bytes, lower-cased with fold) of each word in buf.

    offs are the documents' offsets into buf; no word crosses one. is_word
    says of each byte whether it belongs to words.
    """
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64)
    m = is_word[buf]
    first = m.copy()
    first[1:] &= ~m[:-1]
    last = m.copy()
    last[:-1] &= ~m[1:]
    cuts = offs[(offs > 0) & (offs < n)]
    first[cuts] = m[cuts]
    last[cuts - 1] = m[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashed, codes = np.empty(len(start), np.uint64), byte_codes(fold)
    i = 0
    while i < len(start):  # about CHUNK bytes at a time, so that the tables of powers stay small
        j = max(int(np.searchsorted(end, start[i] + CHUNK, side="right")), i + 1)
        lo, hi = int(start[i]), int(end[j - 1])
        if hi - lo > CHUNK:
            hashed[i] = _long(buf[lo:hi], codes)
        else:
            up, down = powers(hi - lo)
            total = np.empty(hi - lo + 1, np.uint64)
            total[0] = 0
            np.cumsum(codes[buf[lo:hi]] * up, out=total[1:])
            hashed[i:j] = (total[end[i:j] - lo] - total[start[i:j] - lo]) * down[start[i:j] - lo]
        i = j
    return start, end, mix(hashed + (end - start).astype(np.uint64))


def _long(word: np.ndarray, codes: np.ndarray) -> int:
    """The sum of a word that is longer than CHUNK, part by part."""
    up, _ = powers(CHUNK)
    total, scale = 0, 1
    for lo in range(0, len(word), CHUNK):
        part = word[lo : lo + CHUNK]
        total += int(np.sum(codes[part] * up[: len(part)], dtype=np.uint64)) * scale
        scale = scale * pow(_BASE, CHUNK, 1 << 64) & _MASK
    return total & _MASK


def per_doc(start: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Bounds: words bounds[d]:bounds[d + 1] are those of document d."""
    return np.searchsorted(start, offs, side="left")


def space_words() -> np.ndarray:
    """Bytes of words [^\\x20\\x09-\\x0D]+."""
    m = np.ones(256, bool)
    m[[0x20, *range(0x09, 0x0E)]] = False
    return m


def letter_words() -> np.ndarray:
    """Bytes of words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ once A-Z are lower-cased."""
    m = np.zeros(256, bool)
    m[0x30:0x3A] = m[0x41:0x5B] = m[0x61:0x7B] = True
    m[0x80:] = True
    return m
