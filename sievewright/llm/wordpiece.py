"""Token counts by a linear longest-match automaton.

Greedy word pieces take the longest vocabulary entry at every place of a word.
The automaton is a trie of the vocabulary in which every node also knows where
to go when no child fits (its failure link) and how many pieces are settled on
the way; both are precomputed, so a word is counted in time linear in its
length and no piece is ever built. All distinct words of a batch walk the
automaton together, and what a word has beyond TOGETHER bytes alone.

Words are [^\\x20\\x09-\\x0D]+. A word that the vocabulary cannot cover counts
as one piece. Null and empty texts have no words and no tokens; repeated rows
count alike; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sievewright.llm import _bytes
from sievewright.llm._shared import tidy


#: Bytes of a word that all words walk together; the rest of longer ones is walked alone.
TOGETHER = 256


class Automaton:
    """Counts of greedy pieces: `initial` entries begin words, `inner` ones continue them."""

    def __init__(self, initial: Iterable[bytes], inner: Iterable[bytes]):
        child: list[dict[int, int]] = [{}, {}]  # 0 begins a word, 1 continues it
        entry = [False, False]
        for root, entries in ((0, initial), (1, inner)):
            for piece in entries:
                at = root
                for b in piece:
                    to = child[at].get(b)
                    if to is None:
                        to = child[at][b] = len(child)
                        child.append({})
                        entry.append(False)
                    at = to
                entry[at] = entry[at] or at > 1
        fail, pops = [-1] * len(child), [0] * len(child)
        row = [0, 1]
        while row:  # by depth: a node's link ends at a node nearer to a root
            following = []
            for at in row:
                for b, to in child[at].items():
                    following.append(to)
                    if entry[to]:
                        fail[to], pops[to] = 1, 1
                        continue
                    back, settled = fail[at], pops[at]
                    while back >= 0 and b not in child[back]:
                        settled += pops[back]
                        back = fail[back]
                    if back >= 0:
                        fail[to], pops[to] = child[back][b], settled
            row = following
        rest = [-1] * len(child)  # pieces still to settle where a word ends; -1: none fit
        rest[1] = 0

        def settle(at: int) -> int:
            path = []
            while at > 1 and rest[at] < 0 and fail[at] >= 0:
                path.append(at)
                at = fail[at]
            n = rest[at] if at >= 0 else -1
            for x in reversed(path):
                n = n + pops[x] if n >= 0 else -1
                rest[x] = n
            return n

        for at in range(2, len(child)):
            settle(at)
        keys = np.array([at << 8 | b for at in range(len(child)) for b in child[at]], np.int64)
        to = np.array([t for c in child for t in c.values()], np.int64)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], to[order]
        self._lists: tuple | None = None
        self.fail, self.pops, self.rest = np.array(fail, np.int64), np.array(pops, np.int64), np.array(rest, np.int64)

    def count(self, buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Pieces of each word buf[start : start + size]."""
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        state, n = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        dead = np.zeros(len(start), bool)
        longer = np.searchsorted(-size, -np.arange(min(int(size[0]), TOGETHER) if len(size) else 0), side="left")  # words longer than j
        for j, many in enumerate(longer.tolist()):
            live = np.flatnonzero(~dead[:many])
            byte = buf[start[live] + j]
            while len(live):
                key = state[live] << 8 | byte
                at = np.searchsorted(self.keys, key)
                at[at == len(self.keys)] = 0
                fits = self.keys[at] == key if len(self.keys) else np.zeros(len(live), bool)
                state[live[fits]] = self.to[at[fits]]
                live, byte = live[~fits], byte[~fits]
                back = self.fail[state[live]]
                dead[live[back < 0]] = True
                live, byte, back = live[back >= 0], byte[back >= 0], back[back >= 0]
                n[live] += self.pops[state[live]]
                state[live] = back
        for w in range(int(np.searchsorted(-size, -TOGETHER, side="left"))):  # the rest of long words, one by one
            if not dead[w]:
                state[w], more, dead[w] = self._walk(int(state[w]), buf[start[w] + TOGETHER : start[w] + size[w]])
                n[w] += more
        ending = self.rest[state]
        n = np.where(dead | (ending < 0), 1, n + ending)
        out = np.empty(len(n), np.int64)
        out[order] = n
        return out


    def _walk(self, at: int, rest: np.ndarray) -> tuple[int, int, bool]:
        """(state, pieces settled, whether nothing fits) behind the bytes of rest."""
        child, fail, pops, n = self._plain()
        for b in rest.tobytes():
            while True:
                to = child.get(at << 8 | b)
                if to is not None:
                    at = to
                    break
                if fail[at] < 0:
                    return at, n, True
                n += pops[at]
                at = fail[at]
        return at, n, False

    def _plain(self) -> tuple[dict[int, int], list[int], list[int], int]:
        if self._lists is None:
            self._lists = dict(zip(self.keys.tolist(), self.to.tolist())), self.fail.tolist(), self.pops.tolist()
        return *self._lists, 0


def pieces_of_ranks(tokens: Iterable[bytes]) -> tuple[set[bytes], set[bytes]]:
    """(initial, inner) entries of a byte-level vocabulary: a leading space begins a word."""
    initial, inner = set(), set()
    for t in tokens:
        if t[:1] == b" " and len(t) > 1:
            initial.add(t[1:])
        else:
            inner.add(t)
            if len(t) == 1:
                initial.add(t)
    return initial, inner


def count_tokens(docs: DataFrame, initial: set[bytes], inner: set[bytes]) -> DataFrame:
    """doc_id, n_words and n_tokens of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast((initial, inner))  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(*shared.value)
        for batch in batches:
            buf, offs = _bytes.text_bytes(batch.column("text"))
            words, tokens = np.zeros(len(offs) - 1, np.int64), np.zeros(len(offs) - 1, np.int64)
            for lo, hi in _bytes.chunks(offs, 8 * _bytes.CHUNK):
                own, part = offs[lo : hi + 1] - offs[lo], buf[offs[lo] : offs[hi]]
                start, end, hashed = _bytes.words(part, own, _bytes.space_words(), fold=False)
                _, first, which = np.unique(hashed, return_index=True, return_inverse=True)
                counts = automaton.count(part, start[first], (end - start)[first])[which]
                total, bounds = np.concatenate([[0], np.cumsum(counts)]), _bytes.per_doc(start, own)
                words[lo:hi], tokens[lo:hi] = np.diff(bounds), np.diff(total[bounds])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words), pa.array(tokens)], names=["doc_id", "n_words", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_words long, n_tokens long")
