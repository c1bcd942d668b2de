"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts of up to three bytes with the counts
of the bytes that followed. A byte is coded in the longest context that the
tree holds; a byte new to a context pays the escape probability and is tried in
the next shorter one, down to 1/256 (escape method C, no exclusions). The
statistics are frozen after training, so the code length of every (context,
byte) is a constant, and a text's exact code length under each language is a
sum of table entries. The language with the shortest code wins; the score is
its share of 2**-length over all languages.

Training reads at most about ROWS_A_LANGUAGE labelled documents of each
language, chosen by a hash of doc_id, and keeps at most NODES contexts of two
bytes and as many of three, an equal part for each language, the most frequent
ones. The languages are the LANGUAGES labels with most training rows, ties by
name; rarer labels are not learned, so a dirty label column costs no memory and
never stops a run. All three are parameters. They bound a worker's tables,
whatever the languages: 2 * NODES rows of costs and NODES rows of contexts, of
257 numbers of 4 bytes at most, and under 1 MB of byte pairs for each language.

Null text, empty text and text without a letter: `und`, score 0. No training
rows at all: every text is `und`. Ties go to the first language by name.
Repeated rows are predicted alike; text is read whole, in any length.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.llm import _bytes
from sievewright.llm._shared import KEPT, tidy

ROWS_A_LANGUAGE = 1500
NODES = 1 << 17
LANGUAGES = 200
_ORDER = 3


def is_held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves remainder 2 by 4; a null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (context, byte) for contexts of 0 to 3 bytes, by language.

    A key holds the gram's bytes below a leading one, so that lengths differ.
    """
    for batch in batches:
        codes, names = batch.column("lang").dictionary_encode(), None
        names, codes = codes.dictionary.to_pylist(), codes.indices.to_numpy(zero_copy_only=False)
        buf, offs = _bytes.text_bytes(batch.column("text"))
        for k, name in enumerate(names):
            keys, counts = [], []
            for i in np.flatnonzero(codes == k):
                b = buf[offs[i] : offs[i + 1]].astype(np.int64)
                for length in range(1, min(len(b), _ORDER + 1) + 1):
                    key = np.full(len(b) - length + 1, 1 << 8 * length)
                    for j in range(length):
                        key |= b[j : len(b) - length + 1 + j] << 8 * (length - 1 - j)
                    keys.append(key)
                if sum(map(len, keys)) > 1 << 20:
                    keys, counts = _merged(keys, counts)
            keys, counts = _merged(keys, counts)
            if len(keys[0]):
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys[0])), pa.array(keys[0]), pa.array(counts[0])], names=["lang", "gram", "n"])


def _merged(keys: list, counts: list) -> tuple[list, list]:
    done = sum(map(len, counts))
    flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    weight = np.ones(len(flat), np.int64)
    weight[:done] = np.concatenate(counts) if counts else 1
    unique, inverse = np.unique(flat, return_inverse=True)
    return [unique], [np.bincount(inverse, weight, len(unique)).astype(np.int64)]


class _Tree:
    """One language's frozen costs: bits of each byte behind each context."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        seen = np.zeros(256, bool)
        seen[grams[(grams >> 8) == 1] & 255] = True
        #: byte -> symbol; 0: a byte never met, which is also what stands before a text
        self.symbol = np.zeros(256, np.int32)
        self.symbol[seen] = 1 + np.arange(seen.sum())
        self.symbols = a = int(seen.sum()) + 1
        levels = []  # by length of context: contexts as keys of symbols in base a, last symbols, counts
        for order in range(_ORDER + 1):
            own = (grams >> 8 * (order + 1)) == 1
            key = np.zeros(own.sum(), np.int64)
            for j in range(order, 0, -1):
                key = key * a + self.symbol[(grams[own] >> 8 * j) & 255]
            levels.append((key, self.symbol[grams[own] & 255], counts[own]))
        nodes = [np.unique(key) for key, _, _ in levels]
        first = np.cumsum([0, *map(len, nodes)])
        cost = np.empty((max(first[-1], 1), a), np.float32)
        cost[:1] = 8.0

        def fill(order: int, shorter: np.ndarray) -> np.ndarray:
            """Costs of the contexts of a length, whose longest known suffixes are `shorter`; gives their numbers."""
            key, last, n = levels[order]
            below = cost[shorter].astype(np.float64)
            at = np.searchsorted(nodes[order], key)
            total, kinds = np.bincount(at, n, len(nodes[order])), np.bincount(at, minlength=len(nodes[order]))
            own = below - np.log2(kinds / (total + kinds))[:, None]
            own[at, last] = -np.log2(n / (total + kinds)[at])
            cost[first[order] : first[order + 1]] = own
            return first[order] + np.arange(len(nodes[order]), dtype=np.int32)

        fill(0, np.zeros(len(nodes[0]), np.int64))
        one = np.zeros(a, np.int32)
        one[nodes[1]] = fill(1, one[nodes[1]])
        two = np.tile(one, a)  # by the last two symbols
        two[nodes[2]] = fill(2, two[nodes[2]])
        three = fill(3, two[nodes[3] % a**2])
        # a pair that ends a known context of three has a row of what may stand before it, any other has one entry
        pairs = np.unique(nodes[3] % a**2)
        rows = np.repeat(two[pairs][:, None], a, axis=1)
        rows[np.searchsorted(pairs, nodes[3] % a**2), nodes[3] // a**2] = three
        self.node = np.concatenate([two, rows.ravel()])
        self.base, self.step = np.arange(a**2, dtype=np.int32), np.zeros(a**2, np.int8)
        self.base[pairs], self.step[pairs] = a**2 + a * np.arange(len(pairs)), 1
        self.cost = cost.ravel()

    def bits(self, part: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Bits of each document that isn't empty; `starts` are the documents' offsets in part."""
        s = self.symbol[part].astype(np.int64)
        before = []
        for back in range(1, _ORDER + 1):
            own = np.zeros(len(s), np.int64)
            own[back:] = s[:-back]
            for j in range(back):  # what stands before the document's start is unknown
                at = starts[:-1] + j
                own[at[at < len(s)]] = 0
            before.append(own)
        pair = before[1] * self.symbols + before[0]
        rows = self.node[self.base[pair] + before[2] * self.step[pair]].astype(np.int64) * self.symbols + s
        return np.add.reduceat(self.cost[rows], starts[:-1][np.diff(starts) > 0], dtype=np.float64)


class Model:
    """Frozen statistics: for each language the counts of its grams; a tree of costs of its own for each."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.languages = sorted(counts)
        self.counts = [counts[x] for x in self.languages]
        self._trees: list[_Tree] | None = None

    def trees(self) -> list[_Tree]:
        if self._trees is None:
            self._trees = [_Tree(*c) for c in self.counts]
        return self._trees

    def code_lengths(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Bits of each document under each language; documents lie at offs in buf."""
        out = np.zeros((len(offs) - 1, len(self.languages)))
        for lo, hi in _bytes.chunks(offs):
            part, starts = buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
            full = lo + np.flatnonzero(np.diff(starts))
            if len(part):
                for k, tree in enumerate(self.trees()):
                    out[full, k] = tree.bits(part, starts)
        return out


def train(docs: DataFrame, rows: int = ROWS_A_LANGUAGE, nodes: int = NODES, languages: int = LANGUAGES) -> Model:
    """Fit on rows of docs with text and lang; see the module for the bounds."""
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    sizes = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    if not sizes:
        return Model({})
    nodes = max(nodes // len(sizes), 1)
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, rows / r["count"]))])
    chosen = known.where(F.col("lang").isin([r["lang"] for r in sizes])).where(F.pmod(F.xxhash64(F.lit("lang"), F.coalesce("doc_id", F.xxhash64("text"))), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    counted = chosen.select("lang", "text").mapInArrow(tidy(_grams), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).persist()
    long = F.col("gram") >= 1 << 17  # contexts of two and three bytes; the shorter ones are at most 257 a language
    context, order = F.shiftright("gram", 8), F.col("gram") >= 1 << 25
    try:
        totals = counted.where(long).groupBy("lang", order.alias("three"), context.alias("context")).agg(F.sum("n").alias("total"))
        best = totals.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "three").orderBy(F.desc("total"), "context"))).where(F.col("rank") <= nodes)
        kept = counted.where(long).withColumn("context", context).join(best.select("lang", "context"), ["lang", "context"], "left_semi")
        table = counted.where(~long).unionByName(kept.select("lang", "gram", "n")).toArrow()
    finally:
        counted.unpersist()
    lang = table["lang"].combine_chunks().dictionary_encode()
    code, gram, n = lang.indices.to_numpy(), table["gram"].to_numpy(), table["n"].to_numpy()
    return Model({x: (gram[code == k], n[code == k]) for k, x in enumerate(lang.dictionary.to_pylist())})


_MODELS: dict[str, Model] = {}


def _shared(docs: DataFrame, model: Model):
    """A function that gives the model in a worker, where its trees are built once.

    What is sent is bounded by languages and contexts. The key is drawn anew for
    every model, so no worker scores with a former one.
    """
    key = uuid.uuid4().hex
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.counts))

    def get() -> Model:
        if key not in _MODELS:
            _MODELS.clear()
            _MODELS[key] = Model(dict(zip(*sent.value)))
            KEPT["langid"] = _MODELS.clear
        return _MODELS[key]

    return get


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score and bits_per_byte (of the best language; null for `und`)."""
    get, languages = _shared(docs, model), model.languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = get()
        for batch in batches:
            buf, offs = _bytes.text_bytes(batch.column("text"))
            n = len(offs) - 1
            letter = batch.column("has_letter").to_numpy(zero_copy_only=False).astype(bool)
            if languages and n:
                bits = own.code_lengths(buf, offs)
                best = bits.argmin(axis=1)
                least = bits[np.arange(n), best]
                score = 1 / np.exp2(least[:, None] - bits).sum(axis=1)
                known = letter
            else:
                best, least, score, known = np.zeros(n, int), np.zeros(n), np.zeros(n), np.zeros(n, bool)
            said = np.array([*languages, "und"], object)[np.where(known, best, len(languages))]
            rate = pa.array(least / np.maximum(np.diff(offs), 1), mask=~known)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(said, pa.string()), pa.array(np.where(known, score, 0.0)), rate], names=["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"])

    ready = docs.select("doc_id", "text", is_held_out(F.col("doc_id")).alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("has_letter"))
    return ready.mapInArrow(tidy(run, "langid"), "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double")


def identify(docs: DataFrame) -> DataFrame:
    """Train on the documents that aren't held out, predict all."""
    return predict(docs, train(docs.where(~is_held_out(F.col("doc_id")))))


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of docs that have a language, all columns as they are, but that a null lang gives way to the one found.

    Rejected are texts without a letter (null and empty ones included), texts
    that even the best language's statistics code in 8 bits a byte or more, as
    no model at all would, and texts of which no language has half of the
    score. Without training rows nothing has a language. Repeated rows fare
    alike; extra columns are kept.
    """
    get = _shared(docs, train(docs.where(~is_held_out(F.col("doc_id")))))
    schema, letter = docs.schema, "_has_letter"
    while letter in docs.columns:
        letter = "_" + letter

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = get()
        for batch in batches:
            keep = batch.column(letter).to_numpy(zero_copy_only=False).astype(bool)
            names = np.full(len(keep), None, object)
            if own.languages and len(keep):
                buf, offs = _bytes.text_bytes(batch.column("text"))
                bits = own.code_lengths(buf, offs)
                best = bits.argmin(axis=1)
                least = bits[np.arange(len(keep)), best]
                keep &= (least < 8.0 * np.diff(offs)) & (np.exp2(least[:, None] - bits).sum(axis=1) <= 2)
                names = np.array(own.languages, object)[best]
            else:
                keep[:] = False
            at = batch.schema.get_field_index("lang")
            lang = pc.coalesce(batch.column("lang"), pa.array(names, pa.string()).cast(batch.schema.field(at).type))
            told = batch.set_column(at, batch.schema.field(at).with_nullable(True), lang)
            yield told.drop_columns([letter]).filter(pa.array(keep, pa.bool_()))

    return docs.withColumn(letter, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).mapInArrow(tidy(run, "langid"), schema)
