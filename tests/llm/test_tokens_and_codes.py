"""Piece models, vector codes and token alignment against the libraries and brute force."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

public_tokenizers = pytest.importorskip("public_tokenizers")
from sievewright.llm import alignment, codes, pieces  # noqa: E402

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
FIXED = ["", " ", "  ", "a  b", " a", "a ", "x \xa0 y", "a" * 3000, " " * 900, "I'll <s> </s> <unk> <0x41> don't <|endoftext|>", "中文字" * 500, "▁", "▁▁a▁ b", "é́", "�", "\U0010ffff"]


def odd(n, seed=1, alphabet="ab  \n\té🙂中's12!\x1c\x85\xa0 ​▁\x00<0x>."):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    tool = Tokenizer.from_file(BYTES)
    tool.encode_special_tokens = True
    return tool, sentencepiece.SentencePieceProcessor(model_file=PIECES)


# ---- pieces ----
def test_same_pieces_as_the_library(library):
    tool, own = library[1], pieces.PieceCodec(pieces.read_model(PIECES)[1])
    spaces = ["".join(random.Random(k).choice(" " * (k % 30 + 1) + "a.\n") for _ in range(k % 80)) for k in range(600)]
    texts = FIXED + odd(1500) + spaces
    for text, ids in zip(texts, own.encoded(texts)):
        numbers = ids.split(" ") if ids else []
        assert list(map(int, numbers)) == tool.encode(text)
        assert own.decoded(numbers) == own.model.decode(tool.encode(text)) == tool.decode(tool.encode(text))
    rnd = random.Random(2)
    for _ in range(1500):  # ids that no text has: broken characters, controls, unknown ones
        ids = [rnd.choice([0, 1, 2, 259, 261, 29871, 3, 130, 230, 231, 187, rnd.randrange(32000)]) for _ in range(rnd.randrange(12))]
        assert own.model.decode(ids) == tool.decode(ids)


def test_piece_operators(spark, library):
    texts = [None, *FIXED, *odd(100)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "x"), (3, "x"), (3, "x")], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = {r.doc_id: r for r in pieces.encode_digests(df.where("text <> 'x' OR text IS NULL"), PIECES, checked=1).collect()}
    for i, t in enumerate(texts):
        ids = library[1].encode(t or "", add_eos=True)
        said = library[1].decode(ids)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(said.encode()).hexdigest())
    rows = pieces.encode_documents(df.where("text = 'x'"), PIECES, eos=False).collect()
    assert [r.doc_id for r in rows].count(3) == 2 and {tuple(r.ids) for r in rows} == {tuple(library[1].encode("x"))} and {r.decoded for r in rows} == {"x"}
    back = pieces.decode_documents(pieces.encode_documents(df, PIECES).select("doc_id", "ids"), PIECES)
    assert {r.text for r in back.where("doc_id IS NULL").collect()} == {"x"}
    assert pieces.encode_digests(df.limit(0), PIECES).count() == 0


def test_a_difference_from_the_library_fails(library):
    with pytest.raises(RuntimeError, match="doc_id 7"):
        pieces._compare(library[1], [7], ["ab"], [["5"]], ["ab"])


# ---- vector codes ----
def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = sorted(((i, [math.floor(256 * float(x)) for x in v], label) for i, v, label in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * w : p * w + w]
    books = [[cut(r[1], p) for r in kept[:entries]] for p in range(parts)]

    def assign():
        return [[min(range(len(books[p])), key=lambda e: (sum((x - c) ** 2 for x, c in zip(cut(v, p), books[p][e])), e)) for p in range(parts)] for _, v, _ in kept]

    for _ in range(rounds):
        at = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [cut(r[1], p) for r, a in zip(kept, at) if a[p] == e]
                if mine:
                    books[p][e] = [math.floor(sum(x) / len(mine)) for x in zip(*mine)]
    at = assign()
    error = [sum(sum((x - c) ** 2 for x, c in zip(cut(v, p), books[p][a[p]])) for p in range(parts)) for (_, v, _), a in zip(kept, at)]
    by = Counter()
    for (_, _, label), x in zip(kept, error):
        by[label] += x
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i if i is not None else -1), "".join(f"{x:02x}" for x in a), e, by[label], digest) for (i, _, label), a, e in zip(kept, at, error))


def test_codes_against_brute_force(spark):
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(400, 32)).astype(np.float32)
    x[100:250] = x[99]  # a hot vector
    rows = [(1000 - i, v.tolist(), None if i % 3 == 0 else i % 5) for i, v in enumerate(x)] + [(7, x[0].tolist(), 1), (7, x[0].tolist(), 1), (None, x[1].tolist(), 2), (8, [1e30] * 32, 4)]
    bad = [(2, None, 1), (3, [float("nan")] * 32, 1), (4, [None] * 32, 1), (5, [float("inf")] * 32, 1), (6, [], 1), (2000, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int").withColumns({"v": F.lit(1), "code": F.lit("clash")}).repartition(5)
    got = sorted((r.vec_id if r.vec_id is not None else -1, r.code, r.error, r.label_error, r.codebooks_sha256) for r in codes.digests(df).collect())
    most = codes.MOST / 256
    assert got == brute_codes([(i, [min(max(c, -most), most) for c in v], label) for i, v, label in rows])


def test_codes_of_few_rows_and_back(spark):
    df = spark.createDataFrame([(i, [float(i)] * 16, "a") for i in range(10)], "vec_id long, embedding array<double>, label string")
    told, books = codes.compress(df)
    assert {(r.vec_id, r.error) for r in told.collect()} == {(i, 0) for i in range(10)}
    assert {(r.vec_id, tuple(r.v)) for r in codes.decompress(told, books).collect()} == {(i, (256 * i,) * 16) for i in range(10)}
    assert codes.digests(df.limit(0)).count() == 0
    uneven, _ = codes.compress(df.withColumn("embedding", F.transform("embedding", lambda x: x * 2)), parts=5, entries=4, rounds=3)
    assert uneven.count() == 10 and {len(r.code) for r in uneven.collect()} == {5}


def test_only_changes_move():
    spans = [(0, 1), (1, 2)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([[5, 7], [1, 2]], pa.list_(pa.int32())), pa.array([b"\x00\x01", None], pa.binary()), pa.array([b"\x00\x00", b"\x01\x01"], pa.binary())], names=["v", "was", "code"])
    out = [r for b in codes._changes(2, spans)(iter([batch])) for r in b.to_pylist()]
    # the first row moves its second part from 1 to 0, the second row arrives
    assert [(r["part"], r["entry"], r["n"], r["sums"]) for r in out] == [(0, 1, 1, [1]), (1, 0, 1, [7]), (1, 1, 0, [-5])]


# ---- alignment ----
def brute_alignment(library, texts):
    tool, sp = library
    byte = {c: b for b, c in enumerate(alignment._letters())}
    told = []
    for text in texts:
        a = tool.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        ab = [bytes(byte[c] for c in tool.id_to_token(i)) for i in a]
        bb = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or {b"".join(ab), b"".join(bb)} != {(" " + text).encode()}:
            told.append((0, 0, [], []))
            continue
        ends = [{e: i for i, e in enumerate(np.cumsum([len(y) for y in x]).tolist())} for x in (ab, bb)]
        groups, links, at = [], [], [0, 0]
        for e in sorted(set(ends[0]) & set(ends[1])):
            i, j = ends[0][e], ends[1][e]
            groups.append(",".join(map(str, a[at[0] : i + 1])) + "|" + ",".join(map(str, b[at[1] : j + 1])))
            links.append((b[j], a[i]))
            at = [i + 1, j + 1]
        told.append((len(a), len(b), groups, links))
    count = Counter(x for t in told for x in t[3])
    best = {}
    for (b, _), n in count.items():
        best[b] = max(best.get(b, 0), n)
    return [(na, nb, len(g), len(ls), sum(count[x] == best[x[0]] for x in ls), sum(count[x] for x in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if na else "") for na, nb, g, ls in told]


@pytest.mark.parametrize("chunks_a_part", [2048, 2])
def test_alignment_against_brute_force(spark, library, chunks_a_part, monkeypatch):
    texts = FIXED + odd(500) + odd(200, 3, "the cat sat on a mat. ") + ["the cat sat on the mat " * 20] * 150  # a third of all rows alike
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9_000, None), (None, "the cat"), (9_001, "the cat"), (9_001, "the cat")], "doc_id long, text string").withColumns({"key": F.lit(1), "n_a": F.lit("clash")}).repartition(6)
    got = {r.doc_id: tuple(r)[1:] for r in alignment.align(df, BYTES, public_tokenizers.PATTERN, PIECES, chunks_a_part).collect()}
    want = brute_alignment(library, [*texts, "", "the cat", "the cat", "the cat"])
    assert [got[i] for i in range(len(texts))] == want[: len(texts)] and got[9_000] == want[-4] and got[None] == got[9_001] == want[-1]
    assert alignment.align(df.limit(0), BYTES, public_tokenizers.PATTERN, PIECES).count() == 0


def test_best_pairs(spark, library):
    df = spark.createDataFrame([(1, "a b a c")], "doc_id long, text string")
    told = {(r.b, r.a): r.n for r in alignment.best_pairs(df, BYTES, public_tokenizers.PATTERN, PIECES).collect()}
    a, b = (library[0].encode(" a", add_special_tokens=False).ids[0], library[1].encode("a")[0])
    assert told[b, a] == 2 and len(told) == 3


def test_tables_of_a_worker_are_forgotten(monkeypatch):
    tool = alignment.Aligner(alignment.read_bytes(BYTES), public_tokenizers.PATTERN, pieces.read_model(PIECES)[1])
    first = tool.chunk(odd(300))
    monkeypatch.setattr(alignment, "MOST_KEPT", 10)
    for other in (odd(200, 9), odd(300)):
        again = tool.chunk(other)
    assert again[0] == first[0] and (again[2] == first[2]).all()
