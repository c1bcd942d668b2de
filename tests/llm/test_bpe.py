import random

import pytest
import tiktoken

public_tokenizers = pytest.importorskip("public_tokenizers")
from sievewright.llm import bpe  # noqa: E402

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def tools():
    ranks = bpe.read_ranks(PATH)
    return bpe.TextCodec(ranks, PATTERN), tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_the_library(tools):
    own, library = tools
    rnd = random.Random(1)
    odd = ["".join(rnd.choice("ab \n\té🙂中's12!\x1d\x85\xa0") for _ in range(rnd.randrange(120))) for _ in range(600)]
    for text in ["", " ", "a  b", " a", "a ", "x \xa0 y", "a" * 5000, " " * 900, "I'll <|endoftext|> don't", *odd]:
        assert own.ids(text) == library.encode_ordinary(text)
        n, ids, back = own.text(text)
        assert back == text.encode() and n == len(own.ids(text)) and ids == " ".join(map(str, own.ids(text)))


def test_appends_and_edits_are_exact(tools):
    coder = tools[0].bpe
    rnd = random.Random(2)
    for _ in range(100):
        grown = bpe.Growing(coder)
        for _ in range(6):
            new = "".join(rnd.choice("thequickbrownfx") for _ in range(rnd.randrange(1, 9))).encode()
            if rnd.random() < 0.5:
                grown.append(new)
            else:
                at = rnd.randrange(len(grown.piece) + 1)
                grown.replace(at, min(len(grown.piece), at + 3), new)
            assert grown.ids() == coder.encode(grown.piece) and coder.decode(grown.ids()) == grown.piece


def test_edits_refill_near_the_change_only(tools):
    coder = tools[0].bpe
    rnd = random.Random(3)
    for alphabet in ("thequickbrownfx", "a", "ab", "  \n"):
        text = "".join(rnd.choice(alphabet) for _ in range(20_000)).encode()
        grown = bpe.Growing(coder, text)
        for _ in range(5):
            at = rnd.randrange(len(grown.piece))
            grown.replace(at, at + rnd.randrange(4), b"zq"[: rnd.randrange(3)])
            assert grown.last == coder.last_tokens(grown.piece)
            if alphabet == "thequickbrownfx":
                assert grown.filled < 3 * coder.longest


def test_a_codec_for_each_pattern(tools):
    ranks = tools[0].bpe.ranks
    one, two = bpe.codec(PATH, ranks, PATTERN), bpe.codec(PATH, ranks, r"\S+|\s+")
    assert one is not two and bpe.codec(PATH, ranks, r"\S+|\s+") is two


def test_frames(spark):
    docs = spark.createDataFrame([(1, "hello world", "x"), (2, None, "y"), (3, "", "z"), (3, "", "z")], "doc_id long, text string, ids string")
    out = {r.doc_id: r for r in bpe.encode_documents(docs, PATH, PATTERN).collect()}
    assert out[1].n_tokens == 2 and out[2].ids == [] and out[2].ids_sha256 == out[3].ids_sha256
    back = bpe.decode_documents(bpe.encode_documents(docs, PATH, PATTERN), PATH)
    assert {r.doc_id: bytes(r.bytes) for r in back.collect()} == {1: b"hello world", 2: b"", 3: b""}
    assert bpe.encode_digests(docs.limit(0), PATH, PATTERN).count() == 0
