"""Operators on texts against brute-force versions."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievewright.llm import _bytes, chat, decontaminate, langid, ngram_join, secrets, sharding, spans, wordpiece

EDGE = [(1, None), (2, ""), (3, " \n "), (4, "a"), (5, "a"), (5, "a")]


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"lang": F.lit("en"), "n_words": F.lit("clash"), "key": F.lit(1), "spans": F.lit(0)}) if extra else df


def words(text, pattern="[^\x20\x09-\x0d]+"):
    return re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


# ---- language ID ----
def test_ppm_code_lengths():
    counts = Counter()
    data = b"abracadabra abracadabra"
    for k in range(1, 5):
        for i in range(len(data) - k + 1):
            counts[1 << 8 * k | int.from_bytes(data[i : i + k], "big")] += 1
    model = langid.Model({"x": tuple(np.array(sorted(counts.items()), np.int64).T)})

    def bits(context, byte):
        while True:
            seen = {k & 255: n for k, n in counts.items() if k >> 8 == (1 << 8 * len(context) | int.from_bytes(context, "big"))}
            total = sum(seen.values())
            if total:
                if byte in seen:
                    return -math.log2(seen[byte] / (total + len(seen)))
                escape = -math.log2(len(seen) / (total + len(seen)))
            else:
                escape = 0
            if not context:
                return escape + 8
            return escape + bits(context[1:], byte)

    texts = [b"abra zebra", b"", b"c", "ünknown\x00".encode(), b"dab", data * 3]
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = model.code_lengths(np.frombuffer(b"".join(texts), np.uint8), offs)[:, 0]
    expected = [sum(bits(t[max(0, i - 3) : i], t[i]) for i in range(len(t))) for t in texts]
    assert np.allclose(got, expected, rtol=1e-5)


def test_language_held_out_and_edges(spark):
    rnd = random.Random(1)
    say = {"en": "the and of thing with that".split(), "de": "und der die ein nicht schön".split()}
    rows = [(i, " ".join(rnd.choices(say[lang], k=12)), lang) for i in range(200) for lang in [("en", "de")[i % 2]]]
    rows += [(1000, None, "en"), (1001, "123 !!", "de"), (1002, "", None), (1003, "the thing", None), (None, "der die", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:200])
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(200))
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003, None)] == ["und", "und", "und", "en", "de"]
    assert got[1000].score == 0 and 0.5 < got[1003].score <= 1
    untrained = langid.identify(docs.where("lang IS NULL")).collect()
    assert {r.lang_pred for r in untrained} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0
    kept = langid.accepted(docs)
    assert kept.columns == docs.columns and kept.count() == 202


# ---- secrets ----
def test_secrets(spark):
    said = 'x password: "hunter2hunter" é Secret=short token: token: abcdefgh1 AKIA1234567890AB AKIA12 ' + "0a" * 16 + " 🙂 key Zx9Qw3Er7Ty1Ui5Op0As8Df api_key = example-but-base"
    docs = frame(spark, [(10, said), (11, "q9Zx7Lm2Vb4Nc8Kd1Wp6Ht3Y"), (12, "abcdefghijklmnopqrstuvwxyz0123456789"), *EDGE])
    got = {r.doc_id: r for r in secrets.digests(docs).collect()}
    base = []
    for kind, pattern, ok in (("assign", secrets.ASSIGN, lambda m: len(m[2]) >= 8), ("access", secrets.ACCESS, lambda m: len(m[0]) >= 16), ("hex", secrets.HEX, lambda m: len(m[0]) >= 32)):
        base += [(m.start(), secrets.KINDS.index(kind), f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, said) if ok(m)]
    import hashlib

    assert got[10].base_sha256 == hashlib.sha256(",".join(x[2] for x in sorted(base)).encode()).hexdigest()
    assert set(x[2] for x in base) <= set(got[10].spans.split(","))
    at = said.index("Zx9Qw")
    assert f"entropy_base64:{at}:{said.index(' api_key')}" in got[10].spans
    assert got[11].spans == "entropy_base64:0:24" and got[12].spans == "" and all(got[k].spans == "" for k in (1, 2, 3, 4, 5))
    clean = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert clean[11] == "[secret]" and clean[12].startswith("abc") and clean[1] is None and "hunter2" not in clean[10] and "🙂" in clean[10]
    assert secrets.redact(docs).columns == docs.columns


def test_allowed_words_spare_only_their_windows(spark):
    key = "q9Zx7Lm2Vb4Nc8Kd1Wp6Ht3Y"
    said = [f"/example/{key}", f"{key}/your_{key}", f"{key}{'A' * 12}{key}", "exampleZx9Qw3Er7Ty1U", key]
    got = {r.doc_id: r.spans for r in secrets.digests(frame(spark, list(enumerate(said)))).collect()}
    two = lambda gap: f"entropy_base64:0:24,entropy_base64:{24 + gap}:{48 + gap}"
    assert got[0] == "entropy_base64:8:33" and got[4] == "entropy_base64:0:24"
    assert got[1] == "entropy_base64:0:25,entropy_base64:30:54" and got[2] == two(12) and got[3] == ""


def test_entropy_windows_match_fresh_counts(spark):
    rnd = random.Random(4)
    runs = ["".join(rnd.choice("abcXYZ0189+/" + "q" * k) for _ in range(rnd.randrange(20, 70))) for k in range(0, 60, 2)]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(runs)], "i int, r string")
    _, alphabet, bits, _ = secrets.CLASSES[1]
    got = {r.i: [(s.begin, s.end) for s in r.s] for r in rows.select("i", secrets._hot(F.col("r"), alphabet, 2.9).alias("s")).collect()}
    for i, run in enumerate(runs):
        expected = []
        for p in range(len(run) - 19):
            h = -sum(c / 20 * math.log2(c / 20) for c in Counter(run[p : p + 20]).values())
            assert abs(h - 2.9) > 1e-9
            if h >= 2.9:
                if expected and expected[-1][1] >= p:
                    expected[-1] = (expected[-1][0], p + 20)
                else:
                    expected.append((p, p + 20))
        assert got[i] == expected


# ---- sentence spans ----
def brute_spans(rows, least=20, long=None):
    """doc -> (sentences, which go): every run of two sentences and `least` words, or one of `long`, that some run before equals."""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        ws = [(m.start(), m.end()) for m in re.finditer("[^\x20\x09-\x0d]+", text)]
        sent = []
        for i, (b, e) in enumerate(ws):
            if i == 0 or re.search("[.!?\n\r]", text[ws[i - 1][1] - 1 : b]):
                sent.append([])
            sent[-1].append(text[b:e].lower())
        bad = set()
        for i in range(len(sent)):
            for j in range(i, len(sent)):
                n = sum(map(len, sent[i : j + 1]))
                if (j > i and n >= least) or (long is not None and j == i and n >= long):
                    key = tuple(w for x in sent[i : j + 1] for w in x)
                    bad |= set(range(i, j + 1)) if key in seen else set()
                    seen.add(key)
        out[doc] = (sent, bad)
    return out


@pytest.mark.parametrize("long", [None, 40])
def test_spans_against_brute_force(spark, long):
    rnd = random.Random(5)
    pool = [" ".join(rnd.choices("one two three four five six".split(), k=rnd.randrange(1, 14))).capitalize() + rnd.choice([".", "!", "?\n"]) for _ in range(30)]
    rows = [(i, " ".join(rnd.choices(pool, k=rnd.randrange(0, 12)))) for i in range(60)] + [(100, "w " * 45 + "."), (101, "before. " + "w " * 45 + ".")]
    docs = frame(spark, rows + [(k + 1000, t) for k, t in EDGE])
    got = {r.doc_id: r for r in spans.dedup(docs, long=long).collect()}
    for doc, (sent, bad) in brute_spans(rows, long=long).items():
        assert (got[doc].n_sentences, got[doc].n_removed) == (len(sent), len(bad)), doc
        assert words(got[doc].text) == [w for i, s in enumerate(sent) if i not in bad for w in s]
    assert got[101].n_removed == (0 if long is None else 1)  # one sentence is no run, unless it is asked for
    assert got[1001].text is None and got[1002].text == ""
    assert spans.dedup(docs.limit(0)).count() == 0


def test_spans_of_tables_without_a_run(spark):
    """Whole batches without a run: short texts, nulls and empties, and the last rows of a partition."""
    short = [(i, "hi there.") for i in range(50)]
    assert {(r.doc_id, r.n_removed, r.text) for r in spans.dedup(frame(spark, short).coalesce(1)).collect()} == {(i, 0, t) for i, t in short}
    nothing = [(i, (None, "", " \n")[i % 3]) for i in range(9)]
    assert {(r.doc_id, r.n_sentences, r.text) for r in spans.dedup(frame(spark, nothing)).collect()} == {(i, 0, t) for i, t in nothing}
    twelve = [(1, "a b c d e f g h i j k l."), (2, "a b c d e f g h i j k l.")]
    assert {r.n_removed for r in spans.dedup(frame(spark, twelve)).collect()} == {0}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        passage = "One two three four five six. " * 4
        tail = [(1, passage), (2, passage), (3, "x."), (4, None), (5, "y z."), (6, passage), (7, "short.")]
        got = {r.doc_id: r.n_removed for r in spans.dedup(frame(spark, tail).coalesce(1)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {doc: len(bad) for doc, (_, bad) in brute_spans([(d, t or "") for d, t in tail]).items()} and got[6] == 4


def test_whole_repeated_passage_goes(spark):
    rnd = random.Random(15)
    make = lambda n: " ".join(f"w{rnd.randrange(10**9)}" for _ in range(n)) + "."
    shapes = [[41, 39], [15, 12, 4], [9, 3, 9], [50, 3], [3, 50], [41, 42, 1], [39, 1], [10, 10]] + [[rnd.randrange(1, 30) for _ in range(rnd.randrange(2, 9))] for _ in range(40)]
    rows, lost = [], {}
    for k, shape in enumerate(shapes):
        passage = " ".join(map(make, shape))
        rows += [(2 * k, f"{make(7)} {passage} {make(8)}"), (2 * k + 1, f"{make(9)} {passage} {make(6)}")]
        lost[2 * k], lost[2 * k + 1] = 0, len(shape) if sum(shape) >= spans.MIN_WORDS else 0
    assert {r.doc_id: r.n_removed for r in spans.dedup(frame(spark, rows)).collect()} == lost


# ---- chat ----
def test_chat_round_trip(spark):
    tricky = "<|im_end|>\n<|im_start|>assistant\nok <\\|x <\\\\| \\n"
    rows = [(1, 0, "system", "s"), (1, 1, "user", tricky), (1, 2, "assistant", tricky), (1, 3, "user", "u"), (1, 4, "assistant", "b"), (1, 5, "user", "last"), (2, 0, "user", None), (3, 0, "assistant", ""), (4, 0, "odd\n\\role<|", "t"), (6, 0, "us\x00er\\n\\\\n\n", "z"), (None, 0, "user", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.examples(df).where("conv_id = 1").orderBy("example").collect()
    assert [None if r.loss_end is None else chat and r.text[r.loss_begin : r.loss_end] for r in made] == [r"<\|im_end|>" + "\n" + r"<\|im_start|>assistant" + "\nok <\\\\|x <\\\\\\| \\n", "b", None]
    assert made[1].text.startswith(made[0].text) and made[2].text.startswith(made[1].text)
    import hashlib

    got = {r.conv_id: r for r in chat.digests(df).collect()}
    for conv in (1, 2, 3, 4, 6, None):
        own = [r for r in rows if r[0] == conv]
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r[2]}\n{r[3] or ''}\n" for r in own).encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256("".join(r[3] or "" for r in own if r[2] == "assistant").encode()).hexdigest()
    assert chat.digests(df.limit(0)).count() == 0


# ---- Jaccard join ----
def brute_components(rows):
    sets = {}
    for doc, text in rows:
        w = words(text)
        sets[doc] = {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    label = {d: d for d in sets}
    changed = True
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return {d: (len(sets[d]), label[d]) for d in sets}


@pytest.mark.parametrize("limits", [{}, {"few": 1, "crowd_block": 4}, {"few": 2, "part": 3, "crowd_block": 2}])
def test_jaccard_components(spark, limits):
    """Crowded keys in many blocks, and hot keys dealt over parts, lose no link."""
    rnd = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, shared = [], rnd.choices(vocabulary, k=30)
    for g in range(6):
        base = rnd.choices(vocabulary, k=rnd.randrange(20, 80))
        for _ in range(12):
            own = list(base)
            for _ in range(rnd.randrange(0, 4)):
                own[rnd.randrange(len(own))] = rnd.choice(vocabulary)
            rows.append((len(rows) + 1, " ".join(own)))
    rows += [(200 + i, " ".join(shared + rnd.choices(vocabulary, k=rnd.randrange(2, 12)))) for i in range(25)]
    rows += [(300, "a b c"), (301, "A b  c"), (302, "a b"), (303, None), (304, ""), (305, " ")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link(frame(spark, rows), **limits).collect()}
    assert got == brute_components(rows)


def test_jaccard_ids_and_long_texts(spark):
    """Null ids take no part; rows of one id join their sets' groups; a text of a million words and a word of 3 MB."""
    rnd = random.Random(7)
    a, b = (" ".join(rnd.choices([f"u{i}" for i in range(500)], k=40)) for _ in range(2))
    long = " ".join(f"w{i % 9973}" for i in range(1_000_000))
    rows = [(None, a), (9, a), (7, b), (5, b + " x"), (9, b + " y"), (3, long), (4, long + " end"), (2, "z" * 3_000_000), (6, "z" * 3_000_000), (8, "z" * 3_000_001)]
    got = sorted(((r.doc_id, r.component_id) for r in ngram_join.link(frame(spark, rows)).collect()), key=str)
    assert got == [(2, 2), (3, 3), (4, 3), (5, 5), (6, 2), (7, 5), (8, 8), (9, 5), (9, 5), (None, None)]


def test_jaccard_edges(spark):
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link(frame(spark, EDGE)).collect())
    assert got == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (5, 1, 4)]
    assert ngram_join.link(frame(spark, EDGE).limit(0)).count() == 0


def test_trie_and_signatures():
    rnd = np.random.default_rng(7)
    base = rnd.integers(1, 1 << 62, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rnd.choice(base, rnd.integers(1, 60), replace=False), rnd.integers(1, 1 << 62, rnd.integers(0, 9), dtype=np.uint64)])) for _ in range(80)]
    trie = ngram_join.Trie([s[::-1].astype(">u8") for s in sets])
    marks = [ngram_join._signatures(s, np.array([0, len(s)]))[0] for s in sets]
    for i, s in enumerate(sets):
        expected = {j for j, t in enumerate(sets) if 4 * len(np.intersect1d(s, t)) >= 3 * len(np.union1d(s, t))}
        assert set(trie.linked(s)) == expected
        assert all(ngram_join.apart(marks[i], marks[j]) <= len(np.setxor1d(s, t)) for j, t in enumerate(sets))


# ---- decontamination ----
def test_decontamination(spark):
    rnd = random.Random(8)
    vocabulary = [f"v{i}é" for i in range(60)] + ["A", "b2"]
    items = [(str(i), " ".join(rnd.choices(vocabulary, k=k))) for i, k in enumerate((40, 13, 20, 3, 1, 14, 12))] + [("8", None), ("9", "...")]
    docs = []
    for i in range(40):
        own = rnd.choices(vocabulary, k=rnd.randrange(0, 60))
        if i % 2:
            w = items[rnd.randrange(7)][1].split()
            b = rnd.randrange(len(w))
            own[len(own) // 2 : len(own) // 2] = w[b : b + rnd.randrange(1, 40)]
        docs.append((i, ", ".join(own)))
    bench = spark.createDataFrame(items, "item_id string, text string")
    rows = frame(spark, docs + [(k + 100, t) for k, t in EDGE])
    pattern = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
    whole = {r.doc_id: r for r in decontaminate.judge(rows, bench).collect()}
    sliced = {r.doc_id: r for r in decontaminate.find(rows, bench, slice_bytes=60).collect()}
    for doc, text in docs:
        w, hit, met = words(text, pattern), set(), set()
        for item, said in items:
            v = words(said or "", pattern)
            m = min(13, len(v))
            grams = {tuple(v[p : p + m]) for p in range(len(v) - m + 1)} if m else set()
            for p in range(len(w) - m + 1):
                if m and tuple(w[p : p + m]) in grams:
                    hit |= set(range(p, p + m))
                    met.add(item)
        r = whole[doc]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(met), bool(hit) and 20 * len(hit) >= len(w))
        assert sliced[doc]["items"] == sorted(met) and sum(s.end - s.begin for s in sliced[doc].spans) == len(hit)
    assert whole[101].n_words == 0 and not whole[101].contaminated
    clean = decontaminate.judge(rows, bench.limit(0))
    assert clean.where("contaminated").count() == 0 and clean.count() == rows.count()


# ---- word pieces ----
def test_word_pieces(spark):
    rnd = random.Random(9)

    def brute(word, initial, inner):
        n = i = 0
        while i < len(word):
            for j in range(len(word), i, -1):
                if word[i:j] in (inner if i else initial):
                    n, i = n + 1, j
                    break
            else:
                return 1
        return n

    for _ in range(100):
        make = lambda k: {"".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 6))).encode() for _ in range(k)}
        initial, inner = make(rnd.randrange(12)), make(rnd.randrange(12))
        said = ["".join(rnd.choice("abcd" if rnd.random() < 0.1 else "abc") for _ in range(rnd.randrange(1, 15))).encode() for _ in range(40)]
        size = np.array([len(w) for w in said])
        got = wordpiece.Automaton(initial, inner).count(np.frombuffer(b"".join(said), np.uint8), np.cumsum(size) - size, size)
        assert got.tolist() == [brute(w, initial, inner) for w in said]
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in wordpiece.count_tokens(frame(spark, [(9, "ab abc\tq"), *EDGE]), {b"ab", b"a"}, {b"c"}).collect()}
    assert got == {9: (3, 4), 1: (0, 0), 2: (0, 0), 3: (0, 0), 4: (1, 1), 5: (1, 1)}


# ---- sharding ----
def test_jump(spark):
    def jump(key, n):
        key, b, j = key % (1 << 64), -1, 0
        while j < n:
            b = j
            key = (key * 2862933555777941757 + 1) % (1 << 64)
            j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
        return b

    keys = [0, 1, -1, 7, 10**18, *range(100, 400)]
    for n in (1, 2, 40, 41):
        assert sharding.jump(np.array(keys), n).tolist() == [jump(k, n) for k in keys]
    rows = [(k, f"t{k % 5}é") for k in keys] + [(None, None), (7, "again"), (7, "again")]
    got = sharding.assign(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.grown_shard in (r.shard, 40) and r.shard == jump(r.doc_id or 0, 40)
    for s in {r.shard for r in got}:
        own = sorted((r for r in got if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        ids = [r.doc_id for r in own if r.doc_id is not None]
        assert ids == sorted(ids)
    one = next(r for r in got if r.doc_id == 1)
    assert one.size == 16 + len("t1é".encode()) and one.text_crc32 == zlib.crc32("t1é".encode())
    assert sharding.assign(frame(spark, rows).limit(0)).count() == 0


def test_words_do_not_cross_documents():
    texts = ["ab cd", "", "ef", "Ab"]
    buf, offs = _bytes.text_bytes(pa.array(texts).slice(0, 4))
    start, end, hashed = _bytes.words(buf, offs, _bytes.space_words())
    assert [bytes(buf[b:e]) for b, e in zip(start, end)] == [b"ab", b"cd", b"ef", b"Ab"] and hashed[0] == hashed[3]
    buf, offs = _bytes.text_bytes(pa.array(["x", None, "yy"]).slice(1, 2))
    assert bytes(buf) == b"yy" and offs.tolist() == [0, 0, 2]


# ---- long texts, hot keys, clashing names ----
def test_long_candidate_run_and_many_matches(spark):
    """A run of 300,000 characters, across all stretches, and 20,000 matches: in time that follows their length."""
    rnd = random.Random(11)
    _, alphabet, bits, _ = secrets.CLASSES[1]
    run = "".join(rnd.choices(alphabet, k=300_000))
    rows = frame(spark, [(1, "x " + run), (2, "token=abcdef12345 " * 20_000)], extra=False)
    got = {r.doc_id: r for r in secrets.digests(rows).collect()}
    hot = [p for p in range(len(run) - 19) if -sum(n / 20 * math.log2(n / 20) for n in Counter(run[p : p + 20]).values()) >= bits]
    expected = []
    for p in hot:
        if expected and p <= expected[-1][1]:
            expected[-1][1] = p + 20
        else:
            expected.append([p, p + 20])
    barred = [m.span() for a in secrets.ALLOWED for m in re.finditer(a, run)]
    assert not barred
    assert [s for s in got[1].spans.split(",") if s.startswith("entropy_base64")] == [f"entropy_base64:{b + 2}:{e + 2}" for b, e in expected]
    assert got[2].n_assign == 20_000


def test_redact_keeps_clashing_columns(spark):
    docs = frame(spark, [(1, "a token=abcdef12345 b"), (2, None)]).withColumns({"_in_doc_id": F.lit(7), "row": F.lit(8), "base": F.lit(9), "_changed": F.lit(1), "a.b": F.lit(2)})
    out = secrets.redact(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: (r["text"], r["_in_doc_id"], r["row"], r["base"], r["a.b"]) for r in out.collect()}
    assert got == {1: ("a [secret] b", 7, 8, 9, 2), 2: (None, 7, 8, 9, 2)}


def test_spans_of_repeated_ids_and_a_hot_run(spark):
    """A second row of an id keeps its own text whole; a run that every document holds stays in the first only."""
    hot = "This is a long passage of words that all of the documents hold somewhere. It goes on for a second sentence of more words."
    rows = [(i, f"Own words {i} here are. {hot}") for i in range(40)] + [(2, "Quite another text of two sentences that no other row has at all. It is long enough to be a run by itself.")]
    got = sorted((r.doc_id, r.n_removed, r.text) for r in spans.dedup(frame(spark, rows).repartition(3)).collect())
    assert [(i, n) for i, n, _ in got] == [(0, 0), (1, 2), (2, 0), (2, 2), *[(i, 2) for i in range(3, 40)]]
    assert rows[-1][1] in [t for _, _, t in got]


def test_piece_counts_of_long_words():
    """Beyond the bytes that words walk together, and in a word of a million bytes."""
    rnd = random.Random(12)
    initial, inner = {b"ab", b"a", b"b", b"aab"}, {b"ab", b"a", b"b", b"bba", b"abab"}
    said = [bytes(rnd.choices(b"ab", k=k)) for k in (3, 255, 256, 257, 900, 1_000_000)] + [b"a" * 400 + b"z"]
    size = np.array([len(w) for w in said])
    got = wordpiece.Automaton(initial, inner).count(np.frombuffer(b"".join(said), np.uint8), np.cumsum(size) - size, size)
    for w, n in zip(said, got.tolist()):
        at, count = 0, 0
        while at < len(w):
            fit = max((p for p in (initial if at == 0 else inner) if w.startswith(p, at)), key=len, default=None)
            if fit is None:
                count = 1
                break
            at, count = at + len(fit), count + 1
        assert n == count


def test_contaminated_rows_go_whatever_their_ids(spark):
    passage = " ".join(f"v{i}" for i in range(20))
    docs = frame(spark, [(None, passage), (1, passage), (1, "clean words only"), (None, None), (2, "one")])
    items = spark.createDataFrame([(1, passage), (2, "one"), (3, None)], "item_id long, text string")
    for limit in (decontaminate.SLICE_BYTES, 10):
        left = decontaminate.clean(docs, items, slice_bytes=limit)
        assert left.columns == docs.columns
        assert sorted(map(str, ((r.doc_id, r.text) for r in left.collect()))) == ["(1, 'clean words only')", "(None, None)"]


def test_labels_beyond_the_limit_are_not_learned(spark):
    rows = [(i, f"word number {i} " * 3, f"l{i % 5}" if i % 7 else "rare") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.train(docs, languages=3).languages == ["l0", "l1", "l2"] or len(langid.train(docs, languages=3).languages) == 3
    assert len(langid.train(docs).languages) == 6
    assert sum(len(set(g[g >= 1 << 25] >> 8)) for g, _ in langid.train(docs, nodes=12).counts) <= 12


def test_shards_of_a_batch_are_searched_alike():
    passage = " ".join(f"v{i}" for i in range(30))
    texts = pa.array(["", passage, "clean words " * 40, None, f"x {passage[:80]} y", "one", passage * 3, ""])
    slices = [decontaminate.Windows([("1", passage), ("2", "one")]), decontaminate.Windows([("3", "clean words clean")])]
    whole, parts = (decontaminate._found(texts, slices, size) for size in (1 << 20, 50))
    assert whole[0].tolist() == parts[0].tolist() and whole[1] == parts[1]
    assert len(whole[1]) == len(texts) and {i for x in whole[1] for i in x[1]} == {"1", "2", "3"}


# ---- rows without ids ----
def test_items_without_id_are_their_own(spark):
    text = " ".join(f"w{i}" for i in range(40))
    other = " ".join(f"v{i}" for i in range(40))
    docs = frame(spark, [(1, text), (2, f"{text} {other}"), (3, "nothing of it"), (None, other)])
    items = spark.createDataFrame([(None, text), (None, other), (7, text)], "item_id long, text string")
    import hashlib

    sha = lambda *x: hashlib.sha256(",".join(x).encode()).hexdigest()
    for slice_bytes in (decontaminate.SLICE_BYTES, 10):
        got = {r.doc_id: r for r in decontaminate.find(docs, items, slice_bytes=slice_bytes).collect()}
        assert got[1]["items"] == ["", "7"] and got[2]["items"] == ["", "", "7"] and got[3]["items"] == [] and got[None]["items"] == [""]
    judged = {r.doc_id: r for r in decontaminate.judge(docs, items).collect()}
    assert (judged[2].n_items, judged[2].items_sha256) == (3, sha("", "", "7")) and judged[None].n_items == 1


def test_languages_are_learned_from_rows_without_id(spark):
    say = {"en": "the and of thing with that", "de": "und der die ein nicht sehr"}
    rnd = random.Random(21)
    rows = [(None, " ".join(rnd.choices(words_.split(), k=12)), lang) for lang, words_ in say.items() for _ in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    told = langid.predict(df, langid.train(df, rows=100))
    assert told.join(df.distinct(), told.lang_pred == df.lang, "left_semi").count() == 600
    assert {r.lang_pred for r in told.collect()} == {"en", "de"}
