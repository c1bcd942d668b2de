"""Similarity joins, growing components, Bloom filters, the posts index and running ranks against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievewright.functions.text import STOPWORDS
from sievewright.operators import bloom, feed, graph, pairs, post_index
from sievewright.operators.lineage import cut
from sievewright.operators.numbering import running


def brute_cosines(texts, least, tfidf):
    stop = set(STOPWORDS)
    vectors = {k: Counter(w for w in (t or "").lower().split() if len(w) > 1 and w not in stop) for k, t in texts}
    df = Counter(w for v in vectors.values() for w in v)
    weight = lambda w, n: n * ((math.log((len(texts) + 1) / (df[w] + 1)) + 1) if tfidf else 1)
    vectors = {k: {w: weight(w, n) for w, n in v.items()} for k, v in vectors.items() if v}
    norm = {k: math.sqrt(sum(x * x for x in v.values())) for k, v in vectors.items()}
    out = {}
    for a in vectors:
        for b in vectors:
            if a < b:
                sim = sum(x * vectors[b].get(w, 0) for w, x in vectors[a].items()) / (norm[a] * norm[b])
                assert abs(sim - least) > 1e-7
                if sim >= least:
                    out[a, b] = sim
    return out


def said(seed, n=90):
    rnd = random.Random(seed)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    texts = [" ".join(rnd.choices(words[: rnd.choice((8, 60))], k=rnd.randrange(1, 14)) + ["hot"] * rnd.randrange(3)) for _ in range(n)]
    copies = [texts[3]] * 25 + [texts[4] + " waa"] * 5 + ["the of", "", None]
    return list(enumerate(texts + copies))


@pytest.mark.parametrize("short", [64, 0])
@pytest.mark.parametrize("sent, block", [(2_000_000, 1024), (0, 5)])
@pytest.mark.parametrize("by, least", [("tfidf", 0.8512345), ("counts", 0.5012345)])
def test_cosine_join_loses_nothing(spark, monkeypatch, sent, block, by, least, short):
    monkeypatch.setattr(pairs, "SHORT", short)
    monkeypatch.setattr(pairs, "TERMS_SENT", sent)
    monkeypatch.setattr(pairs, "BLOCK", block)
    if sent == 0:
        monkeypatch.setattr(pairs, "SENT", -1)
        monkeypatch.setattr(pairs, "PLACES", (8, 16))  # a sketch that rules out little
    rows = said(7)
    df = spark.createDataFrame(rows, "seq long, text string")
    got = {(r.a, r.b): r.sim for r in pairs.cosine_pairs(df, least, by).collect()}
    want = brute_cosines(rows, least, by == "tfidf")
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_classes_stand_for_their_copies(spark):
    rows = said(8)
    df = spark.createDataFrame(rows, "seq long, text string")
    found, members = pairs.cosine_classes(df, 0.8512345)
    first = {r.seq: r.first for r in members.collect()}
    want = brute_cosines(rows, 0.8512345, True)
    assert {tuple(r)[:2] for r in found.collect()} == {(first[a], first[b]) if first[a] < first[b] else (first[b], first[a]) for a, b in want if first[a] != first[b]}
    # 26 copies of one text, 6 of another and such as chance makes are one class each
    assert Counter(first.values())[first[3]] >= 26 and sum(1 for k in first if first[k] == k) < len(rows) - 28
    assert pairs.cosine_classes(df.limit(0), 0.5)[0].count() == 0


@pytest.mark.parametrize("block", [1024, 5])
def test_earliest_match(spark, monkeypatch, block):
    monkeypatch.setattr(pairs, "BLOCK", block)
    rows = said(13)
    want = {}
    for a, b in sorted(brute_cosines(rows, 0.7512345, False)):
        want.setdefault(b, a)
    df = spark.createDataFrame(rows, "seq long, text string")
    assert {r.seq: r.match for r in pairs.earliest_match(df, 0.7512345).collect()} == want


def test_a_block_multiplies_some_terms_at_a_time(spark, monkeypatch):
    """The matrix of a block has COLUMNS columns at most, however many terms its vectors share."""
    monkeypatch.setattr(pairs, "COLUMNS", 7)
    widest, zeros = [0], np.zeros
    monkeypatch.setattr(pairs.np, "zeros", lambda shape, *more: (widest.append(shape[1] if isinstance(shape, tuple) and shape[0] == 40 else 0), zeros(shape, *more))[1])
    t, w = np.arange(50), np.full(50, 50**-0.5)
    batch = pa.RecordBatch.from_pylist([{"t": 1, "i": 0, "j": 0, "seq": k, "block": 0, "place": 0, "terms": t.tobytes(), "weights": w.tobytes()} for k in range(40)])
    out = list(pairs._meet_whole(0.9, True)(iter([batch])))
    assert {(a, b) for x in out for a, b in zip(x["a"].to_pylist(), x["b"].to_pylist())} == {(0, b) for b in range(1, 40)}
    # but for the products themselves, which are 40 by 40
    assert max(c for c in widest if c != 40) == 7


@pytest.mark.parametrize("block, sent", [(1024, 200_000), (4, -1)])
def test_overlaps_with_a_hot_keyword(spark, monkeypatch, block, sent):
    monkeypatch.setattr(pairs, "BLOCK", block)
    monkeypatch.setattr(pairs, "SENT", sent)
    rnd = random.Random(9)
    lists = {i: set(rnd.sample([f"k{j}" for j in range(40)], rnd.randrange(1, 9))) | ({"hot"} if rnd.random() < 0.4 else set()) for i in range(80)}
    df = spark.createDataFrame([(i, w) for i, x in lists.items() for w in sorted(x)], "seq long, term string")
    for least in (0.3, 0.75):
        got = {(r.a, r.b): (r.shared, round(r.overlap, 9)) for r in pairs.overlap_edges(df, least).collect()}
        want = {(a, b): (len(x & y), round(len(x & y) / min(len(x), len(y)), 9)) for a, x in lists.items() for b, y in lists.items() if a < b and len(x & y) / min(len(x), len(y)) >= least}
        assert got == want
    assert pairs.overlap_edges(df.limit(0)).count() == 0


def test_components_grow(spark):
    rnd = random.Random(10)
    edge = lambda: (rnd.randrange(60), rnd.randrange(60))
    old, new = [edge() for _ in range(18)], [edge() for _ in range(15)] + [(100, 100), (0, 101), (101, 0)]
    make = lambda e: spark.createDataFrame(e, "a long, b long")
    told = lambda df: {r.node: r.component for r in df.collect()}
    stored = graph.components(make(old))
    changes = graph.grown(stored, make(new))
    before, after = told(stored), told(graph.components(make(old + new)))
    changed = told(changes)
    assert changes.count() == len(changed) and {**before, **changed} == after
    assert changed == {n: c for n, c in after.items() if before.get(n) != c}  # nothing else is touched
    assert told(graph.grown(stored.limit(0), make(old))) == before and graph.grown(stored, make(new).limit(0)).count() == 0


def test_bloom_anti_join_is_exact(spark, monkeypatch):
    seen = spark.range(0, 3000).select((F.col("id") * 3).cast("string").alias("k")).unionByName(spark.createDataFrame([(None,)], "k string"))
    rows = spark.range(0, 9000).select(F.col("id"), F.col("id").cast("string").alias("k"), F.lit(None).cast("array<string>").alias("more")).unionByName(spark.createDataFrame([(-1, None, ["x"])], "id long, k string, more array<string>"))
    want = {i for i in range(9000) if i % 3} | {-1}
    assert {r.id for r in bloom.without_seen(rows, seen, "k").collect()} == want
    monkeypatch.setattr(bloom, "MOST_BYTES", 1)
    assert {r.id for r in bloom.without_seen(rows, seen, "k").collect()} == want
    assert bloom.without_seen(rows, seen.limit(0), "k").count() == 9001


def test_index_finds_what_the_texts_hold(spark, tmp_path):
    rnd = random.Random(11)
    texts = [" ".join(rnd.choices(["Red", "fox,", "ran", "far", "É2", "red-fox"], k=rnd.randrange(0, 9))) for _ in range(80)] + [None]
    posts = spark.createDataFrame([(i, f"u{i % 5}", t, ("en", "de")[i % 2]) for i, t in enumerate(texts)], "post_id long, author string, text string, lang string")
    members = spark.createDataFrame([("l", "U1"), ("l", "u2"), ("m", "u2")], "list_id string, account string")
    path = f"{tmp_path}/index"
    post_index.build(posts, path)
    index = post_index.PostIndex(spark, path, posts, members)
    import re

    line = {i: " " + " ".join(w.lower() for w in re.findall(r"\w+", t or "")) + " " for i, t in enumerate(texts)}
    has = lambda i, *w: all(f" {x} " in line[i] for x in w)
    cases = {
        "red": lambda i: has(i, "red"), '"red fox"': lambda i: has(i, "red fox"), '"fox red fox"': lambda i: has(i, "fox red fox"), "red-fox": lambda i: has(i, "red fox"), "far -ran": lambda i: has(i, "far") and not has(i, "ran"),
        '(É2 OR "ran far") -red': lambda i: (has(i, "é2") or has(i, "ran far")) and not has(i, "red"), "-red": lambda i: not has(i, "red"), "fox list:l lang:en": lambda i: has(i, "fox") and i % 5 in (1, 2) and i % 2 == 0,
        "list:l -list:m": lambda i: i % 5 == 1, "fox (lang:de OR from:u3)": lambda i: has(i, "fox") and (i % 2 == 1 or i % 5 == 3), "nowhere": lambda i: False, "fox -(lang:de)": lambda i: False,
    }
    for query, good in list(cases.items())[:-1]:
        assert sorted(r.post_id for r in index.search(query).collect()) == [i for i in line if good(i)], query
    # only the folders and row groups of the asked words are read
    plan = index.search("red fox")._jdf.queryExecution().toString()
    assert plan.count("PartitionFilters: [isnotnull(bucket") >= 2 and "PushedFilters: [IsNotNull(term), EqualTo(term," in plan


def test_index_gathers_words_of_many_posts(spark, tmp_path):
    texts = [(i, f"red fox w{i}") for i in range(50)] + [(7, "fox red"), (8, None)]
    path = f"{tmp_path}/index"
    posts = spark.createDataFrame(texts, "post_id long, text string").coalesce(1)
    post_index.build(posts, path)
    # a word moves once for all posts that are read together, and posts of one id are one
    rows = spark.read.parquet(path).collect()
    assert len(rows) < 70 and sum(len(r.posts) for r in rows if r.term == "red") == 50
    index = post_index.PostIndex(spark, path, posts)
    assert {r.post_id: r.places for r in index.postings("red").collect()} == {i: [0, 1] if i == 7 else [0] for i in range(50)}
    assert sorted(r.post_id for r in index.search('"red fox" -w3').collect()) == [i for i in range(50) if i != 3]


def test_ranks_and_running_sums(spark):
    rnd = random.Random(12)
    rows = [(i, rnd.choice(["a", "b", None]), float(rnd.randrange(6))) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, tier string, total double")
    got = {r.id: r.rank_in_tier for r in feed.ranked(df).collect()}
    assert got == {i: 1 + sum(1 for _, t, x in rows if t == tier and x > total) for i, tier, total in rows}
    told = running(df.select("tier", "id", F.lit(2).alias("v")), "tier", ["id"], "v", "upto").collect()
    assert {r.id: r.upto for r in told} == {i: 2 * sum(1 for j, t, _ in rows if t == tier and j <= i) for i, tier, _ in rows}


def test_first_match_asks_the_done_only(spark):
    done = [(3, "red fox runs"), (5, "blue whale sings"), (9, "red fox runs"), (10, None)]
    asked = [(0, "runs fox red"), (1, "green bird"), (2, "green bird"), (4, "blue whale sings loud"), (7, "")]
    make = lambda rows: spark.createDataFrame(rows, "seq long, text string")
    got = {r.seq: (r.match, round(r.sim, 6)) for r in pairs.first_match(make(asked), make(done)).collect()}
    assert got == {0: (3, 1.0), 4: (5, round(math.sqrt(3) / 2, 6))}
    assert pairs.first_match(make(asked), make(done).limit(0)).count() == 0 and pairs.first_match(make(asked).limit(0), make(done)).count() == 0


def test_leaders_of_long_chains(spark):
    """A chain longer than any number of rounds that settle all over the graph, with shortcuts."""
    rnd = random.Random(14)
    edges = {(i, i + 1) for i in range(160)} | {tuple(sorted(rnd.sample(range(160), 2))) for _ in range(30)} | {(200, b) for b in range(201, 240)}
    gone = {}
    for a, b in sorted(edges, key=lambda e: (e[1], e[0])):
        if a not in gone and b not in gone:
            gone[b] = a
    df = spark.createDataFrame(sorted(edges), "a long, b long").repartition(3)
    assert {r.node: r.duplicate_of for r in graph.leaders(df, few=40).collect()} == gone
    assert {r.node: r.duplicate_of for r in graph.leaders(df).collect()} == gone


@pytest.mark.parametrize("common", [0.0, 0.05, 0.2, 1.0])
@pytest.mark.parametrize("sent", [2_000_000, 0])
def test_long_vectors_meet_by_parts(spark, monkeypatch, common, sent):
    monkeypatch.setattr(pairs, "SHORT", 0)
    monkeypatch.setattr(pairs, "COMMON", common)
    monkeypatch.setattr(pairs, "TERMS_SENT", sent)
    monkeypatch.setattr(pairs, "PART", 20)
    rows = said(21)
    df = spark.createDataFrame(rows, "seq long, text string")
    for least in (0.8512345, 0.5012345):
        want = brute_cosines(rows, least, True)
        got = {(r.a, r.b): r.sim for r in pairs.cosine_pairs(df, least).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
        # of two sides only
        sides = df.select("seq", (F.col("seq") % 3 == 0).alias("side"))
        found, members = pairs.cosine_classes(df, least, sides=sides)
        told = {}
        for r in members.collect():
            told.setdefault(r.first, []).append(r.seq)
        across = [(min(x, y), max(x, y)) for r in found.collect() for x in told[r.a] for y in told[r.b]]
        assert len(across) == len(set(across)) and set(across) == {k for k in want if (k[0] % 3 == 0) != (k[1] % 3 == 0)}


def test_links_join_what_edges_do(spark):
    rnd = random.Random(31)
    for words in (12, 60, 200):
        lists = {i: set(rnd.sample([f"k{j}" for j in range(words)], rnd.choice((1, 2, 3, 4, 5, 6, 7, 8, 8, 8, 8)))) for i in range(90)}
        lists |= {100 + i: lists[i] for i in range(0, 20, 3)}
        df = spark.createDataFrame([(i, w) for i, x in lists.items() for w in sorted(x)], "seq long, term string")
        told = lambda edges: {r.node: r.component for r in graph.components(edges).collect()}
        assert told(pairs.overlap_links(df)) == told(pairs.overlap_edges(df))
    # a crowd makes a star, not its square of edges
    crowd = spark.range(300).select(F.col("id").alias("seq"), F.explode(F.array(F.lit("x"), F.lit("y"), F.lit("z"), *(F.concat(F.lit(f"w{k}-"), F.col("id").cast("string")) for k in range(5)))).alias("term"))
    assert pairs.overlap_links(crowd).count() < 1000 and pairs.overlap_edges(crowd).count() == 300 * 299 // 2
    assert pairs.overlap_links(df.limit(0)).count() == 0


def test_pairs_go_to_no_table(spark, monkeypatch):
    """Pairs may be the square of the facts: what is kept on the way has a row a fact or term at most."""
    texts = said(21, 60)
    kept = []
    monkeypatch.setattr(pairs, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    monkeypatch.setattr(pairs, "SHORT", 0)
    df = spark.createDataFrame(texts, "seq long, text string")
    assert {(r.a, r.b) for r in pairs.cosine_pairs(df, 0.3012345).collect()} == brute_cosines(texts, 0.3012345, True).keys()
    assert kept and not any("sim" in table.columns for table in kept)
    kept.clear()
    lists = spark.createDataFrame([(i, w) for i in range(40) for w in ("hot", "warm", f"w{i % 7}", f"v{i}")], "seq long, term string")
    assert pairs.overlap_edges(lists).count() == 40 * 39 // 2
    assert kept and all(table.count() <= 40 for table in kept)


@pytest.mark.parametrize("sent", [2_000_000, 0])
@pytest.mark.parametrize("by, least", [("tfidf", 0.8512345), ("counts", 0.5012345)])
def test_vectors_with_rare_terms_in_front_meet_by_these(spark, monkeypatch, sent, by, least):
    """Pairs are those of brute force whether rare terms alone are in front or common ones too, within a part and across."""
    for name, value in (("SHORT", 0), ("TERMS_SENT", sent), ("COMMON", 0.2), ("COMMON_LOW", 0.2), ("PART", 40), ("CELLS", 60)):
        monkeypatch.setattr(pairs, name, value)
    rows = said(17)
    df = spark.createDataFrame(rows, "seq long, text string")
    got = {(r.a, r.b): r.sim for r in pairs.cosine_pairs(df, least, by).collect()}
    want = brute_cosines(rows, least, by == "tfidf")
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_few_pairs_are_looked_at_by_fronts():
    """Two vectors without a shared front term are not even bounded."""
    rows = [[k, 3, 2, 1.0, np.array([2 * k, 2 * k + 1, 500], np.int64).tobytes(), np.array([0.8, 0.59, 0.11]).tobytes()] for k in range(200)]
    rows.append([200, 3, 2, 1.0, np.array([0, 1, 500], np.int64).tobytes(), np.array([0.81, 0.58, 0.09]).tobytes()])
    x = pairs._Part(rows, None)
    looked = []
    exact = pairs._exact
    pairs._exact = lambda x, y, i, j, *more: (looked.extend(zip(i, j)), exact(x, y, i, j, *more))[1]
    try:
        found = [(x.seq[i].tolist(), x.seq[j].tolist()) for i, j, _ in pairs._by_fronts(x, x, True, 0.85, 501)]
    finally:
        pairs._exact = exact
    assert found == [([0], [200])] and len(looked) == 1


@pytest.mark.parametrize("part", [49_152, 20])
def test_leaders_by_stretches_make_few_pairs(spark, monkeypatch, part):
    """A crowd of alike facts meets its leader; the pairs within are not made."""
    for name, value in (("SHORT", 0), ("STRETCH", 1), ("STRETCHES", (0.1, 0.5)), ("COMMON", 0.2), ("PART", part)):
        monkeypatch.setattr(pairs, name, value)
    rnd = random.Random(19)
    crowd = [" ".join(["alike"] * 40 + ["crowd"] * 40 + [f"x{chr(97 + k % 26)}{chr(97 + k // 26)}"]) for k in range(100)]
    texts = crowd + [t for _, t in said(18)]
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    made = []
    leaders = pairs.leaders
    monkeypatch.setattr(pairs, "leaders", lambda edges: (made.append(edges.count()), leaders(edges))[1])
    found, members = pairs.cosine_leaders(spark.createDataFrame(rows, "seq long, text string"), 0.8512345)
    got = {r.node: r.duplicate_of for r in pairs.spread_duplicates(found, members).collect()}
    want, lead = {}, []
    near = brute_cosines(rows, 0.8512345, True)
    for k, _ in rows:
        first = next((a for a in lead if (a, k) in near), None)
        want |= {} if first is None else {k: first}
        lead += [k] if first is None else []
    assert got == want and sum(made) < len(near) / 4


@pytest.mark.parametrize("short", [64, 0])
def test_of_two_sides_the_larger_moves_once(spark, monkeypatch, short):
    for name, value in (("SHORT", short), ("COMMON_LOW", 0.2), ("LATER", 3)):
        monkeypatch.setattr(pairs, name, value)
    moved = []
    dealt = pairs._dealt_parts, pairs._dealt_behind
    for name, deal in zip(("_dealt_parts", "_dealt_behind"), dealt):
        monkeypatch.setattr(pairs, name, lambda *a, deal=deal: (moved.append((out := deal(*a)).count()), out)[1])
    rows = said(21)
    side = {k: k % 9 == 0 for k, _ in rows}
    df = spark.createDataFrame([(k, t, side[k]) for k, t in rows], "seq long, text string, side boolean")
    got = {(r.a, r.b): r.sim for r in pairs.cosine_pairs_across(df.select("seq", "text"), df.select("seq", "side"), 0.5012345).collect()}
    want = {k: v for k, v in brute_cosines(rows, 0.5012345, True).items() if side[k[0]] != side[k[1]]}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    if not short:
        assert sum(moved) <= len(rows) + 2 * sum(side.values())
