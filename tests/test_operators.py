"""Operators against plain Python models on small random inputs."""

import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from sievewright.functions.text import ENGLISH_STOPWORDS
from sievewright.operators import analyze, feed, pairs, report, vectors
from sievewright.operators.graph import components, leaders
from sievewright.plans import catalog
from sievewright.sources import state

WORDS = "alpha beta gamma delta epsilon zeta eta theta not never".split()


def texts(seed, n):
    rnd = random.Random(seed)
    out = [" ".join(rnd.choices(WORDS, k=rnd.randrange(0, 7))) for _ in range(n)]
    return out + ["2024 2025", "2024 2025", ""]


def facts(spark, said):
    return spark.createDataFrame([(i, str(i), t) for i, t in enumerate(said)], "seq long, id string, text string")


def cosines(said):
    docs = [[w for w in t.split() if w.isalpha() and w not in ENGLISH_STOPWORDS] for t in said]
    df = Counter(w for d in docs for w in set(d))
    vec = [{w: c / len(d) * (math.log((len(docs) + 1) / (df[w] + 1)) + 1) for w, c in Counter(d).items()} for d in docs]
    norm = [math.sqrt(sum(x * x for x in v.values())) for v in vec]
    return {(i, j): sum(v * vec[j].get(w, 0) for w, v in vec[i].items()) / (norm[i] * norm[j]) for i in range(len(docs)) for j in range(i + 1, len(docs)) if vec[i] and vec[j]}


def test_cosine_pairs_lose_nothing(spark):
    said = texts(1, 60)
    expected = cosines(said)
    for least in (0.5, 0.85):
        got = {(r.a, r.b): r.sim for r in pairs.tfidf_pairs(facts(spark, said), least).collect()}
        assert set(got) == {k for k, v in expected.items() if v >= least - 1e-9}
        assert all(abs(v - expected[k]) < 1e-9 for k, v in got.items())


def test_each_pair_has_its_own_statistics(spark):
    said = texts(4, 30)
    got = {(r.a, r.b): r.sim for r in pairs.successor_cosines(facts(spark, said)).collect()}
    assert set(got) == {(i, i + 1) for i in range(len(said) - 1)}
    assert all(abs(sim - cosines([said[i], said[j]]).get((0, 1), 0)) < 1e-9 for (i, j), sim in got.items())


def test_leaders_of_a_long_chain(spark):
    chain = spark.range(5000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {(r.node, r.duplicate_of) for r in leaders(chain).collect()} == {(i, i - 1) for i in range(1, 5001, 2)}


def test_leaders_by_rounds_and_in_order_agree(spark):
    rnd = random.Random(8)
    edges = spark.createDataFrame([tuple(sorted(rnd.sample(range(40), 2))) for _ in range(60)], "a long, b long")
    found = [{(r.node, r.duplicate_of) for r in leaders(edges, few).collect()} for few in (0, 15, 1000)]
    assert found[0] and found[0] == found[1] == found[2]
    assert leaders(edges.limit(0)).count() == 0


def test_every_query_meets_all_before_it(spark):
    said = texts(3, 50)
    said += said[:9]
    bags = [Counter(w for w in t.split() if w.isalpha() and w not in ENGLISH_STOPWORDS) for t in said]
    size = [math.sqrt(sum(n * n for n in b.values())) for b in bags]
    alike = lambda i, j: bags[i] and bags[j] and sum(n * bags[j][w] for w, n in bags[i].items()) / (size[i] * size[j]) >= 0.75 - 1e-9
    expected = {j: next(i for i in range(j) if alike(i, j)) for j in range(len(said)) if any(alike(i, j) for i in range(j))}
    assert any(i % 2 == j % 2 for j, i in expected.items())
    rows = facts(spark, said)
    assert {r.seq: r.match for r in pairs.earliest_match(rows).collect()} == expected
    assert pairs.earliest_match(rows.limit(0)).count() == 0


def test_leaders_follow_the_order(spark):
    rnd = random.Random(2)
    edges = sorted({tuple(sorted(rnd.sample(range(40), 2))) for _ in range(90)})
    got = {r.node: r.duplicate_of for r in leaders(spark.createDataFrame(edges, "a long, b long")).collect()}
    lead, expected = [], {}
    for node in range(40):
        first = next((x for x in lead if (x, node) in set(edges)), None)
        if first is None:
            lead.append(node)
        else:
            expected[node] = first
    assert got == expected


def test_chain_keeps_its_third(spark):
    got = leaders(spark.createDataFrame([(0, 1), (1, 2)], "a long, b long")).collect()
    assert [(r.node, r.duplicate_of) for r in got] == [(1, 0)]


def test_components(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 130)] + [tuple(rnd.sample(range(60), 2)) for _ in range(40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b), near[b].add(a)
    for node in near:
        seen, todo = {node}, [node]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x), todo.append(x)
        assert got[node] == min(seen)


def test_dedup_and_sticky_flags(spark):
    said = ["alpha beta", "alpha beta", "gamma delta", "2024 2025", "2024 2025"]
    got = {r.seq: (r.is_duplicate, r.duplicate_of) for r in analyze.deduplicate(facts(spark, said)).collect()}
    assert got == {0: (False, None), 1: (True, 0), 2: (False, None), 3: (False, None), 4: (False, None)}
    flagged = facts(spark, said).withColumn("is_duplicate", F.col("seq") == 0)
    got = {r.seq: r.is_duplicate for r in analyze.deduplicate(flagged).collect()}
    assert got == {0: True, 1: False, 2: False, 3: False, 4: False}


def test_clusters_conflicts_and_keywords(spark):
    said = ["solar power grows", "solar power shrinks", "tea leaves", "solar power never grows", ""]
    rows = facts(spark, said)
    found = {r.cluster_id: r for r in analyze.clusters(rows).collect()}
    assert [found[k].member_ids for k in sorted(found)] == [["0", "1", "3"], ["2"], ["4"]]
    assert found[0].label.startswith("solar / power") and found[2].label == ""
    clash = {(r.learning_a, r.learning_b) for r in analyze.conflicts(rows, 0.3).collect()}
    assert ("0", "3") in clash and ("0", "1") not in clash
    assert [r.term for r in vectors.top_keywords(rows, 2, by="n").where("seq = 2").orderBy("rank").collect()] == ["tea", "leaves"]


def test_empty_tables(spark):
    none = facts(spark, []).limit(0)
    assert analyze.deduplicate(none).count() == 0 and analyze.clusters(none).count() == 0 and analyze.conflicts(none).count() == 0


def test_reports(spark):
    rows = spark.createDataFrame([(0, "0", "x", "http://a.com/1", "A"), (1, "1", "y", "http://b.org/2", "B" * 70), (2, "2", "z", "http://a.com/1", "A"), (3, "3", "w", "", None)], "seq long, id string, text string, source_url string, source_title string")
    sources = report.source_index(rows)
    assert [(r["index"], r["url"]) for r in sources.orderBy("index").collect()] == [(1, "http://a.com/1"), (2, "http://b.org/2")]
    groups = spark.createDataFrame([(0, 1, "one"), (1, 1, "one"), (2, 2, "other"), (3, 2, "other")], "seq long, group int, label string")
    none = spark.createDataFrame([], "seq_a long, seq_b long, text_a string, text_b string, similarity double")
    config = {"query": "q", "max_depth": 3, "base_breadth": 4, "visited": 2, "queries": 1, "active": 4, "written_at": "now"}
    lines = report.report_lines(rows, groups, none, sources, config)
    said = report.text_of(lines)
    assert "- x [1]" in said and "- y [2]" in said and "- w\n" in said and report.NO_CONFLICT in said and "B" * 60 + "..." in said
    visited = rows.select(F.col("source_url").alias("url"))
    checked = report.validate(spark.createDataFrame([("r", said)], "id string, text string"), sources, visited).first()
    assert checked.valid and checked.unused_sources == 0
    assert [r.line for r in report.section(lines, "cluster", 5).collect()] == []
    bad = spark.createDataFrame([("b", "[1] [2-3] [45] todo http://no.com/")], "id string, text string")
    got = report.validate(bad, sources, visited).first()
    assert not got.valid and (got.missing_citations, got.ranges, got.placeholders, got.unvisited_urls, got.cited_sources) == (1, 1, 1, 1, 2)


def test_report_query_tells_conflicts_clusters_and_counts(spark, tmp_path):
    said = ["solar power grows fast", "solar power never grows fast", "tea leaves", "tea leaves"]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(said)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, f"http://a.com/{i}", "") for i in range(5)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "r"), (2, 0, "user", "s")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    lines = catalog.QUERIES["report_lines"](spark, str(tmp_path))
    told = report.text_of(lines)
    assert "访问来源：5 个 | 有效发现：3 条 | 搜索查询：2 次" in told
    assert report.NO_CONFLICT not in told and "**观点 A** [1]: solar power grows fast" in told and "**观点 B** [2]: solar power never grows fast" in told
    heads = [r.line for r in lines.where("section = 'cluster' AND ord = -1").orderBy("part").collect()]
    assert len(heads) == 2 and heads[0].startswith("## 1. solar / power") and heads[1] == "## 2. tea / leaves"
    assert [r.line for r in report.section(lines, "cluster", 1).where("ord >= 0").collect()] == ["- tea leaves [3]"]


def test_state(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"config": {"query": "q"}, "learnings": [{"id": "a", "text": "t"}, {"id": "b", "text": "u", "is_duplicate": true}], "urls_visited": [], "followups": [{"question": "w", "priority": "low"}, {"question": "w", "priority": "high", "used": true}]}')
    tables = state.read_json(spark, str(tmp_path / "s.json"), "run")
    assert [(r.seq, r.id) for r in tables["facts"].orderBy("seq").collect()] == [(0, "a"), (1, "b")]
    assert [r.seq for r in state.unused_followups(tables["followups"]).collect()] == [0]
    assert [r.used for r in state.mark_followup(tables["followups"], "w").orderBy("seq").collect()] == [True, True]
    arriving = spark.createDataFrame([(0, "http://x.com/"), (1, "http://X.com"), (2, "http://y.com")], "seq long, url string")
    seen = spark.createDataFrame([("http://y.com/",)], "normalized string")
    assert [r.seq for r in state.unseen_urls(seen, arriving).collect()] == [0]
    done = spark.createDataFrame([(5, "alpha beta gamma"), (7, "alpha beta gamma delta")], "seq long, text string")
    asked = spark.createDataFrame([(0, "gamma beta alpha delta"), (1, "tea")], "seq long, text string")
    assert {r.seq: r.match for r in state.check_queries(done, asked).collect()} == {0: 5, 1: None}


def test_search(spark):
    posts = spark.createDataFrame([(1, "ann", "Deep learning rocks #AI", 5, True), (2, "bob", "deep fried", 50, False), (3, "cat", "nothing $AAPL", 500, True)], "post_id int, author string, text string, likes int, has_links boolean")
    find = lambda q: [r.post_id for r in posts.where(feed.search(q)).orderBy("post_id").collect()]
    assert find("deep") == [1, 2] and find('"deep learning"') == [1] and find("deep -fried") == [1]
    assert find("(from:ann OR from:cat) filter:links") == [1, 3] and find("#ai OR $aapl") == [1, 3] and find("min_faves:50 -filter:links") == [2]


def test_broken_markup_falls_back(spark):
    from sievewright.functions import content

    pages = spark.createDataFrame([(1, "<p>a<![foo[b]]>c</p>"), (2, "<p>fine</p>"), (3, None)], "id int, html string")
    got = {r.id: r.t for r in pages.select("id", content.extract_html(F.col("html")).alias("t")).collect()}
    assert got[1].startswith("a") and got[1].endswith("c") and got[2] == "fine" and got[3] is None


def test_memory_rounds_and_state_files(spark, tmp_path):
    from sievewright.sources import memory, state

    path = str(tmp_path / "memory")
    memory.write_memory(spark.createDataFrame([("a", 1), ("b", 2)], "chat_id string, x int"), path)
    memory.write_memory(spark.createDataFrame([("a", 3)], "chat_id string, x int"), path)
    assert sorted(r.x for r in memory.read_memory(spark, path, "a").collect()) == [1, 3]
    found = memory.until_settled(spark.createDataFrame([(1,)], "k int"), lambda f, r: f.select((F.col("k") * 2).alias("k")).where("k < 20"), "k")
    assert sorted((r["round"], r.k) for r in found.collect()) == [(0, 1), (1, 2), (2, 4), (3, 8), (4, 16)]
    one, two = state.new_run(spark, {"query": "q"}).first(), state.new_run(spark, {}).first()
    assert one.run_id != two.run_id and one.config == {"query": "q"}
    asked = state.followup_events(spark.createDataFrame([(1, "why", 2)], "seq long, question string, depth int"), one.run_id)
    assert state.of_run(asked, one.run_id).count() == 1 and state.of_run(asked, two.run_id).count() == 0
    assert state.read_list(spark, str(tmp_path / "none.json"), "id string").count() == 0
    (tmp_path / "s.json").write_text('[{"id": "x"}, {"id": "y"}]')
    assert sorted(r.id for r in state.read_list(spark, str(tmp_path / "s.json"), "id string").collect()) == ["x", "y"]
    assert state.read_config(spark, str(tmp_path / "s.json"), "id string").count() == 2


def test_report_files_and_outline(spark, tmp_path):
    from sievewright.operators import report

    facts = spark.createDataFrame([(1, "one"), (2, "two")], "seq long, text string")
    groups = spark.createDataFrame([(1, 1, "label"), (2, 1, "label")], "seq long, group int, label string")
    words = spark.createDataFrame([(1, ["a", "b"])], "group int, keywords array<string>")
    lines = report.of_kind("outline", lambda: None, lambda: None, lambda: report.outline_lines(facts, groups, words, "q"))
    n = report.write_report(lines, str(tmp_path / "r"))
    text = report.read_report(spark, str(tmp_path / "r"))
    assert text.split("\n") == ["# 研究大纲：q", "## 1. label", "   关键词: a, b", "   发现数: 2", "   - one...", "   - two..."] and n == len(text)
    assert report.of_kind(None, lambda: 1, lambda: 2, lambda: 3) == report.of_kind("other", lambda: 1, lambda: 2, lambda: 3) == 1
