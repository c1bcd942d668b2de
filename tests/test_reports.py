"""Checks of reports, diversity, files and the commands of a run."""

import json
import math

import pytest
from pyspark.sql import functions as F

from sievewright.api import Research
from sievewright.functions import planning, text, urls
from sievewright.operators import quality, report
from sievewright.sources import state

GOOD = "## 摘要\nAll is well.\n\n## 1. A\n- x [1]\n\n## 2. B\n- y [2] [3] [4] [5]\n\n## 信息来源\nhttps://a.org/1\n"


def checks(spark, said, n=5, mode="quick", visited=("https://a.org/1",)):
    reports = spark.createDataFrame([("r", said)], "id string, text string")
    sources = spark.createDataFrame([(i + 1, f"u{i}") for i in range(n)], "index int, url string")
    seen = spark.createDataFrame([(u,) for u in visited], "url string")
    return {r.check for r in quality.nine_checks(reports, sources, seen, mode).collect() if not r.good}


def test_each_of_the_nine_checks_fails_by_itself(spark):
    assert checks(spark, GOOD) == set() and len(quality.CHECKS) == 9
    assert checks(spark, GOOD.replace("[2]", "[1]")) == {"citations run on", "enough sources"}
    assert checks(spark, GOOD, n=4) == {"citations have sources"}
    assert checks(spark, GOOD + "[2-3]") == {"no ranges"}
    assert checks(spark, GOOD + "a todo") == {"no placeholders"}
    assert checks(spark, GOOD + "Due to length") == {"not cut short"}
    assert checks(spark, GOOD, visited=("https://b.org",)) == {"urls visited"}
    assert checks(spark, GOOD, mode="deep") == {"enough sources"}
    assert checks(spark, GOOD.replace("- x [1]\n", "").replace("[2]", "[1] [2]")) == {"clusters have content"}
    assert checks(spark, GOOD.replace("All is well.", "<!-- 200\n300 -->")) == checks(spark, GOOD.replace("## 摘要", "## x")) == {"summary written"}


def test_validation_counts(spark):
    reports = spark.createDataFrame([(1, "[1] [9] [2-3] https://a.org/1 tbd"), (2, "[1] [2] https://b.org"), (3, "")], "id long, text string")
    sources = spark.createDataFrame([(i, "u") for i in (1, 2, 3)], "index int, url string")
    got = {r.id: r.asDict() for r in report.validate(reports, sources, spark.createDataFrame([("https://b.org",)], "url string")).collect()}
    names = ("missing_citations", "unvisited_urls", "placeholders", "ranges", "cited_sources", "total_sources", "unused_sources", "gapless", "valid")
    assert [got[1][c] for c in names] == [1, 1, 1, 1, 2, 3, 2, False, False]
    assert [got[2][c] for c in names] == [0, 0, 0, 0, 2, 3, 1, True, True] and got[3]["valid"]


def test_diversity_of_claims(spark):
    rows = [("a", f"u{i}", ("x", "y")[i % 2], 2000 + i) for i in range(4)] + [("a", "u0", "x", 2000), ("b", "u1", "x", 2001), ("b", "u2", "x", 2002), ("c", "u3", None, None)]
    got = {r.claim: r for r in quality.claim_diversity(spark.createDataFrame(rows, "claim string, url string, kind string, year int"), "deep").collect()}
    assert (got["a"].n_sources, got["a"].n_kinds, got["a"].n_years, got["a"].enough, got["a"].diverse) == (4, 2, 4, True, True)
    assert math.isclose(got["a"].kind_entropy, 1) and math.isclose(got["a"].year_entropy, 2) and got["b"].kind_entropy == 0
    assert not got["b"].enough and not got["b"].diverse and got["c"].n_kinds == 0


def test_files_and_folders(spark, tmp_path):
    (tmp_path / "long.md").write_text("x" * 300)
    (tmp_path / "short.md").write_text("x")
    told = quality.file_gates(spark, {f"file://{tmp_path}/{n}": 200 for n in ("long.md", "short.md", "none.md")})
    assert {(r.path.split("/")[-1], r.bytes, r.good) for r in told.collect()} == {("long.md", 300, True), ("short.md", 1, False), ("none.md", 0, False)}
    for name, file in (("one", "SKILL.md"), ("two", "README.md")):
        (tmp_path / "root" / name).mkdir(parents=True)
        (tmp_path / "root" / name / file).write_text("x")
    assert [r.folder for r in state.with_manifest(spark, f"{tmp_path}/root", "SKILL.md").collect()] == ["one"]
    assert state.with_manifest(spark, f"{tmp_path}/nowhere", "SKILL.md").count() == 0


def test_json_goes_out_and_comes_back(spark, tmp_path):
    rows = spark.createDataFrame([(1, None, ["a"]), (2, "é", [])], "id long, name string, tags array<string>")
    for _ in range(2):  # the second time replaces the first
        state.write_json(rows, f"{tmp_path}/out")
    assert sorted(map(str, state.read_json_lines(spark, f"{tmp_path}/out", "id long, name string, tags array<string>").collect())) == sorted(map(str, rows.collect()))
    info = {"chat_id": "c", "name": "n", "agent_id": "a", "bot_name": "b"}
    state.write_json(spark.createDataFrame([tuple(info.values())], ", ".join(f"{k} string" for k in info)), f"{tmp_path}/group/info")
    assert state.read_config(spark, f"{tmp_path}/group/info", ", ".join(f"{k} string" for k in info)).first().asDict() == info


def test_broken_records_are_told_of(spark, tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps([{"id": "x"}, {"id": "y"}]))
    assert sorted(r.id for r in state.read_list(spark, str(path), "id string").collect()) == ["x", "y"]
    path.write_text("[{")
    with pytest.warns(UserWarning, match="1 broken"):
        assert state.read_list(spark, str(path), "id string").count() == 0
    with pytest.warns(UserWarning, match="missing"):
        assert state.read_list(spark, str(tmp_path / "none.json"), "id string").count() == 0


def test_small_functions(spark):
    row = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert row(text.shorten(F.lit("añb🙂c"), 3, "...")) == "añb..." and row(text.shorten(F.lit("ab"), 3, "...")) == "ab"
    assert row(text.anchor(F.lit("a b c"))) == "a-b-c"
    assert row(urls.search_url("https://x.org/s", F.lit("a b&ü"), f="live")) == "https://x.org/s?q=a+b%26%C3%BC&f=live"
    assert row(planning.or_mode(F.lit(0), F.lit(3))) == 3 and row(planning.or_mode(F.lit(2), F.lit(3))) == 2 and row(planning.or_mode(F.lit(None).cast("int"), F.lit(3))) == 3
    assert list(planning.WEIGHTS.values()) == [0.3, 0.25, 0.2, 0.15, 0.1]


def test_commands_of_a_run(spark, tmp_path):
    run = Research(spark, f"{tmp_path}/run")
    assert run.init("birds", "quick").first().asDict() == {"query": "birds", "mode": "quick", "max_depth": 1, "base_breadth": 3, "report_type": "comprehensive"}
    with pytest.raises(ValueError):
        run.init("again")
    assert run.add_query("how do birds fly south") and not run.add_query("how do birds fly south?") and run.add_query("winter food prices")
    assert run.check_query("birds fly south how") == 0 and run.check_query("nothing alike") is None
    pages = spark.createDataFrame([("https://arxiv.org/abs/1", "one", "academic"), ("https://arxiv.org/abs/1#x", "same", "academic"), ("https://b.example.com/2", "two", "news")], "url string, title string, content_type string").coalesce(1)
    assert run.add_urls(pages) == 2 and run.add_urls(pages) == 0 and run.check_url("https://ARXIV.org/abs/1/") and not run.check_url("https://c.org")
    facts = [("swallows cross the desert each autumn", "https://arxiv.org/abs/1"), ("swallows cross the desert each autumn", "https://b.example.com/2"), ("swallows never cross the desert each autumn", "https://b.example.com/2"), ("prices of wheat doubled", None)]
    run.add_learnings(spark.createDataFrame([(t, u, "t", 0, "q") for t, u in facts], "text string, source_url string, source_title string, depth_level int, query_origin string").coalesce(1))
    run.add_followup("which desert", 0, "low")
    run.add_followup("why autumn", 0, "high")
    assert [r.question for r in run.followups().collect()] == ["why autumn", "which desert"]
    assert run.mark_followup("why autumn") and not run.mark_followup("who") and [r.question for r in run.followups().collect()] == ["which desert"]
    assert run.next_depth() == "continue" and run.suggest_queries().first().asDict() == {"mode": "quick", "breadth": 3, "agents": 1, "queries_per_agent": 3}
    run.set_progress(1, "searching")
    told = run.stats().first()
    assert (told.learnings, told.urls, told.queries, told.followups, told.unused_followups, told.has_analysis, told.current_depth, told.status) == (4, 2, 2, 2, 1, False, 1, "searching")
    assert run.next_depth() == "max_depth_reached"
    found = run.analyze_learnings().first()
    assert (found.total_learnings, found.duplicates_found, found.total_conflicts) == (4, 1, 1) and run.stats().first().has_analysis
    assert [(r["index"], r.credibility) for r in run.sources(f"{tmp_path}/sources").orderBy("index").collect()] == [(1, "HIGH"), (2, "MEDIUM")]
    assert state.read_json_lines(spark, f"{tmp_path}/sources", "index int, url string").count() == 2
    n = run.generate_report(f"{tmp_path}/report")
    assert n == len(report.read_report(spark, f"{tmp_path}/report"))
    failed = {r.check for r in run.validate_report(f"{tmp_path}/report").collect() if not r.good}
    assert failed == {"enough sources", "summary written"}  # the summary is for a person to write
    assert "swallows" in run.generate_section("cluster", 0) and run.generate_section("sources").count("http") == 2
    for kind in ("brief", "outline"):
        assert run.generate_report(f"{tmp_path}/{kind}", kind) > 0
    with pytest.raises(ValueError):
        run.generate_section("nothing")
    assert run.credibility(spark.createDataFrame([("https://arxiv.org/x",)], "url string")).first().credibility == "HIGH"
    assert run.process_content(spark.createDataFrame([("<p>hi</p>", "u")], "html string, url string")).count() == 1
    assert {r.table for r in run.dump().collect()} >= {"config", "facts", "used", "analysis"}
