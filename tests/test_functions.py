"""Goldens and traps of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from sievewright.functions import content, planning, text, urls
from sievewright.functions.reputation import credibility


def value(spark, column, **row):
    names = ", ".join(row) or "x"
    frame = spark.createDataFrame([tuple(row.values()) or (1,)], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'int' if isinstance(v, int) else 'double'}" for k, v in row.items()) or "x int")
    assert names
    return frame.select(column.alias("v")).first()["v"]


def test_tokens(spark):
    assert value(spark, text.tokens(F.col("t")), t="naïve ABC12de a x_y 深度研究カ") == ["na", "ve", "abc", "de", "深", "度", "研", "究"]
    assert value(spark, text.filtered_tokens(F.col("t")), t="The cat and 的 dog cat") == ["cat", "dog", "cat"]


@pytest.mark.parametrize(("url", "expected"), [
    ("HTTP://User:p@EX.com:443/a/b//?b=2&a=1&b=1#f", "http://ex.com/a/b?a=1&b=2&b=1"),
    ("http://ex.com", "http://ex.com/"),
    ("http://ex.com:8080/x;p=1?q=a+b&r=~*", "http://ex.com:8080/x?q=a+b&r=~%2A"),
    (" http://ex.com:port/ ", "http://ex.com:port/"),
    ("https://ex.com/?empty=&k=%zz", "https://ex.com/?empty=&k=%25zz"),
])
def test_normalise(spark, url, expected):
    got = value(spark, urls.normalise(F.col("u")), u=url)
    assert got == expected
    assert value(spark, urls.normalise(F.col("u")), u=got) == got


@pytest.mark.parametrize(("url", "level"), [
    ("https://baijiahao.baidu.com/x", "LOW"), ("https://www.baidu.com", "MEDIUM"), ("https://cs.example.edu.cn", "HIGH"),
    ("https://x.example.org", "MEDIUM"), ("arxiv.org/abs/1", "MEDIUM"), ("https://arxiv.org/abs/1", "HIGH"), ("https://my_host.com/a|b", "MEDIUM"), ("", "MEDIUM"),
])
def test_credibility(spark, url, level):
    assert value(spark, credibility(urls.host(F.col("u"))), u=url) == level


@pytest.mark.parametrize(("said", "negated"), [("中not中", False), ("it is not so", True), ("没有证据", True), ("nothing knots", False), ("I DON'T", True)])
def test_negation(spark, said, negated):
    assert value(spark, text.has_negation(F.col("t")), t=said) is negated


def test_html_and_markdown(spark):
    page = "<html><head><meta charset=x><title>t</title></head><body><nav>menu</nav><p>one <b>two</b></p><br>three&amp;</body></html>"
    assert content.html_text(page) == "one two \nthree&"
    assert value(spark, content.clean_markdown(F.col("t")), t="Cookies improve flavour\nkeep\nShare \n\n\n\n\nend\n") == "keep\n\n\nend"
    assert value(spark, content.content_type(F.col("t")), t="abstract doi api version") == "paper"
    assert value(spark, content.content_type(F.col("t")), t="abstract only") == "unknown"


def test_process_cuts(spark):
    got = value(spark, content.process(F.col("t"), F.lit("u")), t="x" * 50_001)
    assert got["truncated"] and got["char_count"] == 50_000 + len(content.CUT_MARK) and not got["is_html_source"]


def test_planning(spark):
    depth = [value(spark, planning.breadth(F.lit(b), F.lit(d))) for b, d in ((4, 0), (4, 1), (4, 2), (5, 0), (5, 1), (5, 2), (5, 3), (5, 4))]
    assert depth == [4, 2, 2, 5, 3, 2, 2, 2]
    score = planning.total_score(*map(F.lit, (5, 5, 5, 5, 5)))
    assert value(spark, score) == pytest.approx(5.0) and value(spark, planning.tier(F.lit("breakthrough"), score)) == "Breakthroughs"
    score = planning.total_score(*map(F.lit, (3, 3, 3, 5, 4)))
    assert value(spark, score) == pytest.approx(3.4) and value(spark, planning.tier(F.lit("opinion"), score)) == "Industry & Opinions"
    assert value(spark, planning.decision(*map(F.lit, (1, 3, 1, 1, 5)))) == "continue"
    assert value(spark, planning.decision(*map(F.lit, (1, 3, 1, 0, 5)))) == "diminishing_returns"
    assert value(spark, text.next_patch(F.lit("1.2.9"))) == "1.2.10" and value(spark, text.next_patch(F.lit(None).cast("string"))) == "0.0.1"
