"""Content cleaning and type detection; only HTML parsing leaves the JVM."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sievewright.functions.text import whole_word

# Elements whose content is left out, elements that part lines, and elements without an end tag.
LEFT_OUT = "script style nav footer header aside noscript iframe svg form button input select textarea meta link head".split()
LINES = "p div section article main h1 h2 h3 h4 h5 h6 li tr blockquote pre table ul ol dl dt dd figcaption details summary".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
# What a line of navigation begins with, or consists of.
NAVIGATION = r"(?i)^\s*\[?\s*(Skip to|Jump to|Navigation|Menu|Sign in|Log in|Subscribe)", r"(?i)^\s*Cookie", r"(?i)^\s*(Share|Tweet|Pin|Email|Print)\s*$", r"(?i)^\s*Advertisement\s*$"
# Words that tell a content type, by group; a type scores a point for every group that occurs.
TYPES = {
    "paper": ("abstract introduction methodology conclusion references bibliography", "doi arxiv isbn issn", r"et\s+al"),
    "documentation": ("api sdk install configuration usage parameters returns? example", "```", "deprecated version changelog"),
    "forum": ("answered? reply replies vote upvote comment posted asked", "ago views? reputation badge"),
    "article": ("published author editor journalist reporter", "opinion editorial column feature analysis"),
}
SNIFFED, SCANNED, MOST = 500, 3000, 50_000
CUT_MARK = "\n\n[... content truncated ...]"


def type_patterns() -> dict[str, list[str]]:
    return {t: [g if g == "```" else whole_word([g] if "\\" in g else g.split()) for g in groups] for t, groups in TYPES.items()}


def is_html(text: Column) -> Column:
    return F.substring(text, 1, SNIFFED).rlike(r"(?i)<\s*(html|body|div|p|span|head)([^\p{L}\p{N}_]|$)")


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"\s+", " "), r"^\s+|\s+$", "")


def clean_markdown(text: Column) -> Column:
    def keep(line: Column) -> Column:
        bad = F.lit(False)
        for pattern in NAVIGATION:
            bad |= line.rlike(pattern)
        return ~bad

    kept = F.array_join(F.filter(F.split(text, "\n", -1), keep), "\n")
    return F.regexp_replace(F.regexp_replace(kept, "\n{4,}", "\n\n\n"), r"^\s+|\s+$", "")


def content_type(text: Column) -> Column:
    """The type with most points, the first named of equals, if it has two at least."""
    start, scores = F.substring(text, 1, SCANNED), {}
    for name, patterns in type_patterns().items():
        scores[name] = sum((start.rlike(p).cast("int") for p in patterns), F.lit(0))
    best, out = F.greatest(*scores.values()), F.lit("unknown")
    for name, score in reversed(scores.items()):
        out = F.when((score == best) & (best >= 2), name).otherwise(out)
    return out


class _Reader(HTMLParser):
    """Text outside the elements left out. Elements without an end tag open nothing."""

    def __init__(self) -> None:
        super().__init__()
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in VOID:
            return
        if self.hidden or tag in LEFT_OUT:
            self.hidden += 1
        elif tag in LINES:
            self.out.append("\n")

    def handle_startendtag(self, tag: str, attrs) -> None:
        if not self.hidden and tag in LINES:
            self.out.append("\n\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            return
        if self.hidden:
            self.hidden -= 1
        elif tag in LINES:
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden and (text := data.strip()):
            self.out.append(text + " ")


def html_text(html: str | None) -> str | None:
    """The visible text of a page; None where its markup can't be parsed."""
    import re

    if html is None:
        return None
    reader = _Reader()
    try:
        reader.feed(html)
        reader.close()
    except (AssertionError, ValueError):  # what the parser raises on broken declarations
        return None
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", "".join(reader.out))).strip()


def extract_html(html: Column) -> Column:
    """html_text over Arrow batches; pages that can't be parsed lose their tags by pattern."""

    @F.pandas_udf("string")
    def of(pages: pd.Series) -> pd.Series:
        return pages.map(html_text, na_action="ignore")

    return F.coalesce(of(html), strip_tags(html))


def process(text: Column, url: Column) -> Column:
    """struct<text, content_type, char_count, truncated, source_url, is_html_source>; the count includes the mark."""
    html = is_html(text)
    clean = F.when(html, extract_html(F.when(html, text))).otherwise(clean_markdown(text))
    cut = F.length(clean) > MOST
    shown = F.when(cut, F.concat(F.substring(clean, 1, MOST), F.lit(CUT_MARK))).otherwise(clean)
    return F.struct(shown.alias("text"), content_type(clean).alias("content_type"), F.length(shown).alias("char_count"), cut.alias("truncated"), url.alias("source_url"), html.alias("is_html_source"))
