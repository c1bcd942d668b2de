"""Quality gates over reports and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.operators import report

# Sources a run needs, sources a claim needs, words a section may have, by mode.
NEEDS = {"quick": (5, 1, 1000), "standard": (10, 2, 2000), "deep": (15, 3, 2000)}


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, r"\n\s*\n"), lambda p: p.rlike(r"\S"))


def prose_share(text: Column) -> Column:
    """Share of non-empty lines that are no list, table, heading or quote."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"\S"))
    prose = F.filter(lines, lambda x: ~x.rlike(r"^\s*([-*+|>#]|[0-9]+\.)"))
    return F.when(F.size(lines) > 0, F.size(prose) / F.size(lines)).otherwise(0.0)


def section_gates(sections: DataFrame, most_words: int = 2000) -> DataFrame:
    """id, n_paragraphs, prose_share and whether they pass: 3 paragraphs, 80 % prose, at most most_words words."""
    n = F.size(paragraphs(F.col("text")))
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    share = prose_share(F.col("text"))
    return sections.select("id", n.alias("n_paragraphs"), words.alias("n_words"), share.alias("prose_share"), ((n >= 3) & (share >= 0.8) & (words <= most_words)).alias("good"))


def enough_sources(n_sources: Column, mode: Column) -> Column:
    out = n_sources >= NEEDS["standard"][0]
    for m, (least, _, _) in NEEDS.items():
        out = F.when(mode == m, n_sources >= least).otherwise(out)
    return out


#: Headings begin sections; a numbered one is a cluster's. Fixed value: the heading of the summary.
_SECTION, _CLUSTER, SUMMARY = r"(?m)^## ", r"(?s)\d+\. .*", "摘要"
CHECKS = ("citations run on", "citations have sources", "no ranges", "no placeholders", "not cut short", "urls visited", "enough sources", "clusters have content", "summary written")


def _has_content(section: Column) -> Column:
    """Whether a line behind the section's heading says something."""
    return section.rlike(r"(?s)\n.*\S")


def nine_checks(reports: DataFrame, sources: DataFrame, visited: DataFrame, mode: str) -> DataFrame:
    """id, check, good: one row for each of CHECKS of every report (id, text).

    sources has index, visited url; both are tables, of which one row of counts
    and the URLs that reports name come in. A report without a summary section
    fails there; one without cluster sections has nothing to fail.
    """
    text = F.col("text")
    numbers = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(report.CITATION), F.lit(1)), lambda x: x.try_cast("int"))))
    known = sources.agg(F.count(F.lit(1)).alias("_n"), F.count_distinct("index").alias("_different"))  # one row
    bad = report.unvisited(reports, visited).groupBy("id").agg(F.count(F.lit(1)).alias("_bad"))
    sections = F.split(text, _SECTION)
    clusters = F.filter(sections, lambda x: x.rlike(r"^\d+\. "))
    summary = F.filter(sections, lambda x: x.startswith(SUMMARY))
    # what is between comment marks is a place to be filled
    written = F.filter(summary, lambda x: _has_content(F.regexp_replace(x, r"(?s)<!--.*?-->", "")))
    told = reports.select("id", text, numbers.alias("_cited")).crossJoin(F.broadcast(known)).join(bad.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left")
    cited, n = F.col("_cited"), F.size("_cited")
    good = (
        (F.coalesce(F.array_max(cited), F.lit(0)) == n) & (F.coalesce(F.array_min(cited), F.lit(1)) >= 1) & (F.col("_n") == F.col("_different")),
        ~F.exists(cited, lambda c: (c < 1) | (c > F.col("_n"))),
        ~text.rlike(report.RANGE),
        ~text.rlike("(?i)(" + "|".join(p for p in report.PLACEHOLDERS if p not in report.CUT_SHORT) + ")"),
        ~text.rlike("(?i)(" + "|".join(report.CUT_SHORT) + ")"),
        F.col("_bad").isNull(),
        enough_sources(n, F.lit(mode)),
        ~F.exists(clusters, lambda x: ~_has_content(x)),
        (F.size(summary) > 0) & (F.size(summary) == F.size(written)),
    )
    each = F.array(*[F.struct(F.lit(k).alias("check"), v.alias("good")) for k, v in zip(CHECKS, good)])
    return told.select("id", F.explode(each).alias("c")).select("id", "c.check", "c.good")


def claim_diversity(support: DataFrame, mode: str) -> DataFrame:
    """claim, n_sources, n_kinds, n_years, kind_entropy, year_entropy, enough, diverse.

    support says which source (url, kind, year) stands for which claim; rows
    may repeat. Entropies (in bits) tell how evenly the sources of a claim
    spread over kinds and years; a claim has enough sources by the mode, and
    diverse ones if these are of two kinds and two years at least.
    """
    once = support.select("claim", "url", "kind", "year").distinct()
    counts = once.groupBy("claim").agg(F.count_distinct("url").alias("n_sources"), F.count(F.lit(1)).alias("_all"))
    out = counts
    for c in ("kind", "year"):
        share = once.groupBy("claim", c).agg(F.count(F.lit(1)).alias("_n"))
        # the entropy of counts n is log(sum) - sum(n log n) / sum
        told = share.groupBy("claim").agg(F.count(c).alias(f"n_{c}s"), (F.log2(F.sum("_n")) - F.sum(F.col("_n") * F.log2("_n")) / F.sum("_n")).alias(f"{c}_entropy"))
        out = out.join(told, "claim")
    least = NEEDS.get(mode, NEEDS["standard"])[1]
    enough, diverse = F.col("n_sources") >= least, (F.col("n_kinds") >= 2) & (F.col("n_years") >= 2)
    return out.select("claim", "n_sources", "n_kinds", "n_years", "kind_entropy", "year_entropy", enough.alias("enough"), diverse.alias("diverse"))


def file_gates(spark: SparkSession, least: dict[str, int]) -> DataFrame:
    """path, bytes, good: whether each file is there and has more bytes than it should at least; only lengths are read."""
    asked = spark.createDataFrame([(path, n) for path, n in least.items()], "path string, least long")
    found = None
    for path in least:  # a file that is missing is a row, not a failure
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            one = spark.read.format("binaryFile").load(path).agg(F.sum("length").alias("bytes")).select(F.lit(path).alias("path"), "bytes")
            found = one if found is None else found.unionByName(one)
    sizes = found if found is not None else spark.createDataFrame([], "path string, bytes long")
    return asked.join(sizes, "path", "left").select("path", F.coalesce("bytes", F.lit(0)).alias("bytes"), (F.coalesce("bytes", F.lit(0)) > F.col("least")).alias("good"))


def run_gates(rounds: Column, followed_lines: Column, sources: Column) -> Column:
    """Three rounds, ten lines on followed accounts and five sources at least."""
    return (rounds >= 3) & (followed_lines >= 10) & (sources >= 5)
