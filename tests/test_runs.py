"""Versioned tables, runs by depth and the daily report."""

import threading

import pytest
from pyspark.sql import functions as F

from sievewright.operators import daily, recursion
from sievewright.sources.versions import Conflict, VersionedTable


def ids(df):
    return sorted(r.id for r in df.collect())


def test_versions_are_read_as_they_were(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t", "id long, name string")
    assert table.latest() == 0 and ids(table.read()) == []
    rows = spark.range(3).withColumns({"name": F.lit("x"), "extra": F.lit(1)})
    assert table.append(rows) == 1 and table.append(rows.where("id > 1")) == 2
    assert ids(table.read()) == [0, 1, 2, 2] and ids(table.read(1)) == [0, 1, 2] and ids(table.read(0)) == []
    assert table.compact() == 3 and ids(table.read()) == [0, 1, 2, 2] and len(table.commit_of(3)["folders"]) == 1
    assert table.append(rows.limit(0)) == 4 and ids(table.read()) == [0, 1, 2, 2]
    # another handle sees the same, without a path scheme too
    assert ids(VersionedTable(spark, f"{tmp_path}/t", "id long, name string").read(2)) == [0, 1, 2, 2]
    assert table.vacuum() == 2 and table.versions() == [4] and ids(table.read()) == [0, 1, 2, 2]


def test_racing_writers_lose_nothing(spark, tmp_path):
    path, failed = f"{tmp_path}/t", []

    def write(k):
        try:
            own = VersionedTable(spark, path, "id long")
            for i in range(4):
                own.append(spark.range(10 * (4 * k + i), 10 * (4 * k + i) + 10, numPartitions=1))
                if k == 0 and i == 2:
                    own.compact()
        except Exception as error:  # shown below
            failed.append(error)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    table = VersionedTable(spark, path, "id long")
    assert not failed and ids(table.read()) == list(range(120)) and table.versions() == list(range(1, 14))


def test_a_claim_is_whole_and_exclusive(spark, tmp_path):
    table = VersionedTable(spark, f"{tmp_path}/t", "id long")
    got = []
    threads = [threading.Thread(target=lambda k=k: got.append(table._claim(1, b'{"version": 1, "made": "%d", "folders": []}' % k))) for k in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(got) == [False] * 7 + [True] and table.commit_of(1)["version"] == 1


def test_compactions_that_race(spark, tmp_path, monkeypatch):
    table = VersionedTable(spark, f"{tmp_path}/t", "id long")
    table.append(spark.range(2))
    table.append(spark.range(2, 4))
    other = VersionedTable(spark, f"{tmp_path}/t", "id long")
    write = table._write

    def late(rows):
        folder = write(rows)
        other.append(spark.range(4, 6))  # an append in between stays
        return folder

    monkeypatch.setattr(table, "_write", late)
    table.compact()
    assert ids(table.read()) == list(range(6))

    def too_late(rows):
        folder = write(rows)
        other.compact()
        return folder

    monkeypatch.setattr(table, "_write", too_late)
    with pytest.raises(Conflict):
        table.compact()
    assert ids(table.read()) == list(range(6))


# ---- runs ----
def _search(calls, die_at=None):
    def search(queries, depth):
        if depth == die_at:
            raise RuntimeError("the driver died")
        calls.append((depth, sorted((r.run_id, r.seq) for r in queries.collect())))
        kids = queries.select("run_id", F.explode(F.array(*(F.col("seq") * 3 + k for k in (1, 2, 3)))).alias("seq"))
        kids = kids.withColumns({"text": F.lit("t"), "priority": F.when(F.col("seq") % 2 == 0, "high").otherwise("low")})
        facts = kids.withColumn("kind", F.lit("fact")).where("run_id <> 'dry' OR seq <= 3")
        questions = kids.withColumn("kind", F.lit("question")).where("run_id <> 'mute'")
        return facts.unionByName(questions)

    return search


def test_runs_stop_by_their_own_rule_and_resume(spark, tmp_path):
    seeds = spark.createDataFrame([("long", 0, "q"), ("dry", 0, "q"), ("mute", 0, "q")], "run_id string, seq long, text string")
    whole, calls = VersionedTable(spark, f"{tmp_path}/whole", recursion.SCHEMA), []
    log = recursion.research(whole, seeds, _search(calls), max_depth=3, base_breadth=4)
    said = {(r.run_id, r.depth): r.decision for r in recursion.by_depth(log).collect()}
    assert said == {
        ("long", 0): "continue", ("long", 1): "continue", ("long", 2): "continue", ("long", 3): "max_depth_reached",
        ("dry", 0): "continue", ("dry", 1): "diminishing_returns", ("mute", 0): "continue",
    }
    # two questions a depth, urgent ones first
    assert calls[1] == (1, [("dry", 1), ("dry", 2), ("long", 1), ("long", 2)]) and calls[2] == (2, [("long", 4), ("long", 6)])
    # a run that dies at depth 2 and is called again does only what is left
    broken, again = VersionedTable(spark, f"{tmp_path}/broken", recursion.SCHEMA), []
    with pytest.raises(RuntimeError):
        recursion.research(broken, seeds, _search(again, die_at=2), max_depth=3)
    assert broken.latest() == 2
    again.clear()
    resumed = recursion.research(VersionedTable(spark, f"{tmp_path}/broken", recursion.SCHEMA), seeds, _search(again), max_depth=3)
    assert [d for d, _ in again] == [2, 3]
    told = lambda df: sorted(map(str, df.collect()))
    assert told(resumed) == told(log)
    # a finished run asks nothing more
    assert told(recursion.research(broken, seeds, _search([], die_at=4), max_depth=3)) == told(log)


def test_runs_without_seeds(spark, tmp_path):
    seeds = spark.createDataFrame([], "run_id string, seq long, text string")
    assert recursion.research(VersionedTable(spark, f"{tmp_path}/none", recursion.SCHEMA), seeds, _search([])).count() == 0


# ---- daily report ----
FINDINGS = "id long, created timestamp, tier string, topic string, source string, author string, link string, total double"


def test_daily_levels_and_lines(spark):
    from datetime import datetime

    old, new = datetime(2024, 1, 1), datetime(2024, 1, 20)
    rows = [(1, old, "A", "x", "s", "u", "l1", 3.0), (2, new, "A", "x", "s", "u", "l1", 3.0), (3, new, "B", "y", "s", None, "l2", 4.0), (4, old, "B", "z", "s", "u", None, None)]
    told = daily.levels(spark.createDataFrame(rows, FINDINGS), "2024-01-16")
    got = {(r.level, r.key): r for r in told.collect()}
    assert got["all", None].n == 4 and got["all", None]["items"] == 2 and got["all", None].top_id == 3
    assert (got["topic", "x"].n_before, got["topic", "x"].n_now, got["topic", "x"].heat, got["topic", "x"].top_id) == (1, 1, "stable", 1)
    assert got["topic", "y"].heat == "new" and got["topic", "z"].heat == "gone" and got["tier", "A"].share == 0.5
    assert got["author", None].n == 1 and len([k for k in got if k[0] == "author"]) == 2  # no author is a key of its own
    said = [r.line for r in daily.lines(told, "2024-01-20").orderBy("part", "ord").collect()]
    assert said[0] == "# Daily report 2024-01-20" and "| s | 4 | 100.0% |" in said and "| - | 1 | 3 |" in said
    empty = daily.levels(spark.createDataFrame([], FINDINGS), "2024-01-16")
    assert empty.count() == 0 and daily.lines(empty, "d").count() == 1 + 3 * len(daily.TABLES)
