"""The stream of queries: decisions over several batches, restarts, and rows that come twice."""

import random

import numpy as np
from pyspark.sql import functions as F

from sievewright.operators import analyze
from sievewright.streaming import ingest


def test_batches_decide_as_one_pass_does(spark, tmp_path):
    rnd = random.Random(3)
    words = [f"word{chr(97 + k)}" for k in range(12)]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randrange(0, 6)))) for i in range(120)] + [(120, None), (121, "the of")]
    df = spark.createDataFrame(rows, "seq long, text string")
    want = {r.seq: r.duplicate_of for r in analyze.query_dedup(df).collect()}
    assert sum(1 for x in want.values() if x is not None) > 20
    schema = df.schema
    for k, (lo, hi) in enumerate(((0, 40), (40, 41), (41, 90), (90, 200))):
        df.where((F.col("seq") >= lo) & (F.col("seq") < hi)).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        ingest.log_queries(stream, f"{tmp_path}/log", f"{tmp_path}/checkpoint").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/log/*").collect()
    assert {r.seq: r.duplicate_of for r in got} == want and len(got) == len(rows)
    # no news: nothing is decided again
    ingest.log_queries(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/log", f"{tmp_path}/checkpoint").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/log/*").count() == len(rows)


def test_every_row_is_read_once(spark, tmp_path):
    df = spark.range(20).select(F.col("id").alias("seq"), F.concat(F.lit("swallow number "), F.col("id").cast("string")).alias("text"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    for k in range(2):
        run = ingest.log_queries(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/log", f"{tmp_path}/checkpoint")
        run.awaitTermination()
        assert sum(p["numInputRows"] for p in run.recentProgress) == (20 if k == 0 else 0)


def test_copies_meet_the_first_of_them_only(spark, tmp_path):
    """Before, every two copies were told of, under each of their terms."""
    df = spark.createDataFrame([(i, "swallows Swallows cross wide rivers" if i % 2 else "rivers wide cross swallows swallows") for i in range(60)] + [(60, "swallows cross wide rivers"), (61, None)], "seq long, text string")
    told = []
    for lo, hi in ((0, 30), (30, 62)):
        df.where((F.col("seq") >= lo) & (F.col("seq") < hi)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        found = ingest.alike(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), buckets=4)
        found.writeStream.foreachBatch(lambda batch, _: told.extend(batch.distinct().collect())).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.seq for r in told if r.earlier is None) == list(range(62))
    assert sorted((r.seq, r.earlier, r.copy) for r in told if r.earlier is not None) == [(i, 0, True) for i in range(1, 60)] + [(60, 0, False)]


def test_copies_go_where_the_first_of_them_goes(spark, tmp_path):
    few, more, most = "amber basil cedar", "amber basil cedar daisy", "amber basil cedar daisy elder fern"  # cosines 0.87, 0.82 and 0.71
    df = spark.createDataFrame(list(enumerate([few, more, more, most, few, more, most, "of the", "of the"])), "seq long, text string")
    want = {r.seq: r.duplicate_of for r in analyze.query_dedup(df).collect()}
    assert want == {0: None, 1: 0, 2: 0, 3: None, 4: 0, 5: 0, 6: 3, 7: None, 8: None}
    for lo, hi in ((0, 4), (4, 9)):
        df.where((F.col("seq") >= lo) & (F.col("seq") < hi)).write.mode("append").parquet(f"{tmp_path}/in")
        ingest.log_queries(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/log", f"{tmp_path}/checkpoint").awaitTermination()
    assert {r.seq: r.duplicate_of for r in spark.read.parquet(f"{tmp_path}/log/*").collect()} == want


def test_a_crowded_term_meets_as_matrices_do():
    """Pairs of _near are those of all pairs, for terms of few and of many rows, with all or some of them new."""
    rnd = np.random.default_rng(5)
    vectors = []
    for _ in range(800):
        t = np.sort(rnd.choice(30, rnd.integers(1, 7), replace=False)).astype(np.int64) * 1_000_003 - 7_000_000
        vectors.append((t, rnd.integers(1, 4, len(t)).astype(np.int32)))
    entries, at = [], []
    for seq, (t, n) in enumerate(vectors):
        tail = np.cumsum((n * n)[::-1])[::-1]
        for k in np.flatnonzero(tail >= 0.5625 * tail[0]):
            entries.append(tuple(np.array(v, np.int64).tobytes() for v in (t[k], seq, tail[0], (seq, 0), len(t) - k)) + (t[k:].tobytes(), n[k:].tobytes()))
            at.append(seq)
    at = np.array(at)
    whole = np.zeros((800, 30))
    for seq, (t, n) in enumerate(vectors):
        whole[seq, (t + 7_000_000) // 1_000_003] = n
    whole /= np.linalg.norm(whole, axis=1)[:, None]
    b, a = np.nonzero(np.tril(whole @ whole.T >= 0.75 - 1e-9, -1))
    rows = ingest._Rows(entries)
    assert np.unique(rows.term, return_counts=True)[1].max() > ingest.FEW > np.unique(rows.term, return_counts=True)[1].min()
    for since in (0, 400, 799):
        i, j = ingest._near(rows, at >= since, 0.75)
        assert set(zip(at[i].tolist(), at[j].tolist())) == {(x, y) for x, y in zip(b.tolist(), a.tolist()) if x >= since}
