import numpy as np
import pytest

from sievewright.llm import nn_graph


def test_recall_copies_and_edges(spark):
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(600, 16)).astype(np.float32)
    x[100:140] = x[99]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(1000, None, 0), (1020, [0.0] * 16, 0), (1040, [float("nan")] * 16, 0), (1060, [1.0, None], 0), (1080, [2.0, 1.0], 0), (1081, [1.0, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, node int")
    got = {}
    for r in nn_graph.nearest(df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {*range(0, 600, 20), 1080} and got[1080] == [(1, 1081, 3.0)]
    hit = 0
    for q in range(0, 600, 20):
        score = (x.astype(float) * x[q].astype(float)).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(600), -score)) if i != q][:20]
        own = sorted(got[q])
        assert [r for r, _, _ in own] == list(range(1, 21)) and all(abs(score[i] - s) < 1e-9 for _, i, s in own)
        assert [(-s, i) for _, i, s in own] == sorted((-s, i) for _, i, s in own)
        hit += len({i for _, i, _ in own} & set(order))
    assert hit >= 0.9 * 30 * 20
    assert nn_graph.nearest(df.limit(0)).count() == 0


def test_shared_ids_and_hot_vector(spark):
    """Two vectors under one id: the first in order takes part. A vector that most ids share is one node, and all its queries are answered."""
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(1, 121)] + [(200, [0.0, 1.0, 0.0]), (200, [0.0, 0.0, 9.0]), (220, [0.5, 1.0, 0.0]), (None, [7.0, 7.0, 7.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = {}
    for r in nn_graph.nearest(df, k=3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    got = {q: sorted(x) for q, x in got.items()}
    assert set(got) == {*range(20, 121, 20), 200, 220}
    assert all(got[q] == [(1, 1, 1.0), (2, 2, 1.0), (3, 3, 1.0)] for q in range(20, 121, 20))
    assert got[200] == [(1, 1, 0.0), (2, 2, 0.0), (3, 3, 0.0)]
    assert got[220] == [(1, 1, 0.5), (2, 2, 0.5), (3, 3, 0.5)]


def test_pipeline(spark, tmp_path):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    assert public_tokenizers
    import corpus_pipeline

    prose = "the quick brown fox jumps over the lazy dog and runs far away from the old barn today"
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    other = "many people like to read long books about ships and storms on the wide open sea"
    docs = [(0, prose, "en"), (1, prose, "en"), (2, None, None), (3, "123", "en"), (4, passage, "en"), (5, other + " password=abcdef123456", "en"), (6, "seven short words are all it says", "en")]
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = []
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, str(tmp_path))
        left.append((name, sorted(r.doc_id for r in frame.collect())))
        if name == "secrets":
            five = frame.where("doc_id = 5").first()
            assert five.text == other + " [secret]" and five.n_chars == len(five.text)
    assert left == [("language_id", [0, 1, 4, 5, 6]), ("near_duplicates", [0, 4, 5, 6]), ("decontaminate", [0, 5, 6]), ("secrets", [0, 5, 6]), ("byte_bpe", [0, 5, 6])]
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == [0, 5, 6]
