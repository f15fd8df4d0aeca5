import numpy as np
from pyspark.sql import functions as F

from tidegauge.llm import ann

DDL = "vec_id bigint, embedding array<float>"


def brute(rows, asks, k):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for i, q in good:
        if asks(i):
            best = sorted(((-float(q @ v), j) for j, v in good if j != i))[:k]
            out[i] = [(j, -s) for s, j in best]
    return out


def found(df, k=20, **more):
    out = {}
    for r in sorted(ann.neighbours(df, F.col("vec_id") % 20 == 0, k, **more).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    want = brute([(r.vec_id, r.embedding) for r in df.collect()], lambda i: i % 20 == 0, 20)
    got = found(df)
    assert set(got) == set(want)
    share = np.mean([len({j for j, _ in got[q]} & {j for j, _ in want[q]}) / len(want[q]) for q in want])
    assert share >= 0.9
    for q, hits in got.items():
        exact = dict(want[q])
        assert len(hits) == 20 and hits == sorted(hits, key=lambda h: (-round(h[1], 12), h[0]))
        assert all(abs(s - exact[j]) < 1e-9 for j, s in hits if j in exact)


def test_norms_copies_and_blocks(spark, monkeypatch):
    """Vectors of very different length, a large group of copies, and small blocks; many tables make the search complete."""
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=12) * rng.uniform(0.1, 5)).astype(np.float32).tolist()) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(70)]
    want = brute(rows, lambda i: i % 20 == 0, 6)
    df = spark.createDataFrame(rows, DDL).repartition(4)
    for block in (2048, 16):
        monkeypatch.setattr(ann, "BLOCK", block)
        got = found(df, 6, tables=10, probes=32)
        assert {q: [j for j, _ in h] for q, h in got.items()} == {q: [j for j, _ in h] for q, h in want.items()}


def test_few_rows_and_bad_vectors(spark, nothing):
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]),
            (None, [1.0, 1.0]), (7, [1.0, 2.0, 3.0]), (40, []), (60, None)]
    got = found(spark.createDataFrame(rows, DDL))
    assert {q: [j for j, _ in h] for q, h in got.items()} == {0: [1, 20], 20: [0, 1]}
    assert found(spark.createDataFrame([], DDL)) == {}
    assert found(spark.createDataFrame([(0, [1.0])], DDL)) == {}
    assert found(spark.createDataFrame([(0, [1.0]), (0, [1.0]), (9, [2.0])], DDL).withColumn("rep", F.lit("clash"))) == {0: [(9, 2.0)]}


def test_rotation_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 64))
    y = ann.rotated(x, 3)
    np.testing.assert_allclose(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1))
    np.testing.assert_allclose(x @ x.T, y @ y.T)
    assert ann.axes(np.array([[0.1, -3.0, 2.0]]), 3).tolist() == [[3, 4, 0]]
