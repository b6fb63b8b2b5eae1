"""Nearest neighbours against brute force."""

import numpy as np
from pyspark.sql import functions as F

from talkloom.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(vectors, queries, top):
    out = {}
    for q in queries:
        scores = sorted(((-float(np.dot(vectors[q], v)), i) for i, v in vectors.items() if i != q))[:top]
        out[q] = [i for _, i in scores]
    return out


def test_recall_and_form(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(800, 16)) * rng.uniform(0.5, 2, size=(800, 1))
    rows = [(i, [float(np.float32(c)) for c in v], 0) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, SCHEMA)
    vectors = {i: np.array(v) for i, v, _ in rows}
    got = ann.nearest(df, df.where("vec_id % 20 == 0")).toPandas()
    want = brute(vectors, range(0, 800, 20), 20)
    hits = 0
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 21)) and (np.diff(g.score) <= 0).all()
        assert all(abs(s - np.dot(vectors[q], vectors[i])) < 1e-12 for i, s in zip(g.vec_id, g.score, strict=True))
        hits += len(set(want[q]) & set(g.vec_id))
    assert hits >= 0.9 * 20 * 40


def test_copies_ties_and_unusable_vectors(spark):
    base = [1.0, 2.0, 2.0]
    rows = [(i, base, 0) for i in range(60)] + [(100 + i, [1.0, 0.1 * i, 0.5], 0) for i in range(5)]
    rows += [(200, None, 0), (201, [0.0, 0.0, 0.0], 0), (202, [1.0, None, 1.0], 0), (203, [float("nan"), 1.0, 1.0], 0), (204, [float("inf"), 1.0, 1.0], 0), (0, base, 0), (None, base, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = ann.nearest(df, df.where("vec_id in (0, 40, 200, 201, 203)")).toPandas()
    assert set(got.query_id) == {0, 40}
    for q in (0, 40):
        g = got[got.query_id == q].sort_values("rank")
        assert list(g.vec_id) == [i for i in range(22) if i != q][:20] and set(g.score) == {9.0}


def test_few_candidates_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0), (20, [0.5, 0.5], 0), (3, [0.0, 1.0], 0)], SCHEMA)
    got = ann.nearest(df, df.where("vec_id % 20 == 0")).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(0, 1, 20), (0, 2, 3), (20, 1, 0), (20, 2, 3)]
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0
    assert ann.nearest(df.withColumn("id", F.lit(1)).withColumn("v", F.lit(2)).withColumn("rep", F.lit(3)), df).count() == 6


def pairs(got) -> dict:
    out = {}
    for r in sorted(got.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append(r[2])
    return out


def test_each_length_is_searched_by_itself(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(1000, [1.0] * 9, 0), (1020, [2.0] * 9, 0), (2000, [5.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = pairs(ann.nearest(df, df.where("vec_id % 20 == 0")))
    plain = {i: np.array(np.float32(v), float) for i, v, _ in rows[:300]}
    want = brute(plain, range(0, 300, 20), 20)
    assert sum(len(set(want[q]) & set(got[q])) for q in want) >= 0.9 * 20 * len(want)
    assert got[1000] == [1020] and got[1020] == [1000] and 2000 not in got


def test_ties_between_different_vectors_and_blocks(spark, monkeypatch):
    """Orthogonal vectors all score 0: the smaller ids win, in any block, and blocks give no more than they must."""
    monkeypatch.setattr(ann, "BLOCK_ROWS", 64)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 4)
    rng = np.random.default_rng(2)
    flat = np.hstack([np.zeros((400, 4)), rng.integers(-3, 4, (400, 4)) + 0.5])
    rows = [(i, v.tolist(), 0) for i, v in enumerate(flat)] + [(1000 + 20 * k, [1.0 + k] + [0.0] * 7, 0) for k in range(12)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = pairs(ann.nearest(df, df.where("vec_id >= 1000")))
    for k in range(12):
        others = [1000 + 20 * m for m in range(11, -1, -1) if m != k]
        assert got[1000 + 20 * k] == others + list(range(9))
    i, j, s = ann.best(np.eye(8)[:2], flat, np.arange(400), 5)
    assert len(i) == 10 and j.tolist() == [*range(5)] * 2 and not s.any()


def test_sparse_rest_goes_on(spark):
    """A tight cluster holds most queries and sets the distance; the scattered others still find all their neighbours."""
    rng = np.random.default_rng(3)
    tight, loose = rng.normal(size=(1, 12)) + 0.01 * rng.normal(size=(900, 12)), 3 * rng.normal(size=(300, 12))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.vstack([tight, loose]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = pairs(ann.nearest(df, df.where("vec_id % 20 == 0")))
    want = brute({i: np.array(v) for i, v, _ in rows}, range(0, 1200, 20), 20)
    assert all(len(got[q]) == 20 for q in want)
    assert sum(len(set(want[q]) & set(got[q])) for q in want if q >= 900) >= 0.95 * 20 * 15


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    vectors = {r.vec_id: np.array(r.embedding, float) for r in df.collect() if r.embedding is not None and len(r.embedding)}
    got = pairs(ann.nearest(df, df.where("vec_id % 20 == 0")))
    want = brute(vectors, got, 20)
    assert sum(len(set(want[q]) & set(got[q])) for q in want) >= 0.95 * sum(map(len, want.values()))


def test_probes_come_likeliest_first():
    h = ann.Hashing(6, 1.0, 0.5, tables=1, k=3)
    counts, cells = h.probes(np.array([[0.5, 0.5, 0.5], [0.02, 0.5, 0.98]]))
    assert counts.sum() == len(cells) and cells[0].tolist() == [0, 0, 0]
    second = cells[counts[0] :]
    assert second[0].tolist() == [0, 0, 0] and {tuple(c) for c in second[1:3].tolist()} == {(-1, 0, 0), (0, 0, 1)}
    assert len(np.unique(cells[: counts[0]], axis=0)) == counts[0]
