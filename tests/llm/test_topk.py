import math
import random

import pytest
from pyspark.sql import functions as F

from quirefold.llm import topk


def brute(rows, every, k):
    whole = {i: [math.floor(64 * x) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q in whole:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)
            out |= {(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)}
    return out


@pytest.mark.parametrize(("n", "dims", "spread"), [(900, 8, 1.0), (400, 3, 0.1), (7, 4, 1.0)])
def test_against_brute_force(spark, monkeypatch, n, dims, spread):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 300)
    monkeypatch.setattr(topk, "QUERY_ROWS", 20)
    monkeypatch.setattr(topk, "PAGE", 16)
    monkeypatch.setattr(topk, "HELD", 500)
    draw = random.Random(n)
    rows = [(i, [draw.gauss(0, spread) for _ in range(dims)]) for i in range(n)]
    rows += [(n + i, [0.5] * dims) for i in range(n // 3)] + [(-20 * i, [0.0] * dims) for i in (3, 4)]
    rows += [(10_100, []), (10_120, [])]
    rows += [(10_000, None), (10_040, [None] * dims), (10_060, [math.nan] * dims), (10_080, [math.inf] * dims), (None, [1.0] * dims)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, 20).collect()
    assert {tuple(r) for r in got} == brute(rows, 20, 20)
    assert len(got) == len(set(got))


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0])], "vec_id long, embedding array<float>")
    assert topk.top_k(df.limit(0), F.lit(True), 20).count() == 0
    assert {tuple(r) for r in topk.top_k(df, F.lit(True), 20).collect()} == {(0, 1, 1, 4096), (1, 1, 0, 4096)}


def test_an_id_with_several_vectors(spark):
    """Its own rows take the first places of its queries; k others are left nevertheless."""
    rows = [(-7, [9.0 + i, 1.0]) for i in range(5)] + [(i, [i / 8, 1.0]) for i in range(1, 31)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
    scored = sorted((-sum(a * b for a, b in zip(q, v)), i) for o, q in whole if o == -7 for i, v in whole if i != -7)
    got = topk.top_k(df, F.col("vec_id") == -7, 4).collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in got) == [(n, i, -s) for n, (s, i) in enumerate(scored[:4], 1)]


def test_components_of_any_size(spark, monkeypatch):
    """Products beyond doubles and longs: exact below the range of a long, its end beyond."""
    monkeypatch.setattr(topk, "BLOCK_ROWS", 40)
    monkeypatch.setattr(topk, "PAGE", 8)
    draw = random.Random(5)
    sizes = [1.0, 300_000.0, 2.0**23 + 1, 1e12]
    rows = [(i, [draw.gauss(0, 1) * draw.choice(sizes) for _ in range(draw.randrange(5))]) for i in range(120)]
    rows += [(200, [1e300, 1.0]), (201, [-1e300, 1.0]), (202, [300_000.0, 1.0])]
    for data in (rows[:120], rows):
        df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
        got = topk.top_k(df, F.col("vec_id") % 20 == 0, 5).collect()
        end = (1 << 63) - 1
        want = set()
        whole = {i: [math.floor(64 * x) for x in v] for i, v in data}
        for q in (i for i in whole if i % 20 == 0):
            scored = sorted((-max(-end - 1, min(end, sum(a * b for a, b in zip(whole[q], v)))), i) for i, v in whole.items() if i != q)
            want |= {(q, n, i, -s) for n, (s, i) in enumerate(scored[:5], 1)}
        assert {tuple(r) for r in got} == want


def test_pages_are_ruled_out():
    """Of clustered vectors few are scored, and the k best are those of all."""
    import numpy as np

    draw = np.random.default_rng(1)
    centers = draw.normal(0, 64, (60, 16))
    whole = np.floor(centers[draw.integers(0, 60, 6000)] + draw.normal(0, 2, (6000, 16)))
    queries = whole[:200]
    largest = float((whole**2).sum(axis=1).max())
    (qs, rows, scores), computed = topk.search(whole, np.arange(6000), queries, np.full(200, -np.inf), 10, largest)
    every = (queries @ whole.T).astype(int)
    for q in range(200):
        best = np.lexsort((np.arange(6000), -every[q]))[:10]
        assert rows[qs == q].tolist() == best.tolist() and scores[qs == q].tolist() == every[q][best].tolist()
    assert computed < 0.3 * every.size, computed / every.size
