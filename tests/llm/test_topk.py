import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import topk


def brute(rows, k, wanted):
    vectors = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {(i, tuple(v)) for i, v in vectors if wanted(i)}:
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in vectors if i != q)
        out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(5)
    out = [(i, (r.standard_normal(6) * (1 + i % 4)).tolist()) for i in range(400)]
    out += [(i, [0.25] * 6) for i in range(400, 460)]  # ties
    out += [(500, None), (520, [None, 1.0, 2.0, 3.0, 4.0, 5.0]), (540, [float("nan")] * 6), (560, [float("inf")] * 6), (580, []), (600, [1.0, 2.0]), (None, [1.0] * 6), (620, [0.0] * 6), (7, [0.5] * 6), (7, [0.5] * 6)]
    return out


def test_against_brute_force(spark, rows):
    df = spark.createDataFrame([(*x, "c", 1) for x in rows], "vec_id long, embedding array<float>, vec string, score int")
    expected = brute(rows, 10, lambda i: i % 20 == 0)
    for options in ({}, {"pivots": 5, "annuli": 4, "part_bytes": 1, "least_part": 40, "sample": 50}):
        got = topk.top_k(df, F.col("vec_id") % 20 == 0, **options)
        assert sorted(map(tuple, got.collect())) == expected
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert topk.top_k(df, F.col("vec_id") < 0).count() == 0


def test_fewer_candidates_than_k(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [-1.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") == 0).collect())) == [(0, 1, 1, 2048 * 1024), (0, 2, 2, -1024 * 1024)]
    alone = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert topk.top_k(alone, F.col("vec_id") == 0).count() == 0


def test_large_components_are_exact(spark):
    """Products past 2^53, past 2^63, and components past a long."""
    r = np.random.default_rng(6)
    long = np.iinfo(np.int64)
    for size in (3e5, 1e7, 3e14, 1e18):
        rows = [(i, (r.standard_normal(5) * 10 + size * (1 if i % 3 else -1)).tolist()) for i in range(120)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = topk.top_k(df, F.col("vec_id") % 40 == 0, pivots=6, least_part=16)
        vectors = [(i, [max(long.min, min(long.max, math.floor(1024 * x))) for x in v]) for i, v in rows]
        expected = []
        for q, v in vectors[::40]:
            scores = sorted((-max(long.min, min(long.max, sum(a * b for a, b in zip(v, w, strict=True)))), i) for i, w in vectors if i != q)
            expected += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:10])]
        assert sorted(map(tuple, got.collect())) == sorted(expected)


def test_several_vectors_under_a_query_id(spark):
    df = spark.createDataFrame([(0, [2.0, 0.0]), (0, [1.0, 5.0]), (1, [1.0, 1.0]), (2, [0.0, 3.0])], "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") == 0).collect()]
    assert sorted(got) == [(1, 6 * 1024**2), (2, 15 * 1024**2)]  # (1, 5) is less than (2, 0)


def test_a_part_stops_at_the_bound(monkeypatch):
    """Expansion from the nearest stretch leaves out those that the triangle inequality rules out."""
    seen = []
    real = topk.products
    monkeypatch.setattr(topk, "products", lambda x, y, g: seen.append(len(y)) or real(x, y, g))
    n = 50 * topk.ROWS
    radius = np.arange(n)
    vectors = np.column_stack([radius, np.zeros(n, np.int64)])
    square = float(n * n)
    part = topk.Part(radius.astype(float), np.arange(n), vectors, square, n)
    query = np.array([[n, 0]])
    bound = np.array([n * (n - 100)])
    found = list(part.best(np.array([-1]), query, np.array([float(n)]), bound, np.array([True]), 10))
    assert [i for _, i, _ in found] == list(range(n - 1, n - 11, -1)) and len(seen) < 25
