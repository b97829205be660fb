import numpy as np
import pytest
from pyspark.sql import functions as F

from tillmark.llm import topk_search as t


def brute(rows, k):
    fit = []
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            fit.append((i, [int(np.floor(1024 * float(x))) for x in v]))
    found = []
    for q, own in [r for r in fit if r[0] % 100 == 0]:
        scores = [(-sum(a * b for a, b in zip(own, v)), i) for i, v in fit if i != q and len(v) == len(own)]
        found += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(found)


def run(spark, rows, k=10):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("mine"))
    return sorted(map(tuple, t.top_k(df, F.col("id") % 100 == 0, k=k).collect()))


def test_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(t, "SHARD_ROWS", 100)
    monkeypatch.setattr(t, "QUERY_ROWS", 3)
    rng = np.random.RandomState(5)
    centres = rng.randn(4, 6)
    rows = [(i, (centres[i % 4] + 0.2 * rng.randn(6)).round(2).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[7][1]) for i in range(40)]  # ties
    assert run(spark, rows) == brute(rows, 10)


def test_odd_vectors(spark):
    rows = [
        (0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]),
        (5, [0.5, 0.5]), (5, [0.25, 0.5]), (6, []), (7, [1.0]), (None, [1.0, 1.0]), (100, [-1.0, 0.0]), (200, [2.0]), (8, [0.0, 0.0]),
    ]
    assert run(spark, rows, 3) == brute(rows, 3)
    assert run(spark, rows[:1]) == [] and run(spark, rows[2:3]) == []


def test_large_products_are_exact(spark):
    big = 2.0**20
    rows = [(0, [big, 1.0]), (0, [big, 2.0])] + [(i, [big, float(i)]) for i in range(1, 20)] + [(3, [big, 9.0]), (3, [big, 9.0])]
    assert run(spark, rows, 12) == brute(rows, 12)
    with pytest.raises(Exception, match="64 bits"):
        run(spark, [(0, [1e9, 1e9]), (1, [1e9, 1e9])])


def test_bounds_leave_work_out():
    rng = np.random.RandomState(2)
    points = np.concatenate([rng.randn(500, 8) + 20 * c for c in rng.randn(8, 8)]).round().astype(np.int64)
    tree = t.build_tree(points.astype(float))
    seen = []

    class Counting(t.Best):
        def take(self, rows, scores, ids):
            seen.append(scores.size)
            super().take(rows, scores, ids)

    own = points[tree["order"]]
    best = Counting(5, 3)
    t.search_shard(tree, own, np.arange(len(own)), own[:5], np.full(5, -1), best)
    assert sum(seen) < 0.5 * 5 * len(own)
    assert (np.sort(own[:5] @ own.T, 1)[:, :-4:-1] == best.scores).all()
