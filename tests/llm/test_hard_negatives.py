import numpy as np
import pytest
from pyspark.sql import functions as F

from tillmark.llm import hard_negatives as h


def brute(rows, scale=256):
    fit = []
    for i, v, label in rows:
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v):
            fit.append((i, [int(np.floor(scale * float(x))) for x in v], label))
    found = []
    for a in [r for r in fit if r[0] % 50 == 0]:
        scored = [(-sum(x * y for x, y in zip(a[1], v)), i, label) for i, v, label in fit if i != a[0] and len(v) == len(a[1])]
        scored.sort(key=lambda s: s[:2])
        for p, pid, _ in [s for s in scored if s[2] == a[2]][:5]:
            hard = [s for s in scored if s[2] != a[2] and 50 * -p <= 100 * -s[0] <= 95 * -p][:3]
            found += [(a[0], pid, n + 1, i, -p, -s) for n, (s, i, _) in enumerate(hard)]
    return sorted(found)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    df = df.withColumns({"rid": F.lit("mine"), "part": F.lit("mine"), "d": F.lit("mine")})
    return sorted(map(tuple, h.hard_negatives(df, F.col("id") % 50 == 0, **options).collect()))


def made(n, d, seed=2):
    rng = np.random.RandomState(seed)
    centres = rng.randn(4, d)
    labels = rng.choice(4, n, p=[0.4, 0.3, 0.2, 0.1])
    return [(i, (centres[k] + 0.8 * rng.randn(d)).round(2).tolist(), int(k)) for i, k in enumerate(labels)]


def test_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(h, "SHARD_ROWS", 150)
    monkeypatch.setattr(h, "TILE_ROWS", 16)
    monkeypatch.setattr(h, "BLOCK_ROWS", 4)
    rows = made(800, 6)
    rows += [(2000 + i, rows[7][1], rows[7][2]) for i in range(30)]  # ties
    rows += [(2100 + i, rows[11][1], (rows[11][2] + 1) % 4) for i in range(30)]
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (0, [1.0, 2.0], 1), (0, [1.0, 2.5], 1), (1, None, 1), (2, [None, 1.0], 1), (3, [nan, 1.0], 2), (4, [inf, 0.0], 2),
        (5, [0.5, 2.0], 1), (5, [0.5, 1.75], 1), (6, [], 1), (7, [1.0], 1), (None, [1.0, 1.0], 1), (8, [1.0, 1.0], None),
        (9, [0.5, 1.0], 2), (9, [0.5, 1.0], 2), (10, [0.0, 0.0], 1), (50, [0.0, 0.0], 1), (100, [-1.0, 0.25], 3), (101, [0.5, 0.0], 3),
        (102, [0.0, 0.0], 4),
    ]
    found = run(spark, rows)
    assert found == brute(rows) and found
    assert run(spark, rows[:0]) == [] and run(spark, rows[:1]) == [] and run(spark, rows[2:3]) == []


def test_large_products_are_exact(spark):
    big = 2.0**30
    rows = [(0, [big, 1.0], 0), (1, [big, 2.0], 0), (2, [big, 3.0], 0)] + [(i, [big * 0.9, float(i)], 1) for i in range(3, 9)]
    assert run(spark, rows, scale=1) == brute(rows, 1)
    with pytest.raises(Exception, match="64 bits"):
        run(spark, [(0, [2.0**40], 0), (1, [2.0**40], 0)])


def test_bounds_hold_and_leave_work_out():
    rng = np.random.RandomState(4)
    centres = 200 * rng.randn(8, 16)
    points = np.concatenate([centres[k] + 30 * rng.randn(1024, 16) for k in range(8)]).astype(np.int64)
    norms, own = h.angles(points, h.references(points.astype(float)))
    order = np.lexsort((own.min(1), own.argmin(1)))
    points, norms, own = points[order], norms[order], own[order]
    tile = h.tiles(norms, own)
    low, high = h.score_bounds(norms[:40], own[:40], tile)
    scores = points[:40] @ points.T
    most, least = (f.reduceat(scores, tile["first"], axis=1) for f in (np.maximum, np.minimum))
    assert (low <= least).all() and (most <= high).all()
    kth = np.sort(scores, 1)[:, -6]
    assert (high >= kth[:, None]).mean() < 0.3
