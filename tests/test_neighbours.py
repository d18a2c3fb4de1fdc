"""Nearest neighbours over cells, rounds and trees, against brute force."""

import numpy as np
import pytest

from geolode.operators import neighbours


def brute(points, queries, k):
    out = set()
    for q, (qx, qy) in enumerate(queries):
        order = sorted(((x - qx) * (x - qx) + (y - qy) * (y - qy), i) for i, (x, y) in enumerate(points))[:k]
        out |= {(q, d2, i, rank) for rank, (d2, i) in enumerate(order, 1)}
    return out


def found(spark, points, queries, k, **more):
    p = spark.createDataFrame([(float(x), float(y), i) for i, (x, y) in enumerate(points)], "x double, y double, id long")
    q = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(queries)], "q long, qx double, qy double")
    rows = neighbours.nearest(p, q, k, **more).collect()
    assert len(rows) == len(set(rows))
    return {(r.q, r.d2, r.id, r["rank"]) for r in rows}


@pytest.mark.parametrize("k", [1, 4])
def test_neighbours_several_cells_away_and_crowded_cells(spark, monkeypatch, k):
    monkeypatch.setattr(neighbours, "TREE", 40)
    monkeypatch.setattr(neighbours, "QUERIES", 15)
    rng = np.random.default_rng(k)
    points = np.vstack([rng.normal(0, 1, (300, 2)), rng.uniform(-100, 100, (40, 2)), [[500.0, 500.0]], np.repeat([[7.0, 7.0]], 60, 0), rng.integers(-3, 3, (50, 2))])
    queries = np.vstack([rng.normal(0, 1, (40, 2)), rng.uniform(-150, 150, (30, 2)), [[499.0, -400.0], [-3000.0, 20.0], [7.0, 7.0], [7.0, 7.0]], rng.integers(-4, 4, (20, 2))])
    assert found(spark, points, queries, k, size=1.0) == brute(points, queries, k)


def test_few_points_and_odd_rows(spark):
    assert found(spark, [(1.0, 2.0)], [(0.0, 0.0), (1.0, 2.0)], 3) == {(0, 5.0, 0, 1), (1, 0.0, 0, 1)}
    assert found(spark, [(0.0, 0.0), (0.0, 0.0), (9.0, 0.0)], [(4.0, 0.0)], 2) == {(0, 16.0, 0, 1), (0, 16.0, 1, 2)}
    assert found(spark, [], [(4.0, 0.0)], 2) == set()
    p = spark.createDataFrame([(None, 1.0, 1), (float("nan"), 1.0, 2), (3.0, 3.0, 3)], "x double, y double, id long")
    q = spark.createDataFrame([(1, None, 0.0), (2, 0.0, 0.0)], "q long, qx double, qy double")
    assert [(r.q, r.id) for r in neighbours.nearest(p, q).collect()] == [(2, 3)]
    assert neighbours.nearest(p, q.limit(0)).collect() == []


def test_trees_equal_sorting():
    rng = np.random.default_rng(9)
    for n, k in ((1, 1), (17, 3), (2000, 5), (500, 1)):
        points, queries = rng.integers(0, 40, (n, 2)).astype(float), rng.uniform(-5, 45, (60, 2)).round(1)
        d2, ids = neighbours.Tree(points, rng.permutation(n).astype(np.int64)).nearest(queries, k)
        tree = neighbours.Tree(points, np.arange(n))
        d2, ids = tree.nearest(queries, k)
        for q in range(60):
            want = sorted((float(((points[i] - queries[q]) ** 2).sum()), i) for i in range(n))[:k]
            assert [(pytest.approx(a), b) for a, b in want] == [(a, b) for a, b in zip(d2[q], ids[q]) if np.isfinite(a)]


def test_a_query_looks_at_its_own_cell_first(spark, monkeypatch):
    asked, keep = [], neighbours.kept

    def counted(df):
        table = keep(df)
        if "trees" in table.columns:
            asked.append(table.count())
        return table

    monkeypatch.setattr(neighbours, "kept", counted)
    rng = np.random.default_rng(4)
    points, queries = rng.uniform(0, 100, (9000, 2)), rng.uniform(0, 100, (200, 2))
    assert found(spark, points, queries, 3) == brute(points, queries, 3)
    assert asked[0] == 200 and sum(asked) < 300  # and not nine cells each
