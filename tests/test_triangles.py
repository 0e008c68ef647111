"""Triangulations in tiles against all triples with an empty circle, and the heights on them."""

from itertools import combinations

import numpy as np
import pytest

from terravane.operators import triangles as tri
from terravane.operators.graph import cut_lineage


def empty_circles(xy):
    """All triples whose circumcircle holds no other point."""
    found = set()
    for t in combinations(range(len(xy)), 3):
        a, b, c = xy[list(t)]
        d = 2 * ((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))
        if d == 0:
            continue
        bb, cc = ((b - a) ** 2).sum(), ((c - a) ** 2).sum()
        centre = a + np.array([(c - a)[1] * bb - (b - a)[1] * cc, (b - a)[0] * cc - (c - a)[0] * bb]) / d
        away = ((xy - centre) ** 2).sum(1)
        away[list(t)] = np.inf
        if away.min() > ((a - centre) ** 2).sum():
            found.add(t)
    return found


@pytest.mark.parametrize("per_tile", [4, 200])
def test_tiles_give_the_triangles_of_all_points(spark, per_tile, monkeypatch):
    monkeypatch.setattr(tri, "TILE_POINTS", per_tile)
    rng = np.random.default_rng(1)
    groups = {"a": rng.uniform(0, 100, (60, 2)), "b": np.stack([rng.uniform(0, 300, 50), rng.normal(0, 1, 50)], 1), "c": rng.uniform(0, 1, (3, 2)), "d": rng.uniform(0, 1, (2, 2))}
    rows = [(g, i, float(x), float(y), 0.0, "clash") for g, xy in groups.items() for i, (x, y) in enumerate(xy)]
    rows += [("a", 999, *map(float, groups["a"][7]), 0.0, "clash"), ("a", 998, None, 1.0, 1.0, "clash")]
    df = spark.createDataFrame(rows, "case_id string, id long, x double, y double, z double, tile string")
    got = {}
    for r in tri.triangulate(df).collect():
        got.setdefault(r["case_id"], []).append((r["a"]["id"], r["b"]["id"], r["c"]["id"]))
    for g, xy in groups.items():
        assert len(got.get(g, [])) == len(set(got.get(g, []))) and set(got.get(g, [])) == empty_circles(xy)


def test_points_on_a_grid_cover_it_once(spark, monkeypatch):
    monkeypatch.setattr(tri, "TILE_POINTS", 9)
    rows = [("a", u * 100 + v, u * 3.0, v * 3.0, float(u)) for u in range(12) for v in range(9)]
    df = spark.createDataFrame(rows, "case_id string, id long, x double, y double, z double")
    area = sum(abs((r["b"]["x"] - r["a"]["x"]) * (r["c"]["y"] - r["a"]["y"]) - (r["b"]["y"] - r["a"]["y"]) * (r["c"]["x"] - r["a"]["x"])) / 2 for r in tri.triangulate(df).collect())
    assert area == pytest.approx(33 * 24)


def test_heights_are_linear_inside_and_nearest_outside(spark):
    rng = np.random.default_rng(3)
    xy = rng.uniform(2, 30, (80, 2))
    rows = [("a", i, float(x), float(y), float(3 * x - 2 * y + 5)) for i, (x, y) in enumerate(xy)]
    df = spark.createDataFrame(rows, "case_id string, id long, x double, y double, z double")
    cells = spark.createDataFrame([(c, u, v) for c in "ab" for u in range(32) for v in range(0, 40, 3)], "case_id string, u int, v int")
    got = {(r["case_id"], r["u"], r["v"]): r["z"] for r in tri.heights(cells, df).collect()}
    assert len(got) == cells.count() and all(z is None for (c, _, _), z in got.items() if c == "b")
    hull = xy[tri.convex_hull(xy)]
    for (c, u, v), z in got.items():
        if c == "b":
            continue
        edge, rest = np.roll(hull, -1, 0) - hull, np.array([u, v]) - hull
        side = edge[:, 0] * rest[:, 1] - edge[:, 1] * rest[:, 0]
        if (side > 1e-3).all():
            assert z == pytest.approx(3 * u - 2 * v + 5, abs=1e-2)
        elif (side < -1e-3).any():
            i = ((xy - (u, v)) ** 2).sum(1).argmin()
            assert z == pytest.approx(rows[i][4])


def test_no_points(spark):
    df = spark.createDataFrame([], "case_id string, id long, x double, y double, z double")
    assert tri.triangulate(df).collect() == []


def test_the_hull_comes_once_to_a_tile(spark):
    plans = []

    def cut(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut_lineage(df)

    points = spark.createDataFrame([(0, k, float(k * 37 % 101), float(k * 61 % 103), 1.0) for k in range(40)], "case_id int, id long, x double, y double, z double")
    assert tri.triangulate(points, cut=cut).count() > 40
    assert any("FlatMapCoGroups" in p for p in plans)
