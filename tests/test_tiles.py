"""Stencils on tiles against the joins on cells that they stand for."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravane.operators import contours, raster, segmentation, tiles

BY = ("case_id",)


def cells_of(spark, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(c, int(u) + du, int(v) - 9, *map(int, rng.integers(0, 4, 2)), bool(rng.random() < 0.3)) for c, w, h, du in (("a", 23, 31, -11), ("b", 9, 5, 40)) for u in range(w) for v in range(h) if rng.random() < 0.95]
    return spark.createDataFrame(rows, "case_id string, u int, v int, label int, kind int, hole boolean")


def table(df, *columns):
    return {(r["case_id"], r["u"], r["v"], *[r[c] for c in columns]) for r in df.collect()}


@pytest.mark.parametrize("side", [4, 64])
def test_median_masks_and_fill(spark, side):
    cells = cells_of(spark)
    disc = raster.offsets("disc", 2)

    def run(a, have, row):
        wide = tiles.widened(have & (a["kind"] == 0), disc)
        return {"median": tiles.lower_median(a["label"], have, 2), "wide": wide, "narrow": tiles.narrowed(wide, disc), "fill": tiles.filled(a["label"], have & ~a["hole"], have & a["hole"], 3)}

    got = tiles.over_tiles(cells, BY, {"label": "int", "kind": "int", "hole": "boolean"}, 5, run, {"median": "int", "wide": "boolean", "narrow": "boolean", "fill": "int"}, side=side)
    assert table(got, "median") == table(raster.median_filter(cells, 2, "label", BY), "label")
    wide = raster.dilate(cells.where("kind = 0"), disc, BY)
    assert table(got.where("wide")) == table(cells.join(wide, ["case_id", "u", "v"], "left_semi"))
    assert table(got.where("narrow")) == table(cells.join(raster.erode(wide, disc, BY), ["case_id", "u", "v"], "left_semi"))
    assert table(got.where("fill >= 0"), "fill") == table(raster.nearest_fill(cells, "hole", "label", by=BY).where("label is not null"), "label")


@pytest.mark.parametrize("eight", [True, False])
def test_components_across_tiles(spark, eight, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(c, u, v, int(rng.integers(0, 2))) for c in "ab" for u in range(-140, 20) for v in range(100, 160) if rng.random() < 0.9]
    df = spark.createDataFrame(rows, "case_id string, u int, v int, kind int")
    got = {(r["case_id"], r["u"], r["v"]): r["component"] for r in contours.labelled_components(df, BY, eight, "kind").collect()}
    kind, seen = {r[:3]: r[3] for r in rows}, {}
    for start in sorted(kind):
        if start in seen:
            continue
        todo, seen[start] = [start], start
        while todo:
            c, u, v = todo.pop()
            for a in (-1, 0, 1):
                for b in (-1, 0, 1):
                    n = (c, u + a, v + b)
                    if (eight or 0 in (a, b)) and kind.get(n) == kind[start] and n not in seen:
                        seen[n] = start
                        todo.append(n)
    names = {}
    for cell, root in seen.items():
        names.setdefault(root, set()).add(got[cell])
    assert all(len(x) == 1 for x in names.values()) and len({min(x) for x in names.values()}) == len(names)


def test_far_cells_are_refused(spark):
    with pytest.raises(Exception, match="does not fit"):
        contours.labelled_components(spark.createDataFrame([("a", 1 << 20, 0)], "case_id string, u int, v int"), BY).collect()


def test_water_of_arrays_is_that_of_columns(spark):
    rng = np.random.default_rng(6)
    rgb = rng.integers(0, 256, (2000, 3))
    rgb[:500] = np.stack([rng.integers(0, 90, 500), rng.integers(60, 200, 500), rng.integers(150, 256, 500)], 1)
    df = spark.createDataFrame([tuple(map(int, c)) for c in rgb], "r int, g int, b int")
    want = [r[0] for r in df.select(segmentation.is_water(F.col("r"), F.col("g"), F.col("b"))).collect()]
    assert segmentation.water_mask(*rgb.T.astype(float)).tolist() == want and 50 < sum(want) < 1950


def test_wide_smoothing_is_the_masked_gaussian_mean(spark):
    rng = np.random.default_rng(7)
    u, v = np.meshgrid(np.arange(90), np.arange(70), indexing="ij")
    z, use = 10 + 0.05 * u + 2 * np.sin(v / 15) + rng.normal(0, 0.1, u.shape), rng.random(u.shape) < 0.8
    use[:30, :40] = False  # a wide hole in the mask
    rows = [("a", int(a) - 5, int(b), float(z[a, b]), bool(use[a, b]), "clash") for a, b in np.ndindex(*u.shape)]
    rows += [("b", 0, 0, 1.0, False, ""), ("b", 3, 0, None, True, ""), ("c", 7, 7, 2.5, True, "")]
    df = spark.createDataFrame(rows, "case_id string, u int, v int, z double, use boolean, other string")
    got = {(r["case_id"], r["u"], r["v"]): r["z"] for r in raster.wide_smooth(df, 12.0, "z", "use", BY).collect()}
    weight = np.exp(-((np.arange(90)[:, None] - np.arange(90)) ** 2) / (2 * 12.0**2))
    total, norm = (weight @ np.where(use, x, 0.0) @ weight[:70, :70] for x in (z, np.ones_like(z)))
    want = total / norm
    assert len(got) == len(rows) and got["b", 0, 0] is got["b", 3, 0] is None and got["c", 7, 7] == 2.5
    assert max(abs(got["a", a - 5, b] / want[a, b] - 1) for a, b in np.ndindex(*u.shape)) < 0.001


def test_smoothing_and_median_hold_no_task_s_cells(spark):
    rng = np.random.default_rng(6)
    rows = [(c, u, v, None if rng.random() < 0.2 else float(rng.normal()), None if rng.random() < 0.2 else int(rng.integers(0, 9))) for c in "ab" for u in range(-20, 3) for v in range(120, 135) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "case_id string, u int, v int, z double, k int")
    weights = [1.0, 0.5, 0.25]
    now = {r[:3]: r[3] for r in rows}
    for axis in (0, 1):
        then = {}
        for c, *at in now:
            near = [((c, at[0] + d * (axis == 0), at[1] + d * (axis == 1)), weights[abs(d)]) for d in range(-2, 3)]
            known = [w * now[p] for p, w in near if now.get(p) is not None]
            then[c, *at] = sum(known) / sum(w for p, w in near if p in now) if known else None
        now = then
    smoothed = raster.smooth(df, weights, "z", BY)
    got = {(r["case_id"], r["u"], r["v"]): r["z"] for r in smoothed.collect()}
    assert got.keys() == now.keys() and all(got[p] == pytest.approx(now[p]) for p in now)
    kinds = {r[:3]: r[4] for r in rows}
    want = {}
    for c, u, v in kinds:
        near = sorted(k for i in (-1, 0, 1) for j in (-1, 0, 1) if (k := kinds.get((c, u + i, v + j))) is not None)
        want[c, u, v] = near[(len(near) - 1) // 2] if near else None
    median = raster.median_filter(df, 1, "k", BY)
    assert {(r["case_id"], r["u"], r["v"]): r["k"] for r in median.collect()} == want
    words = raster.median_filter(df.withColumn("k", F.col("k").cast("string")), 1, "k", BY)
    assert {(r["case_id"], r["u"], r["v"]): r["k"] and int(r["k"]) for r in words.collect()} == want
    for out in (smoothed, median):  # cells move before anything is added up
        assert "Aggregate" not in out._jdf.queryExecution().executedPlan().toString().rpartition("Exchange")[2].partition("Initial Plan")[0]
