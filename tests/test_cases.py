"""Cases: evaluation, contours, segmentation, constraints and generators."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravane.functions.exprs import GeoRef, SectionFrame
from terravane.operators import builder, contours, evaluate, generate, graph, raster, segmentation, spatial, vector
from terravane.operators.grid import Grid, scenarios
from terravane.plans import case_queries
from terravane.sources import readers, writers

BASE = scenarios()["base"]


def _cells(spark, w, h):
    return spark.range(w * h).select((F.col("id") % w).cast("int").alias("u"), F.expr(f"cast(id div {w} as int)").alias("v"))


# ---- evaluation


def test_relabelled_maps_score_one_and_shifted_edges_do_not(spark):
    cells = _cells(spark, 60, 40)
    same = cells.select(F.lit("same").alias("case_id"), "u", "v", (F.col("u") >= 20).cast("int").alias("gt"), F.when(F.col("u") >= 20, 5).otherwise(8).alias("pred"))
    moved = cells.select(F.lit("moved").alias("case_id"), "u", "v", (F.col("u") >= 20).cast("int").alias("gt"), F.when(F.col("u") >= 22, 5).otherwise(8).alias("pred"))
    for tolerance, f1 in ((3, 1.0), (0, 0.0)):
        found = {r["case_id"]: r for r in evaluate.segmentation_metrics(same.unionByName(moved), tolerance).collect()}
        assert [found["same"][c] for c in ("pixel_accuracy", "macro_iou", "boundary_f1", "n_units_gt", "n_units_pred")] == [1.0, 1.0, 1.0, 2, 2]
        assert found["moved"]["pixel_accuracy"] == pytest.approx(1 - 2 / 60) and found["moved"]["boundary_f1"] == f1


def test_a_plain_map_has_no_boundary_and_unmatched_labels_never_count(spark):
    plain = _cells(spark, 8, 8).select(F.lit(1).alias("case_id"), "u", "v", F.lit(3).alias("gt"), F.lit(3).alias("pred"))
    r = evaluate.segmentation_metrics(plain).first()
    assert (r["boundary_precision"], r["boundary_recall"], r["pixel_accuracy"]) == (1.0, 1.0, 1.0)
    noisy = plain.withColumn("pred", F.when(F.col("u") == 0, 7).otherwise(3)).withColumn("ignore", F.col("v") == 0)
    r = evaluate.segmentation_metrics(noisy, ignore="ignore").first()
    assert r["pixel_accuracy"] == pytest.approx(7 / 8) and r["n_units_pred"] == 2


def test_metrics_become_long_rows_and_absent_cases_fail(spark):
    cells = _cells(spark, 4, 4).select(F.lit(1).alias("case_id"), "u", "v", (F.col("u") % 2).alias("gt"), (F.col("u") % 2).alias("pred"))
    out = evaluate.evaluate_cases(spark.createDataFrame([(1,), (2,)], "case_id int"), cells)
    assert {r["case_id"]: r["status"] for r in out.collect()} == {1: "ok", 2: "FAILED"}
    assert {(r["case_id"], r["metric"]) for r in evaluate.metric_rows(out).collect()} >= {(1, "pixel_accuracy"), (1, "macro_iou")}


def test_nearest_distances_against_brute_force(spark):
    rng = random.Random(3)
    points = [(k % 3, k, rng.uniform(0, 900), rng.uniform(0, 900)) for k in range(60)]
    targets = [(k % 2, rng.uniform(0, 100), rng.uniform(0, 100)) for k in range(9)]
    out = spatial.nearest_distances(spark.createDataFrame(points, "g int, id int, x double, y double"), spark.createDataFrame(targets, "g int, x double, y double"), 5.0, ("g",))
    for r in out.collect():
        _, _, x, y = next(p for p in points if p[1] == r["id"])
        want = min((math.hypot(x - a, y - b) for g, a, b in targets if g == r["g"]), default=None)
        assert (r["dist"] is None and want is None) or r["dist"] == pytest.approx(want)
    assert out.count() == 60


# ---- contours


def _drawn(spark):
    """Two maps: a ring of dashes in one, a row of dashes and a block of text-like blots in the other."""
    dark = set()
    for k in range(24):
        t = 2 * math.pi * k / 24
        for s in np.linspace(-4, 4, 17):
            x, y = 80 + 60 * math.cos(t) - s * math.sin(t), 80 + 60 * math.sin(t) + s * math.cos(t)
            dark |= {(0, int(round(x)) + a, int(round(y))) for a in (0, 1)}
    for k in range(8):
        dark |= {(1, 10 + 16 * k + s, 30 + a) for s in range(9) for a in (0, 1)}
        dark |= {(1, 20 + 14 * k + a, 90 + b) for a in range(6) for b in range(6)}
    return spark.createDataFrame([(c, u, v, 20, 20, 20) for c, u, v in dark], "case_id int, u int, v int, r int, g int, b int")


def test_contours_of_drawn_dashes(spark):
    rows = contours.extract_contours(_drawn(spark)).orderBy("case_id").collect()
    assert [(r["case_id"], r["contour_id"]) for r in rows] == [(0, 0), (1, 0)]
    ring, row = ([(v["x"], v["y"]) for v in r["vertices"]] for r in rows)
    assert ring[0] == ring[-1] and all(abs(math.hypot(x - 80.5, y - 80) - 60) < 2.5 for x, y in ring)
    assert rows[0]["length"] == pytest.approx(2 * math.pi * 60, rel=0.05)
    assert len(row) == 2 and {round(x) for x, _ in row} == {14, 126} and all(abs(y - 30.5) < 0.6 for _, y in row)
    named = contours.apply_elevations(contours.extract_contours(_drawn(spark)), spark.createDataFrame([(1, 0, 250.0)], "case_id int, contour_id int, elevation double"))
    assert {(r["case_id"], r["n_contours"], r["n_with_elevation"]) for r in contours.contour_counts(named).collect()} == {(0, 1, 0), (1, 1, 1)}


def test_dots_link_on_both_sides_whatever_their_way(spark):
    marks = [(1, k, 10.0 * k * math.cos(0.9), 10.0 * k * math.sin(0.9), 0.0, 0.0) for k in range(6)]
    links = contours.link_dashes(spark.createDataFrame(marks, "case_id int, component long, x double, y double, dx double, dy double"))
    assert {(r["u"], r["v"]) for r in links.collect()} == {(k, k + 1) for k in range(5)}


def test_links_of_many_dashes_at_few_places(spark, monkeypatch):
    rng = np.random.default_rng(8)
    marks = []
    for k in range(500):
        x, y = map(float, rng.choice([0.0, 7.0, 15.0, 24.0, 26.0], 2))
        a = rng.uniform(0, 2 * math.pi)
        marks.append((k % 2, k, x, y, *((0.0, 0.0) if k % 9 == 0 else (math.cos(a), math.sin(a)))))
    best = set()
    for case, a, x, y, dx, dy in marks:
        near = []
        for other, b, u, v, ex, ey in marks:
            d = math.sqrt((u - x) * (u - x) + (v - y) * (v - y))
            if other == case and 0 < d <= 18.0:
                wx, wy = (u - x) / d, (v - y) / d
                if all((p, q) == (0, 0) or abs(wx * p + wy * q) >= math.cos(math.radians(42.0)) for p, q in ((dx, dy), (ex, ey))):
                    near.append((d, b, wx, wy))
        near.sort()
        if (dx, dy) == (0, 0):
            sides = [near[:1], [n for n in near if n[2] * near[0][2] + n[3] * near[0][3] < -0.17]]
        else:
            sides = [[n for n in near if (n[2] * dx + n[3] * dy >= 0) == front] for front in (True, False)]
        best |= {(a, side[0][1]) for side in sides if side}
    joined, whole = [], contours.within
    monkeypatch.setattr(contours, "within", lambda *a, **k: joined.append(whole(*a, **k)) or joined[-1])
    links = contours.link_dashes(spark.createDataFrame(marks, "case_id int, component long, x double, y double, dx double, dy double"))
    assert {(r["u"], r["v"]) for r in links.collect()} == {(a, b) for a, b in best if a < b and (b, a) in best}
    assert sum(j.count() for j in joined) <= 2 * 25 * 25


def test_lines_run_on_over_gaps():
    wavy = [np.array([[x, 3 * math.sin(x / 20)] for x in range(a, b, 4)]) for a, b in ((0, 60), (70, 130), (140, 200))]
    across = np.array([[64.0, 8.0], [64.0, 60.0]])
    joined = vector.join_broken([wavy[1][::-1], across, wavy[0], wavy[2]], 20.0, 30.0)
    assert sorted(len(p) for p in joined) == [2, sum(map(len, wavy))]
    whole = max(joined, key=len)
    assert (np.diff(whole[:, 0]) > 0).all() or (np.diff(whole[:, 0]) < 0).all()


# ---- segmentation and degradations


def test_segmentation_of_two_maps(spark):
    cells = _cells(spark, 48, 40)
    left = F.col("u") < 24
    one = cells.select(F.lit("a").alias("case_id"), "u", "v", *[F.when(left, x).otherwise(y).alias(c) for c, x, y in (("r", 230, 120), ("g", 200, 180), ("b", 150, 110))])
    two = cells.select(F.lit("b").alias("case_id"), "u", "v", *[F.when(F.col("v") < 10, x).when(F.col("v") < 30, y).otherwise(z).alias(c) for c, x, y, z in (("r", 60, 240, 170), ("g", 120, 220, 120), ("b", 220, 170, 90))])
    line = (F.col("u") == 24) | ((F.col("u") == 5) & (F.col("v") == 5))
    pixels = one.unionByName(two).select("case_id", "u", "v", *[F.when(line & (F.col("case_id") == "a"), 15).otherwise(F.col(c)).alias(c) for c in "rgb"])
    labels, units = segmentation.segment_maps(pixels, segmentation.SegmentParams(min_region=30), light_sigma=16.0)
    found = {(r["case_id"], r["unit_id"]): r for r in units.collect()}
    # the lake and the unit below it are of one size, so either may come first
    assert sorted((c, v["role_guess"], round(v["n_px"], -2)) for (c, _), v in found.items()) == [("a", "strata", 1000), ("a", "strata", 1000), ("b", "strata", 500), ("b", "strata", 1000), ("b", "water", 500)]
    got = {(r["case_id"], r["u"], r["v"]): r["label"] for r in labels.collect()}
    assert len(got) == 2 * 48 * 40 and len({got["a", u, v] for u in range(0, 22) for v in range(40)}) == 1 and got["a", 5, 5] == got["a", 6, 6] != got["a", 40, 5]
    assert got["b", 3, 2] != got["b", 3, 20] != got["b", 3, 35]
    key = spark.createDataFrame([(c, k, n, *rgb) for c in "ab" for k, n, rgb in ((3, "sand", (230, 200, 150)), (4, "wood", (120, 180, 110)), (6, "lake", (60, 120, 220)))], "case_id string, unit_id int, name string, r int, g int, b int")
    _, named = segmentation.segment_maps(pixels.where("case_id = 'a'"), segmentation.SegmentParams(min_region=30, level_light=False), legend=key.where("case_id = 'a'"))
    assert {(r["unit_id"], r["name"]) for r in named.collect()} == {(3, "sand"), (4, "wood")}


def test_no_task_of_a_segmentation_gets_a_whole_map(spark):
    wide = segmentation.SegmentParams(sample=50, min_region=30)
    rows = [(c, u, v, *((200, 180, 90) if u < 20 else (60, 140, 70))) for c in "ab" for u in range(40) for v in range(30)]
    cells, plans = spark.createDataFrame(rows, "case_id string, u int, v int, r int, g int, b int"), []

    def cut(df):
        out = raster.materialise(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    labels, _ = segmentation.segment_maps(cells, wide, light_sigma=4.0, cut=cut)
    assert labels.count() == len(rows)
    tiles = [p for p in plans if "MapInArrow" in p and "centres" in p]
    assert tiles and not any("SortMergeJoin" in p for p in tiles)
    ranked = [p for p in plans if "FlatMapGroupsInPandas" in p]
    assert ranked and all("_range" in p for p in ranked)


def _sent(df):
    """The keys by which a plan joins with a broadcast table."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {name for keys in re.findall(r"BroadcastHashJoin \[(.*?)\], \[", plan) for name in re.findall(r"(\w+)#", keys)}


def test_only_rows_of_maps_and_labels_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(graph, "BROADCAST_ROWS", -1)
    sent, by = set(), ("case_id",)

    def cut(df):
        sent.update(_sent(df))
        return raster.materialise(df)

    # a dark block whose middle is beyond a tile's fill, specks, and a border of tiles
    colour = lambda u, v: (10, 10, 10) if u < 36 and v < 36 else (200, 60, 60) if u % 12 == 3 and v % 12 < 3 else (200, 180, 90) if u < 70 else (60, 140, 70)
    rows = [("a", u, v, *colour(u, v)) for u in range(140) for v in range(40)]
    labels, _ = segmentation.segment_maps(spark.createDataFrame(rows, "case_id string, u int, v int, r int, g int, b int"), segmentation.SegmentParams(sample=50, min_region=30, denoise=False), light_sigma=4.0, cut=cut)
    assert labels.count() == len(rows) and labels.select("u", "v").distinct().count() == len(rows)
    flat = spark.createDataFrame([("a", u, 0, "x", u % 3 == 0) for u in range(300)], "case_id string, u int, v int, kind string, hole boolean")
    cut(contours.labelled_components(flat, by, label="kind", cut=cut))
    cut(raster.nearest_fill(flat, "hole", "kind", cut, by))
    assert sent <= {"case_id", "label"}
    monkeypatch.setattr(segmentation, "segment_maps", lambda pixels, params: (pixels.select("case_id", "u", "v", F.lit(0).alias("label")), None))
    assert "u" not in _sent(case_queries.segment_cases(spark, "/root/testdata/sf0.001"))


def test_small_regions_are_told_by_tile(spark, monkeypatch):
    # components that lie in several tiles: 5, 4 and 1 cells
    at = [(126, 0, 7), (127, 0, 7), (128, 0, 7), (129, 0, 7), (129, 1, 7), (-1, 9, 8), (0, 9, 8), (0, 10, 8), (-1, 10, 8), (60, 60, 9)]
    parts = spark.createDataFrame([(c, u, v, 2, k) for c in "ab" for u, v, k in at if c == "a" or (u, v) != (127, 0)], "case_id string, u int, v int, label int, component long")
    for most in (0, graph.BROADCAST_ROWS):
        monkeypatch.setattr(graph, "BROADCAST_ROWS", most)
        got = {(r["case_id"], r["u"], r["v"]): r["small"] for r in segmentation._marked(parts, 5, ("case_id",), raster.materialise).collect()}
        assert got == {(r["case_id"], r["u"], r["v"]): r["component"] != 7 or r["case_id"] == "b" for r in parts.collect()}


def test_cells_of_least_hash_are_those_of_a_ranking(spark):
    cells = _cells(spark, 37, 29).select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("case_id"), "u", "v").where("case_id = 'a' or u < 5")
    for order in (F.xxhash64("u", "v"), F.lit(7).cast("long"), -F.col("u").cast("long")):
        for most in (1, 150, 400):
            got = [tuple(r) for r in segmentation.least_hashed(cells, order, most, ("case_id",)).collect()]
            ranked = {}
            for r in cells.withColumn("o", order).collect():
                ranked.setdefault(r["case_id"], []).append((r["o"], r["u"], r["v"]))
            assert sorted(got) == sorted((c, u, v) for c, x in ranked.items() for _, u, v in sorted(x)[:most])


def test_deep_holes_get_the_nearest_label(spark):
    rng = np.random.default_rng(5)
    rows = [("a", u, v, 0 if u < 30 else int(rng.integers(1, 4)), 25 <= u < 75 and 20 <= v < 70 or u > 95) for u in range(100) for v in range(90)] + [("b", u, 0, u % 3, u % 2 == 0) for u in range(9)]
    known = [r for r in rows if not r[4]]
    have = {r[:3] for r in known}
    rim = {r[:3] for r in known if not all((r[0], r[1] + i, r[2] + j) in have for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1)))}
    near = lambda r: min(((r[1] - k[1]) ** 2 + (r[2] - k[2]) ** 2, k[3]) for k in known if k[0] == r[0] and k[:3] in rim)
    want = {r[:3]: near(r)[1] if r[4] else r[3] for r in rows}
    marked = [(*r[:3], -1 if r[4] and near(r)[0] > segmentation.FILL_REACH**2 else want[r[:3]], r[:3] in rim) for r in rows]
    assert sum(r[3] == -1 for r in marked) > 500
    df = spark.createDataFrame(marked, "case_id string, u int, v int, label int, rim boolean")
    assert {(r["case_id"], r["u"], r["v"]): r["label"] for r in segmentation._fill(df, ("case_id",), segmentation.materialise).collect()} == want


def test_noise_is_measured_and_lines_keep_their_sides(spark):
    cells = _cells(spark, 60, 40).select(F.lit(1).alias("case_id"), "u", "v", *[F.lit(120).alias(c) for c in "rgb"])
    assert segmentation.noise_level(cells).first()["sigma"] == 0
    loud = raster.noisy(cells, 3, 5, ("case_id",))
    assert 4 < segmentation.noise_level(loud).first()["sigma"] < 20
    calm = segmentation.cleaned(loud, segmentation.SegmentParams())
    assert calm.agg(F.stddev("r")).first()[0] < 0.8 * loud.agg(F.stddev("r")).first()[0]


@pytest.mark.parametrize("kind", sorted(raster.DEGRADATIONS))
@pytest.mark.parametrize("severity", [1, 4])
def test_degradations_by_case(spark, kind, severity):
    line = F.col("u") == 9
    pixels = _cells(spark, 24, 18).select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("case_id"), "u", "v", *[F.when(line, 10).otherwise((F.col("u") * 7 + F.col("v") * k) % 256).cast("int").alias(c) for k, c in enumerate("rgb", 2)])
    more = {} if kind in ("blur", "fade") else {"seed": 4}
    more |= {"width": 24, "height": 18} if kind in raster.SIZED else {}
    run = lambda: {tuple(r) for r in raster.degrade(pixels, kind, severity, by=("case_id",), **more).collect()}
    once = run()
    assert len(once) == 2 * 24 * 18 and once == run() and all(0 <= c <= 255 for r in once for c in r[3:])
    assert {r[1:] for r in once if r[0] == "a"} != {tuple(r) for r in pixels.where("case_id = 'a'").drop("case_id").collect()}


def test_profiles_apply_one_after_the_other(spark):
    pixels = _cells(spark, 12, 10).select("u", "v", *[F.lit(100).alias(c) for c in "rgb"])
    out = raster.apply_profile(pixels, [("fade", 2), ("illumination", 1), ("stain", 1)], 12, 10, 3)
    assert out.count() == 120 and out.exceptAll(pixels).count() > 0
    assert raster.uneven_light(pixels, 2, 12, 10).agg(F.max("r"), F.min("r")).first()[:] != (100, 100)


# ---- constraints


def test_constraints_of_a_dipping_bed(spark):
    """One contact on a plane that dips 20 degrees to the east, a confirmed fault, deep points and a prior."""
    georef = GeoRef(200, 200, 0.0, 2000.0, 0.0, 2000.0)
    slope = math.tan(math.radians(20.0))
    x, y = georef.to_world(F.col("u"), F.col("v"))
    heights = generate.pixels(spark, 200, 200).select("u", "v", (900.0 - slope * x + 0.0 * y).alias("z"))
    units = spark.createDataFrame(
        [(0, "Top", "strata", 0, "S", None, None), (1, "Mid", "strata", 1, "S", None, None), (2, "Low", "strata", 2, "S", None, None), (3, "Base", "strata", 3, "S", None, None), (4, "Lake", "water", -1, None, None, None), (5, "New", "strata", -1, "S", None, None)],
        "unit_id int, name string, role string, `order` int, series string, dip double, azimuth double",
    )
    bow = [(7, k, 20.0 + 2.0 * k, 100.0 + 60.0 * math.sin(k / 12)) for k in range(80)]
    skip = [(8, 0, 10.0, 10.0), (8, 1, 190.0, 10.0)]
    contacts = spark.createDataFrame([(7, 0, 1), (8, 0, 2), (9, 0, 4)], "contact_id int, unit_a int, unit_b int")
    lines = spark.createDataFrame(bow + skip, "contact_id int, seq int, u double, v double")
    faults = spark.createDataFrame([(1, "F1", 60.0, 90.0)], "fault int, name string, dip double, azimuth double")
    trace = spark.createDataFrame([(1, 0, 60.0, 0.0), (1, 1, 60.0, 199.0), (2, 0, 0.0, 0.0), (2, 1, 199.0, 0.0)], "fault int, seq int, u double, v double")
    deep = spark.createDataFrame([(100.0 + 60 * (k % 6), 100.0 + 70 * (k // 6), 300.0 - slope * 60 * (k % 6), "Low") for k in range(24)] + [(5.0, 5.0, 5.0, "Nowhere")], "x double, y double, z double, formation string")
    params = builder.ConstraintParams(sample_step=6.0, z_margin=15.0, projection=(200.0,))
    made = builder.build_constraints(contacts, lines, units, faults, trace, heights, georef, (0.0, 1000.0), params=params, deep=deep)
    points, poses = made.points.collect(), made.orientations.collect()
    top = [r for r in points if r["formation"] == "Top" and r["src"] == 0]
    assert top and all(abs(r["x"] - 605.0) > 110 for r in top) and all(r["z"] == pytest.approx(max(15.0, 900.0 - slope * r["x"]), abs=0.2) for r in top)
    assert {r["formation"] for r in points} == {"Top", "Low", "F1"} and [r["contact_id"] for r in made.suspects.collect()] == [8]
    assert [r["name"] for r in made.unreviewed.collect()] == ["New"] and [r["formation"] for r in made.unknown.collect()] == ["Nowhere"]
    for r in poses:
        assert r["dip"] == pytest.approx(60.0 if r["formation"] == "F1" else 20.0, abs=1.0) and r["azimuth"] == pytest.approx(90.0, abs=3.0), r
    assert {r["formation"] for r in poses} == {"Top", "Low", "F1"} and sum(r["formation"] == "F1" for r in poses) == 2
    below = [r for r in points if r["src"] == 4]
    assert below and all(r["z"] >= 15.0 for r in below)
    deepest = {round(r["z"] - (900.0 - slope * 605.0)) for r in points if r["src"] == 3}
    assert deepest == {0, -130, -280, -430}
    config = made.config.first()
    assert [(s["name"], s["members"]) for s in config["series"]] == [("Fault_F1", ["F1"]), ("S", ["Top", "Low"])] and config["basement"] == "Base" and config["fault_series"] == ["Fault_F1"]
    prior = builder.build_constraints(contacts, lines, units, faults.limit(0), trace, heights, georef, (0.0, 1000.0), params=builder.ConstraintParams(sample_step=6.0, thickness_priors={"Mid": 100.0, "Low": 50.0}))
    z = {f: sorted(r["z"] for r in prior.points.where(F.col("formation") == f).collect()) for f in ("Top", "Mid", "Low")}
    assert len(z["Mid"]) == -(-len(z["Top"]) // 2) and len(z["Low"]) == -(-len(z["Mid"]) // 2)
    with pytest.raises(Exception, match="no surface point"):
        builder.build_constraints(contacts.limit(0), lines, units, faults.limit(0), trace, heights, georef, (0.0, 1000.0)).config.collect()


def test_picks_outside_the_frame_are_listed(spark):
    frame = SectionFrame(0.0, 0.0, 300.0, 400.0, 0.0, 100.0, 120, 70, 10.0, 10.0, 10.0, 10.0)
    picks = spark.createDataFrame([(10.0, 10.0, "A"), (110.0, 60.0, "B"), (111.0, 60.0, "C"), (None, 20.0, "D")], "u double, v double, formation string")
    good, bad = builder.picks_to_points(picks, frame)
    assert {tuple(r) for r in good.collect()} == {(0.0, 0.0, 100.0, "A"), (300.0, 400.0, 0.0, "B")} and {r["formation"] for r in bad.collect()} == {"C", "D"}


# ---- generators and files


def test_generated_cases(spark, tmp_path):
    georef = GeoRef(40, 40, 0.0, 2000.0, 0.0, 2000.0)
    names = {k: scenarios()[k] for k in ("base", "gentle_nofault")}
    generate.write_cases(spark, names, str(tmp_path), georef, Grid(10, 10, 10))
    maps = spark.read.parquet(f"{tmp_path}/map")
    assert {r["case_id"]: r["count"] for r in maps.groupBy("case_id").count().collect()} == {"base": 1600, "gentle_nofault": 1600}
    symbols = spark.read.parquet(f"{tmp_path}/dip_symbols").where("case_id = 'base'").collect()
    assert symbols and all(r["dip"] >= 1.0 and 0 <= r["azimuth"] < 360 and r["label"] < 5 for r in symbols)
    assert spark.read.parquet(f"{tmp_path}/fault_trace").where("case_id = 'base'").count() == 40
    points = generate.layer_points(spark, BASE, 12)
    assert points.count() > 100 and generate.layer_orientations(points, BASE).where("dip < 0 or dip > 90").isEmpty()
    plane = generate.fault_plane_points(spark, BASE, 10).collect()
    assert plane and all(r["x"] == pytest.approx(1150.0 + (500.0 - r["z"]) / math.tan(math.radians(65.0)), abs=0.02) for r in plane)


def test_places_lie_deep_inside_their_label(spark):
    cells = _cells(spark, 30, 20).select(F.lit(1).alias("case_id"), "u", "v", F.when((F.col("u") >= 3) & (F.col("u") < 14) & (F.col("v") >= 4) & (F.col("v") < 15), 1).when((F.col("u") > 24) & (F.col("v") < 3), 1).otherwise(0).alias("label"))
    found = {(r["label"], r["place_no"]): r for r in generate.label_places(cells, 2).collect()}
    assert (found[1, 1]["u"], found[1, 1]["v"], found[1, 1]["depth"]) == (8, 9, 6.0) and found[1, 2]["u"] > 24


def test_files_of_a_case(spark, tmp_path):
    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "scan.png").write_bytes(b"png")
    old = tmp_path / "cases" / "one"
    (old / "extract").mkdir(parents=True)
    (old / "extract" / "old.txt").write_text("x")
    staged = readers.stage_upload(spark, str(tmp_path / "up" / "scan.png"), str(old))
    assert staged.endswith("one/input/map.png") and not (old / "extract").exists() and (old / "input" / "map.png").read_bytes() == b"png"
    (tmp_path / "m.json").write_text('{"pixel_accuracy": 0.5, "voxel_3d": {"agreement": 0.25, "note": "x"}, "name": "n"}')
    assert {(r["metric"], r["value"]) for r in readers.metric_table(spark, str(tmp_path / "m.json")).collect()} == {("pixel_accuracy", 0.5), ("voxel_3d.agreement", 0.25)}
    shown = readers.gallery(spark, str(tmp_path / "cases"), spark.createDataFrame([("map.png",), ("none.png",)], "name string"))
    assert [(r["case_id"], r["name"]) for r in shown.collect()] == [("one", "map.png")]
    labels = _cells(spark, 3, 2).select(F.lit(1).alias("case_id"), "u", "v", F.lit(0).alias("label"))
    writers.write_extract(labels, spark.createDataFrame([(0, "A")], "unit_id int, name string"), f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out/labels").count() == 6
    assert spark.read.option("header", True).csv(f"{tmp_path}/out/units_auto").columns == ["unit_id", "name", "order", "series", "dip", "azimuth"]
