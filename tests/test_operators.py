"""Sequence, metric, spatial, raster and constraint operators on small fixtures."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terravane.functions import GeoRef, SectionFrame
from terravane.operators import constraints, graph, kernels, metrics, raster, review, sequences, spatial


def test_runs_with_nulls(spark):
    values = ["a", "a", None, None, "b", "a"]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "p int, o int, v string")
    rows = sequences.run_length_segments(df, ["p"], ["o"], "v").orderBy("run_no").collect()
    assert [(r["v"], r["n"]) for r in rows] == [("a", 2), (None, 2), ("b", 1), ("a", 1)]


@settings(max_examples=5, deadline=None)
@given(st.integers(1, 700))
def test_thinning_never_exceeds_its_bound(spark, n):
    df = spark.range(n).select(F.lit("f").alias("g"), "id")
    rows = sequences.stride_thin(df, ["g"], ["id"], 260).collect()
    assert len(rows) == len(range(0, n, -(-n // 260))) <= 260


def test_resample(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 10.0, 0.0), (1, 2, 10.0, 5.0), (2, 0, 3.0, 3.0), (3, 0, 1.0, 1.0), (3, 1, 1.0, 1.0)], "p int, o int, x double, y double")
    rows = sequences.resample(df, ["p"], ["o"], "x", "y", 5.0).orderBy("p", "seq").collect()
    assert [(r["p"], r["s"], r["x"], r["y"]) for r in rows] == [(1, 0.0, 0.0, 0.0), (1, 5.0, 5.0, 0.0), (1, 10.0, 10.0, 0.0), (1, 15.0, 10.0, 5.0), (2, 0.0, 3.0, 3.0), (3, 0.0, 1.0, 1.0)]


@pytest.mark.parametrize("n", [3, 4, 11, 12, 17, 18, 30])
def test_windows(spark, n):
    df = spark.range(n).select(F.lit(1).alias("p"), "id")
    got = {}
    for r in sequences.sliding_windows(df, ["p"], ["id"], 12, 4).collect():
        got.setdefault(r["window_no"], []).append(r["id"])
    want = {k: list(range(s, min(s + 12, n))) for k, s in enumerate(range(0, max(n - 12 + 1, 1), 6))} if n >= 4 else {}
    assert {k: sorted(v) for k, v in got.items()} == want


def _labels(spark):
    rng = np.random.default_rng(7)
    gt = np.array([[10 * (1 + (v >= 100) * 2 + (u >= 100)) for u in range(200)] for v in range(200)])
    pred = np.vectorize({10: 3, 20: 7, 30: 1, 40: 5}.get)(gt)
    flat = rng.choice(40000, 200, replace=False)
    pred.reshape(-1)[flat] = 9
    return spark.createDataFrame([(int(a), int(b)) for a, b in zip(gt.reshape(-1), pred.reshape(-1), strict=True)], "gt int, pred int")


def test_label_matching(spark):
    counts = metrics.confusion(_labels(spark), "gt", "pred").cache()
    assert counts.agg(F.sum("n")).first()[0] == 40000
    assert {r["pred"]: r["gt"] for r in metrics.match_labels(counts).collect()} == {3: 10, 7: 20, 1: 30, 5: 40}
    mapped = counts.join(metrics.match_labels(counts).select("pred", F.col("gt").alias("m")), "pred", "left").select("gt", F.coalesce("m", F.lit(-999)).alias("pred"), "n")
    total = metrics.overall(mapped).first()
    assert total["pixel_accuracy"] == pytest.approx(0.995) and total["macro_iou"] > 0.97


def test_agreement(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (2, 2), (3, 3)], "gt int, pred int")
    assert {r["gt"]: r["agreement"] for r in metrics.agreement(df, "gt", "pred").collect()} == {None: 0.75, 1: 1.0, 2: 0.5, 3: 1.0}


def test_boundary_tolerance(spark):
    edge = lambda at: raster.boundary_both(spark.range(60 * 200).select((F.col("id") % 200).cast("int").alias("u"), F.expr("cast(id div 200 as int)").alias("v")).withColumn("label", (F.col("u") >= at).cast("int"))).select("u", "v")
    assert metrics.boundary_scores(edge(102), edge(100), 3).first()["f1"] > 0.99
    assert metrics.boundary_scores(edge(102), edge(100), 0).first()["f1"] < 0.5
    empty = edge(100).where("false")
    assert metrics.boundary_scores(empty, empty, 3).first()["f1"] == 1.0 and metrics.boundary_scores(empty, edge(100), 3).first()["f1"] == 0.0


def test_section_frame(spark):
    frame = SectionFrame(100, 200, 1900, 1700, 0, 1000, 900, 600, 80, 40, 50, 60)
    assert frame.length == pytest.approx(math.hypot(1800, 1500))
    corners = spark.createDataFrame([(80.0, 50.0), (80.0, 540.0), (860.0, 50.0), (860.0, 540.0), (79.0, 50.0)], "u double, v double")
    x, y, z = frame.to_world(F.col("u"), F.col("v"))
    rows = corners.select(x.alias("x"), y.alias("y"), z.alias("z"), frame.inside(F.col("u"), F.col("v")).alias("in")).collect()
    assert [tuple(r)[:3] for r in rows[:4]] == [(100, 200, 1000), (100, 200, 0), (1900, 1700, 1000), (1900, 1700, 0)]
    assert [r["in"] for r in rows] == [True] * 4 + [False]
    assert SectionFrame.from_dict(frame.to_dict()) == frame and GeoRef.from_dict(GeoRef(10, 10, 0, 1, 0, 1).to_dict()) == GeoRef(10, 10, 0, 1, 0, 1)
    with pytest.raises(ValueError):
        SectionFrame(0, 0, 1, 1, 0, 1, 100, 100, 60, 60, 0, 0)


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 6), st.integers(1, 6), st.integers(0, 10**6))
def test_assignment_is_optimal(n, m, seed):
    from itertools import permutations

    cost = np.random.default_rng(seed).integers(-9, 9, (n, m)).astype(float)
    rows, cols = kernels.assign_min_cost(cost)
    small, large = (cost, m) if n <= m else (cost.T, n)
    best = min(sum(small[i, p[i]] for i in range(len(small))) for p in permutations(range(large), len(small)))
    assert cost[rows, cols].sum() == best and len(rows) == min(n, m)


def test_plane_fit(spark):
    rng = np.random.default_rng(3)
    p = rng.uniform(0, 100, (60, 2))
    z = 0.3 * p[:, 0] - 0.2 * p[:, 1] + 7
    df = spark.createDataFrame([("f", float(a), float(b), float(c)) for (a, b), c in zip(p, z, strict=True)] + [("line", float(i), float(i), float(i)) for i in range(5)], "f string, x double, y double, z double")
    rows = {r["f"]: r for r in constraints.plane_fit(df, ["f"]).collect()}
    assert rows["f"]["a"] == pytest.approx(0.3) and rows["f"]["b"] == pytest.approx(-0.2) and rows["f"]["rms"] == pytest.approx(0, abs=1e-5)
    assert rows["line"]["a"] is None
    xy = p - p.mean(0)
    assert rows["f"]["spread"] == pytest.approx(np.linalg.svd(xy, compute_uv=False)[1])


def test_components_of_a_long_path(spark):
    df = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")).unionByName(spark.createDataFrame([(1000, 1001), (1005, 1001)], "u long, v long"))
    found = {r["node"]: r["component"] for r in graph.components(df).collect()}
    assert {found[n] for n in range(301)} == {0} and found[1005] == found[1001] == 1000


def test_mutual_links(spark):
    rows = [(1, 0, 2, 1.0), (2, 0, 1, 1.0), (2, 0, 3, 2.0), (3, 0, 2, 2.0), (3, 1, 4, 1.0), (4, 0, 3, 1.0)]
    df = spark.createDataFrame(rows, "node long, side int, other long, dist double")
    assert {(r["a"], r["b"]) for r in graph.mutual_best(df).collect()} == {(1, 2), (3, 4)}


def test_simplify_and_linkage_and_thinning():
    line = np.array([[0, 0], [1, 0.05], [2, 0], [3, 5], [4, 0]], float)
    assert kernels.simplify(line, 0.5).tolist() == [0, 2, 3, 4]
    assert kernels.average_linkage(np.array([[0.0], [1.0], [10.0], [11.0]]), 5.0).tolist() == [0, 0, 1, 1]
    mask = np.zeros((9, 20), bool)
    mask[3:6, 2:18] = True
    bone = kernels.thin(mask)
    assert bone.sum() < mask.sum() / 2 and bone[4, 5:15].all()


def test_fill_and_median(spark):
    cells = spark.createDataFrame([(0, 0, 5, False), (1, 0, 0, True), (2, 0, 0, True), (3, 0, 7, False)], "u int, v int, label int, hole boolean")
    assert {(r["u"], r["label"]) for r in raster.nearest_fill(cells).collect()} == {(0, 5), (1, 5), (2, 7), (3, 7)}
    noise = spark.range(25).select((F.col("id") % 5).cast("int").alias("u"), F.expr("cast(id div 5 as int)").alias("v")).withColumn("label", F.when((F.col("u") == 2) & (F.col("v") == 2), 9).otherwise(1))
    assert {r["label"] for r in raster.median_filter(noise, 1).collect()} == {1}


def test_fill_of_deep_holes(spark):
    known = {(0, 0): 5, (150, 3): 7, (20, 170): 2, (21, 170): 2, **{(u, v): 3 for u in range(30, 36) for v in range(40, 46)}, (900, 900): 4}
    holes = [(u, v) for u in range(0, 200, 7) for v in range(0, 200, 9) if (u, v) not in known] + [(400, 500)]
    rows = [(u, v, x, False) for (u, v), x in known.items()] + [(u, v, 0, True) for u, v in holes]
    cells = spark.createDataFrame(rows, "u int, v int, label int, hole boolean")
    found = {(r["u"], r["v"]): r["label"] for r in raster.nearest_fill(cells).collect()}
    assert len(found) == len(rows)
    for u, v in holes:
        assert found[u, v] == min(((u - a) ** 2 + (v - b) ** 2, x) for (a, b), x in known.items())[1]
    assert {r["label"] for r in raster.nearest_fill(cells.where("hole")).collect()} == {None}


@pytest.mark.parametrize("kind", ["noise", "blur", "fade", "line_break"])
def test_degradations(spark, kind):
    pixels = spark.range(40 * 30).select((F.col("id") % 40).cast("int").alias("u"), F.expr("cast(id div 40 as int)").alias("v"))
    line = F.col("u") == 20
    pixels = pixels.select("u", "v", *[F.when(line, 10).otherwise((F.col("u") * 3 + F.col("v") * k) % 256).cast("int").alias(c) for k, c in enumerate("rgb")])
    kinds = {"noise": {"seed": 4}}.get(kind, {})
    once = {tuple(r) for r in raster.degrade(pixels, kind, 2, **kinds).collect()}
    assert len(once) == 1200 and once == {tuple(r) for r in raster.degrade(pixels, kind, 2, **kinds).collect()}
    assert once != {tuple(r) for r in pixels.collect()} and all(0 <= c <= 255 for r in once for c in r[2:])


def test_merge_and_append(spark):
    base = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "name string, unit_id long, role string")
    edits = spark.createDataFrame([("a", None), ("b", "z")], "name string, role string")
    assert {tuple(r) for r in review.merge_edits(base, edits, "name").collect()} == {("a", 1, "x"), ("b", 2, "z")}
    more = spark.createDataFrame([("b",), ("c",), ("d",)], "name string")
    assert {(r["name"], r["unit_id"]) for r in review.append_missing(base, more, "name", "unit_id").collect()} == {("a", 1), ("b", 2), ("c", -100), ("d", -101)}


def test_distance_join_is_an_equi_join(spark):
    points = spark.range(2000).select("id", (F.col("id") * 37 % 1009).cast("double").alias("x"), (F.col("id") * 61 % 1013).cast("double").alias("y"))
    plan = spatial.pairs_within(points, 5.0, "id")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_distance_join_broadcasts_no_side(spark, tmp_path):
    # a file of few bytes whose rows fill a driver once they stand in nine cells
    spark.range(200_000).select("id", (F.col("id") % 50).cast("double").alias("x"), (F.col("id") % 997).cast("double").alias("y")).write.parquet(f"{tmp_path}/points")
    points = spark.read.parquet(f"{tmp_path}/points")
    assert "BroadcastHashJoin" not in spatial.pairs_within(points, 2.0, "id")._jdf.queryExecution().executedPlan().toString()


def test_nearest_of_dense_targets(spark, monkeypatch):
    rng = np.random.default_rng(3)
    left, right = rng.uniform(0, 40, (300, 2)), np.vstack([rng.uniform(0, 30, (600, 2)), rng.uniform(0, 44, (20, 2))])
    right = np.vstack([right, right[:50]])  # copies with larger ids
    monkeypatch.setattr(spatial, "CELL_TARGETS", 8)
    joined, whole = [], spatial.within
    monkeypatch.setattr(spatial, "within", lambda *a, **k: joined.append(whole(*a, **k)) or joined[-1])
    frame = lambda xy, name: spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xy)], f"{name} long, x double, y double")
    got = {r["a"]: (r["b"], round(r["dist"], 9)) for r in spatial.nearest_within(frame(left, "a"), frame(right, "b"), 10.0, "a", "b").collect()}
    away = np.sqrt(((left[:, None] - right[None]) ** 2).sum(2))
    assert got == {i: (int(d.argmin()), round(float(d.min()), 9)) for i, d in enumerate(away) if d.min() <= 10.0}
    assert len(joined) > 1 and sum(j.count() for j in joined) < (away <= 10.0).sum() / 4


def test_thickness_and_fault_points(spark):
    points = spark.createDataFrame([(i, float(i), 0.0, 100.0 + i, "K1") for i in range(5)], "seq long, x double, y double, z double, formation string")
    assert [r["z"] for r in constraints.thickness_prior(points, "P1", "K1", 50.0, 10.0).orderBy("seq").collect()] == [50.0, 52.0, 54.0]
    assert constraints.thickness_prior(points, "K1", "K1", 50.0, 10.0).count() == 0
    deep = constraints.fault_points(points, 45.0, 90.0, [130.0, 430.0], -1000.0, 500.0)
    assert deep.count() == 5 + 2 and deep.where("dz > 0").orderBy("seq").first()["x"] == pytest.approx(130.0)
