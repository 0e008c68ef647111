"""Tracing, contacts, broken lines, faults and contour interpolation."""

import numpy as np
from pyspark.sql import functions as F

from terravane.operators import tiles, vector
from terravane.operators.grid import Grid, scenarios
from terravane.plans.tables import slice_cells


def test_trace_of_a_cross_and_a_ring():
    cross = np.array([(x, 20) for x in range(41)] + [(20, y) for y in range(41) if y != 20])
    lines = vector.trace_lines(cross, 10.0, 1.0)
    assert len(lines) == 4 and all(18 <= vector.path_length(p) <= 21 for p in lines)
    ring = np.array([(int(round(30 + 20 * np.cos(t))), int(round(30 + 20 * np.sin(t)))) for t in np.linspace(0, 2 * np.pi, 400)])
    (line,) = vector.trace_lines(np.unique(ring, axis=0), 10.0, 0.0)
    assert abs(vector.path_length(line) - 2 * np.pi * 20) < 25 and (line[0] == line[-1]).all()


def test_tiles_trace_what_one_task_does(spark):
    """Thick strokes, a ring, a loop at a junction and blots, over many tiles."""
    u, v = np.meshgrid(np.arange(400), np.arange(300), indexing="ij")
    mask = (np.abs(np.hypot(u - 150, v - 140) - 90) < 6) | (np.abs(v - 20 - u // 9) < 9) | ((np.abs(u - 300) < 25) & (v > 60)) | (np.abs(np.hypot(u - 345, v - 150) - 30) < 3) | (np.hypot(u - 40, v - 250) < 30)
    mask |= np.random.default_rng(1).random(mask.shape) < 0.01
    cells = np.argwhere(mask)
    rows = [(g, int(a) + d - 200, int(b)) for g, d in (("a", 0), ("b", 77)) for a, b in cells]
    df = spark.createDataFrame(rows, "case_id string, u int, v int")
    for shortest, tolerance in ((12.0, 0.0), (12.0, 1.5)):
        got = {}
        for r in vector.mask_to_lines(df, ["case_id"], shortest, tolerance, most=0).collect():
            got.setdefault((r["case_id"], r["line_no"]), []).append((r["seq"], r["x"], r["y"]))
        for g, d in (("a", 0), ("b", 77)):
            want = vector.trace_lines(cells + (d - 200, 0), shortest, tolerance)
            key = lambda p: min(tuple(map(tuple, p)), tuple(map(tuple, p[::-1])))
            lines = [[p[1:] for p in sorted(x)] for (case, _), x in got.items() if case == g]
            if tolerance == 0:
                assert sorted(map(key, lines)) == sorted(key(p.tolist()) for p in want)
            assert len(lines) == len(want) > 10


def test_sparse_tiles_are_worked_on_where_their_cells_are(spark):
    sizes = spark.sparkContext.accumulator(0)

    def run(arrays, have, row):
        sizes.add(have.size)
        return {"n": sum(tiles.shifted(have, i, j).astype(np.int32) for i in (-1, 0, 1) for j in (-1, 0, 1))}

    bars = [(u, v) for u in range(120, 150) for v in (3, 200)] + [(u, -129) for u in range(5)]
    got = {(r["u"], r["v"]): r["n"] for r in tiles.over_tiles(spark.createDataFrame([("a", *c) for c in bars], "case_id string, u int, v int"), ["case_id"], {}, 2, run, {"n": "int"}).collect()}
    assert got == {(u, v): sum((u + i, v + j) in bars for i in (-1, 0, 1) for j in (-1, 0, 1)) for u, v in bars}
    assert sizes.value < 5 * 200


def test_far_lines_have_numbers_of_their_own(spark):
    """Places that differ by 1 and 2^20 were one line."""
    rows = [("a", 5 + u, 0) for u in range(30)] + [("a", 4 + u, 1 << 20) for u in range(30)]
    got = {}
    for r in vector.mask_to_lines(spark.createDataFrame(rows, "case_id string, u int, v int"), ["case_id"], 15.0, 1.5, most=0).collect():
        got.setdefault(r["line_no"], []).append((r["x"], r["y"]))
    assert sorted(sorted(x) for x in got.values()) == [[(4.0, float(1 << 20)), (33.0, float(1 << 20))], [(5.0, 0.0), (34.0, 0.0)]]


def test_contacts_lie_between_their_units(spark):
    rows = vector.contacts(slice_cells(spark, 25), shortest=8.0).collect()
    labels = {(r["u"], r["v"]): r["label"] for r in slice_cells(spark, 25).collect()}
    assert rows
    for r in rows:
        around = {labels.get((int(r["x"]) + a, int(r["y"]) + b)) for a in (-2, -1, 0, 1, 2) for b in (-2, -1, 0, 1, 2)}
        assert {r["unit_a"], r["unit_b"]} <= around


def test_broken_lines_are_joined():
    lines = vector.join_broken([np.array([[0, 0], [10, 0]]), np.array([[30, 1], [15, 0.5]]), np.array([[12, 0], [12, 30]])], 8.0, 20.0)
    assert sorted(len(p) for p in lines) == [2, 4]


def test_fault_candidates(spark):
    cells = spark.range(200 * 60).select((F.col("id") % 200).cast("int").alias("u"), F.expr("cast(id div 200 as int)").alias("v"))
    thick = F.abs(F.col("v") - 30) <= 3
    thin = F.col("u") == 50
    shade = F.when(thick | thin, 10).otherwise(240)
    pixels = cells.select(F.lit("a").alias("case_id"), "u", "v", *[shade.alias(c) for c in "rgb"])
    labels = cells.select(F.lit("a").alias("case_id"), "u", "v", (F.col("u") >= 100).cast("int").alias("label"))
    (row,) = vector.fault_candidates(pixels, labels, "case_id").collect()
    assert row["length_px"] > 150 and row["straightness"] > 0.95 and row["n_units_crossed"] == 2


def test_contours_give_the_terrain_back(spark):
    grid, base = Grid(), scenarios()["base"]
    fine = spark.range(200 * 200).select((F.col("id") % 200).cast("int").alias("u"), F.expr("cast(id div 200 as int)").alias("v"))
    dem = fine.withColumn("z", base.dem((F.col("u") + 0.5) * 10.0, (F.col("v") + 0.5) * 10.0))
    from terravane.operators.raster import iso_crossings

    samples = iso_crossings(dem, 25.0).select(F.col("level").alias("z"), F.col("u").cast("double").alias("x"), F.col("v").cast("double").alias("y"))
    got = vector.contours_to_dem(samples, 200, 200, 4, 0.0, sigma=1.0)
    truth = dem.where("u % 4 = 0 and v % 4 = 0").select(F.expr("cast(u div 4 as int)").alias("u"), F.expr("cast(v div 4 as int)").alias("v"), F.col("z").alias("t"))
    error = got.join(truth, ["u", "v"]).agg(F.avg(F.abs(F.col("z") - F.col("t")))).first()[0]
    assert error < 5.0 and grid.nx == 50
    flat = vector.contours_to_dem(samples.where("z = 700"), 40, 40, 4, 123.0)
    assert {r["z"] for r in flat.collect()} == {123.0} and flat.count() == 100
