"""Potential-field models on planes and on an analytic fold."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terravane.operators import model
from terravane.operators.grid import Grid, scenarios, truth_voxels


def test_tilted_planes_are_exact():
    rng = np.random.default_rng(1)
    xy = rng.uniform(0, 1000, (40, 2))
    plane = lambda c: np.column_stack([xy, c - 0.2 * xy[:, 0] + 0.1 * xy[:, 1]])
    points = pd.concat([pd.DataFrame(plane(c), columns=list("XYZ")).assign(formation=f) for f, c in (("A", 700.0), ("B", 400.0))])
    dip = np.degrees(np.arctan(np.hypot(0.2, 0.1)))
    azimuth = np.degrees(np.arctan2(0.2, -0.1)) % 360
    poses = pd.DataFrame([(500.0, 500.0, 600.0, azimuth, dip)], columns=["X", "Y", "Z", "azimuth", "dip"])
    field = model.solve(points, poses, ["A", "B"], (0, 1000, 0, 1000, 0, 1000))
    at = rng.uniform(0, 1000, (300, 3))
    height = at[:, 2] + 0.2 * at[:, 0] - 0.1 * at[:, 1]
    clear = (np.abs(height - 700) > 8) & (np.abs(height - 400) > 8)
    assert (field.unit_index(at)[clear] == ((height < 700).astype(int) + (height < 400))[clear]).all()


def test_solver_needs_constraints():
    with pytest.raises(ValueError):
        model.solve(pd.DataFrame(columns=["X", "Y", "Z", "formation"]), pd.DataFrame(columns=["X", "Y", "Z", "azimuth", "dip"]), ["A"], (0, 1, 0, 1, 0, 1))


def test_fold_model_agrees_with_the_truth(spark):
    scenario, grid = scenarios()["gentle_nofault"], Grid(20, 20, 20)
    spots = spark.range(60).select((F.col("id") * 377 % 2000).cast("double").alias("X"), (F.col("id") * 613 % 2000).cast("double").alias("Y"))
    parts = [spots.withColumn("Z", scenario.bottom(i, F.col("X"), F.col("Y"))).withColumn("formation", F.lit(n)) for i, (n, _, _) in enumerate(scenario.layers)]
    points = parts[0]
    for p in parts[1:]:
        points = points.unionByName(p)
    from terravane.functions import dip_azimuth

    dip, azimuth = dip_azimuth(*scenario.gradient(F.col("X"), F.col("Y")))
    poses = points.where("formation in ('K2', 'P2')").select("X", "Y", "Z", azimuth.alias("azimuth"), dip.alias("dip"), "formation").where("dip > 1")
    got = model.build_model(points, poses, [("all", [n for n, _, _ in scenario.layers])], grid)
    both = got.join(truth_voxels(spark, scenario, grid).where("below").select("i", "j", "k", (F.col("lith_id") + 1).alias("truth")), ["i", "j", "k"])
    assert both.agg(F.avg((F.col("lith_id") == F.col("truth")).cast("double"))).first()[0] > 0.9


def test_a_fault_steps_the_layers(spark):
    """Flat layers, let down by 150 beyond a plane that dips 60 degrees to the east."""
    rng = np.random.default_rng(4)
    xy = rng.uniform(0, 1000, (80, 2))
    east = lambda x, z: x > 500 + (500 - z) / np.tan(np.radians(60.0))
    rows = []
    for name, height in (("A", 700.0), ("B", 400.0)):
        low = east(xy[:, 0], height - 150.0)
        real = low | ~east(xy[:, 0], height)  # between the two, the layer is missing
        rows.append(pd.DataFrame({"X": xy[:, 0], "Y": xy[:, 1], "Z": np.where(low, height - 150.0, height), "formation": name})[real])
    y, z = rng.uniform(0, 1000, 25), rng.uniform(0, 1000, 25)
    rows.append(pd.DataFrame({"X": 500 + (500 - z) / np.tan(np.radians(60.0)), "Y": y, "Z": z, "formation": "F1"}))
    points = spark.createDataFrame(pd.concat(rows))
    poses = spark.createDataFrame([(100.0, 500.0, 600.0, 90.0, 0.0, "A"), (900.0, 500.0, 500.0, 90.0, 0.0, "B"), (500.0, 500.0, 500.0, 90.0, 60.0, "F1")], "X double, Y double, Z double, azimuth double, dip double, formation string")
    grid, stack = Grid(16, 8, 20, 0, 1000, 0, 1000, 0, 1000), [("S", ["A", "B"])]
    x, z = grid.centre("x", F.col("i")), grid.centre("z", F.col("k"))
    drop = F.when(x > 500 + (500 - z) / float(np.tan(np.radians(60.0))), 150.0).otherwise(0.0)
    clear = (F.abs(x - 500 - (500 - z) / float(np.tan(np.radians(60.0)))) > 40) & (F.abs(z + drop - 700) > 30) & (F.abs(z + drop - 400) > 30)
    truth = grid.cells(spark).select("i", "j", "k", F.when(z + drop >= 700, "A").when(z + drop >= 400, "B").otherwise("deep").alias("gt"), clear.alias("below"))
    found = {r["reach"]: r["agreement"] for r in model.ablation(points, poses, stack, grid, truth, "deep", [10.0, 2.0], ["F1"]).collect()}
    assert set(found) == {10.0, 2.0} and min(found.values()) > 0.98
    plain = model.build_model(points.where("formation <> 'F1'"), poses.where("formation <> 'F1'"), stack, grid)
    assert plain.where("lith_id < 1 or lith_id > 3").isEmpty()
    cut = model.build_model(points, poses, stack, grid, faults=["F1"])
    assert {(r["lith_id"], r["name"]) for r in model.lith_names(cut, stack, "deep", ["F1"]).collect()} == {(2, "A"), (3, "B"), (4, "deep")}
