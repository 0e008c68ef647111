"""Analytic models: counts, logs, sections and slices."""

import pytest
from pyspark.sql import functions as F

from terravane.operators import grid, requests
from terravane.operators.grid import AIR, Grid, scenarios

# Expected voxel counts for unit ids 0..5: all, and below ground.
COUNTS = {
    "base": ([33391, 12160, 13319, 14604, 14568, 36958], [5353, 5253, 10541, 14220, 14567, 36958]),
    "gentle_nofault": ([25873, 12500, 13760, 15000, 15000, 42867], [1796, 4482, 9784, 14230, 15000, 42867]),
    "steep_narrow": ([38482, 11945, 13155, 14311, 13490, 33617], [8852, 6804, 10554, 13666, 13406, 33617]),
    "high_relief": ([33391, 12160, 13319, 14604, 14568, 36958], [6578, 5703, 9841, 13575, 14465, 36956]),
    "flat_dem": ([33391, 12160, 13319, 14604, 14568, 36958], [5285, 7124, 9600, 13965, 14568, 36958]),
}
#: Cells of 20 x 10 x 10 metres.
LENS = Grid(24, 16, 20, 0.0, 480.0, 0.0, 160.0, -200.0, 0.0)


@pytest.mark.parametrize("name", sorted(COUNTS))
def test_scenario_counts(spark, name):
    rows = grid.truth_voxels(spark, scenarios()[name]).groupBy("lith_id").agg(F.count("*").alias("n"), F.count_if("below").alias("b")).orderBy("lith_id").collect()
    assert ([r["n"] for r in rows], [r["b"] for r in rows]) == COUNTS[name]


@pytest.fixture(scope="module")
def tilted(spark):
    """Five layers whose borders sink towards smaller x, one metre in four, and a lens of coal across them."""
    x, z = LENS.centre("x", F.col("i")), LENS.centre("z", F.col("k"))
    height = z + 0.25 * x
    lens = (x - 240) * (x - 240) / 10_000 + (z + 100) * (z + 100) / 625 <= 1
    unit = F.when(lens, 7).when(height > 60, 10).when(height > 20, 11).when(height > -40, 12).when(height > -110, 13).otherwise(14)
    return LENS.cells(spark).withColumn("lith_id", unit.cast("int")).cache()


@pytest.fixture(scope="module")
def called(spark):
    return spark.createDataFrame([(7, "Coal"), (10, "Sand"), (11, "Silt"), (12, "Clay"), (13, "Marl")], "lith_id int, unit string")


def _log(spark, tilted, called, x, ground=None):
    ask = spark.createDataFrame([("well", x, 75.0)], "name string, x double, y double")
    rows = grid.borehole(tilted, ask, LENS, called, ground).orderBy("seg_no").collect()
    assert all(r["thickness"] == pytest.approx(r["z_top"] - r["z_bottom"]) for r in rows)
    return [(r["unit"], r["z_top"], r["z_bottom"]) for r in rows]


def test_logs_of_a_tilted_lens(spark, tilted, called):
    # Columns with centres at 10 and 250; the oldest layer has no name.
    assert _log(spark, tilted, called, 3.0) == [("Clay", 0.0, -40.0), ("Marl", -40.0, -110.0), ("Unknown", -110.0, -200.0)]
    assert _log(spark, tilted, called, 259.0) == [("Silt", 0.0, -40.0), ("Clay", -40.0, -80.0), ("Coal", -80.0, -120.0), ("Marl", -120.0, -170.0), ("Unknown", -170.0, -200.0)]
    ground = LENS.columns(spark).withColumn("ground_z", F.lit(-60.43))
    assert _log(spark, tilted, called, 259.0, ground)[0] == ("Clay", -60.4, -80.0)
    with pytest.raises(Exception, match="outside the model"):
        _log(spark, tilted, called, 481.0)


def test_sections_through_the_lens(spark, tilted):
    along = grid.section(tilted, LENS, (0.0, 15.0), (480.0, 15.0), 97)
    assert along.count() == 97 * 20 and along.where("lith_id = 7").select("k").distinct().count() == 4
    assert grid.section(tilted, LENS, (250.0, 15.0), (0.0, 0.0), 1).where("lith_id = 7").count() == 4
    cuts = spark.createDataFrame([("a", 0.0, 15.0, 480.0, 15.0, 97), ("b", 250.0, 15.0, 0.0, 0.0, 1)], "name string, ax double, ay double, bx double, by double, n int")
    both = requests.sections(tilted, cuts, LENS)
    assert both.where("request = 'a'").drop("request").exceptAll(along).isEmpty() and both.where("request = 'b' and lith_id = 7").count() == 4


def test_slices_and_their_bounds(spark, tilted):
    assert grid.level_slice(tilted, LENS, -97.0).where("lith_id = 7").count() == 10 * 16
    assert {r["lith_id"] for r in grid.level_slice(tilted, LENS, 5000.0).collect()} == {10, 11, 12}
    ground = LENS.columns(spark).withColumn("ground_z", F.when(F.col("i") < 12, -150.0).otherwise(0.0))
    assert grid.level_slice(tilted, LENS, -50.0, ground).where(F.col("lith_id") == AIR).count() == 12 * 16
    asked = spark.createDataFrame([("s", -50.0), ("t", 5000.0)], "name string, z double")
    made = requests.level_slices(tilted, asked, LENS, ground)
    assert made.where(f"request = 's' and lith_id = {AIR}").count() == 12 * 16 and made.where("request = 't'").count() == 24 * 16
