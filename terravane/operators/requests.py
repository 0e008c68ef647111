"""Batches of questions to voxel models: logs, sections and level slices, each from a table of requests, in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import clamp
from .grid import AIR, Grid, borehole


def auto_requests(spark: SparkSession, grid: Grid) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The standard questions to a model: three boreholes (name, x, y), one section (name, ax, ay, bx, by, n) and two slices (name, z), placed by fractions of its extent."""
    w, h, d = grid.x1 - grid.x0, grid.y1 - grid.y0, grid.z1 - grid.z0
    # The fractions and the margin of the section's ends.
    holes = [(f"borehole_{k}", grid.x0 + a * w, grid.y0 + b * h) for k, (a, b) in enumerate(((0.3, 0.4), (0.62, 0.55), (0.8, 0.75)), 1)]
    cuts = [("section_1", grid.x0 + 50.0, grid.y0 + 0.35 * h, grid.x1 - 50.0, grid.y0 + 0.75 * h, 500)]
    levels = [(f"slice_{k}", grid.z0 + f * d) for k, f in enumerate((0.45, 0.65), 1)]
    return (
        spark.createDataFrame(holes, "name string, x double, y double"),
        spark.createDataFrame(cuts, "name string, ax double, ay double, bx double, by double, n int"),
        spark.createDataFrame(levels, "name string, z double"),
    )


def _aired(cells: DataFrame, grid: Grid, ground: DataFrame | None) -> DataFrame:
    if ground is None:
        return cells
    above = grid.centre("z", F.col("k")) > F.col("ground_z")
    return cells.join(ground.select("i", "j", "ground_z"), ["i", "j"], "left").withColumn("lith_id", F.when(above, AIR).otherwise(F.col("lith_id")))


def sections(voxels: DataFrame, requests: DataFrame, grid: Grid, ground: DataFrame | None = None) -> DataFrame:
    """request, sample, k, lith_id (AIR above the ground) of n evenly spaced columns from (ax, ay) to (bx, by), ends included."""
    dx, dy, _ = grid.steps
    t = F.col("sample") / F.greatest(F.col("n") - 1, F.lit(1))
    spot = requests.select(F.col("name").alias("request"), "ax", "ay", "bx", "by", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("sample")).select(
        "request", F.col("sample").cast("int").alias("sample"),
        clamp(F.floor((F.col("ax") + t * (F.col("bx") - F.col("ax")) - grid.x0) / dx), 0, grid.nx - 1).cast("int").alias("i"),
        clamp(F.floor((F.col("ay") + t * (F.col("by") - F.col("ay")) - grid.y0) / dy), 0, grid.ny - 1).cast("int").alias("j"),
    )
    return _aired(voxels.select("i", "j", "k", "lith_id").join(spot, ["i", "j"]), grid, ground).select("request", "sample", "k", "lith_id")


def level_slices(voxels: DataFrame, requests: DataFrame, grid: Grid, ground: DataFrame | None = None) -> DataFrame:
    """request, i, j, lith_id (AIR above the ground) of the cells at each height; heights outside the grid take its nearest layer."""
    k = clamp(F.floor((F.col("z") - grid.z0) / grid.steps[2]), 0, grid.nz - 1).cast("int")
    asked = requests.select(F.col("name").alias("request"), k.alias("k"))
    return _aired(voxels.select("i", "j", "k", "lith_id").join(asked, "k"), grid, ground).select("request", "i", "j", "lith_id")


def run_requests(voxels: DataFrame, grid: Grid, names: DataFrame, ground: DataFrame | None = None, asked: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Logs, sections and slices of all requests (the standard ones if none are given)."""
    holes, cuts, levels = asked or auto_requests(voxels.sparkSession, grid)
    return {"boreholes": borehole(voxels, holes, grid, names, ground), "sections": sections(voxels, cuts, grid, ground), "slices": level_slices(voxels, levels, grid, ground)}
