"""Analytic scenarios, voxel grids and the queries on them: logs, sections, slices."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import clamp
from .sequences import run_length_segments

AIR = -9999


@dataclass(frozen=True)
class Scenario:
    """A synthetic block of layers: regional dip, two folds, one normal fault, analytic terrain."""

    name: str = "base"
    # Layer names, base heights and colours, young to old; the basement; and all default parameters.
    layers: tuple = (("N1", 780.0, (250, 240, 190)), ("K2", 680.0, (205, 225, 145)), ("K1", 570.0, (150, 200, 120)), ("P2", 450.0, (240, 165, 120)), ("P1", 330.0, (215, 125, 95)))
    basement: tuple = ("S1", (125, 185, 175))
    world: tuple = (0.0, 2000.0, 0.0, 2000.0)
    z_range: tuple = (0.0, 1000.0)
    regional_dip: float = 6.0
    x_center: float = 1000.0
    fold_amp: float = 90.0
    fold_wavelength: float = 1150.0
    fold_phase: float = 350.0
    cross_amp: float = 35.0
    cross_wavelength: float = 1600.0
    cross_phase: float = 250.0
    fault: tuple | None = (1150.0, 500.0, 65.0, 140.0)  # x at the reference height, that height, dip, throw
    dem_base: float = 700.0
    dem_amps: tuple = (110.0, 75.0, 45.0)
    dem_waves: tuple = (1700.0, 1300.0, 2100.0)
    flat: bool = False

    @property
    def slope(self) -> float:
        return -math.tan(math.radians(self.regional_dip))

    def units(self) -> list[tuple[int, str, tuple]]:
        return [(i, n, c) for i, (n, _, c) in enumerate(self.layers)] + [(len(self.layers), *self.basement)]

    def fold(self, x: Column, y: Column) -> Column:
        return self.fold_amp * F.cos(2.0 * math.pi * (x - self.fold_phase) / self.fold_wavelength) + self.cross_amp * F.cos(2.0 * math.pi * (y - self.cross_phase) / self.cross_wavelength)

    def fault_x(self, z: Column) -> Column:
        """Where the fault plane is at a height; beyond all points without a fault."""
        if self.fault is None:
            return F.lit(float("inf"))
        x, z0, dip, _ = self.fault
        return x + (z0 - z) / math.tan(math.radians(dip))

    def drop(self, x: Column, z: Column) -> Column:
        return F.when(x > self.fault_x(z), self.fault[3]).otherwise(0.0) if self.fault else F.lit(0.0)

    def unit_id(self, x: Column, y: Column, z: Column) -> Column:
        """The youngest layer whose base is not above the point, else the basement."""
        rise = self.slope * (x - self.x_center) + self.fold(x, y) - self.drop(x, z)
        out = F
        for i, (_, base, _) in enumerate(self.layers):
            out = out.when(z >= base + rise, i)
        return out.otherwise(len(self.layers)).cast("int")

    def bottom(self, layer: int, x: Column, y: Column) -> Column:
        """Height of a layer's base, on the side of the fault where the undisturbed base lies."""
        before = self.layers[layer][1] + self.slope * (x - self.x_center) + self.fold(x, y)
        return before - self.drop(x, before)

    def gradient(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Slopes of a layer's base along x and y."""
        a = 2.0 * math.pi / self.fold_wavelength
        b = 2.0 * math.pi / self.cross_wavelength
        return self.slope - self.fold_amp * a * F.sin(a * (x - self.fold_phase)), -self.cross_amp * b * F.sin(b * (y - self.cross_phase))

    def dem(self, x: Column, y: Column) -> Column:
        """Terrain height; a flat terrain has no hills, valley or bounds."""
        if self.flat:
            return F.lit(self.dem_base)
        (a1, a2, a3), (w1, w2, w3), tau = self.dem_amps, self.dem_waves, 2.0 * math.pi
        z = self.dem_base + a1 * F.sin(tau * x / w1) + a2 * F.cos(tau * y / w2) + a3 * F.sin(tau * (x + 0.6 * y) / w3) + 25.0 * F.cos(tau * x / 600.0) * F.sin(tau * y / 800.0)
        if self.fault:
            z = z - 45.0 * F.exp(-((x - self.fault[0]) * (x - self.fault[0])) / (2.0 * 180.0 * 180.0))
        return clamp(z, self.z_range[0] + 80.0, self.z_range[1] - 40.0)


def scenarios() -> dict[str, Scenario]:
    """The six built-in scenarios."""
    base = Scenario()
    # What each scenario changes.
    near = (("N1", 780.0, (247, 239, 196)), ("K2", 680.0, (196, 219, 148)), ("K1", 570.0, (176, 208, 142)), ("P2", 450.0, (238, 168, 122)), ("P1", 330.0, (228, 148, 108)))
    changes = {
        "base": {},
        "gentle_nofault": {"fault": None, "fold_amp": 55.0, "regional_dip": 4.0},
        "steep_narrow": {"fold_amp": 130.0, "fold_wavelength": 750.0, "regional_dip": 8.0, "fault": (1050.0, 500.0, 60.0, 190.0)},
        "similar_colors": {"layers": near},
        "high_relief": {"dem_amps": (170.0, 110.0, 60.0)},
        "flat_dem": {"flat": True},
    }
    return {k: replace(base, name=k, **v) for k, v in changes.items()}


@dataclass(frozen=True)
class Grid:
    """Cell counts and world bounds of a voxel grid; k counts upwards."""

    nx: int = 50
    ny: int = 50
    nz: int = 50
    x0: float = 0.0
    x1: float = 2000.0
    y0: float = 0.0
    y1: float = 2000.0
    z0: float = 0.0
    z1: float = 1000.0

    @property
    def steps(self) -> tuple[float, float, float]:
        return (self.x1 - self.x0) / self.nx, (self.y1 - self.y0) / self.ny, (self.z1 - self.z0) / self.nz

    def centre(self, axis: str, index: Column) -> Column:
        at = "xyz".index(axis)
        return (self.x0, self.y0, self.z0)[at] + (index + 0.5) * self.steps[at]

    def cells(self, spark: SparkSession) -> DataFrame:
        """i, j, k of all cells, generated from one range, so that no join is needed and rows spread evenly."""
        n = F.col("id")
        return spark.range(self.nx * self.ny * self.nz).select(
            F.expr(f"cast(id div {self.ny * self.nz} as int)").alias("i"), F.expr(f"cast((id div {self.nz}) % {self.ny} as int)").alias("j"), (n % self.nz).cast("int").alias("k")
        )

    def columns(self, spark: SparkSession) -> DataFrame:
        return spark.range(self.nx * self.ny).select(F.expr(f"cast(id div {self.ny} as int)").alias("i"), (F.col("id") % self.ny).cast("int").alias("j"))


def truth_voxels(spark: SparkSession, scenario: Scenario, grid: Grid = Grid()) -> DataFrame:
    """i, j, k, lith_id and below (the cell's centre is not above the terrain)."""
    x, y, z = (grid.centre(a, F.col(c)) for a, c in zip("xyz", "ijk", strict=True))
    return grid.cells(spark).select("i", "j", "k", scenario.unit_id(x, y, z).alias("lith_id"), (z <= scenario.dem(x, y)).alias("below"))


def surface(spark: SparkSession, scenario: Scenario, grid: Grid = Grid()) -> DataFrame:
    """Terrain height of each column, sampled at evenly spaced nodes that include the bounds."""
    x = grid.x0 + F.col("i") * ((grid.x1 - grid.x0) / (grid.nx - 1))
    y = grid.y0 + F.col("j") * ((grid.y1 - grid.y0) / (grid.ny - 1))
    return grid.columns(spark).select("i", "j", scenario.dem(x, y).alias("ground_z"))


def borehole(voxels: DataFrame, requests: DataFrame, grid: Grid, names: DataFrame, ground: DataFrame | None = None) -> DataFrame:
    """Logs of all requests (name, x, y): request, seg_no, unit, z_top, z_bottom, thickness, from the ground down.

    A request outside the grid raises an error. The first interval is cut to the ground height, rounded to one decimal.
    """
    dx, dy, dz = grid.steps
    good = F.col("x").between(grid.x0, grid.x1) & F.col("y").between(grid.y0, grid.y1)
    ask = requests.select(
        F.col("name").alias("request"),
        F.when(good, F.least(F.floor((F.col("x") - grid.x0) / dx), F.lit(grid.nx - 1))).otherwise(F.raise_error(F.lit("borehole outside the model"))).cast("int").alias("i"),
        F.least(F.floor((F.col("y") - grid.y0) / dy), F.lit(grid.ny - 1)).cast("int").alias("j"),
    )
    cells = voxels.select("i", "j", "k", "lith_id").join(ask, ["i", "j"])
    if ground is None:
        cells = cells.withColumn("ground_z", F.lit(None).cast("double"))
    else:
        start = F.greatest(F.lit(0), F.least(F.floor((F.col("ground_z") - grid.z0) / dz), F.lit(grid.nz - 1)))
        cells = cells.join(ground, ["i", "j"], "left").where(F.col("k") <= F.coalesce(start, F.lit(grid.nz - 1)))
    cells = cells.withColumn("down", -F.col("k"))
    runs = run_length_segments(cells, ["request", "ground_z"], ["down"], "lith_id")
    depth = cells.groupBy("request").agg(F.max("k").alias("k0"))
    out = runs.join(depth, "request").join(names, "lith_id", "left")
    top = grid.z0 + (F.col("k0") - F.col("first_pos") + 2) * dz
    cut = F.when((F.col("run_no") == 1) & F.col("ground_z").isNotNull(), F.least(top, F.bround("ground_z", 1))).otherwise(top)
    bottom = grid.z0 + (F.col("k0") - F.col("last_pos") + 1) * dz
    return out.select("request", F.col("run_no").alias("seg_no"), F.coalesce("unit", F.lit("Unknown")).alias("unit"), cut.alias("z_top"), bottom.alias("z_bottom"), (cut - bottom).alias("thickness"))


def section(voxels: DataFrame, grid: Grid, a: tuple, b: tuple, n: int, ground: DataFrame | None = None) -> DataFrame:
    """n evenly spaced columns from a to b, ends included: sample, k, lith_id (AIR above the ground)."""
    dx, dy, dz = grid.steps
    t = F.col("sample") / max(n - 1, 1)
    samples = voxels.sparkSession.range(n).select(F.col("id").cast("int").alias("sample")).select(
        "sample",
        clamp(F.floor((a[0] + t * (b[0] - a[0]) - grid.x0) / dx), 0, grid.nx - 1).cast("int").alias("i"),
        clamp(F.floor((a[1] + t * (b[1] - a[1]) - grid.y0) / dy), 0, grid.ny - 1).cast("int").alias("j"),
    )
    out = voxels.select("i", "j", "k", "lith_id").join(samples, ["i", "j"])
    return out.select("sample", "k", "lith_id") if ground is None else _aired(out, grid, ground).select("sample", "k", "lith_id")


def level_slice(voxels: DataFrame, grid: Grid, z: float, ground: DataFrame | None = None) -> DataFrame:
    """The layer of cells at a height (the nearest layer outside the grid): i, j, lith_id (AIR above the ground)."""
    k = min(max(math.floor((z - grid.z0) / grid.steps[2]), 0), grid.nz - 1)
    out = voxels.where(F.col("k") == k).select("i", "j", "k", "lith_id")
    return (out if ground is None else _aired(out, grid, ground)).select("i", "j", "lith_id")


def _aired(cells: DataFrame, grid: Grid, ground: DataFrame) -> DataFrame:
    above = grid.centre("z", F.col("k")) > F.col("ground_z")
    return cells.join(ground, ["i", "j"], "left").withColumn("lith_id", F.when(above, AIR).otherwise(F.col("lith_id")))
