"""One map from its scan to its model: segmentation, lines, heights, constraints, voxels, requests.

Every step is an operator of its own that returns tables; run_case() only hands them on. Steps that stop short leave the later tables out.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import GeoRef
from .builder import ConstraintParams, build_constraints
from .contours import ContourParams, apply_elevations, extract_contours
from .graph import cut_lineage
from .grid import Grid
from .model import build_model, lith_names
from .requests import run_requests
from .review import merge_edits
from .segmentation import SegmentParams, segment_maps
from .vector import contacts, contours_to_dem, fault_candidates

#: Steps after which a run may stop.
STEPS = ("extract", "constraints", "model", "requests")


@dataclass(frozen=True)
class CaseParams:
    segment: SegmentParams = field(default_factory=SegmentParams)
    contour: ContourParams = field(default_factory=ContourParams)
    constraint: ConstraintParams = field(default_factory=ConstraintParams)
    contact_length: float = 25.0
    fault_length: float = 120.0
    grid_step: int = 4
    reach: float = 10.0
    grid: Grid | None = None


def vectorized(pixels: DataFrame, labels: DataFrame, params: CaseParams = CaseParams(), by: str = "case_id") -> tuple[DataFrame, DataFrame]:
    """Contacts (by, contact_id, unit_a, unit_b, seq, x, y) and fault candidates of maps; contacts are numbered in each map."""
    lines = contacts(labels, shortest=params.contact_length, by=(by,))
    number = F.dense_rank().over(Window.partitionBy(by).orderBy("unit_a", "unit_b", "line_no")) - 1
    return lines.withColumn("contact_id", number.cast("int")).drop("line_no"), fault_candidates(pixels, labels, by, shortest=params.fault_length)


def run_case(
    pixels: DataFrame, georef: GeoRef, z_range: tuple[float, float], review: DataFrame | None = None, elevations: DataFrame | None = None, faults: DataFrame | None = None, heights: DataFrame | None = None,
    params: CaseParams = CaseParams(), stop_after: str = "requests", legend: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """The tables of one case (pixels: case_id, u, v, r, g, b), up to a step.

    review: unit_id and columns of units to overwrite (name, role, order, series, dip, azimuth); without it units are strata in the order of their numbers. elevations:
    contour_id, elevation; heights (u, v, z) take the place of contours. faults: fault_id of confirmed candidates, with name, dip and azimuth.
    """
    if stop_after not in STEPS:
        raise ValueError(f"no step {stop_after}: one of {', '.join(STEPS)}")
    spark, cut = pixels.sparkSession, cut_lineage
    labels, units = segment_maps(pixels, params.segment, legend=legend)
    labels = cut(labels)
    units = units.select("unit_id", F.coalesce("name", F.format_string("unit_%d", "unit_id")).alias("name"), F.col("role_guess").alias("role"), F.col("unit_id").alias("order"), F.lit("Strat_Series").alias("series"), F.lit(None).cast("double").alias("dip"), F.lit(None).cast("double").alias("azimuth"))
    units = cut(merge_edits(units, review, "unit_id") if review is not None else units)
    lines, candidates = vectorized(pixels, labels, params)
    lines, candidates = cut(lines), cut(candidates)
    out = {"labels": labels, "units": units, "contacts": lines, "faults": candidates}
    if heights is None:
        found = extract_contours(pixels, params.contour)
        if elevations is not None:
            found = apply_elevations(found, elevations.withColumn("case_id", F.lit(pixels.first()["case_id"])))
        out["contours"] = found = cut(found)
        samples = found.select(F.col("elevation").alias("z"), F.explode("vertices").alias("p")).select("z", "p.x", "p.y")
        step = params.grid_step
        coarse = cut(contours_to_dem(samples, georef.img_w, georef.img_h, step, sum(z_range) / 2))
        # Each cell takes the height of the coarse cell that holds it.
        heights = labels.select("u", "v").withColumns({"_u": F.floor(F.col("u") / step), "_v": F.floor(F.col("v") / step)}).join(coarse.select(F.col("u").alias("_u"), F.col("v").alias("_v"), "z"), ["_u", "_v"]).select("u", "v", "z")
    out["heights"] = heights
    if stop_after == "extract":
        return out
    confirmed = candidates.join(faults.withColumnRenamed("dip", "_dip").withColumnRenamed("azimuth", "_az"), "fault_id").select(F.col("fault_id").alias("fault"), "name", F.col("_dip").alias("dip"), F.col("_az").alias("azimuth"), "vertices") if faults is not None else None
    empty = spark.createDataFrame([], "fault long, name string, dip double, azimuth double, vertices array<struct<x:double,y:double>>")
    confirmed = cut(confirmed if confirmed is not None else empty)
    traces = confirmed.select("fault", F.posexplode("vertices").alias("seq", "p")).select("fault", "seq", F.col("p.x").alias("u"), F.col("p.y").alias("v"))
    sides = lines.select("contact_id", "unit_a", "unit_b").distinct()
    vertices = lines.select("contact_id", "seq", F.col("x").alias("u"), F.col("y").alias("v"))
    grid = params.grid or Grid(50, 50, 50, georef.x0, georef.x1, georef.y0, georef.y1, *z_range)
    made = build_constraints(sides, vertices, units, confirmed.drop("vertices"), traces, heights, georef, z_range, (grid.nx, grid.ny, grid.nz), params.constraint)
    out |= {"points": made.points, "orientations": made.orientations, "stack": made.stack, "config": made.config}
    if stop_after == "constraints":
        return out
    series = [(r["name"], list(r["members"])) for r in made.config.first()["series"]]  # one row
    breaks = [m for name, members in series if name.startswith("Fault_") for m in members]
    stack = [x for x in series if not x[0].startswith("Fault_")]
    capital = lambda df: df.withColumnsRenamed({"x": "X", "y": "Y", "z": "Z"})
    voxels = cut(build_model(capital(made.points), capital(made.orientations), stack, grid, params.reach, faults=breaks))
    out["voxels"] = voxels
    out["lith_names"] = names = lith_names(voxels, stack, made.config.first()["basement"], breaks)
    if stop_after == "model":
        return out
    return out | run_requests(voxels, grid, names.select("lith_id", F.col("name").alias("unit")))
