"""The constraint tables of a map: surface points, orientations and the stack of series, from contacts, units, faults and heights.

Points have an order key (src, part, seq) of their own: 0 contacts (part: contact, seq: place along it), 1 deep points,
2 thickness priors, 3 faults, 4 projections. Nothing depends on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import GeoRef, SectionFrame, clamp
from .constraints import contact_formation, credible, downdip_projection, plane_fit, spaced_best
from .graph import cut_lineage
from .sequences import every_nth, number, pick_at, resample, sliding_windows, stride_thin
from .spatial import bilinear, within

POINTS = ("src", "part", "seq", "x", "y", "z", "formation")
READINGS = ("x", "y", "z", "azimuth", "dip", "polarity", "formation")


@dataclass(frozen=True)
class ConstraintParams:
    # The default thresholds.
    sample_step: float = 16.0
    fault_buffer: float = 12.0
    per_formation: int = 3
    fit_points: int = 10
    min_relief: float = 10.0
    min_dip: float = 1.5
    max_dip: float = 88.0
    default_dip: float | None = None
    default_azimuth: float | None = None
    max_points: int = 260
    fault_offsets: tuple = (130.0, 280.0, 430.0)
    z_margin: float = 15.0
    thickness_priors: dict = field(default_factory=dict)
    projection: tuple = ()
    projection_radius: float = 650.0
    spacing: float = 250.0
    neighbours: int = 14
    hidden_fits: int = 2


def picks_to_points(picks: DataFrame, frame: SectionFrame) -> tuple[DataFrame, DataFrame]:
    """World points (x, y, z, formation, rounded) of section picks (u, v, formation) inside the frame, and the picks that are not."""
    u, v = F.col("u").cast("double"), F.col("v").cast("double")
    inside = F.coalesce(frame.inside(u, v), F.lit(False))
    x, y, z = frame.to_world(u, v)
    good = picks.where(inside).select(F.bround(x, 2).alias("x"), F.bround(y, 2).alias("y"), F.bround(z, 2).alias("z"), "formation")
    return good, picks.where(~inside)


def readings_on_strata(readings: DataFrame, labels: DataFrame, heights: DataFrame, units: DataFrame, georef: GeoRef) -> DataFrame:
    """Orientations of pixel readings (u, v, dip, azimuth) that stand on a stratum. Readings beyond the image take its nearest cell's unit and height."""
    cell = lambda c, n: clamp(F.col(c), 0, n - 1).cast("int")
    asked = readings.select("dip", "azimuth", F.col("u").cast("double").alias("pu"), F.col("v").cast("double").alias("pv")).withColumn("u", cell("pu", georef.img_w)).withColumn("v", cell("pv", georef.img_h))
    strata = units.where("role = 'strata'").select(F.col("unit_id").alias("label"), F.col("name").alias("formation"))
    x, y = georef.to_world(F.col("pu"), F.col("pv"))
    found = asked.join(labels.select("u", "v", "label"), ["u", "v"]).join(strata, "label").join(heights.select("u", "v", "z"), ["u", "v"])
    return found.select(x.alias("x"), y.alias("y"), F.col("z").cast("double").alias("z"), F.col("azimuth").cast("double").alias("azimuth"), F.col("dip").cast("double").alias("dip"), F.lit(1).alias("polarity"), "formation")


def fault_distance(points: DataFrame, faults: DataFrame, reach: float, step: float = 0.5) -> DataFrame:
    """id and the distance to the nearest fault line (fault, seq, u, v), for points (id, u, v) within reach of one."""
    line = resample(faults, ["fault"], ["seq"], "u", "v", step)
    near = within(points.select("id", F.col("u").alias("x"), F.col("v").alias("y")), line.select("x", "y"), reach)
    return near.groupBy(F.col("l.id").alias("id")).agg(F.min("dist").alias("fault_dist"))


def contact_points(contacts: DataFrame, kinds: DataFrame, faults: DataFrame, heights: DataFrame, georef: GeoRef, z_range: tuple[float, float], params: ConstraintParams) -> DataFrame:
    """Points along contacts (contact_id, seq, u, v) whose formation is known: evenly spaced, away from faults, in world coordinates, with clamped and rounded heights."""
    along = resample(contacts.join(kinds.where("formation is not null").select("contact_id", "formation"), "contact_id"), ["contact_id", "formation"], ["seq"], "u", "v", params.sample_step)
    asked = along.select(F.struct("contact_id", "seq").alias("id"), F.col("x").alias("u"), F.col("y").alias("v"), "formation")
    # Distances are measured from the cell that a sample stands in.
    cells = asked.select("id", F.floor(F.col("u")).cast("double").alias("u"), F.floor(F.col("v")).cast("double").alias("v"))
    close = fault_distance(cells, faults, params.fault_buffer).select("id")
    kept = asked.join(close, "id", "left_anti")
    placed = kept.join(bilinear(kept, heights, georef.img_w, georef.img_h), "id")
    x, y = georef.to_world(F.col("u"), F.col("v"))
    z = clamp(F.col("z"), z_range[0] + params.z_margin, z_range[1] - params.z_margin)
    return placed.select(F.lit(0).alias("src"), F.col("id.contact_id").cast("long").alias("part"), F.col("id.seq").cast("long").alias("seq"), F.bround(x, 2).alias("x"), F.bround(y, 2).alias("y"), F.bround(z, 2).alias("z"), "formation")


def _best_fits(fits: DataFrame, order: str, most: int, params: ConstraintParams) -> DataFrame:
    """The best credible fits of each formation that keep their distance, as orientations."""
    good = credible(fits, params.min_relief, params.min_dip, params.max_dip).select("formation", order, F.col("cx").alias("x"), F.col("cy").alias("y"), "cz", "azimuth", "dip", "score")
    best = spaced_best(good, "formation", most, params.spacing, order).select("formation", order)
    return good.join(best, ["formation", order]).select(
        F.bround("x", 2).alias("x"), F.bround("y", 2).alias("y"), F.bround("cz", 2).alias("z"), F.bround("azimuth", 2).alias("azimuth"), F.bround("dip", 2).alias("dip"), F.lit(1).alias("polarity"), "formation"
    )


def _longest(samples: DataFrame) -> DataFrame:
    """The samples of the contact with most of them in each formation (ties: smallest contact)."""
    sizes = samples.groupBy("formation", "part").agg(F.count("*").alias("n"))
    top = sizes.groupBy("formation").agg(F.max_by("part", F.struct("n", -F.col("part"))).alias("part"))
    return samples.join(top, ["formation", "part"])


def unit_dips(samples: DataFrame, units: DataFrame, params: ConstraintParams) -> DataFrame:
    """Orientations of formations whose unit has a dip and azimuth: at even places between 15 and 85 % of their longest contact."""
    given = units.where("dip is not null and azimuth is not null").groupBy(F.col("name").alias("formation")).agg(F.max_by(F.struct("dip", "azimuth"), "unit_id").alias("g"))
    at = pick_at(_longest(samples), ["formation"], ["seq"], np.linspace(0.15, 0.85, params.per_formation).tolist())
    return at.join(given, "formation").select("x", "y", "z", F.col("g.azimuth").cast("double").alias("azimuth"), F.col("g.dip").cast("double").alias("dip"), F.lit(1).alias("polarity"), "formation")


def window_fits(samples: DataFrame, params: ConstraintParams) -> DataFrame:
    """Orientations from planes through stretches of a contact."""
    windows = sliding_windows(samples, ["formation", "part"], ["seq"], max(params.fit_points, 12), params.fit_points)
    fits = plane_fit(windows.withColumn("at", F.struct("part", "window_no")), ["formation", "at"]).where(F.col("n") >= params.fit_points)
    return _best_fits(fits.withColumn("at", F.col("at.part") * (1 << 20) + F.col("at.window_no")), "at", params.per_formation, params)


def default_dips(samples: DataFrame, params: ConstraintParams) -> DataFrame:
    """The default orientation at the middle of each formation's longest contact."""
    counted = number(_longest(samples), ["formation"], ["seq"], "_rn", "_n").where("_rn - 1 = _n div 2")
    return counted.select("x", "y", "z", F.lit(float(params.default_azimuth or 90.0)).alias("azimuth"), F.lit(float(params.default_dip)).alias("dip"), F.lit(1).alias("polarity"), "formation")


def hidden_fits(points: DataFrame, params: ConstraintParams, reach: float, cut: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """Orientations of formations that have deep points only: planes through each point and its nearest others on the map.

    Rounds of growing reach find the neighbours; a point is done when it has enough, or its formation has no more.
    """
    named = cut(points.select("formation", F.xxhash64("src", "part", "seq").alias("at"), "x", "y", "z"))
    sizes = named.groupBy("formation").agg(F.count("*").alias("n")).where(F.col("n") >= params.fit_points)
    left, parts = cut(named.join(sizes, "formation").withColumn("need", F.least(F.col("n"), F.lit(params.neighbours)))), []
    while not left.isEmpty():
        near = within(left, named, reach, on=("formation",)).select("formation", F.col("l.at").alias("at"), F.col("l.need").alias("need"), "dist", "r.x", "r.y", "r.z", F.col("r.at").alias("other"))
        done = near.groupBy("formation", "at").agg(F.count("*").alias("k"), F.first("need").alias("need")).where("k >= need").select("formation", "at")
        ranked = near.join(done, ["formation", "at"]).withColumn("_r", F.row_number().over(Window.partitionBy("formation", "at").orderBy("dist", "other")))
        parts.append(cut(ranked.where("_r <= need").select("formation", "at", "x", "y", "z")))
        left, reach = cut(left.join(done, ["formation", "at"], "left_anti")), reach * 2
    if not parts:
        return named.where("false").select("x", "y", "z", F.lit(0.0).alias("azimuth"), F.lit(0.0).alias("dip"), F.lit(1).alias("polarity"), "formation")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return _best_fits(plane_fit(every, ["formation", "at"]), "at", params.hidden_fits, params)


def fault_constraints(faults: DataFrame, lines: DataFrame, heights: DataFrame, georef: GeoRef, z_range: tuple[float, float], params: ConstraintParams) -> tuple[DataFrame, DataFrame]:
    """Points on and down the planes of confirmed faults (fault, name, dip, azimuth; lines: fault, seq, u, v), and two orientations each. Lines of less than two samples give none."""
    along = resample(lines.join(faults.select("fault"), "fault", "left_semi"), ["fault"], ["seq"], "u", "v", 2.5 * params.sample_step)
    asked = number(along.select("fault", "seq", F.col("x").alias("u"), F.col("y").alias("v")), ["fault"], ["seq"], "_rn", "_n").where("_n >= 2").withColumn("id", F.struct("fault", "seq"))
    x, y = georef.to_world(F.col("u"), F.col("v"))
    about = faults.select("fault", F.col("name").alias("formation"), F.col("dip").cast("double").alias("dip"), F.col("azimuth").cast("double").alias("azimuth"))
    placed = asked.join(bilinear(asked, heights, georef.img_w, georef.img_h), "id").join(about, "fault").select("fault", "seq", "_rn", "_n", x.alias("x"), y.alias("y"), "z", "formation", "dip", "azimuth")
    used = [float(d) for d in params.fault_offsets if d <= 0.8 * (z_range[1] - z_range[0])]
    steps = F.when((F.col("_rn") - 1) % 3 == 0, F.array(F.lit(0.0), *[F.lit(d) for d in used])).otherwise(F.array(F.lit(0.0)))
    run = F.col("dz") / F.tan(F.radians("dip"))
    down = placed.withColumn("dz", F.explode(steps)).withColumn("_z", F.col("z") - F.col("dz")).where((F.col("dz") == 0) | (F.col("_z") >= z_range[0] + params.z_margin))
    points = down.select(
        F.lit(3).alias("src"), F.col("fault").cast("long").alias("part"), (F.col("seq") * 1000 + F.col("dz")).cast("long").alias("seq"),
        F.bround(F.col("x") + run * F.sin(F.radians("azimuth")), 2).alias("x"), F.bround(F.col("y") + run * F.cos(F.radians("azimuth")), 2).alias("y"), F.bround("_z", 2).alias("z"), "formation",
    )
    at = F.array(*[F.floor(F.lit(f) * (F.col("_n") - 1)) for f in (0.3, 0.7)])
    poses = placed.withColumn("_k", F.explode(at)).where("_rn - 1 = _k")
    z = F.greatest(F.col("z") - 150.0, F.lit(z_range[0] + 40.0))
    return points, poses.select(F.bround("x", 2).alias("x"), F.bround("y", 2).alias("y"), F.bround(z, 2).alias("z"), "azimuth", "dip", F.lit(1).alias("polarity"), "formation")


def _with_priors(points: DataFrame, strata: DataFrame, z_floor: float, params: ConstraintParams) -> DataFrame:
    """Adds, for each formation with a thickness and no points, every second point of the unit above it, moved down. Priors apply in their order, so one may rest on another."""
    for name, thickness in params.thickness_priors.items():
        me = strata.where(F.col("name") == name).select("series", F.col("order") - 1)
        upper = strata.select("series", "order", F.col("name").alias("formation")).join(me.toDF("series", "order"), ["series", "order"]).select("formation").distinct()
        have = points.where(F.col("formation") == name).select(F.lit(1).alias("_one")).limit(1)
        base = every_nth(points.join(upper, "formation", "left_semi"), ["formation"], ["src", "part", "seq"], 2)
        moved = base.withColumn("z", F.greatest(F.col("z") - float(thickness), F.lit(z_floor))).withColumn("formation", F.lit(name)).withColumn("src", F.lit(2)).withColumn("_one", F.lit(1))
        points = points.unionByName(moved.join(have, "_one", "left_anti").select(*POINTS))
    return points


@dataclass(frozen=True)
class Constraints:
    points: DataFrame
    orientations: DataFrame
    stack: DataFrame  # name, series, order, rank of the series (new to old)
    suspects: DataFrame  # contact_id
    unreviewed: DataFrame  # strata without an order
    unknown: DataFrame  # deep points of no stratum
    config: DataFrame  # one row
    summary: DataFrame  # formation, n_points, n_orientations


def build_constraints(
    contacts: DataFrame, lines: DataFrame, units: DataFrame, faults: DataFrame, fault_lines: DataFrame, heights: DataFrame, georef: GeoRef, z_range: tuple[float, float],
    resolution: tuple[int, int, int] = (60, 60, 60), params: ConstraintParams = ConstraintParams(), deep: DataFrame | None = None, readings: DataFrame | None = None,
    cut: Callable[[DataFrame], DataFrame] = cut_lineage,
) -> Constraints:
    """All tables of a map.

    contacts: contact_id, unit_a, unit_b; lines: contact_id, seq, u, v; units: unit_id, name, role, order, series, dip, azimuth; faults: fault,
    name, dip, azimuth (confirmed ones); fault_lines: fault, seq, u, v; heights: u, v, z; deep: x, y, z, formation; readings: orientations.
    A map without a point raises an error when its configuration is read.
    """
    every = units.where("role = 'strata'").withColumn("series", F.coalesce("series", F.lit("Strat_Series")))
    unreviewed, strata = every.where("order < 0 or order is null"), cut(every.where("order >= 0"))
    kinds = cut(contact_formation(contacts, strata))
    samples = cut(contact_points(lines, kinds, fault_lines.join(faults.select("fault"), "fault", "left_semi"), heights, georef, z_range, params))
    points = stride_thin(samples, ["formation"], ["part", "seq"], params.max_points)
    names = strata.select(F.col("name").alias("formation")).distinct()
    unknown = names.where("false")
    if deep is not None:
        placed = deep.select(F.lit(1).alias("src"), F.lit(0).cast("long").alias("part"), F.xxhash64("x", "y", "z", "formation").alias("seq"), *[F.col(c).cast("double").alias(c) for c in "xyz"], "formation")
        points, unknown = points.unionByName(placed.join(names, "formation", "left_semi").select(*POINTS)), deep.join(names, "formation", "left_anti")
    points = cut(_with_priors(points, strata, z_range[0] + params.z_margin, params))

    given = unit_dips(samples, strata, params)
    fitted = window_fits(samples.join(given.select("formation").distinct(), "formation", "left_anti"), params)
    poses = given.unionByName(fitted)
    if readings is not None:
        rounded = readings.join(names, "formation", "left_semi").select(*[F.bround(c, 2).alias(c) for c in "xyz"], F.col("azimuth").cast("double").alias("azimuth"), F.col("dip").cast("double").alias("dip"), F.col("polarity").cast("int").alias("polarity"), "formation")
        poses = poses.unionByName(rounded)
    if params.default_dip is not None:
        lacking = samples.join(given.unionByName(fitted).select("formation").distinct(), "formation", "left_anti")
        poses = poses.unionByName(default_dips(lacking, params))
    poses = cut(poses.select(*READINGS))
    alone = points.join(names, "formation", "left_semi").join(poses.select("formation").distinct(), "formation", "left_anti")
    poses = poses.unionByName(hidden_fits(alone, params, (georef.x1 - georef.x0) / 16, cut).select(*READINGS))
    fault_points_, fault_poses = fault_constraints(faults, fault_lines, heights, georef, z_range, params)

    # The stack: strata with points, without the oldest, which is the basement.
    aged = strata.groupBy("name").agg(F.min("order").alias("order"), F.max_by("series", "order").alias("series"))
    basement = aged.agg(F.max_by("name", "order").alias("basement"))
    kept = aged.join(basement, F.col("name") != F.col("basement")).drop("basement").join(points.select(F.col("formation").alias("name")).distinct(), "name", "left_semi")
    stack = cut(kept.join(kept.groupBy("series").agg(F.min("order").alias("youngest")), "series").select("name", "series", "order", F.dense_rank().over(Window.orderBy("youngest", "series")).alias("rank")))
    allowed = stack.select(F.col("name").alias("formation")).unionByName(fault_points_.select("formation").distinct())
    points = cut(points.unionByName(fault_points_).join(allowed, "formation", "left_semi"))
    poses = cut(poses.unionByName(fault_poses.select(*READINGS)).join(allowed, "formation", "left_semi"))
    poses = cut(poses.unionByName(_one_each(stack, points, poses, params)))
    if params.projection:
        strata_points = points.join(names, "formation", "left_semi").withColumn("id", F.struct("src", "part", "seq"))
        tilted = poses.join(names, "formation", "left_semi").withColumn("ori_id", F.xxhash64(*READINGS))
        more = downdip_projection(strata_points.withColumn("_seq", F.col("seq")).withColumn("seq", F.col("id")), tilted, list(params.projection), params.projection_radius, (georef.x0, georef.x1, georef.y0, georef.y1), z_range[0] + params.z_margin)
        added = more.select(F.lit(4).alias("src"), F.col("id.part").alias("part"), F.xxhash64("id", "len").alias("seq"), *[F.bround(c, 2).alias(c) for c in "xyz"], "formation")
        points = points.unionByName(added)
    return Constraints(points, poses, stack, kinds.where("kind = 'suspect'").select("contact_id"), unreviewed, unknown, _config(points, stack, faults, basement, georef, z_range, resolution), _summary(points, poses))


def _one_each(stack: DataFrame, points: DataFrame, poses: DataFrame, params: ConstraintParams) -> DataFrame:
    """A default orientation for each series without one: at the middle point of its member with most points."""
    have = stack.join(poses.select(F.col("formation").alias("name")).distinct(), "name", "left_semi").select("series").distinct()
    bare = stack.join(have, "series", "left_anti")
    sizes = points.groupBy(F.col("formation").alias("name")).agg(F.count("*").alias("n"))
    member = bare.join(sizes, "name").groupBy("series").agg(F.max_by("name", F.struct("n", -F.col("order"))).alias("formation"))
    middle = number(points.join(member.select("formation"), "formation", "left_semi"), ["formation"], ["src", "part", "seq"], "_rn", "_n").where("_rn - 1 = _n div 2")
    dip, azimuth = 5.0 if params.default_dip is None else float(params.default_dip), 90.0 if params.default_azimuth is None else float(params.default_azimuth)
    return middle.select("x", "y", "z", F.lit(azimuth).alias("azimuth"), F.lit(dip).alias("dip"), F.lit(1).alias("polarity"), "formation")


def _config(points: DataFrame, stack: DataFrame, faults: DataFrame, basement: DataFrame, georef: GeoRef, z_range: tuple, resolution: tuple) -> DataFrame:
    """One row: extent, resolution, series (faults first, then new to old, each with its members new to old), fault_series, basement, georef. Raises an error when read if there is no point."""
    members = stack.groupBy("rank", "series").agg(F.transform(F.array_sort(F.collect_list(F.struct("order", "name"))), lambda m: m["name"]).alias("members"))
    groups = members.select(F.col("rank"), F.struct(F.col("series").alias("name"), "members").alias("g"))
    broken = faults.select(F.lit(0).alias("rank"), F.struct(F.concat(F.lit("Fault_"), F.col("name")).alias("name"), F.array("name").alias("members")).alias("g"))
    ordered = broken.unionByName(groups).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "g"))), lambda r: r["g"]).alias("series"))
    n = points.agg(F.count("*").alias("n"))
    extent = F.array(*[F.lit(float(v)) for v in (georef.x0, georef.x1, georef.y0, georef.y1, *z_range)])
    checked: Column = F.when(F.col("n") > 0, F.col("series")).otherwise(F.raise_error(F.lit("no surface point: are the orders of the units reviewed?")))
    faulty = F.transform(F.filter("series", lambda s: s["name"].startswith("Fault_")), lambda s: s["name"])
    return n.join(ordered).join(basement).select(extent.alias("extent"), F.array(*[F.lit(int(v)) for v in resolution]).alias("resolution"), checked.alias("series"), faulty.alias("fault_series"), "basement", F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in georef.to_dict().items()])).alias("georef"))


def _summary(points: DataFrame, poses: DataFrame) -> DataFrame:
    a = points.groupBy("formation").agg(F.count("*").alias("n_points"))
    b = poses.groupBy("formation").agg(F.count("*").alias("n_orientations"))
    return a.join(b, "formation", "full").select("formation", F.coalesce("n_points", F.lit(0)).cast("long").alias("n_points"), F.coalesce("n_orientations", F.lit(0)).cast("long").alias("n_orientations"))
