"""Operators that turn contacts, units, faults and readings into constraint tables."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import clamp, dip_azimuth
from .graph import cut_lineage
from .sequences import every_nth
from .spatial import nearest_within


def contact_formation(contacts: DataFrame, units: DataFrame) -> DataFrame:
    """contact_id, kind and formation of contacts (contact_id, unit_a, unit_b); units: unit_id, name, series, order (0: youngest).

    Same series and neighbours in order: the younger unit. Other series: the oldest member of the younger
    unit's series. Same series, not neighbours: suspect, no formation. Same order, or a unit that is no stratum: no row.
    """
    side = lambda s: units.select(F.col("unit_id").alias(f"unit_{s}"), F.col("name").alias(f"name_{s}"), F.col("series").alias(f"series_{s}"), F.col("order").alias(f"order_{s}"))
    oldest = units.groupBy(F.col("series").alias("young")).agg(F.max_by("name", "order").alias("oldest"))
    both = contacts.join(side("a"), "unit_a").join(side("b"), "unit_b").where("order_a <> order_b")
    a_young = F.col("order_a") < F.col("order_b")
    both = both.withColumn("young", F.when(a_young, F.col("series_a")).otherwise(F.col("series_b"))).join(oldest, "young")
    same = F.col("series_a") == F.col("series_b")
    next_to = F.abs(F.col("order_a") - F.col("order_b")) == 1
    kind = F.when(same & next_to, "conformable").when(same, "suspect").otherwise("unconformable")
    name = F.when(kind == "conformable", F.when(a_young, F.col("name_a")).otherwise(F.col("name_b"))).when(kind == "unconformable", F.col("oldest"))
    return both.select("contact_id", kind.alias("kind"), name.alias("formation"))


def plane_fit(df: DataFrame, group: list[str], x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """Least-squares plane z = a x + b y + c per group from centred sums: n, a, b, dip, azimuth, rms, relief, spread (second singular value), score.

    Groups without a plane (points on a line) have null slopes.
    """
    means = df.groupBy(*group).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"), F.avg(z).alias("_mz"))
    d = {k: F.col(c) - F.col(m) for k, c, m in (("x", x, "_mx"), ("y", y, "_my"), ("z", z, "_mz"))}
    sums = [F.sum(d[p] * d[q]).alias(f"s{p}{q}") for p, q in ("xx", "xy", "yy", "xz", "yz", "zz")]
    s = df.join(means, group).groupBy(*group).agg(F.count("*").alias("n"), (F.max(z) - F.min(z)).alias("relief"), F.first("_mx").alias("cx"), F.first("_my").alias("cy"), F.first("_mz").alias("cz"), *sums)
    det = F.col("sxx") * F.col("syy") - F.col("sxy") * F.col("sxy")
    safe = F.when(F.abs(det) > 1e-9 * F.col("sxx") * F.col("syy"), det)
    s = s.withColumn("a", (F.col("sxz") * F.col("syy") - F.col("syz") * F.col("sxy")) / safe).withColumn("b", (F.col("syz") * F.col("sxx") - F.col("sxz") * F.col("sxy")) / safe)
    rss = F.greatest(F.lit(0.0), F.col("szz") - F.col("a") * F.col("sxz") - F.col("b") * F.col("syz"))
    half = (F.col("sxx") + F.col("syy") - F.sqrt((F.col("sxx") - F.col("syy")) * (F.col("sxx") - F.col("syy")) + 4 * F.col("sxy") * F.col("sxy"))) / 2
    dip, azimuth = dip_azimuth(F.col("a"), F.col("b"))
    out = s.withColumn("rms", F.sqrt(rss / F.col("n"))).withColumn("spread", F.sqrt(F.greatest(F.lit(0.0), half))).withColumn("dip", dip).withColumn("azimuth", azimuth)
    return out.withColumn("score", F.col("relief") / (F.col("rms") + 3.0)).select(*group, "n", "cx", "cy", "cz", "a", "b", "dip", "azimuth", "rms", "relief", "spread", "score")


def credible(fits: DataFrame, min_relief: float, min_dip: float, max_dip: float, min_spread: float = 15.0) -> DataFrame:
    """Fits with enough relief and spread and a dip in range."""
    return fits.where((F.col("relief") >= min_relief) & (F.col("spread") >= min_spread) & F.col("dip").between(min_dip, max_dip))


def spaced_best(df: DataFrame, group: str, k: int, gap: float, order: str, cut: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """Per group, up to k rows of best score, each more than gap away from those chosen before it (ties: smallest order). df: group, order, x, y, score; rank is added.

    Rows are dealt to cells whose diagonal is the gap. In each round the best open row of a cell is chosen if it beats the best ones of all
    cells that the gap reaches, which is what choosing one by one would do; rows within the gap of a chosen one go, and so do those that
    are worse than k chosen ones of their group. No task holds a group, and no cell's rows meet each other. Rows without a score or a place are not chosen.
    """
    names = [group, order, "x", "y", "score"]
    side = max(gap, 0.0) / 2**0.5
    cell = lambda c: F.floor(F.col(c) / side).cast("long") if side > 0 else F.col(c)
    rank = F.struct((-F.col("score").cast("double")).alias("s"), F.col(order).alias("o"))
    left = cut(df.select(*names).dropna(subset=["x", "y", "score"]).withColumns({"_r": rank, "_cu": cell("x"), "_cv": cell("y")}))
    around = [(a, b) for a in range(-2, 3) for b in range(-2, 3)] if side > 0 else [(0, 0)]
    reach = F.explode(F.array(*[F.struct((F.col("_cu") + a).alias("_cu"), (F.col("_cv") + b).alias("_cv")) for a, b in around])).alias("_c")
    keys, rounds = [group, "_cu", "_cv"], []
    while gap >= 0 and not left.isEmpty():
        best = left.groupBy(*keys).agg(F.min_by(F.struct(*names[1:], "_r"), "_r").alias("b"))
        beaten = best.select(group, reach, F.col("b._r").alias("_r")).select(group, "_c.*", "_r").groupBy(*keys).agg(F.min("_r").alias("_least"))
        fresh = cut(best.join(beaten, keys).where("b._r = _least").select(*keys, "b.*"))
        rounds.append(fresh)
        chosen = rounds[0]
        for one in rounds[1:]:
            chosen = chosen.unionByName(one)
        near = fresh.select(group, reach, F.struct("x", "y").alias("p")).select(group, "_c.*", "p").groupBy(*keys).agg(F.collect_list("p").alias("_near"))
        # the k-th best of what is chosen so far; what is worse than that can't come in any more
        bar = first_of_each(chosen.select(group, "_r"), group, k).groupBy(group).agg(F.max("_r").alias("_bar"), F.count("*").alias("_n")).where(F.col("_n") >= k).select(group, "_bar")
        close = F.exists("_near", lambda p: F.sqrt((F.col("x") - p["x"]) * (F.col("x") - p["x"]) + (F.col("y") - p["y"]) * (F.col("y") - p["y"])) <= gap)
        open_rows = left.join(near, keys, "left").where(~F.coalesce(close, F.lit(False))).drop("_near")
        left = cut(open_rows.join(bar, group, "left").where("_bar is null or _r < _bar").select(left.columns))
    chosen = left if gap < 0 else None
    for one in rounds:
        chosen = one if chosen is None else chosen.unionByName(one)
    out = left if chosen is None else chosen
    return first_of_each(out.select(*names, "_r"), group, k).select(*names, F.col("_k").cast("long").alias("rank"))


def first_of_each(rows: DataFrame, group: str, k: int) -> DataFrame:
    """The k rows of least _r of each group, numbered in _k; each of some parts of a group is cut down first."""
    parts = rows.withColumn("_part", F.pmod(F.xxhash64("_r"), F.lit(16)))
    few = parts.withColumn("_k", F.row_number().over(Window.partitionBy(group, "_part").orderBy("_r"))).where(F.col("_k") <= k)
    return few.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy("_r"))).where(F.col("_k") <= k).drop("_part")


def downdip_projection(points: DataFrame, orientations: DataFrame, lengths: list[float], radius: float, bounds: tuple, z_floor: float) -> DataFrame:
    """Virtual points below every third point of each formation (id, seq, x, y, z, formation), along the dip of the nearest orientation (ori_id, x, y, azimuth, dip) in reach; outside the bounds they go."""
    third = every_nth(points, ["formation"], ["seq"], 3)
    near = nearest_within(third, orientations.select(F.col("ori_id"), "x", "y"), radius, "id", "ori_id")
    posed = third.join(near, "id").join(orientations.select("ori_id", F.radians("azimuth").alias("_az"), F.radians("dip").alias("_dip")), "ori_id")
    spread = posed.withColumn("len", F.explode(F.array(*[F.lit(float(v)) for v in lengths])))
    out = spread.select(
        "id", "len",
        (F.col("x") + F.sin("_az") * F.cos("_dip") * F.col("len")).alias("x"),
        (F.col("y") + F.cos("_az") * F.cos("_dip") * F.col("len")).alias("y"),
        (F.col("z") - F.sin("_dip") * F.col("len")).alias("z"), "formation",
    )
    x0, x1, y0, y1 = bounds
    return out.where((F.col("x") > x0) & (F.col("x") < x1) & (F.col("y") > y0) & (F.col("y") < y1) & (F.col("z") >= z_floor))


def thickness_prior(points: DataFrame, formation: str, upper: str, thickness: float, z_floor: float, order: str = "seq") -> DataFrame:
    """Points of the upper formation moved down, every second one, as points of `formation`; none if it has points of its own."""
    mine = points.where(F.col("formation") == formation).select(F.lit(1).alias("_one")).limit(1)
    moved = points.where(F.col("formation") == upper).withColumn("z", F.greatest(F.col("z") - thickness, F.lit(z_floor))).withColumn("formation", F.lit(formation)).withColumn("_one", F.lit(1))
    return every_nth(moved.join(F.broadcast(mine), "_one", "left_anti"), ["formation"], [order], 2).select(*points.columns)


def fault_points(trace: DataFrame, dip: float, azimuth: float, offsets: list[float], z_floor: float, depth: float, by: list[str] | None = None) -> DataFrame:
    """Trace points (by, seq, x, y, z) and, for every third of a trace, points down the fault plane at the offsets (up to 0.8 of the depth range)."""
    used = [d for d in offsets if d <= 0.8 * depth]
    east, north = math.sin(math.radians(azimuth)), math.cos(math.radians(azimuth))
    run = F.col("dz") / math.tan(math.radians(dip))
    by = by or []
    third = every_nth(trace, by, ["seq"], 3)
    deep = third.withColumn("dz", F.explode(F.array(*[F.lit(float(d)) for d in used]))).select(*by, "seq", "dz", (F.col("x") + run * east).alias("x"), (F.col("y") + run * north).alias("y"), (F.col("z") - F.col("dz")).alias("z"))
    return trace.select(*by, "seq", F.lit(0.0).alias("dz"), "x", "y", "z").unionByName(deep.where(F.col("z") >= z_floor))


def modelable_stack(units: DataFrame, points: DataFrame) -> DataFrame:
    """Strata with points, without the oldest (the basement), young to old: position (from 1), name, series."""
    strata = units.where((F.col("role") == "strata") & (F.col("order") >= 0))
    top = strata.agg(F.max("order").alias("_last"))
    kept = strata.join(F.broadcast(top), F.col("order") < F.col("_last")).join(points.select(F.col("formation").alias("name")).distinct(), "name", "left_semi")
    return kept.select(F.row_number().over(Window.orderBy("order")).alias("position"), "name", "series")


def series_groups(stack: DataFrame) -> DataFrame:
    """Series in the order of their youngest member, each with its members young to old."""
    grouped = stack.groupBy("series").agg(F.min("position").alias("_first"), F.array_sort(F.collect_list(F.struct("position", "name"))).alias("_m"))
    return grouped.select(F.row_number().over(Window.orderBy("_first")).alias("rank"), "series", F.concat_ws(",", F.transform("_m", lambda m: m["name"])).alias("members"))


def missing_orientation(stack: DataFrame, orientations: DataFrame) -> DataFrame:
    """Series none of whose members has an orientation."""
    have = stack.join(orientations.select(F.col("formation").alias("name")).distinct(), "name", "left_semi").select("series")
    return stack.select("series").distinct().join(have, "series", "left_anti")


def referential(points: DataFrame, orientations: DataFrame, allowed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables, each cut separately to the allowed formations."""
    names = allowed.select("formation").distinct()
    return points.join(names, "formation", "left_semi"), orientations.join(names, "formation", "left_semi")


def on_contact(samples: DataFrame, dem_z: str, buffer: float, z_range: tuple, margin: float) -> DataFrame:
    """Contact samples farther than the buffer from a fault, with height clamped to the range and all rounded to 2 decimals. samples: formation, x, y, fault_dist (null: no fault) and a height."""
    z = clamp(F.col(dem_z), z_range[0] + margin, z_range[1] - margin)
    far = F.col("fault_dist").isNull() | (F.col("fault_dist") > buffer)
    return samples.where(far).select("formation", F.bround("x", 2).alias("x"), F.bround("y", 2).alias("y"), F.bround(z, 2).alias("z"))
