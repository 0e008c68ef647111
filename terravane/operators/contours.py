"""Contour lines from drawn dashes and dots, for many maps at once: components, their shapes, links, chains.

Every table has the columns `by` that tell maps apart. Components are found by pointer doubling, their shapes
are sums over their cells, links come from a distance join on grid cells.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import gray
from .graph import chains, components, cut_lineage, materialise, simplify_paths, unsent
from .raster import offsets
from .spatial import within
from .tiles import SIDE, least_connected, over_tiles


@dataclass(frozen=True)
class ContourParams:
    # The default thresholds.
    dark_gray_max: float = 110.0
    dash_area_min: int = 4
    dash_area_max: int = 260
    dash_aspect_min: float = 1.5
    dot_area_max: int = 0
    link_dist: float = 18.0
    link_angle: float = 42.0
    min_chain_dashes: int = 5
    tolerance: float = 1.5


def touching(cells: DataFrame, by: Sequence[str], eight: bool = True, label: str | None = None) -> DataFrame:
    """Edges (u, v of cell ids) between touching cells (by, id, u, v), of one label if given."""
    steps = [s for s in offsets("square" if eight else "cross", 1) if s > (0, 0)]
    keys = [*by, *([label] if label else []), "u", "v"]
    moved = F.explode(F.array(*[F.struct((F.col("u") + a).alias("u"), (F.col("v") + b).alias("v")) for a, b in steps]))
    ahead = cells.select(F.col("id").alias("_a"), *keys[:-2], moved.alias("_c")).select("_a", *keys[:-2], "_c.u", "_c.v")
    return ahead.join(cells.select("id", *keys).hint("merge"), keys).select(F.col("_a").alias("u"), F.col("id").alias("v"))


#: Types of labels that tiles carry.
TILE_KINDS = {"int": "int", "bigint": "long", "double": "double", "boolean": "boolean"}


def labelled_components(cells: DataFrame, by: Sequence[str] = ("case_id",), eight: bool = True, label: str | None = None, cut: Callable[[DataFrame], DataFrame] = materialise) -> DataFrame:
    """by, u, v, the label and component: the least cell id of the connected cells; cells are numbered by a hash-free packing of their place, so ids are the same in every run. Places beyond 2^19 either way are an error."""
    half = 1 << 19
    fits = F.col("u").between(-half, half - 1) & F.col("v").between(-half, half - 1)
    packing = (F.col("u").cast("long") + half) * (1 << 20) + F.col("v").cast("long") + half
    place = F.when(fits, packing).otherwise(F.raise_error(F.lit("a cell's place does not fit its number")).cast("long"))
    number = F.dense_rank().over(Window.orderBy(*by)) if by else F.lit(1)
    # as many rows as maps; of known size once it is cut, so that it comes to the cells and not the cells of a map to one task
    maps = cut(cells.select(*by).distinct().withColumn("_map", number.cast("long"))) if by else None
    named = cells.join(maps, list(by)) if by else cells.withColumn("_map", F.lit(1).cast("long"))
    named = named.withColumn("id", F.col("_map") * (1 << 40) + place).drop("_map")
    # inside tiles cells are joined as arrays; only cells at the borders of tiles meet others
    kinds = dict(cells.dtypes)
    carried = {"_label": TILE_KINDS[kinds[label]], "_none": "boolean"} if label and kinds[label] in TILE_KINDS else {}
    inside = lambda arrays, have, row: {"_root": arrays["id"].ravel()[least_connected(have, arrays["_kind"], eight)], **{c: arrays[c] for c in carried}}
    named = named.withColumn("_kind", F.xxhash64(label) if label else F.lit(0))
    if carried:  # columns are not null in tiles
        named = named.withColumn("_label", F.coalesce(F.col(label), F.lit(0).cast(kinds[label]))).withColumn("_none", F.col(label).isNull())
    elif label:
        named = cut(named)
    rooted = over_tiles(named, by, {"id": "long", "_kind": "long", **carried}, 0, inside, {"_root": "long", **carried})
    rooted = rooted.select(*by, *[F.col(c).cast(kinds[c]).alias(c) for c in "uv"], "_root", *([F.when(~F.col("_none"), F.col("_label")).alias(label)] if carried else []))
    if label and not carried:
        rooted = named.select(*by, "u", "v", label).join(rooted.hint("merge"), [*by, "u", "v"])
    rooted = cut(rooted)
    at_border = F.lit(False)
    for c in "uv":
        at_border = at_border | F.pmod(F.col(c), F.lit(SIDE)).isin(0, SIDE - 1)
    border = rooted.where(at_border).select(*by, "u", "v", *([label] if label else []), F.col("_root").alias("id"))
    found = cut(components(touching(border, by, eight, label), cut))
    return rooted.join(unsent(found.withColumnRenamed("node", "_root"), found.count()), "_root", "left").select(*by, "u", "v", *([label] if label else []), F.coalesce("component", "_root").alias("component"))


def component_shapes(cells: DataFrame, by: Sequence[str] = ("case_id",)) -> DataFrame:
    """by, component, area, bounding box (u0, u1, v0, v1), centre (x, y), principal direction (dx, dy) and its aspect: the ratio of the extents along and across it.

    Sums of places and their squares give the covariance, whose first axis has half the angle of (cxx - cyy, 2 cxy).
    """
    sums = cells.groupBy(*by, "component").agg(
        F.count("*").alias("area"), F.min("u").alias("u0"), F.max("u").alias("u1"), F.min("v").alias("v0"), F.max("v").alias("v1"), F.avg("u").alias("x"), F.avg("v").alias("y"),
        F.covar_pop("u", "u").alias("cxx"), F.covar_pop("v", "v").alias("cyy"), F.covar_pop("u", "v").alias("cxy"),
    )
    angle = 0.5 * F.atan2(2 * F.col("cxy"), F.col("cxx") - F.col("cyy"))
    half = F.sqrt((F.col("cxx") - F.col("cyy")) * (F.col("cxx") - F.col("cyy")) / 4 + F.col("cxy") * F.col("cxy"))
    mean = (F.col("cxx") + F.col("cyy")) / 2
    # A bar of n cells has the variance (n * n - 1) / 12 along it.
    side = lambda variance: F.sqrt(F.greatest(F.lit(0.0), variance) * 12 + 1)
    return sums.select(*by, "component", "area", "u0", "u1", "v0", "v1", "x", "y", F.cos(angle).alias("dx"), F.sin(angle).alias("dy"), (side(mean + half) / side(mean - half)).alias("aspect"))


def dashes(shapes: DataFrame, params: ContourParams = ContourParams()) -> DataFrame:
    """Shapes that may be dashes (long ones of middling area) or dots (small ones; their direction is (0, 0), which goes with any)."""
    dot = F.col("area") <= params.dot_area_max
    kept = shapes.where(F.col("area").between(params.dash_area_min, params.dash_area_max) & (dot | (F.col("aspect") >= params.dash_aspect_min)))
    return kept.withColumn("dx", F.when(dot, 0.0).otherwise(F.col("dx"))).withColumn("dy", F.when(dot, 0.0).otherwise(F.col("dy")))


def link_dashes(marks: DataFrame, params: ContourParams = ContourParams(), by: Sequence[str] = ("case_id",)) -> DataFrame:
    """Edges (u < v of component ids) between dashes that are near, lie in line with both directions, and choose each other.

    A dash chooses its nearest partner on either side along its direction. A dot's first choice is its nearest partner, its
    second the nearest one that lies more than about 100 degrees away from the first. A component is one dash, at one place;
    dashes at the same place don't link with each other.
    """
    points = marks.select(*by, "component", "x", "y", "dx", "dy")
    places = points.select(*by, "x", "y").distinct()
    near = within(places, places, params.link_dist, on=tuple(by)).where("dist > 0")
    p, q = ([F.col(f"{s}.{c}").alias(f"{s}{c}") for c in "xy"] for s in "lr")
    near = near.select(*by, *p, *q, "dist", *[((F.col(f"r.{k}") - F.col(f"l.{k}")) / F.col("dist")).alias(f"e{k}") for k in "xy"])
    along, dot = F.col("ex") * F.col("dx") + F.col("ey") * F.col("dy"), (F.col("dx") == 0) & (F.col("dy") == 0)
    fits = dot | (F.abs(along) >= math.cos(math.radians(params.link_angle)))
    at = lambda s: points.withColumnsRenamed({"x": f"{s}x", "y": f"{s}y"})
    # of the dashes at one place only the first of those in line with another place can be a partner of those there
    pair = [*by, "lx", "ly", "rx", "ry"]
    offered = near.join(at("r"), [*by, "rx", "ry"]).where(fits).groupBy(*pair, "dist", "ex", "ey").agg(F.min("component").alias("b"))
    near = offered.join(at("l"), [*by, "lx", "ly"]).where(fits).select(F.col("component").alias("a"), "b", "dist", "ex", "ey", dot.alias("dot"), F.when(along >= 0, 0).otherwise(1).alias("side"))
    order = Window.partitionBy("a").orderBy("dist", "b")
    dots = near.where("dot").withColumn("_x", F.first("ex").over(order)).withColumn("_y", F.first("ey").over(order)).withColumn("_b", F.first("b").over(order))
    behind = (F.col("ex") * F.col("_x") + F.col("ey") * F.col("_y") < -0.17) & (F.col("b") != F.col("_b"))
    dots = dots.withColumn("side", F.when(F.col("b") == F.col("_b"), 0).when(behind, 1)).where("side is not null")
    every = near.where("not dot").select("a", "b", "dist", "side").unionByName(dots.select("a", "b", "dist", "side"))
    best = every.groupBy("a", "side").agg(F.min(F.struct("dist", "b")).alias("best")).select("a", F.col("best.b").alias("b")).distinct()
    back = best.select(F.col("a").alias("b"), F.col("b").alias("a"))
    return best.join(back, ["a", "b"]).where("a < b").select(F.col("a").alias("u"), F.col("b").alias("v"))


def extract_contours(pixels: DataFrame, params: ContourParams = ContourParams(), by: Sequence[str] = ("case_id",), cut: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """by, contour_id (from 0, longest first in each map), elevation (null), length, vertices, of pixels (by, u, v, r, g, b).

    Chains of too few dashes go; a chain is closed if it is a ring or its ends are within one and a half link distances.
    """
    dark = pixels.where(gray(F.col("r"), F.col("g"), F.col("b")) < params.dark_gray_max)
    marks = cut(dashes(component_shapes(labelled_components(dark, by, cut=cut), by), params))
    walked = cut(chains(link_dashes(marks, params, by), cut))
    placed = walked.join(marks.select(*by, F.col("component").alias("node"), "x", "y"), "node")
    ends = placed.groupBy(*by, "chain").agg(F.count("*").alias("n"), F.min_by(F.struct("x", "y"), "seq").alias("p"), F.max_by(F.struct("x", "y"), "seq").alias("q"), F.max("closed").alias("closed"))
    ends = ends.where(F.col("n") >= params.min_chain_dashes)
    closed = F.col("closed") | (F.hypot(F.col("p.x") - F.col("q.x"), F.col("p.y") - F.col("q.y")) < 1.5 * params.link_dist)
    back = ends.where(closed).select("chain", F.col("n").alias("seq"), F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    vertices = placed.join(ends.select("chain"), "chain").select("chain", "seq", "x", "y").unionByName(back)
    kept = simplify_paths(vertices, "chain", "seq", params.tolerance).withColumn("_v", F.struct("seq", "x", "y"))
    lines = kept.groupBy("chain").agg(F.array_sort(F.collect_list("_v")).alias("_v")).where(F.size("_v") >= 2)
    step = F.zip_with(F.slice("_v", 1, F.size("_v") - 1), F.slice("_v", 2, F.size("_v") - 1), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    lines = lines.select("chain", F.aggregate(step, F.lit(0.0), lambda s, d: s + d).alias("length"), F.transform("_v", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))).alias("vertices"))
    named = lines.join(ends.select(*by, "chain"), "chain")
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("length"), "chain")) - 1
    return named.select(*by, rank.cast("int").alias("contour_id"), F.lit(None).cast("double").alias("elevation"), "length", "vertices")


def apply_elevations(contours: DataFrame, elevations: DataFrame, by: Sequence[str] = ("case_id",)) -> DataFrame:
    """Contours with the elevations (by, contour_id, elevation) that are given; the others keep their own."""
    given = elevations.select(*by, "contour_id", F.col("elevation").cast("double").alias("_given"))
    return contours.join(given, [*by, "contour_id"], "left").withColumn("elevation", F.coalesce("_given", "elevation")).drop("_given")


def contour_counts(contours: DataFrame, by: Sequence[str] = ("case_id",)) -> DataFrame:
    return contours.groupBy(*by).agg(F.count("*").alias("n_contours"), F.count("elevation").alias("n_with_elevation"))


def iso_segments(cells: DataFrame, interval: float, value: str = "z", by: Sequence[str] = ("case_id",)) -> DataFrame:
    """by, level_no, p, q: the pieces of contours inside the squares between four cells; p and q are edges between side neighbours (by, level_no, axis, u, v of the first cell).

    A square with two pairs of like corners across from each other has two pieces; the mean of its corners tells which pair they part. Squares that lack a
    corner have none.
    """
    spread = cells.select(*by, F.explode(F.array(*[F.struct((F.col("u") - i).alias("u"), (F.col("v") - j).alias("v"), F.lit(2 * i + j).alias("k"), F.col(value).cast("double").alias("z")) for i in (0, 1) for j in (0, 1)])).alias("c")).select(*by, "c.*")
    square = spread.groupBy(*by, "u", "v").agg(*[F.max(F.when(F.col("k") == k, F.col("z"))).alias(f"z{k}") for k in range(4)]).dropna(subset=[f"z{k}" for k in range(4)])
    names = [f"z{k}" for k in range(4)]  # corners: at (0, 0), (0, 1), (1, 0), (1, 1)
    low, high = F.floor(F.least(*names) / interval) + 1, F.floor(F.greatest(*names) / interval)
    at = square.where(low <= high).withColumn("level_no", F.explode(F.sequence(low, high)))
    level = F.col("level_no") * interval
    above = [F.col(n) >= level for n in names]
    edge = lambda axis, i, j: F.struct(*by, "level_no", F.lit(axis).alias("axis"), (F.col("u") + i).alias("u"), (F.col("v") + j).alias("v"))
    sides = [(edge("u", 0, 0), above[0] != above[2]), (edge("v", 0, 0), above[0] != above[1]), (edge("u", 0, 1), above[1] != above[3]), (edge("v", 1, 0), above[2] != above[3])]
    met = F.filter(F.array(*[F.when(test, e) for e, test in sides]), lambda e: e.isNotNull())
    bottom, left, top, right = (e for e, _ in sides)
    pair = lambda p, q: F.struct(p.alias("p"), q.alias("q"))
    first = ((F.col("z0") + F.col("z1") + F.col("z2") + F.col("z3")) / 4.0 >= level) == above[0]
    pieces = F.when(F.size("_met") == 2, F.array(pair(F.col("_met")[0], F.col("_met")[1]))).when(first, F.array(pair(bottom, right), pair(left, top))).otherwise(F.array(pair(bottom, left), pair(right, top)))
    return at.withColumn("_met", met).select(*by, "level_no", F.explode(pieces).alias("s")).select(*by, "level_no", "s.p", "s.q")


def iso_lines(cells: DataFrame, interval: float, value: str = "z", by: Sequence[str] = ("case_id",), cut: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """by, level, line, seq, closed, u, v: contours of a height field as lines; line is the least edge that a line crosses.

    The pieces inside squares are chained by list ranking over all maps and levels at once, so a line may be of any length and cross any number of tasks.
    """
    pieces = iso_segments(cells, interval, value, by)
    found = chains(pieces.select(F.col("p").alias("u"), F.col("q").alias("v")), cut)
    ends = lambda name, move: cells.select(*by, *[(F.col(c) - (1 if c == move else 0)).alias(c) for c in "uv"], F.col(value).cast("double").alias(name))
    node = [F.col(f"node.{c}").alias(c) for c in (*by, "level_no", "axis", "u", "v")]
    at = found.select(F.col("chain").alias("line"), "seq", "closed", *node)
    a = cells.select(*by, "u", "v", F.col(value).cast("double").alias("a"))
    out = None
    for axis in "uv":
        one = at.where(F.col("axis") == axis).join(a, [*by, "u", "v"]).join(ends("b", axis), [*by, "u", "v"])
        t = (F.col("level_no") * interval - F.col("a")) / (F.col("b") - F.col("a"))
        one = one.select(*by, (F.col("level_no") * interval).alias("level"), F.struct("line.axis", "line.u", "line.v").alias("line"), "seq", "closed", *[(F.col(c) + (t if c == axis else F.lit(0.0))).cast("double").alias(c) for c in "uv"])
        out = one if out is None else out.unionByName(one)
    return out
