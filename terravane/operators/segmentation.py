"""Units of scanned maps from their colours, for many maps at once.

Filters, masks, nearest labels and fills are stencils on tiles with margins: one pass cleans and masks, one labels and fills, one takes the median and joins
cells inside tiles, one absorbs small regions. Only regions that cross tiles meet by their borders, and only holes deeper than
a margin are filled by a join. Clusters are learned for each map from a bounded sample of its cells in one grouped task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import clamp, gray, hsv, lab
from .contours import labelled_components
from .graph import materialise, unsent
from .kernels import average_linkage
from .raster import RGB, nearest_fill, offsets, wide_smooth
from .tiles import SIDE, filled, lower_median, narrowed, over_tiles, shifted, widened


@dataclass(frozen=True)
class SegmentParams:
    # The default thresholds.
    k_max: int = 22
    merge_distance: float = 5.0
    dark_gray_max: float = 110.0
    dark_dilate: int = 2
    median_radius: int = 2
    min_region: int = 150
    #: Cells of a map that its clusters are learned from.
    sample: int = 20_000
    seed: int = 0
    denoise: bool = True
    noise_limit: float = 8.0
    level_light: bool = True


def is_water(r: Column, g: Column, b: Column) -> Column:
    """Clear blue: hue, saturation and value in the range of drawn water."""
    # The bounds (hue in half degrees).
    h, s, v = hsv(r, g, b)
    return h.between(95, 135) & (s > 60) & (v > 120)


def noise_level(pixels: DataFrame, by: Sequence[str] = ("case_id",)) -> DataFrame:
    """by, sigma: the noise of each map, from the median of the second differences along rows (0.6745 sigma times the root of 6)."""
    w = Window.partitionBy(*by, "v").orderBy("u")
    level = gray(F.col("r"), F.col("g"), F.col("b"))
    bent = pixels.select(*by, F.abs(F.lag(level).over(w) - 2 * level + F.lead(level).over(w)).alias("d")).where("d is not null")
    return bent.groupBy(*by).agg((F.percentile_approx("d", 0.5) / (0.6745 * 6**0.5)).alias("sigma"))


def smoothed(colours: list[np.ndarray], have: np.ndarray, radius: int = 3, sigma_colour: float = 35.0, sigma_space: float = 5.0) -> list[np.ndarray]:
    """Weighted means of the cells of a disc, near in place and in colour."""
    total, sums = np.zeros(have.shape), [np.zeros(have.shape) for _ in colours]
    for i, j in offsets("disc", radius):
        near = [shifted(c, i, j) for c in colours]
        away = sum(np.abs(n - c) for n, c in zip(near, colours, strict=True))
        weight = np.where(shifted(have, i, j), np.exp(-(i * i + j * j) / (2 * sigma_space**2) - away * away / (2 * sigma_colour**2)), 0.0)
        total += weight
        for s, n in zip(sums, near, strict=True):
            s += weight * n
    return [np.rint(s / np.where(have, total, 1.0)) for s in sums]


def cleaned(pixels: DataFrame, params: SegmentParams, by: Sequence[str] = ("case_id",), cut: Callable[[DataFrame], DataFrame] = materialise) -> DataFrame:
    """by, u, v, r, g, b, water and exclude, in one pass over tiles.

    Denoised: a median over three by three cells for maps whose noise is beyond the limit, then a bilateral filter for all. Water is clear blue;
    excluded are dark lines and rivers, widened; lakes (water that a disc of five cells fits into) stay.
    """
    disc, lake_disc = offsets("disc", params.dark_dilate), offsets("disc", 2)
    limit = F.coalesce(F.col("sigma"), F.lit(0.0)) > params.noise_limit
    given = noise_level(pixels, by).select(*by, limit.alias("loud")) if params.denoise else None
    if given is not None:  # maps of one or two columns have no second difference
        given = cut(pixels.select(*by).distinct().join(given, list(by), "left").select(*by, F.coalesce("loud", F.lit(False)).alias("loud")))
    dark_max, denoise = params.dark_gray_max, params.denoise

    def run(arrays: dict[str, np.ndarray], have: np.ndarray, row: dict) -> dict[str, np.ndarray]:
        colours = [arrays[c].astype(float) for c in RGB]
        if denoise:
            if row["loud"]:
                colours = [lower_median(arrays[c], have, 1).astype(float) for c in RGB]
            colours = smoothed(colours, have)
        r, g, b = colours
        dark = widened(have & (r * 0.299 + g * 0.587 + b * 0.114 < dark_max), disc)
        blue = have & water_mask(r, g, b)
        lake = widened(narrowed(blue, lake_disc), lake_disc)
        river = widened(blue & ~lake, disc) & ~lake
        return {"r": r, "g": g, "b": b, "water": blue, "exclude": dark | river}

    margin = 2 * 2 + 2 * params.dark_dilate + (4 if denoise else 0)
    return over_tiles(pixels, by, dict.fromkeys(RGB, "long"), margin, run, {**dict.fromkeys(RGB, "int"), "water": "boolean", "exclude": "boolean"}, given)


def water_mask(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> np.ndarray:
    """is_water() for arrays."""
    high, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    span = np.where(high > low, high - low, 1.0)
    turn = np.where(high == r, 60 * (g - b) / span, np.where(high == g, 120 + 60 * (b - r) / span, 240 + 60 * (r - g) / span))
    hue = np.where(high > low, np.where(turn < 0, turn + 360, turn), 0.0) / 2
    full = np.where(high > 0, 255 * (high - low) / np.maximum(high, 1e-9), 0.0)
    # The bounds of is_water().
    return (hue >= 95) & (hue <= 135) & (full > 60) & (high > 120)


def k_means(points: np.ndarray, k: int, seed: int, rounds: int = 40, tries: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Centres and their sizes: Lloyd's rounds from spread-out starts, the best of some tries."""
    rng, best = np.random.default_rng(seed), None
    for _ in range(tries):
        centres = points[[rng.integers(len(points))]]
        near = ((points - centres[0]) ** 2).sum(1)
        while len(centres) < k and near.max() > 0:
            centres = np.vstack([centres, points[rng.choice(len(points), p=near / near.sum())]])
            near = np.minimum(near, ((points - centres[-1]) ** 2).sum(1))
        for _ in range(rounds):
            d = (points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)[None]
            own = d.argmin(1)
            sizes = np.bincount(own, minlength=len(centres))
            fresh = np.stack([np.bincount(own, points[:, j], len(centres)) for j in range(points.shape[1])], 1)
            fresh = np.where(sizes[:, None] > 0, fresh / np.maximum(sizes, 1)[:, None], centres)
            if np.allclose(fresh, centres, atol=1e-3):
                break
            centres = fresh
        cost = float(np.maximum(d.min(1), 0).sum())
        if best is None or cost < best[0]:
            best = cost, centres, sizes
    return best[1], best[2]


#: Ranges of hashes by which cells are picked: a map's task gets its sample and one range's cells more.
HASH_RANGES = 1 << 16


def least_hashed(cells: DataFrame, order: Column, most: int, by: Sequence[str], cut: Callable[[DataFrame], DataFrame] = materialise) -> DataFrame:
    """The cells of each map that come first by a hash (then u, v), `most` of each map at most. Cells are counted in ranges of hashes, and only those of the ranges that reach `most` are ranked, so no task sorts a map."""
    ranged = cells.withColumn("_order", order).withColumn("_range", F.shiftright("_order", 64 - (HASH_RANGES.bit_length() - 1)))
    so_far = F.sum("count").over(Window.partitionBy(*by).orderBy("_range"))
    last = ranged.groupBy(*by, "_range").count().withColumn("_before", so_far - F.col("count")).where(F.col("_before") < most).groupBy(*by).agg(F.max("_range").alias("_last"))
    first = ranged.join(cut(last), list(by)).where("_range <= _last")
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("_order", "u", "v"))
    return first.withColumn("_n", rank).where(F.col("_n") <= most).select(*cells.columns)


def centres_of(cells: DataFrame, params: SegmentParams, by: Sequence[str] = ("case_id",), cut: Callable[[DataFrame], DataFrame] = materialise) -> DataFrame:
    """by, centres (array of id, l, a, b): merged clusters of each map's colours, from at most `sample` of its cells that are not excluded, picked by a hash of the place."""
    free = least_hashed(cells.where("not exclude").select(*by, "u", "v", "l", "a", "b"), F.xxhash64("u", "v", F.lit(params.seed)), params.sample, by, cut)
    kinds = dict(cells.dtypes)

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        points = pdf.sort_values(["u", "v"])[["l", "a", "b"]].to_numpy(float)
        centres, sizes = k_means(points, min(params.k_max, len(points)), params.seed)
        group = average_linkage(centres, params.merge_distance)
        rows = []
        for g in range(group.max() + 1):
            w = np.maximum(sizes[group == g], 1e-9)
            rows.append(dict(zip(("id", "l", "a", "b"), (g, *map(float, np.average(centres[group == g], axis=0, weights=w))), strict=True)))
        out = pd.DataFrame({"centres": [rows]})
        for i, name in enumerate(by):
            out.insert(i, name, pdf[name].iat[0])
        return out

    return free.groupBy(*by).applyInPandas(lambda pdf: learn(pdf), ", ".join(f"{c} {kinds[c]}" for c in by) + ", centres array<struct<id:int,l:double,a:double,b:double>>")


def nearest_label(cells: DataFrame, centres: DataFrame, by: Sequence[str] = ("case_id",)) -> DataFrame:
    """Cells (l, a, b) with the id of the nearest centre of their map (ties: smallest id)."""
    away = lambda c: F.struct((c["l"] - F.col("l")) * (c["l"] - F.col("l")) + (c["a"] - F.col("a")) * (c["a"] - F.col("a")) + (c["b"] - F.col("b")) * (c["b"] - F.col("b")), c["id"])
    return cells.join(centres, list(by)).withColumn("label", F.array_min(F.transform("centres", away))["id"]).drop("centres")


def _with_lab(pixels: DataFrame) -> DataFrame:
    names = ("l", "a", "b")
    values = lab(*(F.col(c).cast("double") for c in RGB))
    kept = [c for c in pixels.columns if c not in RGB]
    return pixels.select(*kept, F.struct(*RGB).alias("rgb"), *[v.alias(n) for v, n in zip(values, names, strict=True)])


def even_light(cells: DataFrame, labels: DataFrame, sigma: float, by: Sequence[str] = ("case_id",), cut: Callable[[DataFrame], DataFrame] = materialise) -> DataFrame:
    """Cells (l, a, b, exclude) without the slow part of their lightness: each unit's own lightness taken off, the rest averaged with wide Gaussian weights over cells that are not excluded. Maps whose light varies by two or less stay as they are."""
    unit = cells.select(*by, "u", "v", "l", "exclude").join(labels.hint("merge"), [*by, "u", "v"])
    unit = cut(unit)
    own = cut(unit.where("not exclude").groupBy(*by, "label").agg(F.avg("l").alias("_own")))
    rest = unit.join(own, [*by, "label"], "left").select(*by, "u", "v", (F.col("l") - F.col("_own")).alias("_light"), (~F.col("exclude")).alias("_use"))
    field = cut(wide_smooth(rest, sigma, "_light", "_use", by))
    strong = cut(field.groupBy(*by).agg(F.max(F.abs(F.col("_light"))).alias("_most")).where("_most > 2").select(*by))
    light = field.join(strong, list(by), "left_semi")
    return cells.join(light.hint("merge"), [*by, "u", "v"], "left").withColumn("l", clamp(F.col("l") - F.coalesce("_light", F.lit(0.0)), 0.0, 100.0)).drop("_light")


#: Reach of the fill inside a tile's margin; what is farther from a label is filled by a join.
FILL_REACH = 12


def _rim(known: np.ndarray) -> np.ndarray:
    """Known cells beside one that is not; only they can be nearest to a hole."""
    return known & ~np.logical_and.reduce([shifted(known, i, j) for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1))])


def _fill(cells: DataFrame, by: Sequence[str], cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """by, u, v, label: holes left at -1 by a tile's fill get the label of the nearest cell of a rim (of cells that were no holes)."""
    open_cells = cut(cells.where("label = -1").select(*by, "u", "v", "label"))
    if open_cells.isEmpty():
        return cells.select(*by, "u", "v", "label")
    maps = cut(open_cells.select(*by).distinct())
    rims = cells.where("rim").select(*by, "u", "v", "label").join(maps, list(by), "left_semi")
    deep = open_cells.withColumn("_hole", F.lit(True)).unionByName(rims.withColumn("_hole", F.lit(False)))
    got = nearest_fill(deep, "_hole", "label", cut, by, 4 * FILL_REACH).withColumnRenamed("label", "_far")
    joined = cells.join(got.hint("merge"), [*by, "u", "v"], "left")
    return joined.select(*by, "u", "v", F.when(F.col("label") == -1, F.col("_far")).otherwise(F.col("label")).alias("label"))


def _marked(parts: DataFrame, least: int, by: Sequence[str], cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """by, u, v, label and small: whether a cell's component has fewer than `least` cells. Small components are told to the tiles that they are in, so no task gets all cells of a large one."""
    tiles = {f"_t{c}": F.floor(F.col(c) / SIDE) for c in "uv"}
    counts = cut(parts.withColumns(tiles).groupBy(*by, *tiles, "component").count())
    small = counts.groupBy(*by, "component").agg(F.sum("count").alias("_n")).where(F.col("_n") < least)
    told = cut(counts.join(small.hint("merge"), [*by, "component"], "left_semi").select(*by, *tiles, "component", F.lit(True).alias("_s")))
    return parts.withColumns(tiles).join(unsent(told, told.count()), [*by, *tiles, "component"], "left").select(*by, "u", "v", "label", F.coalesce("_s", F.lit(False)).alias("small"))


def _labelled(cells: DataFrame, params: SegmentParams, by: Sequence[str], cut: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Labels of all cells (nearest centre, holes filled, median, small regions absorbed) and the centres."""
    centres = cut(centres_of(cells, params, by, cut))
    reach, radius = FILL_REACH, params.median_radius

    def nearest(arrays: dict[str, np.ndarray], have: np.ndarray, row: dict) -> dict[str, np.ndarray]:
        kept = sorted(row["centres"], key=lambda c: c["id"])
        away = np.stack([(arrays["l"] - c["l"]) ** 2 + (arrays["a"] - c["a"]) ** 2 + (arrays["b"] - c["b"]) ** 2 for c in kept])
        label, hole = np.array([c["id"] for c in kept])[away.argmin(0)], have & arrays["exclude"]
        return {"label": filled(label, have & ~hole, hole, reach), "rim": _rim(have & ~hole)}

    own = over_tiles(cells, by, {"l": "double", "a": "double", "b": "double", "exclude": "boolean"}, reach, nearest, {"label": "int", "rim": "boolean"}, centres)
    whole = _fill(cut(own), by, cut)
    if radius > 0:
        median = lambda arrays, have, row: {"label": lower_median(arrays["label"], have, radius)}
        whole = over_tiles(whole.where("label is not null"), by, {"label": "int"}, radius, median, {"label": "int"})
    parts = labelled_components(cut(whole), by, eight=False, label="label", cut=cut)
    marked = _marked(cut(parts), params.min_region, by, cut)
    absorb = lambda arrays, have, row: {"label": filled(arrays["label"], have & ~arrays["small"], have & arrays["small"], reach), "rim": _rim(have & ~arrays["small"])}
    done = over_tiles(marked, by, {"label": "int", "small": "boolean"}, reach, absorb, {"label": "int", "rim": "boolean"})
    return _fill(cut(done), by, cut), centres


def segment_maps(pixels: DataFrame, params: SegmentParams = SegmentParams(), light_sigma: float = 64.0, legend: DataFrame | None = None, by: Sequence[str] = ("case_id",), cut: Callable[[DataFrame], DataFrame] = materialise) -> tuple[DataFrame, DataFrame]:
    """Labels (by, u, v, label) and units (by, unit_id, name, n_px, l, a, b, role_guess) of pixels (by, u, v, r, g, b).

    Units are numbered by area, largest first; with a legend (by, unit_id, name, r, g, b) every cluster takes the nearest legend colour's number.
    """
    cells = cut(_with_lab(cleaned(pixels, params, by, cut)))
    if params.level_light:
        first, _ = _labelled(cells, replace(params, merge_distance=max(params.merge_distance, 14.0)), by, cut)
        cells = cut(even_light(cells, first, light_sigma, by, cut))
    labels, centres = _labelled(cells, params, by, cut)
    labels = cut(labels)
    colours = centres.select(*by, F.explode("centres").alias("c")).select(*by, F.col("c.id").alias("label"), "c.l", "c.a", "c.b")
    if legend is None:
        sized = labels.groupBy(*by, "label").agg(F.count("*").alias("n_px"))
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n_px"), "label")) - 1
        named = sized.withColumn("unit_id", rank.cast("int")).join(colours, [*by, "label"])
        water = cells.groupBy(*by, "u", "v").agg(F.first("water").alias("water"))
        wet = labels.join(water.hint("merge"), [*by, "u", "v"]).groupBy(*by, "label").agg(F.avg(F.col("water").cast("double")).alias("wet"))
        units = named.join(wet, [*by, "label"]).select(*by, "label", "unit_id", F.lit(None).cast("string").alias("name"), "n_px", "l", "a", "b", F.when(F.col("wet") > 0.5, "water").otherwise("strata").alias("role_guess"))
    else:
        l, a, b = lab(*(F.col(c).cast("double") for c in RGB))  # noqa: E741
        key = legend.select(*by, F.col("unit_id").cast("int").alias("id"), "name", l.alias("l"), a.alias("a"), b.alias("b"), is_water(F.col("r"), F.col("g"), F.col("b")).alias("blue"))
        packed = key.groupBy(*by).agg(F.collect_list(F.struct("id", "l", "a", "b")).alias("centres"))
        to = nearest_label(colours.withColumnRenamed("label", "_from"), packed, by).select(*by, F.col("_from").alias("label"), F.col("label").alias("unit_id"))
        sized = labels.join(to, [*by, "label"]).groupBy(*by, "unit_id").agg(F.count("*").alias("n_px"))
        units = to.join(sized, [*by, "unit_id"]).join(key.withColumnRenamed("id", "unit_id"), [*by, "unit_id"]).select(*by, "label", "unit_id", "name", "n_px", "l", "a", "b", F.when(F.col("blue"), "water").otherwise("strata").alias("role_guess"))
    units = cut(units)
    out = labels.join(units.select(*by, "label", "unit_id"), [*by, "label"]).select(*by, "u", "v", F.col("unit_id").alias("label"))
    return out, units.drop("label").distinct()
