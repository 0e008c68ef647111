"""Stencil operators on cell tables (u to the right, v down) and pixel degradations.

`by` names the columns that tell images apart (such as a case id); cells of different images never meet.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import clamp, fade
from .graph import materialise, unsent
from .tiles import Arrays, lower_median, over_tiles, shifted


def _along(axis: str, by: Sequence[str]) -> Window:
    other = "v" if axis == "u" else "u"
    return Window.partitionBy(*by, other).orderBy(axis)


def _beside(column: str, axis: str, step: int, by: Sequence[str] = ()) -> Column:
    """A column of the neighbouring cell, null where that cell is missing."""
    w, move = _along(axis, by), F.lead if step > 0 else F.lag
    return F.when(move(axis).over(w) == F.col(axis) + step, move(column).over(w))


def boundary_both(cells: DataFrame, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Both cells of each differing pair of side neighbours."""
    differs = F.lit(False)
    for axis, step in product("uv", (1, -1)):
        differs = differs | F.coalesce(_beside(label, axis, step, by) != F.col(label), F.lit(False))
    return cells.withColumn("_b", differs).where("_b").select(*by, "u", "v", label)


def boundary_upper_left(cells: DataFrame, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Only the left or upper cell of each differing pair."""
    differs = F.coalesce(_beside(label, "u", 1, by) != F.col(label), F.lit(False)) | F.coalesce(_beside(label, "v", 1, by) != F.col(label), F.lit(False))
    return cells.withColumn("_b", differs).where("_b").select(*by, "u", "v", label)


def adjacent_pairs(cells: DataFrame, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Counts of unordered label pairs over side neighbours."""
    beside = cells.select(*by, F.col(label).alias("a"), _beside(label, "u", 1, by).alias("_right"), _beside(label, "v", 1, by).alias("_down"))
    pairs = beside.select(*by, "a", F.explode(F.array("_right", "_down")).alias("b")).where("a <> b")
    return pairs.groupBy(*by, F.least("a", "b").alias("unit_a"), F.greatest("a", "b").alias("unit_b")).agg(F.count("*").alias("n"))


def offsets(kind: str, radius: int) -> list[tuple[int, int]]:
    """Cells of a square, disc or cross, the middle included."""
    return [(a, b) for a, b in product(range(-radius, radius + 1), repeat=2) if kind == "square" or (kind == "disc" and a * a + b * b <= radius * radius) or (kind == "cross" and 0 in (a, b))]


def _shifted(cells: DataFrame, shape: list[tuple[int, int]], *columns: str) -> DataFrame:
    """Each cell's columns at every place of the shape around it."""
    moved = F.explode(F.array(*[F.struct((F.col("u") + a).alias("u"), (F.col("v") + b).alias("v")) for a, b in shape]))
    return cells.select(*columns, moved.alias("_c")).select("_c.u", "_c.v", *columns)


def dilate(mask: DataFrame, shape: list[tuple[int, int]], by: Sequence[str] = ()) -> DataFrame:
    """Cells that the shape covers when it is laid on each cell of a mask (u, v)."""
    return _shifted(mask, shape, *by).select(*by, "u", "v").distinct()


def erode(mask: DataFrame, shape: list[tuple[int, int]], by: Sequence[str] = ()) -> DataFrame:
    """Cells on which the whole shape lies inside the mask."""
    moved = _shifted(mask.select(*by, "u", "v").distinct(), [(-a, -b) for a, b in shape], *by)
    return moved.groupBy(*by, "u", "v").count().where(F.col("count") == len(shape)).select(*by, "u", "v")


def opening(mask: DataFrame, shape: list[tuple[int, int]], by: Sequence[str] = ()) -> DataFrame:
    return dilate(erode(mask, shape, by), shape, by)


def degree(mask: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Number of mask cells among the eight neighbours of each mask cell."""
    around = [x for x in offsets("square", 1) if x != (0, 0)]
    counted = _shifted(mask, around, *by).groupBy(*by, "u", "v").agg(F.count("*").alias("degree"))
    return mask.select(*by, "u", "v").join(counted, [*by, "u", "v"], "left").select(*by, "u", "v", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def _by_tiles(cells: DataFrame, value: str, kind: str, margin: int, run: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], by: Sequence[str]) -> DataFrame:
    """by, u, v and what run(values, where they are known, where cells are) finds in tiles: values, and where they are known; elsewhere null."""
    rows = cells.select(*by, "u", "v", F.coalesce(F.col(value).cast(kind), F.lit(0).cast(kind)).alias("_x"), F.col(value).isNotNull().alias("_known"))

    def work(arrays: Arrays, have: np.ndarray, row: dict) -> Arrays:
        x, known = run(arrays["_x"], arrays["_known"], have)
        return {"_x": x, "_known": known}

    names = {"_x": kind, "_known": "boolean"}
    kinds = dict(cells.dtypes)
    return over_tiles(rows, by, names, margin, work, names).select(*by, *[F.col(c).cast(kinds[c]).alias(c) for c in "uv"], F.when(F.col("_known"), F.col("_x")).alias(value))


def median_filter(cells: DataFrame, radius: int, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Lower median of the values in a square around each cell; missing cells are left out. Whole numbers are sorted as arrays of tiles."""
    kind = dict(cells.dtypes)[label]
    if kind in ("tinyint", "smallint", "int", "bigint"):
        around = lambda a: np.logical_or.reduce([shifted(a, i, j) for i, j in offsets("square", radius)])
        found = _by_tiles(cells, label, "long", radius, lambda x, known, have: (lower_median(x, known, radius), around(known)), by)
        return found.withColumn(label, F.col(label).cast(kind))
    spread = _shifted(cells, offsets("square", radius), *by, label).repartition(*by, "u", "v").groupBy(*by, "u", "v").agg(F.array_sort(F.collect_list(label)).alias("_all"))
    middle = spread.select(*by, "u", "v", F.get("_all", F.expr("cast((size(_all) - 1) div 2 as int)")).alias(label))
    return middle.join(cells.select(*by, "u", "v"), [*by, "u", "v"], "left_semi")


def smooth(cells: DataFrame, weights: list[float], value: str = "z", by: Sequence[str] = ()) -> DataFrame:
    """Separable weighted mean along rows, then columns, in tiles; weights reach from the middle outwards and are normalised over the cells that exist."""
    reach = len(weights) - 1

    def run(x: np.ndarray, known: np.ndarray, have: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for axis in (0, 1):
            total, weight, some = np.zeros(x.shape), np.zeros(x.shape), np.zeros(x.shape, bool)
            for d in range(-reach, reach + 1):
                step, w = ((d, 0) if axis == 0 else (0, d)), weights[abs(d)]
                there = shifted(known, *step)
                total += np.where(there, w * shifted(x, *step), 0.0)
                weight += w * shifted(have, *step)
                some |= there
            known = have & some
            x = np.divide(total, weight, out=np.zeros(x.shape), where=known)
        return x, known

    return _by_tiles(cells, value, "double", reach, run, by)


def wide_smooth(cells: DataFrame, sigma: float, value: str = "z", mask: str | None = None, by: Sequence[str] = (), truncate: float = 4.0) -> DataFrame:
    """by, u, v and the value averaged with Gaussian weights (cut off at truncate times sigma along each axis) over the cells of the mask (a boolean column; all cells without one), null where none is in reach.

    The masked values and the mask are each convolved along rows, then along columns; their quotient is the normalised mean. A task works on whole rows as arrays, so
    there is one shuffle an axis, and the work of a cell grows with sigma, not with its square as that of one wide stencil would.
    """
    reach = int(truncate * sigma + 0.5)
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma)) if sigma > 0 else np.ones(1)
    inside = F.coalesce(F.col(mask), F.lit(False)) if mask else F.lit(True)
    use = inside & F.col(value).isNotNull()
    out = cells.select(*by, F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), F.when(use, F.col(value)).otherwise(0.0).cast("double").alias("_s"), use.cast("double").alias("_w"))

    def along(axis: str, other: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    at, *values = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (axis, "_s", "_w"))
                    row, places = np.zeros(at.max() - at.min() + 1), at - at.min()
                    found = []
                    for x in values:
                        line = row.copy()
                        line[places] = x
                        found.append(pa.array(np.convolve(line, kernel)[len(kernel) // 2 :][places]))
                    same = pa.array(np.full(len(at), i))
                    names = {axis: pa.array(at), other: batch.column(other).take(same), "_s": found[0], "_w": found[1]}
                    yield pa.RecordBatch.from_arrays([*[batch.column(c).take(same) for c in by], *names.values()], [*by, *names])

        return run

    for axis, other in ("uv", "vu"):
        packed = out.repartition(*by, other).groupBy(*by, other).agg(*[F.collect_list(c).alias(c) for c in (axis, "_s", "_w")])
        schema = out.select(*by, axis, other, "_s", "_w").schema
        out = packed.mapInArrow(along(axis, other), schema)
    return out.select(*by, F.col("u").cast("int").alias("u"), F.col("v").cast("int").alias("v"), F.when(F.col("_w") > 1e-12, F.col("_s") / F.col("_w")).alias(value))


def gradient(cells: DataFrame, value: str = "z", by: Sequence[str] = ()) -> DataFrame:
    """du and dv: central differences, one-sided where a neighbour is missing, 0 where both are."""

    def slope(axis: str) -> Column:
        before, after = _beside(value, axis, -1, by), _beside(value, axis, 1, by)
        return F.coalesce((after - before) / 2.0, after - F.col(value), F.col(value) - before, F.lit(0.0))

    return cells.select(*by, "u", "v", value, slope("u").alias("du"), slope("v").alias("dv"))


def nearest_fill(cells: DataFrame, hole: str = "hole", label: str = "label", cut: Callable[[DataFrame], DataFrame] = materialise, by: Sequence[str] = (), reach: int = 2) -> DataFrame:
    """Gives hole cells the label of the nearest other cell (ties: smallest label), looking at rings of growing radius.

    Each round takes four times the reach of the last and joins only the cells still open; a round's answer counts once
    no cell beyond its reach can be nearer. The reach grows until no cell is open, so only cells of a table
    without a labelled cell keep a null. A labelled cell whose four side neighbours are labelled is nearest to
    no hole (the one towards the hole is nearer), so only the others are joined. The first round looks as far as reach.
    """
    filled = cells.where(~F.col(hole))
    inner = _shifted(filled.select(*by, "u", "v").distinct(), [(1, 0), (-1, 0), (0, 1), (0, -1)], *by).groupBy(*by, "u", "v").count().where("count = 4").select(*by, "u", "v")
    known_cells = cut(filled.join(inner.hint("merge"), [*by, "u", "v"], "left_anti").select(*by, F.col("u").alias("ku"), F.col("v").alias("kv"), F.col(label).alias("kl")))
    left, out = cut(cells.where(hole).select(*by, "u", "v")), filled.select(*by, "u", "v", label)
    (u0, u1, v0, v1, known) = known_cells.agg(F.min("ku"), F.max("ku"), F.min("kv"), F.max("kv"), F.count("*")).first()
    (a0, a1, b0, b1) = left.agg(F.min("u"), F.max("u"), F.min("v"), F.max("v")).first()
    far = -1 if None in (u0, v0, a0, b0) else max(u1 - a0, a1 - u0) + max(v1 - b0, b1 - v0)  # no pair is farther apart
    last = 0
    while last < far and (open_cells := left.count()):
        grid = lambda c: F.floor(F.col(c) / reach)  # noqa: E731, B023
        near = F.array(*[F.struct((grid("u") + a).alias("gu"), (grid("v") + b).alias("gv")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
        du, dv = (F.col("u") - F.col("ku")).cast("long"), (F.col("v") - F.col("kv")).cast("long")
        d2 = du * du + dv * dv
        found = (
            left.withColumn("_g", F.explode(near)).select(*by, "u", "v", "_g.gu", "_g.gv")
            .join(unsent(known_cells.withColumn("gu", grid("ku")).withColumn("gv", grid("kv")), min(known, 9 * open_cells)), [*by, "gu", "gv"])
            .where(d2 <= reach * reach).groupBy(*by, "u", "v").agg(F.min(F.struct(d2.alias("d2"), F.col("kl"))).alias("best"))
        )
        got = cut(found.select(*by, "u", "v", F.col("best.kl").alias(label)))
        out = out.unionByName(got)
        left = cut(left.join(unsent(got, open_cells), [*by, "u", "v"], "left_anti"))
        last, reach = reach, reach * 4
    return out.unionByName(left.withColumn(label, F.lit(None).cast(dict(cells.dtypes)[label])))


def iso_crossings(cells: DataFrame, interval: float, value: str = "z", by: Sequence[str] = ()) -> DataFrame:
    """Where contours of a height field cross the edges between side neighbours: level, u, v."""
    parts = []
    for axis in "uv":
        nxt = _beside(value, axis, 1, by)
        edge = cells.select(*by, "u", "v", F.col(value).alias("a"), nxt.alias("b")).where("b is not null and a <> b")
        lo, hi = F.floor(F.least("a", "b") / interval) + 1, F.floor(F.greatest("a", "b") / interval)
        hit = edge.where(hi >= lo).withColumn("_n", F.explode(F.sequence(lo, hi))).withColumn("level", F.col("_n") * interval)
        t = (F.col("level") - F.col("a")) / (F.col("b") - F.col("a"))
        parts.append(hit.select(*by, "level", *(((F.col(c) + t) if c == axis else F.col(c).cast("double")).alias(c) for c in "uv")))
    return parts[0].unionByName(parts[1])


# Strengths of the degradations at severities 1 to 4.
NOISE, FADE, BREAKS, BREAK_RADIUS = (4.0, 8.0, 16.0, 28.0), (0.15, 0.30, 0.45, 0.60), (30, 60, 120, 240), (3, 4, 6, 8)
BLUR, GAIN, STAIN_ALPHA = (0.7, 1.2, 2.0, 3.2), (0.10, 0.18, 0.28, 0.40), (0.18, 0.28, 0.38, 0.50)
STAIN, STAIN_REACH, STAINS = (160.0, 120.0, 60.0), (25.0, 20.0, 20.0), ((2, 3), (3, 5), (4, 6), (6, 8))


RGB = ("r", "g", "b")


def _channels(change: Callable[[str], Column], integer: bool = True) -> list[Column]:
    """Each channel changed, cut off to 0..255 and, unless rounded before, truncated."""
    return [clamp(change(c), 0.0, 255.0).cast("int" if integer else "double").alias(c) for c in RGB]


def _unit(seed: int, *salt) -> Column:
    """A hashed number between 0 and 1."""
    return (F.pmod(F.xxhash64(F.lit(seed), *[F.lit(x) if not isinstance(x, Column) else x for x in salt]), F.lit(1 << 30)) + 0.5) / float(1 << 30)


def noisy(pixels: DataFrame, severity: int, seed: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """Normal noise on each channel of (u, v, r, g, b), reproducible from the cell and the seed, cut off to 0..255."""
    sigma, cell = NOISE[severity - 1], [F.col(c) for c in (*by, "u", "v")]
    normal = {c: F.sqrt(-2.0 * F.log(_unit(seed, *cell, 2 * k))) * F.cos(2 * math.pi * _unit(seed, *cell, 2 * k + 1)) for k, c in enumerate(RGB)}
    return pixels.select(*by, "u", "v", *_channels(lambda c: F.col(c) + sigma * normal[c]))


def _cubic(t: Column) -> list[Column]:
    """Weights of the four knots around a place, by the cubic convolution kernel with -0.75 that image resizing uses."""
    a = -0.75
    near = lambda x: ((a + 2) * x - (a + 3)) * x * x + 1
    far = lambda x: ((a * x - 5 * a) * x + 8 * a) * x - 4 * a
    return [far(t + 1), near(t), near(1 - t), far(2 - t)]


def uneven_light(pixels: DataFrame, severity: int, width: int, height: int, seed: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """Multiplies by a smooth gain of 1 plus or minus at most the strength: a field of 4 x 4 random knots (hashed from the image and the seed), upsampled by cubic convolution and scaled to its largest knot."""
    knots = [[_unit(seed, *[F.col(c) for c in by], 7, i, j) * 2 - 1 for i in range(4)] for j in range(4)]
    most = F.greatest(*[F.abs(k) for row in knots for k in row])
    place = {axis: F.greatest(F.lit(-0.5), F.least((F.col(axis) + 0.5) * 4.0 / size - 0.5, F.lit(3.5))) for axis, size in (("u", width), ("v", height))}
    base = {axis: F.floor(x) for axis, x in place.items()}
    weight = {axis: _cubic(place[axis] - base[axis]) for axis in "uv"}

    def blend(values: list[Column], axis: str) -> Column:
        """The knots beyond an edge are those of the edge."""
        at = lambda k: F.element_at(F.array(*values), (F.greatest(F.lit(0), F.least(base[axis] + k, F.lit(3))) + 1).cast("int"))
        return sum(w * at(k) for k, w in zip((-1, 0, 1, 2), weight[axis], strict=True))

    field = blend([blend(row, "u") for row in knots], "v") / most
    lit = pixels.withColumn("_gain", 1 + GAIN[severity - 1] * clamp(field, -1.0, 1.0))
    return lit.select(*by, "u", "v", *_channels(lambda c: F.col(c) * F.col("_gain")))


def stained(pixels: DataFrame, severity: int, width: int, height: int, seed: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """Blends turned ellipses of a stain colour over the pixels, one after the other, strongest in the middle and gone at the edge; their number, places, axes, turns and strengths are hashed from the image and the seed."""
    size, key = float(min(width, height)), [F.col(c) for c in by]
    draw = lambda k, j, lo, hi: lo + (hi - lo) * _unit(seed, *key, 11, k, j)
    fewest, most = STAINS[severity - 1]
    number, out = F.floor(draw(0, 9, float(fewest), most + 1.0)), pixels
    for k in range(most):
        cu, cv, ru, rv, turn = draw(k, 0, 0.0, float(width)), draw(k, 1, 0.0, float(height)), draw(k, 2, 0.05, 0.2) * size + 2, draw(k, 3, 0.05, 0.2) * size + 2, draw(k, 4, 0.0, math.pi)
        du, dv = F.col("u") - cu, F.col("v") - cv
        x, y = (du * F.cos(turn) + dv * F.sin(turn)) / ru, (dv * F.cos(turn) - du * F.sin(turn)) / rv
        alpha = F.when(k < number, STAIN_ALPHA[severity - 1] * draw(k, 5, 0.7, 1.2) * clamp(1.5 - x * x - y * y, 0.0, 1.0)).otherwise(0.0)
        stain = {c: middle + draw(k, 6 + i, -reach, reach) for i, (c, middle, reach) in enumerate(zip(RGB, STAIN, STAIN_REACH, strict=True))}
        out = out.withColumn("_alpha", alpha).select(*by, "u", "v", *[(F.col(c) * (1 - F.col("_alpha")) + stain[c] * F.col("_alpha")).alias(c) for c in RGB])
    return out.select(*by, "u", "v", *_channels(F.col))


def broken_lines(pixels: DataFrame, severity: int, seed: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """Rubs out discs around hash-picked dark pixels of each image: their pixels take the colour of the nearest pixel outside."""
    n, radius = BREAKS[severity - 1], BREAK_RADIUS[severity - 1]
    dark = pixels.where(F.col("r") * 0.299 + F.col("g") * 0.587 + F.col("b") * 0.114 < 110)
    order = [F.xxhash64("u", "v", F.lit(seed)), F.col("u"), F.col("v")]
    picked = dark.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n) if by else dark.orderBy(*order).limit(n)
    disc = dilate(picked, offsets("disc", radius), by).withColumn("_in", F.lit(True))
    marked = pixels.join(disc, [*by, "u", "v"], "left").select(*by, "u", "v", F.struct("r", "g", "b").alias("rgb"), F.coalesce("_in", F.lit(False)).alias("hole"))
    return nearest_fill(marked, label="rgb", by=by).select(*by, "u", "v", "rgb.*")


def blurred(pixels: DataFrame, severity: int, by: Sequence[str] = ()) -> DataFrame:
    sigma = BLUR[severity - 1]
    weights = [math.exp(-d * d / (2 * sigma * sigma)) for d in range(int(3 * sigma) + 2)]
    out = None
    for c in RGB:
        one = smooth(pixels.select(*by, "u", "v", F.col(c).cast("double").alias(c)), weights, c, by)
        out = one if out is None else out.join(one, [*by, "u", "v"])
    return out.select(*by, "u", "v", *_channels(F.rint))


def faded(pixels: DataFrame, severity: int, by: Sequence[str] = ()) -> DataFrame:
    r, g, b = fade(F.col("r"), F.col("g"), F.col("b"), FADE[severity - 1])
    return pixels.select(*by, "u", "v", r.alias("r"), g.alias("g"), b.alias("b"))


DEGRADATIONS = {"noise": noisy, "blur": blurred, "fade": faded, "line_break": broken_lines, "illumination": uneven_light, "stain": stained}
#: Degradations that need the size of the image.
SIZED = {"illumination", "stain"}


def degrade(pixels: DataFrame, kind: str, severity: int, **more) -> DataFrame:
    """Applies one kind at severity 1 to 4."""
    if kind not in DEGRADATIONS or severity not in (1, 2, 3, 4):
        raise ValueError(f"no degradation {kind} of severity {severity}")
    return DEGRADATIONS[kind](pixels, severity, **more)


def apply_profile(pixels: DataFrame, profile: list[tuple[str, int]], width: int, height: int, seed: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """Applies kinds one after the other, each with a seed of its own."""
    for k, (kind, severity) in enumerate(profile):
        seeded = {} if kind in ("blur", "fade") else {"seed": seed + k}
        pixels = degrade(pixels, kind, severity, by=by, **seeded, **({"width": width, "height": height} if kind in SIZED else {}))
    return pixels
