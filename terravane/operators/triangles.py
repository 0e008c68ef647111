"""Delaunay triangulation of scattered points in tiles, and heights between them.

A tile's task sees its own points and those of the tiles around it, and builds the fan of triangles around each of its points. A triangle is
final if no point can lie in its circumcircle beyond what the task sees; for that the convex hull of all points is known to every task, so
that circles that only leave it are no obstacle. Points with a triangle in doubt are tried again with a wider
surrounding, so the triangles are those of all points together, and no task holds all points but where few, wide triangles need them.

Circles through more than three points have no single triangulation, so the tests see every point moved by a tiny step that only
depends on its place: all tasks decide alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import cut_lineage
from .spatial import nearest_values

#: Points of a tile, about, and the step that breaks ties (in units of the points).
TILE_POINTS, NUDGE = 200, 1e-5
VERTEX = "struct<id:{id},x:double,y:double,z:double>"


def convex_hull(xy: np.ndarray) -> np.ndarray:
    """Indices of the hull's corners, counter-clockwise from the leftmost."""
    order = np.lexsort((xy[:, 1], xy[:, 0]))
    half = []
    for run in (order, order[::-1]):
        line: list[int] = []
        for i in run:
            while len(line) > 1:
                (ax, ay), (bx, by), (cx, cy) = xy[line[-2]], xy[line[-1]], xy[i]
                if (bx - ax) * (cy - ay) - (by - ay) * (cx - ax) > 0:
                    break
                line.pop()
            line.append(int(i))
        half += line[:-1]
    return np.array(half if half else order[:1], int)


def _beyond(hull: np.ndarray, axis: int, bound: float, sign: int) -> np.ndarray:
    """The part of a convex polygon where sign * coordinate exceeds sign * bound."""
    out = []
    for p, q in zip(hull, np.roll(hull, -1, 0), strict=True):
        a, b = sign * (p[axis] - bound), sign * (q[axis] - bound)
        if a > 0:
            out.append(p)
        if (a > 0) != (b > 0):
            out.append(p + (q - p) * (a / (a - b)))
    return np.array(out).reshape(-1, 2)


def _distance(polygon: np.ndarray, c: np.ndarray) -> float:
    """Distance of a point from a convex polygon (0 inside)."""
    edge = np.roll(polygon, -1, 0) - polygon
    rest = c - polygon
    if len(polygon) > 2 and (edge[:, 0] * rest[:, 1] - edge[:, 1] * rest[:, 0] >= 0).all():
        return 0.0
    t = np.clip((rest * edge).sum(1) / np.maximum((edge * edge).sum(1), 1e-300), 0, 1)
    return float(np.sqrt(((rest - t[:, None] * edge) ** 2).sum(1)).min())


class Surroundings:
    """Points that a task sees, the rectangle in which it sees all of them, and the hull of all points."""

    def __init__(self, xy: np.ndarray, seen: tuple[float, float, float, float], hull: np.ndarray):
        self.x, self.y, self.seen = xy[:, 0].copy(), xy[:, 1].copy(), seen
        x0, x1, y0, y1 = seen
        self.hidden = [p for p in (_beyond(hull, 0, x0, -1), _beyond(hull, 0, x1, 1), _beyond(hull, 1, y0, -1), _beyond(hull, 1, y1, 1)) if len(p)]
        self.edges = {(*p, *q) for p, q in zip(hull.tolist(), np.roll(hull, -1, 0).tolist(), strict=True)}
        self.known: dict[tuple[int, int], int | None] = {}

    def apex(self, i: int, j: int) -> int | None:
        """The point left of i -> j that sees it under the largest angle; -1 for an edge of the hull, None if points may be hidden."""
        if (i, j) in self.known:
            return self.known[i, j]
        ax, ay, bx, by = self.x - self.x[i], self.y - self.y[i], self.x - self.x[j], self.y - self.y[j]
        left = (self.x[j] - self.x[i]) * ay - (self.y[j] - self.y[i]) * ax
        left[[i, j]] = 0
        k = np.flatnonzero(left > 0)
        if not len(k):
            self.known[i, j] = -1 if not self.hidden or (self.x[j], self.y[j], self.x[i], self.y[i]) in self.edges else None
            return self.known[i, j]
        best = int(k[np.argmin((ax[k] * bx[k] + ay[k] * by[k]) / left[k])])
        if not self.certain(i, j, best):
            self.known[i, j] = None
            return None
        self.known[i, j], self.known[j, best], self.known[best, i] = best, i, j
        return best

    def certain(self, i: int, j: int, k: int) -> bool:
        """Whether no point can be hidden in the circle through three points."""
        bx, by, cx, cy = self.x[j] - self.x[i], self.y[j] - self.y[i], self.x[k] - self.x[i], self.y[k] - self.y[i]
        d = 2 * (bx * cy - by * cx)
        ux, uy = (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / d, (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / d
        r, c = float(np.hypot(ux, uy)), np.array([self.x[i] + ux, self.y[i] + uy])
        x0, x1, y0, y1 = self.seen
        if x0 <= c[0] - r and c[0] + r <= x1 and y0 <= c[1] - r and c[1] + r <= y1:
            return True
        return all(_distance(p, c) >= r * (1 - 1e-12) for p in self.hidden)

    def fan(self, i: int) -> list[tuple[int, int, int]] | None:
        """The triangles around a point, None if one is in doubt."""
        away = (self.x - self.x[i]) ** 2 + (self.y - self.y[i]) ** 2
        away[i] = np.inf
        if not np.isfinite(away).any():
            return None if self.hidden else []
        first = now = int(np.argmin(away))
        out: list[tuple[int, int, int]] = []
        while True:  # counter-clockwise until the fan is closed or the hull is met
            k = self.apex(i, now)
            if k is None:
                return None
            if k == -1:
                break
            out.append((i, now, k))
            if k == first:
                return out
            now = k
        now = first
        while (k := self.apex(now, i)) != -1:
            if k is None:
                return None
            out.append((i, k, now))
            now = k
        return out


def _nudged(x: Column, y: Column) -> list[Column]:
    """The place that the tests see: the bits of a hash of the place move it by NUDGE at most."""
    step = lambda seed: (F.pmod(F.xxhash64(x, y, F.lit(seed)), F.lit(1 << 20)) / float(1 << 20) - 0.5) * NUDGE
    return [(x + step(1)).alias("px"), (y + step(2)).alias("py")]


def _hulls(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, hull (corners as arrays of two) of the nudged points: those of tiles first, then of their corners."""
    kinds = dict(points.dtypes)
    names = ", ".join(f"{c} {kinds[c]}" for c in by)

    def corners(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[convex_hull(pdf[["px", "py"]].to_numpy())]

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        xy = corners(pdf)[["px", "py"]].to_numpy()
        return pd.DataFrame({**{c: [pdf[c].iat[0]] for c in by}, "hull": [xy.tolist()]})

    few = points.select(*by, "tu", "tv", "px", "py").groupBy(*by, "tu", "tv").applyInPandas(lambda pdf: corners(pdf)[[*by, "px", "py"]], f"{names}, px double, py double")
    return few.groupBy(*by).applyInPandas(lambda pdf: whole(pdf), f"{names}, hull array<array<double>>")


def triangulate(points: DataFrame, by: Sequence[str] = ("case_id",), cut: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """by, a, b, c: the Delaunay triangles of points (by, id, x, y, z) of each group, corners (id, x, y, z) in the order of their ids.

    Points at one place count as one, with the smallest id and the mean height. Groups of fewer than three places have no triangle.
    """
    kinds = dict(points.dtypes)
    rows = points.dropna(subset=["x", "y", "z"]).groupBy(*by, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).agg(F.min("id").alias("id"), F.avg("z").alias("z"))
    about = cut(rows.groupBy(*by).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.sqrt(F.greatest((F.max("x") - F.min("x")) * (F.max("y") - F.min("y")), F.lit(1e-12)) / F.count("*") * TILE_POINTS).alias("side")))
    placed = rows.join(about, list(by)).select(*by, "id", "x", "y", "z", *_nudged(F.col("x"), F.col("y")), "x0", "y0", "side", F.floor((F.col("x") - F.col("x0")) / F.col("side")).alias("tu"), F.floor((F.col("y") - F.col("y0")) / F.col("side")).alias("tv"))
    placed = cut(placed)
    hulls = cut(_hulls(placed, by))
    ends = placed.agg(F.max("tu"), F.max("tv")).first()
    most = max((e for e in ends if e is not None), default=0)
    vertex = VERTEX.format(id=kinds["id"])
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in by], f"open {kinds['id']}", *[f"{c} {vertex}" for c in "abc"]])
    tile = [*by, "tu", "tv"]

    def run(pdf: pd.DataFrame, frame: pd.DataFrame, reach: int) -> pd.DataFrame:
        tu, tv, side, x0, y0 = (frame[c].iat[0] for c in ("_tu", "_tv", "side", "x0", "y0"))
        seen = (x0 + (tu - reach) * side + NUDGE, x0 + (tu + reach + 1) * side - NUDGE, y0 + (tv - reach) * side + NUDGE, y0 + (tv + reach + 1) * side - NUDGE)
        xy = pdf[["px", "py"]].to_numpy()
        around = Surroundings(xy, seen, np.array([list(p) for p in frame["hull"].iat[0]]))
        place = lambda k: (xy[k, 0], xy[k, 1])
        ids, x, y, z = (pdf[c].to_numpy() for c in ("id", "x", "y", "z"))
        corner = lambda k: {"id": ids[k].item() if isinstance(ids[k], np.generic) else ids[k], "x": float(x[k]), "y": float(y[k]), "z": float(z[k])}
        doubt, found = [], []
        for i in np.flatnonzero(pdf["asked"].to_numpy()):
            fan = around.fan(int(i))
            if fan is None:
                doubt.append(corner(i)["id"])
            else:  # a triangle is given by the first of its corners
                found += [sorted((corner(k) for k in t), key=lambda c: c["id"]) for t in fan if place(i) == min(place(k) for k in t)]
        columns = {**{c: [frame[c].iat[0]] * (len(doubt) + len(found)) for c in by}, "open": doubt + [None] * len(found)}
        columns |= {c: [None] * len(doubt) + [t[n] for t in found] for n, c in enumerate("abc")}
        return pd.DataFrame(columns, dtype=object)

    asked, reach, out = placed.select(*by, "id", "tu", "tv"), 1, None
    while True:
        tiles = asked.select(*tile).distinct().withColumns({"_tu": F.col("tu"), "_tv": F.col("tv")})
        span = F.sequence(F.lit(-reach), F.lit(reach))
        wide = tiles.withColumn("tu", F.explode(F.transform(span, lambda d: F.col("_tu") + d))).withColumn("tv", F.explode(F.transform(span, lambda d: F.col("_tv") + d)))
        given = placed.join(asked.select(*by, "id", F.lit(True).alias("asked")), [*by, "id"], "left") if reach > 1 else placed.withColumn("asked", F.lit(True))
        near = wide.join(given.drop("x0", "y0", "side"), tile).withColumn("asked", F.coalesce("asked", F.lit(False)) & (F.col("tu") == F.col("_tu")) & (F.col("tv") == F.col("_tv")))
        # a tile's frame and the hull come once beside its points, not on each of them
        frames = tiles.drop("tu", "tv").join(about, list(by)).join(hulls, list(by))
        frames = frames.select(*[F.col(c).alias(c) for c in frames.columns])
        keys = [*by, "_tu", "_tv"]
        got = cut(near.groupBy(*keys).cogroup(frames.groupBy(*keys)).applyInPandas((lambda r: lambda pdf, frame: run(pdf, frame, r))(reach), schema))
        done = got.where("open is null").select(*by, "a", "b", "c")
        out = done if out is None else out.unionByName(done)
        doubt = got.where("open is not null").select(*by, F.col("open").alias("id"))
        if reach > most or doubt.isEmpty():
            return out
        asked = cut(placed.select(*by, "id", "tu", "tv").join(doubt, [*by, "id"], "left_semi"))
        reach *= 4


def rasterise(triangles: DataFrame, by: Sequence[str] = ("case_id",)) -> DataFrame:
    """by, u, v, z: heights at the whole-numbered places that triangles cover, linear between the corners.

    Each triangle gives the places of its own rows of cells, so nothing is joined; on common edges the triangles agree but for rounding, and the mean is taken.
    """
    x, y, z = ([F.col(f"{p}.{c}") for p in "abc"] for c in "xyz")
    area = (x[1] - x[0]) * (y[2] - y[0]) - (x[2] - x[0]) * (y[1] - y[0])
    low, high = F.ceil(F.least(*y) - 1e-9), F.floor(F.greatest(*y) + 1e-9)
    rows = triangles.where((F.abs(area) > 1e-9) & (low <= high)).withColumn("v", F.explode(F.sequence(low, high)))

    def crossing(i: int, j: int) -> Column:
        """Where the row meets an edge; null if it does not."""
        at = x[i] + (F.col("v") - y[i]) / (y[j] - y[i]) * (x[j] - x[i])
        return F.when((y[i] != y[j]) & (F.col("v") >= F.least(y[i], y[j]) - 1e-9) & (F.col("v") <= F.greatest(y[i], y[j]) + 1e-9), F.greatest(F.least(x[i], x[j]), F.least(at, F.greatest(x[i], x[j]))))

    cross = [crossing(0, 1), crossing(1, 2), crossing(2, 0)]
    lo, hi = F.ceil(F.least(*cross) - 1e-9), F.floor(F.greatest(*cross) + 1e-9)
    cells = rows.withColumns({"_lo": lo, "_hi": hi}).where("_lo <= _hi").withColumn("u", F.explode(F.sequence("_lo", "_hi")))
    wb = ((F.col("u") - x[0]) * (y[2] - y[0]) - (F.col("v") - y[0]) * (x[2] - x[0])) / area
    wc = ((x[1] - x[0]) * (F.col("v") - y[0]) - (y[1] - y[0]) * (F.col("u") - x[0])) / area
    value = z[0] + wb * (z[1] - z[0]) + wc * (z[2] - z[0])
    return cells.select(*by, F.col("u").cast("int").alias("u"), F.col("v").cast("int").alias("v"), value.alias("z")).groupBy(*by, "u", "v").agg(F.avg("z").alias("z"))


def heights(cells: DataFrame, points: DataFrame, by: Sequence[str] = ("case_id",), cut: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """Cells (by, u, v) with z: linear on the triangles of points (by, id, x, y, z), that of the nearest point outside of them (ties: smallest); null where a group has no point."""
    inside = rasterise(triangulate(points, by, cut), by)
    known = cut(cells.select(*by, "u", "v").join(inside, [*by, "u", "v"], "left"))
    bare = known.where("z is null").select(*by, F.struct("u", "v").alias("id"), F.col("u").cast("double").alias("x"), F.col("v").cast("double").alias("y"))
    sites = points.dropna(subset=["x", "y", "z"]).select(*by, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("z").cast("double").alias("z"))
    found = nearest_values(bare, sites, "z", 8.0, by, cut).select(*by, "id.u", "id.v", "z")
    return known.where("z is not null").unionByName(found)
