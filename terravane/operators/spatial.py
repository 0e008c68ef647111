"""Distance joins on grid cells, nearest neighbours and bilinear sampling."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import cut_lineage


def _cells(df: DataFrame, x: str, y: str, size: float, around: bool) -> DataFrame:
    """Adds the grid cell of a point, or the nine cells around it."""
    cx, cy = F.floor(F.col(x) / size), F.floor(F.col(y) / size)
    if not around:
        return df.withColumn("_cx", cx).withColumn("_cy", cy)
    near = F.array(*[F.struct((cx + a).alias("cx"), (cy + b).alias("cy")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    return df.withColumn("_cell", F.explode(near)).withColumn("_cx", F.col("_cell.cx")).withColumn("_cy", F.col("_cell.cy")).drop("_cell")


def within(left: DataFrame, right: DataFrame, radius: float, x: str = "x", y: str = "y", on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of points at most `radius` apart: all columns as structs l and r, and dist.

    One side stands in its own grid cell, the other in nine, so the distance join is an equi-join that
    shuffles by cell; the exact distance is tested after it. Neither side is broadcast: the nine copies are made after the size of a
    side is guessed, and a table of any size may be on it.
    """
    l = _cells(left.select(*on, F.struct(*left.columns).alias("l"), F.col(x).alias("_x"), F.col(y).alias("_y")), "_x", "_y", radius, False)  # noqa: E741
    r = _cells(right.select(*on, F.struct(*right.columns).alias("r"), F.col(x).alias("_u"), F.col(y).alias("_v")), "_u", "_v", radius, True)
    dx, dy = F.col("_x") - F.col("_u"), F.col("_y") - F.col("_v")
    square = dx * dx + dy * dy
    return l.join(r.hint("merge"), [*on, "_cx", "_cy"]).where(square <= radius * radius).select(*on, "l", "r", F.sqrt(square).alias("dist"))


def pairs_within(points: DataFrame, radius: float, id_column: str, x: str = "x", y: str = "y") -> DataFrame:
    """Unordered pairs of one set, as (a, b, dist) with a < b."""
    found = within(points.select(id_column, x, y), points.select(id_column, x, y), radius, x, y)
    a, b = F.col(f"l.{id_column}"), F.col(f"r.{id_column}")
    return found.where(a < b).select(a.alias("a"), b.alias("b"), "dist")


#: Targets of a grid cell at most when the search for the nearest begins, and how many times the reach may be quartered for that.
CELL_TARGETS, QUARTERS = 64, 8


def _reaches(targets: DataFrame, radius: float) -> list[float]:
    """The reaches, each four times the last and the radius at the end, from the widest whose cells hold few targets (x, y)."""
    levels = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(radius / 4**k).alias("size")) for k in range(QUARTERS + 1)]))
    cells = targets.select("x", "y", levels.alias("_l")).groupBy("_l.k", F.floor(F.col("x") / F.col("_l.size")), F.floor(F.col("y") / F.col("_l.size"))).count()
    fullest = {r["k"]: r["n"] for r in cells.groupBy("k").agg(F.max("count").alias("n")).collect()}
    first = next((k for k in range(QUARTERS + 1) if fullest.get(k, 0) <= CELL_TARGETS), QUARTERS)
    return [radius / 4**k for k in range(first, -1, -1)]


def nearest_within(left: DataFrame, right: DataFrame, radius: float, left_id: str, right_id: str, x: str = "x", y: str = "y", cut: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """For each left point with a right one in reach, the nearest (ties: smallest id).

    Right points at one place count as the smallest of them. Where they are dense, the search begins with a smaller reach, and only
    points that have found none go on to four times that, so the pairs do not grow with the square of the density.
    """
    targets = right.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.min(F.struct(F.col(right_id).alias("id"))).alias("_id")).select("x", "y", "_id.id")
    points, out = left.select(F.col(left_id).alias("id"), F.col(x).alias("x"), F.col(y).alias("y")), None
    reaches = _reaches(targets, radius)
    if len(reaches) > 1:
        targets = cut(targets)
    for reach in reaches:
        found = within(points, targets, reach).groupBy(F.col("l.id").alias("id")).agg(F.min(F.struct("dist", F.col("r.id").alias("id"))).alias("best"))
        if reach < radius:
            found = cut(found)
            done = found.select(F.col("id").alias("_done"))
            points = cut(points.join(done, F.col("id").eqNullSafe(F.col("_done")), "left_anti"))
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("id").alias(left_id), F.col("best.id").alias(right_id), F.col("best.dist").alias("dist"))


def nearest_distances(points: DataFrame, targets: DataFrame, start: float, by: Sequence[str] = (), cut: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """by, id, dist: how far each point (by, id, x, y) is from the nearest target (by, x, y) of its group; null where the group has none.

    Each round joins only the points still open, over four times the reach of the last; a point is done once a target is in reach.
    """
    left = cut(points.select(*by, "id", "x", "y"))
    bounds = [tuple(df.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()) for df in (left, targets)]
    far = -1.0 if None in bounds[0] or None in bounds[1] else max(bounds[1][1] - bounds[0][0], bounds[0][1] - bounds[1][0]) + max(bounds[1][3] - bounds[0][2], bounds[0][3] - bounds[1][2])
    out, last, reach = left.where("false").select(*by, "id", F.lit(0.0).alias("dist")), 0.0, start
    while last < far and not left.isEmpty():
        got = cut(within(left, targets, reach, on=tuple(by)).groupBy(*by, F.col("l.id").alias("id")).agg(F.min("dist").alias("dist")))
        out = out.unionByName(got)
        left = cut(left.join(got, [*by, "id"], "left_anti"))
        last, reach = reach, reach * 4
    return out.unionByName(left.select(*by, "id", F.lit(None).cast("double").alias("dist")))


def nearest_values(points: DataFrame, targets: DataFrame, value: str, start: float, by: Sequence[str] = (), cut: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """by, id and the value of the target (by, x, y, value) nearest to each point (by, id, x, y) of its group (ties: smallest value); null where the group has none. Rounds as in nearest_distances()."""
    left = cut(points.select(*by, "id", "x", "y"))
    bounds = [tuple(df.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()) for df in (left, targets)]
    far = -1.0 if None in bounds[0] or None in bounds[1] else max(bounds[1][1] - bounds[0][0], bounds[0][1] - bounds[1][0]) + max(bounds[1][3] - bounds[0][2], bounds[0][3] - bounds[1][2])
    out, last, reach = None, -1.0, start
    while last < far and not left.isEmpty():
        near = within(left, targets, reach, on=tuple(by)).groupBy(*by, F.col("l.id").alias("id")).agg(F.min(F.struct("dist", F.col(f"r.{value}").alias("v"))).alias("best"))
        got = cut(near.select(*by, "id", F.col("best.v").alias(value)))
        out = got if out is None else out.unionByName(got)
        left = cut(left.join(got, [*by, "id"], "left_anti"))
        last, reach = reach, reach * 4
    rest = left.select(*by, "id", F.lit(None).cast(dict(targets.dtypes)[value]).alias(value))
    return rest if out is None else out.unionByName(rest)


#: Pivots of a group at most, and vectors that are dealt to pivots at once.
PIVOTS, CHUNK = 1024, 4096


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """g, id, v, p, away, b: vectors (g, id, v) with their nearest pivot and its distance, in blocks b of about `block` vectors of one pivot.

    Pivots are vectors that a hash picks, one for a block but PIVOTS at most; vectors come to them in chunks, each with its group's pivots.
    """
    kind = dict(rows.dtypes)
    sizes = rows.groupBy("g").agg(F.count("*").alias("n"), F.min_by("v", F.xxhash64("id")).alias("_first"))
    share = F.least(F.ceil(F.col("n") / block), F.lit(PIVOTS)) / F.col("n")
    picked = rows.join(sizes.select("g", "n"), "g").where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) < share * (1 << 30))
    pivots = picked.select("g", "v").unionByName(sizes.where(F.col("n") > 0).select("g", F.col("_first").alias("v"))).groupBy("g").agg(F.collect_set("v").alias("pivots"))
    chunks = rows.join(sizes.select("g", "n"), "g").groupBy("g", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / CHUNK)).alias("_c")).agg(F.collect_list(F.struct("id", "v")).alias("own"))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for g, own, pivots in zip(pdf["g"], pdf["own"], pdf["pivots"], strict=True):
                v, c = np.array([list(r["v"]) for r in own], float), np.array(sorted(map(tuple, pivots)), float)
                far = np.maximum((v * v).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * v @ c.T, 0)
                p = far.argmin(1)
                yield pd.DataFrame({"g": [g] * len(v), "id": [r["id"] for r in own], "v": list(v), "p": p, "away": np.sqrt(((v - c[p]) ** 2).sum(1)), "c": list(c[p])})

    dealt = chunks.join(pivots, "g").select("g", "own", "pivots").mapInPandas(near, f"g {kind['g']}, id {kind['id']}, v array<double>, p long, away double, c array<double>")
    parts = dealt.groupBy("g", "p").agg(F.ceil(F.count("*") / block).alias("_parts"))
    return dealt.join(parts, ["g", "p"]).withColumn("b", F.concat_ws(":", "p", F.pmod(F.xxhash64("id", F.lit(9)), F.col("_parts")).cast("string"))).drop("_parts")


def knn(vectors: DataFrame, k: int, id_column: str, vector_column: str, group: str, block: int = 512, cut: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """The k nearest others of each vector inside its group: id, neighbour, rank, dist2 (ties: smallest id). Rows without a vector have none and are none.

    A group's vectors are dealt to blocks by their nearest pivot. A block's own vectors give a bound on how far its k-th neighbours are, and by
    the triangle inequality only blocks whose balls come within that bound meet it. A pair of blocks gives at most k candidates a vector,
    and no task holds more than two blocks and the balls of its group.
    """
    kinds = dict(vectors.dtypes)
    rows = vectors.where(F.col(vector_column).isNotNull()).select(F.col(group).alias("g"), F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
    dealt = cut(_blocks(rows, block))
    packed = dealt.groupBy("g", "b").agg(F.first("c").alias("c"), F.max("away").alias("r"), F.collect_list(F.struct("id", "v")).alias("own"))
    balls = packed.groupBy("g").agg(F.collect_list(F.struct("b", "c", "r")).alias("balls"))

    def best(own: list, other: list) -> pd.DataFrame:
        a, b = (np.array([list(r["v"]) for r in side], float) for side in (own, other))
        i, j = (np.array([r["id"] for r in side]) for side in (own, other))
        far = np.round(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0), 9)
        far[i[:, None] == j[None]] = np.inf
        near = np.lexsort((np.broadcast_to(j, far.shape), far), axis=1)[:, :k]
        return pd.DataFrame({"id": np.repeat(i, near.shape[1]), "neighbour": j[near].ravel(), "dist2": np.take_along_axis(far, near, 1).ravel()})

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for g, b, c, r, own, others in zip(pdf["g"], pdf["b"], pdf["c"], pdf["r"], pdf["own"], pdf["balls"], strict=True):
                found = best(own, own)
                far = found.groupby("id")["dist2"].max().max() if len(own) > k else np.inf
                reach = np.sqrt(far) + 1e-6
                gap = np.sqrt(((np.array([list(x["c"]) for x in others]) - np.array(c)) ** 2).sum(1)) - np.array([x["r"] for x in others]) - r
                to = [x["b"] for x, d in zip(others, gap, strict=True) if d <= reach * (1 + 1e-9) and x["b"] != b]
                found = found[np.isfinite(found["dist2"])].assign(g=g, b=b, to=None)
                asked = pd.DataFrame({"id": None, "neighbour": None, "dist2": None, "g": g, "b": b, "to": to})
                yield from (x[["g", "b", "to", "id", "neighbour", "dist2"]].astype(object).where(lambda y: y.notna(), None) for x in (found, asked) if len(x))

    kind, name = kinds[id_column], kinds[group]
    started = cut(packed.join(balls, "g").mapInPandas(first, f"g {name}, b string, `to` string, id {kind}, neighbour {kind}, dist2 double"))
    asked = started.where("`to` is not null").select("g", "b", "to")
    pairs = asked.join(packed.select("g", "b", "own"), ["g", "b"]).join(packed.select("g", F.col("b").alias("to"), F.col("own").alias("other")), ["g", "to"]).select("own", "other")

    def second(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for own, other in zip(pdf["own"], pdf["other"], strict=True):
                out = best(own, other)
                yield out[np.isfinite(out["dist2"])]

    found = pairs.mapInPandas(second, f"id {kind}, neighbour {kind}, dist2 double").unionByName(started.where("`to` is null").select("id", "neighbour", "dist2"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("dist2", "neighbour")))
    return ranked.where(F.col("rank") <= k).select(F.col("id").alias(id_column), "neighbour", "dist2", "rank")


def _small(df: DataFrame, most: int) -> None:
    """Raises an error if a table that is to be broadcast has more rows than that."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows to broadcast")


def nearest_centre(points: DataFrame, centres: DataFrame, point_id: str, centre_id: str, columns: list[str], most: float | None = None) -> DataFrame:
    """The nearest of a few centres (a broadcast table, checked to be small) for each point: dist, ties by smallest id; farther than `most` is no match."""
    _small(centres, 10_000)
    named = F.broadcast(centres.select(F.col(centre_id).alias("_c"), *[F.col(c).alias(f"_{c}") for c in columns]))
    square = sum((F.col(c) - F.col(f"_{c}")) * (F.col(c) - F.col(f"_{c}")) for c in columns)
    best = points.join(named).groupBy(point_id).agg(F.min(F.struct(F.sqrt(square).alias("dist"), F.col("_c").alias("id"))).alias("best"))
    out = best.select(point_id, F.col("best.id").alias(centre_id), F.col("best.dist").alias("dist"))
    return out if most is None else out.where(F.col("dist") <= most)


def mean_nearest(samples: DataFrame, truth: DataFrame, reach: float) -> DataFrame:
    """For each line of samples (line, seq, x, y) the label of truth points (label, x, y) of least mean nearest distance, if that is below reach: line, label, mean_dist.

    A mean below reach needs one sample in reach, so only labels that a distance join finds near a line are measured.
    """
    points = samples.select("line", "seq", "x", "y")
    near = within(points, truth.select("label", "x", "y"), reach).select(F.col("l.line").alias("line"), F.col("r.label").alias("label")).distinct()
    asked = points.join(near, "line").select("label", F.struct("line", "seq").alias("id"), "x", "y")
    mean = nearest_distances(asked, truth.select("label", "x", "y"), reach, ("label",)).groupBy(F.col("id.line").alias("line"), "label").agg(F.avg("dist").alias("mean_dist"))
    best = mean.groupBy("line").agg(F.min(F.struct("mean_dist", "label")).alias("best"))
    return best.where(F.col("best.mean_dist") < reach).select("line", "best.label", "best.mean_dist")


def bilinear(points: DataFrame, raster: DataFrame, width: int, height: int, point_id: str = "id") -> DataFrame:
    """Bilinear sample of raster (u, v, z) at points (id, u, v); outside takes the edge value."""
    u, v = F.greatest(F.lit(0.0), F.least(F.col("u"), F.lit(width - 1.0))), F.greatest(F.lit(0.0), F.least(F.col("v"), F.lit(height - 1.0)))
    base = points.select(point_id, F.floor(u).cast("int").alias("u0"), F.floor(v).cast("int").alias("v0"), (u - F.floor(u)).alias("fu"), (v - F.floor(v)).alias("fv"))
    corner = lambda a, b: F.struct(
        F.least(F.col("u0") + a, F.lit(width - 1)).alias("u"), F.least(F.col("v0") + b, F.lit(height - 1)).alias("v"), ((F.col("fu") if a else 1 - F.col("fu")) * (F.col("fv") if b else 1 - F.col("fv"))).alias("w")
    )
    corners = base.select(point_id, F.explode(F.array(corner(0, 0), corner(1, 0), corner(0, 1), corner(1, 1))).alias("c")).select(point_id, "c.*")
    return corners.join(raster.select("u", "v", "z"), ["u", "v"]).groupBy(point_id).agg(F.sum(F.col("w") * F.col("z")).alias("z"))
