"""Raster to lines, lines to height fields: tracing, contacts, broken lines, fault candidates, contour interpolation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import chains, cut_lineage, simplify_paths
from .kernels import simplify, thin, thin_once
from .raster import offsets, smooth
from .tiles import over_tiles, shifted
from .triangles import heights

LINES = "line_no long, seq long, x double, y double"


def path_length(points: np.ndarray) -> float:
    return float(np.hypot(*np.diff(points, axis=0).T).sum()) if len(points) > 1 else 0.0


def trace_lines(cells: np.ndarray, shortest: float, tolerance: float) -> list[np.ndarray]:
    """Lines (x, y) along the skeleton of a set of cells (u, v).

    The skeleton is a graph of touching cells. Cells with other than two neighbours are stops; every
    edge of a stop starts a line that runs to the next stop, and what is left are rings, closed at their first cell.
    """
    low = cells.min(0)
    mask = np.zeros(tuple(cells.max(0) - low + 1), bool)
    mask[tuple((cells - low).T)] = True
    bone = [tuple(c) for c in np.argwhere(thin(mask))]
    have = set(bone)
    near = {c: [n for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (n := (c[0] + a, c[1] + b)) in have] for c in bone}
    # A diagonal step beside a corner cell would close a triangle: the corner carries the line.
    near = {c: [n for n in ns if c[0] == n[0] or c[1] == n[1] or not {(c[0], n[1]), (n[0], c[1])} & have] for c, ns in near.items()}
    used, lines = set(), []

    def follow(start, step) -> list:
        line = [start]
        while True:
            used.add(frozenset((line[-1], step)))
            line.append(step)
            ahead = [n for n in near[step] if frozenset((step, n)) not in used]
            if len(near[step]) != 2 or not ahead:
                return line
            step = ahead[0]

    for stops in (True, False):
        for c in bone:
            if stops and len(near[c]) == 2:
                continue
            for n in near[c]:
                if frozenset((c, n)) not in used:
                    lines.append(follow(c, n))
    out = [np.array(line, float) + low for line in lines]
    return [p[simplify(p, tolerance)] if tolerance > 0 else p for p in out if path_length(p) >= shortest]


def _rows(lines: list[np.ndarray]) -> pd.DataFrame:
    parts = [pd.DataFrame({"line_no": k, "seq": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1]}) for k, p in enumerate(lines)]
    return pd.concat(parts) if parts else pd.DataFrame({"line_no": [], "seq": [], "x": [], "y": []})


#: Cells of a group that one task traces; larger ones are traced in tiles.
GROUP_CELLS = 4_000_000
#: Rounds of thinning in one pass over tiles; each reaches two cells farther.
ROUNDS = 8


def thin_tiles(mask: DataFrame, group: list[str], cut: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """The skeleton of the mask cells (group, u, v), as kernels.thin() gives it: rounds on tiles whose margins reach as far as the rounds of a pass do, until no tile changes."""

    def run(arrays: dict[str, np.ndarray], have: np.ndarray, row: dict) -> dict[str, np.ndarray]:
        img = have
        for _ in range(ROUNDS):
            gone = thin_once(img)
            if not gone.any():
                break
            img = img & ~gone
        return {"kept": img, "late": gone}

    left = mask.select(*group, "u", "v").distinct()
    while True:
        got = cut(over_tiles(left, group, {}, 2 * ROUNDS, run, {"kept": "boolean", "late": "boolean"}))
        left = got.where("kept").select(*group, "u", "v")
        if got.where("late").isEmpty():
            return left


def trace_tiles(mask: DataFrame, group: list[str], shortest: float = 15.0, tolerance: float = 1.5, cut: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """As mask_to_lines(), with no group in one task: the skeleton is thinned in tiles, its cells are joined with their neighbours, and the steps between stops are chained by list ranking.

    A stop (a cell with other than two neighbours) is as many nodes as it has steps, so that every node has two neighbours at most.
    """
    bone = cut(thin_tiles(mask, group, cut))
    around = [(1, 0), (0, 1), (-1, 0), (0, -1), (1, 1), (1, -1), (-1, -1), (-1, 1)]
    side = {s: k for k, s in enumerate(around)}

    def run(arrays: dict[str, np.ndarray], have: np.ndarray, row: dict) -> dict[str, np.ndarray]:
        beside = [have & shifted(have, i, j) for i, j in around]
        # a diagonal step beside a corner cell would close a triangle: the corner carries the line
        step = [b if 0 in s else b & ~beside[side[s[0], 0]] & ~beside[side[0, s[1]]] for b, s in zip(beside, around, strict=True)]
        stop = sum(b.astype(np.int32) for b in step) != 2
        bits = lambda masks: sum(m.astype(np.int32) << k for k, m in enumerate(masks))
        return {"steps": bits(step), "stops": bits([b & shifted(stop, i, j) for b, (i, j) in zip(step, around, strict=True)]), "stop": stop}

    # steps as bits by direction, and which of them lead to stops: a stop is seen from two cells away, and so is what it borders on
    cells = over_tiles(bone, group, {}, 3, run, {"steps": "int", "stops": "int", "stop": "boolean"})
    half, has = len(around), lambda bits, k: F.col(bits).bitwiseAND(F.lit(1 << k)) != 0
    every = F.array(*[F.when(has("steps", k), F.struct(F.lit(k).alias("k"), F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(side[-i, -j]).alias("back"), has("stops", k).alias("stop"), F.lit(float(np.hypot(i, j))).alias("length"))) for k, (i, j) in enumerate(around)])
    out = cells.select(*group, "u", "v", "stop", F.explode(F.filter(every, lambda x: x.isNotNull())).alias("s"))
    node = lambda u, v, stop, k: F.struct(*group, u.alias("u"), v.alias("v"), F.when(stop, k).otherwise(half).alias("k"))
    near, far = node(F.col("u"), F.col("v"), F.col("stop"), F.col("s.k")), node(F.col("u") + F.col("s.i"), F.col("v") + F.col("s.j"), F.col("s.stop"), F.col("s.back"))
    edges = cut(out.select(near.alias("u"), far.alias("v"), F.col("s.length").alias("length")).where("u < v"))
    found = cut(chains(edges.select("u", "v"), cut))
    lengths = edges.join(found.select(F.col("node").alias("u"), "chain"), "u").groupBy("chain").agg(F.sum("length").alias("length"))
    rows = found.join(lengths.where(F.col("length") >= shortest), "chain")
    ends = rows.where("closed and seq = 0").join(rows.groupBy("chain").agg((F.max("seq") + 1).alias("_last")), "chain").withColumn("seq", F.col("_last")).drop("_last")
    place = (F.col("chain.u").cast("long") + (1 << 28)) * (1 << 29) + F.col("chain.v").cast("long") + (1 << 28)  # places up to 2^28 either way
    named = rows.unionByName(ends).select(*[F.col(f"chain.{g}").alias(g) for g in group], (place * 16 + F.col("chain.k")).alias("line_no"), "seq", F.col("node.u").cast("double").alias("x"), F.col("node.v").cast("double").alias("y"))
    if tolerance <= 0:
        return named
    kept = simplify_paths(named.select(F.struct(*group, "line_no").alias("line"), "seq", "x", "y"), "line", "seq", tolerance, cut=cut)
    return kept.select(*[F.col(f"line.{g}").alias(g) for g in group], F.col("line.line_no").alias("line_no"), "seq", "x", "y")


def mask_to_lines(mask: DataFrame, group: list[str], shortest: float = 15.0, tolerance: float = 1.5, most: int = GROUP_CELLS, cut: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """Lines of the mask cells (u, v) of each group (an image, or an image and a label pair): group, line_no, seq, x, y. Groups of more than `most` cells are traced in tiles."""
    kinds = dict(mask.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = _rows(trace_lines(pdf[["u", "v"]].to_numpy(), shortest, tolerance))
        for i, g in enumerate(group):
            out.insert(i, g, pdf[g].iat[0])
        return out

    cells = mask.select(*group, "u", "v")
    large = cut(cells.groupBy(*group).count().where(F.col("count") > most).select(*group))
    if not large.isEmpty():
        wide = trace_tiles(cells.join(large, group, "left_semi"), group, shortest, tolerance, cut)
        cells = cells.join(large, group, "left_anti")
    traced = cells.groupBy(*group).applyInPandas(lambda pdf: run(pdf), ", ".join(f"{g} {kinds[g]}" for g in group) + ", " + LINES)
    return traced if large.isEmpty() else traced.unionByName(wide)


def contacts(cells: DataFrame, label: str = "label", shortest: float = 25.0, tolerance: float = 1.5, by: Sequence[str] = ()) -> DataFrame:
    """Border lines of each pair of labels: by, unit_a, unit_b, line_no, seq, x, y.

    One pass gives the cells on both sides of every differing pair, and each pair's band is traced; pairs with fewer side contacts than the shortest line are left out.
    """
    ahead = cells.select(*by, "u", "v", F.col(label).alias("a"), F.explode(F.array(*[F.struct((F.col("u") + a).alias("u2"), (F.col("v") + b).alias("v2")) for a, b in ((1, 0), (0, 1))])).alias("n"))
    sides = ahead.select(*by, "u", "v", "a", "n.*").join(cells.select(*by, F.col("u").alias("u2"), F.col("v").alias("v2"), F.col(label).alias("b")), [*by, "u2", "v2"]).where("a <> b")
    pairs = sides.select(*by, F.least("a", "b").alias("unit_a"), F.greatest("a", "b").alias("unit_b"), "u", "v", "u2", "v2")
    group = [*by, "unit_a", "unit_b"]
    long = pairs.groupBy(*group).count().where(F.col("count") >= shortest).select(*group)
    both = pairs.join(long, group).select(*group, F.explode(F.array(F.struct("u", "v"), F.struct(F.col("u2").alias("u"), F.col("v2").alias("v")))).alias("c"))
    return mask_to_lines(both.select(*group, "c.*").distinct(), group, shortest, tolerance)


#: Arc length at the end of a line that its direction there is fitted to.
END_STRETCH = 12.0


def end_direction(line: np.ndarray) -> np.ndarray:
    """Unit vector in which a line runs out of its last vertex: the principal axis of its last stretch, every part weighted by its length."""
    back = line[::-1]
    step = np.hypot(*np.diff(back, axis=0).T)
    used = np.searchsorted(np.cumsum(step), END_STRETCH) + 1
    middle, weight = (back[:-1] + back[1:])[:used] / 2, step[:used]
    rest = np.vstack([middle, back[0]]) - np.average(middle, axis=0, weights=weight if weight.any() else None)
    axis = np.linalg.eigh((rest * np.append(weight, 1e-3)[:, None]).T @ rest)[1][:, -1]
    return axis if axis @ (back[0] - back[min(used, len(back) - 1)]) >= 0 else -axis


def join_broken(lines: list[np.ndarray], gap: float, angle: float) -> list[np.ndarray]:
    """Joins lines end to end, the closest ends first, if they are at most gap apart and both run on in the direction of the bridge between their directions within an angle (degrees). Each end is used once, and no line is closed on itself."""
    lines = [np.asarray(p, float) for p in lines if len(p) > 1]
    if not lines:
        return []
    ends = np.array([p[k] for p in lines for k in (0, -1)])
    runs = np.array([end_direction(p) for line in lines for p in (line[::-1], line)])
    dist = np.hypot(*(ends[:, None] - ends[None]).transpose(2, 0, 1))
    one, two = np.nonzero(np.triu(dist <= gap, 1) & (-(runs @ runs.T) >= np.cos(np.radians(angle))))
    chain, taken, bridge = list(range(len(lines))), set(), {}

    def root(i: int) -> int:
        while chain[i] != i:
            i = chain[i]
        return i

    for a, b in sorted(zip(one.tolist(), two.tolist(), strict=True), key=lambda p: (dist[p], p)):
        if a not in taken and b not in taken and root(a // 2) != root(b // 2):
            chain[root(a // 2)] = root(b // 2)
            taken |= {a, b}
            bridge[a], bridge[b] = b, a
    out = []
    for start in range(len(ends)):
        other = start ^ 1
        if start in taken or (other not in taken and start % 2):
            continue  # a walk starts at a free end; a lone line at its first
        walk = [lines[start // 2] if start % 2 == 0 else lines[start // 2][::-1]]
        while other in bridge:
            here = bridge[other]
            walk.append(lines[here // 2] if here % 2 == 0 else lines[here // 2][::-1])
            other = here ^ 1
        if start < other or len(walk) == 1:
            out.append(np.vstack(walk))
    return out


def fault_candidates(pixels: DataFrame, labels: DataFrame, group: str, radius: float = 2.4, shortest: float = 120.0, gap: float = 28.0, angle: float = 32.0, dark: int = 110) -> DataFrame:
    """Long dark lines thicker than ordinary ones: group, fault_id, length_px, straightness, n_units_crossed, vertices.

    pixels: group, u, v, r, g, b; labels: group, u, v, label. A line's core are the dark cells whose surrounding disc is all dark.
    """
    disc = offsets("disc", int(round(radius)))
    mask = pixels.where(F.col("r") * 0.299 + F.col("g") * 0.587 + F.col("b") * 0.114 < dark).select(group, "u", "v")
    shift = lambda df, sign: df.select(group, F.explode(F.array(*[F.struct((F.col("u") + sign * a).alias("u"), (F.col("v") + sign * b).alias("v")) for a, b in disc])).alias("c")).select(group, "c.*")
    core = shift(mask, -1).groupBy(group, "u", "v").count().where(F.col("count") == len(disc)).select(group, "u", "v")
    thick = shift(core, 1).distinct()
    kinds = dict(pixels.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = join_broken(trace_lines(pdf[["u", "v"]].to_numpy(), 0.4 * shortest, 2.0), gap, angle)
        found = sorted((p for p in found if path_length(p) >= shortest), key=lambda p: -path_length(p))
        rows = [(pdf[group].iat[0], k, round(path_length(p), 1), round(float(np.hypot(*(p[-1] - p[0]))) / path_length(p), 3), [{"x": float(x), "y": float(y)} for x, y in p]) for k, p in enumerate(found)]
        return pd.DataFrame(rows, columns=[group, "fault_id", "length_px", "straightness", "vertices"])

    lines = thick.groupBy(group).applyInPandas(lambda pdf: run(pdf), f"{group} {kinds[group]}, fault_id long, length_px double, straightness double, vertices array<struct<x:double,y:double>>")
    at = lines.select(group, "fault_id", F.explode("vertices").alias("p")).select(group, "fault_id", F.col("p.x").cast("int").alias("u"), F.col("p.y").cast("int").alias("v"))
    crossed = at.join(labels.select(group, "u", "v", "label"), [group, "u", "v"]).groupBy(group, "fault_id").agg(F.count_distinct("label").alias("n_units_crossed"))
    return lines.join(crossed, [group, "fault_id"], "left").select(group, "fault_id", "length_px", "straightness", F.coalesce("n_units_crossed", F.lit(0)).alias("n_units_crossed"), "vertices")


def contours_to_dem(samples: DataFrame, width: int, height: int, step: int, fallback: float, sigma: float = 2.0, by: Sequence[str] = (), cut: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """by, u, v, z: heights of coarse cells (u, v in steps) from contour samples (by, z, x, y): linear on the triangles of the samples, that of the nearest sample outside of them, then smoothed.

    Maps of fewer than two levels get the fallback height; maps without a sample are not in it.
    """
    if not by:
        return contours_to_dem(samples.withColumn("_map", F.lit(0)), width, height, step, fallback, sigma, ("_map",), cut).drop("_map")
    wide, high = -(-width // step), -(-height // step)
    rows = samples.where("z is not null").select(*by, (F.col("x") / step).alias("x"), (F.col("y") / step).alias("y"), F.col("z").cast("double").alias("z"))
    maps = rows.groupBy(*by).agg((F.min("z") < F.max("z")).alias("_several"))
    line = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cells = cut(maps.withColumn("u", line(wide)).withColumn("v", line(high)))
    several = rows.join(maps.where("_several"), list(by), "left_semi").withColumn("id", F.xxhash64("x", "y"))
    found = heights(cells.where("_several"), several, by, cut)
    weights = [float(np.exp(-d * d / (2 * sigma * sigma))) for d in range(int(3 * sigma) + 1)]
    flat = cells.where("not _several").select(*by, "u", "v", F.lit(float(fallback)).alias("z"))
    return smooth(found, weights, "z", by).unionByName(flat)
