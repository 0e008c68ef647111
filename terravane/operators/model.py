"""Potential-field models: co-kriging of surfaces and orientations, evaluated cell by cell.

Method: Lajaunie, Courrioux and Manuel (1997), "Foliation fields and 3D cartography in geology";
the dual form of de la Varga, Schaaf and Wellmann (2019). The system of one series is dense and small (its
size is checked), so it is solved once; its weights are sent to the cells, which are evaluated where they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a dense system at most.
MAX_SYSTEM = 6000


def _cubic(r: np.ndarray, reach: float, sill: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cubic covariance, its slope over r, and its second derivative less that."""
    t = np.minimum(r / reach, 1.0)
    value = sill * (1 - 7 * t**2 + 35 / 4 * t**3 - 7 / 2 * t**5 + 3 / 4 * t**7)
    slope = sill / reach**2 * (-14 + 105 / 4 * t - 35 / 2 * t**3 + 21 / 4 * t**5)
    bend = sill / reach**2 * (-14 + 105 / 2 * t - 70 * t**3 + 63 / 2 * t**5)
    return value, slope, bend - slope


@dataclass
class Field:
    """A solved scalar field and the value of each surface."""

    centre: np.ndarray
    scale: float
    reach: float
    sill: float
    at_gradient: np.ndarray
    gradient_weights: np.ndarray
    at_point: np.ndarray
    at_base: np.ndarray
    point_weights: np.ndarray
    drift: np.ndarray
    names: list[str]  # young to old
    values: np.ndarray
    faults: list[Field] = field(default_factory=list)
    throws: np.ndarray = field(default_factory=lambda: np.zeros(0))  # the field's step across each fault

    def evaluate(self, xyz: np.ndarray) -> np.ndarray:
        x = (xyz - self.centre) / self.scale
        out = x @ self.drift
        h = x[:, None] - self.at_gradient[None]
        slope = _cubic(np.sqrt((h * h).sum(2)), self.reach, self.sill)[1]
        out -= (slope[:, :, None] * h * self.gradient_weights[None]).sum((1, 2))
        for at, sign in ((self.at_point, 1.0), (self.at_base, -1.0)):
            h = x[:, None] - at[None]
            out += sign * _cubic(np.sqrt((h * h).sum(2)), self.reach, self.sill)[0] @ self.point_weights
        return out + sides(self.faults, xyz) @ self.throws

    def unit_index(self, xyz: np.ndarray) -> np.ndarray:
        """0 above the youngest surface's base, and one more below each further one."""
        return (self.evaluate(xyz)[:, None] < self.values[None]).sum(1)


def sides(faults: list[Field], xyz: np.ndarray) -> np.ndarray:
    """A column for each fault: 1 below its surface, 0 above."""
    return np.stack([(f.unit_index(xyz) > 0).astype(float) for f in faults], 1) if faults else np.zeros((len(xyz), 0))


def normals(azimuth: np.ndarray, dip: np.ndarray) -> np.ndarray:
    """Upward unit normals of planes with a dip and an azimuth in degrees."""
    a, d = np.radians(azimuth), np.radians(dip)
    return np.stack([np.sin(a) * np.sin(d), np.cos(a) * np.sin(d), np.cos(d)], 1)


def solve(points: pd.DataFrame, orientations: pd.DataFrame, names: list[str], extent: tuple, reach: float = 10.0, sill: float = 10.0, nugget: float = 0.01, faults: list[Field] | None = None) -> Field:
    """Solves one series; faults that are solved already cut it: the field may step across each of them by an amount that the points tell. points: X, Y, Z, formation; orientations: X, Y, Z, azimuth, dip; names young to old.

    Lengths are scaled so that the longest side of the extent is 1. Raises an error without an orientation or a surface with two points.
    """
    low, high = np.array(extent[::2], float), np.array(extent[1::2], float)
    centre, scale = (low + high) / 2, float((high - low).max())
    g = (orientations[["X", "Y", "Z"]].to_numpy(float) - centre) / scale
    n = normals(orientations["azimuth"].to_numpy(float), orientations["dip"].to_numpy(float))
    groups = [(points.loc[points["formation"] == f, ["X", "Y", "Z"]].to_numpy(float) - centre) / scale for f in names]
    if not len(g) or not any(len(p) > 1 for p in groups):
        raise ValueError("a series needs an orientation and a surface with two points")
    p = np.vstack([x[1:] for x in groups])
    base = np.vstack([np.repeat(x[:1], len(x) - 1, 0) for x in groups if len(x)])
    m, k = 3 * len(g), len(p)
    step = sides(faults or [], p * scale + centre) - sides(faults or [], base * scale + centre)
    told = np.flatnonzero(step.any(0))  # a fault that parts no points of a surface tells nothing
    faults, step = [(faults or [])[i] for i in told], step[:, told]
    if m + k > MAX_SYSTEM:
        raise ValueError("too many constraints for one dense system; thin them first")
    d = 3 + len(faults)
    matrix = np.zeros((m + k + d, m + k + d))
    h = g[:, None] - g[None]
    r = np.sqrt((h * h).sum(2))
    _, slope, bend = _cubic(r, reach, sill)
    unit = np.divide(h, r[:, :, None], out=np.zeros_like(h), where=r[:, :, None] > 0)
    block = -(unit[:, :, :, None] * unit[:, :, None, :]) * bend[:, :, None, None] - np.eye(3)[None, None] * slope[:, :, None, None]
    matrix[:m, :m] = block.transpose(0, 2, 1, 3).reshape(m, m) + nugget * np.eye(m)
    for at, sign in ((p, 1.0), (base, -1.0)):
        h = at[:, None] - g[None]
        matrix[m : m + k, :m] += sign * (-h * _cubic(np.sqrt((h * h).sum(2)), reach, sill)[1][:, :, None]).reshape(k, m)
    matrix[:m, m : m + k] = matrix[m : m + k, :m].T
    for a, sa in ((p, 1.0), (base, -1.0)):
        for b, sb in ((p, 1.0), (base, -1.0)):
            h = a[:, None] - b[None]
            matrix[m : m + k, m : m + k] += sa * sb * _cubic(np.sqrt((h * h).sum(2)), reach, sill)[0]
    matrix[m : m + k, m : m + k] += 1e-6 * np.eye(k)
    drift = np.hstack([np.vstack([np.tile(np.eye(3), (len(g), 1)), p - base]), np.vstack([np.zeros((m, len(faults))), step])])
    matrix[: m + k, m + k :], matrix[m + k :, : m + k] = drift, drift.T
    matrix[m + k + 3 :, m + k + 3 :] -= 1e-9 * np.eye(len(faults))  # faults that part the same points share their step
    w = np.linalg.solve(matrix, np.concatenate([n.ravel(), np.zeros(k + d)]))
    out = Field(centre, scale, reach, sill, g, w[:m].reshape(-1, 3), p, base, w[m : m + k], w[m + k : m + k + 3], names, np.zeros(0), faults, w[m + k + 3 :])
    out.values = np.array([out.evaluate(x * scale + centre).mean() if len(x) else -np.inf for x in groups])
    return out


def model_cells(cells: DataFrame, series: list[tuple[Field, dict[int, int]]], basement: int) -> DataFrame:
    """i, j, k, lith_id of cells (i, j, k, x, y, z) under a stack of series, young to old.

    Each series comes with the lith id of each of its unit indexes. A cell below all surfaces of a series is left to the next older one, else it is basement.
    """
    shared = cells.sparkSession.sparkContext.broadcast(series)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            xyz = batch[["x", "y", "z"]].to_numpy(float)
            lith, open_ = np.full(len(xyz), basement, np.int32), np.ones(len(xyz), bool)
            for field, ids in shared.value:
                for a in range(0, len(xyz), 4096):
                    part = slice(a, a + 4096)
                    index = field.unit_index(xyz[part])
                    hit = open_[part] & (index < len(field.names))
                    lith[part] = np.where(hit, np.array([ids[i] for i in range(len(field.names))] + [basement], np.int32)[index], lith[part])
                    open_[part] &= ~hit
            yield batch[["i", "j", "k"]].assign(lith_id=lith)

    return cells.select("i", "j", "k", "x", "y", "z").mapInPandas(run, "i int, j int, k int, lith_id int")


def build_model(points: DataFrame, orientations: DataFrame, stack: list[tuple[str, list[str]]], grid, reach: float = 10.0, sill: float = 10.0, faults: list[str] | None = None) -> DataFrame:
    """Voxels of a model: stack lists (series, members young to old), young series first; lith ids run from 1 down the faults, then the stack, the basement last.

    faults names surfaces that cut every series; they take ids, but no cell. The constraint tables are thinned tables of one model; solve() checks their size.
    """
    p, o = points.limit(MAX_SYSTEM + 1).toPandas(), orientations.limit(MAX_SYSTEM + 1).toPandas()
    extent, series, first = (grid.x0, grid.x1, grid.y0, grid.y1, grid.z0, grid.z1), [], 1 + len(faults or [])
    of = lambda names: (p[p["formation"].isin(names)], o[o["formation"].isin(names)], names, extent, reach, sill)
    cuts = [solve(*of([name])) for name in faults or []]
    for _, members in stack:
        series.append((solve(*of(members), faults=cuts), {i: first + i for i in range(len(members))}))
        first += len(members)
    at = {a: grid.centre(a, F.col(c)).alias(a) for a, c in zip("xyz", "ijk", strict=True)}
    return model_cells(grid.cells(points.sparkSession).select("i", "j", "k", at["x"], at["y"], at["z"]), series, first)


def lith_names(voxels: DataFrame, stack: list[tuple[str, list[str]]], basement: str, faults: list[str] | None = None) -> DataFrame:
    """lith_id, name of a model's cells: faults (whose ids no cell has) are left out, other units stay even if no cell has them."""
    ordered = [(name, True) for name in faults or []] + [(name, False) for _, members in stack for name in members] + [(basement, False)]
    every = voxels.sparkSession.createDataFrame([(i, *x) for i, x in enumerate(ordered, 1)], "lith_id int, name string, is_fault boolean")
    used = voxels.select("lith_id").distinct().withColumn("_used", F.lit(True))
    return every.join(used, "lith_id", "left").where("_used or not is_fault").select("lith_id", "name")


def ablation(points: DataFrame, orientations: DataFrame, stack: list[tuple[str, list[str]]], grid, truth: DataFrame, basement: str, ranges: list[float], faults: list[str] | None = None) -> DataFrame:
    """reach and the agreement with the truth (i, j, k, gt: name, below) of the model solved with each kriging range: one solve a range, all of them scored in one job."""
    from .evaluate import voxel_metrics

    every = None
    for reach in ranges:
        voxels = build_model(points, orientations, stack, grid, reach, faults=faults)
        named = voxels.join(lith_names(voxels, stack, basement, faults).withColumnRenamed("name", "pred"), "lith_id").select(F.lit(float(reach)).alias("reach"), "i", "j", "k", "pred")
        every = named if every is None else every.unionByName(named)
    return voxel_metrics(every.join(truth.select("i", "j", "k", "gt", "below"), ["i", "j", "k"]).withColumn("basement", F.lit(basement)), ("reach",))
