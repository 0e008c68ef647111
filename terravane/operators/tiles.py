"""Stencils on cells as arrays of tiles: each task works on squares of cells with a margin of their neighbours around them.

A cell is sent to its own tile and to those whose margin it is in, so a chain of stencils whose reaches add up to the margin needs one shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of a tile's side, without its margin.
SIDE = 128

Arrays = dict[str, np.ndarray]


def over_tiles(
    cells: DataFrame, by: Sequence[str], columns: dict[str, str], margin: int, run: Callable[[Arrays, np.ndarray, dict], Arrays], outputs: dict[str, str], given: DataFrame | None = None, side: int = SIDE
) -> DataFrame:
    """by, u, v and the outputs (name to type: int, long, double or boolean) of run for all cells (by, u, v and columns: name to type).

    run(arrays, have, row) gets an array for each column, first axis u, with its margin, `have` where a cell is, and the row of its image in given (by and
    more, one row an image; images without one are left out). Cells are unique in their image; columns are not null.
    """
    moved = lambda c: F.sequence(F.floor((F.col(c) - margin) / side), F.floor((F.col(c) + margin) / side))
    dealt = cells.withColumn("_tu", F.explode(moved("u"))).withColumn("_tv", F.explode(moved("v")))
    cell = F.struct(*[F.col(c).cast(t).alias(c) for c, t in (("u", "long"), ("v", "long"), *columns.items())])  # one list of cells, not one of each column
    # cells are moved before they are collected: collecting first would hold all that a task reads
    packed = dealt.repartition(*by, "_tu", "_tv").groupBy(*by, "_tu", "_tv").agg(F.collect_list(cell).alias("_cells"))
    more = [c for c in given.columns if c not in by] if given is not None else []
    if given is not None:
        packed = packed.join(given, list(by))
    packed = packed.select(*by, "_tu", "_tv", "_cells", *more)
    kinds = {"int": np.int32, "long": np.int64, "double": np.float64, "boolean": bool}
    wide = side + 2 * margin
    schema = packed.select(*by, F.col("_tu").cast("int").alias("u"), F.col("_tu").cast("int").alias("v"), *[F.lit(None).cast(t).alias(c) for c, t in outputs.items()]).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = {c: batch.column(c)[i] for c in ("_tu", "_tv", *more)}
                u, v, *values = (c.to_numpy(zero_copy_only=False) for c in batch.column("_cells")[i].values.flatten())
                at = u - one["_tu"].as_py() * side + margin, v - one["_tv"].as_py() * side + margin
                mine = (at[0] >= margin) & (at[0] < margin + side) & (at[1] >= margin) & (at[1] < margin + side)
                if not mine.any():
                    continue
                # of a sparse tile only what its own cells reach is worked on
                low, high = ([f(x[mine]) for x in at] for f in (np.min, np.max))
                low, high = [max(0, x - margin) for x in low], [min(wide, x + margin + 1) for x in high]
                near = (at[0] >= low[0]) & (at[0] < high[0]) & (at[1] >= low[1]) & (at[1] < high[1])
                at, shape = tuple(x[near] - a for x, a in zip(at, low, strict=True)), (high[0] - low[0], high[1] - low[1])
                have, inner, arrays = np.zeros(shape, bool), np.zeros(shape, bool), {}
                have[at], inner[tuple(x[mine[near]] for x in at)] = True, True
                for c, value in zip(columns, values, strict=True):
                    arrays[c] = np.zeros(shape, kinds[columns[c]])
                    arrays[c][at] = value[near]
                found = run(arrays, have, {c: one[c].as_py() for c in more})
                own = np.nonzero(have & inner)
                place = [(own[0] + low[0] - margin + one["_tu"].as_py() * side).astype(np.int32), (own[1] + low[1] - margin + one["_tv"].as_py() * side).astype(np.int32)]
                repeated = pa.array(np.full(len(place[0]), i))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(repeated) for c in by], *map(pa.array, place), *[pa.array(found[c][own].astype(kinds[t])) for c, t in outputs.items()]], schema.names)

    return packed.mapInArrow(work, schema)


def shifted(a: np.ndarray, du: int, dv: int) -> np.ndarray:
    """What stands du and dv further on; wrong within that reach of the array's border."""
    return np.roll(a, (-du, -dv), (0, 1))


def lower_median(a: np.ndarray, have: np.ndarray, radius: int) -> np.ndarray:
    """Lower median of the cells there are in a square around each."""
    steps, most, a = range(-radius, radius + 1), np.iinfo(np.int64).max, a.astype(np.int64)
    stack = np.sort([np.where(shifted(have, i, j), shifted(a, i, j), most) for i in steps for j in steps], axis=0)
    count = sum(shifted(have, i, j).astype(int) for i in steps for j in steps)
    return np.take_along_axis(stack, np.maximum(count - 1, 0)[None] // 2, 0)[0]


def widened(mask: np.ndarray, shape: list[tuple[int, int]]) -> np.ndarray:
    """Cells that the shape covers when laid on each cell of the mask."""
    return np.logical_or.reduce([shifted(mask, -i, -j) for i, j in shape])


def narrowed(mask: np.ndarray, shape: list[tuple[int, int]]) -> np.ndarray:
    """Cells on which the whole shape lies inside the mask."""
    return np.logical_and.reduce([shifted(mask, i, j) for i, j in shape])


def filled(label: np.ndarray, known: np.ndarray, holes: np.ndarray, reach: int) -> np.ndarray:
    """Labels with each hole given that of its nearest known cell (ties: smallest), -1 where none is in reach."""
    label = label.astype(np.int64)
    out = np.where(holes, -1, label)
    rings: dict[int, list[tuple[int, int]]] = {}
    for i in range(-reach, reach + 1):
        for j in range(-reach, reach + 1):
            if 0 < i * i + j * j <= reach * reach:
                rings.setdefault(i * i + j * j, []).append((i, j))
    left = np.array(np.nonzero(holes))
    size = np.array(label.shape)[:, None]
    most = np.iinfo(np.int64).max
    for d in sorted(rings):
        if not left.size:
            break
        best = np.full(left.shape[1], most)
        for step in rings[d]:
            at = left + np.array(step)[:, None]
            inside = ((at >= 0) & (at < size)).all(0)
            at = np.where(inside, at, 0)
            best = np.minimum(best, np.where(inside & known[tuple(at)], label[tuple(at)], most))
        got = best < most
        out[tuple(left[:, got])] = best[got]
        left = left[:, ~got]
    return out


def least_connected(have: np.ndarray, label: np.ndarray, eight: bool) -> np.ndarray:
    """For each cell the flat place of the first cell that it is connected with, through cells of its label."""
    n, wide = have.size, have.shape[1]
    place = np.arange(n).reshape(have.shape)
    pairs = []
    for i, j in [(1, 0), (0, 1)] + ([(1, 1), (1, -1)] if eight else []):
        a = (slice(0, have.shape[0] - i), slice(max(0, -j), wide - max(0, j)))
        b = (slice(i, None), slice(max(0, j), wide - max(0, -j)))
        same = have[a] & have[b] & (label[a] == label[b])
        pairs.append(np.stack([place[a][same], place[b][same]]))
    a, b = np.concatenate(pairs, 1)
    up = np.arange(n)
    while True:
        x, y = up[a], up[b]
        if (x == y).all():
            return up.reshape(have.shape)
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while ((top := up[up]) != up).any():
            up = top
