"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors whose cosine is at least t lie within eps = sqrt(2 - 2t) of each other, in full space and
so in any projection. Vectors are sorted in epsilon grid order: by group, then by the grid cells (of
side eps / 2) of their leading principal components; the order is cut into intervals of BLOCK vectors,
and FANOUT intervals make one of the next level. Pairs of intervals are joined from the top level
down; a pair whose bounding boxes are farther than eps apart is dropped with all below it. The remaining
pairs are cut once more, into intervals of PART vectors; of those within eps, vectors that are near in the
projection are compared exactly, in double precision.

Equal vectors are one class with a count before the join, so copies cost nothing; a leaf pair returns
a row per vector (its links there and the least vector it reaches there), never the pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows
without a group, link with nothing; vectors of different lengths never link; each repeated row counts
as a vector of its own; only the three named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, materialise
from .graph import components

#: Vectors of an interval that is sent, intervals of a parent, vectors of the smallest intervals, principal components used, vectors that these are fitted on at most.
BLOCK, FANOUT, PART, DIMENSIONS, SAMPLE = 512, 8, 16, 16, 2000
LEAF = "grp string, part long, seq long, lo array<double>, hi array<double>, ids binary, counts binary, vectors binary"


def _classes(rows: DataFrame) -> DataFrame:
    good = F.col("vector").isNotNull() & (F.size("vector") > 0) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vector", lambda x: x != 0)
    return rows.where(good & F.col("grp").isNotNull()).groupBy("grp", "h1", "h2").agg(F.min("id").alias("first_id"), F.count("*").alias("count"), F.first("vector").alias("vector"))


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def _axes(classes: DataFrame, dimensions: int) -> dict[int, np.ndarray]:
    """Leading principal axes by vector length, fitted on a bounded sample; the choice only steers how much is skipped."""
    got = classes.where(F.pmod(F.xxhash64("class"), F.lit(64)) < 48).select("vector").limit(SAMPLE).toArrow()["vector"].to_pylist()
    out = {}
    for n in {len(v) for v in got}:
        x = _unit(np.array([v for v in got if len(v) == n], float))
        out[n] = np.linalg.eigh(x.T @ x - len(x) * np.outer(x.mean(0), x.mean(0)))[1][:, ::-1][:, :dimensions]
    return out


def _cells(classes: DataFrame, axes: dict[int, np.ndarray], eps: float, dimensions: int) -> DataFrame:
    shared = classes.sparkSession.sparkContext.broadcast(axes)
    schema = f"class long, grp string, count long, vector {dict(classes.dtypes)['vector']}, cells array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for v in batch.column("vector"):
                x = v.values.to_numpy().astype(float)
                axis = shared.value.get(len(x))
                p = _unit(x[None])[0] @ axis if axis is not None else np.zeros(0)
                cells.append(np.pad(np.floor(2 * p / eps).astype(np.int32), (0, dimensions - len(p))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int32()))], ["class", "grp", "count", "vector", "cells"])

    return in_arrow(classes.select("class", "grp", "count", "vector"), run, schema)


def _leaves(cells: DataFrame, axes: dict[int, np.ndarray], dimensions: int, block: int) -> DataFrame:
    """Cuts the sorted vectors of each partition into leaves of one group."""
    kind = _kind(cells)
    shared = cells.sparkSession.sparkContext.broadcast(axes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, now, held = TaskContext.get().partitionId(), 0, None, []

        def leaf() -> pa.RecordBatch:
            raw = np.array([v for _, _, v in held], float)
            axis = shared.value.get(raw.shape[1])
            p = _unit(raw) @ axis if axis is not None else np.zeros((len(raw), 0))
            p = np.pad(p, ((0, 0), (0, dimensions - p.shape[1])))
            row = [[now], [part], [seq], [p.min(0)], [p.max(0)], [np.array([c for c, _, _ in held], np.int64).tobytes()], [np.array([n for _, n, _ in held], np.int64).tobytes()], [raw.astype(kind).tobytes()]]
            types = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types, strict=True)], [f.split()[0] for f in LEAF.split(", ")])

        for batch in batches:
            for c, g, n, v in zip(batch.column("class").to_pylist(), batch.column("grp").to_pylist(), batch.column("count").to_pylist(), batch.column("vector"), strict=True):
                if held and (g != now or len(held) == block):
                    yield leaf()
                    seq, held = seq + 1, []
                now = g
                held.append((c, n, v.values.to_numpy()))
        if held:
            yield leaf()

    order = ["grp", *[F.col("cells")[i] for i in range(dimensions)], "class"]
    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return in_arrow(cells.repartitionByRange(n, *order).sortWithinPartitions(*order), run, LEAF)


def _near(a: str, b: str, eps: float):
    """Whether two boxes are within eps."""
    gaps = [F.greatest(F.lit(0.0), F.col(f"{a}.lo")[i] - F.col(f"{b}.hi")[i], F.col(f"{b}.lo")[i] - F.col(f"{a}.hi")[i]) for i in range(DIMENSIONS)]
    return sum(g * g for g in gaps) <= eps * eps * (1 + 1e-9) + 1e-12


def _pairs(leaves: DataFrame, eps: float, fanout: int) -> DataFrame:
    """part and seq of the leaf pairs (a <= b) that may hold a link, by descent through the interval levels."""
    dims = DIMENSIONS
    box = lambda: (F.array(*[F.min(F.col("lo")[i]) for i in range(dims)]).alias("lo"), F.array(*[F.max(F.col("hi")[i]) for i in range(dims)]).alias("hi"))
    node = leaves.select("grp", "part", "seq", "lo", "hi")
    most = node.agg(F.max("seq").alias("s"), F.max("part").alias("p")).first()
    if most["s"] is None:
        return leaves.sparkSession.createDataFrame([], "grp string, a_part long, a_seq long, b_part long, b_seq long")
    levels, seqs, parts = [node], most["s"] + 1, most["p"] + 1
    while seqs > 1 or parts > 1:
        if seqs > 1:
            up, seqs = (F.col("part"), F.floor(F.col("seq") / fanout)), -(-seqs // fanout)
        else:
            up, parts = (F.floor(F.col("part") / fanout), F.lit(0).cast("long")), -(-parts // fanout)
        below = levels.pop().withColumns({"up_part": up[0], "up_seq": up[1]})
        levels += [below, below.groupBy("grp", F.col("up_part").alias("part"), F.col("up_seq").alias("seq")).agg(*box())]
    top = levels.pop()
    pairs = top.select("grp", *[F.col(k).alias(f"{x}_{k}") for x in "ab" for k in ("part", "seq")])
    if not levels:
        return pairs
    for below in reversed(levels):
        child = lambda x: below.select("grp", F.col("up_part").alias(f"{x}_part"), F.col("up_seq").alias(f"{x}_seq"), F.struct("part", "seq", "lo", "hi").alias(x))  # noqa: E731, B023
        found = pairs.join(child("a"), ["grp", "a_part", "a_seq"]).join(child("b"), ["grp", "b_part", "b_seq"])
        ordered = F.struct("a.part", "a.seq") <= F.struct("b.part", "b.seq")
        same = (F.col("a_part") == F.col("b_part")) & (F.col("a_seq") == F.col("b_seq"))
        found = found.where((~same | ordered) & _near("a", "b", eps))
        pairs = found.select("grp", *[F.col(f"{x}.{k}").alias(f"{x}_{k}") for x in "ab" for k in ("part", "seq")])
    return pairs


def _kind(df: DataFrame):
    return np.float32 if dict(df.dtypes)["vector"] == "array<float>" else np.float64


def _apart(a: np.ndarray, b: np.ndarray, reach: float) -> np.ndarray:
    """Which pairs of intervals of PART rows of two projected tables have boxes farther apart than the square root of reach."""
    lo, hi = ([f(p, np.arange(0, len(p), PART), axis=0) for p in (a, b)] for f in (np.minimum.reduceat, np.maximum.reduceat))
    gap = np.maximum(0, np.maximum(lo[0][:, None] - hi[1][None], lo[1][None] - hi[0][:, None]))
    return (gap * gap).sum(2) > reach


def linked(a: np.ndarray, b: np.ndarray, axis: np.ndarray | None, least: float) -> np.ndarray:
    """Which rows of a and b have a cosine of at least `least`, in double precision; rows that are provably farther apart in the projection are not compared."""
    a, b = _unit(a), _unit(b)
    if axis is None:
        return a @ b.T >= least
    pa, pb = a @ axis, b @ axis
    reach = max(0.0, 2 - 2 * least) * (1 + 1e-9) + 1e-12
    far, na, nb = _apart(pa, pb, reach), (pa * pa).sum(1), (pb * pb).sum(1)
    out = np.zeros((len(a), len(b)), bool)
    for i, row in enumerate(far):
        own = np.arange(i * PART, min((i + 1) * PART, len(a)))
        others = np.flatnonzero(~np.repeat(row, PART)[: len(b)])
        x, y = np.nonzero(na[own][:, None] + nb[others][None] - 2 * pa[own] @ pb[others].T <= reach)
        good = np.einsum("ij,ij->i", a[own[x]], b[others[y]]) >= least
        out[own[x[good]], others[y[good]]] = True
    return out


def _links(pairs: DataFrame, leaves: DataFrame, axes: dict[int, np.ndarray], kind, least: float) -> DataFrame:
    """class, links (copies of linked classes counted), reach (the least class reached in this leaf pair)."""
    shared = pairs.sparkSession.sparkContext.broadcast(axes)
    side = lambda x: leaves.select("grp", F.col("part").alias(f"{x}_part"), F.col("seq").alias(f"{x}_seq"), *[F.col(k).alias(f"{x}_{k}") for k in ("ids", "counts", "vectors")])
    joined = pairs.join(side("a"), ["grp", "a_part", "a_seq"]).join(side("b"), ["grp", "b_part", "b_seq"])
    joined = joined.select("a_ids", "a_counts", "a_vectors", "b_ids", "b_counts", "b_vectors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cell = {k: np.frombuffer(batch.column(k)[i].as_py(), kind if k.endswith("vectors") else np.int64) for k in batch.schema.names}
                a_ids, b_ids = cell["a_ids"], cell["b_ids"]
                a, b = cell["a_vectors"].reshape(len(a_ids), -1).astype(float), cell["b_vectors"].reshape(len(b_ids), -1).astype(float)
                if a.shape[1] != b.shape[1]:
                    continue
                hit = linked(a, b, shared.value.get(a.shape[1]), least)
                if a_ids[0] == b_ids[0]:
                    np.fill_diagonal(hit, False)
                rows, cols = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
                if not len(rows):
                    continue
                hit = hit[np.ix_(rows, cols)]
                x, y, xn, yn = a_ids[rows], b_ids[cols], hit @ cell["b_counts"][cols], cell["a_counts"][rows] @ hit
                far = np.iinfo(np.int64).max
                rx, ry = x.copy(), y.copy()
                while True:
                    nx = np.minimum(rx, np.where(hit, ry[None], far).min(1))
                    ny = np.minimum(ry, np.where(hit, nx[:, None], far).min(0))
                    if (nx == rx).all() and (ny == ry).all():
                        break
                    rx, ry = nx, ny
                if a_ids[0] == b_ids[0]:
                    out = (x, xn, np.minimum(rx, ry))
                else:
                    out = (np.concatenate([x, y]), np.concatenate([xn, yn]), np.concatenate([rx, ry]))
                yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in out], ["class", "links", "reach"])

    return in_arrow(joined, run, "class long, links long, reach long")


def link_vectors(rows: DataFrame, least: float = 0.98, id_column: str = "vec_id", vector_column: str = "embedding", group_column: str = "label", block: int = BLOCK, fanout: int = FANOUT) -> DataFrame:
    """id, n_links, component_id (the smallest id reachable) and kept (id = component_id) of every row."""
    eps = math.sqrt(max(0.0, 2 - 2 * least))
    picked = rows.select(F.col(id_column).alias("id"), F.concat_ws(":", F.col(group_column).cast("string"), F.size(vector_column)).alias("g"), F.col(group_column).alias("group"), F.col(vector_column).cast("array<float>" if dict(rows.dtypes)[vector_column] == "array<float>" else "array<double>").alias("vector"))
    picked = picked.select("id", F.when(F.col("group").isNotNull(), F.col("g")).alias("grp"), "vector", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2"))
    classes = materialise(_classes(picked).withColumn("class", F.monotonically_increasing_id()))
    axes = _axes(classes, DIMENSIONS)
    leaves = materialise(_leaves(_cells(classes, axes, eps, DIMENSIONS), axes, DIMENSIONS, block))
    found = materialise(_links(materialise(_pairs(leaves, eps, fanout)), leaves, axes, _kind(classes), least))
    totals = found.groupBy("class").agg(F.sum("links").alias("links"))
    comps = components(found.select(F.col("class").alias("u"), F.col("reach").alias("v")))
    named = classes.join(comps.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    least_id = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    per_class = (
        named.join(least_id, "component")
        .join(totals, "class", "left")
        .select("grp", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("count") - 1).alias("n_links"), "component_id")
    )
    out = picked.drop("vector").join(per_class, ["grp", "h1", "h2"], "left")
    return out.select(
        F.col("id").alias(id_column),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(True)).alias("kept"),
    )
