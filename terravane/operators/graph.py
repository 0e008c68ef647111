"""Graph operators: components, chains, mutual links."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

if TYPE_CHECKING:  # workers that only need this module's other functions don't load them
    import numpy as np
    import pyarrow as pa


@lru_cache(1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="terravane-")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; below a temporary one where that is unset and the master is local."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = _local_folder()
    return f"{top}/{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def materialise(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts the lineage so that a lost executor costs no recomputation of it.

    The planner gets a plain table of known size. A checkpoint keeps the constraints and size estimates of its plan instead, which grow from round to round.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a written table that a join may broadcast.
BROADCAST_ROWS = 100_000


def unsent(df: DataFrame, rows: int) -> DataFrame:
    """df for a side of a join, which broadcasts neither side if there are many rows.

    The planner takes a written table for as large as its files, where values that repeat take next to nothing; broadcast, each row takes over a
    hundred bytes, and all of them pass through the driver.
    """
    return df.hint("merge") if rows > BROADCAST_ROWS else df


def components(edges: DataFrame, cut: Callable[[DataFrame], DataFrame] = materialise) -> DataFrame:
    """node, component: the smallest node that edges (u, v) reach. Nodes without an edge are not in it.

    Each round points every node at the least of itself and its neighbours, follows the pointers to their
    ends by doubling, and contracts the edges to these ends. Doubling shortens a path of any length in
    the logarithm of its length, and a node that is no least neighbour is gone after its round, so
    the rounds are few. Each result is cut from its lineage.
    """
    pair = lambda a, b: (F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    left = cut(edges.select(*pair(F.col("u"), F.col("v"))).where("u <> v").distinct())
    rounds: list[tuple[DataFrame, int]] = []
    while rows := 2 * left.count():  # a round has so many nodes at most
        both = left.select(F.col("u").alias("node"), F.col("v").alias("x")).unionAll(left.select(F.col("v").alias("node"), F.col("u").alias("x")))
        least = cut(both.groupBy("node").agg(F.min("x").alias("x")).select("node", F.least("node", "x").alias("component")))
        while True:
            up = least.select(F.col("node").alias("component"), F.col("component").alias("top"))
            jumped = cut(least.join(unsent(up, rows), "component").select("node", "component", "top"))
            if jumped.where("top <> component").isEmpty():
                break
            least = jumped.select("node", F.col("top").alias("component"))
        to_u = least.select(F.col("node").alias("u"), F.col("component").alias("cu"))
        to_v = least.select(F.col("node").alias("v"), F.col("component").alias("cv"))
        left = cut(left.join(unsent(to_u, rows), "u").join(unsent(to_v, rows), "v").where("cu <> cv").select(*pair(F.col("cu"), F.col("cv"))).distinct())
        rounds.append((least, rows))
    if not rounds:
        return left.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out, rows = rounds[-1]
    for least, earlier in reversed(rounds[:-1]):
        later = unsent(out.select(F.col("node").alias("component"), F.col("component").alias("last")), rows)
        out, rows = least.join(later, "component", "left").select("node", F.coalesce("last", "component").alias("component")), earlier
    return out


def grid_edges(cells: DataFrame, eight: bool = True, label: str | None = None) -> DataFrame:
    """Edges between touching cells (id, u, v), of one label if given: each cell looks right, down and (eight) at both lower diagonals."""
    steps = [(1, 0), (0, 1)] + ([(1, 1), (-1, 1)] if eight else [])
    keys = ["u", "v", *([label] if label else [])]
    look = cells.select("id", *([label] if label else []), F.explode(F.array(*[F.struct((F.col("u") + a).alias("u"), (F.col("v") + b).alias("v")) for a, b in steps])).alias("c"))
    return look.select(F.col("id").alias("a"), F.col("c.u").alias("u"), F.col("c.v").alias("v"), *([label] if label else [])).join(cells.select("id", *keys), keys).select(F.col("a").alias("u"), F.col("id").alias("v"))


def mutual_best(candidates: DataFrame) -> DataFrame:
    """Links (a < b) that each end ranks first on one of its sides; candidates: node, side, other, dist, in both directions."""
    w = Window.partitionBy("node", "side").orderBy("dist", "other")
    best = candidates.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("node", "other").distinct()
    back = best.select(F.col("node").alias("other"), F.col("other").alias("node"))
    return best.join(back, ["node", "other"]).where("node < other").select(F.col("node").alias("a"), F.col("other").alias("b"))


def rank_lists(arcs: DataFrame, cut: Callable[[DataFrame], DataFrame] = cut_lineage) -> tuple[DataFrame, DataFrame]:
    """Ranks the lists that arcs (u, v) of a graph of paths and rings form, an arc followed by the one that goes on from its end.

    The first table has the arcs that come to an end: u, v, last (the node where the list ends), steps (arcs after this one; with a column
    length the sum of their lengths) and least (the smallest node from here to the end). The second has those of rings, which never end: u, v and least, of the whole
    ring. Each round joins every open arc with the one that it points at and takes over where that points, so a list of any length
    takes a logarithmic number of rounds, and no task holds a list.
    """
    long = F.col("length") if "length" in arcs.columns else F.lit(1).cast("long")
    ahead = arcs.select(F.col("u").alias("_v"), F.col("v").alias("w"), long.alias("_length"))
    start = arcs.join(ahead, (F.col("v") == F.col("_v")) & (F.col("u") != F.col("w")), "left")
    more = F.col("w").isNotNull()
    state = cut(start.select("u", "v", F.coalesce("w", "v").alias("pv"), F.when(more, F.col("v")).otherwise(F.col("u")).alias("pu"), F.coalesce("_length", F.lit(0).cast("long")).alias("steps"), F.least("u", "v").alias("least"), more.alias("open")))
    reach, most = 1, state.count()
    while reach <= most and not state.where("open").isEmpty():
        to = state.select(F.col("u").alias("pu"), F.col("v").alias("pv"), F.col("pu").alias("qu"), F.col("pv").alias("qv"), F.col("steps").alias("_steps"), F.col("least").alias("_least"), F.col("open").alias("_open"))
        jumped = state.where("open").join(to, ["pu", "pv"])
        moved = jumped.select("u", "v", F.col("qv").alias("pv"), F.col("qu").alias("pu"), (F.col("steps") + F.col("_steps")).alias("steps"), F.least("least", "_least").alias("least"), F.col("_open").alias("open"))
        state = cut(state.where("not open").unionByName(moved))
        reach *= 2
    return state.where("not open").select("u", "v", F.col("pv").alias("last"), "steps", "least"), state.where("open").select("u", "v", "least")


#: Arcs of a range of nodes within which one task shortens paths.
RANGE_ARCS = 100_000


def _leaves(column: pa.Array) -> list[pa.Array]:
    """The columns of a nested node."""
    import pyarrow as pa

    return [x for part in column.flatten() for x in _leaves(part)] if pa.types.is_struct(column.type) else [column]


def _ends(at: np.ndarray, to: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For arcs (at, to), both ways and sorted by at, of a graph of paths and rings of nodes 0 to n: the node where each arc's walk ends, how many arcs away, and the least node that the walk meets (of the whole ring in rings, which have no end)."""
    import numpy as np

    first, count = np.searchsorted(at, np.arange(n)), np.bincount(at, minlength=n)
    own = np.arange(len(at))
    other = first[to] + (to[first[to]] == at)  # of the arcs from an arc's end the one that does not go back, if there are two
    jump = np.where(count[to] == 2, other, own)
    steps, low = (jump != own).astype(np.int64), np.minimum(at, to)
    for _ in range(max(1, len(at)).bit_length()):
        low = np.minimum(low, low[jump])
        steps, jump = steps + np.where(jump != own, steps[jump], 0), jump[jump]
    return to[jump], steps + 1, low


def _shortened(arcs: DataFrame, parts: int) -> DataFrame:
    """One row a node: node, head, away, last and arcs, from arcs (u, v).

    Nodes are dealt to tasks by ranges, and in each the stretches of nodes of one range are walked as arrays. A stretch is cut beside its
    smallest node, so that this node and its neighbours stay; of what is left a node knows the smaller end (head), how far that is, and whether it is an
    end itself. Ends have the arcs (v, length) of the shortened graph, which has their names, distances and smallest nodes.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    both = arcs.repartitionByRange(parts, "u").sortWithinPartitions("u", "v")
    schema = arcs.select(F.col("u").alias("node"), F.col("u").alias("head"), F.lit(0).cast("long").alias("away"), F.lit(True).alias("last"), F.array(F.struct("v", F.lit(0).cast("long").alias("length"))).alias("arcs")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        table = pa.Table.from_batches(held).combine_chunks()
        us, vs = (table.column(c).chunk(0) for c in "uv")
        rows, key = len(us), np.zeros(2 * len(us), np.int64)
        for a, b in zip(_leaves(us), _leaves(vs), strict=True):
            code = pc.dictionary_encode(pa.concat_arrays([a, b]), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            key = np.unique(key * (int(code.max()) + 1) + code, return_inverse=True)[1].ravel()
        # nodes of this range by number, in their order; -1: a node of another range
        begin = np.flatnonzero(np.concatenate([[True], key[1:rows] != key[: rows - 1]]))
        number = np.full(int(key.max()) + 1, -1, np.int64)
        number[key[begin]] = np.arange(len(begin))
        at, to, n = number[key[:rows]], number[key[rows:]], len(begin)

        def walk(inside: np.ndarray) -> tuple[np.ndarray, ...]:
            return inside, *_ends(at[inside], to[inside], n)

        inside, _, _, low = walk(np.flatnonzero(to >= 0))
        least = np.arange(n)
        np.minimum.at(least, at[inside], low)
        smallest = least == np.arange(n)
        inside, end, steps, _ = walk(np.flatnonzero((to >= 0) & ~smallest[at] & ~smallest[to]))
        # both ends of a node's stretch and how far they are; a node with one arc or none is an end itself
        ends, far = np.repeat(np.arange(n)[:, None], 2, 1), np.zeros((n, 2), np.int64)
        second = np.concatenate([[0], (at[inside][1:] == at[inside][:-1]).astype(np.int64)]) if len(inside) else inside
        ends[at[inside], second], far[at[inside], second] = end, steps
        pick = ends.argmin(1)
        head, away, tail = ends[np.arange(n), pick], far[np.arange(n), pick], ends.max(1)
        last = (head == np.arange(n)) | (tail == np.arange(n))
        out = np.ones(rows, bool)
        out[inside] = False
        out = np.flatnonzero(out)
        long = np.flatnonzero(last & (head != tail))
        owner = np.concatenate([at[out], long])
        order = np.argsort(owner, kind="stable")
        across = np.where(head[long] == long, tail[long], head[long])
        values = pa.concat_arrays([vs.take(pa.array(out)), us.take(pa.array(begin[across]))]).take(pa.array(order))
        length = np.concatenate([np.ones(len(out), np.int64), far[long].max(1)])[order]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([values, pa.array(length)], ["v", "length"]))
        found = pa.RecordBatch.from_arrays([us.take(pa.array(begin)), us.take(pa.array(begin[head])), pa.array(away), pa.array(last), lists], ["node", "head", "away", "last", "arcs"])
        for i in range(0, n, 10_000):
            yield found.slice(i, 10_000)

    return both.mapInArrow(run, schema)


def chains(edges: DataFrame, cut: Callable[[DataFrame], DataFrame] = cut_lineage, range_arcs: int = RANGE_ARCS) -> DataFrame:
    """Ordered vertices of the paths of a graph whose nodes have at most two neighbours: chain (its smallest node), seq, node, closed.

    An open path starts at its smaller end; a closed one at its smallest node, towards the smaller neighbour. Loops and repeated edges are left out.
    Stretches of nodes that are near in their order are shortened to their ends first, so that rounds of list ranking see few of the nodes of most graphs.
    """
    pair = edges.where("u <> v").select("u", "v")
    every = cut(pair.unionByName(pair.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    local = cut(_shortened(every, every.count() // range_arcs + 1))
    arcs = cut(local.where("last").select(F.col("node").alias("u"), F.explode("arcs").alias("_a")).select("u", F.col("_a.v").alias("v"), F.col("_a.length").alias("length")))

    def placed(ended: DataFrame, closed: bool) -> DataFrame:
        ends = ended.where("steps = 0").select(F.col("last").alias("node"), "last", F.lit(0).cast("long").alias("away"), "least")
        both = ended.join(arcs, ["u", "v"]).select(F.col("u").alias("node"), "last", (F.col("steps") + F.col("length")).alias("away"), "least").unionByName(ends)
        # a node knows both ends of its path, and the smallest node on either side
        at = both.groupBy("node").agg(F.min("least").alias("chain"), F.min(F.struct("last", "away")).alias("first"))
        return at.select("chain", F.col("first.away").alias("seq"), "node", F.lit(closed).alias("closed"))

    ended, rings = rank_lists(arcs, cut)
    out = placed(ended, False)
    rings = cut(rings)
    if not rings.isEmpty():
        # a ring is cut between its smallest node and the larger neighbour of that
        last = rings.where("u = least").groupBy("least").agg(F.max("v").alias("_t"))
        at_cut = ((F.col("u") == F.col("least")) & (F.col("v") == F.col("_t"))) | ((F.col("v") == F.col("least")) & (F.col("u") == F.col("_t")))
        opened = rings.join(last, "least").where(~at_cut).select("u", "v").join(arcs, ["u", "v"])
        out = out.unionByName(placed(rank_lists(cut(opened), cut)[0], True))
    out = cut(out)
    # nodes inside of a stretch lie between its ends
    stretch = out.join(local.where("last").select("node", "head", "away"), "node").groupBy("head").agg(F.min_by(F.struct("chain", "seq", "closed"), "away").alias("_a"), F.max_by("seq", "away").alias("_z"))
    inner = local.where("not last").select("node", "head", "away").join(stretch, "head")
    turn = F.when(F.col("_z") > F.col("_a.seq"), F.col("away")).otherwise(-F.col("away"))
    return out.unionByName(inner.select("_a.chain", (F.col("_a.seq") + turn).alias("seq"), "node", "_a.closed"))


def simplify_paths(points: DataFrame, path: str, order: str, tolerance: float, most: int = 100_000, cut: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """Vertices (path, order, x, y) that the farthest-point rule keeps: a stretch is split at its farthest vertex from its chord (ties: the first) while that is beyond tolerance.

    Stretches of more than `most` vertices are split in rounds, all of them in one job a round: a vertex knows its stretch, and the farthest
    vertex of each is an aggregate. What is left are stretches that a task can hold, which are finished one by one.
    """
    import numpy as np
    import pyarrow as pa

    from .kernels import simplify

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # vertices stay arrays: as rows of Python they would take many times the memory of their batch
        for batch in batches:
            held = batch.column("vertices")
            flat, ends = held.flatten(), held.offsets.to_numpy() - held.offsets[0].as_py()
            xy = np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y")], 1)
            kept = [a + np.array(simplify(xy[a:b], tolerance), np.int64) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            at = pa.array(np.concatenate([np.zeros(0, np.int64), *kept]))
            own = pa.array(np.repeat(np.arange(len(kept)), [len(k) for k in kept]))
            yield pa.RecordBatch.from_arrays([batch.column("p").take(own), *[flat.field(c).take(at) for c in ("o", "x", "y")]], [path, order, "x", "y"])

    kind = dict(points.dtypes)
    rows = points.select(F.col(path).alias("p"), F.struct(F.col(order).alias("o"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).alias("at"))
    bounds = rows.groupBy("p").agg(F.min("at").alias("a"), F.max("at").alias("b"), F.count("*").alias("_n"))
    long = cut(bounds.where(F.col("_n") > most))
    if long.isEmpty():
        pieces = rows.groupBy("p").agg(F.array_sort(F.collect_list("at")).alias("vertices"))
    else:
        # vertices of long paths by their stretch (a, b); the ends of a stretch are no rows of it
        inner = cut(rows.join(long.select("p", "a", "b"), "p").where("at > a and at < b"))
        done, ends = [], long.select("p", "a", "b")
        away = _off_chord(F.col("a"), F.col("b"), F.col("at"))
        while True:
            far = inner.groupBy("p", "a", "b").agg(F.min(F.struct((-away).alias("d"), "at")).alias("far"), F.count("*").alias("_n"))
            split = cut(ends.join(far, ["p", "a", "b"], "left").select("p", "a", "b", (F.coalesce(-F.col("far.d"), F.lit(0.0)) > tolerance).alias("open"), F.col("far.at").alias("far"), F.coalesce("_n", F.lit(0)).alias("_n")))
            small = split.where(~F.col("open") | (F.col("_n") <= most))
            done.append((small.where("not open").select("p", "a", "b"), None))
            done.append((small.where("open").select("p", "a", "b"), inner))
            wide = cut(split.where(F.col("open") & (F.col("_n") > most)).select("p", "a", "b", "far"))
            if wide.isEmpty():
                break
            ends = cut(wide.select("p", F.explode(F.array(F.struct("a", F.col("far").alias("b")), F.struct(F.col("far").alias("a"), "b"))).alias("s")).select("p", "s.*"))
            side = F.when(F.col("at") < F.col("far"), F.struct("a", F.col("far").alias("b"))).otherwise(F.struct(F.col("far").alias("a"), "b"))
            inner = cut(inner.join(wide, ["p", "a", "b"]).where("at <> far").select("p", "at", side.alias("s")).select("p", "at", "s.*"))
        short = rows.join(long.select("p"), "p", "left_anti").groupBy("p").agg(F.array_sort(F.collect_list("at")).alias("vertices"))
        pieces = short
        for stretch, held in done:
            if held is None:
                pieces = pieces.unionByName(stretch.select("p", F.array("a", "b").alias("vertices")))
            else:
                own = held.join(stretch, ["p", "a", "b"]).groupBy("p", "a", "b").agg(F.collect_list("at").alias("_in"))
                pieces = pieces.unionByName(own.select("p", F.array_sort(F.concat(F.array("a", "b"), "_in")).alias("vertices")))
    kept = pieces.mapInArrow(run, f"{path} {kind[path]}, {order} {kind[order]}, x double, y double")
    return kept if long.isEmpty() else kept.distinct()  # stretches share their ends


def _off_chord(a: Column, b: Column, p: Column) -> Column:
    """Distance of a vertex from the line through the ends of its stretch, or from the one point that both are."""
    cx, cy, px, py = b["x"] - a["x"], b["y"] - a["y"], p["x"] - a["x"], p["y"] - a["y"]
    length = F.sqrt(cx * cx + cy * cy)
    return F.when(length > 0, F.abs(cx * py - cy * px) / length).otherwise(F.sqrt(px * px + py * py))
