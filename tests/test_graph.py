"""Chains, simplification and spaced selection against walks in Python, on graphs that no task would hold."""

import numpy as np
import pytest

from terravane.operators import constraints, graph, kernels


def walked(edges):
    near = {}
    for u, v in edges:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    seen, out = set(), set()
    for start in [*sorted(n for n, x in near.items() if len(x) == 1), *sorted(near)]:
        if start in seen:
            continue
        walk, now = [], start
        while now is not None:
            walk.append(now)
            seen.add(now)
            now = min((x for x in near[now] if x not in seen), default=None)
        out |= {(min(walk), k, n, len(near[start]) == 2) for k, n in enumerate(walk)}
    return out


def chains_of(spark, edges, **how):
    return {tuple(r) for r in graph.chains(spark.createDataFrame(edges, "u long, v long"), **how).select("chain", "seq", "node", "closed").collect()}


def test_chains_of_paths_and_rings(spark):
    rng = np.random.default_rng(2)
    names = rng.permutation(400).tolist()
    edges, at = [], 0
    for size, ring in ((2, False), (3, True), (60, True), (57, False), (1, False), (5, True), (90, False)):
        own = names[at : at + size]
        at += size
        edges += list(zip(own, own[1:], strict=False)) + ([(own[-1], own[0])] if ring else [])
    edges = [e if rng.random() < 0.5 else e[::-1] for e in edges]
    assert chains_of(spark, edges) == walked(edges)
    assert chains_of(spark, [*edges, edges[0], edges[0][::-1], (7000, 7000)]) == walked(edges)


def test_chains_are_shortened_within_ranges(spark, monkeypatch):
    """Paths and rings inside of one range, across many, and of names with a group, some of them null; rounds see the ends of stretches only."""
    rng = np.random.default_rng(4)
    edges, at = [], 0
    for size, ring in ((300, False), (3, True), (200, True), (2, False), (150, False), (4, True)):
        own = list(range(at, at + size)) if size != 150 else (at + rng.permutation(size)).tolist()
        at += size
        edges += list(zip(own, own[1:], strict=False)) + ([(own[-1], own[0])] if ring else [])
    seen, rank = [], graph.rank_lists
    monkeypatch.setattr(graph, "rank_lists", lambda arcs, cut: seen.append(arcs.count()) or rank(arcs, cut))
    for range_arcs in (100_000, 70):
        assert chains_of(spark, edges, range_arcs=range_arcs) == walked(edges)
    assert seen[0] < 40 and max(seen) < 600 < len(edges)
    name = lambda n: {"g": None if n % 1000 < 500 else "b", "n": n}
    df = spark.createDataFrame([(name(a), name(b)) for a, b in edges if (a % 1000 < 500) == (b % 1000 < 500)], "u struct<g:string,n:long>, v struct<g:string,n:long>")
    got = {(r["chain"]["n"], r["seq"], r["node"]["n"], r["closed"]) for r in graph.chains(df).collect()}
    assert got == walked([(a, b) for a, b in edges if (a % 1000 < 500) == (b % 1000 < 500)])


def test_chains_of_nothing(spark):
    assert graph.chains(spark.createDataFrame([], "u long, v long")).collect() == []


def test_long_stretches_are_split_in_rounds(spark):
    rng = np.random.default_rng(5)
    rows, want = [], set()
    for p, n in ((1, 400), (2, 30), (3, 2), (4, 1), (5, 300)):
        xy = np.cumsum(rng.normal(size=(n, 2)), 0) if p != 5 else np.stack([np.arange(n), np.zeros(n)], 1).astype(float)
        if p == 1:
            xy[-1] = xy[0]  # a closed path has no chord
        rows += [(p, 2 * k, float(x), float(y), "clash") for k, (x, y) in enumerate(xy)]
        want |= {(p, 2 * int(k)) for k in kernels.simplify(xy, 1.5)}
    df = spark.createDataFrame(rows, "line long, seq long, x double, y double, p string").drop("p")
    for most in (20, 100_000):
        got = [(r["line"], r["seq"]) for r in graph.simplify_paths(df, "line", "seq", 1.5, most).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def one_by_one(rows, k, gap):
    chosen = []
    for row in sorted((r for r in rows if r[4] is not None and r[2] is not None), key=lambda r: (-r[4], r[1])):
        if len(chosen) < k and all(np.hypot(row[2] - c[2], row[3] - c[3]) > gap for c in chosen):
            chosen.append(row)
    return [(*r, i + 1) for i, r in enumerate(chosen)]


@pytest.mark.parametrize("k, gap", [(3, 5.0), (1000, 2.0), (40, 0.0), (5, -1.0), (0, 1.0)])
def test_spaced_best_is_what_one_by_one_gives(spark, k, gap):
    rng = np.random.default_rng(8)
    rows = [("a" if i % 3 else "b", i, float(x), float(y), float(s)) for i, (x, y, s) in enumerate(zip(rng.integers(0, 30, 500), rng.integers(0, 20, 500), rng.integers(0, 40, 500), strict=True))]
    rows += [("c", 900, None, 1.0, 5.0), ("c", 901, 1.0, 1.0, None), ("d", 902, -3.0, 4.0, 0.0)]
    df = spark.createDataFrame(rows, "g string, id long, x double, y double, score double")
    got = sorted(tuple(r) for r in constraints.spaced_best(df, "g", k, gap, "id").select("g", "id", "x", "y", "score", "rank").collect())
    assert got == sorted(sum((one_by_one([r for r in rows if r[0] == g], k, gap) for g in "abcd"), []))


def test_vertices_of_short_paths_stay_arrays(spark):
    rows = [(p, k, float(k), float((k * 7 + p) % 5)) for p in range(300) for k in range(p % 7 + 1)]
    kept = graph.simplify_paths(spark.createDataFrame(rows, "line long, seq long, x double, y double").repartition(3), "line", "seq", 1.0)
    got, want = {}, {}
    for r in kept.collect():
        got.setdefault(r["line"], set()).add((r["seq"], r["x"], r["y"]))
    for p in range(300):
        own = np.array([r[2:] for r in rows if r[0] == p])
        want[p] = {(int(k), *own[k]) for k in kernels.simplify(own, 1.0)}
    assert got == want
    assert "MapInPandas" not in kept._jdf.queryExecution().executedPlan().toString()


def test_plans_of_components_do_not_grow_from_round_to_round(spark):
    names = np.random.default_rng(8).permutation(1000)[:300].tolist()
    edges = spark.createDataFrame(list(zip(names, names[1:], strict=False)), "u long, v long")
    found = graph.components(edges)
    leaves = found._jdf.queryExecution().optimizedPlan().collectLeaves()
    leaves = [leaves.apply(i) for i in range(leaves.size())]
    assert max(x.stats().sizeInBytes().bit_length() for x in leaves) < 40 and max(x.constraints().size() for x in leaves) < 20
    assert {r["component"] for r in found.collect()} == {min(names)}


def test_rounds_of_many_nodes_are_not_broadcast(spark, monkeypatch):
    edges = spark.createDataFrame([(i, (i * 7 + 3) % 400) for i in range(400)] + [(1000 + i, 1001 + i) for i in range(50)], "u long, v long")
    few = {tuple(r) for r in graph.components(edges).collect()}
    monkeypatch.setattr(graph, "BROADCAST_ROWS", 10)
    plans = []

    def cut(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return graph.materialise(df)

    found = graph.components(edges, cut)
    assert {tuple(r) for r in found.collect()} == few
    wide = [p for p in plans if "Join" in p][0]
    assert "SortMergeJoin" in wide and "BroadcastHashJoin" not in wide
