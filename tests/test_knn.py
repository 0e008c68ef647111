"""Nearest neighbours by blocks against all pairs; balls of blocks keep most pairs of blocks apart where vectors are clustered."""

import numpy as np
import pytest

from terravane.operators import spatial


def all_pairs(rows, k):
    out = set()
    for g, i, v in rows:
        if v is None:
            continue
        near = sorted((round(sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), 9), j) for h, j, w in rows if h == g and j != i and w is not None)[:k]
        out |= {(i, j, n + 1) for n, (_, j) in enumerate(near)}
    return out


@pytest.mark.parametrize("block", [16, 512])
def test_knn_is_that_of_all_pairs(spark, block):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(9, 3)) * 30
    rows = [("a" if i < 200 else "b", i, [float(round(x, 2)) for x in centres[i % 9] + rng.normal(size=3)]) for i in range(240)]
    rows += [("a", 900, rows[0][2]), ("a", 901, rows[0][2]), ("c", 902, [0.0, 0.0, 0.0]), ("a", 903, None), ("d", 904, [1.0, 2.0, 3.0]), ("d", 905, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "kind string, no long, vec array<double>")
    got = {(r["no"], r["neighbour"], r["rank"]) for r in spatial.knn(df, 4, "no", "vec", "kind", block).collect()}
    assert got == all_pairs(rows, 4)


def test_clustered_vectors_meet_few_blocks(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 8)) * 20
    rows = [("a", i, (centres[i % 40] + rng.normal(size=8)).tolist()) for i in range(4000)]
    df = spark.createDataFrame(rows, "kind string, no long, vec array<double>")
    cuts = []
    spatial.knn(df, 5, "no", "vec", "kind", 64, cut=lambda d: cuts.append(spatial.cut_lineage(d)) or cuts[-1]).count()
    blocks, met = cuts[0].select("b").distinct().count(), cuts[1].where("`to` is not null").count()
    assert blocks > 40 and met < 0.5 * blocks * (blocks - 1)
