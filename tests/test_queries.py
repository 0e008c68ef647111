"""Every registered query of the engine against its SQL, on the smallest tables."""

import pytest

import __spark_entry__
from terravane.catalogue import ORACLE, QUERIES

from .compare import assert_same, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


#: Maps of 14 by 14 cells are too coarse to find units in.
COARSE = {"segment_cases": "/root/testdata/sf0.01"}


@pytest.mark.parametrize("name", sorted(set(ORACLE) - set(COARSE)))
def test_matches_sql(spark, con, name):
    assert_same(QUERIES[name](spark, FOLDER), con, ORACLE[name])


@pytest.mark.parametrize("name", sorted(COARSE))
def test_matches_sql_on_larger_tables(spark, name):
    assert_same(QUERIES[name](spark, COARSE[name]), connect(COARSE[name]), ORACLE[name])


def test_entry_is_the_flagship(spark):
    df = __spark_entry__.entry(spark)
    assert set(df.columns) == {"user_id", "run_no", "event_type", "first_pos", "last_pos", "n"}
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_components_reach_everything(spark):
    found = {r["node"]: r["component"] for r in QUERIES["components"](spark, FOLDER).collect()}
    assert len(set(found.values())) >= 1 and all(c <= n for n, c in found.items())


def test_chains_walk_each_path_once(spark):
    rows = QUERIES["chains"](spark, FOLDER).collect()
    by = {}
    for r in rows:
        by.setdefault(r["chain"], []).append((r["seq"], r["node"]))
    for nodes in by.values():
        walk = [n for _, n in sorted(nodes)]
        assert walk == list(range(walk[0], walk[0] + len(walk)))


def test_chains_hold_every_part(spark, con):
    rows = QUERIES["chains"](spark, FOLDER).collect()
    parts = {k for (k,) in con.execute("SELECT p_partkey FROM part").fetchall()}
    assert sorted(r["node"] for r in rows) == sorted(parts | {k + 1 for k in parts})
    assert len({r["chain"] for r in rows}) == len(parts - {k + 1 for k in parts}) and not any(r["closed"] for r in rows)


def test_spaced_best_keeps_its_distance(spark):
    rows = QUERIES["nms_topk"](spark, FOLDER).collect()
    by = {}
    for r in rows:
        for x, y in by.get(r["c_nationkey"], []):
            assert ((x - r["x"]) ** 2 + (y - r["y"]) ** 2) ** 0.5 > 250.0
        by.setdefault(r["c_nationkey"], []).append((r["x"], r["y"]))
    assert max(len(v) for v in by.values()) <= 3


def test_merged_clusters_cover_all_vectors(spark):
    assert sum(r["n"] for r in QUERIES["kmeans_merge"](spark, FOLDER).collect()) == 500
