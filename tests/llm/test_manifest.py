"""The Merkle manifest against trees built by hand, and its defined results."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from terravane.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, digest string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, **other):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (other.get(c, row[c]) for c in manifest.FIELDS)])


def tree_of(digests):
    """The root, and for each leaf the digests left and right of it on each level."""
    steps, under = [[] for _ in digests], [[i] for i in range(len(digests))]
    while len(digests) > 1:
        runs = range(0, len(digests), 16)
        for start in runs:
            run = digests[start : start + 16]
            for k, leaves in enumerate(under[start : start + 16]):
                for i in leaves:
                    steps[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
        under = [sum(under[s : s + 16], []) for s in runs]
        digests = [sha(*digests[s : s + 16]) for s in runs]
    return digests[0], steps


def expected(rows):
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [tree_of([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in names]
    root, ups = tree_of([t[0] for t in trees])
    for name, (sub, steps), up in zip(names, trees, ups, strict=True):
        for (_, _, first, r), own in zip(sorted(by[name], key=lambda x: x[:3]), steps, strict=True):
            x = first
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
                x = leaf_of(r, text=r["text"] and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"]))
            for left, right in own + up:
                x = sha(left, x, right)
            yield r["doc_id"], first, sub, root, sha(*[a + b for a, b in own + up]), x, x == root


def same(df):
    got = manifest.digest(df).collect()
    assert sorted(map(tuple, got), key=str) == sorted(expected(df.collect()), key=str)
    return got


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def test_nulls_repeats_long_texts_and_clashing_columns(spark):
    rows = [(None, "a", None, None, None), (1, None, "x", 3, "ABC"), (1, None, "x", 3, "ABC"), (1, None, "x", 3, "abc"), (2, None, None, None, ""), (7, "é", "en", 1, "Zé" * 500_000)]
    got = same(frame(spark, rows))
    assert len(got) == 6 and len({r["root"] for r in got}) == 1


def test_trees_of_several_levels_and_a_hot_source(spark):
    rows = [(i, "hot" if i % 3 else f"s{i}", None, i, f"T{i}") for i in range(900)]  # 300 sources of one row
    got = same(frame(spark, rows))
    assert {r["verified"] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 16, 17, 257])
def test_last_runs(spark, n):
    same(frame(spark, [(i, "s", None, None, str(i)) for i in range(n)]))


def test_empty_table_has_no_root(spark):
    empty = frame(spark, []).limit(0)
    assert manifest.digest(empty).collect() == [] and manifest.build(empty, manifest.leaf()).root() is None


def test_a_changed_field_is_seen(spark):
    df = frame(spark, [(i, "s", "en", i, "same") for i in range(40)])
    for change in (F.lit("Same"), F.lit(None).cast("string"), F.lit("")):
        found = manifest.verify(df, F.col("doc_id") == 3, change).where("not verified").collect()
        assert [r["doc_id"] for r in found] == [3]
