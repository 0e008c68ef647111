"""Suffix-array, vector and MinHash deduplication and the pipeline against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravane.llm import embedding_dedup, minhash, suffix_dedup

from .test_text_ops import docs_of, words_of


def _find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def _join(parent, a, b):
    a, b = _find(parent, a), _find(parent, b)
    parent[max(a, b)] = min(a, b)


# ---- suffix array


def _want_cut(rows, length):
    first = {}
    for i, t in rows:
        for k in range(len(t) - length + 1):
            first[t[k : k + length]] = min(first.get(t[k : k + length], 1 << 70), i)
    out = []
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if first[t[k : k + length]] < i:
                gone[k : k + length] = True
        out.append((i, len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("chunk", [200, 1 << 20])
def test_repeats_against_brute_force(spark, chunk):
    rng = random.Random(3)
    parts = ["".join(rng.choice("abcd é\n") for _ in range(rng.randint(20, 120))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 5)))) for i in range(60)] + [(7, "".join(parts[:2])), (7, "".join(parts[:2])), (100, "z" * 4000), (101, "z" * 60), (102, "z" * 49), (103, None), (104, "")]
    found = suffix_dedup.remove_repeats(docs_of(spark, rows), chunk_bytes=chunk, key_bytes=3000, string_bytes=2000)
    got = sorted(tuple(r) for r in suffix_dedup.digest(found).collect())
    assert got == _want_cut([(i, (t or "").encode()) for i, t in rows], 50)
    whole = suffix_dedup.remove_repeats(docs_of(spark, rows), chunk_bytes=chunk, whole_characters=True)
    assert all(r["kept"].decode() is not None for r in whole.collect())


def test_repeats_of_nothing_and_null_ids(spark):
    assert suffix_dedup.remove_repeats(docs_of(spark).where("false")).count() == 0
    found = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(docs_of(spark, [(None, "q" * 80), (5, "q" * 80)])).collect()}
    assert found == {None: 80, 5: 0}


def test_transform_is_sorted_with_right_prefixes():
    rng = random.Random(6)
    strings = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 9))) for _ in range(40)]
    sizes = np.array([len(x) for x in strings])
    table = np.zeros((40, 9), np.uint8)
    for i, x in enumerate(strings):
        table[i, 9 - len(x) :] = list(x)
    owner, size, prefix = suffix_dedup.bcr(table, sizes, 50)
    suffixes = [strings[o][len(strings[o]) - n :] if n else b"" for o, n in zip(owner, size, strict=True)]
    assert suffixes == sorted(suffixes) and len(suffixes) == sizes.sum() + 40
    common = lambda a, b: next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    assert all(prefix[i] == common(suffixes[i - 1], suffixes[i]) for i in range(1, len(suffixes)))


def test_window_minima_of_strings_around_a_minimizer():
    strings, places = [b"xxabyy", b"xabyyz", b"xxabyz"], np.array([2, 1, 2])  # windows of 5 bytes that hold "ab"
    least, windows = suffix_dedup.window_minima(strings, places, np.array([5, 3, 9]), 5, 2)
    assert windows.tolist() == [2, 2, 2] and least.tolist() == [5, 3, 3, 3, 5, 9]


@pytest.mark.parametrize("hot", [2, 16_000])
def test_repeats_of_periodic_texts_and_frequent_minimizers(spark, hot):
    rng = random.Random(8)
    core = "".join(rng.choice("abcdefgh") for _ in range(46))
    word = lambda n: "".join(rng.choice("xyzuvw") for _ in range(n))
    rows = [(i, word(30) + core + word(rng.randint(3, 40))) for i in range(40)] + [(50 + p, ("abcdefghijk"[:p] * 400)[:300]) for p in range(1, 9)] + [(70 + p, "q" + ("abcdefghijk"[:p] * 400)[:200]) for p in range(1, 9)]
    rows += [(90, rows[3][1] + rows[4][1]), (91, word(10) + rows[5][1])]
    found = suffix_dedup.remove_repeats(docs_of(spark, rows), chunk_bytes=500, key_bytes=3000, string_bytes=3000, pile=5, hot_runs=hot)
    assert sorted(tuple(r) for r in suffix_dedup.digest(found).collect()) == _want_cut([(i, t.encode()) for i, t in rows], 50)


def test_repeats_with_extreme_ids_leave_no_table(spark):
    top, low = 2**63 - 1, -(2**63)
    rows = [(top, "k" * 60), (None, "k" * 60), (top - 1, "m" * 60), (top, "m" * 60)]
    found = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_removed"]) for r in suffix_dedup.remove_repeats(docs_of(spark, rows)).collect())
    assert found == [(False, top - 1, 0), (False, top, 0), (False, top, 60), (True, 0, 60)]
    found = sorted((r["doc_id"], r["n_removed"]) for r in suffix_dedup.remove_repeats(docs_of(spark, [(low, "k" * 60), (top, "k" * 60)])).collect())
    assert found == [(low, 0), (top, 60)]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("terravane")]


# ---- vectors


@pytest.mark.parametrize("block", [8, 512])
def test_vectors_against_brute_force(spark, block):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    vectors = [centres[rng.integers(12)] + rng.normal(scale=0.05, size=16) * rng.integers(0, 3) for _ in range(150)]
    rows = [(i, [float(np.float32(x)) for x in v], int(i % 3)) for i, v in enumerate(vectors)]
    rows += [(200, rows[0][1], 0), (201, [2 * x for x in rows[0][1]], 0), (202, rows[0][1], None), (203, None, 0), (204, [0.0] * 16, 0), (205, [float("nan")] + [1.0] * 15, 0), (206, [None] + [1.0] * 15, 0), (207, [], 0), (208, [1.0, 2.0], 0), (209, [float("inf")] * 16, 0), (0, rows[0][1], 0)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, label int, class string")
    got = embedding_dedup.link_vectors(df, block=block, fanout=2).collect()
    good = [(k, i, np.array(v, float), y) for k, (i, v, y) in enumerate(rows) if y is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links, parent = [0] * len(rows), {i: i for i, _, _ in rows}
    for k, i, v, y in good:
        for m, j, w, z in good:
            if k != m and y == z and len(v) == len(w) and v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= 0.98:
                links[k] += 1
                _join(parent, i, j)
    want = sorted((i, links[k], _find(parent, i), i == _find(parent, i)) for k, (i, _, _) in enumerate(rows))
    assert sorted(tuple(r) for r in got) == want
    assert embedding_dedup.link_vectors(df.where("false")).count() == 0


# ---- MinHash


def _shingles(text):
    words = words_of(text)
    n = min(5, len(words))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if words else set()


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, n = [], 0
    for _ in range(12):
        base = [word() for _ in range(rng.randint(3, 90))]
        for _ in range(rng.randint(1, 9)):
            copy = [w if rng.random() > 0.01 else word() for w in base]
            rows.append((n, " ".join(copy)))
            n += 1
    rows += [(500, None), (501, None), (502, ""), (503, ""), (504, "..."), (505, "one two"), (506, "One, two!"), (507, rows[0][1]), (507, rows[0][1])]
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs_of(spark, rows)).collect()}
    parent = {i: i for i, _ in rows}
    sets = [(i, t, _shingles(t)) for i, t in rows]
    for i, t, a in sets:
        for j, u, b in sets:
            if i < j and t is not None and (t == u or (a and b and len(a & b) >= 0.8 * len(a | b))):
                _join(parent, i, j)
    assert got == {i: _find(parent, i) for i in parent}
    assert minhash.near_duplicates(docs_of(spark).where("false")).count() == 0


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 2)
    monkeypatch.setattr(minhash, "BLOCK", 3)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    rows = [(i, " ".join(w if rng.random() > 0.02 else f"x{rng.random()}" for w in base)) for i in range(30)]
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs_of(spark, rows)).collect()}
    parent, sets = {i: i for i, _ in rows}, {i: _shingles(t) for i, t in rows}
    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                _join(parent, i, j)
    assert got == {i: _find(parent, i) for i in parent}


@pytest.mark.parametrize("weighted", [False, True])
def test_signatures_estimate_the_similarity(weighted):
    rng = np.random.default_rng(0)
    rates, truths = [], []
    for _ in range(30):
        ids = minhash.mix(rng.integers(0, 2**63, 300).astype(np.uint64))
        w = rng.integers(1, 6, 300).astype(float) if weighted else np.ones(300)
        a, b = (ids[:200], w[:200]), (ids[50:250], w[50:250] + (rng.integers(0, 2, 200) if weighted else 0))
        rates.append(np.mean(minhash.signature(*a, 240) == minhash.signature(*b, 240)))
        low = np.minimum(a[1][50:], b[1][:150]).sum()
        truths.append(low / (a[1].sum() + b[1].sum() - low))
    assert abs(np.mean(rates) - np.mean(truths)) < 0.03


# ---- pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(2)
    prose = lambda n: " ".join(rng.choice("the of and house river mountain walking quickly under sky stone".split()) for _ in range(n))
    shared, leak = prose(30), prose(14)
    texts = {1: prose(80), 2: None, 3: "12 34 ...", 4: prose(60) + shared, 5: shared + prose(70), 6: prose(50) + " " + leak, 7: prose(3)}
    texts[8] = texts[1]
    rows = [(i, t, "en", "s", len(t or ""), "x") for i, t in texts.items()] + [(9, texts[1] + " end", None, None, None, "x")]
    (spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, words string").write.parquet(f"{tmp_path}/documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append({r["doc_id"] for r in docs.collect()})
        if k < 4:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        if k == 2:
            cut = {r["doc_id"]: r for r in docs.collect()}
            assert shared in cut[4]["text"] and shared not in cut[5]["text"] and cut[5]["n_chars"] == len(cut[5]["text"])
    assert kept == [{1, 4, 5, 6, 7, 8, 9}, {1, 4, 5, 6, 7}, {1, 4, 5, 6, 7}, {1, 4, 5, 7}, {1, 4, 5, 7}]
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in run.collect()} == {1, 4, 5, 7}
    assert run.where(F.sha2("token_ids", 256) != F.col("ids_sha256")).count() == 0


def test_pipeline_keeps_ids_with_a_kept_row(spark):
    import corpus_pipeline

    a, b = ("one two three four five six seven eight", "red green blue black white brown pink grey")
    rows = [(3, a), (5, a), (5, b), (7, a), (7, a), (8, b), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(kept) == [(3, a), (5, b)]
    nameless = spark.createDataFrame([(None, a), (None, None), (4, b)], "doc_id long, text string").withColumns({c: F.lit(None).cast("string") for c in ("lang", "source", "n_chars")})
    assert len(corpus_pipeline.near_duplicates(spark, nameless, "").collect()) == 3


def test_near_duplicates_with_null_and_repeated_ids(spark):
    words = [f"w{k}" for k in range(60)]
    a, near, other = " ".join(words), " ".join([*words[:58], "x", "y"]), "red green blue black white brown pink grey"
    rows = [(None, a), (4, near), (7, other), (7, a), (None, other + " " + other), (9, None), (None, None)]
    got = sorted(((r["doc_id"], r["class_id"], r["kept"]) for r in minhash.near_duplicates(docs_of(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 4, False), (4, 4, True), (7, 7, True), (7, 4, False), (None, None, True), (9, 9, True), (None, None, True)], key=str)
    only_null = minhash.near_duplicates(docs_of(spark, [(None, a), (None, near)])).collect()
    assert [(r["class_id"], r["kept"]) for r in only_null] == [(None, True)] * 2


def test_blocks_of_large_sets_are_compared_in_tiles():
    rng = np.random.default_rng(3)
    pool = np.unique(minhash.mix(rng.integers(0, 2**63, 3000).astype(np.uint64)))

    def make():
        out = []
        for _ in range(12):
            h = np.sort(rng.choice(pool[:900], 800, replace=False))
            rows = np.empty(len(h), minhash._SET)
            rows["h"], rows["n"] = h, rng.integers(1, 3, len(h))
            out.append(rows)
        return out

    xs, ys = make(), make()
    ys[3] = xs[5]
    want = np.array([[minhash.similarity(x, y) >= 0.7 for y in ys] for x in xs])
    assert want.any() and not want.all()
    for tile in (16, 64, 5000):
        assert (minhash.similar_blocks(xs, ys, 0.7, tile) == want).all()
