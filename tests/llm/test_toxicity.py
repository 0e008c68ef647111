"""Toxicity: the channel against all restorations of a word, hidden words, held-out labels, defined results."""

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravane.llm import toxicity as tx
from terravane.llm.queries import queries

SCHEMA = "doc_id long, text string, score string, predicted string, y int, restored string"
FOLDER = "/root/testdata/sf0.01"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash", 7, "clash") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def chars(spark):
    plain = ["the quiet river runs to the old mill and the idiot sleeps", "a loser is not a moron or an idiot who says scum", "stupid people and noble rivers"] * 20
    return tx.language_model(frame(spark, list(enumerate(plain))))


def ways(word, chars):
    """Text and cost of all ways through the lattice."""
    for way in product(*tx.lattice(word)):
        a = b = 0
        cost = 0.0
        for s, _, own in way:
            cost += own
            if s < 0 or s == b == 0:
                continue
            cost += chars.costs[(a * 128 + b) * 128 + s]
            a, b = b, s
        yield "".join(c for _, c, _ in way), cost + (chars.costs[(a * 128 + b) * 128] if b else 0.0)


@pytest.mark.parametrize("word", ["1d10t", "l.o.s.e.r", "scuum", "$cum", "m0r0n", "a!b", "ri-ver", "2024", "sc*m", "(x)", "mоron", "ooo"])
def test_viterbi_finds_the_cheapest_restoration(word, chars):
    word = tx.fold(word)
    found = tx.restore(word, chars)
    assert min(c for text, c in ways(word, chars) if text == found) == pytest.approx(min(c for _, c in ways(word, chars)), abs=1e-4)


def test_hidden_words_are_restored(chars):
    for hidden, word in (("1d10t", "idiot"), ("l0s3r", "loser"), ("m-o-r-o-n", "moron"), ("stuuuupid", "stupid"), ("$cum", "scum"), ("ıdıot".replace("ı", "í"), "idiot"), ("mоrоn", "moron"), ("i​diot", "idiot")):
        assert tx.restore(tx.fold(hidden), chars) == word
    assert tx.joined("you i d i o t !! a b") == ["you", "idiot", "!!", "a", "b"]


def test_plain_words_are_their_own_restoration(chars):
    for word in ("river", "mill", "noble", "日本", "straße"):
        assert tx.restore(word, chars) == word


def test_restored_text_and_nulls(spark, chars):
    got = {r["doc_id"]: r["restored"] for r in tx.restored(frame(spark, [(1, None), (2, ""), (3, "The 1d10t, l o s e r")]), chars).collect()}
    assert got[1] is None and got[2] == "" and [w.strip(" ,") for w in got[3].split()] == ["the", "idiot", "loser"]


def test_the_model_counts_all_texts(spark):
    model = tx.language_model(frame(spark, [(1, "ab"), (2, "ab"), (3, None), (4, "x " * 1_000_000)]))
    counts = np.exp(-np.array(model.costs)).reshape(128, 128, 128)
    a, b, x = 1, 2, 24
    assert counts[0, 0, x] == pytest.approx(1.0, abs=1e-4) and counts[0, a, b] > 0.1 and counts[0, x, 0] > 0.99
    assert np.allclose(counts.sum(-1), 1, atol=1e-4)


def toxic_rows(n=200):
    rng = np.random.default_rng(4)
    words = np.array(["river", "mill", "house", "stone", "water", "green", "light", "paper", "table", "window"])
    hidden = ["idiot", "1d10t", "i d i o t", "idiiiot", "i.d.i.o.t"]
    out = []
    for i in range(n):
        text = " ".join(rng.choice(words, 30))
        out.append((i, f"{text} {hidden[i % 5] if i >= n // 2 else 'idiot'} {text}" if i % 4 == 0 else text, i % 4 == 0))
    return out


def test_hidden_words_count_as_plain_ones(spark):
    rows = toxic_rows()
    docs = frame(spark, [r[:2] for r in rows])
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows if i < 100] + [(3, None), (None, 1)], "doc_id long, toxic int")
    model = tx.learn(docs, labels, tx.language_model(docs))
    got = {r["doc_id"]: r for r in tx.score(docs.unionByName(frame(spark, [(900, None), (901, ""), (902, "1d10t " + "water " * 300_000), (902, "x")])), model).collect()}
    assert all(got[i]["predicted"] == int(y) == int(got[i]["score"] >= 0.5) for i, _, y in rows)
    assert got[900]["score"] == got[901]["score"] < 0.5


def test_the_regression_reaches_its_optimum():
    """Also where the kinds are far apart, one is rare, and the columns go together."""
    rng = np.random.default_rng(1)
    for gap in (1.0, 6.0):
        y = (rng.random(4000) < 0.1).astype(float)
        most = np.maximum(rng.normal(0.3, 0.5, 4000) + gap * y, 0).round(2)
        x = np.stack([np.ones(4000), most, most * (1 + 3 * y * rng.random(4000))], 1)
        b = tx.calibrate(x, y, np.ones(4000))
        p = 1 / (1 + np.exp(-x @ b))
        assert (b[1:] >= 0).all() and abs(p.mean() - y.mean()) < 0.002
        if gap > 5:
            assert ((p > 0.5) == (y > 0)).mean() > 0.999
    assert tx.calibrate(np.ones((4, 3)), np.array([0.0, 0, 0, 1]), np.ones(4))[0] < 0


def test_one_kind_no_label_and_empty_tables(spark, chars):
    docs = frame(spark, [(1, "river"), (2, "mill")])
    labels = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")
    scores = lambda model: {r["score"] for r in tx.score(docs, model).collect()}
    assert min(scores(tx.learn(docs, labels, chars))) > 0.99
    assert max(scores(tx.learn(docs, labels.limit(0), chars))) < 0.01
    empty = docs.limit(0)
    model = tx.learn(empty, labels.withColumn("toxic", F.col("doc_id").cast("int") - 1), tx.language_model(empty))
    assert tx.score(empty, model).collect() == [] and len(scores(model)) == 1


def test_the_sample_is_bounded_and_the_same_each_time(spark):
    labels = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 10 == 0).cast("int").alias("toxic"))
    sample = lambda: sorted(map(tuple, tx._sample(labels.repartition(3), "doc_id", "toxic", 600)[0].collect()))
    got = sample()
    assert got == sample() and len(got) == 600 and sum(y for _, y in got) == 300


def test_held_out_labels(spark):
    got = queries()["op13_toxicity"](spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").toPandas()
    for held, least in ((False, 0.9), (True, 0.75)):
        part = got[got["held_out"] == held]
        order = part["score"].rank()
        n1 = (part["toxic"] == 1).sum()
        auc = (order[part["toxic"] == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(part) - n1))
        assert auc > least
