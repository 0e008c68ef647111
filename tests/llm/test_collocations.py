"""Phrase collocations against a count of every phrase in Python."""

import random
import re
from collections import Counter

import pytest

from terravane.llm import collocations as co

SCHEMA = "doc_id long, text string, lang string, n long, w1 string, phrase string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, "clash", "clash") for i, (t, lang) in enumerate(rows)], SCHEMA)


def expected(rows):
    counts, totals = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        own = counts.setdefault(lang, Counter())
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            own.update(tuple(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    for lang, own in counts.items():
        found = []
        for phrase, a in own.items():
            longer = [n for p, n in own.items() if len(p) == 3 and n >= 10 and phrase in (p[:2], p[1:])] if len(phrase) == 2 else []
            if len(phrase) == 1 or a < 10 or any(100 * n >= 50 * a for n in longer):
                continue
            score, k = min((10**6 * a * a // (own[phrase[:k]] * own[phrase[k:]]), k) for k in range(1, len(phrase)))
            found.append((-score, -a, " ".join(phrase).encode(), own[phrase[:k]], own[phrase[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:2000], 1):
            yield lang, rank, p.decode(), -a, left, right, totals[lang], -s


def same(spark, rows):
    got = [tuple(r) for r in co.collocations(frame(spark, rows)).collect()]
    assert sorted(got) == sorted(expected(rows))
    return got


def texts(seed=3, n=120):
    rng = random.Random(seed)
    words = ["the", "of", "The", "a\x01b", "é", "日本", "x" * 40, "rare%d"]
    ends = [" ", "  ", "\t", ". ", "\n", ",", " !"]
    return ["".join((rng.choice(words) if rng.random() < 0.9 else f"w{rng.randrange(50)}") + rng.choice(ends) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_small_shards_ranges_and_chunks(spark, monkeypatch):
    for name, value in (("RANGE_BYTES", 1 << 10), ("SAMPLE_BYTES", 1 << 9)):
        monkeypatch.setattr(co, name, value)
    rows = [(t, lang) for t, lang in zip(texts(), ["en", "de", None, "und"] * 30, strict=True)]
    assert len(same(spark, rows)) > 20


@pytest.mark.parametrize("chunk, shard", [(7, 13), (64, 50), (1 << 20, 3)])
def test_shards_hand_over_their_last_words(chunk, shard, monkeypatch):
    monkeypatch.setattr(co, "CHUNK_BYTES", chunk)
    total, now = [Counter(), Counter(), Counter()], co.Shard()

    def count(s):
        words, levels, base = s.levels()
        for k, (keys, counts) in enumerate([levels[0], levels[1], levels[2][:2]]):
            for key, n in zip(keys.tolist(), counts.tolist(), strict=True):
                pair = levels[2][2][key // base] if k == 2 else 0
                digits = [[key], [key // base, key % base], [pair // base, pair % base, key % base]][k]
                total[k][tuple(words[int(d)] for d in digits)] += n

    want = Counter()
    for text in texts(5, 20):
        for words in co.words_of(text):
            now.add(words)
            if now.size >= shard:
                count(now)
                now = now.next()
        for piece in re.split(b"[.,;:!?\n\x0b\x0c\r]", text.encode()):
            w = re.findall(b"[^ \t]+", piece.lower())
            want.update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    count(now)
    assert total[0] + total[1] + total[2] == want


def test_nulls_empty_repeats_and_long_texts(spark):
    long = "alpha beta gamma delta. " * 20_000
    rows = [(None, "en"), ("", None), ("...", "en"), (long, "en"), ("one two three", None)] + [("one two three", "und")] * 12
    got = same(spark, rows)
    assert {r[0] for r in got} == {"en", "und"}


def test_empty_table(spark):
    assert co.collocations(frame(spark, [("x", "y")]).limit(0)).collect() == []


def test_scores_pass_64_bits(spark):
    rows = [(3 * 10**15, 4 * 10**15, 10**17), (12345678901234, 99999999999999, 88888888888888), (7, 7, 7)]
    df = spark.createDataFrame(rows, "a long, l long, r long")
    assert [r[0] for r in df.select(co.score_cut(df.a, df.l, df.r)).collect()] == [10**6 * a * a // (x * y) for a, x, y in rows]


def test_rank_ties_go_by_bytes(spark):
    rows = [(f"{w}1 {w}2. " * 10, "en") for w in ("b", "é", "a", "日", "Z")]
    assert [r[2] for r in sorted(same(spark, rows), key=lambda r: r[1])] == ["a1 a2", "b1 b2", "z1 z2", "é1 é2", "日1 日2"]


def test_a_shard_gives_up_its_words_when_it_is_counted():
    shard = co.Shard((b"a", b"b"))
    shard.add([b"c", b"a", b"b", b"c", b"\xff", b"a"])
    words, levels, base = shard.levels()
    assert shard.runs == [] and words == [b"a", b"b", b"c"] and base == 4
    (k1, n1), (k2, n2), (k3, n3, known) = levels
    assert dict(zip(k1.tolist(), n1.tolist(), strict=True)) == {0: 2, 1: 1, 2: 2}
    assert dict(zip(k2.tolist(), n2.tolist(), strict=True)) == {1: 1, 1 * 4 + 2: 2, 2 * 4: 1}
    assert sorted((known[k // 4].item(), k % 4, n) for k, n in zip(k3.tolist(), n3.tolist(), strict=True)) == [(1, 2, 2), (6, 0, 1), (8, 1, 1)]
