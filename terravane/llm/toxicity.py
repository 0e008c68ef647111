"""Toxicity of documents whose writers hide words: a noisy channel restores the text before it is scored.

A character model (interpolated trigrams of folded letters) is counted over all texts. Each word is a lattice: a character
may stand for itself, for the letter that it looks like (leetspeak, other scripts), be a separator put between letters, or
repeat the one before; single characters with spaces between them are one word. Viterbi decoding takes the restoration
of least cost under the character model. A word whose characters have one reading each is its own restoration.

The scores are learned from labelled documents. Every restored word has its 4- and 5-grams and itself as features;
for each hashed feature the number of toxic and of other documents that hold it is counted, which gives shrunken log
odds. A document is judged by its most telling word and by its five most telling ones together, weighed by a logistic
regression on the same documents, each without its own part of the counts.

Labels come from a bounded sample: at most MAX_ROWS labelled ids, as many toxic as other ones where there are as many, those of least hash. Their
documents are counted where they lie; to the driver come one row a bin of the regression, one a telling feature
(BUCKETS at most) and one a letter trigram (2^21 at most).

Defined results: null and empty texts have no words and get the score of a text without a telling word; documents of one id are
each scored, and learned, if labelled, each; null labels are not learned, labels that differ count as their mean; without labels of
either kind all scores are the share of toxic labels (0 without any); an empty table gives no rows; texts of any length are read
whole; columns other than those named are not read.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import repeat
from math import exp
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, slices

#: Ids to learn from; hashed features; documents added to each feature, of the kinds as they come; log odds that a telling word exceeds; telling words of a document that count; width of a bin of the regression.
MAX_ROWS, BUCKETS, ADDED, FLOOR, MOST, BIN = 20_000, 1 << 22, 2.0, 0.0, 5, 0.25
#: Symbols of the character model, and the weight of its shorter contexts.
SYMBOLS, BACK = 128, 5.0
#: Costs of the channel: a character for the letter it looks like, one dropped between letters, a repeated one dropped, a look-alike before a letter that means itself.
LOOKS, BETWEEN, REPEATS, ITSELF = 2.5, 2.0, 3.0, 4.0
#: Words and their scores that a worker keeps.
KEPT = 200_000

#: Letters that characters are used for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "¡": "i", "€": "e", "£": "l", "*": "aeiou"}
#: Letters of other scripts that look like Latin ones.
ALIKE = dict(zip("авеікмнорстухүјѕԁɡαβεικνορτυχ", "abeikmhopctyxyjsdgabeikvoptux", strict=True))


_DOUBLE, _TRIPLE = re.compile(r"(.)\1"), re.compile(r"(.)\1\1")


def fold(word: str) -> str:
    """Compatible forms and letters with marks as plain ones, without characters that have no width."""
    if word.isascii():
        return word
    return "".join(c for c in unicodedata.normalize("NFKD", word) if unicodedata.category(c) not in ("Mn", "Cf"))


def symbol(c: str) -> int:
    """The symbol of a folded character: 0 for a break, then a-z, any digit, other letters by code."""
    if "a" <= c <= "z":
        return ord(c) - 96
    if not c.isalnum():
        return 0
    return 27 if c.isdigit() else 28 + ord(c) % 100


def _table() -> np.ndarray:
    """Symbols of lower-cased characters by code, the first 2^16."""
    return np.array([symbol(fold(chr(i))[:1] or " ") if not 0xD800 <= i < 0xE000 else 0 for i in range(1 << 16)], np.uint8)


@dataclass
class Characters:
    """Costs (negative logarithms) of a symbol after two others; index: first, second, third as digits."""

    costs: array

    @classmethod
    def of(cls, counts: np.ndarray) -> Characters:
        """counts: of all triples of symbols, in three dimensions. Each context's distribution is mixed with the shorter context's.

        A letter beside a digit is no model of a word but what hides one: such steps are left out.
        """
        counts = counts.copy()
        digit = np.arange(SYMBOLS) == 27
        letter = ~digit & (np.arange(SYMBOLS) > 0)
        counts[:, digit[:, None] & letter | letter[:, None] & digit] = 0
        p = np.full(SYMBOLS, 1.0 / SYMBOLS)
        for n in (counts.sum((0, 1)), counts.sum(0), counts):
            total = n.sum(-1, keepdims=True)
            p = (n + BACK * p) / (total + BACK)
        return cls(array("f", (-np.log(p)).astype(np.float32).ravel().tobytes()))


def language_model(docs: DataFrame, text_column: str = "text") -> Characters:
    """Counts letter triples of all texts: one row a task and triple, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = _table(), np.zeros(SYMBOLS**3, np.int64)
        for part in slices(batches, "t"):
            text = "  ".join(t for t in part.column("t").to_pylist() if t).lower()
            s = table[np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), 0xFFFF)]
            s = np.concatenate([[0], s, [0]])
            s = np.concatenate([[0], s[1:][(s[1:] != 0) | (s[:-1] != 0)]]).astype(np.int32)  # breaks in a row are one
            if len(s) > 2:
                total += np.bincount((s[:-2] << 14) | (s[1:-1] << 7) | s[2:], minlength=SYMBOLS**3)
                total += np.bincount(s[1:-1][s[:-2] == 0] << 7 | s[2:][s[:-2] == 0], minlength=SYMBOLS**3)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(total[k])], ["k", "n"])

    found = in_arrow(docs.select(F.col(text_column).cast("string").alias("t")).where("t is not null"), run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SYMBOLS**3)
    counts[found["k"].to_numpy()] = found["n"].to_numpy()
    return Characters.of(counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS))


def lattice(word: str) -> list[list[tuple[int, str, float]]]:
    """The readings of each character of a folded word: symbol (-1: dropped), text and cost."""
    out, before = [], ""
    plain = any("a" <= c <= "z" for c in word)
    for i, c in enumerate(word):
        after = word[i + 1 : i + 2]
        inner = before.isalnum() and after.isalnum()
        found = [(symbol(c), c if c.isalnum() else " ", 0.0 if c.isalnum() or not after.isalpha() else ITSELF if c in LEET else 0.0)]
        if c in LEET and (c != "*" or inner):
            found += [(symbol(x), x, LOOKS) for x in LEET[c]]
        elif c in ALIKE and plain:
            found.append((symbol(ALIKE[c]), ALIKE[c], LOOKS / 2))
        if not c.isalnum() and before and after:
            found.append((-1, "", BETWEEN))
        elif c == before:
            found.append((-1, "", REPEATS))
        out.append(found)
        before = c
    return out


def _doubles(word: str, chars: Characters) -> str:
    """restore() of letters that stand twice in a row at most and have no other reading: what one letter costs depends on its neighbours alone."""
    costs, s = chars.costs, [0, 0, *(c - 96 for c in word.encode()), 0]
    out, at = [], 0
    for i in range(2, len(s) - 2):
        if word[i - 2] == word[i - 1]:
            a, b, c = s[i - 1], s[i], s[i + 2]
            if REPEATS + costs[a << 14 | b << 7 | c] < costs[a << 14 | b << 7 | b] + costs[b << 14 | b << 7 | c]:
                out.append(word[at : i - 1])
                at = i
    return "".join(out) + word[at:]


def restore(word: str, chars: Characters) -> str:
    """The restoration of least cost of a folded word; breaks are spaces."""
    if word.isalpha() and word.isascii() and not _TRIPLE.search(word):
        return _doubles(word, chars) if _DOUBLE.search(word) else word
    readings = lattice(word)
    if all(len(r) == 1 for r in readings):
        return "".join(r[0][1] for r in readings)
    costs, states = chars.costs, {0: (0.0, "")}
    for found in readings:
        new: dict[int, tuple[float, str]] = {}
        for context, (cost, text) in states.items():
            for s, c, own in found:
                if s < 0:
                    key, value, longer = context, cost + own, text
                elif s == 0 and not context & 127:
                    key, value, longer = context, cost + own, text + c
                else:
                    key, value, longer = (context & 127) << 7 | s, cost + own + costs[context << 7 | s], text + c
                if key not in new or value < new[key][0]:
                    new[key] = (value, longer)
        states = new
    return min((cost + (costs[k << 7] if k & 127 else 0.0), text) for k, (cost, text) in states.items())[1]


def words_of(text: str) -> set[str]:
    """The distinct words of a lower-cased text, as they stand, and those of single characters in a row, put together."""
    words = text.split()
    sizes = bytes(map(min, map(len, words), repeat(2)))
    found, at = set(words), sizes.find(b"\1\1\1")
    while at >= 0:
        end = at
        while end < len(sizes) and sizes[end] == 1:
            end += 1
        found.add("".join(words[at:end]))
        at = sizes.find(b"\1\1\1", end)
    return found


def trim(word: str) -> str:
    """A word folded, without the marks around it; one before it that looks like a letter stays."""
    if word.isalpha() and word.isascii():
        return word
    core = fold(word.rstrip(punctuation))
    while core and not core[-1].isalnum():
        core = core[:-1]
    while core and not core[0].isalnum() and core[0] not in LEET:
        core = core[1:]
    return core


def features(core: str, chars: Characters) -> list[int]:
    """Hashed features of the restoration of a trimmed word."""
    out, crc, most = [], zlib.crc32, BUCKETS - 1
    for one in restore(core, chars).split():
        data = f"^{one}$".encode()
        size = len(data)
        out.append(crc(data) & most)
        if size > 4:
            out += [crc(data[i : i + 4]) & most for i in range(size - 3)]
        if size > 5:
            out += [crc(data[i : i + 5]) & most for i in range(size - 4)]
    return out


class Memo(dict):
    """Values of words as they come; long words are not kept, and all go when there are too many."""

    def __init__(self, make: Callable, most: int = KEPT):
        self.make, self.most = make, most

    @classmethod
    def of_words(cls, make: Callable, most: int = KEPT) -> Memo:
        """Values that make gives for trimmed words, kept for words as they stand too."""
        trimmed = cls(make, most)
        return cls(lambda word: trimmed[trim(word)], most)

    def __missing__(self, word: str):
        value = self.make(word)
        if len(word) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = value
        return value


@dataclass
class Model:
    chars: Characters
    weights: dict[int, float] = field(default_factory=dict)
    bias: float = 0.0
    slopes: tuple[float, float] = (0.0, 0.0)

    def word_score(self, core: str) -> float:
        """The weight of the most telling feature of a trimmed word."""
        get = self.weights.get
        return max((get(k, 0.0) for k in features(core, self.chars)), default=0.0)

    def probability(self, most: float, several: float) -> float:
        return 1 / (1 + exp(-min(30.0, max(-30.0, self.bias + self.slopes[0] * most + self.slopes[1] * several))))


def _judged(scores: list[float]) -> tuple[float, float]:
    """The two values that a document is judged by: the odds of its most telling word, and those of its MOST most telling ones together."""
    telling = sorted((s for s in scores if s > FLOOR), reverse=True)[:MOST]
    return (telling[0], sum(telling)) if telling else (0.0, 0.0)


def _sample(labels: DataFrame, id_column: str, label_column: str, most: int) -> tuple[DataFrame, dict[int, int]]:
    """i and y of at most `most` labelled ids, those of least hash of each kind, and the number of all of each kind."""
    marked = labels.select(F.col(id_column).alias("i"), F.col(label_column).cast("double").alias("y")).where("i is not null and y is not null")
    marked = marked.groupBy("i").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    sizes = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    toxic = min(sizes.get(1, 0), max(most // 2, most - sizes.get(0, 0)))
    kind = lambda y, n: marked.where(F.col("y") == y).orderBy(F.xxhash64("i", F.lit(41)), "i").limit(n)
    return kind(1, toxic).unionByName(kind(0, most - toxic)), sizes


def calibrate(x: np.ndarray, y: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Coefficients of a logistic regression of y (0 or 1) on the columns of x (the first is 1) with weights part: Newton steps, halved until the loss falls. Slopes are not negative."""
    ridge = np.array([1e-3, *[0.1] * (x.shape[1] - 1)])
    loss = lambda b: (part * (np.logaddexp(0, x @ b) - y * (x @ b))).sum() + 0.5 * (ridge * b * b).sum()
    inside = lambda b: np.concatenate([b[:1], np.maximum(b[1:], 0)])
    b = np.zeros(x.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -500, 500)))
        slope, bend = x.T @ (part * (p - y)) + ridge * b, (x * (part * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        free = np.flatnonzero((b > 0) | (slope < 0) | (np.arange(len(b)) == 0))  # a slope at 0 that would fall stays
        step = np.zeros_like(b)
        step[free] = np.linalg.solve(bend[np.ix_(free, free)], slope[free])
        size, now = 1.0, loss(b)
        while size > 1e-9 and loss(inside(b - size * step)) > now:
            size /= 2
        fresh = inside(b - size * step)
        if now - loss(fresh) <= 1e-9 * abs(now):
            break
        b = fresh
    return b


def learn(docs: DataFrame, labels: DataFrame, chars: Characters, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", max_rows: int = MAX_ROWS) -> Model:
    """Learns from the documents of at most max_rows labelled ids."""
    picked, sizes = _sample(labels, id_column, label_column, max_rows)
    if len(sizes) < 2:
        return Model(chars, bias=-30.0 if not sizes.get(1) else 30.0)
    rows = docs.select(F.col(id_column).alias("i"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("t")).join(F.broadcast(picked), "i").select("y", "t")
    shared = docs.sparkSession.sparkContext.broadcast(chars)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo.of_words(lambda w: np.array(features(w, shared.value), np.int32), KEPT // 2)
        total, n = np.zeros((2, BUCKETS), np.int32), [0, 0]
        for part in slices(batches, "t"):
            for y, text in zip(part.column("y").to_pylist(), part.column("t").to_pylist(), strict=True):
                n[y] += 1
                found = [memo[w] for w in words_of(text.lower())]
                if found:
                    total[y, np.unique(np.concatenate(found))] += 1
        k = np.flatnonzero(total.any(0))
        # the numbers of documents stand at a bucket that no feature has
        yield pa.RecordBatch.from_arrays([pa.array(np.append(k, BUCKETS).astype(np.int32)), *[pa.array(np.append(total[y, k], n[y]).astype(np.int64)) for y in (0, 1)]], ["k", "n0", "n1"])

    counted = in_arrow(rows, count, "k int, n0 long, n1 long").groupBy("k").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where("n1 > 1").toArrow()
    k, n0, n1 = (counted[c].to_numpy() for c in ("k", "n0", "n1"))
    ends = k == BUCKETS
    docs0, docs1 = (int(x[ends][0]) if ends.any() else 0 for x in (n0, n1))
    share = sizes[1] / sum(sizes.values())
    ratio = (1 - share) / share * docs1 / max(1, docs0)  # other documents that one of the sample stands for, to each toxic one

    def odds(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
        return np.log((n1 + ADDED * share) / (n0 * ratio + ADDED * (1 - share)))

    telling = ~ends & (odds(np.maximum(n0 - 1, 0), n1) > FLOOR)  # also without one other document, as judge() needs them
    k, n0, n1 = (x[telling] for x in (k, n0, n1))
    weights = odds(n0, n1)
    own = docs.sparkSession.sparkContext.broadcast((k, n0, n1))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, n0, n1 = own.value
        by = []  # weights without a document of each kind
        for y in (0, 1):
            w = odds(np.maximum(n0 - (1 - y), 0), n1 - y)
            by.append(Model(shared.value, dict(zip(k.tolist(), np.maximum(w, 0.0).tolist(), strict=True))))
        memos = [Memo.of_words(m.word_score, KEPT // 2) for m in by]
        out: list[tuple] = []
        for part in slices(batches, "t"):
            for y, text in zip(part.column("y").to_pylist(), part.column("t").to_pylist(), strict=True):
                out.append((y, *[round(v / BIN) for v in _judged([memos[y][w] for w in words_of(text.lower())])]))
        columns = list(zip(*out, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in columns], ["y", "most", "several"])

    bins = in_arrow(rows, judge, "y int, most int, several int").groupBy("y", "most", "several").count().collect()
    held = [sum(r["count"] for r in bins if r["y"] == y) for y in (0, 1)]
    x = np.array([(1.0, r["most"] * BIN, r["several"] * BIN) for r in bins] or [(1.0, 0.0, 0.0)])
    y = np.array([r["y"] for r in bins] or [0], float)
    # kinds weigh as they do in all labels
    part = np.array([r["count"] * sizes[r["y"]] / sum(sizes.values()) / held[r["y"]] for r in bins] or [1.0]) * max(1, sum(held))
    b = calibrate(x, y, part)
    return Model(chars, {i: w for i, w in zip(k.tolist(), weights.tolist(), strict=True) if w > FLOOR}, float(b[0]), (float(b[1]), float(b[2])))


def score(docs: DataFrame, model: Model, text_column: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, score (0 to 1, higher: toxic likelier) and predicted, from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    picked = docs.select(*keep, F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("_text"))
    schema = picked.select(*keep, F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        memo = Memo.of_words(model.word_score)
        for part in slices(batches, "_text"):
            found = [model.probability(*_judged([memo[w] for w in words_of(t.lower())])) for t in part.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found, pa.float64()), pa.array([int(p >= 0.5) for p in found], pa.int32())], schema.names)

    return in_arrow(picked, run, schema)


def restored(docs: DataFrame, chars: Characters, text_column: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and the text with each word restored, words with one space between them."""
    shared = docs.sparkSession.sparkContext.broadcast(chars)
    picked = docs.select(*keep, F.col(text_column).cast("string").alias("_text"))
    schema = picked.select(*keep, F.lit(None).cast("string").alias("restored")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(lambda w: restore(fold(w), shared.value).strip())
        for part in slices(batches, "_text"):
            texts = [None if t is None else " ".join(memo[w] for w in joined(t.lower())) for t in part.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], schema.names)

    return in_arrow(picked, run, schema)


def joined(text: str) -> list[str]:
    """The words of a lower-cased text in order; three or more single characters in a row are one word."""
    out: list[str] = []
    single: list[str] = []
    for word in [*text.split(), ""]:
        if len(word) == 1:
            single.append(word)
            continue
        out += ["".join(single)] if len(single) > 2 else single
        single = []
        if word:
            out.append(word)
    return out
