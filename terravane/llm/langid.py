"""Language identification by error-correcting output codes.

Each language has a codeword of +1/-1 bits; one binary classifier per bit, over hashed byte n-grams
of the whole lower-cased text, predicts that bit. Decoding sums an exponential loss per bit, weighted
by how well that bit's classifier reproduces that language's bit in training, and takes the codeword
of least loss; if the second is nearly as near, the text is flagged as ambiguous.

The classifiers are ridge regressions on a bounded sample: of every label the same number of rows, those of least
hash, MAX_ROWS in all but LEAST_ROWS of each label at least, so that no label is lost; each whole and as one piece of
PIECE_WORDS words, so that short texts are learned. The driver holds the sample's sparse features; up to DIRECT_ROWS
rows also one table of them by themselves, beyond that the regressions are solved step by step (conjugate gradients).

Defined results: null texts and texts without a letter (str.isalpha) are `und` with score 0 and not
ambiguous; rows without a label are never learned; with one learned language all texts with letters get it;
with none all get `und`; repeated rows each get a result and are learned once; texts of any length are read whole; an empty
table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import in_arrow, slices

BUCKETS = 1 << 13
#: Rows to learn from, least rows of a label, words of a piece, ridge penalty, and the relative gap of losses below which a text is ambiguous.
MAX_ROWS, LEAST_ROWS, PIECE_WORDS, PENALTY, GAP = 1000, 2, 8, 0.3, 0.02
#: Rows (two of each sampled one) whose regressions are solved at once.
DIRECT_ROWS = 3000
#: Rows of the sample that are spread out to full width at once.
BLOCK = 256
#: Byte table: ASCII characters that are no letters to a space.
_SPACED = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def counts(text: str) -> np.ndarray:
    """Hashed counts of the 1- to 3-byte grams of a text."""
    data = np.frombuffer(f" {text.lower()} ".encode().translate(_SPACED), np.uint8).astype(np.uint32)
    pair = data[:-1] * np.uint32(263) + data[1:]
    triple = pair[:-1] * np.uint32(65599) + data[2:]
    out = np.bincount((triple * np.uint32(2654435761)) >> np.uint32(19), minlength=BUCKETS)
    out += np.bincount(((pair + np.uint32(7)) * np.uint32(2246822519)) >> np.uint32(19), minlength=BUCKETS)
    out[: 1 << 8] += np.bincount(data, minlength=1 << 8)
    return out


def features(text: str) -> np.ndarray:
    x = np.log1p(counts(text)).astype(np.float32)
    return x / max(np.sqrt(x @ x), 1e-6)


def codewords(k: int, seed: int = 11) -> np.ndarray:
    """k codewords: exhaustive for up to five languages, else the best of some random dense codes."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 5:
        bits = [b for b in product((1, -1), repeat=k) if b[0] == 1 and -1 in b]
        return np.array(bits, float).T
    rng, length = np.random.default_rng(seed), int(np.ceil(10 * np.log2(k)))
    best, most = None, -1
    for _ in range(64):
        code = rng.choice((-1.0, 1.0), (k, length))
        code = code[:, np.abs(code.sum(0)) < k]
        near = (code.shape[1] - (code @ code.T)[np.tril_indices(k, -1)].max()) / 2
        if near > most:
            best, most = code, near
    return best


@dataclass
class Model:
    labels: list[str]
    code: np.ndarray
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    trust: np.ndarray  # languages x bits, rows sum to 1

    def losses(self, x: np.ndarray) -> np.ndarray:
        """rows x languages."""
        margins = x @ self.weights + self.bias
        return np.einsum("rlb,lb->rl", np.exp(-np.clip(margins[:, None, :] * self.code[None], -6, 6)), self.trust)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.labels or not has_letter(text):
            return "und", 0.0, False
        if len(self.labels) == 1:
            return self.labels[0], 1.0, False
        loss = self.losses(features(text)[None])[0]
        order = np.argsort(loss, kind="stable")
        odds = np.exp(-4 * (loss - loss[order[0]]))
        return self.labels[order[0]], float(odds[order[0]] / odds.sum()), bool(loss[order[1]] - loss[order[0]] < GAP * loss[order[1]])


class Sample:
    """Sparse feature rows: the buckets and values of each, spread out to full width a block at a time."""

    def __init__(self, buckets: np.ndarray, values: np.ndarray, ends: np.ndarray):
        self.buckets, self.values, self.ends = buckets, values, ends

    def __len__(self) -> int:
        return len(self.ends)

    def block(self, i: int) -> np.ndarray:
        """Rows from i * BLOCK on, with a last column of ones."""
        a, b = i * BLOCK, min((i + 1) * BLOCK, len(self))
        out = np.zeros((b - a, BUCKETS + 1), np.float32)
        out[:, -1] = 1
        lo, hi = self.ends[a - 1] if a else 0, self.ends[b - 1]
        out[np.repeat(np.arange(b - a), np.diff(self.ends[a:b], prepend=lo)), self.buckets[lo:hi]] = self.values[lo:hi]
        return out


def _direct(x: Sample, share: np.ndarray, target: np.ndarray, penalty: float) -> np.ndarray:
    """The rows' parts d with (S X X' S + penalty) d = target, S the diagonal of share."""
    n = len(x)
    inner, at = np.empty((n, n)), lambda i: slice(i * BLOCK, (i + 1) * BLOCK)
    for i in range(-(-n // BLOCK)):
        one = x.block(i)
        for j in range(i + 1):
            inner[at(i), at(j)] = one @ (one if i == j else x.block(j)).T
            inner[at(j), at(i)] = inner[at(i), at(j)].T
    inner *= share
    inner *= share.T
    inner[np.arange(n), np.arange(n)] += penalty
    return np.linalg.solve(inner, target)


def _stepwise(x: Sample, share: np.ndarray, target: np.ndarray, penalty: float, most: int = 200) -> np.ndarray:
    """As _direct() by conjugate gradients, all bits at once, without a table of rows by rows."""
    blocks = range(-(-len(x) // BLOCK))
    at = lambda i: slice(i * BLOCK, (i + 1) * BLOCK)

    def times(d: np.ndarray) -> np.ndarray:
        part = (d * share).astype(np.float32)
        w = sum(x.block(i).T @ part[at(i)] for i in blocks)
        return np.concatenate([x.block(i) @ w for i in blocks]) * share + penalty * d

    d, rest = np.zeros_like(target), target.copy()
    step, size = rest.copy(), (rest * rest).sum(0)
    for _ in range(most):
        moved = times(step)
        by = size / np.maximum((step * moved).sum(0), 1e-300)
        d += by * step
        rest -= by * moved
        fresh = (rest * rest).sum(0)
        if fresh.max() <= 1e-6 * (target * target).sum(0).max():
            break
        step, size = rest + fresh / np.maximum(size, 1e-300) * step, fresh
    return d


def fit(labels: list[str], x: Sample, y: np.ndarray, penalty: float = PENALTY) -> Model:
    """y: row numbers of labels. One ridge regression per bit, rows weighted so that languages weigh alike; solved for the rows' parts, then summed over the rows."""
    code, n = codewords(len(labels)), len(x)
    if len(labels) < 2:
        return Model(labels, code, np.zeros((BUCKETS, code.shape[1])), np.zeros(code.shape[1]), np.ones(code.shape))
    share = np.sqrt(n / (len(labels) * np.bincount(y, minlength=len(labels))))[y][:, None]
    blocks = range(-(-n // BLOCK))
    at = lambda i: slice(i * BLOCK, (i + 1) * BLOCK)
    dual = (_direct if n <= DIRECT_ROWS else _stepwise)(x, share, code[y] * share, penalty) * share
    w, margins = np.zeros((BUCKETS + 1, code.shape[1])), np.empty((n, code.shape[1]))
    for i in blocks:
        w += x.block(i).T @ dual[at(i)].astype(np.float32)
    for i in blocks:
        margins[at(i)] = x.block(i) @ w.astype(np.float32)
    right = np.array([((margins[y == i] * code[i]) > 0).mean(0) for i in range(len(labels))])
    trust = np.maximum(right - 0.5, 0.01)
    return Model(labels, code, w[:-1], w[-1], trust / trust.sum(1, keepdims=True))


def learn(rows: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang", max_rows: int = MAX_ROWS) -> Model:
    """Learns from rows whose label is not null and whose text has a letter: of each label as many, those of least hash, max_rows in all but LEAST_ROWS of each label; what comes to the driver is bounded by that."""
    rows = rows.select(F.col(id_column).alias("i"), F.col(text_column).cast("string").alias("t"), F.col(label_column).cast("string").alias("y")).where("y is not null").where(F.col("t").rlike(r"\p{L}"))
    hashed = rows.withColumn("h", F.xxhash64("i", "t", F.lit(17)))
    narrow = hashed.select("y", "h").distinct()
    labels = rows.agg(F.count_distinct("y")).first()[0]
    if not labels:
        return fit([], Sample(np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(0, int)), np.zeros(0, int))
    quota = max(LEAST_ROWS, max_rows // labels)
    least = lambda rows, *keys: rows.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("h"))).where(F.col("k") <= quota).drop("k")
    # of parts of a label first, so that no task gets all rows of one
    nth = least(least(narrow.withColumn("part", F.pmod("h", F.lit(64))), "y", "part"), "y").select("y", "h")
    nth = F.broadcast(nth) if quota * labels <= 100_000 else nth
    picked = hashed.join(nth, ["y", "h"]).groupBy("y", "h").agg(F.first("t").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            out: dict = {"y": [], "k": [], "v": []}
            for text, y in zip(part.column("t").to_pylist(), part.column("y").to_pylist(), strict=True):
                if not has_letter(text):
                    continue
                words = text.split()
                at = zlib.crc32(text.encode()) % max(1, len(words) - PIECE_WORDS)
                for piece in (text, " ".join(words[at : at + PIECE_WORDS])):
                    x = features(piece)
                    k = np.flatnonzero(x)
                    out["y"].append(y)
                    out["k"].append(k.astype(np.int32))
                    out["v"].append(x[k])
            yield pa.RecordBatch.from_arrays([pa.array(out["y"], pa.string()), pa.array(out["k"], pa.list_(pa.int32())), pa.array(out["v"], pa.list_(pa.float32()))], ["y", "k", "v"])

    got = in_arrow(picked, run, "y string, k array<int>, v array<float>").toArrow().sort_by([("y", "ascending")]).combine_chunks()
    names = got["y"].to_pylist()
    learned = sorted(set(names))
    number = {y: i for i, y in enumerate(learned)}
    flat = lambda name: pc.list_flatten(got[name]).to_numpy()
    return fit(learned, Sample(flat("k"), flat("v"), np.cumsum(pc.list_value_length(got["k"]).to_numpy())), np.array([number[y] for y in names], int))


def identify(rows: DataFrame, model: Model, text_column: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, lang_pred, score and ambiguous, from the text alone."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    picked = rows.select(*keep, F.col(text_column).alias("_text"))
    schema = picked.select(*keep, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("ambiguous")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            found = [shared.value.predict(t) for t in part.column("_text").to_pylist()]
            columns = list(zip(*found, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.bool_())], schema.names)

    return in_arrow(picked, run, schema)
