"""Document quality by a linear-chain conditional random field over lines.

Every line has binned features of its own and those of the line before and after; a two-state chain
(bad, good) over a document's lines gives forward-backward marginals, and the document's quality is
their mean weighted by line length, put on a probability scale by a logistic curve.

The field learns from a bounded sample of whole documents: the MAX_ROWS labelled ids of least hash, in
that order as long as their lines are MAX_LINES in all (one that does not fit is passed over); every
line of a document takes its label, and each document weighs alike, however many lines it has. So what
comes to the driver is bounded by MAX_LINES. Scores use the text alone.

Defined results: a null or empty text is one empty line and gets a score like any other; rows
without a label are never learned; repeated labels of one id count by their mean (0.5 or more is
good); of documents with one labelled id, the one of least hash is learned, and each is scored; if the
labels are all one kind or absent, every score is that share (0.5 without any); texts and lines of
any length are read whole; an empty table gives no rows; columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, materialise, slices

#: Labelled documents and lines of them to learn from, lines of a training chain, steps and step size of the ascent, L2 penalty.
MAX_ROWS, MAX_LINES, CHAIN, STEPS, RATE, PENALTY = 1500, 200_000, 64, 150, 0.08, 0.002
#: Training chains that are worked on at once.
BLOCK = 4096

LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
UPPER, DIGITS, SPACES = bytes(range(65, 91)), bytes(range(48, 58)), b" \t\r\f\v"
SYMBOLS, STOPS = b"#$%&*|!<>{}[]@^~=+\\/_", b".,;:?'\"()-"
#: Upper bounds of the bins of each feature.
BINS = [
    (0, 20, 60, 120, 250, 500, 1000),  # characters
    (0, 2, 5, 12, 30, 80, 200),  # words
    (0.3, 0.5, 0.65, 0.75, 0.82, 0.9),  # share of letters
    (0, 0.01, 0.03, 0.06, 0.15, 0.4),  # share of upper case
    (0, 0.01, 0.03, 0.08, 0.2),  # share of digits
    (0, 0.005, 0.02, 0.05, 0.1, 0.2),  # share of symbols
    (0, 0.01, 0.02, 0.04, 0.08, 0.15),  # share of marks
    (0.1, 0.25, 0.4, 0.55, 0.7, 0.85, 0.95),  # distinct words of all words
    (0, 0.02, 0.1, 0.3, 0.6),  # words equal to the one before
    (2, 3, 4, 5, 6, 8, 12),  # characters a word
    (0, 1),  # ends with a full stop; no words
]
WIDTH = 9


def line_values(line: str) -> tuple:
    data, words = line.encode(), line.split()
    n, k = max(1, len(data)), len(words)
    count = lambda drop: (len(data) - len(data.translate(None, drop))) / n
    same = sum(map(str.__eq__, words, words[1:])) / k if k > 1 else 0.0
    end = 0 if not k else 1 if line.rstrip()[-1] in ".!?" else 2
    return len(line), k, count(LETTERS), count(UPPER), count(DIGITS), count(SYMBOLS), count(STOPS), len(set(words)) / k if k else 1.0, same, len(line) / k if k else 0.0, end


def bins_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Per line: a bin number per feature (columns offset so that all are distinct), and its length."""
    lines = (text or "").split("\n")
    values = np.array([line_values(x) for x in lines])
    out = np.empty(values.shape, np.int16)
    for j, edges in enumerate(BINS):
        out[:, j] = np.searchsorted(edges, values[:, j], "left") + j * WIDTH
    return out, values[:, 0]


@dataclass
class Field:
    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    bias: float
    step: np.ndarray  # 2 x 2: score of going from bad or good to bad or good
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None

    def emissions(self, bins: np.ndarray) -> np.ndarray:
        """Good minus bad, per line of one document."""
        u = self.own[bins].sum(1) + self.bias
        u[1:] += self.before[bins[:-1]].sum(1)
        u[:-1] += self.after[bins[1:]].sum(1)
        return u


def marginals(emissions: list[np.ndarray], step: np.ndarray) -> list[np.ndarray]:
    """P(good) of every line, by forward and backward passes over all documents at once, longest first."""
    if not emissions:
        return []
    order = np.argsort([-len(u) for u in emissions], kind="stable")
    sizes = np.array([len(emissions[i]) for i in order])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    flat = np.concatenate([emissions[i] for i in order])
    ahead, back = np.zeros(len(flat)), np.zeros(len(flat))  # log odds of good against bad
    live = [int((sizes > t).sum()) for t in range(sizes[0])]
    (bb, bg), (gb, gg) = step
    carry = lambda odds, a, b, c, d: np.logaddexp(b, odds + d) - np.logaddexp(a, odds + c)
    ahead[starts] = flat[starts]
    for t in range(1, sizes[0]):
        at = starts[: live[t]] + t
        ahead[at] = flat[at] + carry(ahead[at - 1], bb, bg, gb, gg)
    for t in range(sizes[0] - 2, -1, -1):
        at = starts[: live[t + 1]] + t
        back[at] = carry(flat[at + 1] + back[at + 1], bb, gb, bg, gg)
    p = 1 / (1 + np.exp(-np.clip(ahead + back, -40, 40)))
    out: list = [None] * len(emissions)
    for i, a, n in zip(order, starts, sizes, strict=True):
        out[i] = p[a : a + n]
    return out


def _weighted(p: np.ndarray, sizes: np.ndarray) -> float:
    return float((p * sizes).sum() / sizes.sum()) if sizes.sum() else float(p.mean())


def _logit(p: float) -> float:
    p = min(max(p, 1e-4), 1 - 1e-4)
    return float(np.log(p / (1 - p)))


def _gradient(w: np.ndarray, own: np.ndarray, mask: np.ndarray, truth: np.ndarray, part: np.ndarray, size: int) -> np.ndarray:
    """Gradient of the log likelihood of some chains (bins, real lines, labels, weight of a line)."""
    n, long, width = len(own), mask.shape[1], own.shape[2]
    scale, pairs = part[:, None] * mask, mask[:, 1:]
    tables = w[: 3 * (size + 1)].reshape(3, size + 1)
    u = tables[0][own[:, 1:-1]].sum(2) + tables[1][own[:, :-2]].sum(2) + tables[2][own[:, 2:]].sum(2) + w[-5]
    (bb, bg), (gb, gg) = w[-4:].reshape(2, 2)
    a = np.zeros((n, long, 2))
    z = np.zeros((n, long, 2))
    a[:, 0, 1] = u[:, 0]
    for t in range(1, long):
        x = a[:, t - 1]
        a[:, t, 0] = np.logaddexp(x[:, 0] + bb, x[:, 1] + gb)
        a[:, t, 1] = np.logaddexp(x[:, 0] + bg, x[:, 1] + gg) + u[:, t]
    for t in range(long - 2, -1, -1):
        x0, x1 = z[:, t + 1, 0], z[:, t + 1, 1] + u[:, t + 1]
        z[:, t, 0] = np.where(mask[:, t + 1], np.logaddexp(bb + x0, bg + x1), 0)
        z[:, t, 1] = np.where(mask[:, t + 1], np.logaddexp(gb + x0, gg + x1), 0)
    odds = a[:, :, 1] + z[:, :, 1] - a[:, :, 0] - z[:, :, 0]
    p = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
    g = (truth[:, None] - p) * scale
    grad = np.zeros_like(w)
    for j, shift in enumerate((slice(1, -1), slice(0, -2), slice(2, None))):
        grad[j * (size + 1) : (j + 1) * (size + 1)] = np.bincount(own[:, shift].ravel(), np.repeat(g.ravel(), width), size + 1)
        grad[(j + 1) * (size + 1) - 1] = 0
    grad[-5] = g.sum()
    # pair marginals
    joint = np.stack([a[:, :-1, s] + (w[-4 + 2 * s + r] + (u[:, 1:] if r else 0)) + z[:, 1:, r] for s in (0, 1) for r in (0, 1)], 2) if long > 1 else np.zeros((n, 0, 4))
    joint = np.exp(joint - joint.max(2, keepdims=True)) if long > 1 else joint
    joint /= np.maximum(joint.sum(2, keepdims=True), 1e-300)
    real = np.zeros_like(joint)
    real[np.arange(n), :, 3 * truth] = 1
    grad[-4:] = ((real - joint) * (pairs * scale[:, 1:])[..., None]).sum((0, 1))
    return grad


def fit(docs: list[tuple[np.ndarray, np.ndarray, int]], block: int = BLOCK) -> Field:
    """docs: bins, line lengths, label. Gradient ascent (Adam) on the chains' log likelihood, kinds weighted alike."""
    size = len(BINS) * WIDTH
    share = float(np.mean([y for *_, y in docs])) if docs else 0.5
    field = Field(np.zeros(size), np.zeros(size), np.zeros(size), 0.0, np.zeros((2, 2)))
    if share in (0.0, 1.0) or not docs:
        field.constant = share
        return field
    chains = [(b[i : i + CHAIN], y, len(b)) for b, _, y in docs for i in range(0, len(b), CHAIN)]
    long, width = max(len(b) for b, *_ in chains), len(BINS)
    n = len(chains)
    mask = np.zeros((n, long), bool)
    own = np.full((n, long + 2, width), size, np.uint8)  # one more entry, always 0, for no line
    for i, (b, *_) in enumerate(chains):
        mask[i, : len(b)] = True
        own[i, 1 : len(b) + 1] = b
    truth = np.array([y for _, y, _ in chains])
    # a line's part of its document, so that long documents count no more than short ones
    part = np.array([(0.5 / share if y else 0.5 / (1 - share)) / lines / len(docs) for _, y, lines in chains])
    w, m, v = np.zeros(3 * (size + 1) + 5), 0.0, 0.0
    for k in range(1, STEPS + 1):
        grad = np.zeros_like(w)
        for i in range(0, n, block):
            grad += _gradient(w, own[i : i + block], mask[i : i + block], truth[i : i + block], part[i : i + block], size)
        grad -= PENALTY * w / len(w) ** 0.5
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w = w + RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        w[-4:] = np.clip(w[-4:], -2, 2)  # lines of one document share a label here; without a bound the chain would not bend
    tables = w[: 3 * (size + 1)].reshape(3, size + 1)
    field = Field(tables[0], tables[1], tables[2], float(w[-5]), w[-4:].reshape(2, 2))
    raw = np.array([_logit(_weighted(p, s)) for p, (_, s, _) in zip(marginals([field.emissions(b) for b, _, _ in docs], field.step), docs, strict=True)])
    y = np.array([y for *_, y in docs], float)
    slope, shift = 1.0, 0.0
    for _ in range(50):  # Newton steps of a logistic regression on one value
        q = 1 / (1 + np.exp(-(slope * raw + shift)))
        h = q * (1 - q) + 1e-6
        step = np.linalg.solve([[(h * raw * raw).sum() + 1e-2, (h * raw).sum()], [(h * raw).sum(), h.sum() + 1e-2]], [((y - q) * raw).sum() - 1e-2 * slope, (y - q).sum()])
        slope, shift = slope + float(np.clip(step[0], -1, 1)), shift + float(np.clip(step[1], -1, 1))
    field.slope, field.shift = max(slope, 1e-3), shift
    return field


def learn(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", max_rows: int = MAX_ROWS, max_lines: int = MAX_LINES) -> Field:
    """Learns from at most max_rows documents with a label, of at most max_lines lines in all; what comes to the driver is bounded by that."""
    marked = labels.select(F.col(id_column).alias("i"), F.col(label_column).cast("double").alias("y")).where("i is not null and y is not null")
    picked = marked.groupBy("i").agg(F.avg("y").alias("y")).orderBy(F.xxhash64("i", F.lit(29)), "i").limit(max_rows)
    own = docs.select(F.col(id_column).alias("i"), F.col(text_column).cast("string").alias("t")).where("t is not null").join(F.broadcast(picked), "i")
    one = materialise(own.groupBy("i", "y").agg(F.min_by("t", F.xxhash64("t")).alias("t")))
    sized = one.select("i", F.xxhash64("i", F.lit(29)).alias("h"), (F.length("t") - F.length(F.replace("t", F.lit("\n"))) + 1).alias("n"))
    taken, held = [], 0
    for r in sized.orderBy("h", "i").collect():  # max_rows at most
        if held + r["n"] <= max_lines:
            taken.append((r["i"],))
            held += r["n"]
    ids = docs.sparkSession.createDataFrame(taken, sized.select("i").schema)
    rows = one.join(F.broadcast(ids), "i")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            found = [bins_of(t) for t in part.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("i").cast(pa.string()), pa.array([int(y >= 0.5) for y in part.column("y").to_pylist()], pa.int32()), pa.array([b.ravel() for b, _ in found], pa.list_(pa.int16())), pa.array([s for _, s in found], pa.list_(pa.float64()))],
                ["i", "y", "b", "s"],
            )

    got = in_arrow(rows.select("i", "y", "t"), run, "i string, y int, b array<short>, s array<double>").toArrow().sort_by([("i", "ascending")])
    return fit([(np.array(b.values).reshape(-1, len(BINS)), np.array(s.values), y) for b, s, y in zip(got["b"], got["s"], got["y"].to_pylist(), strict=True)])


def score(docs: DataFrame, field: Field, text_column: str = "text", keep: tuple[str, ...] = ("doc_id",), lines: bool = False) -> DataFrame:
    """The kept columns, score (0 to 1, higher: better) and predicted; with lines, also P(good) of each line."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    picked = docs.select(*keep, F.col(text_column).cast("string").alias("_text"))
    extra = [F.array(F.lit(0.0)).alias("line_scores")] if lines else []
    schema = picked.select(*keep, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), *extra).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for part in slices(batches, "_text"):
            found = [bins_of(t) for t in part.column("_text").to_pylist()]
            chains = marginals([field.emissions(b) for b, _ in found], field.step)
            out = [field.constant if field.constant is not None else 1 / (1 + np.exp(-(field.slope * _logit(_weighted(p, s)) + field.shift))) for p, (_, s) in zip(chains, found, strict=True)]
            columns = [pa.array(out, pa.float64()), pa.array([int(x >= 0.5) for x in out], pa.int32())]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns, *([pa.array(chains, pa.list_(pa.float64()))] if lines else [])], schema.names)

    return in_arrow(picked, run, schema)
