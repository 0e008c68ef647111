"""Benchmark decontamination: one Aho-Corasick automaton over the normalised word windows of test items.

Each text is normalised once (ASCII lower case, every separator to one space), scanned once, and
the matches are mapped back to word numbers and to character offsets of the original text.

The items are cut into pieces that overlap by a window less one word, and where their windows outgrow one automaton
the pieces are dealt to blocks of a written table. The driver holds one block at a time, whose size is known; each block
is one pass over the documents, in which every task builds the automaton once and returns the rows with hits only.

Defined results: null or wordless texts have no words and no hits; items without a word match
nothing; items with a null id mark words as hit but are not listed; repeated rows each get a
result; of other columns only the kept ones are read, so clashing names do no harm.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import CASED_WORD_PATTERN, in_arrow, materialise, slices, words_of

#: Characters of windows that one automaton holds at most (about 50 bytes of memory each), and words of an item's piece.
BLOCK_CHARS, PIECE_WORDS = 4_000_000, 1000
WORD = re.compile(CASED_WORD_PATTERN)
RESULT = "n_words long, runs array<struct<first:long,last:long>>, spans array<struct<start:long,end:long>>, items array<long>"


def windows_of(text: bytes, window: int) -> list[bytes]:
    """All windows of an item: `window` consecutive words each; one shorter window if it has fewer."""
    words = words_of(text)
    if not words:
        return []
    return [b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))]


def _pieces(items: DataFrame, id_column: str, text_column: str, window: int, piece_words: int) -> DataFrame:
    """i, part, piece (normalised words) and size (characters of its windows) of all items with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            out: list[tuple] = []
            for i, text in zip(batch.column("i").to_pylist(), batch.column("t").to_pylist(), strict=True):
                words = words_of(text.encode())
                for part, a in enumerate(range(0, max(1, len(words) - window + 1), piece_words) if words else ()):
                    piece = b" ".join(words[a : a + piece_words + window - 1])
                    out.append((i, part, piece, (window + 1) * (len(piece) + 2)))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.int64()), strict=True)], ["i", "part", "piece", "size"])

    rows = items.select(F.col(id_column).cast("long").alias("i"), F.col(text_column).cast("string").alias("t")).where("t is not null")
    return in_arrow(rows, run, "i long, part long, piece binary, size long")


def _dealt(pieces: DataFrame, block_chars: int) -> tuple[DataFrame, int]:
    """The pieces with the number of their block, and the number of blocks, each of which fits one automaton (or is one piece)."""
    about = pieces.agg(F.sum("size").alias("n"), F.max("size").alias("most")).first()
    blocks, most = max(1, -(-(about["n"] or 0) // block_chars)), max(block_chars, about["most"] or 0)
    while True:
        out = pieces.withColumn("block", F.pmod(F.xxhash64("i", "part", "piece"), F.lit(blocks)))
        if blocks == 1 or out.groupBy("block").agg(F.sum("size").alias("n")).agg(F.max("n")).first()[0] <= most:
            return out, blocks
        blocks *= 2


def build(items: list[tuple], window: int):
    """An automaton, or None without items: the value of a key is (words in it, item ids)."""
    of: dict[bytes, set] = {}
    for i, text in items:
        for w in windows_of(text, window):
            of.setdefault(w, set()).add(i)
    automaton = ahocorasick.Automaton()
    for w, ids in of.items():
        automaton.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, sorted(i for i in ids if i is not None)))
    if not of:
        return None
    automaton.make_automaton()
    return automaton


def scan(text: str | None, automaton) -> tuple[int, list, set]:
    """Number of words, hit word runs [first, last], and matched item ids."""
    words = words_of((text or "").encode())
    if not words or automaton is None:
        return len(words), [], set()
    line = f" {b' '.join(words).decode('latin-1')} "
    ends, found = [], set()
    for end, (n, ids) in automaton.iter(line):
        ends.append((end, n))
        found.update(ids)
    if not ends:
        return len(words), [], found
    spaces = np.cumsum(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
    last = spaces[[e for e, _ in ends]] - 2
    first = last - np.array([n for _, n in ends]) + 1
    mark = np.zeros(len(words) + 1, np.int64)
    np.add.at(mark, first, 1)
    np.add.at(mark, last + 1, -1)
    hit = np.concatenate([[0], (np.cumsum(mark)[:-1] > 0).astype(np.int8), [0]])
    edge = np.flatnonzero(np.diff(hit))
    return len(words), [(int(a), int(b) - 1) for a, b in zip(edge[::2], edge[1::2], strict=True)], found


def _merge(runs: list) -> list:
    out: list = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _spans(text: str | None, runs: list) -> list[dict]:
    """Character ranges of word runs in the original text."""
    if not runs:
        return []
    at = [m.span() for m in WORD.finditer(text)]
    return [{"start": at[a][0], "end": at[b][1]} for a, b in runs]


_RUNS, _SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _found(n_words: list, runs: list, spans: list, items: list) -> list[pa.Array]:
    return [pa.array(n_words, pa.int64()), pa.array([[{"first": a, "last": b} for a, b in r] for r in runs], _RUNS), pa.array(spans, _SPANS), pa.array([sorted(x) for x in items], pa.list_(pa.int64()))]


def decontaminate(
    docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10,
    block_chars: int = BLOCK_CHARS, keep: tuple[str, ...] = (), piece_words: int = PIECE_WORDS,
) -> DataFrame:
    """Per document: the id, the kept columns, n_words, hit word runs, their character spans in the original text, and matched item ids."""
    sc = docs.sparkSession.sparkContext
    pieces, blocks = _dealt(materialise(_pieces(items, item_id, item_text, window, piece_words)), block_chars)
    block = lambda k: sc.broadcast([(r["i"], bytes(r["piece"])) for r in pieces.where(F.col("block") == k).select("i", "piece").collect()])
    rows = docs.select(F.col(id_column).cast("long").alias(id_column), *keep, F.col(text_column).cast("string").alias("_text"))
    kept = rows.drop("_text").schema
    schema = StructType([*kept.fields, *StructType.fromDDL(RESULT).fields])

    if blocks == 1:
        held = block(0)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = build(held.value, window)
            for part in slices(batches, "_text"):
                texts = part.column("_text").to_pylist()
                n_words, runs, found = zip(*[scan(t, automaton) for t in texts], strict=True) if texts else ((), (), ())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *_found(n_words, runs, [_spans(t, r) for t, r in zip(texts, runs, strict=True)], found)], schema.names)

        return in_arrow(rows, run, schema)

    def hits(held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = build(held.value, window)
            for part in slices(batches, "_text"):
                got = [(i, *scan(t, automaton)) for i, t in zip(part.column("_row").to_pylist(), part.column("_text").to_pylist(), strict=True)]
                got = [x for x in got if x[2]]
                columns = list(zip(*got, strict=True)) or [()] * 4
                _, runs, _, found = _found(columns[1], columns[2], [[] for _ in got], columns[3])
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), runs, found], ["_row", "runs", "items"])

        return run

    base, every = materialise(rows.withColumn("_row", F.monotonically_increasing_id())), None
    for k in range(blocks):
        held = block(k)
        one = materialise(in_arrow(base.select("_row", "_text"), hits(held), "_row long, runs array<struct<first:long,last:long>>, items array<long>"))
        every = one if every is None else every.unionByName(one)
        held.unpersist()
    merged = every.groupBy("_row").agg(F.flatten(F.collect_list("runs")).alias("_runs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("_items"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            texts = part.column("_text").to_pylist()
            runs = [_merge([(r["first"], r["last"]) for r in rs or []]) for rs in part.column("_runs").to_pylist()]
            spans = [_spans(t, r) for t, r in zip(texts, runs, strict=True)]
            n_words = [len(words_of((t or "").encode())) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(c) for c in kept.names] + _found(n_words, runs, spans, [x or [] for x in part.column("_items").to_pylist()]), schema.names)

    return in_arrow(base.join(merged, "_row", "left").select(*kept.names, "_runs", "_items", "_text"), finish, schema)


def digest(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The contract's columns of decontaminate()'s result."""
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda acc, r: acc + r["last"] - r["first"] + 1)
    listed = F.concat_ws(",", F.array_sort(F.transform("items", lambda i: i.cast("string"))))
    return found.select(
        id_column,
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(listed.cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
