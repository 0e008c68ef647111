"""Suffix-array dedup: removes bytes of passages that an earlier document also holds.

A byte goes if a LENGTH-byte string that covers it also starts in a document with a smaller id;
strings are judged on the input. The order of all suffixes comes from a column-wise construction of the
collection's Burrows-Wheeler transform (bcr): every round puts one more symbol of every string in
front, merges the new suffixes into the transform and updates the common prefixes. Windows whose
common prefix is a whole window are one class.

Column-wise rounds cost the number of symbols a string has, and all suffixes of a string must meet
in one place, so the collection is first cut into short strings that can be dealt out: each window of
LENGTH bytes is assigned to its minimizer (the leftmost of the least hashes of its MER-byte substrings), and
a run of windows with one minimizer is one string. Equal windows have equal minimizers at the same
place, so they always meet, and the MER bytes of the minimizer count as one symbol of the string: it
has at most 57. Minimizers seen in one document only are dropped before any text moves; equal strings
are sent once a chunk with the smallest id that holds them. Minimizers with more than HOT runs are split:
each of their windows is a string of its own, dealt by the hash of the whole window, so one minimizer
in ever new contexts is spread over all groups. All of this is exact. A group is worked on in
transforms of about PILE strings, so the memory of a task does not grow with the input.

Defined results: a null text is empty; documents shorter than LENGTH bytes lose nothing; rows with one
id count as one document (nothing is removed on their own account); a null id is larger than any
other (where the ids also hold both the least and the largest 64-bit integer, it counts as the largest); only
the id and text columns are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import shared_folder
from .common import in_arrow, materialise, slices
from .minhash import _power_tables, mix

LENGTH, MER, RUN = 50, 22, 64
#: Windows whose runs are found at once.
RUN_BLOCK = 1 << 18
#: Text bytes of a chunk, and of the input for each group of minimizers and of strings.
CHUNK, KEY_BYTES, STRING_BYTES = 1 << 20, 16 << 20, 8 << 20
#: Strings of one transform (its arrays stay in the processor's cache), and runs from which a minimizer is split.
PILE, HOT = 16_000, 16_000
_U = np.uint64
_NO_ID, _LEAST_ID = np.iinfo(np.int64).max, np.iinfo(np.int64).min


def runs(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, mer: int = MER, block: int = RUN_BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and number of windows of each run in concatenated texts that end at `ends`, and the place of its minimizer in the first window. Works in blocks of windows, whose borders cut runs in two."""
    found = []
    for a in range(0, len(data) - length + 1, block):
        part = data[a : a + block + length - 1]
        near = ends[np.searchsorted(ends, a, "right") :] - a
        start, windows, place = _runs(part, np.append(near[near < len(part)], near[near >= len(part)][:1]), length, mer)
        found.append((start + a, windows, place))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def _runs(data: np.ndarray, ends: np.ndarray, length: int, mer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(data)
    power, inverse = _power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * power[:n], dtype=np.uint64, out=sums[1:])
    value = mix((sums[mer:] - sums[:-mer]) * inverse[: n - mer + 1])
    del sums
    least = value
    width, have = length - mer + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    sizes = np.diff(np.minimum(ends, n), prepend=0)
    left = np.repeat(ends, sizes) - np.arange(n)  # bytes to the end of the text
    good = left[: len(least)] >= length
    first = good.copy()
    first[1:] &= ~good[:-1] | (least[1:] != least[:-1])
    start = np.flatnonzero(first)
    number = np.cumsum(first) - 1
    inside = np.flatnonzero(good)
    start = inside[(inside - start[number[inside]]) % RUN == 0]
    stop = np.append(np.flatnonzero(np.diff(good.astype(np.int8), append=0) == -1) + 1, n)
    end = np.minimum(stop[np.searchsorted(stop, start, "right")], np.append(start[1:], n))
    found = []
    while len(start):  # one round, but for texts that repeat within a window
        place = np.argmax(value[start[:, None] + np.arange(width)] == least[start][:, None], axis=1)
        until = np.minimum(end, start + place + 1)
        found.append((start, until - start, place))
        more = until < end
        start, end = until[more], end[more]
    start, windows, place = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    order = np.argsort(start, kind="stable")
    return start[order], windows[order], place[order]


def hashes(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` bytes at each place."""
    power, _ = _power_tables(size)
    total = np.zeros(len(at), np.uint64)
    for i in range(size):
        total += (data[at + i].astype(np.uint64) + _U(1)) * power[i]
    return mix(mix(total) + _U(1))  # least hashes are small; scrambled again, they spread evenly over the groups


def bcr(strings: np.ndarray, sizes: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, length and common prefix with the row above (at most cap) of all suffixes, empty ones first, in order.

    strings: one row of symbols (1 to 65535) per string, right-aligned; sizes: their lengths, at most 127.
    Round j puts the symbol at distance j from the end in front of each string's suffix of j - 1 symbols.
    The new suffix's row is the number of smaller first symbols plus the rank of its symbol among equal ones
    in the transform; its common prefix with a neighbour of the same first symbol is one more than the
    least common prefix between the rows that the two symbols stand in.
    """
    count, long = strings.shape
    symbol = np.where(sizes > 0, strings[:, -1], 0).astype(np.uint16) if long else np.zeros(count, np.uint16)
    name = np.arange(count, dtype=np.int32 if count < 1 << 24 else np.int64) << 7  # owner and length of each row's suffix
    prefix = np.zeros(count, np.uint8)
    live = np.flatnonzero(sizes > 0)  # in the order of their longest suffixes' rows
    row = live.copy()
    for j in range(1, long + 1):
        n = len(symbol)
        by_symbol = np.argsort(symbol, kind="stable")
        place = np.empty(n, np.int32 if n < 1 << 31 else np.int64)
        place[by_symbol] = np.arange(n, dtype=place.dtype)
        spot = place[row].astype(np.int64)
        ended = n - int(np.count_nonzero(symbol))
        c = symbol[row]
        above, below = by_symbol[np.maximum(spot - 1, 0)], by_symbol[np.minimum(spot + 1, n - 1)]
        padded = np.append(prefix, np.uint8(0))
        up = _least(padded, above + 1, row + 1, (spot > 0) & (symbol[above] == c), cap)
        down = _least(padded, row + 1, below + 1, (spot + 1 < n) & (symbol[below] == c), cap)
        order = np.argsort(spot, kind="stable")
        live, up, down = live[order], up[order], down[order]
        fresh_at = count + spot[order] - ended
        size = n + len(fresh_at)
        kept = np.ones(size, bool)
        kept[fresh_at] = False
        more = sizes[live] > j
        following = np.where(more, strings[live, long - 1 - np.minimum(j, long - 1)], 0).astype(np.uint16)
        merged = []
        for old, new in ((symbol, following), (name, (live << 7) + j), (prefix, up)):
            fresh = np.empty(size, old.dtype)
            fresh[kept] = old
            fresh[fresh_at] = new
            merged.append(fresh)
        symbol, name, prefix = merged
        after = fresh_at + 1
        fix = after < size
        fix[fix] = kept[after[fix]]
        prefix[after[fix]] = down[fix]
        live, row = live[more], fresh_at[more]
        if not len(live):
            break
    return name >> 7, name & 127, prefix


def _least(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, real: np.ndarray, cap: int) -> np.ndarray:
    """One more than the least prefix in [start, end), at most cap; 0 where there is no neighbour."""
    out = np.zeros(len(start), np.uint8)
    if real.any():
        pairs = np.stack([start[real], end[real]], 1).ravel()
        out[real] = np.minimum(np.minimum.reduceat(prefix, pairs)[::2] + 1, cap)
    return out


def window_minima(strings: list[bytes], places: np.ndarray, ids: np.ndarray, length: int = LENGTH, mer: int = MER) -> tuple[np.ndarray, np.ndarray]:
    """For every window of every string, the least id of a string that holds it: flat values, and the windows of each string. places: where each string's minimizer stands."""
    of: dict[bytes, int] = {}
    core = np.array([of.setdefault(x[p : p + mer], len(of)) for x, p in zip(strings, places.tolist(), strict=True)]) + 257
    whole_sizes = np.array([len(x) for x in strings], np.int64)
    sizes, cap = whole_sizes - mer + 1, length - mer + 1
    flat = np.frombuffer(b"".join(strings), np.uint8).astype(np.uint16) + np.uint16(1)
    begin = np.cumsum(whole_sizes) - whole_sizes
    flat[begin + places] = core
    drop = (begin + places)[:, None] + np.arange(1, mer)
    stay = np.ones(len(flat), bool)
    stay[drop.ravel()] = False
    long = int(sizes.max())
    table = np.zeros((len(strings), long), np.uint16)
    table[np.arange(long)[None, :] >= (long - sizes)[:, None]] = flat[stay]
    owner, size, prefix = bcr(table, sizes, cap)
    whole = size >= cap
    owner, size, prefix = owner[whole], size[whole], prefix[whole]
    first = np.flatnonzero(prefix < cap)
    least = np.repeat(np.minimum.reduceat(ids[owner], first), np.diff(first, append=len(owner)))
    windows = sizes - cap + 1
    base = np.cumsum(windows) - windows
    out = np.empty(len(owner), np.int64)
    out[base[owner] + sizes[owner] - size] = least
    return out, windows


_CHUNK = "chunk long, ids binary, nulls long, sizes binary, windows binary, places binary, data binary"


def _chunks(docs: DataFrame, most: int, length: int) -> DataFrame:
    """Documents in chunks, sorted by id in each: ids (64-bit, null ones last), number of null ids, byte lengths, runs (windows and place of the minimizer, in order), bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, ids, texts, held = TaskContext.get().partitionId(), 0, [], [], 0

        def chunk() -> pa.RecordBatch:
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
            data = b"".join([texts[i] for i in order])
            sizes = np.array([len(texts[i]) for i in order], np.int64)
            named = np.array([_NO_ID if ids[i] is None else ids[i] for i in order], np.int64)
            _, windows, places = runs(np.frombuffer(data, np.uint8), np.cumsum(sizes), length)
            return _batch(_CHUNK, [(part << 32) + seq], [named.tobytes()], [ids.count(None)], [sizes.tobytes()], [windows.astype(np.uint8).tobytes()], [places.astype(np.uint8).tobytes()], [data])

        for batch in slices(batches, "text"):
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                data = (text or "").encode()
                if held and held + len(data) > most:
                    yield chunk()
                    seq, ids, texts, held = seq + 1, [], [], 0
                ids.append(i)
                texts.append(data)
                held += len(data)
        if ids:
            yield chunk()

    return in_arrow(docs, run, _CHUNK)


class _Chunk:
    """A chunk, its runs, and the distinct minimizers of these with the smallest and largest id and the number of runs."""

    def __init__(self, r: dict, length: int):
        self.ids, self.sizes, self.data, self.length = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["sizes"], np.int64), np.frombuffer(r["data"], np.uint8), length
        self.windows, self.place = (np.frombuffer(r[k], np.uint8).astype(np.int64) for k in ("windows", "places"))
        have = np.maximum(self.sizes - length + 1, 0)
        place = np.cumsum(self.windows) - self.windows  # of each run's first window among all windows
        self.doc = np.searchsorted(np.cumsum(have), place, "right")
        self.start = place + (np.cumsum(self.sizes) - self.sizes - np.cumsum(have) + have)[self.doc] if len(place) else place
        self.key = hashes(self.data, self.start + self.place, MER)
        order = np.argsort(self.key, kind="stable")  # documents are in the order of their ids, and so are the runs of a key
        keys = self.key[order]
        edge = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.number = keys[edge], np.diff(edge, append=len(keys))
        last = edge + self.number - 1
        self.low, self.high = self.ids[self.doc[order[edge]]], self.ids[self.doc[order[last]]]

    def strings(self, flags: list, parts: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct strings under shared minimizers, in the order of their keys; the key, minimizer's place and least id of each; and the start, document and string of each shared run."""
        shared, hot = _flagged(self, flags, parts)
        at = np.searchsorted(self.keys, self.key)
        wanted = np.flatnonzero(shared[at]) if len(self.keys) else np.zeros(0, np.int64)
        split = hot[at[wanted]]
        one, every = wanted[~split], wanted[split]
        n = self.windows[every]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)  # each window of a split run is a run of its own
        start = np.concatenate([self.start[one], np.repeat(self.start[every], n) + step])
        windows = np.concatenate([self.windows[one], np.ones(len(step), np.int64)])
        place = np.concatenate([self.place[one], np.repeat(self.place[every], n) - step])
        doc = np.concatenate([self.doc[one], np.repeat(self.doc[every], n)])
        key = np.concatenate([self.key[one], hashes(self.data, start[len(one) :], self.length)])
        order = np.lexsort((doc, key))
        start, windows, place, doc, key = start[order], windows[order], place[order], doc[order], key[order]
        data, of, firsts, number = self.data.tobytes(), {}, [], []
        for i, (a, b) in enumerate(zip(start.tolist(), (start + windows + self.length - 1).tolist(), strict=True)):
            k = of.setdefault(data[a:b], len(of))
            if k == len(firsts):
                firsts.append(i)
            number.append(k)
        firsts = np.array(firsts, np.int64)
        return list(of), key[firsts], place[firsts], self.ids[doc[firsts]], start, doc, np.array(number, np.int64)


def _groups(key: np.ndarray, n: int) -> np.ndarray:
    """Ends of n groups of sorted keys, by equal ranges."""
    borders = np.array([((i + 1) << 64) // n - 1 for i in range(n)], np.uint64)
    return np.searchsorted(key, borders, "right")


def _pieces(key: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """Number, begin and end of the groups that have a key."""
    ends = _groups(key, n)
    return [(p, a, b) for p, (a, b) in enumerate(zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True)) if b > a]


def _batch(schema: str, *columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [f for f, _ in fields])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {k: batch.column(k)[i].as_py() for k in batch.schema.names}


_KEYS, _FLAGS = "part long, chunk long, keys binary, low binary, high binary, number binary", "chunk long, part long, shared binary, hot binary"
_STRINGS, _MINIMA = "part long, chunk long, keys binary, sizes binary, places binary, data binary, ids binary", "chunk long, part long, steps binary, spans binary, values binary"


def _flags(chunks: DataFrame, parts: int, length: int, hot_runs: int) -> DataFrame:
    """Per chunk and group of minimizers: bits for each distinct minimizer, set if several documents have it, and if it has more than hot_runs runs."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            c = _Chunk(r, length)
            have = _pieces(c.keys, parts)
            cut = lambda x: [x[a:b].tobytes() for _, a, b in have]
            yield _batch(_KEYS, [p for p, *_ in have], [r["chunk"]] * len(have), *map(cut, (c.keys, c.low, c.high, c.number.astype(np.int32))))

    def meet(table: pa.Table) -> pa.Table:
        join = lambda name, kind: np.frombuffer(b"".join(table[name].to_pylist()), kind)
        keys, low, high, number = join("keys", np.uint64), join("low", np.int64), join("high", np.int64), join("number", np.int32)
        order = np.argsort(keys, kind="stable")
        edge = np.flatnonzero(np.append(True, np.diff(keys[order]) != 0))
        many = np.diff(edge, append=len(keys))
        ends = np.cumsum([len(x) // 8 for x in table["keys"].to_pylist()])

        def bits(of_key: np.ndarray) -> list[bytes]:
            flag = np.empty(len(keys), bool)
            flag[order] = np.repeat(of_key, many)
            return [np.packbits(x).tobytes() for x in np.split(flag, ends[:-1])]

        several = bits(np.minimum.reduceat(low[order], edge) < np.maximum.reduceat(high[order], edge))
        hot = bits(np.add.reduceat(number[order].astype(np.int64), edge) > hot_runs)
        return pa.Table.from_batches([_batch(_FLAGS, table["chunk"].to_pylist(), table["part"].to_pylist(), several, hot)])

    return in_arrow(chunks, send, _KEYS).groupBy("part").applyInArrow(meet, _FLAGS)


def _flagged(c: _Chunk, flags: list, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """For each distinct minimizer of a chunk: whether it is shared, and whether it is hot."""
    of = {f["part"]: f for f in flags or []}
    have = [(p, b - a) for p, a, b in _pieces(c.keys, parts)]
    read = lambda name: np.concatenate([np.unpackbits(np.frombuffer(of[p][name], np.uint8), count=n).astype(bool) for p, n in have]) if have else np.zeros(0, bool)
    return read("shared"), read("hot")


def _answers(rows: list[dict], length: int, pile: int) -> list[list[bytes]]:
    """For each row of strings: the least ids of their windows, as steps a string, spans and values of equal ids. Works through the keys in transforms of about `pile` strings."""
    sizes = [np.frombuffer(r["sizes"], np.uint8).astype(np.int64) for r in rows]
    keys, places, ids = (np.concatenate([np.frombuffer(r[k], t) for r in rows]) for k, t in (("keys", np.uint64), ("places", np.uint8), ("ids", np.int64)))
    ends = np.concatenate([np.cumsum(s) for s in sizes])
    source = np.repeat(np.arange(len(rows)), [len(s) for s in sizes])
    size = np.concatenate(sizes)
    order = np.argsort(keys, kind="stable")
    edge = np.append(np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1])), len(keys))
    steps, span_of, value_of = np.zeros(len(keys), np.int64), [None] * len(keys), [None] * len(keys)
    a, pile = 0, min(pile, 32_000)  # a transform's symbols have 16 bits
    while a < len(keys):
        b = int(edge[max(np.searchsorted(edge, a + pile, "right") - 1, np.searchsorted(edge, a, "right"))])
        of: dict[bytes, int] = {}
        here, least_id, first = [], [], []
        for k in order[a:b].tolist():
            e = int(ends[k])
            x, i = rows[source[k]]["data"][e - int(size[k]) : e], int(ids[k])
            m = of.setdefault(x, len(first))
            if m == len(first):
                first.append(k)
                least_id.append(i)
            elif i < least_id[m]:
                least_id[m] = i
            here.append(m)
        least, windows = window_minima(list(of), places[first].astype(np.int64), np.array(least_id, np.int64), length)
        base = np.cumsum(windows) - windows
        change = np.append(True, least[1:] != least[:-1])
        change[base] = True
        at = np.flatnonzero(change)  # steps of equal values, none across two strings
        span, value = np.diff(at, append=len(least)).astype(np.uint8).tobytes(), least[at].tobytes()
        begin = np.append(np.searchsorted(at, base), len(at)).tolist()
        for k, m in zip(order[a:b].tolist(), here, strict=True):
            x, y = begin[m], begin[m + 1]
            steps[k], span_of[k], value_of[k] = y - x, span[x:y], value[8 * x : 8 * y]
        a = b
    out, a = [], 0
    for s in sizes:
        b = a + len(s)
        out.append([steps[a:b].astype(np.uint8).tobytes(), b"".join(span_of[a:b]), b"".join(value_of[a:b])])
        a = b
    return out


def _minima(flagged: DataFrame, key_parts: int, parts: int, length: int, pile: int) -> DataFrame:
    """Per chunk and group of strings: the least id of each window, as runs of equal values."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            strings, keys, places, ids, *_ = _Chunk(r, length).strings(r["flags"], key_parts)
            have, sizes = _pieces(keys, parts), np.array([len(x) for x in strings], np.uint8)
            cut = lambda x: [x[a:b].tobytes() for _, a, b in have]
            data = [b"".join(strings[a:b]) for _, a, b in have]
            yield _batch(_STRINGS, [p for p, *_ in have], [r["chunk"]] * len(have), cut(keys), cut(sizes), cut(places.astype(np.uint8)), data, cut(ids))

    def meet(table: pa.Table) -> pa.Table:
        found = _answers(table.select(["keys", "sizes", "places", "data", "ids"]).to_pylist(), length, pile)
        return pa.Table.from_batches([_batch(_MINIMA, table["chunk"].to_pylist(), table["part"].to_pylist(), *zip(*found, strict=True))])

    return in_arrow(flagged, send, _STRINGS).groupBy("part").applyInArrow(meet, _MINIMA)


_RESULT = "id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"


def _cut(answered: DataFrame, key_parts: int, length: int, shift: int, whole_characters: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            c = _Chunk(r, length)
            n, cover = len(c.data), np.zeros(len(c.data) + 1, np.int32)
            back = sorted(r["minima"] or [], key=lambda m: m["part"])
            if back:
                *_, start, doc, number = c.strings(r["flags"], key_parts)
                steps, span, value = (np.frombuffer(b"".join(m[k] for m in back), kind).astype(np.int64) for k, kind in (("steps", np.uint8), ("spans", np.uint8), ("values", np.int64)))
                first = np.cumsum(steps) - steps
                offset = np.cumsum(span) - span
                offset -= np.repeat(offset[first], steps)
                many = steps[number]
                take = np.repeat(first[number] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                gone = value[take] < np.repeat(c.ids[doc], many)
                begin = (np.repeat(start, many) + offset[take])[gone]
                np.add.at(cover, begin, 1)
                np.add.at(cover, begin + span[take][gone] + length - 1, -1)
            removed = np.cumsum(cover[:-1]) > 0
            if whole_characters and n:
                head = np.flatnonzero((c.data & 0xC0) != 0x80)
                removed = np.repeat(np.logical_and.reduceat(removed, head), np.diff(head, append=n))
            ends = np.cumsum(c.sizes)
            spans, kept, lost = [], [], []
            for a, b in zip((ends - c.sizes).tolist(), ends.tolist(), strict=True):
                mask = removed[a:b]
                lost.append(int(mask.sum()))
                if lost[-1]:
                    edge = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
                    spans.append([{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)])
                    kept.append(c.data[a:b][~mask].tobytes())
                else:
                    spans.append([])
                    kept.append(c.data[a:b].tobytes())
            ids = [i + shift for i in c.ids.tolist()[: len(c.ids) - r["nulls"]]] + [None] * r["nulls"]
            columns = [pa.array(ids, pa.int64()), pa.array(c.sizes), pa.array(lost, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "n_removed", "spans", "kept"])

    return in_arrow(answered, run, _RESULT)


def _bucketed(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """Writes df to the shared folder, bucketed by a column, and reads it again; the name that the buckets need is given up at once."""
    spark, name = df.sparkSession, f"terravane_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.block.size", 8 << 20).option("path", shared_folder(spark)).bucketBy(buckets, column).saveAsTable(name)
    out = spark.table(name)
    out.schema  # resolved before the name goes  # noqa: B018
    spark.sql(f"DROP TABLE {name}")
    return out


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, id_column: str = "doc_id", text_column: str = "text", chunk_bytes: int = CHUNK, key_bytes: int = KEY_BYTES, string_bytes: int = STRING_BYTES,
    whole_characters: bool = False, pile: int = PILE, hot_runs: int = HOT,
) -> DataFrame:
    """id, n_bytes, n_removed, spans (byte ranges removed) and kept (the remaining bytes) of every document. With whole_characters, a character of which some bytes stay is kept whole."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    about = rows.agg(F.sum(F.octet_length("text")).alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).first()
    total, shift = about["n"] or 0, int(about["hi"] == _NO_ID and about["lo"] > _LEAST_ID)  # the largest integer stands for null
    key_parts, parts = -(-total // key_bytes) or 1, -(-total // string_bytes) or 1
    # Bucketed by chunk, so that the answers come to the texts and no text is shuffled.
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (8 * chunk_bytes)))
    chunks = _bucketed(_chunks(rows.withColumn("id", F.col("id") - shift), chunk_bytes, length), "chunk", buckets)
    flags = materialise(_flags(chunks, key_parts, length, hot_runs)).groupBy("chunk").agg(F.collect_list(F.struct("part", "shared", "hot")).alias("flags"))
    flagged = chunks.join(flags.hint("shuffle_hash"), "chunk", "left")
    minima = materialise(_minima(flagged, key_parts, parts, length, pile)).groupBy("chunk").agg(F.collect_list(F.struct("part", "steps", "spans", "values")).alias("minima"))
    answered = flagged.join(minima.hint("shuffle_hash"), "chunk", "left")
    return _cut(answered, key_parts, length, shift, whole_characters).withColumnRenamed("id", id_column)


def digest(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    return found.select(id_column, "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
