"""Byte-level BPE encoding and decoding by backtracking over longest matches.

Bytes are mapped to Latin-1 characters so that an Aho-Corasick automaton finds, in one pass over a
piece, the longest token that starts at each byte. A token sequence equals the one that the merges
produce if and only if each pair of neighbours is compatible (merging would not cross the border
between them); the encoder takes the longest compatible token and backs out of dead ends, marking
each dead position once, so a piece takes linear time. Compatibility of pairs is memoised.

Defined results: a null text counts as empty and gives no tokens; repeated rows each get a result;
pieces of any length are handled in linear time.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, slices

#: Pieces whose ids a worker remembers at most, and the longest piece (in characters) that it remembers.
CACHE_PIECES, CACHE_CHARS = 600_000, 48


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by id, from a file of base64 token and rank per line."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


class Encoder(dict):
    """Maps a piece (str) to its ids, packed as little-endian unsigned 32-bit integers; a bounded memo."""

    def __init__(self, tokens: list[bytes], pattern: str):
        super().__init__()
        self.tokens = tokens
        self.find = regex.compile(pattern).findall
        self.id_of = {t: i for i, t in enumerate(tokens)}
        self.length = [len(t) for t in tokens]
        self.packed = [i.to_bytes(4, "little") for i in range(len(tokens))]
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            self.automaton.add_word(t.decode("latin-1"), (i, len(t) - 1))
        self.automaton.make_automaton()
        self.shorter = [self._prefix(t) for t in tokens]
        self.pair: dict[tuple[int, int], int] = {}
        self.halves: list[tuple[int, int]] = []
        self.compatible = lru_cache(1 << 18)(self._compatible)
        for i, t in enumerate(tokens):
            self.halves.append(self._split(i, t))

    def _prefix(self, token: bytes) -> int:
        """The longest proper prefix that is a token, or -1."""
        for n in range(len(token) - 1, 0, -1):
            if (i := self.id_of.get(token[:n])) is not None:
                return i
        return -1

    def _split(self, i: int, token: bytes) -> tuple[int, int]:
        """The two tokens whose merge makes token i; (i, i) if none do."""
        left = self.shorter[i]
        while left >= 0:
            right = self.id_of.get(token[self.length[left] :], i)
            if left < i and right < i and self._compatible(left, right):
                self.pair[left, right] = i
                return left, right
            left = self.shorter[left]
        return i, i

    def _compatible(self, a: int, b: int) -> bool:
        """Whether the merges leave a border between tokens a and b: undoes the later merge on either side, and sees whether an earlier one would have crossed."""
        limit = len(self.tokens) + 1
        while True:
            if self.pair.get((a, b), limit) < limit:
                return False
            from_left = a > b
            for _ in range(2):
                if from_left:
                    limit, a = a, self.halves[a][1]
                    if a != limit:
                        break
                else:
                    limit, b = b + 1, self.halves[b][0]
                    if b + 1 != limit:
                        break
                from_left = not from_left
            else:
                return True

    def ids(self, data: bytes) -> list[int]:
        if (whole := self.id_of.get(data)) is not None:
            return [whole]
        n = len(data)
        length = self.length
        # Matches come in the order of their ends, so the last one noted for a start is the longest.
        longest = {end - k: i for end, (i, k) in self.automaton.iter(data.decode("latin-1"))}
        alive = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            last = out[-1] if out else -1
            while True:
                end = at + length[token]
                if alive[end] and (last < 0 or self.compatible(last, token)):
                    out.append(token)
                    at = end
                    token = longest.get(at, -1)
                    break
                if (token := self.shorter[token]) < 0:
                    alive[at] = 0
                    out.pop()
                    at -= length[last]
                    token = last
                    break
        return out

    def __missing__(self, piece: str) -> bytes:
        packed = b"".join([self.packed[i] for i in self.ids(piece.encode())])
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = packed
        return packed

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, self.find(text))) if text else b""


def _encoding(shared: Broadcast, pattern: str, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Replaces the last column, a text, by its packed ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, pattern)  # one a task: it takes half a second to make, and its memos go with the task
        encode = encoder.encode
        for part in slices(batches, "_text"):
            ids = pa.array([encode(t) for t in part.column("_text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids], names)
        encoder.clear()
        encoder.compatible.cache_clear()

    return run


def _decoding(shared: Broadcast, ids_column: str, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds a column: the bytes that packed ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.__getitem__
        for part in slices(batches, ids_column):
            ids = part.column(ids_column).to_pylist()
            data = pa.array([b"".join(map(get, memoryview(x).cast("I"))) if x else b"" for x in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns, data], names)

    return run


def encode_bpe(df: DataFrame, tokens: list[bytes], pattern: str, id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id_column, the kept columns, and token_ids: binary, ids as little-endian unsigned 32-bit integers."""
    shared = df.sparkSession.sparkContext.broadcast(tokens)
    rows = df.select(id_column, *keep, F.col(text_column).alias("_text"))
    schema = rows.select(id_column, *keep, F.lit(b"").alias("token_ids")).schema
    return in_arrow(rows, _encoding(shared, pattern, schema.names), schema)


def decode_bpe(df: DataFrame, tokens: list[bytes], ids_column: str = "token_ids", out_column: str = "decoded") -> DataFrame:
    """Adds out_column: the bytes that the ids stand for. Unknown ids raise an error."""
    shared = df.sparkSession.sparkContext.broadcast(tokens)
    rows = df.select(*[c for c in df.columns if c != out_column])
    schema = rows.select("*", F.lit(b"").alias(out_column)).schema
    return in_arrow(rows, _decoding(shared, ids_column, schema.names), schema)


def round_trip(df: DataFrame, tokens: list[bytes], pattern: str, id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """As decode_bpe() of encode_bpe(), both by one worker a task: two would stay beside each other, and with them their memory, for the jobs after this one too."""
    shared = df.sparkSession.sparkContext.broadcast(tokens)
    rows = df.select(id_column, *keep, F.col(text_column).alias("_text"))
    schema = rows.select(id_column, *keep, F.lit(b"").alias("token_ids"), F.lit(b"").alias("decoded")).schema
    encode, decode = _encoding(shared, pattern, schema.names[:-1]), _decoding(shared, "token_ids", schema.names)
    return in_arrow(rows, lambda batches: decode(encode(batches)), schema)


def digest(decoded: DataFrame, id_column: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """The contract's columns of the ids and the decoded bytes, and the kept columns."""
    return decoded.select(
        id_column,
        *keep,
        (F.length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
