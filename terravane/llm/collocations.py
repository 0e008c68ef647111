"""Phrase collocations: phrases of two or three words that occur more often together than their parts would tell.

Texts are counted by count tries of depth three. A shard is the part of a task's texts that fits SHARD_WORDS words: its words are numbered in byte
order, its phrases are sorted numbers, and its trie is serialised level by level (word, count, children), cut at the borders of prefix
ranges. Each range then merges the sorted runs of all shards (a stable sort, which merges runs) and keeps what occurs often enough. In
the merged trie a phrase's left parts are its ancestors and its right parts are found by suffix links, from a phrase to the phrase
without its first word; both are joins on the table of kept nodes, which is far smaller than the tries.

Prefix ranges are borders on whole phrases, so that a frequent first word (or pair) is cut into several; they come from a sample of
texts and decide only which task merges what. Counts cover all texts, and nothing is dropped before all shards' counts are added.

Defined results: null and empty texts have no words; a null language is `und`; repeated rows count repeatedly; an empty table and
languages without a candidate give no rows; a text of any length is read whole, in chunks; ties are ordered by count, then by bytes of the
phrase; counts are exact as long as no phrase occurs 10^16 times (38 digits); other columns are not read, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import in_arrow, materialise, slices

#: Fixed values of the contract: least count of a phrase, its share of a shorter one that makes that one go (percent), phrases of a language.
LEAST, SHARE, TOP, SCALE = 10, 50, 2000, 1_000_000
#: Words of a shard; bytes of text that make a prefix range; bytes of sampled text for each range; bytes of a text that are read at once.
SHARD_WORDS, RANGE_BYTES, SAMPLE_BYTES, CHUNK_BYTES = 4_000_000, 8 << 20, 32 << 10, 4 << 20
#: Byte table: A-Z to a-z, the ends of pieces to a line feed, tabs to spaces. A piece's end becomes a word of its own, which no UTF-8 text holds.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
_END = b"\xff"
#: A part of a trie: the words it uses; of each level the words' numbers, counts and numbers of children.
PART = "part int, lang string, words array<binary>, w1 array<int>, n1 array<long>, c1 array<int>, w2 array<int>, n2 array<long>, c2 array<int>, w3 array<int>, n3 array<long>"
NODES = "lang string, w1 string, w2 string, w3 string, n long"


class _Numbers(dict):
    """Numbers words as they come; the end of a piece is 0."""

    def __init__(self):
        self[_END] = 0

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def words_of(text: str) -> Iterator[list[bytes]]:
    """The words of a text with an end after each piece, some megabytes at a time."""
    data = text.encode().translate(_NORMAL)
    start = 0
    while start < len(data):
        stop = start + CHUNK_BYTES
        if stop < len(data):  # up to the end of a word
            ends = [e for e in (data.find(b" ", stop), data.find(b"\n", stop)) if e >= 0]
            stop = min(ends) if ends else len(data)
        yield data[start:stop].replace(b"\n", b" \xff ").split()
        start = stop
    yield [_END]


class Shard:
    """The words of one language, in their order, until the trie is made."""

    def __init__(self, before: tuple[bytes, ...] = ()):
        self.numbers, self.size, self.before = _Numbers(), len(before), len(before)
        self.runs = [np.fromiter(map(self.numbers.__getitem__, before), np.int32, len(before))]
        self.last = before

    def add(self, words: list[bytes]) -> None:
        self.runs.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
        self.size += len(words)
        self.last = (*self.last, *words[-2:])[-2:]

    def next(self) -> Shard:
        """A shard that goes on behind this one: phrases that end in its first words are counted here."""
        return Shard(self.last)

    def levels(self) -> tuple[list[bytes], list[tuple[np.ndarray, np.ndarray]], int]:
        """The words in byte order, (keys, counts) of each level, and the base of keys: a phrase is its words' places as digits."""
        words = sorted(self.numbers)
        place = np.empty(len(words), np.int32)
        place[[self.numbers[w] for w in words]] = np.arange(len(words))
        ids = place[np.concatenate(self.runs)]
        self.runs = []  # a shard is counted once, and its numbers take as much as all its words
        end, base = len(words) - 1, len(words)  # no word comes after the end of a piece
        inside = ids != end
        one = np.bincount(ids[self.before :], minlength=base)[:end]
        first = np.flatnonzero(one), one[one > 0]

        def pairs(which: np.ndarray) -> np.ndarray:
            out = ids[: len(which)][which].astype(np.int64)
            out *= base
            out += ids[1 : len(which) + 1][which]
            return out

        two = inside[:-1] & inside[1:]
        two[: max(0, self.before - 1)] = False
        second = _counted(pairs(two))
        three = inside[:-2] & inside[1:-1] & inside[2:]
        known = _counted(pairs(three))[0]
        # a triple's first digits are the place of its pair, so that three words never pass 64 bits
        third = np.searchsorted(known, pairs(three))
        third *= base
        third += ids[2:][three]
        del ids
        return words[:-1], [first, second, (*_counted(third), known)], base


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their counts; sorts the keys where they stand."""
    keys.sort()
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    start = np.flatnonzero(new)
    return keys[start], np.diff(start, append=len(keys))


def parts(shard: Shard, lang: str, borders: list[tuple[bytes, bytes, bytes]]) -> Iterator[tuple]:
    """The serialised trie, a row for each prefix range that it has nodes in. borders: sorted phrases, each the first of a range."""
    words, ((k1, n1), (k2, n2), (k3, n3, known)), base = shard.levels()
    firsts = [b[0] for b in borders]
    low = np.array([bisect_left(firsts, w) for w in words], np.int32)
    high = np.array([bisect_right(firsts, w) for w in words], np.int32)
    pair3 = known[k3 // base] if len(k3) else k3  # the pair of each triple
    r1, r2, r3 = (low[k] if len(k) else np.zeros(0, np.int32) for k in (k1, k2 // base, pair3 // base))
    for i in np.flatnonzero(high > low):  # a word that borders stand in: its pairs and triples lie in several ranges
        a2, b2 = np.searchsorted(k2, [i * base, (i + 1) * base])
        a3, b3 = np.searchsorted(pair3, [i * base, (i + 1) * base])
        for _, x, y in borders[low[i] : high[i]]:
            j = bisect_left(words, x)
            same = j < len(words) and words[j] == x
            r2[a2 + np.searchsorted(k2[a2:b2], i * base + j + same) : b2] += 1
            at = np.searchsorted(pair3[a3:b3], i * base + j)
            if same:
                stop = np.searchsorted(pair3[a3:b3], i * base + j + 1)
                at += np.searchsorted(k3[a3:b3][at:stop] % base, bisect_left(words, y))
            r3[a3 + at : b3] += 1
    for r in np.unique(np.concatenate([r1, r2, r3])):
        s1, s2, s3 = (slice(*np.searchsorted(x, [r, r + 1])) for x in (r1, r2, r3))
        up2, c2 = np.unique(pair3[s3], return_counts=True)
        all2, m2, d2 = _level(k2[s2], n2[s2], up2, c2)
        up1, c1 = np.unique(all2 // base, return_counts=True)
        all1, m1, d1 = _level(k1[s1], n1[s1], up1, c1)
        digits = [all1, all2 % base, k3[s3] % base]
        used, own = np.unique(np.concatenate(digits), return_inverse=True)
        w1, w2, w3 = np.split(own, np.cumsum([len(d) for d in digits[:-1]]))
        yield int(r), lang, [words[i] for i in used], w1, m1, d1, w2, m2, d2, w3, n3[s3]


def _level(keys: np.ndarray, counts: np.ndarray, parents: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a level and of the level below's parents, with counts and numbers of children (none: 0)."""
    both = np.union1d(keys, parents)
    n, c = np.zeros(len(both), np.int64), np.zeros(len(both), np.int64)
    n[np.searchsorted(both, keys)] = counts
    c[np.searchsorted(both, parents)] = children
    return both, n, c


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of PART."""
    part, lang, words, *levels = zip(*rows, strict=True)
    names = [f.split()[0] for f in PART.split(", ")]
    arrays = [pa.array(part, pa.int32()), pa.array(lang, pa.string()), pa.array(words, pa.list_(pa.binary()))]
    for name, lists in zip(names[3:], levels, strict=True):
        values = np.concatenate(lists).astype(np.int64 if name[0] == "n" else np.int32)
        arrays.append(pa.ListArray.from_arrays(np.cumsum([0, *map(len, lists)]).astype(np.int32), pa.array(values)))
    return pa.RecordBatch.from_arrays(arrays, names)


def _count(docs: DataFrame, borders: list[tuple[str, bytes, bytes, bytes]]) -> DataFrame:
    """The parts of all shards' tries."""
    first, by = {}, {}
    for k, (lang, *words) in enumerate(borders):
        first.setdefault(lang, k)
        by.setdefault(lang, []).append(tuple(words))
    langs = sorted(by)
    shared = docs.sparkSession.sparkContext.broadcast((langs, by, first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, by, first = shared.value
        shards: dict[str, Shard] = {}

        def out(lang: str) -> Iterator[pa.RecordBatch]:
            # ranges of a language follow those of the languages before it
            at = bisect_left(langs, lang)
            before = first[lang] if lang in first else (first[langs[at]] if at < len(langs) else sum(map(len, by.values())))
            rows, held = [], 0
            for row in parts(shards[lang], lang, by.get(lang, [])):
                rows.append((row[0] + before, *row[1:]))
                held += len(row[3]) + len(row[6]) + len(row[9])
                if held > 300_000:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

        for part in slices(batches, "t"):
            for text, lang in zip(part.column("t").to_pylist(), part.column("lang").to_pylist(), strict=True):
                shard = shards.setdefault(lang, Shard())
                for words in words_of(text):
                    shard.add(words)
                    if shard.size >= SHARD_WORDS:
                        yield from out(lang)
                        shards[lang] = shard = shard.next()
            if sum(s.size for s in shards.values()) >= 2 * SHARD_WORDS:
                for lang in list(shards):
                    yield from out(lang)
                    del shards[lang]
        for lang in list(shards):
            yield from out(lang)
            del shards[lang]

    return in_arrow(docs, run, PART)


def _column(table: pa.Table, name: str):
    """A list column in one piece."""
    column = table.column(name).combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


def _merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts; keys are sorted runs put together, which a stable sort merges."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    start = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
    return keys[start], np.add.reduceat(counts[order], start)


def merge_parts(key: tuple, table: pa.Table) -> pa.Table:
    """The nodes of one range of one language that occur LEAST times or more, and the number of its words (all words null)."""
    lists = _column(table, "words")
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    order = sorted(range(len(words)), key=words.__getitem__)
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    places, base = place[coded.indices.to_numpy()], max(1, len(words))
    starts = np.cumsum([0, *lists.value_lengths().to_numpy()])[:-1]
    flat = {c: _column(table, c).flatten().to_numpy() for c in ("n1", "c1", "n2", "c2", "n3")}
    w1, w2, w3 = (places[(x := _column(table, c)).flatten().to_numpy() + np.repeat(starts, x.value_lengths().to_numpy())] for c in ("w1", "w2", "w3"))

    pairs = np.repeat(w1, flat["c1"]) * base + w2
    known = np.unique(pairs)
    triples = np.searchsorted(known, np.repeat(pairs, flat["c2"])) * base + w3
    (k1, n1), (k2, n2), (k3, n3) = (_merge(k, flat[n]) for k, n in ((w1, "n1"), (pairs, "n2"), (triples, "n3")))
    total = int(n1.sum())
    (k1, n1), (k2, n2), (k3, n3) = ((k[n >= LEAST], n[n >= LEAST]) for k, n in ((k1, n1), (k2, n2), (k3, n3)))
    pair3 = known[k3 // base] if len(k3) else k3
    none = [np.full(len(k), -1) for k in (k1, k2)]
    digits = [np.concatenate(x) for x in ([[-1], k1, k2 // base, pair3 // base], [[-1], none[0], k2 % base, pair3 % base], [[-1], none[0], none[1], k3 % base])]
    texts = pa.array([words[i].decode() for i in order], pa.string())
    columns = [texts.take(pa.array(d.astype(np.int64), mask=d < 0)) for d in digits]
    counts = np.concatenate([[total], n1, n2, n3]).astype(np.int64)
    return pa.Table.from_arrays([pa.array([key[1].as_py()] * len(counts), pa.string()), *columns, pa.array(counts)], ["lang", "w1", "w2", "w3", "n"])


def _borders(docs: DataFrame) -> list[tuple[str, bytes, bytes, bytes]]:
    """The first phrases of prefix ranges, about one range for RANGE_BYTES of text, from a sample of texts."""
    total = docs.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    ranges = total // RANGE_BYTES + 1
    if ranges == 1:
        return []
    picked = docs.where(F.rand(7) < ranges * SAMPLE_BYTES / total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            out = []
            for text, lang in zip(part.column("t").to_pylist(), part.column("lang").to_pylist(), strict=True):
                for words in words_of(text):
                    out += [(lang, *p) for p in list(zip(words, words[1:], words[2:], strict=False))[::8] if _END not in p]
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *[pa.array(c, pa.binary()) for c in columns[1:]]], ["lang", "w1", "w2", "w3"])

    keys = ("lang", "w1", "w2", "w3")
    dealt = in_arrow(picked, run, "lang string, w1 binary, w2 binary, w3 binary").repartitionByRange(int(ranges), *keys)
    least = dealt.groupBy(F.spark_partition_id()).agg(F.min(F.struct(*keys)).alias("b")).select("b.*").collect()
    return sorted({(r["lang"], bytes(r["w1"]), bytes(r["w2"]), bytes(r["w3"])) for r in least})[1:]


def count_phrases(docs: DataFrame, text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """The merged trie: lang, w1, w2, w3 (null beyond a phrase's words; all null: all words of a range) and n, of phrases that occur LEAST times or more."""
    rows = docs.select(F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("t"), F.coalesce(F.col(lang_column).cast("string"), F.lit("und")).alias("lang"))
    return materialise(_count(rows, _borders(rows)).groupBy("part", "lang").applyInArrow(lambda key, table: merge_parts(key, table), NODES))


def score_cut(a: Column, left: Column, right: Column) -> Column:
    """floor(SCALE * a * a / (left * right)) in whole numbers of 38 digits."""
    big = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * (big(a) * big(a)), big(left) * big(right))


def collocations(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a (its count), l and r (those of the parts at its lowest-scoring cut), n (all words of the language), score."""
    trie = count_phrases(docs, text_column, lang_column)
    totals = trie.where("w1 is null").groupBy("lang").agg(F.sum("n").alias("n"))
    word = lambda c, name: trie.where("w1 is not null and w2 is null").select("lang", F.col("w1").alias(c), F.col("n").alias(name))
    pair = lambda a, b, name: trie.where("w2 is not null and w3 is null").select("lang", F.col("w1").alias(a), F.col("w2").alias(b), F.col("n").alias(name))
    cut = lambda k, left, right: F.struct(score_cut(F.col("a"), F.col(left), F.col(right)).alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))
    triples = trie.where("w3 is not null").withColumnRenamed("n", "a")
    # ancestors of a node, then its suffix links
    linked = triples.join(word("w1", "l1"), ["lang", "w1"]).join(pair("w1", "w2", "l2"), ["lang", "w1", "w2"]).join(pair("w2", "w3", "r1"), ["lang", "w2", "w3"]).join(word("w3", "r2"), ["lang", "w3"])
    best3 = linked.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.least(cut(1, "l1", "r1"), cut(2, "l2", "r2")).alias("best"))
    inside = triples.select("lang", "w1", "w2", "a").unionByName(triples.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a")).groupBy("lang", "w1", "w2").agg(F.max("a").alias("longer"))
    pairs = pair("w1", "w2", "a").join(inside, ["lang", "w1", "w2"], "left").where(f"longer is null or 100 * longer < {SHARE} * a")
    best2 = pairs.join(word("w1", "l1"), ["lang", "w1"]).join(word("w2", "r1"), ["lang", "w2"]).select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", cut(1, "l1", "r1").alias("best"))
    found = best3.unionByName(best2).select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # the first of parts of a language, then of the language: no task gets more than the parts' first
    salted = found.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(32)))
    few = salted.withColumn("_k", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_k") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
