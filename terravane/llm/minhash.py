"""MinHash near-dedup with DartMinHash signatures, banded joining and an exact check.

A text is a weighted set of word shingles (weight 1 each, or their counts). Darts are thrown, by hash
alone, into the plane of weight and rank of every element: cells of known area get a Poisson number
of darts at hashed places. Darts below the element's weight and below a rank bound that makes about
K ln K + 2 K of them are kept, dealt to K coordinates by hash, and the earliest of each coordinate is
the signature; if a coordinate is empty the bound is doubled. Equal coordinates have the probability
of the weighted Jaccard similarity. With BANDS bands of ROWS coordinates a pair at 0.8 is missed with
probability (1 - 0.8 ** ROWS) ** BANDS, 5e-6.

Equal texts are one class before anything is joined. Members of a band's bucket are compared with one
hub each, verified exactly, and merged into components, HUB_ROUNDS times with other hubs: a group of copies
costs about one comparison a member and round. Buckets that still hold several components are compared
in full: small ones pair by pair across components, larger ones in blocks of like set sizes (sizes that differ by
more than the similarity allows are never compared), where a pair of blocks gives a row a member at
most. What is kept is the component, never all pairs. Members of one bucket, and pairs with one hub,
are dealt over SALTS tasks.

Defined results: equal texts are always one class; a null text is a class of its own; texts without a
word are similar to nothing but equal texts; texts of fewer than SHINGLE words have one shingle of all
of them; the class id is the smallest id in it. Every row is judged by its own text: rows with one id and
one text share a class and a fate, rows with one id and unlike texts may be in two classes, so no text
goes because another text has its id. Null ids are larger than all others: such a row has a class id
if its class holds any id, and is kept only if it holds none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NORMAL, in_arrow, materialise, slices
from .graph import components

SHINGLE, LEAST, BANDS, ROWS = 5, 0.8, 40, 6
#: Rounds of hubs; members of a bucket up to which its pairs are joined one by one; members and bytes of a block in
#: larger ones; shingles of a block that are compared at once; tasks over which one key is dealt.
HUB_ROUNDS, SMALL, BLOCK, BLOCK_BYTES, TILE, SALTS = 2, 12, 512, 8 << 20, 4096, 16
#: A text is frequent if it holds more than one row in so many.
OFTEN = 1000
#: Bytes of a text whose words are hashed at once.
WORD_BLOCK = 1 << 17

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_ORDER = np.array([pow(0xD1342543DE82EF95, i + 1, 1 << 64) for i in range(64)], np.uint64)
_SMALL = 6  # cells of rank below 1 are halved this often
_CDF = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> _U(11)).astype(np.float64) * 2.0**-53


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def word_hashes(text: str, block: int = WORD_BLOCK) -> np.ndarray:
    """A 64-bit hash of each lower-cased word, from prefix sums of one polynomial over the bytes; texts are worked through in blocks that end at a space, so their length needs no memory."""
    line = b" " + text.encode().translate(NORMAL) + b" "
    out, begin = [], 0
    while begin < len(line) - 1:
        end = line.find(b" ", min(begin + block, len(line) - 1))
        out.append(_word_hashes(np.frombuffer(line, np.uint8, end + 1 - begin, begin)))
        begin = end
    return out[0] if len(out) == 1 else np.concatenate(out)


def _word_hashes(data: np.ndarray) -> np.ndarray:
    """data: bytes that begin and end with a space."""
    space = data == 32
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(len(data))
    sums = np.cumsum((data.astype(np.uint64) + _U(1)) * power[: len(data)], dtype=np.uint64)
    return mix((sums[end - 1] - sums[start - 1]) * inverse[start] + (end - start).astype(np.uint64))


def shingles(text: str | None, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the word shingles, and how often each occurs."""
    words = word_hashes(text) if text else np.zeros(0, np.uint64)
    if not len(words):
        return words, np.zeros(0, np.int64)
    n = min(size, len(words))
    total = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        total += words[i : len(words) - n + 1 + i] * _ORDER[i]
    return np.unique(mix(total + _U(n)), return_counts=True)


def _cells(theta: float) -> tuple[np.ndarray, np.ndarray]:
    """Rank borders of unit-width cells that cover [0, theta]: halved below 1, of height 1 above."""
    small = [0.0, *(2.0 ** (i - _SMALL) for i in range(_SMALL + 1))]
    keep = next((i for i, x in enumerate(small) if i and x >= theta), None)
    borders = np.array(small[: keep + 1]) if keep else np.concatenate([small, np.arange(2, int(np.ceil(theta)) + 1)])
    return borders[:-1], borders[1:]


def _poisson_cdf(area: float) -> np.ndarray:
    if area not in _CDF:
        p, total, out = np.exp(-area), np.exp(-area), []
        for j in range(1, 24):
            out.append(total)
            p *= area / j
            total += p
        _CDF[area] = np.array(out)
    return _CDF[area]


def darts(elements: np.ndarray, weights: np.ndarray, theta: float) -> tuple[np.ndarray, np.ndarray]:
    """Identity and rank of all darts with weight coordinate below the element's weight and rank below theta."""
    ids, ranks = [], []
    low, width, layer = 0.0, 1.0, 0
    while len(elements):
        begin, end = _cells(theta * width)  # in this layer a cell is width wide and 1/width as high
        key = mix(np.arange(len(begin), dtype=np.uint64) + _U(layer << 32) + _U(1))
        u = mix(elements[:, None] ^ key[None])
        cdf = np.stack([_poisson_cdf(float(a)) for a in end - begin])
        full = _unit(u)
        at, cell = np.nonzero(full >= cdf[None, :, 0])
        count = (full[at, cell][:, None] >= cdf[cell]).sum(1)
        owner = np.repeat(np.arange(len(at)), count)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        dart = mix(u[at, cell][owner] + _BASE * (nth + 1).astype(np.uint64))
        span = (end - begin)[cell][owner]
        rank = (begin[cell][owner] + span * _unit(dart)) / width
        inside = rank <= theta
        if width > 1 or (weights < 1).any():
            inside &= low + width * _unit(mix(dart ^ _BASE)) <= weights[at][owner]
        ids.append(dart[inside])
        ranks.append(rank[inside])
        low += width
        width = low if layer else 1.0
        layer += 1
        more = weights > low
        elements, weights = elements[more], weights[more]
    return (np.concatenate(ids), np.concatenate(ranks)) if ids else (np.zeros(0, np.uint64), np.zeros(0))


def signature(elements: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """The earliest dart of each of k coordinates."""
    theta = (k * np.log(k) + 2 * k) / weights.sum()
    while True:
        ids, ranks = darts(elements, weights, theta)
        spot = (mix(ids + _INVERSE) >> _U(33)).astype(np.int64) % k
        order = np.argsort(-ranks, kind="stable")
        out, filled = np.zeros(k, np.uint64), np.zeros(k, bool)
        out[spot[order]] = ids[order]
        filled[spot] = True
        if filled.all():
            return out
        theta *= 2


def band_keys(text: str | None, weighted: bool = False, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE) -> np.ndarray:
    elements, counts = shingles(text, size)
    if not len(elements):
        return np.zeros(0, np.int64)
    found = signature(elements, counts.astype(float) if weighted else np.ones(len(elements)), bands * rows).reshape(bands, rows)
    return mix((found * _ORDER[None, :rows]).sum(1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)).view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted arrays of (hash, count) rows."""
    _, i, j = np.intersect1d(a["h"], b["h"], assume_unique=True, return_indices=True)
    common = int(np.minimum(a["n"][i], b["n"][j]).sum())
    return common / (int(a["n"].sum()) + int(b["n"].sum()) - common)


_SET = np.dtype([("h", "<u8"), ("n", "<i4")])


def _signed(keyed: DataFrame, weighted: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            keys = [band_keys(t, weighted) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("h1"), part.column("h2"), pa.array(keys, pa.list_(pa.int64()))], ["id", "h1", "h2", "bands"])

    return in_arrow(keyed, run, "id long, h1 long, h2 long, bands array<long>")


def _sets(texts: DataFrame, weighted: bool) -> DataFrame:
    """class, shingles (packed rows of hash and count), size (the sum of counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            out, sizes = [], []
            for t in part.column("text").to_pylist():
                h, n = shingles(t)
                rows = np.empty(len(h), _SET)
                rows["h"], rows["n"] = h, n if weighted else 1
                out.append(rows.tobytes())
                sizes.append(int(rows["n"].sum()))
            yield pa.RecordBatch.from_arrays([part.column("class"), pa.array(out, pa.binary()), pa.array(sizes, pa.int64())], ["class", "shingles", "size"])

    return in_arrow(texts.select("class", "text"), run, "class long, shingles binary, size long")


def _salt(column: str):
    return F.pmod(F.xxhash64(F.lit(5), column), F.lit(SALTS)).alias("salt")


def _on_key(rows: DataFrame, per_key: DataFrame) -> DataFrame:
    """Joins rows (key, salt, ...) with one row a key, a copy of which goes to each of the tasks that a key is dealt over."""
    return rows.join(per_key.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["key", "salt"])


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose similarity is at least `least`. A set that is b of many pairs goes to several tasks."""
    salted = pairs.select("a", "b", _salt("a"))
    second = salted.select("b", "salt").distinct().join(sets.select(F.col("class").alias("b"), F.col("shingles").alias("y")), "b")
    both = salted.join(sets.select(F.col("class").alias("a"), F.col("shingles").alias("x")), "a").join(second, ["b", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "x"):
            like = [similarity(np.frombuffer(x, _SET), np.frombuffer(y, _SET)) >= least for x, y in zip(part.column("x").to_pylist(), part.column("y").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(like, pa.bool_())], ["a", "b", "like"])

    return in_arrow(both.select("a", "b", "x", "y"), run, "a long, b long, like boolean")


def _rest(shared: DataFrame, comps: DataFrame) -> DataFrame:
    """key, salt, class, component of the buckets that hold several components, and n, the members of the bucket."""
    named = shared.join(comps.withColumnRenamed("node", "class"), "class", "left").select("key", "salt", "class", F.coalesce("component", "class").alias("component"))
    open_keys = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("key", "n")
    return _on_key(named, open_keys)


def _block_links(rest: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links u, v of large buckets (key, class): all pairs of blocks of like sizes are compared exactly, and of each pair of blocks comes one row a class at most, with the least class that it reaches there.

    Members are in layers by the logarithm of their size, so that only layers side by side can hold similar sets; a layer is dealt
    to blocks by hash. Each block names its partners and is sent to each of them, so pairs of blocks are dealt over all tasks.
    """
    layer = F.floor(F.log(F.col("size").cast("double")) / float(np.log((1 + 1e-6) / least)))
    sized = rest.select("key", "class").join(sets, "class").where("size > 0").withColumn("layer", layer)
    number = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(F.octet_length("shingles")) / BLOCK_BYTES)).cast("long")
    layers = sized.groupBy("key", "layer").agg(number.alias("blocks"))
    above = layers.select("key", (F.col("layer") - 1).alias("layer"), F.col("blocks").alias("blocks_above"))
    layers = layers.join(above, ["key", "layer"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    dealt = sized.select("*", _salt("class")).join(layers, ["key", "layer", "salt"]).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")))
    blocks = materialise(dealt.groupBy("key", "layer", "block").agg(F.first("blocks").alias("blocks"), F.first("blocks_above").alias("blocks_above"), F.collect_list(F.struct("class", "shingles")).alias("members")))
    beside = F.transform(F.sequence("block", F.col("blocks") - 1), lambda i: F.struct(F.col("layer").alias("layer"), i.alias("block")))
    higher = F.when(F.col("blocks_above") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks_above") - 1), lambda i: F.struct((F.col("layer") + 1).alias("layer"), i.alias("block"))))
    partner = F.explode(F.concat(beside, F.coalesce(higher, F.slice(beside, 1, 0)))).alias("p")
    named = blocks.select("key", F.struct("layer", "block").alias("own"), partner)
    a = blocks.select("key", F.struct("layer", "block").alias("own"), F.col("members").alias("a"))
    b = blocks.select("key", F.struct("layer", "block").alias("p"), F.col("members").alias("b"))
    pairs = named.join(b, ["key", "p"]).join(a, ["key", "own"]).select("a", "b")

    def unpack(members) -> tuple[np.ndarray, list[np.ndarray]]:
        return np.array([m["class"] for m in members], np.int64), [np.frombuffer(m["shingles"], _SET) for m in members]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (x, xs), (y, ys) = unpack(batch.column("a")[i].as_py()), unpack(batch.column("b")[i].as_py())
                hit = similar_blocks(xs, ys, least)
                rx, ry, far = x.copy(), y.copy(), np.iinfo(np.int64).max
                while True:
                    nx = np.minimum(rx, np.where(hit, ry[None], far).min(1))
                    ny = np.minimum(ry, np.where(hit, nx[:, None], far).min(0))
                    if (nx == rx).all() and (ny == ry).all():
                        break
                    rx, ry = nx, ny
                u, v = np.concatenate([x, y]), np.concatenate([rx, ry])
                yield pa.RecordBatch.from_arrays([pa.array(u[u != v]), pa.array(v[u != v])], ["u", "v"])

    return in_arrow(pairs, run, "u long, v long")


def similar_blocks(xs: list[np.ndarray], ys: list[np.ndarray], least: float, tile: int = TILE) -> np.ndarray:
    """Which pairs of two lists of sets have a similarity of at least `least`: exact, by matrix products over the shingles that both lists hold, some thousand at a time (counts above 1 in layers)."""
    sizes = [np.array([s["n"].sum() for s in sets], np.int64) for sets in (xs, ys)]
    common = np.zeros((len(xs), len(ys)), np.float32)
    tiles = max(1, -(-max(sum(map(len, xs)), sum(map(len, ys))) // (8 * tile)))  # equal ranges of hashes
    for t in range(tiles):
        lo, hi = _U((t << 64) // tiles), _U(((t + 1) << 64) // tiles - 1)
        cut = [[s[np.searchsorted(s["h"], lo) : np.searchsorted(s["h"], hi, "right")] for s in sets] for sets in (xs, ys)] if tiles > 1 else [xs, ys]
        flat = [(np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])) for sets in cut]
        shared = np.intersect1d(flat[0][0]["h"], flat[1][0]["h"])
        for a in range(0, len(shared), tile):
            both, placed = shared[a : a + tile], []
            for rows, owner in flat:
                at = np.searchsorted(both, rows["h"])
                known = both[np.minimum(at, len(both) - 1)] == rows["h"]
                placed.append((at[known], owner[known], rows["n"][known]))
            for layer in range(1, min(int(n.max()) for _, _, n in placed) + 1):
                tables = []
                for sets, (at, owner, n) in zip((xs, ys), placed, strict=True):
                    table = np.zeros((len(sets), len(both)), np.float32)
                    table[owner[n >= layer], at[n >= layer]] = 1
                    tables.append(table)
                common += tables[0] @ tables[1].T
    union = sizes[0][:, None] + sizes[1][None] - common
    return common.astype(float) >= least * union - 1e-9


def _classified(docs: DataFrame, least: float, weighted: bool, id_column: str, text_column: str) -> DataFrame:
    """id, h1, h2 (hashes of the text) and class_id, one row per row of docs."""
    keyed = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text")).withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(7), "text")})
    present = keyed.where("text is not null")
    classes = materialise(
        _signed(present, weighted).groupBy("h1", "h2").agg(F.min("id").alias("first_id"), F.first("bands").alias("bands"), F.count("*").alias("copies")).withColumn("class", F.monotonically_increasing_id())
    )
    buckets = classes.select("class", F.explode("bands").alias("key"), _salt("class"))
    hubs = buckets.groupBy("key").agg(F.min("class").alias("hub"), F.count("*").alias("n")).where("n > 1").select("key", "hub")
    shared = materialise(_on_key(buckets, hubs).select("key", "salt", "class", "hub"))
    wanted = shared.select("class").distinct().join(classes.select("class", "h1", "h2", F.col("first_id").alias("id")), "class").alias("w")
    first = present.alias("p").join(wanted, F.expr("p.h1 = w.h1 and p.h2 = w.h2 and p.id <=> w.id")).select("w.class", "p.text")
    sets = materialise(_sets(first.dropDuplicates(["class"]), weighted))
    links = None
    for turn in range(HUB_ROUNDS):
        if turn == 0:
            pairs = shared.where("class <> hub").groupBy(F.col("class").alias("a")).agg(F.min("hub").alias("b"))
        else:
            hub = rest.groupBy("key").agg(F.min_by(F.struct(F.col("class").alias("b"), F.col("component").alias("cb")), F.xxhash64(F.lit(turn), "class")).alias("hub"))
            other = _on_key(rest, hub).where(F.col("component") != F.col("hub.cb")).select("class", "hub.b")
            pairs = other.groupBy("class").agg(F.min_by("b", F.xxhash64(F.lit(turn), "b")).alias("b")).select(F.greatest("class", "b").alias("a"), F.least("class", "b").alias("b")).distinct()
        found = materialise(_verified(pairs, sets, least).where("like").select(F.col("a").alias("u"), F.col("b").alias("v")))
        links = found if links is None else links.unionByName(found)
        comps = components(links)
        rest = materialise(_rest(shared.select("key", "salt", "class"), comps))
    # Buckets that still hold several components: all pairs across components in small ones, blocks in large ones.
    x, y = (rest.where(F.col("n") <= SMALL).select("key", F.col("class").alias(k), F.col("component").alias(f"c{k}")) for k in "ab")
    pairs = x.join(y, "key").where("a > b and ca <> cb").select("a", "b").distinct()
    few = _verified(pairs, sets, least).where("like").select(F.col("a").alias("u"), F.col("b").alias("v"))
    links = links.unionByName(materialise(few)).unionByName(materialise(_block_links(rest.where(F.col("n") > SMALL), sets, least)))
    comps = components(links)
    named = classes.select("class", "h1", "h2", "first_id", "copies").join(comps.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    least_id = named.groupBy("component").agg(F.min("first_id").alias("class_id"))
    per_class = materialise(named.join(least_id, "component").select("h1", "h2", "class_id", "copies"))
    # Texts that hold more than one row in OFTEN are fewer than OFTEN: they are sent to all tasks, and no task gets all copies of a text.
    total = per_class.agg(F.sum("copies").alias("n")).first()["n"] or 0
    often = F.broadcast(per_class.where(F.col("copies") * OFTEN > total).drop("copies"))
    rows, keys = present.select("id", "h1", "h2"), ["h1", "h2"]
    found = rows.join(often, keys).unionByName(rows.join(often, keys, "left_anti").join(per_class.where(F.col("copies") * OFTEN <= total).drop("copies"), keys)).select("id", "h1", "h2", "class_id")
    return found.unionByName(keyed.where("text is null").select("id", "h1", "h2", F.col("id").alias("class_id")))


def near_duplicates(docs: DataFrame, least: float = LEAST, weighted: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, class_id (smallest id of its class) and kept (id = class_id), one row per row of docs."""
    found = _classified(docs, least, weighted, id_column, text_column)
    return found.select(F.col("id").alias(id_column), "class_id", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"))


def first_of_each(docs: DataFrame, least: float = LEAST, weighted: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs that near_duplicates() keeps, with all their columns."""
    found = _classified(docs, least, weighted, id_column, text_column)
    gone = found.where(~F.col("id").eqNullSafe(F.col("class_id"))).select("id", "h1", "h2").distinct().alias("gone")
    text = F.col(f"docs.{text_column}").cast("string")
    same = F.col(f"docs.{id_column}").cast("long").eqNullSafe(F.col("gone.id")) & (F.xxhash64(text) == F.col("gone.h1")) & (F.xxhash64(F.lit(7), text) == F.col("gone.h2"))
    return docs.alias("docs").join(gone, same, "left_anti")
