"""Merkle manifest of a data set: one tree of digests per source, one over the sources, and proofs of rows.

Each row is a leaf: the sha256 of its fields, each preceded by its length. The leaves of a source, in the order of
their ids, are a tree: every `arity` consecutive nodes (a last run may be shorter) are hashed into one node of
the next level, until one is left, the subroot. The subroots, in the order of their sources, are a tree likewise.

The node store is outside memory: leaves are dealt by ranges of (source, id), so that no task gets a whole source, and numbered; each level
is written as Parquet (`level=k` of its tree) and the next is made from it alone. Proofs go the other way: a scan of each level,
joined to the level above by (tree, position), hands every node the siblings on its way to the root. Text is read once, by the
scan that hashes it; what is shuffled is some hundred bytes a row.

Defined results: a null field counts as `-`, a null source is one source and comes first, null ids come first in their
source; rows with one id are ordered by their digests, and equal rows are leaves of their own; a source of one row has its leaf as
subroot; an empty table has no rows and no root; a text is hashed whole, whatever its length; other columns are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import shared_folder
from ..operators.sequences import number_spread
from .common import materialise

#: Fixed values of the contract: nodes hashed into one, and the fields of a leaf in their order.
ARITY, FIELDS = 16, ("doc_id", "source", "lang", "n_chars", "text")
#: One step of a proof: the digests left and right of a node in its run, joined.
STEP = "struct<l string, r string>"


def sha(*parts: Column) -> Column:
    """Lowercase hex sha256 of strings put together."""
    return F.sha2(F.concat(*parts) if len(parts) > 1 else parts[0], 256)


def field(value: Column) -> Column:
    """A field of a leaf: its UTF-8 length, a colon and its value; a null is told from all values."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(**values: Column) -> Column:
    """The digest of a row; values replace columns of the same name."""
    return sha(*[field(values.get(c, F.col(c))) for c in FIELDS])


@dataclass
class Forest:
    """The written runs of many trees: of level k, tree, position (of the node that the run becomes), digest, members, left."""

    path: str
    levels: int
    leaves: DataFrame  # tree, position, left (nodes of the level), digest and what else a leaf carries

    def runs(self, k: int) -> DataFrame:
        return self.leaves.sparkSession.read.parquet(f"{self.path}/level={k}")

    def roots(self) -> DataFrame:
        """tree, height, digest: the last node of each tree."""
        out = self.leaves.where("left = 1").select("tree", F.lit(0).alias("height"), "digest")
        for k in range(self.levels):
            out = out.unionByName(self.runs(k).where("left = 1").select("tree", F.lit(k + 1).alias("height"), "digest"))
        return out


def grow(leaves: DataFrame, order: list[str], carried: tuple[str, ...] = (), arity: int = ARITY) -> Forest:
    """Numbers the leaves (tree, the columns of order, digest, carried) of each tree and writes all levels; one job a level."""
    columns = ["tree", *dict.fromkeys([*order, "digest", *carried])]
    numbered = number_spread(leaves.select(*columns), ["tree"], [*order, "digest"], "position", "left", materialise)
    base = materialise(numbered.select("tree", (F.col("position") - 1).alias("position"), "left", "digest", *carried))
    most = base.agg(F.max("left")).first()[0] or 0
    forest, nodes, extra = Forest(shared_folder(leaves.sparkSession), 0, base), base, carried
    while most > 1:
        run = F.sort_array(F.collect_list(F.struct("position", "digest", *extra)))
        merged = nodes.where("left > 1").groupBy("tree", F.floor(F.col("position") / arity).alias("position"), F.ceil(F.col("left") / arity).alias("left")).agg(run.alias("members"))
        digest = sha(F.array_join(F.transform("members", lambda m: m["digest"]), ""))
        merged.withColumn("digest", digest).write.parquet(f"{forest.path}/level={forest.levels}")
        nodes, extra, most = forest.runs(forest.levels), (), -(-most // arity)
        forest.levels += 1
    return forest


def _members(runs: DataFrame, above: DataFrame, arity: int = ARITY) -> DataFrame:
    """The members of runs, each with its siblings before the steps of the run's own node; above: tree, position, steps and what holds for a whole tree."""
    joined = runs.select("tree", "position", "members").join(above, ["tree", "position"])
    rest = [c for c in above.columns if c not in ("tree", "position", "steps")]
    digests = F.transform("members", lambda m: m["digest"])
    each = joined.select("tree", (F.col("position") * arity).alias("_first"), digests.alias("_all"), "steps", *rest, F.posexplode("members").alias("_i", "member"))
    step = F.struct(
        F.array_join(F.slice("_all", F.lit(1), F.col("_i")), "").alias("l"),
        F.array_join(F.slice("_all", F.col("_i") + 2, F.greatest(F.size("_all") - F.col("_i") - 1, F.lit(0))), "").alias("r"),
    )
    return each.select("tree", (F.col("_first") + F.col("_i")).alias("position"), F.concat(F.array(step), "steps").alias("steps"), *rest, "member")


def descend(forest: Forest, roots: DataFrame, arity: int = ARITY) -> DataFrame:
    """The leaves with the steps from them up to the end of roots' own (tree, height, steps and what holds for a whole tree)."""
    rest = [c for c in roots.columns if c not in ("tree", "height")]
    at = lambda k: roots.where(F.col("height") == k).select("tree", F.lit(0).cast("long").alias("position"), *rest)
    above = at(forest.levels)
    for k in reversed(range(forest.levels)):
        found = _members(forest.runs(k), above, arity)
        if k:
            above = found.drop("member").unionByName(at(k)).select("tree", "position", *rest)
    kept = [c for c in forest.leaves.columns if c not in ("tree", "position", "left")]
    alone = forest.leaves.where("left = 1").join(at(0), ["tree", "position"]).select(*rest, *kept)
    return found.select(*rest, *[F.col(f"member.{c}").alias(c) for c in kept]).unionByName(alone) if forest.levels else alone


@dataclass
class Manifest:
    sources: Forest
    top: Forest

    def root(self) -> str | None:
        """The one digest of the data set; none of an empty table."""
        row = self.top.roots().first()
        return row["digest"] if row else None

    def proofs(self) -> DataFrame:
        """The carried columns of each leaf, digest, steps (from the leaf to the root), subroot and root."""
        ends = self.top.roots().select("tree", "height", F.array().cast(f"array<{STEP}>").alias("steps"), F.col("digest").alias("root"))
        subroots = descend(self.top, ends).withColumnRenamed("digest", "subroot").select(F.col("source").alias("tree"), "height", "steps", "subroot", "root")
        return descend(self.sources, subroots)


def build(docs: DataFrame, digest: Column, tree: str = "source", order: str = "doc_id", **carried: Column) -> Manifest:
    """The manifest of docs; digest: a leaf of each row; carried: more columns that its leaf keeps."""
    # byte order, null before all else
    name = F.coalesce(F.concat(F.lit("s"), F.col(tree).cast("string")), F.lit(""))
    leaves = docs.select(name.alias("tree"), F.col(order).alias("id"), digest.alias("digest"), *[c.alias(k) for k, c in carried.items()])
    sources = grow(leaves, ["id"], ("id", *carried))
    subroots = sources.roots().select(F.lit("").alias("tree"), F.col("tree").alias("source"), "height", "digest")
    return Manifest(sources, grow(subroots, ["source"], ("source", "height")))


def fold(digest: Column, steps: Column) -> Column:
    """The root that a leaf's digest and its siblings lead to."""
    return F.aggregate(steps, digest, lambda x, s: sha(s["l"], x, s["r"]))


def proof(steps: Column) -> Column:
    """One digest of all siblings, level by level, left to right."""
    return sha(F.array_join(F.transform(steps, lambda s: F.concat(s["l"], s["r"])), ""))


def verify(docs: DataFrame, tampered: Column, changed: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, and for each row the root that its leaf leads to when its text is `changed` where `tampered` holds.

    The manifest is made of the rows as they are; folded_root takes the changed row's digest and the siblings of the manifest.
    """
    docs = docs.select(*FIELDS)
    other = F.when(tampered, leaf(text=changed))
    found = build(docs, leaf(), other=other).proofs()
    folded = fold(F.coalesce("other", "digest"), F.col("steps"))
    out = found.select(F.col("id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", proof(F.col("steps")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def digest(docs: DataFrame) -> DataFrame:
    """verify() with A-Z lower-cased in the texts of rows whose crc32 of the id is a multiple of 5 (null ids: none)."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return verify(docs, chosen, F.translate("text", upper, lower))
