"""Review-style merges and table checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merge_edits(base: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """Base rows with the non-null values of an edit row of the same key in place of their own."""
    changed = [c for c in edits.columns if c != key]
    joined = base.join(edits.select(key, *[F.col(c).alias(f"_new_{c}") for c in changed]), key, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in changed else F.col(c) for c in base.columns])


def append_missing(base: DataFrame, truth: DataFrame, key: str, id_column: str, start: int = -100) -> DataFrame:
    """Base and those truth rows whose key it lacks, with new ids start, start - 1, ... in the order of the key."""
    missing = truth.join(base.select(key), key, "left_anti")
    numbered = missing.withColumn(id_column, (start + 1 - F.row_number().over(Window.orderBy(key))).cast("long"))
    return base.unionByName(numbered, allowMissingColumns=True)


def known(df: DataFrame, names: DataFrame, key: str) -> DataFrame:
    return df.join(names.select(key), key, "left_semi")


def unknown(df: DataFrame, names: DataFrame, key: str) -> DataFrame:
    return df.join(names.select(key), key, "left_anti")


def violations(df: DataFrame, key: list[str], required: list[str]) -> DataFrame:
    """Rows of problems: duplicate keys and missing required values, with counts."""
    twice = df.groupBy(*key).count().where("count > 1").agg(F.count("*").alias("n"), F.sum("count").alias("n_rows")).select(F.lit("duplicate key").alias("problem"), "n", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))
    gaps = [df.agg(F.count_if(F.col(c).isNull()).alias("n")).select(F.lit(f"missing {c}").alias("problem"), "n", F.col("n").alias("n_rows")) for c in required]
    out = twice
    for g in gaps:
        out = out.unionByName(g)
    return out.where("n > 0")


def contiguous(df: DataFrame, group: str, order: str) -> DataFrame:
    """Groups whose distinct orders leave a gap."""
    spread = df.groupBy(group).agg(F.min(order).alias("lo"), F.max(order).alias("hi"), F.count_distinct(order).alias("n"))
    return spread.where(F.col("hi") - F.col("lo") + 1 != F.col("n"))


def upper_neighbour(df: DataFrame, group: str, order: str, columns: list[str]) -> DataFrame:
    """Each row with the named columns of the row one order above in its group (no match: no row)."""
    upper = df.select(F.col(group), (F.col(order) + 1).alias(order), *[F.col(c).alias(f"upper_{c}") for c in columns])
    return df.join(upper, [group, order])


def ordered_list(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("string").alias("v"))))
    return df.groupBy(group).agg(F.concat_ws(",", F.transform(pairs, lambda p: p["v"])).alias("members"))
