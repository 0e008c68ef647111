"""Ordered-sequence operators: runs, thinning, arc length, resampling, sliding windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import cut_lineage


def run_length_segments(df: DataFrame, partition: list[str], order: list, value: str) -> DataFrame:
    """Maximal runs of equal values: partition, run_no (from 1), value, first and last position, n.

    `order` must be unique in a partition. Nulls equal nulls.
    """
    w = Window.partitionBy(*partition).orderBy(*order)
    marked = df.select(*partition, *order, value, F.row_number().over(w).alias("pos"), F.lag(value).over(w).alias("_before"))
    change = F.when((F.col("pos") == 1) | ~F.col(value).eqNullSafe(F.col("_before")), 1).otherwise(0)
    runs = marked.withColumn("run_no", F.sum(change).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*partition, "run_no").agg(F.first(value).alias(value), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count("*").alias("n"))


def number(df: DataFrame, partition: list[str], order: list, name: str = "rn", count: str | None = None) -> DataFrame:
    """Adds row numbers (from 1) and, if named, the size of each partition."""
    w = Window.partitionBy(*partition).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(w))
    return out.withColumn(count, F.count("*").over(Window.partitionBy(*partition))) if count else out


def number_spread(df: DataFrame, partition: list[str], order: list, name: str = "rn", count: str | None = None, cut: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """As number(), for few partitions of many rows: rows are dealt by ranges of (partition, order), numbered in each range, and shifted by the rows of the ranges before, so that no task gets a whole partition."""
    ranged = cut(df.repartitionByRange(*partition, *order).withColumn("_p", F.spark_partition_id()))
    w = Window.partitionBy(*partition).orderBy("_p")
    sizes = ranged.groupBy(*partition, "_p").agg(F.count("*").alias("_c"))  # a row a partition and range
    before = sizes.select(*partition, "_p", (F.sum("_c").over(w) - F.col("_c")).alias("_before"), F.sum("_c").over(Window.partitionBy(*partition)).alias("_total"))
    inside = ranged.withColumn("_n", F.row_number().over(Window.partitionBy(*partition, "_p").orderBy(*order)))
    same = None
    for c in (*partition, "_p"):
        test = F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        same = test if same is None else same & test
    joined = inside.alias("a").join(before.alias("b"), same)
    return joined.select(*[F.col(f"a.{c}") for c in df.columns], (F.col("_n") + F.col("_before")).alias(name), *([F.col("_total").alias(count)] if count else []))


def stride_thin(df: DataFrame, partition: list[str], order: list, most: int, spread: bool = False) -> DataFrame:
    """Every s-th row of each partition, with s the least stride that leaves `most` rows or fewer. Spread is for few partitions of many rows."""
    counted = (number_spread if spread else number)(df, partition, order, "_rn", "_n")
    return counted.where((F.col("_rn") - 1) % F.ceil(F.col("_n") / most) == 0).drop("_rn", "_n")


def every_nth(df: DataFrame, partition: list[str], order: list, n: int, spread: bool = False) -> DataFrame:
    return (number_spread if spread else number)(df, partition, order, "_rn").where((F.col("_rn") - 1) % n == 0).drop("_rn")


def pick_at(df: DataFrame, partition: list[str], order: list, fractions: list[float]) -> DataFrame:
    """The rows at floor(fraction * (n - 1)) of each partition; one row per fraction."""
    counted = number(df, partition, order, "_rn", "_n").withColumn("fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions])))
    return counted.where(F.col("_rn") - 1 == F.floor(F.col("fraction") * (F.col("_n") - 1))).drop("_rn", "_n")


def with_arc_length(df: DataFrame, partition: list[str], order: list, x: str, y: str, name: str = "s") -> DataFrame:
    """Adds the length of the path up to each vertex."""
    w = Window.partitionBy(*partition).orderBy(*order)
    dx, dy = F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)
    stepped = df.withColumn("_step", F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0)))
    return stepped.withColumn(name, F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def resample(df: DataFrame, partition: list[str], order: list, x: str, y: str, step: float) -> DataFrame:
    """Points every `step` along each path, and its end point: partition, seq (from 0), s, x, y.

    The vertex pairs of a path become right-closed intervals of arc length, and each interval makes the
    targets inside it, so nothing is joined. A path of no length gives its first point; single points stay.
    """
    w = Window.partitionBy(*partition).orderBy("_pos")
    located = with_arc_length(number(df, partition, order, "_pos"), partition, ["_pos"], x, y, "_s")
    pieces = located.select(
        *partition, "_pos", "_s", F.col(x).alias("x"), F.col(y).alias("y"),
        F.coalesce(F.lag("_s").over(w), F.lit(0.0)).alias("_s0"), F.lag(x).over(w).alias("_x0"), F.lag(y).over(w).alias("_y0"),
        F.max("_s").over(Window.partitionBy(*partition)).alias("_total"),
    )
    # Targets k * step (k from 1) with s0 < k * step <= s and k * step < total, then the end point.
    last = F.ceil(F.col("_total") / step) - 1
    low, high = F.floor(F.col("_s0") / step) + 1, F.least(F.floor(F.col("_s") / step), last)
    inner = pieces.where((F.col("_pos") > 1) & (high >= low)).withColumn("seq", F.explode(F.sequence(low, high)))
    t = (F.col("seq") * step - F.col("_s0")) / (F.col("_s") - F.col("_s0"))
    inner = inner.select(*partition, "seq", (F.col("seq") * step).alias("s"), (F.col("_x0") + t * (F.col("x") - F.col("_x0"))).alias("x"), (F.col("_y0") + t * (F.col("y") - F.col("_y0"))).alias("y"))
    start = pieces.where("_pos = 1").select(*partition, F.lit(0).cast("long").alias("seq"), F.lit(0.0).alias("s"), "x", "y")
    top = Window.partitionBy(*partition).orderBy(F.desc("_pos"))
    end = pieces.withColumn("_r", F.row_number().over(top)).where("_r = 1 and _total > 0").select(*partition, (last + 1).alias("seq"), F.col("_total").alias("s"), "x", "y")
    return start.unionByName(inner).unionByName(end)


def sliding_windows(df: DataFrame, partition: list[str], order: list, size: int, least: int) -> DataFrame:
    """Rows of overlapping windows: window_no and the row's place in it.

    Full windows start every size // 2 rows; a partition of `least` rows or more but fewer than `size` is one window.
    Each row names the windows that hold it, so nothing is joined.
    """
    step = max(size // 2, 1)
    counted = number(df, partition, order, "_rn", "_n").where(F.col("_n") >= least)
    i = F.col("_rn") - 1
    first = F.greatest(F.lit(0), F.ceil((i - (size - 1)) / step))
    last = F.least(F.floor(i / step), F.greatest(F.floor((F.col("_n") - size) / step), F.lit(0)))
    spread = counted.where(last >= first).withColumn("window_no", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    return spread.withColumn("place", (F.col("_rn") - 1 - F.col("window_no") * step).cast("long")).drop("_rn", "_n")


def rank_by(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """Numbers few rows (groups, not records) from 1 by an order."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def first_sign_change(df: DataFrame, partition: list[str], order: list, value: Column) -> DataFrame:
    """The first row of each partition whose sign differs from that of the row before; zero counts as its own sign."""
    w = Window.partitionBy(*partition).orderBy(*order)
    marked = df.withColumn("_sign", F.signum(value)).withColumn("_before", F.lag("_sign").over(w)).withColumn("_rn", F.row_number().over(w))
    changed = marked.where(F.col("_before").isNotNull() & (F.col("_sign") != F.col("_before")))
    keep = [c for c in df.columns if c not in partition]
    return changed.groupBy(*partition).agg(F.min_by(F.struct(*keep), "_rn").alias("_row")).select(*partition, "_row.*")
