"""Small table operators: palettes, ordered distinct values, raster look-ups, colours of names, mask algebra."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import clamp

#: The colour of names without one.
NO_COLOUR = 160


def palette(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column and their places in order, from 0 (nulls are left out)."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().select(column, (F.row_number().over(Window.orderBy(column)) - 1).alias("place"))


def ordered_distinct(df: DataFrame, column: str, order: str) -> DataFrame:
    """The distinct values of a column in the order of their first appearance: value, place (from 1)."""
    first = df.groupBy(column).agg(F.min(order).alias("_first"))
    return first.select(column, F.row_number().over(Window.orderBy("_first", column)).alias("place"))


def value_range(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.min(column).alias("low"), F.max(column).alias("high"))


def at_cells(points: DataFrame, cells: DataFrame, width: int, height: int, columns: Sequence[str], u: str = "u", v: str = "v") -> DataFrame:
    """Points with the columns of the cell they stand in: places are cut off to whole cells, those beyond an edge take the nearest cell."""
    # A place is cut off towards zero before it is clamped.
    key = {"_u": clamp(F.col(u).cast("int"), 0, width - 1), "_v": clamp(F.col(v).cast("int"), 0, height - 1)}
    named = cells.select(F.col("u").cast("int").alias("_u"), F.col("v").cast("int").alias("_v"), *columns)
    return points.withColumns(key).join(named, ["_u", "_v"]).drop("_u", "_v")


def coloured(df: DataFrame, id_column: str, names: DataFrame, colours: DataFrame) -> DataFrame:
    """df with r, g, b: those of the name (names: id, name) of its id (colours: name, r, g, b), or the default gray."""
    known = names.join(colours, "name").select(F.col("id").alias(id_column), *[F.col(c).alias(f"_{c}") for c in "rgb"])
    return df.join(known, id_column, "left").select(*df.columns, *[F.coalesce(f"_{c}", F.lit(NO_COLOUR)).alias(c) for c in "rgb"])


def upside_down(height: int, v: Column) -> Column:
    """The row number counted from the other edge."""
    return F.lit(height - 1) - v


def merged_mask(any_of: Sequence[Column], none_of: Sequence[Column] = ()) -> Column:
    """True where one of the masks is set and none of the others; null masks count as unset."""
    out = F.lit(False)
    for m in any_of:
        out = out | F.coalesce(m, F.lit(False))
    for m in none_of:
        out = out & ~F.coalesce(m, F.lit(False))
    return out


def longest_line(lines: DataFrame, group: str, line: str, size: str) -> DataFrame:
    """The row of each group with the largest size (ties: smallest line)."""
    rest = [c for c in lines.columns if c != group]
    return lines.groupBy(group).agg(F.min_by(F.struct(*rest), F.struct(-F.col(size), F.col(line))).alias("_row")).select(group, "_row.*")
