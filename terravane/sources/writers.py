"""Sinks: Parquet cubes, CSV tables, JSON documents, Markdown summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_cube(voxels: DataFrame, path: str, slab: int = 16) -> None:
    """Voxels by case and slab of k, so that a level slice reads one folder; rows of a file run k, then j, then i."""
    out = voxels if "case_id" in voxels.columns else voxels.withColumn("case_id", F.lit("case"))
    out = out.withColumn("k_slab", F.expr(f"k div {slab}").cast("int"))
    out.repartition("case_id", "k_slab").sortWithinPartitions("case_id", "k_slab", "k", "j", "i").write.mode("overwrite").partitionBy("case_id", "k_slab").parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_documents(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def as_json(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))


def markdown(df: DataFrame, order: str) -> DataFrame:
    """Table rows as Markdown lines, in order, below a header: line_no, line."""
    head = df.sparkSession.createDataFrame([(-2, "| " + " | ".join(df.columns) + " |"), (-1, "|" + " --- |" * len(df.columns))], "line_no long, line string")
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    body = df.select(F.col(order).cast("long").alias("line_no"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    return head.unionByName(body).orderBy("line_no")


def write_extract(labels: DataFrame, units: DataFrame, folder: str, masks: DataFrame | None = None) -> None:
    """The tables of a segmentation: labels (and masks) as Parquet by case, units as CSV with the review columns that are still empty."""
    labels.write.mode("overwrite").partitionBy(*[c for c in ("case_id",) if c in labels.columns]).parquet(f"{folder}/labels")
    if masks is not None:
        masks.write.mode("overwrite").partitionBy(*[c for c in ("case_id",) if c in masks.columns]).parquet(f"{folder}/masks")
    blank = {"order": F.lit(-1), "series": F.lit("Strat_Series"), "dip": F.lit(None).cast("double"), "azimuth": F.lit(None).cast("double")}
    review = units.withColumns({k: v for k, v in blank.items() if k not in units.columns})
    write_table(review, f"{folder}/units_auto")
