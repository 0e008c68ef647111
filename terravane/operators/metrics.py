"""Scores of a prediction against truth: confusion, overlap, agreement, boundaries, assignment."""

from __future__ import annotations

from itertools import product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import assign_min_cost


def confusion(df: DataFrame, truth: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("gt"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def confusion_pivot(df: DataFrame, truth: str, pred: str, values: list) -> DataFrame:
    """One column per predicted value, absent pairs as 0."""
    return df.groupBy(F.col(truth).alias("gt")).pivot(pred, values).count().na.fill(0)


def class_scores(counts: DataFrame) -> DataFrame:
    """Per truth class of a confusion table (gt, pred, n): inter, n_gt, n_pred, iou, recall. Classes that only occur in predictions have no row."""
    gt = counts.groupBy("gt").agg(F.sum("n").alias("n_gt"), F.sum(F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(0)).alias("inter"))
    pred = counts.groupBy(F.col("pred").alias("gt")).agg(F.sum("n").alias("n_pred"))
    out = gt.join(pred, "gt", "left").withColumn("n_pred", F.coalesce("n_pred", F.lit(0)).cast("long"))
    return out.select("gt", "inter", "n_gt", "n_pred", (F.col("inter") / (F.col("n_gt") + F.col("n_pred") - F.col("inter"))).alias("iou"), (F.col("inter") / F.col("n_gt")).alias("recall"))


def overall(counts: DataFrame) -> DataFrame:
    """One row: pixel_accuracy, macro_iou (unweighted), n_gt_classes, n_pred_classes."""
    total = counts.agg(
        (F.sum(F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n")).alias("pixel_accuracy"),
        F.count_distinct("gt").alias("n_gt_classes"),
        F.count_distinct("pred").alias("n_pred_classes"),
    )
    return total.join(class_scores(counts).agg(F.avg("iou").alias("macro_iou")))


def agreement(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Share of equal values, in all (gt null) and per truth value: one pass with a rollup."""
    rolled = df.select(F.col(truth).alias("gt"), (F.col(truth) == F.col(pred)).cast("double").alias("eq")).rollup("gt")
    return rolled.agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.avg("eq").alias("agreement"))


def match_labels(counts: DataFrame) -> DataFrame:
    """One-to-one mapping of predicted to truth labels with the largest total overlap; pairs without overlap are dropped. The table has a row per label pair."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        table = pdf.pivot_table(index="pred", columns="gt", values="n", fill_value=0).sort_index()
        rows, cols = assign_min_cost(-table.to_numpy(float))
        out = [(table.index[r], table.columns[c], int(table.iat[r, c])) for r, c in zip(rows, cols, strict=True) if table.iat[r, c] > 0]
        return pd.DataFrame(out, columns=["pred", "gt", "n"])

    return counts.select(F.col("pred").cast("long").alias("pred"), F.col("gt").cast("long").alias("gt"), F.col("n").cast("long").alias("n")).groupBy(F.lit(0).alias("_all")).applyInPandas(lambda pdf: solve(pdf), "pred long, gt long, n long")


def mae(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.avg(F.abs(F.col(a) - F.col(b))).alias("mae"), F.count("*").alias("n"))


def boundary_scores(pred: DataFrame, truth: DataFrame, tolerance: int) -> DataFrame:
    """Precision, recall and F1 of boundary cells (u, v) within a distance of cells.

    Each cell of one side is matched by equality with the integer offsets of the tolerance disc of the other.
    Both empty: all 1; one empty: all 0.
    """
    disc = [(a, b) for a, b in product(range(-tolerance, tolerance + 1), repeat=2) if a * a + b * b <= tolerance * tolerance]

    def hits(of: DataFrame, by: DataFrame, name: str) -> DataFrame:
        spread = by.select(F.explode(F.array(*[F.struct((F.col("u") + a).alias("u"), (F.col("v") + b).alias("v")) for a, b in disc])).alias("c")).select("c.u", "c.v").distinct().withColumn("_hit", F.lit(1))
        return of.join(spread, ["u", "v"], "left").agg(F.count("*").alias(f"n_{name}"), F.coalesce(F.sum("_hit"), F.lit(0)).alias(f"hit_{name}"))

    both = hits(pred.distinct(), truth, "pred").join(hits(truth.distinct(), pred, "gt"))
    none = (F.col("n_pred") == 0) & (F.col("n_gt") == 0)
    part = lambda k: F.when(none, 1.0).when((F.col("n_pred") == 0) | (F.col("n_gt") == 0), 0.0).otherwise(F.col(f"hit_{k}") / F.col(f"n_{k}"))
    out = both.select("n_pred", "n_gt", part("pred").alias("precision"), part("gt").alias("recall"))
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.when(p + r > 0, 2 * p * r / F.when(p + r > 0, p + r)).otherwise(0.0))
