"""Evaluation of many cases at once: label rasters, height fields and voxel models against truth.

Every table has a `case_id`; one job gives the metrics of all cases, a row each. A case's assignment of
predicted to true labels works on its label pairs only, never on its cells.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import assign_min_cost
from .raster import boundary_both, dilate, offsets
from .sequences import with_arc_length
from .spatial import nearest_distances

#: A predicted label without a partner; no true label has it.
UNMATCHED = -999


def counted(cells: DataFrame, ignore: str | None = None) -> DataFrame:
    """Cells that take part in the statistics: all, or those whose ignore flag is not set."""
    return cells if ignore is None else cells.where(~F.coalesce(F.col(ignore), F.lit(False)))


def label_pairs(cells: DataFrame, by: Sequence[str] = ("case_id",)) -> DataFrame:
    """by, gt, pred, n: the confusion counts of each case."""
    return cells.groupBy(*by, F.col("gt").cast("long").alias("gt"), F.col("pred").cast("long").alias("pred")).agg(F.count("*").alias("n"))


def matched(pairs: DataFrame, by: Sequence[str] = ("case_id",)) -> DataFrame:
    """by, pred, gt: the one-to-one mapping of largest overlap in each case; pairs without overlap are dropped."""
    kinds = dict(pairs.dtypes)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        table = pdf.pivot_table(index="pred", columns="gt", values="n", fill_value=0).sort_index()
        found = [(table.index[r], table.columns[c]) for r, c in zip(*assign_min_cost(-table.to_numpy(float)), strict=True) if table.iat[r, c] > 0]
        out = pd.DataFrame(found, columns=["pred", "gt"])
        for i, name in enumerate(by):
            out.insert(i, name, pdf[name].iat[0])
        return out

    return pairs.groupBy(*by).applyInPandas(lambda pdf: solve(pdf), ", ".join(f"{c} {kinds[c]}" for c in by) + ", pred long, gt long")


def remapped(cells: DataFrame, mapping: DataFrame, by: Sequence[str] = ("case_id",)) -> DataFrame:
    """Predicted labels in the terms of the truth; those without a partner become UNMATCHED."""
    names = mapping.select(*by, "pred", F.col("gt").alias("_to"))
    return cells.join(names, [*by, "pred"], "left").withColumn("pred", F.coalesce("_to", F.lit(UNMATCHED)).cast("long")).drop("_to")


def class_overlap(pairs: DataFrame, by: Sequence[str] = ("case_id",)) -> DataFrame:
    """by, gt, iou, recall of every true class, from the counts of remapped pairs."""
    same = F.sum(F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(0))
    truth = pairs.groupBy(*by, "gt").agg(F.sum("n").alias("n_gt"), same.alias("inter"))
    guess = pairs.groupBy(*by, F.col("pred").alias("gt")).agg(F.sum("n").alias("n_pred"))
    both = truth.join(guess, [*by, "gt"], "left").withColumn("n_pred", F.coalesce("n_pred", F.lit(0)))
    return both.select(*by, "gt", (F.col("inter") / (F.col("n_gt") + F.col("n_pred") - F.col("inter"))).alias("iou"), (F.col("inter") / F.col("n_gt")).alias("recall"))


def boundary_overlap(cells: DataFrame, tolerance: int, ignore: str | None = None, by: Sequence[str] = ("case_id",)) -> DataFrame:
    """by, boundary_precision, boundary_recall, boundary_f1: boundary cells of one side within a distance of the other's. Both empty: 1; one empty: 0."""
    edges = {k: counted(boundary_both(cells, k, by).join(cells.select(*by, "u", "v", *([ignore] if ignore else [])), [*by, "u", "v"]), ignore).select(*by, "u", "v") for k in ("gt", "pred")}
    disc = offsets("disc", tolerance)

    def hits(one: str, other: str) -> DataFrame:
        near = dilate(edges[other], disc, by).withColumn("_hit", F.lit(1))
        return edges[one].join(near, [*by, "u", "v"], "left").groupBy(*by).agg(F.count("*").alias(f"n_{one}"), F.sum(F.coalesce("_hit", F.lit(0))).alias(f"hit_{one}"))

    out = cells.select(*by).distinct().join(hits("pred", "gt"), list(by), "left").join(hits("gt", "pred"), list(by), "left").na.fill(0, ["n_pred", "n_gt", "hit_pred", "hit_gt"])
    none = (F.col("n_pred") == 0) & (F.col("n_gt") == 0)
    part = lambda k: F.when(none, 1.0).when((F.col("n_pred") == 0) | (F.col("n_gt") == 0), 0.0).otherwise(F.col(f"hit_{k}") / F.col(f"n_{k}"))
    out = out.select(*by, part("pred").alias("boundary_precision"), part("gt").alias("boundary_recall"))
    p, r = F.col("boundary_precision"), F.col("boundary_recall")
    return out.withColumn("boundary_f1", F.when(p + r > 0, 2 * p * r / F.when(p + r > 0, p + r)).otherwise(0.0))


def segmentation_metrics(cells: DataFrame, tolerance: int = 3, ignore: str | None = None, by: Sequence[str] = ("case_id",)) -> DataFrame:
    """A row a case: pixel_accuracy, macro_iou, boundary scores, n_units_gt and n_units_pred of cells (case_id, u, v, gt, pred)."""
    used = counted(cells, ignore)
    pairs = label_pairs(used, by)
    mapping = matched(pairs, by)
    named = remapped(pairs, mapping, by).groupBy(*by, "gt", "pred").agg(F.sum("n").alias("n"))
    total = named.groupBy(*by).agg((F.sum(F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n")).alias("pixel_accuracy"))
    units = pairs.groupBy(*by).agg(F.count_distinct("gt").alias("n_units_gt"), F.count_distinct("pred").alias("n_units_pred"))
    macro = class_overlap(named, by).groupBy(*by).agg(F.avg("iou").alias("macro_iou"))
    edges = boundary_overlap(remapped(cells, mapping, by), tolerance, ignore, by)
    return total.join(macro, list(by)).join(units, list(by)).join(edges, list(by))


def voxel_metrics(voxels: DataFrame, by: Sequence[str] = ("case_id",)) -> DataFrame:
    """A row a case of voxels (case_id, gt, pred, below, basement: name of the oldest unit): agreement below ground, its mean over units, that without the basement, and the basement's share."""
    below = voxels.where("below").withColumn("_same", (F.col("gt") == F.col("pred")).cast("double"))
    per_unit = below.groupBy(*by, "gt", "basement").agg(F.avg("_same").alias("share"), F.sum("_same").alias("same"), F.count("*").alias("n"))
    other = F.col("gt") != F.col("basement")
    return per_unit.groupBy(*by).agg(
        (F.sum("same") / F.sum("n")).alias("agreement"), F.avg("share").alias("macro_agreement"),
        (F.sum(F.when(other, F.col("same"))) / F.sum(F.when(other, F.col("n")))).alias("agreement_excl_basement"),
        (F.sum(F.when(~other, F.col("n")).otherwise(0)) / F.sum("n")).alias("basement_share"),
    )


def evaluate_cases(cases: DataFrame, cells: DataFrame, heights: DataFrame | None = None, voxels: DataFrame | None = None, tolerance: int = 3, ignore: str | None = None) -> DataFrame:
    """One row for every case, with all its metrics and a status: 'ok', or 'FAILED' for a case without cells (its metrics are null).

    heights: case_id, gt, pred; voxels: as voxel_metrics() takes them. Missing parts give null metrics.
    """
    out = cases.select("case_id").distinct().join(segmentation_metrics(cells, tolerance, ignore), "case_id", "left")
    if heights is not None:
        out = out.join(heights.groupBy("case_id").agg(F.avg(F.abs(F.col("pred") - F.col("gt"))).alias("dem_mae")), "case_id", "left")
    if voxels is not None:
        out = out.join(voxel_metrics(voxels), "case_id", "left")
    return out.withColumn("status", F.when(F.col("pixel_accuracy").isNull(), "FAILED").otherwise("ok"))


def fault_hits(lines: DataFrame, truth: DataFrame, most: float = 15.0, shortest: float = 300.0, by: Sequence[str] = ("case_id",)) -> DataFrame:
    """by, fault_hit: whether a case has a line (line, seq, x, y) of at least `shortest` whose points are on average within `most` of the truth's points (x, y)."""
    points = lines.select(*by, F.struct("line", "seq").alias("id"), "x", "y")
    near = nearest_distances(points, truth.select(*by, "x", "y"), 2.0 * most, by)
    mean = near.groupBy(*by, F.col("id.line").alias("line")).agg(F.avg("dist").alias("mean_dist"))
    long = with_arc_length(lines, [*by, "line"], ["seq"], "x", "y", "s").groupBy(*by, "line").agg(F.max("s").alias("length"))
    hit = mean.join(long, [*by, "line"]).groupBy(*by).agg(F.max((F.col("mean_dist") < most) & (F.col("length") >= shortest)).alias("_hit"))
    return lines.select(*by).unionByName(truth.select(*by)).distinct().join(hit, list(by), "left").select(*by, F.coalesce("_hit", F.lit(False)).alias("fault_hit"))


def metric_rows(metrics: DataFrame, by: Sequence[str] = ("case_id",)) -> DataFrame:
    """by, metric, value: a long table of the numeric columns, for reports."""
    names = [c for c, t in metrics.dtypes if c not in by and t in ("double", "float", "int", "bigint")]
    return metrics.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names])).alias("m")).select(*by, "m.*").where("value is not null")
