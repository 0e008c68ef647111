"""Joins, scores, merges, set operations, ranking and kernels on the driver tables, and their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import constraints, graph, kernels, metrics, review, sequences, spatial
from .tables import PATHS_SQL, exact_sum, paths, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---- lookups


@query("""
SELECT n.n_nationkey, n.n_name, coalesce(CASE WHEN r.r_regionkey <> 2 THEN r.r_name END, 'Unknown') AS region FROM nation n LEFT JOIN region r ON n.n_regionkey = r.r_regionkey""")
def dim_lookup_default(spark, sf_dir):
    regions = table(spark, sf_dir, "region").where("r_regionkey <> 2").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return table(spark, sf_dir, "nation").join(F.broadcast(regions), "n_regionkey", "left").select("n_nationkey", "n_name", F.coalesce("r_name", F.lit("Unknown")).alias("region"))


@query("SELECT count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def semi_known(spark, sf_dir):
    keys = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return review.known(table(spark, sf_dir, "orders"), keys, "o_orderkey").agg(F.count("*").alias("n"), exact_sum("o_totalprice").alias("total"))


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_unknown(spark, sf_dir):
    keys = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return review.unknown(table(spark, sf_dir, "orders"), keys, "o_orderkey").select("o_orderkey", "o_custkey")


@query("""
WITH e AS (SELECT c_custkey, CASE WHEN c_custkey % 14 = 0 THEN NULL ELSE 'REVIEWED' END AS seg, c_acctbal + 1 AS bal FROM customer WHERE c_custkey % 7 = 0)
SELECT c.c_custkey, coalesce(e.seg, c.c_mktsegment) AS c_mktsegment, coalesce(e.bal, c.c_acctbal) AS c_acctbal FROM customer c LEFT JOIN e USING (c_custkey)""")
def review_merge(spark, sf_dir):
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    edits = base.where("c_custkey % 7 = 0").select("c_custkey", F.when(F.col("c_custkey") % 14 != 0, "REVIEWED").alias("c_mktsegment"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return review.merge_edits(base, edits, "c_custkey")


@query("""
WITH b AS (SELECT n_name AS name, CAST(n_nationkey AS BIGINT) AS unit_id FROM nation WHERE n_nationkey % 3 <> 0)
SELECT name, unit_id FROM b UNION ALL SELECT name, CAST(-99 - row_number() OVER (ORDER BY name) AS BIGINT) FROM (SELECT n_name AS name FROM nation WHERE n_nationkey % 3 = 0)""")
def append_missing_units(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    base = nation.where("n_nationkey % 3 <> 0").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("bigint").alias("unit_id"))
    return review.append_missing(base, nation.select(F.col("n_name").alias("name")), "name", "unit_id").select("name", "unit_id")


RANKED_SQL = "SELECT n_regionkey AS series, n_name AS name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS ord FROM nation"


def _ranked(spark, sf_dir):
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    return table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("series"), F.col("n_name").alias("name"), F.row_number().over(w).alias("ord"))


@query(f"WITH r AS ({RANKED_SQL}) SELECT a.series, a.ord, a.name, b.name AS upper_name FROM r a JOIN r b ON a.series = b.series AND a.ord = b.ord + 1")
def upper_neighbour(spark, sf_dir):
    return review.upper_neighbour(_ranked(spark, sf_dir), "series", "ord", ["name"]).select("series", "ord", "name", "upper_name")


@query(f"WITH r AS ({RANKED_SQL}) SELECT series, string_agg(name, ',' ORDER BY ord) AS members FROM r GROUP BY series")
def ordered_list_per_group(spark, sf_dir):
    return review.ordered_list(_ranked(spark, sf_dir), "series", "ord", "name")


@query(f"WITH r AS ({RANKED_SQL}) SELECT series, arg_max(name, ord) AS oldest, arg_min(name, ord) AS youngest, count(*) AS n FROM r GROUP BY series")
def oldest_youngest(spark, sf_dir):
    return _ranked(spark, sf_dir).groupBy("series").agg(F.max_by("name", "ord").alias("oldest"), F.min_by("name", "ord").alias("youngest"), F.count("*").alias("n"))


@query(f"""
WITH r AS ({RANKED_SQL}), u AS (SELECT CAST(row_number() OVER (ORDER BY series, ord) AS BIGINT) AS unit_id, name, series, row_number() OVER (ORDER BY series, ord) - 1 AS ord FROM r),
c AS (SELECT k AS contact_id, k % 27 AS unit_a, (k * 7 + 3) % 27 AS unit_b FROM range(300) t(k)), o AS (SELECT series, arg_max(name, ord) AS oldest FROM u GROUP BY series),
j AS (SELECT contact_id, a.name AS na, b.name AS nb, a.series AS sa, b.series AS sb, a.ord AS oa, b.ord AS ob FROM c JOIN u a ON a.unit_id = unit_a JOIN u b ON b.unit_id = unit_b WHERE a.ord <> b.ord)
SELECT contact_id, CASE WHEN sa = sb AND abs(oa - ob) = 1 THEN 'conformable' WHEN sa = sb THEN 'suspect' ELSE 'unconformable' END AS kind,
 CASE WHEN sa = sb AND abs(oa - ob) = 1 THEN CASE WHEN oa < ob THEN na ELSE nb END WHEN sa = sb THEN NULL ELSE o.oldest END AS formation
FROM j JOIN o ON o.series = CASE WHEN oa < ob THEN sa ELSE sb END""")
def contact_formation(spark, sf_dir):
    order = F.row_number().over(Window.orderBy("series", "ord"))
    units = _ranked(spark, sf_dir).select(order.cast("bigint").alias("unit_id"), "name", "series", (order - 1).alias("order"))
    k = F.col("id")
    contacts = spark.range(300).select(k.alias("contact_id"), (k % 27).alias("unit_a"), ((k * 7 + 3) % 27).alias("unit_b"))
    return constraints.contact_formation(contacts, units)


@query("""
WITH a AS (SELECT l_returnflag AS f, l_linenumber AS n FROM lineitem), s AS (SELECT DISTINCT l_returnflag AS f FROM lineitem WHERE l_linestatus = 'O')
SELECT 'points' AS side, count(*) AS n FROM a WHERE f IN (SELECT f FROM s) UNION ALL SELECT 'orientations', count(*) FROM a WHERE n = 1 AND f IN (SELECT f FROM s)""")
def referential_filter(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("formation"), "l_linenumber", "l_linestatus")
    points, orientations = constraints.referential(lines, lines.where("l_linenumber = 1"), lines.where("l_linestatus = 'O'"))
    count = lambda df, side: df.agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")
    return count(points, "points").unionByName(count(orientations, "orientations"))


@query("""
WITH d AS (SELECT l_orderkey, l_linenumber, count(*) AS c FROM lineitem GROUP BY ALL HAVING count(*) > 1)
SELECT 'duplicate key' AS problem, count(*) AS n, CAST(sum(c) AS BIGINT) AS n_rows FROM d HAVING count(*) > 0""")
def validate_units(spark, sf_dir):
    return review.violations(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_shipdate"])


@query("SELECT l_orderkey, CAST(min(l_linenumber) AS INTEGER) AS lo, CAST(max(l_linenumber) AS INTEGER) AS hi, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY l_orderkey HAVING max(l_linenumber) - min(l_linenumber) + 1 <> count(DISTINCT l_linenumber)")
def order_gaps(spark, sf_dir):
    return review.contiguous(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


# ---- set operations


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("SELECT DISTINCT l_partkey AS k FROM lineitem EXCEPT SELECT p_partkey FROM part WHERE p_size > 10")
def set_except(spark, sf_dir):
    used = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"))
    return used.subtract(table(spark, sf_dir, "part").where("p_size > 10").select("p_partkey"))


@query("SELECT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT s_suppkey FROM supplier WHERE s_acctbal > 0")
def set_intersect(spark, sf_dir):
    used = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("k"))
    return used.intersect(table(spark, sf_dir, "supplier").where("s_acctbal > 0").select("s_suppkey"))


# ---- scores


@query("SELECT quality AS gt, toxic AS pred, count(*) AS n FROM labels GROUP BY ALL")
def confusion_labels(spark, sf_dir):
    return metrics.confusion(table(spark, sf_dir, "labels"), "quality", "toxic")


@query('SELECT quality AS gt, count(*) FILTER (WHERE toxic = 0) AS "0", count(*) FILTER (WHERE toxic = 1) AS "1" FROM labels GROUP BY quality')
def confusion_pivot(spark, sf_dir):
    return metrics.confusion_pivot(table(spark, sf_dir, "labels"), "quality", "toxic", [0, 1])


@query("""
SELECT quality AS gt, CAST(grouping(quality) AS BIGINT) AS level, count(*) AS n, round(avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS agreement FROM labels GROUP BY ROLLUP (quality)""")
def agreement_overall_per_value(spark, sf_dir):
    return metrics.agreement(table(spark, sf_dir, "labels"), "quality", "toxic").select("gt", "level", "n", F.round("agreement", 6).alias("agreement"))


CLASS_SQL = """
WITH c AS (SELECT quality AS gt, toxic AS pred, count(*) AS n FROM labels GROUP BY ALL), g AS (SELECT gt, CAST(sum(n) AS BIGINT) AS n_gt, CAST(sum(CASE WHEN gt = pred THEN n ELSE 0 END) AS BIGINT) AS inter FROM c GROUP BY gt),
p AS (SELECT pred AS gt, CAST(sum(n) AS BIGINT) AS n_pred FROM c GROUP BY pred), s AS (SELECT gt, inter, n_gt, coalesce(n_pred, 0) AS n_pred FROM g LEFT JOIN p USING (gt))
"""


@query(CLASS_SQL + "SELECT gt, inter, n_gt, n_pred, round(inter / (n_gt + n_pred - inter)::DOUBLE, 6) AS iou FROM s")
def iou_per_class(spark, sf_dir):
    return metrics.class_scores(metrics.confusion(table(spark, sf_dir, "labels"), "quality", "toxic")).select("gt", "inter", "n_gt", "n_pred", F.round("iou", 6).alias("iou"))


@query(CLASS_SQL + "SELECT gt, round(inter / n_gt::DOUBLE, 6) AS recall FROM s")
def recall_per_class(spark, sf_dir):
    return metrics.class_scores(metrics.confusion(table(spark, sf_dir, "labels"), "quality", "toxic")).select("gt", F.round("recall", 6).alias("recall"))


def _overall(spark, sf_dir):
    return metrics.overall(metrics.confusion(table(spark, sf_dir, "labels"), "quality", "toxic"))


@query(CLASS_SQL + "SELECT round(avg(inter / (n_gt + n_pred - inter)::DOUBLE), 6) AS macro_iou FROM s")
def macro_iou(spark, sf_dir):
    return _overall(spark, sf_dir).select(F.round("macro_iou", 6).alias("macro_iou"))


@query("SELECT round(avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS pixel_accuracy, count(DISTINCT quality) AS n_gt_classes, count(DISTINCT toxic) AS n_pred_classes FROM labels")
def pixel_accuracy(spark, sf_dir):
    return _overall(spark, sf_dir).select(F.round("pixel_accuracy", 6).alias("pixel_accuracy"), "n_gt_classes", "n_pred_classes")


@query("SELECT round(avg(abs(l_extendedprice - l_quantity * 1500.0)), 4) AS mae, count(*) AS n FROM lineitem")
def mae_value(spark, sf_dir):
    priced = table(spark, sf_dir, "lineitem").select("l_extendedprice", (F.col("l_quantity") * 1500.0).alias("guess"))
    return metrics.mae(priced, "l_extendedprice", "guess").select(F.round("mae", 4).alias("mae"), "n")


@query("""
WITH c AS (SELECT (c_custkey % 4) + 10 AS gt, CASE WHEN c_custkey % 50 = 0 THEN 9 ELSE CAST(((c_custkey % 4) * 3 + 1) % 4 AS INTEGER) END AS pred, count(*) AS n FROM customer GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY pred ORDER BY n DESC) AS k FROM c WHERE pred <> 9)
SELECT CAST(pred AS BIGINT) AS pred, CAST(gt AS BIGINT) AS gt, n FROM r WHERE k = 1""")
def hungarian_match(spark, sf_dir):
    key = F.col("c_custkey") % 4
    pairs = table(spark, sf_dir, "customer").select((key + 10).alias("gt"), F.when(F.col("c_custkey") % 50 == 0, 9).otherwise((key * 3 + 1) % 4).alias("pred"))
    return metrics.match_labels(metrics.confusion(pairs, "gt", "pred"))


# ---- distances


@query("""
SELECT a.p_partkey AS a, b.p_partkey AS b, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 4) AS dist
FROM (SELECT p_partkey, p_size * 10.0 AS x, p_retailprice AS y FROM part) a JOIN (SELECT p_partkey, p_size * 10.0 AS x, p_retailprice AS y FROM part) b ON a.p_partkey < b.p_partkey
WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 4.0""")
def range_pairs(spark, sf_dir):
    points = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 10.0).alias("x"), F.col("p_retailprice").alias("y"))
    return spatial.pairs_within(points, 2.0, "p_partkey").select("a", "b", F.round("dist", 4).alias("dist"))


@query("""
WITH s AS (SELECT s_suppkey, s_acctbal AS x, s_nationkey * 10.0 AS y FROM supplier), c AS (SELECT c_custkey, c_acctbal AS x, c_nationkey * 10.0 AS y FROM customer),
p AS (SELECT c_custkey, s_suppkey, (c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y) AS d2 FROM c, s), r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY d2, s_suppkey) AS k FROM p WHERE d2 <= 2500.0)
SELECT c_custkey, s_suppkey, round(sqrt(d2), 4) AS dist FROM r WHERE k = 1""")
def nearest_within_radius(spark, sf_dir):
    left = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("x"), (F.col("c_nationkey") * 10.0).alias("y"))
    right = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("x"), (F.col("s_nationkey") * 10.0).alias("y"))
    return spatial.nearest_within(left, right, 50.0, "c_custkey", "s_suppkey").select("c_custkey", "s_suppkey", F.round("dist", 4).alias("dist"))


@query("""
WITH e AS (SELECT vec_id, label, embedding FROM embeddings), d AS (SELECT a.vec_id, b.vec_id AS neighbour, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))), 9) AS d2 FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id),
r AS (SELECT vec_id, neighbour, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY d2, neighbour) AS INTEGER) AS rank, round(d2, 6) AS dist2 FROM d)
SELECT vec_id, neighbour, rank, dist2 FROM r WHERE rank <= 14""")
def knn_embeddings(spark, sf_dir):
    return spatial.knn(table(spark, sf_dir, "embeddings"), 14, "vec_id", "embedding", "label").select("vec_id", "neighbour", "rank", F.round("dist2", 6).alias("dist2"))


@query("SELECT label, count(*) AS n, round(avg(embedding[1]::DOUBLE), 6) AS m1, round(avg(embedding[2]::DOUBLE), 6) AS m2 FROM embeddings GROUP BY label")
def center_means(spark, sf_dir):
    at = lambda i: F.round(F.avg(F.element_at("embedding", i).cast("double")), 6).alias(f"m{i}")
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), at(1), at(2))


@query("""
WITH e AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), c AS (SELECT label, avg(x) AS x, avg(y) AS y FROM e GROUP BY label),
r AS (SELECT vec_id, c.label, sqrt((e.x - c.x) * (e.x - c.x) + (e.y - c.y) * (e.y - c.y)) AS d, row_number() OVER (PARTITION BY vec_id ORDER BY sqrt((e.x - c.x) * (e.x - c.x) + (e.y - c.y) * (e.y - c.y)), c.label) AS k FROM e, c)
SELECT vec_id, label, round(d, 5) AS dist FROM r WHERE k = 1""")
def nearest_center(spark, sf_dir):
    at = lambda i: F.element_at("embedding", i).cast("double")
    points = table(spark, sf_dir, "embeddings").select("vec_id", "label", at(1).alias("x"), at(2).alias("y"))
    centres = points.groupBy("label").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return spatial.nearest_centre(points, centres, "vec_id", "label", ["x", "y"]).select("vec_id", "label", F.round("dist", 5).alias("dist"))


@query("""
WITH p AS (SELECT p_partkey, p_size::DOUBLE AS a, p_retailprice / 30.0 AS b FROM part), c(id, a, b) AS (VALUES (1, 10.0, 35.0), (2, 25.0, 45.0), (3, 40.0, 55.0)),
r AS (SELECT p_partkey, id, sqrt((p.a - c.a) * (p.a - c.a) + (p.b - c.b) * (p.b - c.b)) AS d FROM p, c), k AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY d, id) AS k FROM r)
SELECT p_partkey, id, round(d, 4) AS dist FROM k WHERE k = 1 AND d <= 15.0""")
def color_cross_argmin(spark, sf_dir):
    points = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), (F.col("p_retailprice") / 30.0).alias("b"))
    centres = spark.createDataFrame([(1, 10.0, 35.0), (2, 25.0, 45.0), (3, 40.0, 55.0)], "id int, a double, b double")
    return spatial.nearest_centre(points, centres, "p_partkey", "id", ["a", "b"], 15.0).select("p_partkey", "id", F.round("dist", 4).alias("dist"))


LINES_SQL = """
s AS (SELECT s_nationkey AS line, s_suppkey AS seq, s_acctbal / 100.0 AS x, (s_suppkey % 100)::DOUBLE AS y FROM supplier),
t AS (SELECT n_nationkey AS label, n_nationkey * 4.0 + k AS x, k * 25.0 AS y FROM nation, range(4) r(k))
"""


@query("WITH " + LINES_SQL + """, d AS (SELECT line, seq, label, min(sqrt((s.x - t.x) * (s.x - t.x) + (s.y - t.y) * (s.y - t.y))) AS d FROM s, t GROUP BY ALL), m AS (SELECT line, label, avg(d) AS mean_dist FROM d GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY mean_dist, label) AS k FROM m) SELECT line, label, round(mean_dist, 4) AS mean_dist FROM r WHERE k = 1 AND mean_dist < 40.0""")
def mean_nearest_assign(spark, sf_dir):
    samples = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("line"), F.col("s_suppkey").alias("seq"), (F.col("s_acctbal") / 100.0).alias("x"), (F.col("s_suppkey") % 100).cast("double").alias("y"))
    truth = table(spark, sf_dir, "nation").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3)))).select(F.col("n_nationkey").alias("label"), (F.col("n_nationkey") * 4.0 + F.col("k")).alias("x"), (F.col("k") * 25.0).alias("y"))
    return spatial.mean_nearest(samples, truth, 40.0).select("line", "label", F.round("mean_dist", 4).alias("mean_dist"))


@query("""
WITH p AS (SELECT s_suppkey AS id, s_suppkey AS seq, (s_suppkey * 37 % 2000)::DOUBLE AS x, (s_suppkey * 61 % 2000)::DOUBLE AS y, 900.0 - s_suppkey % 300 AS z, row_number() OVER (ORDER BY s_suppkey) AS rn FROM supplier),
o AS (SELECT n_nationkey AS ori_id, (n_nationkey * 83 % 2000)::DOUBLE AS x, (n_nationkey * 71 % 2000)::DOUBLE AS y, radians(n_nationkey * 14.0) AS az, radians(20.0 + n_nationkey) AS dip FROM nation),
n AS (SELECT p.*, o.az, o.dip, row_number() OVER (PARTITION BY p.id ORDER BY (p.x - o.x) * (p.x - o.x) + (p.y - o.y) * (p.y - o.y), o.ori_id) AS k, (p.x - o.x) * (p.x - o.x) + (p.y - o.y) * (p.y - o.y) AS d2 FROM p, o WHERE (rn - 1) % 3 = 0),
q AS (SELECT id, len, x + sin(az) * cos(dip) * len AS x, y + cos(az) * cos(dip) * len AS y, z - sin(dip) * len AS z FROM n, (VALUES (150.0::DOUBLE), (400.0::DOUBLE)) l(len) WHERE k = 1 AND d2 <= 650.0 * 650.0)
SELECT id, len, round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z FROM q WHERE x > 0 AND x < 2000 AND y > 0 AND y < 2000 AND z >= 40""")
def downdip_projection(spark, sf_dir):
    k, m = F.col("s_suppkey"), F.col("n_nationkey")
    points = table(spark, sf_dir, "supplier").select(k.alias("id"), k.alias("seq"), (k * 37 % 2000).cast("double").alias("x"), (k * 61 % 2000).cast("double").alias("y"), (F.lit(900.0) - k % 300).alias("z"), F.lit("F").alias("formation"))
    poses = table(spark, sf_dir, "nation").select(m.alias("ori_id"), (m * 83 % 2000).cast("double").alias("x"), (m * 71 % 2000).cast("double").alias("y"), (m * 14.0).alias("azimuth"), (m + 20.0).alias("dip"))
    out = constraints.downdip_projection(points, poses, [150.0, 400.0], 650.0, (0.0, 2000.0, 0.0, 2000.0), 40.0)
    return out.select("id", "len", *[F.round(c, 3).alias(c) for c in "xyz"])


# ---- ranking and samples


@query("SELECT p_brand, n, CAST(row_number() OVER (ORDER BY n DESC, p_brand) AS INTEGER) AS rank FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand)")
def renumber_by_size(spark, sf_dir):
    sized = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    return sequences.rank_by(sized, [F.desc("n"), "p_brand"])


@query("SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders) WHERE rank <= 3")
def top_k_per_group(spark, sf_dir):
    return sequences.number(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], "rank").where("rank <= 3").select("o_custkey", "o_orderkey", "rank")


@query("SELECT event_id, user_id FROM events WHERE (event_id * 2654435761 + 12345) % 4294967296 < 429496730")
def hash_sample(spark, sf_dir):
    return table(spark, sf_dir, "events").where("(event_id * 2654435761 + 12345) % 4294967296 < 429496730").select("event_id", "user_id")


@query("SELECT (SELECT count(*) FROM customer) AS n_points, (SELECT count(*) FROM supplier) AS n_orientations, (SELECT count(DISTINCT c_nationkey) FROM customer) AS n_formations, (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS n_suspect")
def summary_counts(spark, sf_dir):
    one = table(spark, sf_dir, "customer").agg(F.count("*").alias("n_points"), F.count_distinct("c_nationkey").alias("n_formations"), F.count_if(F.col("c_acctbal") < 0).alias("n_suspect"))
    return one.join(table(spark, sf_dir, "supplier").agg(F.count("*").alias("n_orientations"))).select("n_points", "n_orientations", "n_formations", "n_suspect")


@query("SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS INTEGER), -1) AS k, coalesce(json_extract_string(props, '$.absent'), 'none') AS absent FROM events")
def fill_default(spark, sf_dir):
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(k, F.lit(-1)).alias("k"), F.coalesce(F.get_json_object("props", "$.absent"), F.lit("none")).alias("absent"))


@query("""
SELECT n_regionkey, count(*) AS n, round(avg(n_nationkey), 1)::DOUBLE AS mean, count(*) >= 5 AS enough FROM nation GROUP BY n_regionkey""")
def minimum_count(spark, sf_dir):
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n"), F.round(F.avg("n_nationkey"), 1).alias("mean"), (F.count("*") >= 5).alias("enough"))


# ---- kernels


def kmeans_merge(spark, sf_dir):
    """Over-clustering, then linkage of the few centres; each vector's merged cluster."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=22, seed=42, maxIter=20).fit(rows)
    merged = kernels.average_linkage(np.array(model.clusterCenters()), 0.6)
    names = spark.createDataFrame([(i, int(m)) for i, m in enumerate(merged)], "prediction int, cluster int")
    return model.transform(rows).join(F.broadcast(names), "prediction").groupBy("cluster").agg(F.count("*").alias("n"))


@query("""
WITH s AS (SELECT c_nationkey, c_custkey, (c_custkey * 37 % 2000)::DOUBLE AS x, (c_custkey * 61 % 2000)::DOUBLE AS y, c_acctbal AS score FROM customer),
a AS (SELECT *, 1 AS rank FROM s QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY score DESC, c_custkey) = 1),
b AS (SELECT s.*, 2 AS rank FROM s JOIN a USING (c_nationkey) WHERE sqrt((s.x - a.x) * (s.x - a.x) + (s.y - a.y) * (s.y - a.y)) > 250 QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY s.score DESC, s.c_custkey) = 1),
c AS (SELECT s.*, 3 AS rank FROM s JOIN a USING (c_nationkey) JOIN b USING (c_nationkey) WHERE sqrt((s.x - a.x) * (s.x - a.x) + (s.y - a.y) * (s.y - a.y)) > 250 AND sqrt((s.x - b.x) * (s.x - b.x) + (s.y - b.y) * (s.y - b.y)) > 250
 QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY s.score DESC, s.c_custkey) = 1)
SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c""")
def nms_topk(spark, sf_dir):
    scored = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", (F.col("c_custkey") * 37 % 2000).cast("double").alias("x"), (F.col("c_custkey") * 61 % 2000).cast("double").alias("y"), F.col("c_acctbal").alias("score"))
    return constraints.spaced_best(scored, "c_nationkey", 3, 250.0, "c_custkey")


def _reached(edges: str, rounds: int) -> str:
    """The least node that each node reaches in so many steps, which is its component in a graph of no larger diameter."""
    steps = "".join(
        f", l{k} AS (SELECT o.node, least(o.c, min(n.c)) AS c FROM l{k - 1} o JOIN e ON e.a = o.node JOIN l{k - 1} n ON n.node = e.b GROUP BY o.node, o.c)" for k in range(1, rounds + 1)
    )
    return f"WITH p AS ({edges}), e AS (SELECT u AS a, v AS b FROM p UNION SELECT v, u FROM p), l0 AS (SELECT DISTINCT a AS node, a AS c FROM e){steps} SELECT node, c AS component FROM l{rounds}"


@query(_reached("SELECT o_custkey + 10000000 AS u, o_orderkey % 977 AS v FROM orders", 24))
def components(spark, sf_dir):
    return graph.components(table(spark, sf_dir, "orders").select((F.col("o_custkey") + 10_000_000).alias("u"), (F.col("o_orderkey") % 977).alias("v")))


@query("""
WITH i AS (SELECT min(p_partkey) AS a, max(p_partkey) + 1 AS b FROM (SELECT p_partkey, p_partkey - row_number() OVER (ORDER BY p_partkey) AS g FROM (SELECT DISTINCT p_partkey FROM part)) GROUP BY g)
SELECT a AS chain, k AS seq, a + k AS node, false AS closed FROM (SELECT a, unnest(range(b - a + 1)) AS k FROM i)""")
def chains(spark, sf_dir):
    edges = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("u"), (F.col("p_partkey") + 1).alias("v"))
    return graph.chains(edges)


#: The stretches of all paths, split at their farthest vertices by recursion.
@query(f"""
WITH RECURSIVE p AS ({PATHS_SQL}),
s(user_id, a, b) AS (SELECT user_id, min(seq), max(seq) FROM p GROUP BY user_id
 UNION ALL SELECT user_id, unnest([a, f.seq]), unnest([f.seq, b]) FROM (
  SELECT s.user_id, s.a, s.b, min(struct_pack(d := -CASE WHEN y.x <> x.x OR y.y <> x.y THEN abs((y.x - x.x) * (p.y - x.y) - (y.y - x.y) * (p.x - x.x)) / sqrt((y.x - x.x) * (y.x - x.x) + (y.y - x.y) * (y.y - x.y)) ELSE sqrt((p.x - x.x) * (p.x - x.x) + (p.y - x.y) * (p.y - x.y)) END, seq := p.seq)) AS f
  FROM s JOIN p x ON x.user_id = s.user_id AND x.seq = s.a JOIN p y ON y.user_id = s.user_id AND y.seq = s.b JOIN p ON p.user_id = s.user_id AND p.seq > s.a AND p.seq < s.b GROUP BY ALL) WHERE -f.d > 20.0)
SELECT user_id, seq, x, y FROM p WHERE EXISTS (SELECT 1 FROM s WHERE s.user_id = p.user_id AND p.seq IN (s.a, s.b))""")
def simplify_dp(spark, sf_dir):
    return graph.simplify_paths(paths(spark, sf_dir), "user_id", "seq", 20.0)


@query("""
SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM events GROUP BY ALL""")
def stream_daily_window(spark, sf_dir):
    from ..streaming.windows import daily_counts, read_events, run_updates

    out = run_updates(daily_counts(read_events(spark, sf_dir)), ["day", "event_type"])
    return out.select(F.col("day").cast("timestamp_ntz").alias("day"), "event_type", "n", "total")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""")
def stream_sessions(spark, sf_dir):
    from ..streaming.windows import read_events, run_closed, sessions

    out = run_closed(sessions(read_events(spark, sf_dir), "6 hours"))
    return out.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")], "n")


QUERIES |= {f.__name__: f for f in (kmeans_merge,)}

