"""Queries on map cases, constraints, requests and generators, and their SQL.

The maps are made from the rows of part: four cases of n by n cells, where n is the root of their number; a part's key is its place, and its
size goes into the cell's values.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import GeoRef, SectionFrame, hsv, lab
from ..operators import builder, constraints, contours, evaluate, generate, graph, grid, lookups, raster, requests, segmentation, sequences, spatial
from .tables import BASE, GRID, _sql_rise, asked_voxels, dem_sql, exact_sum, ground_sql, paths, table, unit_sql, voxels_sql

QUERIES, ORACLE = {}, {}
BY = ("case_id",)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _side(spark, sf_dir) -> int:
    return int(table(spark, sf_dir, "part").count() ** 0.5)


def _cells(spark, sf_dir):
    """case_id, u, v, gt, pred, ignore, z, guess and r, g, b of the cases."""
    n = _side(spark, sf_dir)
    c, u, v, place = F.col("case_id"), F.col("u"), F.col("v"), F.col("p_partkey")
    parts = table(spark, sf_dir, "part").where(place < n * n).withColumn("case_id", F.explode(F.sequence(F.lit(0), F.lit(3))))
    placed = parts.select("case_id", (place % n).cast("int").alias("u"), F.expr(f"cast(p_partkey div {n} as int)").alias("v"), F.col("p_size").cast("long").alias("size"))
    gt = (F.floor(u * 5 / n) + c + F.when(v * 2 > n, 2).otherwise(0) + F.when(F.col("size") % 25 == 0, 1).otherwise(0)) % 5
    out = placed.withColumn("gt", gt.cast("long"))
    return out.select(
        "case_id", "u", "v", "gt", F.when((u * 31 + v * 17 + c * 7) % 23 == 0, 9).otherwise((F.col("gt") * 3 + 1) % 5).cast("long").alias("pred"), ((u + v) % 29 == 0).alias("ignore"),
        (100.0 + u * 2.0 + v + (u * v) % 7 + F.col("size") % 3).alias("z"), (100.0 + u * 2.0 + v).alias("guess"),
        ((u * 7 + v * 3) % 256).alias("r"), ((u * 5 + c * 40) % 256).alias("g"), ((v * 9 + 50) % 256).alias("b"),
    )


CELLS = """n AS (SELECT CAST(floor(sqrt(count(*))) AS BIGINT) AS n FROM part),
q AS (SELECT CAST(c AS INTEGER) AS case_id, p_partkey % n AS u, p_partkey // n AS v, n, p_size AS size FROM part, n, range(4) a(c) WHERE p_partkey < n * n),
t AS (SELECT *, CAST((floor(u * 5 / n) + case_id + CASE WHEN v * 2 > n THEN 2 ELSE 0 END + CASE WHEN size % 25 = 0 THEN 1 ELSE 0 END) % 5 AS BIGINT) AS gt FROM q),
c AS (SELECT case_id, CAST(u AS INTEGER) AS u, CAST(v AS INTEGER) AS v, gt, CAST(CASE WHEN (u * 31 + v * 17 + case_id * 7) % 23 = 0 THEN 9 ELSE (gt * 3 + 1) % 5 END AS BIGINT) AS pred, (u + v) % 29 = 0 AS ignore,
 100.0::DOUBLE + u * 2.0 + v + (u * v) % 7 + size % 3 AS z, 100.0::DOUBLE + u * 2.0 + v AS guess, (u * 7 + v * 3) % 256 AS r, (u * 5 + case_id * 40) % 256 AS g, (v * 9 + 50) % 256 AS b FROM t)"""
STEPS = "(VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) s(a, b)"


# ---- evaluation


@query("WITH " + CELLS + f""",
f AS (SELECT * FROM c WHERE NOT ignore), p AS (SELECT case_id, gt, pred, count(*) AS n FROM f GROUP BY ALL),
m AS (SELECT case_id, pred, gt AS t FROM p WHERE pred <> 9 QUALIFY row_number() OVER (PARTITION BY case_id, pred ORDER BY n DESC) = 1),
d AS (SELECT c.case_id, u, v, gt, coalesce(t, -999) AS p, ignore FROM c LEFT JOIN m USING (case_id, pred)), e AS (SELECT * FROM d WHERE NOT ignore),
i AS (SELECT case_id, k, count(*) FILTER (gt = k AND p = k) / count(*) FILTER (gt = k OR p = k)::DOUBLE AS iou FROM e, (SELECT DISTINCT gt AS k FROM c) GROUP BY case_id, k),
x AS (SELECT DISTINCT y.case_id, y.u, y.v, y.ignore, y.gt <> w.gt AS bg, y.p <> w.p AS bp FROM d y, {STEPS} JOIN d w ON w.case_id = y.case_id AND w.u = y.u + s.a AND w.v = y.v + s.b),
bg AS (SELECT DISTINCT case_id, u, v FROM x WHERE bg AND NOT ignore), bp AS (SELECT DISTINCT case_id, u, v FROM x WHERE bp AND NOT ignore),
o AS (SELECT a.i AS a, b.i AS b FROM range(-2, 3) a(i), range(-2, 3) b(i) WHERE a.i * a.i + b.i * b.i <= 4),
ng AS (SELECT DISTINCT case_id, u + a AS u, v + b AS v FROM bg, o), np AS (SELECT DISTINCT case_id, u + a AS u, v + b AS v FROM bp, o),
hp AS (SELECT bp.case_id, count(ng.u) / count(*)::DOUBLE AS p FROM bp LEFT JOIN ng USING (case_id, u, v) GROUP BY 1), hg AS (SELECT bg.case_id, count(np.u) / count(*)::DOUBLE AS r FROM bg LEFT JOIN np USING (case_id, u, v) GROUP BY 1),
z AS (SELECT case_id, avg(CASE WHEN gt = p THEN 1.0 ELSE 0.0 END) AS acc FROM e GROUP BY 1), un AS (SELECT case_id, count(DISTINCT gt) AS ng, count(DISTINCT pred) AS np FROM f GROUP BY 1),
h AS (SELECT case_id, avg(abs(guess - z)) AS mae FROM c GROUP BY 1), mi AS (SELECT case_id, avg(iou) AS iou FROM i GROUP BY 1)
SELECT k.case_id, round(acc, 6)::DOUBLE AS pixel_accuracy, round(mi.iou, 6) AS macro_iou, un.ng AS n_units_gt, un.np AS n_units_pred, round(hp.p, 6) AS boundary_precision, round(hg.r, 6) AS boundary_recall,
 round(2 * hp.p * hg.r / (hp.p + hg.r), 6) AS boundary_f1, round(mae, 6) AS dem_mae, CASE WHEN acc IS NULL THEN 'FAILED' ELSE 'ok' END AS status
FROM (SELECT CAST(i AS INTEGER) AS case_id FROM range(5) t(i)) k LEFT JOIN z USING (case_id) LEFT JOIN mi USING (case_id) LEFT JOIN un USING (case_id) LEFT JOIN hp USING (case_id) LEFT JOIN hg USING (case_id) LEFT JOIN h USING (case_id)""")
def evaluate_cases(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    cases = spark.range(5).select(F.col("id").cast("int").alias("case_id"))
    out = evaluate.evaluate_cases(cases, cells.select("case_id", "u", "v", "gt", "pred", "ignore"), cells.select("case_id", F.col("z").alias("gt"), F.col("guess").alias("pred")), tolerance=2, ignore="ignore")
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query("WITH " + CELLS + """, b AS (SELECT case_id, gt, pred, z < 170.0 + case_id AS below FROM c WHERE z < 170.0 + case_id), u AS (SELECT case_id, gt, avg(CASE WHEN gt = pred THEN 1.0 ELSE 0.0 END) AS share FROM b GROUP BY ALL)
SELECT case_id, round(avg(CASE WHEN gt = pred THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS agreement, (SELECT round(avg(share), 6)::DOUBLE FROM u WHERE u.case_id = b.case_id) AS macro_agreement,
 round(avg(CASE WHEN gt = pred THEN 1.0 ELSE 0.0 END) FILTER (gt <> 4), 6)::DOUBLE AS agreement_excl_basement, round(avg(CASE WHEN gt = 4 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS basement_share FROM b GROUP BY case_id""")
def voxel_case_metrics(spark, sf_dir):
    cells = _cells(spark, sf_dir).select("case_id", F.col("gt").cast("string").alias("gt"), F.col("pred").cast("string").alias("pred"), (F.col("z") < 170.0 + F.col("case_id")).alias("below"), F.lit("4").alias("basement"))
    out = evaluate.voxel_metrics(cells)
    return out.select("case_id", *[F.round(c, 6).alias(c) for c in out.columns if c != "case_id"])


@query("""
WITH l AS (SELECT s_nationkey % 3 AS case_id, s_nationkey AS line, s_suppkey AS seq, s_acctbal / 20.0 AS x, (s_suppkey % 100)::DOUBLE AS y FROM supplier), t AS (SELECT n_regionkey % 2 AS case_id, n_nationkey * 20.0 AS x, k * 25.0 AS y FROM nation, range(4) r(k)),
d AS (SELECT l.case_id, line, seq, min(sqrt((l.x - t.x) * (l.x - t.x) + (l.y - t.y) * (l.y - t.y))) AS d FROM l JOIN t USING (case_id) GROUP BY ALL), m AS (SELECT case_id, line, avg(d) AS d FROM d GROUP BY ALL),
s AS (SELECT case_id, line, coalesce(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)), 0) AS step FROM l WINDOW w AS (PARTITION BY case_id, line ORDER BY seq)), g AS (SELECT case_id, line, sum(step) AS len FROM s GROUP BY ALL)
SELECT k.case_id, coalesce(bool_or(m.d < 60.0 AND g.len >= 300.0), false) AS fault_hit FROM (SELECT DISTINCT case_id FROM l UNION SELECT DISTINCT case_id FROM t) k LEFT JOIN m USING (case_id) LEFT JOIN g USING (case_id, line) GROUP BY k.case_id""")
def fault_hits(spark, sf_dir):
    k = F.col("s_suppkey")
    lines = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 3).alias("case_id"), F.col("s_nationkey").alias("line"), k.alias("seq"), (F.col("s_acctbal") / 20.0).alias("x"), (k % 100).cast("double").alias("y"))
    truth = table(spark, sf_dir, "nation").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3)))).select((F.col("n_regionkey") % 2).alias("case_id"), (F.col("n_nationkey") * 20.0).alias("x"), (F.col("k") * 25.0).alias("y"))
    return evaluate.fault_hits(lines, truth, 60.0, 300.0)


# ---- stencils by case


@query("WITH " + CELLS + f", x AS (SELECT DISTINCT y.case_id, y.u, y.v, y.gt FROM c y, {STEPS} JOIN c w ON w.case_id = y.case_id AND w.u = y.u + s.a AND w.v = y.v + s.b WHERE y.gt <> w.gt) SELECT case_id, gt, count(*) AS n FROM x GROUP BY ALL")
def case_boundaries(spark, sf_dir):
    return raster.boundary_both(_cells(spark, sf_dir), "gt", BY).groupBy("case_id", "gt").agg(F.count("*").alias("n"))


@query("WITH " + CELLS + """, p AS (SELECT case_id, gt AS a, unnest([lead(gt) OVER (PARTITION BY case_id, v ORDER BY u), lead(gt) OVER (PARTITION BY case_id, u ORDER BY v)]) AS b FROM c)
SELECT case_id, least(a, b) AS unit_a, greatest(a, b) AS unit_b, count(*) AS n FROM p WHERE a <> b GROUP BY ALL""")
def case_adjacent_pairs(spark, sf_dir):
    return raster.adjacent_pairs(_cells(spark, sf_dir), "gt", BY)


@query("WITH " + CELLS + """, g AS (SELECT case_id, u, v, z, lag(z) OVER h AS l, lead(z) OVER h AS r, lag(z) OVER w AS t, lead(z) OVER w AS d FROM c WINDOW h AS (PARTITION BY case_id, v ORDER BY u), w AS (PARTITION BY case_id, u ORDER BY v))
SELECT case_id, u, v, coalesce((r - l) / 2.0, r - z, z - l, 0.0) AS du, coalesce((d - t) / 2.0, d - z, z - t, 0.0) AS dv FROM g""")
def case_gradients(spark, sf_dir):
    return raster.gradient(_cells(spark, sf_dir), "z", BY).select("case_id", "u", "v", "du", "dv")


@query("WITH " + CELLS + """, o AS (SELECT a.i AS du, b.i AS dv FROM range(-1, 2) a(i), range(-1, 2) b(i)), s AS (SELECT c.case_id, c.u, c.v, quantile_disc(w.pred, 0.5) AS m FROM c, o JOIN c w ON w.case_id = c.case_id AND w.u = c.u + du AND w.v = c.v + dv GROUP BY ALL)
SELECT case_id, m AS pred, count(*) AS n FROM s GROUP BY ALL""")
def case_median(spark, sf_dir):
    return raster.median_filter(_cells(spark, sf_dir), 1, "pred", BY).groupBy("case_id", "pred").agg(F.count("*").alias("n"))


@query("WITH " + CELLS + """, k AS (SELECT * FROM c WHERE case_id < 2), h AS (SELECT * FROM k WHERE pred = 9), f AS (SELECT * FROM k WHERE pred <> 9),
b AS (SELECT h.case_id, h.u, h.v, min({'d': (h.u - f.u) * (h.u - f.u) + (h.v - f.v) * (h.v - f.v), 'p': f.pred}).p AS pred FROM h JOIN f ON h.case_id = f.case_id AND abs(h.u - f.u) <= 6 AND abs(h.v - f.v) <= 6 GROUP BY ALL)
SELECT case_id, u, v, pred FROM f UNION ALL SELECT * FROM b""")
def case_nearest_fill(spark, sf_dir):
    """Holes are single cells here, so the SQL looks only as far as six cells; a test has deep holes."""
    cells = _cells(spark, sf_dir).where("case_id < 2").withColumn("hole", F.col("pred") == 9)
    return raster.nearest_fill(cells, "hole", "pred", by=BY)


@query("WITH " + CELLS + """, w(d, w) AS (VALUES (-2, 0.25::DOUBLE), (-1, 0.5), (0, 1.0), (1, 0.5), (2, 0.25)), a AS (SELECT c.case_id, c.u, c.v, sum(w * x.z) / sum(w) AS z FROM c, w JOIN c x ON x.case_id = c.case_id AND x.u = c.u + d AND x.v = c.v GROUP BY ALL),
b AS (SELECT a.case_id, a.u, a.v, sum(w * x.z) / sum(w) AS z FROM a, w JOIN a x ON x.case_id = a.case_id AND x.u = a.u AND x.v = a.v + d GROUP BY ALL) SELECT case_id, u, v, round(z, 5) AS z FROM b""")
def case_smooth(spark, sf_dir):
    return raster.smooth(_cells(spark, sf_dir), [1.0, 0.5, 0.25], "z", BY).select("case_id", "u", "v", F.round("z", 5).alias("z"))


@query("WITH " + CELLS + """, m AS (SELECT case_id, u, v FROM c WHERE pred = 9), o AS (SELECT a.i AS a, b.i AS b FROM range(-1, 2) a(i), range(-1, 2) b(i)), d AS (SELECT DISTINCT case_id, u + a AS u, v + b AS v FROM m, o),
e AS (SELECT d.case_id, d.u, d.v FROM d, o JOIN d x ON x.case_id = d.case_id AND x.u = d.u + a AND x.v = d.v + b GROUP BY ALL HAVING count(*) = 9)
SELECT 'dilated' AS kind, case_id, count(*) AS n FROM d GROUP BY ALL UNION ALL SELECT 'closed', case_id, count(*) FROM e GROUP BY ALL""")
def case_morphology(spark, sf_dir):
    square = raster.offsets("square", 1)
    wide = raster.dilate(_cells(spark, sf_dir).where("pred = 9"), square, BY)
    count = lambda df, kind: df.groupBy("case_id").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "case_id", "n")
    return count(wide, "dilated").unionByName(count(raster.erode(wide, square, BY), "closed"))


@query("WITH " + CELLS + """, e AS (SELECT case_id, u, v, z AS a, lead(z) OVER (PARTITION BY case_id, v ORDER BY u) AS b, 1 AS du, 0 AS dv FROM c UNION ALL SELECT case_id, u, v, z, lead(z) OVER (PARTITION BY case_id, u ORDER BY v), 0, 1 FROM c),
h AS (SELECT *, unnest(range(CAST(floor(least(a, b) / 10.0) AS BIGINT) + 1, CAST(floor(greatest(a, b) / 10.0) AS BIGINT) + 1)) AS k FROM e WHERE b IS NOT NULL AND a <> b)
SELECT case_id, k * 10.0::DOUBLE AS level, round(u + du * (k * 10.0 - a) / (b - a), 6) AS u, round(v + dv * (k * 10.0 - a) / (b - a), 6) AS v FROM h""")
def case_contour_crossings(spark, sf_dir):
    out = raster.iso_crossings(_cells(spark, sf_dir), 10.0, "z", BY)
    return out.select("case_id", "level", F.round("u", 6).alias("u"), F.round("v", 6).alias("v"))


@query("WITH " + CELLS + """, s AS (SELECT case_id, gt AS component, count(*) AS area, min(u) AS u0, max(u) AS u1, min(v) AS v0, max(v) AS v1, avg(u) AS x, avg(v) AS y, var_pop(u) AS cxx, var_pop(v) AS cyy, covar_pop(u, v) AS cxy FROM c GROUP BY ALL),
k AS (SELECT *, 0.5 * atan2(2 * cxy, cxx - cyy) AS a, sqrt((cxx - cyy) * (cxx - cyy) / 4 + cxy * cxy) AS h, (cxx + cyy) / 2 AS m FROM s)
SELECT case_id, component, area, u0, u1, v0, v1, round(x, 6) AS x, round(y, 6) AS y, round(abs(cos(a)), 4) AS dx, round(abs(sin(a)), 4) AS dy, round(sqrt(greatest(0.0, m + h) * 12 + 1) / sqrt(greatest(0.0, m - h) * 12 + 1), 6) AS aspect FROM k""")
def component_shapes(spark, sf_dir):
    out = contours.component_shapes(_cells(spark, sf_dir).withColumn("component", F.col("gt")))
    return out.select("case_id", "component", "area", "u0", "u1", "v0", "v1", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round(F.abs("dx"), 4).alias("dx"), F.round(F.abs("dy"), 4).alias("dy"), F.round("aspect", 6).alias("aspect"))


@query("WITH RECURSIVE " + CELLS + f""", k AS (SELECT case_id, u, v, case_id::BIGINT * 1000000000 + u * 100000 + v AS id FROM c WHERE pred = 9 OR z % 5 = 0),
e AS (SELECT x.id AS a, y.id AS b FROM k x, {STEPS} JOIN k y ON y.case_id = x.case_id AND y.u = x.u + s.a AND y.v = x.v + s.b), r(x, y) AS (SELECT id, id FROM k UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y),
l AS (SELECT x, min(y) AS y FROM r GROUP BY x), g AS (SELECT k.case_id, y, count(*) AS area FROM l JOIN k ON k.id = l.x GROUP BY ALL) SELECT case_id, area, count(*) AS n FROM g GROUP BY ALL""")
def case_components(spark, sf_dir):
    cells = _cells(spark, sf_dir).where("pred = 9 or z % 5 = 0")
    return contours.labelled_components(cells, BY, eight=False).groupBy("case_id", "component").agg(F.count("*").alias("area")).groupBy("case_id", "area").agg(F.count("*").alias("n"))


@query("WITH " + CELLS + """, m AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM c), w AS (SELECT *, CASE WHEN hi = lo THEN 0.0 WHEN hi = r THEN 60.0 * (g - b) / (hi - lo) WHEN hi = g THEN 120.0 + 60.0 * (b - r) / (hi - lo) ELSE 240.0 + 60.0 * (r - g) / (hi - lo) END AS turn FROM m),
h AS (SELECT *, CASE WHEN turn < 0 THEN turn + 360.0 ELSE turn END / 2 AS h, CASE WHEN hi = 0 THEN 0.0 ELSE 255.0 * (hi - lo) / hi END AS s FROM w)
SELECT case_id, u, v, round(h, 4)::DOUBLE AS h, round(s, 4)::DOUBLE AS s, hi AS val, h BETWEEN 95 AND 135 AND s > 60 AND hi > 120 AS water FROM h""")
def water_cells(spark, sf_dir):
    r, g, b = (F.col(c) for c in "rgb")
    h, s, v = hsv(r, g, b)
    return _cells(spark, sf_dir).select("case_id", "u", "v", F.round(h, 4).alias("h"), F.round(s, 4).alias("s"), v.alias("val"), segmentation.is_water(r, g, b).alias("water"))


@query("WITH " + CELLS + """, d AS (SELECT DISTINCT r, g, b FROM c), l AS (SELECT *, list_transform([r, g, b], lambda x: CASE WHEN x / 255.0 <= 0.04045 THEN x / 255.0 / 12.92 ELSE pow((x / 255.0 + 0.055) / 1.055, 2.4) END) AS k FROM d),
x AS (SELECT *, [(0.412453 * k[1] + 0.357580 * k[2] + 0.180423 * k[3]) / 0.950456, 0.212671 * k[1] + 0.715160 * k[2] + 0.072169 * k[3], (0.019334 * k[1] + 0.119193 * k[2] + 0.950227 * k[3]) / 1.088754] AS t FROM l),
f AS (SELECT *, list_transform(t, lambda x: CASE WHEN x > 0.008856 THEN pow(x, 1.0 / 3.0) ELSE 7.787 * x + 16.0 / 116.0 END) AS f FROM x)
SELECT r, g, b, round(116.0 * f[2] - 16.0, 3) AS l, round(500.0 * (f[1] - f[2]), 3) AS a, round(200.0 * (f[2] - f[3]), 3) AS bb FROM f""")
def lab_colours(spark, sf_dir):
    l, a, b = lab(F.col("r"), F.col("g"), F.col("b"))  # noqa: E741
    return _cells(spark, sf_dir).select("r", "g", "b").distinct().select("r", "g", "b", F.round(l, 3).alias("l"), F.round(a, 3).alias("a"), F.round(b, 3).alias("bb"))


# ---- look-ups


@query("SELECT p_brand, CAST(row_number() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS place FROM (SELECT DISTINCT p_brand FROM part)")
def palette(spark, sf_dir):
    return lookups.palette(table(spark, sf_dir, "part"), "p_brand")


@query("SELECT event_type, CAST(row_number() OVER (ORDER BY f, event_type) AS INTEGER) AS place FROM (SELECT event_type, min(event_id) AS f FROM events GROUP BY 1)")
def ordered_distinct(spark, sf_dir):
    return lookups.ordered_distinct(table(spark, sf_dir, "events"), "event_type", "event_id")


@query("WITH " + CELLS + " SELECT case_id, min(z) AS low, max(z) AS high FROM c GROUP BY case_id")
def height_range(spark, sf_dir):
    return lookups.value_range(_cells(spark, sf_dir), "z", BY)


@query("WITH " + CELLS + ", p AS (SELECT s_suppkey, CAST(greatest(0, least(trunc(s_acctbal / 100.0), n - 1)) AS INTEGER) AS u, CAST(greatest(0, least(trunc(s_suppkey * 1.5), n - 1)) AS INTEGER) AS v FROM supplier, n) SELECT s_suppkey, gt, z FROM p JOIN c USING (u, v) WHERE case_id = 0")
def cell_lookup(spark, sf_dir):
    n = _side(spark, sf_dir)
    points = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") / 100.0).alias("u"), (F.col("s_suppkey") * 1.5).alias("v"))
    return lookups.at_cells(points, _cells(spark, sf_dir).where("case_id = 0"), n, n, ["gt", "z"]).select("s_suppkey", "gt", "z")


@query("""SELECT c_custkey, coalesce(r, 160) AS r, coalesce(g, 160) AS g, coalesce(b, 160) AS b FROM customer LEFT JOIN (SELECT n_nationkey, n_nationkey * 9 % 256 AS r, n_nationkey * 5 AS g, 255 - n_nationkey AS b FROM nation WHERE n_regionkey <> 3) ON c_nationkey = n_nationkey""")
def coloured_ids(spark, sf_dir):
    k = F.col("n_nationkey")
    nation = table(spark, sf_dir, "nation")
    colours = nation.where("n_regionkey <> 3").select(F.col("n_name").alias("name"), (k * 9 % 256).alias("r"), (k * 5).alias("g"), (255 - k).alias("b"))
    return lookups.coloured(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", nation.select(k.alias("id"), F.col("n_name").alias("name")), colours).drop("c_nationkey")


@query("WITH " + CELLS + " SELECT case_id, u, CAST(n - 1 - v AS INTEGER) AS v, (pred = 9 OR z > 150) AND NOT (ignore OR gt = 2) AS mask FROM c, n")
def mask_algebra(spark, sf_dir):
    n = _side(spark, sf_dir)
    mask = lookups.merged_mask([F.col("pred") == 9, F.col("z") > 150], [F.col("ignore"), F.col("gt") == 2])
    return _cells(spark, sf_dir).select("case_id", "u", lookups.upside_down(n, F.col("v")).alias("v"), mask.alias("mask"))


@query("SELECT c_nationkey, c_custkey, n FROM (SELECT c_nationkey, c_custkey, count(o_orderkey) AS n, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(o_orderkey) DESC, c_custkey) AS k FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2) WHERE k = 1")
def longest_line(spark, sf_dir):
    sizes = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", "c_custkey").agg(F.count("*").alias("n"))
    return lookups.longest_line(sizes, "c_nationkey", "c_custkey", "n")


# ---- contours and graphs


@query("""
WITH k AS (SELECT c_nationkey % 4 AS case_id, c_custkey AS component, (c_custkey * 37 % 500)::DOUBLE AS x, (c_custkey * 61 % 500)::DOUBLE AS y, cos(c_custkey * 0.1) AS dx, sin(c_custkey * 0.1) AS dy FROM customer),
p AS (SELECT l.component AS a, r.component AS b, sqrt((l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y)) AS d, r.x - l.x AS vx, r.y - l.y AS vy, l.dx, l.dy, r.dx AS ex, r.dy AS ey FROM k l JOIN k r USING (case_id) WHERE l.component <> r.component AND (l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y) BETWEEN 1e-9 AND 1600),
f AS (SELECT a, b, d, CASE WHEN vx / d * dx + vy / d * dy >= 0 THEN 0 ELSE 1 END AS side FROM p WHERE abs(vx / d * dx + vy / d * dy) >= cos(radians(42.0)) AND abs(vx / d * ex + vy / d * ey) >= cos(radians(42.0))),
m AS (SELECT DISTINCT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY a, side ORDER BY d, b) AS k FROM f) WHERE k = 1) SELECT m.a AS u, m.b AS v FROM m JOIN m w ON w.a = m.b AND w.b = m.a WHERE m.a < m.b""")
def link_dashes(spark, sf_dir):
    k = F.col("c_custkey")
    marks = table(spark, sf_dir, "customer").select((F.col("c_nationkey") % 4).alias("case_id"), k.alias("component"), (k * 37 % 500).cast("double").alias("x"), (k * 61 % 500).cast("double").alias("y"), F.cos(k * 0.1).alias("dx"), F.sin(k * 0.1).alias("dy"))
    return contours.link_dashes(marks, contours.ContourParams(link_dist=40.0))


@query("""
WITH e AS (SELECT s_nationkey % 4 AS case_id, s_suppkey AS contour_id, CASE WHEN s_suppkey % 5 = 0 THEN s_acctbal END AS elevation FROM supplier), g AS (SELECT s_nationkey % 4 AS case_id, s_suppkey AS contour_id, s_suppkey * 10.0 AS given FROM supplier WHERE s_suppkey % 3 = 0),
a AS (SELECT case_id, contour_id, coalesce(given, elevation) AS elevation FROM e LEFT JOIN g USING (case_id, contour_id)) SELECT case_id, count(*) AS n_contours, count(elevation) AS n_with_elevation, CAST(sum(CAST(elevation AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM a GROUP BY case_id""")
def contour_elevations(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").withColumn("case_id", F.col("s_nationkey") % 4)
    named = contours.apply_elevations(rows.select("case_id", k.alias("contour_id"), F.when(k % 5 == 0, F.col("s_acctbal")).alias("elevation")), rows.where(k % 3 == 0).select("case_id", k.alias("contour_id"), (k * 10.0).alias("elevation")))
    return contours.contour_counts(named).join(named.groupBy("case_id").agg(exact_sum("elevation").alias("total")), "case_id")


@query("""WITH c AS (SELECT c_nationkey AS node, CAST(c_custkey % 2 AS INTEGER) AS side, CAST(c_custkey % 25 AS INTEGER) AS other, c_acctbal AS dist FROM customer WHERE c_nationkey <> c_custkey % 25),
m AS (SELECT DISTINCT node, other FROM (SELECT *, row_number() OVER (PARTITION BY node, side ORDER BY dist, other) AS k FROM c) WHERE k = 1) SELECT m.node AS a, m.other AS b FROM m JOIN m w ON w.node = m.other AND w.other = m.node WHERE m.node < m.other""")
def mutual_links(spark, sf_dir):
    k = F.col("c_custkey")
    return graph.mutual_best(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("node"), (k % 2).cast("int").alias("side"), (k % 25).cast("int").alias("other"), F.col("c_acctbal").alias("dist")).where("node <> other"))


# ---- constraints


FRAME = SectionFrame(100.0, 200.0, 1900.0, 1700.0, 0.0, 1000.0, 900, 600, 80.0, 40.0, 50.0, 60.0)


@query("""
WITH p AS (SELECT c_custkey, (c_custkey * 37 % 900)::DOUBLE AS u, (c_custkey * 61 % 600)::DOUBLE AS v, c_mktsegment AS formation FROM customer), k AS (SELECT *, u BETWEEN 80 AND 860 AND v BETWEEN 50 AND 540 AS inside FROM p)
SELECT 'in' AS side, formation, round_even(100.0 + (u - 80.0) / 780.0 * 1800.0, 2)::DOUBLE AS x, round_even(200.0 + (u - 80.0) / 780.0 * 1500.0, 2)::DOUBLE AS y, round_even(1000.0 - (v - 50.0) / 490.0 * 1000.0, 2)::DOUBLE AS z FROM k WHERE inside
UNION ALL SELECT 'out', formation, NULL, NULL, NULL FROM k WHERE NOT inside""")
def section_picks_in_frame(spark, sf_dir):
    k = F.col("c_custkey")
    picks = table(spark, sf_dir, "customer").select((k * 37 % 900).cast("double").alias("u"), (k * 61 % 600).cast("double").alias("v"), F.col("c_mktsegment").alias("formation"))
    good, bad = builder.picks_to_points(picks, FRAME)
    return good.select(F.lit("in").alias("side"), "formation", "x", "y", "z").unionByName(bad.select(F.lit("out").alias("side"), "formation"), allowMissingColumns=True)


@query("WITH " + CELLS + """, r AS (SELECT s_suppkey, s_suppkey * 1.7 - 3.0 AS pu, (s_suppkey % 50)::DOUBLE - 2.0 AS pv, s_nationkey + 10.0 AS dip, s_nationkey * 14.0 AS azimuth FROM supplier),
a AS (SELECT *, CAST(greatest(0, least(trunc(pu), n - 1)) AS INTEGER) AS u, CAST(greatest(0, least(trunc(pv), n - 1)) AS INTEGER) AS v FROM r, n)
SELECT round((pu + 0.5) * 2000.0 / n, 3)::DOUBLE AS x, round(2000.0 - (pv + 0.5) * 2000.0 / n, 3)::DOUBLE AS y, z, azimuth::DOUBLE AS azimuth, dip::DOUBLE AS dip, CAST(1 AS INTEGER) AS polarity, 'F' || gt AS formation FROM a JOIN c USING (u, v) WHERE case_id = 0 AND gt <> 4""")
def readings_on_strata(spark, sf_dir):
    n = _side(spark, sf_dir)
    cells = _cells(spark, sf_dir).where("case_id = 0")
    k = F.col("s_suppkey")
    readings = table(spark, sf_dir, "supplier").select((k * 1.7 - 3.0).alias("u"), (k % 50).cast("double").alias("_v"), (F.col("s_nationkey") + 10.0).alias("dip"), (F.col("s_nationkey") * 14.0).alias("azimuth")).withColumn("v", F.col("_v") - 2.0).drop("_v")
    units = spark.range(5).select(F.col("id").alias("unit_id"), F.format_string("F%d", "id").alias("name"), F.when(F.col("id") < 4, "strata").otherwise("water").alias("role"))
    out = builder.readings_on_strata(readings, cells.withColumnRenamed("gt", "label"), cells, units, GeoRef(n, n, 0.0, 2000.0, 0.0, 2000.0))
    return out.withColumns({c: F.round(c, 3) for c in "xy"})


@query("""
WITH p AS (SELECT s_suppkey AS id, (s_suppkey * 37 % 300)::DOUBLE AS x, (s_suppkey * 61 % 200)::DOUBLE AS y FROM supplier),
f AS (SELECT k * 0.5 * 300.0 / sqrt(300.0 * 300.0 + 160.0 * 160.0) AS x, 20.0 + k * 0.5 * 160.0 / sqrt(300.0 * 300.0 + 160.0 * 160.0) AS y FROM range(681) t(k) UNION ALL SELECT 300.0, 180.0)
SELECT id, round(min(sqrt((p.x - f.x) * (p.x - f.x) + (p.y - f.y) * (p.y - f.y))), 5)::DOUBLE AS fault_dist FROM p, f WHERE (p.x - f.x) * (p.x - f.x) + (p.y - f.y) * (p.y - f.y) <= 144.0 GROUP BY id""")
def fault_distances(spark, sf_dir):
    k = F.col("s_suppkey")
    points = table(spark, sf_dir, "supplier").select(k.alias("id"), (k * 37 % 300).cast("double").alias("u"), (k * 61 % 200).cast("double").alias("v"))
    line = spark.createDataFrame([(1, 0, 0.0, 20.0), (1, 1, 300.0, 180.0)], "fault int, seq int, u double, v double")
    return builder.fault_distance(points, line, 12.0).select("id", F.round("fault_dist", 5).alias("fault_dist"))


STACK_SQL = """
u AS (SELECT n_nationkey AS unit_id, n_name AS name, CASE WHEN n_nationkey % 7 = 0 THEN 'water' ELSE 'strata' END AS role, n_nationkey AS ord, 'S' || n_regionkey AS series FROM nation),
p AS (SELECT DISTINCT n_name AS name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 9900 OR c_nationkey > 12),
s AS (SELECT row_number() OVER (ORDER BY ord) AS position, name, series FROM u WHERE role = 'strata' AND ord < (SELECT max(ord) FROM u WHERE role = 'strata') AND name IN (SELECT name FROM p))
"""


def _stack(spark, sf_dir):
    k = F.col("n_nationkey")
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    units = nation.select(k.alias("unit_id"), F.col("n_name").alias("name"), F.when(k % 7 == 0, "water").otherwise("strata").alias("role"), k.alias("order"), F.concat(F.lit("S"), F.col("n_regionkey").cast("string")).alias("series"))
    points = customer.where("c_acctbal > 9900 or c_nationkey > 12").join(nation, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("n_name").alias("formation"))
    return constraints.modelable_stack(units, points)


@query("WITH " + STACK_SQL + "SELECT CAST(position AS INTEGER) AS position, name, series FROM s")
def modelable_stack(spark, sf_dir):
    return _stack(spark, sf_dir)


@query("WITH " + STACK_SQL + "SELECT CAST(row_number() OVER (ORDER BY min(position)) AS INTEGER) AS rank, series, string_agg(name, ',' ORDER BY position) AS members FROM s GROUP BY series")
def series_groups(spark, sf_dir):
    return constraints.series_groups(_stack(spark, sf_dir))


@query("WITH " + STACK_SQL + "SELECT DISTINCT series FROM s WHERE series NOT IN (SELECT series FROM s WHERE name IN (SELECT n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 5 = 0 AND s_nationkey < 4))")
def missing_orientation(spark, sf_dir):
    poses = table(spark, sf_dir, "supplier").where("s_suppkey % 5 = 0 and s_nationkey < 4").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("n_name").alias("formation"))
    return constraints.missing_orientation(_stack(spark, sf_dir), poses)


@query("""
WITH p AS (SELECT s_suppkey AS seq, (s_suppkey % 40)::DOUBLE AS x, (s_suppkey % 7)::DOUBLE AS y, s_acctbal AS z, 'F' || s_nationkey AS formation FROM supplier WHERE s_nationkey <> 3),
u AS (SELECT *, row_number() OVER (ORDER BY seq) AS k FROM p WHERE formation = 'F4') SELECT seq, x, y, greatest(z - 400.0, 15.0) AS z, 'F3' AS formation FROM u WHERE k % 2 = 1""")
def thickness_prior(spark, sf_dir):
    k = F.col("s_suppkey")
    points = table(spark, sf_dir, "supplier").where("s_nationkey <> 3").select(k.alias("seq"), (k % 40).cast("double").alias("x"), (k % 7).cast("double").alias("y"), F.col("s_acctbal").alias("z"), F.concat(F.lit("F"), F.col("s_nationkey").cast("string")).alias("formation"))
    return constraints.thickness_prior(points, "F3", "F4", 400.0, 15.0)


def constraint_tables(spark, sf_dir):
    """The whole builder on a map of the base scenario: points and orientations of each formation. SQL has no greedy choices; tests hold its parts."""
    n = 2 * _side(spark, sf_dir)
    georef = GeoRef(n, n, 0.0, 2000.0, 0.0, 2000.0)
    truth = generate.map_truth(spark, BASE, georef)
    names = [(i, name, "strata", i, "S", None, None) for i, name, _ in BASE.units()]
    units = spark.createDataFrame(names, "unit_id int, name string, role string, `order` int, series string, dip double, azimuth double")
    rims = truth.select("u", "v", "label", F.lead("label").over(generate.Window.partitionBy("u").orderBy("v")).alias("below")).where("below = label + 1")
    rank = F.row_number().over(generate.Window.partitionBy("label").orderBy("u", "v"))
    lines = rims.groupBy("label", "u").agg(F.min("v").alias("v")).select(F.col("label").alias("contact_id"), rank.alias("seq"), F.col("u").cast("double").alias("u"), F.col("v").cast("double").alias("v"))
    contacts = lines.select("contact_id", F.col("contact_id").alias("unit_a"), (F.col("contact_id") + 1).alias("unit_b")).distinct()
    faults = spark.createDataFrame([(1, "F1", 65.0, 90.0)], "fault int, name string, dip double, azimuth double")
    trace = spark.createDataFrame([(1, 0, n * 0.55, 0.0), (1, 1, n * 0.6, float(n - 1))], "fault int, seq int, u double, v double")
    made = builder.build_constraints(contacts, lines, units, faults, trace, truth.select("u", "v", "z"), georef, (0.0, 1000.0), params=builder.ConstraintParams(sample_step=4.0, fault_buffer=3.0, default_dip=5.0))
    return made.summary


# ---- requests and generators


@query("WITH v AS (" + voxels_sql() + "), g AS (" + ground_sql() + """), s AS (SELECT k AS sample, CAST(greatest(0, least(floor((50.0 + k / 499.0 * 1900.0) / 40.0), 49)) AS BIGINT) AS i, CAST(greatest(0, least(floor((700.0 + k / 499.0 * 800.0) / 40.0), 49)) AS BIGINT) AS j FROM range(500) t(k))
SELECT 'section_1' AS request, CAST(CASE WHEN 20.0 * (v.k + 0.5) > ground_z THEN -9999 ELSE lith_id END AS INTEGER) AS lith_id, count(*) AS n FROM s JOIN v USING (i, j) JOIN g USING (i, j) GROUP BY ALL
UNION ALL SELECT 'slice_' || r, CAST(CASE WHEN 20.0 * (k + 0.5) > ground_z THEN -9999 ELSE lith_id END AS INTEGER), count(*) FROM v JOIN g USING (i, j) JOIN (VALUES (1, 22), (2, 32)) q(r, k) USING (k) GROUP BY ALL""")
def request_batch(spark, sf_dir):
    names = spark.createDataFrame([(i, n) for i, n, _ in BASE.units()], "lith_id int, unit string")
    made = requests.run_requests(asked_voxels(spark, sf_dir), GRID, names, grid.surface(spark, BASE))
    both = made["sections"].select("request", "lith_id").unionByName(made["slices"].select("request", "lith_id"))
    return both.groupBy("request", "lith_id").agg(F.count("*").alias("n"))


@query("""
WITH a AS (SELECT user_id, seq, x, y, coalesce(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)), 0) AS st FROM (SELECT user_id, event_id AS seq, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS x, value AS y FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
s AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY seq) AS s FROM a) SELECT user_id, seq, CAST(floor(s / 160.0) AS BIGINT) AS dash_no FROM s WHERE s - floor(s / 160.0) * 160.0 < 100.0""")
def dash_pattern(spark, sf_dir):
    return generate.dashed(paths(spark, sf_dir), ["user_id"], "seq", 100.0, 60.0).select("user_id", "seq", "dash_no")


@query("WITH " + CELLS + """, l AS (SELECT case_id, u, v, CASE WHEN v * 4 < u THEN NULL ELSE gt END AS label FROM c), m AS (SELECT *, lag(label) OVER w AS up, row_number() OVER w AS k FROM l WINDOW w AS (PARTITION BY case_id, u ORDER BY v))
SELECT case_id, u, v, CASE WHEN up IS NULL THEN 'ground' ELSE 'contact' END AS kind FROM m WHERE k > 1 AND label IS NOT NULL AND up IS DISTINCT FROM label""")
def drawn_section_edges(spark, sf_dir):
    return generate.section_edges(_cells(spark, sf_dir).select("case_id", "u", "v", F.when(F.col("v") * 4 < F.col("u"), None).otherwise(F.col("gt")).alias("label")), BY)


def _fold_sql(x: str, y: str) -> str:
    """The rise of a layer without the fault's part."""
    from dataclasses import replace

    return _sql_rise(x, y, "0.0", replace(BASE, fault=None))


_FX, _FZ, _DIP, _THROW = BASE.fault
_BOTTOMS = " UNION ALL ".join(f"SELECT x, y, '{name}' AS formation, {base} + ({_fold_sql('x', 'y')}) AS before FROM g" for name, base, _ in BASE.layers)
LAYERS = f"b AS ({_BOTTOMS}), k AS (SELECT x, y, formation, before - CASE WHEN x > {_FX} + ({_FZ} - before) / tan(radians({_DIP})) THEN {_THROW} ELSE 0.0 END AS z FROM b)"


@query("WITH n AS (SELECT CAST(floor(sqrt(count(*))) AS BIGINT) AS n FROM part), g AS (SELECT (i % n) * (2000.0 / (n - 1)) AS x, (i // n) * (2000.0 / (n - 1)) AS y FROM n, (SELECT unnest(range(n * n)) AS i FROM n)), " + LAYERS + f"""
SELECT formation, count(*) AS n, CAST(sum(CAST(round_even(z, 2) AS DECIMAL(18, 2))) AS DOUBLE) AS z FROM k WHERE z BETWEEN 0 AND 1000 AND z <= {dem_sql('x', 'y')} GROUP BY formation""")
def layer_points(spark, sf_dir):
    return generate.layer_points(spark, BASE, _side(spark, sf_dir)).groupBy("formation").agg(F.count("*").alias("n"), exact_sum("z").alias("z"))


_A = f"({BASE.slope!r} - {BASE.fold_amp} * 2.0 * pi() / {BASE.fold_wavelength} * sin(2.0 * pi() / {BASE.fold_wavelength} * (x - {BASE.fold_phase})))"
_B = f"(-{BASE.cross_amp} * 2.0 * pi() / {BASE.cross_wavelength} * sin(2.0 * pi() / {BASE.cross_wavelength} * (y - {BASE.cross_phase})))"


@query("WITH n AS (SELECT CAST(floor(sqrt(count(*))) AS BIGINT) AS n FROM part), g AS (SELECT CAST(i % n AS INTEGER) AS u, CAST(i // n AS INTEGER) AS v, (i % n) * 10.0 AS x, (i // n) * 10.0 AS y FROM n, (SELECT unnest(range(n * n)) AS i FROM n)), "
    f"""d AS (SELECT u, v, {_A} AS a, {_B} AS b FROM g) SELECT u, v, round(a, 8) AS a, round(b, 8) AS b, round(CASE WHEN sqrt(a * a + b * b) < 1e-6 THEN 0.0 ELSE degrees(atan(sqrt(a * a + b * b))) END, 1) AS dip FROM d""")
def layer_gradients(spark, sf_dir):
    n = _side(spark, sf_dir)
    nodes = generate.pixels(spark, n, n)
    a, b = BASE.gradient(F.col("u") * 10.0, F.col("v") * 10.0)
    dip = F.when(F.sqrt(a * a + b * b) < 1e-6, 0.0).otherwise(F.degrees(F.atan(F.sqrt(a * a + b * b))))
    return nodes.select("u", "v", F.round(a, 8).alias("a"), F.round(b, 8).alias("b"), F.round(dip, 1).alias("dip"))


MAP = "n AS (SELECT CAST(floor(sqrt(count(*))) AS BIGINT) AS n FROM part), g AS (SELECT CAST(i % n AS INTEGER) AS u, CAST(i // n AS INTEGER) AS v, (i % n + 0.5) * (2000.0 / n) AS x, 2000.0 - (i // n + 0.5) * (2000.0 / n) AS y FROM n, (SELECT unnest(range(n * n)) AS i FROM n)), " + f"h AS (SELECT *, {dem_sql('x', 'y')} AS z FROM g)"


def _map(spark, sf_dir):
    n = _side(spark, sf_dir)
    return generate.map_truth(spark, BASE, GeoRef(n, n, 0.0, 2000.0, 0.0, 2000.0))


@query("WITH " + MAP + f" SELECT u, v, CAST({unit_sql('x', 'y', 'z')} AS INTEGER) AS label, round(z, 6) AS z FROM h")
def map_truth(spark, sf_dir):
    return _map(spark, sf_dir).select("u", "v", "label", F.round("z", 6).alias("z"))


@query("WITH " + MAP + f", b AS (SELECT v, u, x > {_FX} + ({_FZ} - z) / tan(radians({_DIP})) AS beyond FROM h), c AS (SELECT v, u, beyond, lag(beyond) OVER (PARTITION BY v ORDER BY u) AS before FROM b) SELECT v, min(u) AS u FROM c WHERE beyond <> before GROUP BY v")
def fault_trace(spark, sf_dir):
    return generate.fault_trace(_map(spark, sf_dir), BASE)


@query("WITH RECURSIVE " + MAP + """, r AS (SELECT u, v, round(z, 6) AS z FROM h), o AS (SELECT a.i AS a, b.i AS b FROM range(-1, 2) a(i), range(-1, 2) b(i)),
s AS (SELECT r.u, r.v, min({'z': w.z, 'u': w.u, 'v': w.v}) AS low FROM r, o JOIN r w ON w.u = r.u + a AND w.v = r.v + b GROUP BY ALL),
p(river, seq, u, v) AS (SELECT u * 1000 + v, CAST(0 AS BIGINT), u, v FROM r WHERE u % 10 = 3 AND v % 10 = 3 UNION ALL SELECT river, seq + 1, low.u, low.v FROM p JOIN s USING (u, v) WHERE low.u <> p.u OR low.v <> p.v)
SELECT river, seq, u, v FROM p""")
def rivers(spark, sf_dir):
    heights = _map(spark, sf_dir).select("u", "v", F.round("z", 6).alias("z"))
    sources = heights.where("u % 10 = 3 and v % 10 = 3").select((F.col("u") * 1000 + F.col("v")).alias("river"), "u", "v")
    return generate.rivers(heights, sources)


@query("WITH " + CELLS + """, l AS (SELECT case_id, u, v, gt AS label FROM c WHERE case_id = 1), f AS (SELECT a.label, a.u, a.v, min((a.u - b.u) * (a.u - b.u) + (a.v - b.v) * (a.v - b.v)) AS d FROM l a JOIN l b ON a.label <> b.label GROUP BY ALL)
SELECT label, round(max(sqrt(d)), 6) AS depth FROM f GROUP BY label""")
def deepest_places(spark, sf_dir):
    """The depth of the deepest place of each label: the largest over all of its parts."""
    cells = _cells(spark, sf_dir).where("case_id = 1").select("case_id", "u", "v", F.col("gt").alias("label"))
    return generate.label_places(cells, 1_000_000).groupBy("label").agg(F.round(F.max("depth"), 6).alias("depth"))


@query("WITH g AS (SELECT 80.0 + k * 45.0 AS u, 100.0 + k * 45.0 / 780.0 * 1800.0 AS x, 200.0 + k * 45.0 / 780.0 * 1500.0 AS y FROM range(18) t(k)), b AS (" + _BOTTOMS.replace("SELECT x, y,", "SELECT u, x, y,")
    + f"), k AS (SELECT u, x, y, formation, before - CASE WHEN x > {_FX} + ({_FZ} - before) / tan(radians({_DIP})) THEN {_THROW} ELSE 0.0 END AS z FROM b) "
    f"SELECT round(u, 2)::DOUBLE AS u, round(50.0 + (1000.0 - z) / 1000.0 * 490.0, 1) AS v, formation FROM k WHERE z BETWEEN 15 AND 985 AND z <= {dem_sql('x', 'y')} - 15 AND abs(x - ({_FX} + ({_FZ} - z) / tan(radians({_DIP})))) > 80.0")
def generated_section_picks(spark, sf_dir):
    return generate.section_picks(spark, BASE, FRAME).select("u", F.round("v", 1).alias("v"), "formation")


@query("WITH " + MAP + f", l AS (SELECT u, v, {unit_sql('x', 'y', 'z')} AS label, {_A} AS a, {_B} AS b FROM h), d AS (SELECT label, count(*) AS n FROM l WHERE label < 5 AND round_even(degrees(atan(sqrt(a * a + b * b))), 2) >= 1.0 GROUP BY label) SELECT CAST(label AS INTEGER) AS label, CAST(least(n, 4) AS BIGINT) AS n FROM d")
def dip_symbols(spark, sf_dir):
    """How many readings each layer gets; the places are hashed, the readings are held by layer_gradients."""
    return generate.dip_symbols(_map(spark, sf_dir), BASE, 4).groupBy("label").agg(F.count("*").alias("n"))


@query("WITH " + MAP + f", l AS (SELECT {unit_sql('x', 'y', 'z')} AS label FROM h), k AS (SELECT label, count(*) AS n FROM l GROUP BY label) SELECT CAST(c AS INTEGER) AS case_id, CAST(sum(n) AS BIGINT) AS n, max(n) AS largest, true AS good FROM k, range(4) t(c) GROUP BY c")
def segment_cases(spark, sf_dir):
    """Four drawn maps (cleaned, with even light; cases 1 to 3 have noise and a slope of light): labelled cells, cells of the largest true unit, and whether over 85 % of all cells are in a found unit that is mostly their own.

    Clusters can't be expressed in SQL; the SQL holds that every cell is labelled, once, and how well.
    """
    n = _side(spark, sf_dir)
    colours = spark.createDataFrame([(i, *map(int, c)) for i, _, c in BASE.units()], "label int, r int, g int, b int")
    drawn = _map(spark, sf_dir).select("u", "v", F.col("label").alias("gt")).join(F.broadcast(colours.withColumnRenamed("label", "gt")), "gt")
    case, noise = F.col("case_id"), lambda c: F.pmod(F.xxhash64("case_id", "u", "v", F.lit(c)), F.lit(2)) * F.col("case_id")
    shade = lambda c: F.greatest(F.lit(0), F.least(F.lit(255), F.col(c) + noise(c) - F.floor(case * F.col("u") * 3 / n))).cast("int").alias(c)
    pixels = drawn.withColumn("case_id", F.explode(F.sequence(F.lit(0), F.lit(3)))).select("case_id", "u", "v", "gt", *[shade(c) for c in "rgb"])
    labels, _ = segmentation.segment_maps(pixels.drop("gt"), segmentation.SegmentParams(min_region=max(2, n * n // 1000), median_radius=1))
    both = labels.withColumnRenamed("label", "pred").join(pixels.select("case_id", "u", "v", "gt").hint("merge"), ["case_id", "u", "v"]).groupBy("case_id", "gt", "pred").agg(F.count("*").alias("k"))
    own = both.withColumn("_m", F.max("k").over(Window.partitionBy("case_id", "pred"))).withColumn("_g", F.sum("k").over(Window.partitionBy("case_id", "gt")))
    return own.groupBy("case_id").agg(F.sum("k").alias("n"), F.max("_g").alias("largest"), (F.sum(F.when(F.col("k") == F.col("_m"), F.col("k"))) > 0.85 * F.sum("k")).alias("good"))


@query("""WITH e AS (SELECT user_id, event_id AS seq, value FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM e) SELECT user_id, seq, value FROM k WHERE rn - 1 = n // 2""")
def middle_element(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), "value")
    return sequences.number(rows, ["user_id"], ["seq"], "_rn", "_n").where("_rn - 1 = _n div 2").select("user_id", "seq", "value")


@query("""
WITH c AS (SELECT c_custkey AS id, c_nationkey AS k, c_acctbal AS x, (c_custkey % 50)::DOUBLE AS y FROM customer), s AS (SELECT s_nationkey AS k, s_acctbal AS x, (s_suppkey % 50)::DOUBLE AS y FROM supplier)
SELECT c.k, id, round(min(sqrt((c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y))), 4) AS dist FROM c LEFT JOIN s USING (k) GROUP BY ALL""")
def nearest_distances(spark, sf_dir):
    points = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 50).cast("double").alias("y"))
    targets = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("x"), (F.col("s_suppkey") % 50).cast("double").alias("y"))
    return spatial.nearest_distances(points, targets, 100.0, ("k",)).select("k", "id", F.round("dist", 4).alias("dist"))


QUERIES |= {f.__name__: f for f in (constraint_tables, segment_cases)}
