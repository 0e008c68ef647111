"""Queries on grids and frames, and their SQL.

Voxels, rasters and points come from the driver's tables; the analytic model only says what stands in a voxel.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import GeoRef, SectionFrame, index_nearest
from ..operators import grid, metrics, raster
from ..operators.grid import scenarios
from .tables import BASE, GRID, asked_voxels, dem_sql, ground_sql, level_cells, level_sql, table, voxels_sql

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


UNIT_VALUES = ", ".join(f"({i}, '{n}')" for i, n, _ in BASE.units())


def _names(spark):
    return spark.createDataFrame([(i, n) for i, n, _ in BASE.units()], "lith_id int, unit string")


@query(f"""
WITH v AS ({voxels_sql(whole=True)}), g AS ({ground_sql()}), b AS (SELECT s_suppkey AS request, (s_suppkey * 37 % 1001) * 2.0 AS x, (s_acctbal + 1000.0) / 5.6 AS y FROM supplier), u(lith_id, unit) AS (VALUES {UNIT_VALUES}),
q AS (SELECT request, CAST(least(floor(x / 40.0), 49) AS BIGINT) AS i, CAST(least(floor(y / 40.0), 49) AS BIGINT) AS j FROM b),
c AS (SELECT request, k, lith_id, ground_z FROM q JOIN v USING (i, j) JOIN g USING (i, j) WHERE k <= greatest(0, least(floor(ground_z / 20.0), 49))),
m AS (SELECT *, CASE WHEN lith_id = lag(lith_id) OVER w THEN 0 ELSE 1 END AS ch FROM c WINDOW w AS (PARTITION BY request ORDER BY k DESC)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY request ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS seg_no FROM m),
s AS (SELECT request, CAST(seg_no AS BIGINT) AS seg_no, any_value(lith_id) AS lith_id, any_value(ground_z) AS ground_z, (max(k) + 1) * 20.0 AS top, min(k) * 20.0 AS z_bottom FROM r GROUP BY request, seg_no)
SELECT request, seg_no, unit, round(CASE WHEN seg_no = 1 THEN least(top, round_even(ground_z, 1)) ELSE top END, 4)::DOUBLE AS z_top, z_bottom::DOUBLE AS z_bottom,
  round(CASE WHEN seg_no = 1 THEN least(top, round_even(ground_z, 1)) ELSE top END - z_bottom, 4)::DOUBLE AS thickness FROM s JOIN u USING (lith_id)""")
def borehole_truth(spark, sf_dir):
    k = F.col("s_suppkey")
    requests = table(spark, sf_dir, "supplier").select(k.alias("name"), ((k * 37 % 1001) * 2.0).alias("x"), ((F.col("s_acctbal") + 1000.0) / 5.6).alias("y"))
    out = grid.borehole(asked_voxels(spark, sf_dir, whole=True), requests, GRID, _names(spark), grid.surface(spark, BASE))
    return out.select("request", "seg_no", "unit", *[F.round(c, 4).alias(c) for c in ("z_top", "z_bottom", "thickness")])


@query(f"""
WITH v AS ({voxels_sql()}), g AS ({ground_sql()})
SELECT CAST(CASE WHEN 610.0 > ground_z THEN -9999 ELSE lith_id END AS INTEGER) AS lith_id, count(*) AS n FROM v JOIN g USING (i, j) WHERE k = 30 GROUP BY 1""")
def level_slice_truth(spark, sf_dir):
    cells = grid.level_slice(asked_voxels(spark, sf_dir), GRID, 617.0, grid.surface(spark, BASE))
    return cells.groupBy("lith_id").agg(F.count("*").alias("n"))


@query(f"""
WITH v AS ({voxels_sql()}), g AS ({ground_sql()}),
s AS (SELECT k AS sample, CAST(greatest(0, least(floor((100.0 + k / 199.0 * 1800.0) / 40.0), 49)) AS BIGINT) AS i, CAST(greatest(0, least(floor((150.0 + k / 199.0 * 1600.0) / 40.0), 49)) AS BIGINT) AS j FROM range(200) t(k))
SELECT CAST(sample AS INTEGER) AS sample, CAST(CASE WHEN 20.0 * (k + 0.5) > ground_z THEN -9999 ELSE lith_id END AS INTEGER) AS lith_id, count(*) AS n FROM s JOIN v USING (i, j) JOIN g USING (i, j) GROUP BY 1, 2""")
def section_truth(spark, sf_dir):
    cells = grid.section(asked_voxels(spark, sf_dir), GRID, (100.0, 150.0), (1900.0, 1750.0), 200, grid.surface(spark, BASE))
    return cells.groupBy("sample", "lith_id").agg(F.count("*").alias("n"))


@query(" UNION ALL ".join(f"SELECT '{k}' AS scenario, CAST(lith_id AS INTEGER) AS lith_id, count(*) AS n_all, CAST(count(*) FILTER (WHERE below) AS BIGINT) AS n_below FROM ({voxels_sql(s)}) GROUP BY lith_id" for k, s in scenarios().items()))
def truth_voxel_counts(spark, sf_dir):
    out = None
    for name, scenario in scenarios().items():
        part = asked_voxels(spark, sf_dir, scenario).groupBy("lith_id").agg(F.count("*").alias("n_all"), F.count_if("below").alias("n_below")).select(F.lit(name).alias("scenario"), "*")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"SELECT round(avg(CASE WHEN lith_id = 5 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS share, count(*) AS n FROM ({voxels_sql()}) WHERE below")
def below_ground_share(spark, sf_dir):
    below = asked_voxels(spark, sf_dir).where("below")
    return below.agg(F.round(F.avg((F.col("lith_id") == 5).cast("double")), 6).alias("share"), F.count("*").alias("n"))


SIDES = """
c AS ({cells}), n AS (SELECT a.u, a.v, a.label, b.label AS other, b.u > a.u OR b.v > a.v AS ahead FROM c a JOIN c b ON (b.u = a.u + 1 AND b.v = a.v) OR (b.u = a.u - 1 AND b.v = a.v) OR (b.u = a.u AND b.v = a.v + 1) OR (b.u = a.u AND b.v = a.v - 1))
"""
LEVEL_SIDES = "WITH " + SIDES.format(cells=level_sql(25))


@query(LEVEL_SIDES + "SELECT DISTINCT CAST(u AS INTEGER) AS u, CAST(v AS INTEGER) AS v, CAST(label AS INTEGER) AS label FROM n WHERE label <> other")
def boundary_both_sides(spark, sf_dir):
    return raster.boundary_both(level_cells(spark, sf_dir, 25))


@query(LEVEL_SIDES + "SELECT DISTINCT CAST(u AS INTEGER) AS u, CAST(v AS INTEGER) AS v, CAST(label AS INTEGER) AS label FROM n WHERE label <> other AND ahead")
def boundary_upper_left(spark, sf_dir):
    return raster.boundary_upper_left(level_cells(spark, sf_dir, 25))


@query(LEVEL_SIDES + "SELECT CAST(least(label, other) AS INTEGER) AS unit_a, CAST(greatest(label, other) AS INTEGER) AS unit_b, count(*) AS n FROM n WHERE label <> other AND ahead GROUP BY 1, 2")
def adjacent_pair_counts(spark, sf_dir):
    return raster.adjacent_pairs(level_cells(spark, sf_dir, 25))


@query(LEVEL_SIDES + """, b AS (SELECT DISTINCT u, v FROM n WHERE label <> other),
d AS (SELECT a.u, a.v, count(b.u) AS degree FROM b a LEFT JOIN b ON abs(a.u - b.u) <= 1 AND abs(a.v - b.v) <= 1 AND NOT (a.u = b.u AND a.v = b.v) GROUP BY a.u, a.v)
SELECT degree, count(*) AS n FROM d GROUP BY degree""")
def degree_8(spark, sf_dir):
    return raster.degree(raster.boundary_both(level_cells(spark, sf_dir, 25)).select("u", "v")).groupBy("degree").agg(F.count("*").alias("n"))


@query("WITH " + SIDES.format(cells=level_sql(25)) + ", b AS (SELECT DISTINCT u, v FROM n WHERE label <> other), c2 AS (" + level_sql(27) + """),
n2 AS (SELECT DISTINCT a.u, a.v FROM c2 a JOIN c2 b ON abs(a.u - b.u) + abs(a.v - b.v) = 1 WHERE a.label <> b.label),
p AS (SELECT count(*) AS n_pred, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM b WHERE (b.u - n2.u) * (b.u - n2.u) + (b.v - n2.v) * (b.v - n2.v) <= 9)) AS hit FROM n2),
g AS (SELECT count(*) AS n_gt, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM n2 WHERE (b.u - n2.u) * (b.u - n2.u) + (b.v - n2.v) * (b.v - n2.v) <= 9)) AS hit FROM b),
s AS (SELECT n_pred, n_gt, p.hit / n_pred::DOUBLE AS precision, g.hit / n_gt::DOUBLE AS recall FROM p, g)
SELECT n_pred, n_gt, round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / (precision + recall), 6) AS f1 FROM s""")
def boundary_prf_tol(spark, sf_dir):
    edge = lambda z: raster.boundary_both(level_cells(spark, sf_dir, z)).select("u", "v")
    out = metrics.boundary_scores(edge(27), edge(25), 3)
    return out.select("n_pred", "n_gt", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""
WITH c AS ({level_sql(25)}), m AS (SELECT u, v FROM c WHERE label = 3), o AS (SELECT a AS du, b AS dv FROM range(-2, 3) p(a), range(-2, 3) q(b) WHERE a * a + b * b <= 4)
SELECT count(DISTINCT (u + du, v + dv)) AS n_dilated, (SELECT count(*) FROM (SELECT m.u, m.v FROM m, o JOIN m k ON k.u = m.u + du AND k.v = m.v + dv GROUP BY m.u, m.v HAVING count(*) = 13)) AS n_eroded FROM m, o""")
def morphology(spark, sf_dir):
    mask = level_cells(spark, sf_dir, 25).where("label = 3").select("u", "v")
    disc = raster.offsets("disc", 2)
    return raster.dilate(mask, disc).agg(F.count("*").alias("n_dilated")).join(raster.erode(mask, disc).agg(F.count("*").alias("n_eroded")))


@query(f"""
WITH c AS ({level_sql(25)}), s AS (SELECT a.u, a.v, list_sort(list(b.label)) AS l FROM c a JOIN c b ON abs(a.u - b.u) <= 2 AND abs(a.v - b.v) <= 2 GROUP BY a.u, a.v)
SELECT CAST(l[(len(l) - 1) // 2 + 1] AS INTEGER) AS label, count(*) AS n FROM s GROUP BY 1""")
def median_labels(spark, sf_dir):
    return raster.median_filter(level_cells(spark, sf_dir, 25), 2).groupBy("label").agg(F.count("*").alias("n"))


@query(f"""
WITH g AS ({ground_sql()}), p AS (SELECT k AS id, (k * 37 % 997) / 997.0 * 53.0 - 2.0 AS u, (k * 61 % 991) / 991.0 * 53.0 - 2.0 AS v FROM (SELECT c_custkey AS k FROM customer)),
q AS (SELECT id, greatest(0.0, least(49.0, u)) AS u, greatest(0.0, least(49.0, v)) AS v FROM p), f AS (SELECT id, floor(u) AS u0, floor(v) AS v0, u - floor(u) AS fu, v - floor(v) AS fv FROM q),
c AS (SELECT id, least(u0 + a, 49) AS i, least(v0 + b, 49) AS j, (CASE WHEN a = 1 THEN fu ELSE 1 - fu END) * (CASE WHEN b = 1 THEN fv ELSE 1 - fv END) AS w FROM f, range(2) x(a), range(2) y(b))
SELECT id, round(sum(w * ground_z), 4) AS z FROM c JOIN g ON g.i = c.i AND g.j = c.j GROUP BY id""")
def bilinear_sample(spark, sf_dir):
    from ..operators.spatial import bilinear

    k = F.col("id")
    points = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).select("id", ((k * 37 % 997) / 997.0 * 53.0 - 2.0).alias("u"), ((k * 61 % 991) / 991.0 * 53.0 - 2.0).alias("v"))
    raster_z = grid.surface(spark, BASE).select(F.col("i").alias("u"), F.col("j").alias("v"), F.col("ground_z").alias("z"))
    return bilinear(points, raster_z, 50, 50).select("id", F.round("z", 4).alias("z"))


REF = GeoRef(1100, 1000, 0.0, 2000.0, 100.0, 2100.0)


@query("""
WITH p AS (SELECT k AS id, (k * 37 % 1100)::DOUBLE AS u, (acctbal + 1000.0) / 11.0 AS v FROM (SELECT c_custkey AS k, c_acctbal AS acctbal FROM customer)), w AS (SELECT *, 0.0 + (u + 0.5) * (2000.0 / 1100) AS x, 2100.0 - (v + 0.5) * (2000.0 / 1000) AS y FROM p)
SELECT id, round(x, 4)::DOUBLE AS x, round(y, 4)::DOUBLE AS y, round(x / (2000.0 / 1100) - 0.5, 4)::DOUBLE AS u, round((2100.0 - y) / 2.0 - 0.5, 4)::DOUBLE AS v FROM w""")
def georef_roundtrip(spark, sf_dir):
    p = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 37 % 1100).cast("double").alias("u"), ((F.col("c_acctbal") + 1000.0) / 11.0).alias("v"))
    x, y = REF.to_world(F.col("u"), F.col("v"))
    world = p.select("id", x.alias("x"), y.alias("y"))
    u, v = REF.to_pixel(F.col("x"), F.col("y"))
    return world.select("id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.round(u, 4).alias("u"), F.round(v, 4).alias("v"))


FRAME = SectionFrame(100.0, 200.0, 1900.0, 1700.0, 0.0, 1000.0, 900, 600, 80, 40, 50, 60)


@query("""
WITH p AS (SELECT k AS id, (k * 37 % 900)::DOUBLE AS u, (acctbal + 1000.0) / 18.0 AS v FROM (SELECT c_custkey AS k, c_acctbal AS acctbal FROM customer)), t AS (SELECT *, (u - 80) / 780.0 AS t FROM p),
w AS (SELECT id, 100.0 + t * 1800.0 AS x, 200.0 + t * 1500.0 AS y, 1000.0 - (v - 50) / 490.0 * 1000.0 AS z FROM t)
SELECT id, round(x, 4)::DOUBLE AS x, round(y, 4)::DOUBLE AS y, round(z, 4)::DOUBLE AS z, round(80 + ((x - 100.0) * 1800.0 + (y - 200.0) * 1500.0) / 5490000.0 * 780.0, 4)::DOUBLE AS u, round(50 + (1000.0 - z) / 1000.0 * 490.0, 4)::DOUBLE AS v FROM w""")
def section_roundtrip(spark, sf_dir):
    p = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 37 % 900).cast("double").alias("u"), ((F.col("c_acctbal") + 1000.0) / 18.0).alias("v"))
    x, y, z = FRAME.to_world(F.col("u"), F.col("v"))
    world = p.select("id", x.alias("x"), y.alias("y"), z.alias("z"))
    u, v = FRAME.to_pixel(F.col("x"), F.col("y"), F.col("z"))
    return world.select("id", *[F.round(c, 4).alias(n) for n, c in (("x", F.col("x")), ("y", F.col("y")), ("z", F.col("z")), ("u", u), ("v", v))])


@query("SELECT id, u, v FROM (SELECT k AS id, (k * 37 % 900)::DOUBLE AS u, (acctbal + 1000.0) / 18.0 AS v FROM (SELECT c_custkey AS k, c_acctbal AS acctbal FROM customer)) WHERE u BETWEEN 80 AND 860 AND v BETWEEN 50 AND 540")
def inside_filter(spark, sf_dir):
    p = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 37 % 900).cast("double").alias("u"), ((F.col("c_acctbal") + 1000.0) / 18.0).alias("v"))
    return p.where(FRAME.inside(F.col("u"), F.col("v")))


@query(f"""
WITH p AS (SELECT o_custkey % 50 AS u, o_orderkey % 50 AS v, max(o_custkey) * 5 % 256 AS r, min(o_orderkey) * 7 % 256 AS g, count(*) * 40 % 256 AS b FROM orders GROUP BY ALL),
w AS (SELECT u, v, r * 0.7 + 76.5 AS r, g * 0.7 + 76.5 AS g, b * 0.7 + 76.5 AS b FROM p), y AS (SELECT *, r * 0.299 + g * 0.587 + b * 0.114 AS l FROM w)
SELECT CAST(u AS INTEGER) AS u, CAST(v AS INTEGER) AS v, {", ".join(f"CAST(greatest(0, least(255, floor(round({c} * 0.85 + l * 0.15, 9)))) AS INTEGER) AS {c}" for c in "rgb")} FROM y""")
def fade_pixels(spark, sf_dir):
    cells = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 50).cast("int").alias("u"), (F.col("o_orderkey") % 50).cast("int").alias("v"))
    pixels = cells.agg((F.max("o_custkey") * 5 % 256).alias("r"), (F.min("o_orderkey") * 7 % 256).alias("g"), (F.count("*") * 40 % 256).alias("b"))
    return raster.faded(pixels, 2)


@query(f"""
WITH v AS ({voxels_sql()}), g AS (SELECT i, j, {dem_sql('(40.0 * (i + 0.5))', '(40.0 * (j + 0.5))')} AS z FROM range(50) a(i), range(50) b(j)),
s AS (SELECT i, j, CAST(greatest(0, least(49, round_even(z / 20.0 - 0.5, 0))) AS BIGINT) AS k FROM g)
SELECT CAST(lith_id AS INTEGER) AS lith_id, count(*) AS n FROM s JOIN v USING (i, j, k) GROUP BY lith_id""")
def surface_units(spark, sf_dir):
    x, y = GRID.centre("x", F.col("i")), GRID.centre("y", F.col("j"))
    top = GRID.columns(spark).select("i", "j", index_nearest(BASE.dem(x, y), 0.0, 20.0, 50).alias("k"))
    return asked_voxels(spark, sf_dir).join(top, ["i", "j", "k"]).groupBy("lith_id").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE c AS ({level_sql(25)}), k AS (SELECT CAST(v * 50 + u AS BIGINT) AS id, u, v, label FROM c),
e AS (SELECT x.id AS a, y.id AS b FROM k x, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) s(a, b) JOIN k y ON y.u = x.u + s.a AND y.v = x.v + s.b AND y.label = x.label),
r(x, y) AS (SELECT id, id FROM k UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y), l AS (SELECT x, min(y) AS component FROM r GROUP BY x)
SELECT component, CAST(label AS INTEGER) AS label, count(*) AS area FROM l JOIN k ON k.id = l.x GROUP BY ALL""")
def components_slice(spark, sf_dir):
    from ..operators.graph import components, grid_edges

    cells = level_cells(spark, sf_dir, 25).withColumn("id", (F.col("v") * 50 + F.col("u")).cast("long"))
    comps = components(grid_edges(cells, eight=False, label="label"))
    return cells.join(comps.withColumnRenamed("node", "id"), "id", "left").groupBy(F.coalesce("component", "id").alias("component"), "label").agg(F.count("*").alias("area"))


@query("""WITH g AS (SELECT o_custkey % 30 AS i, o_orderkey % 25 AS j, max(o_totalprice) / 1000.0 AS ground_z FROM orders GROUP BY ALL), e AS (SELECT a.ground_z AS a, b.ground_z AS b FROM g a JOIN g b ON (b.i = a.i + 1 AND b.j = a.j) OR (b.i = a.i AND b.j = a.j + 1) WHERE a.ground_z <> b.ground_z),
h AS (SELECT unnest(range(CAST(floor(least(a, b) / 50.0) AS BIGINT) + 1, CAST(floor(greatest(a, b) / 50.0) AS BIGINT) + 1)) AS k FROM e) SELECT k * 50.0::DOUBLE AS level, count(*) AS n FROM h GROUP BY k""")
def contour_crossings(spark, sf_dir):
    dem = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 30).alias("u"), (F.col("o_orderkey") % 25).alias("v")).agg((F.max("o_totalprice") / 1000.0).alias("z"))
    return raster.iso_crossings(dem, 50.0).groupBy("level").agg(F.count("*").alias("n"))
