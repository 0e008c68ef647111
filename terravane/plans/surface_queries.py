"""Queries on triangulated surfaces, contour lines, traced lines and array files, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import contours, raster, triangles, vector
from .tables import exact_sum, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---- triangulated surfaces


def _sites(spark, sf_dir):
    """case_id, id, x, y, z of the suppliers, in a square of as many cells a side as the root of the number of parts."""
    n = float(int(table(spark, sf_dir, "part").count() ** 0.5))
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 2).alias("case_id"), k.alias("id"), ((F.col("s_acctbal") + 1000.0) / 11000.0 * n).alias("x"), ((k * 61 % 97 + k * 0.0013) / 98.0 * n).alias("y"), (k % 50).cast("double").alias("z")), int(n)


#: All triples of sites whose circle through them holds no other site.
SITES = """n AS (SELECT CAST(floor(sqrt(count(*))) AS BIGINT) AS n FROM part),
s AS (SELECT s_nationkey % 2 AS case_id, s_suppkey AS id, (s_acctbal + 1000.0) / 11000.0 * n AS x, (s_suppkey * 61 % 97 + s_suppkey * 0.0013::DOUBLE) / 98.0 * n AS y, (s_suppkey % 50)::DOUBLE AS z FROM supplier, n),
t AS (SELECT a.case_id, a.id AS a, b.id AS b, c.id AS c, a.x AS ax, a.y AS ay, a.z AS az, b.x - a.x AS px, b.y - a.y AS py, b.z - a.z AS pz, c.x - a.x AS qx, c.y - a.y AS qy, c.z - a.z AS qz FROM s a JOIN s b ON b.case_id = a.case_id AND b.id > a.id JOIN s c ON c.case_id = a.case_id AND c.id > b.id),
o AS (SELECT *, (qy * (px * px + py * py) - py * (qx * qx + qy * qy)) / (2 * (px * qy - py * qx)) AS ux, (px * (qx * qx + qy * qy) - qx * (px * px + py * py)) / (2 * (px * qy - py * qx)) AS uy FROM t WHERE px * qy <> py * qx),
d AS (SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.case_id = o.case_id AND s.id NOT IN (o.a, o.b, o.c) AND (s.x - ax - ux) * (s.x - ax - ux) + (s.y - ay - uy) * (s.y - ay - uy) < ux * ux + uy * uy))"""


@query(f"WITH {SITES} SELECT case_id, a, b, c FROM d")
def tin_triangles(spark, sf_dir):
    return triangles.triangulate(_sites(spark, sf_dir)[0]).select("case_id", F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("c.id").alias("c"))


@query(f"""WITH {SITES}, g AS (SELECT c.i AS case_id, u.i AS u, v.i AS v FROM n, range(2) c(i), range(n) u(i), range(n) v(i) WHERE EXISTS (SELECT 1 FROM s WHERE s.case_id = c.i)),
w AS (SELECT g.case_id, u, v, az, pz, qz, ((u - ax) * qy - (v - ay) * qx) / (px * qy - py * qx) AS wb, (px * (v - ay) - py * (u - ax)) / (px * qy - py * qx) AS wc FROM g JOIN d USING (case_id)),
i AS (SELECT case_id, u, v, avg(az + wb * pz + wc * qz) AS z FROM w WHERE wb >= 0 AND wc >= 0 AND wb + wc <= 1 GROUP BY ALL),
f AS (SELECT g.case_id, u, v, min(struct_pack(d := (s.x - u) * (s.x - u) + (s.y - v) * (s.y - v), z := s.z)).z AS z FROM g JOIN s USING (case_id) GROUP BY ALL)
SELECT case_id, CAST(u AS INTEGER) AS u, CAST(v AS INTEGER) AS v, round(coalesce(i.z, f.z), 4) AS z FROM f LEFT JOIN i USING (case_id, u, v)""")
def tin_heights(spark, sf_dir):
    sites, n = _sites(spark, sf_dir)
    line = lambda: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cells = sites.select("case_id").distinct().withColumn("u", line()).withColumn("v", line())
    return triangles.heights(cells, sites).select("case_id", "u", "v", F.round("z", 4).alias("z"))


# ---- contours


def _heights(spark, sf_dir):
    """case_id, u, v, z: the largest order of each of 30 by 25 cells, in two cases."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy((F.col("o_orderkey") % 2).alias("case_id"), (F.col("o_custkey") % 30).alias("u"), (F.col("o_orderkey") % 25).alias("v")).agg(F.max("o_totalprice").alias("z"))


HEIGHTS = "h AS (SELECT o_orderkey % 2 AS case_id, o_custkey % 30 AS u, o_orderkey % 25 AS v, max(o_totalprice) AS z FROM orders GROUP BY ALL)"


@query(f"""WITH {HEIGHTS},
q AS (SELECT a.case_id, a.u, a.v, a.z AS z0, b.z AS z1, c.z AS z2, d.z AS z3 FROM h a JOIN h b ON b.case_id = a.case_id AND b.u = a.u AND b.v = a.v + 1 JOIN h c ON c.case_id = a.case_id AND c.u = a.u + 1 AND c.v = a.v JOIN h d ON d.case_id = a.case_id AND d.u = a.u + 1 AND d.v = a.v + 1),
l AS (SELECT *, unnest(range(CAST(floor(least(z0, z1, z2, z3) / 50000.0) AS BIGINT) + 1, CAST(floor(greatest(z0, z1, z2, z3) / 50000.0) AS BIGINT) + 1)) * 50000.0::DOUBLE AS level FROM q),
e AS (SELECT *, CASE WHEN (z0 >= level) <> (z2 >= level) THEN [u + (level - z0) / (z2 - z0), v] END AS lower, CASE WHEN (z0 >= level) <> (z1 >= level) THEN [u, v + (level - z0) / (z1 - z0)] END AS first,
 CASE WHEN (z1 >= level) <> (z3 >= level) THEN [u + (level - z1) / (z3 - z1), v + 1] END AS upper, CASE WHEN (z2 >= level) <> (z3 >= level) THEN [u + 1, v + (level - z2) / (z3 - z2)] END AS last FROM l),
m AS (SELECT *, list_filter([lower, first, upper, last], lambda x: x IS NOT NULL) AS met, ((z0 + z1 + z2 + z3) / 4.0 >= level) = (z0 >= level) AS joined FROM e),
s AS (SELECT case_id, level, unnest(CASE WHEN len(met) = 2 THEN [[met[1], met[2]]] WHEN joined THEN [[lower, last], [first, upper]] ELSE [[lower, first], [last, upper]] END) AS s FROM m),
r AS (SELECT case_id, level, list_sort([[round(s[1][1], 4), round(s[1][2], 4)], [round(s[2][1], 4), round(s[2][2], 4)]]) AS s FROM s)
SELECT case_id, level, s[1][1] AS u0, s[1][2] AS v0, s[2][1] AS u1, s[2][2] AS v1 FROM r""")
def contour_lines(spark, sf_dir):
    """The stretches between neighbouring vertices of each contour line, and the one that closes a closed line, are the pieces that the squares hold."""
    lines = contours.iso_lines(_heights(spark, sf_dir), 50000.0)
    w = Window.partitionBy("case_id", "level", "line").orderBy("seq")
    at = F.struct(F.round("u", 4).alias("u"), F.round("v", 4).alias("v"))
    ahead = lines.withColumn("p", at).withColumn("q", F.lead("p").over(w)).withColumn("q", F.when(F.col("q").isNull() & F.col("closed"), F.first("p").over(w)).otherwise(F.col("q"))).where("q is not null")
    return ahead.select("case_id", "level", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).select("case_id", "level", F.col("p.u").alias("u0"), F.col("p.v").alias("v0"), F.col("q.u").alias("u1"), F.col("q.v").alias("v1"))


# ---- traced lines


@query("""
WITH b AS (SELECT s_nationkey % 3 AS case_id, s_suppkey * 4 AS v, CAST(floor(s_acctbal) AS BIGINT) AS u0, CAST(floor(s_acctbal) AS BIGINT) + 20 + s_nationkey AS u1 FROM supplier)
SELECT case_id, u0::DOUBLE AS x0, v::DOUBLE AS y0, u1::DOUBLE AS x1, v::DOUBLE AS y1 FROM b""")
def traced_bars(spark, sf_dir):
    """Bars of one row of cells, a supplier each, in three images; traced in tiles, each is a line between its two ends."""
    bars = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 3).alias("case_id"), (F.col("s_suppkey") * 4).alias("v"), F.floor("s_acctbal").alias("_a"), (F.col("s_nationkey") + 20).alias("_n"))
    mask = bars.withColumn("u", F.explode(F.sequence(F.col("_a"), F.col("_a") + F.col("_n"))))
    lines = vector.mask_to_lines(mask, ["case_id"], 15.0, 1.5, most=0)
    ends = lines.groupBy("case_id", "line_no").agg(F.min(F.struct("x", "y")).alias("a"), F.max(F.struct("x", "y")).alias("b"), F.count("*").alias("_n")).where("_n = 2")
    return ends.select("case_id", F.col("a.x").alias("x0"), F.col("a.y").alias("y0"), F.col("b.x").alias("x1"), F.col("b.y").alias("y1"))


# ---- array files


@query("""
WITH c AS (SELECT unnest([0, 1, 2]) AS j, unnest([l_partkey::DOUBLE, l_quantity::DOUBLE, l_extendedprice::DOUBLE]) AS value FROM lineitem)
SELECT CAST(j AS BIGINT) AS j, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS total, max(value) AS most FROM c GROUP BY j""")
def array_files(spark, sf_dir):
    """Columns of lineitem, written as array files by the tasks that hold them and read back in slabs."""
    from ..operators.graph import shared_folder
    from ..sources.arrays import read_arrays, write_arrays

    folder = shared_folder(spark)
    write_arrays(table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice"), folder)
    return read_arrays(spark, folder).groupBy("j").agg(F.count("*").alias("n"), exact_sum("value").alias("total"), F.max("value").alias("most"))


# ---- wide smoothing


@query(f"""WITH {HEIGHTS}, b AS (SELECT case_id, u, v, CASE WHEN (u + v) % 3 > 0 THEN z / 1000.0 ELSE 0.0 END AS s, CASE WHEN (u + v) % 3 > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS w FROM h),
r AS (SELECT a.case_id, a.u, a.v, sum(b.s * exp(-(a.u - b.u) * (a.u - b.u) / 18.0)) AS s, sum(b.w * exp(-(a.u - b.u) * (a.u - b.u) / 18.0)) AS w FROM b a JOIN b ON b.case_id = a.case_id AND b.v = a.v AND abs(a.u - b.u) <= 12 GROUP BY ALL),
c AS (SELECT a.case_id, a.u, a.v, sum(b.s * exp(-(a.v - b.v) * (a.v - b.v) / 18.0)) AS s, sum(b.w * exp(-(a.v - b.v) * (a.v - b.v) / 18.0)) AS w FROM r a JOIN r b ON b.case_id = a.case_id AND b.u = a.u AND abs(a.v - b.v) <= 12 GROUP BY ALL)
SELECT case_id, CAST(u AS INTEGER) AS u, CAST(v AS INTEGER) AS v, CASE WHEN w > 1e-12 THEN round(s / w, 4) END AS z FROM c""")
def masked_smoothing(spark, sf_dir):
    """Heights of two thirds of the cells, averaged with Gaussian weights over all cells."""
    cells = _heights(spark, sf_dir).select("case_id", "u", "v", (F.col("z") / 1000.0).alias("z"), ((F.col("u") + F.col("v")) % 3 > 0).alias("use"))
    return raster.wide_smooth(cells, 3.0, "z", "use", ("case_id",)).select("case_id", "u", "v", F.round("z", 4).alias("z"))
