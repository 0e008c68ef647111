"""Ordered-sequence queries on the driver tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import constraints, sequences
from .tables import PATHS_SQL, paths, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


RUNS_SQL = """
WITH m AS (SELECT user_id, ts, event_id, event_type, row_number() OVER w AS pos,
    CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS ch
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run_no FROM m),
s AS (SELECT user_id, CAST(run_no AS BIGINT) AS run_no, any_value(event_type) AS event_type, CAST(min(pos) AS INTEGER) AS first_pos, CAST(max(pos) AS INTEGER) AS last_pos, count(*) AS n
  FROM r GROUP BY user_id, run_no)
"""


def _runs(spark, sf_dir):
    return sequences.run_length_segments(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@query(RUNS_SQL + "SELECT * FROM s")
def runlength_events(spark, sf_dir):
    return _runs(spark, sf_dir)


@query(RUNS_SQL + "SELECT user_id, run_no, event_type, CAST(CASE WHEN run_no = 1 THEN least(n, user_id % 3 + 1) ELSE n END AS BIGINT) AS n FROM s")
def runlength_top_clip(spark, sf_dir):
    cut = F.when(F.col("run_no") == 1, F.least("n", F.col("user_id") % 3 + 1)).otherwise(F.col("n"))
    return _runs(spark, sf_dir).select("user_id", "run_no", "event_type", cut.cast("bigint").alias("n"))


@query("""
WITH m AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, event_id FROM m WHERE (rn - 1) % CAST(ceil(n / 260.0) AS BIGINT) = 0""")
def stride_thin(spark, sf_dir):
    return sequences.stride_thin(table(spark, sf_dir, "events").select("event_type", "event_id"), ["event_type"], ["event_id"], 260, spread=True)


@query("""
WITH m AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events)
SELECT event_type, event_id FROM m WHERE (rn - 1) % 3 = 0""")
def every_nth(spark, sf_dir):
    return sequences.every_nth(table(spark, sf_dir, "events").select("event_type", "event_id"), ["event_type"], ["event_id"], 3, spread=True)


@query("""
WITH m AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, event_id, fraction FROM m, (VALUES (0.15::DOUBLE), (0.5::DOUBLE), (0.85::DOUBLE)) f(fraction) WHERE rn - 1 = floor(fraction * (n - 1))""")
def quantile_pick(spark, sf_dir):
    return sequences.pick_at(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], ["event_id"], [0.15, 0.5, 0.85])


ARC_SQL = f"""
WITH p AS ({PATHS_SQL}),
d AS (SELECT user_id, seq, x, y, coalesce(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)), 0.0) AS step FROM p WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
a AS (SELECT user_id, seq, x, y, sum(step) OVER (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS s FROM d)
"""


@query(ARC_SQL + "SELECT user_id, round(max(s), 4) AS length, count(*) AS n FROM a GROUP BY user_id")
def arc_length(spark, sf_dir):
    located = sequences.with_arc_length(paths(spark, sf_dir), ["user_id"], ["seq"], "x", "y")
    return located.groupBy("user_id").agg(F.round(F.max("s"), 4).alias("length"), F.count("*").alias("n"))


@query(ARC_SQL + "SELECT user_id, seq, round(s, 4) AS s FROM a")
def cum_arc_length(spark, sf_dir):
    return sequences.with_arc_length(paths(spark, sf_dir), ["user_id"], ["seq"], "x", "y").select("user_id", "seq", F.round("s", 4).alias("s"))


@query(ARC_SQL + """
, b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS pos, max(s) OVER (PARTITION BY user_id) AS total FROM a),
g AS (SELECT user_id, s, x, y, pos, total, lag(s) OVER w AS s0, lag(x) OVER w AS x0, lag(y) OVER w AS y0, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS back FROM b WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
t AS (SELECT user_id, pos, unnest(range(CAST(floor(s0 / 250.0) AS BIGINT) + 1, CAST(least(floor(s / 250.0), ceil(total / 250.0) - 1) AS BIGINT) + 1)) AS k FROM g WHERE pos > 1)
SELECT user_id, CAST(0 AS BIGINT) AS seq, 0.0::DOUBLE AS s, round(x, 4) AS x, round(y, 4) AS y FROM g WHERE pos = 1
UNION ALL SELECT g.user_id, k, round(k * 250.0, 4), round(x0 + (k * 250.0 - s0) / (s - s0) * (x - x0), 4), round(y0 + (k * 250.0 - s0) / (s - s0) * (y - y0), 4) FROM t JOIN g USING (user_id, pos)
UNION ALL SELECT user_id, CAST(ceil(total / 250.0) AS BIGINT), round(total, 4), round(x, 4), round(y, 4) FROM g WHERE back = 1 AND total > 0""")
def resample_path(spark, sf_dir):
    out = sequences.resample(paths(spark, sf_dir), ["user_id"], ["seq"], "x", "y", 250.0)
    return out.select("user_id", "seq", *[F.round(c, 4).alias(c) for c in ("s", "x", "y")])


@query(f"""
WITH p AS ({PATHS_SQL}), m AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM p),
w AS (SELECT *, unnest(range(CAST(greatest(0, ceil((i - 11) / 6.0)) AS BIGINT), CAST(least(floor(i / 6.0), greatest(floor((n - 12) / 6.0), 0)) AS BIGINT) + 1)) AS window_no FROM m WHERE n >= 4)
SELECT user_id, window_no, count(*) AS n, round((avg(x * y) - avg(x) * avg(y)) / nullif(avg(x * x) - avg(x) * avg(x), 0), 3) AS slope FROM w GROUP BY user_id, window_no""")
def sliding_window_fit(spark, sf_dir):
    spread = sequences.sliding_windows(paths(spark, sf_dir), ["user_id"], ["seq"], 12, 4)
    slope = (F.avg(F.col("x") * F.col("y")) - F.avg("x") * F.avg("y")) / F.nullif(F.avg(F.col("x") * F.col("x")) - F.avg("x") * F.avg("x"), F.lit(0.0))
    return spread.groupBy("user_id", "window_no").agg(F.count("*").alias("n"), F.round(slope, 3).alias("slope"))


@query(f"""
WITH p AS ({PATHS_SQL}), c AS (SELECT user_id, seq, y, sign(y - 50.0) AS sg, lag(sign(y - 50.0)) OVER (PARTITION BY user_id ORDER BY seq) AS before FROM p)
SELECT user_id, min(seq) AS seq FROM c WHERE before IS NOT NULL AND sg <> before GROUP BY user_id""")
def first_crossing(spark, sf_dir):
    found = sequences.first_sign_change(paths(spark, sf_dir), ["user_id"], ["seq"], F.col("y") - 50.0)
    return found.select("user_id", "seq")


@query("""
WITH m AS (SELECT l_returnflag AS flag, l_quantity AS x, l_discount * 100 AS y, l_extendedprice / 1000 AS z FROM lineitem),
a AS (SELECT flag, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM m GROUP BY flag),
s AS (SELECT flag, count(*) AS n, max(z) - min(z) AS relief, sum((x-mx)*(x-mx)) AS sxx, sum((x-mx)*(y-my)) AS sxy, sum((y-my)*(y-my)) AS syy, sum((x-mx)*(z-mz)) AS sxz, sum((y-my)*(z-mz)) AS syz, sum((z-mz)*(z-mz)) AS szz FROM m JOIN a USING (flag) GROUP BY flag),
f AS (SELECT *, (sxz*syy - syz*sxy) / (sxx*syy - sxy*sxy) AS a, (syz*sxx - sxz*sxy) / (sxx*syy - sxy*sxy) AS b FROM s),
g AS (SELECT *, sqrt(greatest(0.0, szz - a*sxz - b*syz) / n) AS rms FROM f)
SELECT flag, n, round(a, 4) AS a, round(b, 4) AS b, round(degrees(atan(sqrt(a*a + b*b))), 3) AS dip,
  round(sqrt((sxx + syy - sqrt((sxx - syy)*(sxx - syy) + 4*sxy*sxy)) / 2), 3) AS spread, round(rms, 4) AS rms, round(relief / (rms + 3.0), 4) AS score FROM g""")
def plane_fit(spark, sf_dir):
    points = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_extendedprice") / 1000).alias("z"))
    fit = constraints.plane_fit(points, ["flag"])
    return fit.select("flag", "n", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"), F.round("dip", 3).alias("dip"), F.round("spread", 3).alias("spread"), F.round("rms", 4).alias("rms"), F.round("score", 4).alias("score"))


@query("""
WITH g AS (SELECT event_id, (value - 50) / 40.0 AS a, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100.0 - 0.35 AS b FROM events), d AS (SELECT event_id, a, b, degrees(atan2(-a, -b)) AS z FROM g)
SELECT event_id, round(degrees(atan(sqrt(a*a + b*b))), 4) AS dip, round(z - floor(z / 360.0) * 360.0, 4) AS azimuth FROM d""")
def dip_azimuth(spark, sf_dir):
    from ..functions.exprs import dip_azimuth as angles

    k = F.get_json_object("props", "$.k").cast("double")
    g = table(spark, sf_dir, "events").select("event_id", ((F.col("value") - 50) / 40.0).alias("a"), (k / 100.0 - 0.35).alias("b"))
    dip, azimuth = angles(F.col("a"), F.col("b"))
    return g.select("event_id", F.round(dip, 4).alias("dip"), F.round(azimuth, 4).alias("azimuth"))
