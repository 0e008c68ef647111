"""Views that the queries share: driver tables cast to plain types, and analytic inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import Grid, scenarios

BASE = scenarios()["base"]
GRID = Grid()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exact_sum(column: str) -> Column:
    """The sum of a column of two decimals, added up in decimals, so that it does not depend on the order of rows."""
    return F.sum(F.col(column).cast("decimal(18,2)")).cast("double")


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a path: seq by event id, x the number in props, y the value."""
    props = F.get_json_object("props", "$.k").cast("double")
    return table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), props.alias("x"), F.col("value").alias("y"))


PATHS_SQL = "SELECT user_id, event_id AS seq, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS x, value AS y FROM events"


def slice_cells(spark: SparkSession, z_index: int) -> DataFrame:
    """A level of the base scenario as cells: u, v, label."""
    x, y = GRID.centre("x", F.col("i")), GRID.centre("y", F.col("j"))
    z = F.lit(GRID.z0 + (z_index + 0.5) * GRID.steps[2])
    return GRID.columns(spark).select(F.col("i").alias("u"), F.col("j").alias("v"), BASE.unit_id(x, y, z).alias("label"))


def _sql_rise(x: str, y: str, z: str, s) -> str:
    import math

    fold = f"{s.fold_amp} * cos(2.0 * pi() * ({x} - {s.fold_phase}) / {s.fold_wavelength}) + {s.cross_amp} * cos(2.0 * pi() * ({y} - {s.cross_phase}) / {s.cross_wavelength})"
    out = f"({s.slope!r}) * ({x} - {s.x_center}) + {fold}"
    if s.fault:
        fx, fz, dip, throw = s.fault
        out += f" - CASE WHEN {x} > {fx} + ({fz} - {z}) / {math.tan(math.radians(dip))!r} THEN {throw} ELSE 0.0 END"
    return out


def unit_sql(x: str, y: str, z: str, s=BASE) -> str:
    """The unit at a point, written out for the oracle."""
    rise = _sql_rise(x, y, z, s)
    whens = " ".join(f"WHEN {z} >= {base} + ({rise}) THEN {i}" for i, (_, base, _) in enumerate(s.layers))
    return f"(CASE {whens} ELSE {len(s.layers)} END)"


def dem_sql(x: str, y: str, s=BASE) -> str:
    if s.flat:
        return f"CAST({s.dem_base} AS DOUBLE)"
    (a1, a2, a3), (w1, w2, w3) = s.dem_amps, s.dem_waves
    z = (
        f"{s.dem_base} + {a1} * sin(2.0 * pi() * {x} / {w1}) + {a2} * cos(2.0 * pi() * {y} / {w2}) + {a3} * sin(2.0 * pi() * ({x} + 0.6 * {y}) / {w3})"
        f" + 25.0 * cos(2.0 * pi() * {x} / 600.0) * sin(2.0 * pi() * {y} / 800.0)"
    )
    if s.fault:
        z += f" - 45.0 * exp(-(({x} - {s.fault[0]}) * ({x} - {s.fault[0]})) / 64800.0)"
    return f"greatest({s.z_range[0] + 80.0}, least({s.z_range[1] - 40.0}, {z}))"


def asked_voxels(spark: SparkSession, sf_dir: str, s=BASE, whole: bool = False) -> DataFrame:
    """i, j, k, lith_id, below of the voxels of the 50-cell grid that the rows of lineitem fall into, or of their whole columns."""
    cell = lambda c, name: (F.col(c) % 50).cast("int").alias(name)
    asked = table(spark, sf_dir, "lineitem").select(cell("l_partkey", "i"), cell("l_suppkey", "j"), cell("l_orderkey", "k")).distinct()
    if whole:
        asked = asked.select("i", "j").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(49))))
    x, y, z = (GRID.centre(a, F.col(c)) for a, c in zip("xyz", "ijk", strict=True))
    return asked.select("i", "j", "k", s.unit_id(x, y, z).alias("lith_id"), (z <= s.dem(x, y)).alias("below"))


def level_cells(spark: SparkSession, sf_dir: str, shift: int) -> DataFrame:
    """u, v, label: a raster of the lineitem rows in 50 by 50 cells, blocks of labels with ragged edges by the number of rows."""
    rows = table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 50).cast("int").alias("u"), ((F.col("l_suppkey") * 7 + F.col("l_linenumber")) % 50).cast("int").alias("v")).agg(F.count("*").alias("n"))
    return rows.select("u", "v", F.expr(f"cast((u div 8 + v div 8 + (n + {shift}) % 5 div 3) % 4 as int)").alias("label"))


def level_sql(shift: int) -> str:
    return f"SELECT u, v, (u // 8 + v // 8 + (n + {shift}) % 5 // 3) % 4 AS label FROM (SELECT l_partkey % 50 AS u, (l_suppkey * 7 + l_linenumber) % 50 AS v, count(*) AS n FROM lineitem GROUP BY ALL)"


def voxels_sql(s=BASE, whole: bool = False) -> str:
    """As asked_voxels()."""
    x, y, z = "(40.0 * (i + 0.5))", "(40.0 * (j + 0.5))", "(20.0 * (k + 0.5))"
    return (
        f"SELECT i, j, k, {unit_sql(x, y, z, s)} AS lith_id, {z} <= {dem_sql(x, y, s)} AS below "
        + ("FROM (SELECT DISTINCT l_partkey % 50 AS i, l_suppkey % 50 AS j FROM lineitem), range(50) c(k)" if whole else "FROM (SELECT DISTINCT l_partkey % 50 AS i, l_suppkey % 50 AS j, l_orderkey % 50 AS k FROM lineitem)")
    )


def ground_sql() -> str:
    x, y = "(i * (2000.0 / 49))", "(j * (2000.0 / 49))"
    return f"SELECT i, j, {dem_sql(x, y)} AS ground_z FROM range(50) a(i), range(50) b(j)"
