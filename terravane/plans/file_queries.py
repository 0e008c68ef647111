"""Queries that write files from the given tables to the shared folder and read them back with the library's readers, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.graph import shared_folder
from ..sources import readers, writers
from .tables import asked_voxels, exact_sum, table, voxels_sql

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def _documents(df, key: str):
    """Writes one file for each row: the JSON text in column doc, in a folder by key; returns the folder."""
    folder = shared_folder(df.sparkSession)
    df.select(key, "doc").repartition(key).write.partitionBy(key).text(folder)
    return folder


@query("""SELECT CAST(n_nationkey AS INTEGER) AS unit_id, n_name AS name, CASE WHEN n_regionkey = 2 THEN 'water' ELSE 'strata' END AS role,
 CAST(CASE WHEN n_nationkey % 5 = 0 THEN -1 ELSE n_nationkey END AS INTEGER) AS "order", CAST(NULL AS VARCHAR) AS series FROM nation""")
def unit_files(spark, sf_dir):
    """Unit tables as CSV files without all of their columns and values; what is missing is completed."""
    k, folder = F.col("n_nationkey"), shared_folder(spark)
    rows = table(spark, sf_dir, "nation").select(k.alias("unit_id"), F.col("n_name").alias("name"), F.when(F.col("n_regionkey") == 2, "water").alias("role"), F.when(k % 5 != 0, k).alias("order"), F.lit("x").alias("extra"))
    writers.write_table(rows, folder)
    return readers.units_table(spark, folder).select("unit_id", "name", "role", "order", "series")


@query("SELECT CAST(s_suppkey AS INTEGER) AS contact_id, CAST(s_nationkey AS INTEGER) AS unit_a, CAST(s_nationkey + 1 AS INTEGER) AS unit_b, k AS seq, s_acctbal + k AS x, (s_suppkey * k)::DOUBLE AS y FROM supplier, range(3) t(k)")
def contact_documents(spark, sf_dir):
    """Contacts as JSON arrays, a file for each nation; the vertices of their lines."""
    k = F.col("s_suppkey")
    line = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.array((F.col("s_acctbal") + i).cast("double"), (k * i).cast("double")))
    contact = F.struct(k.alias("contact_id"), F.col("s_nationkey").alias("unit_a"), (F.col("s_nationkey") + 1).alias("unit_b"), line.alias("polyline_px"))
    docs = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.to_json(F.collect_list(contact)).alias("doc"))
    rows = readers.json_rows(spark, _documents(docs, "s_nationkey"), readers.CONTACTS)
    vertices = rows.select("contact_id", "unit_a", "unit_b", F.posexplode("polyline_px").alias("seq", "p"))
    return vertices.select("contact_id", "unit_a", "unit_b", F.col("seq").cast("long").alias("seq"), F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


@query("SELECT CAST(s_suppkey AS INTEGER) AS fault_id, 'F' || s_suppkey AS name, s_acctbal AS dip FROM supplier WHERE s_suppkey % 3 = 0")
def fault_documents(spark, sf_dir):
    """Faults as JSON arrays, a file for each nation; the confirmed ones."""
    k = F.col("s_suppkey")
    fault = F.struct(k.alias("fault_id"), F.concat(F.lit("F"), k.cast("string")).alias("name"), F.col("s_acctbal").alias("dip"), (k % 3 == 0).alias("confirmed"))
    docs = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.to_json(F.collect_list(fault)).alias("doc"))
    return readers.confirmed_faults(spark, _documents(docs, "s_nationkey")).select("fault_id", "name", "dip")


@query("SELECT CAST(c_custkey AS INTEGER) AS contour_id, c_acctbal AS elevation FROM customer")
def elevation_documents(spark, sf_dir):
    """Documents with a map from contour numbers to heights, a file for each nation."""
    entries = F.map_from_entries(F.collect_list(F.struct(F.col("c_custkey").cast("string"), "c_acctbal")))
    docs = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.to_json(F.struct(entries.alias("elevations"), F.lit("n").alias("notes"))).alias("doc"))
    return readers.elevations(spark, _documents(docs, "c_nationkey"))


@query("SELECT CASE WHEN c_custkey % 2 = 0 THEN 'section' ELSE 'section2' END AS section, c_mktsegment AS formation, count(*) AS n, CAST(sum(CAST(c_acctbal AS DECIMAL(18, 2))) AS DOUBLE) AS v FROM customer GROUP BY ALL")
def pick_files(spark, sf_dir):
    """Section picks as CSV files of two sections; a third that is not there is skipped."""
    top, k = shared_folder(spark), F.col("c_custkey")
    for name, rest in (("section", 0), ("section2", 1)):
        writers.write_table(table(spark, sf_dir, "customer").where(k % 2 == rest).select(k.alias("u"), F.col("c_acctbal").alias("v"), F.col("c_mktsegment").alias("formation")), f"{top}/{name}")
    rows = readers.pick_tables(spark, {n: f"{top}/{n}" for n in ("section", "section2", "section3")})
    return rows.groupBy("section", "formation").agg(F.count("*").alias("n"), exact_sum("v").alias("v"))


@query("SELECT unnest(['n', 'scores.low', 'scores.high']) AS metric, unnest([count(*)::DOUBLE, min(o_totalprice), max(o_totalprice)]) AS value FROM orders")
def metric_documents(spark, sf_dir):
    """A metrics document with nested numbers and a text, as a table of its numbers."""
    scores = F.struct(F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))
    doc = table(spark, sf_dir, "orders").agg(F.to_json(F.struct(F.count("*").alias("n"), scores.alias("scores"), F.lit("text").alias("note"))).alias("doc")).withColumn("k", F.lit(1))
    return readers.metric_table(spark, _documents(doc, "k"))


@query(f"SELECT CAST(k AS INTEGER) AS k, CAST(lith_id AS INTEGER) AS lith_id, count(*) AS n FROM ({voxels_sql()}) WHERE k BETWEEN 20 AND 22 GROUP BY ALL")
def cube_slabs(spark, sf_dir):
    """Voxels written by slab; three levels are read from the slabs that hold them."""
    folder = shared_folder(spark)
    writers.write_cube(asked_voxels(spark, sf_dir), folder)
    return spark.read.parquet(folder).where("k_slab = 1 and k between 20 and 22").groupBy("k", "lith_id").agg(F.count("*").alias("n"))


@query("""SELECT n_nationkey AS line_no, '| ' || n_nationkey || ' | ' || n_name || ' | ' || CASE WHEN n_regionkey = 1 THEN '' ELSE CAST(n_regionkey AS VARCHAR) END || ' |' AS line FROM nation
UNION ALL SELECT -2, '| n_nationkey | n_name | region |' UNION ALL SELECT -1, '| --- | --- | --- |'""")
def markdown_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.when(F.col("n_regionkey") != 1, F.col("n_regionkey")).alias("region"))
    return writers.markdown(rows, "n_nationkey")
