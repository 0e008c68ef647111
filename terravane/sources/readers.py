"""Sources: images, arrays, JSON documents, constraint tables. All schemas are explicit."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNITS = "unit_id int, name string, role string, `order` int, series string, color_r int, color_g int, color_b int, dip double, azimuth double"
POINTS = "X double, Y double, Z double, formation string"
ORIENTATIONS = "X double, Y double, Z double, azimuth double, dip double, polarity int, formation string"
PICKS = "u double, v double, formation string"
READINGS = "u double, v double, dip double, azimuth double"
LINE = "array<array<double>>"
CONTACTS = f"array<struct<contact_id:int,unit_a:int,unit_b:int,polyline_px:{LINE}>>"
CONTOURS = f"array<struct<contour_id:int,elevation:double,polyline_px:{LINE}>>"
FAULTS = f"array<struct<fault_id:int,name:string,polyline_px:{LINE},dip:double,azimuth:double,length_px:double,straightness:double,n_units_crossed:int,confirmed:boolean>>"
ELEVATIONS = "struct<elevations:map<string,double>,notes:string>"
LITH_META = "struct<extent:array<double>,resolution:array<int>,id_to_name:map<string,string>,name_to_color:map<string,array<int>>,surface_z:array<array<double>>>"


def csv_table(spark: SparkSession, path, schema: str) -> DataFrame:
    """A CSV file or several; columns are matched by the header's names, missing ones are null and others are left out. Values that do not parse are null."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    fields = spark.createDataFrame([], schema).schema.fields
    have = set(raw.columns)
    return raw.select(*[(F.expr(f"try_cast(nullif(trim(`{f.name}`), '') as {f.dataType.simpleString()})") if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields])


def units_table(spark: SparkSession, path) -> DataFrame:
    """Unit rows with defaults: role strata, order -1."""
    out = csv_table(spark, path, UNITS)
    return out.withColumn("role", F.coalesce("role", F.lit("strata"))).withColumn("order", F.coalesce("order", F.lit(-1)))


def pick_tables(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Section picks of several files, told apart by `section`; files that do not exist are skipped."""
    out = spark.createDataFrame([], "section string, " + PICKS)
    for name, path in paths.items():
        if exists(spark, path):
            out = out.unionByName(csv_table(spark, path, PICKS).select(F.lit(name).alias("section"), "*"))
    return out


def json_document(spark: SparkSession, path, kind: str) -> DataFrame:
    """One row per file: path and the parsed document `doc`; a file that does not parse has a null document."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return text.select("path", F.from_json("value", kind).alias("doc"))


def json_rows(spark: SparkSession, path, kind: str) -> DataFrame:
    """Elements of JSON arrays as rows."""
    return json_document(spark, path, kind).select(F.explode("doc").alias("row")).select("row.*")


def confirmed_faults(spark: SparkSession, path: str) -> DataFrame:
    """Confirmed faults; none if the file is missing."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"row {FAULTS[6:-1]}").select("row.*")
    return json_rows(spark, path, FAULTS).where("confirmed")


def elevations(spark: SparkSession, path) -> DataFrame:
    """contour_id and elevation of a document with an elevations map."""
    return json_document(spark, path, ELEVATIONS).select(F.explode("doc.elevations").alias("id", "elevation")).select(F.col("id").cast("int").alias("contour_id"), "elevation")


def lith_names(spark: SparkSession, path) -> DataFrame:
    """lith_id, name, r, g, b of a voxel metadata document."""
    doc = json_document(spark, path, LITH_META)
    named = doc.select(F.explode("doc.id_to_name").alias("id", "name"), "doc")
    colour = F.col("doc.name_to_color")[F.col("name")]
    return named.select(F.col("id").cast("int").alias("lith_id"), "name", *[F.get(colour, F.lit(i)).alias(c) for i, c in enumerate("rgb")])


def array_cells(spark: SparkSession, path) -> DataFrame:
    """Cells of .npy arrays: path, index (array of the cell's place), value; files are read by Spark and unpacked in slabs."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                array = np.load(io.BytesIO(content), allow_pickle=False)
                flat = array.reshape(-1)
                for a in range(0, len(flat), 1 << 16):
                    part = flat[a : a + (1 << 16)]
                    at = np.stack(np.unravel_index(np.arange(a, a + len(part)), array.shape), 1).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(list(at), pa.list_(pa.int32())), pa.array(part.astype(float), pa.float64())], ["path", "index", "value"])

    return files.mapInArrow(run, "path string, index array<int>, value double")


def image_pixels(spark: SparkSession, path) -> DataFrame:
    """Pixels of images: path, u, v, r, g, b (the source holds rows of blue, green, red)."""
    images = spark.read.format("image").option("dropInvalid", True).load(path).select("image.origin", "image.width", "image.nChannels", "image.data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                data = np.frombuffer(r["data"], np.uint8).reshape(-1, r["nChannels"])
                data = np.repeat(data, 3, 1) if r["nChannels"] == 1 else data
                n = np.arange(len(data), dtype=np.int32)
                columns = [pa.array([r["origin"]] * len(data)), pa.array(n % r["width"]), pa.array(n // r["width"]), *[pa.array(data[:, k].astype(np.int16)) for k in (2, 1, 0)]]
                yield pa.RecordBatch.from_arrays(columns, ["path", "u", "v", "r", "g", "b"])

    return images.mapInArrow(run, "path string, u int, v int, r short, g short, b short")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def cases(spark: SparkSession, top: str, marker: str) -> DataFrame:
    """Folders below `top` that hold the marker file."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", marker).option("recursiveFileLookup", True).load(top)
    return found.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("case_id")).distinct()


def lines_of_text(spark: SparkSession, text: str, schema: str) -> DataFrame:
    """Rows of pasted comma-separated text (full-width commas count); rows whose numbers do not parse are dropped."""
    fields = spark.createDataFrame([], schema).schema.fields
    rows = spark.createDataFrame([(line,) for line in text.splitlines() if line.strip()], "line string")
    parts = F.split(F.translate("line", "，", ","), ",")
    out = rows.select(*[F.expr(f"try_cast(trim(get(split(translate(line, '，', ','), ','), {i})) as {f.dataType.simpleString()})").alias(f.name) for i, f in enumerate(fields)], F.size(parts).alias("_n"))
    return out.where(F.col("_n") >= len(fields)).drop("_n").na.drop()


def gallery(spark: SparkSession, top: str, wanted: DataFrame) -> DataFrame:
    """case_id, name, path of the files below `top` whose name is among the wanted ones (name), in order of the case and name."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(top).select("path")
    parts = found.select(F.regexp_extract("path", r"([^/]+)/[^/]+/[^/]+$", 1).alias("case_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "path")
    return parts.join(wanted.select("name").distinct(), "name", "left_semi").select("case_id", "name", "path")


def metric_table(spark: SparkSession, path: str) -> DataFrame:
    """metric, value: the numbers of a metrics document, with the names of nested ones joined by dots; read as text, so any nesting will do."""
    whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("doc"))
    top = whole.select(F.explode(F.from_json(F.to_json("doc"), "map<string,string>")).alias("metric", "value"))
    inner = F.from_json("value", "map<string,string>")
    nested = top.where(F.col("value").startswith("{")).select(F.col("metric").alias("_m"), F.explode(inner).alias("_k", "value")).select(F.concat_ws(".", "_m", "_k").alias("metric"), "value")
    flat = top.where(~F.col("value").startswith("{")).unionByName(nested)
    return flat.select("metric", F.col("value").try_cast("double").alias("value")).where("value is not null")


def stage_upload(spark: SparkSession, upload: str, case_folder: str) -> str:
    """Empties a case folder and copies one uploaded file into it as input/map with the upload's ending; returns the new path."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source, folder = jvm.org.apache.hadoop.fs.Path(upload), jvm.org.apache.hadoop.fs.Path(case_folder)
    name = source.getName()
    target = jvm.org.apache.hadoop.fs.Path(folder, "input/map" + name[name.rfind(".") :] if "." in name else "input/map")
    files = folder.getFileSystem(conf)
    files.delete(folder, True)
    files.mkdirs(target.getParent())
    jvm.org.apache.hadoop.fs.FileUtil.copy(source.getFileSystem(conf), source, files, target, False, conf)
    return target.toString()
