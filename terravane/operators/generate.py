"""Synthetic cases from analytic scenarios: truth tables, drawn symbols and picks, rivers, traces, label places."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import GeoRef, SectionFrame
from .contours import labelled_components
from .graph import cut_lineage
from .grid import Grid, Scenario, surface, truth_voxels
from .raster import offsets
from .sequences import first_sign_change, with_arc_length
from .spatial import nearest_distances


def pixels(spark: SparkSession, width: int, height: int) -> DataFrame:
    """u, v of all cells of an image, from one range."""
    return spark.range(width * height).select((F.col("id") % width).cast("int").alias("u"), F.expr(f"cast(id div {width} as int)").alias("v"))


def map_truth(spark: SparkSession, scenario: Scenario, georef: GeoRef) -> DataFrame:
    """u, v, x, y, z, label: the unit that crops out at each cell of a map."""
    x, y = georef.to_world(F.col("u"), F.col("v"))
    placed = pixels(spark, georef.img_w, georef.img_h).select("u", "v", x.alias("x"), y.alias("y")).withColumn("z", scenario.dem(F.col("x"), F.col("y")))
    return placed.withColumn("label", scenario.unit_id(F.col("x"), F.col("y"), F.col("z")))


def dip_reading(a: Column, b: Column) -> tuple[Column, Column]:
    """Dip and azimuth of a plane with slopes a and b, to two decimals; planes flatter than 1e-6 have dip 0 and azimuth 90."""
    flat = F.sqrt(a * a + b * b) < 1e-6
    azimuth = F.degrees(F.atan2(-a, -b))
    return F.when(flat, 0.0).otherwise(F.bround(F.degrees(F.atan(F.sqrt(a * a + b * b))), 2)), F.when(flat, 90.0).otherwise(F.bround(azimuth - F.floor(azimuth / 360.0) * 360.0, 2))


def dip_symbols(truth: DataFrame, scenario: Scenario, per_unit: int, seed: int = 0, least: float = 1.0) -> DataFrame:
    """u, v, label, dip, azimuth: readings at cells of each layer that a hash picks; the basement has none, and flat readings are left out."""
    a, b = scenario.gradient(F.col("x"), F.col("y"))
    dip, azimuth = dip_reading(a, b)
    steep = truth.where(F.col("label") < len(scenario.layers)).withColumn("dip", dip).withColumn("azimuth", azimuth).where(F.col("dip") >= least)
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("u", "v", F.lit(seed)), "u", "v"))
    return steep.withColumn("_r", rank).where(F.col("_r") <= per_unit).select("u", "v", "label", "dip", "azimuth")


def layer_points(spark: SparkSession, scenario: Scenario, n: int) -> DataFrame:
    """x, y, z, formation: the base of every layer at n by n even nodes, where it is inside the block and not above the terrain."""
    x0, x1, y0, y1 = scenario.world
    nodes = pixels(spark, n, n).select((x0 + F.col("u") * ((x1 - x0) / (n - 1))).alias("x"), (y0 + F.col("v") * ((y1 - y0) / (n - 1))).alias("y"))
    z = F.array(*[F.struct(F.lit(name).alias("formation"), scenario.bottom(k, F.col("x"), F.col("y")).alias("z")) for k, (name, _, _) in enumerate(scenario.layers)])
    every = nodes.withColumn("_l", F.explode(z)).select("x", "y", "_l.z", "_l.formation")
    return every.where(F.col("z").between(*scenario.z_range) & (F.col("z") <= scenario.dem(F.col("x"), F.col("y")))).select(*[F.bround(c, 2).alias(c) for c in "xyz"], "formation")


def layer_orientations(points: DataFrame, scenario: Scenario) -> DataFrame:
    a, b = scenario.gradient(F.col("x"), F.col("y"))
    dip, azimuth = dip_reading(a, b)
    return points.select("x", "y", "z", azimuth.alias("azimuth"), dip.alias("dip"), F.lit(1).alias("polarity"), "formation")


def fault_trace(truth: DataFrame, scenario: Scenario) -> DataFrame:
    """v, u: the first cell of each row of a map beyond the fault; rows that it does not cross have none."""
    beyond = F.col("x") - scenario.fault_x(F.col("z"))
    return first_sign_change(truth.select("v", "u", "x", "z"), ["v"], ["u"], beyond).select("v", "u")


def fault_plane_points(spark: SparkSession, scenario: Scenario, n: int) -> DataFrame:
    """x, y, z of n by n points of the fault plane inside the block and not above the terrain."""
    _, _, y0, y1 = scenario.world
    z0, z1 = scenario.z_range
    at = pixels(spark, n, n).select((y0 + (F.col("u") + 0.5) * ((y1 - y0) / n)).alias("y"), (z0 + (F.col("v") + 0.5) * ((z1 - z0) / n)).alias("z"))
    placed = at.withColumn("x", scenario.fault_x(F.col("z")))
    return placed.where(F.col("x").between(scenario.world[0], scenario.world[1]) & (F.col("z") <= scenario.dem(F.col("x"), F.col("y")))).select(*[F.bround(c, 2).alias(c) for c in "xyz"])


def dashed(paths: DataFrame, path: Sequence[str], order: str, on: float, off: float, x: str = "x", y: str = "y") -> DataFrame:
    """Vertices of paths with dash_no, for those on a dash: stretches of `on` of arc length with gaps of `off` between them."""
    located = with_arc_length(paths, list(path), [order], x, y, "_s")
    period = on + off
    return located.where(F.col("_s") - F.floor(F.col("_s") / period) * period < on).withColumn("dash_no", F.floor(F.col("_s") / period).cast("long")).drop("_s")


def section_edges(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, u, v, kind: cells of a drawn section (u, v, label; null above ground) whose upper neighbour differs: 'ground' at the terrain, 'contact' between two units below it."""
    w = Window.partitionBy(*by, "u").orderBy("v")
    marked = cells.withColumn("_up", F.lag("label").over(w)).withColumn("_first", F.row_number().over(w) == 1)
    kind = F.when(F.col("_first") | F.col("label").isNull(), None).when(F.col("_up").isNull(), "ground").when(F.col("_up") != F.col("label"), "contact")
    return marked.withColumn("kind", kind).where("kind is not null").select(*by, "u", "v", "kind")


def steepest(heights: DataFrame) -> DataFrame:
    """u, v, nu, nv: each cell and its lowest neighbour of eight, itself if none is lower (ties: smallest u, then v)."""
    moved = F.explode(F.array(*[F.struct((F.col("u") + a).alias("u"), (F.col("v") + b).alias("v")) for a, b in offsets("square", 1)]))
    from_ = heights.select(F.struct("z", "u", "v").alias("low"), moved.alias("_c")).select("low", "_c.u", "_c.v")
    best = heights.select("u", "v").join(from_, ["u", "v"]).groupBy("u", "v").agg(F.min("low").alias("low"))
    return best.select("u", "v", F.col("low.u").alias("nu"), F.col("low.v").alias("nv"))


def rivers(heights: DataFrame, sources: DataFrame, longest: int = 4096, cut: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """river, seq, u, v: the way of water from each source (river, u, v) down the steepest neighbours to a pit or the edge.

    Steps are doubled: a table of jumps over 1, 2, 4 ... cells is made by joining each with itself, and the places of all rivers
    are filled in from the longest jump down, so a way of n cells takes twice the logarithm of n joins.
    """
    jumps, reach = [cut(steepest(heights).where("u <> nu or v <> nv"))], 1
    while reach * 2 < longest:
        last = jumps[-1]
        twice = last.join(last.select(F.col("u").alias("nu"), F.col("v").alias("nv"), F.col("nu").alias("mu"), F.col("nv").alias("mv")), ["nu", "nv"]).select("u", "v", F.col("mu").alias("nu"), F.col("mv").alias("nv"))
        twice = cut(twice)
        if twice.isEmpty():
            break
        jumps.append(twice)
        reach *= 2
    out = sources.select("river", F.lit(0).cast("long").alias("seq"), "u", "v")
    for k in range(len(jumps) - 1, -1, -1):
        ahead = out.join(jumps[k], ["u", "v"]).select("river", (F.col("seq") + (1 << k)).alias("seq"), F.col("nu").alias("u"), F.col("nv").alias("v"))
        out = cut(out.unionByName(ahead))
    return out


def label_places(cells: DataFrame, k: int, by: Sequence[str] = ("case_id",), cut: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """by, label, place_no, u, v, depth: for the k largest parts of each label, the cell farthest from all cells outside of its label (ties: smallest u, v). Parts without an outside have a null depth and their first cell."""
    parts = cut(labelled_components(cells.select(*by, "u", "v", "label"), by, eight=True, label="label", cut=cut))
    sized = parts.groupBy(*by, "label", "component").agg(F.count("*").alias("n"))
    top = sized.withColumn("place_no", F.row_number().over(Window.partitionBy(*by, "label").orderBy(F.desc("n"), "component"))).where(F.col("place_no") <= k)
    # The nearest cell of another label stands beside one's own label: only such cells are targets, for each label they touch.
    moved = F.explode(F.array(*[F.struct((F.col("u") + a).alias("u"), (F.col("v") + b).alias("v")) for a, b in offsets("square", 1) if (a, b) != (0, 0)]))
    around = parts.select(*by, F.col("label").alias("near"), moved.alias("_c")).select(*by, "near", "_c.u", "_c.v")
    targets = around.join(parts.select(*by, "u", "v", "label"), [*by, "u", "v"]).where("label <> near").select(*by, F.col("near").alias("label"), F.col("u").alias("x"), F.col("v").alias("y")).distinct()
    inside = parts.join(top.select(*by, "label", "component", "place_no"), [*by, "label", "component"]).select(*by, "label", F.struct("place_no", "u", "v").alias("id"), F.col("u").alias("x"), F.col("v").alias("y"))
    deep = nearest_distances(inside, targets, 4.0, (*by, "label"), cut)
    best = deep.groupBy(*by, "label", F.col("id.place_no").alias("place_no")).agg(F.max(F.struct("dist", -F.col("id.u"), -F.col("id.v"))).alias("b"))
    return best.select(*by, "label", "place_no", (-F.col("b.col2")).cast("int").alias("u"), (-F.col("b.col3")).cast("int").alias("v"), F.col("b.dist").alias("depth"))


def section_picks(spark: SparkSession, scenario: Scenario, frame: SectionFrame, spacing: float = 45.0, margin: float = 15.0, fault_buffer: float = 80.0) -> DataFrame:
    """u, v, formation: places of layer bases on a drawn section, every `spacing` pixels, that are inside the block, below the terrain by the margin and off the fault by the buffer (metres)."""
    n = int(frame.plot_w // spacing) + 1
    u = frame.left + F.col("id") * spacing
    t = (u - frame.left) / frame.plot_w
    at = spark.range(n).select(u.alias("u"), (frame.ax + t * (frame.bx - frame.ax)).alias("x"), (frame.ay + t * (frame.by - frame.ay)).alias("y"))
    layers = F.array(*[F.struct(F.lit(name).alias("formation"), scenario.bottom(k, F.col("x"), F.col("y")).alias("z")) for k, (name, _, _) in enumerate(scenario.layers)])
    every = at.withColumn("_l", F.explode(layers)).select("u", "x", "y", "_l.z", "_l.formation")
    inside = F.col("z").between(frame.z0 + margin, frame.z1 - margin) & (F.col("z") <= scenario.dem(F.col("x"), F.col("y")) - margin)
    off = F.abs(F.col("x") - scenario.fault_x(F.col("z"))) > fault_buffer if scenario.fault else F.lit(True)
    _, v = frame.to_pixel(F.col("x"), F.col("y"), F.col("z"))
    return every.where(inside & off).select(F.bround("u", 2).alias("u"), F.bround(v, 2).alias("v"), "formation")


def generate_case(spark: SparkSession, scenario: Scenario, georef: GeoRef, grid: Grid = Grid(), per_unit: int = 4) -> dict[str, DataFrame]:
    """All truth tables of a scenario: map (labels and heights), units, voxels, surface, dip_symbols, fault_trace (if it has a fault)."""
    truth = map_truth(spark, scenario, georef)
    units = spark.createDataFrame([(i, name, "strata", i, *map(int, c)) for i, name, c in scenario.units()], "unit_id int, name string, role string, `order` int, r int, g int, b int")
    out = {"map": truth, "units": units, "voxels": truth_voxels(spark, scenario, grid), "surface": surface(spark, scenario, grid), "dip_symbols": dip_symbols(truth, scenario, per_unit)}
    return out | ({"fault_trace": fault_trace(truth, scenario)} if scenario.fault else {})


def write_cases(spark: SparkSession, cases: dict[str, Scenario], folder: str, georef: GeoRef, grid: Grid = Grid()) -> None:
    """Writes the tables of each case, below folder, as Parquet partitioned by case_id: one table for all cases, so that they are read together."""
    for name, scenario in cases.items():
        for table, df in generate_case(spark, scenario, georef, grid).items():
            df.withColumn("case_id", F.lit(name)).write.mode("append").partitionBy("case_id").parquet(f"{folder}/{table}")
