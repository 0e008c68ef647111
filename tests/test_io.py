"""Sources, sinks and streaming on files made here."""

import json

import numpy as np
from pyspark.sql import functions as F

from terravane.operators.grid import Grid, scenarios, truth_voxels
from terravane.sources import readers, writers
from terravane.streaming import windows


def test_csv_completion_and_bad_values(spark, tmp_path):
    (tmp_path / "u.csv").write_text("unit_id,name,order,extra\n1,K1,0,x\n2,P1,,y\nbad,Q,3,z\n")
    rows = readers.units_table(spark, str(tmp_path / "u.csv")).orderBy("name").collect()
    assert [(r["unit_id"], r["name"], r["role"], r["order"]) for r in rows] == [(1, "K1", "strata", 0), (2, "P1", "strata", -1), (None, "Q", "strata", 3)]
    assert "extra" not in rows[0].asDict()


def test_documents(spark, tmp_path):
    (tmp_path / "faults.json").write_text(json.dumps([{"fault_id": 1, "name": "F1", "confirmed": True, "polyline_px": [[1, 2], [3, 4.5]]}, {"fault_id": 2, "name": "F2", "confirmed": False}]))
    assert [r["name"] for r in readers.confirmed_faults(spark, str(tmp_path / "faults.json")).collect()] == ["F1"]
    assert readers.confirmed_faults(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "e.json").write_text(json.dumps({"elevations": {"3": 100.5, "4": None}, "notes": "n"}))
    assert {(r["contour_id"], r["elevation"]) for r in readers.elevations(spark, str(tmp_path / "e.json")).collect()} == {(3, 100.5), (4, None)}
    (tmp_path / "m.json").write_text(json.dumps({"id_to_name": {"1": "A", "2": "B"}, "name_to_color": {"A": [1, 2, 3]}}))
    assert {(r["lith_id"], r["name"], r["r"]) for r in readers.lith_names(spark, str(tmp_path / "m.json")).collect()} == {(1, "A", 1), (2, "B", None)}
    assert {r["case_id"] for r in readers.cases(spark, str(tmp_path), "m.json").collect()} == {tmp_path.name}


def test_arrays(spark, tmp_path):
    cube = np.arange(24).reshape(2, 3, 4)
    np.save(tmp_path / "cube.npy", cube)
    rows = readers.array_cells(spark, str(tmp_path)).collect()
    assert len(rows) == 24 and all(cube[tuple(r["index"])] == r["value"] for r in rows)


def test_pasted_lines(spark):
    rows = readers.lines_of_text(spark, "1,2,x\n3，4,y\nbad,5,z\n7,8\n", "u double, v double, formation string").collect()
    assert {tuple(r) for r in rows} == {(1.0, 2.0, "x"), (3.0, 4.0, "y")}


def test_cube_prunes_by_slab(spark, tmp_path):
    path = str(tmp_path / "cube")
    writers.write_cube(truth_voxels(spark, scenarios()["base"], Grid(10, 10, 32)), path)
    back = spark.read.parquet(path)
    assert back.count() == 3200
    plan = back.where("k_slab = 1 and lith_id = 2").select("i")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(k_slab" in plan and "PushedFilters: [IsNotNull(lith_id)" in plan


def test_markdown(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "n long, s string")
    assert [r["line"] for r in writers.markdown(df, "n").collect()] == ["| n | s |", "| --- | --- |", "| 1 | a |", "| 2 |  |"]


def _events(spark, rows, folder, name):
    df = spark.createDataFrame([(i, u, "a", float(v)) for i, (_, u, v) in enumerate(rows)], "event_id long, user_id long, event_type string, value double")
    times = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(rows)], "event_id long, t string")
    df.join(times, "event_id").select("event_id", F.col("t").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value").coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def test_a_later_run_updates_open_days_and_drops_late_rows(spark, tmp_path):
    out = str(tmp_path / "out")
    _events(spark, [("2024-01-01 01:00:00", 1, 1), ("2024-01-04 05:00:00", 1, 2)], tmp_path / "in" / "x", "a")
    stream = lambda: spark.readStream.schema(spark.read.parquet(str(tmp_path / "in" / "x" / "a.parquet")).schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp"))
    run = lambda: {str(r["day"])[:10]: (r["n"], r["total"]) for r in windows.run_updates(windows.daily_counts(stream()), ["day", "event_type"], out).collect()}
    assert run() == {"2024-01-01": (1, 1.0), "2024-01-04": (1, 2.0)}
    # the first day is closed by now: its late row is dropped, the open day is updated
    _events(spark, [("2024-01-01 02:00:00", 1, 50), ("2024-01-04 06:00:00", 1, 5), ("2024-01-04 07:00:00", 1, 0.25)], tmp_path / "in" / "y", "b")
    assert run() == {"2024-01-01": (1, 1.0), "2024-01-04": (3, 7.25)}


def test_open_sessions_are_not_written(spark, tmp_path):
    _events(spark, [("2024-01-01 01:00:00", 1, 1), ("2024-01-01 02:00:00", 1, 1), ("2024-01-01 01:30:00", 2, 1), ("2024-01-09 00:00:00", 2, 1)], tmp_path, "events")
    rows = windows.run_closed(windows.sessions(windows.read_events(spark, str(tmp_path / "events.parquet"), "part-*.parquet"), "6 hours"), str(tmp_path / "out")).collect()
    assert sorted((r["user_id"], str(r["end"]), r["n"]) for r in rows) == [(1, "2024-01-01 08:00:00", 2), (2, "2024-01-01 07:30:00", 1)]
