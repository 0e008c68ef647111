"""The array data source: slabs, axes, pushed bounds, round trips."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravane.sources import arrays


@pytest.mark.parametrize("shape, order", [((7,), "C"), ((5, 6), "F"), ((4, 3, 5), "C"), ((0, 3), "C")])
def test_cells_of_all_shapes(spark, tmp_path, shape, order):
    a = np.asarray(np.arange(np.prod(shape)).reshape(shape), dtype=np.int16, order=order)
    np.save(tmp_path / "a.npy", a)
    rows = arrays.read_arrays(spark, f"file://{tmp_path}").collect()
    got = {tuple(r[c] for c in "ijk" if r[c] is not None): r["value"] for r in rows}
    assert got == {at: float(x) for at, x in np.ndenumerate(a)} and len(rows) == a.size


def test_bounds_narrow_the_slabs(tmp_path, monkeypatch):
    monkeypatch.setattr(arrays, "SLAB_BYTES", 80)
    np.save(tmp_path / "a.npy", np.zeros((100, 2)))
    reader = arrays.NpyReader(str(tmp_path))
    kept = list(reader.pushFilters([arrays.GreaterThan(("i",), 41), arrays.LessThanOrEqual(("i",), 52), arrays.EqualTo(("j",), 1)]))
    assert len(kept) == 3 and [(s.start, s.stop) for s in reader.partitions()] == [(42, 47), (47, 52), (52, 53)]


def test_filters_through_spark_and_round_trip(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") % 13).alias("a"), (F.col("id") * 0.5).alias("b"))
    arrays.write_arrays(df.repartition(3), str(tmp_path / "out"))
    cells = arrays.read_arrays(spark, str(tmp_path / "out"))
    assert cells.where("j = 1").agg(F.sum("value"), F.count("*")).first()[:] == (999 * 1000 / 4, 1000)
    assert {r["i"] for r in cells.where("i >= 3 and i < 5").collect()} == {3, 4}


def test_other_stores_are_refused():
    with pytest.raises(ValueError, match="mounted"):
        arrays.NpyReader("hdfs://x/a.npy").partitions()
