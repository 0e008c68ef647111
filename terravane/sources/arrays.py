"""Array files as a Spark data source: slabs as partitions, bounds on the first axis taken from filters.

Only folders that every executor mounts can be read and written this way, as array files are opened by their place; for other stores
readers.array_cells() takes files as Spark reads them, each whole in one task.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes of a partition that is read, and of a file that is written; cells of a batch.
SLAB_BYTES, BATCH = 32 << 20, 1 << 16


def _local(path: str) -> str:
    """The mounted folder of a path without a scheme or with that of files."""
    place = path.removeprefix("file://")
    if "://" in place:
        raise ValueError(f"{path} is no mounted folder; use readers.array_cells()")
    return place


@dataclass
class Slab(InputPartition):
    file: str
    start: int
    stop: int


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class NpyReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.low, self.high = path, 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds of i narrow the slabs; Spark tests all filters again, as a slab is read whole."""
        for f in filters:
            if getattr(f, "attribute", None) == ("i",) and isinstance(getattr(f, "value", None), int):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    stop = f.value + (not isinstance(f, LessThan))
                    self.high = stop if self.high is None else min(self.high, stop)
            yield f

    def partitions(self) -> list[InputPartition]:
        top = _local(self.path)
        files = [top] if os.path.isfile(top) else sorted(f"{top}/{f}" for f in os.listdir(top) if f.endswith(".npy") and not f.startswith("."))
        out: list[InputPartition] = []
        for file in files:
            array = np.load(file, mmap_mode="r", allow_pickle=False)  # the header alone is read
            if array.ndim not in (1, 2, 3):
                raise ValueError(f"{file} has {array.ndim} axes; 1 to 3 can be read")
            stop = len(array) if self.high is None else min(self.high, len(array))
            rows = max(1, SLAB_BYTES // max(1, array.itemsize * int(np.prod(array.shape[1:]))))
            out += [Slab(file, a, min(a + rows, stop)) for a in range(self.low, stop, rows)]
        return out or [Slab("", 0, 0)]

    def read(self, partition: Slab) -> Iterator[pa.RecordBatch]:
        if partition.start >= partition.stop:
            return
        array = np.load(partition.file, mmap_mode="r", allow_pickle=False)
        cells = int(np.prod(array.shape[1:]))
        rows = max(1, BATCH // max(1, cells))
        for a in range(partition.start, partition.stop, rows):
            part = np.asarray(array[a : min(a + rows, partition.stop)], float)
            at = [x.ravel().astype(np.int64) for x in np.indices(part.shape)]
            at[0] += a
            places = [pa.array(x) for x in at] + [pa.nulls(part.size, pa.int64())] * (3 - part.ndim)
            yield pa.RecordBatch.from_arrays([pa.array([partition.file] * part.size, pa.string()), *places, pa.array(part.ravel())], ["path", "i", "j", "k", "value"])


class NpyWriter(DataSourceArrowWriter):
    """Each task writes its rows as arrays of rows by columns (numbers); files get their names when all tasks are done."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        top, files, held, size = _local(self.path), [], [], 0
        os.makedirs(top, exist_ok=True)

        def flush() -> None:
            files.append(f"{uuid.uuid4().hex}.npy")
            with open(f"{top}/.{files[-1]}", "wb") as out:
                np.save(out, np.concatenate(held))

        for batch in iterator:
            held.append(np.stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in batch.columns], 1))
            size += held[-1].nbytes
            if size >= SLAB_BYTES:
                flush()
                held, size = [], 0
        if size:
            flush()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        for m in messages:
            for f in m.files if m else ():
                os.replace(f"{_local(self.path)}/.{f}", f"{_local(self.path)}/{f}")

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            for f in m.files if m else ():
                os.remove(f"{_local(self.path)}/.{f}")


class NpySource(DataSource):
    """spark.read.format("npy"): path, i, j, k (null beyond an array's axes) and value of each cell; spark.write.format("npy") for tables of numbers."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "path string, i long, j long, k long, value double"

    def reader(self, schema: StructType) -> NpyReader:
        return NpyReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> NpyWriter:
        return NpyWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NpySource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """Cells of the .npy files at a path, in slabs."""
    register(spark)
    return spark.read.format("npy").load(path)


def write_arrays(df: DataFrame, path: str) -> None:
    """Numeric columns of df as arrays of rows by columns."""
    register(df.sparkSession)
    df.write.format("npy").mode("append").save(path)
