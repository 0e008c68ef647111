"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import materialise  # noqa: F401

#: Fixed values. A word is a run of bytes that are digits, ASCII letters or part of a non-ASCII character.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words in a text whose letters are not lower-cased yet.
CASED_WORD_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Byte table: A-Z to a-z, every separator to a space, all else itself.
NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: bytes) -> list[bytes]:
    """The lower-cased words of UTF-8 bytes."""
    return text.translate(NORMAL).split()


#: Bytes of an Arrow batch, on which the memory of a Python worker and its task depends; and Spark's own value.
BATCH_BYTES, SPARK_BATCH_BYTES = 8 << 20, "67108864b"


def in_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """df.mapInArrow(run, schema) in batches of at most BATCH_BYTES (one longer row stays whole), unless the session sets a size of its own."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key) == SPARK_BATCH_BYTES:
        conf.set(key, f"{BATCH_BYTES}b")
    return df.mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that one column holds about most_bytes at most in each (one longer row stays whole)."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            n = n or 0
            if i > start and held + n > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if len(sizes) > start:
            yield batch.slice(start)


def crc_mod(column: str, modulus: int):
    """crc32 of a column as text, modulo modulus; null ids count as the empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus
