"""What the operators share on the side of Spark: reading, passing columns on, Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


BATCH_BYTES = 8_000_000


def bound_batches(spark: SparkSession) -> None:
    """Rows of texts reach Python in batches of a few megabytes, not of 10,000 rows or 64 MB; a smaller bound of the session stays.

    A batch lies in the memory of the JVM, of the worker and in what the worker makes of it, for each task of an executor.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, mod: int):
    """crc32 of an id written as text, modulo a number: the folds of the labelled rows. Null: null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % mod


def without(frame: DataFrame, names: list[str]) -> DataFrame:
    """The frame without columns of these names, whatever their case, so that results may take them."""
    taken = {name.lower() for name in names}
    return frame.select(*[F.col(f"`{name}`") for name in frame.columns if name.lower() not in taken])


def release() -> None:
    """Give memory that Python and Arrow have freed back to the system, so that a reused worker starts small again."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def lean(kernel):
    """The kernel, which gives its memory back when its task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from kernel(batches)
        finally:
            release()

    return run


def add_columns(frame: DataFrame, kernel, added: T.StructType) -> DataFrame:
    """The frame with columns that ``kernel`` computes from each Arrow batch.

    ``kernel`` gets an iterator of batches and yields, for each, (batch, list of arrays for ``added``).
    Columns of the input that bear an added name are replaced; all others pass through unchanged.
    """
    bound_batches(frame.sparkSession)
    names = [field.name for field in added.fields]
    lowered = {name.lower() for name in names}
    kept = [field for field in frame.schema.fields if field.name.lower() not in lowered]
    schema = T.StructType(kept + list(added.fields))
    keep = [field.name for field in kept]
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, arrays in kernel(batches):
            columns = [batch.column(batch.schema.get_field_index(name)) for name in keep] + list(arrays)
            columns = [
                column if column.type == field.type else column.cast(field.type)
                for column, field in zip(columns, target, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=target)

    return frame.mapInArrow(lean(run), schema)


BROADCAST_BYTES = 32_000_000


def small_enough(written: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A written table, marked for broadcast if its files are within ``limit``; else Spark shuffles both sides."""
    size = int(str(written._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(written) if size <= limit else written
