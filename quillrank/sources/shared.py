"""Tables written between steps of one job, in the folder the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local session without one gets its own."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def materialise(frame: DataFrame, name: str) -> DataFrame:
    """Write the rows once and read them back.

    For a result that several branches of a plan read: it is computed once, its lineage ends here,
    and losing an executor costs no more than the task that was running. Being a file, it also has a
    known size, by which Spark decides how to join it. What was shuffled for it is deleted at once.
    """
    return materialise_each([frame], name)


def materialise_each(frames: Iterable[DataFrame], name: str) -> DataFrame:
    """The rows of one or more frames of one schema as a table, written one after another, each when the one before is done."""
    path = schema = spark = None
    for frame in frames:
        spark, schema = frame.sparkSession, frame.schema
        path = path or f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
        with shuffles_freed(spark):
            frame.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Deletes a table of ``materialise`` that no later step reads."""
    spark = table.sparkSession
    folders = {name.rsplit("/", 1)[0] for name in table.inputFiles()}
    for folder in folders:
        if "/tables/" not in folder:
            raise ValueError(f"{folder} is no table of this job")
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go when the job that wrote them ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
