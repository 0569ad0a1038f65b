"""Running a stream to its end, as tests and batch callers do."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.sources.shared import shared_folder

FILE_ROWS = 500_000  # of the files a stream reads
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def replay(frame: DataFrame, by: str, build: Callable[[DataFrame], DataFrame], name: str, batches: int = 3) -> DataFrame:
    """What a stream writes for a table that arrives in the order of ``by``."""
    folder, stream = _replayed(frame, by, build, name, batches)
    return frame.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def replay_state(frame: DataFrame, by: str, build: Callable[[DataFrame], DataFrame], name: str, variable: str, batches: int = 3) -> DataFrame:
    """What a stream still holds in a state variable (key, value, ...) after the table, read from its state store."""
    folder, _ = _replayed(frame, by, build, name, batches)
    return frame.sparkSession.read.format("statestore").option("stateVarName", variable).load(f"{folder}/checkpoint")


def _replayed(frame: DataFrame, by: str, build: Callable[[DataFrame], DataFrame], name: str, batches: int) -> tuple[str, DataFrame]:
    """Run a stream over a table in ranges of about equal numbers of rows; its folder, and the stream.

    The table is written once, by as many tasks as it has, and quantiles cut it; rows of equal ``by`` stay together. Then one range
    after another is handed to the source's folder, in many files, and the stream runs on from its checkpoint, as after a restart.
    No range goes through one task.
    """
    spark = frame.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    folder = f"{shared_folder(spark)}/streams/{name}-{uuid.uuid4().hex}"
    frame.write.option("maxRecordsPerFile", FILE_ROWS).parquet(f"{folder}/whole")
    whole = spark.read.schema(frame.schema).parquet(f"{folder}/whole")
    shares = [F.lit(k / batches) for k in range(1, batches)]
    found = whole.agg(F.percentile_approx(by, F.array(*shares), F.lit(10_000)).alias("cuts")).first()
    cuts = sorted(set(found["cuts"] or []))
    place = F.lit(0)
    for cut in cuts:
        place = place + (F.col(by) > F.lit(cut)).cast("int")
    stream = build(spark.readStream.schema(frame.schema).parquet(f"{folder}/source/*"))
    for k in range(len(cuts) + 1):
        part = whole.where(F.coalesce(place, F.lit(0)) == k)
        part.write.option("maxRecordsPerFile", FILE_ROWS).parquet(f"{folder}/source/{k}")
        run_once(stream, folder)
    return folder, stream


def run_once(stream: DataFrame, folder: str) -> None:
    """Process what the source holds now, from the checkpoint on."""
    run = (
        stream.writeStream.format("parquet")
        .option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()


def run_to_end(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Process what the source holds now, and return what was written."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    folder = f"{shared_folder(spark)}/streams/{name}-{uuid.uuid4().hex}"
    run_once(stream, folder)
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
