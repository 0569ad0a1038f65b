"""Set-up of Spark sessions for tests, the benchmark and local use."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, partitions: int = 8, name: str = "quillrank") -> SparkSession:
    """A local session; on a cluster pass the session that is already there instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Limits of a few thousand requests are cut per client before the shuffle as well.
        .config("spark.sql.optimizer.windowGroupLimitThreshold", "10000")
        .config("spark.driver.memory", os.environ.get("QUILLRANK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
        .getOrCreate()
    )
