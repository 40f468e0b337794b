"""Local session for tests and tools."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from tickloom.session import prepare


def local_session(cores: str | int | None = None, memory: str = "8g") -> SparkSession:
    n = cores or os.environ.get("BENCH_CPUS", "*")
    spark = (
        SparkSession.builder.master(f"local[{n}]")
        .appName("tickloom")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        # window-heavy stages are bound by CPU: let small inputs use all cores too
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return prepare(spark)
