"""Session settings the operators rely on."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import SparkSession

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare(spark: SparkSession) -> SparkSession:
    """Set the runtime options that change results (time zone) or plans (AQE)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


@functools.cache
def _own_folder() -> str:
    """One temporary folder for a local session; the setting itself cannot be changed while a session runs."""
    return tempfile.mkdtemp(prefix="tickloom-")


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder of the cluster.

    Only a local master without ``spark.checkpoint.dir`` (tests) gets a temporary one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = _own_folder()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df, name: str):
    """Cut the lineage through a written table (survives lost executors)."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
