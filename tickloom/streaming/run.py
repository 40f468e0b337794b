"""Starting streams: durable sinks, checkpoints in the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import ROCKS, work_dir


def tick_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 64) -> DataFrame:
    """File stream of ticks; the event time becomes a TIMESTAMP, as watermarks need it."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_table(stream: DataFrame, name: str, out: str | None = None, empty_batches: bool = True) -> DataFrame:
    """Run the available input to the end into parquet files and read them back.

    State that expires by the clock asks for one more batch for ever; such a run ends with
    its input only when batches without rows are off.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(empty_batches).lower())
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    out = out or work_dir(spark, name)
    q = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", work_dir(spark, f"{name}-checkpoint"))
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_batches(stream: DataFrame, name: str, each: Callable[[DataFrame, int], None]) -> None:
    """Run the available input to the end through a batch function.

    A batch may be repeated after a failure: ``each`` writes below a folder named by the
    batch id and overwrites it.
    """
    spark = stream.sparkSession
    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", work_dir(spark, f"{name}-checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination()
