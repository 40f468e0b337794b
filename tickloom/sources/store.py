"""Stores and text formats: parquet bars, CSV and JSON sinks, run summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.sources.bars import merge_pages

# Keys of the summary text format.
SUMMARY_KEYS = {
    "Window": "window",
    "Threshold": "threshold",
    "AUC": "auc",
    "Accuracy": "accuracy",
    "Precision (1)": "precision_1",
    "Recall (1)": "recall_1",
    "False Positives": "false_positives",
    "False Negatives": "false_negatives",
}


def append_bars(bars: DataFrame, path: str, few_symbols: bool = True) -> None:
    """Append to a parquet store; folders by symbol only when there are few."""
    w = bars.write.mode("append").option("compression", "snappy")
    (w.partitionBy("symbol") if few_symbols else w).parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Store with re-appended bars removed."""
    return merge_pages(spark.read.parquet(path))


def write_dataset(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)


def read_dataset(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Parquet, or CSV when the path says so."""
    if path.rstrip("/").endswith(".csv"):
        return spark.read.schema(schema).csv(path, header=True)
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def append_metrics(df: DataFrame, path: str) -> None:
    """Append {timestamp, auc, f1} rows to the metric history."""
    df.write.mode("append").json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("timestamp string, auc double, f1 double").json(path).orderBy("timestamp")


def parse_summaries(lines: DataFrame, name="file_name", value="value") -> DataFrame:
    """'Key: value' lines of many run summaries to one row per file."""
    key = F.trim(F.split_part(F.col(value), F.lit(":"), F.lit(1)))
    num = F.regexp_extract(F.col(value), r":\s*(-?[0-9.]+)", 1).try_cast("double")
    aggs = [F.max(F.when(F.col("_k") == k, F.col("_v"))).alias(out) for k, out in SUMMARY_KEYS.items()]
    return lines.withColumns({"_k": key, "_v": num}).groupBy(name).agg(*aggs)


def read_summaries(spark: SparkSession, glob: str) -> DataFrame:
    return parse_summaries(spark.read.text(glob).withColumn("file_name", F.col("_metadata.file_name")))


def read_datasets(spark: SparkSession, glob: str, schema) -> DataFrame:
    """Union of label datasets, tagged with window and threshold from the file path."""
    df = spark.read.schema(schema).csv(glob, header=True)
    path = F.col("_metadata.file_path")
    return df.select(
        "*",
        F.regexp_extract(path, r"win(\d+)_thr", 1).cast("int").alias("win"),
        F.regexp_extract(path, r"_thr(\d+)", 1).cast("int").alias("thr"),
    )
