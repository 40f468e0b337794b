"""Small helpers the text operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import work_dir

#: Words are separated by these white-space characters only.
SPACES = r"[\x20\x09-\x0D]+"
#: Rows of an Arrow batch, and of a batch read from Parquet, while a table is stored.
BATCH = 1000
BATCHES = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Scratch:
    """Tables of one run, in a folder of their own below ``spark.checkpoint.dir``.

    A table cuts the lineage and survives lost executors. Tables that the result does not
    read are dropped as soon as they are not needed.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, work_dir(spark, name)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Whole texts are read and go to Python in batches of ``BATCH`` rows, so memory does not follow the default batches."""
        conf = self.spark.conf
        before = {key: conf.get(key) for key in BATCHES}
        for key, rows in before.items():
            conf.set(key, str(min(int(rows), BATCH) if int(rows) > 0 else BATCH))
        try:
            df.write.parquet(f"{self.root}/{name}")
        finally:
            for key, rows in before.items():
                conf.set(key, rows)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z only: other letters stay as they are, in any locale."""
    return F.translate(c, UPPER, UPPER.lower())


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")
