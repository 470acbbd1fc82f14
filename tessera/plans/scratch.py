"""Tables in the shared folder that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one serves a local session; on a cluster that
    is an error, as its executors don't share such folders."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not place:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            return found.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(place)
    return place


def remove(spark: SparkSession, path: str) -> None:
    """Removes a file or folder, if it is there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def forget(spark: SparkSession, path: str) -> None:
    """Has a folder removed when the session's JVM ends: until then a plan may read it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


class Scratch:
    """``keep(df)`` writes a table and rereads it, so that any executor can read it again after a loss.
    ``drop(df)`` removes what ``keep`` wrote, once nothing reads it; the rest goes when the session's JVM ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark).rstrip('/')}/tessera-{name}-{uuid.uuid4().hex}"
        self.count = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.base}/{self.count}"
        df.write.parquet(path)
        if self.count == 1:
            forget(self.spark, self.base)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch_path = path
        return back

    def drop(self, df: DataFrame) -> None:
        remove(self.spark, df._scratch_path)
