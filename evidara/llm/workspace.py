"""Tables that an operator writes between its steps.

They go to the folder that all executors share (``spark.checkpoint.dir``), so a lost executor costs a task and never a
result, each cuts the lineage, and a reader gets real sizes: Spark broadcasts a side only where its files are small.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only where that is unset and all runs in one process, as in tests, a temporary
    folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _OWN.setdefault(spark.sparkContext.applicationId, "")
        if not found:
            found = _OWN[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="evidara-")
    return found.rstrip("/")


class Workspace:
    """A folder of one run of an operator. Tables are dropped one by one as soon as nothing reads them any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def save(self, df: DataFrame, table: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(table))
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def drop(self, *tables: str) -> None:
        fs, path = self._fs(self.root)
        for table in tables:
            fs.delete(path(self.path(table)), True)

    def _fs(self, where: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path
        return path(where).getFileSystem(self.spark._jsc.hadoopConfiguration()), path
