"""Groups of rows that are linked, directly or through others."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.operators.skew import attach

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where that is unset and all runs in one process, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _OWN.setdefault(spark.sparkContext.applicationId, "")
        if not found:
            found = _OWN[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="evidara-")
    return found.rstrip("/")


def _shared(df: DataFrame) -> DataFrame:
    """The rows, written to the folder that executors share: cuts the plan and outlives executors."""
    path = f"{shared_folder(df.sparkSession)}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _drop(df: DataFrame) -> None:
    """Deletes the files of a ``_shared`` table that nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        at = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _settled(links: DataFrame) -> bool:
    """Whether each node hangs on one other, which hangs on none."""
    more = links.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").select("u")
    chained = links.select(F.col("v").alias("u")).distinct().join(links.select("u"), "u", "left_semi")
    return more.union(chained).isEmpty()


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (its smallest node) of all nodes of ``edges``. Two steps alternate: every larger neighbour of a node is
    hung on the smallest node around it, then every smaller one; paths about halve in each round. Hubs are dealt over tasks."""
    nodes = edges.select(F.col(a).alias("node")).union(edges.select(F.col(b))).filter("node is not null").distinct()
    links = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    links = _shared(links.distinct())
    while not _settled(links):
        both = _shared(links.union(links.select("v", "u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        up = attach(both, least.drop("n"), "u", least.select("u", "n")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        up = _shared(up.filter("u != v").distinct())
        _drop(both)
        least = up.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        down = attach(up, least.drop("n"), "u", least.select("u", "n")).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = _shared(down.union(least.select("u", "m")).distinct())
        _drop(up)
        _drop(links)
        links = after
    return nodes.join(links.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").withColumn("component", F.coalesce("component", "node"))


def sharing(rows: DataFrame, key: str, columns: Sequence[str], ignored: Sequence[str] = ("", "none", "nan")) -> DataFrame:
    """Rows that share any value of any of the columns, through others too, as key and component. Rows and values are the two
    sides of a graph, so a value of many rows makes as many edges, not pairs. Null and ``ignored`` values link nothing."""
    edges = None
    row = F.concat(F.lit("0:"), F.col(key).cast("string"))
    for c in columns:
        value = F.trim(F.col(c).cast("string"))
        part = rows.filter(value.isNotNull() & ~F.lower(value).isin(*ignored)).select(row.alias("a"), F.concat(F.lit(f"1:{c}:"), value).alias("b"))
        edges = part if edges is None else edges.union(part)
    labels = connected(edges).filter(F.col("node").startswith("0:")).select(F.substring("node", 3, 1 << 20).alias("__k"), F.substring("component", 3, 1 << 20).alias("component"))
    keyed = rows.select(key).distinct().withColumn("__k", F.col(key).cast("string"))
    return keyed.join(labels, "__k", "left").select(key, F.coalesce("component", "__k").alias("component"))
