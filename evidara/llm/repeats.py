"""Rows that are equal in doc_id and text (and one more column), told apart.

Such rows are interchangeable, so any numbering of them gives the same table; it only has to have the same numbers. Rows that
occur once, nearly all, are found by their digests and stay where they are. Repeated ones are numbered within the tasks that
hold them, and their counts by task give where each task starts: no task holds a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidara.llm.workspace import Workspace


def digest_of(text: Column) -> Column:
    """MD5 of a text in hex; null counts as empty."""
    return F.md5(F.coalesce(text, F.lit("")))


def nested(docs: DataFrame) -> DataFrame:
    """The row as the one column ``doc`` and its digest: no name of the caller's can clash with one of ours."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), digest_of(F.col("text")).alias("digest"))


def numbered(docs: DataFrame, space: Workspace, also: str | None = None) -> DataFrame:
    """``nested`` rows with ordinal: 0, 1, ... among those equal in doc_id, text and the column ``also``."""
    other = (F.col(f"`{also}`") if also else F.lit(None)).cast("string")
    rows = nested(docs).withColumn("id", F.col("doc.doc_id")).withColumn("other", F.col(f"doc.`{also}`").cast("string") if also else other)
    keys = ["id", "digest", "other"]
    narrow = docs.select(F.col("doc_id").alias("id"), digest_of(F.col("text")).alias("digest"), other.alias("other"))
    twice = space.save(narrow.groupBy(keys).agg(F.count("*").alias("n")).filter("n > 1").select(*[F.col(k).alias(f"same_{k}") for k in keys]), "repeats")
    zero = F.lit(0).cast("long").alias("ordinal")
    if twice.isEmpty():
        return rows.select("doc", "digest", zero)
    same = (F.col("digest") == F.col("same_digest")) & F.col("id").eqNullSafe(F.col("same_id")) & F.col("other").eqNullSafe(F.col("same_other"))
    once = rows.join(twice, same, "left_anti").select("doc", "digest", zero)
    held = space.save(rows.withColumn("task", F.spark_partition_id()).join(twice, same, "left_semi"), "held")
    before = Window.partitionBy(*keys).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = held.groupBy(*keys, "task").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    starts = counts.select(*[F.col(k).alias(f"same_{k}") for k in keys], F.col("task").alias("same_task"), "start")
    inside = F.row_number().over(Window.partitionBy(*keys, "task").orderBy(F.lit(0)))
    placed = held.withColumn("place", inside).join(starts, same & (F.col("task") == F.col("same_task")))
    return once.union(placed.select("doc", "digest", (F.col("start") + F.col("place") - 1).alias("ordinal")))
