"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

``plan`` gives each source its target and how its documents are repeated. With a level L, a source of weight w and size s
takes min(w * L, epochs * s); rounds clamp the sources above their cap and share the excess among the rest by weight until
none is above. A round is one aggregate over a table of one row per source, so nothing but three sums reaches the driver.

A source whose target is r times its size takes every document floor(r) times. For the rest of its target, documents are
thinned by a seeded hash of doc_id, text and, among rows that are equal in both and in source, a number: each falls into one of 4,096 bins,
and the bins below a cut get one more repetition. The cut is the one whose words come nearest to what is missing, read off a
histogram of all documents by source and bin. So reruns agree, targets are met within about a bin (a 4,096th of a source, or
one document), whatever ids repeat or are null, and applying the plan moves no text but that of repeated rows.

Null source is a source of its own (last in order). Null or empty text has size 0. Equal deviations take the lower cut. An empty
table gives no rows. A caller's columns, whatever their names, stay: ``mix`` returns each row as one column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidara.llm.repeats import numbered
from evidara.llm.words import word_count
from evidara.llm.workspace import Workspace

BINS = 4096


def bin_of(doc_id: Column, digest: Column, ordinal: Column, seed: int) -> Column:
    """The document's bin: the first three hex digits of an MD5 sum."""
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")), digest, ordinal.cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 3), 16, 10).cast("int")


def ranked(sources: DataFrame, space: Workspace) -> DataFrame:
    """Adds rank, from 0 in code-point order with null last. Ranges are counted and numbered apart, so no task holds all
    sources; only the table of ranges, a row for each partition, is summed in one."""
    order = [F.col("source").isNull(), F.col("source")]
    n = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = space.save(sources.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return parts.withColumn("in", inside).join(starts, "part").withColumn("rank", F.col("start") + F.col("in") - 1).drop("part", "start", "in")


def water_level(sources: DataFrame, total: float) -> float:
    """The level at which capped shares of ``weight`` reach ``total``; infinite if all caps together do not."""
    level, clamped = 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) > F.col("cap")
        n, caps, weight = sources.agg(F.count_if(above), F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("weight")))).first()
        if n == clamped:
            return level
        if not weight:
            return float("inf")
        clamped, level = n, (total - (caps or 0)) / weight


def plan(sizes: DataFrame, weights: list[int], share: float, epochs: int, space: Workspace) -> DataFrame:
    """``sizes`` has source, size and bin of every document. One row per source: source, source_size, target,
    whole (repetitions of every document), cut (bins below it get one more)."""
    sums = space.save(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sums")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = space.save(ranked(sums, space).withColumn("weight", weight).withColumn("cap", F.lit(epochs) * F.col("source_size")).drop("rank"), "sources")
    total = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level = water_level(sources, total)
    target = F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight")) if level != float("inf") else F.col("cap").cast("double")
    sources = sources.withColumn("target", target)
    sources = sources.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    bins = sizes.groupBy("source", "bin").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("bin"))
    filled = bins.select(F.col("source").alias("of"), (F.col("bin") + 1).alias("upto"), upto.alias("filled"))
    missing = F.col("target") - F.col("whole") * F.col("source_size")
    fitted = sources.join(filled, F.col("source").eqNullSafe(F.col("of")), "left")
    off = F.abs(F.col("filled") - missing)
    best = F.min(F.when(off < missing, F.struct(off.alias("off"), F.col("upto").alias("cut"))))
    keys = ["source", "source_size", "target", "whole"]
    made = fitted.groupBy(*keys).agg(F.coalesce(best["cut"], F.lit(0)).alias("cut"))
    made = space.save(made, "plan")
    space.drop("sums", "ranges", "sources")
    return made


def measured(docs: DataFrame, seed: int, space: Workspace) -> DataFrame:
    """doc (the row), source, size and bin of every document."""
    bin_ = bin_of(F.col("doc.doc_id"), F.col("digest"), F.col("ordinal"), seed)
    return numbered(docs, space, "source").select("doc", F.col("doc.source").alias("source"), word_count(F.col("doc.text")).alias("size"), bin_.alias("bin"))


def mix(docs: DataFrame, weights: list[int] = (5, 2, 1), share: float = 1.5, epochs: int = 2, seed: int = 11) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, source and others) as the column doc, with size, source_size, target and times, its
    repetitions."""
    space = Workspace(docs.sparkSession, "mix")
    rows = measured(docs, seed, space)
    sizes = space.save(rows.groupBy("source", "bin").agg(F.sum("size").alias("size")), "sizes")
    made = plan(sizes, list(weights), share, epochs, space).withColumnRenamed("source", "of")
    space.drop("sizes")
    times = F.col("whole") + (F.col("bin") < F.col("cut")).cast("int")
    return rows.join(made, F.col("source").eqNullSafe(F.col("of")), "left").select("doc", "size", "source_size", "target", times.alias("times"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as its plan says, with the columns of ``docs``."""
    made = mix(docs, **options).filter("times > 0")
    return made.select("doc", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*[F.col(f"doc.`{c}`") for c in docs.columns])
