"""Event streams run to the end of what is there: the same rows as the batch SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evidara.operators import paired, resample
from evidara.operators.graph import shared_folder
from evidara.plans.registry import query
from evidara.plans.relational import table
from evidara.streaming import incremental


def _events(spark, sf_dir):
    """The events as a stream, with their zone-less times read as UTC."""
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    return incremental.file_stream(spark, sf_dir, schema, glob="events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


@query("events_window_stream", """
with w as (select time_bucket(interval 1 day, ts, timestamp '1970-01-01') as window_start, event_type, value from events)
select window_start, event_type, count(*) as n, sum(floor(value))::double as total from w group by all""")  # fmt: skip
def events_window_stream(spark, sf_dir):
    """All windows, complete mode into a table: the batch result of the same plan."""
    at = _folder(spark)
    events = _events(spark, sf_dir).withColumn("value", F.floor("value").cast("double"))
    counts = incremental.window_counts(events, "ts", "1 day", "1 hour", ["event_type"], "value")
    stream = counts.writeStream.outputMode("complete").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{at}/out")).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    stream.awaitTermination()
    return spark.read.parquet(f"{at}/out").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


@query("emit_once_stream", "select distinct user_id, event_type from events")
def emit_once_stream(spark, sf_dir):
    at = _folder(spark)
    once = incremental.emit_once(_events(spark, sf_dir).select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "3650 days")
    incremental.run(once.drop("ts"), f"{at}/out", f"{at}/checkpoint")
    return spark.read.parquet(f"{at}/out")


@query("upsert_stream", "select distinct user_id from events")
def upsert_stream(spark, sf_dir):
    at = _folder(spark)
    incremental.run_into(_events(spark, sf_dir).select("user_id"), incremental.upsert(f"{at}/cache", ["user_id"]), f"{at}/checkpoint")
    return spark.read.parquet(f"{at}/cache")


@query("late_duplicates", "select user_id, event_type, min(ts) as first_time, count(*) - 1 as n_late from events group by all")
def late_duplicates(spark, sf_dir):
    return incremental.late_duplicates(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts")


@query("bootstrap_ci")
def bootstrap_ci(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("lang", F.col("quality").alias("label"), (F.col("n_chars") % 997 / 997.0).alias("score"))
    return resample.bootstrap_ci(rows, "lang", "label", "score", n=200)


@query("paired_arms")
def paired_arms(spark, sf_dir):
    """Arms against the reference with intervals from resampled variants."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    each = rows.select(F.col("lang").alias("gene"), F.col("doc_id").cast("string").alias("variant_key"), F.col("quality").cast("int").alias("label"), "n_chars")
    arms = each.withColumn("a", F.explode(F.array(*[F.struct(F.lit(arm).alias("arm"), F.lit(seed).alias("seed")) for arm in ("base", "other") for seed in (0, 1)])))
    score = F.when(F.col("a.arm") == "base", F.col("n_chars") % 997 / 997.0).otherwise(F.col("n_chars") % 499 / 499.0) + F.col("a.seed") * 0.001
    return paired.paired_table(arms.select("a.arm", "a.seed", "gene", "variant_key", "label", score.alias("score")), "base", n=100)


@query("calibrated_scores")
def calibrated_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", F.col("quality").cast("double").alias("label"), (F.col("n_chars") % 997 / 997.0).alias("score"))
    return resample.calibrate(rows.filter("doc_id % 2 = 0"), rows.filter("doc_id % 2 = 1"), "lang", "label", "score", "platt")
