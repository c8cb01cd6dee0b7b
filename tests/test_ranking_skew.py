"""Groups that hold most of the rows."""

from pyspark.sql import functions as F

from evidara.operators import ranking


def test_zscore_deals_a_hot_group_over_tasks(spark):
    rows = spark.range(40_000).select("id", F.concat(F.lit("hot"), F.substring(F.col("id").cast("string"), 9, 1)).alias("g"), (F.col("id") % 7).cast("double").alias("v")).union(spark.sql("select -1L, 'alone', 3.0D union all select -2L, null, 1.0D"))
    kept = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = ranking.zscore(rows, ["g"], ["v"])
        taken = [r.n for r in made.filter("id >= 0").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.sum("z_v")).collect()]
        z = {r.id: r.z_v for r in made.filter("id < 7").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept[0])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept[1])
    assert sum(taken) == 40_000 and max(taken) < 30_000  # of four tasks
    values = [i % 7 for i in range(40_000)]
    mean = sum(values) / 40_000
    deviation = (sum((v - mean) ** 2 for v in values) / 39_999) ** 0.5
    assert all(abs(z[-1 if i < 0 else i] - ((i - mean) / deviation if i >= 0 else 0.0)) < 1e-9 for i in range(-2, 7) if i != -2) and z[-2] == 0.0
