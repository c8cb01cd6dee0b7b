"""Files that the format queries write."""

from pyspark.sql import functions as F

from evidara.plans import formats
from evidara.sources import delimited


def test_lines_are_written_by_all_tasks_behind_one_header(spark):
    rows = spark.range(0, 4000, 1, 4).withColumn("v", F.col("id") * 2)
    path = formats._lines(rows, formats._tab(F.col("id"), F.col("v")), "test", "#id\tv")
    per_file = spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("f")).count().collect()
    assert sorted(r["count"] for r in per_file) == [1, 1000, 1000, 1000, 1000]  # no task took all rows
    read = delimited.table(spark, path, ["v", "id"])
    assert {(r.id, r.v) for r in read.collect()} == {(str(i), str(2 * i)) for i in range(4000)}
