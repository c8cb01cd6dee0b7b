"""Relational queries on rows that their order leaves tied."""

import datetime

from evidara.plans import registry


def test_average_duplicates_takes_the_first_in_the_file_of_tied_lines(spark, tmp_path):
    import duckdb

    day = lambda i: datetime.datetime(2020, 1, 1) + datetime.timedelta(days=i)
    (tmp_path / "lineitem.parquet").mkdir()
    rows = [(7, part, 1, float(i), 0.02 * (part % 4), day((i * 37 + part) % 101)) for i in range(40) for part in range(25)]  # all lines of a part have one number
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_tax double, l_shipdate timestamp").createOrReplaceTempView("made")
    for n, which in enumerate(("l_quantity < 3", "l_quantity >= 3")):  # the second file is larger: a scan takes it first
        made = spark.table("made").filter(which).coalesce(1).sortWithinPartitions("l_quantity").toPandas()
        made.to_parquet(f"{tmp_path}/lineitem.parquet/{n}.parquet", coerce_timestamps="us")
    got = {(r.l_partkey, r.l_shipdate) for r in registry.queries()["average_duplicates"](spark, str(tmp_path)).collect()}
    duck = duckdb.connect()
    duck.execute("set threads = 1")
    duck.execute(f"create view lineitem as select l_orderkey, l_partkey, l_linenumber, l_quantity, l_tax, l_shipdate::timestamp as l_shipdate from '{tmp_path}/lineitem.parquet/*.parquet'")
    want = {(p, d) for p, _, _, d in duck.execute(registry.oracle_sql()["average_duplicates"]).fetchall()}
    assert {p for p, _ in got} == {p for p, _ in want}
    assert got == want == {(part, day(part % 101)) for part in range(25)}
