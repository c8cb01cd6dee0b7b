"""Running sums over many ranges against one range and against SQL."""

import duckdb
import pytest

from evidara.operators import metrics, ranking

ROWS = """select cast(id as int) as id, case when id % 11 = 0 then null when id % 3 > 0 then 'hot' else concat('g', id % 5) end as g,
  case when id % 13 = 0 then null else cast(pmod(hash(id), 40) as double) end as s, cast(id % 7 as int) as w from range(2000)"""


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("size", [10_000, 97])
@pytest.mark.parametrize("descending", [False, True])
def test_running_sums(spark, monkeypatch, size, descending):
    monkeypatch.setattr(ranking, "ROWS", size)
    rows = spark.sql(ROWS)
    import pyspark.sql.functions as F

    held = rows.toPandas()  # noqa: F841  read by the SQL
    for groups, over in ((["g"], "partition by g"), ([], "")):
        got = ranking.running(rows, groups, "s", {"total": "w", "before": "id"}, descending, [F.desc("id")]).select("id", "total", "before")
        way = "desc" if descending else "asc"
        want = duckdb.sql(f"select id, sum(w) over p as total, sum(id) over p as before from held where s is not null and not isnan(s) window p as ({over} order by s {way}, id desc rows unbounded preceding)").fetchall()
        assert told(got) == sorted(((a, int(b), int(c)) for a, b, c in want), key=repr)


def test_null_groups_and_empty_tables(spark, monkeypatch):
    rows = spark.sql(ROWS)
    one = told(ranking.tie_counts(rows, ["g"], "s", {"rows": ranking.F.lit(1)}).select("g", "s", "n_rows", "le_rows"))
    monkeypatch.setattr(ranking, "ROWS", 20)
    assert told(ranking.tie_counts(rows, ["g"], "s", {"rows": ranking.F.lit(1)}).select("g", "s", "n_rows", "le_rows")) == one and any(r[0] is None for r in one)
    assert ranking.tie_counts(rows.filter("false"), ["g"], "s", {"rows": ranking.F.lit(1)}).count() == 0
    assert metrics.spearman(rows, ["g"], "s", "w").count() == metrics.roc_auc(rows.withColumn("y", ranking.F.col("id") % 2), ["g"], "y", "s").count()


def test_spearman_orders_one_column_and_ranks_the_other(spark, monkeypatch):
    ordered, running = [], ranking.running
    monkeypatch.setattr(metrics, "running", lambda *a, **k: ordered.append(a[2]) or running(*a, **k))
    rows = spark.sql("select if(id % 11 = 0, null, id % 2) as g, id % 5 as few, cast(hash(id) % 97 as double) as many from range(400) union all select 0, null, 1.0D")
    pdf = rows.toPandas().dropna(subset=["few", "many"])
    want = {g: part.few.rank().corr(part.many.rank()) for g, part in pdf.fillna({"g": -1}).groupby("g")}
    for limit in (metrics.SENT, 0):  # ranks that go to every task, and ranks that are joined
        monkeypatch.setattr(metrics, "SENT", limit)
        for x, y in (("few", "many"), ("many", "few")):
            got = {-1 if r.g is None else r.g: r.spearman for r in metrics.spearman(rows, ["g"], x, y).collect()}
            assert got.keys() == want.keys() and all(abs(got[g] - v) < 1e-12 for g, v in want.items())
    assert ordered == ["__y", "__x"] * 2
    assert metrics.spearman(rows, ["g"], "few", "many").inputFiles()[0].rsplit("/", 2)[1].startswith("graph-")  # written: read again, not ranked again


def test_no_medians_without_nulls(spark, monkeypatch):
    asked, median = [], ranking._median
    monkeypatch.setattr(ranking, "_median", lambda rows, groups, c, name: asked.append(c) or median(rows, groups, c, name))
    rows = spark.sql("select * from values ('a', 1, 1), ('a', 3, null), ('a', 5, 4), ('b', 7, null) t(g, whole, part)")
    got = ranking.impute_medians(rows, ["whole", "part"], ["g"])
    assert set(asked) == {"part"} and sorted((r.whole, r.part, r.is_missing_whole, r.is_missing_part) for r in got.collect()) == [(1, 1, 0, 0), (3, 2.5, 0, 1), (5, 4, 0, 0), (7, 2.5, 0, 1)]
