"""Split, fold, graph and leakage queries over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidara.functions import hashing
from evidara.operators import graph, leakage, splits
from evidara.plans.registry import query
from evidara.plans.relational import table

_DRAW = "('0x' || substr(sha1('42:' || {k}::varchar), 1, 13))::bigint / 4503599627370496.0::double"
_SIDE = f"case when {_DRAW} < 0.1 then 'test' when {_DRAW} < 0.2 then 'validation' else 'train' end"


@query("hash_bucket_split", f"select doc_id, {_SIDE.format(k='doc_id')} as split from documents")
def hash_bucket_split(spark, sf_dir):
    return splits.hash_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 42)


@query("group_split", f"select o_orderkey, {_SIDE.format(k='o_custkey')} as split from orders")
def group_split(spark, sf_dir):
    """D57, D58."""
    return splits.group_split(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 42).select("o_orderkey", "split")


@query("hash_folds", "select doc_id, (('0x' || substr(sha256('7:' || doc_id::varchar), 1, 8))::bigint % 5)::int as fold from documents")
def hash_folds(spark, sf_dir):
    return splits.hash_folds(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 5, 7)


@query("validation_per_mille", "select doc_id, ('0x' || substr(sha1(doc_id::varchar), 1, 8))::bigint % 1000 < 10 as in_validation from documents")
def validation_per_mille(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", hashing.in_validation(F.col("doc_id").cast("string")).alias("in_validation"))


@query("most_held_out_side", f"""
with s as (select event_id, user_id, case {_SIDE.format(k='event_id')} when 'test' then 2 when 'validation' then 1 else 0 end as r from events)
select event_id, case max(r) over (partition by user_id) when 2 then 'test' when 1 then 'validation' else 'train' end as split from s""")  # fmt: skip
def most_held_out_side(spark, sf_dir):
    rows = splits.hash_split(table(spark, sf_dir, "events").select("event_id", "user_id"), "event_id", 42)
    return splits.most_held_out(rows, "user_id").select("event_id", "split")


@query("largest_group", "select count(*) as n_groups, max(n) / sum(n)::double as largest_share from (select l_suppkey, count(*) as n from lineitem group by 1)")
def largest_group(spark, sf_dir):
    return splits.largest_group(table(spark, sf_dir, "lineitem"), "l_suppkey")


@query("temporal_split", f"""
with e as (select event_id, user_id, strftime(ts, '%Y-%m-%d') as day from events)
select event_id, case when day < cut then case when {_DRAW.format(k='user_id')} < 0.1 then 'validation' else 'train' end when min(day) over (partition by user_id) >= cut then 'test' end as split
from e cross join (select (select day from e order by day, event_id limit 1 offset (select count(*) // 4 from e)) as cut)""")  # fmt: skip
def temporal_split(spark, sf_dir):
    """W06."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    cutoff = splits.day_at(rows, "day", 0.25)
    return splits.by_time(rows, "user_id", "day", cutoff, "novel", 42, 0.1).select("event_id", "split")


@query("leave_one_group_out", "select o_orderpriority as fold, (select count(*) from orders) - count(*) as n_train, count(*) as n_test from orders group by 1 having count(*) >= 10")
def leave_one_group_out(spark, sf_dir):
    """D13."""
    return splits.leave_one_out(table(spark, sf_dir, "orders"), "o_orderpriority", 10)


@query("straddling_groups", f"""
select o_custkey, count_if(split = 'train')::bigint as n_train, count_if(split <> 'train')::bigint as n_held_out from (select o_custkey, {_SIDE.format(k='o_orderkey')} as split from orders) group by 1
having count_if(split = 'train') > 0 and count_if(split <> 'train') > 0""")  # fmt: skip
def straddling_groups(spark, sf_dir):
    """D14, D54, D12."""
    return splits.straddling(splits.hash_split(table(spark, sf_dir, "orders"), "o_orderkey", 42), "o_custkey")


@query("purge_clusters", "select o_orderkey from orders where o_orderkey % 5 > 0 and o_custkey not in (select o_custkey from orders where o_orderkey % 5 = 0)")
def purge_clusters(spark, sf_dir):
    """D16."""
    orders = table(spark, sf_dir, "orders")
    return splits.purge(orders.filter("o_orderkey % 5 > 0"), orders.filter("o_orderkey % 5 = 0"), "o_custkey").select("o_orderkey")


@query("fill_clusters", f"""
with s as (select l_suppkey, count(*) as n, {_DRAW.format(k='l_suppkey')} as d from lineitem group by 1),
r as (select *, sum(n) over (order by d, l_suppkey rows unbounded preceding) as upto, sum(n) over () as total from s)
select l_suppkey, n, case when upto - n < total * 0.2 then 'validation' else 'train' end as split from r""")  # fmt: skip
def fill_clusters(spark, sf_dir):
    made = splits.fill_clusters(table(spark, sf_dir, "lineitem").select("l_suppkey"), "l_suppkey", 0.2, 42)
    return made.groupBy("l_suppkey", "split").agg(F.count("*").alias("n"))


@query("capped_rows", f"select o_orderkey from (select o_orderkey, row_number() over (partition by o_orderstatus order by {_DRAW.format(k='o_orderkey')}) as r from orders) where r <= 40")
def capped_rows(spark, sf_dir):
    """A54."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return splits.capped(rows, ["o_orderstatus"], F.lit(40), hashing.bucket(F.col("o_orderkey").cast("string"), 42)).select("o_orderkey")


@query("balanced_rows", f"""
with n as (select o_orderpriority as g, min(n) as least from (select o_orderpriority, o_totalprice > 150000 as y, count(*) as n from orders group by all) group by 1 having count(*) > 1),
r as (select o_orderkey, least, row_number() over (partition by g, o_totalprice > 150000 order by {_DRAW.format(k='o_orderkey')}) as r from orders join n on g = o_orderpriority)
select o_orderkey from r where r <= least""")  # fmt: skip
def balanced_rows(spark, sf_dir):
    """A53."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", (F.col("o_totalprice") > 150000).alias("y"))
    return splits.balanced(rows, "o_orderpriority", "y", 42, "o_orderkey").select("o_orderkey")


@query("reserved_keys", f"select distinct doc_id from documents where {_SIDE.format(k='doc_id')} <> 'train' or doc_id in (select doc_id from labels where toxic = 1)")
def reserved_keys(spark, sf_dir):
    return splits.reserved([splits.hash_split(table(spark, sf_dir, "documents"), "doc_id", 42)], "doc_id", table(spark, sf_dir, "labels").filter("toxic = 1"))


@query("split_digest", """
with d as (select distinct sha256(doc_id::varchar) as d from documents), s as (select substr(d, 1, 2) as s, sha256(string_agg(d, chr(10) order by d)) as h, count(*) as n from d group by 1)
select sha256(string_agg(h, chr(10) order by s)) as split_hash, sum(n)::bigint as n_keys from s""")  # fmt: skip
def split_digest(spark, sf_dir):
    return hashing.split_digest(table(spark, sf_dir, "documents"), "doc_id")


@query("held_out_split_hash", f"""
select substr(sha256(string_agg(k, chr(10) order by k)), 1, 16) as split_hash, count(*) as n_keys from (select doc_id::varchar as k from documents where {_SIDE.format(k='doc_id')} = 'test')""")  # fmt: skip
def held_out_split_hash(spark, sf_dir):
    """The hash of a split's held-out keys."""
    held = splits.hash_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 42).filter("split = 'test'")
    value, n = hashing.split_hash(held, "doc_id")
    return spark.createDataFrame([(value, n)], "split_hash string, n_keys long")


_LINKS = "select c_custkey * 2 as a, (c_custkey * 7 % 50) * 2 + 1 as b from customer"


@query("connected_components", f"""
with recursive e as (select a, b from ({_LINKS}) union select b, a from ({_LINKS})), c(node, root) as (select a, a from e union select c.node, e.b from c join e on c.root = e.a)
select node, min(root) as component from c group by node""")  # fmt: skip
def connected_components(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    return graph.connected(customers.select((F.col("c_custkey") * 2).alias("a"), (F.col("c_custkey") * 7 % 50 * 2 + 1).alias("b")))


@query("rows_sharing_values", """
with recursive r as (select s_suppkey as k, (s_nationkey % 7)::varchar as x, (s_suppkey % 11)::varchar as y from supplier),
v as (select k, 'x' || x as v from r union all select k, 'y' || y from r where y <> '0'), e as (select distinct a.k as a, b.k as b from v a join v b using (v)),
c(node, root) as (select k, k from r union select c.node, e.b from c join e on c.root = e.a),
f as (select node, min(root) as component from c group by node) select node as s_suppkey, component, count(*) over (partition by component) as n from f""")  # fmt: skip
def rows_sharing_values(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") % 7).alias("x"), (F.col("s_suppkey") % 11).alias("y"))
    found = graph.sharing(rows.withColumn("y", F.when(F.col("y") != 0, F.col("y"))), "s_suppkey", ["x", "y"])
    firsts = found.groupBy("component").agg(F.min("s_suppkey").alias("first"), F.count("*").alias("n"))
    return found.join(firsts, "component").select("s_suppkey", F.col("first").alias("component"), "n")


@query("leakage_audit", f"""
with o as (select o_orderkey, o_custkey, o_orderpriority, (o_totalprice > 150000)::int as y, {_SIDE.format(k='o_orderkey')} as split from orders),
x as (select 'crossing:o_custkey' as "check", sum(n)::double as n from (select o_custkey, count(*) as n from o group by 1 having count_if(split = 'train') > 0 and count_if(split <> 'train') > 0) union all
  select 'crossing:o_orderkey', coalesce(sum(n), 0)::double from (select o_orderkey, count(*) as n from o group by 1 having count_if(split = 'train') > 0 and count_if(split <> 'train') > 0) union all
  select 'late', count(*)::double from o join orders using (o_orderkey) where split = 'train' and o_orderdate >= timestamp '1995-01-01')
select "check", case when n > 0 then 'critical' else 'ok' end as severity, n from x""")  # fmt: skip
def leakage_audit(spark, sf_dir):
    """D31, D32, D36, D37, D50."""
    rows = splits.hash_split(table(spark, sf_dir, "orders"), "o_orderkey", 42)
    late = leakage.late_training(rows, "o_orderdate", "1995-01-01").withColumn("check", F.lit("late"))
    return leakage.audit([leakage.groups_cross(rows, ["o_custkey", "o_orderkey"]), late])


@query("target_shortcut", f"""
with o as (select o_orderpriority, (o_totalprice > 150000)::int as y, {_SIDE.format(k='o_orderkey')} as split from orders), r as (select o_orderpriority, avg(y) as rate from o where split = 'train' group by 1),
t as (select y, coalesce(rate, (select avg(y) from o where split = 'train')) as s from o left join r using (o_orderpriority) where split <> 'train'),
k as (select y, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0::double as r from t),
a as (select (sum(r * y) - sum(y) * (sum(y) + 1) / 2.0::double) / (sum(y) * (count(*) - sum(y)))::double as auc from k)
select 'shortcut:o_orderpriority' as "check", case when greatest(auc, 1 - auc) >= 0.75 then 'warning' else 'ok' end as severity, greatest(auc, 1 - auc) as n from a""")  # fmt: skip
def target_shortcut(spark, sf_dir):
    rows = splits.hash_split(table(spark, sf_dir, "orders").withColumn("y", (F.col("o_totalprice") > 150000).cast("int")), "o_orderkey", 42)
    return leakage.shortcut(rows, "o_orderpriority", "y")


@query("duplicate_id_findings", """
select 'duplicates:l_orderkey' as "check", 'critical' as severity, count(*)::double as n from (select l_orderkey from lineitem group by 1 having count(*) > 1) union all
select 'ids_of:l_partkey', 'warning', count(*)::double from (select l_partkey from lineitem group by 1 having count(distinct l_suppkey) > 1)""")  # fmt: skip
def duplicate_id_findings(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return leakage.audit([leakage.duplicate_ids(rows, "l_orderkey"), leakage.keys_under_two_ids(rows, "l_partkey", "l_suppkey")])


@query("exclusion_findings", """
select 'eval_in_index' as "check", case when count(*) > 0 then 'critical' else 'ok' end as severity, count(*)::double as n from (select distinct doc_id from labels where toxic = 1 and doc_id in (select doc_id from documents where lang = 'en')) union all
select 'not_excluded', case when count(*) > 0 then 'critical' else 'ok' end, count(*)::double from (select distinct doc_id from labels where quality = 0 and doc_id not in (select doc_id from labels where toxic = 1))""")  # fmt: skip
def exclusion_findings(spark, sf_dir):
    """D46, D52."""
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    return leakage.audit([leakage.overlap("eval_in_index", labels.filter("toxic = 1"), docs.filter("lang = 'en'"), "doc_id"), leakage.not_excluded("not_excluded", labels.filter("quality = 0"), labels.filter("toxic = 1"), "doc_id")])
