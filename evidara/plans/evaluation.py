"""Evaluation queries: ranks, measures, calibration and risk over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidara.functions import arrays
from evidara.operators import metrics, paired, ranking, resample, ridge
from evidara.plans.registry import query
from evidara.plans.relational import table


def labelled(spark, sf_dir):
    """(doc_id, lang, source, quality, toxic, share): labelled documents with a score in [0, 1) from their length."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.select("doc_id", "lang", "source", "quality", "toxic", "n_chars", (F.col("n_chars") % 997 / 997.0).alias("share"))


_LABELLED = "l as (select doc_id, lang, source, quality, toxic, n_chars, n_chars % 997 / 997.0::double as share from documents join labels using (doc_id))"


@query("zscore_within_group", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, coalesce((l_quantity - avg(l_quantity) over w) / nullif(stddev_samp(l_quantity) over w, 0), 0) as z_l_quantity from lineitem
window w as (partition by l_returnflag)""")  # fmt: skip
def zscore_within_group(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity")
    return ranking.zscore(rows, ["l_returnflag"], ["l_quantity"]).drop("l_quantity")


@query("average_rank_pct", """
select p_partkey, (rank() over (partition by p_brand order by p_size) + (count(*) over (partition by p_brand, p_size) - 1) / 2.0::double) / count(p_size) over (partition by p_brand) as pct from part""")  # fmt: skip
def average_rank_pct(spark, sf_dir):
    return ranking.percentile_rank(table(spark, sf_dir, "part"), ["p_brand"], "p_size", "pct").select("p_partkey", "pct")


@query("within_group_ranks", """
with r as (select p_partkey, p_brand, p_size as a, -p_retailprice as b from part),
q as (select p_partkey, (rank() over (partition by p_brand order by a) + (count(*) over (partition by p_brand, a) - 1) / 2.0::double) / count(*) over (partition by p_brand) as rank_p_size,
  (rank() over (partition by p_brand order by b) + (count(*) over (partition by p_brand, b) - 1) / 2.0::double) / count(*) over (partition by p_brand) as rank_p_retailprice from r)
select *, (rank_p_size + rank_p_retailprice) / 2 as rank_consensus from q""")  # fmt: skip
def within_group_ranks(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    return ranking.within_group_ranks(rows, "p_brand", {"p_size": 1, "p_retailprice": -1}).select("p_partkey", "rank_p_size", "rank_p_retailprice", "rank_consensus")


@query("risk_tiers", """
with q as (select c_custkey, (rank() over (order by c_acctbal) + (count(*) over (partition by c_acctbal) - 1) / 2.0::double) / count(c_acctbal) over () as pct from customer)
select c_custkey, pct, case when pct >= 0.9 then 'high' when pct >= 0.7 then 'medium' else 'low' end as tier from q""")  # fmt: skip
def risk_tiers(spark, sf_dir):
    return ranking.risk_tiers(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), [], "c_acctbal").select("c_custkey", "pct", "tier")


@query("spearman_by_group", """
with r as (select l_returnflag, l_quantity as x, l_extendedprice as y from lineitem),
k as (select l_returnflag, rank() over (partition by l_returnflag order by x) + (count(*) over (partition by l_returnflag, x) - 1) / 2.0::double as rx,
  rank() over (partition by l_returnflag order by y) + (count(*) over (partition by l_returnflag, y) - 1) / 2.0::double as ry from r)
select l_returnflag, corr(rx, ry) as spearman, count(*) as n from k group by 1""")  # fmt: skip
def spearman_by_group(spark, sf_dir):
    """A31."""
    return metrics.spearman(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")


_AUC = """select {g}count(*) as n, sum({y})::bigint as n_pos, case when sum({y}) > 0 and sum({y}) < count(*) then
  (sum(r * {y}) - sum({y}) * (sum({y}) + 1) / 2.0::double) / (sum({y}) * (count(*) - sum({y})))::double end as auc from (
  select *, rank() over ({p}order by {s}) + (count(*) over (partition by {gc}{s}) - 1) / 2.0::double as r from l)"""


@query("roc_auc_by_group", f"with {_LABELLED} " + _AUC.format(g="lang, ", p="partition by lang ", gc="lang, ", y="quality", s="n_chars") + " group by lang")
def roc_auc_by_group(spark, sf_dir):
    """A16."""
    return metrics.roc_auc(labelled(spark, sf_dir), ["lang"], "quality", "n_chars")


@query("roc_auc_overall", f"with {_LABELLED} " + _AUC.format(g="", p="", gc="", y="toxic", s="share"))
def roc_auc_overall(spark, sf_dir):
    return metrics.roc_auc(labelled(spark, sf_dir), [], "toxic", "share")


@query("column_agreement", f"""
with {_LABELLED}, x as (select quality, 'n_chars' as "column", n_chars::double as v from l union all select quality, 'share', share from l union all select quality, 'quality_copy', quality::double from l),
r as (select *, rank() over (partition by "column" order by v) + (count(*) over (partition by "column", v) - 1) / 2.0::double as r from x),
a as (select "column", count(*) as n, sum(quality)::bigint as n_pos, (sum(r * quality) - sum(quality) * (sum(quality) + 1) / 2.0::double) / (sum(quality) * (count(*) - sum(quality)))::double as auc from r group by 1)
select *, greatest(auc, 1 - auc) as agreement, case when greatest(auc, 1 - auc) >= 0.99 then 'critical' when greatest(auc, 1 - auc) >= 0.95 then 'warning' else 'ok' end as severity from a""")  # fmt: skip
def column_agreement(spark, sf_dir):
    return metrics.column_agreement(labelled(spark, sf_dir).withColumn("quality_copy", F.col("quality")), "quality", ["n_chars", "share", "quality_copy"])


@query("average_precision", f"""
with {_LABELLED}, r as (select lang, quality, sum(quality) over w / count(*) over w::double as p from l window w as (partition by lang order by share desc, doc_id rows unbounded preceding))
select lang, sum(p * quality) / sum(quality) as average_precision from r group by lang""")  # fmt: skip
def average_precision(spark, sf_dir):
    """A17."""
    return metrics.average_precision(labelled(spark, sf_dir), ["lang"], "quality", "share", "doc_id")


@query("average_precision_tied", f"""
with {_LABELLED}, t as (select lang, share, sum(quality) as p, count(*) as n from l group by all),
r as (select lang, p, sum(p) over w / (sum(n) over w)::double as precision from t window w as (partition by lang order by share desc rows unbounded preceding))
select lang, sum(p * precision) / sum(p) as average_precision from r group by lang""")  # fmt: skip
def average_precision_tied(spark, sf_dir):
    return metrics.average_precision_tied(labelled(spark, sf_dir), ["lang"], "quality", "share")


_PANEL = """tp, fp, fn, tn, tp + fp + fn + tn as n, (tp + tn) / (tp + fp + fn + tn)::double as accuracy, case when tp + fp > 0 then tp / (tp + fp)::double else 0 end as precision,
  case when tp + fn > 0 then tp / (tp + fn)::double else 0 end as recall, case when tn + fp > 0 then tn / (tn + fp)::double else 0 end as specificity, case when tn + fn > 0 then tn / (tn + fn)::double else 0 end as npv,
  case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn)::double else 0 end as f1,
  (case when tp + fn > 0 then tp / (tp + fn)::double else 0 end + case when tn + fp > 0 then tn / (tn + fp)::double else 0 end) / 2 as balanced_accuracy,
  case when (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 then (tp * tn - fp * fn)::double / sqrt(((tp + fp) * (tp + fn))::double * ((tn + fp) * (tn + fn))::double) else 0 end as mcc"""


@query("confusion_panel_mcc", f"""
with {_LABELLED}, c as (select lang, count_if(quality = 1 and toxic = 1)::bigint as tp, count_if(quality = 0 and toxic = 1)::bigint as fp, count_if(quality = 1 and toxic = 0)::bigint as fn, count_if(quality = 0 and toxic = 0)::bigint as tn from l group by lang)
select lang, {_PANEL} from c""")  # fmt: skip
def confusion_panel_mcc(spark, sf_dir):
    return metrics.panel(metrics.confusion(labelled(spark, sf_dir), ["lang"], "quality", F.col("toxic")))


_SWEEP = f"""
with {_LABELLED}, s as (select distinct share as threshold from l),
c as (select threshold, count_if(quality = 1 and share >= threshold)::bigint as tp, count_if(quality = 0 and share >= threshold)::bigint as fp, count_if(quality = 1 and share < threshold)::bigint as fn,
  count_if(quality = 0 and share < threshold)::bigint as tn from s cross join l group by threshold)"""


@query("mcc_threshold_sweep", f"{_SWEEP} select threshold, {_PANEL} from c")
def mcc_threshold_sweep(spark, sf_dir):
    """A18, A62, A63."""
    return metrics.threshold_sweep(labelled(spark, sf_dir), [], "quality", "share")


@query("best_threshold_by_f1", f"{_SWEEP}, p as (select threshold, {_PANEL} from c) select arg_min(threshold, (-f1, threshold)) as threshold, max(f1) as f1 from p")
def best_threshold_by_f1(spark, sf_dir):
    return metrics.best_threshold(labelled(spark, sf_dir), [], "quality", "share", "f1")


@query("grid_threshold", f"""
with {_LABELLED}, s as (select unnest(range(0, 101)) as t),
c as (select t / 100.0::double as threshold, count_if(quality = 1 and floor(share * 100) >= t)::bigint as tp, count_if(quality = 0 and floor(share * 100) >= t)::bigint as fp,
  count_if(quality = 1 and floor(share * 100) < t)::bigint as fn, count_if(quality = 0 and floor(share * 100) < t)::bigint as tn from s cross join l group by t),
p as (select threshold, {_PANEL} from c) select arg_min(threshold, (-f1, threshold)) as threshold, max(f1) as f1 from p""")  # fmt: skip
def grid_threshold(spark, sf_dir):
    return metrics.grid_threshold(labelled(spark, sf_dir), [], "quality", "share", 100, "f1")


_BINS = f"{_LABELLED}, b as (select lang, least(floor(share * 10), 9)::int as bin, count(*) as n, avg(share) as confidence, avg(quality::double) as accuracy from l group by all)"


@query("reliability_bins", f"""
with {_BINS}, e as (select lang, unnest(range(0, 10))::int as bin from (select distinct lang from l))
select lang, bin, coalesce(n, 0) as n, confidence, accuracy from e left join b using (lang, bin)""")  # fmt: skip
def reliability_bins(spark, sf_dir):
    """A27, A87."""
    return metrics.reliability(labelled(spark, sf_dir), ["lang"], "quality", "share")


@query("calibration_errors", f"with {_BINS} select lang, sum(abs(confidence - accuracy) * n) / sum(n) as ece, max(abs(confidence - accuracy)) as mce from b group by lang")
def calibration_errors(spark, sf_dir):
    """A28, A66, A67, A69."""
    return metrics.calibration_errors(metrics.reliability(labelled(spark, sf_dir), ["lang"], "quality", "share"), ["lang"])


@query("quantile_reliability", f"""
with {_LABELLED}, e as (select lang, list_distinct(quantile_cont(share, [0.25, 0.5, 0.75])) as edges from l group by lang),
j as (select lang, len(list_filter(edges, lambda e: e <= share))::int as bin, share, quality from l join e using (lang))
select lang, bin, count(*) as n, avg(share) as confidence, avg(quality::double) as accuracy from j group by all""")  # fmt: skip
def quantile_reliability(spark, sf_dir):
    return metrics.quantile_reliability(labelled(spark, sf_dir), ["lang"], "quality", "share", 4)


@query("brier_score", f"with {_LABELLED} select source, avg((share - quality) ** 2) as brier, avg(quality::double) as prevalence, count(*) as n from l group by source")
def brier_score(spark, sf_dir):
    return metrics.brier(labelled(spark, sf_dir), ["source"], "quality", "share")


@query("risk_coverage", f"""
with {_LABELLED}, r as (select doc_id, count(*) over w as seen, sum(1 - quality) over w as errors, count(*) over () as n from l window w as (order by share desc, doc_id rows unbounded preceding))
select doc_id, seen / n::double as coverage, errors / seen::double as risk from r""")  # fmt: skip
def risk_coverage(spark, sf_dir):
    """W04, A85."""
    return metrics.risk_coverage(labelled(spark, sf_dir), [], "share", "quality", "doc_id").select("doc_id", "coverage", "risk")


@query("risk_area", f"""
with {_LABELLED}, r as (select lang, sum(1 - quality) over w / count(*) over w::double as risk from l window w as (partition by lang order by share desc, doc_id rows unbounded preceding))
select lang, avg(risk) as aurc from r group by lang""")  # fmt: skip
def risk_area(spark, sf_dir):
    return metrics.risk_area(metrics.risk_coverage(labelled(spark, sf_dir), ["lang"], "share", "quality", "doc_id"), ["lang"])


@query("ranking_at_k", f"""
with {_LABELLED}, o as (select quality, row_number() over (order by share desc, doc_id) as place from l), b as (select avg(quality) as base, count(*) as n from l),
k as (select k, (case when k < 1 then greatest(1, floor(k * n)) else least(k, n) end)::bigint as top, base from (select unnest([10.0, 50.0, 0.1])::double as k) cross join b)
select k.k, top, base, avg(quality) as precision, avg(quality) / base as enrichment from k join o on place <= top group by k.k, top, base""")  # fmt: skip
def ranking_at_k(spark, sf_dir):
    return metrics.ranking_at(labelled(spark, sf_dir), "share", "quality", "doc_id", [10, 50, 0.1])


@query("class_panel", """
with n as (select o_orderpriority as y, case when o_totalprice > 200000 then '1-URGENT' else '3-MEDIUM' end as p from orders), c as (select y as class from n union select p from n)
select class, (select count(*) from n where y = class) as support,
  coalesce((select count(*) from n where y = class and p = class) / nullif((select count(*) from n where p = class), 0)::double, 0) as precision,
  coalesce((select count(*) from n where y = class and p = class) / nullif((select count(*) from n where y = class), 0)::double, 0) as recall,
  2 * (select count(*) from n where y = class and p = class) / ((select count(*) from n where y = class) + (select count(*) from n where p = class))::double as f1 from c""")  # fmt: skip
def class_panel(spark, sf_dir):
    """A46, A83."""
    rows = table(spark, sf_dir, "orders").withColumn("p", F.when(F.col("o_totalprice") > 200000, "1-URGENT").otherwise("3-MEDIUM"))
    return metrics.class_panel(rows, "o_orderpriority", "p")


@query("cohort_panels", f"""
with {_LABELLED}, x as (select 'lang' as grouping, lang as level, quality, toxic from l union all select 'source', source, quality, toxic from l),
c as (select grouping, level, count_if(quality = 1 and toxic = 1)::bigint as tp, count_if(quality = 0 and toxic = 1)::bigint as fp, count_if(quality = 1 and toxic = 0)::bigint as fn, count_if(quality = 0 and toxic = 0)::bigint as tn from x group by all)
select grouping, level, {_PANEL}, (tp + fp + fn + tn >= 30 and tp + fn >= 5 and fp + tn >= 5) as available from c""")  # fmt: skip
def cohort_panels(spark, sf_dir):
    """A24, P45."""
    return metrics.cohorts(labelled(spark, sf_dir), "quality", F.col("toxic"), ["lang", "source"])


@query("fold_small_groups", f"with {_LABELLED}, s as (select source, count(*) as n from l group by 1) select case when n >= 20 then source else 'other' end as source, count(*) as n from l join s using (source) group by 1")
def fold_small_groups(spark, sf_dir):
    """A49."""
    return metrics.fold_small_groups(labelled(spark, sf_dir), "source", 20).groupBy("source").agg(F.count("*").alias("n"))


@query("target_rate_encoding", f"""
with {_LABELLED}, r as (select source, avg(quality) as rate from l where doc_id % 3 > 0 group by 1)
select doc_id, coalesce(rate, (select avg(quality) from l where doc_id % 3 > 0)) as rate from l left join r using (source) where doc_id % 3 = 0""")  # fmt: skip
def target_rate_encoding(spark, sf_dir):
    """A45."""
    rows = labelled(spark, sf_dir)
    return metrics.target_rates(rows.filter("doc_id % 3 > 0"), rows.filter("doc_id % 3 = 0"), "source", "quality").select("doc_id", "rate")


@query("two_level_mean_std", """
with s as (select l_returnflag, l_linenumber, avg(l_quantity) as m, count(distinct l_linestatus) as u from lineitem group by all)
select l_returnflag, avg(m) as mean, stddev_samp(m) as sd, count(*) as n_seeds, max(u) as n_units from s group by 1""")  # fmt: skip
def two_level_mean_std(spark, sf_dir):
    """A12."""
    return metrics.seed_summary(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_linestatus", "l_linenumber", "l_quantity")


@query("benjamini_hochberg", """
with t as (select n_nationkey, ((n_nationkey * 7 + 3) % 26) / 26.0::double as p from nation), r as (select *, p * count(*) over () / row_number() over (order by p) as raw, row_number() over (order by p) as k from t)
select n_nationkey, p, least(1, min(raw) over (order by k desc)) as q from r""")  # fmt: skip
def benjamini_hochberg(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_nationkey", ((F.col("n_nationkey") * 7 + 3) % 26 / 26.0).alias("p"))
    return metrics.benjamini_hochberg(rows, "p")


@query("comparable_runs", "select l_returnflag, count(distinct l_linestatus) as l_linestatus, count(distinct l_linenumber) as l_linenumber from lineitem group by 1 having count(distinct l_linestatus) > 1 or count(distinct l_linenumber) > 1")
def comparable_runs(spark, sf_dir):
    """A50, F58."""
    return metrics.comparable(table(spark, sf_dir, "lineitem"), "l_returnflag", ["l_linestatus", "l_linenumber"])


@query("rounded_table", "select r_regionkey, format('{:.2f}', round_even(r_regionkey + 0.125::double, 2)) as x, case when r_regionkey > 2 then 'n/a' else format('{:.1f}', round_even(r_regionkey * 1.5::double, 1)) end as y from region")
def rounded_table(spark, sf_dir):
    """A70."""
    rows = table(spark, sf_dir, "region").select("r_regionkey", (F.col("r_regionkey") + 0.125).alias("x"), F.when(F.col("r_regionkey") <= 2, F.col("r_regionkey") * 1.5).alias("y"))
    return metrics.rounded(rows, {"x": 2, "y": 1})


@query("impute_medians", """
with e as (select event_id, event_type, case when value < 60 then value end as value from events),
g as (select event_type, quantile_cont(value, 0.5) as m from e group by 1)
select event_id, (value is null)::int as is_missing_value, coalesce(value, m) as value from e join g using (event_type)""")  # fmt: skip
def impute_medians(spark, sf_dir):
    """A76, A77."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.when(F.col("value") < 60, F.col("value")).alias("value"))
    return ranking.impute_medians(rows, ["value"], ["event_type"]).select("event_id", "is_missing_value", "value")


@query("standardise", """
with t as (select avg(p_size) as m, stddev_pop(p_size) as s from part where p_partkey % 2 = 0) select p_partkey, (p_size - m) / s as p_size from part cross join t where p_partkey % 2 = 1""")  # fmt: skip
def standardise(spark, sf_dir):
    """A35, A79."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"))
    return ranking.standardise(rows.filter("p_partkey % 2 = 0"), rows.filter("p_partkey % 2 = 1"), ["p_size"])


@query("top_k_by_group", """
select c_nationkey, c_custkey, c_acctbal, rank from (select c_nationkey, c_custkey, c_acctbal, row_number() over (partition by c_nationkey order by c_acctbal desc nulls last, c_custkey)::int as rank from customer) where rank <= 3""")  # fmt: skip
def top_k_by_group(spark, sf_dir):
    return ranking.top_k_by_group(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], "c_acctbal", "c_custkey", 3)


@query("top_k", "select c_custkey, c_acctbal from customer where c_acctbal > 0 order by c_acctbal desc, c_custkey limit 25")
def top_k(spark, sf_dir):
    return ranking.top_k(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", 25)


@query("entropy_margin_arrays", """
with e as (select vec_id, list_transform(embedding[1:5], lambda x: exp(x::double)) as x from embeddings), s as (select vec_id, list_transform(x, lambda v: v / list_sum(x)) as p from e)
select vec_id, -list_sum(list_transform(p, lambda v: v * ln(v))) as entropy, list_sort(p)[5] - list_sort(p)[4] as margin, (list_position(p, list_max(p)) - 1)::int as top,
  list_sum(list_transform(p, lambda v, i: (v - (i = 3)::int) ** 2)) as brier from s""")  # fmt: skip
def entropy_margin_arrays(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", arrays.softmax(F.slice("embedding", 1, 5)).alias("p"))
    return rows.select("vec_id", arrays.entropy(F.col("p")).alias("entropy"), arrays.margin(F.col("p")).alias("margin"), arrays.argmax(F.col("p")).alias("top"), arrays.one_hot_brier(F.col("p"), F.lit(2)).alias("brier"))


@query("mutual_information", """
with e as (select vec_id, [[0.2 + 0.001 * (vec_id % 100), 0.8 - 0.001 * (vec_id % 100)], [0.5, 0.5], [0.9 - 0.002 * (vec_id % 100), 0.1 + 0.002 * (vec_id % 100)]]::double[][] as s from embeddings),
m as (select vec_id, s, [(s[1][1] + s[2][1] + s[3][1]) / 3, (s[1][2] + s[2][2] + s[3][2]) / 3] as a from e)
select vec_id, -list_sum(list_transform(a, lambda v: v * ln(v))) - list_sum(list_transform(s, lambda p: -list_sum(list_transform(p, lambda v: v * ln(v))))) / 3 as mi from m""")  # fmt: skip
def mutual_information(spark, sf_dir):
    x = F.col("vec_id") % 100
    samples = F.array(F.array(0.2 + 0.001 * x, 0.8 - 0.001 * x), F.array(F.lit(0.5), F.lit(0.5)), F.array(0.9 - 0.002 * x, 0.1 + 0.002 * x))
    return table(spark, sf_dir, "embeddings").select("vec_id", arrays.mutual_information(samples).alias("mi"))


@query("abstain_reasons", "select vec_id, array_to_string(list_filter([case when list_max(embedding[1:4]) < 0.1 then 'low_confidence' end, case when vec_id % 7 = 0 then 'no_evidence' end], lambda x: x is not null), '|') as reasons from embeddings")
def abstain_reasons(spark, sf_dir):
    found = arrays.abstain(F.slice("embedding", 1, 4), 0.1, evidence=F.col("vec_id") % 7)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(found, "|").alias("reasons"))


@query("covariate_rank_sums", """
with o as (select (o_orderpriority in ('1-URGENT', '2-HIGH'))::int as y, o_totalprice, (o_custkey % 50)::double as custkey, (o_orderkey % 3 = 0)::int::double as third, case when o_orderkey % 7 > 0 then (o_orderkey % 1000) / 8 end as partly from orders),
l as (select 'o_totalprice' as covariate, y, o_totalprice as value from o union all select 'custkey', y, custkey from o union all select 'third', y, third from o union all select 'partly', y, partly from o where partly is not null),
r as (select covariate, y, value, rank() over (partition by covariate order by value) + (count(*) over (partition by covariate, value) - 1) / 2.0::double as rk from l),
t as (select covariate, sum(c::double ** 3 - c) as ties, count(*) as n_values from (select covariate, value, count(*) as c from l group by all) group by 1),
s as (select covariate, sum(y)::bigint as n, sum(1 - y)::bigint as m, sum(case when y = 1 then rk end) as sum_rank, sum((value = 1)::int * y)::bigint as ones from r group by 1)
select covariate, n, m, round(2 * sum_rank - n::double * (n + 1))::double as u2, ties::double as ties, n_values, case when covariate = 'third' then ones end as ones,
  round((sum_rank - n::double * (n + 1) / 2) / (n::double * m), 9) as effect from s join t using (covariate)""")  # fmt: skip
def covariate_rank_sums(spark, sf_dir):
    """Tie-corrected rank sums of covariates between urgent and other orders."""
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("y")
    partly = F.when(F.col("o_orderkey") % 7 > 0, (F.col("o_orderkey") % 1000) / 8).alias("partly")
    rows = table(spark, sf_dir, "orders").select(urgent, "o_totalprice", (F.col("o_custkey") % 50).alias("custkey"), (F.col("o_orderkey") % 3 == 0).cast("int").alias("third"), partly)
    found = resample.rank_sums(rows, "y", ["o_totalprice", "custkey", "third", "partly"])
    return found.select("covariate", "n", "m", F.col("u2").cast("double").alias("u2"), "ties", "n_values", F.when(F.col("binary"), F.col("ones")).alias("ones"), F.round("effect", 9).alias("effect"))


@query("covariate_levels", """
with o as (select (o_orderstatus = 'F')::int as y, o_orderpriority as level from orders), c as (select level, sum(y) as a, count(*) as n from o group by 1 having count(*) >= 5),
t as (select sum(a) / sum(n)::double as share from c)
select 'priority' as covariate, count(*) as levels, sum(n)::bigint as n, round(sum((a - n * share) ** 2 / (n * share) + (a - n * share) ** 2 / (n * (1 - share))), 6) as chi2 from c cross join t""")  # fmt: skip
def covariate_levels(spark, sf_dir):
    """Chi-square of a nominal covariate."""
    rows = table(spark, sf_dir, "orders").select((F.col("o_orderstatus") == "F").cast("int").alias("y"), F.col("o_orderpriority").alias("priority"))
    found = resample.level_counts(rows, "y", ["priority"])
    return found.select("covariate", "levels", "n", F.round("chi2", 6).alias("chi2"))


#: Ridge on two columns (a, b) by cells (g) and folds (f), solved by Cramer's rule, over a table r; the chosen models are in c.
_RIDGE = """k as (select distinct g, f as k from r),
m as (select g, k, count(*) as n, avg(a) as ma, avg(b) as mb, avg(y) as my from r join k using (g) where f <> k group by all),
s as (select g, k, n, ma, mb, my, sum((a - ma) ** 2) as aa, sum((a - ma) * (b - mb)) as ab, sum((b - mb) ** 2) as bb, sum((a - ma) * (y - my)) as ay, sum((b - mb) * (y - my)) as bt from r join m using (g) where f <> k group by all),
p as (select *, (aa + al) * (bb + al) - ab * ab as det from s cross join (select unnest([1.0::double, 100.0::double, 10000.0::double]) as al)),
w as (select *, ((bb + al) * ay - ab * bt) / det as wa, ((aa + al) * bt - ab * ay) / det as wb from p),
e as (select g, k, al, avg(((y - my - wa * (a - ma) - wb * (b - mb)) / (1 - 1.0::double / n - ((bb + al) * (a - ma) ** 2 - 2 * ab * (a - ma) * (b - mb) + (aa + al) * (b - mb) ** 2) / det)) ** 2) as err from r join w using (g) where f <> k group by all),
c as (select w.* from w join (select g, k, arg_min(al, err) as al from e group by all) using (g, k, al)),
o as (select r.*, my + wa * (a - ma) + wb * (b - mb) as predicted, al from r join c on r.g = c.g and r.f = c.k)"""
_PENALTIES = [1.0, 100.0, 10000.0]


def _priced(spark, sf_dir):
    """Lines with a price to be told from quantity and discount; the kind of a line is its assay."""
    number = lambda c, name: F.col(c).cast("double").alias(name)
    kind = F.concat("l_returnflag", "l_linestatus").alias("kind")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", kind, (F.col("l_orderkey") % 5).alias("fold"), (F.col("l_partkey") % 4).alias("part_fold"), number("l_quantity", "quantity"), (F.col("l_discount") * 100).alias("discount"), number("l_extendedprice", "price"))


_PRICED = "l as (select l_orderkey, l_linenumber, l_partkey, l_returnflag || l_linestatus as kind, l_orderkey % 5 as fold, l_partkey % 4 as part_fold, l_quantity as a, l_discount * 100 as b, l_extendedprice as y from lineitem)"


@query("out_of_fold_ridge", f"""
with {_PRICED}, r as (select l_orderkey, l_linenumber, l_partkey, kind as g, fold as f, a, b, y from l), {_RIDGE}
select l_orderkey, l_linenumber, l_partkey, round(predicted, 5) as predicted, al as alpha from o""")  # fmt: skip
def out_of_fold_ridge(spark, sf_dir):
    """Prices predicted by ridge models of the other folds, penalties chosen by leave-one-out errors."""
    done = ridge.out_of_fold_ridge(_priced(spark, sf_dir), "kind", ["quantity", "discount"], "price", "fold", _PENALTIES)
    return done.select("l_orderkey", "l_linenumber", "l_partkey", F.round("predicted", 5).alias("predicted"), "alpha")


@query("individual_and_combined", f"""
with {_PRICED}, r as (select kind, kind as g, fold as f, a, b, y from l union all select kind, 'all', part_fold, a, b, y from l), {_RIDGE},
q as (select g, kind, rank() over (partition by g, kind order by predicted) + (count(*) over (partition by g, kind, predicted) - 1) / 2.0::double as x,
  rank() over (partition by g, kind order by y) + (count(*) over (partition by g, kind, y) - 1) / 2.0::double as z from o),
t as (select g, kind, count(*) as n, corr(x, z) as rho from q group by all)
select i.kind, i.n, round(i.rho, 9) as individual, round(j.rho, 9) as combined, round(j.rho - i.rho, 9) as gain from t i join t j on i.kind = j.kind and i.g <> 'all' and j.g = 'all'""")  # fmt: skip
def individual_and_combined(spark, sf_dir):
    """Rank correlation of prices with models of one kind of line and with one model of all kinds."""
    done = ridge.individual_and_combined(_priced(spark, sf_dir), "kind", ["quantity", "discount"], "price", "fold", "part_fold", _PENALTIES)
    return done.select("kind", "n", *[F.round(c, 9).alias(c) for c in ("individual", "combined", "gain")])


@query("against_published", """
with a as (select p_brand as brand, l_quantity as q, l_extendedprice as y, l_discount as z from lineitem join part on l_partkey = p_partkey),
k as (select brand, rank() over (partition by brand order by q) + (count(*) over (partition by brand, q) - 1) / 2.0::double as rq, rank() over (partition by brand order by y) + (count(*) over (partition by brand, y) - 1) / 2.0::double as ry,
  rank() over (partition by brand order by z) + (count(*) over (partition by brand, z) - 1) / 2.0::double as rz from a),
c as (select brand, corr(rq, ry) as ours, case when brand <> 'Brand#11' then corr(rq, ry) + corr(rq, rz) end as published from k group by 1),
r as (select *, ours - published as gap from c),
b as (select corr(ours, published) as pearson, corr(ro, rp) as rank_correlation from (select ours, published, rank() over (order by ours)::double as ro, rank() over (order by published)::double as rp from r where gap is not null))
select count(*) as assays, count(gap) as compared, round(avg(ours), 9) as mean_ours, round(avg(published), 9) as mean_published, round(avg(abs(gap)), 9) as mean_abs_diff, avg((abs(gap) <= 0.02)::int) as within_002, avg((abs(gap) <= 0.05)::int) as within_005,
  round(median(gap), 9) as median_diff, round(any_value(pearson), 9) as pearson, round(any_value(rank_correlation), 9) as rank_correlation from r cross join b""")  # fmt: skip
def against_published(spark, sf_dir):
    """Own correlations of each assay beside others' (those of the price with the quantity, by brand, against a shifted copy)."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand")), "l_partkey")
    ours = metrics.spearman(rows, ["brand"], "l_quantity", "l_extendedprice").select("brand", "spearman")
    shift = metrics.spearman(rows, ["brand"], "l_quantity", "l_discount").select("brand", F.col("spearman").alias("shift"))
    published = ours.join(shift, "brand").filter("brand != 'Brand#11'").select("brand", (F.col("spearman") + F.col("shift")).alias("published"))
    done = ridge.against_published(ours, published, "brand")
    return done.select("assays", "compared", "within_002", "within_005", *[F.round(c, 9).alias(c) for c in ("mean_ours", "mean_published", "mean_abs_diff", "median_diff", "pearson", "rank_correlation")])


def _urgent_arms(spark, sf_dir):
    """Predictions of two arms and two seeds on orders, whose statuses stand for genes."""
    y = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("label")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("gene"), F.col("o_orderkey").alias("variant_key"), y, "o_custkey")
    each = orders.withColumn("a", F.explode(F.array(*[F.struct(F.lit(arm).alias("arm"), F.lit(seed).alias("seed")) for arm in ("base", "other") for seed in (0, 1)])))
    score = F.when(F.col("a.arm") == "base", (F.col("o_custkey") * 31 + F.col("a.seed") * 7) % 101 + 10 * F.col("label")).otherwise((F.col("o_custkey") * 17 + F.col("a.seed") * 5) % 89 + 14 * F.col("label"))
    return each.select("a.arm", "a.seed", "gene", "variant_key", "label", score.cast("double").alias("score"))


_ARMS = """o as (select o_orderstatus as gene, (o_orderpriority in ('1-URGENT', '2-HIGH'))::int as y, o_custkey as c from orders),
s as (select gene, y, 'base' as arm, seed, (c * 31 + seed * 7) % 101 + 10 * y as score from o cross join (values (0), (1)) v(seed) union all select gene, y, 'other', seed, (c * 17 + seed * 5) % 89 + 14 * y from o cross join (values (0), (1)) v(seed)),
k as (select *, rank() over w + (count(*) over (partition by arm, gene, seed, score) - 1) / 2.0::double as r from s window w as (partition by arm, gene, seed order by score)),
u as (select arm, gene, seed, count(*) as n, sum(1 - y)::bigint as n_benign, (sum(case when y = 1 then r end) - sum(y)::double * (sum(y) + 1) / 2) / (sum(y)::double * sum(1 - y)) as auc from k group by all),
m as (select arm, gene, any_value(n) as n, any_value(n_benign) as n_benign, count(*) as seeds, avg(auc) as auc from u group by all),
t as (select a.arm, gene, a.n, a.n_benign, a.seeds, a.auc, b.auc as auc_reference, a.auc - b.auc as delta from m a join m b using (gene) where a.arm = 'other' and b.arm = 'base')"""


@query("paired_auc", f"with {_ARMS} select arm, gene, n, n_benign, seeds, round(auc, 9) as auc, round(auc_reference, 9) as auc_reference, round(delta, 9) as delta, n >= 50 as scoreable, true as inside from t")
def paired_auc(spark, sf_dir):
    """An arm against the reference, gene by gene; the interval holds the difference."""
    found = paired.paired_table(_urgent_arms(spark, sf_dir), "base", n=200)
    inside = (F.col("ci_low") <= F.col("delta")) & (F.col("delta") <= F.col("ci_high"))
    return found.select("arm", "gene", "n", "n_benign", "seeds", *[F.round(c, 9).alias(c) for c in ("auc", "auc_reference", "delta")], "scoreable", inside.alias("inside"))


@query("paired_auc_means", f"""
with {_ARMS} select arm, string_agg(gene, '+' order by gene) as genes, sum(n)::bigint as n, sum(n_benign)::bigint as n_benign, round(avg(auc), 9) as auc, round(avg(auc_reference), 9) as auc_reference, round(avg(delta), 9) as delta
from t where n >= 50 group by 1 having count(*) >= 2""")  # fmt: skip
def paired_auc_means(spark, sf_dir):
    """The mean difference over genes."""
    found = paired.paired_means(paired.paired_draws(_urgent_arms(spark, sf_dir), "base", n=200))
    return found.select("arm", "genes", "n", "n_benign", *[F.round(c, 9).alias(c) for c in ("auc", "auc_reference", "delta")])


@query("calibrated_isotonic", """
with l as (select doc_id, lang, quality as y, n_chars % 97 / 97.0::double as s from documents join labels using (doc_id)),
e as (select * from l where doc_id % 2 = 0 and lang in (select lang from l where doc_id % 2 = 0 group by 1 having count(distinct y) > 1)),
t as (select lang, s, sum(y) as y, count(*) as w from e group by all),
c as (select *, sum(y) over v as cy, sum(w) over v as cw from t window v as (partition by lang order by s)),
m as (select a.lang, a.s as sa, b.s as sb, (b.cy - a.cy + a.y)::double / (b.cw - a.cw + a.w)::double as v from c a join c b on a.lang = b.lang and a.s <= b.s),
g as (select i.lang, i.s, m.sa, min(m.v) as v from c i join m on i.lang = m.lang and m.sa <= i.s and m.sb >= i.s group by all),
f as (select lang, s, max(v) as v from g group by all),
q as (select q.lang, q.s, max(case when f.s <= q.s then f.s end) as lo, min(case when f.s > q.s then f.s end) as hi from (select distinct lang, s from l where doc_id % 2 = 1) q join f using (lang) group by all),
z as (select q.lang, q.s, case when lo is null then b.v when hi is null then a.v else a.v + (b.v - a.v) * (q.s - lo) / (hi - lo) end as calibrated
  from q left join f a on a.lang = q.lang and a.s = lo left join f b on b.lang = q.lang and b.s = hi)
select doc_id, l.lang, l.s as score, coalesce(calibrated, l.s) as calibrated from l left join z on z.lang = l.lang and z.s = l.s where doc_id % 2 = 1""")  # fmt: skip
def calibrated_isotonic(spark, sf_dir):
    """Scores of one half of the documents by the isotonic regression of the other half, against its min-max formula."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", F.col("quality").alias("label"), (F.col("n_chars") % 97 / 97.0).alias("score"))
    return resample.calibrate(rows.filter("doc_id % 2 = 0"), rows.filter("doc_id % 2 = 1"), "lang", "label", "score", "isotonic").drop("label")
