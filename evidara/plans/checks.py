"""Checks, policies and records of runs over the supplied tables. Docstrings name the survey rows a query stands for."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidara.functions import arrays, clinical, passages, residues
from evidara.functions import text as T
from evidara.operators import corpus, joins, leakage, merge, metrics, provenance, ranking, validate
from evidara.plans.registry import query
from evidara.plans.relational import table


_TASKS = ["classify", "classify_from_codes", "acmg_codes", "evidence_type", "evidence_polarity", "vus_priority", "explanation", "pretraining"]


@query("task_policies", f"""
with t as (select {_TASKS}[(doc_id % 8)::int + 1] as task, text from documents)
select task, true as mask_conclusions, task not in ('classify_from_codes', 'pretraining') as mask_codes, 4::int as n_forbidden, count(*) as n_documents, count_if(length(text) > 1000) as n_long from t group by task""")  # fmt: skip
def task_policies(spark, sf_dir):
    """U32: what each task masks in the documents that are dealt to it."""
    task = F.get(F.array(*map(F.lit, _TASKS)), (F.col("doc_id") % 8).cast("int")).alias("task")
    docs = table(spark, sf_dir, "documents").select(task, F.coalesce(F.length("text") > 1000, F.lit(False)).alias("long"))
    held = docs.groupBy("task").agg(F.count("*").alias("n_documents"), F.count_if("long").alias("n_long"))
    return provenance.policy_table(spark).join(held, "task")


@query("applicable_codes", """
select s_suppkey, case when s_suppkey % 3 = 0 then 23 else 26 end::int as n_codes, s_suppkey % 3 > 0 as has_pm1, false as has_pp5 from supplier""")  # fmt: skip
def applicable_codes(spark, sf_dir):
    """criteria that may be predicted for a gene."""
    gene = F.when(F.col("s_suppkey") % 3 == 0, "mlh1").otherwise("BRCA1")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", provenance.applicable_codes(gene).alias("c"))
    return rows.select("s_suppkey", F.size("c").alias("n_codes"), F.array_contains("c", "PM1").alias("has_pm1"), F.array_contains("c", "PP5").alias("has_pp5"))


@query("one_hot_design", """
with l as (select l_orderkey * 10 + l_linenumber as k, l_linenumber as p from lineitem)
select k, (p - 1) * 20 + 14 as "column", 1.0::double as value from l union all select k, (p - 1) * 20 + 5, -1.0::double from l""")  # fmt: skip
def one_hot_design(spark, sf_dir):
    """The one-hot design of substitutions (G to R) as rows."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), F.col("l_linenumber").cast("long").alias("position"), F.lit("G").alias("wt_aa"), F.lit("R").alias("mut_aa"))
    return provenance.design_rows(rows, "k")


@query("functional_orientation", """
with x as (select l_linestatus as assay, l_quantity as a, l_extendedprice as d from lineitem), r as (
  select assay, rank() over (partition by assay order by a) + (count(*) over (partition by assay, a) - 1) / 2.0::double as ra, rank() over (partition by assay order by d) + (count(*) over (partition by assay, d) - 1) / 2.0::double as rd from x)
select assay, count(*) as n, corr(ra, rd) as spearman from r group by assay""")  # fmt: skip
def functional_orientation(spark, sf_dir):
    """Damage grows with an independent score in every assay."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("assay"), F.col("l_quantity").alias("prior"), F.col("l_extendedprice").alias("damage_score"))
    return provenance.orientation(rows, "prior")


@query("slice_report", """
with l as (select quality as y, n_chars % 997 / 997.0::double as a, toxic::double as b from documents join labels using (doc_id) where lang = 'en'),
u as (select y, 'a' as score, a as p from l union all select y, 'b', b from l),
k as (select score, y, rank() over (partition by score order by p) + (count(*) over (partition by score, p) - 1) / 2.0::double as r from u),
c as (select score, count_if(y = 1 and p >= 0.5)::double as tp, count_if(y = 0 and p >= 0.5)::double as fp, count_if(y = 1 and p < 0.5)::double as fn, count_if(y = 0 and p < 0.5)::double as tn from u group by 1)
select 'english' as slice, score, (tp + fp + fn + tn)::bigint as n, (select (sum(r * y) - sum(y) * (sum(y) + 1) / 2.0::double) / (sum(y) * (count(*) - sum(y))) from k where k.score = c.score)::double as auc,
  case when (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 then (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) else 0 end as mcc,
  case when tp + fp > 0 then tp / (tp + fp) else 0 end as precision, case when tp + fn > 0 then tp / (tp + fn) else 0 end as recall from c""")  # fmt: skip
def slice_report(spark, sf_dir):
    """Measures of several scores on a slice."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = rows.select("quality", "lang", (F.col("n_chars") % 997 / 997.0).alias("a"), F.col("toxic").cast("double").alias("b"))
    return provenance.slice_report(rows, "quality", ["a", "b"], F.col("lang") == "en", "english")


@query("evidence_index", """
select count(*) as n_units, count(distinct document_id) as n_documents from (select item_id as document_id from benchmark where item_id not in (select doc_id from labels where toxic = 1))""")  # fmt: skip
def evidence_index(spark, sf_dir):
    """An index over units whose documents train; every item is one unit, toxic ones are known to be left out."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("document_id"), "text")
    roles = table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("document_id"), F.lit("EXCLUDED").alias("role"))
    units = items.select("document_id", F.col("document_id").cast("string").alias("evidence_id"), F.lit("evidence").alias("sentence_role"), F.col("text").alias("text_span"))
    kept, found = provenance.evidence_index(units, roles)
    indexed = kept.join(found.select("evidence_id").distinct(), "evidence_id", "left_semi")
    return indexed.agg(F.count("*").alias("n_units"), F.count_distinct("document_id").alias("n_documents"))


@query("frequency_evidence", """
select l_orderkey, l_linenumber, (l_discount >= 0.05)::int as ba1, (l_discount >= 0.001 and l_discount < 0.05)::int as bs1, (l_discount <= 0.00001)::int as pm2,
  case when l_discount > 0 then greatest(log10(l_discount), -7) else -7 end::double as log10_af, case when l_linenumber >= 3 then '3+' else l_linenumber::varchar end as stars from lineitem""")  # fmt: skip
def frequency_evidence(spark, sf_dir):
    """Frequency criteria and star bands."""
    f = clinical.frequency_flags(F.col("l_discount"))
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", f["ba1"].alias("ba1"), f["bs1"].alias("bs1"), f["pm2"].alias("pm2"), f["log10_af"].alias("log10_af"), clinical.star_band(F.col("l_linenumber")).alias("stars"))


@query("condition_lists", """
select p_partkey, 'MedGen:C' || p_partkey || '|MONDO:' || p_size as ids, 'Gastric cancer' as name, p_size % 2 = 0 as is_specific, 'cc-by-nc' as licence, 'pathogenic' as said from part""")  # fmt: skip
def condition_lists(spark, sf_dir):
    """conditions, their ids and names, and licence spellings."""
    rows, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    ids = F.concat(F.lit("OMIM:1,MedGen:C"), k, F.lit("|MONDO:MONDO:"), "p_size")
    name = F.get(clinical.conditions(ids, F.lit("Gastric cancer|-")), F.lit(0))["name"]
    special = clinical.specific_condition(F.when(F.col("p_size") % 2 == 0, "Lynch syndrome").otherwise("not provided"))
    said = clinical.normalized_classification(F.lit("Pathogenic; other"))["label5"]
    return rows.select("p_partkey", F.array_join(clinical.condition_ids(ids), "|").alias("ids"), name.alias("name"), special.alias("is_specific"), clinical.licence_code(F.lit("CC BY-NC 4.0")).alias("licence"), said.alias("said"))


@query("window_spans", r"""
select p_partkey, least(greatest(0, p_size - 5), greatest(0, 60 - 10))::int as start, substr(repeat('-', 3) || p_name || repeat('-', 3), (p_partkey % length(p_name))::int + 1, 7) as around from part""")  # fmt: skip
def window_spans(spark, sf_dir):
    """Windows around a position, moved inside the chain or padded beyond its ends."""
    rows = table(spark, sf_dir, "part")
    span = residues.centered_span(F.lit(60), F.col("p_size"), 10)
    at = (F.col("p_partkey") % F.length("p_name") + 1).cast("int")
    return rows.select("p_partkey", span["start"].cast("int").alias("start"), residues.window(F.col("p_name"), at).alias("around"))


@query("missing_and_classes", """
select 'ts' as "column", avg((case when value > 50 then null else 1 end is null)::int::double) as missing_share from events union all select 'user_id', avg((user_id is null)::int::double) from events""")  # fmt: skip
def missing_and_classes(spark, sf_dir):
    """The share of nulls in each column."""
    rows = table(spark, sf_dir, "events").withColumn("ts", F.when(F.col("value") <= 50, F.col("ts")))
    return validate.missing_shares(rows, ["ts", "user_id"])


@query("evidence_edges", """
select l_orderkey::varchar as subject, 'has_part' as predicate, l_partkey::varchar as object, 'tpch' as source_id from lineitem union
select l_orderkey::varchar, 'has_supplier', l_suppkey::varchar, 'tpch' from lineitem""")  # fmt: skip
def evidence_edges(spark, sf_dir):
    """Edges of several kinds as one table."""
    items = table(spark, sf_dir, "lineitem")
    return joins.edges({"has_part": (items, "l_orderkey", "l_partkey"), "has_supplier": (items, "l_orderkey", "l_suppkey")}, "tpch")


@query("residual_phrases", """
select doc_id, (doc_id % 3 = 0)::int as n from documents""")  # fmt: skip
def residual_phrases(spark, sf_dir):
    """Texts that still assert a class."""
    said = F.when(F.col("doc_id") % 3 == 0, "Thus it is likely pathogenic.").otherwise("A benign tumour grew.")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.residual_assertions(said)).alias("n"))


@query("column_quartiles", """
select lang, count(n_chars) as n, sum(n_chars)::bigint as total, quantile_cont(n_chars, 0.25) as p25, quantile_cont(n_chars, 0.5) as median, quantile_cont(n_chars, 0.75) as p75, max(n_chars) as max, avg(n_chars) as mean from documents group by lang""")  # fmt: skip
def column_quartiles(spark, sf_dir):
    """Lengths by language, with exact quartiles."""
    return corpus.lengths(table(spark, sf_dir, "documents"), "n_chars", ["lang"])


@query("rank_features", """
with r as (select s_suppkey, s_nationkey, rank() over (partition by s_nationkey order by s_acctbal) + (count(*) over (partition by s_nationkey, s_acctbal) - 1) / 2.0::double as r, count(*) over (partition by s_nationkey) as n from supplier)
select s_suppkey, r / n as pct, case when r / n >= 0.9 then 'high' when r / n >= 0.7 then 'medium' else 'low' end as tier from r""")  # fmt: skip
def rank_features(spark, sf_dir):
    """Percentile ranks within a group, and their tiers."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return ranking.risk_tiers(rows, ["s_nationkey"], "s_acctbal").select("s_suppkey", "pct", "tier")


_RULED = """
r as (select 'P' || l_partkey as uniprot_id, l_partkey as k, (l_linenumber - 1)::bigint as position, ['A', 'R', 'B', 'G', 'N'][(l_orderkey % 5)::int + 1] as wt_aa, ['G', 'R', 'K', 'E', 'D'][(l_orderkey % 5)::int + 1] as mut_aa from lineitem),
c as (select r.*, case when wt_aa = 'B' then 'residue' when position < 1 then 'position' when wt_aa = mut_aa then 'synonymous'
  when p_name is not null and (position > length(p_name) or upper(substr(p_name, position::int, 1)) <> wt_aa) then 'sequence' end as reason from r left join part on k = p_partkey)"""


def _records(spark, sf_dir):
    """Records from line items: position as a decimal text, residues in small letters with blanks."""
    k = (F.col("l_orderkey") % 5).cast("int")
    pick = lambda *v: F.lower(F.get(F.array(*[F.lit(x) for x in v]), k))
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("P"), "l_partkey").alias("uniprot_id"), F.concat((F.col("l_linenumber") - 1).cast("string"), F.lit(".0")).alias("position"), F.concat(F.lit(" "), pick("A", "R", "B", "G", "N")).alias("wt_aa"),
        pick("G", "R", "K", "E", "D").alias("mut_aa"), F.lit("G").alias("gene"), (F.col("l_quantity") > 25).cast("double").alias("label"), F.lit("items").alias("label_source"), "l_discount", F.col("l_linenumber").alias("ordinal"),
    )
    return validate.normalise_keys(rows)


def _sequences(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.concat(F.lit("P"), "p_partkey").alias("uniprot_id"), F.upper("p_name").alias("sequence"))


@query("record_rules", f"with {_RULED} select reason, count(*) as n from c group by reason")
def record_rules(spark, sf_dir):
    """Records of one substitution by the first rule they break, against their protein's sequence."""
    return validate.valid_records(_records(spark, sf_dir), _sequences(spark, sf_dir)).groupBy("reason").agg(F.count("*").alias("n"))


@query("assembled_table", f"""
with {_RULED}, l as (select 'P' || l_partkey as uniprot_id, (l_linenumber - 1)::bigint as position, ['A', 'R', 'B', 'G', 'N'][(l_orderkey % 5)::int + 1] as wt_aa, ['G', 'R', 'K', 'E', 'D'][(l_orderkey % 5)::int + 1] as mut_aa, (l_quantity > 25)::int as y from lineitem),
ok as (select distinct uniprot_id, position, wt_aa, mut_aa from c where reason is null)
select uniprot_id, position, wt_aa, mut_aa, count(distinct y) > 1 as quarantined, case when count(distinct y) = 1 then min(y)::double end as label from l join ok using (uniprot_id, position, wt_aa, mut_aa) group by all""")  # fmt: skip
def assembled_table(spark, sf_dir):
    """Validated records of a source assembled into one row a change; changes of two labels are quarantined."""
    made, _ = merge.assemble({"items": _records(spark, sf_dir).drop("gene")}, {"items": 1}, ["l_discount"], _sequences(spark, sf_dir))
    return made.select("uniprot_id", "position", "wt_aa", "mut_aa", "quarantined", "label")


@query("unobserved_defaults", """
select l_orderkey, l_linenumber, (l_discount > 0.02)::int::double as seen, case when l_discount > 0.02 then l_discount else -7 end as value from lineitem""")  # fmt: skip
def unobserved_defaults(spark, sf_dir):
    """Evidence values for rows that a source does not have."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_discount") > 0.02, F.col("l_discount")).alias("value"))
    return merge.unobserved_defaults(rows, "seen", {"value": -7.0})


@query("column_policies", """
select * from (values ('absent', 'o_absent: absent'), ('type', 'o_orderkey: bigint instead of int'), ('forbidden', 'refused'), ('wanted', 'refused'), ('proxy', 'refused'), ('left', 'o_custkey')) as t("check", outcome)""")  # fmt: skip
def column_policies(spark, sf_dir):
    """What a table's columns must be and must not be."""
    orders = table(spark, sf_dir, "orders")
    found = validate.schema_problems(orders, {"o_absent": "int", "o_orderkey": "int", "o_custkey": "bigint"})

    def refused(check):
        try:
            check()
        except ValueError:
            return "refused"
        return "accepted"

    left = validate.without_families(["o_custkey", "gnomad_af"], ["frequency"])
    rows = [
        ("absent", found[0]), ("type", found[1]), ("forbidden", refused(lambda: validate.check_forbidden(["review_label"]))), ("wanted", refused(lambda: validate.align_columns(orders.columns, ["o_absent"]))),
        ("proxy", refused(lambda: validate.without_families(["plain"], ["frequency"], {"plain": "frequency"}))), ("left", ",".join(left)),
    ]
    return spark.createDataFrame(rows, "check string, outcome string")


@query("key_checks", """
with a as (select distinct o_custkey as k from orders), b as (select c_custkey as k from customer where c_acctbal > 0)
select count_if(a.k is not null and b.k is not null)::bigint as in_both, count_if(b.k is null)::bigint as left_only, count_if(a.k is null)::bigint as right_only from a full join b on a.k = b.k""")  # fmt: skip
def key_checks(spark, sf_dir):
    """Rows lost by a join and ids without a partner."""
    rows, side = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return validate.key_difference(rows, side, ["k"])


@query("transcript_and_gaps", """
select o_orderkey, case o_orderkey % 4 when 0 then 'mane' when 1 then 'mane_version_mismatch' when 2 then 'non_mane' else 'unknown' end as status,
  case when o_orderkey % 3 = 0 then 'complete' when o_orderkey % 3 = 1 then 'partial' else 'sparse' end as gaps from orders""")  # fmt: skip
def transcript_and_gaps(spark, sf_dir):
    """A transcript against the chosen one of its gene, and how many of a row's columns are missing."""
    k = F.col("o_orderkey")
    transcript = F.get(F.array(F.lit("NM_1.4"), F.lit("NM_1.3"), F.lit("NM_2.1"), F.lit(None).cast("string")), (k % 4).cast("int"))
    gaps = clinical.missingness([F.when(k % 3 == 0, 1), F.when(k % 3 < 2, 1), F.when(k % 3 < 2, 1)])
    return table(spark, sf_dir, "orders").select("o_orderkey", residues.transcript_status(F.lit("MLH1"), transcript, {"MLH1": "NM_1.4"}).alias("status"), gaps.alias("gaps"))


@query("overlapping_spans", """
with p as (select p_partkey, (p_size * 60)::bigint as n from part), s as (select p_partkey, n, unnest(case when n <= 1022 then [0] else range(0, (ceil((n - 1022) / 766.0) * 766)::bigint + 1, 766) end) as s from p)
select p_partkey, least(s, greatest(n - 1022, 0)) as start, least(n, s + 1022) as "end" from s""")  # fmt: skip
def overlapping_spans(spark, sf_dir):
    """Overlapping windows over a chain, the last one ending with it."""
    spans = residues.sliding_spans((F.col("p_size") * 60).cast("long"))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(spans).alias("s")).select("p_partkey", "s.start", "s.end")


@query("end_spans", """
with p as (select p_partkey, p_size::bigint as a from part) select p_partkey,
  case when a < 20 and a <= 59 - a then 0 when a >= 40 and a > 59 - a then 40 else greatest(0, least(a - 10, 40)) end as start from p""")  # fmt: skip
def end_spans(spark, sf_dir):
    """The window at the nearer end of the chain where that holds the position."""
    return table(spark, sf_dir, "part").select("p_partkey", residues.asymmetric_span(F.lit(60), F.col("p_size"), 20)["start"].alias("start"))


@query("average_class_f1", """
with n as (select o_orderpriority as y, case when o_totalprice > 150000 then '1-URGENT' else '2-HIGH' end as p from orders), c as (select distinct y as class from n),
f as (select class, (select count(*) from n where y = class) as s, coalesce(2 * (select count(*) from n where y = class and p = class) / ((select count(*) from n where y = class) + (select count(*) from n where p = class))::double, 0) as f1 from c)
select avg(f1) as macro_f1, sum(f1 * s) / sum(s) as weighted_f1 from f""")  # fmt: skip
def average_class_f1(spark, sf_dir):
    """F1 averaged over classes, plainly and by their size."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("y"), F.when(F.col("o_totalprice") > 150000, "1-URGENT").otherwise("2-HIGH").alias("p"))
    return metrics.averaged_f1(metrics.class_panel(rows, "y", "p"))


@query("class_counts", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by all")
def class_counts(spark, sf_dir):
    """The counts of labels and predictions."""
    return metrics.class_confusion(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


@query("multilabel_panel", """
with l as (select (l_quantity > 25)::int as y1, l_discount * 10 as p1, (l_tax > 0.04)::int as y2, l_tax * 10 as p2 from lineitem), u as (select 'quantity' as name, y1 as y, p1 as p from l union all select 'tax', y2, p2 from l),
c as (select name, count_if(y = 1 and p >= 0.5)::double as tp, count_if(y = 0 and p >= 0.5)::double as fp, count_if(y = 1 and p < 0.5)::double as fn from u group by name)
select name, case when tp + fp > 0 then tp / (tp + fp) else 0 end as precision, case when tp + fn > 0 then tp / (tp + fn) else 0 end as recall from c""")  # fmt: skip
def multilabel_panel(spark, sf_dir):
    """Measures of each label of a set."""
    y = F.array((F.col("l_quantity") > 25).cast("int"), (F.col("l_tax") > 0.04).cast("int")).alias("y")
    rows = table(spark, sf_dir, "lineitem").select(y, F.array(F.col("l_discount") * 10, F.col("l_tax") * 10).alias("p"))
    return metrics.multilabel_panel(rows, "y", "p", ["quantity", "tax"]).select("name", "precision", "recall")


@query("shared_citations", """
with s as (select o_custkey as v, case when o_orderkey % 4 = 0 then 'test' else 'train' end as split, o_orderpriority as c from orders)
select 'shared_citations' as "check", case when count(*) > 0 then 'warning' else 'ok' end as severity, count(*)::double as n from (
  select c from (select distinct s.v, s.split, t.c from s join (select distinct v, c from s) t using (v)) group by c having count_if(split = 'train') > 0 and count_if(split <> 'train') > 0)""")  # fmt: skip
def shared_citations(spark, sf_dir):
    """Publications that both sides of a split cite."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("variation_id"), F.when(F.col("o_orderkey") % 4 == 0, "test").otherwise("train").alias("split"), F.col("o_orderpriority").alias("citation_id"))
    return leakage.shared_citations(rows.select("variation_id", "split"), rows.select("variation_id", "citation_id"))


@query("holdout_findings", """
select 'named_holdouts' as "check", case when n > 0 then 'critical' else 'ok' end as severity, n::double as n from (select count_if(doc_id % 3 > 0 and text like '%license%') as n from documents)
union all select 'teacher', case when n > 0 then 'critical' else 'ok' end, n::double from (select count_if(doc_id % 3 = 0) as n from labels where doc_id in (select doc_id from documents))
union all select 'teacher_unknown', 'critical', count(*)::double from labels""")  # fmt: skip
def holdout_findings(spark, sf_dir):
    """Training texts that name a held-out identifier, and a teacher's rows outside training."""
    split = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("input_text"), F.when(F.col("doc_id") % 3 > 0, "train").otherwise("test").alias("split"))
    labels = table(spark, sf_dir, "labels")
    return leakage.audit([leakage.named_holdouts(split, "license"), leakage.outside_training("teacher", labels, split, "doc_id"), leakage.outside_training("teacher_unknown", labels, split.limit(0), "doc_id")])


@query("code_vectors", "select s_suppkey, [(s_suppkey % 2 = 0)::int, 1, 0]::int[] as hot, s_suppkey % 3 = 0 as matched, 'zs_esm_1v_ens' as name from supplier")
def code_vectors(spark, sf_dir):
    """Codes as a vector of 0 and 1, keyword groups, and names of models as columns."""
    codes = F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("PM2"), F.lit("PP3"))).otherwise(F.array(F.lit("PP3")))
    said = F.when(F.col("s_suppkey") % 3 == 0, "Colon CANCER").otherwise("colon")
    matched = arrays.keywords_match(said, F.array(F.array(F.lit("COLON"), F.lit("x")), F.array(F.lit("cancer"))))
    return table(spark, sf_dir, "supplier").select("s_suppkey", arrays.multi_hot(codes, ["PM2", "PP3", "BA1"]).alias("hot"), matched.alias("matched"), F.lit(T.model_column("ESM-1v (ens)")).alias("name"))


@query("answer_citations", "select item_id, 2 as n_claims, 1 as n_cited, '9' as wrong from benchmark")
def answer_citations(spark, sf_dir):
    """claims of an answer that cite a passage that exists, and citations that do not."""
    answer = F.concat(F.lit("Item number "), F.col("item_id").cast("string"), F.lit(" is about the gene. [1] It also binds other proteins [9]."))
    return table(spark, sf_dir, "benchmark").select("item_id", passages.citations_udf(answer, F.lit(3)).alias("c")).select("item_id", "c.n_claims", "c.n_cited", F.array_join("c.wrong", ",").alias("wrong"))


_CODES = (["PM2", "PS3", "PVS1", "PM5"], ["", "_supporting", " strong", "-moderate"], ["PP3", "BP4", "BS1"], ["BA1", "PP5", "BP7", "PS1", "PM1"], ["pathogenic", "likely pathogenic", "benign", "likely benign"])


@query("masked_codes", rf"""
with c as (
  select doc_id, coalesce(text, '') as text, {_CODES[0]}[(doc_id % 4)::int + 1] as a, {_CODES[2]}[(doc_id % 3)::int + 1] as b, {_CODES[3]}[(doc_id % 5)::int + 1] as c, {_CODES[4]}[(doc_id % 4)::int + 1] as word from documents),
m as (
  select *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text || '; applied (, ) here; ' || case when doc_id % 6 = 0 then ' was not met' else ' was met' end,
    '\(\s*[,;\s]*\)|\[\s*[,;\s]*\]', '', 'g'), '(?:\s*,){{2,}}', ',', 'g'), '[ \t]{{2,}}', ' ', 'g'), '\s+([.,;:])', '\1', 'g') as masked from c)
select doc_id, sha256(regexp_replace(masked, '^\s+|\s+$', '', 'g')) as text_sha256, 3 as n_codes, a || ':true,' || b || ':true,' || c || ':' || (doc_id % 6 <> 0) as found,
  'classification_statement' as verdict, case when word like '%benign' then 'benign' else 'pathogenic' end as direction from m""")  # fmt: skip
def masked_codes(spark, sf_dir):
    """criteria codes of various strengths behind whole documents, found and masked; a sentence's verdict and the
    direction of its evidence."""
    pick = lambda i, by: F.get(F.array(*map(F.lit, _CODES[i])), (by % len(_CODES[i])).cast("int"))
    k = F.col("doc_id")
    met = F.when(k % 6 == 0, " was not met").otherwise(" was met")
    said = F.concat(F.coalesce("text", F.lit("")), F.lit("; applied ("), pick(0, k), pick(1, F.floor(k / 4)), F.lit(", "), pick(2, k), F.lit(") here; "), pick(3, k), met)
    verdict = F.concat(F.lit("This variant is classified as "), pick(4, k), F.lit("."))
    docs = table(spark, sf_dir, "documents").select("doc_id", said.alias("said"), verdict.alias("verdict"))
    made = docs.select("doc_id", passages.codes_masked_udf(F.col("said")).alias("m"), passages.codes_udf(F.col("said")).alias("c"), passages.verdict_udf(F.col("verdict")).alias("v"))
    found = F.array_join(F.transform("c", lambda x: F.concat(x["code"], F.lit(":"), x["met"].cast("string"))), ",")
    return made.select("doc_id", F.sha2("m.text", 256).alias("text_sha256"), "m.n_codes", found.alias("found"), "v.verdict", "v.direction")
