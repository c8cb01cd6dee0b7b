"""Sources and sinks: each query writes supplied tables, whole, in a release's format to the shared folder, reads them back with
the source, and is held against SQL over the tables. Docstrings name the survey rows a query stands for."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara import schemas
from evidara.functions import residues as R
from evidara.operators import structure
from evidara.operators.graph import shared_folder
from evidara.plans.registry import query
from evidara.plans.relational import table
from evidara.sources import delimited, nested, sinks


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _lines(rows: DataFrame, line: Column, name: str, header: str | None = None) -> str:
    """``rows`` as text lines, as many files as tasks write; a header is a file of its own, the first by path."""
    path, spark = _place(rows.sparkSession, name), rows.sparkSession
    rows.select(line.cast("string").alias("value")).write.text(f"{path}/rows")
    if header is None:
        return f"{path}/rows"
    spark.createDataFrame([(header,)], "value string").coalesce(1).write.text(f"{path}/head")
    return f"{path}/*"


def _xml(rows: DataFrame, element: Column, name: str) -> str:
    """Elements under a root, 64 files at most, each of a 64th of the rows."""
    path = _place(rows.sparkSession, name)
    each = rows.select(element.alias("e")).withColumn("file", F.pmod(F.xxhash64("e"), F.lit(64)))
    whole = F.concat(F.lit("<set>\n"), F.array_join(F.collect_list("e"), "\n"), F.lit("\n</set>"))
    each.groupBy("file").agg(whole.alias("value")).write.partitionBy("file").text(path)
    return path


def _tab(*cells) -> Column:
    return F.concat_ws("\t", *[F.coalesce(c.cast("string"), F.lit("-")) for c in cells])


def _pick(key: Column, *values: str) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (key % len(values)).cast("int"))


# Variant releases

_SAID = ("Pathogenic", "Likely benign", "Uncertain significance", "Conflicting classifications of pathogenicity", "Benign/Likely benign")
_STATUS = ("criteria provided, single submitter", "reviewed by expert panel", "no assertion criteria provided", "criteria provided, multiple submitters, no conflicts")
_PART = f"""
v as (select p_partkey as k, p_brand as gene, p_size as pos, {list(_SAID)}[(p_partkey % 5)::int + 1] as said, {list(_STATUS)}[(p_partkey % 4)::int + 1] as status,
  [1, 3, 0, 2][(p_partkey % 4)::int + 1] as stars from part)"""


def _summary_file(spark: SparkSession, sf_dir: str) -> str:
    part = table(spark, sf_dir, "part").withColumn("assembly", F.explode(F.array(F.lit("GRCh37"), F.lit("GRCh38"))))
    k, pos = F.col("p_partkey"), F.col("p_size")
    at = F.when(F.col("assembly") == "GRCh38", k * 10).otherwise(k * 10 + 7)
    cells = {
        "AlleleID": k + 5, "Type": F.lit("single nucleotide variant"), "Name": F.concat(F.lit("NM_000249.4("), "p_brand", F.lit("):c."), pos * 3 - 1, F.lit("G>A (p.Gly"), pos, F.lit("Arg)")),
        "GeneSymbol": F.col("p_brand"), "ClinicalSignificance": _pick(k, *_SAID), "LastEvaluated": F.lit("Jan 05, 2020"), "PhenotypeIDS": F.concat(F.lit("MONDO:MONDO:1,MedGen:C"), k, F.lit("|MedGen:C2")),
        "PhenotypeList": F.concat(F.lit("Disease "), k, F.lit("|not provided")), "Assembly": F.col("assembly"), "Chromosome": F.lit("2"), "Start": at, "Stop": at, "ReviewStatus": _pick(k, *_STATUS),
        "NumberSubmitters": k % 3 + 1, "VariationID": k, "PositionVCF": at, "ReferenceAlleleVCF": F.lit("G"), "AlternateAlleleVCF": F.lit("A"),
    }
    rows = part.select(_tab(*[cells.get(c, F.lit("-")) for c in delimited.SUMMARY]).alias("value")).union(spark.createDataFrame([("ragged\tline",)], "value string"))
    return _lines(rows, F.col("value"), "summary", "#" + "\t".join(delimited.SUMMARY))


@query("release_variants", f"""
with {_PART} select k as variation_id, gene, 'c.' || (pos * 3 - 1) || 'G>A' as change, case k % 5 when 0 then 'pathogenic' when 1 then 'likely_benign' when 2 then 'vus' end as label5,
  case k % 5 when 3 then 'conflicting' when 4 then 'pair' else 'five_class' end as label_category, stars::int as stars, '2020-01-05' as last_evaluated, 'GRCh38:2:' || k * 10 || ':G:A' as genomic_key,
  'MedGen:C' || k as disease, pos::bigint as position, 'missense' as consequence, (k % 3 + 1)::int as n_submitters from v""")  # fmt: skip
def release_variants(spark, sf_dir):
    """A release of two assembly rows a variant, read as one record each."""
    rows = delimited.variant_summary(spark, _summary_file(spark, sf_dir))
    return rows.select("variation_id", "gene", "change", "label5", "label_category", "stars", "last_evaluated", "genomic_key", F.get("disease_ids", F.lit(0)).alias("disease"), "substitution.position", "consequence", "n_submitters")


@query("release_missense", f"""
with {_PART}, r as (select *, case said when 'Pathogenic' then 1.0 when 'Likely benign' then 0.0 when 'Benign/Likely benign' then 0.0 end::double as y from v where stars >= 2),
m as (select gene, pos, min(k) as k from r where y is not null group by all)
select 'P_' || gene as uniprot_id, pos::bigint as position, 'G' as wt_aa, 'R' as mut_aa, gene, y as label, 'clinvar' as label_source, case when stars >= 3 then 'expert' else 'multiple' end as evidence_tier
from m join r using (gene, pos, k)""")  # fmt: skip
def release_missense(spark, sf_dir):
    """Labelled missense records of at least two stars, the first of each key."""
    genes = table(spark, sf_dir, "part").select(F.col("p_brand").alias("gene")).distinct().withColumn("uniprot_id", F.concat(F.lit("P_"), "gene"))
    summary = delimited.variant_summary(spark, _summary_file(spark, sf_dir)).withColumn("ordinal", F.col("variation_id"))
    return delimited.missense_records(summary, genes).drop("ordinal")


@query("release_submissions", f"""
select 'SCV' || lpad(o_orderkey::varchar, 9, '0') as document_id, o_custkey as variation_id, strftime(o_orderdate, '%Y-%m-%d') as date, case o_orderkey % 5 when 0 then 'pathogenic' when 1 then 'likely_benign' when 2 then 'vus' end as label5,
  case when o_orderkey % 4 = 1 then 1 when o_orderkey % 4 = 2 then 5 else 2 end as tier, o_orderkey % 7 = 0 as restricted, 'MedGen:C' || lpad(o_custkey::varchar, 7, '0') as disease, case when o_orderkey % 2 = 0 then (o_orderkey + 10000)::varchar end as pmid
from orders""")  # fmt: skip
def release_submissions(spark, sf_dir):
    """Submissions with label, tier, restriction, phenotypes and publications."""
    orders, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    text = F.concat(F.lit("This is a description of the evidence that is long enough. "), F.when(k % 2 == 0, F.concat(F.lit("PMID: "), k + 10000)).otherwise(F.lit("No publication")))
    cells = {
        "VariationID": F.col("o_custkey"), "ClinicalSignificance": _pick(k, *_SAID), "DateLastEvaluated": F.date_format("o_orderdate", "MMM dd, yyyy"), "Description": text,
        "ReportedPhenotypeInfo": F.concat(F.lit("C"), F.lpad(F.col("o_custkey").cast("string"), 7, "0"), F.lit(":Lynch syndrome;other")), "ReviewStatus": _pick(k, *_STATUS), "CollectionMethod": F.lit("clinical testing"),
        "Submitter": F.when(k % 7 == 0, "OMIM").otherwise("Lab"), "SCV": F.concat(F.lit("SCV"), F.lpad(k.cast("string"), 9, "0")), "SubmittedGeneSymbol": F.lit("MLH1"),
    }
    path = _lines(orders, _tab(*[cells[c] for c in delimited.SUBMISSION]), "submissions", "#" + "\t".join(delimited.SUBMISSION))
    rows = delimited.submissions(spark, path)
    return rows.select("document_id", "variation_id", "date", "label5", "tier", "restricted", F.get("disease_ids", F.lit(0)).alias("disease"), F.get("text_pmids", F.lit(0)).alias("pmid"))


@query("release_citations", "select distinct l_partkey as variation_id, l_suppkey as allele_id, 'PubMed' as citation_source, l_orderkey::varchar as citation_id from lineitem")
def release_citations(spark, sf_dir):
    """Citations without repeats."""
    line = _tab(F.col("l_suppkey"), F.col("l_partkey"), F.lit("PubMed"), F.col("l_orderkey"))
    return delimited.citations(spark, _lines(table(spark, sf_dir, "lineitem"), line, "citations", "#AlleleID\tVariationID\tcitation_source\tcitation_id"))


@query("curated_criteria", """
select 'D' || o_orderkey as document_id, case o_orderkey % 3 when 0 then 'PM2_Supporting|PP3' when 1 then 'PVS1' else '' end as met from orders""")  # fmt: skip
def curated_criteria(spark, sf_dir):
    """A curation export under other header names."""
    orders, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    path = _lines(orders, _tab(F.concat(F.lit("D"), k), _pick(k, "PM2_supporting, PP3; PP3", "pvs1", "none given"), F.lit("BS1")), "curation", "Identifier\tMet codes\tNot met")
    rows = delimited.curated_labels(spark, path, {"document_id": "Identifier", "codes_met": "Met codes", "codes_not_met": "Not met"})
    return rows.select("document_id", F.array_join("codes_met", "|").alias("met"))


# Scores

_CHANGE = "'A' || l_linenumber || 'V'"


@query("pathogenicity_lines", f"""
select 'P' || l_suppkey as uniprot_id, l_linenumber::bigint as position, 'A' as wt_aa, 'V' as mut_aa, 'G' || l_suppkey as gene, l_discount as feature_alphamissense_score,
  case when l_discount > 0.05 then 'likely_pathogenic' else 'ambiguous' end as am_class from lineitem join supplier on l_suppkey = s_suppkey where s_acctbal > 0""")  # fmt: skip
def pathogenicity_lines(spark, sf_dir):
    """A large score file of four columns, only the wanted accessions (suppliers with a balance)."""
    rows, s = table(spark, sf_dir, "lineitem"), F.col("l_suppkey")
    kind = F.when(F.col("l_discount") > 0.05, "likely_pathogenic").otherwise("ambiguous")
    path = _lines(rows, _tab(F.concat(F.lit("P"), s), F.concat(F.lit("A"), "l_linenumber", F.lit("V")), F.col("l_discount"), kind), "scores", "uniprot_id\tprotein_variant\tam_pathogenicity\tam_class")
    wanted = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.concat(F.lit("P"), "s_suppkey").alias("uniprot_id"), F.concat(F.lit("G"), "s_suppkey").alias("gene"))
    return delimited.pathogenicity_scores(spark, path, wanted).drop("ordinal")


@query("score_set", """
select 'P1' as uniprot_id, p_partkey as position, 'G' as wt_aa, 'R' as mut_aa, 'MLH1' as gene, 'urn:1' as assay, p_retailprice as raw_score, -p_retailprice as damage_score, null::double as functional_class from part where p_partkey % 9 > 0""")  # fmt: skip
def score_set(spark, sf_dir):
    """A score set by protein names; names that are no substitution (every ninth) are left out."""
    part = table(spark, sf_dir, "part")
    name = F.when(F.col("p_partkey") % 9 == 0, "p.=").otherwise(F.concat(F.lit("p.Gly"), "p_partkey", F.lit("Arg")))
    path = _place(spark, "set")
    part.select(name.alias("hgvs_pro"), F.col("p_retailprice").alias("score")).write.option("header", True).csv(path)
    return delimited.score_set(spark, path, "MLH1", "P1", "urn:1", False)


@query("odds_file", """
select 'MSH2' as gene, p_partkey as position, 'A' as wt_aa, 'V' as mut_aa, p_retailprice / 100 as oddspath, log10(p_retailprice / 100) as log10_oddspath,
  case when p_retailprice / 100 >= 350 then 'PS3_very_strong' when p_retailprice / 100 >= 18.7 then 'PS3_strong' when p_retailprice / 100 >= 4.3 then 'PS3_moderate' when p_retailprice / 100 >= 2.08 then 'PS3_supporting' else 'indeterminate' end as strength
from part where p_size % 5 > 0""")  # fmt: skip
def odds_file(spark, sf_dir):
    """Odds with their strength; splicing mechanisms (sizes divisible by five) are left out."""
    part, path = table(spark, sf_dir, "part"), _place(spark, "odds")
    part.select(
        F.lit("MSH2").alias("gene"), F.col("p_partkey").alias("position"), F.lit("a").alias("wt_aa"), F.lit("V").alias("mut_aa"), (F.col("p_retailprice") / 100).alias("cimra_oddspath"),
        F.when(F.col("p_size") % 5 == 0, "aberrant Splicing").otherwise("protein").alias("mechanism"),
    ).write.option("header", True).csv(path)
    return delimited.odds_table(spark, path).select("gene", "position", "wt_aa", "mut_aa", "oddspath", "log10_oddspath", "strength")


@query("expert_file", """
select 'G' || s_suppkey as gene, s_suppkey as position, case when s_suppkey % 2 = 0 then 'G' else 'K' end as wt_aa, case when s_suppkey % 2 = 0 then 'R' else 'E' end as mut_aa, (s_acctbal > 0)::int::double as label, 'expert' as label_source from supplier""")  # fmt: skip
def expert_file(spark, sf_dir):
    """Expert labels by a protein name or by explicit columns."""
    rows, path, k = table(spark, sf_dir, "supplier"), _place(spark, "expert"), F.col("s_suppkey")
    named = k % 2 == 0
    rows.select(
        F.concat(F.lit("G"), k).alias("gene"), (F.col("s_acctbal") > 0).cast("int").alias("label"), F.when(named, F.concat(F.lit("p.Gly"), k, F.lit("Arg"))).alias("hgvs_p"),
        F.when(~named, k).alias("position"), F.when(~named, "K").alias("wt_aa"), F.when(~named, "E").alias("mut_aa"),
    ).write.option("header", True).csv(path)
    return delimited.expert_labels(spark, path, "expert").drop("ordinal")


@query("confirmations_file", "select distinct 'G' as gene, l_linenumber::bigint as position, l_returnflag as wt_aa, l_linestatus as mut_aa, 'rna' as method from lineitem")
def confirmations_file(spark, sf_dir):
    """Confirmations without repeats."""
    rows, path = table(spark, sf_dir, "lineitem"), _place(spark, "confirmed")
    rows.select(F.lit("G").alias("gene"), F.col("l_linenumber").alias("position"), F.col("l_returnflag").alias("wt_aa"), F.col("l_linestatus").alias("mut_aa"), F.lit("rna").alias("method")).write.option("header", True).csv(path)
    return delimited.confirmations(spark, path)


@query("cluster_file", "select distinct l_orderkey::varchar as member, l_suppkey::varchar as cluster from lineitem")
def cluster_file(spark, sf_dir):
    """Cluster and member, two columns."""
    return delimited.cluster_members(spark, _lines(table(spark, sf_dir, "lineitem"), _tab(F.col("l_suppkey"), F.col("l_orderkey")), "clusters"))


@query("prediction_files", """
select 'main' as arm, 'gbm' as model, c_nationkey::int as seed, c_custkey::varchar as variant_key, (c_acctbal > 0)::int as label, c_acctbal as score from customer""")  # fmt: skip
def prediction_files(spark, sf_dir):
    """Prediction files under a glob, their cell names split."""
    rows, path = table(spark, sf_dir, "customer"), _place(spark, "predictions")
    rows.select(F.concat(F.lit("main__gbm__seed"), "c_nationkey").alias("cell"), F.lit("G").alias("gene"), F.col("c_custkey").alias("variant_key"), (F.col("c_acctbal") > 0).cast("int").alias("label"), F.col("c_acctbal").alias("score"), F.lit(0.5).alias("threshold"), F.lit("f").alias("fold")).write.option("header", True).csv(path)
    return delimited.predictions(spark, f"{path}/*.csv").select("arm", "model", "seed", "variant_key", "label", "score")


@query("side_table_files", "select n_nationkey::varchar as n_nationkey, n_name, true as named from nation")
def side_table_files(spark, sf_dir):
    """Side tables under a glob with the file each row came from."""
    path = _place(spark, "side")
    table(spark, sf_dir, "nation").select("n_nationkey", "n_name").write.option("header", True).csv(path)
    return delimited.side_tables(spark, f"{path}/*.csv").select("n_nationkey", "n_name", F.col("source_file").endswith(".csv").alias("named"))


@query("run_summary_files", "select s_suppkey as run, s_acctbal as auc from supplier")
def run_summary_files(spark, sf_dir):
    """Summaries of runs anywhere under a folder, in JSON files of about 1,000 runs each: as many files as runs would
    be opened and renamed one by one."""
    path, runs = _place(spark, "runs"), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("run"), F.col("s_acctbal").alias("auc"))
    _summaries(runs, path)
    return delimited.run_summaries(spark, path, "run long, auc double", "part-*").select("run", "auc")


def _summaries(runs: DataFrame, path: str, each: int = 1000) -> None:
    """``runs`` as arrays of JSON objects, about ``each`` of them a file, in a folder of its own."""
    files = -(-runs.count() // each) or 1
    dealt = runs.groupBy(F.pmod(F.xxhash64("run"), F.lit(files)).alias("folder")).agg(F.to_json(F.collect_list(F.struct(*runs.columns)), {"ignoreNullFields": "false"}).alias("value"))
    dealt.write.partitionBy("folder").text(path)


@query("question_lines", "select item_id, text from benchmark")
def question_lines(spark, sf_dir):
    """JSON lines with comments and lines that are no JSON."""
    rows = table(spark, sf_dir, "benchmark").select(F.to_json(F.struct("item_id", "text")).alias("value")).union(spark.createDataFrame([("// a comment",), ("",)], "value string"))
    return delimited.jsonl(spark, _lines(rows, F.col("value"), "questions"), "item_id long, text string")


@query("fasta_entries", "select 'P' || p_partkey as id, upper(regexp_replace(p_name, '\\s', '', 'g')) as sequence from part")
def fasta_entries(spark, sf_dir):
    """Sequences written in wrapped lines and read back."""
    rows, path = table(spark, sf_dir, "part"), _place(spark, "fasta")
    sinks.fasta(rows.select(F.concat(F.lit("P"), "p_partkey").alias("id"), F.regexp_replace("p_name", r"\s", "").alias("sequence")), path, width=7)
    return delimited.fasta(spark, path)


# Nested files

@query("population_files", """
with v as (select 'G' || s_nationkey as gene, s_suppkey as pos, s_suppkey % 40 as ac, 1000 + s_suppkey as an from supplier)
select gene, pos::bigint as position, 'G' as wt_aa, 'R' as mut_aa, ac::bigint + 1 as ac, an::bigint * 2 as an, (ac + 1) / (an * 2)::double as af from v""")  # fmt: skip
def population_files(spark, sf_dir):
    """Cached answers, one file a gene; counts of exomes and genomes are pooled."""
    rows, path, k = table(spark, sf_dir, "supplier"), _place(spark, "population"), F.col("s_suppkey")
    seen = lambda ac: F.struct(ac.cast("long").alias("ac"), (k + 1000).cast("long").alias("an"))
    variant = F.struct(F.concat(F.lit("2-"), k, F.lit("-G-A")).alias("variant_id"), F.concat(F.lit("p.Gly"), k, F.lit("Arg")).alias("hgvsp"), F.lit(None).cast("string").alias("hgvsc"), F.lit("missense_variant").alias("consequence"), seen(k % 40).alias("exome"), seen(F.lit(1)).alias("genome"))
    genes = rows.groupBy(F.concat(F.lit("G"), "s_nationkey").alias("symbol")).agg(F.collect_list(variant).alias("variants"))  # a gene's variants
    genes.select(F.struct(F.struct("symbol", "variants").alias("gene")).alias("data"), F.col("symbol").alias("file")).write.partitionBy("file").json(path)
    return nested.population_variants(spark, path).select("gene", "position", "wt_aa", "mut_aa", "ac", "an", "af")


@query("constraint_files", "select n_name as gene, n_nationkey / 30.0::double as \"pLI\", n_regionkey::double as mis_z from nation")
def constraint_files(spark, sf_dir):
    """Constraint of each gene from its own file."""
    path = _place(spark, "constraint")
    found = F.struct((F.col("n_nationkey") / F.lit(30.0)).alias("pLI"), F.col("n_regionkey").cast("double").alias("mis_z")).alias("gnomad_constraint")
    table(spark, sf_dir, "nation").select(F.struct(F.struct(F.col("n_name").alias("symbol"), found).alias("gene")).alias("data"), F.col("n_nationkey").alias("file")).write.partitionBy("file").json(path)
    return nested.gene_constraint(spark, path).select("gene", "pLI", "mis_z")


@query("protein_residues", """
with p as (select n_nationkey as k, n_regionkey as r, unnest(range(1, length(n_name) + 1)) as position, least(length(n_name), 2 + n_regionkey) as e from nation)
select 'P' || k as uniprot_id, position::int as position, case when position between 2 and e then 'Domain' else '' end as domain, (position between 2 and e)::int as in_domain, case when position = 1 then 'Active site' else '' end as site, (position = 1)::int as has_site from p""")  # fmt: skip
def protein_residues(spark, sf_dir):
    """Every residue of protein entries with its domains and sites."""
    rows, path = table(spark, sf_dir, "nation"), _place(spark, "proteins")
    place = lambda a, b: F.struct(F.struct(a.cast("int").alias("value")).alias("start"), F.struct(b.cast("int").alias("value")).alias("end")).alias("location")
    feature = lambda kind, a, b: F.struct(F.lit(kind).alias("type"), F.lit("d").alias("description"), place(a, b))
    entry = rows.select(
        F.concat(F.lit("P"), "n_nationkey").alias("primaryAccession"), F.struct(F.col("n_name").alias("value"), F.length("n_name").alias("length")).alias("sequence"),
        F.array(feature("Domain", F.lit(2), F.least(F.length("n_name"), F.col("n_regionkey") + 2)), feature("Active site", F.lit(1), F.lit(1))).alias("features"), F.col("n_nationkey").alias("file"),
    )
    entry.write.partitionBy("file").json(path)
    return nested.residue_table(nested.proteins(spark, path))


@query("entry_intervals", """
select 'P' || n_nationkey as uniprot_id, 'IPR' || r_regionkey as entry, r_name as name, 'domain' as type, n_nationkey + 1 as start, n_nationkey + 9 as "end" from nation join region on n_regionkey = r_regionkey""")  # fmt: skip
def entry_intervals(spark, sf_dir):
    """Four nested lists as intervals."""
    fragment = F.array(F.struct(F.array(F.struct((F.col("n_nationkey") + 1).alias("start"), (F.col("n_nationkey") + 9).alias("end"))).alias("fragments")))
    protein = F.struct(F.concat(F.lit("p"), "n_nationkey").alias("accession"), fragment.alias("entry_protein_locations"))
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    entries = rows.groupBy("r_regionkey", "r_name").agg(F.collect_list(protein).alias("proteins"))
    meta = F.struct(F.concat(F.lit("IPR"), "r_regionkey").alias("accession"), F.col("r_name").alias("name"), F.lit("domain").alias("type"))
    path = _place(spark, "entries")
    entries.select(F.array(F.struct(meta.alias("metadata"), "proteins")).alias("results"), F.col("r_regionkey").alias("file")).write.partitionBy("file").json(path)
    return nested.entry_intervals(spark, path)


@query("structure_confidence", """
with a as (select n_nationkey as k, unnest(range(1, 21)) as position from nation), b as (select k, position, ((k * 7 + position * 13) % 100)::double as plddt from a)
select k as structure, position::int as position, plddt, case when plddt >= 90 then 'very_high' when plddt >= 70 then 'confident' when plddt >= 50 then 'low' else 'very_low' end as band, (plddt < 50)::int as disordered from b""")  # fmt: skip
def structure_confidence(spark, sf_dir):
    """Fixed-width structure files; side-chain atoms, other locations and later models do not count."""
    path, k = _place(spark, "structures"), F.col("n_nationkey")
    each = table(spark, sf_dir, "nation").withColumn("position", F.explode(F.sequence(F.lit(1), F.lit(20))))
    value = ((k * 7 + F.col("position") * 13) % 100).cast("double")
    line = lambda atom, loc, b: F.format_string(f"ATOM  %5d  {atom}{loc}GLY A%4d    %8.3f%8.3f%8.3f%6.2f%6.2f", F.col("position"), F.col("position"), *[F.lit(1.0)] * 3, F.lit(1.0), b)
    atoms = each.select("n_nationkey", F.explode(F.array(line("CA ", " ", value), line("CB ", " ", F.lit(1.0)), line("CA ", "B", F.lit(2.0)))).alias("value"))
    atoms.repartitionByRange(64, "n_nationkey").write.partitionBy("n_nationkey").text(path)
    named = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("structure"), "n_nationkey").distinct()
    return nested.residue_confidence(nested.atoms(spark, path)).join(named, "structure").select(F.col("n_nationkey").alias("structure"), "position", "plddt", "band", "disordered")


_NAMES = ("ALA", "GLY", "LEU", "TRP", "LYS")
_COORDINATES = {"x": (7919, 104729), "y": (15485, 32452), "z": (49979, 86028)}
#: Thousandths of an angstrom from 0 to 60,000, of a customer's atom number ``a``.
_AT = ", ".join(f"((c_custkey * {k} + a * {s}) % 60000) / 1000.0::double as {c}" for c, (k, s) in _COORDINATES.items())


@query("structure_surfaces", f"""
with r as (select c_custkey, 's' || (c_custkey // 400) as structure, (c_custkey % 400 + 1)::int as position, c_custkey % 5 as kind from customer),
t as (select c_custkey, structure, position, kind, unnest(range(case when kind = 1 then 3 else 4 end)) as a from r),
p as (select *, ['N', 'CA', 'C', 'CB'][a::int + 1] as atom, [1.55, 1.7, 1.7, 1.7][a::int + 1]::double + 1.4::double as radius, {_AT} from t),
s as (
  select i, sqrt(1 - z * z) * cos(i * (pi() * (3 - sqrt(5::double)))) as u, sqrt(1 - z * z) * sin(i * (pi() * (3 - sqrt(5::double)))) as v, z as w
  from (select i, 1 - (2 * i + 1) / 96.0::double as z from range(96) q(i))),
n as (
  select p.structure, p.position, p.a, q.x as nx, q.y as ny, q.z as nz, q.radius as nr from p join p q
  on p.structure = q.structure and (p.position, p.a) <> (q.position, q.a) and (p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2 < (p.radius + q.radius) ** 2),
h as (
  select distinct p.structure, p.position, p.a, i from p join n using (structure, position, a) cross join s
  where (x + radius * u - nx) ** 2 + (y + radius * v - ny) ** 2 + (z + radius * w - nz) ** 2 < nr ** 2),
k as (select structure, position, a, count(*) as hidden from h group by all),
e as (
  select structure, position, sum(4 * pi() * radius ** 2 * (1 - coalesce(hidden, 0) / 96.0::double)) as area from p left join k using (structure, position, a) group by all),
m as (select a.structure, a.position, a.x, a.y, a.z, b.x as bx, b.y as b_y, b.z as bz from p a join p b using (structure, position) where a.atom = 'CA' and b.atom = 'CB'),
c as (
  select m.structure, m.position, count_if((m.bx - o.bx) ** 2 + (m.b_y - o.b_y) ** 2 + (m.bz - o.bz) ** 2 <= 64) as near,
    count_if((m.x - o.x) ** 2 + (m.y - o.y) ** 2 + (m.z - o.z) ** 2 <= 169 and (o.x - m.x) * (m.bx - m.x) + (o.y - m.y) * (m.b_y - m.y) + (o.z - m.z) * (m.bz - m.z) > 0) as up
  from m join m o on m.structure = o.structure and m.position <> o.position group by all)
select r.structure, r.position, ['A', 'G', 'L', 'W', 'K'][kind::int + 1] as residue, round(area, 4) as area,
  round(least(1.5, area / [129.0, 104.0, 201.0, 285.0, 236.0][kind::int + 1]), 6)::double as exposure
from r join e using (structure, position)""")  # fmt: skip
def structure_surfaces(spark, sf_dir):
    """Exposed surface of the residues in structure files that are written from customers, 400 residues a structure."""
    rows = table(spark, sf_dir, "customer").withColumn("kind", F.col("c_custkey") % 5).withColumn("position", (F.col("c_custkey") % 400 + 1).cast("int"))
    each = rows.withColumn("a", F.explode(F.sequence(F.lit(0), F.when(F.col("kind") == 1, 2).otherwise(3))))
    at = [((F.col("c_custkey") * k + F.col("a") * s) % 60000) / 1000 for k, s in _COORDINATES.values()]
    name = F.get(F.array(*map(F.lit, ("N  ", "CA ", "C  ", "CB "))), F.col("a"))
    line = F.format_string("ATOM  %5d  %s %s A%4d    %8.3f%8.3f%8.3f%6.2f%6.2f", F.col("position"), name, _pick(F.col("c_custkey"), *_NAMES), F.col("position"), *at, F.lit(1.0), F.lit(80.0))
    path = _place(spark, "surfaces")
    files = each.groupBy(F.concat(F.lit("s"), F.floor(F.col("c_custkey") / 400)).alias("model")).agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("value"))
    files.write.partitionBy("model").text(path)  # a file is one structure, of 1,600 lines at most
    atoms = nested.atoms(spark, path, F.regexp_extract("_metadata.file_path", "model=([^/]+)/", 1))
    made = structure.residue_features(atoms)
    return made.select("structure", "position", "residue", F.round("area", 4).alias("area"), F.round("exposure", 6).alias("exposure"))


# Text sources

def _escaped(text: Column) -> Column:
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20-\x7e]", " ")
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        clean = F.replace(clean, F.lit(char), F.lit(entity))
    return clean


@query("abstract_files", """
select doc_id as pmid, (2000 + doc_id % 20)::int as year, case when doc_id % 5 = 0 then 'retracted' when doc_id % 5 = 1 then 'language' when doc_id % 5 = 2 then 'no_abstract' end as reason,
  case when doc_id % 5 = 2 then 0 else n_chars end::bigint as n_chars from (select doc_id, n_chars from documents)""")  # fmt: skip
def abstract_files(spark, sf_dir):
    """Article XML with the reason an article is left out."""
    docs, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    abstract = F.when(k % 5 == 2, "").otherwise(F.concat(F.lit("<Abstract><AbstractText>"), F.repeat(F.lit("x"), F.col("n_chars").cast("int")), F.lit("</AbstractText></Abstract>")))
    line = F.concat(
        F.lit("<PubmedArticle><MedlineCitation><PMID>"), k, F.lit("</PMID><Article><ArticleTitle>About "), k, F.lit("</ArticleTitle><Language>"), F.when(k % 5 == 1, "fre").otherwise("eng"), F.lit("</Language>"), abstract,
        F.lit("<PublicationTypeList><PublicationType>"), F.when(k % 5 == 0, "Retracted Publication").otherwise("Journal Article"), F.lit("</PublicationType></PublicationTypeList><Journal><JournalIssue><PubDate><MedlineDate>"),
        k % 20 + 2000, F.lit(" Jan-Feb</MedlineDate></PubDate></JournalIssue></Journal></Article></MedlineCitation></PubmedArticle>"),
    )
    rows = nested.abstracts(spark, _xml(docs, line, "abstracts"))
    return rows.select("pmid", "year", "reason", F.length("abstract").cast("long").alias("n_chars"))


@query("topic_files", "select p_partkey as k, lower(p_name) as title, p_type || chr(10) || p_brand as text from part")
def topic_files(spark, sf_dir):
    """Topic summaries in XML, their markup gone."""
    line = F.concat(F.lit("<health-condition-summary><name>"), _escaped(F.col("p_name")), F.lit("</name><reviewed>"), F.col("p_partkey"), F.lit("</reviewed><text-list>"), *[F.concat(F.lit("<text><text-role>r</text-role><html>&lt;p&gt;"), _escaped(F.col(c)), F.lit("&lt;/p&gt;</html></text>")) for c in ("p_type", "p_brand")], F.lit("</text-list></health-condition-summary>"))
    rows = nested.health_topics(spark, _xml(table(spark, sf_dir, "part"), line, "topics"))
    return nested.documents(rows.select(F.col("reviewed").cast("long").alias("k"), "title", "text"))


@query("disorder_files", "select 'ORPHA:' || s_suppkey as document_id, s_name as title, 'about ' || s_name as text from supplier")
def disorder_files(spark, sf_dir):
    """Disorders with their summaries."""
    line = F.concat(F.lit("<Disorder><OrphaCode>"), "s_suppkey", F.lit("</OrphaCode><Name>"), _escaped(F.col("s_name")), F.lit("</Name><SummaryInformationList><SummaryInformation><TextSectionList><TextSection><Contents>about "), _escaped(F.col("s_name")), F.lit("</Contents></TextSection></TextSectionList></SummaryInformation></SummaryInformationList></Disorder>"))
    return nested.rare_disorders(spark, _xml(table(spark, sf_dir, "supplier"), line, "disorders")).select("document_id", "title", "text")


@query("ontology_file", "select 'MONDO:' || p_partkey as document_id, p_name as title, 'kind ' || p_type as text, 'syn ' || p_brand as synonym from part where p_size % 6 > 0")
def ontology_file(spark, sf_dir):
    """Terms of an ontology file; obsolete ones (sizes divisible by six) are left out."""
    part = table(spark, sf_dir, "part")
    stanza = F.concat(F.lit("\n[Term]\nid: MONDO:"), "p_partkey", F.lit("\nname: "), "p_name", F.lit('\ndef: "kind '), "p_type", F.lit('" [x]\nsynonym: "syn '), "p_brand", F.lit('" EXACT'), F.when(F.col("p_size") % 6 == 0, "\nis_obsolete: true").otherwise(""), F.lit("\n"))
    return nested.ontology_terms(spark, _lines(part, stanza, "ontology")).select("document_id", "title", "text", F.get("synonyms", F.lit(0)).alias("synonym"))


@query("protein_note_file", "select 'P' || p_partkey as document_id, p_brand as genes, p_name || chr(10) || p_type as text from part")
def protein_note_file(spark, sf_dir):
    """Notes of a protein export without evidence tags."""
    path = _place(spark, "notes")
    table(spark, sf_dir, "part").select(F.concat(F.lit("P"), "p_partkey").alias("Entry"), F.col("p_brand").alias("Gene Names"), F.concat("p_name", F.lit(" {ECO:0000269|PubMed:1}.")).alias("Function"), F.col("p_type").alias("Disease")).write.option("header", True).option("sep", "\t").csv(path)
    return nested.protein_notes(spark, path).select("document_id", "genes", "text")


# Sinks

@query("declared_table", "select 'V' || l_partkey || ':' || l_linenumber as variant_id, l_partkey as variation_id, l_returnflag as gene, null::varchar as label5, l_linenumber::int as stars from lineitem")
def declared_table(spark, sf_dir):
    """Rows under a declared schema, written by gene and read back; absent columns are null."""
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("V"), "l_partkey", F.lit(":"), "l_linenumber").alias("variant_id"), F.col("l_partkey").alias("variation_id"), F.col("l_returnflag").alias("gene"), F.col("l_linenumber").alias("stars"), F.lit(1).alias("more"))
    return sinks.table(rows, schemas.VARIANTS, _place(spark, "variants"), ["gene"]).select("variant_id", "variation_id", "gene", "label5", "stars")


@query("feature_store_rows", "select s_suppkey as variant_id, s_acctbal as value from supplier where s_acctbal > 0")
def feature_store_rows(spark, sf_dir):
    """A block stored under its identity; the wanted rows are read from it."""
    rows = table(spark, sf_dir, "supplier")
    store, identity = sinks.FeatureStore(spark, _place(spark, "store")), {"model": "m", "layer": 3}
    store.write("family", "tag", identity, rows.select(F.col("s_suppkey").alias("variant_id"), F.col("s_acctbal").alias("value")))
    return store.rows("family", "tag", identity, rows.filter("s_acctbal > 0").select(F.col("s_suppkey").alias("variant_id")))


@query("corpus_shards", """
with d as (select doc_id, source, length(text) as n, ('0x' || substr(sha1(doc_id::varchar), 1, 8))::bigint % 1000 < 10 as v from documents where doc_id not in (select doc_id from labels where toxic = 1))
select source as source_id, case when v then 'validation' else 'train' end as split, count(*) as n_documents, sum(n)::bigint as n_chars from d group by all""")  # fmt: skip
def corpus_shards(spark, sf_dir):
    """A corpus in sharded JSON by split without the excluded documents; the figures are those of the files."""
    docs, path = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("source_id"), "text"), _place(spark, "corpus")
    sinks.corpus(docs, path, "doc_id", [(table(spark, sf_dir, "labels").filter("toxic = 1"), "doc_id")], shard_rows=500)
    back = spark.read.schema("doc_id long, source_id string, text string, split string").json(path)
    return back.groupBy("source_id", "split").agg(F.count("*").alias("n_documents"), F.sum(F.length("text")).alias("n_chars"))


@query("index_on_disk", """
select (select count(*) from documents) as n_documents, (select sha256(string_agg(h, chr(10) order by s)) from (
  select substr(d, 1, 2) as s, sha256(string_agg(d, chr(10) order by d)) as h from (select distinct sha256(doc_id::varchar || chr(9) || sha256(text)) as d from documents) group by 1)) as digest""")  # fmt: skip
def index_on_disk(spark, sf_dir):
    """Postings and documents on disk under a digest that is read back."""
    docs, path = table(spark, sf_dir, "documents").select("doc_id", "text"), _place(spark, "index")
    digest = sinks.search_index(docs, path, "doc_id", "text")
    assert digest in sinks.read_text(spark, f"{path}/digest.json")
    return spark.read.parquet(f"{path}/documents").agg(F.count("*").alias("n_documents"), F.lit(digest).alias("digest"))


@query("bundle_manifest", "select 'nation' as name, count(*) as n_rows, true as listed from nation union all select 'region', count(*), true from region")
def bundle_manifest(spark, sf_dir):
    """Named tables and the manifest that lists all their files with size and digest."""
    path = _place(spark, "bundle")
    names = ["nation", "region"]
    made = sinks.bundle(spark, path, {n: table(spark, sf_dir, n) for n in names}, {"made_by": "test"})
    listed = {n: sum(1 for a in made["artefacts"] if f"/{n}/" in a["path"] and a["length"] > 0 and len(a["sha256"]) == 64) > 0 for n in names}
    parts = [spark.read.parquet(f"{path}/{n}").agg(F.lit(n).alias("name"), F.count("*").alias("n_rows"), F.lit(listed[n]).alias("listed")) for n in names]
    return parts[0].union(parts[1])


@query("rendered_changes", r"""
select p_partkey, 'p.Gly' || p_size || 'Arg' as rendered, 'P' || p_partkey || ':' || p_size || ':G>R' as variant_id, p_size::bigint as parsed, 'P' || p_partkey || ':' || p_size as group_key, 'G' || p_size || 'R' as short, 'c.' || p_size || 'G>A' as cdna from part""")  # fmt: skip
def rendered_changes(spark, sf_dir):
    """Names and keys rendered and parsed again."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("P"), "p_partkey").alias("acc"), F.col("p_size").alias("pos"))
    name, key = R.format_change(F.lit("G"), F.col("pos"), F.lit("R")), R.variant_id(F.col("acc"), F.col("pos"), F.lit("G"), F.lit("R"))
    cdna = R.normalised_cdna(F.concat(F.lit("C."), "pos", F.lit("g>a")))
    return rows.select("p_partkey", name.alias("rendered"), key.alias("variant_id"), R.parse_variant_id(key)["position"].alias("parsed"), R.group_key(F.col("acc"), F.col("pos")).alias("group_key"), R.short_protein(name).alias("short"), cdna.alias("cdna"))
