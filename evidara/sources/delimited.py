"""Delimited releases and user tables: every source is a function of (spark, path) that gives a declared schema, null for what
is missing, and where one of several rows will be kept an ``ordinal`` of its place in the files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.functions import clinical as C
from evidara.functions import residues as R
from evidara.operators.merge import first_by

RECORD = ["uniprot_id", "position", "wt_aa", "mut_aa", "gene", "label", "label_source", "evidence_tier"]
MISSING = ("", "-", "na", "NA", "nan", "None")


def ordinal() -> Column:
    """Orders rows as they stand in the files, however the files are split."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def lines(spark: SparkSession, path: str, skip: str | None = None) -> DataFrame:
    """value and ordinal of the lines that do not start with ``skip``."""
    rows = spark.read.text(path).select(F.regexp_replace("value", r"\r$", "").alias("value"), ordinal().alias("ordinal"))
    return rows.filter(~F.col("value").startswith(skip)) if skip else rows


def table(spark: SparkSession, path: str, required: Sequence[str], sep: str = "\t", header: str = "#", comment: str | None = "##") -> DataFrame:
    """A delimited file whose header line starts with ``header`` or is the first line: required columns as strings, null for
    the usual signs of absence, ragged rows left out. Columns that are not there are named in the error."""
    rows = lines(spark, path, comment)
    first = rows.orderBy("ordinal").select("value").first()
    names = [n.strip() for n in first.value.lstrip(header).split(sep)] if first else []
    if absent := [c for c in required if c not in names]:
        raise ValueError(f"absent columns: {absent}")
    cells = F.split("value", sep, -1)
    good = rows.filter((F.size(cells) == len(names)) & (F.col("value") != F.lit(first.value)))
    cell = lambda c: F.trim(F.get(cells, F.lit(names.index(c))))
    return good.select(*[F.when(~cell(c).isin(*MISSING), cell(c)).alias(c) for c in required], "ordinal")


def csv(spark: SparkSession, path: str, required: Sequence[str], optional: Sequence[str] = ()) -> DataFrame:
    """A quoted CSV file with a header; optional columns that are not there are null."""
    rows = spark.read.option("header", True).option("multiLine", False).csv(path)
    if absent := [c for c in required if c not in rows.columns]:
        raise ValueError(f"absent columns: {absent}")
    clean = lambda c: F.when(~F.trim(F.col(f"`{c}`")).isin(*MISSING), F.trim(F.col(f"`{c}`")))
    return rows.select(*[clean(c).alias(c) for c in required], *[(clean(c) if c in rows.columns else F.lit(None).cast("string")).alias(c) for c in optional], ordinal().alias("ordinal"))


# Variant releases

SUMMARY = ["AlleleID", "Type", "Name", "GeneSymbol", "ClinicalSignificance", "LastEvaluated", "PhenotypeIDS", "PhenotypeList", "Assembly", "Chromosome", "Start", "Stop", "ReviewStatus", "NumberSubmitters", "VariationID", "PositionVCF", "ReferenceAlleleVCF", "AlternateAlleleVCF"]


def variant_summary(spark: SparkSession, path: str, genes: Sequence[str] | None = None, assembly: str = "GRCh38", conflicting_stars: int = 1) -> DataFrame:
    """One record for each variant: its row of the preferred assembly, else the first; with parsed names, conditions and keys."""
    rows = table(spark, path, SUMMARY)
    if genes:
        rows = rows.filter(F.upper("GeneSymbol").isin(*[g.upper() for g in genes]))
    rows = rows.withColumn("VariationID", F.col("VariationID").try_cast("bigint")).filter("VariationID is not null")
    best = first_by(rows, ["VariationID"], [(F.coalesce(F.col("Assembly"), F.lit("")) != assembly).cast("int"), F.col("ordinal")])
    span = F.col("Stop").try_cast("bigint") - F.col("Start").try_cast("bigint") + 1
    name, info = R.variant_name(F.col("Name")), C.normalized_classification(F.col("ClinicalSignificance"))
    condition = C.conditions(F.col("PhenotypeIDS"), F.col("PhenotypeList"))
    return best.select(
        F.col("VariationID").alias("variation_id"), F.concat(F.lit("VariationID:"), F.col("VariationID")).alias("variant_id"), F.col("GeneSymbol").alias("gene"),
        F.split("GeneSymbol", "[;,]").alias("genes"), F.col("Name").alias("name"), name["transcript"].alias("transcript"), name["change"].alias("change"), name["protein"].alias("protein"),
        R.consequence(F.col("Type"), F.col("Name"), span).alias("consequence"), F.col("ClinicalSignificance").alias("significance"), info["label5"].alias("label5"),
        info["category"].alias("label_category"), F.col("ReviewStatus").alias("review_status"), C.stars(F.col("ReviewStatus"), conflicting_stars).alias("stars"), C.iso_date(F.col("LastEvaluated")).alias("last_evaluated"),
        F.transform(condition, lambda c: c["id"]).alias("disease_ids"), F.transform(condition, lambda c: c["name"]).alias("disease_names"),
        R.genomic_key(F.col("Chromosome"), F.col("PositionVCF"), F.col("ReferenceAlleleVCF"), F.col("AlternateAlleleVCF"), assembly).alias("genomic_key"),
        R.three_letter_change(F.col("Name")).alias("substitution"), F.col("NumberSubmitters").try_cast("int").alias("n_submitters"), "ordinal",
    )


def missense_records(summary: DataFrame, accessions: DataFrame, min_stars: int = 2, source: str = "clinvar") -> DataFrame:
    """Record-schema rows of missense variants with a binary label, the first of each key, and their accession (gene, uniprot_id)."""
    rows = summary.filter(F.col("substitution").isNotNull() & (F.col("stars") >= min_stars)).withColumn("label", C.significance_label(F.col("significance")))
    joined = rows.filter("label is not null").join(accessions, "gene").select("uniprot_id", "substitution.*", "gene", "label", F.lit(source).alias("label_source"), C.evidence_tier(F.col("stars"))["tier"].alias("evidence_tier"), "ordinal")
    return first_by(joined, ["uniprot_id", "position", "wt_aa", "mut_aa"], [F.col("ordinal")]).select(*RECORD, "ordinal")


SUBMISSION = ["VariationID", "ClinicalSignificance", "DateLastEvaluated", "Description", "ReportedPhenotypeInfo", "ReviewStatus", "CollectionMethod", "Submitter", "SCV", "SubmittedGeneSymbol"]


def submissions(spark: SparkSession, path: str) -> DataFrame:
    """One row for each submission, with its label, phenotypes, tier, restriction and the publications it names."""
    from evidara.functions import text as T

    rows = table(spark, path, SUBMISSION)
    info, phenotypes = C.normalized_classification(F.col("ClinicalSignificance")), C.reported_phenotypes(F.col("ReportedPhenotypeInfo"))
    return rows.filter(F.col("VariationID").try_cast("bigint").isNotNull() & F.col("SCV").isNotNull()).select(
        F.col("SCV").alias("document_id"), F.col("VariationID").cast("bigint").alias("variation_id"), F.concat(F.lit("VariationID:"), "VariationID").alias("variant_id"), F.col("SubmittedGeneSymbol").alias("gene"),
        F.col("Submitter").alias("submitter"), F.col("ReviewStatus").alias("review_status"), F.col("ClinicalSignificance").alias("classification_raw"), info["label5"].alias("label5"), info["soft"].alias("label_soft"),
        C.iso_date(F.col("DateLastEvaluated")).alias("date"), F.coalesce("Description", F.lit("")).alias("text"), C.tier(F.lit("clinvar"), F.col("ReviewStatus"), F.col("CollectionMethod"), F.col("Description")).alias("tier"),
        C.restricted(F.col("Submitter")).alias("restricted"), T.publication_ids(F.col("Description")).alias("text_pmids"), phenotypes["ids"].alias("disease_ids"), phenotypes["names"].alias("disease_names"), "ordinal",
    )


def citations(spark: SparkSession, path: str) -> DataFrame:
    rows = table(spark, path, ["AlleleID", "VariationID", "citation_source", "citation_id"])
    made = rows.select(F.col("VariationID").try_cast("bigint").alias("variation_id"), F.col("AlleleID").try_cast("bigint").alias("allele_id"), "citation_source", "citation_id")
    return made.filter("variation_id is not null and citation_id is not null").distinct()


def curated_labels(spark: SparkSession, path: str, columns: Mapping[str, str], sep: str = "\t") -> DataFrame:
    """A curation export under other header names: ``columns`` gives the header of each field."""
    from evidara.functions import text as T

    rows = table(spark, path, list(columns.values()), sep, comment=None).withColumnsRenamed({v: k for k, v in columns.items()})
    return rows.withColumns({c: T.codes_list(F.col(c)) for c in ("codes_met", "codes_not_met") if c in columns})


# Scores

def pathogenicity_scores(spark: SparkSession, path: str, accessions: DataFrame, score: str = "feature_alphamissense_score") -> DataFrame:
    """accession, change, score and class of the wanted accessions (uniprot_id, gene); the lines of others are dropped before
    they are cut into columns where the list is small enough to be broadcast."""
    rows = lines(spark, path, "#").filter(~F.col("value").startswith("uniprot_id"))
    cells = F.split("value", "\t")
    cut = rows.filter(F.size(cells) == 4).select(F.get(cells, F.lit(0)).alias("uniprot_id"), R.one_letter_change(F.get(cells, F.lit(1))).alias("c"), F.get(cells, F.lit(2)).try_cast("double").alias(score), F.get(cells, F.lit(3)).alias("am_class"), "ordinal")
    return cut.filter("c is not null").join(accessions.select("uniprot_id", "gene"), "uniprot_id").select("uniprot_id", "c.*", "gene", score, "am_class", "ordinal")


def functional(rows: DataFrame, assay: Column, raw: Column, higher_is_damaging: bool, functional_class: Column | None = None) -> DataFrame:
    """Rows (uniprot_id, position, wt_aa, mut_aa, gene) in the functional schema: damage grows with harm."""
    damage = raw if higher_is_damaging else -raw
    return rows.select("uniprot_id", "position", "wt_aa", "mut_aa", "gene", assay.alias("assay"), raw.alias("raw_score"), damage.alias("damage_score"), (functional_class if functional_class is not None else F.lit(None)).cast("double").alias("functional_class"))


def odds_table(spark: SparkSession, path: str, exclude_splicing: bool = True) -> DataFrame:
    """gene, change, odds, its logarithm and strength, mechanism; odds that are no positive number are left out."""
    rows = csv(spark, path, ["gene", "position", "wt_aa", "mut_aa", "cimra_oddspath"], ["mechanism"])
    odds = F.col("cimra_oddspath").try_cast("double")
    made = rows.select("gene", F.col("position").try_cast("bigint").alias("position"), F.upper("wt_aa").alias("wt_aa"), F.upper("mut_aa").alias("mut_aa"), odds.alias("oddspath"), F.log10(odds).alias("log10_oddspath"), C.odds_strength(odds).alias("strength"), F.coalesce("mechanism", F.lit("")).alias("mechanism"), "ordinal")
    made = made.filter("position is not null and oddspath > 0 and not isnan(oddspath)")
    if exclude_splicing:
        made = made.filter(~F.lower("mechanism").contains("splic"))
    return first_by(made, ["gene", "position", "wt_aa", "mut_aa"], [F.col("ordinal")])


def score_set(spark: SparkSession, path: str, gene: str, uniprot_id: str, urn: str, higher_is_damaging: bool, score: str = "score") -> DataFrame:
    """A score set (hgvs_pro, score) in the functional schema, the first row of each change."""
    rows = csv(spark, path, ["hgvs_pro", score])
    made = rows.select(F.lit(uniprot_id).alias("uniprot_id"), R.three_letter_change(F.col("hgvs_pro"), anchored=True).alias("c"), F.lit(gene).alias("gene"), F.col(score).try_cast("double").alias("raw"), "ordinal").filter("c is not null and raw is not null")
    made = first_by(made.select("uniprot_id", "c.*", "gene", "raw", "ordinal"), ["uniprot_id", "position", "wt_aa", "mut_aa"], [F.col("ordinal")])
    return functional(made, F.lit(urn), F.col("raw"), higher_is_damaging)


def expert_labels(spark: SparkSession, path: str, source: str) -> DataFrame:
    """gene, change and label, by a protein name or by explicit columns."""
    rows = csv(spark, path, ["gene", "label"], ["hgvs_p", "position", "wt_aa", "mut_aa"])
    named = R.normalized_change(F.col("hgvs_p"))
    pick = lambda c, kind: F.coalesce(named[c], F.col(c).try_cast(kind)).alias(c)
    made = rows.select("gene", pick("position", "bigint"), pick("wt_aa", "string"), pick("mut_aa", "string"), F.col("label").try_cast("double").alias("label"), F.lit(source).alias("label_source"), "ordinal")
    return made.dropna(subset=["position", "wt_aa", "mut_aa", "label"])


def confirmations(spark: SparkSession, path: str) -> DataFrame:
    rows = csv(spark, path, ["gene", "position", "wt_aa", "mut_aa", "method"])
    return rows.withColumn("position", F.col("position").try_cast("bigint")).drop("ordinal").distinct()


def cluster_members(spark: SparkSession, path: str) -> DataFrame:
    rows = lines(spark, path).select(F.split("value", "\t").alias("c")).filter(F.size("c") == 2)
    return rows.select(F.get("c", F.lit(1)).alias("member"), F.get("c", F.lit(0)).alias("cluster")).distinct()


def predictions(spark: SparkSession, glob: str) -> DataFrame:
    """All prediction files under a glob, each row with the arm, model and seed that its cell names."""
    from evidara.functions.text import cell_parts

    schema = "cell string, gene string, variant_key string, label int, score double, threshold double, fold string"
    return spark.read.option("header", True).schema(schema).csv(glob).select("*", cell_parts(F.col("cell")).alias("p")).select("*", "p.*").drop("p")


def side_tables(spark: SparkSession, glob: str) -> DataFrame:
    return spark.read.option("header", True).csv(glob).withColumn("source_file", F.col("_metadata.file_name"))


def run_summaries(spark: SparkSession, root: str, schema: str, pattern: str = "summary_*.json") -> DataFrame:
    """Summaries of runs anywhere under a folder."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("multiLine", True).json(root).withColumn("source_file", F.col("_metadata.file_name"))


def jsonl(spark: SparkSession, path: str, schema: str, comment: str = "//") -> DataFrame:
    """JSON lines with comment lines; lines that do not fit the schema are null throughout and left out."""
    rows = spark.read.text(path).filter((F.trim("value") != "") & ~F.trim("value").startswith(comment))
    return rows.select(F.from_json("value", schema).alias("r")).filter("r is not null").select("r.*")


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """id and sequence of each entry."""
    entries = spark.read.option("lineSep", ">").text(path).filter(F.trim("value") != "")
    first = F.substring_index("value", "\n", 1)
    return entries.select(F.element_at(F.split(F.trim(first), r"\s+"), 1).alias("id"), F.upper(F.regexp_replace(F.expr("substring(value, instr(value, '\n') + 1)"), r"\s+", "")).alias("sequence"))
