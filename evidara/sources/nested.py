"""Nested JSON, fixed-width, XML and ontology sources as declared schemas and explodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidara.functions import clinical as C
from evidara.functions import residues as R
from evidara.functions.text import clean_markup, normalized
from evidara.operators.merge import first_by

FREQUENCIES = "struct<ac:bigint,an:bigint>"
POPULATION = f"gene struct<symbol:string,gnomad_constraint:struct<pLI:double,oe_mis:double,oe_mis_upper:double,mis_z:double>,variants:array<struct<variant_id:string,hgvsp:string,hgvsc:string,consequence:string,exome:{FREQUENCIES},genome:{FREQUENCIES}>>>"


def population_variants(spark: SparkSession, path: str) -> DataFrame:
    """One row for each protein substitution of each cached gene: pooled counts and frequency over exomes and genomes."""
    rows = spark.read.schema(f"data struct<{POPULATION.replace('gene struct', 'gene:struct', 1)}>").option("multiLine", True).json(path)
    v = rows.select("data.gene.symbol", F.posexplode("data.gene.variants").alias("ordinal", "v"))
    ac = F.coalesce("v.exome.ac", F.lit(0)) + F.coalesce("v.genome.ac", F.lit(0))
    an = F.coalesce("v.exome.an", F.lit(0)) + F.coalesce("v.genome.an", F.lit(0))
    made = v.select(F.col("symbol").alias("gene"), R.three_letter_change(F.col("v.hgvsp")).alias("c"), ac.alias("ac"), an.alias("an"), F.when(an > 0, ac / an).alias("af"), F.col("v.variant_id").alias("source_id"), "ordinal")
    return made.filter("c is not null").select("gene", "c.*", "ac", "an", "af", "source_id", "ordinal")


def most_frequent(variants: DataFrame) -> DataFrame:
    """The allele of the largest frequency for each change, with its evidence flags."""
    best = first_by(variants, ["gene", "position", "wt_aa", "mut_aa"], [-F.coalesce("af", F.lit(-1.0)), F.col("ordinal")])
    return best.select("*", C.frequency_flags(F.col("af")).alias("f")).select("*", "f.*").drop("f")


def gene_constraint(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(f"data struct<{POPULATION.replace('gene struct', 'gene:struct', 1)}>").option("multiLine", True).json(path)
    return rows.select(F.col("data.gene.symbol").alias("gene"), "data.gene.gnomad_constraint.*")


PROTEIN = "primaryAccession string, sequence struct<value:string,length:int>, features array<struct<type:string,description:string,location:struct<start:struct<value:int>,`end`:struct<value:int>>>>"
# Feature types that are stretches, and those that are single residues.
DOMAIN_TYPES = ("Domain", "Region", "Repeat", "Zinc finger", "Motif")
SITE_TYPES = ("Active site", "Binding site", "Site", "Modified residue", "Disulfide bond", "Glycosylation", "Cross-link")


def proteins(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROTEIN).option("multiLine", True).json(path)


def sequences(entries: DataFrame, lengths: dict[str, int] | None = None) -> DataFrame:
    """Accession and sequence; a length other than the pinned one fails the query."""
    rows = entries.select(F.col("primaryAccession").alias("uniprot_id"), F.col("sequence.value").alias("sequence"))
    if not lengths:
        return rows
    pinned = F.element_at(F.create_map(*[F.lit(x) for p in lengths.items() for x in p]), F.col("uniprot_id"))
    return rows.filter(F.when(pinned.isNull() | (F.length("sequence") == pinned), True).otherwise(F.raise_error(F.concat(F.lit("another length: "), "uniprot_id")).cast("boolean")))


def domains(entries: DataFrame, types=DOMAIN_TYPES) -> DataFrame:
    f = entries.select(F.col("primaryAccession").alias("uniprot_id"), F.explode("features").alias("f")).filter(F.col("f.type").isin(*types))
    return f.select("uniprot_id", F.col("f.type").alias("feature_type"), F.col("f.description").alias("description"), F.col("f.location.start.value").alias("start"), F.col("f.location.end.value").alias("end")).dropna(subset=["start", "end"])


def sites(entries: DataFrame, types=SITE_TYPES) -> DataFrame:
    """One row for each end of a site feature."""
    d = domains(entries, types)
    return d.select("uniprot_id", "feature_type", F.explode(F.array_distinct(F.array("start", "end"))).alias("position")).distinct()


def residue_table(entries: DataFrame) -> DataFrame:
    """Every residue of every protein with domain and site flags."""
    from evidara.operators.joins import attach_intervals, attach_points

    each = entries.select(F.col("primaryAccession").alias("uniprot_id"), F.explode(F.sequence(F.lit(1), F.length("sequence.value"))).alias("position"))
    flagged = attach_intervals(each, domains(entries), "uniprot_id", "position", "feature_type", "domain")
    return attach_points(flagged, sites(entries), "uniprot_id", "position", "feature_type", "site")


FRAGMENTS = "array<struct<start:int,`end`:int>>"
ENTRIES = f"results array<struct<metadata:struct<accession:string,name:string,type:string>,proteins:array<struct<accession:string,entry_protein_locations:array<struct<fragments:{FRAGMENTS}>>>>>>"


def entry_intervals(spark: SparkSession, path: str) -> DataFrame:
    """Four nested lists (entries, proteins, locations, fragments) as intervals."""
    rows = spark.read.schema(ENTRIES).option("multiLine", True).json(path).select(F.explode("results").alias("e"))
    p = rows.select("e.metadata.*", F.explode("e.proteins").alias("p"))
    loc = p.select(F.col("accession").alias("entry"), "name", "type", F.upper("p.accession").alias("uniprot_id"), F.explode("p.entry_protein_locations").alias("l"))
    return loc.select("uniprot_id", "entry", "name", "type", F.explode("l.fragments").alias("f")).select("uniprot_id", "entry", "name", "type", "f.start", "f.end").distinct()


def atoms(spark: SparkSession, path: str, name: Column | None = None) -> DataFrame:
    """Atoms of the first model of each structure file, alternative location A or none, by fixed columns. A structure is called
    after its file, or by ``name``, an expression over ``_metadata``."""
    from evidara.sources.delimited import ordinal

    rows = spark.read.text(path, wholetext=True).select((F.col("_metadata.file_name") if name is None else name).alias("structure"), F.posexplode(F.split(F.substring_index("value", "\nENDMDL", 1), "\n")).alias("line", "value"))
    assert ordinal
    cut = lambda a, n: F.trim(F.substring("value", a, n))
    out = rows.filter(F.col("value").startswith("ATOM") & F.substring("value", 17, 1).isin(" ", "A"))
    return out.select("structure", "line", cut(13, 4).alias("atom"), R.one_letter(cut(18, 3)).alias("residue"), cut(22, 1).alias("chain"), cut(23, 4).try_cast("int").alias("position"), *[cut(a, 8).try_cast("double").alias(c) for c, a in (("x", 31), ("y", 39), ("z", 47))], cut(61, 6).try_cast("double").alias("b_factor"))


def residue_confidence(atom_rows: DataFrame) -> DataFrame:
    """Model confidence of each residue, its band and whether it counts as disordered."""
    ca = atom_rows.filter("atom = 'CA'").select("structure", "position", F.col("b_factor").alias("plddt"))
    return ca.withColumn("band", C.confidence_band(F.col("plddt"))).withColumn("disordered", (F.col("plddt") < 50).cast("int"))


# Text sources

ABSTRACT = "MedlineCitation struct<PMID:string,Article:struct<ArticleTitle:string,Language:array<string>,Abstract:struct<AbstractText:array<string>>,PublicationTypeList:struct<PublicationType:array<string>>,Journal:struct<JournalIssue:struct<PubDate:struct<Year:string,MedlineDate:string>>>>>"


def abstracts(spark: SparkSession, path: str) -> DataFrame:
    """Articles with their reason for being left out (retracted, language, no_abstract), null for those to be used."""
    rows = spark.read.format("xml").option("rowTag", "PubmedArticle").option("valueTag", "_text").schema(ABSTRACT).load(path)
    a = "MedlineCitation.Article"
    text = F.trim(F.array_join(F.transform(F.col(f"{a}.Abstract.AbstractText"), lambda x: clean_markup(x)), " "))
    retracted = F.exists(F.coalesce(F.col(f"{a}.PublicationTypeList.PublicationType"), F.array().cast("array<string>")), lambda t: t.contains("Retract"))
    english = F.array_contains(F.coalesce(F.col(f"{a}.Language"), F.array(F.lit("eng"))), "eng")
    date = f"{a}.Journal.JournalIssue.PubDate"
    year = F.regexp_extract(F.coalesce(F.col(f"{date}.Year"), F.col(f"{date}.MedlineDate")), r"(\d{4})", 1).try_cast("int")
    made = rows.select(F.col("MedlineCitation.PMID").try_cast("bigint").alias("pmid"), year.alias("year"), clean_markup(F.col(f"{a}.ArticleTitle")).alias("title"), F.coalesce(text, F.lit("")).alias("abstract"), retracted.alias("r"), english.alias("e"), F.col("_metadata.file_name").alias("file"))
    reason = F.when(F.col("r"), "retracted").when(~F.col("e"), "language").when(F.col("abstract") == "", "no_abstract")
    return made.withColumn("reason", reason).drop("r", "e")


def health_topics(spark: SparkSession, path: str) -> DataFrame:
    """Genetics summaries: one document for each."""
    rows = spark.read.format("xml").option("rowTag", "health-condition-summary").schema("name string, `text-list` struct<text:array<struct<`text-role`:string,html:string>>>, reviewed string").load(path)
    text = F.array_join(F.transform(F.col("`text-list`.text"), lambda t: clean_markup(t["html"])), "\n")
    return rows.select(F.lit("medlineplus").alias("source_id"), normalized(F.col("name")).alias("title"), text.alias("text"), "reviewed").filter("text != ''")


def rare_disorders(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.format("xml").option("rowTag", "Disorder").schema("OrphaCode string, Name string, SummaryInformationList struct<SummaryInformation:array<struct<TextSectionList:struct<TextSection:array<struct<Contents:string>>>>>>").load(path)
    pieces = F.flatten(F.transform(F.col("SummaryInformationList.SummaryInformation"), lambda s: F.transform(s["TextSectionList"]["TextSection"], lambda t: clean_markup(t["Contents"]))))
    return rows.select(F.lit("orphanet").alias("source_id"), F.concat(F.lit("ORPHA:"), "OrphaCode").alias("document_id"), F.col("Name").alias("title"), F.array_join(pieces, "\n").alias("text")).filter("text != ''")


def ontology_terms(spark: SparkSession, path: str) -> DataFrame:
    """Terms of an OBO file with a definition that are not obsolete."""
    stanzas = spark.read.option("lineSep", "\n[").text(path).filter(F.col("value").startswith("Term]"))
    field = lambda p: F.regexp_extract("value", p, 1)
    made = stanzas.select(field(r"(?m)^id: (\S+)").alias("document_id"), field(r"(?m)^name: (.+)$").alias("title"), field(r'(?m)^def: "((?:[^"\\]|\\.)*)"').alias("text"), F.regexp_extract_all("value", F.lit(r'(?m)^synonym: "([^"]+)"'), F.lit(1)).alias("synonyms"), F.col("value").rlike(r"(?m)^is_obsolete: true").alias("obsolete"))
    return made.filter("not obsolete and text != '' and document_id != ''").drop("obsolete").withColumn("source_id", F.lit("mondo"))


def protein_notes(spark: SparkSession, path: str) -> DataFrame:
    """Free-text columns of a protein export, evidence tags gone."""
    rows = spark.read.option("header", True).option("sep", "\t").csv(path)
    notes = [c for c in rows.columns if c not in ("Entry", "Gene Names", "Organism")]
    text = F.array_join(F.array_compact(F.array(*[F.regexp_replace(F.col(f"`{c}`"), r"\s*\{ECO:[^}]*\}\.?", "") for c in notes])), "\n")
    return rows.select(F.lit("uniprot").alias("source_id"), F.col("Entry").alias("document_id"), F.col("`Gene Names`").alias("genes"), text.alias("text")).filter("text != ''")


def documents(*parts: DataFrame) -> DataFrame:
    """Union of text sources by name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def first_abstracts(rows: DataFrame) -> DataFrame:
    """Of each publication the article in the last file (later files correct earlier ones)."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy("pmid").orderBy(F.desc("file"), F.desc("year")))).filter("__r = 1").drop("__r")
