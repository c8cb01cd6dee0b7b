"""Clinical labels, review stars, evidence tiers, frequency flags, dates and conditions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Review status and its stars. Conflicting submissions have 0 or 1, by policy.
REVIEW_STARS = {
    "practice guideline": 4,
    "reviewed by expert panel": 3,
    "criteria provided, multiple submitters, no conflicts": 2,
    "criteria provided, single submitter": 1,
    "criteria provided, conflicting interpretations": 0,
    "criteria provided, conflicting classifications": 0,
    "no assertion criteria provided": 0,
    "no assertion provided": 0,
    "no assertion for the individual variant": 0,
}
# Terms of the five classes and of the sub-tiers of uncertain significance.
CLASS_TERMS = {
    "pathogenic": "pathogenic",
    "likely pathogenic": "likely_pathogenic",
    "uncertain significance": "vus",
    "variant of uncertain significance": "vus",
    "vus-high": "vus",
    "vus-mid": "vus",
    "vus-low": "vus",
    "likely benign": "likely_benign",
    "benign": "benign",
}
CLASSES = ("pathogenic", "likely_pathogenic", "vus", "likely_benign", "benign")
MISSING_TERMS = ("", "-", "not provided", "na", "none", "no classification for the single variant", "no classifications from unflagged records", "no classification provided")
# Odds of pathogenicity from which a strength holds.
ODDS = (("very_strong", 350.0), ("strong", 18.7), ("moderate", 4.3), ("supporting", 2.08))
# Upper edges of allele-frequency bands.
AF_EDGES = (1e-5, 1e-4, 1e-3, 1e-2)
# Condition names that name no single disease.
CATCH_ALL = ("not provided", "not specified", "see cases", "none provided", "not applicable", "variant of unknown significance", "all conditions", "unspecified", "")
UMBRELLA = ("inborn genetic diseases", "hereditary cancer-predisposing syndrome", "cardiovascular phenotype", "hereditary disease", "genetic disease")
RESTRICTED = ("omim",)
EXPERT_SOURCES = ("clingen_erepo",)
LITERATURE_SOURCES = ("pubmed", "pmc", "genereviews", "medlineplus", "orphanet", "clingen_gene_validity")


def _map(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def stars(status: Column, conflicting: int = 0) -> Column:
    """Stars of a review status; ``conflicting`` sets those of conflicting submissions, unknown texts have none."""
    text = F.lower(F.trim(status))
    return F.when(text.contains("conflicting"), F.lit(conflicting)).otherwise(F.coalesce(F.element_at(_map(REVIEW_STARS), text), F.lit(0)))


def significance_label(text: Column) -> Column:
    """1 for pathogenic terms, 0 for benign ones, else null; exact terms only."""
    low = F.lower(F.trim(text))
    return F.when(low.isin("pathogenic", "likely pathogenic", "pathogenic/likely pathogenic"), 1.0).when(low.isin("benign", "likely benign", "benign/likely benign"), 0.0)


def classify_significance(text: Column, review_stars: Column, min_stars: int = 1) -> Column:
    """kind (labelled, vus) and label of an aggregate term; null for conflicting, mixed or under-reviewed ones."""
    terms = F.array_distinct(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[|/]"), lambda x: F.lower(F.trim(x))), lambda x: x != ""))
    only = lambda *words: F.size(F.array_except(terms, F.array(*[F.lit(w) for w in words]))) == 0
    made = lambda kind, label: F.struct(F.lit(kind).alias("kind"), F.lit(label).cast("double").alias("label"))
    some = (F.size(terms) > 0) & ~F.exists(terms, lambda x: x.contains("conflicting"))
    return (
        F.when(some & only("pathogenic", "likely pathogenic") & (review_stars >= min_stars), made("labelled", 1.0))
        .when(some & only("benign", "likely benign") & (review_stars >= min_stars), made("labelled", 0.0))
        .when(some & only("uncertain significance"), made("vus", None))
    )


def normalized_classification(text: Column) -> Column:
    """A submitted classification as category, label5, soft (shares of the five classes) and modifiers."""
    raw = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    pieces = F.transform(F.split(raw, ";"), lambda x: F.trim(x))
    primary = F.element_at(pieces, 1)
    low = ", low penetrance"
    terms = F.transform(F.split(primary, "/"), lambda x: F.trim(x))
    bare = F.transform(terms, lambda x: F.trim(F.regexp_replace(x, f"{low}$", "")))
    known = F.map_keys(_map(CLASS_TERMS))
    unknown = F.array_except(bare, known)
    classes = F.array_distinct(F.transform(F.array_intersect(bare, known), lambda x: F.element_at(_map(CLASS_TERMS), x)))
    extra = F.concat(
        F.filter(F.slice(pieces, 2, 100), lambda x: x != ""),
        F.when(F.exists(terms, lambda x: x.endswith(low)), F.array(F.lit("low_penetrance"))).otherwise(F.array().cast("array<string>")),
        F.transform(F.filter(bare, lambda x: x.startswith("vus-")), lambda x: F.replace(x, F.lit("-"), F.lit("_"))),
    )
    pair = F.array_sort(classes)
    is_pair = pair.eqNullSafe(F.array(F.lit("likely_pathogenic"), F.lit("pathogenic"))) | pair.eqNullSafe(F.array(F.lit("benign"), F.lit("likely_benign")))
    category = (
        F.when(raw.isin(*MISSING_TERMS) | primary.isin(*MISSING_TERMS), "missing")
        .when(primary.contains("conflicting"), "conflicting")
        .when((F.size(unknown) > 0) | (F.size(classes) == 0), "out_of_scope")
        .when(F.size(classes) == 1, "five_class")
        .when(is_pair, "pair")
        .otherwise("conflicting")
    )
    soft = F.transform(F.array(*[F.lit(c) for c in CLASSES]), lambda c: F.when(F.array_contains(classes, c), 1.0 / F.size(classes)).otherwise(0.0))
    modifiers = F.array_distinct(F.when(category == "out_of_scope", F.concat(extra, unknown)).when(category == "missing", F.array().cast("array<string>")).otherwise(extra))
    return F.struct(category.alias("category"), F.when(category == "five_class", F.element_at(classes, 1)).alias("label5"), F.when(category.isin("five_class", "pair"), soft).alias("soft"), modifiers.alias("modifiers"))


def binary_label(info: Column) -> Column:
    """1 or 0 of a normalised classification whose classes are all pathogenic or all benign."""
    soft = info["soft"]
    return F.when(soft[0] + soft[1] == 1, 1.0).when(soft[3] + soft[4] == 1, 0.0)


def tier(source: Column, status: Column, method: Column, text: Column, least: int = 40) -> Column:
    """Context tier from 1 (expert) to 5 (little context)."""
    source, status, method = (F.lower(F.coalesce(c, F.lit(""))) for c in (source, status, method))
    told = F.length(F.trim(F.coalesce(text, F.lit("")))) >= least
    return (
        F.when(source.isin(*EXPERT_SOURCES), 1)
        .when(source.isin(*LITERATURE_SOURCES), 4)
        .when(status.contains("expert panel") | status.contains("practice guideline"), 1)
        .when(~told | status.contains("no assertion criteria") | status.contains("no classification"), 5)
        .when(method.rlike("literature only|research|curation"), 3)
        .when(status.contains("criteria provided"), 2)
        .otherwise(5)
    )


def restricted(submitter: Column) -> Column:
    return F.coalesce(F.lower(F.trim(submitter)).isin(*RESTRICTED), F.lit(False))


def evidence_tier(review_stars: Column) -> Column:
    """Name and weight of the evidence behind a label."""
    name = F.when(review_stars >= 3, "expert").when(review_stars == 2, "multiple").when(review_stars == 1, "single").otherwise("none")
    return F.struct(name.alias("tier"), F.element_at(_map({"expert": 1.0, "multiple": 0.75, "single": 0.5, "none": 0.2}), name).alias("weight"))


def star_band(review_stars: Column) -> Column:
    return F.when(review_stars.isNull(), "unknown").when(review_stars >= 3, "3+").when(review_stars == 2, "2").when(review_stars == 1, "1").otherwise("0")


def odds_strength(odds: Column) -> Column:
    """Strength bucket of an odds-of-pathogenicity value; indeterminate between the two supporting edges or if not finite."""
    out = F.when(odds.isNull() | F.isnan(odds) | (F.abs(odds) == float("inf")), "indeterminate")
    for name, edge in ODDS:
        out = out.when(odds >= edge, f"PS3_{name}")
    for name, edge in ODDS:
        out = out.when(odds <= 1.0 / edge, f"BS3_{name}")
    return out.otherwise("indeterminate")


def frequency_flags(af: Column, ba1: float = 0.05, bs1: float = 1e-3, pm2: float = 1e-5, floor: float = -7.0) -> Column:
    """Allele-frequency evidence: an absent variant counts as rarer than any other."""
    seen = af.isNotNull() & ~F.isnan(af)
    on = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return F.struct(
        on(seen & (af >= ba1)).alias("ba1"), on(seen & (af >= bs1) & (af < ba1)).alias("bs1"), on(~seen | (af <= pm2)).alias("pm2"),
        F.when(seen & (af > 0), F.greatest(F.log10(af), F.lit(floor))).otherwise(floor).alias("log10_af"), seen.cast("int").alias("observed"),
    )


def frequency_band(af: Column, edges=AF_EDGES) -> Column:
    out = F.when(af.isNull() | F.isnan(af) | (af <= 0), "absent")
    for edge in edges:
        out = out.when(af < edge, f"<{edge:g}")
    return out.otherwise(f">={edges[-1]:g}")


def confidence_band(plddt: Column) -> Column:
    """Band of a per-residue model confidence."""
    return F.when(plddt >= 90, "very_high").when(plddt >= 70, "confident").when(plddt >= 50, "low").when(plddt.isNotNull(), "very_low")


def missingness(columns: list[Column]) -> Column:
    """complete, partial (under half missing) or sparse."""
    missing = sum((c.isNull().cast("int") for c in columns), F.lit(0))
    return F.when(missing == 0, "complete").when(missing * 2 < len(columns), "partial").otherwise("sparse")


# Date formats, tried in this order.
DATE_FORMATS = ("MMM d, yyyy", "MMMM d, yyyy", "yyyy-MM-dd", "yyyyMMdd", "d MMM yyyy", "yyyy/MM/dd", "MMM yyyy", "yyyy")


def iso_date(text: Column) -> Column:
    """Dates in any of the known formats as ``yyyy-MM-dd``; months and years stand for their first day."""
    text = F.trim(text)
    return F.date_format(F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS]), "yyyy-MM-dd")


def condition_ids(text: Column) -> Column:
    """One id for each condition: MedGen, else MONDO, else the first."""

    def chosen(group: Column) -> Column:
        ids = F.filter(F.transform(F.split(group, ","), lambda x: F.trim(x)), lambda x: (x != "") & (x != "-"))
        first = lambda prefix: F.get(F.filter(ids, lambda x: x.startswith(prefix)), F.lit(0))
        return F.coalesce(first("MedGen:"), F.regexp_replace(first("MONDO:"), "^MONDO:MONDO:", "MONDO:"), F.get(ids, F.lit(0)))

    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\|"), chosen), lambda x: x.isNotNull()))


def conditions(ids: Column, names: Column) -> Column:
    """Aligned id and name of each named condition."""
    both = F.arrays_zip(F.split(F.coalesce(ids, F.lit("")), r"\|").alias("ids"), F.split(F.coalesce(names, F.lit("")), r"\|").alias("names"))
    made = F.transform(both, lambda x: F.struct(F.get(condition_ids(x["ids"]), F.lit(0)).alias("id"), F.trim(x["names"]).alias("name")))
    return F.filter(made, lambda x: x["name"].isNotNull() & (x["name"] != "") & (x["name"] != "-"))


def specific_condition(name: Column) -> Column:
    return ~F.lower(F.trim(F.coalesce(name, F.lit("")))).isin(*CATCH_ALL, *UMBRELLA)


def reported_phenotypes(text: Column) -> Column:
    """``C0009405:Lynch syndrome;other`` as ids and names, distinct, in order."""
    pieces = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[;|]"), lambda x: F.trim(x)), lambda x: (x != "") & (x != "-"))
    pattern = r"^((?:C|CN)\d+)\s*:\s*(.*)$"
    ids = F.transform(F.filter(pieces, lambda x: x.rlike(pattern)), lambda x: F.concat(F.lit("MedGen:"), F.regexp_extract(x, pattern, 1)))
    names = F.transform(pieces, lambda x: F.when(x.rlike(pattern), F.trim(F.regexp_extract(x, pattern, 2))).otherwise(x))
    return F.struct(F.array_distinct(ids).alias("ids"), F.array_distinct(F.filter(names, lambda x: x != "")).alias("names"))


def licence_code(text: Column) -> Column:
    """``CC BY-NC 4.0`` and the like in one spelling: lower case, hyphens, no version."""
    low = F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"[\s_]+", "-")
    bare = F.regexp_replace(F.regexp_replace(low, r"-?v?\d+(?:\.\d+)?$", ""), r"^cc-?zero$|^cc-?0$|^cc0.*$", "cc0")
    return F.when(low.rlike(r"^cc-?0|^cc-?zero"), "cc0").otherwise(bare)
