"""Merging sources: precedence, coalescing, conflicts, pivots, the assembled and the canonical table.

Everything that picks one of several rows orders them by a stated precedence and an ordinal of ingestion, never by the order
in which rows happen to arrive.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidara.operators.validate import valid_records

KEY = ["uniprot_id", "position", "wt_aa", "mut_aa"]


def first_by(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key: the first in ``order``. An aggregate, so partial minima are taken before the shuffle and a hot key
    is no task of its own."""
    others = [c for c in rows.columns if c not in keys]
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), rank).alias("__row"))
    return best.select(*keys, "__row.*").select(*rows.columns)


def coalesce_by(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], order: Column) -> DataFrame:
    """One row for each key: of every column the first value in order that is not null."""
    return rows.groupBy(*keys).agg(*[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns])


def conflicts(rows: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Keys whose rows disagree, with the distinct labels."""
    seen = rows.filter(F.col(label).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_set(label)).alias("labels"), F.count("*").alias("n_rows"))
    return seen.filter(F.size("labels") > 1)


def resolve_binary(rows: DataFrame, keys: Sequence[str], label: str, order: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """Rows without disagreement, one for each key, and the conflicts apart."""
    apart = conflicts(rows, keys, label)
    return first_by(rows.join(apart.select(*keys), list(keys), "left_anti"), keys, order), apart


def merge_labels(rows: DataFrame, keys: Sequence[str], precedence: Mapping[str, int], sources: Sequence[str], features: Sequence[str] = (), ordinal: str = "ordinal") -> DataFrame:
    """Long rows (keys, label, label_source, features, ordinal) as one row for each key: label and source of the highest
    precedence, each feature's first value that is not null, a column label__<source> for each source, and ``quarantined``:
    sources that disagree take both label and source away, and leave the label__ columns to see why."""
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in precedence.items() for x in p]), F.col("label_source")), F.lit(1 << 30))
    order = F.struct(rank.alias("rank"), F.col(ordinal).alias("ordinal"))
    named = [F.min_by(F.col("label"), F.when((F.col("label_source") == s) & F.col("label").isNotNull(), order)).alias(f"label__{s}") for s in sources]
    chosen = F.when(F.col("label").isNotNull(), order)
    merged = rows.groupBy(*keys).agg(
        F.min_by(F.struct("label", "label_source"), chosen).alias("__best"),
        (F.count_distinct("label") > 1).alias("quarantined"),
        *[F.min_by(F.col(f), F.when(F.col(f).isNotNull(), order)).alias(f) for f in features],
        *named,
    )
    free = ~F.col("quarantined")
    return merged.select(
        *keys, F.when(free, F.col("__best.label")).alias("label"), F.when(free, F.col("__best.label_source")).alias("label_source"), "quarantined", *features, *[f"label__{s}" for s in sources]
    )


def row_label(columns: Sequence[str]) -> Column:
    """First of several label columns that is not null; null where they disagree."""
    seen = F.array_compact(F.array(*[F.col(c) for c in columns]))
    return F.when(F.size(F.array_distinct(seen)) == 1, F.get(seen, F.lit(0)))


def unobserved_defaults(rows: DataFrame, observed: str, defaults: Mapping[str, float]) -> DataFrame:
    """Evidence values for rows that a source does not have, with a flag for those it has."""
    rows = rows.withColumn(observed, F.coalesce(*[F.col(c).isNotNull() for c in list(defaults)[:1]]).cast("double"))
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def assemble(frames: Mapping[str, DataFrame], precedence: Mapping[str, int], features: Sequence[str], sequences: DataFrame | None = None, defaults: Mapping[str, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """The assembled table over validated sources, and a row for each source with what its validation kept and dropped."""
    parts, reports = [], []
    for name, frame in frames.items():
        checked = valid_records(frame, sequences).withColumn("__source", F.lit(name))
        reports.append(checked.groupBy("__source", "reason").agg(F.count("*").alias("n_rows")))
        parts.append(checked.filter("reason is null").drop("reason", "__source"))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    report = reports[0]
    for r in reports[1:]:
        report = report.unionByName(r)
    merged = merge_labels(rows, KEY, precedence, list(precedence), features)
    return (unobserved_defaults(merged, "observed", defaults) if defaults else merged), report.withColumnRenamed("__source", "source")


def protein_labels(records: DataFrame, min_stars: int = 2, expert_stars: int = 3) -> DataFrame:
    """All records of a protein change as one row: label of the eligible ones if they agree, discordance, expert label, the
    record of most stars (first of equals by ordinal), and sorted distinct lists."""
    eligible = (F.col("stars") >= min_stars) & F.col("label").isNotNull()
    expert = (F.col("stars") >= expert_stars) & F.col("label").isNotNull()
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), ";")
    labels = F.collect_set(F.when(eligible, F.col("label")))
    experts = F.collect_set(F.when(expert, F.col("label")))
    return records.groupBy("gene", "position", "wt_aa", "mut_aa").agg(
        F.when(F.size(labels) == 1, F.element_at(labels, 1)).alias("label"),
        (F.size(labels) > 1).alias("discordant"),
        F.when(F.size(experts) == 1, F.element_at(experts, 1)).alias("expert_label"),
        F.max_by("review_status", F.struct("stars", -F.col("ordinal"))).alias("review_status"),
        F.max("stars").alias("stars"), joined("variation_id").alias("variation_ids"), joined("significance").alias("significances"), F.count("*").alias("n_records"),
    )


def protein_frequencies(records: DataFrame) -> DataFrame:
    """Alleles of one protein change summed: frequency and count are sums, the number of chromosomes the largest."""
    return records.groupBy("gene", "position", "wt_aa", "mut_aa").agg(F.sum("af").alias("af"), F.sum("ac").alias("ac"), F.max("an").alias("an"), F.count("*").alias("n_alleles"))


def one_per_key(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Duplicates collapsed; a value that they disagree on is null."""
    return rows.groupBy(*keys).agg(F.when(F.count_distinct(value) == 1, F.max(value)).alias(value))


def average_duplicates(rows: DataFrame, keys: Sequence[str], scores: Sequence[str], classes: Sequence[str] = (), firsts: Sequence[str] = (), ordinal: str = "ordinal") -> DataFrame:
    """Duplicates averaged; a class that is no longer 0 or 1 is null; other columns are the first's."""
    mean = [F.avg(c).alias(c) for c in scores]
    voted = [F.when(F.avg(c).isin(0.0, 1.0), F.avg(c)).alias(c) for c in classes]
    return rows.groupBy(*keys).agg(*mean, *voted, *[F.min_by(c, ordinal).alias(c) for c in firsts])


def gate_region(rows: DataFrame, group: str, value: str, first: int, last: int, confirmed: DataFrame | None = None, label: str = "label", exclude: bool = False) -> DataFrame:
    """Labels inside a range of positions of one group become null unless a confirmation (group, position, wt_aa, mut_aa) is
    there; without confirmations all of them do. ``exclude`` drops the group instead."""
    if exclude:
        return rows.filter(F.coalesce(F.col(group) != value, F.lit(True)))
    inside = (F.col(group) == value) & F.col("position").between(first, last)
    if confirmed is not None:
        keys = [group, "position", "wt_aa", "mut_aa"]
        rows = rows.join(confirmed.select(*keys).distinct().withColumn("__confirmed", F.lit(True)), keys, "left")
        inside = inside & F.col("__confirmed").isNull()
    gated = F.coalesce(inside, F.lit(False))
    out = rows.withColumn("gated", gated & F.col(label).isNotNull()).withColumn(label, F.when(~gated, F.col(label)))
    return out.drop("__confirmed")


def canonical(table: DataFrame, records: DataFrame, frequencies: DataFrame, functional: DataFrame | None = None, clusters: DataFrame | None = None) -> DataFrame:
    """The assembled table with per-change summaries, quality flags as an array, and the label withheld where a flag says so."""
    keys = ["gene", "position", "wt_aa", "mut_aa"]
    out = table.join(protein_labels(records).withColumnsRenamed({"label": "record_label"}), keys, "left").join(protein_frequencies(frequencies), keys, "left")
    if functional is not None:
        out = out.join(functional, keys, "left")
    if clusters is not None:
        out = out.join(clusters, ["uniprot_id", "position"], "left")
    differs = F.col("label").isNotNull() & F.col("record_label").isNotNull() & (F.col("label") != F.col("record_label"))
    common = F.coalesce(F.col("af") >= 0.05, F.lit(False)) & (F.col("label") == 1)
    flags = F.array_compact(F.array(F.when(F.col("discordant"), F.lit("discordant")), F.when(differs, F.lit("label_differs")), F.when(common, F.lit("common_pathogenic"))))
    out = out.withColumn("qc_flags", flags)
    withheld = F.size("qc_flags") > 0
    return out.withColumns({"withheld": withheld, "label": F.when(~withheld, F.col("label")), "label_source": F.when(~withheld, F.col("label_source"))})


def orphans(rows: DataFrame, table: DataFrame, sequences: DataFrame) -> DataFrame:
    """Rows whose key the table has not, with the reason."""
    lone = rows.join(table.select(*KEY).distinct(), KEY, "left_anti").join(sequences, "uniprot_id", "left")
    at = F.col("position")
    reason = (
        F.when(F.col("sequence").isNull(), "unknown_accession")
        .when((at < 1) | (at > F.length("sequence")), "outside_sequence")
        .when(F.substring("sequence", at.cast("int"), F.lit(1)) != F.col("wt_aa"), "residue_differs")
        .otherwise("not_in_table")
    )
    return lone.withColumn("reason", reason).drop("sequence")


def master(base: DataFrame, sides: Mapping[str, DataFrame], keys: Sequence[str] = KEY) -> DataFrame:
    """The universe of keys left-joined to side tables of one row for each key, with the list of sources that had it."""
    out = base
    for name, side in sides.items():
        extra = [c for c in side.columns if c not in keys]
        out = out.join(side.select(*keys, *[F.col(c).alias(c if c not in base.columns else f"{name}_{c}") for c in extra], F.lit(name).alias(f"__has_{name}")), list(keys), "left")
    seen = F.array_compact(F.array(*[F.col(f"__has_{name}") for name in sides]))
    return out.withColumn("sources", F.array_join(seen, "|")).drop(*[f"__has_{name}" for name in sides])


def label_with_weight(candidates: Sequence[tuple[str, str, float]]) -> Column:
    """Label, source and weight of the first column that is not null, of (column, source, weight) in order of precedence."""
    out = F.lit(None).cast("struct<label:double,label_source:string,weight:double>")
    for column, source, weight in reversed(candidates):
        out = F.when(F.col(column).isNotNull(), F.struct(F.col(column).cast("double").alias("label"), F.lit(source).alias("label_source"), F.lit(weight).alias("weight"))).otherwise(out)
    return out


def pivot_first(rows: DataFrame, keys: Sequence[str], column: str, values: Sequence, value: str, order: str) -> DataFrame:
    """One column for each of ``values``: the first value in order."""
    return rows.groupBy(*keys).agg(*[F.min_by(value, F.when((F.col(column) == v) & F.col(value).isNotNull(), F.col(order))).alias(str(v)) for v in values])


def exon_table(exons: DataFrame) -> DataFrame:
    """Exons (transcript, exon, length) with the first and last coding position and codon each covers."""
    upto = F.sum("length").over(Window.partitionBy("transcript").orderBy("exon"))
    return exons.withColumn("cds_end", upto).withColumn("cds_start", F.col("cds_end") - F.col("length") + 1).withColumns({"codon_start": F.floor((F.col("cds_start") - 1) / 3) + 1, "codon_end": F.floor((F.col("cds_end") - 1) / 3) + 1})
