"""Leakage audits: each check is one aggregate over the split tables; the findings are rows of one table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.functions import text as T
from evidara.operators.metrics import roc_auc, symmetric, target_rates
from evidara.operators.splits import crossing


def finding(check: str, counts: DataFrame, severity: Column, detail: str = "n_rows") -> DataFrame:
    """One row (check, severity, n) from a table of one row."""
    return counts.select(F.lit(check).alias("check"), severity.alias("severity"), F.col(detail).cast("double").alias("n"))


def bad_if(count: Column, level: str = "critical") -> Column:
    return F.when(count > 0, level).otherwise("ok")


def groups_cross(rows: DataFrame, columns: Sequence[str], level: str = "critical") -> DataFrame:
    """A finding for each grouping column (variant, exact text, near duplicate, publication...): rows of groups that straddle."""
    out = None
    for c in columns:
        part = finding(f"crossing:{c}", crossing(rows, c), bad_if(F.col("n_rows"), level))
        out = part if out is None else out.union(part)
    return out


def keys_under_two_ids(rows: DataFrame, key: str, identifier: str) -> DataFrame:
    """One key (genomic position, protein change, sequence) under several ids."""
    twice = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(identifier).alias("n")).filter("n > 1")
    return finding(f"ids_of:{key}", twice.agg(F.count("*").alias("n_rows")), bad_if(F.col("n_rows"), "warning"))


def duplicate_ids(rows: DataFrame, identifier: str) -> DataFrame:
    twice = rows.groupBy(identifier).agg(F.count("*").alias("n")).filter("n > 1")
    return finding(f"duplicates:{identifier}", twice.agg(F.count("*").alias("n_rows")), bad_if(F.col("n_rows")))


def shared_citations(rows: DataFrame, citations: DataFrame, on: str = "variation_id", cited: str = "citation_id") -> DataFrame:
    """Publications cited for training rows and for held-out rows alike."""
    both = rows.select(on, "split").distinct().join(citations.select(on, cited).distinct(), on)
    return finding("shared_citations", crossing(both, cited), bad_if(F.col("n_groups"), "warning"), "n_groups")


def shortcut(rows: DataFrame, key: str, label: str, warn: float = 0.75) -> DataFrame:
    """How well a key's label rate in training alone predicts held-out labels."""
    train, test = rows.filter("split = 'train'"), rows.filter("split != 'train'")
    auc = roc_auc(target_rates(train, test, key, label), [], label, "rate").select(symmetric(F.col("auc")).alias("auc"))
    return finding(f"shortcut:{key}", auc, F.when(F.col("auc") >= warn, "warning").otherwise("ok"), "auc")


def overlap(check: str, left: DataFrame, right: DataFrame, on: str, level: str = "critical") -> DataFrame:
    """Keys that both tables have: evaluation documents in an index, held-out variants in pretraining text, positions of a fold
    on both of its sides."""
    both = left.select(on).filter(F.col(on).isNotNull()).distinct().join(right.select(on).distinct(), on, "left_semi")
    return finding(check, both.agg(F.count("*").alias("n_rows")), bad_if(F.col("n_rows"), level))


def not_excluded(check: str, wanted: DataFrame, excluded: DataFrame, on: str) -> DataFrame:
    """Keys that should have been excluded and were not."""
    open_ = wanted.select(on).distinct().join(excluded.select(on), on, "left_anti")
    return finding(check, open_.agg(F.count("*").alias("n_rows")), bad_if(F.col("n_rows")))


def late_training(rows: DataFrame, date: str, cutoff: str) -> DataFrame:
    bad = (F.col("split") == "train") & (F.col(date).isNull() | (F.col(date) >= cutoff))
    return finding("late_training", rows.agg(F.count_if(bad).alias("n_rows")), bad_if(F.col("n_rows")))


def outside_training(check: str, rows: DataFrame, split: DataFrame, on: str) -> DataFrame:
    """Rows (of a teacher, say) whose document is not a training document."""
    joined = rows.join(split.select(on, "split"), on, "left")
    return finding(check, joined.agg(F.count_if(~F.coalesce(F.col("split") == "train", F.lit(False))).alias("n_rows")), bad_if(F.col("n_rows")))


def residual_verdicts(rows: DataFrame, text: str = "input_text", most: float = 0.02) -> DataFrame:
    """Share of texts that still assert a class after masking."""
    share = rows.agg(F.avg((F.size(T.residual_assertions(F.col(text))) > 0).cast("double")).alias("share"))
    return finding("residual_verdicts", share, F.when(F.col("share") > most, "critical").when(F.col("share") > 0, "warning").otherwise("ok"), "share")


def named_holdouts(rows: DataFrame, pattern: str, text: str = "input_text") -> DataFrame:
    """Training texts that name a held-out identifier."""
    return finding("named_holdouts", rows.agg(F.count_if((F.col("split") == "train") & F.col(text).rlike(pattern)).alias("n_rows")), bad_if(F.col("n_rows")))


def contamination(documents: DataFrame, benchmark: DataFrame, key: str, item: str, k: int = 8) -> DataFrame:
    """(key, item, share): documents and benchmark items that share runs of ``k`` words, and the share of the item's runs.
    Runs are joined on their hash; each document meets an item once for each distinct run."""
    runs = lambda t, c: t.select(c, F.explode(T.shingles(F.col("text"), k)).alias("h"))
    sizes = benchmark.select(item, F.size(T.shingles(F.col("text"), k)).alias("n"))
    shared = runs(documents, key).join(runs(benchmark, item), "h").groupBy(key, item).agg(F.count("*").alias("shared"))
    return shared.join(sizes, item).select(key, item, "shared", (F.col("shared") / F.col("n")).alias("share"))


def feature_findings(agreement: DataFrame) -> DataFrame:
    """Findings from ``metrics.column_agreement``."""
    return agreement.select(F.concat(F.lit("feature:"), "column").alias("check"), "severity", F.col("agreement").alias("n"))


def audit(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def run_audit(rows: DataFrame, groups: Sequence[str], label: str, shortcuts: Sequence[str], more: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """The usual findings over one split table, with any others given, the worst first."""
    parts = [groups_cross(rows, groups), *[shortcut(rows, s, label) for s in shortcuts], *(more or {}).values()]
    order = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return audit(parts).orderBy(order, "check")
