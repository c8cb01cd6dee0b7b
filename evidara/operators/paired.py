"""Arms compared on the same variants: differences of AUC with intervals from resampled variants.

The AUC is a mean over positives of the share of negatives below each, and over negatives of the share of positives above. These
shares, its structural components, are counted by ranges of the score; a variant's difference of components between two arms says
how much it moves their difference of AUC. Resampling then needs only counts of variants by difference, so a gene of any size is a
few thousand numbers where it is resampled. What that leaves out shrinks with one over the number of variants; genes of up to
``EXACT`` variants are resampled variant by variant instead.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.functions.hashing import derived_seed
from evidara.operators.graph import _shared
from evidara.operators.ranking import tie_counts
from evidara.operators.skew import attach

#: Variants of a gene up to which the scores themselves are resampled, and ranges of a difference of components beyond.
EXACT, RANGES = 1000, 4096

#: Variants that a gene needs to count in a mean over genes.
SCOREABLE = 50


def _held(predictions: DataFrame) -> DataFrame:
    """(arm, gene, seed, variant_key, y, score): the least score where a variant was predicted twice; labels must agree."""
    known = predictions.filter(F.col("label").isNotNull() & F.col("score").isNotNull() & ~F.isnan(F.col("score").cast("double")))
    kept = known.groupBy("arm", "gene", "seed", "variant_key").agg(F.min("label").cast("int").alias("y"), F.max("label").cast("int").alias("__most"), F.min(F.col("score").cast("double")).alias("score"))
    agreed = F.when(F.col("y") == F.col("__most"), F.col("y")).otherwise(F.raise_error(F.concat(F.lit("two labels of "), F.col("variant_key").cast("string"))))
    return kept.withColumn("y", agreed).drop("__most")


def structural_components(held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows (arm, gene, seed, variant_key, y, score): the AUC of each (arm, gene, seed), and each variant's component, averaged over
    its seeds: (arm, gene, variant_key, y, component, seeds). Both are null where a class is missing."""
    cell = ["arm", "gene", "seed"]
    y = F.col("y")
    ties = _shared(tie_counts(held, cell, "score", {"pos": y, "neg": 1 - y}))
    sizes = ties.groupBy(cell).agg(F.sum("n_pos").alias("pos"), F.sum("n_neg").alias("neg"))
    pairs = F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("pos").cast("double") * F.col("neg"))
    below, above = F.col("le_neg") - F.col("n_neg") / 2, F.col("pos") - F.col("le_pos") + F.col("n_pos") / 2
    told = ties.join(sizes, cell)
    areas = told.groupBy(*cell, "pos", "neg").agg(F.sum(F.col("n_pos") * below).alias("u")).select(*cell, (F.col("u") / pairs).alias("auc"))
    shares = told.select(*cell, "score", F.when(pairs.isNotNull(), below / F.col("neg")).alias("below"), F.when(pairs.isNotNull(), above / F.col("pos")).alias("above"))
    counts = ties.select(*cell, "score", (F.col("n_pos") + F.col("n_neg")).alias("n"))
    rows = attach(held, shares, [*cell, "score"], counts)
    mine = F.when(y == 1, F.col("below")).otherwise(F.col("above"))
    return areas, rows.groupBy("arm", "gene", "variant_key", "y").agg(F.avg(mine).alias("component"), F.count_distinct("seed").alias("seeds"))


def weighted_auc(y: np.ndarray, s: np.ndarray, w: np.ndarray) -> np.ndarray:
    """AUC for each row of weights (resamples by variants) of one column of scores; variants without a score are left out."""
    from evidara.operators.resample import cell_auc

    there = np.flatnonzero(np.isfinite(s))
    if not len(there):
        return np.full(len(w), np.nan)
    order = there[np.argsort(s[there], kind="stable")]
    starts = np.flatnonzero(np.r_[True, np.diff(s[order]) > 0])
    pos, neg = (np.add.reduceat(w[:, order] * (y[order] == k), starts, axis=1) for k in (1, 0))
    return cell_auc(pos.astype(float), neg.astype(float))


def exact_draws(y: np.ndarray, a: np.ndarray, b: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Differences of AUC (rows x seeds, averaged over seeds) of ``n`` resamples of the variants, both arms on the same ones."""
    w = np.random.default_rng(seed).multinomial(len(y), np.full(len(y), 1 / len(y)), n)
    with np.errstate(all="ignore"):
        mean = lambda m: np.mean([weighted_auc(y, m[:, k], w) for k in range(m.shape[1])], axis=0)
        return mean(a) - mean(b)


def component_draws(y: np.ndarray, value: np.ndarray, count: np.ndarray, n: int, seed: int) -> np.ndarray:
    """How far ``n`` resamples move a difference of AUC, from counts of variants by class and difference of components."""
    rng = np.random.default_rng(seed)
    w = rng.multinomial(int(count.sum()), count / count.sum(), n)
    out = np.zeros(n)
    with np.errstate(all="ignore"):
        for k in (0, 1):
            mine = y == k
            out += w[:, mine] @ value[mine] / w[:, mine].sum(axis=1) - np.average(value[mine], weights=count[mine]) if mine.any() else np.nan
    return out


def paired_draws(predictions: DataFrame, reference: str, n: int = 1000, seed: int = 0, exact: int = EXACT) -> DataFrame:
    """predictions (arm, gene, seed, variant_key, label, score): (arm, gene, n, n_benign, seeds, auc, auc_reference, delta, draws) of every
    arm on each gene that the reference has too; ``draws`` are the differences in ``n`` resamples, without those that lack a class.
    An arm that has other variants than the reference, or other labels, is refused. Rows without label or score, and of a null
    arm, gene or variant, do not count."""
    keyed = predictions.select("arm", "gene", "seed", "variant_key", "label", "score").dropna(subset=["arm", "gene", "seed", "variant_key"])
    held = _shared(_held(keyed))
    areas, components = structural_components(held)
    components, is_ref = _shared(components), F.col("arm") == reference
    by_arm = areas.groupBy("arm", "gene").agg(F.avg("auc").alias("auc"))
    sizes = components.groupBy("arm", "gene").agg(F.count("*").alias("n"), F.sum(1 - F.col("y")).alias("n_benign"), F.max("seeds").alias("seeds"))
    base = sizes.filter(is_ref).select("gene", F.col("n").alias("n_ref"))
    ref = components.filter(is_ref).select("gene", "variant_key", F.col("y").alias("y_ref"), F.col("component").alias("base"))
    pairs = components.filter(~is_ref).join(ref, ["gene", "variant_key"])
    moved = _shared(pairs.select("arm", "gene", "y", (F.col("y") != F.col("y_ref")).alias("wrong"), (F.col("component") - F.col("base")).alias("d")))
    matched = moved.groupBy("arm", "gene").agg(F.count("*").alias("same"), F.max("wrong").alias("wrong"))
    refuse = lambda what: F.raise_error(F.concat("arm", F.lit(f" and {reference} {what} "), "gene"))
    facts = sizes.filter(~is_ref).join(base, "gene").join(matched, ["arm", "gene"], "left")
    alike = F.when(F.coalesce("same", F.lit(0)) != F.col("n"), refuse("are not scored on the same variants of")).when(F.col("n") != F.col("n_ref"), refuse("are not scored on the same variants of"))
    facts = facts.withColumn("n", alike.when(F.col("wrong"), refuse("have other labels of")).otherwise(F.col("n")))
    ref_area = by_arm.filter(is_ref).select("gene", F.col("auc").alias("auc_reference"))
    facts = facts.join(by_arm, ["arm", "gene"]).join(ref_area, "gene").withColumn("delta", F.col("auc") - F.col("auc_reference"))
    facts = _shared(facts.select("arm", "gene", "n", "n_benign", "seeds", "auc", "auc_reference", "delta"))
    few = facts.filter(F.col("n") <= exact).select("arm", "gene")

    def by_components(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "cell"])
        arm, gene = pdf.arm.iloc[0], pdf.gene.iloc[0]
        found = component_draws(pdf.y.to_numpy(), pdf.total.to_numpy() / pdf["count"].to_numpy(), pdf["count"].to_numpy(), n, derived_seed(seed, f"{arm}:{gene}"))
        return pd.DataFrame({"arm": [arm], "gene": [gene], "moves": [found]})

    def by_scores(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a, b = (d.pivot(index=["variant_key", "y"], columns="seed", values="score").sort_index() for d in (left, right))
        found = exact_draws(a.index.get_level_values("y").to_numpy(), a.to_numpy(), b.to_numpy(), n, derived_seed(seed, f"{key[0]}:{key[1]}"))
        return pd.DataFrame({"arm": [key[0]], "gene": [key[1]], "moves": [found]})

    many = moved.join(few, ["arm", "gene"], "left_anti").filter(F.col("d").isNotNull())
    cells = many.groupBy("arm", "gene", "y", F.floor((F.col("d") + 1) * (RANGES / 2)).alias("cell")).agg(F.count("*").alias("count"), F.sum("d").alias("total"))
    schema = "arm string, gene string, moves array<double>"
    far = cells.groupBy("arm", "gene").applyInPandas(by_components, schema)
    few = few.toDF("to", "gene")
    scores = ["seed", "variant_key", "y", "score"]
    of_ref = held.filter(is_ref).join(few, "gene").select(*[F.col(c).alias(f"r_{c}") for c in ("to", "gene", *scores)]).toDF("arm", "gene", *scores)
    of_arms = held.filter(~is_ref).join(few.withColumnRenamed("to", "arm"), ["arm", "gene"], "left_semi").select("arm", "gene", *scores)
    near = of_arms.groupBy("arm", "gene").cogroup(of_ref.groupBy("arm", "gene")).applyInPandas(by_scores, schema)
    told = facts.join(far.withColumn("far", F.lit(True)).union(near.withColumn("far", F.lit(False))), ["arm", "gene"], "left")
    drawn = F.transform("moves", lambda m: F.when(F.col("far"), m + F.col("delta")).otherwise(m))
    return told.withColumn("draws", drawn).drop("moves", "far")


def _at(values: Column, share: float) -> Column:
    """A quantile of a sorted array, between two values in proportion; null of an empty one."""
    place = F.lit(share) * (F.size(values) - 1)
    low, high = F.get(values, F.floor(place).cast("int")), F.get(values, F.ceil(place).cast("int"))
    return low + (high - low) * (place - F.floor(place))


def _with_interval(table: DataFrame, alpha: float) -> DataFrame:
    good = F.array_sort(F.filter("draws", lambda d: d.isNotNull() & ~F.isnan(d)))
    ends = table.withColumn("__d", good).withColumns({"ci_low": _at(F.col("__d"), alpha / 2), "ci_high": _at(F.col("__d"), 1 - alpha / 2)}).drop("__d", "draws")
    return ends.withColumn("excludes_zero", F.coalesce((F.col("ci_low") > 0) | (F.col("ci_high") < 0), F.lit(False)))


def paired_table(predictions: DataFrame, reference: str, n: int = 1000, seed: int = 0, alpha: float = 0.05, exact: int = EXACT) -> DataFrame:
    """``paired_draws`` with an interval of the difference, whether it leaves out zero, and whether a gene has variants enough."""
    return _with_interval(paired_draws(predictions, reference, n, seed, exact), alpha).withColumn("scoreable", F.col("n") >= SCOREABLE)


def paired_means(draws: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(arm, genes, n, n_benign, auc, auc_reference, delta, ci_low, ci_high, excludes_zero): the mean difference over genes, each resampled
    within itself, of arms with two such genes or more. Genes of few variants, or on which no resample tells both arms apart, are
    left out. ``draws``: from ``paired_draws``."""
    same = F.forall("draws", lambda d: d.isNull() | F.isnan(d) | (d == 0)) & (F.col("delta") == 0)
    held = _shared(draws.filter((F.col("n") >= SCOREABLE) & F.col("delta").isNotNull() & ~same))
    means = [F.avg(c).alias(c) for c in ("auc", "auc_reference", "delta")]
    sums = held.groupBy("arm").agg(F.concat_ws("+", F.array_sort(F.collect_list("gene"))).alias("genes"), F.count("*").alias("__g"), F.sum("n").alias("n"), F.sum("n_benign").alias("n_benign"), *means)
    each = held.select("arm", F.posexplode("draws").alias("i", "d")).filter(F.col("d").isNotNull() & ~F.isnan("d"))
    mean = each.groupBy("arm", "i").agg(F.avg("d").alias("d")).groupBy("arm").agg(F.collect_list("d").alias("draws"))
    return _with_interval(sums.filter("__g >= 2").drop("__g").join(mean, "arm", "left"), alpha)
