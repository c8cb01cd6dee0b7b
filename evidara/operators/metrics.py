"""Evaluation: ranking, confusion, calibration and risk measures by group, as aggregates over (group, label, score)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidara.operators.graph import _shared
from evidara.operators.ranking import average_ranks, exact_quantiles, matched, running, tie_counts

#: Rows of a table that may go to every task.
SENT = 500_000


def _on(groups: Sequence[str]):
    return lambda a, b: a.join(b, list(groups)) if groups else a.join(F.broadcast(b))  # without groups b is one row


def roc_auc(rows: DataFrame, groups: Sequence[str], label: str, score: str) -> DataFrame:
    """Rank-sum AUC with ties averaged, by group; null where a class is absent."""
    rows = rows.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
    ties = tie_counts(rows, groups, score, {"pos": F.col(label).cast("bigint"), "rows": F.lit(1)})
    rank = F.col("le_rows") - (F.col("n_rows") - 1) / 2
    sums = ties.groupBy(*groups).agg(F.sum(rank * F.col("n_pos")).alias("rs"), F.sum("n_pos").alias("pos"), F.sum("n_rows").alias("n"))
    neg = F.col("n") - F.col("pos")
    auc = F.when((F.col("pos") > 0) & (neg > 0), (F.col("rs") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * neg))
    return sums.select(*groups, F.col("n").alias("n"), F.col("pos").alias("n_pos"), auc.alias("auc"))


def symmetric(auc: Column) -> Column:
    return F.greatest(auc, 1 - auc)


def column_agreement(rows: DataFrame, label: str, columns: Sequence[str], warn: float = 0.95, refuse: float = 0.99) -> DataFrame:
    """How well each column alone tells the label, in either direction, and what that means for its use as a feature."""
    long = rows.filter(F.col(label).isNotNull()).select(label, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot([label], list(columns), "column", "value")
    auc = roc_auc(long, ["column"], label, "value").withColumn("agreement", symmetric(F.col("auc")))
    return auc.withColumn("severity", F.when(F.col("agreement") >= refuse, "critical").when(F.col("agreement") >= warn, "warning").otherwise("ok"))


def average_precision(rows: DataFrame, groups: Sequence[str], label: str, score: str, ordinal: str) -> DataFrame:
    """Mean precision at the positives in order of (score descending, ordinal): ties are not merged."""
    run = running(rows.withColumn("__one", F.lit(1)), groups, score, {"__hits": label, "__seen": "__one"}, descending=True, ties=[F.asc(ordinal)])
    at = F.when(F.col(label) == 1, F.col("__hits") / F.col("__seen"))
    return run.groupBy(*groups).agg((F.sum(at) / F.sum(label)).alias("average_precision"))


def average_precision_tied(rows: DataFrame, groups: Sequence[str], label: str, score: str) -> DataFrame:
    """Precision weighted by the recall that each distinct score adds: ties are merged."""
    ties = rows.filter(F.col(score).isNotNull()).groupBy(*groups, score).agg(F.sum(label).alias("p"), F.count("*").alias("n"))
    run = running(ties, groups, score, {"__p": "p", "__n": "n"}, descending=True)
    return run.groupBy(*groups).agg((F.sum(F.col("p") * F.col("__p") / F.col("__n")) / F.sum("p")).alias("average_precision"))


def mcc(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    """Matthews correlation, 0 where it is not defined."""
    tp, fp, fn, tn = (c.cast("double") for c in (tp, fp, fn, tn))
    below = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    return F.when(below > 0, (tp * tn - fp * fn) / F.sqrt(below)).otherwise(0.0)


def confusion(rows: DataFrame, groups: Sequence[str], label: str, predicted: Column) -> DataFrame:
    """Counts tp, fp, fn, tn by group; rows without label or prediction are left out."""
    rows = rows.withColumn("__p", predicted.cast("int")).filter(F.col(label).isNotNull() & F.col("__p").isNotNull())
    is_ = lambda y, p: F.count_if((F.col(label) == y) & (F.col("__p") == p))
    return rows.groupBy(*groups).agg(is_(1, 1).alias("tp"), is_(0, 1).alias("fp"), is_(1, 0).alias("fn"), is_(0, 0).alias("tn"))


def panel(counts: DataFrame) -> DataFrame:
    """Measures from tp, fp, fn, tn; those that divide by nothing are 0."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    recall, precision, specificity = share(tp, tp + fn), share(tp, tp + fp), share(tn, tn + fp)
    return counts.withColumns({
        "n": (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")), "accuracy": share(tp + tn, tp + fp + fn + tn), "precision": precision, "recall": recall,
        "specificity": specificity, "npv": share(tn, tn + fn), "f1": share(2 * tp, 2 * tp + fp + fn), "balanced_accuracy": (recall + specificity) / 2, "mcc": mcc(tp, fp, fn, tn),
    })


def threshold_sweep(rows: DataFrame, groups: Sequence[str], label: str, score: str) -> DataFrame:
    """Confusion counts and measures at each distinct score as the threshold (positive from it upwards)."""
    ties = tie_counts(rows.filter(F.col(label).isNotNull()), groups, score, {"pos": F.col(label).cast("bigint"), "rows": F.lit(1).cast("bigint")})
    totals = ties.groupBy(*groups).agg(F.sum("n_pos").alias("P"), F.sum("n_rows").alias("N"))
    below_pos, below = F.col("le_pos") - F.col("n_pos"), F.col("le_rows") - F.col("n_rows")
    joined = _on(groups)(ties, totals)
    counts = joined.select(*groups, F.col(score).alias("threshold"), (F.col("P") - below_pos).alias("tp"), (F.col("N") - F.col("P") - (below - below_pos)).alias("fp"), below_pos.alias("fn"), (below - below_pos).alias("tn"))
    return panel(counts)


def best_threshold(rows: DataFrame, groups: Sequence[str], label: str, score: str, measure: str = "mcc") -> DataFrame:
    """The threshold of the largest measure, the smallest of equals."""
    sweep = threshold_sweep(rows, groups, label, score)
    best = F.min(F.struct((-F.col(measure)).alias("m"), F.col("threshold").alias("t"))).alias("b")
    return sweep.groupBy(*groups).agg(best).select(*groups, F.col("b.t").alias("threshold"), (-F.col("b.m")).alias(measure))


def grid_threshold(rows: DataFrame, groups: Sequence[str], label: str, score: str, steps: int = 2000, measure: str = "mcc") -> DataFrame:
    """The best of ``steps`` + 1 evenly spaced thresholds. Rows are first counted by the grid cell their score falls in."""
    cell = F.least(F.lit(steps), F.greatest(F.lit(-1), F.floor(F.col(score) * steps))).cast("int")
    cells = rows.filter(F.col(label).isNotNull() & F.col(score).isNotNull()).withColumn("__cell", cell).groupBy(*groups, "__cell").agg(F.sum(label).cast("bigint").alias("p"), F.count("*").alias("n"))
    # a score in cell c is at or above the thresholds up to c
    made = cells.groupBy(*groups).agg(F.collect_list(F.struct("__cell", "p", "n")).alias("cells"), F.sum("p").alias("P"), F.sum("n").alias("N"))  # steps + 2 at most
    at = made.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    above = lambda f: F.aggregate(F.filter("cells", lambda c: c["__cell"] >= F.col("t")), F.lit(0).cast("bigint"), lambda a, c: a + c[f])
    tp, pp = above("p"), above("n")
    counts = at.select(*groups, (F.col("t") / steps).alias("threshold"), tp.alias("tp"), (pp - tp).alias("fp"), (F.col("P") - tp).alias("fn"), (F.col("N") - F.col("P") - pp + tp).alias("tn"))
    best = F.min(F.struct((-F.col(measure)).alias("m"), F.col("threshold").alias("t"))).alias("b")
    return panel(counts).groupBy(*groups).agg(best).select(*groups, F.col("b.t").alias("threshold"), (-F.col("b.m")).alias(measure))


def reliability(rows: DataFrame, groups: Sequence[str], label: str, share: str, bins: int = 10, keep_empty: bool = True) -> DataFrame:
    """Count, mean share and mean label in equal bins of [0, 1], right-open but for the last."""
    cell = F.least(F.floor(F.col(share) * bins), F.lit(bins - 1)).cast("int")
    found = rows.filter(F.col(label).isNotNull() & F.col(share).isNotNull()).withColumn("bin", cell).groupBy(*groups, "bin").agg(F.count("*").alias("n"), F.avg(share).alias("confidence"), F.avg(F.col(label).cast("double")).alias("accuracy"))
    if not keep_empty:
        return found
    every = (rows.select(*groups).distinct() if groups else rows.sparkSession.range(1).drop("id")).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(found, [*groups, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def quantile_reliability(rows: DataFrame, groups: Sequence[str], label: str, share: str, bins: int = 10) -> DataFrame:
    """As ``reliability`` with bins between exact quantiles; equal edges make one bin."""
    edges = exact_quantiles(rows, groups, share, [i / bins for i in range(1, bins)]).withColumnRenamed("quantiles", "__edges")
    joined = _on(groups)(rows.filter(F.col(label).isNotNull()), edges)
    cell = F.size(F.filter(F.array_distinct("__edges"), lambda e: e <= F.col(share)))
    return joined.withColumn("bin", cell).groupBy(*groups, "bin").agg(F.count("*").alias("n"), F.avg(share).alias("confidence"), F.avg(F.col(label).cast("double")).alias("accuracy"))


def calibration_errors(bins: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Expected and largest gap between confidence and accuracy over bins that have rows."""
    gap = F.abs(F.col("confidence") - F.col("accuracy"))
    return bins.filter("n > 0").groupBy(*groups).agg((F.sum(gap * F.col("n")) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))


def brier(rows: DataFrame, groups: Sequence[str], label: str, share: str) -> DataFrame:
    return rows.groupBy(*groups).agg(F.avg(F.pow(F.col(share) - F.col(label), F.lit(2))).alias("brier"), F.avg(F.col(label).cast("double")).alias("prevalence"), F.count("*").alias("n"))


def spearman(rows: DataFrame, groups: Sequence[str], x: str, y: str) -> DataFrame:
    """Correlation of average ranks, by group, over rows that have both. The column of fewer values is ranked first and its ranks are
    brought to the rows; the other's values then need only their number of rows and sums of those ranks, and are put in order once.
    The mean rank is known, so sums over values give the result."""
    both = _shared(rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*groups, F.col(x).alias("__x"), F.col(y).alias("__y")))
    found = both.agg(F.approx_count_distinct("__x"), F.approx_count_distinct("__y")).first()
    few, many = ("__x", "__y") if found[0] <= found[1] else ("__y", "__x")
    centred = lambda rank: rank - (F.col("n") + 1) / 2
    ranks = _shared(average_ranks(both, groups, few).select(*groups, few, centred(F.col("rank")).alias("__r"), "n"))
    joined = matched(both, F.broadcast(ranks) if ranks.count() <= SENT else ranks, [*groups, few])
    values = joined.groupBy(*groups, many).agg(F.count("*").alias("__w"), F.sum("__r").alias("__s"), F.sum(F.col("__r") * F.col("__r")).alias("__q"), F.max("n").alias("n"))
    run = running(values, groups, many, {"__le": "__w"}).withColumn("__t", centred(F.col("__le") - (F.col("__w") - 1) / 2))
    first, second = F.sum("__q"), F.sum(F.col("__w") * F.col("__t") * F.col("__t"))
    told = run.groupBy(*groups).agg(F.when((first > 0) & (second > 0), F.sum(F.col("__s") * F.col("__t")) / F.sqrt(first * second)).alias("spearman"), F.sum("__w").alias("n"))
    return _shared(told)  # one row a group, whatever reads it how often


def risk_coverage(rows: DataFrame, groups: Sequence[str], confidence: str, correct: str, ordinal: str) -> DataFrame:
    """Each row's coverage and the error rate of all rows at least as confident, in order of (confidence descending, ordinal)."""
    run = running(rows.withColumn("__one", F.lit(1)).withColumn("__wrong", 1 - F.col(correct).cast("int")), groups, confidence, {"seen": "__one", "errors": "__wrong"}, descending=True, ties=[F.asc(ordinal)])
    total = rows.filter(F.col(confidence).isNotNull()).groupBy(*groups).agg(F.count("*").alias("__n"))
    return _on(groups)(run, total).withColumns({"coverage": F.col("seen") / F.col("__n"), "risk": F.col("errors") / F.col("seen")}).drop("__one", "__wrong", "__n")


def risk_area(curve: DataFrame, groups: Sequence[str]) -> DataFrame:
    return curve.groupBy(*groups).agg(F.avg("risk").alias("aurc"))


def ranking_at(rows: DataFrame, score: str, outcome: str, key: str, ks: Sequence[float]) -> DataFrame:
    """Precision and enrichment among the best k rows, k a number or a share of all, ties by key."""
    known = rows.filter(F.col(outcome).isNotNull())
    run = running(known.withColumn("__one", F.lit(1)), [], score, {"place": "__one"}, descending=True, ties=[F.asc(key)])
    base = known.agg(F.avg(outcome).alias("base"), F.count("*").alias("n"))
    joined = run.join(F.broadcast(base)).withColumn("k", F.explode(F.array(*[F.lit(float(k)) for k in ks])))
    top = F.when(F.col("k") < 1, F.greatest(F.lit(1), F.floor(F.col("k") * F.col("n")))).otherwise(F.least(F.col("k"), F.col("n"))).cast("bigint")
    cut = joined.withColumn("top", top).filter(F.col("place") <= F.col("top"))
    return cut.groupBy("k", "top", "base").agg(F.avg(outcome).alias("precision")).withColumn("enrichment", F.when(F.col("base") > 0, F.col("precision") / F.col("base")))


def class_confusion(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    return rows.groupBy(label, predicted).agg(F.count("*").alias("n"))


def class_panel(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support of each class that is a label or a prediction."""
    n = rows.groupBy(label, predicted).agg(F.count("*").alias("n"))
    sided = n.select(F.col(label).alias("class"), F.when(F.col(label) == F.col(predicted), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("said"))
    sided = sided.union(n.select(F.col(predicted), F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), F.col("n")))
    sums = sided.groupBy("class").agg(F.sum("tp").alias("tp"), F.sum("actual").alias("support"), F.sum("said").alias("predicted"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, support, said = F.col("tp"), F.col("support"), F.col("predicted")
    return sums.select("class", "support", share(tp, said).alias("precision"), share(tp, support).alias("recall"), share(2 * tp, support + said).alias("f1"))


def averaged_f1(classes: DataFrame) -> DataFrame:
    return classes.filter("support > 0").agg(F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"))


def multilabel_panel(rows: DataFrame, truth: str, shares: str, names: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Confusion-based measures of each label of arrays of 0/1 and of shares; null entries of ``truth`` are not counted."""
    each = rows.select(F.posexplode(F.arrays_zip(F.col(truth).alias("y"), F.col(shares).alias("p"))).alias("i", "v")).select("i", F.col("v.y").alias("y"), F.col("v.p").alias("p"))
    counts = panel(confusion(each, ["i"], "y", F.col("p") >= threshold))
    return counts.withColumn("name", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("i") + 1))


def cohorts(rows: DataFrame, label: str, predicted: Column, groupings: Sequence[str], least: int = 30, per_class: int = 5) -> DataFrame:
    """The panel for every level of every grouping in one long table; levels that are too small say so."""
    long = rows.withColumn("__p", predicted.cast("int")).select(label, "__p", *[F.col(g).cast("string").alias(g) for g in groupings]).unpivot([label, "__p"], list(groupings), "grouping", "level")
    out = panel(confusion(long, ["grouping", "level"], label, F.col("__p")))
    pos, neg = F.col("tp") + F.col("fn"), F.col("fp") + F.col("tn")
    return out.withColumn("available", (F.col("n") >= least) & (pos >= per_class) & (neg >= per_class))


def availability(n: Column, pos: Column, least: int = 30, per_class: int = 5) -> Column:
    """Why a cohort's measures are not to be reported, or ok."""
    return F.when(n < least, "too_few").when((pos < per_class) | (n - pos < per_class), "class_too_small").otherwise("ok")


def fold_small_groups(rows: DataFrame, group: str, least: int = 30) -> DataFrame:
    """Groups with fewer rows become ``other``."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("__n"))
    return rows.join(sizes, group, "left").withColumn(group, F.when(F.col("__n") >= least, F.col(group)).otherwise("other")).drop("__n")


def target_rates(train: DataFrame, test: DataFrame, key: str, label: str) -> DataFrame:
    """Test rows with their key's mean label among training rows, the overall mean for keys that are not there."""
    rates = train.groupBy(key).agg(F.avg(label).alias("rate"))
    prior = train.agg(F.avg(label).alias("__prior"))
    return test.join(rates, key, "left").join(F.broadcast(prior)).withColumn("rate", F.coalesce("rate", "__prior")).drop("__prior")


def seed_summary(cells: DataFrame, arm: Sequence[str], unit: str, seed: str, value: str) -> DataFrame:
    """Two levels: mean over units for each seed, then mean and sample deviation over seeds."""
    by_seed = cells.filter(F.col(value).isNotNull()).groupBy(*arm, seed).agg(F.avg(value).alias("m"), F.count_distinct(unit).alias("u"))
    return by_seed.groupBy(*arm).agg(F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"), F.count("*").alias("n_seeds"), F.max("u").alias("n_units"))


def benjamini_hochberg(tests: DataFrame, p: str) -> DataFrame:
    """Adjusted p-values: p * m / rank, made monotone from the largest p. Distinct values are ranked in ranges; the smallest ratio of
    the ranges above, one row each, is carried down. Null p stays null."""
    upto = tie_counts(tests, [], p, {"rows": F.lit(1)}).select(p, "le_rows").join(F.broadcast(tests.agg(F.count(p).alias("m"))))
    raw = upto.withColumn("raw", F.col(p) * F.col("m") / F.col("le_rows")).withColumn("cell", F.floor(F.col("le_rows") * 64 / F.col("m")))
    above = Window.partitionBy(F.lit(0)).orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)
    cells = raw.groupBy("cell").agg(F.min("raw").alias("least")).withColumn("carried", F.min("least").over(above)).select("cell", "carried")  # 65 rows
    inside = Window.partitionBy("cell").orderBy(F.desc("le_rows"))
    told = raw.withColumn("own", F.min("raw").over(inside)).join(F.broadcast(cells), "cell").select(p, F.least(F.lit(1.0), "own", "carried").alias("q"))
    return tests.join(told, p, "left")


def comparable(runs: DataFrame, by: str, hashes: Sequence[str]) -> DataFrame:
    """Groups of runs whose hashes differ, with how many there are of each: none may be pooled."""
    counts = runs.groupBy(by).agg(*[F.count_distinct(h).alias(h) for h in hashes])
    return counts.filter(sum((F.col(h) > 1).cast("int") for h in hashes) > 0)


def report(rows: DataFrame, groups: Sequence[str], label: str, share: str, threshold: float, ordinal: str) -> DataFrame:
    """AUC, average precision, Brier, calibration errors and the panel at one threshold, by group."""
    parts = [roc_auc(rows, groups, label, share).drop("n", "n_pos"), average_precision(rows, groups, label, share, ordinal), brier(rows, groups, label, share).drop("n"), calibration_errors(reliability(rows, groups, label, share), groups)]
    out = panel(confusion(rows, groups, label, F.col(share) >= threshold))
    for part in parts:
        out = _on(groups)(out, part)
    return out


def rounded(table: DataFrame, columns: Mapping[str, int]) -> DataFrame:
    """Numbers as text with so many decimals (half to even), n/a for null."""
    return table.withColumns({c: F.when(F.col(c).isNull(), "n/a").otherwise(F.format_string(f"%.{d}f", F.bround(c, d))) for c, d in columns.items()})


def auc_by_condition(rows: DataFrame, groups: Sequence[str], label: str, score: str, condition: Column) -> DataFrame:
    """AUC over all rows of a group, over those that meet a condition, and over the others: what a shortcut would need to differ."""
    met = F.coalesce(condition, F.lit(False))
    long = rows.withColumn("slice", F.explode(F.array(F.lit("all"), F.when(met, "met").otherwise("not_met"))))
    return roc_auc(long, [*groups, "slice"], label, score)


def auc_gap(validation: DataFrame, test: DataFrame, groups: Sequence[str], label: str, score: str) -> DataFrame:
    """AUC inside the training groups less that on held-out rows, by cell."""
    inner = roc_auc(validation, groups, label, score).select(*groups, F.col("auc").alias("validation_auc"))
    outer = roc_auc(test, groups, label, score).select(*groups, F.col("auc").alias("test_auc"))
    return inner.join(outer, list(groups)).withColumn("gap", F.col("validation_auc") - F.col("test_auc"))


def centroid_accuracy(rows: DataFrame, group: str, columns: Sequence[str], fold: str) -> DataFrame:
    """How often a row's group is the nearest centroid of the other folds: whether features alone tell the groups apart. Rows with
    a missing feature are left out; groups are few by contract, and a fold carries the centroids of all."""
    full = rows.dropna(subset=[group, fold, *columns])
    sums = lambda t, by, p: t.groupBy(*by).agg(F.count("*").alias(f"{p}n"), *[F.sum(F.col(c).cast("double")).alias(f"{p}{c}") for c in columns])
    total, part = sums(full, [group], "t_"), sums(full, [group, fold], "f_")
    grid = total.join(full.select(fold).distinct().withColumn("__one", F.lit(1)).join(total.select(group).withColumn("__one", F.lit(1)), "__one").drop("__one"), group).join(part, [group, fold], "left")
    n = F.col("t_n") - F.coalesce("f_n", F.lit(0))
    centre = F.array(*[(F.col(f"t_{c}") - F.coalesce(F.col(f"f_{c}"), F.lit(0.0))) / n for c in columns])
    centres = grid.filter(n > 0).groupBy(fold).agg(F.collect_list(F.struct(F.col(group).alias("g"), centre.alias("c"))).alias("centres"))
    own = F.array(*[F.col(c).cast("double") for c in columns])
    far = F.transform("centres", lambda x: F.struct(F.aggregate(F.zip_with(x["c"], own, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d).alias("d"), x["g"].alias("g")))
    guessed = full.join(centres, fold).withColumn("nearest", F.array_min(far)["g"])
    return guessed.agg(F.avg((F.col("nearest") == F.col(group)).cast("double")).alias("accuracy"), F.count("*").alias("n"), F.count_distinct(group).alias("n_groups"))
