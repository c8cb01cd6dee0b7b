"""Ranks and running sums that no single task has to hold.

A running sum over all rows in order of group and score is cut into ranges of that order: sums run within a range, and the ranges'
totals give where each starts. There are as many ranges as leave ``ROWS`` rows to each, so tasks stay as they are when tables grow,
and a hot group is cut like any other. Edges need not be exact for the result to be.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidara.operators.graph import _shared
from evidara.operators.skew import attach

#: Rows of a range, about.
ROWS = 250_000


def matched(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``a`` joined to ``b`` on keys of which null is a value like any other; without keys ``b`` is one row."""
    if not keys:
        return a.join(F.broadcast(b))
    other = {c: f"__j{i}" for i, c in enumerate(keys)}
    return a.join(b.withColumnsRenamed(other), [F.col(c).eqNullSafe(F.col(k)) for c, k in other.items()]).drop(*other.values())


def exact_quantiles(rows: DataFrame, groups: Sequence[str], column: str, shares: Sequence[float]) -> DataFrame:
    """One row for each group with the array quantiles: exact, between two values in proportion. Distinct values are ranked in
    ranges, so no buffer holds a group."""
    ties = tie_counts(rows, groups, column, {"rows": F.lit(1)})
    total = rows.filter(F.col(column).isNotNull()).groupBy(*groups).agg(F.count("*").alias("__n"))
    joined = matched(ties, total, groups)
    at = lambda q: F.lit(float(q)) * (F.col("__n") - 1)
    value = lambda place: F.min(F.when(F.col("le_rows") > place, F.col(column).cast("double")))
    parts = [c for i, q in enumerate(shares) for c in (value(F.floor(at(q))).alias(f"__l{i}"), value(F.ceil(at(q))).alias(f"__h{i}"))]
    found = joined.groupBy(*groups, "__n").agg(*parts)
    between = [F.col(f"__l{i}") + (F.col(f"__h{i}") - F.col(f"__l{i}")) * (at(q) - F.floor(at(q))) for i, q in enumerate(shares)]
    return found.select(*groups, F.array(*between).alias("quantiles"))


def running(rows: DataFrame, groups: Sequence[str], score: str, sums: dict[str, str], descending: bool = False, ties: Sequence[Column] = ()) -> DataFrame:
    """Adds, for each of ``sums`` (new column: column), its sum over all rows of the group up to and with this one, in order of
    ``score`` and ``ties``. Rows of a null score are not ranked and are dropped."""
    held = _shared(rows.filter(F.col(score).isNotNull()))
    order = [F.desc(score) if descending else F.asc(score), *ties]
    over = lambda *by: Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    n = -(-held.count() // ROWS)
    if n <= 1:  # one range
        return held.withColumns({n: F.sum(c).over(over(*groups)) for n, c in sums.items()})
    ranged = _shared(held.repartitionByRange(n, *groups, *order).withColumn("__range", F.spark_partition_id()))
    totals = ranged.groupBy(*groups, "__range").agg(*[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    by_range = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    before = by_range.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*groups, "__range", *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__s_{n}") for n in sums])
    inside = ranged.withColumns({f"__i_{n}": F.sum(c).over(over(*groups, "__range")) for n, c in sums.items()})
    out = matched(inside, starts, [*groups, "__range"])
    return out.withColumns({n: F.col(f"__i_{n}") + F.col(f"__s_{n}") for n in sums}).drop("__range", *[f"__{k}_{n}" for n in sums for k in "is"])


def tie_counts(rows: DataFrame, groups: Sequence[str], score: str, counts: dict[str, Column]) -> DataFrame:
    """One row for each group and distinct score, with sums of ``counts`` there (n_<name>) and up to there (le_<name>)."""
    tied = rows.filter(F.col(score).isNotNull()).groupBy(*groups, score).agg(*[F.sum(c).alias(f"n_{n}") for n, c in counts.items()])
    return running(tied, groups, score, {f"le_{n}": f"n_{n}" for n in counts})


def average_ranks(rows: DataFrame, groups: Sequence[str], score: str, weight: str | None = None) -> DataFrame:
    """Average rank, from 1, of each distinct score within its group, and the number of scores there; a row counts ``weight`` times."""
    one = F.col(weight) if weight else F.lit(1)
    ties = tie_counts(rows, groups, score, {"rows": one})
    total = rows.filter(F.col(score).isNotNull()).groupBy(*groups).agg(F.sum(one).alias("n"))
    ranked = ties.withColumn("rank", F.col("le_rows") - (F.col("n_rows") - 1) / 2)
    return matched(ranked, total, groups).select(*groups, score, "rank", "n")


def percentile_rank(rows: DataFrame, groups: Sequence[str], score: str, out: str) -> DataFrame:
    """Rows with average rank over number of scores; null for a null score."""
    ranks = average_ranks(rows, groups, score).select(*groups, score, (F.col("rank") / F.col("n")).alias(out))
    return rows.join(ranks, [*groups, score], "left")


def within_group_ranks(rows: DataFrame, group: str, signs: dict[str, int], consensus: str = "rank_consensus") -> DataFrame:
    """A percentile rank rank_<score> of every score in its group, downwards for sign -1, and their mean without nulls."""
    for score, sign in signs.items():
        signed = rows.withColumn("__signed", F.col(score) * sign)
        rows = percentile_rank(signed, [group], "__signed", f"rank_{score}").drop("__signed")
    ranks = F.array_compact(F.array(*[F.col(f"rank_{s}") for s in signs]))
    mean = F.aggregate(ranks, F.lit(0.0), lambda a, x: a + x) / F.size(ranks)
    return rows.withColumn(consensus, F.when(F.size(ranks) > 0, mean))


def risk_tiers(scores: DataFrame, groups: Sequence[str], score: str) -> DataFrame:
    """Percentile rank and a tier: high from 0.9, medium from 0.7."""
    ranked = percentile_rank(scores, groups, score, "pct")
    return ranked.withColumn("tier", F.when(F.col("pct") >= 0.9, "high").when(F.col("pct") >= 0.7, "medium").otherwise("low"))


def top_k(rows: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """The k rows of largest positive score, ties by key: each task keeps k."""
    return rows.filter(F.col(score) > 0).orderBy(F.desc(score), key).limit(k)


def top_k_by_group(rows: DataFrame, groups: Sequence[str], score: str, key: str, k: int) -> DataFrame:
    """The k rows of largest score in each group, ties by key, with their rank from 1. Scores are cut at a salted k-th first, so
    a hot group is no task of its own."""
    salt = F.pmod(F.xxhash64(key), F.lit(64))
    order = [F.desc_nulls_last(score), F.asc(key)]
    cut = rows.withColumn("__salt", salt).withColumn("__r", F.row_number().over(Window.partitionBy(*groups, "__salt").orderBy(*order))).filter(F.col("__r") <= k).drop("__salt", "__r")
    return cut.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).filter(F.col("rank") <= k)


def zscore(rows: DataFrame, groups: Sequence[str], columns: Sequence[str], train: DataFrame | None = None) -> DataFrame:
    """Columns less their group's mean over its sample deviation (population rows: those of ``train`` where given); 0 where a
    value is null or the group does not vary. A group of many rows is dealt over tasks."""
    fitted = train if train is not None else rows
    stats = fitted.groupBy(*groups).agg(*[F.avg(c).alias(f"__m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"__s_{c}") for c in columns])
    joined = attach(rows, stats, list(groups), how="left") if groups else rows.join(F.broadcast(stats))
    made = {f"z_{c}": F.coalesce(F.when(F.col(f"__s_{c}") > 0, (F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}")), F.lit(0.0)) for c in columns}
    return joined.withColumns(made).drop(*[f"__{k}_{c}" for c in columns for k in "ms"])


def _median(rows: DataFrame, groups: Sequence[str], column: str, name: str) -> DataFrame:
    return exact_quantiles(rows, groups, column, [0.5]).select(*groups, F.get("quantiles", F.lit(0)).alias(name))


def impute_medians(rows: DataFrame, columns: Sequence[str], groups: Sequence[str] = (), indicators: bool = True) -> DataFrame:
    """Nulls as the median (of the group where given, then of all, then 0), with a flag for each column that had them. Medians are
    found for columns that hold nulls only; ``rows`` are counted, so they should be a written table or a plain scan."""
    nulls = rows.agg(*[F.count_if(F.col(c).isNull()) for c in columns]).first() if columns else ()
    lacking = [c for c, n in zip(columns, nulls, strict=True) if n]
    out = rows
    for c in lacking:
        out = out.join(F.broadcast(_median(rows, [], c, f"__a_{c}")), how="left")  # one row
        if groups:
            out = out.join(_median(rows, groups, c, f"__g_{c}"), list(groups), "left")
    flags = {f"is_missing_{c}": F.col(c).isNull().cast("int") for c in columns} if indicators else {}
    medians = lambda c: [F.col(f"__{k}_{c}") for k in ("ga" if groups else "a")] if c in lacking else []
    filled = {c: F.coalesce(F.col(c), *medians(c), F.lit(0.0)) for c in columns}
    return out.withColumns(flags).withColumns(filled).drop(*[f"__{k}_{c}" for c in columns for k in "ag"])


def standardise(train: DataFrame, rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Median-imputed and scaled by the training rows' mean and population deviation; constant columns become 0."""
    stats = train.sparkSession.range(1).drop("id")
    for c in columns:
        stats = stats.join(_median(train, [], c, f"__q_{c}"), how="left")
    filled = lambda t: t.join(F.broadcast(stats)).withColumns({c: F.coalesce(c, f"__q_{c}", F.lit(0.0)) for c in columns}).drop(*[f"__q_{c}" for c in columns])
    moments = filled(train).agg(*[F.avg(c).alias(f"__m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"__s_{c}") for c in columns])
    out = filled(rows).join(F.broadcast(moments))  # one row
    return out.withColumns({c: F.when(F.col(f"__s_{c}") > 0, (F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}")).otherwise(0.0) for c in columns}).drop(*[f"__{k}_{c}" for c in columns for k in "ms"])
