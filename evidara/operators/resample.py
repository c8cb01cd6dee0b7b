"""Bootstrap intervals, paired comparisons and calibrators: seeded numpy on one group's scores at a time.

A group is one evaluation cell (an arm, a gene, an assay), whose scores are a few columns of numbers; these functions are the
only ones that take a whole group into a task. For corpora of rows use the aggregates in ``metrics``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.functions.hashing import derived_seed


def auc(y: np.ndarray, s: np.ndarray) -> float:
    pos = int(y.sum())
    if not 0 < pos < len(y):
        return math.nan
    rank = pd.Series(s).rank().to_numpy()
    return float((rank[y == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(y) - pos)))


def renewed(rows: DataFrame) -> DataFrame:
    """The same rows with columns of their own, so that they can be grouped beside others of the same origin."""
    named = rows.toDF(*[f"__{c}" for c in rows.columns])
    return named.toDF(*rows.columns)


def _none(x: float) -> float | None:
    return None if x is None or not math.isfinite(x) else float(x)


def interval(values: Sequence[float], alpha: float = 0.05) -> tuple[float | None, float | None]:
    good = [v for v in values if math.isfinite(v)]
    return (_none(np.quantile(good, alpha / 2)), _none(np.quantile(good, 1 - alpha / 2))) if good else (None, None)


def draws(y: np.ndarray, rng: np.random.Generator, stratified: bool) -> np.ndarray:
    if not stratified:
        return rng.integers(0, len(y), len(y))
    return np.concatenate([rng.choice(i, len(i)) for i in (np.flatnonzero(y == 0), np.flatnonzero(y == 1)) if len(i)])


def bootstrap(y: np.ndarray, s: np.ndarray, n: int, seed: int, statistic: Callable = auc, stratified: bool = False) -> tuple[float | None, float | None, float | None]:
    rng = np.random.default_rng(seed)
    return _none(statistic(y, s)), *interval([statistic(y[i], s[i]) for i in (draws(y, rng, stratified) for _ in range(n))])


def cell_auc(pos: np.ndarray, neg: np.ndarray) -> np.ndarray:
    """AUC of counts in cells of ascending score (last axis); pairs within a cell count half."""
    below = np.cumsum(neg, axis=-1) - neg
    total = pos.sum(axis=-1) * neg.sum(axis=-1)
    return np.where(total > 0, (pos * (below + neg / 2)).sum(axis=-1) / np.maximum(total, 1), np.nan)


def bootstrap_ci(rows: DataFrame, group: str, label: str, score: str, n: int = 1000, seed: int = 0, stratified: bool = False, cells: int = 1024) -> DataFrame:
    """AUC of each group with a percentile interval. The AUC is exact; resampling works on counts of both classes in at most
    ``cells`` ranges of the score, so a group of any size is a few numbers where it is resampled."""
    from evidara.operators.metrics import roc_auc

    known = rows.select(group, label, score).dropna(subset=[label, score])
    edges = known.groupBy(group).agg(F.percentile_approx(score, F.array(*[F.lit(i / cells) for i in range(1, cells)]), F.lit(10 * cells)).alias("edges"))
    counted = known.join(edges, group).withColumn("cell", F.size(F.filter(F.array_distinct("edges"), lambda e: e <= F.col(score))))
    counted = counted.groupBy(group, "cell").agg(F.sum(label).cast("long").alias("pos"), F.sum(1 - F.col(label)).cast("long").alias("neg"))

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell")
        rng, both = np.random.default_rng(derived_seed(seed, str(key[0]))), pdf[["pos", "neg"]].to_numpy(np.int64)
        if stratified:
            picks = np.stack([rng.multinomial(c.sum(), c / max(1, c.sum()), n) for c in both.T], axis=-1)
        else:
            picks = rng.multinomial(both.sum(), both.ravel() / both.sum(), n).reshape(n, -1, 2)
        low, high = interval(cell_auc(picks[..., 0].astype(float), picks[..., 1].astype(float)))
        return pd.DataFrame([(key[0], low, high)])

    kind = dict(rows.dtypes)[group]
    ends = counted.groupBy(group).applyInPandas(one, f"`{group}` {kind}, ci_low double, ci_high double")
    return roc_auc(known, [group], label, score).select(group, "n", "auc").join(ends, group, "left")


def pooled(pools: list, more) -> list:
    """``pools`` (first score, last score, sum of labels, weight), of ascending means, with further ones behind them: neighbours merge
    until means ascend again."""
    for pool in more:
        pools.append(tuple(pool))
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            b, a = pools.pop(), pools.pop()
            pools.append((a[0], b[1], a[2] + b[2], a[3] + b[3]))
    return pools


def isotonic_pools(rows: DataFrame, cell: str, label: str, score: str) -> DataFrame:
    """(cell, xs, ys): the isotonic regression of labels on scores, exactly, as ends of pools and their means. Labels are counted by
    distinct score and pooled within ranges of (cell, score); the pools of neighbouring ranges, which are far fewer than scores, are
    merged by cell. Merging pools in any order that keeps neighbours gives the same result."""
    from evidara.operators import ranking
    from evidara.operators.graph import _shared

    known = rows.filter(F.col(label).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    tied = _shared(known.groupBy(cell, F.col(score).cast("double").alias("first")).agg(F.sum(F.col(label).cast("double")).alias("total"), F.count("*").cast("double").alias("weight")))
    kind, fields = dict(rows.dtypes)[cell], ["first", "last", "total", "weight"]

    def within(batches):
        at, held = None, []
        for pdf in batches:
            for key, part in pdf.groupby(cell, sort=False, dropna=False):
                if held and not (key == at or key != key and at != at):
                    yield told(at, held)
                    held = []
                at, held = key, pooled(held, zip(part["first"], part["first"], part["total"], part["weight"], strict=True))
        if held:
            yield told(at, held)

    def told(key, held) -> pd.DataFrame:
        return pd.DataFrame([(None if key != key else key, *pool) for pool in held], columns=[cell, *fields])

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        held = pooled([], pdf.sort_values("first")[fields].itertuples(index=False))
        ends = [[x for pool in held for x in pool[:2]], [pool[2] / pool[3] for pool in held for _ in range(2)]]
        return pd.DataFrame([(pdf[cell].iloc[0], *ends)], columns=[cell, "xs", "ys"])

    n = max(1, -(-tied.count() // ranking.ROWS))
    parts = tied.repartitionByRange(n, cell, "first").sortWithinPartitions(cell, "first").mapInPandas(within, f"`{cell}` {kind}, first double, last double, total double, weight double")
    return parts.groupBy(cell).applyInPandas(across, f"`{cell}` {kind}, xs array<double>, ys array<double>")


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def platt(y: np.ndarray, p: np.ndarray, n: np.ndarray | None = None, rounds: int = 50, ridge: float = 1e-6) -> tuple[float, float]:
    """Slope and intercept of a logistic fit of the label on the logit, by Newton's method; a step that does not lower the loss is
    halved."""
    x, n = np.stack([logit(p), np.ones(len(p))], axis=1), np.ones(len(p)) if n is None else n
    loss = lambda w: float(n @ np.logaddexp(0, x @ w) - (n * y) @ (x @ w) + ridge / 2 * (w @ w))
    w = np.array([1.0, 0.0])
    now = loss(w)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        change = np.linalg.solve(x.T @ (x * (n * q * (1 - q))[:, None]) + ridge * np.eye(2), x.T @ (n * (y - q)) - ridge * w)
        for half in range(40):
            then = loss(w + change / 2**half)
            if then <= now:
                break
        else:
            break
        w, now = w + change / 2**half, then
        if np.abs(change).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def temperature(y: np.ndarray, p: np.ndarray, n: np.ndarray | None = None, low: float = 0.05, high: float = 20.0, rounds: int = 80) -> float:
    """The temperature of least log loss, by golden section over its logarithm."""
    z = logit(p)

    def loss(t: float) -> float:
        q = np.clip(1 / (1 + np.exp(-np.clip(z / math.exp(t), -30, 30))), 1e-12, 1 - 1e-12)
        return float(-np.average(y * np.log(q) + (1 - y) * np.log(1 - q), weights=n))

    a, b, g = math.log(low), math.log(high), (math.sqrt(5) - 1) / 2
    c, d = b - g * (b - a), a + g * (b - a)
    for _ in range(rounds):
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
        c, d = b - g * (b - a), a + g * (b - a)
    return math.exp((a + b) / 2)


def score_counts(rows: DataFrame, cell: str, label: str, score: str, digits: int = 4) -> DataFrame:
    """(cell, p, y, w): labelled rows counted by score to ``digits`` decimals, with their mean score and mean label. At most
    10,001 rows a cell for scores from 0 to 1, however large the cell is."""
    known = rows.filter(F.col(label).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score)))
    counted = known.groupBy(cell, F.round(score, digits).alias("__r")).agg(F.avg(score).alias("p"), F.avg(F.col(label).cast("double")).alias("y"), F.count("*").cast("double").alias("w"))
    return counted.select(cell, "p", "y", "w")


def calibrate(validation: DataFrame, test: DataFrame, cell: str, label: str, score: str, method: str) -> DataFrame:
    """Test rows with ``calibrated``: a calibrator fitted on each cell's validation scores and applied as an expression. isotonic is exact:
    constant over a pool, in proportion between pools, and as at the ends beyond them. platt and temperature are fitted on counts
    of scores to four decimals. Cells without both classes there keep their scores."""
    fit_rows, s = renewed(validation), F.col(score).cast("double")
    if method == "isotonic":
        both = fit_rows.filter(F.col(label).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))).groupBy(cell).agg(F.count_distinct(label).alias("__k")).filter("__k > 1").select(cell)
        fitted = isotonic_pools(fit_rows.join(both, cell, "left_semi"), cell, label, score).withColumnsRenamed({"xs": "__xs", "ys": "__ys"})
        i = F.size(F.filter("__xs", lambda x: x <= s))
        x0, x1, y0, y1 = (F.get(c, i - k) for c in ("__xs", "__ys") for k in (1, 0))
        made = F.when(i == 0, F.get("__ys", F.lit(0))).when(i == F.size("__xs"), y0).otherwise(y0 + (y1 - y0) * (s - x0) / (x1 - x0))
        made = F.when(F.col("__xs").isNotNull() & s.isNotNull() & ~F.isnan(s), made).otherwise(s)
    else:

        def one(key, fit: pd.DataFrame) -> pd.DataFrame:
            y, p, w = fit.y.to_numpy(float), fit.p.to_numpy(float), fit.w.to_numpy(float)
            slope = shift = None
            if 0 < y @ w < w.sum():
                slope, shift = platt(y, p, w) if method == "platt" else (1 / temperature(y, p, w), 0.0)
            return pd.DataFrame([(key[0], slope, shift)], columns=[cell, "__slope", "__shift"])

        fitted = score_counts(fit_rows, cell, label, score).groupBy(cell).applyInPandas(one, f"`{cell}` {dict(validation.dtypes)[cell]}, __slope double, __shift double")
        inside = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), s))
        z = F.col("__slope") * F.log(inside / (1 - inside)) + F.col("__shift")
        made = F.when(F.col("__slope").isNotNull(), 1 / (1 + F.exp(-z))).otherwise(s)
    return test.join(fitted, cell, "left").withColumn("calibrated", made).select(*test.columns, "calibrated")


def calibration_slope(rows: DataFrame, group: str, label: str, score: str) -> DataFrame:
    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        y, p, w = (pdf[c].to_numpy(float) for c in ("y", "p", "w"))
        return pd.DataFrame([(key[0], *(platt(y, p, w) if 0 < y @ w < w.sum() else (None, None)))])

    return score_counts(rows, group, label, score).groupBy(group).applyInPandas(one, f"`{group}` {dict(rows.dtypes)[group]}, slope double, intercept double")


def match_spans(predicted: DataFrame, gold: DataFrame, document: str, least: float = 0.5) -> DataFrame:
    """(document, label, tp, n_predicted, n_gold): spans (start, end, label) matched one to one, the largest overlap first."""

    def one(key, p: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        pairs = []
        for i, (a, b) in enumerate(zip(p.start, p.end, strict=True)):
            for j, (c, d) in enumerate(zip(g.start, g.end, strict=True)):
                shared, union = min(b, d) - max(a, c), max(b, d) - min(a, c)
                if shared > 0 and shared / union >= least:
                    pairs.append((-shared / union, i, j))
        used_p, used_g = set(), set()
        for _, i, j in sorted(pairs):
            if i not in used_p and j not in used_g:
                used_p.add(i)
                used_g.add(j)
        return pd.DataFrame([(key[0], key[1], len(used_p), len(p), len(g))])

    kind = dict(predicted.dtypes)[document]
    by = [document, "label"]
    return predicted.groupBy(by).cogroup(gold.groupBy(by)).applyInPandas(one, f"`{document}` {kind}, label string, tp long, n_predicted long, n_gold long")


def span_f1(matched: DataFrame) -> DataFrame:
    sums = matched.agg(*[F.sum(c).cast("double").alias(c) for c in ("tp", "n_predicted", "n_gold")])
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, p, g = F.col("tp"), F.col("n_predicted"), F.col("n_gold")
    return sums.select(share(tp, p).alias("precision"), share(tp, g).alias("recall"), share(2 * tp, p + g).alias("f1"))


#: Pairs of rows up to which the distribution of a rank sum is counted exactly.
EXACT_PAIRS = 4000


def rank_counts(n: int, m: int) -> np.ndarray:
    """Of all ways to draw ``n`` of ``n`` + ``m`` ranks, how many have each value of U (from 0 to n * m), as a share."""
    ways = np.zeros(n * m + 1)
    ways[0] = 1.0
    for k in range(1, n + 1):  # times (1 - q^(m + k)) / (1 - q^k), one step of the Gaussian binomial
        if m + k < len(ways):
            ways[m + k :] -= ways[: -(m + k)].copy()
        for i in range(k, len(ways)):
            ways[i] += ways[i - k]
    return ways / ways.sum()


def rank_test(u2: int, n: int, m: int, ties: float) -> tuple[float | None, float | None]:
    """Share of pairs in which x is larger (ties half) and a two-sided p-value, from twice U, both sizes and the sum of t^3 - t over
    tied values: exact without ties and up to ``EXACT_PAIRS`` pairs, else normal with tie and continuity correction."""
    if not n or not m:
        return None, None
    u, pairs = u2 / 2, n * m
    if not ties and pairs <= EXACT_PAIRS:
        ways = rank_counts(min(n, m), max(n, m))
        return u / pairs, min(1.0, 2 * float(ways[round(max(u, pairs - u)) :].sum()))
    variance = pairs / 12 * (n + m + 1 - ties / max(1, (n + m) * (n + m - 1)))
    if variance <= 0:
        return u / pairs, 1.0
    z = max(0.0, abs(u - pairs / 2) - 0.5) / math.sqrt(variance)
    return u / pairs, math.erfc(z / math.sqrt(2))


def mann_whitney(x: np.ndarray, y: np.ndarray) -> tuple[float | None, float | None]:
    """``rank_test`` of two samples in memory."""
    both = pd.Series(np.r_[x, y])
    t = both.value_counts().to_numpy().astype(float)
    return rank_test(round(2 * both.rank()[: len(x)].sum() - len(x) * (len(x) + 1)), len(x), len(y), float((t**3 - t).sum()))


def chi_square_tail(x: float, df: int) -> float:
    """Chance of a chi-square of ``df`` degrees above ``x``: the regularised upper incomplete gamma, by series or by continued
    fraction."""
    a, z = df / 2, x / 2
    if df <= 0 or z <= 0:
        return 1.0
    scale = math.exp(a * math.log(z) - z - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= z / k
            total += term
        return max(0.0, 1 - total * scale)
    b, c = z + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b)
        c = b + step / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * scale


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p-value of a table of two by two counts: the total of tables that are no likelier."""
    row, column, n = a + b, a + c, a + b + c + d
    log = lambda k: math.lgamma(k + 1)

    def chance(k: int) -> float:
        return math.exp(log(row) + log(n - row) + log(column) + log(n - column) - log(n) - log(k) - log(row - k) - log(column - k) - log(n - row - column + k))

    seen = chance(a)
    return min(1.0, sum(p for k in range(max(0, row + column - n), min(row, column) + 1) if (p := chance(k)) <= seen * (1 + 1e-9)))


def rank_sums(rows: DataFrame, outcome: str, covariates: Sequence[str]) -> DataFrame:
    """covariate, n and m (rows with and without the outcome), u2 (twice Mann and Whitney's U), ties (the sum of t^3 - t over
    values), effect (U over all pairs), distinct values, and ones and ones_rest (rows of value 1) where all are 0 or 1. Values are
    counted first and ranked in ranges, so no task holds a covariate."""
    from evidara.operators.ranking import tie_counts

    y = F.col(outcome).cast("int").alias("__y")
    long = rows.select(y, *[F.col(c).cast("double").alias(c) for c in covariates]).unpivot(["__y"], list(covariates), "covariate", "value").dropna()
    tied = tie_counts(long.filter(~F.isnan("value")), ["covariate"], "value", {"with": F.col("__y"), "rest": 1 - F.col("__y")})
    here, rest = F.col("n_with"), F.col("n_rest")
    size = (here + rest).cast("double")
    one = lambda c: F.sum(F.when(F.col("value") == 1, c).otherwise(0))
    found = tied.groupBy("covariate").agg(
        F.sum(here).alias("n"), F.sum(rest).alias("m"), F.sum((here * (2 * F.col("le_rest") - rest)).cast("decimal(38,0)")).alias("u2"), F.sum(size * size * size - size).alias("ties"),
        F.count("*").alias("n_values"), F.bool_and(F.col("value").isin(0.0, 1.0)).alias("binary"), one(here).alias("ones"), one(rest).alias("ones_rest"),
    )
    pairs = F.col("n").cast("double") * F.col("m")
    return found.withColumn("effect", F.when(pairs > 0, F.col("u2").cast("double") / 2 / pairs))


def level_counts(rows: DataFrame, outcome: str, covariates: Sequence[str], least: int = 1) -> DataFrame:
    """covariate, levels (those of ``least`` rows or more), n and chi2 (of level by outcome; with Yates' correction for two levels) of
    each nominal covariate."""
    y = F.col(outcome).cast("int").alias("__y")
    long = rows.select(y, *[F.col(c).cast("string").alias(c) for c in covariates]).unpivot(["__y"], list(covariates), "covariate", "level").dropna()
    cells = long.groupBy("covariate", "level").agg(F.sum("__y").alias("a"), F.count("*").alias("n")).filter(F.col("n") >= least)
    totals = cells.groupBy("covariate").agg(F.sum("a").alias("all_a"), F.sum("n").alias("all_n"), F.count("*").alias("levels"))
    share = F.col("all_a") / F.col("all_n")
    away = F.abs(F.col("a") - F.col("n") * share)
    away = F.when(F.col("levels") == 2, F.greatest(away - 0.5, F.lit(0.0))).otherwise(away)
    cell = F.when((share > 0) & (share < 1), away * away / (F.col("n") * share) + away * away / (F.col("n") * (1 - share))).otherwise(0.0)
    return cells.join(totals, "covariate").groupBy("covariate", "levels").agg(F.sum("n").alias("n"), F.sum(cell).alias("chi2"))


def covariate_tests(rows: DataFrame, outcome: str, covariates: Sequence[str], nominal: Sequence[str] = ()) -> DataFrame:
    """How each covariate differs between rows with and without an outcome: Fisher's exact test for 0/1 columns, ranks for numbers,
    chi-square for ``nominal`` ones (effect: Cramer's V); with p-values adjusted for the number of covariates. Only a row of sums for
    each covariate reaches the tests. Null and not-a-number values do not count; a nominal covariate of one level has no p-value."""
    from evidara.operators.metrics import benjamini_hochberg

    out = "covariate string, test string, n long, effect double, p double"

    def by_ranks(parts):
        for pdf in parts:
            told = []
            for r in pdf.itertuples():
                n, m = int(r.n), int(r.m)
                if r.binary:
                    a, c = int(r.ones), int(r.ones_rest)
                    effect, p = (a / n if n else 0.0) - (c / m if m else 0.0), fisher_exact(a, n - a, c, m - c)
                else:
                    effect, p = rank_test(int(r.u2), n, m, float(r.ties))
                told.append((r.covariate, "exact" if r.binary else "ranks", n + m, effect, p))
            yield pd.DataFrame(told, columns=["covariate", "test", "n", "effect", "p"])

    def by_levels(parts):
        for pdf in parts:
            told = [(r.covariate, "chi2", int(r.n), math.sqrt(r.chi2 / r.n), chi_square_tail(float(r.chi2), int(r.levels) - 1) if r.levels > 1 else None) for r in pdf.itertuples()]
            yield pd.DataFrame(told, columns=["covariate", "test", "n", "effect", "p"])

    found = rank_sums(rows, outcome, covariates).mapInPandas(by_ranks, out)
    if nominal:
        found = found.union(level_counts(rows, outcome, nominal).mapInPandas(by_levels, out))
    return benjamini_hochberg(found, "p")
