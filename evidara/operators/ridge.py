"""Ridge regressions of every assay, each fold predicted by a model of the other folds.

A model needs sums of products of its training rows only, and these are differences of sums over folds. They are gathered by
Spark, solved once an assay for all penalties, and brought back to the rows, whose leave-one-out errors choose the penalty. What is
chosen is a few numbers for each fold of an assay, joined to the rows, which predict themselves. No task holds an assay: what one
takes at once is a batch or a block of rows, or the sums of an assay's folds. Only numbers of rows go through Python, and of these
only sums come back.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.operators.graph import _shared
from evidara.operators.skew import attach

#: Rows of a block, about, and cells (assay, fold) whose sums a task keeps before it passes them on.
BLOCK, CELLS = 20_000, 256
#: Numbers of a table that may go to every task.
SENT = 1_000_000

#: Penalties of the published comparison: 13 from a thousandth to a thousand, evenly on a log scale.
ALPHAS = tuple(10 ** (i / 2 - 3) for i in range(13))


def _usable(features: Sequence[str], target: str, fold: str):
    finite = [F.col(c).isNotNull() & (F.abs(F.col(c).cast("double")) < float("inf")) for c in (*features, target)]
    usable = F.col(fold).isNotNull()
    for condition in finite:
        usable = usable & condition
    return usable


def _cells(*codes: pa.Array) -> Iterator[tuple[tuple, np.ndarray]]:
    """The distinct values of the columns, taken together, with the places of the rows that have them."""
    found = [pc.dictionary_encode(c, null_encoding="encode") for c in codes]
    at = np.zeros(len(codes[0]), np.int64)
    for c in found:
        at = at * len(c.dictionary) + c.indices.to_numpy()
    order = np.argsort(at, kind="stable")
    for places in np.split(order, np.flatnonzero(np.diff(at[order])) + 1) if len(order) else []:
        yield tuple(c.dictionary[c.indices[int(places[0])].as_py()].as_py() for c in found), places


def _numbers(batch: pa.RecordBatch, p: int) -> np.ndarray:
    return np.column_stack([batch.column(f"z{i}").to_numpy(zero_copy_only=False) for i in range(p + 1)])


def _sums(placed: DataFrame, p: int) -> DataFrame:
    """(a, f, m): sums of the products of (1, features, target), less the assay's means, over usable rows."""
    kinds = dict(placed.dtypes)
    width = p + 2

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            z = np.column_stack([np.ones(batch.num_rows), _numbers(batch, p)])
            for cell, places in _cells(batch.column("a"), batch.column("f")):
                mine = z[places]
                held[cell] = held.get(cell, 0.0) + mine.T @ mine
            if len(held) > CELLS:
                yield table(held, batch.schema)
                held = {}
        if held:
            yield table(held, batch.schema)

    def table(held: dict, schema: pa.Schema) -> pa.RecordBatch:
        keys = [pa.array([cell[i] for cell in held], schema.field(c).type) for i, c in enumerate("af")]
        return pa.RecordBatch.from_arrays([*keys, pa.array([m.ravel() for m in held.values()], pa.list_(pa.float64()))], names=["a", "f", "m"])

    rows = placed.filter("ok").select("a", "f", *[f"z{i}" for i in range(p + 1)])
    parts = rows.mapInArrow(partial, f"a string, f {kinds['f']}, m array<double>").select("a", "f", F.posexplode("m").alias("i", "v"))
    cells = parts.groupBy("a", "f", "i").agg(F.sum("v").alias("v")).groupBy("a", "f").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("m"))
    return cells.select("a", "f", F.slice(F.col("m.v"), 1, width * width).alias("m"))


def solved(total: np.ndarray) -> tuple[int, np.ndarray, float, np.ndarray, np.ndarray, np.ndarray]:
    """From sums of products of (1, x, y): rows, mean of x and of y, eigenvalues and vectors of x's scatter, and x'y along them."""
    n = int(round(total[0, 0]))
    mean = total[0] / max(1, n)
    centred = total - n * np.outer(mean, mean)
    values, vectors = np.linalg.eigh(centred[1:-1, 1:-1])
    return n, mean[1:-1], float(mean[-1]), values.clip(min=0), vectors, vectors.T @ centred[1:-1, -1]


def _models(sums: DataFrame, p: int) -> DataFrame:
    """(a, f, n, mean, level, values, vectors, along): for each fold, what its assay's other folds determine."""
    kinds = dict(sums.dtypes)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = np.stack(pdf["m"].to_numpy()).reshape(len(pdf), p + 2, p + 2)
        out = []
        for i, (a, f) in enumerate(zip(pdf["a"], pdf["f"], strict=True)):
            n, mean, level, values, vectors, along = solved(np.delete(parts, i, axis=0).sum(axis=0))
            out.append((a, f, n, mean, level, values, vectors.ravel(), along))
        return pd.DataFrame(out, columns=["a", "f", "n", "mean", "level", "values", "vectors", "along"])

    return sums.groupBy("a").applyInPandas(one, f"a {kinds['a']}, f {kinds['f']}, n long, mean array<double>, level double, values array<double>, vectors array<double>, along array<double>")


def _gaps(a: pa.Array, f: pa.Array, z: np.ndarray, models: dict[str, list[dict]], alphas: np.ndarray) -> Iterator[tuple]:
    """(assay, fold, errors): for each model of an assay, the squared leave-one-out errors of those rows that it was trained on."""
    p = z.shape[1] - 1
    cells: dict[str, list] = {}
    for (assay, fold), places in _cells(a, f):
        cells.setdefault(assay, []).append((fold, places))
    for assay, parts in cells.items():
        for m in models.get(assay, ()):
            own = m["f"]
            train = [places for fold, places in parts if fold != own and (fold == fold or own == own)]
            if m["n"] < 3 or not train:
                continue
            x = z[np.concatenate(train)]
            shrink = 1 / (np.array(m["values"])[:, None] + alphas)
            inside = (x[:, :p] - np.array(m["mean"])) @ np.array(m["vectors"]).reshape(p, p)
            gap = (x[:, p] - m["level"])[:, None] - inside @ (shrink * np.array(m["along"])[:, None])
            with np.errstate(divide="ignore", invalid="ignore"):
                gap = gap / (1 - inside**2 @ shrink - 1 / m["n"])
            yield assay, m["f"], (gap**2).sum(axis=0)


def _errors(placed: DataFrame, centres: DataFrame, models: DataFrame, p: int, alphas: np.ndarray) -> DataFrame:
    """(a, f, e): the sums of squared leave-one-out errors for each penalty. Few models go to all tasks; many meet blocks of rows."""
    kind = dict(models.dtypes)["f"]
    out = f"a string, f {kind}, e array<double>"
    used = placed.filter("ok")

    def table(found: list[tuple], fold: pa.DataType) -> pa.Table:
        columns = [pa.array([a for a, _, _ in found], pa.string()), pa.array([f for _, f, _ in found], fold), pa.array([e for _, _, e in found], pa.list_(pa.float64()))]
        return pa.Table.from_arrays(columns, names=["a", "f", "e"])

    if models.count() * (p + 2) ** 2 <= SENT:
        by: dict[str, list[dict]] = {}
        for m in models.toArrow().to_pylist():
            by.setdefault(m["a"], []).append(m)
        sent = models.sparkSession.sparkContext.broadcast(by)

        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict = {}
            for batch in batches:
                for a, f, e in _gaps(batch.column("a"), batch.column("f"), _numbers(batch, p), sent.value, alphas):
                    held[a, f] = held.get((a, f), 0.0) + e
            if held:
                yield from table([(*cell, e) for cell, e in held.items()], batch.schema.field("f").type).to_batches()

        found = used.select("a", "f", *[f"z{i}" for i in range(p + 1)]).mapInArrow(one, out)
    else:
        blocks = F.ceil(F.col("n") / BLOCK)
        # any deal does that is the same whenever a row is read
        dealt = attach(used, centres.select("a", blocks.alias("blocks")), "a").withColumn("b", F.floor(F.col("u") * F.col("blocks")))
        spread = models.join(centres.select("a", blocks.alias("blocks")), "a").withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))

        def two(left: pa.Table, right: pa.Table) -> pa.Table:
            batch, mine = left.combine_chunks(), right.to_pylist()
            if not batch.num_rows or not mine:
                return table([], right.schema.field("f").type)
            one_chunk = batch.to_batches()[0]
            return table(list(_gaps(one_chunk.column("a"), one_chunk.column("f"), _numbers(one_chunk, p), {mine[0]["a"]: mine}, alphas)), right.schema.field("f").type)

        found = dealt.groupBy("a", "b").cogroup(spread.groupBy("a", "b")).applyInArrow(two, out)
    return found.groupBy("a", "f").agg(F.array(*[F.sum(F.get("e", F.lit(i))) for i in range(len(alphas))]).alias("e"))


def out_of_fold_ridge(rows: DataFrame, assay: str, features: Sequence[str], target: str, fold: str, alphas: Sequence[float] = ALPHAS) -> DataFrame:
    """Rows with ``predicted`` and ``alpha``: a ridge model of the assay's other folds, with an intercept, whose penalty has the least
    squared leave-one-out error over its training rows (the first of equal ones). Rows that lack the target, a feature or the fold, or
    hold values that are not finite, train nothing; those without target are predicted all the same. A model of fewer than three rows
    predicts nothing. Rows of a null assay form one. ``rows`` are read four times, so they should be a written table. Memory: a batch,
    or a block of about ``BLOCK`` rows, and K * (p + 2)^2 sums of an assay; models of up to ``SENT`` numbers go to every task."""
    features, alphas, p = list(features), np.array([float(a) for a in alphas]), len(features)
    doubles = [F.col(c).cast("double") for c in (*features, target)]
    # the assay goes by one column that is never null, so that joins and groups see null as a value
    key = F.coalesce(F.concat(F.lit("="), F.col(assay).cast("string")), F.lit("null"))
    plain = rows.select(key.alias("a"), F.col(fold).alias("f"), _usable(features, target, fold).alias("ok"), F.rand(1).alias("u"), *[d.alias(f"x{i}") for i, d in enumerate(doubles)])
    means = [F.coalesce(F.avg(F.when(F.col("ok"), F.col(f"x{i}"))), F.lit(0.0)) for i in range(p + 1)]
    centres = _shared(plain.groupBy("a").agg(F.count("*").alias("n"), F.array(*means).alias("c")))
    placed = _met(plain, centres.select("a", "c"), ["a"], p + 2).select("a", "f", "ok", "u", *[(F.col(f"x{i}") - F.get("c", F.lit(i))).alias(f"z{i}") for i in range(p + 1)])
    models = _shared(_models(_sums(placed, p), p))
    errors = _errors(placed, centres, models, p, alphas)
    picked = errors.select("a", "f", F.coalesce(F.nullif(F.array_position("e", F.array_min("e")), F.lit(0)), F.lit(1)).cast("int").alias("pick"))

    def weights(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [np.array(v).reshape(p, p) @ (np.array(along) / (np.array(e) + alphas[i - 1])) for v, along, e, i in zip(pdf["vectors"], pdf["along"], pdf["values"], pdf["pick"], strict=True)]
            yield pd.DataFrame({"__key": pdf["a"], "__fold": pdf["f"], "__w": made, "__alpha": alphas[pdf["pick"].to_numpy() - 1], "__m": [np.array(m) + np.array(c)[:p] for m, c in zip(pdf["mean"], pdf["c"], strict=True)], "__level": pdf["level"] + pdf["c"].str[-1]})

    known = models.filter("n >= 3").join(picked, ["a", "f"]).join(centres.drop("n"), "a")
    fits = _shared(known.mapInPandas(weights, f"__key string, __fold {dict(models.dtypes)['f']}, __w array<double>, __alpha double, __m array<double>, __level double"))
    told = _met(rows.withColumns({"__key": key, "__fold": F.col(fold)}), fits, ["__key", "__fold"], 2 * p + 3, how="left")
    whole = F.lit(True)
    for d in doubles[:p]:
        whole = whole & d.isNotNull() & (F.abs(d) < float("inf"))
    away = F.zip_with(F.zip_with(F.array(*doubles[:p]), "__m", lambda x, m: x - m), "__w", lambda x, w: x * w)
    predicted = F.aggregate(away, F.lit(0.0), lambda s, x: s + x) + F.col("__level")
    return told.select(*rows.columns, F.when(whole, predicted).alias("predicted"), F.when(whole, F.col("__alpha")).alias("alpha"))


def _met(many: DataFrame, one: DataFrame, keys: list[str], width: int, how: str = "inner") -> DataFrame:
    """``many`` joined to a written table of one row for each of ``keys``, which goes to all tasks where it is small."""
    if one.count() * width <= SENT:
        return many.join(F.broadcast(one), keys, how)
    return attach(many, one, keys, how=how)


def against_published(ours: DataFrame, published: DataFrame, assay: str) -> DataFrame:
    """One row that holds own values (assay, spearman) beside published ones (assay, published): assays, those that both have, means,
    correlation of values and of ranks over at least three assays, mean absolute and median difference, shares within 0.02 and 0.05."""
    from evidara.operators.metrics import spearman
    from evidara.operators.ranking import exact_quantiles

    joined = _shared(ours.join(published, assay, "left").withColumn("gap", F.col("spearman") - F.col("published")))
    both = joined.filter(F.col("gap").isNotNull())
    within = lambda most: F.avg((F.abs("gap") <= most).cast("double"))
    least = lambda c: F.when(F.col("compared") >= 3, c)
    sums = joined.agg(
        F.count("*").alias("assays"), F.count("gap").alias("compared"), F.avg("spearman").alias("mean_ours"), F.avg("published").alias("mean_published"), F.corr("spearman", "published").alias("r"),
        F.avg(F.abs("gap")).alias("mean_abs_diff"), within(0.02).alias("within_002"), within(0.05).alias("within_005"),
    )
    ranks = spearman(both.select(F.lit(0).alias("all"), "spearman", "published"), ["all"], "spearman", "published").select(F.col("spearman").alias("rho"))
    median = exact_quantiles(both, [], "gap", [0.5]).select(F.get("quantiles", F.lit(0)).alias("median_diff"))
    one = sums.join(F.broadcast(ranks), how="left").join(F.broadcast(median), how="left")  # one row each
    return one.withColumns({"pearson": least(F.col("r")), "rank_correlation": least(F.col("rho"))}).drop("r", "rho")


def individual_and_combined(rows: DataFrame, assay: str, features: Sequence[str], target: str, fold: str, protein_fold: str, alphas: Sequence[float] = ALPHAS) -> DataFrame:
    """(assay, n, individual, combined, gain): Spearman's correlation of each assay's target with out-of-fold predictions by a model of
    that assay alone (``fold``) and by one model of all assays (``protein_fold`` keeps related assays together). A feature that is
    missing takes its assay's median."""
    from evidara.operators.metrics import spearman
    from evidara.operators.ranking import impute_medians

    filled = _shared(impute_medians(rows.select(*dict.fromkeys([assay, *features, target, fold, protein_fold])), list(features), [assay], indicators=False))
    own = out_of_fold_ridge(filled, assay, features, target, fold, alphas)
    shared = out_of_fold_ridge(filled.withColumn("__all", F.lit("all")), "__all", features, target, protein_fold, alphas)
    judge = lambda t, name: spearman(t.select(assay, target, "predicted"), [assay], "predicted", target).select(assay, F.col("spearman").alias(name))
    sizes = filled.groupBy(assay).agg(F.count("*").alias("n"))
    table = sizes.join(judge(own, "individual"), assay, "left").join(judge(shared, "combined"), assay, "left")
    return table.withColumn("gain", F.col("combined") - F.col("individual"))
