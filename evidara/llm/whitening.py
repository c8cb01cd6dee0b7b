"""Embedding whitening: a two-pass covariance.

Entries are quantised: c becomes the integer x = floor(``SCALE`` * c) + ``SHIFT``. The first pass sums x exactly (in two halves
of 32 bits each, so no sum of fewer than 2^31 rows a task overflows), which gives the mean as a fraction S/n. The second
centres each vector as (n*x - S)/n, an exact integer over n, before it multiplies, and sums the outer products of a batch by one
matrix product; both passes merge by ``treeAggregate``. LAPACK's symmetric solver gives the components; their matrix, of at
most ``COMPONENTS`` vectors, is broadcast and every row is projected. A third pass measures the covariance of what comes out,
by means and centred products of batches that are merged pairwise, and its largest difference to the identity.

Components are numbered by falling eigenvalue; each sign is that which makes the entry of largest size positive. A component
without variance (its eigenvalue is at most 1e-12 of the trace) has null ``whitened`` and no part in ``identity_error``, which is
null without any. ``deviation`` is exact in 38 digits, null beyond.

Vectors of each length are a fit list of their own, with a model of their own (the driver holds a matrix for each length). Rows
whose vector is null or holds null or non-finite entries, or an entry whose x needs more than 52 bits, are dropped; empty
vectors have no components and so no rows. Repeated rows count and are answered as often as they occur; a null vec_id is kept. An
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT, COMPONENTS, SPAN, DEPTH = 1024, 100_000, 8, 2.0**52, 3
OUT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
HALF = 32


def quantised(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of vectors in ``column``: the rows that count, and their integers as a matrix."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes[sizes > 0]).tolist():
        rows = np.nonzero(sizes == dim)[0]
        entries = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        with np.errstate(over="ignore", invalid="ignore"):
            x = np.floor(SCALE * entries) + SHIFT
            good = (np.abs(x) < SPAN).all(axis=1)  # false for what is not a number
        yield rows[good], x[good].astype(np.int64)


def _batches(vectors: DataFrame, summed) -> RDD:
    """What ``summed`` makes of the matrices of each batch, as an RDD of small dicts by length."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        for batch in batches:
            found = {x.shape[1]: summed(x) for _, x in quantised(batch.column("embedding")) if len(x)}
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)], pa.binary())], ["part"])

    def opened(row) -> dict:
        import pickle

        return pickle.loads(row.part)

    return vectors.select("embedding").mapInArrow(each, "part binary").rdd.map(opened)


def _merged(parts: RDD, merge) -> dict:
    """All dicts as one, values of a key merged; by a tree, so the driver gets a few."""

    def both(a: dict, b: dict) -> dict:
        for dim, part in b.items():
            a[dim] = merge(a[dim], part) if dim in a else part
        return a

    return parts.treeAggregate({}, both, both, DEPTH)


def sums(vectors: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """n and the exact sums of each length of vectors."""

    def summed(x: np.ndarray) -> tuple[int, list[int]]:
        high, low = (x >> HALF).sum(axis=0), (x & ((1 << HALF) - 1)).sum(axis=0)
        return len(x), [(int(h) << HALF) + int(w) for h, w in zip(high, low, strict=True)]

    return _merged(_batches(vectors, summed), lambda a, b: (a[0] + b[0], [s + t for s, t in zip(a[1], b[1], strict=True)]))


def centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n*x - S of each entry: as longs where they fit, else as Python's integers."""
    most = max(n * int(np.abs(x).max(initial=0)), *map(abs, total))
    if most < 1 << 62:
        return n * x - np.array(total, np.int64)
    return n * x.astype(object) - np.array(total, object)


def covariances(vectors: DataFrame, fits: dict) -> dict[int, np.ndarray]:
    """The covariance of each length's integers, divisor n."""
    shared = vectors.sparkSession.sparkContext.broadcast(fits)  # a row of sums for each length

    def summed(x: np.ndarray) -> np.ndarray:
        n, total = shared.value[x.shape[1]]
        away = centred(x, n, total).astype(np.float64) / n
        return away.T @ away

    found = _merged(_batches(vectors, summed), lambda a, b: a + b)
    return {dim: total / fits[dim][0] for dim, total in found.items()}


def components_of(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues and unit eigenvectors (columns) by falling eigenvalue, at most ``COMPONENTS``, and each one's share of the trace."""
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:COMPONENTS], axes[:, ::-1][:, :COMPONENTS]
    largest = np.abs(axes).argmax(axis=0)
    axes = axes * np.sign(axes[largest, np.arange(axes.shape[1])])
    trace = float(np.trace(covariance))
    values = np.where(values > 1e-12 * trace, values, 0.0)
    return values, axes, values / trace if trace > 0 else np.full(len(values), np.nan)


def project(x: np.ndarray, model: dict) -> np.ndarray:
    """Whitened coordinates of the components that have variance."""
    away = centred(x, model["n"], model["sums"]).astype(np.float64) / model["n"]
    return away @ model["matrix"]


def identity_errors(vectors: DataFrame, models: dict) -> dict[int, float | None]:
    """The largest absolute entry of whitened's covariance minus the identity, for each length."""
    shared = vectors.sparkSession.sparkContext.broadcast(models)

    def summed(x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        made = project(x, shared.value[x.shape[1]])
        mean = made.mean(axis=0)
        return len(made), mean, (made - mean).T @ (made - mean)

    def merge(a: tuple, b: tuple) -> tuple:
        n, step = a[0] + b[0], b[1] - a[1]
        return n, a[1] + step * (b[0] / n), a[2] + b[2] + np.outer(step, step) * (a[0] * b[0] / n)

    found = _merged(_batches(vectors, summed), merge)
    return {dim: float(np.abs(c / n - np.eye(len(c))).max()) if len(c) else None for dim, (n, _, c) in found.items()}


def fit(vectors: DataFrame) -> dict[int, dict]:
    """A model for each length of ``vectors`` (embedding): n, sums, matrix, explained and identity_error."""
    fits = sums(vectors)
    models = {}
    for dim, covariance in covariances(vectors, fits).items():
        values, axes, explained = components_of(covariance)
        some = values > 0
        models[dim] = {"n": fits[dim][0], "sums": fits[dim][1], "some": some, "matrix": axes[:, some] / np.sqrt(values[some]), "explained": [None if np.isnan(e) else float(e) for e in explained]}
    for dim, error in identity_errors(vectors, models).items():
        models[dim]["identity_error"] = error
    return models


def deviations(x: np.ndarray, model: dict) -> list[Decimal | None]:
    """Exact sum of (n*x - S)^2 of each row."""
    away = centred(x, model["n"], model["sums"])
    if away.dtype != object and int(np.abs(away).max(initial=0)) ** 2 * away.shape[1] >= 1 << 63:
        away = away.astype(object)
    found = [int(d) for d in (away * away).sum(axis=1)]
    return [Decimal(d) if d < 10**38 else None for d in found]


def whiten(vectors: DataFrame) -> DataFrame:
    """``OUT`` for every row of ``vectors`` (vec_id, embedding) and component."""
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    shared = vectors.sparkSession.sparkContext.broadcast(fit(vectors))  # sums and COMPONENTS vectors for each length

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in quantised(batch.column("embedding")):
                if not len(rows):
                    continue
                model = shared.value[x.shape[1]]
                count = len(model["some"])
                made = np.full((len(x), count), np.nan)
                made[:, model["some"]] = project(x, model)
                repeat = np.repeat(np.arange(len(rows)), count)
                ids, deviation = batch.column("vec_id").take(pa.array(rows)), pa.array(deviations(x, model), pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(repeat)), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(rows))), pa.array(np.full(len(repeat), model["n"], np.int64)), deviation.take(pa.array(repeat)),
                        pa.array(made.ravel(), mask=np.isnan(made.ravel())), pa.array(model["explained"] * len(rows), pa.float64()), pa.array([model["identity_error"]] * len(repeat), pa.float64()),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return vectors.mapInArrow(each, OUT)
