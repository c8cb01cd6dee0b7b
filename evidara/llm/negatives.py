"""Hard-negative mining: a distributed nearest-neighbour join over a Voronoi partition.

Vectors become integers, x = floor(``SCALE`` * c), and a row's score for an anchor is their exact inner product. An anchor's
positives are its best rows of the same label; for each positive, the negatives are the best rows of other labels whose score
lies between ``low`` percent of the positive's and the positive's own. Both are one join, run twice.

Inner products are no metric, so every vector gets one more coordinate, sqrt(M^2 - |x|^2) with M the largest norm; all then lie on
one sphere, an anchor's on its equator, and a higher score is a smaller angle. Pivots, taken farthest-first from a seeded sample
of ``SAMPLE`` rows (all that reaches the driver), part the sphere: a row is in the cell of its nearest pivot, anchors form groups by
the nearest of the first g pivots. The sample also gives each anchor a score that its worst wanted row reaches at least, and so
the widest angle it must look at. By the triangle inequality, a cell's rows can be that near only if their own angle to the
pivot lies in an interval, and not at all if the plane between the pivots is farther away. Anchors' intervals are joined for each
group and cell; a row is copied only to the groups whose interval holds its angle. g is the number with the fewest comparisons
among those that copy a row ``COPIES`` times at most on average; with g = 1 no row is copied more than once.

An anchor whose label, in the positives' join, has too few rows in the sample has no such score. It joins its label's rows on
their own, by label, whatever the cell; likewise vectors of a length that the sample lacks. Groups are cut into blocks of at
most about ``ANCHORS`` anchors and ``CELL`` rows; a block returns the first few rows of each anchor, never pairs, and the blocks'
answers are ranked together. Ties go to the smaller vec_id, a null one last.

Labels of any type are compared as text. Rows of null label or vector, with null or non-finite components, or with an integer
norm of 2^30 and more (scores would need more than a long) take no part; vectors of other lengths have no score for an
anchor. A row of null vec_id may serve but is no anchor by the query's rule. "Other rows" are those of another vec_id. Repeated rows take a place
each; a repeated anchor is answered as often. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidara.llm.near_vectors import farthest_first
from evidara.llm.skew import attach
from evidara.llm.workspace import Workspace

SCALE, SAMPLE, COPIES, CELL, ANCHORS, STRIP = 256, 2048, 4, 4096, 1024, 256
#: Least and largest number of pivots; there is one for every ``CELL`` rows between them.
FEW, MANY = 16, 256
LIMIT, SLACK, LOWEST = 2.0**30, 1e-6, np.iinfo(np.int64).min
ROW = "row long, vec_id long, label string, anchor boolean, dim int, norm double, vector binary"
KEY = ["dim", "grp", "part"]


def _integers(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(len(column), dim)


def _by_length(batch: pa.RecordBatch, size: int = 4096) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The batch's rows by length of vector, in slices."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        own = batch.filter(pa.array(dims == dim))
        for i in range(0, own.num_rows, size):
            yield dim, own.slice(i, size)


def rows_of(vectors: DataFrame, anchor: Column) -> DataFrame:
    """``ROW`` of all rows that take part."""
    good = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    chosen = vectors.select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col("embedding").cast("array<double>").alias("embedding"),
    ).filter(good)

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("embedding").value_lengths().to_numpy()
            batch = batch.append_column("dim", pa.array(sizes.astype(np.int32)))
            for dim, own in _by_length(batch):
                entries = own.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, dim)
                with np.errstate(over="ignore"):
                    x = np.floor(SCALE * entries)
                    norm = np.sqrt((x * x).sum(axis=1))
                fits = norm < LIMIT
                kept, x = own.filter(pa.array(fits)), x[fits].astype(np.int32)
                made = [*(kept.column(c) for c in ("row", "vec_id", "label", "anchor", "dim")), pa.array(norm[fits]), pa.array([v.tobytes() for v in x], pa.binary())]
                yield pa.RecordBatch.from_arrays(made, ["row", "vec_id", "label", "anchor", "dim", "norm", "vector"])

    return chosen.mapInArrow(quantise, ROW)


def on_sphere(x: np.ndarray, most: float) -> np.ndarray:
    """Rows with one more coordinate, as unit vectors."""
    unit = x / most
    return np.column_stack([unit, np.sqrt(np.maximum(1 - (unit * unit).sum(axis=1), 0))])


def angles(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ pivots.T, -1, 1))


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, as longs."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    most = np.sqrt((a * a).sum(axis=1).max(initial=0) * (b * b).sum(axis=1).max(initial=0))
    if most < 2**52:  # so is every partial sum
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def first_few(score: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` first allowed of each row by falling score, then by column."""
    held, keep = np.where(allowed, score, LOWEST), allowed
    if k < score.shape[1]:
        edge = np.partition(held, score.shape[1] - k, axis=1)[:, score.shape[1] - k, None]
        keep = allowed & (held >= edge)
    row, column = np.nonzero(keep)
    order = np.lexsort((column, -score[row, column], row))
    row, column = row[order], column[order]
    start = np.cumsum(np.bincount(row, minlength=len(score))) - np.bincount(row, minlength=len(score))
    first = np.arange(len(row)) - start[row] < k
    return row[first], column[first]


class Voronoi:
    """Pivots and sample of each length of vectors, on the driver and broadcast."""

    def __init__(self, rows: DataFrame):
        total, self.most = rows.agg(F.count("*"), F.max("norm")).first()
        self.most = max(self.most or 0.0, 1.0)
        # a row's share of the hash range decides, so nothing is ranked
        lot = F.conv(F.substring(F.md5(F.col("row").cast("string")), 1, 8), 16, 10).cast("double") / 2**32
        drawn = rows.filter(lot < 2 * SAMPLE / max(total, 1)).orderBy(F.md5(F.col("row").cast("string"))).limit(SAMPLE).select("vec_id", "label", "dim", "vector").collect()
        self.sample: dict[int, tuple] = {}
        self.pivots: dict[int, np.ndarray] = {}
        self.seen: dict[int, tuple] = {}
        for dim in {r.dim for r in drawn}:
            own = [r for r in drawn if r.dim == dim]
            x = np.frombuffer(b"".join(r.vector for r in own), np.int32).reshape(len(own), dim)
            self.sample[dim] = (x, np.array([r.label for r in own]), np.array([-1 if r.vec_id is None else r.vec_id for r in own]), np.array([r.vec_id is None for r in own]))
            units = on_sphere(x, self.most)
            self.pivots[dim] = farthest_first(units, min(MANY, max(FEW, total // CELL)))
            self.seen[dim] = self.placed(x, dim)

    def placed(self, x: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
        """Cell and angle to its pivot of each row."""
        away = angles(on_sphere(x, self.most), self.pivots[dim])
        cell = away.argmin(axis=1)
        return cell, away[np.arange(len(x)), cell]

    def sampled(self, own: pa.RecordBatch, x: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of anchors and sample, which of them share the label, and which are rows of another vec_id."""
        known, labels, ids, none = self.sample[dim]
        same = own.column("label").to_numpy(zero_copy_only=False).astype(str)[:, None] == labels
        other = (own.column("vec_id").to_numpy()[:, None] != ids) | none
        return scores(x, known), same, other

    def levels(self, dim: int) -> list[int]:
        """Numbers of groups to choose from."""
        n = len(self.pivots[dim])
        return sorted({n, *(1 << i for i in range(n.bit_length()) if 1 << i <= n)})

    def intervals(self, x: np.ndarray, dim: int, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each anchor's angle to each pivot, and the angles to it between which a row of the cell can score from ``least`` to
        ``most`` (anchors x pivots)."""
        pivots, norm = self.pivots[dim], np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        safe = np.where(norm > 0, norm, 1.0)
        units = np.column_stack([x / safe[:, None], np.zeros(len(x))])
        away = angles(units, pivots)
        widest = np.arccos(np.clip(least / (safe * self.most), -1, 1))[:, None] + SLACK
        nearest = np.arccos(np.clip(most / (safe * self.most), -1, 1))[:, None] - SLACK
        low, high = np.maximum(away - widest, nearest - away) - SLACK, away + widest
        home = away.argmin(axis=1)
        apart = np.linalg.norm(pivots[home][:, None, :] - pivots[None], axis=2)
        ahead = np.cos(away[np.arange(len(x)), home])[:, None] - np.cos(away)
        plane = np.arcsin(np.clip(ahead / np.where(apart > 0, apart, 1.0), -1, 1))
        low = np.where((apart > 0) & (plane > widest + SLACK), np.inf, low)
        zero = norm == 0  # all scores are 0, whatever the angle
        low[zero], high[zero] = -np.inf, np.inf
        return away, low, high


def reached(voronoi: Voronoi, asked: DataFrame, limits) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """For each length of vectors: the number of groups, and the interval of angles of each group and cell. ``limits`` gives the
    anchors that have limits, with their least and most scores."""
    shared = asked.sparkSession.sparkContext.broadcast(voronoi)  # SAMPLE rows at most

    def span(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, held = shared.value, {}
        for batch in batches:
            for dim, own in _by_length(batch, STRIP):
                if dim not in v.pivots:
                    continue
                x = _integers(own.column("vector"), dim)
                known, least, most = limits(v, own, x, dim)
                away, low, high = v.intervals(x[known], dim, least[known], most[known])
                for level in v.levels(dim):
                    home = away[:, :level].argmin(axis=1)
                    if (dim, level) not in held:
                        held[dim, level] = np.full((level, away.shape[1]), np.inf), np.full((level, away.shape[1]), -np.inf), np.zeros(level, np.int64)
                    lows, highs, n = held[dim, level]
                    np.minimum.at(lows, home, low)
                    np.maximum.at(highs, home, np.where(np.isinf(low) & (low > 0), -np.inf, high))
                    np.add.at(n, home, 1)
        for (dim, level), (lows, highs, n) in held.items():
            grp = np.repeat(np.nonzero(n)[0], lows.shape[1])
            cell = np.tile(np.arange(lows.shape[1]), (n > 0).sum())
            ints = [pa.array(c.astype(np.int32)) for c in (np.full(len(grp), dim), np.full(len(grp), level), grp, cell)]
            yield pa.RecordBatch.from_arrays([*ints, pa.array(lows[grp, cell]), pa.array(highs[grp, cell]), pa.array(n[grp])], ["dim", "level", "grp", "cell", "low", "high", "n"])

    spans = asked.mapInArrow(span, "dim int, level int, grp int, cell int, low double, high double, n long")
    found: dict[tuple, tuple] = {}
    # at most two groups a pivot and an interval for each group and pivot
    for r in spans.groupBy("dim", "level", "grp", "cell").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).collect():
        count = len(voronoi.pivots[r.dim])
        lows, highs, n = found.setdefault((r.dim, r.level), (np.full((r.level, count), np.inf), np.full((r.level, count), -np.inf), np.zeros(r.level)))
        lows[r.grp, r.cell], highs[r.grp, r.cell], n[r.grp] = r.low, r.high, r.n
    best: dict[int, tuple] = {}
    for (dim, level), (lows, highs, n) in sorted(found.items()):
        cell, angle = voronoi.seen[dim]
        share = ((lows[:, cell] <= angle) & (angle <= highs[:, cell])).mean(axis=1)
        work = (n * share).sum()
        if dim not in best or share.sum() <= COPIES and work < 0.95 * best[dim][0]:
            best[dim] = work, level, lows, highs
    return {dim: rest for dim, (_, *rest) in best.items()}


def in_groups(voronoi: Voronoi, asked: DataFrame, limits, groups: dict, apart: bool) -> DataFrame:
    """``asked`` with its group and part: -1 where it has no limits, with the label as its part if ``apart`` or not."""
    shared = asked.sparkSession.sparkContext.broadcast((voronoi, groups))
    names = asked.columns

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, chosen = shared.value
        for batch in batches:
            for dim, own in _by_length(batch, STRIP):
                grp = np.full(own.num_rows, -1, np.int32)
                if dim in chosen:
                    x = _integers(own.column("vector"), dim)
                    known, least, most = limits(v, own, x, dim)
                    away = v.intervals(x, dim, np.where(known, least, 0), np.where(known, most, 0))[0]
                    grp = np.where(known, away[:, : chosen[dim][0]].argmin(axis=1), -1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(grp)], [*names, "grp"])

    made = asked.mapInArrow(put, ", ".join(f"{n} {t}" for n, t in asked.dtypes) + ", grp int")
    return made.withColumn("part", F.col("label") if apart else F.lit(""))


def copied(voronoi: Voronoi, rows: DataFrame, groups: dict, apart: bool) -> DataFrame:
    """Rows with each group that they might serve; those of lengths without groups go to -1 unless ``apart``."""
    shared = rows.sparkSession.sparkContext.broadcast((voronoi, groups))
    kept = ["row", "vec_id", "label", "dim", "vector"]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, chosen = shared.value
        for batch in batches:
            for dim, own in _by_length(batch, STRIP):
                at, grp = np.arange(0 if apart else own.num_rows), np.full(0 if apart else own.num_rows, -1)
                if dim in chosen:
                    cell, angle = v.placed(_integers(own.column("vector"), dim), dim)
                    _, lows, highs = chosen[dim]
                    grp, at = np.nonzero((lows[:, cell] <= angle) & (angle <= highs[:, cell]))
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([*(own.column(c).take(take) for c in kept), pa.array(grp.astype(np.int32))], [*kept, "grp"])

    made = rows.select(kept).mapInArrow(put, "row long, vec_id long, label string, dim int, vector binary, grp int")
    return made.withColumn("part", F.col("label") if apart else F.lit(""))


def join_blocks(asked: DataFrame, sent: DataFrame, space: Workspace, block, schema: str) -> DataFrame:
    """``block`` of the anchors (side 0) and rows (side 1) of each block; both tables are written ones."""
    both = asked.groupBy(KEY).agg(F.count("*").alias("a")).join(sent.groupBy(KEY).agg(F.count("*").alias("c")), KEY)
    sizes = space.save(both.withColumn("rows", F.ceil(F.col("a") / ANCHORS)).withColumn("columns", F.ceil(F.col("c") / CELL)), "sizes")
    number = lambda n, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    wide = [*KEY, "i", "j", "side", "row", "vec_id", "label", "vector"]
    with_size = lambda table, n: attach(table, sizes.select(*KEY, "rows", "columns"), KEY, sizes.select(*KEY, F.col(n).alias("n")))
    left = with_size(asked, "a").withColumn("i", number("rows", 0)).withColumn("j", every("columns")).withColumn("side", F.lit(0)).select(*wide, "wanted")
    right = with_size(sent, "c").withColumn("j", number("columns", 1)).withColumn("i", every("rows")).withColumn("side", F.lit(1)).select(*wide, F.lit(None).cast(asked.schema["wanted"].dataType).alias("wanted"))
    return left.union(right).groupBy(*KEY, "i", "j").applyInArrow(block, schema)


def _sides(table: pa.Table) -> tuple[pa.Table, pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors, and rows in the order in which ties are broken; their integers; and which pairs share a label."""
    side, dim = table.column("side").to_numpy(), table.column("dim")[0].as_py()
    a, c = table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1))
    c = c.sort_by([("vec_id", "ascending")])  # null last
    labels = np.unique(np.concatenate([t.column("label").to_numpy().astype(str) for t in (a, c)]), return_inverse=True)[1]
    return a, c, _integers(a.column("vector"), dim), _integers(c.column("vector"), dim), labels


def positive_block(table: pa.Table, k: int) -> pa.Table:
    """The ``k`` first rows of the anchor's label for each anchor of the block."""
    a, c, x, y, labels = _sides(table)
    mine, ids, none = labels[: len(x)], c.column("vec_id"), c.column("vec_id").is_null().to_numpy()
    theirs, held = labels[len(x) :], ids.fill_null(0).to_numpy()
    own, parts = a.column("vec_id").to_numpy(), []
    for i in range(0, max(len(x), 1), STRIP):  # hashing may leave a block without anchors or without rows
        score = scores(x[i : i + STRIP], y)
        row, column = first_few(score, (mine[i : i + STRIP, None] == theirs) & ((own[i : i + STRIP, None] != held) | none), k)
        parts.append((row + i, column, score[row, column]))
    row, column, score = (np.concatenate(p) for p in zip(*parts, strict=True))
    return pa.table({"row": a.column("row").take(pa.array(row)), "id": ids.take(pa.array(column)), "score": pa.array(score)})


def least_of(score: np.ndarray, low: int) -> np.ndarray:
    """The least integer that is at least ``low`` percent of each score, without overflow."""
    whole, rest = np.divmod(score, 100)
    return low * whole - (-low * rest) // 100


def _wanted(batch: pa.RecordBatch | pa.Table, k: int) -> np.ndarray:
    """Scores of each anchor's positives, -1 where there is none or it is negative: anchors x ``k``."""
    found = np.full((batch.num_rows, k), -1, np.int64)
    for i, row in enumerate(batch.column("wanted").to_pylist()):
        for p, positive in enumerate(row):
            found[i, p] = max(positive["score"], -1)
    return found


def negative_block(table: pa.Table, k: int, places: int, low: int) -> pa.Table:
    """For each anchor of the block and place of a positive: the ``k`` first rows of other labels within the limits."""
    a, c, x, y, labels = _sides(table)
    mine, theirs, top = labels[: len(x)], labels[len(x) :], _wanted(a, places)
    parts = []
    for i in range(0, max(len(x), 1), STRIP):
        score = scores(x[i : i + STRIP], y)
        other = mine[i : i + STRIP, None] != theirs
        for p in range(places):
            most = top[i : i + STRIP, p, None]
            row, column = first_few(score, other & (most >= 0) & (score <= most) & (score >= least_of(most, low)), k)
            parts.append((row + i, np.full(len(row), p, np.int32), column, score[row, column]))
    row, place, column, score = (np.concatenate(p) for p in zip(*parts, strict=True))
    return pa.table({"row": a.column("row").take(pa.array(row)), "place": pa.array(place + 1), "id": c.column("vec_id").take(pa.array(column)), "score": pa.array(score)})


def ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The ``k`` first of each ``by``, with their rank from 1; each task ranks its own before anything is shuffled."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80) -> DataFrame:
    """anchor_id, positive_id, positive_rank, rank, negative_id, positive_score and negative_score: for each row of ``vectors``
    (vec_id, embedding, label) where ``anchor`` holds and each of its positives, the negatives by rank."""
    space = Workspace(vectors.sparkSession, "negatives")
    rows = space.save(rows_of(vectors, anchor), "rows")
    voronoi = Voronoi(rows)

    def of_positives(v: Voronoi, own: pa.RecordBatch, x: np.ndarray, dim: int):
        score, same, other = v.sampled(own, x, dim)
        held = np.where(same & other, score, LOWEST)
        known = (same & other).sum(axis=1) >= positives
        least = np.partition(held, held.shape[1] - positives, axis=1)[:, -positives] if held.shape[1] >= positives else np.zeros(len(x))
        return known, least.astype(np.float64), np.full(len(x), np.inf)

    def of_negatives(v: Voronoi, own: pa.RecordBatch, x: np.ndarray, dim: int):
        score, same, _ = v.sampled(own, x, dim)
        top, least = _wanted(own, positives), np.full(len(x), np.inf)
        for p in range(positives):
            most = top[:, p, None]
            bottom = least_of(most, low)
            held = np.where(~same & (score <= most) & (score >= bottom), score, LOWEST)
            if held.shape[1] >= negatives:  # as many of the sample are there already
                bottom = np.maximum(bottom, np.partition(held, held.shape[1] - negatives, axis=1)[:, -negatives, None])
            least = np.where(top[:, p] >= 0, np.minimum(least, bottom[:, 0]), least)
        return np.ones(len(x), bool), least, top.max(axis=1).astype(np.float64)

    def joined(asked: DataFrame, limits, apart: bool, block, schema: str, by: list[str], k: int, name: str) -> DataFrame:
        groups = reached(voronoi, asked, limits)
        grouped = space.save(in_groups(voronoi, asked, limits, groups, apart), "grouped")
        sent = copied(voronoi, rows, groups, apart)
        if apart:  # labels with anchors that join by label alone
            alone = space.save(grouped.filter("grp < 0").select("dim", "label").distinct(), "alone")
            few = rows.join(alone, ["dim", "label"], "left_semi").select("row", "vec_id", "label", "dim", "vector", F.lit(-1).alias("grp"), F.col("label").alias("part"))
            sent = sent.unionByName(few)
        sent = space.save(sent, "sent")
        found = space.save(ranked(join_blocks(grouped, sent, space, block, schema), by, k), name)
        space.drop("grouped", "sent", "sizes", "alone")
        return found

    wants = "array<struct<rank: int, id: long, score: long>>"
    anchors = space.save(rows.filter("anchor").withColumn("wanted", F.lit(None).cast(wants)), "anchors")
    best = joined(anchors, of_positives, True, lambda t: positive_block(t, positives), "row long, id long, score long", ["row"], positives, "positives")
    wanted = best.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("wanted")).filter(F.exists("wanted", lambda x: x["score"] >= 0))
    asked = space.save(anchors.drop("wanted").join(wanted, "row"), "asked")
    schema = "row long, place int, id long, score long"
    hard = joined(asked, of_negatives, False, lambda t: negative_block(t, negatives, positives, low), schema, ["row", "place"], negatives, "hard")
    told = hard.join(asked.select("row", F.col("vec_id").alias("anchor_id"), "wanted"), "row").withColumn("positive", F.element_at("wanted", F.col("place")))
    return told.select("anchor_id", F.col("positive.id").alias("positive_id"), F.col("place").alias("positive_rank"), "rank", F.col("id").alias("negative_id"), F.col("positive.score").alias("positive_score"), F.col("score").alias("negative_score"))
