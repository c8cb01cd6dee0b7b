"""Embedding near-duplicates: an exact metric range join.

Cosine >= c of two vectors is a distance of at most r = sqrt(2 - 2c) of their unit vectors. Pivots part the vectors at every
size of table: a vector is at home in the cell of its nearest pivot q. By the triangle inequality, anything within r of it is
at home in the cell of a pivot p that is at most 2r farther from it than q; and since which of two pivots is nearer is decided
by a plane between them, it can only be so if the vector is within r of the plane of p and q. A vector is copied to the cells
that both bounds allow. So a cell holds, for each vector at home, all its partners, and cells join on their own, those of
each label apart. A cell of more than ``CELL`` rows is cut into blocks of at most about that many, each pair of blocks a task
of its own: dense spots that no pivot can part stay exact and bounded. Blocks count links and give a spanning forest, never
pairs.

Pivots are taken farthest-first from a seeded sample of ``SAMPLE`` vectors (all that reaches the driver), the same for all
labels; there are as many as bring the largest label's cells down to ``CELL`` rows, halved until a vector of the sample is
copied to ``COPIES`` cells at most on average, but never fewer than ``COPIES``. Vectors spread evenly over many dimensions
thus get few cells and more blocks, and the copies stay in proportion to the rows.

Equal vectors of a label are one class that is joined once and counted with its copies. Vectors are scaled by their largest
component first, so no norm under- or overflows. Cosines are computed in double precision; those within 1e-9 of the threshold
a second time, the same way for both orders.

Labels of any type are compared as text. Vectors that are null, empty, zero or hold null or non-finite components, and those
without a label, link with nothing. A null vec_id counts as a partner but never names a component. Repeated rows are copies.
An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.llm.graph import components, merge
from evidara.llm.skew import attach
from evidara.llm.workspace import Workspace

CELL, SAMPLE, COPIES, ROWS = 4096, 2048, 4, 512
GROUP = ["label", "dim"]
CLASS = "key string, first_id long, copies long, label string, dim int"
PLACED = f"{CLASS}, cell int, home boolean, vector binary"


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of doubles, the largest component of each 1 or -1, from a column of arrays."""
    found = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return found / np.abs(found).max(axis=1, keepdims=True)


def _units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def classes_of(vectors: DataFrame, space: Workspace) -> tuple[DataFrame, DataFrame]:
    """(vec_id, key) of every row, key null where it links with nothing; and a row for each key with its vector and copies."""
    keyed = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    good = F.col("label").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    key = F.concat(F.hex(F.xxhash64("label", "embedding")), F.hex(F.xxhash64(F.lit(1), "label", "embedding")))
    keyed = keyed.withColumn("key", F.when(F.coalesce(good, F.lit(False)), key))
    rows = space.save(keyed.select("vec_id", "key"), "rows")
    own = F.any_value(F.struct("label", F.size("embedding").alias("dim"), "embedding")).alias("own")
    classes = keyed.filter("key is not null").groupBy("key").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"), own)
    return rows, space.save(classes.select("key", "first_id", "copies", "own.*"), "classes")


def farthest_first(units: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows at most, each the one farthest from those before it; equal rows are taken once."""
    chosen, far = [0], np.full(len(units), np.inf)
    while len(chosen) < n:
        far = np.minimum(far, 2 - 2 * units @ units[chosen[-1]])
        at = int(far.argmax())
        if far[at] < 1e-9:
            break
        chosen.append(at)
    return units[chosen]


def cells_of(units: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest pivot, and whether it belongs to each cell (rows x pivots)."""
    apart = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))
    cosines = units @ pivots.T
    near = cosines.argmax(axis=1)
    best = cosines[np.arange(len(units)), near][:, None]
    far = np.sqrt(np.maximum(2 - 2 * cosines, 0))
    inside = (far <= np.sqrt(np.maximum(2 - 2 * best, 0)) + 2 * radius + 1e-6) & (best - cosines <= radius * apart[near] + 1e-6)
    inside[np.arange(len(units)), near] = True
    return near, inside


def pivots_of(classes: DataFrame, radius: float) -> dict[int, np.ndarray]:
    """Unit pivots for each length of vectors."""
    sizes = classes.groupBy(GROUP).agg(F.count("*").alias("n"))
    total, largest = sizes.agg(F.sum("n"), F.max("n")).first()
    if not total:
        return {}
    # a row's share of the hash range decides, so no group is ranked
    lot = F.conv(F.substring(F.md5("key"), 1, 8), 16, 10).cast("double") / 2**32
    drawn = classes.filter(lot < 2 * SAMPLE / total).orderBy(F.md5("key")).limit(SAMPLE).select("dim", "embedding").collect()
    by_dim: dict[int, list] = {}
    for row in drawn:
        by_dim.setdefault(row.dim, []).append(row.embedding)
    found = {}
    for dim, vectors in by_dim.items():
        units = np.array(vectors, np.float64)
        units = _units(units / np.abs(units).max(axis=1, keepdims=True))
        pivots = farthest_first(units, max(COPIES, min(SAMPLE, 2 * largest // CELL)))
        while len(pivots) > COPIES and cells_of(units, pivots, radius)[1].sum() > COPIES * len(units):
            pivots = pivots[: max(COPIES, len(pivots) // 2)]
        found[dim] = pivots
    return found


def place(classes: DataFrame, pivots: dict, radius: float) -> DataFrame:
    """``PLACED``: each vector in its home cell and in those it is copied to."""
    shared = classes.sparkSession.sparkContext.broadcast(pivots)  # SAMPLE vectors at most
    kept = ["key", "first_id", "copies", "label", "dim"]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                of_dim = batch.filter(pa.array(dims == dim))
                for i in range(0, of_dim.num_rows, ROWS):
                    own = of_dim.slice(i, ROWS)
                    vectors = _matrix(own.column("embedding"), dim)
                    near, inside = np.zeros(len(vectors), np.int64), np.ones((len(vectors), 1), bool)
                    if dim in shared.value:
                        near, inside = cells_of(_units(vectors), shared.value[dim], radius)
                    row, cell = np.nonzero(inside)
                    data, take = [v.tobytes() for v in vectors], pa.array(row)
                    made = [own.column(c).take(take) for c in kept]
                    made += [pa.array(cell.astype(np.int32)), pa.array(near[row] == cell), pa.array([data[i] for i in row], pa.binary())]
                    yield pa.RecordBatch.from_arrays(made, [*kept, "cell", "home", "vector"])

    return classes.select(*kept, "embedding").mapInArrow(put, PLACED)


def linked(home: np.ndarray, near: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of ``home`` and of ``near`` with at least that cosine, in strips of ``home``."""
    size, other = np.linalg.norm(home, axis=1), np.linalg.norm(near, axis=1)
    for i in range(0, len(home), ROWS):
        found = (home[i : i + ROWS] @ near.T) / (size[i : i + ROWS, None] * other)
        close = found >= cosine
        for a, b in zip(*np.nonzero(np.abs(found - cosine) < 1e-9), strict=True):
            close[a, b] = np.sum(home[i + a] * near[b]) / (size[i + a] * other[b]) >= cosine
        a, b = np.nonzero(close)
        yield a + i, b


def join_blocks(placed: DataFrame, cosine: float, space: Workspace) -> DataFrame:
    """key and first_id of a class, links (to other classes' vectors found in this block) and the smallest class it is connected
    with in this block (root_id, root), by block."""
    cell = [*GROUP, "cell"]
    sizes = placed.groupBy(cell).agg(F.count_if("home").alias("homes"), F.count("*").alias("all"))
    sizes = space.save(sizes.select(*cell, F.ceil(F.col("homes") / CELL).alias("rows"), F.ceil(F.col("all") / CELL).alias("columns")).filter("rows > 0"), "sizes")
    cut = placed.join(sizes, cell)
    row, column = F.pmod(F.xxhash64("key"), F.col("rows")), F.pmod(F.xxhash64("key"), F.col("columns"))
    as_home = cut.filter("home").withColumn("i", row).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("columns") - 1))).withColumn("side", F.lit(0))
    as_near = cut.withColumn("j", column).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1))).withColumn("side", F.lit(1))
    columns = [*cell, "i", "j", "side", "key", "first_id", "copies", "vector"]

    def block(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        side, names = table.column("side").to_numpy(), table.column("key").to_numpy().astype(str)
        first = table.column("first_id")
        none, first = first.is_null().to_numpy(), first.fill_null(0).to_numpy()
        order = np.lexsort((names, first, none))  # classes in the order in which they name a component
        new = np.r_[True, names[order][1:] != names[order][:-1]]
        at = np.empty(len(order), np.int64)
        at[order] = np.cumsum(new) - 1
        one = order[new]
        vectors = np.frombuffer(b"".join(table.column("vector").to_pylist()), np.float64).reshape(-1, dim)
        copies = table.column("copies").to_numpy()
        h, c = np.nonzero(side == 0)[0], np.nonzero(side == 1)[0]
        links, roots = np.zeros(len(one), np.int64), np.arange(len(one))
        for a, b in linked(vectors[h], vectors[c], cosine):
            a, b = h[a], c[b]
            other = at[a] != at[b]
            a, b = a[other], b[other]
            np.add.at(links, at[a], copies[b])
            merge(roots, at[a], at[b])
        told = np.nonzero((links > 0) | (roots != np.arange(len(one))))[0]
        rows, root = one[told], one[roots[told]]
        ids = table.column("first_id").combine_chunks()
        return pa.table({"key": pa.array(names[rows], pa.string()), "first_id": ids.take(pa.array(rows)), "links": links[told], "root": pa.array(names[root], pa.string()), "root_id": ids.take(pa.array(root))})

    return as_home.select(columns).union(as_near.select(columns)).groupBy(*cell, "i", "j").applyInArrow(block, "key string, first_id long, links long, root string, root_id long")


def near_vectors(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, embedding, label)."""
    space = Workspace(vectors.sparkSession, "vectors")
    rows, classes = classes_of(vectors.select("vec_id", "embedding", "label"), space)
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    placed = space.save(place(classes, pivots_of(classes, radius), radius), "placed")
    found = space.save(join_blocks(placed, cosine, space), "found")
    space.drop("placed", "sizes")
    # a node is a class in the order of its smallest vec_id, null last, so a root names its component
    node = lambda first, key: F.struct(F.col(first).isNull().alias("none"), F.col(first).alias("id"), F.col(key).alias("key"))
    roots = components(found.select(node("first_id", "key").alias("a"), node("root_id", "root").alias("b")), space)
    roots = roots.select(F.col("node.key").alias("key"), F.col("root.id").alias("root_id"))
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    told = classes.select("key", "first_id", "copies").join(links, "key", "left").join(roots, "key", "left")
    n_links = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    by_class = space.save(told.select("key", n_links, F.coalesce("root_id", "first_id").alias("component_id"), F.col("copies").alias("n")), "told")
    space.drop("found", "classes")
    known = attach(rows.filter("key is not null"), by_class.drop("n"), "key", by_class.select("key", "n")).select("vec_id", "n_links", "component_id")
    alone = rows.filter("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
