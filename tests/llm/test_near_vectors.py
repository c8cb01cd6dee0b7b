import math

import numpy as np

from evidara.llm import near_vectors
from tests.llm.helpers import components

SCHEMA = "vec_id long, embedding array<float>, label int, key string, copies long"


def rows_of(n, dim, seed, labels=2, groups=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    out = []
    for i in range(n):
        v = centres[i % groups] + rng.normal(size=dim) * (0.02 if i % 3 else 0.3)
        out.append((i, [float(x) for x in v.astype(np.float32)], int(i % groups % labels), "k", 7))
    out += [(n + i, out[0][1], out[0][2], "k", 7) for i in range(20)]
    return out


def brute(rows, cosine=0.98):
    pairs = []
    for i, (_, a, la, *_) in enumerate(rows):
        for j in range(i):
            _, b, lb, *_ = rows[j]
            good = lambda v: v and all(x is not None and math.isfinite(x) for x in v) and any(v)
            if la is None or la != lb or not good(a) or not good(b) or len(a) != len(b):
                continue
            x, y = (np.array(v, float) / max(map(abs, v)) for v in (a, b))
            if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= cosine:
                pairs.append((j, i))
    links = [0] * len(rows)
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    ids = [r[0] for r in rows]
    root = components(len(rows), pairs)
    least = {}
    for i, r in enumerate(root):
        if ids[i] is not None:
            least[r] = min(least.get(r, ids[i]), ids[i])
    return sorted(((ids[i], links[i], least.get(root[i]), ids[i] is not None and ids[i] == least.get(root[i])) for i in range(len(rows))), key=repr)


def check(spark, rows):
    got = near_vectors.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute(rows), key=repr)


def test_against_all_pairs(spark):
    check(spark, rows_of(200, 8, 1))


def test_pivots_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "CELL", 24)
    rows = rows_of(260, 6, 2, labels=1)
    frame = spark.createDataFrame(rows, SCHEMA)
    classes = near_vectors.classes_of(frame, near_vectors.Workspace(spark, "t"))[1]
    assert len(near_vectors.pivots_of(classes, 0.2)[6]) > near_vectors.COPIES
    check(spark, rows)


def test_odd_vectors(spark):
    e = [1.0, 0.0]
    rows = [(0, e, 1, "k", 1), (1, [2.0, 0.0], 1, "k", 1), (2, e, None, "k", 1), (3, None, 1, "k", 1), (4, [], 1, "k", 1), (5, [0.0, 0.0], 1, "k", 1), (6, [math.nan, 1.0], 1, "k", 1), (7, [math.inf, 1.0], 1, "k", 1), (8, [None, 1.0], 1, "k", 1), (9, [1.0, 0.0, 0.0], 1, "k", 1), (1, [2.0, 0.0], 1, "k", 1), (10, e, 2, "k", 1)]
    check(spark, rows)
    assert near_vectors.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pivots_at_every_size_and_bounds(spark):
    rng = np.random.default_rng(5)
    for n, dim in ((5, 3), (300, 6), (300, 48)):
        vectors = rng.normal(size=(n, dim))
        rows = [(i, [float(x) for x in v], 1, "k", 1) for i, v in enumerate(vectors)]
        classes = near_vectors.classes_of(spark.createDataFrame(rows, SCHEMA), near_vectors.Workspace(spark, "t"))[1]
        assert len(near_vectors.pivots_of(classes, 0.2)[dim]) == near_vectors.COPIES
    # whatever is within the radius shares the other's home cell
    units = near_vectors._units(np.repeat(rng.normal(size=(60, 5)), 8, axis=0) + rng.normal(size=(480, 5)) * 0.05)
    pivots = near_vectors.farthest_first(units, 40)
    near, inside = near_vectors.cells_of(units, pivots, 0.2)
    close = np.sqrt(np.maximum(2 - 2 * units @ units.T, 0)) <= 0.2
    a, b = np.nonzero(close)
    assert inside[b, near[a]].all() and inside.sum() < 0.8 * inside.size


def test_labels_of_other_types_and_magnitudes(spark):
    e = [(0, [1e-200, 2e-200], "x y", 1), (1, [1e200, 2e200], "x y", 1), (2, [1.0, 2.0], "x", 1), (None, [3.0, 6.0], "x y", 1), (4, [5e-324, 0.0], "x", 1), (5, [1.7e308, 1e300], "x", 1)]
    frame = spark.createDataFrame(e, "vec_id long, embedding array<double>, label string, node int")
    assert sorted(map(tuple, near_vectors.near_vectors(frame).collect()), key=repr) == sorted(brute(e), key=repr)
    longs = spark.createDataFrame([(1, [1.0], 1 << 40), (2, [2.0], 1 << 40), (3, [1.0], (1 << 40) + (1 << 32))], "vec_id long, embedding array<double>, label long")
    assert sorted(map(tuple, near_vectors.near_vectors(longs).collect())) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_hot_keys_are_dealt(spark, monkeypatch):
    from evidara.operators import skew

    monkeypatch.setattr(skew, "LEAST", 3)
    monkeypatch.setattr(skew, "SHARE", 50)
    check(spark, rows_of(120, 4, 3))
