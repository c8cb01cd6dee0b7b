import math

import numpy as np
from pyspark.sql import functions as F

from evidara.llm import negatives, queries
from tests.llm.helpers import write_tables

SCHEMA = "vec_id long, embedding array<double>, label string, row long, grp string, norm string"


def divisible():
    return F.col("vec_id") % 4 == 0


def brute(rows, positives=5, count=5, low=80, is_anchor=lambda i: i is not None and i % 4 == 0):
    held = []
    for i, v, label in rows:
        if label is None or v is None or not all(c is not None and math.isfinite(c) for c in v):
            continue
        x = [math.floor(256 * c) for c in v]
        if sum(c * c for c in x) < 1 << 60:
            held.append((i, x, label))
    out = []
    order = lambda p: (-p[1], p[0] is None, p[0] or 0)
    for i, x, label in held:
        if not is_anchor(i):
            continue
        scored = [(j, sum(a * b for a, b in zip(x, y, strict=True)), other == label) for j, y, other in held if j != i and len(x) == len(y)]
        best = sorted((p for p in scored if p[2]), key=order)[:positives]
        for place, (p, top, _) in enumerate(best):
            hard = sorted((h for h in scored if not h[2] and low * top <= 100 * h[1] <= 100 * top), key=order)[:count]
            out += [(i, p, place + 1, n + 1, h, top, score) for n, (h, score, _) in enumerate(hard)]
    return sorted(out, key=repr)


def check(spark, rows, **more):
    frame = spark.createDataFrame([(i, v, label, 1, "g", "n") for i, v, label in rows], SCHEMA)
    got = sorted(map(tuple, negatives.hard_negatives(frame, divisible(), **more).collect()), key=repr)
    assert got == brute(rows, more.get("positives", 5), more.get("negatives", 5), more.get("low", 80))
    return got


def clusters(n, dim, seed, groups=6, labels=4, spread=0.1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim)) * rng.uniform(0.5, 2, size=(groups, 1))
    return [(i, (centres[i % groups] + rng.normal(size=dim) * spread).tolist(), f"l{rng.integers(labels)}") for i in range(n)]


def test_against_all_pairs(spark):
    assert len(check(spark, clusters(240, 8, 1))) > 500
    check(spark, clusters(150, 3, 2), positives=3, negatives=2, low=50)


def test_groups_prune_and_blocks_agree(spark, monkeypatch):
    for name, value in (("CELL", 20), ("ANCHORS", 8), ("MANY", 12)):
        monkeypatch.setattr(negatives, name, value)
    rows = clusters(400, 6, 3, groups=8, spread=0.02)
    frame = spark.createDataFrame([(i, v, label, 1, "g", "n") for i, v, label in rows], SCHEMA)
    sides = []
    plain = negatives.reached
    monkeypatch.setattr(negatives, "reached", lambda *a: sides.append(plain(*a)) or sides[-1])
    got = sorted(map(tuple, negatives.hard_negatives(frame, divisible()).collect()), key=repr)
    assert got == brute(rows)
    assert len(sides) == 2
    for chosen in sides:  # several groups, and many a cell is out of a group's reach
        count, low, high = chosen[6]
        assert count > 1 and (low > high).mean() > 0.3


def test_intervals_hold_what_they_promise():
    rng = np.random.default_rng(11)
    x = np.floor(256 * np.repeat(rng.normal(size=(40, 5)), 10, axis=0) + 20 * rng.normal(size=(400, 5))).astype(np.int32)
    v = negatives.Voronoi.__new__(negatives.Voronoi)
    v.most = float(np.sqrt((x.astype(float) ** 2).sum(axis=1)).max())
    v.pivots = {5: negatives.farthest_first(negatives.on_sphere(x, v.most), 24)}
    cell, angle = v.placed(x, 5)
    score = negatives.scores(x, x)
    least = np.partition(score, -20, axis=1)[:, -20]
    most = np.partition(score, -3, axis=1)[:, -3]
    _, low, high = v.intervals(x, 5, least.astype(float), most.astype(float))
    serves = (score >= least[:, None]) & (score <= most[:, None])
    inside = (low[:, cell] <= angle) & (angle <= high[:, cell])
    assert inside[serves].all() and inside.mean() < 0.6


def test_first_few_breaks_ties_by_column():
    score = np.array([[3, 5, 5, 1, 5], [0, 0, 0, 0, 0], [9, 8, 7, 6, 5]])
    allowed = np.array([[1, 1, 1, 1, 1], [0, 1, 0, 1, 1], [0, 0, 0, 0, 0]], bool)
    row, column = negatives.first_few(score, allowed, 2)
    assert list(zip(row.tolist(), column.tolist(), strict=True)) == [(0, 1), (0, 2), (1, 1), (1, 3)]
    tops = np.array([0, 1, 99, 100, 101, (1 << 60) - 1])
    assert negatives.least_of(tops, 80).tolist() == [-(-80 * int(t) // 100) for t in tops]
    big = np.array([[1 << 29, -(1 << 29), 7]], np.int32)
    assert negatives.scores(big, big).tolist() == [[(1 << 59) + 49]]


def test_rare_labels_join_by_label(spark):
    rows = clusters(120, 4, 5, labels=60)
    check(spark, rows)
    check(spark, [(4, [1.0, 0.0], "a"), (5, [1.0, 0.1], "a"), (6, [0.9, 0.1], "b")])


def test_odd_rows(spark):
    e = [1.0, 0.5]
    rows = [(i, [1.0, i / 40], "ab"[i % 2]) for i in range(24)]
    rows += [(24, None, "a"), (28, e, None), (32, [math.nan, 1.0], "a"), (36, [math.inf, 1.0], "a"), (40, [None, 1.0], "a"), (44, [], "a"), (48, [], "a"), (49, [], "b"), (None, e, "a"), (None, e, "b"), (52, [1.0, 2.0, 3.0], "a"), (53, [1.0, 2.0, 3.0], "a"), (54, [1.0, 2.0, 3.0], "b")]
    rows += [(4, [1.0, 0.1], "a"), (7, [1.0, 7 / 40], "b"), (7, [1.0, 7 / 40], "b"), (56, [0.0, 0.0], "a"), (60, [-1.0, -0.5], "a"), (61, [1e7, 0.0], "b"), (64, [1e200, 0.0], "a")]
    check(spark, rows)
    assert negatives.hard_negatives(spark.createDataFrame([], SCHEMA), divisible()).count() == 0
    assert negatives.hard_negatives(spark.createDataFrame([(1, e, "a", 1, "", "")], SCHEMA), divisible()).count() == 0


def test_one_vector_and_one_label_hold_most_rows(spark, monkeypatch):
    from evidara.operators import skew

    for module, name, value in ((skew, "LEAST", 3), (skew, "SHARE", 50), (negatives, "CELL", 16), (negatives, "ANCHORS", 4)):
        monkeypatch.setattr(module, name, value)
    rows = [(i, [0.5, 0.25, 1.0] if i % 3 else [0.5, i / 100, 0.9], "hot" if i % 5 else f"l{i % 2}") for i in range(130)]
    check(spark, rows)


def test_query(spark, tmp_path):
    docs = spark.createDataFrame([(1, "t", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=6) * 0.2 + 0.2], int(rng.integers(10))) for i in range(420)]
    sf = write_tables(spark, tmp_path / "sf", docs, embeddings=rows)
    got = queries.op11_hard_negatives(spark, sf)
    changed = [(i, v, (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in rows]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(changed, is_anchor=lambda i: i % 100 == 0)
    assert dict(got.dtypes)["rank"] == "int"
