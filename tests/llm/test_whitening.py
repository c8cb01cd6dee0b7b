import math
from fractions import Fraction

import numpy as np
import pytest

from evidara.llm import queries, whitening
from tests.llm.helpers import write_tables

SCHEMA = "vec_id long, embedding array<double>, label int, n long, component string"


def table(spark, vectors, first=0, schema=SCHEMA):
    return spark.createDataFrame([(first + i, v, 1, 3, "x") for i, v in enumerate(vectors)], schema)


def brute(vectors):
    """n, deviations, eigenvalues, whitened up to sign and shares, in exact fractions as far as numbers go."""
    x = [[math.floor(1024 * c) + 100000 for c in v] for v in vectors]
    n, dim = len(x), len(x[0])
    total = [sum(r[d] for r in x) for d in range(dim)]
    deviation = [sum((n * r[d] - total[d]) ** 2 for d in range(dim)) for r in x]
    away = [[Fraction(n * r[d] - total[d], n) for d in range(dim)] for r in x]
    cov = np.array([[float(sum(a[i] * a[j] for a in away) / n) for j in range(dim)] for i in range(dim)])
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:8], axes[:, ::-1][:, :8]
    return n, deviation, values, (np.array(away, float) @ axes) / np.sqrt(values), values / np.trace(cov)


def vectors(n=150, dim=11, seed=1):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, dim)) @ rng.normal(size=(dim, dim)) / 3 + rng.normal(size=dim)).tolist()


def check(spark, rows):
    got = {(r.vec_id, r.component): r for r in whitening.whiten(table(spark, rows).repartition(5)).collect()}
    n, deviation, values, whitened, explained = brute(rows)
    count = len(values)
    assert len(got) == n * count
    for c in range(count):
        mine = np.array([got[i, c + 1].whitened for i in range(n)])
        sign = np.sign(mine @ whitened[:, c])
        assert np.allclose(mine, sign * whitened[:, c], atol=1e-8)
        assert all(math.isclose(got[i, c + 1].explained, explained[c], rel_tol=1e-9) for i in range(n))
    for i in range(n):
        assert int(got[i, 1].deviation) == deviation[i] and got[i, 1].n == n and got[i, 1].identity_error < 1e-8


def test_against_fractions(spark):
    check(spark, vectors())
    check(spark, vectors(60, 3, 2))


def test_large_entries_stay_exact(spark):
    rng = np.random.default_rng(7)
    check(spark, (rng.normal(size=(40, 4)) * 1e11).tolist())  # sums of squares beyond a long
    x = np.array([[1 << 51, -(1 << 51)], [3, 5]])
    n, total = 1 << 10, [(1 << 51) * 7, 9]
    assert whitening.centred(x, n, total).tolist() == [[n * a - b for a, b in zip(r, total, strict=True)] for r in x.tolist()]
    assert whitening.deviations(x, {"n": n, "sums": total}) == [sum((n * a - b) ** 2 for a, b in zip(r, total, strict=True)) for r in x.tolist()]


def test_odd_vectors(spark):
    rows = [*vectors(50, 4), None, [], [math.nan, 0.0, 0.0, 0.0], [math.inf, 0.0, 0.0, 0.0], [None, 0.0, 0.0, 0.0], [1e300, 0.0, 0.0, 0.0], [1e13, 0.0, 0.0, 0.0]]
    got = whitening.whiten(table(spark, rows)).collect()
    assert sorted({r.vec_id for r in got}) == list(range(50)) and {r.n for r in got} == {50}
    assert whitening.whiten(table(spark, [])).count() == 0
    twice = whitening.whiten(table(spark, rows).union(table(spark, rows))).collect()
    assert len(twice) == 400 and {r.n for r in twice} == {100}
    null_id = table(spark, vectors(9, 2)).selectExpr("cast(null as bigint) vec_id", "embedding")
    assert len([r for r in whitening.whiten(null_id).collect() if r.vec_id is None]) == 18


def test_lengths_apart_and_no_variance(spark):
    rows = [*vectors(30, 4), *vectors(20, 3, 5), [7.0, 8.0]]
    got = whitening.whiten(table(spark, rows)).collect()
    assert {(r.n, r.component) for r in got} == {(30, c) for c in range(1, 5)} | {(20, c) for c in range(1, 4)} | {(1, 1), (1, 2)}
    one = [r for r in got if r.n == 1]
    assert all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in one)
    flat = [[a, b, 0.25, a] for a, b in vectors(40, 2)]  # rank 2
    got = whitening.whiten(table(spark, flat)).collect()
    assert {r.component for r in got if r.whitened is None} == {3, 4} and all(r.explained == 0 for r in got if r.component > 2)
    assert max(r.identity_error for r in got) < 1e-9


def test_query(spark, tmp_path):
    rows = vectors(70, 12, 9)
    docs = spark.createDataFrame([(1, "t", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    sf = write_tables(spark, tmp_path / "sf", docs, embeddings=[(i, [float(np.float32(c)) for c in v], i % 3) for i, v in enumerate(rows)])
    got = queries.op13_embedding_whitening(spark, sf)
    assert dict(got.dtypes)["deviation"] == "bigint" and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    found = got.collect()
    _, deviation, *_ = brute([[float(np.float32(c)) for c in v] for v in rows])
    assert len(found) == 560 and all(r.deviation == deviation[r.vec_id] for r in found)
    w = np.zeros((70, 8))
    for r in found:
        w[r.vec_id, r.component - 1] = r.whitened
    error = np.abs(np.cov(w.T, bias=True) - np.eye(8)).max()
    assert error < 1e-4 and found[0].identity_error == pytest.approx(error, abs=1e-9)
