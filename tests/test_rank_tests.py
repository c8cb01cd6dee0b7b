import itertools
import math

import numpy as np
import pandas as pd
import pytest

from evidara.operators import resample


def test_exact_distribution_is_that_of_all_draws():
    for n, m in ((1, 1), (2, 5), (4, 4), (3, 6)):
        seen = np.zeros(n * m + 1)
        for drawn in itertools.combinations(range(n + m), n):
            seen[sum(drawn) - n * (n - 1) // 2] += 1
        assert np.allclose(resample.rank_counts(n, m), seen / seen.sum(), atol=1e-12)


def test_exact_p_by_permutation():
    x, y = [1.5, 2.5, 9.0, 7.0], [0.5, 2.0, 3.0, 1.0, 0.1]
    both, n = np.array(x + y), len(x)
    u = lambda pick: sum((a > b) + (a == b) / 2 for a in both[list(pick)] for b in np.delete(both, list(pick)))
    mine = u(range(n))
    every = [u(p) for p in itertools.combinations(range(len(both)), n)]
    far = max(mine, n * len(y) - mine)
    effect, p = resample.mann_whitney(np.array(x), np.array(y))
    assert effect == mine / 20 and p == pytest.approx(min(1.0, 2 * np.mean([v >= far for v in every])))


def test_normal_approximation_meets_the_exact_one():
    n, m = 60, 66  # 3,960 pairs
    u = 2300
    exact = resample.rank_test(2 * u, n, m, 0)[1]
    near = resample.rank_test(2 * u, n, m, 1e-9)[1]
    assert near == pytest.approx(exact, rel=0.02)
    assert resample.rank_test(0, 0, 5, 0) == (None, None) and resample.rank_test(25, 5, 5, 10**3 - 10)[1] == 1.0


def test_chi_square_tails():
    for x in (0.1, 1.0, 5.0, 30.0):
        assert resample.chi_square_tail(x, 2) == pytest.approx(math.exp(-x / 2))
        assert resample.chi_square_tail(x, 1) == pytest.approx(math.erfc(math.sqrt(x / 2)))
        assert resample.chi_square_tail(x, 4) == pytest.approx(math.exp(-x / 2) * (1 + x / 2))
    assert resample.chi_square_tail(0.0, 3) == 1.0


def test_sums_in_ranges_are_those_in_memory(spark, monkeypatch):
    from evidara.operators import ranking

    monkeypatch.setattr(ranking, "ROWS", 40)
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"y": rng.integers(0, 2, 600), "a": rng.normal(size=600), "b": rng.integers(0, 9, 600).astype(float), "flag": rng.integers(0, 2, 600).astype(float), "kind": rng.choice(list("pqr"), 600)})
    pdf.loc[::7, "a"] = np.nan
    pdf["name"] = np.where(pdf.index < 3, "rare", pdf.kind)
    frame = spark.createDataFrame(pdf)
    got = {r.covariate: r for r in resample.covariate_tests(frame, "y", ["a", "b", "flag"], nominal=["name"]).collect()}
    for c in ("a", "b"):
        part = pdf.dropna(subset=[c])
        effect, p = resample.mann_whitney(part[part.y == 1][c].to_numpy(), part[part.y == 0][c].to_numpy())
        assert (got[c].test, got[c].n) == ("ranks", len(part)) and got[c].effect == pytest.approx(effect) and got[c].p == pytest.approx(p)
    on = pdf[pdf.y == 1].flag
    off = pdf[pdf.y == 0].flag
    assert got["flag"].p == pytest.approx(resample.fisher_exact(int(on.sum()), int((1 - on).sum()), int(off.sum()), int((1 - off).sum())))
    table = pd.crosstab(pdf.name, pdf.y).to_numpy()
    expected = table.sum(axis=1, keepdims=True) * table.sum(axis=0) / table.sum()
    chi2 = ((table - expected) ** 2 / expected).sum()
    assert got["name"].n == 600 and got["name"].p == pytest.approx(resample.chi_square_tail(chi2, 3)) and got["name"].effect == pytest.approx(math.sqrt(chi2 / 600))
    two = resample.level_counts(frame.filter("kind != 'r'"), "y", ["kind"]).first()  # Yates' correction
    table = pd.crosstab(pdf[pdf.kind != "r"].kind, pdf.y).to_numpy()
    expected = table.sum(axis=1, keepdims=True) * table.sum(axis=0) / table.sum()
    assert two.levels == 2 and two.chi2 == pytest.approx((np.maximum(np.abs(table - expected) - 0.5, 0) ** 2 / expected).sum())
    assert [r.levels for r in resample.level_counts(frame, "y", ["name"], least=5).collect()] == [3]
    assert sorted(r.q for r in got.values()) == pytest.approx(sorted(min(min(s.p * 4 / rank for rank, s in enumerate(sorted(got.values(), key=lambda v: v.p), 1) if s.p >= r.p), 1.0) for r in got.values()))


def test_empty_and_constant_covariates(spark):
    rows = spark.createDataFrame([(1, None, 3.0, "x"), (0, None, 3.0, "x"), (0, None, 3.0, "x")], "y int, none double, same double, level string")
    got = {r.covariate: r for r in resample.covariate_tests(rows, "y", ["none", "same"], nominal=["level"]).collect()}
    assert got["same"].p == 1.0 and got["same"].effect == 0.5 and "none" not in got
    assert got["level"].p is None and got["level"].n == 3
