"""Isotonic calibration by ranges against the min-max formula."""

import numpy as np
import pandas as pd
import pytest

from evidara.operators import ranking, resample

SCHEMA = "cell string, label int, score double"


def plain(y, s):
    """Means of the tied scores, then the largest, over starts, of the least mean up to an end."""
    xs = np.unique(s)
    total, weight = np.array([y[s == x].sum() for x in xs]), np.array([(s == x).sum() for x in xs])
    mean = lambda a, b: total[a : b + 1].sum() / weight[a : b + 1].sum()
    return xs, np.array([max(min(mean(a, b) for b in range(i, len(xs))) for a in range(i + 1)) for i in range(len(xs))])


@pytest.mark.parametrize("size", [250_000, 7])
def test_against_the_formula(spark, monkeypatch, size):
    monkeypatch.setattr(ranking, "ROWS", size)
    rng = np.random.default_rng(8)
    n = 150
    pdf = pd.DataFrame({"cell": rng.choice(["a", "b"], n, p=[0.8, 0.2]), "score": np.round(rng.random(n), 2)})
    pdf["label"] = (rng.random(n) < pdf.score**2).astype(int)
    make = lambda d: spark.createDataFrame(d[["cell", "label", "score"]].values.tolist(), SCHEMA).repartition(3)
    asked = [(c, 0, float(x)) for c in ("a", "b") for x in np.linspace(-0.1, 1.1, 61)]
    got = resample.calibrate(make(pdf), spark.createDataFrame(asked, SCHEMA), "cell", "label", "score", "isotonic").collect()
    assert len(got) == len(asked)
    fits = {c: plain(part.label.to_numpy(), part.score.to_numpy()) for c, part in pdf.groupby("cell")}
    for r in got:
        assert r.calibrated == pytest.approx(np.interp(r.score, *fits[r.cell]), abs=1e-12)


def test_odd_rows(spark):
    make = lambda rows: spark.createDataFrame(rows, SCHEMA)
    fit = make([("a", 0, 0.1), ("a", 1, 0.9), ("a", None, 0.5), ("a", 1, None), ("a", 0, float("nan")), ("one", 1, 0.3), (None, 0, 0.2), (None, 1, 0.7)])
    asked = make([("a", None, 0.5), ("a", 0, None), ("one", 0, 0.4), ("new", 0, 0.6), (None, 0, 0.25)])
    got = {(r.cell, r.score): r.calibrated for r in resample.calibrate(fit, asked, "cell", "label", "score", "isotonic").collect()}
    assert got == {("a", 0.5): pytest.approx(0.5), ("a", None): None, ("one", 0.4): 0.4, ("new", 0.6): 0.6, (None, 0.25): 0.25}
    assert resample.calibrate(fit.filter("false"), asked, "cell", "label", "score", "isotonic").filter("calibrated <=> score").count() == 5
    assert resample.isotonic_pools(make([(None, 0, 0.2), (None, 1, 0.7)]), "cell", "label", "score").first().xs == [0.2, 0.2, 0.7, 0.7]
