"""Ridge by folds against a solution row by row."""

import numpy as np
import pandas as pd
import pytest

from evidara.operators import ridge

ALPHAS = [0.01, 1.0, 100.0]


def plain(pdf, features):
    """Predictions and penalties: every leave-one-out model is fitted by itself."""
    fit = lambda x, y, a: np.linalg.solve((x - x.mean(0)).T @ (x - x.mean(0)) + a * np.eye(x.shape[1]), (x - x.mean(0)).T @ (y - y.mean()))
    out = {}
    for _, part in pdf.groupby("assay", dropna=False):
        ok = part[[*features, "y"]].notna().all(axis=1) & part.fold.notna()
        for f in part.fold.dropna().unique():
            train = part[ok & (part.fold != f)]
            x, y = train[features].to_numpy(float), train.y.to_numpy(float)
            if len(x) < 3:
                continue
            errors = []
            for a in ALPHAS:
                left = [np.delete(np.arange(len(x)), i) for i in range(len(x))]
                errors.append(np.mean([(y[i] - y[k].mean() - (x[i] - x[k].mean(0)) @ fit(x[k], y[k], a)) ** 2 for i, k in enumerate(left)]))
            a = ALPHAS[int(np.argmin(errors))]
            test = part[part.fold == f].dropna(subset=features)
            for i, v in zip(test["id"], (test[features].to_numpy(float) - x.mean(0)) @ fit(x, y, a) + y.mean(), strict=True):
                out[i] = (v, a)
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    n = 260
    pdf = pd.DataFrame({"id": range(n), "assay": rng.choice(["a", "b", "c"], n, p=[0.7, 0.25, 0.05]), "fold": rng.integers(0, 4, n).astype(float)})
    for i in range(5):
        pdf[f"x{i}"] = rng.normal(size=n) * 10**i + 1000
    pdf["x5"] = pdf.x0  # collinear
    pdf["y"] = pdf.x0 + pdf.x1 / 10 + rng.normal(size=n) * np.where(pdf.assay == "a", 1, 5) + 1e4
    pdf.loc[3, "y"] = pdf.loc[7, "x2"] = pdf.loc[11, "fold"] = np.nan
    pdf.loc[20:23, "assay"] = None
    pdf.loc[len(pdf)] = [n, "only", 0.0, *([1.0] * 6), 2.0]
    return pdf


def frame(spark, pdf):
    clean = pdf.astype(object).where(pdf.notna(), None)
    return spark.createDataFrame(clean.values.tolist(), "id long, assay string, fold double, x0 double, x1 double, x2 double, x3 double, x4 double, x5 double, y double").repartition(5)


def test_against_single_fits(spark, rows, monkeypatch):
    monkeypatch.setattr(ridge, "BLOCK", 37)
    features = [f"x{i}" for i in range(6)]
    want = plain(rows, features)
    got = {r["id"]: r for r in ridge.out_of_fold_ridge(frame(spark, rows), "assay", features, "y", "fold", ALPHAS).collect()}
    assert len(got) == len(rows) and {i for i, r in got.items() if r["predicted"] is not None} == set(want)
    assert len({a for _, a in want.values()}) > 1
    for i, (v, a) in want.items():
        assert got[i]["predicted"] == pytest.approx(v, rel=1e-7) and got[i]["alpha"] == a
    assert got[3]["predicted"] is not None and got[3]["y"] is None  # no target: predicted all the same
    assert got[7]["predicted"] is None and got[11]["predicted"] is None and got[260]["predicted"] is None


def test_columns_pass_untouched_and_empty_tables(spark):
    rows = spark.sql("select id, 'a' as assay, cast(id % 3 as int) as fold, cast(id as decimal(20, 3)) as x, id * 2.0D + 1 as y, timestamp'2020-01-01' as t, array(id, null) as l from range(40)")
    done = ridge.out_of_fold_ridge(rows, "assay", ["x"], "y", "fold", [1e-9])
    assert done.columns == [*rows.columns, "predicted", "alpha"] and [f.dataType for f in done.schema][: len(rows.columns)] == [f.dataType for f in rows.schema]
    for r in done.collect():
        assert r.predicted == pytest.approx(r.y, abs=1e-6) and r.l == [r.id, None] and r.x == r.id
    assert ridge.out_of_fold_ridge(rows.filter("false"), "assay", ["x"], "y", "fold").count() == 0


def test_repeated_rows_and_one_hot_assay(spark, monkeypatch):
    monkeypatch.setattr(ridge, "BLOCK", 50)
    rows = spark.sql("select 'a' as assay, cast(id % 2 as int) as fold, 1.0D as x, 3.0D as y from range(500)")
    done = ridge.out_of_fold_ridge(rows, "assay", ["x"], "y", "fold").collect()
    assert len(done) == 500 and all(r.predicted == pytest.approx(3) for r in done)


def test_published_and_arms(spark, rows):
    ours = spark.createDataFrame([("a", 0.5), ("b", 0.4), ("c", 0.1), ("d", None)], "assay string, spearman double")
    told = ridge.against_published(ours, spark.createDataFrame([("a", 0.49), ("b", 0.37), ("c", 0.3)], "assay string, published double"), "assay").first()
    assert (told.assays, told.compared, told.within_002, told.within_005) == (4, 3, pytest.approx(1 / 3), pytest.approx(2 / 3))
    assert told.rank_correlation == pytest.approx(1) and told.pearson == pytest.approx(np.corrcoef([0.5, 0.4, 0.1], [0.49, 0.37, 0.3])[0, 1]) and told.median_diff == pytest.approx(0.01)
    few = ridge.against_published(ours.limit(2), ours.limit(2).withColumnRenamed("spearman", "published"), "assay").first()
    assert few.pearson is None and few.rank_correlation is None
    table = ridge.individual_and_combined(frame(spark, rows).filter("assay is not null"), "assay", ["x0", "x1", "x2"], "y", "fold", "fold", ALPHAS)
    found = {r.assay: r for r in table.collect()}
    assert set(found) == {"a", "b", "c", "only"} and found["a"].individual > 0.5 and found["only"].individual is None and found["a"].gain == pytest.approx(found["a"].combined - found["a"].individual)


def test_rows_are_not_written_or_dealt(spark, monkeypatch):
    held, write = [], ridge._shared
    monkeypatch.setattr(ridge, "_shared", lambda df: held.append(write(df)) or held[-1])
    rows = spark.sql("select id, cast(id % 3 as int) as fold, if(id % 2 = 0, 'a', 'b') as assay, id * 1.0D as x, id * 3.0D as y from range(600)")
    done = ridge.out_of_fold_ridge(rows, "assay", ["x"], "y", "fold", [1e-9])
    assert max(h.count() for h in held) <= 6 and all(r.predicted == pytest.approx(r.y, abs=1e-5) for r in done.collect())


def test_many_models_meet_blocks(spark, rows, monkeypatch):
    features = [f"x{i}" for i in range(6)]
    ask = lambda: {r["id"]: (r["predicted"], r["alpha"]) for r in ridge.out_of_fold_ridge(frame(spark, rows), "assay", features, "y", "fold", ALPHAS).collect()}
    want = ask()
    monkeypatch.setattr(ridge, "SENT", 0)
    monkeypatch.setattr(ridge, "BLOCK", 37)
    got = ask()
    assert set(got) == set(want) and all(got[i][1] == want[i][1] and got[i][0] == (v if v is None else pytest.approx(v, rel=1e-9)) for i, (v, _) in want.items())
