import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from evidara.operators import models, validate


def test_leave_one_group_out(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"gene": np.repeat(["A", "B"], 80), "key": range(160), "y": rng.integers(0, 2, 160).astype(float)})
    pdf["x"], pdf["noise"] = pdf.y * 2 + rng.normal(size=160), rng.normal(size=160)
    pdf.loc[3, "x"] = np.nan
    rows = validate.no_nan(spark.createDataFrame(pdf)).withColumns({"train_label": F.col("y"), "test_label": F.col("y")})
    cell = models.Cell("logistic", ("b", "a"), seed=1, dropped=("noise",))
    assert cell.name == "train-a+b__drop-noise__logistic__seed1"
    made = models.sweep(rows, ["x", "noise"], [cell], {"noise": ["noise"]})
    assert made.count() == 160 and {r.fold for r in made.select("fold").distinct().collect()} == {"A", "B"}
    auc = {r.gene: r.auc for r in models.cell_reports(made, 0.5, "key").collect()}
    assert all(v > 0.8 for v in auc.values())
    seen = models.consensus(made.withColumn("threshold", F.lit(0.5)).withColumn("variant_key", F.col("key")))
    assert seen.count() == 160 and seen.filter("verdict = 'always_right'").count() > 110


def test_family_columns():
    assert validate.family_of("feature_gnomad_log10_af") == "frequency" and validate.family_of("plddt") == "structure"
    assert validate.without_families(["gnomad_af", "plddt"], ["frequency"]) == ["plddt"]
    for bad in (lambda: validate.without_families(["x"], ["label"], {"x": "label"}), lambda: validate.check_forbidden(["my_label"]), lambda: validate.align_columns(["a"], ["b"])):
        try:
            bad()
        except ValueError:
            continue
        raise AssertionError
