"""Model arms over MLlib, evaluated leave-one-group-out, with a contract of fit and score."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import HashingTF, IDF, Imputer, NGram, RegexTokenizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.operators.metrics import report


def tabular(columns: Sequence[str], classifier) -> Pipeline:
    """Median-imputed, scaled columns into a classifier."""
    filled = [f"{c}__filled" for c in columns]
    return Pipeline(stages=[
        Imputer(strategy="median", inputCols=list(columns), outputCols=filled), VectorAssembler(inputCols=filled, outputCol="__raw", handleInvalid="error"),
        StandardScaler(inputCol="__raw", outputCol="features", withMean=True), classifier,
    ])


def logistic(columns: Sequence[str], seed: int = 0) -> Pipeline:
    return tabular(columns, LogisticRegression(labelCol="label", regParam=0.01))


def boosted(columns: Sequence[str], seed: int = 0, rounds: int = 30) -> Pipeline:
    return tabular(columns, GBTClassifier(labelCol="label", maxIter=rounds, maxDepth=4, seed=seed, subsamplingRate=0.8))


def perceptron(columns: Sequence[str], seed: int = 0) -> Pipeline:
    return tabular(columns, MultilayerPerceptronClassifier(labelCol="label", layers=[len(columns), 32, 2], seed=seed, maxIter=100))


def text_linear(text: str = "text", size: int = 1 << 16) -> Pipeline:
    """Hashed TF-IDF over words and word pairs into a linear classifier."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="__w", pattern=r"[^\p{L}\p{N}_>.:-]+"), NGram(n=2, inputCol="__w", outputCol="__b"),
        HashingTF(inputCol="__w", outputCol="__tw", numFeatures=size), HashingTF(inputCol="__b", outputCol="__tb", numFeatures=size),
        IDF(inputCol="__tw", outputCol="__iw"), IDF(inputCol="__tb", outputCol="__ib"), VectorAssembler(inputCols=["__iw", "__ib"], outputCol="features"),
        LogisticRegression(labelCol="label", regParam=0.01),
    ])


def one_hot_ridge(rows: DataFrame, substitutions: str, target: str, penalty: float = 1.0):
    """Linear regression over hashed (position, residue) terms of an array of substitutions."""
    made = HashingTF(inputCol=substitutions, outputCol="features", numFeatures=1 << 14).transform(rows)
    return LinearRegression(labelCol=target, regParam=penalty, elasticNetParam=0.0, solver="l-bfgs").fit(made), made


ARMS: dict[str, Callable] = {"logistic": logistic, "boosted": boosted, "perceptron": perceptron}


def scored(model, rows: DataFrame) -> DataFrame:
    """Rows with ``score``, the probability of label 1."""
    keep = rows.columns
    return model.transform(rows).withColumn("score", vector_to_array("probability")[1]).select(*keep, "score")


@dataclass(frozen=True)
class Cell:
    """What one evaluation run is of."""

    model: str
    train_sources: tuple[str, ...]
    seed: int = 0
    dropped: tuple[str, ...] = field(default_factory=tuple)

    @property
    def name(self) -> str:
        parts = ["train-" + "+".join(sorted(self.train_sources)), *(["drop-" + "-".join(sorted(self.dropped))] if self.dropped else [])]
        return f"{'__'.join(parts)}__{self.model}__seed{self.seed}"


def leave_one_group_out(rows: DataFrame, columns: Sequence[str], cell: Cell, group: str = "gene", train_label: str = "train_label", test_label: str = "test_label", cluster: str | None = None) -> DataFrame:
    """Predictions of every group by a model of the others (cell, group, key columns, label, score). The loop is over groups, a
    handful by contract; rows stay in Spark."""
    from evidara.operators.splits import purge

    groups = [r[0] for r in rows.filter(F.col(test_label).isNotNull()).select(group).distinct().orderBy(group).collect()]
    out = None
    for g in groups:
        train = rows.filter((F.col(group) != g) & F.col(train_label).isNotNull())
        test = rows.filter((F.col(group) == g) & F.col(test_label).isNotNull())
        if cluster:
            train = purge(train, test, cluster)
        model = ARMS[cell.model](columns, cell.seed).fit(train.withColumn("label", F.col(train_label).cast("double")))
        part = scored(model, test.withColumn("label", F.col(test_label).cast("double"))).withColumns({"cell": F.lit(cell.name), "fold": F.lit(str(g))})
        out = part if out is None else out.unionByName(part)
    return out


def sweep(rows: DataFrame, columns: Sequence[str], cells: Sequence[Cell], families: Mapping[str, Sequence[str]], **options) -> DataFrame:
    """All cells, each without the columns of its dropped families."""
    out = None
    for cell in cells:
        gone = {c for f in cell.dropped for c in families[f]}
        part = leave_one_group_out(rows, [c for c in columns if c not in gone], cell, **options)
        out = part if out is None else out.unionByName(part)
    return out


def cell_reports(predictions: DataFrame, threshold: float, ordinal: str) -> DataFrame:
    return report(predictions, ["cell", "gene"], "label", "score", threshold, ordinal)


def consensus(predictions: DataFrame) -> DataFrame:
    """Of each variant over seeds: how many, how often right, mean and deviation of the score, and a verdict."""
    right = ((F.col("score") >= F.col("threshold")).cast("int") == F.col("label")).cast("int")
    out = predictions.groupBy("gene", "variant_key", "label").agg(F.count_distinct("cell").alias("n_cells"), F.sum(right).alias("n_right"), F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.stddev_samp("score").alias("sd_score"))
    verdict = F.when(F.col("n_right") == F.col("n"), "always_right").when(F.col("n_right") == 0, "always_wrong").otherwise("mixed")
    return out.withColumn("verdict", verdict)


def ensemble(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    from evidara.operators.ranking import risk_tiers

    mean = predictions.groupBy(*keys).agg(F.avg("score").alias("score"), F.stddev_samp("score").alias("sd"))
    return risk_tiers(mean, [], "score")
