"""Encoders, splits, classifiers, scoring and model-agnostic importance on MLlib pipelines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .ordered import index_percentiles

# Trees, iterations and folds of the trainers.
TREES, GBT_ITERATIONS, LR_ITERATIONS, FOLDS = 100, 100, 200, 5
MODEL_TYPES = ("random_forest", "gradient_boosting", "logistic_regression")


def label_encoder(column: str, output: str):
    """Codes in alphabetical order."""
    return StringIndexer(inputCol=column, outputCol=output, stringOrderType="alphabetAsc", handleInvalid="keep")


def standardize(df: DataFrame, columns: Sequence[str], is_train: Column) -> DataFrame:
    """``z_<column>`` with the population moments of the training rows only."""
    train = lambda c: F.when(is_train, F.col(c))
    moments = df.agg(F.struct(*[f(train(c)).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])).scalar()
    scaled = {}
    for c in columns:
        spread = F.when(moments[f"s_{c}"] > 0, moments[f"s_{c}"]).otherwise(1.0)
        scaled[f"z_{c}"] = (F.col(c) - moments[f"m_{c}"]) / spread
    return df.withColumns(scaled)


def hash_split(df: DataFrame, row_id: str, train_percent: int = 80) -> DataFrame:
    """Split by id hash: the same after any repartitioning, for train and serve alike."""
    return df.withColumn("split", F.when(S.md5_number(F.col(row_id)) % 100 < train_percent, "train").otherwise("test"))


def stratified_split(df: DataFrame, row_id: str, label: str, train_share: float = 0.8) -> DataFrame:
    """Exact share per class: the hash at that share is the class's cut, found without sorting a class in one task."""
    hashed = df.withColumn("_h", F.xxhash64(row_id))
    cuts = index_percentiles(hashed, "_h", {"_cut": train_share}, [label])
    joined = hashed.join(cuts, label)
    return joined.withColumn("split", F.when(F.col("_h") < F.col("_cut"), "train").otherwise("test")).drop("_h", "_cut")


def classifier(model_type: str, label: str = "label", features: str = "features", binary: bool = False, iterations: int | None = None):
    common = {"labelCol": label, "featuresCol": features}
    if model_type == "random_forest":
        return RandomForestClassifier(numTrees=iterations or TREES, seed=42, **common)
    if model_type == "logistic_regression":
        return LogisticRegression(maxIter=iterations or LR_ITERATIONS, **common)
    if model_type == "gradient_boosting":
        boosted = GBTClassifier(maxIter=iterations or GBT_ITERATIONS, seed=42, **common)
        return boosted if binary else OneVsRest(classifier=boosted, parallelism=4, **common)
    raise ValueError(f"unknown model type: {model_type}")


def train_event_classifier(train: DataFrame, features: Sequence[str], target: str, model_type: str, iterations: int | None = None) -> PipelineModel:
    """encode target -> assemble -> scale -> classify, fitted on the training rows."""
    return Pipeline(stages=[
        label_encoder(target, "label"),
        VectorAssembler(inputCols=list(features), outputCol="raw", handleInvalid="keep"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True),
        classifier(model_type, iterations=iterations),
    ]).fit(train)


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``predicted`` class name, and its ``confidence`` where the model gives probabilities."""
    labels = model.stages[0].labels
    names = F.array(*[F.lit(n) for n in labels])
    out = model.transform(df).withColumn("predicted", F.get(names, F.col("prediction").cast("int")))
    if "probability" in out.columns:
        out = out.withColumn("probabilities", vector_to_array("probability")).withColumn("confidence", F.array_max("probabilities"))
    return out


def search_churn_model(train: DataFrame, features: Sequence[str], label: str, folds: int = FOLDS, parallelism: int = 4, seed: int = 42):
    """Cross-validated search of logistic regressions by area under ROC; the trials run in parallel as Spark jobs."""
    stages = [VectorAssembler(inputCols=list(features), outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)]
    model = LogisticRegression(labelCol=label, maxIter=LR_ITERATIONS)
    grid = ParamGridBuilder().addGrid(model.regParam, [1.0, 0.1, 0.01, 0.001]).build()
    pipeline = Pipeline(stages=[*stages, model])
    return CrossValidator(estimator=pipeline, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(labelCol=label),
                          numFolds=folds, parallelism=parallelism, seed=seed).fit(train)


def fit_linear(train: DataFrame, features: Sequence[str], label: str) -> tuple[list[float], float]:
    """(coefficients, intercept) of a least-squares fit over all rows; the normal equations are aggregated by Spark."""
    rows = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip").transform(train.filter(F.col(label).isNotNull()))
    model = LinearRegression(labelCol=label, solver="normal").fit(rows)
    return [float(w) for w in model.coefficients], float(model.intercept)


def linear_scorer(coefficients: Sequence[float], intercept: float):
    """Inference of a linear model as a native expression over its feature columns."""
    return lambda *features: sum((F.lit(float(w)) * c.cast("double") for w, c in zip(coefficients, features)), F.lit(0.0)) + F.lit(float(intercept))


def shuffled_column(df: DataFrame, row_id: str, column: str, rows_per_bucket: int = 100_000, seed: int = 7) -> DataFrame:
    """``column`` permuted among rows: inside hash buckets of bounded size, one hash order is matched to another."""
    buckets = max(1, -(-df.count() // rows_per_bucket))
    bucketed = df.withColumn("_b", F.pmod(F.xxhash64(row_id, F.lit(seed)), F.lit(buckets)))
    order = lambda s: Window.partitionBy("_b").orderBy(F.xxhash64(row_id, F.lit(s)), row_id)
    ranked = bucketed.withColumns({"_i": F.row_number().over(order(seed + 1)), "_j": F.row_number().over(order(seed + 2))})
    donors = ranked.select("_b", F.col("_j").alias("_i"), F.col(column).alias("_shuffled"))
    return ranked.join(donors, ["_b", "_i"]).withColumn(column, F.col("_shuffled")).drop("_b", "_i", "_j", "_shuffled")


def permutation_importance(model, df: DataFrame, row_id: str, features: Sequence[str], metric) -> DataFrame:
    """Loss of the metric when one feature is shuffled. ``metric(scored)`` gives one number column in one row."""
    spark = df.sparkSession
    base = metric(model.transform(df)).first()[0]
    rows = [(f, float(base - metric(model.transform(shuffled_column(df, row_id, f))).first()[0])) for f in features]
    return spark.createDataFrame(rows, "feature string, importance double")


def accuracy(scored: DataFrame, label: str = "label") -> DataFrame:
    return scored.agg(F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("accuracy"))
