"""Regression on feature tables with Spark ML."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.operators.quality import rmse, score
from tarmac.operators.split import hash_bucket
from tarmac.session import scratch
from tarmac.sources.tables import write_table


def materialised(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Training passes over its input many times; from a table each pass is a scan, and a lost executor costs a
    re-read rather than the whole preparation.
    """
    path = scratch(df.sparkSession, label)
    write_table(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def boosted_trees(
    features: Sequence[str],
    target: str,
    rounds: int = 100,
    depth: int = 6,
    rate: float = 0.05,
    subsample: float = 0.8,
    validation: str | None = None,
    seed: int = 42,
) -> Pipeline:
    """Gradient-boosted trees; with a boolean ``validation`` column, rounds stop when its error stops falling."""
    trees = GBTRegressor(
        featuresCol="features",
        labelCol=target,
        maxIter=rounds,
        maxDepth=depth,
        stepSize=rate,
        subsamplingRate=subsample,
        seed=seed,
    )
    if validation:
        trees = trees.setValidationIndicatorCol(validation)
    return Pipeline(stages=[_assembler(features), trees])


def linear(features: Sequence[str], target: str) -> Pipeline:
    return Pipeline(stages=[_assembler(features), LinearRegression(featuresCol="features", labelCol=target, regParam=0.01)])


def _assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")


def predict(model: PipelineModel, df: DataFrame, name: str = "prediction") -> DataFrame:
    return model.transform(df).drop("features").withColumnRenamed("prediction", name)


def best_round(model: PipelineModel, validation: DataFrame) -> DataFrame:
    """Validation error after each round, the least of them marked."""
    trees = model.stages[-1]
    errors = trees.evaluateEachIteration(model.stages[0].transform(validation), "squared")
    least = min(range(len(errors)), key=errors.__getitem__)
    rows = [(i + 1, float(e) ** 0.5, i == least) for i, e in enumerate(errors)]
    return validation.sparkSession.createDataFrame(rows, "round int, rmse double, best boolean")


def random_search(
    train: DataFrame,
    features: Sequence[str],
    target: str,
    draws: int = 30,
    folds: int = 3,
    seed: int = 42,
    parallelism: int = 4,
    rounds: tuple[int, int] = (100, 1000),
    keys: Sequence[str] = (),
) -> tuple[PipelineModel, DataFrame]:
    """Best model and the mean squared error of every draw of the tree parameters.

    Folds are dealt by the hash of ``keys``, so that they don't hang on partitions; without keys, by Spark. The share of
    columns a split may choose from is drawn too.
    """
    pipeline = boosted_trees(features, target, seed=seed)
    trees = pipeline.getStages()[-1]
    dice = random.Random(seed)
    maps = [
        {
            trees.maxIter: dice.randrange(*rounds),
            trees.stepSize: 0.01 + 0.1 * dice.random(),
            trees.maxDepth: dice.randrange(3, 10),
            trees.subsamplingRate: 0.6 + 0.4 * dice.random(),
            trees.featureSubsetStrategy: str(round(0.6 + 0.4 * dice.random(), 3)),
        }
        for _ in range(draws)
    ]
    search = CrossValidator(
        estimator=pipeline,
        estimatorParamMaps=maps,
        evaluator=RegressionEvaluator(labelCol=target, metricName="mse"),
        numFolds=folds,
        parallelism=parallelism,
        seed=seed,
        foldCol="_fold" if keys else "",
    ).fit(train.withColumn("_fold", hash_bucket(keys, seed, folds)) if keys else train)
    drawn = (trees.maxIter, trees.stepSize, trees.maxDepth, trees.subsamplingRate, trees.featureSubsetStrategy)
    rows = [
        (i, *[float(m[p]) for p in drawn], float(e))
        for i, (m, e) in enumerate(zip(maps, search.avgMetrics))
    ]
    names = "draw int, rounds double, rate double, depth double, subsample double, columns double, mse double"
    return search.bestModel, train.sparkSession.createDataFrame(rows, names)


def staged_search(
    train: DataFrame,
    features: Sequence[str],
    target: str,
    draws: Sequence[dict[str, float]],
    stages: Sequence[int],
    keys: Sequence[str],
    folds: int = 3,
    keep: float = 0.5,
    seed: int = 42,
) -> DataFrame:
    """``draw, rounds, mse, dropped``: mean held-out error of every draw after each round, losers dropped at set rounds.

    One fit of a draw and fold gives its errors at every round up to the stage's, since the first trees of a longer fit are
    those of a shorter one; so draws that differ in rounds only are one draw here. After each stage the better share
    of the draws (by their least error so far) goes on to more rounds. Rows are dealt to folds by the hash of ``keys``.
    A draw has ``depth``, ``rate``, ``subsample`` and ``columns``, the share of columns a split may choose from.
    """
    dealt = train.withColumn("_fold", hash_bucket(keys, seed, folds))
    alive, errors, dropped = list(range(len(draws))), {}, {}
    for stage in stages:
        for number in alive:
            draw = draws[number]
            pipeline = boosted_trees(features, target, stage, int(draw["depth"]), draw["rate"], draw["subsample"], seed=seed)
            pipeline.getStages()[-1].setFeatureSubsetStrategy(str(draw["columns"]))
            sums = [0.0] * stage
            for fold in range(folds):
                model = pipeline.fit(dealt.filter(F.col("_fold") != fold))
                held = model.stages[0].transform(dealt.filter(F.col("_fold") == fold))
                sums = [a + b for a, b in zip(sums, model.stages[-1].evaluateEachIteration(held, "squared"))]
            errors[number] = [x / folds for x in sums]
        alive.sort(key=lambda n: min(errors[n]))
        for number in alive[max(1, math.ceil(len(alive) * keep)) :]:
            dropped[number] = stage
        alive = [n for n in alive if n not in dropped]
    rows = [(n, r, float(e), dropped.get(n)) for n, all_ in errors.items() for r, e in enumerate(all_, start=1)]
    return train.sparkSession.createDataFrame(rows, "draw int, rounds int, mse double, dropped int")


def drawn_parameters(draws: int, seed: int = 42) -> list[dict[str, float]]:
    """Random draws over the ranges of the search."""
    dice = random.Random(seed)
    return [
        {
            "rate": 0.01 + 0.1 * dice.random(),
            "depth": dice.randrange(3, 10),
            "subsample": 0.6 + 0.4 * dice.random(),
            "columns": round(0.6 + 0.4 * dice.random(), 3),
        }
        for _ in range(draws)
    ]


def static_encoder(column: str, out: str) -> Pipeline:
    """Label code and one indicator per label. Fitted once, on training data; unseen labels get a place of their own."""
    index = StringIndexer(inputCol=column, outputCol=f"{column}_code", stringOrderType="alphabetAsc", handleInvalid="keep")
    hot = OneHotEncoder(inputCol=f"{column}_code", outputCol=out, dropLast=False)
    return Pipeline(stages=[index, hot])


def encode_static(model: PipelineModel, df: DataFrame, column: str, out: str) -> DataFrame:
    encoded = model.transform(df)
    return encoded.withColumn(out, vector_to_array(F.col(out))).withColumn(
        f"{column}_code", F.col(f"{column}_code").cast("int")
    )


def blend(df: DataFrame, columns: Sequence[str], name: str = "blend") -> DataFrame:
    """Equal-weight mean of several predictions."""
    total = sum((F.col(c) for c in columns), F.lit(0.0))
    return df.withColumn(name, total / len(columns))


def scores(df: DataFrame, target: str, predictions: Sequence[str]) -> DataFrame:
    """Error and score of each prediction column, from one pass."""
    errors = df.agg(*[rmse(F.col(target), F.col(p)).alias(p) for p in predictions])
    rows = F.array(*[F.struct(F.lit(p).alias("model"), F.col(p).alias("rmse")) for p in predictions])
    return errors.select(F.explode(rows).alias("r")).select("r.*").withColumn("score", score(F.col("rmse")))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
