"""Models on Spark ML: design matrices, discrete-time hazards, static risks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import cif_from_hazards, signed_log


def with_logs(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Signed logs of columns, and whether each was missing."""
    return rows.select("*", *[signed_log(F.col(c).cast("double")).alias(f"{c}_log") for c in columns], *[F.col(c).isNull().cast("double").alias(f"{c}_missing") for c in columns])


def design(numeric: Sequence[str], categories: Sequence[str], output: str = "features") -> list:
    """Stages: medians for missing numbers, centred and scaled; categories one-hot with a level for unseen and missing."""
    logs = [f"{c}_log" for c in numeric]
    return [
        Imputer(inputCols=logs, outputCols=[f"{c}_filled" for c in logs], strategy="median"),
        VectorAssembler(inputCols=[f"{c}_filled" for c in logs], outputCol="numbers"),
        StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True),
        StringIndexer(inputCols=list(categories), outputCols=[f"{c}_code" for c in categories], handleInvalid="keep"),
        OneHotEncoder(inputCols=[f"{c}_code" for c in categories], outputCols=[f"{c}_hot" for c in categories], handleInvalid="keep"),
        VectorAssembler(inputCols=["scaled", *[f"{c}_missing" for c in numeric], *[f"{c}_hot" for c in categories]], outputCol=output),
    ]


def fit_hazards(periods: DataFrame, numeric: Sequence[str], categories: Sequence[str], label: str = "outcome") -> PipelineModel:
    """Multinomial logistic model of (censored, stop, complete) per person-period."""
    model = LogisticRegression(featuresCol="features", labelCol=label, family="multinomial", regParam=1e-3, maxIter=50)
    return Pipeline(stages=[*design(numeric, categories), model]).fit(with_logs(periods, numeric))


def risks(model: PipelineModel, periods: DataFrame, numeric: Sequence[str], keys: Sequence[str], interval: str = "interval") -> DataFrame:
    """keys with the cumulative incidence of stop after each interval."""
    p = vector_to_array("probability")
    hazard = F.struct(F.col(interval).alias("i"), p[1].alias("stop"), p[2].alias("complete"))
    listed = model.transform(with_logs(periods, numeric)).groupBy(*keys).agg(F.array_sort(F.collect_list(hazard)).alias("hazards"))
    return listed.select(*keys, cif_from_hazards(F.col("hazards")).alias("cif"))


def fit_boosted(rows: DataFrame, numeric: Sequence[str], categories: Sequence[str], label: str, weight: str, validation: str | None = None, rounds: int = 20) -> PipelineModel:
    """A boosted binary model with row weights; with a validation flag it stops early."""
    gbt = GBTClassifier(featuresCol="features", labelCol=label, weightCol=weight, maxIter=rounds, maxDepth=4, seed=42)
    if validation:
        gbt = gbt.setValidationIndicatorCol(validation)
    return Pipeline(stages=[*design(numeric, categories), gbt]).fit(with_logs(rows, numeric))


def best_models(results: DataFrame) -> DataFrame:
    """Models in order: highest AUC, then lowest Brier, then slope nearest 1 (auc, brier, slope, model)."""
    return results.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("auc"), "brier", F.abs(F.col("slope") - 1), "model")))


def majority(votes: Column) -> Column:
    """The label of most votes in an array of labels; null on a tie."""
    counted = F.transform(F.array_distinct(votes), lambda v: F.struct((-F.size(F.filter(votes, lambda x: x == v))).alias("n"), v.alias("label")))
    ranked = F.array_sort(counted)
    return F.when((F.size(ranked) == 1) | (ranked[0]["n"] != F.get(ranked, F.lit(1))["n"]), ranked[0]["label"])
