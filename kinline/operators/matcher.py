"""The matcher: gradient-boosted trees over the features, one model for each fold, and their mean."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinline.functions.features import FEATURES
from kinline.operators.keyed_pass import CAND, S1
from kinline.operators.sampling import fold

FOLDS = 5


def _assembled(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(df)


def train_fold(rows: DataFrame, held_out: int, seed: int = 42, iterations: int = 20, depth: int = 5):
    """A model of all folds but one, with balanced class weights. ``rows``: label, s1, candidate and the features."""
    part = rows.withColumn("fold", fold(S1, FOLDS)).filter(F.col("fold") != held_out)
    n = part.groupBy("label").count().collect()  # two rows
    total, sizes = sum(r["count"] for r in n), {r["label"]: r["count"] for r in n}
    weight = F.when(F.col("label") == 1, total / (2 * max(1, sizes.get(1, 0)))).otherwise(total / (2 * max(1, sizes.get(0, 0))))
    gbt = GBTClassifier(labelCol="label", weightCol="weight", maxIter=iterations, maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed + held_out)
    return gbt.fit(_assembled(part.withColumn("weight", weight).withColumn("label", F.col("label").cast("double"))))


def train_ensemble(rows: DataFrame, **more) -> list:
    return [train_fold(rows, k, **more) for k in range(1, FOLDS + 1)]


def _probability(model, df: DataFrame, name: str) -> DataFrame:
    out = model.transform(df)
    return out.withColumn(name, vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction")


def score_ensemble(rows: DataFrame, models: list) -> DataFrame:
    """(s1, candidate, probability): the mean of all models."""
    df = _assembled(rows)
    for i, m in enumerate(models):
        df = _probability(m, df, f"p{i}")
    return df.select(S1, CAND, (sum(F.col(f"p{i}") for i in range(len(models))) / len(models)).alias("probability"))


def score_out_of_fold(rows: DataFrame, models: list) -> DataFrame:
    """Each row by the model that didn't see its fold; a row of no fold (0: its anchor isn't in the mapping) has the probability 0.

    ``rows`` may bring a column ``fold``; without one the fold goes by the hash of the anchor.
    """
    rows = rows if "fold" in rows.columns else rows.withColumn("fold", fold(S1, FOLDS))
    df = _assembled(rows)
    out = rows.filter((F.col("fold") == 0) | F.col("fold").isNull()).select(S1, CAND, F.lit(0.0).alias("probability"))
    for k, m in enumerate(models, 1):
        part = _probability(m, df.filter(F.col("fold") == k), "p").select(S1, CAND, F.col("p").alias("probability"))
        out = out.unionByName(part)
    return out


def accepted(scored: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose probability reaches the threshold, itself included."""
    return scored.filter(F.col("probability") >= threshold)


def importances(models: list) -> dict[str, float]:
    """Mean importance of each feature, largest first."""
    mean = {f: sum(float(m.featureImportances[i]) for m in models) / len(models) for i, f in enumerate(FEATURES)}
    return dict(sorted(mean.items(), key=lambda x: -x[1]))


def save(models: list, path: str) -> None:
    for i, m in enumerate(models):
        PipelineModel([m]).write().overwrite().save(f"{path}/fold{i + 1}")


def load(path: str) -> list:
    return [PipelineModel.load(f"{path}/fold{k}").stages[0] for k in range(1, FOLDS + 1)]
