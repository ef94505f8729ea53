"""Correction by weather type: times are clustered by their features, each cluster gets its own fit."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainloom.operators.fusion import Fuser
from rainloom.operators.scores import cluster_features

FEATURES = ["spm", "sup", "std", "cvr"]


def _vectors(features: DataFrame, fill: float = 20.0) -> DataFrame:
    x = features.fillna(fill, FEATURES)
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(x)


def fit_clusters(df: DataFrame, variable: str, k: int = 3, seed: int = 12) -> KMeansModel:
    return KMeans(k=k, seed=seed, featuresCol="features", predictionCol="label").fit(_vectors(cluster_features(df, variable)))


def labelled(df: DataFrame, variable: str, model: KMeansModel, time: str = "time") -> DataFrame:
    """``df`` with the ``label`` of each row's time."""
    marks = model.transform(_vectors(cluster_features(df, variable))).select(time, F.col("label"))
    return df.join(marks, time)


def nearest_centre(df: DataFrame, variable: str, centres: list[list[float]], time: str = "time", fill: float = 20.0) -> DataFrame:
    """(time, label): the centre nearest to each time's features, the first of ties; missing features are ``fill``."""
    x = cluster_features(df, variable).fillna(fill, FEATURES)
    far = [sum(((F.col(f) - F.lit(float(v))) * (F.col(f) - F.lit(float(v))) for f, v in zip(FEATURES, c)), F.lit(0.0)) for c in centres]
    return x.select(time, F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(i).alias("i")) for i, d in enumerate(far)]))["i"].alias("label"))


def corrected(df: DataFrame, variable: str, model: KMeansModel, fuser: Fuser) -> DataFrame:
    """``df`` with ``<variable>_matched``: a fit of ``fuser`` per label; rows at or below zero become zero."""
    x = labelled(df, variable, model)
    out = None
    for label in range(len(model.clusterCenters())):
        part = x.where(F.col("label") == label)
        if not part.take(1):
            continue
        y = fuser.transform(part)
        out = y if out is None else out.unionByName(y)
    return out.withColumn(f"{variable}_matched", F.when(F.col(variable) > 0, F.col(f"{variable}_matched")).otherwise(F.lit(0.0)))


def same_model(a: KMeansModel, b: KMeansModel) -> bool:
    return len(a.clusterCenters()) == len(b.clusterCenters()) and all((p == q).all() for p, q in zip(a.clusterCenters(), b.clusterCenters()))
