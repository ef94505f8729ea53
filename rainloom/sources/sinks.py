"""Writing results: Parquet by day with a side-car of attributes, csv by step or field."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save_grid(df: DataFrame, path: str, attributes: dict | None = None, overwrite: bool = True, by_day: bool = True) -> None:
    """Parquet with values as four-byte floats; only the days that ``df`` has are overwritten."""
    x = df.withColumns({c: F.col(c).cast("float") for c, t in df.dtypes if t == "double" and c not in ("lat", "lon")})
    w = x.write.option("compression", "zstd").option("partitionOverwriteMode", "dynamic").mode("overwrite" if overwrite else "errorifexists")
    (w.partitionBy("day") if by_day and "day" in x.columns else w).parquet(path)
    if attributes:
        side = df.sparkSession.createDataFrame([(json.dumps(attributes, sort_keys=True, default=str),)], "value string")
        side.coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}.attributes")


def save_csv(df: DataFrame, path: str, by: list[str]) -> None:
    df.write.partitionBy(*by).mode("overwrite").csv(path, header=True)


def save_fields(observations: DataFrame, stations: DataFrame, path: str) -> None:
    """Observations by field, and the stations that occur in them, as csv."""
    save_csv(observations, f"{path}/data", ["field"])
    stations.join(observations.select(F.col("station").alias("id")).distinct(), "id", "left_semi").write.mode("overwrite").csv(f"{path}/stations", header=True)
