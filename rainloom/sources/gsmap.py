"""Hourly global grids of 1200 by 3600 four-byte floats, gzipped, as rows."""

from __future__ import annotations

import gzip

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rainloom.functions.scalar import filename_time
from rainloom.operators.space import BBox

ROWS, COLUMNS = 1200, 3600


def read_gsmap(spark: SparkSession, path: str | list[str], box: BBox | None = None, chunk_rows: int = 50) -> DataFrame:
    """(time, lat, lon, precipitation) of grid files; longitudes from -180 to 180.  A box is cut out while decoding.

    Latitudes run from 59.95 down, longitudes from 0.05 up.  Files of another size are an error.
    """
    x = spark.read.format("binaryFile").load(path)
    x = x.select(filename_time(F.element_at(F.split("path", "/"), -1)).alias("time"), "content")
    lat, lon = 59.95 - 0.1 * np.arange(ROWS), 0.05 + 0.1 * np.arange(COLUMNS)
    lon = np.where(lon > 180, lon - 360, lon)
    rows = np.arange(ROWS) if box is None else np.nonzero((lat >= box.min_lat - 1e-9) & (lat <= box.max_lat + 1e-9))[0]
    cols = np.argsort(lon) if box is None else np.array([i for i in np.argsort(lon) if box.min_lon - 1e-9 <= lon[i] <= box.max_lon + 1e-9], int)

    def run(batches):
        for b in batches:
            for time, content in zip(b["time"], b["content"]):
                grid = np.frombuffer(gzip.decompress(bytes(content)), "<f4").reshape(ROWS, COLUMNS)
                for part in np.array_split(rows, max(1, len(rows) // chunk_rows)):
                    v = grid[np.ix_(part, cols)].astype(float)
                    yield pd.DataFrame({"time": time, "lat": np.repeat(lat[part], len(cols)).round(2), "lon": np.tile(lon[cols], len(part)).round(2), "precipitation": v.ravel()})

    return x.mapInPandas(run, "time timestamp_ntz, lat double, lon double, precipitation double")


def read_grid(spark: SparkSession, path: str, day: str | None = None, fields: list[str] | None = None) -> DataFrame:
    """Canonical grid (time, lat, lon, fields) from Parquet, cut to a day by a filter that reaches the scan."""
    x = spark.read.parquet(path)
    if day is not None:
        start = F.lit(day).cast("timestamp_ntz")
        x = x.where((F.col("time") >= start) & (F.col("time") < start + F.expr("interval 1 day")))
    return x if fields is None else x.select("time", "lat", "lon", *fields)
