"""Daily amounts over a stream of rates, with late rows up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_daily(stream: DataFrame, keys: list[str], time: str, value: str, hours: float, late: str = "6 hours") -> DataFrame:
    """(keys, day_start, amount, n) per day; ``time`` must be a TIMESTAMP.  Works on a batch as well."""
    v = F.when(~F.isnan(value) & (F.col(value) >= 0), F.col(value))
    x = stream.withWatermark(time, late).groupBy(*keys, F.window(time, "1 day").alias("w"))
    return x.agg(F.sum(v * hours).alias("amount"), F.count(v).alias("n")).select(*keys, F.col("w.start").alias("day_start"), "amount", "n")
