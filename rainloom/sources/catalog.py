"""File catalogs: paths with the time their names tell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rainloom.functions.scalar import filename_time


def files(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """(path, name, length) of the files below a folder; contents aren't read."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", pattern).load(folder)
    return x.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def catalog(spark: SparkSession, folder: str, pattern: str = "*", start: int | None = None, stop: int | None = None, fmt: str | None = None, strict: bool = True) -> DataFrame:
    """(path, name, time, day) of product files, by time.

    The time is cut from the name by position and format, or recognised from it.  Folder settings files are left out.
    With ``strict`` a name without a time is an error, otherwise its time is NULL.
    """
    x = files(spark, folder, pattern).where(~F.col("name").endswith("tore"))
    if fmt is not None:
        t = F.try_to_timestamp(F.substring("name", (start or 0) + 1, (stop or 10_000) - (start or 0)), F.lit(fmt)).cast("timestamp_ntz")
    else:
        t = filename_time(F.col("name"))
    if strict:
        t = F.coalesce(t, F.raise_error(F.concat(F.lit("no time in file name "), F.col("name"))).cast("timestamp_ntz"))
    return x.withColumn("time", t).withColumn("day", F.to_date("time")).select("path", "name", "time", "day").orderBy("time", "path")


def unique_files(x: DataFrame) -> DataFrame:
    """One path per (name, length), the first in order."""
    return x.groupBy("name", "length").agg(F.min("path").alias("path"))


class Instrument:
    """A radar or satellite product with a catalog per processing level, kept as temporary views."""

    def __init__(self, source: str, name: str, levels: range = range(0, 4)):
        self.source, self.name, self.levels = source, name, levels
        self.catalogs: dict[int, DataFrame] = {}

    def build_catalog(self, spark: SparkSession, level: int, folder: str, **options) -> DataFrame:
        if level not in self.levels:
            raise ValueError(f"level must be in {list(self.levels)}")
        x = catalog(spark, folder, **options)
        x.createOrReplaceTempView(f"l{level}_catalog")
        self.catalogs[level] = x
        return x

    def sample_path(self, level: int = 2, date: str | None = None) -> str | None:
        """The first file of a level, or of a date."""
        if level not in self.catalogs:
            raise ValueError(f"no catalog of level {level}")
        x = self.catalogs[level]
        x = x if date is None else x.where(F.col("day") == F.lit(date).cast("date"))
        r = x.orderBy("time", "path").limit(1).collect()
        return r[0].path if r else None
