"""Gauge networks: commented csv files, Météo-France files and station pages, wide network tables."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rainloom.operators.accumulate import time_step
from rainloom.session import epoch_us

#: Fields of station records and the format of their DATE.
FIELDS = {"RR1": "yyyyMMddHH", "DRR1": "yyyyMMddHH", "RR6": "yyyyMMddHHmm", "RR": "yyyyMMdd"}
#: Synonyms of station columns.
STATION_NAMES = {"id": {"id", "code", "codigo", "código", "station", "poste"}, "name": {"name", "nome", "nom"}, "lat": {"lat", "latitude"}, "lon": {"lon", "longitude"}, "alt": {"alt", "altitude"}}


def numeric_where_all(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text columns cast to DOUBLE if every value that is there casts."""
    r = df.agg(*[(F.count(c) == F.count(F.col(c).try_cast("double"))).alias(c) for c in columns]).first()
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns if r[c]})


def commented_csv(spark: SparkSession, folder: str, tz: str = "America/Sao_Paulo", tz_rule: str = "duration", pattern: str = "*.csv") -> tuple[DataFrame, DataFrame]:
    """(observations, stations) of csv files whose head lines are ``#key:value``.

    observations: (id, time, value), stations: (id, name, lat, lon, alt, step_seconds, duration_seconds, path).  Local
    time goes to UTC if the record is shorter than a day (``tz_rule="duration"``) or its step is ("step").  Files with
    the same name and size are one; files without two times have no duration and are left out.
    """
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(folder, wholetext=True)
    x = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_size").alias("size"), "value")
    x = x.groupBy("name", "size").agg(F.min_by("value", "path").alias("value"), F.min("path").alias("path"))
    lines = F.filter(F.split("value", r"\r?\n"), lambda v: F.trim(v) != "")
    head = F.filter(lines, lambda v: v.startswith("#"))
    body = F.filter(lines, lambda v: ~v.startswith("#"))
    keys = F.map_from_entries(F.transform(head, lambda v: F.struct(F.lower(F.trim(F.regexp_extract(v, r"^#\s*([^:]*)", 1))), F.trim(F.regexp_extract(v, r":(.*)$", 1)))))
    x = x.select("path", keys.alias("k"), body.alias("b"))
    pick = lambda names: F.coalesce(*[F.col("k")[n] for n in names])
    station = x.select("path", pick(["código", "codigo", "id"]).alias("id"), pick(["nome", "name"]).alias("name"), *[pick([long, short]).try_cast("double").alias(short) for short, long in (("lat", "latitude"), ("lon", "longitude"), ("alt", "altitude"))], "b")
    rows = station.select("path", "id", F.explode(F.slice("b", 2, 1_000_000_000)).alias("line"))
    part = F.split("line", "[,;]")
    obs = rows.select("path", "id", F.get(part, F.lit(0)).try_cast("timestamp_ntz").alias("time"), F.get(part, F.lit(1)).try_cast("double").alias("value")).where("time is not null")
    steps = time_step(obs, by=["path"]).join(obs.groupBy("path").agg(F.count("*").alias("n")), "path").withColumn("duration_seconds", F.col("step_seconds") * F.col("n"))
    meta = station.drop("b").join(steps.where("duration_seconds is not null"), "path").drop("n")
    shift = F.col("duration_seconds" if tz_rule == "duration" else "step_seconds") < 86_400
    utc = F.to_utc_timestamp(F.col("time").cast("timestamp"), tz).cast("timestamp_ntz")
    obs = obs.join(meta.select("path", "step_seconds", "duration_seconds"), "path").select("id", F.when(shift, utc).otherwise(F.col("time")).alias("time"), "value", "step_seconds")
    return obs, meta


def by_step(obs: DataFrame) -> DataFrame:
    """Observations once per (id, time) with a label of their step; the first value counts."""
    from rainloom.functions.scalar import timedelta_label

    return obs.groupBy("id", "step_seconds", "time").agg(F.min("value").alias("value")).withColumn("step", timedelta_label(F.col("step_seconds")))


def record_files(spark: SparkSession, folder: str, ignore: tuple[str, ...] = (), shift_hours: int = 3, pattern: str = "*.data") -> DataFrame:
    """(station, field, time, value) of ``.data`` files; times get ``shift_hours`` but for daily fields.

    Fields that a file doesn't have are skipped; of several values for one station, field and time the first counts.
    """
    from rainloom.operators.schema_drift import with_records

    x = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(folder, wholetext=True)
    x = x.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    name = F.element_at(F.split("path", "/"), -1)
    x = x.where(~name.isin(*ignore)) if ignore else x

    t = with_records(x).select("path", "header", F.posexplode("lines").alias("line", "r"))
    at = lambda name: F.get("r", F.array_position("header", name).cast("int") - 1)
    t = t.where(F.array_contains("header", "POSTE") & F.array_contains("header", "DATE"))
    fields = F.filter(F.array(*[F.struct(F.lit(f).alias("field"), at(f).alias("text"), F.array_contains("header", f).alias("there")) for f in FIELDS]), lambda e: e["there"])
    t = t.select("path", "line", at("POSTE").alias("station"), at("DATE").alias("date"), F.explode(fields).alias("f")).select("path", "line", "station", "date", "f.field", "f.text")
    when = F.lit(None).cast("timestamp_ntz")
    for f, fmt in FIELDS.items():
        when = F.when(F.col("field") == f, F.try_to_timestamp("date", F.lit(fmt)).cast("timestamp_ntz")).otherwise(when)
    t = t.withColumn("time", when).withColumn("value", F.regexp_replace("text", ",", ".").try_cast("double")).where("time is not null")
    later = (F.col("time") + F.make_dt_interval(hours=F.lit(shift_hours))).cast("timestamp_ntz")
    t = t.withColumn("time", F.when(F.col("field") == "RR", F.col("time")).otherwise(later))
    return t.groupBy(F.col("station").try_cast("long").alias("station"), "field", "time").agg(F.min_by("value", F.struct("path", "line")).alias("value"))


def record_long(records: DataFrame, fields: tuple[str, ...] = ("rr1", "rr6", "rr")) -> DataFrame:
    """(station, n, total, field): number and sum of each station's values per field of a record table."""
    parts = F.array(*[F.struct(F.lit(f).alias("field"), F.when(~F.isnan(f), F.col(f)).alias("v")) for f in fields])
    x = records.where("poste is not null").select(F.col("poste").alias("station"), F.explode(parts).alias("p")).where("p.v is not null")
    return x.groupBy("station", F.col("p.field").alias("field")).agg(F.count("*").alias("n"), F.sum("p.v").alias("total")).select("station", "n", "total", "field")


def measured_field(columns: list[str]) -> str:
    """The first of RR1, DRR1, RR6 and RR that is there."""
    for f in FIELDS:
        if f in columns:
            return f
    raise ValueError(f"none of {', '.join(FIELDS)} among the columns")


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__()
        self.rows: list[list[str]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None and self.rows:
            self.rows[-1].append(" ".join("".join(self.cell).split()))
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def station_pages(spark: SparkSession, folder: str, pattern: str = "*.html") -> DataFrame:
    """(id, name, lat, lon, altitude, owner) of station tables in html pages, one row per id.

    Rows with a number first and at least five cells are stations; coordinates are read as degrees, minutes, seconds.
    """
    from rainloom.operators.near import with_position

    x = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(folder, wholetext=True)

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for page in b["value"]:
                p = _Tables()
                p.feed(page)
                for r in p.rows:
                    if len(r) >= 5 and re.fullmatch(r"\d+", r[0]):
                        alt = re.search(r"-?\d+", r[-2])
                        rows.append((int(r[0]), r[1], r[2], float(alt.group()) if alt else None, r[-1]))
            yield pd.DataFrame(rows, columns=["id", "name", "coordinates", "altitude", "owner"])

    t = x.mapInPandas(run, "id long, name string, coordinates string, altitude double, owner string")
    t = t.groupBy("id").agg(F.min(F.struct("name", "coordinates", "altitude", "owner")).alias("s")).select("id", "s.*", F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"))
    return with_position(t).select("id", "name", F.col("p_lat").alias("lat"), F.col("p_lon").alias("lon"), "altitude", "owner")


def station_columns(df: DataFrame) -> DataFrame:
    """Station table with its columns renamed by synonyms to id, name, lat, lon, alt."""
    names = {c: n for c in df.columns for n, known in STATION_NAMES.items() if c.strip().lower() in known}
    return df.withColumnsRenamed(names)


def network_csv(spark: SparkSession, data: str, stations: str) -> tuple[DataFrame, DataFrame]:
    """(observations, stations) of a wide csv (time, one column per station) and its station table."""
    wide = spark.read.csv(data, header=True, inferSchema=False)
    time, *ids = wide.columns
    long = wide.select(F.col(time).cast("timestamp_ntz").alias("time"), *[F.col(f"`{c}`").try_cast("double").alias(c) for c in ids]).unpivot("time", ids, "station", "value")
    return long.withColumn("station", F.col("station").cast("long")), station_columns(spark.read.csv(stations, header=True, inferSchema=True))


def station_coordinates(stations: DataFrame, ids: DataFrame, id: str = "id") -> DataFrame:
    """(id, lat, lon) of the stations asked for, each once; unknown ones have no row."""
    return stations.join(ids.select(id).distinct(), id, "left_semi").groupBy(id).agg(F.min(F.struct("lat", "lon")).alias("p")).select(id, "p.lat", "p.lon")


def distance_to(stations: DataFrame, lat: float, lon: float) -> DataFrame:
    from rainloom.functions.scalar import haversine_km

    return stations.withColumn("km", haversine_km(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon)))


def latest_per_time(obs: DataFrame, keys: list[str], time: str, order: str) -> DataFrame:
    """First row per key and time by ``order``."""
    w = Window.partitionBy(*keys, epoch_us(F.col(time))).orderBy(order)
    return obs.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
