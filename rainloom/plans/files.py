"""Queries of sources and sinks: tables are written as files of each kind, read again, and compared with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rainloom.functions import scalar as S
from rainloom.plans import reference
from rainloom.plans.reference import rain
from rainloom.session import shared_folder, table
from rainloom.sources import gauges, gsmap, sinks

_PARTS = "part-*"


def _write(files: DataFrame, folder: str) -> str:
    """Each row (file, content) as a file of its own."""
    files.write.partitionBy("file").text(folder)
    return folder


def read_records(spark: SparkSession, d: str) -> DataFrame:
    """Record files, one per station and day, read as (station, field, time, value)."""
    x = table(spark, d, "mf_data").where("rr1 is not null and not isnan(rr1)").groupBy("poste", "date").agg(F.min("rr1").alias("v"))
    line = F.concat_ws(";", "poste", "date", F.regexp_replace(F.col("v").cast("string"), r"\\.", ","))
    x = x.groupBy("poste", F.substring("date", 1, 8).alias("day")).agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("lines"))
    folder = _write(x.select(F.concat_ws("_", "poste", "day").alias("file"), F.concat(F.lit("# note\nPOSTE;DATE;RR1\n"), F.col("lines")).alias("content")), shared_folder(spark, "records"))
    return gauges.record_files(spark, folder, pattern=_PARTS)


def read_commented_csv(spark: SparkSession, d: str) -> DataFrame:
    """Gauge files with commented heads: local times of long records stay."""
    x = rain(spark, d).groupBy("pixel").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(",", F.col("time").cast("string"), F.round("rate", 6).cast("string")))), "\n").alias("lines"))
    head = F.concat(F.lit("#Código:"), F.col("pixel"), F.lit("\n#Nome:N\n#Latitude:-3.5\n#Longitude:-38\n#Altitude:9\ndata,valor\n"))
    folder = _write(x.select(F.col("pixel").alias("file"), F.concat(head, F.col("lines")).alias("content")), shared_folder(spark, "csv"))
    obs, meta = gauges.commented_csv(spark, folder, pattern=_PARTS)
    return obs.join(meta.select("id", "lat", "lon", "alt"), "id").select("id", "time", F.round("value", 6).alias("value"), "lat", "lon", "alt")


def read_station_pages(spark: SparkSession, d: str) -> DataFrame:
    """Station tables in pages of twenty."""
    k = F.col("s_suppkey")
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    at = F.concat((k % 60).cast("string"), F.lit("°30'00\"N "), (k % 90).cast("string"), F.lit("°15'00\"O"))
    row = F.concat(F.lit("<tr>"), cell(k.cast("string")), cell(F.col("s_name")), cell(at), cell(F.concat((k % 500).cast("string"), F.lit(" m"))), cell(F.lit("owner")), F.lit("</tr>"))
    x = table(spark, d, "supplier").groupBy(F.floor(k / 20).alias("page")).agg(F.array_join(F.collect_list(row), "").alias("rows"))
    folder = _write(x.select(F.col("page").cast("string").alias("file"), F.concat(F.lit("<table>"), F.col("rows"), F.lit("</table>")).alias("content")), shared_folder(spark, "pages"))
    return gauges.station_pages(spark, folder, pattern=_PARTS).select("id", "name", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "altitude", "owner")


def read_network_csv(spark: SparkSession, d: str) -> DataFrame:
    """A wide csv with a column per station, and its station table."""
    x = table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("time")).pivot("event_type").agg(F.count("event_id"))
    names = sorted(c for c in x.columns if c != "time")
    folder = shared_folder(spark, "network")
    x.select("time", *[F.col(c).alias(str(i)) for i, c in enumerate(names)]).write.csv(f"{folder}/data", header=True)
    spark.createDataFrame([(i, c, float(i), -float(i)) for i, c in enumerate(names)], "Code long, Nome string, Latitude double, Longitude double").write.csv(f"{folder}/stations", header=True)
    obs, stations = gauges.network_csv(spark, f"{folder}/data", f"{folder}/stations")
    return obs.join(stations.select(F.col("id").cast("long").alias("station"), "name", "lat", "lon"), "station").where("value is not null").select("time", "name", "lat", "lon", "value")


def written_grid(spark: SparkSession, d: str) -> DataFrame:
    """Daily amounts written by day and read back."""
    day = reference.QUERIES["daily_accumulation"](spark, d)
    folder = shared_folder(spark, "grid")
    sinks.save_grid(day, folder, {"product": "gsmap"})
    x = spark.read.parquet(folder)
    return x.select(F.to_date("day").alias("day"), "pixel", F.round(F.col("daily_accumulation").cast("double"), 3).alias("daily_accumulation"), "is_complete")


def written_fields(spark: SparkSession, d: str) -> DataFrame:
    """Observations written by field as csv, with the stations that occur, and read back."""
    obs = gauges.record_long(table(spark, d, "mf_data"))
    folder = shared_folder(spark, "fields")
    sinks.save_fields(obs, table(spark, d, "mf_data").select(F.col("poste").alias("id")).distinct(), folder)
    x = spark.read.csv(f"{folder}/data", header=True, schema="station long, n long, total double, field string")
    s = spark.read.csv(f"{folder}/stations", header=True, schema="id long")
    return x.join(s, x["station"] == s["id"], "left_semi").select("station", "field", "n", F.round("total", 4).alias("total"))


def grid_of_a_day(spark: SparkSession, d: str) -> DataFrame:
    """A canonical grid read for one day and field."""
    x = gsmap.read_grid(spark, f"{d}/imerg_grid.parquet", "2024-09-03", ["precipitationcal"])
    return x.groupBy("lat", "lon").agg(F.count("precipitationcal").alias("n"), F.min("time").alias("first"))


def product_times(spark: SparkSession, d: str) -> DataFrame:
    """Times of product files of every kind, from names made of the events' hours."""
    o = table(spark, d, "events").select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("time")).distinct()
    f = lambda p: F.date_format("time", p)
    names = {
        "gsmap": F.concat(F.lit("gsmap."), f("yyyyMMdd.HHmm"), F.lit(".dat.gz")), "romuald": F.concat(F.lit("Romuald_"), f("yyyyMMddHHmmss"), F.lit("_scan.nc")), "raw": F.concat(f("yyMMddHHmmss"), F.lit(".RAW")),
        "vol": F.concat(f("yyyyMMddHHmmss"), F.lit("00.vol")), "level": F.concat(F.lit("L1_radar_S"), f("yyyyMMdd'T'HHmm"), F.lit("_x.nc")),
    }
    x = o.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), n.alias("name")) for k, n in names.items()])).alias("n")).select("n.kind", "n.name")
    return x.select("kind", "name", S.filename_time(F.col("name")).alias("time"))


QUERIES = {f.__name__: f for f in (read_records, read_commented_csv, read_station_pages, read_network_csv, written_grid, written_fields, grid_of_a_day, product_times)}

_RAIN = "select date_trunc('hour', ts) as time, event_type as pixel, round(avg(value) / 100, 9) as rate from events group by 1, 2"

ORACLE = {
    "read_records": """select poste as station, 'RR1' as field, strptime(date, '%Y%m%d%H') + interval 3 hour as time, min(rr1) as value
        from mf_data where rr1 is not null and not isnan(rr1) group by poste, date""",
    "read_commented_csv": f"select pixel as id, cast(time as timestamp) as time, round(rate, 6) as value, -3.5::double as lat, -38.0::double as lon, 9.0::double as alt from ({_RAIN})",
    "read_station_pages": """select s_suppkey as id, s_name as name, round(s_suppkey % 60 + 0.5, 6)::double as lat, round(-(s_suppkey % 90) - 0.25, 6)::double as lon, (s_suppkey % 500)::double as altitude, 'owner' as owner from supplier
        where s_suppkey % 60 + 0.5 <= 90""",
    "read_network_csv": """with n as (select event_type, row_number() over (order by event_type) - 1 as i from (select distinct event_type from events))
        select cast(date_trunc('hour', ts) as timestamp) as time, event_type as name, any_value(i)::double as lat, -any_value(i)::double as lon, count(*)::double as value from events join n using (event_type) group by 1, 2""",
    "written_grid": f"select cast(day as date) as day, pixel, round(cast(cast(daily_accumulation as float) as double), 3) as daily_accumulation, is_complete from ({reference.ORACLE['daily_accumulation']})",
    "written_fields": """select station, field, n, total from (
        select poste as station, 'rr1' as field, count(rr1) as n, round(sum(rr1), 4) as total from mf_data where not isnan(rr1) group by 1
        union all select poste, 'rr6', count(rr6), round(sum(rr6), 4) from mf_data where not isnan(rr6) group by 1
        union all select poste, 'rr', count(rr), round(sum(rr), 4) from mf_data where not isnan(rr) group by 1)""",
    "grid_of_a_day": "select lat, lon, count(precipitationcal) as n, min(time) as first from imerg_grid where time >= timestamp '2024-09-03' and time < timestamp '2024-09-04' group by 1, 2",
    "product_times": """with o as (select distinct date_trunc('hour', ts) as t from events),
        n as (select t, unnest([{'kind': 'gsmap', 'name': 'gsmap.' || strftime(t, '%Y%m%d.%H%M') || '.dat.gz'}, {'kind': 'romuald', 'name': 'Romuald_' || strftime(t, '%Y%m%d%H%M%S') || '_scan.nc'},
          {'kind': 'raw', 'name': strftime(t, '%y%m%d%H%M%S') || '.RAW'}, {'kind': 'vol', 'name': strftime(t, '%Y%m%d%H%M%S') || '00.vol'}, {'kind': 'level', 'name': 'L1_radar_S' || strftime(t, '%Y%m%dT%H%M') || '_x.nc'}]) as n from o)
        select n.kind as kind, n.name as name, cast(t as timestamp) as time from n""",
}
