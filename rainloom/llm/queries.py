"""Queries of the problems tagged llm: 2, 7, 8, 9 and 10, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rainloom.llm import leaks, nearest_time, packing, rank_sketch
from rainloom.llm import sentences as sentence_units
from rainloom.operators import units
from rainloom.session import table


#: Where the vocabulary files of the public tokenizers lie.
TOKENIZERS = "/opt/tokenizers"


def _text_rows(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Documents; dealt out anew, the one shuffle of their texts, only where the files give fewer partitions than there are cores."""
    docs = table(spark, folder, "documents").select(*columns)
    want = spark.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= want else docs.repartition(3 * want)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    mf = table(spark, folder, "mf_data").where("rr6 is not null")
    radar = table(spark, folder, "radar_rain").where(units.usable(F.col("rain_rate")))
    return nearest_time.match_nearest_time(mf, radar, "poste", "obs_id", "rate_id", "time", "time", 180_000_000).select("obs_id", "rate_id")


def _sketches(spark: SparkSession, folder: str) -> DataFrame:
    radar, deployments = table(spark, folder, "radar_rain"), table(spark, folder, "deployments")
    conversions = units.UnitGraph.from_codes(table(spark, folder, "unit_codes")).table(spark, ["mm_h"])
    rows = units.with_recorded_unit(units.radar_readings(radar).where(units.usable(F.col("value"))), deployments, "rate")
    rain = units.to_common_units(rows, conversions, "mm_h").select("poste", "time", F.col("value_common").alias("value"))
    values = rank_sketch.imerg_values(table(spark, folder, "imerg_grid")).unionByName(rank_sketch.rain_values(rain))
    return rank_sketch.day_sketches(values)


def p7_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles per grid cell and station over all days, from merged sketches of days."""
    return rank_sketch.percentiles(rank_sketch.merged(_sketches(spark, folder), ["kind", "key"]))


def p7_daily(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of each day over all cells, and over all stations."""
    return rank_sketch.percentiles(rank_sketch.merged(_sketches(spark, folder), ["kind", "day"]))


def p7_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of each grid cell held against exact ranks over all its values."""
    values = rank_sketch.imerg_values(table(spark, folder, "imerg_grid"))
    return rank_sketch.rank_checks(values, rank_sketch.percentiles(rank_sketch.merged(rank_sketch.day_sketches(values), ["kind", "key"])))


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.document_containers(_text_rows(spark, folder, "doc_id", "text"), TOKENIZERS)


def p8_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Each document with whether it stands in containers whole: once, without gaps, cut only if it must be, none overfull."""
    x = p8_containers(spark, folder)
    size = packing.CAPACITY
    full = x.groupBy("container_id").agg((F.sum("n_tokens") <= size).alias("fits"))
    x = x.join(full, "container_id").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens"), F.sort_array(F.collect_list("start_token")).alias("starts"), F.min("fits").alias("fits"))
    gaps = F.forall(F.transform("starts", lambda s, i: s == i * size), lambda ok: ok)
    return x.select("doc_id", (F.col("fits") & gaps & (F.col("n") == F.ceil(F.col("tokens") / size))).alias("whole"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked_items(_text_rows(spark, folder, "doc_id", "text"), table(spark, folder, "benchmark")).select("doc_id", "item_id")


def p10_restored(spark: SparkSession, folder: str) -> DataFrame:
    """Each document put together again from its units, blanks aside: number of characters and a digest."""
    x = sentence_units.sentences(_text_rows(spark, folder, "doc_id", "text"))
    x = x.withColumn("sentence", F.translate("sentence", sentence_units.BLANKS, ""))
    whole = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("start_pos", "sentence"))), lambda u: u["sentence"]))
    return x.groupBy("doc_id").agg(whole.alias("t")).select("doc_id", F.char_length("t").cast("long").alias("n_chars"), F.md5("t").alias("digest"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentence_units.sentences(_text_rows(spark, folder, "doc_id", "text")).select("doc_id", "start_pos", "end_pos")


QUERIES = {f.__name__: f for f in (p2_found, p7_percentiles, p7_daily, p7_bounds, p8_containers, p8_documents, p9_found, p10_found, p10_restored)}

_BLANKS = "' ' || " + " || ".join(f"chr({ord(c)})" for c in sentence_units.BLANKS if c != " ")

ORACLE = {
    "p7_bounds": f"""
        with v as (
          select printf('%.4f,%.4f', lat, lon) as key, time, arg_min(precipitationcal, case when run_type = 'final' then 0 else 1 end) as v
          from imerg_grid where time is not null and lat is not null and lon is not null and precipitationcal >= 0 and not isnan(precipitationcal)
          group by key, time)
        select 'precipitationcal' as kind, key, q, count(*) as n, true as within
        from v, (select unnest({rank_sketch.QUANTILES!r}) as q) group by key, q""",
    "p8_documents": "select doc_id, true as whole from documents where text is not null and text <> ''",
    "p10_restored": f"""
        select doc_id, cast(length(t) as bigint) as n_chars, md5(t) as digest
        from (select doc_id, translate(text, {_BLANKS}, '') as t from documents where text is not null) where t <> ''""",
    "p2_found": """
        select obs_id, rate_id from (
          select m.obs_id, r.rate_id,
                 row_number() over (partition by m.obs_id order by abs(epoch_us(r.time) - epoch_us(m.time)), r.time, r.rate_id) as k
          from mf_data m join radar_rain r
            on m.poste = r.poste and epoch_us(r.time) between epoch_us(m.time) - 180000000 and epoch_us(m.time) + 180000000
          where m.rr6 is not null and r.rain_rate >= 0 and not isnan(r.rain_rate))
        where k = 1""",
}
