"""Queries of the general training-data problems 1, 3, 4, 5 and 6 over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rainloom.operators import anomalies, near, regular_grid, schema_drift, units
from rainloom.session import table

#: Largest possible amounts in mm.
LIMITS = {"rr1": 500.0, "rr6": 150.0}


def grid_of_deployments(spark: SparkSession, folder: str, common_units: bool = True) -> DataFrame:
    """Regular series of precipitation and rain_rate; rates are in mm/h if ``common_units``."""
    gauge = table(spark, folder, "gauge_series").select("poste", F.lit("precipitation").alias("field"), "time", F.col("precipitation").alias("value"))
    radar, deployments = table(spark, folder, "radar_rain"), table(spark, folder, "deployments")
    if common_units:
        conversions = units.UnitGraph.from_codes(table(spark, folder, "unit_codes")).table(spark, ["mm_h"])
        rows = units.radar_readings(radar).where(units.usable(F.col("value")))
        rain = units.to_common_units(units.with_recorded_unit(rows, deployments, "rate"), conversions, "mm_h").select("poste", "field", "time", F.col("value_common").alias("value"))
    else:
        rain = radar.select("poste", F.lit("rain_rate").alias("field"), "time", F.col("rain_rate").alias("value"))
    return regular_grid.regular_grid(gauge.unionByName(rain), deployments.where("field in ('precipitation', 'rain_rate')"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return regular_grid.missing_slots(grid_of_deployments(spark, folder, common_units=False))


def p1_status(spark: SparkSession, folder: str) -> DataFrame:
    """Every slot with its status; the value where it was observed, as recorded."""
    grid = grid_of_deployments(spark, folder, common_units=False)
    value = F.when(F.col("status") == "observed", F.round("value", 6))
    return grid.select("deployment_id", "poste", "field", "slot_epoch", "n_readings", "status", value.alias("value"))


def implausible_records(spark: SparkSession, folder: str) -> DataFrame:
    mf, deployments = table(spark, folder, "mf_data"), table(spark, folder, "deployments")
    conversions = units.UnitGraph.from_codes(table(spark, folder, "unit_codes")).table(spark, ["mm"])
    six = units.with_recorded_unit(units.mf_readings(mf, ["rr6"]), deployments, "depth")
    six = units.to_common_units(six, conversions, "mm").select("row_id", "poste", "field", "time", F.col("value_common").alias("value"))
    hour = mf.where("rr1 is not null").select(F.col("obs_id").alias("row_id"), "poste", F.lit("rr1").alias("field"), "time", F.col("rr1").alias("value"))
    return anomalies.implausible(six.unionByName(hour), LIMITS)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return implausible_records(spark, folder).where("anomaly").select(F.col("row_id").alias("obs_id"), "field")


def p3_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Impossible and stuck readings of both fields, values as recorded."""
    rows = units.mf_readings(table(spark, folder, "mf_data"), ["rr1", "rr6"]).select("row_id", "poste", "field", "time", "value")
    x = anomalies.implausible(rows, LIMITS).where("impossible or stuck")
    return x.select(F.col("row_id").alias("obs_id"), "field", "impossible", "stuck")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = near.near_pairs(near.station_positions(table(spark, folder, "station_metadata")), 2000.0)
    return pairs.select(F.col("id_a").alias("poste_a"), F.col("id_b").alias("poste_b"))


def harmonised_values(spark: SparkSession, folder: str) -> DataFrame:
    return units.harmonised(*[table(spark, folder, t) for t in ("mf_data", "radar_rain", "deployments", "unit_codes")])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return harmonised_values(spark, folder).where("unit_code not in ('mm', 'mm_h')").select("table_name", "row_id", "field", "unit_code")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return schema_drift.schema_changes(table(spark, folder, "mf_files")).select("file_id", "change_kind", "field_name")


def p6_records(spark: SparkSession, folder: str) -> DataFrame:
    return schema_drift.unified_records(table(spark, folder, "mf_files"))


def p6_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Per file: records read, and those with a station, with a time, and with any measured value."""
    x = schema_drift.file_records(table(spark, folder, "mf_files"))
    some = F.coalesce(*[F.col(c).cast("string") for c in schema_drift.NUMBERS], F.col("quality")).isNotNull() | (F.size("other") > 0)
    return x.groupBy("file_id").agg(F.count("*").alias("n_records"), F.count("poste").alias("n_poste"), F.count("time").alias("n_time"), F.count_if(some).alias("n_filled"))


QUERIES = {
    "p1_found": p1_found,
    "p1_grid": grid_of_deployments,
    "p1_status": p1_status,
    "p3_found": p3_found,
    "p3_rules": p3_rules,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_values": harmonised_values,
    "p6_found": p6_found,
    "p6_records": p6_records,
    "p6_counts": p6_counts,
}

# degrees and minutes and seconds with sign or letter, the two halves of a text position
_HALF = r"""([-+\u2212]?)(\d+(?:[.,]\d+)?) ?\u00b0? ?(?:(\d+(?:[.,]\d+)?) ?[\'\u2032\u2019] ?)?(?:(\d+(?:[.,]\d+)?) ?(?:"|\u2033|\u201d|\'\') ?)?""".replace("\\'", "''")
for _c in "\u2212\u00b0\u2032\u2019\u2033\u201d":
    _HALF = _HALF.replace(f"\\u{ord(_c):04x}", _c)
_TEXT = f"^ *{_HALF}([NSns]?)[ ,;/]+{_HALF}([EWOewo]?) *$"
_PART = lambda i: f"coalesce(try_cast(replace(g.g{i}, ',', '.') as double), 0.0)"

ORACLE = {
    # a record's values beside station and time: there must be two texts of their kinds, the rest counts
    "p6_counts": r"""
        with l as (
          select file_id, list_filter(regexp_split_to_array(regexp_replace(content, '^\ufeff+', ''), '\r\n|\r|\n'), lambda x: not regexp_matches(x, '^\s*(#|$)')) as l
          from mf_files where file_id is not null and series is not null and trim(content) <> ''),
        s as (
          select file_id, l, [c for c in [';', chr(9), '|', ','] if len(string_split(l[1], c)) = list_max([len(string_split(l[1], d)) for d in [';', chr(9), '|', ',']])][1] as c from l where len(l) > 0),
        r as (select file_id, unnest([[trim(v, ' "') for v in string_split(x, c)] for x in l[2:]]) as v from s),
        k as (
          select file_id, [v for v in v if not regexp_matches(v, '^(\d{4}-\d\d-\d\d[T ]\d\d.*|\d{10}|\d{12}|\d\d/\d\d/\d{4} \d\d.*)$') and not regexp_matches(v, '^[A-Za-z]{0,2}\d{7,9}(-[A-Za-z0-9])?$')] as rest,
                 len([v for v in v if regexp_matches(v, '^(\d{4}-\d\d-\d\d[T ]\d\d.*|\d{10}|\d{12}|\d\d/\d\d/\d{4} \d\d.*)$')]) > 0 as t,
                 len([v for v in v if regexp_matches(v, '^[A-Za-z]{0,2}\d{7,9}(-[A-Za-z0-9])?$')]) > 0 as p
          from r)
        select file_id, count(*) as n_records, count(*) filter (p) as n_poste, count(*) filter (t) as n_time,
               count(*) filter (len([v for v in rest if lower(v) not in ('', 'mq', '-', 'na', 'nan', 'null')]) > 0) as n_filled
        from k group by file_id""".replace("\\ufeff", "\ufeff"),
    "p4_found": f"""
        with t as (
          select poste, lat, lon, regexp_extract(coordinates, '{_TEXT}', ['g1', 'g2', 'g3', 'g4', 'g5', 'g6', 'g7', 'g8', 'g9', 'g10']) as g,
                 coalesce(regexp_matches(coordinates, '{_TEXT}'), false) as ok from station_metadata),
        u as (
          select poste,
                 case when lat is not null and lon is not null and not isnan(lat) and not isnan(lon) then lat
                      when ok and {_PART(3)} < 60 and {_PART(4)} < 60 and {_PART(8)} < 60 and {_PART(9)} < 60
                      then case when g.g1 in ('-', '\u2212') or upper(g.g5) = 'S' then -1 else 1 end * ({_PART(2)} + {_PART(3)} / 60 + {_PART(4)} / 3600) end as a,
                 case when lat is not null and lon is not null and not isnan(lat) and not isnan(lon) then lon
                      when ok and {_PART(3)} < 60 and {_PART(4)} < 60 and {_PART(8)} < 60 and {_PART(9)} < 60
                      then case when g.g6 in ('-', '\u2212') or upper(g.g10) in ('W', 'O') then -1 else 1 end * ({_PART(7)} + {_PART(8)} / 60 + {_PART(9)} / 3600) end as o
          from t),
        p as (
          select distinct poste, radians(a) as a, radians(case when o > 180 then o - 360 else o end) as o from u
          where poste is not null and a between -90 and 90 and o between -180 and 360 and not (a = 0 and o = 0))
        select distinct x.poste as poste_a, y.poste as poste_b
        from p x join p y on x.poste < y.poste and abs(x.a - y.a) <= 0.00032
          and 2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin((y.a - x.a) / 2), 2) + cos(x.a) * cos(y.a) * pow(sin((y.o - x.o) / 2), 2)))) <= 2000""",
    "p3_rules": """
        with x as (
          select obs_id, poste, field, epoch_us(time) as us, round(value, 9) as v, case when field = 'rr1' then 500 else 150 end as most
          from (select obs_id, poste, 'rr1' as field, time, rr1 as value from mf_data union all select obs_id, poste, 'rr6', time, rr6 from mf_data)
          where value is not null and not isnan(value) and time is not null and poste is not null),
        y as (select *, lag(v) over w as pv, lag(us) over w as pu from x window w as (partition by poste, field order by us, v, obs_id)),
        z as (select *, sum(case when pv is distinct from v then 1 else 0 end) over (partition by poste, field order by us, v, obs_id rows unbounded preceding) as island,
                     coalesce(pv = v and pu = us, false) as repeated from y),
        r as (select *, sum(case when repeated then 0 else 1 end) over (partition by poste, field, island) as run, v < 0 or v > most as impossible from z),
        f as (select obs_id, field, impossible, run >= 10 and v > 0 and not impossible as stuck from r)
        select * from f where impossible or stuck""",
    # slots of a deployment in a block of 8 days; windows of 12 slots begin every 4 and at the end
    "p1_status": """
        with d as (
          select deployment_id, poste, field, cast(step_min as bigint) * 60000000 as s, epoch_us(active_from) as a,
                 (epoch_us(active_to) - epoch_us(active_from)) // (cast(step_min as bigint) * 60000000) as n
          from deployments where field in ('precipitation', 'rain_rate')),
        slots as (
          select *, row_number() over (partition by deployment_id, block order by b) - 1 as i, count(*) over (partition by deployment_id, block) as m
          from (select deployment_id, poste, field, s, a + k * s as b, (a + k * s) // 691200000000 as block from d, unnest(range(0, n)) as u(k))),
        r as (
          select poste, 'precipitation' as field, epoch_us(time) as us, precipitation as v from gauge_series where precipitation >= 0 and not isnan(precipitation)
          union all
          select poste, 'rain_rate', epoch_us(time), rain_rate from radar_rain where rain_rate >= 0 and not isnan(rain_rate)),
        c as (
          select t.deployment_id, t.poste, t.field, t.block, t.b, t.i, t.m, count(r.v) as n, avg(r.v) as v
          from slots t left join r on r.poste = t.poste and r.field = t.field and r.us >= t.b and r.us < t.b + t.s
          group by all),
        w as (
          select deployment_id, block, least(4 * j, greatest(m - 12, 0)) as first
          from (select deployment_id, block, any_value(m) as m from c group by all), unnest(range(0, (greatest(m - 12, 0) + 3) // 4 + 1)) as u(j)),
        good as (
          select w.deployment_id, w.block, w.first from w join c on c.deployment_id = w.deployment_id and c.block = w.block and c.i between w.first and w.first + 11 and c.n > 0
          group by all having count(*) >= 3)
        select deployment_id, poste, field, cast(b // 1000000 as bigint) as slot_epoch, cast(n as integer) as n_readings,
               case when n > 0 then 'observed' when exists (select 1 from good g where g.deployment_id = c.deployment_id and g.block = c.block and c.i between g.first and g.first + 11)
                 then 'filled' else 'unsupported' end as status,
               round(v, 6) as value
        from c""",
    "p1_found": """
        with d as (
          select poste, field, step_min, epoch_us(active_from) as a,
                 (epoch_us(active_to) - epoch_us(active_from)) // (cast(step_min as bigint) * 60000000) as n
          from deployments where field in ('precipitation', 'rain_rate')),
        slots as (
          select poste, field, a + k * cast(step_min as bigint) * 60000000 as a, a + (k + 1) * cast(step_min as bigint) * 60000000 as b
          from d, unnest(range(0, n)) as u(k)),
        r as (
          select poste, 'precipitation' as field, epoch_us(time) as us from gauge_series where precipitation >= 0 and not isnan(precipitation)
          union all
          select poste, 'rain_rate', epoch_us(time) from radar_rain where rain_rate >= 0 and not isnan(rain_rate))
        select s.poste, s.field, cast(s.a // 1000000 as bigint) as slot_epoch
        from slots s anti join r on r.poste = s.poste and r.field = s.field and r.us >= s.a and r.us < s.b""",
}
