"""Queries of the analytics operators over the driver's tables, and the SQL each must agree with."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rainloom.functions import metrics as M
from rainloom.functions import scalar as S
from rainloom.operators import accumulate, align, cluster, fusion, interp, scores, space
from rainloom.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


# ---- stand-in views: an hourly rain series, a monthly cube, value pairs, stations -------------------------


def rain(spark: SparkSession, d: str) -> DataFrame:
    t = F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz")
    return table(spark, d, "events").groupBy(t.alias("time"), F.col("event_type").alias("pixel")).agg(F.round(F.avg("value") / 100, 9).alias("rate"))


def grid(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_shipdate", "l_quantity", "l_extendedprice")
    x = li.join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    x = x.join(table(spark, d, "part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    t = F.date_trunc("month", F.col("l_shipdate")).cast("timestamp_ntz")
    g = x.groupBy(t.alias("time"), F.col("s_nationkey").cast("double").alias("lat"), (F.col("p_size") % 10).cast("double").alias("lon"))
    return g.agg(F.round(F.avg("l_quantity"), 9).alias("radar"), F.round(F.avg("l_extendedprice") / 2000, 9).alias("sat"))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("obs"), (F.col("l_extendedprice") / 2000).alias("sim"), "l_orderkey")


def sparse(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).withColumn("sim", F.when(F.col("l_orderkey") % 7 != 0, F.col("sim")))


def stations(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("id"), (F.lit(-6.0) + (k % 20) * 0.1).alias("lat"), (F.lit(-40.0) + F.floor(k / 20) * 0.1).alias("lon"))


_RAIN = "rain as (select date_trunc('hour', ts) as time, event_type as pixel, round(avg(value) / 100, 9) as rate from events group by 1, 2)"
_GRID = """grid as (select cast(date_trunc('month', l_shipdate) as timestamp) as time, cast(s_nationkey as double) as lat, cast(p_size % 10 as double) as lon,
    round(avg(l_quantity), 9) as radar, round(avg(l_extendedprice) / 2000, 9) as sat
  from lineitem join supplier on l_suppkey = s_suppkey join part on l_partkey = p_partkey group by 1, 2, 3)"""
_PAIRS = "pairs as (select l_returnflag as flag, l_quantity as obs, l_extendedprice / 2000 as sim, l_orderkey from lineitem)"
_STATIONS = "stations as (select s_suppkey as id, -6.0::double + (s_suppkey % 20) * 0.1::double as lat, -40.0::double + (s_suppkey // 20) * 0.1::double as lon from supplier)"
_HOURS = """hours as (select pixel, day, h, cast(day as timestamp) + h * interval 1 hour as time
  from (select distinct pixel, cast(time as date) as day from rain), range(0, 24) as r(h))"""
_SERIES = f"""{_RAIN}, {_HOURS}, s as (select hours.*, rate from hours left join rain using (pixel, time)),
 a as (select *,
   last_value(case when rate is not null then h end ignore nulls) over b as ph, last_value(rate ignore nulls) over b as pv,
   first_value(case when rate is not null then h end ignore nulls) over n as nh, first_value(rate ignore nulls) over n as nv
   from s window b as (partition by pixel, day order by h rows between unbounded preceding and 1 preceding),
                 n as (partition by pixel, day order by h rows between 1 following and unbounded following)),
 e as (select *,
   last_value(case when rate is not null then ph end ignore nulls) over b as ph2, last_value(case when rate is not null then pv end ignore nulls) over b as pv2,
   first_value(case when rate is not null then nh end ignore nulls) over n as nh2, first_value(case when rate is not null then nv end ignore nulls) over n as nv2
   from a window b as (partition by pixel, day order by h rows between unbounded preceding and 1 preceding),
                 n as (partition by pixel, day order by h rows between 1 following and unbounded following))"""
_LINEAR = """case when rate is not null then rate
   when ph is not null and nh is not null then pv + (nv - pv) * (h - ph) / (nh - ph)
   when ph is null and nh2 is not null then nv + (nv2 - nv) * (h - nh) / (nh2 - nh)
   when nh is null and ph2 is not null then pv2 + (pv - pv2) * (h - ph2) / (ph - ph2)
   else coalesce(pv, nv) end"""


def r6(c) -> "F.Column":
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6)


# ---- accumulation ---------------------------------------------------------------------------------------


@query(
    f"""with {_SERIES}, f as (select pixel, day, {_LINEAR} as v from e), c as (select pixel, day, count(rate) as n from s group by 1, 2)
    select f.pixel, f.day, round(sum(v), 8) as daily_accumulation, round(count(v) / 24.0, 6) as valid_fraction, any_value(c.n) >= 20 as is_complete
    from f join c on f.pixel = c.pixel and f.day = c.day group by 1, 2"""
)
def daily_accumulation(spark: SparkSession, d: str) -> DataFrame:
    x = rain(spark, d)
    filled = accumulate.gap_filled(x, ["pixel"], "rate", 24, "linear", max_gap_steps=0)
    amounts = accumulate.daily_accumulation(filled, ["pixel"], "rate", 1.0, 24)
    report = accumulate.completeness(x, "gsmap", ["pixel"]).select("pixel", "day", "is_complete")
    return amounts.join(report, ["pixel", "day"]).select("pixel", "day", F.round("daily_accumulation", 8).alias("daily_accumulation"), r6("valid_fraction").alias("valid_fraction"), "is_complete")


@query(
    f"""with {_RAIN}, {_HOURS}
    select h.pixel, h.day, 24 as expected, cast(count(r.rate) as int) as actual, cast(24 - count(r.rate) as int) as missing,
      round((24 - count(r.rate)) / 24.0, 6) as missing_fraction, (24 - count(r.rate)) / 24.0 <= 0.2 as is_complete
    from hours h left join rain r on h.pixel = r.pixel and h.time = r.time group by 1, 2"""
)
def completeness_report(spark: SparkSession, d: str) -> DataFrame:
    x = accumulate.completeness(rain(spark, d), "gsmap", ["pixel"])
    return x.select("pixel", "day", "expected", "actual", "missing", r6("missing_fraction").alias("missing_fraction"), "is_complete")


def _fill(spark: SparkSession, d: str, method: str) -> DataFrame:
    x = accumulate.gap_filled(rain(spark, d), ["pixel"], "rate", 24, method, max_gap_steps=0)
    return x.select("pixel", "day", "time", F.round("rate", 11).alias("rate"), "was_missing")


_FILL = f"with {_SERIES} select pixel, day, time, round({{}}, 11) as rate, rate is null as was_missing from e"


@query(_FILL.format(_LINEAR))
def gap_fill_linear(spark: SparkSession, d: str) -> DataFrame:
    return _fill(spark, d, "linear")


@query(_FILL.format("coalesce(rate, pv, nv)"))
def gap_fill_previous(spark: SparkSession, d: str) -> DataFrame:
    return _fill(spark, d, "previous")


@query(_FILL.format("coalesce(rate, 0)"))
def gap_fill_zero(spark: SparkSession, d: str) -> DataFrame:
    return _fill(spark, d, "zero")


@query(_FILL.format("coalesce(rate, case when h - ph <= nh - h then pv else coalesce(nv, pv) end)"))
def gap_fill_nearest(spark: SparkSession, d: str) -> DataFrame:
    return _fill(spark, d, "nearest")


@query(
    f"""with {_SERIES}, i as (select *, row_number() over (partition by pixel, day order by h) - row_number() over (partition by pixel, day, rate is null order by h) as g from s)
    select pixel, day, time, rate is null and count(*) over (partition by pixel, day, rate is null, g) > 2 as large_gap from i"""
)
def large_gap_mask(spark: SparkSession, d: str) -> DataFrame:
    return accumulate.gap_filled(rain(spark, d), ["pixel"], "rate", 24, "zero").select("pixel", "day", "time", "large_gap")


@query(
    f"""with {_GRID}, sp as (select (max(lon) - min(lon)) / (count(distinct lon) - 1) as s from grid)
    select time, round_even(lat, greatest(0, cast(ceil(-log10(0.005 * s)) as int) - 1)) as lat, round_even(lon, greatest(0, cast(ceil(-log10(0.005 * s)) as int) - 1)) as lon, radar from grid, sp"""
)
def normalise_grid(spark: SparkSession, d: str) -> DataFrame:
    return accumulate.normalised(grid(spark, d).withColumnsRenamed({"lat": "latitude", "lon": "longitude"}).select("time", "latitude", "longitude", "radar"))


@query(
    f"""with {_RAIN}, x as (select pixel, epoch_us(time) - lag(epoch_us(time)) over (partition by pixel order by time) as us from rain)
    select pixel, quantile_cont(us / 1e6, 0.5) as step_seconds from x group by 1"""
)
def step_length(spark: SparkSession, d: str) -> DataFrame:
    return accumulate.time_step(rain(spark, d), by=["pixel"])


# ---- scores ---------------------------------------------------------------------------------------------

_COMPLETE = f"with {_PAIRS}, z as (select flag, obs, case when l_orderkey % 7 <> 0 then sim end as sim from pairs), c as (select * from z where obs is not null and sim is not null)"


def _score(name: str):
    def f(spark: SparkSession, d: str) -> DataFrame:
        return pairs(spark, d).groupBy("flag").agg(r6(M.SCORES[name](F.col("obs"), F.col("sim"))).alias("value"))

    f.__name__ = f"score_{name}"
    return f


for _name, _sql in {
    "correlation": "corr(obs, sim)",
    "rmse": "sqrt(avg((obs - sim) * (obs - sim)))",
    "rbias": "(sum(sim) - sum(obs)) / sum(obs)",
    "kge": "1 - sqrt(power(corr(obs, sim) - 1, 2) + power(stddev_pop(obs) / avg(obs) - stddev_pop(sim) / avg(sim), 2) + power(avg(obs) / avg(sim) - 1, 2))",
    "r2": "1 - sum((obs - sim) * (obs - sim)) / (var_pop(obs) * count(obs))",
}.items():
    query(f"with {_PAIRS} select flag, round({_sql}, 6) as value from pairs group by 1")(_score(_name))


@query(
    f"""{_COMPLETE}, k as (select flag, count(*) filter (sim is null) as gone from z group by 1)
    select z.flag, case when any_value(gone) = 0 then round(corr(obs, sim), 6) end as correlation, round((sum(sim) - sum(obs)) / sum(obs), 6) as rbias,
      round(1 - sum((obs - sim) * (obs - sim)) / (var_pop(obs) * count(obs)), 6) as r2 from z join k on z.flag = k.flag group by 1"""
)
def scores_with_missing(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("obs"), F.col("sim")
    return sparse(spark, d).groupBy("flag").agg(r6(M.correlation(a, b, False)).alias("correlation"), r6(M.relative_bias(a, b, False)).alias("rbias"), r6(M.r2(a, b, False)).alias("r2"))


@query(
    f"""with {_GRID}, s as (select corr(radar, sat) as correlation, sqrt(avg((radar - sat) * (radar - sat))) as rmse, (sum(sat) - sum(radar)) / sum(radar) as rbias from grid)
    select 'sat' as variable, metric, round(value, 6) as value from s unpivot (value for metric in (correlation, rmse, rbias))"""
)
def score_table(spark: SparkSession, d: str) -> DataFrame:
    x = scores.score_table(grid(spark, d), "radar", ["sat"], ["correlation", "rmse", "rbias"])
    return x.select("variable", "metric", r6("value").alias("value"))


@query(f"with {_GRID} select round(case when avg(power(radar - sat, 2)) = 0 then 100 else 20 * log10(greatest(max(radar), max(sat)) / sqrt(avg(power(radar - sat, 2)))) end, 6) as psnr from grid")
def psnr(spark: SparkSession, d: str) -> DataFrame:
    return grid(spark, d).agg(r6(M.psnr(F.col("radar"), F.col("sat"))).alias("psnr"))


_CONT = "count(*) filter (radar > t and sat > {d}) as tp, count(*) filter (radar < t and sat > {d}) as fp, count(*) filter (radar > t and sat < {d}) as fn, count(*) filter (radar < t and sat < {d}) as tn"


@query(
    f"""with {_GRID}, c as (select t as threshold, {_CONT.format(d="0.2")} from grid, (values (15.0::double), (20.0), (25.0)) as v(t) group by 1)
    select threshold, tp, fp, fn, tn, round(tp / nullif(tp + fn, 0), 6) as pod, round(tn / nullif(fn + tn, 0), 6) as pond, round(fp / nullif(fp + tp, 0), 6) as far from c"""
)
def score_contingency(spark: SparkSession, d: str) -> DataFrame:
    x = scores.contingency_scores(grid(spark, d), "radar", "sat", [15.0, 20.0, 25.0])
    return x.select("threshold", "tp", "fp", "fn", "tn", r6("pod").alias("pod"), r6("pond").alias("pond"), r6("far").alias("far"))


@query(
    f"""with {_GRID}, c as (select time, {_CONT.format(d="t")}, count(*) filter (radar > t) as above from grid, (values (20.0::double)) as v(t) group by 1)
    select time, tp, fp, fn, tn, round(tp / nullif(above, 0), 6) as pod, round(fp / nullif(fp + tp, 0), 6) as far, round(fp / nullif(fp + tn, 0), 6) as pofd from c"""
)
def contingency_timewise(spark: SparkSession, d: str) -> DataFrame:
    x = scores.contingency_timewise(grid(spark, d), "radar", "sat", 20.0)
    return x.select("time", "tp", "fp", "fn", "tn", r6("pod").alias("pod"), r6("far").alias("far"), r6("pofd").alias("pofd"))


_DETECT = """select t as threshold, round(count(*) filter (radar > t and sat > t) / nullif(count(*) filter (radar > t), 0), 6) as pod,
  round(1 - count(*) filter (radar < t and sat > t) / nullif(count(*) filter (radar < t), 0), 6) as one_minus_pofd,
  round(count(*) filter (radar < t and sat > t) / nullif(count(*) filter (radar < t), 0), 6) as pofd from {}, (values (22.0::double), (25.0), (28.0)) as v(t) group by 1"""


def _detect(spark: SparkSession, d: str, area: bool) -> DataFrame:
    x = scores.threshold_detection(grid(spark, d), "radar", "sat", [22.0, 25.0, 28.0], area)
    return x.select("threshold", r6("pod").alias("pod"), r6("one_minus_pofd").alias("one_minus_pofd"), r6("pofd").alias("pofd"))


@query(f"with {_GRID} " + _DETECT.format("grid"))
def contingency_pixel(spark: SparkSession, d: str) -> DataFrame:
    return _detect(spark, d, False)


@query(f"with {_GRID}, m as (select time, avg(radar) as radar, avg(sat) as sat from grid group by 1) " + _DETECT.format("m"))
def contingency_area(spark: SparkSession, d: str) -> DataFrame:
    return _detect(spark, d, True)


_CORR = "with " + _GRID + ", m as (select time, {} as a, {} as b from grid group by 1) select round(corr(a, b), 6) as value from m"


def _corr(spark: SparkSession, d: str, how) -> DataFrame:
    return scores.series_correlation(grid(spark, d), "radar", "sat", how).select(r6("value").alias("value"))


@query(_CORR.format("count(*) filter (radar > 25)", "count(*) filter (sat > 25)"))
def support_size_corr(spark: SparkSession, d: str) -> DataFrame:
    return _corr(spark, d, scores.support_size(25.0))


@query(_CORR.format("avg(radar)", "avg(sat)"))
def spatial_avg_corr(spark: SparkSession, d: str) -> DataFrame:
    return _corr(spark, d, scores.spatial_average)


@query(_CORR.format("stddev_pop(radar) / avg(radar)", "stddev_pop(sat) / avg(sat)"))
def coeff_var_corr(spark: SparkSession, d: str) -> DataFrame:
    return _corr(spark, d, scores.variation)


@query(_CORR.format("sum(case when radar > 25 then radar else 0 end)", "sum(case when sat > 25 then sat else 0 end)"))
def corr_above_threshold(spark: SparkSession, d: str) -> DataFrame:
    return _corr(spark, d, scores.sum_above(25.0))


@query(f"with {_GRID} select time, count(*) filter (radar > 25) as radar, count(*) filter (sat > 25) as sat from grid group by 1")
def count_over_threshold(spark: SparkSession, d: str) -> DataFrame:
    return scores.per_time(grid(spark, d), {"radar": scores.count_over("radar", 25.0), "sat": scores.count_over("sat", 25.0)})


@query(f"with {_GRID} select time, round(avg(radar), 6) as radar, round(avg(case when sat > 25 then sat end), 6) as sat from grid group by 1")
def average_over_domain(spark: SparkSession, d: str) -> DataFrame:
    return scores.per_time(grid(spark, d), {"radar": r6(scores.domain_average("radar")), "sat": r6(scores.domain_average("sat", 25.0))})


@query(f"with {_GRID} select time, round(quantile_cont(case when sat > 20 then sat end, 0.5) - quantile_cont(case when radar > 20 then radar end, 0.5), 6) as distance from grid group by 1")
def dist_to_median(spark: SparkSession, d: str) -> DataFrame:
    return scores.distance_to_median(grid(spark, d), "sat", "radar").select("time", r6("distance").alias("distance"))


@query(f"with {_GRID} select time, round(quantile_cont(radar, 0.25), 6) as q_low, round(quantile_cont(radar, 0.5), 6) as median, round(quantile_cont(radar, 0.75), 6) as q_high from grid where radar > 0 group by 1")
def median_quantile_band(spark: SparkSession, d: str) -> DataFrame:
    x = grid(spark, d).groupBy("time").agg(*scores.band("radar"))
    return x.select("time", r6("q_low").alias("q_low"), r6("median").alias("median"), r6("q_high").alias("q_high"))


@query(
    f"""with {_GRID}, n as (select time, count(sat) as n from grid group by 1), f as (select arg_min(n, time) as n0 from n)
    select time, round(avg(sat), 6) as spm, round(count(*) filter (sat > 25) / any_value(n0), 6) as sup, round(stddev_pop(sat), 6) as std, round(stddev_pop(sat) / avg(sat), 6) as cvr from grid, f group by 1"""
)
def cluster_features(spark: SparkSession, d: str) -> DataFrame:
    x = scores.cluster_features(grid(spark, d), "sat", 25.0)
    return x.select("time", *[r6(c).alias(c) for c in ("spm", "sup", "std", "cvr")])


@query()
def cluster_correction(spark: SparkSession, d: str) -> DataFrame:
    """Each weather type gets its own fit by parts, per land and sea, with ten thousand quantiles."""
    g = grid(spark, d)
    fuser = fusion.Fuser("qmatch_by_parts", "radar", "sat", land=(F.col("lat") + F.col("lon")) % 2 == 0)
    return cluster.corrected(g, "sat", cluster.fit_clusters(g, "sat"), fuser).drop("label")


_CENTRES = [[10.0, 0.2, 5.0, 0.3], [20.0, 0.5, 8.0, 0.5], [30.0, 0.9, 12.0, 0.7]]
_NEAREST = ", ".join(f"power(coalesce(spm, 20) - {c[0]}, 2) + power(coalesce(sup, 20) - {c[1]}, 2) + power(coalesce(std, 20) - {c[2]}, 2) + power(coalesce(cvr, 20) - {c[3]}, 2)" for c in _CENTRES)


@query(
    f"""with {_GRID}, n as (select time, count(sat) as n from grid group by 1), f as (select arg_min(n, time) as n0 from n),
    x as (select time, avg(sat) as spm, count(*) filter (sat > 25) / any_value(n0) as sup, stddev_pop(sat) as std, stddev_pop(sat) / avg(sat) as cvr from grid, f group by 1),
    y as (select time, [{_NEAREST}] as d from x) select time, cast(list_position(d, list_min(d)) - 1 as integer) as label from y"""
)
def cluster_labels(spark: SparkSession, d: str) -> DataFrame:
    return cluster.nearest_centre(grid(spark, d), "sat", _CENTRES)


@query(
    """with a as (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings),
    p as (select a.vec_id as row_a, b.vec_id as row_b, corr(a.x, b.x) as r from a join a b on a.i = b.i where b.vec_id % 50 = 0 group by 1, 2)
    select row_a, row_b, round(r, 6) as r from p"""
)
def row_correlation_matrix(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return scores.row_correlations(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding").select("row_a", "row_b", r6("r").alias("r"))


@query(
    """with a as (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings), o as (select * from a where vec_id = (select min(vec_id) from embeddings))
    select a.vec_id as row_a, round(corr(a.x, o.x), 6) as r from a join o on a.i = o.i group by 1"""
)
def vector_row_correlation(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return scores.row_correlations(e, e.orderBy("vec_id").limit(1), "vec_id", "embedding").select("row_a", r6("r").alias("r"))


@query(
    """with r as (select min(l_quantity) as a, max(l_quantity) as b from lineitem),
    h as (select least(cast(floor((l_quantity - a) * 30 / (b - a)) as int), 29) as bin, count(*) as n from lineitem, r group by 1)
    select cast(g.bin as int) as bin, round(a + g.bin * (b - a) / 30, 6) as low, round(a + (g.bin + 1) * (b - a) / 30, 6) as high, coalesce(n, 0) as n from r, range(0, 30) as g(bin) left join h on h.bin = g.bin"""
)
def histogram(spark: SparkSession, d: str) -> DataFrame:
    x = scores.histogram(table(spark, d, "lineitem").select("l_quantity"), "l_quantity", 30)
    return x.select("bin", r6("low").alias("low"), r6("high").alias("high"), "n")


@query(
    f"""with {_PAIRS}, z as (select regr_slope(sim, obs) as s, regr_intercept(sim, obs) as i, regr_r2(sim, obs) as r2, regr_sxx(sim, obs) as sxx, regr_syy(sim, obs) as syy, count(*) as n from pairs)
    select round(s, 6) as slope, round(i, 6) as intercept, round(r2, 6) as r2, round(sqrt((1 - r2) * syy / ((n - 2) * sxx)), 6) as stderr, n from z"""
)
def linear_fit(spark: SparkSession, d: str) -> DataFrame:
    x = scores.linear_fit(pairs(spark, d), "obs", "sim")
    return x.select(*[r6(c).alias(c) for c in ("slope", "intercept", "r2", "stderr")], "n")


# ---- space ----------------------------------------------------------------------------------------------


@query(f"with {_GRID} select time, lat, lon, radar from grid where lat between 3 and 12 and lon between 2 and 6")
def bbox_select(spark: SparkSession, d: str) -> DataFrame:
    return space.in_box(grid(spark, d), space.BBox(3, 2, 12, 6)).select("time", "lat", "lon", "radar")


@query(f"with {_STATIONS} select round(min(lat), 6) as min_lat, round(min(lon), 6) as min_lon, round(max(lat), 6) as max_lat, round(max(lon), 6) as max_lon from stations")
def bbox_of(spark: SparkSession, d: str) -> DataFrame:
    x = space.bbox_frame(stations(spark, d))
    return x.select(*[r6(c).alias(c) for c in x.columns])


@query(f"with {_STATIONS} select round(min(lat) + (max(lat) - min(lat)) / 2, 6) as lat, round(min(lon) + (max(lon) - min(lon)) / 2, 6) as lon from stations")
def domain_center(spark: SparkSession, d: str) -> DataFrame:
    return space.center(stations(spark, d)).select(r6("lat").alias("lat"), r6("lon").alias("lon"))


@query(f"with {_GRID}, c as (select distinct lat, lon from grid) select (select lat from c order by abs(lat - 7.4), lat limit 1) as lat, (select lon from c order by abs(lon - 3.2), lon limit 1) as lon")
def nearest_cell(spark: SparkSession, d: str) -> DataFrame:
    return space.nearest_cell(grid(spark, d), 7.4, 3.2)


@query(f"with {_GRID}, c as (select distinct lat, lon from grid) select lat, lon from c order by greatest(abs(lat - 7.4), abs(lon - 3.2)), lat, lon limit 1")
def nearest_cell_chebyshev(spark: SparkSession, d: str) -> DataFrame:
    return space.nearest_cell(grid(spark, d), 7.4, 3.2, per_axis=False)


@query(f"with {_GRID}, c as (select (select lat from grid order by abs(lat - 7.4), lat limit 1) as a, (select lon from grid order by abs(lon - 3.2), lon limit 1) as o) select time, lat, lon, radar, sat from grid, c where lat = a and lon = o")
def point_series(spark: SparkSession, d: str) -> DataFrame:
    return space.at_point(grid(spark, d), 7.4, 3.2)


@query(
    f"""with {_GRID}, a as (select lat, row_number() over (order by lat) - 1 as r, count(*) over () as n from (select distinct lat from grid)),
    o as (select lon, row_number() over (order by lon) - 1 as r, count(*) over () as n from (select distinct lon from grid))
    select cast((o.r // greatest(1, o.n // 3)) * 2 + a.r // greatest(1, a.n // 2) as int) as block, count(*) as n, round(sum(radar), 4) as total
    from grid join a on a.lat = grid.lat join o on o.lon = grid.lon where a.r // greatest(1, a.n // 2) < 2 and o.r // greatest(1, o.n // 3) < 3 group by 1"""
)
def subdivide(spark: SparkSession, d: str) -> DataFrame:
    return space.subdivided(grid(spark, d), 2, 3).groupBy("block").agg(F.count("*").alias("n"), F.round(F.sum("radar"), 4).alias("total"))


@query(
    f"""with {_GRID}, a as (select lat, ntile(3) over (order by lat) - 1 as b from (select distinct lat from grid)), o as (select lon, ntile(3) over (order by lon) - 1 as b from (select distinct lon from grid))
    select cast(a.b * 3 + o.b as int) as block, count(*) as n, round(sum(radar), 4) as total from grid join a on a.lat = grid.lat join o on o.lon = grid.lon group by 1"""
)
def subdivide_whole(spark: SparkSession, d: str) -> DataFrame:
    return space.subdivided_whole(grid(spark, d), 3).groupBy("block").agg(F.count("*").alias("n"), F.round(F.sum("radar"), 4).alias("total"))


@query(f"with {_GRID} select time, lat, lon, case when (lat + lon) % 2 = 0 then radar end as radar_land, case when (lat + lon) % 2 <> 0 then radar end as radar_sea from grid")
def land_sea_split(spark: SparkSession, d: str) -> DataFrame:
    x = space.land_sea(grid(spark, d), (F.col("lat") + F.col("lon")) % 2 == 0, ["radar"])
    return x.select("time", "lat", "lon", "radar_land", "radar_sea")


@query(f"with {_GRID} select time, lat, lon, radar, (lat + lon) % 2 = 0 as is_land from grid")
def land_mask(spark: SparkSession, d: str) -> DataFrame:
    g = grid(spark, d)
    cells = g.select("lat", "lon").distinct().withColumn("is_land", (F.col("lat") + F.col("lon")) % 2 == 0)
    return space.masked(g, cells).select("time", "lat", "lon", "radar", "is_land")


# ---- alignment ------------------------------------------------------------------------------------------

_CV = "a as (select distinct ts as t1 from events where event_type = 'click'), b as (select distinct ts as t2 from events where event_type = 'view')"


@query(
    f"""with {_CV}, j as (select t2, coalesce(a.t1, (select max(t1) from a)) as t1 from b asof left join a on a.t1 >= b.t2)
    select t1, t2, make_timestamp(epoch_us(t1) + cast(floor((epoch_us(t1) - epoch_us(t2)) / 2.0) as bigint)) as stamp from j where abs(epoch_us(t1) - epoch_us(t2)) <= 360000000"""
)
def asof_align(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("ts", "event_type")
    return align.asof_forward(e.where("event_type = 'click'"), e.where("event_type = 'view'"), "ts", "ts", 360)


@query(
    f"""with {_CV} select t1, t2 from (select t1, t2, row_number() over (partition by t1 order by abs(epoch_us(t1) - epoch_us(t2)), t2) as k from a join b
      on t2 between t1 - interval 360 second and t1 + interval 360 second) where k = 1"""
)
def nearest_time(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("ts", "event_type")
    return align.nearest_times(e.where("event_type = 'click'"), e.where("event_type = 'view'"), "ts", "ts", 360)


@query("select event_type as pixel, time_bucket(interval 30 minute, ts) as ts, case when count(value) >= 4 then round(sum(value), 4) end as value, count(value) as n from events group by 1, 2")
def resample_min_count(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_type").alias("pixel"), "ts", "value")
    return align.resampled(e, ["pixel"], "ts", "value", 1800, "sum", 4).withColumn("value", F.round("value", 4))


@query("with m as (select min(value) as m from events) select event_type as pixel, time_bucket(interval 360 second, ts) + interval 360 second as ts, round(avg(case when value = m then 0 else value end), 6) as value from events, m group by 1, 2")
def radar_in_gauge_step(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_type").alias("pixel"), "ts", "value")
    return align.means_inside_steps(e, ["pixel"], "ts", "value", 360).withColumn("value", r6("value"))


@query(
    """with g as (select l_suppkey as station, cast(l_shipdate as date) as day, l_quantity as v from lineitem), r as (select distinct cast(o_orderdate as date) as day from orders where o_orderpriority = '1-URGENT'),
    w as (select station, day, sum(v) as total, count(*) as n from g where day in (select day from r) group by 1, 2 having sum(v) > 20)
    select station, cast(sum(n) as bigint) as n_points, count(*) as n_days from w group by 1 having sum(n) > 6"""
)
def analysis_scope(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("station"), F.col("l_shipdate").alias("time"), F.col("l_quantity").alias("value"))
    days = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.to_date("o_orderdate").alias("day"))
    return align.analysis_scope(g, days)


@query(
    f"""with {_GRID}, v7 as (select * from grid where lat between 2 and 20), v6 as (select * from grid where lon between 1 and 8), t0 as (select min(time) as t from v7 where lat between 2 and 20 and lon between 1 and 8),
    cells as (select distinct lat, lon from v7, t0 where time = t and lon between 1 and 8 and radar is not null)
    select v7.time, v7.lat, v7.lon, v7.radar, v6.sat from v7 join v6 using (time, lat, lon) semi join cells on cells.lat = v7.lat and cells.lon = v7.lon
    where v7.lat between (select greatest(min(lat), (select min(lat) from v6)) from v7) and (select least(max(lat), (select max(lat) from v6)) from v7)"""
)
def merged_dataset(spark: SparkSession, d: str) -> DataFrame:
    g = grid(spark, d)
    a, b = g.where("lat between 2 and 20").select("time", "lat", "lon", "radar"), g.where("lon between 1 and 8").select("time", "lat", "lon", "sat")
    return align.merged_grids({"radar": a, "sat": b}, {"radar": "radar", "sat": "sat"}, "radar")


@query(f"with {_GRID}, t as (select time, row_number() over (order by time) as r, count(*) over () as n from (select distinct time from grid)) select 'train' as part, grid.* from grid join t using (time) where r <= floor(0.8 * n) union all select 'test', grid.* from grid join t using (time) where r > floor(0.8 * n) and r <= floor(0.8 * n) + floor(0.2 * n)")
def split_sequential(spark: SparkSession, d: str) -> DataFrame:
    a, b = align.split_times(grid(spark, d))
    return a.withColumn("part", F.lit("train")).unionByName(b.withColumn("part", F.lit("test")))


@query(
    f"""with {_GRID}, t as (select time, row_number() over (order by md5(epoch_us(time)::varchar || ':12'), time) as r, count(*) over () as n from (select distinct time from grid))
    select 'train' as part, grid.* from grid join t using (time) where r <= floor(0.8 * n) union all select 'test', grid.* from grid join t using (time) where r > floor(0.8 * n) and r <= floor(0.8 * n) + floor(0.2 * n)"""
)
def split_random(spark: SparkSession, d: str) -> DataFrame:
    a, b = align.split_times(grid(spark, d), method="random")
    return a.withColumn("part", F.lit("train")).unionByName(b.withColumn("part", F.lit("test")))


# ---- scalar functions -----------------------------------------------------------------------------------


@query("select l_orderkey, l_linenumber, round(power(power(10, l_quantity / 10) / 200, 1 / 1.6), 6) as rate, round(10 * log10(200 * power(l_quantity + 1e-4, 1.6)), 6) as dbz from lineitem")
def zr_conversion(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(S.rate_from_reflectivity(q)).alias("rate"), r6(S.reflectivity_from_rate(q)).alias("dbz"))


@query("select l_suppkey, l_partkey, round(avg(power(power(10, (l_quantity + 5.7) / 10) / 205, 1 / 1.44)), 6) as rate from lineitem group by 1, 2")
def elevation_average(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("time"), F.col("l_partkey").alias("azimuth"), F.lit(0).alias("range"), F.col("l_quantity").alias("dbz"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"))
    return interp.rate_over_elevations(x).select(F.col("time").alias("l_suppkey"), F.col("azimuth").alias("l_partkey"), r6("rate").alias("rate"))


@query("select l_orderkey, l_linenumber, round((1 + tanh(-5 * (l_quantity - 25))) / 2, 6) as down, round(1 - (1 + tanh(-5 * (l_quantity - 25))) / 2, 6) as up from lineitem")
def echelon(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(S.echelon_down(q, 25)).alias("down"), r6(S.echelon_up(q, 25)).alias("up"))


@query(
    """with p as (select l_orderkey, l_linenumber, (l_quantity - 25) * 4000 as x, (l_discount * 100 - 5) * 20000 as y from lineitem),
    q as (select *, sqrt(x * x + y * y) as rho, radians(-3.0) as p from p), c as (select *, rho / 6370997.0 as c from q)
    select l_orderkey, l_linenumber,
      round(case when rho = 0 then -38.5 else -38.5 + degrees(atan2(x * sin(c), rho * cos(p) * cos(c) - y * sin(p) * sin(c))) end, 6) as lon,
      round(case when rho = 0 then -3.0 else degrees(asin(cos(c) * sin(p) + y * sin(c) * cos(p) / rho)) end, 6) as lat from c"""
)
def aeqd(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", ((F.col("l_quantity") - 25) * 4000).alias("x"), ((F.col("l_discount") * 100 - 5) * 20000).alias("y"))
    lon, lat = S.aeqd_to_geographic(F.col("x"), F.col("y"), -38.5, -3.0)
    return x.select("l_orderkey", "l_linenumber", r6(lon).alias("lon"), r6(lat).alias("lat"))


@query(f"with {_STATIONS} select id, round(2 * 6371.0088 * asin(sqrt(power(sin(radians(-3.7 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(-3.7)) * power(sin(radians(-38.5 - lon) / 2), 2))), 5) as km from stations")
def haversine_distance(spark: SparkSession, d: str) -> DataFrame:
    from rainloom.sources.gauges import distance_to

    return distance_to(stations(spark, d), -3.7, -38.5).select("id", F.round("km", 5).alias("km"))


@query(f"with {_STATIONS}, c as (select avg(lat) as a, avg(lon) as o from stations) select id, round(sqrt(power(lat - a, 2) + power(lon - o, 2)), 6) as distance from stations, c")
def center_distance(spark: SparkSession, d: str) -> DataFrame:
    s = stations(spark, d)
    c = s.agg(F.avg("lat").alias("a"), F.avg("lon").alias("o"))
    return s.crossJoin(F.broadcast(c)).select("id", r6(S.degrees_to_center(F.col("lat"), F.col("lon"), F.col("a"), F.col("o"))).alias("distance"))


@query(
    """select file_name, cast(strptime(replace(split_part(split_part(file_name, '.', 5), '-', 1) || split_part(split_part(file_name, '.', 5), '-', 2), 'S', ''), '%Y%m%d%H%M%S') as timestamp) as time
    from (select distinct file_name from imerg_grid)"""
)
def parse_filenames(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "imerg_grid").select("file_name").distinct().select("file_name", S.filename_time(F.col("file_name")).alias("time"))


@query("select deployment_id, case when s >= 86400 then (s // 86400)::varchar || 'DAY' when s >= 3600 then (s // 3600)::varchar || 'HOUR' else (s // 60)::varchar || 'MIN' end as label from (select deployment_id, (epoch_us(active_to) - epoch_us(active_from)) // 1000000 as s from deployments)")
def timedelta_label(spark: SparkSession, d: str) -> DataFrame:
    from rainloom.session import epoch_us

    return table(spark, d, "deployments").select("deployment_id", S.timedelta_label((epoch_us(F.col("active_to")) - epoch_us(F.col("active_from"))) / 1_000_000).alias("label"))


# ---- interpolation --------------------------------------------------------------------------------------


@query(
    f"""with {_STATIONS}, o as (select date_trunc('month', l_shipdate) as day, l_suppkey as id, avg(l_quantity) as v from lineitem group by 1, 2),
    b as (select min(lat) as a, ceil((max(lat) - min(lat)) / 0.25 - 1e-12) as n, min(lon) as o, ceil((max(lon) - min(lon)) / 0.25 - 1e-12) as m from stations),
    n as (select a + i * 0.25 as lat, o + j * 0.25 as lon from b, range(0, cast(n as bigint)) as u(i), range(0, cast(m as bigint)) as w(j)),
    x as (select day, n.lat as lat, n.lon as lon, v, power(n.lat - s.lat, 2) + power(n.lon - s.lon, 2) as d2 from o join stations s using (id), n)
    select cast(day as timestamp) as time, round(lat, 6) as lat, round(lon, 6) as lon, round(case when min(d2) > 0 then sum(v / nullif(d2, 0)) / sum(1 / nullif(d2, 0)) end, 6) as value from x group by 1, 2, 3"""
)
def idw_grid(spark: SparkSession, d: str) -> DataFrame:
    month = F.date_trunc("month", F.col("l_shipdate")).cast("timestamp_ntz")
    o = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("station"), month.alias("time")).agg(F.avg("l_quantity").alias("value"))
    s = stations(spark, d)
    return interp.idw(o, s, interp.grid_nodes(spark, space.bbox_of(s), 0.25)).select("time", r6("lat").alias("lat"), r6("lon").alias("lon"), r6("value").alias("value"))


_KERNEL = [[0.0, 1.0, 0.0], [1.0, 4.0, 2.0], [0.0, 1.0, 0.0]]


@query(
    f"""with {_GRID}, k as (select * from (values (-1, 0, 1.0), (0, -1, 1.0), (0, 0, 4.0), (0, 1, 2.0), (1, 0, 1.0)) as v(di, dj, w)),
    m as (select time, lat + di as lat, lon + dj as lon, sum(radar * w) as v from grid, k group by 1, 2, 3) select grid.time, grid.lat, grid.lon, round(m.v, 5) as radar from grid join m on m.time = grid.time and m.lat = grid.lat and m.lon = grid.lon"""
)
def convolve2d(spark: SparkSession, d: str) -> DataFrame:
    return interp.convolved(grid(spark, d), np.array(_KERNEL), "lat", "lon", "radar", ["time"]).withColumn("radar", F.round("radar", 5))


@query("select round(0.05 + i * 0.4, 6) as lat, round(0.05 + j * 0.4, 6) as lon, round(2 * (0.05 + i * 0.4) - 3 * (0.05 + j * 0.4) + 7, 6) as value from range(0, 20) as a(i), range(0, 20) as b(j)")
def regrid_triangles(spark: SparkSession, d: str) -> DataFrame:
    """A planar field over quads of unit cells: any triangulation gives it back exactly."""
    g = spark.range(100).select((F.col("id") % 10).cast("double").alias("lat"), F.floor(F.col("id") / 10).cast("double").alias("lon")).select(F.col("lon").cast("long").alias("azimuth_i"), F.col("lat").cast("long").alias("range_i"), "lat", "lon", (2 * F.col("lat") - 3 * F.col("lon") + 7).alias("value"))
    t = interp.sweep_triangles(g, azimuths=1_000_000)
    n = spark.range(400).select((F.floor(F.col("id") / 20) * 0.4 + 0.05).alias("lat"), (F.col("id") % 20 * 0.4 + 0.05).alias("lon"))
    return interp.regrid_triangles(t, n, 1.0).select(r6("lat").alias("lat"), r6("lon").alias("lon"), r6("value").alias("value"))


@query(
    f"""with {_GRID}, t as (select distinct time from grid), b as (select min(lat) as a, ceil((max(lat) - min(lat)) / 0.5 - 1e-12) as n, min(lon) as o, ceil((max(lon) - min(lon)) / 0.5 - 1e-12) as m from grid)
    select time, a + i * 0.5 as lat, o + j * 0.5 as lon, round(2 * (a + i * 0.5) - 3 * (o + j * 0.5) + 7 + month(time), 6) as value from t, b, range(0, cast(n as bigint)) as u(i), range(0, cast(m as bigint)) as w(j)"""
)
def regrid_scattered(spark: SparkSession, d: str) -> DataFrame:
    """A planar field over the cube's cells and the corners of its box: any triangulation gives it back exactly."""
    g = grid(spark, d).select("time", "lat", "lon")
    box = space.bbox_of(g)
    corners = F.array(*[F.struct(F.lit(a).alias("lat"), F.lit(o).alias("lon")) for a in (box.min_lat, box.max_lat) for o in (box.min_lon, box.max_lon)])
    g = g.unionByName(g.select("time").distinct().select("time", F.explode(corners).alias("c")).select("time", "c.lat", "c.lon"))
    g = g.withColumn("value", 2 * F.col("lat") - 3 * F.col("lon") + 7 + F.month("time"))
    return interp.regrid_scattered(g, box, 0.5).withColumn("value", r6("value"))


# ---- fusion ---------------------------------------------------------------------------------------------

_QS = [round(float(q), 2) for q in np.linspace(0.01, 0.99, 99)]


def _moments(source: str, name: str = "") -> str:
    """Quadratic least squares of y on x by centred normal equations."""
    sql = f"""m as (select avg(x) as mx, avg(x * x) as mxx, avg(y) as my from {source}),
    s as (select sum((x - mx) * (x - mx)) as a, sum((x - mx) * (x * x - mxx)) as b, sum((x * x - mxx) * (x * x - mxx)) as c, sum((x - mx) * (y - my)) as d, sum((x * x - mxx) * (y - my)) as e, any_value(mx) as mx, any_value(mxx) as mxx, any_value(my) as my from {source}, m),
    f0 as (select (e * a - d * b) / (c * a - b * b) as p2, (d * c - e * b) / (c * a - b * b) as p1, d / a as lin, mx, mxx, my from s),
    f as (select case when p2 < 0 then 0 else p2 end as p2, case when p2 < 0 then lin else p1 end as p1, case when p2 < 0 then my - lin * mx else my - p1 * mx - p2 * mxx end as p0 from f0)"""
    return re.sub(r"\b(m|s|f0|f) as \(", rf"{name}\1 as (", re.sub(r"(from|,) (m|f0)\b(?!x| as)", rf"\1 {name}\2", sql.replace("from s)", f"from {name}s)"))) if name else sql



@query(
    f"""with {_GRID}, q as (select unnest(quantile_cont(sat, {_QS})) as x, unnest(quantile_cont(radar, {_QS})) as y from grid), {_moments("q")}
    select time, lat, lon, round(greatest(p2 * sat * sat + p1 * sat + p0, 0), 4) as sat_matched from grid, f"""
)
def quantile_match(spark: SparkSession, d: str) -> DataFrame:
    return fusion.Fuser("qmatch", "radar", quantiles=_QS).transform(grid(spark, d)).select("time", "lat", "lon", F.round("sat_matched", 4).alias("sat_matched"))


@query(
    f"""with {_GRID}, v as (select row_number() over (order by radar) - 1 as r, radar from grid), w as (select row_number() over (order by sat) - 1 as r, sat from grid), n as (select count(*) as n from grid),
    p as (select i / 10000.0 * (n - 1) as p from range(0, 10000) as g(i), n), q as (select w1.sat + (w2.sat - w1.sat) * (p - floor(p)) as x, v1.radar + (v2.radar - v1.radar) * (p - floor(p)) as y
      from p join n on true join v v1 on v1.r = floor(p) join v v2 on v2.r = least(floor(p) + 1, n.n - 1) join w w1 on w1.r = floor(p) join w w2 on w2.r = least(floor(p) + 1, n.n - 1)), {_moments("q")}
    select time, lat, lon, round(greatest(p2 * sat * sat + p1 * sat + p0, 0), 4) as sat_matched from grid, f"""
)
def quantile_match_many(spark: SparkSession, d: str) -> DataFrame:
    """Ten thousand quantiles, by ranks."""
    return fusion.Fuser("qmatch", "radar").transform(grid(spark, d)).select("time", "lat", "lon", F.round("sat_matched", 4).alias("sat_matched"))


@query(
    f"""with {_GRID}, r as (select time, avg(sat) as x, avg(radar) as y from grid group by 1), a as (select sum(x * y) / sum(x * x) as a from r) select time, lat, lon, round(a * sat, 5) as sat_matched from grid, a"""
)
def linreg_fusion(spark: SparkSession, d: str) -> DataFrame:
    return fusion.Fuser("linreg", "radar").transform(grid(spark, d)).select("time", "lat", "lon", F.round("sat_matched", 5).alias("sat_matched"))


@query(
    f"""with {_GRID}, g as (select *, (lat + lon) % 2 = 0 as land from grid), r as (select land, time, avg(sat) as x, avg(radar) as y from g group by 1, 2), a as (select land, sum(x * y) / sum(x * x) as a from r group by 1)
    select time, lat, lon, round(a * sat, 5) as sat_matched from g join a using (land)"""
)
def linreg_land_sea(spark: SparkSession, d: str) -> DataFrame:
    f = fusion.Fuser("linreg", "radar", land=(F.col("lat") + F.col("lon")) % 2 == 0)
    return f.transform(grid(spark, d)).select("time", "lat", "lon", F.round("sat_matched", 5).alias("sat_matched"))


_PARTS = f"""with {_GRID}, v as (select row_number() over (order by radar) - 1 as r, radar from grid), w as (select row_number() over (order by sat) - 1 as r, sat from grid), n as (select count(*) as n from grid),
    pos as (select k, (case when k = 0 then i / 10000.0 * 0.75 else 0.75 + i / 10000.0 * 0.25 end) * (n - 1) as p from range(0, 10000) as g(i), n, (values (0), (1)) as part(k)),
    q as (select k, w1.sat + (w2.sat - w1.sat) * (p - floor(p)) as x, v1.radar + (v2.radar - v1.radar) * (p - floor(p)) as y
      from pos join n on true join v v1 on v1.r = floor(p) join v v2 on v2.r = least(floor(p) + 1, n.n - 1) join w w1 on w1.r = floor(p) join w w2 on w2.r = least(floor(p) + 1, n.n - 1)),
    low as (select x, y from q where k = 0), high as (select x, y from q where k = 1), cut as (select quantile_cont(sat, 0.75) as c from grid)"""


@query(
    f"""{_PARTS}, {_moments("low", "lo_")}, {_moments("high", "hi_")},
    z as (select time, lat, lon, sat, 1 / (1 + exp(greatest(least(-40 * (sat - c), 700), -700))) as up from grid, cut)
    select time, lat, lon, round(greatest((lo_f.p2 * sat * sat + lo_f.p1 * sat + lo_f.p0) * (1 - up) + (hi_f.p2 * sat * sat + hi_f.p1 * sat + hi_f.p0) * up, 0), 4) as sat_matched from z, lo_f, hi_f"""
)
def quantile_match_by_parts(spark: SparkSession, d: str) -> DataFrame:
    """Ten thousand quantiles in each part, by ranks."""
    return fusion.Fuser("qmatch_by_parts", "radar").transform(grid(spark, d)).select("time", "lat", "lon", F.round("sat_matched", 4).alias("sat_matched"))


# ---- radar geometry and gauges against radar ---------------------------------------------------------------


@query(
    """with g as (select station as id, lat, lon from (select s_suppkey as station, -6.0 + (s_suppkey % 20) * 0.1 as lat, -40.0 + floor(s_suppkey / 20) * 0.1 as lon from supplier)),
    x as (select id, b, radians(lat) as a, radians(lon) as o, 25.0 / 6371.0088 as d, radians(b) as t from g, (select unnest(range(0, 360, 30)) as b)),
    y as (select *, asin(sin(a) * cos(d) + cos(a) * sin(d) * cos(t)) as a2 from x)
    select id, cast(b as bigint) as bearing, round(degrees(a2), 6) as lat, round((degrees(o + atan2(sin(t) * sin(d) * cos(a), cos(d) - sin(a) * sin(a2))) + 540) % 360 - 180, 6) as lon from y"""
)
def radar_circles(spark: SparkSession, d: str) -> DataFrame:
    """Circles of 25 km around the stations, every 30 degrees."""
    x = stations(spark, d).withColumn("bearing", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(330).cast("long"), F.lit(30).cast("long"))))
    lat, lon = S.destination(F.col("lat"), F.col("lon"), F.col("bearing").cast("double"), 25.0)
    return x.select("id", "bearing", r6(lat).alias("lat"), r6(lon).alias("lon"))


@query(
    """with g as (select p_partkey as gate, radians((p_partkey * 7) % 360) as az, (p_size * 1000.0) as r, radians(0.5 + p_partkey % 4) as e, 4.0 / 3.0 * 6371000.0 as k from part),
    z as (select *, sqrt(r * r + k * k + 2.0 * r * k * sin(e)) - k as z from g), x as (select gate, z, k * asin(r * cos(e) / (k + z)) * sin(az) as x, k * asin(r * cos(e) / (k + z)) * cos(az) as y from z),
    p as (select *, sqrt(x * x + y * y) as rho, radians(-3.7) as p from x)
    select gate, round(case when rho = 0 then -38.5 else -38.5 + degrees(atan2(x * sin(rho / R), rho * cos(p) * cos(rho / R) - y * sin(p) * sin(rho / R))) end, 6) as lon,
           round(case when rho = 0 then -3.7 else degrees(asin(greatest(-1, least(1, cos(rho / R) * sin(p) + y * sin(rho / R) * cos(p) / rho)))) end, 6) as lat, round(z + 20, 4) as alt from p""".replace("/ R", f"/ {S.AEQD_RADIUS_M}")
)
def georeferenced_gates(spark: SparkSession, d: str) -> DataFrame:
    """Positions of radar gates under the four-thirds earth model."""
    g = table(spark, d, "part").select(F.col("p_partkey").alias("gate"), F.pmod(F.col("p_partkey") * 7, F.lit(360)).cast("double").alias("az"), (F.col("p_size") * 1000.0).alias("r"), (F.lit(0.5) + F.col("p_partkey") % 4).alias("e"))
    lon, lat, alt = S.georeferenced(F.col("az"), F.col("r"), F.col("e"), -38.5, -3.7, 20.0)
    return g.select("gate", r6(lon).alias("lon"), r6(lat).alias("lat"), F.round(alt, 4).alias("alt"))


@query(
    """with m as (select obs_id, poste, epoch_us(time) as us, rr6 from mf_data where rr6 >= 0 and not isnan(rr6)), s as (select poste, count(*) as n from m group by 1 having count(*) > 6),
    b as (select poste, us // 3600000000 as h, avg(rr6) as gauge from m join s using (poste) group by 1, 2),
    r as (select poste, epoch_us(time) // 3600000000 as h, avg(rain_rate) as radar from radar_rain where rain_rate >= 0 and not isnan(rain_rate) group by 1, 2)
    select poste, cast(h as bigint) as hour, round(gauge, 6) as gauge, round(radar, 6) as radar from b join r using (poste, h)"""
)
def gauge_radar_steps(spark: SparkSession, d: str) -> DataFrame:
    """Gauge and radar means of the same station and hour, for stations with more than six readings."""
    usable = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) >= 0)
    g = table(spark, d, "mf_data").where(usable("rr6")).select(F.col("poste").alias("station"), "time", F.col("rr6").alias("value"))
    r = table(spark, d, "radar_rain").where(usable("rain_rate")).select(F.col("poste").alias("station"), "time", F.col("rain_rate").alias("value"))
    x = align.gauge_radar(g, r, 3600, 6)
    return x.select(F.col("station").alias("poste"), F.col("step").alias("hour"), r6("gauge").alias("gauge"), r6("radar").alias("radar"))


@query(
    f"""with {_GRID}, t as (select distinct time from grid), a as (select time as t1, lat, lon, radar from grid), b as (select time as t2, lat, lon, sat from grid where month(time) % 2 = 1),
    n as (select t.time as t1, arg_min(u.time, struct_pack(d := abs(epoch_us(u.time) - epoch_us(t.time)), t := u.time)) as t2 from t, (select distinct t2 as time from b) u group by 1)
    select a.t1 as time, round(corr(radar, sat), 6) as r from a join n using (t1) join b using (t2, lat, lon) group by 1"""
)
def nearest_step_correlation(spark: SparkSession, d: str) -> DataFrame:
    """Correlation over the cells of each radar step with the satellite step nearest in time."""
    g = grid(spark, d)
    x = align.at_nearest_step(g.select("time", "lat", "lon", "radar"), g.where("month(time) % 2 = 1").select("time", "lat", "lon", "sat"))
    return x.groupBy("time").agg(r6(M.correlation(F.col("radar"), F.col("sat"))).alias("r"))
