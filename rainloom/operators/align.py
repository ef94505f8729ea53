"""Aligning series in time: as-of and nearest joins, resampling, scopes and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rainloom.session import epoch_us, floor_div


def asof_forward(left: DataFrame, right: DataFrame, left_time: str, right_time: str, tolerance_s: int, stamp: str = "reference") -> DataFrame:
    """For each time t2 of ``right`` the first time t1 >= t2 of ``left`` (or the last one before, if none follows).

    Result: (t1, t2, stamp) of pairs at most ``tolerance_s`` apart; distinct times on both sides.  The stamp is
    t1 + (t1 - t2)/2 or, with ``stamp="midpoint"``, the middle of both.  Times are cut into buckets as wide as
    the tolerance: only the next bucket can hold a partner, so no global sort is needed; the clamp to the last
    time touches at most the tolerance after it and comes from one aggregated row.
    """
    width = max(1, tolerance_s) * 1_000_000
    a = left.where(F.col(left_time).isNotNull()).select(F.col(left_time).alias("t1")).distinct().withColumn("u1", epoch_us(F.col("t1")))
    b = right.where(F.col(right_time).isNotNull()).select(F.col(right_time).alias("t2")).distinct().withColumn("u2", epoch_us(F.col("t2")))
    own = floor_div(F.col("u1"), width)
    spread = a.withColumn("b", F.explode(F.array(own - 1, own)))
    pairs = b.withColumn("b", floor_div(F.col("u2"), width)).join(spread, "b").where((F.col("u1") >= F.col("u2")) & (F.col("u1") - F.col("u2") <= width))
    first = pairs.groupBy("t2", "u2").agg(F.min(F.struct("u1", "t1")).alias("m")).select("t2", "u2", "m.u1", "m.t1")
    last = F.broadcast(a.agg(F.max(F.struct("u1", "t1")).alias("m")).select("m.u1", "m.t1"))  # one row
    late = b.crossJoin(last).where((F.col("u2") > F.col("u1")) & (F.col("u2") - F.col("u1") <= width)).select("t2", "u2", "u1", "t1")
    x = first.unionByName(late)
    half = F.make_dt_interval(secs=(F.floor((F.col("u1") - F.col("u2")) / 2).cast("decimal(18,0)") / F.lit(1_000_000)).cast("decimal(18,6)"))
    made = F.col("t1") + half if stamp == "reference" else F.col("t2") + half
    return x.select("t1", "t2", made.alias("stamp"))


def nearest_times(left: DataFrame, right: DataFrame, left_time: str, right_time: str, within_s: int) -> DataFrame:
    """(t1, t2): for each distinct left time the nearest right time at most ``within_s`` away; ties go to the earlier."""
    width = within_s * 1_000_000
    a = left.where(F.col(left_time).isNotNull()).select(F.col(left_time).alias("t1")).distinct().withColumn("u1", epoch_us(F.col("t1")))
    b = right.where(F.col(right_time).isNotNull()).select(F.col(right_time).alias("t2")).distinct().withColumn("u2", epoch_us(F.col("t2")))
    own = floor_div(F.col("u2"), width)
    x = a.withColumn("b", floor_div(F.col("u1"), width)).join(b.withColumn("b", F.explode(F.array(own - 1, own, own + 1))), "b")
    x = x.withColumn("d", F.abs(F.col("u1") - F.col("u2"))).where(F.col("d") <= width)
    return x.groupBy("t1").agg(F.min(F.struct("d", "u2", "t2")).alias("m")).select("t1", F.col("m.t2").alias("t2"))


def resampled(df: DataFrame, keys: list[str], time: str, value: str, step_s: int, how: str = "sum", min_count: int = 1, right_label: bool = False) -> DataFrame:
    """(keys, time, value, n) per step of the day: sum or mean of at least ``min_count`` values, else NULL."""
    v = F.when(~F.isnan(value), F.col(value))
    start = floor_div(epoch_us(F.col(time)), step_s * 1_000_000) * step_s + (step_s if right_label else 0)
    x = df.where(F.col(time).isNotNull()).groupBy(*keys, start.alias("__s")).agg(F.count(v).alias("n"), (F.sum(v) if how == "sum" else F.avg(v)).alias("__v"))
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return x.select(*keys, (epoch + F.make_dt_interval(secs=F.col("__s").cast("decimal(18,6)"))).alias(time), F.when(F.col("n") >= min_count, F.col("__v")).alias(value), "n")


def means_inside_steps(radar: DataFrame, keys: list[str], time: str, value: str, step_s: int) -> DataFrame:
    """Radar means over gauge steps, labelled at the right edge; the least value of the series counts as zero."""
    least = radar.agg(F.min(F.when(~F.isnan(value), F.col(value))).alias("__least"))
    x = radar.crossJoin(F.broadcast(least)).withColumn(value, F.when(F.col(value) == F.col("__least"), F.lit(0.0)).otherwise(F.col(value)))
    return resampled(x.select(*keys, time, value), keys, time, value, step_s, "mean", 1, right_label=True).drop("n")


def analysis_scope(gauges: DataFrame, radar_days: DataFrame, daily_threshold: float = 20.0, min_points: int = 6) -> DataFrame:
    """Stations worth comparing: (station, n_points, n_days) on radar days whose daily sum exceeds the threshold.

    gauges: (station, time, value); radar_days: (day).  Stations need more than ``min_points`` readings on such days.
    """
    x = gauges.withColumn("day", F.to_date("time")).join(radar_days.select("day").distinct(), "day", "left_semi")
    wet = x.groupBy("station", "day").agg(F.sum("value").alias("total"), F.count("*").alias("n")).where(F.col("total") > daily_threshold)
    return wet.groupBy("station").agg(F.sum("n").alias("n_points"), F.count("*").alias("n_days")).where(F.col("n_points") > min_points)


def merged_grids(sources: dict[str, DataFrame], value: dict[str, str], mask_by: str) -> DataFrame:
    """Inner join of grids on (time, lat, lon) inside their common box, on cells valid in ``mask_by`` at its first time."""
    from rainloom.operators.space import bbox_of, common_box, in_box

    box = common_box([bbox_of(df) for df in sources.values()])
    m = in_box(sources[mask_by], box)
    t0 = m.agg(F.min("time").alias("__t0"))
    cells = m.join(F.broadcast(t0), F.col("time") == F.col("__t0")).where(F.col(value[mask_by]).isNotNull()).select("lat", "lon").distinct()
    out = None
    for name, df in sources.items():
        x = in_box(df, box).select("time", "lat", "lon", F.col(value[name]).alias(name))
        out = x if out is None else out.join(x, ["time", "lat", "lon"])
    return out.join(cells, ["lat", "lon"], "left_semi").select("time", "lat", "lon", *sources)


def split_times(df: DataFrame, training: float = 0.8, testing: float = 0.2, method: str = "sequential", seed: int = 12, time: str = "time") -> tuple[DataFrame, DataFrame]:
    """Rows of the first (or, by seeded hash, random) share of the distinct times, and of the next share.

    Both shares round down; their sum may be at most one.  The random order is by the MD5 digest of the time's
    microseconds and the seed, so it needs no driver and is the same on every run.  Distinct times are a dimension.
    """
    if not 0 <= training <= 1 or not 0 <= testing <= 1 or training + testing > 1 + 1e-9:
        raise ValueError("shares must lie between 0 and 1 and sum to at most 1")
    if method not in ("sequential", "random"):
        raise ValueError(f"unknown method {method!r}")
    times = df.select(time).where(F.col(time).isNotNull()).distinct()
    key: Column = F.col(time) if method == "sequential" else F.md5(F.concat_ws(":", epoch_us(F.col(time)).cast("string"), F.lit(str(seed))))
    n = times.count()
    k, m = int(training * n + 1e-9), int(testing * n + 1e-9)
    # distinct times are a dimension; the cut times come from one sort of them
    order = times.withColumn("__r", F.row_number().over(Window.orderBy(key, F.col(time))))
    first, second = order.where(F.col("__r") <= k).select(time), order.where((F.col("__r") > k) & (F.col("__r") <= k + m)).select(time)
    return df.join(first, time, "left_semi"), df.join(second, time, "left_semi")


def gauge_radar(gauges: DataFrame, radar: DataFrame, step_seconds: int, min_points: int) -> DataFrame:
    """(station, step, gauge, radar): means per station and step of both sources, for stations with more than ``min_points`` readings.

    Both: (station, time, value); step is the time in seconds over ``step_seconds``, rounded down.  Both sides are combined
    before they meet by station and step; a step that one of them lacks has no row.
    """
    step = floor_div(epoch_us(F.col("time")), step_seconds * 1_000_000).alias("step")
    many = gauges.groupBy("station").agg(F.count("*").alias("n")).where(F.col("n") > min_points).select("station")
    g = gauges.groupBy("station", step).agg(F.avg("value").alias("gauge")).join(many, "station", "left_semi")
    return g.join(radar.groupBy("station", step).agg(F.avg("value").alias("radar")), ["station", "step"])


def at_nearest_step(left: DataFrame, right: DataFrame) -> DataFrame:
    """Cells (time, lat, lon, ...) of ``left`` with those of ``right`` at its step nearest in time, the earlier of two.

    The distinct steps, a dimension, are matched by looking to both sides in time order.
    """
    mark = left.select("time").distinct().select("time", F.lit(None).cast("timestamp_ntz").alias("t")).unionByName(right.select("time").distinct().select("time", F.col("time").alias("t")))
    w = Window.orderBy("time")
    before = F.last("t", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    after = F.first("t", ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing))
    gap = lambda c: F.abs(epoch_us(F.col("time")) - epoch_us(F.col(c)))
    x = mark.select("time", "t", before.alias("b"), after.alias("a")).where("t is null").select("time", F.when(F.col("a").isNull() | (gap("b") <= gap("a")), F.col("b")).otherwise(F.col("a")).alias("near"))
    return left.join(x, "time").join(right.withColumnRenamed("time", "near"), ["near", "lat", "lon"]).drop("near")
