"""From rates to daily amounts: normalise, check completeness, fill gaps, accumulate."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rainloom.session import epoch_us

#: Steps per day, hours per step and value column of each product.
PRODUCTS = {"imerg": (48, 0.5, "precipitationCal"), "gsmap": (24, 1.0, "precipitation"), "radar": (144, 1.0 / 6.0, "rain_rate")}
SYNONYMS = {"latitude": "lat", "longitude": "lon", "y": "lat", "x": "lon"}
METHODS = ("zero", "previous", "linear", "nearest")


def product(name: str) -> tuple[int, float, str]:
    if name not in PRODUCTS:
        raise ValueError(f"unknown product {name!r}; known: {', '.join(PRODUCTS)}")
    return PRODUCTS[name]


def normalised(df: DataFrame, spacing: float | None = None) -> DataFrame:
    """Grid with columns time, lat, lon first, coordinates rounded by the grid's mean spacing, NaN as NULL.

    The number of decimals is that of the zeros that lead five thousandths of the mean longitude spacing;
    ``spacing`` skips the aggregation that finds it.  Synonyms of lat and lon are renamed.
    """
    df = df.withColumnsRenamed({k: v for k, v in SYNONYMS.items() if k in df.columns and v not in df.columns})
    if spacing is None:
        r = df.agg(F.min("lon").alias("a"), F.max("lon").alias("b"), F.count_distinct("lon").alias("n")).first()
        spacing = (r.b - r.a) / (r.n - 1) if r.n and r.n > 1 else 0.0
    digits = max(0, math.ceil(-math.log10(0.005 * abs(spacing))) - 1) if spacing else 6
    doubles = [c for c, t in df.dtypes if t in ("double", "float") and c not in ("lat", "lon")]
    out = df.withColumns({"lat": F.bround("lat", digits), "lon": F.bround("lon", digits), "time": F.col("time").cast("timestamp_ntz")} | {c: F.when(~F.isnan(c), F.col(c)) for c in doubles})
    return out.select("time", "lat", "lon", *[c for c in out.columns if c not in ("time", "lat", "lon")])


def day_grid(days: DataFrame, steps: int) -> DataFrame:
    """Each row of ``days`` (with a DATE column ``day``) once for each expected time of its day."""
    seconds = 86_400 // steps
    step = F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))
    x = days.withColumn("step", step)
    return x.withColumn("time", (F.col("day").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("step") * F.lit(seconds))).cast("timestamp_ntz"))


def completeness(df: DataFrame, product_name: str, by: list[str] | None = None, max_missing: float = 0.2) -> DataFrame:
    """Per day (and ``by``): expected, actual, missing, missing_fraction, is_complete, missing_times.

    A time is there if any row has it; times off the grid don't count.
    """
    by = by or []
    steps = product(product_name)[0]
    there = df.where("time is not null").select(*by, F.to_date("time").alias("day"), "time").distinct()
    grid = day_grid(there.select(*by, "day").distinct(), steps)
    gone = grid.join(there.withColumn("hit", F.lit(1)), [*by, "day", "time"], "left")
    out = gone.groupBy(*by, "day").agg(
        F.count("*").cast("int").alias("expected"), F.count("hit").cast("int").alias("actual"), F.sort_array(F.collect_list(F.when(F.col("hit").isNull(), F.col("time")))).alias("missing_times")
    )
    out = out.withColumn("missing", F.col("expected") - F.col("actual")).withColumn("missing_fraction", F.col("missing") / F.col("expected"))
    return out.withColumn("is_complete", F.col("missing_fraction") <= max_missing).select(*by, "day", "expected", "actual", "missing", "missing_fraction", "is_complete", "missing_times")


def large_gaps(df: DataFrame, keys: list[str], order: str, missing: str, most: int, out: str = "large_gap") -> DataFrame:
    """``df`` with ``out``: whether a row lies in a run of more than ``most`` missing rows."""
    w = Window.partitionBy(*keys).orderBy(order)
    both = Window.partitionBy(*keys, missing).orderBy(order)
    x = df.withColumn("__island", F.row_number().over(w) - F.row_number().over(both))
    n = F.count("*").over(Window.partitionBy(*keys, missing, "__island"))
    return x.withColumn(out, F.col(missing) & (n > most)).drop("__island")


def gap_filled(df: DataFrame, keys: list[str], value: str, steps: int, method: str = "linear", max_gap_steps: int | None = None, fill_value: float = 0.0) -> DataFrame:
    """(keys, day, time, value, was_missing, large_gap): every expected time of each series' days, gaps filled.

    linear goes on in a straight line beyond the first and last value of a day, so it may be negative there;
    nearest takes the earlier of two equally near; previous takes the last value, at the begin the first; zero
    is zero.  Times at which no series of ``keys`` has a row are missing; runs of more than ``max_gap_steps``
    of them (default two, zero: off) get ``fill_value``.  A day without a value stays NULL.  Of several rows for one
    time the smallest value counts.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; known: {', '.join(METHODS)}")
    v = F.when(~F.isnan(value), F.col(value))
    rows = df.where("time is not null").groupBy(*keys, F.to_date("time").alias("day"), "time").agg(F.min(v).alias("v"))
    x = day_grid(rows.select(*keys, "day").distinct(), steps).join(rows.withColumn("__row", F.lit(1)), [*keys, "day", "time"], "left")
    x = x.withColumn("was_missing", F.col("__row").isNull()).withColumn("t", F.col("step").cast("double"))
    w = Window.partitionBy(*keys, "day").orderBy("step")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    point = F.when(F.col("v").isNotNull(), F.struct("t", "v"))
    x = x.withColumn("p1", F.last(point, True).over(back)).withColumn("n1", F.first(point, True).over(ahead))
    x = x.withColumn("p2", F.last(F.when(F.col("v").isNotNull(), F.col("p1")), True).over(back)).withColumn("n2", F.first(F.when(F.col("v").isNotNull(), F.col("n1")), True).over(ahead))
    line = lambda a, b: F.col(f"{a}.v") + (F.col(f"{b}.v") - F.col(f"{a}.v")) * (F.col("t") - F.col(f"{a}.t")) / (F.col(f"{b}.t") - F.col(f"{a}.t"))
    linear = F.when(F.col("p1").isNotNull() & F.col("n1").isNotNull(), line("p1", "n1")).when(F.col("n2").isNotNull() & F.col("p1").isNull(), line("n1", "n2")).when(F.col("p2").isNotNull() & F.col("n1").isNull(), line("p2", "p1"))
    near = F.when(F.col("t") - F.col("p1.t") <= F.col("n1.t") - F.col("t"), F.col("p1.v")).otherwise(F.coalesce("n1.v", "p1.v"))
    filled = {"zero": F.lit(0.0), "previous": F.coalesce("p1.v", "n1.v"), "linear": F.coalesce(linear, F.col("p1.v"), F.col("n1.v")), "nearest": near}[method]
    x = x.withColumn("filled", F.coalesce("v", filled))
    most = 2 if max_gap_steps is None else max_gap_steps
    x = large_gaps(x, [*keys, "day"], "step", "was_missing", most) if most > 0 else x.withColumn("large_gap", F.lit(False))
    return x.select(*keys, "day", "time", F.when(F.col("large_gap"), F.lit(float(fill_value))).otherwise(F.col("filled")).alias(value), "was_missing", "large_gap")


def daily_accumulation(df: DataFrame, keys: list[str], value: str, hours: float, steps: int | None = None, min_valid: float = 0.5) -> DataFrame:
    """(keys, day, daily_accumulation, valid_fraction): sum of rate times hours per day.

    Missing rates add nothing; below ``min_valid`` of the steps the amount is NULL.  The share is of ``steps`` or,
    without it, of the rows that the day has.
    """
    v = F.when(~F.isnan(value), F.col(value))
    total = F.lit(steps) if steps else F.count("*")
    x = df.groupBy(*keys, F.to_date("time").alias("day")).agg(F.coalesce(F.sum(v * hours), F.lit(0.0)).alias("a"), (F.count(v) / total).alias("valid_fraction"))
    return x.select(*keys, "day", F.when(F.col("valid_fraction") >= min_valid, F.col("a")).alias("daily_accumulation"), "valid_fraction")


class DailyPipeline:
    """Daily amounts of many days in one job, with a status per day."""

    def __init__(self, product_name: str, keys: list[str], method: str = "linear", max_gap_hours: float | None = None, max_missing: float = 0.2, min_valid: float = 0.5, value: str | None = None):
        self.steps, self.hours, default = product(product_name)
        self.product, self.keys, self.value = product_name, keys, value or default
        if method not in METHODS:
            raise ValueError(f"unknown method {method!r}")
        self.method, self.max_missing, self.min_valid = method, max_missing, min_valid
        self.max_gap = None if max_gap_hours is None else int(max_gap_hours / self.hours)
        self.log: DataFrame | None = None

    def run(self, df: DataFrame, first: dt.date | None = None, last: dt.date | None = None, done: DataFrame | None = None) -> DataFrame:
        """Amounts of the complete days from ``first`` to ``last``, both included, that aren't in ``done`` (day)."""
        day = F.to_date("time")
        if self.value not in df.columns:
            raise ValueError(f"no column {self.value!r}")
        if first is not None:
            df = df.where(day >= F.lit(first))
        if last is not None:
            df = df.where(day <= F.lit(last))
        if done is not None:
            df = df.withColumn("__d", day).join(done.select(F.col("day").alias("__d")), "__d", "left_anti").drop("__d")
        report = completeness(df, self.product, max_missing=self.max_missing)
        self.log = report.select("day", F.when(F.col("is_complete"), "success").otherwise("failed").alias("status"), F.when(~F.col("is_complete"), F.format_string("%d of %d steps missing", "missing", "expected")).alias("error"))
        good = report.where("is_complete").select("day")
        kept = df.withColumn("day", day).join(good, "day", "left_semi").drop("day")
        filled = gap_filled(kept, self.keys, self.value, self.steps, self.method, self.max_gap)
        return daily_accumulation(filled, self.keys, self.value, self.hours, self.steps, self.min_valid)

    def summary(self) -> DataFrame:
        if self.log is None:
            raise ValueError("nothing was run")
        return self.log.groupBy("status").count()


def time_step(df: DataFrame, time: str = "time", by: list[str] | None = None) -> DataFrame:
    """Median difference between successive times in seconds, per ``by``."""
    by = by or []
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))).orderBy(time)
    x = df.where(F.col(time).isNotNull()).select(*by, time).distinct().withColumn("d", (epoch_us(F.col(time)) - epoch_us(F.lag(time).over(w))) / 1e6)
    return x.groupBy(*by).agg(F.percentile("d", 0.5).alias("step_seconds"))
