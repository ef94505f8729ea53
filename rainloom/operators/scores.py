"""Scores of simulated against observed variables, each in one or two aggregations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainloom.functions import metrics as M
from rainloom.session import small_or_shuffled


def score_table(df: DataFrame, reference: str, variables: list[str] | None = None, scores: list[str] | None = None, by: list[str] | None = None, skipna: bool = True) -> DataFrame:
    """(by, variable, metric, value) of every variable against ``reference``, all in one aggregation."""
    by, scores = by or [], scores or list(M.SCORES)
    variables = variables or [c for c, t in df.dtypes if t in ("double", "float") and c != reference and c not in by]
    if not variables or reference not in df.columns:
        raise ValueError("needs the reference and another variable")
    aggs = [M.SCORES[s](F.col(reference), F.col(v), skipna).alias(f"{v}\t{s}") for v in variables for s in scores]
    x = df.groupBy(*by).agg(*aggs)
    cells = F.array(*[F.struct(F.lit(v).alias("variable"), F.lit(s).alias("metric"), F.col(f"`{v}\t{s}`").alias("value")) for v in variables for s in scores])
    return x.select(*by, F.explode(cells).alias("c")).select(*by, "c.*")


def contingency_scores(df: DataFrame, obs: str, sim: str, thresholds: list[float], detection: float | None = 0.2, by: list[str] | None = None, global_threshold: bool = False) -> DataFrame:
    """(by, threshold, tp, fp, fn, tn, pod, pond, far): counts per threshold, in one pass over the rows.

    ``global_threshold`` puts the threshold on both sides; otherwise the simulated side is detected above
    ``detection``.  far is false alarms over detections; pond is tn over (fn + tn).
    """
    by = by or []
    aggs = []
    for i, t in enumerate(thresholds):
        c = M.contingency(F.col(obs), F.col(sim), t, None if global_threshold else detection)
        aggs.append(F.struct(F.lit(float(t)).alias("threshold"), *[v.alias(k) for k, v in c.items()]).alias(f"t{i}"))
    x = df.groupBy(*by).agg(*aggs).select(*by, F.explode(F.array(*[f"t{i}" for i in range(len(thresholds))])).alias("c")).select(*by, "c.*")
    return x.withColumns({"pod": F.try_divide("tp", F.col("tp") + F.col("fn")), "pond": F.try_divide("tn", F.col("fn") + F.col("tn")), "far": F.try_divide("fp", F.col("fp") + F.col("tp"))})


def contingency_timewise(df: DataFrame, obs: str, sim: str, threshold: float = 0.0, time: str = "time") -> DataFrame:
    """Per time: tp, fp, fn, tn, pod = tp over observed above, far = fp/(fp+tp), pofd = fp/(fp+tn)."""
    c = M.contingency(F.col(obs), F.col(sim), threshold)
    above = F.count_if(M._clean(F.col(obs)) > threshold).alias("above")
    x = df.groupBy(time).agg(*[v.alias(k) for k, v in c.items()], above)
    return x.select(time, "tp", "fp", "fn", "tn", F.try_divide("tp", "above").alias("pod"), F.try_divide("fp", F.col("fp") + F.col("tp")).alias("far"), F.try_divide("fp", F.col("fp") + F.col("tn")).alias("pofd"))


def threshold_detection(df: DataFrame, ref: str, sim: str, thresholds: list[float], area: bool = False, time: str = "time") -> DataFrame:
    """(threshold, pod, one_minus_pofd, pofd) over pixels or, with ``area``, over domain means per time."""
    a, b = M._clean(F.col(ref)), M._clean(F.col(sim))
    if area:
        df = df.groupBy(time).agg(F.avg(a).alias(ref), F.avg(b).alias(sim))
        a, b = F.col(ref), F.col(sim)
    aggs = [F.struct(F.lit(float(t)).alias("threshold"), F.count_if((a > t) & (b > t)).alias("hit"), F.count_if(a > t).alias("pos"), F.count_if((a < t) & (b > t)).alias("false"), F.count_if(a < t).alias("neg")).alias(f"t{i}") for i, t in enumerate(thresholds)]
    x = df.agg(*aggs).select(F.explode(F.array(*[f"t{i}" for i in range(len(thresholds))])).alias("c")).select("c.*")
    return x.select("threshold", F.try_divide("hit", "pos").alias("pod"), (1 - F.try_divide("false", "neg")).alias("one_minus_pofd"), F.try_divide("false", "neg").alias("pofd"))


def series_correlation(df: DataFrame, reference: str, variable: str, per_time: Callable[[Column], Column], time: str = "time") -> DataFrame:
    """(value): correlation of two series, each made per time by an aggregate such as the mean or a count."""
    x = df.groupBy(time).agg(per_time(M._clean(F.col(reference))).cast("double").alias("a"), per_time(M._clean(F.col(variable))).cast("double").alias("b"))
    return x.agg(M.correlation(F.col("a"), F.col("b")).alias("value"))


def support_size(threshold: float) -> Callable[[Column], Column]:
    return lambda x: F.count_if(x > threshold)


def spatial_average(x: Column) -> Column:
    return F.avg(x)


def variation(x: Column) -> Column:
    return F.try_divide(F.stddev_pop(x), F.avg(x))


def sum_above(threshold: float) -> Callable[[Column], Column]:
    return lambda x: F.sum(F.when(x > threshold, x).otherwise(0.0))


def per_time(df: DataFrame, aggregates: dict[str, Column], time: str = "time") -> DataFrame:
    """One row per time with the given aggregates, such as counts over a threshold or domain means."""
    return df.groupBy(time).agg(*[c.alias(n) for n, c in aggregates.items()])


def count_over(x: str, threshold: float) -> Column:
    return F.count_if(M._clean(F.col(x)) > threshold)


def domain_average(x: str, threshold: float | None = None) -> Column:
    v = M._clean(F.col(x))
    return F.avg(v if threshold is None else F.when(v > threshold, v))


def band(x: str, threshold: float = 0.0, quantiles: tuple[float, float] = (0.25, 0.75)) -> list[Column]:
    """Median and quantile band of the values above a threshold, one percentile pass."""
    v = M._clean(F.col(x))
    p = F.percentile(F.when(v > threshold, v), F.array(F.lit(quantiles[0]), F.lit(0.5), F.lit(quantiles[1])))
    return [F.get(p, F.lit(0)).alias("q_low"), F.get(p, F.lit(1)).alias("median"), F.get(p, F.lit(2)).alias("q_high")]


def cluster_features(df: DataFrame, variable: str, threshold: float = 1.5, time: str = "time") -> DataFrame:
    """Per time: spm (mean), sup (share of the first time's valid cells above the threshold), std, cvr."""
    v = M._clean(F.col(variable))
    first = df.groupBy(time).agg(F.count(v).alias("n")).agg(F.min_by("n", time).alias("n0"))
    x = df.groupBy(time).agg(F.avg(v).alias("spm"), F.count_if(v > threshold).alias("c"), F.stddev_pop(v).alias("std"))
    x = x.crossJoin(F.broadcast(first))  # one row
    return x.select(time, "spm", F.try_divide("c", "n0").alias("sup"), "std", F.try_divide("std", "spm").alias("cvr"))


def row_correlations(a: DataFrame, b: DataFrame, row: str, vector: str) -> DataFrame:
    """(row_a, row_b, r): Pearson correlation of every row of ``a`` with every row of ``b``.

    Vectors are centred and scaled once; rows of zero variance give NULL.  ``b`` is the smaller side, a stated query
    set; the product of the two is the result itself.
    """
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)
    def scaled(df: DataFrame, name: str) -> DataFrame:
        x = df.select(F.col(row).alias(f"row_{name}"), F.col(vector).cast("array<double>").alias("v")).withColumn("m", mean(F.col("v")))
        x = x.withColumn("v", F.transform("v", lambda e: e - F.col("m")))
        return x.select(f"row_{name}", F.col("v").alias(f"v_{name}"), F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e)).alias(f"n_{name}"))
    x = scaled(a, "a").crossJoin(small_or_shuffled(scaled(b, "b")))
    dot = F.aggregate(F.zip_with("v_a", "v_b", lambda p, q: p * q), F.lit(0.0), lambda s, e: s + e)
    return x.select("row_a", "row_b", F.try_divide(dot, F.col("n_a") * F.col("n_b")).alias("r"))


def distance_to_median(df: DataFrame, column: str, reference: str, above: float = 20.0, time: str = "time") -> DataFrame:
    """(time, distance): median of ``column`` less that of ``reference``, each over its own values above ``above``."""
    median = lambda c: F.percentile(F.when(M._clean(F.col(c)) > above, F.col(c)), 0.5)
    return df.groupBy(time).agg((median(column) - median(reference)).alias("distance"))


def histogram(df: DataFrame, column: str, bins: int = 30, density: bool = False) -> DataFrame:
    """(bin, low, high, n): bins of equal width from least to largest value, the last closed; empty bins included."""
    if column not in df.columns:
        raise ValueError(f"no column {column!r}")
    v = M._clean(F.col(column))
    ends = df.agg(F.min(v).alias("a"), F.max(v).alias("b"), F.count(v).alias("total"))
    x = df.select(v.alias("v")).where("v is not null").crossJoin(F.broadcast(ends))  # one row
    k = F.least(F.floor(F.try_divide((F.col("v") - F.col("a")) * bins, F.col("b") - F.col("a"))), F.lit(bins - 1))
    counts = x.groupBy(F.coalesce(k, F.lit(0)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    grid = ends.select("a", "b", "total", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("b") - F.col("a")) / bins
    n = F.coalesce("n", F.lit(0))
    value = F.try_divide(n.cast("double"), F.col("total") * width) if density else n
    return grid.join(counts, "bin", "left").select("bin", (F.col("a") + F.col("bin") * width).alias("low"), (F.col("a") + (F.col("bin") + 1) * width).alias("high"), value.alias("density" if density else "n"))


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """(slope, intercept, r2, stderr, n) of least squares of y on x over complete pairs."""
    a, b = M.paired(F.col(x), F.col(y))
    z = df.agg(F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"), F.regr_r2(b, a).alias("r2"), F.regr_sxx(b, a).alias("sxx"), F.regr_syy(b, a).alias("syy"), F.count(a).alias("n"))
    err = F.sqrt(F.try_divide((1 - F.col("r2")) * F.col("syy"), (F.col("n") - 2) * F.col("sxx")))
    return z.select("slope", "intercept", "r2", err.alias("stderr"), "n")


def plot_levels(df: DataFrame, columns: list[str], n: int | None = None, most: float | None = None) -> list[float]:
    """Rounded, evenly spaced levels from the least to the largest value of some columns."""
    r = df.agg(F.least(*[F.min(M._clean(F.col(c))) for c in columns]).alias("a") if len(columns) > 1 else F.min(M._clean(F.col(columns[0]))).alias("a"), F.greatest(*[F.max(M._clean(F.col(c))) for c in columns]).alias("b") if len(columns) > 1 else F.max(M._clean(F.col(columns[0]))).alias("b")).first()
    top = most if most is not None else r.b
    k = n or (int(top // 10) + 1 if top // 10 >= 3 else 11)
    return [round(r.a + (top - r.a) * i / (k - 1), 2) for i in range(k)] if k > 1 else [round(r.a, 2)]
