"""Bias correction of one source against another: quantile matching and linear regression."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainloom.functions.metrics import _clean
from rainloom.functions.scalar import echelon_down, echelon_up
from rainloom.session import checkpointed

#: Most quantiles that one percentile call is asked for.
FEW = 128


def exact_quantiles(df: DataFrame, columns: list[str], quantiles: list[float]) -> dict[str, np.ndarray]:
    """Quantiles by linear interpolation; NULL and NaN are no values.

    A few come from one percentile aggregation.  Many come from ranks: the values of all columns are counted,
    range-partitioned and summed up with one offset per partition, so neither one task nor the driver holds a column.
    """
    if len(quantiles) <= FEW:
        r = df.agg(*[F.percentile(_clean(F.col(c)), F.array(*map(F.lit, quantiles))).alias(c) for c in columns]).first()
        return {c: np.array(r[c], float) if r[c] is not None else np.full(len(quantiles), np.nan) for c in columns}
    return _by_rank(df, columns, quantiles)


def _by_rank(df: DataFrame, columns: list[str], quantiles: list[float]) -> dict[str, np.ndarray]:
    parts = F.array(*[F.struct(F.lit(i).alias("c"), _clean(F.col(c)).alias("v")) for i, c in enumerate(columns)])
    v = df.select(F.explode(parts).alias("p")).select("p.c", "p.v").where("v is not null").groupBy("c", "v").agg(F.count("*").alias("n"))
    x = checkpointed(v.repartitionByRange("c", "v").sortWithinPartitions("c", "v").withColumn("pid", F.spark_partition_id()))
    sums = sorted((r.c, r.pid, r.n) for r in x.groupBy("c", "pid").agg(F.sum("n").alias("n")).collect())  # one row per column and partition
    wanted: dict[tuple[int, int], tuple[int, np.ndarray]] = {}
    places = {}
    for i in range(len(columns)):
        own = [(pid, n) for c, pid, n in sums if c == i]
        total = sum(n for _, n in own)
        if not total:
            continue
        at = np.asarray(quantiles) * (total - 1)
        low, high = np.floor(at).astype(np.int64), np.minimum(np.floor(at) + 1, total - 1).astype(np.int64)
        places[i], ranks = (at, low, high), np.unique(np.concatenate([low, high]))
        begin = 0
        for pid, n in own:
            mine = ranks[np.searchsorted(ranks, begin) : np.searchsorted(ranks, begin + n)]
            if len(mine):
                wanted[i, pid] = begin, mine
            begin += n

    def pick(batches):
        """Values of the ranks asked for; a partition comes in order of column and value."""
        done: dict[tuple[int, int], int] = {}
        for b in batches:
            c, r, out = [], [], []
            for (col, pid), g in b.groupby(["c", "pid"], sort=False):
                if (col, pid) not in wanted:
                    continue
                begin, ranks = wanted[col, pid]
                ends = done.get((col, pid), begin) + np.cumsum(g["n"].to_numpy())
                first, done[col, pid] = done.get((col, pid), begin), int(ends[-1])
                mine = ranks[np.searchsorted(ranks, first) : np.searchsorted(ranks, ends[-1])]
                c.append(np.full(len(mine), col))
                r.append(mine)
                out.append(g["v"].to_numpy()[np.searchsorted(ends, mine, "right")])
            if c:
                yield pd.DataFrame({"c": np.concatenate(c), "r": np.concatenate(r), "v": np.concatenate(out)})

    got = x.mapInPandas(pick, "c int, r long, v double").collect()  # as many rows as ranks were asked for
    value = {(r.c, r.r): r.v for r in got}
    out = {}
    for i, name in enumerate(columns):
        if i not in places:
            out[name] = np.full(len(quantiles), np.nan)
            continue
        at, low, high = places[i]
        a, b = (np.array([value[i, int(k)] for k in z]) for z in (low, high))
        out[name] = a + (b - a) * (at - low)
    return out


def fit_quadratic(x: np.ndarray, y: np.ndarray, absolute: bool = True) -> np.ndarray:
    """a, b, c of y = |a| x**2 + b x + c by least squares; where a would be negative the best fit has a = 0."""
    ok = ~np.isnan(x) & ~np.isnan(y)
    x, y = x[ok], y[ok]
    p = np.linalg.lstsq(np.stack([x * x, x, np.ones_like(x)], 1), y, rcond=None)[0]
    if absolute and p[0] < 0:
        p = np.append(0.0, np.linalg.lstsq(np.stack([x, np.ones_like(x)], 1), y, rcond=None)[0])
    return p


def fit_callable(f: Callable, x: np.ndarray, y: np.ndarray, n: int, steps: int = 200) -> np.ndarray:
    """Least squares of any f(x, *p) with n parameters, from ones, by damped Gauss-Newton."""
    p, damp = np.ones(n), 1e-3
    cost = float(((f(x, *p) - y) ** 2).sum())
    for _ in range(steps):
        base = f(x, *p)
        h = 1e-6 * np.maximum(1.0, np.abs(p))
        jac = np.stack([(f(x, *(p + h * (np.arange(n) == i))) - base) / h[i] for i in range(n)], 1)
        a = jac.T @ jac
        step = np.linalg.lstsq(a + damp * np.diag(np.maximum(np.diag(a), 1e-12)), jac.T @ (y - base), rcond=None)[0]
        new = float(((f(x, *(p + step)) - y) ** 2).sum())
        if new <= cost:
            done = cost - new <= 1e-14 * max(cost, 1e-300)
            p, cost, damp = p + step, new, damp / 3
            if done:
                break
        else:
            damp *= 4
            if damp > 1e12:
                break
    return p


def quadratic(x: Column, p: np.ndarray) -> Column:
    return abs(float(p[0])) * x * x + float(p[1]) * x + float(p[2])


def clipped(x: Column) -> Column:
    """Negative values as zero; NULL stays NULL."""
    return F.when(x < 0, F.lit(0.0)).otherwise(x)


def rescaled(quantiles: np.ndarray, cut: float) -> tuple[np.ndarray, np.ndarray]:
    return quantiles * cut, cut + quantiles * (1 - cut)


class Fuser:
    """Fits ``field`` to ``reference`` and applies it: qmatch, qmatch_by_parts or linreg, whole or per land and sea.

    ``clip_first`` clips the two parts before they are blended instead of after.
    """

    METHODS = ("qmatch", "qmatch_by_parts", "linreg")

    def __init__(self, method: str = "qmatch", reference: str = "radar", field: str | None = None, quantiles: np.ndarray | None = None, cut: float = 0.75, land: Column | None = None, clip_first: bool = False, speed: float = 20.0):
        if method not in self.METHODS:
            raise ValueError(f"unknown method {method!r}; known: {', '.join(self.METHODS)}")
        self.method, self.reference, self.field, self.cut, self.land, self.clip_first, self.speed = method, reference, field, cut, land, clip_first, speed
        self.quantiles = np.linspace(0, 1, 10_000, endpoint=False) if quantiles is None else np.asarray(quantiles)

    def fields(self, df: DataFrame) -> tuple[str, str]:
        """The reference, the first variable that contains its name, and the other variable."""
        names = [c for c, t in df.dtypes if t in ("double", "float") and c not in ("lat", "lon")]
        ref = next((c for c in names if self.reference in c), None)
        rest = [c for c in names if c != ref]
        if ref is None or (self.field is None and len(rest) != 1):
            raise ValueError("needs a reference and exactly one other variable")
        return ref, self.field or rest[0]

    def _part(self, df: DataFrame, ref: str, field: str, time: str) -> dict:
        if self.method == "linreg":
            x = df.groupBy(time).agg(F.avg(_clean(F.col(field))).alias("x"), F.avg(_clean(F.col(ref))).alias("y")).where("x is not null and y is not null")
            r = x.agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx")).first()
            return {"a": r.xy / r.xx if r.xx else float("nan")}
        if self.method == "qmatch":
            q = exact_quantiles(df, [field, ref], list(self.quantiles))
            return {"p": fit_quadratic(q[field], q[ref])}
        low, high = rescaled(self.quantiles, self.cut)
        every = exact_quantiles(df, [field, ref], [*low, *high, self.cut])
        n = len(low)
        return {"low": fit_quadratic(every[field][:n], every[ref][:n]), "high": fit_quadratic(every[field][n : 2 * n], every[ref][n : 2 * n]), "offset": float(every[field][-1])}

    def fit(self, df: DataFrame, time: str = "time") -> dict:
        ref, field = self.fields(df)
        if self.land is None:
            return {"all": self._part(df, ref, field, time)}
        return {"land": self._part(df.where(self.land), ref, field, time), "sea": self._part(df.where(~self.land), ref, field, time)}

    def _apply(self, x: Column, p: dict) -> Column:
        if self.method == "linreg":
            return p["a"] * x
        if self.method == "qmatch":
            return clipped(quadratic(x, p["p"]))
        low, high = quadratic(x, p["low"]), quadratic(x, p["high"])
        if self.clip_first:
            low, high = clipped(low), clipped(high)
        blend = low * echelon_down(x, p["offset"], self.speed) + high * echelon_up(x, p["offset"], self.speed)
        return blend if self.clip_first else clipped(blend)

    def transform(self, df: DataFrame, params: dict | None = None, suffix: str = "matched") -> DataFrame:
        """``df`` with ``<field>_<suffix>``; fitted on ``df`` itself if no parameters are given."""
        params = params or self.fit(df)
        _, field = self.fields(df)
        x = _clean(F.col(field))
        if "all" in params:
            return df.withColumn(f"{field}_{suffix}", self._apply(x, params["all"]))
        return df.withColumn(f"{field}_{suffix}", F.when(self.land, self._apply(x, params["land"])).when(~self.land, self._apply(x, params["sea"])))
