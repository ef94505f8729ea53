"""Scores as aggregate Column expressions over an observed and a simulated column.

NaN counts as NULL.  With ``skipna`` every score uses the complete pairs only.  Without it, correlation and KGE are
NULL if any value is missing, the relative bias sums each column on its own, RMSE is pairwise, and R2 takes the
observed variance over all observations.  Standard deviations are of the population.  Division by zero gives NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _clean(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def paired(a: Column, b: Column) -> tuple[Column, Column]:
    """Both columns, NULL wherever one of them is NULL or NaN."""
    a, b = _clean(a), _clean(b)
    both = a.isNotNull() & b.isNotNull()
    return F.when(both, a), F.when(both, b)


def _whole(a: Column, b: Column, value: Column, skipna: bool) -> Column:
    if skipna:
        return value
    missing = F.count_if(_clean(a).isNull() | _clean(b).isNull())
    return F.when(missing == 0, value)


def correlation(obs: Column, sim: Column, skipna: bool = True) -> Column:
    a, b = paired(obs, sim)
    return _whole(obs, sim, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)), skipna)


def rmse(obs: Column, sim: Column, skipna: bool = True) -> Column:
    a, b = paired(obs, sim)
    return F.sqrt(F.avg((a - b) * (a - b)))


def relative_bias(obs: Column, sim: Column, skipna: bool = True) -> Column:
    a, b = paired(obs, sim) if skipna else (_clean(obs), _clean(sim))
    return F.try_divide(F.sum(b) - F.sum(a), F.sum(a))


def kge(obs: Column, sim: Column, skipna: bool = True) -> Column:
    """Kling-Gupta efficiency with variation and bias as obs over sim; swap the arguments for the other reading."""
    a, b = paired(obs, sim)
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    gamma = F.try_divide(F.stddev_pop(a), F.avg(a)) - F.try_divide(F.stddev_pop(b), F.avg(b))
    beta = F.try_divide(F.avg(a), F.avg(b)) - 1
    return _whole(obs, sim, 1 - F.sqrt((r - 1) * (r - 1) + gamma * gamma + beta * beta), skipna)


def r2(obs: Column, sim: Column, skipna: bool = True) -> Column:
    a, b = paired(obs, sim)
    own = a if skipna else _clean(obs)
    return 1 - F.try_divide(F.sum((a - b) * (a - b)), F.var_pop(own) * F.count(own))


def psnr(img1: Column, img2: Column) -> Column:
    a, b = paired(img1, img2)
    mse = F.avg((a - b) * (a - b))
    peak = F.greatest(F.max(a), F.max(b))
    return F.when(mse == 0, F.lit(100.0)).when(peak > 0, 20 * F.log10(F.try_divide(peak, F.sqrt(mse))))


def contingency(obs: Column, sim: Column, threshold: Column | float, detection: Column | float | None = None) -> dict[str, Column]:
    """Counts tp, fp, fn, tn; both sides strict, so a value equal to its threshold is in no class."""
    a, b = paired(obs, sim)
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    d = t if detection is None else detection if isinstance(detection, Column) else F.lit(float(detection))
    return {"tp": F.count_if((a > t) & (b > d)), "fp": F.count_if((a < t) & (b > d)), "fn": F.count_if((a > t) & (b < d)), "tn": F.count_if((a < t) & (b < d))}


SCORES = {"correlation": correlation, "rmse": rmse, "rbias": relative_bias, "kge": kge, "r2": r2}
