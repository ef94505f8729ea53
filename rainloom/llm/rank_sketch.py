"""Percentiles of very large columns with multiplicative rank error, from mergeable sketches (problem 7).

A sketch is a stack of relative compactors.  A level keeps its largest values untouched and compacts only the
lower part, in sections whose number follows how often the level was compacted; half of the compacted values
move up with doubled weight.  So the error of a rank shrinks with its distance from the top, and sketches of
partitions, files or days merge level by level.  The method is that of Cormode, Karnin, Liberty, Thaler and Vesely,
"Relative Error Streaming Quantiles" (2021).

Values are kept in two stacks, one exact at the top and one at the bottom, and a percentile is read from the
nearer one, so the error is proportional to the smaller of q and 1 - q.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Section size; three sections at first.
K = 16
QUANTILES = [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999]


def rank_error(q: float, k: int = K, sigmas: float = 3.0) -> float:
    """Bound of the error of a normalised rank: proportional to the share of values beyond it on the nearer side."""
    return sigmas * (0.0512 / 3) ** 0.5 / k * min(q, 1.0 - q)


class RankSketch:
    """Quantile sketch that is most exact at high ranks (or, with ``low=True``, at low ones)."""

    def __init__(self, k: int = K, low: bool = False):
        if k < 4 or k % 2:
            raise ValueError("k must be even and at least 4")
        self.k, self.low, self.n = k, low, 0
        self.levels: list[np.ndarray] = [np.zeros(0)]
        self.shape: list[list[float]] = [[0, 3, float(k)]]  # state, sections, section size
        self.least, self.most = np.inf, -np.inf

    def update(self, values: np.ndarray) -> "RankSketch":
        """Add values; NaN are skipped."""
        v = np.asarray(values, float)
        v = v[~np.isnan(v)]
        for part in np.array_split(v, max(1, len(v) // 65_536 + 1)):
            if len(part):
                self.n += len(part)
                self.least, self.most = min(self.least, float(part.min())), max(self.most, float(part.max()))
                self.levels[0] = np.concatenate([self.levels[0], -part if self.low else part])
                self._compress()
        return self

    def merge(self, other: "RankSketch") -> "RankSketch":
        if (self.k, self.low) != (other.k, other.low):
            raise ValueError("sketches of different kinds")
        while len(self.levels) < len(other.levels):
            self.levels.append(np.zeros(0))
            self.shape.append([0, 3, float(self.k)])
        for h, v in enumerate(other.levels):
            self.levels[h] = np.concatenate([self.levels[h], v])
            mine, its = self.shape[h], other.shape[h]
            state = int(mine[0]) | int(its[0])
            self.shape[h] = [state, *(max(mine[1:], its[1:]))]
        self.n += other.n
        self.least, self.most = min(self.least, other.least), max(self.most, other.most)
        self._compress()
        return self

    def _compress(self) -> None:
        h = 0
        while h < len(self.levels):
            while len(self.levels[h]) > 2 * self.shape[h][1] * _even(self.shape[h][2]):
                self._compact(h)
            h += 1

    def _compact(self, h: int) -> None:
        state, sections, size = int(self.shape[h][0]), int(self.shape[h][1]), self.shape[h][2]
        trailing = ((~state) & (state + 1)).bit_length() - 1
        part = min(trailing + 1, sections)
        keep = sections * _even(size) + (sections - part) * _even(size)
        v = np.sort(self.levels[h])
        n = len(v) - keep
        n -= n % 2
        rng = np.random.default_rng((self.n, h, state))
        up = v[:n][int(rng.integers(2)) :: 2]
        self.levels[h] = v[n:]
        if h + 1 == len(self.levels):
            self.levels.append(np.zeros(0))
            self.shape.append([0, 3, float(self.k)])
        self.levels[h + 1] = np.concatenate([self.levels[h + 1], up])
        # only now may the sections double: a compaction must see the room that filled up
        if state + 1 >= 1 << (sections - 1) and _even(size / 2**0.5) >= 4:
            sections, size = sections * 2, size / 2**0.5
        self.shape[h] = [state + 1, sections, size]

    def weight(self) -> int:
        """Number of values that the levels stand for; always ``n``."""
        return sum(len(v) << h for h, v in enumerate(self.levels))

    def quantiles(self, q: list[float]) -> np.ndarray:
        """Values whose share of values at or below is the first to reach each q; NaN for an empty sketch."""
        if not self.n:
            return np.full(len(q), np.nan)
        v = np.concatenate(self.levels)
        w = np.concatenate([np.full(len(x), 1 << h, np.int64) for h, x in enumerate(self.levels)])
        v = -v if self.low else v
        order = np.argsort(v, kind="stable")
        rank = np.cumsum(w[order])
        at = np.searchsorted(rank, np.ceil(np.clip(q, 0, 1) * rank[-1] - 1e-9), "left")
        out = v[order][np.minimum(at, len(v) - 1)]
        return np.where(np.asarray(q) <= 0, self.least, np.where(np.asarray(q) >= 1, self.most, out))

    def dump(self) -> bytes:
        head = struct.pack("<iiqddi", self.k, self.low, self.n, self.least, self.most, len(self.levels))
        rows = b"".join(struct.pack("<qidi", int(s[0]), int(s[1]), s[2], len(v)) for s, v in zip(self.shape, self.levels))
        return head + rows + np.concatenate(self.levels).tobytes()

    @staticmethod
    def load(b: bytes) -> "RankSketch":
        k, low, n, least, most, levels = struct.unpack_from("<iiqddi", b)
        s = RankSketch(k, bool(low))
        s.n, s.least, s.most = n, least, most
        at = struct.calcsize("<iiqddi")
        step = struct.calcsize("<qidi")
        rows = [struct.unpack_from("<qidi", b, at + i * step) for i in range(levels)]
        v = np.frombuffer(b, float, offset=at + levels * step)
        cuts = np.cumsum([r[3] for r in rows])[:-1]
        s.levels = [x.copy() for x in np.split(v, cuts)]
        s.shape = [[r[0], r[1], r[2]] for r in rows]
        return s


class TailSketch:
    """Quantile sketch exact at both tails: two one-sided ones.  Few values are kept as they are, once."""

    #: Values that a sketch holds as they are.
    WHOLE = 4 * K

    def __init__(self, k: int = K):
        self.k, self.whole, self.sides = k, np.zeros(0), None

    @property
    def n(self) -> int:
        return len(self.whole) if self.sides is None else self.sides[0].n

    def update(self, values: np.ndarray) -> "TailSketch":
        """Add values; NaN are skipped."""
        v = np.asarray(values, float)
        return self._add(v[~np.isnan(v)])

    def _add(self, v: np.ndarray) -> "TailSketch":
        if self.sides is None:
            if len(self.whole) + len(v) <= self.WHOLE:
                self.whole = np.concatenate([self.whole, v])
                return self
            v = np.concatenate([self.whole, v])
            self.whole, self.sides = np.zeros(0), (RankSketch(self.k), RankSketch(self.k, low=True))
        for s in self.sides:
            s.update(v)
        return self

    def merge(self, other: "TailSketch") -> "TailSketch":
        if self.k != other.k:
            raise ValueError("sketches of different kinds")
        if other.sides is None:
            return self._add(other.whole)
        if self.sides is None:
            held, self.whole = self.whole, np.zeros(0)
            self.sides = tuple(RankSketch.load(s.dump()) for s in other.sides)
            return self._add(held) if len(held) else self
        for mine, its in zip(self.sides, other.sides):
            mine.merge(its)
        return self

    def quantiles(self, q: list[float]) -> np.ndarray:
        """Values whose share of values at or below is the first to reach each q; NaN for an empty sketch."""
        q = np.asarray(q, float)
        if self.sides is None:
            if not self.n:
                return np.full(len(q), np.nan)
            v = np.sort(self.whole)
            return v[np.clip(np.ceil(np.clip(q, 0, 1) * len(v) - 1e-9).astype(int) - 1, 0, len(v) - 1)]
        high, low = self.sides
        return np.where(q < 0.5, low.quantiles(q), high.quantiles(q))

    def dump(self) -> bytes:
        if self.sides is None:
            return struct.pack("<bi", 0, self.k) + self.whole.tobytes()
        high, low = (s.dump() for s in self.sides)
        return struct.pack("<bii", 1, self.k, len(high)) + high + low

    @staticmethod
    def load(b: bytes) -> "TailSketch":
        kind, k = struct.unpack_from("<bi", b)
        s = TailSketch(k)
        if kind == 0:
            s.whole = np.frombuffer(b, float, offset=5).copy()
        else:
            n = struct.unpack_from("<i", b, 5)[0]
            s.sides = RankSketch.load(b[9 : 9 + n]), RankSketch.load(b[9 + n :])
        return s


def _even(size: float) -> int:
    return int(round(size / 2)) * 2


def _runs(keys: list[np.ndarray]) -> np.ndarray:
    """Begins of the runs of equal keys, and the end."""
    change = np.zeros(len(keys[0]), bool)
    change[:1] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.append(np.nonzero(change)[0], len(change))


def day_sketches(values: DataFrame, k: int = K) -> DataFrame:
    """One or more sketches per (kind, key, day) of the rows (kind, key, day, value): (kind, key, day, n, sketch).

    A hot key is spread over its days, and a day's rows become one sketch per batch, so no task or row grows with
    a key.  NULL and NaN values are no values; NULL kinds, keys or days are left out.
    """
    x = values.where("kind is not null and key is not null and day is not null and value is not null and not isnan(value)")
    x = x.repartition("kind", "key", "day").sortWithinPartitions("kind", "key", "day")

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            cuts = _runs([b["kind"].to_numpy(), b["key"].to_numpy(), b["day"].to_numpy()])
            v = b["value"].to_numpy(float)
            first = b.iloc[cuts[:-1]]
            sketches = [TailSketch(k).update(v[a:e]) for a, e in zip(cuts[:-1], cuts[1:])]
            yield pd.DataFrame({"kind": first["kind"], "key": first["key"], "day": first["day"], "n": [s.n for s in sketches], "sketch": [s.dump() for s in sketches]})

    return x.select("kind", "key", "day", "value").mapInPandas(run, "kind string, key string, day int, n long, sketch binary")


def merged(sketches: DataFrame, by: list[str], salts: int = 16) -> DataFrame:
    """Sketches of one row per ``by`` (some of kind, key, day) and the number of values: (by, n, sketch).

    Merging goes in two levels: first by ``by`` and a hash of the other columns, then by ``by`` alone, so of a hot
    key a task merges a ``salts``-th of the sketches or at most ``salts`` of them.
    """
    rest = [c for c in ("kind", "key", "day") if c in sketches.columns and c not in by]
    if rest:
        salted = sketches.withColumn("salt", F.pmod(F.xxhash64(*rest), F.lit(salts)))
        sketches = _merged(salted, [*by, "salt"])
    return _merged(sketches, by)


def _merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    x = sketches.select(*by, "sketch").repartition(*by).sortWithinPartitions(*by)
    schema = ", ".join(f"{c} {dict(sketches.dtypes)[c]}" for c in by) + ", n long, sketch binary"

    def run(batches):
        key, held, first = None, None, b""
        whole = lambda: first if held is None else held.dump()
        count = lambda: TailSketch.load(first).n if held is None else held.n
        for b in batches:
            rows = []
            for *k, s in b[[*by, "sketch"]].itertuples(index=False, name=None):
                if k != key:
                    if key is not None:
                        rows.append((*key, count(), whole()))
                    key, held, first = k, None, s
                else:
                    held = held or TailSketch.load(first)
                    held.merge(TailSketch.load(s))
            yield pd.DataFrame(rows, columns=[*by, "n", "sketch"])
        if key is not None:
            yield pd.DataFrame([(*key, count(), whole())], columns=[*by, "n", "sketch"])

    return x.mapInPandas(run, schema)


def percentiles(sketches: DataFrame, quantiles: list[float] = QUANTILES, k: int = K) -> DataFrame:
    """Sketch rows as values: the other columns, then q, value and rank_error.

    rank_error is three standard errors of the normalised rank, proportional to the smaller of q and 1 - q.
    """
    keep = [c for c in sketches.columns if c != "sketch"]
    types = dict(sketches.dtypes)

    def run(batches):
        for b in batches:
            m = len(quantiles)
            out = {c: np.repeat(b[c].to_numpy(), m) for c in keep}
            out["q"] = np.tile(quantiles, len(b))
            out["value"] = np.concatenate([TailSketch.load(s).quantiles(quantiles) for s in b["sketch"]]) if len(b) else np.zeros(0)
            out["rank_error"] = np.tile([rank_error(q, k) for q in quantiles], len(b))
            yield pd.DataFrame(out)

    return sketches.mapInPandas(run, ", ".join(f"{c} {types[c]}" for c in keep) + ", q double, value double, rank_error double")


def rank_checks(values: DataFrame, found: DataFrame, quantiles: list[float] = QUANTILES) -> DataFrame:
    """Percentiles held against exact ranks: (kind, key, q, n, within).

    ``within`` says that a value's share of smaller and of not larger values enclose q up to its rank_error and one
    value.  Percentiles meet their values as one row per key, so values are joined once.
    """
    one = found.groupBy("kind", "key").pivot("q", quantiles).agg(F.first(F.struct("value", "rank_error")))
    one = one.toDF("f_kind", "f_key", *[f"q{i}" for i in range(len(quantiles))])
    x = values.join(one, (F.col("kind") == F.col("f_kind")) & (F.col("key") == F.col("f_key")))
    counts = []
    for i in range(len(quantiles)):
        counts += [F.count_if(F.col("value") < F.col(f"q{i}.value")).alias(f"b{i}"), F.count_if(F.col("value") <= F.col(f"q{i}.value")).alias(f"m{i}"), F.first(f"q{i}.rank_error").alias(f"e{i}")]
    g = x.groupBy("kind", "key").agg(F.count("*").alias("n"), *counts)
    rows = F.array(*[F.struct(F.lit(float(q)).alias("q"), F.col(f"b{i}").alias("b"), F.col(f"m{i}").alias("m"), F.col(f"e{i}").alias("e")) for i, q in enumerate(quantiles)])
    g = g.select("kind", "key", "n", F.explode(rows).alias("r"))
    slack = F.col("r.e") + 1 / F.col("n") + 1e-12
    return g.select("kind", "key", "r.q", "n", ((F.col("r.b") / F.col("n") - slack <= F.col("r.q")) & (F.col("r.m") / F.col("n") + slack >= F.col("r.q"))).alias("within"))


def imerg_values(grid: DataFrame) -> DataFrame:
    """(kind, key, day, value) of the grid: one usable value per cell and step, of the final run if there is one.

    Of repeated rows with different values of one run the smallest counts.
    """
    x = grid.where("time is not null and lat is not null and lon is not null and precipitationcal >= 0 and not isnan(precipitationcal)")
    day = F.unix_date(F.to_date("time"))
    key = F.format_string("%.4f,%.4f", "lat", "lon")
    x = x.select(key.alias("key"), day.alias("day"), "time", F.when(F.col("run_type") == "final", 0).otherwise(1).alias("late"), F.col("precipitationcal").alias("v"))
    x = x.repartition("key", "day").groupBy("key", "day", "time").agg(F.min(F.struct("late", "v")).alias("m"))
    return x.select(F.lit("precipitationcal").alias("kind"), "key", "day", F.col("m.v").alias("value"))


def rain_values(readings: DataFrame) -> DataFrame:
    """(kind, key, day, value) of readings (poste, time, value in mm/h); a reading delivered twice counts once."""
    x = readings.where("poste is not null and time is not null and value >= 0 and not isnan(value)")
    x = x.select(F.col("poste").cast("string").alias("key"), F.unix_date(F.to_date("time")).alias("day"), "time", "value")
    x = x.repartition("key", "day").dropDuplicates(["key", "day", "time", "value"])
    return x.select(F.lit("rain_rate").alias("kind"), "key", "day", "value")
