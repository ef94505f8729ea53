"""Implausible readings of a source (problem 3).

An isolation forest per source scores every reading on four features: level, difference to the reading
before, departure from the hour's usual level, and length of the run of equal values.  The forest picks the
spikes: readings above a wide gap are spikes if they are isolated, that is if their mean score reaches
``SPIKE_SCORE``; exact checks of the gap follow.  What is physically impossible or stuck is said by rules.

A source is cut into blocks of days, and a block travels as one row with arrays, so no task holds a whole
source, however hot it is.  Three small tables with one row per source and block connect the blocks: runs
that cross an edge and the usual levels, then the forest, which is fitted once per source and sent to its blocks.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rainloom.functions import forest
from rainloom.functions.whole_groups import numbered, whole_groups
from rainloom.session import checkpointed, epoch_us, floor_div, small_or_shuffled

BLOCK_US = 10 * 86_400_000_000
#: Readings of a source that its forest is fitted on, at most.
SAMPLE = 256
#: Mean isolation score from which readings above a gap are spikes.
SPIKE_SCORE = 0.54
FEATURES = ["level", "difference", "seasonal", "run"]
_HOURS = 4
_KEYS = ["s_poste", "s_field", "block"]
_NO_OCTAVE = -10_000


def _lists(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Flat values of a list column and the length of each list."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return c.flatten().to_numpy(zero_copy_only=False), np.diff(c.offsets.to_numpy()).astype(np.int64)


def _to_lists(flat: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), pa.array(flat, kind))


def _slices(batches, rows: int = 512):
    """Batches of at most ``rows`` blocks, so that memory follows the blocks held at once."""
    for whole in batches:
        if whole.num_rows <= rows:
            if whole.num_rows:
                yield whole
            continue
        for a in range(0, whole.num_rows, rows):
            b = whole.slice(a, rows)
            yield pa.RecordBatch.from_arrays([c.take(pa.array(range(len(c)))) for c in b.columns], names=b.schema.names)


class _Packs:
    """Readings of many blocks in flat arrays: where runs begin, what is repeated, how long runs are."""

    def __init__(self, b: pa.RecordBatch):
        self.b = b
        self.us, self.n = _lists(b.column("us"))
        self.value, _ = _lists(b.column("value"))
        self.of = np.repeat(np.arange(len(self.n)), self.n)
        first = np.zeros(len(self.us), bool)
        first[(np.cumsum(self.n) - self.n)[self.n > 0]] = True
        before = np.r_[np.nan, self.value[:-1]][: len(self.value)]
        self.before = np.where(first, np.nan, before)
        self.head = first | (self.value != before)
        same_time = np.r_[False, self.us[1:] == self.us[:-1]][: len(self.us)]
        self.repeated = ~self.head & same_time
        self.island = np.cumsum(self.head) - 1
        self.own = np.bincount(self.island, ~self.repeated).astype(np.int64) if len(self.island) else np.zeros(0, np.int64)
        self.first, self.last = np.cumsum(self.n) - self.n, np.cumsum(self.n) - 1
        self.limit = b.column("most").to_numpy(zero_copy_only=False)[self.of]
        self.impossible = (self.value < 0) | (self.value > self.limit)
        self.level = np.sign(self.value) * np.log1p(np.abs(self.value))
        self.hour = (self.us // (6 * 3_600_000_000)) % _HOURS

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Features of all readings and their run's length; the columns of ``_connected`` must be there."""
        run = self.own.copy()
        run[self.island[self.last]] = self.b.column("run_last").to_numpy(zero_copy_only=False)
        run[self.island[self.first]] = self.b.column("run_first").to_numpy(zero_copy_only=False)
        run = run[self.island]
        before = self.before.copy()
        before[self.first] = self.b.column("before").to_numpy(zero_copy_only=False).astype(float)
        usual, _ = _lists(self.b.column("usual"))
        seasonal = self.level - usual[self.of * _HOURS + self.hour]
        was = np.where(np.isnan(before), self.value, before)
        difference = np.abs(self.level - np.sign(was) * np.log1p(np.abs(was)))
        x = np.stack([self.level, difference, seasonal, np.where(self.value > 0, np.log1p(run), 0.0)], 1)
        # a repeated delivery looks like the first one
        at = np.maximum.accumulate(np.where(self.repeated, 0, np.arange(len(run)))) if len(run) else np.zeros(0, int)
        return x[at], run


def _edges(batches):
    """Per block: its first and last run, and sums of the usual levels."""
    for b in _slices(batches):
        p = _Packs(b)
        use = ~p.impossible & ~p.repeated
        at = p.of * _HOURS + p.hour
        size = b.num_rows * _HOURS
        i, j = p.island[p.first], p.island[p.last]
        four = np.full(b.num_rows, _HOURS)
        yield pa.RecordBatch.from_arrays(
            [*[b.column(k) for k in _KEYS], pa.array(p.value[p.first]), pa.array(p.own[i]), pa.array(p.value[p.last]), pa.array(p.own[j]), pa.array(j - i),
             _to_lists(np.bincount(at[use], p.level[use], size), four, pa.float64()), _to_lists(np.bincount(at[use], minlength=size), four, pa.int64())],
            names=[*_KEYS, "v_first", "n_first", "v_last", "n_last", "islands", "h_sum", "h_n"],
        )


def _connect(batches):
    """Per block, from ``_edges`` in order: the value before it, its edge runs' full lengths, its source's usual levels."""
    for x in whole_groups(batches, _KEYS[:2]):
        source = numbered(x, _KEYS[:2])
        two = (x["islands"] > 0).to_numpy()
        row = np.repeat(np.arange(len(x)), 1 + two)
        second = np.r_[False, row[1:] == row[:-1]]
        value = np.where(second, x["v_last"].to_numpy()[row], x["v_first"].to_numpy()[row])
        own = np.where(second, x["n_last"].to_numpy()[row], x["n_first"].to_numpy()[row])
        known = np.r_[False, source[row[1:]] == source[row[:-1]]]
        joins = known & ~second & np.r_[False, value[1:] == value[:-1]]
        run = np.cumsum(~joins) - 1
        total = np.bincount(run, own).astype(np.int64)[run]
        before = np.where(known, np.r_[np.nan, value[:-1]], np.nan)
        sums, counts = np.stack(x["h_sum"].to_numpy()), np.stack(x["h_n"].to_numpy())
        size = source[-1] + 1
        usual = np.stack([np.bincount(source, sums[:, h], size) / np.maximum(np.bincount(source, counts[:, h], size), 1) for h in range(_HOURS)], 1)
        out = x[_KEYS].copy()
        out["before"], out["run_first"] = before[~second], total[~second]
        out["run_last"] = total[np.r_[~second[1:], True]]
        out["usual"] = list(usual[source])
        yield out


def _candidates(sample: int):
    def run(batches):
        """Per block: the feature box of its readings, and the readings with the smallest hashes, for the sample."""
        for b in _slices(batches):
            p = _Packs(b)
            x, _ = p.features()
            low, high = np.minimum.reduceat(x, p.first), np.maximum.reduceat(x, p.first)
            ids, _ = _lists(b.column("row_id"))
            draw = forest.uniform(ids, 17)
            at = np.nonzero(~p.repeated)[0]
            at = at[np.lexsort((ids[at], draw[at], p.of[at]))]
            n = np.bincount(p.of[at], minlength=b.num_rows)
            at = at[np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) < sample]
            n = np.minimum(n, sample)
            box = lambda z: _to_lists(z.ravel(), np.full(len(z), len(FEATURES)), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [*[b.column(k) for k in _KEYS], box(low), box(high), _to_lists(draw[at], n, pa.float64()), _to_lists(x[at].ravel(), n * len(FEATURES), pa.float64())], names=[*_KEYS, "low", "high", "draw", "x"]
            )

    return run


def _fit(sample: int):
    def run(batches):
        """The forest of each source, given to each of its blocks."""
        for g in whole_groups(batches, _KEYS[:2], 2_000):
            source = numbered(g, _KEYS[:2])
            starts = np.nonzero(np.r_[True, source[1:] != source[:-1]])[0]
            low, high = np.minimum.reduceat(np.stack(g["low"].to_numpy()), starts), np.maximum.reduceat(np.stack(g["high"].to_numpy()), starts)
            draw, x = np.concatenate(g["draw"].to_numpy()), np.concatenate(g["x"].to_numpy()).reshape(-1, len(FEATURES))
            of = np.repeat(source, g["draw"].map(len))
            order = np.lexsort((draw, of))
            n = np.bincount(of, minlength=len(starts))
            order = order[np.arange(len(order)) - np.repeat(np.cumsum(n) - n, n) < sample]
            n = np.minimum(n, sample)
            first = g.iloc[starts]
            seeds = pd.util.hash_pandas_object(first[_KEYS[:2]], index=False).to_numpy().view(np.int64)
            models = []
            for a in range(0, len(starts), 256):  # memory follows the sources grown at once
                part = slice(int(n[:a].sum()), int(n[: a + 256].sum()))
                trees = forest.grow(x[order][part], n[a : a + 256], low[a : a + 256], high[a : a + 256], seeds[a : a + 256])
                models += [zlib.compress(b"".join(t[i].tobytes() for t in trees), 1) for i in range(len(n[a : a + 256]))]
            out = g[_KEYS].copy()
            out["model"] = [models[i] for i in source]
            yield out

    return run


def _load(models: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = forest.TREES * forest.NODES
    raw = [zlib.decompress(m) for m in models]
    part = lambda a, kind, width: np.stack([np.frombuffer(r, kind, n, a * n) for r in raw]).reshape(-1, forest.TREES, forest.NODES)
    return part(0, np.int8, 1), part(1, np.float32, 4), part(5, np.float32, 4)


def _verdicts(stuck_run: int):
    def run(batches):
        """Score, flags and levels by power of two of each block."""
        for b in _slices(batches):
            p = _Packs(b)
            x, length = p.features()
            # equal readings of a block have equal scores: each is scored once
            _, at, back = np.unique(np.column_stack([p.of, x.astype(np.float32)]).astype(np.float64), axis=0, return_index=True, return_inverse=True)
            score = forest.scores(x[at], p.of[at], *_load(b.column("model").to_pylist()))[back.ravel()]
            stuck = (length >= stuck_run) & (p.value > 0) & ~p.impossible
            use = ~p.impossible & ~stuck & ~p.repeated
            with np.errstate(divide="ignore", invalid="ignore"):
                octave = np.where(p.value > 0, np.floor(np.log2(np.where(p.value > 0, p.value, 1.0))), _NO_OCTAVE).astype(np.int64)
            order = np.nonzero(use)[0]
            order = order[np.lexsort((octave[order], p.of[order]))]
            of, oc = p.of[order], octave[order]
            new = np.r_[True, (of[1:] != of[:-1]) | (oc[1:] != oc[:-1])] if len(of) else np.zeros(0, bool)
            starts = np.nonzero(new)[0]
            per = np.bincount(of[starts], minlength=b.num_rows)
            reduce = lambda f, v: f.reduceat(v[order], starts) if len(starts) else np.zeros(0)
            summary = [oc[starts], reduce(np.minimum, p.value), reduce(np.maximum, p.value), np.diff(np.append(starts, len(of))), reduce(np.add, score)]
            kinds = [pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(k) for k in _KEYS], *[b.column(k) for k in ("row_id", "us", "value")], _to_lists(score, p.n, pa.float64()), _to_lists(p.impossible, p.n, pa.bool_()), _to_lists(stuck, p.n, pa.bool_()),
                 *[_to_lists(v, per, k) for v, k in zip(summary, kinds)]],
                names=[*_KEYS, "row_id", "us", "value", "score", "impossible", "stuck", "octave", "low", "high", "n", "total"],
            )

    return run


def spike_levels(levels: DataFrame, keys: list[str], factor: float = 4.0, least_score: float = SPIKE_SCORE) -> DataFrame:
    """Per source the level from which readings are spikes: (keys, spike_from); sources without are left out.

    levels: (keys, octave, low, high, n, total), readings that aren't impossible, stuck or repeated reduced to one
    row per power of two (octave NULL: not above zero) with least and largest value, number and sum of scores.

    A spike is at least ``factor`` times every reading that is no case: a gap of factor four or more always lies
    between two such rows.  Readings above a gap are spikes if their mean score reaches ``least_score``.  Two exact
    checks follow: they are no more than half of the source's readings above zero or a twentieth of all its
    readings, and above zeros alone only a single reading is one.  Of several such gaps the lowest counts.
    """
    if factor < 2:
        raise ValueError("factor must be at least 2")
    level = levels.groupBy(*keys, "octave").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"), F.sum("total").alias("total"))
    level = level.withColumn("high", F.when(F.col("octave").isNotNull(), F.col("high")))
    w = Window.partitionBy(*keys).orderBy("octave")
    up, all_ = w.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy(*keys)
    x = level.select(
        *keys, "octave", "low", F.lag("high").over(w).alias("below"), F.sum("n").over(up).alias("above"), (F.sum("total").over(up) / F.sum("n").over(up)).alias("score"),
        F.sum("n").over(all_).alias("readings"), F.sum(F.when(F.col("octave").isNotNull(), F.col("n"))).over(all_).alias("positive"),
    ).where("octave is not null")
    gap = F.col("low") >= factor * F.coalesce("below", F.lit(0.0))
    exception = (F.col("above") == 1) | F.col("below").isNotNull() & ((F.col("above") * 2 <= F.col("positive")) | (F.col("above") * 20 <= F.col("readings")))
    return x.where(gap & exception & (F.col("score") >= least_score)).groupBy(*keys).agg(F.min("low").alias("spike_from"))


def implausible(readings: DataFrame, limits: dict[str, float], stuck_run: int = 10, factor: float = 4.0, sample: int = SAMPLE, least_score: float = SPIKE_SCORE, block_us: int = BLOCK_US) -> DataFrame:
    """Every reading with its score and what is wrong with it.

    readings: (row_id, poste, field, time, value), values in the unit of ``limits``, the largest possible
    value of each field.  Result: (row_id, poste, field, time, value, score, impossible, stuck, spike, anomaly).
    Readings whose value is NULL or NaN, or without id, time, station or field, are skipped; a field without a
    limit has only the lower one, zero.  Repeated deliveries (same time and value) share one verdict and count
    once.  ``stuck`` is a run of ``stuck_run`` or more equal values above zero; equal times with different values are
    ordered by value.  ``anomaly`` is impossible, stuck or spike.  The forest of a source is fitted on at most
    ``sample`` of its readings, picked by hash; every reading is scored.  A row between stages holds a source's
    readings of ``block_us``, which must be few enough for one row.
    """
    keys = _KEYS[:2]
    x = readings.where("row_id is not null and poste is not null and field is not null and time is not null and value is not null and not isnan(value)").select(
        F.col("poste").cast("long").alias("s_poste"), F.col("field").alias("s_field"), epoch_us(F.col("time")).alias("us"), F.round("value", 9).alias("value"), F.col("row_id").cast("long").alias("row_id")
    )
    most = F.lit(float("inf"))
    for name, m in limits.items():
        most = F.when(F.col("s_field") == name, F.lit(float(m))).otherwise(most)
    p = x.groupBy(*keys, floor_div(F.col("us"), block_us).alias("block")).agg(F.array_sort(F.collect_list(F.struct("us", "value", "row_id"))).alias("p"))
    packs = checkpointed(p.select(*_KEYS, most.alias("most"), "p.us", "p.value", "p.row_id"))
    key_types = "s_poste long, s_field string, block long"
    edges = packs.mapInArrow(_edges, f"{key_types}, v_first double, n_first long, v_last double, n_last long, islands long, h_sum array<double>, h_n array<long>")
    edges = edges.repartition(*keys).sortWithinPartitions(*_KEYS)
    connected = edges.mapInPandas(_connect, f"{key_types}, before double, run_first long, run_last long, usual array<double>")
    full = packs.join(connected, _KEYS)
    cols = f"{key_types}, low array<double>, high array<double>, draw array<double>, x array<double>"
    fitted = full.mapInArrow(_candidates(sample), cols).repartition(*keys).sortWithinPartitions(*_KEYS).mapInPandas(_fit(sample), f"{key_types}, model binary")
    out = f"{key_types}, row_id array<long>, us array<long>, value array<double>, score array<double>, impossible array<boolean>, stuck array<boolean>, octave array<long>, low array<double>, high array<double>, n array<long>, total array<double>"
    scored = checkpointed(full.join(fitted, _KEYS).mapInArrow(_verdicts(stuck_run), out))
    levels = scored.select(*keys, F.explode(F.arrays_zip("octave", "low", "high", "n", "total")).alias("l")).select(*keys, F.when(F.col("l.octave") > _NO_OCTAVE, F.col("l.octave")).alias("octave"), "l.low", "l.high", "l.n", "l.total")
    spikes = small_or_shuffled(spike_levels(levels, keys, factor, least_score))
    rows = scored.join(spikes, keys, "left").select(*keys, "spike_from", F.explode(F.arrays_zip("row_id", "us", "value", "score", "impossible", "stuck")).alias("r")).select(*keys, "spike_from", "r.*")
    spike = F.coalesce((F.col("value") >= F.col("spike_from")) & ~F.col("impossible") & ~F.col("stuck"), F.lit(False))
    rows = rows.withColumn("spike", spike).withColumn("time", F.expr("timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(us as decimal(20, 0)) / 1000000)"))
    return rows.select(
        "row_id", F.col("s_poste").alias("poste"), F.col("s_field").alias("field"), "time", "value", "score", "impossible", "stuck", "spike",
        (F.col("impossible") | F.col("stuck") | F.col("spike")).alias("anomaly"),
    )
