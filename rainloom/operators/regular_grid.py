"""Irregular readings onto a regular grid, gaps filled by low-rank factorisation (problem 1).

Every deployment has slots of its nominal step.  Readings are averaged per slot, observed slots keep that
value exactly, and missing slots are filled by alternating least squares.

Sources rarely rain at the same moment, but the course of rain over a few steps is alike everywhere.  So the
matrix has a row per source and window of ``WINDOW`` consecutive slots, its columns are the slots of the window,
and the time factors are the few courses that all sources of a field and step share; windows overlap, and a
slot takes the mean of its windows, the central ones first.  Values are taken as departures from the source's
own mean, in its own spread, and from the column's mean, so a source's level and unit don't enter the factors.

Matrices are tiles: sources of one field and step in a block of days, split by hash so that a tile has about
``tile_slots`` slots.  A tile is the unit of work of one Python call, so its size is bounded however many
sources there are, and a station that holds a third of all rows is spread over its blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainloom.operators.units import usable
from rainloom.session import epoch_us, floor_div, small_or_shuffled

OBSERVED, FILLED, UNSUPPORTED = 0, 1, 2
STATUS = ["observed", "filled", "unsupported"]
_DAY = 86_400_000_000
#: Days of a tile, and slots that it has on average.
BLOCK_DAYS, TILE_SLOTS = 8, 65_536
#: Slots of a window and how far the next one begins.
WINDOW, STRIDE = 12, 4
RANK, RIDGE, MOST_SWEEPS, SUPPORT = 4, 2.0, 40, 3
_OUT = "deployment_id long, poste long, field string, slot_epoch long, value double, n_readings int, status int"


def als_fill(matrix: np.ndarray, rank: int = RANK, ridge: float = RIDGE, most_sweeps: int = MOST_SWEEPS, tolerance: float = 1e-3, support: int = SUPPORT) -> tuple[np.ndarray, np.ndarray]:
    """Estimates of the cells of ``matrix`` (NaN: missing) by alternating least squares of the given rank.

    Returns the estimates of all cells, column means and factors together, and a mask of the rows whose
    estimates are supported: those with at least ``support`` observed cells.  Sweeps end when the penalised
    error falls by less than ``tolerance`` of itself, or after ``most_sweeps``.
    """
    seen = ~np.isnan(matrix)
    ok, w = seen.sum(1) >= support, seen.astype(float)
    mean = np.where(seen, matrix, 0.0).sum(0) / np.maximum(w.sum(0), 1.0)
    x = np.where(seen, matrix - mean, 0.0)
    if not ok.any():
        return np.broadcast_to(mean, matrix.shape).copy(), ok
    rank = min(rank, matrix.shape[1])
    # smooth courses to begin with: the first cosines over the columns
    at = (np.arange(matrix.shape[1]) + 0.5) * np.pi / matrix.shape[1]
    v = np.cos(at[:, None] * np.arange(rank)[None, :])
    eye = ridge * np.eye(rank)

    def solve(target: np.ndarray, weight: np.ndarray, factors: np.ndarray) -> np.ndarray:
        outer = (factors[:, :, None] * factors[:, None, :]).reshape(len(factors), -1)
        gram = (weight @ outer).reshape(-1, rank, rank) + eye
        return np.linalg.solve(gram, (target @ factors)[:, :, None])[:, :, 0]

    last = np.inf
    for _ in range(most_sweeps):
        u = solve(x, w, v)
        v = solve(x.T, w.T, u)
        error = float((w * (x - u @ v.T) ** 2).sum() + ridge * ((u**2).sum() + (v**2).sum()))
        if last - error <= tolerance * error:
            break
        last = error
    return solve(x, w, v) @ v.T + mean, ok


def fill_series(source: np.ndarray, value: np.ndarray, rank: int = RANK, window: int = WINDOW, stride: int = STRIDE, ridge: float = RIDGE, support: int = SUPPORT) -> tuple[np.ndarray, np.ndarray]:
    """Fill the NaN slots of several series at once; ``source`` numbers the series of each slot from 0, in order.

    Returns the values and a mask of the filled slots.  A slot is filled if one of its windows has at least
    ``support`` observed slots; others stay NaN.  Filled values aren't below zero.
    """
    seen = ~np.isnan(value)
    if not seen.any() or seen.all():
        return value.copy(), np.zeros(len(value), bool)
    n = np.bincount(source)
    start = np.cumsum(n) - n
    count = np.bincount(source, seen)
    x = np.where(seen, value, 0.0)
    level = np.bincount(source, x) / np.maximum(count, 1)
    spread = np.sqrt(np.bincount(source, np.where(seen, (x - level[source]) ** 2, 0.0)) / np.maximum(count, 1))
    spread[spread < 1e-12] = 1.0
    z = np.where(seen, (value - level[source]) / spread[source], np.nan)
    # windows begin every few slots, and one at the end of each series
    steps = np.maximum(0, -((window - n) // stride)) + 1
    which = np.repeat(np.arange(len(n)), steps)
    begin = np.minimum((np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps)) * stride, np.maximum(n - window, 0)[which])
    at = begin[:, None] + np.arange(window)[None, :]
    inside = at < n[which][:, None]
    at = np.where(inside, at + start[which][:, None], 0)
    rows = np.where(inside, z[at], np.nan)
    got, ok = als_fill(rows, rank, ridge, support=support)
    central = (window - np.abs(np.arange(window) - (window - 1) / 2)) ** 2
    weight = np.where(inside & ok[:, None], central[None, :], 0.0)
    total = np.bincount(at.ravel(), weight.ravel(), len(value))
    mean = np.bincount(at.ravel(), (weight * got).ravel(), len(value)) / np.maximum(total, 1e-12)
    fill = ~seen & (total > 0)
    return np.where(fill, np.maximum(mean * spread[source] + level[source], 0.0), value), fill


def _tile(cells: pd.DataFrame, block_us: int, rank: int) -> pd.DataFrame:
    """All slots of the tile's sources that begin in its block."""
    block, step = int(cells["block"].iloc[0]), int(cells["step_us"].iloc[0])
    sources = cells.drop_duplicates("deployment_id")
    start, n_slots = sources["from_us"].to_numpy(np.int64), sources["n_slots"].to_numpy(np.int64)
    first = np.maximum(0, -((start - block * block_us) // step))  # the first slot that begins in the block
    n = np.maximum(0, np.minimum(n_slots, -((start - (block + 1) * block_us) // step)) - first)
    row = np.repeat(np.arange(len(n)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    value, count = np.full(len(row), np.nan), np.zeros(len(row), np.int32)
    got = cells[cells["k"].notna()]
    if len(got):
        own = pd.Index(sources["deployment_id"]).get_indexer(got["deployment_id"])
        at = (np.cumsum(n) - n)[own] + got["k"].to_numpy(np.int64) - first[own]
        value[at], count[at] = (got["total"] / got["n"]).to_numpy(float), got["n"].to_numpy()
    used = n > 0
    filled, done = fill_series((np.cumsum(used) - 1)[row], value, rank) if len(row) else (value, np.zeros(0, bool))
    pick = lambda c: sources[c].to_numpy()[row]
    return pd.DataFrame(
        {
            "deployment_id": pick("deployment_id"), "poste": pick("d_poste"), "field": pick("d_field"), "slot_epoch": (start[row] + k * step) // 1_000_000,
            "value": filled,
            "n_readings": count, "status": np.where(count > 0, OBSERVED, np.where(done, FILLED, UNSUPPORTED)).astype(np.int32),
        }
    )


def regular_grid(readings: DataFrame, deployments: DataFrame, rank: int = RANK, block_days: int = BLOCK_DAYS, tile_slots: int = TILE_SLOTS) -> DataFrame:
    """One row per deployment and nominal slot: (deployment_id, poste, field, slot_epoch, value, n_readings, status).

    readings: (poste, field, time, value).  deployments: (deployment_id, poste, field, step_min, active_from,
    active_to).  Slots are [active_from + k*step, active_from + (k+1)*step) that end by active_to; slot_epoch is
    the begin in seconds.  Readings that are NULL, NaN or negative, have no time or station, or lie outside
    every slot are no readings; several in one slot are averaged, repeated rows among them.  Deployments with
    a NULL among these columns, a step below one or no whole slot have no slots.  A deployment without any
    reading has all its slots, unsupported.  status is observed, filled or unsupported; value is NULL only in
    the last.  deployment_id must be unique.
    """
    block_us = block_days * _DAY
    d = (
        deployments.where("deployment_id is not null and poste is not null and field is not null and step_min >= 1 and active_from is not null and active_to is not null")
        .select("deployment_id", F.col("poste").alias("d_poste"), F.col("field").alias("d_field"), (F.col("step_min").cast("long") * 60_000_000).alias("step_us"), epoch_us(F.col("active_from")).alias("from_us"), epoch_us(F.col("active_to")).alias("to_us"))
        .withColumn("n_slots", F.floor((F.col("to_us") - F.col("from_us")) / F.col("step_us")))
        .where("n_slots >= 1")
    )
    block_of = lambda us: floor_div(us, block_us)
    from_us, step_us = F.col("from_us"), F.col("step_us")
    end = from_us + F.col("n_slots") * step_us - 1
    blocks = d.withColumn("block", F.explode(F.sequence(block_of(from_us), block_of(end))))
    r = (
        readings.where(usable(F.col("value")) & F.col("time").isNotNull() & F.col("poste").isNotNull())
        .select("poste", "field", epoch_us(F.col("time")).alias("us"), "value")
        .withColumn("r_block", block_of(F.col("us")))
    )
    on = (F.col("poste") == F.col("d_poste")) & (F.col("field") == F.col("d_field")) & (F.col("r_block") == F.col("block"))
    inside = (F.col("us") >= from_us) & (F.col("us") <= end)
    meta = ["deployment_id", "d_poste", "d_field", "step_us", "from_us", "n_slots"]
    cells = (
        r.join(small_or_shuffled(blocks), on & inside)
        .withColumn("k", F.floor((F.col("us") - from_us) / step_us))
        .withColumn("block", block_of(from_us + F.col("k") * step_us))
        .groupBy(*meta, "block", "k")
        .agg(F.sum("value").alias("total"), F.count("value").cast("int").alias("n"))
    )
    # every source is announced in each of its blocks, whether or not it has a reading there
    announced = blocks.select(*meta, "block", F.lit(None).cast("long").alias("k"), F.lit(None).cast("double").alias("total"), F.lit(None).cast("int").alias("n"))
    held = F.least(end + 1, (F.col("block") + 1) * block_us) - F.greatest(from_us, F.col("block") * block_us)
    tiles = blocks.groupBy("d_field", "step_us", "block").agg(F.greatest(F.ceil(F.sum(held / step_us) / tile_slots), F.lit(1)).alias("n_tiles"))
    x = cells.unionByName(announced).join(small_or_shuffled(tiles), ["d_field", "step_us", "block"])
    x = x.withColumn("tile", F.pmod(F.xxhash64("deployment_id"), F.col("n_tiles")))
    filled = x.groupBy("d_field", "step_us", "block", "tile").applyInPandas(lambda g: _tile(g, block_us, rank), _OUT)
    status = F.element_at(F.array(*[F.lit(s) for s in STATUS]), F.col("status") + 1)
    value = F.when(F.col("status") != UNSUPPORTED, F.col("value"))
    return filled.select("deployment_id", "poste", "field", "slot_epoch", value.alias("value"), "n_readings", status.alias("status"))


def missing_slots(grid: DataFrame) -> DataFrame:
    """(poste, field, slot_epoch) of each slot without a usable reading, whether it was filled or not."""
    return grid.where("status != 'observed'").select("poste", "field", "slot_epoch")
