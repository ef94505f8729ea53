"""Batches of sorted partitions, cut where a key ends."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str], least: int = 20_000) -> Iterator[pd.DataFrame]:
    """Frames of at least ``least`` rows (the last may be shorter) in which no key of the sorted input is cut.

    The rows held are those of ``least`` rows, one batch and one key.
    """
    held: list[pd.DataFrame] = []
    rows = 0
    for b in batches:
        if not len(b):
            continue
        held.append(b)
        rows += len(b)
        if rows < least:
            continue
        x = pd.concat(held, ignore_index=True) if len(held) > 1 else b.reset_index(drop=True)
        last = (x[keys] == x[keys].iloc[-1]).all(axis=1).to_numpy()
        cut = len(x) - int(np.argmin(last[::-1])) if not last.all() else 0
        if cut:
            yield x.iloc[:cut]
        held, rows = [x.iloc[cut:]], len(x) - cut
    if rows:
        yield pd.concat(held, ignore_index=True)


def numbered(x: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Number of each row's key, from 0 in the order of the sorted rows."""
    new = np.zeros(len(x), bool)
    for k in keys:
        v = x[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.cumsum(new)
