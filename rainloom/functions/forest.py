"""Isolation forests of many sources at once, grown and applied level by level in arrays.

A tree cuts the box that all readings of its source span, by a random feature at a random level, until its points
stand alone.  The box is that of all readings, not of the sample alone: a reading far outside the sample is cut
off from it by the gap between, which a forest that knows the sample only can't do.  Random numbers are hashes of
(source, tree, node), so a source's forest is the same in whatever batch it is grown.
"""

from __future__ import annotations

import numpy as np

#: Trees of a source, sample points of a tree and its depth.
TREES, POINTS = 32, 32
DEPTH = 5
NODES = 2 ** (DEPTH + 1) - 1
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def uniform(*parts: np.ndarray | int) -> np.ndarray:
    """Numbers in [0, 1) that are a hash of whole numbers; arrays broadcast."""
    with np.errstate(over="ignore"):
        h = np.uint64(0)
        for p in parts:
            h = (h ^ np.asarray(p).astype(np.int64).view(np.uint64)) + _MIX[0]
            h = (h ^ (h >> np.uint64(30))) * _MIX[1]
            h = (h ^ (h >> np.uint64(27))) * _MIX[2]
            h = h ^ (h >> np.uint64(31))
    return (h >> np.uint64(11)).astype(float) / 2.0**53


def mean_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of n points."""
    n = np.asarray(n, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        c = 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n
    return np.where(n > 2, c, np.where(n == 2, 1.0, 0.0))


def grow(points: np.ndarray, sizes: np.ndarray, low: np.ndarray, high: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forests of ``len(sizes)`` sources.

    points: (sum of sizes, features), the samples of the sources one after the other; low, high: (sources,
    features), the box of all readings; seeds: a whole number per source.  Returns, each (sources, trees, nodes),
    the feature of a node's cut (-1: leaf), its level, and a leaf's path length in units of the mean path.
    """
    s, f = len(sizes), points.shape[1]
    feature = np.full((s * TREES, NODES), -1, np.int8)
    level = np.zeros((s * TREES, NODES), np.float32)
    path = np.zeros((s * TREES, NODES), np.float32)
    tree = np.arange(s * TREES)
    own = tree // TREES
    n = np.minimum(sizes, POINTS)
    # a tree's points: all of a small sample, else drawn with replacement
    at = np.arange(POINTS)[None, :]
    drawn = np.floor(uniform(seeds[own][:, None], tree[:, None] % TREES, at, 1) * sizes[own][:, None]).astype(int)
    drawn = np.where((sizes <= POINTS)[own][:, None], at, drawn)
    valid = (at < n[own][:, None]).ravel()
    first = np.cumsum(sizes) - sizes
    x = points[(first[own][:, None] + drawn).ravel()[valid]]
    node = np.repeat(tree, POINTS)[valid]  # running number of the node among those of its level
    box_low, box_high = low[own].astype(float), high[own].astype(float)
    open_low, open_high = np.ones((len(tree), f), bool), np.ones((len(tree), f), bool)
    live = np.arange(len(tree))  # tree of each node of the level that isn't closed
    place = np.zeros(len(tree), int)  # its number in the tree
    unit = np.maximum(mean_path(n), 1e-9)
    for depth in range(DEPTH + 1):
        if not len(live):
            break
        order = np.argsort(node, kind="stable")
        ids, starts = np.unique(node[order], return_index=True)
        count = np.zeros(len(live))
        inner_low, inner_high = np.full((len(live), f), np.inf), np.full((len(live), f), -np.inf)
        if len(ids):
            xs = x[order]
            count[ids] = np.diff(np.append(starts, len(order)))
            inner_low[ids], inner_high[ids] = np.minimum.reduceat(xs, starts), np.maximum.reduceat(xs, starts)
        # sides that no cut has closed reach as far as the source's readings
        a, b = np.where(open_low, np.minimum(box_low, inner_low), inner_low), np.where(open_high, np.maximum(box_high, inner_high), inner_high)
        wide = (b > a) & np.isfinite(a) & np.isfinite(b)
        leaf = (count <= 1) | ~wide.any(1) | (depth == DEPTH)
        path[live[leaf], place[leaf]] = (depth + mean_path(count[leaf])) / unit[own[live[leaf]]]
        go = np.nonzero(~leaf)[0]
        if depth == DEPTH or not len(go):
            break
        pick = np.where(wide[go], uniform(seeds[own[live[go]]][:, None], live[go][:, None] % TREES, place[go][:, None], np.arange(f)[None, :] + 2), -1.0).argmax(1)
        u = uniform(seeds[own[live[go]]], live[go] % TREES, place[go], f + 2)
        cut = (a[go, pick] + u * (b[go, pick] - a[go, pick])).astype(np.float32)
        feature[live[go], place[go]], level[live[go], place[go]] = pick, cut
        # the two halves of every cut node, its points sent down
        number = np.full(len(live), -1)
        number[go] = np.arange(len(go))
        keep = number[node] >= 0
        x, to = x[keep], number[node[keep]]
        node = to * 2 + (x[np.arange(len(x)), pick[to]] > cut[to])
        live, place = np.repeat(live[go], 2), np.stack([place[go] * 2 + 1, place[go] * 2 + 2], 1).ravel()
        box_low, box_high = np.repeat(box_low[go], 2, 0), np.repeat(box_high[go], 2, 0)
        open_low, open_high = np.repeat(open_low[go], 2, 0), np.repeat(open_high[go], 2, 0)
        half = np.repeat(pick, 2)
        even, odd = np.arange(0, len(live), 2), np.arange(1, len(live), 2)
        open_high[even, half[even]] = False
        open_low[odd, half[odd]] = False
    shape = (s, TREES, NODES)
    return feature.reshape(shape), level.reshape(shape), path.reshape(shape)


def scores(rows: np.ndarray, source: np.ndarray, feature: np.ndarray, level: np.ndarray, path: np.ndarray) -> np.ndarray:
    """Anomaly scores in (0, 1) of ``rows`` (n, features) under the forest of the source each belongs to."""
    out = np.empty(len(rows))
    trees = np.arange(TREES)[None, :]
    for a in range(0, len(rows), 16_384):
        x, s = rows[a : a + 16_384].astype(np.float32), source[a : a + 16_384][:, None]
        base = (s * TREES + trees) * NODES
        node = np.zeros((len(x), TREES), np.int64)
        ff, lf = feature.ravel(), level.ravel()
        at = (np.arange(len(x)) * x.shape[1])[:, None]
        for _ in range(DEPTH):
            f = ff[base + node]
            inner = f >= 0
            if not inner.any():
                break
            right = x.ravel()[at + np.maximum(f, 0)] > lf[base + node]
            node = np.where(inner, 2 * node + 1 + right, node)
        out[a : a + 16_384] = np.exp2(-path.ravel()[base + node].mean(1))
    return out
