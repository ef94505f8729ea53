"""Points near other points, complete radius joins on the sphere (problem 4).

Points are assigned to the Voronoi cells of pivots drawn from the data, so dense regions get small cells.  A
point also visits every other cell that could hold a point within the radius of it: with home distance h,
distance d to the other pivot and radius r that is d <= h + 2r, by the triangle inequality.  A cell that is still
crowded is split again by pivots of its own, points and visitors alike, so pivots form a tree, a point is
compared with the pivots along its path only, and more points make the tree deeper.  Each leaf is joined locally
with a vantage-point tree under the exact great-circle distance.  Leaves that no pivots can split (many points
within twice the radius) are cut into chunks, and every pair of chunks is a task of its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainloom.session import checkpointed, small_or_shuffled

EARTH_M = 6_371_008.8
#: Points per pivot, pivots of one cell, pivots of one level (they are broadcast: 2 MB), and points of a cell that
#: are joined in one task.
POINTS_PER_PIVOT, CELL_PIVOTS, LEVEL_PIVOTS, CHUNK = 512, 1_024, 65_536, 4_096
MOST_LEVELS = 8

_NUM = r"(\d+(?:[.,]\d+)?)"
_PART = rf"([-+−]?){_NUM} ?°? ?(?:{_NUM} ?['′’] ?)?(?:{_NUM} ?(?:\"|″|”|'') ?)?"
_PAIR = rf"^ *{_PART}([NSns]?)[ ,;/]+{_PART}([EWOewo]?) *$"


def with_position(df: DataFrame, lat: str = "lat", lon: str = "lon", text: str = "coordinates") -> DataFrame:
    """``df`` with ``p_lat`` and ``p_lon`` (-180 to 180) in degrees; both NULL where there is no position.

    The numbers count; where one of them is NULL or NaN the text does: decimal degrees, degrees and minutes
    or degrees, minutes and seconds, latitude first, with sign or letter (O is west).  Longitudes may run to
    180 or to 360.  0/0, values outside the globe, minutes or seconds of 60 and more, and other texts are no
    position.
    """
    # the pattern runs once per row; its ten groups are then picked from an array
    groups = F.split(F.regexp_replace(F.col(text), _PAIR, "|".join(f"${i}" for i in range(1, 11))), r"\|", -1)
    x = df.withColumn("__g", F.when(F.col(text).rlike(_PAIR), groups))
    number = F.transform("__g", lambda v: F.coalesce(F.regexp_replace(v, ",", ".").try_cast("double"), F.lit(0.0)))
    x = x.withColumn("__n", number)
    n, g = F.col("__n"), F.col("__g")
    fine = (n[2] < 60) & (n[3] < 60) & (n[7] < 60) & (n[8] < 60)
    minus = lambda s, letter, which: g[s].isin("-", "\u2212") | F.upper(g[letter]).isin(*which)
    degrees = lambda i: n[i] + n[i + 1] / 60 + n[i + 2] / 3600
    x = x.withColumn("__ta", F.when(fine, F.when(minus(0, 4, ["S"]), -degrees(1)).otherwise(degrees(1))))
    x = x.withColumn("__to", F.when(fine, F.when(minus(5, 9, ["W", "O"]), -degrees(6)).otherwise(degrees(6))))
    given = F.col(lat).isNotNull() & F.col(lon).isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
    x = x.withColumn("__a", F.when(given, F.col(lat)).otherwise(F.col("__ta"))).withColumn("__o", F.when(given, F.col(lon)).otherwise(F.col("__to")))
    good = F.col("__a").between(-90, 90) & F.col("__o").between(-180, 360) & ~((F.col("__a") == 0) & (F.col("__o") == 0))
    x = x.withColumn("p_lat", F.when(good, F.col("__a"))).withColumn("p_lon", F.when(good, F.when(F.col("__o") > 180, F.col("__o") - 360).otherwise(F.col("__o"))))
    return x.drop("__g", "__n", "__ta", "__to", "__a", "__o")


def _xyz(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    a, o = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(a) * np.cos(o), np.cos(a) * np.sin(o), np.sin(a)], 1)


def great_circle(lat1, lon1, lat2, lon2, radius: float = EARTH_M):
    """Great-circle distance in metres by the haversine formula; arrays broadcast."""
    a1, o1, a2, o2 = map(np.radians, (lat1, lon1, lat2, lon2))
    h = np.sin((a2 - a1) / 2) ** 2 + np.cos(a1) * np.cos(a2) * np.sin((o2 - o1) / 2) ** 2
    return 2 * radius * np.arcsin(np.sqrt(np.minimum(h, 1.0)))


class VantageTree:
    """Vantage-point tree over points in degrees; answers radius queries for many probes at once."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray, leaf: int = 48):
        self.lat, self.lon, self.leaf = lat, lon, leaf
        self.root = self._grow(np.arange(len(lat)))

    def _grow(self, at: np.ndarray):
        if len(at) <= self.leaf:
            return at
        v = at[0]
        d = great_circle(self.lat[v], self.lon[v], self.lat[at], self.lon[at])
        mid = np.median(d)
        inner = d <= mid
        if inner.all():  # many points in one place
            return at
        return float(self.lat[v]), float(self.lon[v]), float(mid), self._grow(at[inner]), self._grow(at[~inner])

    def within(self, lat: np.ndarray, lon: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probe, point, metres) of all pairs at most ``radius`` apart."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        stack = [(self.root, np.arange(len(lat)))]
        slack = radius + 1e-3  # metres, for rounding in the bounds; the pairs themselves are tested exactly
        while stack:
            node, probes = stack.pop()
            if not len(probes):
                continue
            if isinstance(node, np.ndarray):
                for part in np.array_split(probes, max(1, len(probes) * len(node) // 2_000_000 + 1)):
                    d = great_circle(lat[part][:, None], lon[part][:, None], self.lat[node][None, :], self.lon[node][None, :])
                    i, j = np.nonzero(d <= radius)
                    out.append((part[i], node[j], d[i, j]))
                continue
            a, o, mid, inner, outer = node
            d = great_circle(a, o, lat[probes], lon[probes])
            stack += [(inner, probes[d <= mid + slack]), (outer, probes[d > mid - slack])]
        if not out:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        return tuple(np.concatenate(x) for x in zip(*out))  # type: ignore[return-value]


def spread_pivots(lat: np.ndarray, lon: np.ndarray, radius: float, most: int) -> np.ndarray:
    """Unit vectors of at most ``most`` of the points, no two nearer than twice the radius."""
    xyz = _xyz(lat, lon)
    keep: list[int] = []
    free = np.ones(len(xyz), bool)
    close = np.cos(min(np.pi, 2 * radius / EARTH_M))
    for i in range(len(xyz)):
        if free[i]:
            keep.append(i)
            if len(keep) == most:
                break
            free &= xyz @ xyz[i] < close
    return xyz[keep]


def _split(shared, radius: float):
    """Send the copies of crowded cells to the children of their cell; others go on as they are."""

    def run(batches):
        trees, first = shared.value
        for b in batches:
            cell = b["cell"].to_numpy()
            at, child, own = [np.zeros(0, int)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
            order = np.argsort(cell, kind="stable")
            cuts = np.append(np.nonzero(np.r_[True, np.diff(cell[order]) != 0])[0], len(cell)) if len(cell) else [0]
            for a, e in zip(cuts[:-1], cuts[1:]):
                pivots = trees.get(int(cell[order[a]]))
                if pivots is None:
                    rows = order[a:e]
                    at.append(rows)
                    child.append(cell[rows])
                    own.append(b["own"].to_numpy()[rows])
                    continue
                base = first[int(cell[order[a]])]
                for s in range(a, e, 1024):
                    rows = order[s : min(e, s + 1024)]
                    dots = np.clip(_xyz(b["lat"].to_numpy()[rows], b["lon"].to_numpy()[rows]) @ pivots.T, -1.0, 1.0)
                    home = dots.argmax(1)
                    angle = np.arccos(dots[np.arange(len(home)), home])
                    i, j = np.nonzero(dots >= np.cos(np.minimum(np.pi, angle + 2 * radius / EARTH_M + 1e-7))[:, None])
                    at.append(rows[i])
                    child.append(base + j)
                    own.append(b["own"].to_numpy()[rows[i]] & (j == home[i]))
            at = np.concatenate(at)
            yield pd.DataFrame({"id": b["id"].to_numpy()[at], "lat": b["lat"].to_numpy()[at], "lon": b["lon"].to_numpy()[at], "cell": np.concatenate(child), "own": np.concatenate(own)})

    return run


def _join_cell(radius: float):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        index, probe = g[g["role"] == 0], g[g["role"] == 1]
        if not len(index) or not len(probe):
            return pd.DataFrame({"a": [], "b": [], "metres": []}).astype({"a": "int64", "b": "int64", "metres": "float64"})
        tree = VantageTree(index["lat"].to_numpy(), index["lon"].to_numpy())
        i, j, d = tree.within(probe["lat"].to_numpy(), probe["lon"].to_numpy(), radius)
        a, b = probe["id"].to_numpy()[i], index["id"].to_numpy()[j]
        # two points meet in each one's own cell, as probe and as its own point in turn: one of the two counts
        keep = a < b
        return pd.DataFrame({"a": a[keep], "b": b[keep], "metres": d[keep]})

    return run


def voronoi_cells(points: DataFrame, radius: float, per_pivot: int = POINTS_PER_PIVOT, chunk: int = CHUNK, cell_pivots: int = CELL_PIVOTS, level_pivots: int = LEVEL_PIVOTS) -> DataFrame:
    """(id, lat, lon, cell, own): each point in the cell of its own and in those it visits, at the leaves of the tree.

    A level splits the most crowded cells, as many as ``level_pivots`` allow; the next level goes on.  A cell that
    got only one pivot can't be split further.
    """
    spark = points.sparkSession
    placed = points.select("id", "lat", "lon", F.lit(0).cast("long").alias("cell"), F.lit(True).alias("own"))
    whole, next_cell = {-1}, 1
    for level in range(MOST_LEVELS):
        sizes = placed.groupBy("cell").count().where((F.col("count") > chunk) & ~F.col("cell").isin(*whole)) if level else placed.groupBy("cell").count()
        crowded = sizes.orderBy(F.desc("count"), "cell").limit(max(1, level_pivots // 16)).collect()
        share, room = [], level_pivots
        for r in crowded:
            want = min(cell_pivots, max(2, -(-r["count"] // per_pivot)), room)
            if want < 2:
                break
            room -= want
            share.append((r["cell"], min(1.0, 1.5 * want / r["count"]), want))
        if not share:
            break
        drawn = placed.join(F.broadcast(spark.createDataFrame(share, "s_cell long, share double, want int")), F.col("cell") == F.col("s_cell"))
        draw = F.pmod(F.xxhash64("lat", "lon", F.lit(level)), F.lit(1_000_000)) / 1_000_000
        got = drawn.where(draw < F.col("share")).select("cell", "lat", "lon", draw.alias("draw")).limit(2 * level_pivots).toPandas()
        wants, trees, first = {c: w for c, _, w in share}, {}, {}
        for cell, g in got.sort_values(["cell", "draw", "lat", "lon"]).groupby("cell"):
            pivots = spread_pivots(g["lat"].to_numpy(), g["lon"].to_numpy(), radius, wants[cell])
            if len(pivots) < 2:
                whole.add(int(cell))
                continue
            trees[int(cell)], first[int(cell)] = pivots, next_cell
            next_cell += len(pivots)
        if not trees:
            break
        shared = spark.sparkContext.broadcast((trees, first))
        placed = checkpointed(placed.mapInPandas(_split(shared, radius), "id long, lat double, lon double, cell long, own boolean"))
    return placed


def near_pairs(points: DataFrame, radius: float, per_pivot: int = POINTS_PER_PIVOT, chunk: int = CHUNK, cell_pivots: int = CELL_PIVOTS, level_pivots: int = LEVEL_PIVOTS) -> DataFrame:
    """All pairs of different ids that have positions at most ``radius`` metres apart: (id_a, id_b, metres).

    points: (id long, lat, lon in degrees).  id_a < id_b, each pair once with its least distance; an id may have
    several positions, and repeated rows change nothing.  Rows with a NULL among the three are left out.  Pairs
    exactly at the radius are inside.  The result is exact whatever the pivots.
    """
    p = points.where("id is not null and lat is not null and lon is not null").select("id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).distinct()
    placed = voronoi_cells(checkpointed(p), radius, per_pivot, chunk, cell_pivots, level_pivots)
    # one row per cell: how many chunks its own points and all its visitors fall into
    sizes = placed.groupBy("cell").agg(F.ceil(F.count_if("own") / chunk).alias("n_index"), F.ceil(F.count("*") / chunk).alias("n_probe")).where("n_index > 0")
    x = placed.join(small_or_shuffled(sizes), "cell")
    index = x.where("own").withColumn("ci", F.pmod(F.xxhash64("id", "lat", "lon"), F.col("n_index"))).withColumn("cp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_probe") - 1)))
    probe = x.withColumn("cp", F.pmod(F.xxhash64("id", "lat", "lon"), F.col("n_probe"))).withColumn("ci", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_index") - 1)))
    cols = ["cell", "ci", "cp", "id", "lat", "lon"]
    both = index.select(*cols, F.lit(0).alias("role")).unionByName(probe.select(*cols, F.lit(1).alias("role")))
    pairs = both.groupBy("cell", "ci", "cp").applyInPandas(_join_cell(radius), "a long, b long, metres double")
    return pairs.groupBy(F.col("a").alias("id_a"), F.col("b").alias("id_b")).agg(F.min("metres").alias("metres"))


def station_positions(stations: DataFrame) -> DataFrame:
    """(id, lat, lon) of each listing of a station that has a position."""
    x = with_position(stations.select("poste", "lat", "lon", "coordinates")).where("p_lat is not null")
    return x.select(F.col("poste").alias("id"), F.col("p_lat").alias("lat"), F.col("p_lon").alias("lon"))
