"""Selection in space: boxes, nearest cells, subdivisions, masks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BBox:
    """A box in degrees, its edges included."""

    min_lat: float
    min_lon: float
    max_lat: float
    max_lon: float

    def shape_order(self) -> list[float]:
        return [self.min_lon, self.min_lat, self.max_lon, self.max_lat]

    def extent(self, pad: float = 0.0) -> tuple[float, float, float, float]:
        return self.min_lon - pad, self.max_lon + pad, self.min_lat - pad, self.max_lat + pad

    def holds(self, lat: Column | str = "lat", lon: Column | str = "lon") -> Column:
        a, o = (F.col(c) if isinstance(c, str) else c for c in (lat, lon))
        return a.between(self.min_lat, self.max_lat) & o.between(self.min_lon, self.max_lon)


def bbox_frame(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    return df.agg(F.min(lat).alias("min_lat"), F.min(lon).alias("min_lon"), F.max(lat).alias("max_lat"), F.max(lon).alias("max_lon"))


def bbox_of(df: DataFrame, lat: str = "lat", lon: str = "lon") -> BBox:
    return BBox(*bbox_frame(df, lat, lon).first())


def surrounding_box(boxes: list[BBox]) -> BBox:
    return BBox(min(b.min_lat for b in boxes), min(b.min_lon for b in boxes), max(b.max_lat for b in boxes), max(b.max_lon for b in boxes))


def common_box(boxes: list[BBox]) -> BBox:
    b = BBox(max(b.min_lat for b in boxes), max(b.min_lon for b in boxes), min(b.max_lat for b in boxes), min(b.max_lon for b in boxes))
    if b.min_lat > b.max_lat or b.min_lon > b.max_lon:
        raise ValueError("the boxes have no common area")
    return b


def in_box(df: DataFrame, box: BBox, lat: str = "lat", lon: str = "lon") -> DataFrame:
    return df.where(box.holds(lat, lon))


def center(df: DataFrame) -> DataFrame:
    b = bbox_frame(df)
    return b.select((F.col("min_lat") + (F.col("max_lat") - F.col("min_lat")) / 2).alias("lat"), (F.col("min_lon") + (F.col("max_lon") - F.col("min_lon")) / 2).alias("lon"))


def nearest_cell(df: DataFrame, lat: float, lon: float, per_axis: bool = True) -> DataFrame:
    """(lat, lon) of the cell nearest to a point: per axis, or by the larger of both axis distances.  Ties: the smaller."""
    a, o = F.abs(F.col("lat") - lat), F.abs(F.col("lon") - lon)
    if per_axis:
        return df.agg(F.min(F.struct(a.alias("d"), F.col("lat"))).alias("a"), F.min(F.struct(o.alias("d"), F.col("lon"))).alias("o")).select("a.lat", "o.lon")
    return df.agg(F.min(F.struct(F.greatest(a, o).alias("d"), F.col("lat"), F.col("lon"))).alias("m")).select("m.lat", "m.lon")


def at_point(df: DataFrame, lat: float, lon: float, per_axis: bool = True) -> DataFrame:
    """All rows of the cell nearest to a point, its time series."""
    cell = nearest_cell(df.select("lat", "lon"), lat, lon, per_axis).select(F.col("lat").alias("__a"), F.col("lon").alias("__o"))
    return df.join(F.broadcast(cell), (F.col("lat") == F.col("__a")) & (F.col("lon") == F.col("__o"))).drop("__a", "__o")


def subdivided(df: DataFrame, rows: int, columns: int) -> DataFrame:
    """``df`` with ``block``: equal blocks of whole numbers of cells, column by column; what is left over is dropped."""
    def axis(name: str, parts: int) -> DataFrame:
        x = df.select(name).distinct()
        n = x.count()  # an axis of the grid, a dimension
        rank = F.row_number().over(Window.orderBy(name)) - 1
        size = max(1, n // parts)
        return x.withColumn(f"__{name}", F.floor(rank / size)).where(F.col(f"__{name}") < parts)
    x = df.join(axis("lat", rows), "lat").join(axis("lon", columns), "lon")
    return x.withColumn("block", (F.col("__lon") * rows + F.col("__lat")).cast("int")).drop("__lat", "__lon")


def subdivided_whole(df: DataFrame, n: int) -> DataFrame:
    """``df`` with ``block``: n by n blocks row by row, the first ones larger by the remainder; nothing is dropped."""
    a = df.select("lat").distinct().withColumn("__a", F.ntile(n).over(Window.orderBy("lat")))
    o = df.select("lon").distinct().withColumn("__o", F.ntile(n).over(Window.orderBy("lon")))
    return df.join(a, "lat").join(o, "lon").withColumn("block", ((F.col("__a") - 1) * n + F.col("__o") - 1).cast("int")).drop("__a", "__o")


def masked(df: DataFrame, mask: DataFrame, digits: int = 4) -> DataFrame:
    """``df`` with ``is_land`` from a mask (lat, lon, is_land) on rounded coordinates; NULL off the mask."""
    key = lambda c: F.round(c, digits)
    m = mask.groupBy(key("lat").alias("__a"), key("lon").alias("__o")).agg(F.max("is_land").alias("is_land"))
    return df.join(m, (key("lat") == F.col("__a")) & (key("lon") == F.col("__o")), "left").drop("__a", "__o")


def land_sea(df: DataFrame, land: Column, columns: list[str]) -> DataFrame:
    """``df`` with two columns per variable: NULL over sea, and NULL over land."""
    extra = {f"{c}_land": F.when(land, F.col(c)) for c in columns} | {f"{c}_sea": F.when(~land, F.col(c)) for c in columns}
    return df.withColumns(extra)
