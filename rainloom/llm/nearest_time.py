"""Matching records by nearest time (problem 2): tolerance-wide buckets, an equi-join, then the minimum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainloom.session import epoch_us, floor_div


def match_nearest_time(
    left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str, left_time: str, right_time: str, tolerance_us: int, key_right: str | None = None, keep_right: list[str] | None = None
) -> DataFrame:
    """Each left row that has a right row of the same key within the tolerance, with the nearest one.

    Result: (left_id, right_id, diff_us, *keep_right), one row per left row; diff_us is right minus left time.
    Of two equally near the earlier in time wins, then the smaller right_id.  Both ends of the tolerance are
    inside.  Rows with a NULL key, time or id match nothing; right rows of one key and time are reduced to the
    smallest id before the join, so repeated rows don't multiply.  Left rows with the same id are one row.

    Time is cut into buckets as wide as the tolerance; a right row goes into its own bucket and both
    neighbours, so each pair meets exactly once, in the left row's bucket.  Key and bucket together are the
    shuffle key: a key that holds a third of all rows is spread over its buckets.  The one exchange of each
    side also serves the reduction before the join and the aggregation after it.
    """
    kr, extra = key_right or key, keep_right or []
    a = left.where(F.col(key).isNotNull() & F.col(left_time).isNotNull() & F.col(left_id).isNotNull()).select(
        F.col(key).alias("k"), epoch_us(F.col(left_time)).alias("l_us"), F.col(left_id).alias("l_id")
    )
    a = a.withColumn("b", floor_div(F.col("l_us"), tolerance_us)).repartition("k", "b")
    b = right.where(F.col(kr).isNotNull() & F.col(right_time).isNotNull() & F.col(right_id).isNotNull()).select(
        F.col(kr).alias("k"), epoch_us(F.col(right_time)).alias("r_us"), F.col(right_id).alias("r_id"), *[F.col(c).alias(f"x_{c}") for c in extra]
    )
    own = floor_div(F.col("r_us"), tolerance_us)
    b = (
        b.withColumn("b", F.explode(F.array(own - 1, own, own + 1)))
        .repartition("k", "b")
        .groupBy("k", "b", "r_us")
        .agg(F.min_by(F.struct("r_id", *[f"x_{c}" for c in extra]), "r_id").alias("r"))
    )
    diff = F.col("r_us") - F.col("l_us")
    pairs = a.join(b, ["k", "b"]).where(F.abs(diff) <= tolerance_us)
    best = pairs.groupBy("k", "b", "l_us", "l_id").agg(F.min_by(F.struct("r_us", "r"), F.struct(F.abs(diff), "r_us", "r.r_id")).alias("m"))
    return best.select(
        F.col("l_id").alias(left_id), F.col("m.r.r_id").alias(right_id), (F.col("m.r_us") - F.col("l_us")).alias("diff_us"), *[F.col(f"m.r.x_{c}").alias(c) for c in extra]
    )
