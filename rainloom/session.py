"""Session helpers shared by all operators: checkpoints, bounded broadcasts, table access."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows and bytes a side may have before it is joined by shuffle instead of broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def local_session(name: str = "rainloom", cores: int | str = 8, partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut.

    The folder is the one the cluster names in ``spark.checkpoint.dir``.  Where none is set a temporary one is
    chosen if the session runs on one machine; on a cluster that would be a folder of the driver alone, so it
    is an error there.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="rainloom-checkpoint-"))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder, or below a temporary one in a session of one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="rainloom-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _row_bytes(df: DataFrame) -> "F.Column":
    """Bytes that a row of ``df`` holds, about: eight a number or time, texts and nested values by their length."""
    total = F.lit(16)
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(c), F.lit(0))
        elif re.fullmatch(r"array<(?!string|binary|array|struct|map)\w+>", kind):
            total = total + F.greatest(F.size(c), F.lit(0)) * 8
        elif kind.startswith(("array", "struct", "map")):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
        else:
            total = total + 8
    return total


def fits(df: DataFrame, rows: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``rows`` rows of together at most ``most_bytes``; reads no more than it has to."""
    n, size = df.limit(rows + 1).select(_row_bytes(df).cast("long").alias("b")).agg(F.count("*"), F.coalesce(F.sum("b"), F.lit(0))).first()
    return n <= rows and size <= most_bytes


def small_or_shuffled(df: DataFrame, rows: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast when it was counted to be small, else left to a shuffle join."""
    return F.broadcast(df) if fits(df, rows, most_bytes) else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def epoch_us(column) -> "F.Column":
    """Microseconds since 1970-01-01 of a TIMESTAMP_NTZ taken as UTC, whatever the session's zone."""
    day = F.unix_date(F.to_date(column)).cast("long")
    inside = F.hour(column) * 3600 + F.minute(column) * 60
    return (day * 86400 + inside) * 1_000_000 + F.round(F.extract(F.lit("SECOND"), column) * 1_000_000).cast("long")


def floor_div(column, width: int) -> "F.Column":
    """Integer floor of a long ``column`` over ``width``, right for negative values too."""
    return ((column - F.pmod(column, F.lit(width))) / F.lit(width)).cast("long")
