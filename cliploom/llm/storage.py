"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows (a few numbers each) up to which a counted table may be broadcast.
BROADCAST_ROWS = 500_000


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a scratch folder only where it is unset and the master is local."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="cliploom-"))
    return context.getCheckpointDir().rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it back.

    Cuts lineage: a lost executor costs the tasks it ran, never the steps before the table."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measured(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table of narrow rows, marked for broadcast if it has been counted to hold ``rows`` at most; beyond that the
    join shuffles."""
    return F.broadcast(table) if table.count() <= rows else table


def as_text(*names: str) -> list:
    """Number columns as text for the way through pandas, where one null would turn a batch of them into floats."""
    return [F.col(n).cast("string").alias(n) for n in names]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
