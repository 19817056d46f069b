"""Shared storage for results that many plans read, and the append-only log of runs."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, ``spark.checkpoint.dir`` of the session.  Only a session on one
    machine (tests) without such a folder gets a temporary one; on a cluster it is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="factweave-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed to the shared folder, so its plan is planned and run once and survives
    lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def record(df: DataFrame, path: str) -> None:
    """Append snapshots (run_id, ts, status, ...) to a run log."""
    df.write.mode("append").parquet(path)


def latest_runs(log: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The last snapshot of each run; with ``known`` (run_id) updates of unknown runs are ignored."""
    rows = log if known is None else log.join(known.select("run_id").distinct(), "run_id", "left_semi")
    rest = [c for c in rows.columns if c != "run_id"]
    g = rows.groupBy("run_id").agg(F.max_by(F.struct(*rest), "ts").alias("last"))
    return g.select("run_id", "last.*")


#: Sides of a join of at most so many rows are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 200_000


#: As many numbers in lists take the memory of as many rows with texts as above.
BROADCAST_NUMBERS = 2_000_000


def small(df: DataFrame) -> DataFrame:
    """``df`` marked for a broadcast if it was counted to have few rows, else as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df
