"""Folders that driver and executors share, lineage cuts, and rows dealt by key."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, a folder of our own in local
    mode and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tallyline-")  # driver and executors are one process
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base if ":/" in base else f"file://{base}"


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def tasks_for(rows: int, per_task: int = 50_000) -> int:
    """How many tasks of about `per_task` rows."""
    return rows // per_task + 1


def dealt(df: DataFrame, *keys: str, rows: int | None = None, per_task: int = 50_000) -> DataFrame:
    """df shuffled by `keys` into partitions of about `per_task` rows (`rows`: how many there are, else they are counted), so that
    tasks get more in number, not larger, as tables grow. Groups and windows by these keys and more stay where they are."""
    return df.repartition(tasks_for(df.count() if rows is None else rows, per_task), *keys)


def laid(df: DataFrame, *keys: str, tasks: int | None = None) -> DataFrame:
    """df written to the shared folder, read from there and dealt by `keys` into `tasks` partitions (None: as many as wrote any).

    What reads it later reads the columns it needs, and a lost executor costs no recomputation. Joins of two such frames stay
    where they are if they are by `keys`, not by more, and of as many tasks.
    """
    path = fresh_dir(df.sparkSession, "laid")
    df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    return written.repartition(tasks or max(len(written.inputFiles()), 1), *keys)
