"""Guarded writes: partitions are replaced only when enough rows remain, and by one swap."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import retention, upsert


class RefusedWrite(ValueError):
    """New rows would replace too many old ones; nothing was written."""


def read_partitions(spark: SparkSession, path: str, part: str, values: list | None = None) -> DataFrame | None:
    """The table at `path`, with `values` only those partitions, whose files alone are read; None where there is no table."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    return df if values is None else df.where(F.col(part).isin(*values) if values else F.lit(False))


def replace_partitions(new: DataFrame, path: str, part: str, least: float = 0.9, allow_shrink: bool = False) -> DataFrame:
    """Replace the partitions of `part` that occur in `new`; one row: old_rows, new_rows (of these partitions), accepted.

    `new` is written beside the table first and read back, so it is computed once and may itself come from the table. If it
    has fewer than `least` of the rows it replaces, RefusedWrite is raised and the table stays as it is. The swap
    overwrites the touched partitions in one job and leaves others alone; running it again gives the same table. An empty
    `new` touches nothing. Partition values are a small set, say seasons.
    """
    spark = new.sparkSession
    staged = f"{path.rstrip('/')}-staged-{uuid.uuid4().hex}"
    new.write.partitionBy(part).parquet(staged)
    fresh = spark.read.schema(new.schema).parquet(staged)
    values = [r[0] for r in fresh.select(part).distinct().collect()]  # a row per partition
    old = read_partitions(spark, path, part, values)
    kept = retention(fresh.limit(0) if old is None else old, fresh, least).withColumn("accepted", F.col("accepted") | F.lit(allow_shrink))
    (r,) = kept.collect()
    if not r["accepted"]:
        raise RefusedWrite(f"{path}: {r['new_rows']} rows for {r['old_rows']}, fewer than {least:.0%}")
    fresh.repartition(part, *[c for c in fresh.columns if c != part][:1]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
    return spark.createDataFrame([tuple(r)], "old_rows long, new_rows long, accepted boolean")


def upsert_partitions(new: DataFrame, path: str, part: str, keys: list[str], order: list[Column]) -> DataFrame:
    """Put rows into the table by key, the first per key in `order`; only partitions that `new` touches are read and written.
    Keys must include the partition column."""
    values = [r[0] for r in new.select(part).distinct().collect()]
    old = read_partitions(new.sparkSession, path, part, values)
    return replace_partitions(upsert(new.limit(0) if old is None else old.select(*new.columns), new, keys, order), path, part)
