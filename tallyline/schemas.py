"""Schema helpers: conforming to a schema, required columns, typed empty tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """The schema's columns in order: cast where present (null where the cast fails), typed null where absent."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def empty(spark: SparkSession, schema: StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def union_common(*frames: DataFrame) -> DataFrame:
    """Union on the columns that all frames have, in the first one's order."""
    names = [c for c in frames[0].columns if all(c in f.columns for f in frames)]
    out = frames[0].select(*names)
    for f in frames[1:]:
        out = out.unionByName(f.select(*names))
    return out
