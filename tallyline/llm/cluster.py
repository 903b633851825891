"""Lineage cuts, shared folders and distributed running sums used by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..lineage import cut, fresh_dir, shared_dir

__all__ = ["cut", "fresh_dir", "fresh_names", "hot_join", "running_sums", "shared_dir", "small_batches"]


#: Texts of one Arrow batch. Spark's 10,000 make batches of tens of MB, of which a Python worker holds several copies.
BATCH_TEXTS = 1000


def small_batches(spark: SparkSession) -> None:
    """Let Python workers get texts in batches of BATCH_TEXTS rows at most; smaller settings stay."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_TEXTS:
        spark.conf.set(name, str(BATCH_TEXTS))


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """Column names like `names` that df does not have yet, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def hot_join(many: DataFrame, one: DataFrame, counts: DataFrame, key: str, spread: str, how: str = "inner") -> DataFrame:
    """many joined with one by `key`, which is unique in `one`; keys of many rows are dealt over several tasks.

    `counts` (key, n; materialised) says how many rows of `many` a key has. Those with more than a quarter of an average
    partition are hot, of which there can be four a partition at most, so their list may be broadcast. Rows of a hot key
    are dealt by a hash of the column `spread`, and its row of `one` is repeated for each part.
    """
    parts = max(int(many.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    limit = max((counts.agg(F.sum("n")).first()[0] or 0) // (4 * parts), 256)
    hot = counts.where(F.col("n") > limit).select(key, F.ceil(F.col("n") / limit).cast("int").alias("__parts"))
    if hot.isEmpty():
        return many.join(one, key, how)
    hot = F.broadcast(hot)
    left = many.join(hot, key, "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(spread), "__parts").cast("int"), F.lit(0))).drop("__parts")
    right = one.join(hot, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return left.join(right, [key, "__salt"], how).drop("__salt")


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Add for each name the sum of its expression over all rows before this one, in the given order.

    The rows are range partitioned once; each task sums its own range, and only one row per partition meets in the
    small table of partition offsets. Nothing is sorted in one task. Ties in `order` come in an arbitrary but fixed
    order. Nulls in an expression count as 0; an empty table stays empty.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    zero = lambda c: F.coalesce(c, F.lit(0))
    totals = ranged.groupBy("__part").agg(*[F.sum(zero(e)).alias(f"__t_{n}") for n, e in sums.items()])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__part", *[zero(F.sum(f"__t_{n}").over(before)).alias(f"__o_{n}") for n in sums])
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumns({f"__w_{n}": zero(F.sum(zero(e)).over(inside)) for n, e in sums.items()})
    # offsets: one row per partition, a size that the partition count bounds
    out = out.join(F.broadcast(offsets), "__part")
    return out.select(*df.columns, *[(F.col(f"__o_{n}") + F.col(f"__w_{n}")).alias(n) for n in sums])
