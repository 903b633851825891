"""Keyed table operations: dedupe, upsert, replacement, guards, top-n, joins of tables with tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut


def pick_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per key in the given order; ties need a complete order to be repeatable."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, where: Column | None = None) -> DataFrame:
    df = df if where is None else df.where(where)
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col("rank") <= n)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """New rows (the first per key in `order`) and the old rows of other keys."""
    fresh = pick_one(new, keys, order)
    return old.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def replace_groups(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of a touched group give way to the new ones."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def retention(old: DataFrame, new: DataFrame, least: float = 0.9) -> DataFrame:
    """One row: old_rows, new_rows, accepted."""
    a, b = old.agg(F.count("*").alias("old_rows")), new.agg(F.count("*").alias("new_rows"))
    return a.join(F.broadcast(b)).withColumn("accepted", F.col("new_rows") >= F.col("old_rows") * F.lit(least))  # single rows


def priority_union(frames: list[DataFrame]) -> DataFrame:
    """Union with source_priority 1, 2, ... in the given order."""
    out = frames[0].withColumn("source_priority", F.lit(1))
    for i, f in enumerate(frames[1:], 2):
        out = out.unionByName(f.withColumn("source_priority", F.lit(i)), allowMissingColumns=True)
    return out


def first_by_priority(df: DataFrame, keys: list[str], values: list[str], priorities: int) -> DataFrame:
    """Per key and column the value of the best priority that has one."""
    best = lambda c: F.coalesce(*[F.max(F.when(F.col("source_priority") == p, F.col(c))) for p in range(1, priorities + 1)])
    return df.groupBy(*keys).agg(*[best(c).alias(c) for c in values])


def flag_exists(df: DataFrame, flags: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """A boolean column per named table: whether the row's key occurs in it."""
    for name, other in flags.items():
        mark = other.select(*keys).distinct().withColumn(name, F.lit(True))
        df = df.join(mark, keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return df


def closed_remap(remap: DataFrame) -> DataFrame:
    """A remap table (old_id, new_id) followed to its ends: each old id with the id that its chain leads to.

    Pointers are doubled until nothing moves, so a chain of n links takes log2(n) rounds. Where a chain comes
    back to an id, that id is its end: (a to b, b to c, c to a) leaves a as it is. Repeated old ids count
    once, with the least new id. The table is small against what it is applied to, and never leaves Spark.
    """
    step = remap.where("old_id is not null and new_id is not null and old_id <> new_id").groupBy("old_id").agg(F.min("new_id").alias("new_id"))
    step = cut(step)
    now, limit, hops = step, step.count(), 1
    while hops < limit:
        ahead = now.select(F.col("old_id").alias("new_id"), F.col("new_id").alias("_far"))
        after = now.join(ahead, "new_id", "left").select("old_id", F.coalesce("_far", "new_id").alias("new_id"), F.col("_far").isNotNull().alias("_moved"))
        after = cut(after)
        now, hops = after.drop("_moved"), 2 * hops
        if after.where("_moved").isEmpty():
            break
    # pointers that still land on an old id are on a cycle or lead into one
    on = now.join(step.select(F.col("old_id").alias("new_id")), "new_id", "left_semi").select("old_id")
    return now.join(on, "old_id", "left_anti").unionByName(_cycle_ends(step, on))


def _cycle_ends(step: DataFrame, on: DataFrame) -> DataFrame:
    """Ends of chains that run into a cycle, walked link by link: the first id that comes again."""
    walk = step.join(on, "old_id", "left_semi").select("old_id", F.array("old_id").alias("seen"), "new_id")
    out = None
    while True:
        walk = cut(walk)
        back = walk.where(F.array_contains("seen", F.col("new_id"))).select("old_id", F.col("new_id"))
        out = back if out is None else out.unionByName(back)
        rest = walk.where(~F.array_contains("seen", F.col("new_id")))
        if rest.isEmpty():
            return out
        ahead = step.select(F.col("old_id").alias("new_id"), F.col("new_id").alias("_next"))
        walk = rest.join(ahead, "new_id").select("old_id", F.concat("seen", F.array("new_id")).alias("seen"), F.col("_next").alias("new_id"))


def follow_remap(df: DataFrame, column: str, remap: DataFrame) -> DataFrame:
    """The column with each id replaced by the end of its chain in the table (old_id, new_id); see closed_remap()."""
    ends = closed_remap(remap).select(F.col("old_id").alias("_old"), F.col("new_id").alias("_new"))
    return df.join(ends, F.col(column) == F.col("_old"), "left").withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")


def coverage_gate(wanted: DataFrame, have: DataFrame, keys: list[str], least: float = 0.98) -> DataFrame:
    """One row: wanted, covered, ratio, passed."""
    w = wanted.select(*keys).distinct()
    a = w.agg(F.count("*").alias("wanted"))
    b = w.intersect(have.select(*keys).distinct()).agg(F.count("*").alias("covered"))
    out = a.join(F.broadcast(b))  # single rows
    return out.withColumn("ratio", F.when(F.col("wanted") > 0, F.col("covered") / F.col("wanted"))).withColumn("passed", F.coalesce(F.col("ratio") >= least, F.lit(False)))


def reconcile(ours: DataFrame, official: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Our rows with the official values and signed differences."""
    theirs = official.select(*keys, *[F.col(v).alias(f"official_{v}") for v in values])
    out = ours.join(theirs, keys, "left")
    return out.withColumns({f"diff_{v}": F.col(v) - F.col(f"official_{v}") for v in values})


def reconcile_summary(diffs: DataFrame, value: str, near: float = 0.5) -> DataFrame:
    d = F.abs(F.col(f"diff_{value}"))
    return diffs.agg(F.count(d).alias("n"), F.avg(d).alias("mean_abs"), F.max(d).alias("max_abs"), F.avg((d == 0).cast("double")).alias("exact_rate"), F.avg((d <= near).cast("double")).alias("near_rate"))


def outer_zero(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join in which absent figures count as 0."""
    figures = [c for c in (*first.columns, *second.columns) if c not in keys]
    return first.join(second, keys, "full_outer").fillna(0, figures)


def absent(wanted: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of the first table that the second lacks."""
    return wanted.select(*keys).distinct().join(have.select(*keys).distinct(), keys, "left_anti")


def left_of_union(rows: DataFrame, sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """Left join to the union of several sources, whose keys do not overlap."""
    return rows.join(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources), keys, "left")
