"""Ordered-event operators: islands, fills, deltas, intervals, sessions, as-of and interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, key: list[str], order: list[Column], value: str) -> DataFrame:
    """Add island, counting up whenever `value` changes within the key."""
    w = Window.partitionBy(*key).orderBy(*order)
    change = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & F.lag(F.lit(1)).over(w).isNotNull(), 0).otherwise(1)
    return df.withColumn("_change", change).withColumn("island", F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_change")


def fill_both(df: DataFrame, key: list[str], order: list[Column], value: str) -> DataFrame:
    """Forward fill, then back fill. The latter is a forward fill in reverse order: a frame that ends at the last row and starts at
    each one would be read anew for every row."""
    w = Window.partitionBy(*key).orderBy(*order)
    rows = df.withColumns({"_n": F.row_number().over(w), "_forward": F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    back = F.last(value, ignorenulls=True).over(Window.partitionBy(*key).orderBy(F.desc("_n")).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(value, F.coalesce("_forward", back)).drop("_n", "_forward")


def deltas(df: DataFrame, key: list[str], order: list[Column], value: str, name: str) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn(name, F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0)))


def sessions(df: DataFrame, key: list[str], order: list[Column], is_end: Column) -> DataFrame:
    """Add session: the number of end events before the row, so an end closes its own session."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("session", F.coalesce(F.sum(F.when(is_end, 1).otherwise(0)).over(w), F.lit(0)))


def interval_join(points: DataFrame, intervals: DataFrame, key: list[str], at: str, start: str, end: str) -> DataFrame:
    """Points with the intervals of their key that cover them: start < at <= end, so a boundary belongs to what ends there."""
    return points.join(intervals, key).where((F.col(at) > F.col(start)) & (F.col(at) <= F.col(end)))


def interval_sums(intervals: DataFrame, points: DataFrame, key: list[str], at: str, start: str, end: str, value: str) -> DataFrame:
    """Per interval the sum of the points in (start, end], as a difference of running sums: one shuffle by key, no pairs.

    Boundaries and points go into one ordered stream per key; a boundary sees all points up to and with its time.
    """
    marks = intervals.select(*key, start, end, F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(-1).alias("sign")), F.struct(F.col(end).alias("t"), F.lit(1).alias("sign")))).alias("m"))
    marks = marks.select(*key, F.col("m.t").cast("double").alias("t"), F.lit(1).alias("kind"), F.col("m.sign").alias("sign"), start, end, F.lit(0.0).alias("v"))
    none = lambda c: F.lit(None).cast(intervals.schema[c].dataType).alias(c)
    facts = points.select(*key, F.col(at).cast("double").alias("t"), F.lit(0).alias("kind"), F.lit(0).alias("sign"), none(start), none(end), F.col(value).cast("double").alias("v"))
    w = Window.partitionBy(*key).orderBy("t", "kind").rangeBetween(Window.unboundedPreceding, 0)
    both = marks.unionByName(facts).withColumn("run", F.sum("v").over(w)).where("kind = 1")
    return both.groupBy(*key, start, end).agg((F.sum(F.col("sign") * F.col("run")) / F.greatest(F.sum(F.when(F.col("sign") > 0, 1).otherwise(0)), F.lit(1))).alias(value))


def first_after(df: DataFrame, events: DataFrame, key: list[str], at: str, event_at: str, value: str) -> DataFrame:
    """Forward as-of: the first later event of the same key, null if none follows. Rows and events go into one stream in order of
    time, in which a window looks ahead; no pairs are made."""
    mine = df.withColumns({"_at": F.col(at), "_event": F.lit(None).cast(f"struct<e:{events.schema[event_at].dataType.simpleString()},v:{events.schema[value].dataType.simpleString()}>"), "_kind": F.lit(1)})
    theirs = events.select(*key, F.col(event_at).alias("_at"), F.struct(F.col(event_at).alias("e"), F.col(value).alias("v")).alias("_event"), F.lit(0).alias("_kind"))
    both = mine.unionByName(theirs, allowMissingColumns=True)
    # events come before rows of their time, so that only later ones follow; of events at one time the least value counts
    # the order is reversed, so that the frame grows row by row
    w = Window.partitionBy(*key).orderBy(F.desc("_at"), F.desc("_kind"), F.desc("_event")).rowsBetween(Window.unboundedPreceding, -1)
    out = both.withColumn("_f", F.last("_event", ignorenulls=True).over(w)).where("_kind = 1")
    return out.select(*df.columns, F.col("_f.e").alias(event_at), F.col("_f.v").alias(value))


def first_proof(asked: DataFrame, events: DataFrame, key: list[str], at: str, member: str) -> DataFrame:
    """For each asked row (key, at, candidate member): the candidate whose next event of the key comes first, if one alone is
    first; else null. Rows key, at, member."""
    later = first_after(asked.select(*key, at, member), events.select(*key, member, F.col(at).alias("_seen"), F.col(at).alias("_same")), [*key, member], at, "_seen", "_same")
    first = later.groupBy(*key, at).agg(F.min("_seen").alias("_seen"), F.collect_list(F.struct(F.col("_seen").alias("s"), F.col(member).alias("m"))).alias("_all"))
    # an asked row has a handful of candidates
    winners = F.filter("_all", lambda x: x["s"] == F.col("_seen"))
    return first.select(*key, at, F.when(F.size(winners) == 1, F.get(winners, F.lit(0))["m"]).alias(member))


def on_court_intervals(moves: DataFrame, key: list[str], at: str, sign: str, end_of: str) -> DataFrame:
    """Intervals from +1 / -1 moves of a member: from each entry to the next exit, or to the end."""
    w = Window.partitionBy(*key).orderBy(F.col(at), F.col(sign))
    rows = moves.withColumn("on", F.sum(sign).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("until", F.coalesce(F.lead(at).over(w), F.col(end_of)))
    return rows.where((F.col("on") == 1) & (F.col("until") > F.col(at))).select(*key, F.col(at).alias("start"), F.col("until").alias("end"))
