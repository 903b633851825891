"""Incremental forms: decayed player state as a stream, and replacement of recomputed groups per micro-batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..lineage import dealt, fresh_dir
from . import folds


def decay_stream(shots: DataFrame, half_life: float = 1000.0, forget_after_ms: int | None = None) -> DataFrame:
    """Rows (player_id, event_id, made) in order of event_id become (player_id, event_id, a_before, m_before); the state
    of a player is its decayed attempts and makes, two numbers, kept between micro-batches.

    Batches must come in order of events; rows of one batch are put in order here. A batch's rows of one player are held
    together, so the source should bound its batches (maxFilesPerTrigger). With `forget_after_ms`, a player without shots
    for so long loses its state, which decays to nothing anyway.
    """
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        a, m = state.get if state.exists else (0.0, 0.0)
        rows = pd.concat(list(frames)).sort_values("event_id")
        before, (a, m) = folds.decayed(rows["made"].to_numpy(float), a, m, half_life)
        yield pd.DataFrame({"player_id": key[0], "event_id": rows["event_id"].to_numpy(), "a_before": before[0], "m_before": before[1]})
        state.update((a, m))
        if forget_after_ms:
            state.setTimeoutDuration(forget_after_ms)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if forget_after_ms else GroupStateTimeout.NoTimeout
    return shots.groupBy("player_id").applyInPandasWithState(step, "player_id long, event_id long, a_before double, m_before double", "a double, m double", "append", timeout)


def once_per_game(stream: DataFrame, key: str = "game_id", at: str = "ts", delay: str = "7 days") -> DataFrame:
    """Skip games that were already taken, within the watermark."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def replace_per_batch(path: str, partition: str):
    """A foreachBatch function that overwrites only the partitions a micro-batch holds."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)

    return write


def possession_stream(events: DataFrame, ends: tuple[str, ...], over: str = "game_end", silent_ms: int | None = None) -> DataFrame:
    """Possessions of games as they happen: rows (game_id, action_number, team_id, kind, points) become one row per ending event
    (game_id, poss_index, ended_by, team_id of the ending event, points of all events since the last end).

    The state of a game is its count and open points. It goes when an event of kind `over` comes or, if `silent_ms` is given,
    nothing has come for so long; points that are open then make a last possession, ended by 'end_of_game'. Batches must come
    in order of action_number per game. A stream that ends with its source (availableNow) must not wait for silence.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        index, points, opened = state.get if state.exists else (0, 0, False)
        rows = None if state.hasTimedOut else pd.concat(list(frames)).sort_values("action_number")
        found, left = folds.possessions(rows, index, points, opened, ends, over)
        if left:
            state.update(left)
            if silent_ms:
                state.setTimeoutDuration(silent_ms)
        elif state.exists or state.hasTimedOut:
            state.remove()
        if len(found):
            found.insert(0, "game_id", key[0])
            yield found

    timeout = GroupStateTimeout.ProcessingTimeTimeout if silent_ms else GroupStateTimeout.NoTimeout
    return events.groupBy("game_id").applyInPandasWithState(step, "game_id long, poss_index long, ended_by string, team_id long, points long", "index long, points long, opened boolean", "append", timeout)


_SPANS = "game_id long, poss_index long, ended_by string, team_id long, points long, closed boolean, opened boolean, finished boolean, batch int"


def _spans(batch: DataFrame, before: DataFrame, ends: tuple[str, ...], over: str) -> DataFrame:
    """The possessions of a batch and the open one of each game, from events and what the batch before left (rows of _SPANS)."""
    left = before.groupBy("game_id").agg(F.max(F.col("poss_index") - F.when(F.col("closed"), 0).otherwise(1)).alias("index"), F.sum(F.when(F.col("closed"), 0).otherwise(F.col("points"))).alias("points"), F.coalesce(F.max(F.when(~F.col("closed"), F.col("opened"))), F.lit(False)).alias("opened"), F.max("finished").alias("finished"))
    left = left.where("not finished").select("game_id", "index", "points", "opened")
    none = lambda t: F.lit(None).cast(t)
    kind = F.col("kind").cast("string")
    rows = batch.select(F.col("game_id").cast("long").alias("game_id"), none("long").alias("index"), F.col("action_number").cast("long").alias("at"), F.col("team_id").cast("long").alias("team_id"), kind.alias("kind"), F.coalesce(F.col("points").cast("long"), F.lit(0)).alias("points"), F.coalesce(kind != over, F.lit(True)).alias("opened"))
    carried = left.select("game_id", "index", none("long").alias("at"), none("long").alias("team_id"), none("string").alias("kind"), "points", "opened")
    both = dealt(rows.unionByName(carried), "game_id")
    game = Window.partitionBy("game_id").orderBy(F.col("index").isNull(), F.col("at").asc_nulls_last())  # what was left comes first
    end = F.coalesce(F.col("kind").isin(*ends), F.lit(False))
    both = both.withColumn("end", end).withColumns({"base": F.coalesce(F.first("index").over(game.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)), "n": F.coalesce(F.sum(F.col("end").cast("long")).over(game.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    both = both.withColumn("finished", F.max(F.coalesce(F.col("kind") == over, F.lit(False))).over(game.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    own = lambda c: F.max(F.when(F.col("end"), F.col(c)))  # noqa: E731  a possession has one end at most
    spans = both.groupBy("game_id", (F.col("base") + F.col("n") + 1).alias("poss_index")).agg(own("kind").alias("ended_by"), own("team_id").alias("team_id"), F.sum("points").alias("points"), F.max("end").alias("closed"), F.max("opened").alias("opened"), F.max("finished").alias("finished"))
    return spans.withColumn("ended_by", F.when(F.col("closed"), F.col("ended_by")).otherwise("end_of_game"))


def possessions_of_batches(events: DataFrame, ends: tuple[str, ...], over: str = "game_end") -> DataFrame:
    """Run a stream of events to the end of what there is: the rows of possession_stream() without silence, each micro-batch by windows
    within its games instead of a call for each game, so this is the form for many games.

    What a batch leaves of a game (its count, open points) lies in the shared folder and goes into the next batch with its
    events; a batch that is run again writes the same files. A batch costs its events and the games that are not over.
    """
    spark, path = events.sparkSession, fresh_dir(events.sparkSession, "possessions")
    of = lambda number: f"{path}/batch={number}"
    schema = spark.createDataFrame([], _SPANS).schema
    inside = [c for c in schema.names if c != "batch"]
    spark.createDataFrame([], schema).drop("batch").write.parquet(of(-1))  # before the first batch there is nothing

    def write(batch: DataFrame, number: int) -> None:
        before = batch.sparkSession.read.schema(schema).parquet(of(number - 1)).select(*inside)
        _spans(batch, before, ends, over).select(*inside).write.mode("overwrite").parquet(of(number))

    events.writeStream.foreachBatch(write).option("checkpointLocation", fresh_dir(spark, "possessions-log")).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(schema).parquet(path).where("closed or (finished and opened)")
    return found.select("game_id", "poss_index", "ended_by", "team_id", "points")


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 8) -> DataFrame:
    """A table's Parquet files as a stream, some files a batch."""
    one = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(one).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def replayed(stream: DataFrame, path: str, partition: str) -> None:
    """Run a stream to the end of what there is, replacing the partitions of `path` that its batches hold."""
    log = fresh_dir(stream.sparkSession, "replayed-log")
    stream.writeStream.foreachBatch(replace_per_batch(path, partition)).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()


def drain(stream: DataFrame) -> DataFrame:
    """Run a stream over all that its source holds now, into Parquet in the shared folder, and read it back."""
    spark = stream.sparkSession
    path = fresh_dir(spark, "stream")
    stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
