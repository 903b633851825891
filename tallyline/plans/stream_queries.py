"""Registered queries that run as streams over a table until it is read, each beside the SQL of the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lineage import fresh_dir
from ..sources import adapters as A
from ..sources.pbp import GAME_SECONDS, PBP_SQL, play_by_play
from ..streaming import incremental, ordered
from .registry import query


@query("""WITH s AS (SELECT user_id AS player_id, event_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END AS made, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)
  SELECT x.player_id, x.event_id, round(coalesce(sum(power(2.0, -(x.n - 1 - y.n)/1000.0)), 0), 6) AS a_before, round(coalesce(sum(y.made * power(2.0, -(x.n - 1 - y.n)/1000.0)), 0), 6) AS m_before FROM s x LEFT JOIN s y ON x.player_id = y.player_id AND y.n < x.n GROUP BY ALL""")
def decayed_state_stream(spark, d):
    events = incremental.table_stream(spark, d, "events")
    shots = events.select(F.col("user_id").alias("player_id"), "event_id", F.col("event_type").isin("purchase", "signup").cast("int").alias("made"))
    out = incremental.drain(incremental.decay_stream(shots))
    return out.select("player_id", "event_id", F.round("a_before", 6).alias("a_before"), F.round("m_before", 6).alias("m_before"))


@query("SELECT DISTINCT user_id AS game_id FROM events")
def games_taken_once(spark, d):
    """Each game of a stream once, however often its rows come within the watermark."""
    events = incremental.table_stream(spark, d, "events").select(F.col("user_id").alias("game_id"), F.col("ts").cast("timestamp").alias("ts"))
    return incremental.drain(incremental.once_per_game(events, delay="400 days")).select("game_id")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 2 * o_totalprice END AS price, o_orderstatus FROM orders")
def replaced_partitions(spark, d):
    """A first stream writes all orders; a second one brings one status anew, whose partition it replaces."""
    path = fresh_dir(spark, "replaced")
    orders = incremental.table_stream(spark, d, "orders", 1_000_000).select("o_orderkey", F.col("o_totalprice").alias("price"), "o_orderstatus")
    incremental.replayed(orders.withColumn("price", 2 * F.col("price")), path, "o_orderstatus")
    incremental.replayed(orders.where("o_orderstatus = 'F'"), path, "o_orderstatus")
    return spark.read.parquet(path).select("o_orderkey", "price", F.col("o_orderstatus").cast("string").alias("o_orderstatus"))


@query(f"""WITH {PBP_SQL}, s AS (SELECT *, coalesce(sum(CASE WHEN kind IN ('made', 'turnover') THEN 1 ELSE 0 END) OVER (PARTITION BY game_id ORDER BY action_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS i FROM pbp)
  SELECT game_id, CAST(i AS BIGINT) AS poss_index, arg_max(kind, action_number) AS ended_by, arg_max(team_id, action_number) AS team_id, CAST(sum(points) AS BIGINT) AS points FROM s GROUP BY 1, 2 HAVING arg_max(kind, action_number) IN ('made', 'turnover')""")
def streamed_possessions(spark, d):
    """The feed is laid down in the shared folder and read as a stream of games."""
    path = fresh_dir(spark, "feed")
    play_by_play(spark, d).select("game_id", "action_number", "team_id", "kind", "points").write.parquet(path)
    schema = spark.read.parquet(path).schema
    events = spark.readStream.schema(schema).parquet(path)
    return incremental.possessions_of_batches(events, ("made", "turnover"))


def _out_of_order(rows: DataFrame, at: str, pieces: int = 4) -> tuple[DataFrame, str]:
    """The rows as a stream of `pieces` micro-batches and more, a row in the piece of its time or the one after it, in any order
    within a piece; a row without key a year later closes the stream. Also the delay that such rows need."""
    spark = rows.sparkSession
    stage, path = fresh_dir(spark, "pieces"), fresh_dir(spark, "feed")
    low, high = rows.agg(F.unix_seconds(F.min(at)), F.unix_seconds(F.max(at))).first()
    width = ((high or 0) - (low or 0)) // pieces + 1
    piece = ((F.unix_seconds(at) - (low or 0)) / width).cast("int") + F.abs(F.xxhash64(*rows.columns)) % 2
    rows.withColumn("_piece", piece).write.partitionBy("_piece").parquet(stage)
    laid = spark.read.schema(T.StructType([*rows.schema, T.StructField("_piece", T.IntegerType())])).parquet(stage)
    for p in range(pieces + 1):
        laid.where(F.col("_piece") == p).drop("_piece").write.mode("append").parquet(path)
    closing = spark.range(1).select(F.timestamp_seconds(F.lit((high or 0) + 2 * width + 366 * 86400)).alias(at))
    rows.limit(0).unionByName(closing, allowMissingColumns=True).coalesce(1).write.mode("append").parquet(path)
    files = spark.read.parquet(path).inputFiles()
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(len(files) // pieces, 1)).parquet(path), f"{2 * width} seconds"


@query("""WITH s AS (SELECT user_id AS player_id, event_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END AS made, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
  SELECT x.player_id, x.event_id, round(coalesce(sum(power(2.0, -(x.n - 1 - y.n)/1000.0)), 0), 6) AS a_before, round(coalesce(sum(y.made * power(2.0, -(x.n - 1 - y.n)/1000.0)), 0), 6) AS m_before FROM s x LEFT JOIN s y ON x.player_id = y.player_id AND y.n < x.n GROUP BY ALL""")
def decayed_state_any_order(spark, d):
    """The state of players from shots that come out of order: rows wait in the state until the watermark has passed them."""
    events = A.table(spark, d, "events")
    shots = events.select(F.col("user_id").alias("player_id"), "event_id", F.col("event_type").isin("purchase", "signup").cast("int").alias("made"), F.col("ts").cast("timestamp").alias("ts"))
    stream, delay = _out_of_order(shots, "ts")
    out = incremental.drain(ordered.decay_in_order(stream, delay=delay))
    return out.select("player_id", "event_id", F.round("a_before", 6).alias("a_before"), F.round("m_before", 6).alias("m_before"))


@query(f"""WITH {PBP_SQL}, s AS (SELECT *, coalesce(sum(CASE WHEN kind IN ('made', 'turnover') THEN 1 ELSE 0 END) OVER (PARTITION BY game_id ORDER BY action_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS i FROM pbp)
  SELECT game_id, CAST(i AS BIGINT) AS poss_index, CASE WHEN arg_max(kind, action_number) IN ('made', 'turnover') THEN arg_max(kind, action_number) ELSE 'end_of_game' END AS ended_by, CASE WHEN arg_max(kind, action_number) IN ('made', 'turnover') THEN arg_max(team_id, action_number) END AS team_id, CAST(sum(points) AS BIGINT) AS points FROM s GROUP BY 1, 2""")
def possessions_any_order(spark, d):
    """Possessions of games whose events come out of order; a game ends a game's length of event time after its last event, and what is
    open then is a possession of its own. Games start a minute apart."""
    feed = play_by_play(spark, d).select("game_id", "action_number", "team_id", "kind", "points", F.timestamp_seconds(F.col("game_id") * 60 + F.col("elapsed")).alias("ts"))
    stream, delay = _out_of_order(feed, "ts")
    return incremental.drain(ordered.possessions_of_sessions(stream, ("made", "turnover"), f"{GAME_SECONDS} seconds", delay))
