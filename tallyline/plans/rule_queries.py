"""Registered queries of single rules, each beside its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facts, reconstruct
from ..schemas import union_common
from ..sources import adapters as A
from ..sources.pbp import PBP_SQL, play_by_play
from . import audits
from .messy_queries import _FAULTY_SQL, _faulty
from .registry import query


@query(f"""WITH {A.PLAYER_GAMES_SQL}, c AS (SELECT player_id, count(*) AS games, count(*) FILTER (minutes >= 20) + least(count(*) FILTER (minutes >= 15 AND minutes < 20), 2) + CASE WHEN player_id % 7 = 0 THEN 1 ELSE 0 END AS counted FROM player_games GROUP BY 1),
  l AS (SELECT DISTINCT player_id, player_id % 9 AS n FROM player_games WHERE player_id % 5 <> 0), m AS (SELECT avg(n) AS mean FROM l WHERE n > 0)
  SELECT player_id, games, counted, CASE WHEN counted >= 1000 THEN 'CLINCHED' WHEN counted + CASE WHEN n > 0 THEN n ELSE mean END < 1000 THEN 'ELIMINATED' ELSE 'BUBBLE' END AS status FROM c LEFT JOIN l USING (player_id), m""")
def award_bonus(spark, d):
    """Eligibility with a game that no box holds, and the games that are left to each player."""
    games = A.player_games(spark, d)
    players = games.select("player_id").distinct()
    bonus = players.where("player_id % 7 = 0").withColumn("games", F.lit(1))
    left = players.where("player_id % 5 <> 0").withColumn("games", F.col("player_id") % 9)
    return facts.eligibility(games, 1000, 1230, bonus=bonus, remaining=left)


@query(f"WITH {_FAULTY_SQL} SELECT CAST(season AS BIGINT) AS season, game_id, count(*) AS missing_rows, sum(minutes) AS minutes_total FROM faulty WHERE on_possessions IS NULL GROUP BY 1, 2")
def missing_possessions_by_game(spark, d):
    return audits.missing_by_game(_faulty(spark, d), "on_possessions", ["season", "game_id"]).withColumn("season", F.col("season").cast("long"))


@query(f"WITH {_FAULTY_SQL} SELECT CAST(season AS BIGINT) AS season, game_id, count(*) AS missing_rows, sum(minutes) AS minutes_total FROM faulty WHERE pts IS NULL GROUP BY 1, 2")
def missing_boxes_by_game(spark, d):
    return audits.missing_by_game(_faulty(spark, d), "pts", ["season", "game_id"]).withColumn("season", F.col("season").cast("long"))


@query("SELECT nationkey, name, count(*) AS n FROM (SELECT c_nationkey AS nationkey, c_name AS name FROM customer UNION ALL SELECT s_nationkey, s_name FROM supplier) GROUP BY 1, 2")
def common_columns(spark, d):
    """Two tables of different columns, united on those that both have."""
    own = lambda t, p, more: A.table(spark, d, t).select(*more, F.col(f"{p}_name").alias("name"), F.col(f"{p}_nationkey").alias("nationkey"))
    return union_common(own("customer", "c", ["c_mktsegment"]), own("supplier", "s", ["s_acctbal"])).groupBy("nationkey", "name").agg(F.count("*").alias("n"))


@query(f"""WITH {PBP_SQL}, s AS (SELECT c_custkey AS player_id, CAST(c_custkey % 40 AS DOUBLE) AS a, CAST(c_custkey % 13 AS DOUBLE) AS m FROM customer),
  e AS (SELECT game_id, team_id, kind = 'made' AS made, CASE WHEN a >= 10 THEN m / a ELSE 0.36 END AS p FROM pbp LEFT JOIN s USING (player_id) WHERE three AND kind IN ('made', 'missed'))
  SELECT game_id, team_id, count(*) AS threes, round(sum(CASE WHEN made THEN 3.0 ELSE 0.0 END - 3 * p), 6) AS adjustment FROM e GROUP BY 1, 2""")
def older_adjustments(spark, d):
    """What luck gave each team in the older feeds' way."""
    state = A.table(spark, d, "customer").select(F.col("c_custkey").alias("player_id"), (F.col("c_custkey") % 40).cast("double").alias("a"), (F.col("c_custkey") % 13).cast("double").alias("m"))
    shots = play_by_play(spark, d).where("three and kind in ('made', 'missed')").join(state, "player_id", "left")
    gained = reconstruct.plain_adjustment(F.col("kind") == "made", reconstruct.plain_expectation(F.col("a"), F.col("m")))
    return shots.groupBy("game_id", "team_id").agg(F.count("*").alias("threes"), F.round(F.sum(gained), 6).alias("adjustment"))
