"""Frames of the event-data shapes, derived from the driver's star-schema tables by plain arithmetic.

Each adapter exists as a DataFrame and, in WITH_SQL, as a DuckDB common table expression of the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _slots(team: str, seed: str, div: str) -> list[str]:
    return [f"{team}*100 + ({seed} {div} {3**k}) % 3 + {3 * k}" for k in range(5)]


_HOME, _AWAY = "(l_orderkey % 10)", "((l_orderkey + 1 + (l_orderkey {div} 10) % 9) % 10)"


def _stint_columns(div: str) -> dict[str, str]:
    away = _AWAY.format(div=div)
    arr = "array({})" if div == "div" else "[{}]"
    return {
        "game_id": "l_orderkey", "date": "cast(o_orderdate as date)", "home_id": _HOME, "away_id": away,
        "home_lineup": arr.format(", ".join(_slots(_HOME, "l_partkey", div))), "away_lineup": arr.format(", ".join(_slots(away, "(l_partkey + l_suppkey)", div))),
        "seconds": "l_quantity * 10", "home_pts": "floor(l_extendedprice / 10000)", "away_pts": "floor(l_extendedprice / 20000) + l_linenumber",
        "home_pts_adj": "floor(l_extendedprice / 10000) * (1 - l_discount)", "away_pts_adj": "(floor(l_extendedprice / 20000) + l_linenumber) * (1 - l_tax)",
        "l_linenumber": "l_linenumber", "l_partkey": "l_partkey", "l_suppkey": "l_suppkey", "ended_by": "l_returnflag",
    }


def _lines_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their orders, dealt by order."""
    lines = table(spark, sf_dir, "lineitem")
    return dealt(lines, "l_orderkey").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))


def stints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines_of_orders(spark, sf_dir)
    rows = rows.select(*[F.expr(e).alias(n) for n, e in _stint_columns("div").items()])
    return rows.withColumn("stint_index", F.expr("cast(row_number() over (partition by game_id order by l_linenumber, l_partkey, l_suppkey) as bigint)"))


def possessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stints(spark, sf_dir)
    home = F.col("l_linenumber") % 2 == 0
    pick = lambda a, b: F.when(home, F.col(a)).otherwise(F.col(b))
    return s.select("game_id", F.col("stint_index").alias("poss_index"), pick("home_id", "away_id").alias("offense_team"), pick("away_id", "home_id").alias("defense_team"), pick("home_lineup", "away_lineup").alias("off_lineup"), pick("away_lineup", "home_lineup").alias("def_lineup"), (F.col("l_linenumber") % 4).alias("points"), "ended_by", "date")


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", F.to_date("ts").alias("game_id"), F.col("user_id").alias("player_id"), F.col("event_type").isin("purchase", "signup").cast("int").alias("made"), F.col("event_type").alias("type"), F.when(F.col("value") >= 50, "corner").otherwise("above_break").alias("area"), (F.get_json_object("props", "$.k").cast("int") % 2).alias("assisted"), "value")


def player_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines_of_orders(spark, sf_dir)
    return rows.groupBy(F.col("l_orderkey").alias("game_id"), (F.col("l_suppkey") % 50).alias("player_id")).agg(
        F.max(F.to_date("o_orderdate")).alias("date"), F.max(F.col("l_suppkey") % 4).alias("team_id"), F.sum("l_quantity").alias("minutes"), F.sum(F.col("l_linenumber") * 5).cast("long").alias("pts"),
        F.sum(F.col("l_partkey") % 13).alias("reb"), F.sum(F.col("l_partkey") % 11).alias("ast"), F.sum(F.col("l_partkey") % 4).alias("stl"), F.sum(F.col("l_partkey") % 3).alias("blk"),
        F.sum(F.col("l_linenumber") + 3).cast("long").alias("fga"), F.sum(F.col("l_linenumber")).cast("long").alias("fgm"), F.sum(F.col("l_partkey") % 7).alias("fta"),
    )


STINTS_SQL = "stints AS (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY l_linenumber, l_partkey, l_suppkey) AS stint_index FROM (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _stint_columns("//").items()) + " FROM lineitem JOIN orders ON l_orderkey = o_orderkey))"
SIDES_SQL = STINTS_SQL + """, sides AS (
  SELECT game_id, stint_index, date, seconds, home_id AS team_id, list_sort(home_lineup) AS lineup, home_pts AS pf, away_pts AS pa, home_pts_adj AS pf_adj, away_pts_adj AS pa_adj FROM stints
  UNION ALL SELECT game_id, stint_index, date, seconds, away_id, list_sort(away_lineup), away_pts, home_pts, away_pts_adj, home_pts_adj FROM stints)"""
POSS_SQL = STINTS_SQL + """, possessions AS (
  SELECT game_id, stint_index AS poss_index, CASE WHEN l_linenumber % 2 = 0 THEN home_id ELSE away_id END AS offense_team, CASE WHEN l_linenumber % 2 = 0 THEN away_id ELSE home_id END AS defense_team, CASE WHEN l_linenumber % 2 = 0 THEN home_lineup ELSE away_lineup END AS off_lineup,
  CASE WHEN l_linenumber % 2 = 0 THEN away_lineup ELSE home_lineup END AS def_lineup, l_linenumber % 4 AS points, ended_by, date FROM stints)"""
SHOTS_SQL = """shots AS (
  SELECT event_id, ts, CAST(ts AS DATE) AS game_id, user_id AS player_id, CAST(event_type IN ('purchase', 'signup') AS INTEGER) AS made, event_type AS type,
  CASE WHEN value >= 50 THEN 'corner' ELSE 'above_break' END AS area, CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 AS assisted, value FROM events)"""
PLAYER_GAMES_SQL = """player_games AS (
  SELECT l_orderkey AS game_id, l_suppkey % 50 AS player_id, max(CAST(o_orderdate AS DATE)) AS date, max(l_suppkey % 4) AS team_id, sum(l_quantity) AS minutes, CAST(sum(l_linenumber * 5) AS BIGINT) AS pts,
  CAST(sum(l_partkey % 13) AS BIGINT) AS reb, CAST(sum(l_partkey % 11) AS BIGINT) AS ast, CAST(sum(l_partkey % 4) AS BIGINT) AS stl, CAST(sum(l_partkey % 3) AS BIGINT) AS blk,
  CAST(sum(l_linenumber + 3) AS BIGINT) AS fga, CAST(sum(l_linenumber) AS BIGINT) AS fgm, CAST(sum(l_partkey % 7) AS BIGINT) AS fta
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""
