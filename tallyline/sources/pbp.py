"""A play-by-play feed derived from the driver's lineitem table: sixteen orders make a game, a line is an event.

Each team has five slots with a starter and a substitute; a 'sub' event swaps the two, so five are on the floor at all times.
Actions come from whoever holds the slot at that moment. PBP_SQL is the same feed for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..lineage import dealt

GAME_SECONDS = 2880


def _steps(div: str) -> list[dict[str, str]]:
    game = f"(l_orderkey {div} 16)"
    home, away = f"({game} % 10)", f"(({game} + 1 + ({game} {div} 10) % 9) % 10)"
    code = "((l_partkey + l_linenumber) % 8)"
    kind = f"CASE WHEN {code} <= 1 THEN 'made' WHEN {code} = 2 THEN 'missed' WHEN {code} = 3 THEN 'defensive_rebound' WHEN {code} = 4 THEN 'turnover' WHEN {code} = 5 THEN 'free_throw' ELSE 'sub' END"
    points = f"CASE WHEN {code} <= 1 THEN 2 + l_linenumber % 2 WHEN {code} = 5 THEN l_partkey % 2 ELSE 0 END"
    return [
        {
            "game_id": game, "home_id": home, "away_id": away, "elapsed": "CAST((l_partkey * 37 + l_suppkey * 11 + l_linenumber * 101) % 2879 + 1 AS BIGINT)", "kind": kind,
            "team_id": f"CASE WHEN l_suppkey % 2 = 0 THEN {home} ELSE {away} END", "slot": f"(l_suppkey {div} 2) % 5", "points": f"CAST({points} AS BIGINT)", "three": f"{code} <= 2 AND l_linenumber % 2 = 1",
            "description": f"CASE WHEN {code} = 5 THEN 'Free Throw ' || CAST(l_linenumber % 2 + 1 AS STRING) || ' of ' || CAST((l_linenumber + l_suppkey) % 2 + 1 AS STRING) END",
            "l_orderkey": "l_orderkey", "l_partkey": "l_partkey", "l_suppkey": "l_suppkey", "l_linenumber": "l_linenumber",
        },
        {"action_number": "CAST(row_number() OVER (PARTITION BY game_id ORDER BY elapsed, l_orderkey, l_partkey, l_suppkey, l_linenumber) AS BIGINT)"},
        {"swaps": "CAST(coalesce(sum(CASE WHEN kind = 'sub' THEN 1 ELSE 0 END) OVER (PARTITION BY game_id, team_id, slot ORDER BY action_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)"},
        {"player_id": "team_id * 100 + slot + 5 * (swaps % 2)", "in_id": "CASE WHEN kind = 'sub' THEN team_id * 100 + slot + 5 * ((swaps + 1) % 2) END", "period": f"(elapsed - 1) {div} 720 + 1"},
    ]


def play_by_play(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns game_id, home_id, away_id, period, elapsed, action_number, kind, team_id, player_id (of a 'sub' the one who
    leaves), in_id, points, three, description (of free throws). Dealt by game: windows and joins within a game stay in place."""
    first, *more = _steps("div")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    out = dealt(lines.selectExpr(*[f"{e} AS {n}" for n, e in first.items()]), "game_id", rows=lines.count())
    for step in more:
        out = out.selectExpr("*", *[f"{e} AS {n}" for n, e in step.items()])
    return out.select("game_id", "home_id", "away_id", "period", "elapsed", "action_number", "kind", "team_id", "player_id", "in_id", "points", "three", "description")


def _sql() -> str:
    first, *more = _steps("//")
    out = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in first.items()) + " FROM lineitem"
    for step in more:
        out = f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in step.items())} FROM ({out})"
    return f"pbp AS ({out})"


PBP_SQL = _sql()
