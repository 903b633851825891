"""An older kind of event feed derived from lineitem: numeric event types, texts per side, 'away - home' scores, second
players. LEGACY_SQL is the same feed for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_NAME = "CASE l_suppkey % 4 WHEN 0 THEN 'Ann Stone' WHEN 1 THEN 'Ben Van Dyke' WHEN 2 THEN 'Cal Smith Jr.' ELSE 'Okoro' END"
_SHOT = "CASE l_linenumber % 3 WHEN 0 THEN ' 26ft 3PT Jump Shot' WHEN 1 THEN ' Driving Layup' ELSE CASE WHEN l_suppkey % 2 = 0 THEN ' Pullup Dunk' ELSE ' step back Jump Shot' END END"


def _steps(div: str) -> list[dict[str, str]]:
    game = f"(l_orderkey {div} 16)"
    home, away = f"({game} % 10)", f"(({game} + 1 + ({game} {div} 10) % 9) % 10)"
    text = f"""CASE event_type WHEN 1 THEN name || shot || ' (2 PTS)' || CASE WHEN l_suppkey % 3 = 0 THEN ' (Jones 3 AST)' ELSE '' END WHEN 2 THEN 'MISS ' || name || shot
      WHEN 3 THEN CASE WHEN l_partkey % 3 = 0 THEN 'MISS ' ELSE '' END || name || ' Free Throw ' || CAST(l_partkey % 2 + 1 AS STRING) || ' of ' || CAST(l_suppkey % 2 + 1 AS STRING)
      WHEN 4 THEN name || CASE l_suppkey % 3 WHEN 0 THEN ' offensive REBOUND' WHEN 1 THEN ' defensive REBOUND' ELSE ' REBOUND (Off:1 Def:2)' END ELSE name || ' event' END"""
    return [
        {
            "game": game, "game_id": f"lpad(CAST({game} AS STRING), 10, '0')", "home_id": home, "away_id": away, "event_type": "(l_partkey + l_linenumber) % 14", "period": "l_linenumber % 4 + 1",
            "clock": "CAST(l_partkey % 12 AS STRING) || ':' || lpad(CAST(l_suppkey % 60 AS STRING), 2, '0')", "name": _NAME, "shot": _SHOT,
            "player1_team_id": f"CASE WHEN l_suppkey % 5 = 0 THEN 0 WHEN l_suppkey % 2 = 0 THEN {home} ELSE {away} END", "player2_team_id": f"CASE WHEN l_suppkey % 2 = 0 THEN {home} ELSE {away} END",
            "player1_id": "l_suppkey % 40", "player2_id": "CASE WHEN l_partkey % 3 = 0 THEN l_partkey % 50 ELSE 0 END", "l_orderkey": "l_orderkey", "l_partkey": "l_partkey", "l_suppkey": "l_suppkey", "l_linenumber": "l_linenumber",
        },
        {"event_num": "CAST(row_number() OVER (PARTITION BY game ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber) AS BIGINT)", "body": text},
        {
            "home_text": "CASE l_suppkey % 7 WHEN 0 THEN body WHEN 1 THEN '  ' WHEN 2 THEN 'nan' END", "visitor_text": "CASE l_suppkey % 7 WHEN 1 THEN body WHEN 2 THEN '' WHEN 3 THEN body END", "neutral_text": "CASE WHEN l_suppkey % 7 IN (2, 4, 5) THEN body END",
            "score": "CASE WHEN l_partkey % 4 = 0 THEN '0 - 0' WHEN l_partkey % 4 = 1 THEN CAST(event_num + l_suppkey % 5 AS STRING) || ' - ' || CAST(event_num + l_linenumber AS STRING) WHEN l_partkey % 4 = 2 THEN 'TIE' END",
        },
    ]


_COLUMNS = ("game", "game_id", "home_id", "away_id", "event_num", "event_type", "period", "clock", "name", "home_text", "visitor_text", "neutral_text", "score", "player1_id", "player1_team_id", "player2_id", "player2_team_id")


def legacy_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns _COLUMNS: one row per event, numbered within its game."""
    first, *more = _steps("div")
    out = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(*[f"{e} AS {n}" for n, e in first.items()])
    for step in more:
        out = out.selectExpr("*", *[f"{e} AS {n}" for n, e in step.items()])
    return out.select(*_COLUMNS)


def _sql() -> str:
    first, *more = _steps("//")
    out = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in first.items()) + " FROM lineitem"
    for step in more:
        out = f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in step.items())} FROM ({out})"
    return f"legacy AS (SELECT {', '.join(_COLUMNS)} FROM ({out}))"


LEGACY_SQL = _sql()
