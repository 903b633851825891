"""The span report on facts with every column of it, beside its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import spans
from ..sources import adapters as A
from . import search
from .registry import query

#: Columns that the driver's tables do not have, by plain arithmetic over a player's game; each is valid in Spark and DuckDB.
_MADE = {
    "season": "CASE WHEN game_id % 97 > 0 THEN year(date) END", "possessions": "pts + reb", "oreb": "reb % 3", "dreb": "reb - reb % 3", "tov": "ast % 5",
    "fg3m": "fgm % 3", "fg3a": "fgm % 3 + pts % 2", "fg2m": "fgm - fgm % 3", "fg2a": "fga - fgm % 3 - pts % 2", "ftm": "CASE WHEN fta % 2 = 0 THEN fta END",
    "assisted_2pm": "fgm % 2", "unassisted_2pm": "fgm % 5", "assisted_3pm": "fgm % 4", "unassisted_3pm": "fgm % 7", "assisted_fgm": "fgm % 6", "unassisted_fgm": "fgm % 8",
    "plus_minus_actual": "pts - ast", "plus_minus_adjusted": "2 * pts - 3 * ast", "on_off_actual": "CASE WHEN reb % 4 > 0 THEN ast - reb END", "on_off_adjusted": "ast - stl",
    "player_name": "'P' || CAST(player_id % 40 AS STRING)", "listed_height": "CASE WHEN game_id % 3 = 0 THEN NULL WHEN game_id % 3 = 1 THEN '' ELSE '6-' || CAST(game_id % 12 AS STRING) END",
    "height_inches": "CASE WHEN game_id % 4 > 0 THEN 70 + game_id % 12 END", "draft_year": "CASE WHEN player_id % 3 > 0 AND game_id % 5 > 0 THEN 1980 + game_id % 10 END", "draft_overall_pick": "CASE WHEN player_id % 3 > 0 THEN 1 + game_id % 60 END",
    "age": "CASE WHEN game_id % 7 > 0 THEN year(date) - 1970 + player_id % 5 END", "career_year": "CASE WHEN player_id % 4 > 0 THEN year(date) - 1990 END",
    "rim_dfga": "CASE WHEN game_id % 3 > 0 THEN game_id % 50 END", "rim_tracking_games": "game_id % 5", "rim_assists_season_games": "CASE WHEN game_id % 5 > 0 THEN game_id % 4 END",
}
_MADE |= {n: f"CASE WHEN (game_id + {i}) % 4 > 0 THEN game_id % {7 + i} END" for i, n in enumerate(spans.SEASON_MEANS)}
_MADE |= {n: f"CASE WHEN game_id % 2 = 0 AND (game_id + {i}) % 3 > 0 THEN game_id % {5 + i} END" for i, n in enumerate(spans.PER_GAME)}
_MADE |= {f"{n}_per_game": f"CASE WHEN game_id % 3 = 0 AND (game_id + {i}) % 5 > 0 THEN game_id % {4 + i} END" for i, n in enumerate(spans.ASSISTS)}


def _facts(spark, d) -> DataFrame:
    return A.player_games(spark, d).selectExpr("*", *[f"{e} AS {n}" for n, e in _MADE.items()])


_SUMS = ("games", "possessions", *spans.COUNTS, *spans.MARGINS)
_MEANS = (*spans.WEIGHTED, *spans.SEASON_MEANS, "rim_dfga", *spans.PER_GAME, *spans.ASSISTS, "ts_game", "fg2_pct", "fg3_pct", "ft_pct", "minutes")
_PER_ASSIST = [f"{n}_per_game" for n in spans.ASSISTS]


def _pack(names) -> str:
    return "{" + ", ".join(f"'{n}': CAST({n} AS DOUBLE)" for n in names) + "}"


def _any(names) -> str:
    return "season IS NOT NULL AND coalesce(" + ", ".join(names) + ") IS NOT NULL"


_SPANS_SQL = f"""{A.PLAYER_GAMES_SQL}, f AS (SELECT *, {", ".join(f"{e} AS {n}" for n, e in _MADE.items())} FROM player_games WHERE pts >= 5),
  s AS (SELECT player_id, season, count(*) AS games, arg_min({_pack((*spans.SEASON_MEANS, "rim_dfga", "rim_tracking_games"))}, (date, game_id)) FILTER (season IS NOT NULL) AS r,
    arg_min({_pack(spans.PER_GAME)}, (date, game_id)) FILTER ({_any(spans.PER_GAME)}) AS p, arg_min({_pack(("rim_assists_season_games", *_PER_ASSIST))}, (date, game_id)) FILTER ({_any(_PER_ASSIST)}) AS a FROM f GROUP BY 1, 2),
  v AS (SELECT player_id, {", ".join(f"sum(coalesce(r.{n}, 0)) / nullif(count(r), 0) AS {n}" for n in spans.SEASON_MEANS)},
    CASE WHEN count(r) > 0 THEN coalesce(sum(CASE WHEN r.rim_tracking_games > 0 THEN coalesce(r.rim_dfga, 0) * games / r.rim_tracking_games END), 0) END AS rim_dfga, {", ".join(f"sum(p.{n} * games) AS {n}" for n in spans.PER_GAME)},
    {", ".join(f"sum(CASE WHEN a.rim_assists_season_games > 0 THEN a.{n}_per_game * games END) AS {n}" for n in spans.ASSISTS)} FROM s GROUP BY 1),
  g AS (SELECT player_id, count(*) AS games, sum(minutes) AS minutes, {", ".join(f"CAST(sum(coalesce({n}, 0)) AS BIGINT) AS {n}" for n in _SUMS[1:])}, {", ".join(f"sum(coalesce({n}, 0) * minutes) / sum(minutes) AS {n}" for n in spans.WEIGHTED)},
    {", ".join(f"min({n}) AS {n}" for n in spans.LEAST)}, {", ".join(f"arg_min({n}, (date, game_id)) FILTER ({n} IS NOT NULL AND CAST({n} AS VARCHAR) <> '') AS {n}" for n in spans.BIO)} FROM f GROUP BY 1),
  spans AS (SELECT g.*, v.* EXCLUDE (player_id), pts / nullif(2 * (fga + 0.44 * fta), 0) AS ts_game, fg2m / nullif(fg2a, 0) AS fg2_pct, fg3m / nullif(fg3a, 0) AS fg3_pct, ftm / nullif(fta, 0) AS ft_pct FROM g JOIN v USING (player_id))"""
_COLUMNS = ["player_id", *_SUMS, *spans.BIO, *spans.LEAST]


@query(f"""WITH {_SPANS_SQL} SELECT {", ".join(n for n in _COLUMNS if n not in ("reb", "ast"))}, round(CAST(reb * 36 / minutes AS DOUBLE), 6) AS reb, round(CAST(ast AS DOUBLE) / games, 6) AS ast, {", ".join(f"round(CAST({n} AS DOUBLE), 6) AS {n}" for n in _MEANS)}
  FROM spans WHERE pts / games >= 20.4 AND fg3a / games <= 1.6 AND age <= 28 AND (reb / games) - (ast / games) >= 0.9""")
def span_report(spark, d):
    """Whole spans: every figure of the span table; bounds and a formula per game, rebounds and assists shown in modes of their own."""
    having = search.SearchSpec(bounds={"pts": (20.4, None), "fg3a": (None, 1.6), "age": (None, 28)}, formulas=[("reb", "-", "ast", ">=", 0.9)], mode="per_game", rated=("pts", "fg3a", "reb", "ast"), sort=("reb", True))
    out = search.span_report(_facts(spark, d), search.SearchSpec(bounds={"pts": (5, None)}), having, {"reb": "per_36", "ast": "per_game"})
    whole = [F.col(n) for n in _COLUMNS if n not in ("reb", "ast")]
    return out.select(*whole, *[F.round(F.col(n).cast("double"), 6).alias(n) for n in ("reb", "ast", *_MEANS)])
