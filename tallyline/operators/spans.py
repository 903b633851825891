"""Spans: all games of a player that a search selects, as one row of sums, shares and season figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

# The figures of a span.
#: Counts, summed over games; a missing one is 0.
COUNTS = (
    "pts", "reb", "oreb", "dreb", "ast", "stl", "blk", "tov", "fgm", "fga", "fg2m", "fg2a", "fg3m", "fg3a", "ftm", "fta",
    "assisted_2pm", "unassisted_2pm", "assisted_3pm", "unassisted_3pm", "assisted_fgm", "unassisted_fgm",
)
MARGINS = ("plus_minus_actual", "plus_minus_adjusted")
#: Averages over games, each game with the weight of its minutes.
WEIGHTED = ("on_off_actual", "on_off_adjusted")
#: Bio: the first known value; LEAST: the least one.
BIO = ("player_name", "listed_height", "height_inches", "draft_year", "draft_overall_pick")
LEAST = ("age", "career_year")
#: Season figures: plain means over seasons, of the season's first row.
SEASON_MEANS = ("rim_anchor_signature", "rim_deterrence_signature", "rim_dfg_pct", "rim_dfg_pct_diff")
#: Season figures per game, times the games selected.
PER_GAME = ("contested_shots", "contested_shots_2pt", "contested_shots_3pt", "deflections", "charges_drawn", "screen_assists", "screen_ast_pts", "loose_balls_recovered", "box_outs")
#: The same under another name in the facts (with `_per_game`), counted only where the season's games are known.
ASSISTS = ("layup_assists_created", "dunk_assists_created", "other_rim_assists_created", "rim_assists_strict", "rim_assists_all")


def span_table(facts: DataFrame) -> DataFrame:
    """One row per player of `facts` (player_id, game_id, date, season, minutes and any of the figures above; absent ones are null).

    Two aggregations with partial sums, by (player, season) and then by player, so a player with many games is summed where
    the games lie. Season figures are those of the season's first row by (date, game_id): for PER_GAME and ASSISTS the first
    one that has any of them. `rim_dfga` is a season total, taken by the share of `rim_tracking_games` that is selected. A
    null season takes part in sums but gives no season figures; ties in (date, game_id) give any of the tied rows.
    """
    c = lambda n: F.col(n) if n in facts.columns else F.lit(None).cast("double")
    known = lambda n: c(n).isNotNull() & (c(n).cast("string") != "")
    when = F.struct("date", "game_id")
    weight = F.coalesce(c("minutes"), F.lit(0))

    def first_row(names: tuple[str, ...], need: Column) -> Column:
        return F.min_by(F.struct(*[c(n).cast("double").alias(n) for n in names]), F.when(need, when))

    per_assist = tuple(f"{n}_per_game" for n in ASSISTS)
    rim, any_of = (*SEASON_MEANS, "rim_dfga", "rim_tracking_games"), lambda names: F.coalesce(*[c(n).cast("double") for n in names]).isNotNull()
    total = lambda n: F.sum(F.coalesce(c(n), F.lit(0))).alias(n)
    seasons = facts.groupBy("player_id", "season").agg(
        F.count("*").alias("games"), F.sum(weight).alias("minutes"), total("possessions"), *[total(n) for n in (*COUNTS, *MARGINS)],
        *[F.sum(F.coalesce(c(n), F.lit(0)) * weight).alias(n) for n in WEIGHTED], *[F.min(c(n)).alias(n) for n in LEAST],
        *[F.min(F.when(known(n), F.struct("date", "game_id", c(n).alias("v")))).alias(n) for n in BIO],
        first_row(rim, F.col("season").isNotNull()).alias("_rim"), first_row(PER_GAME, F.col("season").isNotNull() & any_of(PER_GAME)).alias("_per"),
        first_row(("rim_assists_season_games", *per_assist), F.col("season").isNotNull() & any_of(per_assist)).alias("_assist"),
    )
    f = F.col
    out = seasons.groupBy("player_id").agg(
        *[F.sum(n).alias(n) for n in ("games", "minutes", "possessions", *COUNTS, *MARGINS)], *[F.min(n).alias(n) for n in LEAST], *[F.min(n)["v"].alias(n) for n in BIO],
        *[F.sum(n).alias(n) for n in WEIGHTED], F.count("_rim").alias("_seasons"), *[F.sum(F.coalesce(f("_rim")[n], F.lit(0))).alias(n) for n in SEASON_MEANS],
        F.sum(F.when(f("_rim")["rim_tracking_games"] > 0, F.coalesce(f("_rim")["rim_dfga"], F.lit(0)) * f("games") / f("_rim")["rim_tracking_games"])).alias("rim_dfga"),
        *[F.sum(f("_per")[n] * f("games")).alias(n) for n in PER_GAME],
        *[F.sum(F.when(f("_assist")["rim_assists_season_games"] > 0, f("_assist")[p] * f("games"))).alias(n) for n, p in zip(ASSISTS, per_assist, strict=True)],
    )
    out = out.withColumns({n: S.ratio(f(n), f("minutes")) for n in WEIGHTED} | {n: S.ratio(f(n), f("_seasons")) for n in SEASON_MEANS})
    out = out.withColumn("rim_dfga", F.when(f("_seasons") > 0, F.coalesce("rim_dfga", F.lit(0.0)))).drop("_seasons")
    return out.withColumns({"ts_game": S.true_shooting(f("pts"), f("fga"), f("fta")), "fg2_pct": S.ratio(f("fg2m"), f("fg2a")), "fg3_pct": S.ratio(f("fg3m"), f("fg3a")), "ft_pct": S.ratio(f("ftm"), f("fta"))})
