"""Lineup algebra: stints, on/off, combinations, presence, time on court."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def combinations(arr: Column, k: int) -> Column:
    """All sorted k-subsets of a sorted array, as an array of arrays."""
    if k == 1:
        return F.transform(arr, lambda x: F.array(x))
    rest = lambda i: F.slice(arr, i + 2, F.greatest(F.size(arr) - i - 1, F.lit(0)))
    return F.flatten(F.transform(arr, lambda x, i: F.transform(combinations(rest(i), k - 1), lambda y: F.concat(F.array(x), y))))


def by_side(stints: DataFrame) -> DataFrame:
    """Two rows per stint, one per team: team_id, lineup, points for and against, raw and adjusted. One pass over the stints."""

    def side(own: str, other: str) -> Column:
        named = {"team_id": f"{own}_id", "opponent_id": f"{other}_id", "pf": f"{own}_pts", "pa": f"{other}_pts", "pf_adj": f"{own}_pts_adj", "pa_adj": f"{other}_pts_adj"}
        return F.struct(*[F.col(c).alias(n) for n, c in named.items()], F.sort_array(f"{own}_lineup").alias("lineup"))

    return stints.select("game_id", "stint_index", "date", "seconds", F.explode(F.array(side("home", "away"), side("away", "home"))).alias("s")).select("game_id", "stint_index", "date", "seconds", "s.*")


def group_ratings(sides: DataFrame, size: int) -> DataFrame:
    """Per team and group of `size` players: games, stints, seconds, minutes, estimated possessions (seconds / 24) and net
    ratings per 100, raw, adjusted and their difference.

    Stints of one lineup in one game are summed first; groups are then picked from the lineup by fixed places and summed by
    game before the games are counted, so nothing distinct is gathered. Lineups of other sizes than five are allowed.
    """
    net = {"net": F.col("pf") - F.col("pa"), "net_adj": F.col("pf_adj") - F.col("pa_adj")}
    # rounded sums do not hang on the order of rows
    sums = lambda: [F.sum("stints").alias("stints"), *[F.round(F.sum(c), 6).alias(c) for c in ("seconds", "net", "net_adj")]]
    rows = sides.select("team_id", "game_id", "lineup", "seconds", *[e.alias(n) for n, e in net.items()])
    rows = rows.groupBy("team_id", "game_id", "lineup").agg(F.count("*").alias("stints"), *[F.sum(c).alias(c) for c in ("seconds", "net", "net_adj")])
    if size < 5:
        picks = F.array(*[F.array(*[F.get("lineup", F.lit(i)) for i in at]) for at in itertools.combinations(range(5), size)])
        groups = F.when(F.size("lineup") == 5, picks).otherwise(combinations(F.col("lineup"), size))
        rows = rows.withColumn("lineup", F.explode(groups)).groupBy("team_id", "lineup", "game_id").agg(*sums())
    out = rows.groupBy("team_id", "lineup").agg(F.count("*").alias("games"), *sums())
    poss = F.col("seconds") / 24.0
    per = lambda c: F.when(poss > 0, F.col(c) * 100.0 / poss)
    return out.select("team_id", F.array_join("lineup", "-").alias("group_id"), "games", "stints", "seconds", (F.col("seconds") / 60.0).alias("minutes"), poss.alias("poss_est"), per("net").alias("net_rating"), per("net_adj").alias("net_rating_adj"), (per("net_adj") - per("net")).alias("net_rating_delta"))


def on_off(sides: DataFrame) -> DataFrame:
    """Per game, team and player: points for and against and seconds with the player on, and off as the team's rest."""
    team = sides.groupBy("game_id", "team_id").agg(*[F.sum(c).alias(f"team_{c}") for c in ("pf", "pa", "seconds")])
    on = sides.withColumn("player_id", F.explode("lineup")).groupBy("game_id", "team_id", "player_id").agg(*[F.sum(c).alias(f"on_{c}") for c in ("pf", "pa", "seconds")])
    out = on.join(team, ["game_id", "team_id"])
    out = out.withColumns({f"off_{c}": F.col(f"team_{c}") - F.col(f"on_{c}") for c in ("pf", "pa", "seconds")})
    diff = lambda w: F.col(f"{w}_pf") - F.col(f"{w}_pa")
    return out.withColumns({"on_diff": diff("on"), "off_diff": diff("off")}).withColumn("on_off_diff", F.col("on_diff") - F.col("off_diff"))


def time_on_court(sides: DataFrame) -> DataFrame:
    return sides.select("team_id", "seconds", F.explode("lineup").alias("player_id")).groupBy("player_id").agg(F.sum("seconds").alias("seconds"))


def primary_team(sides: DataFrame) -> DataFrame:
    """The team with most time per player; the larger id on ties."""
    per = sides.select("team_id", "seconds", F.explode("lineup").alias("player_id")).groupBy("player_id", "team_id").agg(F.sum("seconds").alias("seconds"))
    return per.groupBy("player_id").agg(F.max_by("team_id", F.struct("seconds", "team_id")).alias("team_id"))


def primary_team_and_time(sides: DataFrame) -> DataFrame:
    """primary_team() and time_on_court() from one pass."""
    per = sides.select("team_id", "seconds", F.explode("lineup").alias("player_id")).groupBy("player_id", "team_id").agg(F.sum("seconds").alias("seconds"))
    return per.groupBy("player_id").agg(F.max_by("team_id", F.struct("seconds", "team_id")).alias("team_id"), F.sum("seconds").alias("seconds"))


def possession_counts(possessions: DataFrame) -> DataFrame:
    """Distinct offensive possessions per game and player."""
    rows = possessions.select("game_id", "poss_index", F.explode("off_lineup").alias("player_id")).where("player_id > 0").distinct()
    return rows.groupBy("game_id", "player_id").agg(F.count("*").alias("possessions"))


def presence_counts(possessions: DataFrame) -> DataFrame:
    """Tri-state: offensive possessions of everyone who is on the floor, 0 for those who only defend."""
    seen = possessions.select("game_id", F.explode(F.concat("off_lineup", "def_lineup")).alias("player_id")).distinct()
    return seen.join(possession_counts(possessions), ["game_id", "player_id"], "left").withColumn("possessions", F.coalesce("possessions", F.lit(0)))


def season_on_off(onoff: DataFrame) -> DataFrame:
    """Season sums with minutes off: a game's team minutes are a fifth of its players' minutes."""
    team = F.sum("minutes_on").over(Window.partitionBy("game_id", "team_id")) / 5
    rows = onoff.withColumn("minutes_off", F.greatest(team - F.col("minutes_on"), F.lit(0.0)))
    return rows.groupBy("season", "team_id", "player_id").agg(F.count("*").alias("games"), *[F.sum(c).alias(c) for c in ("minutes_on", "minutes_off", "on_diff", "off_diff")])


def per_48(season: DataFrame) -> DataFrame:
    on, off = (F.when(F.col(f"minutes_{w}") > 0, F.col(f"{w}_diff") * 48 / F.col(f"minutes_{w}")) for w in ("on", "off"))
    return season.withColumns({"on_per_48": on, "off_per_48": off}).withColumn("on_off_per_48", F.col("on_per_48") - F.col("off_per_48"))


def _features(lineup: str, sign: float, code: int = 0, scale: int = 1) -> Column:
    """A lineup's part of a design row: feature numbers id * scale + code, each with the sign."""
    return F.transform(lineup, lambda x: F.struct((x.cast("long") * scale + code).alias("f"), F.lit(sign).alias("s")))


def margin_design(stints: DataFrame, adjusted: bool = False) -> DataFrame:
    """One design row per stint (game_id, stint_index, fx, y, w): +1 for home players, -1 for away players, y the home margin per
    100 possessions, w the root of the possessions (seconds / 24, .1 at least)."""
    poss, end = F.greatest(F.col("seconds") / 24.0, F.lit(0.1)), "_adj" if adjusted else ""
    y = (F.col(f"home_pts{end}") - F.col(f"away_pts{end}")) / poss * 100
    return stints.select("game_id", "stint_index", F.concat(_features("home_lineup", 1.0), _features("away_lineup", -1.0)).alias("fx"), y.cast("double").alias("y"), F.sqrt(poss).alias("w"))


def design_rows(stints: DataFrame) -> DataFrame:
    """margin_design() in long form: game_id, stint_index, player_id, sign, y, w."""
    return margin_design(stints).select("game_id", "stint_index", F.explode("fx").alias("e"), "y", "w").select("game_id", "stint_index", F.col("e.f").alias("player_id"), F.col("e.s").alias("sign"), "y", "w")


#: Feature numbers of offence and defence designs: twice the player's id, and one more for defence.
OFFENCE, DEFENCE = 0, 1


def offence_defence_design(stints: DataFrame, least_seconds: float = 10.0, adjusted: bool = False) -> DataFrame:
    """Two design rows per stint of `least_seconds` or more (game_id, stint_index, team_id, fx, y, w), one for each team with the
    ball: its lineup's offence with +1, the other's defence with -1; y is its points per 100 possessions."""
    poss, end = F.greatest(F.col("seconds") / 24.0, F.lit(0.1)), "_adj" if adjusted else ""

    def side(own: str, other: str) -> Column:
        both = F.concat(_features(f"{own}_lineup", 1.0, OFFENCE, 2), _features(f"{other}_lineup", -1.0, DEFENCE, 2))
        return F.struct(F.col(f"{own}_id").alias("team_id"), both.alias("fx"), (F.col(f"{own}_pts{end}") / poss * 100).cast("double").alias("y"))

    rows = stints.where(F.col("seconds") >= least_seconds).withColumn("_s", F.explode(F.array(side("home", "away"), side("away", "home"))))
    return rows.select(*[c for c in stints.columns if c in ("season", "window")], "game_id", "stint_index", "_s.team_id", "_s.fx", "_s.y", F.sqrt(poss).alias("w"))


def possession_design(possessions: DataFrame, points: str = "points") -> DataFrame:
    """One design row per possession (game_id, poss_index, fx, y, w) of weight 1: y is its points times 100."""
    both = F.concat(_features("off_lineup", 1.0, OFFENCE, 2), _features("def_lineup", -1.0, DEFENCE, 2))
    return possessions.select(*[c for c in possessions.columns if c in ("season", "window")], "game_id", "poss_index", both.alias("fx"), (F.col(points).cast("double") * 100).alias("y"), F.lit(1.0).alias("w"))


def packed_stints(stints: DataFrame, least_seconds: float = 10.0, adjusted: bool = False) -> tuple[DataFrame, tuple]:
    """The rows of offence_defence_design() two to a stint, players not yet written out: home_lineup, away_lineup, w and the ys of
    either team; and for each of the two its offence, its defence and its ys. `adjusted` adds adjusted points as a second y."""
    poss, ends = F.greatest(F.col("seconds") / 24.0, F.lit(0.1)), ("", "_adj") if adjusted else ("",)
    ys = [(F.col(f"{own}_pts{end}") / poss * 100).cast("double").alias(f"{own}_y{end}") for own in ("home", "away") for end in ends]
    rows = stints.where(F.col("seconds") >= least_seconds).select(*[c for c in stints.columns if c in ("season", "window")], "home_lineup", "away_lineup", F.sqrt(poss).alias("w"), *ys)
    return rows, tuple((f"{own}_lineup", f"{other}_lineup", tuple(f"{own}_y{end}" for end in ends)) for own, other in (("home", "away"), ("away", "home")))


def packed_possessions(possessions: DataFrame, points: str = "points") -> tuple[DataFrame, tuple]:
    """The rows of possession_design(), players not yet written out, and their one side."""
    rows = possessions.select(*[c for c in possessions.columns if c in ("season", "window")], "off_lineup", "def_lineup", F.lit(1.0).alias("w"), (F.col(points).cast("double") * 100).alias("y"))
    return rows, (("off_lineup", "def_lineup", ("y",)),)


def long_design(rows: DataFrame, keys: list[str]) -> DataFrame:
    """An offence and defence design in long form: keys, feature ('O:id' or 'D:id'), sign, y, w."""
    name = F.concat(F.when(F.col("e.f") % 2 == 0, "O:").otherwise("D:"), F.floor(F.col("e.f") / 2).cast("string"))
    return rows.select(*keys, F.explode("fx").alias("e"), "y", "w").select(*keys, name.alias("feature"), F.col("e.s").alias("sign"), "y", "w")
