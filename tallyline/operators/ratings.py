"""On/off ratings: per possession with the rest of the team as complement, per 48 minutes where possessions are missing, daily
boxes, and shot-by-shot trails of a player's time on and off the floor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def possession_ratings(possessions: DataFrame) -> DataFrame:
    """Per team and player, on and off the floor: offensive and defensive possessions, points for and against, and ratings per
    100; off the floor is the team less the player. Columns offense_team, defense_team, off_lineup, def_lineup, points.

    Without possessions off the floor on both ends, the off ratings are the team's and off_poss is 0.
    """
    side = lambda team, lineup, code: F.struct(F.col(team).alias("team_id"), F.col(lineup).alias("lineup"), F.lit(code).alias("attacks"))
    rows = possessions.select("points", F.explode(F.array(side("offense_team", "off_lineup", True), side("defense_team", "def_lineup", False))).alias("s")).select("points", "s.*")
    mine = lambda p: {f"{p}off_poss": F.count_if("attacks"), f"{p}def_poss": F.count_if(~F.col("attacks")), f"{p}pts": F.sum(F.when(F.col("attacks"), F.col("points")).otherwise(0)), f"{p}opp_pts": F.sum(F.when(~F.col("attacks"), F.col("points")).otherwise(0))}
    team = rows.groupBy("team_id").agg(*[e.alias(n) for n, e in mine("team_").items()])
    on = rows.withColumn("player_id", F.explode("lineup")).groupBy("team_id", "player_id").agg(*[e.alias(n) for n, e in mine("on_").items()])
    out = on.join(team, "team_id").where("on_off_poss > 0 and on_def_poss > 0")
    out = out.withColumns({f"off_{c}": F.col(f"team_{c}") - F.col(f"on_{c}") for c in ("off_poss", "def_poss", "pts", "opp_pts")})
    per = lambda p: {f"{p}_ortg": F.try_divide(F.col(f"{p}_pts") * 100.0, F.col(f"{p}_off_poss")), f"{p}_drtg": F.try_divide(F.col(f"{p}_opp_pts") * 100.0, F.col(f"{p}_def_poss"))}
    out = out.withColumns(per("on") | per("team") | per("off"))
    alone = (F.col("off_off_poss") <= 0) | (F.col("off_def_poss") <= 0)
    out = out.withColumns({c: F.when(alone, F.col(c.replace("off_", "team_", 1))).otherwise(F.col(c)) for c in ("off_ortg", "off_drtg")})
    net = lambda p: F.col(f"{p}_ortg") - F.col(f"{p}_drtg")
    return out.withColumns({"on_net": net("on"), "off_net": net("off"), "on_off_net": net("on") - net("off"), "on_poss": (F.col("on_off_poss") + F.col("on_def_poss")) / 2.0, "off_poss": F.when(alone, 0.0).otherwise((F.col("off_off_poss") + F.col("off_def_poss")) / 2.0)})


def finished_ratings(rows: DataFrame, possession: DataFrame | None = None) -> DataFrame:
    """Season rows (team_id, player_id, minutes_on, minutes_off, {on,off}_diff, {on,off}_diff_adj, {on,off}_for_adj,
    {on,off}_against_adj) with ratings per 100.

    Actual ones come from `possession` (possession_ratings()) where it has the player, else per 48 minutes; adjusted ones
    use its possessions, else minutes. The parts for offence and defence always take 100 possessions for 48 minutes, so
    that a player's teams stay apart. Ratings without time are 0.
    """
    known = ["on_net", "on_off_net", "on_poss", "off_poss"]
    if possession is None:
        out = rows.withColumns({c: F.lit(None).cast("double") for c in known})
    else:
        out = rows.join(possession.select("team_id", "player_id", *known), ["team_id", "player_id"], "left")
    zero, c = F.lit(0.0), F.col
    by_time = lambda value, w: F.coalesce(F.when(c(f"minutes_{w}") > 0, value * 48.0 / c(f"minutes_{w}")), zero)

    def both(on: Column, off: Column, there: Column) -> Column:
        """On less off; 0 where there is no time off the floor."""
        return F.when(there, on - off).otherwise(zero)

    off_time = c("minutes_off") > 0
    actual = F.coalesce("on_net", by_time(c("on_diff"), "on"))
    actual_both = F.coalesce("on_off_net", both(actual, by_time(c("off_diff"), "off"), off_time))
    adjusted = F.when(c("on_poss") > 0, c("on_diff_adj") * 100.0 / c("on_poss")).otherwise(by_time(c("on_diff_adj"), "on"))
    adjusted_off = F.when(c("off_poss") > 0, c("off_diff_adj") * 100.0 / c("off_poss")).otherwise(by_time(c("off_diff_adj"), "off"))
    out = out.withColumns({"source": F.when(c("on_net").isNull(), "minutes").otherwise("possessions"), "net": actual, "net_adj": adjusted, "on_off": actual_both, "on_off_adj": both(adjusted, adjusted_off, (c("off_poss") > 0) | off_time)})
    out = out.withColumns({f"{w}_{n}_adj": by_time(c(f"{w}_{p}_adj"), w) for w in ("on", "off") for n, p in (("ortg", "for"), ("drtg", "against"))})
    return out.withColumns({"net_delta": c("net_adj") - c("net"), "on_off_delta": c("on_off_adj") - c("on_off"), "on_off_offence": c("on_ortg_adj") - c("off_ortg_adj"), "on_off_defence": c("off_drtg_adj") - c("on_drtg_adj")}).drop(*known)


def season_totals(sides: DataFrame) -> DataFrame:
    """Season rows for finished_ratings(): per team and player, over the team's games that the player was in."""
    values = ("pf", "pa", "pf_adj", "pa_adj", "seconds")
    team = sides.groupBy("game_id", "team_id").agg(*[F.sum(v).alias(f"team_{v}") for v in values])
    on = sides.withColumn("player_id", F.explode("lineup")).groupBy("game_id", "team_id", "player_id").agg(*[F.sum(v).alias(v) for v in values])
    out = on.join(team, ["game_id", "team_id"]).groupBy("team_id", "player_id").agg(F.count("*").alias("games"), *[F.sum(v).alias(f"on_{v}") for v in values], *[F.sum(F.col(f"team_{v}") - F.col(v)).alias(f"off_{v}") for v in values])
    c = F.col
    named = {"minutes_on": c("on_seconds") / 60.0, "minutes_off": c("off_seconds") / 60.0}
    for w in ("on", "off"):
        # rounded sums do not hang on the order of rows
        named |= {f"{w}_diff": c(f"{w}_pf") - c(f"{w}_pa"), f"{w}_diff_adj": F.round(c(f"{w}_pf_adj") - c(f"{w}_pa_adj"), 6), f"{w}_for_adj": F.round(c(f"{w}_pf_adj"), 6), f"{w}_against_adj": F.round(c(f"{w}_pa_adj"), 6)}
    return out.select("team_id", "player_id", "games", *[e.alias(n) for n, e in named.items()])


def daily_box(on_off: DataFrame) -> DataFrame:
    """Per game and player: plus-minus and on/off, actual, adjusted and their difference, rounded to three places."""
    diff = lambda w, end: F.col(f"{w}_pf{end}") - F.col(f"{w}_pa{end}")
    pairs = {"plus_minus": (diff("on", ""), diff("on", "_adj")), "on_off": (diff("on", "") - diff("off", ""), diff("on", "_adj") - diff("off", "_adj"))}
    out = on_off.select("date", "game_id", "team_id", "player_id", F.round(F.col("on_seconds") / 60.0, 3).alias("minutes_on"), *[F.round(e, 3).alias(f"{n}_{k}") for n, (a, b) in pairs.items() for k, e in (("actual", a), ("adjusted", b), ("delta", b - a))])
    return out


def box_of_day(box: DataFrame, games: DataFrame, day: Column, least_minutes: float = 0.0) -> DataFrame:
    """The daily boxes of one date with the games' scores; `place` orders a team's players by minutes."""
    rows = box.where((F.col("date") == day) & (F.col("minutes_on") >= least_minutes)).join(games, "game_id")
    order = Window.partitionBy("game_id", "team_id").orderBy(F.col("minutes_on").desc(), "player_id")
    return rows.withColumn("place", F.row_number().over(order).cast("long"))


def games_by_date(games: DataFrame) -> DataFrame:
    """One row per date: its games (game_id, margin, margin_adj, flipped) as one list in order of id, and how many were flipped."""
    rows = games.groupBy("date").agg(F.sort_array(F.collect_list(F.struct("game_id", "margin", "margin_adj", "flipped"))).alias("games"))
    return rows.withColumns({"n_games": F.size("games").cast("long"), "n_flipped": F.size(F.filter("games", lambda g: g["flipped"])).cast("long")})


def shot_trail(shots: DataFrame, intervals: DataFrame, member: str = "player_id") -> DataFrame:
    """Every shot of a game held against every player of it: whether the player was on the floor, the shot's expectation and luck
    (made - expected) * (3 - .25), for (+1) or against (-1) the player's team, and whether the player has changed between
    floor and bench since the shot before.

    `shots` has game_id, action_number, elapsed, team_id, made, expected; `intervals` game_id, team_id, player_id, start, end.
    Rows are one game's shots times its some twenty players.
    """
    people = intervals.groupBy("game_id", "team_id", member).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    rows = shots.join(people.withColumnRenamed("team_id", "own_team"), "game_id")
    on = F.exists("spans", lambda s: (F.col("elapsed") > s["start"]) & (F.col("elapsed") <= s["end"]))
    luck = (F.col("made").cast("double") - F.col("expected")) * (3 - 0.25)
    rows = rows.withColumns({"on": on, "luck": luck * F.when(F.col("team_id") == F.col("own_team"), 1).otherwise(-1)})
    w = Window.partitionBy("game_id", "own_team", member).orderBy("elapsed", "action_number")
    return rows.withColumn("changed", F.coalesce(F.lag("on").over(w) != F.col("on"), F.lit(False))).drop("spans")


def luck_split(trail: DataFrame, member: str = "player_id") -> DataFrame:
    """Per game and player of a shot_trail(): shots and luck on and off the floor, and changes."""
    part = lambda on: F.col("on") if on else ~F.col("on")
    cols = [F.count_if(part(x)).alias(f"{n}_shots") for n, x in (("on", True), ("off", False))] + [F.round(F.sum(F.when(part(x), F.col("luck")).otherwise(0.0)), 6).alias(f"{n}_luck") for n, x in (("on", True), ("off", False))]
    return trail.groupBy("game_id", F.col("own_team").alias("team_id"), member).agg(*cols, F.count_if("changed").alias("changes"))
