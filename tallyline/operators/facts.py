"""Fact tables and roll-ups: player-game and lineup-stint facts, ledgers, histories, leaderboards, luck tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .tables import pick_one, priority_union

_BOX = ("pts", "reb", "ast", "stl", "blk", "fga", "fgm", "fta")


def player_game_facts(sources: list[DataFrame], games: DataFrame, possessions: DataFrame, people: DataFrame) -> DataFrame:
    """One row per (game_id, player_id) of the best source that has it, with each box column from the best source that has a value.

    `games` has game_id, date, home_id, away_id, home_pts, away_pts; `possessions` game_id, player_id, possessions; `people`
    player_id, birth, from_year. Players without minutes or points are left out. All joins are equi joins on keys of the
    right side, so rows never multiply; sizes are left to adaptive execution.
    """
    rows = priority_union(sources).where("player_id > 0")
    best = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("source_priority")))
    box = rows.groupBy("game_id", "player_id").agg(F.min_by("team_id", "source_priority").alias("team_id"), F.min("source_priority").alias("source"), *[best(c).alias(c) for c in ("minutes", *_BOX)])
    box = box.where("minutes > 0 and pts is not null")
    out = box.join(games, "game_id", "left").join(possessions, ["game_id", "player_id"], "left").join(people, "player_id", "left")
    home = F.col("team_id") == F.col("home_id")
    own, other = F.when(home, F.col("home_pts")).otherwise(F.col("away_pts")), F.when(home, F.col("away_pts")).otherwise(F.col("home_pts"))
    stats = [F.col(c) for c in ("pts", "reb", "ast", "stl", "blk")]
    season = F.year("date") - F.when(F.month("date") >= 10, 0).otherwise(1)
    return out.withColumns({
        "season": S.season_label(F.col("date")), "opponent_id": F.when(home, F.col("away_id")).otherwise(F.col("home_id")), "win_loss": F.when(own > other, "W").when(own < other, "L"),
        "age": S.age_at(F.col("birth"), F.col("date")), "career_year": S.career_year(season, F.col("from_year")), "fg_pct": S.ratio(F.col("fgm"), F.col("fga")), "ts_pct": S.true_shooting(F.col("pts"), F.col("fga"), F.col("fta")),
        "double_double": S.many_doubles(stats, 2), "triple_double": S.many_doubles(stats, 3),
    })


def lineup_stint_facts(sources: list[DataFrame], rollover_month: int = 10) -> DataFrame:
    """Stints of several sources, the first source winning per (game_id, stint_index), with season, order-insensitive lineup ids and margins."""
    rows = pick_one(priority_union(sources), ["game_id", "stint_index"], [F.col("source_priority")])
    return rows.withColumns({"season": S.season_label(F.col("date"), rollover_month), "home_group": S.id_set(F.col("home_lineup")), "away_group": S.id_set(F.col("away_lineup")), "margin": F.col("home_pts") - F.col("away_pts"), "margin_adj": F.col("home_pts_adj") - F.col("away_pts_adj")})


def adjusted_games(teams: DataFrame) -> DataFrame:
    """Two team rows per game (team_id, is_home, pts, pts_adj) as one row with margins; a zero margin counts as an away win. The
    adjusted margin is rounded to six places, so that its sign does not hang on the order of sums."""
    side = lambda flag, c: F.max(F.when(F.col("is_home") == F.lit(flag), F.col(c)))
    out = teams.groupBy("game_id").agg(*[side(flag, c).alias(f"{n}_{c}") for flag, n in ((True, "home"), (False, "away")) for c in ("team_id", "pts", "pts_adj")])
    out = out.withColumns({"margin": F.col("home_pts") - F.col("away_pts"), "margin_adj": F.round(F.col("home_pts_adj") - F.col("away_pts_adj"), 6)})
    return out.withColumn("flipped", (F.col("margin") > 0) != (F.col("margin_adj") > 0))


def luck_table(games: DataFrame) -> DataFrame:
    """Per team: actual and adjusted records and margins, and their difference, best luck first by `rank`."""
    home = games.select(F.col("home_team_id").alias("team_id"), "margin", "margin_adj", (F.col("margin") > 0).alias("won"), (F.col("margin_adj") > 0).alias("won_adj"))
    away = games.select(F.col("away_team_id").alias("team_id"), -F.col("margin"), -F.col("margin_adj"), F.col("margin") <= 0, F.col("margin_adj") <= 0)
    out = home.union(away).groupBy("team_id").agg(F.count("*").alias("games"), F.count_if("won").alias("wins"), F.count_if("won_adj").alias("wins_adj"), F.sum("margin").alias("margin"), F.sum("margin_adj").alias("margin_adj"))
    out = out.withColumn("luck", F.col("margin") - F.col("margin_adj"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.col("luck").desc(), "team_id")).cast("long"))  # one row per team


def player_history(facts: DataFrame, measures: list[str]) -> DataFrame:
    """Per player: distinct games, sums and means of the measures, first and last date, team of the last game."""
    return facts.groupBy("player_id").agg(F.countDistinct("game_id").alias("games"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.max_by("team_id", F.struct("date", "game_id")).alias("team_id"), *[F.sum(m).alias(f"{m}_sum") for m in measures], *[F.avg(m).alias(f"{m}_mean") for m in measures])


def group_leaderboard(seasons: DataFrame, rates: list[str], weight: str = "minutes", least_games: int = 0, least_minutes: float = 0.0) -> DataFrame:
    """Per player over several seasons: weighted means of rates (nulls carry no weight), games, minutes and the sorted set of teams."""
    w = F.col(weight)
    mean = lambda c: F.try_divide(F.sum(F.col(c) * w), F.sum(F.when(F.col(c).isNotNull(), w)))
    out = seasons.groupBy("player_id").agg(F.sum("games").alias("games"), F.sum(weight).alias(weight), F.array_join(F.sort_array(F.collect_set("team_id")), "/").alias("teams"), *[mean(c).alias(c) for c in rates])
    return out.where((F.col("games") >= least_games) & (F.col(weight) >= least_minutes))


def period_leaderboard(seasons: DataFrame, periods: DataFrame, least_games: int = 1, least_minutes: float = 0.0) -> DataFrame:
    """Sums over the seasons of each period (table period, season; small), then differences per 48 minutes."""
    rows = seasons.join(periods, "season")
    out = rows.groupBy("period", "player_id").agg(*[F.sum(c).alias(c) for c in ("games", "minutes_on", "minutes_off", "on_diff", "off_diff")])
    out = out.where((F.col("games") >= least_games) & (F.col("minutes_on") >= least_minutes))
    per = {f"{x}_per_48": F.when(F.col(f"minutes_{x}") > 0, F.col(f"{x}_diff") * 48 / F.col(f"minutes_{x}")) for x in ("on", "off")}
    return out.withColumns(per).withColumn("on_off_per_48", F.col("on_per_48") - F.col("off_per_48"))


def eligibility(facts: DataFrame, need: int, season_games: int, low: float = 15.0, full: float = 20.0, near_cap: int = 2, bonus: DataFrame | None = None, remaining: DataFrame | None = None) -> DataFrame:
    """Games that count for awards: those of `full` minutes or more, and at most `near_cap` of `low` to `full` minutes; and
    whether the player has reached `need`, still can, or cannot in a season of `season_games`.

    `bonus` (player_id, games) counts besides, for games that no box holds. `remaining` (player_id, games) says what is left to
    play; players with none or 0 there get the mean of those above 0, in place of the season's games less those played.
    """
    near = F.count_if((F.col("minutes") >= low) & (F.col("minutes") < full))
    out = facts.groupBy("player_id").agg(F.count("*").alias("games"), (F.count_if(F.col("minutes") >= full) + F.least(near, F.lit(near_cap))).alias("counted"))
    if bonus is not None:
        more = bonus.groupBy("player_id").agg(F.sum("games").alias("_more"))
        out = out.join(more, "player_id", "left").withColumn("counted", F.col("counted") + F.coalesce("_more", F.lit(0))).drop("_more")
    left = F.greatest(F.lit(season_games) - F.col("games"), F.lit(0))
    if remaining is not None:
        mean = remaining.where("games > 0").agg(F.avg("games").alias("_mean"))
        own = remaining.groupBy("player_id").agg(F.max("games").alias("_left"))
        out = out.join(own, "player_id", "left").join(F.broadcast(mean))  # a single row
        left = F.when(F.col("_left") > 0, F.col("_left")).otherwise(F.coalesce("_mean", F.lit(0.0)))
    out = out.withColumn("status", F.when(F.col("counted") >= need, "CLINCHED").when(F.col("counted") + left < need, "ELIMINATED").otherwise("BUBBLE"))
    return out.drop("_left", "_mean")


def win_ledger(facts: DataFrame) -> DataFrame:
    """Per player-game: played (minutes > 0) and won, by the sums of the players' points of each team in the game."""
    team = facts.groupBy("game_id", "team_id").agg(F.sum("pts").alias("team_pts"))
    best = team.withColumn("won", (F.col("team_pts") == F.max("team_pts").over(Window.partitionBy("game_id"))) & (F.count("*").over(Window.partitionBy("game_id", "team_pts")) == 1)).select("game_id", "team_id", "team_pts", "won")
    return facts.select("game_id", "player_id", "team_id", (F.col("minutes") > 0).alias("played")).join(best, ["game_id", "team_id"])


def conform_box(df: DataFrame, mapping: dict[str, Column | str]) -> DataFrame:
    """A source's columns under the target names: a name, or an expression over the source's columns."""
    return df.select(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in mapping.items()])


def repair_names(df: DataFrame, names: DataFrame, key: str, name: str) -> DataFrame:
    """Overwrite `name` by the table (key, name) where it has one, and flag the rows that changed."""
    fixed = names.select(key, F.col(name).alias("_fixed"))
    out = df.join(fixed, key, "left").withColumn("changed", F.col("_fixed").isNotNull() & ~F.col("_fixed").eqNullSafe(F.col(name)))
    return out.withColumn(name, F.coalesce("_fixed", name)).drop("_fixed")


def identity_spans(rows: DataFrame, name: str, player: str, team: str, at: str, max_gap: int = 2) -> DataFrame:
    """Names with several ids, in order of first season: OVERLAP if spans overlap, CONTINUITY if the gap is at most `max_gap`
    and a team is shared, else SAME_NAME; one row per neighbouring pair of ids."""
    span = rows.groupBy(name, player).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.collect_set(team).alias("teams"))
    w = Window.partitionBy(name).orderBy("first", player)
    pair = span.withColumns({"next_id": F.lead(player).over(w), "_f": F.lead("first").over(w), "_t": F.lead("teams").over(w)}).where("next_id is not null")
    shared = F.arrays_overlap("teams", "_t")
    status = F.when(F.col("last") >= F.col("_f"), "OVERLAP").when((F.col("_f") - F.col("last") <= max_gap) & shared, "CONTINUITY").otherwise("SAME_NAME")
    return pair.select(name, F.col(player).alias("id"), "next_id", status.alias("status"))


def missing_causes(facts: DataFrame, possessions: DataFrame, stints: DataFrame) -> DataFrame:
    """Player-games without possessions by cause: the whole game has none, the player is in no stint, or in stints only."""
    games = possessions.select("game_id").distinct().withColumn("_g", F.lit(True))
    seen = stints.select("game_id", F.explode("lineup").alias("player_id")).distinct().withColumn("_s", F.lit(True))
    counted = possessions.select("game_id", F.explode("off_lineup").alias("player_id")).distinct()
    rows = facts.join(counted, ["game_id", "player_id"], "left_anti").join(games, "game_id", "left").join(seen, ["game_id", "player_id"], "left")
    return rows.withColumn("cause", F.when(F.col("_g").isNull(), "game_missing").when(F.col("_s").isNull(), "not_in_stints").otherwise("no_offence")).drop("_g", "_s")


def unreversed(df: DataFrame, key: list[str], order: list[Column], value: str) -> DataFrame:
    """Running totals that count down are turned round: where the first exceeds the last, value = max - value."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    down = F.first(value, ignorenulls=True).over(w) > F.last(value, ignorenulls=True).over(w)
    return df.withColumn(value, F.when(down, F.max(value).over(w) - F.col(value)).otherwise(F.col(value)))


def game_meta(rows: DataFrame) -> DataFrame:
    """Per game with both sides, from player rows (game_id, date, team, matchup, pts): the last date, home and away team by the
    matchup text, and their points."""
    home, away = S.matchup_sides(F.col("matchup"))
    sided = rows.withColumns({"_home": home, "_away": away})
    points = lambda side: F.sum(F.when(F.col("team") == F.col(side), F.col("pts"))).alias(f"{side[1:]}_pts")
    out = sided.groupBy("game_id").agg(F.max("date").alias("date"), F.max("_home").alias("home"), F.max("_away").alias("away"), points("_home"), points("_away"))
    return out.where("home_pts is not null and away_pts is not null")


def game_meta_of_stints(stints: DataFrame) -> DataFrame:
    """Per game the date, both teams and the final score, which is the largest score at the end of a stint."""
    top = {"date": "date", "home_id": "home_id", "away_id": "away_id", "home_pts": "end_home_score", "away_pts": "end_away_score"}
    return stints.groupBy("game_id").agg(*[F.max(c).alias(n) for n, c in top.items()])


def with_team_names(games: DataFrame, teams: DataFrame) -> DataFrame:
    """Add home_abbr and away_abbr from the dimension (team_id, abbr), some thirty rows, used twice; Spark broadcasts it by its size."""
    for side in ("home", "away"):
        games = games.join(teams.select(F.col("team_id").alias(f"{side}_id"), F.col("abbr").alias(f"{side}_abbr")), f"{side}_id")
    return games


def with_season_figures(rows: DataFrame, figures: DataFrame, keys: dict[str, str], season_type: str) -> DataFrame:
    """Left join of a season's figures (season, keys, season_type) to game rows; other kinds of season are dropped before the join."""
    chosen = figures.where(F.col("season_type") == season_type).drop("season_type").withColumnsRenamed({v: k for k, v in keys.items()})
    return rows.join(chosen, ["season", *keys], "left")


def playoff_facts(stints: DataFrame, boxes: list[DataFrame], possessions: DataFrame, teams: DataFrame, people: DataFrame) -> DataFrame:
    """player_game_facts() of a play-off season: games and scores come from the stints, box rows from the sources in order, and both
    teams' names from the dimension."""
    out = player_game_facts(boxes, game_meta_of_stints(stints), possessions, people)
    return with_team_names(out, teams)
