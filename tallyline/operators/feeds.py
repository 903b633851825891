"""Event feeds before reconstruction: one shape for older feeds, event order, score snapshots, per-player shot counts, passes to
the rim, agreement of two feeds, names of players."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .tables import pick_one


def actions_of_legacy(events: DataFrame) -> DataFrame:
    """Older event rows as actions: game_id, event_num, period, clock, action, result, description, team_id (of the second player
    where the first has none), person_id, second_id, score_home and score_away of an 'away - home' text."""
    text = S.first_text(F.col("home_text"), F.col("visitor_text"), F.col("neutral_text"))
    away, home = S.score_pair(F.when(F.col("score").contains(" - "), F.col("score")))
    named = events.withColumns({"_name": S.event_name(F.col("event_type")), "description": text})
    return named.select(
        "game_id", "event_num", "period", S.iso_duration(F.col("clock")).alias("clock"), S.event_action(F.col("_name"), F.col("description")).alias("action"), S.shot_result(F.lit(None).cast("string"), F.col("_name")).alias("result"), "description",
        F.when(F.col("player1_team_id") > 0, F.col("player1_team_id")).otherwise(F.greatest(F.coalesce("player2_team_id", F.lit(0)), F.lit(0))).alias("team_id"),
        F.col("player1_id").alias("person_id"), F.col("player2_id").alias("second_id"), home.alias("score_home"), away.alias("score_away"), "name",
    )


def event_order(elapsed: Column, action: Column, text: Column, order_number: Column, action_number: Column) -> list[Column]:
    """Sort key of a game's events: time, then ends of periods, starts of periods and all else, then their number."""
    low = F.lower(F.coalesce(text, F.lit("")))
    rank = F.when((F.lower(action) == "period") & low.contains("end"), 0).when((F.lower(action) == "period") & low.contains("start"), 1).otherwise(2)
    return [F.coalesce(elapsed, F.lit(0)), rank, F.coalesce(order_number, action_number, F.lit(0))]


def accepted_scores(rows: DataFrame, key: list[str], order: list[str], home: str, away: str) -> DataFrame:
    """Add `accepted`: a score counts only if neither side falls below the last score that counted (feeds hold placeholders).

    The scores of a key (a game's few hundred) are folded in order, as each decision hangs on those before it.
    """
    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("a"), F.array().cast(f"array<struct<{', '.join(f'{o}:{rows.schema[o].dataType.simpleString()}' for o in order)},accepted:boolean>>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        ok = F.coalesce((x["h"] >= state["h"]) & (x["a"] >= state["a"]), F.lit(False))
        mark = F.struct(*[x[o].alias(o) for o in order], ok.alias("accepted"))
        return F.struct(F.when(ok, x["h"]).otherwise(state["h"]).alias("h"), F.when(ok, x["a"]).otherwise(state["a"]).alias("a"), F.concat(state["out"], F.array(mark)).alias("out"))

    own = F.struct(*order, F.col(home).cast("long").alias("h"), F.col(away).cast("long").alias("a"))
    folded = rows.groupBy(*key).agg(F.sort_array(F.collect_list(own)).alias("all")).select(*key, F.explode(F.aggregate("all", start, step)["out"]).alias("m"))
    return rows.join(folded.select(*key, "m.*"), [*key, *order])


def player_threes(actions: DataFrame) -> DataFrame:
    """Per game and player: three-point attempts and makes, and the first name and team in event order that are not empty."""
    first = lambda c, ok: F.min_by(c, F.when(ok, F.col("event_num"))).alias(c)
    rows = actions.where("action = '3pt' and person_id > 0")
    return rows.groupBy("game_id", "person_id").agg(F.count("*").alias("attempts"), F.count_if(F.col("result") == "Made").alias("makes"), first("name", F.col("name") != ""), first("team_id", F.col("team_id") > 0))


def creation_makes(actions: DataFrame) -> DataFrame:
    """Per game and player the made shots by worth and by whether a pass led to them."""
    made = actions.where("result = 'Made' and person_id > 0").withColumns({"_three": S.is_three(F.col("description")), "_passed": S.is_assisted(F.col("description"))})
    count = lambda p, t: F.count_if((F.col("_passed") == p) & (F.col("_three") == t))
    out = made.groupBy("game_id", "person_id").agg(count(True, False).alias("assisted_2pm"), count(False, False).alias("unassisted_2pm"), count(True, True).alias("assisted_3pm"), count(False, True).alias("unassisted_3pm"))
    return out.withColumns({"assisted_fgm": F.col("assisted_2pm") + F.col("assisted_3pm"), "unassisted_fgm": F.col("unassisted_2pm") + F.col("unassisted_3pm")})


def rim_assists(actions: DataFrame, seasons: DataFrame, games: DataFrame) -> DataFrame:
    """Per season and passer the passes that led to makes at the rim, by kind, and per game played.

    `seasons` has game_id and season; `games` season, player_id, season_games. Threes do not count; `strict` are layups and dunks.
    """
    made = actions.where("result = 'Made' and second_id > 0").where(~S.is_three(F.col("description")))
    none = F.lit(None).cast("double")
    rows = made.withColumn("_kind", S.rim_class(F.col("description"), none, none, none)).join(seasons, "game_id")
    kinds = {k: F.count_if(F.col("_kind") == k).alias(f"{k}_assists_created") for k in ("layup", "dunk", "other_rim")}
    out = rows.groupBy("season", F.col("second_id").alias("player_id")).agg(*kinds.values())
    total = F.col("layup_assists_created") + F.col("dunk_assists_created")
    out = out.withColumns({"rim_assists_strict": total, "rim_assists_all": total + F.col("other_rim_assists_created")}).join(games, ["season", "player_id"], "left")
    names = [*[f"{k}_assists_created" for k in kinds], "rim_assists_strict", "rim_assists_all"]
    return out.withColumns({f"{n}_per_game": F.try_divide(F.col(n), F.col("season_games")) for n in names})


def agreement(first: DataFrame, second: DataFrame, keys: list[str], compare: list[str]) -> DataFrame:
    """One row: how many events of the first feed the second has too, by key, and in how many of these each column agrees."""
    other = second.select(*keys, *[F.col(c).alias(f"_{c}") for c in compare], F.lit(True).alias("_there"))
    both = first.join(other, keys, "left")
    return both.agg(F.count("*").alias("wanted"), F.count_if("_there").alias("matched"), *[F.count_if(F.col("_there") & F.col(c).eqNullSafe(F.col(f"_{c}"))).alias(f"same_{c}") for c in compare])


def alias_table(people: DataFrame, by: list[str], player: str, name: str) -> DataFrame:
    """Rows (by..., alias, player_id): every key by which a feed may name the player; for unique_aliases()."""
    return people.select(*by, F.col(player).alias("player_id"), F.explode(S.name_aliases(F.col(name))).alias("alias")).distinct()


def season_universe(rows: DataFrame, season: str, game: str, player: str, name: str) -> DataFrame:
    """Per season and player: the number of the season's games, those of the player, and the last name in order of text."""
    games = rows.select(season, game).distinct().groupBy(season).agg(F.count("*").alias("all_games"))
    own = rows.groupBy(season, player).agg(F.countDistinct(game).alias("games"), F.max(name).alias("name"))
    return own.join(games, season)


def latest_with_value(rows: DataFrame, keys: list[str], measure: str, at: str) -> DataFrame:
    """One row per key: one that has the measure before one that lacks it, then the latest."""
    return pick_one(rows, keys, [F.when(F.col(measure).isNotNull(), 0).otherwise(1), F.col(at).desc_nulls_last()])
