"""Games from their event feeds, by joins and windows within a game: moves, on-court intervals, stints, possessions,
starters and period openings.

Every operator shuffles by game (or game and team) and keeps at most one game's rows of a key together: tens to hundreds.
A time on a boundary belongs to the interval that ends there, so points scored at the clock of a substitution count for the
lineup that was on the floor before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..lineage import dealt
from .sequences import on_court_intervals, sessions

_PLAYER = ["game_id", "team_id", "player_id"]
#: Kinds of events that end a possession; with steals also in feeds that record them apart from turnovers.
ENDS = ("made", "defensive_rebound", "turnover", "free_throw")


def moves(starters: DataFrame, subs: DataFrame) -> DataFrame:
    """Moves (game_id, team_id, player_id, at, sign): +1 at 0 for starters, -1 and +1 for each substitution (columns elapsed,
    player_id who leaves, in_id). Moves of one player at one time are netted, so neutral pairs vanish; a null id moves nobody."""
    pair = F.array(F.struct(F.col("player_id").alias("p"), F.lit(-1).alias("sign")), F.struct(F.col("in_id").alias("p"), F.lit(1).alias("sign")))
    swapped = subs.select("game_id", "team_id", F.col("elapsed").alias("at"), F.explode(pair).alias("m")).select("game_id", "team_id", F.col("m.p").alias("player_id"), "at", "m.sign")
    opening = starters.select(*_PLAYER, F.lit(0).cast("long").alias("at"), F.lit(1).alias("sign"))
    both = opening.unionByName(swapped).where("player_id is not null")
    return both.groupBy(*_PLAYER, "at").agg(F.sum("sign").alias("sign")).where("sign <> 0")


def repaired(moved: DataFrame) -> DataFrame:
    """Moves that alternate: repeated entries and exits are dropped, and a player whose first move is an exit enters at 0."""
    w = Window.partitionBy(*_PLAYER).orderBy("at")
    rows = moved.withColumn("sign", F.signum("sign").cast("int")).withColumn("_before", F.lag("sign").over(w))
    kept = rows.where(F.col("_before").isNull() | (F.col("_before") != F.col("sign")))
    own, entry = F.struct(F.col("at").cast("long").alias("at"), "sign"), F.struct(F.lit(0).cast("long").alias("at"), F.lit(1).alias("sign"))
    both = F.when(F.col("_before").isNull() & (F.col("sign") < 0), F.array(entry, own)).otherwise(F.array(own))
    return kept.select(*_PLAYER, F.explode(both).alias("m")).select(*_PLAYER, "m.at", "m.sign")


def rotations(starters: DataFrame, subs: DataFrame, ends: DataFrame) -> DataFrame:
    """On-court intervals (game_id, team_id, player_id, start, end) up to the game's game_seconds (table `ends`)."""
    rows = repaired(moves(starters, subs)).join(ends.select("game_id", "game_seconds"), "game_id")
    return on_court_intervals(rows, _PLAYER, "at", "sign", "game_seconds")


def stint_sides(intervals: DataFrame, ends: DataFrame, period_seconds: int = 720) -> DataFrame:
    """Two rows per stint (game_id, start, end, team_id, lineup): segments between any two neighbouring times at which an
    interval or a period starts or ends, where both teams have five players; other segments give no rows."""
    periods = ends.select("game_id", F.sequence(F.lit(0).cast("long"), F.col("game_seconds").cast("long"), F.lit(period_seconds).cast("long")).alias("_p"))
    # a game's times are some dozens
    marks = intervals.groupBy("game_id").agg(F.array_union(F.collect_set(F.col("start").cast("long")), F.collect_set(F.col("end").cast("long"))).alias("_m")).join(periods, "game_id", "left")
    marks = marks.select("game_id", F.array_sort(F.array_union("_m", F.coalesce("_p", F.array().cast("array<long>")))).alias("_m"))
    segments = marks.select("game_id", F.explode(F.arrays_zip(F.slice("_m", 1, F.size("_m") - 1).alias("start"), F.slice("_m", 2, F.size("_m") - 1).alias("end"))).alias("_s")).select("game_id", "_s.start", "_s.end")
    on = intervals.select("game_id", "team_id", "player_id", F.col("start").alias("_s"), F.col("end").alias("_e"))
    seen = segments.join(on, "game_id").where((F.col("end") > F.col("_s")) & (F.col("end") <= F.col("_e")))
    sides = seen.groupBy("game_id", "start", "end", "team_id").agg(F.sort_array(F.collect_set("player_id")).alias("lineup"))
    both = F.count_if(F.size("lineup") == 5).over(Window.partitionBy("game_id", "start", "end"))
    return sides.withColumn("_full", both).where("_full = 2 and size(lineup) = 5").drop("_full")


def with_points(sides: DataFrame, events: DataFrame, values: list[str]) -> DataFrame:
    """Add `v` and `v_against` for each value: the sums of the team's and its opponent's events in (start, end]."""
    scored = events.where(" or ".join(f"{v} <> 0" for v in values)).select("game_id", "elapsed", F.col("team_id").alias("_t"), *[F.col(v).alias(f"_{v}") for v in values])
    spans = sides.select("game_id", "start", "end").distinct()
    hits = spans.join(scored, "game_id").where((F.col("elapsed") > F.col("start")) & (F.col("elapsed") <= F.col("end")))
    sums = hits.groupBy("game_id", "start", "end", F.col("_t").alias("team_id")).agg(*[F.sum(f"_{v}").alias(v) for v in values])
    out = sides.join(sums, ["game_id", "start", "end", "team_id"], "left").withColumns({v: F.coalesce(v, F.lit(0)) for v in values})
    w = Window.partitionBy("game_id", "start", "end")
    return out.withColumns({f"{v}_against": F.sum(v).over(w) - F.col(v) for v in values})


def adjusted_points(points: Column, three: Column, made: Column, expected: Column, haircut: float = 0.25) -> Column:
    """Points with a three's outcome replaced by its expectation: (expected - made) * (3 - haircut) more."""
    return points + F.when(three, (expected - made.cast("double")) * (3 - haircut)).otherwise(0.0)


def plain_expectation(attempts: Column, makes: Column, default: float = 0.36, least: float = 10.0) -> Column:
    """The older feeds' expectation of a three: the shooter's own rate from `least` attempts on, else `default`."""
    return F.when(attempts >= least, makes / attempts).otherwise(default)


def plain_adjustment(made: Column, expected: Column) -> Column:
    """What luck gave in the older feeds, without a haircut: 3 - 3 * expected for a make, -3 * expected for a miss."""
    return F.when(made, 3.0).otherwise(0.0) - 3 * expected


def shot_expectation(prior: Column, model: Column) -> Column:
    """A shot's own prior within [.10, .60], else the model's value within [.15, .55]."""
    within = lambda c, low, high: F.greatest(F.least(c, F.lit(high)), F.lit(low))
    return F.when(prior.isNotNull(), within(prior, 0.10, 0.60)).otherwise(within(model, 0.15, 0.55))


def possessions(events: DataFrame, sides: DataFrame, ends: tuple[str, ...] = ENDS) -> DataFrame:
    """Possessions (game_id, poss_index, offense_team, off_lineup, def_lineup, points, ended_by).

    An event of kind in `ends` closes the possession, a free throw only as the last of its sequence (column last_throw; without
    the column every one is). The offence is its team, after a defensive rebound the other one. The end of a period
    closes what is open: the offence is then who last got an offensive rebound or a jump ball in it, else who had the ball
    after the last close of the period, else who first shot. Points are the offence's in the possession. Those that end
    outside stints (incomplete lineups) give no row, and the index runs over the rows there are.
    """
    last_throw = F.coalesce("last_throw", F.lit(False)) if "last_throw" in events.columns else F.lit(True)
    closes = F.col("kind").isin(*ends) & ((F.col("kind") != "free_throw") | last_throw)
    other = F.when(F.col("team_id") == F.col("home_id"), F.col("away_id")).otherwise(F.col("home_id"))
    rows = sessions(events.withColumn("_closes", closes), ["game_id", "period"], [F.col("action_number")], F.col("_closes"))
    held = F.collect_list(F.struct("team_id", "points"))
    offence = F.when(F.col("kind") == "defensive_rebound", other).otherwise(F.col("team_id"))
    after = F.when(F.col("kind") == "defensive_rebound", F.col("team_id")).otherwise(other)
    latest = lambda ok, what: F.max_by(what, F.when(ok, F.col("action_number")))
    ball, shot = F.col("kind").isin("offensive_rebound", "jump_ball"), F.col("kind").isin("made", "missed", "free_throw")
    grouped = rows.groupBy("game_id", "period", "session").agg(
        held.alias("_p"), F.max("action_number").alias("_n"), F.bool_or("_closes").alias("_closed"), latest(F.col("_closes"), F.struct(offence.alias("team"), after.alias("next"), "kind", "elapsed")).alias("_last"),
        latest(ball, F.col("team_id")).alias("_ball"), F.min_by("team_id", F.when(shot, F.col("action_number"))).alias("_shot"),
    )
    w = Window.partitionBy("game_id", "period").orderBy("session")
    grouped = grouped.withColumns({"_had": F.lag("_last.next").over(w), "_final": F.lead("session").over(w).isNull()})
    # a period that ends on a close leaves an empty possession to the side that has the ball then
    natural = F.struct(F.col("_last.team").alias("team"), F.col("_last.kind").alias("kind"), F.col("_last.elapsed").cast("long").alias("at"), F.col("session").alias("order"), F.col("_p").alias("p"))
    empty = F.array().cast(rows.select(held).schema[0].dataType)
    trailing = F.struct(F.when(F.col("_closed"), F.col("_last.next")).otherwise(F.coalesce("_ball", "_had", "_shot")).alias("team"), F.lit("period").alias("kind"), S.period_end(F.col("period")).cast("long").alias("at"), (F.col("session") + F.when(F.col("_closed"), 1).otherwise(0)).alias("order"), F.when(F.col("_closed"), empty).otherwise(F.col("_p")).alias("p"))
    each = F.filter(F.array(F.when(F.col("_closed"), natural), F.when(F.col("_final"), trailing)), lambda x: x.isNotNull() & x["team"].isNotNull())
    closed = grouped.select("game_id", "period", F.explode(each).alias("e")).select("game_id", "period", "e.*")
    mine = F.aggregate(F.filter("p", lambda x: x["team_id"] == F.col("team")), F.lit(0).cast("long"), lambda a, x: a + x["points"])
    closed = closed.select("game_id", "period", F.col("order").alias("session"), F.col("team").alias("offense_team"), F.col("kind").alias("ended_by"), F.col("at").alias("_at"), mine.alias("points"))
    at = closed.join(sides, "game_id").where((F.col("_at") > F.col("start")) & (F.col("_at") <= F.col("end")))
    own = F.col("team_id") == F.col("offense_team")
    out = at.groupBy("game_id", "period", "session", "offense_team", "ended_by", "points").agg(F.max(F.when(own, F.col("lineup"))).alias("off_lineup"), F.max(F.when(~own, F.col("lineup"))).alias("def_lineup"))
    index = F.row_number().over(Window.partitionBy("game_id").orderBy("period", "session")).cast("long")
    return out.where("off_lineup is not null and def_lineup is not null").withColumn("poss_index", index).drop("session")


def opening_lineups(events: DataFrame, by: list[str], prior: DataFrame | None = None, size: int = 5) -> DataFrame:
    """Players (by..., player_id, evidence) who were on the floor when the game or period opened, `size` at most.

    Evidence 1: an action before any entry; 2: the first substitution is an exit; 9: from `prior` (by..., player_id), a
    fallback for those without other evidence who did not enter later. Ties go by the first event, then the player id.
    """
    acts = events.select(*by, "player_id", "action_number", F.when(F.col("kind") == "sub", "out").otherwise("act").alias("what"))
    entries = events.where("kind = 'sub'").select(*by, F.col("in_id").alias("player_id"), "action_number", F.lit("in").alias("what"))
    first = lambda w: F.min(F.when(F.col("what") == w, F.col("action_number"))).alias(w)
    seen = acts.unionByName(entries).where("player_id is not null").groupBy(*by, "player_id").agg(first("act"), first("out"), first("in"))
    never = F.lit(2**62)
    evidence = F.when(F.col("act") < F.coalesce("in", never), 1).when(F.col("out") < F.coalesce("in", never), 2)
    found = seen.withColumn("evidence", evidence).withColumn("first", F.least("act", "out"))
    if prior is not None:
        carried = prior.select(*by, "player_id").distinct().withColumn("_prior", F.lit(True))
        found = found.join(carried, [*by, "player_id"], "full_outer").withColumn("evidence", F.coalesce("evidence", F.when(F.col("_prior") & F.col("in").isNull(), 9)))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("evidence", F.coalesce("first", never), "player_id"))
    return found.where("evidence is not null").withColumn("_rank", rank).where(F.col("_rank") <= size).select(*by, "player_id", "evidence")


def trusted_openings(sides: DataFrame, ends: DataFrame, slack: int = 5, period_seconds: int = 720) -> DataFrame:
    """Opening lineups (game_id, period, team_id, lineup) of games whose stints cover the expected seconds within `slack`
    and hold no negative points (column points)."""
    game = Window.partitionBy("game_id")
    whole = sides.withColumns({"_covered": F.sum(F.col("end") - F.col("start")).over(game) / 2, "_least": F.min("points").over(game)})
    good = whole.join(ends.select("game_id", "game_seconds").distinct(), "game_id").where((F.abs(F.col("_covered") - F.col("game_seconds")) <= slack) & (F.col("_least") >= 0))
    period = (F.floor(F.col("start") / period_seconds) + 1).cast("long").alias("period")
    return good.groupBy("game_id", period, "team_id").agg(F.min_by("lineup", "start").alias("lineup"))


def furthest(first: DataFrame, second: DataFrame, ends: DataFrame, slack: int = 1) -> DataFrame:
    """Per game the first source's stints, unless they end before the expected seconds less `slack` and the second's go on longer."""
    reach = lambda df, n: df.groupBy("game_id").agg(F.max("end").alias(n))
    pick = ends.join(reach(first, "_a"), "game_id", "left").join(reach(second, "_b"), "game_id", "left")
    pick = pick.withColumn("_second", (F.coalesce("_a", F.lit(0)) < F.col("game_seconds") - slack) & (F.coalesce("_b", F.lit(0)) > F.coalesce("_a", F.lit(0)))).select("game_id", "_second")
    return first.join(pick.where("not _second"), "game_id", "left_semi").unionByName(second.join(pick.where("_second"), "game_id", "left_semi"))


def unique_aliases(names: DataFrame, aliases: DataFrame, by: list[str]) -> DataFrame:
    """Resolve name keys to a player if exactly one candidate has the alias; else player_id is null and `candidates` lists all.

    `names` and `aliases` share the columns `by` (say team and key); aliases carry player_id. A list of candidates is made into
    text once, and the names that share it are in one partition, where a column file holds it once: lists and names both grow
    with the tables, so their product is never laid down."""
    own = aliases.select(*by, "player_id").distinct()
    per = own.groupBy(*by).agg(F.sort_array(F.collect_set("player_id")).alias("_c"))
    per = per.select(*by, F.when(F.size("_c") == 1, F.get("_c", F.lit(0))).alias("player_id"), F.array_join("_c", ",").alias("candidates"))
    return dealt(names, *by, rows=own.count(), per_task=20_000).join(per, by, "left")


def home_vote(events: DataFrame) -> DataFrame:
    """Per game the team whose events go with most points of the home side (column home_delta), and of the other: they must differ."""
    votes = events.groupBy("game_id", "team_id").agg(F.count_if(F.expr("home_delta > 0 and away_delta = 0")).alias("h"), F.count_if(F.expr("away_delta > 0 and home_delta = 0")).alias("a"))
    best = votes.groupBy("game_id").agg(F.max_by("team_id", F.struct("h", -F.col("a"), "team_id")).alias("home_team"), F.max_by("team_id", F.struct("a", -F.col("h"), "team_id")).alias("away_team"))
    return best.where("home_team <> away_team")


def entry_exit_conflicts(events: DataFrame, openings: DataFrame, by: list[str]) -> DataFrame:
    """Audit of period openings: at the first substitution clock, exits of players not in the opening lineup and entries of
    players already in it. Rows (by..., player_id, problem); openings carry by..., player_id."""
    subs = events.where("kind = 'sub'")
    first = subs.withColumn("_f", F.min("elapsed").over(Window.partitionBy(*by))).where("elapsed = _f")
    marks = openings.select(*by, "player_id").distinct().withColumn("_open", F.lit(True))
    exits = first.select(*by, "player_id").join(marks, [*by, "player_id"], "left").where("_open is null").withColumn("problem", F.lit("out_not_in_opening"))
    entries = first.select(*by, F.col("in_id").alias("player_id")).join(marks, [*by, "player_id"]).withColumn("problem", F.lit("in_already_in_opening"))
    return exits.unionByName(entries).drop("_open").distinct()
