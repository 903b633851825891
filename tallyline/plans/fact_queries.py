"""Registered queries on fact tables, roll-ups, box sources and models, each beside its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import decay, facts as X, lineups
from ..sources import adapters as A, boxes
from . import ridge
from .registry import query, r6

_SEASON = "CASE WHEN month(date) >= 10 THEN year(date) ELSE year(date) - 1 END"
_LABEL = f"({_SEASON}) || '-' || lpad(CAST((({_SEASON}) + 1) % 100 AS VARCHAR), 2, '0')"
_GAMES_SQL = A.STINTS_SQL + """, games AS (SELECT game_id, max(date) AS date, max(home_id) AS home_id, max(away_id) AS away_id, CAST(sum(home_pts) AS BIGINT) AS home_pts, CAST(sum(away_pts) AS BIGINT) AS away_pts, sum(home_pts_adj) AS home_adj, sum(away_pts_adj) AS away_adj FROM stints GROUP BY 1)"""
_BOX_SQL = f"""{_GAMES_SQL}, {A.PLAYER_GAMES_SQL}, box AS (SELECT p.game_id, p.player_id, CASE WHEN p.player_id % 2 = 0 THEN home_id ELSE away_id END AS team_id, minutes, pts, reb, ast, stl, blk, fga, fgm, fta FROM player_games p JOIN games USING (game_id)),
  u AS (SELECT *, 1 AS p FROM (SELECT * REPLACE (CASE WHEN reb >= 3 THEN reb END AS reb) FROM box WHERE game_id % 2 = 0) UNION ALL SELECT *, 2 FROM (SELECT * REPLACE (pts + 1 AS pts) FROM box WHERE game_id % 3 = 0) UNION ALL SELECT *, 3 FROM box)"""


def _games(spark, d):
    total = lambda c: F.sum(c).alias(c)
    return A.stints(spark, d).groupBy("game_id").agg(F.max("date").alias("date"), F.max("home_id").alias("home_id"), F.max("away_id").alias("away_id"), total("home_pts"), total("away_pts"), total("home_pts_adj"), total("away_pts_adj"))


def _facts(spark, d):
    games = _games(spark, d)
    team = F.when(F.col("player_id") % 2 == 0, F.col("home_id")).otherwise(F.col("away_id"))
    box = A.player_games(spark, d).drop("date", "team_id").join(games.select("game_id", "home_id", "away_id"), "game_id").withColumn("team_id", team).drop("home_id", "away_id")
    sources = [box.where("game_id % 2 = 0").withColumn("reb", F.when(F.col("reb") >= 3, F.col("reb"))), box.where("game_id % 3 = 0").withColumn("pts", F.col("pts") + 1), box]
    counted = A.table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("game_id"), (F.col("l_suppkey") % 50).alias("player_id")).agg(F.count("*").alias("possessions"))
    people = A.table(spark, d, "customer").select(F.col("c_custkey").alias("player_id"), F.expr("date_add(date'1965-01-01', cast(c_custkey % 50 * 37 as int))").alias("birth"), (F.col("c_custkey") % 10 + 1990).alias("from_year"))
    return X.player_game_facts(sources, games.drop("home_pts_adj", "away_pts_adj"), counted, people)


_best = ", ".join(f"coalesce(max({c}) FILTER (p = 1), max({c}) FILTER (p = 2), max({c}) FILTER (p = 3)) AS {c}" for c in ("team_id", "minutes", "pts", "reb", "ast", "stl", "blk", "fga", "fgm", "fta"))
_doubles = " + ".join(f"CASE WHEN {c} >= 10 THEN 1 ELSE 0 END" for c in ("pts", "reb", "ast", "stl", "blk"))
_FACTS_SQL = f"""{_BOX_SQL}, best AS (SELECT game_id, player_id, CAST(min(p) AS BIGINT) AS source, {_best} FROM u WHERE player_id > 0 GROUP BY 1, 2),
  pc AS (SELECT l_orderkey AS game_id, l_suppkey % 50 AS player_id, count(*) AS possessions FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2),
  people AS (SELECT c_custkey AS player_id, DATE '1965-01-01' + CAST(c_custkey % 50 * 37 AS INTEGER) AS birth, c_custkey % 10 + 1990 AS from_year FROM customer),
  facts AS (SELECT b.*, g.date, possessions, {_LABEL} AS season, CASE WHEN team_id = home_id THEN away_id ELSE home_id END AS opponent_id, CASE WHEN home_pts = away_pts THEN NULL WHEN (team_id = home_id) = (home_pts > away_pts) THEN 'W' ELSE 'L' END AS win_loss,
    year(date) - year(birth) - CASE WHEN month(date) < month(birth) OR (month(date) = month(birth) AND day(date) < day(birth)) THEN 1 ELSE 0 END AS age, CASE WHEN ({_SEASON}) >= from_year THEN ({_SEASON}) - from_year + 1 END AS career_year,
    ({_doubles}) >= 2 AS double_double, ({_doubles}) >= 3 AS triple_double FROM best b LEFT JOIN games g USING (game_id) LEFT JOIN pc USING (game_id, player_id) LEFT JOIN people USING (player_id) WHERE minutes > 0 AND pts IS NOT NULL)"""


@query(f"WITH {_FACTS_SQL} SELECT game_id, player_id, source, team_id, opponent_id, season, win_loss, possessions, age, career_year, pts, reb, round(CAST(fgm AS DOUBLE)/nullif(fga, 0), 6) AS fg_pct, double_double, triple_double FROM facts")
def player_game_facts(spark, d):
    c = F.col
    return _facts(spark, d).select("game_id", "player_id", c("source").cast("long").alias("source"), "team_id", "opponent_id", "season", "win_loss", "possessions", c("age").cast("long").alias("age"), "career_year", "pts", "reb", F.round("fg_pct", 6).alias("fg_pct"), "double_double", "triple_double")


@query(f"""WITH {_GAMES_SQL}, {A.PLAYER_GAMES_SQL}, n AS (SELECT n_nationkey AS team_id, n_name AS abbr FROM nation), b AS (SELECT p.game_id, p.player_id, CASE WHEN p.player_id % 2 = 0 THEN home_id ELSE away_id END AS team_id, CASE WHEN p.game_id % 2 = 0 THEN coalesce(CASE WHEN reb >= 3 THEN reb END, reb) ELSE reb END AS reb, pts, minutes FROM player_games p JOIN games USING (game_id))
  SELECT game_id, player_id, b.team_id, pts, reb, h.abbr AS home_abbr, a.abbr AS away_abbr, CASE WHEN home_pts = away_pts THEN NULL WHEN (b.team_id = home_id) = (home_pts > away_pts) THEN 'W' ELSE 'L' END AS win_loss FROM b JOIN games USING (game_id) JOIN n h ON h.team_id = home_id JOIN n a ON a.team_id = away_id WHERE player_id > 0 AND minutes > 0""")
def playoff_facts(spark, d):
    """The facts of games whose scores are known from their stints only, from two box sources."""
    s = A.stints(spark, d)
    w = "over (partition by game_id order by stint_index)"
    scored = s.withColumns({"end_home_score": F.expr(f"sum(home_pts) {w}").cast("long"), "end_away_score": F.expr(f"sum(away_pts) {w}").cast("long")})
    games = _games(spark, d).select("game_id", "home_id", "away_id")
    box = A.player_games(spark, d).drop("date", "team_id").join(games, "game_id").withColumn("team_id", F.when(F.col("player_id") % 2 == 0, F.col("home_id")).otherwise(F.col("away_id"))).drop("home_id", "away_id")
    counted = A.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("game_id"), (F.col("l_suppkey") % 50).alias("player_id")).agg(F.count("*").alias("possessions"))
    people = A.table(spark, d, "customer").select(F.col("c_custkey").alias("player_id"), F.expr("date'1970-01-01'").alias("birth"), F.lit(1990).alias("from_year"))
    teams = A.table(spark, d, "nation").select(F.col("n_nationkey").alias("team_id"), F.col("n_name").alias("abbr"))
    out = X.playoff_facts(scored, [box.where("game_id % 2 = 0").withColumn("reb", F.when(F.col("reb") >= 3, F.col("reb"))), box], counted, teams, people)
    return out.select("game_id", "player_id", "team_id", "pts", "reb", "home_abbr", "away_abbr", "win_loss")


@query(f"""WITH {A.STINTS_SQL} SELECT game_id, stint_index, CAST(CASE WHEN game_id % 2 = 0 THEN 1 ELSE 2 END AS BIGINT) AS source, {_LABEL} AS season, array_to_string(list_sort(home_lineup), '-') AS home_group, array_to_string(list_sort(away_lineup), '-') AS away_group,
  CAST(home_pts - away_pts AS BIGINT) AS margin, round(home_pts_adj - away_pts_adj, 6) AS margin_adj FROM stints""")
def lineup_stint_facts(spark, d):
    s = A.stints(spark, d)
    return X.lineup_stint_facts([s.where("game_id % 2 = 0"), s]).select("game_id", "stint_index", F.col("source_priority").cast("long").alias("source"), "season", "home_group", "away_group", F.col("margin").cast("long").alias("margin"), F.round("margin_adj", 6).alias("margin_adj"))


def _team_games(spark, d):
    side = lambda n, flag: _games(spark, d).select("game_id", F.col(f"{n}_id").alias("team_id"), F.lit(flag).alias("is_home"), F.col(f"{n}_pts").alias("pts"), F.col(f"{n}_pts_adj").alias("pts_adj"))
    return X.adjusted_games(side("home", True).unionByName(side("away", False)))


@query(f"WITH {_GAMES_SQL} SELECT game_id, home_id AS home_team_id, away_id AS away_team_id, home_pts - away_pts AS margin, round(home_adj - away_adj, 4) AS margin_adj, (home_pts > away_pts) <> (round(home_adj - away_adj, 6) > 0) AS flipped FROM games")
def adjusted_games(spark, d):
    return _team_games(spark, d).select("game_id", "home_team_id", "away_team_id", "margin", F.round("margin_adj", 4).alias("margin_adj"), "flipped")


@query(f"""WITH {_GAMES_SQL}, t AS (SELECT home_id AS team_id, home_pts - away_pts AS m, home_adj - away_adj AS a, home_pts > away_pts AS w, round(home_adj - away_adj, 6) > 0 AS wa FROM games UNION ALL SELECT away_id, away_pts - home_pts, away_adj - home_adj, home_pts <= away_pts, round(home_adj - away_adj, 6) <= 0 FROM games),
  s AS (SELECT team_id, count(*) AS games, count(*) FILTER (w) AS wins, count(*) FILTER (wa) AS wins_adj, sum(m) - sum(a) AS luck FROM t GROUP BY 1) SELECT team_id, games, wins, wins_adj, round(luck, 4) AS luck, row_number() OVER (ORDER BY luck DESC, team_id) AS rank FROM s""")
def luck_table(spark, d):
    return X.luck_table(_team_games(spark, d)).select("team_id", "games", "wins", "wins_adj", F.round("luck", 4).alias("luck"), "rank")


@query(f"WITH {A.PLAYER_GAMES_SQL} SELECT player_id, count(DISTINCT game_id) AS games, min(date) AS first_date, max(date) AS last_date, arg_max(team_id, (date, game_id)) AS team_id, CAST(sum(pts) AS BIGINT) AS pts_sum, round(avg(pts), 6) AS pts_mean, CAST(sum(reb) AS BIGINT) AS reb_sum, round(avg(reb), 6) AS reb_mean FROM player_games GROUP BY 1")
def player_history(spark, d):
    return X.player_history(A.player_games(spark, d), ["pts", "reb"]).withColumns(r6("pts_mean", "reb_mean"))


_SEASONS_SQL = f"{A.PLAYER_GAMES_SQL}, seasons AS (SELECT player_id, team_id, year(date) AS season, count(*) AS games, sum(minutes) AS minutes_on, CAST(sum(fga) AS DOUBLE) AS minutes_off, sum(pts - reb) AS on_diff, sum(ast - stl) AS off_diff FROM player_games GROUP BY 1, 2, 3)"


def _seasons(spark, d):
    g = A.player_games(spark, d)
    return g.groupBy("player_id", "team_id", F.year("date").alias("season")).agg(F.count("*").alias("games"), F.sum("minutes").alias("minutes_on"), F.sum("fga").cast("double").alias("minutes_off"), F.sum(F.col("pts") - F.col("reb")).alias("on_diff"), F.sum(F.col("ast") - F.col("stl")).alias("off_diff"))


@query(f"WITH {_SEASONS_SQL} SELECT player_id, CAST(sum(games) AS BIGINT) AS games, round(sum(minutes_on), 4) AS minutes_on, string_agg(DISTINCT CAST(team_id AS VARCHAR), '/' ORDER BY CAST(team_id AS VARCHAR)) AS teams, round(sum(minutes_on * on_diff / games) / sum(minutes_on), 6) AS diff FROM seasons GROUP BY 1 HAVING sum(games) >= 20 AND sum(minutes_on) >= 500")
def group_leaderboard(spark, d):
    rows = _seasons(spark, d).withColumn("diff", F.col("on_diff") / F.col("games"))
    return X.group_leaderboard(rows, ["diff"], "minutes_on", 20, 500.0).withColumns({"diff": F.round("diff", 6), "minutes_on": F.round("minutes_on", 4)})


@query(f"""WITH {_SEASONS_SQL}, periods AS (SELECT DISTINCT season, unnest(CASE WHEN season >= 1996 THEN ['all', 'late'] ELSE ['all'] END) AS period FROM seasons)
  SELECT period, player_id, CAST(sum(games) AS BIGINT) AS games, round(sum(on_diff) * 48 / sum(minutes_on), 6) AS on_per_48, round(sum(off_diff) * 48 / sum(minutes_off), 6) AS off_per_48 FROM seasons JOIN periods USING (season) GROUP BY 1, 2 HAVING sum(games) >= 10""")
def period_leaderboard(spark, d):
    seasons = _seasons(spark, d)
    periods = seasons.select("season").distinct().withColumn("period", F.explode(F.when(F.col("season") >= 1996, F.array(F.lit("all"), F.lit("late"))).otherwise(F.array(F.lit("all")))))
    return X.period_leaderboard(seasons, periods, 10).select("period", "player_id", "games", F.round("on_per_48", 6).alias("on_per_48"), F.round("off_per_48", 6).alias("off_per_48"))


@query(f"""WITH {A.PLAYER_GAMES_SQL}, c AS (SELECT player_id, count(*) AS games, count(*) FILTER (minutes >= 20) + least(count(*) FILTER (minutes >= 15 AND minutes < 20), 2) AS counted FROM player_games GROUP BY 1)
  SELECT *, CASE WHEN counted >= 40 THEN 'CLINCHED' WHEN counted + greatest(82 - games, 0) < 40 THEN 'ELIMINATED' ELSE 'BUBBLE' END AS status FROM c""")
def award_eligibility(spark, d):
    return X.eligibility(A.player_games(spark, d), 40, 82)


@query(f"""WITH {A.PLAYER_GAMES_SQL}, t AS (SELECT game_id, team_id, CAST(sum(pts) AS BIGINT) AS team_pts FROM player_games GROUP BY 1, 2), w AS (SELECT *, team_pts = max(team_pts) OVER (PARTITION BY game_id) AND count(*) OVER (PARTITION BY game_id, team_pts) = 1 AS won FROM t)
  SELECT game_id, player_id, team_id, minutes > 0 AS played, team_pts, won FROM player_games JOIN w USING (game_id, team_id)""")
def win_ledger(spark, d):
    return X.win_ledger(A.player_games(spark, d))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN upper(c_name) || ' Jr' ELSE c_name END AS c_name, c_custkey % 5 = 0 AS changed FROM customer""")
def repaired_names(spark, d):
    c = A.table(spark, d, "customer").select("c_custkey", "c_name")
    return X.repair_names(c, c.where("c_custkey % 5 = 0").withColumn("c_name", F.concat(F.upper("c_name"), F.lit(" Jr"))), "c_custkey", "c_name")


@query("""WITH r AS (SELECT o_custkey % 40 AS name, o_custkey AS id, min(year(o_orderdate) + (o_custkey % 7) * 9) AS f, max(year(o_orderdate) + (o_custkey % 7) * 9) AS l, list(DISTINCT o_orderkey % 6) AS teams FROM orders GROUP BY 1, 2),
  p AS (SELECT *, lead(id) OVER w AS next_id, lead(f) OVER w AS nf, lead(teams) OVER w AS nt FROM r WINDOW w AS (PARTITION BY name ORDER BY f, id))
  SELECT name, id, next_id, CASE WHEN l >= nf THEN 'OVERLAP' WHEN nf - l <= 2 AND list_has_any(teams, nt) THEN 'CONTINUITY' ELSE 'SAME_NAME' END AS status FROM p WHERE next_id IS NOT NULL""")
def audit_identity(spark, d):
    o = A.table(spark, d, "orders")
    rows = o.select((F.col("o_custkey") % 40).alias("name"), "o_custkey", (F.col("o_orderkey") % 6).alias("team"), (F.year("o_orderdate") + (F.col("o_custkey") % 7) * 9).alias("season"))
    return X.identity_spans(rows, "name", "o_custkey", "team", "season")


@query(f"""WITH {A.POSS_SQL}, pos AS (SELECT * FROM possessions WHERE ended_by = 'R'), f AS (SELECT DISTINCT game_id, unnest(list_concat(home_lineup, away_lineup)) AS player_id FROM stints), seen AS (SELECT DISTINCT game_id, unnest(list_concat(home_lineup, away_lineup)) AS player_id FROM stints WHERE stint_index <= 2),
  n AS (SELECT DISTINCT game_id, unnest(off_lineup) AS player_id FROM pos)
  SELECT game_id, player_id, CASE WHEN game_id NOT IN (SELECT game_id FROM pos) THEN 'game_missing' WHEN s.player_id IS NULL THEN 'not_in_stints' ELSE 'no_offence' END AS cause FROM (SELECT * FROM f ANTI JOIN n USING (game_id, player_id)) LEFT JOIN (SELECT game_id AS g, player_id FROM seen) s ON s.g = game_id AND s.player_id = f.player_id""".replace("(SELECT * FROM f ANTI JOIN n USING (game_id, player_id)) LEFT", "(SELECT * FROM f ANTI JOIN n USING (game_id, player_id)) AS f LEFT").replace("SELECT game_id, player_id, CASE", "SELECT game_id, f.player_id, CASE"))
def audit_missing_possessions(spark, d):
    s = A.stints(spark, d).withColumn("lineup", F.concat("home_lineup", "away_lineup"))
    facts = s.select("game_id", F.explode("lineup").alias("player_id")).distinct()
    return X.missing_causes(facts, A.possessions(spark, d).where("ended_by = 'R'"), s.where("stint_index <= 2"))


@query("""SELECT event_id, round(CASE WHEN f > l THEN m - value ELSE value END, 6) AS value FROM (SELECT event_id, value, first_value(value) OVER w AS f, last_value(value) OVER w AS l, max(value) OVER w AS m FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))""")
def reversed_totals(spark, d):
    e = A.table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    return X.unreversed(e, ["user_id"], [F.col("ts"), F.col("event_id")], "value").select("event_id", F.round("value", 6).alias("value"))


# --- sources ---------------------------------------------------------------------------------------------------


@query("SELECT CAST(l_orderkey AS VARCHAR) AS game_id, l_suppkey % 2 AS team_id, l_partkey AS player_id, CAST(l_linenumber AS BIGINT) AS points, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ':00' AS minutes FROM lineitem WHERE l_returnflag <> 'N'")
def nested_box_rows(spark, d):
    player = F.struct(F.col("l_partkey").alias("personId"), F.when(F.col("l_returnflag") != "N", "1").otherwise("0").alias("played"), F.struct(F.col("l_linenumber").alias("points"), F.concat(F.col("l_quantity").cast("long").cast("string"), F.lit(":00")).alias("minutes")).alias("statistics"))
    teams = A.table(spark, d, "lineitem").groupBy("l_orderkey", (F.col("l_suppkey") % 2).alias("teamId")).agg(F.collect_list(player).alias("players"))
    games = teams.groupBy("l_orderkey").agg(F.collect_list(F.struct("teamId", "players")).alias("teams"))
    return boxes.box_rows(games.select(F.to_json(F.struct(F.col("l_orderkey").cast("string").alias("gameId"), "teams")).alias("j")), "j")


@query("SELECT l_orderkey, l_partkey AS player, CAST(l_quantity AS DOUBLE) AS amount, CAST(NULL AS DOUBLE) AS absent FROM lineitem")
def matrix_box_rows(spark, d):
    row = F.array(F.col("l_quantity").cast("string"), F.col("l_partkey").cast("string"))
    texts = A.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.struct(F.array(F.lit("amount"), F.lit("player")).alias("columns"), F.collect_list(row).alias("data"))).alias("j"))
    return boxes.matrix_rows(texts, "j", {"player": "bigint", "amount": "double", "absent": "double"})


# --- models ----------------------------------------------------------------------------------------------------


@query(f"""WITH {A.SHOTS_SQL}, s AS (SELECT player_id, game_id, count(*) AS a, sum(made) AS m FROM shots GROUP BY 1, 2), k AS (SELECT unnest([5.0, 20.0, 80.0, 320.0, 1280.0]) AS kappa)
  SELECT CAST(kappa AS DOUBLE) AS kappa, round(sum(lgamma(0.4*kappa + m) + lgamma(0.6*kappa + a - m) - lgamma(kappa + a) - lgamma(0.4*kappa) - lgamma(0.6*kappa) + lgamma(kappa)), 3) AS log_likelihood FROM s, k GROUP BY 1""")
def concentration_likelihood(spark, d):
    s = A.shots(spark, d).groupBy("player_id", "game_id").agg(F.count("*").alias("a"), F.sum("made").alias("m"))
    return decay.concentration_likelihood(s, "a", "m", F.lit(0.4), [5.0, 20.0, 80.0, 320.0, 1280.0]).withColumn("log_likelihood", F.round("log_likelihood", 3))


@query()
def concentration_fit(spark, d):
    s = A.shots(spark, d).groupBy("player_id", "game_id").agg(F.count("*").alias("a"), F.sum("made").alias("m"))
    return spark.createDataFrame([(decay.concentration_fit(s, "a", "m", F.lit(0.4)),)], "kappa double")


@query(f"""WITH {A.STINTS_SQL}, s AS (SELECT * FROM stints WHERE seconds >= 10), o AS (SELECT game_id, stint_index, home_id AS team_id, home_pts AS pf, seconds, home_lineup AS ol, away_lineup AS dl FROM s UNION ALL SELECT game_id, stint_index, away_id, away_pts, seconds, away_lineup, home_lineup FROM s),
  f AS (SELECT *, unnest(list_concat([('O:' || x::VARCHAR, 1.0) for x in ol], [('D:' || x::VARCHAR, -1.0) for x in dl])) AS e FROM o)
  SELECT game_id, stint_index, team_id, e[1] AS feature, CAST(e[2] AS DOUBLE) AS sign, round(pf / greatest(seconds/24.0, 0.1) * 100, 6) AS y, round(sqrt(greatest(seconds/24.0, 0.1)), 6) AS w FROM f""")
def offence_defence_design(spark, d):
    return lineups.long_design(lineups.offence_defence_design(A.stints(spark, d)), ["game_id", "stint_index", "team_id"]).withColumns(r6("y", "w"))


@query(f"""WITH {A.POSS_SQL}, f AS (SELECT *, unnest(list_concat([('O:' || x::VARCHAR, 1.0) for x in off_lineup], [('D:' || x::VARCHAR, -1.0) for x in def_lineup])) AS e FROM possessions)
  SELECT game_id, poss_index, e[1] AS feature, CAST(e[2] AS DOUBLE) AS sign, CAST(points * 100 AS DOUBLE) AS y, CAST(1 AS DOUBLE) AS w FROM f""")
def possession_design(spark, d):
    return lineups.long_design(lineups.possession_design(A.possessions(spark, d)), ["game_id", "poss_index"])


@query()
def possession_plus_minus(spark, d):
    return ridge.offence_defence_fit(lineups.possession_design(A.possessions(spark, d)), 2500.0, 2500.0)


@query()
def regularized_plus_minus(spark, d):
    return ridge.plus_minus_table(A.stints(spark, d), 2500.0, 2500.0, 20.0)


@query()
def plus_minus_windows(spark, d):
    """Windows of seasons; possessions are there for the later years only, so the gate picks stints for the earlier ones."""
    s, p = (f(spark, d).withColumn("season", F.year("date")) for f in (A.stints, A.possessions))
    windows = {"early": (None, 1994), "last3": (1996, 1998), "all": (None, None)}
    return ridge.plus_minus_windows(s, windows, [500.0, 2500.0], p.where("season >= 1995"))
