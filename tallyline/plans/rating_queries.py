"""Registered queries on ratings, daily boxes, priors and season tables, each beside its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import decay, facts as X, lineups, ratings, reconstruct, sequences, tables
from ..sources import adapters as A
from ..sources.pbp import PBP_SQL, play_by_play
from . import audits, search
from .game_queries import _ROTATIONS, _rotations
from .registry import query, r6, rsql

# --- on/off ------------------------------------------------------------------------------------------------------

_RATED = f"""{A.POSS_SQL}, side AS (SELECT offense_team AS team_id, off_lineup AS lineup, points, true AS att FROM possessions UNION ALL SELECT defense_team, def_lineup, points, false FROM possessions),
  team AS (SELECT team_id, count(*) FILTER (att) AS tof, count(*) FILTER (NOT att) AS tdf, sum(CASE WHEN att THEN points ELSE 0 END) AS tp, sum(CASE WHEN NOT att THEN points ELSE 0 END) AS top FROM side GROUP BY 1),
  onp AS (SELECT team_id, player_id, count(*) FILTER (att) AS nof, count(*) FILTER (NOT att) AS ndf, sum(CASE WHEN att THEN points ELSE 0 END) AS np, sum(CASE WHEN NOT att THEN points ELSE 0 END) AS nop FROM (SELECT *, unnest(lineup) AS player_id FROM side) GROUP BY 1, 2),
  joined AS (SELECT *, tof - nof <= 0 OR tdf - ndf <= 0 AS alone FROM onp JOIN team USING (team_id) WHERE nof > 0 AND ndf > 0),
  rated AS (SELECT team_id, player_id, np*100.0/nof AS on_ortg, nop*100.0/ndf AS on_drtg, CASE WHEN alone THEN tp*100.0/tof ELSE (tp-np)*100.0/(tof-nof) END AS off_ortg, CASE WHEN alone THEN top*100.0/tdf ELSE (top-nop)*100.0/(tdf-ndf) END AS off_drtg, (nof+ndf)/2.0 AS on_poss, CASE WHEN alone THEN 0 ELSE (tof-nof+tdf-ndf)/2.0 END AS off_poss FROM joined)"""


@query(f"WITH {_RATED} SELECT team_id, player_id, {rsql('on_ortg', 'on_drtg', 'off_ortg', 'off_drtg', 'on_poss', 'off_poss')}, round(on_ortg - on_drtg - off_ortg + off_drtg, 6) AS on_off_net FROM rated")
def possession_ratings(spark, d):
    names = ("on_ortg", "on_drtg", "off_ortg", "off_drtg", "on_poss", "off_poss", "on_off_net")
    return ratings.possession_ratings(A.possessions(spark, d)).select("team_id", "player_id", *[c.alias(n) for n, c in r6(*names).items()])


_TOTALS = f"""{A.SIDES_SQL}, tg AS (SELECT game_id, team_id, sum(pf) AS tpf, sum(pa) AS tpa, sum(pf_adj) AS tpfa, sum(pa_adj) AS tpaa, sum(seconds) AS ts FROM sides GROUP BY 1, 2), pg AS (SELECT game_id, team_id, player_id, sum(pf) AS pf, sum(pa) AS pa, sum(pf_adj) AS pfa, sum(pa_adj) AS paa, sum(seconds) AS s FROM (SELECT *, unnest(lineup) AS player_id FROM sides) GROUP BY 1, 2, 3),
  tot AS (SELECT team_id, player_id, count(*) AS games, sum(s)/60.0 AS minutes_on, sum(ts-s)/60.0 AS minutes_off, sum(pf)-sum(pa) AS on_diff, sum(tpf-pf)-sum(tpa-pa) AS off_diff, round(sum(pfa)-sum(paa), 6) AS on_adj, round(sum(tpfa-pfa)-sum(tpaa-paa), 6) AS off_adj, round(sum(pfa), 6) AS on_for, round(sum(paa), 6) AS on_against, round(sum(tpfa-pfa), 6) AS off_for, round(sum(tpaa-paa), 6) AS off_against FROM pg JOIN tg USING (game_id, team_id) GROUP BY 1, 2)"""
_RATED_POSS = _RATED.replace(A.STINTS_SQL + ", ", "")


@query(f"""WITH {_TOTALS}, {_RATED_POSS}, half AS (SELECT * FROM rated WHERE player_id % 2 = 0), j AS (SELECT t.*, on_poss, off_poss, on_ortg - on_drtg AS rn, on_ortg - on_drtg - off_ortg + off_drtg AS rb FROM tot t LEFT JOIN half USING (team_id, player_id)),
  k AS (SELECT *, coalesce(rn, CASE WHEN minutes_on > 0 THEN on_diff*48.0/minutes_on ELSE 0 END) AS net, CASE WHEN on_poss > 0 THEN on_adj*100.0/on_poss WHEN minutes_on > 0 THEN on_adj*48.0/minutes_on ELSE 0 END AS net_adj, CASE WHEN off_poss > 0 THEN off_adj*100.0/off_poss WHEN minutes_off > 0 THEN off_adj*48.0/minutes_off ELSE 0 END AS oadj FROM j)
  SELECT team_id, player_id, games, CASE WHEN rn IS NULL THEN 'minutes' ELSE 'possessions' END AS source, {rsql('net', 'net_adj')}, round(coalesce(rb, CASE WHEN minutes_off > 0 THEN net - off_diff*48.0/minutes_off ELSE 0 END), 6) AS on_off, round(CASE WHEN off_poss > 0 OR minutes_off > 0 THEN net_adj - oadj ELSE 0 END, 6) AS on_off_adj,
    round(CASE WHEN minutes_on > 0 THEN on_for*48.0/minutes_on ELSE 0 END - CASE WHEN minutes_off > 0 THEN off_for*48.0/minutes_off ELSE 0 END, 6) AS on_off_offence, round(CASE WHEN minutes_off > 0 THEN off_against*48.0/minutes_off ELSE 0 END - CASE WHEN minutes_on > 0 THEN on_against*48.0/minutes_on ELSE 0 END, 6) AS on_off_defence FROM k""")
def finished_ratings(spark, d):
    known = ratings.possession_ratings(A.possessions(spark, d)).where("player_id % 2 = 0")
    out = ratings.finished_ratings(ratings.season_totals(lineups.by_side(A.stints(spark, d))), known)
    return out.select("team_id", "player_id", "games", "source", *[c.alias(n) for n, c in r6("net", "net_adj", "on_off", "on_off_adj", "on_off_offence", "on_off_defence").items()])


_BOX = f"""{A.SIDES_SQL}, tg AS (SELECT game_id, team_id, sum(pf-pa) AS t, sum(pf_adj-pa_adj) AS ta FROM sides GROUP BY 1, 2), pg AS (SELECT game_id, team_id, player_id, max(date) AS date, sum(seconds)/60.0 AS m, sum(pf-pa) AS o, sum(pf_adj-pa_adj) AS oa FROM (SELECT *, unnest(lineup) AS player_id FROM sides) GROUP BY 1, 2, 3),
  box AS (SELECT date, game_id, team_id, player_id, round(m, 3) AS minutes_on, round(o, 3) AS plus_minus_actual, round(oa, 3) AS plus_minus_adjusted, round(2*o - t, 3) AS on_off_actual FROM pg JOIN tg USING (game_id, team_id))"""


def _box(spark, d):
    sides = lineups.by_side(A.stints(spark, d))
    values = ("pf", "pa", "pf_adj", "pa_adj", "seconds")
    team = sides.groupBy("game_id", "team_id").agg(*[F.sum(v).alias(f"t_{v}") for v in values])
    on = sides.withColumn("player_id", F.explode("lineup")).groupBy("game_id", "team_id", "player_id").agg(F.max("date").alias("date"), *[F.sum(v).alias(f"on_{v}") for v in values])
    rows = on.join(team, ["game_id", "team_id"]).withColumns({f"off_{v}": F.col(f"t_{v}") - F.col(f"on_{v}") for v in values})
    return ratings.daily_box(rows)


@query(f"WITH {_BOX} SELECT date, game_id, team_id, player_id, minutes_on, plus_minus_actual, on_off_actual, round(plus_minus_adjusted, 2) AS plus_minus_adjusted FROM box")
def daily_box(spark, d):
    return _box(spark, d).select("date", "game_id", "team_id", "player_id", "minutes_on", "plus_minus_actual", "on_off_actual", F.round("plus_minus_adjusted", 2).alias("plus_minus_adjusted"))


@query(f"""WITH {_BOX}, g AS (SELECT game_id, CAST(sum(home_pts) AS BIGINT) AS home_pts, CAST(sum(away_pts) AS BIGINT) AS away_pts FROM stints GROUP BY 1), day AS (SELECT max(date) AS d FROM box)
  SELECT game_id, team_id, player_id, minutes_on, home_pts, away_pts, row_number() OVER (PARTITION BY game_id, team_id ORDER BY minutes_on DESC, player_id) AS place FROM box JOIN g USING (game_id), day WHERE date = d AND minutes_on >= 3""")
def box_of_last_day(spark, d):
    """The boxes of the last day there is."""
    box, s = _box(spark, d), A.stints(spark, d)
    games = s.groupBy("game_id").agg(F.sum("home_pts").cast("long").alias("home_pts"), F.sum("away_pts").cast("long").alias("away_pts"))
    last = s.agg(F.max("date").alias("day")).first()[0]
    return ratings.box_of_day(box, games, F.lit(last), 3.0).select("game_id", "team_id", "player_id", "minutes_on", "home_pts", "away_pts", "place")


@query(f"""WITH {A.STINTS_SQL}, g AS (SELECT game_id, max(date) AS date, CAST(sum(home_pts) - sum(away_pts) AS BIGINT) AS margin, round(sum(home_pts_adj) - sum(away_pts_adj), 6) AS adj FROM stints GROUP BY 1)
  SELECT date, count(*) AS n_games, count(*) FILTER ((margin > 0) <> (adj > 0)) AS n_flipped, string_agg(game_id || ':' || margin, ',' ORDER BY game_id) AS games FROM g GROUP BY 1""")
def games_by_date(spark, d):
    g = A.stints(spark, d).groupBy("game_id").agg(F.max("date").alias("date"), (F.sum("home_pts") - F.sum("away_pts")).cast("long").alias("margin"), F.round(F.sum("home_pts_adj") - F.sum("away_pts_adj"), 6).alias("margin_adj"))
    out = ratings.games_by_date(g.withColumn("flipped", (F.col("margin") > 0) != (F.col("margin_adj") > 0)))
    text = F.array_join(F.transform("games", lambda x: F.concat(x["game_id"].cast("string"), F.lit(":"), x["margin"].cast("string"))), ",")
    return out.select("date", "n_games", "n_flipped", text.alias("games"))


@query(f"""WITH {_ROTATIONS}, sh AS (SELECT game_id, action_number, elapsed, team_id, CASE WHEN kind = 'made' THEN 1 ELSE 0 END AS made FROM pbp WHERE three),
  p AS (SELECT DISTINCT game_id, team_id AS own, player_id FROM iv), t AS (SELECT sh.*, own, player_id, EXISTS (SELECT 1 FROM iv WHERE iv.game_id = sh.game_id AND iv.team_id = own AND iv.player_id = p.player_id AND elapsed > s AND elapsed <= e) AS floor, (made - 0.36) * 2.75 * CASE WHEN team_id = own THEN 1 ELSE -1 END AS luck FROM sh JOIN p USING (game_id)),
  c AS (SELECT *, lag(floor) OVER (PARTITION BY game_id, own, player_id ORDER BY elapsed, action_number) <> floor AS changed FROM t)
  SELECT game_id, own AS team_id, player_id, count(*) FILTER (floor) AS on_shots, count(*) FILTER (NOT floor) AS off_shots, round(sum(CASE WHEN floor THEN luck ELSE 0 END), 6) AS on_luck, round(sum(CASE WHEN NOT floor THEN luck ELSE 0 END), 6) AS off_luck, count(*) FILTER (changed) AS changes FROM c GROUP BY 1, 2, 3""")
def shot_luck_trail(spark, d):
    events = play_by_play(spark, d)
    shots = events.where("three").select("game_id", "action_number", "elapsed", "team_id", (F.col("kind") == "made").cast("int").alias("made"), F.lit(0.36).alias("expected"))
    return ratings.luck_split(ratings.shot_trail(shots, _rotations(events)))


# --- priors ------------------------------------------------------------------------------------------------------

_SEASONS = """sea AS (SELECT o_custkey AS player_id, year(o_orderdate) AS season, CAST(sum(o_orderkey % 50) AS DOUBLE) AS fta, CAST(sum((o_orderkey % 50) * (o_orderkey % 4)) AS DOUBLE) / 4 AS ftm, CAST(sum(o_orderkey % 90) AS DOUBLE) AS fg3a, CAST(sum(o_orderkey % 37) AS DOUBLE) AS fg3m, CAST(sum(o_orderkey % 70) AS DOUBLE) AS catch_a, CAST(sum(o_orderkey % 29) AS DOUBLE) AS catch_m FROM orders GROUP BY 1, 2)"""


def _seasons(spark, d):
    k = F.col("o_orderkey")
    s = lambda e, n: F.sum(e).cast("double").alias(n)
    out = A.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("player_id"), F.year("o_orderdate").alias("season")).agg(s(k % 50, "fta"), s((k % 50) * (k % 4), "ftm"), s(k % 90, "fg3a"), s(k % 37, "fg3m"), s(k % 70, "catch_a"), s(k % 29, "catch_m"))
    return out.withColumn("ftm", F.col("ftm") / 4)


@query(f"WITH {_SEASONS} SELECT player_id, round(sum(ftm) / sum(fta), 6) AS rate, round((0.34 + sum(ftm) / sum(fta) * 0.5 - 0.02) / 2, 9) AS skill FROM sea WHERE player_id > 0 GROUP BY 1 HAVING sum(fta) > 0")
def career_free_throws(spark, d):
    return decay.career_rates(_seasons(spark, d), "player_id", "fta", "ftm").withColumns({"rate": F.round("rate", 6), "skill": F.round(decay.starting_skill(F.col("rate")), 9)})


@query(f"""WITH {_SEASONS}, r AS (SELECT *, CASE WHEN fta > 0 THEN ftm / fta END AS rate FROM sea), w AS (SELECT *, CASE WHEN rate IS NOT NULL THEN exp(-ln(2)/3.0*(max(season) FILTER (rate IS NOT NULL) OVER (PARTITION BY player_id) - season)) * fta END AS w FROM r)
  SELECT player_id, round(coalesce(sum(w * rate) / nullif(sum(w), 0), 0.78), 6) AS rate FROM w GROUP BY 1""")
def recent_free_throws(spark, d):
    rows = _seasons(spark, d).withColumn("rate", F.when(F.col("fta") > 0, F.col("ftm") / F.col("fta")))
    return decay.recent_rate(rows, "player_id", "season", "fta", "rate").withColumns(r6("rate"))


@query(f"""WITH {_SEASONS} SELECT player_id, season, greatest(fg3a - catch_a, 0) AS pull_a, greatest(fg3m - catch_m, 0) AS pull_m, round(CASE WHEN fg3a - catch_a > 0 THEN greatest(fg3m - catch_m, 0) / (fg3a - catch_a) END, 6) AS pull_pct, round(CASE WHEN catch_a <> 0 THEN catch_m / catch_a END, 6) AS catch_pct, round(CASE WHEN fg3a <> 0 THEN catch_a / fg3a END, 6) AS catch_share FROM sea""")
def shot_split(spark, d):
    return decay.shot_split(_seasons(spark, d)).select("player_id", "season", "pull_a", "pull_m", *[c.alias(n) for n, c in r6("pull_pct", "catch_pct", "catch_share").items()])


_FACTOR = "CASE " + " ".join(f"WHEN area = '{a}' AND kind = '{k}' THEN {r} / {S.LEAGUE_THREE}" for a, kinds in S.THREE_RATES.items() for k, r in kinds.items())


@query(f"""WITH {_SEASONS}, c AS (SELECT season, sum(catch_a) / sum(fg3a) AS share FROM sea WHERE fg3a > 0 AND season < 1998 GROUP BY 1), g AS (SELECT sum(catch_a) / sum(fg3a) AS share_all FROM sea WHERE fg3a > 0 AND season < 1998),
  s AS (SELECT o_orderkey, year(o_orderdate) AS season, CASE WHEN o_custkey % 3 = 0 THEN 'corner' ELSE 'above_break' END AS area, ['catch_shoot', 'pullup', 'stepback', 'running', 'fadeaway', 'turnaround', 'unknown', 'hook'][o_orderkey % 8 + 1] AS kind FROM orders)
  SELECT o_orderkey, round(CASE WHEN kind = 'unknown' THEN coalesce(share, share_all) * CASE WHEN area = 'corner' THEN 0.41 ELSE 0.38 END / 0.365 + (1 - coalesce(share, share_all)) * CASE WHEN area = 'corner' THEN 0.37 ELSE 0.34 END / 0.365 ELSE {_FACTOR} ELSE 1 END END, 6) AS factor FROM s LEFT JOIN c USING (season), g""")
def shot_factors(spark, d):
    """Difficulty of shots by area and type; shots of no known type take their season's mix, of seasons without one the overall mix."""
    shares, overall = decay.group_share(_seasons(spark, d).where("season < 1998").withColumn("season", F.col("season").cast("string")), "season", "catch_a", "fg3a")
    kinds = F.array(*[F.lit(k) for k in ("catch_shoot", "pullup", "stepback", "running", "fadeaway", "turnaround", "unknown", "hook")])
    o = A.table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").cast("string").alias("season"), F.when(F.col("o_custkey") % 3 == 0, "corner").otherwise("above_break").alias("area"), F.element_at(kinds, (F.col("o_orderkey") % 8 + 1).cast("int")).alias("kind"))
    return decay.with_default(o, shares, "season", overall).select("o_orderkey", F.round(S.shot_factor(F.col("area"), F.col("kind"), F.col("share")), 6).alias("factor"))


_TRACK = "WITH {shots}, s AS (SELECT player_id, event_id, made, assisted, row_number() OVER (PARTITION BY player_id ORDER BY event_id) AS n, coalesce(sum(assisted) OVER (PARTITION BY player_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM shots),"


@query(_TRACK.format(shots=A.SHOTS_SQL) + """
  t AS (SELECT x.player_id, x.event_id, x.made, x.assisted, x.n, x.k, (0.35*300*power(2, -x.k/1200.0) + coalesce(sum(CASE WHEN y.assisted = 1 THEN y.made * power(2, -(x.k - y.k - 1)/1200.0) END), 0)) / (300*power(2, -x.k/1200.0) + coalesce(sum(CASE WHEN y.assisted = 1 THEN power(2, -(x.k - y.k - 1)/1200.0) END), 0)) AS theta
    FROM s x LEFT JOIN s y ON y.player_id = x.player_id AND y.n < x.n GROUP BY x.player_id, x.event_id, x.made, x.assisted, x.n, x.k),
  v AS (SELECT *, n - 1 - k AS u FROM t),
  e AS (SELECT x.player_id, x.event_id, x.assisted, x.theta, (-0.06*250*power(2, -x.u/800.0) + coalesce(sum(CASE WHEN y.assisted = 0 THEN (y.made - y.theta) * power(2, -(x.u - y.u - 1)/800.0) END), 0)) / (250*power(2, -x.u/800.0) + coalesce(sum(CASE WHEN y.assisted = 0 THEN power(2, -(x.u - y.u - 1)/800.0) END), 0)) AS delta
    FROM v x LEFT JOIN v y ON y.player_id = x.player_id AND y.n < x.n GROUP BY x.player_id, x.event_id, x.assisted, x.theta, x.u)
  SELECT player_id, event_id, round(theta, 6) AS theta, round(delta, 6) AS delta, round(greatest(least(CASE WHEN assisted = 1 THEN theta ELSE theta + delta END, 0.6), 0.1), 6) AS expected FROM e""")
def shot_priors(spark, d):
    out = decay.shot_priors(A.shots(spark, d).select("player_id", "event_id", "made", "assisted"), F.lit(0.35), order=["event_id"])
    return out.select("player_id", "event_id", *[c.alias(n) for n, c in r6("theta", "delta", "expected").items()])


@query(f"""WITH {A.SHOTS_SQL}, p AS (SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN (event_id % 100) / 100.0 END AS prior FROM events) SELECT event_id, round(CASE WHEN prior IS NOT NULL THEN greatest(least(prior, 0.6), 0.1) ELSE greatest(least(value / 100.0, 0.55), 0.15) END, 6) AS expected FROM shots LEFT JOIN p USING (event_id)""")
def shot_expectations(spark, d):
    e = A.table(spark, d, "events")
    priors = e.where("event_id % 4 <> 0").select("event_id", ((F.col("event_id") % 100) / 100.0).alias("prior"))
    return A.shots(spark, d).join(priors, "event_id", "left").select("event_id", F.round(reconstruct.shot_expectation(F.col("prior"), F.col("value") / 100.0), 6).alias("expected"))


@query(f"""WITH {A.SHOTS_SQL}, s AS (SELECT player_id, dayofmonth(game_id) AS season, CASE WHEN assisted = 1 THEN 'catch' ELSE 'pull' END AS kind, count(*) AS a, sum(made) AS m FROM shots GROUP BY 1, 2, 3), w AS (SELECT *, exp(-ln(2)/2.0*(max(season) OVER (PARTITION BY player_id) - season)) AS w FROM s),
  b AS (SELECT player_id, kind, w, a, m FROM w UNION ALL SELECT player_id, 'overall', w, a, m FROM w), t AS (SELECT player_id, kind, sum(w*a) AS attempts, sum(w*m) AS makes, 72 + sum(w*m) AS x, 128 + sum(w*a) - sum(w*m) AS y FROM b GROUP BY 1, 2 HAVING kind = 'overall' OR sum(w*a) >= 10)
  SELECT player_id, kind, {rsql("attempts", "makes")}, round(x/(x+y), 6) AS mean, round(x/(x+y) - 1.6448536269514722*sqrt(x*y/((x+y)*(x+y)*(x+y+1))), 6) AS low, round(x/(x+y) + 1.6448536269514722*sqrt(x*y/((x+y)*(x+y)*(x+y+1))), 6) AS high FROM t""")
def posterior_by_kind(spark, d):
    s = A.shots(spark, d).groupBy("player_id", F.dayofmonth("game_id").alias("season"), F.when(F.col("assisted") == 1, "catch").otherwise("pull").alias("kind")).agg(F.count("*").alias("a"), F.sum("made").alias("m"))
    out = decay.posterior_table(s, "player_id", "season", "a", "m", 0.36, 200.0, split="kind", least=10.0)
    return out.select("player_id", "kind", *[c.alias(n) for n, c in r6("attempts", "makes", "mean", "low", "high").items()])


@query("""WITH st AS (SELECT c_custkey AS player_id, CAST(c_custkey % 90 AS DOUBLE) AS attempts, CAST(c_custkey % 30 AS DOUBLE) AS makes FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT DISTINCT o_custkey AS player_id FROM orders), c AS (SELECT c_custkey AS player_id, CAST(c_nationkey * 10 AS DOUBLE) AS attempts, CAST(c_nationkey * 3 AS DOUBLE) AS makes FROM customer WHERE c_custkey % 2 = 0)
  SELECT * FROM st UNION ALL SELECT n.player_id, coalesce(attempts, 0), coalesce(makes, 0) FROM n LEFT JOIN c ON c.player_id = n.player_id WHERE n.player_id NOT IN (SELECT player_id FROM st)""")
def seeded_state(spark, d):
    c, k = A.table(spark, d, "customer"), F.col("c_custkey")
    state = c.where("c_custkey % 3 <> 0").select(k.alias("player_id"), (k % 90).alias("attempts"), (k % 30).alias("makes"))
    careers = c.where("c_custkey % 2 = 0").select(k.alias("player_id"), (F.col("c_nationkey") * 10).alias("attempts"), (F.col("c_nationkey") * 3).alias("makes"))
    return decay.seeded_state(state, A.table(spark, d, "orders").select(F.col("o_custkey").alias("player_id")), careers)


@query(f"""WITH {PBP_SQL}, r AS (SELECT game_id, action_number, points, three AND kind = 'made' AS hit, three FROM pbp) SELECT game_id, round(sum(points + CASE WHEN three THEN (0.36 - CASE WHEN hit THEN 1 ELSE 0 END) * 2.75 ELSE 0 END), 4) AS first_prior, round(sum(points + CASE WHEN three THEN (0.3 + (action_number % 10) / 100.0 - CASE WHEN hit THEN 1 ELSE 0 END) * 2.75 ELSE 0 END), 4) AS second_prior FROM r GROUP BY 1""")
def two_prior_sets(spark, d):
    """The same events scored under two sets of priors in one pass."""
    e = play_by_play(spark, d)
    adjusted = lambda p: F.round(F.sum(reconstruct.adjusted_points(F.col("points"), F.col("three"), F.col("kind") == "made", p)), 4)
    return e.groupBy("game_id").agg(adjusted(F.lit(0.36)).alias("first_prior"), adjusted(0.3 + (F.col("action_number") % 10) / 100.0).alias("second_prior"))


# --- season tables and worklists -----------------------------------------------------------------------------------


@query("""SELECT p_partkey AS player_id, CAST(p_size AS BIGINT) AS attempts, round(p_retailprice / 3000, 6) AS pct, round((p_size % 10) / 10.0, 6) AS expected, round((p_size % 10) / 10.0 - p_retailprice / 3000, 6) AS diff FROM part""")
def rim_defence(spark, d):
    raw = A.table(spark, d, "part").select("p_partkey", F.col("p_size").cast("long").alias("D_FGA"), (F.col("p_retailprice") / 3000).alias("D_FG_PCT"), ((F.col("p_size") % 10) / 10.0).alias("NORMAL_FG_PCT"))
    out = X.conform_box(raw, {"player_id": "p_partkey", "attempts": "D_FGA", "pct": "D_FG_PCT", "expected": "NORMAL_FG_PCT", "diff": F.col("NORMAL_FG_PCT") - F.col("D_FG_PCT")})
    return out.withColumns(r6("pct", "expected", "diff"))


@query(f"""WITH {A.PLAYER_GAMES_SQL}, t AS (SELECT game_id, max(date) AS date, CAST(sum(CASE WHEN player_id % 2 = 0 THEN pts ELSE 0 END) AS BIGINT) AS home_pts, CAST(sum(CASE WHEN player_id % 2 = 1 THEN pts ELSE 0 END) AS BIGINT) AS away_pts, bool_or(player_id % 2 = 0) AS h, bool_or(player_id % 2 = 1) AS a FROM player_games GROUP BY 1)
  SELECT game_id, date, 'H' || game_id % 7 AS home, 'A' || game_id % 5 AS away, home_pts, away_pts FROM t WHERE h AND a""")
def game_meta_of_boxes(spark, d):
    """Scores and sides of games from player rows with a matchup text."""
    home = F.col("player_id") % 2 == 0
    own, other = F.concat(F.lit("H"), (F.col("game_id") % 7).cast("string")), F.concat(F.lit("A"), (F.col("game_id") % 5).cast("string"))
    g = A.player_games(spark, d).select("game_id", "date", "pts", F.when(home, own).otherwise(other).alias("team"), F.when(home, F.concat(own, F.lit(" vs. "), other)).otherwise(F.concat(other, F.lit(" @ "), own)).alias("matchup"))
    return X.game_meta(g)


@query(f"""WITH {A.STINTS_SQL}, s AS (SELECT *, sum(home_pts) OVER (PARTITION BY game_id ORDER BY stint_index) AS h, sum(away_pts) OVER (PARTITION BY game_id ORDER BY stint_index) AS a FROM stints) SELECT game_id, max(date) AS date, max(home_id) AS home_id, max(away_id) AS away_id, CAST(max(h) AS BIGINT) AS home_pts, CAST(max(a) AS BIGINT) AS away_pts FROM s GROUP BY 1""")
def game_meta_of_stints(spark, d):
    s = A.stints(spark, d)
    w = "over (partition by game_id order by stint_index)"
    return X.game_meta_of_stints(s.withColumns({"end_home_score": F.expr(f"sum(home_pts) {w}"), "end_away_score": F.expr(f"sum(away_pts) {w}")}))


@query("""WITH n AS (SELECT n_nationkey, n_name, n_regionkey FROM nation), s AS (SELECT s_nationkey AS team_id, 1997 AS season, count(*) AS hustle, max(s_acctbal) AS top FROM supplier WHERE s_suppkey % 2 = 0 GROUP BY 1)
  SELECT o_orderkey, o_custkey % 25 AS home_id, o_orderkey % 25 AS away_id, h.n_name AS home, a.n_name AS away, s.hustle FROM orders JOIN n h ON h.n_nationkey = o_custkey % 25 JOIN n a ON a.n_nationkey = o_orderkey % 25 LEFT JOIN s ON s.team_id = o_custkey % 25 AND s.season = year(o_orderdate)""")
def season_dimensions(spark, d):
    """Games with both teams' names, from one small dimension, and a season's figures of the home team, of one kind of season only."""
    o = A.table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("season"), (F.col("o_custkey") % 25).alias("home_id"), (F.col("o_orderkey") % 25).alias("away_id"))
    names = A.table(spark, d, "nation").select(F.col("n_nationkey").alias("team_id"), F.col("n_name").alias("abbr"))
    kinds = A.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("team_id"), F.when(F.col("s_suppkey") % 2 == 0, "Regular Season").otherwise("Playoffs").alias("season_type")).agg(F.count("*").alias("hustle")).withColumn("season", F.lit(1997))
    out = X.with_season_figures(X.with_team_names(o, names), kinds, {"home_id": "team_id"}, "Regular Season")
    return out.select("o_orderkey", "home_id", "away_id", F.col("home_abbr").alias("home"), F.col("away_abbr").alias("away"), "hustle")


@query(f"""WITH {A.PLAYER_GAMES_SQL}, p AS (SELECT player_id, year(date) AS season, count(*) AS picked FROM player_games WHERE pts >= 20 GROUP BY 1, 2), v AS (SELECT player_id, year(date) AS season, count(*) AS season_games, avg(reb) AS per_game, CAST(sum(ast) AS DOUBLE) AS total FROM player_games GROUP BY 1, 2)
  SELECT player_id, CAST(sum(picked) AS BIGINT) AS games, round(sum(per_game * picked), 6) AS per_game, round(sum(total * picked / season_games), 6) AS total FROM p LEFT JOIN v USING (player_id, season) GROUP BY 1""")
def prorated_seasons(spark, d):
    g = A.player_games(spark, d).withColumn("season", F.year("date"))
    values = g.groupBy("player_id", "season").agg(F.count("*").alias("season_games"), F.avg("reb").alias("per_game"), F.sum("ast").cast("double").alias("total"))
    return search.prorated(g.where("pts >= 20"), values, ["per_game"], ["total"]).withColumns(r6("per_game", "total"))


@query(f"""WITH {A.PLAYER_GAMES_SQL} SELECT round(avg(minutes), 6) AS minutes_mean, round(avg(CASE WHEN reb > 5 THEN reb END), 6) AS reb_mean, count(*) AS rows, string_agg(DISTINCT CAST(team_id AS VARCHAR), ',' ORDER BY CAST(team_id AS VARCHAR)) AS teams FROM player_games""")
def population_statistics(spark, d):
    g = A.player_games(spark, d).withColumn("reb", F.when(F.col("reb") > 5, F.col("reb")))
    return audits.population(g, ["minutes", "reb"], "team_id", "teams").withColumns(r6("minutes_mean", "reb_mean"))


@query(f"""WITH {A.PLAYER_GAMES_SQL}, f AS (SELECT player_id, game_id, pts*36.0/nullif(minutes, 0) AS rate FROM player_games) SELECT player_id, game_id, round(rate, 6) AS rate, round(CASE WHEN rate > 30 THEN rate - 30 ELSE 5 - rate END, 6) AS distance FROM f WHERE rate > 30 OR rate < 5""")
def audit_extreme_rates(spark, d):
    g = A.player_games(spark, d).withColumn("rate", F.try_divide(F.col("pts") * 36.0, F.col("minutes")))
    return audits.extremes(g, "rate", 5.0, 30.0).select("player_id", "game_id", *[c.alias(n) for n, c in r6("rate", "distance").items()])


@query("""SELECT c_custkey, c_nationkey % 5 = 0 AS name_missing, c_custkey % 4 = 0 AS birth_missing FROM customer WHERE c_nationkey % 5 = 0 OR c_custkey % 4 = 0""")
def audit_missing_meta(spark, d):
    c = A.table(spark, d, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 5 != 0, F.col("c_name")).alias("name"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal")).alias("birth"))
    return audits.missing(c, ["name", "birth"]).select("c_custkey", "name_missing", "birth_missing")


@query("""WITH m AS (SELECT o_custkey % 40 AS game_id, count(*) FILTER (o_orderkey % 3 = 0) AS missing, count(*) AS rows, sum(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 9 ELSE 0 END) AS weight FROM orders GROUP BY 1) SELECT game_id, missing, rows, CAST(weight AS BIGINT) AS weight FROM m WHERE missing > 0 ORDER BY missing DESC, weight DESC, game_id LIMIT 25""")
def repair_worklist(spark, d):
    """The 25 games with most rows to repair."""
    o = A.table(spark, d, "orders").select((F.col("o_custkey") % 40).alias("game_id"), F.when(F.col("o_orderkey") % 3 != 0, F.lit(1)).alias("value"), (F.col("o_orderkey") % 9).alias("minutes"))
    return audits.worklist(o, "game_id", F.col("value").isNull(), "minutes", 25).withColumn("weight", F.col("weight").cast("long"))


@query("""WITH b AS (SELECT o_custkey % 40 AS g, count(*) FILTER (o_orderkey % 3 = 0) AS n FROM orders GROUP BY 1), a AS (SELECT o_custkey % 40 AS g, count(*) FILTER (o_orderkey % 6 = 0) AS n FROM orders GROUP BY 1) SELECT g AS game_id, b.n AS before, a.n AS after, a.n < b.n AS better FROM b JOIN a USING (g)""")
def repair_progress(spark, d):
    o = A.table(spark, d, "orders").select((F.col("o_custkey") % 40).alias("game_id"), "o_orderkey")
    return audits.progress(o, o, "game_id", F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 6 == 0)


@query("""SELECT DISTINCT o_custkey AS player_id FROM orders WHERE year(o_orderdate) = 1996 AND o_custkey % 4 <> 0 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey > 5 AND c_acctbal > 0)""")
def incomplete_dimension(spark, d):
    rows = A.table(spark, d, "orders").where("year(o_orderdate) = 1996 and o_custkey % 4 <> 0").select(F.col("o_custkey").alias("player_id"))
    people = A.table(spark, d, "customer").select(F.col("c_custkey").alias("player_id"), F.when(F.col("c_nationkey") > 5, F.col("c_name")).alias("name"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("birth"))
    return audits.incomplete(rows, people, "player_id", ["name", "birth"])


@query(f"""WITH {A.PLAYER_GAMES_SQL} SELECT game_id, player_id, date FROM player_games WHERE year(date) BETWEEN 1994 AND 1996 AND stl BETWEEN 2 AND 6 AND blk >= 1""")
def split_stat_search(spark, d):
    """Games of a range of seasons, open ends allowed, by bounds on chosen figures."""
    g = A.player_games(spark, d).withColumn("season", F.year("date"))
    return search.game_search(search.in_seasons(g, 1994, 1996), search.SearchSpec(bounds=search.split_bounds([("stl", 2, 6), ("blk", 1, None)]))).select("game_id", "player_id", "date")


@query(f"""WITH {A.PLAYER_GAMES_SQL}, h AS (SELECT game_id, max(date) AS date, count(*) AS home FROM player_games WHERE player_id % 2 = 0 AND pts > 15 GROUP BY 1), a AS (SELECT game_id, count(*) AS away FROM player_games WHERE player_id % 2 = 1 AND pts > 25 GROUP BY 1) SELECT game_id, coalesce(home, 0) AS home, coalesce(away, 0) AS away FROM h FULL OUTER JOIN a USING (game_id)""")
def both_sides(spark, d):
    g = A.player_games(spark, d)
    count = lambda r, least, n: g.where((F.col("player_id") % 2 == r) & (F.col("pts") > least)).groupBy("game_id").agg(F.count("*").alias(n))
    return tables.outer_zero(count(0, 15, "home"), count(1, 25, "away"), ["game_id"])


@query("""WITH e AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R'), f AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 30) SELECT l_orderkey FROM e EXCEPT SELECT l_orderkey FROM f""")
def missing_games(spark, d):
    li = A.table(spark, d, "lineitem")
    return tables.absent(li.where("l_returnflag = 'R'"), li.where("l_quantity > 30"), ["l_orderkey"])


@query("""WITH u AS (SELECT l_orderkey, max(l_quantity) AS q FROM lineitem GROUP BY 1 UNION ALL SELECT o_orderkey + 1000000, o_totalprice FROM orders), w AS (SELECT o_orderkey AS k FROM orders UNION ALL SELECT o_orderkey + 1000000 FROM orders WHERE o_orderkey % 2 = 0) SELECT k, q FROM w LEFT JOIN u ON l_orderkey = k""")
def join_of_union(spark, d):
    li, o = A.table(spark, d, "lineitem"), A.table(spark, d, "orders")
    first = li.groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_quantity").alias("q"))
    second = o.select((F.col("o_orderkey") + 1000000).alias("k"), F.col("o_totalprice").alias("q"))
    wanted = o.select(F.col("o_orderkey").alias("k")).unionByName(o.where("o_orderkey % 2 = 0").select((F.col("o_orderkey") + 1000000).alias("k")))
    return tables.left_of_union(wanted, [first, second], ["k"])


@query(f"""WITH {PBP_SQL}, s AS (SELECT game_id, team_id, elapsed AS t0, action_number, CASE WHEN player_id % 3 = 0 THEN player_id END AS a FROM pbp WHERE kind = 'sub'), c AS (SELECT DISTINCT team_id, slot_id, player_id FROM (SELECT team_id, player_id % 10 AS slot_id, player_id FROM pbp WHERE player_id IS NOT NULL UNION ALL SELECT team_id, player_id % 10, player_id + 5 FROM pbp WHERE player_id IS NOT NULL)),
  q AS (SELECT game_id, action_number, team_id, player_id % 10 AS slot_id FROM pbp WHERE kind = 'sub'),
  n AS (SELECT q.game_id, q.action_number, c.player_id, min(p.action_number) AS seen FROM q JOIN c ON c.team_id = q.team_id AND c.slot_id = q.slot_id LEFT JOIN pbp p ON p.game_id = q.game_id AND p.player_id = c.player_id AND p.action_number > q.action_number GROUP BY 1, 2, 3),
  r AS (SELECT *, rank() OVER (PARTITION BY game_id, action_number ORDER BY seen NULLS LAST) AS rk FROM n), w AS (SELECT game_id, action_number, CASE WHEN count(*) = 1 AND max(seen) IS NOT NULL THEN max(player_id) END AS player_id FROM r WHERE rk = 1 GROUP BY 1, 2)
  SELECT * FROM w""")
def resolved_by_presence(spark, d):
    """Candidates for a substitution's player, decided by whose next action comes first, if one alone is first."""
    e = play_by_play(spark, d)
    code = (F.col("player_id") % 10).alias("slot_id")
    acts = e.where("player_id is not null")
    candidates = acts.select("team_id", code, "player_id").unionByName(acts.select("team_id", code, (F.col("player_id") + 5).alias("player_id"))).distinct()
    asked = e.where("kind = 'sub'").select("game_id", "action_number", "team_id", code).join(candidates, ["team_id", "slot_id"]).select("game_id", "action_number", "player_id")
    return sequences.first_proof(asked, acts.select("game_id", "player_id", "action_number"), ["game_id"], "action_number", "player_id")
