"""Registered queries over the driver's tables, each beside its DuckDB twin."""

from __future__ import annotations

import datetime
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from .. import schemas
from ..functions import scalars as S
from ..operators import decay, lineups, sequences, tables
from ..sources import adapters as A
from . import audits, fact_queries, feed_queries, game_queries, messy_queries, rating_queries, ridge, rule_queries, search, span_queries, stream_queries  # noqa: F401
from .registry import QUERIES, SQL, query, r6, rsql

# --- lineups ---------------------------------------------------------------------------------------------------

_GROUP_SQL = """SELECT team_id, group_id, CAST(count(DISTINCT game_id) AS BIGINT) AS games, count(*) AS stints, {seconds}, round(sum(seconds)/60.0, 6) AS minutes, round(sum(seconds)/24.0, 6) AS poss_est,
  round(sum(pf-pa)*100.0/(sum(seconds)/24.0), 6) AS net_rating, round(round(sum(pf_adj-pa_adj), 6)*100.0/(sum(seconds)/24.0), 6) AS net_rating_adj,
  round(round(sum(pf_adj-pa_adj), 6)*100.0/(sum(seconds)/24.0) - sum(pf-pa)*100.0/(sum(seconds)/24.0), 6) AS net_rating_delta FROM g GROUP BY team_id, group_id""".format(seconds="round(sum(seconds), 6) AS seconds")
_RATED = ("seconds", "minutes", "poss_est", "net_rating", "net_rating_adj", "net_rating_delta")


def _groups(k: int, unnest: str):
    sql = f"WITH {A.SIDES_SQL}, g AS (SELECT team_id, game_id, seconds, pf, pa, pf_adj, pa_adj, {unnest} AS group_id FROM sides) {_GROUP_SQL}"
    return sql, lambda spark, d: lineups.group_ratings(lineups.by_side(A.stints(spark, d)), k).withColumns(r6(*_RATED))


for _name, _k, _unnest in (
    ("lineup_ratings", 5, "array_to_string(lineup, '-')"),
    ("pair_ratings", 2, "unnest(flatten([[lineup[i]::VARCHAR || '-' || lineup[j]::VARCHAR for j in range(i+1, 6)] for i in range(1, 5)]))"),
    ("trio_ratings", 3, "unnest(flatten(flatten([[[lineup[i]::VARCHAR || '-' || lineup[j]::VARCHAR || '-' || lineup[k]::VARCHAR for k in range(j+1, 6)] for j in range(i+1, 5)] for i in range(1, 4)])))"),
):
    SQL[_name], QUERIES[_name] = _groups(_k, _unnest)

_ONOFF_SQL = f"""WITH {A.SIDES_SQL}, p AS (SELECT game_id, team_id, pf, pa, seconds, unnest(lineup) AS player_id FROM sides),
  t AS (SELECT game_id, team_id, sum(pf) AS tf, sum(pa) AS ta, sum(seconds) AS ts FROM sides GROUP BY 1, 2),
  o AS (SELECT game_id, team_id, player_id, sum(pf) AS on_pf, sum(pa) AS on_pa, sum(seconds) AS on_seconds FROM p GROUP BY 1, 2, 3)
  SELECT game_id, team_id, player_id, {{cols}} FROM o JOIN t USING (game_id, team_id)"""


@query(_ONOFF_SQL.format(cols="CAST(on_pf AS DOUBLE) AS on_pf, CAST(on_pa AS DOUBLE) AS on_pa, CAST(on_seconds AS DOUBLE) AS on_seconds, CAST(tf-on_pf AS DOUBLE) AS off_pf, CAST(ta-on_pa AS DOUBLE) AS off_pa, CAST(ts-on_seconds AS DOUBLE) AS off_seconds, CAST(on_pf-on_pa-(tf-on_pf-ta+on_pa) AS DOUBLE) AS on_off_diff"))
def on_off_by_game(spark, d):
    return lineups.on_off(lineups.by_side(A.stints(spark, d))).select("game_id", "team_id", "player_id", *[F.col(c).cast("double") for c in ("on_pf", "on_pa", "on_seconds", "off_pf", "off_pa", "off_seconds", "on_off_diff")])


@query(f"WITH {A.SIDES_SQL} SELECT player_id, round(sum(seconds), 6) AS seconds FROM (SELECT seconds, unnest(lineup) AS player_id FROM sides) GROUP BY player_id")
def time_on_court(spark, d):
    return lineups.time_on_court(lineups.by_side(A.stints(spark, d))).withColumns(r6("seconds"))


@query(f"WITH {A.SIDES_SQL}, p AS (SELECT player_id, team_id, sum(seconds) AS s FROM (SELECT team_id, seconds, unnest(lineup) AS player_id FROM sides) GROUP BY 1, 2) SELECT player_id, team_id FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY s DESC, team_id DESC) AS rn FROM p) WHERE rn = 1")
def primary_team(spark, d):
    return lineups.primary_team(lineups.by_side(A.stints(spark, d)))


@query(f"WITH {A.POSS_SQL} SELECT game_id, player_id, count(*) AS possessions FROM (SELECT DISTINCT game_id, poss_index, unnest(off_lineup) AS player_id FROM possessions) WHERE player_id > 0 GROUP BY 1, 2")
def offensive_possessions(spark, d):
    return lineups.possession_counts(A.possessions(spark, d))


@query(f"""WITH {A.POSS_SQL}, seen AS (SELECT DISTINCT game_id, unnest(list_concat(off_lineup, def_lineup)) AS player_id FROM possessions),
  o AS (SELECT game_id, player_id, count(*) AS n FROM (SELECT DISTINCT game_id, poss_index, unnest(off_lineup) AS player_id FROM possessions) WHERE player_id > 0 GROUP BY 1, 2)
  SELECT game_id, player_id, CAST(coalesce(n, 0) AS BIGINT) AS possessions FROM seen LEFT JOIN o USING (game_id, player_id)""")
def presence_possessions(spark, d):
    return lineups.presence_counts(A.possessions(spark, d))


@query(f"""WITH {A.STINTS_SQL}, e AS (SELECT *, unnest(list_concat([(x, 1.0) for x in home_lineup], [(x, -1.0) for x in away_lineup])) AS e FROM stints)
  SELECT game_id, stint_index, e[1] AS player_id, CAST(e[2] AS DOUBLE) AS sign, round((home_pts-away_pts)/greatest(seconds/24.0, 0.1)*100, 6) AS y, round(sqrt(greatest(seconds/24.0, 0.1)), 6) AS w FROM e""")
def design_rows(spark, d):
    return lineups.design_rows(A.stints(spark, d)).withColumns(r6("y", "w"))


@query()
def lineup_ridge(spark, d):
    return ridge.ridge_fit(lineups.margin_design(A.stints(spark, d)))


_GAMES_ONOFF = _ONOFF_SQL.format(cols="on_seconds/60.0 AS minutes_on, on_pf-on_pa AS on_diff, tf-on_pf-ta+on_pa AS off_diff")


@query(f"""SELECT team_id, player_id, games, {rsql("minutes_on", "minutes_off", "on_diff", "off_diff")}, CASE WHEN minutes_on > 0 THEN round(on_diff*48/minutes_on, 6) END AS on_per_48, CASE WHEN minutes_off > 0 THEN round(off_diff*48/minutes_off, 6) END AS off_per_48
  FROM (SELECT team_id, player_id, count(*) AS games, sum(minutes_on) AS minutes_on, sum(greatest(tm - minutes_on, 0)) AS minutes_off, sum(on_diff) AS on_diff, sum(off_diff) AS off_diff
  FROM (SELECT *, sum(minutes_on) OVER (PARTITION BY game_id, team_id)/5 AS tm FROM ({_GAMES_ONOFF})) GROUP BY team_id, player_id)""")
def season_on_off(spark, d):
    games = lineups.on_off(lineups.by_side(A.stints(spark, d))).withColumns({"minutes_on": F.col("on_seconds") / 60.0, "season": F.lit("all")})
    return lineups.per_48(lineups.season_on_off(games)).select("team_id", "player_id", "games", *[c.alias(n) for n, c in r6("minutes_on", "minutes_off", "on_diff", "off_diff", "on_per_48", "off_per_48").items()])


# --- shots and decayed state -----------------------------------------------------------------------------------


@query(f"""WITH {A.SHOTS_SQL}, g AS (SELECT player_id, game_id, count(*) AS a, sum(made) AS m FROM shots GROUP BY 1, 2),
  c AS (SELECT *, sum(a) OVER (PARTITION BY player_id ORDER BY game_id) AS c FROM g)
  SELECT x.player_id, x.game_id, x.a AS attempts, CAST(x.m AS BIGINT) AS makes, round(coalesce(sum(y.a * power(2.0, (y.c - (x.c - x.a))/1000.0)), 0), 6) AS a_before, round(coalesce(sum(y.m * power(2.0, (y.c - (x.c - x.a))/1000.0)), 0), 6) AS m_before
  FROM c x LEFT JOIN c y ON y.player_id = x.player_id AND y.game_id < x.game_id GROUP BY ALL""")
def decayed_state(spark, d):
    games = A.shots(spark, d).groupBy("player_id", "game_id").agg(F.count("*").alias("attempts"), F.sum("made").alias("makes"))
    return decay.decayed_before(games, "player_id", ["game_id"], "attempts", "makes").withColumns(r6("a_before", "m_before"))


@query(f"""WITH {A.SHOTS_SQL}, s AS (SELECT player_id, count(*) AS a, sum(made) AS m, avg(CAST(assisted AS DOUBLE)) AS mix FROM shots GROUP BY 1)
  SELECT player_id, a AS attempts, CAST(m AS BIGINT) AS makes, round((m + (200 + 100*least(a/1000.0, 1))*(0.32 + 0.04*least(a/1000.0, 1)))/(a + 200 + 100*least(a/1000.0, 1)), 6) AS rate,
  round(greatest(least((m + (200 + 100*least(a/1000.0, 1))*(0.32 + 0.04*least(a/1000.0, 1)))/(a + 200 + 100*least(a/1000.0, 1)), 0.55), 0.15), 6) AS clamped FROM s""")
def shrunk_rates(spark, d):
    s = A.shots(spark, d).groupBy("player_id").agg(F.count("*").alias("attempts"), F.sum("made").alias("makes"))
    rate = S.shrunk_rate(F.col("makes"), F.col("attempts"), *S.sliding_prior(F.col("attempts")))
    return s.withColumns({"rate": F.round(rate, 6), "clamped": F.round(S.clamp(rate, 0.15, 0.55), 6)})


@query(f"""WITH {A.SHOTS_SQL}, r AS (SELECT type, avg(CAST(made AS DOUBLE)) AS rate FROM shots GROUP BY 1)
  SELECT game_id, player_id, count(*) AS shots, CAST(sum(made) AS BIGINT) AS made, round(sum(rate), 6) AS expected, round((sum(made) - sum(rate)) * (3 - 0.25), 6) AS luck FROM shots JOIN r USING (type) GROUP BY 1, 2""")
def shot_luck(spark, d):
    s = A.shots(spark, d)
    rates = s.groupBy("type").agg(F.avg(F.col("made").cast("double")).alias("rate"))
    out = s.join(F.broadcast(rates), "type").groupBy("game_id", "player_id").agg(F.count("*").alias("shots"), F.sum("made").alias("made"), F.sum("rate").alias("expected"))  # one row per event type
    return out.withColumn("luck", F.round((F.col("made") - F.col("expected")) * (3 - 0.25), 6)).withColumns(r6("expected"))


@query(f"""WITH {A.SHOTS_SQL}, g AS (SELECT player_id, game_id, sum(2*made-1) AS delta FROM shots GROUP BY 1, 2), f AS (SELECT * FROM g WHERE abs(delta) >= 2)
  SELECT * FROM (SELECT game_id, player_id, CAST(delta AS BIGINT) AS delta, row_number() OVER (PARTITION BY game_id ORDER BY abs(delta) DESC, player_id) AS rank FROM f) WHERE rank <= 2""")
def biggest_swings(spark, d):
    g = A.shots(spark, d).groupBy("player_id", "game_id").agg(F.sum(2 * F.col("made") - 1).alias("delta"))
    return tables.top_n(g, ["game_id"], [F.abs("delta").desc(), F.col("player_id")], 2, F.abs("delta") >= 2).select("game_id", "player_id", "delta", "rank")


@query(f"""WITH {A.SHOTS_SQL}, s AS (SELECT player_id, month(ts)*0 + dayofmonth(game_id) AS season, count(*) AS a, sum(made) AS m FROM shots GROUP BY 1, 2),
  w AS (SELECT *, exp(-ln(2)/2.0*(max(season) OVER (PARTITION BY player_id) - season)) AS w FROM s), t AS (SELECT player_id, sum(w*a) AS attempts, sum(w*m) AS makes FROM w GROUP BY 1)
  SELECT player_id, {rsql("attempts", "makes")}, round((72 + makes)/(200 + attempts), 6) AS mean FROM t""")
def posterior(spark, d):
    s = A.shots(spark, d).groupBy("player_id", F.dayofmonth("game_id").alias("season")).agg(F.count("*").alias("a"), F.sum("made").alias("m"))
    return decay.posterior_table(s, "player_id", "season", "a", "m", 0.36, 200.0).select("player_id", *[c.alias(n) for n, c in r6("attempts", "makes", "mean").items()])


@query(f"""WITH {A.PLAYER_GAMES_SQL} , rows_of AS (SELECT CAST(fgm AS DOUBLE)/fga AS x, CAST(pts AS DOUBLE) AS y, minutes*minutes AS w, minutes AS v FROM player_games),
  line AS (SELECT (s*sxy - sx*sy)/(s*sxx - sx*sx) AS a, (sy - (s*sxy - sx*sy)/(s*sxx - sx*sx)*sx)/s AS b FROM (SELECT sum(w) AS s, sum(w*x) AS sx, sum(w*y) AS sy, sum(w*x*x) AS sxx, sum(w*x*y) AS sxy FROM rows_of)),
  mean AS (SELECT sum(v*y)/sum(v) AS m FROM rows_of)
  SELECT round(max(a), 6) AS slope, round(max(b), 6) AS intercept, round(1 - sum(v*(y - a*x - b)*(y - a*x - b))/sum(v*(y - m)*(y - m)), 6) AS r2 FROM rows_of, line, mean""")
def weighted_line(spark, d):
    rows = A.player_games(spark, d).select((F.col("fgm") / F.col("fga")).alias("x"), F.col("pts").cast("double").alias("y"), F.col("minutes").alias("w"))
    return decay.weighted_line(rows, "x", "y", "w").withColumns(r6("slope", "intercept", "r2"))


# --- sequences -------------------------------------------------------------------------------------------------


@query("""SELECT user_id, island, count(*) AS n, min(event_id) AS first_event, max(event_type) AS event_type FROM (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM (
  SELECT user_id, event_id, event_type, ts, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type THEN 0 ELSE 1 END AS c FROM events)) GROUP BY 1, 2""".replace("island, count", "CAST(island AS BIGINT) AS island, count"))
def event_islands(spark, d):
    e = sequences.islands(A.table(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], "event_type")
    return e.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"), F.max("event_type").alias("event_type"))


@query("""SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, round(sum(value), 6) AS points FROM (SELECT *, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS session FROM events) GROUP BY 1, 2""")
def event_sessions(spark, d):
    e = sequences.sessions(A.table(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], F.col("event_type") == "purchase")
    return e.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("points"))


@query("""WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'click' THEN value END AS v FROM events)
  SELECT event_id, round(coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS v FROM e""")
def filled_scores(spark, d):
    e = A.table(spark, d, "events").select("event_id", "user_id", "ts", F.when(F.col("event_type") == "click", F.col("value")).alias("v"))
    return sequences.fill_both(e, ["user_id"], [F.col("ts"), F.col("event_id")], "v").select("event_id", F.round("v", 6).alias("v"))


@query("SELECT event_id, round(value - coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0), 6) AS change FROM events")
def score_deltas(spark, d):
    return sequences.deltas(A.table(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], "value", "change").select("event_id", F.round("change", 6).alias("change"))


_INTERVALS = """iv AS (SELECT l_orderkey AS k, CAST(l_linenumber AS DOUBLE) * 10 AS s, CAST(l_linenumber AS DOUBLE) * 10 + max(l_quantity) AS e FROM lineitem GROUP BY 1, 2), pt AS (SELECT l_orderkey AS k, CAST(l_partkey % 90 AS DOUBLE) AS t, CAST(l_suppkey % 4 AS DOUBLE) AS v FROM lineitem)"""


def _intervals(spark, d):
    li = A.table(spark, d, "lineitem")
    iv = li.groupBy(F.col("l_orderkey").alias("k"), "l_linenumber").agg(F.max("l_quantity").alias("q")).select("k", (F.col("l_linenumber") * 10.0).alias("s"), (F.col("l_linenumber") * 10.0 + F.col("q")).alias("e"))
    return iv, li.select(F.col("l_orderkey").alias("k"), (F.col("l_partkey") % 90).cast("double").alias("t"), (F.col("l_suppkey") % 4).cast("double").alias("v"))


@query(f"WITH {_INTERVALS} SELECT iv.k, s, e, count(*) AS n FROM iv JOIN pt ON iv.k = pt.k AND t > s AND t <= e GROUP BY 1, 2, 3")
def interval_hits(spark, d):
    iv, pt = _intervals(spark, d)
    return sequences.interval_join(pt, iv, ["k"], "t", "s", "e").groupBy("k", "s", "e").agg(F.count("*").alias("n"))


@query(f"WITH {_INTERVALS} SELECT iv.k, s, e, coalesce(sum(v), 0) AS v FROM iv LEFT JOIN pt ON iv.k = pt.k AND t > s AND t <= e GROUP BY 1, 2, 3")
def interval_points(spark, d):
    iv, pt = _intervals(spark, d)
    return sequences.interval_sums(iv, pt, ["k"], "t", "s", "e", "v")


@query("""WITH e AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'error') SELECT e.user_id, e.event_id, min(p.event_id) AS next_id FROM e LEFT JOIN (SELECT user_id, event_id FROM events WHERE event_type = 'click') p ON p.user_id = e.user_id AND p.event_id > e.event_id GROUP BY 1, 2""")
def next_click(spark, d):
    e = A.table(spark, d, "events")
    clicks = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("next_id"), F.col("ts").alias("next_ts"))
    errors = e.where("event_type = 'error'").select("user_id", "event_id")
    return sequences.first_after(errors, clicks, ["user_id"], "event_id", "next_id", "next_ts").select("user_id", "event_id", "next_id")


# --- tables ----------------------------------------------------------------------------------------------------


@query("""SELECT * EXCLUDE (rn) FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS rn FROM lineitem) WHERE rn = 1""")
def dedupe_lines(spark, d):
    li = A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return tables.pick_one(li, ["l_orderkey", "l_linenumber"], [F.col("l_partkey"), F.col("l_suppkey")])


@query("""SELECT CAST(count(*) AS BIGINT) AS kept, CAST(sum(n) AS BIGINT) AS total, CAST(sum(n) - count(*) AS BIGINT) AS removed FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)""")
def dedupe_report(spark, d):
    return audits.dedupe_report(A.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT o_orderkey, o_custkey, o_totalprice * 2 FROM orders WHERE o_orderkey % 5 = 0""")
def upsert_orders(spark, d):
    o = A.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return tables.upsert(o, o.where("o_orderkey % 5 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 2), ["o_orderkey"], [F.col("o_totalprice")])


@query("""SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_partkey % 50 = 0) UNION ALL SELECT l_orderkey, l_partkey, -l_quantity FROM lineitem WHERE l_partkey % 50 = 0""")
def replace_touched_games(spark, d):
    li = A.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return tables.replace_groups(li, li.where("l_partkey % 50 = 0").withColumn("l_quantity", -F.col("l_quantity")), ["l_orderkey"])


@query("SELECT CAST(o AS BIGINT) AS old_rows, CAST(n AS BIGINT) AS new_rows, n >= o * 0.9 AS accepted FROM (SELECT count(*) AS o, count(*) FILTER (l_discount < 0.09) AS n FROM lineitem)")
def retention_guard(spark, d):
    li = A.table(spark, d, "lineitem")
    return tables.retention(li, li.where("l_discount < 0.09"))


@query(f"""WITH {A.PLAYER_GAMES_SQL}, u AS (SELECT game_id, player_id, pts, reb, 1 AS p FROM player_games WHERE game_id % 2 = 0 UNION ALL SELECT game_id, player_id, pts + 1, CASE WHEN reb > 6 THEN reb END, 2 FROM player_games WHERE game_id % 3 = 0)
  SELECT game_id, player_id, coalesce(max(pts) FILTER (p = 1), max(pts) FILTER (p = 2)) AS pts, coalesce(max(reb) FILTER (p = 1), max(reb) FILTER (p = 2)) AS reb FROM u GROUP BY 1, 2""")
def priority_merge(spark, d):
    g = A.player_games(spark, d).select("game_id", "player_id", "pts", "reb")
    second = g.where("game_id % 3 = 0").select("game_id", "player_id", (F.col("pts") + 1).alias("pts"), F.when(F.col("reb") > 6, F.col("reb")).alias("reb"))
    return tables.first_by_priority(tables.priority_union([g.where("game_id % 2 = 0"), second]), ["game_id", "player_id"], ["pts", "reb"], 2)


@query("""SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS returned, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) AS large FROM orders""")
def exists_flags(spark, d):
    li = A.table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return tables.flag_exists(A.table(spark, d, "orders").select("o_orderkey"), {"returned": li.where("l_returnflag = 'R'"), "large": li.where("l_quantity > 45")}, ["o_orderkey"])


@query("""SELECT CAST(count(*) AS BIGINT) AS wanted, CAST(count(l_orderkey) AS BIGINT) AS covered, count(l_orderkey) / count(*) AS ratio, count(l_orderkey) / count(*) >= 0.98 AS passed FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON o_orderkey = l_orderkey""")
def coverage(spark, d):
    li = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return tables.coverage_gate(A.table(spark, d, "orders"), li, ["o_orderkey"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 40 = 39 THEN c_custkey ELSE c_custkey - c_custkey % 40 END AS canonical FROM customer")
def canonical_ids(spark, d):
    """Chains of up to 38 links, with repeated rows; two ids of every forty stay as they are."""
    c = A.table(spark, d, "customer").select("c_custkey", F.col("c_custkey").alias("canonical"))
    remap = c.where("c_custkey % 40 between 1 and 38").select(F.col("c_custkey").alias("old_id"), (F.col("c_custkey") - 1).alias("new_id"))
    return tables.follow_remap(c, "canonical", remap.unionByName(remap.where("old_id % 3 = 0")))


@query("""SELECT CAST(count(*) AS BIGINT) AS n, round(avg(x), 6) AS mean_abs, round(max(x), 6) AS max_abs, round(avg(CASE WHEN x = 0 THEN 1.0 ELSE 0 END), 6) AS exact_rate, round(avg(CASE WHEN x <= 100000 THEN 1.0 ELSE 0 END), 6) AS near_rate
  FROM (SELECT abs(s - o_totalprice) AS x FROM (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1) JOIN orders ON l_orderkey = o_orderkey)""")
def reconciliation(spark, d):
    ours = A.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_extendedprice").alias("price"))
    official = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"))
    return tables.reconcile_summary(tables.reconcile(ours, official, ["k"], ["price"]), "price", 100000).withColumns(r6("mean_abs", "max_abs", "exact_rate", "near_rate"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS game_id, s_name AS name, CAST(NULL AS DOUBLE) AS minutes FROM supplier")
def conform_schema(spark, d):
    schema = StructType([StructField("game_id", StringType()), StructField("name", StringType()), StructField("minutes", DoubleType())])
    return schemas.conform(A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("game_id"), F.col("s_name").alias("name")), schema)


@query("SELECT CAST(o_orderkey AS BIGINT) AS id FROM orders")
def optional_source(spark, d):
    schema = StructType([StructField("id", LongType())])
    return schemas.empty(spark, schema).unionByName(A.table(spark, d, "orders").select(F.col("o_orderkey").alias("id")))


# --- scalars ---------------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, CASE WHEN month(o_orderdate) >= 10 THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END || '-' || lpad(CAST((CASE WHEN month(o_orderdate) >= 10 THEN year(o_orderdate) + 1 ELSE year(o_orderdate) END) % 100 AS VARCHAR), 2, '0') AS season_oct,
  CASE WHEN month(o_orderdate) >= 7 THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END || '-' || lpad(CAST((CASE WHEN month(o_orderdate) >= 7 THEN year(o_orderdate) + 1 ELSE year(o_orderdate) END) % 100 AS VARCHAR), 2, '0') AS season_jul,
  lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS padded, CASE WHEN o_orderkey = 0 THEN '' ELSE CAST(o_orderkey AS VARCHAR) END AS game_key, date_diff('year', DATE '1970-06-15', CAST(o_orderdate AS DATE)) - CASE WHEN month(o_orderdate) < 6 OR (month(o_orderdate) = 6 AND day(o_orderdate) < 15) THEN 1 ELSE 0 END AS age FROM orders""")
def season_labels(spark, d):
    date = F.to_date("o_orderdate")
    return A.table(spark, d, "orders").select("o_orderkey", S.season_label(date, 10).alias("season_oct"), S.season_label(date, 7).alias("season_jul"), S.padded_game_key(F.col("o_orderkey")).alias("padded"), S.game_key(F.col("o_orderkey")).alias("game_key"), S.age_at(F.lit(datetime.date(1970, 6, 15)), date).cast("long").alias("age"))


@query("""WITH c AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_partkey % 12 AS VARCHAR) || ':' || lpad(CAST(l_suppkey % 60 AS VARCHAR), 2, '0') AS clock, CAST((l_partkey % 12) * 60 + l_suppkey % 60 AS DOUBLE) AS remaining FROM lineitem)
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, remaining, CAST(CASE WHEN l_linenumber <= 4 THEN l_linenumber * 720 ELSE 2880 + (l_linenumber - 4) * 300 END - remaining AS DOUBLE) AS elapsed, remaining / 60 AS minutes FROM c""")
def clocks(spark, d):
    li = A.table(spark, d, "lineitem").withColumn("clock", F.concat((F.col("l_partkey") % 12).cast("string"), F.lit(":"), F.lpad((F.col("l_suppkey") % 60).cast("string"), 2, "0")))
    left = S.clock_seconds(F.col("clock"))
    return li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", left.alias("remaining"), S.elapsed_seconds(F.col("l_linenumber"), left).cast("double").alias("elapsed"), S.minutes_value(F.col("clock")).alias("minutes"))


@query("""SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS name_key, length(trim(p_name)) + CASE WHEN contains(trim(p_name), ' ') THEN 100 ELSE 0 END AS name_score, CASE WHEN contains(lower(p_name), 'ring') THEN 'ring' WHEN contains(lower(p_name), 'widget') THEN 'widget' ELSE 'other' END AS kind,
  CASE WHEN contains(lower(p_type), 'corner') THEN 'corner' ELSE 'above_break' END AS area FROM part""")
def text_classes(spark, d):
    p = A.table(spark, d, "part")
    return p.select("p_partkey", S.name_key(F.col("p_name")).alias("name_key"), S.name_score(F.col("p_name")).cast("long").alias("name_score"), S.keyword_class(F.col("p_name"), [("ring", "ring"), ("widget", "widget")], "other").alias("kind"), S.shot_area(F.lit(None).cast("double"), F.lit(None).cast("double"), F.col("p_type")).alias("area"))


@query(f"""WITH {A.PLAYER_GAMES_SQL} SELECT game_id, player_id, round(CASE WHEN fga + 0.44*fta <> 0 THEN pts/(2*(fga + 0.44*fta)) END, 6) AS ts, round(CASE WHEN fga <> 0 THEN CAST(fgm AS DOUBLE)/fga END, 6) AS fg_pct,
  (CASE WHEN pts >= 10 THEN 1 ELSE 0 END + CASE WHEN reb >= 10 THEN 1 ELSE 0 END + CASE WHEN ast >= 10 THEN 1 ELSE 0 END + CASE WHEN stl >= 10 THEN 1 ELSE 0 END + CASE WHEN blk >= 10 THEN 1 ELSE 0 END) >= 2 AS double_double,
  round(CASE WHEN minutes > 0 THEN pts*36/minutes END, 6) AS pts_36 FROM player_games""")
def derived_box(spark, d):
    c = F.col
    return A.player_games(spark, d).select("game_id", "player_id", F.round(S.true_shooting(c("pts"), c("fga"), c("fta")), 6).alias("ts"), F.round(S.ratio(c("fgm"), c("fga")), 6).alias("fg_pct"), S.many_doubles([c(x) for x in ("pts", "reb", "ast", "stl", "blk")], 2).alias("double_double"), F.round(S.rate(c("pts"), "per_36", minutes=c("minutes")), 6).alias("pts_36"))


# --- search ----------------------------------------------------------------------------------------------------


def _hits(spark, d):
    return search.game_search(A.player_games(spark, d), search.SearchSpec(bounds={"pts": (20, None), "reb": (2, 20)}, formulas=[("pts", "/", "fga", ">=", 1.0)]))


_HITS = f"WITH {A.PLAYER_GAMES_SQL}, h AS (SELECT * FROM player_games WHERE pts >= 20 AND reb BETWEEN 2 AND 20 AND CAST(pts AS DOUBLE)/fga >= 1.0)"


@query(_HITS + " SELECT game_id, player_id, team_id, pts, reb FROM h")
def game_search(spark, d):
    return _hits(spark, d).select("game_id", "player_id", "team_id", "pts", "reb")


@query(_HITS + " SELECT game_id, player_id FROM (SELECT *, count(*) OVER (PARTITION BY game_id) AS n FROM h) WHERE n >= 2")
def game_search_company(spark, d):
    return search.with_company(_hits(spark, d), 2).select("game_id", "player_id")


@query(_HITS + ", t AS (SELECT *, count(*) OVER (PARTITION BY game_id, team_id) AS n FROM h) SELECT game_id, player_id FROM t WHERE n >= 1 AND game_id IN (SELECT game_id FROM t GROUP BY game_id HAVING count(DISTINCT team_id) >= 2)")
def game_search_each_team(spark, d):
    return search.with_company(_hits(spark, d), 1, "each").select("game_id", "player_id")


@query(_HITS + " SELECT game_id, team_id, count(*) AS players, string_agg(CAST(player_id AS VARCHAR), ',' ORDER BY player_id) AS player_ids FROM h GROUP BY 1, 2")
def team_games(spark, d):
    return search.team_games(_hits(spark, d))


@query(f"""WITH {A.PLAYER_GAMES_SQL}, s AS (SELECT player_id, count(*) AS games, sum(minutes) AS minutes, min(date) AS first_date, CAST(sum(pts) AS BIGINT) AS pts, CAST(sum(fga) AS BIGINT) AS fga, CAST(sum(fgm) AS BIGINT) AS fgm FROM player_games WHERE pts >= 5 GROUP BY 1)
  SELECT player_id, games, round(minutes, 6) AS minutes, first_date, round(CASE WHEN games > 0 THEN CAST(pts AS DOUBLE)/games END, 6) AS pts, fga, round(CAST(fgm AS DOUBLE)/fga, 6) AS fg_pct FROM s WHERE CAST(pts AS DOUBLE)/games >= 20""")
def span_search(spark, d):
    out = search.span_search(A.player_games(spark, d), ["pts", "fga", "fgm"], search.SearchSpec(bounds={"pts": (5, None)}), search.SearchSpec(bounds={"pts": (20, None)}, mode="per_game", rated=("pts",)))
    return out.select("player_id", "games", F.round("minutes", 6).alias("minutes"), "first_date", F.round("pts", 6).alias("pts"), "fga", F.round("fg_pct", 6).alias("fg_pct"))


# --- audits ----------------------------------------------------------------------------------------------------

_RULES_SQL = {"pts_high": "pts > 60", "made_over": "fgm > fga", "no_minutes": "minutes <= 10", "points_formula": "pts <> 2*fgm + fta"}


def _rules():
    return {n: F.expr(e) for n, e in _RULES_SQL.items()}


@query(f"WITH {A.PLAYER_GAMES_SQL} SELECT year(date) AS season, count(*) AS rows, " + ", ".join(f"count(*) FILTER ({e}) AS {n}" for n, e in _RULES_SQL.items()) + " FROM player_games GROUP BY 1")
def audit_rules(spark, d):
    return audits.rule_counts(A.player_games(spark, d), _rules(), [F.year("date").cast("long").alias("season")])


@query(f"WITH {A.PLAYER_GAMES_SQL} SELECT game_id, player_id, " + ", ".join(f"({e}) AS {n}" for n, e in _RULES_SQL.items()) + " FROM player_games WHERE " + " OR ".join(_RULES_SQL.values()))
def audit_violations(spark, d):
    return audits.violations(A.player_games(spark, d), _rules(), ["game_id", "player_id"])


@query("""SELECT name, count(*) AS n_values, string_agg(v, ',' ORDER BY v) AS "values" FROM (SELECT DISTINCT p_name AS name, CAST(p_partkey AS VARCHAR) AS v FROM part) GROUP BY name HAVING count(*) > 1""")
def audit_name_collisions(spark, d):
    return audits.key_collisions(A.table(spark, d, "part"), F.col("p_name"), F.col("p_partkey"), "name")


@query("""SELECT l_orderkey, l_linenumber, count(*) AS n, string_agg(l_returnflag, ',' ORDER BY l_returnflag) AS sources FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def audit_duplicate_keys(spark, d):
    return audits.duplicate_keys(A.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "l_returnflag")


@query(f"WITH {A.PLAYER_GAMES_SQL} SELECT game_id, count(*) AS rows, CAST(sum(abs(pts - 2*fgm - fta)) AS BIGINT) AS sum_abs, max(abs(pts - 2*fgm - fta)) AS max_abs FROM player_games WHERE abs(pts - 2*fgm - fta) > 8 GROUP BY 1")
def audit_gaps(spark, d):
    return audits.gaps_by_game(A.player_games(spark, d), F.expr("pts - 2*fgm - fta"), 8)


@query("""SELECT o_orderkey, risk, CASE WHEN risk = 0 THEN 'low' WHEN risk <= 2 THEN 'medium' ELSE 'high' END AS bucket FROM (SELECT o_orderkey, CAST(CASE WHEN o_totalprice > 300000 THEN 2 ELSE 0 END + CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 0 END + CASE WHEN o_custkey % 10 = 0 THEN 1 ELSE 0 END AS BIGINT) AS risk FROM orders)""")
def audit_risk(spark, d):
    flags = {"price": F.col("o_totalprice") > 300000, "open": F.col("o_orderstatus") == "P", "tenth": F.col("o_custkey") % 10 == 0}
    return audits.risk_scores(A.table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_custkey"), flags, {"price": 2, "open": 2, "tenth": 1}).select("o_orderkey", F.col("risk").cast("long").alias("risk"), "bucket")


@query()
def audit_sample(spark, d):
    flags = {"price": F.col("o_totalprice") > 300000}
    return audits.sample_per_bucket(audits.risk_scores(A.table(spark, d, "orders"), flags, {"price": 3}).select("o_orderkey", "bucket"), "bucket", "o_orderkey", 20, 7)
