"""Registered queries on the older kind of event feed, each beside its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import feeds, reconstruct
from ..sources import adapters as A
from ..sources.legacy import LEGACY_SQL, legacy_events
from .registry import query, r6

_NAMES = " ".join(f"WHEN {k} THEN '{v}'" for k, v in S.EVENT_NAMES.items())
_FILLED = ", ".join(f"CASE WHEN trim({c}) <> '' AND lower(trim({c})) <> 'nan' THEN trim({c}) END" for c in ("home_text", "visitor_text", "neutral_text"))
_ACTIONS = f"""{LEGACY_SQL}, named AS (SELECT *, CASE event_type {_NAMES} ELSE '' END AS en, coalesce({_FILLED}, '') AS description FROM legacy),
  actions AS (SELECT game_id, event_num, period, 'PT' || lpad(split_part(clock, ':', 1), 2, '0') || 'M' || split_part(clock, ':', 2) || '.00S' AS clock,
    CASE WHEN en IN ('Made Shot', 'Missed Shot') THEN CASE WHEN regexp_matches(lower(description), '3(-| )?pt') THEN '3pt' ELSE '2pt' END WHEN en = 'Free Throw' THEN 'freethrow' WHEN en = 'Jump Ball' THEN 'jumpball' ELSE en END AS action,
    CASE en WHEN 'Made Shot' THEN 'Made' WHEN 'Missed Shot' THEN 'Missed' END AS result, description, CASE WHEN player1_team_id > 0 THEN player1_team_id ELSE player2_team_id END AS team_id, player1_id AS person_id, player2_id AS second_id,
    CASE WHEN contains(score, ' - ') THEN CAST(split_part(score, ' - ', 2) AS INTEGER) END AS score_home, CASE WHEN contains(score, ' - ') THEN CAST(split_part(score, ' - ', 1) AS INTEGER) END AS score_away, name FROM named)"""


def _actions(spark, d):
    return feeds.actions_of_legacy(legacy_events(spark, d))


@query(f"WITH {_ACTIONS} SELECT * FROM actions")
def legacy_actions(spark, d):
    return _actions(spark, d)


@query(f"""WITH {_ACTIONS} SELECT game_id, event_num, regexp_matches(upper(description), '3-?PT') AS three, contains(upper(description), 'AST)') OR second_id > 0 AS assisted, action = 'freethrow' OR contains(lower(description), 'free throw') AS free_throw,
  coalesce(regexp_extract(description, '(\\d+) of (\\d+)', 1) = regexp_extract(description, '(\\d+) of (\\d+)', 2) AND regexp_matches(description, '\\d+ of \\d+'), false) AS last_throw, CASE WHEN lower(description) LIKE 'miss%' THEN 0 ELSE 1 END AS throw_points,
  CASE WHEN contains(lower(description), 'offensive') THEN 'offensive' WHEN contains(lower(description), 'defensive') THEN 'defensive' WHEN team_id = person_id % 10 THEN 'offensive' WHEN person_id IS NOT NULL THEN 'defensive' END AS rebound,
  CASE WHEN contains(lower(description), 'dunk') THEN 'dunk' WHEN contains(lower(description), 'layup') THEN 'layup' WHEN event_num % 9 <= 5 THEN 'other_rim' END AS rim,
  CASE WHEN regexp_matches(lower(description), 'step back|stepback') THEN 'stepback' WHEN regexp_matches(lower(description), 'pullup|pull-up|pull up') THEN 'pullup' WHEN regexp_matches(lower(description), 'running|driving') THEN 'running' ELSE 'catch_shoot' END AS shot_type,
  CASE WHEN abs(event_num % 500 - 250) >= 220 AND person_id * 5 <= 100 THEN 'corner' ELSE 'above_break' END AS area FROM actions""")
def event_classes(spark, d):
    text, c = F.col("description"), F.col
    return _actions(spark, d).select(
        "game_id", "event_num", S.is_three(text).alias("three"), S.is_assisted(text, c("second_id")).alias("assisted"), S.is_free_throw(c("action"), F.lit(None).cast("string"), text).alias("free_throw"), S.last_of_sequence(text).alias("last_throw"), S.free_throw_points(text).alias("throw_points"),
        S.rebound_side(text, c("team_id"), c("person_id") % 10).alias("rebound"), S.rim_class(text, (c("event_num") % 9).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("double")).alias("rim"), S.shot_type(text).alias("shot_type"),
        S.shot_area(c("event_num") % 500 - 250, c("person_id") * 5, F.lit(None).cast("string")).alias("area"),
    )


@query(f"""WITH RECURSIVE {_ACTIONS}, s AS (SELECT game_id, event_num, score_home, score_away, row_number() OVER (PARTITION BY game_id ORDER BY event_num) AS rn FROM actions WHERE score_home IS NOT NULL),
  f AS (SELECT game_id, event_num, rn, score_home AS h, score_away AS a, true AS accepted FROM s WHERE rn = 1 UNION ALL
    SELECT s.game_id, s.event_num, s.rn, CASE WHEN s.score_home >= f.h AND s.score_away >= f.a THEN s.score_home ELSE f.h END, CASE WHEN s.score_home >= f.h AND s.score_away >= f.a THEN s.score_away ELSE f.a END, s.score_home >= f.h AND s.score_away >= f.a FROM f JOIN s ON s.game_id = f.game_id AND s.rn = f.rn + 1)
  SELECT game_id, event_num, accepted FROM f""")
def accepted_scores(spark, d):
    rows = _actions(spark, d).where("score_home is not null").select("game_id", "event_num", "score_home", "score_away")
    return feeds.accepted_scores(rows, ["game_id"], ["event_num"], "score_home", "score_away").select("game_id", "event_num", "accepted")


@query(f"""WITH {_ACTIONS} SELECT game_id, person_id, count(*) AS attempts, count(*) FILTER (result = 'Made') AS makes, arg_min(name, event_num) FILTER (name <> '') AS name, arg_min(team_id, event_num) FILTER (team_id > 0) AS team_id FROM actions WHERE action = '3pt' AND person_id > 0 GROUP BY 1, 2""")
def player_threes(spark, d):
    return feeds.player_threes(_actions(spark, d))


_MADE = "SELECT *, regexp_matches(upper(description), '3-?PT') AS t, contains(upper(description), 'AST)') AS p FROM actions WHERE result = 'Made'"


@query(f"""WITH {_ACTIONS}, m AS ({_MADE}) SELECT game_id, person_id, count(*) FILTER (p AND NOT t) AS assisted_2pm, count(*) FILTER (NOT p AND NOT t) AS unassisted_2pm, count(*) FILTER (p AND t) AS assisted_3pm, count(*) FILTER (NOT p AND t) AS unassisted_3pm, count(*) FILTER (p) AS assisted_fgm, count(*) FILTER (NOT p) AS unassisted_fgm
  FROM m WHERE person_id > 0 GROUP BY 1, 2""")
def creation_makes(spark, d):
    return feeds.creation_makes(_actions(spark, d))


_KIND = "CASE WHEN contains(lower(description), 'dunk') THEN 'dunk' WHEN contains(lower(description), 'layup') THEN 'layup' END"


@query(f"""WITH {_ACTIONS}, m AS ({_MADE}), k AS (SELECT CAST(CAST(game_id AS BIGINT) % 5 AS BIGINT) AS season, second_id AS player_id, {_KIND} AS k FROM m WHERE NOT t AND second_id > 0),
  g AS (SELECT CAST(CAST(game_id AS BIGINT) % 5 AS BIGINT) AS season, person_id AS player_id, count(DISTINCT game_id) AS season_games FROM actions GROUP BY 1, 2),
  r AS (SELECT season, player_id, count(*) FILTER (k = 'layup') AS layup_assists_created, count(*) FILTER (k = 'dunk') AS dunk_assists_created, count(*) FILTER (k IS NOT NULL) AS rim_assists_strict FROM k GROUP BY 1, 2)
  SELECT season, player_id, layup_assists_created, dunk_assists_created, rim_assists_strict, season_games, round(CAST(rim_assists_strict AS DOUBLE) / season_games, 6) AS rim_assists_strict_per_game FROM r LEFT JOIN g USING (season, player_id)""")
def rim_assists(spark, d):
    actions = _actions(spark, d)
    season = (F.col("game_id").cast("long") % 5).alias("season")
    games = actions.groupBy(season, F.col("person_id").alias("player_id")).agg(F.countDistinct("game_id").alias("season_games"))
    out = feeds.rim_assists(actions, actions.select("game_id", season).distinct(), games)
    return out.select("season", "player_id", "layup_assists_created", "dunk_assists_created", "rim_assists_strict", "season_games", F.round("rim_assists_strict_per_game", 6).alias("rim_assists_strict_per_game"))


@query(f"""WITH {_ACTIONS}, o AS (SELECT lpad(ltrim(game_id, '0'), 10, '0') AS game_id, event_num, period, CASE WHEN event_num % 7 = 0 THEN clock || 'x' ELSE clock END AS clock, CASE WHEN person_id % 5 = 0 THEN 0 ELSE person_id END AS person_id FROM actions WHERE event_num % 11 <> 0)
  SELECT count(*) AS wanted, count(o.event_num) AS matched, count(*) FILTER (a.period = o.period) AS same_period, count(*) FILTER (a.clock = o.clock) AS same_clock, count(*) FILTER (a.person_id = o.person_id) AS same_person_id FROM actions a LEFT JOIN o ON o.game_id = a.game_id AND o.event_num = a.event_num""")
def feed_agreement(spark, d):
    a = _actions(spark, d).select(S.padded_game_key(F.col("game_id")).alias("game_id"), "event_num", "period", "clock", "person_id")
    other = a.where("event_num % 11 <> 0").withColumns({"clock": F.when(F.col("event_num") % 7 == 0, F.concat("clock", F.lit("x"))).otherwise(F.col("clock")), "person_id": F.when(F.col("person_id") % 5 == 0, 0).otherwise(F.col("person_id"))})
    return feeds.agreement(a, other, ["game_id", "event_num"], ["period", "clock", "person_id"])


@query("""WITH p AS (SELECT c_nationkey AS team_id, c_custkey AS player_id, CASE c_custkey % 3 WHEN 0 THEN 'Al' || c_custkey % 50 || ' Stone Jr.' WHEN 1 THEN 'B.J. Ray' || c_custkey % 90 ELSE 'Solo' || c_custkey % 40 END AS name FROM customer),
  w AS (SELECT *, [x for x in [regexp_replace(lower(y), '[^a-z0-9]', '', 'g') for y in string_split_regex(replace(name, '.', ' '), ' +')] if x <> ''] AS w FROM p),
  a AS (SELECT DISTINCT team_id, player_id, unnest(list_concat([regexp_replace(lower(name), '[^a-z0-9]', '', 'g')], CASE WHEN len(w) >= 2 AND w[-1] IN ('jr', 'sr', 'ii', 'iii', 'iv') THEN [w[-2] || w[-1]] ELSE [w[-1], w[1][1] || w[-1]] END)) AS alias FROM w)
  SELECT * FROM a""")
def name_alias_table(spark, d):
    c = F.col("c_custkey")
    text = lambda x: x.cast("string")
    name = F.when(c % 3 == 0, F.concat(F.lit("Al"), text(c % 50), F.lit(" Stone Jr."))).when(c % 3 == 1, F.concat(F.lit("B.J. Ray"), text(c % 90))).otherwise(F.concat(F.lit("Solo"), text(c % 40)))
    people = A.table(spark, d, "customer").select(F.col("c_nationkey").alias("team_id"), "c_custkey", name.alias("name"))
    return feeds.alias_table(people, ["team_id"], "c_custkey", "name")


@query("""WITH p AS (SELECT c_nationkey AS team_id, c_custkey AS player_id, 'Al' || c_custkey % 50 || ' Stone' || c_custkey % 9 AS name FROM customer),
  a AS (SELECT DISTINCT team_id, player_id, unnest([lower(replace(name, ' ', '')), 'stone' || player_id % 9, 'astone' || player_id % 9]) AS alias FROM p), u AS (SELECT team_id, alias, count(*) AS n, min(player_id) AS one, string_agg(CAST(player_id AS VARCHAR), ',' ORDER BY player_id) AS candidates FROM a GROUP BY 1, 2),
  o AS (SELECT o_orderkey, o_custkey % 25 AS team_id, CASE WHEN o_orderkey % 2 = 0 THEN 'stone' ELSE 'al' || o_custkey % 50 || 'stone' END || o_custkey % 9 AS alias FROM orders) SELECT o_orderkey, CASE WHEN n = 1 THEN one END AS player_id, candidates FROM o LEFT JOIN u USING (team_id, alias)""")
def resolved_aliases(spark, d):
    text = lambda x: x.cast("string")
    c, o = F.col("c_custkey"), F.col("o_custkey")
    people = A.table(spark, d, "customer").select(F.col("c_nationkey").alias("team_id"), "c_custkey", F.concat(F.lit("Al"), text(c % 50), F.lit(" Stone"), text(c % 9)).alias("name"))
    key = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "stone").otherwise(F.concat(F.lit("al"), text(o % 50), F.lit("stone"))), text(o % 9))
    names = A.table(spark, d, "orders").select("o_orderkey", (o % 25).alias("team_id"), key.alias("alias"))
    return reconstruct.unique_aliases(names, feeds.alias_table(people, ["team_id"], "c_custkey", "name"), ["team_id", "alias"]).select("o_orderkey", "player_id", "candidates")


@query("""WITH r AS (SELECT year(o_orderdate) AS season, o_orderdate AS game, o_custkey AS player, o_orderpriority AS name FROM orders), g AS (SELECT season, count(DISTINCT game) AS all_games FROM r GROUP BY 1)
  SELECT season, player, count(DISTINCT game) AS games, max(name) AS name, all_games FROM r JOIN g USING (season) GROUP BY season, player, all_games""")
def season_universe(spark, d):
    rows = A.table(spark, d, "orders").select(F.year("o_orderdate").alias("season"), F.col("o_orderdate").alias("game"), F.col("o_custkey").alias("player"), F.col("o_orderpriority").alias("name"))
    return feeds.season_universe(rows, "season", "game", "player", "name")


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END, o_orderdate * 1000000 + o_orderkey DESC) AS rn FROM (SELECT o_custkey, o_orderkey, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS o_orderdate FROM orders)) WHERE rn = 1""")
def latest_with_value(spark, d):
    o = A.table(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("price"), (F.unix_date(F.to_date("o_orderdate")) * F.lit(1000000).cast("long") + F.col("o_orderkey")).alias("at"))
    return feeds.latest_with_value(o, ["o_custkey"], "price", "at").select("o_custkey", "o_orderkey")


@query("""SELECT o_orderkey, CASE WHEN n <= 48 THEN make_date(y, 4, least(15 + n // 4, 30)) WHEN n <= 72 THEN make_date(y, 5, least(1 + (n - 48) // 2, 31)) WHEN n <= 84 THEN make_date(y, 5, least(20 + (n - 72) // 2, 31)) ELSE make_date(y, 6, least(1 + (n - 84) // 2, 30)) END AS date
  FROM (SELECT o_orderkey, CAST(o_custkey % 100 AS BIGINT) AS n, CASE WHEN o_orderkey % 2 = 0 THEN 1990 + o_orderkey % 10 WHEN o_orderkey % 30 >= 96 THEN 1900 + o_orderkey % 30 ELSE 2000 + o_orderkey % 30 END AS y FROM orders)""")
def approximate_dates(spark, d):
    k, n = F.col("o_orderkey"), F.lpad((F.col("o_custkey") % 100).cast("string"), 4, "0")
    old, new = F.concat(F.lit("49"), (k % 10).cast("string"), n), F.concat(F.lit("4"), F.lpad((k % 30).cast("string"), 2, "0"), F.lit("00"), n)
    return A.table(spark, d, "orders").select("o_orderkey", S.approximate_date(F.when(k % 2 == 0, old).otherwise(new)).alias("date"))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN e < 2880 THEN e // 720 + 1 ELSE (e - 2880) // 300 + 5 END AS period, round(CASE WHEN e < 2880 THEN (e // 720 + 1) * 720 ELSE 2880 + ((e - 2880) // 300 + 1) * 300 END - e, 6) AS remaining,
  CASE WHEN e = 0 THEN 1 WHEN e <= 2880 THEN (e + 719) // 720 ELSE (e - 2880 + 299) // 300 + 4 END AS ending, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE CAST(l_partkey AS DOUBLE) END AS number, 72 + l_suppkey % 12 AS inches, 'Ann Lee' AS tidy, l_suppkey AS home_points, l_partkey AS away_points, 'H' || l_suppkey AS home, 'A' || l_partkey AS away, l_orderkey % 30 + 1990 AS season, 'Playoffs' AS kind
  FROM (SELECT *, (l_partkey * 60) % 3600 AS e FROM lineitem)""")
def clock_and_text_parts(spark, d):
    """Times, texts and ids of a feed, taken apart: clocks are made by one function and read by its inverse."""
    c = F.col
    li = A.table(spark, d, "lineitem").withColumn("e", (c("l_partkey") * 60) % 3600)
    text = lambda x: c(x).cast("string")
    away_points, home_points = S.score_pair(F.concat(text("l_partkey"), F.lit(" - "), text("l_suppkey")))
    home, away = S.matchup_sides(F.when(c("l_linenumber") % 2 == 0, F.concat(F.lit("A"), text("l_partkey"), F.lit(" @ H"), text("l_suppkey"))).otherwise(F.concat(F.lit("H"), text("l_suppkey"), F.lit(" vs. A"), text("l_partkey"))))
    two = F.lpad((c("l_orderkey") % 30 + 90).cast("string"), 3, "0")
    game = F.concat(F.lit("004"), F.right(two, F.lit(2)), F.lit("00001"))
    return li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", S.period_at(c("e")).alias("period"), F.round(S.clock_seconds(S.clock_at(c("e"))), 6).alias("remaining"), S.period_at(c("e"), True).alias("ending"),
        S.number_or(F.when(c("l_partkey") % 5 == 0, "x").otherwise(text("l_partkey")), None).alias("number"), S.height_inches(F.concat(F.lit("6-"), (c("l_suppkey") % 12).cast("string"))).alias("inches"), S.tidy(F.when(c("l_partkey") % 2 == 0, F.lit("Ann   Lee* ")).otherwise(F.lit(" Ann Lee (12)"))).alias("tidy"),
        home_points.cast("long").alias("home_points"), away_points.cast("long").alias("away_points"), home.alias("home"), away.alias("away"), S.season_of_game_id(game).cast("long").alias("season"), S.season_type_of_game_id(game).alias("kind"),
    )


__all__ = ["r6"]
