"""Registered queries on the messy feed, each beside its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..lineage import fresh_dir, laid, tasks_for
from ..operators import decay, openings
from ..operators.substitutions import expand_substitutions, known_players
from ..operators.tracking import track_lineups
from ..sources import adapters as A, sinks
from ..sources.messy import MESSY_SQL, messy_events
from ..sources.pbp import GAME_SECONDS, PBP_SQL, play_by_play
from . import audits
from .game_queries import _ROTATIONS, _rotations as clean_rotations
from .registry import query

_IN = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
_KEY = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"
_SHORT = "CASE WHEN contains(trim({0}), ' ') THEN substr(trim({0}), 1, 1) || '. ' || substr(trim({0}), strpos(trim({0}), ' ') + 1) ELSE trim({0}) END"


def _words(name: str) -> str:
    return f"[x for x in [{_KEY.format('y')} for y in regexp_split_to_array(replace(coalesce({name}, ''), '.', ' '), ' +')] if x <> '']"


def _forms(name: str, out: str) -> str:
    """Columns of a name: its words and the keys by which it may be called."""
    return f"{_words(name)} AS {out}_w, {_KEY.format(f'coalesce({name}, {chr(39)*2})')} AS {out}_k"


def _aliases(p: str) -> str:
    return f"""[x for x in CASE WHEN len({p}_w) = 0 THEN [{p}_k] WHEN len({p}_w) >= 2 AND {p}_w[-1] IN ('jr', 'sr', 'ii', 'iii', 'iv') THEN [{p}_k, {p}_w[-2] || {p}_w[-1]] ELSE [{p}_k, {p}_w[-1], substr({p}_w[1], 1, 1) || {p}_w[-1]] END if x <> '']"""


def _surname(p: str) -> str:
    return f"CASE WHEN len({p}_w) >= 2 AND {p}_w[-1] IN {_IN(S.NAME_SUFFIXES)} THEN {p}_w[-2] ELSE {p}_w[-1] END"


_TEXT_KEYS = f"""txt AS (SELECT *, [x for x in [{_KEY.format('y')} for y in regexp_split_to_array(CASE WHEN starts_with(upper(d), 'MISS ') THEN substr(d, 6) ELSE d END, '\\s+')] if x <> ''] AS tw FROM (SELECT *, trim(coalesce(description, '')) AS d FROM messy WHERE player_id > 0)),
  beg AS (SELECT *, list_position([x NOT IN {_IN(S.EVENT_WORDS)} for x in tw], true) AS b FROM txt),
  rst AS (SELECT *, CASE WHEN b > 0 THEN tw[b:] ELSE [] END AS rest FROM beg),
  cut AS (SELECT *, list_position([x IN {_IN(S.EVENT_WORDS)} OR NOT regexp_matches(x, '^[a-z]+$') for x in rest[2:]], true) AS stop FROM rst),
  nam AS (SELECT *, list_concat([x for x in rest[1:1] if regexp_matches(x, '^[a-z]+$')], CASE WHEN stop > 0 THEN rest[2:stop] ELSE rest[2:] END) AS nm FROM cut),
  keyed AS (SELECT *, CASE WHEN kind = 'sub' THEN [] ELSE [x for x in [CASE WHEN nm[1] NOT IN {_IN(S.NAME_SUFFIXES)} THEN nm[1] END, CASE WHEN nm[2] IN {_IN(S.NAME_SUFFIXES)} THEN nm[1] || nm[2] END, CASE WHEN nm[2] NOT IN {_IN(S.NAME_SUFFIXES)} THEN nm[2] END,
    CASE WHEN nm[2] NOT IN {_IN(S.NAME_SUFFIXES)} THEN nm[1] || nm[2] END, CASE WHEN nm[2] NOT IN {_IN(S.NAME_SUFFIXES)} THEN substr(nm[1], 1, 1) || nm[2] END] if x IS NOT NULL] END AS text_keys FROM nam)"""
_PLAYERS = f"""{_TEXT_KEYS},
  formed AS (SELECT *, {_forms('player_name', 'f')}, {_forms(_SHORT.format('player_name'), 's')} FROM keyed),
  ali AS (SELECT DISTINCT game_id, team_id, player_id, unnest(list_concat(list_concat({_aliases('f')}, {_aliases('s')}), text_keys)) AS a FROM formed),
  pl AS MATERIALIZED (SELECT * FROM (SELECT game_id, team_id, player_id, f_k, s_k, {_surname('f')} AS f_s, {_surname('s')} AS s_s, list_concat({_aliases('f')}, {_aliases('s')}) AS own FROM formed QUALIFY row_number() OVER (PARTITION BY game_id, team_id, player_id ORDER BY action_number) = 1)
    JOIN (SELECT game_id, team_id, player_id, list(a) AS alias FROM ali GROUP BY 1, 2, 3) USING (game_id, team_id, player_id))"""
_EXPANDED = f"""{_PLAYERS},
  subs AS MATERIALIZED (SELECT *, trim(split_part(split_part(description, 'SUB:', 2), ' FOR ', 1)) AS in_raw, trim(split_part(description, ' FOR ', 2)) AS out_raw FROM messy WHERE kind = 'sub'),
  raws AS (SELECT *, {_forms('raw', 'r')} FROM (SELECT game_id, team_id, in_raw AS raw FROM subs UNION SELECT game_id, team_id, out_raw FROM subs)),
  met AS (SELECT game_id, team_id, raw, player_id, r_k IN (f_k, s_k) AS r1, len(r_w) = 1 AND r_w[-1] IN (f_s, s_s) AS r2, list_contains(alias, r_k) AS r3, list_contains(own, r_w[-1]) AND len([a for a in own if ends_with(a, r_w[-1]) AND starts_with(a, r_w[1])]) > 0 AS r4,
    len([a for a in alias if a <> r_w[-1] AND ends_with(a, r_w[-1]) AND starts_with(a, r_w[1])]) > 0 AS r5, list_contains(alias, r_w[-1]) AS r6 FROM raws JOIN pl USING (game_id, team_id)),
  cand AS MATERIALIZED (SELECT game_id, team_id, raw, CASE WHEN count(*) FILTER (r1) > 0 THEN list(player_id ORDER BY player_id) FILTER (r1) WHEN count(*) FILTER (r2) > 1 THEN list(player_id ORDER BY player_id) FILTER (r2) WHEN count(*) FILTER (r3) > 0 THEN list(player_id ORDER BY player_id) FILTER (r3)
    WHEN count(*) FILTER (r4) > 0 THEN list(player_id ORDER BY player_id) FILTER (r4) WHEN count(*) FILTER (r5) > 0 THEN list(player_id ORDER BY player_id) FILTER (r5) ELSE coalesce(list(player_id ORDER BY player_id) FILTER (r6), []) END AS found FROM met GROUP BY 1, 2, 3),
  open_subs AS (SELECT s.*, coalesce(i.found, []) AS ins0, CASE WHEN s.player_id > 0 THEN [s.player_id] ELSE coalesce(o.found, []) END AS outs FROM subs s
    LEFT JOIN cand i ON i.game_id = s.game_id AND i.team_id = s.team_id AND i.raw = in_raw LEFT JOIN cand o ON o.game_id = s.game_id AND o.team_id = s.team_id AND o.raw = out_raw),
  shown AS (SELECT m.game_id, m.team_id, m.player_id, m.action_number AS seen, CASE WHEN kind <> 'sub' THEN true WHEN list_contains(own, {_KEY.format("split_part(split_part(description, 'SUB:', 2), ' FOR ', 1)")}) THEN false WHEN list_contains(own, {_KEY.format("split_part(description, ' FOR ', 2)")}) THEN true END AS onfloor
    FROM messy m JOIN pl USING (game_id, team_id, player_id)),
  asked AS (SELECT game_id, team_id, action_number, unnest(ins0) AS player_id FROM open_subs WHERE len(ins0) > 1 AND len({_words('in_raw')}) > 1),
  nxt AS (SELECT a.game_id, a.team_id, a.action_number, a.player_id, min(seen) AS seen, arg_min(onfloor, seen) AS onfloor FROM asked a JOIN shown s ON s.game_id = a.game_id AND s.team_id = a.team_id AND s.player_id = a.player_id AND s.seen > a.action_number AND onfloor IS NOT NULL GROUP BY 1, 2, 3, 4),
  proof AS (SELECT game_id, team_id, action_number, list(player_id) AS who FROM (SELECT *, min(seen) OVER (PARTITION BY game_id, team_id, action_number) AS least FROM nxt WHERE onfloor) WHERE seen = least GROUP BY 1, 2, 3 HAVING count(*) = 1),
  solved AS (SELECT open_subs.*, coalesce(who, ins0) AS ins FROM open_subs LEFT JOIN proof USING (game_id, team_id, action_number)),
  moved AS MATERIALIZED (SELECT *, 'out' AS side, outs[1] AS pid, CAST([] AS BIGINT[]) AS cands FROM solved WHERE len(outs) = 1 AND NOT (len(ins) = 1 AND ins[1] = outs[1]) UNION ALL
    SELECT *, 'in', CASE WHEN len(ins) = 1 THEN ins[1] END, CASE WHEN len(ins) > 1 THEN ins ELSE [] END FROM solved)"""


def _laid_feed(spark, d, where="true"):
    """The messy feed laid down and dealt by game and team, and into how many tasks."""
    tasks = tasks_for(A.table(spark, d, "lineitem").count())
    return laid(messy_events(spark, d).where(where), "game_id", "team_id", tasks=tasks), tasks


@query(f"WITH {MESSY_SQL}, {_PLAYERS} SELECT game_id, team_id, player_id, array_to_string(list_sort(list_distinct(alias)), ' ') AS aliases FROM pl")
def player_aliases(spark, d):
    """All keys by which a game's texts and names may call a player."""
    return known_players(messy_events(spark, d)).select("game_id", "team_id", "player_id", F.array_join(F.sort_array("alias"), " ").alias("aliases"))


@query(f"WITH {MESSY_SQL}, {_EXPANDED} SELECT game_id, team_id, action_number, side, pid AS player_id, array_to_string(cands, ',') AS candidates FROM moved")
def expanded_substitutions(spark, d):
    """Substitution texts as moves out and in, with candidates where a name stays ambiguous."""
    events, tasks = _laid_feed(spark, d)
    out = expand_substitutions(events, tasks=tasks).where("side is not null")
    return out.select("game_id", "team_id", "action_number", "side", "player_id", F.array_join("candidates", ",").alias("candidates"))


_NAMED = "CASE WHEN {0}.p IS NOT NULL THEN {0}.p WHEN len({0}.c) = 1 THEN {0}.c[1] END"
_ENTERS = "CASE WHEN {0}.p IS NOT NULL THEN CASE WHEN NOT list_contains({1}, {0}.p) THEN {0}.p END WHEN len([c for c in {0}.c if NOT list_contains({1}, c)]) = 1 THEN [c for c in {0}.c if NOT list_contains({1}, c)][1] END"


def _batch_steps(rows: str) -> str:
    """Nested selects over `rows` (h, a: lineups; h_outs, h_ins, a_outs, a_ins: moves {p, c, d}) that end in h_new and a_new."""
    steps = [
        ("neu", "list_intersect([mo.p for mo in {s}_outs if list_contains({s}, mo.p)], [x for x in [" + _NAMED.format("mi") + " for mi in {s}_ins] if x IS NOT NULL])"),
        ("o1", "[mo for mo in {s}_outs if NOT list_contains({s}_neu, mo.p)]"), ("i1", "[mi for mi in {s}_ins if coalesce(NOT list_contains({s}_neu, " + _NAMED.format("mi") + "), true)]"),
        ("pw", "[{{'k': kk, 'w': [jj for jj in range(1, len({s}_i1) + 1) if {s}_i1[jj].d = {s}_o1[kk].d][1 + len([y for y in {s}_o1[1:kk - 1] if y.d = {s}_o1[kk].d])]}} for kk in range(1, len({s}_o1) + 1)]"),
        ("pr", "[q for q in [{{'k': x.k, 'w': x.w, 'o': CASE WHEN list_contains({s}, {s}_o1[x.k].p) THEN {s}_o1[x.k].p END, 'i': " + _ENTERS.format("{s}_i1[x.w]", "{s}") + "}} for x in {s}_pw if x.w IS NOT NULL] if q.o IS NOT NULL AND q.i IS NOT NULL]"),
        ("l1", "list_reduce([{{'l': CAST([] AS BIGINT[]), 'o': q.o, 'i': q.i}} for q in {s}_pr], lambda acc, q: {{'l': CASE WHEN list_contains(acc.l, q.o) AND NOT list_contains(acc.l, q.i) THEN list_append([x for x in acc.l if x <> q.o], q.i) ELSE acc.l END, 'o': CAST(NULL AS BIGINT), 'i': CAST(NULL AS BIGINT)}}, {{'l': {s}, 'o': CAST(NULL AS BIGINT), 'i': CAST(NULL AS BIGINT)}}).l"),
        ("l2", "[x for x in {s}_l1 if NOT list_contains([{s}_o1[kk].p for kk in range(1, len({s}_o1) + 1) if NOT list_contains([q.k for q in {s}_pr], kk)], x)]"),
        ("i2", "[{s}_i1[jj] for jj in range(1, len({s}_i1) + 1) if NOT list_contains([q.w for q in {s}_pr], jj)]"),
        ("new", "list_reduce([{{'l': CAST([] AS BIGINT[]), 'p': y.p, 'c': y.c}} for y in {s}_i2], lambda acc, y: {{'l': CASE WHEN (" + _ENTERS.format("y", "acc.l") + ") IS NULL THEN acc.l ELSE list_append(acc.l, " + _ENTERS.format("y", "acc.l") + ") END, 'p': CAST(NULL AS BIGINT), 'c': CAST([] AS BIGINT[])}}, {{'l': {s}_l2, 'p': CAST(NULL AS BIGINT), 'c': CAST([] AS BIGINT[])}}).l"),
    ]
    for name, e in steps:
        rows = f"SELECT *, {', '.join(f'{e.format(s=s)} AS {s}_{name}' for s in 'ha')} FROM ({rows})"
    return rows


def _tracked(given: str, forced: str) -> str:
    """CTEs up to `seg`: lineups folded over the points at which they may change. `given` makes gv (game_id, team_id, mark, t0, lineup).

    A point is a batch of substitutions (k = 0 in event order, k = 1 after a clock with a later free throw), the first event of a
    period with known lineups (k = -2) or of a known time (k = -1). pos numbers the events, of which a text of two is one.
    """
    side = lambda t, m: f"coalesce(list({{'p': pid, 'c': cands, 'd': description}} ORDER BY action_number) FILTER (team_id = {t} AND side = '{m}'), [])"
    known = lambda t, m, at: f"(SELECT any_value(lineup) FROM gv WHERE gv.game_id = e.game_id AND gv.team_id = e.{t} AND mark = '{m}' AND gv.t0 = e.{at})"
    return f"""{_EXPANDED}, {given},
  ev AS MATERIALIZED (SELECT *, action_number - row_number() OVER (PARTITION BY game_id, kind = 'sub' ORDER BY action_number) AS island0, row_number() OVER (PARTITION BY game_id ORDER BY action_number) AS pos FROM messy),
  isl AS (SELECT *, min(pos) OVER (PARTITION BY game_id, elapsed, grp) AS island FROM (SELECT *, pos - row_number() OVER (PARTITION BY game_id, elapsed, kind = 'sub' ORDER BY pos) AS grp FROM ev) WHERE kind = 'sub'),
  marks AS (SELECT game_id, t0 FROM gv JOIN (SELECT DISTINCT game_id AS g, home_id, away_id FROM messy) ON g = game_id AND team_id IN (home_id, away_id) WHERE mark = 'elapsed' AND len(lineup) = 5 GROUP BY 1, 2 HAVING count(DISTINCT team_id) = 2),
  mv AS (SELECT moved.*, CASE WHEN action_number < (SELECT max(action_number) FROM messy f WHERE f.kind = 'free_throw' AND f.game_id = moved.game_id AND f.elapsed = moved.elapsed) THEN 1 ELSE 0 END AS k FROM moved WHERE NOT EXISTS (SELECT 1 FROM marks WHERE marks.game_id = moved.game_id AND marks.t0 = moved.elapsed)),
  bat AS (SELECT mv.game_id, mv.elapsed, k, CASE WHEN k = 0 THEN island ELSE 0 END AS o, {side('any_home', 'out')} AS h_outs, {side('any_home', 'in')} AS h_ins, {side('any_away', 'out')} AS a_outs, {side('any_away', 'in')} AS a_ins
    FROM (SELECT mv.*, isl.island, mv.home_id AS any_home, mv.away_id AS any_away FROM mv JOIN isl ON isl.game_id = mv.game_id AND isl.action_number = mv.action_number) mv GROUP BY 1, 2, 3, 4),
  firsts AS (SELECT game_id, period, any_value(home_id) AS home_id, any_value(away_id) AS away_id, min(elapsed) AS elapsed FROM messy GROUP BY 1, 2),
  clocks AS (SELECT game_id, elapsed, any_value(home_id) AS home_id, any_value(away_id) AS away_id FROM messy GROUP BY 1, 2),
  no AS (SELECT [x for x in [{{'p': CAST(1 AS BIGINT), 'c': CAST([] AS BIGINT[]), 'd': ''}}] if false] AS none),
  pts AS (SELECT game_id, elapsed, k, o, h_outs, h_ins, a_outs, a_ins, CAST(NULL AS BIGINT[]) AS h_set, CAST(NULL AS BIGINT[]) AS a_set FROM bat UNION ALL
    SELECT game_id, elapsed, -2, 0, none, none, none, none, CASE WHEN len(hs) = 5 THEN hs END, CASE WHEN len(s2) = 5 THEN s2 END FROM (SELECT e.*, {known('home_id', 'period', 'period')} AS hs, {known('away_id', 'period', 'period')} AS s2 FROM firsts e WHERE period > 1), no WHERE len(hs) = 5 OR len(s2) = 5 UNION ALL
    SELECT game_id, elapsed, -1, 0, none, none, none, none, hs, s2 FROM (SELECT e.*, {known('home_id', 'elapsed', 'elapsed')} AS hs, {known('away_id', 'elapsed', 'elapsed')} AS s2 FROM clocks e), no WHERE len(hs) = 5 AND len(s2) = 5),
  point AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY elapsed, CASE WHEN k < 0 THEN k ELSE 2 * k END, o) AS n FROM pts),
  fold AS (SELECT e.game_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS elapsed, -9 AS k, CAST(0 AS BIGINT) AS o, true AS applied, coalesce({known('home_id', 'period', 'period')}, []) AS h, coalesce({known('away_id', 'period', 'period')}, []) AS a FROM (SELECT DISTINCT game_id, home_id, away_id, 1 AS period FROM messy) e
    UNION ALL SELECT game_id, n, elapsed, k, o, k <> -1 OR {forced} OR len(h) <> 5 OR len(a) <> 5, CASE WHEN k = -2 THEN coalesce(h_set, h) WHEN k = -1 AND ({forced} OR len(h) <> 5 OR len(a) <> 5) THEN h_set ELSE h_new END, CASE WHEN k = -2 THEN coalesce(a_set, a) WHEN k = -1 AND ({forced} OR len(h) <> 5 OR len(a) <> 5) THEN a_set ELSE a_new END
    FROM ({_batch_steps("SELECT point.*, fold.h, fold.a FROM fold JOIN point ON point.game_id = fold.game_id AND point.n = fold.n + 1")})),
  live AS (SELECT *, lead(elapsed) OVER w AS nxt, row_number() OVER w AS i FROM fold WHERE applied WINDOW w AS (PARTITION BY game_id ORDER BY n)),
  scored AS (SELECT ev.game_id, live.i, sum(CASE WHEN team_id = home_id THEN points ELSE 0 END) AS hp, sum(CASE WHEN team_id = away_id THEN points ELSE 0 END) AS ap FROM ev JOIN live ON live.game_id = ev.game_id AND kind <> 'sub' AND (live.elapsed < ev.elapsed OR (live.elapsed = ev.elapsed AND live.k < 1 AND live.o < ev.pos)) GROUP BY ev.game_id, ev.pos, live.i QUALIFY live.i = max(live.i) OVER (PARTITION BY ev.game_id, ev.pos)),
  ends AS (SELECT game_id, max(elapsed) AS last FROM messy GROUP BY 1),
  seg AS (SELECT live.game_id, live.elapsed AS s, coalesce(nxt, last) AS e, list_sort(h) AS h, list_sort(a) AS a, coalesce(sum(hp), 0) AS hp, coalesce(sum(ap), 0) AS ap FROM live JOIN ends USING (game_id) LEFT JOIN scored ON scored.game_id = live.game_id AND scored.i = live.i GROUP BY ALL)"""


_BASE = "team_id * 100 + 1000"
_STARTERS = f"SELECT game_id, team_id, 'period' AS mark, CAST(1 AS BIGINT) AS t0, [{_BASE}, {_BASE} + 1, {_BASE} + 2, {_BASE} + 3, {_BASE} + 4] AS lineup FROM sides"
_SIDES = "sides AS (SELECT DISTINCT game_id, home_id AS team_id FROM messy UNION SELECT DISTINCT game_id, away_id FROM messy)"


def _starters(events):
    sides = events.select("game_id", F.explode(F.array("home_id", "away_id")).alias("team_id")).distinct()
    return sides.select("game_id", "team_id", F.lit("period").alias("mark"), F.lit(1).cast("long").alias("at"), F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.col("team_id") * 100 + 1000 + i).alias("lineup"))


def _groups(df):
    return df.select("game_id", "start", "end", F.array_join("home_lineup", "-").alias("home_group"), F.array_join("away_lineup", "-").alias("away_group"), F.col("home_points").cast("long").alias("home_points"), F.col("away_points").cast("long").alias("away_points"))


def _tracks(spark, d, given, forced=False):
    events, tasks = _laid_feed(spark, d)
    return _groups(track_lineups(expand_substitutions(events, tasks=tasks), given(events), forced=forced, tasks=tasks))


@query(f"""WITH RECURSIVE {MESSY_SQL}, {_tracked(f"{_SIDES}, gv AS ({_STARTERS})", 'false')}
  SELECT game_id, s AS "start", e AS "end", array_to_string(h, '-') AS home_group, array_to_string(a, '-') AS away_group, CAST(hp AS BIGINT) AS home_points, CAST(ap AS BIGINT) AS away_points FROM seg WHERE e > s OR hp <> 0 OR ap <> 0""")
def tracked_lineups(spark, d):
    """Lineups of the messy feed, event by event: batches of one clock, pairs, exits and entries that cancel, free throws first."""
    return _tracks(spark, d, _starters)


_TRUSTED = f"""{_SIDES}, gv AS ({_STARTERS} UNION ALL
  SELECT game_id, team_id, 'period', p, [{_BASE} + s + CASE WHEN s = p % 5 THEN 5 ELSE 0 END for s in [0, 1, 2, 3, 4]] FROM sides, range(2, 5) AS r(p) WHERE (game_id + p) % 2 = 0 UNION ALL
  SELECT game_id, team_id, 'elapsed', CAST(1104 AS BIGINT), [{_BASE} + s for s in [1, 3, 5, 7, 9]] FROM sides WHERE game_id % 3 = 0 AND NOT (game_id % 7 = 0 AND team_id % 2 = 0))"""


def _given(events):
    base, starters = F.col("team_id") * 100 + 1000, _starters(events)
    slots = lambda *s: F.array(*[F.lit(x).cast("long") for x in s])
    sides = starters.select("game_id", "team_id")
    periods = sides.withColumn("p", F.explode(F.sequence(F.lit(2).cast("long"), F.lit(4).cast("long")))).where("(game_id + p) % 2 = 0")
    periods = periods.select("game_id", "team_id", F.lit("period").alias("mark"), F.col("p").alias("at"), F.transform(slots(0, 1, 2, 3, 4), lambda s: base + s + F.when(s == F.col("p") % 5, 5).otherwise(0)).alias("lineup"))
    times = sides.where("game_id % 3 = 0 and not (game_id % 7 = 0 and team_id % 2 = 0)").select("game_id", "team_id", F.lit("elapsed").alias("mark"), F.lit(1104).cast("long").alias("at"), F.transform(slots(1, 3, 5, 7, 9), lambda s: base + s).alias("lineup"))
    return starters.unionByName(periods).unionByName(times)


def _override_sql(forced: str) -> str:
    return f"""WITH RECURSIVE {MESSY_SQL}, {_tracked(_TRUSTED, forced)}
  SELECT game_id, s AS "start", e AS "end", array_to_string(h, '-') AS home_group, array_to_string(a, '-') AS away_group, CAST(hp AS BIGINT) AS home_points, CAST(ap AS BIGINT) AS away_points FROM seg WHERE e > s OR hp <> 0 OR ap <> 0"""


@query(_override_sql("false"))
def trusted_overrides(spark, d):
    """Tracked lineups with known ones at starts of periods, and at a time wherever a lineup is not five by then."""
    return _tracks(spark, d, _given)


@query(_override_sql("true"))
def forced_overrides(spark, d):
    """The same with the lineups of the known time taken in any case."""
    return _tracks(spark, d, _given, forced=True)


_HIDDEN = "messy AS MATERIALIZED (SELECT * FROM messy_all WHERE game_id % 4 <> 0 OR kind <> 'sub')"
_HIDDEN_SQL = MESSY_SQL.replace("messy AS", "messy_all AS", 1) + ", " + _HIDDEN


def _hidden(spark, d):
    """The messy feed, with no substitutions at all in every fourth game, and its number of tasks."""
    return _laid_feed(spark, d, "game_id % 4 <> 0 or kind <> 'sub'")


_UNIFIED = """un AS MATERIALIZED (SELECT game_id, period, team_id, elapsed, action_number, 'act' AS what, player_id, CAST([] AS BIGINT[]) AS cands FROM messy WHERE kind <> 'sub' UNION ALL SELECT game_id, period, team_id, elapsed, action_number, side, pid, cands FROM moved)"""


@query(f"""WITH {_HIDDEN_SQL}, {_EXPANDED}, {_UNIFIED},
  ev AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY elapsed, action_number, what = 'in') - 1 AS pos FROM un),
  ky AS (SELECT game_id, team_id, a AS key, min(player_id) AS player_id FROM ali WHERE a NOT IN {_IN(S.NAME_SUFFIXES)} GROUP BY 1, 2, 3 HAVING count(*) = 1),
  tx AS (SELECT DISTINCT k.game_id, k.team_id, ev.pos, k.elapsed, ky.player_id FROM (SELECT game_id, team_id, action_number, elapsed, unnest(text_keys) AS key FROM keyed) k JOIN ky ON ky.game_id = k.game_id AND ky.team_id = k.team_id AND ky.key = k.key JOIN ev ON ev.game_id = k.game_id AND ev.action_number = k.action_number AND what = 'act'),
  fs AS MATERIALIZED (SELECT game_id, team_id, player_id, min(pos) AS spos, arg_min(what, pos) AS sw, arg_min(elapsed, pos) AS se FROM ev WHERE what <> 'act' AND player_id > 0 GROUP BY 1, 2, 3),
  co AS (SELECT game_id, team_id, min(elapsed) AS c FROM ev WHERE what <> 'act' AND player_id > 0 GROUP BY 1, 2),
  acts AS MATERIALIZED (SELECT x.*, sw, se, c FROM (SELECT game_id, team_id, player_id, pos, elapsed, what = 'in' AS inrow, 0 AS al FROM ev WHERE player_id > 0 UNION ALL SELECT game_id, team_id, player_id, pos, elapsed, false, 1 FROM tx) x LEFT JOIN fs USING (game_id, team_id, player_id) LEFT JOIN co USING (game_id, team_id)),
  ab AS (SELECT game_id, team_id, player_id, 1 AS tier, spos AS p, 0 AS al FROM fs JOIN co USING (game_id, team_id) WHERE sw = 'out' AND (se < 720 OR se <= c) UNION ALL SELECT game_id, team_id, player_id, 2, pos, al FROM acts WHERE elapsed <= c AND NOT coalesce(sw = 'in' AND se <= c, false) AND NOT inrow),
  fa AS (SELECT game_id, team_id, player_id, min(elapsed) AS e, arg_min(pos, (elapsed, pos)) AS p FROM ev WHERE what = 'act' AND player_id > 0 GROUP BY 1, 2, 3),
  abc AS (SELECT * FROM ab UNION ALL SELECT game_id, team_id, player_id, 3, p, 0 FROM fa LEFT JOIN fs USING (game_id, team_id, player_id) JOIN co USING (game_id, team_id) WHERE e > c AND NOT coalesce(sw = 'in' AND se < e, false) AND (game_id, team_id) IN (SELECT (game_id, team_id) FROM ab)),
  b1 AS (SELECT * FROM abc QUALIFY row_number() OVER (PARTITION BY game_id, team_id, player_id ORDER BY tier, p, al) = 1),
  solved AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY game_id, team_id ORDER BY tier, p, al, player_id) AS i, count(*) OVER (PARTITION BY game_id, team_id) AS n FROM b1) WHERE n >= 5 AND i <= 5),
  win AS (SELECT game_id, team_id, player_id, lim AS tier, pos AS p, al FROM acts, (VALUES (120), (300), (600)) l(lim) WHERE elapsed <= lim AND NOT coalesce(sw = 'in' AND se <= lim, false) AND game_id NOT IN (SELECT game_id FROM solved)),
  b2 AS (SELECT * FROM win QUALIFY row_number() OVER (PARTITION BY game_id, team_id, tier, player_id ORDER BY p, al) = 1),
  wide AS (SELECT *, min(tier) OVER (PARTITION BY game_id) AS least FROM (SELECT *, row_number() OVER (PARTITION BY game_id, team_id, tier ORDER BY p, al, player_id) AS i, count(*) OVER (PARTITION BY game_id, team_id, tier) AS n FROM b2) WHERE n >= 5 AND i <= 5)
  SELECT game_id, team_id, player_id, CAST(tier AS INTEGER) AS tier FROM solved UNION ALL SELECT game_id, team_id, player_id, tier FROM wide WHERE tier = least""".replace("solved AS (SELECT open_subs", "resolved AS (SELECT open_subs").replace("FROM solved WHERE len(outs)", "FROM resolved WHERE len(outs)").replace("ELSE [] END FROM solved)", "ELSE [] END FROM resolved)"))
def hidden_starters(spark, d):
    """Starters by tiers of evidence on a feed that does not name them."""
    events, tasks = _hidden(spark, d)
    return openings.tiered_starters(expand_substitutions(events, tasks=tasks), tasks=tasks)


@query(f"""WITH {MESSY_SQL}, {_EXPANDED}, {_UNIFIED},
  ev AS (SELECT *, row_number() OVER (PARTITION BY game_id, period, team_id ORDER BY elapsed, action_number, what = 'in') - 1 AS pos FROM un WHERE period > 1),
  lg AS (SELECT *, what <> 'act' AND NOT coalesce(lag(what) OVER w <> 'act' AND lag(elapsed) OVER w = elapsed, false) AS opens FROM ev WINDOW w AS (PARTITION BY game_id, period, team_id ORDER BY pos)),
  bt AS MATERIALIZED (SELECT *, min(batch) OVER (PARTITION BY game_id, period, team_id) AS f FROM (SELECT *, CASE WHEN what <> 'act' THEN max(CASE WHEN opens THEN pos END) OVER (PARTITION BY game_id, period, team_id ORDER BY pos) END AS batch FROM lg)),
  seen AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY game_id, period, team_id ORDER BY seen) - 1 AS place FROM (SELECT game_id, period, team_id, player_id, min(pos) AS seen, min(pos) FILTER (what = 'act') AS act, any_value(f) AS f FROM bt WHERE player_id > 0 AND (what = 'act' OR opens) GROUP BY 1, 2, 3, 4)),
  uns AS MATERIALIZED (SELECT game_id, period, team_id, batch, what, pos, unnest(cands) AS player_id FROM bt WHERE player_id IS NULL AND what <> 'act'),
  actv AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY game_id, period, team_id, pos) AS n FROM uns SEMI JOIN seen USING (game_id, period, team_id, player_id)) WHERE n = 1),
  mvd AS (SELECT game_id, period, team_id, player_id, min((batch, o, pos, what)) AS s FROM (SELECT game_id, period, team_id, player_id, batch, 0 AS o, pos, what FROM bt WHERE player_id > 0 AND what <> 'act' UNION ALL SELECT game_id, period, team_id, player_id, batch, 1, pos, what FROM actv) GROUP BY 1, 2, 3, 4),
  mayb AS (SELECT game_id, period, team_id, player_id, min(batch) AS maybe FROM uns WHERE what = 'in' GROUP BY 1, 2, 3, 4),
  lv AS (SELECT game_id, period, team_id, player_id, min(pos - batch) AS leave FROM bt WHERE batch = f AND what = 'out' AND player_id > 0 GROUP BY 1, 2, 3, 4),
  al AS (SELECT *, coalesce(s[4] = 'in', false) AS comes FROM seen FULL JOIN mvd USING (game_id, period, team_id, player_id) LEFT JOIN mayb USING (game_id, period, team_id, player_id) LEFT JOIN lv USING (game_id, period, team_id, player_id)),
  er AS (SELECT *, seen IS NOT NULL AND (f IS NULL OR seen <= f) AND NOT comes AS early FROM al), kp AS (SELECT *, count(*) FILTER (early) OVER (PARTITION BY game_id, period, team_id) AS kept FROM er),
  mk AS (SELECT game_id, period, team_id, player_id, 0 AS r, place AS o, 0 AS t FROM kp WHERE early UNION ALL SELECT game_id, period, team_id, player_id, 0, kept + leave, 1 FROM kp WHERE leave IS NOT NULL AND NOT comes UNION ALL SELECT game_id, period, team_id, player_id, 2, s[1], s[2] * 1000000 + s[3] FROM kp WHERE s[4] = 'out'
    UNION ALL SELECT game_id, period, team_id, player_id, 1, act, 0 FROM kp WHERE act IS NOT NULL AND NOT (comes AND s[1] <= act) AND NOT coalesce(maybe <= act, false) UNION ALL SELECT game_id, period, team_id, player_id, 3, place, 0 FROM kp WHERE seen IS NOT NULL AND NOT comes),
  bs AS (SELECT * FROM mk QUALIFY row_number() OVER (PARTITION BY game_id, period, team_id, player_id ORDER BY r, o, t) = 1)
  SELECT game_id, period, team_id, player_id, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY game_id, period, team_id ORDER BY r, o, t, player_id) AS i, count(*) OVER (PARTITION BY game_id, period, team_id) AS n FROM bs) WHERE n >= 5 AND i <= 5""")
def ranked_openings(spark, d):
    """Lineups at the start of later periods by ranked evidence."""
    events, tasks = _laid_feed(spark, d)
    return openings.ranked_openings(expand_substitutions(events, tasks=tasks))


@query(f"""WITH {_ROTATIONS}, pr AS MATERIALIZED (SELECT game_id, team_id, player_id, s, e FROM iv WHERE (player_id + s) % 7 <> 0), gm AS (SELECT DISTINCT game_id FROM pbp),
  ps AS (SELECT game_id, p * 720 AS t0 FROM gm, range(4) r(p)), ast AS (SELECT DISTINCT ps.game_id, t0, team_id, player_id FROM ps JOIN pr ON pr.game_id = ps.game_id AND s <= t0 AND e > t0),
  anc AS MATERIALIZED (SELECT game_id, t0, team_id, player_id FROM (SELECT *, count(*) FILTER (n = 5) OVER (PARTITION BY game_id, t0) AS full_n FROM (SELECT *, count(*) OVER (PARTITION BY game_id, t0, team_id) AS n FROM ast)) WHERE full_n = 10),
  mvs AS MATERIALIZED (SELECT game_id, team_id, elapsed AS t0, player_id, false AS on_ FROM pbp WHERE kind = 'sub' UNION ALL SELECT game_id, team_id, elapsed, in_id, true FROM pbp WHERE kind = 'sub'),
  mg AS (SELECT game_id, team_id, player_id, t0, bool_or(on_) AS on_, 1 AS m FROM mvs GROUP BY 1, 2, 3, 4), kn AS (SELECT game_id, team_id, player_id FROM mg UNION SELECT game_id, team_id, player_id FROM anc),
  rs AS (SELECT kn.game_id, kn.team_id, kn.player_id, a.t0, anc.player_id IS NOT NULL AS on_, 0 AS m FROM kn JOIN (SELECT DISTINCT game_id, t0 FROM anc) a ON a.game_id = kn.game_id LEFT JOIN anc ON anc.game_id = kn.game_id AND anc.team_id = kn.team_id AND anc.player_id = kn.player_id AND anc.t0 = a.t0),
  st2 AS (SELECT game_id, team_id, player_id, t0, arg_max(on_, m) AS on_ FROM (SELECT * FROM mg UNION ALL SELECT * FROM rs) GROUP BY 1, 2, 3, 4),
  sec AS (SELECT game_id, team_id, player_id, t0 AS s, e FROM (SELECT *, coalesce(lead(t0) OVER (PARTITION BY game_id, team_id, player_id ORDER BY t0), {GAME_SECONDS}) AS e FROM st2) WHERE on_ AND e > t0),
  lay AS MATERIALIZED (SELECT *, 'primary' AS source FROM pr UNION ALL SELECT *, 'fallback' FROM sec), mk AS (SELECT game_id, s AS t0 FROM lay UNION SELECT game_id, e FROM lay UNION SELECT game_id, t0 FROM ps UNION SELECT game_id, {GAME_SECONDS} FROM gm UNION SELECT game_id, t0 FROM mvs),
  sg AS (SELECT * FROM (SELECT game_id, t0 AS s, lead(t0) OVER (PARTITION BY game_id ORDER BY t0) AS e FROM mk) WHERE e IS NOT NULL),
  li AS (SELECT sg.game_id, sg.s, sg.e, source, team_id, list(DISTINCT player_id ORDER BY player_id) AS lineup FROM sg JOIN lay ON lay.game_id = sg.game_id AND sg.e > lay.s AND sg.e <= lay.e GROUP BY ALL),
  fl AS (SELECT *, count(*) FILTER (len(lineup) = 5) OVER (PARTITION BY game_id, s, e, source) AS f FROM li), bb AS (SELECT *, max(source) FILTER (f = 2) OVER (PARTITION BY game_id, s, e) AS best FROM fl)
  SELECT game_id, s AS "start", e AS "end", team_id, array_to_string(lineup, '-') AS group_id, source FROM bb WHERE f = 2 AND source = best""")
def segment_fallback(spark, d):
    """Lineups from rotations with holes, and from substitutions that restart at each period, chosen segment by segment."""
    events = play_by_play(spark, d)
    ends = events.select("game_id", "home_id", "away_id").distinct().withColumn("game_seconds", F.lit(GAME_SECONDS).cast("long"))
    subs = events.where("kind = 'sub'")
    moves = subs.select("game_id", "team_id", "elapsed", "player_id", F.lit("out").alias("side")).unionByName(subs.select("game_id", "team_id", "elapsed", F.col("in_id").alias("player_id"), F.lit("in").alias("side")))
    primary = clean_rotations(events).where("(player_id + start) % 7 <> 0")
    out = openings.sides_with_fallback(primary, moves, ends)
    return out.select("game_id", "start", "end", "team_id", F.array_join("lineup", "-").alias("group_id"), "source")


#: Facts with the faults that audits look for, derived from order lines.
_FAULTY = {
    "season": "l_orderkey % 5", "game_id": "l_orderkey", "player_id": "l_partkey", "line": "l_linenumber", "on_possessions": "CASE WHEN l_partkey % 11 <> 0 THEN CAST(l_quantity * 2 + l_suppkey % 9 AS DOUBLE) END", "minutes": "CAST(l_quantity AS DOUBLE)", "fgm": "l_partkey % 12", "fga": "l_suppkey % 25 + 4",
    "fg3m": "l_partkey % 4", "fg3a": "l_suppkey % 9 + 1", "ftm": "CASE WHEN l_suppkey % 17 <> 0 THEN l_partkey % 6 END", "fta": "l_suppkey % 8 + 2", "pts": "CASE WHEN l_partkey % 13 = 0 THEN NULL WHEN l_partkey % 19 = 0 THEN 7 ELSE 2 * (l_partkey % 12) + l_partkey % 4 + l_partkey % 6 END",
    "reb": "l_linenumber + l_suppkey % 3", "oreb": "l_linenumber", "dreb": "CASE WHEN l_suppkey % 7 = 0 THEN 1 ELSE l_suppkey % 3 END", "plus_minus_actual": "CAST(l_suppkey % 30 AS DOUBLE)", "on_diff_reconstructed": "CASE WHEN l_partkey % 23 <> 0 THEN l_suppkey % 30 + (l_partkey % 3) * 0.4 END",
    "team_abbr": "CASE WHEN l_suppkey % 29 <> 0 THEN 'AAA' END", "opp_team_abbr": "CASE WHEN l_suppkey % 31 <> 0 THEN 'BBB' END", "player_name": "CASE l_partkey % 37 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE 'P' END",
}
_FAULTY_SQL = f"faulty AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _FAULTY.items())} FROM lineitem)"


def _faulty(spark, d):
    return A.table(spark, d, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in _FAULTY.items()])


@query(f"WITH {_FAULTY_SQL} SELECT CAST(season AS BIGINT) AS season, count(*) AS rows, {', '.join(f'count(*) FILTER ({e}) AS {n}' for n, e in audits.FACT_RULES.items())} FROM faulty GROUP BY 1")
def fact_audit(spark, d):
    """All rules of player-game facts, counted by season."""
    return audits.rule_counts(_faulty(spark, d), audits.fact_rules(), [F.col("season").cast("long").alias("season")])


@query(f"WITH {_FAULTY_SQL} SELECT game_id, player_id, line, {', '.join(f'coalesce({e}, false) AS {n}' for n, e in audits.FACT_RULES.items())} FROM faulty WHERE {' OR '.join(f'coalesce({e}, false)' for e in audits.FACT_RULES.values())}")
def fact_violations(spark, d):
    """Rows of player-game facts that break a rule, with a flag per rule."""
    return audits.violations(_faulty(spark, d), audits.fact_rules(), ["game_id", "player_id", "line"])


@query("""WITH o AS (SELECT o_orderkey, o_custkey, year(o_orderdate) AS season, o_totalprice AS price FROM orders)
  SELECT season, count(*) AS rows, CAST(sum(CASE WHEN season = 1995 THEN 2 ELSE 1 END * CASE WHEN season = 1996 AND o_orderkey % 2 = 0 THEN 0 ELSE CAST(round(price * 100) AS BIGINT) END) AS BIGINT) AS cents, true AS refused FROM o WHERE season IN (1995, 1996) GROUP BY 1""")
def guarded_seasons(spark, d):
    """A table by season is written, one season replaced, another put in by key, a write that loses rows refused; two seasons are read."""
    path = fresh_dir(spark, "seasons")
    orders = A.table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("season"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    sinks.replace_partitions(orders, path, "season")
    sinks.replace_partitions(orders.where("season = 1995").withColumn("cents", 2 * F.col("cents")), path, "season")
    sinks.upsert_partitions(orders.where("season = 1996 and o_orderkey % 2 = 0").withColumn("cents", F.lit(0).cast("long")), path, "season", ["season", "o_orderkey"], [F.col("cents")])
    refused = False
    try:
        sinks.replace_partitions(orders.where("season = 1995 and o_orderkey % 4 = 0"), path, "season")
    except sinks.RefusedWrite:
        refused = True
    return sinks.read_partitions(spark, path, "season", [1995, 1996]).groupBy(F.col("season").cast("long").alias("season")).agg(F.count("*").alias("rows"), F.sum("cents").alias("cents"), F.lit(refused).alias("refused"))


@query()
def posterior_intervals(spark, d):
    """Exact 90 % intervals of shooters' posteriors; tested against numeric integrals."""
    s = A.shots(spark, d).groupBy("player_id", F.dayofmonth("game_id").alias("season")).agg(F.count("*").alias("a"), F.sum("made").alias("m"))
    return decay.posterior_table(s, "player_id", "season", "a", "m", 0.36, 200.0, exact=True)


_CARRY = f"""WITH RECURSIVE {PBP_SQL}, rc AS (SELECT game_id, team_id, period, action_number AS n, kind, player_id AS p, in_id AS q, period * 720 - elapsed AS lft, min(action_number) FILTER (kind = 'sub') OVER (PARTITION BY game_id, team_id, period) AS cut FROM pbp),
  sn AS (SELECT game_id, team_id, period, p AS player_id, 0 AS side, n, kind, lft, cut FROM rc UNION ALL SELECT game_id, team_id, period, q, 1, n, kind, lft, cut FROM rc WHERE kind = 'sub'),
  own AS (SELECT game_id, team_id, period, player_id, min((n, side)) AS place, arg_min(CASE side WHEN 0 THEN 'out' ELSE 'in' END, (n, side)) FILTER (kind = 'sub') AS first, min(n) FILTER (kind <> 'sub') AS acted, any_value(cut) AS cut FROM sn GROUP BY 1, 2, 3, 4),
  bf AS (SELECT game_id, team_id, period + 1 AS period, player_id, bool_or(kind = 'sub' AND side = 1) AS came_in, bool_or(kind = 'sub' AND side = 1 AND lft <= 6) AS late_in, bool_or(kind = 'sub' AND side = 0 AND lft <= 6) AS late_out, coalesce(arg_max(lft, n) FILTER (kind <> 'sub') <= 30, false) AS closing FROM sn GROUP BY 1, 2, 3, 4),
  fl AS (SELECT *, coalesce(acted < coalesce(cut, 1000000), false) AS early, coalesce(acted <= coalesce(cut + 20, 1000000), false) AS acts, row_number() OVER (PARTITION BY game_id, team_id, period ORDER BY place NULLS LAST) AS rn FROM own FULL JOIN bf USING (game_id, team_id, period, player_id)),
  ev AS (SELECT game_id, team_id, period, list({{'p': player_id, 'seen': place IS NOT NULL, 'st': CASE first WHEN 'out' THEN 1050 WHEN 'in' THEN -1000 ELSE 50 END + CASE WHEN early THEN 500 ELSE 0 END + CASE WHEN first IS NULL AND acts THEN 225 ELSE 0 END + CASE WHEN late_out AND first IS DISTINCT FROM 'in' THEN 175 ELSE 0 END - CASE WHEN late_in AND NOT early THEN 175 ELSE 0 END,
    'cp': CASE WHEN first IS DISTINCT FROM 'in' THEN 100 ELSE 0 END + CASE WHEN first IS NULL AND NOT early THEN CASE WHEN came_in THEN -120 ELSE 0 END + CASE WHEN closing THEN 140 ELSE 0 END ELSE 0 END}} ORDER BY rn) AS l FROM fl GROUP BY 1, 2, 3),
  mv AS (SELECT game_id, team_id, period, list({{'f': CAST([] AS BIGINT[]), 'o': p, 'i': q}} ORDER BY n) AS m FROM rc WHERE kind = 'sub' GROUP BY 1, 2, 3),
  fr AS MATERIALIZED (SELECT t.game_id, t.team_id, g.period, row_number() OVER (PARTITION BY t.game_id, t.team_id ORDER BY g.period) AS num, coalesce(ev.l, []) AS l, coalesce(mv.m, []) AS m FROM (SELECT DISTINCT game_id, team_id FROM pbp) t JOIN (SELECT DISTINCT game_id, period FROM pbp) g ON g.game_id = t.game_id
    LEFT JOIN ev ON ev.game_id = t.game_id AND ev.team_id = t.team_id AND ev.period = g.period LEFT JOIN mv ON mv.game_id = t.game_id AND mv.team_id = t.team_id AND mv.period = g.period),
  fold AS (SELECT DISTINCT game_id, team_id, CAST(0 AS BIGINT) AS period, CAST(0 AS BIGINT) AS num, CAST([] AS BIGINT[]) AS held, [x for x in [{{'n': CAST(0 AS BIGINT), 'i': CAST(0 AS BIGINT), 'p': CAST(0 AS BIGINT)}}] if false] AS top FROM fr UNION ALL
    SELECT game_id, team_id, period, num, list_reduce(m, lambda acc, mm: {{'f': CASE WHEN mm.i IS NULL OR list_contains([xx for xx in acc.f if xx <> mm.o], mm.i) THEN [xx for xx in acc.f if xx <> mm.o] ELSE list_append([xx for xx in acc.f if xx <> mm.o], mm.i) END, 'o': CAST(NULL AS BIGINT), 'i': CAST(NULL AS BIGINT)}}, {{'f': [zz.p for zz in top], 'o': CAST(NULL AS BIGINT), 'i': CAST(NULL AS BIGINT)}}).f, top FROM (
    SELECT *, list_reverse_sort([{{'n': CAST(cand[jj].st + CASE WHEN list_contains(held, cand[jj].p) THEN cand[jj].cp ELSE 0 END AS BIGINT), 'i': CAST(-jj AS BIGINT), 'p': CAST(cand[jj].p AS BIGINT)}} for jj in range(1, len(cand) + 1)])[1:5] AS top FROM (
    SELECT *, list_concat([yy for yy in l if yy.seen], [coalesce([yy for yy in l if yy.p = hh][1], {{'p': hh, 'seen': false, 'st': 50, 'cp': 100}}) for hh in list_sort([hh for hh in held if NOT list_contains([yy.p for yy in l if yy.seen], hh)])]) AS cand FROM (
    SELECT fr.game_id, fr.team_id, fr.period, fr.num, fr.l, fr.m, fold.held FROM fold JOIN fr ON fr.game_id = fold.game_id AND fr.team_id = fold.team_id AND fr.num = fold.num + 1))))
  SELECT game_id, team_id, period, z.p AS player_id, z.n AS points FROM (SELECT game_id, team_id, period, unnest(top) AS z FROM fold)"""


@query(_CARRY)
def carried_openings(spark, d):
    """Openings of periods by evidence that includes the lineup rebuilt to the end of the period before."""
    return openings.carried_openings(laid(play_by_play(spark, d).drop("points", "three", "description"), "game_id"))
