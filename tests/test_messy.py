"""Messy feeds: substitution texts, batches of one clock, known lineups, starters that nobody names, two sources of lineups."""

import random
import uuid

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline import lineage
from tallyline.functions import names
from tallyline.functions import scalars as S
from tallyline.operators import openings, substitutions, tracking
from tallyline.sources.messy import messy_events

EVENTS = "game_id long, home_id long, away_id long, period long, elapsed long, action_number long, kind string, team_id long, player_id long, player_name string, description string, points long"
NAMES = {10: "Ann Stone", 11: "Ben Okoro", 12: "Jo Smith", 13: "Dan Reed", 14: "Eve Lund Jr.", 15: "Jack Smith", 16: "Gus Moss"}


def feed(spark, rows):
    """Rows (elapsed, kind, team, player, text, points) of game 1, in order."""
    full = [(1, 1, 2, (t - 1) // 720 + 1 if t else 1, t, n, kind, team, p, NAMES.get(p), text, pts) for n, (t, kind, team, p, text, pts) in enumerate(rows)]
    return spark.createDataFrame(full, EVENTS).repartition(2)


def known(spark, *rows):
    base = [(1, t, "period", 1, [t * 10 + k for k in range(5)]) for t in (1, 2)]
    return spark.createDataFrame([*base, *rows], "game_id long, team_id long, mark string, at long, lineup array<long>")


def segments(events, given, **options):
    out = tracking.track_lineups(substitutions.expand_substitutions(events), given, **options)
    return [(r.start, r.end, r.home_lineup, r.home_points) for r in out.orderBy("start").collect()]


@pytest.mark.parametrize(
    ("text", "keys"),
    [
        ("MISS Ja. Green 26ft 3PT", {"ja", "green", "jagreen", "jgreen"}), ("Smith Jr. Free Throw 1 of 2", {"smith", "smithjr"}), ("Jump Ball Okoro vs. Lund: Tip to Reed", {"okoro"}),
        ("REBOUND", set()), ("", set()), (None, set()), ("Van Dyke Layup", {"van", "dyke", "vandyke", "vdyke"}), ("76ers Timeout", {"timeout"}),
    ],
)
def test_names_in_texts(spark, text, keys):
    got = spark.createDataFrame([(text,)], "t string").select(S.text_name_keys(F.col("t"))).first()[0]
    assert set(got) == keys


def test_ambiguous_names(spark):
    """Two Smiths: a lone surname keeps both, an initial that both share is settled by who acts first, the row's id is who leaves."""
    rows = [(10, "made", 1, 12, "Smith Layup", 2), (20, "made", 1, 15, "Smith Layup", 2), (30, "made", 1, 10, "Stone Layup", 2)]
    rows += [(100, "sub", 1, 10, "SUB: Smith FOR Stone", 0), (110, "sub", 1, None, "SUB: J. Smith FOR Ann Stone", 0), (120, "sub", 1, 13, "SUB: Nobody FOR Somebody", 0), (130, "turnover", 1, 15, "Smith Turnover", 0), (140, "sub", 1, 11, "timeout", 0)]
    out = substitutions.expand_substitutions(feed(spark, rows)).where("elapsed >= 100").orderBy("action_number", F.desc("side")).collect()
    got = [(r.elapsed, r.side, r.player_id, r.candidates) for r in out]
    assert got == [
        (100, "out", 10, []), (100, "in", None, [12, 15]), (110, "out", 10, []), (110, "in", 15, []), (120, "out", 13, []), (120, "in", None, []), (130, None, 15, []), (140, None, 11, []),
    ]


def test_season_names_serve_where_the_game_says_nothing(spark):
    events = feed(spark, [(30, "made", 1, 10, "Stone Layup", 2), (100, "sub", 1, 10, "SUB: Moss FOR Stone", 0)])
    season = spark.createDataFrame([(1, "moss", 16), (2, "moss", 99)], "team_id long, key string, player_id long")
    assert [r.player_id for r in substitutions.expand_substitutions(events, season).where("side = 'in'").collect()] == [16]


def test_substitution_waits_for_free_throws(spark):
    """ft_sub: the substitution stands before two free throws on its clock and counts after them."""
    rows = [(50, "made", 1, 10, "x", 2), (60, "made", 1, 15, "Smith", 0), (100, "sub", 1, 10, "SUB: Jack Smith FOR Ann Stone", 0), (100, "free_throw", 1, 11, "Okoro Free Throw 1 of 2", 1), (100, "free_throw", 1, 11, "Okoro Free Throw 2 of 2", 1), (200, "made", 1, 15, "Smith", 3)]
    assert segments(feed(spark, rows), known(spark)) == [(0, 100, [10, 11, 12, 13, 14], 4), (100, 200, [11, 12, 13, 14, 15], 3)]
    # one with points after it on its clock and no free throw counts at once
    rows[3:5] = [(100, "made", 1, 11, "Okoro", 2)]
    assert segments(feed(spark, rows), known(spark)) == [(0, 100, [10, 11, 12, 13, 14], 2), (100, 200, [11, 12, 13, 14, 15], 5)]


def test_one_segment_per_lineup_and_clock(spark):
    """Texts that move nobody part the points of a clock into batches; its segments of one lineup are one."""
    nobody = (100, "sub", 1, 15, "SUB: Nobody FOR Somebody", 0)
    rows = [(50, "made", 1, 10, "x", 2), nobody, (100, "made", 1, 11, "x", 3), nobody, (100, "made", 1, 11, "x", 1), nobody, (200, "made", 1, 11, "x", 2)]
    five = [10, 11, 12, 13, 14]
    assert sorted(segments(feed(spark, rows), known(spark))) == [(0, 100, five, 2), (100, 100, five, 4), (100, 200, five, 2)]


def test_batches():
    move = lambda side, p, text, c=(): {"side": side, "player_id": p, "candidates": list(c), "description": text}
    floor = {10, 11, 12, 13, 14}
    # neutral_sub: 10 leaves and comes in on one clock, so 10 stays
    assert tracking.apply_batch(floor, [move("out", 10, "a"), move("in", 10, "b"), move("out", 11, "c"), move("in", 15, "c")]) == {10, 12, 13, 14, 15}
    # a pair is made only whole; a second text for the same exit is dropped with its pair
    assert tracking.apply_batch(floor, [move("out", 10, "a"), move("in", 15, "a"), move("out", 10, "b"), move("in", 16, "b")]) == {11, 12, 13, 14, 15}
    # candidates are settled by who is on the floor; entries of those who are on it, and exits of those who are not, do nothing
    assert tracking.apply_batch(floor, [move("out", 10, "a"), move("in", None, "a", (12, 15))]) == {11, 12, 13, 14, 15}
    assert tracking.apply_batch(floor, [move("out", 10, "a"), move("in", None, "a", (15, 16))]) == {11, 12, 13, 14}
    assert tracking.apply_batch(floor, [move("out", 19, "a"), move("in", 12, "a")]) == floor
    assert tracking.apply_batch(set(), [move("in", 10, "a"), move("in", None, "b")]) == {10}


def test_known_lineups(spark):
    rows = [(30, "made", 1, 15, "Smith", 0), (100, "sub", 1, 10, "SUB: Nobody FOR Ann Stone", 0), (300, "sub", 1, 11, "SUB: Jack Smith FOR Ben Okoro", 0), (300, "made", 1, 12, "x", 2), (800, "made", 1, 12, "y", 2)]
    five, other = [11, 12, 13, 14, 15], [20, 21, 22, 23, 24]
    marks = [(1, 1, "elapsed", 300, five), (1, 2, "elapsed", 300, other)]
    # four are left at 100; the known five of 300 stand, and the text of 300 is ignored
    assert segments(feed(spark, rows), known(spark, *marks)) == [(0, 100, [10, 11, 12, 13, 14], 0), (100, 300, [11, 12, 13, 14], 0), (300, 800, five, 4)]
    # complete lineups are left alone unless forced
    whole = [r for r in rows if r[0] != 100]
    assert segments(feed(spark, whole), known(spark, *marks))[-1] == (0, 800, [10, 11, 12, 13, 14], 4)
    assert segments(feed(spark, whole), known(spark, *marks), forced=True)[-1] == (300, 800, five, 4)
    # a known opening of period 2 comes with its first event
    got = segments(feed(spark, [*whole[:1], (700, "made", 1, 12, "z", 1), whole[-1], (900, "made", 1, 15, "z", 1)]), known(spark, (1, 1, "period", 2, five)))
    assert got == [(0, 800, [10, 11, 12, 13, 14], 1), (800, 900, five, 3)]


def test_sides_need_five(spark):
    rows = [(100, "sub", 1, 10, "SUB: Nobody FOR Ann Stone", 0), (300, "made", 2, 20, "x", 2)]
    out = tracking.full_sides(tracking.track_lineups(substitutions.expand_substitutions(feed(spark, rows)), known(spark)))
    assert sorted((r.start, r.end, r.team_id, r.points) for r in out.collect()) == [(0, 100, 1, 0), (0, 100, 2, 0)]


def tiers(events):
    return {(r.team_id, r.player_id): r.tier for r in openings.tiered_starters(substitutions.expand_substitutions(events)).collect()}


def test_tiered_starters(spark):
    act = lambda t, p: (t, "made", 1, p, "", 2)
    sub = lambda t, i, o: (t, "sub", 1, o, f"SUB: {NAMES[i]} FOR {NAMES[o]}", 0)
    rows = [act(20, 10), act(40, 11), sub(100, 15, 12), act(120, 15), sub(200, 16, 11), act(210, 16), sub(300, 12, 13), act(400, 14)]
    # 12, 11, 13 leave first; 10 acted before the first substitution; 14 fills the fifth place; 15 and 16 came in
    assert tiers(feed(spark, rows)) == {(1, 12): 1, (1, 11): 1, (1, 13): 1, (1, 10): 2, (1, 14): 3}
    # without substitutions: the first window that shows five
    assert tiers(feed(spark, [act(20 + 50 * k, 10 + k) for k in range(6)])) == {(1, 10 + k): 300 for k in range(5)}
    assert tiers(feed(spark, [act(20, 10), act(700, 11)])) == {}


def test_ranked_openings(spark):
    act = lambda t, p: (t, "made", 1, p, "", 2)
    sub = lambda t, i, o: (t, "sub", 1, o, f"SUB: {NAMES[i]} FOR {NAMES[o]}", 0)
    first = [act(10 + k, p) for k, p in enumerate(NAMES)]
    rows = [*first, act(730, 10), sub(800, 15, 11), act(810, 15), act(820, 12), sub(900, 16, 13), act(1000, 16), act(1100, 14)]
    got = {r.player_id: r["rank"] for r in openings.ranked_openings(substitutions.expand_substitutions(feed(spark, rows))).collect()}
    assert got == {10: 0, 11: 0, 12: 1, 13: 2, 14: 1}
    assert openings.ranked_openings(substitutions.expand_substitutions(feed(spark, rows[:-1]))).count() == 0  # four are no lineup


def test_fallback_by_segment(spark):
    ends = spark.createDataFrame([(1, 1440, 1, 2)], "game_id long, game_seconds long, home_id long, away_id long")
    rows = [(1, t, t * 10 + k, 0, 1440) for t in (1, 2) for k in range(5) if (t, k) != (1, 0)] + [(1, 1, 10, 0, 300), (1, 1, 15, 720, 1440), (1, 1, 10, 900, 1000)]
    primary = spark.createDataFrame(rows, "game_id long, team_id long, player_id long, start long, end long")
    moves = spark.createDataFrame([(1, 1, 300, 10, "out"), (1, 1, 300, 16, "in"), (1, 1, 800, 11, "out")], "game_id long, team_id long, elapsed long, player_id long, side string")
    out = openings.sides_with_fallback(primary, moves, ends).where("team_id = 1").orderBy("start").collect()
    # the rotations lack a fifth from 300 to 720 (the text of 300 knows), hold six from 900 to 1000; from 800 on the texts lack 11
    assert [(r.start, r.end, r.lineup, r.source) for r in out] == [
        (0, 300, [10, 11, 12, 13, 14], "primary"), (300, 720, [11, 12, 13, 14, 16], "fallback"), (720, 800, [11, 12, 13, 14, 15], "primary"), (800, 900, [11, 12, 13, 14, 15], "primary"), (1000, 1440, [11, 12, 13, 14, 15], "primary"),
    ]


CARRY = "game_id long, period long, elapsed long, action_number long, kind string, team_id long, player_id long, in_id long"


def plain_carry(rows):
    """carried_openings() of one team as one loop over its rows (period, elapsed, kind, player, in)."""
    floor, out = set(), []
    for period in sorted({r[0] for r in rows}):
        mine, last = [(n, *r) for n, r in enumerate(rows) if r[0] == period], [(n, *r) for n, r in enumerate(rows) if r[0] == period - 1]
        cut = min((n for n, *r in mine if r[2] == "sub"), default=None)
        seen, first, acted = [], {}, {}
        for n, _, _, kind, p, q in mine:
            for who, side in ((p, "out"), (q, "in")):
                if who is None or kind in ("technical", "ejection"):
                    continue
                seen += [] if who in seen else [who]
                if kind == "sub":
                    first.setdefault(who, side)
                else:
                    acted.setdefault(who, n)
        left = lambda r: period_end(r[1]) - r[2]
        subs, acts = [r for r in last if r[3] == "sub"], [r for r in last if r[3] not in ("sub", "technical", "ejection")]
        scores = []
        for i, p in enumerate(seen + sorted(floor - set(seen))):
            early = p in acted and (cut is None or acted[p] < cut)
            quiet = p in floor and not early and p not in first
            n = 1000 * (first.get(p) == "out") + 500 * early + 100 * (p in floor and first.get(p) != "in") + 225 * (p not in first and p in acted and (cut is None or acted[p] <= cut + 20))
            n += 175 * (first.get(p) != "in" and any(r[4] == p and left(r) <= 6 for r in subs)) - 175 * (not early and any(r[5] == p and left(r) <= 6 for r in subs)) - 120 * (quiet and any(r[5] == p for r in subs))
            mine_last = [r for r in acts if r[4] == p]
            n += 140 * (quiet and bool(mine_last) and left(mine_last[-1]) <= 30) + (50 if first.get(p) != "in" else -1000)
            scores.append((n, -i, p))
        best = sorted(scores, reverse=True)[:5]
        out += [(period, p, n) for n, _, p in best]
        floor = {p for _, _, p in best}
        for r in mine:
            if r[3] == "sub":
                floor = (floor - {r[4]}) | ({r[5]} - {None})
    return sorted(out)


def period_end(p):
    return p * 720 if p <= 4 else 2880 + (p - 4) * 300


def test_carried_openings(spark):
    draw = random.Random(11)
    every, want = [], []
    for game in range(12):
        rows = []
        for period in range(1, 7):
            times = sorted(draw.sample(range(1, 720 if period <= 4 else 300), draw.choice([0, 4, 9])) + [period_end(period) - period_end(period - 1) - draw.choice([2, 20, 40])] * (game % 3 > 0))
            for t in times:
                kind = draw.choice(["sub", "made", "made", "missed", "technical"])
                rows.append((period, period_end(period - 1) + t, kind, draw.randint(1, 9) if draw.random() < 0.95 else None, draw.randint(1, 9) if kind == "sub" else None))
        if game == 0:
            rows = [r for r in rows if r[0] != 3]  # a period without events is no period
        every += [(game, r[0], r[1], n, r[2], 1, r[3], r[4]) for n, r in enumerate(rows)]
        want += [(game, *w) for w in plain_carry(rows)]
    got = openings.carried_openings(spark.createDataFrame(every, CARRY).repartition(3)).collect()
    assert sorted((r.game_id, r.period, r.player_id, r.points) for r in got) == sorted(want)
    assert openings.carried_openings(spark.createDataFrame([], CARRY)).count() == 0


def test_what_is_laid_down_is_dealt_by_game_again(spark):
    """Events, players and found names that are read from the checkpoint have their own number of tasks, which no later step merges."""
    out = substitutions.expand_substitutions(lineage.laid(messy_events(spark, "/root/testdata/sf0.001"), "game_id"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") >= 3


def test_names_are_keyed_once_per_distinct_text(spark):
    """Two texts in a thousand rows: two calls; null stays null."""
    marks = names.each(lambda _: uuid.uuid4().hex, T.StringType())
    rows = spark.range(1000).select(F.when(F.col("id") % 3 > 0, F.concat(F.lit("t"), F.col("id") % 3)).alias("t")).coalesce(1)
    assert rows.select(marks(F.col("t")).alias("m")).agg(F.countDistinct("m"), F.count_if(F.col("m").isNull())).first()[:] == (2, 334)


@pytest.mark.parametrize(
    ("name", "exact", "family", "own"),
    [
        ("Ann Stone", ["annstone", "astone"], ["stone", "stone"], ["annstone", "stone", "astone"]), ("Eve Lund Jr.", ["evelundjr", "elundjr"], ["lund", "lund"], ["evelundjr", "lundjr", "elundjr"]),
        ("A.C. O'Neal", ["aconeal", "aoneal"], ["oneal", "oneal"], ["aconeal", "oneal", "aoneal"]), ("Moss", ["moss", "moss"], ["moss", "moss"], ["moss", "mmoss"]), ("", ["", ""], [None, None], []),
    ],
)
def test_forms_of_names(name, exact, family, own):
    assert names.forms(name) == {"exact": exact, "family": family, "own": own}


def test_all_names_of_a_player_serve(spark):
    """A player whom a game calls by two names: forms of the first one, aliases of both and of the texts; sub texts teach nothing."""
    rows = [(10, "made", 1, 12, "Smith Layup", 2), (20, "sub", 1, 12, "SUB: Moss FOR Smith", 0)]
    other = feed(spark, rows).unionByName(feed(spark, [(5, "made", 1, 12, "Jay Smythe Layup", 2)]).withColumns({"player_name": F.lit("Jay Smythe"), "action_number": F.lit(9).cast("long")}))
    (got,) = substitutions.known_players(other).collect()
    assert got.exact == ["josmith", "jsmith"] and set(got.own) == {"josmith", "smith", "jsmith"}
    assert set(got.alias) == {"josmith", "smith", "jsmith", "jaysmythe", "smythe", "jsmythe", "jay"}


def test_expansion_joins_stay_where_events_are_dealt(spark):
    """Of what joins by game and team nothing is dealt anew or sorted, and what was laid down is read by column."""
    events = lineage.laid(messy_events(spark, "/root/testdata/sf0.001"), "game_id", "team_id", tasks=3)
    assert "ReadSchema: struct<game_id:bigint,team_id:bigint,points:bigint>" in events.select("game_id", "points")._jdf.queryExecution().executedPlan().toString()
    plan = substitutions.expand_substitutions(events, tasks=3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin [game_id") >= 4 and "SortMergeJoin" not in plan
    joins = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "REPARTITION_BY_NUM" in line]
    assert joins and all(", 3), REPARTITION_BY_NUM" in line for line in joins)


def test_games_are_folded_many_to_a_batch(spark):
    """Games in one batch, one without substitutions, one of whose lineups nothing is known, null points: each as if alone."""
    one = [(50, "made", 1, 10, "x", 2), (100, "sub", 1, 10, "SUB: Jack Smith FOR Ann Stone", 0), (100, "free_throw", 1, 11, "y", 1), (150, "made", 1, 15, "Smith", None), (200, "made", 2, 20, "z", 3)]
    games = [one, [r for r in one if r[1] != "sub"], one]
    events = None
    for g, rows in enumerate(games, 1):
        part = feed(spark, rows).withColumn("game_id", F.lit(g).cast("long"))
        events = part if events is None else events.unionByName(part)
    given = known(spark).unionByName(known(spark).withColumn("game_id", F.lit(2).cast("long")))
    out = tracking.track_lineups(substitutions.expand_substitutions(events), given, tasks=1)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapCoGroupsInArrow" not in plan
    five, later = [10, 11, 12, 13, 14], [11, 12, 13, 14, 15]
    assert sorted((r.game_id, r.start, r.end, r.home_lineup, r.home_points, r.away_points) for r in out.collect()) == [
        (1, 0, 100, five, 3, 0), (1, 100, 200, later, 0, 3), (2, 0, 200, five, 3, 3), (3, 0, 100, [], 3, 0), (3, 100, 200, [15], 0, 3),
    ]


def test_forced_marks_over_batches(spark):
    """Forced lineups of a known time hold in each game of a batch."""
    lists = {"period": [1, 1], "elapsed": [100, 300], "team_id": [1, 1], "side": [0, 0], "throw": [False, False], "player_id": [0, 0], "description": ["", ""], "candidates": [None, None], "value0": [2, 3]}
    types = {"candidates": pa.list_(pa.int64()), "throw": pa.bool_(), "description": pa.string()}
    events = pa.ListArray.from_arrays(pa.array([0, 2, 4], pa.int32()), pa.StructArray.from_arrays([pa.array(v * 2, types.get(c, pa.int64())) for c, v in lists.items()], list(lists)))
    marks = [{"team_id": t, "mark": m, "at": at, "lineup": [10 * t + k + at // 300 for k in range(5)]} for t in (1, 2) for m, at in (("period", 1), ("elapsed", 300))]
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8]), pa.array([1, 1]), pa.array([2, 2]), pa.array([marks, marks]), events], ["game_id", "home_id", "away_id", "given", "events"])
    for forced, want in ((True, [(0, 300, [10, 11, 12, 13, 14], 2.0), (300, 300, [11, 12, 13, 14, 15], 3.0)]), (False, [(0, 300, [10, 11, 12, 13, 14], 5.0)])):
        got = [r for b in tracking._track(("points",), forced)(iter([batch, batch])) for r in b.to_pylist()]
        assert [(r["game_id"], r["start"], r["end"], r["home_lineup"], r["home_points"]) for r in got] == [(g, *w) for g in (7, 8, 7, 8) for w in want]
