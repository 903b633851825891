"""Rebuilt games, facts, box sources, models and streams on hand-made rows and against plain versions."""

import math
import tempfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyline import lineage
from tallyline.functions import scalars as S
from tallyline.operators import decay, facts, lineups, reconstruct
from tallyline.plans import ridge
from tallyline.sources import boxes, messy, pbp
from tallyline.streaming import incremental, ordered

EVENTS = "game_id long, home_id long, away_id long, period long, elapsed long, action_number long, kind string, team_id long, player_id long, in_id long, points long"


def game(spark):
    """Team 1 has players 10..15, team 2 players 20..24; 15 replaces 10 at 300 and leaves for 10 again at 900."""
    rows = [
        (1, 1, 2, 1, 100, 1, "made", 1, 10, None, 2), (1, 1, 2, 1, 300, 2, "sub", 1, 10, 15, 0), (1, 1, 2, 1, 300, 3, "free_throw", 1, 11, None, 1), (1, 1, 2, 1, 301, 4, "made", 2, 20, None, 3),
        (1, 1, 2, 2, 800, 5, "missed", 1, 15, None, 0), (1, 1, 2, 2, 801, 6, "defensive_rebound", 2, 21, None, 0), (1, 1, 2, 2, 900, 7, "sub", 1, 15, 10, 0), (1, 1, 2, 2, 1000, 8, "turnover", 2, 22, None, 0),
    ]
    events = spark.createDataFrame(rows, EVENTS)
    starters = spark.createDataFrame([(1, t, t * 10 + k) for t in (1, 2) for k in range(5)], "game_id long, team_id long, player_id long")
    ends = spark.createDataFrame([(1, 1440)], "game_id long, game_seconds long")
    return events, starters, ends


def test_stints_by_hand(spark):
    events, starters, ends = game(spark)
    sides = reconstruct.stint_sides(reconstruct.rotations(starters, events.where("kind = 'sub'"), ends), ends)
    got = {(r.start, r.end, r.team_id): (r.lineup, r.points, r.points_against) for r in reconstruct.with_points(sides, events, ["points"]).collect()}
    assert sorted({k[:2] for k in got}) == [(0, 300), (300, 720), (720, 900), (900, 1440)]
    assert got[(0, 300, 1)] == ([10, 11, 12, 13, 14], 3, 0)  # the free throw at 300 belongs to the stint that ends there
    assert got[(300, 720, 1)] == ([11, 12, 13, 14, 15], 0, 3)
    assert got[(900, 1440, 1)][0] == [10, 11, 12, 13, 14]
    poss = reconstruct.possessions(events, sides).orderBy("poss_index").collect()
    assert [(p.poss_index, p.offense_team, p.ended_by, p.points) for p in poss] == [(1, 1, "made", 2), (2, 1, "free_throw", 1), (3, 2, "made", 3), (4, 1, "period", 0), (5, 1, "defensive_rebound", 0), (6, 2, "turnover", 0), (7, 1, "period", 0)]


def test_free_throws_close_a_possession_with_the_last_one(spark):
    _, starters, ends = game(spark)
    feed = [(10, "jump_ball", 2, 0, None), (20, "missed", 1, 0, None), (21, "offensive_rebound", 1, 0, None), (30, "free_throw", 1, 1, "Free Throw 1 of 2"), (31, "free_throw", 1, 1, "Free Throw 2 of 2"), (700, "free_throw", 2, 1, "MISS Free Throw 1 of 3")]
    rows = [(1, 1, 2, 1, t, i, k, team, team * 10, None, p, text) for i, (t, k, team, p, text) in enumerate(feed)]
    events = spark.createDataFrame(rows, EVENTS + ", description string")
    sides = reconstruct.stint_sides(reconstruct.rotations(starters, events.where("kind = 'sub'"), ends), ends)
    marked = events.withColumn("last_throw", S.last_of_sequence(F.col("description")))
    got = [(r.offense_team, r.ended_by, r.points) for r in reconstruct.possessions(marked, sides).orderBy("poss_index").collect()]
    assert got == [(1, "free_throw", 2), (2, "period", 1)]
    # before any close, a period goes to who last got the ball, not to who shot
    opening = reconstruct.possessions(marked.where("action_number <= 1"), sides).collect()
    assert [(r.offense_team, r.ended_by) for r in opening] == [(2, "period")]


def test_incomplete_lineups_give_no_stint_and_no_possession(spark):
    events, starters, ends = game(spark)
    short = reconstruct.stint_sides(reconstruct.rotations(starters.where("player_id <> 24"), events.where("kind = 'sub'"), ends), ends)
    assert short.count() == 0 and reconstruct.possessions(events, short).count() == 0


def test_moves_are_repaired_and_neutral_pairs_vanish(spark):
    moved = spark.createDataFrame([(1, 1, 7, 50, -1), (1, 1, 8, 10, 1), (1, 1, 8, 20, 1), (1, 1, 8, 30, -1)], "game_id long, team_id long, player_id long, at long, sign int")
    assert sorted((r.player_id, r.at, r.sign) for r in reconstruct.repaired(moved).collect()) == [(7, 0, 1), (7, 50, -1), (8, 10, 1), (8, 30, -1)]
    subs = spark.createDataFrame([(1, 1, 60, 10, 15), (1, 1, 60, 15, 10)], "game_id long, team_id long, elapsed long, player_id long, in_id long")
    assert reconstruct.moves(moved.limit(0).select("game_id", "team_id", "player_id"), subs).count() == 0


def test_openings(spark):
    events, _, _ = game(spark)
    got = {(r.period, r.team_id, r.player_id): r.evidence for r in reconstruct.opening_lineups(events, ["game_id", "period", "team_id"]).collect()}
    assert got == {(1, 1, 10): 1, (1, 1, 11): 1, (1, 2, 20): 1, (2, 1, 15): 1, (2, 2, 21): 1, (2, 2, 22): 1}
    prior = spark.createDataFrame([(1, 2, 1, 12), (1, 2, 1, 10)], "game_id long, period long, team_id long, player_id long")
    carried = reconstruct.opening_lineups(events, ["game_id", "period", "team_id"], prior).where("evidence = 9").collect()
    assert [r.player_id for r in carried] == [12]  # 10 enters later in the period


def test_ambiguous_alias_keeps_its_candidates(spark):
    aliases = spark.createDataFrame([(1, "smith", 5), (1, "smith", 6), (1, "jones", 7)], "team long, key string, player_id long")
    names = spark.createDataFrame([(1, "smith"), (1, "jones"), (1, "none")], "team long, key string")
    assert {r.key: (r.player_id, r.candidates) for r in reconstruct.unique_aliases(names, aliases, ["team", "key"]).collect()} == {"smith": (None, "5,6"), "jones": (7, "7"), "none": (None, None)}


def test_ties_in_facts(spark):
    teams = spark.createDataFrame([(1, 1, True, 90, 91.0), (1, 2, False, 90, 90.0)], "game_id long, team_id long, is_home boolean, pts long, pts_adj double")
    games = facts.adjusted_games(teams)
    assert games.first().flipped and {r.team_id: r.wins for r in facts.luck_table(games).collect()} == {1: 0, 2: 1}
    rows = spark.createDataFrame([(1, 1, 1, 90, 1.0), (1, 2, 2, 90, 0.0)], "game_id long, player_id long, team_id long, pts long, minutes double")
    assert sorted((r.player_id, r.played, r.won) for r in facts.win_ledger(rows).collect()) == [(1, True, False), (2, False, False)]


def test_box_texts(spark):
    texts = spark.createDataFrame([(1, '{"columns":["b","a"],"data":[["x","1"],[null,"q"]]}'), (2, "broken"), (3, None)], "k long, j string")
    assert [tuple(r) for r in boxes.matrix_rows(texts, "j", {"a": "bigint", "b": "string", "c": "double"}).orderBy("k", F.col("b").desc()).collect()] == [(1, 1, "x", None), (1, None, None, None)]
    box = '{"gameId":"7","teams":[{"teamId":1,"players":[{"personId":5,"played":"1","statistics":{"points":9,"minutes":"PT10M"}},{"personId":6,"played":"0"}]}]}'
    assert [tuple(r) for r in boxes.box_rows(spark.createDataFrame([(box,)], "j string"), "j").collect()] == [("7", 1, 5, 9, "PT10M")]


def test_season_files(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for year in (2020, 2021):
        with open(f"{path}/stints_{year}.csv", "w") as f:
            f.write(f"game_id,points\n00{year},3\n")
    got = boxes.read_season_files(spark, f"{path}/stints_*.csv", "game_id string, points int")
    assert sorted(map(tuple, got.collect())) == [("002020", 3, 2020), ("002021", 3, 2021)]
    boxes.write_by_season(got, f"{path}/out")
    assert spark.read.parquet(f"{path}/out").where("season = 2021").count() == 1


def test_concentration(spark):
    assert spark.range(1).select(decay.log_gamma(F.lit(0.3))).first()[0] == pytest.approx(math.lgamma(0.3), abs=1e-10)
    rng = np.random.default_rng(3)
    rows = [(int(a), int(rng.binomial(a, rng.beta(12.0, 28.0)))) for a in rng.integers(50, 200, 400)]
    kappa = decay.concentration_fit(spark.createDataFrame(rows, "a long, m long"), "a", "m", F.lit(0.3))

    def ll(k):
        return sum(math.lgamma(0.3 * k + m) + math.lgamma(0.7 * k + a - m) - math.lgamma(k + a) - math.lgamma(0.3 * k) - math.lgamma(0.7 * k) + math.lgamma(k) for a, m in rows)

    grid = np.exp(np.linspace(math.log(5), math.log(2000), 2000))
    assert kappa == pytest.approx(grid[np.argmax([ll(k) for k in grid])], rel=0.01)


@pytest.mark.parametrize("on_driver", [5000, 3])
def test_offence_defence_ridge_is_the_normal_equations(spark, on_driver, monkeypatch):
    monkeypatch.setattr(ridge, "MAX_FEATURES", on_driver)  # beyond it: conjugate gradients on the table of products
    rng = np.random.default_rng(5)
    rows = [(g, 1, 1, 2, [int(x) for x in rng.choice(8, 5, False)], [int(x) for x in rng.choice(8, 5, False) + 8], float(rng.integers(20, 200)), int(rng.integers(0, 5)), int(rng.integers(0, 5))) for g in range(60)]
    stints = spark.createDataFrame(rows, "game_id long, stint_index long, home_id long, away_id long, home_lineup array<long>, away_lineup array<long>, seconds double, home_pts long, away_pts long")
    got = {r.player_id: r for r in ridge.offence_defence_fit(lineups.offence_defence_design(stints), 50.0, 80.0).collect()}
    x, y = [], []
    for _, _, _, _, h, a, sec, hp, ap in rows:
        for own, other, p in ((h, a, hp), (a, h, ap)):
            w, line = math.sqrt(sec / 24), np.zeros(32)
            line[own], line[[16 + o for o in other]] = w, -w
            x.append(line)
            y.append(p / (sec / 24) * 100 * w)
    x, y = np.array(x), np.array(y)
    xc = x - x.mean(0)
    coef = np.linalg.solve(xc.T @ xc + np.diag([50.0] * 16 + [80.0] * 16), xc.T @ (y - y.mean()))
    o, d = coef[:16] - coef[:16].mean(), coef[16:] - coef[16:].mean()
    for p in range(16):
        assert (got[p].offence, got[p].defence, got[p].total) == (pytest.approx(o[p]), pytest.approx(d[p]), pytest.approx(o[p] + d[p]))


def test_windows_take_possessions_where_they_cover_the_games(spark):
    rng = np.random.default_rng(2)
    pick = lambda base: [int(x) for x in rng.choice(7, 5, False) + base]
    lines = [(g, 0, 1, 2, pick(0), pick(10), 60.0, int(rng.integers(0, 5)), int(rng.integers(0, 5)), 2000 + g % 2) for g in range(40)]
    stints = spark.createDataFrame(lines, "game_id long, stint_index long, home_id long, away_id long, home_lineup array<long>, away_lineup array<long>, seconds double, home_pts long, away_pts long, season int")
    poss = spark.createDataFrame([(x[0], i, x[4], x[5], int(rng.integers(0, 3)), x[9]) for x in lines if x[9] == 2001 for i in range(3)], "game_id long, poss_index long, off_lineup array<long>, def_lineup array<long>, points long, season int")
    out = ridge.plus_minus_windows(stints, {"late": (2001, None), "all": (None, None), "none": (2010, 2000)}, [100.0], poss)
    assert {(r.window, r.source) for r in out.collect()} == {("late", "possessions"), ("all", "stints")}
    alone = {r.player_id: r.total for r in ridge.offence_defence_fit(lineups.possession_design(poss), 100.0, 100.0).collect()}
    assert {r.player_id: pytest.approx(r.total) for r in out.where("window = 'late'").collect()} == alone


def plain_gram(rows):
    """Features in order (-2 is y, -1 the constant) and the Gram matrix of rows (features with signs, y, w)."""
    names = sorted({f for fx, _, _ in rows for f, _ in fx if f is not None and f >= 0} | {-2, -1})
    x = np.zeros((len(rows), len(names)))
    for r, (fx, y, w) in enumerate(rows):
        x[r, 0], x[r, 1] = (y or 0.0) * w, 1.0
        for f, s in fx:
            if f is not None and f >= 0:
                x[r, names.index(f)] += s * w
    return names, x.T @ x


def test_products_are_summed_where_the_rows_lie(spark):
    rng = np.random.default_rng(9)
    rows = [([(int(f), float(rng.choice([-1, 1]))) for f in rng.integers(0, 6, rng.integers(0, 5))], float(rng.integers(0, 9)), float(rng.integers(1, 4))) for _ in range(60)]  # features come twice
    rows += [([(3, 1.0), (-4, 1.0), (None, 1.0), (3, 1.0)], None, 2.0)]
    table = ridge.gram_table(spark.createDataFrame([*rows, (None, 1.0, 1.0)], "fx array<struct<f:long,s:double>>, y double, w double"))
    assert "Generate" not in table._jdf.queryExecution().executedPlan().toString()  # no row for each product
    names, want = plain_gram(rows)
    got = {(r.i, r.j): r.g for r in table.collect()}
    assert {k for k in got if k[0] < 0} == {(i, j) for i in (-2, -1) for j in names if i <= j}
    assert all(got.get((i, j), 0.0) == pytest.approx(want[a, b]) for a, i in enumerate(names) for b, j in enumerate(names) if a <= b)


def test_many_features_are_summed_without_a_square(monkeypatch):
    rows = pa.table({"fx": pa.array([[(7, 1.0), (90_000, -1.0)], [(7, 1.0)]], pa.list_(pa.struct([("f", pa.int64()), ("s", pa.float64())]))), "y": [2.0, 3.0], "w": [1.0, 2.0]})
    want = [c.tolist() for c in ridge._products(rows, ())]
    monkeypatch.setattr(ridge, "DENSE", 0)
    assert [c.tolist() for c in ridge._products(rows, ())] == want


def test_stints_held_as_lineups_give_the_written_design(spark):
    stints = spark.createDataFrame([(1, 0, 1, 2, [0, 1, 2], [10, 11], 60.0, 4, 2), (1, 1, 1, 2, [0, None, -3], [10, 10], 90.0, None, 3), (1, 2, 1, 2, None, [10], 90.0, 1, 3), (1, 3, 1, 2, [1], [11], 5.0, 1, 3)], "game_id long, stint_index long, home_id long, away_id long, home_lineup array<long>, away_lineup array<long>, seconds double, home_pts long, away_pts long")
    packed, sides = lineups.packed_stints(stints)
    of = lambda table: {(r.i, r.j): pytest.approx(r.g) for r in table.collect()}
    assert of(ridge.gram_table(packed, (), sides)) == {k: v.expected for k, v in of(ridge.gram_table(lineups.offence_defence_design(stints))).items()}


def test_margin_ridge_sees_both_sides(spark):
    rng = np.random.default_rng(7)
    rows = [(g, 0, [int(x) for x in rng.choice(8, 5, False)], [int(x) for x in rng.choice(8, 5, False) + 8], float(rng.integers(20, 200)), int(rng.integers(0, 9)), int(rng.integers(0, 9))) for g in range(80)]
    stints = spark.createDataFrame(rows, "game_id long, stint_index long, home_lineup array<long>, away_lineup array<long>, seconds double, home_pts long, away_pts long")
    got = {r.player_id: r.coefficient for r in ridge.ridge_fit(lineups.margin_design(stints), 40.0).collect()}
    x, y = np.zeros((80, 16)), np.zeros(80)
    for i, (_, _, h, a, sec, hp, ap) in enumerate(rows):
        w = math.sqrt(sec / 24)
        x[i, h], x[i, a], y[i] = w, -w, (hp - ap) / (sec / 24) * 100 * w
    xc = x - x.mean(0)
    want = np.linalg.solve(xc.T @ xc + 40.0 * np.eye(16), xc.T @ (y - y.mean()))
    assert [got[i] for i in range(16)] == pytest.approx(want)


def batches(spark, df, parts):
    """A stream over `parts` files of a table, one per micro-batch."""
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for part in parts:
        df.where(part).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_decay_stream_is_the_window_form(spark):
    rows = spark.createDataFrame([(i % 3, i, i * 7 % 5 % 2) for i in range(60)], "player_id long, event_id long, made long")
    got = {(r.player_id, r.event_id): (r.a_before, r.m_before) for r in incremental.drain(incremental.decay_stream(batches(spark, rows, ["event_id < 25", "event_id >= 25"]), 10.0)).collect()}
    want = decay.decayed_before(rows.withColumn("a", F.lit(1)), "player_id", ["event_id"], "a", "made", 10.0).collect()
    assert len(got) == len(want) == 60
    for r in want:
        assert got[r.player_id, r.event_id] == (pytest.approx(r.a_before), pytest.approx(r.m_before))


def test_possession_stream_carries_open_points_over_batches(spark):
    events = game(spark)[0].select("game_id", "action_number", "team_id", "kind", "points")
    out = incremental.drain(incremental.possession_stream(batches(spark, events, ["action_number <= 2", "action_number > 2"]), reconstruct.ENDS))
    assert [(r.poss_index, r.ended_by, r.points) for r in out.orderBy("poss_index").collect()] == [(1, "made", 2), (2, "free_throw", 1), (3, "made", 3), (4, "defensive_rebound", 0), (5, "turnover", 0)]


def test_possessions_of_batches_are_those_of_the_stream(spark):
    rng = np.random.default_rng(4)
    kinds = ["made", "turnover", "missed", "sub", None]
    rows = [(g, n, int(rng.integers(0, 2)), kinds[rng.integers(0, 5)], [None, 0, 2][rng.integers(0, 3)]) for g in range(12) for n in range(int(rng.integers(1, 12)))]
    rows += [(g, 20, None, "game_end", 1) for g in range(0, 12, 2)] + [(20, 1, 1, "game_end", 0), (21, 3, 1, "made", 2), (21, None, 0, "missed", 1)]
    events = spark.createDataFrame(rows, "game_id long, action_number long, team_id long, kind string, points long")
    parts = ["action_number <= 3", "action_number between 4 and 6", "action_number between 7 and 19 and game_id % 3 > 0", "action_number = 20 or (action_number between 7 and 19 and game_id % 3 = 0) or action_number is null"]
    read = lambda out: sorted(map(tuple, out.collect()), key=str)
    want = read(incremental.drain(incremental.possession_stream(batches(spark, events, parts), ("made", "turnover"))))
    assert read(incremental.possessions_of_batches(batches(spark, events, parts), ("made", "turnover"))) == want and len(want) > 20
    assert read(incremental.possessions_of_batches(batches(spark, events.limit(0), ["true"]), ("made",))) == []


def test_streamed_possessions_make_no_call_for_a_game(spark, monkeypatch):
    from tallyline.plans import stream_queries

    monkeypatch.setattr(incremental, "possession_stream", None)
    assert stream_queries.streamed_possessions(spark, "/root/testdata/sf0.001").count() > 1000


def test_replaced_partitions_and_games_taken_once(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    write = incremental.replace_per_batch(path, "season")
    write(spark.createDataFrame([(1, 2020), (2, 2021)], "v long, season long"), 0)
    write(spark.createDataFrame([(3, 2021)], "v long, season long"), 1)
    assert sorted((r.v, r.season) for r in spark.read.parquet(path).collect()) == [(1, 2020), (3, 2021)]
    twice = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-02 00:00:00"), (2, "2024-01-02 00:00:00")], "game_id long, t string").select("game_id", F.col("t").cast("timestamp").alias("ts"))
    assert sorted(r.game_id for r in incremental.drain(incremental.once_per_game(batches(spark, twice, ["ts < '2024-01-02'", "ts >= '2024-01-02'"]))).collect()) == [1, 2]


def timed(rows, at):
    return rows.withColumn("ts", F.timestamp_seconds(at + 1000))  # a row of time 0 would be late at once


def closed(spark, rows, parts, at):
    """A stream of files, one a batch; the last one holds a row without key at time `at`."""
    end = rows.limit(0).unionByName(spark.range(1).select(F.timestamp_seconds(F.lit(at)).alias("ts")), allowMissingColumns=True)
    return batches(spark, rows.unionByName(end), [*parts, f"ts = timestamp_seconds({at})"])


def test_decay_in_order_of_shuffled_batches_is_the_window_form(spark):
    rows = spark.createDataFrame([(i % 3, i, i * 7 % 5 % 2) for i in range(90)], "player_id long, event_id long, made int")
    stream = closed(spark, timed(rows, F.col("event_id") * 10), ["event_id % 4 = 3 and event_id < 40", "event_id % 4 < 3 and event_id < 40", "event_id >= 60", "event_id between 40 and 59"], 100_000)
    got = {(r.player_id, r.event_id): (r.a_before, r.m_before) for r in incremental.drain(ordered.decay_in_order(stream, 10.0, "600 seconds")).collect()}
    want = decay.decayed_before(rows.withColumn("a", F.lit(1)), "player_id", ["event_id"], "a", "made", 10.0).collect()
    assert len(got) == len(want) == 90
    for r in want:
        assert got[r.player_id, r.event_id] == (pytest.approx(r.a_before), pytest.approx(r.m_before))


def test_possessions_in_order_of_shuffled_batches(spark):
    """Game 1 ends with its last event; in game 2 an event is missing its team and points, and what is open ends with silence."""
    events = game(spark)[0].select("game_id", "elapsed", "action_number", "team_id", "kind", "points")
    more = [(1, 1100, 9, None, "game_end", 0), (2, 100, 1, 1, "made", 2), (2, 101, 2, None, "made", None), (2, 102, 3, 1, "free_throw_miss", 1)]
    events = timed(events.union(spark.createDataFrame(more, events.schema)), F.col("elapsed"))
    stream = closed(spark, events, ["action_number in (4, 2, 9)", "action_number in (1, 7, 5)", "action_number in (3, 6, 8)"], 100_000)
    out = incremental.drain(ordered.possessions_in_order(stream, reconstruct.ENDS, delay="2000 seconds", silent_ms=60_000)).orderBy("game_id", "poss_index").collect()
    one = [(1, "made", 2), (2, "free_throw", 1), (3, "made", 3), (4, "defensive_rebound", 0), (5, "turnover", 0)]
    assert [(r.poss_index, r.ended_by, r.points) for r in out if r.game_id == 1] == one
    assert [(r.poss_index, r.ended_by, r.team_id, r.points) for r in out if r.game_id == 2] == [(1, "made", 1, 2), (2, "made", None, 0), (3, "end_of_game", None, 1)]


def test_late_rows_are_dropped_and_waiting_rows_stay(spark):
    rows = timed(spark.createDataFrame([(1, e, 1) for e in range(6)], "player_id long, event_id long, made int"), F.col("event_id") * 100)
    out = incremental.drain(ordered.decay_in_order(batches(spark, rows, ["event_id in (0, 3)", "event_id = 4", "event_id = 1", "event_id = 5"]), 10.0, "150 seconds"))
    assert [r.event_id for r in out.orderBy("event_id").collect()] == [0, 3]  # 1 is late; 4 and 5 wait for later rows


def test_possessions_of_sessions_are_those_in_order(spark):
    """Events in any order, a null count of points, an unclosed end, a row without key: as the rows taken one by one."""
    rows = [(g, n, 10 + n // 3, kind, points, 1000 * g + n) for g in (1, 2, 3) for n, (kind, points) in enumerate([("missed", 0), ("made", 2), ("free_throw", None), ("sub", 0), ("turnover", 0), ("free_throw", 1)], 1)]
    rows = rows[:-1] + [(None, 1, 10, "made", 2, 1500)]
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for part in (rows[::-1][:9], rows[::-1][9:], [(None, None, None, None, None, 10**6)]):
        frame = spark.createDataFrame(part, "game_id long, action_number long, team_id long, kind string, points long, s long")
        frame.withColumn("ts", F.timestamp_seconds("s")).drop("s").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = incremental.drain(ordered.possessions_of_sessions(stream, ("made", "turnover"), "60 seconds", delay="5000 seconds"))
    ends = lambda g: [(g, 1, "made", 10, 2), (g, 2, "turnover", 11, 0), (g, 3, "end_of_game", None, 1)]
    assert sorted(map(tuple, out.collect())) == [*ends(1), *ends(2), *ends(3)[:2]]


def test_feeds_are_dealt_by_game_in_tasks_that_stay_small(spark):
    """Joins and windows of a game stay in place behind the feed, behind what is laid down, and the feed has more tasks where it is larger."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    feed = pbp.play_by_play(spark, "/root/testdata/sf0.1")
    assert feed.rdd.getNumPartitions() == messy.messy_events(spark, "/root/testdata/sf0.1").rdd.getNumPartitions() == 600_000 // 50_000 + 1
    assert plan(feed.groupBy("game_id", "team_id").count()).count("Exchange") == 1
    small = pbp.play_by_play(spark, "/root/testdata/sf0.001")
    again = lineage.laid(small, "game_id")
    assert again.count() == small.count() and plan(again.groupBy("game_id", "period").count()).count("Exchange") == 1
