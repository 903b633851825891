"""Event-data operators on hand-made rows."""

import importlib
import itertools

import pytest
from pyspark.sql import functions as F

from tallyline.functions import scalars as S
from tallyline.operators import decay, lineups, reconstruct, sequences, tables
from tallyline.sources import adapters


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first().asDict()


def test_clocks_and_ids(spark):
    got = one(spark, iso=S.clock_seconds(F.lit("PT11M46.50S")), plain=S.clock_seconds(F.lit("1:05")), bad=S.clock_seconds(F.lit("x")), ot=S.elapsed_seconds(F.lit(5), F.lit(300)), end=S.period_at(F.lit(720), at_end=True), start=S.period_at(F.lit(720)), key=S.game_key(F.lit("0021")), season=S.season_label(F.lit("2023-07-02").cast("date"), 7), earlier=S.season_label(F.lit("2023-07-02").cast("date"), 10), inches=S.height_inches(F.lit("6-7")))
    assert got == {"iso": 706.5, "plain": 65.0, "bad": None, "ot": 2880, "end": 1, "start": 2, "key": "21", "season": "2023-24", "earlier": "2022-23", "inches": 79}


def test_null_fails_a_bound(spark):
    none = F.lit(None).cast("double")
    assert one(spark, a=S.in_range(none, 1, None), b=S.in_range(none), c=S.rate(F.lit(3.0), "per_36", minutes=F.lit(0)), d=S.ratio(F.lit(1), F.lit(0))) == {"a": False, "b": True, "c": None, "d": None}


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_combinations(spark, k):
    got = one(spark, c=lineups.combinations(F.array(*[F.lit(x) for x in (1, 2, 3, 4, 5)]), k))["c"]
    assert [tuple(x) for x in got] == list(itertools.combinations((1, 2, 3, 4, 5), k))


def test_decay_is_the_recursion(spark):
    rows = [(1, i, 1 + i % 3, i % 2) for i in range(50)]
    got = decay.decayed_before(spark.createDataFrame(rows, "p long, g int, a long, m long"), "p", ["g"], "a", "m", 20.0).orderBy("g").collect()
    a = m = 0.0
    for r in got:
        assert (r.a_before, r.m_before) == (pytest.approx(a), pytest.approx(m))
        f = 2 ** (-r.a / 20.0)
        a, m = f * a + r.a, f * m + r.m


def test_decay_of_long_series(spark):
    """Millions of attempts: more than powers of two can span."""
    rows = spark.range(4000).select(F.lit(1).alias("p"), F.col("id").alias("g"), F.lit(500).alias("a"), (F.col("id") % 400).alias("m"))
    got = decay.decayed_before(rows, "p", ["g"], "a", "m", 1000.0).orderBy("g").collect()
    a = m = 0.0
    for r in got:
        assert (r.a_before, r.m_before) == (pytest.approx(a), pytest.approx(m))
        f = 2 ** (-r.a / 1000.0)
        a, m = f * a + r.a, f * m + r.m


def test_shot_priors_are_the_recursion(spark):
    rows = [(1, i, i * 5 % 3 % 2, i * 7 % 4 % 2) for i in range(120)]
    out = decay.shot_priors(spark.createDataFrame(rows, "player_id long, n long, made long, assisted long"), F.lit(0.33), order=["n"], skill_half_life=12.0, penalty_half_life=8.0, anchor=5.0, penalty_weight=6.0)
    sm, sa, um, ua = 0.33 * 10, 10.0, -0.06 * 6, 6.0
    for r in out.orderBy("n").collect():
        theta, delta = sm / sa, um / ua
        want = max(0.1, min(0.6, theta if r.assisted else theta + delta))
        assert (r.theta, r.delta, r.expected) == (pytest.approx(theta), pytest.approx(delta), pytest.approx(want))
        if r.assisted:
            f = 0.5 ** (1 / 12)
            sm, sa = sm * f + r.made, sa * f + 1
        else:
            f = 0.5 ** (1 / 8)
            um, ua = um * f + r.made - theta, ua * f + 1


def test_remap_chains_are_followed_to_their_ends(spark):
    links = [(i, i + 1) for i in range(1, 30)] + [(40, 41), (41, 42), (42, 40), (50, 41), (3, 4), (60, 60), (70, None)]
    got = {r.old_id: r.new_id for r in tables.closed_remap(spark.createDataFrame(links, "old_id long, new_id long")).collect()}

    def plain(i, to):
        seen = set()
        while i in to and i not in seen:
            seen.add(i)
            i = to[i]
        return i

    to = {a: b for a, b in links if b is not None and a != b}
    assert {k: v for k, v in got.items() if k not in (40, 41, 42, 50)} == {i: plain(i, to) for i in to if i not in (40, 41, 42, 50)}
    ids = spark.createDataFrame([(1,), (40,), (50,), (99,), (None,)], "x long")
    assert {r.x for r in tables.follow_remap(ids, "x", spark.createDataFrame(links, "old_id long, new_id long")).collect()} == {30, 99, None, plain(40, to), plain(50, to)}
    assert tables.follow_remap(ids, "x", spark.createDataFrame([], "old_id long, new_id long")).count() == 5


def test_first_after_looks_ahead_of_its_own_key(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 9, "b"), (2, 1, "c")], "k long, t long, name string")
    events = spark.createDataFrame([(1, 5, 10), (1, 7, 12), (1, 7, 11), (2, 1, 13)], "k long, et long, v long")
    got = {r.name: (r.et, r.v) for r in sequences.first_after(df, events, ["k"], "t", "et", "v").collect()}
    assert got == {"a": (7, 11), "b": (None, None), "c": (None, None)}


def test_names_texts_and_times(spark):
    text = lambda x: F.lit(x)
    got = one(spark, plain=F.sort_array(S.name_aliases(text("A.C. Green"))), junior=F.sort_array(S.name_aliases(text("Jo Smith Jr."))), none=S.name_aliases(F.lit(None).cast("string")), star=S.tidy(text("Ann  Lee* ")), number=S.tidy(text("Ann Lee (3)")), at=S.clock_at(F.lit(725)), end=S.clock_at(F.lit(720), True), first=S.first_text(F.lit(None).cast("string"), text(" nan "), text(" x ")), unknown=S.event_name(F.lit(7)))
    assert got == {"plain": ["acgreen", "agreen", "green"], "junior": ["josmithjr", "smithjr"], "none": [], "star": "Ann Lee", "number": "Ann Lee", "at": "PT11M55.00S", "end": "PT00M00.00S", "first": "x", "unknown": ""}


def test_boundary_belongs_to_the_interval_that_ends_there(spark):
    iv = spark.createDataFrame([("g", 0.0, 10.0), ("g", 10.0, 20.0), ("h", 0.0, 5.0)], "k string, s double, e double")
    pts = spark.createDataFrame([("g", 10.0, 2.0), ("g", 10.5, 3.0), ("g", 0.0, 7.0)], "k string, t double, v double")
    got = {(r.k, r.s): r.v for r in sequences.interval_sums(iv, pts, ["k"], "t", "s", "e", "v").collect()}
    assert got == {("g", 0.0): 2.0, ("g", 10.0): 3.0, ("h", 0.0): 0.0}


def test_upsert_and_priority(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "k long, v string")
    assert sorted(map(tuple, tables.upsert(old, new, ["k"], [F.col("v").desc()]).collect())) == [(1, "a"), (2, "d"), (3, "e")]
    both = tables.priority_union([old.where("k = 1").withColumn("v", F.lit(None).cast("string")), old])
    assert {r.k: r.v for r in tables.first_by_priority(both, ["k"], ["v"], 2).collect()} == {1: "a", 2: "b"}


def test_entry_imports_and_runs(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() > 0
    assert {"lineup_ratings", "span_search"} <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_names_with_one_list_of_candidates_share_a_partition(spark):
    """Else a long list would be laid down once for each part of the names."""
    aliases = spark.range(301).selectExpr("1 AS team_id", "if(id < 300, 'a', 'b') AS alias", "CAST(if(id < 300, id, 7) AS INT) AS player_id")
    names = spark.range(400, numPartitions=4).selectExpr("1 AS team_id", "CASE id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS alias", "id")
    out = reconstruct.unique_aliases(names, aliases, ["team_id", "alias"]).withColumn("part", F.spark_partition_id())
    got = {r.alias: r for r in out.groupBy("alias").agg(F.countDistinct("part").alias("parts"), F.count("*").alias("rows"), F.max("player_id").alias("player_id"), F.max("candidates").alias("candidates")).collect()}
    assert [got[k].parts for k in "abc"] == [1, 1, 1] and sum(got[k].rows for k in "abc") == 400
    assert (got["a"].player_id, got["a"].candidates) == (None, ",".join(map(str, range(300)))) and (got["b"].player_id, got["b"].candidates) == (7, "7") and (got["c"].player_id, got["c"].candidates) == (None, None)


@pytest.mark.parametrize("make", [adapters.stints, adapters.player_games])
def test_lines_are_dealt_by_number(spark, make):
    """60,000 lines are two tasks' work whatever the session's partitions are, and a game is in one of them."""
    per = make(spark, "/root/testdata/sf0.01").withColumn("p", F.spark_partition_id()).groupBy("game_id").agg(F.countDistinct("p").alias("n"), F.max("p").alias("part"))
    assert [tuple(r) for r in per.agg(F.max("n"), F.countDistinct("part")).collect()] == [(1, 2)]
