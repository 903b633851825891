"""Guarded writes, pruned reads, Beta quantiles, linear look-ahead, fits that do not converge."""

import math
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.functions.beta import beta_cdf, beta_quantile, beta_quantiles
from tallyline.operators import lineups, sequences
from tallyline.plans import audits, ridge
from tallyline.sources import sinks


def table(spark, rows):
    return spark.createDataFrame(rows, "season int, k long, v long")


def read(spark, path):
    return sorted(map(tuple, spark.read.parquet(path).select("season", "k", "v").collect()))


def test_guarded_writes(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/t"
    old = [(s, k, 0) for s in (1, 2) for k in range(10)]
    assert tuple(sinks.replace_partitions(table(spark, old), path, "season").first()) == (0, 20, True)
    with pytest.raises(sinks.RefusedWrite):
        sinks.replace_partitions(table(spark, old[:8]), path, "season")
    assert read(spark, path) == old
    new = [(1, k, 5) for k in range(9)]
    for _ in range(2):  # safe to run twice
        assert tuple(sinks.replace_partitions(table(spark, new), path, "season").first())[1:] == (9, True)
        assert read(spark, path) == new + old[10:]
    sinks.replace_partitions(table(spark, new[:1]), path, "season", allow_shrink=True)
    assert read(spark, path) == new[:1] + old[10:]
    sinks.replace_partitions(table(spark, []), path, "season")  # touches nothing
    assert read(spark, path) == new[:1] + old[10:]
    # by key, from the table itself: the first in order wins, other seasons and keys stay
    sinks.upsert_partitions(table(spark, [(1, 0, 8), (1, 0, 7), (1, 50, 1), (3, 1, 1)]), path, "season", ["season", "k"], [F.col("v")])
    assert read(spark, path) == [(1, 0, 7), (1, 50, 1), *old[10:], (3, 1, 1)]


def test_reads_of_some_seasons_skip_the_others(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/t"
    assert sinks.read_partitions(spark, path, "season") is None
    sinks.replace_partitions(table(spark, [(s, k, s) for s in range(4) for k in range(3)]), path, "season")
    some = sinks.read_partitions(spark, path, "season", [1, 3])
    assert some.count() == 6 and sinks.read_partitions(spark, path, "season", []).count() == 0
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(season" in plan or "PartitionFilters: [season" in plan
    assert len(some.inputFiles()) > 0


@pytest.mark.parametrize(("a", "b"), [(0.4, 0.7), (1.0, 1.0), (3.5, 9.0), (72.0, 128.0), (500.0, 900.0), (2.0, 0.3)])
def test_beta_quantiles_by_integration(a, b):
    u, w = np.polynomial.legendre.leggauss(600)
    # t = sin(v)^2 takes the poles at both ends away for parameters of a half or more
    log = lambda v: (2 * a - 1) * np.log(np.sin(v)) + (2 * b - 1) * np.log(np.cos(v))
    full = np.pi / 4 * (u + 1)
    for p in (0.05, 0.5, 0.95):
        x = float(beta_quantile(p, np.array([a]), np.array([b]))[0])
        half = np.arcsin(np.sqrt(x)) / 2
        if min(a, b) >= 0.5:
            top = log(full).max()
            assert half * (w @ np.exp(log(half * (u + 1)) - top)) / (np.pi / 4 * (w @ np.exp(log(full) - top))) == pytest.approx(p, abs=1e-8)
        assert float(beta_cdf(np.array([a]), np.array([b]), np.array([x]))[0]) == pytest.approx(p, abs=1e-12)
        assert 1 - float(beta_quantile(1 - p, np.array([b]), np.array([a]))[0]) == pytest.approx(x, abs=1e-10)


def test_beta_column(spark):
    rows = spark.createDataFrame([(1, 1.0, 1.0), (2, None, 1.0), (3, 0.0, 1.0), (4, 3.0, 1.0)], "k int, a double, b double")
    got = [r.q for r in rows.select("k", beta_quantiles(0.25, F.col("a"), F.col("b")).alias("q")).orderBy("k").collect()]
    assert got[0] == pytest.approx(0.25, abs=1e-12) and got[1:3] == [None, None] and got[3] == pytest.approx(0.25 ** (1 / 3), abs=1e-12)


def test_fill_and_look_ahead(spark):
    rows = [(k, t, (k * 7 + t * 5) % 11 if (k + t) % 3 == 0 else None) for k in range(3) for t in range(12)]
    df = spark.createDataFrame(rows, "k long, t long, v long")
    got = {(r.k, r.t): r.v for r in sequences.fill_both(df, ["k"], [F.col("t")], "v").collect()}
    for k, t, _ in rows:
        past, later = ([v for k2, t2, v in rows if k2 == k and v is not None and ok(t2)] for ok in (lambda x, t=t: x <= t, lambda x, t=t: x > t))
        assert got[k, t] == (past[-1] if past else later[0] if later else None)
    events = spark.createDataFrame([(0, 3, 9), (0, 3, 4), (0, 7, 1), (1, 0, 2)], "k long, e long, w long")
    ahead = {(r.k, r.t): (r.e, r.w) for r in sequences.first_after(df.select("k", "t"), events, ["k"], "t", "e", "w").collect()}
    assert [ahead[0, t] for t in (0, 2, 3, 6, 7)] == [(3, 4), (3, 4), (7, 1), (7, 1), (None, None)] and ahead[1, 0] == (None, None)


def test_fact_rules(spark):
    good = {"on_possessions": 60.0, "minutes": 30.0, "fgm": 5, "fga": 9, "fg3m": 2, "fg3a": 3, "ftm": 1, "fta": 2, "pts": 13, "reb": 4, "oreb": 1, "dreb": 3, "plus_minus_actual": 2.0, "on_diff_reconstructed": 2.5, "team_abbr": "A", "opp_team_abbr": "B", "player_name": "P"}
    schema = ", ".join(f"{n} {'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}" for n, v in good.items()) + ", k string"
    bad = {
        "missing_on_possessions": {"on_possessions": None}, "missing_box_stats": {"pts": None}, "missing_team_meta": {"opp_team_abbr": None}, "blank_player_name": {"player_name": " "}, "bad_fgm_fga": {"fga": 4}, "bad_fg3m_fg3a": {"fg3a": 1},
        "bad_ftm_fta": {"fta": 0}, "bad_points_formula": {"pts": 12}, "bad_rebound_formula": {"dreb": 2}, "pm_vs_reconstructed_mismatch": {"plus_minus_actual": 1.9}, "extreme_pace": {"on_possessions": 40.0}, "none": {}, "unknown": {"fg3a": None, "reb": None, "ftm": None, "minutes": 4.0, "on_possessions": 40.0},
    }
    rows = spark.createDataFrame([tuple((good | change).values()) + (k,) for k, change in bad.items()], schema)
    got = {r.k: {n for n in audits.FACT_RULES if r[n]} for r in audits.violations(rows, audits.fact_rules(), ["k"]).collect()}
    assert got == {k: {k} for k in audits.FACT_RULES}


def test_plus_minus_table_and_intercept(spark):
    """Raw and adjusted ratings, the intercept with its shift, minutes, primary teams and the least minutes, against NumPy."""
    rng = np.random.default_rng(9)
    rows = [(g, 1, 1, 2, [int(x) for x in rng.choice(8, 5, False)], [int(x) for x in rng.choice(8, 5, False) + 8], float(rng.integers(20, 200)), float(rng.integers(0, 5)), float(rng.integers(0, 5)), float(rng.random() * 5), float(rng.random() * 5)) for g in range(60)]
    stints = spark.createDataFrame(rows, "game_id long, stint_index long, home_id long, away_id long, home_lineup array<long>, away_lineup array<long>, seconds double, home_pts double, away_pts double, home_pts_adj double, away_pts_adj double").withColumn("date", F.lit("2020-01-01").cast("date"))

    def fit(home, away):
        x, y = [], []
        for r in rows:
            for own, other, p in ((r[4], r[5], r[home]), (r[5], r[4], r[away])):
                w, line = math.sqrt(r[6] / 24), np.zeros(32)
                line[own], line[[16 + o for o in other]] = w, -w
                x.append(line)
                y.append(p / (r[6] / 24) * 100 * w)
        x, y = np.array(x), np.array(y)
        xc = x - x.mean(0)
        coef = np.linalg.solve(xc.T @ xc + np.diag([50.0] * 16 + [80.0] * 16), xc.T @ (y - y.mean()))
        o, d = coef[:16], coef[16:]
        return o - o.mean(), d - d.mean(), y.mean() - x.mean(0) @ coef + 5 * (o.mean() - d.mean())

    (o, d, b), (o_adj, d_adj, _) = fit(7, 8), fit(9, 10)
    assert ridge.offence_defence_model(lineups.offence_defence_design(stints), 50.0, 80.0)[1] == pytest.approx(b)
    minutes = {p: sum(r[6] for r in rows if p in r[4] or p in r[5]) / 60 for p in range(16)}
    least = sorted(minutes.values())[4]
    got = {r.player_id: r for r in ridge.plus_minus_table(stints, 50.0, 80.0, least).collect()}
    assert set(got) == {p for p in minutes if minutes[p] >= least - 1e-9}
    for p, r in got.items():
        assert (r.offence, r.defence, r.total, r.offence_adj, r.defence_adj, r.total_adj) == tuple(map(pytest.approx, (o[p], d[p], o[p] + d[p], o_adj[p], d_adj[p], o_adj[p] + d_adj[p])))
        assert r.minutes == pytest.approx(minutes[p]) and r.team_id == (1 if p < 8 else 2)


def test_unconverged_fit_raises(monkeypatch):
    eq = ridge.NormalEquations(np.arange(2), np.zeros(2), np.ones(2), 1.0, 0.0, None)
    monkeypatch.setattr(ridge.NormalEquations, "_times", lambda self, p: p[::-1] * np.array([1.0, -1.0]))  # no positive matrix
    with pytest.raises(ArithmeticError), np.errstate(all="ignore"):
        eq.solve(0.0)
