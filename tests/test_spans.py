"""The span table by hand: sums, first and least bio, season figures, modes and sorting."""

import datetime

import pytest

from tallyline.operators import spans
from tallyline.plans import search

SCHEMA = "player_id long, game_id long, date date, season long, minutes double, possessions long, pts long, reb long, listed_height string, age long, on_off_actual double, rim_dfg_pct double, rim_dfga double, rim_tracking_games long, deflections double, rim_assists_season_games long, rim_assists_all_per_game double"


def facts(spark):
    day = lambda n: datetime.date(2020, 1, n)
    return spark.createDataFrame([
        (1, 1, day(1), 2019, 10.0, 20, 5, None, "", 30, 4.0, None, 30.0, 10, None, None, 2.0),
        (1, 2, day(2), 2019, 30.0, 60, 7, 3, "6-5", 29, None, 0.5, 99.0, 99, 3.0, 5, 9.0),
        (1, 3, day(3), 2020, None, 0, 2, 1, "6-6", None, 8.0, 0.4, 20.0, 0, 2.0, 5, 1.0),
        (2, 3, day(3), None, 20.0, 40, 9, 9, None, 25, 1.0, 0.9, 9.0, 9, 9.0, 9, 9.0),
    ], SCHEMA)


def test_span_table_by_hand(spark):
    got = {r.player_id: r for r in spans.span_table(facts(spark)).collect()}
    one, two = got[1], got[2]
    assert (one.games, one.minutes, one.possessions, one.pts, one.reb, one.ast) == (3, 40.0, 80, 14, 4, 0)
    assert (one.listed_height, one.age, one.player_name) == ("6-5", 29, None)
    assert one.on_off_actual == pytest.approx(4.0 * 10 / 40)  # a null difference is 0 and keeps its minutes
    assert one.rim_dfg_pct == pytest.approx((0 + 0.4) / 2)  # the first row of 2019 has none: 0, and it counts
    assert one.rim_dfga == pytest.approx(30.0 * 2 / 10)  # 2020 has no tracked games
    assert one.deflections == pytest.approx(3.0 * 2 + 2.0 * 1)
    assert one.rim_assists_all == pytest.approx(1.0 * 1)  # 2019's first row does not know the season's games
    assert (two.games, two.pts, two.rim_dfga, two.rim_dfg_pct, two.deflections, two.ts_game) == (1, 9, None, None, None, None)
    assert spans.span_table(facts(spark).limit(0)).count() == 0


def test_span_report_filters_in_one_mode_and_shows_another(spark):
    report = lambda **spec: search.span_report(facts(spark), search.SearchSpec(), search.SearchSpec(**spec), {"pts": "per_36"}).collect()
    assert [(r.player_id, r.pts) for r in report(bounds={"pts": (5, None)}, mode="per_game", rated=("pts",))] == [(2, pytest.approx(16.2))]
    assert [r.player_id for r in report(sort=("pts", True))] == [2, 1]  # 16.2 and 12.6 as shown, 9 and 14 in totals
    assert [r.player_id for r in report(sort=("listed_height", False))] == [2, 1]  # a null text sorts as ''
    assert [r.player_id for r in report(sort=("deflections", True))] == [1, 2]  # a null number sorts as 0
    assert [r.player_id for r in report(bounds={"deflections": (None, 100)})] == [1]  # a null fails a bound
