"""Lineups from messy feeds: a state machine over the ordered events of each game.

What a batch of substitutions does depends on who is on the floor when it comes, so the events of a game (some hundreds) are
folded in order in one task; games are independent and are dealt by game_id.
"""

from __future__ import annotations

from collections import defaultdict
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .feeds import event_order

FIVE = 5


def _named(move: dict) -> int | None:
    """The player a move names: its id, or its only candidate."""
    known = [move["player_id"]] if (move["player_id"] or 0) > 0 else move["candidates"] or []
    return known[0] if len(known) == 1 else None


def _fit(move: dict, floor: set[int]) -> int | None:
    """The player whom a move can concern: who leaves must be on the floor, who comes in must not."""
    leaves, player = move["side"] == "out", move["player_id"]
    if player and player > 0 and (player in floor) == leaves:
        return player
    fitting = [p for p in move["candidates"] or () if p > 0 and (p in floor) == leaves]
    return fitting[0] if len(fitting) == 1 else None


def apply_batch(floor: set[int], moves: list[dict]) -> set[int]:
    """The lineup after one team's substitutions of one clock (player_id, candidates, side, description).

    A player who leaves and comes in stays. Moves of one text are then made in pairs, each of them if the one leaving is on
    the floor and the other is not; what is left is made singly, exits first.
    """
    if len(moves) == 2 and moves[0]["side"] == "out" and moves[1]["side"] == "in":  # one text, as mostly: the same in short
        p, named = _fit(moves[0], floor), _named(moves[1])
        if p is not None and p == named:
            return floor
        q = _fit(moves[1], floor) if p and moves[0]["description"] == moves[1]["description"] else None
        floor = floor - {p} if p else floor
        q = q or _fit(moves[1], floor)
        return floor | {q} if q else floor
    floor = set(floor)
    outs, ins = ([m for m in moves if m["side"] == s] for s in ("out", "in"))
    both = {_fit(m, floor) for m in outs} & {_named(m) for m in ins} - {None}
    outs, ins = [m for m in outs if _fit(m, floor) not in both], [m for m in ins if _named(m) not in both]
    waiting = defaultdict(list)
    for m in ins:
        waiting[m["description"]].append(m)
    paired, start = [], set(floor)
    for m in outs:
        partners = waiting[m["description"]]
        partner = partners.pop(0) if partners else None
        if partner and (p := _fit(m, start)) and (q := _fit(partner, start)):
            paired += [id(m), id(partner)]
            if p in floor and q not in floor:
                floor = floor - {p} | {q}
    for m in [*outs, *ins]:
        if id(m) not in paired and (p := _fit(m, floor)):
            floor = floor - {p} if m["side"] == "out" else floor | {p}
    return floor


#: Segments in one batch that leaves a task.
_OUT_ROWS = 10_000
#: Sides of a move in the fold; 0: no move.
_SIDES = (None, "out", "in")


def _plain(column: pa.Array) -> list:
    """The values of a column as Python's; by way of NumPy where there are no nulls, which takes a tenth of the time."""
    return column.to_pylist() if column.null_count or pa.types.is_nested(column.type) else column.to_numpy(zero_copy_only=False).tolist()


def _track(values: tuple[str, ...], forced: bool):
    names = ["game_id", "start", "end", "home_id", "away_id", "home_lineup", "away_lineup", *[f"{side}_{v}" for v in values for side in ("home", "away")]]
    schema = pa.schema([(n, pa.list_(pa.int64()) if n.endswith("lineup") else pa.float64() if i >= 7 else pa.int64()) for i, n in enumerate(names)])

    def segments(game: int, home: int, away: int, at: range, columns: tuple[list, ...], counted: list[list], move, periods: dict, marks: dict) -> list[tuple]:
        """The segments of the game whose events are the rows `at` of the columns; move(i): the move of row i."""
        period_of, time_of, team_of, side_of, throw_of = columns
        floor = {t: set(periods.get((t, 1), [])[:FIVE]) for t in (home, away)}
        out, start, now, period = [], 0, 0, 1
        sums = [0] * (2 * len(values))  # of home and away by turns, as in names
        pending = defaultdict(list)

        def close():
            nonlocal start
            if now > start or any(sums):
                segment = (game, start, now, home, away, sorted(floor[home]), sorted(floor[away]))
                # lineups that come back within one clock have one segment there
                same = next((k for k in range(len(out) - 1, -1, -1) if out[k][2] != now or out[k][:7] == segment), -1)
                if same >= 0 and out[same][2] == now:
                    out[same] = (*segment, *map(add, out[same][7:], sums))
                else:
                    out.append((*segment, *sums))
            start, sums[:] = now, [0] * len(sums)

        def change(batches):
            close()
            for team, moves in batches.items():
                floor[team] = apply_batch(floor[team], moves)

        first, stop = at.start, at.stop
        while first < stop:
            clock = (period_of[first], time_of[first])
            end = first + 1
            while end < stop and time_of[end] == clock[1] and period_of[end] == clock[0]:
                end += 1
            if pending:
                change(pending)
                pending.clear()
            now = max(now, clock[1])
            if clock[0] > period:
                period = clock[0]
                given = {t: periods[t, period] for t in (home, away) if len(periods.get((t, period), [])) == FIVE}
                if given:
                    close()
                    floor |= {t: set(g) for t, g in given.items()}
            known = bool(marks) and all(len(marks.get((t, clock[1]), [])) == FIVE for t in (home, away))
            if known and (forced or any(len(floor[t]) != FIVE for t in floor)):
                close()
                floor |= {t: set(marks[t, clock[1]]) for t in (home, away)}
            throw = max((i for i in range(first, end) if throw_of[i]), default=-1)
            run = None  # the batches of the run of substitutions that goes on
            for i in range(first, end):
                team = team_of[i]
                if not side_of[i]:
                    if run is not None and run is not pending:
                        change(run)
                    run = None
                    if team == away or team == home:
                        for k, value in enumerate(counted):
                            sums[2 * k + (team == away)] += value[i] or 0
                elif not known:  # else the lineups of this clock are known, whatever its texts say
                    if run is None:
                        run = pending if throw > i else defaultdict(list)
                    if team in floor:
                        run[team].append(move(i))
            if run is not None and run is not pending:
                change(run)
            first = end
        if pending:
            change(pending)
        close()
        return out

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(map(list, zip(*out)), schema)], schema=schema)

    def run(batches):
        out = []
        for batch in batches:
            games, homes, aways, given = (batch.column(c).to_pylist() for c in ("game_id", "home_id", "away_id", "given"))
            events = batch.column("events")
            ends, rows = events.value_lengths().to_pylist(), events.flatten()
            column = lambda c: _plain(rows.field(c))  # noqa: B023, E731
            columns = tuple(column(c) for c in ("period", "elapsed", "team_id", "side", "throw"))
            side_of, players, texts, candidates = columns[3], column("player_id"), column("description"), rows.field("candidates")
            several = dict(zip(candidates.is_valid().to_numpy(zero_copy_only=False).nonzero()[0].tolist(), candidates.drop_null().to_pylist()))
            move = lambda i: {"side": _SIDES[side_of[i]], "player_id": players[i], "candidates": several.get(i), "description": texts[i]}  # noqa: B023, E731
            counted = [column(f"value{k}") for k in range(len(values))]
            at = 0
            for game, home, away, known, n in zip(games, homes, aways, given, ends):
                periods, marks = {}, {}
                for g in known or ():
                    (periods if g["mark"] == "period" else marks)[g["team_id"], g["at"]] = sorted(set(g["lineup"] or []))
                out += segments(game, home, away, range(at, at + n), columns, counted, move, periods, marks)
                at += n
                if len(out) >= _OUT_ROWS:
                    yield batch_of(out)
                    out = []
        if out:
            yield batch_of(out)

    return run


def track_lineups(events: DataFrame, given: DataFrame, values: tuple[str, ...] = ("points",), forced: bool = False, tasks: int | None = None) -> DataFrame:
    """Segments of games between changes of lineups: game_id, start, end, home_id, away_id, home_lineup, away_lineup, and home_ and
    away_ sums of each of `values`.

    `events` are those of expand_substitutions(); they are taken in event order, so points on the clock of a substitution
    count for the lineup that is on the floor in that order. Substitutions of one clock form a batch per team
    (apply_batch); one with a free throw after it on its clock waits until the clock has passed. `given` (game_id, team_id,
    mark, at, lineup) holds what is known: with mark 'period', lineups at the start of period `at` (1: the starters), set
    when the period's first event comes; with mark 'elapsed', lineups of both teams at a time, taken if either lineup is not
    five or if `forced`, while substitutions at that time are ignored. Lineups may be incomplete: see full_sides().

    A game's events and what is known of it become one row, so that many games cross to Python in one batch; games are dealt into
    `tasks` tasks (None: as Spark has it).
    """
    text, none = F.col("description"), F.lit(None).cast("long")
    place = event_order(F.col("elapsed"), F.col("kind"), text, none, F.col("action_number"))
    side = F.when(F.col("side").isNull(), 0).when(F.col("side") == "out", 1).otherwise(2)
    moves = side > 0
    fields = {
        "side": side, "period": F.col("period"), "elapsed": F.col("elapsed"), "team_id": F.col("team_id"), "throw": F.coalesce(F.col("kind") == "free_throw", F.lit(False)), "player_id": F.when(moves, F.coalesce("player_id", F.lit(0))).otherwise(0),
        "description": F.when(moves, F.coalesce(text, F.lit(""))).otherwise(""), "candidates": F.when(moves & (F.size("candidates") > 0), F.col("candidates")),
    }
    order = [*place, F.col("side").eqNullSafe("in")]
    event = F.struct(*[c.cast("long").alias(f"o{i}") for i, c in enumerate(order)], *[c.alias(n) for n, c in fields.items()], *[F.col(v).alias(f"value{i}") for i, v in enumerate(values)])
    rows = events.where("elapsed is not null").select("game_id", "home_id", "away_id", event.alias("event"))
    rows = rows.repartition(tasks, "game_id") if tasks else rows
    # a game's events: some hundreds
    games = rows.groupBy("game_id").agg(F.first("home_id").alias("home_id"), F.first("away_id").alias("away_id"), F.sort_array(F.collect_list("event")).alias("events"))
    known = given.groupBy("game_id").agg(F.collect_list(F.struct("team_id", "mark", F.col("at").cast("long").alias("at"), "lineup")).alias("given"))
    sums = ", ".join(f"{side}_{v} double" for v in values for side in ("home", "away"))
    schema = f"game_id long, start long, end long, home_id long, away_id long, home_lineup array<long>, away_lineup array<long>, {sums}"
    return games.join(known, "game_id", "left").mapInArrow(_track(values, forced), schema)


def full_sides(segments: DataFrame, values: tuple[str, ...] = ("points",)) -> DataFrame:
    """Two rows (game_id, start, end, team_id, lineup, each value and v_against) per segment that lasts and has five on both sides."""
    kept = segments.where(f"end > start and size(home_lineup) = {FIVE} and size(away_lineup) = {FIVE}")
    side = lambda own, other: F.struct(F.col(f"{own}_id").alias("team_id"), F.col(f"{own}_lineup").alias("lineup"), *[F.col(f"{own}_{v}").alias(v) for v in values], *[F.col(f"{other}_{v}").alias(f"{v}_against") for v in values])
    return kept.select("game_id", "start", "end", F.explode(F.array(side("home", "away"), side("away", "home"))).alias("s")).select("game_id", "start", "end", "s.*")
