"""Streams whose rows come out of order: keyed processors that hold rows until the watermark has passed them.

Rows need an event time. A row that comes more than `delay` behind the latest one seen is late and is dropped by the engine
(as is, at the start, a row of 1970 or before). Rows of a key that wait are read together, so `delay` bounds what a task holds.
A row without key belongs to nobody and only moves the watermark, so a source that ends closes with one such row of a late time;
rows that the watermark never passes stay in the state and come with the next run from the same checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from . import folds

#: (key, rows in order or None after silence, carried state or None) -> (frames to put out, new carried state or None to forget)
Fold = Callable[[object, pd.DataFrame | None, tuple | None], tuple[list[pd.DataFrame], tuple | None]]


class InOrder(StatefulProcessor):
    """Hands the rows of a key to a fold in order of (time, order column), each once, when the watermark has passed them.

    The state of a key: a list of the rows that wait (those of the last `delay`), the value that the fold carries, the time of
    its last row. There is one event-time timer a key: at its first waiting row or, if none waits, `silent_ms` after the last one.
    """

    def __init__(self, fold: Fold, columns: list[str], waiting: str, carried: str, order: str, silent_ms: int | None):
        self.fold, self.columns, self.schemas, self.order, self.silent_ms = fold, columns, (waiting, carried), order, silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schemas[0])
        self.carried = handle.getValueState("carried", self.schemas[1])
        self.last = handle.getValueState("last", "at long")

    def _wake(self, at: int) -> None:
        for timer in list(self.handle.listTimers()):
            if timer <= at:
                return
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        if key[0] is None:
            return
        first, part = None, []
        for row in rows:
            part.append(tuple(row[c] for c in self.columns))
            first = part[-1][0] if first is None else min(first, part[-1][0])
            if len(part) == 1000:
                self.waiting.appendList(part)
                part = []
        if part:
            self.waiting.appendList(part)
        if first is not None:
            self._wake(-(-first // 1000))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        due, rest = [], []
        for row in self.waiting.get():
            (due if row[0] <= passed else rest).append(tuple(row))
        carried = self.carried.get() if self.carried.exists() else None
        out: list[pd.DataFrame] = []
        if due:
            self.last.update((max(row[0] for row in due),))
            order = self.columns.index(self.order)
            due.sort(key=lambda row: (row[0], row[order] is None, row[order] or 0))
            out, carried = self.fold(key[0], pd.DataFrame(due, columns=self.columns, dtype=object), carried)
            self.waiting.put(rest) if rest else self.waiting.clear()
        silent_at = -(-self.last.get()[0] // 1000) + self.silent_ms if self.silent_ms and self.last.exists() else None
        if not rest and carried is not None and silent_at is not None and silent_at <= timerValues.getCurrentWatermarkInMs():
            more, carried = self.fold(key[0], None, carried)
            out = out + more
        self.carried.update(carried) if carried is not None else self.carried.clear()
        if rest:
            self.handle.registerTimer(-(-min(row[0] for row in rest) // 1000))
        elif carried is not None and silent_at is not None:
            self.handle.registerTimer(silent_at)
        elif carried is None:
            self.last.clear()
        for frame in out:
            columns = [frame[c].astype(object).where(frame[c].notna(), None).tolist() for c in frame.columns]
            yield from (Row(**dict(zip(frame.columns, values, strict=True))) for values in zip(*columns, strict=True))


def _state_on_disk(rows: DataFrame) -> None:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _in_order(rows: DataFrame, key: str, order: str, at: str, delay: str, values: dict[str, str], carried: str, out: str, fold: Fold, silent_ms: int | None) -> DataFrame:
    """`values` names the columns that wait, with their types; the timers need the state store on disk."""
    _state_on_disk(rows)
    names = ["at_us", *values]
    kept = rows.select(key, *values, F.col(at).alias("at_ts"), F.unix_micros(at).alias("at_us")).withWatermark("at_ts", delay)
    processor = InOrder(fold, names, ", ".join(f"{n} {t}" for n, t in ({"at_us": "long"} | values).items()), carried, order, silent_ms)
    return kept.groupBy(key).transformWithState(processor, out, "append", "eventTime")


def decay_in_order(shots: DataFrame, half_life: float = 1000.0, delay: str = "1 hour", silent_ms: int | None = None, at: str = "ts") -> DataFrame:
    """Rows (player_id, event_id, made, ts) in any order within `delay` become (player_id, event_id, a_before, m_before): the
    player's decayed attempts and makes before each shot, shots in order of (ts, event_id). After `silent_ms` without a shot
    a player's state goes. A null in `made` counts as a miss."""

    def fold(key, rows, carried):
        if rows is None:
            return [], None
        a, m = carried or (0.0, 0.0)
        made = pd.to_numeric(rows["made"]).fillna(0).to_numpy(float)
        before, state = folds.decayed(made, a, m, half_life)
        return [pd.DataFrame({"player_id": key, "event_id": rows["event_id"].to_numpy(), "a_before": before[0], "m_before": before[1]})], state

    return _in_order(shots, "player_id", "event_id", at, delay, {"event_id": "long", "made": "int"}, "a double, m double", "player_id long, event_id long, a_before double, m_before double", fold, silent_ms)


def possessions_in_order(events: DataFrame, ends: tuple[str, ...], over: str = "game_end", delay: str = "1 hour", silent_ms: int | None = None, at: str = "ts") -> DataFrame:
    """Possessions as `incremental.possession_stream` gives them, of events (game_id, action_number, team_id, kind, points, ts) that
    come in any order within `delay`; events of a game are in order of (ts, action_number). A game goes with its event of kind
    `over` or `silent_ms` of event time after its last one."""

    def fold(key, rows, carried):
        index, points, opened = carried or (0, 0, False)
        found, state = folds.possessions(rows, index, points, opened, ends, over)
        found.insert(0, "game_id", key)
        return ([found] if len(found) else []), state

    values = {"action_number": "long", "team_id": "long", "kind": "string", "points": "long"}
    return _in_order(events, "game_id", "action_number", at, delay, values, "n long, points long, opened boolean", "game_id long, poss_index long, ended_by string, team_id long, points long", fold, silent_ms)


def possessions_of_sessions(events: DataFrame, ends: tuple[str, ...], silence: str, delay: str = "1 hour", at: str = "ts") -> DataFrame:
    """Possessions as possessions_in_order() gives them with `silent_ms`, of games that only silence ends; they come all at once when
    the watermark has passed the `silence` after a game's last event. A session window holds a game's events, some hundreds,
    and array functions count them off: no row passes through Python, so this is the form for many games."""
    _state_on_disk(events)
    event = F.struct(F.col(at).alias("ts"), F.col("action_number").isNull().alias("unnumbered"), "action_number", "team_id", "kind", F.coalesce("points", F.lit(0)).cast("long").alias("points"), "game_id")
    games = events.withWatermark(at, delay).groupBy("game_id", F.session_window(at, silence)).agg(F.array_sort(F.collect_list(event)).alias("e"))
    # a row without key must reach the watermark, so that it is dropped only behind the window and by a value the window made
    games = games.where(F.get("e", F.lit(0))["game_id"].isNotNull())
    closing = F.filter(F.transform("e", lambda x, i: F.when(x["kind"].isin(*ends), i)), lambda i: i.isNotNull())
    last = F.size("e") - 1
    games = games.select("game_id", "e", F.array_distinct(F.concat(closing, F.array(last))).alias("stops"))
    spans = F.transform("stops", lambda stop, i: F.struct((i + 1).cast("long").alias("poss_index"), F.coalesce(F.get("stops", i - 1) + 1, F.lit(0)).alias("first"), stop.alias("stop")))
    found = games.select("game_id", "e", F.explode(spans).alias("s")).select("game_id", "s.poss_index", F.get("e", F.col("s.stop")).alias("end"), F.slice("e", F.col("s.first") + 1, F.col("s.stop") - F.col("s.first") + 1).alias("own"))
    closed = F.col("end.kind").isin(*ends)
    points = F.aggregate("own", F.lit(0).cast("long"), lambda a, x: a + x["points"])
    return found.select("game_id", "poss_index", F.when(closed, F.col("end.kind")).otherwise("end_of_game").alias("ended_by"), F.when(closed, F.col("end.team_id")).alias("team_id"), points.alias("points"))
