"""What a keyed stream does with the next rows of a key, given in order: arrays in, arrays and the carried state out."""

from __future__ import annotations

import numpy as np
import pandas as pd


def decayed(made: np.ndarray, attempts: float, makes: float, half_life: float) -> tuple[tuple[np.ndarray, np.ndarray], tuple[float, float]]:
    """Decayed attempts and makes before each shot, and both after the last one."""
    gamma = 2.0 ** (-1.0 / half_life)
    piece = max(int(500 * half_life), 1)  # longer runs would overflow the powers
    before: tuple[list, list] = ([], [])
    for low in range(0, len(made), piece):
        hits = made[low : low + piece]
        left = gamma ** np.arange(len(hits) + 1)
        a = attempts * left + (1 - left) / (1 - gamma)
        m = left * (makes + np.concatenate([[0.0], np.cumsum(hits / left[1:])]))
        before[0].append(a[:-1])
        before[1].append(m[:-1])
        attempts, makes = float(a[-1]), float(m[-1])
    return (np.concatenate([[], *before[0]]), np.concatenate([[], *before[1]])), (attempts, makes)


def possessions(rows: pd.DataFrame | None, index: int, points: int, opened: bool, ends: tuple[str, ...], over: str) -> tuple[pd.DataFrame, tuple[int, int, bool] | None]:
    """Possessions that the next events (kind, team_id, points) of a game end, after `index` of them and with `points` open; and the
    state after, None if the game is over (`rows` is None after silence). Points still open then make a last possession."""
    out = pd.DataFrame({"poss_index": [], "ended_by": [], "team_id": [], "points": []}).astype({"poss_index": "int64", "ended_by": object, "team_id": "Int64", "points": "int64"})
    finished = rows is None
    if rows is not None and len(rows):
        kind, scored = rows["kind"].to_numpy(object), pd.to_numeric(rows["points"]).fillna(0).to_numpy("int64")
        finished, at = bool((kind == over).any()), np.flatnonzero(np.isin(kind.astype(str), ends))
        sums = np.cumsum(scored) + points
        closed = sums[at]
        out = pd.DataFrame({"poss_index": index + 1 + np.arange(len(at)), "ended_by": kind[at], "team_id": rows["team_id"].iloc[at].astype("Int64").array, "points": np.diff(closed, prepend=0)})
        after = kind[at[-1] + 1 :] if len(at) else kind
        opened = bool((after != over).any()) or (opened and not len(at))
        index, points = index + len(at), int(sums[-1] - (closed[-1] if len(at) else 0))
    if not finished:
        return out, (index, points, opened)
    if opened:
        last = pd.DataFrame({"poss_index": [index + 1], "ended_by": ["end_of_game"], "team_id": pd.array([None], "Int64"), "points": [points]})
        out = pd.concat([out, last]) if len(out) else last
    return out, None
