"""Regularised plus-minus: ridge regression on lineup designs, by distributed normal equations."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import lineups

#: Features up to which the Gram matrix is solved on the driver (5,000 squared is 200 MB); with more, its entries stay in
#: Spark and the driver holds a few vectors only.
MAX_FEATURES = 5000
#: Design rows that a task multiplies at once, and products (features squared) that it sums in one array; with more it sorts them.
CHUNK, DENSE = 50_000, 4_000_000
_ONE, _Y = -1, -2  # numbers of the constant and of the first y among the features; further ones go down from there


@dataclass
class NormalEquations:
    """Feature numbers in order, column sums, products with y, row count and sum of y, all over scaled rows, and the Gram matrix
    (or, where it is too large, its upper triangle as a table i, j, g)."""

    features: np.ndarray
    sx: np.ndarray
    xy: np.ndarray
    n: float
    ty: float
    gram: np.ndarray | None
    table: DataFrame | None = None

    def solve(self, alpha: np.ndarray | float) -> np.ndarray:
        """Coefficients for a penalty (one, or one per feature) with a free intercept."""
        alpha = np.broadcast_to(alpha, len(self.sx)).astype(float)
        right = self.xy - self.sx * self.ty / self.n
        if self.gram is not None:
            return np.linalg.solve(self.gram - np.outer(self.sx, self.sx) / self.n + np.diag(alpha), right)
        return self._conjugate_gradient(alpha, right)

    def intercept(self, coef: np.ndarray) -> float:
        """The free intercept that goes with coefficients."""
        return float((self.ty - self.sx @ coef) / self.n)

    def _times(self, p: np.ndarray) -> np.ndarray:
        """Gram matrix times p, summed in Spark; p and the result have one number per feature."""
        vector = self.table.sparkSession.createDataFrame(pd.DataFrame({"f": self.features, "p": p}), "f long, p double")
        both = F.explode(F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))))
        rows = self.table.select(both.alias("e"), "g").select("e.i", F.col("e.j").alias("f"), "g").join(vector, "f")
        sums = rows.groupBy("i").agg(F.sum(F.col("g") * F.col("p")).alias("v")).toArrow()
        out = np.zeros(len(p))
        out[np.searchsorted(self.features, sums.column("i").to_numpy())] = sums.column("v").to_numpy()
        return out

    def _conjugate_gradient(self, alpha: np.ndarray, right: np.ndarray, tolerance: float = 1e-10) -> np.ndarray:
        x, r = np.zeros_like(right), right.copy()
        p, rr = r.copy(), r @ r
        stop = tolerance**2 * rr
        for _ in range(10 * len(right)):
            if rr <= stop:
                break
            a = self._times(p) - self.sx * (self.sx @ p) / self.n + alpha * p
            step = rr / (p @ a)
            x, r = x + step * p, r - step * a
            rr, before = r @ r, rr
            p = r + rr / before * p
        if not rr <= stop:  # also where it is no number
            raise ArithmeticError(f"ridge fit did not converge in {10 * len(right)} steps: residual {np.sqrt(rr):.3g}")
        return x


#: A design row that is held as lineups: the columns of players with +1 and of those with -1, and of the ys.
Side = tuple[str, str, tuple[str, ...]]


def _written(rows: pa.Table, sides: tuple[Side, ...]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Row, feature and sign of all features, and the ys, of design rows: of fx or, with `sides`, of lineups, whose players have the
    numbers of offence and defence designs. Negative features and nulls are left out."""
    number = lambda c: rows.column(c).combine_chunks().fill_null(0.0).to_numpy(zero_copy_only=False)
    at = lambda lists: np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    if not sides:
        fx = rows.column("fx").combine_chunks()
        f, s = fx.flatten().flatten()
        f, s, row = f.fill_null(-1).to_numpy(zero_copy_only=False), s.fill_null(0.0).to_numpy(zero_copy_only=False), at(fx)
        yield row[f >= 0], f[f >= 0], s[f >= 0], [number("y")]
    for plus, minus, ys in sides:
        parts = []
        for column, code, sign in ((plus, lineups.OFFENCE, 1.0), (minus, lineups.DEFENCE, -1.0)):
            lists = rows.column(column).combine_chunks()
            players, row = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False), at(lists)
            parts.append((row[players >= 0], players[players >= 0] * 2 + code, np.full(int((players >= 0).sum()), sign)))
        row, f, s = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(row, kind="stable")
        yield row[order], f[order], s[order], [number(y) for y in ys]


def _row_groups(rows: pa.Table, sides: tuple[Side, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features and scaled values (rows by columns) of design rows with equally many features: the ys, the constant, the features.
    A null among values counts as 0, as it would in a sum."""
    w = rows.column("w").combine_chunks().fill_null(0.0).to_numpy(zero_copy_only=False)
    for row, f, s, ys in _written(rows, sides):
        more, x = np.stack([*[y * w for y in reversed(ys)], np.ones(len(w))], 1), s * w[row]
        sizes = np.bincount(row, minlength=len(w))
        for size in np.unique(sizes):
            own, at = sizes == size, sizes[row] == size
            n = int(own.sum())
            yield np.hstack([np.tile(np.arange(_ONE - len(ys), 0), (n, 1)), f[at].reshape(n, size)]), np.hstack([more[own], x[at].reshape(n, size)])


def _products(rows: pa.Table, sides: tuple[Side, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sums of products over design rows: i, j (i <= j) and g, each pair once; all pairs of a y or the constant, and others if not 0."""
    groups = list(_row_groups(rows, sides))
    features = np.unique(np.concatenate([np.unique(f) for f, _ in groups]))
    p, own = len(features), np.zeros(len(features))
    dense, codes, sums = (np.zeros(p * p) if p * p <= DENSE else None), [], []
    for f, x in groups:
        at = np.searchsorted(features, f)
        for a in range(f.shape[1]):
            own += np.bincount(at[:, a], x[:, a] ** 2, p)
            code, v = (np.minimum(at[:, a, None], at[:, a + 1 :]) * p + np.maximum(at[:, a, None], at[:, a + 1 :])).ravel(), (x[:, a, None] * x[:, a + 1 :]).ravel()
            if dense is not None:
                dense += np.bincount(code, v, p * p)
            else:
                there, inverse = np.unique(code, return_inverse=True)
                codes.append(there)
                sums.append(np.bincount(inverse, v, len(there)))
    if dense is None:
        code, inverse = np.unique(np.concatenate([*codes, np.arange(p) * (p + 1)]), return_inverse=True)
        g = np.bincount(inverse, np.concatenate([*sums, np.zeros(p)]), len(code))
    else:
        code = np.flatnonzero(np.triu(np.ones((p, p), bool)))
        g = dense[code]
    i, j = np.divmod(code, p)
    g = np.where(i == j, 2 * g + own[i], g)  # a feature that a row holds twice meets itself twice
    keep = (g != 0) | (features[i] < 0)
    return features[i[keep]], features[j[keep]], g[keep]


def _sums_of_tasks(sides: tuple[Side, ...], by: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sums(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        keys = rows.select(list(by)).group_by(list(by)).aggregate([]).to_pylist() if by else [{}]
        for key in keys:
            own = rows
            for c, v in key.items():
                own = own.filter(pc.is_null(own.column(c)) if v is None else pc.equal(own.column(c), v))
            i, j, g = _products(own, sides)
            yield pa.RecordBatch.from_arrays([*[pa.array([v] * len(i), rows.schema.field(c).type) for c, v in key.items()], pa.array(i), pa.array(j), pa.array(g)], [*by, "i", "j", "g"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= CHUNK:
                yield from sums(held)
                held = []
        if held:
            yield from sums(held)

    return run


def gram_table(rows: DataFrame, by: tuple[str, ...] = (), sides: tuple[Side, ...] = ()) -> DataFrame:
    """The upper triangle (by..., i, j, g) of the Gram matrix of design rows (fx, y, w) with a constant and y as further columns; or,
    with `sides`, of rows (lineups, ys, w) that hold a design row for each side (lineups.packed_stints(), packed_possessions()).

    Products are made within a row (some dozen features) and summed by task as they arise, then in one shuffle; features are
    numbers, and negative ones and nulls are no players.
    """
    lists = list(dict.fromkeys(c for side in sides for c in side[:2]))
    numbers = ["w", *(y for side in sides for y in side[2])] if sides else ["w", "y"]
    players = [F.col(c).cast("array<bigint>").alias(c) for c in lists] or [F.col("fx").cast("array<struct<f:bigint,s:double>>").alias("fx")]
    for c in lists or ["fx"]:
        rows = rows.where(F.col(c).isNotNull())
    slim = rows.select(*by, *players, *[F.col(c).cast("double").alias(c) for c in numbers])
    named = ", ".join([*[f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in by], "i long, j long, g double"])
    return slim.mapInArrow(_sums_of_tasks(sides, by), named).groupBy(*by, "i", "j").agg(F.sum("g").alias("g"))


def equations_of(table: DataFrame, ys: int = 1) -> list[NormalEquations]:
    """The equations of a gram_table(), one for each y. What comes to the driver is one number per feature, and the matrix up to
    MAX_FEATURES."""
    edge = table.where(F.col("i") < 0).toPandas()
    of = lambda i: edge[(edge["i"] == i) & (edge["j"] >= 0)].sort_values("j")
    corner = lambda i, j: float(edge.loc[(edge["i"] == i) & (edge["j"] == j), "g"].sum())
    one = of(_ONE)
    features = one["j"].to_numpy(np.int64)
    inner = table.where(F.col("i") >= 0)
    gram = None
    if len(features) <= MAX_FEATURES:
        entries = inner.toArrow()
        i, j = (np.searchsorted(features, entries.column(c).to_numpy()) for c in ("i", "j"))
        gram = np.zeros((len(features), len(features)))
        np.add.at(gram, (i, j), entries.column("g").to_numpy())
        gram = np.triu(gram) + np.triu(gram, 1).T
    return [NormalEquations(features, one["g"].to_numpy(float), of(y)["g"].to_numpy(float), corner(_ONE, _ONE) or 1.0, corner(y, _ONE), gram, None if gram is not None else inner) for y in range(_Y, _Y - ys, -1)]


def normal_equations(rows: DataFrame, sides: tuple[Side, ...] = ()) -> list[NormalEquations]:
    """The equations of the rows of gram_table(), one for each y, which share their products. A table of products that is solved in
    Spark stays persisted."""
    table = gram_table(rows, sides=sides).persist()
    out = equations_of(table, len(sides[0][2]) if sides else 1)
    if out[0].table is None:
        table.unpersist()
    return out


def ridge_fit(rows: DataFrame, alpha: float = 2500.0, name: str = "player_id") -> DataFrame:
    """Coefficients (player_id, coefficient) of min |w (y - b) - w X c|^2 + alpha |c|^2 with an unweighted intercept b after
    scaling, on design rows (fx, y, w)."""
    (eq,) = normal_equations(rows)
    frame = pd.DataFrame({name: eq.features, "coefficient": eq.solve(alpha)})
    return rows.sparkSession.createDataFrame(frame, f"{name} long, coefficient double")


def centred_ratings(eq: NormalEquations, alpha_offence: float, alpha_defence: float) -> tuple[pd.DataFrame, float]:
    """Ratings (player_id, offence, defence, total) with a penalty per block and each block centred on its mean, and the intercept,
    which takes up five times the difference of the means so that fitted values stay; players seen on one side only get 0 on
    the other."""
    coef = eq.solve(np.where(eq.features % 2 == 0, alpha_offence, alpha_defence))
    long = pd.DataFrame({"role": np.where(eq.features % 2 == 0, "O", "D"), "player_id": eq.features // 2, "c": coef})
    means = long.groupby("role")["c"].mean()
    intercept = eq.intercept(coef) + 5.0 * (means.get("O", 0.0) - means.get("D", 0.0))
    long["c"] -= long.groupby("role")["c"].transform("mean")
    wide = long.pivot(index="player_id", columns="role", values="c").reindex(columns=["O", "D"]).fillna(0.0).reset_index()
    return wide.rename(columns={"O": "offence", "D": "defence"}).assign(total=wide["O"] + wide["D"])[["player_id", "offence", "defence", "total"]], intercept


def offence_defence_ratings(eq: NormalEquations, alpha_offence: float, alpha_defence: float) -> pd.DataFrame:
    """The ratings of centred_ratings() alone."""
    return centred_ratings(eq, alpha_offence, alpha_defence)[0]


def offence_defence_model(rows: DataFrame, alpha_offence: float, alpha_defence: float) -> tuple[DataFrame, float]:
    """The ratings of rows from offence_defence_design() or possession_design(), and the intercept."""
    ratings, intercept = centred_ratings(normal_equations(rows)[0], alpha_offence, alpha_defence)
    return rows.sparkSession.createDataFrame(ratings, "player_id long, offence double, defence double, total double"), intercept


def offence_defence_fit(rows: DataFrame, alpha_offence: float, alpha_defence: float) -> DataFrame:
    """The ratings of offence_defence_model() alone."""
    return offence_defence_model(rows, alpha_offence, alpha_defence)[0]


def plus_minus_table(stints: DataFrame, alpha_offence: float, alpha_defence: float, least_minutes: float = 200.0) -> DataFrame:
    """Raw and adjusted ratings with minutes and the primary team, for players of `least_minutes` or more. Stints are read once for
    both fits and once for time and team."""
    fits = [offence_defence_ratings(eq, alpha_offence, alpha_defence) for eq in normal_equations(*lineups.packed_stints(stints, adjusted=True))]
    raw, adj = (stints.sparkSession.createDataFrame(fit, "player_id long, offence double, defence double, total double") for fit in fits)
    adj = adj.select("player_id", *[F.col(c).alias(f"{c}_adj") for c in ("offence", "defence", "total")])
    played = lineups.primary_team_and_time(lineups.by_side(stints)).withColumn("minutes", F.col("seconds") / 60.0).where(F.col("minutes") >= least_minutes)
    return raw.join(adj, "player_id").join(played.select("player_id", "minutes", "team_id"), "player_id")


def window_of(season: Column, windows: dict[str, tuple]) -> Column:
    """The names of the windows (first, last; None is open) that a season belongs to."""
    inside = lambda first, last: (season >= first if first is not None else F.lit(True)) & (season <= last if last is not None else F.lit(True))
    return F.filter(F.array(*[F.when(inside(*w), n) for n, w in windows.items()]), lambda n: n.isNotNull())


def plus_minus_windows(stints: DataFrame, windows: dict[str, tuple], alphas: list[float], possessions: DataFrame | None = None, least_coverage: float = 0.98) -> DataFrame:
    """Ratings of each window of seasons and each penalty: rows window, source, alpha, player_id, ratings.

    Each source is read once for the windows that are fitted on it: products are summed by the set of windows that a row lies in,
    then per window. With `possessions` (and a season), a window is fitted on these where they cover at least `least_coverage`
    of its games with stints, else on stints.
    """
    source = dict.fromkeys(windows, "stints")
    if possessions is not None:
        games = stints.select("season", "game_id").distinct().select(F.explode(window_of(F.col("season"), windows)).alias("window"), "game_id").distinct()
        have = possessions.select("game_id").distinct().withColumn("_there", F.lit(True))
        for name, wanted, there in games.join(have, "game_id", "left").groupBy("window").agg(F.count("*"), F.count("_there")).collect():  # a row per window
            source[name] = "possessions" if there >= least_coverage * wanted else "stints"
    parts = []
    for kind, rows, design in (("stints", stints, lineups.packed_stints), ("possessions", possessions, lineups.packed_possessions)):
        own = [n for n in windows if source[n] == kind]
        if not own:
            continue
        places = window_of(F.col("season"), {str(k): windows[n] for k, n in enumerate(own)})
        packed, sides = design(rows.withColumn("window", F.concat_ws(",", places)).where("window <> ''"))
        table = gram_table(packed, ("window",), sides)
        table = table.withColumn("window", F.explode(F.split("window", ","))).groupBy("window", "i", "j").agg(F.sum("g").alias("g")).persist()
        for k, name in enumerate(own):
            (eq,) = equations_of(table.where(F.col("window") == str(k)).drop("window"))
            parts += [offence_defence_ratings(eq, alpha, alpha).assign(window=name, source=kind, alpha=alpha) for alpha in alphas if len(eq.features)]
        table.unpersist()
    columns = ["window", "source", "alpha", "player_id", "offence", "defence", "total"]
    out = pd.concat(parts)[columns] if parts else pd.DataFrame(columns=columns)
    return stints.sparkSession.createDataFrame(out, "window string, source string, alpha double, player_id long, offence double, defence double, total double")
