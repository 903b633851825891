"""Search over player-game facts: game search, multi-player conditions, team games, span search."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.spans import span_table


@dataclass
class SearchSpec:
    """bounds: column -> (low, high); formulas: (left, op, right, comparator, value); sort: (column, descending)."""

    bounds: dict[str, tuple] = field(default_factory=dict)
    formulas: list[tuple] = field(default_factory=list)
    name: tuple[str, str] | None = None
    mode: str = "totals"
    rated: tuple[str, ...] = ()
    dates: tuple = (None, None)
    sort: tuple[str, bool] | None = None


def _rated(df: DataFrame, spec: SearchSpec) -> DataFrame:
    minutes = F.col("minutes") if "minutes" in df.columns else None
    games = F.col("games") if "games" in df.columns else F.lit(1)
    poss = F.col("possessions") if "possessions" in df.columns else None
    return df.withColumns({c: S.rate(F.col(c), spec.mode, games, minutes, poss) for c in spec.rated}) if spec.rated else df


def _tests(spec: SearchSpec):
    tests = [S.in_range(F.col(c), *b) for c, b in spec.bounds.items()]
    tests += [S.compares(S.combine(F.col(a), op, F.col(b)), cmp, v) for a, op, b, cmp, v in spec.formulas]
    if spec.name:
        tests.append(S.name_contains(F.col(spec.name[0]), spec.name[1]))
    return S.all_of(tests)


def game_search(facts: DataFrame, spec: SearchSpec) -> DataFrame:
    """Facts in rate mode that meet all bounds; a null fails any bound that is set."""
    facts = facts.where(S.in_range(F.col("date"), *spec.dates)) if any(spec.dates) else facts
    out = _rated(facts, spec).where(_tests(spec))
    return out.orderBy(F.coalesce(F.col(spec.sort[0]), F.lit(0)).desc() if spec.sort[1] else F.coalesce(F.col(spec.sort[0]), F.lit(0))) if spec.sort else out


def with_company(hits: DataFrame, n: int, scope: str = "game") -> DataFrame:
    """Hits in games with at least n of them: in the 'game', in one 'team', or in 'each' of two teams or more."""
    if scope == "game":
        return hits.withColumn("_n", F.count("*").over(Window.partitionBy("game_id"))).where(F.col("_n") >= n).drop("_n")
    out = hits.withColumn("_n", F.count("*").over(Window.partitionBy("game_id", "team_id"))).where(F.col("_n") >= n)
    if scope == "each":
        per = Window.partitionBy("game_id")
        out = out.withColumn("_t", F.size(F.collect_set("team_id").over(per))).where("_t >= 2").drop("_t")
    return out.drop("_n")


def team_games(hits: DataFrame) -> DataFrame:
    out = hits.groupBy("game_id", "team_id").agg(F.count("*").alias("players"), F.sort_array(F.collect_list("player_id")).alias("p"))
    return out.select("game_id", "team_id", "players", F.array_join("p", ",").alias("player_ids"))


def span_search(facts: DataFrame, sums: list[str], scope: SearchSpec, having: SearchSpec) -> DataFrame:
    """Per player over the games in scope: games, sums, weighted and ratio figures; then bounds on the span."""
    rows = facts.where(S.in_range(F.col("date"), *scope.dates)) if any(scope.dates) else facts
    rows = rows.where(_tests(scope))
    out = rows.groupBy("player_id").agg(F.count("*").alias("games"), F.sum("minutes").alias("minutes"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.max_by("team_id", F.struct("date", "game_id")).alias("team_id"), *[F.sum(c).alias(c) for c in sums])
    out = out.withColumns({"fg_pct": S.ratio(F.col("fgm"), F.col("fga"))} if {"fgm", "fga"} <= set(sums) else {})
    out = _rated(out, having).where(_tests(having))
    return out


def span_report(facts: DataFrame, scope: SearchSpec, having: SearchSpec, shown: dict[str, str] | None = None, texts: tuple[str, ...] = ("player_name", "listed_height")) -> DataFrame:
    """The span table of the games in scope, for spans that meet `having` (bounds and formulas in its mode, for its rated columns).

    `shown` gives columns another mode for display only (per_game, per_36, per_100). `having.sort` sorts by a column as it is shown:
    texts without regard to null and '', numbers with null as 0, ties by player_id.
    """
    rows = facts.where(S.in_range(F.col("date"), *scope.dates)) if any(scope.dates) else facts
    spans = span_table(rows.where(_tests(scope)))
    kept = _rated(spans.withColumn("_span", F.struct(*spans.columns)), having).where(_tests(having)).select("_span.*")
    shown = shown or {}
    out = kept.withColumns({c: S.rate(F.col(c), mode, F.col("games"), F.col("minutes"), F.col("possessions")) for c, mode in shown.items()}) if shown else kept
    if not having.sort:
        return out
    name, down = having.sort
    key = F.coalesce(F.col(name), F.lit("" if name in texts else 0))
    return out.orderBy(key.desc() if down else key, "player_id")


def prorated(facts: DataFrame, season_values: DataFrame, per_game: list[str], season_totals: list[str]) -> DataFrame:
    """Season values once per (player, season): per-game values times the selected games, totals by the share of games."""
    picked = facts.groupBy("player_id", "season").agg(F.count("*").alias("picked"))
    rows = picked.join(season_values, ["player_id", "season"], "left")
    cols = [F.sum(F.col(c) * F.col("picked")).alias(c) for c in per_game] + [F.sum(F.when(F.col("season_games") > 0, F.col(c) * F.col("picked") / F.col("season_games"))).alias(c) for c in season_totals]
    return rows.groupBy("player_id").agg(F.sum("picked").alias("games"), *cols)


def in_seasons(facts: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Rows of the seasons first to last; None is an open end, and an end before the start leaves nothing."""
    return facts.where(S.in_range(F.col("season"), first, last))


def split_bounds(slots: list[tuple[str, float | None, float | None]]) -> dict[str, tuple]:
    """Bounds of a SearchSpec from slots (figure, least, most); a slot without bounds asks for nothing, and two slots on one figure
    both hold."""
    out: dict[str, tuple] = {}
    for name, low, high in slots:
        if low is None and high is None:
            continue
        a, b = out.get(name, (None, None))
        out[name] = (low if a is None else a if low is None else max(a, low), high if b is None else b if high is None else min(b, high))
    return out
