"""Data-quality audits: rule counts, flagged rows, key collisions, duplicates, worklists, risk scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Rules of a player-game fact row: what is missing, what cannot be, and how far two sources may differ. Limits are fixed values.
FACT_RULES = {
    "missing_on_possessions": "on_possessions IS NULL", "missing_box_stats": "pts IS NULL", "missing_team_meta": "team_abbr IS NULL OR opp_team_abbr IS NULL", "blank_player_name": "player_name IS NULL OR trim(player_name) = ''",
    "bad_fgm_fga": "fgm > fga", "bad_fg3m_fg3a": "fg3m > fg3a", "bad_ftm_fta": "ftm > fta", "bad_points_formula": "pts <> 2 * (fgm - fg3m) + 3 * fg3m + ftm", "bad_rebound_formula": "reb <> oreb + dreb",
    "pm_vs_reconstructed_mismatch": "abs(plus_minus_actual - on_diff_reconstructed) > 0.5", "extreme_pace": "minutes >= 5 AND (on_possessions / minutes * 48.0 < 75 OR on_possessions / minutes * 48.0 > 125)",
}


def fact_rules() -> dict[str, Column]:
    return {n: F.expr(e) for n, e in FACT_RULES.items()}


def rule_counts(df: DataFrame, rules: dict[str, Column], by: list[Column]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("rows"), *[F.count_if(c).alias(n) for n, c in rules.items()])


def violations(df: DataFrame, rules: dict[str, Column], keep: list[str]) -> DataFrame:
    flags = {n: F.coalesce(c, F.lit(False)) for n, c in rules.items()}
    out = df.withColumns(flags)
    return out.where(reduce(lambda a, b: a | b, [F.col(n) for n in flags])).select(*keep, *flags)


def key_collisions(df: DataFrame, key: Column, other: Column, name: str) -> DataFrame:
    """Keys that go with more than one other value, and these in order."""
    out = df.select(key.alias(name), other.cast("string").alias("_o")).where("_o is not null").distinct().groupBy(name).agg(F.count("*").alias("n_values"), F.sort_array(F.collect_set("_o")).alias("v"))
    return out.where("n_values > 1").select(name, "n_values", F.array_join("v", ",").alias("values"))


def duplicate_keys(df: DataFrame, keys: list[str], source: str) -> DataFrame:
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(source)).alias("s")).where("n > 1")
    return out.select(*keys, "n", F.array_join("s", ",").alias("sources"))


def missing_by_game(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Games with rows that lack `column`: how many, and their minutes."""
    return df.where(F.col(column).isNull()).groupBy(*by).agg(F.count("*").alias("missing_rows"), F.sum("minutes").alias("minutes_total"))


def gaps_by_game(df: DataFrame, gap: Column, least: float) -> DataFrame:
    return df.withColumn("_g", F.abs(gap)).where(F.col("_g") > least).groupBy("game_id").agg(F.count("*").alias("rows"), F.sum("_g").alias("sum_abs"), F.max("_g").alias("max_abs"))


def risk_scores(games: DataFrame, flags: dict[str, Column], weights: dict[str, int]) -> DataFrame:
    score = reduce(lambda a, b: a + b, [F.when(F.coalesce(c, F.lit(False)), weights[n]).otherwise(0) for n, c in flags.items()])
    return games.withColumn("risk", score).withColumn("bucket", F.when(F.col("risk") == 0, "low").when(F.col("risk") <= 2, "medium").otherwise("high"))


def sample_per_bucket(df: DataFrame, bucket: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows per bucket by a seeded hash of the key: the same on every run."""
    from ..operators.tables import top_n

    return top_n(df.withColumn("_h", F.xxhash64(F.lit(seed), key)), [bucket], [F.col("_h"), F.col(key)], n).drop("_h", "rank")


def dedupe_report(df: DataFrame, keys: list[str]) -> DataFrame:
    out = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.sum("n").alias("total"), F.count("*").alias("kept"))
    return out.withColumn("removed", F.col("total") - F.col("kept"))


def population(df: DataFrame, means: list[str], listed: str, name: str) -> DataFrame:
    """One row: how many rows, the means of columns without nulls, and the distinct values of a column in order (of few values)."""
    values = F.array_join(F.sort_array(F.collect_set(F.col(listed).cast("string"))), ",")
    return df.agg(F.count("*").alias("rows"), *[F.avg(c).alias(f"{c}_mean") for c in means], values.alias(name))


def extremes(df: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """Rows outside [low, high] and how far outside they are."""
    c = F.col(value)
    return df.where((c < low) | (c > high)).withColumn("distance", F.when(c > high, c - high).otherwise(low - c))


def missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that lack one of the columns (null, or a blank text), with a flag per column."""
    empty = {f"{c}_missing": F.col(c).isNull() | F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(False)) for c in columns}
    out = df.withColumns(empty)
    return out.where(reduce(lambda a, b: a | b, [F.col(n) for n in empty]))


def worklist(df: DataFrame, key: str, is_missing: Column, weight: str, n: int) -> DataFrame:
    """The n keys with most missing rows, then most weight in them: key, missing, rows, weight."""
    out = df.groupBy(key).agg(F.count_if(is_missing).alias("missing"), F.count("*").alias("rows"), F.sum(F.when(is_missing, F.col(weight)).otherwise(0)).alias("weight"))
    return out.where("missing > 0").orderBy(F.col("missing").desc(), F.col("weight").desc(), key).limit(n)


def progress(before: DataFrame, after: DataFrame, key: str, was_missing: Column, is_missing: Column) -> DataFrame:
    """Per key the missing rows before and after a repair, and whether they became fewer."""
    a = before.groupBy(key).agg(F.count_if(was_missing).alias("before"))
    b = after.groupBy(key).agg(F.count_if(is_missing).alias("after"))
    return a.join(b, key, "left").withColumn("after", F.coalesce("after", F.lit(0))).withColumn("better", F.col("after") < F.col("before"))


def incomplete(rows: DataFrame, dimension: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys of `rows` that no row of the dimension describes in full."""
    full = dimension.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])).select(key).distinct()
    return rows.select(key).distinct().join(full, key, "left_anti")
