"""Box-score and multi-file sources: JSON matrices, nested box scores, season files, season-partitioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The nested box score: game -> two teams -> players -> statistics.
BOX_SCHEMA = "gameId string, teams array<struct<teamId: bigint, players: array<struct<personId: bigint, played: string, statistics: struct<points: bigint, minutes: string>>>>>"


def matrix_rows(df: DataFrame, json: str, columns: dict[str, str]) -> DataFrame:
    """Rows of {"columns": [...], "data": [[...], ...]} texts: the named columns, cast to the given types (null where the
    cast fails or the column is absent). Values are found by name, so the order of columns may differ between texts."""
    parsed = df.withColumn("_j", F.from_json(json, "columns array<string>, data array<array<string>>"))
    rows = parsed.select("*", F.explode("_j.data").alias("_r"))
    value = lambda n, t: F.try_element_at("_r", F.nullif(F.array_position("_j.columns", n), F.lit(0).cast("long")).cast("int")).try_cast(t)
    return rows.select(*[c for c in df.columns if c != json], *[value(n, t).alias(n) for n, t in columns.items()])


def box_rows(df: DataFrame, json: str) -> DataFrame:
    """Flat rows (game_id, team_id, player_id, points, minutes) of nested box-score texts: players who took part."""
    game = df.select(F.from_json(json, BOX_SCHEMA).alias("b")).select("b.gameId", F.explode("b.teams").alias("t"))
    rows = game.select("gameId", "t.teamId", F.explode("t.players").alias("p")).where("p.played = '1'")
    return rows.select(F.col("gameId").alias("game_id"), F.col("teamId").alias("team_id"), F.col("p.personId").alias("player_id"), F.col("p.statistics.points").alias("points"), F.col("p.statistics.minutes").alias("minutes"))


def read_season_files(spark: SparkSession, pattern: str, schema: StructType | str, season: str = r"(\d{4})\.csv$") -> DataFrame:
    """CSV files of one pattern with a pinned schema; the season comes from the file name."""
    df = spark.read.csv(pattern, header=True, schema=schema)
    return df.withColumn("season", F.regexp_extract(F.col("_metadata.file_path"), season, 1).try_cast("int"))


def write_by_season(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet with a folder per season, so that readers of some seasons skip the others; a season is dealt over several
    tasks by game."""
    df.repartition("season", "game_id").write.mode(mode).partitionBy("season").parquet(path)
