"""Table sources and sinks.

Anything written goes to a path the caller names; scratch tables go to the shared folder the
session names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.fit import LinearModel, SmoothModel
from .shared import settle, shared_folder

GAMES_SCHEMA = (
    "game_id string, season int, game_type string, week int, away_team string, away_score int, "
    "home_team string, home_score int, result int, div_game int"
)
__all__ = [
    "games_source", "ratings_csv_source", "ratings_csv_write", "table_read", "table_write", "snapshot_write",
    "snapshot_read", "model_write", "model_read", "settle", "shared_folder",
]

RATINGS_SCHEMA = "date date, season int, team1 string, team2 string, elo1_pre double, elo2_pre double"


def games_source(spark: SparkSession, path: str, schema: str = GAMES_SCHEMA) -> DataFrame:
    """Wide games, one row per game; the schema is fixed, not inferred."""
    return spark.read.schema(schema).parquet(path)


def ratings_csv_source(spark: SparkSession, path: str, schema: str = RATINGS_SCHEMA, null_text: str = "NA") -> DataFrame:
    """Delimited ratings with a header line. A bad value raises an error instead of turning NULL."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("nullValue", null_text)
        .option("mode", "FAILFAST")
        .csv(path)
    )


def ratings_csv_write(df: DataFrame, path: str, null_text: str = "NA") -> None:
    df.write.mode("overwrite").option("header", True).option("nullValue", null_text).csv(path)


def table_read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def table_write(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def snapshot_write(df: DataFrame, path: str, as_of_week: int) -> None:
    """Store a result under its week; other weeks already stored at the path stay."""
    (
        df.withColumn("as_of_week", F.lit(as_of_week))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("as_of_week")
        .parquet(path)
    )


def snapshot_read(spark: SparkSession, path: str, as_of_week: int) -> DataFrame:
    return spark.read.parquet(path).where(F.col("as_of_week") == as_of_week)


def model_write(spark: SparkSession, model: LinearModel | SmoothModel, path: str) -> None:
    """Store a fitted model as a table of coefficients (and covariance)."""
    model.to_frame(spark).coalesce(1).write.mode("overwrite").parquet(path)


def model_read(spark: SparkSession, path: str) -> LinearModel | SmoothModel:
    df = spark.read.parquet(path)
    return (SmoothModel if "covariance" in df.columns else LinearModel).from_frame(df)
