"""Stand-in tables over the supplied parquet files (rules in FIXTURES.md).

Each one is a lazy DataFrame over whole tables. ``nation`` and ``region`` hold a fixed
25 and 5 rows at every scale, so those two are broadcast; ``customer`` grows with the
data and is left to the planner.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"
    )
    customer = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_nationkey"
    )
    nation = table(spark, sf_dir, "nation")
    home = F.broadcast(
        nation.select(
            F.col("n_nationkey").alias("c_nationkey"),
            F.col("n_name").alias("home_team"),
            F.col("n_regionkey").alias("home_region"),
        )
    )
    away = F.broadcast(
        nation.select(
            F.col("n_nationkey").alias("away_key"),
            F.col("n_name").alias("away_team"),
            F.col("n_regionkey").alias("away_region"),
        )
    )
    step = F.floor((F.dayofyear("o_orderdate") - 1) / 20).cast("int")
    unplayed = (F.col("season") == 2001) & (F.col("step") >= 9)
    points = F.floor(F.col("o_totalprice"))
    return (
        orders.join(customer, "o_custkey")
        .withColumn(
            "away_key",
            ((F.col("c_nationkey") + 1 + F.col("o_orderkey") % 24) % 25).cast("int"),
        )
        .join(home, "c_nationkey")
        .join(away, "away_key")
        .withColumn("season", F.year("o_orderdate"))
        .withColumn("step", step)
        .withColumn("away_score", F.when(~unplayed, (F.floor(F.col("o_totalprice") / 45) % 45).cast("int")))
        .withColumn("home_score", F.when(~unplayed, (points % 45).cast("int")))
        .select(
            F.col("o_orderkey").alias("game_id"),
            "season",
            F.when(F.col("step") >= 17, "POST").otherwise("REG").alias("game_type"),
            (F.col("step") + 1).alias("week"),
            F.to_date("o_orderdate").alias("game_date"),
            "away_team",
            "away_score",
            "home_team",
            "home_score",
            (F.col("home_score") - F.col("away_score")).alias("result"),
            (F.col("home_region") == F.col("away_region")).cast("int").alias("div_game"),
        )
    )


def ratings(spark: SparkSession, sf_dir: str, g: DataFrame | None = None) -> DataFrame:
    """From the games, or from ``g`` where they are stored."""
    g = games(spark, sf_dir) if g is None else g
    return g.select(
        F.col("game_date").alias("date"),
        "season",
        F.col("home_team").alias("team1"),
        F.col("away_team").alias("team2"),
        (1300 + F.col("game_id") * 37 % 400).cast("double").alias("elo1_pre"),
        (1300 + F.col("game_id") * 53 % 400).cast("double").alias("elo2_pre"),
    )


def strengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("team"),
        (2 + key % 7).cast("double").alias("alpha"),
        (2 + key % 5).cast("double").alias("beta"),
    )


def divisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = F.broadcast(table(spark, sf_dir, "region"))
    conf = F.when(F.col("n_nationkey") % 2 == 0, "AFC").otherwise("NFC")
    return (
        table(spark, sf_dir, "nation")
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("n_name").alias("team"),
            conf.alias("conf"),
            F.concat(conf, F.lit(" "), F.col("r_name")).alias("division"),
        )
    )


def colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("n_name")
    return table(spark, sf_dir, "nation").select(
        name.alias("team_abbr"),
        F.concat(F.lit("#"), F.substring(F.md5(name), 1, 6)).alias("preferred_color"),
        F.concat(F.lit("#"), F.substring(F.md5(F.concat(F.lit("t"), name)), 1, 6)).alias("team_color"),
    )


def team_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, name = F.col("n_nationkey"), F.col("n_name")
    return table(spark, sf_dir, "nation").select(
        name.alias("team_abbr"),
        F.concat(F.lit("Team "), name).alias("team_name"),
        F.concat(F.lit("T"), key.cast("string")).alias("team_nick"),
        key.cast("string").alias("team_id"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return games(spark, sf_dir).select(
        "game_id",
        "season",
        "week",
        F.col("result").cast("double").alias("truth"),
        ((F.col("game_id") * 7) % 41 - 20).cast("double").alias("estimate"),
    )


def season_length(spark: SparkSession, sf_dir: str, g: DataFrame | None = None) -> DataFrame:
    """Games per season: 16 before 2001, 17 from 2001; one row per season present."""
    return (
        (games(spark, sf_dir) if g is None else g)
        .select("season")
        .distinct()
        .withColumn("games", F.when(F.col("season") < 2001, 16).otherwise(17))
    )
