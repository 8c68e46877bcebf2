"""Season scenarios as tables: expand, draw, fill, reshape.

Weeks of the schedule do not depend on each other (strengths are drawn from fixed Beta
parameters every week), so a whole season is one job without a loop over weeks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import draw_beta, draw_normal
from ..functions.scalars import compose_key, if_else, round_away
from .columns import require
from .fit import LinearModel
from .relate import (
    fits_broadcast,
    inner_join_on,
    join_renamed_key,
    role_playing_join,
    scenario_inner_join,
)
from .reshape import unpivot_simple

SCENARIOS = 10_000
SIMS_PER_BLOCK = 50
GAMES_PER_CHUNK = 20_000
SMALLEST_CHUNK = 1_000
#: Partitions are even if the longest has at most so many times the rows of the median one.
EVEN = 2.0


def _layout(n_sims: int, n_games: int, tasks: int) -> tuple[int, int]:
    """(scenarios per block, chunks of games): enough pieces for ``tasks``, whole scenarios
    together where that still leaves enough."""
    per_block = max(1, min(SIMS_PER_BLOCK, n_sims // max(tasks, 1), n_sims), min(10, n_sims))
    blocks = -(-n_sims // per_block)
    most = max(1, -(-n_games // SMALLEST_CHUNK))
    chunks = max(-(-n_games // GAMES_PER_CHUNK), min(-(-tasks // blocks), most), 1)
    return per_block, chunks


def _measured(schedule: DataFrame) -> tuple[int, bool]:
    """Rows of the schedule, and whether its partitions keep all tasks equally busy as they are."""
    lengths = schedule.select(F.spark_partition_id().alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    row = lengths.agg(F.sum("n"), F.max("n"), F.percentile("n", 0.5), F.count(F.lit(1))).first()
    rows, longest, median, parts = row[0] or 0, row[1] or 0, row[2] or 0.0, row[3]
    return rows, parts >= _width(schedule) and longest <= EVEN * median


def _width(schedule: DataFrame) -> int:
    spark = schedule.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def scenario_expand(schedule: DataFrame, n_sims: int = SCENARIOS, key: str = "game_id") -> DataFrame:
    """Every game of the schedule once per scenario (``sim`` 1 to ``n_sims``).

    The rows of each partition of the schedule are counted first. Where there are enough
    partitions, none of them much longer than the others, games are opened where they lie,
    without a shuffle. Otherwise games are spread while they are few: each is repeated per block
    of scenarios, goes to the task of its block and of its chunk of games (by hash of the key),
    and is opened into single scenarios there. Blocks differ by one scenario at most. All games
    of a scenario share a task unless there are too few scenarios to keep the tasks busy, or too
    many games; then the games are cut into chunks.
    """
    require(schedule, key)

    def long(n: int):
        return F.lit(n).cast("long")

    n_games, is_even = _measured(schedule)
    if is_even:
        return schedule.select(F.explode(F.sequence(long(1), long(n_sims))).alias("sim"), "*")
    per_block, chunks = _layout(n_sims, n_games, _width(schedule))
    blocks = -(-n_sims // per_block)
    spread = schedule.select(F.explode(F.sequence(long(0), long(blocks - 1))).alias("__block"), "*")
    task = F.col("__block") * chunks + F.pmod(F.xxhash64(key), F.lit(chunks))
    edge = lambda b: F.floor(b * n_sims / blocks)
    sims = F.sequence(edge(F.col("__block")) + 1, edge(F.col("__block") + 1))
    return spread.repartitionById(blocks * chunks, task.cast("int")).select(F.explode(sims).alias("sim"), *schedule.columns)


def attach_strengths(games: DataFrame, strengths: DataFrame) -> DataFrame:
    """Beta parameters of both sides (games whose team has none go)."""
    if strengths is None:
        raise ValueError("a table of strengths (team, alpha, beta) is needed")
    require(games, "away_team", "home_team")
    require(strengths, "team", "alpha", "beta")
    is_small = fits_broadcast(strengths)
    for side in ("away", "home"):
        role = strengths.select(
            F.col("team").alias(f"{side}_team"),
            F.col("alpha").alias(f"alpha_{side}"),
            F.col("beta").alias(f"beta_{side}"),
        )
        games = games.join(F.broadcast(role) if is_small else role, f"{side}_team", "inner")
    return games


def _period(rows: DataFrame) -> list[str]:
    """The season as the first part of a draw's key, where the rows have one."""
    return ["season"] if "season" in rows.columns else []


def draw_strengths(teams: DataFrame, seed: int, keys: Sequence[str] = ("sim", "week", "team"), name: str = "pre_game_strength") -> DataFrame:
    """One Beta draw per row of a (sim, week, team) table with alpha and beta, and per season if it has one."""
    keys = [*_period(teams), *keys]
    require(teams, "alpha", "beta", *keys)
    return teams.withColumn(name, draw_beta("alpha", "beta", *keys, seed=seed))


def draw_game_strengths(games: DataFrame, seed: int, only: Column | None = None) -> DataFrame:
    """Both sides' draws on the game row itself: the draw is a function of (season, sim, week, team),
    so no table of draws has to be joined. Games that are not in ``only`` get NULL, and no key."""
    require(games, "sim", "week", "alpha_away", "beta_away", "alpha_home", "beta_home")
    return games.withColumns(
        {
            f"pre_game_strength_{s}": draw_beta(
                f"alpha_{s}", f"beta_{s}", *_period(games), "sim", "week", f"{s}_team", seed=seed, only=only
            )
            for s in ("away", "home")
        }
    ).drop("alpha_away", "beta_away", "alpha_home", "beta_home")


def mean_game_strengths(games: DataFrame) -> DataFrame:
    """As ``draw_game_strengths`` with the mean of each distribution in place of a draw."""
    for s in ("away", "home"):
        a, b = F.col(f"alpha_{s}"), F.col(f"beta_{s}")
        games = games.withColumn(f"pre_game_strength_{s}", F.try_divide(a, a + b))
    return games.drop("alpha_away", "beta_away", "alpha_home", "beta_home")


def matchup_features(games: DataFrame) -> DataFrame:
    """Strength difference, playoff type, after-first-week flag."""
    require(games, "pre_game_strength_home", "pre_game_strength_away", "game_type", "week")
    return games.withColumns(
        {
            "strength_diff": F.col("pre_game_strength_home") - F.col("pre_game_strength_away"),
            "game_type_adj": if_else(F.col("game_type") == "REG", F.lit("REG"), F.lit("PLAYOFF")),
            "is_after_week_1": if_else(F.col("week") == 1, F.lit(0), F.lit(1)),
        }
    )


def draw_margins(
    games: DataFrame, sigma: float, seed: int, key: str = "game_id", mean: str = "pred", only: Column | None = None
) -> DataFrame:
    """``outcome_gen``: a normal margin around the prediction, keyed by (sim, game); NULL for games
    that are not in ``only``."""
    require(games, "sim", key, mean)
    return games.withColumn("outcome_gen", draw_normal(mean, sigma, "sim", key, seed=seed, only=only))


def _open(week: int | None) -> Column:
    open_game = F.col("result").isNull()
    return open_game if week is None else open_game & (F.col("week") == week)


def fill_results(games: DataFrame, week: int | None = None) -> DataFrame:
    """Fill missing results of one week (None: of every week) with the drawn margin, rounded
    away from zero; known results and other weeks stay."""
    require(games, "result", "outcome_gen", "week")
    drawn = round_away("outcome_gen").cast("int")
    return games.withColumn("result", F.when(_open(week), drawn).otherwise(F.col("result").cast("int")))


def _with_margin(
    games: DataFrame, model: LinearModel, sigma: float, seed: int, key: str, only: Column | None = None
) -> DataFrame:
    rows = matchup_features(games)
    for name in model.features:
        a, _, b = name.partition("_x_")
        if b and name not in rows.columns:
            rows = rows.withColumn(name, F.col(a) * F.col(b))
    return draw_margins(model.predict(rows), sigma, seed, key, only=only)


def simulate_results(
    games: DataFrame,
    strengths: DataFrame,
    model: LinearModel,
    sigma: float,
    seed: int,
    week: int | None = None,
    key: str = "game_id",
) -> DataFrame:
    """Scenario games with open results filled: draw strengths, predict, draw margins, fill.

    Everything happens on the game row, in one pass: nothing but a small table of strengths is
    joined, and games that stay as they are get no keys and no draws.
    """
    require(games, "result", "week")
    rows = draw_game_strengths(attach_strengths(games, strengths), seed, only=_open(week))
    rows = _with_margin(rows, model, sigma, seed, key, only=_open(week))
    return fill_results(rows, week).select(*games.columns)


def predict_week(
    teams: DataFrame,
    games: DataFrame,
    week: int,
    strengths: DataFrame,
    model: LinearModel,
    sigma: float,
    seed: int,
    key: str = "game_id",
) -> tuple[DataFrame, DataFrame]:
    """One week of a season simulator: (teams, games) of all scenarios in and out.

    Strengths are drawn per row of the (sim, team) table and joined to both sides; the week's
    open results are filled. Gives the results of ``simulate_results`` for that week.
    """
    if strengths is None:
        raise ValueError("a table of strengths (team, alpha, beta) is needed")
    require(teams, "sim", "team")
    require(strengths, "team", "alpha", "beta")
    params = inner_join_on(teams.select("sim", "team"), strengths.select("team", "alpha", "beta"), ["team"])
    if "season" in games.columns:
        params = params.join(games.select("sim", "season").distinct(), "sim")
    drawn = draw_strengths(params.withColumn("week", F.lit(week)), seed)
    ratings = drawn.select(*_period(params), "sim", "team", "pre_game_strength")
    rows = _with_margin(scenario_inner_join(games, ratings), model, sigma, seed, key)
    return teams, fill_results(rows, week).select(*games.columns)


def scenario_games_wide(games: DataFrame, colors: DataFrame) -> DataFrame:
    """Matchup key, both sides' colours, and the winner (a tie counts for the away team)."""
    require(games, "away_team", "home_team", "week", "result")
    keyed = games.withColumn("matchup", matchup_key())
    both = role_playing_join(keyed, colors, "team_abbr", {"away_team": "_away", "home_team": "_home"})
    return both.withColumn("winner", if_else(F.col("result") > 0, F.col("home_team"), F.col("away_team")))


def matchup_key():
    return compose_key("away_team", F.lit("_"), "home_team", F.lit("_wk_"), "week")


def scenario_games_long(games: DataFrame, dim: DataFrame | None = None, drop: Sequence[str] = ()) -> DataFrame:
    """One row per scenario, game and side with the win flag (NULL for a tie)."""
    require(games, "sim", "game_type", "week", "result", "away_team", "home_team")
    rows = games.withColumn("matchup", matchup_key())
    ids = [c for c in ("matchup", "game_id", "sim", "season", "game_type", "week", "result") if c in rows.columns]
    long = unpivot_simple(rows.select(*ids, "away_team", "home_team"), ["away_team", "home_team"], "setting", "team")
    if dim is not None:
        dim = dim.drop(*drop)
        long = join_renamed_key(long, F.broadcast(dim) if fits_broadcast(dim) else dim, {"team": "team_abbr"})
    home = F.col("setting") == "home_team"
    own = F.when(home, F.col("result")).otherwise(-F.col("result"))
    win = F.when(own > 0, 1.0).when(own < 0, 0.0)
    at = long.columns.index("team") + 1
    flagged = long.withColumn("win", win)
    return flagged.select(*long.columns[:at], "win", *long.columns[at:])
