"""Stored states, random effects of many levels, sums in levels, and how evenly scenarios are spread."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridtally.functions.scalars import unit_hash
from gridtally.operators import features as X
from gridtally.operators import fit as M
from gridtally.operators import scenario as N
from gridtally.operators.ordered import _block_of
from gridtally.plans import state as S
from gridtally.plans import strength as T
from gridtally.sources import fixtures as fx


def uniform(seed):
    return (unit_hash("id", seed=seed) + 0.5) / 2**32


# Scenarios ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n_games,files", [(90_000, 1), (150_000, 1), (90_000, 40)])
def test_tasks_of_scenarios_are_even(spark, tmp_path, n_games, files):
    spark.range(n_games).withColumnRenamed("id", "game_id").repartition(files).write.parquet(str(tmp_path / "g"))
    rows = N.scenario_expand(spark.read.parquet(str(tmp_path / "g")), 20)
    sizes = [r[0] for r in rows.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert sum(sizes) == 20 * n_games and len(sizes) >= spark.sparkContext.defaultParallelism
    assert max(sizes) <= 2 * np.median(sizes)


def test_even_partitions_are_opened_where_they_lie(spark):
    width = spark.sparkContext.defaultParallelism
    even = spark.range(0, 8_000, 1, width).withColumnRenamed("id", "game_id")
    uneven = even.union(even.where("game_id < 1000")).union(spark.range(8_000, 16_000, 1, 1).toDF("game_id"))
    for df, wanted in ((even, 0), (uneven, 1)):
        rows = N.scenario_expand(df, 7)
        assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange") == wanted
        assert rows.count() == 7 * df.count()
        assert tuple(rows.agg(F.min("sim"), F.max("sim")).first()) == (1, 7)
    assert N.scenario_expand(even.limit(0), 5).count() == 0


# Blocks of ordered groups ---------------------------------------------------------------------------


def test_blocks_are_found_by_halving(spark):
    for n in (0, 1, 5, 16, 999):
        cuts = sorted(range(3, 3 + 7 * n, 7))
        df = spark.range(0, 7 * n + 9).select("id", F.array(*[F.struct(F.lit(c).cast("bigint").alias("id")) for c in cuts]).alias("cuts") if cuts else F.lit(None).cast("array<struct<id:bigint>>").alias("cuts"))
        got = dict(df.select("id", _block_of(F.struct("id"), F.col("cuts"), 1_000)).collect())
        assert got == {i: sum(c <= i for c in cuts) for i in got}


# Sums in levels -------------------------------------------------------------------------------------


def test_vectors_of_many_tasks_are_added_in_levels(spark, monkeypatch):
    monkeypatch.setattr(M, "FAN", 3)
    df = spark.range(0, 5_000, 1, 41).select(F.col("id").cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("k"))

    def make():
        return lambda m: np.array([[m[m[:, 1] == k, 0].sum(), (m[:, 1] == k).sum()] for k in range(5)])

    got = M.sum_vectors(df, make, 2, 5)
    assert got.tolist() == [[sum(range(k, 5_000, 5)), 1_000] for k in range(5)]
    assert M.sum_vectors(df.limit(0), make, 2, 5).tolist() == [[0, 0]] * 5


def test_sums_read_all_partitions_in_one_job(spark):
    def make():
        return lambda m: np.array([[m[:, 0].sum()]])

    sc, df = spark.sparkContext, spark.range(0, 1_200, 1, 12).selectExpr("double(id) AS x")
    sc.setJobGroup("few partitions", "sums")
    try:
        assert M.sum_vectors(df, make, 1).tolist() == [[sum(range(1_200))]]
    finally:
        sc.setJobGroup("", "")
    # The pass over the rows, and the fetch of the one partition of sums; not a job for each partition.
    assert len(sc.statusTracker().getJobIdsForGroup("few partitions")) <= 3


# Random effects -------------------------------------------------------------------------------------


@pytest.mark.parametrize("logit", [True, False])
def test_level_effects_equal_a_dense_fit(spark, logit):
    df = spark.range(4_000).withColumns({"g": F.concat(F.lit("t"), F.col("id") % 25), "x": uniform(1) * 2 - 1})
    eta = F.col("x") * 0.7 + F.when(F.col("id") % 25 < 9, 0.6).otherwise(-0.4)
    y = F.when(uniform(2) < 1 / (1 + F.exp(-eta)), 0.9).otherwise(0.1) if logit else eta + uniform(2)
    df = df.withColumn("y", F.when(F.col("id") % 97 != 0, y))
    line = X.Basis("x", (X.Part("x", 0.0, 1.0),), None)
    model = M.level_effect_fit(df, "y", [line], "g", 2.5, logit=logit)
    levels = [f"t{i}" for i in range(25)]
    effects = {r["g"]: r["effect"] for r in model.effects.collect()}
    if logit:
        dense = M.binomial_smooth_fit(df, "y", [line, *X.random_effect("g", levels)], 2.5)
        assert model.beta == pytest.approx(dense.beta[:2], abs=1e-6)
        assert [effects[t] for t in levels] == pytest.approx(list(dense.beta[2:]), abs=1e-6)
        a = dict(model.predict(df).select("id", "pred").collect())
        b = dict(dense.predict(df).select("id", "pred").collect())
        assert max(abs(a[i] - b[i]) for i in a) < 1e-6
    else:
        rows = df.na.drop("any").collect()
        z = np.array([[1.0, r["x"], *[float(r["g"] == t) for t in levels]] for r in rows])
        want = np.linalg.solve(z.T @ z + np.diag([0, 0] + [2.5] * 25), z.T @ np.array([r["y"] for r in rows]))
        assert model.beta == pytest.approx(want[:2], abs=1e-9) and [effects[t] for t in levels] == pytest.approx(list(want[2:]), abs=1e-9)


def test_ten_thousand_levels(spark):
    df = spark.range(60_000).withColumns({"g": F.col("id") % 10_000, "x": uniform(3)})
    df = df.withColumn("y", F.col("x") * 2 + (F.col("g") % 3 - 1) + (uniform(4) - 0.5))
    model = M.level_effect_fit(df, "y", [X.Basis("x", (X.Part("x", 0.0, 1.0),), None)], "g", 1.0, logit=False)
    assert model.effects.count() == 10_000 and model.beta[1] == pytest.approx(2.0, abs=0.05)
    by = {r[0]: r[1] for r in model.effects.groupBy(F.col("g") % 3).agg(F.avg("effect")).collect()}
    assert by[2] - by[0] == pytest.approx(2 * 6 / 7, abs=0.1)
    unseen = spark.createDataFrame([(None, 0.5), (99_999, 0.5)], "g long, x double")
    assert [r["pred"] for r in model.predict(unseen).collect()] == pytest.approx([model.beta[0] + 0.5 * model.beta[1]] * 2)


# State of a week ------------------------------------------------------------------------------------


def same(a, b):
    names = sorted(a.columns)
    assert names == sorted(b.columns)
    left, right = ({(r["season"], r["team"], r["game_id"]): r for r in x.select(*names).collect()} for x in (a, b))
    assert left.keys() == right.keys()
    for k, r in left.items():
        for n in names:
            if isinstance(r[n], float):
                assert r[n] == pytest.approx(right[k][n], abs=1e-7), (k, n)
            else:
                assert r[n] == right[k][n], (k, n)


@pytest.mark.parametrize("weeks", [(12, 13), (3, 9, 10, 14)])
def test_a_stored_state_goes_on_like_a_full_run(spark, data, tmp_path, weeks):
    games = fx.games(spark, data)
    state = S.running_state(games, weeks[0], codes={})
    same(S.state_rows(state), T.current_state(games, None, weeks[0], codes={}))
    for before, week in zip(weeks, weeks[1:]):
        S.store_state(state, str(tmp_path / "state"), before)
        stored = S.stored_state(spark, str(tmp_path / "state"), before)
        state = S.extend_state(stored, games.where((F.col("week") > before) & (F.col("week") <= week)), codes={})
        same(S.state_rows(state), T.current_state(games, None, week, codes={}))


def test_unknown_codes_of_a_state_are_null(spark, data):
    games = fx.games(spark, data)
    known = spark.createDataFrame([(f"NATION_{i}",) for i in range(20)], "team string")
    teams = {r[0] for r in T.current_state(games, None, 5, levels=known).select("team").distinct().collect()}
    assert None in teams and teams - {None} <= {f"NATION_{i}" for i in range(20)}
