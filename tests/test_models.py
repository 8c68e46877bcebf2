"""Fits against Spark ML and against their own properties."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.sql import functions as F

from gridtally.functions.scalars import unit_hash
from gridtally.operators import features as X
from gridtally.operators import fit as M
from gridtally.operators.relate import best_candidate
from gridtally.operators.splits import kfold
from gridtally.plans import history as H
from gridtally.plans import margin as G
from gridtally.plans import ratings as P
from gridtally.plans import strength as T
from gridtally.sources import fixtures as fx
from gridtally.sources import tables as src
from gridtally.sources.shared import settle


@pytest.fixture(scope="module")
def rows(spark):
    """2,000 rows: two predictors, a group, a margin and a share that depend on them."""
    u = [(unit_hash("id", seed=s) + 0.5) / 2**32 for s in range(4)]
    df = spark.range(2_000).select(
        "id",
        (u[0] * 4 - 2).alias("a"),
        (u[1] * 10 + 100).alias("b"),
        F.concat(F.lit("t"), (F.col("id") % 6).cast("string")).alias("team"),
        u[2].alias("noise"),
        u[3].alias("more"),
    )
    eta = F.sin("a") * 1.2 + (F.col("b") - 105) * 0.15 + F.when(F.col("team") == "t1", 0.6).otherwise(0.0)
    p = 1 / (1 + F.exp(-eta))
    wins = sum([F.when((unit_hash("id", seed=20 + k) + 0.5) / 2**32 < p, 1.0).otherwise(0.0) for k in range(8)])
    df = df.withColumns({"share": wins / 8, "margin": 3.0 + 2.0 * F.col("a") - 0.5 * F.col("b") + F.col("noise") * 4})
    return df.repartition(5).cache()


def test_linear_fit_equals_spark_ml(rows):
    model = M.linear_fit(rows, "margin", ["a", "b"])
    vec = VectorAssembler(inputCols=["a", "b"], outputCol="x").transform(rows)
    ml = LinearRegression(featuresCol="x", labelCol="margin", solver="normal").fit(vec)
    assert model.coef == pytest.approx(list(ml.coefficients), rel=1e-9)
    assert model.intercept == pytest.approx(ml.intercept, rel=1e-8)
    rss = ml.summary.meanSquaredError * 2_000
    assert model.sigma == pytest.approx((rss / (2_000 - 3)) ** 0.5, rel=1e-9)
    sigma = M.residual_sigma(model.predict(rows), "margin", "pred", 2).first()["sigma"]
    assert sigma == pytest.approx(model.sigma, rel=1e-9)


def test_linear_fit_with_repeated_and_constant_features(rows):
    df = rows.withColumns({"a2": F.col("a") * 2, "one": F.lit(1.0)})
    plain = M.linear_fit(rows, "margin", ["a", "b"])
    odd = M.linear_fit(df, "margin", ["a", "b", "a2", "one"])
    gap = odd.predict(df).select(F.abs(F.col("pred") - plain.column()).alias("d")).agg(F.max("d")).first()[0]
    assert gap < 1e-8


def test_fits_without_folds_equal_separate_fits(rows):
    df = kfold(rows, ["id"], 5, 4)
    for f, model in M.linear_fit_without_folds(df, "margin", ["a", "b"]).items():
        alone = M.linear_fit(df.where(F.col("fold") != f), "margin", ["a", "b"])
        assert model.coef == pytest.approx(alone.coef, rel=1e-9) and model.n == alone.n
        assert model.sigma == pytest.approx(alone.sigma, rel=1e-9)


def _basis(rows, knots=3):
    s = X.find_smooths(rows, ["a", "b"], knots)
    return [*X.spline_basis(s["a"]), *X.spline_basis(s["b"])]


def test_unpenalised_fit_equals_spark_glr(rows):
    basis = _basis(rows, 2)
    model = M.binomial_smooth_fit(rows, "share", basis)
    cols = X.basis_columns(rows, basis, ["share"])
    vec = VectorAssembler(inputCols=[c for c in cols.columns if c != "share"], outputCol="x").transform(cols)
    glr = GeneralizedLinearRegression(
        family="binomial", link="logit", featuresCol="x", labelCol="share", maxIter=50, tol=1e-12
    ).fit(vec)
    assert model.beta[1:] == pytest.approx(np.array(glr.coefficients), rel=1e-6, abs=1e-8)
    assert model.beta[0] == pytest.approx(glr.intercept, rel=1e-6)
    se = np.sqrt(np.diag(model.cov))
    want = glr.summary.coefficientStandardErrors
    assert np.append(se[1:], se[0]) == pytest.approx(np.array(want), rel=1e-5)
    quasi = M.quasibinomial_smooth_fit(rows, "share", basis)
    phi = glr.summary.dispersion * 0 + float(
        glr.summary.residuals("pearson").select(F.sum(F.col("pearsonResiduals") ** 2)).first()[0]
    ) / (2_000 - len(basis) - 1)
    assert quasi.dispersion == pytest.approx(phi, rel=1e-6)
    assert quasi.cov == pytest.approx(model.cov * quasi.dispersion, rel=1e-9)


def _rmse(model, df):
    return model.predict(df).agg(F.sqrt(F.avg((F.col("share") - F.col("pred")) ** 2))).first()[0]


def test_smoothing_helps_on_unseen_rows(rows):
    train, test = rows.where("id % 25 = 0"), rows.where("id % 25 <> 0")
    basis = _basis(train, 5)
    free = M.binomial_smooth_fit(train, "share", basis)
    search = M.grid_search(kfold(train, ["id"], 2), "share", basis, grid=[0.01, 0.1, 1.0, 10.0])
    best = best_candidate(search, "rmse", "candidate").first()
    smooth = M.binomial_smooth_fit(train, "share", basis, best["smoothing"])
    assert best["folds"] == 10 and 0 < best["rmse"] < 0.5
    assert _rmse(smooth, test) <= _rmse(free, test)
    assert smooth.edf < free.edf == pytest.approx(len(basis) + 1, abs=1e-3)


def test_grid_search_equals_fits_without_each_fold(rows):
    """With one Newton step from the common fit the result is close to full refits."""
    df = kfold(rows, ["id"], 5, 4)
    basis = _basis(rows, 2)
    got = M.grid_search(df, "share", basis, folds=4, grid=[1.0]).first()["rmse"]
    parts = []
    for f in range(1, 5):
        model = M.binomial_smooth_fit(df.where(F.col("fold") != f), "share", basis, 1.0)
        parts.append(_rmse(model, df.where(F.col("fold") == f)))
    assert got == pytest.approx(np.mean(parts), rel=1e-4)


def test_random_effects_shrink(rows):
    levels = X.find_levels(rows, "team")
    basis = X.random_effect("team", levels)
    loose = M.binomial_smooth_fit(rows, "share", basis, {"re(team)": 0.1})
    tight = M.binomial_smooth_fit(rows, "share", basis, {"re(team)": 500.0})
    assert np.abs(tight.beta[1:]).max() < np.abs(loose.beta[1:]).max()
    assert int(np.argmax(loose.beta[1:])) == levels.index("t1")
    unknown = rows.limit(1).withColumn("team", F.lit("new"))
    p = loose.predict(unknown).first()["pred"]
    assert p == pytest.approx(1 / (1 + np.exp(-loose.beta[0])))


def test_interval_holds_the_prediction(rows):
    model = M.quasibinomial_smooth_fit(rows, "share", _basis(rows), 1.0)
    scored = model.predict_with_se(model.predict(rows, "again"))
    ok = (
        (F.col("std_error") > 0) & (F.col("pred") > 0) & (F.col("pred") < 1)
        & (F.col("pred_lower") < F.col("pred")) & (F.col("pred") < F.col("pred_upper"))
        & (F.abs(F.col("pred") - F.col("again")) < 1e-12)
    )
    assert scored.where(~ok).count() == 0
    missing = rows.limit(2).withColumn("a", F.lit(None).cast("double"))
    assert [r["pred"] for r in model.predict_with_se(missing).collect()] == [None, None]


def test_fit_does_not_depend_on_layout(rows):
    basis = _basis(rows)
    a = M.binomial_smooth_fit(rows.repartition(2), "share", basis, 1.0)
    b = M.binomial_smooth_fit(rows.repartition(13), "share", basis, 1.0)
    assert a.beta == pytest.approx(b.beta, rel=1e-7, abs=1e-9)


def test_models_survive_storage(spark, rows, tmp_path):
    line = M.linear_fit(rows, "margin", ["a", "b"])
    src.model_write(spark, line, str(tmp_path / "line"))
    assert src.model_read(spark, str(tmp_path / "line")) == line
    smooth = M.quasibinomial_smooth_fit(rows, "share", _basis(rows), 1.0)
    src.model_write(spark, smooth, str(tmp_path / "smooth"))
    back = src.model_read(spark, str(tmp_path / "smooth"))
    a = smooth.predict_with_se(rows).agg(F.sum("pred"), F.sum("std_error")).first()
    b = back.predict_with_se(rows).agg(F.sum("pred"), F.sum("std_error")).first()
    assert tuple(a) == tuple(b)


def test_too_wide_a_model_is_refused(rows):
    with pytest.raises(ValueError, match="at most"):
        M.smooth_fit(rows, "share", [X.Basis(f"c{i}", (X.Part("a"),)) for i in range(M.MAX_COLUMNS)])


def test_wide_linear_models_are_refused_and_never_read_in_part(spark, rows, monkeypatch):
    with pytest.raises(ValueError, match="at most"):
        M.linear_fit(rows.withColumns({f"c{i}": F.col("a") for i in range(450)}), "margin", [f"c{i}" for i in range(450)])
    wide = M.LinearModel("margin", tuple(f"c{i}" for i in range(450)), 0.0, (1.0,) * 450, 1.0, 9)
    with pytest.raises(ValueError, match="stored model"):
        M.LinearModel.from_frame(wide.to_frame(spark))
    most = M.LinearModel("margin", tuple(f"c{i}" for i in range(400)), 0.0, (1.0,) * 400, 1.0, 9)
    assert M.LinearModel.from_frame(most.to_frame(spark)) == most


def test_grid_search_takes_every_fold(rows):
    folded = kfold(rows, ["id"], 3, 20)
    line = [X.Basis("a", (X.Part("a"),), "a")]
    table = M.grid_search(folded, "share", line, grid=[1.0]).collect()
    assert [r["folds"] for r in table] == [20]
    shifted = M.grid_search(folded.withColumn("fold", F.col("fold") * 3 - 100), "share", line, grid=[1.0]).collect()
    assert table == shifted
    with pytest.raises(ValueError, match="other than"):
        M.grid_search(folded, "share", line, folds=10, grid=[1.0])
    with pytest.raises(ValueError, match="none missing"):
        M.grid_search(folded.withColumn("fold", F.when(F.col("fold") > 1, F.col("fold"))), "share", line, grid=[1.0])


def test_a_fit_that_does_not_settle_is_told(spark, rows):
    line = [X.Basis("a", (X.Part("a"),))]
    apart = spark.createDataFrame([(float(i), float(i > 0)) for i in range(-20, 21)], "a double, share double")
    with pytest.raises(M.NotConverged):
        M.smooth_fit(apart, "share", line, max_steps=8)
    open_ = M.smooth_fit(rows, "share", line, max_steps=1, must_converge=False)
    assert not open_.converged and not M.SmoothModel.from_frame(open_.to_frame(spark)).converged
    assert M.smooth_fit(rows, "share", line).converged


def test_folds_do_not_depend_on_the_split(spark):
    from gridtally.operators.splits import random_split

    both = kfold(random_split(spark.range(40_000), ["id"], 13), ["id"], 13).where("split = 'train'")
    counts = [r["count"] for r in both.groupBy("fold").count().collect()]
    assert len(counts) == 10 and max(counts) - min(counts) < 6 * 3_000**0.5


def test_strength_factors_are_all_there_or_an_error(spark):
    columns = [*T.STRENGTH_SMOOTHS, "week"]
    values = [(unit_hash("id", seed=k) % 1000 / 10).alias(c) for k, c in enumerate(columns) if c not in ("week", "game_num")]
    df = spark.range(800).select("id", *values, (F.col("id") % 17).alias("week"), (F.col("id") % 23).alias("game_num"))
    names = [b.name for b in T.strength_basis(df, 2)]
    assert sum(n.startswith("game_num[") for n in names) == 23 - (sum(n.startswith("week[") for n in names) == 16)
    with pytest.raises(ValueError):
        T.strength_basis(df.withColumn("game_num", F.col("id") % 40), 2)


def test_whole_training_and_scoring_path(spark, data):
    games = fx.games(spark, data)
    final = H.season_final_table(games, codes={})
    inputs = P.preseason_inputs(final, fx.ratings(spark, data), codes={}).persist()
    first, search, split = T.fit_preseason_model(inputs, n_knots=2, folds=3, grid=[0.1, 1.0, 10.0])
    assert search.count() == 3
    assert {r[0] for r in split.select("split").distinct().collect()} == {"train", "test"}
    history = H.team_game_history(games, codes={}).persist()
    second, rows = T.fit_strength_model(
        T.strength_inputs(history, inputs, first), n_knots=2, factors=["week"],
        first_season=1996, new_team="NATION_3", new_team_last_season=1997,
    )
    assert rows.where("season < 1996 or (team = 'NATION_3' and season <= 1997)").count() == 0
    assert rows.groupBy("id").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    assert second.dispersion > 0

    before = T.strength_table(inputs, first)
    now = T.strength_table(inputs, first, T.current_state(games, 2000, 8), second)
    assert before.columns == now.columns
    strengths = [r["estimated_strength"] for r in now.collect() if r["estimated_strength"] is not None]
    assert strengths == sorted(strengths, reverse=True) and all(0 < s < 1 for s in strengths)
    ratio = F.abs(F.col("alpha") / (F.col("alpha") + F.col("beta")) - F.col("estimated_strength"))
    assert now.where(F.col("alpha").isNotNull() & (ratio > 1e-9)).count() == 0

    rated = second.predict(T.strength_inputs(history, inputs, first), "estimated_strength").where("initial_rating is not null")
    compared = G.game_comparison(T.pregame_strengths(rated)).where("result is not null and strength_diff is not null")
    margin = G.fit_margin_model(compared, folds=3)
    assert margin.model.sigma > 0 and margin.resamples.count() == 3
    inputs.unpersist()
    history.unpersist()


def _ties(spark):
    """Games of five team-seasons, one without a team, and 0 to 40 ratings of each; some values are missing."""
    u = lambda k: unit_hash("id", seed=k) % 10_000 / 1_000
    team = F.when(F.col("id") % 5 > 0, F.concat(F.lit("t"), F.col("id") % 5))
    keys = [F.lit(2000).alias("season"), team.alias("team")]
    names = [c for c in T.STRENGTH_SMOOTHS if c not in ("game_num", "initial_rating")]
    values = [F.when(F.col("id") % 97 != k, u(k)).alias(c) for k, c in enumerate(names)]
    wins = (F.floor(u(30)) / 10 + F.col("id") % 5 / 20).cast("double").alias("final_wp")
    games = spark.range(400).select(*keys, wins, *values, (F.col("id") % 7).alias("week"), (F.col("id") % 11).alias("game_num"))
    rated = spark.range(90).where("id % 5 > 1 or id < 60").where("id % 5 <> 3").select(*keys, F.when(F.col("id") % 31 > 0, u(40) / 10).alias("initial_rating"))
    return games, rated.unionByName(spark.createDataFrame([(2001, "t1", 0.5)], rated.schema))


def test_fit_on_ties_equals_the_fit_on_their_joined_rows(spark, monkeypatch):
    games, rated = (settle(df) for df in _ties(spark))
    joined = games.join(rated, games.season.eqNullSafe(rated.season) & games.team.eqNullSafe(rated.team), "left")
    joined = joined.drop(rated.season, rated.team)
    wanted = T.strength_model(joined, n_knots=1, factors=["week"])
    monkeypatch.setattr(M, "BLOCK_ROWS", 30)
    monkeypatch.setattr(M, "CELLS", 200)
    keys = ["season", "team"]
    counts, rows = M.pair_counts(games, rated, keys)
    assert rows == joined.count() > 10 * 400
    same = M.joined_smooth_fit(games, rated, keys, counts, "final_wp", wanted.basis, select=0.1, smoothing=1.0, quasi=True)
    assert (same.n, same.steps, same.basis) == (wanted.n, wanted.steps, wanted.basis)
    assert (same.deviance, same.dispersion, same.edf) == pytest.approx((wanted.deviance, wanted.dispersion, wanted.edf), rel=1e-8)
    assert same.beta == pytest.approx(wanted.beta, rel=1e-6, abs=1e-8)
    assert np.allclose(same.cov, wanted.cov, rtol=1e-6, atol=1e-10)
    # Its own knots are exact, those of the joined rows approximate.
    own = T.strength_model(games, n_knots=1, factors=["week"], rated=rated, hot_rows=0)
    assert (own.n, [b.name for b in own.basis]) == (wanted.n, [b.name for b in wanted.basis])
    assert own.deviance == pytest.approx(wanted.deviance, rel=1e-4)


def _some_sides():
    smooths = {n: X.Smooth(n, 0.0, 1.0, (-0.5, 0.6)) for n in ("own", "game_num", "initial_rating")}
    basis = [b for s in smooths.values() for b in X.spline_basis(s)]
    basis += X.tensor_interaction(smooths["initial_rating"], smooths["game_num"]) + X.factor_basis("week", [1, 2, 3])
    return M._Sides.of(basis, {"initial_rating"}), basis


def test_joined_step_does_not_weigh_all_pairs(monkeypatch):
    """A step over 20,000 x 400 rows that share five game numbers takes sums at places of its own, and they are those of all pairs."""
    draw = np.random.default_rng(3)
    sides, basis = _some_sides()
    assert sides.left.numbers == ("own", "game_num") and len(sides.own) > 4
    n = 20_000
    left = np.column_stack([draw.uniform(0, 1, n).round(1), draw.normal(size=n), draw.integers(0, 5, n) - 2.0, draw.integers(1, 4, n)])
    left[:30, 1] *= 20  # linear predictors beyond the bound, which are clipped
    left[30:60, 2] = draw.normal(size=30)  # and numbers of games that no other row has
    right, beta = draw.normal(size=(400, 1)), draw.normal(size=len(basis) + 1) * 0.1
    weighed, sums = [], M._sums_over_right

    def counted(weights, *rest):
        weighed.append(len(weights))
        return sums(weights, *rest)

    monkeypatch.setattr(M, "_sums_over_right", counted)
    found = M._joined_working(sides, beta)()([(left, right)])
    assert 60 <= sum(weighed) < n / 4
    weighed.clear()
    monkeypatch.setattr(M, "NODES", 10**9)
    wanted = M._joined_working(sides, beta)()([(left, right)])
    assert sum(weighed) == n
    assert found[-1] == wanted[-1] == n * 400
    assert np.allclose(found[:-3], wanted[:-3], rtol=1e-9, atol=1e-11 * np.abs(wanted[:-3]).max())
    assert found[-3:] == pytest.approx(wanted[-3:], rel=1e-11)
    # The same sums from rows of model columns.
    left = left[60:110]
    rows = np.column_stack([np.repeat(left, 400, axis=0), np.tile(right, (50, 1))])
    monkeypatch.undo()
    packing = X.Packing.of(basis)
    order = [("y", "own", "game_num", "week", "initial_rating").index(c) for c in ("y", *packing.numbers, *packing.labels)]
    plain = M._working(packing.design(), beta)()(rows[:, order])
    assert np.allclose(M._joined_working(sides, beta)()([(left, right)]), plain, rtol=1e-9, atol=1e-11 * np.abs(plain).max())


def test_strengths_of_ties_equal_those_of_their_joined_rows(spark, monkeypatch):
    games, rated = (settle(df) for df in _ties(spark))
    second = T.strength_model(games, n_knots=1, factors=["week"], rated=rated)
    keys = ["season", "team"]
    counts, n = M.pair_counts(games, rated, keys)
    wanted = second.predict_with_se(M.attach(games, rated, keys)).select(*keys, "pred", "std_error")
    monkeypatch.setattr(M, "BLOCK_ROWS", 30)
    monkeypatch.setattr(M, "OPEN_ROWS", 17)
    monkeypatch.setattr(M, "CELLS", 200)
    found = M.joined_predict_with_se(second, games, rated, keys, counts)
    assert found.schema.simpleString() == wanted.schema.simpleString()
    order = [F.col(c).asc_nulls_first() for c in (*keys, "pred", "std_error")]
    found, wanted = (df.orderBy(*order).collect() for df in (found, wanted))
    assert len(found) == len(wanted) == n and any(r["pred"] is None for r in found) and any(r["team"] is None for r in found)
    for a, b in zip(found, wanted):
        assert tuple(a)[:2] == tuple(b)[:2]
        assert tuple(a)[2:] == (None, None) if b["pred"] is None else tuple(a)[2:] == pytest.approx(tuple(b)[2:], rel=1e-7)


def test_strength_table_is_the_same_above_hot_rows(spark):
    inputs = spark.createDataFrame(
        [(2000, t, 0.4 + 0.01 * k, 1300.0 + 40.0 * k + 7.0 * i, 0.35 + 0.05 * k) for i, t in enumerate("abcd") for k in range(6)],
        "season int, team string, prev_season_wp double, elo double, final_wp double",
    )
    first = M.binomial_smooth_fit(inputs, "final_wp", [X.Basis("elo", (X.Part("elo", 1400.0, 100.0),))], 1.0)
    games, rated = _ties(spark)
    second = T.strength_model(games, n_knots=1, factors=["week"], rated=rated)
    state = games.where("team is null or team <> 't4'").withColumn("team", F.translate("team", "t123", "abc"))
    few, many = (T.strength_table(inputs, first, state, second, hot_rows=n).collect() for n in (5_000_000, 0))
    assert len(few) == len(many) > 400 and few[0].asDict().keys() == many[0].asDict().keys()
    shown = lambda r: [-1.0 if r[c] is None else r[c] for c in ("season", "team", "elo", "estimated_strength", "alpha", "beta")]
    strengths = [r["estimated_strength"] for r in many if r["estimated_strength"] is not None]
    assert strengths == sorted(strengths, reverse=True) and all(r["estimated_strength"] is None for r in many[len(strengths) :])
    place = lambda r: [str(r["team"]), shown(r)[3]]
    for a, b in zip(sorted(few, key=place), sorted(many, key=place)):
        assert shown(a)[:3] == shown(b)[:3] and shown(a)[3:] == pytest.approx(shown(b)[3:], rel=1e-6)


def test_weighted_smooths_are_those_of_repeated_rows(spark):
    rows = spark.range(300).select((unit_hash("id", seed=3) % 1000 / 7).alias("a"), (F.col("id") % 9).alias("b"), (F.col("id") % 4).alias("times"))
    repeated = rows.where("times > 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    found, wanted = M.weighted_smooths(rows, ["a", "b"], "times", 4), X.find_smooths(repeated, ["a", "b"], 4)
    for n in ("a", "b"):
        assert (found[n].center, found[n].scale) == pytest.approx((wanted[n].center, wanted[n].scale), rel=1e-12)
        assert found[n].knots == pytest.approx(wanted[n].knots, abs=2e-6)
