"""The training chain: out-of-fold models, evaluation, scoring."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridtally.functions.scalars import unit_hash
from gridtally.operators import features as X
from gridtally.operators import fit as M
from gridtally.operators.splits import kfold
from gridtally.plans import training as E

LINE = [X.Basis("a", (X.Part("a", 0.5, 0.3),), "s(a)")]


@pytest.fixture(scope="module")
def rows(spark):
    u = [(unit_hash("id", seed=s) + 0.5) / 2**32 for s in range(3)]
    share = F.floor((1 / (1 + F.exp(-(u[0] * 3 - 1.5))) * 0.6 + u[1] * 0.4) * 8) / 8
    df = spark.range(600).select("id", u[0].alias("a"), share.alias("share"))
    return kfold(df, ["id"], 5, 4).cache()


def test_out_of_fold_models_are_close_to_separate_fits(rows):
    models = M.smooth_fit_without_folds(rows, "share", LINE, "fold", 2.0)
    assert models.named == (1.0, 2.0, 3.0, 4.0)
    whole = M.smooth_fit(rows, "share", LINE, 2.0)
    for f, beta in list(zip(models.named, models.betas))[:2]:
        alone = M.smooth_fit(rows.where(F.col("fold") != f), "share", LINE, 2.0)
        assert np.abs(beta - alone.beta).max() < 0.05 * np.abs(whole.beta - alone.beta).max() + 1e-9
    scored = models.predict(rows).collect()
    for r in scored[:50]:
        beta = models.betas[models.named.index(r.fold)]
        assert r.pred == pytest.approx(1 / (1 + np.exp(-(beta[0] + beta[1] * (r.a - 0.5) / 0.3))))


def test_out_of_fold_scores_of_missing_values(rows):
    models = M.smooth_fit_without_folds(rows, "share", LINE, "fold", 2.0)
    odd = rows.limit(1).select("id", F.explode(F.array(F.lit(None).cast("int"), F.lit(9), F.lit(1))).alias("fold"), "a")
    got = {r.fold: r.pred for r in models.predict(odd).collect()}
    assert got[None] is None and got[9] is None and 0 < got[1] < 1
    no_value = rows.limit(1).withColumn("a", F.lit(None).cast("double"))
    assert models.predict(no_value).first().pred is None
    assert models.predict(rows.limit(0)).count() == 0
    with pytest.raises(ValueError, match="one value"):
        M.smooth_fit_without_folds(rows.withColumn("fold", F.lit(1)), "share", LINE)
    with pytest.raises(ValueError, match="none missing"):
        M.smooth_fit_without_folds(rows.withColumn("fold", F.when(F.col("id") > 3, 1)), "share", LINE)


def test_a_changed_row_does_not_change_its_own_score(spark, rows):
    """Up to second order: the score of a row by the others' model moves far less than the fit of all."""
    changed = rows.withColumn("share", F.when(F.col("id") == 7, F.lit(1.0)).otherwise(F.col("share")))
    score = lambda df: M.smooth_fit_without_folds(df, "share", LINE, "fold", 2.0).predict(df).where("id = 7").first().pred
    whole = lambda df: M.smooth_fit(df, "share", LINE, 2.0).predict(df).where("id = 7").first().pred
    assert abs(score(changed) - score(rows)) < 0.1 * abs(whole(changed) - whole(rows))


def test_evaluation_by_side_and_week(spark):
    model = M.SmoothModel("final_wp", tuple(LINE), np.array([0.0, 0.0]), np.eye(2), 1.0, 2.0, 0.0, 4, 1)
    pre = spark.createDataFrame(
        [(2020, "x", 0.5, 0.7, "train"), (2021, "x", 0.5, 0.9, "test"), (2021, "y", 0.5, 0.3, "test")],
        "season int, team string, a double, final_wp double, split string",
    )
    first = E.evaluate_preseason(model, pre)
    got = {(r.season, r.team): (r.tot_wins, r.exp_wins) for r in first.rows.collect()}
    assert got[2020, "x"][1] == pytest.approx(8.0) and got[2021, "x"] == (pytest.approx(15.3), pytest.approx(8.5))
    assert {r.metric: r.estimate for r in first.side("train").collect()}["mae"] == pytest.approx(0.2)
    now = spark.createDataFrame(
        [("i", 2020, w, "x", 0.5, 0.5 + w / 10, 8.0, s) for w, s in ((1, "test"), (2, "test"), (3, "train"))],
        "id string, season int, week int, team string, a double, final_wp double, reg_wins double, split string",
    )
    weekly = E.held_out_rmse_by_week(first, E.evaluate_strength(model, now)).collect()
    assert [r.week for r in weekly] == [2, 1, 0]
    assert [r.estimate for r in weekly] == pytest.approx([0.2, 0.1, np.sqrt((0.16 + 0.04) / 2)])
