"""Models: scaler, saved bundle, defaults, row bound, trees."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barwright.config import DEFAULT
from barwright.operators import features as FE
from barwright.operators import model as M

FEATS = ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    n = 120
    parts = []
    for symbol, shift in (("X", 3.0), ("Y", -50.0)):
        a, b = rng.normal(shift, 2.0, n), rng.normal(0.0, 1.0, n)
        up = (a - shift + rng.normal(0, 1.0, n) > 0).astype(int)
        parts.append(pd.DataFrame({"symbol": symbol, "ts": np.arange(n), "a": a, "b": b, "target": up,
                                   "n_clean": n, "is_train": np.arange(n) < 96}))
    return spark.createDataFrame(pd.concat(parts))


def test_scaler_matches_numpy(rows):
    got = {r["symbol"]: r for r in FE.fit_scaler(rows, FEATS).collect()}
    pdf = rows.where("is_train").toPandas()
    for symbol, part in pdf.groupby("symbol"):
        assert np.allclose(got[symbol]["means"], part[FEATS].mean())
        assert np.allclose(got[symbol]["stds"], part[FEATS].std(ddof=0))


def test_constant_feature_scales_to_zero(rows):
    flat = rows.withColumn("a", F.lit(5.0))
    out = FE.transform(flat, FE.fit_scaler(flat, FEATS), FEATS)
    assert out.where("a <> 0").count() == 0


def test_saved_model_scores_new_rows_as_the_fitted_one(spark, rows, tmp_path):
    scaler = FE.fit_scaler(rows, FEATS)
    coefs = M.fit_logistic(FE.transform(rows, scaler, FEATS), features=FEATS)
    M.save(M.bundle(coefs, scaler, FEATS), str(tmp_path / "m"))
    new = rows.where("symbol = 'X'").select("symbol", "ts", "a", "b").limit(3)
    got = {r["ts"]: r["probability"] for r in M.score_with(new, M.load(spark, str(tmp_path / "m"))).collect()}
    want = M.score(FE.transform(rows, scaler, FEATS), coefs, features=FEATS).where("symbol = 'X'")
    want = {r["ts"]: r["probability"] for r in want.collect()}
    assert len(got) == 3 and all(abs(p - want[t]) < 1e-12 for t, p in got.items())


def test_saved_model_without_symbols_is_an_error(spark, rows, tmp_path):
    none = rows.where("false")
    scaler = FE.fit_scaler(none, FEATS)
    M.save(M.bundle(M.fit_logistic(FE.transform(none, scaler, FEATS), features=FEATS), scaler, FEATS), str(tmp_path / "m"))
    with pytest.raises(ValueError):
        M.score_with(rows, M.load(spark, str(tmp_path / "m")))


def test_symbols_without_model_get_defaults(spark, rows):
    scaled = FE.transform(rows, FE.fit_scaler(rows, FEATS), FEATS)
    last = M.latest(M.score(scaled, M.fit_logistic(scaled, features=FEATS), features=FEATS))
    asked = spark.createDataFrame([("X",), ("Z",), ("Z",)], "symbol string")
    got = {r["symbol"]: r for r in M.for_all(asked, last).collect()}
    assert set(got) == {"X", "Z"}
    assert (got["Z"]["latest_prediction"], got["Z"]["confidence"], got["Z"]["ts"]) == (0, 0.5, None)
    assert got["X"]["ts"] == 119 and got["X"]["confidence"] >= 0.5


def test_fit_reads_a_bounded_sample_of_a_long_symbol(rows):
    scaled = FE.transform(rows, FE.fit_scaler(rows, FEATS), FEATS)
    few = M.fit_logistic(scaled, replace(DEFAULT.ml, max_fit_rows=60), FEATS)
    assert all(20 <= r["n_train"] <= 80 for r in few.collect())
    assert {r["n_train"] for r in M.fit_logistic(scaled, features=FEATS).collect()} == {96}


def test_trees_find_the_feature_that_matters(spark, rows):
    scaled = FE.transform(rows, FE.fit_scaler(rows, FEATS), FEATS)
    for kind in ("decision_tree", "random_forest"):
        tree = M.fit_trees(scaled, FEATS, kind, replace(DEFAULT.ml, forest_trees=5))
        got = M.importance(tree, spark, FEATS).collect()
        assert [r["rank"] for r in got] == [1, 2] and got[0]["feature"] == "a"
    with pytest.raises(ValueError):
        M.fit_trees(scaled, FEATS, "boosted")
