"""Per-symbol trees and forests against brute force; Newton by sums against Newton on the rows."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barwright.config import DEFAULT
from barwright.operators import model as M
from barwright.operators import trees as TR

FEATS = ["a", "b", "c"]
ML = replace(DEFAULT.ml, tree_depth=4, forest_trees=9)


def table(symbol, n, seed, one_class=False):
    rng = np.random.default_rng(seed)
    a, b, c = rng.normal(0, 1, n), rng.integers(0, 4, n).astype(float), rng.normal(0, 1, n)
    y = ((a > 0.3) ^ (b >= 2) ^ (rng.random(n) < 0.15)).astype(int)
    return pd.DataFrame({"symbol": symbol, "ts": np.arange(n), "a": a, "b": b, "c": c, "target": 0 * y + 1 if one_class else y,
                         "is_train": np.arange(n) < n - 20, "n_clean": n})


@pytest.fixture(scope="module")
def rows(spark):
    pdf = pd.concat([table("X", 150, 1), table("Y", 120, 2), table("FEW", 35, 3), table("ONE", 60, 4, True)])
    return spark.createDataFrame(pdf).repartition(5).cache(), pdf


def gini_sum(y):
    n = len(y)
    return (np.sum(y == 0) ** 2 + np.sum(y == 1) ** 2) / n


def brute_tree(x, y, depth=0, node=0):
    """node -> (n0, n1, feature, threshold): the exact best cut over all values, ties to the first feature and lowest value."""
    out = {node: (int((y == 0).sum()), int((y == 1).sum()), -1, None)}
    if depth == ML.tree_depth or len(y) < ML.tree_min_split or len(set(y)) == 1:
        return out
    best = None
    for f in range(x.shape[1]):
        for v in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= v
            if min(left.sum(), (~left).sum()) < ML.tree_min_leaf:
                continue
            kept = round(gini_sum(y[left]) + gini_sum(y[~left]), 9)
            if best is None or kept > best[0]:
                best = (kept, f, v)
    if best is None:
        return out
    left = x[:, best[1]] <= best[2]
    out[node] = (*out[node][:2], best[1], best[2])
    return out | brute_tree(x[left], y[left], depth + 1, 2 * node + 1) | brute_tree(x[~left], y[~left], depth + 1, 2 * node + 2)


@pytest.fixture(scope="module")
def tree(rows):
    nodes, cuts = TR.fit_symbol_trees(rows[0], FEATS, ML, max_bins=256, salts=3)
    return nodes, cuts


def test_trees_are_brute_force(rows, tree):
    nodes, cuts = tree
    edges = {r["symbol"]: r["edges"] for r in cuts.collect()}
    got = {}
    for r in nodes.collect():
        threshold = edges[r["symbol"]][r["feature"]][r["bin"]] if r["feature"] >= 0 else None
        got.setdefault(r["symbol"], {})[r["node"]] = (int(r["n0"]), int(r["n1"]), r["feature"], threshold)
    for symbol, part in rows[1].groupby("symbol"):
        train = part[part["is_train"]]
        assert got[symbol] == brute_tree(train[FEATS].to_numpy(), train["target"].to_numpy()), symbol
    assert len(got["X"]) > 5 and len(got["ONE"]) == 1 and len(got["FEW"]) == 1


def test_scores_are_the_leaf_shares(rows, tree):
    got = {(r["symbol"], r["ts"]): r["probability"] for r in TR.score_symbol_trees(rows[0], *tree, FEATS, ML, salts=3).collect()}
    assert len(got) == len(rows[1])
    for symbol, part in rows[1].groupby("symbol"):
        train = part[part["is_train"]]
        brute = brute_tree(train[FEATS].to_numpy(), train["target"].to_numpy())
        for r in part.itertuples():
            node = 0
            while brute[node][2] >= 0:
                node = 2 * node + 1 + (getattr(r, FEATS[brute[node][2]]) > brute[node][3])
            assert got[symbol, r.ts] == pytest.approx(brute[node][1] / (brute[node][0] + brute[node][1]))


def test_importances_are_shares_of_one(rows, tree):
    out = TR.symbol_importance(tree[0], FEATS, ML).toPandas()
    total = out.groupby("symbol")["importance"].sum()
    assert np.allclose(total[["X", "Y"]], 1.0) and (total[["ONE", "FEW"]] == 0).all()
    x = out[out["symbol"] == "X"].set_index("feature")["importance"]
    assert len(x) == 3 and x["c"] < x["a"] and x["c"] < x["b"]


def test_forest_beats_a_coin_and_repeats(rows):
    nodes, cuts = TR.fit_symbol_trees(rows[0], FEATS, ML, forest=True, salts=2)
    again, _ = TR.fit_symbol_trees(rows[0].repartition(2), FEATS, ML, forest=True, salts=5)
    key = lambda df: sorted(map(repr, df.drop("decrease").collect()))
    assert key(nodes) == key(again)  # the same trees however the rows are dealt
    assert nodes.select("symbol", "tree").distinct().count() == 4 * ML.forest_trees
    scored = TR.score_symbol_trees(rows[0], nodes, cuts, FEATS, ML, keep=("target", "is_train"))
    right = scored.where("symbol in ('X', 'Y') and is_train").agg(F.avg((F.col("target") == F.col("prediction")).cast("int"))).first()[0]
    assert right > 0.75
    assert np.allclose(TR.symbol_importance(nodes, FEATS, ML).where("symbol = 'X'").agg(F.sum("importance")).first()[0], 1.0)


def test_bins_bound_the_cuts(rows):
    cuts = TR.edges(rows[0].where("is_train"), FEATS, 8).collect()
    assert all(len(e) <= 7 and e == sorted(set(e)) for r in cuts for e in r["edges"])


def test_no_rows(spark, rows):
    nodes, cuts = TR.fit_symbol_trees(rows[0].where("false"), FEATS, ML)
    assert nodes.count() == 0 and cuts.count() == 0
    assert TR.score_symbol_trees(rows[0], nodes, cuts, FEATS, ML).count() == 0
    assert M.fit_logistic_sums(rows[0].where("false"), features=FEATS).count() == 0


def test_newton_by_sums_is_newton_on_the_rows(rows):
    want = {r["symbol"]: (r["intercept"], *r["coef"]) for r in M.fit_logistic(rows[0], features=FEATS).collect()}
    out = M.fit_logistic_sums(rows[0], features=FEATS).collect()
    assert {r["symbol"] for r in out} == set(want)
    for r in out:
        assert np.allclose((r["intercept"], *r["coef"]), want[r["symbol"]], rtol=0, atol=1e-8), r["symbol"]
    assert {r["symbol"]: r["n_train"] for r in out} == {"X": 130, "Y": 100, "FEW": 15, "ONE": 40}
