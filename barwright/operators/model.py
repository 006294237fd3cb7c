"""Next-bar direction models: fit, predict, evaluate, persist.

Model: L2-regularised logistic regression (C = 1, intercept not penalised)
on standardised features, one model per symbol.  The optimum is unique, so a
Newton solve gives the same coefficients any exact solver would.

The fit is the only Python step: ``groupBy(symbol).applyInPandas`` hands one
symbol's training rows (at most about ``max_fit_rows``, 33 doubles each) to a
numpy Newton solver, or ``fit_logistic_sums`` adds up each step's gradient and
Hessian over all rows of symbols of any size.  Scoring, the "latest" row and every metric are JVM
expressions and aggregates over the coefficient table joined by symbol.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, MLParams
from ..functions.materialize import materialize
from ..functions.windows import SYMBOL, TS
from .features import feature_columns, transform

COEF_SCHEMA = "symbol string, intercept double, coef array<double>, n_train long, iterations int"


def _newton(X: np.ndarray, y: np.ndarray, l2: float, max_iter: int) -> tuple[np.ndarray, int]:
    n, d = X.shape
    A = np.hstack([np.ones((n, 1)), X])
    w = np.zeros(d + 1)
    reg = np.full(d + 1, l2)
    reg[0] = 0.0
    it = 0
    for it in range(1, max_iter + 1):
        z = A @ w
        p = 1.0 / (1.0 + np.exp(-z))
        g = A.T @ (p - y) + reg * w
        H = (A * (p * (1 - p))[:, None]).T @ A + np.diag(reg)
        step = np.linalg.solve(H + 1e-12 * np.eye(d + 1), g)
        w = w - step
        if np.max(np.abs(step)) < 1e-10:
            break
    return w, it


def fit_logistic(scaled: DataFrame, ml: MLParams = DEFAULT.ml, features: list[str] | None = None,
                 target: str = "target") -> DataFrame:
    """Coefficients per symbol from the training rows of a scaled feature table.

    A symbol of more than ``ml.max_fit_rows`` clean rows (``n_clean``) is fitted on a hashed sample of about
    that many, so that a task's group is bounded; every row is scored.
    """
    feats = features or feature_columns(ml.max_lag)
    l2, max_iter = ml.l2, ml.max_iter

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        X = pdf[feats].to_numpy(dtype=float)
        y = pdf[target].to_numpy(dtype=float)
        if len(np.unique(y)) < 2:  # one class only: constant model
            w = np.zeros(len(feats) + 1)
            w[0] = 40.0 if y.size and y[0] == 1 else -40.0
            it = 0
        else:
            w, it = _newton(X, y, l2, max_iter)
        return pd.DataFrame({
            "symbol": [pdf["symbol"].iloc[0]], "intercept": [float(w[0])], "coef": [w[1:].tolist()],
            "n_train": [len(pdf)], "iterations": [it],
        })

    chosen = F.pmod(F.xxhash64(SYMBOL, TS, F.lit(ml.seed)), F.col("n_clean")) < ml.max_fit_rows
    train = scaled.filter(F.col("is_train") & chosen).select(SYMBOL, *feats, target)
    return train.groupBy(SYMBOL).applyInPandas(fit, COEF_SCHEMA)


def fit_logistic_sums(scaled: DataFrame, ml: MLParams = DEFAULT.ml, features: list[str] | None = None, target: str = "target") -> DataFrame:
    """The same coefficients from all training rows, with no group of a symbol's rows anywhere.

    Each Newton step is one job: tasks turn the rows they read into one row of sums a symbol
    (gradient and upper half of the Hessian), the sums of a symbol are added as they stream by, and its
    small system is solved.  Symbols that have converged take no further part; the driver
    sees only how many have not.  A symbol may have any number of rows on any number of tasks.
    """
    feats = features or feature_columns(ml.max_lag)
    d = len(feats) + 1
    upper = np.triu_indices(d)
    rows = materialize(scaled.filter(F.col("is_train")).select(
        SYMBOL, F.array(F.lit(1.0), *[F.col(c).cast("double") for c in feats]).alias("x"), F.col(target).cast("double").alias("y")))
    counts = rows.groupBy(SYMBOL).agg(F.count(F.lit(1)).alias("n_train"), F.sum("y").alias("ones"))
    one_class = F.when(F.col("ones") == 0, -40.0).when(F.col("ones") == F.col("n_train"), 40.0)
    coefs = materialize(counts.select(
        SYMBOL, F.concat(F.array(F.coalesce(one_class, F.lit(0.0))), F.array_repeat(F.lit(0.0), d - 1)).alias("w"),
        "n_train", F.lit(0).alias("iterations"), one_class.isNotNull().alias("done")))

    def sums(batches):
        held: dict[str, list] = {}

        def out():
            names = list(held)
            table = {"symbol": names, "sums": [held[s][0] for s in names], "w": [held[s][1] for s in names]}
            held.clear()
            return pa.RecordBatch.from_pydict(table, schema=pa.schema([("symbol", pa.string()), ("sums", pa.list_(pa.float64())), ("w", pa.list_(pa.float64()))]))

        for batch in batches:
            symbols = np.array(batch.column("symbol").to_pylist(), dtype=object)
            x = batch.column("x").flatten().to_numpy().reshape(-1, d)
            y, w = batch.column("y").to_numpy(), batch.column("w").flatten().to_numpy().reshape(-1, d)
            order = np.argsort(symbols, kind="stable")
            cuts = np.flatnonzero(np.concatenate(([True], symbols[order][1:] != symbols[order][:-1]))) if len(order) else []
            for a, b in zip(cuts, [*cuts[1:], len(order)]):
                i = order[a:b]
                A, now = x[i], w[i[0]]
                p = 1.0 / (1.0 + np.exp(-(A @ now)))
                part = np.concatenate([A.T @ (p - y[i]), ((A * (p * (1 - p))[:, None]).T @ A)[upper]])
                name = symbols[i[0]]
                held[name] = [held[name][0] + part, now] if name in held else [part, now]
            if len(held) > 2000:
                yield out()
        if held:
            yield out()

    reg = np.full(d, ml.l2)
    reg[0] = 0.0

    def solved(name: str, total: np.ndarray, w: np.ndarray) -> dict:
        hessian = np.zeros((d, d))
        hessian[upper] = total[d:]
        hessian = hessian + np.triu(hessian, 1).T + np.diag(reg)
        step = np.linalg.solve(hessian + 1e-12 * np.eye(d), total[:d] + reg * w)
        return {"symbol": name, "w": w - step, "done": bool(np.max(np.abs(step)) < 1e-10)}

    def solve(batches):
        schema = pa.schema([("symbol", pa.string()), ("w", pa.list_(pa.float64())), ("done", pa.bool_())])
        name, total, w = None, None, None
        for batch in batches:
            out = []
            for s, part, now in zip(*[batch.column(c).to_pylist() for c in ("symbol", "sums", "w")]):
                if s != name:
                    if name is not None:
                        out.append(solved(name, total, w))
                    name, total, w = s, np.zeros(len(part)), np.array(now)
                total += np.array(part)
            yield pa.RecordBatch.from_pylist(out, schema)
        if name is not None:
            yield pa.RecordBatch.from_pylist([solved(name, total, w)], schema)

    for it in range(1, ml.max_iter + 1):
        active = coefs.where(~F.col("done")).select(SYMBOL, "w")
        if active.isEmpty():
            break
        parts = rows.join(active, SYMBOL).mapInArrow(sums, "symbol string, sums array<double>, w array<double>")
        new = parts.repartition(SYMBOL).sortWithinPartitions(SYMBOL).mapInArrow(solve, "symbol string, w array<double>, done boolean")
        new = new.select(SYMBOL, F.col("w").alias("_w"), F.col("done").alias("_done"))
        coefs = materialize(coefs.join(new, SYMBOL, "left").select(
            SYMBOL, F.coalesce("_w", "w").alias("w"), "n_train",
            F.when(F.col("_w").isNotNull(), F.lit(it)).otherwise(F.col("iterations")).alias("iterations"), F.coalesce("_done", "done").alias("done")))
    return coefs.select(SYMBOL, F.col("w")[0].alias("intercept"), F.slice("w", 2, d - 1).alias("coef"), "n_train", "iterations")


def score(scaled: DataFrame, coefs: DataFrame, ml: MLParams = DEFAULT.ml, features: list[str] | None = None) -> DataFrame:
    """Add ``decision``, ``probability`` (P(up)) and ``prediction`` to every row."""
    feats = features or feature_columns(ml.max_lag)
    joined = scaled.join(coefs.select(SYMBOL, "intercept", "coef"), SYMBOL)
    decision = F.col("intercept")
    for i, c in enumerate(feats):
        decision = decision + F.col("coef")[i] * F.col(c)
    out = joined.withColumn("decision", decision).drop("coef", "intercept")
    return out.withColumn("probability", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("decision")))).withColumn(
        "prediction", F.when(F.col("decision") > 0, F.lit(1)).otherwise(F.lit(0))
    )


def evaluate(scored: DataFrame) -> DataFrame:
    """Test-row metrics per symbol: accuracy, weighted precision / recall / F1
    (zero division -> 0), confusion counts, sample counts."""
    test = scored.filter(~F.col("is_train"))
    y, p = F.col("target"), F.col("prediction")
    n = F.count(F.lit(1))
    tp = F.count(F.when((y == 1) & (p == 1), 1))
    tn = F.count(F.when((y == 0) & (p == 0), 1))
    fp = F.count(F.when((y == 0) & (p == 1), 1))
    fn = F.count(F.when((y == 1) & (p == 0), 1))
    counts = test.groupBy(SYMBOL).agg(
        n.alias("total_samples"), tp.alias("tp"), tn.alias("tn"), fp.alias("fp"), fn.alias("fn")
    )

    def d(c):
        return F.col(c).cast("double")

    def safe(num, den):
        return F.coalesce(F.try_divide(num, den), F.lit(0.0))

    pos, neg, tot = d("tp") + d("fn"), d("tn") + d("fp"), d("total_samples")
    prec1, rec1 = safe(d("tp"), d("tp") + d("fp")), safe(d("tp"), pos)
    prec0, rec0 = safe(d("tn"), d("tn") + d("fn")), safe(d("tn"), neg)
    f1_1 = safe(2 * prec1 * rec1, prec1 + rec1)
    f1_0 = safe(2 * prec0 * rec0, prec0 + rec0)
    return counts.select(
        SYMBOL,
        ((d("tp") + d("tn")) / tot).alias("accuracy"),
        ((prec0 * neg + prec1 * pos) / tot).alias("precision"),
        ((rec0 * neg + rec1 * pos) / tot).alias("recall"),
        ((f1_0 * neg + f1_1 * pos) / tot).alias("f1_score"),
        F.array(F.array(F.col("tn"), F.col("fp")), F.array(F.col("fn"), F.col("tp"))).alias("confusion_matrix"),
        "total_samples",
        (F.col("tp") + F.col("fn")).alias("positive_samples"),
        (F.col("tn") + F.col("fp")).alias("negative_samples"),
    )


def latest(scored: DataFrame) -> DataFrame:
    """The newest row of each symbol with its class and confidence (max probability)."""
    last = scored.groupBy(SYMBOL).agg(
        F.max(TS).alias(TS), F.max_by("prediction", TS).alias("latest_prediction"),
        F.max_by("probability", TS).alias("probability"))
    return last.select(
        SYMBOL, TS, "latest_prediction",
        F.greatest(F.col("probability"), F.lit(1.0) - F.col("probability")).alias("confidence"),
        "probability",
    )


def for_all(symbols: DataFrame, results: DataFrame) -> DataFrame:
    """A result row for each of ``symbols``: those without a model get accuracy, confidence and
    probability 0.5 and class 0."""
    defaults = {"accuracy": 0.5, "latest_prediction": 0, "confidence": 0.5, "probability": 0.5}
    out = symbols.select(SYMBOL).distinct().join(results, SYMBOL, "left")
    return out.fillna({c: v for c, v in defaults.items() if c in results.columns})


# ---------------------------------------------------------------- saved models


def bundle(coefs: DataFrame, scaler: DataFrame, features: list[str] | None = None, model_type: str = "logistic_regression") -> DataFrame:
    """All that scoring new bars needs, one row per symbol: features, their means and stds, coefficients."""
    names = F.array(*[F.lit(c) for c in features or feature_columns()])
    return coefs.join(scaler, SYMBOL).withColumns({"features": names, "model_type": F.lit(model_type)})


def save(bundled: DataFrame, path: str) -> None:
    bundled.write.mode("overwrite").parquet(path)


def load(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def score_with(rows: DataFrame, bundled: DataFrame) -> DataFrame:
    """Raw feature rows (of new bars, say) scaled and scored by a saved model."""
    first = bundled.select("features").first()  # one row: the feature names are the same for all symbols
    if first is None:
        raise ValueError("the saved model holds no symbol")
    features = list(first[0])
    return score(transform(rows, bundled, features), bundled, features=features)


# ---------------------------------------------------------------- trees


def fit_trees(scaled: DataFrame, features: list[str] | None = None, model_type: str = "decision_tree", ml: MLParams = DEFAULT.ml):
    """A decision tree or a random forest (MLlib) over the training rows of all symbols together.

    Features are standardised per symbol, so one model serves all; any other
    ``model_type`` is an error.
    """
    feats = features or feature_columns(ml.max_lag)
    common = {"featuresCol": "x", "labelCol": "target", "maxDepth": ml.tree_depth, "seed": ml.seed}
    if model_type == "decision_tree":
        learner = DecisionTreeClassifier(minInstancesPerNode=ml.tree_min_leaf, **common)
    elif model_type == "random_forest":
        learner = RandomForestClassifier(numTrees=ml.forest_trees, **common)
    else:
        raise ValueError(f"unknown tree model {model_type!r}")
    rows = VectorAssembler(inputCols=feats, outputCol="x").transform(scaled.filter(F.col("is_train")))
    return learner.fit(rows.select("x", F.col("target").cast("double").alias("target")))


def importance(model, spark, features: list[str] | None = None, top: int = 5) -> DataFrame:
    """``rank, feature, importance``: the features a tree model splits on most, ties in feature order."""
    feats = features or feature_columns()
    ranked = sorted(zip(feats, model.featureImportances.toArray()), key=lambda r: -r[1])[:top]
    return spark.createDataFrame([(i, f, float(v)) for i, (f, v) in enumerate(ranked, 1)], "rank int, feature string, importance double")
