"""ML feature, split, scaling, training and evaluation queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.materialize import materialize
from ..operators import features as FE
from ..operators import model as M
from ..operators import trees as TR
from ..session import scratch_path
from ..sources import fixtures as FX
from ..sources import sinks as SK
from . import oracle as O
from .catalog import register, rounded
from .queries_core import bars
from .queries_data import REPORT_AS_OF, published

FEATS = FE.FEATURES
_LAGS = ", ".join(
    f"lag({b}, {k}) OVER w AS {b}_lag_{k}" for k in range(1, 6) for b in FE.LAG_BASES
)
FEATURES_CTES = f"""f0 AS (
  SELECT symbol, ts, close, rsi, ma_20, ma_50, macd, volume_sma,
         close / nullif(lag(close) OVER w, 0) - 1.0 AS price_change,
         volume / nullif(lag(volume) OVER w, 0) - 1.0 AS volume_change,
         high / nullif(low, 0) AS high_low_ratio,
         close / nullif(ma_20, 0) AS close_ma20_ratio, close / nullif(ma_50, 0) AS close_ma50_ratio,
         stoch_k, stoch_d, bb_upper, bb_lower, atr, macd_signal, macd_histogram,
         CASE WHEN lead(close) OVER w > close THEN 1 ELSE 0 END AS target,
         count(*) OVER (PARTITION BY symbol) AS n_raw
  FROM ind WINDOW w AS (PARTITION BY symbol ORDER BY ts)
),
f1 AS (SELECT *, {_LAGS} FROM f0 WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
fc0 AS (SELECT * FROM f1 WHERE n_raw >= 100 AND {' AND '.join(f'{c} IS NOT NULL' for c in FEATS)}),
fc AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n_clean FROM fc0),
fclean AS (SELECT * FROM fc WHERE n_clean >= 50),
fsplit AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) <= CAST(floor(n_clean * 0.8) AS BIGINT) AS is_train
  FROM fclean
)"""

FEAT_PROJ = ", ".join(f"d:{c}" for c in FEATS)


def over_features(select: str, frm: str, tail: str = "") -> str:
    return O.with_(O.bars_cte(), O.indicators_ctes(), FEATURES_CTES) + f"\nSELECT {select} FROM {frm} {tail}"


def raw(spark, sf_dir):
    return FE.raw_features(bars(spark, sf_dir))


def split_rows(spark, sf_dir):
    """The split feature table, written once: scaler and rows both read it."""
    return materialize(FE.split(FE.clean_features(raw(spark, sf_dir))))


def scaled(spark, sf_dir):
    return FE.scale(split_rows(spark, sf_dir))


def listed(spark, sf_dir):
    """Every listed symbol: the brands and the tick symbols, which have no daily bars."""
    return (FX.derived_universe(spark, sf_dir).select("symbol")
            .union(FX.table(spark, sf_dir, "events").select("event_type")).distinct())


@register("ml_target", over_features("symbol, ts, target", "f1"))
def q_ml_target(spark, sf_dir):
    return raw(spark, sf_dir).select("symbol", "ts", "target")


@register("ml_features", over_features(O.proj("symbol, ts, " + FEAT_PROJ + ", target"), "f1"))
def q_ml_features(spark, sf_dir):
    return rounded(raw(spark, sf_dir).select("symbol", "ts", *FEATS, "target"))


@register("ml_clean", over_features(O.proj("symbol, ts, " + FEAT_PROJ + ", target"), "fclean"))
def q_ml_clean(spark, sf_dir):
    return rounded(FE.clean_features(raw(spark, sf_dir)).select("symbol", "ts", *FEATS, "target"))


# Beside each symbol, its first 100 bars (too few clean rows) and its first 99 (too few bars).
_SHORT_BARS = O.bars_cte("all_bars") + """,
bars AS (
  SELECT * FROM all_bars
  UNION ALL
  SELECT symbol || '/' || n, ts, open, high, low, close, volume
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM all_bars)
  JOIN (VALUES (100), (99)) short(n) ON rn <= n
)"""


@register(
    "ml_min_rows",
    O.with_(_SHORT_BARS, O.indicators_ctes(), FEATURES_CTES) + """
SELECT symbol, max(n_raw) AS n_raw, count(*) FILTER (WHERE n_raw >= 100 AND n_clean IS NOT NULL) AS n_clean,
       max(n_raw) >= 100 AND count(*) FILTER (WHERE n_clean IS NOT NULL) >= 50 AS trainable
FROM (SELECT f1.symbol, f1.n_raw, fc.n_clean FROM f1 LEFT JOIN fc USING (symbol, ts)) GROUP BY symbol""",
)
def q_ml_min_rows(spark, sf_dir):
    b = bars(spark, sf_dir)
    rn = F.row_number().over(Window.partitionBy("symbol").orderBy("ts"))
    short = b.withColumn("rn", rn).withColumn("n", F.explode(F.array(F.lit(100), F.lit(99)))).where("rn <= n")
    short = short.withColumn("symbol", F.concat("symbol", F.lit("/"), F.col("n").cast("string")))
    r = FE.raw_features(b.unionByName(short.select(*b.columns)))
    clean_flag = F.when(F.col("n_raw") >= 100, F.lit(1))
    for c in FEATS:
        clean_flag = F.when(F.col(c).isNotNull(), clean_flag)
    agg = r.groupBy("symbol").agg(F.max("n_raw").alias("n_raw"), F.count(clean_flag).alias("n_clean"))
    return agg.withColumn("trainable", (F.col("n_raw") >= 100) & (F.col("n_clean") >= 50))


@register("ml_split", over_features("symbol, ts, target, is_train", "fsplit"))
def q_ml_split(spark, sf_dir):
    return FE.split(FE.clean_features(raw(spark, sf_dir))).select("symbol", "ts", "target", "is_train")


def _z(c: str) -> str:
    mu = f"avg(CASE WHEN is_train THEN {c} END) OVER (PARTITION BY symbol)"
    sd = f"stddev_pop(CASE WHEN is_train THEN {c} END) OVER (PARTITION BY symbol)"
    return f"({c} - {mu}) / (CASE WHEN {sd} = 0 THEN 1.0 ELSE {sd} END)"


def _scale_expr(c: str) -> str:
    return f"d:{c}={_z(c)}"


@register(
    "ml_scale",
    over_features(O.proj("symbol, ts, is_train, target, " + ", ".join(_scale_expr(c) for c in FEATS)), "fsplit"),
)
def q_ml_scale(spark, sf_dir):
    return rounded(scaled(spark, sf_dir).select("symbol", "ts", "is_train", "target", *FEATS))


ALT_CTES = """a0 AS (
  SELECT symbol, ts, rsi AS RSI, ma_20 AS MA_20, ma_50 AS MA_50, macd AS MACD, macd_signal AS MACD_Signal,
         macd - macd_signal AS MACD_Hist,
         volume / nullif(lag(volume) OVER w, 0) - 1.0 AS Volume_Change,
         close / nullif(lag(close) OVER w, 0) - 1.0 AS Price_Change,
         lag(close, 1) OVER w AS Close_Lag1, lag(close, 2) OVER w AS Close_Lag2,
         CASE WHEN lead(close) OVER w > close THEN 1 ELSE 0 END AS Target
  FROM ind WINDOW w AS (PARTITION BY symbol ORDER BY ts)
),
a1 AS (
  SELECT *, CASE WHEN count(Price_Change) OVER w10 = 10 THEN stddev_samp(Price_Change) OVER w10 END AS Volatility
  FROM a0 WINDOW w10 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)
),
a2 AS (
  SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM a1
  WHERE RSI IS NOT NULL AND MA_20 IS NOT NULL AND MA_50 IS NOT NULL AND MACD IS NOT NULL AND MACD_Signal IS NOT NULL
    AND Volume_Change IS NOT NULL AND Price_Change IS NOT NULL AND Close_Lag1 IS NOT NULL AND Close_Lag2 IS NOT NULL
    AND Volatility IS NOT NULL
)"""


@register(
    "ml_features_alt",
    O.with_(O.bars_cte(), O.indicators_ctes(), ALT_CTES) + "\nSELECT " + O.proj("symbol, ts, d:RSI, d:MA_20, d:MA_50, d:MACD, d:MACD_Signal, d:MACD_Hist, d:Volume_Change, "
                              "d:Price_Change, Target, d:Close_Lag1, d:Close_Lag2, d:Volatility") + " FROM a2 WHERE n >= 20",
)
def q_ml_features_alt(spark, sf_dir):
    return rounded(FE.alt_features(bars(spark, sf_dir)))


# ---------------------------------------------------------------- models (rows-only checks)


def _scored(spark, sf_dir):
    sc = scaled(spark, sf_dir)
    coefs = materialize(M.fit_logistic(sc))
    return sc, coefs, M.score(sc, coefs)


@register("ml_train")
def q_ml_train(spark, sf_dir):
    _, coefs, _ = _scored(spark, sf_dir)
    return coefs


@register("ml_predict_all")
def q_ml_predict_all(spark, sf_dir):
    _, _, s = _scored(spark, sf_dir)
    return rounded(s.select("symbol", "ts", "is_train", "target", "probability", "prediction"))


@register("ml_predict_next")
def q_ml_predict_next(spark, sf_dir):
    _, _, s = _scored(spark, sf_dir)
    return rounded(M.for_all(listed(spark, sf_dir), M.latest(s)))


@register("ml_evaluate")
def q_ml_evaluate(spark, sf_dir):
    _, _, s = _scored(spark, sf_dir)
    return rounded(M.evaluate(s))


@register("ml_predictor")
def q_ml_predictor(spark, sf_dir):
    """Direction, P(up) and the raw newest row of the second feature set, by a model of that set."""
    alt = FE.alt_features(bars(spark, sf_dir))
    rows = materialize(FE.split(alt.withColumn("n_clean", F.count(F.lit(1)).over(Window.partitionBy("symbol")))))
    scaler = FE.fit_scaler(rows, FE.ALT_FEATURES)
    sc = FE.transform(rows, scaler, FE.ALT_FEATURES)
    s = M.score(sc, M.fit_logistic(sc, features=FE.ALT_FEATURES, target="Target"), features=FE.ALT_FEATURES)
    newest = rows.select("symbol", "ts", F.array(*FE.ALT_FEATURES).alias("features"))
    out = M.for_all(listed(spark, sf_dir), M.latest(s).join(newest, ["symbol", "ts"]))
    return rounded(out.select("symbol", "ts", F.col("latest_prediction").alias("direction"),
                              F.col("probability").alias("confidence"), "features"))


@register("ml_importance")
def q_ml_importance(spark, sf_dir):
    """The five features that a decision tree over all symbols splits on most."""
    return rounded(M.importance(M.fit_trees(scaled(spark, sf_dir)), spark))


# A coefficient table that SQL can state: P(up) grows with MACD less its signal line, both standardised.
RULE = {"macd": 1.0, "macd_signal": -1.0}
_RULE_CTE = f"""rule0 AS (
  SELECT symbol, ts, is_train, target,
         {_z('macd')} - {_z('macd_signal')} AS decision
  FROM fsplit
),
rule AS (
  SELECT *, 1.0 / (1.0 + exp(-decision)) AS probability, CASE WHEN decision > 0 THEN 1 ELSE 0 END AS prediction FROM rule0
)"""


def _over_rule(select: str, frm: str, tail: str = "", *ctes: str) -> str:
    return O.with_(O.bars_cte(), O.indicators_ctes(), FEATURES_CTES, _RULE_CTE, *ctes) + f"\nSELECT {select} FROM {frm} {tail}"


def _by_rule(spark, sf_dir):
    sc = scaled(spark, sf_dir)
    coef = F.array(*[F.lit(RULE.get(c, 0.0)) for c in FEATS])
    return M.score(sc, sc.select("symbol").distinct().select("symbol", F.lit(0.0).alias("intercept"), coef.alias("coef")))


@register("ml_predict_all_rule", _over_rule(O.proj("symbol, ts, is_train, target, d:probability, prediction"), "rule"))
def q_ml_predict_all_rule(spark, sf_dir):
    return rounded(_by_rule(spark, sf_dir).select("symbol", "ts", "is_train", "target", "probability", "prediction"))


@register(
    "ml_predict_next_rule",
    _over_rule(O.proj("symbol, ts, coalesce(prediction, 0) AS latest_prediction, d:confidence=coalesce(greatest(probability, 1.0 - probability), 0.5), "
                      "d:probability=coalesce(probability, 0.5)"),
               "known LEFT JOIN newest USING (symbol)", "",
               "known AS (SELECT DISTINCT p_brand AS symbol FROM part UNION SELECT DISTINCT event_type FROM events)",
               "newest AS (SELECT * FROM rule QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1)"),
)
def q_ml_predict_next_rule(spark, sf_dir):
    return rounded(M.for_all(listed(spark, sf_dir), M.latest(_by_rule(spark, sf_dir))))


SCORES = ["accuracy", "precision", "recall", "f1_score", "total_samples", "positive_samples", "negative_samples"]


@register(
    "ml_evaluate_rule",
    _over_rule(O.proj("symbol, d:accuracy=(tp + tn) / n, d:precision=(p0 * neg + p1 * pos) / n, d:recall=(r0 * neg + r1 * pos) / n, "
                      "d:f1_score=(coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0) * neg + coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0) * pos) / n, "
                      "CAST(n AS BIGINT) AS total_samples, CAST(pos AS BIGINT) AS positive_samples, CAST(neg AS BIGINT) AS negative_samples"),
               "parts", "",
               """hits AS (
  SELECT symbol, CAST(count(*) AS DOUBLE) AS n, CAST(sum(target) AS DOUBLE) AS pos, CAST(sum(1 - target) AS DOUBLE) AS neg,
         CAST(sum(target * prediction) AS DOUBLE) AS tp, CAST(sum((1 - target) * (1 - prediction)) AS DOUBLE) AS tn,
         CAST(sum(prediction) AS DOUBLE) AS said1, CAST(sum(1 - prediction) AS DOUBLE) AS said0
  FROM rule WHERE NOT is_train GROUP BY symbol
)""",
               """parts AS (
  SELECT *, coalesce(tp / nullif(said1, 0), 0) AS p1, coalesce(tn / nullif(said0, 0), 0) AS p0,
         coalesce(tp / nullif(pos, 0), 0) AS r1, coalesce(tn / nullif(neg, 0), 0) AS r0
  FROM hits
)"""),
)
def q_ml_evaluate_rule(spark, sf_dir):
    return rounded(M.evaluate(_by_rule(spark, sf_dir)).select("symbol", *SCORES))


@register(
    "ml_split_small",
    over_features("symbol, target, n, w // nn + CASE WHEN 2 * (w % nn) > nn OR (2 * (w % nn) = nn AND target = 0) THEN 1 ELSE 0 END AS n_test",
                  "(SELECT symbol, target, count(*) AS n, max(n_clean) AS nn, "
                  "count(*) * CAST(ceil(max(n_clean) * CAST(0.3 AS DOUBLE)) AS BIGINT) AS w FROM fclean GROUP BY symbol, target)"),
)
def q_ml_split_small(spark, sf_dir):
    """Stratified fallback split forced on every symbol (min_test_rows above any test size)."""
    from dataclasses import replace

    from ..config import DEFAULT

    ml = replace(DEFAULT.ml, min_test_rows=10**9)
    s = FE.split(FE.clean_features(raw(spark, sf_dir), ml), ml)
    return s.groupBy("symbol", "target").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(~F.col("is_train"), 1)).alias("n_test"))


@register("sink_ml")
def q_sink_ml(spark, sf_dir):
    _, _, s = _scored(spark, sf_dir)
    s = s.select("symbol", "ts", "is_train", "target", "prediction", "probability")
    preds = M.for_all(listed(spark, sf_dir), M.evaluate(s).select("symbol", "accuracy").join(M.latest(s), "symbol"))
    return published(spark, rounded(SK.ml_table(preds, REPORT_AS_OF)), "ml_predictions", {"model_accuracy": F.lit(0.0)})


@register("model_save_load")
def q_model_save_load(spark, sf_dir):
    """Models with scaler and feature names, saved, loaded, and used on the newest raw features."""
    rows = split_rows(spark, sf_dir)
    scaler = FE.fit_scaler(rows)
    path = scratch_path(spark, "model")
    M.save(M.bundle(M.fit_logistic(FE.transform(rows, scaler)), scaler), path)
    saved = M.load(spark, path)
    last = M.latest(M.score_with(rows.select("symbol", "ts", *FEATS), saved))
    return rounded(saved.join(last, "symbol"))


# ---------------------------------------------------------------- the rule through the sink, the saved model and the second feature set

_KNOWN = "known AS (SELECT DISTINCT p_brand AS symbol FROM part UNION SELECT DISTINCT event_type FROM events)"
_NEWEST = "newest AS (SELECT * FROM rule QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1)"


@register(
    "ml_confusion_rule",
    _over_rule("symbol, count(*) FILTER (target = 0 AND prediction = 0) AS tn, count(*) FILTER (target = 0 AND prediction = 1) AS fp, "
               "count(*) FILTER (target = 1 AND prediction = 0) AS fn, count(*) FILTER (target = 1 AND prediction = 1) AS tp",
               "rule", "WHERE NOT is_train GROUP BY symbol"),
)
def q_ml_confusion_rule(spark, sf_dir):
    m = M.evaluate(_by_rule(spark, sf_dir))
    return m.select("symbol", *[F.col("confusion_matrix")[i][j].alias(n) for n, i, j in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))])


@register(
    "sink_ml_rule",
    _over_rule(O.proj("symbol, d:model_accuracy=coalesce(accuracy, 0.5), CAST(coalesce(prediction, 0) AS INTEGER) AS latest_prediction, "
                      "d:confidence=coalesce(greatest(probability, 1.0 - probability), 0.5), "
                      f"DATE '{REPORT_AS_OF}' AS date, DATE '{REPORT_AS_OF}' AS updated"),
               "known LEFT JOIN (SELECT * FROM newest JOIN right_ USING (symbol)) n USING (symbol)", "", _KNOWN, _NEWEST,
               "right_ AS (SELECT symbol, avg(CASE WHEN target = prediction THEN 1.0 ELSE 0.0 END) AS accuracy FROM rule WHERE NOT is_train GROUP BY symbol)"),
)
def q_sink_ml_rule(spark, sf_dir):
    s = _by_rule(spark, sf_dir)
    preds = M.for_all(listed(spark, sf_dir), M.evaluate(s).select("symbol", "accuracy").join(M.latest(s), "symbol"))
    return published(spark, rounded(SK.ml_table(preds, REPORT_AS_OF)), "ml_predictions_rule", {"model_accuracy": F.lit(0.0)})


@register(
    "model_save_load_rule",
    _over_rule(O.proj("symbol, ts, prediction AS latest_prediction, d:confidence=greatest(probability, 1.0 - probability), d:probability, "
                      "d:macd_mean, d:macd_std, 'rule' AS model_type"),
               "newest JOIN stats USING (symbol)", "", _NEWEST,
               "stats AS (SELECT symbol, avg(macd) AS macd_mean, stddev_pop(macd) AS macd_std FROM fsplit WHERE is_train GROUP BY symbol)"),
)
def q_model_save_load_rule(spark, sf_dir):
    """The rule's table as a model with its scaler, saved, loaded, and used on raw features."""
    rows = split_rows(spark, sf_dir)
    scaler = FE.fit_scaler(rows)
    coef = F.array(*[F.lit(RULE.get(c, 0.0)) for c in FEATS])
    coefs = rows.select("symbol").distinct().select("symbol", F.lit(0.0).alias("intercept"), coef.alias("coef"))
    path = scratch_path(spark, "model-rule")
    M.save(M.bundle(coefs, scaler, model_type="rule"), path)
    saved = M.load(spark, path)
    at = FEATS.index("macd")
    last = M.latest(M.score_with(rows.select("symbol", "ts", *FEATS), saved))
    return rounded(saved.join(last, "symbol").select(
        "symbol", "ts", "latest_prediction", "confidence", "probability", F.col("means")[at].alias("macd_mean"), F.col("stds")[at].alias("macd_std"), "model_type"))


ALT_RULE = {"MACD": 1.0, "MACD_Signal": -1.0}


@register(
    "ml_predictor_rule",
    O.with_(O.bars_cte(), O.indicators_ctes(), ALT_CTES, """a3 AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) <= CAST(floor(n * 0.8) AS BIGINT) AS is_train FROM a2 WHERE n >= 20)""",
            f"a4 AS (SELECT *, {_z('MACD')} - {_z('MACD_Signal')} AS decision FROM a3)", _KNOWN,
            "newest AS (SELECT * FROM a4 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1)")
    + "\nSELECT " + O.proj("symbol, ts, CASE WHEN coalesce(decision, 0) > 0 THEN 1 ELSE 0 END AS direction, "
                           "d:confidence=coalesce(1.0 / (1.0 + exp(-decision)), 0.5), " + ", ".join(f"d:{c}" for c in FE.ALT_FEATURES))
    + " FROM known LEFT JOIN newest USING (symbol)",
)
def q_ml_predictor_rule(spark, sf_dir):
    """The second feature set's predictor with the rule for a model: direction, P(up) and the raw newest row."""
    alt = FE.alt_features(bars(spark, sf_dir))
    rows = materialize(FE.split(alt.withColumn("n_clean", F.count(F.lit(1)).over(Window.partitionBy("symbol")))))
    coef = F.array(*[F.lit(ALT_RULE.get(c, 0.0)) for c in FE.ALT_FEATURES])
    coefs = rows.select("symbol").distinct().select("symbol", F.lit(0.0).alias("intercept"), coef.alias("coef"))
    s = M.score(FE.transform(rows, FE.fit_scaler(rows, FE.ALT_FEATURES), FE.ALT_FEATURES), coefs, features=FE.ALT_FEATURES)
    newest = M.latest(s).join(rows.select("symbol", "ts", *FE.ALT_FEATURES), ["symbol", "ts"])
    return rounded(M.for_all(listed(spark, sf_dir), newest).select(
        "symbol", "ts", F.col("latest_prediction").alias("direction"), F.col("probability").alias("confidence"), *FE.ALT_FEATURES))


# ---------------------------------------------------------------- fits over symbols of any size


@register("ml_train_sums")
def q_ml_train_sums(spark, sf_dir):
    """Coefficients from grouped sums; equal to ``ml_train`` (tests hold them to 1e-8)."""
    return M.fit_logistic_sums(scaled(spark, sf_dir))


def _grown(spark, sf_dir, forest):
    rows = materialize(scaled(spark, sf_dir).select("symbol", "ts", "is_train", "target", *FEATS))
    return rows, *TR.fit_symbol_trees(rows, FEATS, forest=forest)


@register("ml_tree_importance")
def q_ml_tree_importance(spark, sf_dir):
    """What each symbol's decision tree splits on; shares of 1 per symbol."""
    _, nodes, _ = _grown(spark, sf_dir, False)
    return rounded(TR.symbol_importance(nodes, FEATS))


@register("ml_tree_evaluate")
def q_ml_tree_evaluate(spark, sf_dir):
    rows, nodes, cuts = _grown(spark, sf_dir, False)
    scored = TR.score_symbol_trees(rows, nodes, cuts, FEATS, keep=("is_train", "target"))
    return rounded(M.evaluate(scored).select("symbol", *SCORES))


@register("ml_forest_importance")
def q_ml_forest_importance(spark, sf_dir):
    """The same of forests of a hundred trees a symbol."""
    _, nodes, _ = _grown(spark, sf_dir, True)
    return rounded(TR.symbol_importance(nodes, FEATS))
