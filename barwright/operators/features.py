"""Feature tables for next-bar direction models.

Features and split are window functions on the ``(symbol, ts)`` layout the
indicators already use.  Scaling statistics are a grouped aggregate (partial sums
per map task, one small row per symbol) that is kept with the model and joined to
the rows to scale, so new bars are scaled like the training rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, IndicatorParams, MLParams
from ..functions.windows import SYMBOL, TS, by_symbol, trailing
from .cleaning import pct_change
from .indicators import add_all_indicators

BASIC = ["rsi", "ma_20", "ma_50", "macd", "volume_sma"]
EXTRA = [
    "price_change", "volume_change", "high_low_ratio", "close_ma20_ratio", "close_ma50_ratio",
    "stoch_k", "stoch_d", "bb_upper", "bb_lower", "atr", "macd_signal", "macd_histogram",
]
LAG_BASES = ["rsi", "price_change", "volume_change"]


def feature_columns(max_lag: int = 5) -> list[str]:
    """Fixed order: 5 basic, 12 extra, then lags k=1..max_lag of rsi, price_change, volume_change."""
    lags = [f"{b}_lag_{k}" for k in range(1, max_lag + 1) for b in LAG_BASES]
    return BASIC + EXTRA + lags


FEATURES = feature_columns(DEFAULT.ml.max_lag)


def target(df: DataFrame) -> DataFrame:
    """1 if the next close is higher, else 0 (the last bar gets 0)."""
    nxt = F.lead("close").over(by_symbol())
    return df.withColumn("target", F.when(nxt > F.col("close"), F.lit(1)).otherwise(F.lit(0)))


def _whole() -> Window:
    return Window.partitionBy(SYMBOL)


def raw_features(bars: DataFrame, ind: IndicatorParams = DEFAULT.indicators, ml: MLParams = DEFAULT.ml) -> DataFrame:
    """Bars -> symbol, ts, close, the feature columns (NULLs kept), target, n_raw."""
    df = add_all_indicators(bars, ind)
    df = target(df)
    df = df.withColumn("price_change", pct_change("close")).withColumn("volume_change", pct_change("volume"))
    df = df.withColumn("high_low_ratio", F.try_divide(F.col("high"), F.col("low")))
    df = df.withColumn("close_ma20_ratio", F.try_divide(F.col("close"), F.col("ma_20")))
    df = df.withColumn("close_ma50_ratio", F.try_divide(F.col("close"), F.col("ma_50")))
    w = by_symbol()
    lags = [F.lag(b, k).over(w).alias(f"{b}_lag_{k}") for k in range(1, ml.max_lag + 1) for b in LAG_BASES]
    df = df.select("*", *lags, F.count(F.lit(1)).over(_whole()).alias("n_raw"))
    return df.select(SYMBOL, TS, "close", *feature_columns(ml.max_lag), "target", "n_raw")


def clean_features(raw: DataFrame, ml: MLParams = DEFAULT.ml) -> DataFrame:
    """Rows with every feature present, for symbols with enough raw and clean rows."""
    feats = feature_columns(ml.max_lag)
    ok = raw.filter(F.col("n_raw") >= ml.min_raw_rows).dropna(subset=feats)
    ok = ok.withColumn("n_clean", F.count(F.lit(1)).over(_whole()))
    return ok.filter(F.col("n_clean") >= ml.min_clean_rows)


def split(clean: DataFrame, ml: MLParams = DEFAULT.ml) -> DataFrame:
    """Chronological split: the first ``int(n * 0.8)`` rows of each symbol train.

    If fewer than ``min_test_rows`` rows would be left for testing, a
    stratified test sample of ``ceil(0.3 * n)`` rows is drawn instead, shared
    among the two classes by their size (the odd row goes to the larger
    remainder, class 0 if equal): rows are ranked inside each (symbol, target)
    class by a seeded hash (deterministic; not the same draw as scikit-learn).
    """
    rn = F.row_number().over(by_symbol())
    n_train = F.floor(F.col("n_clean") * ml.train_fraction)
    out = clean.withColumn("_rn", rn).withColumn("_n_train", n_train.cast("long"))
    # n - floor(f*n) never decreases with n, so if the smallest admitted symbol
    # keeps enough test rows the fallback is unreachable and is not planned.
    n_min = ml.min_clean_rows
    if n_min - int(n_min * ml.train_fraction) >= ml.min_test_rows:
        return out.withColumn("is_train", F.col("_rn") <= F.col("_n_train")).drop("_rn", "_n_train")
    small = (F.col("n_clean") - F.col("_n_train")) < ml.min_test_rows
    cls = Window.partitionBy(SYMBOL, "target")
    h = F.xxhash64(F.col(SYMBOL), F.col(TS), F.lit(ml.seed))
    strat_rank = F.row_number().over(cls.orderBy(h, TS))
    cls_n = F.count(F.lit(1)).over(cls)
    wanted = cls_n * F.ceil(F.col("n_clean") * ml.small_test_fraction)
    odd = 2 * F.pmod(wanted, F.col("n_clean"))
    gets_odd = (odd > F.col("n_clean")) | ((odd == F.col("n_clean")) & (F.col("target") == 0))
    strat_test = strat_rank <= F.floor(wanted / F.col("n_clean")) + gets_odd.cast("int")
    out = out.withColumn(
        "is_train",
        F.when(small, ~strat_test).otherwise(F.col("_rn") <= F.col("_n_train")),
    )
    return out.drop("_rn", "_n_train")


def fit_scaler(split_df: DataFrame, features: list[str] | None = None) -> DataFrame:
    """``symbol, means, stds``: mean and population std (0 -> 1) of the training rows, in the order of ``features``."""
    features = features or FEATURES
    stats = [F.avg(c).alias(f"{c}_mu") for c in features] + [F.stddev_pop(c).alias(f"{c}_sd") for c in features]
    got = split_df.filter(F.col("is_train")).groupBy(SYMBOL).agg(*stats)
    sds = [F.when(F.col(f"{c}_sd") == 0, F.lit(1.0)).otherwise(F.col(f"{c}_sd")) for c in features]
    return got.select(SYMBOL, F.array(*[f"{c}_mu" for c in features]).alias("means"), F.array(*sds).alias("stds"))


def transform(df: DataFrame, scaler: DataFrame, features: list[str] | None = None) -> DataFrame:
    """``df`` with each feature standardised by ``scaler``; symbols it does not know have no rows."""
    features = features or FEATURES
    joined = df.join(scaler.select(SYMBOL, "means", "stds"), SYMBOL)
    cols = [((F.col(c) - F.col("means")[i]) / F.col("stds")[i]).alias(c) for i, c in enumerate(features)]
    return joined.select(*[c for c in df.columns if c not in features], *cols)


def scale(split_df: DataFrame, ml: MLParams = DEFAULT.ml) -> DataFrame:
    """Standardise each feature by the training rows; pass a materialized table, it is read twice."""
    features = feature_columns(ml.max_lag)
    return transform(split_df, fit_scaler(split_df, features), features)


ALT_FEATURES = ["RSI", "MA_20", "MA_50", "MACD", "MACD_Signal", "MACD_Hist", "Volume_Change", "Price_Change",
                "Close_Lag1", "Close_Lag2", "Volatility"]


def alt_features(bars: DataFrame, ind: IndicatorParams = DEFAULT.indicators, min_rows: int = 20) -> DataFrame:
    """Second feature set: indicators, changes, 10-bar volatility, close lags, target.

    Rows with any missing value are dropped; symbols with fewer than
    ``min_rows`` remaining rows yield nothing.
    """
    df = add_all_indicators(bars, ind)
    w = by_symbol()
    pc = pct_change("close")
    df = df.select(
        SYMBOL, TS,
        F.col("rsi").alias("RSI"), F.col("ma_20").alias("MA_20"), F.col("ma_50").alias("MA_50"),
        F.col("macd").alias("MACD"), F.col("macd_signal").alias("MACD_Signal"),
        (F.col("macd") - F.col("macd_signal")).alias("MACD_Hist"),
        pct_change("volume").alias("Volume_Change"), pc.alias("Price_Change"),
        F.lag("close", 1).over(w).alias("Close_Lag1"), F.lag("close", 2).over(w).alias("Close_Lag2"),
        F.when(F.lead("close").over(w) > F.col("close"), F.lit(1)).otherwise(F.lit(0)).alias("Target"),
    )
    w10 = trailing(10)
    vol: Column = F.when(F.count("Price_Change").over(w10) == 10, F.stddev_samp("Price_Change").over(w10))
    df = df.withColumn("Volatility", vol).dropna()
    df = df.withColumn("_n", F.count(F.lit(1)).over(_whole()))
    return df.filter(F.col("_n") >= min_rows).drop("_n")
