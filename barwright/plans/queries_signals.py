"""Signal sub-operators."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..config import DEFAULT
from ..operators import signals as S
from . import oracle as O
from .catalog import register, rounded
from .queries_core import bars, signals

CAPITAL = 100000.0


def _sig(spark, sf_dir, *cols):
    return rounded(signals(spark, sf_dir).select("symbol", "ts", *cols))


@register("ma_cross", O.over_signals("symbol, ts, ma_cross, ma_cross_signal"))
def q_ma_cross(spark, sf_dir):
    return _sig(spark, sf_dir, "ma_cross", "ma_cross_signal")


@register("signal_strength", O.over_signals(O.proj("symbol, ts, signal, d:signal_strength")))
def q_signal_strength(spark, sf_dir):
    return _sig(spark, sf_dir, "signal", "signal_strength")


@register("entry_reason", O.over_signals("symbol, ts, signal, entry_reason"))
def q_entry_reason(spark, sf_dir):
    return _sig(spark, sf_dir, "signal", "entry_reason")


@register("confirm_volume", O.over_signals(O.proj("symbol, ts, d:volume_avg, volume_spike")))
def q_confirm_volume(spark, sf_dir):
    return _sig(spark, sf_dir, "volume_avg", "volume_spike")


@register("confirm_macd", O.over_signals("symbol, ts, macd_bullish, macd_bearish"))
def q_confirm_macd(spark, sf_dir):
    return _sig(spark, sf_dir, "macd_bullish", "macd_bearish")


STRONG = replace(DEFAULT.strategy, confirm_bonus=0.6)  # so large a bonus that strengths reach the cap


@register(
    "clip_strength",
    O.with_(O.bars_cte(), O.indicators_ctes(), O.signals_ctes(bonus=STRONG.confirm_bonus))
    + "\nSELECT symbol, signal, count(*) AS n, count(*) FILTER (WHERE signal_strength >= 1.0) AS n_capped, "
    + O.proj("d:strongest=max(signal_strength)") + " FROM sig GROUP BY symbol, signal",
)
def q_clip_strength(spark, sf_dir):
    s = S.generate_signals(bars(spark, sf_dir), st=STRONG)
    return rounded(s.groupBy("symbol", "signal").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("signal_strength") >= 1.0, 1)).alias("n_capped"),
        F.max("signal_strength").alias("strongest")))


@register(
    "position_size",
    O.over_signals(
        "symbol, ts, signal, CAST(greatest(1, CASE WHEN close * 0.02 > 0 THEN floor(CAST(100000.0 AS DOUBLE) * 0.02 / (close * 0.02)) "
        "ELSE floor(CAST(100000.0 AS DOUBLE) * 0.1 / close) END) AS BIGINT) AS position_size"),
)
def q_position_size(spark, sf_dir):
    s = signals(spark, sf_dir)
    return s.select("symbol", "ts", "signal", S.position_size(F.lit(CAPITAL), F.col("close")).alias("position_size"))


@register(
    "stop_loss",
    O.over_signals(O.proj("symbol, ts, signal, d:stop_loss=CASE WHEN signal = 'buy' THEN close * (1 - 0.02) ELSE close * (1 + 0.02) END")),
)
def q_stop_loss(spark, sf_dir):
    s = signals(spark, sf_dir)
    return rounded(s.select("symbol", "ts", "signal", S.stop_loss_price(F.col("close"), F.col("signal")).alias("stop_loss")))


@register(
    "take_profit",
    O.over_signals(O.proj("symbol, ts, signal, d:take_profit=CASE WHEN signal = 'buy' THEN close * (1 + 0.04) ELSE close * (1 - 0.04) END")),
)
def q_take_profit(spark, sf_dir):
    s = signals(spark, sf_dir)
    return rounded(s.select("symbol", "ts", "signal", S.take_profit_price(F.col("close"), F.col("signal")).alias("take_profit")))


@register(
    "validate_signal",
    O.over_signals(O.proj("symbol, ts, signal, d:signal_strength"),
                   "WHERE signal <> 'hold' AND signal_strength >= 0.3 AND rsi IS NOT NULL AND ma_20 IS NOT NULL AND ma_50 IS NOT NULL"),
)
def q_validate_signal(spark, sf_dir):
    s = signals(spark, sf_dir).filter((F.col("signal") != "hold") & S.valid_signal())
    return rounded(s.select("symbol", "ts", "signal", "signal_strength"))


@register("signal_distribution", O.over_signals("symbol, signal, count(*) AS n", "GROUP BY symbol, signal"))
def q_signal_distribution(spark, sf_dir):
    return S.signal_distribution(signals(spark, sf_dir))
