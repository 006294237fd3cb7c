"""Queries over bars, indicators and signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import indicators as I
from ..operators import signals as S
from ..sources import fixtures as FX
from . import oracle as O
from .catalog import register, rounded

BAR_COLS = ["symbol", "ts", "open", "high", "low", "close", "volume"]
IND = I.INDICATOR_COLUMNS


def bars(spark, sf_dir):
    return FX.daily_bars(spark, sf_dir)


def signals(spark, sf_dir):
    return S.generate_signals(bars(spark, sf_dir))


@register("daily_bars", O.over_bars(O.proj(O.BAR_COLS)))
def q_daily_bars(spark, sf_dir):
    return rounded(bars(spark, sf_dir))


@register("rsi", O.over_indicators(O.proj("symbol, ts, d:rsi")))
def q_rsi(spark, sf_dir):
    return rounded(I.rsi(bars(spark, sf_dir)).select("symbol", "ts", "rsi"))


@register("sma", O.over_indicators(O.proj("symbol, ts, d:ma_20, d:ma_50")))
def q_sma(spark, sf_dir):
    b = I.sma(I.sma(bars(spark, sf_dir), 20), 50)
    return rounded(b.select("symbol", "ts", "ma_20", "ma_50"))


@register(
    "ema",
    O.with_(O.bars_cte(), O.indicators_ctes())
    + "\nSELECT " + O.proj("e.symbol, e.ts, d:ema_12=e.ema12 + (b.close - b.xc), d:ema_26=e.ema26 + (b.close - b.xc)")
    + " FROM ind_e1 e JOIN ind_b1 b ON e.symbol = b.symbol AND e.ts = b.ts",
)
def q_ema(spark, sf_dir):
    out = I.ema(I.ema(bars(spark, sf_dir), 12), 26)
    return rounded(out.select("symbol", "ts", "ema_12", "ema_26"))


@register(
    "ema_long",
    O.with_(O.bars_cte(), """base AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn,
         close - first_value(close) OVER (PARTITION BY symbol ORDER BY ts) AS xc FROM bars)""",
            O.ema_join("base", "e", "xc", {"ema50": 50, "ema200": 200}))
    + "\nSELECT " + O.proj("e.symbol, e.ts, d:ema_50=e.ema50 + (b.close - b.xc), d:ema_200=e.ema200 + (b.close - b.xc)")
    + " FROM e JOIN base b ON e.symbol = b.symbol AND e.ts = b.ts",
)
def q_ema_long(spark, sf_dir):
    out = I.ema(I.ema(bars(spark, sf_dir), 50), 200)
    return rounded(out.select("symbol", "ts", "ema_50", "ema_200"))


@register("macd", O.over_indicators(O.proj("symbol, ts, d:macd, d:macd_signal, d:macd_histogram")))
def q_macd(spark, sf_dir):
    return rounded(I.macd(bars(spark, sf_dir)).select("symbol", "ts", "macd", "macd_signal", "macd_histogram"))


@register("bollinger", O.over_indicators(O.proj("symbol, ts, d:bb_upper, d:bb_middle, d:bb_lower")))
def q_bollinger(spark, sf_dir):
    return rounded(I.bollinger(bars(spark, sf_dir)).select("symbol", "ts", "bb_upper", "bb_middle", "bb_lower"))


@register("stochastic", O.over_indicators(O.proj("symbol, ts, d:stoch_k, d:stoch_d")))
def q_stochastic(spark, sf_dir):
    return rounded(I.stochastic(bars(spark, sf_dir)).select("symbol", "ts", "stoch_k", "stoch_d"))


@register("volume_sma", O.over_indicators(O.proj("symbol, ts, d:volume_sma")))
def q_volume_sma(spark, sf_dir):
    return rounded(I.volume_sma(bars(spark, sf_dir)).select("symbol", "ts", "volume_sma"))


@register("atr", O.over_indicators(O.proj("symbol, ts, d:atr")))
def q_atr(spark, sf_dir):
    return rounded(I.atr(bars(spark, sf_dir)).select("symbol", "ts", "atr"))


@register("all_indicators", O.over_indicators(O.proj(O.BAR_COLS + ", " + O.IND_COLS)))
def q_all_indicators(spark, sf_dir):
    return rounded(I.add_all_indicators(bars(spark, sf_dir)).select(*BAR_COLS, *IND))


# rows of a block; production tables with millions of bars a symbol take the default of functions.blocks
BLOCK_ROWS = 512


@register("all_indicators_blocked", O.over_indicators(O.proj(O.BAR_COLS + ", " + O.IND_COLS)))
def q_all_indicators_blocked(spark, sf_dir):
    """The same values with windows per block of a symbol's rows."""
    return rounded(I.add_all_indicators(bars(spark, sf_dir), block_rows=BLOCK_ROWS).select(*BAR_COLS, *IND))


@register("signal_blocked", O.over_signals(O.proj(O.BAR_COLS + ", " + O.IND_COLS + ", " + O.SIG_COLS)))
def q_signal_blocked(spark, sf_dir):
    out = S.generate_signals(bars(spark, sf_dir), block_rows=BLOCK_ROWS)
    return rounded(out.select(*BAR_COLS, *IND, *S.SIGNAL_COLUMNS))


@register("signal", O.over_signals(O.proj(O.BAR_COLS + ", " + O.IND_COLS + ", " + O.SIG_COLS)))
def q_signal(spark, sf_dir):
    return rounded(signals(spark, sf_dir).select(*BAR_COLS, *IND, *S.SIGNAL_COLUMNS))


@register(
    "current_signals",
    O.with_(O.bars_cte(), O.indicators_ctes(), O.signals_ctes(),
            "last AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rr FROM sig)")
    + "\nSELECT " + O.proj("symbol, signal, d:price=close, d:rsi, d:ma_20, d:ma_50, ts AS date")
    + " FROM last WHERE rr = 1 AND signal <> 'hold'",
)
def q_current_signals(spark, sf_dir):
    return rounded(S.current_signals(signals(spark, sf_dir)))
