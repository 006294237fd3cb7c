"""RSI + moving-average crossover signals.

Rules (fixed by the surveyed strategy):

* ``ma_cross`` = +1 if ma_20 > ma_50 else -1; ``ma_cross_signal`` is its
  change from the previous bar (+2 cross up, -2 cross down, NULL on row 1);
* buy if RSI < oversold OR cross up; sell if RSI > overbought OR cross down,
  and sell overrides buy; everything else holds;
* strength: buy ``(30-rsi)/30*0.5 + 0.5*[cross up]``, sell
  ``(rsi-70)/30*0.5 + 0.5*[cross down]``, +0.1 for a volume spike
  (volume > 1.5 x the full 20-bar mean), +0.1 for MACD agreement, capped at 1;
* reasons: tags of every condition that held, buy tags first.

Threshold tests use exact integers: ``rsi < 30  <=>  70*gains < 30*losses``,
``rsi > 70  <=>  30*gains > 70*losses`` and ``ma_20 > ma_50  <=>
s20*n50 > s50*n20``, so the decision does not depend on float rounding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, IndicatorParams, StrategyParams
from ..functions import blocks as B
from ..functions.ewm import drop_row_index
from ..functions.windows import add_trailing_sums, by_symbol
from .indicators import _blocked_macd, _indicators, add_all_indicators, longest_window

SIGNAL_COLUMNS = [
    "signal", "signal_strength", "entry_reason", "ma_cross", "ma_cross_signal",
    "volume_avg", "volume_spike", "macd_bullish", "macd_bearish",
]


def _rsi_below(threshold: int) -> Column:
    g, l = F.col("_rsi_g"), F.col("_rsi_l")
    return (g * (100 - threshold)) < (l * threshold)


def _rsi_above(threshold: int) -> Column:
    g, l = F.col("_rsi_g"), F.col("_rsi_l")
    return (g * (100 - threshold)) > (l * threshold)


def generate_signals(
    bars: DataFrame,
    ind: IndicatorParams = DEFAULT.indicators,
    st: StrategyParams = DEFAULT.strategy,
    keep_helpers: bool = False,
    block_rows: int | None = None,
) -> DataFrame:
    """Bars -> bars + indicators + signal columns (one row per input bar).

    With ``block_rows`` no window holds a whole symbol (see ``functions.blocks``).
    """
    if block_rows:
        rows = B.deal(bars, block_rows, max(longest_window(ind), st.volume_window) + 1)
        df = _indicators(rows, ind, lambda out: _blocked_macd(out, rows, ind, block_rows))
        return drop_row_index(B.undeal(_rules(df.drop("_c", "_h", "_l", "_pc", "_c0"), ind, st, keep_helpers)))
    return drop_row_index(_rules(add_all_indicators(bars, ind, keep_sums=True, keep_index=True), ind, st, keep_helpers))


def _rules(df: DataFrame, ind: IndicatorParams, st: StrategyParams, keep_helpers: bool) -> DataFrame:
    if st.volume_window != ind.volume_period:
        n = st.volume_window
        df = add_trailing_sums(df.drop("_vs", "_vn"), {"_vs": (F.col("volume"), n)})
        df = df.withColumn("_vn", F.least(F.col("_ewm_rn") + 1, F.lit(n)).cast("long"))
    up = (F.col("_s_short") * F.col("_n_long")) > (F.col("_s_long") * F.col("_n_short"))
    cross = F.when(up, F.lit(1)).otherwise(F.lit(-1))
    df = df.withColumn("ma_cross", cross)
    df = df.withColumn("ma_cross_signal", F.col("ma_cross") - F.lag("ma_cross").over(by_symbol()))
    return finish_signals(df, st, keep_helpers)


def finish_signals(df: DataFrame, st: StrategyParams = DEFAULT.strategy, keep_helpers: bool = False) -> DataFrame:
    """Signal rules on a table that carries the exact helper sums."""
    cross = F.col("ma_cross_signal")
    oversold = _rsi_below(st.rsi_oversold)
    overbought = _rsi_above(st.rsi_overbought)
    cross_up = F.coalesce(cross == 2, F.lit(False))
    cross_down = F.coalesce(cross == -2, F.lit(False))
    buy = oversold | cross_up
    sell = overbought | cross_down
    signal = F.when(sell, "sell").when(buy, "buy").otherwise("hold")

    n_full = st.volume_window
    full = F.col("_vn") == n_full
    volume_avg = F.when(full, F.col("_vs") / F.lit(float(n_full)))
    # volume > factor * mean  <=>  volume * n > factor * sum  (factor 1.5 -> 2*n*v > 3*sum)
    spike = F.coalesce(full & (F.col("volume") * (2 * n_full) > F.col("_vs") * (2 * st.volume_spike_factor)), F.lit(False))
    bullish = F.col("macd") > F.col("macd_signal")
    bearish = F.col("macd") < F.col("macd_signal")

    lo, hi = float(st.rsi_oversold), float(st.rsi_overbought)
    buy_strength = (F.lit(lo) - F.col("rsi")) / F.lit(lo) * 0.5 + F.when(cross_up, 1.0).otherwise(0.0) * 0.5
    sell_strength = (F.col("rsi") - F.lit(hi)) / F.lit(100.0 - hi) * 0.5 + F.when(cross_down, 1.0).otherwise(0.0) * 0.5
    base = F.when(sell, sell_strength).when(buy, buy_strength).otherwise(F.lit(0.0))
    bonus = st.confirm_bonus
    vol_bonus = F.when((sell | buy) & spike, F.lit(bonus)).otherwise(F.lit(0.0))
    macd_bonus = F.when(sell, F.when(bearish, bonus).otherwise(0.0)).when(
        buy, F.when(bullish, bonus).otherwise(0.0)
    ).otherwise(0.0)
    strength = F.least((base + vol_bonus) + macd_bonus, F.lit(1.0))

    reason = F.concat_ws(
        " ",
        F.when(oversold, F.lit("RSI_OVERSOLD")),
        F.when(cross_up, F.lit("MA_CROSSOVER_UP")),
        F.when(overbought, F.lit("RSI_OVERBOUGHT")),
        F.when(cross_down, F.lit("MA_CROSSOVER_DOWN")),
    )
    out = df.select(
        "*",
        signal.alias("signal"),
        strength.alias("signal_strength"),
        reason.alias("entry_reason"),
        volume_avg.alias("volume_avg"),
        spike.alias("volume_spike"),
        F.coalesce(bullish, F.lit(False)).alias("macd_bullish"),
        F.coalesce(bearish, F.lit(False)).alias("macd_bearish"),
    )
    if not keep_helpers:
        out = out.drop("_rsi_g", "_rsi_l", "_s_short", "_n_short", "_s_long", "_n_long", "_vs", "_vn")
    return out


def signal_distribution(signals: DataFrame) -> DataFrame:
    """Count of bars per (symbol, signal)."""
    return signals.groupBy("symbol", "signal").agg(F.count(F.lit(1)).alias("n"))


def current_signals(signals: DataFrame) -> DataFrame:
    """The last bar of each symbol, kept only when it is not a hold."""
    # the order of the signal windows again: no second sort
    last = signals.withColumn("_next", F.lead("ts").over(by_symbol())).filter(F.col("_next").isNull())
    return last.filter(F.col("signal") != "hold").select(
        "symbol", "signal", F.col("close").alias("price"), "rsi", "ma_20", "ma_50", F.col("ts").alias("date")
    )


def position_size(capital: Column, price: Column, st: StrategyParams = DEFAULT.strategy) -> Column:
    """max(1, int(capital*risk / (price*stop))) ; fallback int(capital*0.1/price)."""
    risk = capital * st.risk_pct
    stop = price * st.stop_loss_pct
    main = F.floor(risk / stop)
    fallback = F.floor(F.try_divide(capital * 0.1, price))
    return F.greatest(F.lit(1), F.when(stop > 0, main).otherwise(fallback)).cast("long")


def stop_loss_price(price: Column, side: Column, st: StrategyParams = DEFAULT.strategy) -> Column:
    return F.when(side == "buy", price * (1 - st.stop_loss_pct)).otherwise(price * (1 + st.stop_loss_pct))


def take_profit_price(price: Column, side: Column, st: StrategyParams = DEFAULT.strategy) -> Column:
    return F.when(side == "buy", price * (1 + st.take_profit_pct)).otherwise(price * (1 - st.take_profit_pct))


def valid_signal(st: StrategyParams = DEFAULT.strategy) -> Column:
    """strength >= 0.3 and rsi, ma_20, ma_50 present."""
    return (
        (F.coalesce(F.col("signal_strength"), F.lit(0.0)) >= st.min_strength)
        & F.col("rsi").isNotNull()
        & F.col("ma_20").isNotNull()
        & F.col("ma_50").isNotNull()
    )

