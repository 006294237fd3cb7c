"""Technical indicators as window functions over ``(symbol, ts)``.

Each function takes a bar table (``symbol ts open high low close volume``)
and returns it with indicator columns added.  Trailing windows are partial at
the start of a series (the first row is a window of one).

Execution: one hash exchange on ``symbol`` and one sort on ``(symbol, ts)``
feed every trailing window.  Trailing sums are running sums minus the running
sum ``n`` rows back (O(1) per row, see ``add_trailing_sums``) on integer cents,
so they are exact and independent of evaluation order; only the 14-row
min/max of the stochastic and the 3-row mean of %D use bounded frames.
Columns are built in a few wide ``select``s rather than long ``withColumn``
chains, which keeps analysis time flat.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, PRICE_SCALE, IndicatorParams
from ..functions import blocks as B
from ..functions.ewm import _RN, adjusted_ema, chunk_rows, drop_row_index
from ..functions.windows import add_trailing_sums, by_symbol, cents, ddiv, trailing

INDICATOR_COLUMNS = [
    "rsi", "ma_20", "ma_50", "macd", "macd_signal", "macd_histogram",
    "bb_upper", "bb_middle", "bb_lower", "volume_sma", "atr", "stoch_k", "stoch_d",
]


def _prepare(df: DataFrame) -> DataFrame:
    """Cents columns, previous close, first close and the row index (one Window node).

    Rows dealt in blocks bring the index and the symbol's first close with them.
    """
    w = by_symbol()
    c = cents("close")
    given = {"_x0": F.first("close").over(w), _RN: (F.row_number().over(w) - 1).cast("long")}
    return df.select(
        "*",
        c.alias("_c"),
        cents("high").alias("_h"),
        cents("low").alias("_l"),
        F.lag(c).over(w).alias("_pc"),
        F.first(c).over(w).alias("_c0"),
        *[value.alias(name) for name, value in given.items() if name not in df.columns],
    )


_PREP = ["_c", "_h", "_l", "_pc", "_c0", "_x0"]


def _n(period: int) -> Column:
    return F.least(F.col(_RN) + 1, F.lit(period)).cast("long")


def _mean_cents(s: str, period: int) -> Column:
    return F.col(s).cast("double") / (_n(period) * PRICE_SCALE).cast("double")


def rsi_from_sums(g: str = "_rsi_g", l: str = "_rsi_l") -> Column:
    sg, sl = F.col(g), F.col(l)
    value = F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + sg.cast("double") / sl.cast("double"))
    return F.when(sl == 0, F.when(sg == 0, F.lit(50.0)).otherwise(F.lit(100.0))).otherwise(value)


def _rsi_specs(period: int) -> dict:
    d = F.col("_c") - F.col("_pc")
    # greatest() skips NULL, so the first row's gain and loss are 0 (not missing)
    return {"_rsi_g": (F.greatest(d, F.lit(0)), period), "_rsi_l": (F.greatest(-d, F.lit(0)), period)}


def _std_from(s1: str, s2: str, period: int) -> Column:
    """Sample std (price units) from exact sums of centred cents and their squares."""
    n = _n(period)
    var = (n * F.col(s2) - F.col(s1) * F.col(s1)).cast("double") / (n * (n - 1)).cast("double")
    return F.when(n > 1, F.sqrt(var) / float(PRICE_SCALE))


def _finish(df: DataFrame) -> DataFrame:
    return drop_row_index(df.drop(*_PREP))


def rsi(df: DataFrame, period: int = 14, keep_sums: bool = False) -> DataFrame:
    out = add_trailing_sums(_prepare(df), _rsi_specs(period)).withColumn("rsi", rsi_from_sums())
    return _finish(out if keep_sums else out.drop("_rsi_g", "_rsi_l"))


def sma(df: DataFrame, period: int, name: str | None = None, source: str = "close") -> DataFrame:
    out = add_trailing_sums(_prepare(df), {"_s": (cents(source), period)})
    return _finish(out.withColumn(name or f"ma_{period}", _mean_cents("_s", period)).drop("_s"))


def _centered(df: DataFrame, source: str) -> DataFrame:
    """Add ``_x0`` (first value of the symbol) and ``_xc = source - _x0``.

    EMA is shift-equivariant; centring makes a constant run exactly 0, so
    MACD ties (macd == signal) stay ties instead of float noise.
    """
    if "_x0" not in df.columns:
        df = df.withColumn("_x0", F.first(source).over(by_symbol()))
    return df.withColumn("_xc", F.col(source) - F.col("_x0"))


def ema(df: DataFrame, span: int, name: str | None = None, source: str = "close") -> DataFrame:
    out = adjusted_ema(_centered(df, source), {"_ema": ("_xc", span)})
    out = out.withColumn(name or f"ema_{span}", F.col("_ema") + F.col("_x0"))
    return drop_row_index(out.drop("_ema", "_x0", "_xc"))


def _macd_on(df: DataFrame, fast: int, slow: int, signal: int) -> DataFrame:
    chunk = chunk_rows([fast, slow, signal])  # one layout for both passes, where one fits
    out = adjusted_ema(_centered(df, "close"), {"_ema_fast": ("_xc", fast), "_ema_slow": ("_xc", slow)}, chunk)
    out = out.withColumn("macd", F.col("_ema_fast") - F.col("_ema_slow")).drop("_ema_fast", "_ema_slow", "_xc")
    out = adjusted_ema(out, {"macd_signal": ("macd", signal)}, chunk)
    return out.withColumn("macd_histogram", F.col("macd") - F.col("macd_signal"))


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, keep_index: bool = False) -> DataFrame:
    out = _macd_on(df, fast, slow, signal).drop("_x0")
    return out if keep_index else drop_row_index(out)


def bollinger(df: DataFrame, period: int = 20, n_std: int = 2) -> DataFrame:
    out = _prepare(df)
    cc = F.col("_c") - F.col("_c0")
    out = add_trailing_sums(out, {"_bs": (F.col("_c"), period), "_b1": (cc, period), "_b2": (cc * cc, period)}, bounded=("_b2",))
    out = out.select("*", _mean_cents("_bs", period).alias("bb_middle"), _std_from("_b1", "_b2", period).alias("_bsd"))
    out = out.select(
        "*",
        (F.col("bb_middle") + F.col("_bsd") * float(n_std)).alias("bb_upper"),
        (F.col("bb_middle") - F.col("_bsd") * float(n_std)).alias("bb_lower"),
    ).drop("_bs", "_b1", "_b2", "_bsd")
    return _finish(out)


def _stoch_raw(k_period: int) -> Column:
    wk = trailing(k_period)
    lo = F.min("_l").over(wk)
    hi = F.max("_h").over(wk)
    return F.lit(100.0) * ddiv(F.col("_c") - lo, hi - lo)  # NULL on a zero range


def _stoch_finish(df: DataFrame, d_period: int) -> DataFrame:
    # D is the mean of the unfilled K (missing values skipped); both filled last.
    w3 = trailing(d_period)
    d = F.try_divide(F.sum("_k_raw").over(w3), F.count("_k_raw").over(w3))
    return df.select(
        "*", F.coalesce("_k_raw", F.lit(50.0)).alias("stoch_k"), F.coalesce(d, F.lit(50.0)).alias("stoch_d")
    ).drop("_k_raw")


def stochastic(df: DataFrame, k_period: int = 14, d_period: int = 3) -> DataFrame:
    out = _prepare(df).select("*", _stoch_raw(k_period).alias("_k_raw"))
    return _finish(_stoch_finish(out, d_period))


def volume_sma(df: DataFrame, period: int = 20) -> DataFrame:
    out = add_trailing_sums(_prepare(df), {"_vs": (F.col("volume"), period)}, bounded=("_vs",))
    return _finish(out.withColumn("volume_sma", F.col("_vs") / _n(period)).drop("_vs"))


def _tr() -> Column:
    h, l, pc = F.col("_h"), F.col("_l"), F.col("_pc")
    return F.greatest(h - l, F.abs(h - pc), F.abs(l - pc))  # first row: high - low


def atr(df: DataFrame, period: int = 14) -> DataFrame:
    out = add_trailing_sums(_prepare(df), {"_trs": (_tr(), period)})
    return _finish(out.withColumn("atr", F.coalesce(_mean_cents("_trs", period), F.lit(0.0))).drop("_trs"))


HELPER_SUMS = ["_rsi_g", "_rsi_l", "_s_short", "_n_short", "_s_long", "_n_long", "_vs", "_vn"]


def longest_window(p: IndicatorParams) -> int:
    return max(p.rsi_period, p.ma_short, p.ma_long, p.bb_period, p.volume_period, p.atr_period, p.stoch_k + p.stoch_d)


def _blocked_macd(out: DataFrame, rows: DataFrame, p: IndicatorParams, block_rows: int) -> DataFrame:
    """MACD on rows dealt in blocks: two scans, each with a table of carries, the second over the first's result."""
    fast_slow = {"_ema_fast": ("_xc", p.macd_fast), "_ema_slow": ("_xc", p.macd_slow)}
    keys = [B.SYMBOL, "ts", B.BLOCK, B.HALO, _RN]

    def lines(df: DataFrame, thin: DataFrame) -> DataFrame:
        both = B.carried_ema(_centered(df, "close"), _centered(thin, "close"), fast_slow, block_rows)
        return both.withColumn("macd", F.col("_ema_fast") - F.col("_ema_slow")).drop("_ema_fast", "_ema_slow", "_xc")

    thin = rows.select(*keys, "close", B.FIRST)
    signal = B.carried_ema(lines(out, thin), lines(thin, thin).select(*keys, "macd"), {"macd_signal": ("macd", p.macd_signal)}, block_rows)
    return signal.withColumn("macd_histogram", F.col("macd") - F.col("macd_signal"))


def add_all_indicators(
    df: DataFrame,
    p: IndicatorParams = DEFAULT.indicators,
    keep_sums: bool = False,
    keep_index: bool = False,
    block_rows: int | None = None,
) -> DataFrame:
    """Bars + the 13 indicator columns.

    Columns are always named ``ma_20`` / ``ma_50`` whatever the periods are.
    With ``keep_sums`` the exact helper sums used by the signal rules are kept
    (``HELPER_SUMS``; ``_vs``/``_vn`` are the volume sum and count over the
    volume period).

    ``block_rows`` runs every window per block of so many rows of a symbol
    instead of per symbol (``functions.blocks``), for symbols of millions of
    bars; values are the same.
    """
    if block_rows:
        rows = B.deal(df, block_rows, longest_window(p) + 1)
        out = drop_helpers(_indicators(rows, p, lambda out: _blocked_macd(out, rows, p, block_rows)), keep_sums, True)
        out = B.undeal(out)
        return out if keep_index else drop_row_index(out)
    out = _indicators(df, p, lambda out: _macd_on(out, p.macd_fast, p.macd_slow, p.macd_signal))
    return drop_helpers(out, keep_sums, keep_index)


def drop_helpers(df: DataFrame, keep_sums: bool, keep_index: bool) -> DataFrame:
    out = df.drop(*_PREP)
    if not keep_sums:
        out = out.drop(*HELPER_SUMS)
    return out if keep_index else drop_row_index(out)


def _indicators(df: DataFrame, p: IndicatorParams, with_macd: Callable[[DataFrame], DataFrame]) -> DataFrame:
    out = _prepare(df)
    cc = F.col("_c") - F.col("_c0")
    specs = {
        **_rsi_specs(p.rsi_period),
        "_s_short": (F.col("_c"), p.ma_short),
        "_s_long": (F.col("_c"), p.ma_long),
        "_bs": (F.col("_c"), p.bb_period),
        "_b1": (cc, p.bb_period),
        "_b2": (cc * cc, p.bb_period),
        "_vs": (F.col("volume"), p.volume_period),
        "_trs": (_tr(), p.atr_period),
    }
    out = add_trailing_sums(out, specs, bounded=("_b2", "_vs")).select("*", _stoch_raw(p.stoch_k).alias("_k_raw"))
    out = out.select(
        "*",
        rsi_from_sums().alias("rsi"),
        _mean_cents("_s_short", p.ma_short).alias("ma_20"),
        _mean_cents("_s_long", p.ma_long).alias("ma_50"),
        _mean_cents("_bs", p.bb_period).alias("bb_middle"),
        _std_from("_b1", "_b2", p.bb_period).alias("_bsd"),
        (F.col("_vs") / _n(p.volume_period)).alias("volume_sma"),
        F.coalesce(_mean_cents("_trs", p.atr_period), F.lit(0.0)).alias("atr"),
        _n(p.ma_short).alias("_n_short"),
        _n(p.ma_long).alias("_n_long"),
        _n(p.volume_period).alias("_vn"),
    )
    out = out.select(
        "*",
        (F.col("bb_middle") + F.col("_bsd") * float(p.bb_std)).alias("bb_upper"),
        (F.col("bb_middle") - F.col("_bsd") * float(p.bb_std)).alias("bb_lower"),
    ).drop("_bs", "_b1", "_b2", "_bsd", "_trs")
    return with_macd(_stoch_finish(out, p.stoch_d))
