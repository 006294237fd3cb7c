"""Cleaning, derived columns and resampling of bar / tick tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.windows import SYMBOL, TS, by_symbol, trailing

OHLCV = ["open", "high", "low", "close", "volume"]


def dedup(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Drop fully identical rows; the key columns (symbol, ts) are part of the row."""
    return df.dropDuplicates(subset) if subset else df.dropDuplicates()


def ffill_bfill(df: DataFrame, cols: list[str] | None = None, order: str = TS) -> DataFrame:
    """Forward fill, then backward fill, each column within its symbol."""
    cols = cols or [c for c in df.columns if c not in (SYMBOL, order)]
    w = by_symbol(order)
    fwd = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # after the forward fill only the head is left, and all of it takes the symbol's first value
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = []
    for c in df.columns:
        if c in cols:
            filled = F.coalesce(F.last(c, ignorenulls=True).over(fwd), F.first(c, ignorenulls=True).over(whole))
            out.append(filled.alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def pct_change(c: str, order: str = TS) -> Column:
    """``x / previous x - 1``; NULL on the first row and for a zero previous value."""
    prev = F.lag(c).over(by_symbol(order))
    return F.try_divide(F.col(c), prev) - F.lit(1.0)


def outlier_filter(df: DataFrame, threshold: float = 0.20, order: str = TS) -> DataFrame:
    """Keep rows whose close moved less than ``threshold`` from the previous row.

    The first row has no change and is dropped (NULL fails the test).
    """
    flagged = df.withColumn("_chg", pct_change("close", order))
    return flagged.filter(F.abs(F.col("_chg")) < F.lit(threshold)).drop("_chg")


def coerce_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """Parse text columns as double; unparsable values become NULL."""
    return df.select(*[
        F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(c) if c in cols else F.col(c) for c in df.columns
    ])


def derive_price(df: DataFrame) -> DataFrame:
    return (
        df.withColumn("price_change", pct_change("close"))
        .withColumn("high_low_ratio", F.try_divide(F.col("high"), F.col("low")))
        .withColumn("open_close_ratio", F.try_divide(F.col("open"), F.col("close")))
    )


def derive_volume(df: DataFrame) -> DataFrame:
    if "price_change" not in df.columns:
        df = df.withColumn("price_change", pct_change("close"))
    return df.withColumn("volume_change", pct_change("volume")).withColumn(
        "volume_price_trend", F.col("volume") * F.col("price_change")
    )


def rolling_std_full(c: str, n: int) -> Column:
    """Sample std over the last ``n`` rows, only where all ``n`` values exist."""
    w = trailing(n)
    return F.when(F.count(c).over(w) == n, F.stddev_samp(c).over(w))


def derive_volatility(df: DataFrame) -> DataFrame:
    if "price_change" not in df.columns:
        df = df.withColumn("price_change", pct_change("close"))
    return df.withColumn("volatility_5d", rolling_std_full("price_change", 5)).withColumn(
        "volatility_20d", rolling_std_full("price_change", 20)
    )


def derive_gap(df: DataFrame) -> DataFrame:
    prev = F.lag("close").over(by_symbol())
    return df.withColumn("gap", F.try_divide(F.col("open") - prev, prev))


# ---------------------------------------------------------------- resampling

_FIXED = {
    "1min": "1 minute", "1m": "1 minute", "5min": "5 minutes", "5m": "5 minutes",
    "15min": "15 minutes", "15m": "15 minutes", "1h": "1 hour", "1H": "1 hour", "60min": "1 hour",
    "1D": "1 day", "1d": "1 day",
}


def bin_start(ts: Column, timeframe: str) -> Column:
    """Start of the bin containing ``ts`` (UTC); weeks end on Sunday, months start on day 1."""
    if timeframe in _FIXED:
        return F.window(ts, _FIXED[timeframe]).start
    if timeframe in ("1W", "W"):
        return F.date_add(F.date_trunc("week", ts).cast("date"), 6)  # labelled by the closing Sunday
    if timeframe in ("1M", "M", "1MS", "MS"):
        return F.date_trunc("month", ts).cast("date")
    raise ValueError(f"unsupported timeframe {timeframe!r}")


def tick_order(ticks: DataFrame, tiebreak: str) -> Column:
    """(ts, tiebreak) as one DECIMAL(38, 0), which hash aggregation can hold (a struct key sorts every map task)."""
    if isinstance(ticks.schema["ts"].dataType, T.TimestampNTZType):
        micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    else:
        micros = F.unix_micros("ts")
    return (micros.cast("decimal(19,0)") * F.lit(10**18).cast("decimal(19,0)") * F.lit(10) + F.col(tiebreak)).cast("decimal(38,0)")


def resample_bars(bars: DataFrame, timeframe: str) -> DataFrame:
    """OHLCV bars of a coarser ``timeframe`` from OHLCV bars: first open, max high, min low, last close, summed volume."""
    keyed = bars.select(SYMBOL, bin_start(F.col(TS), timeframe).alias("_bin"), TS, *OHLCV)
    out = keyed.groupBy(SYMBOL, "_bin").agg(
        F.min_by("open", TS).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", TS).alias("close"), F.sum("volume").alias("volume"),
    )
    return out.withColumnRenamed("_bin", TS)


def resample(
    ticks: DataFrame,
    timeframe: str = "1D",
    price: str = "price",
    volume: str = "volume",
    tiebreak: str | None = None,
) -> DataFrame:
    """OHLCV per ``(symbol, bin)``: first / max / min / last price, summed volume.

    Ticks with a NULL price are ignored for open and close; bins without any
    price are dropped.  Ticks of one instant are ordered by ``tiebreak`` (a long).
    Grouping by ``(symbol, bin)`` spreads a hot symbol over many reducers, and
    the partial aggregation runs map-side.
    """
    order = tick_order(ticks, tiebreak) if tiebreak else F.col("ts")
    has_price = F.col(price).isNotNull()
    keyed = ticks.select(
        SYMBOL,
        bin_start(F.col("ts"), timeframe).alias("ts"),
        F.col(price).alias("_p"),
        F.col(volume).alias("_v"),
        F.when(has_price, order).alias("_o"),
    )
    bars = keyed.groupBy(SYMBOL, "ts").agg(
        F.min_by("_p", "_o").alias("open"),
        F.max("_p").alias("high"),
        F.min("_p").alias("low"),
        F.max_by("_p", "_o").alias("close"),
        F.sum("_v").alias("volume"),
    )
    return bars.filter(F.col("close").isNotNull())


def regular_grid(bars: DataFrame, step: str = "1 hour") -> DataFrame:
    """Every bin between a symbol's first and last bar, with the bar columns (NULL in gaps)."""
    span = bars.groupBy(SYMBOL).agg(F.min("ts").alias("_lo"), F.max("ts").alias("_hi"))
    grid = span.select(SYMBOL, F.explode(F.expr(f"sequence(_lo, _hi, interval {step})")).alias("ts"))
    return grid.join(bars, [SYMBOL, "ts"], "left")
