"""Bar scans, standardisation and the symbol universe."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.windows import SYMBOL, TS
from ..operators.cleaning import resample

BAR_SCHEMA = T.StructType([
    T.StructField("symbol", T.StringType(), False),
    T.StructField("ts", T.DateType(), False),
    T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("volume", T.DoubleType()),
])
REQUIRED = ["open", "high", "low", "close", "volume"]


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """Bars stored as parquet (ideally partitioned by date, clustered by symbol)."""
    return spark.read.parquet(path)


def scan_daily(bars: DataFrame, end: dt.date, days: int = 200, symbols: list[str] | None = None) -> DataFrame:
    """Bars with ``end - days <= ts < end`` (optionally for some symbols).

    Both predicates are plain column comparisons, so they reach the parquet
    scan as pushed filters (and prune date partitions).
    """
    start = end - dt.timedelta(days=days)
    out = bars.filter((F.col(TS) >= F.lit(start)) & (F.col(TS) < F.lit(end)))
    if symbols is not None:
        out = out.filter(F.col(SYMBOL).isin(list(symbols)))
    return out


def scan_intraday(
    ticks: DataFrame, interval: str = "5m", symbols: list[str] | None = None,
    start: dt.datetime | None = None, end: dt.datetime | None = None,
) -> DataFrame:
    """Bars of ``interval`` (1m, 5m, 15m, 1h) from the ticks with ``start <= ts < end``, optionally of some symbols.

    The bounds are plain comparisons on the tick time, so they reach the scan.
    """
    out = ticks
    if start is not None:
        out = out.filter(F.col(TS) >= F.lit(start).cast(ticks.schema[TS].dataType))
    if end is not None:
        out = out.filter(F.col(TS) < F.lit(end).cast(ticks.schema[TS].dataType))
    if symbols is not None:
        out = out.filter(F.col(SYMBOL).isin(list(symbols)))
    return resample(out, interval, tiebreak="seq" if "seq" in ticks.columns else None)


def standardize_bars(df: DataFrame, symbol: str | None = None) -> DataFrame:
    """Lower-case names, drop rows with any NULL, require OHLCV, round OHLC to cents.

    Rounding is half-to-even (``bround``), like the surveyed system's rounding.
    """
    df = df.toDF(*[c.lower() for c in df.columns])
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    if symbol is not None and SYMBOL not in df.columns:
        df = df.withColumn(SYMBOL, F.lit(symbol))
    df = df.dropna(how="any")
    return df.select(*[
        F.bround(F.col(c), 2).alias(c) if c in ("open", "high", "low", "close") else F.col(c) for c in df.columns
    ])


def latest_price(bars: DataFrame) -> DataFrame:
    return bars.groupBy(SYMBOL).agg(F.max_by("close", TS).alias("price"), F.max(TS).alias("ts"))


def scan_symbols(bars: DataFrame, universe: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bars of listed symbols, listed symbols without any bar).

    Semi/anti joins; Spark picks a broadcast only when its size estimate of the
    universe is under the broadcast threshold, otherwise a shuffled join.
    """
    u = universe.select(SYMBOL).distinct()
    hits = bars.join(u, SYMBOL, "left_semi")
    misses = u.join(bars.select(SYMBOL), SYMBOL, "left_anti")
    return hits, misses


def validate_symbols(bars: DataFrame, universe: DataFrame, as_of: dt.date, days: int = 5) -> DataFrame:
    """Per listed symbol: has at least one bar in the last ``days`` days before ``as_of``."""
    recent = scan_daily(bars, as_of, days).groupBy(SYMBOL).agg(F.count(F.lit(1)).alias("_n"))
    u = universe.select(SYMBOL).distinct()
    return u.join(recent, SYMBOL, "left").select(
        SYMBOL, (F.coalesce(F.col("_n"), F.lit(0)) > 0).alias("valid")
    )


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """Watch lists from a JSON object ``{name: [symbol, ...]}`` -> (name, position, symbol)."""
    raw = spark.read.option("multiLine", True).json(path)
    lists = F.map_from_arrays(
        F.array(*[F.lit(c) for c in raw.columns]), F.array(*[F.col(f"`{c}`") for c in raw.columns])
    )
    exploded = raw.select(F.explode(lists).alias("name", "symbols"))
    return exploded.select("name", F.posexplode("symbols").alias("position", SYMBOL))


def symbol_limit(universe: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` symbols of the configured order (a top-n by position)."""
    return universe.orderBy("position", SYMBOL).limit(n)
