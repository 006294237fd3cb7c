"""Scans, cleaning, derived columns, resampling and sinks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.materialize import materialize
from ..operators import cleaning as C
from ..operators import backtest as B
from ..operators import signals as S
from ..session import scratch_path
from ..sources import bars as SB
from ..sources import fixtures as FX
from ..sources import sinks as SK
from ..sources.store import BarStore
from . import oracle as O
from .catalog import register, rounded
from .queries_core import bars, signals

# Fixed parameters of the registered scans (explicit "as of" dates, never the clock).
SCAN_END = dt.date(1999, 1, 1)
SCAN_DAYS = 200
VALIDATE_AS_OF = dt.date(1998, 8, 3)
REPORT_AS_OF = dt.date(2001, 12, 31)
INTRADAY_SYMBOL = "purchase"
INTRADAY_START, INTRADAY_END = dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 15)
_start = SCAN_END - dt.timedelta(days=SCAN_DAYS)

# ------------------------------------------------------------------ scans


@register("scan_daily", O.over_bars(O.proj(O.BAR_COLS), f"WHERE ts >= DATE '{_start}' AND ts < DATE '{SCAN_END}'"))
def q_scan_daily(spark, sf_dir):
    b = FX.daily_bars(spark, sf_dir, start=_start, end=SCAN_END)
    return rounded(SB.scan_daily(b, SCAN_END, SCAN_DAYS))


TICKS_SQL = "ticks AS (SELECT event_type AS symbol, CAST(ts AS TIMESTAMP) AS ts, value AS price, 1.0 AS volume, event_id FROM events)"


def _resample_sql(width_us: int, name: str = "rs") -> str:
    return f"""{name}_k AS (
  SELECT symbol, make_timestamp(epoch_us(ts) // {width_us} * {width_us}) AS ts, price, volume, ts AS t0, event_id
  FROM ticks
),
{name} AS (
  SELECT symbol, ts, first(price ORDER BY t0, event_id) AS open, max(price) AS high, min(price) AS low,
         last(price ORDER BY t0, event_id) AS close, sum(volume) AS volume
  FROM {name}_k WHERE price IS NOT NULL GROUP BY symbol, ts
)"""


@register("scan_intraday", O.with_(TICKS_SQL, _resample_sql(300_000_000)) + "\nSELECT " + O.proj(O.BAR_COLS) + " FROM rs")
def q_scan_intraday(spark, sf_dir):
    return rounded(SB.scan_intraday(FX.event_ticks(spark, sf_dir), "5m"))


@register(
    "scan_intraday_range",
    O.with_(TICKS_SQL.replace("FROM events)", f"FROM events WHERE event_type = '{INTRADAY_SYMBOL}' AND ts >= TIMESTAMP '{INTRADAY_START}' AND ts < TIMESTAMP '{INTRADAY_END}')"),
            _resample_sql(900_000_000)) + "\nSELECT " + O.proj(O.BAR_COLS) + " FROM rs",
)
def q_scan_intraday_range(spark, sf_dir):
    ticks = FX.event_ticks(spark, sf_dir)
    return rounded(SB.scan_intraday(ticks, "15m", [INTRADAY_SYMBOL], INTRADAY_START, INTRADAY_END))


@register("resample", O.with_(TICKS_SQL, _resample_sql(3_600_000_000)) + "\nSELECT " + O.proj(O.BAR_COLS) + " FROM rs")
def q_resample(spark, sf_dir):
    return rounded(C.resample(FX.event_ticks(spark, sf_dir), "1h", tiebreak="seq"))


@register(
    "resample_daily",
    O.with_(TICKS_SQL, _resample_sql(86_400_000_000)) + "\nSELECT " + O.proj(O.BAR_COLS) + " FROM rs",
)
def q_resample_daily(spark, sf_dir):
    return rounded(C.resample(FX.event_ticks(spark, sf_dir), "1D", tiebreak="seq"))


def _coarser_sql(start: str) -> str:
    return O.with_(O.bars_cte()) + "\nSELECT " + O.proj(O.BAR_COLS) + f""" FROM (
  SELECT symbol, {start} AS ts, arg_min(open, bars.ts) AS open, max(high) AS high, min(low) AS low,
         arg_max(close, bars.ts) AS close, sum(volume) AS volume
  FROM bars GROUP BY symbol, {start}) b"""


@register("resample_weekly", _coarser_sql("CAST(date_trunc('week', bars.ts) AS DATE) + 6"))
def q_resample_weekly(spark, sf_dir):
    return rounded(C.resample_bars(bars(spark, sf_dir), "1W"))


@register("resample_monthly", _coarser_sql("CAST(date_trunc('month', bars.ts) AS DATE)"))
def q_resample_monthly(spark, sf_dir):
    return rounded(C.resample_bars(bars(spark, sf_dir), "1M"))


UNIVERSE_SQL = (
    "universe AS (SELECT DISTINCT 'MFGR_' || regexp_extract(p_brand, '#(\\d)', 1) AS name, p_brand AS symbol FROM part)"
)


@register("universe", O.with_(UNIVERSE_SQL) + "\nSELECT name, symbol FROM universe")
def q_universe(spark, sf_dir):
    return FX.derived_universe(spark, sf_dir)


# brands in the order of their first part, then tick symbols, which have no daily bars
WATCH_SQL = """watch AS (
  SELECT p_brand AS symbol, CAST(min(p_partkey) AS BIGINT) AS position FROM part WHERE starts_with(p_brand, 'Brand#1') GROUP BY p_brand
  UNION ALL SELECT event_type, CAST(min(event_id) AS BIGINT) + 1099511627776 FROM events GROUP BY event_type)"""


@register("symbol_limit", O.with_(WATCH_SQL) + "\nSELECT symbol FROM watch ORDER BY position, symbol LIMIT 3")
def q_symbol_limit(spark, sf_dir):
    return SB.symbol_limit(FX.watch_list(spark, sf_dir), 3).select("symbol")


@register("scan_symbols", O.with_(O.bars_cte(), WATCH_SQL) + "\nSELECT "
          + O.proj(O.BAR_COLS) + " FROM bars WHERE symbol IN (SELECT symbol FROM watch)")
def q_scan_symbols(spark, sf_dir):
    hits, _ = SB.scan_symbols(bars(spark, sf_dir), FX.watch_list(spark, sf_dir))
    return rounded(hits)


@register("scan_symbols_missing", O.with_(O.bars_cte(), WATCH_SQL)
          + "\nSELECT DISTINCT symbol FROM watch WHERE symbol NOT IN (SELECT symbol FROM bars)")
def q_scan_symbols_missing(spark, sf_dir):
    _, misses = SB.scan_symbols(bars(spark, sf_dir), FX.watch_list(spark, sf_dir))
    return misses


@register(
    "standardize_bars",
    O.with_(TICKS_SQL, _resample_sql(3_600_000_000))
    + "\nSELECT symbol, ts, " + O.proj(", ".join(f"d:{c}=round_even({c} / 7, 2)" for c in ("open", "high", "low", "close")) + ", d:volume")
    + " FROM rs WHERE hour(ts) <> 12",
)
def q_standardize_bars(spark, sf_dir):
    raw = C.resample(FX.event_ticks(spark, sf_dir), "1h", tiebreak="seq")
    # a vendor's feed: prices of a seventh lot, with parts of a cent, and no volume at noon
    vendor = raw.select(
        F.col("symbol").alias("Symbol"), "ts", *[(F.col(c) / 7).alias(c.title()) for c in ("open", "high", "low", "close")],
        F.when(F.hour("ts") != 12, F.col("volume")).alias("Volume"))
    return rounded(SB.standardize_bars(vendor).select(*["symbol", "ts", "open", "high", "low", "close", "volume"]))


@register("latest_price", O.over_bars(O.proj("symbol, d:price=max_by(close, ts), max(ts) AS ts"), "GROUP BY symbol"))
def q_latest_price(spark, sf_dir):
    return rounded(SB.latest_price(bars(spark, sf_dir)))


@register(
    "validate_symbols",
    O.with_(O.bars_cte(), UNIVERSE_SQL)
    + f"""
SELECT u.symbol, count(b.ts) > 0 AS valid
FROM (SELECT DISTINCT symbol FROM universe) u
LEFT JOIN bars b ON b.symbol = u.symbol AND b.ts >= DATE '{VALIDATE_AS_OF - dt.timedelta(days=5)}' AND b.ts < DATE '{VALIDATE_AS_OF}'
GROUP BY u.symbol""",
)
def q_validate_symbols(spark, sf_dir):
    return SB.validate_symbols(bars(spark, sf_dir), FX.derived_universe(spark, sf_dir), VALIDATE_AS_OF, 5)


# ------------------------------------------------------------------ cleaning


@register("dedup", O.over_bars("DISTINCT " + O.proj(O.BAR_COLS)))
def q_dedup(spark, sf_dir):
    """Every bar, those of list MFGR_1 twice."""
    b = bars(spark, sf_dir)
    return rounded(C.dedup(b.unionByName(b.where(F.col("symbol").startswith("Brand#1")))))


HOURLY_GRID_SQL = """grid AS (
  SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM rs GROUP BY symbol
),
gapped AS (SELECT g.symbol, g.ts, r.open, r.high, r.low, r.close, r.volume FROM grid g LEFT JOIN rs r USING (symbol, ts))"""


def _fill(c: str) -> str:
    return (f"coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
            f"first_value({c} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))")


@register(
    "ffill_bfill",
    O.with_(TICKS_SQL, _resample_sql(3_600_000_000), HOURLY_GRID_SQL)
    + "\nSELECT symbol, ts, " + ", ".join(O.r(_fill(c), c) for c in ["open", "high", "low", "close", "volume"])
    + " FROM gapped",
)
def q_ffill_bfill(spark, sf_dir):
    hourly = C.resample(FX.event_ticks(spark, sf_dir), "1h", tiebreak="seq")
    return rounded(C.ffill_bfill(C.regular_grid(hourly, "1 hour")).select(
        "symbol", "ts", "open", "high", "low", "close", "volume"))


@register(
    "outlier_filter",
    O.with_(O.bars_cte(scaled=False))
    + "\nSELECT " + O.proj(O.BAR_COLS) + " FROM (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1.0 AS chg FROM bars) WHERE abs(chg) < 0.2",
)
def q_outlier_filter(spark, sf_dir):
    return rounded(C.outlier_filter(FX.daily_bars(spark, sf_dir, scaled=False)))


@register(
    "coerce_numeric",
    "SELECT event_type AS symbol, CAST(ts AS TIMESTAMP) AS ts, "
    "TRY_CAST(json_extract_string(props, '$.k') || CASE WHEN event_type = 'click' THEN ' units' ELSE '' END AS DOUBLE) AS k FROM events",
)
def q_coerce_numeric(spark, sf_dir):
    ev = FX.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("ts"),
        # clicks carry a unit, which no number has
        F.concat(F.get_json_object("props", "$.k"), F.when(F.col("event_type") == "click", " units").otherwise("")).alias("k"),
    )
    return C.coerce_numeric(ev, ["k"])


_PC = "{c} / lag({c}) OVER (PARTITION BY symbol ORDER BY ts) - 1.0"


@register(
    "derive_price",
    O.over_bars(O.proj("symbol, ts, d:price_change=" + _PC.format(c="close")
                       + ", d:high_low_ratio=high / nullif(low, 0), d:open_close_ratio=open / nullif(close, 0)")),
)
def q_derive_price(spark, sf_dir):
    return rounded(C.derive_price(bars(spark, sf_dir)).select("symbol", "ts", "price_change", "high_low_ratio", "open_close_ratio"))


@register(
    "derive_volume",
    O.over_bars(O.proj("symbol, ts, d:volume_change=" + _PC.format(c="volume")
                       + ", d:volume_price_trend=volume * (" + _PC.format(c="close") + ")")),
)
def q_derive_volume(spark, sf_dir):
    return rounded(C.derive_volume(bars(spark, sf_dir)).select("symbol", "ts", "volume_change", "volume_price_trend"))


@register(
    "derive_volatility",
    O.with_(O.bars_cte(), "pc AS (SELECT symbol, ts, " + _PC.format(c="close") + " AS pc FROM bars)")
    + "\nSELECT " + O.proj(
        "symbol, ts, "
        "d:volatility_5d=CASE WHEN count(pc) OVER w5 = 5 THEN stddev_samp(pc) OVER w5 END, "
        "d:volatility_20d=CASE WHEN count(pc) OVER w20 = 20 THEN stddev_samp(pc) OVER w20 END")
    + " FROM pc WINDOW w5 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),"
      " w20 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)",
)
def q_derive_volatility(spark, sf_dir):
    return rounded(C.derive_volatility(bars(spark, sf_dir)).select("symbol", "ts", "volatility_5d", "volatility_20d"))


@register(
    "derive_gap",
    O.over_bars(O.proj("symbol, ts, d:gap=(open - lag(close) OVER (PARTITION BY symbol ORDER BY ts)) "
                       "/ nullif(lag(close) OVER (PARTITION BY symbol ORDER BY ts), 0)")),
)
def q_derive_gap(spark, sf_dir):
    return rounded(C.derive_gap(bars(spark, sf_dir)).select("symbol", "ts", "gap"))


# ------------------------------------------------------------------ sinks


def _yesterday():
    return {"updated": F.lit(REPORT_AS_OF - dt.timedelta(days=1))}


def published(spark, df, name, stale):
    """The report ``df`` after an earlier report (every symbol twice, with ``stale`` columns) was published at the same path."""
    path = scratch_path(spark, name)
    df = materialize(df)
    old = df.withColumns(stale)
    SK.publish(old.unionByName(old), path)
    return SK.publish(df, path)





@register(
    "sink_trading_log",
    O.over_backtest(
        O.proj("date, symbol, upper(action) AS action, quantity, d:price, d:value, d:commission, d:signal_strength, "
               f"entry_reason, d:rsi, d:ma_20, d:ma_50, d:pnl, 'BACKTEST' AS mode, DATE '{REPORT_AS_OF}' AS updated"),
        "bt_trades"),
)
def q_sink_trading_log(spark, sf_dir):
    led = B.run_backtest(signals(spark, sf_dir))
    return published(spark, rounded(SK.trading_log(led, REPORT_AS_OF)), "trading_log", _yesterday())


@register(
    "sink_performance",
    O.over_backtest(O.proj("symbol, start_date, end_date, d:initial_capital, d:final_value, d:total_return, "
                           "total_trades, d:win_rate, d:max_drawdown, d:sharpe_ratio"), "bt_summary"),
)
def q_sink_performance(spark, sf_dir):
    from .queries_backtest import _summary

    return published(spark, rounded(SK.performance(_summary(spark, sf_dir))), "performance", {"final_value": F.lit(0.0)})


@register(
    "sink_signals",
    O.with_(O.bars_cte(), O.indicators_ctes(), O.signals_ctes(),
            "last AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rr FROM sig)")
    + "\nSELECT " + O.proj(f"symbol, upper(signal) AS signal, d:price=close, d:rsi, d:ma_20, d:ma_50, ts AS date, "
                           f"DATE '{REPORT_AS_OF}' AS updated")
    + " FROM last WHERE rr = 1 AND signal <> 'hold'",
)
def q_sink_signals(spark, sf_dir):
    cur = S.current_signals(signals(spark, sf_dir))
    return published(spark, rounded(SK.signals_table(cur, REPORT_AS_OF)), "signals", _yesterday())


@register(
    "sink_log_by_symbol",
    O.over_backtest(
        O.proj("date, symbol, upper(action) AS action, quantity, d:price, d:value, d:commission, d:signal_strength, "
               f"entry_reason, d:rsi, d:ma_20, d:ma_50, d:pnl, 'BACKTEST' AS mode, "
               f"CASE WHEN symbol LIKE '%2' THEN DATE '{REPORT_AS_OF}' ELSE DATE '{REPORT_AS_OF}' - 1 END AS updated"),
        "bt_trades"),
)
def q_sink_log_by_symbol(spark, sf_dir):
    """Yesterday's trading log, in which only the symbols that end in 2 are published again."""
    path = scratch_path(spark, "trading_log_by_symbol")
    log = materialize(rounded(SK.trading_log(B.run_backtest(signals(spark, sf_dir)), REPORT_AS_OF)))
    SK.publish(log.withColumns(_yesterday()), path)
    return SK.republish(log.where(F.col("symbol").endswith("2")), path)


# ------------------------------------------------------------------ bar store, watch lists in JSON

# Bars of list MFGR_1 end here, so that their newest prices lie in older periods of the store.
DELISTED = dt.date(1996, 1, 1)


@register(
    "latest_price_store",
    O.over_bars(O.proj("symbol, d:price=max_by(close, ts), max(ts) AS ts"),
                f"WHERE NOT (symbol LIKE 'Brand#1%' AND ts >= DATE '{DELISTED}') GROUP BY symbol"),
)
def q_latest_price_store(spark, sf_dir):
    """Newest prices of all listed symbols from stored bars: newest period first, older ones for the symbols still missing."""
    kept = bars(spark, sf_dir).where(~(F.col("symbol").startswith("Brand#1") & (F.col("ts") >= F.lit(DELISTED))))
    store = BarStore(spark, scratch_path(spark, "bar-store")).write(kept)
    listed = (FX.derived_universe(spark, sf_dir).select("symbol")
              .union(FX.table(spark, sf_dir, "events").select("event_type")).distinct())
    found, _ = store.latest_price(listed)
    return rounded(found)


@register("universe_json", O.with_(UNIVERSE_SQL) + """
SELECT name, CAST(row_number() OVER (PARTITION BY name ORDER BY symbol) - 1 AS INTEGER) AS position, symbol FROM universe""")
def q_universe_json(spark, sf_dir):
    """The watch lists written as the JSON file they come in, and read from it."""
    lists = FX.derived_universe(spark, sf_dir).groupBy("name").agg(F.sort_array(F.collect_list("symbol")).alias("symbols"))
    path = scratch_path(spark, "universe-json")
    whole = lists.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("name", "symbols")))).alias("value"))  # one small file, as it is kept
    whole.coalesce(1).write.text(path)
    return SB.read_universe(spark, path)


@register(
    "ffill_bfill_head",
    O.with_(TICKS_SQL, _resample_sql(3_600_000_000), HOURLY_GRID_SQL.replace("gapped AS", "gapped0 AS"), """heads AS (
  SELECT symbol, min(ts) + INTERVAL 5 HOUR AS known FROM gapped0 GROUP BY symbol),
gapped AS (SELECT g.symbol, g.ts, """ + ", ".join(f"CASE WHEN g.ts >= known THEN {c} END AS {c}" for c in C.OHLCV)
            + " FROM gapped0 g JOIN heads USING (symbol))")
    + "\nSELECT symbol, ts, " + ", ".join(O.r(_fill(c), c) for c in C.OHLCV) + " FROM gapped",
)
def q_ffill_bfill_head(spark, sf_dir):
    """Hourly bars whose first five hours of each symbol are missing: only the backward fill reaches them."""
    grid = C.regular_grid(C.resample(FX.event_ticks(spark, sf_dir), "1h", tiebreak="seq"), "1 hour")
    heads = grid.groupBy("symbol").agg((F.min("ts") + F.expr("INTERVAL 5 HOUR")).alias("known"))
    gapped = grid.join(heads, "symbol").select("symbol", "ts", *[F.when(F.col("ts") >= F.col("known"), F.col(c)).alias(c) for c in C.OHLCV])
    return rounded(C.ffill_bfill(gapped).select("symbol", "ts", *C.OHLCV))
