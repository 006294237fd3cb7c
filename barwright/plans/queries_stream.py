"""Streaming queries, driven with availableNow and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.materialize import materialize
from ..operators.indicators import INDICATOR_COLUMNS as S_INDICATORS
from ..session import scratch_path
from ..sources import fixtures as FX
from ..streaming import bars as SB
from . import oracle as O
from .catalog import REGISTRY, register, rounded
from .queries_core import bars

DELAY_MIN = 10

# Closed windows: Spark emits a window in append mode once its end is at or
# below the watermark (max event time seen minus the delay).
_CLOSED = f"(SELECT max(CAST(ts AS TIMESTAMP)) - INTERVAL {DELAY_MIN} MINUTE FROM events)"


@register(
    "s_bars",
    f"""WITH k AS (
  SELECT event_type AS symbol, make_timestamp(epoch_us(CAST(ts AS TIMESTAMP)) // 300000000 * 300000000) AS ts,
         value AS price, CAST(ts AS TIMESTAMP) AS t0, event_id
  FROM events
)
SELECT symbol, ts, {O.proj('d:open=first(price ORDER BY t0, event_id), d:high=max(price), d:low=min(price), d:close=last(price ORDER BY t0, event_id), d:volume=count(*)')}
FROM k WHERE ts + INTERVAL 5 MINUTE <= {_CLOSED} GROUP BY symbol, ts""",
)
def q_s_bars(spark, sf_dir):
    ticks = SB.read_tick_stream(spark, f"{sf_dir}/events*.parquet")
    return rounded(SB.run_available_now(SB.stream_bars(ticks, "5 minutes", f"{DELAY_MIN} minutes"), "s_bars"))


@register(
    "s_sliding_volume",
    f"""WITH t AS (SELECT event_type AS symbol, CAST(ts AS TIMESTAMP) AS ts, value AS price FROM events),
starts AS (
  SELECT symbol, ts, price,
         unnest(generate_series(0, 3)) AS j,
         make_timestamp(epoch_us(ts) // 900000000 * 900000000) AS last_start
  FROM t
),
w AS (SELECT symbol, price, last_start - j * INTERVAL 15 MINUTE AS start FROM starts)
SELECT symbol, start, start + INTERVAL 1 HOUR AS "end", {O.proj('d:volume=count(*)')}, count(*) AS ticks, {O.proj('d:avg_price=avg(price)')}
FROM w WHERE start + INTERVAL 1 HOUR <= {_CLOSED} GROUP BY symbol, start""",
)
def q_s_sliding_volume(spark, sf_dir):
    ticks = SB.read_tick_stream(spark, f"{sf_dir}/events*.parquet")
    out = SB.run_available_now(SB.stream_sliding_volume(ticks, "1 hour", "15 minutes", f"{DELAY_MIN} minutes"),
                               "s_sliding_volume")
    return rounded(out)


@register(
    "s_current_signals",
    O.with_(O.bars_cte(), O.indicators_ctes(), O.signals_ctes(),
            "last AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rr FROM sig)")
    + "\nSELECT " + O.proj("symbol, signal, d:price=close, d:rsi, d:ma_20, d:ma_50, ts AS date")
    + " FROM last WHERE rr = 1 AND signal <> 'hold'",
)
def q_s_current_signals(spark, sf_dir):
    """Daily bars arrive as a stream (one file per year); each micro-batch
    carries the newest bars on and derives the current signals from them."""
    src = scratch_path(spark, "s_current_signals-src")
    b = bars(spark, sf_dir).withColumn("year", F.year("ts"))
    b.write.partitionBy("year").parquet(src)
    stream = spark.readStream.schema(b.schema).option("maxFilesPerTrigger", 4).parquet(src).drop("year")
    return rounded(SB.run_current_signals(stream))


# Ticks arrive in four waves, out of order by up to five minutes, which the watermark's ten minutes cover.
_NEAR_US = 300_000_000


def _tick_waves(spark, sf_dir, jitter_us):
    events = FX.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return SB.in_waves(events, micros, TICK_WAVES, jitter_us, F.col("event_id"))


@register("s_bars_waves", REGISTRY["s_bars"].sql)
def q_s_bars_waves(spark, sf_dir):
    """The closed bars when ticks arrive out of order in several files, with a restart after each wave."""
    waves = _tick_waves(spark, sf_dir, _NEAR_US)
    out = SB.run_in_waves(waves, lambda ev: SB.stream_bars(SB.event_ticks(ev), "5 minutes", f"{DELAY_MIN} minutes"), "s_bars_waves")
    return rounded(out)


@register("s_sliding_volume_waves", REGISTRY["s_sliding_volume"].sql)
def q_s_sliding_volume_waves(spark, sf_dir):
    waves = _tick_waves(spark, sf_dir, _NEAR_US)
    out = SB.run_in_waves(waves, lambda ev: SB.stream_sliding_volume(SB.event_ticks(ev), "1 hour", "15 minutes", f"{DELAY_MIN} minutes"),
                          "s_sliding_volume_waves")
    return rounded(out)


# Ticks arrive up to an hour late, in four waves; every seventh is sent again with the next wave.
TICK_JITTER_US, TICK_WAVES, TICK_DELAY = 3_600_000_000, 4, "30 days"


@register(
    "s_bars_corrected",
    f"""WITH k AS (
  SELECT event_type AS symbol, make_timestamp(epoch_us(CAST(ts AS TIMESTAMP)) // 300000000 * 300000000) AS ts,
         value AS price, CAST(ts AS TIMESTAMP) AS t0, event_id FROM events
)
SELECT symbol, ts, {O.proj('d:open=first(price ORDER BY t0, event_id), d:high=max(price), d:low=min(price), d:close=last(price ORDER BY t0, event_id), d:volume=count(*)')}
FROM k GROUP BY symbol, ts""",
)
def q_s_bars_corrected(spark, sf_dir):
    """Five-minute bars of a table that late ticks correct and repeated ticks do not change, over several files."""
    waves = _tick_waves(spark, sf_dir, TICK_JITTER_US)
    again = [w.unionByName(before.where("event_id % 7 = 0")) for before, w in zip(waves, waves[1:])]
    return rounded(SB.run_corrected_bars([waves[0], *again], SB.event_ticks, "5 minutes", TICK_DELAY))


def bar_waves(spark, sf_dir, count: int, jitter_days: int) -> list:
    """The daily bars in waves by time, each bar up to ``jitter_days`` late."""
    b = materialize(bars(spark, sf_dir))
    return SB.in_waves(b, F.unix_date("ts"), count, jitter_days, F.struct("symbol", "ts"))


@register("s_state", O.over_indicators(O.proj("symbol, ts, d:macd, d:macd_signal") + ", false AS late"))
def q_s_state(spark, sf_dir):
    """Daily bars arrive in four waves, oldest first; per-symbol state carries the EMAs across batches and restarts."""
    from ..streaming.state import streaming_macd

    return rounded(SB.run_in_waves(bar_waves(spark, sf_dir, 4, 0), streaming_macd, "s_state"))


# Bars arrive up to 20 days late and wait 30 days behind the newest: what is older than that is out.
JITTER_DAYS, WAIT_DAYS, WAVES = 20, 30, 4
_RELEASED = f"ts < (SELECT max(ts) - INTERVAL {WAIT_DAYS} DAY FROM bars)"


@register(
    "s_signals",
    O.with_(O.bars_cte(), O.indicators_ctes(), O.signals_ctes())
    + "\nSELECT " + O.proj(O.BAR_COLS + ", " + O.IND_COLS + ", signal, d:signal_strength, signal_reason, ma_cross, ma_cross_signal, "
                           "d:volume_avg, volume_spike, macd_bullish, macd_bearish").replace("signal_reason", "entry_reason AS signal_reason")
    + f" FROM sig WHERE {_RELEASED}",
)
def q_s_signals(spark, sf_dir):
    """All indicators and the signal of every bar, from a stream whose bars arrive out of order in four waves."""
    out = _engine(spark, sf_dir, "s_signals")
    return rounded(out.select(*SIGNAL_COLS))


@register(
    "s_trades",
    O.over_backtest(O.proj("symbol, date, action, quantity, d:price, d:value, d:commission, d:signal_strength, entry_reason, d:rsi, d:ma_20, d:ma_50, "
                           "d:pnl, exit_reason, d:cash_after, position_after"), "bt_trades",
                    "WHERE NOT final AND " + _RELEASED.replace("ts <", "date <")),
)
def q_s_trades(spark, sf_dir):
    """The backtest's trades, from the same stream; what is open stays open."""
    from ..streaming.engine import TRADE_COLUMNS, stream_trades

    return rounded(stream_trades(_engine(spark, sf_dir, "s_trades")).select(*[c for c in TRADE_COLUMNS if c != "seq"]))


SIGNAL_COLS = ["symbol", "ts", "open", "high", "low", "close", "volume", *S_INDICATORS, "signal", "signal_strength", "signal_reason", "ma_cross",
               "ma_cross_signal", "volume_avg", "volume_spike", "macd_bullish", "macd_bearish"]


def _engine(spark, sf_dir, name):
    from ..streaming.engine import stream_signals

    waves = bar_waves(spark, sf_dir, WAVES, JITTER_DAYS)
    return SB.run_in_waves(waves, lambda b: stream_signals(b, f"{WAIT_DAYS} days"), name)
