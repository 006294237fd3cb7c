"""The stream's indicators, signals and trades equal the batch operators, whatever order bars arrive in; bars that late ticks correct."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barwright.operators import backtest as B
from barwright.operators import indicators as I
from barwright.operators import signals as S
from barwright.sources.bars import BAR_SCHEMA
from barwright.streaming import bars as SB
from barwright.streaming import engine as E

START = dt.date(2020, 1, 1)


def walk(symbol, days, seed):
    rng = np.random.default_rng(seed)
    close = (80 + np.cumsum(rng.integers(-250, 251, days)) / 100).round(2).clip(2)
    close[40:70] = close[min(40, days - 1)]  # a run without a change: zero ranges, RSI of 50
    high, low = close + rng.integers(0, 2, days), close - rng.integers(0, 2, days)
    return pd.DataFrame({"symbol": symbol, "ts": [START + dt.timedelta(days=i) for i in range(days)], "open": close, "high": high, "low": low,
                         "close": close, "volume": 1.0 * rng.integers(1, 60, days)})


@pytest.fixture(scope="module")
def bars(spark):
    # Z ends early: only the timer, not new data, can release its last bars
    return pd.concat([walk("A", 400, 1), walk("B", 400, 2), walk("Z", 200, 3), walk("ONE", 1, 4)])


@pytest.fixture(scope="module")
def streamed(spark, bars):
    rows = spark.createDataFrame(bars.sample(frac=1.0, random_state=5), BAR_SCHEMA)
    waves = SB.in_waves(rows, F.unix_date("ts"), 4, 15, F.struct("symbol", "ts"))
    assert all(w.count() for w in waves)
    waves[1] = waves[1].unionByName(waves[1].where("symbol = 'A'"))  # bars that come twice
    return SB.run_in_waves(waves, lambda b: E.stream_signals(b, "20 days"), "test-engine").cache()


def released(df, column="ts"):
    return df.where(F.col(column) < F.lit(START + dt.timedelta(days=399 - 20)))


def test_indicators_and_signals_are_the_batch_ones(spark, bars, streamed):
    batch = released(S.generate_signals(spark.createDataFrame(bars, BAR_SCHEMA)))
    columns = ["open", "close", "volume", *I.INDICATOR_COLUMNS, "signal", "signal_strength", "ma_cross", "ma_cross_signal", "volume_avg",
               "volume_spike", "macd_bullish", "macd_bearish"]
    want = batch.withColumnRenamed("entry_reason", "reason").select("symbol", "ts", "reason", *columns).toPandas()
    got = streamed.withColumnRenamed("signal_reason", "reason").select("symbol", "ts", "reason", *columns).toPandas()
    want, got = (d.sort_values(["symbol", "ts"]).reset_index(drop=True) for d in (want, got))
    assert len(got) == len(want) == 379 * 2 + 200 + 1
    for c in want.columns:
        if want[c].dtype == float:
            assert np.allclose(got[c].astype(float), want[c], rtol=0, atol=1e-9, equal_nan=True), c
        else:
            assert got[c].tolist() == want[c].tolist(), c
    assert set(want["signal"]) == {"buy", "sell", "hold"}


def test_trades_are_the_batch_ledger(spark, bars, streamed):
    s = S.generate_signals(spark.createDataFrame(bars, BAR_SCHEMA))
    want = released(B.run_backtest(s).where("not final"), "date").select(*E.TRADE_COLUMNS).toPandas()
    got = E.stream_trades(streamed).select(*E.TRADE_COLUMNS).toPandas()
    want, got = (d.sort_values(["symbol", "seq"]).reset_index(drop=True) for d in (want, got))
    assert len(want) > 10 and len(got) == len(want)
    for c in want.columns:
        if want[c].dtype == float:
            assert np.allclose(got[c].astype(float), want[c], rtol=0, atol=1e-6), c
        else:
            assert got[c].tolist() == want[c].tolist(), c


def test_rows_come_in_time_order_whatever_the_order_of_arrival():
    rows = [(i * 86_400_000, 1.0 + i, 2.0 + i, 0.5 + i, 1.0 + i, 5.0) for i in range(80)]
    from barwright.config import DEFAULT

    straight, mixed, parts = E.SymbolState(DEFAULT, None), E.SymbolState(DEFAULT, None), []
    straight.waiting = {r[0]: r for r in rows}
    want = straight.released(10**15)
    state = None
    for chunk in (rows[20:], rows[5:20], rows[:5]):
        mixed = E.SymbolState(DEFAULT, state)
        mixed.waiting |= {r[0]: r for r in chunk}
        state = mixed.stored()  # through the stored form each time
    for until in (rows[7][0], rows[7][0], rows[19][0], 10**15):
        mixed = E.SymbolState(DEFAULT, state)
        parts += mixed.released(until)
        state = mixed.stored()
    assert parts == want and len(mixed.close) == 51


def test_no_bars(spark):
    none = spark.createDataFrame([], BAR_SCHEMA)
    assert SB.run_in_waves(SB.in_waves(none, F.unix_date("ts"), 3, 2, F.col("symbol")), lambda b: E.stream_signals(b), "test-none").count() == 0


TICKS = "symbol string, ts timestamp, price double, volume double, seq long"


def ticks(spark, rows):
    at = dt.datetime(2024, 1, 1, 9, 0, 0)
    return spark.createDataFrame([(s, at + dt.timedelta(seconds=t), p, 1.0, n) for s, t, p, n in rows], TICKS)


def test_late_and_repeated_ticks_give_the_batch_bars(spark):
    rng = np.random.default_rng(9)
    rows = [("AB"[n % 2], int(rng.integers(0, 4000)), float(rng.integers(1, 99)), n) for n in range(400)]
    frames = [ticks(spark, rows[:150]), ticks(spark, rows[100:300]), ticks(spark, rows[300:] + rows[:40])]  # parts of the first file again
    got = SB.run_corrected_bars(frames, lambda t: t, "5 minutes", "3 hours", "test-corrected")
    want = SB.partial_bars(ticks(spark, rows), "5 minutes").drop("first_tick", "last_tick")
    key = lambda df: sorted(map(repr, df.select("symbol", "ts", "open", "high", "low", "close", "volume").collect()))
    assert key(got) == key(want)
    assert got.agg(F.sum("volume")).first()[0] == 400


def test_an_epoch_that_comes_again_changes_nothing(spark, tmp_path):
    table = SB.bar_table(spark, str(tmp_path / "bars"))
    sink = SB.corrected_bars_sink(table)
    first, second = ticks(spark, [("A", 10, 5.0, 1), ("A", 20, 7.0, 2)]), ticks(spark, [("A", 5, 3.0, 3)])
    sink(first, 0)
    sink(first, 0)
    sink(second, 1)
    sink(second, 1)
    row = table.read().first()
    assert (row["open"], row["high"], row["low"], row["close"], row["volume"]) == (3.0, 7.0, 3.0, 7.0, 3.0)
    assert table.versions() == [1, 2]
