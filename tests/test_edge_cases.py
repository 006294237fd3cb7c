"""Hand-made edge cases: literal rows, expected values worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barwright.operators import backtest as B
from barwright.operators import cleaning as C
from barwright.operators import indicators as I
from barwright.operators import signals as S

D0 = dt.date(2024, 1, 1)


def bars_df(spark, closes, symbol="X", volumes=None, opens=None):
    rows = []
    for i, c in enumerate(closes):
        v = volumes[i] if volumes else 100.0
        o = opens[i] if opens else c
        rows.append((symbol, D0 + dt.timedelta(days=i), o, max(o, c), min(o, c), c, v))
    return spark.createDataFrame(rows, "symbol string, ts date, open double, high double, low double, close double, volume double")


def col(df, name):
    return [r[name] for r in df.orderBy("ts").collect()]


def test_single_bar(spark):
    out = I.add_all_indicators(bars_df(spark, [10.0]))
    r = out.collect()[0]
    assert r.rsi == 50.0 and r.ma_20 == 10.0 and r.bb_upper is None and r.atr == 0.0
    assert r.stoch_k == 50.0 and r.stoch_d == 50.0 and r.macd == 0.0


def test_constant_price(spark):
    out = I.add_all_indicators(bars_df(spark, [25.5] * 60))
    assert set(col(out, "rsi")) == {50.0}
    assert set(col(out, "stoch_k")) == {50.0} and set(col(out, "stoch_d")) == {50.0}
    assert set(col(out, "macd")) == {0.0} and set(col(out, "macd_signal")) == {0.0}
    summ = B.summary(S.generate_signals(bars_df(spark, [25.5] * 60))).collect()[0]
    assert summ.volatility == 0.0 and summ.sharpe_ratio == 0.0 and summ.total_trades == 0


def test_rising_and_falling(spark):
    up = col(I.rsi(bars_df(spark, [10.0 + i for i in range(20)])), "rsi")
    down = col(I.rsi(bars_df(spark, [50.0 - i for i in range(20)])), "rsi")
    assert up[0] == 50.0 and set(up[1:]) == {100.0}
    assert down[0] == 50.0 and set(down[1:]) == {0.0}


def test_rsi_partial_window_counts_first_row(spark):
    # gains 1, losses 2 over rows 2..3 -> RSI = 100 - 100/(1 + 1/2)
    r = col(I.rsi(bars_df(spark, [10.0, 11.0, 9.0])), "rsi")
    assert r[2] == pytest.approx(100 - 100 / 1.5)


def test_zero_volume_change(spark):
    b = bars_df(spark, [10.0, 10.5, 11.0], volumes=[100.0, 0.0, 50.0])
    out = col(C.derive_volume(b), "volume_change")
    assert out[0] is None and out[1] == -1.0 and out[2] is None


def test_outlier_threshold_is_strict(spark):
    # 4 -> 5 is +25 % exactly in binary floating point; 5 -> 6.24 is +24.8 %
    b = bars_df(spark, [4.0, 5.0, 6.24, 6.0])
    kept = [r.ts for r in C.outlier_filter(b, threshold=0.25).collect()]
    assert kept == [D0 + dt.timedelta(days=2), D0 + dt.timedelta(days=3)]


def test_ffill_bfill(spark):
    rows = [("X", D0 + dt.timedelta(days=i), v) for i, v in enumerate([None, 1.0, None, 3.0, None])]
    df = spark.createDataFrame(rows, "symbol string, ts date, v double")
    assert col(C.ffill_bfill(df), "v") == [1.0, 1.0, 1.0, 3.0, 3.0]


def test_resample_skips_null_open(spark):
    t0 = dt.datetime(2024, 1, 1, 9, 0)
    rows = [("X", t0, None, 1.0), ("X", t0 + dt.timedelta(minutes=1), 5.0, 1.0), ("X", t0 + dt.timedelta(minutes=2), 7.0, 1.0)]
    ticks = spark.createDataFrame(rows, "symbol string, ts timestamp, price double, volume double")
    r = C.resample(ticks, "5m").collect()[0]
    assert (r.open, r.high, r.low, r.close, r.volume) == (5.0, 7.0, 5.0, 7.0, 3.0)


def test_dedup_keeps_distinct_dates(spark):
    b = bars_df(spark, [10.0, 10.0])  # identical OHLCV on two dates
    assert C.dedup(b).count() == 2
    assert C.dedup(b.union(b)).count() == 2


def _ledger(spark, closes, sigs):
    rows = [("X", D0 + dt.timedelta(days=i), c, s, 50.0, c, c) for i, (c, s) in enumerate(zip(closes, sigs))]
    sig = spark.createDataFrame(rows, "symbol string, ts date, close double, signal string, rsi double, ma_20 double, ma_50 double")
    return sig, B.run_backtest(sig).orderBy("seq").collect()


def test_buy_on_last_bar_closes_same_bar(spark):
    _, led = _ledger(spark, [10.0, 10.0, 20.0], ["hold", "hold", "buy"])
    assert [r.action for r in led] == ["buy", "sell"]
    assert led[1].final and led[1].exit_reason == "Position closed at end of backtest"
    assert led[0].quantity == int(100000 * 0.95 / 20.0)


def test_unaffordable_then_affordable_buy(spark):
    _, led = _ledger(spark, [200000.0, 50.0, 60.0], ["buy", "buy", "sell"])
    assert [(r.action, r.price) for r in led] == [("buy", 50.0), ("sell", 60.0)]


def test_repeated_buys_and_sells_are_noops(spark):
    _, led = _ledger(spark, [10.0, 11.0, 12.0, 13.0, 14.0], ["sell", "buy", "buy", "sell", "sell"])
    assert [(r.action, r.price) for r in led] == [("buy", 11.0), ("sell", 13.0)]
    shares = int(100000 * 0.95 / 11.0)
    tv = shares * 13.0
    assert led[1].pnl == pytest.approx(tv - tv * 0.001 - tv * 0.001 - shares * 11.0)


def test_sell_overrides_buy_keeps_buy_tag(spark):
    # strongly falling then a bounce: RSI < 30 and, later, cross-down co-occur in real data;
    # here check the rule on the finished columns directly
    df = spark.createDataFrame(
        [("X", D0, 1, 9, 9, 9, 9, 9, -2, 10.0, 100.0, 20, 0.1, 0.2, 30.0)],
        "symbol string, ts date, _rsi_g long, _rsi_l long, _s_short long, _n_short long, _s_long long, _n_long long,"
        " ma_cross_signal int, volume double, _vs double, _vn long, macd double, macd_signal double, rsi double",
    )
    r = S.finish_signals(df).collect()[0]
    assert r.signal == "sell" and r.entry_reason == "RSI_OVERSOLD MA_CROSSOVER_DOWN"


def test_universe_without_data_gets_empty_result(spark):
    sig = S.generate_signals(bars_df(spark, [10.0 + (i % 7) for i in range(80)]))
    uni = spark.createDataFrame([("X",), ("NOPE",)], "symbol string")
    rows = {r.symbol: r for r in B.summary(sig, universe=uni).collect()}
    assert rows["NOPE"].final_value == 100000.0 and rows["NOPE"].total_trades == 0
    assert rows["NOPE"].total_return == 0.0 and rows["X"].data_points == 80


def test_ticks_of_one_instant_are_ordered_by_their_number(spark):
    at = dt.datetime(2024, 1, 1, 10, 0, 0)
    rows = [("a", at, 5.0, 1.0, 30), ("a", at, 7.0, 1.0, 10), ("a", at, 6.0, 1.0, 20), ("a", at, None, 1.0, 5)]
    for kind in ("timestamp", "timestamp_ntz"):
        ticks = spark.createDataFrame(rows, f"symbol string, ts {kind}, price double, volume double, seq long")
        bars = C.resample(ticks, "5m", tiebreak="seq")
        got = bars.first()
        assert (got["open"], got["high"], got["low"], got["close"], got["volume"]) == (7.0, 7.0, 5.0, 5.0, 4.0)
        assert "SortAggregate" not in bars._jdf.queryExecution().executedPlan().toString()


def test_coarser_bars_from_bars(spark):
    days = [("a", dt.date(2024, 1, d), float(d), d + 1.0, d - 1.0, d + 0.5, 10.0) for d in (1, 7, 8, 31)] + [("a", dt.date(2024, 2, 1), 9.0, 9.0, 9.0, 9.0, 1.0)]
    bars = spark.createDataFrame(days, "symbol string, ts date, open double, high double, low double, close double, volume double")
    month = C.resample_bars(bars, "1M").orderBy("ts").collect()
    assert [tuple(r) for r in month] == [("a", dt.date(2024, 1, 1), 1.0, 32.0, 0.0, 31.5, 40.0), ("a", dt.date(2024, 2, 1), 9.0, 9.0, 9.0, 9.0, 1.0)]
    week = C.resample_bars(bars, "1W").orderBy("ts").first()
    assert tuple(week) == ("a", dt.date(2024, 1, 7), 1.0, 8.0, 0.0, 7.5, 20.0)
