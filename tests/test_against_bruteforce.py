"""Spark operators vs straightforward Python/pandas on the sf0.001 fixture."""

import math

import numpy as np
import pandas as pd
import pytest

from barwright.operators import backtest as B
from barwright.operators import indicators as I
from barwright.operators import signals as S
from barwright.sources import fixtures as FX


@pytest.fixture(scope="module")
def sig_pd(spark, small_dir):
    return S.generate_signals(FX.daily_bars(spark, small_dir)).toPandas().sort_values(["symbol", "ts"])


def test_ema_matches_pandas_adjusted(spark, small_dir):
    pdf = I.ema(FX.daily_bars(spark, small_dir), 12).toPandas().sort_values(["symbol", "ts"])
    for _, g in pdf.groupby("symbol"):
        ref = g["close"].ewm(span=12, adjust=True, min_periods=1).mean().to_numpy()
        assert np.allclose(g["ema_12"].to_numpy(), ref, rtol=1e-12, atol=1e-9)


def test_macd_signal_matches_pandas(sig_pd):
    for _, g in sig_pd.groupby("symbol"):
        c = g["close"]
        line = c.ewm(span=12, adjust=True).mean() - c.ewm(span=26, adjust=True).mean()
        sigl = line.ewm(span=9, adjust=True).mean()
        assert np.allclose(g["macd"], line, atol=1e-9) and np.allclose(g["macd_signal"], sigl, atol=1e-9)


def test_rsi_and_sma_match_pandas(sig_pd):
    for _, g in sig_pd.groupby("symbol"):
        c = g["close"]
        d = c.diff()
        ag = d.where(d > 0, 0).rolling(14, min_periods=1).mean()
        al = (-d.where(d < 0, 0)).rolling(14, min_periods=1).mean()
        rsi = (100 - 100 / (1 + ag / al)).fillna(50)
        assert np.allclose(g["rsi"], rsi, atol=1e-6)
        assert np.allclose(g["ma_50"], c.rolling(50, min_periods=1).mean(), atol=1e-9)


def _loop(g: pd.DataFrame):
    cash, pos, ep, trades = 100000.0, 0, 0.0, []
    for r in g.itertuples():
        if r.signal == "buy" and pos == 0 and cash > r.close:
            sh = int(cash * 0.95 / r.close)
            tv = sh * r.close
            cost = tv + tv * 0.001 + tv * 0.001
            if sh > 0 and cost <= cash:
                pos, cash, ep = sh, cash - cost, r.close
                trades.append(("buy", sh, cost))
        elif r.signal == "sell" and pos > 0:
            tv = pos * r.close
            net = tv - tv * 0.001 - tv * 0.001
            cash += net
            trades.append(("sell", pos, net))
            pos = 0
    if pos > 0:
        tv = pos * g["close"].iloc[-1]
        net = tv - tv * 0.001 - tv * 0.001
        cash += net
        trades.append(("sell", pos, net))
    return trades, cash


def test_backtest_matches_python_loop(spark, small_dir, sig_pd):
    led = B.run_backtest(S.generate_signals(FX.daily_bars(spark, small_dir))).toPandas()
    for sym, g in sig_pd.groupby("symbol"):
        trades, cash = _loop(g)
        mine = led[led.symbol == sym].sort_values("seq")
        assert [(a, q, v) for a, q, v in zip(mine.action, mine.quantity, mine.value)] == trades
        final = mine.cash_after.iloc[-1] if len(mine) else 100000.0
        assert final == cash


def test_properties(spark, small_dir, sig_pd):
    assert sig_pd["rsi"].between(0, 100).all()
    ok = sig_pd.dropna(subset=["bb_upper"])
    assert (ok.bb_lower <= ok.bb_middle + 1e-9).all() and (ok.bb_middle <= ok.bb_upper + 1e-9).all()
    summ = B.summary(S.generate_signals(FX.daily_bars(spark, small_dir))).toPandas()
    assert (summ.max_drawdown <= 0).all()
    led = B.run_backtest(S.generate_signals(FX.daily_bars(spark, small_dir))).toPandas()
    q = led.groupby(["symbol", "action"]).quantity.sum().unstack(fill_value=0)
    assert (q["buy"] == q["sell"]).all()
    assert (led.cash_after >= 0).all() and not math.isnan(led.value.sum())
