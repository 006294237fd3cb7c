"""Indicators, signals and trades of a bar stream, from composite state per symbol.

``applyInPandasWithState`` keeps, per symbol:

* the bars that wait: those not yet older than the watermark, in any order;
* a ring of the last bars (as many as the longest window and one more), from which
  every trailing indicator is computed on exact integer cents;
* numerators and denominators of the three adjusted EMAs, the last moving-average
  cross and the last raw stochastic values;
* the backtest's cash, position, entry price and reason, and the trade count.

Bars are released in time order once the watermark has passed them.  An
event-time timer, set to the oldest bar that waits, releases bars of symbols that get
no new data.  So the order in which files arrive does not matter within the watermark's
delay, and what is put out equals the batch operators on the same bars (held
by tests and by the batch SQL).  A position that is open is not closed: a stream has no last bar.

Defined cases: a bar that comes twice while it waits counts once (the later one);
a bar older than the watermark is dropped by Spark; bars without symbol, time or
prices never reach the state; times before 1970 are not supported, as the
watermark starts there.  State is O(ring + waiting bars) a symbol; it lives in the state store.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from ..config import DEFAULT, PRICE_SCALE, Params
from ..operators.backtest import _reason
from .bars import instant_to_wallclock, wallclock_to_instant

_DAY_MS = 86_400_000
_BAR = ("ms", "open", "high", "low", "close", "volume")
_NUMBERS = ("x0", "nf", "df", "ns", "ds", "ng", "dg", "cash", "entry_price")

STATE = T.StructType([
    *[T.StructField(f"wait_{c}", T.ArrayType(T.LongType() if c == "ms" else T.DoubleType())) for c in _BAR],
    *[T.StructField(f"ring_{c}", T.ArrayType(T.LongType())) for c in ("high", "low", "close")],
    T.StructField("ring_volume", T.ArrayType(T.DoubleType())),
    T.StructField("raw_k", T.ArrayType(T.DoubleType())),
    *[T.StructField(c, T.DoubleType()) for c in _NUMBERS],
    T.StructField("count", T.LongType()), T.StructField("cross", T.IntegerType()),
    T.StructField("position", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("entry_reason", T.StringType()),
])

_DOUBLES = ["open", "high", "low", "close", "volume", "rsi", "ma_20", "ma_50", "macd", "macd_signal", "macd_histogram", "bb_upper", "bb_middle",
            "bb_lower", "volume_sma", "atr", "stoch_k", "stoch_d"]
OUT = T.StructType([
    T.StructField("symbol", T.StringType()), T.StructField("ms", T.LongType()),
    *[T.StructField(c, T.DoubleType()) for c in _DOUBLES],
    T.StructField("signal", T.StringType()), T.StructField("signal_strength", T.DoubleType()), T.StructField("signal_reason", T.StringType()),
    T.StructField("ma_cross", T.IntegerType()), T.StructField("ma_cross_signal", T.IntegerType()), T.StructField("volume_avg", T.DoubleType()),
    T.StructField("volume_spike", T.BooleanType()), T.StructField("macd_bullish", T.BooleanType()), T.StructField("macd_bearish", T.BooleanType()),
    T.StructField("action", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("quantity", T.LongType()),
    T.StructField("value", T.DoubleType()), T.StructField("commission", T.DoubleType()), T.StructField("pnl", T.DoubleType()),
    T.StructField("entry_reason", T.StringType()), T.StructField("exit_reason", T.StringType()),
    T.StructField("cash_after", T.DoubleType()), T.StructField("position_after", T.LongType()),
])


class SymbolState:
    """One symbol's state between bars; ``step`` takes the next bar and returns its output row."""

    def __init__(self, p: Params, stored: tuple | None):
        self.p = p
        self.keep = max(p.indicators.ma_long, p.indicators.ma_short, p.indicators.bb_period, p.indicators.volume_period,
                        p.indicators.atr_period, p.indicators.stoch_k, p.indicators.rsi_period) + 1
        s = dict(zip(STATE.fieldNames(), stored)) if stored else {}
        self.waiting = {row[0]: row for row in zip(*[list(s[f"wait_{c}"]) for c in _BAR])} if s else {}
        self.high, self.low, self.close = ([int(x) for x in s.get(f"ring_{c}") or []] for c in ("high", "low", "close"))
        self.volume = [float(x) for x in (s.get("ring_volume") if s else None) or []]
        self.raw_k = [None if x is None or x != x else float(x) for x in (s.get("raw_k") if s else None) or []]
        for name in _NUMBERS:
            setattr(self, name, s.get(name, 0.0))
        self.count, self.cross, self.position, self.seq = (s.get(n, 0) for n in ("count", "cross", "position", "seq"))
        self.entry_reason = s.get("entry_reason", "")
        if not s:
            self.cash = p.backtest.initial_capital

    def stored(self) -> tuple:
        rows = [self.waiting[ms] for ms in sorted(self.waiting)]
        columns = [list(c) for c in zip(*rows)] if rows else [[] for _ in _BAR]
        return (*columns, self.high, self.low, self.close, self.volume, self.raw_k, *[getattr(self, n) for n in _NUMBERS],
                self.count, self.cross, self.position, self.seq, self.entry_reason)

    def released(self, before_ms: int) -> list[tuple]:
        """The output rows of the waiting bars older than the watermark, in time order."""
        return [self.step(*self.waiting.pop(ms)) for ms in sorted(ms for ms in self.waiting if ms < before_ms)]

    def _ema(self, x: float, names: str, span: int) -> float:
        q = 1.0 - 2.0 / (span + 1.0)
        n, d = x + q * getattr(self, f"n{names}"), 1.0 + q * getattr(self, f"d{names}")
        setattr(self, f"n{names}", n)
        setattr(self, f"d{names}", d)
        return n / d

    def step(self, ms: int, open_: float, high: float, low: float, close: float, volume: float) -> tuple:
        i, st = self.p.indicators, self.p.strategy
        cents = [round(x * PRICE_SCALE) for x in (high, low, close)]
        for ring, x in zip((self.high, self.low, self.close, self.volume), (*cents, volume)):
            ring.append(x)
            del ring[:-self.keep]
        if self.count == 0:
            self.x0 = close
        self.count += 1
        n, c = self.count, self.close

        def size(period: int) -> int:
            return min(n, period)

        steps = [b - a for a, b in zip(c, c[1:])][-size(i.rsi_period):]
        gains, losses = sum(d for d in steps if d > 0), -sum(d for d in steps if d < 0)
        rsi = (50.0 if gains == 0 else 100.0) if losses == 0 else 100.0 - 100.0 / (1.0 + gains / losses)
        s_short, s_long = sum(c[-i.ma_short:]), sum(c[-i.ma_long:])
        n_short, n_long = size(i.ma_short), size(i.ma_long)
        ma_short, ma_long = s_short / (n_short * PRICE_SCALE), s_long / (n_long * PRICE_SCALE)
        x = close - self.x0
        macd = self._ema(x, "f", i.macd_fast) - self._ema(x, "s", i.macd_slow)
        macd_signal = self._ema(macd, "g", i.macd_signal)
        n_bb, in_bb = size(i.bb_period), c[-i.bb_period:]
        middle = sum(in_bb) / (n_bb * PRICE_SCALE)
        sd = math.sqrt((n_bb * sum(v * v for v in in_bb) - sum(in_bb) ** 2) / (n_bb * (n_bb - 1))) / PRICE_SCALE if n_bb > 1 else None
        volumes, n_vol = self.volume[-i.volume_period:], size(i.volume_period)
        n_atr = size(i.atr_period)
        ranges = [self.high[k] - self.low[k] if n + k < 1 else max(self.high[k] - self.low[k], abs(self.high[k] - c[k - 1]), abs(self.low[k] - c[k - 1]))
                  for k in range(-n_atr, 0)]  # n + k: the row number from 0; row 0 has no close before it
        top, bottom = max(self.high[-i.stoch_k:]), min(self.low[-i.stoch_k:])
        raw = 100.0 * ((c[-1] - bottom) / (top - bottom)) if top != bottom else None
        self.raw_k = [*self.raw_k, raw][-i.stoch_d:]
        known = [k for k in self.raw_k if k is not None]

        cross = 1 if s_short * n_long > s_long * n_short else -1
        turn = cross - self.cross if n > 1 else None
        self.cross = cross
        oversold, overbought = gains * (100 - st.rsi_oversold) < losses * st.rsi_oversold, gains * (100 - st.rsi_overbought) > losses * st.rsi_overbought
        up, down = turn == 2, turn == -2
        recent = self.volume[-st.volume_window:]
        full = n >= st.volume_window
        spike = full and volume * (2 * st.volume_window) > sum(recent) * (2 * st.volume_spike_factor)
        bullish, bearish = macd > macd_signal, macd < macd_signal
        signal = "sell" if overbought or down else "buy" if oversold or up else "hold"
        strength = 0.0
        if signal == "sell":
            strength = (rsi - st.rsi_overbought) / (100.0 - st.rsi_overbought) * 0.5 + (0.5 if down else 0.0)
        elif signal == "buy":
            strength = (st.rsi_oversold - rsi) / st.rsi_oversold * 0.5 + (0.5 if up else 0.0)
        if signal != "hold":
            agree = bearish if signal == "sell" else bullish
            strength = min(strength + (st.confirm_bonus if spike else 0.0) + (st.confirm_bonus if agree else 0.0), 1.0)
        tags = [tag for tag, on in (("RSI_OVERSOLD", oversold), ("MA_CROSSOVER_UP", up), ("RSI_OVERBOUGHT", overbought), ("MA_CROSSOVER_DOWN", down)) if on]
        return (ms, open_, high, low, close, volume, rsi, ma_short, ma_long, macd, macd_signal, macd - macd_signal,
                None if sd is None else middle + sd * i.bb_std, middle, None if sd is None else middle - sd * i.bb_std,
                sum(volumes) / n_vol, sum(ranges) / (n_atr * PRICE_SCALE), 50.0 if raw is None else raw, sum(known) / len(known) if known else 50.0,
                signal, strength, " ".join(tags), cross, turn, sum(recent) / st.volume_window if full else None, spike, bullish, bearish,
                *self._trade(close, signal, rsi, ma_short, ma_long))

    def _trade(self, price: float, signal: str, rsi: float, ma_short: float, ma_long: float) -> tuple:
        bt = self.p.backtest
        nothing = (None,) * 8
        row = nothing
        if signal == "buy" and self.position == 0 and self.cash > price:
            shares = math.floor(self.cash * bt.cash_fraction / price)
            worth = shares * price
            fee = worth * bt.commission
            total = worth + fee + worth * bt.slippage
            if shares > 0 and total <= self.cash:
                self.position, self.entry_price = shares, price
                self.cash -= total
                self.entry_reason = _reason("Buy", rsi, ma_short, ma_long)
                self.seq += 1
                row = ("buy", self.seq, shares, total, fee, 0.0, self.entry_reason, None)
        elif signal == "sell" and self.position > 0:
            worth = self.position * price
            fee = worth * bt.commission
            net = worth - fee - worth * bt.slippage
            self.cash += net
            self.seq += 1
            row = ("sell", self.seq, self.position, net, fee, net - self.position * self.entry_price, self.entry_reason, _reason("Sell", rsi, ma_short, ma_long))
            self.position, self.entry_price, self.entry_reason = 0, 0.0, ""
        return (*row, self.cash, self.position)


def _updater(p: Params):
    names = OUT.fieldNames()

    def update(key, batches, state):
        held = SymbolState(p, state.get if state.exists else None)
        if not state.hasTimedOut:
            for pdf in batches:
                for row in zip(*[pdf[c].tolist() for c in _BAR]):
                    held.waiting[row[0]] = row
        watermark = state.getCurrentWatermarkMs()
        rows = held.released(watermark)
        state.update(held.stored())
        if held.waiting:
            state.setTimeoutTimestamp(max(min(held.waiting), watermark + 1))
        if rows:
            frame = pd.DataFrame.from_records([(key[0], *row) for row in rows], columns=names)
            for field in OUT.fields:  # missing numbers stay missing, whole numbers whole
                if isinstance(field.dataType, (T.LongType, T.IntegerType)):
                    frame[field.name] = frame[field.name].astype("Int64" if isinstance(field.dataType, T.LongType) else "Int32")
            yield frame

    return update


def stream_signals(bars: DataFrame, delay: str = "30 days", p: Params = DEFAULT) -> DataFrame:
    """Bar stream -> one row per bar that the watermark has passed: indicators, signal and trade.

    ``ts`` may be a date, a wall-clock or an instant timestamp and comes back as it was.
    """
    kind = bars.schema["ts"].dataType
    if isinstance(kind, T.DateType):
        event, back = F.timestamp_millis(F.unix_date("ts").cast("long") * _DAY_MS), F.date_from_unix_date((F.col("ms") / _DAY_MS).cast("int"))
    elif isinstance(kind, T.TimestampNTZType):
        event, back = wallclock_to_instant("ts"), None
    else:
        event, back = F.col("ts"), F.timestamp_millis("ms")
    numbers = [F.col(c).cast("double").alias(c) for c in _BAR[1:]]
    src = (bars.where("symbol is not null and ts is not null and open is not null and high is not null and low is not null and close is not null")
           .select("symbol", event.alias("event_time"), *numbers).fillna(0.0, ["volume"]).withWatermark("event_time", delay)
           .withColumn("ms", F.unix_millis("event_time")))
    out = src.groupBy("symbol").applyInPandasWithState(_updater(p), OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    if back is None:
        out, back = out.withColumn("_instant", F.timestamp_millis("ms")), instant_to_wallclock("_instant")
    return out.select("symbol", back.alias("ts"), *OUT.fieldNames()[2:])


TRADE_COLUMNS = ["symbol", "date", "seq", "action", "quantity", "price", "value", "commission", "signal_strength", "entry_reason",
                 "rsi", "ma_20", "ma_50", "pnl", "exit_reason", "cash_after", "position_after"]


def stream_trades(signals: DataFrame) -> DataFrame:
    """The trades of ``stream_signals``, with the ledger's columns; their strength is 1, as in the batch ledger."""
    return (signals.where(F.col("action").isNotNull())
            .withColumns({"date": F.col("ts"), "price": F.col("close"), "signal_strength": F.lit(1.0)}).select(*TRADE_COLUMNS))
