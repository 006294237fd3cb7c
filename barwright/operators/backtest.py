"""Long-only, all-in/all-out backtest of a signal table, per symbol.

State ``(cash, position, entry price, entry reason)`` starts at
``(capital, 0, 0, '')``.  On each bar, in time order:

* buy when ``signal = buy``, flat, ``cash > price``: ``shares =
  int(cash * 0.95 / price)``; cost = value + commission + slippage (0.1 % each)
  and must not exceed cash;
* sell when ``signal = sell`` and long: proceeds = value - commission -
  slippage; ``pnl = proceeds - shares * entry price`` (entry costs are not
  subtracted);
* after the last bar an open position is sold at the last close.

Share counts compound with cash and an unaffordable buy leaves the state flat,
so the fold is sequential.  It runs over *events* only: window functions first
drop holds and sells that follow a sell (or nothing) - both are no-ops in
every state - and add one ``end`` marker per symbol.  The events are hash
partitioned by symbol, sorted by ``(symbol, ts, kind)`` and streamed through
``mapInPandas``; the fold keeps O(1) state, never materialises a group, and
emits one row per trade.  Everything else (equity curve, metrics) is window
functions and aggregates on the JVM, on one layout by symbol: bars and the
states after trades are one tagged table, so a state reaches its bars without a join.

``continue_backtest`` folds only the bars after a saved state's high-water mark and
puts out the new state with the new trades.  ``curve_blocks`` and
``merge_blocks`` give the curve's metrics for symbols too long for one task.
"""

from __future__ import annotations

import itertools
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT, BacktestParams
from ..functions.windows import before, by_symbol

END_REASON = "Position closed at end of backtest"

TRADE_COLUMNS = [
    "symbol", "date", "action", "quantity", "price", "value", "commission", "signal_strength",
    "entry_reason", "rsi", "ma_20", "ma_50", "pnl", "exit_reason",
]


def backtest_events(signals: DataFrame, open_before: bool = False) -> DataFrame:
    """Decisive rows (kind 0) plus one end marker per symbol (kind 1).

    ``open_before``: a position may be open before the first row, so a sell that nothing precedes decides, too.
    """
    w = by_symbol()
    prev = F.last(F.when(F.col("signal") != "hold", F.col("signal")), ignorenulls=True).over(before())
    flagged = signals.select(
        "symbol", "ts", "close", "signal", "rsi", "ma_20", "ma_50",
        prev.alias("_prev"),
        F.lead("ts").over(w).isNull().alias("_last"),
    )
    long_ = F.coalesce(F.col("_prev") == "buy", F.lit(open_before))
    decisive = (F.col("signal") == "buy") | ((F.col("signal") == "sell") & long_)
    kinds = F.array_compact(F.array(F.when(decisive, F.lit(0)), F.when(F.col("_last"), F.lit(1))))
    return (
        flagged.filter(decisive | F.col("_last"))
        .select("symbol", "ts", "close", "signal", "rsi", "ma_20", "ma_50", F.explode(kinds).alias("kind"))
    )


def _trade_schema(ts_type: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("symbol", T.StringType()),
        T.StructField("date", ts_type),
        T.StructField("seq", T.LongType()),
        T.StructField("action", T.StringType()),
        T.StructField("quantity", T.LongType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("commission", T.DoubleType()),
        T.StructField("signal_strength", T.DoubleType()),
        T.StructField("entry_reason", T.StringType()),
        T.StructField("rsi", T.DoubleType()),
        T.StructField("ma_20", T.DoubleType()),
        T.StructField("ma_50", T.DoubleType()),
        T.StructField("pnl", T.DoubleType()),
        T.StructField("exit_reason", T.StringType()),
        T.StructField("cash_after", T.DoubleType()),
        T.StructField("position_after", T.LongType()),
        T.StructField("final", T.BooleanType()),
    ])


def _reason(kind: str, rsi: float, ma20: float, ma50: float) -> str:
    return f"{kind} signal: RSI={rsi:.1f}, MA20={ma20:.1f}, MA50={ma50:.1f}"


class _Account:
    """State of one symbol's fold; ``trade`` and ``close`` return a ledger row or None."""

    def __init__(self, bt: BacktestParams, symbol: str):
        self.bt, self.symbol = bt, symbol
        self.cash, self.pos, self.entry_price, self.entry_reason, self.seq, self.ts = bt.initial_capital, 0, 0.0, "", 0, None

    def _sold(self, ts, price: float, rsi: float, ma20: float, ma50: float, reason: str, final: bool) -> tuple:
        tv = self.pos * price
        commission = tv * self.bt.commission
        net = tv - commission - tv * self.bt.slippage
        return (self.symbol, ts, self.seq + 1, "sell", self.pos, price, net, commission, 1.0, self.entry_reason,
                rsi, ma20, ma50, net - self.pos * self.entry_price, reason, self.cash + net, 0, final)

    def trade(self, ts, price: float, signal: str, rsi: float, ma20: float, ma50: float) -> tuple | None:
        if signal == "buy" and self.pos == 0 and self.cash > price:
            shares = math.floor(self.cash * self.bt.cash_fraction / price)
            tv = shares * price
            commission = tv * self.bt.commission
            total = tv + commission + tv * self.bt.slippage
            if shares <= 0 or total > self.cash:
                return None
            self.pos, self.entry_price, self.entry_reason = shares, price, _reason("Buy", rsi, ma20, ma50)
            self.cash -= total
            self.seq += 1
            return (self.symbol, ts, self.seq, "buy", shares, price, total, commission, 1.0, self.entry_reason,
                    rsi, ma20, ma50, 0.0, None, self.cash, self.pos, False)
        if signal == "sell" and self.pos > 0:
            row = self._sold(ts, price, rsi, ma20, ma50, _reason("Sell", rsi, ma20, ma50), False)
            self.cash, self.pos, self.entry_price, self.entry_reason, self.seq = row[15], 0, 0.0, "", row[2]
            return row
        return None

    def close(self, ts, price: float, rsi: float, ma20: float, ma50: float) -> tuple | None:
        """The sale of what is open after the last bar; the state stays as it is."""
        return self._sold(ts, price, rsi, ma20, ma50, END_REASON, True) if self.pos > 0 else None


def _fold(bt: BacktestParams, columns: list[str], saved: bool = False):
    """Events in order -> ledger rows; with ``saved`` also each symbol's state (kind -1 rows bring it, one row a symbol returns it)."""
    given = ["symbol", "ts", "close", "signal", "rsi", "ma_20", "ma_50", "kind"]
    state = ["cash", "position", "entry_price", "entry_reason", "seq"]

    def run(batches):
        account = None

        def kept() -> list[tuple]:
            if not saved or account is None:
                return []
            a = account
            return [(a.symbol, a.ts, a.seq, None, None, None, None, None, None, a.entry_reason, None, None, None, None, None, a.cash, a.pos, None, a.entry_price)]

        for pdf in batches:
            out = []
            more = zip(*[pdf[c] for c in state]) if saved else itertools.repeat(())
            for (sym, ts, price, signal, rsi, ma20, ma50, kind), extra in zip(zip(*[pdf[c] for c in given]), more):
                if account is None or sym != account.symbol:
                    out += kept()
                    account = _Account(bt, sym)
                account.ts = ts
                if kind == -1:
                    account.cash, account.pos, account.entry_price, account.entry_reason, account.seq = extra[0], int(extra[1]), extra[2], extra[3], int(extra[4])
                    continue
                row = account.close(ts, price, rsi, ma20, ma50) if kind == 1 else account.trade(ts, price, signal, rsi, ma20, ma50)
                if row is not None:
                    out.append((*row, None) if saved else row)
            if out:
                yield pd.DataFrame.from_records(out, columns=columns)
        if rest := kept():
            yield pd.DataFrame.from_records(rest, columns=columns)

    return run


def run_backtest(signals: DataFrame, bt: BacktestParams = DEFAULT.backtest) -> DataFrame:
    """Trade ledger with running state: TRADE_COLUMNS + seq, cash_after, position_after, final."""
    events = backtest_events(signals)
    schema = _trade_schema(signals.schema["ts"].dataType)
    ordered = events.repartition("symbol").sortWithinPartitions("symbol", "ts", "kind")
    return ordered.mapInPandas(_fold(bt, schema.fieldNames()), schema)


def continue_backtest(signals: DataFrame, state: DataFrame | None = None, bt: BacktestParams = DEFAULT.backtest) -> DataFrame:
    """Fold the bars after ``state``'s high-water marks; ledger rows as ``run_backtest`` gives them, and rows of the new state.

    Rows of the state have no action; ``new_trades`` and ``saved_state`` tell the two apart
    (write the result once, read it twice).  A position that is open at the end is sold in a ``final`` row, as if no bar
    were to follow, but stays open in the state (``append_ledger`` drops rows that later bars overtake).  Bars at or before a symbol's high-water mark are ignored, so a part may be sent again.
    """
    kind = signals.schema["ts"].dataType
    schema = T.StructType([*_trade_schema(kind).fields, T.StructField("entry_price", T.DoubleType())])
    if state is None:
        state = signals.sparkSession.createDataFrame([], state_schema(kind))
    marks = state.select(F.col("symbol").alias("_of"), F.col("ts").alias("_mark"))
    fresh = signals.join(marks, F.col("symbol") == F.col("_of"), "left").filter(F.col("_mark").isNull() | (F.col("ts") > F.col("_mark")))
    events = backtest_events(fresh.drop("_of", "_mark"), open_before=True).unionByName(
        state.withColumn("kind", F.lit(-1)), allowMissingColumns=True)
    ordered = events.repartition("symbol").sortWithinPartitions("symbol", "ts", "kind")
    return ordered.mapInPandas(_fold(bt, schema.fieldNames(), saved=True), schema)


def state_schema(ts_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("symbol", T.StringType()), T.StructField("ts", ts_type), T.StructField("cash", T.DoubleType()),
                         T.StructField("position", T.LongType()), T.StructField("entry_price", T.DoubleType()),
                         T.StructField("entry_reason", T.StringType()), T.StructField("seq", T.LongType())])


def new_trades(folded: DataFrame) -> DataFrame:
    return folded.filter(F.col("action").isNotNull()).drop("entry_price")


def saved_state(folded: DataFrame) -> DataFrame:
    """One row per symbol: high-water mark (its last bar), cash, position, entry, trades so far."""
    return folded.filter(F.col("action").isNull()).select(
        "symbol", F.col("date").alias("ts"), F.col("cash_after").alias("cash"), F.col("position_after").alias("position"),
        "entry_price", "entry_reason", "seq")


def trades(ledger: DataFrame) -> DataFrame:
    return ledger.select(*TRADE_COLUMNS)


def append_ledger(earlier: DataFrame, later: DataFrame) -> DataFrame:
    """The ledger of two folded parts: a ``final`` row of the earlier one goes if its symbol had bars in the later one."""
    marks = saved_state(earlier).select("symbol", F.col("ts").alias("_old"))
    moved = saved_state(later).join(marks, "symbol").filter(F.col("ts") > F.col("_old")).select("symbol", F.lit(True).alias("final"))
    return new_trades(earlier).join(moved, ["symbol", "final"], "left_anti").unionByName(new_trades(later))


def _tagged(signals: DataFrame, ledger: DataFrame, *extra: str) -> DataFrame:
    """Bars (kind 0) and ledger rows (kind 1, after the bar of their day) as one table."""
    bars = signals.select("symbol", "ts", F.lit(0).alias("kind"), "close", *[c for c in ("signal",) if c in extra])
    trades_ = ledger.select(
        "symbol", F.col("date").alias("ts"), F.lit(1).alias("kind"),
        *[F.when(~F.col("final"), F.col(c)).alias(f"_{c}") for c in ("cash_after", "position_after")],
        *[c for c in ("action", "pnl", "cash_after", "seq") if c in extra])
    return bars.unionByName(trades_, allowMissingColumns=True)


def _valued(rows: DataFrame, keys: tuple[str, ...], cash: Column, position: Column) -> DataFrame:
    """Add cash and position before each bar's trade and the bar's value, per ``keys`` in order of (ts, kind); other state from the arguments."""
    w = Window.partitionBy(*keys).orderBy("ts", "kind").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(
        "*",
        F.coalesce(F.last("_cash_after", ignorenulls=True).over(w), cash).alias("cash"),
        F.coalesce(F.last("_position_after", ignorenulls=True).over(w), position).alias("position"))
    return rows.withColumn("value", F.when(F.col("kind") == 0, F.col("cash") + F.col("position") * F.col("close")))


def _returns(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Add each bar's return on the bar before and its drawdown from the peak so far; rows without a value have neither."""
    w = Window.partitionBy(*keys).orderBy("ts", "kind").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy("ts", "kind").rowsBetween(Window.unboundedPreceding, 0)
    peak = F.max("value").over(upto)
    return rows.select(
        "*",
        (F.try_divide(F.col("value"), F.last("value", ignorenulls=True).over(w)) - F.lit(1.0)).alias("ret"),
        F.try_divide(F.col("value") - peak, peak).alias("dd"))


def _initial(bt: BacktestParams) -> tuple[Column, Column]:
    return F.lit(float(bt.initial_capital)), F.lit(0).cast("long")


def equity_curve(signals: DataFrame, ledger: DataFrame, bt: BacktestParams = DEFAULT.backtest) -> DataFrame:
    """Per bar: portfolio value before that bar's trade (final liquidation excluded)."""
    rows = _valued(_tagged(signals, ledger), ("symbol",), *_initial(bt))
    return rows.filter(F.col("kind") == 0).select(
        "symbol", F.col("ts").alias("date"), "value", "cash", "position", F.col("close").alias("price"))


CURVE_BLOCK_DAYS = 1024


def curve_blocks(signals: DataFrame, ledger: DataFrame, bt: BacktestParams = DEFAULT.backtest, days: int = CURVE_BLOCK_DAYS) -> DataFrame:
    """Per (symbol, block of days): count, mean and M2 of the returns inside, first and last value, peak, trough, drawdown.

    A block's opening state is the last one of the blocks before, from a table of one row a
    block, so no window holds a whole symbol.
    """
    rows = _tagged(signals, ledger)
    rows = rows.withColumn("block", F.floor(F.unix_date(F.col("ts").cast("date")) / days).cast("long"))
    state = F.when(F.col("kind") == 1, F.struct("_cash_after", "_position_after"))
    ends = rows.groupBy("symbol", "block").agg(F.max_by(state, F.when(F.col("_cash_after").isNotNull(), F.col("ts"))).alias("end"))
    before_ = Window.partitionBy("symbol").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    opening = ends.select("symbol", "block", F.last("end", ignorenulls=True).over(before_).alias("open"))
    cash, position = _initial(bt)
    rows = _valued(rows.join(opening, ["symbol", "block"]), ("symbol", "block"),
                   F.coalesce("open._cash_after", cash), F.coalesce("open._position_after", position))
    n = F.count("ret")
    return _returns(rows, ("symbol", "block")).groupBy("symbol", "block").agg(
        n.alias("n"), F.coalesce(F.avg("ret"), F.lit(0.0)).alias("mean"), F.coalesce(F.var_pop("ret") * n, F.lit(0.0)).alias("m2"),
        F.min_by("value", F.when(F.col("kind") == 0, F.col("ts"))).alias("first"), F.max_by("value", F.when(F.col("kind") == 0, F.col("ts"))).alias("last"),
        F.max("value").alias("peak"), F.min("value").alias("trough"), F.min("dd").alias("dd")).filter(F.col("first").isNotNull())


def _join_moments(a: Column, n: Column, mean: Column, m2: Column) -> dict[str, Column]:
    """Count, mean and M2 of two sets of returns together."""
    both = a["n"] + n
    share = F.coalesce(F.try_divide(n.cast("double"), both.cast("double")), F.lit(0.0))
    gap = mean - a["mean"]
    return {"n": both, "mean": a["mean"] + gap * share, "m2": a["m2"] + m2 + gap * gap * a["n"] * share}


def merge_blocks(blocks: DataFrame, bt: BacktestParams = DEFAULT.backtest) -> DataFrame:
    """Per symbol: volatility and max drawdown from the summaries of its blocks, taken in order.

    Two neighbours merge into a summary of the same form, so blocks may be merged in any grouping.
    """
    fields = ("n", "mean", "m2", "last", "peak", "dd")

    def step(a: Column, x: Column) -> Column:
        joint = F.try_divide(x["first"], a["last"]) - F.lit(1.0)
        one = F.when(joint.isNotNull(), F.lit(1)).otherwise(F.lit(0)).cast("long")
        with_joint = F.struct(*[c.alias(k) for k, c in _join_moments(a, one, F.coalesce(joint, F.lit(0.0)), F.lit(0.0)).items()])
        moments = _join_moments(with_joint, x["n"], x["mean"], x["m2"])
        fall = F.try_divide(x["trough"] - a["peak"], a["peak"])
        values = {**moments, "last": x["last"], "peak": F.greatest(a["peak"], x["peak"]), "dd": F.least(a["dd"], x["dd"], fall)}
        return F.struct(*[values[k].alias(k) for k in fields])

    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"), F.lit(None).cast("double").alias("last"),
                    F.lit(None).cast("double").alias("peak"), F.lit(None).cast("double").alias("dd"))
    ordered = F.sort_array(F.collect_list(F.struct("block", *[c for c in ("n", "mean", "m2", "first", "last", "peak", "trough", "dd")])))
    folded = blocks.groupBy("symbol").agg(ordered.alias("b")).select("symbol", F.aggregate("b", zero, step).alias("f"))
    spread = F.sqrt(F.col("f.m2") / (F.col("f.n") - 1)) * F.sqrt(F.lit(float(bt.trading_days)))
    return folded.select("symbol", F.when(F.col("f.n") > 1, spread).otherwise(F.lit(0.0)).alias("volatility"), F.col("f.dd").alias("max_drawdown"))


def _curve_aggregates(bt: BacktestParams) -> list[Column]:
    vol = F.when(F.count("ret") > 1, F.stddev_samp("ret") * F.sqrt(F.lit(float(bt.trading_days)))).otherwise(F.lit(0.0))
    return [vol.alias("volatility"), F.min("dd").alias("max_drawdown")]


def curve_metrics(curve: DataFrame, bt: BacktestParams = DEFAULT.backtest) -> DataFrame:
    """Per symbol: volatility (annualised sample std of returns), max drawdown."""
    rows = curve.select("symbol", F.col("date").alias("ts"), F.lit(0).alias("kind"), "value")
    return _returns(rows, ("symbol",)).groupBy("symbol").agg(*_curve_aggregates(bt))


def _trade_aggregates() -> list[Column]:
    sells = F.col("action") == "sell"
    pnl = F.col("pnl")
    win = sells & (pnl > 0)
    lose = sells & (pnl <= 0)
    total = F.count(F.when(sells, 1))
    wins = F.count(F.when(win, 1))
    return [
        F.max_by("cash_after", "seq").alias("final_value"),
        total.alias("total_trades"),
        wins.alias("winning_trades"),
        F.count(F.when(lose, 1)).alias("losing_trades"),
        F.coalesce(F.try_divide(wins.cast("double"), total.cast("double")), F.lit(0.0)).alias("win_rate"),
        F.coalesce(F.avg(F.when(sells, pnl)), F.lit(0.0)).alias("avg_return"),
        F.coalesce(F.avg(F.when(win, pnl)), F.lit(0.0)).alias("avg_winning_return"),
        F.coalesce(F.avg(F.when(lose, pnl)), F.lit(0.0)).alias("avg_losing_return"),
    ]


def trade_metrics(ledger: DataFrame, bt: BacktestParams = DEFAULT.backtest) -> DataFrame:
    """Per symbol: final value and sell-trade statistics."""
    return ledger.groupBy("symbol").agg(*_trade_aggregates())


def ledger_summary(symbols: DataFrame, ledger: DataFrame, bt: BacktestParams = DEFAULT.backtest) -> DataFrame:
    """Final value, total return and trade statistics of each of ``symbols``; without trades, the capital and zeros."""
    cap = F.lit(float(bt.initial_capital))
    stats = trade_metrics(ledger, bt)
    out = symbols.join(stats, "symbol", "left").fillna(0, [c for c in stats.columns if c not in ("symbol", "final_value")])
    final = F.coalesce(F.col("final_value"), cap)
    return out.withColumns({"final_value": final, "total_return": (final - cap) / cap})


def _bar_aggregates() -> list[Column]:
    """Of bars (rows with a close): count, first and last dates, buy & hold, signal counts."""
    bar = F.col("close").isNotNull()
    ts = F.when(bar, F.col("ts"))
    n = F.count("close")
    first, last = F.min_by("close", ts), F.max_by("close", ts)
    return [
        n.alias("data_points"),
        F.min(ts).alias("start_date"),
        F.max(ts).alias("end_date"),
        F.when(n > 1, (last - first) / first).otherwise(F.lit(0.0)).alias("buy_hold_return"),
        *[F.count(F.when(bar & (F.col("signal") == k), 1)).alias(f"signals_{k}") for k in ("buy", "sell", "hold")],
    ]


def bar_metrics(signals: DataFrame) -> DataFrame:
    """Per symbol: bar count, first/last dates, buy & hold, signal counts."""
    return signals.groupBy("symbol").agg(*_bar_aggregates())


def empty_summary(symbols: DataFrame, bars: DataFrame, bt: BacktestParams = DEFAULT.backtest) -> DataFrame:
    """The empty result (zeros, final value = capital) of each of ``symbols`` that has no bars; no backtest runs."""
    without = symbols.select("symbol").distinct().join(bars.select("symbol").distinct(), "symbol", "left_anti")
    zero, none, cap = F.lit(0.0), F.lit(0).cast("long"), F.lit(float(bt.initial_capital))
    special = {"final_value": cap, "initial_capital": cap, "start_date": F.lit(None).cast("date"), "end_date": F.lit(None).cast("date")}
    counts = ("total_trades", "winning_trades", "losing_trades", "data_points", "signals_buy", "signals_sell", "signals_hold")
    return without.select("symbol", *[special.get(c, none if c in counts else zero).alias(c) for c in SUMMARY_COLUMNS[1:]])


SUMMARY_COLUMNS = [
    "symbol", "total_return", "final_value", "total_trades", "winning_trades", "losing_trades", "win_rate",
    "avg_return", "avg_winning_return", "avg_losing_return", "volatility", "sharpe_ratio", "max_drawdown",
    "buy_hold_return", "excess_return", "data_points", "signals_buy", "signals_sell", "signals_hold",
    "start_date", "end_date", "initial_capital",
]


def summary(
    signals: DataFrame,
    ledger: DataFrame | None = None,
    universe: DataFrame | None = None,
    bt: BacktestParams = DEFAULT.backtest,
) -> DataFrame:
    """One row per symbol with all metrics.

    With ``universe`` (a ``symbol`` column) every listed symbol gets a row;
    symbols without bars get the empty result (zeros, final value = capital).
    """
    ledger = ledger if ledger is not None else run_backtest(signals, bt)
    cap = float(bt.initial_capital)
    rows = _valued(_tagged(signals, ledger, "signal", "action", "pnl", "cash_after", "seq"), ("symbol",), *_initial(bt))
    out = _returns(rows, ("symbol",)).groupBy("symbol").agg(*_bar_aggregates(), *_trade_aggregates(), *_curve_aggregates(bt))
    if universe is not None:
        out = universe.select("symbol").distinct().join(out, "symbol", "left")
    z = F.lit(0.0)
    zl = F.lit(0).cast("long")
    final = F.coalesce(F.col("final_value"), F.lit(cap))
    total_return = (final - F.lit(cap)) / F.lit(cap)
    vol = F.coalesce(F.col("volatility"), z)
    bh = F.coalesce(F.col("buy_hold_return"), z)
    return out.select(
        "symbol",
        total_return.alias("total_return"),
        final.alias("final_value"),
        F.coalesce("total_trades", zl).alias("total_trades"),
        F.coalesce("winning_trades", zl).alias("winning_trades"),
        F.coalesce("losing_trades", zl).alias("losing_trades"),
        F.coalesce("win_rate", z).alias("win_rate"),
        F.coalesce("avg_return", z).alias("avg_return"),
        F.coalesce("avg_winning_return", z).alias("avg_winning_return"),
        F.coalesce("avg_losing_return", z).alias("avg_losing_return"),
        vol.alias("volatility"),
        F.when(vol > 0, total_return / vol).otherwise(z).alias("sharpe_ratio"),
        F.coalesce("max_drawdown", z).alias("max_drawdown"),
        bh.alias("buy_hold_return"),
        (total_return - bh).alias("excess_return"),
        F.coalesce("data_points", zl).alias("data_points"),
        F.coalesce("signals_buy", zl).alias("signals_buy"),
        F.coalesce("signals_sell", zl).alias("signals_sell"),
        F.coalesce("signals_hold", zl).alias("signals_hold"),
        "start_date",
        "end_date",
        F.lit(cap).alias("initial_capital"),
    )


# Report layout and number formats of the surveyed report, in printf notation.
REPORT_TEMPLATE = """
BACKTEST REPORT - %s
{rule}

PERFORMANCE SUMMARY:
Total Return:           %.2f%%
Buy & Hold Return:      %.2f%%
Excess Return:          %.2f%%
Final Portfolio Value:  $%,.2f

RISK METRICS:
Volatility (Annual):    %.2f%%
Sharpe Ratio:          %.2f
Maximum Drawdown:      %.2f%%

TRADING STATISTICS:
Total Trades:          %d
Winning Trades:        %d
Losing Trades:         %d
Win Rate:             %.1f%%

AVERAGE RETURNS:
Average Return/Trade:  $%,.2f
Average Winning Trade: $%,.2f
Average Losing Trade:  $%,.2f

DATA INFO:
Data Points:          %d
Signal Distribution:  %s
""".format(rule="=" * 50)

#: What fills the template, in order: column, what it is multiplied by, decimals (None: as it is).
REPORT_FIELDS = [
    ("symbol", None, None), ("total_return", 100, 2), ("buy_hold_return", 100, 2), ("excess_return", 100, 2),
    ("final_value", 1, 2), ("volatility", 100, 2), ("sharpe_ratio", 1, 2), ("max_drawdown", 100, 2),
    ("total_trades", None, None), ("winning_trades", None, None), ("losing_trades", None, None), ("win_rate", 100, 1),
    ("avg_return", 1, 2), ("avg_winning_return", 1, 2), ("avg_losing_return", 1, 2), ("data_points", None, None),
]


def distribution_text() -> Column:
    """The signals that occur with their counts, most frequent first, equal counts by name."""
    found = F.filter(
        F.array(*[F.struct((-F.col(f"signals_{k}")).alias("n"), F.lit(k).alias("name")) for k in ("buy", "hold", "sell")]),
        lambda e: e["n"] < 0)
    parts = F.transform(F.array_sort(found), lambda e: F.concat(F.lit("'"), e["name"], F.lit("': "), (-e["n"]).cast("string")))
    return F.concat(F.lit("{"), F.array_join(parts, ", "), F.lit("}"))


def report(summary_df: DataFrame) -> DataFrame:
    """``symbol, report``: the formatted text report of each summary row."""
    shown = [F.col(c) if digits is None else F.round(F.col(c) * by, digits) + F.lit(0.0) for c, by, digits in REPORT_FIELDS]
    return summary_df.select("symbol", F.format_string(REPORT_TEMPLATE, *shown, distribution_text()).alias("report"))
