"""Backtest queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.materialize import materialize
from ..operators import backtest as B
from ..sources import fixtures as FX
from . import oracle as O
from .catalog import register, rounded
from .queries_core import bars, signals


# what the fold, the equity curve and the metrics read of the signal table
NEEDED = ["symbol", "ts", "close", "signal", "rsi", "ma_20", "ma_50"]


def ledger(spark, sf_dir):
    return B.run_backtest(signals(spark, sf_dir))


def _tables(spark, sf_dir):
    """The pruned signal table and the (small) ledger, each written once: several plans read both."""
    s = materialize(signals(spark, sf_dir).select(*NEEDED))
    return s, materialize(B.run_backtest(s))


@register(
    "bt_fold",
    O.over_backtest(O.proj("symbol, date, action, quantity, d:value, d:cash_after, position_after, final"), "bt_trades"),
)
def q_bt_fold(spark, sf_dir):
    return rounded(ledger(spark, sf_dir).select(
        "symbol", "date", "action", "quantity", "value", "cash_after", "position_after", "final"))


@register("bt_trades", O.over_backtest(O.proj(O.TRADE_COLS), "bt_trades"))
def q_bt_trades(spark, sf_dir):
    return rounded(B.trades(ledger(spark, sf_dir)))


@register(
    "bt_pnl",
    O.over_backtest(O.proj("symbol, date, quantity, d:price, d:value, d:pnl"), "bt_trades", "WHERE action = 'sell'"),
)
def q_bt_pnl(spark, sf_dir):
    t = ledger(spark, sf_dir).filter(F.col("action") == "sell")
    return rounded(t.select("symbol", "date", "quantity", "price", "value", "pnl"))


@register(
    "bt_final_close",
    O.over_backtest(O.proj("symbol, date, quantity, d:price, d:value, d:pnl, entry_reason, exit_reason"),
                    "bt_trades", "WHERE final"),
)
def q_bt_final_close(spark, sf_dir):
    t = ledger(spark, sf_dir).filter(F.col("final"))
    return rounded(t.select("symbol", "date", "quantity", "price", "value", "pnl", "entry_reason", "exit_reason"))


@register("bt_incremental", O.over_backtest(O.proj(O.TRADE_COLS), "bt_trades"))
def q_bt_incremental(spark, sf_dir):
    """The ledger in two parts: the first half of the days, then the rest from the saved state; equal to the ledger of all."""
    s = materialize(signals(spark, sf_dir).select(*NEEDED))
    middle = s.agg(F.expr("date_add(min(ts), cast(datediff(max(ts), min(ts)) / 2 as int))")).first()[0]
    early = materialize(B.continue_backtest(s.where(F.col("ts") <= F.lit(middle))))
    late = materialize(B.continue_backtest(s, B.saved_state(early)))
    return rounded(B.trades(B.append_ledger(early, late)))


@register("bt_equity", O.over_backtest(O.proj("symbol, date, d:value, d:cash, position, d:price"), "bt_equity"))
def q_bt_equity(spark, sf_dir):
    return rounded(B.equity_curve(*_tables(spark, sf_dir)))


def _summary(spark, sf_dir):
    s, trades = _tables(spark, sf_dir)
    return B.summary(s, trades, universe=FX.derived_universe(spark, sf_dir))


@register("bt_summary", O.over_backtest(O.proj(O.SUMMARY_COLS), "bt_summary"))
def q_bt_summary(spark, sf_dir):
    return rounded(_summary(spark, sf_dir).select(*B.SUMMARY_COLUMNS))


def _known(spark, sf_dir):
    return FX.derived_universe(spark, sf_dir).select("symbol").distinct()


def _curve_metric(name: str, *cols: str):
    """Metrics of the equity curve, merged from blocks; the return in the Sharpe ratio comes from the ledger."""

    @register(name, O.over_backtest(O.proj("symbol, " + ", ".join(f"d:{c}" for c in cols)), "bt_summary"))
    def q(spark, sf_dir):
        s, trades = _tables(spark, sf_dir)
        curve = B.merge_blocks(B.curve_blocks(s, trades))
        out = B.ledger_summary(_known(spark, sf_dir), trades).join(curve, "symbol", "left")
        vol = F.coalesce("volatility", F.lit(0.0))
        out = out.withColumn("sharpe_ratio", F.when(vol > 0, F.col("total_return") / vol).otherwise(F.lit(0.0)))
        return rounded(out.select("symbol", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in cols]))

    return q


def _ledger_metric(name: str, cols: str):
    """Metrics that the ledger alone gives: one pass over the trades, nothing written."""
    spark_cols = [c.split("=")[0].replace("d:", "") for c in cols.split(", ")]

    @register(name, O.over_backtest(O.proj("symbol, " + cols), "bt_summary"))
    def q(spark, sf_dir):
        return rounded(B.ledger_summary(_known(spark, sf_dir), ledger(spark, sf_dir)).select("symbol", *spark_cols))

    return q


_ledger_metric("m_total_return", "d:total_return, d:final_value")
_ledger_metric("m_trade_stats", "total_trades, winning_trades, losing_trades, d:win_rate, d:avg_return, "
               "d:avg_winning_return, d:avg_losing_return")
_curve_metric("m_volatility", "volatility")
_curve_metric("m_sharpe", "sharpe_ratio")
_curve_metric("m_max_drawdown", "max_drawdown")


@register("m_buy_hold", O.over_backtest(O.proj("symbol, d:buy_hold_return"), "bt_summary"))
def q_buy_hold(spark, sf_dir):
    """First and last close of each symbol's bars: no signals, no fold."""
    return rounded(_buy_hold(spark, sf_dir))


def _buy_hold(spark, sf_dir):
    held = B.bar_metrics(bars(spark, sf_dir).withColumn("signal", F.lit("hold")))
    return _known(spark, sf_dir).join(held, "symbol", "left").select(
        "symbol", F.coalesce("buy_hold_return", F.lit(0.0)).alias("buy_hold_return"))


@register("m_excess", O.over_backtest(O.proj("symbol, d:excess_return"), "bt_summary"))
def q_excess(spark, sf_dir):
    """Return of the ledger over buy-and-hold of the bars: no equity curve."""
    gained = B.ledger_summary(_known(spark, sf_dir), ledger(spark, sf_dir))
    out = gained.join(_buy_hold(spark, sf_dir), "symbol")
    return rounded(out.select("symbol", (F.col("total_return") - F.col("buy_hold_return")).alias("excess_return")))


EMPTY_COLS = ["total_return", "final_value", "total_trades", "win_rate", "volatility", "sharpe_ratio", "max_drawdown",
              "buy_hold_return", "data_points", "initial_capital"]


@register(
    "bt_empty",
    O.with_(O.bars_cte(), """watch AS (SELECT DISTINCT p_brand AS symbol FROM part UNION SELECT DISTINCT event_type FROM events)""")
    + """
SELECT symbol, CAST(0 AS DOUBLE) AS total_return, CAST(100000 AS DOUBLE) AS final_value, CAST(0 AS BIGINT) AS total_trades,
       CAST(0 AS DOUBLE) AS win_rate, CAST(0 AS DOUBLE) AS volatility, CAST(0 AS DOUBLE) AS sharpe_ratio,
       CAST(0 AS DOUBLE) AS max_drawdown, CAST(0 AS DOUBLE) AS buy_hold_return, CAST(0 AS BIGINT) AS data_points,
       CAST(100000 AS DOUBLE) AS initial_capital
FROM watch WHERE symbol NOT IN (SELECT symbol FROM bars)""",
)
def q_bt_empty(spark, sf_dir):
    """The empty result of listed symbols that have no bars (tick symbols are listed, too)."""
    listed = (FX.derived_universe(spark, sf_dir).select("symbol")
              .union(FX.table(spark, sf_dir, "events").select("event_type")).distinct())
    return rounded(B.empty_summary(listed, bars(spark, sf_dir)).select("symbol", *EMPTY_COLS))


def _report_sql() -> str:
    """The same layout in DuckDB's printf, which has no thousands separator beside %: those go through format."""
    args = []
    for c, by, digits in B.REPORT_FIELDS:
        if digits is None:
            args.append(c)
        elif by == 1 and c != "sharpe_ratio":
            args.append(f"format('{{:,.{digits}f}}', round({c}, {digits}) + 0.0)")
        else:
            args.append(f"round({c} * {by}, {digits}) + 0.0")
    template = B.REPORT_TEMPLATE.replace("%,.2f", "%s")
    distribution = """(SELECT string_agg(name || ': ' || n, ', ' ORDER BY n DESC, name)
    FROM (VALUES ('''buy''', signals_buy), ('''hold''', signals_hold), ('''sell''', signals_sell)) d(name, n) WHERE n > 0)"""
    return f"symbol, printf('{template}', {', '.join(args)}, '{{' || {distribution} || '}}') AS report"


@register("bt_report", O.over_backtest(_report_sql(), "bt_summary"))
def q_bt_report(spark, sf_dir):
    return B.report(_summary(spark, sf_dir))
