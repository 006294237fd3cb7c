"""DuckDB SQL oracles, written independently of the Spark code.

The SQL states each definition directly: trailing windows with ROWS frames,
the adjusted EMA as a weighted self-join over the last 479 rows (older weights
are below 1e-16), exact integer comparisons for decisions, and the backtest
as a recursive CTE over each symbol's events.  Doubles are rounded to 6
decimals in both engines (``+ 0.0`` turns -0.0 into 0.0).
"""

from __future__ import annotations

# ---------------------------------------------------------------- helpers


def r(expr: str, alias: str | None = None, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0 AS {alias or expr}"


def _split_top(spec: str) -> list[str]:
    """Split on commas that are not inside parentheses or quotes."""
    parts, depth, quote, cur = [], 0, False, []
    for ch in spec:
        if ch == "'":
            quote = not quote
        elif not quote and ch == "(":
            depth += 1
        elif not quote and ch == ")":
            depth -= 1
        if ch == "," and depth == 0 and not quote:
            parts.append("".join(cur))
            cur = []
        else:
            cur.append(ch)
    parts.append("".join(cur))
    return parts


def proj(spec: str) -> str:
    """'a, d:b, d:c=expr' -> select list; 'd:' marks a rounded double."""
    out = []
    for item in [s.strip() for s in _split_top(spec) if s.strip()]:
        if item.startswith("d:"):
            body = item[2:]
            if "=" in body:
                alias, expr = body.split("=", 1)
                out.append(r(expr, alias))
            else:
                out.append(r(body))
        else:
            out.append(item)
    return ", ".join(out)


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes)


# ---------------------------------------------------------------- bars


def bars_cte(name: str = "bars", scaled: bool = True) -> str:
    if scaled:
        px = "10000 + (2 * CAST(round(l.l_extendedprice * 100) AS BIGINT) + CAST(l.l_quantity AS BIGINT) * 10000) // (2 * CAST(l.l_quantity AS BIGINT) * 10000)"
    else:
        px = "(2 * CAST(round(l.l_extendedprice * 100) AS BIGINT) + CAST(l.l_quantity AS BIGINT)) // (2 * CAST(l.l_quantity AS BIGINT))"
    key = "l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice, l.l_quantity"
    keyd = "l.l_orderkey DESC, l.l_linenumber DESC, l.l_partkey DESC, l.l_suppkey DESC, l.l_extendedprice DESC, l.l_quantity DESC"
    return f"""{name}_ticks AS (
  SELECT p.p_brand AS symbol, CAST(l.l_shipdate AS DATE) AS ts, {px} AS px, l.l_quantity AS qty,
         row_number() OVER (PARTITION BY p.p_brand, CAST(l.l_shipdate AS DATE) ORDER BY {key}) AS r_first,
         row_number() OVER (PARTITION BY p.p_brand, CAST(l.l_shipdate AS DATE) ORDER BY {keyd}) AS r_last
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
),
{name} AS (
  SELECT symbol, ts,
         CAST(max(CASE WHEN r_first = 1 THEN px END) AS DOUBLE) / 100.0 AS open,
         CAST(max(px) AS DOUBLE) / 100.0 AS high,
         CAST(min(px) AS DOUBLE) / 100.0 AS low,
         CAST(max(CASE WHEN r_last = 1 THEN px END) AS DOUBLE) / 100.0 AS close,
         CAST(sum(qty) AS DOUBLE) AS volume
  FROM {name}_ticks GROUP BY symbol, ts
)"""


# ---------------------------------------------------------------- indicators


def ema_join(src: str, out: str, value: str, spans: dict[str, int], keys: str = "symbol, ts") -> str:
    """Adjusted EMA by weighted self-join on the per-symbol row number ``rn``."""
    sums = []
    for name, span in spans.items():
        q = f"(CAST({span - 1} AS DOUBLE) / CAST({span + 1} AS DOUBLE))"
        sums.append(
            f"sum(b.{value} * pow({q}, a.rn - b.rn)) / sum(pow({q}, a.rn - b.rn)) AS {name}"
        )
    cols = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    return f"""{out} AS (
  SELECT {cols}, {', '.join(sums)}
  FROM {src} a JOIN {src} b ON a.symbol = b.symbol AND b.rn <= a.rn
  GROUP BY {cols}
)"""


def indicators_ctes(src: str = "bars", out: str = "ind") -> str:
    """CTEs ending in ``out``: bars + indicators + exact helper sums."""
    return f"""{out}_b1 AS (
  SELECT *, CAST(round(close * 100) AS BIGINT) AS c_c, CAST(round(high * 100) AS BIGINT) AS h_c,
         CAST(round(low * 100) AS BIGINT) AS l_c,
         row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn,
         close - first_value(close) OVER (PARTITION BY symbol ORDER BY ts) AS xc
  FROM {src}
),
{out}_b2 AS (
  SELECT *, c_c - lag(c_c) OVER (PARTITION BY symbol ORDER BY ts) AS d,
         lag(c_c) OVER (PARTITION BY symbol ORDER BY ts) AS pc
  FROM {out}_b1
),
{out}_b3 AS (
  SELECT *,
    sum(CASE WHEN d > 0 THEN d ELSE 0 END) OVER w14 AS sg,
    sum(CASE WHEN d < 0 THEN -d ELSE 0 END) OVER w14 AS sl,
    sum(c_c) OVER w20 AS s20, count(*) OVER w20 AS n20,
    sum(c_c * c_c) OVER w20 AS q20,
    sum(c_c) OVER w50 AS s50, count(*) OVER w50 AS n50,
    sum(volume) OVER w20 AS vs20, count(*) OVER w20 AS vn20,
    min(l_c) OVER w14 AS ll, max(h_c) OVER w14 AS hh,
    sum(greatest(h_c - l_c, coalesce(abs(h_c - pc), 0), coalesce(abs(l_c - pc), 0))) OVER w14 AS trs,
    count(*) OVER w14 AS n14
  FROM {out}_b2
  WINDOW w14 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 13 PRECEDING AND CURRENT ROW),
         w20 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
         w50 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)
),
{out}_b4 AS (
  SELECT *,
    CASE WHEN sl = 0 THEN (CASE WHEN sg = 0 THEN 50.0 ELSE 100.0 END)
         ELSE 100.0 - 100.0 / (1.0 + CAST(sg AS DOUBLE) / CAST(sl AS DOUBLE)) END AS rsi,
    CAST(s20 AS DOUBLE) / CAST(n20 * 100 AS DOUBLE) AS ma_20,
    CAST(s50 AS DOUBLE) / CAST(n50 * 100 AS DOUBLE) AS ma_50,
    CASE WHEN n20 > 1 THEN sqrt(CAST(n20 * q20 - s20 * s20 AS DOUBLE) / CAST(n20 * (n20 - 1) AS DOUBLE)) / 100.0 END AS bb_sd,
    vs20 / vn20 AS volume_sma,
    CAST(trs AS DOUBLE) / CAST(n14 * 100 AS DOUBLE) AS atr,
    100.0 * (CAST(c_c - ll AS DOUBLE) / NULLIF(CAST(hh - ll AS DOUBLE), 0)) AS k_raw
  FROM {out}_b3
),
{out}_b5 AS (
  SELECT *, ma_20 AS bb_middle, ma_20 + bb_sd * 2.0 AS bb_upper, ma_20 - bb_sd * 2.0 AS bb_lower,
         coalesce(k_raw, 50.0) AS stoch_k,
         coalesce(avg(k_raw) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 50.0) AS stoch_d
  FROM {out}_b4
),
{ema_join(out + '_b1', out + '_e1', 'xc', {'ema12': 12, 'ema26': 26})},
{out}_m1 AS (
  SELECT b.symbol, b.ts, b.rn, e.ema12 - e.ema26 AS macd
  FROM {out}_b1 b JOIN {out}_e1 e ON b.symbol = e.symbol AND b.ts = e.ts
),
{ema_join(out + '_m1', out + '_e2', 'macd', {'macd_signal': 9})},
{out} AS (
  SELECT b.*, m.macd, e.macd_signal, m.macd - e.macd_signal AS macd_histogram
  FROM {out}_b5 b JOIN {out}_m1 m ON b.symbol = m.symbol AND b.ts = m.ts
  JOIN {out}_e2 e ON b.symbol = e.symbol AND b.ts = e.ts
)"""


BAR_COLS = "symbol, ts, d:open, d:high, d:low, d:close, d:volume"
IND_COLS = (
    "d:rsi, d:ma_20, d:ma_50, d:macd, d:macd_signal, d:macd_histogram, d:bb_upper, d:bb_middle, "
    "d:bb_lower, d:volume_sma, d:atr, d:stoch_k, d:stoch_d"
)


def signals_ctes(src: str = "ind", out: str = "sig", bonus: float = 0.1) -> str:
    return f"""{out}_a AS (
  SELECT *, CASE WHEN s20 * n50 > s50 * n20 THEN 1 ELSE -1 END AS ma_cross
  FROM {src}
),
{out}_b AS (
  SELECT *, ma_cross - lag(ma_cross) OVER (PARTITION BY symbol ORDER BY ts) AS ma_cross_signal,
         70 * sg < 30 * sl AS oversold, 30 * sg > 70 * sl AS overbought
  FROM {out}_a
),
{out}_c AS (
  SELECT *, coalesce(ma_cross_signal = 2, false) AS cross_up, coalesce(ma_cross_signal = -2, false) AS cross_down,
         CASE WHEN vn20 = 20 THEN vs20 / 20.0 END AS volume_avg,
         coalesce(vn20 = 20 AND 40 * volume > 3 * vs20, false) AS volume_spike,
         coalesce(macd > macd_signal, false) AS macd_bullish,
         coalesce(macd < macd_signal, false) AS macd_bearish
  FROM {out}_b
),
{out}_d AS (
  SELECT *, overbought OR cross_down AS is_sell, oversold OR cross_up AS is_buy FROM {out}_c
),
{out} AS (
  SELECT *,
    CASE WHEN is_sell THEN 'sell' WHEN is_buy THEN 'buy' ELSE 'hold' END AS signal,
    least(
      (CASE WHEN is_sell THEN (rsi - 70.0) / 30.0 * 0.5 + (CASE WHEN cross_down THEN 1.0 ELSE 0.0 END) * 0.5
            WHEN is_buy THEN (30.0 - rsi) / 30.0 * 0.5 + (CASE WHEN cross_up THEN 1.0 ELSE 0.0 END) * 0.5
            ELSE 0.0 END
       + CASE WHEN (is_sell OR is_buy) AND volume_spike THEN {bonus} ELSE 0.0 END)
       + CASE WHEN is_sell AND macd_bearish THEN {bonus} WHEN is_sell THEN 0.0
              WHEN is_buy AND macd_bullish THEN {bonus} ELSE 0.0 END,
      1.0) AS signal_strength,
    concat_ws(' ', CASE WHEN oversold THEN 'RSI_OVERSOLD' END, CASE WHEN cross_up THEN 'MA_CROSSOVER_UP' END,
                   CASE WHEN overbought THEN 'RSI_OVERBOUGHT' END, CASE WHEN cross_down THEN 'MA_CROSSOVER_DOWN' END)
      AS entry_reason
  FROM {out}_d
)"""


SIG_COLS = (
    "signal, d:signal_strength, entry_reason, ma_cross, ma_cross_signal, d:volume_avg, "
    "volume_spike, macd_bullish, macd_bearish"
)


def over_signals(select: str, tail: str = "", scaled: bool = True) -> str:
    return with_(bars_cte(scaled=scaled), indicators_ctes(), signals_ctes()) + f"\nSELECT {select} FROM sig {tail}"


def over_indicators(select: str, tail: str = "") -> str:
    return with_(bars_cte(), indicators_ctes()) + f"\nSELECT {select} FROM ind {tail}"


def over_bars(select: str, tail: str = "", scaled: bool = True) -> str:
    return with_(bars_cte(scaled=scaled)) + f"\nSELECT {select} FROM bars {tail}"


# ---------------------------------------------------------------- backtest


def backtest_ctes(src: str = "sig") -> str:
    """Recursive CTE over *every* bar (plus an end row) of each symbol.

    ``st`` holds the state after step k and the trade made at step k, if any.
    """
    return f"""bt_rows AS (
  SELECT symbol, ts, close, signal, rsi, ma_20, ma_50, 0 AS kind,
         row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k
  FROM {src}
  UNION ALL
  SELECT symbol, max(ts), max_by(close, ts), 'end', max_by(rsi, ts), max_by(ma_20, ts), max_by(ma_50, ts), 1,
         count(*) + 1
  FROM {src} GROUP BY symbol
),
st AS (
  SELECT symbol, CAST(0 AS BIGINT) AS k, CAST(NULL AS DATE) AS ts, CAST(100000.0 AS DOUBLE) AS cash,
         CAST(0 AS BIGINT) AS pos, CAST(0.0 AS DOUBLE) AS ep, CAST('' AS VARCHAR) AS er,
         CAST(NULL AS VARCHAR) AS act, CAST(NULL AS BIGINT) AS qty, CAST(NULL AS DOUBLE) AS price,
         CAST(NULL AS DOUBLE) AS val, CAST(NULL AS DOUBLE) AS comm, CAST(NULL AS DOUBLE) AS pnl,
         CAST(NULL AS VARCHAR) AS ter, CAST(NULL AS VARCHAR) AS xr, CAST(NULL AS DOUBLE) AS t_rsi,
         CAST(NULL AS DOUBLE) AS t_ma20, CAST(NULL AS DOUBLE) AS t_ma50, 0 AS kind
  FROM (SELECT DISTINCT symbol FROM bt_rows)
  UNION ALL
  SELECT symbol, k, ts,
    CASE WHEN do_buy THEN cash - buy_total WHEN do_sell THEN cash + sell_net ELSE cash END,
    CASE WHEN do_buy THEN sh WHEN do_sell THEN 0 ELSE pos END,
    CASE WHEN do_buy THEN close WHEN do_sell THEN 0.0 ELSE ep END,
    CASE WHEN do_buy THEN buy_reason WHEN do_sell THEN '' ELSE er END,
    CASE WHEN do_buy THEN 'buy' WHEN do_sell THEN 'sell' END,
    CASE WHEN do_buy THEN sh WHEN do_sell THEN pos END,
    CASE WHEN do_buy OR do_sell THEN close END,
    CASE WHEN do_buy THEN buy_total WHEN do_sell THEN sell_net END,
    CASE WHEN do_buy THEN buy_tv * 0.001 WHEN do_sell THEN sell_tv * 0.001 END,
    CASE WHEN do_buy THEN 0.0 WHEN do_sell THEN sell_net - CAST(pos AS DOUBLE) * ep END,
    CASE WHEN do_buy THEN buy_reason WHEN do_sell THEN er END,
    CASE WHEN do_sell AND kind = 1 THEN 'Position closed at end of backtest'
         WHEN do_sell THEN printf('Sell signal: RSI=%.1f, MA20=%.1f, MA50=%.1f', rsi, ma_20, ma_50) END,
    CASE WHEN do_buy OR do_sell THEN rsi END,
    CASE WHEN do_buy OR do_sell THEN ma_20 END,
    CASE WHEN do_buy OR do_sell THEN ma_50 END,
    kind
  FROM (
    SELECT y.*,
      signal = 'buy' AND pos = 0 AND cash > close AND sh > 0 AND buy_total <= cash AS do_buy,
      ((kind = 0 AND signal = 'sell') OR kind = 1) AND pos > 0 AS do_sell
    FROM (
      SELECT x.*, CAST(x.sh AS DOUBLE) * x.close AS buy_tv,
             (CAST(x.sh AS DOUBLE) * x.close + CAST(x.sh AS DOUBLE) * x.close * 0.001) + CAST(x.sh AS DOUBLE) * x.close * 0.001 AS buy_total,
             CAST(x.pos AS DOUBLE) * x.close AS sell_tv,
             (CAST(x.pos AS DOUBLE) * x.close - CAST(x.pos AS DOUBLE) * x.close * 0.001) - CAST(x.pos AS DOUBLE) * x.close * 0.001 AS sell_net,
             printf('Buy signal: RSI=%.1f, MA20=%.1f, MA50=%.1f', x.rsi, x.ma_20, x.ma_50) AS buy_reason
      FROM (
        SELECT s.symbol, e.k, e.ts, s.cash, s.pos, s.ep, s.er, e.close, e.signal, e.rsi, e.ma_20, e.ma_50, e.kind,
               CASE WHEN s.cash > e.close THEN CAST(floor(s.cash * 0.95 / e.close) AS BIGINT) ELSE 0 END AS sh
        FROM st s JOIN bt_rows e ON e.symbol = s.symbol AND e.k = s.k + 1
      ) x
    ) y
  ) z
),
bt_trades AS (
  SELECT symbol, ts AS date, k, act AS action, qty AS quantity, price, val AS value, comm AS commission,
         1.0 AS signal_strength, ter AS entry_reason, t_rsi AS rsi, t_ma20 AS ma_20, t_ma50 AS ma_50,
         pnl, xr AS exit_reason, cash AS cash_after, pos AS position_after, kind = 1 AS final
  FROM st WHERE act IS NOT NULL
),
bt_equity AS (
  SELECT e.symbol, e.ts AS date, s.cash + CAST(s.pos AS DOUBLE) * e.close AS value, s.cash, s.pos AS position,
         e.close AS price
  FROM bt_rows e JOIN st s ON s.symbol = e.symbol AND s.k = e.k - 1
  WHERE e.kind = 0
),
bt_curve AS (
  SELECT symbol,
    CASE WHEN count(ret) > 1 THEN stddev_samp(ret) * sqrt(252.0) ELSE 0.0 END AS volatility,
    min(dd) AS max_drawdown
  FROM (
    SELECT symbol, value / lag(value) OVER w - 1.0 AS ret,
           (value - max(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
             / max(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS dd
    FROM bt_equity WINDOW w AS (PARTITION BY symbol ORDER BY date)
  ) GROUP BY symbol
),
bt_final AS (
  SELECT symbol, max_by(cash, k) AS final_value FROM st GROUP BY symbol
),
bt_tstats AS (
  SELECT symbol,
    count(*) FILTER (WHERE action = 'sell') AS total_trades,
    count(*) FILTER (WHERE action = 'sell' AND pnl > 0) AS winning_trades,
    count(*) FILTER (WHERE action = 'sell' AND pnl <= 0) AS losing_trades,
    coalesce(avg(pnl) FILTER (WHERE action = 'sell'), 0.0) AS avg_return,
    coalesce(avg(pnl) FILTER (WHERE action = 'sell' AND pnl > 0), 0.0) AS avg_winning_return,
    coalesce(avg(pnl) FILTER (WHERE action = 'sell' AND pnl <= 0), 0.0) AS avg_losing_return
  FROM bt_trades GROUP BY symbol
),
bt_bars AS (
  SELECT symbol, count(*) AS data_points, min(ts) AS start_date, max(ts) AS end_date,
    CASE WHEN count(*) > 1 THEN (max_by(close, ts) - min_by(close, ts)) / min_by(close, ts) ELSE 0.0 END AS buy_hold_return,
    count(*) FILTER (WHERE signal = 'buy') AS signals_buy,
    count(*) FILTER (WHERE signal = 'sell') AS signals_sell,
    count(*) FILTER (WHERE signal = 'hold') AS signals_hold
  FROM {src} GROUP BY symbol
),
bt_sum0 AS (
  SELECT b.*, f.final_value, (f.final_value - 100000.0) / 100000.0 AS total_return,
    coalesce(t.total_trades, 0) AS total_trades, coalesce(t.winning_trades, 0) AS winning_trades,
    coalesce(t.losing_trades, 0) AS losing_trades,
    CASE WHEN coalesce(t.total_trades, 0) > 0 THEN CAST(t.winning_trades AS DOUBLE) / CAST(t.total_trades AS DOUBLE) ELSE 0.0 END AS win_rate,
    coalesce(t.avg_return, 0.0) AS avg_return, coalesce(t.avg_winning_return, 0.0) AS avg_winning_return,
    coalesce(t.avg_losing_return, 0.0) AS avg_losing_return,
    c.volatility, c.max_drawdown
  FROM bt_bars b JOIN bt_final f USING (symbol) JOIN bt_curve c USING (symbol)
  LEFT JOIN bt_tstats t USING (symbol)
),
bt_summary AS (
  SELECT *, CASE WHEN volatility > 0 THEN total_return / volatility ELSE 0.0 END AS sharpe_ratio,
         total_return - buy_hold_return AS excess_return, 100000.0 AS initial_capital
  FROM bt_sum0
)"""


TRADE_COLS = (
    "symbol, date, action, quantity, d:price, d:value, d:commission, d:signal_strength, entry_reason, "
    "d:rsi, d:ma_20, d:ma_50, d:pnl, exit_reason"
)
SUMMARY_COLS = (
    "symbol, d:total_return, d:final_value, total_trades, winning_trades, losing_trades, d:win_rate, "
    "d:avg_return, d:avg_winning_return, d:avg_losing_return, d:volatility, d:sharpe_ratio, d:max_drawdown, "
    "d:buy_hold_return, d:excess_return, data_points, signals_buy, signals_sell, signals_hold, start_date, "
    "end_date, d:initial_capital"
)


def over_backtest(select: str, frm: str, tail: str = "") -> str:
    return (
        "WITH RECURSIVE " + ",\n".join([bars_cte(), indicators_ctes(), signals_ctes(), backtest_ctes()])
        + f"\nSELECT {select} FROM {frm} {tail}"
    )
