"""Per-symbol streaming state: running adjusted EMAs -> MACD and signal line.

``applyInPandasWithState`` keyed by symbol keeps, per symbol, the first close
(centring), the last bar time, and the numerator / denominator of the three
adjusted EMAs (``N_t = x_t + q N_{t-1}``, ``D_t = 1 + q D_{t-1}``).  Each
micro-batch is processed in time order; a bar not newer than the stored last
bar is late: it is put out with ``late`` true and no values, so that late bars
can be counted and replayed.  A task holds a symbol's bars of one micro-batch
(bounded by the source's files per trigger).  State is O(1) per symbol and lives in the state
store (checkpointed), so it survives restarts and executor loss.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from ..config import DEFAULT, IndicatorParams

STATE_SCHEMA = T.StructType([
    T.StructField("x0", T.DoubleType()),
    T.StructField("last_ts", T.DateType()),
    T.StructField("nf", T.DoubleType()), T.StructField("df", T.DoubleType()),
    T.StructField("ns", T.DoubleType()), T.StructField("ds", T.DoubleType()),
    T.StructField("ng", T.DoubleType()), T.StructField("dg", T.DoubleType()),
])
OUT_SCHEMA = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("ts", T.DateType()),
    T.StructField("macd", T.DoubleType()),
    T.StructField("macd_signal", T.DoubleType()),
    T.StructField("late", T.BooleanType()),
])


def _updater(p: IndicatorParams):
    qf = 1.0 - 2.0 / (p.macd_fast + 1.0)
    qs = 1.0 - 2.0 / (p.macd_slow + 1.0)
    qg = 1.0 - 2.0 / (p.macd_signal + 1.0)

    def update(key, batches, state):
        pdf = pd.concat(list(batches)).sort_values("ts")
        if state.exists:
            x0, last_ts, nf, df_, ns, ds, ng, dg = state.get
        else:
            x0, last_ts, nf, df_, ns, ds, ng, dg = None, None, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0
        out_ts, out_m, out_s, out_late = [], [], [], []
        for ts, close in zip(pdf["ts"], pdf["close"]):
            out_ts.append(ts)
            out_late.append(last_ts is not None and ts <= last_ts)
            if out_late[-1]:
                out_m.append(None)
                out_s.append(None)
                continue
            if x0 is None:
                x0 = close
            x = close - x0
            nf, df_ = x + qf * nf, 1.0 + qf * df_
            ns, ds = x + qs * ns, 1.0 + qs * ds
            m = nf / df_ - ns / ds
            ng, dg = m + qg * ng, 1.0 + qg * dg
            out_m.append(m)
            out_s.append(ng / dg)
            last_ts = ts
        if x0 is not None:
            state.update((x0, last_ts, nf, df_, ns, ds, ng, dg))
        yield pd.DataFrame({"symbol": key[0], "ts": out_ts, "macd": out_m, "macd_signal": out_s, "late": out_late})

    return update


def streaming_macd(bar_stream: DataFrame, p: IndicatorParams = DEFAULT.indicators) -> DataFrame:
    return bar_stream.select("symbol", "ts", "close").groupBy("symbol").applyInPandasWithState(
        _updater(p), OUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout
    )
