"""Registered queries vs their DuckDB SQL on the sf0.001 tables."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from barwright.plans import REGISTRY

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
NAMES = [
    "daily_bars", "all_indicators", "signal", "current_signals", "bt_trades", "bt_equity", "bt_summary",
    "resample", "ffill_bfill", "outlier_filter", "derive_volatility", "ml_scale", "ml_features_alt", "s_bars",
    "ema", "ema_long", "macd", "bollinger", "volume_sma", "position_size", "scan_intraday_range", "resample_weekly",
    "resample_monthly", "bt_empty", "dedup", "symbol_limit", "scan_symbols", "scan_symbols_missing", "m_trade_stats", "ml_split_small",
    "ml_evaluate_rule", "ml_predict_next_rule", "m_volatility", "m_excess", "m_sharpe", "m_max_drawdown",
    "all_indicators_blocked", "signal_blocked", "bt_incremental", "s_state", "s_signals", "s_trades", "s_bars_corrected", "s_bars_waves", "s_sliding_volume_waves",
    "latest_price_store", "universe_json", "ffill_bfill_head", "stop_loss", "take_profit", "sink_trading_log", "sink_performance",
    "sink_signals", "sink_log_by_symbol", "ml_confusion_rule", "sink_ml_rule", "model_save_load_rule", "ml_predictor_rule",
]


@pytest.fixture(scope="module")
def con(small_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small_dir}/{t}.parquet')")
    return c


def canon(df):
    cols = sorted(df.columns)

    def norm(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return None
        return str(pd.Timestamp(v)) if hasattr(v, "isoformat") else v

    rows = [tuple(norm(x) for x in r) for r in df[cols].itertuples(index=False, name=None)]
    return cols, sorted(rows, key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, small_dir, con, name):
    got = canon(E.queries()[name](spark, small_dir).toPandas())
    want = canon(con.sql(E.oracle_sql()[name]).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


def test_every_query_has_sql_or_is_model_or_stream():
    no_sql = {name for name, q in REGISTRY.items() if q.sql is None}  # the llm queries have tests of their own
    assert no_sql <= {"ml_train", "ml_predict_all", "ml_predict_next", "ml_evaluate", "ml_predictor",
                      "ml_importance", "sink_ml", "model_save_load", "ml_train_sums",
                      "ml_tree_importance", "ml_tree_evaluate", "ml_forest_importance"}


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "total_return" in df.columns


@pytest.mark.parametrize("name", ["resample_daily", "s_bars", "daily_bars"])
def test_time_bins_do_not_depend_on_session_zone(spark, small_dir, con, name):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = canon(E.queries()[name](spark, small_dir).toPandas())
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == canon(con.sql(E.oracle_sql()[name]).df())
