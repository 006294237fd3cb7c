"""Physical-plan checks: one exchange for the indicator chain, no Python in
it, filters pushed to the scan."""

import pytest

from barwright.operators import indicators as I
from barwright.operators import signals as S
from barwright.plans import REGISTRY
from barwright.sources import fixtures as FX


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_indicator_chain_one_exchange_no_python(spark, small_dir):
    bars = FX.daily_bars(spark, small_dir).checkpoint(eager=True)
    p = plan(S.generate_signals(bars))
    assert p.count("Exchange hashpartitioning(symbol") == 1
    assert "Python" not in p and "ArrowEval" not in p


def test_scan_daily_pushes_date_filter(spark, small_dir):
    p = plan(REGISTRY["scan_daily"].build(spark, small_dir))
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in p


def test_backtest_reuses_symbol_partitioning(spark, small_dir):
    bars = FX.daily_bars(spark, small_dir).checkpoint(eager=True)
    from barwright.operators import backtest as B

    p = plan(B.run_backtest(S.generate_signals(bars)))
    # the fold runs on the exchange made for the indicator windows: no second one
    assert p.count("Exchange hashpartitioning(symbol") == 1


def test_bars_read_only_needed_columns(spark, small_dir):
    p = plan(FX.daily_bars(spark, small_dir))
    assert "l_discount" not in p and "l_tax" not in p and "l_comment" not in p


def test_bars_use_hash_aggregation(spark, small_dir):
    p = plan(FX.daily_bars(spark, small_dir))
    assert "SortAggregate" not in p and "HashAggregate" in p


def test_tick_key_orders_like_its_columns(spark):
    rows = [(1, 2, 3, 4), (1, 2, 3, 5), (1, 2, 4, 1), (1, 3, 1, 1), (2, 1, 1, 1), (999_999_999_999, 7, 25_000_000_000, 1_000_000_000)]
    df = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long")
    got = df.orderBy(FX.tick_key()).collect()
    assert [tuple(r) for r in got] == sorted(rows)
    assert df.select(FX.tick_key().alias("k")).distinct().count() == len(rows)


def test_line_number_too_large_is_an_error(spark):
    df = spark.createDataFrame([(1, 10, 1, 1)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long")
    with pytest.raises(Exception, match="NUMERIC_VALUE_OUT_OF_RANGE|CAST_OVERFLOW"):
        df.select(FX.tick_key()).collect()
