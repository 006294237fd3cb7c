"""Blocks instead of whole symbols, tagged rows instead of joins, folds that go on: equal values and the plans they are for."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barwright.functions import blocks
from barwright.operators import backtest as B
from barwright.operators import indicators as I
from barwright.operators import signals as S
from barwright.plans import REGISTRY
from barwright.sources import fixtures as FX
from barwright.sources.bars import BAR_SCHEMA


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def walk(symbol, days, seed, every=1):
    rng = np.random.default_rng(seed)
    close = (300 + np.cumsum(rng.integers(-300, 301, days)) / 100).round(2).clip(5)
    close[days // 2:days // 2 + 60] = close[days // 2]  # a constant run
    return pd.DataFrame({
        "symbol": symbol, "ts": [dt.date(1980, 1, 1) + dt.timedelta(days=i * every) for i in range(days)],
        "open": close, "high": close + rng.integers(0, 3, days), "low": close - rng.integers(0, 3, days), "close": close,
        "volume": 1.0 * rng.integers(1, 50, days)})


@pytest.fixture(scope="module")
def one_symbol(spark):
    return spark.createDataFrame(walk("HUGE", 6000, 1), BAR_SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def several(spark):
    parts = [walk("A", 1500, 2), walk("B", 513, 3, every=9), walk("C", 512, 4), walk("D", 51, 5), walk("E", 1, 6), walk("F", 1025, 7, every=3)]
    return spark.createDataFrame(pd.concat(parts), BAR_SCHEMA).repartition(4).cache()


def values(df, columns):
    return df.select("symbol", "ts", *columns).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)


@pytest.mark.parametrize("table", ["one_symbol", "several"])
def test_blocked_signals_are_the_same(table, request):
    bars = request.getfixturevalue(table)
    want = values(S.generate_signals(bars), [*I.INDICATOR_COLUMNS, *S.SIGNAL_COLUMNS])
    got = values(S.generate_signals(bars, block_rows=512), [*I.INDICATOR_COLUMNS, *S.SIGNAL_COLUMNS])
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    numbers = [c for c in want.columns if want[c].dtype == float]
    assert np.allclose(got[numbers], want[numbers], rtol=0, atol=1e-9, equal_nan=True)
    others = [c for c in want.columns if c not in numbers]
    pd.testing.assert_frame_equal(got[others], want[others])


def test_one_symbol_is_spread_over_tasks(spark, one_symbol):
    out = S.generate_signals(one_symbol, block_rows=512)
    p = plan(out)
    assert "hashpartitioning(symbol#" in p
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = S.generate_signals(one_symbol, block_rows=512).select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tasks > 4  # twelve blocks over eight partitions; by symbol it would be one
    # every window over rows is keyed by the struct (symbol, block) or by (symbol, bucket); whole symbols only in tables of one row a block
    dealt = blocks.deal(one_symbol, 512, 51)
    assert dealt.groupBy("symbol").count().agg(F.max("count")).first()[0] == 512 + 51
    assert dealt.where("not _halo").count() == 6000


def test_row_numbers_need_no_whole_symbol(several):
    rows = blocks.with_row_numbers(several, 100).select("symbol", "ts", "_ewm_rn", "_x0", "close").toPandas().sort_values(["symbol", "ts"])
    for _, part in rows.groupby("symbol"):
        assert part["_ewm_rn"].tolist() == list(range(len(part))) and (part["_x0"] == part["close"].iloc[0]).all()


def test_blocks_that_do_not_suit_are_refused(several):
    with pytest.raises(ValueError, match="do not suit"):
        I.add_all_indicators(several, block_rows=100)
    with pytest.raises(ValueError, match="do not suit"):
        I.add_all_indicators(several, block_rows=5000)
    with pytest.raises(ValueError, match="does not fit"):
        blocks.deal(several, 10, 51)


@pytest.fixture(scope="module")
def folded(several):
    s = S.generate_signals(several).select("symbol", "ts", "close", "signal", "rsi", "ma_20", "ma_50").cache()
    return s, B.run_backtest(s).cache()


def test_curve_needs_no_join_and_one_exchange(spark, folded):
    s, ledger = folded
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p, q = plan(B.equity_curve(s, ledger)), plan(B.summary(s, ledger))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for text in (p, q):
        body = text.split("InMemoryTableScan")[0]  # above the cached inputs
        assert "Join" not in body and "hashpartitioning(symbol#" in body and "hashpartitioning(symbol#" + "ts#" not in body
        assert body.count("Exchange hashpartitioning") == 1


def test_merged_blocks_are_the_whole_curve(folded):
    s, ledger = folded
    want = {r["symbol"]: (r["volatility"], r["max_drawdown"]) for r in B.curve_metrics(B.equity_curve(s, ledger)).collect()}
    for days in (7, 64, 100_000):
        got = {r["symbol"]: (r["volatility"], r["max_drawdown"]) for r in B.merge_blocks(B.curve_blocks(s, ledger, days=days)).collect()}
        assert got.keys() == want.keys()
        for symbol, pair in want.items():
            assert np.allclose(got[symbol], pair, rtol=0, atol=1e-12), (symbol, days)
    assert any(v[1] < 0 for v in want.values())


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.select(*B.TRADE_COLUMNS, "seq", "cash_after", "position_after", "final").collect())))


def test_ledger_in_parts_is_the_whole_ledger(folded):
    s, ledger = folded
    want = rows(ledger)
    for cuts in ([dt.date(1981, 6, 1)], [dt.date(1980, 1, 2), dt.date(1982, 3, 1), dt.date(1982, 3, 2), dt.date(1990, 1, 1)]):
        state, done = None, None
        for upto in [*cuts, dt.date(2100, 1, 1)]:
            now = B.continue_backtest(s.where(F.col("ts") <= F.lit(upto)), state).cache()
            so_far = B.new_trades(now) if done is None else B.append_ledger(done, now)
            # what the next part appends to: the trades so far and the newest state
            done = (so_far.withColumn("entry_price", F.lit(None).cast("double")).unionByName(now.filter(F.col("action").isNull()))).cache()
            state = B.saved_state(now)
        assert rows(so_far) == want


def test_state_of_symbols_without_new_bars_is_kept(folded):
    s, _ = folded
    early = B.continue_backtest(s).cache()
    again = B.continue_backtest(s.where("symbol = 'A'"), B.saved_state(early)).cache()
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(B.saved_state(again)) == key(B.saved_state(early))
    assert B.new_trades(again).count() == 0
    assert rows(B.append_ledger(early, again)) == rows(B.new_trades(early))


def test_empty_results_need_no_backtest(spark, small_dir):
    p = plan(REGISTRY["bt_empty"].build(spark, small_dir))
    assert "MapInPandas" not in p and "LeftAnti" in p


def test_no_bars(spark):
    none = spark.createDataFrame([], BAR_SCHEMA)
    assert S.generate_signals(none, block_rows=512).count() == 0
    signals = S.generate_signals(none)
    assert B.merge_blocks(B.curve_blocks(signals, B.run_backtest(signals))).count() == 0
    assert B.continue_backtest(signals).count() == 0
