"""Streams over several batches: out of order, late, and without any input."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from barwright.operators import signals as S
from barwright.sources.bars import BAR_SCHEMA
from barwright.streaming import bars as SB
from barwright.streaming.state import streaming_macd

DAYS = 150


@pytest.fixture(scope="module")
def bars(spark):
    rng = np.random.default_rng(3)
    parts = []
    for k in range(12):
        close = (100 + np.cumsum(rng.integers(-200, 201, DAYS)) / 100 + 20).round(2)
        parts.append(pd.DataFrame({
            "symbol": f"S{k}", "ts": [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(DAYS)],
            "open": close, "high": close + 1, "low": close - 1, "close": close, "volume": 1.0 * rng.integers(1, 50, DAYS)}))
    return pd.concat(parts)


def write_batches(spark, bars, path, ranges):
    for lo, hi in ranges:
        part = bars[[lo <= (d - dt.date(2024, 1, 1)).days < hi for d in bars["ts"]]]
        spark.createDataFrame(part, BAR_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return spark.readStream.schema(BAR_SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def test_current_signals_equal_batch_whatever_the_order(spark, bars, tmp_path):
    want = {tuple(r) for r in S.current_signals(S.generate_signals(spark.createDataFrame(bars, BAR_SCHEMA))).collect()}
    assert want
    for name, ranges in (("onward", [(0, 60), (60, 149), (149, 150)]), ("mixed", [(120, 150), (0, 70), (70, 120)])):
        path = str(tmp_path / name)
        write_batches(spark, bars, path, ranges)
        assert {tuple(r) for r in SB.run_current_signals(stream(spark, path)).collect()} == want


def test_no_batch_gives_no_signals(spark, tmp_path):
    (tmp_path / "none").mkdir()
    got = SB.run_current_signals(stream(spark, str(tmp_path / "none")))
    assert got.count() == 0 and "signal" in got.columns


def test_late_bars_are_put_out_as_late(spark, bars, tmp_path):
    path = str(tmp_path / "late")
    write_batches(spark, bars, path, [(0, 50), (60, 150), (50, 60)])
    got = SB.run_available_now(streaming_macd(stream(spark, path)), "late").toPandas()
    assert len(got) == len(bars)
    late = got[got["late"]]
    assert len(late) == 12 * 10 and late["macd"].isna().all()
    assert not got[~got["late"]]["macd"].isna().any()


def test_state_carries_over_batches(spark, bars, tmp_path):
    from barwright.operators import indicators as I

    path = str(tmp_path / "state")
    write_batches(spark, bars, path, [(0, 50), (50, 51), (51, 150)])
    got = SB.run_available_now(streaming_macd(stream(spark, path)), "state").toPandas().sort_values(["symbol", "ts"])
    want = I.macd(spark.createDataFrame(bars, BAR_SCHEMA)).toPandas().sort_values(["symbol", "ts"])
    assert not got["late"].any()
    assert np.allclose(got["macd"], want["macd"], atol=1e-9) and np.allclose(got["macd_signal"], want["macd_signal"], atol=1e-9)
