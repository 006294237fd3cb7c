"""Long histories and edges: EMA for every span, overflow, linear fills, the checkpoint folder."""

import time
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barwright import session
from barwright.operators import cleaning, indicators


def prices(spark, n, close):
    """One symbol; ``close`` is an expression over the row number ``id``."""
    c = F.expr(close)
    return spark.range(n).select(
        F.lit("S").alias("symbol"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), c.alias("open"), c.alias("high"), c.alias("low"),
        c.alias("close"), (F.lit(1000.5) + F.col("id") % 7).alias("volume"))


@pytest.mark.parametrize("span", [1, 2, 26, 100, 200])
def test_ema_of_every_span(spark, span):
    two = prices(spark, 6000, "100 + 30 * sin(id / 40) + (id * 7919) % 101 / 10").unionByName(
        prices(spark, 3500, "50 + (id * 104729) % 97 / 10").withColumn("symbol", F.lit("T")))
    got = indicators.ema(two, span, "e").toPandas().sort_values(["symbol", "ts"])
    for _, g in got.groupby("symbol"):
        assert np.allclose(g["e"], g["close"].ewm(span=span, adjust=True).mean(), rtol=0, atol=1e-9)


def test_macd_with_spans_that_share_no_chunk(spark):
    bars = prices(spark, 5000, "100 + (id * 7919) % 1013 / 10")
    g = indicators.macd(bars, 2, 400, 3).toPandas().sort_values("ts")
    line = g["close"].ewm(span=2).mean() - g["close"].ewm(span=400).mean()
    assert np.allclose(g["macd"], line, atol=1e-8) and np.allclose(g["macd_signal"], line.ewm(span=3).mean(), atol=1e-8)


def test_no_span_below_one(spark):
    with pytest.raises(ValueError):
        indicators.ema(prices(spark, 3, "1.0 * id"), 0)


def test_bollinger_on_a_long_history_of_wide_moves(spark):
    bars = prices(spark, 200_000, "CASE WHEN id % 2 = 0 THEN 100.0D ELSE 100000.0D END")
    g = indicators.bollinger(bars).toPandas().sort_values("ts")
    roll = g["close"].rolling(20, min_periods=1)
    assert np.allclose(g["bb_upper"].iloc[1:], (roll.mean() + 2 * roll.std()).iloc[1:], rtol=1e-9)
    v = indicators.volume_sma(bars).toPandas().sort_values("ts")
    assert np.array_equal(v["volume_sma"], v["volume"].rolling(20, min_periods=1).mean().round(12)) or np.allclose(
        v["volume_sma"], v["volume"].rolling(20, min_periods=1).mean(), rtol=1e-13)


def test_fills_are_linear(spark):
    bars = prices(spark, 200_000, "CASE WHEN id < 500 OR id % 3 = 0 THEN NULL ELSE 1.0D * id END")
    began = time.perf_counter()
    g = cleaning.ffill_bfill(bars).toPandas().sort_values("ts")
    assert time.perf_counter() - began < 60
    raw = pd.Series([np.nan if i < 500 or i % 3 == 0 else float(i) for i in range(200_000)])
    assert np.array_equal(g["close"].to_numpy(), raw.ffill().bfill().to_numpy())


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    unset = SimpleNamespace(sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None), conf=SimpleNamespace(get=lambda *a: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(unset)
