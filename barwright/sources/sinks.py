"""Report tables (trading log, performance, current signals, ML predictions).

Each is a DataFrame with a fixed column list.  ``publish`` replaces the report
table as a whole - the equivalent of clearing a sheet and writing it again - as a
new version beside the old one, so that readers see one or the other; ``republish``
replaces only the rows of the symbols at hand.  ``write_table`` writes plain files.
Timestamps come from an explicit ``as_of`` parameter, never the clock.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .versioned import VersionedTable, hash_bucket

TRADING_LOG_COLUMNS = [
    "date", "symbol", "action", "quantity", "price", "value", "commission", "signal_strength",
    "entry_reason", "rsi", "ma_20", "ma_50", "pnl", "mode", "updated",
]
PERFORMANCE_COLUMNS = [
    "symbol", "start_date", "end_date", "initial_capital", "final_value", "total_return",
    "total_trades", "win_rate", "max_drawdown", "sharpe_ratio",
]
SIGNALS_COLUMNS = ["symbol", "signal", "price", "rsi", "ma_20", "ma_50", "date", "updated"]
ML_COLUMNS = ["symbol", "model_accuracy", "latest_prediction", "confidence", "date", "updated"]


def trading_log(ledger: DataFrame, as_of: dt.date) -> DataFrame:
    """All symbols' trades, upper-case actions, run mode and update stamp."""
    return ledger.select(
        "date", "symbol", F.upper("action").alias("action"), "quantity", "price", "value", "commission",
        "signal_strength", "entry_reason", "rsi", "ma_20", "ma_50", "pnl",
        F.lit("BACKTEST").alias("mode"), F.lit(as_of).alias("updated"),
    )


def performance(summary: DataFrame) -> DataFrame:
    return summary.select(*PERFORMANCE_COLUMNS)


def signals_table(current: DataFrame, as_of: dt.date) -> DataFrame:
    return current.select(
        "symbol", F.upper("signal").alias("signal"), "price", "rsi", "ma_20", "ma_50", "date",
        F.lit(as_of).alias("updated"),
    )


def ml_table(predictions: DataFrame, as_of: dt.date) -> DataFrame:
    """``predictions``: symbol, accuracy, latest_prediction, confidence."""
    return predictions.select(
        "symbol", F.col("accuracy").alias("model_accuracy"), "latest_prediction", "confidence",
        F.lit(as_of).alias("date"), F.lit(as_of).alias("updated"),
    )


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, fmt: str = "parquet") -> None:
    w = df.write.mode("overwrite").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", True)
    w.save(path)


def report_table(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, ["symbol"], hash_bucket("symbol"))


def publish(df: DataFrame, path: str) -> DataFrame:
    """Replace the report at ``path`` by ``df``; the report as readers see it."""
    table = report_table(df.sparkSession, path)
    table.replace(df)
    return table.read()


def republish(df: DataFrame, path: str) -> DataFrame:
    """Replace the rows of ``df``'s symbols in the report at ``path``; other symbols keep theirs."""
    table = report_table(df.sparkSession, path)
    table.upsert(df)
    return table.read()
