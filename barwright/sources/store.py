"""Stored bars: Parquet by period of time, bucketed by symbol.

A scan of some days reads only their periods; two bar tables of the same bucket
count join on the symbol without an exchange; the newest price of symbols reads the newest
periods first and older ones only for symbols that have not been found.

The table's metadata is a catalog entry of the session (or metastore); a store
that another session wrote is opened from its path.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.materialize import materialize
from ..functions.windows import SYMBOL, TS
from .bars import latest_price

PERIOD = "period"


def year(ts: Column) -> Column:
    return F.date_format(ts, "yyyy")


class BarStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 8):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.name = "bars_" + hashlib.sha256(self.path.encode()).hexdigest()[:16]

    def write(self, bars: DataFrame, period=year) -> BarStore:
        """One file per period and bucket, sorted: a hot symbol is split by period.  Replaces what the store holds."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        dealt = bars.withColumn(PERIOD, period(F.col(TS))).repartition(F.col(PERIOD), F.pmod(F.hash(SYMBOL), F.lit(self.buckets)))
        (dealt.write.mode("overwrite").format("parquet").partitionBy(PERIOD).bucketBy(self.buckets, SYMBOL).sortBy(SYMBOL, TS)
         .option("path", self.path).saveAsTable(self.name))
        return self

    def open(self, bars_schema) -> BarStore:
        """Declare a store that lies at the path already."""
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bars_schema.fields)
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        self.spark.sql(f"CREATE TABLE {self.name} ({columns}, {PERIOD} string) USING parquet PARTITIONED BY ({PERIOD}) "
                       f"CLUSTERED BY ({SYMBOL}) SORTED BY ({SYMBOL}, {TS}) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")
        self.spark.sql(f"MSCK REPAIR TABLE {self.name}")
        return self

    def periods(self) -> list[str]:
        """Newest first; names of partitions, from the catalog."""
        return sorted((r[0].split("=", 1)[1] for r in self.spark.sql(f"SHOW PARTITIONS {self.name}").collect()), reverse=True)

    def bars(self, periods: list[str] | None = None) -> DataFrame:
        table = self.spark.table(self.name)
        return (table if periods is None else table.where(F.col(PERIOD).isin(periods))).drop(PERIOD)

    def latest_price(self, symbols: DataFrame) -> tuple[DataFrame, list[list[str]]]:
        """(symbol, price, ts of its newest bar) of those of ``symbols`` that have bars, and the periods read in each step.

        Steps read 1, 2, 4, ... periods, newest first, for the symbols not found so far, and end when all are found:
        as many steps as the logarithm of the periods, however old a symbol's last bar is.
        """
        wanted = materialize(symbols.select(SYMBOL).distinct())
        left, steps, found, take = self.periods(), [], [], 1
        while left and not wanted.isEmpty():
            now, left = left[:take], left[take:]
            steps.append(now)
            part = materialize(latest_price(self.bars(now).join(wanted, SYMBOL, "left_semi")))
            found.append(part)
            wanted = materialize(wanted.join(part, SYMBOL, "left_anti"))
            take *= 2
        if not found:
            return latest_price(self.bars().where("false")), steps
        out = found[0]
        for part in found[1:]:
            out = out.unionByName(part)
        return out, steps
