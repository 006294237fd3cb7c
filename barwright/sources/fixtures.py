"""Market data derived from the driver's tables.

* daily bars: symbol = part brand, one bar per ship day; each lineitem row is a
  tick whose price is ``100 + extendedprice / quantity / 10000`` rounded to
  cents (``scaled``), or ``extendedprice / quantity`` rounded to cents (raw).
  Both are computed in exact integer cents.  Ticks within a day are ordered by
  the key below, packed into one decimal.
* ticks: symbol = event type, price = value, volume 1 per row.
* universe: watch lists derived from the brands (``MFGR_<first digit>``).

At scale the lineitem scan is the big input: only the seven needed columns
are read, the join to ``part`` is left to Spark's size-checked join selection
(broadcast only below ``spark.sql.autoBroadcastJoinThreshold``, else a
shuffled join), and the bar aggregation is keyed by ``(symbol, day)`` with
map-side partial aggregation, so one hot brand is split over all map tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Tick order key within a day, and the decimal digits that its key columns take when packed.
TICK_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
KEY_DIGITS = {"l_linenumber": 1, "l_partkey": 12, "l_suppkey": 10}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _tick_cents(scaled: bool) -> Column:
    ep_c = F.round(F.col("l_extendedprice") * 100).cast("long")
    qty = F.col("l_quantity").cast("long")
    if scaled:
        d = qty * 10000
        return F.lit(10000) + F.floor((ep_c * 2 + d) / (d * 2)).cast("long")
    return F.floor((ep_c * 2 + qty) / (qty * 2)).cast("long")


def tick_key() -> Column:
    """The key columns of a tick, most significant first, as one DECIMAL(38, 0).

    Hash aggregation can hold it, where a struct key makes every map task sort
    its ticks.  Order, line, part and supplier identify a lineitem; a row that
    repeats all four is the same tick again, with the same price.  A line number
    over 9 or a key too large for its digits raises an error under ANSI mode, it
    never changes the order.
    """
    key = F.coalesce("l_orderkey", F.lit(0)).cast("decimal(15,0)")
    for c, digits in KEY_DIGITS.items():
        shift = F.lit(10**digits).cast(f"decimal({digits + 1},0)")
        key = (key * shift + F.coalesce(c, F.lit(0)).cast(f"decimal({digits},0)")).cast("decimal(38,0)")
    return key


def lineitem_ticks(spark: SparkSession, sf_dir: str, scaled: bool = True, start=None, end=None) -> DataFrame:
    """One row per lineitem: symbol, ts (ship timestamp), price_c, qty, key.

    ``start`` / ``end`` (dates) bound the ship day; they are applied to the raw
    ``l_shipdate`` column so they reach the parquet scan as pushed filters.
    """
    li = table(spark, sf_dir, "lineitem").select(*TICK_KEY, "l_shipdate")
    if start is not None:
        li = li.filter(F.col("l_shipdate") >= F.lit(start).cast(li.schema["l_shipdate"].dataType))
    if end is not None:
        li = li.filter(F.col("l_shipdate") < F.lit(end).cast(li.schema["l_shipdate"].dataType))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    joined = li.join(part, li.l_partkey == part.p_partkey)
    return joined.select(
        F.col("p_brand").alias("symbol"),
        F.col("l_shipdate").alias("ts"),
        _tick_cents(scaled).alias("price_c"),
        F.col("l_quantity").alias("qty"),
        tick_key().alias("key"),
    )


def daily_bars(spark: SparkSession, sf_dir: str, scaled: bool = True, start=None, end=None) -> DataFrame:
    """Daily OHLCV bars: symbol, ts (date), open, high, low, close, volume."""
    ticks = lineitem_ticks(spark, sf_dir, scaled, start, end)
    agg = ticks.groupBy("symbol", F.to_date("ts").alias("ts")).agg(
        F.min_by("price_c", "key").alias("o"),
        F.max("price_c").alias("h"),
        F.min("price_c").alias("l"),
        F.max_by("price_c", "key").alias("c"),
        F.sum("qty").alias("volume"),
    )
    return agg.select(
        "symbol",
        "ts",
        (F.col("o") / 100.0).alias("open"),
        (F.col("h") / 100.0).alias("high"),
        (F.col("l") / 100.0).alias("low"),
        (F.col("c") / 100.0).alias("close"),
        F.col("volume").cast("double").alias("volume"),
    )


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intraday ticks: symbol, ts (timestamp), price, volume (1 per tick), seq."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    return ev.select(
        F.col("event_type").alias("symbol"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),  # wall-clock time: bins do not move with the session zone
        F.col("value").alias("price"),
        F.lit(1.0).alias("volume"),
        F.col("event_id").alias("seq"),
    )


def watch_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, position): the brands of list MFGR_1, in order of their first part, then the tick
    symbols, which have no daily bars."""
    brands = (table(spark, sf_dir, "part").where(F.col("p_brand").startswith("Brand#1"))
              .groupBy(F.col("p_brand").alias("symbol")).agg(F.min("p_partkey").cast("long").alias("position")))
    quoted = (table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("symbol"))
              .agg((F.min("event_id") + F.lit(1 << 40)).cast("long").alias("position")))
    return brands.unionByName(quoted)


def derived_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watch lists (name, symbol) derived from the part brands."""
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("symbol")).distinct()
    digit = F.regexp_extract("symbol", r"#(\d)", 1)
    return part.select(F.concat(F.lit("MFGR_"), digit).alias("name"), "symbol")
