"""Structured Streaming versions of the bar and signal operators.

* ``stream_bars``: ticks -> watermark -> tumbling event-time windows -> OHLCV,
  append mode (a bar is emitted once its window closes);
* ``stream_sliding_volume``: sliding event-time windows of volume / ticks;
* ``current_signals_sink``: ``foreachBatch`` that carries each symbol's newest
  bars from batch to batch and derives the current signals from them.

``run_available_now`` drives a query with ``trigger(availableNow=True)``
into parquet under the shared checkpoint folder and returns the result as a
batch DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT, IndicatorParams
from ..operators import signals as S
from ..operators.cleaning import tick_order
from ..session import scratch_path
from ..sources.versioned import VersionedTable

TICK_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])


_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def wallclock_to_instant(c: str) -> F.Column:
    """TIMESTAMP_NTZ -> TIMESTAMP with the same wall clock in UTC (zone-independent).

    Watermarks need TIMESTAMP; epoch-aligned windows on this instant equal
    wall-clock bins whatever the session time zone is.
    """
    return F.expr(f"timestamp_micros(timestampdiff(MICROSECOND, {_EPOCH}, {c}))")


def instant_to_wallclock(c: str) -> F.Column:
    return F.expr(f"timestampadd(MICROSECOND, unix_micros({c}), {_EPOCH})")


def read_tick_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Event files as a tick stream: symbol, ts, price, volume."""
    r = spark.readStream.schema(TICK_SCHEMA).format("parquet")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return event_ticks(r.load(path))


def event_ticks(ev: DataFrame) -> DataFrame:
    return ev.select(
        F.col("event_type").alias("symbol"), wallclock_to_instant("ts").alias("ts"),
        F.col("value").alias("price"), F.lit(1.0).alias("volume"), F.col("event_id").alias("seq")
    )


def stream_bars(ticks: DataFrame, width: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Tumbling OHLCV bars; late ticks (older than the watermark) are dropped."""
    order = tick_order(ticks, "seq")
    w = ticks.withColumn("_o", order).withWatermark("ts", delay).groupBy("symbol", F.window("ts", width).alias("win"))
    agg = w.agg(
        F.min_by("price", "_o").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "_o").alias("close"),
        F.sum("volume").alias("volume"),
    )
    return agg.select("symbol", instant_to_wallclock("win.start").alias("ts"), "open", "high", "low", "close", "volume")


def stream_sliding_volume(
    ticks: DataFrame, length: str = "1 hour", slide: str = "15 minutes", delay: str = "10 minutes"
) -> DataFrame:
    w = ticks.withWatermark("ts", delay).groupBy("symbol", F.window("ts", length, slide).alias("win"))
    agg = w.agg(F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("ticks"), F.avg("price").alias("avg_price"))
    return agg.select("symbol", instant_to_wallclock("win.start").alias("start"), instant_to_wallclock("win.end").alias("end"),
                      "volume", "ticks", "avg_price")


def run_available_now(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process everything available, write parquet, return it as a batch DataFrame."""
    spark = df.sparkSession
    out = scratch_path(spark, f"{name}-out")
    ckpt = scratch_path(spark, f"{name}-ckpt")
    q = (
        df.writeStream.format("parquet").outputMode(mode)
        .option("path", out).option("checkpointLocation", ckpt)
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return spark.read.schema(df.schema).parquet(out)


def run_in_waves(waves: list[DataFrame], transform: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Files arrive wave by wave; after each the stream runs on from its checkpoint until nothing is left.

    Every wave is one distributed write of its rows, in as many files as it has
    partitions, so all of them reach the stream before the next wave's.  The query
    stops and starts again between waves: its state comes back from the checkpoint.
    """
    spark = waves[0].sparkSession
    source, out, ckpt = (scratch_path(spark, f"{name}-{part}") for part in ("src", "out", "ckpt"))
    schema = None
    for wave in waves:
        wave.write.mode("append").parquet(source)
        result = transform(spark.readStream.schema(wave.schema).parquet(source))
        schema = result.schema
        q = (result.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", ckpt)
             .trigger(availableNow=True).start())
        q.awaitTermination()
        if q.exception() is not None:
            raise RuntimeError(str(q.exception()))
    return spark.read.schema(schema).parquet(out)


def in_waves(rows: DataFrame, at: Column, count: int, jitter: int, seed: Column) -> list[DataFrame]:
    """``rows`` cut into ``count`` waves by ``at`` (whole numbers) plus 0 to ``jitter`` by a hash of ``seed``: neighbours arrive out of order.

    A row arrives at most ``jitter`` after rows that are later than it.
    """
    low, high = rows.agg(F.min(at), F.max(at)).first()
    if low is None:
        return [rows]
    late = at - low + F.pmod(F.xxhash64(seed), F.lit(jitter + 1))
    wave = F.floor(late * count / (high - low + jitter + 1))
    return [rows.where(wave == k) for k in range(count)]


def newest_bars(bars: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` newest bars of each symbol."""
    newest = Window.partitionBy("symbol").orderBy(F.col("ts").desc())
    return bars.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= keep).drop("_rn")


def current_signals_sink(tail_path: str, signals_path: str, ind: IndicatorParams = DEFAULT.indicators):
    """``foreachBatch`` function: carries each symbol's newest bars on, rebuilds current signals from them.

    A current signal looks back over its longest window and one bar more (the
    cross), so that many bars are kept and a batch costs its own rows and a few
    per symbol, however long the history.  The newest bars of a union are those
    of its parts' newest, so the order of arrival does not matter.  Each epoch
    reads the epoch before and writes folders of its own: a replayed epoch gives
    the same result, and readers never see a half-written table.  Only the last two epochs
    are kept: an epoch that comes again needs the one before it.
    """
    keep = max(ind.ma_long, ind.ma_short, ind.rsi_period + 1, ind.volume_period) + 1

    def handle(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if epoch_id > 0:
            rows = spark.read.schema(batch.schema).parquet(f"{tail_path}/epoch={epoch_id - 1}").unionByName(batch)
        newest_bars(rows, keep).write.mode("overwrite").parquet(f"{tail_path}/epoch={epoch_id}")
        tail = spark.read.schema(batch.schema).parquet(f"{tail_path}/epoch={epoch_id}")
        S.current_signals(S.generate_signals(tail, ind)).write.mode("overwrite").parquet(f"{signals_path}/epoch={epoch_id}")
        for path in (tail_path, signals_path):
            _delete(spark, f"{path}/epoch={epoch_id - 2}")

    return handle


def _delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there, through the file system that Spark uses for it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def run_current_signals(bar_stream: DataFrame, name: str = "current-signals") -> DataFrame:
    """Current signals after everything available; no rows if no batch came."""
    spark = bar_stream.sparkSession
    tail_path = scratch_path(spark, f"{name}-bars")
    signals_path = scratch_path(spark, f"{name}-table")
    ckpt = scratch_path(spark, f"{name}-ckpt")
    done: list[int] = []
    sink = current_signals_sink(tail_path, signals_path)

    def handle(batch: DataFrame, epoch_id: int) -> None:
        sink(batch, epoch_id)
        done[:] = [epoch_id]

    q = (
        bar_stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    if not done:
        return S.current_signals(S.generate_signals(spark.createDataFrame([], bar_stream.schema)))
    return spark.read.parquet(f"{signals_path}/epoch={done[0]}")


# ---------------------------------------------------------------- bars that late ticks correct


_PARTS = ["symbol", "ts", "open", "high", "low", "close", "volume", "first_tick", "last_tick"]


def partial_bars(ticks: DataFrame, width: str) -> DataFrame:
    """Bars of the ticks at hand, with the places (time, number) of their first and last tick, so that two parts of a bar merge."""
    place = F.struct("ts", "seq")
    parts = ticks.groupBy("symbol", F.window("ts", width).start.alias("start")).agg(
        F.min_by("price", place).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", place).alias("close"),
        F.sum("volume").alias("volume"), F.min(place).alias("first_tick"), F.max(place).alias("last_tick"))
    return parts.withColumn("ts", instant_to_wallclock("start")).select(*_PARTS)


def merge_bars(old: DataFrame, new: DataFrame) -> DataFrame:
    """Parts of the same bar as one: any grouping and order of parts gives the bar of all their ticks."""
    return old.select(*_PARTS).unionByName(new.select(*_PARTS)).groupBy("symbol", "ts").agg(
        F.min_by("open", "first_tick").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "last_tick").alias("close"), F.sum("volume").alias("volume"),
        F.min("first_tick").alias("first_tick"), F.max("last_tick").alias("last_tick")).select(*_PARTS)


def bar_table(spark: SparkSession, path: str) -> VersionedTable:
    """A table of bars in buckets of one day: a batch rewrites only the days that its ticks touch."""
    return VersionedTable(spark, path, ["symbol", "ts"], "date_format(ts, 'yyyy-MM-dd')")


def corrected_bars_sink(table: VersionedTable, width: str = "5 minutes", stream: str = "ticks"):
    """``foreachBatch`` function: merges each batch's partial bars into ``table``; an epoch that comes again changes nothing."""
    def handle(batch: DataFrame, epoch_id: int) -> None:
        if table.marks().get(stream, -1) >= epoch_id:
            return
        table.merge(partial_bars(batch, width), merge_bars, {stream: epoch_id})

    return handle


def run_corrected_bars(waves: list[DataFrame], to_ticks: Callable[[DataFrame], DataFrame], width: str = "5 minutes", delay: str = "2 hours",
                       name: str = "corrected-bars") -> DataFrame:
    """Tick files arrive in waves; bars after the last one.

    A tick number that comes again within ``delay`` of the newest tick counts once
    (``dropDuplicatesWithinWatermark``); ticks older than that are dropped; all others reach
    their bar however late they are, as a new version of the days they fall into.
    """
    spark = waves[0].sparkSession
    source, ckpt = scratch_path(spark, f"{name}-src"), scratch_path(spark, f"{name}-ckpt")
    table = bar_table(spark, scratch_path(spark, f"{name}-table"))
    sink = corrected_bars_sink(table, width)
    for wave in waves:
        wave.write.mode("append").parquet(source)
        ticks = to_ticks(spark.readStream.schema(wave.schema).parquet(source))
        q = (ticks.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["seq"]).writeStream.foreachBatch(sink)
             .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
        q.awaitTermination()
        if q.exception() is not None:
            raise RuntimeError(str(q.exception()))
    if not table.versions():
        return partial_bars(to_ticks(waves[0]), width).drop("first_tick", "last_tick")
    return table.read().drop("first_tick", "last_tick")
