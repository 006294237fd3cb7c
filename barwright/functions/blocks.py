"""A layout for symbols of any length: blocks of rows instead of whole symbols.

``Window.partitionBy("symbol")`` puts all bars of a symbol in one task.  Here a
symbol's rows are numbered without such a window, cut into blocks of ``block_rows``
rows, and each block also gets the last ``halo`` rows of the block before it.  Then
any trailing window of at most ``halo`` rows, and a lag on it, is right on every
row that is not halo, while windows run per (symbol, block):

1. rows fall into time buckets; a table of one row a (symbol, bucket) with its
   count gives each bucket's first row number by a running sum over buckets;
2. a row's number is that plus its place in the bucket;
3. blocks follow from row numbers; the rows near a block's end are copied into the next.

``symbol`` becomes the struct ``(symbol, block)`` meanwhile, so operators that
window by ``symbol`` run unchanged; ``undeal`` drops the halo and gives the symbol back.

The adjusted EMA reaches back further than any halo.  Its numerator is a sum
over the block plus the numerator at the end of the block before, scaled: a table of one
row a block holds these carries (``carried_ema``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ewm import _LARGEST, _RN, chunk_rows, decay
from .materialize import materialize
from .windows import SYMBOL, TS

BLOCK, HALO, FIRST = "_blk", "_halo", "_x0"
BLOCK_ROWS = 2048  # between what the EMA spans need for older blocks to vanish and what keeps their weights finite


def instant(ts: Column, kind: T.DataType) -> Column:
    """A bar time as a whole number that grows with it: days or microseconds."""
    if isinstance(kind, T.DateType):
        return F.unix_date(ts).cast("long")
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {TS})")
    return F.unix_micros(ts)


def bucket_width(df: DataFrame, rows: int) -> int:
    """Time that holds about ``rows`` rows of the densest symbol; one small aggregate."""
    at = instant(F.col(TS), df.schema[TS].dataType)
    per_symbol = df.groupBy(SYMBOL).agg(F.count(F.lit(1)).alias("n"), (F.max(at) - F.min(at) + 1).alias("span"))
    densest = per_symbol.agg(F.min(F.col("span") / F.col("n")).alias("step")).first()["step"]
    return max(1, math.ceil((densest or 1) * rows))


def with_row_numbers(df: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """Add the row number from 0 in each symbol by time, and the symbol's first close, with no window over a whole symbol's rows."""
    width = bucket_width(df, rows)
    bucket = F.floor(instant(F.col(TS), df.schema[TS].dataType) / width).cast("long")
    dealt = df.withColumn("_bucket", bucket)
    counts = dealt.groupBy(SYMBOL, "_bucket").agg(F.count(F.lit(1)).alias("_n"), F.min_by("close", TS).alias("_first"))
    by_bucket = Window.partitionBy(SYMBOL).orderBy("_bucket")
    offsets = counts.select(
        SYMBOL, "_bucket",
        F.coalesce(F.sum("_n").over(by_bucket.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"),
        F.first("_first").over(by_bucket).alias(FIRST))
    place = F.row_number().over(Window.partitionBy(SYMBOL, "_bucket").orderBy(TS))
    return (dealt.withColumn("_place", place).join(offsets, [SYMBOL, "_bucket"])
            .withColumn(_RN, F.col("_offset") + F.col("_place") - 1).drop("_bucket", "_place", "_offset"))


def deal(df: DataFrame, block_rows: int, halo: int) -> DataFrame:
    """Rows by (symbol, block), with halo copies; written once, as several passes read them."""
    if not 0 < halo <= block_rows:
        raise ValueError(f"a halo of {halo} rows does not fit into a block of {block_rows}")
    block = F.floor(F.col(_RN) / block_rows).cast("long")
    near_end = F.col(_RN) % block_rows >= block_rows - halo
    copies = with_row_numbers(df, block_rows).withColumn(
        BLOCK, F.explode(F.when(near_end, F.array(block, block + 1)).otherwise(F.array(block))))
    return materialize(copies.withColumn(HALO, F.floor(F.col(_RN) / block_rows) != F.col(BLOCK))
                       .withColumn(SYMBOL, F.struct(F.col(SYMBOL).alias("name"), F.col(BLOCK).alias("block"))))


def undeal(df: DataFrame) -> DataFrame:
    return df.filter(~F.col(HALO)).withColumn(SYMBOL, F.col(f"{SYMBOL}.name")).drop(BLOCK, HALO, FIRST)


def check_spans(spans: list[int], block_rows: int) -> None:
    least = chunk_rows(spans)
    rates = [-math.log(decay(s)) for s in spans if s > 1]
    if least is None or block_rows < least or block_rows * max(rates, default=0.0) > _LARGEST:
        raise ValueError(f"blocks of {block_rows} rows do not suit EMAs of spans {spans}: at least {least} rows, and weights must stay finite")


def carried_ema(rows: DataFrame, thin: DataFrame, specs: dict[str, tuple[str, int]], block_rows: int) -> DataFrame:
    """Add ``name = adjusted EMA(source, span)`` to rows dealt in blocks; ``thin`` is any frame with the same keys, flags and sources.

    A block's local numerator is a running sum inside it.  The carry is the
    local numerator at the end of the block before: what is older weighs less
    than 1e-17 (``check_spans``).  The table of carries has one row a block.
    """
    check_spans([span for _, span in specs.values()], block_rows)
    j = (F.col(_RN) - F.col(BLOCK) * block_rows).cast("int")
    ends = thin.filter(~F.col(HALO)).groupBy(SYMBOL).agg(
        *[F.sum(F.col(src) * F.pow(F.lit(decay(span)), block_rows - 1 - j)).alias(f"_end_{name}") for name, (src, span) in specs.items()])
    before = Window.partitionBy(f"{SYMBOL}.name").orderBy(f"{SYMBOL}.block")
    carries = ends.select(SYMBOL, *[F.lag(f"_end_{name}").over(before).alias(f"_carry_{name}") for name in specs])
    running = Window.partitionBy(SYMBOL).orderBy(TS).rowsBetween(Window.unboundedPreceding, 0)
    local = [(F.sum(F.when(F.col(HALO), 0.0).otherwise(F.col(src) * F.pow(F.lit(decay(span)), -j))).over(running) * F.pow(F.lit(decay(span)), j)).alias(f"_loc_{name}")
             for name, (src, span) in specs.items()]
    out = rows.select("*", *local).join(carries, SYMBOL, "left")
    values = []
    for name, (_, span) in specs.items():
        q = decay(span)
        numerator = F.col(f"_loc_{name}") + F.coalesce(F.col(f"_carry_{name}") * F.pow(F.lit(q), j + 1), F.lit(0.0))
        values.append((numerator * (1.0 - q) / (1.0 - F.pow(F.lit(q), F.col(_RN) + 1))).alias(name))
    return out.select("*", *values).drop(*[f"_{k}_{name}" for name in specs for k in ("loc", "carry")])
