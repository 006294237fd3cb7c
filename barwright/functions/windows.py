"""Window specs and exact-arithmetic column helpers.

Every per-symbol operator shares one layout: hash partitioned by ``symbol``,
sorted by ``ts``.  Spark puts all window expressions with the same spec in one
``Window`` node, so the whole indicator chain costs one exchange and one sort
(plus the EMA passes, see ``ewm``).

Prices have two decimals; sums over windows run on BIGINT cents so that the
result does not depend on summation order and decisions (``rsi < 30``,
``ma_20 > ma_50``) are made on exact integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..config import PRICE_SCALE

SYMBOL = "symbol"
TS = "ts"


def by_symbol(order: str = TS) -> WindowSpec:
    return Window.partitionBy(SYMBOL).orderBy(order)


def trailing(n: int, order: str = TS) -> WindowSpec:
    """The last ``n`` rows up to the current one (partial at the start)."""
    return by_symbol(order).rowsBetween(-(n - 1), Window.currentRow)


def expanding(order: str = TS) -> WindowSpec:
    return by_symbol(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before(order: str = TS) -> WindowSpec:
    """All rows strictly before the current one."""
    return by_symbol(order).rowsBetween(Window.unboundedPreceding, -1)


def add_trailing_sums(df: DataFrame, specs: dict[str, tuple[Column, int]], bounded: tuple[str, ...] = ()) -> DataFrame:
    """Add ``name = sum of expr over the last n rows`` for each ``name: (expr, n)``.

    Computed as ``running_sum(t) - running_sum(t - n)``: both are O(1) per row
    (a running frame and an offset), where a bounded ROWS frame re-aggregates
    all ``n`` rows for every row.  Exact for integer expressions (cents).

    ``bounded`` names use the ROWS frame all the same: squares, whose running
    sum overflows on long histories, and doubles, whose running sum cancels.
    """
    run = expanding()
    w = by_symbol()
    running = {k: v for k, v in specs.items() if k not in bounded}
    df = df.select("*", *[F.sum(e).over(run).alias(f"_cum_{k}") for k, (e, _) in running.items()],
                   *[F.sum(specs[k][0]).over(trailing(specs[k][1])).alias(k) for k in bounded])
    outs = [
        (F.col(f"_cum_{k}") - F.coalesce(F.lag(f"_cum_{k}", n).over(w), F.lit(0))).alias(k)
        for k, (_, n) in running.items()
    ]
    return df.select("*", *outs).drop(*[f"_cum_{k}" for k in running])


def cents(c: Column | str) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col * PRICE_SCALE).cast("long")


def ddiv(num: Column, den: Column) -> Column:
    """Double division that yields NULL for a zero denominator."""
    return F.try_divide(num.cast("double"), den.cast("double"))
