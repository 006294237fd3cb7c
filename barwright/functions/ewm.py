"""Bias-adjusted exponential moving average with window functions only.

Definition (the ``adjust=True`` form): with ``q = 1 - 2/(span+1)``

    ema_t = sum_{i=0..t} q^i x_{t-i} / sum_{i=0..t} q^i

The denominator has a closed form, ``(1 - q^(t+1)) / (1 - q)``.  The numerator
is a weighted running sum; computing it as ``q^t * sum x_k q^-k`` overflows
after a few thousand rows, so rows are cut into chunks:

1. inside a chunk (window partition ``(symbol, chunk)``) a running sum of
   ``x_k q^-j_k`` scaled by ``q^j`` gives the chunk-local numerator;
2. the numerator at the end of the previous chunk is carried by
   ``last(..., ignorenulls)`` over the rows before the current one;
3. ``N_t = local_t + q^(j+1) * carry``.

A chunk has as many rows as its span needs for older chunks to weigh less than
1e-17 (``chunk_rows``: 509 for span 26, 3,914 for span 200), so dropping them is
exact for any span; inside it ``q^-j`` stays below 1e17 for the longest span.
Span 1 is the value itself.  Everything is a running-frame window: O(n),
JVM-side, no Python, on the existing ``hash(symbol)`` layout.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import SYMBOL, TS, before, by_symbol

_PREFIX = "_ewm_"
_RN = _PREFIX + "rn"
_NEGLIGIBLE = 17 * math.log(10)
_LARGEST = 600.0  # q^-j stays below e^600 for the shortest span that shares a chunk


def decay(span: int) -> float:
    if span < 1:
        raise ValueError(f"an EMA span is at least 1, not {span}")
    return 1.0 - 2.0 / (span + 1.0)


def chunk_rows(spans: list[int]) -> int | None:
    """Rows of a chunk that is exact for all ``spans``, or None if no one length is."""
    rates = [-math.log(decay(s)) for s in spans if s > 1]
    if not rates:
        return 1
    rows = math.ceil(_NEGLIGIBLE / min(rates))
    return rows if rows * max(rates) <= _LARGEST else None


def with_row_index(df: DataFrame, chunk: int) -> DataFrame:
    if _RN not in df.columns:
        df = df.withColumn(_RN, F.row_number().over(by_symbol(TS)) - 1)
    names = f"{_PREFIX}chunk_{chunk}", f"{_PREFIX}j_{chunk}"
    if names[0] not in df.columns:
        df = df.withColumn(names[0], F.floor(F.col(_RN) / chunk).cast("long")).withColumn(names[1], (F.col(_RN) % chunk).cast("int"))
    return df


def drop_row_index(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(_PREFIX)])


def adjusted_ema(df: DataFrame, specs: dict[str, tuple[str, int]], chunk: int | None = None) -> DataFrame:
    """Add columns ``name = EMA(source, span)`` for each ``name: (source, span)``.

    Sources must be non-null.  Rows are ordered by ``ts`` within ``symbol``.
    ``chunk`` lets several calls share one chunk length (from ``chunk_rows``).
    """
    for name, (src, span) in specs.items():
        if decay(span) == 0.0:
            df = df.withColumn(name, F.col(src).cast("double"))
    specs = {name: spec for name, spec in specs.items() if spec[1] > 1}
    if not specs:
        return df
    chunk = chunk or chunk_rows([span for _, span in specs.values()])
    if chunk is None:
        for name, spec in specs.items():
            df = adjusted_ema(df, {name: spec})
        return df
    df = with_row_index(df, chunk)
    j = F.col(f"{_PREFIX}j_{chunk}")
    in_chunk = (Window.partitionBy(SYMBOL, f"{_PREFIX}chunk_{chunk}").orderBy(f"{_PREFIX}j_{chunk}")
                .rowsBetween(Window.unboundedPreceding, 0))
    locals_ = []
    for name, (src, span) in specs.items():
        q = decay(span)
        local = F.sum(F.col(src) * F.pow(F.lit(q), -j)).over(in_chunk) * F.pow(F.lit(q), j)
        locals_.append(local.alias(f"_loc_{name}"))
    df = df.select("*", *locals_)
    outs = []
    for name, (_, span) in specs.items():
        q = decay(span)
        loc = F.col(f"_loc_{name}")
        carry = F.last(F.when(j == chunk - 1, loc), ignorenulls=True).over(before(TS))
        num = loc + F.coalesce(carry * F.pow(F.lit(q), j + 1), F.lit(0.0))
        den = (1.0 - F.pow(F.lit(q), F.col(_RN) + 1)) / (1.0 - q)
        outs.append((num / den).alias(name))
    df = df.select("*", *outs)
    return df.drop(*[f"_loc_{n}" for n in specs])
