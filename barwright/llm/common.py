"""Helpers that the text operators share: Arrow text buffers, word spans,
hashing of words and shingles in numpy, and stable written tables.

Every kernel here works on one Arrow batch (or a slice of it) at a time, so a
task holds one batch and the arrays derived from about ``CHUNK_BYTES`` of text
(or from one document, where that is longer).
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

CHUNK_BYTES = 1 << 20

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts the lineage, gives later plans real sizes to choose joins by, and
    survives lost executors, as the files are on the shared store.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def column_type(df: DataFrame, name: str):
    return df.schema[name].dataType


def row_key(id_: Column, text: Column) -> Column:
    """A key that rows share only if they agree in id and text (null counts as a value)."""
    return F.md5(F.concat_ws("\x00", F.coalesce(id_.cast("string"), F.lit("\x01")), F.coalesce(text, F.lit("\x01"))))


def text_arrays(column) -> tuple[np.ndarray, np.ndarray]:
    """(offsets int64 of n+1, bytes) of an Arrow string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset:column.offset + len(column) + 1]
    return offsets, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def slices(column, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, offsets from 0, bytes): whole texts, about ``most`` bytes together."""
    offsets, data = text_arrays(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, offsets[i:j + 1] - offsets[i], data[offsets[i]:offsets[j]]
        i = j


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 0x41) & (data <= 0x5A), data + 32, data).astype(np.uint8)


def spans(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``member`` bytes; no run crosses a text's end."""
    n = len(member)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:] = member[:-1]
    after[:-1] = member[1:]
    return (np.flatnonzero(member & (~before | edge[:-1])),
            np.flatnonzero(member & (~after | edge[1:])) + 1)


def owner(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row that each start lies in."""
    return np.searchsorted(offsets, starts, "right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (murmur3's constants)."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93)) | U64(1)


@functools.lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    def run(base):
        out = np.full(1 << bits, base, U64)
        out[0] = 1
        return np.cumprod(out, dtype=U64)
    return run(_BASE), run(_INVERSE)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each byte span, equal for equal spans anywhere."""
    if not len(starts):
        return np.zeros(0, U64)
    power, inverse = _powers(max(20, int(len(data) + 1).bit_length()))
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_VALUE[data] * power[:len(data)], dtype=U64, out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U64))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive word hashes (crossing texts; the caller masks)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    h = np.zeros(n, U64)
    for j in range(k):
        h = h * U64(0x100000001B3F) + words[j:j + n]
    return mix(h + U64(k))


def word_member() -> np.ndarray:
    """Byte table of word bytes ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing."""
    ok = np.zeros(256, bool)
    ok[0x30:0x3A] = ok[0x61:0x7B] = ok[0x80:] = True
    return ok


def not_space() -> np.ndarray:
    """Byte table of ``[^\\x20\\x09-\\x0D]``."""
    ok = np.ones(256, bool)
    ok[0x09:0x0E] = ok[0x20] = False
    return ok


def as_signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under fixed names, whatever else ``df`` carries."""
    return df.select(*[df[old].alias(new) for new, old in columns.items()])
