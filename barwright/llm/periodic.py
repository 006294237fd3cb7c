"""Periodic runs of words inside one document, by seeds on diagonals.

A run of period q is a stretch of words, equal at distance q, of at least
``max(least, times * q)`` words that cannot be made longer.  Two copies of it
that lie q words apart overlap in at least ``overlap(q)`` words, so lags are
taken in classes ``lo < q <= hi`` with one k-gram length each: the least overlap
of the class, which is at least ``hi``.  In a class

1. every k-gram of a document is indexed (one sort of gram hashes);
2. a gram and its next occurrence in the document, d words on, are a seed on
   the diagonal d, if d is in the class.  As k is at least q, the next
   occurrence of a gram of a run is exactly q on (a nearer one would give the
   run a shorter period), so neighbours in the index are enough: at most one
   seed a word, where all pairs would be quadratic in a repetitive text;
3. a seed is extended both ways to the whole stretch, unless the table of the
   furthest word covered on its diagonal shows that it lies in one.

The smallest period of a stretch so found is its lag, so no run appears twice.
Words are numbered exactly; gram hashes only choose seeds, which are compared
word by word.  Two different grams of one document that share all 64 bits could
hide a run (chance about n^2 / 2^65 for n words).

Scale: each document by itself in one pass over an Arrow batch, O(n) seeds and
O(n log n) work; no shuffle, no broadcast, no collect.

Defined cases: null and blank texts have no words and no runs; repeated rows
each give their row; null ids are kept; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

LEAST, TIMES = 6, 4
SPACE_RUN = r"[\x20\x09-\x0D]+"

_RUN = [("start", T.LongType(), pa.int64()), ("length", T.LongType(), pa.int64()), ("period", T.LongType(), pa.int64())]


def overlap(q: int, least: int, times: int) -> int:
    """Words that a run of period q shares, at the least, with itself moved by q."""
    return max(least, times * q) - q


def classes(words: int, least: int = LEAST, times: int = TIMES) -> Iterator[tuple[int, int, int]]:
    """(lo, hi, k) for texts of so many words: lags lo < q <= hi are found by k-grams."""
    lo = 0
    while max(least, times * (lo + 1)) <= words:
        # overlap falls by one a lag while ``least`` rules, then grows with the lag
        k = min(overlap(q, least, times) for q in range(lo + 1, lo + 2 + max(1, least // times)))
        hi = max(lo + 1, k)
        yield lo, hi, min(k, overlap(hi, least, times))
        lo = hi


def gram_keys(words: np.ndarray, k: int, doubled: list[np.ndarray]) -> np.ndarray:
    """A hash of every k words; ``doubled`` keeps the hashes of 1, 2, 4, ... words from call to call."""
    if not doubled:
        doubled.append(C.mix(words.astype(np.uint64) + C.U64(1)))
    while 2 << (len(doubled) - 1) <= k:
        h, step = doubled[-1], 1 << (len(doubled) - 1)
        doubled.append(C.mix(h[:-step] * C.U64(0x9E3779B97F4A7C15) + h[step:]) if len(h) > step else h[:0])
    level = k.bit_length() - 1
    h, n = doubled[level], len(words) - k + 1
    return C.mix(h[:n] * C.U64(0xD6E8FEB86659FD93) + h[k - (1 << level):][:n]) if n > 0 else h[:0]


def matched(words: np.ndarray, i: int, lag: int, lo: int, hi: int) -> tuple[int, int]:
    """The stretch [a, b) round i, within [lo, hi - lag), of words equal to those ``lag`` on; empty if i itself differs."""
    b, size = i, 64
    while b < hi - lag:
        end = min(hi - lag, b + size)
        differ = words[b:end] != words[b + lag:end + lag]
        if differ.any():
            b += int(differ.argmax())
            break
        b, size = end, size * 2
    a, size = i, 64
    while a > lo and b > i:
        begin = max(lo, a - size)
        differ = words[begin:a] != words[begin + lag:a + lag]
        if differ.any():
            a -= int(differ[::-1].argmax())
            break
        a, size = begin, size * 2
    return a, b


def find_runs(words: np.ndarray, offsets: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """Of each text (words offsets[r] to offsets[r + 1]) its runs as (start, length, period), by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
    sizes = np.diff(offsets)
    doubled: list[np.ndarray] = []
    for lo, hi, k in classes(int(sizes.max(initial=0)), least, times):
        enough = max(least, times * (lo + 1))
        h = gram_keys(words, k, doubled)
        row = np.repeat(np.arange(len(sizes)), sizes)
        at = np.flatnonzero((row[:len(h)] == row[k - 1:]) & (sizes[row[:len(h)]] >= enough)) if len(h) else np.zeros(0, np.int64)
        order = at[np.argsort(h[at], kind="stable")]
        lag = order[1:] - order[:-1]
        seed = (h[order[1:]] == h[order[:-1]]) & (row[order[1:]] == row[order[:-1]]) & (lag > lo) & (lag <= hi)
        first, lag = order[:-1][seed], lag[seed]
        by_place = np.argsort(first, kind="stable")
        current, covered = -1, {}
        for i, q, r in zip(first[by_place].tolist(), lag[by_place].tolist(), row[first[by_place]].tolist()):
            if r != current:
                current, covered = r, {}
            if i < covered.get(q, -1):
                continue
            a, b = matched(words, i, q, int(offsets[r]), int(offsets[r + 1]))
            if b - i < k:
                continue  # the hashes agreed, the words do not
            covered[q] = b
            if b - a + q >= max(least, times * q):
                out[r].append((a - int(offsets[r]), b - a + q, q))
    for found in out:
        found.sort(key=lambda run: (run[0], run[2]))
    return out


def _kernel(id_type: pa.DataType, least: int, times: int, keep: tuple[str, ...]):
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for i, j, offsets, data in C.slices(batch.column(1)):
                raw, number, texts = data.tobytes(), {}, []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    texts.append(raw[a:b].split())  # bytes split at exactly the six ASCII blanks
                words = np.array([number.setdefault(w, len(number)) for text in texts for w in text], np.int64)
                cuts = np.concatenate(([0], np.cumsum([len(text) for text in texts]))).astype(np.int64)
                found = find_runs(words, cuts, least, times)
                best, sums, whole = [], [], []
                for text, runs in zip(texts, found):
                    if runs:
                        kept = np.ones(len(text), bool)
                        for start, length, period in runs:
                            kept[start + period:start + length] = False
                        text = [w for w, k in zip(text, kept.tolist()) if k]
                    joined = b" ".join(text)
                    best.append(min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None))
                    sums.append((hashlib.sha256(b"".join(b"%d,%d,%d\n" % x for x in runs)).hexdigest(), hashlib.sha256(joined).hexdigest()))
                    whole.append(joined)
                columns = [ids.slice(i, j - i).cast(id_type), pa.array([len(x) for x in found], pa.int64())]
                columns += [pa.array([x[c] for x in best], pa.int64()) for c in range(3)]
                columns += [pa.array([x[c] for x in sums]) for c in range(2)]
                names = ["id", "n_runs", "start", "length", "period", "runs_sha256", "collapsed_sha256"]
                if "runs" in keep:
                    columns.append(pa.array([[dict(zip(("start", "length", "period"), x)) for x in runs] for runs in found],
                                            pa.list_(pa.struct([(n, t) for n, _, t in _RUN]))))
                    names.append("runs")
                if "collapsed" in keep:
                    columns.append(pa.array([x.decode() for x in whole], pa.string()))
                    names.append("collapsed")
                yield pa.RecordBatch.from_arrays(columns, names=names)
    return run


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES,
                  keep: tuple[str, ...] = ("runs", "collapsed")) -> DataFrame:
    """Per row: id, n_runs, the longest run (start, length, period), digests and, as ``keep`` asks, all runs and the collapsed text.

    ``times`` is at least 3, so that lags share k-grams and there are few classes.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    if times < 3 or least < 2:
        raise ValueError("a run has at least two words and three periods")
    src = C.pick(docs, id=id_col, text=text_col)
    kind = C.column_type(src, "id")
    run = T.StructType([T.StructField(n, t) for n, t, _ in _RUN])
    schema = T.StructType([T.StructField("id", kind), T.StructField("n_runs", T.LongType()), *run.fields,
                           T.StructField("runs_sha256", T.StringType()), T.StructField("collapsed_sha256", T.StringType()),
                           *[T.StructField("runs", T.ArrayType(run))] * ("runs" in keep), *[T.StructField("collapsed", T.StringType())] * ("collapsed" in keep)])
    out = src.mapInArrow(_kernel(to_arrow_type(kind), least, times, keep), schema)
    return out.select(F.col("id").alias(id_col), *schema.fieldNames()[1:])


def planted(id_: Column, text: Column) -> Column:
    """The text with a period planted from some word on, for about one id in ten (by the CRC-32 of the id); else the text itself."""
    h = F.crc32(id_.cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, SPACE_RUN), lambda w: w != "")
    n = F.size(words).cast("long")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    root = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    times, more = F.floor((n - a) / p).cast("int"), ((n - a) % p).cast("int")
    copied = F.concat(F.slice(words, F.lit(1), a.cast("int")), F.flatten(F.array_repeat(root, times)), F.slice(root, F.lit(1), more))
    return F.when((h % 10 == 0) & F.coalesce(F.rlike(text, F.lit(r"[^\x20\x09-\x0D]")), F.lit(False)), F.concat_ws(" ", copied)).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    return periodic_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")), keep=()).select(
        "doc_id", "n_runs", "start", "length", "period", F.floor(F.lit(1000) * F.col("length") / F.col("period")).cast("long").alias("exponent_milli"),
        "runs_sha256", "collapsed_sha256")
