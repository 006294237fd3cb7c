"""Quality classifier: supervised subword embeddings.

Features are hashed words, character n-grams and the shapes of word bigrams
(a word that equals the one before, or the one two before), each with a learned
vector; a document is the average of its features' vectors, ``BLANK`` zero
vectors among them so that a few words alone decide little, and a softmax over
the two classes follows.  Both layers are trained by stochastic gradient descent in
numpy.  The label is never an input: a row's text alone is hashed.

Fitting uses a bounded sample of labelled rows (about ``sample_rows``, kept by
a hash of the id; the share comes from an exact count).  Workers hash the
sample's whole texts and send feature counts; the driver's training set is
bounded by the sample.  Scoring covers every row's whole text.  As the output
layer is linear in the average, each feature's score (its vector times the
difference of the class weights) is computed once, and a text's score is the
average over its features.

Defined cases: empty or null texts have the score of the bias alone; rows
without a label, or whose label is neither 0 nor 1, teach nothing; repeated ids
in either table are joined as they are; with no labelled row every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

BUCKETS, WIDTH = 1 << 16, 12
GRAMS = (2, 3, 4)
BLANK = 20
REPEATED = (0, 1)  # the buckets of the repeat shapes, with a few hashed features beside them
SAMPLE_ROWS, ROUNDS, RATE = 1200, 12, 0.5
CUT = 0.3


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every hashed word and character n-gram; none crosses a text's end."""
    bits = C.U64(64 - BUCKETS.bit_length() + 1)
    member = C.not_space()
    starts, ends = C.spans(member[data], offsets)
    words, row = C.span_hashes(data, starts, ends), C.owner(starts, offsets).astype(np.int32)
    buckets, rows = [(words >> bits).astype(np.int32)], [row]
    for bucket, back in zip(REPEATED, (1, 2)):
        again = row[back:][(words[back:] == words[:-back]) & (row[back:] == row[:-back])]
        buckets.append(np.full(len(again), bucket, np.int32))
        rows.append(again)
    place = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    values = C.BYTE_VALUE[data]
    for n in GRAMS:
        if len(data) < n:
            continue
        grams = C.gram_hashes(values, n)
        inside = place[:len(grams)] == place[n - 1:]
        buckets.append((grams[inside] >> bits).astype(np.int32))
        rows.append(place[:len(grams)][inside])
    return np.concatenate(buckets), np.concatenate(rows)


def fit(samples: list[tuple[int, np.ndarray, np.ndarray]], rounds: int = ROUNDS, rate: float = RATE, seed: int = 7) -> tuple[np.ndarray, float]:
    """(score of each bucket, bias): the logit of class 1 against class 0.

    ``samples``: (label, buckets, counts) per document; classes weigh as they occur.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH))
    out, bias = np.zeros((2, WIDTH)), np.zeros(2)
    steps, total = 0, max(1, rounds * len(samples))
    for _ in range(rounds):
        for i in rng.permutation(len(samples)):
            label, buckets, counts = samples[i]
            lr = rate * (1 - steps / total)
            steps += 1
            share = counts / (counts.sum() + BLANK)
            hidden = share @ vectors[buckets]
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            error = p
            error[label] -= 1
            back = error @ out
            out -= lr * np.outer(error, hidden)
            bias -= 0.1 * lr * error
            # a feature's gradient is its share; scaled as if each distinct feature came alone, so rare ones learn too
            vectors[buckets] -= lr * np.sqrt(share)[:, None] * back
    return vectors @ (out[1] - out[0]), float(bias[1] - bias[0])


def _hashed(batches):
    for batch in batches:
        for i, j, offsets, data in C.slices(batch.column(1)):
            bucket, row = features(data, offsets)
            key, n = np.unique(row.astype(np.int64) * BUCKETS + bucket, return_counts=True)
            ends = np.searchsorted(key, np.arange(j - i + 1, dtype=np.int64) * BUCKETS).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i),
                 pa.ListArray.from_arrays(ends, pa.array((key % BUCKETS).astype(np.int32))),
                 pa.ListArray.from_arrays(ends, pa.array(n.astype(np.int32)))], names=["label", "buckets", "counts"])


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, float]:
    known = C.pick(labels, id=id_col, label=label_col).where("label in (0, 1) and id is not null")
    n = known.count()
    if not n:
        return np.zeros(BUCKETS), 0.0
    draw = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.where(draw < min(1.0, sample_rows / n))
    joined = C.pick(docs, id=id_col, text=text_col).join(F.broadcast(chosen), "id")  # about sample_rows rows of 16 bytes
    rows = (joined.select(F.col("label").cast("int").alias("label"), "text")
            .mapInArrow(_hashed, "label int, buckets array<int>, counts array<int>").toArrow())
    samples = [(y, np.array(b, np.int32), np.array(c, np.float64)) for y, b, c in
               zip(rows.column(0).to_pylist(), *(_lists(rows.column(k)) for k in (1, 2)))]
    samples.sort(key=lambda s: (s[0], len(s[1]), s[1].tobytes(), s[2].tobytes()))  # the same order however tasks end
    return fit(samples)


def _lists(column):
    for chunk in column.chunks:
        flat, ends = chunk.values.to_numpy(), chunk.offsets.to_numpy()
        yield from (flat[a:b] for a, b in zip(ends[:-1], ends[1:]))


def _rows(batches, shared, id_type):
    weights, bias = shared.value
    for batch in batches:
        for i, j, offsets, data in C.slices(batch.column(1)):
            bucket, row = features(data, offsets)
            n = np.bincount(row, minlength=j - i)
            z = np.bincount(row, weights=weights[bucket], minlength=j - i) / (n + BLANK) + bias
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i).cast(id_type), pa.array(1.0 / (1.0 + np.exp(-np.clip(z, -700, 700))))], names=["id", "score"])


def score(docs: DataFrame, model: tuple[np.ndarray, float], *, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """Per row: id, score (class 1), predicted (1 from ``cut`` on)."""
    from pyspark.sql.pandas.types import to_arrow_type

    src = C.pick(docs, id=id_col, text=text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = C.column_type(src, "id")
    schema = T.StructType([T.StructField("id", kind), T.StructField("score", T.DoubleType())])
    id_type = to_arrow_type(kind)
    return (src.mapInArrow(lambda b: _rows(b, shared, id_type), schema).withColumnRenamed("id", id_col)
            .withColumn("predicted", (F.col("score") >= cut).cast("int")))


def accepted(docs: DataFrame, model: tuple[np.ndarray, float], *, text_col: str = "text", cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``cut``, in one pass."""
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            part = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(at)], names=["id", "text"])
            scores = [out.column(1).to_numpy() for out in _rows([part], shared, pa.int64())]
            if scores:
                yield batch.filter(pa.array(np.concatenate(scores) >= cut))

    return docs.mapInArrow(run, docs.schema)


def held_out():
    """Rows that never teach."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels")
    model = train(docs, labels.where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
