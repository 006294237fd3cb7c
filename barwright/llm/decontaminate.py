"""Benchmark decontamination by winnowing.

Fingerprints are k-gram hashes; in every run of w consecutive k-grams the
least hash is kept.  With ``k + w - 1 = window`` (5 + 6 - 1 = 10 words) every
shared span of ``window`` words has a kept fingerprint on both sides, so no
shared window can be missed.  Fingerprints of training and test texts are
joined, and a hit is extended over the whole window: the join condition also
compares the window's words, so a hash collision cannot make a hit.

An item of fewer words than ``window`` is one window of its own length n; its
fingerprint is the single n-gram (k = n, w = 1).

Scale: documents are read once.  A bitmap of fixed size (1 MB, whatever the
benchmark's size) built by Spark from the benchmark's fingerprints is sent to
the workers; only document windows whose fingerprint may occur in it leave the
scan.  The exact join follows; its benchmark side is broadcast only under a
checked size, else it is an ordinary shuffled join on (length, fingerprint,
words), whose keys are distinct on the benchmark side.

Defined cases: null or empty text has no words; null ids are kept (null
item ids count in the hits but not among the items); rows with equal id and
text give equal results, one per row; item rows with the same id are one item;
empty tables give empty results or uncontaminated documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

WINDOW, GRAM = 10, 5
FILTER_BITS = 23
BROADCAST_BYTES = 8 << 20

_WINDOWS = T.ArrayType(T.StructType([
    T.StructField("start", T.LongType()), T.StructField("len", T.IntegerType()),
    T.StructField("fp", T.LongType()), T.StructField("words", T.StringType())]))
_ARROW_WINDOWS = pa.list_(pa.struct([("start", pa.int64()), ("len", pa.int32()), ("fp", pa.int64()), ("words", pa.string())]))


def _fingerprints(words: np.ndarray, row: np.ndarray, length: int, window: int, gram: int):
    """(first word, fingerprint) of each window of ``length`` words inside one text."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k = gram if length == window else length
    grams = C.as_signed(C.gram_hashes(words, k))
    least = grams[:n].copy()
    for j in range(1, length - k + 1):
        np.minimum(least, grams[j:j + n], out=least)
    at = np.flatnonzero(row[:n] == row[length - 1:])
    return at, least[at]


def _kernel(id_field: pa.DataType, lengths, bits, window: int, gram: int, items: bool):
    member = C.word_member()

    def run(batches):
        for batch in batches:
            ids, texts, keys = batch.column(0), batch.column(1), batch.column(2)
            for i, j, offsets, data in C.slices(texts):
                data = C.lower_ascii(data)
                starts, ends = C.spans(member[data], offsets)
                row = C.owner(starts, offsets)
                words = C.span_hashes(data, starts, ends)
                count = np.bincount(row, minlength=j - i)
                first = np.concatenate(([0], np.cumsum(count)))
                found: list[list] = [[] for _ in range(j - i)]
                raw = data.tobytes()
                for length in ([window, *range(1, window)] if items else lengths):
                    at, fp = _fingerprints(words, row, length, window, gram)
                    if items and length < window:
                        keep = count[row[at]] == length
                    elif bits is not None:
                        slot = fp.view(np.uint64) >> C.U64(64 - FILTER_BITS)
                        keep = (bits.value[slot >> C.U64(3)] >> (slot & C.U64(7)).astype(np.uint8)) & 1 == 1
                    else:
                        keep = np.ones(len(at), bool)
                    for s, f in zip(at[keep].tolist(), fp[keep].tolist()):
                        text = b" ".join([raw[a:b] for a, b in zip(starts[s:s + length].tolist(), ends[s:s + length].tolist())])
                        r = int(row[s])
                        found[r].append({"start": s - int(first[r]), "len": length, "fp": f, "words": text.decode()})
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i).cast(id_field), keys.slice(i, j - i), pa.array(count, pa.int64()), pa.array(found, _ARROW_WINDOWS)],
                    names=["id", "key", "n_words", "windows"])
    return run


def _windows(df: DataFrame, lengths, bits, window: int, gram: int, items: bool) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = C.column_type(df, "id")
    schema = T.StructType([T.StructField("id", kind), T.StructField("key", T.StringType()),
                           T.StructField("n_words", T.LongType()), T.StructField("windows", _WINDOWS)])
    keyed = df.withColumn("key", C.row_key(df["id"], df["text"]))
    return keyed.mapInArrow(_kernel(to_arrow_type(kind), lengths, bits, window, gram, items), schema)


def _bitmap(spark: SparkSession, fps: DataFrame):
    """1 MB of bits, one set for each benchmark fingerprint; built by Spark in 32 K-bit pieces."""
    slot = F.shiftrightunsigned("fp", 64 - FILTER_BITS) + 1  # Spark counts bits from 1
    pieces = (fps.select(F.bitmap_bucket_number(slot).alias("b"), F.bitmap_bit_position(slot).alias("p"))
              .groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits")).collect())
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    size = 32768 // 8
    for b, bits in pieces:
        out[(b - 1) * size:b * size] = np.frombuffer(bits, np.uint8)[:size]
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text",
                  window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per document: id, n_words, n_hit, items (sorted strings), contaminated."""
    spark = docs.sparkSession
    items = _windows(C.pick(benchmark, id=item_id_col, text=item_text_col), None, None, window, gram, True)
    test = C.written(
        items.select(F.col("id").cast("string").alias("item"), F.explode("windows").alias("w"))
        .select("item", "w.len", "w.fp", "w.words")
        .groupBy("len", "fp", "words").agg(F.collect_set("item").alias("items")), "benchmark-windows")
    size = test.agg(F.collect_set("len"), F.sum(F.length("words") + F.size("items") * 24 + 40)).first()
    bits = spark.sparkContext.broadcast(_bitmap(spark, test))
    train = C.written(_windows(C.pick(docs, id=id_col, text=text_col), sorted(size[0]), bits, window, gram, False), "document-windows")
    hits = (train.select("key", F.explode("windows").alias("w")).select("key", "w.*"))
    side = F.broadcast(test) if (size[1] or 0) <= BROADCAST_BYTES else test
    matched = hits.join(side, ["len", "fp", "words"])
    per_doc = (matched.groupBy("key").agg(
        F.array_sort(F.collect_set(F.struct("start", F.col("len").cast("long").alias("len")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
        .select("key", "items", F.aggregate(
            "spans", F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("total")),
            lambda acc, x: F.struct(
                F.greatest(acc["upto"], x["start"] + x["len"]).alias("upto"),
                (acc["total"] + F.greatest(F.lit(0).cast("long"), x["start"] + x["len"] - F.greatest(acc["upto"], x["start"]))).alias("total")),
            lambda acc: acc["total"]).alias("n_hit")))
    joined = train.select("id", "key", "n_words").join(per_doc, "key", "left")
    return joined.select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark window."""
    keyed = C.pick(docs, id=id_col, text=text_col).withColumn("key", C.row_key(F.col("id"), F.col("text")))
    hit = (decontaminate(keyed, benchmark, id_col="key", text_col="text", **options)
           .where("contaminated").select(F.col("key").alias("hit_key")).distinct())
    return docs.join(hit, C.row_key(docs[id_col], docs[text_col]) == hit["hit_key"], "left_anti")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH lowered AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, 2 + len(w) - least(len(w), 10))) AS s FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS t
  FROM (SELECT doc_id, w, n, unnest(range(1, 2 + len(w) - n)) AS s FROM lowered, lengths WHERE len(w) >= n)),
hits AS (SELECT doc_id, s, d.n, item_id FROM doc_windows d JOIN item_windows i ON d.t = i.t AND d.n = i.n),
hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM hits)) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT l.doc_id, CAST(len(l.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM lowered l LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
