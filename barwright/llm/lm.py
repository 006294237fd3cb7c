"""Language-model scoring with a log-frequency Bloom filter.

Counts of words and word pairs over all training documents are quantised on a
logarithmic scale (exact up to about five, then steps of a fifth).  An n-gram
of level q is entered q times, as (n-gram, 1) to (n-gram, q), into a Bloom
filter, which is broadcast in parts.  A count is read by probing (n-gram, 1),
(n-gram, 2), ... until a probe fails.  Probabilities are interpolated:

    P(w)     = c(w) / (N + V), and V / (N + V) / (V + 1) for each word without a count
    P(w | u) = pair_weight * min(1, c(u, w) / c(u)) + (1 - pair_weight) * P(w)

with N training tokens of V kinds; u is the word before, or the end mark.  As
many words without a count are supposed as there are kinds, and one; with them all P(w)
add up to 1, up to the filter's rounding of counts.

Every counted n-gram enters, words and pairs seen once among them.  The filter
has 12 bits an entry, the entries known from the exact histogram of levels.  A
part is bounded at ``2**MAX_BITS`` bits (32 MB): a larger filter is dealt by hash
into as many parts as it needs, the driver makes and broadcasts them one after
the other, and scoring passes each group of texts over the parts, one held at a
time.

The base score needs exact counts.  The most frequent words (at most
``HEAD_WORDS``, 16 bytes each) are broadcast; the rest of each document's words
meet their counts in one shuffled join, so no key there is frequent.

Tokens are carried as 64-bit hashes.  Defined cases: null text is empty (one
token, the end); a null id counts as the empty text for the split; rows are
scored one by one, repeated or not; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from . import common as C

PAIR_WEIGHT = 0.2
MAX_BITS, ENTRY_BITS, PROBES = 28, 12, 4
LEAST_SHARD_BITS, SHARD_LEVELS = 15, 10  # a shard has 4 KB or more, so that all fill alike; 1024 shards a part at most
DEALT_SHARDS = 3  # 2**3 neighbouring shards of a part are filled by one task
HEAD_WORDS = 1 << 18
COUNTED_TOKENS = 1 << 20  # counted together before they leave a task
SCORED_TOKENS = 1 << 19  # scored together: word pairs that recur are probed once, in the order of the filter
PROBED = 1 << 14  # n-grams probed together, so that what is derived from them stays in the cache
ONE = np.uint64(1)
END = C.mix(np.array([0x0E0D], np.uint64))[0]
ADD = 0.1


def level_starts(most: int) -> np.ndarray:
    """The least count of each level: 1, 2, 3, ... and from about 5 on each a fifth above the last."""
    starts = [1]
    while starts[-1] <= most:
        starts.append(max(starts[-1] + 1, int(np.ceil(starts[-1] * 1.2))))
    return np.array(starts, np.int64)


def level_values(starts: np.ndarray) -> np.ndarray:
    """The count that a level stands for; level 0 is none."""
    return np.concatenate(([0.0], np.sqrt(starts[:-1] * np.maximum(starts[:-1], starts[1:] - 1.0)), [float(starts[-1])]))


def tokens(i: int, j: int, offsets: np.ndarray, data: np.ndarray, member=C.not_space()):
    """Token hashes of texts i..j, each text's words then the end; and the number of tokens of each."""
    data = C.lower_ascii(data)
    starts, ends = C.spans(member[data], offsets)
    row = C.owner(starts, offsets)
    count = np.bincount(row, minlength=j - i) + 1
    out = np.full(int(count.sum()), END, np.uint64)
    out[np.arange(len(starts)) + row] = C.span_hashes(data, starts, ends) & ~C.U64(1)
    return out & ~C.U64(1), count


def pairs(tok: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before; a text's first follows the end mark. Odd, where tokens are even."""
    before = np.empty_like(tok)
    before[0], before[1:] = END & ~C.U64(1), tok[:-1]
    return C.mix(before * C.U64(0x100000001B3F) + tok) | C.U64(1)


def _count_rows(batches):
    def counted(got):
        # each slice starts with a new text, whose first word follows the end mark that closes the slice before
        tok = np.concatenate(got)
        h, n = np.unique(np.concatenate([tok, pairs(tok)]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    held, size = [], 0
    for batch in batches:
        for i, j, offsets, data in C.slices(batch.column(0)):
            held.append(tokens(i, j, offsets, data)[0])
            size += len(held[-1])
            if size >= COUNTED_TOKENS:
                yield counted(held)
                held, size = [], 0
    if held:
        yield counted(held)


# -- the filter ------------------------------------------------------------

def _probe_hash(h: np.ndarray, level: int) -> np.ndarray:
    """One hash of (n-gram, level), from which all its probes follow."""
    return C.mix(h + C.U64(level * 0x9E3779B97F4A7C15 + 1 & (1 << 64) - 1))


def _position(x: np.ndarray, probe: int, shard_bits: int) -> np.ndarray:
    """Bit within the n-gram's shard: the hash's low half and so many strides, its odd high half."""
    at = x + C.U64(probe) * ((x >> C.U64(32)) | ONE)
    return (at & C.U64((1 << shard_bits) - 1)).astype(np.int64)


def _shard(h: np.ndarray, levels: int) -> np.ndarray:
    """The top ``levels`` bits."""
    return (h >> C.U64(1) >> C.U64(63 - levels)).astype(np.int64)


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    """The part of the filter that holds an n-gram."""
    return ((h >> ONE) % C.U64(parts)).astype(np.int64)


def _filter_rows(batches, starts: np.ndarray, parts: int, shard_bits: int, levels: int):
    slot: dict[int, int] = {}
    grid = np.zeros((0, 1 << shard_bits), bool)
    for batch in batches:
        h, n = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
        q = np.searchsorted(starts, n, "right")
        places, which = np.unique(_part(h, parts) << levels | _shard(h, levels), return_inverse=True)
        fresh = [s for s in places.tolist() if s not in slot]
        slot.update({s: len(slot) + k for k, s in enumerate(fresh)})
        grid = np.concatenate([grid, np.zeros((len(fresh), grid.shape[1]), bool)])
        row = np.array([slot[s] for s in places.tolist()], np.int64)[which]
        for level in range(1, int(q.max(initial=0)) + 1):
            own = q >= level
            x, at = _probe_hash(h[own], level), row[own]
            for probe in range(PROBES):
                grid[at, _position(x, probe, shard_bits)] = True
    for s, r in slot.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([s >> levels], pa.int32()), pa.array([s & (1 << levels) - 1], pa.int32()),
             pa.array([np.packbits(grid[r], bitorder="little").tobytes()], pa.binary())], names=["part", "shard", "bits"])


class Here:
    """A part of the filter that stays where it was made, read like a broadcast."""

    def __init__(self, value: np.ndarray):
        self.value = value


class Model:
    """The filter's parts (broadcasts, or ``Here``) and what reading them needs."""

    def __init__(self, parts: list, levels: int, shard_bits: int, starts: np.ndarray, total: int, kinds: int, pair_weight: float):
        self.parts, self.levels, self.shard_bits, self.values = parts, levels, shard_bits, level_values(starts)
        self.total, self.kinds, self.pair_weight = total, kinds, pair_weight
        self.unseen = kinds / (kinds + 1.0) if kinds else 1.0  # the share of the kinds' mass that one word without a count gets, as a count

    @property
    def bits(self) -> np.ndarray:
        """The first part's bits."""
        return self.parts[0].value

    def __getstate__(self):
        return self.__dict__ | {"parts": []}  # broadcasts do not travel within another

    def counts(self, h: np.ndarray) -> np.ndarray:
        """The count that each n-gram's probes show; ascending n-grams probe shard by shard."""
        level = np.zeros(len(h), np.uint8 if len(self.values) <= 256 else np.int64)
        part = _part(h, len(self.parts)) if len(self.parts) > 1 else None
        for k, held in enumerate(self.parts):
            bits = held.value
            own = np.flatnonzero(part == k) if part is not None else np.arange(len(h))
            for i in range(0, len(own), PROBED):
                level[own[i:i + PROBED]] = self._levels(bits, h[own[i:i + PROBED]])
            if part is not None and getattr(held, "_path", None):
                vars(held).pop("_value", None)  # a worker holds one part at a time; the next read loads it from its file
        return self.values[level]

    def _levels(self, bits: np.ndarray, h: np.ndarray) -> np.ndarray:
        level = np.zeros(len(h), np.int64)
        live, base = np.arange(len(h)), _shard(h, self.levels) << self.shard_bits
        for step in range(1, len(self.values)):
            x = _probe_hash(h, step)
            there = np.ones(len(h), bool)
            for probe in range(PROBES):
                at = base + _position(x, probe, self.shard_bits)
                there &= (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).view(bool)
            live, h, base = live[there], h[there], base[there]
            if not len(live):
                break
            level[live] = step
        return level

    def log_probs(self, tok: np.ndarray) -> np.ndarray:
        """log10 of each token's probability after the one before."""
        kinds, which = np.unique(tok, return_inverse=True)
        both_kinds, both_which = np.unique(pairs(tok), return_inverse=True)
        found = self.counts(np.concatenate([kinds, both_kinds]))
        one, both = found[:len(kinds)], found[len(kinds):][both_which]
        alone = np.where(one > 0, one, self.unseen) / max(1, self.total + self.kinds)
        c, p = one[which], alone[which]
        before = np.empty_like(c)
        before[1:] = c[:-1]
        before[0] = one[which[-1]] if len(c) else 0  # the last token of a slice is the end mark
        return np.log10(np.where(before > 0, self.pair_weight * np.minimum(1.0, both / np.maximum(before, 1.0)) + (1 - self.pair_weight) * p, p))


def build(counts: DataFrame, total: int, kinds: int, pair_weight: float, max_bits: int, share=Here) -> Model:
    """The model of exact counts; ``share`` takes each part of at most ``2**max_bits`` bits once it is made."""
    starts = level_starts(max(1, total))
    # the entries, from the histogram of levels of the exact counts
    bounds = F.array(*[F.lit(int(s)) for s in starts])
    level = F.size(F.filter(bounds, lambda s: s <= F.col("n")))
    entries = counts.groupBy("n").agg(F.count("*").alias("m")).agg(F.sum(level * F.col("m"))).first()[0] or 0
    parts = max(1, -(-entries * ENTRY_BITS // (1 << max_bits)))
    bits = min(max_bits, max(17, int(entries * ENTRY_BITS - 1).bit_length()))
    levels = max(0, min(SHARD_LEVELS, bits - LEAST_SHARD_BITS))
    shard_bits = bits - levels
    size = 1 << (shard_bits - 3)
    unsigned = F.shiftrightunsigned("h", 1)
    path = scratch_path(counts.sparkSession, "ngram-filter")
    (counts.select("h", "n").repartition(unsigned % parts, F.shiftrightunsigned(unsigned, 63 - levels + min(levels, DEALT_SHARDS)))
     .mapInArrow(lambda b: _filter_rows(b, starts, parts, shard_bits, levels), "part int, shard int, bits binary")
     .write.partitionBy("part").parquet(path))
    made = counts.sparkSession.read.schema("shard int, bits binary, part int").parquet(path)

    def filled(part: int) -> np.ndarray:
        whole = np.zeros(1 << (bits - 3), np.uint8)
        for shard, found in made.where(F.col("part") == part).select("shard", "bits").collect():
            whole[shard * size:(shard + 1) * size] |= np.frombuffer(found, np.uint8)
        return whole

    return Model([share(filled(k)) for k in range(parts)], levels, shard_bits, starts, total, kinds, pair_weight)


# -- scoring ---------------------------------------------------------------

def _score_rows(batches, shared, parts, id_type):
    model, head, head_n = shared.value
    model.parts = parts
    logs = np.log10(head_n + ADD)

    def scored(held):
        tok, count = np.concatenate([t for _, _, t, _ in held]), np.concatenate([n for _, _, _, n in held])
        first = np.cumsum(count) - count
        at = np.minimum(np.searchsorted(head, tok), max(0, len(head) - 1))
        hit = head[at] == tok if len(head) else np.zeros(len(tok), bool)
        base = np.add.reduceat(np.where(hit, logs[at], 0.0) if len(head) else np.zeros(len(tok)), first)
        known = np.add.reduceat(hit.astype(np.int64), first)
        score = np.add.reduceat(model.log_probs(tok), first)
        rest = np.concatenate(([0], np.cumsum(count - known))).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays([u for u, _, _, _ in held]), pa.concat_arrays([k for _, k, _, _ in held]), pa.array(count), pa.array(score),
             pa.array(base), pa.array(known), pa.ListArray.from_arrays(rest, pa.array(tok[~hit].view(np.int64)))],
            names=["uid", "id", "n_tokens", "score", "base", "known", "rest"])

    held, size = [], 0
    for batch in batches:
        uid, ids = batch.column(0), batch.column(1)
        for i, j, offsets, data in C.slices(batch.column(2)):
            tok, count = tokens(i, j, offsets, data)
            held.append((uid.slice(i, j - i), ids.slice(i, j - i).cast(id_type), tok, count))
            size += len(tok)
            if size >= SCORED_TOKENS:
                yield scored(held)
                held, size = [], 0
    if held:
        yield scored(held)


def score(docs: DataFrame, training: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
          pair_weight: float = PAIR_WEIGHT, head_words: int = HEAD_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """Per row of ``docs``: id, n_tokens, n_known, train_tokens, base_score, score."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    src = C.pick(docs, id=id_col, text=text_col)
    counts = C.written(
        C.pick(training, text=text_col).mapInArrow(_count_rows, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "ngram-counts")
    words = counts.where("(h & 1) = 0")
    by_n = words.groupBy("n").agg(F.count("*").alias("m"))
    total, kinds = by_n.agg(F.sum(F.col("n") * F.col("m")), F.sum("m")).first()
    total, kinds = total or 0, kinds or 0
    model = build(counts, total, kinds, pair_weight, max_bits, spark.sparkContext.broadcast)
    cut = _head_cut(words, kinds, head_words)
    top = words.where(F.col("n") >= cut).toArrow()
    head = top.column("h").to_numpy().view(np.uint64)
    order = np.argsort(head)
    shared = spark.sparkContext.broadcast((model, head[order], top.column("n").to_numpy()[order].astype(np.float64)))
    parts = model.parts
    kind = C.column_type(src, "id")
    id_type = to_arrow_type(kind)
    schema = T.StructType([T.StructField("uid", T.LongType()), T.StructField("id", kind), T.StructField("n_tokens", T.LongType()),
                           T.StructField("score", T.DoubleType()), T.StructField("base", T.DoubleType()), T.StructField("known", T.LongType()),
                           T.StructField("rest", T.ArrayType(T.LongType()))])
    rows = C.written(src.select(F.monotonically_increasing_id().alias("uid"), "id", "text")
                     .mapInArrow(lambda b: _score_rows(b, shared, parts, id_type), schema), "scored")
    rest = (rows.select("uid", F.explode("rest").alias("h")).join(words.where(F.col("n") < cut), "h", "left")
            .groupBy("uid").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + ADD)).alias("more"), F.count("n").alias("more_known")))
    each = float(np.log10(total + ADD * (kinds + 1)))
    return rows.drop("rest").join(rest, "uid", "left").select(
        F.col("id").alias(id_col), "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0).cast("long"))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * each).alias("base_score"), "score")


def _head_cut(words: DataFrame, kinds: int, head_words: int) -> int:
    """The least count from which on at most ``head_words`` words lie (1: all of them)."""
    if kinds <= head_words:
        return 1
    powers = (words.groupBy(F.floor(F.log2(F.col("n").cast("double")) * 4).cast("int").alias("b"))
              .agg(F.min("n").alias("least"), F.count("*").alias("m")).orderBy(F.desc("b")).collect())
    cut, seen = 1 << 62, 0
    for _, least, m in powers:
        seen += m
        if seen > head_words:
            break
        cut = least
    return cut


def held_out():
    """Rows that never teach."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    out = score(docs, docs.where(~held_out()))
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
