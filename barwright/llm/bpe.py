"""Byte-level BPE encoding and decoding with a contiguous rank array.

A word's parts lie side by side in one array, with the ranks of neighbouring
parts beside them.  Each step scans the ranks for the least (the leftmost
of equals), replaces that part by the merged one, links over the part after
it and refreshes the two neighbouring ranks.  Many words step together: a column
for each word of a batch, so a step is a few numpy operations.  Words of over
``LONG`` bytes, where repeated scans would be quadratic, take the same merges
from a heap ordered by (rank, position).

Words come from the vocabulary's split pattern, worked out from character
classes for a whole slice of text at once.  A worker keeps a bounded cache of
the words it has met; the vocabulary (under 3 MB) is read on the driver from a
path that is a parameter, and broadcast.

Defined cases: null encodes as the empty text (no ids); the strings of special
tokens in a text become their ids, as the tokenizers library does by default;
ids decode to bytes and these to text with U+FFFD for what is no UTF-8.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
LONG = 256
CACHE_WORDS = 600_000
WORD_BYTES = 1 << 16  # of words that step together
NO_RANK = np.int32(2**31 - 1)
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0


def byte_symbols() -> dict[str, int]:
    """The vocabulary writes printable bytes as themselves, the rest from U+0100 on, in byte order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def load_vocabulary(path: str = VOCABULARY) -> dict:
    """Plain arrays: byte ids, sorted pair keys with rank and merged id, the bytes of each id, special tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ids, symbol = spec["model"]["vocab"], byte_symbols()
    special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
    text: dict[int, bytes] = {i: bytes(symbol[c] for c in s) for s, i in ids.items()}
    text |= {i: s.encode() for s, i in special.items()}
    size = max(text) + 1
    lengths = np.array([len(text.get(i, b"")) for i in range(size)], np.int64)
    pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
    order = np.argsort(keys, kind="stable")
    return {
        "byte_ids": np.array([ids[s] for s, _ in sorted(symbol.items(), key=lambda x: x[1])], np.int32),
        "keys": keys[order], "ranks": order.astype(np.int32),
        "merged": np.array([ids[a + b] for a, b in pairs], np.int32)[order],
        "flat": np.frombuffer(b"".join(text.get(i, b"") for i in range(size)), np.uint8),
        "lengths": lengths, "offsets": np.cumsum(lengths) - lengths, "special": special}


@functools.cache
def char_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[np.frombuffer(m.group().encode("utf-32-le"), np.uint32)] = kind
    return out


def word_starts(raw: bytes, edges: np.ndarray) -> np.ndarray:
    """Byte positions where words start; ``edges`` (ascending, from 0 to the end) start words too.

    The pattern: contractions, then runs of letters, numbers or others with one space before, then white
    space, of which the last character before a word is left to the word (if a space) or stands alone.
    """
    if not raw:
        return np.zeros(0, np.int64)
    edges = edges[edges < len(raw)]
    if raw.isascii():
        cp, at = np.frombuffer(raw, np.uint8), None
    else:
        cp = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
        at = np.cumsum(width) - width
        edges = np.searchsorted(at, edges)
    n = len(cp)
    edge = np.zeros(n + 1, bool)
    edge[edges] = True
    edge[n] = True
    kind = char_classes()[cp]
    before = np.empty(n, np.uint8)
    before[0], before[1:] = 255, kind[:-1]
    before[edge[:n]] = 255
    blank_before = np.zeros(n, bool)
    blank_before[1:] = cp[:-1] == 0x20
    blank_before &= ~edge[:n]
    space = kind == SPACE
    start = edge[:n] | (~space & (kind != before) & ~blank_before) | (space & (before != SPACE))
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~edge[1:n]
    start |= last
    for i in np.flatnonzero(start & (cp == 0x27)).tolist():
        tail = [chr(c) for c in cp[i + 1:i + 3].tolist()]
        if i + 1 < n and not edge[i + 1] and tail[0] in "stmd":
            size = 2
        elif i + 2 < n and not edge[i + 1] and not edge[i + 2] and "".join(tail) in ("re", "ve", "ll"):
            size = 3
        else:
            continue
        start[i + 1] = False
        if i + size < n:
            start[i + size] = True
    return np.flatnonzero(start) if at is None else at[start]


class Encoder:
    def __init__(self, vocabulary: dict):
        self.v = vocabulary
        self.cache: dict[bytes, bytes] = {}
        self.specials = {s.encode(): np.uint32(i).tobytes() for s, i in vocabulary["special"].items()}
        self.special_pattern = regex.compile(b"|".join(sorted(map(regex.escape, self.specials), key=len, reverse=True))) if self.specials else None
        self._dict: dict[int, tuple[int, int]] | None = None
        self.merged = np.zeros(len(vocabulary["ranks"]) + 1, np.int32)  # by rank
        self.merged[vocabulary["ranks"]] = vocabulary["merged"]
        self._hash_pairs()
        single = vocabulary["byte_ids"]
        self.byte_pairs = self._rank(np.repeat(single, 256), np.tile(single, 256))

    def _hash_pairs(self) -> None:
        """A table of pairs, four times as large as it needs to be: a pair lies at its hash or in the places that follow."""
        keys, ranks = self.v["keys"], self.v["ranks"]
        bits = max(4, (4 * len(keys)).bit_length())
        self.hash_shift, self.hash_mask = np.uint64(64 - bits), (1 << bits) - 1
        self.pair_keys, self.pair_ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NO_RANK, np.int32)
        open_, at = np.arange(len(keys)), self._slot(keys)
        while len(open_):
            free = self.pair_keys[at] < 0
            self.pair_keys[at[free]] = keys[open_[free]]  # of several the last stays
            held = self.pair_keys[at] == keys[open_]
            self.pair_ranks[at[held]] = ranks[open_[held]]
            open_, at = open_[~held], (at[~held] + 1) & self.hash_mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.hash_shift).astype(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of pairs of ids; ids under 0 are in no pair."""
        key = a.astype(np.int64) << 32 | b.astype(np.int64) & 0xFFFFFFFF
        key[b < 0] = -2
        at = self._slot(key)
        found = self.pair_keys.take(at)
        out = np.where(found == key, self.pair_ranks.take(at), NO_RANK)
        who = ((found != key) & (found != -1)).nonzero()[0]
        while len(who):
            at[who] = (at[who] + 1) & self.hash_mask
            found = self.pair_keys[at[who]]
            same = found == key[who]
            out[who[same]] = self.pair_ranks[at[who[same]]]
            who = who[~same & (found != -1)]
        return out

    def _rows(self, words: list[bytes]) -> list[bytes]:
        """Words of 2 to LONG bytes, of similar length: a column each, and a row more that stands for no part."""
        n, size = len(words), np.fromiter(map(len, words), np.int32, len(words))
        most = int(size.max())
        rows = np.arange(most + 1, dtype=np.int32)[:, None]
        text = np.zeros((n, most), np.uint8)
        text[rows[:-1].T < size[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        text = np.ascontiguousarray(text.T)
        ids = np.full((most + 1, n), -1, np.int32)
        ids[:-1] = np.where(rows[:-1] < size, self.v["byte_ids"][text], -1)
        order = np.full((most + 1, n), NO_RANK, np.int32)  # rank, then position, of the pair that begins here
        ranks = self.byte_pairs.take(text[:-1].astype(np.int64) << 8 | text[1:])
        order[:-2] = np.where((rows[1:-1] < size) & (ranks != NO_RANK), ranks << 8 | rows[:-2], NO_RANK)
        after = np.where(rows + 1 < size, rows + 1, most).astype(np.int16)
        before = np.where(rows == 0, most, rows - 1).astype(np.int16) + np.zeros(n, np.int16)
        flat_ids, flat_order, flat_after, flat_before = ids.reshape(-1), order.reshape(-1), after.reshape(-1), before.reshape(-1)

        def renew(left, at, a, b):
            rank = self._rank(a, b)
            flat_order[at] = np.where(rank != NO_RANK, rank << 8 | left, NO_RANK)

        while True:
            least = order.min(axis=0)
            column = (least != NO_RANK).nonzero()[0]
            if not len(column):
                break
            least = least[column]
            j = least & 0xFF
            at = j * np.int64(n) + column
            gone = flat_after.take(at) * np.int64(n) + column
            next_, earlier = flat_after.take(gone), flat_before.take(at)
            new, at_next, at_earlier = self.merged.take(least >> 8), next_ * np.int64(n) + column, earlier * np.int64(n) + column
            flat_ids[at] = new
            flat_ids[gone] = -1
            flat_order[gone] = NO_RANK
            flat_after[at] = next_
            flat_before[at_next] = j
            renew(j, at, new, flat_ids.take(at_next))
            renew(earlier, at_earlier, flat_ids.take(at_earlier), new)
        ids = ids.T
        kept = ids >= 0
        data, ends = ids[kept].astype(np.uint32).tobytes(), np.cumsum(kept.sum(1) * 4).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def _long(self, word: bytes) -> bytes:
        if self._dict is None:
            self._dict = dict(zip(self.v["keys"].tolist(), zip(self.v["ranks"].tolist(), self.v["merged"].tolist())))
        find, n = self._dict.get, len(word)
        ids = self.v["byte_ids"][np.frombuffer(word, np.uint8)].tolist()
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(hit[0], i, ids[i], ids[i + 1], hit[1]) for i in range(n - 1) if (hit := find(ids[i] << 32 | ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, merged = heapq.heappop(heap)
            k = right[i]
            if ids[i] != a or k >= n or ids[k] != b:
                continue
            ids[i], ids[k] = merged, -1
            right[i] = right[k]
            if right[i] < n:
                left[right[i]] = i
            for p, q in ((left[i], i), (i, right[i])):
                if p >= 0 and q < n and (hit := find(ids[p] << 32 | ids[q])):
                    heapq.heappush(heap, (hit[0], p, ids[p], ids[q], hit[1]))
        return np.array([i for i in ids if i >= 0], np.uint32).tobytes()

    def learn(self, words: list[bytes]) -> None:
        """Encode words into the cache, in batches of similar length."""
        single = self.v["byte_ids"]
        by_size = sorted(words, key=len)
        i = 0
        while i < len(by_size):
            size = len(by_size[i])
            if size == 1:
                self.cache[by_size[i]] = np.uint32(single[by_size[i][0]]).tobytes()
                i += 1
            elif size > LONG:
                self.cache[by_size[i]] = self._long(by_size[i])
                i += 1
            else:
                j = i
                most = max(1, WORD_BYTES // (size + 4))
                while j < len(by_size) and j - i < most and len(by_size[j]) <= min(LONG, size + size // 4 + 1):
                    j += 1
                self.cache.update(zip(by_size[i:j], self._rows(by_size[i:j])))
                i = j

    def encode_flat(self, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a slice, end to end, and how many each text has."""
        edges, inside = offsets, []
        if self.special_pattern is not None and any(s in raw for s in self.specials):
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                inside += [m.span() for m in self.special_pattern.finditer(raw, a, b)]
            edges = np.unique(np.concatenate([offsets, np.array(inside, np.int64).ravel()]))
        starts = word_starts(raw, edges)
        if inside:
            keep = np.ones(len(starts), bool)
            for a, b in inside:
                keep[np.searchsorted(starts, a, "right"):np.searchsorted(starts, b)] = False
            starts = starts[keep]
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        cuts = np.append(starts, len(raw))
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(raw)]).dictionary_encode()
        which, distinct = found.indices.to_numpy(), found.dictionary
        edges = np.frombuffer(distinct.buffers()[1], np.int64)[:len(distinct) + 1].tolist()
        text = distinct.buffers()[2].to_pybytes()
        words = [text[a:b] for a, b in zip(edges, edges[1:])]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        coded = list(map(self.cache.get, words))
        missing = [i for i, ids in enumerate(coded) if ids is None]
        special_at = [i for i in missing if words[i] in self.specials]
        for i in special_at:
            self.cache[words[i]] = self.specials[words[i]]
        self.learn([words[i] for i in missing if words[i] not in self.specials] if special_at else [words[i] for i in missing])
        for i in missing:
            coded[i] = self.cache[words[i]]
        flat = np.frombuffer(b"".join(coded), np.uint32)
        length = np.fromiter(map(len, coded), np.int64, len(coded)) >> 2
        begin = np.cumsum(length) - length
        size = length.take(which)
        ends = np.concatenate(([0], np.cumsum(size)))
        ids = flat.take(np.repeat(begin.take(which) - ends[:-1], size) + np.arange(ends[-1]))
        return ids, np.diff(ends.take(np.searchsorted(starts, offsets)))

    def encode_slice(self, raw: bytes, offsets: np.ndarray) -> list[bytes]:
        """Ids (little-endian 32-bit) of each text of a slice."""
        ids, counts = self.encode_flat(raw, offsets)
        data, ends = ids.tobytes(), np.cumsum(counts * 4).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, end to end."""
        size = self.v["lengths"][ids]
        total = int(size.sum())
        begin = np.cumsum(size) - size
        return self.v["flat"][np.repeat(self.v["offsets"][ids] - begin, size) + np.arange(total)].tobytes()


_ENCODERS: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """One encoder for each broadcast vocabulary in a worker process."""
    key = id(shared.value)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(shared.value)
    return _ENCODERS[key]


def _rows(batches, shared, id_type, keep_ids: bool, keep_text: bool):
    enc = _encoder(shared)
    for batch in batches:
        ids = batch.column(0)
        for i, j, offsets, data in C.slices(batch.column(1)):
            coded = enc.encode_slice(data.tobytes(), offsets)
            n = np.array([len(c) // 4 for c in coded], np.int64)
            flat = np.frombuffer(b"".join(coded), np.uint32)
            raw = enc.decode(flat)
            ends = np.concatenate(([0], np.cumsum(enc.v["lengths"][flat])))[np.concatenate(([0], np.cumsum(n)))].tolist()
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])]
            columns = [ids.slice(i, j - i).cast(id_type), pa.array(n),
                       pa.array([hashlib.sha256(c).hexdigest() for c in coded]),
                       pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts])]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(n))).astype(np.int32), pa.array(flat.astype(np.int32))))
                names.append("ids")
            if keep_text:
                columns.append(pa.array(texts, pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names=names)


def bpe(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY,
        keep: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256 and, as ``keep`` asks, ids and decoded."""
    from pyspark.sql.pandas.types import to_arrow_type

    src = C.pick(docs, id=id_col, text=text_col)
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))
    kind, keep_ids, keep_text = C.column_type(src, "id"), "ids" in keep, "decoded" in keep
    fields = [T.StructField("id", kind), T.StructField("n_tokens", T.LongType()),
              T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * keep_ids + [T.StructField("decoded", T.StringType())] * keep_text
    id_type = to_arrow_type(kind)
    out = src.mapInArrow(lambda batches: _rows(batches, shared, id_type, keep_ids, keep_text), T.StructType(fields))
    return out.select(F.col("id").alias(id_col), *[f.name for f in fields[1:]])


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe(C.table(spark, sf_dir, "documents"), keep=())
