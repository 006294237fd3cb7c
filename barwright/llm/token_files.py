"""Token-id files: an adaptive context-mixing range coder in independent blocks.

Ids are cut into blocks of ``BLOCK`` ids.  A block starts from an empty model,
carries its own CRC-32 and is decoded by itself.  Inside a block an id has the
number of its first appearance, and three orders predict the next one:

* order 2 and order 1 each name a candidate for their context (the last two
  ids, the last id) with a confidence.  Their shares, and what is left to order 0,
  follow how often each was right at that pair of confidences;
* order 0 has counts of the ids left to it, taken anew at set places
  (``renewals``); a new id, whose number is the next, joins their end at once.

The mixed probabilities drive range coders with 64-bit low and range and
32-bit words: one for who is right, one for the ids left to order 0.  As the
second stream needs nothing of the first, it is read in a loop of its own.
All arithmetic is on integers, so files read the same anywhere.
Many blocks step together: position t of all blocks is a few numpy operations.

Files: documents are dealt by ranges of the id, sorted, and put out as
segments of whole documents of about ``SEGMENT`` ids: document ids, lengths and
the coded blocks.  A segment is a row of a Parquet table under the shared folder, so
writing is atomic per task, a lost task is written again, and any file
system that Spark knows will do.  A document's start is its place in its range plus the sum
over earlier ranges, a table of one row a range.

Block: 4 bytes ``CMX2``, then as 16-bit little-endian numbers the count of ids, of distinct ids and of ids left to order 0,
the bits of the largest id, the words of order 0 and the words of choices; the CRC-32 of the ids (32-bit little-endian); then
the distinct ids in plain bits and the words of both streams.

Defined cases: null text is empty (only the end id); null document ids come
first; rows of one id go by text; repeated rows each have their ids; an empty
table makes no segment; a damaged block raises ``ValueError``.  Ids are below 2^31.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from . import bpe
from . import common as C

END_ID = 2
BLOCK = 4095  # numbers of first appearance go from 1 and fit 12 bits
SEGMENT = 16 * BLOCK
TOGETHER = 2048  # blocks that step together
ROW_GROUP_BYTES = 16 << 20
MAGIC, HEADER = b"CMX2", struct.Struct("<4sHHHHHHI")

CONTEXTS, KINDS = 4096, 64  # KINDS: two confidences of 0 to 7
STEP = 8  # count that an id adds
SHARE_BITS, WHOLE = 16, 1 << 16
LEAST_SHARE = 32
# of each kind, how often order 2, order 1 and order 0 are taken to have been right before a block begins
FIRST_COUNTS = np.array([(min(two, 4), min(one, 4), 2 + 8 * (two + one == 0), 0) for two in range(8) for one in range(8)], np.uint32)
WORD, ALL = np.uint64(32), np.uint64(0xFFFFFFFFFFFFFFFF)
TOP = np.uint64(1 << 32)


def renewals(size: int, part: int) -> list[int]:
    """Places in a stream at which shares or counts are taken anew, each a ``part`` further on."""
    out, at = [], 8
    while at < size:
        out.append(at)
        at += at // part
    return out


class Writer:
    """Range coders of many blocks, each with its own words; two steps at most go before words are put out."""

    def __init__(self, blocks: int):
        self.low = np.zeros(blocks, np.uint64)
        self.range = np.full(blocks, ALL)
        self.at = np.zeros(blocks, np.int64)
        self.words = np.zeros((blocks, 64), np.uint32)
        self.before = self.low.copy()
        self.most = 0  # words a block can have by now

    def move(self, n: int, add: np.ndarray, range_: np.ndarray) -> None:
        """Raise the first lows by ``add`` and set the ranges."""
        self.low[:n] += add
        self.range[:n] = range_

    def settle(self, n: int) -> None:
        """Carry where lows ran over, and put out a word where the range is short."""
        low, range_ = self.low[:n], self.range[:n]
        row = (low < self.before[:n]).nonzero()[0]
        place = self.at[row] - 1
        while len(row):  # a carry runs back while words overflow
            self.words[row, place] += np.uint32(1)
            again = self.words[row, place] == 0
            row, place = row[again], place[again] - 1
        short = (range_ < TOP).nonzero()[0]
        if len(short):
            if self.most == self.words.shape[1]:
                self.most = int(self.at.max())
                if 2 * self.most > self.words.shape[1]:
                    self.words = np.concatenate([self.words, np.zeros_like(self.words)], 1)
            self.most += 1
            at, full = self.at[short], low[short]
            self.words[short, at] = full >> WORD
            self.at[short] = at + 1
            low[short] = full << WORD
            range_[short] = range_[short] << WORD
        self.before[:n] = low

    def finish(self) -> list[bytes]:
        """One word more: the least place of whole words in the range; what is read after it is zeros."""
        n = len(self.at)
        self.move(n, -self.low & np.uint64(0xFFFFFFFF), np.ones_like(self.range))
        self.settle(n)
        return [self.words[i, :n].astype("<u4").tobytes() for i, n in enumerate(self.at.tolist())]


class Reader:
    """The same coders, read: ``low`` is the code's distance from the coder's low."""

    def __init__(self, payloads: list[bytes]):
        most = max((len(p) for p in payloads), default=0) // 4
        self.words = np.zeros((len(payloads), most + 4), np.uint32)
        for i, p in enumerate(payloads):
            self.words[i, :len(p) // 4] = np.frombuffer(p, "<u4")
        self.low = self.words[:, 0].astype(np.uint64) << WORD | self.words[:, 1]
        self.at = np.full(len(payloads), 2)
        self.range = np.full(len(payloads), ALL)

    def move(self, n: int, add: np.ndarray, range_: np.ndarray) -> None:
        self.low[:n] -= add
        self.range[:n] = range_

    def settle(self, n: int) -> None:
        low, range_ = self.low[:n], self.range[:n]
        short = (range_ < TOP).nonzero()[0]
        if len(short):
            at = self.at[short]
            word = self.words[short, np.minimum(at, self.words.shape[1] - 1)]  # damaged data may ask for more than there is
            self.at[short] = at + 1
            low[short] = low[short] << WORD | word
            range_[short] = range_[short] << WORD


def _shares(counts: np.ndarray) -> np.ndarray:
    """Running sums of the shares of orders 2 and 1, by block and kind, from counts of which was right."""
    right = counts.reshape(-1, KINDS, 4).astype(np.uint32) + FIRST_COUNTS
    part = right[:, :, :2] * np.uint32(WHOLE - 3 * LEAST_SHARE) // right.sum(2, dtype=np.uint32, keepdims=True) + np.uint32(LEAST_SHARE)
    out = np.zeros(right.shape, np.uint64)
    out[:, :, 0], out[:, :, 1] = part[:, :, 0], part[:, :, 0] + part[:, :, 1]
    return out.ravel()


def _decide(coder, sizes: np.ndarray, numbers: np.ndarray | None, rest: np.ndarray | None) -> np.ndarray:
    """Code (numbers given, a column a block) or read (what order 0 says given, a row a block) which order says each id.

    Blocks are of descending sizes.  Gives the mask of those left to order 0, or the numbers.
    """
    blocks, longest, reading = len(sizes), int(sizes.max(initial=0)), numbers is None
    out = np.zeros((longest, blocks), np.uint16 if reading else np.uint8)
    every, shift = np.arange(blocks), np.uint64(SHARE_BITS)
    table = np.zeros(2 * blocks * CONTEXTS, np.uint16)  # context -> candidate and confidence: order 2, then order 1
    base = np.stack([every * CONTEXTS, (every + blocks) * CONTEXTS])
    counts = np.zeros(blocks * KINDS * 4, np.int64)  # by kind: order 2 right, order 1, neither
    if reading:
        flat, place = rest.ravel(), every * rest.shape[1]
    state, n = np.zeros((2, blocks), np.int64), -1  # hash of the last two numbers, and the last
    left = np.searchsorted(-sizes, -np.arange(longest)).tolist()
    places = [0, *renewals(longest, 2), longest]
    for begin, end in zip(places, places[1:]):
        shares = _shares(counts)
        met = np.full((end - begin, blocks), len(counts))
        for t in range(begin, end):
            if left[t] != n:
                n = left[t]
                base, by_block, state = base[:, :n].copy(), every[:n] * (KINDS * 4), state[:, :n].copy()
                bounds, learned, last = np.zeros((4, n), np.uint64), np.zeros((2, n), np.uint16), state[1].astype(np.uint16)
                _, two, both, whole = bounds
                if reading:
                    place = place[:n]
            slot = base + state
            entry = table.take(slot)
            candidate, sure = entry >> 3, entry & 7
            kind = by_block + ((sure[0] << 5) | (sure[1] << 2))
            whole[:] = coder.range[:n]
            unit = whole >> shift
            np.multiply(unit, shares.take(kind), out=two)
            np.multiply(unit, shares.take(kind + 1), out=both)
            if reading:
                low = coder.low[:n]
                by_two, other = low < two, low >= both
                number = flat.take(place)
                np.copyto(number, candidate[0], where=by_two)
                np.copyto(number, candidate[1], where=~(by_two | other))
                place += other
                out[t, :n] = number
            else:
                number = numbers[t, :n]
            miss = candidate != number
            who = miss.view(np.uint8)
            who = who[0] + (who[0] & who[1])  # 0, 1: order 2, order 1 is right; 2: neither
            at = who * np.int64(n) + every[:n]
            below = bounds.take(at)
            coder.move(n, below, bounds.take(at + n) - below)
            if t & 1:
                coder.settle(left[t - 1])
            np.add(kind, who, out=met[t - begin, :n])
            if not reading:
                out[t, :n] = who
            learned[:] = (number << 3) + np.uint16(1)
            np.putmask(learned, sure > 2, entry - ((sure + 1) >> 1))
            np.putmask(learned, ~miss, entry + (sure < 7))
            table[slot] = learned
            state[0] = (number * np.uint16(0x9E5) + last * np.uint16(0x3D1)) & np.uint16(CONTEXTS - 1)
            state[1] = last = number
        counts += np.bincount(met.ravel(), minlength=len(counts) + 1)[:-1]
    if longest & 1:
        coder.settle(left[-1])
    return out if reading else out == 2


def _rest(coder, sizes: np.ndarray, most: int, numbers: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Code (given, a column a block) or read what order 0 says; the numbers and how many differ. Blocks are of descending sizes.

    Counts are taken anew at set places; a new number, which is always the next, joins the end of the sums at once.
    """
    blocks, longest, reading = len(sizes), int(sizes.max(initial=0)), numbers is None
    out = np.zeros((longest, blocks), np.uint16) if reading else numbers
    every, step_ = np.arange(blocks), np.uint64(STEP)
    counts = np.zeros((blocks, most + 2), np.uint16)  # by number; 0 is a new one
    counts[:, 0] = STEP
    seen = np.zeros(blocks, np.uint16)
    left = np.searchsorted(-sizes, -np.arange(longest)).tolist()
    places = [0, *renewals(longest, 3), longest]
    for begin, end in zip(places, places[1:]):
        known, columns = seen.copy(), min(int(seen.max(initial=0)) + end - begin, most) + 1
        wide = 1 << columns.bit_length()
        taken = counts[:, :columns].copy()
        total = taken.sum(1, dtype=np.uint64)
        taken[np.arange(columns) > known[:, None]] = STEP  # what each number has that joins
        sums = np.full((blocks, wide), 0xFFFF, np.uint16)
        sums[:, 0] = 0
        sums[:, 1:columns + 1] = np.minimum(np.cumsum(taken, axis=1, dtype=np.uint32), 0xFFFF)
        flat, base = sums.ravel(), every * wide
        if reading:
            stride = max(1, wide >> 6)
            coarse = np.ascontiguousarray(sums[:, stride::stride].T)
            for t in range(begin, end):
                n = left[t]
                unit = coder.range[:n] // total[:n]
                place = np.minimum(coder.low[:n] // unit, total[:n] - np.uint64(1)).astype(np.uint16)
                # the number in whose share the place lies
                at = base[:n] + np.add.reduce((coarse[:, :n] <= place).view(np.uint8), axis=0, dtype=np.uint8) * np.int64(stride)
                step = stride >> 1
                while step:
                    up = at + step
                    at = np.where(flat.take(up) <= place, up, at)
                    step >>= 1
                start = flat.take(at)
                coder.move(n, unit * start, unit * (flat.take(at + 1) - start))
                if t & 1:
                    coder.settle(left[t - 1])
                number = out[t, :n]
                number[:] = at - base[:n]
                new = (number == 0).nonzero()[0]
                if len(new):
                    seen[new] = number[new] = np.minimum(seen[new] + 1, most + 1)  # more only where data are damaged
                    total[new] += step_
        else:
            before = np.zeros((end - begin + 1, blocks), np.uint16)
            before[0] = seen
            for t in range(begin, end):
                np.maximum(before[t - begin], numbers[t], out=before[t - begin + 1])
            seen, before = before[-1], before[:-1]
            at = base + np.where(numbers[begin:end] > before, np.uint16(0), numbers[begin:end])
            starts = flat.take(at)
            lengths = flat.take(at + 1) - starts
            joined = before - known
            for t in range(begin, end):
                n = left[t]
                unit = coder.range[:n] // (total[:n] + joined[t - begin, :n] * step_)
                coder.move(n, unit * starts[t - begin, :n], unit * lengths[t - begin, :n])
                if t & 1:
                    coder.settle(left[t - 1])
        live = np.arange(begin, end)[:, None] < sizes
        met = every * (most + 2) + out[begin:end]
        np.add.at(counts.ravel(), met if live.all() else met[live], np.uint16(STEP))
        counts[:, 0] += (seen - known) * np.uint16(STEP)
    if longest & 1:
        coder.settle(left[-1])
    return out, seen


def _turned(table: np.ndarray) -> np.ndarray:
    """Rows as columns, copied in strips that stay in the processor's cache."""
    out = np.empty(table.shape[::-1], table.dtype)
    for i in range(0, len(table), 64):
        out[:, i:i + 64] = table[i:i + 64].T
    return out


def _columns(parts: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """Arrays as columns, in the given order, zeros after their ends."""
    out = np.zeros((len(parts), max((len(x) for x in parts), default=0)), np.uint16)
    for row, i in enumerate(order.tolist()):
        out[row, :len(parts[i])] = parts[i]
    return _turned(out)


def encode_blocks(blocks: list[np.ndarray], together: int = TOGETHER) -> list[bytes]:
    """The records of blocks of 1 to ``BLOCK`` ids."""
    out: list[bytes] = [b""] * len(blocks)
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    first = np.zeros(max((int(b.max()) for b in blocks), default=0) + 1, np.int32)
    for i in range(0, len(order), together):
        part = order[i:i + together]
        sizes = np.array([len(blocks[b]) for b in part])
        numbers, fresh, plain = [], [], []
        for b in part:
            block, size = blocks[b].astype(np.int64), len(blocks[b])
            place = np.arange(size, dtype=np.int32)
            first[block[::-1]] = place[::-1]  # the first appearance is written last
            begin = first[block]
            new = begin == place
            numbers.append(np.cumsum(new, dtype=np.uint16)[begin])
            fresh.append(block[new])
        columns = _columns(numbers, np.arange(len(part)))
        coder = Writer(len(part))
        other = _turned(_decide(coder, sizes, columns, None))
        decisions = coder.finish()
        rest = [x[o[:len(x)]] for x, o in zip(numbers, other)]
        counts = np.array([len(x) for x in rest])
        by_count = np.argsort(-counts, kind="stable")
        coder = Writer(len(part))
        _rest(coder, counts[by_count], max(len(x) for x in fresh), _columns(rest, by_count))
        words = dict(zip(by_count.tolist(), coder.finish()))
        for row, b in enumerate(part):
            bits = int(blocks[b].max()).bit_length()
            plain = _pack(fresh[row], bits)
            out[b] = HEADER.pack(MAGIC, len(blocks[b]), len(fresh[row]), len(rest[row]), bits, len(words[row]) // 4, len(decisions[row]) // 4,
                                 zlib.crc32(blocks[b].astype("<u4").tobytes())) + plain + words[row] + decisions[row]
    return out


def _pack(ids: np.ndarray, bits: int) -> bytes:
    shown = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, count=bits, bitorder="little")
    return np.packbits(shown, bitorder="little").tobytes()


def _unpack(data: bytes, count: int, bits: int) -> np.ndarray:
    shown = np.zeros((count, 32), np.uint8)
    shown[:, :bits] = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    return np.packbits(shown, axis=1, bitorder="little").view("<u4").ravel()


def split_records(data: bytes) -> list[tuple]:
    """(count of ids, CRC-32, count left to order 0, distinct ids, words of order 0, words of decisions) of every record of a file or segment."""
    out, at = [], 0
    while at < len(data):
        if at + HEADER.size > len(data):
            raise ValueError("a token block ends inside its header")
        magic, size, fresh, rest, bits, rest_words, words, crc = HEADER.unpack_from(data, at)
        at += HEADER.size
        ends = [at + (fresh * bits + 7) // 8]
        ends += [ends[0] + 4 * rest_words, ends[0] + 4 * rest_words + 4 * words]
        if magic != MAGIC or not 0 < fresh <= rest <= size <= BLOCK or bits > 31 or ends[-1] > len(data) or not rest_words or not words:
            raise ValueError("no token block, or a cut one")
        out.append((size, crc, rest, _unpack(data[at:ends[0]], fresh, bits), data[ends[0]:ends[1]], data[ends[1]:ends[2]]))
        at = ends[-1]
    return out


def decode_blocks(records: list[tuple], together: int = TOGETHER) -> list[np.ndarray]:
    """The ids (unsigned 32-bit) of each record; ValueError where a checksum differs."""
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(records)
    order = sorted(range(len(records)), key=lambda i: -records[i][0])
    for i in range(0, len(order), together):
        part = [records[r] for r in order[i:i + together]]
        sizes, counts, fresh = (np.array(x) for x in zip(*((r[0], r[2], len(r[3])) for r in part)))
        by_count = np.argsort(-counts, kind="stable")
        found, seen = _rest(Reader([part[r][4] for r in by_count.tolist()]), counts[by_count], int(fresh.max()), None)
        if (seen != fresh[by_count]).any():
            raise ValueError("a token block's distinct ids differ in number")
        rest = np.zeros((len(part), int(sizes[0]) + 1), np.uint16)
        rest[by_count, :len(found)] = _turned(found)
        numbers = _turned(_decide(Reader([r[5] for r in part]), sizes, None, rest))
        for r, (size, crc, _, ids, _, _), row in zip(order[i:i + together], part, numbers):
            block = ids[np.minimum(row[:size].astype(np.int64), len(ids)) - 1]
            if zlib.crc32(block.tobytes()) != crc:
                raise ValueError("a token block's checksum differs")
            out[r] = block
    return out


def _segments(shared, id_type: pa.DataType, end_id: int):
    """Documents in order: segments of whole documents, coded some ``TOGETHER`` blocks at a time."""
    schema = pa.schema([("part", pa.int32()), ("seg", pa.int32()), ("start", pa.int64()), ("n", pa.int64()),
                        ("ids", pa.list_(id_type)), ("lengths", pa.list_(pa.int64())), ("blocks", pa.binary())])

    def run(batches):
        enc, part = bpe._encoder(shared), TaskContext.get().partitionId()
        tail = np.uint32(end_id).tobytes()
        number, start = 0, 0
        ids, lengths, held, size = [], [], [], 0  # the segment that grows
        ready, waiting = [], 0  # segments to code together

        def close():
            nonlocal ids, lengths, held, size, number, start, waiting
            flat = np.frombuffer(b"".join(held), np.uint32)
            blocks = [flat[i:i + BLOCK] for i in range(0, len(flat), BLOCK)]
            ready.append(({"part": part, "seg": number, "start": start, "n": size, "ids": ids, "lengths": lengths}, blocks))
            number, start, waiting = number + 1, start + size, waiting + len(blocks)
            ids, lengths, held, size = [], [], [], 0

        def coded():
            nonlocal waiting
            records = iter(encode_blocks([b for _, blocks in ready for b in blocks]))
            rows = [row | {"blocks": b"".join([next(records) for _ in blocks])} for row, blocks in ready]
            ready.clear()
            waiting = 0
            return pa.RecordBatch.from_pylist(rows, schema)

        for batch in batches:
            names = batch.column(0).cast(id_type)
            for i, j, offsets, data in C.slices(batch.column(1), 2 * C.CHUNK_BYTES):  # the more words together, the fewer are met anew
                for name, coded_ids in zip(names.slice(i, j - i).to_pylist(), enc.encode_slice(data.tobytes(), offsets)):
                    ids.append(name)
                    held.append(coded_ids + tail)
                    lengths.append(len(held[-1]) // 4)
                    size += lengths[-1]
                    if size >= SEGMENT:
                        close()
                        if waiting >= TOGETHER:
                            yield coded()
        if ids:
            close()
        if ready:
            yield coded()
    return run


def write_tokens(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = bpe.VOCABULARY, end_id: int = END_ID) -> None:
    """Write the ids of all texts, each closed by ``end_id``, in ascending order of the document id."""
    from pyspark.sql.pandas.types import to_arrow_type

    src = C.pick(docs, id=id_col, text=text_col)
    kind = C.column_type(src, "id")
    shared = docs.sparkSession.sparkContext.broadcast(bpe.load_vocabulary(vocabulary))
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("seg", T.IntegerType()), T.StructField("start", T.LongType()),
                           T.StructField("n", T.LongType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("lengths", T.ArrayType(T.LongType())),
                           T.StructField("blocks", T.BinaryType())])
    dealt = src.repartitionByRange("id", F.substring("text", 1, 32)).sortWithinPartitions("id", "text")
    (dealt.mapInArrow(_segments(shared, to_arrow_type(kind), end_id), schema)
     .write.option("parquet.block.size", ROW_GROUP_BYTES).option("compression", "none").parquet(path))


def _documents(keep: bool, schema: pa.Schema):
    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            i = 0
            while i < len(rows):
                part, records = [], []
                while i < len(rows) and len(records) < TOGETHER:  # some segments' blocks step together
                    part.append((rows[i], len(records)))
                    records += split_records(rows[i]["blocks"])
                    rows[i]["blocks"] = None
                    i += 1
                blocks = decode_blocks(records)
                for (row, begin), end in zip(part, [*[b for _, b in part[1:]], len(records)]):
                    flat = np.concatenate([np.zeros(0, np.uint32), *blocks[begin:end]]).astype("<u4")
                    lengths = np.array(row["lengths"], np.int64)
                    cuts = np.concatenate(([0], np.cumsum(lengths)))
                    if cuts[-1] != len(flat) or len(flat) != row["n"]:
                        raise ValueError("a segment's documents and blocks differ in length")
                    columns = [pa.array(row["ids"], schema.field("id").type), pa.array([row["part"]] * len(lengths), pa.int32()),
                               pa.array(row["start"] + cuts[:-1]), pa.array(lengths),
                               pa.array([zlib.crc32(flat[a:b].tobytes()) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())], pa.int64())]
                    if keep:
                        columns.append(pa.ListArray.from_arrays(cuts.astype(np.int32), pa.array(flat.view(np.int32))))
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)
    return run


def read_tokens(spark: SparkSession, path: str, *, id_col: str = "doc_id", keep: tuple[str, ...] = ("ids",)) -> DataFrame:
    """Per document of the files: id, start, n_tokens, ids_crc32 and, if kept, the ids; every block's checksum is tested."""
    from pyspark.sql.pandas.types import to_arrow_schema

    files = spark.read.parquet(path)
    kind = files.schema["ids"].dataType.elementType
    totals = files.groupBy("part").agg(F.sum("n").alias("ids_in_part"))
    offsets = totals.select(F.col("part").alias("of"), (F.sum("ids_in_part").over(Window.orderBy("part")) - F.col("ids_in_part")).alias("offset"))
    schema = T.StructType([T.StructField("id", kind), T.StructField("part", T.IntegerType()), T.StructField("start", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()),
                           *[T.StructField("tokens", T.ArrayType(T.IntegerType()))] * ("ids" in keep)])
    found = files.mapInArrow(_documents("ids" in keep, to_arrow_schema(schema)), schema)
    # one row of two numbers a range, at most as many as shuffle partitions: sent to all tasks, so that no range is decoded for a shuffle first
    return found.join(F.broadcast(offsets), found["part"] == offsets["of"]).select(
        F.col("id").alias(id_col), (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", *[F.col("tokens").alias("ids")] * ("ids" in keep))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    write_tokens(C.table(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path, keep=())
