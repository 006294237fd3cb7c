"""Token counts by a count-only Viterbi over a unigram vocabulary.

Aho-Corasick enumerates the vocabulary pieces that end at each byte; dynamic
programming carries only the best score and the number of pieces of the best
path to each byte, never the path.  Ties are settled as in the tokenizers
library's Unigram model: candidates for a position are tried from the earliest
start on and replace the best only when strictly better; an unknown character
(one that is no piece by itself) scores the least piece score less 10 and, with
byte pieces in the vocabulary, counts as its bytes, else a run of unknown
characters counts as one piece.

Words are split at spaces, each with the word-start mark before it.  Equal
words are counted once per worker (a bounded cache).  Defined cases: null or
empty text has no tokens; runs of spaces give words that are the mark alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from . import pieces as P

CACHE_WORDS = 400_000
UNKNOWN_PENALTY = 10.0
MARK = P.WORD_START.encode()


class Counter:
    def __init__(self, pieces: list[str], scores: list[float], byte_pieces: bool):
        self.auto = P.Automaton(pieces)
        self.scores = np.array(scores, np.float64)
        self.unknown = float(self.scores.min()) - UNKNOWN_PENALTY
        self.byte_pieces = byte_pieces
        self.cache: dict[bytes, int] = {}

    def count_rows(self, words: list[bytes]) -> np.ndarray:
        rows_, sizes = P.padded(words)
        ends = P.char_ends(rows_, sizes)
        n, most = rows_.shape
        best = np.full((n, most + 1), -np.inf)
        best[:, 0] = 0.0
        count = np.zeros((n, most + 1), np.int64)
        last_unknown = np.zeros((n, most + 1), bool)
        for i, rows, found in self.auto.ends(rows_, sizes):
            single = np.zeros(n, bool)
            for r, p in found:
                begin = i + 1 - self.auto.size[p]
                cand = best[r, begin] + self.scores[p]
                better = cand > best[r, i + 1]
                w = r[better]
                best[w, i + 1] = cand[better]
                count[w, i + 1] = count[w, begin[better]] + 1
                single[r[self.auto.size[p] == ends[r, i]]] = True
            r = rows[(ends[rows, i] > 0) & ~single[rows]]
            if len(r):
                begin = i + 1 - ends[r, i]
                cand = best[r, begin] + self.unknown
                better = cand > best[r, i + 1]
                w, begin = r[better], begin[better]
                best[w, i + 1] = cand[better]
                cost = ends[w, i] if self.byte_pieces else np.where(last_unknown[w, begin], 0, 1)
                count[w, i + 1] = count[w, begin] + cost
                last_unknown[w, i + 1] = True
        return count[np.arange(n), sizes]

    def counts(self, words: list[bytes]) -> list[int]:
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        for group in P.by_size(list(set(words).difference(self.cache))):
            self.cache.update(zip(group, self.count_rows(group).tolist()))
        return list(map(self.cache.__getitem__, words))


_COUNTERS: dict[int, Counter] = {}


def _counter(shared) -> Counter:
    key = id(shared.value)
    if key not in _COUNTERS:
        _COUNTERS.clear()
        pieces, scores = shared.value
        _COUNTERS[key] = Counter(pieces, scores, byte_pieces="<0x00>" in pieces)
    return _COUNTERS[key]


def split_words(text: bytes) -> list[bytes]:
    """Words with the mark that stands for the space before them (also before the first)."""
    if not text:
        return []
    whole = text.replace(b" ", MARK)
    return [MARK + w for w in (whole if whole.startswith(MARK) else MARK + whole).split(MARK)[1:]]


def _rows(batches, shared, id_type):
    counter = _counter(shared)
    for batch in batches:
        for i, j, offsets, data in C.slices(batch.column(1)):
            raw = data.tobytes()
            words = [split_words(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            flat = np.array(counter.counts([w for x in words for w in x]), np.int64)
            ends = np.cumsum([0, *map(len, words)])
            total = np.concatenate(([0], np.cumsum(flat)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i).cast(id_type), pa.array(np.diff(ends)), pa.array(np.diff(total[ends]))],
                names=["id", "n_words", "n_tokens"])


def token_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = P.PIECES) -> DataFrame:
    """Per row: id, n_words, n_tokens of the whole text."""
    from pyspark.sql.pandas.types import to_arrow_type

    src = C.pick(docs, id=id_col, text=text_col)
    shared = docs.sparkSession.sparkContext.broadcast(P.load_pieces(vocabulary))
    kind = C.column_type(src, "id")
    schema = T.StructType([T.StructField("id", kind), T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])
    id_type = to_arrow_type(kind)
    return src.mapInArrow(lambda b: _rows(b, shared, id_type), schema).withColumnRenamed("id", id_col)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(C.table(spark, sf_dir, "documents"))
