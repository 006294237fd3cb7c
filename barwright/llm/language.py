"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of one fixed public
vocabulary.  A word's probability is the sum over all ways to cut it into
pieces, by the forward algorithm over the matches that an Aho-Corasick
automaton enumerates; a text's is the product over its words.  Piece
probabilities are fitted by expectation maximisation over all segmentations
(forward and backward), one language per task.

Fitting uses a bounded sample: per language about ``sample_docs`` documents
(each kept by a hash of its id, the share set from the language's exact
count), with all their words; everything else
covers all rows.  Characters outside the vocabulary get a fixed small
probability in every language.

Defined cases: null text or text without a letter is ``und`` with score 0;
equal scores go to the smallest language name; documents of null language
teach nothing; with no learned language every text is ``und``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from . import pieces as P

SAMPLE_DOCS = 800
ROUNDS = 3
UNKNOWN = 1e-7
SMOOTH = 0.01
CACHE_WORDS = 300_000
SAFE_BYTES = 40  # products over longer words could underflow, so these are rescaled on the way
LOW, LIFT = 1e-120, 1e100  # at a character's end, sums under LOW are multiplied by LIFT
MARK = P.WORD_START.encode()


def words_of(text: str) -> list[bytes]:
    return [MARK + w for w in text.lower().encode().split()]


class Segmenter:
    """Forward sums of words under several languages at once (probs: pieces x languages)."""

    def __init__(self, pieces: list[str], probs: np.ndarray):
        self.auto = P.Automaton(pieces)
        self.probs = probs
        self.cache: dict[bytes, int] = {}
        self.logs = np.zeros((0, probs.shape[1]))

    def forward(self, words: list[bytes]) -> np.ndarray:
        rows_, sizes = P.padded(words)
        ends = P.char_ends(rows_, sizes)
        n, most = rows_.shape
        k = self.probs.shape[1]
        alpha = np.zeros((most + 1, n, k))
        alpha[0] = 1.0
        lifts = np.zeros((n, k))
        reach = max(4, int(self.auto.size.max()))  # no piece or character is longer, so sums further back are not read again
        for i, rows, found in self.auto.ends(rows_, sizes):
            here = alpha[i + 1]
            for r, p in found:
                here[r] += alpha[i + 1 - self.auto.size[p], r] * self.probs[p]
            r = rows[ends[rows, i] > 0]
            here[r] += alpha[i + 1 - ends[r, i], r] * UNKNOWN
            if most > SAFE_BYTES:
                low, lang = np.nonzero(here[r] < LOW)  # each language by itself: one may be far below another
                if len(low):
                    low = r[low]
                    alpha[max(0, i + 1 - reach):i + 2, low, lang] *= LIFT
                    lifts[low, lang] += 1
        return np.log(alpha[sizes, np.arange(n)]) - lifts * np.log(LIFT)

    def log_probs(self, words: list[bytes]) -> np.ndarray:
        """One row of log probabilities for each word."""
        if len(self.cache) > CACHE_WORDS:
            self.cache, self.logs = {}, self.logs[:0]
        missing = list(set(words).difference(self.cache))
        fresh = [self.logs]
        for group in P.by_size(missing, cells=1 << 17):
            base = len(self.cache)
            self.cache.update(zip(group, range(base, base + len(group))))
            fresh.append(self.forward(group))
        if len(fresh) > 1:
            self.logs = np.concatenate(fresh)
        return self.logs[list(map(self.cache.__getitem__, words))] if words else self.logs[:0]


def fit(words: list[bytes], counts: np.ndarray, pieces: list[str], rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities of one language by EM over all segmentations of its words."""
    auto = P.Automaton(pieces)
    probs = np.full(len(pieces), 1.0 / len(pieces))
    weight = dict(zip(words, counts.tolist()))
    reach = max(4, int(auto.size.max()))
    for _ in range(rounds):
        expected = np.zeros(len(pieces))
        for group in P.by_size(words, cells=1 << 18):
            rows_, sizes = P.padded(group)
            ends = P.char_ends(rows_, sizes)
            n, most = rows_.shape
            alpha = np.zeros((most + 1, n))
            alpha[0] = 1.0
            long = most > SAFE_BYTES
            lifts, lifted = np.zeros(n), np.zeros((most + 1, n) if long else (0, n))  # so often a row's and each sum's LIFT was applied
            matches: list[list] = []
            for i, rows, found in auto.ends(rows_, sizes):
                kept = []
                for r, p in found:
                    alpha[i + 1, r] += alpha[i + 1 - auto.size[p], r] * probs[p]
                    kept.append((r, p))
                r = rows[ends[rows, i] > 0]
                alpha[i + 1, r] += alpha[i + 1 - ends[r, i], r] * UNKNOWN
                matches.append(kept)
                if long:
                    lifted[i + 1] = lifts
                    low, near = r[alpha[i + 1, r] < LOW], slice(max(0, i + 1 - reach), i + 2)
                    alpha[near, low] *= LIFT
                    lifted[near, low] += 1
                    lifts[low] += 1
            total = alpha[sizes, np.arange(n)]
            beta = np.zeros((most + 1, n))
            beta[sizes, np.arange(n)] = 1.0
            share = np.array([weight[w] for w in group]) / total
            back = np.zeros(n)  # so often LIFT was applied to a row's beta
            for i in range(most - 1, -1, -1):
                if long:
                    low = np.flatnonzero((beta[i + 1] < LOW) & (beta[i + 1] > 0))
                    beta[max(0, i + 1 - reach):i + 2, low] *= LIFT
                    back[low] += 1
                for r, p in matches[i]:
                    begin = i + 1 - auto.size[p]
                    flow = probs[p] * beta[i + 1, r]
                    beta[begin, r] += flow
                    if long:
                        with np.errstate(divide="ignore"):  # the logarithm of no way is -inf
                            ways = np.log(alpha[begin, r]) + np.log(flow) - np.log(total[r])
                        ways += (lifts[r] - lifted[begin, r] - back[r]) * np.log(LIFT)
                        np.add.at(expected, p, np.exp(ways) * share[r] * total[r])
                    else:
                        np.add.at(expected, p, alpha[begin, r] * flow * share[r])
                r = np.flatnonzero(ends[:, i] > 0)
                beta[i + 1 - ends[r, i], r] += beta[i + 1, r] * UNKNOWN
        probs = (expected + SMOOTH) / (expected.sum() + SMOOTH * len(pieces))
    return probs


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          vocabulary: str = P.PIECES, sample_docs: int = SAMPLE_DOCS) -> tuple[list[str], np.ndarray]:
    """(languages in order, probabilities pieces x languages) from rows with a language."""
    src = C.pick(docs, id=id_col, text=text_col, lang=lang_col).where("lang is not null")
    sizes = {r["lang"]: r["n"] for r in src.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return [], np.zeros((0, 0))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample_docs / n))])
    draw = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    sample = src.where(draw < share[F.col("lang")])
    pieces, _ = P.load_pieces(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def word_counts(batches):
        for batch in batches:
            for frame in (batch,):
                found: dict[tuple[str, bytes], int] = {}
                for lang, text in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist()):
                    for w in words_of(text or ""):
                        found[lang, w] = found.get((lang, w), 0) + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in found], pa.string()), pa.array([w for _, w in found], pa.binary()), pa.array(list(found.values()), pa.int64())],
                    names=["lang", "word", "n"])

    counts = (sample.select("lang", "text").mapInArrow(word_counts, "lang string, word binary, n long")
              .groupBy("lang", "word").agg(F.sum("n").alias("n")))

    def fit_group(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n", "word"], ascending=[False, True])
        probs = fit([bytes(w) for w in frame["word"]], frame["n"].to_numpy(np.float64), shared.value)
        return pd.DataFrame({"lang": [frame["lang"].iloc[0]], "probs": [probs.astype(np.float64).tobytes()]})

    fitted = {r["lang"]: np.frombuffer(r["probs"], np.float64) for r in
              counts.groupBy("lang").applyInPandas(fit_group, "lang string, probs binary").collect()}
    langs = sorted(fitted)
    return langs, (np.stack([fitted[x] for x in langs], 1) if langs else np.zeros((len(pieces), 0)))


_SEGMENTERS: dict[int, Segmenter] = {}


def _rows(batches, shared, id_type):
    pieces, langs, probs = shared.value
    key = id(shared.value)
    if key not in _SEGMENTERS:
        _SEGMENTERS.clear()
        _SEGMENTERS[key] = Segmenter(pieces, probs) if langs else None
    seg = _SEGMENTERS[key]
    for batch in batches:
        for i, j, offsets, data in C.slices(batch.column(1)):
            raw = data.tobytes()
            texts = [raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            spoken = np.array([any(map(str.isalpha, t)) for t in texts], bool)
            pred, score = ["und"] * len(texts), np.zeros(len(texts))
            if langs and spoken.any():
                which = np.flatnonzero(spoken)
                words = [words_of(texts[w]) for w in which.tolist()]
                n = np.array([len(w) for w in words])
                logs = seg.log_probs([w for x in words for w in x])
                total = np.add.reduceat(logs, np.cumsum(n) - n, axis=0)
                best = total.argmax(axis=1)
                for w, b in zip(which.tolist(), best.tolist()):
                    pred[w] = langs[b]
                score[which] = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i).cast(id_type), pa.array(pred, pa.string()), pa.array(score)],
                names=["id", "lang_pred", "score"])


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], *, id_col: str = "doc_id", text_col: str = "text",
             vocabulary: str = P.PIECES) -> DataFrame:
    """Per row: id, lang_pred and score, the prediction's share of the total likelihood."""
    from pyspark.sql.pandas.types import to_arrow_type

    src = C.pick(docs, id=id_col, text=text_col)
    shared = docs.sparkSession.sparkContext.broadcast((P.load_pieces(vocabulary)[0], *model))
    kind = C.column_type(src, "id")
    schema = T.StructType([T.StructField("id", kind), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    id_type = to_arrow_type(kind)
    return src.mapInArrow(lambda b: _rows(b, shared, id_type), schema).withColumnRenamed("id", id_col)


def _held_out():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    model = train(docs.where(~_held_out()))
    return identify(docs, model).select("doc_id", _held_out().alias("held_out"), "lang_pred", "score")
