"""op2, op5, op9: exact parts against brute force, learned parts by held-out quality."""

import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from barwright.llm import language, lm, quality

from .conftest import DATA, bag


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def test_base_scores_are_exact(docs, rows):
    training = docs.where(~lm.held_out())
    counts = Counter()
    for i, t in rows:
        if zlib.crc32(str("" if i is None else i).encode()) % 10:
            counts.update(tokens(t))
    total, kinds = sum(counts.values()), len(counts)
    for head in (50, 1 << 18):  # with and without words left to the join
        out = lm.score(docs, training, head_words=head).collect()
        got = sorted((repr(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out)
        want = sorted((repr(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), total,
                       round(sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in tokens(t)), 6)) for i, t in rows)
        assert got == want
        assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in out)


def test_filter_reads_back_levels(spark):
    rng = np.random.default_rng(0)
    h = np.unique(rng.integers(0, 1 << 62, 3000)) * 2
    n = rng.integers(1, 5000, len(h))
    frame = spark.createDataFrame([(int(a), int(b)) for a, b in zip(h, n)], "h long, n long")
    model = lm.build(frame, int(n.sum()), len(h), 0.2, lm.MAX_BITS)
    starts = lm.level_starts(int(n.sum()))
    want = lm.level_values(starts)[np.searchsorted(starts, n, "right")]
    assert (model.counts(h.view(np.uint64)) >= want).all()  # never less; more only by a false probe
    assert (model.counts(h.view(np.uint64)) == want).mean() > 0.98
    assert (model.counts((h + 1).view(np.uint64)) == 0).mean() > 0.98
    small = lm.build(frame, int(n.sum()), len(h), 0.2, 17)  # too small for all: the rarest stay out, the rest is right
    assert len(small.bits) == 1 << 14


def test_every_ngram_enters_a_filter_of_many_parts(spark):
    rng = np.random.default_rng(1)
    h = np.unique(rng.integers(-1 << 63, 1 << 63, 9000, np.int64))  # words and pairs
    n = rng.choice([1, 2, 40], len(h))
    frame = spark.createDataFrame([(int(a), int(b)) for a, b in zip(h, n)], "h long, n long")
    model = lm.build(frame, int(n.sum()), len(h), 0.2, 17)
    starts = lm.level_starts(int(n.sum()))
    want = lm.level_values(starts)[np.searchsorted(starts, n, "right")]
    got = model.counts(h.view(np.uint64))
    assert len(model.parts) > 2 and all(len(p.value) == 1 << 14 for p in model.parts)
    assert (got >= want).all() and (got == want).mean() > 0.95
    assert (model.counts((h ^ 1).view(np.uint64)) == 0).mean() > 0.95


def test_scores_are_alike_in_one_part_and_in_many(spark):
    texts = [" ".join(f"w{i}x{k}" for k in range(400)) for i in range(100)]  # every word and pair is seen once
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    one, many = (sorted((r["doc_id"], r["score"]) for r in lm.score(frame, frame, max_bits=b).collect()) for b in (28, 17))
    # 1/N for a word; the pair follows its word each time, the end mark's pairs aside
    total = 100 * 401
    follows = 0.2 + 0.8 / (total + 40001)
    for got in (one, many):
        assert all(abs(s / (399 * math.log10(follows)) - 1) < 0.05 for _, s in got)


def test_model_beats_the_base_on_held_out_documents(spark):
    out = lm.op2_lm_scores(spark, f"{DATA}/sf0.01").where("held_out").selectExpr("sum(score)", "sum(base_score)").first()
    assert out[0] > out[1]


def test_no_documents(nothing):
    assert lm.score(nothing, nothing).count() == 0
    model = language.train(nothing)
    assert language.identify(nothing, model).count() == 0


def test_language_on_held_out_documents(spark):
    out = language.op9_language_id(spark, f"{DATA}/sf0.01").toPandas()
    known = duckdb.sql(f"select doc_id, lang from '{DATA}/sf0.01/documents.parquet'").df()
    both = out.merge(known, on="doc_id")
    held = both[both.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.98
    assert set(out.held_out[out.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)]) == {True}
    assert out.score.between(0, 1).all()


def test_language_of_odd_rows(docs, rows):
    out = language.identify(docs, language.train(docs))
    got = {repr(r["doc_id"]) + str(r["lang_pred"]) for r in out.collect()}
    for i in (900001, 900002, 900003, 900010):
        assert f"{i}und" in got
    assert out.count() == len(rows)
    assert language.identify(docs, ([], np.zeros((0, 0)))).where("lang_pred <> 'und'").count() == 0


def test_forward_sums_every_segmentation():
    names = ["a", "b", "ab", "ba", "aba"]
    probs = np.array([0.3, 0.2, 0.25, 0.15, 0.1])[:, None]
    seg = language.Segmenter(names, probs)
    p = dict(zip(names, probs[:, 0]))

    def total(text):
        if not text:
            return 1.0
        one = sum(p[n] * total(text[len(n):]) for n in names if text.startswith(n))
        return one + language.UNKNOWN * total(text[1:])

    for text in ("a", "abab", "babab", "abxa"):
        assert seg.log_probs([text.encode()])[0, 0] == pytest.approx(math.log(total(text)), rel=1e-9)
    long = "ab" * 300
    small = seg.log_probs([("ab" * 10).encode()])[0, 0]
    assert seg.log_probs([long.encode()])[0, 0] == pytest.approx(30 * small, rel=0.05)


@pytest.mark.parametrize("char", ["é", "я", "文", "🙂", "x"])
def test_long_words_of_any_character_size_stay_finite(char):
    names = [language.P.WORD_START, char]
    seg = language.Segmenter(names, np.array([[0.5, 0.5], [1e-3, 1e-9]]))
    for other in (char, "ω", "語", "🙃"):  # learned, and in no vocabulary
        got = seg.log_probs(language.words_of(other * 3000))[0]
        each = np.log(np.array([1e-3, 1e-9]) + language.UNKNOWN) if other == char else np.log(language.UNKNOWN)
        assert got == pytest.approx(math.log(0.5 + language.UNKNOWN) + 3000 * each * np.ones(2), rel=1e-9)


def test_fit_learns_from_words_of_any_length(monkeypatch):
    names = [language.P.WORD_START, "日", "本", "日本", "本日", "語", "日本語"]
    short = language.words_of("日本語日本 本日本日日 日本語 ω語日本")
    counts = np.array([3.0, 2.0, 5.0, 1.0])
    want = language.fit(short, counts, names)
    monkeypatch.setattr(language, "SAFE_BYTES", 0)  # the path of long words
    assert language.fit(short, counts, names) == pytest.approx(want, rel=1e-9)
    monkeypatch.undo()
    got = language.fit(language.words_of("日本語" * 1000 + " " + "ω" * 900), np.ones(2), names, rounds=1)
    p = 1 / 7  # three ways to cut one 日本語, and 本語 has no piece
    ways = {"日本語": p, "日本+語": p * p, "日+本+語": p**3}
    share = {k: v / sum(ways.values()) for k, v in ways.items()}
    assert got[6] / got[5] == pytest.approx(share["日本語"] / (share["日本+語"] + share["日+本+語"]), rel=1e-3)


def test_language_written_without_spaces(spark):
    rng = np.random.default_rng(3)
    texts = [(i, "".join(rng.choice(list("日本語文字" if i % 2 else "中国汉字文"), 60)), "ja" if i % 2 else "zh") for i in range(40)]
    frame = spark.createDataFrame(texts, "doc_id bigint, text string, lang string").repartition(2)
    langs, probs = language.train(frame)
    assert langs == ["ja", "zh"] and probs.max() > 0.05  # not the even share of pieces that taught nothing
    out = language.identify(frame, (langs, probs)).join(frame, "doc_id")
    assert out.where("lang_pred = lang and score between 0.99 and 1").count() == 40


def test_quality_on_held_out_documents(spark):
    out = quality.op5_quality(spark, f"{DATA}/sf0.01").toPandas()
    labels = duckdb.sql(f"select doc_id, quality from '{DATA}/sf0.01/labels.parquet'").df()
    both = out.merge(labels, on="doc_id")
    held = both[both.held_out]
    assert len(held) and (held.predicted == held.quality).mean() > 0.95
    assert ((out.score >= 0.3).astype(int) == out.predicted).all() and out.score.between(0, 1).all()


def test_quality_of_odd_rows(spark, docs, rows, nothing):
    labels = spark.createDataFrame([(900006, 1, 0), (900009, 0, 0), (900001, 1, 0), (None, 1, 0), (900002, None, 0), (900006, 1, 1)], "doc_id bigint, quality int, toxic int")
    model = quality.train(docs, labels)
    out = quality.score(docs, model)
    assert out.count() == len(rows) and out.where("score is null or score < 0 or score > 1").count() == 0
    blank = {r["score"] for r in out.where("doc_id in (900001, 900002)").collect()}
    assert len(blank) == 1
    assert quality.accepted(docs, model).columns == docs.columns
    assert quality.accepted(docs, model).count() == out.where("predicted = 1").count()
    empty = quality.train(docs, labels.where("false"))
    assert {r["score"] for r in quality.score(docs, empty).collect()} == {0.5}
    assert quality.accepted(nothing, model).count() == 0
