"""Texts made to hurt: patterns stay linear and off the stack, words never seen share one mass."""

import time

import numpy as np

from barwright.llm import lm, pii

from .conftest import DATA


HOSTILE = [
    "mail x@" + "a." * 4000, "a." * 250_000, "x@" + "a." * 250_000, "mail " + "a.b-" * 125_000 + "@example.org", "1 " * 250_000, "1" * 500_000,
    "1-" * 250_000, "abcdef0123" * 50_000, "-eyJaaaaaaaa" * 40_000, "x@" * 250_000, "DE12" + " 1234" * 100_000, "Dr. " * 125_000,
    "password=" + "q" * 500_000, "+1 (" * 125_000, "é" * 250_000, "sk-" + "a-" * 250_000]


def test_long_runs_are_linear_and_do_not_overflow(spark):
    rows = list(enumerate([*HOSTILE, "write to ann.lee@mail.example.com. Or not"]))
    began = time.time()
    out = {r["doc_id"]: r for r in pii.replace_pii(spark.createDataFrame(rows, "doc_id int, text string").repartition(17, "doc_id")).collect()}
    assert time.time() - began < 120
    last = out[len(HOSTILE)]
    assert "ann.lee" not in last["text"] and last["n_entities"] == 1 and last["text"].endswith(". Or not")
    long = out[12]["text"]  # a keyed secret of half a million letters keeps its length and loses its letters
    assert out[12]["n_entities"] == 1 and long.startswith("password=") and len(long) == len(HOSTILE[12]) and set(long[9:]) != {"q"}


def test_addresses_of_every_shape(spark):
    found = ["a@b.co", "first.last+tag@sub.domain.example.org", "x@" + "a." * 126 + "com", "ü.ñ@exämple.de", "a@b.com.2", "A_B%c-d@x-y.info"]
    left = ["a@b", "a@b.c", "@b.com", "a@.com", "a b.com"]
    frame = spark.createDataFrame([(t, f"see {t} here") for t in found + left], "doc_id string, text string")
    out = {r["doc_id"]: (r["n_entities"], r["text"]) for r in pii.replace_pii(frame).collect()}
    assert all(out[t][0] == 1 and "@" in out[t][1] and f" {t} " not in out[t][1] for t in found)
    assert all(out[t] == (0, f"see {t} here") for t in left)
    assert out["a@b.com.2"][1].endswith(".2 here")


def test_probabilities_add_up_to_one(spark):
    rng = np.random.default_rng(3)
    h = np.unique(rng.integers(1, 2**62, 3000).astype(np.uint64) << np.uint64(1))
    n = rng.integers(1, 5, len(h))  # counts that the levels keep exactly
    frame = spark.createDataFrame(list(zip(h.view(np.int64).tolist(), n.tolist())), "h long, n long")
    model = lm.build(frame, int(n.sum()), len(h), 0.0, lm.MAX_BITS)
    seen = 10.0 ** model.log_probs(h)
    unseen = 10.0 ** model.log_probs(np.unique(rng.integers(1, 2**62, 3000).astype(np.uint64) << np.uint64(1)))
    assert np.allclose(seen.sum() + np.median(unseen) * (len(h) + 1), 1.0, atol=0.02)
    assert np.median(unseen) < seen.min()


def test_nonsense_scores_below_language(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    nonsense = spark.createDataFrame([(-1, "zzqx vvkj qqpw xjjq wwvz kkqz pqqj"), (-2, "blorf!! wug?? " * 40)], "doc_id long, text string")
    train = docs.where(~lm.held_out())
    asked = docs.where(lm.held_out()).where("length(text) > 40").select("doc_id", "text").unionByName(nonsense)
    out = {r["doc_id"]: r["score"] / r["n_tokens"] for r in lm.score(asked, train).collect()}
    worst = max(out.pop(-1), out.pop(-2))
    assert worst < np.quantile(list(out.values()), 0.02)
    assert lm.score(nonsense, train.where("false")).where("score is null or isnan(score)").count() == 0
