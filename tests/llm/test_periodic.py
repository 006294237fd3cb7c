"""op11 against brute force: every lag compared word by word, the planting redone in Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from .conftest import bag

from barwright.llm import periodic

COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def brute_runs(words, least=6, times=4):
    """Every maximal stretch of equal words at every distance whose smallest period it is."""
    n, out = len(words), []
    for q in range(1, n):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            stretch = words[start:i + q]
            if len(stretch) >= max(least, times * q) and not any(stretch[d:] == stretch[:-d] for d in range(1, q)):
                out.append((start, len(stretch), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text, plant=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if plant and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in dropped).encode()).hexdigest())


def test_runs_are_brute_force():
    rng = random.Random(11)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(0, 4)):
            words = []
            while len(words) < rng.randint(0, 90):
                root = [rng.randint(0, 2) for _ in range(rng.randint(1, 9))]
                words += (root * rng.randint(1, 7))[:rng.randint(1, 60)]
            texts.append(words)
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        for least, times in ((6, 4), (20, 3), (2, 6)):
            found = periodic.find_runs(np.array(sum(texts, []), np.int64), offsets, least, times)
            assert found == [brute_runs(t, least, times) for t in texts]


def test_seeds_that_do_not_match_are_no_runs(monkeypatch):
    """Hashes that always agree: every seed is compared, none makes a run."""
    monkeypatch.setattr(periodic, "gram_keys", lambda words, k, doubled: np.zeros(max(0, len(words) - k + 1), np.uint64))
    assert periodic.find_runs(np.arange(100), np.array([0, 100])) == [[]]


def test_one_word_repeated_many_times_is_linear():
    words = np.zeros(300_000, np.int64)
    assert periodic.find_runs(words, np.array([0, len(words)])) == [[(0, 300_000, 1)]]
    words = np.arange(60_000) % 15_000
    assert periodic.find_runs(words, np.array([0, len(words)])) == [[(0, 60_000, 15_000)]]


def test_operator_is_brute_force_with_odd_rows(spark, docs):
    odd = spark.createDataFrame([(900100, "a b " * 9 + "c"), (900101, "x " * 6), (900101, "x " * 6), (900102, "x " * 5), (900103, "é ü " * 4),
                                 (900104, "no break space " * 7)], "doc_id bigint, text string")
    both = docs.select("doc_id", "text").unionByName(odd)
    rows = [tuple(r) for r in both.collect()]
    out = periodic.periodic_runs(both)
    assert bag(out, *COLUMNS[:5], *COLUMNS[6:]) == sorted(repr(r[:5] + r[6:]) for r in (brute_row(i, t, plant=False) for i, t in rows))
    long = out.where("doc_id = 900100").first()
    assert [tuple(r) for r in long["runs"]] == [(0, 18, 2)] and long["collapsed"] == "a b c"
    clash = docs.withColumnsRenamed({"fp": "runs"})
    assert periodic.periodic_runs(clash, keep=()).count() == docs.count()


def test_query_is_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    out = periodic.op11_periodic_runs(spark, sf)
    assert bag(out, *COLUMNS) == sorted(repr(brute_row(i, t)) for i, t in rows)
    assert out.where("n_runs > 0").count() > 10


def test_planting_of_odd_rows(spark):
    ids = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 10 == 0][:40]
    rows = [(i, t) for i in ids for t in (None, "", " \n", "one", "a b", "  lead and trail \t", "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13")]
    rows += [(None, "a b c"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = periodic.periodic_runs(df.select("doc_id", periodic.planted(df.doc_id, df.text).alias("text")), keep=())
    assert bag(out, *COLUMNS[:5], *COLUMNS[6:]) == sorted(repr(r[:5] + r[6:]) for r in (brute_row(i, t) for i, t in rows))


def test_no_rows_and_bad_parameters(nothing):
    assert periodic.periodic_runs(nothing).count() == 0
    with pytest.raises(ValueError, match="three periods"):
        periodic.periodic_runs(nothing, times=2)
