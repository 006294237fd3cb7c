"""op1, op3, op6, op7 against brute force, with odd rows, clashing columns and empty tables."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import xxhash
from .conftest import bag
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from barwright.llm import bpe, decontaminate, pieces, simhash, token_counts

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def brute_decontamination(rows, items, window=10):
    found = []
    for doc_id, text in rows:
        w, hit, ids = WORDS.findall(lowered(text)), set(), set()
        for item, passage in items:
            p = WORDS.findall(lowered(passage))
            n = min(len(p), window)
            windows = {tuple(p[i:i + n]) for i in range(len(p) - n + 1)} if p else set()
            for i in range(len(w) - n + 1) if n else ():
                if tuple(w[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    ids.add(str(item))
        found.append((doc_id, len(w), len(hit), sorted(ids), bool(hit)))
    return sorted(map(repr, found))


def test_decontaminate_is_brute_force(spark, docs, rows):
    source = next(t for i, t in rows if t and len(t) > 1500 and i is not None and i < 900000)
    some = WORDS.findall(lowered(source))
    items = [(1, " ".join(some[5:30]).upper()), (2, "; ".join(some[20:29])), (3, some[40]), (4, " ".join(some[50:60])), (5, None), (6, "..."),
             (7, " ".join(some[5:30])), (8, "same text here now"), (9, "same text here now and then but never these words at all")]
    bench = spark.createDataFrame(items, "item_id int, text string").withColumn("fp", F.lit(1))
    out = decontaminate.decontaminate(docs, bench)
    assert bag(out, "doc_id", "n_words", "n_hit", "items", "contaminated") == brute_decontamination(rows, items)
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns
    assert kept.count() == out.where("not contaminated").count()


def test_decontaminate_without_rows(spark, docs, nothing, rows):
    none = spark.createDataFrame([], "item_id int, text string")
    assert decontaminate.decontaminate(docs, none).where("contaminated or n_hit > 0").count() == 0
    assert decontaminate.decontaminate(docs, none).count() == len(rows)
    assert decontaminate.decontaminate(nothing, none).count() == 0


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, most):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= most:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash_groups_are_brute_force(docs, rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    least = defaultdict(lambda: None)
    tops = components(fps, 4)
    for (i, _), top in zip(rows, tops):
        if i is not None and (least[top] is None or i < least[top]):
            least[top] = i
    want = sorted(repr((i, f - (1 << 64) if f >> 63 else f, least[top])) for (i, _), f, top in zip(rows, fps, tops))
    assert bag(simhash.simhash_groups(docs), "doc_id", "fp", "component_id") == want
    # split groups give the same
    assert bag(simhash.simhash_groups(docs, max_group=3), "doc_id", "fp", "component_id") == want


def test_trie_forest_finds_every_link():
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    keys = np.unique(np.concatenate([centres, *[centres ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (int(n), 12), dtype=np.uint64), axis=0)
                                                for n in (1, 2, 2, 3, 3, 4, 5, 6)]]))
    for budget in (0, 1, 3, 4, 7):
        parent = simhash.trie_forest(keys, np.array([[0, len(keys)]]), budget)
        assert parent.tolist() == components([int(k) for k in keys], budget)


def test_keep_first_takes_one_row_of_each_group(docs, nothing):
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    ids = [r[0] for r in kept.select("doc_id").collect()]
    assert ids.count(900004) == 1 and 900006 in ids and 900007 not in ids
    assert None not in ids or ids.count(None) == 1  # the text without an id stands alone; null text is of the blank group
    assert simhash.keep_first(nothing).count() == 0


def test_bpe_matches_the_library(docs, rows, nothing):
    library = Tokenizer.from_file(bpe.VOCABULARY)
    special = [(1, "a <|endoftext|> b<|endoftext|>"), (2, "'s'll don't 's  x\n\n y \t"), (3, "ab" * 500), (4, "   x\u0085")]
    more = docs.sparkSession.createDataFrame(special, "doc_id bigint, text string")
    out = bpe.bpe(docs.select("doc_id", "text").unionByName(more))
    want = []
    for i, t in [*rows, *special]:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), ids, text))
    assert bag(out, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded") == sorted(map(repr, want))
    assert bpe.bpe(nothing).count() == 0


def test_token_counts_match_the_library(docs, rows, nothing):
    names, scores = pieces.load_pieces()
    library = Tokenizer(models.Unigram(list(zip(names, scores)), 0, True))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    want = sorted(repr((i, len(library.encode(t or "", add_special_tokens=False).ids))) for i, t in rows)
    assert bag(token_counts.token_counts(docs), "doc_id", "n_tokens") == want
    assert token_counts.token_counts(nothing).count() == 0


def test_token_counts_settle_ties_like_the_library():
    vocabulary = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0), ("ba", -2.0), ("aba", -3.0), ("é", -9.0)]
    library = Tokenizer(models.Unigram(vocabulary, 0, False))
    counter = token_counts.Counter([p for p, _ in vocabulary], [s for _, s in vocabulary], False)
    for text in ("▁ababab", "▁aab", "▁bbaba", "▁xxaxé", "▁", "▁xyzab"):
        assert counter.counts([text.encode()]) == [len(library.encode(text).ids)], text
