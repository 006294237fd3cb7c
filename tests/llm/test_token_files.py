"""op13 against the tokenizers library, exact round trips, and damaged blocks."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barwright.llm import bpe
from barwright.llm import token_files as K


def round_trip(blocks, together=K.TOGETHER):
    records = K.encode_blocks(blocks, together)
    back = K.decode_blocks([r for x in records for r in K.split_records(x)], together)
    assert len(back) == len(blocks) and all((a == b).all() and len(a) == len(b) for a, b in zip(blocks, back))
    return records


def test_blocks_of_every_kind_come_back():
    rng = np.random.default_rng(13)
    blocks = [rng.integers(0, 50257, n).astype(np.uint32) for n in (1, 2, 3, 100, K.BLOCK, K.BLOCK)]
    blocks += [rng.zipf(1.3, 3000).clip(0, 50000).astype(np.uint32), np.zeros(K.BLOCK, np.uint32), np.arange(K.BLOCK, dtype=np.uint32),
               np.tile(np.arange(7, dtype=np.uint32), 300), np.array([2**31 - 1, 0, 5, 2**31 - 1], np.uint32), np.array([0], np.uint32)]
    whole = round_trip(blocks)
    assert whole == round_trip(blocks, 2)  # a block's record does not depend on what it steps with
    assert len(whole[7]) < 100 and len(whole[9]) < 300  # what repeats costs next to nothing
    assert round_trip([]) == []


def test_many_random_blocks_come_back():
    rng = np.random.default_rng(7)
    for _ in range(6):
        most = int(rng.choice([2, 5, 300, 60_000]))
        round_trip([rng.integers(0, most, int(n)).astype(np.uint32) for n in rng.integers(1, 700, 60)])


def test_damage_is_found():
    block = np.random.default_rng(1).integers(0, 900, 500).astype(np.uint32)
    record = K.encode_blocks([block])[0]
    for at in (K.HEADER.size + 3, K.HEADER.size + 40, 17, len(record) - 9):
        bad = bytearray(record)
        bad[at] ^= 0x20
        with pytest.raises(ValueError):
            K.decode_blocks(K.split_records(bytes(bad)))
    for cut in (record[:10], record[:-4], b"XXXX" + record[4:]):
        with pytest.raises(ValueError):
            K.split_records(cut)


def brute(rows):
    tokenizer = Tokenizer.from_file(bpe.VOCABULARY)
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def order(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])


def test_files_are_the_library_ids(spark, docs, rows, tmp_path):
    odd = spark.createDataFrame([(900200, "<|endoftext|> inside"), (900201, "x" * 30_000)], "doc_id bigint, text string")
    both = docs.unionByName(odd, allowMissingColumns=True)
    given = [*rows, (900200, "<|endoftext|> inside"), (900201, "x" * 30_000)]
    K.write_tokens(both.withColumns({"part": F.lit(9), "blocks": F.lit("clash")}), str(tmp_path / "a"))
    out = K.read_tokens(spark, str(tmp_path / "a"))
    assert order(out) == brute(given)
    tokenizer = Tokenizer.from_file(bpe.VOCABULARY)
    ids = {r["doc_id"]: r["ids"] for r in out.collect()}
    assert ids[900005] == [*tokenizer.encode(dict(given)[900005], add_special_tokens=False).ids, 2]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        K.write_tokens(both, str(tmp_path / "b"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.read.parquet(str(tmp_path / "b")).select("part").distinct().count() > 1
    assert order(K.read_tokens(spark, str(tmp_path / "b"))) == brute(given)


def test_query_is_the_library_ids(spark, sf):
    given = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert order(K.op13_token_files(spark, sf)) == brute(given)


def test_small_segments_and_no_rows(spark, docs, rows, nothing, tmp_path, monkeypatch):
    K.write_tokens(nothing, str(tmp_path / "none"))
    assert K.read_tokens(spark, str(tmp_path / "none")).count() == 0
    K.write_tokens(docs, str(tmp_path / "ends"), end_id=50256)
    assert K.read_tokens(spark, str(tmp_path / "ends")).where("ids[n_tokens - 1] != 50256").count() == 0


def test_words_of_a_slice_are_coded_together():
    """Ids come end to end, with the words met before and those met anew in one slice; pairs lie in a hash table."""
    rng = np.random.default_rng(5)
    texts = ["", "it's <|endoftext|>", "a" * 255, "b" * 256 + " " + "ab" * 200, "naïve 文字 🙂", " \n\t x"]
    texts += ["".join(rng.choice(list("aehinorst "), int(n))) for n in rng.integers(1, 900, 40)]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    encoder, tokenizer = bpe.Encoder(bpe.load_vocabulary()), Tokenizer.from_file(bpe.VOCABULARY)
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        ids, counts = encoder.encode_flat(b"".join(raw), offsets)
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_every_stream_has_its_part():
    """Repeats are left to the orders 2 and 1, the ids that order 0 codes and the distinct ids are streams of their own."""
    block = np.tile(np.arange(1, 8, dtype=np.uint32), 500)
    (size, _, rest, distinct, _, _), = K.split_records(round_trip([block])[0])
    assert size == len(block) and distinct.tolist() == list(range(1, 8)) and rest < 30
    mixed = np.random.default_rng(3).integers(0, 50, K.BLOCK).astype(np.uint32)
    assert len(round_trip([mixed])[0]) * 8 < 6.6 * K.BLOCK  # log2(50) is 5.64
    words = np.random.default_rng(4).integers(0, 9, (300, 3))  # triples of dependent ids: 3.2 bits each
    depend = np.stack([words[:, 0] * 3, words[:, 0] * 3 + 1, words[:, 0] * 3 + 2], 1).ravel().astype(np.uint32)
    assert len(round_trip([depend])[0]) * 8 < 2.5 * len(depend)
