"""SimHash near-duplicates by a binary trie self-join.

A fingerprint has 64 bits; bit b is 1 when over half the XXH64 hashes of the
text's word shingles have it.  Documents link when fingerprints differ in at
most ``max_bits`` bits, and a group is what links reach.

The join runs over distinct fingerprints only, so copies cost nothing.  Of
``max_bits + 1`` blocks of bits at least one is equal in any linked pair, so
each fingerprint goes once to each block's subtree (five rows of 16 bytes for
four bits).  Within a subtree the trie is joined with itself: node pairs are
taken down together, the differing bits of their prefixes are added up, and a
pair is dropped once they exceed the budget.  A node is a range of the sorted
fingerprints, so a step is a handful of numpy operations over many pairs.  Node
pairs whose leaves are all in one group already are not taken further, and a
task returns a spanning forest, never all pairs.  A subtree with more than
``max_group`` fingerprints is split over several tasks (every two salts meet
in one of them).  Groups are then closed over the whole corpus by alternating
star contraction, each round written to the shared folder.

Defined cases: null or blank text has the fingerprint zero and links like any
other; a text of fewer words than a shingle is one shingle; a null id keeps its
row, and a group whose ids are all null has a null component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

SHINGLE, SEED, MAX_BITS = 4, 42, 4
MAX_GROUP = 40_000
ONE = np.uint64(1)


# -- fingerprints ---------------------------------------------------------

def _shingles(raw: bytes, size: int) -> list[bytes]:
    words = raw.lower().split()  # bytes: A-Z only, and exactly \x09-\x0D and \x20
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*[words[i:] for i in range(size)])))


def _fingerprint_rows(batches, size: int, seed: int):
    digest = xxhash.xxh64_intdigest
    for batch in batches:
        ids = batch.column(0)
        for i, j, offsets, data in C.slices(batch.column(1)):
            raw, hashes, counts = data.tobytes(), [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                found = _shingles(raw[a:b], size)
                counts.append(len(found))
                hashes.extend([digest(s, seed) for s in found])
            n = np.array(counts, np.int64)
            fps = np.zeros(j - i, np.uint64)
            some = np.flatnonzero(n)
            if len(some):
                bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                first = (np.cumsum(n) - n)[some]
                votes = np.add.reduceat(bits, first, axis=0, dtype=np.int64)
                fps[some] = np.packbits(votes * 2 > n[some, None], axis=1, bitorder="little").view(np.uint64).ravel()
            yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(fps.view(np.int64))], names=["id", "fp"])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(id, fp) for each row; fp is the 64 bits as a signed long."""
    src = C.pick(docs, id=id_col, text=text_col)
    schema = T.StructType([T.StructField("id", C.column_type(src, "id")), T.StructField("fp", T.LongType())])
    return src.mapInArrow(lambda batches: _fingerprint_rows(batches, shingle, seed), schema)


# -- trie self-join of one task's fingerprints -----------------------------

def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    while len(a):
        parent = _roots(parent)
        ra, rb = parent[a], parent[b]
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        if len(a):
            np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
    return parent


def _split(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """First position in each range whose key has the bit set (keys ascend in a range, higher bits are equal)."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        at = np.minimum(mid, len(keys) - 1)
        one = (keys[at] & bit) != 0
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)
    return lo


def _top_bit(x: np.ndarray) -> np.ndarray:
    """The highest set bit of each value (0 for 0)."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x | (x >> C.U64(s))
    return x ^ (x >> ONE)


def trie_forest(keys: np.ndarray, nodes: np.ndarray, budget: int, chunk: int = 1 << 18) -> np.ndarray:
    """Union-find parents over ``keys``; ``nodes`` are (lo, hi) of root nodes, keys ascending in each.

    Tries small budgets first: what they unite lets later passes drop whole node pairs.
    """
    parent = np.arange(len(keys))
    for allowed in sorted({min(1, budget), min(2, budget), budget}):
        stack = [(nodes[:, 0], nodes[:, 1], nodes[:, 0], nodes[:, 1])]
        while stack:
            lo1, hi1, lo2, hi2 = stack.pop()
            if len(lo1) > chunk:
                stack.append((lo1[chunk:], hi1[chunk:], lo2[chunk:], hi2[chunk:]))
                lo1, hi1, lo2, hi2 = lo1[:chunk], hi1[:chunk], lo2[:chunk], hi2[:chunk]
            parent = _roots(parent)
            change = np.concatenate(([0], np.cumsum(parent[1:] != parent[:-1])))
            one_group = ((change[hi1 - 1] == change[lo1]) & (change[hi2 - 1] == change[lo2]) & (parent[lo1] == parent[lo2]))
            go = ~one_group
            lo1, hi1, lo2, hi2 = lo1[go], hi1[go], lo2[go], hi2[go]
            if not len(lo1):
                continue
            # bits above the next branching of either node are fixed in both: their differences count now
            fork1, fork2 = _top_bit(keys[lo1] ^ keys[hi1 - 1]), _top_bit(keys[lo2] ^ keys[hi2 - 1])
            fork = np.maximum(fork1, fork2)
            below = np.where(fork > 0, (fork << ONE) - ONE, C.U64(0))
            below = np.where(fork == C.U64(1 << 63), ~C.U64(0), below)
            differ = np.bitwise_count((keys[lo1] ^ keys[lo2]) & ~below)
            ok = differ <= allowed
            leaf = ok & (fork == 0)
            if leaf.any():
                parent = _unite(parent, lo1[leaf], lo2[leaf])
            ok &= fork > 0
            lo1, hi1, lo2, hi2, fork, fork1, fork2 = (x[ok] for x in (lo1, hi1, lo2, hi2, fork, fork1, fork2))
            if not len(lo1):
                continue
            mid1 = np.where(fork1 == fork, _split(keys, lo1, hi1, fork), np.where((keys[lo1] & fork) != 0, lo1, hi1))
            mid2 = np.where(fork2 == fork, _split(keys, lo2, hi2, fork), np.where((keys[lo2] & fork) != 0, lo2, hi2))
            same = (lo1 == lo2) & (hi1 == hi2)
            parts = [(lo1, mid1, lo2, mid2), (mid1, hi1, mid2, hi2), (lo1, mid1, mid2, hi2),
                     (mid1[~same], hi1[~same], lo2[~same], mid2[~same])]
            a, b, c, d = (np.concatenate(x) for x in zip(*parts))
            full = (a < b) & (c < d)
            stack.append((a[full], b[full], c[full], d[full]))
    return _roots(parent)


def _blocks(budget: int) -> list[tuple[int, int]]:
    """(shift to the left, width) of ``budget + 1`` blocks that cover 64 bits."""
    edges = [round(64 * i / (budget + 1)) for i in range(budget + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _rotate(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    by = by.astype(np.uint64)
    return np.where(by == 0, x, (x << by) | (x >> ((C.U64(64) - by) & C.U64(63))))


def _forest_rows(batches, budget: int, shifts: np.ndarray):
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not got:
        return
    task = np.concatenate([g for g, _ in got])
    fp = np.concatenate([f for _, f in got]).view(np.uint64)
    by = shifts[task >> 60]
    keys = _rotate(fp, by)
    order = np.lexsort((keys, task))
    task, keys, fp = task[order], keys[order], fp[order]
    first = np.flatnonzero(np.concatenate(([True], task[1:] != task[:-1])))
    nodes = np.stack([first, np.append(first[1:], len(task))], 1)
    nodes = nodes[nodes[:, 1] - nodes[:, 0] > 1]
    parent = trie_forest(keys, nodes, budget)
    child = np.flatnonzero(parent != np.arange(len(parent)))
    yield pa.RecordBatch.from_arrays(
        [pa.array(fp[child].view(np.int64)), pa.array(fp[parent[child]].view(np.int64))], names=["a", "b"])


def links(fps: DataFrame, max_bits: int = MAX_BITS, max_group: int = MAX_GROUP) -> DataFrame:
    """(a, b): edges that join every two of the distinct ``fp`` values within ``max_bits``, as forests."""
    blocks = _blocks(max_bits)
    shifts = np.array([s for s, _ in blocks], np.int64)
    tops = F.array(*[
        F.struct(F.lit(i).cast("long").alias("r"),
                 F.shiftrightunsigned(F.shiftleft("fp", s) if s else F.col("fp"), 64 - w).alias("top"))
        for i, (s, w) in enumerate(blocks)])
    keyed = fps.select("fp", F.explode(tops).alias("k")).select("fp", "k.r", "k.top")
    large = (keyed.groupBy("r", "top").count().where(F.col("count") > max_group)
             .select("r", "top", F.ceil(F.col("count") / max_group).cast("long").alias("m")))
    m = F.coalesce("m", F.lit(1).cast("long"))
    salted = keyed.join(large, ["r", "top"], "left").select(
        "fp", "r", "top", m.alias("m"), F.pmod(F.xxhash64("fp"), m).alias("salt"))
    paired = salted.select("fp", "r", "top", "salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("other"))
    # a task: block (4 bits), its value (16..), and the two salts that meet
    task = (F.shiftleft("r", 60) + F.shiftleft("top", 40)
            + F.shiftleft(F.least("salt", "other"), 20) + F.greatest("salt", "other"))
    dealt = paired.select(task.alias("task"), "fp").repartition("task")
    return dealt.mapInArrow(lambda batches: _forest_rows(batches, max_bits, shifts), "a long, b long")


# -- groups ----------------------------------------------------------------

def star_groups(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the least node that edges (a, b) reach, for nodes that have edges.

    Alternating large-star and small-star contraction; the minimum of a node's
    neighbours is a partial aggregate, so a node with very many edges is no hot key.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = C.written(e, "edges")
    print_of = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = print_of(e)
    if not before[0]:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        e = C.written(small, "edges")
        now = print_of(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("star contraction did not settle")
    return e.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node").unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def simhash_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                   max_bits: int = MAX_BITS, seed: int = SEED, max_group: int = MAX_GROUP) -> DataFrame:
    """(id_col, fp, component_id) for each row of ``docs``."""
    rows = C.written(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle, seed=seed), "fingerprints")
    classes = C.written(rows.groupBy("fp").agg(F.min("id").alias("least")), "fingerprint-classes")
    groups = star_groups(links(classes.select("fp"), max_bits, max_group))
    linked = classes.join(groups, classes["fp"] == groups["node"]).select("fp", "least", "root")
    tops = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    found = linked.join(tops, "root").select("fp", "component_id")
    whole = classes.join(found, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return rows.join(whole, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each group: that of the least id, ids that are null last; of equal rows, one."""
    order = F.coalesce(F.lpad((docs[id_col].cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")).cast("string"), 21, "0"), F.lit("~"))
    key = F.concat_ws(":", order, C.row_key(docs[id_col], docs[text_col]))
    keyed = docs.select(key.alias("row_key"), docs[text_col].alias("text"))
    groups = simhash_groups(keyed, id_col="row_key", **options)
    first = C.written(groups.where("row_key = component_id").groupBy(F.col("row_key").alias("first_key")).agg(F.count("*").alias("copies")), "group-firsts")
    alone = docs.join(first.where("copies = 1"), key == first["first_key"], "left_semi")
    again = docs.join(first.where("copies > 1"), key == first["first_key"], "inner")
    return alone.unionByName(again.dropDuplicates(["first_key"]).select(*docs.columns)) if first.where("copies > 1").limit(1).count() else alone


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_groups(C.table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
