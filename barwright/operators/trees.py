"""Decision trees and random forests, one per symbol, grown for all symbols at once.

Every feature is cut into at most ``max_bins`` bins at a symbol's own quantiles
(all its values where there are no more).  A level of all trees of all symbols is one
job:

1. rows lie by (symbol, salt), so a symbol of any size is spread over tasks; the
   symbol's tree so far is sent to each of its salts and streams in before its rows;
2. a task walks its rows down the tree and counts classes per (tree, node,
   feature, bin): one histogram row per node and task leaves it, not the rows;
3. histograms of a node are summed, and the cut of least Gini impurity is taken:
   at least ``min_split`` rows in the node, ``min_leaf`` on each side, equal cuts
   to the first feature and the lowest bin.

No group of rows is held in memory, and nothing but the count of new splits reaches the driver.  A
forest adds a tree number to the keys: each tree weighs rows by a Poisson(1) draw and
each node looks at sqrt(features) of them, both from seeded hashes of the row, so that a lost task
gives the same again.

Trees are tables: symbol, tree, node (children of n are 2n+1 and 2n+2), class counts, and the cut.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT, MLParams
from ..functions.materialize import materialize
from ..functions.windows import SYMBOL, TS
from .features import feature_columns

ROWS_PER_SALT = 50_000
MAX_BINS = 64
HELD_BYTES = 64 << 20

NODES = T.StructType([
    T.StructField(SYMBOL, T.StringType()), T.StructField("tree", T.IntegerType()), T.StructField("node", T.LongType()),
    T.StructField("n0", T.DoubleType()), T.StructField("n1", T.DoubleType()), T.StructField("feature", T.IntegerType()),
    T.StructField("bin", T.IntegerType()), T.StructField("decrease", T.DoubleType())])
_ARROW_NODES = pa.schema([(SYMBOL, pa.string()), ("tree", pa.int32()), ("node", pa.int64()), ("n0", pa.float64()), ("n1", pa.float64()),
                          ("feature", pa.int32()), ("bin", pa.int32()), ("decrease", pa.float64())])


def _mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, for draws that a row or node always repeats."""
    h = np.atleast_1d(np.asarray(h, np.uint64))  # arrays wrap around without a warning
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


def draws(keys: np.ndarray, tree: int, forest: bool) -> np.ndarray:
    """How often each row counts in a tree: once, or a Poisson(1) draw of the row and the tree."""
    if not forest:
        return np.ones(len(keys))
    uniform = (_mix(keys.view(np.uint64) ^ _mix(np.uint64(tree + 1))) >> np.uint64(11)) * 2.0**-53
    return np.searchsorted(_POISSON, uniform, "right").astype(float)


def candidates(symbol: str, tree: int, node: int, count: int, take: int) -> np.ndarray:
    """The features that a node looks at: all, or ``take`` of them by a hash of symbol, tree and node; ascending."""
    if take >= count:
        return np.arange(count)
    seed = _mix(np.uint64((sum(b * 257**i for i, b in enumerate(symbol.encode())) * 1_000_003 + tree * 8191 + node) & (2**64 - 1)))
    return np.sort(np.argsort(_mix(seed ^ np.arange(1, count + 1).astype(np.uint64)), kind="stable")[:take])


def edges(train: DataFrame, features: list[str], max_bins: int = MAX_BINS) -> DataFrame:
    """(symbol, edges): for each feature, in order, the ascending values at which it may be cut (x <= edge)."""
    long_ = train.select(SYMBOL, F.posexplode(F.array(*[F.col(c).cast("double") for c in features])).alias("f", "v"))
    steps = [k / max_bins for k in range(1, max_bins)]
    cut = long_.groupBy(SYMBOL, "f").agg(
        F.percentile_approx("v", steps, 100 * max_bins).alias("q"), F.max("v").alias("top"))
    ordered = cut.select(SYMBOL, "f", F.array_sort(F.array_distinct(F.filter("q", lambda e: e < F.col("top")))).alias("e"))
    return ordered.groupBy(SYMBOL).agg(F.transform(F.sort_array(F.collect_list(F.struct("f", "e"))), lambda x: x["e"]).alias("edges"))


def _salted(rows: DataFrame, per_symbol: DataFrame, salts: int) -> DataFrame:
    """Rows with their symbol's one row of ``per_symbol`` before them, by (symbol, salt); kind 0 leads."""
    lead = per_symbol.withColumn("salt", F.explode(F.array(*[F.lit(s) for s in range(salts)]))).withColumn("kind", F.lit(0))
    return (lead.unionByName(rows.withColumn("kind", F.lit(1)), allowMissingColumns=True)
            .repartition(SYMBOL, "salt").sortWithinPartitions(SYMBOL, "salt", "kind"))


def _groups(batches, columns: list[str]):
    """(symbol, salt, kind, batch of consecutive rows of that group) in order."""
    for batch in batches:
        symbol, salt, kind = (batch.column(c) for c in (SYMBOL, "salt", "kind"))
        keys = list(zip(symbol.to_pylist(), salt.to_pylist(), kind.to_pylist()))
        i = 0
        while i < len(keys):
            j = i + 1
            while j < len(keys) and keys[j] == keys[i]:
                j += 1
            yield *keys[i], batch.slice(i, j - i).select(columns)
            i = j


def salts_for(rows: DataFrame) -> int:
    """Into how many parts each symbol's rows are dealt: as many as the longest symbol needs."""
    most = rows.groupBy(SYMBOL).count().agg(F.max("count")).first()[0] or 0
    return max(1, -(-most // ROWS_PER_SALT))


def binned(rows: DataFrame, cuts: DataFrame, features: list[str], target: str | None, salts: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """symbol, salt, key, y, bins (a byte a feature) and ``extra`` columns of every row whose symbol has cuts."""
    key = F.xxhash64(SYMBOL, TS)
    y = F.col(target).cast("int") if target else F.lit(0)
    thin = rows.select(SYMBOL, *extra, F.pmod(key, F.lit(salts)).cast("int").alias("salt"), key.alias("key"), y.alias("y"),
                       F.array(*[F.col(c).cast("double") for c in features]).alias("x"))
    kinds = {f.name: f for f in rows.schema.fields}
    schema = T.StructType([T.StructField(SYMBOL, T.StringType()), *[kinds[c] for c in extra], T.StructField("salt", T.IntegerType()),
                           T.StructField("key", T.LongType()), T.StructField("y", T.IntegerType()), T.StructField("bins", T.BinaryType())])

    def run(batches):
        at, cut = None, None
        for symbol, salt, kind, part in _groups(batches, ["edges", "x", "key", "y", *extra]):
            if kind == 0:
                at, cut = (symbol, salt), [np.array(e, float) for e in part.column("edges")[0].as_py()]
                continue
            if at != (symbol, salt):
                continue  # a symbol without training rows
            x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
            bins = np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(cut)], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [pa.array([symbol] * len(part)), *[part.column(c) for c in extra], pa.array([salt] * len(part), pa.int32()), part.column("key"),
                 part.column("y"), pa.array([r.tobytes() for r in bins], pa.binary())], names=schema.fieldNames())

    return _salted(thin, cuts, salts).mapInArrow(run, schema)


def _walk(bins: np.ndarray, split: dict[int, tuple[int, int]], depth: int) -> np.ndarray:
    """The node that each row reaches."""
    node = np.zeros(len(bins), np.int64)
    if not split:
        return node
    size = max(split) + 1
    feature, cut = np.full(size, -1), np.zeros(size, np.int64)
    for n, (f, b) in split.items():
        feature[n], cut[n] = f, b
    for _ in range(depth):
        inside = np.flatnonzero((node < size) & (feature[np.minimum(node, size - 1)] >= 0))
        if not len(inside):
            break
        n = node[inside]
        node[inside] = 2 * n + 1 + (bins[inside, feature[n]] > cut[n])
    return node


def _splits(column) -> dict[int, dict[int, tuple[int, int]]]:
    out: dict[int, dict[int, tuple[int, int]]] = {}
    for s in column[0].as_py() or []:
        if s["feature"] >= 0:
            out.setdefault(s["tree"], {})[s["node"]] = (s["feature"], s["bin"])
    return out


def _matrix(part, features: int) -> np.ndarray:
    return np.frombuffer(b"".join(part.column("bins").to_pylist()), np.uint8).reshape(len(part), features)


def _level_kernel(features: int, max_bins: int, trees: int, take: int, level: int):
    """Histograms (features looked at, bins, classes) of the nodes of one level, per (symbol, salt)."""
    schema = pa.schema([(SYMBOL, pa.string()), ("tree", pa.int32()), ("node", pa.int64()), ("hist", pa.binary())])
    first = (1 << level) - 1
    one = min(take, features) * max_bins * 2 * 8

    def run(batches):
        at, split, held = None, {}, {}

        def out():
            rows = [{SYMBOL: at[0], "tree": t, "node": n, "hist": h.tobytes()} for (t, n), h in held.items()]
            held.clear()
            return pa.RecordBatch.from_pylist(rows, schema)

        for symbol, salt, kind, part in _groups(batches, ["splits", "bins", "key", "y"]):
            if at != (symbol, salt) and held:
                yield out()
            if kind == 0:
                at, split = (symbol, salt), _splits(part.column("splits"))
                continue
            if at != (symbol, salt):
                at, split = (symbol, salt), {}
            bins, y = _matrix(part, features), part.column("y").to_numpy().astype(np.int64)
            keys = part.column("key").to_numpy()
            for tree in range(trees):
                if level and tree not in split:
                    continue
                weight, node = draws(keys, tree, trees > 1), _walk(bins, split.get(tree, {}), level)
                here = np.flatnonzero((node >= first) & (weight > 0))
                if not len(here):
                    continue
                found, which = np.unique(node[here], return_inverse=True)
                look = np.stack([candidates(symbol, tree, n, features, take) for n in found.tolist()])
                cell = ((which[:, None] * look.shape[1] + np.arange(look.shape[1])) * max_bins + bins[here[:, None], look[which]]) * 2 + y[here][:, None]
                hist = np.bincount(cell.ravel(), np.repeat(weight[here], look.shape[1]), len(found) * look.shape[1] * max_bins * 2)
                for n, part_ in zip(found.tolist(), hist.reshape(len(found), -1)):
                    if (tree, n) in held:
                        held[tree, n] += part_
                    else:
                        held[tree, n] = part_.copy()
                if len(held) * one > HELD_BYTES:
                    yield out()
        if held:
            yield out()
    return run


def best_cut(hist: np.ndarray, min_leaf: int) -> tuple[int, int, float] | None:
    """(place among the features looked at, bin, impurity decrease) of the best allowed cut, ties to the first."""
    left = np.cumsum(hist, axis=1)
    total = left[:, -1:, :]
    n_left, n = left.sum(2), float(total[0].sum())
    n_right = n - n_left
    allowed = (n_left >= min_leaf) & (n_right >= min_leaf)
    if not allowed.any():
        return None
    with np.errstate(divide="ignore", invalid="ignore"):
        kept = (left**2).sum(2) / n_left + ((total - left) ** 2).sum(2) / n_right  # n times one minus the Gini impurity of the parts
    kept = np.where(allowed, kept, -np.inf)
    place = int(np.argmax(np.round(kept, 9)))
    f, b = divmod(place, hist.shape[1])
    return f, b, max(0.0, (kept[f, b] - float((total[0] ** 2).sum()) / n) / n)


def _cut_kernel(features: int, max_bins: int, take: int, ml: MLParams, last: bool):
    """Histogram parts sorted by (symbol, tree, node): each node's counts and cut."""
    def run(batches):
        at, hist = None, None

        def node():
            symbol, tree, n = at
            both = hist.reshape(-1, max_bins, 2)
            n0, n1 = both[0].sum(0)
            cut = None if last or n0 + n1 < ml.tree_min_split or n0 == 0 or n1 == 0 else best_cut(both, ml.tree_min_leaf)
            if cut is None:
                return {SYMBOL: symbol, "tree": tree, "node": n, "n0": n0, "n1": n1, "feature": -1, "bin": -1, "decrease": 0.0}
            look = candidates(symbol, tree, n, features, take)
            return {SYMBOL: symbol, "tree": tree, "node": n, "n0": n0, "n1": n1, "feature": int(look[cut[0]]), "bin": cut[1], "decrease": cut[2]}

        for batch in batches:
            out = []
            for symbol, tree, n, part in zip(*[batch.column(c).to_pylist() for c in (SYMBOL, "tree", "node", "hist")]):
                if at != (symbol, tree, n):
                    if at is not None:
                        out.append(node())
                    at, hist = (symbol, tree, n), np.frombuffer(part, float).copy()
                else:
                    hist += np.frombuffer(part, float)
            yield pa.RecordBatch.from_pylist(out, _ARROW_NODES)
        if at is not None:
            yield pa.RecordBatch.from_pylist([node()], _ARROW_NODES)
    return run


def _leads(nodes: DataFrame) -> DataFrame:
    """One row a symbol: the cuts of its trees (at most trees x nodes of a tree)."""
    cut = nodes.where("feature >= 0")
    return cut.groupBy(SYMBOL).agg(F.collect_list(F.struct("tree", "node", "feature", "bin")).alias("splits"))


def fit_symbol_trees(scaled: DataFrame, features: list[str] | None = None, ml: MLParams = DEFAULT.ml, *, forest: bool = False,
                     target: str = "target", max_bins: int = MAX_BINS, salts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a tree, or of a forest of ``ml.forest_trees``, for each symbol's training rows."""
    feats = features or feature_columns(ml.max_lag)
    trees, take = (ml.forest_trees, max(1, int(math.sqrt(len(feats))))) if forest else (1, len(feats))
    train = scaled.filter(F.col("is_train"))
    salts = salts or salts_for(train)
    cuts = materialize(edges(train, feats, max_bins))
    rows = materialize(binned(train, cuts, feats, target, salts))
    nodes = scaled.sparkSession.createDataFrame([], NODES)
    hist_schema = "symbol string, tree int, node bigint, hist binary"
    for level in range(ml.tree_depth + 1):
        hist = _salted(rows, _leads(nodes), salts).mapInArrow(_level_kernel(len(feats), max_bins, trees, take, level), hist_schema)
        now = materialize(hist.repartition(SYMBOL, "tree", "node").sortWithinPartitions(SYMBOL, "tree", "node")
                          .mapInArrow(_cut_kernel(len(feats), max_bins, take, ml, level == ml.tree_depth), NODES))
        nodes = materialize(nodes.unionByName(now))  # a few rows a tree
        if now.where("feature >= 0").isEmpty():
            break
    return nodes, cuts


def score_symbol_trees(rows: DataFrame, nodes: DataFrame, cuts: DataFrame, features: list[str] | None = None, ml: MLParams = DEFAULT.ml,
                       *, keep: tuple[str, ...] = (), salts: int | None = None) -> DataFrame:
    """symbol, ts, ``keep``, probability (mean over trees of the leaf's share of class 1) and prediction of every row."""
    feats = features or feature_columns(ml.max_lag)
    extra = (TS, *keep)
    salts = salts or salts_for(rows)
    coded = binned(rows, cuts, feats, None, salts, extra).drop("key", "y")
    counts = nodes.groupBy(SYMBOL).agg(F.collect_list(F.struct("tree", "node", "feature", "bin", (F.col("n1") / (F.col("n0") + F.col("n1"))).alias("p"))).alias("splits"))
    kinds = {f.name: f for f in rows.schema.fields}
    schema = T.StructType([T.StructField(SYMBOL, T.StringType()), *[kinds[c] for c in extra], T.StructField("probability", T.DoubleType())])

    def run(batches):
        at, split, share = None, {}, {}
        for symbol, salt, kind, part in _groups(batches, ["splits", "bins", *extra]):
            if kind == 0:
                at, split, share = (symbol, salt), _splits(part.column("splits")), {}
                for s in part.column("splits")[0].as_py():
                    share.setdefault(s["tree"], {})[s["node"]] = s["p"]
                continue
            if at != (symbol, salt):
                continue
            bins = _matrix(part, len(feats))
            total = np.zeros(len(part))
            for tree, leaves in share.items():
                node = _walk(bins, split.get(tree, {}), ml.tree_depth)
                # a forest's leaf that no drawn row reached counts as its nearest ancestor with rows
                total += [next(leaves[n] for n in _upward(x) if n in leaves) for x in node.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([symbol] * len(part)), *[part.column(c) for c in extra], pa.array(total / max(1, len(share)))],
                                             names=schema.fieldNames())

    scored = _salted(coded, counts, salts).mapInArrow(run, schema)
    return scored.withColumn("prediction", F.when(F.col("probability") > 0.5, 1).otherwise(0))


def _upward(node: int):
    yield node
    while node:
        node = (node - 1) // 2
        yield node


def symbol_importance(nodes: DataFrame, features: list[str] | None = None, ml: MLParams = DEFAULT.ml) -> DataFrame:
    """symbol, feature, importance: each tree's impurity decreases by feature as shares of 1, averaged over trees; shares of 1 again."""
    feats = features or feature_columns(ml.max_lag)
    names = F.array(*[F.lit(c) for c in feats])
    cut = nodes.where("feature >= 0").withColumn("gain", F.col("decrease") * (F.col("n0") + F.col("n1")))
    by_tree = cut.groupBy(SYMBOL, "tree", "feature").agg(F.sum("gain").alias("gain"))
    totals = cut.groupBy(SYMBOL, "tree").agg(F.sum("gain").alias("all")).where("all > 0")
    shares = by_tree.join(totals, [SYMBOL, "tree"]).groupBy(SYMBOL, "feature").agg(F.sum(F.col("gain") / F.col("all")).alias("share"))
    whole = shares.groupBy(SYMBOL).agg(F.sum("share").alias("whole"))
    every = nodes.select(SYMBOL).distinct().select(SYMBOL, F.posexplode(names).alias("feature", "name"))
    return every.join(shares.join(whole, SYMBOL), [SYMBOL, "feature"], "left").select(
        SYMBOL, F.col("name").alias("feature"), F.coalesce(F.col("share") / F.col("whole"), F.lit(0.0)).alias("importance"))
