"""Random forests of deep trees, grown by groups of rows.

MLlib keeps a histogram of all bins for every node it splits, so a forest whose trees have as many nodes as a tenth of the rows takes a
histogram for each of them, however few rows it has. Here only nodes over ``LARGE`` rows are split by histograms, summed over blocks of rows;
the rows of any other node are dealt to one task, which grows the whole subtree below it. Trees are as MLlib's: Poisson bags, quantile bins,
a new choice of features for each node, Gini gain, and leaves of one parent and one prediction put together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.contracts import require
from gridloom.session import cut

#: Drawn rows of a node above which it is split by histograms; rows of a block in training and in prediction (at most 65,536, for offsets of 16 bits); trees dealt out with a block.
LARGE, BLOCK, ROWS, TREES = 1 << 17, 1 << 18, 1 << 13, 10
#: Probabilities of a tree are multiples of 1 / ONE, so that their sums are exact in any order.
ONE = 2.0**43
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(20)])
_TREE = np.dtype([("feature", "<i2"), ("cut", "u1"), ("left", "<i4"), ("p", "<f8")])


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bag(seeds: np.ndarray, key: np.uint64) -> np.ndarray:
    """How often the tree of this key draws each row: Poisson with mean 1, by a scattered number of the row."""
    u = (_mixed(seeds ^ key) >> np.uint64(11)).astype(np.float64) * 2.0**-53
    out = (u >= _POISSON[0]).astype(np.uint8) + (u >= _POISSON[1])
    many = np.flatnonzero(u >= _POISSON[2])
    out[many] = np.searchsorted(_POISSON, u[many], "right")
    return out


def chosen(keys: np.ndarray, features: int, k: int) -> np.ndarray:
    """The k features that each node may split on, by its key."""
    draws = _mixed(keys[:, None] ^ _mixed(np.arange(1, features + 1, dtype=np.uint64))[None, :])
    return np.argsort(draws, axis=1, kind="stable")[:, :k]


def children(keys: np.ndarray) -> np.ndarray:
    """Keys of the left and right child of each node, one after the other."""
    return _mixed(np.stack([keys, ~keys], axis=1).reshape(-1) + np.uint64(0x9E3779B97F4A7C15))


def gains(wl: np.ndarray, l1: np.ndarray, w: np.ndarray, w1: np.ndarray, min_leaf: int) -> np.ndarray:
    """What of a split is large where the Gini impurity left is small; -1 where a side is too small or nothing is gained. All counts are whole."""
    wr, r1 = w - wl, w1 - l1
    with np.errstate(divide="ignore", invalid="ignore"):
        g = (l1.astype(float) ** 2 + (wl - l1).astype(float) ** 2) / wl + (r1.astype(float) ** 2 + (wr - r1).astype(float) ** 2) / wr
    return np.where((wl >= max(1, min_leaf)) & (wr >= max(1, min_leaf)) & (l1 * w != w1 * wl), g, -1.0)


def splittable(w: np.ndarray, w1: np.ndarray, min_leaf: int) -> np.ndarray:
    return (w1 > 0) & (w1 < w) & (w >= 2 * min_leaf)


def walk(tree: dict | np.ndarray, x: np.ndarray, start: int = 0) -> np.ndarray:
    """The leaf of each row of bins."""
    at = np.full(len(x), start, np.int64)
    live = np.arange(len(x))
    while live.size:
        f = tree["feature"][at[live]]
        live, f = live[f >= 0], f[f >= 0]
        at[live] = tree["left"][at[live]] + (x[live, f] > tree["cut"][at[live]])
    return at


def pruned(feature: np.ndarray, left: np.ndarray, one: np.ndarray, layers: list[np.ndarray]) -> None:
    """Makes leaves, in place, of nodes whose children are leaves with one prediction; ``layers`` are nodes by depth."""
    for nodes in reversed(layers):
        inner = nodes[(feature[nodes] >= 0) & (left[nodes] > 0)]
        a, b = left[inner], left[inner] + 1
        feature[inner[(feature[a] < 0) & (feature[b] < 0) & (one[a] == one[b])]] = -1


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, key: int, *, levels: int, k: int, min_leaf: int) -> tuple[np.ndarray, int, int]:
    """A tree of at most so many levels of splits over rows of bins ``x``, classes ``y`` and draws ``w``, level by level; and the draws of its root, in all and of class 1."""
    flat, at, slot, keys = x.reshape(-1), np.arange(len(y)) * x.shape[1], np.zeros(len(y), np.int64), np.array([key], np.uint64)
    bits = w.astype(np.int64) << 1 | y
    t, t1 = (np.array([v.sum()], np.int64) for v in (bits >> 1, (bits >> 1) * y))
    feature, cuts, left, total, ones, layers, size = [], [], [], [], [], [], 0
    while keys.size:
        n = keys.size
        f, c, best, wl, l1 = np.full(n, -1, np.int16), np.zeros(n, np.uint8), np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
        live = splittable(t, t1, min_leaf) & (len(layers) < levels)
        stay = np.flatnonzero(live[slot])
        at, bits, slot = at[stay], bits[stay], slot[stay]
        if slot.size:
            picks = chosen(keys, x.shape[1], k)
            before, before1 = (np.concatenate([[0], np.cumsum(np.where(live, v, 0))[:-1]]) for v in (t, t1))
            rest = slot << 17 | bits
            for i in range(k):
                pick = picks[:, i]
                code = flat.take(at + pick[slot]).astype(np.int64)
                code <<= 9
                code |= rest
                code.sort()  # node, bin, draws, class
                run = code >> 9
                end = np.flatnonzero(run[1:] != run[:-1])
                run = run[end]
                s = run >> 8
                inside = np.flatnonzero(s == code[end + 1] >> 17)
                if not inside.size:
                    continue
                end, run, s = end[inside], run[inside] & 255, s[inside]
                drawn = code >> 1 & 255
                code &= 1
                code *= drawn
                a, a1 = np.cumsum(drawn)[end] - before[s], np.cumsum(code)[end] - before1[s]
                g = gains(a, a1, t[s], t1[s], min_leaf)
                first = np.concatenate([[0], np.flatnonzero(s[1:] != s[:-1]) + 1])
                top = np.maximum.reduceat(g, first)
                hit = np.flatnonzero(g == np.repeat(top, np.diff(np.append(first, g.size))))
                hit = hit[np.concatenate([[True], s[hit[1:]] != s[hit[:-1]]])]
                hit = hit[g[hit] > best[s[hit]]]
                node = s[hit]
                best[node], f[node], c[node], wl[node], l1[node] = g[hit], pick[node], run[hit], a[hit], a1[hit]
        split = f >= 0
        rank = np.cumsum(split) - 1
        layers.append(np.arange(size, size + n))
        size += n
        for whole, part in ((feature, f), (cuts, c), (left, np.where(split, size + 2 * rank, 0)), (total, t), (ones, t1)):
            whole.append(part)
        stay = np.flatnonzero(split[slot])
        at, bits, slot = at[stay], bits[stay], slot[stay]
        slot = 2 * rank[slot] + (flat.take(at + f[slot]) > c[slot])
        t, t1 = (np.stack([u, v - u], axis=1)[split].reshape(-1) for u, v in ((wl, t), (l1, t1)))
        keys = children(keys[split])
    feature, cuts, left, total, ones = map(np.concatenate, (feature, cuts, left, total, ones))
    pruned(feature, left, 2 * ones > total, layers)
    seen = np.zeros(size, bool)
    seen[0] = True
    for nodes in layers:
        inner = nodes[seen[nodes] & (feature[nodes] >= 0)]
        seen[left[inner]] = seen[left[inner] + 1] = True
    out = np.zeros(int(seen.sum()), _TREE)
    out["feature"], out["cut"], out["left"] = feature[seen], cuts[seen], np.where(feature >= 0, (np.cumsum(seen) - 1)[left], 0)[seen]
    out["p"] = np.rint(ones[seen] / np.maximum(total[seen], 1) * ONE) / ONE
    return out, int(total[0]), int(ones[0])


def _table(schema: dict[str, pa.DataType], columns: list[list]) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(columns or [[]] * len(schema), schema.values(), strict=True)], names=list(schema))


def _values(rows: DataFrame, bins: int) -> list[np.ndarray]:
    """Bounds of each feature's bins (a value belongs to the first bound it does not exceed): between all values if there are at most ``bins``, else quantiles."""

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy().reshape(b.num_rows, -1) + 0.0  # no negative zero
                held = held or [np.empty(0)] * x.shape[1]
                held = [np.unique(np.concatenate([h, c]))[: bins + 1] for h, c in zip(held, x.T, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(held)), [len(h) for h in held]), pa.int32()), pa.array(np.concatenate(held or [np.empty(0)]), pa.float64())], names=["f", "v"])

    found = rows.select("x").mapInArrow(some, "f int, v double").groupBy("f").agg(F.collect_set("v").alias("v")).select("f", F.size("v").alias("n"), F.when(F.size("v") <= bins, F.sort_array("v")).alias("v")).collect()
    few = {r["f"]: np.array(r["v"]) for r in found if r["n"] <= bins}
    many = sorted(r["f"] for r in found if r["n"] > bins)
    cuts = rows.select(*[F.col("x")[f].alias(f"f{f}") for f in many]).approxQuantile([f"f{f}" for f in many], [i / bins for i in range(1, bins)], 1 / (8 * bins)) if many else []
    return [(few[f][1:] + few[f][:-1]) / 2 if f in few else np.unique(cuts[many.index(f)]) for f in range(len(found))]


def _blocks(rows: DataFrame, bounds: list[np.ndarray], size: int) -> DataFrame:
    """block (the first id), classes and bins of ``size`` rows, which have consecutive ids, or fewer."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(ids: np.ndarray, y: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            require(bool((np.diff(ids) == 1).all()), "ids of a partition are not consecutive")
            return pa.RecordBatch.from_arrays([pa.array([ids[0]], pa.int64()), pa.array([y.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["block", "y", "x"])

        held, n = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(2).flatten().to_numpy().reshape(b.num_rows, -1)
            codes = np.stack([np.searchsorted(c, v) for c, v in zip(bounds, x.T, strict=True)], axis=1).astype(np.uint8)
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.uint8), codes))
            n += b.num_rows
            while n >= size:
                ids, y, x = map(np.concatenate, zip(*held, strict=True))
                yield out(ids[:size], y[:size], x[:size])
                held, n = [(ids[size:], y[size:], x[size:])], n - size
        if n:
            yield out(*map(np.concatenate, zip(*held, strict=True)))

    return rows.select("id", "y", "x").mapInArrow(packed, "block long, y binary, x binary")


def _by(df: DataFrame, tasks: int, *keys: str):
    """Groups by keys over so many tasks: sizes of packed rows say nothing about the work they make, so they are not left to adaptive execution."""
    return df.repartition(tasks, *keys).groupBy(*keys)


class Forest(Estimator):
    """A random forest for classes 0 and 1; its model adds ``probability`` and ``prediction``. At most 256 bins."""

    def __init__(self, *, features: str, label: str, trees: int, max_depth: int, min_leaf: int, bins: int, seed: int):
        super().__init__()
        require(1 <= bins <= 256, "a forest has 1 to 256 bins")
        self.features, self.label, self.trees, self.max_depth, self.min_leaf, self.bins, self.seed = features, label, trees, max_depth, min_leaf, bins, seed

    def _fit(self, dataset: DataFrame) -> ForestModel:
        spark = dataset.sparkSession
        sc = spark.sparkContext
        rows = cut(dataset.select(F.monotonically_increasing_id().alias("id"), F.col(self.label).cast("double").alias("y"), vector_to_array(self.features).alias("x")))
        n, odd = rows.agg(F.count("*"), F.count(F.when(F.coalesce(~F.col("y").isin(0.0, 1.0), F.lit(True)), 1))).first()
        require(n > 0, "a forest needs rows")
        require(odd == 0, "a forest's classes are 0 and 1")
        bounds = _values(rows, self.bins)
        blocks = cut(_blocks(rows, bounds, BLOCK))
        count, k, min_leaf, trees = len(bounds), math.ceil(math.sqrt(len(bounds))), self.min_leaf, self.trees
        lots = blocks.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit((trees - 1) // TREES))))
        tasks = max(24, 3 * sc.defaultParallelism, n * trees * (count + 2) >> 26)
        roots = _mixed(np.uint64(self.seed & (2**64 - 1)) + np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        # the nodes over LARGE draws and their children, the roots first
        top = {"feature": np.full(trees, -1, np.int16), "cut": np.zeros(trees, np.uint8), "left": np.zeros(trees, np.int64), "key": roots, "w": np.full(trees, n), "w1": np.full(trees, -1), "done": np.zeros(trees, bool)}
        layers = [np.arange(trees)]

        def draws(table: pa.Table, told: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
            """For each tree of a lot the top node, bins, class and draws of each row that it draws."""
            block, y, x, lot = (table.column(c)[0].as_py() for c in ("block", "y", "x", "lot"))
            y = np.frombuffer(y, np.uint8)
            x = np.frombuffer(x, np.uint8).reshape(len(y), -1)
            seeds = _mixed((block + np.arange(1, len(y) + 1)).astype(np.uint64))
            for tree in range(lot * TREES, min(trees, (lot + 1) * TREES)):
                w = bag(seeds, roots[tree])
                drawn = np.flatnonzero(w)
                own = x[drawn]
                yield tree, walk(told, own, tree), own, y[drawn], w[drawn]

        for depth in range(self.max_depth):
            nodes = layers[-1]
            large = nodes[(top["w"][nodes] > LARGE) & ((top["w1"][nodes] < 0) | splittable(top["w"][nodes], top["w1"][nodes], min_leaf))]
            if not large.size:
                break
            told = sc.broadcast((top, large, chosen(top["key"][large], count, k)))

            def counted(table: pa.Table) -> pa.Table:
                top, large, picks = told.value  # noqa: B023 (run before the next round)
                names, counts = [], []
                for _, at, x, y, w in draws(table, top):
                    place = np.minimum(np.searchsorted(large, at), large.size - 1)
                    mine = large[place] == at
                    place, x, y, w = place[mine], x[mine], y[mine], w[mine]
                    seen, slot = np.unique(place, return_inverse=True)
                    code = [(slot * k + i) << 9 | x[np.arange(slot.size), picks[place, i]].astype(np.int64) << 1 | y for i in range(k)]
                    sums = sum(np.bincount(c, w, seen.size * k << 9) for c in code).astype(np.int32).reshape(seen.size, k << 9)
                    names += large[seen].tolist()
                    counts += [s.tobytes() for s in sums]
                return _table({"node": pa.int64(), "counts": pa.binary()}, [names, counts])

            def best(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
                _, large, picks = told.value  # noqa: B023
                node = key[0].as_py()
                sums = np.zeros(k << 9, np.int64)
                for c in table.column("counts").to_pylist():
                    sums += np.frombuffer(c, np.int32)
                both = sums.reshape(k, 256, 2)
                w, w1 = int(both[0].sum()), int(both[0, :, 1].sum())
                wl, l1 = both.sum(2).cumsum(1)[:, :-1], both[:, :, 1].cumsum(1)[:, :-1]
                g = gains(wl, l1, np.full_like(wl, w), np.full_like(wl, w1), min_leaf)
                i, c = divmod(int(g.argmax()), 255)
                f = int(picks[np.searchsorted(large, node), i]) if g[i, c] > 0 else -1
                return _table({"node": pa.int64(), "f": pa.int32(), "cut": pa.int32(), "w": pa.int64(), "w1": pa.int64(), "wl": pa.int64(), "l1": pa.int64()}, [[v] for v in (node, f, c, w, w1, int(wl[i, c]), int(l1[i, c]))])

            found = _by(_by(lots, tasks, "block", "lot").applyInArrow(counted, "node long, counts binary"), tasks, "node").applyInArrow(best, "node long, f int, cut int, w long, w1 long, wl long, l1 long")
            found = sorted(found.collect())  # a row for each node over LARGE draws
            for r in found:
                top["w"][r["node"]], top["w1"][r["node"]], top["done"][r["node"]] = r["w"], r["w1"], True
            made = [r for r in found if r["f"] >= 0]
            split = np.array([r["node"] for r in made], np.int64)
            size = len(top["w"])
            top["feature"][split], top["cut"][split], top["left"][split] = [r["f"] for r in made], [r["cut"] for r in made], size + 2 * np.arange(split.size)
            sides = lambda whole, part: np.array([v for r in made for v in (r[part], r[whole] - r[part])], np.int64)
            w, w1 = sides("w", "wl"), sides("w1", "l1")
            new = {"feature": np.full(w.size, -1), "cut": np.zeros(w.size), "left": np.zeros(w.size), "key": children(top["key"][split]), "w": w, "w1": w1, "done": ~splittable(w, w1, min_leaf) | (depth + 1 >= self.max_depth)}
            top = {c: np.concatenate([v, new[c].astype(v.dtype)]) for c, v in top.items()}
            layers.append(np.arange(size, size + w.size))

        level = np.repeat(np.arange(len(layers)), [x.size for x in layers])
        told = sc.broadcast((top, level))
        deepest = self.max_depth

        def dealt(table: pa.Table) -> pa.Table:
            top = told.value[0]
            names, packs = [], []
            for _, at, x, y, w in draws(table, top):
                whole = np.concatenate([x, y[:, None], w[:, None]], axis=1)
                order = np.argsort(at, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
                    if part.size and not top["done"][at[part[0]]]:
                        names.append(int(at[part[0]]))
                        packs.append(whole[part].tobytes())
            return _table({"node": pa.int64(), "rows": pa.binary()}, [names, packs])

        def grown(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            top, level = told.value
            node = key[0].as_py()
            whole = np.frombuffer(b"".join(table.column("rows").to_pylist()), np.uint8).reshape(-1, count + 2)
            tree, w, w1 = grow(whole[:, :-2], whole[:, -2], whole[:, -1], top["key"][node], levels=deepest - level[node], k=k, min_leaf=min_leaf)
            return _table({"node": pa.int64(), "tree": pa.binary(), "leaf": pa.bool_(), "w": pa.int64(), "w1": pa.int64()}, [[v] for v in (node, tree.tobytes(), len(tree) == 1, w, w1)])

        grown_trees = cut(_by(_by(lots, tasks, "block", "lot").applyInArrow(dealt, "node long, rows binary"), tasks, "node").applyInArrow(grown, "node long, tree binary, leaf boolean, w long, w1 long"))
        # where the top's leaves have one prediction they are put together, too
        bottom = {r["node"]: r for r in grown_trees.select("node", "leaf", "w", "w1").collect()}
        for node, r in bottom.items():
            top["w"][node], top["w1"][node] = r["w"], r["w1"]
        open_ = np.isin(np.arange(len(top["w"])), [m for m, r in bottom.items() if not r["leaf"]])
        state = np.where(open_, 0, top["feature"])
        inner = state.copy()
        pruned(inner, top["left"], 2 * top["w1"] > top["w"], layers)
        top["feature"] = np.where(open_, -1, inner).astype(np.int16)
        single = []
        for m in np.flatnonzero((top["feature"] < 0) & ~np.isin(np.arange(len(top["w"])), list(bottom))):
            leaf = np.zeros(1, _TREE)
            leaf["feature"], leaf["p"] = -1, np.rint(max(0, top["w1"][m]) / max(1, top["w"][m]) * ONE) / ONE if top["w1"][m] >= 0 else 0
            single.append((int(m), bytearray(leaf.tobytes())))
        parts = grown_trees.select("node", "tree")
        if single:
            parts = parts.unionByName(spark.createDataFrame(single, "node long, tree binary"))
        return ForestModel(self.features, trees, bounds, {c: top[c] for c in ("feature", "cut", "left")}, parts)


class ForestModel(Model):
    """A forest whose trees' tops are arrays, while what is below them is a table (node of the top, tree) that rows are joined with."""

    def __init__(self, features: str, trees: int, bounds: list[np.ndarray], top: dict[str, np.ndarray], parts: DataFrame):
        super().__init__()
        self.features, self.trees, self.bounds, self.top, self.parts = features, trees, bounds, top, parts

    def _transform(self, dataset: DataFrame) -> DataFrame:
        sc = dataset.sparkSession.sparkContext
        trees, count, told = self.trees, len(self.bounds), sc.broadcast(self.top)
        rows = cut(dataset.withColumn("_forest_row", F.monotonically_increasing_id()))
        n = rows.count()
        lots = _blocks(rows.select(F.col("_forest_row").alias("id"), F.lit(0.0).alias("y"), vector_to_array(self.features).alias("x")), self.bounds, ROWS).select("block", "x", F.explode(F.sequence(F.lit(0), F.lit((trees - 1) // TREES))).alias("lot"))
        tasks = max(24, 3 * sc.defaultParallelism, n * trees * (count + 10) >> 26)
        salts = 1 + n // BLOCK  # rows that one group of a node can have are bounded

        def dealt(table: pa.Table) -> pa.Table:
            block, x, lot = (table.column(c)[0].as_py() for c in ("block", "x", "lot"))
            x = np.frombuffer(x, np.uint8).reshape(-1, count)
            out = []
            for tree in range(lot * TREES, min(trees, (lot + 1) * TREES)):
                at = walk(told.value, x, tree)
                order = np.argsort(at, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
                    out.append((int(at[part[0]]), block // ROWS % salts, block, part.astype(np.uint16).tobytes(), x[part].tobytes(), None))
            return _table(schema, [list(c) for c in zip(*out, strict=True)])

        def told_off(table: pa.Table) -> pa.Table:
            trees_, out = [t for t in table.column("tree").to_pylist() if t is not None], []
            for block, at, x in zip(*(table.column(c).to_pylist() for c in ("block", "at", "x")), strict=True):
                if block is not None:
                    tree = np.frombuffer(trees_[0], _TREE)
                    out.append((block, at, tree["p"][walk(tree, np.frombuffer(x, np.uint8).reshape(-1, count))].tobytes()))
            return _table({"block": pa.int64(), "at": pa.binary(), "p": pa.binary()}, [list(c) for c in zip(*out, strict=True)])

        def summed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            sums = np.zeros(ROWS)
            seen = 0
            for at, p in zip(table.column("at").to_pylist(), table.column("p").to_pylist(), strict=True):
                where = np.frombuffer(at, np.uint16)
                sums[where] += np.frombuffer(p, np.float64)
                seen = max(seen, int(where.max()) + 1)
            return pa.table([pa.array(key[0].as_py() + np.arange(seen), pa.int64()), pa.array(sums[:seen] / trees)], names=["_forest_at", "_forest_share"])

        schema = {"node": pa.int64(), "salt": pa.int64(), "block": pa.int64(), "at": pa.binary(), "x": pa.binary(), "tree": pa.binary()}
        asked = _by(lots, tasks, "block", "lot").applyInArrow(dealt, "node long, salt long, block long, at binary, x binary, tree binary")
        known = self.parts.select("node", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<long>")).alias("salt"), F.lit(None).cast("long").alias("block"), F.lit(None).cast("binary").alias("at"), F.lit(None).cast("binary").alias("x"), "tree")
        each = _by(asked.unionByName(known), tasks, "node", "salt").applyInArrow(told_off, "block long, at binary, p binary")
        sums = cut(_by(each, max(24, 3 * sc.defaultParallelism, n // (4 * ROWS)), "block").applyInArrow(summed, "_forest_at long, _forest_share double"))
        out = rows.join(sums, F.col("_forest_row") == F.col("_forest_at"))
        return out.withColumn("probability", array_to_vector(F.array(1 - F.col("_forest_share"), F.col("_forest_share")))).withColumn("prediction", (F.col("_forest_share") > 0.5).cast("double")).drop("_forest_row", "_forest_at", "_forest_share")
