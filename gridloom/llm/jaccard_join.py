"""N-gram Jaccard join with prefix trees.

Texts are sets of word shingles. All shingles have one global order, rare ones first; frequencies come from a count sketch of fixed size over all texts, and
as any order is right, a rough one only costs comparisons. Two sets as alike as asked for share a shingle among the first few of each and are about as
large, so sets that share none there are never compared, nor sets whose counts of shingles by hash range differ by more than alike sets can. What may be alike,
directly or through others, is one cluster. A cluster's sets go into tries whose paths run from
the cluster's most frequent shingle to its rarest: a traversal for many sets at once counts overlaps along shared paths once, and leaves a subtree
as soon as the overlap so far plus what can still come is too small for any set in it, or all its sets are connected already. Large clusters are
dealt out in blocks: each block against itself and against one of them first, then only blocks that are not in one component yet.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import batches_of, staged
from gridloom.llm.simhash import components, text_mark

SHINGLE, PERCENT, SEED = 3, 90, 42
#: Cells of the sketch of shingle counts (4 bytes each): what is collected and broadcast, whatever the input's size.
CELL_BITS = 20
#: Slots of the sketch that are summed apart.
SLOTS = 32
#: Hash ranges in which a set's shingles are counted, and shingles to a range and most ranges of the finer counts.
RANGES, FINE, MOST_RANGES = 32, 8, 4096
#: Members of a bucket whose possible pairs are looked at one by one, and of one that is taken apart by range counts; larger buckets hang together whole.
SMALL, BUCKET = 16, 512
#: Bits of the filter of texts whose sets are wanted.
FILTER_BITS = 23
#: Shingles of a block of sets: two blocks, at 8 bytes a shingle, stand in a task's memory.
BLOCK_SHINGLES = 1 << 14
#: Sets that traverse a trie at a time, numbers that stand for their members then (one set's at least), and rows of an Arrow batch.
TRAVELLERS, HELD, BATCH = 64, 1 << 23, 512
_MIX = tuple(np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles; a shorter text is one shingle, a wordless one has none. Bytes are lower-cased and split as ASCII."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = own.size - shingle + 1
    x = own[:n].copy()
    for k in range(1, shingle):
        x = (x ^ x >> np.uint64(29)) * _MIX[0] + own[k : k + n]
    x ^= x >> np.uint64(31)
    x *= _MIX[1]
    x ^= x >> np.uint64(29)
    x *= _MIX[2]
    return np.unique(x ^ x >> np.uint64(32))


def _cells(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def shingle_sketch(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> np.ndarray:
    """How often shingles of each cell occur, over all texts; 4 MB, summed in tasks before the driver sees it."""
    width = (1 << CELL_BITS) // SLOTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(1 << CELL_BITS, np.int64), False
        for b in batches:
            found = [shingles(x, shingle) for x in b.column(0).to_pylist()]
            if found:
                total += np.bincount(_cells(np.concatenate(found)), minlength=total.size)
                seen = True
        if seen:
            parts = np.minimum(total, np.iinfo(np.int32).max).astype("<i4").reshape(SLOTS, width)
            yield pa.RecordBatch.from_arrays([pa.array(range(SLOTS), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())], names=["slot", "counts"])

    def add(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for b in parts:
            for x in b.column(1).to_pylist():
                total += np.frombuffer(zlib.decompress(x), "<i4")
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.minimum(total, np.iinfo(np.int32).max).astype("<i4").tobytes()], pa.binary())], names=["slot", "counts"])

    out = np.zeros((SLOTS, width), np.int32)
    rows = docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(count, "slot int, counts binary")
    for r in rows.groupBy("slot").applyInArrow(add, "slot int, counts binary").collect():
        out[r["slot"]] = np.frombuffer(r["counts"], "<i4")
    return out.reshape(-1)


def prefix(x: np.ndarray, sketch: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The rarest shingles of a set: so many that every set at least ``percent`` alike has one of them among its own."""
    keep = x.size - -(-percent * x.size // 100) + 1
    return x[np.lexsort((x, sketch[_cells(x)]))[:keep]] if x.size else x


def range_counts(x: np.ndarray) -> bytes:
    """How many of a set's shingles lie in each hash range, 65,535 at most."""
    counts = np.bincount((x >> np.uint64(20)).astype(np.int64) % RANGES, minlength=RANGES)
    return np.minimum(counts, 65535).astype("<u2").tobytes()


def fine_counts(x: np.ndarray) -> bytes:
    """As ``range_counts`` in ever more ranges for larger sets, 255 at most: unlike sets of any size differ clearly."""
    ranges = min(max(RANGES, 1 << max(0, (x.size // FINE)).bit_length()), MOST_RANGES)
    counts = np.bincount((x >> np.uint64(20)).astype(np.int64) % ranges, minlength=ranges)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def may_be_alike(x: bytes, y: bytes, sizes: int, percent: int) -> bool:
    """Whether sets with these fine counts and so many shingles together can be alike: what differs in some range differs in the sets."""
    a, b = np.frombuffer(x, np.uint8).astype(np.int32), np.frombuffer(y, np.uint8).astype(np.int32)
    n = min(a.size, b.size)
    a, b = (np.minimum(c.reshape(-1, n).sum(0), 255) for c in (a, b))
    return (100 + percent) * int(np.abs(a - b).sum()) <= (100 - percent) * sizes


def _alone_left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (shingle, sid) sorted by shingle, those whose shingle another row has."""
    before, held = None, None

    def kept(b: pa.RecordBatch, after: int | None) -> pa.RecordBatch:
        x = b.column(0).to_numpy()
        same = x[1:] == x[:-1]
        return b.filter(pa.array(np.concatenate([[x[0] == before], same]) | np.concatenate([same, [x[-1] == after]])))

    for b in batches:
        if b.num_rows:
            if held is not None:
                yield kept(held, b.column(0)[0].as_py())
                before = held.column(0)[-1].as_py()
            held = b
    if held is not None:
        yield kept(held, None)


def _possible(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Edges u, v, sure that hold together, in each bucket of the rows (key, sid, size, counts) sorted by key, the sets that may be alike by their sizes and range counts.

    In a bucket of up to ``SMALL`` each possible pair is an edge that may be looked at again (not sure). In larger ones edges only span what hangs together; the
    first set of a bucket of over ``BUCKET`` is joined with every other one.
    """

    def edges(cols: list[np.ndarray]) -> list[tuple[np.ndarray, ...]]:
        key, sid, size, counts = cols
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        members = np.diff(np.append(starts, key.size))
        first, large, small = np.repeat(starts, members), np.repeat(members > BUCKET, members), np.repeat(members <= SMALL, members)
        out = [(sid[large], sid[first[large]], np.ones(int(large.sum()), bool))]
        pairs, most = [], members[members <= BUCKET].max(initial=0)
        for d in range(1, most):
            i = np.flatnonzero((key[d:] == key[:-d]) & ~large[d:])
            apart = np.abs(counts[i].astype(np.int32) - counts[i + d]).sum(1)
            near = (100 + percent) * apart <= (100 - percent) * (size[i] + size[i + d])
            pairs.append((i[near], i[near] + d))
        if pairs:
            u, v = (np.concatenate(p) for p in zip(*pairs, strict=True))
            alone = small[u]
            out.append((sid[v[alone]], sid[u[alone]], np.zeros(int(alone.sum()), bool)))
            u, v = u[~alone], v[~alone]
            label, old = np.arange(key.size), None
            while old is None or (label != old).any():
                old = label.copy()
                np.minimum.at(label, v, old[u])
                np.minimum.at(label, u, old[v])
            moved = label != np.arange(key.size)
            out.append((sid[moved], sid[label[moved]], np.ones(int(moved.sum()), bool)))
        return out

    def batch(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        u, v, sure = (np.concatenate(x) for x in zip(*found, strict=True))
        k = u != v
        return pa.RecordBatch.from_arrays([pa.array(u[k]), pa.array(v[k]), pa.array(sure[k])], names=["u", "v", "sure"])

    rest: list[np.ndarray] | None = None
    lead: tuple[int, int] | None = None  # key and first set of a large bucket that goes on
    for b in batches:
        counts = np.frombuffer(b"".join(b.column(3).to_pylist()), "<u2").reshape(-1, RANGES)
        cols = [*(b.column(k).to_numpy() for k in range(3)), counts]
        found = []
        if lead is not None:
            n = int(np.searchsorted(cols[0], lead[0], side="right"))
            found.append((cols[1][:n], np.full(n, lead[1]), np.ones(n, bool)))
            cols = [c[n:] for c in cols]
            if not cols[0].size:
                yield batch(found)
                continue
            lead = None
        cols = cols if rest is None else [np.concatenate([r, c]) for r, c in zip(rest, cols, strict=True)]
        at = int(np.searchsorted(cols[0], cols[0][-1]))
        if at:
            found += edges([c[:at] for c in cols])
        rest = [c[at:] for c in cols]
        if rest[0].size > BUCKET:
            lead = int(rest[0][0]), int(rest[1][0])
            found.append((rest[1], np.full(rest[1].size, lead[1]), np.ones(rest[1].size, bool)))
            rest = None
        if found:
            yield batch(found)
    if rest is not None and rest[0].size:
        yield batch(edges(rest))


def candidate_edges(one: DataFrame, percent: int) -> DataFrame:
    """Edges u, v over ``one`` (sid, size, rare, counts, fine) whose components hold all alike sets; most of what they join is alike."""
    n = int(one.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rare = one.select(F.explode("rare").alias("shingle"), "sid").repartition(n, "shingle").sortWithinPartitions("shingle")
    shared = staged(rare.mapInArrow(_alone_left_out, "shingle long, sid long"), "jaccard-shared")
    # alike sets are in one class of sizes or in neighbouring ones
    step = max(math.log(100 / percent), 1e-6) * (1 + 1e-9)
    size_class = F.floor(F.log("size") / step)
    sized = shared.join(one.select("sid", "size", "counts"), "sid").withColumn("class", F.explode(F.array(size_class, size_class + 1)))
    keyed = sized.select(F.xxhash64("shingle", "class").alias("key"), "sid", "size", "counts").repartition(n, "key").sortWithinPartitions("key", "sid")
    edges = keyed.mapInArrow(lambda it: _possible(it, percent), "u long, v long, sure boolean").groupBy("u", "v").agg(F.max("sure").alias("sure"))
    edges = staged(edges, "jaccard-possible")

    def finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [may_be_alike(x, y, n, percent) for x, y, n in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    a, b = (one.select(F.col("sid").alias(k), F.col("fine").alias(f"fine_{k}"), F.col("size").alias(f"size_{k}")) for k in "uv")
    again = edges.where("NOT sure").join(a, "u").join(b, "v").select("u", "v", "fine_u", "fine_v", (F.col("size_u") + F.col("size_v")).alias("sizes"))
    return edges.where("sure").select("u", "v").unionByName(again.mapInArrow(finer, "u long, v long"))


def text_filter(marks: DataFrame) -> np.ndarray:
    """A bit for each mark of ``marks`` by its last bits; of a fixed size, so it lets ever more other marks through the more are wanted."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << FILTER_BITS, bool)
        for b in batches:
            held[b.column(0).to_numpy() & ((1 << FILTER_BITS) - 1)] = True
        if held.any():
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.packbits(held).tobytes(), 1)], pa.binary())], names=["bits"])

    out = np.zeros(1 << FILTER_BITS >> 3, np.uint8)
    for r in marks.select("mark").mapInArrow(bits, "bits binary").toLocalIterator():
        out |= np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return out


class Trie:
    """Sets as paths of a compressed trie, from the most to the least frequent member; members of one set only are left out of paths but count in sizes.

    ``others`` are sets that will traverse it besides its own.
    """

    def __init__(self, sets: list[np.ndarray], others: list[np.ndarray] = ()):
        self.members, count = np.unique(np.concatenate([*sets, *others]), return_counts=True)
        rank = np.empty(self.members.size, np.int64)
        rank[np.lexsort((self.members, -count))] = np.arange(self.members.size)
        self.rank, self.shared = rank, int((count > 1).sum())
        paths = [self.path(x) for x in sets]
        self.order = sorted(range(len(sets)), key=lambda i: paths[i].astype(">u4").tobytes())
        self.paths = [paths[i] for i in self.order]
        self.sizes = np.array([sets[i].size for i in self.order])
        self._link_up()

    def path(self, x: np.ndarray) -> np.ndarray:
        """Ranks of the members of ``x`` that paths hold, in order."""
        at = np.minimum(np.searchsorted(self.members, x), self.members.size - 1)
        r = self.rank[at[self.members[at] == x]]
        return np.sort(r[r < self.shared])

    def _link_up(self) -> None:
        """Nodes from common prefixes of neighbours: ``low``, ``high`` (the sets below), ``start``, ``end`` (the piece of their paths on the edge above) and levels."""
        m = len(self.paths)
        common = np.zeros(m + 1, np.int64)
        for i in range(1, m):
            a, b = self.paths[i - 1], self.paths[i]
            n = min(a.size, b.size)
            differ = np.flatnonzero(a[:n] != b[:n])
            common[i] = differ[0] if differ.size else n
        nodes = {(0, m): 0}
        stack = [(0, 0)]  # depth and first set of the open nodes
        for i in range(1, m + 1):
            low = i - 1
            while stack and stack[-1][0] > common[i]:
                depth, low = stack.pop()
                nodes[low, i] = depth
            if i < m and stack[-1][0] < common[i]:
                stack.append((int(common[i]), low))
        leaves = [(i, i + 1, self.paths[i].size, i) for i in range(m)]
        table = np.array([(a, b, d, -1) for (a, b), d in nodes.items()] + leaves)
        table = table[np.lexsort((table[:, 3], -table[:, 1], table[:, 0]))]  # a node stands before what lies below it
        self.low, self.high, self.end, self.leaf = table.T
        self.parent, path = np.full(len(table), -1), []
        for k in range(len(table)):
            while path and self.high[path[-1]] < self.high[k]:
                path.pop()
            if path:
                self.parent[k] = path[-1]
            if self.leaf[k] < 0:
                path.append(k)
        self.start = np.where(self.parent < 0, 0, self.end[self.parent])
        kids = np.argsort(self.parent, kind="stable")
        self.first_kid, self.last_kid = (np.searchsorted(self.parent[kids], np.arange(len(table)), side=s) for s in ("left", "right"))
        self.kids = kids
        length = np.array([p.size for p in self.paths])
        bounds = np.stack([self.low, self.high], 1).reshape(-1)
        below = lambda least_or_most, x: least_or_most.reduceat(np.append(x, x[-1]), bounds)[::2]  # noqa: E731  its odd pieces lie between nodes
        self.left = below(np.maximum, length) - self.end
        self.least, self.most = below(np.minimum, self.sizes), below(np.maximum, self.sizes)
        self.flat = np.concatenate([*self.paths, np.zeros(1, np.int64)])
        self.place = np.cumsum(length) - length

    def search(self, sets: list[np.ndarray], parts: np.ndarray, own: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (set of ``sets``, set of the trie) at least ``percent`` alike; none where ``own`` (of the trie's sets) says the part that ``parts`` says."""
        paths = [self.path(x) for x in sets]
        held = np.zeros((len(sets), self.shared + 1), np.int32)  # how many of a set's members have a lower rank
        for k, p in enumerate(paths):
            held[k, p + 1] = 1
        np.cumsum(held, axis=1, out=held)
        size = np.array([x.size for x in sets])
        changes = np.concatenate([[0], np.cumsum(own[1:] != own[:-1])])
        uniform = np.where(changes[self.high - 1] == changes[self.low], own[self.low], -1)
        query, node, overlap = np.arange(len(sets)), np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while query.size:
            n = self.end[node] - self.start[node]
            at = np.repeat(self.place[self.low[node]] + self.start[node], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            of, token = np.repeat(np.arange(query.size), n), self.flat[at]
            overlap = overlap + np.bincount(of, weights=held[query[of], token + 1] - held[query[of], token], minlength=query.size).astype(np.int64)
            last = np.where(self.end[node] > 0, self.flat[np.maximum(self.place[self.low[node]] + self.end[node] - 1, 0)] + 1, 0)
            best = overlap + np.minimum(held[query, -1] - held[query, last], self.left[node])
            q = size[query]
            ok = ((100 + percent) * best >= percent * (q + self.least[node])) & (percent * self.least[node] <= 100 * q) & (100 * self.most[node] >= percent * q) & (uniform[node] != parts[query])
            query, node, overlap = query[ok], node[ok], overlap[ok]
            ends = self.leaf[node] >= 0
            found.append((query[ends], self.leaf[node[ends]]))
            query, node, overlap = query[~ends], node[~ends], overlap[~ends]
            n = self.last_kid[node] - self.first_kid[node]
            at = np.repeat(self.first_kid[node], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            query, overlap, node = np.repeat(query, n), np.repeat(overlap, n), self.kids[at]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def spanning_links(sets: list[np.ndarray], ids: list[int], parts: list[int], percent: int = PERCENT, *, against: tuple[list[np.ndarray], list[int], list[int]] | None = None) -> list[tuple[int, int]]:
    """Links between ids whose components, with the given parts, are those of all pairs of non-empty ``sets`` (or pairs with those ``against``) at least ``percent`` alike."""
    trie_sets, trie_ids, trie_parts = against or (sets, ids, parts)
    trie = Trie(trie_sets, sets if against else ())
    label: dict[int, int] = {}

    def find(x: int) -> int:
        while label.setdefault(x, x) != x:
            label[x] = x = label[label[x]]
        return x

    out = []
    step = max(1, min(TRAVELLERS, HELD // (trie.shared + 1)))
    for lo in range(0, len(sets), step):
        hi = min(lo + step, len(sets))
        own = np.array([find(trie_parts[i]) for i in trie.order])
        mine = np.array([find(p) for p in parts[lo:hi]])
        name = {p: k for k, p in enumerate(np.unique(np.concatenate([own, mine])).tolist())}  # small numbers, so that -1 is none
        q, t = trie.search(sets[lo:hi], np.array([name[p] for p in mine.tolist()]), np.array([name[p] for p in own.tolist()]), percent)
        for a, b in zip(q.tolist(), t.tolist(), strict=True):
            b = trie.order[b]
            r, s = find(parts[lo + a]), find(trie_parts[b])
            if r != s:
                label[max(r, s)] = min(r, s)
                out.append((ids[lo + a], trie_ids[b]))
    return out


def _set_key(x: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed longs."""
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(x.tobytes(), SEED), "<i8").tolist())


def _dealt(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links from rows (task, side, sid, part): the sets of side 0 go into a trie, those of side 1 traverse it; without side 1 those of side 0 do."""

    def links(held: dict[int, list[tuple]]) -> pa.RecordBatch:
        unpack = lambda side: ([np.frombuffer(r[2], np.uint64) for r in held.get(side, [])], [r[0] for r in held.get(side, [])], [r[1] for r in held.get(side, [])])
        (sets0, ids0, parts0), (sets1, ids1, parts1) = unpack(0), unpack(1)
        found = spanning_links(sets1, ids1, parts1, percent, against=(sets0, ids0, parts0)) if sets1 and sets0 else spanning_links(sets0, ids0, parts0, percent) if len(sets0) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.int64()), pa.array([v for _, v in found], pa.int64())], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for b in batches:
            for task, side, sid, part, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if task != now:
                    if held:
                        yield links(held)
                    now, held = task, {}
                held.setdefault(side, []).append((sid, part, data))
        if held:
            yield links(held)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ready = rows.join(sets, "sid").select("task", "side", "sid", "part", "set").repartition(n, "task").sortWithinPartitions("task", "side", "sid")
    return ready.mapInArrow(run, "u long, v long")


def _blocks(members: DataFrame, by: str) -> DataFrame:
    """``members`` (cluster, sid, size, part) with block: a group ``by`` as large as a block is cut by sid, smaller ones share blocks; and blocks, how many the cluster has."""
    own = members.groupBy("cluster", by).agg(F.sum("size").alias("own"))
    cut = own.select("cluster", by, (F.col("own") / BLOCK_SHINGLES).cast("long").alias("pieces"), "own")
    small = cut.where("pieces = 0").groupBy("cluster").agg(F.ceil(F.sum("own") / BLOCK_SHINGLES).alias("shares"))
    placed = members.join(cut.drop("own"), ["cluster", by]).join(small, "cluster", "left")
    spread = F.when(F.col("pieces") > 0, F.concat_ws(":", F.lit("p"), by, F.pmod(F.xxhash64("sid"), F.col("pieces") + 1))).otherwise(F.concat_ws(":", F.lit("s"), F.pmod(F.xxhash64(by), F.col("shares"))))
    return placed.select("cluster", "sid", "size", "part", spread.alias("block"))


def set_links(members: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links u, v whose components are those of all alike pairs inside the clusters of ``members`` (cluster, sid, size); ``sets`` has sid and set."""
    members = staged(_blocks(members.withColumn("part", F.col("sid")), "sid"), "jaccard-members")
    lead = members.groupBy("cluster").agg(F.min("block").alias("lead"), F.count_distinct("block").alias("blocks"))
    lead = staged(lead, "jaccard-leads")
    met = members.join(lead, "cluster")
    key = lambda *names: F.xxhash64(F.lit("task"), *names)
    alone = met.select(key("cluster", "block").alias("task"), F.lit(0).alias("side"), "sid", "part")
    others = lead.join(members.select("cluster", "block").distinct(), "cluster").where("block <> lead")
    held = met.where("block = lead").join(others.select("cluster", F.col("block").alias("other")), "cluster").select(key("cluster", "lead", "other").alias("task"), F.lit(0).alias("side"), "sid", "part")
    visits = met.where("block <> lead").select(key("cluster", "lead", "block").alias("task"), F.lit(1).alias("side"), "sid", "part")
    found = staged(_dealt(alone.unionByName(held).unionByName(visits), sets, percent), "jaccard-links")
    large = lead.where("blocks > 2").select("cluster")
    if large.isEmpty():
        return found
    reps = components(found)
    again = members.join(large, "cluster").join(reps, F.col("sid") == F.col("node"), "left").select("cluster", "sid", "size", F.coalesce("rep", "sid").alias("part"))
    again = staged(_blocks(again, "part"), "jaccard-parts")
    names = again.groupBy("cluster", "block").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    names = staged(names, "jaccard-blocks")
    a, b = names.select("cluster", F.col("block").alias("i"), F.col("low").alias("low1"), F.col("high").alias("high1")), names.select("cluster", F.col("block").alias("j"), "low", "high")
    apart = a.join(b, "cluster").where("i <= j and least(low, low1) <> greatest(high, high1)").select("cluster", "i", "j")
    apart = staged(apart, "jaccard-apart")
    first = again.join(apart.withColumn("block", F.col("i")), ["cluster", "block"]).select(key("cluster", "i", "j").alias("task"), F.lit(0).alias("side"), "sid", "part")
    second = again.join(apart.where("i <> j").withColumn("block", F.col("j")), ["cluster", "block"]).select(key("cluster", "i", "j").alias("task"), F.lit(1).alias("side"), "sid", "part")
    return found.unionByName(_dealt(first.unionByName(second), sets, percent))


def jaccard_components(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles (the size of its set) and component_id (the smallest doc_id that links of ``percent`` or more reach, itself included).

    Every row stays, repeated rows too; equal sets are compared once. Null, empty and wordless texts have no shingles and link with nothing: their component is
    their own doc_id. A null doc_id belongs to its component but is never its smallest; a component without ids has a null component_id. Other columns are not
    read. Empty in, empty out.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), text_mark(text).alias("mark"), F.col(f"`{text}`").cast("string").alias("text"))
    with batches_of(spark, BATCH):
        sketch = spark.sparkContext.broadcast(shingle_sketch(src, shingle=shingle))

        def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sets = [shingles(x, shingle) for x in b.column(2).to_pylist()]
                keys = [_set_key(x) for x in sets]
                columns = [b.column(0), b.column(1), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([x.size for x in sets], pa.int64())]
                rare = pa.array([prefix(x, sketch.value, percent).view(np.int64) for x in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*columns, rare, pa.array(map(range_counts, sets), pa.binary()), pa.array(map(fine_counts, sets), pa.binary())], names=["id", "mark", "a", "b", "size", "rare", "counts", "fine"])

        rows = staged(src.mapInArrow(prints, "id long, mark long, a long, b long, size long, rare array<long>, counts binary, fine binary"), "jaccard-prints")
        one = rows.where("size > 0").groupBy("a", "b").agg(F.min("id").alias("root"), *[F.first(c).alias(c) for c in ("mark", "size", "rare", "counts", "fine")])
        one = staged(one.withColumn("sid", F.monotonically_increasing_id()), "jaccard-sets")
        clusters = components(staged(candidate_edges(one, percent), "jaccard-edges"))
        near = clusters.select(F.col("node").alias("sid"), F.col("rep").alias("cluster"))
        near = near.unionByName(clusters.select(F.col("rep").alias("sid"), F.col("rep").alias("cluster")).distinct())
        members = staged(near.join(one.select("sid", "size", "mark"), "sid"), "jaccard-clusters")
        wanted = spark.sparkContext.broadcast(text_filter(members))

        def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            done = set()  # repeated texts of a task come once
            for b in batches:
                cell = b.column(0).to_numpy() & ((1 << FILTER_BITS) - 1)
                kept = b.filter(pa.array((wanted.value[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)))
                for mark, text in zip(kept.column(0).to_pylist(), kept.column(1).to_pylist(), strict=True):
                    if mark not in done:
                        done.add(mark)
                        yield pa.RecordBatch.from_arrays([pa.array([mark], pa.int64()), pa.array([shingles(text, shingle).tobytes()], pa.binary())], names=["mark", "set"])

        texts = src.select("mark", "text").mapInArrow(unpacked, "mark long, set binary")
        sets = staged(texts.join(members.select("mark", "sid"), "mark").select("sid", "set").dropDuplicates(["sid"]), "jaccard-wanted-sets")
        links = staged(set_links(members.select("cluster", "sid", "size"), sets, percent), "jaccard-found")
        reps = components(links)
    placed = one.select("a", "b", "sid", "root").join(reps, F.col("sid") == F.col("node"), "left").select("a", "b", "root", F.coalesce("rep", "sid").alias("rep"))
    least = placed.groupBy("rep").agg(F.min("root").alias("component_id"))
    named = placed.join(least, "rep").select("a", "b", "component_id")
    out = rows.select("id", "a", "b", "size").join(named, ["a", "b"], "left")
    return out.select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
