"""Maximal repeat groups of byte strings, each with all its occurrences, from common-prefix interval trees over sampled suffixes.

A repeat is maximal if its occurrences are not all followed by one byte and not all preceded by one byte; the end of a text differs from
any byte. Every string of LENGTH bytes holds an anchor (``suffix_dedup.anchors``), so every repeat shows in the tree of an anchor: a stack
scan over the common prefixes of what stands to the right visits the tree's intervals, and in each a second scan, over what stands to the
left, yields the parts whose left extensions differ. Equal surroundings are one leaf of the tree with a number of copies. A tree's strings
count only where the anchor is that of a window inside the string, as then all its occurrences are in the tree.

A tree with more than FORMS leaves is not scanned by one task. Its root is closed by an aggregation (the common prefix of a set of strings
is that of its least and greatest), and its leaves go on to the root's children by their next byte: to the right, or for good to the left.
That names each maximal repeat once, as the scans do; a child of at most FORMS leaves is scanned.

An anchor sees ``reach`` bytes on either side. A longer repeat shows at many anchors with the same occurrences, and these pieces are chained
into one. Where other places join in or leave, the chain ends, and the next group begins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import BATCH_ROWS, batches_of, staged
from gridloom.llm.suffix_dedup import BLOCK, GRAM, LENGTH, _Hashes, agree, anchors, intervals

#: Leaves of a tree that one task scans at most.
FORMS = 1024
_LEAF = "node long, kind int, deep int, h long, f long, n long, left binary, right binary, lower int, upper int"
_FOUND = "gid string, h long, f long, a int, b int"


def _name(h: int, a: int, b: int, left: bytes, right: bytes) -> str:
    """A name for the string that stands ``a`` bytes to the left and ``b`` to the right of anchor ``h``."""
    return hashlib.blake2b(b"%d:%d:%d:" % (h, a, b) + left[:a] + right[:b], digest_size=16).hexdigest()


def _inside(a: int, b: int, lower: int, upper: int, around: int) -> bool:
    """Whether a window inside the string has its least gram at the anchor; the next lesser grams are ``lower`` bytes before and ``upper`` bytes after it."""
    return max(-a, 1 - lower) <= min(0, b - around, upper - 1 - around)


def _lesser(data: np.ndarray, at: np.ndarray, gram: int, around: int) -> tuple[np.ndarray, np.ndarray]:
    """How far before and after each of these sorted places the next gram stands that an anchor would rather take, ``around`` + 1 if there is none so near."""
    lower, upper = np.full(at.size, around + 1), np.full(at.size, around + 1)
    grams = _Hashes(data, 0).grams(gram) >> np.uint64(24)  # as anchors compare them: ties go to the first
    for lo in range(0, at.size, 1024):
        own = at[lo : lo + 1024]
        for side, out in ((-1, lower), (1, upper)):
            where = own[:, None] + side * np.arange(1, around + 1)
            real = (where >= 0) & (where < grams.size)
            other = grams[np.clip(where, 0, grams.size - 1)]
            less = real & (other <= grams[own][:, None] if side < 0 else other < grams[own][:, None])
            out[lo : lo + 1024] = np.where(less.any(1), less.argmax(1) + 1, around + 1)
    return lower, upper


def _tree(strings: list[bytes]) -> Iterator[tuple[int, int, int]]:
    """(common prefix, first, last) of the intervals of sorted strings, and of those leaves that no other string begins with."""
    lcp = [agree(x, y) for x, y in zip(strings, strings[1:], strict=False)]
    yield from (x for x in intervals(lcp) if x[0] or 0 in lcp)  # the scan closes a root of depth 0 even where all agree further
    for k, x in enumerate(strings):
        if len(x) > max(lcp[k - 1] if k else -1, lcp[k] if k < len(lcp) else -1):
            yield len(x), k, k


def groups_of(lefts: list[bytes], rights: list[bytes], copies: list[int], near: list[tuple[int, int]], need: int, deep: int | None = None) -> Iterator[tuple[int, int, list[int]]]:
    """(bytes to the left, bytes to the right, leaves) of the maximal repeats of at least ``need`` bytes beyond the anchor.

    ``lefts`` are the bytes before the anchors, reversed; ``near`` tells how far before and after them a lesser gram stands. With ``deep`` only those of just so many bytes to the right.
    """
    order = sorted(range(len(rights)), key=rights.__getitem__)
    longest = max(map(len, lefts))
    for b, first, last in _tree([rights[i] for i in order]) if deep is None else [(deep, 0, len(order) - 1)]:
        if b + longest < need:
            continue
        inside = sorted(order[first : last + 1], key=lefts.__getitem__)
        for a, lo, hi in _tree([lefts[i] for i in inside]):
            part = inside[lo : hi + 1]
            if a + b >= need and _inside(a, b, *near[part[0]], need) and sum(copies[i] for i in part) > 1:
                after = {rights[i][b] if len(rights[i]) > b else None for i in part}
                if len(after) > 1 or None in after:
                    yield a, b, part


def _leaves(docs: DataFrame, length: int, gram: int, reach: int) -> DataFrame:
    """(h, f, rid, pos, left, right, lower, upper) of the anchors that occur twice; f is a hash of what stands around."""
    around = length - gram

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [anchors(np.frombuffer(x.encode(), np.uint8), length, gram) for x in b.column(1).to_pylist()]
            sizes = [len(at) for at, _, _ in found]
            if sum(sizes):
                at, h = (np.concatenate([x[k] for x in found]) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.repeat(b.column(0).to_numpy(), sizes)), pa.array(at.astype(np.int32))], names=["h", "rid", "pos"])

    def surrounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rid, x, wanted in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = x.encode()
                place = np.array([w["pos"] for w in wanted])
                cuts = [0, *(np.flatnonzero(np.diff(place // BLOCK)) + 1).tolist(), len(wanted)]
                for lo, hi in zip(cuts, cuts[1:], strict=False):
                    some, begin = wanted[lo:hi], max(0, int(place[lo]) - around)
                    lower, upper = _lesser(np.frombuffer(data[begin : int(place[hi - 1]) + gram + around], np.uint8), place[lo:hi] - begin, gram, around)
                    left = [data[max(0, w["pos"] - reach) : w["pos"]][::-1] for w in some]
                    right = [data[w["pos"] + gram : w["pos"] + gram + reach] for w in some]
                    f = np.array([xxhash.xxh64_intdigest(b"%d:" % len(p) + p + q) for p, q in zip(left, right, strict=True)], np.uint64).view(np.int64)
                    columns = [pa.array([w["h"] for w in some], pa.int64()), pa.array(f), pa.array([rid] * len(some), pa.int64()), pa.array([w["pos"] for w in some], pa.int32()), pa.array(left, pa.binary()), pa.array(right, pa.binary()), pa.array(lower, pa.int32()), pa.array(upper, pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, names=["h", "f", "rid", "pos", "left", "right", "lower", "upper"])

    every = staged(docs.where(F.octet_length("text") >= length).mapInArrow(sampled, "h long, rid long, pos int"), "groups-anchors")
    twice = staged(every.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "groups-repeated")
    wanted = every.join(twice, "h").groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("pos", "h"))).alias("wanted"))  # the anchors of one text
    return staged(docs.join(wanted, "rid").select("rid", "text", "wanted").mapInArrow(surrounded, "h long, f long, rid long, pos int, left binary, right binary, lower int, upper int"), "groups-leaves")


def _scan(leaves: DataFrame, need: int, n: int) -> DataFrame:
    """The groups of small trees, each scanned by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []

        def settle() -> None:
            if held:
                _, kind, deep = held[0][:3]
                for a, b, part in groups_of([r[6] for r in held], [r[7] for r in held], [r[5] for r in held], [r[8:10] for r in held], need, deep if kind else None):
                    _, _, _, h, _, _, left, right, *_ = held[part[0]]
                    name = _name(h, a, b, left, right)
                    out.extend((name, h, held[i][4], a, b) for i in part)
            held.clear()

        def rows() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["gid", "h", "f", "a", "b"])
            out.clear()
            return batch

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[0] != held[0][0]:
                    settle()
                    if len(out) > 10_000:
                        yield rows()
                held.append(row)
        settle()
        yield rows()

    names = [x.split()[0] for x in _LEAF.split(", ")]
    return leaves.select(*names).repartition(n, "node").sortWithinPartitions("node").mapInArrow(run, _FOUND)


def _closed(batches: Iterator[pa.RecordBatch], need: int) -> Iterator[pa.RecordBatch]:
    """(node, a, b, gid) of large trees from (node, kind, deep, h, least and greatest left, least and greatest right, lower, upper): how far all leaves agree; gid is null where that is no maximal repeat."""
    for batch in batches:
        out = []
        for node, kind, deep, h, l1, l2, r1, r2, lower, upper in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = agree(l1, l2), agree(r1, r2)
            if not kind or b == deep:  # what agrees further to the right is named by the path to the right
                out.append((node, a, b, _name(h, a, b, l1, r1) if a + b >= need and _inside(a, b, lower, upper, need) else None))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["node", "a", "b", "gid"])


def _found(forms: DataFrame, need: int, most: int, n: int) -> DataFrame:
    """(gid, h, f, a, b): the leaves of every maximal repeat."""
    found, ready = [], []
    open_ = forms.select(F.col("h").alias("node"), F.lit(0).alias("kind"), F.lit(0).alias("deep"), "h", "f", "n", "left", "right", "lower", "upper")
    while True:
        sizes = open_.groupBy("node").agg(F.count("*").alias("m"), F.sum("n").alias("total")).where("total > 1")
        sized = staged(open_.join(sizes, "node"), "groups-trees")
        ready.append(sized.where(F.col("m") <= most))
        large = sized.where(F.col("m") > most)
        if large.isEmpty():
            break
        ends = large.groupBy("node").agg(F.min("kind"), F.min("deep"), F.min("h"), F.min("left"), F.max("left"), F.min("right"), F.max("right"), F.min("lower"), F.min("upper"))
        closed = staged(ends.mapInArrow(lambda it: _closed(it, need), "node long, a int, b int, gid string"), "groups-closed")
        met = large.join(closed, "node")
        found.append(met.where("gid IS NOT NULL").select("gid", "h", "f", "a", "b"))
        after = lambda side, at: F.substring(F.col(side), F.col(at) + 1, 1)
        child = lambda kind, side, at: F.xxhash64("node", F.lit(kind), "b", after(side, at)).alias("node")
        rest = ["h", "f", "n", "left", "right", "lower", "upper"]
        right = met.where((F.col("kind") == 0) & (F.length("right") > F.col("b"))).select(child(0, "right", "b"), F.lit(0).alias("kind"), F.lit(0).alias("deep"), *rest)
        left = met.where((F.length("left") > F.col("a")) & (F.length("left") + F.col("b") >= need)).select(child(1, "left", "a"), F.lit(1).alias("kind"), F.col("b").alias("deep"), *rest)
        open_ = staged(right.unionByName(left), "groups-children")
    trees = ready[0]
    for more in ready[1:]:
        trees = trees.unionByName(more)
    out = _scan(trees, need, n)
    for more in found:
        out = out.unionByName(more)
    return out


def _chained(pieces: DataFrame) -> DataFrame:
    """group_id, n_occurrences, n_bytes, rid, start, end from pieces (gid, rid, start, end): pieces with the same places that overlap are one string.

    Places are the same if they are as many, begin at one place and stand alike to it (two 64-bit sums of hashes); only the pieces of one such set of places meet in a window.
    """
    first = pieces.groupBy("gid").agg(F.min(F.struct("rid", "start")).alias("rep"), F.count("*").alias("n"))
    away = F.col("start") - F.col("rep.start")
    marks = [F.bit_xor(F.xxhash64("rid", away)).alias("x"), F.bit_xor(F.xxhash64(away, "rid", F.lit(1))).alias("y")]
    signed = pieces.join(first, "gid").groupBy("gid").agg(*marks, F.first("n").alias("n"), F.first("rep.rid").alias("rid"), F.first("rep.start").alias("start"), F.first(F.col("end") - F.col("start")).alias("size"))
    same = ["rid", "n", "x", "y"]
    order = Window.partitionBy(*same).orderBy("start", F.desc("size"), "gid")
    before = F.max(F.col("start") + F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    chain = signed.withColumn("new", (F.col("start") > F.coalesce(before, F.lit(-1))).cast("int")).withColumn("chain", F.sum("new").over(order))
    heads = chain.groupBy(*same, "chain").agg(
        F.min_by("gid", F.struct("start", -F.col("size"), "gid")).alias("gid"), (F.max(F.col("start") + F.col("size")) - F.min("start")).cast("long").alias("n_bytes"),
    ).select("gid", F.col("n").alias("n_occurrences"), "n_bytes")
    return pieces.join(heads, "gid").select(F.col("gid").alias("group_id"), "n_occurrences", "n_bytes", "rid", "start", (F.col("start") + F.col("n_bytes")).alias("end"))


def repeat_groups(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, reach: int | None = None, forms: int = FORMS) -> DataFrame:
    """group_id, n_occurrences, n_bytes, rid, start, end: a row for each occurrence of each maximal repeat of ``length`` bytes or more.

    ``docs`` has rid (a long that tells rows apart) and text; other columns are ignored. ``reach`` is how many bytes on either side of an anchor
    take part, ``length`` - ``gram`` at least and by default. Repeats of up to ``gram`` + ``reach`` bytes are those of the plain definition; a
    longer one is a group as far as the same places share it. Occurrences may overlap, in one text too. Repeated rows are occurrences of
    each other. Null and short texts, and rows with a null rid, have none. Empty in, empty out.
    """
    reach = max(reach or 0, length - gram)
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = docs.select(F.col("rid").cast("long").alias("rid"), F.col("text").cast("string").alias("text")).where("rid IS NOT NULL AND text IS NOT NULL")
    with batches_of(spark, BATCH_ROWS):
        leaves = _leaves(plain, length, gram, reach)
        shapes = staged(leaves.groupBy("h", "f").agg(F.count("*").alias("n"), F.first("left").alias("left"), F.first("right").alias("right"), F.first("lower").alias("lower"), F.first("upper").alias("upper")), "groups-forms")
        found = staged(_found(shapes, length - gram, forms, n), "groups-found")
    spans = leaves.select("h", "f", "rid", "pos").join(found, ["h", "f"]).select(
        "gid", "rid", (F.col("pos") - F.col("a")).cast("long").alias("start"), (F.col("pos") + gram + F.col("b")).cast("long").alias("end")
    )
    return _chained(staged(spans, "groups-pieces"))
