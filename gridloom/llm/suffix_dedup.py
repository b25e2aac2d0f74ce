"""Removal of repeated byte strings by an enhanced suffix array over sampled suffixes.

Every string of LENGTH bytes holds an anchor: the GRAM bytes whose hash is the least in it, so two equal strings have equal anchors at
equal places. Only suffixes at anchors are sorted, and only those whose anchor occurs twice. Suffixes with one anchor, their bytes to
the right sorted and with the common prefixes of neighbours, form a tree of common-prefix intervals. A stack scan visits its
intervals; in each, the bytes to the left of the occurrences, sorted from the right, tell how far which of them agree to the left. An interval
whose prefix and left agreement make up LENGTH bytes is a repeat, with all its occurrences.

The suffix array of all anchors is dealt out by ranges, so an anchor with any number of surroundings spreads over tasks; each task scans the
intervals of its range. Occurrences in different ranges agree to the right exactly as far as both agree with a suffix at a range's end
between them. Those of an anchor that crosses range ends are sorted once more, by what stands left of them, under each of the few range ends that
halve the anchor's ranges again and again; the same scan then settles what lies in one range of that order. What lies in two ranges of both orders is told
by two numbers, the agreement with a range's end on either side, and a count of them for each possible string of LENGTH bytes.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import small_batches, staged, unstage, unused, without

#: Bytes of a repeat and bytes of an anchor.
LENGTH, GRAM = 200, 48
#: Bytes scanned for anchors at a time.
BLOCK = 1 << 20
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_POS_BITS = np.uint64(24)


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64; the base is odd, so it has an inverse."""
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    with np.errstate(over="ignore"):
        return tuple(np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n - 1, b, np.uint64))]) if n else np.empty(0, np.uint64) for b in (base, inverse))


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class _Hashes:
    """Hashes of any substrings of a block in constant time each."""

    _tables: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def __init__(self, data: np.ndarray, which: int):
        size = 1 << max(12, int(data.size).bit_length())
        if size not in self._tables:
            self._tables[size] = [_powers(b, size) for b in _BASES]
        up, self.down = self._tables[size][which]
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: data.size], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mix((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, k: int) -> np.ndarray:
        n = self.sums.size - k
        with np.errstate(over="ignore"):
            return _mix((self.sums[k:] - self.sums[:n]) * self.down[:n])


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` keys, by running minima of blocks from both ends."""
    n = keys.size - width + 1
    padded = np.concatenate([keys, np.full(-keys.size % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the anchors of all strings of ``length`` bytes, hashes of their grams, and hashes of all that such strings around them hold."""
    around, out = length - gram, []
    for lo in range(0, data.size - length + 1, block):
        # the windows that start in [lo, lo + block), and what surrounds their anchors
        left = max(0, lo - around)
        part = data[left : lo + block + length - 1 + around]
        h = _Hashes(part, 0)
        grams = h.grams(gram)
        first, n = lo - left, min(block, data.size - length + 1 - lo)
        own = grams[first : first + n + around]
        keys = (own >> _POS_BITS << _POS_BITS) | np.arange(own.size, dtype=np.uint64)
        at = first + np.unique(_least(keys, around + 1) & ((np.uint64(1) << _POS_BITS) - np.uint64(1))).astype(np.int64)
        start, end = np.maximum(at - around, 0), np.minimum(at + gram + around, part.size)
        clips = ((at - start) * (around + 1) + (end - at - gram)).astype(np.uint64)
        with np.errstate(over="ignore"):
            whole = _mix(_Hashes(part, 1).of(start, end) + clips)
        out.append((at + left, grams[at], whole))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    at, g, w = map(np.concatenate, zip(*out, strict=True))
    at, i = np.unique(at, return_index=True)
    return at, g[i], w[i]


def agree(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    diff = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (diff.bit_length() + 7) // 8


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(common prefix, first, last) of the intervals of a suffix array with these common prefixes of neighbours, children before parents."""
    stack = [(0, 0)]
    for i, x in enumerate([*lcp, -1], 1):
        start = i - 1
        while stack and stack[-1][0] > x:
            depth, start = stack.pop()
            if i - 1 > start:
                yield depth, start, i - 1
        if not stack or stack[-1][0] < x:
            stack.append((x, start))


def extents(lefts: list[bytes], rights: list[bytes], need: int) -> tuple[list[int], list[int]]:
    """How far repeats of at least ``need`` bytes beyond the anchor reach to the left and right of each occurrence; -1 if there is none.

    ``lefts`` are the bytes before the anchors, reversed; ``rights`` those after them.
    """
    m = len(lefts)
    far_left, far_right = [-1] * m, [-1] * m
    if m == 2:
        a, b = agree(*lefts), agree(*rights)
        return ([a, a], [b, b]) if a + b >= need else (far_left, far_right)
    order = sorted(range(m), key=rights.__getitem__)
    lcp = [agree(rights[x], rights[y]) for x, y in zip(order, order[1:], strict=False)]
    by_left = sorted(range(m), key=lefts.__getitem__)
    place = np.empty(m, np.int64)
    place[by_left] = np.arange(m)
    near = np.array([agree(lefts[x], lefts[y]) for x, y in zip(by_left, by_left[1:], strict=False)], np.int64)
    near_end, longest = np.append(near, 0), int(near.max())
    suffixes = np.array(order)
    for depth, a, b in intervals(lcp):
        if depth + longest < need:
            continue
        spots = np.sort(place[suffixes[a : b + 1]])
        # agreement of left neighbours within the interval: the least on the way between them
        left = np.minimum.reduceat(near_end, spots)[:-1]
        best = np.maximum(np.concatenate([[0], left]), np.concatenate([left, [0]]))
        for k in np.flatnonzero(best + depth >= need).tolist():
            i = by_left[spots[k]]
            far_left[i], far_right[i] = max(far_left[i], int(best[k])), max(far_right[i], depth)
    return far_left, far_right


def nested(depths: list[int], lefts: list[bytes], need: int) -> tuple[list[int], list[int]]:
    """As ``extents`` for occurrences sorted by ``lefts`` of which two agree to the right as far as the lesser of their ``depths``.

    The same stack scan over the common prefixes of what stands to the left; in an interval the best partner is the deepest other one.
    """
    m = len(lefts)
    far_left, far_right, depth = np.full(m, -1), np.full(m, -1), np.array(depths)
    for a, first, last in intervals([agree(x, y) for x, y in zip(lefts, lefts[1:], strict=False)]):
        part = depth[first : last + 1]
        top = int(part.argmax())
        second = int(max(part[:top].max(initial=-1), part[top + 1 :].max(initial=-1)))
        if a + second < need:
            continue
        reach = np.minimum(part, part[top])
        reach[top] = second
        ok = np.flatnonzero(reach + a >= need)
        far_left[first + ok] = np.maximum(far_left[first + ok], a)
        far_right[first + ok] = np.maximum(far_right[first + ok], reach[ok])
    return far_left.tolist(), far_right.tolist()


_ENDS = "h long, f long, l int, r int"
_ENDS_ARROW = [("h", pa.int64()), ("f", pa.int64()), ("l", pa.int32()), ("r", pa.int32())]
_SCAN = f"{_ENDS}, pid int, edge int, key long, side binary, tie long"
_SCAN_ARROW = [*_ENDS_ARROW, ("pid", pa.int32()), ("edge", pa.int32()), ("key", pa.int64()), ("side", pa.binary()), ("tie", pa.int64())]


class _Rows:
    """Rows that leave as batches."""

    def __init__(self, kinds: list[tuple[str, pa.DataType]], size: int = 10_000):
        self.kinds, self.size, self.columns = kinds, size, [[] for _ in kinds]

    def add(self, *row) -> None:
        for c, v in zip(self.columns, row, strict=True):
            c.append(v)

    def flush(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if len(self.columns[0]) >= least:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(self.columns, self.kinds, strict=True)], names=[n for n, _ in self.kinds])
            self.columns = [[] for _ in self.kinds]

    def full(self) -> Iterator[pa.RecordBatch]:
        return self.flush(self.size)


def _scan(batches: Iterator[pa.RecordBatch], solve: Callable[[list[tuple]], tuple[list[int], list[int]]]) -> Iterator[pa.RecordBatch]:
    """Extents within runs of one key of rows (key, side, tie, h, f, ...) in sorted order, and the first and last row of the range as edges."""
    pid, out, held, last = TaskContext.get().partitionId(), _Rows(_SCAN_ARROW), [], None

    def settle() -> None:
        if len(held) > 1:
            for row, a, b in zip(held, *solve(held), strict=True):
                if a >= 0:
                    out.add(row[3], row[4], a, b, pid, 0, None, None, None)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if last is None:
                out.add(row[3], row[4], -1, -1, pid, 1, *row[:3])
            elif row[0] != last[0]:
                settle()
                held = []
                yield from out.full()
            held.append(row)
            last = row
    if last is not None:
        settle()
        out.add(last[3], last[4], -1, -1, pid, 2, *last[:3])
    yield from out.flush()


def _ranges(scanned: DataFrame) -> tuple[dict[int, list[tuple[bytes, int]]], dict[int, list[tuple[int, int, int]]]]:
    """For each key that crosses range ends: the last rows (side, tie) before them, and a balanced tree over them as nodes (number, lower, upper).

    Two rows a range come to the driver, a range being a task's share of the sort.
    """
    ends: dict[int, list[tuple[bytes, int]]] = {}
    edges = sorted(scanned.where("edge > 0").select("pid", "edge", "key", "side", "tie").collect())
    for before, after in zip(edges[1::2], edges[2::2], strict=False):
        if before["key"] == after["key"]:
            ends.setdefault(before["key"], []).append((bytes(before["side"]), before["tie"]))
    nodes, numbers = {}, count()
    for key, rows in ends.items():
        spans, nodes[key] = [(0, len(rows))], []
        while spans:
            lo, hi = spans.pop()
            if lo < hi:
                nodes[key].append((next(numbers), lo, hi))
                spans += [(lo, (lo + hi) // 2), ((lo + hi) // 2 + 1, hi)]
    return ends, nodes


def _above(ends: list[tuple[bytes, int]], nodes: list[tuple[int, int, int]], side: bytes, tie: int) -> Iterator[tuple[int, int]]:
    """(node, agreement with the range end of the node) for the nodes over the range of a row: any two rows in different ranges part at one of them."""
    at = bisect_left(ends, (side, tie))
    for node, lo, hi in nodes:
        if lo <= at <= hi:
            yield node, agree(side, ends[(lo + hi) // 2][0])


def _across(contexts: DataFrame, scanned: DataFrame, around: int, n: int) -> DataFrame | None:
    """(h, f, l, r) that occurrences (h, f, lefts, rights) reach with those in other ranges of the suffix array; None if no anchor crosses a range end.

    Driver and closures hold a row for each range end, and ``around`` + 1 bits for each in the second order.
    """
    ends, nodes = _ranges(scanned)
    if not ends:
        return None

    def deepen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows([("node", pa.int64()), ("lefts", pa.binary()), ("tie", pa.int64()), ("h", pa.int64()), ("f", pa.int64()), ("depth", pa.int32())])
        for b in batches:
            for h, f, lefts, rights in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for node, depth in _above(ends[h], nodes[h], rights, f):
                    if depth + len(lefts) >= around:
                        out.add(node, lefts, f, h, f, depth)
            yield from out.full()
        yield from out.flush()

    crossing = contexts.where(F.col("h").isin(list(ends))).select("h", "f", "lefts", "rights")
    deep = staged(crossing.mapInArrow(deepen, "node long, lefts binary, tie long, h long, f long, depth int"), "suffix-crossing")
    order = ("node", "lefts", "tie")
    dealt = deep.repartitionByRange(n, *order).sortWithinPartitions(*order)
    again = staged(dealt.mapInArrow(lambda it: _scan(it, lambda rows: nested([r[5] for r in rows], [r[1] for r in rows], around)), _SCAN), "suffix-lefts")
    found = again.where("edge = 0").select("h", "f", "l", "r")
    left_ends, left_nodes = _ranges(again)
    if not left_ends:
        return found
    twice_crossing = deep.where(F.col("node").isin(list(left_ends)))

    def corners(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, list[tuple[int, int]]]]:
        """(h, f, least, [(node of the second order, most)]) of rows that may lie in a repeat with one beyond a node's end: one that starts ``least`` to ``most`` bytes before."""
        for node, lefts, tie, h, f, depth in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            spots = [(second, left) for second, left in _above(left_ends[node], left_nodes[node], lefts, tie) if left + depth >= around]
            if spots:
                yield h, f, around - depth, spots

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for _, _, least, spots in corners(b):
                for second, most in spots:
                    sums.setdefault(second, np.zeros(around + 1, np.int64))[least : most + 1] += 1
        out = _Rows([("second", pa.int64()), ("left", pa.int32()), ("n", pa.int64())])
        for second, row in sums.items():
            for left in np.flatnonzero(row).tolist():
                out.add(second, left, int(row[left]))
            yield from out.full()
        yield from out.flush()

    # the string that starts ``left`` bytes before the anchor is a repeat if two rows hold it; a row a string and range end comes to the driver
    totals = twice_crossing.mapInArrow(counted, "second long, left int, n long").groupBy("second", "left").agg(F.sum("n").alias("n"))
    repeated: dict[int, np.ndarray] = {}
    for row in totals.where("n > 1").collect():
        repeated.setdefault(row["second"], np.zeros(around + 1, bool))[row["left"]] = True

    def cornered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(_ENDS_ARROW)
        for b in batches:
            for h, f, least, spots in corners(b):
                starts = [least + np.flatnonzero(repeated[second][least : most + 1]) for second, most in spots if second in repeated]
                if any(x.size for x in starts):
                    out.add(h, f, max(int(x[-1]) for x in starts if x.size), around - min(int(x[0]) for x in starts if x.size))
            yield from out.full()
        yield from out.flush()

    return found.unionByName(twice_crossing.mapInArrow(cornered, _ENDS)) if repeated else found


def _release(spark) -> None:
    """Let Spark drop the shuffle files of plans that are done; what is still needed is in written tables."""
    spark.sparkContext._jvm.System.gc()


def repeats(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """rid, spans: for each text (columns rid and text) the byte ranges that strings of ``length`` bytes occurring elsewhere cover.

    ``rid`` stands for a row; rows may share it only if their texts are equal. Spans overlap as they were found.
    """
    spark = docs.sparkSession
    n, around = int(spark.conf.get("spark.sql.shuffle.partitions")), length - gram
    small_batches(spark)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [anchors(np.frombuffer(x.encode(), np.uint8), length, gram) for x in b.column(1).to_pylist()]
            sizes = [len(a) for a, _, _ in found]
            if sum(sizes):
                at, h, f = map(np.concatenate, zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(f.view(np.int64)), pa.array(np.repeat(b.column(0).to_numpy(), sizes)), pa.array(at.astype(np.int32))], names=["h", "f", "rid", "pos"])

    plain = docs.select("rid", "text")
    every = staged(plain.where(F.octet_length("text") >= length).mapInArrow(sampled, "h long, f long, rid long, pos int"), "suffix-anchors")
    # written first: a join straight over two exchanges is one whose crowded keys Spark can split
    twice = staged(every.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "suffix-repeated")
    occ = staged(every.join(twice, "h"), "suffix-occurrences")
    unstage(spark, every)
    _release(spark)
    forms = staged(occ.groupBy("h", "f").agg(F.count("*").alias("n"), F.min(F.struct("rid", "pos")).alias("one")), "suffix-forms")
    mixed = staged(forms.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h"), "suffix-mixed")
    ones = forms.join(mixed, "h").groupBy("one.rid").agg(F.collect_list(F.struct("h", "f", "one.pos")).alias("wanted"))

    def surrounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = _Rows([("h", pa.int64()), ("f", pa.int64()), ("lefts", pa.binary()), ("rights", pa.binary())])
            for x, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = x.encode()
                for w in wanted:
                    p = w["pos"]
                    out.add(w["h"], w["f"], data[max(0, p - around) : p][::-1], data[p + gram : p + gram + around])
                yield from out.full()
            yield from out.flush()

    texts = plain.join(ones, "rid").select("text", "wanted").mapInArrow(surrounded, "h long, f long, lefts binary, rights binary")
    contexts = staged(texts, "suffix-contexts")
    _release(spark)
    order = ("h", "rights", "f")
    dealt = contexts.select("h", "rights", F.col("f").alias("tie"), F.col("h").alias("hh"), "f", "lefts").repartitionByRange(n, *order).sortWithinPartitions(*order)
    scanned = staged(dealt.mapInArrow(lambda it: _scan(it, lambda rows: extents([r[5] for r in rows], [r[1] for r in rows], around)), _SCAN), "suffix-tree")
    reach = scanned.where("edge = 0").select("h", "f", "l", "r")
    across = _across(contexts, scanned, around, n)
    if across is not None:
        reach = reach.unionByName(across)
    # equal surroundings reach to their full extent; it is cut at the ends of the text later
    reach = reach.unionByName(forms.where("n > 1").select("h", "f", F.lit(around).alias("l"), F.lit(around).alias("r")))
    best = staged(reach.groupBy("h", "f").agg(F.max("l").alias("l"), F.max("r").alias("r")), "suffix-reach")
    spans = occ.join(best, ["h", "f"]).select("rid", F.struct((F.col("pos") - F.col("l")).alias("start"), (F.col("pos") + gram + F.col("r")).alias("end")).alias("span"))
    out = staged(spans.groupBy("rid").agg(F.collect_set("span").alias("spans")), "suffix-spans")
    _release(spark)
    return out


def _merge(spans: list[dict] | None, size: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((max(0, s["start"]), min(size, s["end"])) for s in spans or []):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        elif b > a:
            out.append([a, b])
    return [tuple(x) for x in out]


def _whole_characters(parts: list[bytes]) -> str:
    """The characters that lie in one part whole; those that lost some of their bytes go."""
    return "".join(p.decode(errors="ignore") for p in parts)


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", as_text: bool = False, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` without the text but with kept (the remaining bytes), n_bytes, n_removed, n_spans and removed (ranges of bytes).

    With ``as_text`` kept is a string of the characters that lost no byte.

    A byte goes if a string of ``length`` bytes that covers it starts anywhere else too, in another text or the same one; all is judged on the
    input. Every row stays: repeated rows are copies of each other and lose what they share. Null texts count as empty; texts under
    ``length`` bytes lose nothing. Columns named like results are replaced. Empty in, empty out.
    """
    added = ["kept", "n_bytes", "n_removed", "n_spans", "removed"]
    keep = without(docs, text, *added)
    data, row, found_row, spans = unused(docs, "text_", "row_", "found_row_", "spans_")
    texts = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias(data))
    src = texts.withColumn(row, F.xxhash64(F.col(f"`{doc_id}`").cast("string"), F.col(data)))
    found = repeats(src.select(F.col(row).alias("rid"), F.col(data).alias("text")), length=length, gram=gram)
    small_batches(docs.sparkSession)
    found = found.withColumnsRenamed({"rid": found_row, "spans": spans})
    joined = src.join(found, F.col(row) == F.col(found_row), "left").select(*[F.col(f"`{c}`") for c in keep], data, spans)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, sizes, removed = [], [], []
            for x, spans in zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                data = x.encode()
                gone = _merge(spans, len(data))
                edges = [0, *(e for s in gone for e in s), len(data)]
                parts = [data[p:q] for p, q in zip(edges[::2], edges[1::2], strict=True)]
                kept.append(_whole_characters(parts) if as_text else b"".join(parts))
                sizes.append((len(data), sum(q - p for p, q in gone), len(gone)))
                removed.append([{"start": p, "end": q} for p, q in gone])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(kept, pa.string() if as_text else pa.binary()), *[pa.array(c, pa.int64()) for c in zip(*sizes, strict=True)], pa.array(removed, kind)], names=[*keep, *added])

    schema = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields[:-2]), f"kept {'string' if as_text else 'binary'}", "n_bytes long", "n_removed long", "n_spans long", "removed array<struct<start:int,end:int>>"]
    return joined.mapInArrow(cut, ", ".join(schema))


