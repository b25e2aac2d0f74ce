"""The trie of conversation prefixes, from sorted conversations.

Distinct conversations are sorted by their turns, and each is compared with the one before it: the number of turns that both start with is the LCP array.
Its Cartesian tree is the compressed trie: the node of an entry reaches left and right to the nearest smaller entries, and equal entries between the same
two make one node. Nearest smaller entries are found in blocks with a stack; those that lie beyond a block are looked for in the least entries of
blocks first, then in the running minima of the one block that is left. Depths at which nothing branches are filled in, and what a node counts are
differences of running sums at its two ends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import staged

#: Fixed values of the contract: whose turns a conversation starts with, and of how many of them; what a word is.
FAMILY, HEADS, WORD = 20, 4, r"[^\x20\x09-\x0D]+"
#: Distinct conversations of a block; one row for each block comes to the driver.
BLOCK = 1 << 15
#: Bytes of decimal ids that are hashed at a time.
PIECE = 1 << 16

_END = pa.struct([(n, pa.int64()) for n in ("block", "at", "a", "least", "n", "x", "d", "leaves", "size")] + [("sid", pa.string()), ("lo", pa.bool_()), ("ro", pa.bool_())])
_END_SQL = "struct<block:bigint,at:bigint,a:bigint,least:bigint,n:bigint,x:bigint,d:bigint,leaves:bigint,size:bigint,sid:string,lo:boolean,ro:boolean>"
_SUMMARY = pa.schema([("kind", pa.string()), ("block", pa.int64()), ("v", pa.int64()), ("lo", pa.bool_()), ("ro", pa.bool_()), ("q", pa.int64()), ("words", pa.list_(pa.int64())), ("l", _END), ("r", _END)])
_SUMMARY_SQL = f"kind string, block long, v long, lo boolean, ro boolean, q long, words array<long>, l {_END_SQL}, r {_END_SQL}"
_NODE = pa.schema([(n, pa.int64()) for n in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")] + [("sid", pa.string())])
_NODE_SQL = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, sid string"


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id, ds, ws: a 128-bit digest and the number of words of each turn of ``turns`` (conv_id, turn, role, text), in order.

    Null turns come first, a null role or text is an empty one, turns of the same number stand in the order of role and digest, repeated rows are turns of their
    own. Rows without a conv_id belong to no conversation. A conversation is one row of about 24 bytes a turn.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    turn = F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), digest.alias("d"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("w"))
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select("conv_id", F.col("t.d").alias("ds"), F.col("t.w").alias("ws"))


def with_family_heads(convs: DataFrame) -> DataFrame:
    """Each conversation c with the first h turns of conversation c - c % 20 (all if fewer, none if absent) for its own first h; h is the crc32 of the decimal c modulo 4."""
    heads = convs.select(F.col("conv_id").alias("base"), F.slice("ds", 1, HEADS - 1).alias("base_ds"), F.slice("ws", 1, HEADS - 1).alias("base_ws"))
    own = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int"))

    def joined(c: str) -> F.Column:
        head = F.when(F.col(f"base_{c}").isNotNull(), F.slice(f"base_{c}", F.lit(1), F.col("h"))).otherwise(F.slice(c, 1, 0))
        return F.concat(head, F.slice(c, F.col("h") + 1, F.greatest(F.size(c) - F.col("h"), F.lit(0)))).alias(c)

    return own.join(heads, "base", "left").select("conv_id", joined("ds"), joined("ws"))


def _shared(a: list, b: list) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _laid_out(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (sid, conv, n, ds, ws) in blocks, each with the turns it shares with the row before it (null for the first row of a partition)."""
    part, at, last = TaskContext.get().partitionId(), 0, None
    for b in batches:
        lcp = []
        for ds in b.column(3).to_pylist():
            lcp.append(None if last is None else _shared(last, ds))
            last = ds
        place = np.arange(at, at + b.num_rows)
        at += b.num_rows
        columns = [pa.array((part << 32) + place // block), pa.array(place % block), b.column(0), b.column(1), b.column(2), b.column(3), b.column(4), pa.array(lcp, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["block", "at", "sid", "conv", "n", "ds", "ws", "lcp"])


class _Block:
    """A block of sorted conversations with its entries of the LCP array, and the first of the next block as one more."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        t = pa.Table.from_batches(list(batches)).sort_by("at")
        self.block = t["block"][0].as_py()
        self.sid, self.conv, self.n = t["sid"].to_pylist(), t["conv"].to_numpy(), t["n"].to_numpy()
        self.words = [np.concatenate([[0], np.cumsum(np.array(w, np.int64))]).astype(np.int64) for w in t["ws"].to_pylist()]
        self.size = np.array([w.size - 1 for w in self.words])
        self.k = k = len(self.sid)
        self.a = np.append(t["a"].to_numpy(), t["next"][k - 1].as_py())
        self.left, self.right = np.full(k + 1, -1), np.full(k + 1, k + 1)
        stack: list[int] = []
        for i, v in enumerate(self.a.tolist()):
            while stack and self.a[stack[-1]] > v:
                self.right[stack.pop()] = i
            # of equal entries below, all but the first have the same nearest smaller one
            self.left[i] = self.left[stack[-1]] if stack and self.a[stack[-1]] == v else stack[-1] if stack else -1
            stack.append(i)
        self.lo, self.ro = self.left < 0, self.right > k
        total = np.array([w[-1] for w in self.words])
        sums = lambda x: np.concatenate([[0], np.cumsum(x)])
        self.sum_n, self.sum_x = sums(self.n), sums(self.n * total)
        self.sum_d = sums(total - np.array([w[max(a, 0)] for w, a in zip(self.words, self.a.tolist(), strict=False)]))
        self.childless = self.size > self.a[1:]
        self.sum_leaves = sums(self.childless)

    def of(self, i: int) -> np.ndarray:
        """Running word counts of a conversation that starts with what entry ``i`` stands for."""
        return self.words[min(i, self.k - 1)]

    def end(self, i: int, least: int | None) -> dict:
        row = {"size": int(self.size[i]), "sid": self.sid[i]} if i < self.k else {"size": None, "sid": None}
        sums = {"n": int(self.sum_n[i]), "x": int(self.sum_x[i]), "d": int(self.sum_d[i]), "leaves": int(self.sum_leaves[i])}
        return row | sums | {"block": self.block, "at": i, "a": int(self.a[i]), "least": least, "lo": bool(self.lo[i]), "ro": bool(self.ro[i])}


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a block: its totals, the groups of equal entries whose node reaches beyond it, and its running minima from either side."""
    b = _Block(batches)
    k, a = b.k, b.a
    from_left, from_right = np.minimum.accumulate(b.conv), np.minimum.accumulate(b.conv[::-1])[::-1]
    before = lambda i: int(from_left[i - 1]) if i else None
    after = lambda i: int(from_right[i]) if i < k else None
    rows = [{"kind": "block", "block": b.block, "v": int(a[:k].min()), "q": k, "r": b.end(k, before(k))}]
    groups: dict[tuple, list[int]] = {}
    for i in np.flatnonzero((b.lo | b.ro) & (a >= 0)).tolist():
        groups.setdefault((int(a[i]), bool(b.lo[i]), bool(b.ro[i])), []).append(i)
    for (v, lo, ro), at in groups.items():
        i = at[0]
        row = {"kind": "group", "block": b.block, "v": v, "lo": lo, "ro": ro, "q": sum(x < k for x in at), "words": b.of(i)[: v + 1].tolist()}
        if not lo:
            row["l"] = b.end(int(b.left[i]), after(int(b.left[i])))
        if not ro:
            row["r"] = b.end(int(b.right[i]), before(int(b.right[i])))
        rows.append(row)
    least = np.minimum.accumulate(np.append(np.iinfo(np.int64).max, a[:k]))
    rows += [{"kind": "right", "block": b.block, "r": b.end(i, before(i))} for i in np.flatnonzero(a[:k] < least[:-1]).tolist()]
    least = np.minimum.accumulate(np.append(a[:k], np.iinfo(np.int64).max)[::-1])[::-1]
    rows += [{"kind": "left", "block": b.block, "l": b.end(i, after(i))} for i in np.flatnonzero(a[:k] < least[1:]).tolist()]
    yield pa.RecordBatch.from_pylist(rows, schema=_SUMMARY)


class _Minima:
    """Least entries, least ids and running sums of blocks in order, for look-ups."""

    def __init__(self, blocks: list):
        self.ids = np.array([b["block"] for b in blocks], np.int64)
        self.low, self.conv = self._levels([b["v"] for b in blocks]), self._levels([b["r"]["least"] for b in blocks])
        self.sums = {c: np.concatenate([[0], np.cumsum([b["r"][c] for b in blocks])]).astype(np.int64) for c in ("n", "x", "d", "leaves")}
        self.sums["at"] = np.concatenate([[0], np.cumsum([b["q"] for b in blocks])]).astype(np.int64)

    @staticmethod
    def _levels(x: list) -> list[np.ndarray]:
        out = [np.array(x, np.int64)]
        while out[-1].size > 1 << (len(out) - 1):
            step = 1 << (len(out) - 1)
            out.append(np.minimum(out[-1][:-step], out[-1][step:]))
        return out

    def place(self, block: int) -> int:
        return int(np.searchsorted(self.ids, block))

    def before(self, block: int, v: int) -> int:
        """The nearest earlier block with an entry under ``v``."""
        i = self.place(block)
        for level in range(len(self.low) - 1, -1, -1):
            while (j := i - (1 << level)) >= 0 and self.low[level][j] >= v:
                i = j
        return int(self.ids[i - 1])

    def after(self, block: int, v: int) -> int | None:
        """The nearest later block with an entry under ``v``; None where the array ends first."""
        i = self.place(block) + 1
        for level in range(len(self.low) - 1, -1, -1):
            while i + (1 << level) <= self.ids.size and self.low[level][i] >= v:
                i += 1 << level
        return int(self.ids[i]) if i < self.ids.size else None

    def least(self, low: int, high: int) -> int | None:
        """The least id of the blocks at places ``low`` to ``high`` - 1."""
        if low >= high:
            return None
        level = (high - low).bit_length() - 1
        return int(min(self.conv[level][low], self.conv[level][high - (1 << level)]))

    def total(self, column: str, end: dict) -> int:
        return int(self.sums[column][self.place(end["block"])]) + end[column]


def _targets(batches: Iterator[pa.RecordBatch], minima: _Minima) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = b.to_pylist()
        for r in rows:
            r["tl"] = minima.before(r["block"], r["v"]) if r["lo"] else None
            r["tr"] = minima.after(r["block"], r["v"]) if r["ro"] else None
        yield pa.RecordBatch.from_pylist(rows, schema=_SUMMARY.append(pa.field("tl", pa.int64())).append(pa.field("tr", pa.int64())))


def _met(side: str):
    """Groups (left) aimed at a block with its running minima (right): each takes the nearest that is smaller."""

    def run(groups: pa.Table, chain: pa.Table) -> pa.Table:
        rows, ends = groups.to_pylist(), sorted((r[side] for r in chain.to_pylist()), key=lambda e: e["at"])
        values = np.array([e["a"] for e in ends], np.int64)
        for r in rows:
            at = np.searchsorted(values, r["v"]) - 1 if side == "l" else np.searchsorted(-values, -r["v"], side="right")
            r[side] = ends[int(at)]
        return pa.Table.from_pylist(rows, schema=groups.schema)

    return run


def _resolved(batches: Iterator[pa.RecordBatch], minima: _Minima) -> Iterator[pa.RecordBatch]:
    """Groups with both ends: global places, what lies between them, and which group of which block is the parent."""
    for b in batches:
        out = []
        for r in b.to_pylist():
            l, e = r["l"], r["r"]
            last = minima.ids.size if e is None else minima.place(e["block"])
            a_r = -1 if e is None else e["a"]
            first = minima.place(l["block"])
            if e is not None and l["block"] == e["block"]:
                raise ValueError("a node inside a block has no open end")
            parts = [l["least"], minima.least(first + 1, last), None if e is None else e["least"]]
            total = lambda c: int(minima.sums[c][-1]) if e is None else minima.total(c, e)  # noqa: B023, E731
            own = {c: total(c) - minima.total(c, l) for c in ("n", "x", "d", "leaves")}
            up = l if l["a"] >= a_r else e
            out.append({
                "block": r["block"], "v": r["v"], "lo": r["lo"], "ro": r["ro"], "q": r["q"], "words": r["words"], "first": minima.total("at", l), "past": total("at"),
                "pv": max(l["a"], a_r), "al": l["a"], "conv": min(p for p in parts if p is not None), "size": l["size"], "sid": l["sid"], **own,
                "up_block": up["block"], "up_lo": up["lo"], "up_ro": up["ro"],
            })
        yield pa.RecordBatch.from_pylist(out, schema=_RESOLVED)


_RESOLVED = pa.schema(
    [("block", pa.int64()), ("v", pa.int64()), ("lo", pa.bool_()), ("ro", pa.bool_()), ("q", pa.int64()), ("words", pa.list_(pa.int64()))]
    + [(n, pa.int64()) for n in ("first", "past", "pv", "al", "conv", "size", "n", "x", "d", "leaves", "up_block")] + [("sid", pa.string()), ("up_lo", pa.bool_()), ("up_ro", pa.bool_())]
)
_RESOLVED_SQL = (
    "block long, v long, lo boolean, ro boolean, q long, words array<long>, first long, past long, pv long, al long, conv long, size long, n long, x long, d long, leaves long, up_block long, "
    "sid string, up_lo boolean, up_ro boolean"
)


def _depths(conv: int, parent: int | None, pv: int, v: int, al: int, n: int, x: int, d: int, leaves: int, kids: int, ends: str | None, words) -> list[dict]:
    """The nodes of one edge of the compressed trie, from the depth below the parent's to its own."""
    out = []
    for depth in range(pv + 1, v + 1):
        above = int(words[max(depth - 1, 0)])
        saved = x - n * above - (d + int(words[max(al, 0)]) - above)
        last = depth == v
        up = None if depth == 0 else parent if depth == pv + 1 else conv
        out.append({"conv_id": conv, "depth": depth, "parent_conv_id": up, "n_convs": n, "n_children": kids if last else 1, "n_leaves": leaves, "saved_tokens": saved, "sid": ends if last else None})
    return out


def _open_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for r in b.to_pylist():
            ends = r["size"] == r["v"]
            rows += _depths(r["conv"], r["parent"], r["pv"], r["v"], r["al"], r["n"], r["x"], r["d"], r["leaves"], r["q"] + 1 - ends, r["sid"] if ends else None, r["words"])
        yield pa.RecordBatch.from_pylist(rows, schema=_NODE)


def _block_nodes(rows: Iterator[pa.RecordBatch], groups: pa.Table) -> list[dict]:
    """The nodes that lie inside a block, leaves included; ``groups`` name the smallest member of those that do not."""
    b = _Block(rows)
    k, a = b.k, b.a
    known = {(r["v"], r["lo"], r["ro"]): r["conv"] for r in groups.to_pylist()}
    inner: dict[tuple[int, int], list[int]] = {}
    for i in np.flatnonzero(~b.lo & ~b.ro).tolist():
        inner.setdefault((int(b.left[i]), int(b.right[i])), []).append(i)
    least = {}
    if inner:
        bounds = np.array(sorted(inner)).reshape(-1)
        least = dict(zip(sorted(inner), np.minimum.reduceat(np.append(b.conv, b.conv[-1]), bounds)[::2].tolist(), strict=True))

    def name(i: int) -> int | None:
        """The smallest member of entry ``i``'s node."""
        if a[i] < 0:
            return None
        return known[int(a[i]), bool(b.lo[i]), bool(b.ro[i])] if b.lo[i] or b.ro[i] else least[int(b.left[i]), int(b.right[i])]

    def nodes(low: int, high: int, v: int, kids: int, conv: int, words: np.ndarray, ends: str | None) -> list[dict]:
        up = low if a[low] >= a[high] else high
        sums = [int(s[high] - s[low]) for s in (b.sum_n, b.sum_x, b.sum_d, b.sum_leaves)]
        return _depths(conv, name(up), int(a[up]), v, int(a[low]), *sums, kids, ends, words)

    out = []
    for (low, high), at in inner.items():
        v, ends = int(a[at[0]]), b.size[low] == a[at[0]]
        out += nodes(low, high, v, sum(i < k for i in at) + 1 - int(ends), least[low, high], b.of(at[0]), b.sid[low] if ends else None)
    for i in range(k):
        if b.size[i] > max(a[i], a[i + 1]):
            out += nodes(i, i + 1, int(b.size[i]), 0, int(b.conv[i]), b.words[i], b.sid[i])
    return out


def _pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Decimal ids of sorted rows (sid, conv_id), joined by commas in pieces of a bounded size."""
    now, first, held, size = None, 0, [], 0

    def piece() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([first], pa.int64()), pa.array([",".join(held)])], names=["sid", "first", "ids"])

    for b in batches:
        for sid, conv in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if held and (sid != now or size >= most):
                yield piece()
                held, size = [], 0
            if not held:
                now, first = sid, conv
            held.append(str(conv))
            size += len(held[-1]) + 1
    if held:
        yield piece()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sid, sha of the comma-joined pieces of each sid, which come sorted."""
    now, h = None, None
    for b in batches:
        done = []
        for sid, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            if sid == now:
                h.update(b",")
            else:
                if h is not None:
                    done.append((now, h.hexdigest()))
                now, h = sid, hashlib.sha256()
            h.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in done], pa.string()), pa.array([x for _, x in done], pa.string())], names=["sid", "sha"])
    if h is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([h.hexdigest()])], names=["sid", "sha"])


def member_hashes(convs: DataFrame, *, piece: int = PIECE) -> DataFrame:
    """sid, sha: SHA-256 of the decimal conv_ids of each sid, ascending and comma-joined. Ids are joined in pieces where they lie; one task then reads a sid's pieces, one at a time."""
    n = int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = convs.select("sid", "conv_id").repartitionByRange(n, "sid", "conv_id").sortWithinPartitions("sid", "conv_id")
    pieces = dealt.mapInArrow(lambda it: _pieces(it, piece), "sid string, first long, ids string")
    return pieces.repartition(n, "sid").sortWithinPartitions("sid", "first").mapInArrow(_hashed, "sid string, sha string")


def _sorted_blocks(convs: DataFrame, block: int) -> DataFrame:
    """block, at, sid, conv (the smallest id), n, ws, a (its entry of the LCP array, -1 for the first) and next (the entry after the block) of distinct conversations."""
    spark = convs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    one = convs.groupBy("sid").agg(F.min("conv_id").alias("conv"), F.count("*").alias("n"), F.first("ds").alias("ds"), F.first("ws").alias("ws"))
    one = staged(one, "trie-distinct")
    dealt = one.select("sid", "conv", "n", "ds", "ws").repartitionByRange(n, "ds").sortWithinPartitions("ds")
    laid = dealt.mapInArrow(lambda it: _laid_out(it, block), "block long, at long, sid string, conv long, n long, ds array<binary>, ws array<long>, lcp long")
    laid = staged(laid, "trie-sorted")
    sizes = laid.groupBy("block").agg(F.max("at").alias("top"))
    order = Window.orderBy("block")  # one row for each block
    sizes = sizes.withColumn("prev", F.lag("block").over(order)).withColumn("prev_top", F.lag("top").over(order))
    first = laid.where("at = 0").select("block", "lcp", F.col("ds").alias("y"))
    last = laid.select(F.col("block").alias("prev"), F.col("at").alias("prev_top"), F.col("ds").alias("x"))
    both = first.join(sizes, "block").join(last, ["prev", "prev_top"], "left")
    m = F.least(F.size("x"), F.size("y"))
    differ = F.array_position(F.zip_with(F.slice("x", F.lit(1), m), F.slice("y", F.lit(1), m), lambda p, q: p == q), False)
    entry = F.when(F.col("x").isNull(), F.lit(-1)).otherwise(F.coalesce("lcp", F.when(differ == 0, m).otherwise(differ - 1))).cast("long")
    bounds = staged(both.select("block", entry.alias("entry")), "trie-bounds").withColumn("next", F.coalesce(F.lead("entry").over(order), F.lit(-1)).cast("long"))
    rows = laid.join(bounds, "block").select("block", "at", "sid", "conv", "n", "ws", F.when(F.col("at") == 0, F.col("entry")).otherwise(F.col("lcp")).alias("a"), "next")
    return staged(rows, "trie-rows")


def prefix_trie(sequences: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """One row for each node of the trie of ``sequences`` (conv_id, unique; ds and ws as ``sequences()`` makes them), from the root down, equal sequences being members of the same nodes.

    conv_id (the smallest member), depth, parent_conv_id (the parent's; null for the root), n_convs, n_children, n_leaves, saved_tokens (over its subtree, each
    node's members but one times the words of its last turn) and ends_sha256 (of the ids that end there; of nothing if none do). No sequences, no rows.
    """
    spark = sequences.sparkSession
    convs = sequences.select("conv_id", "ds", "ws", F.md5(F.concat_ws("", F.transform("ds", F.hex))).alias("sid"))
    convs = staged(convs, "trie-convs")
    rows = _sorted_blocks(convs, block)
    summary = staged(rows.groupBy("block").applyInArrow(_summary, _SUMMARY_SQL), "trie-summary")
    minima = _Minima(summary.where("kind = 'block'").select("block", "v", "q", "r").orderBy("block").collect())
    groups = summary.where("kind = 'group'").mapInArrow(lambda it: _targets(it, minima), f"{_SUMMARY_SQL}, tl long, tr long")
    groups = staged(groups, "trie-groups")
    for side, to, is_open in (("l", "tl", "lo"), ("r", "tr", "ro")):
        aimed = groups.where(f"{is_open} AND {to} IS NOT NULL").groupBy(to)
        chain = summary.where(F.col("kind") == {"l": "left", "r": "right"}[side]).groupBy("block")
        found = aimed.cogroup(chain).applyInArrow(_keep_aimed(_met(side)), groups.schema)
        groups = staged(groups.where(f"NOT {is_open} OR {to} IS NULL").unionByName(found), "trie-groups")
    ends = staged(groups.mapInArrow(lambda it: _resolved(it, minima), _RESOLVED_SQL), "trie-ends")
    node = ends.groupBy("first", "past", "v").agg(F.sum("q").alias("q"), *[F.first(c).alias(c) for c in ("words", "pv", "al", "conv", "size", "sid", "n", "x", "d", "leaves", "up_block", "up_lo", "up_ro")])
    up = ends.select(F.col("block").alias("up_block"), F.col("v").alias("pv"), F.col("lo").alias("up_lo"), F.col("ro").alias("up_ro"), F.col("conv").alias("parent"))
    crossing = node.join(up, ["up_block", "pv", "up_lo", "up_ro"], "left").mapInArrow(_open_nodes, _NODE_SQL)
    inside = rows.groupBy("block").cogroup(ends.select("block", "v", "lo", "ro", "conv").groupBy("block")).applyInArrow(_inside, _NODE_SQL)
    nodes = crossing.unionByName(inside).join(member_hashes(convs), "sid", "left")
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    return nodes.select(*names, F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def _keep_aimed(run):
    """Blocks that no group is aimed at give no rows."""

    def guarded(groups: pa.Table, chain: pa.Table) -> pa.Table:
        return run(groups, chain) if groups.num_rows else groups

    return guarded


def _inside(rows: pa.Table, groups: pa.Table) -> pa.Table:
    return pa.Table.from_pylist(_block_nodes(iter(rows.to_batches()), groups), schema=_NODE)
