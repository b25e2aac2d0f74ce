"""Benchmark decontamination by pigeonhole edit matching.

An item that occurs in a text with at most e edits, cut into e + 1 pieces, occurs with one piece unchanged. The pieces of all
items are found in one pass of an automaton. A hit climbs a binary tree over the item's pieces: a node over j pieces has a budget
of j - 1 edits, and if a node's budget holds, so does that of one of its halves; Myers' bit-parallel distance checks the nodes
on the way, so chance hits end at a short pattern and only likely places are checked against the whole item.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import small_batches, staged, unused

#: Edits allowed for each character of an item, and the normalised length under which an item must occur unchanged and as whole words.
EDIT_RATE, SHORT = 0.1, 24
#: Characters of items searched in one pass: bounds the automaton that is broadcast (about 100 bytes a character).
BLOCK_CHARS = 2_000_000


def normalise(text: str | None) -> str:
    """Lower case with single spaces."""
    return " ".join(text.lower().split()) if text else ""


def in_word(two: str) -> bool:
    """Whether two neighbouring characters belong to one word: letters, digits and underscores; at a text's end there is one character or none."""
    return len(two) == 2 and all(c.isalnum() or c == "_" for c in two)


def masks_of(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def myers(masks: dict[str, int], m: int, text: str, most: int) -> tuple[int, int]:
    """The least edit distance of a pattern of m characters to any substring of ``text``, and the first end where it is reached.

    Bit-parallel columns of the dynamic-programming table; (most + 1, -1) if it is over ``most``.
    """
    ones = (1 << m) - 1
    top = 1 << (m - 1)
    pv, mv, score, best, where = ones, 0, m, most + 1, -1
    get = masks.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & ones)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best, where = score, j + 1
        ph = (ph << 1) & ones
        pv = ((mh << 1) & ones) | (~(xv | ph) & ones)
        mv = ph & xv
    return best, where


class Node:
    """Pieces [a, b) of an item: its text at ``offset`` and a budget of b - a - 1 edits."""

    __slots__ = ("budget", "masks", "offset", "parent", "size")

    def __init__(self, parent: Node | None, text: str, offset: int, budget: int):
        self.parent, self.offset, self.size, self.budget = parent, offset, len(text), budget
        self.masks = masks_of(text)


class Item:
    def __init__(self, item_id: int, text: str, rate: float, short: int = SHORT):
        self.item_id, self.text, self.short = item_id, text, len(text) < short
        self.budget = 0 if self.short else int(rate * len(text))
        n = self.budget + 1
        self.edges = [len(text) * i // n for i in range(n + 1)]
        self.leaves: list[Node] = [None] * n  # type: ignore[list-item]
        self._grow(None, 0, n)

    def _grow(self, parent: Node | None, a: int, b: int) -> None:
        node = Node(parent, self.text[self.edges[a] : self.edges[b]], self.edges[a], b - a - 1)
        if b - a == 1:
            self.leaves[a] = node
        else:
            self._grow(node, a, (a + b) // 2)
            self._grow(node, (a + b) // 2, b)

    @cached_property
    def reversed_masks(self) -> dict[str, int]:
        return masks_of(self.text[::-1])

    def check(self, leaf: int, text: str, at: int) -> tuple[int, int, int] | None:
        """(distance, start, end) of the item's occurrence around its piece ``leaf`` found at ``at``, if every budget on the way up holds."""
        node = self.leaves[leaf]
        base = at - node.offset
        distance, end = 0, at + node.size
        if self.short:
            inside = in_word(text[max(0, at - 1) : at + 1]) or in_word(text[end - 1 : end + 1])
            return None if inside else (0, at, end)
        while (node := node.parent) is not None:
            lo = max(0, base + node.offset - node.budget)
            distance, end = myers(node.masks, node.size, text[lo : base + node.offset + node.size + node.budget], node.budget)
            if end < 0:
                return None
            end += lo
        lo = max(0, end - len(self.text) - self.budget)
        _, back = myers(self.reversed_masks, len(self.text), text[lo:end][::-1], self.budget)
        return distance, end - back, end


class Matcher:
    """All items of a block."""

    def __init__(self, items: tuple[tuple[int, str], ...], rate: float, short: int = SHORT):
        self.items = [Item(i, t, rate, short) for i, t in items]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for n, item in enumerate(self.items):
            for leaf, (a, b) in enumerate(zip(item.edges, item.edges[1:], strict=False)):
                pieces.setdefault(item.text[a:b], []).append((n, leaf))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in pieces.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if pieces:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of the items in a normalised text: for each item its nearest occurrences, not overlapping."""
        found: dict[int, list[tuple[int, int, int]]] = {}
        if text and self.items:
            for last, (size, owners) in self.automaton.iter(text):
                at = last + 1 - size
                for n, leaf in owners:
                    item = self.items[n]
                    base = at - item.leaves[leaf].offset
                    known = found.get(n)
                    if known and any(abs(base - s) <= item.budget for _, s, _ in known):
                        continue
                    if (hit := item.check(leaf, text, at)) is not None:
                        found.setdefault(n, []).append(hit)
        out = []
        for n, hits in found.items():
            kept: list[tuple[int, int, int]] = []
            for d, s, e in sorted(hits):
                if all(e <= s2 or s >= e2 for _, s2, e2 in kept):
                    kept.append((d, s, e))
            out += [(self.items[n].item_id, *h) for h in sorted(kept, key=lambda h: h[1])]
        return sorted(out)


@lru_cache(maxsize=1)
def matcher(items: tuple[tuple[int, str], ...], rate: float, short: int) -> Matcher:
    return Matcher(items, rate, short)


HIT = "array<struct<item_id: bigint, distance: int, start: int, end: int>>"


def find_items(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = EDIT_RATE, short: int = SHORT, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """``docs`` with hits: the benchmark items each text holds within ``rate`` edits a character, as (item_id, distance, start, end).

    Offsets are in the normalised text. Every row and column stays, repeated rows too; a column named hits is replaced. Null and
    empty texts have no hits. Items under ``short`` characters must occur unchanged, and not inside a word: where an item begins or ends with
    a letter, digit or underscore, none stands beside it. Items without an id, null and blank items
    match nothing; of items that share an id and text one counts. Without items or documents the hits or the result are empty. Items are searched in blocks
    of about ``block_chars`` characters, one pass each; passes are written in between, so one block at a time is broadcast however large the benchmark.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col(f"`{item_id}`").cast("long").alias("i"), F.col(f"`{item_text}`").cast("string").alias("t")).where("i IS NOT NULL AND t IS NOT NULL").distinct()
    chars = items.agg(F.coalesce(F.sum(F.char_length("t")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-chars // block_chars))
    out, sent = docs.drop("hits").withColumn("hits", F.array().cast(HIT)), None
    for block in range(n_blocks):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks)) == block).collect()
        known = tuple(sorted((r["i"], n) for r in rows if (n := normalise(r["t"]))))
        if known:
            if sent is not None:
                out = staged(out, "decontam-pass")
                sent.unpersist()
            sent = spark.sparkContext.broadcast(known)
            out = _pass(out, sent, text, rate, short)
    return out


def _pass(docs: DataFrame, items, text: str, rate: float, short: int) -> DataFrame:
    names, where = docs.columns, [c.lower() for c in docs.columns].index(text.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = matcher(items.value, rate, short)
        for b in batches:
            hits = b.column(b.num_columns - 1)
            fresh = [m.find(normalise(x)) for x in b.column(where).to_pylist()]
            old = hits.to_pylist() if any(len(h) for h in hits) else [[]] * b.num_rows
            keys = ("item_id", "distance", "start", "end")
            both = [o + [dict(zip(keys, h, strict=True)) for h in f] for o, f in zip(old, fresh, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(both, hits.type)], names=names)

    return docs.mapInArrow(run, docs.schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no benchmark item, with the columns of ``docs``, one called hits included."""
    (mark,) = unused(docs, "hits_")
    plain = docs.withColumnRenamed("hits", mark) if "hits" in {c.lower() for c in docs.columns} else docs
    return find_items(plain, benchmark, **options).where(F.size("hits") == 0).drop("hits").toDF(*docs.columns)
