"""Edit-aware token counts.

A document's pre-tokens are the leaves of a segment tree whose nodes hold characters and tokens of their subtrees. An edit
re-splits the text only from shortly before the edit until a boundary agrees with an old one, re-encodes those pieces and
updates the sums above them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.bpe import PieceCoder, coder
from gridloom.llm.common import small_batches, unused, without

#: Characters before an edit whose pre-tokens may look at what it changes.
CONTEXT = 3
#: Characters read beyond an edit at first; doubled until the boundaries agree.
REACH = 64
#: Pieces of one slot before the tree may be laid out anew.
CROWD = 32


class CountTree:
    """Segment tree over the pre-tokens of one text.

    A leaf is a slot that holds the pieces which now stand in its place: one at first, none or several after edits. Once a slot
    holds more than CROWD of them, and more than the root of their number, the tree is laid out anew with a slot for each.
    """

    def __init__(self, text: str, code: PieceCoder):
        self.code = code
        self.reencoded = 0
        self._lay(code.split(text) if text else [])

    def _lay(self, pieces: list[str]) -> None:
        code = self.code
        self.slots: list[list[str]] = [[p] for p in pieces] or [[]]
        self.cap = 1 << (len(self.slots) - 1).bit_length()
        self.chars, self.tokens = np.zeros(2 * self.cap, np.int64), np.zeros(2 * self.cap, np.int64)
        self.chars[self.cap : self.cap + len(pieces)] = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.tokens[self.cap : self.cap + len(pieces)] = code.count_pieces(pieces)
        size = self.cap
        while size > 1:
            for sums in (self.chars, self.tokens):
                sums[size // 2 : size] = sums[size : 2 * size : 2] + sums[size + 1 : 2 * size : 2]
            size //= 2

    @property
    def n_tokens(self) -> int:
        return int(self.tokens[1])

    @property
    def n_chars(self) -> int:
        return int(self.chars[1])

    @property
    def n_pieces(self) -> int:
        return sum(map(len, self.slots))

    def text(self) -> str:
        return "".join(p for s in self.slots for p in s)

    def _slot_at(self, offset: int) -> tuple[int, int]:
        """The slot that holds the character at ``offset`` (the last slot at the end), and where the slot starts."""
        node, start = 1, 0
        if offset >= self.n_chars:
            return len(self.slots) - 1, self.n_chars - int(self.chars[self.cap + len(self.slots) - 1])
        while node < self.cap:
            node *= 2
            if offset >= start + self.chars[node]:
                start += int(self.chars[node])
                node += 1
        return node - self.cap, start

    def _set(self, slot: int, pieces: list[str]) -> None:
        self.slots[slot] = pieces
        node = self.cap + slot
        self.chars[node], self.tokens[node] = sum(map(len, pieces)), int(self.code.count_pieces(pieces).sum()) if pieces else 0
        while node > 1:
            node //= 2
            self.chars[node], self.tokens[node] = self.chars[2 * node] + self.chars[2 * node + 1], self.tokens[2 * node] + self.tokens[2 * node + 1]

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Replace characters ``[start, end)`` of the present text; offsets are clipped to it."""
        start = min(max(start, 0), self.n_chars)
        end = min(max(end, start), self.n_chars)
        if start == end and not replacement:
            return
        first, base = self._slot_at(max(0, start - CONTEXT))
        pieces, stop = [], first
        held, bounds = 0, [0]  # characters of the old text taken from ``base`` on, and their boundaries
        reach = REACH
        while True:
            while stop < len(self.slots) and held < end - base + reach:
                for p in self.slots[stop]:
                    pieces.append(p)
                    held += len(p)
                    bounds.append(held)
                stop += 1
            at_end = stop >= len(self.slots)
            old = "".join(pieces)
            new = old[: start - base] + replacement + old[end - base :]
            grown = len(new) - len(old)
            split = self.code.split(new)
            ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))
            sure = ends if at_end else ends[ends <= len(new) - 4]
            # a new boundary that stands on an old slot's end at or after the edit: all that follows stays
            goal, slot = {}, first
            total = 0
            for slot in range(first, stop):
                total += int(self.chars[self.cap + slot])
                goal[total + grown] = slot + 1
            done = next(((i + 1, goal[e]) for i, e in enumerate(sure.tolist()) if e >= end - base + grown and e in goal), None)
            if done is None and at_end:
                done = (len(split), stop)
            if done is not None:
                keep, last = done
                fresh = split[:keep]
                self.reencoded += len(fresh)
                self._set(first, fresh)
                for slot in range(first + 1, last):
                    if self.slots[slot]:
                        self._set(slot, [])
                if len(fresh) > CROWD and len(fresh) ** 2 > len(self.slots):
                    self._lay([p for s in self.slots for p in s])
                return
            reach *= 2


def count_edited(docs: DataFrame, ranks_path: str, pattern: str, *, text: str = "text", edits: str = "edits") -> DataFrame:
    """``docs`` without text and edits but with n_tokens, n_pieces, n_tokens_edited, n_chars_edited and n_reencoded.

    ``edits`` is an array of struct<start int, end int, replacement string>, in characters of the text as it stands when the
    edit's turn comes; edits apply in order. Null arrays, null edits and edits with a null offset change nothing, a null replacement deletes, offsets
    beyond the text are clipped. Null and empty texts have no tokens until an edit inserts some. Every row stays, repeated rows too; input columns with the names of results are replaced.
    """
    small_batches(docs.sparkSession)
    added = ["n_tokens", "n_pieces", "n_tokens_edited", "n_chars_edited", "n_reencoded"]
    kept = without(docs, text, edits, *added)
    data, changed = unused(docs, "text_", "edits_")
    src = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias(data), F.col(f"`{edits}`").alias(changed))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-2]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(ranks_path, pattern)
        for b in batches:
            out = np.zeros((5, b.num_rows), np.int64)
            for i, (x, changes) in enumerate(zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True)):
                tree = CountTree(x or "", code)
                out[0, i], out[1, i] = tree.n_tokens, tree.n_pieces
                for e in changes or []:
                    if e is not None and e["start"] is not None and e["end"] is not None:
                        tree.edit(e["start"], e["end"], e["replacement"] or "")
                out[2:, i] = tree.n_tokens, tree.n_chars, tree.reencoded
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], *map(pa.array, out)], names=[*kept, *added])

    return src.mapInArrow(run, ", ".join([*fields, *[f"{c} long" for c in added]]))
