"""Byte-level BPE by overlapping chunks, and decoding by concatenation of raw bytes.

A text is cut into chunks that overlap. Each chunk is split into pre-tokens and its pieces are merged by rank on their own, in parallel tasks. The split of
a text from some position on depends only on what follows that position, so as soon as a boundary of a chunk is also a boundary
of the chunk before it, all later boundaries agree: there the two are stitched, by ids alone. A text that fits one chunk has nothing to stitch.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import small_batches, staged, unused, without

#: Characters of a chunk, and those it reads beyond its end.
CHUNK, OVERLAP = 16_384, 256
#: A boundary this near the end of a chunk that is not the text's last may move when more text follows.
UNSURE = 4
_CACHE_PIECES = 250_000
#: Ids, or bytes of text, that a worker turns into Python objects and sends back at a time; a single row may be longer.
SPAN = 1_000_000
#: Rows of a file of long texts' ids: Spark reads up to 4,096 rows of a file at once, with three numbers and spare room for each id.
FILE_ROWS = 128
#: What a chunk sends to the stitching of its text.
SEAMS = ("ids", "head", "head_ids", "tail", "tail_ids")


def compile_pattern(pattern: str) -> regex.Pattern:
    """The pattern with Unicode's White_Space for ``\\s``: Python's own class has four more control characters."""
    return regex.compile(pattern.replace(r"(?!\S)", r"(?!\P{White_Space})").replace(r"\s", r"\p{White_Space}"))


class PieceCoder:
    """Merges single pre-tokens by rank and remembers a bounded number of them."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = compile_pattern(pattern).findall
        self.raw = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.raw[i] = token
        self._merge = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.cache: dict[str, bytes] = {}
        self.counts: dict[str, int] = {}

    def _learn(self, pieces: list[str]) -> None:
        if len(self.cache) > _CACHE_PIECES:
            self.cache.clear()
            self.counts.clear()
        for p in set(pieces).difference(self.cache):
            ids = np.array(self._merge(p), "<i4")
            self.cache[p] = ids.tobytes()
            self.counts[p] = ids.size

    def encode_pieces(self, pieces: list[str]) -> np.ndarray:
        self._learn(pieces)
        return np.frombuffer(b"".join(map(self.cache.__getitem__, pieces)), "<i4")

    def count_pieces(self, pieces: list[str]) -> np.ndarray:
        self._learn(pieces)
        return np.fromiter(map(self.counts.__getitem__, pieces), np.int64, len(pieces))

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_pieces(self.split(text)) if text else np.empty(0, "<i4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def coder(ranks_path: str, pattern: str) -> PieceCoder:
    return PieceCoder(ranks_path, pattern)


def cut(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """Chunks that start every ``chunk`` characters and run ``overlap`` characters into the next; a text without characters is one empty chunk."""
    return [text[i : i + chunk + overlap] for i in range(0, max(1, len(text) - overlap), chunk)]


@dataclass
class Encoded:
    """A chunk's ids, and for the boundaries of pre-tokens in its first and beyond its last characters the ids before them."""

    ids: np.ndarray
    head: np.ndarray
    head_ids: np.ndarray
    tail: np.ndarray
    tail_ids: np.ndarray


def encode_chunk(part: str, last: bool, code: PieceCoder, chunk: int = CHUNK, overlap: int = OVERLAP) -> Encoded:
    """The ids of a chunk's own pre-tokens, without those that more text could move; boundaries count from the chunk's start and from its end."""
    pieces = code.split(part) if part else []
    ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
    n = len(pieces) if last else int(np.searchsorted(ends, len(part) - UNSURE, "right"))
    # only pre-tokens that end in the first or beyond the last characters are counted one by one
    first, last_ones = int(np.searchsorted(ends[:n], overlap, "right")), int(np.searchsorted(ends[:n], chunk))
    ids = code.encode_pieces(pieces[:n])
    head = np.concatenate([[0], np.cumsum(code.count_pieces(pieces[:first]))])
    tail = ids.size - np.cumsum(code.count_pieces(pieces[last_ones + 1 : n])[::-1])[::-1]
    return Encoded(ids, np.concatenate([[0], ends[:first]]), head, ends[last_ones:n] - chunk, np.append(tail, ids.size)[: n - last_ones])


def stitch(parts: list[Encoded]) -> np.ndarray | None:
    """The ids of the whole text from its chunks; None if two of them have no boundary in common where they overlap."""
    start, out = 0, []
    for one, two in zip(parts, parts[1:], strict=False):
        shared, i, j = np.intersect1d(one.tail, two.head, assume_unique=True, return_indices=True)
        if not shared.size or (end := int(one.tail_ids[i[0]])) < start:
            return None
        out.append(one.ids[start:end])
        start = int(two.head_ids[j[0]])
    return np.concatenate([*out, parts[-1].ids[start:]])


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, "<i4")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32, copy=False)))


def in_spans(batch: pa.RecordBatch, sizes: pa.Array, most: int = SPAN) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows whose sizes sum up to ``most``, or a row alone that is larger."""
    lo = held = 0
    for hi, n in enumerate(sizes.to_pylist()):
        if hi > lo and held + n > most:
            yield batch.slice(lo, hi - lo)
            lo, held = hi, 0
        held += n
    if batch.num_rows > lo:
        yield batch.slice(lo)


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, *, text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``docs`` without the text but with ids (array of int) and decoded (binary, what the ids decode to).

    Every row stays, repeated ones too; a null text encodes like an empty one: no ids, no bytes. Input columns named ids or
    decoded are replaced, other columns are carried along. A text of one chunk is done where it is read. The chunks of others are dealt to all tasks,
    equal texts once, and their ids come together again; a text of which one pre-token is longer than an overlap is encoded as one. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    kept = without(docs, text, "ids", "decoded")
    data, key, found_key = unused(docs, "text_", "key_", "found_key_")
    src = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias(data))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(ranks_path, pattern)
        for batch in batches:
            for b in in_spans(batch, pc.binary_length(batch.column(batch.num_columns - 1))):
                ids = [code.encode(x) for x in b.column(b.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], _lists(ids), pa.array([code.decode(x) for x in ids], pa.binary())], names=[*kept, "ids", "decoded"])

    is_long = F.char_length(data) > chunk + overlap
    result = ", ".join([*fields, "ids array<int>", "decoded binary"])
    short = src.where(~is_long).mapInArrow(whole, result)

    def cutting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "k", "last", "part"]
        for b in batches:
            for name, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                parts = cut(x.as_py(), chunk, overlap)
                for lo in range(0, len(parts), 64):
                    some = parts[lo : lo + 64]
                    ks = range(lo, lo + len(some))
                    columns = [pa.array([name] * len(some)), pa.array(ks, pa.int32()), pa.array([k == len(parts) - 1 for k in ks]), pa.array(some, pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    def encoding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(ranks_path, pattern)
        for b in batches:
            done = [encode_chunk(p, z, code, chunk, overlap) for p, z in zip(b.column("part").to_pylist(), b.column("last").to_pylist(), strict=True)]
            columns = [_lists([getattr(e, c) for e in done]) for c in SEAMS]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("k"), *columns], names=["key", "k", *SEAMS])

    def joining(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("k")
        ids = stitch([Encoded(*row) for row in zip(*(g[c] for c in SEAMS), strict=True)])
        return pd.DataFrame({found_key: [g["key"].iloc[0]], "ids": [ids]})

    def decoding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(ranks_path, pattern)
        for batch in batches:
            for b in in_spans(batch, batch.column(batch.num_columns - 1).value_lengths()):
                decoded = [code.decode(x.values.to_numpy()) for x in b.column(b.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(decoded, pa.binary())], names=[*kept, "ids", "decoded"])

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    far = src.where(is_long).withColumn(key, F.sha2(data, 256))
    once = far.groupBy(key).agg(F.first(data).alias(data))
    parts = once.mapInArrow(cutting, "key string, k int, last boolean, part string").repartition(n, "key", "k")
    coded = parts.mapInArrow(encoding, "key string, k int, " + ", ".join(f"{c} array<int>" for c in SEAMS))
    done = staged(coded.groupBy("key").applyInPandas(joining, f"`{found_key}` string, ids array<int>"), "bpe-ids", file_rows=FILE_ROWS)
    columns = [F.col(f"`{c}`") for c in kept]
    met = far.select(*columns, key).join(done.where("ids IS NOT NULL"), F.col(key) == F.col(found_key)).select(*columns, "ids")
    out = short.unionByName(met.mapInArrow(decoding, result))
    apart = done.where("ids IS NULL")
    if apart.isEmpty():
        return out
    return out.unionByName(far.join(apart.select(found_key), F.col(key) == F.col(found_key)).select(*columns, data).mapInArrow(whole, result))
