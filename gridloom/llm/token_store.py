"""Token ids in files of directly addressable codes.

An id is cut into chunks of eight bits. Level 0 holds the low chunk of every id; a level's bitmap marks the ids that go on in
the next level, and its rank directory counts the marks before each block of 512, so the place of any id's next chunk is one
lookup and one popcount away. Any token is read without decoding others; a run of tokens is a run on each level.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from string import ascii_lowercase

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import fresh_path, small_batches, staged

MAGIC = b"DACTOK1\0"
#: Bits of bitmap for each entry of the rank directory.
RANK_BLOCK = 512
#: Ids of a file at most, beyond the document that passes it: with 16-bit ids about 9 MB.
FILE_IDS = 4_000_000
#: Words of one memory; there are two at most.
_CACHE_WORDS = 400_000
_HEAD = struct.Struct("<8sQQI")


def pack(ids: np.ndarray, doc_ids: list[int | None], ends: np.ndarray) -> bytes:
    """A file's bytes: header, document ids with null flags, ends of documents, then the levels."""
    levels, rest = [], ids.astype(np.uint32)
    while rest.size or not levels:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-bits.size % (RANK_BLOCK // 8), np.uint8)])
        ones = np.add.reduceat(np.bitwise_count(bits), np.arange(0, bits.size, RANK_BLOCK // 8)) if bits.size else np.empty(0)
        ranks = np.concatenate([[0], np.cumsum(ones, dtype=np.uint64)]).astype("<u8")
        levels.append(struct.pack("<QQQ", rest.size, bits.size, ranks.size) + (rest & 0xFF).astype(np.uint8).tobytes() + bits.tobytes() + ranks.tobytes())
        rest = rest[more] >> 8
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    keys = np.array([d or 0 for d in doc_ids], "<i8")
    return b"".join([_HEAD.pack(MAGIC, len(doc_ids), ids.size, len(levels)), keys.tobytes(), nulls.tobytes(), np.asarray(ends, "<u8").tobytes(), *levels])


class TokenFile:
    """Random access to a file of ``pack``."""

    def __init__(self, data: bytes):
        magic, n_docs, self.n_ids, n_levels = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = _HEAD.size
        view = lambda kind, n: np.frombuffer(data, kind, n, at)
        keys, at = view("<i8", n_docs), at + 8 * n_docs
        nulls, at = view(np.uint8, n_docs), at + n_docs
        self.doc_ids = [None if z else k for k, z in zip(keys.tolist(), nulls.tolist(), strict=True)]
        self.ends, at = view("<u8", n_docs).astype(np.int64), at + 8 * n_docs
        self.levels = []
        for _ in range(n_levels):
            n, n_bits, n_ranks = struct.unpack_from("<QQQ", data, at)
            at += 24
            chunks, at = view(np.uint8, n), at + n
            bits, at = view(np.uint8, n_bits), at + n_bits
            ranks, at = view("<u8", n_ranks), at + 8 * n_ranks
            self.levels.append((chunks, bits, ranks))

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Marks before position i."""
        block, byte = i // RANK_BLOCK, i // 8
        n = int(ranks[block]) + int(np.bitwise_count(bits[block * (RANK_BLOCK // 8) : byte]).sum())
        return n + (int(bits[byte]) & ((1 << (i % 8)) - 1)).bit_count() if i % 8 else n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value, shift = 0, 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not int(bits[i // 8]) >> (i % 8) & 1:
                return value
            i, shift = self._rank(bits, ranks, i), shift + 8
        raise ValueError("a code goes on beyond the last level")

    def run(self, start: int, end: int) -> np.ndarray:
        """Ids ``[start, end)``, reading just their chunks."""
        out = np.zeros(max(0, end - start), "<u4")
        where = np.arange(out.size)
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            if start >= end:
                break
            out[where] |= chunks[start:end].astype(np.uint32) << np.uint32(8 * level)
            more = np.unpackbits(bits[start // 8 : (end + 7) // 8], bitorder="little")[start % 8 :][: end - start].astype(bool)
            start = self._rank(bits, ranks, start)
            end = start + int(more.sum())
            where = where[more]
        return out

    def document(self, k: int) -> np.ndarray:
        return self.run(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def _drops_space(spec: dict) -> bool:
    """Whether texts can be encoded word by word: whitespace is dropped and no step looks across it."""
    norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps = norm.get("normalizers", [norm] if norm else [])
    splits = [p for p in pre.get("pretokenizers", [pre]) if p.get("type") == "Split"]
    return (
        all(s.get("type") in ("NFC", "NFD", "Lowercase") or s.get("type") == "Replace" and s.get("pattern") == {"Regex": "\\s+"} and s.get("content") == " " for s in steps)
        and len(splits) == 1 and splits[0].get("behavior") == "Removed" and splits[0].get("invert") is True
        and "\\s" not in splits[0]["pattern"].get("Regex", "\\s").replace("[^\\s", "") and " " not in splits[0]["pattern"].get("Regex", " ")
        and spec.get("post_processor") is None
    )


def _splits_stops(spec: dict) -> bool:
    """Whether the pattern that cuts a word parts letters from a full stop or comma after them, so that a space there changes nothing."""
    pre = spec["pre_tokenizer"]
    pattern = regex.compile(next(p for p in pre.get("pretokenizers", [pre]) if p.get("type") == "Split")["pattern"]["Regex"])
    return all(pattern.findall(f"{a}{b}{stop}{c}")[:2] == [a + b, stop] for a in "qs" for b in ascii_lowercase for stop in ".," for c in ("", "t")) and all(
        pattern.findall(f"{a}{stop}") == [a, stop] for a in ascii_lowercase for stop in ".,"
    )


class WordEncoder:
    """``encode(text, add_special_tokens=False).ids`` of a tokenizers file, word by word from a bounded memory where that is the same.

    Words that are letters alone are one pre-token each: many are encoded as one text, and cut where tokens end a word.
    """

    #: Where the tokenizer's own pattern splits between a letter and a full stop or comma, stems are remembered without them.
    _STOPS = re.compile(rb" (?=[.,])(?<![a-z] )")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        suffix = spec["model"].get("end_of_word_suffix")
        self.by_word = _drops_space(spec)
        lowers = any(n.get("type") == "Lowercase" for n in (spec.get("normalizer") or {}).get("normalizers", []))
        self.lower = bytes.lower if lowers else bytes
        # special strings count in a text as it stands and must not arise from its words: texts with either go to the tokenizer as they are
        self.special_bytes = [self.lower(s.encode()) for s in self.special]
        self.stops = self.by_word and lowers and _splits_stops(spec)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        if suffix:
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.marked = bool(self.ends.any())
        self.cache: dict[bytes, bytes] = {}
        #: Words of the memory that was full last: those used again move over, so frequent words are encoded once.
        self.older: dict[bytes, bytes] = {}

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[bytes]) -> None:
        plain, rest = [], []
        for w in words:
            (plain if (x := w.decode()).isalpha() else rest).append((w, x))
        if not self.marked:
            plain, rest = [], plain + rest
        for lo in range(0, len(plain), 4096):
            part = plain[lo : lo + 4096]
            ids = np.array(self._ids([" ".join(x for _, x in part)])[0], "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if cuts.size != len(part) or cuts[-1] != ids.size:
                rest += part
                continue
            raw, edges = ids.tobytes(), (4 * cuts).tolist()
            for (w, _), a, b in zip(part, [0, *edges], edges, strict=False):
                self.cache[w] = raw[a:b]
        for lo in range(0, len(rest), 4096):
            part = rest[lo : lo + 4096]
            for (w, _), ids in zip(part, self._ids([x for _, x in part]), strict=True):
                self.cache[w] = array("I", ids).tobytes()

    def _parted(self, low: bytes) -> bytes:
        """A text with a space between a letter and a full stop or comma: one before every stop, less those after no letter."""
        return self._STOPS.sub(b"", low.replace(b".", b" .").replace(b",", b" ,"))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split: list[list[bytes] | None] = []
        for x in texts:
            low = self.lower(x.encode()) if x else b""
            whole = x and (not self.by_word or any(s in low for s in self.special_bytes))
            split.append(None if whole else (self._parted(low) if self.stops else low).split())
        used = set(chain.from_iterable(w for w in split if w))
        if len(self.cache) > _CACHE_WORDS:
            self.older, self.cache = self.cache, {}
        new = used.difference(self.cache)
        known = new.intersection(self.older)
        self.cache.update(zip(known, map(self.older.__getitem__, known), strict=True))
        self._learn(list(new.difference(known)))
        get = self.cache.__getitem__
        return [array("I", self.tokenizer.encode(x, add_special_tokens=False).ids).tobytes() if w is None else b"".join(map(get, w)) for x, w in zip(texts, split, strict=True)]


@lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, *, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Write the ids of all documents, each with ``end_id`` after it, to ``folder``, a URI all executors share.

    Files hold documents in ascending doc_id order (nulls first; documents that share an id by their text) and are named by
    part and number, so names sort in that order. Returns the manifest: part, number, file, n_docs, n_ids. A retried task
    writes the same names again, each by a rename.
    """
    spark = docs.sparkSession
    small_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text"), F.col("text")]
    fs_, root = _open(folder)
    fs_.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, number = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        attempt = TaskContext.get().taskAttemptId()
        tail = np.array([end_id], "<u4").tobytes()
        keys, codes, sizes, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal keys, codes, sizes, held, number
            ids, ends = np.frombuffer(b"".join(codes), "<u4"), np.cumsum(sizes)
            store, base = _open(folder)
            name = f"part-{part:06d}-{number:06d}.dac"
            with store.open_output_stream(f"{base}/.{name}.{attempt}") as f:
                f.write(pack(ids, keys, ends))
            try:
                store.move(f"{base}/.{name}.{attempt}", f"{base}/{name}")
            except OSError:  # some stores don't rename onto a file; the one there is an earlier attempt's, with the same bytes
                store.delete_file(f"{base}/{name}")
                store.move(f"{base}/.{name}.{attempt}", f"{base}/{name}")
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int32()), "file": [name], "n_docs": pa.array([len(keys)], pa.int64()), "n_ids": pa.array([ids.size], pa.int64())})
            keys, codes, sizes, held, number = [], [], [], 0, number + 1
            return row

        for b in batches:
            for key, code in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist()), strict=True):
                code += tail
                keys.append(key)
                codes.append(code)
                sizes.append(len(code) // 4)
                held += sizes[-1]
                if held >= file_ids:
                    yield flush()
        if keys:
            yield flush()

    sorted_ = src.repartitionByRange(n, *order[:2]).sortWithinPartitions(*order)
    return staged(sorted_.mapInArrow(run, "part int, number int, file string, n_docs long, n_ids long"), "token-manifest")


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document in the files."""
    # parts are as many as shuffle partitions, so the prefix sums over them are small
    totals = manifest.groupBy("part").agg(F.sum("n_ids").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("number")) - F.col("n_ids")
    files = manifest.withColumn("inside", inside).join(before, "part").select("file", (F.col("before") + F.col("inside")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        for b in batches:
            for name, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{base}/{name}") as f:
                    tokens = TokenFile(f.readall())
                ends = tokens.ends
                starts = np.concatenate([[0], ends[:-1]])
                every = memoryview(tokens.run(0, tokens.n_ids).tobytes())
                crcs = [zlib.crc32(every[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(tokens.doc_ids, pa.int64()), pa.array(first + starts), pa.array(ends - starts), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(n, "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store(docs: DataFrame, tokenizer_path: str, *, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write all documents' ids to a new folder under ``spark.checkpoint.dir`` and read them back.

    A null text encodes like an empty one: just the end id. Repeated rows and ids each have a place of their own. Extra columns are
    ignored. No documents: no files and an empty result.
    """
    folder = fresh_path(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, folder, tokenizer_path, end_id=end_id, doc_id=doc_id, text=text), folder)
