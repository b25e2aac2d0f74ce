"""Spelling variants by anagram hashing.

A word's anagram value is the sum of a power of its letters, so words of the same letters share it, and a word with one letter more, one fewer or one other
has a value that differs by a letter's power or by the difference of two. Two words meet where their values agree after each gives up at most one
letter: both give one up for an exchange, the longer one for an addition or a removal. Which letters stand where is checked beside the values, by a
hash of the order of what is left, so that an anagram class of any size is dealt out over all tasks; each pair that meets is then compared letter by letter.

All joins are sort-merge joins: the compressed file of the words is taken for the size of whatever is made from it, and a few MB of it are hundreds of MB
of probes, which Spark would broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import staged

#: Fixed values of the contract: what a word is made of, and when one of its letters goes.
LETTERS, GARBLE_EVERY = "[A-Za-zÀ-ÿ]+", 97
MIN_LETTERS, MIN_COUNT, DOMINANCE = 5, 3, 2
#: The power of a code point that a letter adds to an anagram value.
POWER = 5
#: Letters that are expanded at a time.
SPAN = 200_000
#: Moduli and base of the hash of letter order.
_PRIMES, _BASE = (2147483647, 2147483629), 1_000_003
_EXCHANGED, _REMOVED, _WHOLE = 0, 1, 2
_PROBES = "value long, letter_order long, kind byte, id long"


def word_counts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: the runs of letters of all whole texts, A-Z lower-cased, one letter taken out of the runs whose crc32 with the document's id 97 divides.

    Null texts have no words, a null doc_id counts as an empty one, repeated rows count each. Only words of at least ``min_letters`` code points and
    ``min_count`` occurrences are kept. Other columns are not read. Empty in, empty out.
    """
    own = F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("doc")
    lower = F.translate(F.col(f"`{text}`").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(own, F.explode(F.regexp_extract_all(lower, F.lit(LETTERS), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("doc", F.lit(":"), "run"))
    at = F.expr("cast(h % length(run) as int)")
    garbled = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % GARBLE_EVERY == 0, garbled).otherwise(F.col("run")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where((F.length("word") >= min_letters) & (F.col("n") >= min_count))


def anagram_value(word: str) -> int:
    """The sum of its letters' powers, modulo 2^64."""
    return sum(ord(c) ** POWER for c in word) % (1 << 64)


def _powers(n: int, p: int) -> np.ndarray:
    out = np.ones(1, np.int64)
    while out.size < n:
        out = np.concatenate([out, out * pow(_BASE, out.size, p) % p])
    return out[:n]


def _expanded(ids: np.ndarray, words: list[str]) -> pa.RecordBatch:
    """The probes of some words: each with one letter exchanged, with one removed (of equal neighbours the first), and whole."""
    code = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(size) - size
    of = np.repeat(np.arange(size.size), size)
    at = np.arange(code.size) - start[of]
    power = code.astype(np.uint64) ** np.uint64(POWER)
    value = np.add.reduceat(power, start)
    left, whole = np.zeros(code.size, np.int64), np.zeros(size.size, np.int64)
    for p in _PRIMES:
        base = _powers(int(size.max()), p)
        here, before = code * base[at] % p, code * base[np.maximum(at - 1, 0)] % p
        sums, moved = np.concatenate([[0], np.cumsum(here)]), np.concatenate([[0], np.cumsum(before)])
        end = start + size
        rest = (sums[:-1] - sums[start][of] + moved[end][of] - moved[1:]) % p
        left, whole = left << 31 | rest, whole << 31 | (sums[end] - sums[start]) % p
    first = (at == 0) | (code != np.concatenate([[-1], code[:-1]]))
    less = value[of] - power
    place = left.view(np.uint64) ^ ((at + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    columns = [
        np.concatenate([less, less[first], value]).view(np.int64),
        np.concatenate([place.view(np.int64), left[first], whole]),
        np.repeat(np.array([_EXCHANGED, _REMOVED, _WHOLE], np.int8), [code.size, int(first.sum()), size.size]),
        np.concatenate([ids[of], ids[of][first], ids]),
    ]
    return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["value", "letter_order", "kind", "id"])


def _probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, words = b.column(0).to_numpy(), b.column(1).to_pylist()
        lo = held = 0
        for hi, word in enumerate(words, 1):
            held += len(word)
            if held >= SPAN or hi == len(words):
                yield _expanded(ids[lo:hi], words[lo:hi])
                lo, held = hi, 0


def near_words(words: DataFrame) -> DataFrame:
    """u, v (u < v): the ids of all pairs of ``words`` (id, word; distinct non-empty words) that differ by one inserted, deleted or replaced code point."""
    probes = words.select("id", "word").mapInArrow(_probes, _PROBES)
    p, q = probes.alias("p"), probes.alias("q")
    met = (F.col("p.value") == F.col("q.value")) & (F.col("p.letter_order") == F.col("q.letter_order")) & (F.col("p.id") < F.col("q.id"))
    kinds = (F.col("p.kind") + F.col("q.kind")).isin(_EXCHANGED * 2, _REMOVED + _WHOLE) & ((F.col("p.kind") == _EXCHANGED) == (F.col("q.kind") == _EXCHANGED))
    pairs = p.join(q.hint("merge"), met & kinds).select(F.col("p.id").alias("u"), F.col("q.id").alias("v"))
    a, b = words.select(F.col("id").alias("u"), F.col("word").alias("a")), words.select(F.col("id").alias("v"), F.col("word").alias("b"))
    return pairs.join(a.hint("merge"), "u").join(b.hint("merge"), "v").where(F.levenshtein("a", "b", 1) == 1).select("u", "v")


def follow(steps: DataFrame) -> DataFrame:
    """word, root from word, form: where the forms lead in the end. Each round follows twice as many steps, so a few rounds do; forms must not run in circles."""
    now = staged(steps.select("word", F.col("form").alias("root")), "spelling-steps")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = staged(now.join(further.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-steps")
        if joined.where("moved").isEmpty():
            return joined.select("word", "root")
        now = joined.select("word", "root")


def variants(counts: DataFrame, *, dominance: int = DOMINANCE) -> DataFrame:
    """word, form, root, n, n_near, form_n from word, n (distinct words).

    n_near counts the words one edit away. form is the most frequent of them (of equally frequent ones the smallest by code points) where it is at least
    ``dominance`` (over 1) times as frequent as the word, else null; root is where forms lead in the end, the word itself if it has none. Null and empty words are left out.
    """
    words = staged(counts.where("word <> ''").select(F.monotonically_increasing_id().alias("id"), "word", "n"), "spelling-words")
    pairs = staged(near_words(words), "spelling-pairs")
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    other = words.select(F.col("id").alias("v"), F.struct((-F.col("n")).alias("less"), "word").alias("near"))
    best = both.join(other.hint("merge"), "v").groupBy("u").agg(F.count("*").alias("n_near"), F.min("near").alias("near"))
    takes = -F.col("near.less") >= dominance * F.col("n")
    found = words.join(best.hint("merge"), F.col("id") == F.col("u"), "left").select(
        "word", F.when(takes, F.col("near.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(takes, -F.col("near.less")).alias("form_n")
    )
    found = staged(found, "spelling-forms")
    roots = follow(found.where("form IS NOT NULL"))
    return found.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
