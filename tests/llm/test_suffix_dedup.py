"""Repeated byte strings against a dictionary of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np

from gridloom.llm import queries, suffix_dedup


def slow(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans, i = [], 0
        while i < len(d):
            j = i
            while j < len(d) and gone[j] == gone[i]:
                j += 1
            if gone[i]:
                spans.append((i, j))
            i = j
        out.append((len(d), sum(gone), len(spans), bytes(b for b, g in zip(d, gone, strict=True) if not g)))
    return out


def check(spark, texts, length, gram):
    docs = spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, KEPT string, _text int, rid int").repartition(5)
    out = suffix_dedup.remove_repeats(docs, length=length, gram=gram)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in out.collect()}
    want = slow(texts, length)
    for i, w in enumerate(want):
        assert got[i] == w, (i, got[i][:3], w[:3], texts[i])
    assert len(got) == len(texts)


def test_small_alphabet_and_short_repeats(spark):
    rng = random.Random(0)
    passages = ["".join(rng.choice("abcd é") for _ in range(rng.randrange(8, 40))) for _ in range(6)]
    texts = []
    for _ in range(120):
        texts.append("".join(rng.choice([rng.choice(passages), "".join(rng.choice("abcdefghijklmnop é") for _ in range(rng.randrange(0, 25)))]) for _ in range(rng.randrange(0, 5))))
    texts += [None, "", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "abababababababababababab", texts[3], texts[3]]
    check(spark, texts, 16, 6)


def test_anchors_that_cross_many_ranges(spark):
    rng = random.Random(1)
    line, passage = "a common line", "the passage that many documents share "
    noise = lambda n: "".join(rng.choice("abc ") for _ in range(n))
    texts = [noise(rng.randrange(0, 12)) + line + noise(rng.randrange(0, 12)) + (passage if i % 2 else "") + noise(rng.randrange(0, 9)) for i in range(300)]
    near = "one text of which all the others are copies but for a letter or two that differ"
    for _ in range(200):
        copy = list(near)
        for _ in range(rng.randrange(0, 4)):
            copy[rng.randrange(len(copy))] = rng.choice("xyz")
        texts.append("".join(copy))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        check(spark, texts, 16, 6)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_nested_by_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        m, need = rng.randrange(2, 14), rng.randrange(1, 10)
        lefts = sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 8))) for _ in range(m))
        depths = [rng.randrange(0, 8) for _ in range(m)]
        left, right = [-1] * m, [-1] * m
        for i in range(m):
            for j in range(m):
                a, b = suffix_dedup.agree(lefts[i], lefts[j]), min(depths[i], depths[j])
                if i != j and a + b >= need:
                    left[i], right[i] = max(left[i], a), max(right[i], b)
        assert suffix_dedup.nested(depths, lefts, need) == (left, right)


def test_production_lengths(spark):
    rng = random.Random(2)
    noise = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzäß") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    shared = [noise(60) for _ in range(3)]
    texts = [noise(rng.randrange(0, 80)) + rng.choice([" ", "|"]) + rng.choice(shared)[rng.randrange(0, 40) :] + rng.choice([" ", "|"]) + noise(rng.randrange(0, 80)) for _ in range(40)]
    texts += [texts[0], texts[1][:400], "x" * 1500, ("line of boilerplate, all rights reserved. " * 30)]
    check(spark, texts, 200, 48)


def test_empty_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "y" * 100 + "z" * 150), (1, "y" * 100 + "z" * 150), (None, "q" * 10)], "doc_id long, text string")
    rows = suffix_dedup.remove_repeats(docs).collect()
    assert sorted(r["n_removed"] for r in rows) == [0, 250, 250]
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_intervals_and_extents_by_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        m, need = rng.randrange(2, 14), rng.randrange(1, 10)
        lefts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 8))) for _ in range(m)]
        rights = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 8))) for _ in range(m)]
        left, right = [-1] * m, [-1] * m
        for i in range(m):
            for j in range(m):
                a, b = suffix_dedup.agree(lefts[i], lefts[j]), suffix_dedup.agree(rights[i], rights[j])
                if i != j and a + b >= need:
                    left[i], right[i] = max(left[i], a), max(right[i], b)
        assert suffix_dedup.extents(lefts, rights, need) == (left, right)


def test_anchors_do_not_depend_on_blocks():
    data = np.frombuffer(bytes(random.Random(4).choices(b"abcdefgh", k=5000)), np.uint8)
    whole = suffix_dedup.anchors(data, 60, 20)
    for block in (64, 333, 1000):
        for a, b in zip(whole, suffix_dedup.anchors(data, 60, 20, block), strict=True):
            assert np.array_equal(a, b)
    assert np.diff(whole[0]).max() <= 41


def test_op5_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    want = {r["doc_id"]: w for r, w in zip(rows, slow([r["text"] for r in rows], 200), strict=True)}
    for r in queries.op5(spark, sf_dir).collect():
        n, removed, spans, kept = want[r["doc_id"]]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (n, removed, spans, hashlib.sha256(kept).hexdigest())
