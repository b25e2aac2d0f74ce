"""Maximal repeat groups against all substrings, and against the removed ranges over a whole table."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gridloom.llm import suffix_dedup
from gridloom.llm.common import table
from gridloom.llm.repeat_groups import repeat_groups


def slow(texts, length):
    data = {i: (t or "").encode() for i, t in enumerate(texts)}
    at = defaultdict(list)
    for i, d in data.items():
        for a in range(len(d)):
            for b in range(a + length, len(d) + 1):
                at[d[a:b]].append((i, a, b))
    out = set()
    for spots in at.values():
        before = {data[i][a - 1] if a else (i, a) for i, a, _ in spots}
        after = {data[i][b] if b < len(data[i]) else (i, b) for i, _, b in spots}
        if len(spots) > 1 and len(before) > 1 and len(after) > 1:
            out.add(frozenset(spots))
    return out


def found(spark, texts, **how):
    rows = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "rid long, text string, GID string, h int").repartition(3)
    groups = defaultdict(set)
    for r in repeat_groups(rows, **how).collect():
        assert r["end"] - r["start"] == r["n_bytes"]
        groups[r["group_id"], r["n_occurrences"]].add((r["rid"], r["start"], r["end"]))
    assert all(len(g) == n for (_, n), g in groups.items())
    assert len(set(map(frozenset, groups.values()))) == len(groups)
    return set(map(frozenset, groups.values()))


def odd_texts(seed):
    rng = random.Random(seed)
    noise = lambda n: "".join(rng.choice("abc é") for _ in range(n))
    passages = [noise(rng.randrange(8, 30)) for _ in range(4)]
    texts = ["".join(rng.choice([rng.choice(passages), noise(rng.randrange(0, 12))]) for _ in range(rng.randrange(0, 5))) for _ in range(120)]
    return [*texts, None, "", "a" * 25, "abab" * 6, texts[3], texts[3]]


@pytest.mark.parametrize(("seed", "forms"), [(0, 1024), (1, 3), (2, 8)])
def test_all_maximal_repeats(spark, seed, forms):
    texts = odd_texts(seed)
    want = slow(texts, 12)
    assert len(want) > 50
    assert found(spark, texts, length=12, gram=5, reach=400, forms=forms) == want


def test_long_repeats_are_chained(spark):
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    long, other = noise(3000), noise(700)
    texts = ["x" + noise(50) + long + "y" + noise(20), long, noise(90) + "z" + long + "w", other + "1", "2" + other]
    got = found(spark, texts, length=200, gram=48)
    assert got == {frozenset([(0, 51, 3051), (1, 0, 3000), (2, 91, 3091)]), frozenset([(3, 0, 700), (4, 1, 701)])}


def test_nothing_to_find(spark):
    assert found(spark, ["alone", None, ""], length=12, gram=5) == set()
    assert repeat_groups(spark.createDataFrame([], "rid long, text string")).count() == 0


def test_groups_cover_what_is_removed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rid"), "text")
    assert docs.count() == docs.select("rid").distinct().count()
    covered = defaultdict(list)
    texts = {r["rid"]: (r["text"] or "").encode() for r in docs.collect()}
    strings = {}
    for r in repeat_groups(docs).collect():
        covered[r["rid"]].append({"start": r["start"], "end": r["end"]})
        piece = texts[r["rid"]][r["start"] : r["end"]]
        assert len(piece) == r["n_bytes"] and strings.setdefault(r["group_id"], piece) == piece
    removed = {r["doc_id"]: [tuple(x) for x in r["removed"]] for r in suffix_dedup.remove_repeats(docs.withColumnRenamed("rid", "doc_id")).collect()}
    assert strings
    for rid, data in texts.items():
        assert suffix_dedup._merge(covered[rid], len(data)) == removed[rid]
