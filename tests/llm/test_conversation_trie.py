"""The conversation trie against one built in plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import pytest

from gridloom.llm import conversation_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string"


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def slow_trie(rows):
    own, members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(list), defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((-math.inf if turn is None else turn, role or "", digest(role or "", text or ""), text or ""))
    own = {c: [(r, x) for _, r, _, x in sorted(v)] for c, v in own.items()}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = (len(members[node]) - 1) * words + sum(saved[k] for k in kids[node])
        sha = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(kids[node]), leaves[node], saved[node], sha))
    return sorted(out, key=str)


def fast_trie(df, **options):
    out = conversation_trie.prefix_trie(conversation_trie.with_family_heads(conversation_trie.sequences(df)), **options)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, out.collect()), key=str)


@pytest.mark.parametrize(("seed", "block"), [(0, 1 << 15), (1, 1), (2, 2), (3, 3), (4, 7)])
def test_random_conversations(spark, seed, block):
    rng, rows = random.Random(seed), []
    for c in range(120):
        if rng.random() < 0.9:
            for t in range(rng.randrange(0, 7)):
                rows.append((c, t, rng.choice(["user", "assistant", None]) if rng.random() < 0.2 else "user", rng.choice(["x", "y z", "", "w w\tw", None, "x\x1cy"])))
    rows += rows[5:9] + [(-7, None, None, None), (-7, None, "user", "x"), (-40, 3, "user", "x"), (None, 1, "user", "x")]
    assert fast_trie(spark.createDataFrame(rows, SCHEMA), block=block) == slow_trie(rows)


def test_whole_table(spark, sf_dir):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    assert sorted(map(tuple, queries.op13(spark, sf_dir).collect()), key=str) == slow_trie(rows)


def test_copies_chains_and_lone_conversations(spark):
    copies = [(c, t, "u", f"turn {t}") for c in range(0, 2000, 20) for t in range(5)]
    chain = [(20 * c, t, "u", "go on") for c in range(200, 240) for t in range(c - 199)]
    long = [(100000, t, "u", f"n{t % 7}") for t in range(3000)]
    for rows in (copies, chain, copies + chain + long, [(5, 0, "u", "a")], [(40, t, "u", "same") for t in range(4)]):
        assert fast_trie(spark.createDataFrame(rows, SCHEMA), block=16) == slow_trie(rows)


def test_empty_and_clashing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert fast_trie(none) == [] == fast_trie(spark.createDataFrame([(None, 0, "u", "x")], SCHEMA))
    rows = [(1, 0, "u", "x"), (2, 0, "u", "x"), (21, 0, "u", "y")]
    wide = spark.createDataFrame([(*r, 1, "s", 2) for r in rows], f"{SCHEMA}, depth int, SID string, block int")
    assert fast_trie(wide) == slow_trie(rows)
    assert fast_trie(spark.createDataFrame([(1, 0, "u", "x"), (1, 0, "u", "x")], SCHEMA)) == slow_trie([(1, 0, "u", "x")] * 2)


def test_hashes_of_many_members(spark):
    ids = [*range(0, 300), *range(10**6, 10**6 + 50)]
    convs = spark.createDataFrame([("a" if i % 3 else "b", i) for i in ids], "sid string, conv_id long")
    got = {r["sid"]: r["sha"] for r in conversation_trie.member_hashes(convs, piece=50).collect()}
    assert got == {s: hashlib.sha256(",".join(str(i) for i in ids if (i % 3 > 0) == (s == "a")).encode()).hexdigest() for s in "ab"}
