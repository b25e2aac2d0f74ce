"""SimHash fingerprints, covering LSH and components against brute force."""

import itertools
import random

import numpy as np
import xxhash

from gridloom.llm import queries, simhash


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hs) > len(hs))


def slow_components(fps, radius=3):
    nodes = sorted(set(fps))
    rep = {x: x for x in nodes}

    def find(x):
        while rep[x] != x:
            x = rep[x]
        return x

    for a, b in itertools.combinations(nodes, 2):
        if (a ^ b).bit_count() <= radius and (x := find(a)) != (y := find(b)):
            rep[max(x, y)] = min(x, y)
    return {x: find(x) for x in nodes}


def expected(rows):
    fps = [slow_fingerprint(t) for _, t in rows]
    reps = slow_components(fps)
    least = {}
    for (i, _), f in zip(rows, fps, strict=True):
        if i is not None:
            least[reps[f]] = min(i, least.get(reps[f], i))
    return sorted((-1 if i is None else i, f"{f:016x}", least.get(reps[f], -1)) for (i, _), f in zip(rows, fps, strict=True))


def actual(df):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["fingerprint"], -1 if r["component_id"] is None else r["component_id"]) for r in df.collect())


def test_covering_reaches_every_pair_within_the_radius():
    rng = random.Random(0)
    for free in ((1 << 64) - 1, 0xF0F0F0F0F0F0F0F0, 0b1011, 0):
        places = [i for i in range(64) if free >> i & 1]
        masks = simhash.covering(free)
        for _ in range(3000):
            diff = sum(1 << p for p in rng.sample(places, min(len(places), rng.randrange(1, 4)))) if places else 0
            assert any(diff & ~m == 0 for m in masks)
        assert len(places) < 8 or max(m.bit_count() for m in masks) < len(places)


def test_links_in_crowded_balls(spark):
    rng = random.Random(1)
    centres = [rng.getrandbits(64) for _ in range(3)]
    fps = {rng.getrandbits(64) for _ in range(200)}
    for c in centres:
        for _ in range(400):
            fps.add(c ^ sum(1 << b for b in rng.sample(range(24), rng.randrange(0, 7))))
    signed = [(simhash._signed(f),) for f in fps]
    want = slow_components(fps)
    for bucket in (512, 128):
        edges = simhash.links(spark.createDataFrame(signed, "fp long"), bucket=bucket)
        reps = {r["node"]: r["rep"] for r in simhash.components(edges).collect()}
        groups = {}
        for f in fps:
            groups.setdefault(reps.get(simhash._signed(f), simhash._signed(f)), set()).add(f)
        slow = {}
        for f, r in want.items():
            slow.setdefault(r, set()).add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, slow.values()))


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(1, 30)] + [(7, 7)]
    random.Random(2).shuffle(chain)
    reps = {r["node"]: r["rep"] for r in simhash.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert all(reps[i] == 0 for i in range(1, 41)) and all(reps[100 + i] == 100 for i in range(1, 30))


def test_near_duplicates_cases(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(150)]
        for k in range(6):
            copy = list(base)
            for _ in range(k % 3):
                copy[rng.randrange(150)] = rng.choice(words)
            rows.append((g * 10 + k, " ".join(copy)))
    rows += [(500, None), (501, ""), (502, " \n "), (503, "one"), (504, "ONE"), (505, "two words"), (506, "ÉÀ é"), (None, "one"), (None, "alone without id here"), (3, rows[3][1]), rows[0]]
    docs = spark.createDataFrame([(i, t, "clash", 7, 8, 9, 10) for i, t in rows], "doc_id long, text string, Component_id string, fp int, _text int, _mark int, node int")
    out = simhash.near_duplicates(docs)
    assert actual(out) == expected(rows) and out.columns == ["doc_id", "fingerprint", "component_id", "fp", "_text", "_mark", "node"]
    assert out.where("fp = 7 and _text = 8 and _mark = 9 and node = 10").count() == len(rows)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.where("fp <> 7 or _text <> 8 or _mark <> 9 or node <> 10").count() == 0
    want = {c for _, _, c in expected(rows) if c >= 0}
    got = [r["doc_id"] for r in kept.collect()]
    assert sorted(x for x in got if x is not None) == sorted(want) and got.count(None) == 1
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_op4_query(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert actual(queries.op4(spark, sf_dir)) == expected(rows)


def test_fingerprint_matches_slow():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 4, 50):
        t = " ".join("Wörd" + str(x) for x in rng.integers(0, 30, n))
        assert simhash.fingerprint(t) == slow_fingerprint(t)


def test_links_leave_the_session_as_it_was(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "77")
    try:
        found = simhash.links(spark.createDataFrame([(0,), (1,), (3,), (-1,)], "fp long"))
        assert spark.conf.get(name) == "77"
        assert {frozenset(r) for r in found.collect()} <= {frozenset(x) for x in ((0, 1), (0, 3), (1, 3))}
    finally:
        spark.conf.set(name, before)
