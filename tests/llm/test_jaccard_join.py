"""N-gram Jaccard join against all pairs."""

import random
from collections import Counter, defaultdict

import numpy as np

from gridloom.llm import jaccard_join, queries


def slow_set(text, n=3):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)] if words else [])


def grouped(nodes, links):
    label = {i: i for i in nodes}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for u, v in links:
        u, v = find(u), find(v)
        label[max(u, v)] = min(u, v)
    return {i: find(i) for i in nodes}


def slow_components(rows, percent=90):
    """(doc_id, size, component) of rows (doc_id, text), each row a node of its own."""
    sets, holders, both = [slow_set(t) for _, t in rows], defaultdict(list), Counter()
    for k, s in enumerate(sets):
        for x in s:
            holders[x].append(k)
    for held in holders.values():
        for n, a in enumerate(held):
            for b in held[:n]:
                both[b, a] += 1
    of = grouped(range(len(rows)), [p for p, c in both.items() if 100 * c >= percent * (len(sets[p[0]]) + len(sets[p[1]]) - c)])
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[of[k]] = min(i, least.get(of[k], i))
    return sorted(((i, len(s), least.get(of[k])) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def actual(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def family(rng, n, size, edits, words):
    base = [rng.choice(words) for _ in range(size)]
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(edits + 1)):
            k = rng.randrange(len(copy))
            copy[k : k + 1] = rng.choice([[], [rng.choice(words)], [rng.choice(words), rng.choice(words)]])
        yield " ".join(copy)


def test_query_equals_all_pairs(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = slow_components(rows)
    assert actual(queries.op12(spark, sf_dir)) == want and any(c != i for i, _, c in want)


def test_tries_equal_all_pairs():
    rng = np.random.default_rng(0)
    for trial in range(150):
        sets = []
        for _ in range(rng.integers(1, 6)):
            base = rng.choice(200, rng.integers(1, 40), replace=False)
            for _ in range(rng.integers(1, 12)):
                x = set(base.tolist()) ^ set(rng.integers(0, 400, rng.integers(0, 4)).tolist())
                sets.append(np.array(sorted(x or {0}), np.uint64))
        ids = [1000 + i for i in range(len(sets))]
        percent = (90, 80, 50, 100)[trial % 4]
        alike = lambda x, y: 100 * (k := np.intersect1d(x, y).size) >= percent * (x.size + y.size - k)  # noqa: B023, E731
        half = len(sets) // 2
        inside = [(ids[a], ids[b]) for a in range(len(sets)) for b in range(a) if alike(sets[a], sets[b])]
        found = jaccard_join.spanning_links(sets, ids, ids, percent)
        assert grouped(ids, found) == grouped(ids, inside) and set(map(frozenset, found)) <= set(map(frozenset, inside))
        across = [(ids[a], ids[b]) for a in range(half) for b in range(half, len(sets)) if alike(sets[a], sets[b])]
        if half:
            found = jaccard_join.spanning_links(sets[half:], ids[half:], ids[half:], percent, against=(sets[:half], ids[:half], ids[:half]))
            assert grouped(ids, found) == grouped(ids, across)


def test_large_clusters_in_blocks(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    texts = [t for size, n, edits in ((60, 70, 3), (90, 40, 8), (12, 30, 1), (200, 3, 4)) for t in family(rng, n, size, edits, words)]
    texts += [texts[3]] * 20
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = slow_components(rows)
    for block in (jaccard_join.BLOCK_SHINGLES, 700, 150):
        monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", block)
        assert actual(jaccard_join.jaccard_components(docs)) == want
    assert actual(jaccard_join.jaccard_components(docs, percent=70)) == slow_components(rows, 70)


def test_odd_rows(spark):
    long = " ".join(f"x{k}" for k in range(30000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b"), (5, "A  B"), (6, "a b c"), (7, "a"), (8, "A"), (None, "a"), (None, "alone here without id"), (None, ""), (9, "É à"), (10, "é à"), (11, "x\x1cy z w"), (12, long), (13, long + " end"), (4, "a b"), (1, "again one two"), (14, "again one two"), (2, "")]
    docs = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], "doc_id long, text string, sid int, Size int, component_id string")
    assert actual(jaccard_join.jaccard_components(docs)) == slow_components(rows)
    assert jaccard_join.jaccard_components(docs.limit(0)).count() == 0
    assert actual(jaccard_join.jaccard_components(docs.where("text = ''"))) == [(2, 0, 2), (2, 0, 2), (None, 0, None)]


def test_prefixes_of_alike_sets_meet():
    rng = np.random.default_rng(3)
    sketch = rng.integers(0, 50, 1 << jaccard_join.CELL_BITS).astype(np.int32)
    for _ in range(400):
        x = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 80)).astype(np.uint64) * np.uint64(2))
        y = np.union1d(x[rng.random(x.size) > 0.05], rng.integers(0, 1 << 63, rng.integers(0, 3)).astype(np.uint64))
        both = np.intersect1d(x, y).size
        if both and 100 * both >= 90 * (x.size + y.size - both):
            assert np.intersect1d(jaccard_join.prefix(x, sketch), jaccard_join.prefix(y, sketch)).size


def test_buckets_hold_what_may_be_alike_together(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(jaccard_join, "SMALL", 3)
    monkeypatch.setattr(jaccard_join, "BUCKET", 8)
    rng = np.random.default_rng(4)
    for rows_a_batch in (1, 4, 7, 1000):
        keys = np.sort(rng.integers(0, 12, 90))
        sizes = rng.integers(50, 60, 90)
        counts = rng.integers(0, 3, (90, jaccard_join.RANGES)).astype("<u2")
        near = rng.random(90) < 0.6
        counts[near] = counts[0]
        counts[near, 0] += rng.integers(0, 4, int(near.sum())).astype("<u2")
        rows = pa.table({"key": keys, "sid": np.arange(90), "size": sizes, "counts": pa.array([c.tobytes() for c in counts], pa.binary())})
        found = [e for b in jaccard_join._possible(iter(rows.to_batches(max_chunksize=rows_a_batch)), 90) for e in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        together = grouped(range(90), [(u, v) for u, v, _ in found])
        for i in range(90):
            for j in range(i):
                apart = int(np.abs(counts[i].astype(int) - counts[j]).sum())
                if keys[i] == keys[j] and 190 * apart <= 10 * (sizes[i] + sizes[j]):
                    assert together[i] == together[j]
                    members = int((keys == keys[i]).sum())
                    assert members > 3 or (i, j, False) in found
                elif keys[i] != keys[j]:
                    assert together[i] != together[j]


def test_fine_counts_never_part_alike_sets():
    rng = np.random.default_rng(5)
    for size in (1, 3, 40, 500, 3000, 20000):
        for _ in range(20):
            x = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
            y = np.union1d(x[rng.random(x.size) > 0.05], rng.integers(0, 1 << 63, size // 25).astype(np.uint64))
            both = np.intersect1d(x, y).size
            if 100 * both >= 90 * (x.size + y.size - both):
                assert jaccard_join.may_be_alike(jaccard_join.fine_counts(x), jaccard_join.fine_counts(y), x.size + y.size, 90)
        z = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        assert size < 40 or not jaccard_join.may_be_alike(jaccard_join.fine_counts(x), jaccard_join.fine_counts(z), x.size + z.size, 90)
