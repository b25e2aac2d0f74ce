"""Pigeonhole edit matching against a plain dynamic programme."""

import random

from gridloom.llm import decontam, queries


def slow_distance(pattern, text):
    """Least edit distance of the pattern to any substring."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        prev, row[0] = row[0], 0
        for i, p in enumerate(pattern, 1):
            prev, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, prev + (p != c))
        best = min(best, row[-1])
    return best


def mutate(rng, s, edits):
    for _ in range(edits):
        i = rng.randrange(len(s) + 1)
        s = rng.choice([s[:i] + rng.choice("abc ") + s[i:], s[:i] + s[i + 1 :], s[:i] + rng.choice("abc ") + s[i + 1 :]])
    return s


def test_myers_is_the_dynamic_programme():
    rng = random.Random(0)
    for _ in range(400):
        p = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 90)))
        t = mutate(rng, p, rng.randrange(6)) if rng.random() < 0.5 else "".join(rng.choice("abc") for _ in range(rng.randrange(0, 100)))
        t = "ca" * rng.randrange(4) + t + "b" * rng.randrange(5)
        want = slow_distance(p, t)
        got, end = decontam.myers(decontam.masks_of(p), len(p), t, len(p))
        if want < len(p):
            assert got == want and slow_distance(p[::-1], t[:end][::-1]) == want


def test_no_occurrence_within_the_budget_is_missed(spark):
    rng = random.Random(1)
    alphabet = ["the", "of", "and", "ing", "heer", "ona", "tion", "wh"]
    text = lambda n: " ".join(rng.choice(alphabet) + rng.choice(alphabet) for _ in range(n))
    items = [(i, text(rng.randrange(5, 20)).capitalize()) for i in range(12)] + [(50, "Short  one"), (51, None), (None, text(9)), (52, "")]
    items.append(items[0])
    rows = []
    for i in range(120):
        body = text(rng.randrange(0, 30))
        if i % 2:
            body += " " + mutate(rng, rng.choice(items[:12])[1], rng.randrange(0, 14)) + " " + text(5)
        rows.append((i, body.replace(" ", "\n", 1), "clash"))
    rows += [(910, "a short one", ""), (911, "short ones, a short on", ""), (912, "SHORT ONE", "")]
    rows += [(900, None, ""), (901, "", ""), (None, items[3][1].upper(), ""), rows[1]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string, hits string")
    for block in (decontam.BLOCK_CHARS, 300):
        got = {(r["doc_id"], r["text"]): {h["item_id"]: (h["distance"], h["start"], h["end"]) for h in r["hits"]} for r in decontam.find_items(docs, bench, block_chars=block).collect()}
        for i, t, _ in rows:
            norm = decontam.normalise(t)
            want = {50: 0} if f" short one " in f" {norm} " else {}
            for j, x in items[:12]:
                p = decontam.normalise(x)
                if (d := slow_distance(p, norm)) <= int(0.1 * len(p)):
                    want[j] = d
            assert {j: d for j, (d, _, _) in got[i, t].items()}.keys() == want.keys(), i
            for j, (d, a, b) in got[i, t].items():
                assert slow_distance(decontam.normalise(dict(items)[j]), norm[a:b]) == d
    assert docs.count() == decontam.find_items(docs, bench).count()
    clean = decontam.decontaminate(docs, bench)
    assert clean.columns == docs.columns and clean.where("doc_id is null").count() == 0
    assert {r["hits"] for r in clean.collect()} <= {"clash", ""} and clean.where("doc_id = 912").count() == 0
    assert decontam.decontaminate(docs, bench.limit(0)).count() == docs.count()
    assert decontam.find_items(docs.limit(0), bench).count() == 0


def test_op9_query(spark, sf_dir):
    items = {r["item_id"]: decontam.normalise(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    docs = {r["doc_id"]: decontam.normalise(r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op9(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    grams = lambda x: {x[k : k + 8] for k in range(len(x) - 7)}
    wanted = {i: grams(x) for i, x in items.items()}
    for r in rows:
        text, found = docs[r["doc_id"]], set(r["item_ids"])
        own = grams(text)
        for i, x in items.items():
            most = int(0.1 * len(x))
            # an edit breaks eight of an item's strings of eight at most, so a text that lacks more of them has no occurrence
            if i in found or len(wanted[i] - own) <= 8 * most:
                assert (slow_distance(x, text) <= most) == (i in found), (r["doc_id"], i)


def test_short_items_beside_punctuation(spark):
    items = spark.createDataFrame([(1, "Hello World"), (2, "42"), (3, "(a)"), (4, "日本"), (5, "x_1")], "item_id long, text string")
    cases = {
        "say hello world.": [1], "(hello world)": [1], '"Hello world"': [1], "hello world, yes": [1], "hello\nworld": [1], "othello world": [], "hello worldly": [], "hello worlds, hello world!": [1],
        "hello world_": [], "it is 42.": [2], "it is 142, 421 or a42": [], "142 42": [2], "f(a)b": [3], "(a)": [3], "日本語": [], "「日本」": [4], "x_1;": [5], "x_12": [], "": [], "hello": [],
    }
    docs = spark.createDataFrame([*enumerate(cases), (99, None)], "doc_id long, text string")
    got = {r["doc_id"]: sorted({h["item_id"] for h in r["hits"]}) for r in decontam.find_items(docs, items).collect()}
    assert got == {**dict(enumerate(cases.values())), 99: []}
    assert {r["doc_id"] for r in decontam.decontaminate(docs, items).collect()} == {i for i, w in got.items() if not w}
