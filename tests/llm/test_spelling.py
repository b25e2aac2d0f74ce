"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from gridloom.llm import queries, spelling

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_counts(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w if h % 97 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def slow_near(words):
    places, near = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            places[i, w[:i], w[i + 1 :]].add(w)
            if (shorter := w[:i] + w[i + 1 :]) in words:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in places.values():
        for w in group:
            near[w] |= group - {w}
    return near


def slow_variants(n, dominance=2):
    near, form = slow_near(set(n)), {}
    for w in n:
        if near[w] and n[best := min(near[w], key=lambda x: (-n[x], x))] >= dominance * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def test_query_equals_brute_force_over_the_table(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = slow_variants(slow_counts(docs))
    assert rows(queries.op11(spark, sf_dir)) == want and sum(w[1] is not None and w[1] != w[2] for w in want) > 5


def test_crowded_anagrams_and_chains(spark):
    rng = random.Random(1)
    words = {"".join(rng.sample("abcdefgh", 8)) for _ in range(600)} | {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))) for _ in range(300)}
    words |= {"aaaaa" + "b" * k for k in range(6)} | {"é" + w for w in list(words)[:50]} | {"x" * 3000, "x" * 2999, "x" * 1500 + "y" + "x" * 1499}
    n = {w: rng.choice([3, 3, 4, 6, 7, 12, 30, 61, 500]) for w in words}
    counts = spark.createDataFrame([*n.items(), (None, 9), ("", 9)], "word string, n long")
    assert rows(spelling.variants(counts)) == slow_variants(n)
    assert rows(spelling.variants(counts, dominance=5)) == slow_variants(n, 5)
    assert spelling.variants(counts.limit(0)).count() == 0
    ladder = {f"word{'s' * k}": 3 * 2**k for k in range(12)}
    out = rows(spelling.variants(spark.createDataFrame([*ladder.items()], "word string, n long")))
    assert out == slow_variants(ladder) and {r[2] for r in out} == {"word" + "s" * 11}


def test_words_of_odd_texts(spark):
    texts = [(1, None), (2, ""), (3, "ABC123Éàü÷× straße's naïve_NAÏVE"), (None, "without id ID"), (4, "z" * 20000), (4, "z" * 20000), (4, "z" * 20000), (5, "日本語 abcde"), (6, "café cafe")]
    texts += [(i, "committee comittee Committee") for i in range(100, 400)]
    texts += texts[-1:]
    docs = spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in texts], "doc_id long, text string, word string, n int, run int")
    got = {r["word"]: r["n"] for r in spelling.word_counts(docs, min_letters=1, min_count=1).collect()}
    want = Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            want[w if h % 97 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    assert got == dict(want) and len([w for w in got if w.startswith("com")]) >= 3
    assert spelling.word_counts(docs.limit(0)).count() == 0


def test_anagram_values():
    assert spelling.anagram_value("listen") == spelling.anagram_value("silent") != spelling.anagram_value("listed")
    assert spelling.anagram_value("") == 0


@pytest.mark.parametrize("word", ["hello", "aab", "a", "é" * 7])
def test_probes_agree_with_the_words_they_reach(word):
    import numpy as np

    probe = lambda w: {(r["value"], r["letter_order"]) for r in spelling._expanded(np.array([1]), [w]).to_pylist() if r["kind"] == spelling._REMOVED}
    whole = lambda w: {(r["value"], r["letter_order"]) for r in spelling._expanded(np.array([1]), [w]).to_pylist() if r["kind"] == spelling._WHOLE}
    shorter = {word[:i] + word[i + 1 :] for i in range(len(word))} - {""}
    assert all(whole(s) <= probe(word) for s in shorter) and len(probe(word)) == max(len(shorter), 1)


def test_no_join_is_broadcast(spark, monkeypatch):
    plans, staged = [], spelling.staged
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()

    def noted(df, name):
        plans.append((name, plan(df)))
        return staged(df, name)

    monkeypatch.setattr(spelling, "staged", noted)
    out = spelling.variants(spark.createDataFrame([("north", 8), ("nort", 4), ("norths", 2), ("other", 5)], "word string, n long"))
    plans.append(("result", plan(out)))
    assert len(plans) >= 6
    for name, p in plans:
        assert "BroadcastHashJoin" not in p, name
    assert {(r["word"], r["root"]) for r in out.collect()} == {("north", "north"), ("nort", "north"), ("norths", "north"), ("other", "other")}
