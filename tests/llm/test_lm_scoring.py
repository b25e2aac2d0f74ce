"""Language-model scores against counts and a plain forward pass."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from gridloom.llm import lm_scoring, queries

RANKS = public_tokenizers.path(queries.SUBWORD_RANKS)


@pytest.fixture(scope="module")
def model():
    rng = random.Random(0)
    texts = [[w.encode() for w in ("the cat sat on a mat while it rained über alles".split() * 4)[: rng.randrange(1, 40)]] for _ in range(60)]
    return lm_scoring.train(texts, RANKS, steps=15)


def slow_log_probs(model, symbols):
    """The model's formula, one id at a time; ids see their own block and the one before it."""
    t, size = model.tables, lm_scoring.BLOCK
    inputs, out = [lm_scoring.END, *symbols[:-1]], []
    for i, target in enumerate(symbols):
        start = max(0, i // size * size - size)
        s = np.array([t["q"][inputs[i]] @ t["k"][inputs[j]] + t["near"][i % size, j - (i // size * size - size)] for j in range(start, i + 1)], np.float64)
        a = np.exp(s - s.max())
        h = np.maximum((a / a.sum()) @ t["v"][inputs[start : i + 1]] + t["r"][inputs[i]], 0)
        c, m = divmod(int(t["place"][target]), lm_scoring.MEMBERS)
        y, z = h @ t["wc"] + t["bc"], h @ t["wm"][c] + t["bm"][c]
        out.append(y[c] - np.log(np.exp(y).sum()) + z[m] - np.log(np.exp(z).sum()))
    return out


def test_windows_score_each_token_once_and_as_the_formula_says(model):
    scorer = lm_scoring.Scorer(model)
    texts = [[], [b"cat"], b"the cat sat on a mat and then some more of it".split() * 3, ["ÿé日本".encode()] * 9]
    for words, got in zip(texts, scorer.tokens(texts), strict=True):
        coded = [np.frombuffer(model.symbols(w), np.int16).tolist() for w in words] + [[lm_scoring.END]]
        slow = slow_log_probs(model, [s for c in coded for s in c])
        ends = np.cumsum([0] + [len(c) for c in coded])
        assert np.allclose(got, [sum(slow[a:b]) for a, b in zip(ends, ends[1:], strict=False)], atol=1e-3)
        assert len(got) == len(words) + 1


def test_next_symbol_is_a_distribution(model):
    n = lm_scoring.CLASSES * lm_scoring.MEMBERS
    inputs = np.full((n, lm_scoring.BLOCK), 600, np.int16)
    targets = np.full((n, lm_scoring.BLOCK), 5, np.int16)
    targets[:, 3] = np.arange(n)
    p = np.exp(model.log_probs(inputs, np.ones(n, bool), targets).astype(float))[:, 3]
    assert abs(p.sum() - 1) < 1e-3


def test_score_cases(spark):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7))) for _ in range(80)]
    rows = [(i, " ".join(rng.choice(vocabulary).upper() if rng.random() < 0.1 else rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))), "clash") for i in range(150)]
    rows += [(500, None, ""), (501, "", ""), (502, " \t\n", ""), (None, "no id", ""), rows[7], (503, "w" * 200 + " " + "w" * 200, ""), (504, "never-seen", "")]
    docs = spark.createDataFrame([(*r, 1, 2, "w", 3, 4) for r in rows], "doc_id long, text string, SCORE string, rid int, base int, word string, _text int, _rid int")
    out = lm_scoring.score(docs, RANKS, steps=5)
    assert set(out.columns) == {"doc_id", "rid", "base", "word", "_text", "_rid", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"}
    got = sorted((tuple(r[c] for c in ("n_tokens", "n_known", "train_tokens")), r["held_out"], -1 if r["doc_id"] is None else r["doc_id"], r["base_score"], r["score"]) for r in out.collect())
    words = {i: lm_scoring.words_of(t) for i, t, _ in rows}
    held = {i: i is None or zlib.crc32(str(i).encode()) % 10 == 0 for i in words}
    c = Counter(w for i, t, _ in rows if not held[i] for w in [*lm_scoring.words_of(t), b""])
    total = sum(c.values())
    below = total + 0.1 * (len(c) + 1)
    want = sorted(((len(words[i]) + 1, sum(c[w] > 0 for w in [*words[i], b""]), total), held[i], -1 if i is None else i, sum(np.log10((c[w] + 0.1) / below) for w in [*words[i], b""])) for i, _, _ in rows)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:3] == w[:3] and abs(g[3] - w[3]) < 1e-8 and -1e5 < g[4] < 0
    small = lm_scoring.HEAD_WORDS
    lm_scoring.HEAD_WORDS = 10
    try:
        again = sorted((r["doc_id"] or -1, r["n_tokens"], r["n_known"], round(r["base_score"], 8)) for r in lm_scoring.score(docs, RANKS, steps=5).collect())
    finally:
        lm_scoring.HEAD_WORDS = small
    assert again == sorted((-1 if g[2] <= 0 else g[2], g[0][0], g[0][1], round(g[3], 8)) for g in got)
    assert lm_scoring.score(docs.limit(0), RANKS, steps=1).count() == 0


def test_held_out_scores_beat_the_base(spark):
    rows = queries.op3(spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert rows and sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_gradients_are_slopes():
    rng = np.random.default_rng(2)
    size = lm_scoring.CLASSES * lm_scoring.MEMBERS
    texts = [rng.integers(0, size, n).astype(np.int16) for n in (3, 40, 21)]
    p, place = lm_scoring.start(lm_scoring.count_pairs(texts, [0, 16, 0]).reshape(size, size).astype(np.float32))
    inputs, first, targets, where = lm_scoring.windows(texts)
    real = np.zeros(targets.shape, bool)
    real.reshape(-1)[where] = True
    pick = np.arange(len(inputs))

    def loss():
        lp = lm_scoring.Model(RANKS, {}, lm_scoring.fold(p, place)).log_probs(inputs, first, targets)
        return -float(lp.astype(float)[real].mean())

    g = lm_scoring._gradients(p, lm_scoring.fold(p, place), inputs[pick - 1], inputs[pick], first, targets, real)
    assert g.keys() == p.keys()
    for key, x in p.items():
        d = g[key] / np.sqrt((g[key] ** 2).sum())
        old, h = x.copy(), np.float32(0.02)
        x += h * d
        up = loss()
        x[...] = old - h * d
        down = loss()
        x[...] = old
        assert np.isclose((up - down) / (2 * h), (g[key] * d).sum(), rtol=0.05, atol=1e-5), key


def test_every_window_trains(monkeypatch):
    seen = []
    real_gradients = lm_scoring._gradients
    monkeypatch.setattr(lm_scoring, "_gradients", lambda p, t, before, now, first, targets, real: seen.append(targets[real]) or real_gradients(p, t, before, now, first, targets, real))
    monkeypatch.setattr(lm_scoring, "WINDOWS", 7)
    texts = [np.arange(n, dtype=np.int16) for n in (1, 100, 333)]
    p, place = lm_scoring.start(np.ones((2048, 2048), np.float32))
    assert lm_scoring.fit(p, place, texts, [0, 16, 0], steps=1) == 1 + 84 + 333
    got = Counter(np.concatenate(seen).tolist())
    assert all(got[int(x)] for x in [*texts[0], *texts[1][16:], *texts[2]])


def test_long_documents_train_the_model(spark, monkeypatch):
    # every text is longer than 32 kB, and its words are new but made of subwords that follow a pattern
    def text(i):
        rng = random.Random(i)
        return " ".join("".join(rng.choice(("alpha", "omega")) for _ in range(6)) + str(rng.randrange(10**6)) for _ in range(1200))

    docs = spark.createDataFrame([(i, text(i)) for i in range(40)], "doc_id long, text string")
    monkeypatch.setattr(lm_scoring, "SHARD", 1 << 17)
    rows = lm_scoring.score(docs, RANKS, steps=40).collect()
    held = [r for r in rows if r["held_out"]]
    assert held and len(rows) == 40
    # far below the bare alphabet's 11 nats or more a subword: a word of 40 bytes costs under 14 decades
    assert sum(r["score"] for r in held) / sum(r["n_tokens"] for r in held) > -14


def test_rare_words_have_their_share_in_the_mix(spark, monkeypatch):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(vocabulary) for _ in range(50))) for i in range(200)], "doc_id long, text string")
    scores = lambda: {r["doc_id"]: r["score"] for r in lm_scoring.score(docs, RANKS, steps=3).collect()}
    whole = scores()
    monkeypatch.setattr(lm_scoring, "HEAD_WORDS", 5)
    few = scores()
    assert all(abs(few[i] - whole[i]) < 1e-3 for i in whole)


def test_op3_query(spark, sf_dir):
    docs = {r["doc_id"]: lm_scoring.words_of(r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in docs}
    c = Counter(w for i, words in docs.items() if not held[i] for w in [*words, b""])
    total, below = sum(c.values()), sum(c.values()) + 0.1 * (len(c) + 1)
    rows = queries.op3(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        tokens = [*docs[r["doc_id"]], b""]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(tokens), sum(c[w] > 0 for w in tokens), total)
        assert np.isclose(r["base_score"], sum(np.log10((c[w] + 0.1) / below) for w in tokens)) and np.isfinite(r["score"])


def test_columns_split_as_texts_do():
    texts = [None, "", " \t\n", "One two\x0btwo\x0cthree ", " É ÀB c d ", "a", " lead", "\x1cfs\x85nel"]
    words, at, lengths = lm_scoring.split_words(pa.array(texts))
    assert len(set(words.to_pylist())) == len(words)
    flat = iter(words.take(pa.array(at)).to_pylist())
    assert [[next(flat) for _ in range(n)] for n in lengths] == [lm_scoring.words_of(x) for x in texts]
    assert next(flat, None) is None
    assert [len(x) for x in lm_scoring.split_words(pa.array([], pa.string()))] == [0, 0, 0]


def test_words_coded_together_are_their_subwords(model, monkeypatch):
    words = [w.encode() for w in ("the", "über", "日本語x", "a", "mat,mat", "zqzqzq")]
    ids, raw = lm_scoring._merger(RANKS)

    def plain(word):
        out, last = [], len(ids(word)) - 1
        for n, i in enumerate(ids(word)):
            s = model.pieces.get(2 * i + (n == last))
            out += [s] if s is not None else [*raw[i][:-1], raw[i][-1] + 256 * (n == last)]
        return out

    lexicon = lm_scoring.Lexicon(model)
    monkeypatch.setattr(lm_scoring, "_CACHE_WORDS", 5)  # words are forgotten between calls
    for some in (words[:3], words[2:5], words[2:], words):
        flat, sizes = lexicon.symbols(lexicon.number(some))
        assert [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] == [plain(w) for w in some]


def test_sums_by_symbol():
    rng = np.random.default_rng(3)
    ids = np.minimum(rng.zipf(1.3, 5000) - 1, 2047).astype(np.int16)
    rows = np.concatenate([rng.normal(size=(5000, 6)), np.zeros((1, 6))]).astype(np.float32)
    want = np.zeros((2048, 6))
    np.add.at(want, ids, rows[:-1])
    assert np.allclose(lm_scoring._by_symbol(ids, rows), want, atol=1e-3)


def test_ends_count_though_many_words_are_more_frequent(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "HEAD_WORDS", 2)
    docs = spark.createDataFrame([(i, "a b " * 40 + f"w{i}") for i in range(30)], "doc_id long, text string")
    rows = lm_scoring.score(docs, RANKS, steps=2).collect()
    total, known = rows[0]["train_tokens"], [r for r in rows if not r["held_out"]]
    share = lambda c: np.log10((c + 0.1) / (total + 0.1 * (len(known) + 4)))
    for r in rows:
        assert r["n_known"] == 82 - r["held_out"]
        assert np.isclose(r["base_score"], 80 * share(40 * len(known)) + share(len(known)) + share(0 if r["held_out"] else 1))
