"""Byte-level BPE, token counts, token files, toxicity."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from gridloom.llm import bpe, queries, token_counts, token_store, toxicity

RANKS = public_tokenizers.path(queries.BYTE_RANKS)
SCHEMA = "doc_id long, text string, IDS string, N_tokens string, _text int, _key int, text_ int"
ODD = [None, "", " ", "a", "\n\n  x  \t\r\n", "it's we'll 'tis", "é́ ñ   \x1c\x1d y", "日本語 テキスト 123 ４５", "🙂🙂🙂 ok", "x" * 5000, " " * 3000 + "end", "<|endoftext|> <|startoftext|>x", "Σας ΣΑΣ İI"]


@pytest.fixture(scope="module")
def oracle():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_docs(spark):
    rng = random.Random(5)
    words = ["the", "it's", "  ", "\n", "über", "123", "!?", "x" * 40, "\t", "’", "ñandú"]
    long = ["".join(rng.choice(words) + rng.choice(["", " ", "  "]) for _ in range(n)) for n in (300, 2000)]
    texts = [*ODD, *long, long[1], "z" * 3000 + " " * 2000 + "q"]
    rows = [(i, t, "clash", "clash", 1, 2, 3) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[3], (None, "no id", "a", "b", 4, 5, 6)], SCHEMA), texts


def test_encode_decode_is_the_library_at_every_chunk_size(spark, oracle):
    docs, texts = odd_docs(spark)
    for chunk, overlap in ((16384, 256), (64, 16), (37, 9)):
        rows = bpe.encode_decode(docs, RANKS, public_tokenizers.PATTERN, chunk=chunk, overlap=overlap).collect()
        assert len(rows) == len(texts) + 2
        for r in rows:
            text = "no id" if r["doc_id"] is None else texts[r["doc_id"]] or ""
            assert r["ids"] == oracle.encode_ordinary(text), (text[:50], chunk)
            assert bytes(r["decoded"]) == text.encode()
            assert r["N_tokens"] in ("clash", "b") and (r["_text"], r["_key"], r["text_"]) in ((1, 2, 3), (4, 5, 6))
    assert bpe.encode_decode(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_stitching_equals_one_pass(oracle):
    code, rng, stitched = bpe.coder(RANKS, public_tokenizers.PATTERN), random.Random(1), 0
    for _ in range(600):
        text = "".join(rng.choice("ab1 '!\nsré  ") * rng.choice((1, 1, 1, 1, 1, 1, 1, 1, 3, 9)) for _ in range(rng.randrange(1, 220)))
        chunk, overlap = rng.randrange(32, 80), rng.randrange(12, 28)
        parts = bpe.cut(text, chunk, overlap)
        assert "".join(p[:chunk] for p in parts[:-1]) + parts[-1] == text
        ids = bpe.stitch([bpe.encode_chunk(p, i == len(parts) - 1, code, chunk, overlap) for i, p in enumerate(parts)])
        if ids is not None:
            stitched += len(parts) > 1
            assert ids.tolist() == oracle.encode_ordinary(text)
    assert stitched > 100


def test_op2_query(spark, sf_dir, oracle):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op2(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = oracle.encode_ordinary(docs[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


def test_count_tree_follows_random_edits(oracle):
    code, rng = bpe.coder(RANKS, public_tokenizers.PATTERN), random.Random(2)
    for _ in range(150):
        text = "".join(rng.choice("abé1 '!\n ") * rng.choice((1, 1, 2, 80)) for _ in range(rng.randrange(0, 60)))
        tree = token_counts.CountTree(text, code)
        for _ in range(6):
            a = rng.randrange(0, len(text) + 3)
            b = a + rng.choice((0, 0, 1, 5, 30))
            new = rng.choice(("", "x", "'s", "  ", "long er\n\n", "é"))
            tree.edit(a, b, new)
            a = min(a, len(text))
            text = text[:a] + new + text[max(a, min(b, len(text))) :]
            assert tree.text() == text
            assert (tree.n_tokens, tree.n_chars) == (len(oracle.encode_ordinary(text)), len(text))


def test_count_edited(spark, oracle):
    docs, texts = odd_docs(spark)
    rows = token_counts.count_edited(docs.withColumn("edits", queries.document_edits(docs.text)), RANKS, public_tokenizers.PATTERN).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        if r["doc_id"] is not None:
            text = texts[r["doc_id"]] or ""
            n = len(text)
            new = text
            for a, b, x in ((n // 5, n // 5 + 40, ""), (n * 2 // 5, n * 2 // 5, " It's been revised,"), (n * 3 // 5, n * 3 // 5 + 10, "[redacted]"), (n, n, "\n\nEnd.")):
                a = min(a, len(new))
                new = new[:a] + x + new[max(a, min(b, len(new))) :]
            assert (r["n_tokens"], r["n_tokens_edited"], r["n_chars_edited"]) == (len(oracle.encode_ordinary(text)), len(oracle.encode_ordinary(new)), len(new))
    odd = spark.createDataFrame([(1, "a b", None), (2, None, [(0, 0, "new text")]), (3, "c", [None, (None, 1, "x"), (0, 1, None)])], "doc_id long, text string, edits array<struct<start:int,end:int,replacement:string>>")
    assert {r["doc_id"]: r["n_tokens_edited"] for r in token_counts.count_edited(odd, RANKS, public_tokenizers.PATTERN).collect()} == {1: 2, 2: 2, 3: 0}


def test_op8_query(spark, sf_dir, oracle):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op8(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        text = docs[r["doc_id"]] or ""
        new, n = text, len(text)
        for a, b, x in ((n // 5, n // 5 + 40, ""), (n * 2 // 5, n * 2 // 5, " It's been revised,"), (n * 3 // 5, n * 3 // 5 + 10, "[redacted]"), (n, n, "\n\nEnd.")):
            a = min(a, len(new))
            new = new[:a] + x + new[max(a, min(b, len(new))) :]
        assert (r["n_tokens"], r["n_tokens_edited"], r["n_chars_edited"]) == (len(oracle.encode_ordinary(text)), len(oracle.encode_ordinary(new)), len(new))


def test_many_edits_in_one_place_keep_the_tree(oracle):
    code, rng = bpe.coder(RANKS, public_tokenizers.PATTERN), random.Random(6)
    text = "one two three four"
    tree = token_counts.CountTree(text, code)
    for _ in range(400):
        new = rng.choice(("word ", "x", "'s ", "12 "))
        tree.edit(8, 8, new)
        text = text[:8] + new + text[8:]
    assert tree.text() == text and tree.n_tokens == len(oracle.encode_ordinary(text))
    assert max(map(len, tree.slots)) <= max(token_counts.CROWD, len(tree.slots) ** 0.5) + 8 and tree.reencoded < 400 * 60


def test_token_file_random_access():
    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 511, 512, 513, 3000):
        ids = (rng.integers(0, 2**32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype("<u4")
        f = token_store.TokenFile(token_store.pack(ids, [None, 5], np.array([n // 3, n])))
        assert f.doc_ids == [None, 5] and [f[i] for i in range(n)] == ids.tolist()
        assert f.document(1).tolist() == ids[n // 3 :].tolist()
        for a in range(0, n, 97):
            b = min(n, a + 130)
            assert f.run(a, b).tolist() == ids[a:b].tolist()


def test_store_is_the_library(spark):
    docs, texts = odd_docs(spark)
    path = public_tokenizers.path(queries.WORD_TOKENIZER)
    t = Tokenizer.from_file(path)
    rows = sorted(token_store.store(docs, path).collect(), key=lambda r: r["start"])
    assert len(rows) == len(texts) + 2 and rows[0]["doc_id"] is None
    at = 0
    for r in rows:
        text = "no id" if r["doc_id"] is None else texts[r["doc_id"]]
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        assert (r["start"], r["n_tokens"]) == (at, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert [r["doc_id"] for r in rows[1:]] == sorted(r["doc_id"] for r in rows[1:])
    assert token_store.store(docs.limit(0), path).count() == 0


def test_special_strings_in_any_case():
    path = public_tokenizers.path(queries.WORD_TOKENIZER)
    t, enc, rng = Tokenizer.from_file(path), token_store.WordEncoder(path), random.Random(7)
    parts = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|startoftext|>", "<|STARTOFTEXT|>", "<|endof", "TEXT|>", " ", "a.", "B,", "it's", ".T", "É", "\u212a", "K.", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 8))) for _ in range(3000)]
    for x, ids in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, x


def test_op10_query(spark, sf_dir):
    t, at = Tokenizer.from_file(public_tokenizers.path(queries.WORD_TOKENIZER)), 0
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op10(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for d in docs:
        ids = [*t.encode(d["text"] or "", add_special_tokens=False).ids, 1]
        assert got[d["doc_id"]] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_files_split_inside_a_part(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text number {i} with words") for i in range(200)], "doc_id long, text string")
    path = public_tokenizers.path(queries.WORD_TOKENIZER)
    folder = f"file://{tmp_path}/files"
    rows = sorted(token_store.read_tokens(token_store.write_tokens(docs, folder, path, file_ids=50), folder).collect(), key=lambda r: r["doc_id"])
    starts = np.cumsum([0] + [r["n_tokens"] for r in rows])[:-1]
    assert [r["start"] for r in rows] == starts.tolist()


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 3, (600, 5)).astype(float)
    grades = np.digitize(x @ np.array([2.0, -1, 0, 0.5, 0]) + rng.normal(0, 0.3, 600), [1.0, 3.0])
    w, cuts = toxicity.fit_ordinal((*np.nonzero(x), x[np.nonzero(x)]), x.shape, grades, 3, l2=1e-4)
    assert np.all(np.diff(cuts) > 0)
    p = 1 / (1 + np.exp(-((x @ w)[:, None] - cuts[None, :])))
    mass = -np.diff(np.hstack([np.ones((600, 1)), p, np.zeros((600, 1))]), axis=1)
    assert (mass.argmax(1) == grades).mean() > 0.85


def test_toxicity_finds_held_out_toxic_documents(spark):
    rng = random.Random(4)
    clean = ["".join(rng.choice("aeioubdgklmnr") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    bad = ["vile", "grossly", "scornful"]
    rows = []
    for i in range(900):
        words = [rng.choice(clean) for _ in range(60)]
        if toxic := i % 6 == 0:
            for w in rng.sample(bad, 2):
                words[rng.randrange(60)] = w
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(None, None, "x"), (9000, "", "x"), (9000, "", "x")], "doc_id long, text string, rejected string")
    labels = spark.createDataFrame([(i, 1, z) for i, _, z in rows[:600]] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert docs.count() == 903 and not out[None]["rejected"] and not out[9000]["rejected"]
    assert sum(out[i]["rejected"] == bool(z) for i, _, z in rows[600:]) >= 297
    none = toxicity.fit(docs, labels.limit(0))
    assert not none.weights and toxicity.score(docs, none).where("rejected").count() == 0
    assert toxicity.score(docs.limit(0), none).count() == 0


def test_ordinal_fit_is_the_likeliest():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 3, (300, 4)).astype(float)
    grades = np.digitize(x @ np.array([1.5, -1, 0.3, 0.0]) + rng.logistic(0, 1, 300), [0.5, 2.5])
    w, cuts = toxicity.fit_ordinal((*np.nonzero(x), x[np.nonzero(x)]), x.shape, grades, 3, l2=0.0, steps=4000, rate=0.02)

    def loss(w, cuts):
        total = 0.0
        for row, g in zip(x, grades, strict=True):
            over = [1.0, *(1 / (1 + np.exp(-(row @ w - c))) for c in cuts), 0.0]
            total -= np.log(over[g] - over[g + 1])
        return total

    best = loss(w, cuts)
    for k in range(6):
        for h in (-0.02, 0.02):
            move = np.zeros(6)
            move[k] = h
            assert loss(w + move[:4], cuts + move[4:]) >= best - 1e-3


def test_op7_query(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    tables = spark.read.parquet(f"{sf_dir}/documents.parquet"), queries.graded_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    model = toxicity.fit(*tables, grade="grade")
    levels, rows = model.levels, queries.op7(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs) and list(levels) == sorted(levels) and levels[0] == 0
    for r in rows:
        z = sum(model.weights.get(f, 0.0) for w in set(toxicity.WORD.findall((docs[r["doc_id"]] or "").lower())) for f in toxicity.word_features(w))
        over = [1.0, *(1 / (1 + np.exp(-(z - c))) for c in model.thresholds), 0.0]
        mass = [a - b for a, b in zip(over, over[1:], strict=False)]
        assert np.isclose(r["severity"], sum(p * g for p, g in zip(mass, levels, strict=True))) and np.isclose(r["p_toxic"], over[1])
        assert r["rejected"] == (r["p_toxic"] >= toxicity.REJECT_FROM) and np.isclose(mass[levels.index(r["grade"])], max(mass))


def test_grades_come_from_the_labels(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("aeioubdgklmnr") for _ in range(5)) for _ in range(200)]
    rows = [(i, " ".join([*rng.choices(words, k=40), *(["vile"] if i % 3 else []), *(["horrid", "grossly"] if i % 3 == 2 else [])]), i % 3) for i in range(600)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows[:450]], "doc_id long, grade int")
    out = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.fit(docs, labels, grade="grade")).collect()}
    assert sum(out[i]["grade"] == g for i, _, g in rows[450:]) >= 147
