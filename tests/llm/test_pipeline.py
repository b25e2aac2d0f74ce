"""The pipeline, stage by stage, against brute force."""

import base64
import itertools

import public_tokenizers
import tiktoken

import corpus_pipeline
from gridloom.llm import decontam, near_copies, queries, simhash
from tests.llm.test_decontam import slow_distance
from tests.llm.test_suffix_dedup import slow


def read(spark, path):
    return spark.read.parquet(path)


def near_copies_by_all_pairs(texts):
    ids = sorted(texts)
    sets = {i: set(near_copies.shingles(texts[i]).tolist()) for i in ids}
    prints = {i: simhash.fingerprint(texts[i], near_copies.SHINGLE) for i in ids}
    rep = {i: i for i in ids}

    def root(i):
        while rep[i] != i:
            i = rep[i]
        return i

    for a, b in itertools.combinations(ids, 2):
        low, high = sorted((len(sets[a]), len(sets[b])))
        near = (prints[a] ^ prints[b]).bit_count() <= simhash.RADIUS
        if near or low >= 0.8 * high > 0 and (both := len(sets[a] & sets[b])) >= 0.8 * (low + high - both):
            x, y = root(a), root(b)
            rep[max(x, y)] = min(x, y)
    return {root(i) for i in ids}


def test_stages_follow_each_other(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, step = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = step[name] = read(spark, str(tmp_path / name))
        assert name == "byte_level_bpe" or docs.columns == columns
    rows = {n: {r["doc_id"]: r["text"] for r in d.collect()} for n, d in step.items()}
    first = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    mild = [i for i in first if labels.get(i) == 0]
    assert sum(i in rows["toxicity"] for i in mild) >= 0.99 * len(mild)
    assert rows["simhash_near_dedup"].keys() == near_copies_by_all_pairs(rows["toxicity"])
    before = list(rows["simhash_near_dedup"].items())
    after = rows["suffix_array_dedup"]
    assert after == {i: w[3].decode(errors="ignore") for (i, _), w in zip(before, slow([t for _, t in before], 200), strict=True)}
    items = [decontam.normalise(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    near = lambda t: any(x in decontam.normalise(t) for x in items)
    gone = after.keys() - rows["benchmark_decontamination"].keys()
    assert {i for i, t in after.items() if near(t)} <= gone
    for i in gone:
        assert any(slow_distance(x, decontam.normalise(after[i])) <= int(0.1 * len(x)) for x in items)
    with open(public_tokenizers.path(queries.BYTE_RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    oracle = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in step["byte_level_bpe"].collect():
        assert r["ids"] == oracle.encode_ordinary(rows["benchmark_decontamination"][r["doc_id"]]) and r["text"] == rows["benchmark_decontamination"][r["doc_id"]]


def test_cut_characters_go(spark):
    a = "é" * 150
    docs = spark.createDataFrame([(1, "x" + a, 151), (2, a + "y", 151), (3, None, None), (4, "ü� ok", 5)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.remove_repeats(spark, docs, "").collect()}
    assert got == {1: ("x", 1), 2: ("y", 1), 3: ("", 0), 4: ("ü� ok", 5)}
    tail = "\u0169" + "z" * 220
    docs = spark.createDataFrame([(1, "A\ufffd \u0168" + tail[1:]), (2, "B " + tail)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.remove_repeats(spark, docs, "").collect()}
    assert got[1].startswith("A\ufffd ") and got[2].startswith("B ")


def test_odd_tables_pass_every_stage(spark, sf_dir):
    long = "word " * 30_000
    rows = [(1, None, "x"), (2, "", "x"), (3, "a clean text", "x"), (3, "a clean text", "x"), (None, "no id here", None), (4, long, "x"), (5, long, "x"), (6, "a\ufffdb", "x")]
    clash = "kept int, hits int, rejected int, grade int, spans int, fp int, mark int, _text int, ids int, n_bytes int"
    docs = spark.createDataFrame([(*r, 7, *range(10)) for r in rows], f"doc_id long, text string, lang string, n_chars long, {clash}")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        got = out.collect()
        if name == "byte_level_bpe":
            assert len(got) == len(rows) and {r["text"] for r in got if r["doc_id"] in (1, 2)} == {""}
        else:
            assert out.columns == docs.columns, name
            assert all([r[c] for c in docs.columns[4:]] == list(range(10)) for r in got), name
            ids = sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in got)
            assert ids == ([-1, 1, 3, 4, 6] if name == "simhash_near_dedup" else [-1, 1, 2, 3, 3, 4, 5, 6]), name
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name


def test_run_is_the_stages(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "n_tokens", "ids", "text"] and out.where("n_tokens <> size(ids)").count() == 0
