"""What is held at once of long texts' ids is bounded, however many long texts there are."""

import glob

import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq

from gridloom.llm import bpe, queries


def test_files_of_long_texts_have_few_rows(spark, monkeypatch):
    files, staged = [], bpe.staged

    def noted(df, name, **options):
        out = staged(df, name, **options)
        files.extend(glob.glob(out.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0] + "/*.parquet"))
        return out

    monkeypatch.setattr(bpe, "staged", noted)
    texts = {i: f"text {i} runs on for some words and then on" for i in range(1200)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = bpe.encode_decode(docs, public_tokenizers.path(queries.BYTE_RANKS), public_tokenizers.PATTERN, chunk=16, overlap=12)
    rows = [pq.read_metadata(f).num_rows for f in files]
    assert sum(rows) == 1200 and max(rows) <= 128
    assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in out.collect()} == texts


def test_spans_are_whole_rows_in_order():
    batch = pa.RecordBatch.from_arrays([pa.array([[1] * n for n in (3, 0, 4, 9, 1, 1, 0)])], names=["ids"])
    spans = list(bpe.in_spans(batch, batch.column(0).value_lengths(), 5))
    assert [[len(x) for x in s.column(0).to_pylist()] for s in spans] == [[3, 0], [4], [9], [1, 1, 0]]
    assert list(bpe.in_spans(batch.slice(0, 0), batch.column(0).slice(0, 0).value_lengths(), 5)) == []
