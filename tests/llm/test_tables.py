"""URL filters and nearest neighbours."""

import datetime as dt
import random

import numpy as np
import pytest

from gridloom.llm import ann, queries, url_filters

D = dt.date


def test_url_filter_cases(spark):
    events = spark.createDataFrame(
        [
            ("spam", "bad.example", "add", D(2024, 1, 1)), ("spam", "bad.example", "remove", D(2024, 2, 1)), ("spam", "BAD.example", "add", D(2024, 3, 1)),
            ("adult", "x.bad.example", "add", D(2024, 1, 15)), ("spam", "tie.example", "add", D(2024, 1, 1)), ("spam", "tie.example", "remove", D(2024, 1, 1)),
            (None, "null.example", "add", D(2024, 1, 1)), ("spam", "null.example", "add", None), ("spam", "localhost", "add", D(2024, 1, 1)), ("spam", "bad.example", "add", D(2024, 1, 1)),
        ],
        "list_name string, key string, action string, at date",
    )
    cases = [
        ("http://bad.example/a", D(2023, 12, 31), None), ("http://bad.example/a", D(2024, 1, 1), "bad.example"), ("http://bad.example/a", D(2024, 1, 31), "bad.example"),
        ("http://bad.example/a", D(2024, 2, 1), None), ("https://www.Bad.Example.:8080/?q", D(2024, 3, 1), "bad.example"), ("http://u:p@x.bad.example", D(2024, 1, 14), "bad.example"),
        ("http://x.bad.example", D(2024, 1, 15), "x.bad.example"), ("http://x.bad.example", D(2024, 2, 15), "x.bad.example"), ("http://tie.example", D(2024, 5, 1), None),
        ("http://null.example", D(2024, 5, 1), None), ("http://localhost:99/", D(2024, 5, 1), "localhost"), (None, D(2024, 5, 1), None), ("not a url", D(2024, 5, 1), None), ("http://bad.example", None, None), ("", D(2024, 1, 1), None),
    ]
    captures = spark.createDataFrame([(i, u, d, "clash", d) for i, (u, d, _) in enumerate(cases)] * 2, "page_id long, url string, fetched_at date, key string, seg_from date")
    rows = url_filters.filter_urls(captures, events).collect()
    assert len(rows) == 2 * len(cases)
    for r in rows:
        assert r["matched_key"] == cases[r["page_id"]][2], r
        assert r["blocked"] == (cases[r["page_id"]][2] is not None) and r["key"] == "clash"
    assert url_filters.filter_urls(captures, events.limit(0)).where("blocked").count() == 0
    assert url_filters.filter_urls(captures.limit(0), events).count() == 0


def test_url_filter_plan_is_native(spark, sf_dir):
    plan = queries.op1(spark, sf_dir)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow")) and "html" not in plan.split("== Physical Plan ==")[1]


@pytest.mark.parametrize(("block", "group"), [(ann.QUERY_BLOCK, ann.QUERY_GROUP), (2, 1), (1, 2)])
def test_nearest_equals_brute_force(spark, monkeypatch, block, group):
    monkeypatch.setattr(ann, "QUERY_BLOCK", block)
    monkeypatch.setattr(ann, "QUERY_GROUP", group)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 8)).astype(np.float32)
    base[200:260] = base[10]  # ties by the dozen
    base[260:280] = base[20] * 2
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(base)]
    bad = [(1000, None, ""), (1001, [], ""), (1050, [0.0] * 8, ""), (1100, [1.0, None] * 4, ""), (1150, [float("nan")] * 8, ""), (1200, [float("inf")] + [0.0] * 7, ""), (1250, [1.0, 2.0], ""), (None, [1.0] * 8, "")]
    vectors = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, score string").repartition(5)
    out = ann.nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    x = base.astype(float)
    assert set(got) == set(range(0, 300, 50))
    for q, found in got.items():
        s = ann._cosines(np.repeat(x[q : q + 1], 300, 0), x)
        s[q] = -9
        best = sorted(range(300), key=lambda i: (-s[i], i))[:5]
        assert found == [(i, s[i]) for i in best]
    few = vectors.where("vec_id in (0, 1, 2)")
    assert ann.nearest(few, few.where("vec_id = 0")).count() == 2
    assert ann.nearest(vectors.limit(0), vectors.limit(0)).count() == 0


def test_quantisation_bound_holds():
    rng = random.Random(0)
    import pyarrow as pa

    vs = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(50)]
    batch = pa.RecordBatch.from_pydict({"vec_id": pa.array(range(50), pa.int64()), "embedding": pa.array(vs, pa.list_(pa.float64()))})
    block = next(ann._blocks(iter([batch]), 100)).to_pylist()[0]
    _, v, q, s, e = ann._unpack(block)
    unit = v / np.sqrt((v * v).sum(1))[:, None]
    near = (q @ q.T) * s[:, None] * s[None, :]
    assert np.all(np.abs(unit @ unit.T - near) <= e[:, None] + (1 + e)[:, None] * e[None, :] + 1e-9)
