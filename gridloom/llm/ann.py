"""Exact nearest neighbours by a block matrix join.

Vectors are scaled to unit length and quantised to int8 by blocks. A tile multiplies a block of queries with a block of
candidates in integers (held in float32, which is exact up to 2^24), which gives each cosine up to a known error. Pairs whose
upper bound reaches the k-th best lower bound are recomputed in double precision on the original vectors, and heaps of the k
best merge across tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import batches_of, staged

#: Vectors in a block of candidates and of queries: a tile of 2048 x 512 floats is 4 MB.
CANDIDATE_BLOCK, QUERY_BLOCK = 2048, 512
#: Blocks of queries that one task holds at a time, and blocks of candidates that pass by them.
QUERY_GROUP, CANDIDATE_GROUP = 48, 64
BLOCK_SCHEMA = "dim int, n int, ids binary, vectors binary, quantised binary, scales binary, errors binary"


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Pack valid vectors of one length into blocks."""
    waiting: dict[int, tuple[list[int], list[np.ndarray]]] = {}

    def flush(dim: int) -> pa.RecordBatch:
        ids, rows = waiting.pop(dim)
        v = np.vstack(rows)
        unit = v / np.sqrt((v * v).sum(1))[:, None]
        scale = np.abs(unit).max(1) / 127
        q = np.rint(unit / scale[:, None])
        err = np.sqrt(((unit - q * scale[:, None]) ** 2).sum(1))
        cols = [[dim], [len(ids)], [np.array(ids, np.int64).tobytes()], [v.tobytes()], [q.astype(np.int8).tobytes()], [scale.tobytes()], [err.tobytes()]]
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in BLOCK_SCHEMA.split(", ")])

    for batch in batches:
        for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if i is None or not x.is_valid or x.values.null_count:
                continue
            v = np.asarray(x.values.to_numpy(zero_copy_only=False), np.float64)
            if not v.size or not np.isfinite(v).all():
                continue
            squares = float(np.dot(v, v))
            if not 1e-140 < squares < 1e140:  # out of the range of doubles: brought near 1, which no cosine sees
                if not (top := np.abs(v).max()):
                    continue
                v = v / top
            ids, rows = waiting.setdefault(v.size, ([], []))
            ids.append(i)
            rows.append(v)
            if len(ids) == size:
                yield flush(v.size)
    for dim in list(waiting):
        yield flush(dim)


def _unpack(row: dict) -> tuple[np.ndarray, ...]:
    n = row["n"]
    return (
        np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"]).reshape(n, -1), np.frombuffer(row["quantised"], np.int8).reshape(n, -1).astype(np.float32),
        np.frombuffer(row["scales"]), np.frombuffer(row["errors"]),
    )


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of rows of x and y; sums run over the components in order, so equal vectors always get equal scores."""
    dot, xx, yy = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
    for d in range(x.shape[1]):
        dot += x[:, d] * y[:, d]
        xx += x[:, d] * x[:, d]
        yy += y[:, d] * y[:, d]
    return np.clip(dot / np.sqrt(xx * yy), -1, 1)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _tiles(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k best of each query block over the tiles of this task."""
    heaps: dict[bytes, list[tuple[np.ndarray, np.ndarray]]] = {}

    def out(key: bytes) -> pa.RecordBatch:
        ids, heap = np.frombuffer(key, np.int64), heaps.pop(key)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(ids, [len(c) for _, c in heap]), pa.int64()), pa.array(np.concatenate([c for _, c in heap]), pa.int64()), pa.array(np.concatenate([s for s, _ in heap]), pa.float64())],
            names=["query_id", "vec_id", "score"],
        )

    for batch in batches:
        for row in batch.to_pylist():
            qi, qv, qq, qs, qe = _unpack({c[2:]: v for c, v in row.items() if c.startswith("q_")} | {"n": row["q_n"]})
            ci, cv, cq, cs, ce = _unpack({c[2:]: v for c, v in row.items() if c.startswith("c_")} | {"n": row["c_n"]})
            key = row["q_ids"]
            if key not in heaps:
                if len(heaps) >= 64:
                    yield out(next(iter(heaps)))
                heaps[key] = [(np.empty(0), np.empty(0, np.int64)) for _ in qi]
            heap = heaps[key]
            near = (qq @ cq.T).astype(np.float64) * qs[:, None] * cs[None, :]
            # |<x,y> - <x',y'>| <= |x-x'| |y| + |x'| |y-y'|, and |x'| <= 1 + |x-x'|; the last term covers rounding
            slack = qe[:, None] + (1 + qe)[:, None] * ce[None, :] + 1e-9
            low = near - slack
            own = qi[:, None] == ci[None, :]
            low[own] = -np.inf
            kth = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] >= k else np.full(len(qi), -np.inf)
            known = np.array([s[-1] if len(s) == k else -np.inf for s, _ in heap])
            a, b = np.nonzero((near + slack >= np.maximum(kth, known)[:, None]) & ~own)
            for lo in range(0, len(a), 65536):
                x, y = a[lo : lo + 65536], b[lo : lo + 65536]
                s = _cosines(qv[x], cv[y])
                cuts = np.flatnonzero(np.diff(x, prepend=-1))
                for start, end in zip(cuts, [*cuts[1:], len(x)], strict=True):
                    old_s, old_i = heap[x[start]]
                    all_s, all_i = np.concatenate([old_s, s[start:end]]), np.concatenate([old_i, ci[y[start:end]]])
                    keep = _best(all_s, all_i, k)
                    heap[x[start]] = (all_s[keep], all_i[keep])
    for key in list(heaps):
        yield out(key)


def nearest(vectors: DataFrame, queries: DataFrame, *, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score (cosine, double precision) of each query's k nearest among ``vectors``.

    Rows without an id, and vectors that are null, empty, zero or hold null or non-finite components, take no part; vectors of
    another length than the query's are no candidates. Ties go to the smaller vec_id. A query's own id is never a candidate. Of
    query rows that share an id, the smallest vector is the query; repeated candidate rows each count. Extra columns are
    ignored. No queries or no vectors: an empty result.
    """
    spark = vectors.sparkSession
    plain = lambda df: df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    pack = lambda df, size: df.mapInArrow(lambda it: _blocks(it, size), BLOCK_SCHEMA)
    named = lambda df, p: df.select([F.col(c).alias(p + c) for c in df.columns])
    single = plain(queries).where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    # every group of query blocks meets every group of candidate blocks in a task of its own: tiles have a key, no side is broadcast or crossed, and both groups are
    # of a bounded size, so a task's memory does not grow with the queries
    groups = max(2, 2 * spark.sparkContext.defaultParallelism, -(-vectors.count() // (CANDIDATE_BLOCK * CANDIDATE_GROUP)))
    parts = max(1, -(-single.count() // (QUERY_BLOCK * QUERY_GROUP)))
    dealt = lambda df, ids, name, n: df.withColumn(name, F.pmod(F.xxhash64(ids), F.lit(n)).cast("int"))
    copied = lambda df, name, n: df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    c = copied(dealt(named(pack(plain(vectors), CANDIDATE_BLOCK), "c_"), "c_ids", "grp", groups), "part", parts)
    q = copied(dealt(named(pack(single, QUERY_BLOCK), "q_"), "q_ids", "part", parts), "grp", groups)
    tiles = c.join(q.hint("shuffle_hash"), (c["grp"] == q["grp"]) & (c["part"] == q["part"]) & (c["c_dim"] == q["q_dim"])).drop("grp", "part")
    with batches_of(spark, 16):
        found = staged(tiles.mapInArrow(lambda it: _tiles(it, k), "query_id long, vec_id long, score double"), "nearest-found")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
