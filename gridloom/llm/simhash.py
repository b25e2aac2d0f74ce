"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints of 64 bits link at a radius of r differing bits. Each bit position gets a vector of r + 1 bits; each non-zero vector v
makes a mask of the positions whose vector has an odd product with v. For any r positions some v is orthogonal to all their vectors, so
a pair within the radius agrees under some mask: no pair is missed, with 2^(r+1) - 1 tables. A bucket too large to compare all
its pairs is masked again over the bits it does not agree on yet; that is exact too, and ends when few bits are left.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import batches_of, small_batches, staged, unused, without

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42
#: Members of a bucket whose pairs are compared; a larger bucket is masked again.
BUCKET = 512
_ALL = (1 << BITS) - 1


def shingle_hashes(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Hashes of all word shingles, repeats included; a shorter text is one shingle, a wordless one has none. Bytes are lower-cased and split as ASCII."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, "<u8")
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], "<u8")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    return np.array([digest(joined[a:b], seed) for a, b in spans], "<u8")


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; 0 without hashes."""
    counts = np.zeros(BITS, np.int64)
    for lo in range(0, hashes.size, 32768):
        counts += np.unpackbits(hashes[lo : lo + 32768].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > hashes.size, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Majority bits of the hashes of all word shingles; 0 without words."""
    return majority(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, *, text: str = "text", shingle: int = SHINGLE, name: str = "fp") -> DataFrame:
    """``docs`` without the text but with ``name``, the fingerprint as a (signed) long; every row stays, a null text has fingerprint 0."""
    small_batches(docs.sparkSession)
    kept = without(docs, text, name)
    (data,) = unused(docs, "text_")
    src = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias(data))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x, shingle) for x in b.column(b.num_columns - 1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp)], names=[*kept, name])

    return src.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]), f"`{name}` long"]))


@lru_cache(maxsize=4096)
def covering(free: int, radius: int = RADIUS) -> tuple[int, ...]:
    """For bits ``free``, what stays free under each of the 2^(radius + 1) - 1 masks; any ``radius`` free bits stay free under one."""
    n = (1 << (radius + 1)) - 1
    places = [i for i in range(BITS) if free >> i & 1]
    return tuple(sum(1 << p for k, p in enumerate(places) if ((k % n + 1) & v).bit_count() % 2 == 0) for v in range(1, n + 1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _mask_again(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Each row (free, fp) under each mask over its free bits."""
    for b in batches:
        free, fp = b.column(0).to_numpy(), b.column(1).to_numpy()
        for f in np.unique(free).tolist():
            own = fp[free == f]
            for left in map(_signed, covering(f & _ALL, radius)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(own.size, left)), pa.array(own & ~np.int64(left)), pa.array(own)], names=["free", "key", "fp"])


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links (member, smallest of its linked set) in each bucket of the rows (free, key, fp), which come sorted by bucket."""
    rest: list[np.ndarray] = []

    def of(cols: list[np.ndarray]) -> pa.RecordBatch | None:
        cut = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])) + 1
        u, v = [], []
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(cols[2])], strict=True):
            if b - a > 1:
                x = np.unique(cols[2][a:b])
                near = np.bitwise_count((x[:, None] ^ x[None, :]).view(np.uint64)) <= radius
                label, old = np.arange(x.size), None
                while old is None or (label != old).any():
                    old, label = label, np.where(near, label[None, :], x.size).min(1)
                far = label != np.arange(x.size)
                u.append(x[far])
                v.append(x[label[far]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"]) if u else None

    for b in batches:
        cols = [np.concatenate([r, b.column(i).to_numpy()]) for i, r in enumerate(rest)] if rest else [b.column(i).to_numpy() for i in range(3)]
        last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
        at = int(last[-1]) + 1 if last.size else 0
        if at and (out := of([c[:at] for c in cols])) is not None:
            yield out
        rest = [c[at:] for c in cols]
    if rest and rest[0].size and (out := of(rest)) is not None:
        yield out


def links(fps: DataFrame, *, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links u, v between distinct fingerprints (column fp) whose connected components are those of all pairs within ``radius``."""
    bucket = max(bucket, 128)  # under 8 free bits a mask may free them all again, and 7 bits tell 128 apart
    spark = fps.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    todo = fps.select(F.lit(-1).cast("long").alias("free"), "fp")
    found = None
    while True:
        with batches_of(spark, 10_000):  # fingerprints are short; the session's own batches are for whole texts
            masked = todo.mapInArrow(lambda it: _mask_again(it, radius), "free long, key long, fp long")
            masked = staged(masked.distinct() if found is not None else masked, "simhash-masked")
            sizes = masked.groupBy("free", "key").agg(F.count("*").alias("size")).where("size > 1")
            shared = staged(masked.join(sizes, ["free", "key"]), "simhash-buckets")
            small = shared.where(F.col("size") <= bucket).select("free", "key", "fp").repartition(n, "free", "key").sortWithinPartitions("free", "key")
            new = staged(small.mapInArrow(lambda it: _links(it, radius), "u long, v long"), "simhash-links")
        found = new if found is None else found.unionByName(new)
        todo = shared.where(F.col("size") > bucket).select("free", "fp").distinct()
        if todo.isEmpty():
            return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, rep (the smallest node of its component) for every node of ``edges`` (u, v), by alternating large and small stars.

    Each round is a few joins and aggregations over the edges alone and is written to the shared folder.
    """
    now = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = mark(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = staged(moved.select("e.u", "e.v").where("u <> v").distinct(), "stars")
        if (new := mark(after)) == seen:
            return after.select(F.col("u").alias("node"), F.col("v").alias("rep"))
        now, seen = after, new
    return now.select(F.col("u").alias("node"), F.col("v").alias("rep"))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id that links reach) and the other columns but the text.

    Every row stays, repeated rows too. Null, empty and wordless texts have fingerprint zero and link like any other. A null doc_id
    belongs to its component but is never its smallest; a component without ids has a null component_id. Equal fingerprints are
    compared once, so groups of copies cost what one document costs. Columns named like results are replaced. Empty in, empty out.
    """
    keep = without(docs, doc_id, text, "doc_id", "fingerprint", "component_id")
    fp, data, root, rep = unused(docs, "fp_", "data_", "root_", "rep_")
    src = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias(data), *[F.col(f"`{c}`") for c in keep])
    prints = staged(fingerprints(src, text=data, shingle=shingle, name=fp), "simhash-prints")
    fps = prints.groupBy(fp).agg(F.min("doc_id").alias(root))
    reps = components(links(fps.select(F.col(fp).alias("fp")), radius=radius, bucket=bucket))
    placed = fps.join(reps, F.col(fp) == F.col("node"), "left").select(fp, root, F.coalesce("rep", fp).alias(rep))
    least = placed.groupBy(rep).agg(F.min(root).alias("component_id"))
    out = prints.join(placed.join(least, rep).select(fp, "component_id"), fp)
    return out.select("doc_id", F.lower(F.lpad(F.hex(fp), 16, "0")).alias("fingerprint"), "component_id", *[F.col(f"`{c}`") for c in keep])


def keep_first(docs: DataFrame, groups: DataFrame, *, doc_id: str, text: str) -> DataFrame:
    """Of ``docs`` one row for each group of ``groups`` (id, mark, group): the smallest doc_id, of rows that share it the smallest hash of the text."""
    mark, own, own_mark = unused(docs, "mark_", "own_", "own_mark_")
    key = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("mark"))
    first = groups.groupBy("group").agg(F.min(key).alias("k")).select(F.col("k.id").alias(own), F.col("k.mark").alias(own_mark)).distinct()
    marked = docs.withColumn(mark, text_mark(text))
    same = (F.col(mark) == F.col(own_mark)) & F.col(f"`{doc_id}`").cast("long").eqNullSafe(F.col(own))
    return marked.join(first, same).dropDuplicates([doc_id, mark]).select(*[F.col(f"`{c}`") for c in docs.columns])


def text_mark(text: str):
    """A hash of the text that tells a null one from an empty one."""
    return F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("\0")))


def drop_near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One document of each component, the one with the smallest doc_id (of rows that share it, the smallest hash of the text).

    Null, empty and wordless texts are one component. A component without any id keeps one row. All columns stay. Empty in, empty out.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), text_mark(text).alias("mark"))
    found = near_duplicates(rows, radius=radius, shingle=shingle)
    # a group without any id keeps one row by its fingerprint's hash alone
    name = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("fp"), "fingerprint"))
    return keep_first(docs, found.select(F.col("doc_id").alias("id"), "mark", name.alias("group")), doc_id=doc_id, text=text)
