"""Publication: write to a staging folder, read back, validate, then rename; fingerprints; resumable batches."""

from __future__ import annotations

import hashlib
import json
import math
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.contracts import ContractError, bag_difference


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder if it is there."""
    fs, p = _fs(spark, path)
    if fs.exists(p):
        fs.delete(p, True)


def put_in_place(spark: SparkSession, stage: str, path: str) -> None:
    """Put ``stage`` at ``path``: what is there moves aside first and goes last, so that at every moment one of the two is whole."""
    fs, target = _fs(spark, path)
    _, new = _fs(spark, stage)
    _, aside = _fs(spark, f"{path.rstrip('/')}._old-{uuid.uuid4().hex}")
    had = fs.exists(target)
    if had and not fs.rename(target, aside):
        raise OSError(f"could not move {path} aside")
    if not fs.rename(new, target):
        if had:
            fs.rename(aside, target)
        raise OSError(f"could not put {stage} in place")
    if had:
        fs.delete(aside, True)


def publish_table(df: DataFrame, path: str, *, sort: str | None = None, validate: Callable[[DataFrame], None] | None = None, replace: bool = False, compression: str = "zstd") -> DataFrame:
    """Write, read back, compare as bags, validate, and only then put in place; on failure nothing remains.

    The comparison reads ``df`` again, so it should come from stored tables. Without ``replace`` an existing path is an error.
    """
    spark = df.sparkSession
    if exists(spark, path) and not replace:
        raise FileExistsError(path)
    stage = f"{path.rstrip('/')}._staging-{uuid.uuid4().hex}"
    fs, staged_path = _fs(spark, stage)
    try:
        (df.sort(sort) if sort else df).write.option("compression", compression).parquet(stage)
        back = spark.read.parquet(stage)
        if back.columns != df.columns or not bag_difference(df, back).isEmpty():
            raise ContractError("what was read back is not what was written")
        if validate:
            validate(back)
        put_in_place(spark, stage, path)
    finally:
        if fs.exists(staged_path):
            fs.delete(staged_path, True)
    return spark.read.parquet(path)


def write_json(spark: SparkSession, record: dict, path: str) -> None:
    """A JSON document without NaN or infinity, in place by one rename."""
    text = json.dumps(record, indent=2, sort_keys=True, allow_nan=False, default=lambda x: None if isinstance(x, float) and math.isnan(x) else str(x))
    stage = f"{path}.part-{uuid.uuid4().hex}"
    fs, part = _fs(spark, stage)
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    put_in_place(spark, stage, path)


def publish_all(spark: SparkSession, tables: dict[str, DataFrame], summary: dict, summary_path: str, *, replace: bool = False) -> None:
    """Publish several tables (path to table) and, once all are in place, the summary that names them: readers that see the summary see the tables."""
    for path, df in tables.items():
        publish_table(df, path, replace=replace)
    write_json(spark, summary | {"tables": sorted(tables)}, summary_path)


def fingerprint(spark: SparkSession, path: str) -> str:
    """SHA-256 over the names and contents of a path's files: each is read in blocks where a task runs, and the digests are combined in the order of names."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p in b["path"]:
                store, inner = FileSystem.from_uri(p if "://" in p else p.replace(":", "://", 1))
                h = hashlib.sha256()
                with store.open_input_stream(inner) as f:
                    while block := f.read(1 << 20):
                        h.update(block)
                rows.append(f"{p.rsplit('/', 1)[1]}:{h.hexdigest()}")
            yield pd.DataFrame({"line": rows})

    named = listed.mapInPandas(digest, "line string")
    return named.agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list("line"))), 256)).first()[0]


def table_fingerprint(df: DataFrame) -> DataFrame:
    """n_rows and an order-free digest of a table's rows, in one pass over any number of rows."""
    h = F.xxhash64(*[F.col(c) for c in df.columns])
    return df.agg(F.count("*").alias("n_rows"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("digest"))


def run_batches(
    spark: SparkSession, plan: DataFrame, compute: Callable[[DataFrame], DataFrame], path: str, *, version: str, batch: str = "batch_id", validate: Callable[[DataFrame], None] | None = None
) -> DataFrame:
    """Compute the batches of ``plan`` that ``path`` does not hold for this ``version``; results are appended by batch.

    A batch of another version is stale and an error, so that inputs can't mix. ``validate`` sees the finished batches before any is computed, and all at the end.
    """
    todo = plan
    if exists(spark, path):
        done = spark.read.parquet(path).select(batch, "version").distinct()
        stale = done.where(F.col("version") != version).count()
        if stale:
            raise ContractError(f"{stale} batches are of another version")
        if validate:
            validate(spark.read.parquet(path))
        todo = plan.join(done, batch, "left_anti")
    if not todo.isEmpty():
        compute(todo).withColumn("version", F.lit(version)).write.mode("append").parquet(path)
        if validate:
            validate(spark.read.parquet(path))
    return spark.read.parquet(path)


def _pointer(spark: SparkSession, path: str) -> tuple[int, dict | None]:
    """Number and content of the newest pointer of a table of batches; 0 and None if there is none."""
    fs, root = _fs(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
    numbers = sorted(int(n[8:-5]) for n in names if n.startswith("current-") and n.endswith(".json"))
    if not numbers:
        return 0, None
    text = "\n".join(r["value"] for r in spark.read.text(f"{path}/current-{numbers[-1]:08d}.json").collect())
    return numbers[-1], json.loads(text)


def _stored(spark: SparkSession, path: str, manifest: DataFrame, batch: str) -> DataFrame:
    """The rows of the runs that a manifest names, damaged and absent files left out, with the run of each in _run."""
    runs = [r["run"] for r in manifest.where("rows > 0").select("run").distinct().collect()]
    reader = spark.read.options(ignoreCorruptFiles="true", ignoreMissingFiles="true")
    paths = [f"{path}/runs/{r}" for r in sorted(runs)]
    # one file tells the columns, and all of them if that one is damaged
    for merged in ("false", "true") if paths else ():
        try:
            return reader.option("mergeSchema", merged).parquet(*paths)
        except AnalysisException as e:
            if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
                raise
    return manifest.select(F.col("batch").alias(batch), F.col("run").alias("_run")).limit(0)


def _batch_digests(rows: DataFrame, batch: str) -> DataFrame:
    """batch, run, rows and an order-free digest of each batch: one aggregation."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])
    per = rows.groupBy(F.col(batch).cast("string").alias("batch"), F.col("_run").alias("run"))
    return per.agg(F.count("*").alias("rows"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("digest"))


def read_batches(spark: SparkSession, path: str, *, batch: str = "batch_id") -> DataFrame:
    """The table of finished batches at ``path``, whole at any time: the newest pointer names a manifest, and rows no manifest names are not read."""
    _, current = _pointer(spark, path)
    if current is None:
        raise FileNotFoundError(path)
    manifest = spark.read.parquet(current["manifest"])
    named = manifest.select(F.col("batch").alias("_batch"), F.col("run").alias("_in"))
    rows = _stored(spark, path, manifest, batch)
    return rows.join(named, (F.col(batch).cast("string") == F.col("_batch")) & (F.col("_run") == F.col("_in")), "left_semi").drop("_run")


def resume_batches(
    spark: SparkSession, plan: DataFrame, compute: Callable[[DataFrame], DataFrame], path: str, *, version: str, batch: str = "batch_id", invalid: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Compute the batches of ``plan`` that ``path`` does not hold whole and valid, and return the table of all.

    A batch is reused if its rows and digest are those its manifest recorded and ``invalid`` (given the stored rows, it returns the ids of bad batches) does not name it; a damaged,
    missing or invalid one is computed again while the others stay. A batch of another ``version`` is an error, so that inputs can't mix. Results of a run are written
    apart, read back, checked and recorded in a manifest; the pointer to it comes last, by a rename to a new name, so a reader always sees a whole table and a run that
    breaks off changes nothing. A batch without rows is recorded, too. Runs that no batch is left in are deleted once the pointer has moved.
    """
    number, current = _pointer(spark, path)
    schema = "batch string, run string, rows long, digest string, version string"
    manifest = spark.read.parquet(current["manifest"]) if current else spark.createDataFrame([], schema)
    stale = manifest.where(F.col("version") != version).count()
    if stale:
        raise ContractError(f"{stale} batches are of another version")
    good = manifest
    if current:
        rows = _stored(spark, path, manifest, batch)
        named = manifest.select(F.col("batch").alias("_batch"), F.col("run").alias("_in"))
        rows = rows.join(named, (F.col(batch).cast("string") == F.col("_batch")) & (F.col("_run") == F.col("_in")), "left_semi")
        found = _batch_digests(rows, batch).select("batch", "run", F.col("rows").alias("_rows"), F.col("digest").alias("_digest"))
        same = (F.col("rows") == F.coalesce("_rows", F.lit(0))) & F.col("digest").eqNullSafe(F.col("_digest"))
        good = manifest.join(found, ["batch", "run"], "left").where(same).select(manifest.columns)
        if invalid is not None:
            good = good.join(invalid(rows.drop("_run")).select(F.col(batch).cast("string").alias("batch")).distinct(), "batch", "left_anti")
    wanted = plan.withColumn("_batch", F.col(batch).cast("string"))
    todo = wanted.join(good.select(F.col("batch").alias("_batch")), "_batch", "left_anti")
    if todo.isEmpty():
        return read_batches(spark, path, batch=batch)
    run, fs = uuid.uuid4().hex, _fs(spark, path)[0]
    folder, listing = f"{path}/runs/{run}", f"{path}/manifests/{run}"
    try:
        compute(todo.drop("_batch")).withColumn("_run", F.lit(run)).write.parquet(folder)
        back = spark.read.parquet(folder)
        ids = todo.select(F.col("_batch").alias("batch")).distinct()
        digests = _batch_digests(back, batch)
        strange = digests.join(ids, "batch", "left_anti").count()
        if strange:
            raise ContractError(f"{strange} batches were computed that were not asked for")
        if invalid is not None and not (bad := invalid(back.drop("_run"))).isEmpty():
            raise ContractError(f"{bad.select(batch).distinct().count()} batches are invalid though just computed")
        new = ids.join(digests, "batch", "left").select("batch", F.lit(run).alias("run"), F.coalesce("rows", F.lit(0).cast("long")).alias("rows"), "digest", F.lit(version).alias("version"))
        good.unionByName(new).write.parquet(listing)
        pointer = f"{path}/current-{number + 1:08d}.json"
        if exists(spark, pointer):
            raise ContractError(f"{pointer} was written by another run meanwhile")
        write_json(spark, {"manifest": listing, "version": version}, pointer)
    except BaseException:
        for part in (folder, listing):
            p = _fs(spark, part)[1]
            if fs.exists(p):
                fs.delete(p, True)
        raise
    left = {r["run"] for r in spark.read.parquet(listing).select("run").distinct().collect()}
    for status in fs.listStatus(_fs(spark, f"{path}/runs")[1]):
        if status.getPath().getName() not in left:
            fs.delete(status.getPath(), True)
    return read_batches(spark, path, batch=batch)
