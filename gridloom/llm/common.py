"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Where intermediate tables go if the session names no shared folder (tests and laptops only).
FALLBACK_DIR = "file:///tmp/checkpoints/gridloom"
#: Rows of an Arrow batch: documents average a few kB, and a batch has to fit a Python worker many times over.
BATCH_ROWS = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; on one machine without that setting, a folder of its own."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if path is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return path or FALLBACK_DIR


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; Hadoop deletes it when the driver's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def staged(df: DataFrame, name: str, *, file_rows: int = 0) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut in the lineage that outlives executors. ``file_rows`` bounds the rows of a file, and of what is read at once."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").option("maxRecordsPerFile", file_rows).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files behind a table made by ``staged`` that no later plan reads."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small enough for a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores in front as it takes to clash with no column of ``df``, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, *names: str) -> list[str]:
    """The columns of ``df`` but those called ``names``, compared without case as Spark does."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows for what is run inside, and the session's own after it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` with one output batch for each input batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
