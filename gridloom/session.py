"""Session helpers: a tuned builder, and lineage cuts that survive lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Where checkpoints go if the session names no shared folder (tests and laptops only).
FALLBACK_DIR = "file:///tmp/checkpoints/gridloom"


def build_session(app: str = "gridloom", **conf: str) -> SparkSession:
    """A session with adaptive execution, skew joins and UTC; ``conf`` overrides."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.sql.python.filterPushdown.enabled": "true",
    }
    builder = SparkSession.builder.appName(app)
    for k, v in (base | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that ``spark.checkpoint.dir`` names and all executors share; it goes when the driver's JVM ends."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{(base or FALLBACK_DIR).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder that ``spark.checkpoint.dir`` names."""
    context = df.sparkSession.sparkContext
    if not context.getConf().get("spark.checkpoint.dir", None) and context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(FALLBACK_DIR)
    return df.checkpoint()
