"""File formats as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.contracts import require


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def view(spark: SparkSession, path: str, name: str) -> None:
    """A Parquet path as a SQL view; nothing is read."""
    spark.read.parquet(path).createOrReplaceTempView(name)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A CSV with header; a row that does not fit the schema is an error."""
    return spark.read.schema(schema).option("header", "true").option("mode", "FAILFAST").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header: for reports, not for data."""
    df.coalesce(1).write.option("header", "true").mode("errorifexists").csv(path)


def find_json(spark: SparkSession, folder: str, condition: str, schema: str) -> DataFrame:
    """The one JSON document below ``folder`` that meets a condition, with its file_path; none or several are an error."""
    found = spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").json(folder).select("*", F.col("_metadata.file_path").alias("file_path")).where(condition)
    n = found.limit(2).count()
    require(n == 1, f"{'no document' if not n else 'several documents'} below {folder} match {condition}")
    return found
