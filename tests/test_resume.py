"""Batches that are resumed: damage, staleness, runs that break off."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from gridloom.contracts import ContractError
from gridloom.sources import publish


def plan_of(spark, n):
    return spark.createDataFrame([(f"b{i}", i) for i in range(n)], "batch_id string, i int")


def computed(log):
    def run(todo):
        log.append(sorted(r["batch_id"] for r in todo.select("batch_id").collect()))
        rows = todo.where("i <> 3").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("v", F.col("i") * 100 + F.col("k"))
        return rows.repartition(4, "batch_id")

    return run


def content(df):
    return sorted((r["batch_id"], r["k"], r["v"]) for r in df.collect())


def test_batches_are_computed_once_and_damaged_ones_again(spark, tmp_path):
    path, log = f"file://{tmp_path}/t", []
    first = publish.resume_batches(spark, plan_of(spark, 3), computed(log), path, version="1")
    want = content(computed([])(plan_of(spark, 6)))
    assert content(first) == [r for r in want if r[0] < "b3"]
    assert content(publish.resume_batches(spark, plan_of(spark, 6), computed(log), path, version="1")) == want
    assert content(publish.resume_batches(spark, plan_of(spark, 6), computed(log), path, version="1")) == want
    assert log == [["b0", "b1", "b2"], ["b3", "b4", "b5"]]  # b3 has no rows and is done all the same
    # a file of the first run is cut short
    files = sorted(f for f in glob.glob(f"{tmp_path}/t/runs/*/part-*.parquet") if os.path.getsize(f) > 900)
    victim = files[0]
    lost = {r["batch_id"] for r in spark.read.parquet(f"file://{victim}").select("batch_id").distinct().collect()}
    with open(victim, "r+b") as f:
        f.truncate(os.path.getsize(victim) // 2)
    for crc in glob.glob(os.path.join(os.path.dirname(victim), ".*.crc")):
        os.remove(crc)
    assert content(publish.resume_batches(spark, plan_of(spark, 6), computed(log), path, version="1")) == want
    assert lost and log[-1] == sorted(lost) and len(log) == 3
    # and one is deleted
    victim = sorted(f for f in glob.glob(f"{tmp_path}/t/runs/*/part-*.parquet") if os.path.getsize(f) > 900)[-1]
    lost = {r["batch_id"] for r in spark.read.option("ignoreCorruptFiles", True).parquet(f"file://{victim}").select("batch_id").distinct().collect()}
    os.remove(victim)
    assert content(publish.resume_batches(spark, plan_of(spark, 6), computed(log), path, version="1")) == want
    assert len(log) == 4 and set(log[-1]) & lost and set(log[-1]) != {f"b{i}" for i in range(6)}


def test_any_or_every_file_may_be_damaged(spark, tmp_path):
    path, log = f"file://{tmp_path}/t", []
    want = content(publish.resume_batches(spark, plan_of(spark, 3), computed(log), path, version="1"))
    for cut in (lambda files: files[:1], lambda files: files):  # Spark takes the columns from the first file
        for victim in cut(sorted(glob.glob(f"{tmp_path}/t/runs/*/part-*.parquet"))):
            with open(victim, "r+b") as f:
                f.truncate(os.path.getsize(victim) // 2)
        for crc in glob.glob(f"{tmp_path}/t/runs/*/.*.crc"):
            os.remove(crc)
        assert content(publish.resume_batches(spark, plan_of(spark, 3), computed(log), path, version="1")) == want
    assert log[-1] == ["b0", "b1", "b2"]


def test_stale_batches_are_an_error(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    publish.resume_batches(spark, plan_of(spark, 2), computed([]), path, version="1")
    with pytest.raises(ContractError, match="another version"):
        publish.resume_batches(spark, plan_of(spark, 3), computed([]), path, version="2")


def test_a_run_that_breaks_off_changes_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    publish.resume_batches(spark, plan_of(spark, 2), computed([]), path, version="1")
    before = content(publish.read_batches(spark, path))

    def broken(todo):
        return computed([])(todo).withColumn("v", F.when(F.col("k") == 7, F.raise_error(F.lit("broken"))).otherwise(F.col("v")))

    with pytest.raises(Exception, match="broken"):
        publish.resume_batches(spark, plan_of(spark, 4), broken, path, version="1")
    assert content(publish.read_batches(spark, path)) == before and len(glob.glob(f"{tmp_path}/t/runs/*")) == 1
    os.makedirs(f"{tmp_path}/t/runs/abandoned")  # as of a driver that died
    assert content(publish.read_batches(spark, path)) == before
    with pytest.raises(ContractError, match="not asked for"):
        publish.resume_batches(spark, plan_of(spark, 4), lambda p: computed([])(plan_of(spark, 9)), path, version="1")
    assert content(publish.resume_batches(spark, plan_of(spark, 4), computed([]), path, version="1")) == content(computed([])(plan_of(spark, 4)))
    assert not os.path.exists(f"{tmp_path}/t/runs/abandoned")
    with pytest.raises(FileNotFoundError):
        publish.read_batches(spark, f"file://{tmp_path}/nothing")


def test_invalid_batches_are_computed_again(spark, tmp_path):
    path, log = f"file://{tmp_path}/t", []
    publish.resume_batches(spark, plan_of(spark, 3), lambda p: computed([])(p).withColumn("v", F.when(F.col("i") == 1, -1).otherwise(F.col("v"))), path, version="1")
    negative = lambda rows: rows.where("v < 0").select("batch_id")
    out = publish.resume_batches(spark, plan_of(spark, 3), computed(log), path, version="1", invalid=negative)
    assert log == [["b1"]] and content(out) == content(computed([])(plan_of(spark, 3)))
    with pytest.raises(ContractError, match="invalid though just computed"):
        publish.resume_batches(spark, plan_of(spark, 5), lambda p: computed([])(p).withColumn("v", F.lit(-5)), path, version="1", invalid=negative)
    assert content(publish.read_batches(spark, path)) == content(computed([])(plan_of(spark, 3)))
