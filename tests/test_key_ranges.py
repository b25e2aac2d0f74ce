"""Expected keys over axes, the coverage report, the frozen holdout, datum shifts."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import contracts
from gridloom.contracts import ContractError
from gridloom.operators import geometry, raster, spatial

AXES = {"batch": (1, 4), "row": (0, 5), "col": (-2, 3)}


def expand(rows):
    """The keys that ranges stand for."""
    out = {"missing": [], "surplus": []}
    for r in rows:
        names = list(AXES)
        k = names.index(r["axis"])
        free = [range(AXES[n][0], AXES[n][1] + 1) for n in names[k + 1 :]] if r["kind"] == "missing" else []
        steps = [r["first"]] if r["first"] is None else range(r["first"], r["last"] + 1)
        found = [(*[r[n] for n in names[:k]], v, *rest) for v in steps for rest in itertools.product(*free)]
        assert len(found) == r["keys"]
        out[r["kind"]] += found
    return out


@pytest.mark.parametrize("seed", range(4))
def test_ranges_are_the_difference(spark, seed):
    rng = random.Random(seed)
    every = list(itertools.product(*[range(a, b + 1) for a, b in AXES.values()]))
    keys = [k for k in every if rng.random() < (0.9, 0.3, 1.0, 0.02)[seed]] if seed != 2 else every
    keys = [k for k in keys if k[0] != 3 or seed == 2] + [(9, 0, 0), (9, 0, 1), (9, 0, 5), (1, 0, 99), (1, None, 0)] * (seed != 2)
    df = spark.createDataFrame(keys + keys[:3] * (seed != 2), "batch long, row long, col long")
    got = expand(contracts.key_ranges(df, AXES).collect())
    assert sorted(got["missing"]) == sorted(set(every) - set(keys))
    assert sorted(got["surplus"], key=str) == sorted(set(keys) - set(every), key=str)
    if seed == 2:
        contracts.check_key_ranges(df, AXES)
    else:
        with pytest.raises(ContractError):
            contracts.check_key_ranges(df.distinct().where("row IS NOT NULL"), AXES)


def test_whole_subtrees_are_one_range(spark):
    df = spark.createDataFrame([(1, r, c) for r in range(6) for c in range(-2, 4)], "batch int, row int, col int")
    assert [tuple(r) for r in contracts.key_ranges(df, AXES).collect()] == [("missing", "batch", None, None, None, 2, 4, 3 * 36)]
    assert [(r["axis"], r["first"], r["last"], r["keys"]) for r in contracts.key_ranges(df.limit(0), AXES).collect()] == [("batch", 1, 4, 144)]
    with pytest.raises(ContractError):
        contracts.key_ranges(df, {"batch": (3, 1)})


def test_coverage_report_is_numpys(spark):
    rng = random.Random(3)
    rows = [(f"c{z}", rng.choice([1, 2, 2, 3, -9999]) if z % 9 else -9999) for z in range(60) for _ in range(rng.randrange(4, 9))]
    table = raster.plurality(spark.createDataFrame(rows, "cell string, v int"), ["cell"], "v", nodata=-9999)
    table = table.unionByName(table.limit(1))
    t = table.toPandas()
    got = {(r["metric"], r["item"]): r["value"] for r in raster.coverage_report(table, key="cell", most_frequent=2).collect()}
    valid, share = t["valid_sample_count"], t["dominant_fraction"].astype(float)
    want = {
        "zones": 61, "full_coverage": (valid == t["total_positions"]).sum(), "partial_coverage": ((valid > 0) & (valid < t["total_positions"])).sum(), "zero_valid": (valid == 0).sum(), "nodata_positions": t["nodata_sample_count"].sum(),
        "unique_winner": ((valid > 0) & ~t["plurality_tie"]).sum(), "exact_tie": t["plurality_tie"].sum(), "exact_tie_percent": t["plurality_tie"].mean() * 100, "valid_samples_min": valid.min(), "valid_samples_median": valid.median(),
        "valid_samples_max": valid.max(), "share_min": share.min(), "share_25": share.quantile(0.25), "share_50": share.median(), "share_75": share.quantile(0.75), "share_mean": share.mean(), "share_max": share.max(),
        "invalid_shares": share.isna().sum(), "missing_cell": 0, "missing_dominant_class": t["dominant_class"].isna().sum(), "missing_dominant_fraction": share.isna().sum(), "dominant_classes": t["dominant_class"].nunique(),
        "unique_keys": 60, "duplicate_keys": 1,
    }
    for k, v in want.items():
        assert math.isclose(got.pop((k, None)), v, rel_tol=1e-12), k
    top = t["dominant_class"].value_counts().sort_index().sort_values(ascending=False, kind="stable").head(2)
    assert got == {("class_count", str(int(k))): v for k, v in top.items()}


def test_frozen_holdout_is_the_approved_one(spark):
    cells = spark.range(60).select((F.col("id") % 10).alias("block_col"), F.floor(F.col("id") / 20).alias("block_row"), (F.col("id") % 7 == 0).cast("int").alias("target"))
    cells = spatial.freeze_holdout(cells.withColumn("spatial_block_id", F.concat_ws("_", "block_row", "block_col")), F.col("block_col") >= 8)
    approved = {"anchor": (0.0, 0.0), "approved": (0.0, 0.0), "rows": 12, "positives": cells.where("block_col >= 8 AND target = 1").count(), "blocks": 6, "all_blocks": 30, "extent": (8, 9, 0, 2)}
    spatial.check_frozen_holdout(cells, **approved)
    for change in ({"anchor": (1.0, 0.0)}, {"rows": 11}, {"positives": 0}, {"blocks": 5}, {"all_blocks": 29}, {"extent": (7, 9, 0, 2)}):
        with pytest.raises(ContractError):
            spatial.check_frozen_holdout(cells, **(approved | change))
    apart = spatial.freeze_holdout(cells.drop("split"), F.col("block_col").isin(7, 9))
    with pytest.raises(ContractError, match="groups"):
        spatial.check_frozen_holdout(apart, **(approved | {"extent": (7, 9, 0, 2), "positives": apart.where("split = 'final_test' AND target = 1").count()}))


WGS84, WGS72 = (6378137.0, 1 / 298.257223563), (6378135.0, 1 / 298.26)


def test_published_geocentric_points(spark):
    p = spark.createDataFrame([(2 + 7 / 60 + 46.38 / 3600, 53 + 48 / 60 + 33.82 / 3600, 73.0)], "lon double, lat double, h double")
    got = p.select(*[c.alias(n) for n, c in zip("xyz", geometry.geocentric(F.col("lon"), F.col("lat"), F.col("h"), a=WGS84[0], f=WGS84[1]), strict=True)]).first()
    assert np.allclose(list(got), [3771793.968, 140253.342, 5124304.349], atol=1e-3, rtol=0)
    # the standard's example: WGS 72 to WGS 84
    q = spark.createDataFrame([(3657660.66, 255768.55, 5201382.11)], "x double, y double, z double")
    moved = geometry.seven_parameters(F.col("x"), F.col("y"), F.col("z"), {"tz": 4.5, "rz": 0.554, "ds": 0.219})
    assert np.allclose(list(q.select(*[c.alias(n) for n, c in zip("xyz", moved, strict=True)]).first()), [3657660.78, 255778.43, 5201387.75], atol=1e-2, rtol=0)


def test_datum_shift_there_and_back(spark):
    rng = random.Random(5)
    rows = [(rng.uniform(-180, 180), rng.uniform(-89.9, 89.9), rng.uniform(-400, 9000)) for _ in range(200)] + [(0.0, 0.0, 0.0), (-106.0, 90.0, 10.0), (180.0, -90.0, 0.0), (45.0, 60.0, 0.0)]
    df = spark.createDataFrame([(i, *r, *r) for i, r in enumerate(rows)], "i int, lon double, lat double, h double, lon0 double, lat0 double, h0 double")
    options = {"source": WGS72, "target": WGS84, "parameters": {"tx": 8.0, "ty": -120.0, "tz": 4.5, "rx": 0.3, "ry": -0.2, "rz": 0.554, "ds": 0.219}, "height": "h"}
    there = geometry.shift_datum(df, **options)
    assert there.where("abs(lat - lat0) > 1e-5 OR abs(h - h0) > 0.5").count() > 190
    back = geometry.shift_datum(there, **options, back=True).collect()
    for r in back:
        assert abs(r["lat"] - r["lat0"]) < 1e-9 and abs(r["h"] - r["h0"]) < 1e-5
        assert abs(r["lat0"]) > 89.99 or min(abs(r["lon"] - r["lon0"]), 360 - abs(r["lon"] - r["lon0"])) < 1e-9
    same = geometry.shift_datum(df, source=WGS84, target=WGS84, parameters={}, height="h").where("abs(lat - lat0) > 1e-11 OR abs(h - h0) > 1e-6").count()
    assert same == 0
    odd = spark.createDataFrame([(None, 1.0), (math.nan, 1.0)], "lon double, lat double")
    assert all(r["lon"] is None or math.isnan(r["lon"]) for r in geometry.shift_datum(odd, source=WGS72, target=WGS84, parameters={"tx": 1.0}).collect())


def test_places_and_the_first_few(spark):
    from gridloom.operators import stats

    rng = random.Random(8)
    rows = [(i, rng.randrange(20), None if i % 9 == 0 else rng.choice("abc")) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, v int, s string").repartition(7)
    placed = stats.with_places(df, [F.desc("v"), F.asc_nulls_last("s"), F.col("i")])
    want = sorted(rows, key=lambda r: (-r[1], r[2] is None, r[2] or "", r[0]))
    assert [r["i"] for r in placed.orderBy("place").collect()] == [r[0] for r in want] and placed.agg(F.max("place")).first()[0] == 500
    assert stats.with_places(df.limit(0), [F.col("i")]).count() == 0
    counts = spark.createDataFrame([("a", 5), ("b", 9), (None, 9), ("c", 1), ("d", 2)], "s string, n int")
    order = [F.desc("n"), F.asc_nulls_first("s")]
    assert sorted(map(tuple, stats.top_with_other(counts, "s", k=2, order=order, sums=["n"]).collect()), key=str) == sorted([(None, 1, 9), ("b", 2, 9), ("Other", 3, 8)], key=str)
    assert stats.top_with_other(counts, "s", k=9, order=order, sums=["n"]).count() == 5 and stats.top_with_other(counts.limit(0), "s", k=2, order=order, sums=["n"]).count() == 0


def test_fits_tell_what_went_wrong(spark):
    from pyspark.ml import Pipeline

    from gridloom.operators import modeling

    rng = random.Random(2)
    rows = spark.createDataFrame([(f"c{i}", rng.random(), i % 3 == 0, i % 2) for i in range(120)], "cell_id string, x double, t boolean, fold int").withColumn("target", F.col("t").cast("int"))

    def build(n):
        stages = modeling.logistic_pipeline(n, continuous=["x"]).getStages()
        return Pipeline(stages=[*stages[:-1], stages[-1].setMaxIter(1)])

    _, m = modeling.run_saved_cv(rows, build, fold="fold", n_folds=2)
    got = m.collect()
    assert all(r["train_rows"] == 60 and r["fit_seconds"] > 0 and any("no convergence" in w for w in r["warnings"]) for r in got)
    fine = modeling.run_saved_cv(rows, lambda n: modeling.logistic_pipeline(n, continuous=["x"]), fold="fold", n_folds=2)[1].collect()
    assert all(r["warnings"] == [] for r in fine)


def test_geoparquet_comes_back_as_rings(spark, tmp_path):
    import os

    from gridloom.sources import geo

    ring = lambda x, s: [(x, 0.0), (x + s, 0.0), (x + s, s), (x, 0.0)]
    df = spark.createDataFrame([(1, [ring(0.0, 4.0), ring(1.0, 1.0)]), (2, None), (3, [ring(9.0, 1.0)])], "id int, rings array<array<struct<x:double,y:double>>>").repartition(2)
    path = f"file://{tmp_path}/g"
    geo.write_geoparquet(geo.with_wkb(df), path)
    back = geo.read_geoparquet(spark, path, srid=5070)
    assert sorted((r["id"], r["rings"]) for r in back.collect()) == sorted((r["id"], r["rings"]) for r in df.collect())
    report = geo.geoparquet_report(spark, path).collect()
    assert len(report) == 2 and all((r["geometry"], r["srid"], r["encoding"], r["problem"]) == ("geometry", 5070, "WKB", None) for r in report)
    with pytest.raises(ContractError):
        geo.read_geoparquet(spark, path, srid=4326)
    df.select("id").write.mode("append").parquet(path)
    with pytest.raises(ContractError, match="differ"):
        geo.read_geoparquet(spark, path)
    broken = geo.with_wkb(df).withColumn("id", F.when(F.col("id") == 3, F.raise_error(F.lit("no"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="no"):
        geo.write_geoparquet(broken, f"file://{tmp_path}/h")
    assert not [n for n in os.listdir(tmp_path) if n.startswith("h")]
