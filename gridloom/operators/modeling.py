"""Models on saved folds: MLlib's regression, and forests of deep trees."""

from __future__ import annotations

import math
import time
import warnings
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import ElementwiseProduct, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.contracts import check_comparable, check_fold_numbers, check_folds, check_key, check_predictions, check_record, require
from gridloom.operators.forest import Forest
from gridloom.operators.stats import comparison, ranking_metrics, select_candidate

#: MLlib's deepest tree; an unlimited depth is run at it and labelled as capped.
DEEPEST = 30
#: The predictors by role, and the tuning grid as name, depth (None: unlimited) and least rows of a leaf. With depth capped at 30, B and D are one model.
CONTINUOUS = ("elevation_mean", "elevation_std", "slope_mean", "slope_std", "annual_precip_mean", "evt_dominant_fraction")
ASPECT = ("aspect_sin_mean", "aspect_cos_mean", "aspect_strength")
NOMINAL = ("evt_dominant_class",)
CANDIDATES: tuple[tuple[str, int | None, int], ...] = (("A", None, 1), ("B", None, 5), ("C", None, 10), ("D", 30, 5), ("E", 15, 5))


def _prepare(continuous: Sequence[str], imputed: Sequence[str], nominal: Sequence[str]) -> list:
    """Constant 0 for missing values of ``imputed``, and one indicator a known class; a class unseen in training has none."""
    zero = ", ".join(f"coalesce(nanvl(cast(`{c}` as double), 0), 0) AS `_{c}`" for c in imputed)
    keep = ", ".join(f"cast(`{c}` as double) AS `_{c}`" for c in continuous)
    text = ", ".join(f"cast(`{c}` as string) AS `_{c}`" for c in nominal)
    stages: list = [SQLTransformer(statement=f"SELECT *, {', '.join(x for x in (zero, keep, text) if x)} FROM __THIS__")]
    for c in nominal:
        stages += [StringIndexer(inputCol=f"_{c}", outputCol=f"_{c}_i", handleInvalid="keep"), OneHotEncoder(inputCol=f"_{c}_i", outputCol=f"_{c}_v", dropLast=True)]
    return stages


def logistic_pipeline(rows: int, *, continuous: Sequence[str], imputed: Sequence[str] = (), nominal: Sequence[str] = (), c: float = 1.0, target: str = "target") -> Pipeline:
    """Scaling of numbers by mean and population deviation, indicators of classes, and L2 logistic regression whose penalty is 1 / (C rows).

    The scaler divides by the sample deviation; a constant factor sqrt(rows / (rows - 1)) after it makes that the population's.
    """
    numbers = [f"_{x}" for x in (*continuous, *imputed)]
    stages = _prepare(continuous, imputed, nominal)
    stages += [VectorAssembler(inputCols=numbers, outputCol="_n"), StandardScaler(inputCol="_n", outputCol="_d", withMean=True)]
    stages += [ElementwiseProduct(scalingVec=[math.sqrt(rows / max(1, rows - 1))] * len(numbers), inputCol="_d", outputCol="_s"), VectorAssembler(inputCols=["_s", *[f"_{x}_v" for x in nominal]], outputCol="_features")]
    return Pipeline(stages=[*stages, LogisticRegression(featuresCol="_features", labelCol=target, regParam=1 / (c * rows), elasticNetParam=0.0, standardization=False, maxIter=2000, tol=1e-12)])


def forest_pipeline(*, continuous: Sequence[str], imputed: Sequence[str] = (), nominal: Sequence[str] = (), trees: int = 300, max_depth: int | None = None, min_leaf: int = 1, seed: int = 42, target: str = "target", bins: int = 256) -> Pipeline:
    """Random forest on raw numbers and class indicators; ``max_depth=None`` is capped at MLlib's 30."""
    stages = _prepare(continuous, imputed, nominal)
    stages.append(VectorAssembler(inputCols=[*[f"_{x}" for x in (*continuous, *imputed)], *[f"_{x}_v" for x in nominal]], outputCol="_features"))
    forest = Forest(features="_features", label=target, trees=trees, min_leaf=min_leaf, max_depth=min(max_depth or DEEPEST, DEEPEST), bins=bins, seed=seed)
    return Pipeline(stages=[*stages, forest])


def predict(model: PipelineModel, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    return model.transform(rows).select(*keep, vector_to_array("probability")[1].alias("predicted_probability"))


Factory = Callable[[int], Pipeline]


def fit(pipeline: Pipeline, train: DataFrame) -> tuple[PipelineModel, float, list[str]]:
    """A fitted pipeline, the seconds it took, and what was warned of: Python's warnings, and a regression that used up its iterations."""
    began = time.time()
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        model = pipeline.fit(train)
    said = [f"{w.category.__name__}: {w.message}" for w in caught if not issubclass(w.category, DeprecationWarning | ResourceWarning)]
    last = model.stages[-1]
    if isinstance(last, LogisticRegressionModel) and last.hasSummary and last.summary.totalIterations >= last.getMaxIter():
        said.append(f"no convergence after {last.summary.totalIterations} iterations")
    return model, time.time() - began, said


def run_saved_cv(rows: DataFrame, factory: Factory, *, fold: str, n_folds: int = 5, key: str = "cell_id", target: str = "target", extra: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(out-of-fold predictions, fold metrics): each fold is predicted by a model of the others, each row once. Metrics come with train_rows, fit_seconds and warnings of the fold's fit.

    ``factory`` gets the training rows' count and returns a pipeline. ``rows`` should be cached by the caller: it is read twice a fold. Keys, fold numbers and
    classes are checked before the first fit, so every row has a fold and comes out once.
    """
    check_key(rows, key)
    check_fold_numbers(rows, fold, n_folds, target=target)
    out, fits = [], []
    for f in range(n_folds):
        train = rows.where(F.col(fold) != f)
        n = train.count()
        require(n > 0, f"fold {f} leaves nothing to train on")
        model, seconds, said = fit(factory(n), train)
        fits.append((f, n, seconds, said))
        out.append(predict(model, rows.where(F.col(fold) == f), [key, target, *extra, F.col(fold).alias("fold")]))
    oof = reduce(DataFrame.unionByName, out)
    metrics = ranking_metrics(oof, target=target, by=["fold"]).withColumnRenamed("average_precision", "pr_auc")
    about = rows.sparkSession.createDataFrame(fits, "_fold long, train_rows long, fit_seconds double, warnings array<string>")
    return oof, metrics.join(F.broadcast(about), F.col("fold") == F.col("_fold")).drop("_fold")


def experiment_summary(oof: DataFrame, folds: DataFrame, *, target: str = "target") -> DataFrame:
    """Metrics over all out-of-fold rows, beside mean and sample deviation over the folds."""
    combined = ranking_metrics(oof, target=target).select("rows", "positives", "positive_prevalence", F.col("roc_auc").alias("roc_auc_oof"), F.col("average_precision").alias("pr_auc_oof"))
    spread = folds.agg(F.count("*").alias("fold_count"), *[e for m in ("roc_auc", "pr_auc") for e in (F.avg(m).alias(f"{m}_fold_mean"), F.stddev_samp(m).alias(f"{m}_fold_std"))])
    return combined.join(F.broadcast(spread))


def evaluate_holdout(train: DataFrame, test: DataFrame, factory: Factory, *, key: str = "cell_id", target: str = "target", extra: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(predictions, metrics) of a model fitted once on ``train``."""
    p = predict(factory(train.count()).fit(train), test, [key, target, *extra])
    return p, ranking_metrics(p, target=target)


def tune_forest(rows: DataFrame, *, fold: str, n_folds: int = 5, candidates: Sequence[tuple[str, int | None, int]] = CANDIDATES, target: str = "target", key: str = "cell_id", **options) -> tuple[DataFrame, DataFrame]:
    """(one row a candidate and fold, summary with the selected candidate).

    The summary has runtime_seconds (of the candidate's fits), warning_count, and same_as: the first candidate that is the same model here, as depths over ``DEEPEST`` are
    capped at it; null if there is none.
    """
    parts = []
    for name, depth, leaf in candidates:
        _, m = run_saved_cv(rows, lambda _, d=depth, m=leaf: forest_pipeline(max_depth=d, min_leaf=m, target=target, **options), fold=fold, n_folds=n_folds, key=key, target=target)
        parts.append(m.select(F.lit(name).alias("candidate"), F.lit(depth).cast("int").alias("max_depth"), F.lit(leaf).alias("min_samples_leaf"), "fold", "rows", "positives", "positive_prevalence", "roc_auc", F.col("pr_auc").alias("average_precision"), "fit_seconds", "warnings"))
    folds = reduce(DataFrame.unionByName, parts)
    summary = folds.groupBy("candidate", "max_depth", "min_samples_leaf").agg(F.sum("fit_seconds").alias("runtime_seconds"), F.sum(F.size("warnings")).alias("warning_count"), *[e for m in ("roc_auc", "average_precision") for e in (F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"))])
    first: dict[tuple[int, int], str] = {}
    twins = {name: first.setdefault((min(depth or DEEPEST, DEEPEST), leaf), name) for name, depth, leaf in candidates}
    same = reduce(lambda c, n: c.when(F.col("candidate") == n, twins[n]), [n for n in twins if twins[n] != n], F.when(F.lit(False), F.lit(None).cast("string")))
    return folds, select_candidate(summary.withColumn("same_as", same))


def score_everything(labelled: DataFrame, every_cell: DataFrame, factory: Factory, *, key: str = "cell_id", keep: Sequence[str] = ()) -> DataFrame:
    """Final refit on all labelled rows, then a probability for every cell, excluded ones too."""
    out = predict(factory(labelled.count()).fit(labelled), every_cell, [key, *keep]).withColumnRenamed("predicted_probability", "susceptibility_probability")
    check_predictions(out, every_cell, key, "susceptibility_probability")
    return out


#: Fields that two experiments must share to be compared, and the metrics that are.
SHARED_FIELDS = ("model", "rows", "positives", "negatives", "fold_count", "predictors")
COMPARED = {"roc_auc": "roc_auc_oof", "average_precision": "pr_auc_oof"}


def experiment_record(oof: DataFrame, folds: DataFrame, *, model: str, predictors: Sequence[str], target: str = "target", input_sha256: str | None = None) -> dict:
    """An experiment's summary as a record: population, metrics over all out-of-fold rows, mean and deviation over the folds, provenance."""
    r = experiment_summary(oof, folds, target=target).first().asDict()
    return r | {"negatives": r["rows"] - r["positives"], "model": model, "predictors": list(predictors), "input_sha256": input_sha256, "final_test_accessed": False}


def compare_validation(
    random: Mapping, spatial: Mapping, random_folds: DataFrame, spatial_folds: DataFrame, *, population: Mapping | None = None, need_hash: bool = False, metrics: Mapping[str, str] = COMPARED
) -> DataFrame:
    """validation_strategy and metrics of two experiments, with the signed difference, once both are proven to be comparable.

    Nothing is fitted and no rows but those of the folds are read. ``population`` holds fields that both records must have; ``metrics``
    maps names of the result to fields of the records.
    """
    contract = check_comparable(random, spatial, SHARED_FIELDS, list(COMPARED.values()))
    require(not need_hash or contract["same_input_hash"] is True, "the comparison needs the fingerprints of both inputs")
    for record, folds in ((random, random_folds), (spatial, spatial_folds)):
        check_record(record, population or {})
        check_folds(folds, record)
    return comparison(dict(random), dict(spatial), dict(metrics), random_folds.sparkSession)
