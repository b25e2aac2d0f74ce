"""Contracts on tables: each check is one aggregation, and a violation raises with its counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.missing import close, is_infinite, is_missing, same

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FAMILIES: dict[str, tuple[type, ...]] = {
    "string": (T.StringType,), "integer": INTEGERS, "numeric": (*INTEGERS, T.FloatType, T.DoubleType), "boolean": (T.BooleanType,), "timestamp": (T.TimestampType, T.TimestampNTZType, T.DateType),
}


class ContractError(ValueError):
    """A table does not keep its contract; the message names the counts."""


def require(ok: bool, message: str) -> None:
    if not ok:
        raise ContractError(message)


def check_schema(df: DataFrame, families: Mapping[str, str], *, exact_order: bool = True) -> None:
    """Columns, their order and type families; decimals are no numbers here."""
    require(not exact_order or df.columns == list(families), f"columns are {df.columns}, expected {list(families)}")
    for name, family in families.items():
        require(name in df.columns, f"column {name} is absent")
        require(isinstance(df.schema[name].dataType, FAMILIES[family]), f"column {name} is {df.schema[name].dataType.simpleString()}, expected {family}")


def key_report(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """One row: n_rows, n_keys, null_keys, duplicate_keys (rows beyond the first of each key).

    Counts by key first, so the distinct count is a partial aggregation and a hot key is one row early.
    """
    keys = [key] if isinstance(key, str) else list(key)
    null = F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))
    per = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count_if(~null).alias("n_keys"), F.coalesce(F.sum(F.when(null, F.col("n"))), F.lit(0)).alias("null_keys"),
        F.coalesce(F.sum(F.when(~null, F.col("n") - 1)), F.lit(0)).alias("duplicate_keys"),
    )


def check_key(df: DataFrame, key: str | Sequence[str], *, rows: int | None = None) -> None:
    r = key_report(df, key).first()
    require(not r["null_keys"] and not r["duplicate_keys"], f"key {key}: {r['null_keys']} null and {r['duplicate_keys']} duplicate rows")
    require(rows is None or r["n_rows"] == rows, f"{r['n_rows']} rows, expected {rows}")


def domain_report(df: DataFrame, rules: Mapping[str, Column], columns: Sequence[str] = ()) -> DataFrame:
    """One row: broken_<rule> for each rule (missing values don't break rules), missing_<c> and infinite_<c> for each column."""
    parts = [F.count_if(F.coalesce(~rule, F.lit(False))).alias(f"broken_{name}") for name, rule in rules.items()]
    parts += [F.count_if(is_missing(c)).alias(f"missing_{c}") for c in columns] + [F.count_if(is_infinite(c)).alias(f"infinite_{c}") for c in columns]
    return df.agg(F.count("*").alias("n_rows"), *parts)


def check_domain(df: DataFrame, rules: Mapping[str, Column], columns: Sequence[str] = (), *, allowed_missing: Mapping[str, int] | None = None) -> None:
    """No rule broken, nothing infinite, and exactly the allowed number of missing values in each column."""
    r = domain_report(df, rules, columns).first().asDict()
    bad = {k: v for k, v in r.items() if v and k.startswith(("broken_", "infinite_"))}
    bad |= {f"missing_{c}": r[f"missing_{c}"] for c in columns if r[f"missing_{c}"] != (allowed_missing or {}).get(c, 0)}
    require(not bad, f"domain: {bad}")


def key_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has, with the side: both EXCEPTs in one aggregation over the union."""
    sides = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    per = sides.groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return per.where("l <> r").select(key, F.when(F.col("l") == 1, "left_only").otherwise("right_only").alias("side"))


def check_same_keys(left: DataFrame, right: DataFrame, key: str) -> None:
    n = key_difference(left, right, key).groupBy("side").count().collect()
    require(not n, f"key sets differ: { {r['side']: r['count'] for r in n} }")


def check_disjoint(left: DataFrame, right: DataFrame, key: str) -> None:
    n = left.select(key).join(right.select(key).distinct(), key, "left_semi").distinct().count()
    require(n == 0, f"{n} keys of {key} are on both sides")


def key_ranges(df: DataFrame, axes: Mapping[str, tuple[int, int]]) -> DataFrame:
    """Which keys over several integer axes are missing or surplus, as ranges: kind, axis, the axes' columns, first, last and keys.

    ``axes`` maps each column to its least and greatest expected value; expected is every combination, a list that is never made. Where a whole subtree is missing it is one
    range on its own axis, with the columns before it given and those after it null, and ``keys`` counts the combinations it stands for. Surplus keys (outside an axis, or null
    in one) are ranges on the last axis with keys of its own; repeated keys count once. The first axis is put in order in one task, so it should be the shortest.
    """
    names = list(axes)
    sizes = {n: high - low + 1 for n, (low, high) in axes.items()}
    require(bool(names) and all(x > 0 for x in sizes.values()), f"axes {dict(axes)} are empty")
    keys = df.select(*[F.col(n).cast("long").alias(n) for n in names]).distinct()
    expected = reduce(lambda a, b: a & b, [F.coalesce(F.col(n).between(*axes[n]), F.lit(False)) for n in names])
    out = []
    for k, name in enumerate(names):
        above, (low, high) = names[:k], axes[name]
        each = reduce(lambda a, b: a * b, [sizes[n] for n in names[k + 1 :]], 1)
        there = keys.where(expected).select(*names[: k + 1]).distinct()
        # a place before the axis for each subtree that is there, so that gaps at its beginning show
        starts = (there.select(*above).distinct() if above else df.sparkSession.range(1).select()).withColumn(name, F.lit(low - 1).cast("long"))
        order = Window.partitionBy(*above).orderBy(name)
        gaps = there.unionByName(starts).withColumn("_next", F.lead(name, 1, high + 1).over(order)).where(F.col("_next") > F.col(name) + 1)
        rows = gaps.select(*above, (F.col(name) + 1).alias("first"), (F.col("_next") - 1).alias("last"))
        null = [F.lit(None).cast("long").alias(n) for n in names[k:]]
        out.append(rows.select(F.lit("missing").alias("kind"), F.lit(name).alias("axis"), *above, *null, "first", "last", ((F.col("last") - F.col("first") + 1) * each).alias("keys")))
    *above, name = names
    island = F.col(name) - F.row_number().over(Window.partitionBy(*above).orderBy(name))
    surplus = keys.where(~expected).withColumn("_island", island).groupBy(*above, "_island").agg(F.min(name).alias("first"), F.max(name).alias("last"), F.count("*").alias("keys"))
    out.append(surplus.select(F.lit("surplus").alias("kind"), F.lit(name).alias("axis"), *above, F.lit(None).cast("long").alias(name), "first", "last", "keys"))
    return reduce(DataFrame.unionByName, out)


def check_key_ranges(df: DataFrame, axes: Mapping[str, tuple[int, int]]) -> None:
    """Raises unless the keys are every combination of the axes, each once."""
    check_key(df, list(axes))
    n = {r["kind"]: (r["ranges"], r["keys"]) for r in key_ranges(df, axes).groupBy("kind").agg(F.count("*").alias("ranges"), F.sum("keys").alias("keys")).collect()}
    require(not n, f"keys over {list(axes)}: " + ", ".join(f"{keys} {kind} in {ranges} ranges" for kind, (ranges, keys) in sorted(n.items())))


def bag_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that the two bags don't have equally often, with the surplus on the left (negative: on the right). NaN equals NaN."""
    right = right.select(left.columns)
    both = left.withColumn("_n", F.lit(1)).unionByName(right.withColumn("_n", F.lit(-1)))
    return both.groupBy(*left.columns).agg(F.sum("_n").alias("surplus")).where("surplus <> 0")


def check_preserved(source: DataFrame, result: DataFrame, columns: Sequence[str]) -> None:
    n = bag_difference(source.select(*columns), result.select(*columns)).count()
    require(n == 0, f"{n} rows differ from their source")


def check_counts(df: DataFrame, expected: Mapping[str, tuple[Column, int]]) -> None:
    """Frozen population counts: a condition and how many rows meet it."""
    r = df.agg(*[F.count_if(c).alias(k) for k, (c, _) in expected.items()]).first()
    bad = {k: (r[k], n) for k, (_, n) in expected.items() if r[k] != n}
    require(not bad, f"population (found, expected): {bad}")


def label_violations(df: DataFrame, fraction: str, target: str, positive_from: float = 0.25) -> Column:
    """Rows whose label does not follow from the fraction: 0 needs none, 1 needs at least ``positive_from``."""
    return F.count_if(~F.coalesce(((F.col(target) == 0) & (F.col(fraction) == 0)) | ((F.col(target) == 1) & (F.col(fraction) >= positive_from)), F.lit(False)))


def constant_report(df: DataFrame, group: str, value: str) -> DataFrame:
    """Groups that hold more than one value."""
    lo, hi = F.min(value), F.max(value)
    return df.groupBy(group).agg(lo.alias("low"), hi.alias("high"), F.count_if(F.col(value).isNull()).alias("nulls"), F.count("*").alias("n")).where("low <> high OR (nulls > 0 AND nulls < n)")


def check_split(df: DataFrame, *, split: str = "split", block: str = "spatial_block_id", folds: Sequence[str] = ("random_cv_fold", "spatial_cv_fold"), target: str = "target", n_folds: int = 5) -> None:
    """Known labels, blocks on one side of the split and in one spatial fold, null folds on the test side alone, both classes in every fold."""
    train, test = F.col(split) == "train", F.col(split) == "final_test"
    r = df.agg(F.count_if(~F.coalesce(train | test, F.lit(False))).alias("odd"), *[F.count_if(test & F.col(f).isNotNull() | train & F.col(f).isNull()).alias(f) for f in folds]).first()
    require(not any(r), f"split labels or null folds: {r.asDict()}")
    require(constant_report(df, block, split).isEmpty(), "a block is on both sides of the split")
    require(constant_report(df.where(train), block, folds[-1]).isEmpty(), "a block is in several spatial folds")
    for f in folds:
        per = df.where(train).groupBy(f).agg(F.sum(target).alias("p"), F.count("*").alias("n")).collect()
        require(sorted(x[f] for x in per) == list(range(n_folds)) and all(0 < x["p"] < x["n"] for x in per), f"{f} lacks folds or classes")


def check_fold_numbers(df: DataFrame, fold: str, n_folds: int, *, target: str = "target", expected: Sequence[tuple[int, int]] | None = None) -> None:
    """Whole fold numbers from 0 to n_folds - 1 on every row, both classes in each fold, and (rows, positives) of each as frozen, if given."""
    require(isinstance(df.schema[fold].dataType, INTEGERS), f"{fold} is no whole number")
    per = sorted(df.groupBy(fold).agg(F.count("*").alias("n"), F.sum(target).cast("long").alias("p")).collect(), key=lambda r: (r[fold] is not None, r[fold]))
    require([r[fold] for r in per] == list(range(n_folds)), f"{fold} has the values {[r[fold] for r in per]}")
    require(all(0 < (r["p"] or 0) < r["n"] for r in per), f"a fold of {fold} lacks a class")
    found = [(r["n"], r["p"]) for r in per]
    require(expected is None or found == [tuple(e) for e in expected], f"{fold} has the populations {found}, expected {expected}")


def check_whole_blocks(df: DataFrame, fold: str, *, block: str = "spatial_block_id", expected: Sequence[int] | None = None) -> None:
    """No null block or fold, each block in one fold, and as many blocks in each fold as frozen, if given."""
    require(df.where(F.col(block).isNull() | F.col(fold).isNull()).isEmpty(), "a block or fold is null")
    require(constant_report(df, block, fold).isEmpty(), "a block is in several folds")
    found = [r["n"] for r in df.select(fold, block).distinct().groupBy(fold).agg(F.count("*").alias("n")).orderBy(fold).collect()]
    require(expected is None or found == list(expected), f"blocks of the folds are {found}, expected {expected}")


def check_training(
    df: DataFrame, predictors: Sequence[str], *, fold: str, expected_folds: Sequence[tuple[int, int]], metadata: Sequence[str] = ("cell_id", "spatial_block_id", "random_cv_fold", "spatial_cv_fold"),
    target: str = "target", allowed_missing: Mapping[str, int] | None = None, nominal: Sequence[str] = (), expected_blocks: Sequence[int] | None = None,
) -> None:
    """The training table's contract: exactly the approved columns, unique keys, frozen folds, and numeric finite predictors with the approved gaps."""
    wanted = {*predictors, *metadata, target}
    require(set(df.columns) == wanted, f"columns {sorted(set(df.columns) ^ wanted)} are too many or lack")
    check_key(df, metadata[0], rows=sum(n for n, _ in expected_folds))
    require(df.where(~F.coalesce(F.col(target).isin(0, 1), F.lit(False))).isEmpty(), "a target is neither 0 nor 1")
    check_fold_numbers(df, fold, len(expected_folds), target=target, expected=expected_folds)
    if expected_blocks is not None:
        check_whole_blocks(df, fold, expected=expected_blocks)
    check_schema(df, {c: "numeric" for c in predictors} | {c: "integer" for c in nominal}, exact_order=False)
    check_domain(df, {}, list(predictors), allowed_missing=allowed_missing)


def check_record(record: Mapping, expected: Mapping, *, close_to: Mapping[str, tuple[float, float]] | None = None) -> None:
    """Provenance of a saved record: fields exactly as expected, and figures within a tolerance of their published values."""
    for key, value in expected.items():
        require(key in record and record[key] == value, f"{key} is {record.get(key)!r}, expected {value!r}")
    for key, (value, within) in (close_to or {}).items():
        x = record.get(key)
        require(isinstance(x, int | float) and abs(x - value) <= within, f"{key} is {x!r}, expected {value} within {within}")


def plurality_violations(qa: DataFrame, *, positions: int | None = None, codes: Sequence[int] | None = None) -> DataFrame:
    """One row of counts of zones whose counts, shares and ties contradict each other; every count of a sound table is 0.

    ``qa`` has the columns that a plurality gives. ``positions`` is the frozen number of samples of a zone, ``codes`` the documented classes.
    """
    c = F.col
    has = c("valid_sample_count") > 0
    share = c("winning_sample_count").cast("double") / c("valid_sample_count")
    known = F.lit(True) if codes is None else F.forall("tied_classes", lambda k: k.isin(list(codes)))
    tied = c("tied_classes")
    sound = {
        "positions": (c("total_positions") == positions) if positions is not None else c("total_positions") > 0,
        "coverage": (c("valid_sample_count") + c("nodata_sample_count") == c("total_positions")) & c("valid_sample_count").between(0, c("total_positions")) & (c("valid_fraction") == c("valid_sample_count") / c("total_positions")),
        "winner": F.when(has, c("winning_sample_count").between(1, c("valid_sample_count")) & (c("dominant_fraction") == share)).otherwise((c("winning_sample_count") == 0) & c("dominant_fraction").isNull()),
        "class": F.when(has, c("dominant_class") == tied[0]).otherwise(c("dominant_class").isNull() & (F.size(tied) == 0)) & known,
        "ties": (c("plurality_tie") == (F.size(tied) > 1)) & (tied == F.array_sort(F.array_distinct(tied))),
    }
    return qa.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in sound.items()])


def check_plurality(qa: DataFrame, keys: DataFrame, key: str, **options) -> None:
    """A batch's or the whole table's contract: exactly the authoritative keys, once each, and sound arithmetic."""
    check_key(qa, key)
    check_same_keys(qa, keys, key)
    bad = {k: v for k, v in plurality_violations(qa, **options).first().asDict().items() if v}
    require(not bad, f"plurality: {bad}")


def check_predictions(df: DataFrame, source: DataFrame, key: str = "cell_id", probability: str = "predicted_probability") -> None:
    """Every key of the source predicted once, with a finite probability in [0, 1]."""
    check_key(df, key)
    check_same_keys(df, source, key)
    n = df.where(is_missing(probability) | ~F.col(probability).between(0, 1)).count()
    require(n == 0, f"{n} probabilities are missing or outside [0, 1]")


def check_comparable(a: Mapping, b: Mapping, fields: Sequence[str], metrics: Sequence[str]) -> dict[str, bool | None]:
    """Two experiment records may be compared: equal fields, metrics in [0, 1], consistent counts; hashes count only if both are there."""
    for f in fields:
        require(f in a and f in b and a[f] == b[f], f"experiments differ in {f}")
    for x in (a, b):
        require(x["rows"] == x["positives"] + x["negatives"] and x["fold_count"] >= 2, "inconsistent population or fold count")
        require(all(isinstance(x.get(m), int | float) and 0 <= x[m] <= 1 for m in metrics), "a metric is absent or outside [0, 1]")
        require(x.get("final_test_accessed") is False, "the final test must be untouched")
    hashes = a.get("input_sha256"), b.get("input_sha256")
    require(None in hashes or hashes[0] == hashes[1], "input fingerprints differ")
    return {"same_input_hash": None if None in hashes else True, "same_training_population": True}


def fold_reconciliation(folds: DataFrame, *, metrics: Sequence[str] = ("roc_auc", "pr_auc")) -> DataFrame:
    """One row: totals, and mean and sample deviation of each metric over the folds."""
    parts = [e for m in metrics for e in (F.avg(m).alias(f"{m}_fold_mean"), F.stddev_samp(m).alias(f"{m}_fold_std"))]
    return folds.agg(F.count("*").alias("fold_count"), F.sum("rows").alias("rows"), F.sum("positives").alias("positives"), *parts)


def check_folds(folds: DataFrame, summary: Mapping, *, metrics: Sequence[str] = ("roc_auc", "pr_auc")) -> None:
    r = fold_reconciliation(folds, metrics=metrics).first().asDict()
    for k, v in r.items():
        ok = v == summary[k] if isinstance(v, int) else abs(v - summary[k]) <= 1e-12
        require(ok, f"folds give {k} = {v}, the summary {summary[k]}")


def gate_report(df: DataFrame, gates: Mapping[str, tuple[Column, float]]) -> DataFrame:
    """One row for each review gate: share of rows that meet its condition, limit, passed."""
    rows = df.agg(*[F.avg(c.cast("double")).alias(k) for k, (c, _) in gates.items()])
    pairs = F.array(*[F.struct(F.lit(k).alias("gate"), F.col(k).alias("share"), F.lit(float(m)).alias("most")) for k, (_, m) in gates.items()])
    return rows.select(F.explode(pairs).alias("g")).select("g.*", (F.col("g.share") <= F.col("g.most")).alias("passed"))


__all__ = [n for n in dir() if n.startswith(("check_", "key_", "bag_", "gate_", "domain_", "fold_", "constant_", "label_"))] + ["ContractError", "close", "require", "same"]
