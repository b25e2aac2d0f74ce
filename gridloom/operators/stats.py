"""Exact metrics and diagnostics; every ratio is a double."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.missing import is_missing, nan_to_null
from gridloom.session import cut


#: Groups of which quantiles broadcast what they know (a few hundred numbers each).
MOST_GROUPS = 10_000


def _scores(rows: DataFrame, target: str, probability: str, by: Sequence[str]) -> DataFrame:
    """Positives and rows at each distinct score: all that ranking metrics need, and far fewer rows than predictions."""
    return rows.groupBy(*by, F.col(probability).cast("double").alias("_p")).agg(F.sum(F.col(target).cast("long")).alias("_tp"), F.count("*").alias("_n"))


def ranking_metrics(rows: DataFrame, *, target: str = "target", probability: str = "predicted_probability", by: Sequence[str] = ()) -> DataFrame:
    """rows, positives, positive_prevalence, roc_auc and average_precision, exact with ties, for each group of ``by``.

    ROC-AUC is the share of (positive, negative) pairs in order, ties half; average precision sums precision over steps of recall.
    One class only: both are NULL. Running sums go over distinct scores, first inside ranges of scores and then over the few ranges.
    """
    by = list(by)
    s = _scores(rows, target, probability, by)
    # ranges of about as many distinct scores each keep a window from taking them all into one task; their ends are one row of 255 numbers
    cuts = s.agg(F.percentile_approx("_p", [i / 256 for i in range(1, 256)], 10_000).alias("_cuts"))
    s = s.join(F.broadcast(cuts)).withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col("_p"))).cast("long")).drop("_cuts")
    totals = s.groupBy(*by, "_b").agg(F.sum("_tp").alias("_btp"), F.sum("_n").alias("_bn"))
    wb = Window.partitionBy(*by).orderBy(F.desc("_b"))
    run = lambda c: F.sum(c).over(wb) - F.col(c)
    totals = totals.withColumns({"_tp0": run("_btp"), "_n0": run("_bn"), "_pos": F.sum("_btp").over(Window.partitionBy(*by)), "_all": F.sum("_bn").over(Window.partitionBy(*by))})
    names = {k: f"_{k}_g" for k in by} | {"_b": "_b_g"}
    t = totals.drop("_btp", "_bn").withColumnsRenamed(names)
    on = F.col("_b").eqNullSafe(F.col("_b_g"))
    for k in by:
        on &= F.col(k).eqNullSafe(F.col(f"_{k}_g"))
    w = Window.partitionBy(*by, "_b").orderBy(F.desc("_p"))
    c = s.join(F.broadcast(t) if not by else t, on).withColumn("_ctp", F.sum("_tp").over(w) + F.col("_tp0")).withColumn("_cn", F.sum("_n").over(w) + F.col("_n0"))
    d = lambda x: F.col(x).cast("double")
    neg = F.col("_n") - F.col("_tp")
    # positives above each negative, and half of those beside it
    above = (F.col("_ctp") - F.col("_tp")) + F.col("_tp") / F.lit(2.0)
    out = c.groupBy(*by).agg(
        F.max("_all").alias("rows"), F.max("_pos").alias("positives"),
        F.sum(neg * above).alias("_won"), F.sum(d("_tp") / F.nullif(d("_pos"), F.lit(0.0)) * d("_ctp") / d("_cn")).alias("_ap"),
    )
    pairs = F.col("positives").cast("double") * (F.col("rows") - F.col("positives"))
    both = (F.col("positives") > 0) & (F.col("positives") < F.col("rows"))
    return out.select(
        *by, "rows", "positives", (d("positives") / d("rows")).alias("positive_prevalence"), F.when(both, F.try_divide(F.col("_won"), pairs)).alias("roc_auc"), F.when(both, F.col("_ap")).alias("average_precision"),
    )


def quantiles(rows: DataFrame, by: Sequence[str], value: str, shares: Mapping[str, float], *, ranges: int = 64) -> DataFrame:
    """``by`` and the exact interpolated quantiles of the values that are not null, one column for each name of ``shares``; null without values.

    A sketch of bounded size cuts each group into ranges of about equal counts; counts of the ranges tell in which one a rank lies, and only the values of
    these ranges, counted, are shuffled and put in order. So no task holds a group's values, ties are one row, and ``rows`` are read once, into the shared folder.
    What is known of the groups is broadcast while they are at most ``MOST_GROUPS``.
    """
    by = list(by)
    x = cut(rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_x")))
    cuts = cut(x.groupBy(*by).agg(F.percentile_approx("_x", [i / ranges for i in range(1, ranges)], 10_000).alias("_cuts"), F.count("*").alias("_n")))
    small = F.broadcast if cuts.count() <= MOST_GROUPS else (lambda df: df)
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in by]
    own = lambda a: [F.col(f"{a}.{k}").alias(k) for k in by]
    placed = x.alias("v").join(small(cuts).alias("c"), same("v", "c")).select(*own("v"), "_x", "_n", F.size(F.filter("_cuts", lambda c: c < F.col("_x"))).alias("_range"))
    counts = placed.groupBy(*by, "_range", "_n").agg(F.count("*").alias("_in"))
    counts = counts.withColumn("_before", F.sum("_in").over(Window.partitionBy(*by).orderBy("_range")) - F.col("_in"))
    # 0-based ranks at both sides of each share, and the range each lies in
    spots = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(q)).alias("q"), (F.lit(float(q)) * (F.col("_n") - 1)).alias("h")) for n, q in shares.items()])
    asked = counts.withColumn("_s", F.explode(spots)).withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_s.h"), F.ceil("_s.h")))))
    asked = asked.where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_in")))
    asked = cut(asked.select(*by, "_range", "_before", "_s.name", "_s.h", "_rank"))
    needed = asked.select(*by, "_range", "_before").distinct()
    inside = placed.alias("p").join(small(needed).alias("n"), [*same("p", "n"), F.col("p._range") == F.col("n._range")]).select(*own("p"), F.col("p._range").alias("_range"), "_x", "_before")
    inside = inside.groupBy(*by, "_range", "_before", "_x").agg(F.count("*").alias("_m"))
    order = Window.partitionBy(*by, "_range").orderBy("_x")
    ranked = inside.withColumn("_to", F.sum("_m").over(order) + F.col("_before")).withColumn("_from", F.col("_to") - F.col("_m"))
    hit = ranked.alias("r").join(small(asked).alias("a"), [*same("r", "a"), F.col("r._range") == F.col("a._range"), F.col("a._rank") >= F.col("r._from"), F.col("a._rank") < F.col("r._to")])
    part = F.when(F.floor("h") == F.ceil("h"), F.col("_x")).when(F.col("_rank") == F.floor("h"), F.col("_x") * (1 - (F.col("h") - F.floor("h")))).otherwise(F.col("_x") * (F.col("h") - F.floor("h")))
    found = hit.select(*own("r"), "name", part.alias("_part")).groupBy(*by, "name").agg(F.sum("_part").alias("_q"))
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("name") == n, F.col("_q"))).alias(n) for n in shares])


def describe(rows: DataFrame, columns: Sequence[str], *, by: str, shares: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Long form: predictor, population, rows, counts, mean, sample std and exact interpolated quantiles, without missing values."""
    long = cut(rows.select(F.col(by).alias("population"), *[nan_to_null(c).alias(c) for c in columns]).unpivot(["population"], list(columns), "predictor", "value"))
    moments = long.groupBy("predictor", "population").agg(
        F.count("*").alias("rows"), F.count("value").alias("nonmissing_count"), (F.count("*") - F.count("value")).alias("missing_count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
    )
    q = quantiles(long, ["predictor", "population"], "value", {f"p{round(s * 100):02d}": s for s in shares})
    return moments.join(q, ["predictor", "population"], "left")


def class_changes(composed: DataFrame, value: str, *, names: Sequence[str]) -> DataFrame:
    """Classes with their status: in both populations, unseen (only in the second) or absent (only in the first), the largest shift first by ``place``."""
    a, b = F.col(f"{names[0]}_count"), F.col(f"{names[1]}_count")
    status = F.when((a > 0) & (b > 0), "both").when(b > 0, "unseen").otherwise("absent")
    order = Window.orderBy(F.desc(F.abs("difference_in_proportion")), F.asc_nulls_first(value))
    return composed.withColumn("status", status).withColumn("place", F.row_number().over(order))


def standardised_difference(stats: DataFrame, *, base: str, other: str) -> DataFrame:
    """predictor, pooled_standard_deviation, standardized_mean_difference (other minus base); NULL if the pooled deviation is zero."""
    pick = lambda name, c: F.max(F.when(F.col("population") == name, F.col(c)))
    per = stats.groupBy("predictor").agg(*[pick(p, c).alias(f"{c}_{k}") for k, p in (("a", base), ("b", other)) for c in ("nonmissing_count", "mean", "std")])
    squares = sum(((F.col(f"nonmissing_count_{k}") - 1) * F.col(f"std_{k}") * F.col(f"std_{k}") for k in "ab"), F.lit(0.0))
    pooled = F.sqrt(F.try_divide(squares, (F.col("nonmissing_count_a") + F.col("nonmissing_count_b") - 2).cast("double")))
    smd = F.when(F.col("pooled_standard_deviation") > 0, (F.col("mean_b") - F.col("mean_a")) / F.col("pooled_standard_deviation"))
    return per.withColumn("pooled_standard_deviation", pooled).select("predictor", "pooled_standard_deviation", smd.alias("standardized_mean_difference"))


def composition(rows: DataFrame, *, by: str, names: Sequence[str], value: str) -> DataFrame:
    """Counts and proportions of each class in two populations and their difference; 0 is absence. One aggregation, totals from its windows."""
    counts = rows.groupBy(value).agg(*[F.count_if(F.col(by) == n).alias(f"{n}_count") for n in names])
    total = counts.agg(*[F.sum(f"{n}_count").alias(f"_{n}") for n in names])
    out = counts.join(F.broadcast(total)).withColumns({f"{n}_proportion": F.try_divide(F.col(f"{n}_count").cast("double"), F.col(f"_{n}").cast("double")) for n in names})
    return out.drop(*[f"_{n}" for n in names]).withColumn("difference_in_proportion", F.col(f"{names[1]}_proportion") - F.col(f"{names[0]}_proportion"))


def fixed_histogram(rows: DataFrame, value: str, edges: Sequence[float], *, zero_bin: bool = True) -> DataFrame:
    """bin, low, high, count: bins [low, high), the last closed, and one for exact zeros; empty bins are 0. Values outside raise a count in bin -1."""
    x = nan_to_null(value)
    place = F.lit(-1)
    for i in range(len(edges) - 1):
        inside = (x >= edges[i]) & ((x <= edges[i + 1]) if i == len(edges) - 2 else (x < edges[i + 1]))
        place = F.when(inside, i + 1).otherwise(place)
    if zero_bin:
        place = F.when(x == 0, 0).otherwise(place)
    counts = rows.where(~is_missing(value)).groupBy(place.alias("bin")).agg(F.count("*").alias("count"))
    bins = [F.struct(F.lit(0).alias("bin"), F.lit(0.0).alias("low"), F.lit(0.0).alias("high"))] if zero_bin else []
    bins += [F.struct(F.lit(i + 1).alias("bin"), F.lit(float(edges[i])).alias("low"), F.lit(float(edges[i + 1])).alias("high")) for i in range(len(edges) - 1)]
    bins += [F.struct(F.lit(-1).alias("bin"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))]
    spine = rows.sparkSession.range(1).select(F.explode(F.array(*bins)).alias("s")).select("s.*")
    out = spine.join(counts, "bin", "left").withColumn("count", F.coalesce("count", F.lit(0).cast("long")))
    return out.where("bin >= 0 OR count > 0")


def density_histogram(rows: DataFrame, value: str, *, by: str, bins: int = 45) -> DataFrame:
    """population, bin, count, density over equal bins between the joint least and largest value."""
    ok = rows.where(~is_missing(value)).select(F.col(by).alias("population"), F.col(value).cast("double").alias("_x"))
    span = ok.agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    place = F.when(width > 0, F.least(F.floor((F.col("_x") - F.col("_lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))).otherwise(0).cast("int")
    per = ok.join(F.broadcast(span)).groupBy("population", place.alias("bin")).agg(F.count("*").alias("count"), F.max(width).alias("_w"))
    total = F.sum("count").over(Window.partitionBy("population"))
    return per.withColumn("density", F.try_divide(F.col("count").cast("double"), total * F.col("_w"))).drop("_w")


def top_with_other(counts: DataFrame, value: str, *, k: int, order: Sequence[Column], sums: Sequence[str]) -> DataFrame:
    """The k first classes and one row Other with the sums of the rest, if there is a rest.

    Only the k rows are put in order: each task keeps its own first k, and the rest are what those k leave.
    """
    first = counts.orderBy(*order).limit(k).withColumn("place", F.row_number().over(Window.orderBy(*order)))
    rest = counts.alias("c").join(F.broadcast(first.select(value)).alias("f"), F.col(f"c.{value}").eqNullSafe(F.col(f"f.{value}")), "left_anti")
    other = rest.agg(F.count("*").alias("_n"), *[F.sum(c).alias(c) for c in sums]).where("_n > 0").select(F.lit("Other").alias("label"), F.lit(k + 1).alias("place"), *sums)
    return first.select(F.col(value).cast("string").alias("label"), "place", *sums).unionByName(other)


def with_places(rows: DataFrame, order: Sequence[Column], *, name: str = "place") -> DataFrame:
    """``rows`` with their place from 1 in an order over all of them: sorted in ranges, numbered in each, and moved by the counts of the ranges before.

    No task sorts the whole; the ranges are checkpointed, as they must not change between the two passes. Rows that the order does not tell apart get places in any order.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    # the number holds the range in its upper bits and the place in it below
    dealt = cut(dealt.withColumn("_range", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND((1 << 33) - 1)))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    return dealt.join(before, "_range").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_id", "_range", "_at", "_before")


def with_absent_groups(counts: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """Counts by an integer key for every value of [low, high], zero where there was none."""
    spine = counts.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias(key))
    return spine.join(counts, key, "left").na.fill(0)


def comparison(random: dict, spatial: dict, metrics: dict[str, str], spark) -> DataFrame:
    """validation_strategy and metrics of two experiment records, with the signed difference spatial - random."""
    rows = [("Random CV", *[float(random[s]) for s in metrics.values()]), ("Spatial CV", *[float(spatial[s]) for s in metrics.values()])]
    rows.append(("Spatial - Random", *[b - a for a, b in zip(rows[0][1:], rows[1][1:], strict=True)]))
    return spark.createDataFrame(rows, "validation_strategy string, " + ", ".join(f"`{m}` double" for m in metrics))


def select_candidate(summary: DataFrame) -> DataFrame:
    """candidate summary with selected and place: by average precision, then AUC, larger leaf, smaller depth (none is unlimited, last), name."""
    order = [F.desc("average_precision_mean"), F.desc("roc_auc_mean"), F.desc("min_samples_leaf"), F.asc_nulls_last("max_depth"), F.asc("candidate")]
    return summary.withColumn("place", F.row_number().over(Window.orderBy(*order))).withColumn("selected", F.col("place") == 1)
