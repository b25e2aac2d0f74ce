"""Spatial designs: blocks, directional holdouts, folds of whole blocks, connectivity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.contracts import require
from gridloom.session import cut

DIRECTIONS = ("west", "east", "north", "south")


def assign_blocks(cells: DataFrame, *, anchor: tuple[float, float], size: float, x: str = "x", y: str = "y") -> DataFrame:
    """block_row, block_col and spatial_block_id of centres; the anchor is the whole grid's snapped corner, so exclusions don't move blocks."""
    require(size > 0, "block size must be positive")
    r, c = F.floor((F.col(y) - anchor[1]) / size), F.floor((F.col(x) - anchor[0]) / size)
    return cells.withColumn("block_row", r.cast("long")).withColumn("block_col", c.cast("long")).withColumn("spatial_block_id", F.concat(F.lit("r"), F.col("block_row").cast("string"), F.lit("_c"), F.col("block_col").cast("string")))


def summarise_blocks(cells: DataFrame, *, anchor: tuple[float, float], size: float, target: str = "target") -> DataFrame:
    """One row a block: cells, positives, negatives, share and bounds."""
    per = cells.groupBy("spatial_block_id", "block_row", "block_col").agg(F.count("*").alias("cells"), F.sum(target).cast("long").alias("positives"))
    at = lambda c, a, n: F.lit(float(a)) + (F.col(c) + n) * float(size)
    return per.select(
        "*", (F.col("cells") - F.col("positives")).alias("negatives"), (100.0 * F.col("positives") / F.col("cells")).alias("positive_percent"),
        at("block_col", anchor[0], 0).alias("min_x_m"), at("block_row", anchor[1], 0).alias("min_y_m"), at("block_col", anchor[0], 1).alias("max_x_m"), at("block_row", anchor[1], 1).alias("max_y_m"),
    )


def directional_holdout(blocks: DataFrame, direction: str, *, fraction: float = 0.2) -> DataFrame:
    """Whole strips of blocks from one side whose cells come closest to ``fraction`` of all; equal distances prefer fewer cells.

    Strips are few, so the running sum over them is small; labels play no part.
    """
    require(direction in DIRECTIONS, f"unknown direction {direction}")
    axis = "block_col" if direction in ("west", "east") else "block_row"
    up = direction in ("west", "south")
    key = F.col(axis) if up else -F.col(axis)
    strips = blocks.groupBy(key.alias("_k")).agg(F.sum("cells").alias("_n"))
    w = Window.orderBy("_k")
    sums = strips.select("_k", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_run"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    cutoff = sums.agg(F.min(F.struct(F.abs(F.col("_run") - fraction * F.col("_all")), "_k")).alias("m")).select(F.col("m._k").alias("_cut"))
    return blocks.join(F.broadcast(cutoff)).where(key <= F.col("_cut")).drop("_cut")


def holdout_candidates(blocks: DataFrame, *, fraction: float = 0.2) -> DataFrame:
    """One row a direction: population, bounds and connectivity of its holdout."""
    all_cells = blocks.agg(F.sum("cells").alias("_all"))
    parts = [directional_holdout(blocks, d, fraction=fraction).withColumn("direction", F.lit(d)) for d in DIRECTIONS]
    chosen = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    groups = components(chosen, by="direction").groupBy("direction").agg(F.count_distinct("component").alias("components"))
    per = chosen.groupBy("direction").agg(
        F.count("*").alias("blocks"), F.sum("cells").alias("cells"), F.sum("positives").alias("positives"), F.min("min_x_m").alias("min_x_m"), F.max("max_x_m").alias("max_x_m"), F.min("min_y_m").alias("min_y_m"), F.max("max_y_m").alias("max_y_m"),
    )
    out = per.join(F.broadcast(all_cells)).join(groups, "direction")
    return out.select(
        "direction", "blocks", "cells", (100.0 * F.col("cells") / F.col("_all")).alias("statewide_percent"), "positives", (F.col("cells") - F.col("positives")).alias("negatives"),
        (100.0 * F.col("positives") / F.col("cells")).alias("positive_percent"), "min_x_m", "max_x_m", "min_y_m", "max_y_m", "components", (F.col("components") == 1).alias("contiguous"),
    )


def freeze_holdout(cells: DataFrame, test: Column) -> DataFrame:
    """split: ``final_test`` where the frozen condition holds, else ``train``."""
    return cells.withColumn("split", F.when(test, "final_test").otherwise("train"))


def check_frozen_holdout(cells: DataFrame, *, anchor: tuple[float, float], approved: tuple[float, float], rows: int, positives: int, blocks: int, all_blocks: int, extent: tuple[int, int, int, int]) -> None:
    """Raises unless the frozen design is the approved one: its anchor, the rows, positives and blocks of ``final_test`` and all blocks, the least and greatest block column and row, one group of blocks that share edges.

    ``cells`` has split, target, spatial_block_id, block_row and block_col. Nothing is moved to fit: a source that changed is an error.
    """
    require(anchor == approved, f"the anchor is {anchor}, approved was {approved}")
    test = F.col("split") == "final_test"
    # two aggregations, by block first: a block is one row whatever its cells
    per = cells.groupBy("spatial_block_id", "block_row", "block_col").agg(F.count_if(test).alias("rows"), F.sum(F.when(test, F.col("target")).otherwise(0)).alias("positives"))
    held = F.col("rows") > 0
    r = per.agg(
        F.sum("rows").alias("rows"), F.sum("positives").alias("positives"), F.count_distinct(F.when(held, F.col("spatial_block_id"))).alias("blocks"), F.count_distinct("spatial_block_id").alias("all"),
        *[f(F.when(held, F.col(c))).alias(f"{n}_{c}") for c in ("block_col", "block_row") for n, f in (("low", F.min), ("high", F.max))],
    ).first()
    found, wanted = (r["rows"], r["positives"], r["blocks"], r["all"]), (rows, positives, blocks, all_blocks)
    require(found == wanted, f"rows, positives, held-out and all blocks are {found}, approved were {wanted}")
    place = (r["low_block_col"], r["high_block_col"], r["low_block_row"], r["high_block_row"])
    require(place == extent, f"held-out blocks lie in columns and rows {place}, approved were {extent}")
    groups = components(per.where(held)).agg(F.count_distinct("component")).first()[0]
    require(groups == 1, f"held-out blocks are in {groups} groups")


def components(blocks: DataFrame, *, by: str | None = None, row: str = "block_row", col: str = "block_col") -> DataFrame:
    """``blocks`` with component: groups of blocks that share edges (corners don't count), named by their least (row, col).

    Labels spread to neighbours and then along their own labels, so rounds grow with the logarithm of a group's length; each round is checkpointed.
    """
    keys = [by] if by else []
    nodes = blocks.select(*keys, row, col).distinct()
    start = cut(nodes.select(*keys, row, col, F.struct(F.col(row).alias("r"), F.col(col).alias("c")).alias("component")))
    step = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))])
    while True:
        sent = start.select(*keys, F.explode(step).alias("s"), row, col, "component").select(*keys, (F.col(row) + F.col("s.dr")).alias(row), (F.col(col) + F.col("s.dc")).alias(col), "component")
        least = start.select(*keys, row, col).join(sent, [*keys, row, col]).groupBy(*keys, row, col).agg(F.min("component").alias("component"))
        root = least.select(*keys, F.col(row).alias("_r"), F.col(col).alias("_c"), F.col("component").alias("_further"))
        after = cut(_jump(least, root, keys, row, col))
        changed = after.alias("a").join(start.alias("b"), [*keys, row, col]).where("a.component <> b.component").isEmpty()
        start = after
        if changed:
            return blocks.join(start.withColumn("component", F.concat_ws("_", F.col("component.r"), F.col("component.c"))), [*keys, row, col])


def _jump(least: DataFrame, root: DataFrame, keys: list[str], row: str, col: str) -> DataFrame:
    """Each label replaced by the label of the block it names."""
    names = {k: f"_{k}" for k in keys}
    r = root.withColumnsRenamed(names)
    on = (F.col("component.r") == F.col("_r")) & (F.col("component.c") == F.col("_c"))
    for k in keys:
        on &= F.col(k) == F.col(f"_{k}")
    return least.join(r, on).select(*keys, row, col, F.col("_further").alias("component"))


def random_folds(rows: DataFrame, *, n: int = 5, seed: int = 42, key: str = "cell_id", target: str = "target") -> DataFrame:
    """random_cv_fold: stratified by target, in the order of a seeded hash of the key, so sizes differ by one at most.

    Ranks come from counts of the hash's first two digits and the order inside them: no class is sorted in one task.
    """
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))
    marked = rows.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, 3))
    per = marked.groupBy(target, "_b").agg(F.count("*").alias("_n"))
    before = per.select(F.col(target).alias("_t"), F.col("_b").alias("_bb"), (F.sum("_n").over(Window.partitionBy(target).orderBy("_b")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy(target, "_b").orderBy("_h", key)) + F.col("_before")
    out = marked.join(F.broadcast(before), (F.col(target) == F.col("_t")) & (F.col("_b") == F.col("_bb")))
    return out.withColumn("random_cv_fold", F.pmod(rank - 1, F.lit(n)).cast("int")).drop("_h", "_b", "_t", "_bb", "_before")


def greedy_folds(blocks: DataFrame, *, n: int = 5) -> DataFrame:
    """spatial_block_id, spatial_cv_fold: blocks in order of positives, cells (both descending) and id go to the fold whose squared loads grow least.

    Loads are relative to an even share of cells and of positives; ties go to the lowest fold. The fold over the ordered blocks is one expression over one
    array: blocks are a few for each state, whatever the number of cells.
    """
    item = F.struct((-F.col("positives")).alias("np"), (-F.col("cells")).alias("nc"), F.col("spatial_block_id").alias("id"))
    one = blocks.agg(F.array_sort(F.collect_list(item)).alias("items"), (F.sum("cells") / n).alias("share_c"), (F.sum("positives") / n).alias("share_p"))
    zero = F.struct(F.array_repeat(F.lit(0.0), n).alias("c"), F.array_repeat(F.lit(0.0), n).alias("p"), F.array().cast("array<struct<id:string,fold:int>>").alias("out"))

    def step(acc: Column, b: Column) -> Column:
        c, p = -b["nc"].cast("double"), -b["np"].cast("double")
        grow = lambda load, add, share: ((load + add) / share) * ((load + add) / share) - (load / share) * (load / share)
        scores = F.zip_with(acc["c"], acc["p"], lambda a, q: grow(a, c, F.col("share_c")) + grow(q, p, F.col("share_p")))
        fold = (F.array_position(scores, F.array_min(scores)) - 1).cast("int")
        put = lambda load, add: F.transform(load, lambda v, i: F.when(i == fold, v + add).otherwise(v))
        return F.struct(put(acc["c"], c).alias("c"), put(acc["p"], p).alias("p"), F.concat(acc["out"], F.array(F.struct(b["id"].alias("id"), fold.alias("fold")))).alias("out"))

    done = one.select(F.explode(F.aggregate("items", zero, step, lambda acc: acc["out"])).alias("o"))
    return done.select(F.col("o.id").alias("spatial_block_id"), F.col("o.fold").alias("spatial_cv_fold"))


def population_summary(rows: DataFrame, by: str, *, target: str = "target", block: str = "spatial_block_id") -> DataFrame:
    """rows, positives, negatives, share and blocks for each value of a split or fold column."""
    per = rows.groupBy(by).agg(F.count("*").alias("rows"), F.sum(target).cast("long").alias("positives"), F.count_distinct(block).alias("blocks"))
    return per.select(by, "rows", "positives", (F.col("rows") - F.col("positives")).alias("negatives"), (F.col("positives").cast("double") / F.col("rows")).alias("positive_prevalence"), "blocks")
