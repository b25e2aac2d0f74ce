"""Forests against a plain tree, against MLlib's, and against themselves with other sizes of groups."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler

from gridloom.operators import forest, modeling


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(1500, 3)), 3)
    kind = rng.integers(0, 4, 1500)
    y = (rng.random(1500) < 1 / (1 + np.exp(-2 * x[:, 0] + 3 * x[:, 1] * (kind == 2)))).astype(int)
    return spark.createDataFrame([(i, *map(float, r), int(k), int(t)) for i, (r, k, t) in enumerate(zip(x, kind, y, strict=True))], "cell_id int, a double, b double, c double, kind int, target int").repartition(3, "cell_id").cache()


def scores(rows, test=None, **options):
    model = modeling.forest_pipeline(continuous=["a", "b"], imputed=["c"], nominal=["kind"], **options).fit(rows)
    return {r["cell_id"]: r["predicted_probability"] for r in modeling.predict(model, rows if test is None else test, ["cell_id"]).collect()}


def plain(x, y, w, key, depth, k, min_leaf):
    """(leaf or not, prediction, draws, draws of class 1, feature, cut, left, right), one node at a time."""
    t, t1 = int(w.sum()), int((w * y).sum())
    leaf = (True, 2 * t1 > t, t, t1)
    if not 0 < t1 < t or t < 2 * min_leaf or depth == 0:
        return leaf
    best = (0.0,)
    for f in forest.chosen(np.array([key], np.uint64), x.shape[1], k)[0]:
        for c in range(255):
            side = x[:, f] <= c
            wl, l1 = int(w[side].sum()), int((w * y)[side].sum())
            if min(wl, t - wl) >= min_leaf and l1 * t != t1 * wl:
                gain = (l1**2 + (wl - l1) ** 2) / wl + ((t1 - l1) ** 2 + (t - wl - t1 + l1) ** 2) / (t - wl)
                if gain > best[0]:
                    best = (gain, f, c)
    if len(best) == 1:
        return leaf
    side, keys = x[:, best[1]] <= best[2], forest.children(np.array([key], np.uint64))
    left, right = (plain(x[s], y[s], w[s], h, depth - 1, k, min_leaf) for s, h in zip((side, ~side), keys, strict=True))
    return leaf if left[0] and right[0] and left[1] == right[1] else (False, None, t, t1, best[1], best[2], left, right)


@pytest.mark.parametrize("levels,min_leaf,k", [(30, 1, 2), (4, 1, 3), (30, 5, 1), (0, 1, 1)])
def test_a_tree_is_the_plain_one(levels, min_leaf, k):
    rng = np.random.default_rng(levels + min_leaf)
    x = np.stack([rng.integers(0, n, 300) for n in (256, 7, 2)], axis=1).astype(np.uint8)
    y, w = rng.integers(0, 2, 300).astype(np.uint8), rng.integers(1, 4, 300).astype(np.uint8)
    key = np.uint64(77)
    tree, t, t1 = forest.grow(x, y, w, key, levels=levels, k=k, min_leaf=min_leaf)
    want = plain(x, y.astype(int), w.astype(int), key, levels, k, min_leaf)
    assert (t, t1) == want[2:4] and (levels == 0) == (len(tree) == 1)

    def same(at, node):
        if node[0]:
            assert tree["feature"][at] == -1 and abs(tree["p"][at] - node[3] / node[2]) < 1e-12
            return 1
        assert (tree["feature"][at], tree["cut"][at]) == node[4:6]
        return 1 + same(tree["left"][at], node[6]) + same(tree["left"][at] + 1, node[7])

    assert same(0, want) == len(tree)


def test_splits_by_histograms_and_in_groups_are_one_forest(rows, monkeypatch):
    for options in (dict(trees=13), dict(trees=4, max_depth=3), dict(trees=4, min_leaf=20)):
        whole = scores(rows, **options)
        with monkeypatch.context() as m:
            m.setattr(forest, "LARGE", 60)  # the tops have several levels, over blocks that are not full, and some of their leaves are put together
            m.setattr(forest, "BLOCK", 200)
            assert scores(rows, **options) == whole
    assert len(whole) == 1500 and all(0 <= p <= 1 for p in whole.values())


def test_a_forest_is_like_mllibs(rows):
    kw = dict(trees=60, max_depth=10)
    mine = scores(rows, **kw)
    *before, _ = modeling.forest_pipeline(continuous=["a", "b"], imputed=["c"], nominal=["kind"], **kw).getStages()
    assert isinstance(before[-1], VectorAssembler)
    theirs = Pipeline(stages=[*before, RandomForestClassifier(featuresCol="_features", labelCol="target", numTrees=60, maxDepth=10, maxBins=256, seed=1)]).fit(rows)
    other = {r["cell_id"]: r["predicted_probability"] for r in modeling.predict(theirs, rows, ["cell_id"]).collect()}
    a, b = (np.array([s[i] for i in range(1500)]) for s in (mine, other))
    assert np.corrcoef(a, b)[0, 1] > 0.98 and abs(a - b).mean() < 0.04 and abs(a.mean() - b.mean()) < 0.01


def test_jobs_do_not_grow_with_the_trees_nodes(spark, rows):
    """MLlib runs a job or more for every level of its trees: these are over twenty levels deep."""
    shuffled = rows.selectExpr("cell_id", "a", "b", "c", "kind", "cell_id % 2 AS target")
    spark.sparkContext.setJobGroup("forest", "")
    try:
        modeling.forest_pipeline(continuous=["a", "b", "c"], trees=5).getStages()[-1].fit(modeling.forest_pipeline(continuous=["a", "b", "c"]).getStages()[0].transform(shuffled).transform(lambda d: VectorAssembler(inputCols=["_a", "_b", "_c"], outputCol="_features").transform(d)))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("forest")) <= 16


def test_odd_inputs(spark, rows):
    one = rows.where("target = 1").limit(40)
    assert set(scores(one, rows.limit(5), trees=3).values()) == {1.0}
    assert scores(rows, rows.limit(0), trees=2) == {}
    twice = scores(rows.unionByName(rows), rows.limit(7), trees=3)
    assert len(twice) == 7
    with pytest.raises(ValueError):
        scores(rows.selectExpr("cell_id", "a", "b", "c", "kind", "target + 1 AS target"), trees=2)
