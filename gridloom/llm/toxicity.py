"""Toxicity: cumulative-link (proportional-odds) regression on sparse text features.

P(grade > j | x) = sigmoid(w.x - t_j) with one weight vector for all thresholds t_0 < t_1 < ... A feature's value is the
number of distinct words of the text that have it; features are whole words and word beginnings. The severity of a text is its
expected grade, the sum of P(grade > j).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import map_batches, small_batches, staged

#: Labelled rows that the model is fitted on, give or take a few per cent: the documents with the smallest hashes of their ids.
TRAIN_ROWS = 12_000
#: Lengths of the word beginnings that are features.
PREFIXES = (4, 5, 6)
#: Evidence that a feature needs beyond what the best of as many useless ones has by chance.
MARGIN = 6.0
#: A text is rejected from this probability of a grade over 0.
REJECT_FROM = 0.5
WORD = re.compile(r"[^\W\d_]+")
_CACHE_WORDS = 300_000


def word_features(word: str) -> list[str]:
    """The word itself and its beginnings; ``^`` marks beginnings, so a short word and a beginning differ."""
    return [word, *(f"^{word[:n]}" for n in PREFIXES if len(word) > n)]


def _words(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def _features(text: str | None) -> set[str]:
    return {f for w in _words(text) for f in word_features(w)}


@dataclass(frozen=True)
class OrdinalModel:
    """weights of the features, ascending thresholds and the grades they part; picklable, and bounded as the labelled sample is."""

    weights: dict[str, float]
    thresholds: tuple[float, ...]
    levels: tuple[int, ...] = (0, 1, 2)

    def word_weight(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in word_features(word))

    def exceed(self, score: np.ndarray) -> np.ndarray:
        """P(grade > j) for each threshold j."""
        z = np.asarray(score, float)[:, None] - np.array(self.thresholds)[None, :]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit_ordinal(x: tuple[np.ndarray, np.ndarray, np.ndarray], shape: tuple[int, int], grades: np.ndarray, n_grades: int, *, l2: float = 1e-6, steps: int = 1500, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by maximum likelihood with an L2 penalty (Adam on the full data).

    ``x`` holds rows, columns and values of the features that are not 0. Threshold j is t_0 + exp(g_1) + ... + exp(g_j), so the order holds by construction.
    """
    (n, d), (rows, cols, values) = shape, x
    w, t0, gaps = np.zeros(d), 1.0, np.zeros(max(0, n_grades - 2))
    m, v = np.zeros(d + 1 + gaps.size), np.zeros(d + 1 + gaps.size)
    for step in range(1, steps + 1):
        cuts = t0 + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, w[cols] * values, n)[:, None] - cuts[None, :], -50, 50)))
        over = np.hstack([np.ones((n, 1)), p, np.zeros((n, 1))])
        slope = np.hstack([np.zeros((n, 1)), p * (1 - p), np.zeros((n, 1))])
        i = np.arange(n)
        mass = np.maximum(over[i, grades] - over[i, grades + 1], 1e-12)
        up, down = slope[i, grades] / mass, slope[i, grades + 1] / mass
        g_w = -np.bincount(cols, (up - down)[rows] * values, d) / n + l2 * w
        g_cut = np.zeros(cuts.size)
        np.add.at(g_cut, np.clip(grades - 1, 0, None), np.where(grades > 0, up, 0) / n)
        np.add.at(g_cut, np.clip(grades, None, cuts.size - 1), -np.where(grades < cuts.size, down, 0) / n)
        g_gap = np.array([g_cut[j + 1 :].sum() * np.exp(gaps[j]) for j in range(gaps.size)])
        g = np.concatenate([g_w, [g_cut.sum()], g_gap])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, t0, gaps = w - move[:d], t0 - move[d], gaps - move[d + 1 :]
    return w, t0 + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])


def fit(docs: DataFrame, labels: DataFrame, *, train_rows: int = TRAIN_ROWS, text: str = "text", doc_id: str = "doc_id", grade: str = "toxic") -> OrdinalModel:
    """Fit on about ``train_rows`` labelled documents at most; without toxic or without clean ones the model rejects nothing.

    The column ``grade`` of ``labels`` orders the severities: 0 is clean, all above is toxic. The model has a threshold between each two grades that the
    sample holds. Of several labels of a document the largest counts; null ids and null labels are no labels, null texts have no features.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = (
        labels.where(F.col(grade).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.greatest(F.col(grade).cast("int"), F.lit(0)).alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    # hashes are even, so those under a share of their range are about train_rows labels, and no task sorts more
    share = min(1.0, train_rows / max(1, known.count()))
    ids = known if share == 1.0 else known.where(F.xxhash64("doc_id").cast("double") < (2 * share - 1) * 2.0**63)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(ids), "doc_id")
    sample = staged(texts.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("text").alias("text")), "toxicity-sample")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every: Counter[str] = Counter()
        bad: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            keys = list(every)
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([bad[k] for k in keys], pa.int64()), pa.array([every[k] for k in keys], pa.int64())], names=["f", "bad", "n"])
            every.clear()
            bad.clear()
            return out

        for b in batches:
            for is_bad, x in zip(b.column("toxic").to_pylist(), b.column("text").to_pylist(), strict=True):
                f = _features(x)
                every.update(f)
                if is_bad > 0:
                    bad.update(f)
                if len(every) > _CACHE_WORDS:
                    yield flush()
        if every:
            yield flush()

    per = sample.select("toxic", "text").mapInArrow(counted, "f string, bad long, n long").groupBy("f").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    n_bad, n_all = sample.agg(F.count_if(F.col("toxic") > 0), F.count("*")).first()
    if not n_bad or n_bad == n_all:
        return OrdinalModel({}, (50.0,), (0, 1))
    # evidence of each feature: the log-likelihood ratio of its share among toxic documents, which chance alone keeps under 2 ln(features)
    rate, part_bad = n_bad / n_all, F.col("bad") / F.col("n")
    part = lambda k, p, q: F.when(k > 0, k * F.log(p / F.lit(q))).otherwise(0.0)
    ratio = 2 * (part(F.col("bad"), part_bad, rate) + part(F.col("n") - F.col("bad"), 1 - part_bad, 1 - rate))
    evident = 2 * math.log(1 + per.count()) + MARGIN
    # those that stand out among the features of the bounded sample, however many
    kept = sorted(r["f"] for r in per.where(ratio > evident).select("f").collect())
    place = {f: i for i, f in enumerate(kept)}

    def sparse(batch: pa.RecordBatch) -> pa.RecordBatch:
        idx = [[place[f] for w in _words(x) for f in word_features(w) if f in place] for x in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(idx, pa.list_(pa.int32()))], names=["doc_id", "toxic", "idx"])

    rows = map_batches(sample, sparse, "doc_id long, toxic int, idx array<int>").toArrow().sort_by("doc_id")  # at most train_rows rows of a few indices
    idx = rows.column("idx").combine_chunks()
    docs_of = np.repeat(np.arange(rows.num_rows), idx.value_lengths().to_numpy())
    pairs, values = np.unique(docs_of * np.int64(max(1, len(kept))) + idx.flatten().to_numpy(), return_counts=True)
    r, c = np.divmod(pairs, max(1, len(kept)))
    levels, grades = np.unique(rows.column("toxic").to_numpy(), return_inverse=True)
    w, cuts = fit_ordinal((r, c, values.astype(float)), (rows.num_rows, max(1, len(kept))), grades, len(levels))
    return OrdinalModel({f: float(w[i]) for f, i in place.items() if abs(w[i]) > 1e-4}, tuple(map(float, cuts)), tuple(levels.tolist()))


def score(docs: DataFrame, model: OrdinalModel, *, text: str = "text", reject_from: float = REJECT_FROM) -> DataFrame:
    """``docs`` with severity (expected grade), p_toxic (P(grade > 0)), grade (the likeliest) and rejected.

    Every row stays. Null and empty texts have score 0, the prior of a text without features. Columns of those names are replaced.
    """
    small_batches(docs.sparkSession)
    added = ["severity", "p_toxic", "grade", "rejected"]
    kept = docs.drop(*added)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded as the labelled sample is
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, cache = shared.value, {}
        for batch in batches:
            z = np.zeros(batch.num_rows)
            for i, words in enumerate(map(_words, batch.column([n.lower() for n in names].index(text.lower())).to_pylist())):
                if len(cache) >= _CACHE_WORDS:
                    cache.clear()
                for w in words.difference(cache):
                    cache[w] = m.word_weight(w)
                z[i] = math.fsum(map(cache.__getitem__, words))  # exact, so a set's order doesn't matter
            over = m.exceed(z)
            mass = -np.diff(np.hstack([np.ones((len(z), 1)), over, np.zeros((len(z), 1))]), axis=1)
            levels = np.array(m.levels)
            cols = [levels[0] + over @ np.diff(levels), over[:, 0], levels[mass.argmax(1)].astype(np.int32), over[:, 0] >= reject_from]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, cols)], names=[*names, *added])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + ["severity double, p_toxic double, grade int, rejected boolean"])
    return kept.mapInArrow(run, schema)
