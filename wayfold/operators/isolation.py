"""Isolation trees: how few random cuts set a row apart from the others.

Each tree is grown from a small random sample, so the forest has a fixed size whatever the table holds; it is broadcast
as arrays, and rows go down all trees at once where they are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.operators.windows import cut, exact_quantiles

TREES, SAMPLE = 200, 256        # the bound of what is collected: at most their product of rows


def expected_depth(n) -> np.ndarray:
    """Mean depth of an unsuccessful search among n values: what a leaf of n rows still counts for."""
    n = np.asarray(n, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        deep = 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n
    return np.where(n > 2, deep, np.where(n == 2, 1.0, 0.0))


class Forest:
    """Trees in one set of arrays; ``feature`` is -1 at leaves, where ``value`` is the path length."""

    def __init__(self, pool: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = 42):
        self.feature, self.value, self.left, self.right, self.roots = [], [], [], [], []
        rng = np.random.default_rng(seed)
        self.size = min(sample, len(pool))
        deepest = int(np.ceil(np.log2(max(2, self.size))))
        for _ in range(trees):
            self.roots.append(self._grow(pool[rng.choice(len(pool), self.size, replace=False)], 0, deepest, rng))
        for name in ("feature", "value", "left", "right", "roots"):
            setattr(self, name, np.asarray(getattr(self, name)))

    def _grow(self, x: np.ndarray, depth: int, deepest: int, rng) -> int:
        at = len(self.feature)
        for a in (self.feature, self.left, self.right):
            a.append(-1)
        self.value.append(depth + float(expected_depth(len(x))))
        wide = np.flatnonzero(x.max(axis=0) > x.min(axis=0)) if len(x) > 1 else []
        if depth < deepest and len(wide):
            f = int(rng.choice(wide))
            split = rng.uniform(x[:, f].min(), x[:, f].max())
            low = x[:, f] <= split
            if low.any() and not low.all():
                self.feature[at], self.value[at] = f, float(split)
                self.left[at] = self._grow(x[low], depth + 1, deepest, rng)
                self.right[at] = self._grow(x[~low], depth + 1, deepest, rng)
        return at

    def path_lengths(self, x: np.ndarray) -> np.ndarray:
        """Mean over all trees: each step moves every row that is not yet at a leaf."""
        total = np.zeros(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            live = np.arange(len(x)) if self.feature[root] >= 0 else np.arange(0)
            while len(live):
                n = node[live]
                low = x[live, self.feature[n]] <= self.value[n]
                node[live] = np.where(low, self.left[n], self.right[n])
                live = live[self.feature[node[live]] >= 0]
            total += self.value[node]
        return total / max(1, len(self.roots))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, the greater the more apart."""
        norm = float(expected_depth(self.size))
        return 2.0 ** (-self.path_lengths(x) / norm) if norm > 0 else np.full(len(x), 0.5)


def isolation_scores(features: DataFrame, names: list[str], key: str = "flight_id", trees: int = TREES, sample: int = SAMPLE, seed: int = 42) -> DataFrame:
    """``key`` and score of every row. The trees see the rows whose key hashes lowest, at most ``trees * sample``; nulls count as 0.

    Neither the order nor the partitions of the rows matter.
    """
    x = features.select(F.col(key), *[F.coalesce(F.nanvl(F.col(n).cast("double"), F.lit(None)), F.lit(0.0)).alias(n) for n in names])
    pool = x.orderBy(F.xxhash64(F.lit(seed), key), *[F.col(n) for n in [key, *names]]).limit(trees * sample).select(*names).toArrow()
    table = lambda t: np.column_stack([t[n].to_numpy() for n in names]) if len(names) else np.zeros((t.num_rows, 0))
    if not pool.num_rows:
        return x.select(key, F.lit(0.0).alias("score"))
    forest = x.sparkSession.sparkContext.broadcast(Forest(table(pool), trees, sample, seed))
    kind = features.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names])
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(forest.value.scores(rows))], [key, "score"])

    return x.mapInArrow(run, f"`{key}` {kind}, score double")


def flagged(scores: DataFrame, contamination: float = 0.01) -> DataFrame:
    """Add is_anomaly: above the exact quantile that leaves a share ``contamination`` on top (linear between ranks)."""
    kept = cut(scores.withColumn("_all", F.lit(1)))
    at = 1.0 - contamination
    limit = exact_quantiles(kept, "_all", ["score"], [at]).withColumnRenamed(f"score_q{round(at * 100):02d}", "_limit")
    return kept.join(F.broadcast(limit), "_all").withColumn("is_anomaly", F.col("score") > F.col("_limit")).drop("_all", "_limit")     # one row
