"""Hard negatives by threshold joins over an inverted index.

An anchor's positives are its best rows of the same label, and its hard negatives the best rows of other
labels that score within a window below a positive. Both come from joins that find every pair of anchor and row
with an inner product at or above the anchor's threshold. A block of rows is indexed by dimension. A
row's leading dimensions, whose norm can't reach any anchor's threshold, are left out of the index. Scores
are added up from the last dimension to the first, and a pair is dropped once its sum and the norms that remain
stay below the threshold. Thresholds start where an estimate expects enough rows and are lowered for the
anchors whose windows are not full, down to the end of their windows.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.arrow import freed
from wayfold.llm.integers import finite, floored, padded
from wayfold.storage import written

ANCHORS_AT_ONCE = 16_384        # anchors of one pass over the rows: the bound of what is broadcast
SAMPLE = 4096                   # rows that the estimate of first thresholds looks at; results don't depend on it
ROWS, ASKED = 4096, 256         # a tile of the join
STEP = 8                        # dimensions between two prunings
LOWERING = 8.0
FOUND = "anchor_id long, bar long, other_id long, score long"


class Anchors:
    """Anchors of one pass: vectors in index order of dimensions, thresholds, and the windows to fill.

    ``bars`` has one row of ascending window tops for each anchor; without bars the join looks for the same label.
    """

    def __init__(self, ids, labels, vectors, thresholds, order, bars=None, keep=5, least=80):
        self.ids, self.labels, self.thresholds, self.order = ids, labels, thresholds, order
        self.vectors = vectors[:, order]
        self.norms = prefix_norms(self.vectors)
        self.bars, self.keep, self.least = bars, keep, least


def prefix_norms(vectors: np.ndarray) -> np.ndarray:
    """(rows, dims + 1) norms of the leading dimensions."""
    x = vectors.astype(np.float64)
    return np.sqrt(np.concatenate([np.zeros((len(x), 1)), np.cumsum(x * x, axis=1)], axis=1))


class Index:
    """Rows of a block by dimension. Rows with the fewest dimensions left out come first, so a posting list is a leading slice."""

    def __init__(self, ids, labels, vectors, norms, thresholds):
        dims = vectors.shape[1]
        with np.errstate(divide="ignore", invalid="ignore"):
            reach = np.where(norms > 0, thresholds[:, None] / norms, np.where(thresholds > 0, np.inf, -np.inf)[:, None]).min(axis=0)
        own = prefix_norms(vectors)
        out = (own < reach * (1 - 1e-9)).sum(axis=1) - 1        # leading dimensions below every threshold
        out = np.maximum(out, 0)
        full = own[:, -1] < reach[-1] * (1 - 1e-9)
        rows = np.flatnonzero(~full)
        rows = rows[np.argsort(out[rows], kind="stable")]
        self.ids, self.labels, self.vectors, self.own, self.out = ids[rows], labels[rows], vectors[rows], own[rows], out[rows]
        self.listed = np.searchsorted(self.out, np.arange(dims), side="right")      # length of each posting list
        self.posting = np.where(np.arange(dims) >= self.out[:, None], self.vectors, 0).astype(np.float64)

    def join(self, labels, vectors, norms, thresholds, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, score) of all pairs at or above the thresholds, of the same label or of different ones."""
        none = np.zeros(0, np.int64)
        if not len(self.ids) or not len(labels):
            return none, none, none
        dims = vectors.shape[1]
        a, acc = vectors.astype(np.float64), np.zeros((len(labels), len(self.ids)))
        slack = thresholds - 1e-9 * np.abs(thresholds) - 1e-6
        high = np.median(norms, axis=0) * np.median(self.own, axis=0) >= np.median(thresholds)
        hi = dims
        lo = int(min(dims, np.argmax(high))) if high.any() else dims
        lo = max(0, min(lo, dims - STEP))
        while True:             # whole tile, until few pairs are left
            n = self.listed[hi - 1]
            acc[:, :n] += a[:, lo:hi] @ self.posting[:n, lo:hi].T
            rest = np.maximum(lo, self.out)
            live = acc + norms[:, rest] * self.own[np.arange(len(rest)), rest] >= slack[:, None]
            few = np.count_nonzero(live) * 16 < live.size
            hi, lo = lo, max(0, lo - STEP)
            if few or not hi:
                break
        live &= (labels[:, None] == self.labels[None, :]) == same
        x, y = np.nonzero(live)
        sums = acc[x, y]
        while hi and len(x):
            sums += np.einsum("ij,ij->i", a[x, lo:hi], self.posting[y, lo:hi])
            rest = np.maximum(lo, self.out[y])
            on = sums + norms[x, rest] * self.own[y, rest] >= slack[x]
            x, y, sums = x[on], y[on], sums[on]
            hi, lo = lo, max(0, lo - STEP)
        exact = np.concatenate([none, *((vectors[x[i:i + 65_536]].astype(np.int64) * self.vectors[y[i:i + 65_536]]).sum(axis=1) for i in range(0, len(x), 65_536))])
        on = exact >= thresholds[x]
        return x[on], y[on], exact[on]


def best(anchor, bar, other, score, keep: int) -> list[np.ndarray]:
    """The first ``keep`` of each (anchor, bar): higher scores first, ties by smaller id."""
    order = np.lexsort((other, -score, bar, anchor))
    anchor, bar, other, score = anchor[order], bar[order], other[order], score[order]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (bar[1:] != bar[:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(len(anchor)), 0))
    on = np.arange(len(anchor)) - start < keep
    return [anchor[on], bar[on], other[on], score[on]]


def found(kept: DataFrame, asked: Anchors) -> DataFrame:
    """anchor_id, bar, other_id, score: the best of each window among rows at or above the anchors' thresholds."""
    shared = kept.sparkSession.sparkContext.broadcast(asked)

    def of_block(t: Anchors, ids, labels, vectors):
        index = Index(ids, labels, vectors[:, t.order], t.norms, t.thresholds)
        for a in range(0, len(t.ids), ASKED):
            cut = slice(a, a + ASKED)
            x, y, score = index.join(t.labels[cut], t.vectors[cut], t.norms[cut], t.thresholds[cut], t.bars is None)
            x = x + a
            if t.bars is None:
                on = t.ids[x] != index.ids[y]
                x, y, score, bar = x[on], y[on], score[on], np.zeros(int(on.sum()), np.int64)
            else:
                bar = t.bars[x]
                on = (100 * score[:, None] >= t.least * bar) & (score[:, None] <= bar) & (bar >= 0)
                pair, slot = np.nonzero(on)
                bar = bar[pair, slot]
                x, y, score = x[pair], y[pair], score[pair]
            if len(x):
                yield best(t.ids[x], bar, index.ids[y], score, t.keep)

    @freed
    def run(batches):
        t, held, n = shared.value, [], 0
        width = t.vectors.shape[1]
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                for got in of_block(t, part.column("vec_id").to_numpy(), part.column("label").to_numpy(), padded(part.column("q"), width)):
                    held.append(got)
                    n += len(got[0])
                if n > 500_000:         # at most ``keep`` for each window stay
                    held = [best(*map(np.concatenate, zip(*held)), t.keep)]
                    n = len(held[0][0]) // 2
        if held:
            out = pa.table(best(*map(np.concatenate, zip(*held)), t.keep), names=["anchor_id", "bar", "other_id", "score"])
            yield from out.to_batches(max_chunksize=65_536)

    order = Window.partitionBy("anchor_id", "bar").orderBy(F.desc("score"), "other_id")
    pairs = kept.mapInArrow(run, FOUND)
    return pairs.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= asked.keep).drop("_r")


def prepared(rows: DataFrame, vec_id: str, vector: str, label: str, shift: int = 7, labels: int = 10) -> DataFrame:
    """vec_id, label, q of the rows that take part: one for each id."""
    name = F.col(label).cast("long")
    name = F.when(F.col(vec_id) % shift == 0, (name + 1) % labels).otherwise(name)
    kept = rows.where(F.col(label).isNotNull() & F.col(vec_id).isNotNull() & finite(F.col(vector)))
    kept = kept.select(F.col(vec_id).cast("long").alias("vec_id"), name.alias("label"), floored(F.col(vector)).alias("q"))
    return kept.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("_m")).select("vec_id", "_m.label", "_m.q")


class Estimate:
    """Scores of an anchor, taken as normal with the moments of a bounded sample of rows."""

    def __init__(self, sample: np.ndarray, vectors: np.ndarray):
        x = sample.astype(np.float64)
        self.mean = vectors @ x.mean(axis=0)
        spread = np.cov(x, rowvar=False, bias=True).reshape(x.shape[1], x.shape[1]) if len(x) > 1 else np.zeros((x.shape[1],) * 2)
        self.sd = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", vectors, spread, vectors), 0)) + 1e-9

    def bar(self, share: np.ndarray) -> np.ndarray:
        """The score that a share of the rows is expected to reach."""
        z = np.asarray([NormalDist().inv_cdf(1 - min(max(s, 1e-12), 1 - 1e-12)) for s in share])
        return self.mean + self.sd * z

    def share(self, score: np.ndarray) -> np.ndarray:
        return np.asarray([1 - NormalDist().cdf(z) for z in (score - self.mean) / self.sd])


def positives(kept: DataFrame, block: dict, sample: np.ndarray, order: np.ndarray, need: np.ndarray, keep: int) -> DataFrame:
    """anchor_id, other_id, score: the first ``keep`` rows of the anchor's own label, all if fewer."""
    guess, out = Estimate(sample, block["q"]), None
    size, live, wanted = block["same"], np.flatnonzero(need > 0), 3.0 * keep
    while len(live):
        share = wanted / np.maximum(1, size)
        bars = np.where(share < 0.5, np.ceil(guess.bar(np.minimum(share, 0.5))), -np.inf)
        asked = Anchors(block["id"][live], block["label"][live], block["q"][live], bars[live], order, keep=keep)
        got = written(found(kept, asked), "positives")
        out = got if out is None else out.unionByName(got)
        n = counts(got, ["anchor_id"])
        live = np.asarray([i for i in live.tolist() if n.get(int(block["id"][i]), 0) < need[i] and bars[i] > -np.inf], np.int64)
        wanted *= LOWERING
    return out


def counts(got: DataFrame, key: list[str]) -> dict:
    """Rows of each key: one number for each anchor or window of a pass reaches the driver."""
    t = got.groupBy(*key).count().toArrow().to_pydict()
    keys = t[key[0]] if len(key) == 1 else list(zip(*(t[k] for k in key)))
    return dict(zip(keys, t["count"]))


def below(kept: DataFrame, block: dict, sample: np.ndarray, order: np.ndarray, tops: list[list[int]], rows: int, keep: int, least: int) -> DataFrame | None:
    """anchor_id, bar, other_id, score: of each window [least % of bar, bar] the first ``keep`` rows of other labels."""
    guess, out = Estimate(sample, block["q"]), None
    live = np.asarray([i for i, t in enumerate(tops) if t], np.int64)
    most = max((len(t) for t in tops), default=0)
    bars = np.full((len(tops), max(1, most)), -1, np.int64)
    for i in live.tolist():
        bars[i, :len(tops[i])] = tops[i]
    lowest = np.asarray([min(t) if t else 0 for t in tops], np.int64)
    floor = -(-least * lowest // 100)
    others = np.maximum(1, rows - block["same"])
    start, wanted = guess.share(lowest.astype(np.float64)), 2.0 * keep
    while len(live):
        share = start + wanted / others
        t = np.where(share < 0.5, np.floor(guess.bar(np.minimum(share, 0.5))), floor)
        t = np.maximum(floor, np.minimum(lowest, t)).astype(np.int64)
        asked = Anchors(block["id"][live], block["label"][live], block["q"][live], t[live].astype(np.float64), order, bars[live], keep, least)
        got = written(found(kept, asked), "negatives")
        out = got if out is None else out.unionByName(got)
        n = counts(got, ["anchor_id", "bar"])
        live = np.asarray([i for i in live.tolist()
                           if any(n.get((int(block["id"][i]), b), 0) < keep and 100 * int(t[i]) > least * b and t[i] > floor[i] for b in tops[i])], np.int64)
        wanted *= LOWERING
    return out


def hard_negatives(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = 100, n_positives: int = 5,
                   n_negatives: int = 5, least: int = 80, at_once: int = ANCHORS_AT_ONCE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by ``every``. Components are floor(256 x), held within 2**20, and scores
    integer inner products; a shorter vector counts as ending in zeros. Where an id is divisible by 7 the label becomes
    (label + 1) % 10. Rows with a null id, label or vector, or with null or non-finite components, take no part; of
    several rows under one id the one with the least label, then vector, counts. Ties go to the smaller id. A positive
    with a negative score has no window and gives no row, nor does an anchor alone with its label. Other columns are ignored; an
    empty table gives no rows. Anchors go through the rows in passes of about ``at_once``, whose vectors are broadcast;
    rows aren't shuffled for it. No pair at or above a threshold is skipped.
    """
    spark = rows.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    kept = written(prepared(rows, vec_id, vector, label), "labelled-vectors")
    total, width = kept.agg(F.count("*"), F.max(F.size("q"))).first()
    if not total or not width:
        return spark.createDataFrame([], schema)
    long_q = F.col("q").cast("array<long>").alias("q")
    sample = padded(kept.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select(long_q).toArrow()["q"].combine_chunks(), width)
    asked = kept.where(F.col("vec_id") % every == 0)
    n = asked.count()
    passes = max(1, -(-n // at_once))
    same = kept.groupBy("label").agg(F.count("*").alias("same"))
    asked = written(asked.join(same, "label").withColumn("_pass", F.pmod(F.xxhash64("vec_id"), F.lit(passes))), "anchors")
    order = np.argsort((sample.astype(np.float64) ** 2).sum(axis=0), kind="stable")      # small dimensions first: more are left out
    plus, minus = None, None
    for i in range(passes if n else 0):
        got = asked.where(F.col("_pass") == i).select("vec_id", "label", "same", long_q).toArrow()
        if not len(got):
            continue
        block = {"id": got["vec_id"].to_numpy(), "label": got["label"].to_numpy(), "same": got["same"].to_numpy(), "q": padded(got["q"].combine_chunks(), width)}
        need = np.minimum(n_positives, block["same"] - 1)
        near = positives(kept, block, sample, order, need, n_positives)
        if near is None:
            continue
        first = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "other_id")
        near = near.select("anchor_id", "other_id", "score").distinct().withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= n_positives)
        near = written(near.where("score >= 0").select("anchor_id", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
        tops: dict[int, set[int]] = {}
        for a, s in near.select("anchor_id", "positive_score").distinct().collect():     # at most n_positives for each anchor of the pass
            tops.setdefault(a, set()).add(s)
        far = below(kept, block, sample, order, [sorted(tops.get(int(a), ())) for a in block["id"]], total, n_negatives, least)
        if far is not None:
            plus = near if plus is None else plus.unionByName(near)
            minus = far if minus is None else minus.unionByName(far)
    if minus is None:
        return spark.createDataFrame([], schema)
    ranked = minus.distinct().withColumn("rank", F.row_number().over(Window.partitionBy("anchor_id", "bar").orderBy(F.desc("score"), "other_id")))
    ranked = ranked.where(F.col("rank") <= n_negatives)
    out = plus.join(ranked.withColumnRenamed("bar", "positive_score"), ["anchor_id", "positive_score"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score",
                      F.col("score").alias("negative_score"))
