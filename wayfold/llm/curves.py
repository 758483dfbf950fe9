"""Approximate nearest neighbours along shifted space-filling curves.

Each curve is a Hilbert ordering of a random projection of the vectors with a random shift. Along
every curve a query looks at the rows within a window of places before and after its own; the
windows of all curves are merged and ranked by the exact inner product. The window is fitted: a
bounded set of pilot queries is searched exactly, and the window reaches as many of their
neighbours as asked for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.ranks import numbered
from wayfold.storage import written

CURVES = 16
DIMS = 4
BITS = 15
SAMPLE = 20_000
PILOTS = 128
BLOCK = 4096
SALTS = 8


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points (rows, dims), by the transposed form: undo excess turns, then Gray code."""
    x = cells.astype(np.uint64).T.copy()
    dims, one = len(x), np.uint64(1)
    q = np.uint64(1 << (bits - 1))
    while q > one:
        p = q - one
        for i in range(dims):
            on = (x[i] & q) != 0
            swap = np.where(on, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0]) ^ swap
            x[i] ^= swap
        q >>= one
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = np.uint64(1 << (bits - 1))
    while q > one:
        turn ^= np.where((x[-1] & q) != 0, q - one, np.uint64(0))
        q >>= one
    x ^= turn
    key = np.zeros_like(x[0])
    for b in reversed(range(bits)):
        for i in range(dims):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key


class Orderings:
    """Projections and cell bounds of all curves, fitted on a bounded sample of vectors."""

    def __init__(self, sample: np.ndarray, curves: int, dims: int, bits: int, seed: int):
        rng = np.random.default_rng(seed)
        width = sample.shape[1]
        self.dims, self.bits = min(dims, max(1, width)), bits
        turns = []
        while sum(t.shape[1] for t in turns) < curves * self.dims:
            turns.append(np.linalg.qr(rng.normal(size=(width, width)))[0])
        self.axes = np.concatenate(turns, axis=1)[:, :curves * self.dims]
        self.shift = rng.random(curves * self.dims)
        self.steps = np.quantile(sample @ self.axes, np.linspace(0, 1, 1025)[1:-1], axis=0)

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """(rows, curves) signed keys."""
        flat = vectors @ self.axes
        top = (1 << self.bits) - 1
        cells = np.empty(flat.shape, np.int64)
        for j in range(flat.shape[1]):
            steps = self.steps[:, j]
            i = np.searchsorted(steps, flat[:, j])
            lo, hi = steps[np.maximum(i - 1, 0)], steps[np.minimum(i, len(steps) - 1)]
            inside = np.clip((flat[:, j] - lo) / np.where(hi > lo, hi - lo, 1), 0, 1)
            share = (i + inside) / (len(steps) + 1)
            cells[:, j] = np.clip((share + self.shift[j]) / 2 * top, 0, top)
        return np.stack([hilbert(cells[:, a:a + self.dims], self.bits) for a in range(0, flat.shape[1], self.dims)], axis=1).view(np.int64)


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def top(scores: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores, ties to the smaller name."""
    at = np.arange(len(scores))
    if len(scores) > k:
        least = np.partition(scores, -k)[-k]
        at = np.flatnonzero(scores >= least - 1e-12 * max(1.0, abs(least)))
    return at[np.lexsort((names[at], -scores[at]))][:k]


def usable(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v): one vector for each id, with finite components that are not all zero, of the commonest length."""
    v = F.col(vector).cast("array<double>")
    good = F.size(v) > 0
    good &= F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    kept = rows.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & good)
    size = kept.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return kept.where(F.size("v") == (size.n if size else 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


def search(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = 20, recall: float = 0.96, curves: int = CURVES,
           seed: int = 9, sample: int = SAMPLE, pilots: int = PILOTS) -> DataFrame:
    """query_id, rank, vec_id, score: the k greatest inner products found for every row whose id is divisible by ``every``.

    Equal vectors are searched once, by their least id; of each vector its k + 1 least ids can be in an answer. Null
    ids, null vectors, zero vectors, vectors with null or non-finite components or of another length than most take no
    part. Of several vectors under one id the least counts. Ties go to the smaller id. Other columns are ignored. An
    empty table gives no rows. ``sample`` vectors fit the orderings and ``pilots`` queries the window; every row is
    indexed and every query answered.
    """
    spark = rows.sparkSession
    all_ = written(usable(rows, vec_id, vector), "vectors")
    order = Window.partitionBy("v").orderBy("vec_id")
    few = all_.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1)
    ids = few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asked = all_.where(F.col("vec_id") % every == 0)
    wanted = asked.select("v").distinct().withColumn("query", F.lit(True))
    reps = written(ids.join(wanted, "v", "left").select(F.col("ids")[0].alias("rep"), "v", "ids", F.coalesce("query", F.lit(False)).alias("query")), "distinct")

    fitted = reps.select("v").orderBy(F.xxhash64("v"), "v").limit(sample).toArrow()["v"].combine_chunks()
    if not len(fitted):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    table = spark.sparkContext.broadcast(Orderings(matrix(fitted), curves, DIMS, BITS, seed))

    def place(batches):
        for batch in batches:
            keys = table.value.keys(matrix(batch.column("v")))
            for c in range(keys.shape[1]):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), c, np.int32)), pa.array(keys[:, c]), *(batch.column(x) for x in ("rep", "v", "query"))],
                                                 ["curve", "key", "rep", "v", "query"])

    placed = reps.select("rep", "v", "query").mapInArrow(place, "curve int, key long, rep long, v array<double>, query boolean")
    ranked = written(numbered(placed, ["curve", "key", "rep"], "at").drop("key"), "curves")
    window = fitted_window(reps, ranked, k, recall, pilots)

    near = answers(ranked, window, k)
    own = reps.where("query").select(F.col("rep").alias("q"), F.col("rep").alias("c"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x).alias("score"))
    best = near.unionByName(own).groupBy("q", "c").agg(F.max("score").alias("score"))
    best = best.withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "c"))).where(F.col("_r") <= k + 1).drop("_r")
    wide = best.join(reps.select(F.col("rep").alias("c"), "ids"), "c").select("q", "score", F.explode("ids").alias("vec_id"))
    wide = wide.withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("_r") <= k + 1)
    lists = wide.groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("found"))

    many = reps.where(F.size("ids") > 1).select("v", F.col("rep").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int")
    queries = asked.withColumn("_salt", salt).join(many, ["v", "_salt"], "left").select(F.col("vec_id").alias("query_id"), F.coalesce("q", "vec_id").alias("q"), "_salt")
    lists = lists.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = queries.join(lists, ["q", "_salt"]).withColumn("found", F.filter("found", lambda x: x["vec_id"] != F.col("query_id")))
    out = out.select("query_id", F.posexplode(F.slice("found", 1, k)).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))


def fitted_window(reps: DataFrame, ranked: DataFrame, k: int, recall: float, pilots: int) -> int:
    """The window that reaches a share ``recall`` of the exact neighbours of the pilot queries."""
    chosen = reps.where("query").select("rep", "v").orderBy(F.xxhash64("rep"), "rep").limit(pilots).toArrow()
    if not len(chosen):
        return 0
    held = reps.sparkSession.sparkContext.broadcast((chosen["rep"].to_numpy(), matrix(chosen["v"].combine_chunks())))

    def exact(batches):
        names, vectors = held.value
        for batch in batches:
            reps_, scores = batch.column("rep").to_numpy(), vectors @ matrix(batch.column("v")).T
            for q, s in zip(names, scores):
                s[reps_ == q] = -np.inf
                best = top(s, reps_, k)
                best = best[np.isfinite(s[best])]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), q)), pa.array(reps_[best]), pa.array(s[best])], ["q", "c", "score"])

    found = reps.select("rep", "v").mapInArrow(exact, "q long, c long, score double")
    found = found.withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "c"))).where(F.col("_r") <= k)
    pairs = found.select("q", "c").collect()
    names = sorted({x for r in pairs for x in r})
    if not pairs:
        return 0
    at: dict[int, np.ndarray] = {}
    for r in ranked.where(F.col("rep").isin(names)).groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("curve", "at"))).alias("x")).collect():
        at[r.rep] = np.asarray([y.at for y in r.x])
    off = np.sort([int(np.abs(at[r.q] - at[r.c]).min()) for r in pairs])
    return int(off[min(len(off) - 1, int(np.ceil(recall * len(off))))])


def answers(ranked: DataFrame, window: int, k: int, block: int = BLOCK) -> DataFrame:
    """(q, c, score): for each curve and block, the k best of the block within each query's window."""
    here = ranked.withColumn("block", F.floor(F.col("at") / block)).withColumn("ask", F.lit(False))
    span = F.sequence(F.floor((F.col("at") - window) / block), F.floor((F.col("at") + window) / block))
    asks = ranked.where("query").withColumn("block", F.explode(span)).withColumn("ask", F.lit(True))
    both = here.unionByName(asks).select("curve", "block", "at", "rep", "v", "ask")

    def best(table):
        ask = table["ask"].to_numpy()
        at, rep = table["at"].to_numpy(), table["rep"].to_numpy()
        x = matrix(table["v"].combine_chunks())
        curve = table["curve"].to_numpy()
        qs, cs, ss = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        row, col = np.flatnonzero(ask), np.flatnonzero(~ask)
        for a in range(0, len(row), 256) if len(col) else ():
            part = row[a:a + 256]
            s = x[part] @ x[col].T
            s[(np.abs(at[part][:, None] - at[col][None, :]) > window) | (rep[part][:, None] == rep[col][None, :]) | (curve[part][:, None] != curve[col][None, :])] = -np.inf
            for i, r in enumerate(part):
                j = col[top(s[i], rep[col], k)]
                j = j[(np.abs(at[j] - at[r]) <= window) & (rep[j] != rep[r]) & (curve[j] == curve[r])]
                qs.append(np.full(len(j), rep[r]))
                cs.append(rep[j])
                ss.append((x[j] * x[r]).sum(axis=1))
        return pa.table({"q": np.concatenate(qs), "c": np.concatenate(cs), "score": np.concatenate(ss)})

    return both.groupBy("curve", "block").applyInArrow(best, "q long, c long, score double")
