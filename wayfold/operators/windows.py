"""Per-track windows that stay bounded however long one track is.

A plain ``Window.partitionBy("flight_id")`` sorts a whole track in one task. If one
track owns a third of the table, that task never ends. Here a track is cut into
slices of fixed time width. Points are unique per (flight, second), so a slice has a
fixed bound. Rows look inside their slice first; only what crosses a slice border
comes from a small frame with one row per slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold import config as C
from wayfold.storage import shared_dir

SLICE = "_slice"
GATHERED = 1 << 15      # values of one key that a task may hold in arrays


def with_slice(df: DataFrame, ts: str = "ts", width: int = C.SLICE_S) -> DataFrame:
    return df.withColumn(SLICE, F.floor(F.col(ts) / width))


def with_neighbours(df: DataFrame, prev: dict[str, str | Column] | None = None,
                    nxt: dict[str, str | Column] | None = None,
                    prev2: dict[str, str | Column] | None = None,
                    key: str = "flight_id", ts: str = "ts", width: int = C.SLICE_S) -> DataFrame:
    """Add columns of the previous / next / second previous point of the same track.

    Each argument maps new column names to columns of that neighbour. The big shuffle
    is by (key, slice); border values come from one row per slice, and a slice row is
    the only thing that is ever ordered per whole track.
    """
    prev, nxt, prev2 = dict(prev or {}), dict(nxt or {}), dict(prev2 or {})
    pack = lambda m: F.struct(*[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in m.items()])
    w = Window.partitionBy(key, SLICE).orderBy(ts)
    wk = Window.partitionBy(key).orderBy(SLICE)
    out = with_slice(df, ts, width)
    local, ends, carry, cols, drop = {}, [], [], {}, [SLICE, "_k", "_s"]
    if prev:
        local["_p"] = F.lag(pack(prev)).over(w)
        ends.append(F.max_by(pack(prev), ts).alias("_last"))
        carry.append(F.lag("_last").over(wk).alias("_before"))
        drop += ["_p", "_before"]
        src = F.coalesce(F.col("_p"), F.col("_before"))
        cols.update({n: src[n] for n in prev})
    if nxt:
        local["_n"] = F.lead(pack(nxt)).over(w)
        ends.append(F.min_by(pack(nxt), ts).alias("_first"))
        carry.append(F.lead("_first").over(wk).alias("_after"))
        drop += ["_n", "_after"]
        src = F.coalesce(F.col("_n"), F.col("_after"))
        cols.update({n: src[n] for n in nxt})
    if prev2:
        local["_p1"] = F.lag(pack(prev2)).over(w)
        local["_p2"] = F.lag(pack(prev2), 2).over(w)
        drop += ["_p1", "_p2", "_b1", "_b2"]
    joined = out.withColumns(local)
    if prev2:
        # The slice's last point and the one before it, where the slice has one.
        ends += [F.max_by(pack(prev2), ts).alias("_l1"), F.max_by("_p1", ts).alias("_l2")]
    border = (joined if prev2 else out).groupBy(key, SLICE).agg(*ends)
    if prev2:
        border = border.withColumn("_l2", F.coalesce("_l2", F.lag("_l1").over(wk)))
        carry += [F.lag("_l1").over(wk).alias("_b1"), F.lag("_l2").over(wk).alias("_b2")]
        far = F.coalesce(F.col("_p2"), F.when(F.col("_p1").isNotNull(), F.col("_b1")).otherwise(F.col("_b2")))
        cols.update({n: far[n] for n in prev2})
    border = border.select(F.col(key).alias("_k"), F.col(SLICE).alias("_s"), *carry)
    joined = joined.join(border, (F.col(key) == F.col("_k")) & (F.col(SLICE) == F.col("_s")), "left")
    return joined.withColumns(cols).drop(*drop)


def sliced_row_number(df: DataFrame, key: str, slice_col: str, order: list[str], name: str) -> DataFrame:
    """1-based row number per key: local number plus the count of all earlier slices."""
    w = Window.partitionBy(key, slice_col).orderBy(*order)
    wk = Window.partitionBy(key).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    base = (df.groupBy(key, slice_col).agg(F.count("*").alias("_n"))
            .select(F.col(key).alias("_k"), F.col(slice_col).alias("_s"),
                    F.coalesce(F.sum("_n").over(wk), F.lit(0)).alias("_base")))
    return (df.withColumn("_local", F.row_number().over(w))
            .join(base, (F.col(key) == F.col("_k")) & (F.col(slice_col) == F.col("_s")))
            .withColumn(name, F.col("_base") + F.col("_local"))
            .drop("_k", "_s", "_base", "_local", slice_col))


def running_sum(df: DataFrame, values: dict[str, Column], key: str = "flight_id",
                ts: str = "ts", width: int = C.SLICE_S) -> DataFrame:
    """Cumulative sums along a track, inclusive of the current row."""
    out = with_slice(df, ts, width).withColumns({f"_v_{n}": c for n, c in values.items()})
    w = Window.partitionBy(key, SLICE).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    wk = Window.partitionBy(key).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    base = (out.groupBy(key, SLICE).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
            .select(F.col(key).alias("_k"), F.col(SLICE).alias("_s"),
                    *[F.coalesce(F.sum(f"_t_{n}").over(wk), F.lit(0)).alias(f"_b_{n}") for n in values]))
    res = (out.withColumns({f"_l_{n}": F.sum(f"_v_{n}").over(w) for n in values})
           .join(base, (F.col(key) == F.col("_k")) & (F.col(SLICE) == F.col("_s")), "left")
           .withColumns({n: F.col(f"_b_{n}") + F.coalesce(F.col(f"_l_{n}"), F.lit(0)) for n in values}))
    return res.drop(SLICE, "_k", "_s", *[f"_{p}_{n}" for n in values for p in "vbl"])


def with_halo(df: DataFrame, before: int, after: int, key: str = "flight_id",
              ts: str = "ts", width: int = C.SLICE_S) -> DataFrame:
    """Copy each point to every slice that sees it within the given seconds.

    A slice then holds all points from ``before`` seconds before its start to
    ``after`` seconds past its end; ``_core`` marks the points it owns. Range
    windows up to those spans are exact inside (key, _slice).
    """
    if max(before, after) > width:
        raise ValueError("halo wider than a slice")
    t, own = F.col(ts), F.floor(F.col(ts) / width)
    # Slices [lo, hi] see the point: those whose widened interval covers it.
    lo = F.floor((t - after) / width)
    hi = F.floor((t + before) / width)
    return (df.withColumn(SLICE, F.explode(F.sequence(lo, hi)))
            .withColumn("_core", F.col(SLICE) == own))


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the least by ``order``; aggregates map-side instead of sorting."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def shifted_rows(df: DataFrame, offset: int, cols: dict[str, str], key: str = "flight_id", ts: str = "ts",
                 numbered: bool = False) -> DataFrame:
    """Columns of the row ``offset`` places back, by an equi join on (key, row number)."""
    n = df if numbered else sliced_row_number(with_slice(df, ts), key, SLICE, [ts], "_rn")
    back = n.select(F.col(key).alias("_k"), (F.col("_rn") + offset).alias("_r"),
                    *[F.col(v).alias(k) for k, v in cols.items()])
    return n.join(back, (F.col(key) == F.col("_k")) & (F.col("_rn") == F.col("_r")), "left").drop("_k", "_r")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder the cluster names."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def exact_quantiles(df: DataFrame, key: str, cols: list[str], probs: list[float], buckets: int = 256, gathered: int = GATHERED) -> DataFrame:
    """Linear-interpolated quantiles per key as columns {col}_q{NN}, exact, without one task per key.

    A key with at most ``gathered`` values, all columns together, is sorted as one array for each column. Values of larger
    keys are spread over buckets. ``df`` is read twice, with larger keys about five times.
    """
    stat = cut(df.groupBy(key).agg(*[f(c).alias(f"{p}_{c}") for c in cols for p, f in (("lo", F.min), ("hi", F.max), ("n", F.count))]))
    large = stat.where(sum(F.col(f"n_{c}") for c in cols) > gathered).select(key)
    if not large.limit(1).count():
        return _gathered_quantiles(df, key, cols, probs)
    small = _gathered_quantiles(df.join(large, key, "left_anti"), key, cols, probs)
    return small.unionByName(_bucketed_quantiles(df.join(large, key, "left_semi"), stat.join(large, key, "left_semi"), key, cols, probs, buckets))


def _gathered_quantiles(df: DataFrame, key: str, cols: list[str], probs: list[float]) -> DataFrame:
    """``exact_quantiles`` of keys with few values."""
    some = df.where(F.col(key).isNotNull() & F.coalesce(*[F.col(c).cast("double") for c in cols]).isNotNull())
    held = some.groupBy(key).agg(*[F.sort_array(F.collect_list(F.col(c).cast("double"))).alias(c) for c in cols])
    out = []
    for c in cols:
        for p in probs:
            k = (F.size(c) - 1) * p
            a, z = F.get(c, F.floor(k).cast("int")), F.get(c, F.ceil(k).cast("int"))
            out.append((a + (z - a) * (k - F.floor(k))).alias(f"{c}_q{round(p * 100):02d}"))
    return held.select(key, *out)


def _bucketed_quantiles(df: DataFrame, stat: DataFrame, key: str, cols: list[str], probs: list[float], buckets: int) -> DataFrame:
    """``exact_quantiles`` of keys of any size; ``stat`` has the least and greatest value and the number of each column.

    Values are counted first, then cut into equal-width buckets between the key's least
    and greatest value. Ranks are the count of earlier buckets plus a running count
    inside the bucket, so only one bucket of one key is ever ordered in one task.
    """
    per = stat.select(key, F.explode(F.array(*[F.struct(F.lit(i).alias("s"), F.col(f"lo_{c}").cast("double").alias("lo"),
                                                        F.col(f"hi_{c}").cast("double").alias("hi"), F.col(f"n_{c}").alias("n"))
                                               for i, c in enumerate(cols)])).alias("x")).select(key, "x.*")
    long = df.select(key, F.explode(F.array(*[F.struct(F.lit(i).alias("s"), F.col(c).cast("double").alias("v"))
                                              for i, c in enumerate(cols)])).alias("x")).select(key, "x.*").where("v is not null")
    share = (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * buckets
    b = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(buckets - 1), F.floor(share))).otherwise(0).cast("int")
    j = cut(long.groupBy(key, "s", "v").agg(F.count("*").alias("c")).join(per, [key, "s"]).withColumn("b", b))
    before = F.sum("t").over(Window.partitionBy(key, "s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    base = j.groupBy(key, "s", "b").agg(F.sum("c").alias("t")).select(key, "s", "b", F.coalesce(before, F.lit(0)).alias("base"))
    run = F.sum("c").over(Window.partitionBy(key, "s", "b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    r = j.withColumn("run", run).join(base, [key, "s", "b"])
    end = F.col("base") + F.col("run")
    at = lambda k: (end - F.col("c") <= k) & (k < end)
    aggs, out = [], []
    for i, c in enumerate(cols):
        for p in probs:
            k, name = (F.col("n") - 1) * p, f"{c}_q{round(p * 100):02d}"
            mine = F.col("s") == i
            aggs += [F.max(F.when(mine & at(F.floor(k)), F.col("v"))).alias(f"a_{name}"), F.max(F.when(mine & at(F.ceil(k)), F.col("v"))).alias(f"z_{name}"),
                     F.max(F.when(mine, k - F.floor(k))).alias(f"f_{name}")]
            out.append((F.col(f"a_{name}") + (F.col(f"z_{name}") - F.col(f"a_{name}")) * F.col(f"f_{name}")).alias(name))
    return r.groupBy(key).agg(*aggs).select(key, *out)
