"""Equi joins in which one key may own a large share of the left rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.operators.windows import SLICE, cut

c = F.col
LEAST = 20_000
MOST_TASKS = 20_000
PARTS_SETTING = "spark.sql.shuffle.partitions"


def hot_keys(df: DataFrame, on: list[str], least: int = LEAST) -> DataFrame | None:
    """(key, _parts) of keys with more rows than a quarter of an even partition, at least ``least``; None without any.

    At most four keys for each shuffle partition can pass that line, however large the table is.
    """
    return _hot_of(cut(df.groupBy(*on).agg(F.count("*").alias("_rows"))), on, least)


def _hot_of(sizes: DataFrame, on: list[str], least: int) -> DataFrame | None:
    partitions = int(sizes.sparkSession.conf.get(PARTS_SETTING))
    total, most = sizes.agg(F.sum("_rows"), F.max("_rows")).first()
    line = max(least, (total or 0) // (4 * partitions))
    if most is None or most <= line:
        return None
    return cut(sizes.where(c("_rows") > line).select(*on, F.ceil(c("_rows") / line).cast("int").alias("_parts")))


def join_dealt(left: DataFrame, right: DataFrame, on: list[str], hot: DataFrame | None) -> DataFrame:
    """Inner join on ``on``; left rows of ``hot`` keys are dealt over their parts, right rows are copied to each part.

    Which part takes a row follows from the row alone, so a lost task gives the same rows again. Rows with a null key
    find nothing, as in any inner join.
    """
    if hot is None:
        return left.join(right, on)
    hot = F.broadcast(hot)      # at most four rows for each shuffle partition
    rest = [x for x in left.columns if x not in on]
    part = F.pmod(F.xxhash64(*(rest or on)), F.coalesce("_parts", F.lit(1))).cast("int")
    a = left.join(hot, on, "left").withColumn("_part", part).drop("_parts")
    b = (right.join(hot, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
         .drop("_parts"))
    return a.join(b, [*on, "_part"]).drop("_part")


def join_hot(left: DataFrame, right: DataFrame, on: list[str], least: int = LEAST) -> DataFrame:
    """``join_dealt`` by the hot keys of ``left``, which is read twice."""
    return join_dealt(left, right, on, hot_keys(left, on, least))


def join_balanced(left: DataFrame, right: DataFrame, on: list[str], part_pairs: int = 1 << 24, task_pairs: int = 1 << 26) -> DataFrame:
    """Inner join on ``on`` whose pairs are to be looked at one by one: no task meets many more than ``task_pairs`` of them.

    A key with more than ``part_pairs`` pairs has its rows dealt over the parts of a grid. The number of tasks follows the number of
    pairs, not that of rows, which it can outgrow.
    """
    a, b, key, tasks = balanced_sides(left, right, on, part_pairs, task_pairs)
    return a.repartition(tasks, *key).join(b.repartition(tasks, *key), key).drop("_row", "_col")


def balanced_sides(left: DataFrame, right: DataFrame, on: list[str], part_pairs: int, task_pairs: int) -> tuple[DataFrame, DataFrame, list[str], int]:
    """The sides of ``join_balanced`` with copies, their key, and the number of tasks.

    Left rows of a key are dealt over the lines of its grid and copied to each column, right rows over its columns and copied to each
    line. Copies so grow with the root of the parts, not with the parts.
    """
    count = lambda df, name: df.groupBy(*on).agg(F.count("*").alias(name))
    l, r = c("_l").cast("double"), c("_r").cast("double")
    parts = F.ceil(l * r / part_pairs)
    sizes = count(left, "_l").join(count(right, "_r"), on).withColumn("_rows", F.least(l, F.ceil(F.sqrt(parts * l / r))).cast("int"))
    sizes = cut(sizes.select(*on, (l * r).alias("_w"), F.when(parts > 1, c("_rows")).otherwise(1).alias("_rows"),
                             F.when(parts > 1, F.least(r, F.ceil(parts / c("_rows")))).otherwise(1).cast("int").alias("_cols")))
    total, most = sizes.agg(F.sum("_w"), F.max(c("_rows") * c("_cols"))).first()
    tasks = max(int(sizes.sparkSession.conf.get(PARTS_SETTING)), min(MOST_TASKS, math.ceil((total or 0) / task_pairs)))
    if (most or 0) <= 1:
        return left, right, on, tasks
    hot = sizes.where("_rows > 1 or _cols > 1").select(*on, "_rows", "_cols")

    def dealt(df, mine, others, at, copies):
        rest = [x for x in df.columns if x not in on]
        n = lambda x: F.coalesce(x, F.lit(1))
        j = df.join(hot, on, "left").withColumn(at, F.pmod(F.xxhash64(*(rest or on)), n(mine)).cast("int"))
        return j.withColumn(copies, F.explode(F.sequence(F.lit(0), n(others) - 1))).drop("_rows", "_cols")

    return dealt(left, "_rows", "_cols", "_row", "_col"), dealt(right, "_cols", "_rows", "_col", "_row"), [*on, "_row", "_col"], tasks


def by_place(points: DataFrame, on: list[str], find, least: int = LEAST, sized: bool = False) -> DataFrame:
    """Inner join of points with ``find`` of their places, the distinct values of ``on``.

    What depends on ``on`` alone is so worked out once for each place, however many points are there. ``find`` takes a frame
    of ``on``, with ``sized`` also ``_rows``, the number of points there, and gives back ``on`` with further columns. ``points``
    are read twice; those of a crowded place are dealt over tasks.
    """
    sizes = cut(points.groupBy(*on).agg(F.count("*").alias("_rows")))
    return join_dealt(points, find(sizes if sized else sizes.drop("_rows")), on, _hot_of(sizes, on, least))


def spread(df: DataFrame, keys: tuple = ("flight_id", "ts")) -> DataFrame:
    """Even out rows over the session's shuffle partitions before per-row geometry that costs far more than its bytes."""
    return df.repartition(int(df.sparkSession.conf.get(PARTS_SETTING)), *keys)


def join_by_slice(points: DataFrame, per_key: DataFrame, width: int, key: str = "flight_id", ts: str = "ts",
                  slices_of: DataFrame | None = None) -> DataFrame:
    """Inner join of points with a frame of one row per key, on (key, time slice).

    Only slices, one row each, meet the keys themselves. A slice holds a bounded number of points, however many its key has.
    ``slices_of``: a cheaper frame with the same keys and times, to take the slices from.
    """
    of = F.floor(c(ts) / width).alias(SLICE)
    known = (points if slices_of is None else slices_of).select(key, of).distinct().join(per_key, key)
    return points.withColumn(SLICE, of).join(known, [key, SLICE]).drop(SLICE)


def join_windows(points: DataFrame, events: DataFrame, seconds: int, width: int, key: str = "flight_id", at: str = "center_ts",
                 ts: str = "ts") -> DataFrame:
    """Points at most ``seconds`` from an event of their own key: an event is listed in the slices that its window covers."""
    of = F.sequence(F.floor((c(at) - seconds) / width), F.floor((c(at) + seconds) / width))
    j = points.withColumn(SLICE, F.floor(c(ts) / width)).join(events.withColumn(SLICE, F.explode(of)), [key, SLICE])
    return j.where(F.abs(c(ts) - c(at)) <= seconds).drop(SLICE)
