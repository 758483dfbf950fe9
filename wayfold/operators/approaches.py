"""The closest approach of every two flights.

Points meet in groups of (time slice, cell) as in ``sweep``, but slices are wide against the reach in time, so that two flights meet
in few groups. Flights, not points, of a crowded group are dealt over shares, and each two shares are a task's part: it holds a
bounded number of points, as a flight has one for each second at most. In a part a flight's points look at what is
near in time through the products of unit vectors; only the pairs of points that could be the closest of two flights are then
measured. One row for each two flights leaves a part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from wayfold import config as C
from wayfold.operators.hotkeys import MOST_TASKS, PARTS_SETTING
from wayfold.operators.sweep import _ranks, _width
from wayfold.storage import written

c = F.col
HOT = 40_000            # points of a group above which its flights are dealt over shares
PAIRS = 1 << 20         # pairs of points measured at once
SLOTS = 24              # width of a slice in reaches of time
CLOSE = 1e-14           # products of unit vectors this near one another may belong to equal distances
KEYS = ["_slice", "_y", "_x", "_mine", "_other"]


def _dealt(points: DataFrame, nm: float, seconds: int, hot: int) -> tuple[DataFrame, DataFrame, int]:
    """Left and right rows with the keys of their parts, and the number of parts.

    Shares follow the order of one hash in every group, and a left row meets the shares from its own upwards: of two flights,
    the one with the lesser hash meets the other wherever its points lie.
    """
    reach, width = nm / 59.5, max(60, SLOTS * seconds)
    cell = 3 * reach
    a = points.withColumns({"_slice": F.floor(c("ts") / width), "_y": F.floor(c("lat") / cell)})
    a = a.withColumn("_x", F.floor(c("lon") / _width(c("_y"), cell)))
    far = F.lit(1.001 * reach) / F.cos(F.radians(F.least(F.abs("lat") + reach, F.lit(88.0))))
    b = points.withColumn("_slice", F.explode(F.sequence(F.floor((c("ts") - seconds) / width), F.floor((c("ts") + seconds) / width))))
    b = b.withColumn("_y", F.explode(F.sequence(F.floor((c("lat") - reach) / cell), F.floor((c("lat") + reach) / cell))))
    w = _width(c("_y"), cell)
    b = b.withColumn("_x", F.explode(F.sequence(F.floor((c("lon") - far) / w), F.floor((c("lon") + far) / w))))
    on = ["_slice", "_y", "_x"]
    sizes = written(b.groupBy(*on).agg(F.count("*").alias("_n")).join(a.select(*on).distinct(), on, "left_semi")
                    .select(*on, F.ceil(c("_n") / hot).cast("int").alias("_s")), "shares")
    parts = sizes.agg(F.sum(c("_s").cast("double") * (c("_s") + 1) / 2)).first()[0] or 0
    share = F.floor(F.pmod(F.xxhash64("flight_id"), F.lit(1 << 20)) * c("_s") / (1 << 20)).cast("int")
    a = a.join(sizes, on).withColumn("_mine", share).withColumn("_other", F.explode(F.sequence(c("_mine"), c("_s") - 1))).drop("_s")
    b = b.join(sizes, on).withColumn("_other", share).withColumn("_mine", F.explode(F.sequence(F.lit(0), c("_other")))).drop("_s")
    return a, b, int(parts)


def _measured(lat1, lon1, lat2, lon2) -> np.ndarray:
    """``geo.haversine`` in its own order of operations, with the C library's functions."""
    rad = np.pi / 180
    a1, a2, b1, b2 = lat1 * rad, lat2 * rad, lon1 * rad, lon2 * rad
    of = lambda f, *x: f(*[pa.array(v) for v in x]).to_numpy(zero_copy_only=False)
    y, x = of(pc.sin, (a2 - a1) / 2), of(pc.sin, (b2 - b1) / 2)
    h = y * y + of(pc.cos, a1) * of(pc.cos, a2) * x * x
    return 2 * C.EARTH_NM * of(pc.atan2, np.sqrt(h), np.sqrt(np.maximum(1 - h, 0)))


def closest_approaches(points: DataFrame, nm: float, seconds: int, differ: str) -> DataFrame:
    """The closest points, at most nm and seconds apart, of every two flights that differ in ``differ``, in each of their parts.

    ``points``: flight_id, ts, lat, lon and ``differ``. Result: a_ and b_ columns of these, ``nm``; a is the lesser flight id, and
    the least by (nm, a_ts, b_ts) is taken. Callers take the least over parts. Rows with nulls or positions that are no numbers pair with nothing.
    Cells don't wrap at the 180th meridian.
    """
    return _closest(points, nm, seconds, differ, HOT)


def _closest(points: DataFrame, nm: float, seconds: int, differ: str, hot: int) -> DataFrame:
    cols = ["flight_id", "ts", "lat", "lon", differ]
    usable = " and ".join([*(f"`{x}` is not null" for x in cols), *(f"abs({x}) < double('infinity')" for x in ("lat", "lon"))])
    a, b, parts = _dealt(points.select(*cols).where(usable), nm, seconds, hot)
    both = a.select(*KEYS, *cols, F.lit(False).alias("_right")).unionByName(b.select(*KEYS, *cols, F.lit(True).alias("_right")))
    tasks = max(int(points.sparkSession.conf.get(PARTS_SETTING)), min(MOST_TASKS, parts))
    both = both.repartition(tasks, *KEYS).sortWithinPartitions(*KEYS, "ts")
    kinds = points.schema
    out = StructType([*(StructField(f"{s}_{x}", kinds[x].dataType) for s in "ab" for x in cols), StructField("nm", DoubleType())])
    least_dot = np.cos(nm / C.EARTH_NM) - 1e-12

    def closest_of(table: pa.Table):
        side = table["_right"].to_numpy()
        flight, kind = (_ranks(table[x].combine_chunks().cast(pa.string())) for x in ("flight_id", differ))
        ts, lat, lon = (table[x].to_numpy() for x in ("ts", "lat", "lon"))
        y, x = np.radians(lat), np.radians(lon)
        at = np.column_stack([np.cos(y) * np.cos(x), np.cos(y) * np.sin(x), np.sin(y)])
        ia, ib = np.flatnonzero(~side), np.flatnonzero(side)
        if not len(ia) or not len(ib):
            return
        ia = ia[np.argsort(flight[ia], kind="stable")]          # by flight, in time order
        rt, right = ts[ib], np.ascontiguousarray(at[ib])
        order = np.argsort(flight[ib], kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], np.diff(flight[ib][order]) != 0]))
        heads = ib[order[starts]]
        number = np.empty(len(ib), np.int64)                    # of the flight of a right row
        number[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(ib))))
        lo, hi = np.searchsorted(rt, ts[ia] - seconds, "left"), np.searchsorted(rt, ts[ia] + seconds, "right")
        ends = np.append(np.flatnonzero(np.diff(flight[ia])) + 1, len(ia))
        top, room = np.empty(len(ib)), np.empty(len(ib))
        found, n = [], 0

        def picked():
            p, q = (np.concatenate(v) for v in zip(*found))
            swap = flight[p] > flight[q]
            p, q = np.where(swap, q, p), np.where(swap, p, q)
            d = _measured(lat[p], lon[p], lat[q], lon[q])
            on = d <= nm
            p, q, d = p[on], q[on], d[on]
            o = np.lexsort((ts[q], ts[p], d, flight[q], flight[p]))
            f, g = flight[p[o]], flight[q[o]]
            o = o[np.concatenate([[True], (f[1:] != f[:-1]) | (g[1:] != g[:-1])])] if len(o) else o
            if len(o):
                ta, tb = table.select(cols).take(pa.array(p[o])), table.select(cols).take(pa.array(q[o]))
                yield from pa.table([*ta.columns, *tb.columns, pa.array(d[o])], out.names).to_batches()

        start = 0
        for end in ends:
            own = slice(start, end)
            start = end
            top.fill(-2.0)
            for k in range(own.start, own.stop):
                l, h = lo[k], hi[k]
                if h > l:
                    dots = np.dot(right[l:h], at[ia[k]], out=room[:h - l])
                    np.maximum(top[l:h], dots, out=top[l:h])
            best = np.maximum.reduceat(top[order], starts)
            first = ia[own.start]
            usable = (best >= least_dot) & (flight[heads] != flight[first]) & (kind[heads] != kind[first])
            if not usable.any():
                continue
            line = np.where(usable, best - CLOSE, 9.0)[number]
            near = np.flatnonzero(top >= line)                  # right rows that may be the closest of their flight
            mine = ia[own]
            step = max(1, (4 * PAIRS) // len(mine))
            for k in range(0, len(near), step):
                q = near[k:k + step]
                p, w = np.nonzero((at[mine] @ right[q].T >= line[q] - CLOSE) & (np.abs(ts[mine][:, None] - rt[q]) <= seconds))
                found.append((mine[p], ib[q[w]]))
                n += len(p)
            if n >= PAIRS:
                yield from picked()
                found, n = [], 0
        if n:
            yield from picked()

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            for k in KEYS:
                v = batch.column(k).to_numpy()
                new[1:] |= v[1:] != v[:-1]
                if held:
                    new[0] |= v[0] != held[-1].column(k)[-1].as_py()
            at = 0
            for border in np.flatnonzero(new):
                if border > at:
                    held.append(batch.slice(at, border - at))
                if held:
                    yield from closest_of(pa.Table.from_batches(held))
                held, at = [], int(border)
            held.append(batch.slice(at))
        if held:
            yield from closest_of(pa.Table.from_batches(held))

    return both.mapInArrow(run, out)
