"""Near joins in space and time as a plane sweep.

Rows meet in groups of (time slice, cell). A left row is in one group; a right row is copied only to the groups that it
reaches, about three, as slices and cells are wide against the reach. Inside a partition the groups lie one after another in time
order, and a sweep looks only at what is near in time: two binary searches over all groups of a chunk at once. What a
caller wants of the pairs (the first for each left point, the closest of each two flights) is picked there, so that pairs
themselves are never shuffled.

Points of different flights at one place and time have the same neighbours but for themselves. ``near_counts`` and ``first_near``
sweep the distinct places alone, and set the own flight apart afterwards, so that copies in place don't multiply the pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from wayfold import config as C
from wayfold.operators.hotkeys import by_place
from wayfold.storage import written

c = F.col
HOT = 20_000            # left rows of a group above which it is split
CHUNK = 131_072         # rows looked at together
PAIRS = 1 << 20         # pairs in memory at once
KEYS = ["_slice", "_y", "_x", "_salt"]
AT = ["ts", "lat", "lon", "alt"]


def _haversine(la1, lo1, la2, lo2):
    a1, a2 = np.radians(la1), np.radians(la2)
    h = np.sin((a2 - a1) / 2) ** 2 + np.cos(a1) * np.cos(a2) * np.sin(np.radians(lo2 - lo1) / 2) ** 2
    return 2 * C.EARTH_NM * np.arcsin(np.sqrt(np.minimum(h, 1)))


def _width(y: Column, cell: float) -> Column:
    """Width in degrees of longitude of the cells of a row: at least ``cell`` degrees of latitude at its poleward edge."""
    return F.lit(cell) / F.cos(F.radians(F.least((F.greatest(F.abs(y), F.abs(y + 1))) * cell, F.lit(88.0))))


def _grouped(left: DataFrame, right: DataFrame, nm: float, seconds: int, hot: int) -> tuple[DataFrame, DataFrame]:
    reach = nm / 59.5
    cell, width = 3 * reach, max(60, 4 * seconds)
    a = left.withColumns({"_slice": F.floor(c("ts") / width), "_y": F.floor(c("lat") / cell)})
    a = a.withColumn("_x", F.floor(c("lon") / _width(c("_y"), cell)))
    far = F.lit(1.001 * reach) / F.cos(F.radians(F.least(F.abs("lat") + reach, F.lit(88.0))))
    b = right.withColumn("_slice", F.explode(F.sequence(F.floor((c("ts") - seconds) / width), F.floor((c("ts") + seconds) / width))))
    b = b.withColumn("_y", F.explode(F.sequence(F.floor((c("lat") - reach) / cell), F.floor((c("lat") + reach) / cell))))
    w = _width(c("_y"), cell)
    b = b.withColumn("_x", F.explode(F.sequence(F.floor((c("lon") - far) / w), F.floor((c("lon") + far) / w))))
    size = written(a.groupBy("_slice", "_y", "_x").agg(F.count("*").alias("_n")).where(c("_n") > hot)
                   .select("_slice", "_y", "_x", F.ceil(c("_n") / hot).cast("int").alias("_s")), "hot-groups")
    n = size.count()
    if not n:
        return a.withColumn("_salt", F.lit(0)), b.withColumn("_salt", F.lit(0))
    size = F.broadcast(size) if n <= C.INLINE_DIM_ROWS else size
    on = ["_slice", "_y", "_x"]
    a = a.join(size, on, "left").withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.coalesce("_s", F.lit(1))).cast("int")).drop("_s")
    b = b.join(size, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_s", F.lit(1)) - 1))).drop("_s")
    return a, b


def _ranks(column: pa.Array) -> np.ndarray:
    """Numbers of the strings in their order."""
    coded = column.dictionary_encode()
    names = coded.dictionary
    order = np.empty(len(names), np.int64)
    order[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
    return order[coded.indices.to_numpy(zero_copy_only=False)]


def near_swept(left: DataFrame, right: DataFrame, nm: float, seconds: int, feet: float | None = None, differ: str | None = None,
               ordered: bool = False, best: str | None = None, hot: int = HOT) -> DataFrame:
    """Pairs of points of different flights within nm, seconds and, if given, feet: a_* and b_* columns, and ``nm``.

    Both frames have flight_id, ts, lat, lon, with ``feet`` alt, with ``differ`` a column whose values must differ. ``ordered``
    keeps pairs whose first flight id is the smaller. ``best`` is None for all pairs, "point" for the first right point (by ts,
    then flight id) of each left row, or "flights" for candidates of the closest pair of each two flights: callers take the least of them.
    Two more are for left rows that are places, without a flight: "weight" gives the sum ``near`` of the right column ``_rows``
    instead of pairs, "two" the first right point and the first of another flight than that, which is then named in ``first``.
    Null flights, times and positions pair with nothing. Cells don't wrap at the 180th meridian. Left groups of more than
    ``hot`` rows are split and their right rows copied to each part.
    """
    known = lambda df: df.where(" and ".join(f"{x} is not null" for x in ("flight_id", "ts", "lat", "lon") if x in df.columns))
    a, b = _grouped(known(left), known(right), nm, seconds, hot)
    places = best in ("weight", "two")
    names = [("a", x) for x in left.columns] + [("b", x) for x in right.columns]
    packed = lambda df, side, other: df.select(*KEYS, c("ts").alias("_ts"), F.lit(side == "b").alias("_right"),
                                               F.struct(*[c(x) for x in df.columns if x not in KEYS]).alias(side),
                                               F.lit(None).cast(other.schema).alias("b" if side == "a" else "a"))
    both = packed(a, "a", right).unionByName(packed(b, "b", left))
    both = both.repartition(*KEYS).sortWithinPartitions(*KEYS, "_ts")
    fields = [StructField(f"{side}_{x}", (left if side == "a" else right).schema[x].dataType) for side, x in names]
    out = StructType([*fields, StructField("nm", DoubleType())])
    if best == "weight":
        out = StructType([*fields[:len(left.columns)], StructField("near", LongType())])
    elif best == "two":
        out = StructType([*out.fields, StructField("first", StringType())])
    dlat = nm / 59.5

    def pairs_of(table: pa.Table):
        side = table["_right"].to_numpy()
        new = np.zeros(len(table), bool)
        for k in KEYS:
            v = table[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        ts = table["_ts"].to_numpy()
        base = ts.min()
        key = np.cumsum(new) * (ts.max() - base + 2 * seconds + 2) + (ts - base)
        ia, ib = np.flatnonzero(~side), np.flatnonzero(side)
        if not len(ia) or not len(ib):
            return
        a_, b_ = table["a"].combine_chunks().take(pa.array(ia)), table["b"].combine_chunks().take(pa.array(ib))
        get = lambda x, f: x.field(f).to_numpy(zero_copy_only=False)
        flights = [x.field("flight_id").cast(pa.string()) for x in (a_, b_) if best != "weight" and not (places and x is a_)]
        every = _ranks(pa.concat_arrays(flights)) if flights else None
        fa, fb = (None, every) if places else (every[:len(ia)], every[len(ia):])
        ka, kb = key[ia], key[ib]
        lo, hi = np.searchsorted(kb, ka - seconds, "left"), np.searchsorted(kb, ka + seconds, "right")
        ends = np.cumsum(hi - lo)
        la, lb, oa, ob = get(a_, "lat"), get(b_, "lat"), get(a_, "lon"), get(b_, "lon")
        at = 0
        while at < len(ia):
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
            n = hi[at:to] - lo[at:to]
            x = np.repeat(np.arange(at, to), n)
            y = np.arange(n.sum()) + np.repeat(lo[at:to] - (np.cumsum(n) - n), n)
            on = np.abs(la[x] - lb[y]) <= dlat
            if not places:
                on &= (fa[x] < fb[y]) if ordered else (fa[x] != fb[y])
            x, y = x[on], y[on]
            if feet is not None:
                on = np.abs(get(a_, "alt")[x] - get(b_, "alt")[y]) <= feet
                x, y = x[on], y[on]
            d = _haversine(la[x], oa[x], lb[y], ob[y])
            on = d <= nm
            x, y, d = x[on], y[on], d[on]
            if differ is not None and len(x):
                on = pc.not_equal(a_.field(differ).take(pa.array(x)), b_.field(differ).take(pa.array(y))).fill_null(False).to_numpy(zero_copy_only=False)
                x, y, d = x[on], y[on], d[on]
            if best == "weight":
                near = np.zeros(to - at, np.int64)
                np.add.at(near, x - at, get(b_, "_rows")[y])
                some = np.flatnonzero(near)
                if len(some):
                    ta = a_.take(pa.array(some + at))
                    yield pa.RecordBatch.from_arrays([*(ta.field(f) for s, f in names if s == "a"), pa.array(near[some])], out.names)
                at = to
                continue
            first = None
            if best == "two":
                order = np.lexsort((fb[y], kb[y], x))
                x, y, d = x[order], y[order], d[order]
                starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
                head = np.repeat(starts, np.diff(np.append(starts, len(x))))        # where the first of each place is
                others = np.flatnonzero(fb[y] != fb[y[head]])
                others = others[np.concatenate([[True], x[others][1:] != x[others][:-1]])] if len(others) else others
                first = [*[None] * len(starts), *b_.field("flight_id").cast(pa.string()).take(pa.array(y[head[others]], pa.int64())).to_pylist()]
                order = np.concatenate([starts, others])
                x, y, d = x[order], y[order], d[order]
            elif best == "point":
                order = np.lexsort((fb[y], kb[y], x))
                order = order[np.concatenate([[True], x[order][1:] != x[order][:-1]])] if len(order) else order
                x, y, d = x[order], y[order], d[order]
            elif best == "flights" and len(x):
                _, which = np.unique(fa[x] * (every.max() + 1) + fb[y], return_inverse=True)
                least = np.full(which.max() + 1, np.inf)
                np.minimum.at(least, which, d)
                on = d <= least[which] * (1 + 1e-9) + 1e-9      # all that could be the least in another arithmetic
                x, y, d = x[on], y[on], d[on]
            if len(x):
                ta, tb = a_.take(pa.array(x)), b_.take(pa.array(y))
                more = [] if first is None else [pa.array(first, pa.string())]
                yield pa.RecordBatch.from_arrays([*((ta if s == "a" else tb).field(f) for s, f in names), pa.array(d), *more], out.names)
            at = to

    def run(batches):
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= CHUNK:
                table = pa.Table.from_batches(held)
                last = table.slice(len(table) - 1)
                same = np.ones(len(table), bool)
                for k in KEYS:
                    same &= table[k].to_numpy() == last[k][0].as_py()
                cut = len(table) - int(same.sum())      # the last group may go on
                if cut:
                    yield from pairs_of(table.slice(0, cut))
                held, n = table.slice(cut).to_batches(), len(table) - cut
        if n:
            yield from pairs_of(pa.Table.from_batches(held))

    return both.mapInArrow(run, out)


def _at_places(found: DataFrame) -> DataFrame:
    return found.withColumnsRenamed({f"a_{x}": x for x in AT})


def near_counts(points: DataFrame, nm: float, seconds: int, feet: float, right: DataFrame | None = None) -> DataFrame:
    """Number of pairs with points of other flights within nm, seconds and feet: flight_id, pairs; flights with none are left out.

    The others are the points of ``right``, if given, else ``points`` themselves.
    """
    finite = " and ".join(f"abs({x}) < double('infinity')" for x in ("lat", "lon", "alt"))
    usable = lambda df: df.select("flight_id", *AT).where(f"flight_id is not null and ts is not null and {finite}")
    p = usable(points)
    q = p if right is None else usable(right)

    def swept(places):
        others = places if right is None else q.groupBy(*AT).agg(F.count("*").alias("_rows"))
        return _at_places(near_swept(places.drop("_rows"), others, nm, seconds, feet, best="weight"))

    near = by_place(p, AT, swept, sized=True).groupBy("flight_id").agg(F.sum("near").alias("near"))
    # Every pair of a flight with itself, each point's with its own place among them, by the same arithmetic.
    width = 2 * seconds
    a = p.withColumn("_slice", F.floor(c("ts") / width))
    b = q.withColumnsRenamed({x: f"b_{x}" for x in AT})
    b = b.withColumn("_slice", F.explode(F.sequence(F.floor((c("b_ts") - seconds) / width), F.floor((c("b_ts") + seconds) / width))))
    own = a.join(b, ["flight_id", "_slice"]).where((F.abs(c("ts") - c("b_ts")) <= seconds) & (F.abs(c("alt") - c("b_alt")) <= feet))

    def close(batches):
        for batch in batches:
            la, lo, lb, ob = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("lat", "lon", "b_lat", "b_lon"))
            on = (np.abs(la - lb) <= nm / 59.5) & (_haversine(la, lo, lb, ob) <= nm)
            yield batch.select(["flight_id"]).filter(pa.array(on))

    own = own.select("flight_id", "lat", "lon", "b_lat", "b_lon").mapInArrow(close, own.select("flight_id").schema)
    own = own.groupBy("flight_id").agg(F.count("*").alias("own"))
    others = c("near") - F.coalesce("own", F.lit(0))
    return near.join(own, "flight_id", "left").select("flight_id", others.alias("pairs")).where("pairs > 0")


def first_near(left: DataFrame, right: DataFrame, nm: float, seconds: int, feet: float) -> DataFrame:
    """For each left row the first right point (by ts, then flight id) of another flight: left columns, b_* columns, ``nm``.

    The two least flights of a place are enough of the right side, and so are the first point and the first of another
    flight than that for a place of the left side: one of them is the answer, whatever flight asks.
    """
    least = F.dense_rank().over(Window.partitionBy(*AT).orderBy("flight_id"))
    two = right.where("flight_id is not null").withColumn("_rank", least).where("_rank <= 2").drop("_rank")
    swept = lambda places: _at_places(near_swept(places, two, nm, seconds, feet, best="two"))
    found = by_place(left.where("flight_id is not null"), AT, swept)
    return found.where("case when first is null then b_flight_id <> flight_id else first = flight_id end").drop("first")
