"""Closest points of other flights, as a sweep along latitude inside cells.

Query points meet in one cell each; historic points are copied to the cells that they reach, about three. Inside a partition
two binary searches along latitude find what is near. A cell sees all that its query points reach: the closest point of each
flight, and sums over these, are settled there and pairs are never shuffled.

What is near depends on the place alone: distances are taken between distinct places, and the closest point of each flight and the
sums over them are worked out once for a place. Its query points only set their own flight apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from wayfold.operators.hotkeys import PARTS_SETTING, hot_keys

c = F.col
KM = 6371.0
HOT = 20_000            # query points of a cell above which it is split
CHUNK = 65_536          # rows looked at together
PAIRS = 1 << 20         # pairs in memory at once
SLOTS = 1 << 22         # places times flights looked at together
CANCELS = 1e-6          # share of a sum of squares below which what one value leaves of it is summed anew
APART = 1000.0          # degrees between the cells of a chunk on the axis that is swept
KEYS = ["_y", "_x", "_part"]


def _km(la1, lo1, la2, lo2):
    a1, a2 = np.radians(la1), np.radians(la2)
    h = np.sin((a2 - a1) / 2) ** 2 + np.cos(a1) * np.cos(a2) * np.sin((np.radians(lo2) - np.radians(lo1)) / 2) ** 2
    return np.round(2 * KM * np.arctan2(np.sqrt(h), np.sqrt(np.maximum(1 - h, 0))), 9)


def _met(queries: DataFrame, history: DataFrame, km: float) -> tuple[DataFrame, float]:
    """Rows of both sides by cell, in the order of latitude, and the reach in degrees."""
    reach = 1.001 * km / (KM * np.pi / 180)
    cell = 3 * reach
    width = lambda y: F.lit(cell) / F.cos(F.radians(F.least(F.greatest(F.abs(y), F.abs(y + 1)) * cell, F.lit(88.0))))
    usable = "flight_id is not null and abs(lat) < double('infinity') and abs(lon) < double('infinity')"
    a = queries.where(usable).withColumn("_y", F.floor(c("lat") / cell))
    a = a.withColumn("_x", F.floor(c("lon") / width(c("_y"))))
    b = history.where(usable)
    b = b.withColumn("_y", F.explode(F.sequence(F.floor((c("lat") - reach) / cell), F.floor((c("lat") + reach) / cell))))
    far = F.lit(reach) / F.cos(F.radians(F.least(F.abs("lat") + reach, F.lit(88.0))))
    b = b.withColumn("_x", F.explode(F.sequence(F.floor((c("lon") - far) / width(c("_y"))), F.floor((c("lon") + far) / width(c("_y"))))))
    hot = hot_keys(a, ["_y", "_x"], HOT)
    parts = lambda df: df.withColumn("_parts", F.lit(1)) if hot is None else df.join(F.broadcast(hot), ["_y", "_x"], "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    # A place is worked out in the root of the parts, so that neither it nor its query points are one task's.
    shift = F.pmod(F.xxhash64("qid"), F.ceil(F.sqrt("_parts")))
    a = parts(a).withColumn("_part", F.pmod(F.pmod(F.xxhash64("lat", "lon"), c("_parts")) + shift, c("_parts")).cast("int"))
    b = parts(b).withColumn("_part", F.explode(F.sequence(F.lit(0), c("_parts") - 1)))
    of = lambda df, right: df.select(*KEYS, F.lit(right).alias("right"), c("qid") if not right else F.lit(None).cast("string").alias("qid"), "flight_id",
                                     "lat", "lon", (c("ts") if right else F.lit(None)).cast("bigint").alias("ts"),
                                     *[(c(x) if right else F.lit(None)).cast("double").alias(x) for x in ("gspeed", "vspeed")])
    both = of(a, False).unionByName(of(b, True))
    # A fixed number of tasks: their work is far more than their bytes say.
    return both.repartition(int(both.sparkSession.conf.get(PARTS_SETTING)), *KEYS).sortWithinPartitions(*KEYS), float(reach)


def _cells(batches):
    """Tables of whole cells, of about ``CHUNK`` rows each or one larger cell."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= CHUNK:
            table = pa.Table.from_batches(held)
            same = np.ones(len(table), bool)
            for k in KEYS:
                v = table[k].to_numpy()
                same &= v == v[-1]
            cut = len(table) - int(same.sum())      # the last cell may go on
            if cut:
                yield table.slice(0, cut)
            held, n = table.slice(cut).to_batches(), len(table) - cut
    if n:
        yield pa.Table.from_batches(held)


def _places(rows: np.ndarray, *by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of ``by``, and where one differs from the row before in it."""
    rows = rows[np.lexsort([v[rows] for v in reversed(by)])]
    new = np.zeros(len(rows), bool)
    new[:1] = True
    for v in by:
        new[1:] |= v[rows[1:]] != v[rows[:-1]]
    return rows, new


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of n each, one after another."""
    return np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)


class _Near:
    """The closest row of each flight to some places: row ``rows`` at distance ``km`` to the place with number ``at``, by place.

    ``queries`` are the query rows of these places, ``where`` the numbers of their places and ``own`` the position of their own flight in
    ``rows`` or -1.
    """

    def __init__(self, at, rows, km, queries, where, own, places):
        self.at, self.rows, self.km, self.queries, self.where, self.own, self.places = at, rows, km, queries, where, own, places


def _near(table: pa.Table, reach: float, km: float):
    """``_Near`` of some places after the others."""
    right = table["right"].to_numpy()
    ia, ib = np.flatnonzero(~right), np.flatnonzero(right)
    if not len(ia) or not len(ib):
        return
    fl = table["flight_id"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype("int64")
    flights = int(fl.max()) + 1
    la, lo, ts = (table[x].to_numpy() for x in ("lat", "lon", "ts"))
    cell = np.zeros(len(table), np.int64)
    for k in KEYS:
        v = table[k].to_numpy()
        cell[1:] |= v[1:] != v[:-1]
    cell = np.cumsum(cell)
    queries, new = _places(ia, cell, la, lo)
    number, pa_ = np.cumsum(new) - 1, queries[new]
    # Of a flight that comes to a place more than once the earliest row counts.
    ib = ib[np.argsort(ts[ib].astype("int64"), kind="stable")]
    held, new = _places(ib, cell, la, lo, fl)
    held = held[new]
    first_of = np.ones(len(held), bool)
    first_of[1:] = (cell[held[1:]] != cell[held[:-1]]) | (la[held[1:]] != la[held[:-1]]) | (lo[held[1:]] != lo[held[:-1]])
    start = np.flatnonzero(first_of)
    count, pb = np.diff(np.append(start, len(held))), held[start]
    th, fh = ts[held].astype("int64"), fl[held]
    along = cell * APART + la
    low, high = np.searchsorted(along[pb], along[pa_] - reach, "left"), np.searchsorted(along[pb], along[pa_] + reach, "right")
    ends, at = np.cumsum(high - low), 0
    step = max(1, SLOTS // flights)
    first = np.zeros(step * flights, np.int64)
    none = np.iinfo(np.int64).max
    while at < len(pa_):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
        n = high[at:to] - low[at:to]
        x, y = np.repeat(np.arange(at, to), n), _ranges(low[at:to], n)
        a, b = pa_[x], pb[y]
        # A bound on longitude spares most distances; near the poles it says nothing.
        slim = np.cos(np.radians(np.abs(la[a]) + reach))
        on = (np.abs(lo[a] - lo[b]) * slim <= 1.01 * reach) | (np.abs(la[a]) > 85)
        x, y, a, b = x[on], y[on], a[on], b[on]
        d = _km(la[a], lo[a], la[b], lo[b])
        on = d <= km
        x, y, d = x[on], y[on], d[on]
        order = np.lexsort((d, x))
        x, y, d = x[order], y[order], d[order]
        rows = np.cumsum(np.bincount(x - at, count[y], to - at)) if len(x) else np.zeros(to - at)
        p = at
        while p < to:
            q = at + int(np.searchsorted(rows, (rows[p - at - 1] if p > at else 0) + PAIRS, "right"))
            q = max(p + 1, min(q, p + step, to))
            own = slice(*np.searchsorted(x, [p, q]))
            xp, yp, dp = x[own] - p, y[own], d[own]
            n = count[yp]
            e, place = _ranges(start[yp], n), np.repeat(xp, n)      # of each flight at each near place, the closest places first
            slot, pos = place * flights + fh[e], np.arange(len(e))
            first[slot] = none
            np.minimum.at(first, slot, pos)
            same = (xp[1:] == xp[:-1]) & (dp[1:] == dp[:-1])
            if same.any():          # places equally far: the earliest row of a flight is the closest
                group = np.repeat(np.cumsum(np.concatenate([[0], ~same])), n)
                tied = np.concatenate([same, [False]]) | np.concatenate([[False], same])
                some = np.flatnonzero(np.repeat(tied, n))
                some = some[group[some] == group[first[slot[some]]]]
                some = some[np.argsort(th[e[some]], kind="stable")]
                s = slot[some]
                first[s] = none
                np.minimum.at(first, s, np.arange(len(some)))
                first[s] = some[first[s]]
            best = first[slot] == pos
            qs = slice(*np.searchsorted(number, [p, q]))
            where, ask = number[qs] - p, queries[qs]
            mine = where * flights + fl[ask]
            if len(pos):
                got = np.minimum(first[mine], len(pos) - 1)
                mine = np.where(slot[got] == mine, (np.cumsum(best) - 1)[got], -1)
            else:
                mine = np.full(len(ask), -1)
            yield _Near(place[best], held[e[best]], np.repeat(dp, n)[best], ask, where, mine, q - p)
            p = q
        at = to


def _closest(table: pa.Table, reach: float, km: float):
    """For some query rows after the other: rows of queries, rows of their closest points by flight, distances."""
    for near in _near(table, reach, km):
        count = np.bincount(near.at, minlength=near.places)
        start, n = np.cumsum(count) - count, count[near.where]
        ends, at = np.cumsum(n), 0
        while at < len(n):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            each = _ranges(start[near.where[at:to]], n[at:to])
            others = each != np.repeat(near.own[at:to], n[at:to])
            each = each[others]
            if len(each):
                yield np.repeat(near.queries[at:to], n[at:to])[others], near.rows[each], near.km[each]
            at = to


def _without_own(near: _Near, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of values of ``near.rows``: how many are known, their mean and spread at each query row, without its own flight's.

    Whole numbers are summed exactly. Else the own value is taken off the sum of squares about the place's mean, and where it was nearly
    all of that, which can be so for one or two flights of a place, the others are summed anew.
    """
    known, w = ~np.isnan(v), near.where
    sums = lambda x: np.bincount(near.at, x, near.places)
    with np.errstate(invalid="ignore", divide="ignore"):
        k = sums(known.astype("float64"))
        pivot = sums(np.where(known, v, 0)) / k
        whole = bool((v[known] == np.rint(v[known])).all())
        pivot = np.rint(pivot) if whole else pivot
        u = np.where(known, v - pivot[near.at], 0.0)
        two = sums(u * u)[w]
        less = np.where(near.own >= 0, u[near.own], 0.0)
        n = k[w] - ((near.own >= 0) & known[near.own])
        s = sums(u)[w] - less
        mean, square = s / n + pivot[w], np.where(n > 1, (n * (two - less * less) - s * s) / n, 0.0)
        anew = np.flatnonzero((n > 1) & (square < CANCELS * two) & ((n * two >= 2 ** 53) if whole else True))
        count = np.bincount(near.at, minlength=near.places)
        start = np.cumsum(count) - count
        ends, at = np.cumsum(count[w[anew]]), 0
        while at < len(anew):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            rows = anew[at:to]
            m = count[w[rows]]
            each, of = _ranges(start[w[rows]], m), np.repeat(np.arange(len(rows)), m)
            on = known[each] & (each != near.own[rows][of])
            each, of = each[on], of[on]
            mean[rows] = np.bincount(of, v[each], len(rows)) / n[rows]
            square[rows] = np.bincount(of, (v[each] - mean[rows][of]) ** 2, len(rows))
            at = to
        return n, mean, np.sqrt(np.maximum(square, 0) / n)


def closest_points(queries: DataFrame, history: DataFrame, km: float = 5.0) -> DataFrame:
    """qid, h_flight, km, h_ts, h_gspeed, h_vspeed: of each other flight the closest point within km, ties to the earliest.

    ``queries``: qid (unique), flight_id, lat, lon; ``history``: flight_id, ts, lat, lon, gspeed, vspeed.
    """
    both, reach = _met(queries, history, km)
    out = StructType([StructField("qid", StringType()), StructField("h_flight", StringType()), StructField("km", DoubleType()),
                      StructField("h_ts", LongType()), StructField("h_gspeed", DoubleType()), StructField("h_vspeed", DoubleType())])

    def run(batches):
        for table in _cells(batches):
            for a, b, d in _closest(table, reach, km):
                of = lambda x, rows: table[x].combine_chunks().take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([of("qid", a), of("flight_id", b), pa.array(d), of("ts", b), of("gspeed", b), of("vspeed", b)], names=out.names)

    return both.mapInArrow(run, out)


def history_sums(queries: DataFrame, history: DataFrame, km: float = 5.0) -> DataFrame:
    """qid, tracks, mean m_ and spread s_ of gspeed and vspeed over the rows of ``closest_points``, for queries with such rows."""
    both, reach = _met(queries, history, km)
    kinds = ("gspeed", "vspeed")
    out = StructType([StructField("qid", StringType()), StructField("tracks", LongType()), *[StructField(f"{s}_{x}", DoubleType()) for x in kinds for s in "ms"]])

    def run(batches):
        for table in _cells(batches):
            values = [table[x].to_numpy().astype("float64") for x in kinds]         # null: nan
            for near in _near(table, reach, km):
                if not len(near.rows):
                    continue
                tracks = np.bincount(near.at, minlength=near.places)[near.where] - (near.own >= 0)
                some, cols = tracks > 0, []
                for v in values:
                    n, mean, spread = (x[some] for x in _without_own(near, v[near.rows]))
                    cols += [pa.array(mean, mask=n == 0), pa.array(spread, mask=n == 0)]
                qid = table["qid"].combine_chunks().take(pa.array(near.queries[some]))
                yield pa.RecordBatch.from_arrays([qid, pa.array(tracks[some].astype("int64")), *cols], names=out.names)

    return both.mapInArrow(run, out)
