"""Rule 3: abrupt turns, half turns and orbits.

The abrupt-turn part is plain expressions. The accumulation restarts at every point and
carries direction and reference through glitches, which no window expresses, so it runs
as a map over sorted slices. Slices of a track have the look-ahead copied in and no slice
holds a whole track, so their size is bounded. Only slices with a point from which the heading
turns enough reach it, and there the points of many slices are followed at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold import config as C
from wayfold.functions import geo
from wayfold.operators.windows import SLICE, cut, first_per_key, with_halo

c = F.col
OUT = ("flight_id string, ts bigint, start_ts bigint, pattern string, duration_s bigint, turn_deg double, "
       "path_nm double, displacement_nm double, lat double, lon double")
CHUNK = 65_536          # rows of whole slices looked at together


def abrupt_turns(pts: DataFrame) -> DataFrame:
    """Single steps of 160 degrees or more after three-point smoothing of the heading."""
    t = C.TURN
    smooth = lambda a, b, d: F.when(a.isNull() | d.isNull(), b).otherwise((a + b + d) / 3.0)
    before = smooth(c("prev2_track"), c("prev_track"), c("track"))
    now = F.when(c("next_ts").isNull(), c("track")).otherwise(smooth(c("prev_track"), c("track"), c("next_track")))
    dt = c("ts") - c("prev_ts")
    turn = geo.heading_diff(now, before)
    step = geo.haversine("prev_lat", "prev_lon", "lat", "lon")
    reach = F.coalesce(F.nullif(c("gspeed"), F.lit(0.0)), F.lit(300.0)) * dt / 3600.0 * 3.0
    p = pts.where(~c("impossible") & ~c("bad") & c("track").isNotNull() & c("prev_track").isNotNull()
                  & (dt > 0) & (dt <= t["window_s"]) & (step <= reach) & (c("gspeed") >= t["min_kt"])
                  & (c("ap_nm") >= 6.0) & ~c("in_turn"))
    p = p.withColumn("turn_deg", turn).where((c("turn_deg") >= t["heading_deg"]) & (c("turn_deg") / dt <= 5.0))
    return p.select("flight_id", "ts", c("prev_ts").alias("start_ts"), F.lit("abrupt").alias("pattern"), dt.alias("duration_s"),
                    F.round("turn_deg", 2).alias("turn_deg"), F.round(step, 2).alias("path_nm"),
                    F.round(step, 2).alias("displacement_nm"), "lat", "lon")


def _hav(la1, lo1, la2, lo2):
    a1, a2 = np.radians(la1), np.radians(la2)
    h = np.sin((a2 - a1) / 2) ** 2 + np.cos(a1) * np.cos(a2) * np.sin(np.radians(lo2 - lo1) / 2) ** 2
    return 2 * C.EARTH_NM * np.arctan2(np.sqrt(h), np.sqrt(np.maximum(1 - h, 0)))


def _course(la1, lo1, la2, lo2):
    a1, a2, d = np.radians(la1), np.radians(la2), np.radians(lo2 - lo1)
    return np.degrees(np.arctan2(np.sin(d) * np.cos(a2), np.cos(a1) * np.sin(a2) - np.sin(a1) * np.cos(a2) * np.cos(d))) % 360


def _signed(h1, h0):
    return (h1 - h0 + 540) % 360 - 180


class _Track:
    """Arrays of one slice or, with ``starts``, of several behind one another, with path length and low-approach counts as prefix sums."""

    def __init__(self, pdf: pd.DataFrame, starts: np.ndarray | None = None):
        starts = np.zeros(1, np.int64) if starts is None else starts
        ends = np.append(starts[1:], len(pdf))
        self.group = np.repeat(np.arange(len(starts)), ends - starts)
        self.stop = ends[self.group]
        g = lambda name, fill: pdf[name].astype(float).fillna(fill).to_numpy()
        self.ts = pdf["ts"].to_numpy(np.int64)
        self.lat, self.lon = g("lat", 0.0), g("lon", 0.0)
        self.alt, self.spd, self.hdg = g("alt", 0.0), g("gspeed", 0.0), g("track", np.nan)
        self.nm, self.elev = g("ap_nm", np.inf), g("ap_elev", 0.0)
        self.skip = pdf["impossible"].to_numpy(bool)
        self.quiet = pdf["known_place"].to_numpy(bool)
        self.p_ts, self.p_spd, self.p_hdg = g("prev_ts", np.nan), g("prev_gspeed", 0.0), g("prev_track", np.nan)
        step = _hav(self.lat[:-1], self.lon[:-1], self.lat[1:], self.lon[1:]) if len(pdf) > 1 else np.array([])
        self.cum = np.zeros(len(pdf))
        for a, z in zip(starts.tolist(), ends.tolist()):    # each slice for itself: the sums must not depend on its company
            np.cumsum(step[a:z - 1], out=self.cum[a + 1:z])
        low = (self.nm < 5.0) & (self.alt - self.elev < 2000)
        self.low = np.concatenate([[0], np.cumsum(low)])

    def row(self, fid, i, j, pattern, turn):
        disp = float(_hav(self.lat[i], self.lon[i], self.lat[j], self.lon[j]))
        return (fid, int(self.ts[j]), int(self.ts[i]), pattern, int(self.ts[j] - self.ts[i]), round(float(turn), 2),
                round(float(self.cum[j] - self.cum[i]), 2), round(disp, 2), float(self.lat[j]), float(self.lon[j]))


def _anchors_ok(t: _Track, i: np.ndarray) -> np.ndarray:
    ok = ~np.isnan(t.hdg[i]) & (t.spd[i] >= 80) & (t.alt[i] >= 1500)
    gap = t.ts[i] - t.p_ts[i]
    judged = (gap > 0) & (gap < C.TURN["acc_window_s"]) & ~np.isnan(t.p_hdg[i])
    calm = (np.abs(_signed(t.hdg[i], t.p_hdg[i])) / gap <= 12.0) & (np.abs(t.spd[i] - t.p_spd[i]) / gap <= 10.0)
    return ok & (~judged | calm)


def _holdings(fid: str, t: _Track, anchors: np.ndarray):
    for i, j, pattern, turn in zip(*_holding_ends(t, anchors)):
        yield t.row(fid, i, j, pattern, turn)


def _holding_ends(t: _Track, anchors: np.ndarray):
    """Orbits and half turns: all anchors take a step further in each round, until each has ended.

    An anchor follows accepted turning points while the turn keeps its direction, from a reference that starts afresh
    behind gaps and glitches. The first end that qualifies counts. Gives starts, ends, patterns and turns.
    """
    i = anchors[_anchors_ok(t, anchors)]
    most = C.TURN["acc_window_s"]
    end, orbit, amount = np.full(len(i), -1), np.zeros(len(i), bool), np.zeros(len(i))
    ref, way, turned, done = i.copy(), np.zeros(len(i)), np.zeros(len(i)), np.zeros(len(i), bool)
    live, step = np.arange(len(i)), 0
    while len(live):
        step += 1
        live = live[i[live] + step < t.stop[i[live]]]
        e = i[live] + step
        seen = ~t.skip[e]
        over = seen & (t.ts[e] - t.ts[i[live]] > most)
        live, e, seen = live[~over], e[~over], seen[~over]
        r = ref[live]
        dt = t.ts[e] - t.ts[r]
        on = seen & ~np.isnan(t.hdg[e]) & (t.spd[e] >= 80) & (t.spd[e] <= 600) & (t.alt[e] >= 1500) & (dt > 0) & ~((t.nm[e] < 5.0) & (t.alt[e] < t.alt[r]))
        w, e, r, dt = live[on], e[on], r[on], dt[on]
        moved = _hav(t.lat[r], t.lon[r], t.lat[e], t.lon[e])
        room = np.maximum(np.maximum(t.spd[e], t.spd[r]), 300.0) * dt / 3600.0 * 2.5
        afresh = (dt >= 10) | (np.abs(t.spd[e] - t.spd[r]) / dt > 10.0) | (moved > room)
        ref[w[afresh]] = e[afresh]
        w, e, r, dt = w[~afresh], e[~afresh], r[~afresh], dt[~afresh]
        dh = _signed(t.hdg[e], t.hdg[r])
        off = np.abs(_signed(t.hdg[e], _course(t.lat[r], t.lon[r], t.lat[e], t.lon[e])))
        calm = (np.abs(dh) / dt <= 12.0) & ~((dt > 2) & (off > 90))
        w, e, dh = w[calm], e[calm], dh[calm]
        ref[w] = e
        bent = dh != 0
        w, e, dh = w[bent], e[bent], dh[bent]
        back = (way[w] != 0) & (np.sign(dh) != way[w])
        ended = w[back & (np.abs(dh) > 10)]
        w, e, dh = w[~back], e[~back], dh[~back]
        way[w] = np.sign(dh)
        turned[w] += np.abs(dh)
        a = i[w]
        dur, path, disp = t.ts[e] - t.ts[a], t.cum[e] - t.cum[a], _hav(t.lat[a], t.lon[a], t.lat[e], t.lon[e])
        full = (turned[w] >= 320) & (dur >= 60)
        with np.errstate(divide="ignore", invalid="ignore"):
            shaped = full & ~((path / dur * 3600 > 650) | (disp > 10.0) | ((disp > 0) & (path / disp < 2.0)))
        told = shaped & (t.nm[e] >= 6.0) & (t.low[e + 1] == t.low[a])
        half = ~full & (turned[w] >= 220) & (dur >= 70) & ~t.quiet[e] & (t.nm[e] >= 6.0)
        hit = told | half
        end[w[hit]], orbit[w[hit]], amount[w[hit]] = e[hit], told[hit], turned[w[hit]]
        done[ended] = True
        done[w[shaped | half]] = True
        live = live[~done[live]]
    k = np.flatnonzero(end >= 0)
    return i[k], end[k], np.where(orbit[k], "orbit", "half_turn"), amount[k]


def _loops(fid: str, t: _Track, anchors: np.ndarray, at_once: int = 512):
    for i, j, pattern, turn in zip(*_loop_ends(t, anchors, at_once)):
        yield t.row(fid, i, j, pattern, turn)


def _loop_ends(t: _Track, anchors: np.ndarray, at_once: int = 512):
    """Looser scan for one loop of 70 to 240 s: path against displacement and signed heading. The first anchor's first end counts in each slice.

    Slices go on together, each with ``at_once`` of its anchors, until it has a loop or no more of them.
    """
    anchors = anchors[(t.spd[anchors] >= 80) & (t.alt[anchors] >= 1500)]
    found, parts = np.zeros(int(t.group[-1]) + 1 if len(t.group) else 0, bool), []
    while len(anchors):
        g = t.group[anchors]
        rank = np.arange(len(g)) - np.searchsorted(g, g)
        now = rank < at_once
        a, j, x = _first_loops(t, anchors[now])
        parts.append((a, j, x))
        found[t.group[a]] = True
        anchors = anchors[~now & ~found[g]]
    a, j, x = (np.concatenate(v) for v in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return a, j, np.full(len(a), "loop"), x


def _first_loops(t: _Track, i: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    group, none = t.group[i], len(i)
    best = np.full(int(group[-1]) + 1 if none else 0, none)       # which anchor of each slice, and its end and turn
    end, amount = np.zeros(len(best), np.int64), np.zeros(len(best))
    zero = lambda: np.zeros(len(i))
    faults, flips, acc, last = zero(), zero(), zero(), zero()
    live, step = np.arange(len(i)), 0
    while len(live):
        step += 1
        live = live[i[live] + step < t.stop[i[live]]]
        live = live[t.ts[i[live] + step] - t.ts[i[live]] <= 240]
        live = live[live < best[group[live]]]           # only an earlier anchor can still matter
        a, j = i[live], i[live] + step
        dt, dur = t.ts[j] - t.ts[j - 1], t.ts[j] - t.ts[a]
        dh = _signed(t.hdg[j], t.hdg[j - 1])            # NaN when a heading is missing
        known = ~np.isnan(dh)
        acc[live] += np.where(known, dh, 0.0)
        moved = t.cum[j] - t.cum[j - 1]
        spd = np.maximum(t.spd[j], t.spd[j - 1])
        later = dt > 0
        fast = later & ((spd > 600) | (moved > np.maximum(spd, 300.0) * dt / 3600.0 * 2.5))
        faults[live] += fast
        fair = later & ~fast
        with np.errstate(divide="ignore", invalid="ignore"):
            faults[live] += fair & known & (np.abs(dh) / dt > 8.0)
        flips[live] += fair & known & (last[live] * np.where(known, dh, 0.0) < 0) & (np.minimum(np.abs(last[live]), np.abs(dh)) > 20)
        last[live] = np.where(fair & known, dh, last[live])
        off = np.abs(_signed(t.hdg[j], _course(t.lat[j - 1], t.lon[j - 1], t.lat[j], t.lon[j])))
        faults[live] += fair & ~np.isnan(t.hdg[j]) & (moved > 0.1) & (off > 120)
        if step < 2:
            continue
        f, g, x = faults[live] / step, flips[live] / step, np.abs(acc[live])
        path, disp = t.cum[j] - t.cum[a], _hav(t.lat[a], t.lon[a], t.lat[j], t.lon[j])
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = path / disp
            hit = (dur >= 70) & (t.spd[j] >= 80) & (t.alt[j] >= 1500) & ~((f > 0.05) | (g > 0.08) | ((faults[live] > 0) & (g > 0.05)))
            hit &= (disp > 0) & (disp <= 10.0) & (ratio >= 1.35) & (path <= 300.0 * dur / 3600.0 * 1.5)
            closed = (np.abs(_signed(t.hdg[j], t.hdg[a])) <= 90) | (x >= 640)
            hit &= (x >= 320) & ~np.isnan(t.hdg[a]) & ~np.isnan(t.hdg[j]) & closed & (x / dur <= 6.0) & (np.minimum(t.nm[a], t.nm[j]) >= 6.0)
            hit &= ((ratio >= 2.0) & (disp >= 3.0)) | ~t.quiet[j]
        k = np.flatnonzero(hit)
        if len(k):
            g = group[live[k]]
            k = k[np.concatenate([[True], g[1:] != g[:-1]])]
            g = group[live[k]]
            best[g], end[g], amount[g] = live[k], j[k], x[k]
    g = np.flatnonzero(best < none)
    return i[best[g]], end[g], amount[g]


COLS = ["flight_id", "ts", "lat", "lon", "alt", "gspeed", "track", "ap_nm", "ap_elev", "impossible", "known_place",
        "prev_ts", "prev_gspeed", "prev_track"]


def bounded_anchors(sliced: DataFrame, ahead: int, least: float) -> DataFrame:
    """Mark as ``_anchor`` the points from which the heading can turn by ``least`` degrees within ``ahead`` seconds; slices without one go.

    Whatever points a scan accepts or skips, what it adds up is at most the sum of the absolute steps between all known headings: a
    step over skipped points is no longer than the steps that make it up. Those sums are prefix sums, so the greatest turn of
    a point is one difference.
    """
    w = Window.partitionBy("flight_id", SLICE).orderBy("ts")
    known = F.last("track", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = sliced.withColumn("_step", F.coalesce(F.abs(geo.heading_delta("track", known)), F.lit(0.0)))
    s = s.withColumn("_turned", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.withColumn("_room", F.last("_turned").over(w.rangeBetween(0, ahead)) - c("_turned"))
    s = s.withColumn("_anchor", c("_core") & c("track").isNotNull() & (c("_room") >= least - 1e-6)).drop("_step", "_turned", "_room")
    return s.withColumn("_any", F.max("_anchor").over(Window.partitionBy("flight_id", SLICE))).where("_any").drop("_any")


def _scan(pts: DataFrame, finder, ahead: int, least: float, bounded: bool = True) -> DataFrame:
    sliced = with_halo(pts.select(*COLS), before=0, after=ahead)
    # Windows and the map share one partitioning. AQE would merge small tasks, although a scan costs more than its bytes.
    sliced = sliced.repartition(int(pts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "flight_id", SLICE)
    sliced = bounded_anchors(sliced, ahead, least) if bounded else sliced.withColumn("_anchor", c("_core"))

    # Slices lie one after another, each in order of time.
    return sliced.sortWithinPartitions("flight_id", SLICE, "ts").mapInArrow(lambda batches: _events(batches, finder), OUT)


def _events(batches, finder):
    """Events of sorted rows: whole slices go to ``finder`` together, a chunk at a time."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= CHUNK:
            table = pa.Table.from_batches(held)
            last = int(_starts(table)[-1])          # the last slice may go on
            if last:
                yield _found(table.slice(0, last), finder)
            held, n = table.slice(last).to_batches(), len(table) - last
    if n:
        yield _found(pa.Table.from_batches(held), finder)


def _starts(table: pa.Table) -> np.ndarray:
    flight = table["flight_id"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    part = table[SLICE].to_numpy()
    return np.flatnonzero(np.concatenate([[True], (flight[1:] != flight[:-1]) | (part[1:] != part[:-1])]))


def _found(table: pa.Table, finder) -> pa.RecordBatch:
    t = _Track(table.drop_columns(["flight_id", SLICE]).to_pandas(), _starts(table))
    i, j, pattern, turn = finder(t, np.flatnonzero(table["_anchor"].to_numpy()))
    two = lambda v: pa.array([round(x, 2) for x in v.tolist()], pa.float64())
    disp = _hav(t.lat[i], t.lon[i], t.lat[j], t.lon[j])
    return pa.RecordBatch.from_arrays(
        [table["flight_id"].combine_chunks().take(pa.array(j, pa.int64())).cast(pa.string()), pa.array(t.ts[j]), pa.array(t.ts[i]), pa.array(pattern.tolist(), pa.string()),
         pa.array(t.ts[j] - t.ts[i]), two(turn), two(t.cum[j] - t.cum[i]), two(disp), pa.array(t.lat[j]), pa.array(t.lon[j])],
        [x.split()[0] for x in OUT.split(", ")])


def turn_events(pts: DataFrame, bounded: bool = True) -> DataFrame:
    """All rule-3 events. ``pts`` carries in_turn (learned turn) and known_place (corridor or procedure).

    ``bounded`` leaves out anchors that can't turn enough; events are the same without.
    """
    long_enough = pts.groupBy("flight_id").agg(F.count("*").alias("n")).where("n >= 4").select("flight_id")
    pts = cut(pts.join(long_enough, "flight_id", "left_semi"))      # three scans read it
    found = cut(abrupt_turns(pts).unionByName(_scan(pts, _holding_ends, C.TURN["acc_window_s"], 220.0, bounded)))
    rest = pts.join(found.select("flight_id").distinct(), "flight_id", "left_anti")
    loops = _scan(rest, _loop_ends, 240, 320.0, bounded)
    cols = [x.split()[0] for x in OUT.split(", ")]
    first = first_per_key(loops, ["flight_id"], [c("start_ts"), c("ts")]).select(*cols)
    return found.unionByName(first)
