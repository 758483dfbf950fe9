"""The turn scan against a plain loop over anchors, with and without the bound on what an anchor can turn."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import T0, airports, track
from wayfold import config as C
from wayfold.operators import rules as ru, turns


def anchor_ok(t, i):
    if np.isnan(t.hdg[i]) or t.spd[i] < 80 or t.alt[i] < 1500:
        return False
    gap = t.ts[i] - t.p_ts[i]
    if gap > 0 and gap < C.TURN["acc_window_s"] and not np.isnan(t.p_hdg[i]):
        return abs(turns._signed(t.hdg[i], t.p_hdg[i])) / gap <= 12.0 and abs(t.spd[i] - t.p_spd[i]) / gap <= 10.0
    return True


def grow(t, i: int):
    """Yield (end, turned) for each accepted turning point after anchor i; stops when the turn reverses."""
    ref, turned, way = i, 0.0, 0
    for e in range(i + 1, len(t.ts)):
        if t.skip[e]:
            continue
        if t.ts[e] - t.ts[i] > C.TURN["acc_window_s"]:
            return
        if np.isnan(t.hdg[e]) or not 80 <= t.spd[e] <= 600 or t.alt[e] < 1500:
            continue
        dt = t.ts[e] - t.ts[ref]
        if dt <= 0 or (t.nm[e] < 5.0 and t.alt[e] < t.alt[ref]):
            continue
        moved = turns._hav(t.lat[ref], t.lon[ref], t.lat[e], t.lon[e])
        room = max(t.spd[e], t.spd[ref], 300.0) * dt / 3600.0 * 2.5
        if dt >= 10 or abs(t.spd[e] - t.spd[ref]) / dt > 10.0 or moved > room:
            ref = e                              # start measuring afresh from here
            continue
        dh = turns._signed(t.hdg[e], t.hdg[ref])
        if abs(dh) / dt > 12.0:
            continue
        if dt > 2 and abs(turns._signed(t.hdg[e], turns._course(t.lat[ref], t.lon[ref], t.lat[e], t.lon[e]))) > 90:
            continue
        ref = e
        side = int(np.sign(dh))
        if side == 0:
            continue
        if way and side != way:
            if abs(dh) <= 10:
                continue
            return
        way = side
        turned += abs(dh)
        yield e, turned


def holding(fid, t, anchors):
    for i in anchors:
        if not anchor_ok(t, i):
            continue
        for e, turned in grow(t, i):
            dur = t.ts[e] - t.ts[i]
            if turned >= 320 and dur >= 60:
                path = t.cum[e] - t.cum[i]
                disp = turns._hav(t.lat[i], t.lon[i], t.lat[e], t.lon[e])
                if path / dur * 3600 > 650 or disp > 10.0 or (disp > 0 and path / disp < 2.0):
                    continue
                if t.nm[e] >= 6.0 and t.low[e + 1] == t.low[i]:
                    yield t.row(fid, i, e, "orbit", turned)
                break
            if turned >= 220 and dur >= 70 and not t.quiet[e] and t.nm[e] >= 6.0:
                yield t.row(fid, i, e, "half_turn", turned)
                break


def loop(fid, t, anchors):
    """Looser scan for one loop of 70 to 240 s: path against displacement and signed heading."""
    n = len(t.ts)
    for i in anchors:
        if t.spd[i] < 80 or t.alt[i] < 1500:
            continue
        faults = flips = 0
        acc, last = 0.0, 0.0
        for j in range(i + 1, n):
            dt = t.ts[j] - t.ts[j - 1]
            dur = t.ts[j] - t.ts[i]
            if dur > 240:
                break
            dh = turns._signed(t.hdg[j], t.hdg[j - 1])            # NaN when a heading is missing
            acc += 0.0 if np.isnan(dh) else dh
            if dt > 0:
                moved = t.cum[j] - t.cum[j - 1]
                fast = max(t.spd[j], t.spd[j - 1]) > 600
                if fast or moved > max(t.spd[j], t.spd[j - 1], 300.0) * dt / 3600.0 * 2.5:
                    faults += 1
                else:
                    if not np.isnan(dh):
                        faults += abs(dh) / dt > 8.0
                        flips += last * dh < 0 and min(abs(last), abs(dh)) > 20
                        last = dh
                    if not np.isnan(t.hdg[j]) and moved > 0.1:
                        off = turns._signed(t.hdg[j], turns._course(t.lat[j - 1], t.lon[j - 1], t.lat[j], t.lon[j]))
                        faults += abs(off) > 120
            if j < i + 2 or dur < 70 or t.spd[j] < 80 or t.alt[j] < 1500:
                continue
            steps = j - i
            if faults / steps > 0.05 or flips / steps > 0.08 or (faults and flips / steps > 0.05):
                continue
            path = t.cum[j] - t.cum[i]
            disp = turns._hav(t.lat[i], t.lon[i], t.lat[j], t.lon[j])
            if not 0 < disp <= 10.0 or path / disp < 1.35 or path > 300.0 * dur / 3600.0 * 1.5:
                continue
            closed = abs(turns._signed(t.hdg[j], t.hdg[i])) <= 90 or abs(acc) >= 640
            if abs(acc) < 320 or np.isnan(t.hdg[i]) or np.isnan(t.hdg[j]) or not closed or abs(acc) / dur > 6.0:
                continue
            if min(t.nm[i], t.nm[j]) < 6.0:
                continue
            if not (path / disp >= 2.0 and disp >= 3.0) and t.quiet[j]:
                continue
            yield t.row(fid, i, j, "loop", abs(acc))
            return


def flight(r, n):
    """A track of straight legs, circles, weaves, gaps, glitches and missing headings."""
    rows, la, lo, h, ts, left, rate = [], 31.0 + r.random(), 31.0 + r.random(), 360 * r.random(), T0, 0, 0.0
    for _ in range(n):
        if left <= 0:
            left, rate = r.randint(5, 60), r.choice((0, 0, 1.5, -1.5, 3, -3, 5, 8, -8))
        dt = r.choice((2, 4, 4, 5, 6, 9, 9, 14)) if r.random() < 0.98 else 300
        kt = 220.0 + r.choice((0, 0, 0, 30, -150, 500)) * (r.random() < 0.05)
        turn = rate * dt + r.uniform(-3, 3) + (r.choice((90, -170)) if r.random() < 0.01 else 0)
        d = kt * dt / 3600 / 60
        la += d * math.cos(math.radians(h + turn / 2))
        lo += d * math.sin(math.radians(h + turn / 2)) / math.cos(math.radians(la))
        h, ts, left = h + turn, ts + dt, left - 1
        rows.append({"ts": ts, "lat": la, "lon": lo, "track": None if r.random() < 0.03 else h % 360, "gspeed": kt, "alt": r.choice((15000.0,) * 12 + (1200.0,))})
    return rows


def frame(r, n):
    f = pd.DataFrame(flight(r, n))
    f["track"] = f["track"].astype(float)
    f["ap_nm"] = [r.choice((50.0, 50.0, 50.0, 5.5, 4.0)) if r.random() < 0.1 else 50.0 for _ in range(n)]
    f["ap_elev"], f["impossible"] = 100.0, [r.random() < 0.03 for _ in range(n)]
    f["known_place"] = [r.random() < 0.1 for _ in range(n)]
    for x in ("ts", "gspeed", "track"):
        f[f"prev_{x}"] = f[x].shift()
    return f


@pytest.mark.parametrize("seed", range(12))
def test_scan_equals_a_loop_over_anchors(seed):
    r = random.Random(seed)
    t = turns._Track(frame(r, 500))
    every = np.arange(len(t.ts))
    plain = sorted(holding("F", t, every))
    assert sorted(turns._holdings("F", t, every)) == plain and len(plain) > 20
    for part in (every, every[60:], every[200:300], every[:0]):
        assert list(turns._loops("F", t, part)) == list(loop("F", t, part))
        assert list(turns._loops("F", t, part, at_once=7)) == list(loop("F", t, part))
    assert sorted(turns._holdings("F", t, every[100:200])) == sorted(holding("F", t, every[100:200]))


def test_bound_keeps_all_events_and_drops_slices(spark):
    """One flight holds most points; straight flights never reach the grouped map."""
    r, rows = random.Random(5), []
    rows += [{**x, "flight_id": "hot"} for x in flight(r, 1500)]
    for k in range(6):
        rows += [{**x, "flight_id": f"F{k}"} for x in flight(r, 60)]
    rows += [{"flight_id": "straight", "ts": T0 + 5 * i, "lat": 31 + 220 * 5 * i / 3600 / 60, "lon": 32.0, "track": (i % 2) * 0.5, "gspeed": 220.0, "alt": 15000.0} for i in range(400)]
    pts = ru.enrich(track(spark, rows), airports(spark)).withColumns({"in_turn": F.lit(False), "known_place": F.lit(False)})
    a, b = (sorted(map(tuple, turns.turn_events(pts, bounded=x).collect()), key=str) for x in (True, False))
    assert a == b and {x[0] for x in a} >= {"hot"} and {x[3] for x in a} >= {"orbit", "half_turn"} and len(a) > 50
    kept = turns.bounded_anchors(turns.with_halo(pts.select(*turns.COLS), 0, 900), 900, 220.0)
    assert kept.where("flight_id = 'straight'").count() == 0 and 0 < kept.where("_anchor").count() < len(rows)


def test_slices_together_give_what_each_gives_alone():
    r = random.Random(5)
    parts = [frame(r, n) for n in (500, 1, 40, 500, 3, 300)]
    starts = np.cumsum([0, *(len(p) for p in parts[:-1])])
    t = turns._Track(pd.concat(parts, ignore_index=True), starts)
    every = np.arange(len(t.ts))
    alone = lambda find: [t2.row("F", *x) for t2 in map(turns._Track, parts) for x in zip(*find(t2, np.arange(len(t2.ts))))]
    for find in (turns._holding_ends, turns._loop_ends, lambda t2, a: turns._loop_ends(t2, a, at_once=7)):
        got = [t.row("F", *x) for x in zip(*find(t, every))]
        assert sorted(got) == sorted(alone(find)) and got


def test_chunks_of_the_scan_do_not_matter(spark, monkeypatch):
    r = random.Random(8)
    parts = [frame(r, 120).assign(flight_id=f"F{k}", _anchor=True, _slice=k) for k in range(6)]
    table = turns.pa.Table.from_pandas(pd.concat(parts, ignore_index=True)[[*turns.COLS, "_anchor", "_slice"]], preserve_index=False)
    rows = lambda: [tuple(x.values()) for b in turns._events(iter(table.to_batches(max_chunksize=50)), turns._holding_ends) for x in b.to_pylist()]
    whole = rows()
    monkeypatch.setattr(turns, "CHUNK", 130)
    assert rows() == whole and len({x[0] for x in whole}) > 1
