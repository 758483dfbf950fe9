"""Closest points of other flights by a sweep, against all pairs."""

import math
import random

import pyarrow as pa
import pytest

from tests.conftest import T0, track
from wayfold.operators import forecast as fc, history as hi


def km(p, q):
    a, b, x, y = map(math.radians, (p["lat"], p["lon"], q["lat"], q["lon"]))
    h = math.sin((x - a) / 2) ** 2 + math.cos(a) * math.cos(x) * math.sin((y - b) / 2) ** 2
    return round(2 * 6371.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h)), 9)


def field(lat, lon, n=240, wide=0.3):
    """Points of eight flights in a small field, some at the same place, a few without speed."""
    r = random.Random(lat)
    return [{"flight_id": f"F{i % 8}", "ts": T0 + i, "lat": round(lat + r.random() * 0.3, 2), "lon": lon + round(r.random() * wide, 2),
             "gspeed": None if i % 31 == 0 else 200.0 + i % 90, "vspeed": float(i % 7)} for i in range(n)]


def wanted(rows):
    best = {}
    for p in rows:
        for h in rows:
            d = km(p, h)
            if h["flight_id"] != p["flight_id"] and d <= 5:
                k = (f"{p['flight_id']}:{p['ts']}", h["flight_id"])
                best[k] = min(best.get(k, (9, 0, None)), (d, h["ts"], h["gspeed"]), key=lambda x: x[:2])
    return best


def test_closest_points_and_their_sums_need_no_join_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(hi, "HOT", 40)          # crowded cells are split
    for rows in (field(31.0, 33.0), field(-0.1, -0.1), field(84.0, 10.0, wide=3.0), field(87.0, 10.0, wide=6.0)):
        df = track(spark, rows)
        q = df.selectExpr("concat_ws(':', flight_id, cast(ts as string)) as qid", "flight_id", "lat", "lon", "gspeed", "vspeed").repartition(5)
        best = wanted(rows)
        near = fc.closest_history(q, df)
        assert {(r.qid, r.h_flight): (r.km, r.h_ts, r.h_gspeed) for r in near.collect()} == best and best
        plan = near._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "Aggregate" not in plan
        sums = {r.qid: r for r in hi.history_sums(q, df).collect()}
        assert {k: r.tracks for k, r in sums.items()} == {k: sum(x[0] == k for x in best) for k in {x[0] for x in best}}
        for k, r in sums.items():
            v = [x[2] for (qid, _), x in best.items() if qid == k and x[2] is not None]
            if not v:
                assert r.m_gspeed is None and r.s_gspeed is None
                continue
            m = sum(v) / len(v)
            assert abs(r.m_gspeed - m) < 1e-9 and abs(r.s_gspeed - math.sqrt(sum((x - m) ** 2 for x in v) / len(v))) < 1e-7


def test_cells_and_pairs_in_small_pieces(monkeypatch):
    rows = field(31.0, 33.0)
    at = sorted([(cell, 0, 0, side, p["flight_id"], p["lat"], p["lon"], p["ts"]) for cell in range(5) for side in (False, True) for p in rows], key=lambda x: (x[0], x[5]))
    table = pa.table(dict(zip([*hi.KEYS, "right", "flight_id", "lat", "lon", "ts"], map(list, zip(*at)))))
    found = lambda: sorted((t["_y"][int(a)].as_py(), t["flight_id"][int(a)].as_py(), t["ts"][int(a)].as_py(), t["ts"][int(b)].as_py(), float(d))
                           for t in hi._cells(iter(table.to_batches(max_chunksize=100))) for x, y, z in hi._closest(t, 0.046, 5.0) for a, b, d in zip(x, y, z))
    whole = found()
    monkeypatch.setattr(hi, "CHUNK", 300)
    monkeypatch.setattr(hi, "PAIRS", 50)
    assert whole and found() == whole and len(whole) == 5 * len(wanted(rows))


def test_a_place_is_worked_out_once(spark, monkeypatch):
    """Forty flights over the same thirty places: distances between places, not between points."""
    places = [(31.0 + 0.01 * (i % 6), 33.0 + 0.01 * (i // 6)) for i in range(30)]
    rows = [{"flight_id": f"F{f}", "ts": T0 + 100 * f + i, "lat": la, "lon": lo, "gspeed": 200.0 + (f * i) % 90, "vspeed": 0.1 * (f % 3)} for f in range(40) for i, (la, lo) in enumerate(places)]
    seen, km_ = [], hi._km
    monkeypatch.setattr(hi, "_km", lambda a, *x: (seen.append(len(a)), km_(a, *x))[1])
    at = sorted([(0, 0, 0, side, p["flight_id"], p["lat"], p["lon"], p["ts"]) for side in (False, True) for p in rows], key=lambda x: x[5])
    table = pa.table(dict(zip([*hi.KEYS, "right", "flight_id", "lat", "lon", "ts"], map(list, zip(*at)))))
    text = lambda name, i: table[name][int(i)].as_py()
    got = {(text("flight_id", a), text("ts", a), text("flight_id", b)): (float(d), text("ts", b)) for x, y, z in hi._closest(table, 0.046, 5.0) for a, b, d in zip(x, y, z)}
    assert sum(seen) <= len(places) ** 2
    assert {(f"{a}:{t}", b): v for (a, t, b), v in got.items()} == {k: v[:2] for k, v in wanted(rows).items()}


def test_sums_without_the_own_flight(spark):
    """A flight whose value outweighs all others', values of few digits, unknown ones, whole ones: as summed without the own flight."""
    r = random.Random(4)
    value = {"whole": lambda f: float(r.randint(100, 500)), "far": lambda f: 1e9 + 0.3 if f == 3 else 200 + r.random(), "same": lambda f: 0.1, "some": lambda f: None if f % 2 else r.random()}
    for kind, of in value.items():
        rows = [{"flight_id": f"F{f}", "ts": T0 + 10 * f + i, "lat": 31.0 + 0.01 * i, "lon": 33.0, "gspeed": of(f), "vspeed": 1.0} for f in range(9) for i in range(3)]
        df = track(spark, rows)
        q = df.selectExpr("concat_ws(':', flight_id, cast(ts as string)) as qid", "flight_id", "lat", "lon", "gspeed", "vspeed")
        best, sums = wanted(rows), {x.qid: x for x in hi.history_sums(q, df).collect()}
        assert len(sums) == len(rows)
        for k, x in sums.items():
            v = [h[2] for (qid, _), h in best.items() if qid == k and h[2] is not None]
            m = sum(v) / len(v)
            assert x.m_gspeed == pytest.approx(m, rel=1e-12) and x.s_gspeed == pytest.approx(math.sqrt(sum((y - m) ** 2 for y in v) / len(v)), rel=1e-6, abs=1e-9)
            assert kind != "whole" or x.s_gspeed == pytest.approx(math.sqrt(sum((y - m) ** 2 for y in v) / len(v)), rel=1e-13)
