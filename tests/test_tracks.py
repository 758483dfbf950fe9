"""Smoothing, runways by airport and candidates of similar flights against direct computations."""

import math
import random

from tests.conftest import T0, track

from wayfold.operators import intel as it, sequence as sq


def smoothed(rows, window):
    if len(rows) < window:
        return rows
    half, out = window // 2, []
    for i in range(len(rows)):
        near = rows[max(0, i - half):i + half + 1]
        out.append(tuple(sum(p[k] for p in near) / len(near) for k in (0, 1)))
    return out


def test_smoothing_equals_a_plain_loop_at_every_block_size(spark):
    rnd = random.Random(2)
    tracks = {f"F{n}": [(30 + rnd.random(), 33 + rnd.random()) for _ in range(n)] for n in (1, 2, 4, 5, 6, 23, 200)}
    df = track(spark, [{"flight_id": f, "ts": T0 + i * 3000, "lat": a, "lon": b} for f, rows in tracks.items() for i, (a, b) in enumerate(rows)])
    for window, block in ((5, 11), (5, 4096), (3, 7), (4, 9), (1, 3)):
        got = {}
        for r in sq.smooth_track(df, window, block).collect():
            got.setdefault(r["flight_id"], []).append((r["ts"], r["lat"], r["lon"]))
        for f, rows in tracks.items():
            want = smoothed(rows, window)
            have = [(a, b) for _, a, b in sorted(got[f])]
            assert len(have) == len(want)
            assert all(abs(x - y) < 1e-9 for p, q in zip(have, want) for x, y in zip(p, q)), (window, block, f)


def test_runways_of_known_and_unknown_airports(spark):
    down = [{"flight_id": "L", "ts": T0 + i * 20, "lat": 30.7761, "lon": 34.8067, "alt": 1800.0 - 300 * i, "track": 30.0} for i in range(5)]
    df = track(spark, down + [{"flight_id": "A", "ts": T0, "lat": 30.7761, "lon": 34.8067, "alt": 100.0}])
    got = {r["runway"]: (r["landings"], r["takeoffs"]) for r in sq.runway_usage_at(df, "LLMZ").collect()}
    assert got == {"03": (1, 0), "21": (0, 0)}
    assert sq.runway_usage_at(df, "KJFK").count() == 0
    assert set(sq.RUNWAY_BANDS) == set(sq.RUNWAY_AIRPORTS)


def test_candidates_by_route_then_by_area(spark):
    at = lambda f, lat: {"flight_id": f, "ts": T0, "lat": lat, "lon": 33.0}
    df = track(spark, [at("T", 31.0), at("near", 31.4), at("far", 33.0), at("same", 35.0)])
    target = spark.createDataFrame([("T",)], "flight_id string")
    meta = lambda *rows: spark.createDataFrame(rows, "flight_id string, origin_airport string, destination_airport string")
    ids = lambda m, rules=None: sorted(r[0] for r in it.similar_candidates(df, m, target, rules).collect())
    assert ids(meta(("T", "A", "B"), ("same", "A", "B"), ("near", "A", "C"), ("far", None, "B"))) == ["same"]
    assert ids(meta(("T", "A", None), ("same", "A", "B"), ("near", "A", ""), ("far", "B", "A"))) == ["near", "same"]
    assert ids(meta(("T", "", "B"), ("same", "A", "B"), ("near", None, "C"))) == ["same"]
    assert ids(meta(("T", None, "UNKNOWN"), ("same", None, ""), ("far", None, None))) == ["near"]
    assert ids(meta(("T", "A", "B"), ("far", "X", "Y"))) == ["near"]           # a route that no other flight has
    assert ids(meta(("far", "X", "Y"))) == ["near"]                             # a target without a record
    rules = lambda *rows: spark.createDataFrame(rows, "flight_id string, rule_id int")
    both = meta(("T", "A", "B"), ("same", "A", "B"), ("near", "A", "B"))
    assert ids(both, rules(("T", 1), ("T", 4), ("same", 4), ("near", 6))) == ["same"]
    assert ids(both, rules(("same", 4))) == ["near", "same"]                    # the target broke no rule
    nowhere = spark.createDataFrame([("Q",)], "flight_id string")
    assert it.similar_candidates(df, both, nowhere).count() == 0


def test_similar_flights_read_the_track_plan_once_for_all_branches(spark):
    """Same shares as by brute force, up to the far north, and a plan that no longer holds that of the tracks."""
    r = random.Random(3)
    rows = [{"flight_id": f"F{f}", "ts": T0 + i * 20, "lat": 79.6 + i * 0.05 + f * r.random() * 0.04, "lon": 20.0 + r.random() * f * 0.3} for f in range(12) for i in range(15)]
    df = track(spark, rows).where("alt > -12345")
    target = spark.createDataFrame([("F0",)], "flight_id string")
    got = it.similar_flights(df, target, df.where("flight_id <> 'F0'").select("flight_id").distinct(), nm=5.0, share=0.2, k=99)
    assert "12345" not in got._jdf.queryExecution().analyzed().toString()

    def nm(p, q):
        a, b, x, y = map(math.radians, (p["lat"], p["lon"], q["lat"], q["lon"]))
        return 2 * 6371.0 * 0.539957 * math.asin(math.sqrt(math.sin((x - a) / 2) ** 2 + math.cos(a) * math.cos(x) * math.sin((y - b) / 2) ** 2))

    own = [p for p in rows if p["flight_id"] == "F0"]
    want = {}
    for f in range(1, 12):
        n = sum(any(nm(p, q) <= 5 for q in rows if q["flight_id"] == f"F{f}") for p in own)
        if round(n / 15, 4) >= 0.2:
            want[f"F{f}"] = n
    assert len(want) > 3 and {x.flight_id: x.near_points for x in got.collect()} == want
