"""Interference zones: chains, the split of wide ones, outlines, against a plain loop over components."""

import math

import numpy as np

from wayfold.operators import zones

FIELDS = ("lat double, lon double, score double, event_count bigint, affected_flights bigint, altitude_jumps bigint, position_teleports bigint, "
          "impossible_turns bigint, mlat_only_flights bigint, first_seen bigint, last_seen bigint, confidence string")


def cell(lat, lon, **more):
    base = {"score": 40.0, "event_count": 4, "affected_flights": 2, "altitude_jumps": 1, "position_teleports": 0, "impossible_turns": 0,
            "mlat_only_flights": 0, "first_seen": 100, "last_seen": 200, "confidence": "LOW", **more}
    return (round(float(lat), 4), round(float(lon), 4), *base.values())


def cells(seed=3):
    """A chain of 60 along a longitude, one of 500 in a broad field, a small one, a pair, and a wide one without room to split."""
    r = np.random.default_rng(seed)
    tall = [cell(10 + i * 0.3, 20 + r.random() * 0.05) for i in range(60)]
    field = [cell(40 + (i % 25) * 0.25, -30 + (i // 25) * 0.25, confidence="HIGH" if i % 3 else "LOW", position_teleports=3) for i in range(500)]
    small = [cell(60, 60, mlat_only_flights=9, altitude_jumps=0), cell(60.1, 60.2), cell(60.2, 60, altitude_jumps=0)]
    return tall + field + small + [cell(-10, 5), cell(-10.1, 5)]


def loop(pts, k, rounds=10):
    """Labels of one component by the stated rule."""
    p = np.round(np.asarray(pts) * 1_000_000).astype("int64")
    side = 0 if np.ptp(p[:, 0]) >= np.ptp(p[:, 1]) else 1
    order = np.lexsort((p[:, 1], p[:, 0], p[:, side]))
    centres = p[[order[(2 * i + 1) * len(p) // (2 * k)] for i in range(k)]]
    near = lambda: ((p[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    for _ in range(rounds):
        lab = near()
        new = np.asarray([p[lab == i].sum(axis=0) // (lab == i).sum() if (lab == i).any() else centres[i] for i in range(k)])
        if (new == centres).all():
            break
        centres = new
    return near()


def split(spark, rows, parts=3):
    df = spark.createDataFrame(rows, FIELDS).repartition(parts)
    labelled, sizes = zones.chains(df)
    return labelled, sizes, zones.keyed_kmeans(labelled, sizes)


def test_all_wide_chains_are_split_as_one_by_one(spark):
    rows = cells()
    for parts in (1, 9):
        labelled, sizes, got = split(spark, rows, parts)
        k = {r["component"]: r["parts"] for r in sizes.collect()}
        assert sorted(k.values()) == [1, 3, 10]         # spans of 17.7 and 6 degrees, and a small chain
        mine = {}
        for r in got.collect():
            mine.setdefault(r["component"], []).append((r["lat"], r["lon"], r["part"]))
        assert set(mine) == {x for x, n in k.items() if n > 1}
        for name, held in mine.items():
            assert [h[2] for h in held] == list(loop([h[:2] for h in held], k[name]))
        assert sum(map(len, mine.values())) == 560


def test_zones_have_type_confidence_and_area(spark):
    z = {r["zone"]: r for r in zones.interference_zones(spark.createDataFrame(cells(), FIELDS)).collect()}
    assert len(z) == 14 and sum(r["cells"] for r in z.values()) == 563
    small = [r for r in z.values() if r["lat"] > 59][0]
    assert (small["zone_type"], small["confidence"], small["event_count"]) == ("spoofing", "LOW", 12)
    field = [r for r in z.values() if 39 < r["lat"] < 59 and r["lon"] < 0]
    assert {r["zone_type"] for r in field} == {"mixed"} and {r["confidence"] for r in field} == {"HIGH"}
    # The small zone: a triangle pushed out by 15 nm times 1.2 for its score of 40.
    lat, lon, b = 60.1, 180.2 / 3, 18 / 60
    out = [(lat + (p - lat) * (1 + b / math.hypot(p - lat, q - lon)), lon + (q - lon) * (1 + b / math.hypot(p - lat, q - lon))) for p, q in ((60, 60), (60.1, 60.2), (60.2, 60))]
    want = (max(o[1] for o in out) - min(o[1] for o in out)) * (max(o[0] for o in out) - min(o[0] for o in out)) * 3600 * 0.7
    assert abs(small["area_sq_nm"] - want) < 0.06 and len(small["outline"]) == 3


def test_a_line_gets_a_circle_and_few_cells_none(spark):
    line = [cell(1 + i * 0.25, 7) for i in range(3)]
    r = zones.interference_zones(spark.createDataFrame(line, FIELDS)).collect()
    assert len(r) == 1 and len(r[0]["outline"]) == 17 and abs(r[0]["area_sq_nm"] - 3.14159 * 18 * 18) < 0.06
    assert zones.interference_zones(spark.createDataFrame(line[:2], FIELDS)).count() == 0
    assert zones.interference_zones(spark.createDataFrame([], FIELDS)).count() == 0
