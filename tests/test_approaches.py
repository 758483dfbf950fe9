"""Closest approaches of flights against a loop over all pairs of points."""

import math

import numpy as np
import pytest

from tests.conftest import T0
from wayfold.operators import approaches
from wayfold.operators.intel import operator_proximity

SCHEMA = "flight_id string, ts bigint, lat double, lon double, country string"


def hav(a, b):
    la, lo, lb, ob = map(math.radians, (a[2], a[3], b[2], b[3]))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((ob - lo) / 2) ** 2
    return 2 * 6371.0 * 0.539957 * math.atan2(math.sqrt(h), math.sqrt(max(1 - h, 0)))


def loop(points, nm, seconds):
    best = {}
    for a in points:
        for b in points:
            if a[0] < b[0] and a[4] != b[4] and abs(a[1] - b[1]) <= seconds and hav(a, b) <= nm:
                best.setdefault((a[0], b[0]), []).append((hav(a, b), a[1], b[1]))
    return {k: min(v) for k, v in best.items()}


@pytest.fixture(scope="module")
def flights():
    """Wandering flights over several cells and slices, some over the equator and in the west, a few of them close together."""
    r = np.random.default_rng(5)
    points = []
    for f in range(24):
        lat, lon = r.uniform(-3, 3), r.uniform(-2, 3)
        for t in sorted(r.choice(9000, 25, replace=False)):
            lat, lon = lat + r.normal() * 0.3, lon + r.normal() * 0.3
            points.append((f"F{f * 7 % 24}", int(T0 - 3000 + t), float(lat), float(lon), "ABC"[f % 3]))
    return points


@pytest.mark.parametrize("hot", [100_000, 30])
def test_closest_points_of_all_flights(spark, flights, hot):
    junk = [(None, T0, 0.0, 0.0, "A"), ("N", None, 0.0, 0.0, "B"), ("N", T0, None, 0.0, "B"), ("N", T0, 0.0, float("nan"), "B"), ("N", T0, 0.0, 0.0, None)]
    df = spark.createDataFrame(flights + junk, SCHEMA).repartition(5)
    least = {}
    for r in approaches._closest(df, 50, 300, "country", hot).collect():
        k = (r.a_flight_id, r.b_flight_id)
        least[k] = min(least.get(k, (99,)), (r.nm, r.a_ts, r.b_ts))
    want = loop(flights, 50, 300)
    assert len(want) > 30 and least.keys() == want.keys()
    for k, (d, a, b) in want.items():
        assert least[k][0] == pytest.approx(d, abs=1e-9) and least[k][1:] == (a, b)


def test_one_row_leaves_a_part(spark):
    """Flights side by side are as close at every point: the earliest pair is the answer, and the others don't leave the task."""
    # Equal positions: all distances are exactly 0.
    rows = [(f, T0 + 20 * i, 10.5, 20.5, k) for f, k in (("F1", "A"), ("F2", "B"), ("F3", "A")) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.a_flight_id, r.b_flight_id, r.nm, r.a_ts, r.b_ts) for r in approaches.closest_approaches(df, 50, 300, "country").collect())
    assert got == [("F1", "F2", 0.0, T0, T0), ("F2", "F3", 0.0, T0, T0)]
    assert [(r.f1, r.f2, r.pair, r.min_nm, r.ts, r.severity) for r in operator_proximity(df).orderBy("f1").collect()] == [
        ("F1", "F2", "A-B", 0.0, T0, "critical"), ("F2", "F3", "A-B", 0.0, T0, "critical")]
    assert operator_proximity(df.limit(0)).collect() == []
