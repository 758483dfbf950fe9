"""Queries take all their input: compared with brute force over small tables."""

import functools
import math
import random
from collections import defaultdict
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tests.conftest import T0, airports, track
from wayfold.operators import intel as it, layers as ly, spatial as sp
from wayfold.plans import load_all, rules_queries as rq
from wayfold.plans.registry import QUERIES

load_all()


def km(p, q):
    a, b, c, d = map(math.radians, (p[0], p[1], q[0], q[1]))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * 6371.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


@pytest.fixture(scope="module")
def points():
    """Five flights of five airlines, side by side; of each, one point in seven is MLAT."""
    return [{"flight_id": f"U{f}", "ts": T0 + i * 20, "lat": 31.0 + i * 0.02 + f * 0.007, "lon": 33.0 + i * 0.01, "gspeed": 300.0 + f * f * (i % 4),
             "vspeed": 10.0 * f, "callsign": f"{a}{f}", "source": "MLAT" if i % 7 == 0 else "ADSB"}
            for f, a in enumerate(["ELY", "THY", "WZZ", "RJA", "QTR"]) for i in range(12)]


def test_every_point_is_tested_against_history(spark, points):
    t = SimpleNamespace(tracks=track(spark, points))
    best = {}
    for p in points:
        for h in points:
            d = round(km((p["lat"], p["lon"]), (h["lat"], h["lon"])), 9)
            if h["flight_id"] != p["flight_id"] and d <= 5:
                k = (f"{p['flight_id']}:{p['ts']}", h["flight_id"])
                best[k] = min(best.get(k, (9, 0)), (d, h["ts"]))
    got = {(r.qid, r.h_flight): r.h_ts for r in QUERIES["d08_closest_history"](t).collect()}
    assert got == {k: ts for k, (_, ts) in best.items()}
    tested = {r.qid: r.tracks for r in QUERIES["k17_history_test"](t).collect()}
    assert tested == {f"{p['flight_id']}:{p['ts']}": sum(k[0] == f"{p['flight_id']}:{p['ts']}" for k in best) for p in points}


def test_approaches_of_all_airlines(spark, points):
    country = {f"U{f}": x for f, x in enumerate(["US", "GB", "RU", "US", "GB"])}
    facts = spark.createDataFrame([(p["flight_id"], country[p["flight_id"]], p["callsign"][:3]) for p in points[::12]], "flight_id string, country string, airline string")
    best = {}
    for a in points:
        for b in points:
            k = (a["flight_id"], b["flight_id"])
            if k[0] < k[1] and country[k[0]] != country[k[1]] and abs(a["ts"] - b["ts"]) <= 300:
                best[k] = min(best.get(k, 99.0), km((a["lat"], a["lon"]), (b["lat"], b["lon"])) * 0.539957)
    got = {(r.f1, r.f2): r.min_nm for r in QUERIES["s19_operator_proximity"](SimpleNamespace(tracks=track(spark, points), facts=facts)).collect()}
    assert len(got) == 8 and got == {k: pytest.approx(round(v, 1), abs=0.05) for k, v in best.items()}


def test_route_passes_every_point(spark):
    """Up and down one meridian; the track crosses a border of slices."""
    lats = [31.0, 31.3, 31.1, 31.5, 31.2, 31.25, 31.9, 31.4, 31.6, 31.5, 31.0, 31.7]
    pts = track(spark, [{"ts": T0 + i * 4000, "lat": x} for i, x in enumerate(lats)])
    got = {r.t_s: r.lat for r in QUERIES["k12_interpolated_route"](SimpleNamespace(tracks=pts)).collect()}
    ends, s = [0.0], 3600 / 250
    for x, y in zip(lats, lats[1:]):
        ends.append(ends[-1] + km((x, 33), (y, 33)) * 0.539957 * s)
    want = {}
    for k in range(math.ceil(ends[-1] / 60)):
        i = max(j for j in range(len(lats) - 1) if ends[j] <= k * 60)
        want[k * 60] = lats[i] + (k * 60 - ends[i]) / (ends[i + 1] - ends[i]) * (lats[i + 1] - lats[i])
    assert got == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}


def test_paths_emerge_by_real_headings(spark, monkeypatch):
    """Eleven flights of two headings and one that turns, in turns: one signature repeats five times, another six."""
    rows = [{"flight_id": f"F{f:02d}", "ts": T0 + f * 100 + i * 10, "lat": 31.0 + i * 0.01, "lon": 33.0 + f * 0.1,
             "track": 45.0 + 30 * i if f == 3 else 40.0 if f % 2 else 200.0} for f in range(12) for i in range(6)]
    pts = track(spark, rows)
    monkeypatch.setattr(rq, "layer_set", lambda t: (None, spark.range(1), None))
    monkeypatch.setattr(rq, "enriched", lambda t: None)
    monkeypatch.setattr(ly, "off_course_points", lambda *a: pts.select("flight_id", "ts", F.lit(True).alias("far")))
    codes, seen, want = defaultdict(list), defaultdict(int), []
    for r in rows:
        codes[r["flight_id"]].append(int(r["track"] % 360 // 30))
    for f, sig in codes.items():                    # in the order of their first points
        seen[tuple(sig)] += 1
        want += [f] * (seen[tuple(sig)] % 5 == 0)
    assert want == ["F08", "F11"]
    got = rq._g17(SimpleNamespace(tracks=pts, meta=None)).collect()
    assert sorted(r.flight_id for r in got) == want and {r.num_flights for r in got} == {5}


def test_severities_of_all_reports(spark):
    """Reports of flights that no reviewer confirmed count as well."""
    reports = spark.createDataFrame([("U5", 0.9, 0.3), ("U6", 0.1, 0.2), ("U7", 0.85, 0.7)], "flight_id string, severity_cnn double, severity_dense double")
    feedback = spark.createDataFrame([("U5", 0), ("U6", 1)], "flight_id string, user_label int")
    got = {r.severity_range: r["count"] for r in QUERIES["e60_severity_histogram"](SimpleNamespace(reports=reports, feedback=feedback)).collect()}
    assert got == {"minimal": 1, "low": 0, "medium": 0, "high": 0, "critical": 2}


BORDER = [31.04, 31.83, 30.01, 31.07, 31.73, 30.55, 32.27, 32.16, 30.07, 30.06, 31.3, 32.91]        # their mean is 31.25, a border of cells


def _orders(n=18):
    """Some orders of them; added up as doubles they come out above the border in some."""
    r = random.Random(7)
    lists = [r.sample(BORDER, len(BORDER)) for _ in range(n)]
    assert {functools.reduce(lambda a, b: a + b, p) / len(p) > 31.25 for p in lists} == {True, False}
    return lists


def test_means_on_a_cell_border_do_not_hang_on_the_order_of_rows(spark):
    rows = [(f"U{i}", x, 33.0, 1) for i, p in enumerate(_orders()) for x in p]
    hits = spark.createDataFrame(rows, "flight_id string, lat double, lon double, rule_id int").coalesce(1)
    got = [(r.lat, r.lon, r.occurrences) for r in it.pattern_clusters(hits).collect()]
    assert got == [(31.0, 33.0, 18)]


def test_flights_and_cells_of_interference_take_exact_means(spark):
    rows = [{"flight_id": f"U{i}", "ts": T0 + k * 20, "lat": x, "track": 90.0 * (k % 2), "gspeed": 700.0, "alt": 30000.0 + 10000 * (k % 2)}
            for i, p in enumerate(_orders()) for k, x in enumerate((31.25, *p))]
    far = airports(spark, (("LLBG", 0.0, 0.0, 0),))
    per = sp.flight_interference(track(spark, rows), far).collect()
    assert len(per) == 18 and {r.lat for r in per} == {31.25}
    got = sp.interference_components(track(spark, rows), far, step=0.5, limit=None).collect()
    assert [(r.cell_lat, r.lat, r.affected_flights) for r in got] == [(31.0, 31.25, 18)]
