"""Rules at their thresholds and one step to either side."""

import math

from pyspark.sql import functions as F

from wayfold.operators import rules as ru, sequence as sq, turns
from tests.conftest import T0, airports, track


def test_signal_gap_300_and_301(spark):
    t = track(spark, [{"ts": T0}, {"ts": T0 + 300}, {"ts": T0 + 601}])
    assert [x["gap_s"] for x in sq.signal_gaps(t).collect()] == [301]
    assert sorted(x["gap_s"] for x in sq.signal_gaps(t, inclusive=True).collect()) == [300, 301]


def test_signal_loss_needs_two_gaps(spark):
    one = track(spark, [{"ts": T0}, {"ts": T0 + 180}, {"ts": T0 + 200}])
    two = track(spark, [{"ts": T0}, {"ts": T0 + 180}, {"ts": T0 + 360}])
    ap = airports(spark)
    assert ru.signal_loss(ru.enrich(one, ap)).count() == 0
    assert ru.signal_loss(ru.enrich(two, ap)).count() == 2


def test_altitude_change_and_noise_run(spark):
    ap = airports(spark)
    step = lambda d: track(spark, [{"ts": T0 + 40 * i, "lat": 31 + i * 0.01, "alt": a} for i, a in enumerate([30000.0, 30000.0 - d, 30000.0 - d])])
    assert ru.altitude_change(ru.enrich(step(4000.0), ap)).count() == 1
    assert ru.altitude_change(ru.enrich(step(3999.0), ap)).count() == 0
    # Down to 400 ft and back within the climb limit of 200 ft/s: a false reading of two points.
    alts = [10400.0, 10400.0, 400.0, 400.0, 10400.0, 10400.0]
    run = track(spark, [{"ts": T0 + 55 * i, "lat": 31 + i * 0.01, "alt": a, "gspeed": 150.0} for i, a in enumerate(alts)])
    assert ru.altitude_change(ru.enrich(run, ap)).count() == 0
    single = track(spark, [{"ts": T0 + 55 * i, "lat": 31 + i * 0.01, "alt": a, "gspeed": 150.0} for i, a in enumerate([10400.0, 10400.0, 400.0, 10400.0, 10400.0])])
    assert ru.altitude_change(ru.enrich(single, ap)).count() == 1


def test_proximity_limits(spark):
    ap = airports(spark)

    def hits(dt, ft):
        rows = [{"flight_id": f, "ts": T0 + s, "lat": 31 + (s - off) * 0.0005, "alt": a}
                for f, off, a in (("F1", 0, 20000.0), ("F2", dt, 20000.0 + ft)) for s in (off, off + 30, off + 60)]
        t = track(spark, rows)
        return ru.proximity(ru.enrich(t, ap), t).count()

    assert hits(5, 999.0) == 6
    assert hits(6, 999.0) == 0 and hits(5, 1000.0) == 0


def test_impossible_point_ends_are_never_ruled_out(spark):
    t = track(spark, [{"ts": T0}, {"ts": T0 + 20, "lat": 33.0}, {"ts": T0 + 40}])
    got = {x["ts"] - T0: x["impossible"] for x in ru.enrich(t, airports(spark)).collect()}
    assert got == {0: False, 20: True, 40: False}


def circle(n, dt, turn, kt=220.0, lat=31.0, lon=32.0, start=T0):
    rows, la, lo, h = [], lat, lon, 0.0
    for i in range(n):
        rows.append({"ts": start + i * dt, "lat": la, "lon": lo, "track": h % 360, "gspeed": kt, "alt": 15000.0})
        d = kt * dt / 3600 / 60
        la += d * math.cos(math.radians(h + turn / 2))
        lo += d * math.sin(math.radians(h + turn / 2)) / math.cos(math.radians(la))
        h += turn
    return rows


def turn_rows(spark, rows):
    p = ru.enrich(track(spark, rows), airports(spark)).withColumns({"in_turn": F.lit(False), "known_place": F.lit(False)})
    return turns.turn_events(p).collect()


def test_orbit_is_found_and_straight_flight_is_not(spark):
    straight = [{"ts": T0 + 5 * i, "lat": 31 + 220 * 5 * i / 3600 / 60, "lon": 32.0, "track": 0.0, "gspeed": 220.0, "alt": 15000.0} for i in range(60)]
    assert turn_rows(spark, straight) == []
    got = turn_rows(spark, circle(60, 5, 15.0))
    assert got and {r["pattern"] for r in got} <= {"orbit", "half_turn"}
    assert any(r["turn_deg"] >= 220 for r in got)


def test_sparse_loop_needs_the_looser_scan(spark):
    got = turn_rows(spark, circle(16, 14, 28.0))
    assert [r["pattern"] for r in got] == ["loop"]


def test_confidence_gate(spark):
    df = spark.createDataFrame([("a", True, False, False, False, False, False), ("b", False, True, True, True, True, True)],
                               "flight_id string, rules boolean, xgboost boolean, cnn boolean, dense boolean, transformer boolean, hybrid boolean")
    got = {x["flight_id"]: (x["confidence_score"], x["is_anomaly"]) for x in ru.confidence(df).collect()}
    assert got == {"a": (100.0, True), "b": (41.67, False)}


def test_turn_rows_do_not_depend_on_partitions(spark):
    rows = circle(60, 5, 15.0)
    a = sorted(map(tuple, turn_rows(spark, rows)))
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    b = sorted(map(tuple, turn_rows(spark, rows)))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert a == b


def test_places_of_any_number(spark):
    """The join on cells agrees with the expression, and so do 10,000 places with brute force."""
    import random
    from wayfold.operators.nearest import away_from
    r = random.Random(1)
    pts = [(f"F{i}", T0 + i, r.uniform(-70, 70), r.uniform(-170, 170)) for i in range(1500)]
    places = [(i, f"A{i}", r.uniform(-70, 70), r.uniform(-170, 170), 10) for i in range(10_000)]
    df = spark.createDataFrame(pts, "flight_id string, ts bigint, lat double, lon double")
    ap = spark.createDataFrame(places, "ord int, code string, lat double, lon double, elevation_ft int")
    few = ap.where("ord < 60")
    ids = lambda x: sorted(y.flight_id for y in x.select("flight_id").collect())
    assert ids(away_from(df, few, 300)) == ids(away_from(df, few, 300, inline_rows=0))

    def nm(a, b, p, q):
        a, b, p, q = map(math.radians, (a, b, p, q))
        return 2 * 6371.0 * 0.539957 * math.asin(math.sqrt(math.sin((p - a) / 2) ** 2 + math.cos(a) * math.cos(p) * math.sin((q - b) / 2) ** 2))

    want = sorted(i for i, _, a, b in pts if not any(abs(a - p) < 1 and nm(a, b, p, q) <= 30 for _, _, p, q, _ in places))
    assert ids(away_from(df, ap, 30)) == want and 0 < len(want) < len(pts)
    key = lambda x: sorted((y.flight_id, y.airport) for y in x.collect())
    got = key(ru.near_airports(df, ap, 30, ["flight_id"]))
    assert got == sorted((i, code) for i, _, a, b in pts for _, code, p, q, _ in places if abs(a - p) < 1 and nm(a, b, p, q) <= 30)
    assert key(ru.near_airports(df, few, 300, ["flight_id"])) == key(ru.near_airports(df, few, 300, ["flight_id"], inline_rows=0))


def test_upsert_moves_a_key_between_partitions(spark):
    from wayfold.sources import sinks
    from wayfold.storage import new_path
    path = new_path(spark, "merge-test")
    rows = lambda *x: spark.createDataFrame(list(x), "k string, v int, part string")
    sinks.merge_table(spark, path, rows(("f1", 1, "A"), ("f2", 1, "B"), ("f3", 1, "B")), ["k"], ["v"], "part")
    sinks.merge_table(spark, path, rows(("f1", 2, "B")), ["k"], ["v"], "part")
    assert sorted((r.k, r.v, r.part) for r in spark.read.parquet(path).collect()) == [("f1", 2, "B"), ("f2", 1, "B"), ("f3", 1, "B")]
    sinks.insert_table(spark, path, rows(("f2", 9, "C"), ("f4", 1, "C")), ["k"], "part")
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == ["f1", "f2", "f3", "f4"]
