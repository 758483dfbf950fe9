"""Nearest lines against all lines, joins of crowded keys against plain joins."""

import math
import random

from pyspark.sql import functions as F

from wayfold.operators import hotkeys, layers as ly, segments
from wayfold.operators.windows import SLICE


def flat_distance(p, line):
    k = math.cos(math.radians(line[0][0]))
    best = None
    for (a, b), (x, y) in zip(line, line[1:]):
        ay, ax, by, bx = a * 60, b * 60 * k, x * 60, y * 60 * k
        py, px = p[0] * 60, p[1] * 60 * k
        n = (by - ay) ** 2 + (bx - ax) ** 2
        t = 0.0 if n == 0 else max(0.0, min(1.0, ((py - ay) * (by - ay) + (px - ax) * (bx - ax)) / n))
        d = math.hypot(py - ay - t * (by - ay), px - ax - t * (bx - ax))
        best = d if best is None else min(best, d)
    return best


def layer(spark, lines):
    rows = [(i, [tuple(v) for v in line], 5.0) for i, line in lines.items()]
    return spark.createDataFrame(rows, "id string, centerline array<struct<lat:double,lon:double>>, width_nm double")


def test_nearest_line_equals_all_lines(spark):
    rnd = random.Random(4)
    lines = {}
    for i in range(60):         # most in one region, some far off, some at high latitudes, one across half a globe
        lat, lon = (rnd.uniform(28, 34), rnd.uniform(32, 37)) if i < 45 else (rnd.uniform(-89, 89), rnd.uniform(-180, 180))
        lines[f"L{i:02d}"] = [(max(-90, min(90, lat + rnd.uniform(-1, 1) * j)), lon + rnd.uniform(-1, 1) * j) for j in range(rnd.randint(2, 6))]
    lines["W"] = [(10.0, -170.0), (-20.0, 100.0)]
    lines["Z1"] = lines["L03"]                              # the same line twice: the smaller id
    lines["P"] = [(31.0, 35.0)]                             # a point is no line
    lines["D"] = [(33.0, 36.0), (33.0, 36.0)]               # no length
    lines["N"] = [(31.0, None), (32.0, 35.0)]
    points = [(rnd.uniform(28, 34), rnd.uniform(32, 37)) for _ in range(150)] + [(31.0, 35.0)] * 50
    points += [(rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for _ in range(100)] + [(90.0, 0.0), (-90.0, 180.0), (None, 3.0)]
    df = spark.createDataFrame([(f"F{i % 3}", i, *p) for i, p in enumerate(points)], "flight_id string, ts bigint, lat double, lon double")
    got = {r["ts"]: r for r in segments.nearest_line(df, layer(spark, lines), ["flight_id", "ts"]).collect()}
    usable = {i: line for i, line in lines.items() if len(line) > 1 and i != "N"}
    assert len(got) == len(points) - 1
    for i, p in enumerate(points[:-1]):
        want = min((flat_distance(p, line), k) for k, line in usable.items())
        assert math.isclose(got[i]["d"], want[0], rel_tol=1e-9, abs_tol=1e-9), (p, want, got[i])
        assert got[i]["id"] == want[1] or math.isclose(flat_distance(p, usable[got[i]["id"]]), want[0], rel_tol=1e-9, abs_tol=1e-9)
        assert got[i]["id"] != "Z1"


def test_nearest_line_without_lines_or_points(spark):
    points = spark.createDataFrame([("F", 1, 31.0, 35.0)], "flight_id string, ts bigint, lat double, lon double")
    none = layer(spark, {"P": [(31.0, 35.0)]})
    assert segments.nearest_line(points, none, ["flight_id", "ts"]).count() == 0
    some = layer(spark, {"A": [(31.0, 35.0), (32.0, 35.0)]})
    assert segments.nearest_line(points.limit(0), some, ["flight_id", "ts"]).count() == 0


def test_far_points_keep_few_nodes(spark):
    """A dense layer far away: a point meets lines of the cells that may hold the nearest, not all of them."""
    lines = {f"L{i:03d}": [(30 + i % 20 * 0.3, 33 + i // 20 * 0.3), (30.1 + i % 20 * 0.3, 33.1 + i // 20 * 0.3)] for i in range(400)}
    points = spark.createDataFrame([("F", i, -40.0 + i, 100.0) for i in range(20)], "flight_id string, ts bigint, lat double, lon double")
    seen = []
    plain = segments._nearest
    segments._nearest = lambda pairs, *rest: (seen.append(pairs.count()), plain(pairs, *rest))[1]
    try:
        assert segments.nearest_line(points, layer(spark, lines), ["flight_id", "ts"]).count() == 20
    finally:
        segments._nearest = plain
    assert sum(seen) < 20 * 20


def test_crowded_key_is_dealt_and_complete(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"), "id")
    left = left.unionByName(spark.createDataFrame([(None, -1)], "k int, id bigint"))
    right = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).unionByName(
        spark.createDataFrame([(7, 5), (7, 5)], "k bigint, v bigint"))
    hot = hotkeys.hot_keys(left, ["k"], 200)
    assert {r["k"]: r["_parts"] for r in hot.collect()} == {7: 6}
    got = hotkeys.join_hot(left, right, ["k"], 200)
    want = left.join(right, "k")
    rows = lambda df: sorted(map(tuple, df.select("k", "id", "v").collect()))
    assert rows(got) == rows(want)
    assert hotkeys.hot_keys(left.limit(0), ["k"]) is None


def test_points_meet_their_flight_by_slices(spark):
    points = spark.range(9000).select(F.when(F.col("id") % 3 == 0, "A").otherwise(F.concat(F.lit("B"), (F.col("id") % 40).cast("string"))).alias("flight_id"),
                                      (F.col("id") * 20).alias("ts"))
    per = points.groupBy("flight_id").agg(F.min("ts").alias("t0"))
    got = hotkeys.join_by_slice(points, per, 600)
    assert sorted(map(tuple, got.select("flight_id", "ts", "t0").collect())) == sorted(map(tuple, points.join(per, "flight_id").select("flight_id", "ts", "t0").collect()))
    # What meets by flight alone is one row for each slice: a small part of the flight that owns a third of all points.
    slices = points.select("flight_id", F.floor(F.col("ts") / 600).alias(SLICE)).distinct().where("flight_id = 'A'").count()
    assert slices * 9 < points.where("flight_id = 'A'").count()
    near = hotkeys.join_windows(points, per.withColumnRenamed("t0", "center_ts"), 700, 600)
    assert sorted(map(tuple, near.select("flight_id", "ts").collect())) == sorted(
        map(tuple, points.join(per, "flight_id").where("abs(ts - t0) <= 700").select("flight_id", "ts").collect()))


def test_pairs_without_a_match_get_the_whole_layer_in_parts(spark):
    od = spark.createDataFrame([("A", "B"), ("X", "Y"), (None, None)], "origin string, destination string")
    rows = spark.createDataFrame([("1", "A", "B"), ("2", "A", "C"), ("3", "C", "D")], "id string, origin string, destination string")
    got = sorted((r["origin"] or "", r["id"], r["od_filter"]) for r in ly.match_paths(od, rows).collect())
    assert got == sorted([("A", "1", True)] + [(o, i, False) for o in ("X", "") for i in ("1", "2", "3")])
