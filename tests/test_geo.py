import math
import random

import pytest
from pyspark.sql import functions as F

from wayfold import config as C
from wayfold.functions import geo
from wayfold.operators import clusters, nearest, sweep
from tests.conftest import T0, airports


def hav(a, b, c, d, r=C.EARTH_NM):
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * r * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def ring(pts):
    return F.array(*[F.struct(F.lit(float(a)).alias("lat"), F.lit(float(b)).alias("lon")) for a, b in pts])


def test_haversine_symmetric_and_zero(spark):
    assert one(spark, geo.haversine(31.0, 34.0, 31.0, 34.0)) == 0
    x, y = one(spark, geo.haversine(31.0, 34.0, 35.0, 30.0)), one(spark, geo.haversine(35.0, 30.0, 31.0, 34.0))
    assert abs(x - y) < 1e-9 and abs(x - hav(31, 34, 35, 30)) < 1e-9


def test_destination_and_bearing_agree(spark):
    d = one(spark, geo.destination(31.0, 34.0, 40.0, 25.0))
    assert abs(hav(31, 34, d["lat"], d["lon"]) - 25) < 1e-6
    assert abs(one(spark, geo.bearing(31.0, 34.0, d["lat"], d["lon"])) - 40) < 1e-6


def test_ring_and_polyline(spark):
    sq = ring([(0, 0), (0, 2), (2, 2), (2, 0)])
    assert one(spark, geo.point_in_ring(1.0, 1.0, sq)) and not one(spark, geo.point_in_ring(3.0, 1.0, sq))
    m = one(spark, geo.polyline_distance(1.0, 1.0, ring([(0, 0), (0, 2), (2, 2)])))
    assert abs(m["distance_nm"] - 60) < 0.1 and abs(m["position"] - 0.25) < 1e-3


def test_corridor_is_closed_around_path(spark):
    r = one(spark, geo.corridor(ring([(31, 33), (31.5, 33.5), (32, 34)]), F.lit(8.0)))
    assert len(r) == 7 and r[0] == r[-1]
    assert one(spark, geo.point_in_ring(31.5, 33.5, ring([(p["lat"], p["lon"]) for p in r])))


def test_frechet_matches_dynamic_programme(spark):
    a, b = [(30, 33), (30.5, 33.4), (31, 34)], [(30.1, 33), (30.4, 33.6), (31, 33.9), (31.2, 34.1)]
    ca = [[0.0] * len(b) for _ in a]
    for i, p in enumerate(a):
        for j, q in enumerate(b):
            d = hav(*p, *q)
            prev = [ca[x][y] for x, y in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if x >= 0 and y >= 0]
            ca[i][j] = max(d, min(prev)) if prev else d
    assert abs(one(spark, geo.frechet_nm(ring(a), ring(b))) - ca[-1][-1]) < 1e-9


def test_nearest_by_cells_equals_inline(spark):
    r = random.Random(5)
    aps = airports(spark, [(f"A{i}", r.uniform(-60, 60), r.uniform(-180, 180), i) for i in range(40)])
    pts = spark.createDataFrame([(i, r.uniform(-80, 80), r.uniform(-180, 180)) for i in range(200)], "id int, lat double, lon double")
    a = {x["id"]: (x["ap_code"], round(x["ap_nm"], 6)) for x in nearest.nearest_airport(pts, aps).collect()}
    b = {x["id"]: (x["ap_code"], round(x["ap_nm"], 6)) for x in nearest.nearest_airport(pts, aps, inline_rows=0).collect()}
    assert a == b


@pytest.mark.parametrize("hot, chunk, pairs", [(20_000, 131_072, 1 << 20), (3, 50, 7), (20_000, 1, 1)])
def test_sweep_equals_brute_force(spark, monkeypatch, hot, chunk, pairs):
    """Half of all points in one cell, groups split, and chunks that cut groups apart."""
    monkeypatch.setattr(sweep, "CHUNK", chunk)
    monkeypatch.setattr(sweep, "PAIRS", pairs)
    r = random.Random(6)
    spread = [(f"F{i % 7}", T0 + r.randint(0, 200), r.choice((-50, 0, 31, 70)) + r.uniform(-0.5, 0.5), 34 + r.uniform(-0.8, 0.8)) for i in range(200)]
    tight = [(f"F{i % 9}", T0 + r.randint(0, 60), 31 + r.uniform(0, 0.1), 34 + r.uniform(0, 0.1)) for i in range(200)]
    rows = [(*x, r.choice((9000.0, 9500.0, 12_000.0)), "AB"[int(x[0][1]) % 2]) for x in sorted(set(spread + tight))]
    null = [(None, T0, 31.0, 34.0, 1.0, "A"), ("F1", T0 + 1, None, 34.0, 1.0, "A")]
    df = spark.createDataFrame(rows + null, "flight_id string, ts bigint, lat double, lon double, alt double, country string")
    near = [(a, b) for a in rows for b in rows if a[0] != b[0] and abs(a[1] - b[1]) <= 5 and hav(a[2], a[3], b[2], b[3]) <= 4]
    ids = ["a_flight_id", "a_ts", "a_lat", "b_flight_id", "b_ts", "b_lat"]
    got = sweep.near_swept(df, df, 4, 5, hot=hot)
    assert got.columns == [*(f"{s}_{x}" for s in "ab" for x in df.columns), "nm"]
    assert sorted(map(tuple, got.select(*ids).collect())) == sorted((*a[:3], *b[:3]) for a, b in near) and len(near) > 500
    low = [(a, b) for a, b in near if abs(a[4] - b[4]) <= 999]
    first = {}
    for a, b in sorted(low, key=lambda p: (p[0][1], p[0][0], p[0][2], p[1][1], p[1][0])):
        first.setdefault(a, (b[1], b[0]))
    got = sweep.near_swept(df, df, 4, 5, 999, best="point", hot=hot).collect()
    assert sorted((x.a_flight_id, x.a_ts, x.a_lat, x.b_ts, x.b_flight_id) for x in got) == sorted((*a[:3], *v) for a, v in first.items())
    pair = {}
    for a, b in near:
        if a[0] < b[0] and a[5] != b[5]:
            k = (a[0], b[0])
            pair[k] = min(pair.get(k, 99), hav(a[2], a[3], b[2], b[3]))
    got = sweep.near_swept(df, df, 4, 5, differ="country", ordered=True, best="flights", hot=hot).groupBy("a_flight_id", "b_flight_id").min("nm").collect()
    assert {(x[0], x[1]): round(x[2], 6) for x in got} == {k: round(v, 6) for k, v in pair.items()}
    assert sweep.near_swept(df.limit(0), df, 4, 5).collect() == []


def test_components_and_planar_clusters(spark):
    nodes = spark.createDataFrame([(f"n{i:02d}",) for i in range(12)], "id string")
    edges = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(8)], "src string, dst string")
    got = {x["id"]: x["component"] for x in clusters.components(nodes, edges).collect()}
    assert {got[f"n{i:02d}"] for i in range(9)} == {"n00"} and got["n10"] == "n10"
    r = random.Random(7)
    pts = [(r.uniform(30, 33), r.uniform(33, 36)) for _ in range(120)]
    label = list(range(len(pts)))
    for _ in pts:
        for i, p in enumerate(pts):
            for j, q in enumerate(pts):
                if (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 <= 0.2 ** 2:
                    label[i] = label[j] = min(label[i], label[j])
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "n int, lat double, lon double")
    res = {x["n"]: x["component"] for x in clusters.planar_clusters(df, 0.2).collect()}
    same = lambda f: {frozenset(i for i in range(len(pts)) if f[i] == v) for v in set(f[i] for i in range(len(pts)))}
    assert same(res) == same(label)


def test_hull_in_parts_equals_whole(spark):
    r = random.Random(8)
    df = spark.createDataFrame([("k", r.gauss(31, 1), r.gauss(34, 1)) for _ in range(400)], "key string, lat double, lon double")
    a = clusters.hulls(df, "key").first()["ring"]
    b = clusters.hulls(df, "key", chunk=25).first()["ring"]
    assert set(map(tuple, a)) == set(map(tuple, b)) and len(a) >= 3
