"""Geometry by place: kernels against the Column expressions, places against points."""

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import T0
from wayfold.functions import geo
from wayfold.operators import layers as ly, shapes
from wayfold.operators.hotkeys import by_place

c = F.col


def shapes_frame(spark):
    r = random.Random(3)
    at = lambda: (float(r.randint(0, 6)), float(r.randint(0, 6)))      # on corners and sides too
    rows = [(i, *at(), [at() for _ in range(r.randint(1, 7))]) for i in range(600)]
    return spark.createDataFrame(rows, "i long, lat double, lon double, v array<struct<lat:double,lon:double>>")


@pytest.mark.parametrize("cells", [1 << 20, 20])
def test_kernels_equal_expressions(spark, monkeypatch, cells):
    monkeypatch.setattr(shapes, "CELLS", cells)
    df = shapes_frame(spark)
    want = {r.i for r in df.where(geo.point_in_ring("lat", "lon", "v")).collect()}
    assert {r.i for r in shapes.in_ring(df, "v").collect()} == want and len(want) > 50
    m = geo.polyline_distance("lat", "lon", "v")
    want = {r.i: (r.d, r.pos) for r in df.select("i", m["distance_nm"].alias("d"), m["position"].alias("pos")).collect()}
    assert {r.i: (r.d, r.pos) for r in shapes.measured(df, "v").collect()} == want
    s = df.where(F.size("v") >= 2).select("i", "lat", "lon", c("v")[0].alias("p"), c("v")[1].alias("q"))
    want = {r.i for r in s.where(geo.segment_distance_sampled("lat", "lon", c("p"), c("q")) <= 50).collect()}
    assert {r.i for r in shapes.near_side(s, 50).collect()} == want and want


def test_each_place_is_worked_out_once(spark):
    pts = spark.createDataFrame([(f"F{i % 50}", T0 + i, float(i % 3), 0.0) for i in range(900)], "flight_id string, ts long, lat double, lon double")
    seen = []

    def find(places):
        seen.append(places.count())
        return places.withColumn("v", c("lat") * 2)

    got = by_place(pts, ["lat", "lon"], find, least=100).collect()      # crowded places, so their points are dealt
    assert seen == [3] and len(got) == 900 and all(x.v == 2 * x.lat for x in got)


def test_points_in_a_tube_whatever_their_number_at_a_place(spark):
    ring = [(30.0, 30.0), (30.0, 31.0), (31.0, 31.0), (31.0, 30.0), (30.0, 30.0)]
    tubes = spark.createDataFrame([("T", ring, 0.0, 9000.0)], "id string, ring array<struct<lat:double,lon:double>>, min_alt_ft double, max_alt_ft double")
    places = [(30.5, 30.5, 1000.0), (30.5, 30.5, None), (30.5, 30.5, 99_000.0), (31.05, 30.5, 0.0), (31.2, 30.5, 0.0), (None, 30.5, 0.0)]
    pts = spark.createDataFrame([(f"F{k}", T0, *p) for k, p in enumerate(places * 20)], "flight_id string, ts long, lat double, lon double, alt double")
    got = sorted(r.flight_id for r in ly.tube_membership(pts, tubes).collect())
    assert got == sorted(f"F{k}" for k in range(len(pts.collect())) if k % 6 in (0, 1, 3))


def test_marks_keep_points_without_a_position(spark):
    path = spark.createDataFrame([([(30.0, 30.0), (31.0, 30.0)], 8.0)], "centerline array<struct<lat:double,lon:double>>, width_nm double")
    zone = spark.createDataFrame([("Z", 40.0, 40.0, 4.0)], "id string, lat double, lon double, radius_nm double")
    pts = spark.createDataFrame([("A", T0, 30.5, 30.0), ("B", T0, 30.5, 30.0), ("C", T0, 40.0, 40.0), ("D", T0, None, 30.0), ("E", T0, 50.0, 50.0)],
                                "flight_id string, ts long, lat double, lon double")
    got = {r.flight_id: (r.in_turn, r.known_place) for r in ly.mark_known_places(pts, path, path.limit(0), zone).collect()}
    assert got == {"A": (False, True), "B": (False, True), "C": (True, True), "D": (False, False), "E": (False, False)}
