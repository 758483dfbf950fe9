"""The tree of places against brute force over the whole dimension."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from wayfold.operators import nearest, places


def brute(points, dim):
    """Least half chord of each point, and the least ord among places that reach it up to rounding."""
    la, lo = np.radians(dim.lat.to_numpy()), np.radians(dim.lon.to_numpy())
    out = []
    for y, x in points:
        p, q = np.radians(y), np.radians(x)
        a = np.sin((la - p) / 2) ** 2 + np.cos(p) * np.cos(la) * np.sin((lo - q) / 2) ** 2
        out.append((a.min(), set(dim.ord[a <= a.min() + 1e-15])))
    return out


def dimension(n, seed=5):
    """Half of all places within a hundredth of a degree, the rest anywhere on the northern half, some repeated."""
    r = np.random.default_rng(seed)
    lat = np.where(np.arange(n) % 2 == 0, 32 + r.random(n) * 0.01, r.random(n) * 89)
    lon = np.where(np.arange(n) % 2 == 0, 34.99 + r.random(n) * 0.02, r.random(n) * 360 - 180)
    lat[-20:], lon[-20:] = lat[:20], lon[:20]
    return pd.DataFrame({"ord": np.arange(n, dtype="int32"), "code": [f"P{i}" for i in range(n)], "elevation_ft": pd.array([None] * n, "Int32"), "lat": lat, "lon": lon})


def frame(spark, dim):
    return spark.createDataFrame([(int(o), k, None, float(a), float(b)) for o, k, a, b in zip(dim.ord, dim.code, dim.lat, dim.lon)],
                                 "ord int, code string, elevation_ft int, lat double, lon double")


def test_a_hundred_thousand_places_equal_brute_force(spark):
    dim = dimension(100_000)
    r = np.random.default_rng(6)
    pts = [(32.005, 35.0), (32.005, 35.0), (90.0, 0.0), (-90.0, 10.0), (-60.0, 179.99), (-1.0, -180.0), (31.0, 34.0), *zip(dim.lat[-3:], dim.lon[-3:])]
    pts += [(float(a), float(b)) for a, b in zip(r.random(60) * 180 - 90, r.random(60) * 360 - 180)]
    pts += [(32 + float(a) * 0.01, 35 + float(b) * 0.01) for a, b in zip(r.random(30), r.random(30))]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)] + [(-1, None, 3.0)], "id int, lat double, lon double")
    got = {x["id"]: x for x in nearest.nearest_airport(df, frame(spark, dim), inline_rows=0).collect()}
    assert len(got) == len(pts) + 1 and got.pop(-1)["ap_code"] is None
    for i, (a, ords) in enumerate(brute(pts, dim)):
        assert got[i]["ap_code"] == f"P{min(ords)}" or int(got[i]["ap_code"][1:]) in ords, (i, pts[i])
        assert abs(got[i]["ap_nm"] - 2 * 3440.065 * np.arcsin(np.sqrt(a))) < 0.01
    assert got[7]["ap_code"] != "P99997"        # an equal place is named by its least ord


def test_few_places_no_places_and_poles(spark):
    dim = dimension(40, seed=9)
    pos = spark.createDataFrame([(-80.0, 3.0), (10.0, -179.999), (10.0, 180.0), (None, 1.0)], "lat double, lon double")
    places_ = frame(spark, dim).select("ord", "code", F.lit(0).alias("elev"), "lat", "lon")
    got = {(x["lat"], x["lon"]): x["best"] for x in places.nearest_place(pos, places_).collect()}
    assert len(got) == 3
    for (k, b), (a, ords) in zip(sorted(got.items()), brute(sorted(got), dim)):
        assert b["ord"] in ords and abs(b["a"] - a) < 1e-12
    assert places.nearest_place(pos, places_.limit(0)).count() == 0


def test_no_node_holds_more_than_its_children(spark):
    dim = places._with_vectors(frame(spark, dimension(2000)).select("ord", "lat", "lon")).cache()
    above = places.nodes(dim, 0).agg(F.sum("places")).first()[0]
    for level in range(1, len(places.LEVELS)):
        here = places.nodes(dim, level)
        assert here.agg(F.sum("places")).first()[0] == above
        assert here.groupBy("node").count().where("count > 1").count() == 0     # one parent each
