"""Filter and verify against the full matrix of Fréchet distances."""

import math

import numpy as np
from pyspark.sql import functions as F

from wayfold import config as C
from wayfold.functions import geo
from wayfold.operators import paths


def nm(p, q):
    a, b, x, y = map(math.radians, (p[0], q[0], p[1], q[1]))
    h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin((y - x) / 2) ** 2
    return 2 * C.EARTH_NM * math.asin(math.sqrt(h))


def frechet(p, q):
    m = np.full((len(p), len(q)), np.inf)
    for i, a in enumerate(p):
        for j, b in enumerate(q):
            before = min([m[i - 1, j] if i else np.inf, m[i, j - 1] if j else np.inf, m[i - 1, j - 1] if i and j else np.inf])
            m[i, j] = max(nm(a, b), before if i or j else 0)
    return m[-1, -1]


def lines(seed=2, routes=4, each=8):
    """Routes of paths with drift, two of them with equal ends, one across the 180th meridian, one near the pole."""
    r, out = np.random.default_rng(seed), {}
    ways = [((30, 34), (33, 36)), ((30, 34), (33, 36)), ((10, 179), (10.5, -179)), ((88.5, 0), (88.5, 120))]
    for k in range(routes):
        (a, b), (y, x) = ways[k]
        x = x + 360 if x - b < -180 else x
        for i in range(each):
            n, bow = int(r.integers(4, 9)), (0.6 if k == 1 else 0.0)
            t = np.linspace(0, 1, n)
            lat = a + (y - a) * t + bow * np.sin(np.pi * t) + r.normal(size=n) * 0.04
            lon = b + (x - b) * t + r.normal(size=n) * 0.04
            out[f"R{k}-{i}"] = [(float(p), float((q + 180) % 360 - 180)) for p, q in zip(lat, lon)]
    out["dot"] = [(30.0, 34.0)]
    out["same"] = out["R0-0"]
    return out


def frame(spark, held):
    return spark.createDataFrame([(k, v) for k, v in held.items()], "id string, centerline array<struct<lat:double,lon:double>>")


def test_similar_paths_equal_the_full_matrix(spark):
    held = lines()
    df = frame(spark, {**held, "none": None, "empty": []})
    full = {(a, b): frechet(held[a], held[b]) for a in held for b in held if a < b}
    for limit in (4.0, 9.0, 40.0):
        got = {(r["id"], r["id2"]): r["nm"] for r in paths.similar_paths(df, limit).collect()}
        assert set(got) == {k for k, d in full.items() if d <= limit}, limit
        assert all(abs(d - full[k]) < 1e-6 for k, d in got.items())
        asked = paths.path_candidates(df, limit)
        assert asked.distinct().count() == asked.count() >= len(got)
    # At 9 nm the ends and extents leave little more than the pairs that are alike.
    assert len(full) == 561 and paths.path_candidates(df, 9.0).count() < 200
    assert got["R0-0", "same"] == 0


def test_distance_with_a_limit_is_exact_below_and_above_it_otherwise(spark):
    held = lines()
    one, two = frame(spark, held), frame(spark, held).select(F.col("id").alias("id2"), F.col("centerline").alias("line2"))
    j = one.join(two, F.col("id") < F.col("id2")).select(geo.frechet_nm("centerline", "line2").alias("d"), geo.frechet_nm("centerline", "line2", 10.0).alias("e"))
    for r in j.collect():
        assert r["d"] == r["e"] if r["d"] <= 10 else r["e"] > 10


def test_no_paths(spark):
    assert paths.similar_paths(frame(spark, {"a": None}), 5.0).count() == 0
