"""Spherical and planar geometry as Column expressions (no Python evaluation)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfold import config as C


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(float(x))


def half_chord(lat1, lon1, lat2, lon2) -> Column:
    """Squared half chord on the unit sphere: grows with distance, cheap to rank by."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    dlat = F.radians(lat2) - F.radians(lat1)
    dlon = F.radians(lon2) - F.radians(lon1)
    s1, s2 = F.sin(dlat / 2.0), F.sin(dlon / 2.0)
    return s1 * s1 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * s2 * s2


def chord_to_distance(a: Column, radius: float = C.EARTH_NM) -> Column:
    return 2.0 * radius * F.atan2(F.sqrt(a), F.sqrt(F.greatest(1.0 - a, F.lit(0.0))))


def haversine(lat1, lon1, lat2, lon2, radius: float = C.EARTH_NM) -> Column:
    """Great-circle distance; the unit is that of ``radius`` (nautical miles by default)."""
    return chord_to_distance(half_chord(lat1, lon1, lat2, lon2), radius)


def bearing(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing in degrees, 0 up to 360."""
    lat1, lon1, lat2, lon2 = (F.radians(_c(x)) for x in (lat1, lon1, lat2, lon2))
    y = F.sin(lon2 - lon1) * F.cos(lat2)
    x = F.cos(lat1) * F.sin(lat2) - F.sin(lat1) * F.cos(lat2) * F.cos(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def cross_track_nm(olat, olon, dlat, dlon, plat, plon) -> Column:
    """Distance of a point from the great circle through origin and destination."""
    d13 = haversine(olat, olon, plat, plon, 1.0)
    b13 = F.radians(bearing(olat, olon, plat, plon))
    b12 = F.radians(bearing(olat, olon, dlat, dlon))
    s = F.sin(d13) * F.sin(b13 - b12)
    return F.abs(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s))) * C.EARTH_NM)


def destination(lat, lon, bearing_deg, distance_nm) -> Column:
    """Point reached from (lat, lon): struct<lat, lon>."""
    lat1, lon1, brg = (F.radians(_c(x)) for x in (lat, lon, bearing_deg))
    d = _c(distance_nm) / C.NM_PER_KM / C.EARTH_KM
    lat2 = F.asin(F.sin(lat1) * F.cos(d) + F.cos(lat1) * F.sin(d) * F.cos(brg))
    lon2 = lon1 + F.atan2(F.sin(brg) * F.sin(d) * F.cos(lat1), F.cos(d) - F.sin(lat1) * F.sin(lat2))
    return F.struct(F.degrees(lat2).alias("lat"), F.degrees(lon2).alias("lon"))


def heading_delta(h1, h0) -> Column:
    """Signed turn from h0 to h1, -180 up to 180."""
    return F.pmod(_c(h1) - _c(h0) + 540.0, F.lit(360.0)) - 180.0


def heading_diff(h1, h2) -> Column:
    """Unsigned angle between two headings, 0 to 180."""
    d = F.pmod(F.abs(_c(h1) - _c(h2)), F.lit(360.0))
    return F.least(d, 360.0 - d)


def fixed(x) -> Column:
    """Degrees as a whole number of ten-millionths, whose sums don't depend on the order of rows."""
    return F.floor(_c(x) * 1e7 + 0.5)


def mean(x) -> Column:
    """Mean of degrees over a group, the same however its rows are dealt: an exact sum of ``fixed`` values, divided once."""
    return F.sum(fixed(x)) / F.count(_c(x)) / 1e7


def grid(x, step: float) -> Column:
    """Grid centre, halves to even."""
    return F.bround(_c(x) / step) * step


def cell(x, step: float) -> Column:
    """Integer grid index, halves to even."""
    return F.bround(_c(x) / step).cast("int")


def in_box(lat, lon, south: float, north: float, west: float, east: float) -> Column:
    return _c(lat).between(south, north) & _c(lon).between(west, east)


def in_region(lat="lat", lon="lon") -> Column:
    r = C.REGION
    return in_box(lat, lon, r["south"], r["north"], r["west"], r["east"])


def point_in_ring(lat, lon, ring) -> Column:
    """Even-odd ray cast against array<struct<lat, lon>>; the ring may be open or closed."""
    x, y, ring = _c(lat), _c(lon), _c(ring)
    shifted = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    edges = F.arrays_zip(ring.alias("p"), shifted.alias("q"))

    def crosses(e):
        px, py, qx, qy = e["p"]["lat"], e["p"]["lon"], e["q"]["lat"], e["q"]["lon"]
        at = (y - py) * (qx - px) / (qy - py) + px
        return ((y > F.least(py, qy)) & (y <= F.greatest(py, qy)) & (x <= F.greatest(px, qx))
                & (py != qy) & ((px == qx) | (x <= at)))

    n = F.aggregate(edges, F.lit(0), lambda acc, e: acc + F.when(crosses(e), 1).otherwise(0))
    return F.size(ring).__ge__(3) & (n % 2 == 1)


def segment_distance_sampled(plat, plon, a: Column, b: Column) -> Column:
    """Distance to segment a-b taken at its ends and nine points between, great-circle."""
    plat, plon = _c(plat), _c(plon)
    steps = F.array(*[F.lit(i / 10.0) for i in range(11)])
    return F.array_min(F.transform(steps, lambda t: haversine(
        plat, plon, a["lat"] + t * (b["lat"] - a["lat"]), a["lon"] + t * (b["lon"] - a["lon"]))))


def polyline_distance(plat, plon, line) -> Column:
    """Nearest approach to a polyline: struct<distance_nm, position>.

    Flat projection around the first vertex; position runs 0 to 1 along the line.
    """
    plat, plon, line = _c(plat), _c(plon), _c(line)
    k = F.cos(F.radians(line[0]["lat"]))
    py, px = plat * 60.0, plon * 60.0 * k
    pairs = F.arrays_zip(F.slice(line, 1, F.size(line) - 1).alias("p"),
                         F.slice(line, 2, F.size(line) - 1).alias("q"))

    def measure(e):
        ay, ax = e["p"]["lat"] * 60.0, e["p"]["lon"] * 60.0 * k
        dy, dx = (e["q"]["lat"] - e["p"]["lat"]) * 60.0, (e["q"]["lon"] - e["p"]["lon"]) * 60.0 * k
        len2 = dy * dy + dx * dx
        t = F.when(len2 == 0, F.lit(0.0)).otherwise(
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((py - ay) * dy + (px - ax) * dx) / len2)))
        ey, ex = py - (ay + t * dy), px - (ax + t * dx)
        return F.struct(F.sqrt(ey * ey + ex * ex).alias("d"), t.alias("t"), F.sqrt(len2).alias("len"))

    # One pass over measured segments: least distance so far, where it lies, length walked.
    start = F.struct(F.lit(float("inf")).alias("d"), F.lit(0.0).alias("at"), F.lit(0.0).alias("len"))

    def walk(acc, s):
        nearer = s["d"] < acc["d"]
        return F.struct(F.when(nearer, s["d"]).otherwise(acc["d"]).alias("d"),
                        F.when(nearer, acc["len"] + s["t"] * s["len"]).otherwise(acc["at"]).alias("at"),
                        (acc["len"] + s["len"]).alias("len"))

    def finish(acc):
        return F.struct(acc["d"].alias("distance_nm"),
                        (acc["at"] / F.when(acc["len"] == 0, F.lit(1.0)).otherwise(acc["len"])).alias("position"))

    return F.when(F.size(line) >= 2, F.aggregate(F.transform(pairs, measure), start, walk, finish))


def corridor(line, radius_nm) -> Column:
    """Closed ring around a path: left side out, right side back."""
    line, r = _c(line), _c(radius_nm)
    n = F.size(line)

    def heading(i):
        a = F.when(i < n - 1, i).otherwise(i - 1)
        p, q = line[a], line[a + 1]
        return bearing(p["lat"], p["lon"], q["lat"], q["lon"])

    left = F.transform(line, lambda p, i: destination(p["lat"], p["lon"], heading(i) - 90.0, r))
    right = F.transform(line, lambda p, i: destination(p["lat"], p["lon"], heading(i) + 90.0, r))
    return F.when(n >= 2, F.concat(left, F.reverse(right), F.slice(left, 1, 1)))


def circle(lat, lon, radius_nm, n: int = 12) -> Column:
    """Closed flat circle of n vertices, radius in degrees of 60 nm, widened by latitude."""
    lat, lon, r = _c(lat), _c(lon), _c(radius_nm) / 60.0
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.struct(
        (lat + r * F.cos(F.radians(i % n * (360.0 / n)))).alias("lat"),
        (lon + r * F.sin(F.radians(i % n * (360.0 / n))) / F.cos(F.radians(lat))).alias("lon")))


def expand_ring(ring, buffer_nm) -> Column:
    """Push every vertex away from the vertex mean by buffer_nm (60 nm per degree)."""
    ring, b = _c(ring), _c(buffer_nm) / 60.0
    n = F.size(ring)
    clat = F.aggregate(ring, F.lit(0.0), lambda s, p: s + p["lat"]) / n
    clon = F.aggregate(ring, F.lit(0.0), lambda s, p: s + p["lon"]) / n

    def push(p):
        dy, dx = p["lat"] - clat, p["lon"] - clon
        d = F.sqrt(dy * dy + dx * dx)
        grow = F.when(d > 0, (d + b) / d).otherwise(F.lit(1.0))
        return F.struct((clat + dy * grow).alias("lat"), (clon + dx * grow).alias("lon"))

    return F.transform(ring, push)


def frechet_nm(path_a, path_b, limit: float | None = None) -> Column:
    """Discrete Fréchet distance of two short waypoint arrays, one DP row at a time.

    With a limit, rows after one that exceeds it throughout are not computed; the result is then some value above the limit.
    """
    a, b = _c(path_a), _c(path_b)

    def row(prev, p):
        # prev is the finished row above (empty for the first waypoint of a).
        def cell_(acc, j):
            d = haversine(p["lat"], p["lon"], b[j]["lat"], b[j]["lon"])
            up = F.when(F.size(prev) > 0, prev[j])
            diag = F.when((F.size(prev) > 0) & (j > 0), prev[F.greatest(j - 1, F.lit(0))])
            left = F.when(j > 0, acc[F.greatest(j - 1, F.lit(0))])
            reach = F.least(up, diag, left)
            return F.concat(acc, F.array(F.greatest(d, F.coalesce(reach, d))))

        whole = F.aggregate(F.sequence(F.lit(0), F.size(b) - 1),
                            F.array().cast("array<double>"), cell_)
        return whole if limit is None else F.when(F.array_min(prev) > limit, prev).otherwise(whole)

    last = F.aggregate(a, F.array().cast("array<double>"), row)
    return F.element_at(last, -1)
