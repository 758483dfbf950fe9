"""Clusters by chain distance, hulls, and zone statistics over them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions import geo, keys
from wayfold.operators.windows import cut
from wayfold.storage import written

c = F.col


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Connected components: (id, component), the component named by its least id.

    Each round points every node that still has edges to its least neighbour, follows the pointers to their ends, and
    replaces the ends of all edges by these. Edges inside a component vanish, and at least half of the nodes with
    edges do, so there are few rounds over ever fewer edges. ``edges``: (src, dst), either direction. Between steps
    tables are written to the shared folder; one flag for each step reaches the driver.
    """
    ordered = lambda df: df.where(c("src") != c("dst")).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    live = written(ordered(edges), "edges")
    named = nodes.select("id", c("id").alias("component"))
    while live.limit(1).count():
        both = live.unionByName(live.select(c("dst").alias("src"), c("src").alias("dst")))
        ends = written(both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("end")), "ends")
        while True:
            after = ends.select(c("src").alias("end"), c("end").alias("further"))
            ends = written(ends.join(after, "end").select("src", c("further").alias("end"), (c("further") != c("end")).alias("moved")), "ends")
            if not ends.where("moved").limit(1).count():
                break
        ends = ends.select("src", "end")
        dst = ends.select(c("src").alias("dst"), c("end").alias("dst_end"))
        live = written(ordered(live.join(ends, "src").join(dst, "dst").select(c("end").alias("src"), c("dst_end").alias("dst"))), "edges")
        step = ends.select(c("src").alias("component"), "end")
        named = written(named.join(step, "component", "left").select("id", F.coalesce("end", "component").alias("component")), "named")
    return named


def cell_edges(points: DataFrame, nm: float) -> DataFrame:
    """Pairs of points at most nm apart. ``points``: id, lat, lon, at most one per fine grid cell.

    Inputs are cell centroids, so the points per bucket are bounded by the grid.
    """
    g = nm / 59.5
    wide = lambda band: g / F.cos(F.radians(F.least(F.abs(band) + 2, F.lit(88))))
    a = points.select(c("id").alias("src"), c("lat").alias("alat"), c("lon").alias("alon")).withColumns({"_b": F.floor("alat"), "_y": F.floor(c("alat") / g)})
    a = a.withColumn("_x", F.floor(c("alon") / wide(c("_b"))))
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    b = points.select(c("id").alias("dst"), "lat", "lon")
    b = b.withColumn("_b", F.explode(F.array_distinct(F.array(F.floor(c("lat") - g), F.floor("lat"), F.floor(c("lat") + g)))))
    b = b.withColumn("_y", F.explode(F.transform(near, lambda d: F.floor(c("lat") / g) + d)))
    b = b.withColumn("_x", F.explode(F.transform(near, lambda d: F.floor(c("lon") / wide(c("_b"))) + d)))
    j = a.join(b, ["_b", "_y", "_x"]).where((c("src") < c("dst")) & (geo.haversine("alat", "alon", "lat", "lon") <= nm))
    return j.select("src", "dst")


def chain_clusters(points: DataFrame, nm: float) -> DataFrame:
    """Label points (id, lat, lon, ...) with the chain cluster they belong to."""
    pts = cut(points)
    return pts.join(components(pts, cell_edges(pts, nm)), "id")


# -- planar clusters of raw points, without pairing the points of a crowded place
def planar_clusters(points: DataFrame, reach_deg: float) -> DataFrame:
    """Label raw points (lat, lon, ...) joined by steps of at most reach_deg, flat distance.

    Points in one small cell (diagonal below the reach) belong together anyway, so cells
    are the nodes. Two cells are linked if some pair of their points is close enough:
    decided from tight boxes of 8 x 8 sub-cells; only sub-cell pairs whose boxes leave it
    open are compared point by point, on distinct positions.
    """
    side = reach_deg / 1.4143
    sub = side / 8
    base = points.withColumns({"_cy": F.floor(c("lat") / side), "_cx": F.floor(c("lon") / side)}).withColumn("id", F.concat_ws(":", "_cy", "_cx"))
    base = cut(base)
    box = base.groupBy("id", "_cy", "_cx", F.floor(c("lat") / sub).alias("sy"), F.floor(c("lon") / sub).alias("sx")).agg(
        F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"))
    around = F.explode(F.sequence(F.lit(-2), F.lit(2)))
    a = box.select(*[c(x).alias(f"a_{x}") for x in ("id", "sy", "sx", "s", "n", "w", "e")], "_cy", "_cx")
    b = (box.withColumn("_dy", around).withColumn("_dx", around)
         .select(*[c(x).alias(f"b_{x}") for x in ("id", "sy", "sx", "s", "n", "w", "e")], (c("_cy") + c("_dy")).alias("_cy"), (c("_cx") + c("_dx")).alias("_cx")))
    j = a.join(b, ["_cy", "_cx"]).where(c("a_id") < c("b_id"))
    gap = lambda lo, hi: F.greatest(F.lit(0.0), c(f"a_{lo}") - c(f"b_{hi}"), c(f"b_{lo}") - c(f"a_{hi}"))
    span = lambda lo, hi: F.greatest(c(f"a_{hi}") - c(f"b_{lo}"), c(f"b_{hi}") - c(f"a_{lo}"))
    r2 = reach_deg * reach_deg
    near2 = gap("s", "n") * gap("s", "n") + gap("w", "e") * gap("w", "e")
    far2 = span("s", "n") * span("s", "n") + span("w", "e") * span("w", "e")
    j = cut(j.where(near2 <= r2).select("a_id", "b_id", "a_sy", "a_sx", "b_sy", "b_sx", (far2 <= r2).alias("sure")))
    sure = j.where("sure").select(c("a_id").alias("src"), c("b_id").alias("dst")).distinct()
    openq = j.where(~c("sure")).join(sure, (c("a_id") == c("src")) & (c("b_id") == c("dst")), "left_anti")
    pos = base.select("lat", "lon", F.floor(c("lat") / sub).alias("sy"), F.floor(c("lon") / sub).alias("sx")).distinct()
    pa = pos.select(c("sy").alias("a_sy"), c("sx").alias("a_sx"), c("lat").alias("alat"), c("lon").alias("alon"))
    pb = pos.select(c("sy").alias("b_sy"), c("sx").alias("b_sx"), c("lat").alias("blat"), c("lon").alias("blon"))
    dy, dx = c("alat") - c("blat"), c("alon") - c("blon")
    exact = (openq.join(pa, ["a_sy", "a_sx"]).join(pb, ["b_sy", "b_sx"]).where(dy * dy + dx * dx <= r2)
             .select(c("a_id").alias("src"), c("b_id").alias("dst")).distinct())
    nodes = base.select("id").distinct()
    return base.join(components(nodes, sure.unionByName(exact)), "id").drop("_cy", "_cx", "id")


# -- hulls
def _hull_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    ring = _chain(pdf[["lon", "lat"]].to_numpy(float))
    return pd.DataFrame({"key": pdf["key"].iloc[0], "pos": np.arange(len(ring)), "lon": ring[:, 0], "lat": ring[:, 1]})


def _chain(xy: np.ndarray) -> np.ndarray:
    """Hull of (lon, lat) rows, counter-clockwise, without the closing vertex."""
    pts = np.unique(xy, axis=0)
    if len(pts) < 3:
        return pts

    def half(seq):
        out = []
        for p in seq:
            while len(out) > 1:
                a, b = out[-2], out[-1]
                if (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) > 0:
                    break
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(list(pts)) + half(list(pts[::-1])))


def hulls(points: DataFrame, key: str, chunk: int = 20_000) -> DataFrame:
    """Convex hull per key: (key, ring array<struct<lat, lon>>).

    A large cluster is split by hash into parts of about ``chunk`` points; the hull of the
    part hulls is the hull of the whole, and part hulls are small.
    """
    p = points.select(c(key).cast("string").alias("key"), "lat", "lon").where("lat is not null and lon is not null").distinct()
    size = p.groupBy("key").agg(F.ceil(F.count("*") / chunk).cast("int").alias("_s"))
    schema = "key string, pos bigint, lon double, lat double"
    part = (p.join(size, "key").withColumn("_salt", F.pmod(F.xxhash64("lat", "lon"), c("_s")).cast("int"))
            .groupBy("key", "_salt").applyInPandas(_hull_rows, schema))
    whole = part.groupBy("key").applyInPandas(_hull_rows, schema)
    ring = F.transform(F.array_sort(F.collect_list(F.struct("pos", "lat", "lon"))), lambda s: F.struct(s["lat"].alias("lat"), s["lon"].alias("lon")))
    return whole.groupBy(c("key").alias(key)).agg(ring.alias("ring"))


# -- statistics over clusters
def cluster_table(labelled: DataFrame, min_points: int = 2) -> DataFrame:
    """Clusters of loss cells: (component) with centroid and totals; cells carry count, affected_flights, avg_duration."""
    return (labelled.groupBy("component")
            .agg(F.count("*").alias("point_count"), F.sum("count").alias("total_events"), F.sum("affected_flights").alias("affected_flights"),
                 F.round(F.avg("avg_duration"), 3).alias("avg_duration"), F.round(F.avg("lat"), 4).alias("lat"), F.round(F.avg("lon"), 4).alias("lon"))
            .where(c("point_count") >= min_points))


def interference_clusters(cells: DataFrame, nm: float = 50.0, min_points: int = 3) -> DataFrame:
    """Chain clusters of interference cells: (component) with centroid and totals; a cell counts one event for each flight."""
    points = cells.withColumn("id", F.concat_ws(":", "lat", "lon"))
    return (chain_clusters(points, nm).groupBy("component")
            .agg(F.count("*").alias("point_count"), F.sum("affected_flights").alias("total_events"), F.sum("affected_flights").alias("affected_flights"),
                 F.round(F.avg("intensity"), 2).alias("avg_intensity"), F.round(F.avg("lat"), 4).alias("lat"), F.round(F.avg("lon"), 4).alias("lon"))
            .where(c("point_count") >= min_points))


def gap_zones(gaps: DataFrame, buffer_nm: float = 10.0, merge_nm: float = 5.0, min_events: int = 2) -> DataFrame:
    """Zones of gap starts: counts, risk, buffer by gap length, outline pushed outwards."""
    z = planar_clusters(gaps.select("flight_id", "gap_start", "gap_s", "lat", "lon"), (2 * buffer_nm + merge_nm) / 60.0)
    g = c("gap_s")
    buf = F.when(g < 900, buffer_nm).when(g < 1800, buffer_nm * 1.5).when(g < 3600, buffer_nm * 2.0).otherwise(buffer_nm * 2.5)
    z = cut(z.withColumn("_buf", buf))
    s = (z.groupBy("component").agg(F.count("*").alias("event_count"), F.count_distinct("flight_id").alias("affected_flights"),
                                    F.avg("gap_s").alias("_g"), F.max("gap_s").alias("max_gap_s"), F.max("_buf").alias("buffer_nm"), F.avg("_buf").alias("_ab"),
                                    F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.min("gap_start").alias("first_seen"), F.max("gap_start").alias("last_seen"))
         .where(c("event_count") >= min_events))
    risk = F.least(F.lit(100.0), F.least(F.lit(50), c("event_count") * 5) + F.least(F.lit(30.0), c("_g") / 1800 * 30) + F.least(F.lit(20), c("affected_flights") * 2))
    h = hulls(z.join(s.select("component"), "component", "left_semi"), "component")
    j = s.join(h, "component", "left")
    # Pushed out from the mean of the events, not of the hull corners.
    push = lambda p: (lambda dy, dx: (lambda d: F.struct((c("lat") + dy * F.when(d > 0, 1 + c("buffer_nm") / 60 / d).otherwise(1.0)).alias("lat"),
                                                         (c("lon") + dx * F.when(d > 0, 1 + c("buffer_nm") / 60 / d).otherwise(1.0)).alias("lon")))
                      (F.sqrt(dy * dy + dx * dx)))(p["lat"] - c("lat"), p["lon"] - c("lon"))
    many = (c("event_count") >= 3) & (F.size("ring") >= 3)
    outline = F.when(many, F.transform("ring", push)).otherwise(geo.circle("lat", "lon", "_ab", 16))
    ext = lambda f, k: f(F.transform("outline", lambda p: p[k]))
    area = F.when(many, (ext(F.array_max, "lon") - ext(F.array_min, "lon")) * 60 * (ext(F.array_max, "lat") - ext(F.array_min, "lat")) * 60 * 0.7).otherwise(3.14159 * c("_ab") * c("_ab"))
    return (j.withColumn("outline", outline).select(
        "component", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"), "event_count", "affected_flights", F.floor("_g").alias("avg_gap_s"), "max_gap_s",
        F.round(risk, 1).alias("risk_score"), keys.gap_class(F.floor("_g")).alias("gap_type"), "first_seen", "last_seen", F.round(area, 1).alias("area_sq_nm"), "outline"))
