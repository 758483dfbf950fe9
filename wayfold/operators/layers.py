"""Learned layers: paths, tubes, procedures, turn zones; matching, containment, off-course.

Schemas: paths/procedures (id, kind, origin, destination, centerline array<struct<lat,lon>>,
width_nm, member_count, min_alt_ft, max_alt_ft); tubes (id, origin, destination, ring,
min_alt_ft, max_alt_ft, member_count); turns (id, lat, lon, radius_nm).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold import config as C
from wayfold.functions import geo
from wayfold.operators.hotkeys import PARTS_SETTING, by_place, hot_keys, join_by_slice, join_dealt, join_hot, spread
from wayfold.operators.segments import nearest_line
from wayfold.operators.shapes import in_ring, measured, near_side
from wayfold.operators.windows import SLICE, cut, running_sum, sliced_row_number, with_neighbours, with_slice

c = F.col
ANY = "*"


# -- resampling
def resample_by_distance(tracks: DataFrame, n: int = 80) -> DataFrame:
    """n waypoints per track at equal path length: (flight_id, idx, lat, lon, alt).

    Each segment emits the waypoints that fall on it, so nothing is gathered per track.
    """
    p = with_neighbours(tracks.select("flight_id", "ts", "lat", "lon", F.coalesce("alt", F.lit(0.0)).alias("alt")),
                        {"plat": "lat", "plon": "lon", "palt": "alt"})
    step = F.coalesce(geo.haversine("plat", "plon", "lat", "lon"), F.lit(0.0))
    s = running_sum(p.withColumn("step", step), {"cum": c("step")})
    total = s.groupBy("flight_id").agg(F.max("cum").alias("total")).where("total > 0")
    j = join_by_slice(s, total, C.SLICE_S, slices_of=tracks)
    first = c("plat").isNull()
    # Rounded, so that a border waypoint is seen the same from both of its segments.
    pos = lambda x: F.round(x / c("total") * (n - 1), 9)
    lo = F.when(first, F.lit(0)).otherwise(F.floor(pos(c("cum") - c("step"))) + 1)
    hi = F.when(first, F.lit(0)).otherwise(F.when(c("cum") == c("total"), F.lit(n - 1)).otherwise(F.floor(pos(c("cum")))))
    j = j.withColumns({"_lo": lo.cast("int"), "_hi": hi.cast("int")}).where("_hi >= _lo and (step > 0 or plat is null)")
    j = j.withColumn("idx", F.explode(F.sequence("_lo", "_hi")))
    f = F.when(first, F.lit(1.0)).otherwise((c("idx") * c("total") / (n - 1) - (c("cum") - c("step"))) / c("step"))
    mix = lambda a, b: F.when(first, c(b)).otherwise(c(a) + F.least(f, F.lit(1.0)) * (c(b) - c(a)))
    return j.select("flight_id", "idx", mix("plat", "lat").alias("lat"), mix("plon", "lon").alias("lon"), mix("palt", "alt").alias("alt"))


def resample_by_time(tracks: DataFrame, n: int = 50) -> DataFrame:
    """n points per track at equal times: (flight_id, idx, lat, lon, alt, track); headings are unwrapped first."""
    z = lambda x: F.coalesce(c(x), F.lit(0.0))
    p = with_neighbours(tracks.select("flight_id", "ts", "lat", "lon", z("alt").alias("alt"), z("track").alias("track")),
                        {f"p_{x}": x for x in ("ts", "lat", "lon", "alt", "track")})
    u = running_sum(p.withColumn("turn", F.coalesce(geo.heading_delta("track", "p_track"), c("track"))), {"hdg": c("turn")})
    span = tracks.groupBy("flight_id").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1")).where("t1 > t0")
    j = join_by_slice(u, span, C.SLICE_S, slices_of=tracks)
    pos = lambda t: (t - c("t0")) * (n - 1) / (c("t1") - c("t0"))
    first = c("p_ts").isNull()
    j = j.withColumns({"_lo": F.when(first, 0).otherwise(F.floor(pos(c("p_ts"))) + 1).cast("int"),
                       "_hi": F.floor(pos(c("ts"))).cast("int")}).where("_hi >= _lo")
    j = j.withColumn("idx", F.explode(F.sequence("_lo", "_hi")))
    at = c("t0") + c("idx") * (c("t1") - c("t0")) / (n - 1)
    f = (at - c("p_ts")) / (c("ts") - c("p_ts"))
    mix = lambda a, b: F.when(first, c(b)).otherwise(a + f * (c(b) - a))
    return j.select("flight_id", "idx", mix(c("p_lat"), "lat").alias("lat"), mix(c("p_lon"), "lon").alias("lon"),
                    mix(c("p_alt"), "alt").alias("alt"), F.pmod(mix(c("hdg") - c("turn"), "hdg"), F.lit(360.0)).alias("track"))


def mean_waypoint_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean distance of two paths of equal length, joined on (path, idx)."""
    j = a.join(b.select("path", "idx", c("lat").alias("blat"), c("lon").alias("blon")), ["path", "idx"])
    return j.groupBy("path").agg(F.avg(geo.haversine("lat", "lon", "blat", "blon")).alias("mean_nm"), F.count("*").alias("n"))


# -- layers from tracks
def learn_paths(tracks: DataFrame, meta: DataFrame, bins: int = 8, width: float = C.PATHS["width_nm"]) -> DataFrame:
    """Mean centreline per route: averages per ``bins``-th of each flight's own time, over all of its points."""
    m = meta.select("flight_id", "first_seen_ts", "last_seen_ts", "origin_airport", "destination_airport")
    p = join_by_slice(tracks.select("flight_id", "ts", "lat", "lon", "alt"), m, C.SLICE_S).withColumn(
        "_b", F.floor((c("ts") - c("first_seen_ts")) * bins / (c("last_seen_ts") - c("first_seen_ts") + 1)))
    v = (p.groupBy("origin_airport", "destination_airport", "_b")
         .agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.min("alt").alias("lo"), F.max("alt").alias("hi"),
              F.count_distinct("flight_id").alias("n")))
    line = F.transform(F.array_sort(F.collect_list(F.struct("_b", "lat", "lon"))), lambda s: F.struct(s["lat"].alias("lat"), s["lon"].alias("lon")))
    return (v.groupBy(c("origin_airport").alias("origin"), c("destination_airport").alias("destination"))
            .agg(line.alias("centerline"), F.min("lo").alias("min_alt_ft"), F.max("hi").alias("max_alt_ft"), F.max("n").alias("member_count"))
            .where(F.size("centerline") >= 2)
            .select(F.concat_ws("_", F.lit("P"), F.coalesce("origin", F.lit("UNK")), F.coalesce("destination", F.lit("UNK"))).alias("id"),
                    F.lit("primary").alias("kind"), "origin", "destination", "centerline", F.lit(width).alias("width_nm"),
                    "member_count", "min_alt_ft", "max_alt_ft"))


def tubes_from_paths(paths: DataFrame, half_width_nm: float = 5.0) -> DataFrame:
    return paths.select(F.concat(F.lit("T"), "id").alias("id"), "origin", "destination", geo.corridor("centerline", F.lit(half_width_nm)).alias("ring"),
                        "min_alt_ft", "max_alt_ft", "member_count")


def layers_from_json(docs: DataFrame, kind: str, col: str = "doc") -> DataFrame:
    """Layer rows from JSON documents {"<kind>": [...]}: declared schema, exploded."""
    item = ("struct<id:string,origin:string,destination:string,airport:string,width_nm:double,member_count:bigint,"
            "min_alt_ft:double,max_alt_ft:double,centerline:array<struct<lat:double,lon:double>>,geometry:array<array<double>>>")
    rows = docs.select(F.explode(F.from_json(col, f"{kind} array<{item}>")[kind]).alias("r")).select("r.*")
    return rows.withColumn("ring", F.transform("geometry", lambda p: F.struct(p[0].alias("lat"), p[1].alias("lon")))).drop("geometry")


# -- O/D matching. Flights and layers meet on expanded keys, so it stays an equi join.
def _clean(x: str) -> Column:
    return F.nullif(F.nullif(c(x), F.lit("")), F.lit("UNK"))


def _od_candidates(od: DataFrame, layer: DataFrame) -> DataFrame:
    """(origin, destination) pairs with the layer rows that do not contradict them."""
    l = layer.withColumns({"_lo": _clean("origin"), "_ld": _clean("destination")}).drop("origin", "destination")
    keys = lambda x: F.explode(F.array(F.coalesce(c(x), F.lit("-")), F.lit(ANY)))
    l = l.withColumn("_ko", keys("_lo")).withColumn("_kd", keys("_ld"))
    want = lambda x: F.explode(F.when(c(x).isNull(), F.array(F.lit(ANY))).otherwise(F.array(c(x), F.lit("-"))))
    o = od.withColumn("_ko", want("origin")).withColumn("_kd", want("destination"))
    return o.join(l, ["_ko", "_kd"]).drop("_ko", "_kd")


def _with_fallback(od: DataFrame, matched: DataFrame, layer: DataFrame) -> DataFrame:
    """Pairs without a match get the whole layer. Layer rows meet them in as many parts as the session has partitions."""
    rest = od.join(matched.select("origin", "destination").distinct().withColumnsRenamed({"origin": "_o", "destination": "_d"}),
                   c("origin").eqNullSafe(c("_o")) & c("destination").eqNullSafe(c("_d")), "left_anti")
    parts = int(od.sparkSession.conf.get(PARTS_SETTING))
    every = layer.drop("origin", "destination").withColumn("_k", F.pmod(F.xxhash64("id"), F.lit(parts)))
    return matched.withColumn("od_filter", F.lit(True)).unionByName(
        rest.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint")))).join(every, "_k").drop("_k").withColumn("od_filter", F.lit(False)))


def best_level(od: DataFrame, layer: DataFrame) -> DataFrame:
    """Layer rows of the best level only: exact, one side, generic. Pairs without any have no row. ``od``: distinct pairs."""
    m = _od_candidates(od.where("origin is not null or destination is not null"), layer)
    eo, ed = c("_lo").eqNullSafe(c("origin")), c("_ld").eqNullSafe(c("destination"))
    m = m.withColumn("_p", F.when(eo & ed, 0).when(eo | ed, 1).otherwise(2))
    best = m.groupBy("origin", "destination").agg(F.min("_p").alias("_b")).withColumnsRenamed({"origin": "_o", "destination": "_d"})
    return m.join(best, c("origin").eqNullSafe(c("_o")) & c("destination").eqNullSafe(c("_d")) & (c("_p") == c("_b"))).drop("_o", "_d", "_p", "_b", "_lo", "_ld")


def match_best_level(od: DataFrame, layer: DataFrame) -> DataFrame:
    """``best_level``, and the whole layer for pairs without a match."""
    return _with_fallback(od, best_level(od, layer), layer)


def route_paths(od: DataFrame, paths: DataFrame) -> DataFrame:
    """Paths of the pair, or with one side known and the other null. Pairs without any have no row."""
    m = _od_candidates(od.where("origin is not null or destination is not null"), paths)
    o, d, po, pd_ = c("origin"), c("destination"), c("_lo"), c("_ld")
    both = (po.eqNullSafe(o) & pd_.eqNullSafe(d)) | (po.eqNullSafe(o) & pd_.isNull()) | (po.isNull() & pd_.eqNullSafe(d))
    ok = F.when(o.isNotNull() & d.isNotNull(), both).when(o.isNotNull(), po.eqNullSafe(o)).otherwise(pd_.eqNullSafe(d))
    return m.where(ok).drop("_lo", "_ld")


def match_paths(od: DataFrame, paths: DataFrame) -> DataFrame:
    """``route_paths``, and all paths for pairs without a match."""
    return _with_fallback(od, route_paths(od, paths), paths)


def match_corridors(od: DataFrame, paths: DataFrame) -> DataFrame:
    """Corridors for route planning: with one end asked, a corridor whose other end is known ranks first."""
    m = _od_candidates(od.where("origin is not null or destination is not null"), paths)
    o, d, po, pd_ = c("origin"), c("destination"), c("_lo"), c("_ld")
    eo, ed = po.eqNullSafe(o), pd_.eqNullSafe(d)
    both = F.when(eo & ed, 0).when((eo & pd_.isNull()) | (po.isNull() & ed), 1).when(po.isNull() & pd_.isNull(), 2)
    rank = (F.when(o.isNotNull() & d.isNotNull(), both).when(o.isNotNull(), F.when(eo, F.when(pd_.isNotNull(), 0).otherwise(1)))
            .otherwise(F.when(ed, F.when(po.isNotNull(), 0).otherwise(1))))
    m = m.withColumn("_p", rank).where("_p is not null")
    best = m.groupBy("origin", "destination").agg(F.min("_p").alias("_b")).withColumnsRenamed({"origin": "_o", "destination": "_d"})
    m = m.join(best, c("origin").eqNullSafe(c("_o")) & c("destination").eqNullSafe(c("_d")) & (c("_p") == c("_b"))).drop("_o", "_d", "_p", "_b", "_lo", "_ld")
    return _with_fallback(od, m, paths)


def nearby_corridors(points: DataFrame, paths: DataFrame, max_nm: float = 30.0, k: int = 3) -> DataFrame:
    """Closest k corridors per position by vertex distance. ``points``: pid, lat, lon.

    Vertices and positions meet in cells as wide as the limit, so it is an equi join.
    """
    g = max_nm / 59.5
    v = paths.where(F.size("centerline") >= 2).select("id", F.explode("centerline").alias("v")).select("id", c("v.lat").alias("vlat"), c("v.lon").alias("vlon"))
    wide = lambda band: g / F.cos(F.radians(F.least(F.abs(band) + 2, F.lit(88))))
    p = points.withColumns({"_band": F.floor("lat"), "_y": F.floor(c("lat") / g)}).withColumn("_x", F.floor(c("lon") / wide(c("_band"))))
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    v = v.withColumn("_band", F.explode(F.array_distinct(F.array(F.floor(c("vlat") - g), F.floor("vlat"), F.floor(c("vlat") + g)))))
    v = v.withColumn("_y", F.explode(F.transform(near, lambda d: F.floor(c("vlat") / g) + d)))
    v = v.withColumn("_x", F.explode(F.transform(near, lambda d: F.floor(c("vlon") / wide(c("_band"))) + d)))
    j = join_hot(p, v, ["_band", "_y", "_x"]).withColumn("nm", geo.haversine("lat", "lon", "vlat", "vlon")).where(c("nm") <= max_nm)
    best = j.groupBy("pid", "id").agg(F.round(F.min("nm"), 6).alias("nm"))
    w = Window.partitionBy("pid").orderBy("nm", "id")
    return best.withColumn("rank", F.row_number().over(w)).where(c("rank") <= k)


# -- containment
PLACE = ["lat", "lon"]


def _zone_places(places: DataFrame, turns: DataFrame, tolerance: float, default: float) -> DataFrame:
    z = turns.select(F.array(F.struct("lat", "lon")).alias("_v"), c("lat").alias("_zlat"), c("lon").alias("_zlon"),
                     (F.coalesce("radius_nm", F.lit(default)) + tolerance).alias("_r"))
    j = _by_cells(places, z, c("_v"), c("_r"))
    return j.where(geo.haversine("lat", "lon", c("_zlat"), c("_zlon")) <= c("_r")).select(*PLACE).distinct()


def points_in_turn_zones(points: DataFrame, turns: DataFrame, tolerance: float = 0.0, default: float = C.LAYERS["turn_radius_nm"]) -> DataFrame:
    """Keys of points within the radius of a turn zone, for zones of any number, by cells."""
    return _points_at(points, lambda places: _zone_places(places, turns, tolerance, default))


def _points_at(points: DataFrame, find) -> DataFrame:
    """Keys of the points at the places that ``find`` picks."""
    return by_place(points.select("flight_id", "ts", "lat", "lon"), PLACE, find).select("flight_id", "ts").distinct()


def mark_turn_zones(points: DataFrame, turns: DataFrame, name: str, tolerance: float = 0.0, default: float = C.LAYERS["turn_radius_nm"]) -> DataFrame:
    """Add a boolean: the point is within the radius of a turn zone."""
    hit = points_in_turn_zones(points, turns, tolerance, default).withColumn(name, F.lit(True))
    return points.join(hit, ["flight_id", "ts"], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def _by_cells(points: DataFrame, areas: DataFrame, verts: Column, reach_nm: Column, cell: float = 0.5,
              also: tuple = (), even: bool = False) -> DataFrame:
    """Candidate (point, area) rows: areas are listed in every cell their widened box covers.

    Points of a crowded cell are dealt over several tasks. ``even``: spread all points before costly geometry.
    """
    dy = reach_nm / 59.0
    # The longitude margin is taken at the widest latitude of the area.
    a = areas.withColumns({"_s": F.array_min(F.transform(verts, lambda p: p["lat"])) - dy, "_n": F.array_max(F.transform(verts, lambda p: p["lat"])) + dy})
    dx = dy / F.cos(F.radians(F.least(F.greatest(F.abs("_s"), F.abs("_n")), F.lit(88.0))))
    a = a.withColumns({"_w": F.array_min(F.transform(verts, lambda p: p["lon"])) - dx, "_e": F.array_max(F.transform(verts, lambda p: p["lon"])) + dx})
    f = lambda x: F.floor(c(x) / cell)
    a = a.withColumn("_cy", F.explode(F.sequence(f("_s"), f("_n")))).withColumn("_cx", F.explode(F.sequence(f("_w"), f("_e"))))
    p = points.withColumns({"_cy": F.floor(c("lat") / cell), "_cx": F.floor(c("lon") / cell)})
    on = ["_cy", "_cx", *also]
    return (join_dealt(spread(p, tuple(p.columns)) if even else p, a, on, hot_keys(p, on)).where(c("lat").between(c("_s"), c("_n")) & c("lon").between(c("_w"), c("_e")))
            .drop("_cy", "_cx", "_s", "_n", "_w", "_e"))


def _procedure_places(places: DataFrame, procedures: DataFrame, tolerance: float) -> DataFrame:
    pr = procedures.where(F.size("centerline") >= 2).select("centerline", (F.coalesce("width_nm", F.lit(C.LAYERS["proc_width_nm"])) + tolerance).alias("_r"))
    j = _by_cells(places, pr, c("centerline"), c("_r"), even=True)
    return measured(j.select(*PLACE, "_r", "centerline")).where("d <= _r").select(*PLACE).distinct()


def points_on_procedure(points: DataFrame, procedures: DataFrame, tolerance: float = C.LAYERS["proc_tol_nm"]) -> DataFrame:
    """Keys of points within width plus tolerance of a procedure centreline."""
    return _points_at(points, lambda places: _procedure_places(places, procedures, tolerance))


def _corridor_places(places: DataFrame, paths: DataFrame) -> DataFrame:
    # Written once: left as an expression, the ring would be rebuilt at every use.
    ring = cut(paths.select(geo.corridor("centerline", "width_nm").alias("ring")).where("ring is not null"))
    j = _by_cells(places, ring, c("ring"), F.lit(0.5), even=True)
    return in_ring(j.select(*PLACE, "ring")).distinct()


def points_in_corridors(points: DataFrame, paths: DataFrame) -> DataFrame:
    """Keys of points inside the corridor polygon of a learned path."""
    return _points_at(points, lambda places: _corridor_places(places, paths))


def mark_known_places(pts: DataFrame, paths: DataFrame, procedures: DataFrame, turns: DataFrame) -> DataFrame:
    """Add in_turn (learned turn) and known_place (corridor, procedure or turn zone) for the turn rule."""
    def marked(places):
        known = (_corridor_places(places, paths).unionByName(_procedure_places(places, procedures, C.LAYERS["proc_tol_nm"]))
                 .unionByName(_zone_places(places, turns, C.LAYERS["turn_tol_nm"], C.LAYERS["zone_radius_nm"])).distinct())
        turn = _zone_places(places, turns, 0.0, C.LAYERS["turn_radius_nm"])
        flag = lambda df, name: places.join(df.withColumn(name, F.lit(True)), PLACE, "left").withColumn(name, F.coalesce(name, F.lit(False)))
        return flag(turn, "in_turn").join(flag(known, "known_place"), PLACE)

    nowhere = pts.where("lat is null or lon is null").withColumns({"in_turn": F.lit(False), "known_place": F.lit(False)})
    return by_place(pts, PLACE, marked).select(nowhere.columns).unionByName(nowhere)


def tube_membership(points: DataFrame, tubes: DataFrame, alt_tol: float = C.PATHS["tube_ft"],
                    side_tol: float = C.PATHS["tube_nm"], also: tuple = ()) -> DataFrame:
    """(point, tube) rows inside a tube or within the side tolerance, altitude tolerance included.

    ``also`` names columns of both frames that must agree as well (the route, in rule 11).
    """
    t = tubes.where(F.size("ring") >= 3).select(c("id").alias("tube_id"), "ring", F.coalesce("min_alt_ft", F.lit(0.0)).alias("_lo"),
                                                F.coalesce("max_alt_ft", F.lit(50000.0)).alias("_hi"), *also)
    alt = F.coalesce(c("alt"), F.lit(0.0))
    pts = points.select("flight_id", "ts", "lat", "lon", alt.alias("alt"), *also)
    on = ["lat", "lon", "alt", *also]
    level = c("alt").between(c("_lo") - alt_tol, c("_hi") + alt_tol)

    def found(places):
        inside = in_ring(_by_cells(places, t, c("ring"), F.lit(0.5), also=also, even=True).where(level).select(*on, "tube_id", "ring"))
        # Nearness is a matter of single sides: they are listed in their own, smaller cells.
        shifted = F.concat(F.slice("ring", 2, F.size("ring")), F.slice("ring", 1, 1))
        sides = t.withColumn("_e", F.explode(F.arrays_zip(c("ring").alias("p"), shifted.alias("q")))).drop("ring")
        sides = sides.withColumns({"p": c("_e")["p"], "q": c("_e")["q"]}).drop("_e")
        close = _by_cells(places, sides, F.array("p", "q"), F.lit(side_tol), cell=0.1, also=also, even=True).where(level)
        close = near_side(close.select(*on, "tube_id", "p", "q"), side_tol)
        return inside.unionByName(close).distinct()

    return by_place(pts, on, found).select("flight_id", "ts", "tube_id").distinct()


def heat_cells(tracks: DataFrame, cell: float = C.PATHS["cell_deg"]) -> DataFrame:
    """Activity grid: points per cell with truncating indices."""
    return tracks.groupBy((c("lat") / cell).cast("int").alias("r"), (c("lon") / cell).cast("int").alias("q")).agg(F.count("*").alias("n"))


def in_active_cell(points: DataFrame, heat: DataFrame | None, cell: float = C.PATHS["cell_deg"], least: int = C.PATHS["heat_min"]) -> DataFrame:
    """Add ``active``: the cell reaches the threshold; true everywhere without a grid."""
    if heat is None:
        return points.withColumn("active", F.lit(True))
    p = points.withColumns({"r": (c("lat") / cell).cast("int"), "q": (c("lon") / cell).cast("int")})
    return p.join(heat, ["r", "q"], "left").withColumn("active", F.coalesce(c("n") >= least, F.lit(False))).drop("r", "q", "n")


# -- rule 11
def off_course_points(pts: DataFrame, meta: DataFrame, tubes: DataFrame, paths: DataFrame, heat: DataFrame | None) -> DataFrame:
    """Judged points above 9000 ft with on/off, nearest path and region flag.

    Points of a route with tubes or paths of its own meet those alone. The others, which may be on any, find tubes by
    cell and their nearest path through the segment index, so no point meets a whole layer.
    """
    od = meta.select("flight_id", F.nullif("origin_airport", F.lit("")).alias("origin"), F.nullif("destination_airport", F.lit("")).alias("destination"))
    od = od.where("origin is not null or destination is not null")
    pairs = od.select("origin", "destination").distinct()
    route = F.concat_ws("|", F.coalesce("origin", F.lit("-")), F.coalesce("destination", F.lit("-")))
    tube_ok = cut(best_level(pairs, tubes).withColumn("route", route))
    cand = cut(route_paths(pairs, paths).withColumn("route", route).select("route", "id", "centerline", "width_nm"))
    # Whether a route has layers of its own is settled for each flight, before its points.
    own = lambda layer, flag: layer.select("route").distinct().withColumn(flag, F.lit(True))
    od = (od.withColumn("route", route).join(own(tube_ok, "own_tubes"), "route", "left").join(own(cand, "own_paths"), "route", "left")
          .select("flight_id", "route", *[F.coalesce(x, F.lit(False)).alias(x) for x in ("own_tubes", "own_paths")]))
    use = (pts.where(~c("impossible") & ~c("bad") & (F.coalesce("alt", F.lit(0.0)) > C.PATHS["floor_ft"]))
           .select("flight_id", "ts", "lat", "lon", "alt"))
    use = cut(join_by_slice(use, od, C.SLICE_S))
    inside = (tube_membership(use.where("own_tubes"), tube_ok, also=("route",)).unionByName(tube_membership(use.where("not own_tubes"), tubes))
              .groupBy("flight_id", "ts").agg(F.min("tube_id").alias("path_id")))
    inside = cut(inside)
    keys = ["flight_id", "ts"]
    out = cut(use.join(inside.select(*keys), keys, "left_anti"))
    def on_route(places):
        m = measured(join_dealt(spread(places, tuple(at)), cand, ["route"], hot_keys(places, ["route"])).select(*at, "id", "width_nm", "centerline"))
        return m.groupBy(*at).agg(F.min(F.struct(F.coalesce("d", F.lit(999.0)).alias("d"), "id", "width_nm", "pos")).alias("b"))

    def anywhere(places):
        near = nearest_line(places.withColumns({"_la": c("lat"), "_lo": c("lon")}), paths, ["_la", "_lo"])
        return near.select(c("_la").alias("lat"), c("_lo").alias("lon"), F.struct("d", "id", "width_nm", "pos").alias("b"))

    at = ["route", *PLACE]
    routed = by_place(out.where("own_paths"), at, on_route).select(*keys, "b")
    free = by_place(out.where("not own_paths"), PLACE, anywhere).select(*keys, "b")
    near = (out.select(*keys, "lat", "lon").join(routed.unionByName(free), keys, "left")
            .withColumn("b", F.coalesce("b", F.struct(F.lit(999.0).alias("d"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("double").alias("width_nm"),
                                                      F.lit(None).cast("double").alias("pos")))))
    judged = near.select("flight_id", "ts", "lat", "lon", c("b.id").alias("path_id"), F.round("b.d", 2).alias("distance_nm"),
                         F.round("b.pos", 3).alias("position"), c("b.d").alias("_d"),
                         F.coalesce(c("b.d") <= c("b.width_nm"), F.lit(False)).alias("on_path"), F.lit("path").alias("method"))
    judged = judged.withColumn("far", ~c("on_path") & (c("_d") >= C.PATHS["far_nm"])).drop("_d")
    tube = (use.join(inside, ["flight_id", "ts"]).select(
        "flight_id", "ts", "lat", "lon", "path_id", F.lit(0.0).alias("distance_nm"), F.lit(0.5).alias("position"),
        F.lit(True).alias("on_path"), F.lit("tube").alias("method"), F.lit(False).alias("far")))
    both = cut(in_active_cell(judged.unionByName(tube), heat))
    return both.withColumn("wrong_region", ~c("on_path") & ~c("active")).drop("active")


def off_course(points: DataFrame) -> DataFrame:
    """Flights with 15 or more off points, or any in a low-activity cell."""
    n = points.groupBy("flight_id").agg(
        F.count_if("on_path").alias("on_path_points"), F.count_if(~c("on_path")).alias("off_path_points"),
        F.count_if("wrong_region").alias("wrong_region_points"), F.max(F.when(~c("on_path"), c("distance_nm"))).alias("max_deviation_nm"),
        F.min(F.when(~c("on_path"), c("ts"))).alias("ts"))
    return n.withColumn("matched", (c("off_path_points") >= C.PATHS["off_points"]) | (c("wrong_region_points") > 0))


def heading_bins(points: DataFrame, bin_s: int = 10, deg: int = C.PATHS["sig_deg"]) -> DataFrame:
    """Mean heading per 10 s bin from the first point, in 30-degree classes: (flight_id, bin, code)."""
    t0 = points.groupBy("flight_id").agg(F.min("ts").alias("t0"))
    p = join_by_slice(points, t0, C.SLICE_S).withColumn("bin", F.floor((c("ts") - c("t0")) / bin_s))
    return (p.groupBy("flight_id", "bin").agg(F.avg(F.pmod("track", F.lit(360.0))).alias("h"))
            .select("flight_id", "bin", F.floor(c("h") / deg).cast("int").alias("code")))


def emerging_paths(far: DataFrame, tracks: DataFrame, bucket: int = C.PATHS["bucket"], n: int = C.PATHS["samples"]) -> DataFrame:
    """Every fifth flight with one heading signature promotes its own track to a path.

    The signature is compared through order-free sums over its bins, so no flight's bins
    are gathered. Flights count in order of their first far point.
    """
    far = cut(far)                  # read three times below
    b = heading_bins(far)
    sig = b.groupBy("flight_id").agg(F.count("*").alias("s0"), F.sum(F.xxhash64("bin", "code").cast("decimal(38,0)")).alias("s1"),
                                     F.sum(F.xxhash64("code", "bin").cast("decimal(38,0)")).alias("s2"))
    when = far.groupBy("flight_id").agg(F.min("ts").alias("first_ts"))
    f = sig.join(when, "flight_id").withColumn("_sig", F.concat_ws(":", "s0", "s1", "s2")).withColumn("_sl", F.floor(c("first_ts") / C.SLICE_S))
    hits = sliced_row_number(f, "_sig", "_sl", ["first_ts", "flight_id"], "_n").where(c("_n") % bucket == 0).select("flight_id", F.lit(bucket).cast("long").alias("num_flights"))
    hits = cut(hits)
    own = cut(tracks.join(hits.select("flight_id"), "flight_id", "left_semi"))
    way = resample_by_distance(own, n)
    # n waypoints per promoted flight: a bounded list.
    line = F.transform(F.array_sort(F.collect_list(F.struct("idx", "lat", "lon"))), lambda s: F.struct(s["lat"].alias("lat"), s["lon"].alias("lon")))
    paths = cut(way.groupBy("flight_id").agg(line.alias("centerline")))
    width = (measured(own.select("flight_id", "lat", "lon").join(paths, "flight_id"))
             .groupBy("flight_id").agg(F.greatest(F.stddev_pop("d"), F.lit(2.0)).alias("width_nm")))
    return paths.join(width, "flight_id").join(hits, "flight_id")


def union_tubes(tubes: DataFrame) -> DataFrame:
    """One tube per route: altitude range, members, outline by hull of all ring vertices."""
    from wayfold.operators.clusters import hulls
    ok = tubes.where(F.size("ring") >= 3)
    agg = ok.groupBy("origin", "destination").agg(F.min("min_alt_ft").alias("min_alt_ft"), F.max("max_alt_ft").alias("max_alt_ft"),
                                                  F.count("*").alias("tube_count"), F.sum("member_count").alias("member_count"))
    key = F.concat_ws("_", F.lit("UNION"), F.coalesce("origin", F.lit("")), F.coalesce("destination", F.lit("")))
    v = ok.select(key.alias("id"), F.explode("ring").alias("p")).select("id", "p.lat", "p.lon")
    return agg.withColumn("id", key).join(hulls(v, "id"), "id", "left")


def layer_statistics(layers: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in layers.items():
        one = df.agg(F.lit(name).alias("layer"), F.count("*").alias("total"), F.count_distinct("origin").alias("unique_origins"),
                     F.count_distinct("destination").alias("unique_destinations"), F.round(F.avg("member_count"), 2).alias("avg_member_count"))
        out = one if out is None else out.unionByName(one)
    return out
