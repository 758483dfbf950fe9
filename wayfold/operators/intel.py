"""Activity patterns, proximity between operators, behaviour scores, similarity."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold import config as C
from wayfold.functions import geo, keys
from wayfold.operators.approaches import closest_approaches
from wayfold.operators.hotkeys import join_hot
from wayfold.operators.stats import military_flag, on_spine, spine
from wayfold.operators.windows import cut, with_neighbours

c = F.col


def mil(facts: DataFrame) -> DataFrame:
    return facts.where(military_flag())


# -- counts over military flights
def by_country(facts: DataFrame) -> DataFrame:
    border = c("crossed_borders").isNotNull() & (c("crossed_borders") != "")
    return mil(facts).groupBy("country").agg(
        F.count("*").alias("flights"), F.round(F.sum("flight_duration_sec") / 3600, 2).alias("total_hours"),
        F.count_if(border).alias("border_flights"), F.array_join(F.array_sort(F.collect_set("military_type")), ",").alias("types"))


def first_box(lat: str, lon: str, boxes) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, s, n, w, e in boxes:
        out = out.when(geo.in_box(lat, lon, s, n, w, e), name)
    return F.coalesce(out, F.lit("Other"))


def by_destination(facts: DataFrame, airport_regions: dict[str, str], boxes) -> DataFrame:
    """Destination region: named airport first, else the first box with the last position; origin side by longitude."""
    named = F.create_map(*[F.lit(x) for kv in airport_regions.items() for x in kv])
    dest = F.coalesce(F.try_element_at(named, c("destination_airport")), first_box("dest_lat", "dest_lon", boxes))
    side = F.when(c("dest_lon") > 44, "east").when(c("dest_lon") < 30, "west").otherwise("local")
    return mil(facts).groupBy(dest.alias("region"), side.alias("origin_side")).agg(F.count("*").alias("flights"))


def presence(facts: DataFrame) -> DataFrame:
    return mil(facts).groupBy("military_type", "country").agg(
        F.count("*").alias("flights"), F.count_if(c("flight_duration_sec") > 7200).alias("loitering"))


def loitering(facts: DataFrame, min_s: int = 7200, long_s: int = 14400, limit: int = 20) -> DataFrame:
    label = (F.when(c("military_type") == "ISR", "Surveillance Pattern").when(c("military_type") == "tanker", "Refueling Orbit")
             .when(c("flight_duration_sec") > long_s, "Extended Loitering").otherwise("Unknown"))
    return (mil(facts).where(c("flight_duration_sec") > min_s)
            .select("flight_id", "military_type", "country", F.round(c("flight_duration_sec") / 3600, 1).alias("hours"), label.alias("pattern"))
            .orderBy(F.desc("hours"), "flight_id").limit(limit))


def night_operations(facts: DataFrame) -> DataFrame:
    h = keys.hour_of("first_seen_ts")
    night = (h >= 20) | (h < 6)
    return mil(facts).groupBy("country").agg(F.count("*").alias("flights"), F.count_if(night).alias("night_flights"),
                                             F.round(100.0 * F.count_if(night) / F.count("*"), 1).alias("night_pct"))


def border_pairs(facts: DataFrame) -> DataFrame:
    """Crossings between consecutive countries of the comma list."""
    parts = F.transform(F.split("crossed_borders", ","), lambda x: F.trim(x))
    p = mil(facts).where("crossed_borders like '%,%'").withColumn("p", parts)
    pair = F.explode(F.arrays_zip(F.slice("p", 1, F.size("p") - 1).alias("a"), F.slice("p", 2, F.size("p") - 1).alias("b")))
    return p.select("flight_id", pair.alias("x")).groupBy(c("x.a").alias("from_country"), c("x.b").alias("to_country")).agg(F.count("*").alias("crossings"))


def surveillance_classes(facts: DataFrame) -> DataFrame:
    h = c("flight_duration_sec") / 3600
    cls = F.when(h > 8, "strategic").when(h > 4, "tactical").otherwise("short")
    return mil(facts).where("military_type = 'ISR'").groupBy(cls.alias("duration_class"), "country").agg(F.count("*").alias("flights"))


def tanker_activity(facts: DataFrame, tracks: DataFrame, areas) -> DataFrame:
    """Tanker-type flights with last position, area and orbits of 17 minutes each."""
    t = mil(facts).where("military_type = 'tanker'").select("flight_id", "callsign", "flight_duration_sec")
    last = (tracks.join(t.select("flight_id"), "flight_id", "left_semi").groupBy("flight_id")
            .agg(F.max("ts").alias("last_ts"), F.count("*").alias("points"), F.max_by(F.struct("lat", "lon"), "ts").alias("p")))
    area = F.when(F.lit(False), "")
    for name, la, lo, r in areas:
        area = area.when(geo.haversine("p.lat", "p.lon", la, lo) <= r, name)
    return t.join(last, "flight_id").select("flight_id", "callsign", "points", "last_ts", F.coalesce(area, F.lit("Transit")).alias("area"),
                                            F.floor(c("flight_duration_sec") / 60 / 17).alias("orbits"))


def tempo_hours(facts: DataFrame, countries: list[str]) -> DataFrame:
    n = mil(facts).groupBy(keys.hour_of("first_seen_ts").alias("hour")).pivot("country", countries).agg(F.count(F.lit(1)))
    return on_spine(spine(facts.sparkSession, 0, 23, "hour"), n, "hour", countries)


def tempo_spikes(facts: DataFrame, limit: int | None = 20) -> DataFrame:
    """Country days at least 5 flights and 1.5 times the country's mean over its days (mean at least 2)."""
    d = mil(facts).groupBy("country", keys.date_str("first_seen_ts").alias("date")).agg(F.count("*").alias("count"))
    m = F.avg("count").over(Window.partitionBy("country"))         # one row per day
    s = d.withColumn("_m", m).where((c("count") >= 5) & (c("count") > c("_m") * 1.5) & (c("_m") >= 2))
    inc = F.round((c("count") - c("_m")) / c("_m") * 100, 1)
    out = (s.withColumn("increase_pct", inc).withColumn("score", F.round((c("count") - c("_m")) * 0.6 + c("increase_pct") / 100 * c("count") * 0.4, 3))
            .select("country", "date", "count", "increase_pct", "score"))
    return out if limit is None else out.orderBy(F.desc("score"), "country", "date").limit(limit)


def tempo_trend(facts: DataFrame) -> DataFrame:
    """First against second half of the observed days per country, checked against the last week."""
    d = mil(facts).groupBy("country", keys.day_number("first_seen_ts").alias("day")).agg(F.count("*").alias("n"))
    # One row per observed day: numbering them is a small sort.
    days = d.select("day").distinct().withColumns({"_r": F.row_number().over(Window.orderBy("day")), "_n": F.count("*").over(Window.partitionBy())})
    j = d.join(days, "day")
    n = F.max("_n")
    mid, week = F.floor(n / 2), F.least(n, F.lit(7))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, c("n"))), F.lit(0))
    t = j.groupBy("country").agg(
        n.alias("days"), F.try_divide(total(c("_r") <= F.floor(c("_n") / 2)), mid).alias("a"), (total(c("_r") > F.floor(c("_n") / 2)) / (n - mid)).alias("b"),
        (total(c("_r") > c("_n") - F.least(c("_n"), F.lit(7))) / week).alias("last"), (total(F.lit(True)) / n).alias("mean"))
    a, b, last = c("a"), c("b"), c("last")
    trend = (F.when(c("days") < 4, "stable").when(b > a * 1.3, F.when(last < b * 0.5, "decreasing").otherwise("increasing"))
             .when(b < a * 0.7, "decreasing").when(last < c("mean") * 0.5, "decreasing").otherwise("stable"))
    return t.select("country", trend.alias("trend"))


def readiness(flights: DataFrame, spikes: DataFrame, trend: DataFrame, watch: str = "RU") -> DataFrame:
    """One row: score from flight volume, number of spikes and the trend of one watched country."""
    one = lambda d: d.withColumn("_k", F.lit(1))
    n = flights.agg(F.count("*").alias("flights"))
    k = spikes.agg(F.count("*").alias("spikes"))
    t = trend.agg(F.coalesce(F.max(F.when(c("country") == watch, c("trend"))), F.lit("stable")).alias("trend"))
    score = (F.when(c("flights") > 100, 30).when(c("flights") > 50, 20).when(c("flights") > 20, 10).otherwise(0)
             + F.when(c("spikes") > 5, 25).when(c("spikes") > 2, 15).otherwise(0) + F.when(c("trend") == "increasing", 25).otherwise(0))
    s = c("score")
    level = F.when(s >= 70, "IMMINENT").when(s >= 50, "HIGH").when(s >= 35, "ELEVATED").when(s >= 20, "MODERATE").otherwise("LOW")
    return one(n).join(one(k), "_k").join(one(t), "_k").drop("_k").withColumn("score", score).withColumn("level", level)


SYRIA = (32.0, 37.0, 35.0, 42.0)        # fixed values: south, north, west, east


def anomaly_clusters(reports: DataFrame, least: int = 3) -> DataFrame:
    """Cells of a tenth of a degree with enough anomalous reports. ``reports``: lat, lon, is_anomaly."""
    tenth = lambda x: F.round(c(x) * 10) / 10
    return (reports.where("is_anomaly = 1 and lat is not null and lon is not null").groupBy(tenth("lat").alias("lat"), tenth("lon").alias("lon"))
            .agg(F.count("*").alias("n")).where(c("n") >= least))


def conflict_flights(tracks: DataFrame, military: DataFrame, hostile=("RU", "IR"), box=SYRIA) -> DataFrame:
    """Military flights with a point in the box: how many, and how many of them by operators of the named countries."""
    inside = tracks.where(geo.in_box("lat", "lon", *box)).select("flight_id").distinct()
    return (inside.join(military.select("flight_id", "country"), "flight_id")
            .agg(F.count("*").alias("syria_flights"), F.count_if(c("country").isin(*hostile)).alias("from_east")))


def composite(cells: DataFrame, military: DataFrame, clusters: DataFrame, conflict: DataFrame, hostile=("RU", "IR")) -> DataFrame:
    """Combined threat: interference .30, military activity .25, unusual patterns .20, conflict zone .25, as one row.

    ``cells``: confidence (HIGH, MEDIUM or other) and affected_flights of interference cells; ``military``: one row with country for
    each military flight; ``clusters``: anomaly clusters; ``conflict``: one row of ``conflict_flights``.
    """
    most = lambda limit, x: F.least(F.lit(limit), x)
    g = cells.agg(F.count("*").alias("gps_count"), F.lit(1).alias("_k"),
                  most(100, F.count_if(c("confidence") == "HIGH") * 15 + F.count_if(c("confidence") == "MEDIUM") * 8 + most(30, F.count("*") * 3)
                       + most(25, F.floor(F.coalesce(F.sum("affected_flights"), F.lit(0)) / 2))).cast("long").alias("gps_score"))
    m = military.agg(F.count("*").alias("military_flights"), F.lit(1).alias("_k"),
                     most(100, most(40, F.count("*") * 2) + most(40, F.count_if(c("country").isin(*hostile)) * 10) + most(20, F.floor(F.count("*") / 5)))
                     .cast("long").alias("military_score"))
    u = clusters.agg(F.count("*").alias("cluster_count"), most(100, F.count("*") * 10).cast("long").alias("pattern_score"), F.lit(1).alias("_k"))
    z = conflict.select("syria_flights", "from_east", F.lit(1).alias("_k"), most(100, c("syria_flights") * 15 + c("from_east") * 25).cast("long").alias("conflict_score"))
    j = g.join(m, "_k").join(u, "_k").join(z, "_k").drop("_k")      # rows of one aggregate each
    # Whole percent, so that the floor is exact.
    score = F.floor((c("gps_score") * 30 + c("military_score") * 25 + c("pattern_score") * 20 + c("conflict_score") * 25) / 100)
    named = [("Active GPS Jamming", "gps_score", c("gps_score") >= 50), ("High Military Presence", "military_score", c("military_score") >= 40),
             ("Anomaly Clusters Detected", "pattern_score", c("pattern_score") >= 30), ("Conflict Zone Activity", "conflict_score", c("syria_flights") > 0)]
    concerns = F.filter(F.array(*[F.when(on, F.struct((-c(x)).alias("s"), F.lit(i).alias("i"), F.lit(name).alias("name"))) for i, (name, x, on) in enumerate(named)]),
                        lambda x: x.isNotNull())
    names = F.array_join(F.transform(F.array_sort(concerns), lambda x: x["name"]), ", ")
    return j.withColumn("score", score).withColumn("concerns", names).withColumn(
        "level", F.when(c("score") >= 80, "CRITICAL").when(c("score") >= 60, "HIGH").when(c("score") >= 40, "ELEVATED")
        .when(c("score") >= 20, "MODERATE").otherwise("LOW"))


def interference_correlation(cells: DataFrame) -> DataFrame:
    """Cells of severity 40 and more, mean severity times 1.5, capped."""
    return cells.agg(F.count("*").alias("cells"), F.count_if(c("intensity") >= 40).alias("severe"),
                     F.round(F.least(F.lit(100.0), F.avg("intensity") * 1.5), 2).alias("score"))


def pattern_clusters(reports: DataFrame, step: float = 0.5, least: int = 2) -> DataFrame:
    """Report centroids on a grid. ``reports``: flight_id, lat, lon, rule_id."""
    cen = reports.groupBy("flight_id").agg(geo.mean("lat").alias("lat"), geo.mean("lon").alias("lon"), F.min("rule_id").alias("rule_id"))
    return (cen.groupBy(geo.grid("lat", step).alias("lat"), geo.grid("lon", step).alias("lon"))
            .agg(F.count("*").alias("occurrences"), F.array_join(F.array_sort(F.collect_set("rule_id")).cast("array<string>"), ",").alias("rules"))
            .where(c("occurrences") >= least))


def region_routes(tracks: DataFrame, facts: DataFrame, boxes, k: int = 5) -> DataFrame:
    """Region of the first and last point of military flights; top routes per country."""
    ends = (tracks.join(mil(facts).select("flight_id", "country"), "flight_id").groupBy("flight_id", "country")
            .agg(F.min_by(F.struct("lat", "lon"), "ts").alias("a"), F.max_by(F.struct("lat", "lon"), "ts").alias("b")))
    e = ends.select("country", c("a.lat").alias("alat"), c("a.lon").alias("alon"), c("b.lat").alias("blat"), c("b.lon").alias("blon"))
    n = e.groupBy("country", first_box("alat", "alon", boxes).alias("origin"), first_box("blat", "blon", boxes).alias("destination")).agg(F.count("*").alias("flights"))
    w = Window.partitionBy("country").orderBy(F.desc("flights"), "origin", "destination")
    return n.withColumn("rank", F.row_number().over(w)).where(c("rank") <= k)


def recent_tracks(tracks: DataFrame, facts: DataFrame, k: int = 30) -> DataFrame:
    """Points of the latest k military flights per country; the rank needs k rows per task and country."""
    w = Window.partitionBy("country").orderBy(F.desc("last_seen_ts"), "flight_id")
    top = mil(facts).withColumn("rank", F.row_number().over(w)).where(c("rank") <= k).select("flight_id", "country", "rank")
    return tracks.select("flight_id", "ts", "lat", "lon", "alt").join(top, "flight_id")


def military_patterns(tracks: DataFrame, facts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Flights known as military by flag or prefix, role replaced by the track's when generic."""
    org = keys.military_org("callsign", None, "category")
    m = facts.withColumn("org", org).where(c("org").isNotNull() | military_flag()).dropDuplicates(["flight_id"])
    role = keys.military_role("org")
    return (m.join(patterns, "flight_id", "left")
            .select("flight_id", "callsign", "country", "pattern", F.when(role.isin("military") | role.isNull(), F.coalesce(c("role"), role)).otherwise(role).alias("type")))


def operator_proximity(locations: DataFrame, nm: float = 50, seconds: int = 300) -> DataFrame:
    """Closest approach of flights of different countries. ``locations``: flight_id, ts, lat, lon, country."""
    p = closest_approaches(locations, nm, seconds, "country")
    p = p.withColumn("nm", geo.haversine("a_lat", "a_lon", "b_lat", "b_lon"))
    best = p.groupBy(c("a_flight_id").alias("f1"), c("b_flight_id").alias("f2")).agg(
        F.min_by(F.struct("a_country", "b_country", "nm", F.floor((c("a_ts") + c("b_ts")) / 2).alias("ts")), F.struct("nm", "a_ts", "b_ts")).alias("b"))
    m = c("min_nm")
    return (best.select("f1", "f2", F.concat_ws("-", F.least("b.a_country", "b.b_country"), F.greatest("b.a_country", "b.b_country")).alias("pair"),
                        F.round("b.nm", 1).alias("min_nm"), "b.ts")
            .withColumn("severity", F.when(m < 5, "critical").when(m < 15, "high").when(m < 30, "medium").otherwise("low")))


def similar_candidates(tracks: DataFrame, meta: DataFrame, target: DataFrame, rules: DataFrame | None = None, margin: float = 0.5) -> DataFrame:
    """Flights to hold against ``target`` (one flight): of its known route, or through its extent where no such flight is.

    With both ends known a candidate has both; with one end known, that one. Without any candidate of the route, flights with
    a point within the target's box, widened by ``margin`` degrees, are taken. ``rules`` (flight_id, rule_id): keep those with a
    rule of the target's, if it has any.
    """
    known = lambda x: F.nullif(F.nullif(c(x), F.lit("")), F.lit("UNKNOWN"))
    m = meta.select("flight_id", known("origin_airport").alias("o"), known("destination_airport").alias("d"))
    mine = m.join(target, "flight_id", "left_semi").select(c("o").alias("_o"), c("d").alias("_d")).limit(1)     # one row
    same = F.when(c("_o").isNotNull() & c("_d").isNotNull(), (c("o") == c("_o")) & (c("d") == c("_d"))).otherwise((c("o") == c("_o")) | (c("d") == c("_d")))
    found = m.join(F.broadcast(mine), F.coalesce(same, F.lit(False))).join(target, "flight_id", "left_anti").select("flight_id").distinct()
    if not found.limit(1).count():
        box = tracks.join(target, "flight_id", "left_semi").agg(F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")).first()
        if box[0] is None:
            return found
        south, north, west, east = box[0] - margin, box[1] + margin, box[2] - margin, box[3] + margin
        found = tracks.where(geo.in_box("lat", "lon", south, north, west, east)).select("flight_id").distinct().join(target, "flight_id", "left_anti")
    if rules is not None:
        asked = rules.join(target, "flight_id", "left_semi").select("rule_id").distinct()
        if asked.limit(1).count():
            found = found.join(rules.join(asked, "rule_id", "left_semi").select("flight_id").distinct(), "flight_id", "left_semi")
    return found


def similar_flights(tracks: DataFrame, target: DataFrame, candidates: DataFrame, nm: float = 5.0, share: float = 0.8, k: int = 15) -> DataFrame:
    """Share of a flight's points that have a candidate's point within nm. ``target``/``candidates``: flight_id.

    The target's points, those of one flight, are copied to the cells that they reach; a candidate's point is in one cell, and is
    read only if it lies in the target's extent, widened by nm. Points and candidates are checkpointed, so that the plan of the
    tracks is not repeated in each branch.
    """
    g = nm / 59.5
    wide = lambda band: g / F.cos(F.radians(F.least(F.abs(band) + 2, F.lit(88))))
    own = cut(tracks.join(target, "flight_id", "left_semi").select(c("ts").alias("pid"), "lat", "lon"))
    south, north, west, east = own.agg(F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")).first()
    if south is None or west is None:
        reached = F.lit(False)
    else:
        top = max(abs(south), abs(north)) + g
        far = 1.001 * g / math.cos(math.radians(top)) if top < 86 else 360.0
        reached = geo.in_box("lat", "lon", south - 1.001 * g, north + 1.001 * g, west - far, east + far)
    other = tracks.where(reached).join(cut(candidates), "flight_id", "left_semi").select("flight_id", c("lat").alias("blat"), c("lon").alias("blon"))
    b = other.withColumns({"_b": F.floor("blat"), "_y": F.floor(c("blat") / g)}).withColumn("_x", F.floor(c("blon") / wide(c("_b"))))
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    a = own.withColumn("_b", F.explode(F.array_distinct(F.array(F.floor(c("lat") - g), F.floor("lat"), F.floor(c("lat") + g)))))
    a = a.withColumn("_y", F.explode(F.transform(near, lambda d: F.floor(c("lat") / g) + d)))
    a = a.withColumn("_x", F.explode(F.transform(near, lambda d: F.floor(c("lon") / wide(c("_b"))) + d)))
    hit = (join_hot(cut(b), a, ["_b", "_y", "_x"]).where(geo.haversine("lat", "lon", "blat", "blon") <= nm)
           .groupBy("flight_id").agg(F.count_distinct("pid").alias("near_points")))
    n = own.agg(F.count("*").alias("n")).withColumn("_k", F.lit(1))
    s = F.round(c("near_points") / c("n"), 4)
    return (hit.withColumn("_k", F.lit(1)).join(F.broadcast(n), "_k").withColumn("similarity", s).where(c("similarity") >= share)
            .select("flight_id", "near_points", "similarity").orderBy(F.desc("similarity"), "flight_id").limit(k))


def live_status(tracks: DataFrame, last: int = 10) -> DataFrame:
    """Phase of flight from the last points: altitude band, then the change over them."""
    w = Window.partitionBy("flight_id").orderBy(F.desc("ts"))
    p = tracks.select("flight_id", "ts", F.coalesce("alt", F.lit(0.0)).alias("alt")).withColumn("_r", F.row_number().over(w)).where(c("_r") <= last)
    g = p.groupBy("flight_id").agg(F.max_by("alt", "ts").alias("a"), (F.max_by("alt", "ts") - F.min_by("alt", "ts")).alias("d"), F.count("*").alias("n"))
    a, d = c("a"), c("d")

    def by_change(limit, up, down, level):
        return F.when(d > limit, up).when(d < -limit, down).otherwise(level)

    single = F.when(a > 25000, "CRUISE").when(a > 10000, "CLIMB").when(a < 3000, "APPROACH").otherwise("UNKNOWN")
    status = (F.when(c("n") < 2, single).when(a < 1000, "GROUND").when(a < 5000, by_change(500, "TAKEOFF", "LANDING", "APPROACH"))
              .when(a < 15000, by_change(1000, "CLIMB", "DESCENT", "APPROACH")).otherwise(by_change(500, "CLIMB", "DESCENT", "CRUISE")))
    return g.select("flight_id", status.alias("status"))


# -- behaviour score
# Sensitive zones (name, latitude, longitude, radius in nm, severity, kind).
ZONES = [
    ("Ben Gurion TMA", 32.011389, 34.886667, 25, "medium", "airport_tma"),
    ("Northern Border Zone", 33.1, 35.5, 15, "high", "border"),
    ("Eastern Border Zone", 31.5, 35.5, 10, "high", "border"),
    ("Dimona Restricted", 31.0, 35.15, 20, "critical", "restricted"),
    ("Gaza Buffer Zone", 31.4, 34.4, 15, "critical", "conflict"),
    ("Lebanon FIR Border", 33.3, 35.5, 10, "high", "fir_boundary"),
    ("Syria FIR Border", 32.8, 36.0, 15, "high", "fir_boundary"),
]


def zone_factor(tracks: DataFrame, zones=None, last: int = 10) -> DataFrame:
    """Closest sensitive zone over the last points; row_number <= k is applied before the shuffle too."""
    zones = ZONES if zones is None else zones
    w = Window.partitionBy("flight_id").orderBy(F.desc("ts"))
    p = tracks.select("flight_id", "ts", "lat", "lon").withColumn("_r", F.row_number().over(w)).where(c("_r") <= last)
    d = [geo.haversine("lat", "lon", z[1], z[2]) for z in zones]
    crit = F.lit(False)
    for z, x in zip(zones, d):
        if z[4] == "critical":
            crit = crit | (x < z[3] * 1.5)
    g = p.groupBy("flight_id").agg(F.min(F.least(*d)).alias("nm"), F.bool_or(crit).alias("crit"))
    return g.select("flight_id", F.when(c("crit"), 30).when(c("nm") < 10, 25).when(c("nm") < 25, 15).when(c("nm") < 50, 5).otherwise(0).alias("zone_score"))


def heading_factor(tracks: DataFrame, zones=None) -> DataFrame:
    zones = ZONES if zones is None else zones
    p = with_neighbours(tracks.select("flight_id", "ts", "lat", "lon", "track"), {"p_ts": "ts", "p_track": "track"})
    dt, turn = c("ts") - c("p_ts"), F.abs(geo.heading_delta("track", "p_track"))
    toward = F.lit(False)
    for z in zones:
        if z[4] in ("critical", "high"):
            toward = toward | (F.abs(geo.heading_delta(c("track"), geo.bearing("lat", "lon", z[1], z[2]))) < 30)
    sudden = F.coalesce((dt > 0) & (dt < 60) & (turn > 30), F.lit(False))
    g = p.groupBy("flight_id").agg(F.count("*").alias("n"), F.count_if(sudden).alias("s"), F.count_if(sudden & toward).alias("t"))
    v = F.when(c("n") < 3, 0).when(c("t") >= 2, 25).when(c("t") == 1, 15).when(c("s") >= 3, 10).when(c("s") >= 1, 5).otherwise(0)
    return g.select("flight_id", v.alias("heading_score"))


def altitude_factor(tracks: DataFrame, zones=None) -> DataFrame:
    """Drops over 2000 ft between known altitudes, lowest of the last five, unless over an airport area."""
    zones = ZONES if zones is None else zones
    known = tracks.where("alt is not null and alt <> 0").select("flight_id", "ts", "alt")
    p = with_neighbours(known, {"p_alt": "alt"})
    drops = p.groupBy("flight_id").agg(F.count_if(c("p_alt") - c("alt") > 2000).alias("drops"))
    w = Window.partitionBy("flight_id").orderBy(F.desc("ts"))
    low = known.withColumn("_r", F.row_number().over(w)).where(c("_r") <= 5).groupBy("flight_id").agg(F.min("alt").alias("low"))
    last = tracks.groupBy("flight_id").agg(F.max_by(F.struct("lat", "lon"), "ts").alias("p"), F.count("*").alias("n"))
    near = F.lit(False)
    for z in zones:
        if z[5] == "airport_tma":
            near = near | (geo.haversine("p.lat", "p.lon", z[1], z[2]) < z[3])
    j = last.withColumn("near", near).join(low, "flight_id", "left").join(drops, "flight_id", "left")
    v = (F.when((c("n") < 3) | c("low").isNull(), 0).when((c("low") < 3000) & ~c("near"), 20).when(c("drops") >= 2, 15).when(c("drops") == 1, 8)
         .when((c("low") < 5000) & ~c("near"), 5).otherwise(0))
    return j.select("flight_id", v.alias("altitude_score"))


def speed_factor(tracks: DataFrame) -> DataFrame:
    p = with_neighbours(tracks.where("gspeed is not null and gspeed <> 0").select("flight_id", "ts", "gspeed"), {"p_sp": "gspeed"})
    g = p.groupBy("flight_id").agg(F.avg("gspeed").alias("a"), F.max("gspeed").alias("hi"), F.min("gspeed").alias("lo"), F.count("*").alias("n"),
                                   F.count_if(F.abs(c("gspeed") - c("p_sp")) > 50).alias("ch"))
    v = (F.when((c("hi") > 500) & (c("lo") < 150), 15).when(c("ch") >= 3, 10).when((c("a") < 100) & (c("n") > 20), 8).when(c("ch") >= 1, 3).otherwise(0))
    return g.select("flight_id", v.alias("speed_score"))


def operator_factor(tracks: DataFrame, reports: DataFrame) -> DataFrame:
    """Reports against the callsign prefix; a few prefixes score by themselves. ``reports``: flight_id, callsign."""
    first = tracks.where("callsign is not null and callsign <> ''").groupBy("flight_id").agg(F.min_by("callsign", "ts").alias("cs"))
    hist = reports.groupBy(F.substring("callsign", 1, 3).alias("_p")).agg(F.count("*").alias("h"))
    j = first.join(hist, F.substring("cs", 1, 3) == c("_p"), "left")
    v = (F.when(keys.starts_with_any(F.upper("cs"), ["RCH", "CNV", "QUID", "RRR", "IAF"]), 5).when(c("h") > 5, 10).when(c("h") > 2, 5).otherwise(0))
    return j.select("flight_id", v.alias("operator_score"))


def behaviour_score(tracks: DataFrame, reports: DataFrame, zones=None) -> DataFrame:
    n = tracks.groupBy("flight_id").agg(F.count("*").alias("points"))
    parts = [zone_factor(tracks, zones), heading_factor(tracks, zones), altitude_factor(tracks, zones), speed_factor(tracks), operator_factor(tracks, reports)]
    j = n
    for p in parts:
        j = j.join(p, "flight_id", "left")
    names = ["zone_score", "heading_score", "altitude_score", "speed_score", "operator_score"]
    total = sum((F.coalesce(c(x), F.lit(0)) for x in names[1:]), F.coalesce(c(names[0]), F.lit(0)))
    enough = c("points") >= 5
    s = F.when(enough, F.least(F.lit(100), total)).otherwise(0)
    return (j.withColumns({x: F.coalesce(c(x), F.lit(0)) for x in names}).withColumn("score", s)
            .withColumn("level", F.when(~enough, "unknown").when(c("score") >= 70, "critical").when(c("score") >= 50, "high").when(c("score") >= 30, "medium").otherwise("low"))
            .withColumn("confidence", F.when(enough, F.round(F.least(F.lit(0.95), 0.5 + c("points") / 100 * 0.3), 2)).otherwise(0.0)))


