"""Operators over ordered track points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold import config as C
from wayfold.functions import geo, keys
from wayfold.operators.hotkeys import join_by_slice
from wayfold.operators.nearest import nearest_airport, away_from
from wayfold.operators.windows import (cut, exact_quantiles, running_sum, sliced_row_number, shifted_rows, with_halo,
                                       with_neighbours, with_slice, SLICE)


def pairs(tracks: DataFrame) -> DataFrame:
    """Consecutive points of each track."""
    return with_neighbours(tracks.select("flight_id", "ts", "lat", "lon", "alt"),
                           {"prev_ts": "ts", "prev_lat": "lat", "prev_lon": "lon", "prev_alt": "alt"})


def signal_gaps(tracks: DataFrame, gap_s: int = 300, min_alt: float | None = 5000, inclusive: bool = False) -> DataFrame:
    """Gaps between consecutive points, placed at the point before the gap."""
    p = pairs(tracks)
    g = F.col("ts") - F.col("prev_ts")
    ok = (g >= gap_s) if inclusive else (g > gap_s)
    if min_alt is not None:
        ok = ok & (F.col("prev_alt").isNull() | (F.col("prev_alt") > min_alt))
    return p.where(ok).select(
        "flight_id", F.col("prev_ts").alias("gap_start"), F.col("ts").alias("gap_end"), F.col("prev_lat").alias("lat"),
        F.col("prev_lon").alias("lon"), F.col("prev_alt").alias("alt"), g.alias("gap_s"),
        F.col("lat").alias("end_lat"), F.col("lon").alias("end_lon"))


def gaps_away(tracks: DataFrame, airports: DataFrame, nm: float = 5, **kw) -> DataFrame:
    g = signal_gaps(tracks, **kw)
    return away_from(g, airports, nm, radius=C.EARTH_NM_STATS)


def gaps_by(gaps: DataFrame, key: Column, name: str) -> DataFrame:
    return (gaps.groupBy(key.alias(name))
            .agg(F.count("*").alias("count"), F.count_distinct("flight_id").alias("affected_flights"),
                 F.floor(F.avg("gap_s")).alias("avg_duration")))


# Altitudes typical of spoofed positions, in feet.
SPOOFED_FT = [34764, 44700, 44600, 44500, 40000, 40400, 40800, 36864, 42100, 42500, 42700]


def deltas(tracks: DataFrame, with_previous_turn: bool = False) -> DataFrame:
    """Step distance, implied speed, rates, turn and bearing mismatch against the point before."""
    prev = {f"prev_{c}": c for c in ("ts", "lat", "lon", "alt", "gspeed", "track")}
    base = with_neighbours(
        tracks.select("flight_id", "ts", "lat", "lon", "alt", "gspeed", "vspeed", "track", "source"), prev,
        prev2={"prev2_track": "track", "prev2_ts": "ts"} if with_previous_turn else None)
    dt = F.col("ts") - F.col("prev_ts")
    per = lambda c: F.when(dt > 0, c / dt).otherwise(F.lit(0.0))
    dist = geo.haversine("prev_lat", "prev_lon", "lat", "lon", C.EARTH_NM_STATS)
    out = base.where(F.col("prev_ts").isNotNull()).withColumns({"dt": dt, "dist_nm": dist}).withColumns({
        "speed_kt": per(F.col("dist_nm") * 3600), "alt_diff": F.abs(F.col("alt") - F.col("prev_alt")),
        "turn": F.coalesce(geo.heading_delta("track", "prev_track"), F.lit(0.0))}).withColumns({
            "alt_rate": per(F.col("alt_diff")), "turn_rate": per(F.abs("turn")),
            "mismatch": F.when((F.col("dist_nm") > 0.1) & F.col("track").isNotNull(), F.abs(geo.heading_delta(
                F.col("track"), geo.bearing("prev_lat", "prev_lon", "lat", "lon")))).otherwise(F.lit(0.0))})
    if with_previous_turn:
        before = F.when(F.col("prev2_ts").isNotNull(),
                        F.coalesce(geo.heading_delta("prev_track", "prev2_track"), F.lit(0.0))).otherwise(F.lit(0.0))
        out = out.withColumn("prev_turn", before)
    return out


def oscillates() -> Column:
    """Turn against the previous turn, both beyond 30 degrees."""
    p, t = F.col("prev_turn"), F.col("turn")
    return ((p > 30) & (t < -30)) | ((p < -30) & (t > 30))


def point_features(tracks: DataFrame) -> DataFrame:
    """Per-point rates and trailing sums: turn and speed over 300 s, altitude over 60 s."""
    b = with_neighbours(tracks.select("flight_id", "ts", "lat", "lon", "alt", "gspeed", "vspeed", "track"),
                        {f"prev_{c}": c for c in ("ts", "lat", "lon", "alt", "gspeed", "vspeed", "track")})
    first = F.col("prev_ts").isNull()
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    dt = F.when(first, 1.0).otherwise(F.greatest(F.lit(1.0), (F.col("ts") - F.col("prev_ts")).cast("double")))
    diff = lambda c: F.when(first, 0.0).otherwise(z(c) - z(f"prev_{c}"))
    turn = F.when(first | F.col("track").isNull() | F.col("prev_track").isNull(), 0.0).otherwise(
        geo.heading_delta("track", "prev_track"))
    p = b.withColumns({"dt": dt, "d_alt": diff("alt"), "turn_deg": turn,
                       "distance_step_m": F.when(first, 0.0).otherwise(
                           geo.haversine("prev_lat", "prev_lon", "lat", "lon", C.EARTH_M))}).withColumns({
        "climb_rate": F.col("d_alt") / F.col("dt"), "speed_accel": diff("gspeed") / F.col("dt"),
        "vert_accel": diff("vspeed") / F.col("dt"), "turn_rate": F.col("turn_deg") / F.col("dt"),
        "vspeed_abs": F.abs(z("vspeed")), "phase": keys.flight_phase(z("alt"), z("vspeed"))})
    keep = ["flight_id", "ts", "lat", "lon", "alt", "gspeed", "vspeed", "distance_step_m", "climb_rate", "speed_accel",
            "vert_accel", "turn_rate", "vspeed_abs", "phase", "d_alt", "turn_deg"]
    h = with_halo(p.select(*keep), before=300, after=0)
    w = Window.partitionBy("flight_id", SLICE).orderBy("ts")
    return (h.withColumns({"cum_turn_300": F.sum("turn_deg").over(w.rangeBetween(-300, 0)),
                           "cum_alt_60": F.sum("d_alt").over(w.rangeBetween(-60, 0)),
                           "avg_speed_300": F.avg("gspeed").over(w.rangeBetween(-300, 0))})
            .where("_core").drop("_core", SLICE, "d_alt", "turn_deg"))


SERIES = ["alt", "gspeed", "vspeed", "climb_rate", "speed_accel", "vert_accel", "turn_rate", "vspeed_abs",
          "cum_turn_300", "cum_alt_60", "avg_speed_300"]


def flight_features(features: DataFrame) -> DataFrame:
    """One row per flight: six moments of eleven series, phase shares."""
    features = cut(features)        # read by the moments and by the quantiles
    aggs = [(F.max("ts") - F.min("ts")).alias("duration"), F.count("*").alias("num_points")]
    for c in SERIES:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"), F.min(c).alias(f"{c}_min"),
                 F.max(c).alias(f"{c}_max")]
    aggs += [F.avg(F.when(F.col("phase") == p, 1.0).otherwise(0.0)).alias(f"phase_{p}_pct")
             for p in ("ground", "climb", "descent", "cruise")]
    moments = features.groupBy("flight_id").agg(*aggs)
    return moments.join(exact_quantiles(features, "flight_id", SERIES, [0.05, 0.95]), "flight_id")


def flight_summary(tracks: DataFrame, extended: bool = False) -> DataFrame:
    """Start, end, extremes, length and squawks of each flight."""
    p = with_neighbours(tracks.select("flight_id", "ts", "lat", "lon", "alt", "gspeed", "vspeed", "squawk"),
                        {"prev_lat": "lat", "prev_lon": "lon"})
    step = geo.haversine("prev_lat", "prev_lon", "lat", "lon", C.EARTH_NM_STATS)
    up, sp = F.when(F.col("alt") > 0, F.col("alt")), F.when(F.col("gspeed") >= 0, F.col("gspeed"))
    sq = F.when(F.col("squawk").isNotNull() & ~F.col("squawk").isin("", "0", "None"), F.col("squawk"))
    aggs = [F.min("ts").alias("flight_start_ts"), F.max("ts").alias("flight_end_ts"),
            (F.max("ts") - F.min("ts")).alias("flight_duration_sec"), F.count("*").alias("total_points"),
            F.min(up).alias("min_altitude_ft"), F.max(up).alias("max_altitude_ft"), F.avg(up).alias("avg_altitude_ft"),
            F.min(sp).alias("min_speed_kts"), F.max(sp).alias("max_speed_kts"), F.avg(sp).alias("avg_speed_kts"),
            F.min_by("lat", "ts").alias("start_lat"), F.min_by("lon", "ts").alias("start_lon"),
            F.max_by("lat", "ts").alias("end_lat"), F.max_by("lon", "ts").alias("end_lon"),
            F.round(F.coalesce(F.sum(step), F.lit(0.0)), 2).alias("total_distance_nm"),
            # A squawk is a four-digit octal code: at most 4096 values.
            F.array_sort(F.collect_set(sq)).alias("squawk_codes")]
    if extended:
        aggs += [F.max("vspeed").alias("max_vspeed_fpm"), F.min("vspeed").alias("min_vspeed_fpm")]
    return p.groupBy("flight_id").agg(*aggs)


# Runway heading bands per airport.
RUNWAY_BANDS = {
    "LLBG": {"03": (20, 40), "21": (200, 220), "08": (70, 90), "26": (250, 270), "12": (110, 130), "30": (290, 310)},
    "LLER": {"03": (20, 40), "21": (200, 220)}, "LLHA": {"16": (150, 170), "34": (330, 350)},
    "LLOV": {"02": (10, 30), "20": (190, 210)}, "LLSD": {"08": (70, 90), "26": (250, 270)},
    "LLET": {"01": (0, 20), "19": (180, 200)}, "LLRD": {"15": (140, 160), "33": (320, 340)},
    "LLMZ": {"03": (20, 40), "21": (200, 220)},
}
# Position (latitude, longitude) of those airports.
RUNWAY_AIRPORTS = {
    "LLBG": (32.0114, 34.8867), "LLER": (29.7255, 35.0119), "LLHA": (32.8094, 35.0431), "LLOV": (29.9403, 34.9358),
    "LLSD": (32.1147, 34.7822), "LLET": (29.5613, 34.9601), "LLRD": (32.9810, 35.5718), "LLMZ": (30.7761, 34.8067),
}


def runway_usage(tracks: DataFrame, lat: float, lon: float, bands: dict, nm: float = 10,
                 max_alt: float = 5000, low: float = 1500) -> DataFrame:
    """Landings and take-offs per runway of one airport; runways without traffic keep zero."""
    d = nm / 60
    near = tracks.where(geo.in_box("lat", "lon", lat - d, lat + d, lon - d, lon + d)
                        & F.col("alt").between(0, max_alt) & F.col("track").isNotNull())
    per = near.groupBy("flight_id").agg(
        F.count("*").alias("n"), F.min_by("alt", "ts").alias("a0"), F.max_by("alt", "ts").alias("a1"),
        F.min("alt").alias("lo"), F.min_by("track", F.struct("alt", "ts")).alias("hdg")).where("n >= 3")
    runway = F.when(F.lit(False), "")
    for name, (lo, hi) in bands.items():
        runway = runway.when(F.col("hdg").between(lo, hi), name)
    use = per.where((F.col("lo") < low) & (F.col("a0") != F.col("a1"))).withColumn("runway", runway)
    n = use.groupBy("runway").agg(F.count_if(F.col("a0") > F.col("a1")).alias("landings"),
                                  F.count_if(F.col("a0") < F.col("a1")).alias("takeoffs"))
    every = tracks.sparkSession.createDataFrame([(r,) for r in bands], "runway string")
    return (every.join(n, "runway", "left").select(
        "runway", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("landings", "takeoffs")])
        .withColumn("total", F.col("landings") + F.col("takeoffs")))


def burst_clusters(flagged: DataFrame, max_gap: int = 60) -> DataFrame:
    """Number of bursts per flight: runs of flagged instants at most a minute apart, two or more.

    A burst starts where the previous instant is too far and the next one is near.
    """
    p = with_neighbours(flagged.select("flight_id", "ts").distinct(), {"prev_ts": "ts"}, {"next_ts": "ts"})
    start = F.coalesce(F.col("ts") - F.col("prev_ts") > max_gap, F.lit(True))
    more = F.coalesce(F.col("next_ts") - F.col("ts") <= max_gap, F.lit(False))
    return p.groupBy("flight_id").agg(F.count_if(start & more).alias("clusters"))


def warning_buffer(points: DataFrame, warn: Column, size: int = 15, share: float = 0.8) -> DataFrame:
    """Points whose last ``size`` points (buffer full) carry at least that share of warnings.

    The buffer sum is a difference of two running sums; the older one is fetched by
    row number, so no whole track is ordered in one task.
    """
    r = running_sum(points, {"_cum": F.when(warn, 1).otherwise(0), "_rn": F.lit(1)})
    j = shifted_rows(r, size, {"_old": "_cum"}, numbered=True)
    n = F.col("_cum") - F.coalesce("_old", F.lit(0))
    return j.withColumn("warnings", F.when(F.col("_rn") >= size, n)).withColumn(
        "alarm", F.coalesce(F.col("warnings") >= share * size, F.lit(False))).drop("_cum", "_old", "_rn")


def key_locations(tracks: DataFrame, k: int = 5) -> DataFrame:
    """k evenly spaced points of each track (all of them if fewer)."""
    n = sliced_row_number(with_slice(tracks.select("flight_id", "ts", "lat", "lon", "alt")), "flight_id", SLICE, ["ts"], "_rn")
    total = tracks.groupBy("flight_id").agg(F.count("*").alias("_n"))
    j = join_by_slice(n, total, C.SLICE_S, slices_of=tracks).withColumn("_i", F.col("_rn") - 1)
    # Row i is kept when it is floor(m * n / k) for some m below k.
    m = F.ceil(F.col("_i") * k / F.col("_n"))
    hit = (F.col("_n") <= k) | ((m < k) & (F.floor(m * F.col("_n") / k) == F.col("_i")))
    return j.where(hit).select("flight_id", "ts", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"), "alt")


# Holding areas used to call a pattern offshore (name, lat, lon, radius in nm).
HOLDING_AREAS = [("Eastern Med Track", 34.0, 33.0, 100.0), ("Gulf Track", 27.0, 52.0, 100.0),
                 ("Red Sea Track", 22.0, 37.0, 100.0)]


def flight_patterns(tracks: DataFrame, areas=None) -> DataFrame:
    """Orbit, racetrack, loiter or transit per flight, with the role it suggests.

    The 45-degree turn counter resets at every crossing. Only "two" and "three" are ever
    asked of it, so it is answered by three rounds of "first point that far from the last
    crossing" over a running sum, each a plain aggregate.
    """
    areas = HOLDING_AREAS if areas is None else areas
    d = with_neighbours(tracks.select("flight_id", "ts", "lat", "lon", "track"),
                        {"prev_lat": "lat", "prev_lon": "lon", "prev_track": "track"})
    turn = F.coalesce(geo.heading_delta("track", "prev_track"), F.lit(0.0))
    step = F.coalesce(geo.haversine("prev_lat", "prev_lon", "lat", "lon"), F.lit(0.0))
    s = cut(running_sum(d.withColumns({"turn": turn, "step": step}), {"cum": F.col("turn")})
            .select("flight_id", "ts", "lat", "lon", "step", "cum"))
    per = s.groupBy("flight_id").agg(
        F.count("*").alias("points"), F.abs(F.max_by("cum", "ts")).alias("abs_total"), F.sum("step").alias("dist"),
        ((F.max("ts") - F.min("ts")) / 60).alias("minutes"), F.avg("lat").alias("alat"), F.avg("lon").alias("alon"),
        geo.haversine(F.min_by("lat", "ts"), F.min_by("lon", "ts"), F.max_by("lat", "ts"), F.max_by("lon", "ts")).alias("disp"))
    cross = s.groupBy("flight_id").agg(F.lit(-1).cast("bigint").alias("_t"), F.lit(0.0).alias("_c"), F.lit(0).alias("turns"))
    for _ in range(3):
        hit = (join_by_slice(s.select("flight_id", "ts", "cum"), cross, C.SLICE_S)
               .where((F.col("ts") > F.col("_t")) & (F.abs(F.col("cum") - F.col("_c")) >= 45))
               .groupBy("flight_id").agg(F.min("ts").alias("_nt"), F.min_by("cum", "ts").alias("_nc")))
        cross = (cross.join(hit, "flight_id", "left").select(
            "flight_id", F.coalesce("_nt", F.lit(1 << 60)).alias("_t"), F.coalesce("_nc", "_c").alias("_c"),
            (F.col("turns") + F.col("_nt").isNotNull().cast("int")).alias("turns")))
    off = F.lit(False)
    for _, la, lo, r in areas:
        off = off | (geo.haversine("alat", "alon", la, lo) < r)
    eff = F.when(F.col("dist") > 0, F.col("disp") / F.col("dist")).otherwise(1.0)
    j = per.join(cross, "flight_id").withColumns({"offshore": off, "efficiency": eff,
                                                  "loiter_min": F.round("minutes", 1), "length_nm": F.round("dist", 1)})
    e, mins, turns, tot = F.col("efficiency"), F.col("loiter_min"), F.col("turns"), F.col("abs_total")
    kind = (F.when(F.col("points") < 10, "unknown").when((tot >= 300) & (e < 0.3), "orbit")
            .when((turns >= 2) & (e > 0.2) & (e < 0.6), "racetrack").when((e < 0.4) & (mins > 60), "loiter")
            .when((e > 0.7) | (tot < 90), "transit").when(turns >= 3, "racetrack").otherwise("transit"))
    wide = (turns >= 2) & (e > 0.2) & (e < 0.6)
    role = (F.when((F.col("kind") == "orbit") & F.col("offshore") & (mins > 60), "tanker")
            .when((F.col("kind") == "racetrack") & (~wide | (mins > 120) | (F.col("dist") > 200)), "ISR")
            .when((F.col("kind") == "loiter") & F.col("offshore"), "tanker").when(F.col("kind") == "loiter", "ISR")
            .when((F.col("kind") == "transit") & ((e > 0.7) | (tot < 90)), "transport"))
    return j.withColumn("kind", kind).withColumn("role", role).select(
        "flight_id", F.col("kind").alias("pattern"), "role", "length_nm", "loiter_min", "offshore")


def runway_usage_at(tracks: DataFrame, airport: str) -> DataFrame:
    """``runway_usage`` of an airport by its code; an airport without known runways has no rows."""
    known = airport in RUNWAY_BANDS
    lat, lon = RUNWAY_AIRPORTS.get(airport, (0.0, 0.0))
    use = runway_usage(tracks, lat, lon, RUNWAY_BANDS.get(airport, {"": (0, 0)}))
    return use.select(F.lit(airport).alias("airport"), *use.columns) if known else use.select(F.lit(airport).alias("airport"), *use.columns).limit(0)


def smooth_track(tracks: DataFrame, window: int = 5, block: int = 4096) -> DataFrame:
    """Centred moving average of positions over ``window`` points (one more if even), fewer at the ends of a track.

    Tracks with fewer points than the window stay as they are. Rows are averaged in numbered blocks with the neighbouring
    rows copied in, so a long track is never ordered in one task. Points without a position count for nothing.
    """
    half = window // 2
    if block <= 2 * max(window, half):
        raise ValueError("block must be wider than two windows")
    n = sliced_row_number(with_slice(tracks.select("flight_id", "ts", "lat", "lon")), "flight_id", SLICE, ["ts"], "_rn")
    of = lambda x: F.floor(x / block)
    n = n.withColumn("_own", of(F.col("_rn"))).withColumn("_b", F.explode(F.sequence(of(F.col("_rn") - half), of(F.col("_rn") + half))))
    w = Window.partitionBy("flight_id", "_b")
    near = w.orderBy("_rn").rowsBetween(-half, half)
    # Only a track's first block can hold fewer rows than a window: then these are all there are.
    short = (F.col("_b") == 0) & (F.max("_rn").over(w) < window)
    out = n.withColumns({f"_{x}": F.when(short, F.col(x)).otherwise(F.avg(x).over(near)) for x in ("lat", "lon")})
    return out.where("_b = _own").select("flight_id", "ts", F.col("_lat").alias("lat"), F.col("_lon").alias("lon"))


def od_by_ends(tracks: DataFrame, airports: DataFrame, n: int = C.OD["points"], alt: float = C.OD["alt_ft"],
               nm: float = C.OD["nm"]) -> DataFrame:
    """Origin and destination from the first and last n points: low and near an airport.

    ``row_number() <= n`` is applied on the map side too, so a long track sends n rows per task.
    """
    def side(desc: bool, name: str) -> DataFrame:
        order = F.desc("ts") if desc else F.asc("ts")
        ends = (tracks.select("flight_id", "ts", "lat", "lon", "alt")
                .withColumn("_r", F.row_number().over(Window.partitionBy("flight_id").orderBy(order))).where(F.col("_r") <= n))
        near = nearest_airport(ends.where(F.coalesce("alt", F.lit(0.0)) <= alt), airports)
        return near.where(F.col("ap_nm") <= nm).groupBy("flight_id").agg(F.min_by("ap_code", "_r").alias(name))

    flights = tracks.select("flight_id").distinct()
    return (flights.join(side(False, "origin"), "flight_id", "left").join(side(True, "destination"), "flight_id", "left"))


def od_by_endpoints(tracks: DataFrame, airports: DataFrame, max_nm: float = 15) -> DataFrame:
    """Airport nearest to the first and to the last point, within a distance."""
    ends = tracks.groupBy("flight_id").agg(F.min_by(F.struct("lat", "lon"), "ts").alias("o"),
                                           F.max_by(F.struct("lat", "lon"), "ts").alias("d"))
    x = ends.select("flight_id", F.col("o.lat").alias("olat"), F.col("o.lon").alias("olon"),
                    F.col("d.lat").alias("dlat"), F.col("d.lon").alias("dlon"))
    x = nearest_airport(nearest_airport(x, airports, "o", "olat", "olon"), airports, "d", "dlat", "dlon")
    return x.select("flight_id", F.when(F.col("o_nm") <= max_nm, F.col("o_code")).alias("origin"),
                    F.when(F.col("d_nm") <= max_nm, F.col("d_code")).alias("destination"))


def path_chunk(tracks: DataFrame, lat: float, lon: float, radius_nm: float, half_km: float = 2.0) -> DataFrame:
    """Piece of each track within half_km along the path of its closest point to (lat, lon).

    Headings and speeds are those of the steps inside the piece; changes compare
    consecutive steps.
    """
    back = ("ts", "lat", "lon", "alt")
    p = with_neighbours(tracks.select("flight_id", "ts", "lat", "lon", "alt"),
                        {f"prev_{c}": c for c in back}, prev2={f"prev2_{c}": c for c in back})
    km = lambda a, b: geo.haversine(f"{a}lat", f"{a}lon", f"{b}lat", f"{b}lon", C.EARTH_KM)
    c = running_sum(p.withColumn("km", km("prev_", "")), {"cum_km": F.coalesce(F.col("km"), F.lit(0.0))})
    near = F.round(geo.haversine("lat", "lon", lat, lon), 9)
    close = (tracks.select("flight_id", "ts", near.alias("nm")).where(F.col("nm") <= radius_nm)
             .groupBy("flight_id").agg(F.min_by("ts", F.struct("nm", "ts")).alias("_ct")))
    # The closest point is one row: it is found by its own time, not among all points of its flight.
    centre = (c.select("flight_id", "ts", "cum_km").join(close.withColumn("ts", F.col("_ct")), ["flight_id", "ts"])
              .select("flight_id", F.col("cum_km").alias("_cc")))
    part = join_by_slice(c, centre, C.SLICE_S, slices_of=tracks).where(F.abs(F.col("cum_km") - F.col("_cc")) <= half_km)
    lo = part.groupBy("flight_id").agg(F.min("ts").alias("_lo"))
    part = join_by_slice(part, lo, C.SLICE_S).withColumns({
        "_v": F.col("km") * 3600 / (F.col("ts") - F.col("prev_ts")),
        "_v0": km("prev2_", "prev_") * 3600 / (F.col("prev_ts") - F.col("prev2_ts")),
        "_z": (F.col("alt") - F.col("prev_alt")) * 60 / (F.col("ts") - F.col("prev_ts")),
        "_z0": (F.col("prev_alt") - F.col("prev2_alt")) * 60 / (F.col("prev_ts") - F.col("prev2_ts"))})
    one = F.col("ts") > F.col("_lo")
    two = one & (F.col("prev_ts") > F.col("_lo"))
    total = lambda cond, x: F.round(F.sum(F.when(cond, x).otherwise(0.0)), 2)
    turn = F.abs(geo.heading_delta(geo.bearing("prev_lat", "prev_lon", "lat", "lon"),
                                   geo.bearing("prev2_lat", "prev2_lon", "prev_lat", "prev_lon")))
    mean = lambda x: F.round(F.coalesce(F.avg(F.when(one, x)), F.lit(0.0)), 2)
    return part.groupBy("flight_id").agg(
        F.count("*").alias("total_points"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"),
        total(two, turn).alias("total_heading_changes"), total(two, F.abs(F.col("_v") - F.col("_v0"))).alias("total_speed_changes"),
        total(one, F.abs(F.col("alt") - F.col("prev_alt"))).alias("total_alt_changes"),
        total(two, F.abs(F.col("_z") - F.col("_z0"))).alias("total_vspeed_changes"),
        mean(F.col("_v")).alias("avg_speed"), mean(F.col("_z")).alias("avg_vspeed"))
