"""Scans, filters, scalar functions, limits and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.functions import geo, keys
from wayfold.operators import scans
from wayfold.operators.nearest import nearest_airport, away_from
from wayfold.operators.shapes import in_ring
from wayfold.plans.registry import (query, sql_bearing, sql_cell, sql_date, sql_delta, sql_dow, sql_hav,
                                    sql_hour)

T0, T1 = 1704067200, 4102444800      # closed range that holds every point
PT = "flight_id, ts, lat, lon, alt"
r4 = lambda c: F.round(c, 4)


@query("a01_flight_points", f"""
with top as (select flight_id, count(*) n from tracks group by flight_id order by n desc, flight_id limit 1)
select {PT} from tracks where flight_id in (select flight_id from top)""")
def a01(t):
    # The busiest flight, found over the whole table, then its points by a semi join.
    top = scans.flight_list(t.tracks, limit=1).select("flight_id")
    return t.tracks.join(top, "flight_id", "left_semi").select(*PT.split(", ")).orderBy("ts")


query("a02_points_between", f"select {PT} from tracks where ts between {T0 + 900} and {T0 + 7200}")(
    lambda t: scans.points_between(t.tracks, T0 + 900, T0 + 7200).select(*PT.split(", ")))

query("a03_flight_list", "select flight_id, count(*) as points from tracks group by 1 having count(*) >= 40")(
    lambda t: scans.flight_list(t.tracks, 40))

query("a04_tracks_through_box", """
select flight_id, ts, lat, lon from tracks where flight_id in
 (select flight_id from tracks where lat between 30.5 and 31.0 and lon between 33.5 and 34.0)""")(
    lambda t: scans.tracks_through_box(t.tracks, 30.5, 31.0, 33.5, 34.0).select("flight_id", "ts", "lat", "lon"))

query("a05_normalised_points", """
select coalesce(case when source = 'MLAT' then null else flight_id end, 'UNKNOWN') as flight_id, ts, lat, lon,
 coalesce(case when source = 'MLAT' then null else alt end, 0.0) as alt, gspeed, vspeed, track, squawk, callsign, source
from tracks""")(
    # Raw strings with holes in them, as a feed sends them.
    lambda t: scans.normalise_points(t.tracks.select(
        *[F.when(F.col("source") == "MLAT", None).otherwise(F.col(c)).cast("string").alias(c)
          if c in ("flight_id", "alt") else F.col(c).cast("string").alias(c) for c in t.tracks.columns])))

query("a06_points_of_active_flights", f"""
select {PT} from tracks where ts between {T0} and {T1} and flight_id in
 (select flight_id from tracks where ts between {T0 + 7200 - 1800} and {T0 + 7200})""")(
    lambda t: scans.points_of_active(t.tracks, T0 + 7200, 30, T0, T1).select(*PT.split(", ")))

query("a07_tagged_track_union", """
select t.flight_id, t.ts, case when r.is_anomaly = 1 then 'anomaly' else 'normal' end as track_type
from tracks t left join reports r on r.flight_id = t.flight_id""")(
    lambda t: scans.tagged_union(
        t.tracks.join(t.reports.where("is_anomaly = 1"), "flight_id", "left_anti"),
        t.tracks.join(t.reports.where("is_anomaly = 1"), "flight_id", "left_semi"))
    .select("flight_id", "ts", "track_type"))

query("a08_report_flags", """
select flight_id, ts, has_1, has_4, has_6, has_8, has_11, case when has_1+has_4+has_6 > 0 then 1 else 0 end as has_safety
from reports""")(
    lambda t: t.reports.select("flight_id", "ts", "has_1", "has_4", "has_6", "has_8", "has_11",
                               F.when(F.col("has_1") + F.col("has_4") + F.col("has_6") > 0, 1).otherwise(0)
                               .alias("has_safety")))

query("a09_first_hit_source", """
with s as (select flight_id, ts, 0 as prio, 'live' as origin_table from tracks where source = 'MLAT'
 union all select flight_id, ts, 1, 'feedback' from tracks where flight_id in (select flight_id from reports where is_anomaly=1)
 union all select flight_id, ts, 2, 'research' from tracks)
select s.flight_id, ts, origin_table from s join (select flight_id, min(prio) m from s group by 1) b
 on s.flight_id = b.flight_id and prio = m""")(
    lambda t: scans.first_hit([
        ("live", t.tracks.where("source = 'MLAT'").select("flight_id", "ts")),
        ("feedback", t.tracks.join(t.reports.where("is_anomaly = 1"), "flight_id", "left_semi").select("flight_id", "ts")),
        ("research", t.tracks.select("flight_id", "ts"))]))

# Airport register rows made from suppliers: several rows share a code, the first in order wins.
RAW_PLACES = """
select s_suppkey as row_no, 'I' || cast(s_suppkey % 700 as string) as icao_code,
 case when s_suppkey % 3 = 0 then '' else 'D' || cast(s_suppkey % 500 as string) end as ident,
 case when s_suppkey % 2 = 0 then null else 'I' || cast(s_suppkey % 300 as string) end as gps_code,
 case when s_nationkey % 7 = 0 then '' else 'C' || cast(s_nationkey as string) end as iso_country,
 'C' || cast(s_nationkey as string) || '-R' as iso_region,
 case when s_suppkey % 5 = 0 then '' else s_name end as municipality, s_name as name
from supplier"""
query("a10_airport_places", f"""
with raw as ({RAW_PLACES}), c as (
 select row_no, 0 as i, icao_code as code, * exclude (row_no) from raw union all
 select row_no, 1, ident, * exclude (row_no) from raw union all
 select row_no, 2, coalesce(gps_code,''), * exclude (row_no) from raw),
 k as (select *, row_number() over (partition by code order by row_no, i) rn from c where code <> '' and iso_country <> '')
select code, iso_country, iso_region, municipality, name,
 case when municipality <> '' then municipality || ', ' || iso_country else iso_region end as place from k where rn = 1""")(
    lambda t: scans.airport_places(
        t.spark.sql(RAW_PLACES.replace("from supplier", "from {s}"), s=t.base("supplier")), "row_no"))

UPD = """select flight_id, callsign || 'X' as callsign, airline, origin_airport, destination_airport, aircraft_type,
 category, is_military, first_seen_ts, last_seen_ts + {k} as last_seen_ts, flight_duration_sec, total_points + {k} as total_points
from {src} where destination_airport is null"""


def _updates(t):
    both = [t.spark.sql(UPD.replace("{k}", str(k)).replace("{src}", "{m}"), m=t.meta) for k in (5, 9)]
    return both[0].unionByName(both[1])


query("a11_metadata_upsert", """
select flight_id, first_seen_ts, case when destination_airport is null then callsign || 'X' else callsign end as callsign,
 last_seen_ts + case when destination_airport is null then 9 else 0 end as last_seen_ts,
 total_points + case when destination_airport is null then 9 else 0 end as total_points from flight_metadata""")(
    lambda t: scans.upsert(t.meta, _updates(t), ["flight_id", "first_seen_ts"], ["last_seen_ts"])
    .select("flight_id", "first_seen_ts", "callsign", "last_seen_ts", "total_points"))

query("a12_insert_new_points", """
select flight_id, ts + 1 as ts from tracks where source = 'MLAT' and (flight_id, ts + 1) not in (select flight_id, ts from tracks)""")(
    lambda t: scans.insert_new(
        t.tracks.select("flight_id", "ts"),
        # Half of the arrivals are already stored, and new ones arrive twice.
        t.tracks.where("source = 'MLAT'").select("flight_id", F.explode(F.array(F.col("ts"), F.col("ts") + 1, F.col("ts") + 1)).alias("ts")),
        ["flight_id", "ts"]))

query("a13_report_upsert", """
select flight_id, ts, case when is_anomaly = 1 then 2 else is_anomaly end as is_anomaly, n_events from reports
union all select flight_id, ts + 60, 0, n_events from reports where is_anomaly = 0""")(
    lambda t: scans.upsert(
        t.reports.select("flight_id", "ts", "is_anomaly", "n_events"),
        t.reports.where("is_anomaly = 1").select("flight_id", "ts", F.lit(2).alias("is_anomaly"), "n_events")
        .unionByName(t.reports.where("is_anomaly = 0").select("flight_id", (F.col("ts") + 60).alias("ts"), "is_anomaly", "n_events")),
        ["flight_id", "ts"], ["is_anomaly"]))

query("a17_last_snapshots", f"""
select flight_id, ts, lat, lon from tracks where ts in (select distinct ts from tracks order by ts desc limit 3)""")(
    lambda t: scans.last_snapshots(t.tracks.select("flight_id", "ts", "lat", "lon"), 3))

# -- B
query("b01_region_points", """
select flight_id, ts, lat, lon from tracks where lat between 28.536275 and 34.597042 and lon between 32.299805 and 37.397461""")(
    lambda t: t.tracks.where(geo.in_region()).select("flight_id", "ts", "lat", "lon"))

# Callsign prefixes that are never evaluated.
EXCLUDED = ["4XC", "4XB", "CHLE", "4XA", "HMR"]
SKIPPED = ["4XA", "4XB", "4XC", "4XD"]


@query("b02_gateway_filter", """
select flight_id, case when count(*) filter (where alt > 5600) < 6 then 'No point above 5600 ft'
 when bool_or(regexp_matches(trim(upper(callsign)), '^(4XC|4XB|CHLE|4XA|HMR)')) then 'Excluded callsign prefix' end as reason
from tracks group by 1""")
def b02(t):
    low = F.count_if(F.col("alt") > 5600) < 6
    bad = F.bool_or(keys.starts_with_any(F.trim(F.upper(F.col("callsign"))), EXCLUDED))
    return t.tracks.groupBy("flight_id").agg(
        F.when(low, "No point above 5600 ft").when(bad, "Excluded callsign prefix").alias("reason"))


query("b03_above_altitude", """
select flight_id, count(*) filter (where alt > 12000) >= 6 as above from tracks group by 1""")(
    lambda t: t.tracks.groupBy("flight_id").agg((F.count_if(F.col("alt") > 12000) >= 6).alias("above")))


@query("b04_eligibility", """
with b as (select flight_id, min_by(callsign, ts) filter (where trim(callsign) <> '') as cs,
 count(*) filter (where lat between 28.536275 and 34.597042 and lon between 32.299805 and 37.397461) as n from tracks group by 1)
select flight_id, n as points_in_region, case when regexp_matches(upper(trim(cs)), '^4X[ABCD]') then 'SKIPPED_IGNORED_CALLSIGN'
 when n < 50 then 'SKIPPED_TOO_SHORT' else 'OK' end as status from b""")
def b04(t):
    cs = F.upper(F.trim(F.min_by("callsign", F.when(F.trim("callsign") != "", F.col("ts")))))
    return (t.tracks.groupBy("flight_id").agg(cs.alias("cs"), F.count_if(geo.in_region()).alias("points_in_region"))
            .select("flight_id", "points_in_region",
                    F.when(keys.starts_with_any("cs", SKIPPED), "SKIPPED_IGNORED_CALLSIGN")
                    .when(F.col("points_in_region") < 50, "SKIPPED_TOO_SHORT").otherwise("OK").alias("status")))


def rule_ids(t):
    """Report rows with the exact rule-id array (at most one entry per rule)."""
    return t.hits.groupBy("flight_id").agg(F.array_sort(F.collect_set("rule_id")).alias("rule_ids"))


query("b05_rule_membership", """
select flight_id, bool_or(rule_id = 1) as has_emergency, bool_or(rule_id = 4) as has_proximity,
 bool_or(rule_id = 11) as has_off_course from rule_hits group by 1""")(
    lambda t: rule_ids(t).select("flight_id", F.array_contains("rule_ids", 1).alias("has_emergency"),
                                 F.array_contains("rule_ids", 4).alias("has_proximity"),
                                 F.array_contains("rule_ids", 11).alias("has_off_course")))

query("b06_exact_token", """
select flight_id, count(*) filter (where rule_id = 1) > 0 as token_1 from rule_hits group by 1""")(
    lambda t: rule_ids(t).select("flight_id", F.array_contains(
        F.split(F.regexp_replace(F.array_join(F.col("rule_ids").cast("array<string>"), ", "), " ", ""), ","), "1")
        .alias("token_1")))

query("b07_missing_info", """
select count(*) as total, count(*) filter (where callsign is null or callsign = '') as no_callsign,
 count(*) filter (where destination_airport is null or destination_airport = '') as no_destination,
 round(100.0 * count(*) filter (where destination_airport is null) / count(*), 2) as no_destination_pct
from flight_metadata""")(
    lambda t: t.meta.agg(
        F.count("*").alias("total"), F.count_if(F.col("callsign").isNull() | (F.col("callsign") == "")).alias("no_callsign"),
        F.count_if(F.col("destination_airport").isNull() | (F.col("destination_airport") == "")).alias("no_destination"),
        F.round(100.0 * F.count_if(F.col("destination_airport").isNull()) / F.count("*"), 2).alias("no_destination_pct")))

query("b08_away_from_airports", f"""
select flight_id, ts from tracks t where not exists
 (select 1 from airports a where {sql_hav('t.lat', 't.lon', 'a.lat', 'a.lon', '3440.065')} <= 8)""")(
    lambda t: away_from(t.tracks, t.airports, 8, radius=3440.065).select("flight_id", "ts"))

# Named boxes used for breach and region tests (south, north, west, east), in test order.
ZONES = [("Sinai", 28.0, 31.0, 32.5, 34.5), ("Gaza Border", 31.2, 31.6, 34.2, 34.6),
         ("Lebanon Border", 33.0, 33.5, 35.0, 36.0), ("Central", 31.0, 33.0, 34.0, 35.5)]
ZONE_SQL = "(values " + ", ".join(f"({i},'{n}',{s},{no},{w},{e})" for i, (n, s, no, w, e) in enumerate(ZONES)) + \
           ") z(ord,zone,s,n,w,e)"


def first_zone(lat="lat", lon="lon", zones=ZONES):
    """Name of the first box that holds the point."""
    out = F.when(F.lit(False), F.lit(""))
    for name, s, n, w, e in zones:
        out = out.when(geo.in_box(lat, lon, s, n, w, e), name)
    return out


query("b13_zone_breach", f"""
select flight_id, ts, zone from tracks join {ZONE_SQL} on lat between s and n and lon between w and e""")(
    lambda t: t.tracks.select("flight_id", "ts", F.explode(F.filter(F.array(*[
        F.when(geo.in_box("lat", "lon", s, n, w, e), F.lit(name)) for name, s, n, w, e in ZONES]),
        lambda z: z.isNotNull())).alias("zone")))

query("c27_named_region", f"""
select flight_id, ts, (select min_by(zone, ord) from {ZONE_SQL} where lat between s and n and lon between w and e) as region
from tracks""")(
    lambda t: t.tracks.select("flight_id", "ts", first_zone().alias("region")))

RING = [(29.5137, 33.2071), (31.5113, 33.1039), (32.4151, 34.3067), (30.9091, 34.9021), (30.2177, 33.9043)]
WKT = "POLYGON((" + ", ".join(f"{lon} {lat}" for lat, lon in RING + RING[:1]) + "))"


def ring_lit(ring=RING):
    return F.array(*[F.struct(F.lit(a).alias("lat"), F.lit(o).alias("lon")) for a, o in ring])


def wkt_ring(text):
    """Vertices of the outer ring of a WKT polygon, read with expressions."""
    pairs = F.regexp_extract_all(text, F.lit(r"(-?[0-9.]+\s+-?[0-9.]+)"), 1)
    return F.transform(pairs, lambda p: F.struct(
        F.split(p, r"\s+")[1].cast("double").alias("lat"), F.split(p, r"\s+")[0].cast("double").alias("lon")))


def flights_through_ring(tracks, ring, south, north, west, east):
    """Box first (it reaches the scan), then the ray cast on what is left.

    The cast is no filter with a lambda: in the first query of a session, Spark's constraint inference makes of one a filter for a side
    of the join below that lacks its columns.
    """
    boxed = tracks.where(geo.in_box("lat", "lon", south, north, west, east)).select("flight_id", "lat", "lon")
    once = tracks.sparkSession.range(1).select(ring.alias("ring"))      # read once, not for each row
    return in_ring(boxed.crossJoin(F.broadcast(once))).select("flight_id").distinct()


def _ray_sql():
    parts = []
    for (ax, ay), (bx, by) in zip(RING, RING[1:] + RING[:1]):
        if ay == by:
            continue
        parts.append(f"(case when lon > {min(ay, by)} and lon <= {max(ay, by)} and lat <= {max(ax, bx)} and "
                     f"lat <= (lon-({ay}))*({bx}-({ax}))/({by}-({ay}))+{ax} then 1 else 0 end)")
    return "(" + "+".join(parts) + ") % 2 = 1"


BOX = (29.5137, 32.4151, 33.1039, 34.9021)
query("b11_flights_through_ring", f"select distinct flight_id from tracks where {_ray_sql()}")(
    lambda t: flights_through_ring(t.tracks, ring_lit(), *BOX))
query("b12_flights_through_wkt", f"select distinct flight_id from tracks where {_ray_sql()}")(
    lambda t: flights_through_ring(t.tracks, wkt_ring(F.lit(WKT)), *BOX))
query("c14_point_in_ring", f"select flight_id, ts, {_ray_sql()} as inside from tracks")(
    lambda t: t.tracks.select("flight_id", "ts", geo.point_in_ring("lat", "lon", ring_lit()).alias("inside")))

# -- C: one query per scalar, over all points
P0 = (32.011389, 34.886667)
P1 = (34.8751, 33.6249)


def point_query(name, sql_expr, expr, col):
    query(name, f"select flight_id, ts, {sql_expr} as {col} from tracks")(
        lambda t: t.tracks.select("flight_id", "ts", expr().alias(col)))


point_query("c01_haversine", f"round({sql_hav('lat', 'lon', *P0)},4)", lambda: r4(geo.haversine("lat", "lon", *P0)), "nm")
point_query("c02_bearing", f"round({sql_bearing('lat', 'lon', *P0)},4)", lambda: r4(geo.bearing("lat", "lon", *P0)), "deg")
point_query("c03_cross_track",
            f"round(abs(asin(sin({sql_hav(*P0, 'lat', 'lon', '1.0')})*sin(radians({sql_bearing(*P0, 'lat', 'lon')})"
            f"-radians({sql_bearing(*P0, *P1)})))*6371.0*0.539957),4)",
            lambda: r4(geo.cross_track_nm(*P0, *P1, "lat", "lon")), "nm")
DEST_LAT = ("degrees(asin(sin(radians(lat))*cos(25/0.539957/6371.0)"
            "+cos(radians(lat))*sin(25/0.539957/6371.0)*cos(radians(track))))")
point_query("c04_destination_lat", f"round({DEST_LAT},5)",
            lambda: F.round(geo.destination("lat", "lon", "track", 25)["lat"], 5), "dest_lat")
point_query("c04_destination_lon",
            "round(degrees(radians(lon)+atan2(sin(radians(track))*sin(25/0.539957/6371.0)*cos(radians(lat)),"
            f"cos(25/0.539957/6371.0)-sin(radians(lat))*sin(radians({DEST_LAT})))),5)",
            lambda: F.round(geo.destination("lat", "lon", "track", 25)["lon"], 5), "dest_lon")
point_query("c05_heading_delta", sql_delta("track", "vspeed"), lambda: geo.heading_delta("track", "vspeed"), "delta")
point_query("c06_heading_diff", "least(abs(track-135), 360-abs(track-135))",
            lambda: geo.heading_diff("track", 135.0), "diff")
point_query("c16_grid_key", f"round({sql_cell('lat', 0.25)},4)", lambda: r4(geo.grid("lat", 0.25)), "grid_lat")
point_query("c18_airline_code", "upper(substr(callsign,1,3))", lambda: keys.airline_code(), "airline")
point_query("c18_airline_letters",
            "case when length(regexp_replace(substr(substr(callsign,2),1,3),'[^A-Za-z]','','g')) >= 2 "
            "then upper(regexp_replace(substr(substr(callsign,2),1,3),'[^A-Za-z]','','g')) end",
            lambda: keys.airline_letters(F.substring("callsign", 2, 20)), "airline")
point_query("c20_flight_phase", "case when alt < 1000 then 'ground' when vspeed > 400 then 'climb' "
            "when vspeed < -400 then 'descent' else 'cruise' end", lambda: keys.flight_phase(), "phase")
point_query("c13_pair_distance_term", f"round({sql_hav('lat', 'lon', 'lat+0.1', 'lon+0.1')},4)",
            lambda: r4(geo.haversine("lat", "lon", F.col("lat") + 0.1, F.col("lon") + 0.1)), "nm")
SEG = ((30.0, 33.5), (32.0, 34.2))
point_query("c08_segment_distance",
            "round(least(" + ",".join(sql_hav("lat", "lon", repr(SEG[0][0] + i / 10 * (SEG[1][0] - SEG[0][0])),
                                              repr(SEG[0][1] + i / 10 * (SEG[1][1] - SEG[0][1])))
                                      for i in range(11)) + "),3)",
            lambda: F.round(geo.segment_distance_sampled(
                "lat", "lon", *[F.struct(F.lit(a).alias("lat"), F.lit(o).alias("lon")) for a, o in SEG]), 3), "nm")

query("c19_gap_class", "select flight_id, ts, rule_id, case when duration_s*10 < 900 then 'brief' when duration_s*10 < 3600 "
      "then 'medium' else 'extended' end as gap_type from rule_hits")(
    lambda t: t.hits.select("flight_id", "ts", "rule_id", keys.gap_class(F.col("duration_s") * 10).alias("gap_type")))

query("c21_body_class", "select flight_id, case aircraft_type when 'A333' then 'wide_body' when 'B738' then 'narrow_body' "
      "else 'unknown' end as body from flight_metadata")(
    lambda t: t.meta.select("flight_id", keys.body_class().alias("body")))

query("c22_military_org", "select flight_id, case when category = 'Military_and_government' then 'Military (Category)' end as by_category, "
      "case when callsign like 'RCH%' then 'US Air Force (Air Mobility Command)' end as by_callsign from flight_metadata")(
    lambda t: t.meta.select("flight_id", keys.military_org("callsign", None, "category").alias("by_category"),
                            keys.military_org("callsign").alias("by_callsign")))

query("c23_military_role", "select flight_id, case when callsign like 'RCH%' then 'transport' end as role from flight_metadata")(
    lambda t: t.meta.select("flight_id", keys.military_role(keys.military_org("callsign")).alias("role")))

query("c24_route_places", """
with p(code, place) as (values ('LLBG','Tel Aviv, IL'),('LCLK','Larnaca, CY'),('OJAI','Amman, JO'),('HECA','EG-C'),('LTFM','Istanbul, TR'))
select flight_id, a.place as origin_place, b.place as destination_place from flight_metadata m
left join p a on a.code = m.origin_airport left join p b on b.code = m.destination_airport""")(
    lambda t: scans.with_places(t.meta, t.spark.createDataFrame(
        [("LLBG", "Tel Aviv, IL"), ("LCLK", "Larnaca, CY"), ("OJAI", "Amman, JO"), ("HECA", "EG-C"),
         ("LTFM", "Istanbul, TR")], "code string, place string"))
    .select("flight_id", "origin_place", "destination_place"))

query("c25_time_keys", f"""
select flight_id, ts, rule_id, {sql_date()} as date, {sql_hour()} as hour, {sql_dow()} as dow,
 cast(month(cast({sql_date()} as date)) as int) as month, cast(quarter(cast({sql_date()} as date)) as int) as quarter,
 cast(year(cast({sql_date()} as date)) as int) as year from rule_hits""")(
    lambda t: t.hits.select("flight_id", "ts", "rule_id", keys.date_str().alias("date"), keys.hour_of().alias("hour"),
                            keys.weekday().alias("dow"), keys.month_of().alias("month"),
                            keys.quarter_of().alias("quarter"), keys.year_of().alias("year")))

# -- D02 with the scalar family: nearest airport of every point
query("d02_nearest_airport", f"""
with d as (select flight_id, ts, a.ord, a.code, {sql_hav('t.lat', 't.lon', 'a.lat', 'a.lon')} as nm from tracks t, airports a)
select flight_id, ts, min_by(code, (nm, ord)) as code, round(min(nm),4) as nm from d group by 1, 2""")(
    lambda t: nearest_airport(t.tracks, t.airports).select("flight_id", "ts", F.col("ap_code").alias("code"),
                                                           r4(F.col("ap_nm")).alias("nm")))

# -- L
query("l01_top_k", """
select flight_id, ts, rule_id, distance_nm from rule_hits order by distance_nm desc, flight_id, ts limit 50""")(
    lambda t: scans.top_k(t.hits.select("flight_id", "ts", "rule_id", "distance_nm"),
                          [F.desc("distance_nm"), F.col("flight_id"), F.col("ts")], 50))
query("l02_top_k_per_group", """
select * from (select airport, flight_id, ts, duration_s, row_number() over (partition by airport order by duration_s desc, flight_id, ts) as rank
 from rule_hits) where rank <= 5""")(
    lambda t: scans.top_k_per_group(t.hits.select("airport", "flight_id", "ts", "duration_s"), ["airport"],
                                    [F.desc("duration_s"), F.col("flight_id"), F.col("ts")], 5))
query("l03_page", "select flight_id, last_seen_ts from flight_metadata order by last_seen_ts desc, flight_id limit 20 offset 40")(
    lambda t: scans.page(t.meta.select("flight_id", "last_seen_ts"), [F.desc("last_seen_ts"), F.col("flight_id")], 20, 40))
@query("l04_severity_order", """
select sev, n, row_number() over (order by case sev when 'critical' then 0 when 'conflict' then 1 when 'warning' then 2 else 3 end) as pos
from (select case when distance_nm < 1 then 'critical' when distance_nm < 2 then 'conflict' when distance_nm < 3 then 'warning' else 'clear' end as sev,
 count(*) as n from rule_hits group by 1)""")
def _l04(t):
    from pyspark.sql import Window
    d = F.col("distance_nm")
    sev = F.when(d < 1, "critical").when(d < 2, "conflict").when(d < 3, "warning").otherwise("clear")
    rank = F.when(F.col("sev") == "critical", 0).when(F.col("sev") == "conflict", 1).when(F.col("sev") == "warning", 2).otherwise(3)
    # Four rows at most reach this window.
    return (t.hits.groupBy(sev.alias("sev")).agg(F.count("*").alias("n"))
            .withColumn("pos", F.row_number().over(Window.orderBy(rank))))


# -- M
query("m01_union_all", f"""
select hour, count(*) as points from (select {sql_hour()} as hour from tracks where source = 'MLAT'
 union all select {sql_hour()} from tracks where source = 'ADSB') group by 1""")(
    lambda t: t.tracks.where("source = 'MLAT'").unionAll(t.tracks.where("source = 'ADSB'"))
    .groupBy(keys.hour_of().alias("hour")).agg(F.count("*").alias("points")))


@query("m02_merge_sources", """
with s as (select flight_id, ts, callsign, 0 as prio from tracks where source = 'MLAT' union all
 select flight_id, ts, lower(callsign), 1 from tracks)
select flight_id, min(ts) as start_ts, max(ts) as end_ts, count(*) as points, min_by(callsign, prio) as callsign from s group by 1""")
def m02(t):
    a = t.tracks.where("source = 'MLAT'").select("flight_id", "ts", "callsign", F.lit(0).alias("prio"))
    b = t.tracks.select("flight_id", "ts", F.lower("callsign").alias("callsign"), F.lit(1).alias("prio"))
    return (a.unionByName(b).groupBy("flight_id")
            .agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("points"),
                 F.min_by("callsign", "prio").alias("callsign")))


query("m03_key_sets", """
with a as (select distinct flight_id from rule_hits where rule_id = 1), b as (select distinct flight_id from rule_hits where rule_id = 4)
select flight_id, 'both' as side from (select * from a intersect select * from b) union all
select flight_id, 'only_1' from (select * from a except select * from b) union all
select flight_id, 'only_4' from (select * from b except select * from a)""")(
    lambda t: (lambda a, b: a.intersect(b).withColumn("side", F.lit("both"))
               .unionAll(a.join(b, "flight_id", "left_anti").withColumn("side", F.lit("only_1")))
               .unionAll(b.join(a, "flight_id", "left_anti").withColumn("side", F.lit("only_4"))))(
        t.hits.where("rule_id = 1").select("flight_id").distinct(),
        t.hits.where("rule_id = 4").select("flight_id").distinct()))
