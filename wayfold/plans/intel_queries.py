"""Activity, proximity, behaviour, forecasts, joins and marine queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold import config as C
from wayfold.functions import geo, keys
from wayfold.operators import forecast as fc, intel as it, marine as ma, scans, sequence as sq, spatial as sp, stats as st
from wayfold.operators.hotkeys import join_windows
from wayfold.operators.windows import cut
from wayfold.plans.core_queries import T0, T1, r4
from wayfold.plans.registry import query, sql_bearing, sql_cell, sql_date, sql_delta, sql_hav, sql_hour, sql_mean
from wayfold.plans.sequence_queries import ICELL, P
from wayfold.plans.stats_queries import MIL

c = F.col
MF = f"flight_facts where {MIL}"

# -- military statistics
query("e71_military_by_country", f"select country, count(*) as flights, round(sum(flight_duration_sec)/3600,2) as total_hours, count(crossed_borders) as border_flights, string_agg(distinct military_type, ',' order by military_type) as types from {MF} group by 1")(
    lambda t: it.by_country(t.facts))
BOXES = [("South", 28.0, 30.0, 32.0, 46.0), ("Centre", 30.0, 32.0, 32.0, 46.0), ("North", 32.0, 35.0, 32.0, 46.0)]
BOX_CASE = lambda la, lo: "case " + " ".join(f"when {la} between {s} and {n} and {lo} between {w} and {e} then '{x}'" for x, s, n, w, e in BOXES) + " else 'Other' end"
query("e72_military_by_destination", f"select case destination_airport when 'LTFM' then 'Turkey' when 'LLBG' then 'Israel' else {BOX_CASE('dest_lat', 'dest_lon')} end as region, case when dest_lon > 44 then 'east' when dest_lon < 30 then 'west' else 'local' end as origin_side, count(*) as flights from {MF} group by 1, 2")(
    lambda t: it.by_destination(t.facts, {"LTFM": "Turkey", "LLBG": "Israel"}, BOXES))
query("e73_presence", f"select military_type, country, count(*) as flights, count(*) filter (where flight_duration_sec > 7200) as loitering from {MF} group by 1, 2")(lambda t: it.presence(t.facts))
query("e73_loitering", f"select flight_id, military_type, country, round(flight_duration_sec/3600,1) as hours, case when military_type = 'ISR' then 'Surveillance Pattern' when military_type = 'tanker' then 'Refueling Orbit' when flight_duration_sec > 2400 then 'Extended Loitering' else 'Unknown' end as pattern from {MF} and flight_duration_sec > 1200 order by hours desc, flight_id limit 20")(
    lambda t: it.loitering(t.facts, 1200, 2400))
query("e74_night_operations", f"select country, count(*) as flights, count(*) filter (where {sql_hour('(first_seen_ts - n*3600)')} >= 20 or {sql_hour('(first_seen_ts - n*3600)')} < 6) as night_flights, round(100.0*count(*) filter (where {sql_hour('(first_seen_ts - n*3600)')} >= 20 or {sql_hour('(first_seen_ts - n*3600)')} < 6)/count(*),1) as night_pct from {MF} group by 1")(
    lambda t: it.night_operations(t.facts.withColumn("first_seen_ts", c("first_seen_ts") - c("n") * 3600)))
query("e75_border_pairs", f"with x as (select string_split(replace(crossed_borders,' ',''), ',') as p from {MF}), y as (select unnest(p[1:len(p)-1]) as from_country, unnest(p[2:len(p)]) as to_country from x where len(p) > 1) select from_country, to_country, count(*) as crossings from y group by 1, 2")(
    lambda t: it.border_pairs(t.facts))
query("e76_surveillance_classes", f"select case when flight_duration_sec*20/3600 > 8 then 'strategic' when flight_duration_sec*20/3600 > 4 then 'tactical' else 'short' end as duration_class, country, count(*) as flights from {MF} and military_type = 'transport' group by 1, 2")(
    # The sample has no military flight of that type: transports stand in.
    lambda t: it.surveillance_classes(t.facts.withColumns({"flight_duration_sec": c("flight_duration_sec") * 20, "military_type": F.when(c("military_type") == "transport", "ISR")})))
AREAS = [("Coast", 30.5, 34.0, 60.0), ("Inland", 31.5, 35.0, 60.0)]
AREA_CASE = "case " + " ".join(f"when {sql_hav('la', 'lo', str(a), str(o))} <= {r} then '{n}'" for n, a, o, r in AREAS) + " else 'Transit' end"
query("e77_tanker_activity", f"with l as (select flight_id, max(ts) as last_ts, count(*) as points, max_by(lat, ts) as la, max_by(lon, ts) as lo from tracks group by 1) select f.flight_id, callsign, points, last_ts, {AREA_CASE} as area, cast(floor(flight_duration_sec/60/17) as bigint) as orbits from flight_facts f join l on l.flight_id = f.flight_id where {MIL} and military_type = 'tanker'")(
    lambda t: it.tanker_activity(t.facts, t.tracks, AREAS))
TH = ", ".join(f"(select count(*) from {MF} and country = '{k}' and {sql_hour('first_seen_ts')} = h.hour) as {k}" for k in ("US", "GB", "RU"))
query("e78_tempo_hours", f"select h.hour::int as hour, {TH} from range(24) h(hour)")(
    lambda t: it.tempo_hours(t.facts, ["US", "GB", "RU"]))


def _tempo(t):
    # First sights spread over days, all flights counted, so that spikes exist.
    n = c("n")
    return t.facts.withColumns({"first_seen_ts": c("first_seen_ts") + (n * n % 13) * (n % 2) * 86400, "is_military": F.lit(True)})


TEMPO = f"with d as (select country, {sql_date('(first_seen_ts + (n*n%13)*(n%2)*86400)')} as date, count(*) as count from flight_facts group by 1, 2), m as (select *, avg(count) over (partition by country) as m from d)"
query("e78_tempo_spikes", TEMPO + " select country, date, count, round((count-m)/m*100,1) as increase_pct, round((count-m)*0.6 + round((count-m)/m*100,1)/100*count*0.4,3) as score from m where count >= 5 and count > m*1.5 and m >= 2 order by score desc, country, date limit 20")(
    lambda t: it.tempo_spikes(_tempo(t)))
TREND = """with d as (select country, cast(floor((first_seen_ts + (n*n%13)*(n%2)*86400)/86400) as int) as day, count(*) as k from flight_facts group by 1, 2),
 dn as (select day, row_number() over (order by day) as r, count(*) over () as nn from (select distinct day from d)),
 ta as (select country, max(nn) as nn, coalesce(sum(k) filter (where r <= floor(nn/2)),0)/floor(max(nn)/2) as a, coalesce(sum(k) filter (where r > floor(nn/2)),0)/(max(nn)-floor(max(nn)/2)) as b,
  coalesce(sum(k) filter (where r > nn - least(nn,7)),0)/least(max(nn),7) as la, sum(k)/max(nn) as me from d join dn on dn.day = d.day group by 1),
 tr as (select country, case when nn < 4 then 'stable' when b > a*1.3 then case when la < b*0.5 then 'decreasing' else 'increasing' end when b < a*0.7 then 'decreasing' when la < me*0.5 then 'decreasing' else 'stable' end as trend from ta)"""
query("e78_tempo_trend", TREND + " select * from tr")(lambda t: it.tempo_trend(_tempo(t)))
query("s24_readiness", TREND + """, sp as (select count(*) as spikes from (select country, count, avg(count) over (partition by country) as m from (select country, day, sum(k) as count from d group by 1, 2)) where count >= 5 and count > m*1.5 and m >= 2),
 j as (select (select count(*) from flight_facts) as flights, spikes, coalesce((select trend from tr where country = 'RU'),'stable') as trend from sp),
 q as (select *, case when flights > 100 then 30 when flights > 50 then 20 when flights > 20 then 10 else 0 end + case when spikes > 5 then 25 when spikes > 2 then 15 else 0 end + case when trend = 'increasing' then 25 else 0 end as score from j)
select *, case when score >= 70 then 'IMMINENT' when score >= 50 then 'HIGH' when score >= 35 then 'ELEVATED' when score >= 20 then 'MODERATE' else 'LOW' end as level from q""")(
    lambda t: it.readiness(it.mil(_tempo(t)), it.tempo_spikes(_tempo(t), limit=None), it.tempo_trend(_tempo(t))))
query("e79_pattern_clusters", f"with x as (select flight_id, {sql_mean('lat')} as la, {sql_mean('lon')} as lo, min(rule_id) as r from rule_hits group by 1) select {sql_cell('la', 0.5)} as lat, {sql_cell('lo', 0.5)} as lon, count(*) as occurrences, string_agg(distinct cast(r as varchar), ',' order by cast(r as varchar)) as rules from x group by 1, 2 having count(*) >= 2")(
    lambda t: it.pattern_clusters(t.hits))
query("e80_region_routes", f"with e as (select f.country, min_by(t.lat, t.ts) as a, min_by(t.lon, t.ts) as b, max_by(t.lat, t.ts) as cc, max_by(t.lon, t.ts) as d from tracks t join flight_facts f on f.flight_id = t.flight_id where {MIL} group by t.flight_id, f.country), n as (select country, {BOX_CASE('a', 'b')} as origin, {BOX_CASE('cc', 'd')} as destination, count(*) as flights from e group by 1, 2, 3) select * from (select *, row_number() over (partition by country order by flights desc, origin, destination) as rank from n) where rank <= 5")(
    lambda t: it.region_routes(t.tracks, t.facts, BOXES))
query("s25_recent_tracks", f"with f as (select flight_id, country, row_number() over (partition by country order by last_seen_ts desc, flight_id) as rank from {MF}) select t.flight_id, ts, lat, lon, alt, country, rank from tracks t join f on f.flight_id = t.flight_id where rank <= 30")(
    lambda t: it.recent_tracks(t.tracks, t.facts))
query("s26_military_patterns")(lambda t: it.military_patterns(t.tracks, t.facts, sq.flight_patterns(t.tracks)))
query("s18_interference_correlation", ICELL + "select count(*) as cells, count(*) filter (where intensity >= 40) as severe, round(least(100, avg(intensity)*1.5),2) as score from ic")(
    lambda t: it.interference_correlation(sp.interference_cells(sp.flight_interference(t.tracks, t.airports), limit=None)))
query("s19_operator_proximity", f"with l as (select t.*, f.country from tracks t join flight_facts f on f.flight_id = t.flight_id where country is not null), p as (select a.flight_id as f1, b.flight_id as f2, a.country as c1, b.country as c2, a.ts as t1, b.ts as t2, {sql_hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} as nm from l a join l b on a.flight_id < b.flight_id and a.country <> b.country and b.ts between a.ts-300 and a.ts+300), k as (select f1, f2, least(min(c1),min(c2))||'-'||greatest(min(c1),min(c2)) as pair, round(min(nm),1) as min_nm, cast(floor(min_by(t1+t2, (nm, t1, t2))/2) as bigint) as ts from p where nm <= 50 group by 1, 2) select *, case when min_nm < 5 then 'critical' when min_nm < 15 then 'high' when min_nm < 30 then 'medium' else 'low' end as severity from k")(
    lambda t: it.operator_proximity(t.tracks.select("flight_id", "ts", "lat", "lon").join(t.facts.where("country is not null").select("flight_id", "country"), "flight_id")))


def _similar(t):
    """Against the busiest flight: same route, rules in common."""
    target = cut(scans.flight_list(t.tracks, limit=1).select("flight_id"))
    m = t.meta.select("flight_id", "origin_airport", "destination_airport")
    tm = m.join(target, "flight_id", "left_semi").select(c("origin_airport").alias("o"), c("destination_airport").alias("d"))
    cand = m.join(F.broadcast(tm), c("origin_airport").eqNullSafe(c("o")) & c("destination_airport").eqNullSafe(c("d"))).join(target, "flight_id", "left_anti")
    rules = t.hits.groupBy("flight_id").agg(F.collect_set("rule_id").alias("r"))
    tr = rules.join(target, "flight_id", "left_semi").select(c("r").alias("tr"))
    cand = cand.join(rules, "flight_id").join(F.broadcast(tr), F.arrays_overlap("r", "tr")).select("flight_id")
    return it.similar_flights(t.tracks, target, cand, nm=15.0, share=0.2)


query("s20_similar_flights", f"""
with tg as (select flight_id from tracks group by 1 order by count(*) desc, flight_id limit 1), tm as (select origin_airport as o, destination_airport as d from flight_metadata where flight_id in (select flight_id from tg)),
 cd as (select m.flight_id from flight_metadata m, tm where origin_airport is not distinct from o and destination_airport is not distinct from d and m.flight_id not in (select flight_id from tg)
  and exists (select 1 from rule_hits a join rule_hits b on a.rule_id = b.rule_id where a.flight_id = m.flight_id and b.flight_id in (select flight_id from tg))),
 own as (select ts, lat, lon from tracks where flight_id in (select flight_id from tg)), h as (select b.flight_id, count(distinct own.ts) as near_points from own join tracks b on {sql_hav('own.lat', 'own.lon', 'b.lat', 'b.lon')} <= 15 and b.flight_id in (select flight_id from cd) group by 1)
select flight_id, near_points, round(near_points/(select count(*) from own),4) as similarity from h where round(near_points/(select count(*) from own),4) >= 0.2 order by similarity desc, flight_id limit 15""")(lambda t: _similar(t))


@query("s20_similar_by_area", f"""
with tg as (select flight_id from tracks group by 1 order by count(*) desc, flight_id limit 1), bx as (select min(lat)-0.5 as s, max(lat)+0.5 as n, min(lon)-0.5 as w, max(lon)+0.5 as e, count(*) as own from tracks where flight_id in (select flight_id from tg)),
 cd as (select distinct flight_id from tracks, bx where lat between s and n and lon between w and e and flight_id not in (select flight_id from tg)
  and flight_id in (select a.flight_id from rule_hits a where a.rule_id in (select rule_id from rule_hits where flight_id in (select flight_id from tg)))),
 own as (select ts, lat, lon from tracks where flight_id in (select flight_id from tg)), h as (select b.flight_id, count(distinct own.ts) as near_points from own join tracks b on {sql_hav('own.lat', 'own.lon', 'b.lat', 'b.lon')} <= 15 and b.flight_id in (select flight_id from cd) group by 1)
select flight_id, near_points, round(near_points/(select own from bx),4) as similarity from h where round(near_points/(select own from bx),4) >= 0.2 order by similarity desc, flight_id limit 15""")
def _s20_area(t):
    """The busiest flight taken as one whose route nobody knows."""
    target = cut(scans.flight_list(t.tracks, limit=1).select("flight_id"))
    blank = t.meta.select("flight_id", F.lit("UNKNOWN").alias("origin_airport"), F.lit("").alias("destination_airport"))
    cand = it.similar_candidates(t.tracks, blank, target, t.hits.select("flight_id", "rule_id"))
    return it.similar_flights(t.tracks, target, cand, nm=15.0, share=0.2)


CONF = "case when score >= 60 then 'HIGH' when score >= 35 then 'MEDIUM' else 'LOW' end"


def _s23(t):
    cells = sp.interference_cells(sp.flight_interference(t.tracks, t.airports), limit=None)
    graded = cells.select("affected_flights", F.when(c("score") >= 60, "HIGH").when(c("score") >= 35, "MEDIUM").otherwise("LOW").alias("confidence"))
    placed = t.hits.groupBy("flight_id").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon")).join(t.reports.select("flight_id", "is_anomaly"), "flight_id")
    military = it.mil(t.facts)
    return it.composite(graded, military, it.anomaly_clusters(placed), it.conflict_flights(t.tracks, military))


query("s23_composite", ICELL + f"""
, g as (select count(*) as gps_count, least(100, count(*) filter (where {CONF} = 'HIGH') * 15 + count(*) filter (where {CONF} = 'MEDIUM') * 8 + least(30, count(*) * 3) + least(25, floor(coalesce(sum(affected_flights), 0) / 2)))::bigint as gps_score from ic),
 mm as (select flight_id, country from {MF}), m as (select count(*) as military_flights, least(100, least(40, count(*) * 2) + least(40, count(*) filter (where country in ('RU', 'IR')) * 10) + least(20, count(*) // 5))::bigint as military_score from mm),
 a as (select flight_id, avg(lat) as la, avg(lon) as lo from rule_hits group by 1), b as (select round(la * 10) / 10 as la, round(lo * 10) / 10 as lo from a join reports r on r.flight_id = a.flight_id where is_anomaly = 1 group by 1, 2 having count(*) >= 3),
 u as (select count(*) as cluster_count, least(100, count(*) * 10)::bigint as pattern_score from b),
 z as (select count(*) as syria_flights, count(*) filter (where country in ('RU', 'IR')) as from_east from mm where flight_id in (select flight_id from tracks where lat between 32 and 37 and lon between 35 and 42)),
 j as (select gps_count, gps_score, military_flights, military_score, cluster_count, pattern_score, syria_flights, from_east, least(100, syria_flights * 15 + from_east * 25)::bigint as conflict_score from g, m, u, z),
 k as (select *, (gps_score * 30 + military_score * 25 + pattern_score * 20 + conflict_score * 25) // 100 as score from j),
 n as (select 'Active GPS Jamming' as name, gps_score as s, 0 as i from k where gps_score >= 50 union all select 'High Military Presence', military_score, 1 from k where military_score >= 40
   union all select 'Anomaly Clusters Detected', pattern_score, 2 from k where pattern_score >= 30 union all select 'Conflict Zone Activity', conflict_score, 3 from k where syria_flights > 0)
select *, coalesce((select string_agg(name, ', ' order by s desc, i) from n), '') as concerns, case when score >= 80 then 'CRITICAL' when score >= 60 then 'HIGH' when score >= 40 then 'ELEVATED' when score >= 20 then 'MODERATE' else 'LOW' end as level from k""")(_s23)

# -- behaviour factors
ZT = ("(values (32.011389, 34.886667, 25, 'medium', 'airport_tma'), (33.1, 35.5, 15, 'high', 'border'), (31.5, 35.5, 10, 'high', 'border'), (31.0, 35.15, 20, 'critical', 'restricted'), "
      "(31.4, 34.4, 15, 'critical', 'conflict'), (33.3, 35.5, 10, 'high', 'fir_boundary'), (32.8, 36.0, 15, 'high', 'fir_boundary')) z(zlat, zlon, radius, severity, kind)")
G22 = f"""with l as (select *, row_number() over (partition by flight_id order by ts desc) as r from tracks), d as (select flight_id, {sql_hav('lat', 'lon', 'zlat', 'zlon')} as nm, radius, severity from l, {ZT} where r <= 10)
select flight_id, case when bool_or(severity = 'critical' and nm < radius * 1.5) then 30 when min(nm) < 10 then 25 when min(nm) < 25 then 15 when min(nm) < 50 then 5 else 0 end as zone_score from d group by 1"""
query("g22_zone_factor", G22)(lambda t: it.zone_factor(t.tracks))
TOW = f"exists (select 1 from {ZT} where severity in ('critical', 'high') and abs({sql_delta('track', sql_bearing('lat', 'lon', 'zlat', 'zlon'))}) < 30)"
G23 = P + f", k as (select flight_id, count(*) as n, count(*) filter (where ts-prev_ts > 0 and ts-prev_ts < 60 and abs({sql_delta('track', 'prev_track')}) > 30) as s, count(*) filter (where ts-prev_ts > 0 and ts-prev_ts < 60 and abs({sql_delta('track', 'prev_track')}) > 30 and ({TOW})) as t from p group by 1) select flight_id, case when n < 3 then 0 when t >= 2 then 25 when t = 1 then 15 when s >= 3 then 10 when s >= 1 then 5 else 0 end as heading_score from k"
query("g23_heading_factor", G23.replace("from tracks window", "from (select * replace ((track*7+vspeed) - 360*floor((track*7+vspeed)/360) as track) from tracks) window"))(
    lambda t: it.heading_factor(t.tracks.withColumn("track", F.pmod(c("track") * 7 + c("vspeed"), F.lit(360.0)))))
G24 = f"""with a as (select flight_id, ts, alt, lag(alt) over (partition by flight_id order by ts) as pa, row_number() over (partition by flight_id order by ts desc) as r from tracks where alt <> 0), k as (select flight_id, count(*) filter (where pa-alt > 2000) as drops, min(alt) filter (where r <= 5) as low from a group by 1),
 q as (select flight_id, count(*) as n, max_by(lat, ts) as la, max_by(lon, ts) as lo from tracks group by 1), l as (select flight_id, n, bool_or({sql_hav('la', 'lo', 'zlat', 'zlon')} < radius) as near from q, {ZT} where kind = 'airport_tma' group by 1, 2)
select l.flight_id, case when n < 3 or low is null then 0 when low < 3000 and not near then 20 when drops >= 2 then 15 when drops = 1 then 8 when low < 5000 and not near then 5 else 0 end as altitude_score from l left join k on k.flight_id = l.flight_id"""
query("g24_altitude_factor", G24)(lambda t: it.altitude_factor(t.tracks))
G25 = P + ", k as (select flight_id, avg(gspeed) as a, max(gspeed) as hi, min(gspeed) as lo, count(*) as n, count(*) filter (where abs(gspeed-prev_gspeed) > 50) as ch from p group by 1) select flight_id, case when hi > 500 and lo < 150 then 15 when ch >= 3 then 10 when a < 100 and n > 20 then 8 when ch >= 1 then 3 else 0 end as speed_score from k"
query("g25_speed_factor", G25)(lambda t: it.speed_factor(t.tracks))
OPREP = "(select r.flight_id, callsign from reports r join flight_metadata m on m.flight_id = r.flight_id where is_anomaly = 1 and has_8 = 1)"
G26 = f"with h as (select substr(callsign,1,3) as p, count(*) as h from {OPREP} group by 1) select flight_id, case when callsign like 'RCH%' then 5 when h > 5 then 10 when h > 2 then 5 else 0 end as operator_score from flight_metadata left join h on p = substr(callsign,1,3)"


def _oprep(t):
    return t.reports.where("is_anomaly = 1 and has_8 = 1").select("flight_id").join(t.meta.select("flight_id", "callsign"), "flight_id")


query("g26_operator_factor", G26)(lambda t: it.operator_factor(t.tracks, _oprep(t)))
G21 = f"""select n.flight_id, n.points, coalesce(zone_score, 0) as zone_score, coalesce(heading_score, 0) as heading_score, coalesce(altitude_score, 0) as altitude_score, coalesce(speed_score, 0) as speed_score, coalesce(operator_score, 0) as operator_score,
 case when points >= 5 then least(100, coalesce(zone_score, 0) + coalesce(heading_score, 0) + coalesce(altitude_score, 0) + coalesce(speed_score, 0) + coalesce(operator_score, 0)) else 0 end as score
from (select flight_id, count(*) as points from tracks group by 1) n left join ({G22}) a on a.flight_id = n.flight_id left join ({G23}) b on b.flight_id = n.flight_id left join ({G24}) d on d.flight_id = n.flight_id
 left join ({G25}) e on e.flight_id = n.flight_id left join ({G26}) f on f.flight_id = n.flight_id"""
query("g21_behaviour_score", f"""select *, case when points < 5 then 'unknown' when score >= 70 then 'critical' when score >= 50 then 'high' when score >= 30 then 'medium' else 'low' end as level,
 case when points >= 5 then round(least(0.95, 0.5 + points / 100 * 0.3), 2) else 0.0 end as confidence from ({G21})""")(lambda t: it.behaviour_score(t.tracks, _oprep(t)))

# -- forecasts
LATEST = "with l as (select flight_id, max_by(lat, ts) as lat, max_by(lon, ts) as lon, max_by(alt, ts) as alt, max_by(gspeed, ts) as gspeed, max_by(track, ts) as track from tracks group by 1)"


def _latest(t):
    return t.tracks.groupBy("flight_id").agg(*[F.max_by(x, "ts").alias(x) for x in ("lat", "lon", "alt", "gspeed", "track")])


KBOX = [("East", 30.0, 32.0, 34.3, 36.6), ("North", 31.5, 34.0, 33.0, 42.4)]
query("k08_kinematic_prediction", LATEST + """, p as (select flight_id, s as offset_s, lat + gspeed*s/3600*cos(radians(track))/60 as plat, lon + gspeed*s/3600*sin(radians(track))/(60*cos(radians(lat))) as plon from l, range(15,301,15) r(s)),
 z as (select *, case when plat between 30.0 and 32.0 and plon between 34.3 and 36.6 then 'East' when plat between 31.5 and 34.0 and plon between 33.0 and 42.4 then 'North' end as zone from p)
select flight_id, offset_s::int as offset_s, round(plat,5) as plat, round(plon,5) as plon, zone, case when zone is not null then case when offset_s < 120 then 'critical' else 'warning' end end as severity from z""")(
    lambda t: fc.kinematic(_latest(t), KBOX).select("flight_id", "offset_s", F.round("plat", 5).alias("plat"), F.round("plon", 5).alias("plon"), "zone", "severity"))
query("k09_prediction_confidence", "select flight_id, ts, least(0.95, round(0.5 + case when gspeed between 150 and 550 then 0.2 when gspeed between 50 and 700 then 0.1 else 0 end + case when alt > 20000 then 0.15 when alt > 10000 then 0.1 when alt > 5000 then 0.05 else 0 end + 0.1 + 0.05, 2)) as confidence from tracks")(
    lambda t: t.tracks.select("flight_id", "ts", fc.prediction_confidence().alias("confidence")))
DR = LATEST + """, d as (select flight_id, m, alt, radians(lat) as a, radians(lon) as o, radians(track) as b, gspeed*m/60/0.539957/6371.0 as d from l, range(0,61,5) r(m)),
 q as (select flight_id, m::int as minutes, alt, asin(sin(a)*cos(d)+cos(a)*sin(d)*cos(b)) as la, o, a, b, d from d), dr as (select flight_id, minutes, alt, degrees(la) as lat, degrees(o+atan2(sin(b)*sin(d)*cos(a), cos(d)-sin(a)*sin(la))) as lon from q)
"""
query("k10_dead_reckoning", DR + "select flight_id, minutes, alt, round(lat,5) as lat, round(lon,5) as lon from dr")(
    lambda t: fc.dead_reckoning(_latest(t)).withColumns({x: F.round(x, 5) for x in ("lat", "lon")}))
CONFL = DR + f""", j as (select a.flight_id as plan_id, b.flight_id, a.minutes, {sql_hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} as nm, abs(a.alt-b.alt) as ft from dr a join dr b on a.minutes = b.minutes and a.flight_id <> b.flight_id and abs(a.alt-b.alt) <= 2000),
 cf as (select *, case when nm <= 2.5 and ft <= 500 then 'critical' when nm <= 5 and ft <= 1000 then 'conflict' else 'warning' end as kind from j where nm <= 10)
"""


def _dead(t):
    return t.kept("dead", lambda: fc.dead_reckoning(_latest(t)))


def _conf(t):
    d = _dead(t)
    return fc.conflicts(d.withColumnRenamed("flight_id", "plan_id"), d)


query("k11_conflicts", CONFL + "select plan_id, flight_id, minutes, round(nm,4) as nm, ft, kind from cf")(lambda t: _conf(t).withColumn("nm", r4(c("nm"))))
query("k14_first_conflicts", CONFL + "select plan_id, flight_id, min(minutes) as minutes, min_by(kind, (minutes, case kind when 'critical' then 0 when 'conflict' then 1 else 2 end, nm)) as kind from cf group by 1, 2")(
    lambda t: fc.first_conflicts_of(_dead(t)).select("plan_id", "flight_id", "minutes", "kind"))
query("k13_conflict_severity", "select flight_id, ts, rule_id, case when distance_nm <= 1 and altitude_diff_ft <= 300 then 'critical' when distance_nm <= 2 and altitude_diff_ft <= 600 then 'warning' when distance_nm <= 3 and altitude_diff_ft <= 900 then 'caution' end as severity from rule_hits")(
    lambda t: t.hits.select("flight_id", "ts", "rule_id", fc.severity(c("distance_nm"), c("altitude_diff_ft"), 1.0, 300.0).alias("severity")))
query("k12_interpolated_route")(lambda t: fc.interpolate_route(
    t.tracks.select(c("flight_id").alias("route"), c("ts").alias("seq"), "lat", "lon", "alt", F.lit(None).cast("double").alias("speed_kt"))))
AS_OF = T0 + 9000
query("k15_airspace_risk", f"""
with t as (select count(distinct flight_id) as traffic from tracks where ts between {AS_OF - 3600} and {AS_OF}), a as (select count(distinct flight_id) filter (where ts >= {AS_OF - 3600}) as recent, count(distinct flight_id) filter (where ts >= {AS_OF - 86400}) as today, count(distinct flight_id) filter (where ts < {AS_OF - 86400}) as yesterday from rule_hits where ts between {AS_OF - 172800} and {AS_OF}),
 s as (select *, round(least(30.0, traffic*0.5) + least(40, recent*8) + 3 + case when today/greatest(yesterday,1) > 1 then least(15, (today/greatest(yesterday,1)-1)*15) else 0 end,1) as risk_score from t, a)
select *, case when risk_score >= 75 then 'critical' when risk_score >= 50 then 'high' when risk_score >= 25 then 'medium' else 'low' end as risk_level from s""")(
    lambda t: fc.airspace_risk(t.tracks, t.hits, AS_OF))
FA = T0 + 30 * 86400
query("k16_safety_forecast", f"""
with h as (select * from rule_hits where ts between {FA - 30 * 86400} and {FA}), p as (select {sql_hour()} as hour, count(*) as n, count(*) filter (where rule_id=6) as ga, count(*) filter (where rule_id=4) as nm, count(*) filter (where rule_id=1) as em from h group by 1),
 r as (select count(distinct flight_id) filter (where ts >= {FA - 7 * 86400}) as r, count(distinct flight_id) filter (where ts < {FA - 7 * 86400}) as o, count(*) as total from h),
 j as (select s.o as "offset", (s.o + {FA % 86400 // 3600}) % 24 as hour, coalesce(n,0) as n, coalesce(ga,0) as ga, coalesce(nm,0) as nm, coalesce(em,0) as em, case when r.o > 0 then (r.r/7)/(r.o/23) else 1.0 end as ratio, case when total > 0 then total/720 else 0.1 end as base from range(24) s(o) left join p on p.hour = (s.o + {FA % 86400 // 3600}) % 24, r),
 k as (select *, n/30*ratio as e, ga+nm+em as kinds from j)
select "offset"::int as "offset", hour::int as hour, round(e,2) as expected_total, greatest(0, round_even(e*case when kinds > 0 then ga/kinds else 0.6 end,0)::int) as expected_go_arounds, greatest(0, round_even(e*case when kinds > 0 then nm/kinds else 0.3 end,0)::int) as expected_near_miss,
 greatest(0, round_even(e*case when kinds > 0 then em/kinds else 0.1 end,0)::int) as expected_emergency, case when e > base*1.5 then 'high' when e > base then 'medium' else 'low' end as risk_level, round(greatest(0.5, 1.0 - "offset"/24*0.4),2) as confidence from k""")(
    lambda t: fc.safety_forecast(t.hits, FA))
QUE = "select flight_id||':'||cast(ts as varchar) as qid, flight_id, ts, lat, lon, gspeed, vspeed from tracks"


def _queries(t):
    """Every track point."""
    return t.tracks.select(F.concat_ws(":", "flight_id", c("ts").cast("string")).alias("qid"), "flight_id", "lat", "lon", "gspeed", "vspeed")


HIST = f"""with q as ({QUE}), d as (select q.qid, b.flight_id as h_flight, round({sql_hav('q.lat', 'q.lon', 'b.lat', 'b.lon', '6371.0')},9) as km, b.ts as h_ts, b.gspeed as hg, b.vspeed as hv from q join tracks b on b.flight_id <> q.flight_id and b.lat between q.lat-0.05 and q.lat+0.05 and b.lon between q.lon-0.1 and q.lon+0.1),
 k as (select qid, h_flight, min(km) as km, min_by(h_ts, (km, h_ts)) as h_ts, min_by(hg, (km, h_ts)) as hg, min_by(hv, (km, h_ts)) as hv from d where km <= 5 group by 1, 2)
"""
query("d08_closest_history", HIST + "select qid, h_flight, round(km,5) as km, h_ts from k")(
    lambda t: fc.closest_history(_queries(t), t.tracks).select("qid", "h_flight", F.round("km", 5).alias("km"), "h_ts"))
TESTED = HIST + """, s as (select qid, count(*) as tracks, avg(hg) as mg, stddev_pop(hg) as sg, avg(hv) as mv, stddev_pop(hv) as sv from k group by 1),
 tested as (select q.qid, q.flight_id, q.ts, coalesce(tracks,0) as tracks, case when tracks >= 3 then coalesce(sg > 1 and abs(gspeed-mg)/sg > 2.5758293, false) end as gspeed_warning, case when tracks >= 3 then coalesce(sv > 1 and abs(vspeed-mv)/sv > 2.5758293, false) end as vspeed_warning from q left join s on s.qid = q.qid)
"""
query("k17_history_test", TESTED + "select qid, flight_id, tracks, gspeed_warning, vspeed_warning from tested")(
    lambda t: fc.history_test(_queries(t), t.tracks))

# -- joins
query("d01_flights_with_reports", "select m.flight_id, airline, r.is_anomaly, n_events from flight_metadata m join reports r on r.flight_id = m.flight_id")(
    lambda t: t.meta.join(t.reports, "flight_id").select("flight_id", "airline", "is_anomaly", "n_events"))
query("d03_reports_left_metadata", "select r.flight_id, airline, n_events from reports r left join (select * from flight_metadata where destination_airport is not null) m on m.flight_id = r.flight_id")(
    lambda t: t.reports.join(t.meta.where("destination_airport is not null").select("flight_id", "airline"), "flight_id", "left").select("flight_id", "airline", "n_events"))
query("d04_left_join_filtered", "select m.flight_id, ev from flight_metadata m left join (select flight_id, max(n_events) as ev from reports where flight_id in (select flight_id from flight_metadata where origin_airport = 'LCLK') group by 1) r on r.flight_id = m.flight_id where origin_airport = 'LCLK'")(
    lambda t: t.meta.where("origin_airport = 'LCLK'").select("flight_id").join(
        t.reports.join(t.meta.where("origin_airport = 'LCLK'").select("flight_id"), "flight_id", "left_semi").groupBy("flight_id").agg(F.max("n_events").alias("ev")), "flight_id", "left"))
query("d05_asof_nearest", "select h.flight_id, h.ts, h.rule_id, min_by(p.ts, (abs(p.ts-h.ts), p.ts)) as point_ts, min_by(p.lat, (abs(p.ts-h.ts), p.ts)) as lat from rule_hits h join tracks p on p.flight_id = h.flight_id group by 1, 2, 3")(lambda t: _d05(t))


def _d05(t):
    """Event to nearest point in time: the last point at or before and the first one after, from one ordered union.

    No event meets all points of its flight: both sides travel as neighbours in slices.
    """
    from wayfold.operators.windows import SLICE
    from pyspark.sql import Window
    pts = t.tracks.select("flight_id", "ts", F.lit(None).cast("int").alias("rule_id"), F.struct("ts", "lat").alias("p"))
    ev = t.hits.select("flight_id", "ts", "rule_id", F.lit(None).cast("struct<ts:bigint,lat:double>").alias("p"))
    u = pts.unionByName(ev).withColumn(SLICE, F.floor(c("ts") / 21600))
    w = Window.partitionBy("flight_id", SLICE).orderBy("ts", F.col("rule_id").asc_nulls_first())
    edge = pts.withColumn(SLICE, F.floor(c("ts") / 21600)).groupBy("flight_id", SLICE).agg(F.max("p").alias("hi"), F.min("p").alias("lo"))
    wk = Window.partitionBy("flight_id").orderBy(SLICE)
    have = ev.withColumn(SLICE, F.floor(c("ts") / 21600)).select("flight_id", SLICE).distinct()
    grid = (have.join(edge, ["flight_id", SLICE], "full_outer")
            .withColumns({"pb": F.last("hi", True).over(wk.rowsBetween(Window.unboundedPreceding, -1)),
                          "nb": F.first("lo", True).over(wk.rowsBetween(1, Window.unboundedFollowing))})
            .select(c("flight_id").alias("_f"), c(SLICE).alias("_s"), "pb", "nb"))
    loc = u.withColumns({"a": F.last("p", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "b": F.first("p", True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    j = (loc.where("rule_id is not null").join(grid, (c("flight_id") == c("_f")) & (c(SLICE) == c("_s")), "left")
         .withColumns({"a": F.coalesce("a", "pb"), "b": F.coalesce("b", "nb")}).where("a is not null or b is not null"))
    take_a = c("b").isNull() | (c("a").isNotNull() & (c("ts") - c("a.ts") <= c("b.ts") - c("ts")))
    return j.select("flight_id", "ts", "rule_id", F.when(take_a, c("a")).otherwise(c("b")).alias("p")).select("flight_id", "ts", "rule_id", c("p.ts").alias("point_ts"), "p.lat")


query("d06_range_join", "select h.flight_id, h.ts as center_ts, p.ts, p.lat from (select flight_id, min_by(ts, alt) as ts from tracks group by 1) h join tracks p on p.flight_id = h.flight_id and p.ts between h.ts - 120 and h.ts + 120")(
    lambda t: join_windows(t.tracks.select("flight_id", "ts", "lat"), t.tracks.groupBy("flight_id").agg(F.min_by("ts", "alt").alias("center_ts")), 120, C.SLICE_S)
    .select("flight_id", "center_ts", "ts", "lat"))
query("d09_nearest_within_radius", f"with d as (select t.flight_id, ts, alt, round({sql_hav('lat', 'lon', '30.5', '33.6', '6371.0')},9) as km from tracks t join flight_metadata m on m.flight_id = t.flight_id where origin_airport = 'LCLK' and alt between 10000 and 12000) select flight_id, min_by(ts, (km, ts)) as ts, round(min(km),4) as km from d where km <= 30 group by 1")(
    lambda t: t.tracks.where(geo.in_box("lat", "lon", 30.0, 31.0, 33.0, 34.2) & c("alt").between(10000, 12000))
    .join(t.meta.where("origin_airport = 'LCLK'").select("flight_id"), "flight_id", "left_semi")
    .withColumn("km", F.round(geo.haversine("lat", "lon", 30.5, 33.6, 6371.0), 9)).where("km <= 30")
    .groupBy("flight_id").agg(F.min_by("ts", F.struct("km", "ts")).alias("ts"), r4(F.min("km")).alias("km")))
query("d11_key_anti_join", f"with a as (select distinct substr(callsign,1,3)||origin_airport||aircraft_type||coalesce(destination_airport,'') as k from flight_metadata where first_seen_ts < {T0 + 2400}), b as (select distinct substr(callsign,1,3)||origin_airport||aircraft_type||coalesce(destination_airport,'') as k from flight_metadata where first_seen_ts >= {T0 + 2400}) select k, 'stopped' as side from a where k not in (select k from b) union all select k, 'started' from b where k not in (select k from a)")(
    lambda t: (lambda a, b: a.join(b, "k", "left_anti").withColumn("side", F.lit("stopped")).unionAll(b.join(a, "k", "left_anti").withColumn("side", F.lit("started"))))(
        *[t.meta.where(w).select(F.concat(F.substring("callsign", 1, 3), "origin_airport", "aircraft_type", F.coalesce("destination_airport", F.lit(""))).alias("k")).distinct() for w in (f"first_seen_ts < {T0 + 2400}", f"first_seen_ts >= {T0 + 2400}")]))
query("d12_rule_overlap", "select flight_id, count(distinct rule_id) filter (where rule_id in (1,8)) as n from rule_hits group by 1 having count(*) filter (where rule_id in (1,8)) > 0")(
    lambda t: t.hits.groupBy("flight_id").agg(F.collect_set("rule_id").alias("r")).where(F.arrays_overlap("r", F.array(F.lit(1), F.lit(8))))
    .select("flight_id", F.size(F.array_intersect("r", F.array(F.lit(1), F.lit(8)))).cast("bigint").alias("n")))
query("d13_exists", "select flight_id, airline from flight_metadata m where exists (select 1 from rule_hits h where h.flight_id = m.flight_id and h.airport = m.origin_airport and h.rule_id = 8)")(
    lambda t: t.meta.join(t.hits.where("rule_id = 8").select("flight_id", c("airport").alias("origin_airport")), ["flight_id", "origin_airport"], "left_semi").select("flight_id", "airline"))
query("d14_correlated_counts", "select m.flight_id, (select count(*) from tracks t where t.flight_id = m.flight_id) as points, (select max(ts) from tracks t where t.flight_id = m.flight_id) as last_ts from flight_metadata m")(
    lambda t: t.meta.select("flight_id").join(t.tracks.groupBy("flight_id").agg(F.count("*").alias("points"), F.max("ts").alias("last_ts")), "flight_id", "left"))
query("c33_live_status", """
with r as (select *, row_number() over (partition by flight_id order by ts desc) as r from tracks), g as (select flight_id, max_by(alt, ts) as a, max_by(alt, ts) - min_by(alt, ts) as d, count(*) as n from r where r <= 10 group by 1)
select flight_id, case when n < 2 then case when a > 25000 then 'CRUISE' when a > 10000 then 'CLIMB' when a < 3000 then 'APPROACH' else 'UNKNOWN' end when a < 1000 then 'GROUND'
 when a < 5000 then case when d > 500 then 'TAKEOFF' when d < -500 then 'LANDING' else 'APPROACH' end when a < 15000 then case when d > 1000 then 'CLIMB' when d < -1000 then 'DESCENT' else 'APPROACH' end
 when d > 500 then 'CLIMB' when d < -500 then 'DESCENT' else 'CRUISE' end as status from g""")(lambda t: it.live_status(t.tracks))


query("c26_report_json", "select flight_id, is_anomaly, severity_cnn as sev, n_events as events from reports")(
    lambda t: t.reports.select("flight_id", F.to_json(F.struct(F.struct("is_anomaly", c("severity_cnn").alias("sev")).alias("summary"), F.struct(c("n_events").alias("events")).alias("layer"))).alias("doc"))
    .select("flight_id", F.from_json("doc", "summary struct<is_anomaly:int,sev:double>, layer struct<events:bigint>").alias("d"), F.get_json_object("doc", "$.summary.is_anomaly").cast("int").alias("is_anomaly"))
    .select("flight_id", "is_anomaly", c("d.summary.sev").alias("sev"), c("d.layer.events").alias("events")))

REPORT_SCHEMA = ("summary struct<is_anomaly:boolean,confidence_score:double,triggers:array<string>>, "
                 "layer_1_rules struct<status:string,report:struct<matched_rules:array<struct<id:int,name:string,category:string>>>>, "
                 "layer_2_xgboost struct<is_anomaly:boolean,severity:double>, layer_3_deep_dense struct<is_anomaly:boolean,severity:double>, layer_4_deep_cnn struct<is_anomaly:boolean,severity:double>")
LAYER_NAMES = [("layer_2_xgboost", "XGBoost"), ("layer_3_deep_dense", "Deep Dense"), ("layer_4_deep_cnn", "Deep CNN")]


def report_docs(t):
    """Nested report text per flight, built from the report flags."""
    rule = lambda k, n, cat: F.when(c(f"has_{k}") == 1, F.struct(F.lit(k).alias("id"), F.lit(n).alias("name"), F.lit(cat).alias("category")))
    rules = F.array_compact(F.array(rule(1, "Emergency", "safety"), rule(4, "Proximity", "safety"), rule(8, "Diversion", "operations")))
    layer = lambda cond, s: F.struct(cond.alias("is_anomaly"), s.alias("severity"))
    return t.reports.select("flight_id", "ts", F.to_json(F.struct(
        F.struct((c("is_anomaly") == 1).alias("is_anomaly"), c("severity_cnn").alias("confidence_score"), F.array(F.lit("Rules")).alias("triggers")).alias("summary"),
        F.struct(F.lit("ANOMALY").alias("status"), F.struct(rules.alias("matched_rules")).alias("report")).alias("layer_1_rules"),
        layer(c("has_6") == 1, F.lit(None).cast("double")).alias("layer_2_xgboost"), layer(c("severity_dense") > 0.9, c("severity_dense")).alias("layer_3_deep_dense"),
        layer(c("severity_cnn") > 0.9, c("severity_cnn")).alias("layer_4_deep_cnn"))).alias("full_report"))


def extract_reports(docs):
    """Wide columns from the nested report text."""
    d = docs.withColumn("r", F.from_json("full_report", REPORT_SCHEMA))
    rules = c("r.layer_1_rules.report.matched_rules")
    flagged = F.array_compact(F.array(*[F.when(c(f"r.{k}.is_anomaly"), F.lit(n)) for k, n in LAYER_NAMES]))
    return d.select("flight_id", "ts", c("r.summary.is_anomaly").cast("int").alias("pipeline_is_anomaly"), c("r.summary.confidence_score").alias("confidence_score"),
                    c("r.layer_1_rules.status").alias("rules_status"), F.transform(rules, lambda x: x["id"]).alias("matched_rule_ids"),
                    F.array_join(F.transform(rules, lambda x: x["name"]), ", ").alias("matched_rule_names"),
                    F.array_join(F.array_distinct(F.transform(rules, lambda x: x["category"])), ", ").alias("matched_rule_categories"),
                    flagged.alias("ml_layers_flagged"), c("r.layer_4_deep_cnn.severity").alias("severity_cnn"), c("r.layer_3_deep_dense.severity").alias("severity_dense"), rules.alias("rules"))


IDS = "concat_ws(', ', case when has_1 = 1 then '1' end, case when has_4 = 1 then '4' end, case when has_8 = 1 then '8' end)"
MLF = "concat_ws(',', case when has_6 = 1 then 'XGBoost' end, case when severity_dense > 0.9 then 'Deep Dense' end, case when severity_cnn > 0.9 then 'Deep CNN' end)"
query("e66_report_summary", f"select flight_id, severity_cnn as confidence, {IDS} as rule_ids, {MLF} as layers from reports")(
    lambda t: extract_reports(report_docs(t)).select("flight_id", c("confidence_score").alias("confidence"), F.array_join(c("matched_rule_ids").cast("array<string>"), ", ").alias("rule_ids"), F.array_join("ml_layers_flagged", ",").alias("layers")))
query("e67_report_wide", f"select flight_id, is_anomaly as pipeline_is_anomaly, 'ANOMALY' as rules_status, {IDS} as matched_rule_ids, concat_ws(', ', case when has_1 = 1 then 'Emergency' end, case when has_4 = 1 then 'Proximity' end, case when has_8 = 1 then 'Diversion' end) as matched_rule_names, concat_ws(', ', case when has_1 = 1 or has_4 = 1 then 'safety' end, case when has_8 = 1 then 'operations' end) as matched_rule_categories, severity_cnn, severity_dense from reports")(
    lambda t: extract_reports(report_docs(t)).select("flight_id", "pipeline_is_anomaly", "rules_status", F.array_join(c("matched_rule_ids").cast("array<string>"), ", ").alias("matched_rule_ids"),
                                                    "matched_rule_names", "matched_rule_categories", "severity_cnn", "severity_dense"))
query("a19_flat_report_export", "select flight_id, ts, r.id::int as rule_id, r.name as rule_name from reports left join (values (1,'Emergency'),(4,'Proximity'),(8,'Diversion')) r(id,name) on (r.id = 1 and has_1 = 1) or (r.id = 4 and has_4 = 1) or (r.id = 8 and has_8 = 1)")(
    lambda t: extract_reports(report_docs(t)).select("flight_id", "ts", F.explode_outer("rules").alias("x")).select("flight_id", "ts", c("x.id").alias("rule_id"), c("x.name").alias("rule_name")))

# -- marine
VL = "with v as (select mmsi, max(ts) as ts from vessel_positions group by 1), k as (select p.*, row_number() over (partition by p.mmsi order by p.ts desc, latitude, longitude) as r from vessel_positions p), l as (select * exclude (r) from k where r = 1)"
query("h05_latest_vessel_position", VL + " select mmsi, latitude, longitude, speed_over_ground from l")(
    lambda t: ma.latest_positions(t.vessels).select("mmsi", "latitude", "longitude", "speed_over_ground"))
query("d10_vessels_with_latest", VL + " select m.mmsi, vessel_name, latitude, longitude from vessel_metadata m left join l on l.mmsi = m.mmsi")(
    lambda t: ma.with_latest(t.vessel_meta, t.vessels).select("mmsi", "vessel_name", "latitude", "longitude"))
query("b09_active_vessels", "with k as (select p.*, row_number() over (partition by p.mmsi order by p.ts desc, latitude, longitude) as r from vessel_positions p where ts > timestamp '1998-06-01' and latitude between 30 and 34 and longitude between 31 and 35) select k.mmsi, vessel_name, latitude, longitude from k left join vessel_metadata m on m.mmsi = k.mmsi where r = 1 and vessel_type_description ilike '%tank%'")(
    lambda t: ma.active_vessels(t.vessels, t.vessel_meta, F.lit("1998-06-01").cast("timestamp_ntz"), "tank", (30, 31, 34, 35)).select("mmsi", "vessel_name", "latitude", "longitude"))
query("b10_vessel_search", "select mmsi, vessel_name from vessel_metadata where mmsi like '%20000001%' or vessel_name ilike '%20000001%' order by case when mmsi = '20000001' then 1 when vessel_name ilike '20000001' then 2 else 3 end, mmsi limit 20")(
    lambda t: ma.search(t.vessel_meta, "20000001").select("mmsi", "vessel_name"))
query("e69_marine_statistics", "select 'total' as kind, 'vessels' as label, count(distinct mmsi) as n from vessel_positions union all select 'total', 'positions', count(*) from vessel_positions union all select 'type', vessel_type_description, count(*) from vessel_metadata where mmsi in (select mmsi from vessel_positions) group by 2 union all select 'status', navigation_status, count(distinct mmsi) from vessel_positions group by 2")(
    lambda t: ma.statistics(t.vessels, t.vessel_meta))
query("a18_ais_messages", "select mmsi, count(*) as messages, max(speed_over_ground) as max_speed from vessel_positions group by 1")(
    lambda t: ma.parse_messages(t.vessels.select(F.to_json(F.struct(*t.vessels.columns)).alias("value"))).groupBy("mmsi").agg(F.count("*").alias("messages"), F.max("speed_over_ground").alias("max_speed")))
query("a14_month_partitions", "select strftime(ts, '%Y-%m') as year_month, count(*) as positions from vessel_positions group by 1")(
    lambda t: t.vessels.groupBy(F.substring(c("ts").cast("string"), 1, 7).alias("year_month")).agg(F.count("*").alias("positions")))
