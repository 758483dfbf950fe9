"""Ordered-point operators, gap statistics and cell maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.functions import geo, keys
from wayfold.operators import sequence as sq, spatial as sp
from wayfold.operators.windows import with_neighbours
from wayfold.plans.core_queries import ZONE_SQL, first_zone, r4
from wayfold.plans.registry import query, sql_bearing, sql_cell, sql_delta, sql_hav, sql_hour, sql_mean, sql_month

R = "3440.065"
LAGS = ", ".join(f"lag({c}) over w as prev_{c}" for c in ("ts", "lat", "lon", "alt", "gspeed", "vspeed", "track"))
P = f"with p as (select *, {LAGS} from tracks window w as (partition by flight_id order by ts))"
GAP = P + """, g as (select flight_id, prev_ts as gap_start, ts as gap_end, prev_lat as lat, prev_lon as lon, prev_alt as alt, ts - prev_ts as gap_s, lat as end_lat, lon as end_lon
 from p where ts - prev_ts > 300 and (prev_alt is null or prev_alt > 5000))"""
AWAY = lambda nm, t="g": f"not exists (select 1 from airports a where {sql_hav(f'{t}.lat', f'{t}.lon', 'a.lat', 'a.lon', R)} <= {nm})"

query("h01_signal_gaps", GAP + " select * from g")(lambda t: sq.signal_gaps(t.tracks))

query("h02_pairwise_deltas", P + f""", d as (select *, ts - prev_ts as dt, {sql_hav('prev_lat', 'prev_lon', 'lat', 'lon', R)} as nm, {sql_delta('track', 'prev_track')} as turn from p where prev_ts is not null)
select flight_id, ts, dt, round(nm,4) as dist_nm, round(nm/dt*3600,3) as speed_kt, round(abs(alt-prev_alt)/dt,4) as alt_rate, round(abs(turn)/dt,4) as turn_rate,
 round(case when nm > 0.1 then abs({sql_delta('track', sql_bearing('prev_lat', 'prev_lon', 'lat', 'lon'))}) else 0 end,3) as mismatch from d""")(
    lambda t: sq.deltas(t.tracks).select("flight_id", "ts", "dt", r4(F.col("dist_nm")).alias("dist_nm"), F.round("speed_kt", 3).alias("speed_kt"),
                                         r4(F.col("alt_rate")).alias("alt_rate"), r4(F.col("turn_rate")).alias("turn_rate"),
                                         F.round("mismatch", 3).alias("mismatch")))

FEAT = P + f""", f as (select *, case when prev_ts is null then 1.0 else greatest(1.0, ts - prev_ts) end as dt, case when prev_ts is null then 0 else alt - prev_alt end as d_alt,
 case when prev_ts is null then 0 else {sql_delta('track', 'prev_track')} end as turn from p),
 q as (select flight_id, ts, alt, gspeed, vspeed, d_alt/dt as climb_rate, case when prev_ts is null then 0 else (gspeed-prev_gspeed)/dt end as speed_accel,
  case when prev_ts is null then 0 else (vspeed-prev_vspeed)/dt end as vert_accel, turn/dt as turn_rate, abs(vspeed) as vspeed_abs,
  case when prev_ts is null then 0 else {sql_hav('prev_lat', 'prev_lon', 'lat', 'lon', '6371000')} end as distance_step_m,
  case when alt < 1000 then 'ground' when vspeed > 400 then 'climb' when vspeed < -400 then 'descent' else 'cruise' end as phase,
  sum(turn) over (partition by flight_id order by ts range between 300 preceding and current row) as cum_turn_300,
  sum(d_alt) over (partition by flight_id order by ts range between 60 preceding and current row) as cum_alt_60,
  avg(gspeed) over (partition by flight_id order by ts range between 300 preceding and current row) as avg_speed_300 from f)
"""
FCOLS = ["climb_rate", "speed_accel", "vert_accel", "turn_rate", "vspeed_abs", "distance_step_m", "cum_turn_300", "cum_alt_60", "avg_speed_300"]
query("h03_point_features", FEAT + "select flight_id, ts, phase, " + ", ".join(f"round({c},3) as {c}" for c in FCOLS) + " from q")(
    lambda t: sq.point_features(t.tracks).select("flight_id", "ts", "phase", *[F.round(c, 3).alias(c) for c in FCOLS]))

@query("e68_flight_features", FEAT + "select flight_id, max(ts)-min(ts) as duration, count(*) as num_points, " + ", ".join(
    f"round(avg({c}),6) as {c}_mean, round(stddev_pop({c}),6) as {c}_std, round(min({c}),6) as {c}_min, round(max({c}),6) as {c}_max, "
    f"round(quantile_cont({c},0.95),6) as {c}_q95, round(quantile_cont({c},0.05),6) as {c}_q05" for c in sq.SERIES) + ", " + ", ".join(
    f"round(avg(case when phase = '{p}' then 1.0 else 0.0 end),6) as phase_{p}_pct" for p in ("ground", "climb", "descent", "cruise")) + " from q group by 1")
def _e68(t):
    f = sq.flight_features(sq.point_features(t.tracks))
    return f.select(*[c if c in ("flight_id", "duration", "num_points") else F.round(c, 6).alias(c) for c in f.columns])


H04 = f"select flight_id, ts, {sql_hav('lat', 'lon', '32.011389', '34.886667')} as nm from tracks"
query("h04_closest_point_per_flight", f"select flight_id, min_by(ts, (round(nm,9), ts)) as ts, round(min(nm),4) as nm from ({H04}) group by 1")(
    lambda t: t.tracks.select("flight_id", "ts", geo.haversine("lat", "lon", 32.011389, 34.886667).alias("nm"))
    .groupBy("flight_id").agg(F.min_by("ts", F.struct(F.round("nm", 9), "ts")).alias("ts"), r4(F.min("nm")).alias("nm")))

query("h05_latest_per_key", """
select flight_id, max(ts) as ts, max_by(lat, ts) as lat, max_by(lon, ts) as lon, max_by(alt, ts) as alt from tracks group by 1""")(
    lambda t: t.tracks.groupBy("flight_id").agg(F.max(F.struct("ts", "lat", "lon", "alt")).alias("p")).select("flight_id", "p.*"))

BURST = """
with e as (select flight_id, ts from tracks where gspeed > 380), g as (select *, case when ts - lag(ts) over (partition by flight_id order by ts) <= 60 then 0 else 1 end as s from e),
 c as (select *, sum(s) over (partition by flight_id order by ts) as k from g), z as (select flight_id, k, count(*) as n from c group by 1, 2)
select flight_id, count(*) filter (where n >= 2) as clusters from z group by 1"""
query("h06_burst_clusters", BURST)(lambda t: sq.burst_clusters(t.tracks.where("gspeed > 380")))

query("h07_warning_buffer", """
select flight_id, ts, case when row_number() over w >= 15 then (sum(case when gspeed > 250 then 1 else 0 end) over (partition by flight_id order by ts rows between 14 preceding and current row))::bigint end as warnings,
 row_number() over w >= 15 and sum(case when gspeed > 250 then 1 else 0 end) over (partition by flight_id order by ts rows between 14 preceding and current row) >= 12 as alarm
from tracks window w as (partition by flight_id order by ts)""")(
    lambda t: sq.warning_buffer(t.tracks.select("flight_id", "ts", "gspeed"), F.col("gspeed") > 250)
    .select("flight_id", "ts", "warnings", "alarm"))

query("h08_heading_oscillation", P + f""", d as (select flight_id, ts, {sql_delta('(track*7 + vspeed)', '(prev_track*7 + prev_vspeed)')} as turn from p where prev_ts is not null),
 e as (select *, lag(turn) over (partition by flight_id order by ts) as pt from d)
select flight_id, ts, round(turn,3) as turn, round(pt,3) as prev_turn from e where (pt > 30 and turn < -30) or (pt < -30 and turn > 30)""")(
    # Headings of the sample turn slowly; a mixed heading gives the operator something to find.
    lambda t: sq.deltas(t.tracks.withColumn("track", F.col("track") * 7 + F.col("vspeed")), with_previous_turn=True)
    .where(sq.oscillates()).select("flight_id", "ts", F.round("turn", 3).alias("turn"), F.round("prev_turn", 3).alias("prev_turn")))

CHUNK = P + f""", k as (select *, {sql_hav('prev_lat', 'prev_lon', 'lat', 'lon', '6371.0')} as km, round({sql_hav('lat', 'lon', '30.5', '33.6')},9) as nm from p),
 c as (select *, sum(coalesce(km,0)) over (partition by flight_id order by ts) as cum from k),
 m as (select flight_id, min_by(cum, (nm, ts)) as cc from c where nm <= 12 group by 1),
 q as (select c.*, {sql_bearing('prev_lat', 'prev_lon', 'lat', 'lon')} as b, km*3600/(ts-prev_ts) as v, (alt-prev_alt)*60/(ts-prev_ts) as z, row_number() over (partition by c.flight_id order by ts) as i from c join m on m.flight_id = c.flight_id where abs(cum - cc) <= 10),
 s as (select *, lag(b) over w as b0, lag(v) over w as v0, lag(z) over w as z0 from q window w as (partition by flight_id order by ts))
"""
query("h09_path_chunk", CHUNK + f"""select flight_id, count(*) as total_points, min(ts) as start_ts, max(ts) as end_ts,
 round(sum(case when i > 2 then abs({sql_delta('b', 'b0')}) else 0 end),2) as total_heading_changes, round(sum(case when i > 2 then abs(v-v0) else 0 end),2) as total_speed_changes,
 round(sum(case when i > 1 then abs(alt-prev_alt) else 0 end),2) as total_alt_changes, round(sum(case when i > 2 then abs(z-z0) else 0 end),2) as total_vspeed_changes,
 round(coalesce(avg(case when i > 1 then v end),0),2) as avg_speed, round(coalesce(avg(case when i > 1 then z end),0),2) as avg_vspeed from s group by 1""")(
    lambda t: sq.path_chunk(t.tracks, 30.5, 33.6, 12, 10))

query("h10_key_locations", """
with n as (select *, row_number() over (partition by flight_id order by ts) - 1 as i, count(*) over (partition by flight_id) as n from tracks),
 k as (select n.*, m from n, range(5) r(m)) select flight_id, ts, round(lat,4) as lat, round(lon,4) as lon, alt from n
where n <= 5 or i in (select cast(floor(r.m * n.n / 5) as bigint) from range(5) r(m))""")(lambda t: sq.key_locations(t.tracks, 5))

query("h12_origin_destination", f"""
with n as (select *, row_number() over (partition by flight_id order by ts) as a, row_number() over (partition by flight_id order by ts desc) as z from tracks),
 d as (select n.flight_id, n.a, n.z, min_by(code, ({sql_hav('n.lat', 'n.lon', 'p.lat', 'p.lon')}, ord)) as code, min({sql_hav('n.lat', 'n.lon', 'p.lat', 'p.lon')}) as nm from n, airports p where (n.a <= 20 or n.z <= 20) and n.alt <= 5000 group by 1, 2, 3)
select f.flight_id, (select min_by(code, a) from d where d.flight_id = f.flight_id and a <= 20 and nm <= 60) as origin, (select min_by(code, z) from d where d.flight_id = f.flight_id and z <= 20 and nm <= 60) as destination
from (select distinct flight_id from tracks) f""")(lambda t: sq.od_by_ends(t.tracks, t.airports, nm=60))

query("h13_endpoints", f"""
with e as (select flight_id, min_by(lat, ts) as a, min_by(lon, ts) as b, max_by(lat, ts) as c, max_by(lon, ts) as d from tracks group by 1)
select flight_id, (select case when min({sql_hav('a', 'b', 'lat', 'lon')}) <= 100 then min_by(code, ({sql_hav('a', 'b', 'lat', 'lon')}, ord)) end from airports) as origin,
 (select case when min({sql_hav('c', 'd', 'lat', 'lon')}) <= 100 then min_by(code, ({sql_hav('c', 'd', 'lat', 'lon')}, ord)) end from airports) as destination from e""")(
    lambda t: sq.od_by_endpoints(t.tracks, t.airports, 100))

query("h14_consecutive_pairs", P + " select flight_id, prev_ts, ts from p where prev_ts is not null")(
    lambda t: sq.pairs(t.tracks).where("prev_ts is not null").select("flight_id", "prev_ts", "ts"))
query("h11_flight_patterns")(lambda t: sq.flight_patterns(t.tracks))

query("c10_smoothed_track", """
select flight_id, ts, round(avg(lat) over w,6) as lat, round(avg(lon) over w,6) as lon from tracks window w as (partition by flight_id order by ts rows between 1 preceding and 1 following)""")(
    lambda t: with_neighbours(t.tracks.select("flight_id", "ts", "lat", "lon"), {"plat": "lat", "plon": "lon"}, {"nlat": "lat", "nlon": "lon"})
    .select("flight_id", "ts", *[F.round((F.col(c) + F.coalesce(f"p{c}", F.lit(0.0)) + F.coalesce(f"n{c}", F.lit(0.0)))
                                         / (1 + F.col(f"p{c}").isNotNull().cast("int") + F.col(f"n{c}").isNotNull().cast("int")), 6).alias(c)
                                 for c in ("lat", "lon")]))

query("c10_smoothed_polyline", """
select flight_id, ts, round(case when count(*) over (partition by flight_id) < 5 then lat else avg(lat) over w end,6) as lat, round(case when count(*) over (partition by flight_id) < 5 then lon else avg(lon) over w end,6) as lon
from tracks window w as (partition by flight_id order by ts rows between 2 preceding and 2 following)""")(
    lambda t: sq.smooth_track(t.tracks).select("flight_id", "ts", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon")))

# -- summaries
SUMM = P + f"""
select flight_id, min(ts) as flight_start_ts, max(ts) as flight_end_ts, max(ts)-min(ts) as flight_duration_sec, count(*) as total_points,
 min(alt) as min_altitude_ft, max(alt) as max_altitude_ft, round(avg(alt),3) as avg_altitude_ft, min(gspeed) as min_speed_kts, max(gspeed) as max_speed_kts, round(avg(gspeed),3) as avg_speed_kts,
 min_by(lat,ts) as start_lat, min_by(lon,ts) as start_lon, max_by(lat,ts) as end_lat, max_by(lon,ts) as end_lon, round(coalesce(sum({sql_hav('prev_lat', 'prev_lon', 'lat', 'lon', R)}),0),2) as total_distance_nm,
 string_agg(distinct squawk, ',' order by squawk) as squawk_codes {{x}} from p group by 1"""


def _summary(t, ext):
    s = sq.flight_summary(t.tracks, ext).withColumn("squawk_codes", F.array_join("squawk_codes", ","))
    return s.withColumns({c: F.round(c, 3) for c in ("avg_altitude_ft", "avg_speed_kts")})


query("e64_flight_summary", SUMM.replace("{x}", ""))(lambda t: _summary(t, False))
query("e65_extended_summary", SUMM.replace("{x}", ", max(vspeed) as max_vspeed_fpm, min(vspeed) as min_vspeed_fpm"))(lambda t: _summary(t, True))

BANDS = {"N1": (0, 60), "N2": (60, 120), "S1": (120, 180), "S2": (180, 240), "W1": (240, 300), "W2": (300, 360)}
BAND_SQL = "case " + " ".join(f"when hdg between {a} and {b} then '{n}'" for n, (a, b) in BANDS.items()) + " end"
query("e14_runway_usage", f"""
with p as (select flight_id, min_by(alt,ts) as a0, max_by(alt,ts) as a1, min(alt) as lo, min_by(track,(alt,ts)) as hdg from tracks where lat between 29.4-1.0 and 29.4+1.0 and lon between 33.2-1.0 and 33.2+1.0 and alt between 0 and 12000 group by 1 having count(*) >= 3),
 u as (select *, {BAND_SQL} as runway from p where lo < 1500 and a0 <> a1)
select r.runway, count(*) filter (where a0 > a1) as landings, count(*) filter (where a0 < a1) as takeoffs, count(a0) as total from (values {','.join(f"('{n}')" for n in BANDS)}) r(runway) left join u on u.runway = r.runway group by 1""")(
    # The busiest area of the sample stands in for an airport, with six heading bands.
    lambda t: sq.runway_usage(t.tracks, 29.4, 33.2, BANDS, nm=60, max_alt=12000))



def _runways_sql():
    """Each airport of the list with its own box and bands."""
    boxes = ",".join(f"('{k}',{la},{lo})" for k, (la, lo) in sq.RUNWAY_AIRPORTS.items())
    bands = ",".join(f"('{k}','{n}',{lo},{hi})" for k, v in sq.RUNWAY_BANDS.items() for n, (lo, hi) in v.items())
    return f"""with x(airport, la, lo) as (values {boxes}), b(airport, runway, lo, hi) as (values {bands}),
 p as (select airport, flight_id, min_by(alt,ts) as a0, max_by(alt,ts) as a1, min(alt) as low, min_by(track,(alt,ts)) as hdg from tracks, x
  where tracks.lat between x.la - 10/60.0 and x.la + 10/60.0 and tracks.lon between x.lo - 10/60.0 and x.lo + 10/60.0 and alt between 0 and 5000 and track is not null group by 1, 2 having count(*) >= 3)
select b.airport, b.runway, count(*) filter (where a0 > a1) as landings, count(*) filter (where a0 < a1) as takeoffs, count(a0) as total
from b left join p on p.airport = b.airport and hdg between b.lo and b.hi and low < 1500 and a0 <> a1 group by 1, 2"""


@query("e14_runways_by_airport", _runways_sql())
def _e14(t):
    out = None
    for airport in sq.RUNWAY_AIRPORTS:
        one = sq.runway_usage_at(t.tracks, airport)
        out = one if out is None else out.unionByName(one)
    return out


# -- gaps by time
for name, key, sqlkey in (("e19_signal_loss_monthly", keys.month_str, sql_month), ("e20_signal_loss_hourly", keys.hour_of, sql_hour)):
    col = "month" if "month" in name else "hour"
    query(name, GAP + f" select {sqlkey('gap_start')} as {col}, count(*) as count, count(distinct flight_id) as affected_flights, cast(floor(avg(gap_s)) as bigint) as avg_duration from g where {AWAY(5)} group by 1")(
        lambda t, key=key, col=col: sq.gaps_by(sq.gaps_away(t.tracks, t.airports), key("gap_start"), col))

# -- cells
CELLS = GAP + f""", c as (select cast(round_even(lat/0.25,0) as int) as cy, cast(round_even(lon/0.25,0) as int) as cx, count(*) as count, sum(gap_s) as dur, count(distinct flight_id) as affected_flights,
  count(*) filter (where gap_s < 900) as brief_count, count(*) filter (where gap_s >= 900 and gap_s < 3600) as medium_count, count(*) filter (where gap_s >= 3600) as extended_count,
  round(avg(lat),4) as lat, round(avg(lon),4) as lon, min(gap_start) as first_seen, max(gap_start) as last_seen from g where {AWAY(5)} group by 1, 2)
"""
query("s01_signal_loss_cells", CELLS + """select cy, cx, lat, lon, count, cast(floor(dur/count) as bigint) as avg_duration, cast(least(100, floor(count/(select max(count) from c)*100)) as int) as intensity, affected_flights,
 case when brief_count >= medium_count and brief_count >= extended_count then 'brief' when medium_count >= extended_count then 'medium' else 'extended' end as gap_type, brief_count, medium_count, extended_count, first_seen, last_seen
from c order by count desc, cy, cx limit 50""")(lambda t: sp.signal_loss_cells(t.tracks, t.airports))

query("s02_signal_loss_zones", P + """, g as (select *, ts - prev_ts as gap_s, (lat+prev_lat)/2 as ml, (lon+prev_lon)/2 as mo from p where ts - prev_ts >= 300),
 c as (select round_even(ml/0.25,0)*0.25 as lat, round_even(mo/0.25,0)*0.25 as lon, count(*) as count, count(distinct flight_id) as affected_flights, avg(gap_s) as avg_duration, min(ts) as first_seen, max(ts) as last_seen,
  count(*) filter (where gap_s < 600) as brief_count, count(*) filter (where gap_s >= 600 and gap_s < 1800) as medium_count, count(*) filter (where gap_s >= 1800) as extended_count from g group by 1, 2)
select *, round(least(100, count/(select max(count) from c)*40 + affected_flights/(select max(affected_flights) from c)*30 + extended_count*10 + medium_count*5),4) as intensity,
 case when extended_count > 0 then 'extended' when medium_count > 0 then 'medium' else 'brief' end as gap_type from c""")(
    lambda t: sp.signal_loss_zones(t.tracks, limit=None).withColumn("intensity", r4(F.col("intensity"))))

B0, B1 = 1704067200 + 5400, 1704067200 + 9000
query("e40_zone_baseline", f"""
with a as (select *, ts - lag(ts) over (partition by flight_id order by ts) as g from tracks where ts between {B0} and {B1}), b as (select *, ts - lag(ts) over (partition by flight_id order by ts) as g from tracks where ts between {B0 - 5400} and {B0}),
 ca as (select {sql_cell('lat', 0.5)} as lat, {sql_cell('lon', 0.5)} as lon, count(*) as n, count(distinct flight_id) as f from a where g > 60 group by 1, 2), cb as (select {sql_cell('lat', 0.5)} as lat, {sql_cell('lon', 0.5)} as lon, count(*) as n from b where g > 60 group by 1, 2),
 j as (select ca.*, coalesce(cb.n,0) as bn, case when coalesce(cb.n,0) > 0 then (ca.n - cb.n*{3600 / 5400!r})/(cb.n*{3600 / 5400!r}) else ca.n/10.0 end as s from ca left join cb on cb.lat = ca.lat and cb.lon = ca.lon)
select lat, lon, n as current_losses, bn as baseline_losses, f as affected_flights, round(s,2) as anomaly_score from j where s > 0.5 order by anomaly_score desc, lat, lon limit 20""")(
    lambda t: sp.zone_baseline(t.tracks, B0, B1, 5400))

INTF = P.replace("from tracks window", "from tracks where alt > 5000 window") + f""", d as (select *, ts-prev_ts as dt, {sql_hav('prev_lat', 'prev_lon', 'lat', 'lon', R)} as nm from p where prev_ts is not null),
 e as (select * from d where {AWAY(5, 'd')}),
 f as (select flight_id, count(*) filter (where abs(alt-prev_alt)/dt > 3000) as altitude_jumps, count(*) filter (where (alt in {tuple(sq.SPOOFED_FT)} or prev_alt in {tuple(sq.SPOOFED_FT)}) and abs(alt-prev_alt) > 5000) as spoofed_hits,
  count(*) filter (where gspeed > 600) as speed_anomalies, count(*) filter (where nm/dt*3600 > 600) as position_teleports, count(*) filter (where abs({sql_delta('track', 'prev_track')})/dt > 8) as impossible_turns,
  count(*) filter (where nm > 0.1 and abs({sql_delta('track', sql_bearing('prev_lat', 'prev_lon', 'lat', 'lon'))}) > 90) as bearing_mismatches, count(*) filter (where dt >= 300) as signal_losses, count(*) filter (where source = 'MLAT') as mlat,
  count(*) as points, avg(lat) as lat, avg(lon) as lon, min(ts) as first_seen, max(ts) as last_seen from e group by 1),
 s as (select *, least(20,altitude_jumps*2)+least(15,spoofed_hits*4)+least(15,speed_anomalies*3)+least(15,position_teleports*4)+case when mlat/points > 0.8 then 8 else 0 end+least(12,impossible_turns)+least(5,bearing_mismatches)+least(20,signal_losses*5) as score from f)
"""
query("s05_flight_interference", INTF + "select flight_id, altitude_jumps, spoofed_hits, speed_anomalies, position_teleports, impossible_turns, bearing_mismatches, signal_losses, mlat, points, score from s")(
    lambda t: sp.flight_interference(t.tracks, t.airports).drop("lat", "lon", "first_seen", "last_seen"))
ICELL = INTF + """, c as (select round_even(lat/0.25,0)*0.25 as lat, round_even(lon/0.25,0)*0.25 as lon, avg(score) as score, count(*) as affected_flights, sum(altitude_jumps)::bigint as altitude_jumps, sum(spoofed_hits)::bigint as spoofed_hits, sum(speed_anomalies)::bigint as speed_anomalies,
 sum(position_teleports)::bigint as position_teleports, sum(impossible_turns)::bigint as impossible_turns, sum(bearing_mismatches)::bigint as bearing_mismatches, sum(signal_losses)::bigint as signal_losses, min(first_seen) as first_seen, max(last_seen) as last_seen from s where score >= 15 group by 1, 2),
 ic as (select *, least(100, affected_flights/(select max(affected_flights) from c)*50 + score/100*50) as intensity from c)
"""
EXACT = ICELL.replace("avg(lat) as lat, avg(lon) as lon, min(ts)", f"{sql_mean('lat')} as lat, {sql_mean('lon')} as lon, min(ts)")
query("s04_interference_cells", EXACT + "select * replace (round(score,4) as score, round(intensity,4) as intensity) from ic order by ic.intensity desc, lat, lon limit 30")(
    lambda t: sp.interference_cells(sp.flight_interference(t.tracks, t.airports)).withColumns(
        {c: r4(F.col(c)) for c in ("score", "intensity")}))
query("s17_source_estimate", ICELL + """select round_even(lat/0.5,0)*0.5 as cell_lat, round_even(lon/0.5,0)*0.5 as cell_lon, count(*) as points, round(sum(lat*intensity)/sum(intensity),4) as est_lat,
 round(sum(lon*intensity)/sum(intensity),4) as est_lon, round(avg(intensity),2) as avg_intensity from ic group by 1, 2 having count(*) >= 2""")(
    lambda t: sp.source_estimate(sp.interference_cells(sp.flight_interference(t.tracks, t.airports), limit=None)))
query("s16_signal_map")(
    lambda t: sp.signal_map(sp.interference_cells(sp.flight_interference(t.tracks, t.airports), limit=None),
                            sp.signal_loss_cells(t.tracks, t.airports, limit=None)))

MARKED = P + f""", d as (select *, ts-prev_ts as dt, {sql_hav('prev_lat', 'prev_lon', 'lat', 'lon', R)} as nm, {sql_delta('track', 'prev_track')} as turn, abs(alt-prev_alt) as da from p where prev_ts is not null),
 e as (select *, coalesce(lag(turn) over (partition by flight_id order by ts),0) as pt from d)"""
SCORE = MARKED + f""",
 m as (select flight_id, ts, source, da > 5000 as a, (alt in {tuple(sq.SPOOFED_FT)} or prev_alt in {tuple(sq.SPOOFED_FT)}) and da > 5000 as b, da/dt > 3000 as c, gspeed > 600 as d, nm/dt*3600 > 600 as e, abs(turn)/dt > 8 as f,
  (pt > 30 and turn < -30) or (pt < -30 and turn > 30) as g, nm > 0.1 and abs({sql_delta('track', sql_bearing('prev_lat', 'prev_lon', 'lat', 'lon'))}) > 90 as h from e),
 fl as (select flight_id, ts, case when ts - lag(ts) over (partition by flight_id order by ts) <= 60 then 0 else 1 end as s from m where a or b or c or d or e or f or g or h),
 fk as (select *, sum(s) over (partition by flight_id order by ts) as k from fl), z as (select flight_id, count(*) filter (where n >= 2) as clusters from (select flight_id, k, count(*) as n from fk group by 1, 2) group by 1),
 n as (select flight_id, count(*) filter (where a) as altitude_jumps, count(*) filter (where b) as spoofed_hits, count(*) filter (where c) as impossible_rates, count(*) filter (where d) as speed_anomalies, count(*) filter (where e) as position_teleports,
  count(*) filter (where f) as impossible_turns, count(*) filter (where g) as oscillations, count(*) filter (where h) as bearing_mismatches, round(count(*) filter (where source = 'MLAT')/(count(*)+1),2) as mlat_ratio from m group by 1),
 j as (select n.*, coalesce(clusters,0) as clusters from n left join z on z.flight_id = n.flight_id),
 k as (select *, cast(least(100, least(10,altitude_jumps)+least(12,spoofed_hits*3)+least(8,impossible_rates*2)+least(12,speed_anomalies*2)+least(13,position_teleports*3)+least(10,impossible_turns)+least(10,oscillations*2)+least(5,bearing_mismatches)+least(10,clusters*2)
  + case when mlat_ratio > 0.9 then 10 when mlat_ratio > 0.7 then 7 when mlat_ratio > 0.5 then 4 else 0 end) as bigint) as score from j)
select *, case when score >= 60 then 'HIGH' when score >= 35 then 'MEDIUM' when score >= 15 then 'LOW' else 'UNLIKELY' end as confidence from k"""
query("g20_interference_score", SCORE)(lambda t: sp.flight_score(t.tracks))

query("s12_hotspot_cells", P + f""", c as (select {sql_cell('prev_lat', 0.5)} as lat, {sql_cell('prev_lon', 0.5)} as lon, count(*) as losses, count(distinct flight_id) as flights, sum(ts-prev_ts)::bigint as duration from p where ts - prev_ts > 300 group by 1, 2)
select *, round(losses*flights*duration/3600,2) as score from c where losses >= 3 order by score desc, lat, lon limit 30""")(lambda t: sp.hotspot_cells(t.tracks))

query("s13_region_counts", CELLS + f"""select coalesce((select min_by(zone, ord) from {ZONE_SQL} where c.lat between s and n and c.lon between w and e),'Other') as region, count(*) as zones, sum(count)::bigint as events from c group by 1""")(
    lambda t: sp.region_counts(sp.signal_loss_cells(t.tracks, t.airports, limit=None), first_zone()))

NM = "select flight_id, 'U' || cast(cast(altitude_diff_ft as bigint) % 150 as varchar) as other, ts, distance_nm, altitude_diff_ft, lat, lon from rule_hits where rule_id = 4"
query("s14_near_miss_map", f"""
with e as ({NM}), d as (select min_by((lat, lon, distance_nm), (ts, flight_id)) as v from e where altitude_diff_ft < 1000 group by least(flight_id, other), greatest(flight_id, other), floor(ts/300)),
 x as (select struct_extract_at(v,1) as la, struct_extract_at(v,2) as lo, struct_extract_at(v,3) as nm from d)
select {sql_cell('la', 0.5)} as lat, {sql_cell('lo', 0.5)} as lon, count(*) as count, count(*) filter (where nm < 1) as severity_high, count(*) filter (where nm >= 1) as severity_medium from x group by 1, 2 order by count desc, lat, lon limit 50""")(
    lambda t: sp.near_miss_map(t.spark.sql(NM.replace("varchar", "string").replace("rule_hits", "{h}"), h=t.hits)))

query("s15_bottleneck_cells", f"""
with c as (select cast(round_even(lat/0.5,0) as int) as cy, cast(round_even(lon/0.5,0) as int) as cx, count(distinct flight_id) as flight_count, avg(lat) as lat, avg(lon) as lon, avg(alt) as a, max(ts)-min(ts) as sp from tracks group by 1, 2),
 h as (select cast(round_even(lat/0.5,0) as int) as cy, cast(round_even(lon/0.5,0) as int) as cx, count(*) as n from extra_hits where rule_id = 3 group by 1, 2),
 j as (select c.*, coalesce(h.n,0) as holding_count, least(100, flight_count/(select max(flight_count) from c)*50 + coalesce(h.n,0)*5) as s from c left join h on h.cy = c.cy and h.cx = c.cx where flight_count >= 2)
select cy, cx, round(lat,4) as lat, round(lon,4) as lon, flight_count, holding_count, round(s,1) as density_score, case when s >= 50 then 'critical' when s >= 30 then 'high' when s >= 15 then 'moderate' else 'low' end as congestion_level,
 round(a,0) as avg_altitude, round(flight_count/greatest(sp/3600,1),1) as flights_per_hour from j order by density_score desc, cy, cx limit 20""")(
    lambda t: sp.bottleneck_cells(t.tracks, t.extra.where("rule_id = 3")))
