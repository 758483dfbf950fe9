"""Traffic and safety statistics, with the SQL each must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.functions import keys
from wayfold.operators import scans, stats as st
from wayfold.plans.core_queries import T0, T1
from wayfold.plans.registry import query, sql_date, sql_dow, sql_hav, sql_hour, sql_month

MIL = "(is_military or category = 'Military_and_government')"

query("e01_distinct_flights", f"select count(distinct flight_id) as flights from tracks where ts between {T0} and {T1}")(
    lambda t: st.distinct_flights(t.tracks, T0, T1))

query("e02_overview", """
select (select count(distinct flight_id) from tracks) as total_flights,
 (select count(*) from reports where is_anomaly = 1) as total_anomalies,
 count(distinct case when rule_id = 1 then flight_id end) as emergency_codes,
 count(distinct case when rule_id = 4 then flight_id end) as near_miss,
 count(distinct case when rule_id = 6 then flight_id end) as go_arounds,
 count(distinct case when rule_id in (1,4,6) then flight_id end) as safety_events from rule_hits""")(
    lambda t: st.overview(t.tracks, t.hits, t.reports, T0, T1))

query("e03_flag_overview", """
select count(*) as flights, sum(is_anomaly)::bigint as anomalies, sum(has_1)::bigint as emergencies, sum(has_4)::bigint as near_miss,
 sum(has_6)::bigint as go_arounds, count(*) filter (where has_1+has_4+has_6 > 0) as safety_events from reports""")(
    lambda t: st.flag_overview(t.reports))

DAY = 86400
@query("e04_last_day_overview", f"""
with h as (select flight_id, ts, rule_id from rule_hits union all select flight_id, ts, rule_id from extra_hits),
 e as (select max(ts) m from h)
select count(distinct flight_id) filter (where rule_id = 1) as emergency, count(distinct flight_id) filter (where rule_id = 3) as holding,
 count(distinct flight_id) filter (where rule_id = 4) as near_miss, count(distinct flight_id) filter (where rule_id = 6) as go_around,
 count(distinct flight_id) filter (where rule_id = 7) as return_to_field, count(distinct flight_id) filter (where rule_id = 12) as unplanned
from h, e where ts between m - {DAY} and m""")
def _e04(t):
    h = t.hits.select("flight_id", "ts", "rule_id").unionByName(t.extra.select("flight_id", "ts", "rule_id"))
    # as_of is the newest hit; a one-row frame joined on a constant keeps it on the cluster.
    m = h.agg(F.max("ts").alias("m"))
    recent = h.join(F.broadcast(m), (F.col("ts") >= F.col("m") - DAY) & (F.col("ts") <= F.col("m")))
    return st.rule_counts_since(recent, T0, T1, {1: "emergency", 3: "holding", 4: "near_miss", 6: "go_around",
                                                 7: "return_to_field", 12: "unplanned"})


query("e05_flights_per_day", f"""
select {sql_date('first_seen_ts')} as date, count(*) as count, count(*) filter (where {MIL}) as military_count,
 count(*) filter (where not {MIL}) as civilian_count from flight_metadata group by 1""")(
    lambda t: st.flights_per_day(t.meta, T0, T1))

query("e06_flights_per_month", f"""
select {sql_month('first_seen_ts')} as month, count(*) as total_flights, count(*) filter (where {MIL}) as military_count,
 sum(is_anomaly)::bigint as anomaly_count, round(avg(flight_duration_sec)/3600,2) as avg_duration_hours from flight_facts group by 1""")(
    lambda t: st.flights_per_month(t.facts, T0, T1))

BUSY = """
select airport, sum(1-dep)::bigint as arrivals, sum(dep)::bigint as departures, count(*) as total from
 (select origin_airport as airport, 1 as dep from {src} union all select destination_airport, 0 from {src})
where airport is not null and airport <> '' group by 1 order by total desc, airport limit 10"""
query("e07_busiest_airports", BUSY.replace("{src}", "flight_metadata"))(lambda t: st.busiest_airports(t.meta))

query("e08_airport_hourly", f"""
select h.hour::int as hour, (select count(*) from flight_metadata where origin_airport='LLBG' and {sql_hour('first_seen_ts')} = h.hour) as departures,
 (select count(*) from flight_metadata where destination_airport='LLBG' and {sql_hour('last_seen_ts')} = h.hour) as arrivals,
 (select count(*) from flight_metadata where origin_airport='LLBG' and {sql_hour('first_seen_ts')} = h.hour) +
 (select count(*) from flight_metadata where destination_airport='LLBG' and {sql_hour('last_seen_ts')} = h.hour) as total
from range(24) h(hour)""")(lambda t: st.airport_hourly(t.meta, "LLBG"))

query("e09_busiest_routes", """
select origin_airport, destination_airport, count(*) as flights, round(avg(flight_duration_sec)/60,1) as avg_duration_min,
 round(avg(total_distance_nm),1) as avg_distance_nm from flight_facts where destination_airport is not null group by 1,2
order by flights desc, 1, 2 limit 20""")(lambda t: st.busiest_routes(t.facts))


# Tagged flights are those that a reviewer confirmed.
TAGGED = "flight_id in (select flight_id from feedback where user_label = 1)"


def _confirmed(t, df):
    return df.join(t.feedback.where("user_label = 1").select("flight_id"), "flight_id", "left_semi")


EFF = """
select airline, count(*) as flights, round(avg(flight_duration_sec)/60,1) as avg_duration_min, round(avg(total_distance_nm),1) as avg_distance_nm,
 round(avg(avg_speed_kts),1) as avg_speed_kts, round(100.0*avg(is_anomaly),1) as anomaly_rate from flight_facts group by 1
having count(*) >= {k} order by flights desc, airline limit 20"""
query("e10_airline_efficiency", EFF.replace("{k}", "5"))(lambda t: st.airline_efficiency(t.facts, 5))
query("e61_tagged_airlines", EFF.replace("{k}", "2").replace("from flight_facts", "from flight_facts where " + TAGGED))(lambda t: st.airline_efficiency(_confirmed(t, t.facts), 2))

ROUTED = "from flight_facts where origin_airport <> '' and destination_airport is not null and destination_airport <> ''"
query("e11_available_routes", f"select origin_airport||'-'||destination_airport as route, count(*) as flights {ROUTED} group by 1 having count(*) >= 5")(
    lambda t: st.available_routes(t.facts))
query("e12_top_routes", f"""
select origin_airport||'-'||destination_airport as route, count(*) as flight_count, round(avg(flight_duration_sec)/60,1) as avg_duration_min,
 round(100.0*avg(is_anomaly),1) as anomaly_rate, count(distinct substr(callsign,1,3)) as airline_count {ROUTED} group by 1 order by 2 desc, 1 limit 10""")(
    lambda t: st.top_routes(t.facts))
query("e62_tagged_routes", f"""
select origin_airport||'-'||destination_airport as route, count(*) as flight_count, round(avg(flight_duration_sec)/60,1) as avg_duration_min,
 round(100.0*avg(is_anomaly),1) as anomaly_rate, count(distinct substr(callsign,1,3)) as airline_count {ROUTED} and {TAGGED} group by 1 order by 2 desc, 1 limit 20""")(
    lambda t: st.top_routes(_confirmed(t, t.facts), 20))

query("e13_route_comparison", """
with dev as (select flight_id, max(distance_nm) as dev from rule_hits where rule_id in (5,11) group by 1),
 a as (select airline, count(*) as flights, avg(flight_duration_sec) as d, coalesce(avg(case when dev <> 0 then dev end),0) as v, avg(is_anomaly) as an
  from flight_facts f left join dev on dev.flight_id = f.flight_id where origin_airport='LCLK' and destination_airport='LTFM' group by 1),
 b as (select airline, flights, round(d/60,1) as avg_duration_min, round(v,3) as avg_deviation_nm, round(an*100,1) as anomaly_rate,
  round(greatest(0, least(100, 100 - v*0.5 - an*20)),1) as efficiency_score from a)
select *, row_number() over (order by efficiency_score desc, airline) as rank from b""")(
    lambda t: st.route_comparison(t.facts, t.hits, "LCLK", "LTFM"))

query("e15_emergency_codes", """
select trim(squawk) as code, substr(callsign,1,3) as airline, count(distinct flight_id) as flights, count(*) as events from tracks
where trim(squawk) in ('7500','7600','7700') group by 1, 2""")(lambda t: st.emergency_codes(t.tracks))

query("e16_near_miss_per_flight", """
select flight_id, min_by(ts, (distance_nm, ts)) as ts, round(min(distance_nm),2) as distance_nm,
 cast(min_by(altitude_diff_ft, (distance_nm, ts)) as int) as altitude_diff_ft, case when min(distance_nm) < 1 then 'high' else 'medium' end as severity
from rule_hits where rule_id = 4 and altitude_diff_ft < 1000 group by 1""")(lambda t: st.near_miss_per_flight(t.hits))

query("e17_go_arounds_by_airport", f"""
with h as (select airport, {sql_hour()} as hour, count(*) as n from rule_hits where rule_id = 6 group by 1, 2)
select airport, hour, n, (sum(n) over (partition by airport))::bigint as count,
 round((sum(n) over (partition by airport))/30.0, 2) as avg_per_day from h""")(lambda t: st.go_arounds_by_airport(t.hits, 30.0))
query("e18_go_arounds_by_hour", f"""
select h.hour::int as hour, count(r.airport) as count, coalesce(string_agg(distinct airport, ',' order by airport),'') as airports
from range(24) h(hour) left join rule_hits r on rule_id = 6 and {sql_hour('r.ts')} = h.hour group by 1""")(lambda t: st.go_arounds_by_hour(t.hits))

query("e21_diversion_totals", """
select (select count(*) from rule_hits where rule_id = 8) as diversions,
 (select count(*) from extra_hits where rule_id = 3 and turn_deg >= 300) as holding_360s,
 (select count(*) from (select flight_id from rule_hits where rule_id = 11 group by 1 having count(*) >= 3)) as large_deviations""")(
    lambda t: st.diversion_totals(t.hits, t.extra))
query("e21_diversions_by_airport", "select airport, count(*) as diversions from rule_hits where rule_id = 8 group by 1")(
    lambda t: st.diversions_by(t.hits, t.meta, "airport"))
query("e21_diversions_by_airline", """
select upper(regexp_replace(substr(callsign,1,3),'[^A-Za-z]','','g')) as airline, count(*) as diversions
from rule_hits join flight_metadata using (flight_id) where rule_id = 8 group by 1""")(
    lambda t: st.diversions_by(t.hits, t.meta, "airline"))
query("e22_diversions_monthly", f"""
with u as (select ts, flight_id, rule_id, 0.0 as turn_deg from rule_hits union all select ts, flight_id, rule_id, turn_deg from extra_hits where rule_id = 3)
select {sql_month()} as month, count(*) filter (where rule_id = 8) as diversions, count(*) filter (where rule_id = 3 and turn_deg >= 300) as holding_patterns,
 count(*) filter (where rule_id = 11) as off_course, count(distinct flight_id) filter (where rule_id = 8) as affected_flights,
 count(*) filter (where rule_id = 8 or rule_id = 11 or (rule_id = 3 and turn_deg >= 300)) as total_events from u group by 1""")(
    lambda t: st.diversions_monthly(t.hits, t.extra))
query("e23_diversions_seasonal", f"""
with m as (select m.m as month, count(r.ts) as c from range(1,13) m(m) left join rule_hits r on rule_id = 8 and cast(substr({sql_date('r.ts')},6,2) as int) = m.m group by 1)
select 'month' as kind, cast(month as varchar) as bucket, c as count from m union all
select 'quarter', 'Q' || cast(cast(ceil(month/3.0) as int) as varchar), sum(c)::bigint from m group by 2 union all
select 'season', case when month in (12,1,2) then 'Winter' when month in (3,4,5) then 'Spring' when month in (6,7,8) then 'Summer' else 'Fall' end, sum(c)::bigint from m group by 2""")(
    lambda t: st.diversions_seasonal(t.hits))

query("e24_return_events", """
with f as (select *, row_number() over (partition by flight_id order by ts) rn from extra_hits where rule_id = 7 and duration_s/60 <= 30)
select f.flight_id, f.ts as departure_time, cast(f.ts + duration_s as bigint) as landing_time, round(duration_s/60,1) as duration_min, airport,
 round(outbound_nm,1) as max_outbound_nm, callsign from f left join flight_metadata m on m.flight_id = f.flight_id where rn = 1
order by departure_time desc, f.flight_id limit 50""")(lambda t: st.return_events(t.extra, t.meta))

query("e25_safety_monthly", f"""
select {sql_month()} as month, count(*) filter (where rule_id=1) as emergency_codes, count(*) filter (where rule_id=4) as near_miss,
 count(*) filter (where rule_id=6) as go_arounds, count(*) as total_events, count(distinct flight_id) as affected_flights
from rule_hits where rule_id in (1,4,6) group by 1""")(lambda t: st.safety_monthly(t.hits))

query("e26_safety_by_phase", """
with e as (select h.flight_id, rule_id, altitude_diff_ft, case when rule_id = 1 then null else distance_nm * 10000 end as alt, duration_s as gspeed from rule_hits h
  where rule_id in (1,4,6) and (rule_id <> 4 or altitude_diff_ft < 1000)),
 p as (select flight_id, rule_id, max(alt) as alt, max(gspeed) as g from e group by 1, 2),
 q as (select flight_id, rule_id, case when rule_id = 6 then 'approach' when alt > 25000 then 'cruise' when alt > 10000 then 'descent_climb' when alt is not null then 'approach'
  when g > 400 then 'cruise' when g < 200 then 'approach' else 'descent_climb' end as phase from p)
select phase, count(distinct flight_id) filter (where rule_id=1) as emergency, count(distinct flight_id) filter (where rule_id=4) as near_miss,
 count(distinct flight_id) filter (where rule_id=6) as go_around from q group by 1""")(
    lambda t: st.safety_by_phase(t.hits.select(
        "flight_id", "rule_id", "altitude_diff_ft", F.when(F.col("rule_id") != 1, F.col("distance_nm") * 10000).alias("alt"),
        F.col("duration_s").alias("gspeed"))))

query("e27_deviations_by_type", """
with p as (select flight_id, max(distance_nm) as dev from rule_hits where rule_id in (5,11) group by 1)
select aircraft_type, count(*) as deviation_count, round(avg(dev),1) as avg_deviation_nm, count(*) filter (where dev > 3) as large_deviations
from p join flight_metadata using (flight_id) where aircraft_type <> '' group by 1""")(
    lambda t: st.deviations_by_type(t.hits, t.meta, large_nm=3))

OUT = """
with p as (select flight_id, bool_or(rule_id = 8) as div, max(ts) filter (where rule_id = 1) as ts from rule_hits where rule_id in (1,8) group by 1 having bool_or(rule_id = 1)),
 o as (select p.flight_id, p.ts, airline, case when squawk_codes like '%7700%' then '7700' when squawk_codes like '%7600%' then '7600'
  when squawk_codes like '%7500%' then '7500' else 'UNKNOWN' end as code,
  case when div then 'diverted' when origin_airport = destination_airport then 'rtb' when destination_airport <> '' then 'landed_safely' else 'unknown' end as outcome
 from p left join flight_facts f on f.flight_id = p.flight_id)
"""
query("e28_emergency_outcomes", OUT + "select * from o")(lambda t: st.emergency_outcomes(t.hits, t.facts))
query("e28_outcomes_by_airline", OUT + """
select airline, code, outcome, count(*) as flights from o group by 1, 2, 3""")(
    lambda t: st.emergency_outcomes(t.hits, t.facts).groupBy("airline", "code", "outcome").agg(F.count("*").alias("flights")))

query("e29_airline_emergencies", """
select airline, count(squawk_codes) as emergency_count, count(*) as total_flights, round(100.0*count(squawk_codes)/count(*),2) as emergency_rate
from flight_facts group by 1 having count(squawk_codes) > 0 order by 2 desc, 1 limit 10""")(lambda t: st.airline_emergencies(t.facts))
MILQ = f"select military_type, country, count(*) as flights from flight_facts where {MIL} group by 1, 2"
query("e30_military_totals", MILQ)(lambda t: st.military_totals(t.facts))
query("e58_tagged_military", f"""
select military_type, country, count(*) as flights from flight_facts join feedback using (flight_id) where {MIL} and user_label = 1 group by 1, 2""")(
    lambda t: st.military_totals(t.facts.join(t.feedback.where("user_label = 1").select("flight_id"), "flight_id", "left_semi")))

query("e31_near_miss_by_country", """
with f as (select distinct flight_id from rule_hits where rule_id = 4)
select trim(c) as country, count(*) as flights from (select unnest(string_split(crossed_borders, ',')) as c from f join flight_facts using (flight_id)) group by 1""")(
    lambda t: st.near_miss_by_country(t.hits, t.facts))

query("e32_airline_scorecard", """
with f as (select upper(substr(callsign,1,3)) as airline, count(*) as total_flights from flight_metadata group by 1),
 e as (select upper(substr(callsign,1,3)) as airline, count(*) filter (where rule_id=1) as emergencies, count(*) filter (where rule_id=4) as near_miss,
  count(*) filter (where rule_id=6) as go_arounds, count(*) filter (where rule_id=8) as diversions
  from (select distinct flight_id, rule_id from rule_hits) join flight_metadata using (flight_id) group by 1),
 s as (select f.airline, total_flights, coalesce(emergencies,0) as emergencies, coalesce(near_miss,0) as near_miss, coalesce(go_arounds,0) as go_arounds, coalesce(diversions,0) as diversions
  from f left join e on e.airline = f.airline where total_flights >= 10),
 c as (select *, cast(greatest(0, 100 - least(40, floor(emergencies/total_flights*1000*20)) - least(30, floor(near_miss/total_flights*1000*15))
  - least(20, floor(go_arounds/total_flights*1000*5)) - least(10, floor(diversions/total_flights*1000*2))) as int) as safety_score from s)
select *, case when safety_score >= 90 then 'A' when safety_score >= 80 then 'B' when safety_score >= 70 then 'C' when safety_score >= 60 then 'D' else 'F' end as safety_grade,
 case when total_flights >= 500 then 'high' when total_flights >= 100 then 'medium' when total_flights >= 50 then 'low' else 'very_low' end as confidence from c""")(
    lambda t: st.airline_scorecard(t.meta, t.hits))

query("e33_year_month_comparison", f"""
with m as (select cast(substr({sql_date('(first_seen_ts + n*400000)')},1,4) as int) as year, cast(substr({sql_date('(first_seen_ts + n*400000)')},6,2) as int) as month, count(*) as flights,
  sum(is_anomaly)::bigint as anomalies, count(*) filter (where {MIL}) as military_flights from flight_facts group by 1, 2),
 p as (select *, coalesce(lag(flights) over (partition by month order by year),0) as previous from m)
select *, case when previous > 0 then round((flights-previous)/previous*100,1) else 0.0 end as change_percent from p""")(
    # Spread first sights over several years, so that a year before exists.
    lambda t: st.year_month_comparison(t.facts.withColumn("first_seen_ts", F.col("first_seen_ts") + F.col("n") * 400000)))

HOURLY = f"""
with sp as (select hour::int as hour from range(24) r(hour)), tr as (select {sql_hour()} as hour, count(distinct flight_id) as n from tracks group by 1),
 sa as (select {sql_hour()} as hour, count(distinct flight_id) as n from rule_hits where rule_id in (1,4,6) group by 1),
 j as (select sp.hour, coalesce(tr.n,0) as traffic_count, coalesce(sa.n,0) as safety_count from sp left join tr on tr.hour = sp.hour left join sa on sa.hour = sp.hour),
 k as (select *, case when traffic_count > 0 then round(safety_count/traffic_count*1000,2) else 0.0 end as safety_per_1000 from j)
"""
query("e34_traffic_safety_by_hour", HOURLY + "select *, row_number() over (order by safety_per_1000 desc, hour) as risk_rank from k")(
    lambda t: st.traffic_safety_by_hour(t.tracks, t.hits))
query("e34_traffic_safety_correlation", HOURLY + "select round(coalesce(corr(traffic_count, safety_count),0),3) as correlation from k")(
    lambda t: st.hourly_correlation(st.traffic_safety_by_hour(t.tracks, t.hits)))
query("e36_pearson_or_zero", HOURLY + "select 0.0 as correlation from k limit 1")(
    # A constant series has no spread: the result is zero, not null.
    lambda t: st.hourly_correlation(st.traffic_safety_by_hour(t.tracks, t.hits).withColumn("flat", F.lit(1)), "flat"))

query("e35_peak_hours", f"""
with f as (select flight_id, min(ts) as ts from tracks group by 1)
select {sql_hour()} as hour, count(*) as flights, count(*) filter (where is_anomaly = 1) as anomalies, round(count(*)/30.0,2) as avg_per_day,
 round(100.0*count(*) filter (where is_anomaly = 1)/count(*),2) as anomaly_rate from (select f.flight_id, f.ts, r.is_anomaly from f left join reports r on r.flight_id = f.flight_id) group by 1""")(
    lambda t: st.peak_hours(t.tracks, t.reports, 30.0))

SHIFT = "(first_seen_ts + (n % 20) * (n % 3) * 86400)"
DAILY = f"""
with d as (select {sql_date(SHIFT)} as date, min({sql_dow(SHIFT)}) as dow, count(*) as flights, sum(is_anomaly)::bigint as anomalies from flight_facts group by 1)
"""


def _shifted(t):
    # Spread first sights over several months, so that weekdays repeat.
    n = F.col("n")
    return t.facts.withColumn("first_seen_ts", F.col("first_seen_ts") + (n % 20) * (n % 3) * 86400)


query("e37_weekday_profile", DAILY + "select dow, round(avg(flights),1) as avg_traffic, round(avg(anomalies),1) as avg_anomalies from d group by 1")(
    lambda t: st.weekday_profile(_shifted(t)))
query("e37_low_traffic_days", DAILY + """, m as (select *, round(avg(flights) over (partition by dow),1) as m from d)
select date, flights, round((flights-m)/m*100,1) as traffic_change_percent, case when substr(date,6,2) in ('09','10') then 'Possible Yom Kippur' when substr(date,6) = '12-25' then 'Possible Christmas'
 when substr(date,6) = '01-01' then 'Possible New Year' when substr(date,6,2) = '03' then 'Possible Purim' when substr(date,6,2) = '04' then 'Possible Passover' else 'Unusual low traffic' end as event_name
from m where m > 0 and flights < m*0.5""")(lambda t: st.low_traffic_days(st._daily(_shifted(t))))

query("e38_weather_monthly", f"""
select {sql_month()} as month, count(distinct flight_id) filter (where rule_id=8) as diversion_count, count(distinct flight_id) filter (where rule_id=6) as go_around_count,
 count(distinct flight_id) filter (where rule_id=11) as deviation_count from rule_hits where rule_id in (6,8,11) group by 1""")(lambda t: st.weather_monthly(t.hits))
WX = f"""
with f as (select flight_id, bool_or(rule_id=8) as d, bool_or(rule_id=6) as g from rule_hits where rule_id in (6,8) group by 1),
 j as (select destination_airport as airport, {sql_hour('first_seen_ts')} as hour, count(*) filter (where d) as d, count(*) filter (where g) as g
  from f join flight_metadata using (flight_id) where destination_airport is not null group by 1, 2)
select airport, sum(d)::bigint as diversions, sum(g)::bigint as go_arounds, max_by(hour, (g, -hour)) as peak_hour from j"""
query("e38_weather_by_airport", WX + " group by 1")(lambda t: st.weather_by_airport(t.hits, t.meta))
query("e39_weather_one_airport", WX + " where airport = 'LTFM' group by 1")(
    lambda t: st.weather_by_airport(t.hits, t.meta.where("destination_airport = 'LTFM'")))

query("e41_jamming_by_time", f"""
with r as (select flight_id, max(ts) as ts from extra_hits where rule_id in (9,10) group by 1),
 k as (select 'hour' as kind, {sql_hour()} as slot, count(*) as count from r group by 2 union all select 'weekday', {sql_dow()}, count(*) from r group by 2)
select *, row_number() over (partition by kind order by count desc, slot) as rank from k""")(lambda t: st.jamming_by_time(t.extra))

query("e42_incident_days", f"""
with d as (select {sql_date()} as date, count(*) filter (where rule_id=1) as emergency_count, count(*) filter (where rule_id=4) as near_miss_count, count(*) filter (where rule_id=6) as go_around_count,
  count(*) filter (where rule_id=8) as diversion_count, count(*) as total_incidents, round(sqrt(pow(max(lat)-min(lat),2)+pow(max(lon)-min(lon),2)),2) as geographic_spread_deg
  from rule_hits where rule_id in (1,4,6,8) group by 1)
select *, geographic_spread_deg < 2.0 as geographically_clustered from d where total_incidents >= 3""")(lambda t: st.incident_days(t.hits))

query("e43_emergency_days", f"""
with e as (select {sql_date()} as date, flight_id, ts, lat, lon from rule_hits where rule_id = 1)
select date, count(*) as count, exists (select 1 from e a join e b on a.date = b.date and (a.flight_id, a.ts) < (b.flight_id, b.ts) and abs(a.lat-b.lat) < 0.8 and abs(a.lon-b.lon) < 0.8 where a.date = e.date) as cluster_detected
from e group by 1 having count(*) >= 2""")(lambda t: st.emergency_days(t.hits))
query("e43_emergency_cells", f"""
select round_even(lat,0) as lat, round_even(lon,0) as lon, count(*) as count, count(distinct {sql_date()}) as unique_days from rule_hits where rule_id = 1 group by 1, 2 having count(*) >= 2""")(
    lambda t: st.emergency_cells(t.hits))

query("e44_monthly_trend", f"""
with h as (select {sql_month()} as month, {sql_hour()} as hour, count(*) as points from tracks group by 1, 2)
select month, (select count(distinct flight_id) from tracks where {sql_month()} = h.month) as flights, max_by(hour, (points, -hour)) as busiest_hour, sum(points)::bigint as points from h group by 1""")(
    lambda t: st.monthly_trend(t.tracks))

query("e45_holding_by_airline", """
with h as (select flight_id, sum(duration_s) as s, count(*) as n from extra_hits where rule_id = 3 group by 1)
select airline, count(*) as flights, round(avg(flight_duration_sec)/60,2) as avg_flight_min, round(coalesce(sum(s)/sum(n),0)/60,2) as avg_holding_min
from flight_metadata m left join h on h.flight_id = m.flight_id group by 1 order by 2 desc, 1 limit 10""")(lambda t: st.holding_by_airline(t.extra, t.meta))
query("e46_flight_time_by_airline", """
with p as (select flight_id, min(callsign) as cs, max(ts)-min(ts) as sec from tracks group by 1)
select substr(cs,1,3) as airline, count(*) as flights, round(avg(sec)/60,2) as avg_flight_min from p where sec > 0 group by 1""")(lambda t: st.flight_time_by_airline(t.tracks))
HOLDS = """
with h as (select flight_id, max_by((duration_s, ts, lat, lon), (duration_s, ts)) as e from extra_hits where rule_id = 3 and duration_s > 60 and duration_s <= 3600 group by flight_id, floor(ts/60)),
 k as (select flight_id, e[1] as duration_s, e[2] as ts, e[3] as lat, e[4] as lon from h)
""".replace("max_by((duration_s, ts, lat, lon), (duration_s, ts))", "max(row(duration_s, ts, lat, lon))").replace("e[1]", "struct_extract_at(e,1)").replace("e[2]", "struct_extract_at(e,2)").replace("e[3]", "struct_extract_at(e,3)").replace("e[4]", "struct_extract_at(e,4)")
query("e47_holding_hours", HOLDS + f"""select {sql_hour()} as hour, count(*) as events, round(sum(duration_s)/60*50,1) as cost_usd from k group by 1""")(
    lambda t: st.holding_minutes(t.extra).groupBy(keys.hour_of().alias("hour")).agg(
        F.count("*").alias("events"), F.round(F.sum("duration_s") / 60 * 50, 1).alias("cost_usd")))
query("e47_holding_cost_by_airport", HOLDS + f""", d as (select k.flight_id, k.ts, k.duration_s, min_by(code, ({sql_hav('k.lat', 'k.lon', 'a.lat', 'a.lon')}, ord)) as code, min({sql_hav('k.lat', 'k.lon', 'a.lat', 'a.lon')}) as nm
 from k, airports a group by 1, 2, 3)
select case when nm < 100 then code else 'OTHER' end as airport, count(*) as events, count(distinct flight_id) as flights, round(sum(duration_s)/60,2) as minutes, round(round(sum(duration_s)/60,2)*50,1) as cost_usd from d group by 1""")(
    lambda t: st.holding_cost(st.holding_minutes(t.extra), t.airports))
query("e48_holding_cost_by_destination", """
select coalesce(destination_airport,'UNKNOWN') as destination, count(*) as events, round(sum(duration_s)/60,2) as minutes from extra_hits join flight_metadata using (flight_id) where rule_id = 3 group by 1""")(
    # The phase summary arrives as JSON text and is read with a declared schema.
    lambda t: t.extra.where("rule_id = 3").select("flight_id", F.to_json(F.struct(F.struct(F.col("duration_s").alias("holding_s")).alias("phase_summary"))).alias("doc"))
    .withColumn("p", F.from_json("doc", "phase_summary struct<holding_s:double>"))
    .join(t.meta.select("flight_id", F.coalesce("destination_airport", F.lit("UNKNOWN")).alias("destination")), "flight_id")
    .groupBy("destination").agg(F.count("*").alias("events"), F.round(F.sum("p.phase_summary.holding_s") / 60, 2).alias("minutes")))

ALT = """
select destination_airport as planned, airport as actual, count(*) as diversions, string_agg(distinct aircraft_type, ',' order by aircraft_type) as types,
 count(*) filter (where aircraft_type = 'A333') as wide_body, count(*) filter (where aircraft_type = 'B738') as narrow_body
from rule_hits join flight_metadata using (flight_id) where rule_id = 8 and airport <> destination_airport {w} group by 1, 2"""
query("e49_alternates_for_airport", ALT.replace("{w}", "and destination_airport = 'LTFM'"))(
    lambda t: st.alternates(t.hits, t.meta.where("destination_airport = 'LTFM'")))
query("e50_alternates_in_period", ALT.replace("{w}", ""))(lambda t: st.alternates(st.between(t.hits, "ts", T0, T1), t.meta))
query("e51_alternate_preferences", """
with d as (select origin_airport, airport as alternate, count(*) as n from rule_hits join flight_metadata using (flight_id) where rule_id = 8 group by 1, 2)
select * from (select *, row_number() over (partition by origin_airport order by n desc, alternate) as rank from d) where rank <= 5""")(
    lambda t: st.alternate_preferences(t.hits, t.meta))
query("e51_alternate_by_type", """
with d as (select aircraft_type, airport as alternate, count(*) as n from rule_hits join flight_metadata using (flight_id) where rule_id = 8 group by 1, 2)
select aircraft_type, min_by(alternate, (-n, alternate)) as preferred from d group by 1""")(lambda t: st.alternate_by_type(t.hits, t.meta))

SPLIT = T0 + 3600
CHANGES = f"""
with n as (select airline, count(*) filter (where first_seen_ts < {SPLIT}) as before, count(*) filter (where first_seen_ts >= {SPLIT}) as after from flight_metadata group by 1)
select *, case when before > 0 then round((after-before)/before*100,1) end as change_percent,
 case when before = 0 then 'started' when after = 0 then 'stopped' when abs(round((after-before)/before*100,1)) >= 50 then 'changed' else 'stable' end as status from n"""
query("e52_airline_changes", CHANGES)(lambda t: st.airline_changes(t.meta, SPLIT))

query("e53_tagged_overview", f"""
with r as (select flight_id, list(distinct rule_id) as ids from rule_hits group by 1),
 j as (select f.*, r.ids, p.severity_cnn from feedback f left join r on r.flight_id = f.flight_id left join reports p on p.flight_id = f.flight_id),
 a as (select count(*) filter (where user_label = 1) as total_anomalies, {', '.join(f"count(*) filter (where rule_id = {k} or coalesce(list_contains(ids,{k}),false)) as {n}" for k, n in ((4, 'holding_patterns'), (3, 'near_miss'), (5, 'go_arounds'), (6, 'return_to_field')))},
  round(coalesce(avg(severity_cnn),0),2) as avg_severity from j),
 b as (select count(*) as total_flights, count(*) filter (where {MIL}) as military_flights, count(squawk_codes) as emergency_codes from flight_facts)
select a.*, b.*, emergency_codes + near_miss + go_arounds as safety_events from a, b""")(
    lambda t: st.tagged_overview(t.facts, t.feedback, t.hits.groupBy("flight_id").agg(F.collect_set("rule_id").alias("rule_ids")), t.reports))

TAG = "(select m.* from flight_metadata m join feedback f on f.flight_id = m.flight_id where user_label = 1)"


def _tagged(t):
    return t.meta.join(t.feedback.where("user_label = 1").select("flight_id"), "flight_id", "left_semi")


query("e54_tagged_flights_per_day", f"""
select {sql_date('first_seen_ts')} as date, count(*) as count, count(*) filter (where {MIL}) as military_count, count(*) filter (where not {MIL}) as civilian_count from {TAG} group by 1""")(
    lambda t: st.flights_per_day(_tagged(t), T0, T1))
query("e55_tagged_busiest_airports", BUSY.replace("{src}", TAG))(lambda t: st.busiest_airports(_tagged(t)))

RULE_NAMES = {1: ("Emergency Squawks", "safety"), 4: ("Dangerous Proximity", "safety"), 6: ("Go Around", "operations"),
              8: ("Diversion", "operations"), 11: ("Off Course", "navigation")}
NAMES_SQL = "(values " + ",".join(f"({k},'{n}','{c}')" for k, (n, c) in RULE_NAMES.items()) + ") v(rule_id, rule_name, category)"
@query("e56_tagged_events_by_rule", f"""
select v.rule_id::int as rule_id, rule_name, category, count(*) as count from (select distinct flight_id, rule_id from rule_hits) h join {NAMES_SQL} on v.rule_id = h.rule_id group by 1, 2, 3""")
def _e56(t):
    ids = F.array_sort(F.collect_set("rule_id"))
    name = lambda i: F.create_map(*[F.lit(x) for k, v in RULE_NAMES.items() for x in (k, v[i])])
    lists = t.hits.groupBy("flight_id").agg(ids.alias("r")).select(
        F.array_join(F.col("r").cast("array<string>"), ", ").alias("ids"),
        F.array_join(F.transform("r", lambda x: name(0)[x]), ", ").alias("names"),
        F.array_join(F.transform("r", lambda x: name(1)[x]), ", ").alias("categories"))
    return st.events_by_rule(lists)


query("e57_tagged_emergencies", f"""
select code, airline, count(distinct flight_id) as flights from (select flight_id, airline, unnest(string_split(regexp_replace(squawk_codes, '[^0-9,]', '', 'g'), ',')) as code from flight_facts where squawk_codes is not null and {TAGGED})
where code in ('7500','7600','7700') group by 1, 2""")(lambda t: st.tagged_emergencies(_confirmed(t, t.facts)))
query("e59_tagged_signal_loss", f"""
select sum(signal_loss_events)::bigint as total_events, count(*) filter (where signal_loss_events > 0) as affected_flights,
 round(avg(case when signal_loss_events > 0 then signal_loss_events end),2) as avg_events_per_flight from flight_facts where {TAGGED}""")(lambda t: st.tagged_signal_loss(_confirmed(t, t.facts)))
query("e60_severity_histogram", """
with r as (select case when severity_cnn >= 0.8 then 'critical' when severity_cnn >= 0.6 then 'high' when severity_cnn >= 0.4 then 'medium' when severity_cnn >= 0.2 then 'low' else 'minimal' end as s, * from reports)
select v.s as severity_range, count(r.flight_id) as count, round(avg(severity_cnn),3) as avg_cnn, round(max(severity_dense),3) as max_dense
from (values ('minimal'),('low'),('medium'),('high'),('critical')) v(s) left join r on r.s = v.s group by 1""")(lambda t: st.severity_histogram(t.reports))
query("e63_tagged_returns", """
select f.flight_id, coalesce(callsign,'UNKNOWN') as callsign, f.first_seen_ts as tag_ts, round(flight_duration_sec/60,1) as duration_min, coalesce(origin_airport,'UNKNOWN') as airport, round(total_distance_nm,1) as max_outbound_nm
from feedback f left join flight_facts m on m.flight_id = f.flight_id where rule_id = 6 and user_label = 1 order by tag_ts desc, f.flight_id limit 50""")(
    lambda t: st.tagged_returns(t.feedback, t.facts))
