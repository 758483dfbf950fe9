"""Streaming jobs over the given tables, drained with the available-now trigger."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.operators import forecast as fc, marine as ma
from wayfold.plans.core_queries import T0
from wayfold.plans.intel_queries import TESTED, VL
from wayfold.plans.registry import query, sql_hav
from wayfold.sources import sinks
from wayfold.streaming import jobs as sj, ordered as od

c = F.col


DAY = 86_400


def _tracks(t, cols=("flight_id", "ts", "lat", "lon", "alt"), closing_s=None):
    path, schema = sj.as_files(t.tracks.select(*cols), closing_s=closing_s)
    return lambda: sj.stream_of(t.spark, path, schema)


def _f01(t):
    """Vessel messages as JSON lines in the order of their time, each of them twice, parsed, written once per (vessel, time, place)."""
    v = t.vessels.withColumn("_twice", F.explode(F.array(F.lit(1), F.lit(2))))
    path, schema = sj.as_files(v.select("ts", F.to_json(F.struct(*t.vessels.columns)).alias("value")))
    table = f"{sj.scratch(t.spark)}/table"
    sj.ingest(ma.parse_messages(sj.stream_of(t.spark, path, schema)), table, ["mmsi", "ts", "latitude", "longitude"])
    return t.spark.read.parquet(f"{table}/data").groupBy("mmsi").agg(F.count("*").alias("positions"))


query("f01_ingest_positions", "select mmsi, count(distinct (ts, latitude, longitude)) as positions from vessel_positions group by 1")(_f01)
query("f02_active_flights", f"select flight_id, count(*) as points, max(ts) as ts, max_by(lat, ts) as lat, max_by(lon, ts) as lon, max_by(alt, ts) as alt from tracks group by 1 having max(ts) >= {T0 + 6000}")(
    lambda t: sj.active_table(sj.drain(sj.active_flights(_tracks(t)()), "update"), T0 + 6000))


def _a18(t):
    """Every vessel's static data twice, an older version and its own, among all position messages."""
    v = t.vessel_meta
    kind = F.when(c("vessel_type_description") == "Cargo", 70).when(c("vessel_type_description") == "Tanker", 80).when(c("vessel_type_description") == "Passenger", 60).otherwise(30)
    static = lambda name, code, at: v.select(at.cast("bigint").alias("received"), F.to_json(F.struct(
        F.lit("ShipStaticData").alias("MessageType"), F.struct(c("mmsi").alias("MMSI")).alias("MetaData"),
        F.struct(F.struct(name.alias("Name"), code.alias("Type"), F.struct(F.lit(20).alias("A"), F.lit(5).alias("B"), F.lit(3).alias("C"), F.lit(4).alias("D")).alias("Dimension"))
                 .alias("ShipStaticData")).alias("Message"))).alias("value"))
    pos = t.vessels.select(F.unix_timestamp(c("ts").cast("timestamp")).alias("received"), F.to_json(F.struct(
        F.lit("PositionReport").alias("MessageType"), F.struct(c("mmsi").alias("MMSI")).alias("MetaData"),
        F.struct(F.struct(c("latitude").alias("Latitude"), c("longitude").alias("Longitude"), c("speed_over_ground").alias("Sog")).alias("PositionReport")).alias("Message"))).alias("value"))
    # Half of the vessels send their own data first and the older version, with its earlier time, later in the stream.
    late = F.pmod(F.xxhash64("mmsi"), F.lit(2)) * 400_000_000
    sent = static(F.lit("BEFORE"), F.lit(30), F.lit(700_000_000)).withColumn("seq", c("received"))
    own = static(c("vessel_name"), kind, F.lit(900_000_000))
    swap = v.select("mmsi", late.alias("late"))
    sent = sent.withColumn("mmsi", F.get_json_object("value", "$.MetaData.MMSI")).join(swap, "mmsi").withColumn("seq", c("seq") + c("late")).drop("mmsi", "late")
    every = sent.unionByName(own.withColumn("seq", c("received"))).unionByName(pos.withColumn("seq", c("received")))
    path, schema = sj.as_files(every, order="seq")
    root = sj.scratch(t.spark)
    sj.ingest_vessels(sj.stream_of(t.spark, path, schema), root)
    n = t.spark.read.parquet(f"{root}/positions").groupBy("mmsi").agg(F.count("*").alias("positions"))
    return (sinks.read_table(t.spark, f"{root}/register").join(n, "mmsi", "left")
            .select("mmsi", "vessel_name", "vessel_type_description", "length_m", "width_m", F.coalesce("positions", F.lit(0)).alias("positions")))


query("a18_vessel_register", """select m.mmsi, vessel_name, vessel_type_description, 25 as length_m, 7 as width_m, coalesce(n, 0) as positions
from vessel_metadata m left join (select mmsi, count(*) as n from vessel_positions group by 1) p on p.mmsi = m.mmsi""")(_a18)


def _f03(t):
    path, schema = sj.as_files(t.vessels.select("mmsi", "ts", "latitude", "longitude"))
    timed = sj.stream_of(t.spark, path, schema).withColumn("at", c("ts").cast("timestamp"))
    return sj.vessel_table(sj.drain(sj.latest_vessels(timed), "update")).select("mmsi", "latitude", "longitude")


query("f03_latest_vessels", VL + " select mmsi, latitude, longitude from l")(_f03)


def _f04(t):
    """Tests against history for every point, then the monitor state machine over their stream."""
    q = t.tracks.select(F.concat_ws(":", "flight_id", c("ts").cast("string")).alias("qid"), "flight_id", "ts", "alt", "lat", "lon", "gspeed", "vspeed")
    tests = fc.history_test(q.drop("ts", "alt"), t.tracks).join(q.select("qid", "ts", "alt"), "qid")
    tests = tests.select("flight_id", "ts", "alt", "tracks", *[F.coalesce(x, F.lit(False)).alias(x) for x in ("gspeed_warning", "vspeed_warning")])
    path, schema = sj.as_files(tests, closing_s=DAY)
    return sj.drain(od.monitor(sj.stream_of(t.spark, path, schema)))


query("f04_flight_monitor", TESTED + """, u as (select t.flight_id, t.ts, alt, tracks, coalesce(gspeed_warning, false) as g, coalesce(vspeed_warning, false) as v
   from tested t join tracks p on p.flight_id = t.flight_id and p.ts = t.ts where alt >= 1000),
 a as (select flight_id, ts, count(*) over w as n, count(*) filter (where g) over w as ng, count(*) filter (where v) over w as nv, min(ts) over (partition by flight_id) as start from u where tracks >= 3
   window w as (partition by flight_id order by ts rows between 14 preceding and current row)),
 b as (select flight_id, ts, n = 15 and (ng >= 12 or nv >= 12) as alarm, n = 15 and (ng >= 12 or nv >= 12) and ts - start > 300 as warned from a),
 j as (select u.flight_id, u.ts, tracks, alarm, warned, coalesce(bool_or(warned) over (partition by u.flight_id order by u.ts rows between unbounded preceding and current row), false) as before from u left join b on b.flight_id = u.flight_id and b.ts = u.ts)
select flight_id, ts, case when tracks < 3 then case when before then 'WARNING' else 'STANDBY' end when not alarm then 'NORMAL' when warned then 'WARNING' else 'STANDBY' end as state from j""")(_f04)


def _f05(t):
    path, schema = sj.as_files(t.reports)
    return sj.drain(sj.stream_of(t.spark, path, schema).where((c("is_anomaly") == 1) & (c("ts") > T0 + 86400))).select("flight_id", "ts", "n_events")


query("f05_anomalies_since", f"select flight_id, ts, n_events from reports where is_anomaly = 1 and ts > {T0 + 86400}")(_f05)


def _f06(t):
    root = sj.scratch(t.spark)
    sj.count_proximity(_tracks(t)(), root)
    return t.spark.read.parquet(f"{root}/pairs").groupBy("flight_id").agg(F.sum("pairs").alias("pairs"))


query("f06_live_proximity", "select a.flight_id, count(*) as pairs from tracks a join tracks b on b.ts between a.ts-5 and a.ts+5 and a.flight_id <> b.flight_id and b.lat between a.lat - 0.07 and a.lat + 0.07 where "
      + sql_hav("a.lat", "a.lon", "b.lat", "b.lon") + " <= 4 and abs(a.alt-b.alt) <= 999 group by 1")(_f06)


def _f07(t):
    """Counts per day, each written once its day is over."""
    # Seconds since the epoch from wall-clock fields, so that the session zone plays no part.
    at = F.timestamp_seconds(F.unix_timestamp(c("ts").cast("timestamp")))
    path, schema = sj.as_files(t.events.select("event_type", at.alias("at")), order="at", closing_s=4 * DAY)
    return sj.drain(sj.tumbling_counts(sj.stream_of(t.spark, path, schema))).select(
        F.substring(c("start").cast("string"), 1, 10).alias("date"), "event_type", "n")


query("f07_tumbling_counts", "select strftime(ts, '%Y-%m-%d') as date, event_type, count(*) as n from events group by 1, 2")(_f07)
query("f08_sessions", """
with g as (select flight_id, ts, case when ts - lag(ts) over (partition by flight_id order by ts) < 300 then 0 else 1 end as s from tracks), k as (select *, sum(s) over (partition by flight_id order by ts) as i from g)
select flight_id, min(ts) as first_ts, max(ts) as last_ts, count(*) as points from k group by flight_id, i""")(
    lambda t: sj.drain(sj.sessions(_tracks(t, ("flight_id", "ts"), 3 * DAY)())))
query("f09_heartbeat_expiry", f"select flight_id, max(ts) as last_ts, {T0 + 7200} - max(ts) > 900 as expired from tracks group by 1")(
    lambda t: sj.expiry(sj.drain(sj.heartbeats(_tracks(t, ("flight_id", "ts"))()), "update"), T0 + 7200))
query("f09_expired_events", "with g as (select flight_id, ts, lead(ts) over (partition by flight_id order by ts) as n from tracks) select flight_id, ts as last_ts, ts + 401 as expired_ts from g where n is null or n - ts > 400")(
    lambda t: sj.drain(od.expired(_tracks(t, ("flight_id", "ts"), DAY)(), silent_s=400)))


# -- sinks: written to a new folder and read back
def _a16(t):
    from wayfold.sources.sinks import copy_tables
    root = sj.scratch(t.spark)
    t.reports.write.parquet(f"{root}/old")
    copy_tables(t.spark, {"reports": f"{root}/old"}, f"{root}/new")
    return t.spark.read.parquet(f"{root}/new/reports").select("flight_id", "ts", "n_events")


query("a16_copied_table", "select flight_id, ts, n_events from reports")(_a16)


def _a14(t):
    from wayfold.sources.sinks import write_months
    path = sj.scratch(t.spark) + "/months"
    write_months(t.vessels, path)
    return t.spark.read.parquet(path).groupBy(c("year_month").cast("string").alias("year_month")).agg(F.count("*").alias("positions"))


query("a14_month_table", "select strftime(ts, '%Y-%m') as year_month, count(*) as positions from vessel_positions group by 1")(_a14)


def _a11(t):
    """Metadata table partitioned by origin, merged in place with updates of one kind of flight."""
    from wayfold.sources.sinks import merge_table
    path = sj.scratch(t.spark) + "/meta"
    cols = ["flight_id", "first_seen_ts", "last_seen_ts", "airline", "origin_airport"]
    merge_table(t.spark, path, t.meta.select(cols), ["flight_id", "first_seen_ts"], ["last_seen_ts"], "origin_airport")
    upd = t.meta.where("destination_airport is null").withColumn("last_seen_ts", c("last_seen_ts") + 9).select(cols)
    merge_table(t.spark, path, upd, ["flight_id", "first_seen_ts"], ["last_seen_ts"], "origin_airport")
    return t.spark.read.parquet(path).select("flight_id", "last_seen_ts", "origin_airport")


query("a11_merged_table", "select flight_id, last_seen_ts + case when destination_airport is null then 9 else 0 end as last_seen_ts, origin_airport from flight_metadata")(_a11)
