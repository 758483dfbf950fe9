"""Working tables derived by Spark from the given parquet tables.

``TABLES`` holds each table as one SQL text that Spark and DuckDB both run.
``Tables`` is what operators receive: lazily built DataFrames over one data folder.
The track table is built with the sliced row counter instead of one window per
user, so a user who owns a third of all events is still spread over many tasks.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators.windows import cut, sliced_row_number

BASE = ("region nation customer supplier part orders lineitem events documents "
        "embeddings pages benchmark labels conversations").split()

# HotSpot never compiles methods above 8000 bytes of code. Stages with a longer one are to run as single operators, whose code is cut
# into short methods; geometry over many columns is several times faster that way.
METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"

TABLES: dict[str, str] = {
    "tracks": """
select 'U' || cast(user_id as string) as flight_id,
       cast(1704067200 + (user_id % 10) * 600 + rn * 20
            + case when event_id % 41 = 0 then 15 else 0 end
            + case when rn > 30 then 400 else 0 end as bigint) as ts,
       cast(29.0 + (user_id % 10) * 0.2 + ((user_id * 28) % 31) * 0.04 + rn * 0.02
            + case when event_id % 97 = 0 then 0.6 else 0.0 end as double) as lat,
       cast(33.0 + (user_id % 10) * 0.2 + rn * 0.01 as double) as lon,
       cast(case when rn <= 12 then rn * 900
                 else 11000 + (event_id % 7) * 100
                      + case when event_id % 53 = 0 then 9000 else 0 end end as double) as alt,
       cast(180 + event_id % 300 as double) as gspeed,
       cast(case when rn <= 12 then 1800 else (event_id % 11) * 100 - 500 end as double) as vspeed,
       cast((user_id * 11 + rn * 3) % 360 as double) as track,
       case when event_type = 'error' and event_id % 29 = 0 then '7700' else '2000' end as squawk,
       case user_id % 6 when 0 then 'ELY' when 1 then 'THY' when 2 then 'RCH'
            when 3 then 'WZZ' when 4 then 'RJA' else 'QTR' end || cast(100 + user_id as string) as callsign,
       case when event_id % 17 = 0 then 'MLAT' else 'ADSB' end as source
from numbered_events""",
    "flight_metadata": """
select flight_id, min(callsign) as callsign, substr(min(callsign), 1, 3) as airline,
       case cast(substr(flight_id, 2) as bigint) % 4 when 0 then 'LLBG' when 1 then 'LCLK'
            when 2 then 'OJAI' else 'HECA' end as origin_airport,
       case cast(substr(flight_id, 2) as bigint) % 5 when 0 then 'LLBG' when 1 then 'LTFM'
            when 2 then 'LGAV' when 3 then 'LCLK' else null end as destination_airport,
       case cast(substr(flight_id, 2) as bigint) % 3 when 0 then 'B738' when 1 then 'A333'
            else 'C17' end as aircraft_type,
       case when substr(min(callsign), 1, 3) = 'RCH' then 'Military_and_government'
            else 'Passenger' end as category,
       substr(min(callsign), 1, 3) = 'RCH' as is_military,
       min(ts) as first_seen_ts, max(ts) as last_seen_ts,
       max(ts) - min(ts) as flight_duration_sec, count(*) as total_points
from tracks group by flight_id""",
    "rule_hits": """
select 'U' || cast(user_id as string) as flight_id,
       cast(1704067200 + event_id * 300 as bigint) as ts,
       cast(case event_type when 'error' then 1 when 'click' then 4 when 'view' then 6
            when 'signup' then 8 else 11 end as int) as rule_id,
       cast((event_id % 40) * 0.1 as double) as distance_nm,
       cast((event_id * 37) % 1200 as double) as altitude_diff_ft,
       cast(45 + event_id % 400 as double) as duration_s,
       cast(29.0 + (event_id % 50) * 0.1 as double) as lat,
       cast(33.0 + (event_id % 40) * 0.1 as double) as lon,
       case event_id % 4 when 0 then 'LLBG' when 1 then 'LCLK' when 2 then 'OJAI' else 'HECA' end as airport
from events where event_id % 3 = 0""",
    "airports": """
select cast(ord as int) as ord, code, cast(lat as double) as lat, cast(lon as double) as lon,
       cast(elevation_ft as int) as elevation_ft
from (values (1, 'LLBG', 32.011389, 34.886667, 135), (2, 'LLER', 29.723704, 35.01145, 648),
             (3, 'LLHA', 32.809444, 35.043056, 28), (4, 'LCLK', 34.8751, 33.6249, 8),
             (5, 'OLBA', 33.820889, 35.488389, 89), (6, 'OJAI', 31.722556, 35.993214, 2395),
             (7, 'HECA', 30.1219, 31.4056, 382), (8, 'LTFM', 41.2753, 28.7519, 163),
             (9, 'LGAV', 37.9364, 23.9445, 308)) as t(ord, code, lat, lon, elevation_ft)""",
    "vessel_positions": """
select cast(200000000 + l_suppkey as string) as mmsi, l_shipdate as ts,
       cast(30.0 + (l_orderkey % 500) * 0.01 as double) as latitude,
       cast(31.0 + (l_partkey % 500) * 0.01 as double) as longitude,
       cast(l_quantity * 0.5 as double) as speed_over_ground,
       case l_linenumber % 3 when 0 then 'Moored' when 1 then 'Under way' else 'At anchor' end as navigation_status
from lineitem""",
    "vessel_metadata": """
select cast(200000000 + s_suppkey as string) as mmsi, s_name as vessel_name,
       case s_suppkey % 4 when 0 then 'Cargo' when 1 then 'Tanker' when 2 then 'Passenger'
            else 'Fishing' end as vessel_type_description
from supplier""",
    # One report per flight: which rules fired, a severity per model layer, the worst hit first.
    "reports": """
select flight_id, max(ts) as ts,
       max(case when rule_id = 1 then 1 else 0 end) as has_1,
       max(case when rule_id = 4 then 1 else 0 end) as has_4,
       max(case when rule_id = 6 then 1 else 0 end) as has_6,
       max(case when rule_id = 8 then 1 else 0 end) as has_8,
       max(case when rule_id = 11 then 1 else 0 end) as has_11,
       cast(case when max(altitude_diff_ft) >= 600 then 1 else 0 end as int) as is_anomaly,
       cast(max(distance_nm) / 4.0 as double) as severity_cnn,
       cast(avg(duration_s) / 450.0 as double) as severity_dense,
       count(*) as n_events
from rule_hits group by flight_id""",
    # Hits of the rules that rule_hits leaves out: turns, returns, low flight, signal loss, landings.
    "extra_hits": """
select 'U' || cast(user_id as string) as flight_id,
       cast(1704067200 + event_id * 300 as bigint) as ts,
       cast(case event_type when 'error' then 3 when 'click' then 7 when 'view' then 10
            when 'signup' then 9 else 12 end as int) as rule_id,
       cast(200 + event_id % 250 as double) as turn_deg,
       cast(30 + (event_id * 7) % 4000 as double) as duration_s,
       cast((event_id % 60) * 0.9 as double) as outbound_nm,
       cast(29.0 + (event_id % 50) * 0.1 as double) as lat,
       cast(33.0 + (event_id % 40) * 0.1 as double) as lon,
       case event_id % 4 when 0 then 'LLBG' when 1 then 'LCLK' when 2 then 'OJAI' else 'HECA' end as airport
from events where event_id % 3 = 1""",
    # Metadata with the remaining per-flight attributes.
    "flight_facts": """
select m.*, cast(substr(flight_id, 2) as bigint) as n,
       cast(case when cast(substr(flight_id, 2) as bigint) % 3 = 0 then 1 else 0 end as int) as is_anomaly,
       case when cast(substr(flight_id, 2) as bigint) % 7 = 0 then '["7700","2000"]'
            when cast(substr(flight_id, 2) as bigint) % 11 = 0 then '7600, 2000' else null end as squawk_codes,
       case cast(substr(flight_id, 2) as bigint) % 5 when 0 then 'IL,JO' when 1 then 'CY' when 2 then 'EG, IL'
            when 3 then 'LB,SY,JO' else null end as crossed_borders,
       cast(cast(substr(flight_id, 2) as bigint) % 4 as int) as signal_loss_events,
       cast(cast(substr(flight_id, 2) as bigint) % 900 as double) as total_distance_nm,
       cast(200 + cast(substr(flight_id, 2) as bigint) % 200 as double) as avg_speed_kts,
       case cast(substr(flight_id, 2) as bigint) % 4 when 0 then 'tanker' when 1 then 'ISR'
            when 2 then 'transport' else 'fighter' end as military_type,
       case cast(substr(flight_id, 2) as bigint) % 3 when 0 then 'US' when 1 then 'GB' else 'RU' end as country,
       cast(28.5 + (cast(substr(flight_id, 2) as bigint) % 60) * 0.1 as double) as dest_lat,
       cast(32.5 + (cast(substr(flight_id, 2) as bigint) % 70) * 0.2 as double) as dest_lon
from flight_metadata m""",
    # Reviewer feedback: one tag per flight.
    "feedback": """
select flight_id, first_seen_ts, cast(1 + cast(substr(flight_id, 2) as bigint) % 6 as int) as rule_id,
       cast(case when cast(substr(flight_id, 2) as bigint) % 5 = 0 then 0 else 1 end as int) as user_label
from flight_metadata""",
}


class Tables:
    """Input frames over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")
        if spark.conf.get(METHOD_LIMIT) == "65535":         # Spark's default: a session's own value stays
            spark.conf.set(METHOD_LIMIT, "8000")
        self._kept: dict[str, DataFrame] = {}

    def kept(self, name: str, build) -> DataFrame:
        """A derived frame that several branches read: built once, lineage cut by a checkpoint."""
        if name not in self._kept:
            self._kept[name] = cut(build())
        return self._kept[name]

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _sql(self, name: str, **inputs: DataFrame) -> DataFrame:
        text = TABLES[name]
        for view in inputs:
            text = text.replace(f"from {view}", f"from {{{view}}}")
        return self.spark.sql(text, **inputs)

    @cached_property
    def events(self) -> DataFrame:
        return self.base("events")

    @cached_property
    def tracks(self) -> DataFrame:
        ev = self.events.select("user_id", "event_id", "event_type", "ts")
        # Event time only orders and slices here, so the zone it is read in does not matter.
        numbered = sliced_row_number(
            ev.withColumn("_h", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600)),
            "user_id", "_h", ["ts", "event_id"], "rn")
        return self._sql("tracks", numbered_events=numbered)

    @cached_property
    def meta(self) -> DataFrame:
        return self._sql("flight_metadata", tracks=self.tracks)

    @cached_property
    def hits(self) -> DataFrame:
        return self._sql("rule_hits", events=self.events)

    @cached_property
    def airports(self) -> DataFrame:
        return self._sql("airports")

    @cached_property
    def reports(self) -> DataFrame:
        return self._sql("reports", rule_hits=self.hits)

    @cached_property
    def extra(self) -> DataFrame:
        return self._sql("extra_hits", events=self.events)

    @cached_property
    def facts(self) -> DataFrame:
        return self._sql("flight_facts", flight_metadata=self.meta)

    @cached_property
    def feedback(self) -> DataFrame:
        return self._sql("feedback", flight_metadata=self.meta)

    @cached_property
    def vessels(self) -> DataFrame:
        return self._sql("vessel_positions", lineitem=self.base("lineitem"))

    @cached_property
    def vessel_meta(self) -> DataFrame:
        return self._sql("vessel_metadata", supplier=self.base("supplier"))
