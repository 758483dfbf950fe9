"""Traffic and safety statistics over flight metadata, tracks and rule hits.

Every function takes frames and returns a frame. Counts of distinct flights are
grouped by (key, flight) on the map side first (Catalyst's two-step distinct), so a
hot key does not land in one task as raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions import keys

SAFETY = (1, 4, 6)


def military_flag() -> Column:
    return F.coalesce(F.col("is_military"), F.lit(False)) | (F.col("category") == "Military_and_government")


def in_rules(*ids: int) -> Column:
    return F.col("rule_id").isin(*ids)


def distinct_if(cond: Column, what="flight_id") -> Column:
    return F.count_distinct(F.when(cond, F.col(what)))


def spine(spark, lo: int, hi: int, name: str) -> DataFrame:
    """Rows lo..hi, so that empty buckets are present."""
    return spark.range(lo, hi + 1).select(F.col("id").cast("int").alias(name))


def on_spine(sp: DataFrame, df: DataFrame, key: str, zero: list[str]) -> DataFrame:
    """Left join a small aggregate to its spine, missing counts as zero."""
    return sp.join(df, key, "left").withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in zero})


def between(df: DataFrame, col: str, start: int, end: int) -> DataFrame:
    return df.where(F.col(col).between(start, end))


# -- overview
def distinct_flights(tracks: DataFrame, start: int, end: int, approximate: bool = False) -> DataFrame:
    n = F.approx_count_distinct("flight_id") if approximate else F.count_distinct("flight_id")
    return between(tracks, "ts", start, end).agg(n.alias("flights"))


def overview(tracks: DataFrame, hits: DataFrame, reports: DataFrame, start: int, end: int) -> DataFrame:
    h = between(hits, "ts", start, end).agg(
        distinct_if(in_rules(1)).alias("emergency_codes"), distinct_if(in_rules(4)).alias("near_miss"),
        distinct_if(in_rules(6)).alias("go_arounds"), distinct_if(in_rules(*SAFETY)).alias("safety_events"))
    a = reports.agg(F.count_if(F.col("is_anomaly") == 1).alias("total_anomalies"))
    # One row each: joined on a constant, not a cross product of tables.
    one = lambda d: d.withColumn("_k", F.lit(1))
    return (one(distinct_flights(tracks, start, end).withColumnRenamed("flights", "total_flights"))
            .join(one(a), "_k").join(one(h), "_k").drop("_k"))


def flag_overview(reports: DataFrame) -> DataFrame:
    flag = lambda c: distinct_if(F.col(c) == 1)
    return reports.agg(F.count_distinct("flight_id").alias("flights"), flag("is_anomaly").alias("anomalies"),
                       flag("has_1").alias("emergencies"), flag("has_4").alias("near_miss"),
                       flag("has_6").alias("go_arounds"),
                       distinct_if(F.col("has_1") + F.col("has_4") + F.col("has_6") > 0).alias("safety_events"))


def rule_counts_since(hits: DataFrame, start: int, end: int, names: dict[int, str]) -> DataFrame:
    return between(hits, "ts", start, end).agg(*[distinct_if(in_rules(k)).alias(v) for k, v in names.items()])


# -- traffic
def flights_per_day(meta: DataFrame, start: int, end: int) -> DataFrame:
    mil = F.count_if(military_flag())
    return (between(meta, "first_seen_ts", start, end).groupBy(keys.date_str("first_seen_ts").alias("date"))
            .agg(F.count("*").alias("count"), mil.alias("military_count"))
            .withColumn("civilian_count", F.col("count") - F.col("military_count")))


def flights_per_month(facts: DataFrame, start: int, end: int) -> DataFrame:
    return (between(facts, "first_seen_ts", start, end).groupBy(keys.month_str("first_seen_ts").alias("month"))
            .agg(F.count("*").alias("total_flights"), F.count_if(military_flag()).alias("military_count"),
                 F.count_if(F.col("is_anomaly") == 1).alias("anomaly_count"),
                 F.round(F.avg("flight_duration_sec") / 3600, 2).alias("avg_duration_hours")))


def busiest_airports(meta: DataFrame, limit: int = 10) -> DataFrame:
    """Departures and arrivals from one pass: each flight is unpivoted to its two ends."""
    ends = meta.select(F.explode(F.array(
        F.struct(F.col("origin_airport").alias("airport"), F.lit(1).alias("dep")),
        F.struct(F.col("destination_airport").alias("airport"), F.lit(0).alias("dep")))).alias("e")).select("e.*")
    return (ends.where(F.col("airport").isNotNull() & (F.col("airport") != ""))
            .groupBy("airport").agg(F.count_if(F.col("dep") == 0).alias("arrivals"),
                                    F.count_if(F.col("dep") == 1).alias("departures"), F.count("*").alias("total"))
            .orderBy(F.desc("total"), "airport").limit(limit))


def airport_hourly(meta: DataFrame, airport: str) -> DataFrame:
    ends = meta.select(F.explode(F.array(
        F.struct(F.col("origin_airport").alias("a"), keys.hour_of("first_seen_ts").alias("hour"), F.lit(1).alias("d")),
        F.struct(F.col("destination_airport").alias("a"), keys.hour_of("last_seen_ts").alias("hour"),
                 F.lit(0).alias("d")))).alias("e")).select("e.*").where(F.col("a") == airport)
    n = ends.groupBy("hour").agg(F.count_if(F.col("d") == 1).alias("departures"),
                                 F.count_if(F.col("d") == 0).alias("arrivals"))
    return (on_spine(spine(meta.sparkSession, 0, 23, "hour"), n, "hour", ["departures", "arrivals"])
            .withColumn("total", F.col("departures") + F.col("arrivals")))


def _routed(df: DataFrame) -> DataFrame:
    ok = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    return (df.where(ok("origin_airport") & ok("destination_airport"))
            .withColumn("route", F.concat_ws("-", "origin_airport", "destination_airport")))


def busiest_routes(facts: DataFrame, limit: int = 20) -> DataFrame:
    return (_routed(facts).groupBy("origin_airport", "destination_airport")
            .agg(F.count("*").alias("flights"), F.round(F.avg("flight_duration_sec") / 60, 1).alias("avg_duration_min"),
                 F.round(F.avg("total_distance_nm"), 1).alias("avg_distance_nm"))
            .orderBy(F.desc("flights"), "origin_airport", "destination_airport").limit(limit))


def airline_efficiency(facts: DataFrame, min_flights: int = 5, limit: int = 20) -> DataFrame:
    return (facts.where("airline is not null and airline <> ''").groupBy("airline")
            .agg(F.count("*").alias("flights"), F.round(F.avg("flight_duration_sec") / 60, 1).alias("avg_duration_min"),
                 F.round(F.avg("total_distance_nm"), 1).alias("avg_distance_nm"),
                 F.round(F.avg("avg_speed_kts"), 1).alias("avg_speed_kts"),
                 F.round(100.0 * F.avg("is_anomaly"), 1).alias("anomaly_rate"))
            .where(F.col("flights") >= min_flights).orderBy(F.desc("flights"), "airline").limit(limit))


def available_routes(facts: DataFrame, min_flights: int = 5) -> DataFrame:
    return _routed(facts).groupBy("route").agg(F.count("*").alias("flights")).where(F.col("flights") >= min_flights)


def top_routes(facts: DataFrame, limit: int = 10) -> DataFrame:
    return (_routed(facts).groupBy("route")
            .agg(F.count("*").alias("flight_count"), F.round(F.avg("flight_duration_sec") / 60, 1).alias("avg_duration_min"),
                 F.round(100.0 * F.avg("is_anomaly"), 1).alias("anomaly_rate"),
                 F.count_distinct(F.substring("callsign", 1, 3)).alias("airline_count"))
            .orderBy(F.desc("flight_count"), "route").limit(limit))


def route_comparison(facts: DataFrame, hits: DataFrame, origin: str, dest: str) -> DataFrame:
    """Airlines on one route with an efficiency score; best and worst marked."""
    fl = facts.where((F.col("origin_airport") == origin) & (F.col("destination_airport") == dest))
    dev = (hits.where(in_rules(5, 11)).join(fl.select("flight_id"), "flight_id", "left_semi")
           .groupBy("flight_id").agg(F.max("distance_nm").alias("dev")))
    agg = (fl.join(dev, "flight_id", "left").groupBy("airline")
           .agg(F.count("*").alias("flights"), F.avg("flight_duration_sec").alias("_d"),
                F.coalesce(F.avg(F.when(F.col("dev") != 0, F.col("dev"))), F.lit(0.0)).alias("_v"),
                F.avg("is_anomaly").alias("_a")))
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - F.col("_v") * 0.5 - F.col("_a") * 20))
    w = Window.orderBy(F.desc("efficiency_score"), "airline")      # one row per airline
    out = agg.select("airline", "flights", F.round(F.col("_d") / 60, 1).alias("avg_duration_min"),
                     F.round("_v", 3).alias("avg_deviation_nm"), F.round(F.col("_a") * 100, 1).alias("anomaly_rate"),
                     F.round(score, 1).alias("efficiency_score"))
    return out.withColumn("rank", F.row_number().over(w))


def year_month_comparison(facts: DataFrame) -> DataFrame:
    """Flights per year and month with the change against the year before."""
    ym = (facts.groupBy(keys.year_of("first_seen_ts").alias("year"), keys.month_of("first_seen_ts").alias("month"))
          .agg(F.count("*").alias("flights"), F.count_if(F.col("is_anomaly") == 1).alias("anomalies"),
               F.count_if(military_flag()).alias("military_flights")))
    prev = F.coalesce(F.lag("flights").over(Window.partitionBy("month").orderBy("year")), F.lit(0))
    return ym.withColumn("previous", prev).withColumn(
        "change_percent", F.when(F.col("previous") > 0, F.round(
            (F.col("flights") - F.col("previous")) / F.col("previous") * 100, 1)).otherwise(F.lit(0.0)))


def pearson_or_zero(x: str, y: str) -> Column:
    # A constant series has no spread: try_divide gives null there, read as zero.
    sd = F.stddev_pop(F.col(x)) * F.stddev_pop(F.col(y))
    return F.coalesce(F.try_divide(F.covar_pop(F.col(x), F.col(y)), sd), F.lit(0.0))


def traffic_safety_by_hour(tracks: DataFrame, hits: DataFrame) -> DataFrame:
    tr = tracks.groupBy(keys.hour_of().alias("hour")).agg(F.count_distinct("flight_id").alias("traffic_count"))
    sa = (hits.where(in_rules(*SAFETY)).groupBy(keys.hour_of().alias("hour"))
          .agg(F.count_distinct("flight_id").alias("safety_count")))
    sp = spine(tracks.sparkSession, 0, 23, "hour")
    both = on_spine(on_spine(sp, tr, "hour", ["traffic_count"]), sa, "hour", ["safety_count"])
    ratio = F.when(F.col("traffic_count") > 0, F.round(F.col("safety_count") / F.col("traffic_count") * 1000, 2)).otherwise(0.0)
    out = both.withColumn("safety_per_1000", ratio)
    w = Window.orderBy(F.desc("safety_per_1000"), "hour")           # 24 rows
    return out.withColumn("risk_rank", F.row_number().over(w))


def hourly_correlation(hourly: DataFrame, x: str = "traffic_count", y: str = "safety_count", digits: int = 3) -> DataFrame:
    return hourly.agg(F.round(pearson_or_zero(x, y), digits).alias("correlation"))


def peak_hours(tracks: DataFrame, reports: DataFrame, days: float) -> DataFrame:
    """Flights per hour of first sight, anomalies among them, daily averages."""
    first = tracks.groupBy("flight_id").agg(F.min("ts").alias("first_ts"))
    an = reports.groupBy("flight_id").agg(F.max("is_anomaly").alias("is_anomaly"))
    return (first.join(an, "flight_id", "left").groupBy(keys.hour_of("first_ts").alias("hour"))
            .agg(F.count("*").alias("flights"), F.count_if(F.col("is_anomaly") == 1).alias("anomalies"))
            .select("hour", "flights", "anomalies", F.round(F.col("flights") / days, 2).alias("avg_per_day"),
                    F.round(F.col("anomalies") / F.col("flights") * 100, 2).alias("anomaly_rate")))


def weekday_profile(facts: DataFrame) -> DataFrame:
    day = _daily(facts)
    return day.groupBy("dow").agg(F.round(F.avg("flights"), 1).alias("avg_traffic"),
                                  F.round(F.avg("anomalies"), 1).alias("avg_anomalies"))


def _daily(facts: DataFrame) -> DataFrame:
    return (facts.groupBy(keys.day_number("first_seen_ts").alias("day"))
            .agg(F.count("*").alias("flights"), F.count_if(F.col("is_anomaly") == 1).alias("anomalies"))
            .select(F.date_add(F.lit("1970-01-01").cast("date"), F.col("day")).alias("date"), "flights", "anomalies")
            .withColumn("dow", (F.dayofweek("date") - 1).cast("int")))


def low_traffic_days(daily: DataFrame) -> DataFrame:
    """Days under half their weekday mean, with a holiday guess from the calendar.

    ``daily``: date, dow, flights. One row per day, so the weekday window is small.
    """
    m, d = F.month("date"), F.dayofmonth("date")
    name = (F.when(m == 9, "Possible Yom Kippur").when(m == 10, "Possible Yom Kippur")
            .when((m == 12) & (d == 25), "Possible Christmas").when((m == 1) & (d == 1), "Possible New Year")
            .when(m == 3, "Possible Purim").when(m == 4, "Possible Passover").otherwise("Unusual low traffic"))
    mean = F.round(F.avg("flights").over(Window.partitionBy("dow")), 1)
    return (daily.withColumn("_m", mean).where((F.col("_m") > 0) & (F.col("flights") < F.col("_m") * 0.5))
            .select(F.col("date").cast("string").alias("date"), name.alias("event_name"), "flights",
                    F.round((F.col("flights") - F.col("_m")) / F.col("_m") * 100, 1).alias("traffic_change_percent")))


# -- airlines
def airline_scorecard(meta: DataFrame, hits: DataFrame, min_flights: int = 10) -> DataFrame:
    fl = (meta.where("callsign is not null and callsign <> ''").groupBy(keys.airline_code().alias("airline"))
          .agg(F.count_distinct("flight_id").alias("total_flights")))
    cs = meta.select("flight_id", keys.airline_code().alias("airline"))
    # One row per (flight, rule) before the join: a report lists a rule once.
    fired = hits.where(in_rules(1, 4, 6, 8)).select("flight_id", "rule_id").distinct()
    ev = (fired.join(cs, "flight_id").groupBy("airline")
          .agg(*[F.count_if(in_rules(k)).alias(n) for k, n in
                 ((1, "emergencies"), (4, "near_miss"), (6, "go_arounds"), (8, "diversions"))]))
    names = ["emergencies", "near_miss", "go_arounds", "diversions"]
    both = fl.join(ev, "airline", "left").withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in names})
    cut = lambda n, cap, k: F.least(F.lit(cap), F.floor(F.col(n) / F.col("total_flights") * 1000 * k))
    score = F.greatest(F.lit(0), 100 - cut("emergencies", 40, 20) - cut("near_miss", 30, 15)
                       - cut("go_arounds", 20, 5) - cut("diversions", 10, 2)).cast("int")
    s, n = F.col("safety_score"), F.col("total_flights")
    return (both.where(n >= min_flights).withColumn("safety_score", score)
            .withColumn("safety_grade", F.when(s >= 90, "A").when(s >= 80, "B").when(s >= 70, "C").when(s >= 60, "D").otherwise("F"))
            .withColumn("confidence", F.when(n >= 500, "high").when(n >= 100, "medium").when(n >= 50, "low").otherwise("very_low")))


def airline_emergencies(facts: DataFrame, limit: int = 10) -> DataFrame:
    em = F.count_if(F.col("squawk_codes").isNotNull())
    return (facts.where("airline is not null and airline <> ''").groupBy("airline")
            .agg(em.alias("emergency_count"), F.count("*").alias("total_flights"))
            .where("emergency_count > 0")
            .withColumn("emergency_rate", F.round(F.col("emergency_count") / F.col("total_flights") * 100, 2))
            .orderBy(F.desc("emergency_count"), "airline").limit(limit))


def holding_by_airline(extra: DataFrame, meta: DataFrame, limit: int = 10) -> DataFrame:
    """Mean holding per event and mean flight time, by number of flights."""
    hold = (extra.where(in_rules(3)).groupBy("flight_id")
            .agg(F.sum("duration_s").alias("hold_s"), F.count("*").alias("n")))
    return (meta.join(hold, "flight_id", "left").groupBy("airline")
            .agg(F.count("*").alias("flights"), F.sum("hold_s").alias("_h"), F.sum("n").alias("_n"),
                 F.round(F.avg("flight_duration_sec") / 60, 2).alias("avg_flight_min"))
            .select("airline", "flights", "avg_flight_min",
                    F.round(F.coalesce(F.col("_h") / F.col("_n"), F.lit(0.0)) / 60, 2).alias("avg_holding_min"))
            .orderBy(F.desc("flights"), "airline").limit(limit))


def flight_time_by_airline(tracks: DataFrame) -> DataFrame:
    per = tracks.groupBy("flight_id").agg(F.min("callsign").alias("cs"), (F.max("ts") - F.min("ts")).alias("sec"))
    return (per.where("sec > 0").groupBy(F.substring("cs", 1, 3).alias("airline"))
            .agg(F.count("*").alias("flights"), F.round(F.avg("sec") / 60, 2).alias("avg_flight_min")))


def airline_changes(meta: DataFrame, split_ts: int, threshold: float = 50.0) -> DataFrame:
    """Airlines that started, stopped or changed by at least the threshold between two periods."""
    n = (meta.groupBy("airline").agg(F.count_if(F.col("first_seen_ts") < split_ts).alias("before"),
                                     F.count_if(F.col("first_seen_ts") >= split_ts).alias("after")))
    pct = F.round((F.col("after") - F.col("before")) / F.col("before") * 100, 1)
    return (n.withColumn("change_percent", F.when(F.col("before") > 0, pct))
            .withColumn("status", F.when(F.col("before") == 0, "started").when(F.col("after") == 0, "stopped")
                        .when(F.abs("change_percent") >= threshold, "changed").otherwise("stable")))


# -- events
def emergency_codes(points: DataFrame) -> DataFrame:
    """Flights and events per emergency squawk and airline."""
    code = F.trim("squawk")
    return (points.where(code.isin("7500", "7600", "7700"))
            .groupBy(code.alias("code"), F.substring("callsign", 1, 3).alias("airline"))
            .agg(F.count_distinct("flight_id").alias("flights"), F.count("*").alias("events")))


def near_miss_per_flight(hits: DataFrame) -> DataFrame:
    """Closest proximity event of each flight under 1000 ft."""
    best = F.min_by(F.struct("distance_nm", "altitude_diff_ft", "ts"), F.struct("distance_nm", "ts"))
    return (hits.where(in_rules(4) & (F.col("altitude_diff_ft") < 1000)).groupBy("flight_id").agg(best.alias("b"))
            .select("flight_id", "b.ts", F.round("b.distance_nm", 2).alias("distance_nm"),
                    F.col("b.altitude_diff_ft").cast("int").alias("altitude_diff_ft"),
                    F.when(F.col("b.distance_nm") < 1, "high").otherwise("medium").alias("severity")))


def go_arounds_by_airport(hits: DataFrame, days: float) -> DataFrame:
    """Per airport and hour with the airport total; the hour histogram stays in rows."""
    h = (hits.where(in_rules(6)).groupBy("airport", keys.hour_of().alias("hour")).agg(F.count("*").alias("n")))
    total = F.sum("n").over(Window.partitionBy("airport"))          # at most 24 rows per airport
    return h.withColumn("count", total).withColumn("avg_per_day", F.round(F.col("count") / F.greatest(F.lit(days), F.lit(1.0)), 2))


def go_arounds_by_hour(hits: DataFrame) -> DataFrame:
    h = (hits.where(in_rules(6)).groupBy(keys.hour_of().alias("hour"))
         .agg(F.count("*").alias("count"), F.array_join(F.array_sort(F.collect_set("airport")), ",").alias("airports")))
    return (on_spine(spine(hits.sparkSession, 0, 23, "hour"), h, "hour", ["count"])
            .withColumn("airports", F.coalesce("airports", F.lit(""))))


def diversion_totals(hits: DataFrame, extra: DataFrame) -> DataFrame:
    off = hits.where(in_rules(11)).groupBy("flight_id").agg(F.count("*").alias("n")).agg(
        F.count_if(F.col("n") >= 3).alias("large_deviations"))
    one = lambda d: d.withColumn("_k", F.lit(1))
    return (one(hits.agg(F.count_if(in_rules(8)).alias("diversions")))
            .join(one(extra.agg(F.count_if(in_rules(3) & (F.abs("turn_deg") >= 300)).alias("holding_360s"))), "_k")
            .join(one(off), "_k").drop("_k"))


def diversions_by(hits: DataFrame, meta: DataFrame, what: str) -> DataFrame:
    d = hits.where(in_rules(8))
    if what == "airline":
        d = d.join(meta.select("flight_id", keys.airline_letters().alias("airline")), "flight_id")
    return d.groupBy(what).agg(F.count("*").alias("diversions"))


def diversions_monthly(hits: DataFrame, extra: DataFrame) -> DataFrame:
    both = (hits.select("ts", "flight_id", "rule_id", F.lit(0.0).alias("turn_deg"))
            .unionByName(extra.where(in_rules(3)).select("ts", "flight_id", "rule_id", "turn_deg")))
    return (both.groupBy(keys.month_str().alias("month"))
            .agg(F.count_if(in_rules(8)).alias("diversions"),
                 F.count_if(in_rules(3) & (F.abs("turn_deg") >= 300)).alias("holding_patterns"),
                 F.count_if(in_rules(11)).alias("off_course"), distinct_if(in_rules(8)).alias("affected_flights"))
            .withColumn("total_events", F.col("diversions") + F.col("holding_patterns") + F.col("off_course")))


def diversions_seasonal(hits: DataFrame) -> DataFrame:
    """Counts by month, quarter and season; every bucket present."""
    n = (hits.where(in_rules(8)).groupBy(keys.month_of().alias("month")).agg(F.count("*").alias("count")))
    full = on_spine(spine(hits.sparkSession, 1, 12, "month"), n, "month", ["count"])
    kinds = F.explode(F.array(
        F.struct(F.lit("month").alias("kind"), F.col("month").cast("string").alias("bucket")),
        F.struct(F.lit("quarter").alias("kind"), F.concat(F.lit("Q"), F.ceil(F.col("month") / 3).cast("string")).alias("bucket")),
        F.struct(F.lit("season").alias("kind"), keys.season("month").alias("bucket"))))
    return full.select(kinds.alias("k"), "count").groupBy("k.kind", "k.bucket").agg(F.sum("count").alias("count"))


def return_events(extra: DataFrame, meta: DataFrame, max_min: float = 30, limit: int = 50) -> DataFrame:
    """First return of each flight within the limit, newest first."""
    ok = extra.where(in_rules(7) & (F.col("duration_s") / 60 <= max_min))
    first = ok.groupBy("flight_id").agg(F.min_by(F.struct("ts", "duration_s", "airport", "outbound_nm"), "ts").alias("e"))
    rows = first.select("flight_id", F.col("e.ts").alias("departure_time"),
                        (F.col("e.ts") + F.col("e.duration_s")).cast("bigint").alias("landing_time"),
                        F.round(F.col("e.duration_s") / 60, 1).alias("duration_min"), F.col("e.airport").alias("airport"),
                        F.round("e.outbound_nm", 1).alias("max_outbound_nm"))
    return (rows.join(meta.select("flight_id", "callsign"), "flight_id", "left")
            .orderBy(F.desc("departure_time"), "flight_id").limit(limit))


def safety_monthly(hits: DataFrame) -> DataFrame:
    return (hits.where(in_rules(*SAFETY)).groupBy(keys.month_str().alias("month"))
            .agg(F.count_if(in_rules(1)).alias("emergency_codes"), F.count_if(in_rules(4)).alias("near_miss"),
                 F.count_if(in_rules(6)).alias("go_arounds"), F.count("*").alias("total_events"),
                 F.count_distinct("flight_id").alias("affected_flights")))


def safety_by_phase(events: DataFrame) -> DataFrame:
    """Flights per rule and highest phase. ``events``: flight_id, rule_id, altitude_diff_ft, alt, gspeed."""
    e = events.where(in_rules(*SAFETY) & (~in_rules(4) | (F.col("altitude_diff_ft") < 1000)))
    per = e.groupBy("flight_id", "rule_id").agg(F.max("alt").alias("alt"), F.max("gspeed").alias("gspeed"))
    by_alt = F.when(F.col("alt") > 25000, "cruise").when(F.col("alt") > 10000, "descent_climb").when(F.col("alt").isNotNull(), "approach")
    by_speed = F.when(F.col("gspeed") > 400, "cruise").when(F.col("gspeed") < 200, "approach").otherwise("descent_climb")
    phase = F.when(in_rules(6), "approach").otherwise(F.coalesce(by_alt, by_speed))
    return (per.groupBy(phase.alias("phase"))
            .agg(*[distinct_if(in_rules(k)).alias(n) for k, n in ((1, "emergency"), (4, "near_miss"), (6, "go_around"))]))


def deviations_by_type(hits: DataFrame, meta: DataFrame, large_nm: float = 20, limit: int = 20) -> DataFrame:
    per = hits.where(in_rules(5, 11)).groupBy("flight_id").agg(F.max("distance_nm").alias("dev"))
    return (per.join(meta.where("aircraft_type is not null and aircraft_type <> ''").select("flight_id", "aircraft_type"), "flight_id")
            .groupBy("aircraft_type")
            .agg(F.count("*").alias("deviation_count"), F.round(F.avg("dev"), 1).alias("avg_deviation_nm"),
                 F.count_if(F.col("dev") > large_nm).alias("large_deviations"))
            .orderBy(F.desc("deviation_count"), "aircraft_type").limit(limit))


def emergency_outcomes(hits: DataFrame, facts: DataFrame) -> DataFrame:
    """Flights with an emergency: what became of them."""
    per = (hits.where(in_rules(1, 8)).groupBy("flight_id")
           .agg(F.bool_or(in_rules(1)).alias("em"), F.bool_or(in_rules(8)).alias("div"), F.max(F.when(in_rules(1), F.col("ts"))).alias("ts"))
           .where("em"))
    code = F.coalesce(*[F.when(F.col("squawk_codes").contains(c), c) for c in ("7700", "7600", "7500")])
    dest = F.col("destination_airport")
    outcome = (F.when(F.col("div"), "diverted").when(F.col("origin_airport") == dest, "rtb")
               .when(dest.isNotNull() & (dest != ""), "landed_safely").otherwise("unknown"))
    return (per.join(facts, "flight_id", "left")
            .select("flight_id", "ts", "airline", F.coalesce(code, F.lit("UNKNOWN")).alias("code"), outcome.alias("outcome")))


def near_miss_by_country(hits: DataFrame, facts: DataFrame, country: str | None = None) -> DataFrame:
    fl = hits.where(in_rules(4)).select("flight_id").distinct()
    one = F.explode(F.split("crossed_borders", ","))
    out = (fl.join(facts.where("crossed_borders is not null").select("flight_id", "crossed_borders"), "flight_id")
           .select("flight_id", one.alias("country")).withColumn("country", F.trim("country")).where("country <> ''"))
    if country:
        keep = out.where(F.col("country") == country).select("flight_id").distinct()
        out = out.join(keep, "flight_id", "left_semi")
    return out.groupBy("country").agg(F.count("*").alias("flights"))


def military_totals(facts: DataFrame) -> DataFrame:
    return facts.where(military_flag()).groupBy("military_type", "country").agg(F.count("*").alias("flights"))


def jamming_by_time(extra: DataFrame) -> DataFrame:
    """Reports with rule 9 or 10 by hour and weekday, with the peaks ranked."""
    rep = extra.where(in_rules(9, 10)).groupBy("flight_id").agg(F.max("ts").alias("ts"))
    slots = F.explode(F.array(F.struct(F.lit("hour").alias("kind"), keys.hour_of().alias("slot")),
                              F.struct(F.lit("weekday").alias("kind"), keys.weekday().alias("slot"))))
    n = rep.select(slots.alias("k")).groupBy("k.kind", "k.slot").agg(F.count("*").alias("count"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("count"), "slot")))


def incident_days(hits: DataFrame, min_events: int = 3, spread: float = 2.0) -> DataFrame:
    """Days with many incidents and how far apart they lie."""
    d = (hits.where(in_rules(1, 4, 6, 8)).groupBy(keys.date_str().alias("date"))
         .agg(*[F.count_if(in_rules(k)).alias(n) for k, n in ((1, "emergency_count"), (4, "near_miss_count"),
                                                              (6, "go_around_count"), (8, "diversion_count"))],
              F.count("*").alias("total_incidents"), (F.max("lat") - F.min("lat")).alias("_a"), (F.max("lon") - F.min("lon")).alias("_o")))
    s = F.round(F.sqrt(F.col("_a") * F.col("_a") + F.col("_o") * F.col("_o")), 2)
    return (d.where(F.col("total_incidents") >= min_events).withColumn("geographic_spread_deg", s)
            .withColumn("geographically_clustered", F.col("geographic_spread_deg") < spread).drop("_a", "_o"))


def emergency_days(hits: DataFrame, near_deg: float = 0.8) -> DataFrame:
    """Days with two or more emergencies; clustered when two lie within 0.8 degrees both ways.

    Two points closer than the limit share a cell or sit in adjacent cells of that
    width. A day's cells are reduced to extreme points first, so no day's events are paired.
    """
    e = hits.where(in_rules(1)).select(keys.date_str().alias("date"), "flight_id", "ts", "lat", "lon")
    days = e.groupBy("date").agg(F.count("*").alias("count")).where("count >= 2")
    return days.join(_close_days(e, near_deg), "date", "left").select(
        "date", "count", F.coalesce("cluster_detected", F.lit(False)).alias("cluster_detected"))


def _close_days(e: DataFrame, near: float) -> DataFrame:
    # Cells of half the width: two points in one cell are always closer than the limit,
    # so after that test every cell holds one point per day and the pair join is bounded.
    half = near / 2
    c = (e.withColumns({"cy": F.floor(F.col("lat") / half), "cx": F.floor(F.col("lon") / half)})
         .groupBy("date", "cy", "cx").agg(F.count("*").alias("n"), F.first("lat").alias("lat"), F.first("lon").alias("lon")))
    same = c.where("n >= 2").select("date")
    single = c.where("n = 1").select("date", "cy", "cx", "lat", "lon")
    around = F.explode(F.sequence(F.lit(-2), F.lit(2)))
    probe = (single.withColumn("_dy", around).withColumn("_dx", around)
             .select("date", (F.col("cy") + F.col("_dy")).alias("cy"), (F.col("cx") + F.col("_dx")).alias("cx"),
                     F.col("cy").alias("oy"), F.col("cx").alias("ox"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2")))
    pair = (single.join(probe, ["date", "cy", "cx"])
            .where((F.struct("cy", "cx") < F.struct("oy", "ox")) & (F.abs(F.col("lat") - F.col("lat2")) < near)
                   & (F.abs(F.col("lon") - F.col("lon2")) < near)).select("date"))
    # A cell with one point next to a cell with several is covered by `same`.
    return same.unionByName(pair).distinct().withColumn("cluster_detected", F.lit(True))


def emergency_cells(hits: DataFrame, step: float = 1.0, min_count: int = 2) -> DataFrame:
    from wayfold.functions import geo
    return (hits.where(in_rules(1)).groupBy(geo.grid("lat", step).alias("lat"), geo.grid("lon", step).alias("lon"))
            .agg(F.count("*").alias("count"), F.count_distinct(keys.day_number()).alias("unique_days"))
            .where(F.col("count") >= min_count))


def monthly_trend(tracks: DataFrame) -> DataFrame:
    """Distinct flights per month and the hour with most points."""
    h = (tracks.groupBy(keys.month_str().alias("month"), keys.hour_of().alias("hour")).agg(F.count("*").alias("points")))
    busy = h.groupBy("month").agg(F.max_by("hour", F.struct("points", -F.col("hour"))).alias("busiest_hour"),
                                  F.sum("points").alias("points"))
    return (tracks.groupBy(keys.month_str().alias("month")).agg(F.count_distinct("flight_id").alias("flights"))
            .join(busy, "month"))


def holding_minutes(extra: DataFrame) -> DataFrame:
    """Holdings of 60 < d <= 3600 s, the longest per flight and minute."""
    ok = extra.where(in_rules(3) & (F.col("duration_s") > 60) & (F.col("duration_s") <= 3600))
    return (ok.groupBy("flight_id", F.floor(F.col("ts") / 60).alias("minute"))
            .agg(F.max_by(F.struct("duration_s", "ts", "lat", "lon"), F.struct("duration_s", "ts")).alias("e"))
            .select("flight_id", "e.*"))


def holding_cost(holds: DataFrame, airports: DataFrame, per_minute: float = 50.0, max_nm: float = 100.0) -> DataFrame:
    from wayfold.operators.nearest import nearest_airport
    near = nearest_airport(holds, airports)
    return (near.groupBy(F.when(F.col("ap_nm") < max_nm, F.col("ap_code")).otherwise("OTHER").alias("airport"))
            .agg(F.count("*").alias("events"), F.count_distinct("flight_id").alias("flights"),
                 F.round(F.sum("duration_s") / 60, 2).alias("minutes"))
            .withColumn("cost_usd", F.round(F.col("minutes") * per_minute, 1)))


def alternates(hits: DataFrame, meta: DataFrame) -> DataFrame:
    """Diversions whose actual airport differs from the plan, with body classes."""
    d = (hits.where(in_rules(8)).select("flight_id", F.col("airport").alias("actual"))
         .join(meta.select("flight_id", F.col("destination_airport").alias("planned"), "aircraft_type"), "flight_id"))
    return (d.where(F.col("actual") != F.col("planned")).groupBy("planned", "actual")
            .agg(F.count("*").alias("diversions"),
                 F.array_join(F.array_sort(F.collect_set("aircraft_type")), ",").alias("types"),
                 F.count_if(keys.body_class() == "wide_body").alias("wide_body"),
                 F.count_if(keys.body_class() == "narrow_body").alias("narrow_body")))


def alternate_preferences(hits: DataFrame, meta: DataFrame, k: int = 5) -> DataFrame:
    """Top alternates per origin."""
    d = (hits.where(in_rules(8)).select("flight_id", F.col("airport").alias("alternate"))
         .join(meta.select("flight_id", "origin_airport"), "flight_id")
         .groupBy("origin_airport", "alternate").agg(F.count("*").alias("n")))
    w = Window.partitionBy("origin_airport").orderBy(F.desc("n"), "alternate")
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def alternate_by_type(hits: DataFrame, meta: DataFrame) -> DataFrame:
    d = (hits.where(in_rules(8)).select("flight_id", F.col("airport").alias("alternate"))
         .join(meta.select("flight_id", "aircraft_type"), "flight_id")
         .groupBy("aircraft_type", "alternate").agg(F.count("*").alias("n")))
    return d.groupBy("aircraft_type").agg(F.min_by("alternate", F.struct(-F.col("n"), F.col("alternate"))).alias("preferred"))


def weather_monthly(hits: DataFrame) -> DataFrame:
    """Per month: flights with a diversion, a go-around, a deviation."""
    return (hits.where(in_rules(6, 8, 11)).groupBy(keys.month_str().alias("month"))
            .agg(distinct_if(in_rules(8)).alias("diversion_count"), distinct_if(in_rules(6)).alias("go_around_count"),
                 distinct_if(in_rules(11)).alias("deviation_count")))


def weather_by_airport(hits: DataFrame, meta: DataFrame) -> DataFrame:
    """Diverted and going-around flights by planned destination, with the peak go-around hour."""
    fired = (hits.where(in_rules(6, 8)).groupBy("flight_id").agg(F.bool_or(in_rules(8)).alias("d"), F.bool_or(in_rules(6)).alias("g")))
    j = (fired.join(meta.where("destination_airport is not null").select("flight_id", "first_seen_ts", "destination_airport"), "flight_id")
         .groupBy(F.col("destination_airport").alias("airport"), keys.hour_of("first_seen_ts").alias("hour"))
         .agg(F.count_if("d").alias("d"), F.count_if("g").alias("g")))
    return (j.groupBy("airport").agg(F.sum("d").alias("diversions"), F.sum("g").alias("go_arounds"),
                                     F.max_by("hour", F.struct("g", -F.col("hour"))).alias("peak_hour")))


# -- reviewer-tagged set
def tagged_overview(facts: DataFrame, feedback: DataFrame, rules: DataFrame, reports: DataFrame) -> DataFrame:
    """``rules``: flight_id, rule_ids array. Tag numbering: 4 holding, 3 near miss, 5 go-around, 6 return, 12 unplanned."""
    j = (feedback.join(rules, "flight_id", "left").join(reports.select("flight_id", "severity_cnn"), "flight_id", "left"))
    tag = lambda k: F.count_if((F.col("rule_id") == k) | F.coalesce(F.array_contains("rule_ids", k), F.lit(False)))
    t = j.agg(F.count_if(F.col("user_label") == 1).alias("total_anomalies"), tag(4).alias("holding_patterns"),
              tag(3).alias("near_miss"), tag(5).alias("go_arounds"), tag(6).alias("return_to_field"),
              F.round(F.coalesce(F.avg("severity_cnn"), F.lit(0.0)), 2).alias("avg_severity"))
    f = facts.agg(F.count("*").alias("total_flights"), F.count_if(military_flag()).alias("military_flights"),
                  F.count_if(F.col("squawk_codes").isNotNull()).alias("emergency_codes"))
    one = lambda d: d.withColumn("_k", F.lit(1))
    return one(f).join(one(t), "_k").drop("_k").withColumn(
        "safety_events", F.col("emergency_codes") + F.col("near_miss") + F.col("go_arounds"))


def events_by_rule(report_lists: DataFrame) -> DataFrame:
    """Comma lists of ids, names and categories, zipped and counted."""
    parts = lambda c: F.transform(F.split(c, ","), lambda x: F.trim(x))
    z = F.explode(F.arrays_zip(parts("ids").alias("id"), parts("names").alias("name"), parts("categories").alias("category")))
    return (report_lists.select(z.alias("z")).where("z.id <> ''")
            .groupBy(F.col("z.id").cast("int").alias("rule_id"), F.col("z.name").alias("rule_name"), F.col("z.category").alias("category"))
            .agg(F.count("*").alias("count")))


def tagged_emergencies(facts: DataFrame) -> DataFrame:
    as_list = F.when(F.col("squawk_codes").startswith("["), F.from_json("squawk_codes", "array<string>")).otherwise(
        F.transform(F.split("squawk_codes", ","), lambda x: F.trim(x)))
    return (facts.where("squawk_codes is not null").select("flight_id", "airline", F.explode(as_list).alias("code"))
            .where(F.col("code").isin("7500", "7600", "7700")).groupBy("code", "airline")
            .agg(F.count_distinct("flight_id").alias("flights")))


def tagged_signal_loss(facts: DataFrame) -> DataFrame:
    e = F.col("signal_loss_events")
    return facts.agg(F.sum(F.when(e > 0, e)).alias("total_events"), F.count_if(e > 0).alias("affected_flights"),
                     F.round(F.avg(F.when(e > 0, e)), 2).alias("avg_events_per_flight"))


def severity_histogram(reports: DataFrame) -> DataFrame:
    s = F.coalesce(F.col("severity_cnn"), F.lit(0.0))
    bucket = F.least(F.lit(4), F.greatest(F.lit(0), F.when(s >= 0.8, 4).when(s >= 0.6, 3).when(s >= 0.4, 2).when(s >= 0.2, 1).otherwise(0)))
    n = reports.groupBy(bucket.alias("b")).agg(F.count("*").alias("count"), F.round(F.avg("severity_cnn"), 3).alias("avg_cnn"),
                                               F.round(F.max("severity_dense"), 3).alias("max_dense"))
    full = on_spine(spine(reports.sparkSession, 0, 4, "b"), n, "b", ["count"])
    names = F.array(*[F.lit(x) for x in ("minimal", "low", "medium", "high", "critical")])
    return full.select(F.get(names, F.col("b")).alias("severity_range"), "count", "avg_cnn", "max_dense")


def tagged_returns(feedback: DataFrame, facts: DataFrame, limit: int = 50) -> DataFrame:
    f = feedback.where("rule_id = 6 and user_label = 1").select("flight_id", F.col("first_seen_ts").alias("tag_ts"))
    return (f.join(facts, "flight_id", "left")
            .select("flight_id", F.coalesce("callsign", F.lit("UNKNOWN")).alias("callsign"), "tag_ts",
                    F.round(F.col("flight_duration_sec") / 60, 1).alias("duration_min"),
                    F.coalesce("origin_airport", F.lit("UNKNOWN")).alias("airport"),
                    F.round("total_distance_nm", 1).alias("max_outbound_nm"))
            .orderBy(F.desc("tag_ts"), "flight_id").limit(limit))
