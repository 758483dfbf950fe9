"""Grid cells over gaps, points and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold import config as C
from wayfold.functions import geo, keys
from wayfold.operators.nearest import away_from
from wayfold.operators.sequence import SPOOFED_FT, burst_clusters, deltas, oscillates, signal_gaps
from wayfold.operators.windows import cut
from wayfold.storage import written


def _with_max(df: DataFrame, **maxima: str) -> DataFrame:
    """Attach global maxima of a cell frame as columns, without one global window task.

    The cells (bounded by the grid) are written once, or the scan behind them would run twice.
    """
    df = cut(df)
    m = df.agg(*[F.max(c).alias(n) for n, c in maxima.items()]).withColumn("_k", F.lit(1))
    return df.withColumn("_k", F.lit(1)).join(F.broadcast(m), "_k").drop("_k")     # m is one row


def signal_loss_cells(tracks: DataFrame, airports: DataFrame, step: float = 0.25, airport_nm: float = 5,
                      limit: int | None = 50, gap_s: int = 300, min_alt: float = 5000) -> DataFrame:
    """Signal-loss cells: counts per gap class, centroid, intensity relative to the busiest cell."""
    g = signal_gaps(tracks, gap_s, min_alt)
    g = away_from(g, airports, airport_nm, radius=C.EARTH_NM_STATS).withColumn("cls", keys.gap_class("gap_s"))
    kinds = ("brief", "medium", "extended")
    cells = (g.groupBy(geo.cell("lat", step).alias("cy"), geo.cell("lon", step).alias("cx"))
             .agg(F.count("*").alias("count"), F.sum("gap_s").alias("_dur"), F.count_distinct("flight_id").alias("affected_flights"),
                  *[F.count_if(F.col("cls") == k).alias(f"{k}_count") for k in kinds],
                  F.round(F.avg("lat"), 4).alias("lat"), F.round(F.avg("lon"), 4).alias("lon"),
                  F.min("gap_start").alias("first_seen"), F.max("gap_start").alias("last_seen")))
    b, m, e = (F.col(f"{k}_count") for k in kinds)
    kind = F.when((b >= m) & (b >= e), "brief").when(m >= e, "medium").otherwise("extended")
    out = _with_max(cells, _top="count").select(
        "cy", "cx", "lat", "lon", "count", F.floor(F.col("_dur") / F.col("count")).alias("avg_duration"),
        F.least(F.lit(100), F.floor(F.col("count") / F.col("_top") * 100)).cast("int").alias("intensity"),
        "affected_flights", kind.alias("gap_type"), "brief_count", "medium_count", "extended_count", "first_seen", "last_seen")
    return out.orderBy(F.desc("count"), "cy", "cx").limit(limit) if limit else out


def signal_loss_zones(tracks: DataFrame, step: float = 0.25, limit: int | None = 50, gap_s: int = 300) -> DataFrame:
    """Cells of gap midpoints with the 40/30/10/5 intensity mix."""
    g = signal_gaps(tracks, gap_s, None, inclusive=True).withColumns({
        "mlat": (F.col("lat") + F.col("end_lat")) / 2, "mlon": (F.col("lon") + F.col("end_lon")) / 2,
        "cls": keys.gap_class("gap_s", 600, 1800)})
    c = (g.groupBy(geo.grid("mlat", step).alias("lat"), geo.grid("mlon", step).alias("lon"))
         .agg(F.count("*").alias("count"), F.count_distinct("flight_id").alias("affected_flights"),
              F.avg("gap_s").alias("avg_duration"), F.min("gap_end").alias("first_seen"), F.max("gap_end").alias("last_seen"),
              *[F.count_if(F.col("cls") == k).alias(f"{k}_count") for k in ("brief", "medium", "extended")]))
    score = F.least(F.lit(100.0), F.col("count") / F.col("_c") * 40 + F.col("affected_flights") / F.col("_f") * 30
                    + F.col("extended_count") * 10 + F.col("medium_count") * 5)
    kind = F.when(F.col("extended_count") > 0, "extended").when(F.col("medium_count") > 0, "medium").otherwise("brief")
    out = _with_max(c, _c="count", _f="affected_flights").withColumns({"intensity": score, "gap_type": kind}).drop("_c", "_f")
    return out.orderBy(F.desc("intensity"), "lat", "lon").limit(limit) if limit else out


def zone_baseline(tracks: DataFrame, start: int, end: int, lookback_s: int, step: float = 0.5, gap_s: int = 60,
                  min_score: float = 0.5, limit: int = 20) -> DataFrame:
    """Cells whose gaps exceed those of a baseline period, scaled to the period length."""
    def period(a, b):
        g = signal_gaps(tracks.where(F.col("ts").between(a, b)), gap_s, None)
        return (g.groupBy(geo.grid("end_lat", step).alias("lat"), geo.grid("end_lon", step).alias("lon"))
                .agg(F.count("*").alias("losses"), F.count_distinct("flight_id").alias("flights")))

    now, base = period(start, end), period(start - lookback_s, start)
    ratio = (end - start) / lookback_s
    j = now.join(base.select("lat", "lon", F.col("losses").alias("baseline_losses")), ["lat", "lon"], "left")
    norm = F.coalesce("baseline_losses", F.lit(0)) * ratio
    score = F.when(norm > 0, (F.col("losses") - norm) / norm).otherwise(F.col("losses") / 10.0)
    return (j.withColumn("_s", score).where(F.col("_s") > min_score)
            .select("lat", "lon", F.col("losses").alias("current_losses"), F.coalesce("baseline_losses", F.lit(0)).alias("baseline_losses"),
                    F.col("flights").alias("affected_flights"), F.round("_s", 2).alias("anomaly_score"))
            .orderBy(F.desc("anomaly_score"), "lat", "lon").limit(limit))


# -- interference per flight and per cell
def _flags() -> dict[str, Column]:
    c = F.col
    spoof = (c("alt").isin(SPOOFED_FT) | c("prev_alt").isin(SPOOFED_FT)) & (c("alt_diff") > 5000)
    return {"altitude_jumps": c("alt_rate") > 3000, "spoofed_hits": spoof,
            "speed_anomalies": F.coalesce(c("gspeed"), F.lit(0.0)) > 600, "position_teleports": c("speed_kt") > 600,
            "impossible_turns": c("turn_rate") > 8, "bearing_mismatches": c("mismatch") > 90,
            "signal_losses": c("dt") >= 300, "mlat": F.upper(F.coalesce(c("source"), F.lit(""))) == "MLAT"}


def flight_interference(tracks: DataFrame, airports: DataFrame, min_alt: float = 5000, airport_nm: float = 5) -> DataFrame:
    """Indicator counts and score per flight, away from airports."""
    d = deltas(tracks.where(F.col("alt") > min_alt))
    d = away_from(d, airports, airport_nm, radius=C.EARTH_NM_STATS)
    n = d.groupBy("flight_id").agg(*[F.count_if(v).alias(k) for k, v in _flags().items()], F.count("*").alias("points"),
                                   geo.mean("lat").alias("lat"), geo.mean("lon").alias("lon"),
                                   F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    cap = lambda c, k, top: F.least(F.lit(top), F.col(c) * k)
    score = (cap("altitude_jumps", 2, 20) + cap("spoofed_hits", 4, 15) + cap("speed_anomalies", 3, 15)
             + cap("position_teleports", 4, 15) + F.when(F.col("mlat") / F.greatest(F.col("points"), F.lit(1)) > 0.8, 8).otherwise(0)
             + cap("impossible_turns", 1, 12) + cap("bearing_mismatches", 1, 5) + cap("signal_losses", 5, 20))
    return n.withColumn("score", score)


def interference_cells(per_flight: DataFrame, step: float = 0.25, min_score: float = 15, limit: int | None = 30) -> DataFrame:
    sums = ["altitude_jumps", "spoofed_hits", "speed_anomalies", "position_teleports", "impossible_turns",
            "bearing_mismatches", "signal_losses"]
    c = (per_flight.where(F.col("score") >= min_score)
         .groupBy(geo.grid("lat", step).alias("lat"), geo.grid("lon", step).alias("lon"))
         .agg(F.avg("score").alias("score"), F.count("*").alias("affected_flights"), *[F.sum(x).alias(x) for x in sums],
              F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")))
    val = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("affected_flights") / F.col("_m") * 50 + F.col("score") / 100 * 50))
    out = _with_max(c, _m="affected_flights").withColumn("intensity", val).drop("_m")
    return out.orderBy(F.desc("intensity"), "lat", "lon").limit(limit) if limit else out


def interference_components(tracks: DataFrame, airports: DataFrame, step: float = 0.25, min_score: float = 15, gap_s: int = 300,
                            airport_nm: float = 5, within_s: int = 1800, limit: int | None = 30) -> DataFrame:
    """Cells with the marks of all flights of ``min_score`` whose mean position lies there, and of signal gaps that began there.

    Events are a cell's distinct instants; ``correlated_events`` counts their pairs at most ``within_s`` apart. Instants are
    compared inside time slots with the next slot's copied in, so a crowded cell is spread over tasks. Means are of ``geo.fixed``
    degrees, so that neither cells nor positions hang on the order of rows.
    """
    c, cell = F.col, ["cell_lat", "cell_lon"]
    on_grid = lambda lat, lon: [geo.grid(lat, step).alias("cell_lat"), geo.grid(lon, step).alias("cell_lon")]
    marks = {k: v for k, v in _flags().items() if k not in ("signal_losses", "mlat")} | {"oscillations": oscillates()}
    steps = deltas(tracks, with_previous_turn=True).select("flight_id", "ts", "lat", "lon", "prev_ts", "prev_lat", "prev_lon", "dt", "source",
                                                           *[F.coalesce(v, F.lit(False)).alias(k) for k, v in marks.items()])
    steps = written(steps, "steps")     # read three times: by flight, for gaps, and for marks
    away = lambda df: away_from(df, airports, airport_nm, radius=C.EARTH_NM_STATS)
    n = away(steps).groupBy("flight_id").agg(*[F.count_if(k).alias(k) for k in marks], geo.mean("lat").alias("lat"), geo.mean("lon").alias("lon"),
                                   (F.count_if(F.upper("source") == "MLAT") / F.count("*") > 0.8).alias("mlat"))
    top = lambda most, x: F.least(F.lit(most), x)
    score = (top(20, c("altitude_jumps") * 2) + top(15, c("spoofed_hits") * 4) + top(15, c("speed_anomalies") * 3) + top(15, c("position_teleports") * 4)
             + F.when(c("mlat"), 8).otherwise(0) + top(12, c("impossible_turns")) + top(10, c("oscillations") * 2) + top(5, c("bearing_mismatches")))
    flights = written(n.where(score >= min_score).select("*", *on_grid("lat", "lon")), "flights")
    gaps = away_from(steps.where(c("dt") > gap_s), airports, airport_nm, "prev_lat", "prev_lon", radius=C.EARTH_NM_STATS)
    gaps = written(gaps.select("flight_id", "dt", c("prev_ts").alias("ts"), c("prev_lat").alias("lat"), c("prev_lon").alias("lon"), *on_grid("prev_lat", "prev_lon")), "gaps")
    # One flight may hold a large share of all marks, so the join is salted by time.
    salts = 16
    placed = flights.select("flight_id", *cell, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    marked = away(steps.where(" or ".join(marks))).select("flight_id", "ts", F.pmod(c("ts"), F.lit(salts)).cast("int").alias("_salt"))
    events = marked.join(placed, ["flight_id", "_salt"]).select(*cell, "ts").unionByName(gaps.select(*cell, "ts")).distinct()
    slot = F.floor(c("ts") / within_s)
    dealt = events.withColumn("_home", slot).withColumn("_slot", F.explode(F.array(slot, slot - 1)))
    later = Window.partitionBy(*cell, "_slot").orderBy("ts").rangeBetween(1, within_s)
    times = (dealt.withColumn("_later", F.count("*").over(later)).where("_slot = _home").groupBy(*cell)
             .agg(F.count("*").alias("event_count"), F.sum("_later").alias("correlated_events"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")))
    who = (flights.select(*cell, "flight_id").unionByName(gaps.select(*cell, "flight_id")).distinct().groupBy(*cell).agg(F.count("*").alias("affected_flights")))
    sums = flights.groupBy(*cell).agg(*[F.sum(k).alias(k) for k in marks], F.count_if("mlat").alias("mlat_only_flights"), F.sum(geo.fixed("lat")).alias("_flat"), F.sum(geo.fixed("lon")).alias("_flon"))
    lost = gaps.groupBy(*cell).agg(F.sum("dt").alias("gap_duration"), F.sum(geo.fixed("lat")).alias("_glat"), F.sum(geo.fixed("lon")).alias("_glon"))
    out = who.join(times, cell, "left").join(sums, cell, "left").join(lost, cell, "left").na.fill(
        0, [*marks, "event_count", "correlated_events", "mlat_only_flights", "gap_duration", "_flat", "_flon", "_glat", "_glon"])
    m, lat, lon = c("affected_flights"), c("_flat") + c("_glat"), c("_flon") + c("_glon")
    total = (top(25, c("altitude_jumps") * 2 + c("spoofed_hits") * 4) + top(20, c("speed_anomalies") * 2 + c("position_teleports") * 3)
             + top(25, c("impossible_turns") + c("oscillations") * 2 + c("bearing_mismatches")) + F.floor(c("mlat_only_flights") / m * 10)
             + top(10, c("correlated_events") * 2) + top(10, m * 3))
    s, summed = c("score"), (lat > 0) & (lon > 0)
    out = (out.withColumns({"lat": F.round(F.when(summed, lat / m / 1e7).otherwise(c("cell_lat")), 4), "lon": F.round(F.when(summed, lon / m / 1e7).otherwise(c("cell_lon")), 4),
                            "score": total.cast("long"), "avg_gap_s": F.floor(c("gap_duration") / F.greatest("event_count", F.lit(1)))})
           .withColumn("confidence", F.when(s >= 60, "HIGH").when(s >= 35, "MEDIUM").when(s >= 15, "LOW").otherwise("UNLIKELY"))
           .drop("_flat", "_flon", "_glat", "_glon"))
    return out.orderBy(F.desc("score"), *cell).limit(limit) if limit else out


def flight_score(tracks: DataFrame) -> DataFrame:
    """Ten indicators and a 0-100 score per flight, with a confidence word."""
    d = deltas(tracks, with_previous_turn=True).where("dt > 0")
    c = F.col
    marks = {"altitude_jumps": c("alt_diff") > 5000,
             "spoofed_hits": (c("alt").isin(SPOOFED_FT) | c("prev_alt").isin(SPOOFED_FT)) & (c("alt_diff") > 5000),
             "impossible_rates": c("alt_rate") > 3000, "speed_anomalies": c("gspeed") > 600,
             "position_teleports": c("speed_kt") > 600, "impossible_turns": c("turn_rate") > 8,
             "oscillations": oscillates(), "bearing_mismatches": c("mismatch") > 90}
    d = d.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in marks.items()})
    flagged = d.where(" or ".join(marks)).select("flight_id", "ts")
    n = d.groupBy("flight_id").agg(*[F.count_if(k).alias(k) for k in marks],
                                   F.count_if(F.upper("source") == "MLAT").alias("_m"), (F.count("*") + 1).alias("_n"))
    j = (n.join(burst_clusters(flagged), "flight_id", "left")
         .withColumns({"clusters": F.coalesce("clusters", F.lit(0)), "mlat_ratio": F.round(c("_m") / c("_n"), 2)}))
    cap = lambda x, k, top: F.least(F.lit(top), c(x) * k)
    score = (cap("altitude_jumps", 1, 10) + cap("spoofed_hits", 3, 12) + cap("impossible_rates", 2, 8) + cap("speed_anomalies", 2, 12)
             + cap("position_teleports", 3, 13) + cap("impossible_turns", 1, 10) + cap("oscillations", 2, 10)
             + cap("bearing_mismatches", 1, 5) + cap("clusters", 2, 10)
             + F.when(c("mlat_ratio") > 0.9, 10).when(c("mlat_ratio") > 0.7, 7).when(c("mlat_ratio") > 0.5, 4).otherwise(0))
    s = c("score")
    return (j.withColumn("score", F.least(F.lit(100), score))
            .withColumn("confidence", F.when(s >= 60, "HIGH").when(s >= 35, "MEDIUM").when(s >= 15, "LOW").otherwise("UNLIKELY"))
            .drop("_m", "_n"))


# -- other cell maps
def hotspot_cells(tracks: DataFrame, step: float = 0.5, min_losses: int = 3, limit: int = 30) -> DataFrame:
    g = signal_gaps(tracks, 300, None)
    return (g.groupBy(geo.grid("lat", step).alias("lat"), geo.grid("lon", step).alias("lon"))
            .agg(F.count("*").alias("losses"), F.count_distinct("flight_id").alias("flights"), F.sum("gap_s").alias("duration"))
            .where(F.col("losses") >= min_losses)
            .withColumn("score", F.round(F.col("losses") * F.col("flights") * F.col("duration") / 3600, 2))
            .orderBy(F.desc("score"), "lat", "lon").limit(limit))


def bottleneck_cells(tracks: DataFrame, holdings: DataFrame, step: float = 0.5, limit: int = 20) -> DataFrame:
    """Traffic density per cell with holdings; centroid of the points."""
    t = (tracks.groupBy(geo.cell("lat", step).alias("cy"), geo.cell("lon", step).alias("cx"))
         .agg(F.count_distinct("flight_id").alias("flight_count"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"),
              F.avg(F.when(F.col("alt") != 0, F.col("alt"))).alias("_alt"), (F.max("ts") - F.min("ts")).alias("_span")))
    h = holdings.groupBy(geo.cell("lat", step).alias("cy"), geo.cell("lon", step).alias("cx")).agg(F.count("*").alias("holding_count"))
    j = _with_max(t.join(h, ["cy", "cx"], "left").withColumn("holding_count", F.coalesce("holding_count", F.lit(0))), _m="flight_count")
    d = F.least(F.lit(100.0), F.col("flight_count") / F.col("_m") * 50 + F.col("holding_count") * 5)
    s = F.col("_d")
    return (j.where("flight_count >= 2").withColumn("_d", d)
            .select("cy", "cx", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"), "flight_count", "holding_count",
                    F.round(s, 1).alias("density_score"),
                    F.when(s >= 50, "critical").when(s >= 30, "high").when(s >= 15, "moderate").otherwise("low").alias("congestion_level"),
                    F.round(F.coalesce("_alt", F.lit(0.0))).alias("avg_altitude"),
                    F.round(F.col("flight_count") / F.greatest(F.col("_span") / 3600, F.lit(1.0)), 1).alias("flights_per_hour"))
            .orderBy(F.desc("density_score"), "cy", "cx").limit(limit))


def near_miss_map(events: DataFrame, step: float = 0.5, limit: int | None = 50) -> DataFrame:
    """One event per pair and 300 s, counted per cell. ``events``: flight_id, other, ts, distance_nm, altitude_diff_ft, lat, lon."""
    e = events.where("altitude_diff_ft < 1000").withColumns({
        "p1": F.least("flight_id", "other"), "p2": F.greatest("flight_id", "other"), "bucket": F.floor(F.col("ts") / 300)})
    one = e.groupBy("p1", "p2", "bucket").agg(F.min_by(F.struct("lat", "lon", "distance_nm"), F.struct("ts", "flight_id")).alias("e"))
    one = one.select("e.*").where("lat is not null and lon is not null")
    cells = (one.groupBy(geo.grid("lat", step).alias("lat"), geo.grid("lon", step).alias("lon"))
             .agg(F.count("*").alias("count"), F.count_if(F.col("distance_nm") < 1).alias("severity_high"),
                  F.count_if(F.col("distance_nm") >= 1).alias("severity_medium")))
    return cells if limit is None else cells.orderBy(F.desc("count"), "lat", "lon").limit(limit)


def signal_map(interference: DataFrame, losses: DataFrame, limit: int = 50) -> DataFrame:
    """Interference and loss cells in one typed list."""
    a = interference.select(F.lit("interference").alias("type"), "lat", "lon", F.round("intensity", 2).alias("intensity"),
                            F.col("affected_flights").alias("count"))
    v = F.least(F.lit(100.0), F.col("count") * 5 + F.col("avg_duration") / 60)
    b = losses.select(F.lit("signal_loss").alias("type"), "lat", "lon", F.round(v, 2).alias("intensity"), "count")
    return a.unionByName(b).orderBy(F.desc("intensity"), "type", "lat", "lon").limit(limit)


def source_estimate(cells: DataFrame, step: float = 0.5, min_points: int = 2) -> DataFrame:
    """Weighted mean position per coarse cell."""
    w = lambda c: F.round(F.sum(F.col(c) * F.col("intensity")) / F.sum("intensity"), 4)
    return (cells.groupBy(geo.grid("lat", step).alias("cell_lat"), geo.grid("lon", step).alias("cell_lon"))
            .agg(F.count("*").alias("points"), w("lat").alias("est_lat"), w("lon").alias("est_lon"),
                 F.round(F.avg("intensity"), 2).alias("avg_intensity")).where(F.col("points") >= min_points))


def region_counts(zones: DataFrame, region: Column) -> DataFrame:
    return (zones.groupBy(F.coalesce(region, F.lit("Other")).alias("region"))
            .agg(F.count("*").alias("zones"), F.sum("count").alias("events")))
