"""Event rules. Every rule is one frame of event rows over all flights at once.

``enrich`` is computed once and shared: each point gets its neighbours, the nearest
airport and the plausibility tests. Events stay rows; nothing is gathered per flight
except one line per (flight, rule).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold import config as C
from wayfold.functions import geo, keys
from wayfold.operators.hotkeys import join_by_slice
from wayfold.operators.nearest import bounded_rows, nearest_airport, near_places
from wayfold.operators.sweep import first_near
from wayfold.operators.windows import SLICE, first_per_key, with_halo, with_neighbours

c = F.col
z = lambda x: F.coalesce(c(x), F.lit(0.0))


def enrich(tracks: DataFrame, airports: DataFrame) -> DataFrame:
    """Points with neighbours (prev_*, next_*), nearest airport (ap_*) and flags."""
    base = nearest_airport(tracks.select("flight_id", "ts", "lat", "lon", "alt", "gspeed", "vspeed", "track"), airports)
    core = ("ts", "lat", "lon", "alt", "gspeed", "track")
    p = with_neighbours(base, {f"prev_{x}": x for x in core + ("ap_nm", "ap_elev")}, {f"next_{x}": x for x in core},
                        {"prev2_track": "track"})
    return p.withColumn("impossible", impossible()).withColumn("bad", bad_segment())


def impossible(speed_buffer: float = 1.5, turn_s: float = 8.0, climb_s: float = 200.0) -> Column:
    """A point that speed, turn rate or climb rate rules out on either side; ends are never ruled out."""
    def side(other: str, dt: Column) -> Column:
        far = geo.haversine("lat", "lon", f"{other}_lat", f"{other}_lon") > (
            F.greatest(z(f"{other}_gspeed"), z("gspeed"), F.lit(300.0)) * dt / 3600.0 * speed_buffer)
        turn = F.abs(geo.heading_delta("track", f"{other}_track")) / dt > turn_s
        climb = F.abs(c("alt") - c(f"{other}_alt")) / dt > climb_s
        return F.when(dt > 0, F.coalesce(far, F.lit(False)) | F.coalesce(turn, F.lit(False)) | F.coalesce(climb, F.lit(False))).otherwise(False)

    both = c("prev_ts").isNotNull() & c("next_ts").isNotNull()
    return both & (side("prev", c("ts") - c("prev_ts")) | side("next", c("next_ts") - c("ts")))


def bad_segment() -> Column:
    """Step that cannot be trusted: teleport, heading jump, ocean gap, zero altitude at speed."""
    dt = c("ts") - c("prev_ts")
    speed = F.coalesce(F.nullif(c("gspeed"), F.lit(0.0)), F.nullif(c("prev_gspeed"), F.lit(0.0)), F.lit(350.0))
    tests = [dt <= 0, geo.haversine("prev_lat", "prev_lon", "lat", "lon") > speed * dt / 3600 * 3,
             F.abs(geo.heading_delta("track", "prev_track")) > 80,
             (z("alt") > 15000) & (c("ap_nm") > 60), (z("alt") < 200) & (z("gspeed") > 200)]
    out = F.lit(False)
    for t in tests:
        out = out | F.coalesce(t, F.lit(False))
    return c("prev_ts").isNotNull() & out


# -- rule 1
def emergency_squawk(tracks: DataFrame) -> DataFrame:
    return (tracks.where(F.trim("squawk").isin(*C.SQUAWKS))
            .select("flight_id", "ts", F.trim("squawk").alias("squawk"), "lat", "lon", "alt"))


# -- rule 2
def altitude_change(pts: DataFrame) -> DataFrame:
    """Steep altitude steps at cruise, without runs of false low readings."""
    a = C.ALT_CHANGE
    low, dt = c("alt") < 500, c("ts") - c("prev_ts")
    usable = ~c("impossible") & (dt > 0) & (dt <= a["window_s"]) & (c("prev_alt") >= a["cruise_ft"])
    p = pts.select("flight_id", "ts", "lat", "lon", "alt", "gspeed", "ap_nm", "prev_ts", "prev_alt", "next_ts", "next_alt", "impossible")
    runs = _noise_runs(p, low, usable, a["cruise_ft"])
    drop = (runs.select("flight_id", c("run_ts").alias("ts"))
            .unionByName(runs.select("flight_id", c("after_ts").alias("ts"))))
    glitch = ((z("alt") <= 0) & (c("prev_alt") > 500)) | ((c("alt") < 200) & (z("gspeed") > 200) & (c("ap_nm") > 3))
    delta = c("alt") - c("prev_alt")
    ev = p.where(usable & ~glitch & (F.abs(delta) >= a["delta_ft"]))
    return (ev.join(drop, ["flight_id", "ts"], "left_anti")
            .select("flight_id", "ts", "lat", "lon", "alt", F.round(delta, 2).alias("delta_ft"), F.round(delta / dt, 2).alias("rate_ft_per_s")))


def _noise_runs(p: DataFrame, low: Column, usable: Column, cruise: float) -> DataFrame:
    """Runs of two or more low readings between two similar cruise altitudes, under 300 s, away from airports.

    A run starts on a usable step down. Its end is the first low point after the start
    whose successor is not low; that lies within 300 s or the run does not count, so a
    halo of 300 s is enough. ``after_ts`` is the point behind the recovery point: the
    step to it is skipped as well.
    """
    ends = low & ((c("next_alt") >= 500) | c("next_ts").isNull())
    mark = p.withColumns({
        "_start": usable & low, "_end": F.when(ends, F.struct(c("ts").alias("e_ts"), c("next_ts").alias("r_ts"), c("next_alt").alias("r_alt"))),
        "_near": F.when(low & (c("ap_nm") <= 5), c("ts"))})
    # Only low points matter from here on: a small part of the table.
    h = with_halo(mark.where(low), before=0, after=300)
    w = Window.partitionBy("flight_id", SLICE).orderBy("ts").rangeBetween(0, 299)
    r = (h.withColumns({"_e": F.first("_end", True).over(w), "_n": F.first("_near", True).over(w)})
         .where(c("_core") & c("_start") & c("_e").isNotNull()))
    e = c("_e")
    r = r.where((e["e_ts"] > c("ts")) & (c("_n").isNull() | (c("_n") > e["e_ts"])) & (e["r_alt"] >= cruise)
                & (F.abs(e["r_alt"] - c("prev_alt")) < 5000))
    runs = r.select("flight_id", c("ts").alias("run_ts"), c("prev_ts").alias("in_ts"), e["r_ts"].alias("r_ts"))
    nxt = p.select("flight_id", c("prev_ts").alias("r_ts"), c("ts").alias("after_ts"))
    runs = runs.join(nxt, ["flight_id", "r_ts"], "left")
    # A run entered by the very step that the run before it skips is not looked at: of runs
    # chained that way every second one counts. Runs are rare, so they are numbered per flight.
    wf = Window.partitionBy("flight_id").orderBy("run_ts")
    runs = runs.withColumn("_new", F.when(F.coalesce(F.lag("after_ts").over(wf) == c("run_ts"), F.lit(False)), 0).otherwise(1))
    runs = runs.withColumn("_chain", F.sum("_new").over(wf))
    pos = F.row_number().over(Window.partitionBy("flight_id", "_chain").orderBy("run_ts"))
    return runs.withColumn("_pos", pos).where(c("_pos") % 2 == 1).select("flight_id", "run_ts", "after_ts")


# -- rule 4
def proximity(pts: DataFrame, tracks: DataFrame) -> DataFrame:
    """One event per own point, the first other point in time order that is too close."""
    p = C.PROXIMITY
    own = pts.where(~c("impossible") & (c("alt") >= p["min_alt_ft"]) & (c("ap_nm") > p["airport_nm"])).select("flight_id", "ts", "lat", "lon", "alt")
    other = tracks.where(c("alt") >= p["min_alt_ft"]).select("flight_id", "ts", "lat", "lon", "alt", "callsign")
    found = first_near(own, other, p["nm"], p["sync_s"], p["alt_ft"])
    return found.select("flight_id", "ts", "lat", "lon", "alt", c("b_flight_id").alias("other"), c("b_callsign").alias("other_callsign"),
                        F.round("nm", 2).alias("distance_nm"), F.round(F.abs(c("alt") - c("b_alt")), 1).alias("altitude_diff_ft"))


# -- rule 6
def near_airports(pts: DataFrame, airports: DataFrame, nm: float, keep: list[str], inline_rows: int = C.INLINE_DIM_ROWS) -> DataFrame:
    """(point, airport) rows within a radius; a short airport list is matched in place, a longer one by a join on cells."""
    rows = bounded_rows(airports, inline_rows)
    if rows is None:
        listed, met = near_places(pts, airports.select("code", "lat", "lon", "elevation_ft"), nm)
        close = met & (geo.haversine("lat", "lon", c("_p_lat"), c("_p_lon")) <= nm)
        return pts.join(listed, close).select(*keep, c("_p_code").alias("airport"), F.coalesce("_p_elevation_ft", F.lit(0)).alias("elev"))
    deg = nm / 59.0
    lits = F.array(*[F.struct(F.lit(r["code"]).alias("code"), F.lit(float(r["lat"])).alias("lat"), F.lit(float(r["lon"])).alias("lon"),
                              F.lit(int(r["elevation_ft"] or 0)).alias("elev")) for r in rows])
    hit = F.filter(lits, lambda a: (F.abs(c("lat") - a["lat"]) <= deg)
                   & (geo.haversine("lat", "lon", a["lat"], a["lon"]) <= nm))
    return pts.withColumn("_a", F.explode(hit)).select(*keep, c("_a")["code"].alias("airport"), c("_a")["elev"].alias("elev"))


def runway_aligned(heading: str = "track", airport: str = "airport", tolerance: float = 30) -> Column:
    """Heading within tolerance of a runway direction; airports without directions pass."""
    table = F.create_map(*[x for k, v in C.RUNWAYS.items() for x in (F.lit(k), F.array(*[F.lit(float(h)) for h in v]))])
    dirs = F.try_element_at(table, c(airport))
    return F.when(dirs.isNull(), True).otherwise(F.exists(dirs, lambda h: geo.heading_diff(c(heading), h) <= tolerance))


def go_around(pts: DataFrame, airports: DataFrame) -> DataFrame:
    """Lowest aligned low point near an airport with a descent before and a climb after."""
    g = C.GO_AROUND
    near = near_airports(pts, airports, g["nm"], ["flight_id", "ts", "lat", "lon", "alt", "track", "impossible"])
    near = near.withColumn("pair", F.concat_ws("|", "flight_id", "airport"))
    seg = with_neighbours(near, {"p_ts": "ts", "p_alt": "alt"}, {"n_ts": "ts", "n_alt": "alt"}, key="pair")
    seg = _max_before_after(seg, "alt", key="pair")
    jump = lambda o: F.coalesce(F.abs(c("alt") - c(f"{o}_alt")) / F.abs(c("ts") - c(f"{o}_ts")) > 200, F.lit(False))
    agl = c("alt") - c("elev")
    drop, climb = c("max_before") - c("alt"), c("max_after") - c("alt")
    enough = near.groupBy("pair").agg(F.count("*").alias("_n")).where("_n >= 3").select("pair")
    ok = seg.where(~c("impossible") & ~jump("p") & ~jump("n") & (agl >= g["below_ft"]) & (agl <= g["low_ft"] + g["buffer_ft"])
                   & runway_aligned() & (drop >= g["descent_ft"]) & (climb >= g["recovery_ft"]))
    ok = ok.join(enough, "pair", "left_semi")
    best = F.min_by(F.struct("ts", "lat", "lon", c("alt").alias("min_alt_ft"), F.round(climb, 1).alias("recovered_ft"),
                             F.round(drop, 1).alias("descent_into_low_ft")), F.struct("alt", "ts"))
    return ok.groupBy("flight_id", "airport").agg(best.alias("b")).select("flight_id", "airport", "b.*")


def _max_before_after(df: DataFrame, col: str, key: str, ts: str = "ts", width: int = C.SLICE_S) -> DataFrame:
    """Greatest value strictly before and strictly after each row of its key, by slices."""
    d = df.withColumn(SLICE, F.floor(c(ts) / width))
    w, wk = Window.partitionBy(key, SLICE).orderBy(ts), Window.partitionBy(key).orderBy(SLICE)
    tot = (d.groupBy(key, SLICE).agg(F.max(col).alias("_m"))
           .select(c(key).alias("_kk"), c(SLICE).alias("_ss"), F.max("_m").over(wk.rowsBetween(Window.unboundedPreceding, -1)).alias("_b"),
                   F.max("_m").over(wk.rowsBetween(1, Window.unboundedFollowing)).alias("_a")))
    return (d.withColumns({"_lb": F.max(col).over(w.rowsBetween(Window.unboundedPreceding, -1)),
                           "_la": F.max(col).over(w.rowsBetween(1, Window.unboundedFollowing))})
            .join(tot, (c(key) == c("_kk")) & (c(SLICE) == c("_ss")), "left")
            .withColumns({"max_before": F.greatest("_b", "_lb"), "max_after": F.greatest("_a", "_la")})
            .drop("_lb", "_la", "_kk", "_ss", "_b", "_a", SLICE))


# -- rule 7
def return_to_field(pts: DataFrame) -> DataFrame:
    """Back near the origin and low, two to ten minutes after take-off, having been away."""
    r = C.RETURN
    first = (pts.groupBy("flight_id").agg(F.min_by(F.struct("ap_code", "ap_nm", "ap_elev", "ap_lat", "ap_lon"), "ts").alias("o"), F.count("*").alias("n"))
             .where((c("n") >= 4) & (c("o.ap_nm") <= r["nm"]))
             .select("flight_id", c("o.ap_code").alias("airport"), c("o.ap_elev").alias("elev"), c("o.ap_lat").alias("hlat"), c("o.ap_lon").alias("hlon")))
    p = pts.select("flight_id", "ts", "lat", "lon", "alt", "impossible")
    p = join_by_slice(p, first, C.SLICE_S)
    p = p.withColumn("home_nm", geo.haversine("lat", "lon", "hlat", "hlon"))
    take = p.where(z("alt") >= c("elev") + r["takeoff_ft"]).groupBy("flight_id").agg(F.min("ts").alias("takeoff_ts"))
    q = join_by_slice(p, take, C.SLICE_S, slices_of=pts)
    out = q.where(c("ts") >= c("takeoff_ts")).groupBy("flight_id").agg(F.max("home_nm").alias("max_outbound_nm"))
    dt = c("ts") - c("takeoff_ts")
    back = q.where(~c("impossible") & (z("alt") < c("elev") + r["landing_ft"]) & (c("home_nm") <= r["nm"]) & dt.between(r["min_s"], r["max_s"]))
    hit = back.groupBy("flight_id").agg(F.min("ts").alias("landing_ts"), F.min("takeoff_ts").alias("takeoff_ts"), F.first("airport").alias("airport"))
    return (hit.join(out.where(c("max_outbound_nm") >= r["outbound_nm"]), "flight_id")
            .select("flight_id", "airport", "takeoff_ts", "landing_ts", (c("landing_ts") - c("takeoff_ts")).alias("elapsed_s"), "max_outbound_nm"))


# -- rules 8 and 12
def last_airport(tracks: DataFrame, airports: DataFrame) -> DataFrame:
    last = (tracks.groupBy("flight_id").agg(F.max_by(F.struct("lat", "lon"), "ts").alias("p"), F.max("ts").alias("ts"))
            .select("flight_id", "ts", "p.lat", "p.lon"))
    return nearest_airport(last, airports)


def diversion(last: DataFrame, meta: DataFrame, airports: DataFrame) -> DataFrame:
    """Rule 8: ended at another airport than planned, or away from any. Plans outside the list are skipped."""
    plan = meta.where("destination_airport is not null").select("flight_id", F.upper("destination_airport").alias("planned"))
    known = airports.select(c("code").alias("planned"))
    j = last.join(plan.join(known, "planned", "left_semi"), "flight_id")
    away = c("ap_nm") > C.DIVERSION_NM
    return (j.where(away | (c("ap_code") != c("planned")))
            .select("flight_id", "ts", "lat", "lon", "planned", F.when(~away, c("ap_code")).alias("actual"), F.round("ap_nm", 2).alias("distance_nm")))


def unplanned_landing(last: DataFrame, meta: DataFrame) -> DataFrame:
    """Rule 12: landed at an airport other than the planned one."""
    plan = meta.where("destination_airport is not null and destination_airport <> ''").select("flight_id", F.upper("destination_airport").alias("planned"))
    return (last.join(plan, "flight_id").where((c("ap_nm") <= C.UNPLANNED_NM) & (c("ap_code") != c("planned")))
            .select("flight_id", "ts", "lat", "lon", "planned", c("ap_code").alias("actual"), F.round("ap_nm", 2).alias("distance_nm")))


# -- rule 9
def low_altitude(pts: DataFrame) -> DataFrame:
    """Low flight outside airport zones, after filters for climbs, approaches, flickers and glitches."""
    alt, speed, vs, nm = z("alt"), z("gspeed"), z("vspeed"), c("ap_nm")
    dt, before = c("ts") - c("prev_ts"), z("prev_alt")
    had = c("prev_ts").isNotNull()
    t = lambda x: F.coalesce(x, F.lit(False))
    skip = (c("impossible") | (vs > 300) | t(had & (before < 50) & (dt < 60)) | ((nm < 25) & (vs > 0)) | ((alt < 200) & (nm > 15))
            | ((alt < 800) & (speed > 200) & (nm > 10)) | t(had & (dt > 0) & ((before - alt) / dt > 100) & (nm > 10)))
    flicker = t(z("next_alt") >= C.LOW_ALT["ft"]) & c("next_ts").isNotNull()
    closer = t(nm < geo.haversine("prev_lat", "prev_lon", "ap_lat", "ap_lon"))
    down = t(had & ((before > alt) | closer))
    approach = ((nm > 0) & (nm <= 40) & (vs < 0) & t(geo.heading_diff(geo.bearing("lat", "lon", "ap_lat", "ap_lon"), "track") <= 45)
                & speed.between(90, 200) & down)
    return (pts.where((alt < C.LOW_ALT["ft"]) & ~skip & ~flicker & (nm > C.LOW_ALT["airport_nm"]) & ~approach)
            .select("flight_id", "ts", "lat", "lon", F.round(alt, 1).alias("alt_ft"), speed.alias("speed_kts"),
                    F.round(nm, 1).alias("distance_to_airport_nm"), vs.alias("vspeed_fpm")))


# -- rule 10
def signal_loss(pts: DataFrame) -> DataFrame:
    """Flights with repeated gaps in the air: one row per gap."""
    agl = lambda p: z(f"{p}alt") - F.when(c(f"{p}ap_nm") < 10, c(f"{p}ap_elev")).otherwise(0)
    gap = c("ts") - c("prev_ts")
    g = (pts.where((gap >= C.SIGNAL["gap_s"]) & (agl("prev_") >= 300) & (agl("") >= 300))
         .select("flight_id", c("prev_ts").alias("start_ts"), c("ts").alias("end_ts"), gap.alias("gap_s"), "lat", "lon"))
    enough = g.groupBy("flight_id").agg(F.count("*").alias("n")).where(c("n") >= C.SIGNAL["repeat"]).select("flight_id")
    return g.join(enough, "flight_id", "left_semi")


# -- rule 13
def military(tracks: DataFrame, meta: DataFrame) -> DataFrame:
    """First callsign, registration or category points to a military organisation."""
    first = tracks.where("callsign is not null and callsign <> ''").groupBy("flight_id").agg(F.min_by("callsign", "ts").alias("cs"))
    j = first.join(meta.select("flight_id", "category"), "flight_id", "left")
    org = keys.military_org("cs", None, "category")
    return j.withColumn("organization", org).where("organization is not null").select(
        "flight_id", c("cs").alias("callsign"), "organization", keys.military_role("organization").alias("role"))


# -- assembly
def one_frame(rules: dict[int, DataFrame]) -> DataFrame:
    """All rule frames as (flight_id, rule_id, ts); ts may be null."""
    out = None
    for rid, df in rules.items():
        ts = next((n for n in ("ts", "landing_ts", "end_ts") if n in df.columns), None)
        part = df.select("flight_id", F.lit(rid).alias("rule_id"), (c(ts) if ts else F.lit(None)).cast("bigint").alias("ts"))
        out = part if out is None else out.unionByName(part)
    return out


def evaluations(flights: DataFrame, hits: DataFrame, rule_ids: list[int]) -> DataFrame:
    """One row per (flight, asked rule): matched or not; ids without a rule are not matched."""
    asked = flights.select("flight_id", F.explode(F.array(*[F.lit(i) for i in rule_ids])).alias("rule_id"))
    n = hits.groupBy("flight_id", "rule_id").agg(F.count("*").alias("events"), F.min("ts").alias("first_ts"))
    known = c("rule_id").isin(*C.RULES)
    return asked.join(n, ["flight_id", "rule_id"], "left").select(
        "flight_id", "rule_id", c("events").isNotNull().alias("matched"), F.coalesce("events", F.lit(0)).alias("events"), "first_ts",
        F.when(~known, "Rule not implemented").when(c("events").isNotNull(), "matched").otherwise("nominal").alias("summary"))


def report(evals: DataFrame) -> DataFrame:
    """Per flight the matched rules: at most one entry per rule, so the list is bounded."""
    m = F.when(c("matched"), F.struct("rule_id", "events", "first_ts"))
    return evals.groupBy("flight_id").agg(F.count("*").alias("total_rules"), F.count_if("matched").alias("n_matched"),
                                          F.array_sort(F.collect_list(m)).alias("matched_rules"))


def confidence(layers: DataFrame) -> DataFrame:
    """Weighted vote: rules 6.0, every model layer 0.5, over 6.0; anomaly from 80 %."""
    models = ["xgboost", "cnn", "dense", "transformer", "hybrid"]
    hit = lambda x: F.coalesce(c(x), F.lit(False)).cast("int")
    s = hit("rules") * 6.0
    for m in models:
        s = s + hit(m) * 0.5
    return (layers.withColumn("confidence_score", F.round(F.least(F.lit(1.0), s / 6.0) * 100, 2))
            .withColumn("is_anomaly", c("confidence_score") >= 80.0))
