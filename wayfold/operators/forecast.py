"""Short predictions, conflicts and forecasts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions import geo, keys
from wayfold.operators.history import closest_points, history_sums
from wayfold.operators.hotkeys import join_balanced
from wayfold.operators.stats import distinct_if, in_rules
from wayfold.operators.windows import running_sum, with_neighbours

c = F.col

# Restricted boxes (south, north, west, east), in test order.
RESTRICTED = [("Lebanese Airspace", 33.05, 34.65, 35.1, 36.6), ("Syrian Airspace", 32.3, 37.3, 35.7, 42.4)]


def kinematic(latest: DataFrame, boxes=None, step: int = 15, horizon: int = 300) -> DataFrame:
    """Straight-line positions every 15 s to 300 s with the first box entered at each."""
    boxes = RESTRICTED if boxes is None else boxes
    p = latest.withColumn("offset_s", F.explode(F.sequence(F.lit(step), F.lit(horizon), F.lit(step))))
    nm = c("gspeed") * c("offset_s") / 3600
    p = p.withColumns({"plat": c("lat") + nm * F.cos(F.radians("track")) / 60,
                       "plon": c("lon") + nm * F.sin(F.radians("track")) / (60 * F.cos(F.radians("lat")))})
    zone = F.when(F.lit(False), "")
    for name, s, n, w, e in boxes:
        zone = zone.when(geo.in_box("plat", "plon", s, n, w, e), name)
    return p.withColumn("zone", zone).withColumn("severity", F.when(c("zone").isNotNull(), F.when(c("offset_s") < 120, "critical").otherwise("warning")))


def prediction_confidence() -> Column:
    sp, al = F.coalesce(c("gspeed"), F.lit(0.0)), F.coalesce(c("alt"), F.lit(0.0))
    v = (0.5 + F.when(sp.between(150, 550), 0.2).when(sp.between(50, 700), 0.1).otherwise(0.0)
         + F.when(al > 20000, 0.15).when(al > 10000, 0.1).when(al > 5000, 0.05).otherwise(0.0) + F.when(c("track").isNotNull(), 0.1).otherwise(0.0)
         + F.when((c("lat") != 0) & (c("lon") != 0) & (sp != 0), 0.05).otherwise(0.0))
    return F.least(F.lit(0.95), F.round(v, 2))


def dead_reckoning(latest: DataFrame, step_min: int = 5, horizon_min: int = 60) -> DataFrame:
    """Great-circle positions of all traffic every 5 minutes to an hour."""
    p = latest.withColumn("minutes", F.explode(F.sequence(F.lit(0), F.lit(horizon_min), F.lit(step_min))))
    d = geo.destination("lat", "lon", "track", c("gspeed") * c("minutes") / 60)
    return p.withColumn("_d", d).select("flight_id", "minutes", c("_d.lat").alias("lat"), c("_d.lon").alias("lon"), "alt")


def severity(nm, ft, limit_nm: float = 5.0, limit_ft: float = 1000.0) -> Column:
    """critical, warning, caution within one, two, three times the limits."""
    def within(k):
        return (nm <= limit_nm * k) & (ft <= limit_ft * k)
    return F.when(within(1), "critical").when(within(2), "warning").when(within(3), "caution")


def _beside(lat, lon, blat, blon, nm: float) -> Column:
    """False for most positions further apart than nm, without a distance; never for nearer ones. Says nothing of longitude near the poles."""
    g = nm / 59.5
    wide = F.when(F.abs(lat) > 85, 400.0).otherwise(F.when(F.abs(lat) > 60, 1.01 * g / math.cos(math.radians(85 + g))).otherwise(1.01 * g / math.cos(math.radians(60 + g))))
    return (F.abs(c(lat) - c(blat)) <= g) & (F.abs(c(lon) - c(blon)) <= wide)


def _near(lat, lon, blat, blon, nm: float) -> Column:
    """Whether positions are within nm. Distances of the others are not worked out: of ``x and y``, Spark first evaluates what recurs in y."""
    return F.when(_beside(lat, lon, blat, blon, nm), geo.haversine(lat, lon, blat, blon) <= nm).otherwise(False)


def _meeting(plans: DataFrame, traffic: DataFrame, nm: float, earlier: Column | None = None) -> DataFrame:
    """Pairs of the same minutes within nm and 2000 ft by cells, with kind; columns of ``traffic`` are prefixed with b. ``earlier``: drop those."""
    g = nm / 59.5
    wide = lambda band: g / F.cos(F.radians(F.least(F.abs(band) + 2, F.lit(88))))
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    a = plans.withColumns({"_b": F.floor("lat"), "_y": F.floor(c("lat") / g)}).withColumn("_x", F.floor(c("lon") / wide(c("_b"))))
    b = traffic.withColumnsRenamed({x: f"b{x}" for x in traffic.columns if x not in ("flight_id", "minutes")})
    b = b.withColumn("_b", F.explode(F.array_distinct(F.array(F.floor(c("blat") - g), F.floor("blat"), F.floor(c("blat") + g)))))
    b = b.withColumn("_y", F.explode(F.transform(near, lambda d: F.floor(c("blat") / g) + d)))
    b = b.withColumn("_x", F.explode(F.transform(near, lambda d: F.floor(c("blon") / wide(c("_b"))) + d)))
    ft = F.abs(c("alt") - c("balt"))
    j = join_balanced(a, b, ["minutes", "_b", "_y", "_x"]).where((c("plan_id") != c("flight_id")) & (ft <= 2000) & _near("lat", "lon", "blat", "blon", nm))
    j = j.withColumns({"nm": geo.haversine("lat", "lon", "blat", "blon"), "ft": ft})
    if earlier is not None:
        j = j.where(~earlier)
    kind = F.when((c("nm") <= 2.5) & (c("ft") <= 500), "critical").when((c("nm") <= 5) & (c("ft") <= 1000), "conflict").otherwise("warning")
    return j.select("plan_id", "flight_id", "minutes", "nm", "ft", kind.alias("kind"))


def conflicts(plans: DataFrame, traffic: DataFrame) -> DataFrame:
    """Planned points against predicted traffic at the same step: 5 nm / 1000 ft, 10 / 2000; critical 2.5 / 500.

    ``plans``: plan_id, minutes, lat, lon, alt; ``traffic``: flight_id, minutes, lat, lon, alt.
    """
    return _meeting(plans.select("plan_id", "minutes", "lat", "lon", "alt"), traffic.select("flight_id", "minutes", "lat", "lon", "alt"), 10.0)


def first_conflicts_of(predicted: DataFrame, step_min: int = 5, horizon_min: int = 60) -> DataFrame:
    """``first_conflicts`` of all flights of ``dead_reckoning``, each of which keeps its altitude, without a shuffle of pairs.

    Every row has the positions of its flight at earlier steps, so that a pair tells by itself whether it is its first.
    """
    steps = range(0, horizon_min, step_min)
    known = lambda x, m: F.max(F.when(c("minutes") == m, c(x)))
    past = predicted.groupBy("flight_id").agg(*[known(x, m).alias(f"{x}_{m}") for m in steps for x in ("lat", "lon")])
    p = predicted.select("flight_id", "minutes", "lat", "lon", "alt").join(past, "flight_id")
    p = p.withColumns({f"{x}_{m}": F.when(c("minutes") > m, c(f"{x}_{m}")) for m in steps for x in ("lat", "lon")})
    earlier = F.lit(False)
    for m in reversed(steps):
        earlier = earlier | F.coalesce(_near(f"lat_{m}", f"lon_{m}", f"blat_{m}", f"blon_{m}", 10.0), F.lit(False))
    return _meeting(p.withColumnRenamed("flight_id", "plan_id"), p, 10.0, earlier)


def first_conflicts(found: DataFrame) -> DataFrame:
    """Earliest conflict of each (plan, flight), most severe first at equal time."""
    rank = F.when(c("kind") == "critical", 0).when(c("kind") == "conflict", 1).otherwise(2)
    best = F.min_by(F.struct("minutes", "nm", "ft", "kind"), F.struct("minutes", rank.alias("r"), "nm"))
    return found.groupBy("plan_id", "flight_id").agg(best.alias("b")).select("plan_id", "flight_id", "b.*")


def interpolate_route(waypoints: DataFrame, every_s: int = 60, default_kt: float = 250.0) -> DataFrame:
    """Positions every n seconds along a waypoint list. ``waypoints``: route, seq, lat, lon, alt, speed_kt.

    A whole track may be a route, so neighbours and times go through slices of ``seq``.
    """
    s = with_neighbours(waypoints, nxt={f"n_{x}": x for x in ("lat", "lon", "alt", "speed_kt")}, key="route", ts="seq").where("n_lat is not null")
    kt = (F.coalesce("speed_kt", F.lit(default_kt)) + F.coalesce("n_speed_kt", F.lit(default_kt))) / 2
    s = s.withColumns({"nm": geo.haversine("lat", "lon", "n_lat", "n_lon"), "brg": geo.bearing("lat", "lon", "n_lat", "n_lon"), "kt": kt})
    s = s.withColumn("dur", c("nm") / c("kt") * 3600)
    # A leg starts at the very number at which the one before ends, so that no instant falls between them.
    s = with_neighbours(running_sum(s, {"t1": c("dur")}, key="route", ts="seq"), prev={"t0": "t1"}, key="route", ts="seq")
    s = s.withColumn("t0", F.coalesce("t0", F.lit(0.0)))
    k0, k1 = F.ceil(F.round(c("t0") / every_s, 9)), F.ceil(F.round(c("t1") / every_s, 9)) - 1
    p = s.where(k1 >= k0).withColumn("k", F.explode(F.sequence(k0, k1)))
    f = (c("k") * every_s - c("t0")) / c("dur")
    d = geo.destination("lat", "lon", "brg", c("nm") * f)
    return p.withColumn("_d", d).select("route", (c("k") * every_s).alias("t_s"), c("_d.lat").alias("lat"), c("_d.lon").alias("lon"),
                                        (c("alt") + f * (c("n_alt") - c("alt"))).alias("alt"))


def airspace_risk(tracks: DataFrame, anomalies: DataFrame, as_of: int, weather: float = 0.0) -> DataFrame:
    """Traffic (30), anomalies (40), hour (15), trend (15) and an optional weather term; levels 75/50/25."""
    day = 86400
    t = tracks.where(c("ts").between(as_of - 3600, as_of)).agg(F.count_distinct("flight_id").alias("traffic"), F.lit(1).alias("_k"))
    a = anomalies.where(c("ts").between(as_of - 2 * day, as_of)).agg(
        distinct_if(c("ts") >= as_of - 3600).alias("recent"), distinct_if(c("ts") >= as_of - day).alias("today"),
        distinct_if(c("ts") < as_of - day).alias("yesterday"), F.lit(1).alias("_k"))
    hour = as_of % day // 3600
    time_score = 15 if hour in (6, 7, 8, 17, 18, 19) else 3 if hour < 6 else 8
    ratio = c("today") / F.greatest(c("yesterday"), F.lit(1))
    trend = F.when(ratio > 1, F.least(F.lit(15.0), (ratio - 1) * 15)).otherwise(0.0)
    s = F.round(F.least(F.lit(30.0), c("traffic") * 0.5) + F.least(F.lit(40), c("recent") * 8) + time_score + trend + weather * 0.15, 1)
    return (t.join(a, "_k").drop("_k").withColumn("risk_score", s)
            .withColumn("risk_level", F.when(c("risk_score") >= 75, "critical").when(c("risk_score") >= 50, "high").when(c("risk_score") >= 25, "medium").otherwise("low")))


def safety_forecast(hits: DataFrame, as_of: int, hours: int = 24) -> DataFrame:
    """Expected events per hour ahead: hourly mean over 30 days, times the 7-day against 23-day rate."""
    day = 86400
    h = hits.where(c("ts").between(as_of - 30 * day, as_of))
    per = h.groupBy(keys.hour_of().alias("hour")).agg(
        F.count("*").alias("n"), *[F.count_if(in_rules(k)).alias(v) for k, v in ((6, "ga"), (4, "nm"), (1, "em"))])
    rate = h.agg(distinct_if(c("ts") >= as_of - 7 * day).alias("r"), distinct_if(c("ts") < as_of - 7 * day).alias("o"), F.count("*").alias("total"), F.lit(1).alias("_k"))
    ratio = F.when(c("o") > 0, (c("r") / 7) / (c("o") / 23)).otherwise(1.0)
    start = as_of % day // 3600
    spine_ = hits.sparkSession.range(hours).select(c("id").cast("int").alias("offset"), ((c("id") + start) % 24).cast("int").alias("hour"), F.lit(1).alias("_k"))
    j = spine_.join(per, "hour", "left").join(rate, "_k").na.fill(0, ["n", "ga", "nm", "em"])
    kinds = c("ga") + c("nm") + c("em")
    exp = c("n") / 30 * ratio
    base = F.when(c("total") > 0, c("total") / 720).otherwise(0.1)
    share = lambda x, d: F.greatest(F.lit(0), F.bround(exp * F.when(kinds > 0, c(x) / kinds).otherwise(d)).cast("int"))
    return j.select("offset", "hour", F.round(exp, 2).alias("expected_total"), share("ga", 0.6).alias("expected_go_arounds"), share("nm", 0.3).alias("expected_near_miss"),
                    share("em", 0.1).alias("expected_emergency"), F.when(exp > base * 1.5, "high").when(exp > base, "medium").otherwise("low").alias("risk_level"),
                    F.round(F.greatest(F.lit(0.5), 1.0 - c("offset") / hours * 0.4), 2).alias("confidence"))


def closest_history(queries: DataFrame, history: DataFrame, km: float = 5.0) -> DataFrame:
    """Per query point and historic flight the closest historic point within km.

    ``queries``: qid, flight_id, lat, lon, ...; ``history``: flight_id, ts, lat, lon, gspeed, vspeed.
    """
    return closest_points(queries, history, km)


def history_test(queries: DataFrame, history: DataFrame, least: int = 3, z: float = 2.5758293) -> DataFrame:
    """Speed and vertical speed against the closest points of nearby historic flights: two-tailed p < 0.01, spread above 1."""
    s = history_sums(queries, history)
    j = queries.join(s, "qid", "left").withColumn("tracks", F.coalesce("tracks", F.lit(0)))
    warn = lambda x: F.when(c("tracks") >= least, F.coalesce((c(f"s_{x}") > 1) & (F.abs(c(x) - c(f"m_{x}")) / c(f"s_{x}") > z), F.lit(False)))
    return j.select("qid", "flight_id", "tracks", warn("gspeed").alias("gspeed_warning"), warn("vspeed").alias("vspeed_warning"))
