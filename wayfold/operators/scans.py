"""Scans, source merging and keyed merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators.windows import first_per_key

POINT_TYPES = {"flight_id": "string", "ts": "bigint", "lat": "double", "lon": "double", "alt": "double",
               "gspeed": "double", "vspeed": "double", "track": "double", "squawk": "string",
               "callsign": "string", "source": "string"}


def flight_points(tracks: DataFrame, flight_id: str | Column) -> DataFrame:
    """All points of one flight in time order."""
    return tracks.where(F.col("flight_id") == flight_id).orderBy("ts")


def points_between(tracks: DataFrame, start: int, end: int) -> DataFrame:
    """Points in a closed time interval; a ``date`` partition column is bounded as well."""
    out = tracks.where(F.col("ts").between(start, end))
    if "date" in tracks.columns:
        lo, hi = (F.date_add(F.lit("1970-01-01").cast("date"), int(x // 86400)) for x in (start, end))
        out = out.where(F.col("date").between(lo, hi))
    return out


def flight_list(tracks: DataFrame, min_points: int = 1, limit: int | None = None) -> DataFrame:
    out = (tracks.groupBy("flight_id").agg(F.count("*").alias("points"))
           .where(F.col("points") >= min_points).orderBy(F.desc("points"), "flight_id"))
    return out.limit(limit) if limit else out


def flights_in_box(tracks: DataFrame, south, north, west, east) -> DataFrame:
    return tracks.where(geo.in_box("lat", "lon", south, north, west, east)).select("flight_id").distinct()


def tracks_through_box(tracks: DataFrame, south, north, west, east) -> DataFrame:
    """Whole tracks of every flight with a point in the box."""
    return tracks.join(flights_in_box(tracks, south, north, west, east), "flight_id", "left_semi")


def normalise_points(raw: DataFrame) -> DataFrame:
    """Declared types; unnamed flights become UNKNOWN, missing altitude 0."""
    have = {c: (F.col(c) if c in raw.columns else F.lit(None)).cast(t) for c, t in POINT_TYPES.items()}
    have["flight_id"] = F.coalesce(F.nullif(have["flight_id"], F.lit("")), F.lit("UNKNOWN"))
    have["ts"] = F.coalesce(have["ts"], F.lit(0).cast("bigint"))
    for c in ("lat", "lon", "alt"):
        have[c] = F.coalesce(have[c], F.lit(0.0))
    return raw.select(*[v.alias(k) for k, v in have.items()])


def active_flights(tracks: DataFrame, as_of: int, minutes: int = 15) -> DataFrame:
    """Flights seen in the last minutes, with their last position."""
    recent = tracks.where(F.col("ts").between(as_of - minutes * 60, as_of))
    last = F.max_by(F.struct("lat", "lon", "alt", "callsign"), "ts")
    return (recent.groupBy("flight_id").agg(F.max("ts").alias("last_ts"), F.count("*").alias("points"),
                                            last.alias("p"))
            .select("flight_id", "last_ts", "points", "p.lat", "p.lon", "p.alt", "p.callsign"))


def points_of_active(tracks: DataFrame, as_of: int, minutes: int, start: int, end: int) -> DataFrame:
    live = active_flights(tracks, as_of, minutes).select("flight_id")
    return points_between(tracks, start, end).join(live, "flight_id", "left_semi")


def tagged_union(normal: DataFrame, anomalous: DataFrame) -> DataFrame:
    return (normal.withColumn("track_type", F.lit("normal"))
            .unionByName(anomalous.withColumn("track_type", F.lit("anomaly"))))


def first_hit(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """Per flight the points of the first source that knows it."""
    both = None
    for prio, (name, df) in enumerate(sources):
        part = df.withColumns({"origin_table": F.lit(name), "_prio": F.lit(prio)})
        both = part if both is None else both.unionByName(part)
    best = both.groupBy("flight_id").agg(F.min("_prio").alias("_prio"))
    return both.join(best, ["flight_id", "_prio"], "left_semi").drop("_prio")


def airport_places(raw: DataFrame, order: str) -> DataFrame:
    """Code -> place rows from icao, ident and gps codes; the first row in file order wins."""
    from wayfold.functions.keys import place_text
    clean = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    rows = (raw.select(F.col(order).alias("_o"), *[clean(c).alias(c) for c in (
                "icao_code", "ident", "gps_code", "iso_country", "iso_region", "municipality", "name")])
            .where(F.col("iso_country") != "")
            .withColumn("_codes", F.array("icao_code", "ident", "gps_code"))
            .select("*", F.posexplode("_codes").alias("_i", "code")).where(F.col("code") != ""))
    first = first_per_key(rows.select("code", "_o", "_i", "iso_country", "iso_region", "municipality", "name"),
                          ["code"], [F.col("_o"), F.col("_i")])
    return first.select("code", "iso_country", "iso_region", "municipality", "name",
                        place_text().alias("place"))


def load_airport_places(spark, path: str) -> DataFrame:
    """CSV with a header -> code/place dimension."""
    cols = ["icao_code", "ident", "gps_code", "iso_country", "iso_region", "municipality", "name"]
    raw = spark.read.option("header", True).csv(path)
    raw = raw.select(*[(F.col(c) if c in raw.columns else F.lit(None).cast("string")).alias(c) for c in cols])
    return airport_places(raw.withColumn("_row", F.monotonically_increasing_id()), "_row")


def with_places(flights: DataFrame, places: DataFrame) -> DataFrame:
    """Origin and destination place by upper-trimmed code."""
    from wayfold.operators.nearest import bounded_broadcast
    dim = bounded_broadcast(places.select("code", "place"))
    out = flights
    for side in ("origin", "destination"):
        key = F.upper(F.trim(F.col(f"{side}_airport")))
        d = dim.select(F.col("code").alias(f"_{side}"), F.col("place").alias(f"{side}_place"))
        out = out.join(d, key == F.col(f"_{side}"), "left").drop(f"_{side}")
    return out


# -- keyed merges: plain frames in, merged frame out; see sources.sinks for the writing side
def upsert(existing: DataFrame, updates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Update wins over stored row; among several updates the greatest by ``order`` wins.

    Untouched rows pass by an anti join, so they are neither packed nor aggregated.
    """
    rest = [c for c in existing.columns if c not in keys]
    newest = (updates.select(existing.columns).groupBy(*keys)
              .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
              .select(*keys, *[F.col("_r")[c].alias(c) for c in rest]))
    return existing.join(newest, keys, "left_anti").unionByName(newest)


def insert_new(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``incoming`` whose key is not stored yet, one per key."""
    return incoming.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def last_snapshots(snapshots: DataFrame, keep: int = 3, ts: str = "ts") -> DataFrame:
    """Rows of the latest ``keep`` snapshot times; only distinct times are sorted."""
    times = snapshots.select(ts).distinct().orderBy(F.desc(ts)).limit(keep)
    return snapshots.join(F.broadcast(times), ts, "left_semi")


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """Top k per group. Spark keeps k rows per group on the map side (window group limit)."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
