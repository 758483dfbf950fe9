"""Nearest-of and within-radius joins against a dimension of places.

Small dimensions (checked row count) become expressions, so there is no join at all.
Larger ones go through grid cells: an equi join on cells, then the exact test.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold import config as C
from wayfold.functions import geo
from wayfold.operators.places import nearest_place
from wayfold.operators.windows import cut

DENSE_BLOCK = 256       # airports of a block that are packed into one row


def bounded_rows(dim: DataFrame, limit: int):
    """Rows of a dimension if it has at most ``limit``, else None. Reads limit + 1 rows at most."""
    rows = dim.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def bounded_broadcast(dim: DataFrame, limit: int = C.BROADCAST_DIM_ROWS) -> DataFrame:
    """Broadcast hint only for a side whose size was checked; otherwise left to AQE."""
    return F.broadcast(dim) if dim.limit(limit + 1).count() <= limit else dim


def nearest_airport(df: DataFrame, airports: DataFrame, prefix: str = "ap", lat: str = "lat",
                    lon: str = "lon", inline_rows: int = C.INLINE_DIM_ROWS) -> DataFrame:
    """Add {prefix}_code, _nm, _elev, _lat, _lon of the closest airport (list order breaks ties)."""
    rows = bounded_rows(airports, inline_rows)
    if rows is not None:
        if len(rows) <= 24:      # unrolled: stays in generated code
            cands = [_ranked(r, lat, lon) for r in rows]
            best = F.least(*cands) if len(cands) > 1 else cands[0]
        else:                    # one literal array: keeps the generated method small
            lits = F.array(*[_literal(r) for r in rows])
            best = F.array_min(F.transform(lits, lambda c: F.struct(
                geo.half_chord(lat, lon, c["lat"], c["lon"]).alias("a"), c["ord"].alias("ord"),
                c["code"].alias("code"), c["elev"].alias("elev"), c["lat"].alias("lat"), c["lon"].alias("lon"))))
        df = df.withColumn("_b", best)
    else:
        df = _nearest_by_cells(df, airports, lat, lon)
    b = F.col("_b")
    return df.withColumns({
        f"{prefix}_code": b["code"], f"{prefix}_nm": geo.chord_to_distance(b["a"]),
        f"{prefix}_elev": b["elev"], f"{prefix}_lat": b["lat"], f"{prefix}_lon": b["lon"]}).drop("_b")


def _ranked(r, lat, lon) -> Column:
    return F.struct(geo.half_chord(lat, lon, float(r["lat"]), float(r["lon"])).alias("a"),
                    F.lit(int(r["ord"])).alias("ord"), F.lit(r["code"]).alias("code"),
                    F.lit(int(r["elevation_ft"] or 0)).alias("elev"),
                    F.lit(float(r["lat"])).alias("lat"), F.lit(float(r["lon"])).alias("lon"))


def _literal(r) -> Column:
    return F.struct(F.lit(int(r["ord"])).alias("ord"), F.lit(r["code"]).alias("code"),
                    F.lit(int(r["elevation_ft"] or 0)).alias("elev"),
                    F.lit(float(r["lat"])).alias("lat"), F.lit(float(r["lon"])).alias("lon"))


def _nearest_by_cells(df: DataFrame, airports: DataFrame, lat: str, lon: str, dense: int = DENSE_BLOCK) -> DataFrame:
    """Exact nearest for a large dimension: equi joins on cells of 1, 5 and 20 degrees, then the tree of cells.

    At each level an airport is listed in its cell and the eight around it, so a point
    whose best listed distance is below the way out of that block has its true nearest.
    Blocks of more than ``dense`` airports are not listed. Points in these, and points far
    from all airports, are settled by ``places.nearest_place``, once for each position.
    """
    ap = airports.where("lat is not null and lon is not null").select(
        "ord", "code", F.coalesce("elevation_ft", F.lit(0)).alias("elev"), F.col("lat").alias("alat"), F.col("lon").alias("alon"))
    best_type = "struct<a:double,ord:int,code:string,elev:int,lat:double,lon:double>"
    out = df.withColumn("_b", F.lit(None).cast(best_type))
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    for g in (1, 5, 20):
        n = 360 // g
        cy = lambda c: F.floor(F.col(c) / g).cast("int")
        cx = lambda c: F.pmod(F.floor((F.col(c) + 180.0) / g), F.lit(n)).cast("int")
        listed = (ap.withColumns({"_ay": cy("alat"), "_ax": cx("alon")})
                  .withColumn("_dy", F.explode(near)).withColumn("_dx", F.explode(near)))
        listed = listed.select(
            (F.col("_ay") + F.col("_dy")).alias("_ky"), F.pmod(F.col("_ax") + F.col("_dx"), F.lit(n)).alias("_kx"),
            F.struct("ord", "code", "elev", "alat", "alon").alias("_c"))
        few = listed.groupBy("_ky", "_kx").count().where(F.col("count") <= dense).drop("count")
        packed = listed.join(few, ["_ky", "_kx"]).groupBy("_ky", "_kx").agg(F.collect_list("_c").alias("_cand"))
        found = F.array_min(F.transform("_cand", lambda c: F.struct(
            geo.half_chord(lat, lon, c["alat"], c["alon"]).alias("a"), c["ord"].alias("ord"),
            c["code"].alias("code"), c["elev"].alias("elev"), c["alat"].alias("lat"), c["alon"].alias("lon"))))
        way_out = 0.99 * C.EARTH_NM * F.least(
            F.lit(math.radians(g)), F.asin(math.sin(math.radians(g)) * F.cos(F.radians(F.col(lat)))))
        hit = F.when(geo.chord_to_distance(F.col("_f")["a"]) <= way_out, F.col("_f"))
        out = (out.withColumns({"_py": cy(lat), "_px": cx(lon)})
               .join(packed, (F.col("_py") == F.col("_ky")) & (F.col("_px") == F.col("_kx"))
                     & F.col("_b").isNull(), "left")
               .withColumn("_f", found).withColumn("_b", F.coalesce("_b", hit))
               .drop("_py", "_px", "_ky", "_kx", "_cand", "_f"))
    out = cut(out)                  # read twice below
    rest = nearest_place(out.where("_b is null").select(F.col(lat).alias("lat"), F.col(lon).alias("lon")), ap.select(
        "ord", "code", "elev", F.col("alat").alias("lat"), F.col("alon").alias("lon")))
    rest = rest.select(F.col("lat").alias("_rlat"), F.col("lon").alias("_rlon"), F.col("best").alias("_r"))
    return (out.join(rest, F.col("_b").isNull() & (F.col(lat) == F.col("_rlat")) & (F.col(lon) == F.col("_rlon")), "left")
            .withColumn("_b", F.coalesce("_b", "_r")).drop("_rlat", "_rlon", "_r"))


def near_places(points: DataFrame, places: DataFrame, nm: float, lat: str = "lat", lon: str = "lon") -> tuple[DataFrame, Column]:
    """Places listed in every cell from which they can be within ``nm``, and the cells of a point as a join condition.

    Cells are ``nm`` high and, by latitude band, at least as wide, so a place is listed in its own cell and the eight
    around it: nine rows for each place, whatever their number.
    """
    g = nm / 59.0
    width = lambda band: g / F.greatest(F.lit(0.05), F.cos(F.radians(F.least(F.lit(89.0), (F.abs(band) + 2) * g))))
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    listed = places.select(*[F.col(x).alias(f"_p_{x}") for x in places.columns])
    listed = listed.withColumn("_by", F.explode(F.transform(around, lambda d: F.floor(F.col("_p_lat") / g) + d)))
    listed = listed.withColumn("_bx", F.explode(F.transform(around, lambda d: F.floor(F.col("_p_lon") / width(F.col("_by"))) + d)))
    band = F.floor(F.col(lat) / g)
    return bounded_broadcast(listed), (band == F.col("_by")) & (F.floor(F.col(lon) / width(band)) == F.col("_bx"))


def away_from(df: DataFrame, places: DataFrame, radius_nm: float, lat: str = "lat", lon: str = "lon", radius: float = C.EARTH_NM,
              inline_rows: int = C.INLINE_DIM_ROWS) -> DataFrame:
    """Rows with a position and no place within the radius. A short list becomes an expression, a longer one a join on cells."""
    rows = bounded_rows(places, inline_rows)
    if rows is None:
        known = df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
        listed, met = near_places(known, places.select("lat", "lon"), radius_nm, lat, lon)
        reach = math.sin(radius_nm / radius / 2) ** 2
        return known.join(listed, met & (geo.half_chord(lat, lon, F.col("_p_lat"), F.col("_p_lon")) <= reach), "left_anti")
    return df.where(~_within(rows, radius_nm, lat, lon, radius))


def _within(rows, radius_nm: float, lat: str, lon: str, radius: float) -> Column:
    dlat = radius_nm / 59.0
    reach = math.sin(radius_nm / radius / 2) ** 2
    out = F.lit(False)
    for r in rows:
        dlon = dlat / max(0.05, math.cos(math.radians(min(89.0, abs(r["lat"]) + dlat))))
        box = geo.in_box(lat, lon, r["lat"] - dlat, r["lat"] + dlat, r["lon"] - dlon, r["lon"] + dlon)
        out = out | (box & (geo.half_chord(lat, lon, float(r["lat"]), float(r["lon"])) <= reach))
    return out
