"""The scalar surface as SQL functions, so that plain SQL can call it."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Radius default: 6371 km in nautical miles (6371 * 0.539957).
FUNCTIONS = {
    "haversine_nm(lat1 double, lon1 double, lat2 double, lon2 double) returns double":
        "2 * 6371.0D * 0.539957D * atan2(sqrt(pow(sin((radians(lat2) - radians(lat1)) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2))"
        " * pow(sin((radians(lon2) - radians(lon1)) / 2), 2)), sqrt(greatest(0D, 1 - (pow(sin((radians(lat2) - radians(lat1)) / 2), 2)"
        " + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin((radians(lon2) - radians(lon1)) / 2), 2)))))",
    "heading_delta(h1 double, h0 double) returns double": "pmod(h1 - h0 + 540, 360) - 180",
    "grid_key(x double, step double) returns double": "bround(x / step) * step",
    "flight_phase(alt double, vspeed double) returns string":
        "case when alt < 1000 then 'ground' when vspeed > 400 then 'climb' when vspeed < -400 then 'descent' else 'cruise' end",
}


def register(spark: SparkSession) -> None:
    for head, body in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {head} return {body}")
