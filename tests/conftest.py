import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[4]").appName("wayfold-tests").config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
         .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-test-")).getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


T0 = 1704067200
FIELDS = ["flight_id", "ts", "lat", "lon", "alt", "gspeed", "vspeed", "track", "squawk", "callsign", "source"]


def track(spark, rows):
    """Points from dicts; missing fields get cruise defaults."""
    base = {"flight_id": "F1", "ts": T0, "lat": 31.0, "lon": 33.0, "alt": 30000.0, "gspeed": 300.0, "vspeed": 0.0,
            "track": 90.0, "squawk": "2000", "callsign": "ELY1", "source": "ADSB"}
    data = [tuple({**base, **r}[f] for f in FIELDS) for r in rows]
    return spark.createDataFrame(data, "flight_id string, ts bigint, lat double, lon double, alt double, gspeed double, "
                                       "vspeed double, track double, squawk string, callsign string, source string")


def airports(spark, rows=(("LLBG", 32.011389, 34.886667, 135), ("LCLK", 34.8751, 33.6249, 8))):
    return spark.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], "ord int, code string, lat double, lon double, elevation_ft int")
