from pyspark.sql import functions as F

from tests.conftest import T0, airports, track
from wayfold.operators.spatial import interference_components


def test_cells_read_the_points_once(spark, tmp_path):
    """Flights, gaps and marks come from one table of steps; the result reads that, not the points again."""
    rows = [{"flight_id": f"F{k}", "ts": T0 + 20 * i, "lat": 31 + k * 0.01 + (0.5 if i % 7 == 3 else 0), "lon": 33 + i * 0.01} for k in range(3) for i in range(40)]
    rows.append({"flight_id": "F0", "ts": T0 + 5000, "lat": 31.2, "lon": 33.5})
    track(spark, rows).write.parquet(f"{tmp_path}/points")
    out = interference_components(spark.read.parquet(f"{tmp_path}/points"), airports(spark), min_score=5, limit=None)
    assert not [f for f in out.inputFiles() if f"{tmp_path}/points" in f]
    got = out.agg(F.sum("position_teleports"), F.sum("gap_duration"), F.max("affected_flights")).first()
    assert got[0] > 0 and got[1] == 4220 and got[2] == 3
