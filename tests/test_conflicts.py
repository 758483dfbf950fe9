import random

from pyspark.sql import functions as F

from wayfold.operators import forecast as fc, hotkeys


def traffic(spark, n=60):
    r = random.Random(3)
    rows = [(f"F{i}", 30 + r.random(), 33 + r.random(), 11000.0 + r.choice([0, 400, 900, 9000]), float(r.randint(180, 480)), float(r.randint(0, 359))) for i in range(n)]
    rows += [("N", None, 33.0, 11000.0, 300.0, 10.0)]
    return fc.dead_reckoning(spark.createDataFrame(rows, "flight_id string, lat double, lon double, alt double, gspeed double, track double")).localCheckpoint()


def test_pairs_tell_their_first_conflict_themselves(spark):
    d = traffic(spark)
    every = fc.conflicts(d.withColumnRenamed("flight_id", "plan_id"), d)
    plain, got = (sorted(map(tuple, x.select("plan_id", "flight_id", "minutes", "nm", "ft", "kind").collect())) for x in (fc.first_conflicts(every), fc.first_conflicts_of(d)))
    assert got == plain and len(got) < every.count()        # some pairs conflict more than once


def test_first_conflicts_shuffle_no_pairs(spark):
    plan = fc.first_conflicts_of(traffic(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan and "Aggregate" not in plan.split("Join Inner")[0]


def test_balanced_join_bounds_the_pairs_of_a_part(spark):
    a = spark.range(500).select(F.when(F.col("id") < 400, 0).otherwise(F.col("id") % 7).alias("k"), F.col("id").alias("x"))
    b = a.withColumnRenamed("x", "y")
    rows = lambda df: sorted(map(tuple, df.select("k", "x", "y").collect()))
    dealt = hotkeys.join_balanced(a, b, ["k"], part_pairs=4000, task_pairs=8000)
    assert rows(dealt) == rows(a.join(b, "k"))
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 400 * 400 / 2           # one key's pairs are not one task's
    assert rows(hotkeys.join_balanced(a, b, ["k"])) == rows(a.join(b, "k"))


def test_copies_of_a_crowded_key_grow_with_the_root_of_its_parts(spark):
    a = spark.range(800).select(F.lit(0).alias("k"), F.col("id").alias("x"))
    b = a.withColumnRenamed("x", "y")
    left, right, key, _ = hotkeys.balanced_sides(a, b, ["k"], part_pairs=1600, task_pairs=1 << 20)      # 400 parts
    assert left.count() == right.count() == 800 * 20 and left.select(key).distinct().count() == 400
    few = spark.range(3).select(F.lit(0).alias("k"), F.col("id").alias("y"))
    pairs = lambda df: sorted(map(tuple, df.select("x", "y").collect()))
    for x, y in ((a, few), (few.withColumnRenamed("y", "x"), b)):
        assert pairs(hotkeys.join_balanced(x, y, ["k"], part_pairs=10)) == pairs(x.join(y, "k"))


def test_no_near_position_is_left_out(spark):
    r = random.Random(6)
    rows = []
    for lat0 in (0.0, 31.0, 59.99, 60.01, -84.9, 85.05, 89.0):
        for _ in range(400):
            lat, lon = lat0 + r.uniform(-0.1, 0.1), 33.0
            rows.append((lat, lon, lat + r.uniform(-0.17, 0.17), lon + r.uniform(-3, 3)))
    df = spark.createDataFrame(rows, "lat double, lon double, blat double, blon double")
    near = fc.geo.haversine("lat", "lon", "blat", "blon") <= 10.0
    assert df.where(near & ~fc._beside("lat", "lon", "blat", "blon", 10.0)).count() == 0 < df.where(near).count()
    assert df.where(fc._beside("lat", "lon", "blat", "blon", 10.0)).count() < df.count()


def test_distances_are_worked_out_inside_conditionals(spark):
    """What recurs in a filter is evaluated for every pair before the filter's own order of tests, but for the branches of a conditional."""
    plan = fc.first_conflicts_of(traffic(spark))._jdf.queryExecution().optimizedPlan().toString()
    condition = next(x for x in plan.split("\n") if "Join Inner" in x and "ATAN2" in x)
    assert condition.count("ATAN2") == condition.count("ELSE false") == 13
