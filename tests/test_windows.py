"""Sliced windows must equal plain windows, wherever the slice borders fall."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from wayfold.operators import windows as w
from tests.conftest import T0


def points(spark, n=300, seed=1):
    r = random.Random(seed)
    rows, t = [], {"A": T0, "B": T0 + 5}
    for i in range(n):
        k = "A" if r.random() < 0.8 else "B"
        t[k] += r.choice([1, 5, 20, 400, 30000])
        rows.append((k, t[k], float(r.randint(-50, 50))))
    return spark.createDataFrame(rows, "flight_id string, ts bigint, v double")


def test_neighbours_equal_plain_lag_and_lead(spark):
    df = points(spark)
    got = w.with_neighbours(df, {"p": "v"}, {"n": "v"}, {"p2": "v"}, width=600)
    win = Window.partitionBy("flight_id").orderBy("ts")
    want = df.withColumns({"p": F.lag("v").over(win), "n": F.lead("v").over(win), "p2": F.lag("v", 2).over(win)})
    assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_running_sum_and_row_number(spark):
    df = points(spark, seed=2)
    win = Window.partitionBy("flight_id").orderBy("ts")
    got = w.running_sum(df, {"s": F.col("v")}, width=600)
    want = df.withColumn("s", F.sum("v").over(win))
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    got = w.sliced_row_number(w.with_slice(df, width=600), "flight_id", w.SLICE, ["ts"], "rn")
    want = df.withColumn("rn", F.row_number().over(win))
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_halo_range_window_is_exact(spark):
    df = points(spark, seed=3)
    h = w.with_halo(df, before=300, after=0, width=600)
    win = Window.partitionBy("flight_id", w.SLICE).orderBy("ts").rangeBetween(-300, 0)
    got = h.withColumn("s", F.sum("v").over(win)).where("_core").select("flight_id", "ts", "s")
    plain = Window.partitionBy("flight_id").orderBy("ts").rangeBetween(-300, 0)
    want = df.withColumn("s", F.sum("v").over(plain)).select("flight_id", "ts", "s")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_shifted_rows(spark):
    df = points(spark, seed=4)
    got = w.shifted_rows(df, 7, {"old": "v"}).select("flight_id", "ts", "old")
    want = df.withColumn("old", F.lag("v", 7).over(Window.partitionBy("flight_id").orderBy("ts"))).select("flight_id", "ts", "old")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
