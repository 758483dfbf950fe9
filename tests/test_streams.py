"""State of the streaming jobs ends with the watermark, and what was written stays right."""

import datetime
import os
import random

from pyspark.sql import functions as F

from tests.conftest import T0, track
from wayfold.storage import new_path
from wayfold.streaming import jobs as sj, ordered as od


def test_state_of_silent_flights_goes(spark):
    path = new_path(spark, "in")
    schema = "flight_id string, ts long, lat double, lon double, alt double"
    days = 86_400
    for day in (1, 2, 30, 31, 60):      # one file and one batch for each day; every flight but "z" falls silent
        rows = [(f"f{day}", day * days + i, 30.0 + i, 34.0, 1000.0 * i) for i in range(3)] + [("z", day * days, 1.0, 2.0, 3.0)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    root = new_path(spark, "out")
    q = (sj.active_flights(sj.stream_of(spark, path, spark.read.parquet(path).schema, 1), delay="5 days").writeStream.outputMode("update")
         .foreachBatch(lambda b, e: b.write.mode("overwrite").parquet(f"{root}/batch={e}")).option("checkpointLocation", new_path(spark, "ckpt"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    out = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in q.recentProgress]
    # Ten windows in all; those before the watermark go at the end of a batch, and the last one leaves the newest two.
    assert max(out) <= 6 and out[-1] == 2, out
    parts = spark.read.parquet(root)
    got = {r.flight_id: r for r in sj.active_table(parts, 0).collect()}
    assert set(got) == {"z", "f1", "f2", "f30", "f31", "f60"} and got["z"].points == 5 and got["z"].ts == 60 * days
    assert (got["f30"].points, got["f30"].lat, got["f30"].ts) == (3, 32.0, 30 * days + 2)
    late = {r.flight_id: r.expired for r in sj.expiry(sj.latest_by_window(spark.read.parquet(path), "flight_id", F.struct("ts")), 60 * days + 902).collect()}
    assert late["z"] and not late["f60"] and late["f1"]


def test_files_are_read_in_the_order_of_event_time(spark):
    """A track of 40 days whose oldest file takes longest to write, in four batches: the source drops what is later than the
    watermark of the batch before the last."""
    rows = [{"flight_id": "F1", "ts": T0 + h * 3600} for h in range(960)] + [{"flight_id": "F2", "ts": T0 + 60}, {"flight_id": "F2", "ts": T0 + 39 * 86_400}]
    # Random text makes the rows of the first ten days slow to write.
    slow = F.when(F.col("ts") < T0 + 10 * 86_400, F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(4000)), lambda i: F.sha2(F.concat_ws(":", "ts", i), 256))))
    path, schema = sj.as_files(track(spark, rows).withColumn("text", slow))
    stream = lambda: sj.stream_of(spark, path, schema, 1)
    got = {r.flight_id: (r.points, r.ts) for r in sj.active_table(sj.drain(sj.active_flights(stream()), "update"), 0).collect()}
    assert got == {"F1": (960, T0 + 959 * 3600), "F2": (2, T0 + 39 * 86_400)}
    last = {r.flight_id: r.last_ts for r in sj.expiry(sj.drain(sj.heartbeats(stream()), "update"), T0).collect()}
    assert last == {k: ts for k, (_, ts) in got.items()}
    pairs = sj.drain(sj.proximity_stream(stream(), stream(), seconds=60)).groupBy("a_id").count().collect()
    assert {r.a_id: r["count"] for r in pairs} == {"F1": 2, "F2": 2}


TESTS = "flight_id string, ts long, alt double, tracks long, gspeed_warning boolean, vspeed_warning boolean"


def monitored(rows, idle, warm_up_s=300, size=15, share=0.8):
    """States by a plain loop over sorted points; a flight silent for longer than ``idle`` starts anew."""
    out, s = [], None
    for f, ts, alt, tracks, g, v in sorted(rows):
        if s is None or s["f"] != f or ts - s["last"] > idle:
            s = {"f": f, "g": [], "v": [], "start": None, "warned": False}
        s["last"] = ts
        if alt < 1000:
            continue
        if tracks < 3:
            out.append((f, ts, "WARNING" if s["warned"] else "STANDBY"))
            continue
        s["g"], s["v"] = [*s["g"], g][-size:], [*s["v"], v][-size:]
        s["start"] = ts if s["start"] is None else s["start"]
        alarm = any(len(q) == size and sum(q) >= share * size for q in (s["g"], s["v"]))
        state = "NORMAL" if not alarm else "STANDBY" if ts - s["start"] <= warm_up_s else "WARNING"
        s["warned"] |= state == "WARNING"
        out.append((f, ts, state))
    return sorted(out)


def test_monitor_ignores_batches_and_restarts(spark):
    """Points in mixed order inside the delay, one flight owning most of them, and a restart in the middle of the stream."""
    r = random.Random(3)
    rows = []
    for f, n in (("hot", 400), ("b", 60), ("c", 60)):
        ts, bad = T0, False
        for i in range(n):
            ts += 30_000 if f == "b" and i == 40 else r.choice((10, 20, 60))
            bad = r.random() < 0.9 if i % 40 > 15 else r.random() < 0.2
            rows.append((f, ts, r.choice((500.0, 9000.0, 9000.0)), r.choice((0, 5, 5, 5, 9)), bad, r.random() < 0.3))
    want = monitored(rows, 6 * 3600)
    assert {x[2] for x in want} == {"NORMAL", "WARNING", "STANDBY"}
    newest = max(x[1] for x in rows)
    got = []
    for seed in (1, 2):
        path, ckpt, root = new_path(spark, "in"), new_path(spark, "ckpt"), new_path(spark, "out")
        q = random.Random(seed)
        order = sorted(rows, key=lambda x: x[1] + q.uniform(-250, 250))
        cut = len(order) // 4
        parts = [order[:cut], order[cut:2 * cut], order[2 * cut:], [(None, newest + 86_400, None, None, None, None)]]
        for i, part in enumerate(parts):
            spark.createDataFrame(part, TESTS).repartition(2).sortWithinPartitions("alt").coalesce(1).write.mode("append").parquet(path)
            if i in (1, 3):     # a new run from the checkpoint
                (od.monitor(sj.stream_of(spark, path, TESTS, 1)).writeStream.outputMode("append").option("checkpointLocation", ckpt)
                 .foreachBatch(lambda b, e: b.write.mode("overwrite").parquet(f"{root}/batch={e}")).trigger(availableNow=True).start().awaitTermination())
        got.append(sorted(map(tuple, spark.read.parquet(root).select("flight_id", "ts", "state").collect())))
    assert got == [want, want]


def test_silence_is_an_event_and_its_state_goes(spark):
    path = new_path(spark, "in")
    batches = [[("a", T0), ("b", T0 + 10), ("c", T0 + 20)],
               [("a", T0 + 800), ("b", T0 + 900)],                  # a and b return in time, c falls silent
               [("a", T0 + 3000), ("b", T0 + 1500)],                # a returned too late; b came out of order
               [("d", T0 + 20_000)], [("d", T0 + 40_000)]]
    for part in batches:
        spark.createDataFrame(part, "flight_id string, ts long").coalesce(1).write.mode("append").parquet(path)
    root = new_path(spark, "out")
    q = (od.expired(sj.stream_of(spark, path, "flight_id string, ts long", 1), delay="50 minutes").writeStream.outputMode("append")
         .foreachBatch(lambda b, e: b.write.mode("overwrite").parquet(f"{root}/batch={e}")).option("checkpointLocation", new_path(spark, "ckpt"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(root).select("flight_id", "last_ts", "expired_ts").collect()))
    assert got == [("a", T0 + 800, T0 + 1701), ("a", T0 + 3000, T0 + 3901), ("b", T0 + 1500, T0 + 2401), ("c", T0 + 20, T0 + 921), ("d", T0 + 20_000, T0 + 20_901)]
    # What is left is the open point of d: its waiting slice and its timer.
    assert q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 6


def test_messages_are_written_once_and_keys_leave_the_state(spark):
    path, table = new_path(spark, "in"), new_path(spark, "table")
    schema = "mmsi string, ts timestamp_ntz, latitude double, longitude double"
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    for hour in range(8):
        rows = [(f"m{i}", at(hour * 3600 + i), 1.0, 2.0) for i in range(10)] * 2 + ([(f"m{i}", at((hour - 1) * 3600 + i), 1.0, 2.0) for i in range(10)] if hour else [])
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        if hour == 4:
            sj.ingest(sj.stream_of(spark, path, schema, 1), table, ["mmsi", "ts", "latitude", "longitude"], delay="2 hours")
    messages = sj.stream_of(spark, path, schema, 1)
    seen = []
    q = (sj.once(messages, ["mmsi", "ts"], delay="2 hours").writeStream.foreachBatch(lambda b, e: seen.append(b.count()))
         .option("checkpointLocation", new_path(spark, "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert sum(seen) == 80 and max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) <= 50
    sj.ingest(messages, table, ["mmsi", "ts", "latitude", "longitude"], delay="2 hours")      # goes on from the checkpoint
    assert spark.read.parquet(f"{table}/data").count() == 80


def test_keys_of_a_stream_wait_on_disk(spark):
    """Both runners use the RocksDB store, whose checkpoints are archives, whatever ran in the session before."""
    rows = spark.createDataFrame([("a", 1704067200), ("a", 1704067200), ("b", 1704067300)], "k string, s bigint").select("k", F.timestamp_seconds("s").alias("at"))
    path, schema = sj.as_files(rows, order="at")
    spark.conf.unset(od.STORE)
    table = sj.scratch(spark)
    sj.ingest(sj.stream_of(spark, path, schema), table, ["k"], at="at")
    assert spark.read.parquet(f"{table}/data").count() == 2
    kept = [f for _, _, names in os.walk(f"{table}/ckpt/state".removeprefix("file:")) for f in names]
    assert kept and not [f for f in kept if f.endswith(".delta")]
    spark.conf.unset(od.STORE)
    sj.drain(sj.tumbling_counts(sj.stream_of(spark, path, schema).withColumn("event_type", F.col("k"))))
    assert spark.conf.get(od.STORE) == od.ROCKS


def test_no_task_writes_a_share_of_the_whole_stream(spark, monkeypatch):
    """What a task sorts while the files are made is a bounded number of rows, and the files stay in order of time."""
    monkeypatch.setattr(sj, "RANGE_ROWS", 100)
    rows = spark.range(2000).select(F.col("id").cast("string").alias("k"), F.col("id").alias("ts"))
    path, schema = sj.as_files(rows)
    ranges = spark.read.parquet(f"{path.rsplit('/', 1)[0]}/ranges")
    assert max(r["count"] for r in ranges.groupBy("_range").count().collect()) < 400
    files = (spark.read.schema(schema).parquet(path).groupBy(F.input_file_name()).agg(F.min("ts"), F.max("ts"), F.count("*"),
             F.min("_metadata.file_modification_time")).collect())
    files = sorted((r[1], r[2], r[3], r[4]) for r in files)
    assert len(files) == 4 and sum(f[2] for f in files) == 2000
    assert all(a[1] < b[0] and a[3] <= b[3] for a, b in zip(files, files[1:]))


def test_silence_needs_no_python(spark):
    """One second more than the limit is a silence, the limit itself is none, and the jobs run without a Python state processor."""
    path = new_path(spark, "in")
    schema = "flight_id string, ts long"
    for part in ([("a", T0), ("b", T0)], [("a", T0 + 400), ("b", T0 + 401)], [("z", T0 + 90_000)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    job = od.expired(sj.stream_of(spark, path, schema, 1), silent_s=400)
    assert "Python" not in job._jdf.queryExecution().logical().toString() and "InPandas" not in job._jdf.queryExecution().logical().toString()
    got = sorted(map(tuple, sj.drain(job).collect()))
    assert got == [("a", T0 + 400, T0 + 801), ("b", T0, T0 + 401), ("b", T0 + 401, T0 + 802)]


def test_state_is_kept_by_share_not_by_flight(spark, monkeypatch):
    """Four hundred flights of four shares: the store holds slices and keys of shares, and silent flights are not carried."""
    monkeypatch.setattr(od, "SHARES", 4)
    r = random.Random(5)
    rows = [(f"f{i}", T0 + 20 * k + i % 20, 9000.0, 5, r.random() < 0.9, False) for i in range(400) for k in range(25)]
    path, root = new_path(spark, "in"), new_path(spark, "out")
    for part in (rows[::2], rows[1::2], [(None, T0 + 40_000, None, None, None, None)], [("f1", T0 + 80_000, 9000.0, 5, True, True)], [(None, T0 + 90_000, None, None, None, None)]):
        spark.createDataFrame(part, TESTS).coalesce(1).write.mode("append").parquet(path)
    q = (od.monitor(sj.stream_of(spark, path, TESTS, 1), delay="20 minutes").writeStream.outputMode("append").option("checkpointLocation", new_path(spark, "ckpt"))
         .foreachBatch(lambda b, e: b.write.mode("overwrite").parquet(f"{root}/batch={e}")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(root).select("flight_id", "ts", "state").collect()))
    assert got == monitored([*rows, ("f1", T0 + 80_000, 9000.0, 5, True, True)], 6 * 3600)
    state = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(state) <= 40 and state[-1] <= 3, state
