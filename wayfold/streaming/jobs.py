"""Structured Streaming jobs and the small runner that drains a source into a table.

Every job is a function from a streaming frame to a streaming frame (or a foreachBatch
writer). ``drain`` runs one with the available-now trigger; in production the same
frames are started with a processing-time trigger.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from wayfold.functions import geo
from wayfold.operators import marine as ma
from wayfold.operators.sweep import near_counts
from wayfold.operators.windows import cut
from wayfold.sources import sinks
from wayfold.storage import new_path
from wayfold.streaming.ordered import use_rocks

c = F.col
RANGE_ROWS = 200_000        # rows that one task writes while a stream's files are made


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir."""
    return new_path(spark, "stream")


def as_files(df: DataFrame, files: int = 4, order: str = "ts", closing_s: int | None = None) -> tuple[str, object]:
    """Write a frame as several files ordered by time, to be streamed file by file.

    The source takes files by modification time. They are written one after another, so that it meets them in the order
    of ``order`` and no row comes behind the watermark of a later range. With ``closing_s`` a last file holds one row that is null
    but for ``order``, so many seconds after the newest: it carries the watermark past all others, as later traffic would.
    """
    spark, schema = df.sparkSession, df.schema
    root = scratch(spark)
    path = f"{root}/in"
    df = cut(df)            # counted, sampled for its ranges, and written
    # A writer sorts what it has by range: many narrow ranges keep that small.
    df.repartitionByRange(max(files, math.ceil(df.count() / RANGE_ROWS)), order).withColumn("_range", F.spark_partition_id()).write.partitionBy("_range").parquet(f"{root}/ranges")
    ranges = spark.read.schema(StructType([*schema.fields, StructField("_range", IntegerType())])).parquet(f"{root}/ranges")
    n = (ranges.agg(F.max("_range")).first()[0] or 0) + 1       # a session may make more ranges than asked for
    for i in range(files):
        ranges.where(F.floor(c("_range") * files / n) == i).drop("_range").coalesce(1).write.mode("append").parquet(path)
    if closing_s is not None:
        kind = schema[order].dataType
        after = F.max(order) + (F.lit(closing_s) if kind.simpleString() in ("int", "bigint") else F.make_dt_interval(secs=F.lit(closing_s)))
        last = ranges.agg(after.cast(kind).alias(order)).where(c(order).isNotNull())
        last.select(*[c(f.name) if f.name == order else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]).write.mode("append").parquet(path)
    return path, schema


def stream_of(spark: SparkSession, path: str, schema, per_trigger: int = 2) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a streaming frame over all available input and return its table.

    Each micro-batch writes its own folder, overwriting it on a retry, so a batch counts
    once. Complete mode keeps the newest folder, append and update mode all of them.
    """
    spark = stream.sparkSession
    use_rocks(spark)        # state on disk, not in the memory of a task
    root = scratch(spark)
    last = {"id": -1}

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={epoch}")
        last["id"] = max(last["id"], epoch)

    q = (stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{root}/ckpt")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if last["id"] < 0:
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        return spark.read.parquet(f"{root}/out/batch={last['id']}")
    return spark.read.schema(stream.schema).parquet(*[f"{root}/out/batch={i}" for i in range(last["id"] + 1)])


def event_time(df: DataFrame, ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """Epoch seconds as event time with a watermark."""
    return df.withColumn("at", F.timestamp_seconds(c(ts))).withWatermark("at", delay)


# -- jobs
def latest_by_window(rows: DataFrame, key: str, newest: Column, width: str = "1 hour", delay: str = "7 days") -> DataFrame:
    """Newest row ``p`` and number of points for each key and event-time window, for update mode.

    The state of a window goes once the watermark has passed it, so a key that falls silent leaves no state behind. Rows
    later than ``delay`` are dropped if their window has gone. ``rows`` have ``at``, or epoch seconds in ``ts``.
    """
    timed = rows.withWatermark("at", delay) if "at" in rows.columns else event_time(rows, delay=delay)
    return (timed.groupBy(F.window("at", width).alias("w"), key).agg(F.max(newest).alias("p"), F.count("*").alias("points"))
            .select(key, c("w.start").alias("start"), "points", "p"))


def latest(parts: DataFrame, key: str) -> DataFrame:
    """One row for each key from the table that ``latest_by_window`` writes, in which a window comes again when it grows."""
    return (parts.groupBy(key, "start").agg(F.max("p").alias("p"), F.max("points").alias("points"))
            .groupBy(key).agg(F.max("p").alias("p"), F.sum("points").alias("points")))


def active_flights(points: DataFrame, **times: str) -> DataFrame:
    """Last position for each flight and window; ``active_table`` reads it."""
    return latest_by_window(points, "flight_id", F.struct("ts", "lat", "lon", "alt"), **times)


def active_table(parts: DataFrame, since: int) -> DataFrame:
    """Flights seen at or after ``since`` with their last position."""
    return latest(parts, "flight_id").select("flight_id", "points", "p.*").where(c("ts") >= since)


def latest_vessels(pos: DataFrame, **times: str) -> DataFrame:
    """Last position for each vessel and window; ``vessel_table`` reads it."""
    return latest_by_window(pos, "mmsi", F.struct("ts", (-c("latitude")).alias("a"), (-c("longitude")).alias("b")), **times)


def vessel_table(parts: DataFrame) -> DataFrame:
    return latest(parts, "mmsi").select("mmsi", c("p.ts").alias("ts"), (-c("p.a")).alias("latitude"), (-c("p.b")).alias("longitude"))


def heartbeats(points: DataFrame, **times: str) -> DataFrame:
    """Last instant for each flight and window; ``expiry`` reads it."""
    return latest_by_window(points, "flight_id", F.struct("ts"), **times)


def expiry(parts: DataFrame, now: int, silent_s: int = 900) -> DataFrame:
    """Flights with their last instant, and whether they were silent for more than ``silent_s``."""
    return latest(parts, "flight_id").select("flight_id", c("p.ts").alias("last_ts")).withColumn("expired", F.lit(now) - c("last_ts") > silent_s)


def tumbling_counts(events: DataFrame, width: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Events per window and type; ``at`` is the event time. In append mode a window comes once, when the watermark has passed it."""
    return (events.withWatermark("at", delay).groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
            .select(c("w.start").alias("start"), "event_type", "n"))


def sessions(points: DataFrame, gap: str = "300 seconds") -> DataFrame:
    """Runs of points closer than the gap; a point exactly one gap later opens a new run. In append mode a run comes once, when it is over."""
    return (event_time(points).groupBy(F.session_window("at", gap).alias("s"), "flight_id")
            .agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("points"))
            .select("flight_id", "first_ts", "last_ts", "points"))


def proximity_stream(left: DataFrame, right: DataFrame, nm: float = 4.0, seconds: int = 5, ft: float = 999.0) -> DataFrame:
    """Interval join of two point streams within seconds, nm and feet; state is bounded by the watermarks."""
    g = nm / 59.5
    wide = lambda band: g / F.cos(F.radians(F.least(F.abs(band) + 2, F.lit(88))))
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    a = event_time(left).select(c("flight_id").alias("a_id"), c("ts").alias("a_ts"), c("lat").alias("a_lat"), c("lon").alias("a_lon"), c("alt").alias("a_alt"), c("at").alias("a_at"))
    a = a.withColumns({"ab": F.floor("a_lat"), "ay": F.floor(c("a_lat") / g)}).withColumn("ax", F.floor(c("a_lon") / wide(c("ab"))))
    b = event_time(right).select(c("flight_id").alias("b_id"), c("ts").alias("b_ts"), c("lat").alias("b_lat"), c("lon").alias("b_lon"), c("alt").alias("b_alt"), c("at").alias("b_at"))
    b = b.withColumn("bb", F.explode(F.array_distinct(F.array(F.floor(c("b_lat") - g), F.floor("b_lat"), F.floor(c("b_lat") + g)))))
    b = b.withColumn("by", F.explode(F.transform(near, lambda d: F.floor(c("b_lat") / g) + d)))
    b = b.withColumn("bx", F.explode(F.transform(near, lambda d: F.floor(c("b_lon") / wide(c("bb"))) + d)))
    span = F.expr(f"interval {seconds} seconds")
    cond = ((c("ab") == c("bb")) & (c("ay") == c("by")) & (c("ax") == c("bx")) & (c("a_id") != c("b_id"))
            & (c("b_at") >= c("a_at") - span) & (c("b_at") <= c("a_at") + span) & (F.abs(c("a_alt") - c("b_alt")) <= ft)
            & (geo.haversine("a_lat", "a_lon", "b_lat", "b_lon") <= nm))
    return a.join(b, cond).select("a_id", "a_ts", "b_id", "b_ts")


def count_proximity(points: DataFrame, root: str, nm: float = 4.0, seconds: int = 5, ft: float = 999.0) -> None:
    """Close pairs for each flight over a stream of points: each batch adds (flight_id, pairs) below ``root``/pairs.

    A batch counts the pairs that have a point of its own: among its points, and with those of earlier batches that are near
    in time, whose table is below ``root``/points. No pair is kept, a late point counts too, and a batch that is run again gives the same tables.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch.select("flight_id", "ts", "lat", "lon", "alt").write.mode("overwrite").parquet(f"{root}/points/batch={epoch}")
        every = spark.read.parquet(f"{root}/points")
        new = every.where(c("batch") == epoch).drop("batch")
        first, last = new.agg(F.min("ts"), F.max("ts")).first()
        found = near_counts(new, nm, seconds, ft)
        if first is not None:
            old = every.where((c("batch") < epoch) & c("ts").between(first - seconds, last + seconds)).drop("batch")
            found = found.unionByName(near_counts(new, nm, seconds, ft, right=old)).unionByName(near_counts(old, nm, seconds, ft, right=new))
        found.write.mode("overwrite").parquet(f"{root}/pairs/batch={epoch}")

    points.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/ckpt").trigger(availableNow=True).start().awaitTermination()


def once(messages: DataFrame, keys: list[str], at: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Messages once per key, which must hold the event time. Keys are in state until the watermark has passed them.

    A repeat that comes later than the delay is dropped as late, so a key is never written twice; a first message later than
    that is lost, and counted in the query's progress.
    """
    timed = messages.withColumn("_at", c(at).cast("timestamp")).withWatermark("_at", delay)
    return timed.dropDuplicates([*keys, "_at"]).drop("_at")


def ingest(messages: DataFrame, table: str, keys: list[str], at: str = "ts", delay: str = "1 hour") -> None:
    """AIS or track messages into a table, once per key over all batches; a batch owns its folder, so a re-run replaces it.

    Keys wait in the RocksDB store, on disk: their number grows with the messages within the delay, and no task holds them in memory.
    """
    use_rocks(messages.sparkSession)
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/data/batch={epoch}")

    (once(messages, keys, at, delay).writeStream.foreachBatch(write).option("checkpointLocation", f"{table}/ckpt").trigger(availableNow=True).start()
     .awaitTermination())


def ingest_vessels(messages: DataFrame, root: str, buckets: int = 16) -> None:
    """Vessel messages (value, received): positions are added below ``root``/positions, static data update ``root``/register.

    The register keeps the newest message of a vessel by ``received``, in whatever order batches bring them, ties by its texts.
    Only buckets with a vessel of the batch are written again. A batch that is run again gives the same tables.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        read = cut(ma.ais_envelopes(batch))         # two tables come from it
        ma.position_reports(read).write.mode("overwrite").parquet(f"{root}/positions/batch={epoch}")
        new = ma.static_reports(read).withColumn("bucket", F.pmod(F.xxhash64("mmsi"), F.lit(buckets)).cast("int"))
        if not new.limit(1).count():
            return
        if sinks.exists(spark, f"{root}/register"):
            touched = [r[0] for r in new.select("bucket").distinct().collect()]       # one number for each bucket at most
            held = sinks.read_table(spark, f"{root}/register", new.schema).where(c("bucket").isin(touched))
            new = cut(new.unionByName(held.select(new.columns).join(new.select("mmsi").distinct(), "mmsi", "left_semi").select(new.columns)))
        order = ["last_updated", *[F.coalesce(x, F.lit("")).alias(x) for x in ("vessel_name", "call_sign", "destination")], F.coalesce("vessel_type", F.lit(-1)).alias("vessel_type")]
        best = new.groupBy("mmsi").agg(F.max_by(F.struct(*[x for x in new.columns if x != "mmsi"]), F.struct(*order)).alias("r")).select("mmsi", "r.*")
        sinks.merge_table(spark, f"{root}/register", best, ["mmsi"], ["last_updated"], "bucket")

    (messages.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/ckpt").trigger(availableNow=True).start().awaitTermination())
