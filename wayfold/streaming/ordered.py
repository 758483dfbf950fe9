"""Processors that see the points of a key in the order of event time.

Points wait in state, by slice of time, until the watermark has passed them. Event-time timers then hand them
over in order, so results don't depend on the batch that a point came in, nor on a restart in between. A key that has
been silent for long enough is closed by a timer too, and its state goes.

Every access to state is a call to another process. Keys are therefore dealt over shares by their hash, and a share is what the
state store knows: it reads and writes the waiting points of a slice, and what is carried of its keys, as one Arrow table each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

SLICE_S = 600
SHARES = 256
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(held: bytes) -> pa.Table:
    return pa.ipc.open_stream(held).read_all()


class InEventOrder(StatefulProcessor):
    """Base of processors over rows with a string ``key`` and epoch seconds ``ts``, unique for each key.

    ``columns`` name what is kept of a waiting point, ``carried`` what is kept of a key, with their types; ``silent_s`` is how long a
    key may be silent. Subclasses give ``opened``, the carried values of a new key, and ``on_point``. Rows without a key only move the watermark.
    """

    columns: dict[str, pa.DataType] = {}
    carried: dict[str, pa.DataType] = {}
    out: list[str] = []

    def __init__(self, silent_s: int, key: str = "flight_id"):
        self.silent_s, self.key = silent_s, key

    def opened(self) -> dict:
        raise NotImplementedError

    def on_point(self, key: str, own: dict, point: dict) -> tuple | None:
        """The output row of a point, if any; ``own`` is changed in place."""
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = pa.schema([(self.key, pa.string()), ("ts", pa.int64()), *self.columns.items()])
        self.kept = pa.schema([(self.key, pa.string()), ("last", pa.int64()), *self.carried.items()])
        self.waiting = handle.getMapState("waiting", "slice bigint", "points binary")
        self.keys = handle.getValueState("keys", "kept binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            part = part[part[self.key].notna()]
            for at, own in part.groupby(part["ts"] // SLICE_S):
                at = int(at)
                new = pa.Table.from_pandas(own[self.rows.names], schema=self.rows, preserve_index=False)
                if self.waiting.containsKey((at,)):
                    new = pa.concat_tables([_unpacked(self.waiting.getValue((at,))[0]), new])
                else:
                    self.handle.registerTimer((at + 1) * SLICE_S * 1000)
                self.waiting.updateValue((at,), (_packed(new.replace_schema_metadata()),))
        yield self.frame([])

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=self.out)

    def due(self, until_s: int) -> list[dict]:
        """Take the waiting points at or before an instant out of state, in order."""
        got = []
        for (at,) in sorted(tuple(k) for k in self.waiting.keys()):
            if at * SLICE_S > until_s:
                break
            held = _unpacked(self.waiting.getValue((at,))[0])
            on = held["ts"].to_numpy() <= until_s
            got.append(held.filter(pa.array(on)))
            if on.all():
                self.waiting.removeKey((at,))
            else:
                self.waiting.updateValue((at,), (_packed(held.filter(pa.array(~on))),))
        return pa.concat_tables(got).sort_by("ts").to_pylist() if got else []

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() // 1000      # nothing at or before it can still come
        points, out = self.due(until), []
        held = self.keys.get()
        known = {} if held is None else {x.pop(self.key): x for x in _unpacked(held[0]).to_pylist()}
        for p in points:
            k, ts = p[self.key], p["ts"]
            own = known.get(k)
            if own is None or ts - own["last"] > self.silent_s:     # a point behind a longer silence belongs to a new life of the key
                own = known[k] = self.opened()
            own["last"] = ts
            row = self.on_point(k, own, p)
            if row is not None:
                out.append(row)
        live = {k: x for k, x in known.items() if until <= x["last"] + self.silent_s}
        if points or len(live) < len(known):
            if live:
                self.keys.update((_packed(pa.Table.from_pylist([{self.key: k, **x} for k, x in live.items()], self.kept)),))
                self.handle.registerTimer((min(x["last"] for x in live.values()) + self.silent_s + 1) * 1000)
            else:
                self.keys.clear()
        yield self.frame(out)

    def close(self) -> None:
        pass


class Monitor(InEventOrder):
    """State NORMAL, WARNING or STANDBY of a flight at each of its points.

    Two queues of the last ``size`` results, a warm-up after the first usable point, and a warning that stays while there
    is nothing to decide on.
    """

    columns = {"alt": pa.float64(), "tracks": pa.int64(), "gspeed_warning": pa.bool_(), "vspeed_warning": pa.bool_()}
    carried = {"start": pa.int64(), "warned": pa.bool_(), "gspeed": pa.list_(pa.bool_()), "vspeed": pa.list_(pa.bool_())}
    out = ["flight_id", "ts", "state"]

    def __init__(self, silent_s: int = 6 * 3600, warm_up_s: int = 300, size: int = 15, share: float = 0.8, least_tracks: int = 3):
        super().__init__(silent_s)
        self.warm_up_s, self.size, self.share, self.least_tracks = warm_up_s, size, share, least_tracks

    def opened(self):
        return {"start": None, "warned": False, "gspeed": [], "vspeed": []}

    def on_point(self, key, own, point):
        ts = point["ts"]
        if point["alt"] is None or point["alt"] < 1000:
            return None
        if point["tracks"] < self.least_tracks:
            return key, ts, "WARNING" if own["warned"] else "STANDBY"
        for queue in ("gspeed", "vspeed"):
            own[queue] = [*own[queue], bool(point[f"{queue}_warning"])][-self.size:]
        own["start"] = ts if own["start"] is None else own["start"]
        if not any(len(q) == self.size and sum(q) >= self.share * self.size for q in (own["gspeed"], own["vspeed"])):
            return key, ts, "NORMAL"
        if ts - own["start"] <= self.warm_up_s:
            return key, ts, "STANDBY"
        own["warned"] = True
        return key, ts, "WARNING"


def processed(rows: DataFrame, processor: InEventOrder, schema: str, delay: str = "10 minutes") -> DataFrame:
    """The stream of what a processor makes of ``rows``. Rows later than the delay are dropped."""
    use_rocks(rows.sparkSession)
    timed = rows.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", delay)
    share = F.pmod(F.xxhash64(processor.key), F.lit(SHARES))
    return timed.withColumn("_share", share).groupBy("_share").transformWithStateInPandas(processor, schema, "append", "EventTime")


def use_rocks(spark: SparkSession) -> None:
    """State with timers needs the RocksDB store."""
    if spark.conf.get(STORE, None) != ROCKS:
        spark.conf.set(STORE, ROCKS)


def monitor(tests: DataFrame, delay: str = "10 minutes", **limits) -> DataFrame:
    """Flight monitor over a stream of point tests: flight_id, ts, alt, tracks, gspeed_warning, vspeed_warning.

    A point's state comes once the watermark has passed its slice. A flight silent for ``silent_s`` is over; a later point under
    its id starts anew. State per flight is two short lists, two numbers, and the points of the slices that are still open.
    """
    return processed(tests, Monitor(**limits), "flight_id string, ts bigint, state string", delay)


def expired(points: DataFrame, silent_s: int = 900, delay: str = "10 minutes") -> DataFrame:
    """flight_id, last_ts, expired_ts of every silence longer than ``silent_s``; none for a flight that comes back in time.

    A life of a flight is a session of points no further apart than that, whose state is its first and last instant. It
    comes once the watermark has passed its end. A point later than the delay and the silence together is dropped.
    """
    use_rocks(points.sparkSession)
    gap = f"{silent_s * 1000 + 500} milliseconds"        # between whole seconds: sessions that only touch would merge
    timed = points.select("flight_id", "ts", F.timestamp_seconds("ts").alias("at")).withWatermark("at", delay)
    return (timed.groupBy(F.session_window("at", gap).alias("life"), "flight_id").agg(F.max("ts").alias("last_ts"))
            .select("flight_id", "last_ts", (F.col("last_ts") + silent_s + 1).alias("expired_ts")))
