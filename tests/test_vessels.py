"""Vessel messages: parsing, and a register that does not depend on the order of batches."""

import json

from wayfold.operators import marine as ma
from wayfold.sources import sinks
from wayfold.streaming import jobs as sj

SCHEMA = "seq bigint, received bigint, value string"


def static(mmsi, at, name, code=70, **more):
    body = {"Name": name, "Type": code, "Dimension": {"A": 10, "B": 20, "C": 3, "D": None}, **more}
    return at, json.dumps({"MessageType": "ShipStaticData", "MetaData": {"MMSI": mmsi, "ShipName": "meta"}, "Message": {"ShipStaticData": body}})


def position(mmsi, at, lat=31.0):
    return at, json.dumps({"MessageType": "PositionReport", "MetaData": {"MMSI": mmsi}, "Message": {"PositionReport": {"Latitude": lat, "Longitude": 33.0, "Sog": 4.5}}})


def run(spark, batches):
    """One file, and one batch, for each list of messages."""
    rows = [(b, at, text) for b, batch in enumerate(batches) for at, text in batch]
    path, schema = sj.as_files(spark.createDataFrame(rows, SCHEMA), files=len(batches), order="seq")
    root = sj.scratch(spark)
    sj.ingest_vessels(sj.stream_of(spark, path, schema, per_trigger=1), root)
    return root


def test_envelopes(spark):
    texts = [static("1", 5, "  ", 81)[1], static(None, 5, "x")[1], static(" ", 5, "x")[1], "{", "", None, position("2", 6)[1], position("3", 6, None)[1],
             json.dumps({"MessageType": "Other", "MetaData": {"MMSI": "4"}, "Message": {}}), json.dumps({"MetaData": {"MMSI": "5"}})]
    e = ma.ais_envelopes(spark.createDataFrame([(i, i, x) for i, x in enumerate(texts)], SCHEMA))
    s = [r.asDict() for r in ma.static_reports(e).collect()]
    assert [(r["mmsi"], r["vessel_name"], r["vessel_type_description"], r["length_m"], r["width_m"]) for r in s] == [("1", "meta", "Tanker", 30, None)]
    p = ma.position_reports(e).collect()
    assert [(r["mmsi"], r["latitude"], r["speed_over_ground"], r["ts"].timestamp()) for r in p] == [("2", 31.0, 4.5, 6.0)]
    assert ma.static_reports(e.limit(0)).count() == 0


def test_register_holds_the_newest_message_in_any_order(spark):
    a, b, late = static("1", 10, "old"), static("1", 20, "new", CallSign="C"), static("1", 15, "between")
    tie = static("2", 7, "b"), static("2", 7, "a")
    other = static("3", 1, "alone", 30)
    found = []
    for batches in ([[a, position("1", 1)], [b, tie[0]], [late, tie[1]], [other, position("9", 3)]], [[b, tie[1], position("1", 1)], [late, other], [a, tie[0]], [position("9", 3)]]):
        root = run(spark, batches)
        found.append(sorted((r["mmsi"], r["vessel_name"], r["call_sign"], r["last_updated"]) for r in sinks.read_table(spark, f"{root}/register").collect()))
        assert sorted(r["mmsi"] for r in spark.read.parquet(f"{root}/positions").collect()) == ["1", "9"]
    assert found[0] == found[1] == [("1", "new", "C", 20), ("2", "b", None, 7), ("3", "alone", None, 1)]
