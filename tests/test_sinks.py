"""Writers keep every row that an update does not name."""

import pytest

from wayfold.sources import sinks
from wayfold.sources.sinks import merge_table
from wayfold.storage import new_path


def test_merge_moves_from_to_and_inside_the_null_partition(spark):
    schema = "k string, v long, origin string"
    path = new_path(spark, "merged")

    def merge(*rows):
        merge_table(spark, path, spark.createDataFrame(rows, schema), ["k"], ["v"], "origin")
        return sorted(tuple(r) for r in spark.read.schema(schema).parquet(path).collect())

    merge(("a", 1, None), ("b", 1, None), ("c", 1, "LLBG"), ("d", 1, "LLBG"), ("e", 1, "OJAI"))
    rest = [("d", 1, "LLBG"), ("e", 1, "OJAI")]
    assert merge(("a", 2, None)) == [("a", 2, None), ("b", 1, None), ("c", 1, "LLBG"), *rest]           # inside
    assert merge(("c", 2, None)) == [("a", 2, None), ("b", 1, None), ("c", 2, None), *rest]             # to
    assert merge(("b", 2, "")) == [("a", 2, None), ("b", 2, None), ("c", 2, None), *rest]               # empty text
    assert merge(("a", 3, "LCLK")) == [("a", 3, "LCLK"), ("b", 2, None), ("c", 2, None), *rest]         # from
    assert merge(("b", 3, "LCLK"), ("c", 3, "LCLK")) == [("a", 3, "LCLK"), ("b", 3, "LCLK"), ("c", 3, "LCLK"), *rest]


class Stopped(Exception):
    pass


@pytest.mark.parametrize("stop_at", ["stage", "journal", "first move", "second move", "first removal", "last removal"])
def test_a_merge_that_stops_leaves_the_old_or_the_new_table(spark, monkeypatch, stop_at):
    schema = "k string, v long, origin string"
    path = new_path(spark, "merged")
    make = lambda *rows: spark.createDataFrame(rows, schema)
    merge_table(spark, path, make(("a", 1, "X:1"), ("b", 1, "Y"), ("c", 1, None), ("d", 1, "Y")), ["k"], ["v"], "origin")
    old = [("a", 1, "X:1"), ("b", 1, "Y"), ("c", 1, None), ("d", 1, "Y")]
    new = [("a", 2, "Y"), ("b", 2, "Z"), ("c", 2, None), ("d", 1, "Y")]
    calls = {"write": 0, "move": 0, "remove": 0}
    real = {x: getattr(sinks.Folder, x) for x in calls}
    limit = {"stage": ("write", 1), "journal": ("move", 2), "first move": ("move", 2), "second move": ("move", 3), "first removal": ("remove", 1), "last removal": ("remove", 3)}
    name, at = limit[stop_at]

    def stopping(x):
        def run(self, *args):
            calls[x] += 1
            if x == name and calls[x] == at:
                raise Stopped
            return real[x](self, *args)
        return run

    for x in calls:
        monkeypatch.setattr(sinks.Folder, x, stopping(x))
    with pytest.raises(Stopped):
        merge_table(spark, path, make(("a", 2, "Y"), ("b", 2, "Z"), ("c", 2, None)), ["k"], ["v"], "origin")
    monkeypatch.undo()
    rows = lambda: sorted(tuple(r) for r in sinks.read_table(spark, path, schema).collect())
    assert rows() == (old if stop_at == "stage" else new)
    assert not [x for x in sinks.Folder(spark, path).folders() if x.startswith("_")]
    merge_table(spark, path, make(("a", 3, "X:1"), ("b", 3, "Y"), ("c", 3, None)), ["k"], ["v"], "origin")
    assert rows() == [("a", 3, "X:1"), ("b", 3, "Y"), ("c", 3, None), ("d", 1, "Y")]
    sinks.recover(spark, path)
    assert rows() == [("a", 3, "X:1"), ("b", 3, "Y"), ("c", 3, None), ("d", 1, "Y")]
