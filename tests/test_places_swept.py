"""Near joins by place: many flights at one place, against brute force."""

import random

import pytest

from tests.conftest import T0
from tests.test_geo import hav
from wayfold.operators import sweep
from wayfold.streaming import jobs as sj


def crowd():
    r = random.Random(8)
    spots = [(T0 + r.randint(0, 30), 31 + r.randint(0, 3) * 0.03, 34.0, r.choice((9000.0, 9500.0, 12_000.0))) for _ in range(12)]
    held = {(f"F{r.randint(0, 14)}", *r.choice(spots)) for _ in range(160)}
    return sorted({(x[0], x[1]): x for x in sorted(held)}.values())


SCHEMA = "flight_id string, ts bigint, lat double, lon double, alt double"


def near(rows):
    return [(a, b) for a in rows for b in rows if a[0] != b[0] and abs(a[1] - b[1]) <= 5 and abs(a[4] - b[4]) <= 999 and hav(a[2], a[3], b[2], b[3]) <= 4]


@pytest.mark.parametrize("pairs", [1 << 20, 3])
def test_counts_and_first_by_place(spark, monkeypatch, pairs):
    monkeypatch.setattr(sweep, "PAIRS", pairs)
    rows = crowd()
    odd = [("F1", T0 + 99, None, 34.0, 1.0), ("F2", T0, 31.0, 34.0, None), ("F3", T0, float("nan"), 34.0, 9000.0), (None, T0, 31.0, 34.0, 9000.0)]
    df = spark.createDataFrame(rows + odd, SCHEMA)
    found, want, first = near(rows), {}, {}
    for a, b in sorted(found, key=lambda p: (p[0], p[1][1], p[1][0])):
        want[a[0]] = want.get(a[0], 0) + 1
        first.setdefault(a, (b[1], b[0]))
    assert {r.flight_id: r.pairs for r in sweep.near_counts(df, 4, 5, 999).collect()} == want and len(found) > 300
    got = sweep.first_near(df, df, 4, 5, 999).collect()
    assert sorted((r.flight_id, r.ts, r.b_ts, r.b_flight_id) for r in got) == sorted((*a[:2], *v) for a, v in first.items())


def test_copies_in_place_add_no_pairs_to_the_sweep(spark, monkeypatch):
    seen = []
    real = sweep.near_swept

    def counting(left, right, *args, **kw):
        seen.append((left.count(), right.count()))
        return real(left, right, *args, **kw)

    monkeypatch.setattr(sweep, "near_swept", counting)
    df = spark.createDataFrame([(f"F{i}", T0, 31.0, 34.0, 9000.0) for i in range(500)], SCHEMA)
    assert {r.pairs for r in sweep.near_counts(df, 4, 5, 999).collect()} == {499}
    assert {r.b_flight_id for r in sweep.first_near(df, df, 4, 5, 999).collect()} == {"F0", "F1"}
    assert seen == [(1, 1), (1, 2)]


def test_streamed_counts_over_batches(spark, tmp_path):
    """One file a batch, out of order of time, so that pairs lie within and between batches."""
    rows = crowd()
    for i in range(3):
        spark.createDataFrame(rows[i::3], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    df = spark.createDataFrame(rows, SCHEMA)
    sj.count_proximity(sj.stream_of(spark, f"{tmp_path}/in", df.schema, per_trigger=1), f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out/pairs")
    assert got.select("batch").distinct().count() == 3
    want = {}
    for a, _ in near(rows):
        want[a[0]] = want.get(a[0], 0) + 1
    assert {r.flight_id: r["sum(pairs)"] for r in got.groupBy("flight_id").sum("pairs").collect()} == want
