"""Isolation trees against a direct walk, and flags free of partitioning."""

import math
import random

import numpy as np

from wayfold.operators import isolation as iso
from wayfold.operators.models import outlier_layer


def test_path_lengths_equal_a_direct_walk():
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(size=(400, 5)), np.full((3, 5), 9.0)])
    x[:, 4] = 1.0           # a constant feature is never cut
    f = iso.Forest(x, trees=20, sample=64)
    assert len(f.roots) == 20 and (f.feature < 4).all()

    def walk(row, at, depth=0):
        if f.feature[at] < 0:
            return f.value[at]
        return walk(row, f.left[at] if row[f.feature[at]] <= f.value[at] else f.right[at])

    want = np.asarray([np.mean([walk(row, root) for root in f.roots]) for row in x])
    assert np.allclose(f.path_lengths(x), want, atol=1e-12)
    s = f.scores(x)
    assert ((s > 0) & (s < 1)).all() and s[-3:].min() > np.quantile(s, 0.97)


def test_leaves_count_the_rows_left_in_them():
    r = np.random.default_rng(3)
    x = r.normal(size=(32, 2))
    f = iso.Forest(x, trees=1, sample=32)

    def check(rows, at, depth):
        if f.feature[at] < 0:
            assert math.isclose(f.value[at], depth + float(iso.expected_depth(len(rows)))) and (depth == 5 or len(rows) == 1)
            return
        low = rows[:, f.feature[at]] <= f.value[at]
        assert 0 < low.sum() < len(rows)
        check(rows[low], f.left[at], depth + 1)
        check(rows[~low], f.right[at], depth + 1)

    check(x, f.roots[0], 0)
    assert iso.expected_depth([0, 1, 2]).tolist() == [0, 0, 1]
    assert iso.Forest(np.ones((5, 2)), trees=3).scores(np.ones((2, 2))).tolist() == [0.5, 0.5]


def test_flags_do_not_depend_on_partitions(spark):
    r = random.Random(4)
    rows = [(f"F{i:04d}", r.gauss(0, 1), r.gauss(0, 1) if i % 50 else None, 3.0) for i in range(600)] + [("X1", 30.0, -20.0, 3.0), ("X2", float("nan"), 40.0, 3.0)]
    df = spark.createDataFrame(rows, "flight_id string, a double, b double, k double")
    one, why = outlier_layer(df.repartition(2))
    two, _ = outlier_layer(df.orderBy("a").repartition(7))
    got = sorted(map(tuple, one.collect()))
    assert got == sorted(map(tuple, two.collect())) and len(got) == 602
    s = np.asarray([x[1] for x in got])
    flags = {x[0] for x in got if x[2]}
    assert flags == {x[0] for x in got if x[1] > np.quantile(s, 0.99)} and {"X1", "X2"} <= flags
    assert {x.flight_id for x in why.where("feature = 'a' and z > 2").collect()} >= {"X1"}
    assert outlier_layer(df.limit(0))[0].collect() == []
