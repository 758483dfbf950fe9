import math

import numpy as np
import pytest

from wayfold.operators import models, windows


def test_quantiles_of_few_and_of_many_values(spark, monkeypatch):
    """Keys on either side of the limit agree with numpy; only those beyond it are spread over buckets."""
    rng = np.random.default_rng(3)
    held = {"a": 1, "b": 2, "c": 37, "d": 400, "e": 25}
    rows = [(k, float(round(rng.normal(), 2)), None if k == "e" or i % 3 == 0 else int(rng.integers(-9, 9))) for k, n in held.items() for i in range(n)]
    df = spark.createDataFrame([*rows, (None, 1.0, 1), ("f", None, None)], "k string, x double, y int").repartition(5)
    spread = []
    bucketed = windows._bucketed_quantiles
    monkeypatch.setattr(windows, "_bucketed_quantiles", lambda d, *a: spread.append({r.k for r in d.select("k").distinct().collect()}) or bucketed(d, *a))
    got = {r.k: r for r in windows.exact_quantiles(df, "k", ["x", "y"], [0.05, 0.5, 0.95], gathered=100).collect()}
    assert spread == [{"d"}] and set(got) == set(held)
    for k in held:
        for i, name in ((1, "x"), (2, "y")):
            values = [r[i] for r in rows if r[0] == k and r[i] is not None]
            for p in (0.05, 0.5, 0.95):
                have = got[k][f"{name}_q{round(p * 100):02d}"]
                assert have is None if not values else math.isclose(have, np.quantile(values, p), abs_tol=1e-12)
    assert {r.k: r for r in windows.exact_quantiles(df, "k", ["x", "y"], [0.05, 0.5, 0.95], gathered=0).collect()} == {
        r.k: r for r in windows.exact_quantiles(df, "k", ["x", "y"], [0.05, 0.5, 0.95]).collect()}


def test_reasons_grow_no_trees(spark, monkeypatch):
    """Reasons and scores are worked out apart: a query of one does not pay for the other."""
    monkeypatch.setattr(models, "isolation_scores", lambda *a, **k: pytest.fail("trees"))
    df = spark.createDataFrame([(f"F{i}", float(i == 7), 1.0) for i in range(50)], "flight_id string, a double, b double")
    assert [(r.flight_id, r.feature, r.z) for r in models.outlier_reasons(df).collect()] == [("F7", "a", pytest.approx(7.0))]
