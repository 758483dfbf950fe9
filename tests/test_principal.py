"""Components of all flows in one pass against one model for each flow."""

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector

from wayfold.operators import models, principal


def rows(flows=(200, 60, 3, 1), width=8, seed=4):
    """Flow 0 holds most rows; the last flow has one."""
    r, out = np.random.default_rng(seed), []
    for flow, n in enumerate(flows):
        spread = r.normal(size=(width, width)) * np.linspace(3, 0.1, width)[:, None]
        out += [(f"F{flow}-{i}", flow, [float(v) for v in (r.normal(size=width) @ spread + flow)]) for i in range(n)]
    return out


def errors(x, axes):
    return ((x - x @ axes.T @ axes) ** 2).mean(axis=1)


def test_moments_equal_numpy_whatever_the_partitions(spark):
    data = rows()
    for parts in (1, 7, 150):
        df = spark.createDataFrame(data, "flight_id string, flow int, x array<double>").repartition(parts)
        got = {m["flow"]: m for m in principal.moments(df, "flow").collect()}
        assert set(got) == {0, 1, 2, 3}
        for flow, m in got.items():
            x = np.asarray([v for _, f, v in data if f == flow])
            d = x - x.mean(axis=0)
            assert m["n"] == len(x) and np.allclose(m["mean"], x.mean(axis=0))
            assert np.allclose(m["products"], (d.T @ d).ravel(), atol=1e-9)


def test_models_equal_one_model_for_each_flow(spark):
    data = rows()
    df = spark.createDataFrame(data, "flight_id string, flow int, x array<double>")
    vec = df.select("flight_id", "flow", array_to_vector("x").alias("features")).cache()
    got = {m["flow"]: np.asarray(m["axes"]) for m in principal.models(df, "flow", 3).collect()}
    for flow in range(4):
        part = vec if flow == 3 else vec.where(f"flow = {flow}")
        pc = PCA(k=3, inputCol="features", outputCol="p").fit(part).pc.toArray().T
        x = np.asarray([v for _, f, v in data if f == flow])
        kept = 2 if flow == 2 else 3        # three rows span two directions, the third is free
        assert np.allclose(got[flow][:kept].T @ got[flow][:kept], pc[:kept].T @ pc[:kept], atol=1e-8), flow
        assert np.allclose(got[flow] @ got[flow].T, np.eye(3), atol=1e-9) and x.shape[1] == got[flow].shape[1]


def test_reconstruction_flags_by_the_exact_quantile(spark):
    data = rows(width=8)
    vectors = spark.createDataFrame(data, "flight_id string, flow int, x array<double>")
    df = vectors.select("flight_id", "flow", array_to_vector("x").alias("features"))
    scored, point = models.reconstruction(df, dims=3, quantile=0.9)
    got = {r["flight_id"]: r for r in scored.collect()}
    assert len(got) == len(data)
    axes = {m["flow"]: np.asarray(m["axes"]) for m in principal.models(vectors, "flow", 3).collect()}
    for flow in range(4):
        mine = [(i, v) for i, f, v in data if f == flow]
        loss = errors(np.asarray([v for _, v in mine]), axes[flow])
        at = np.quantile(loss, 0.9)
        for (i, _), l in zip(mine, loss):
            assert abs(got[i]["loss"] - l) < 1e-9 * max(1, l) and abs(got[i]["threshold"] - at) < 1e-9 * max(1, at)
            assert got[i]["is_anomaly"] == (got[i]["loss"] > got[i]["threshold"])
    e = {(r["flight_id"], r["idx"]): r["error"] for r in point.collect()}
    assert len(e) == 2 * len(data)
    assert abs((e["F0-0", 0] + e["F0-0", 1]) / 2 - got["F0-0"]["loss"]) < 1e-9


def test_no_rows_and_rows_without_a_vector(spark):
    empty = spark.createDataFrame([("a", 0, None)], "flight_id string, flow int, x array<double>")
    assert principal.models(empty, "flow", 3).count() == 0
    held = empty.unionByName(spark.createDataFrame(rows((5,)), "flight_id string, flow int, x array<double>"))
    assert principal.moments(held, "flow").first()["n"] == 5
