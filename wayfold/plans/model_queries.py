"""Model layers: no SQL counterpart, checked by rows and by unit tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.operators import layers as ly, models as mo, sequence as sq
from wayfold.plans.registry import query, sql_delta, sql_hav

c = F.col


def _per_flight(t):
    return t.kept("features", lambda: sq.flight_features(sq.point_features(t.tracks)))


def _features(t):
    return _per_flight(t).join(t.reports.select("flight_id", c("is_anomaly").alias("label")), "flight_id")


def _scored(t):
    f = t.kept("labelled", lambda: _features(t))
    return mo.classify(mo.train_classifier(f), f)


def _held_out(t):
    """Scores of a fifth of the flights, by hash of the id, from a model of the others."""
    f = t.kept("labelled", lambda: _features(t))
    apart = F.pmod(F.xxhash64("flight_id"), F.lit(5)) == 0
    return mo.classify(mo.train_classifier(f.where(~apart)), f.where(apart))


def _flows(t):
    v = t.kept("vectors", lambda: mo.trajectory_vectors(ly.resample_by_time(t.tracks, 50)))
    return t.kept("flows", lambda: mo.flow_clusters(v))


query("k01_classifier_scores")(lambda t: _scored(t).withColumn("score", F.round("score", 6)))
query("k02_classifier_quality")(lambda t: mo.evaluate(_held_out(t)))
query("k03_outliers")(lambda t: mo.outliers(_per_flight(t)))
query("k03_outlier_reasons")(lambda t: mo.outlier_reasons(_per_flight(t)))
query("s22_flow_clusters")(lambda t: _flows(t).select("flight_id", "flow"))
query("k04_flow_reconstruction")(lambda t: mo.reconstruction(_flows(t))[0])
query("k05_scored_with_flow")(lambda t: mo.reconstruction(_flows(t))[0].select("flight_id", "flow", "is_anomaly", F.round("severity", 6).alias("severity")))
query("k06_point_errors")(lambda t: mo.map_to_points(t.tracks, mo.reconstruction(_flows(t))[1]))
query("k07_global_reconstruction")(lambda t: mo.reconstruction(_flows(t), quantile=0.99, per_flow=False)[0])


def _u01(t):
    """The public functions called from plain SQL."""
    from wayfold.functions.sql import register
    register(t.spark)
    return t.spark.sql("select flight_id, ts, round(haversine_nm(lat, lon, 32.011389, 34.886667), 4) as nm, heading_delta(track, 90) as delta, "
                       "flight_phase(alt, vspeed) as phase from {x}", x=t.tracks)


query("u01_sql_functions", f"select flight_id, ts, round({sql_hav('lat', 'lon', '32.011389', '34.886667')},4) as nm, {sql_delta('track', '90')} as delta, "
      "case when alt < 1000 then 'ground' when vspeed > 400 then 'climb' when vspeed < -400 then 'descent' else 'cruise' end as phase from tracks")(_u01)
