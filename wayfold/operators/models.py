"""Model layers with Spark ML: classifier, outlier layer, reconstruction error."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.operators import principal
from wayfold.operators.isolation import flagged, isolation_scores
from wayfold.operators.nearest import bounded_broadcast
from wayfold.operators.windows import cut, exact_quantiles

c = F.col
KEYS = ("flight_id", "label", "duration", "num_points")


def feature_names(df: DataFrame) -> list[str]:
    return [x for x in df.columns if x not in ("flight_id", "label")]


def train_classifier(features: DataFrame, iterations: int = 10, depth: int = 3, seed: int = 42):
    """Boosted trees over the flight features; ``features`` carries a 0/1 label."""
    va = VectorAssembler(inputCols=feature_names(features), outputCol="features", handleInvalid="keep")
    gbt = GBTClassifier(labelCol="label", featuresCol="features", maxIter=iterations, maxDepth=depth, seed=seed)
    return Pipeline(stages=[va, gbt]).fit(features)


def classify(model, features: DataFrame, threshold: float = 0.5) -> DataFrame:
    score = vector_to_array("probability")[1]
    return model.transform(features).select("flight_id", "label", score.alias("score")).withColumn("is_anomaly", c("score") > threshold)


def evaluate(scored: DataFrame) -> DataFrame:
    """AUC, area under precision and recall, precision and recall as one row."""
    asked = scored.withColumn("label", c("label").cast("double"))
    area = lambda name: BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="score", metricName=name).evaluate(asked)
    auc, pr = area("areaUnderROC"), area("areaUnderPR")
    hit = F.count_if(c("is_anomaly") & (c("label") == 1))
    return scored.agg(F.lit(float(auc)).alias("auc"), F.lit(float(pr)).alias("pr_auc"), F.try_divide(hit, F.count_if("is_anomaly")).alias("precision"),
                      F.try_divide(hit, F.count_if(c("label") == 1)).alias("recall"), F.count("*").alias("flights"))


def outliers(features: DataFrame, contamination: float = 0.01) -> DataFrame:
    """Scores by isolation trees, the top share flagged."""
    return flagged(isolation_scores(features, feature_names(features)), contamination)


def outlier_reasons(features: DataFrame, sigma: float = 2.0) -> DataFrame:
    """(flight, feature, z) beyond ``sigma`` deviations from the mean of all flights."""
    names = feature_names(features)
    stats = features.agg(*[F.avg(x).alias(f"m_{x}") for x in names], *[F.stddev_pop(x).alias(f"s_{x}") for x in names]).withColumn("_k", F.lit(1))
    j = features.withColumn("_k", F.lit(1)).join(F.broadcast(stats), "_k")      # one row
    z = {x: F.when(c(f"s_{x}") > 0, (c(x) - c(f"m_{x}")) / c(f"s_{x}")).otherwise(F.lit(0.0)) for x in names}
    zz = cut(j.select("flight_id", *[v.alias(k) for k, v in z.items()]))
    pairs = F.explode(F.array(*[F.struct(F.lit(x).alias("feature"), c(x).alias("z")) for x in names]))
    return zz.select("flight_id", pairs.alias("p")).select("flight_id", "p.*").where(F.abs("z") > sigma)


def outlier_layer(features: DataFrame, contamination: float = 0.01, sigma: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """``outliers`` and ``outlier_reasons`` of one frame."""
    return outliers(features, contamination), outlier_reasons(features, sigma)


def trajectory_vectors(resampled: DataFrame) -> DataFrame:
    """One vector of 50 x 4 values per flight; the list per flight has a fixed length."""
    seq = F.array_sort(F.collect_list(F.struct("idx", "lat", "lon", "alt", "track")))
    flat = F.flatten(F.transform(seq, lambda s: F.array(s["lat"], s["lon"], s["alt"], s["track"])))
    return resampled.groupBy("flight_id").agg(flat.alias("v")).select("flight_id", array_to_vector("v").alias("raw"))


def standardise(vectors: DataFrame) -> DataFrame:
    return StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(vectors).transform(vectors)


def flow_clusters(vectors: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """Flow label per flight over standardised vectors."""
    s = standardise(vectors)
    return KMeans(k=k, seed=seed, featuresCol="features", predictionCol="flow").fit(s).transform(s)


def reconstruction(clustered: DataFrame, dims: int = 3, quantile: float = 0.995, per_flow: bool = True) -> tuple[DataFrame, DataFrame]:
    """Reconstruction error per flight against its flow's exact threshold quantile; severity is loss over threshold.

    The models of all flows come from one pass; a flow of one flight has none of its own and takes that of all flights.
    Second result: squared error per (flight, idx).
    """
    x = clustered.select("flight_id", c("flow") if per_flow else F.lit(0).alias("flow"), vector_to_array("features").alias("x"))
    j = x.join(bounded_broadcast(principal.models(x, "flow", dims)), "flow")
    j = j.withColumn("y", F.transform("axes", lambda a: F.aggregate(F.zip_with("x", a, lambda v, w: v * w), F.lit(0.0), lambda s, q: s + q)))
    # What the components say of value i, taken from the value.
    said = lambda i: F.aggregate(F.zip_with("axes", "y", lambda a, y: F.get(a, i) * y), F.lit(0.0), lambda s, q: s + q)
    errs = cut(cut(j).select("flight_id", "flow", F.transform("x", lambda v, i: F.pow(v - said(i), F.lit(2.0))).alias("e")))
    loss = errs.select("flight_id", "flow", (F.aggregate("e", F.lit(0.0), lambda s, x: s + x) / F.size("e")).alias("loss"))
    limit = exact_quantiles(loss, "flow", ["loss"], [quantile]).withColumnRenamed(f"loss_q{round(quantile * 100):02d}", "threshold")
    scored = loss.join(bounded_broadcast(limit), "flow").withColumns({"severity": c("loss") / c("threshold"), "is_anomaly": c("loss") > c("threshold")})
    point = errs.select("flight_id", F.posexplode(F.transform(F.sequence(F.lit(0), (F.size("e") / 4 - 1).cast("int")), lambda i: F.aggregate(
        F.slice("e", (i * 4 + 1).cast("int"), 4), F.lit(0.0), lambda s, x: s + x) / 4)).alias("idx", "error"))
    return scored, point


def map_to_points(tracks: DataFrame, point_errors: DataFrame, n: int = 50) -> DataFrame:
    """Original points with the error of the nearest resampled index by progress in time."""
    span = tracks.groupBy("flight_id").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1")).where("t1 > t0")
    idx = F.bround((c("ts") - c("t0")) / (c("t1") - c("t0")) * (n - 1)).cast("int")
    return (tracks.select("flight_id", "ts", "lat", "lon").join(span, "flight_id").withColumn("idx", idx)
            .join(point_errors, ["flight_id", "idx"]).select("flight_id", "ts", "lat", "lon", "error"))
