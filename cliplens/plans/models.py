"""Registered queries: training, metrics, saved models and batch prediction."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliplens.functions import numbers as N
from cliplens.functions.text import model_tokens
from cliplens.functions.title import NUMERIC_FEATURES, view_bucket
from cliplens.operators import authors, merge, models
from cliplens.operators.joins import lookup_join
from cliplens.operators.tfidf import counted_rows
from cliplens.plans.inputs import VIDEOS_SQL, publish_times, table, videos, with_ctes
from cliplens.session import materialize, scratch_path, spread

V = with_ctes(VIDEOS_SQL)
COLUMNS = ["video_id", "title", "category", "author_id", "view_count"]


def prepared(spark: SparkSession, sf: str, leaky: bool = False) -> tuple[DataFrame, dict]:
    """Rows with features, counted terms, label, bucket and split, written once.

    Author statistics come from the training rows only; ``leaky`` takes all rows.
    Texts are read once and stay in their tasks: the publish times of their ids are
    brought to them, unless these are too many to broadcast.
    """
    rows = merge.split_train_test(videos(spark, sf, *COLUMNS))
    stats = materialize(authors.author_stats(rows if leaky else rows.where("is_train")), "authors")
    defaults = authors.author_defaults(stats)
    times = materialize(publish_times(spark, sf), "times")
    dated = lookup_join(spread(rows), times, ["video_id"], "left")
    made = models.model_features(dated, stats, defaults).withColumns({
        "label": F.log1p("view_count"), "bucket": view_bucket(F.col("view_count"))})
    kept = ["video_id", "category", *NUMERIC_FEATURES, "is_train", "label", "bucket"]
    data = counted_rows(made, kept, model_tokens(F.col("title")))
    return materialize(data, "features", compression="zstd"), {"stats": stats, "defaults": defaults}


def trained(spark: SparkSession, sf: str, kind: str) -> tuple[DataFrame, models.ModelStore]:
    """Rows with features, and the store that a fresh training has written."""
    data, side = prepared(spark, sf)
    features = models.fit_features(data.where("is_train"))
    data = models.with_known_tokens(data, features)
    train = data.where("is_train")
    # Written, not cached: the classifier keeps scaled blocks of all rows in memory itself.
    ready = materialize(features.transform(train).select("features", "label", "bucket"), "ready")
    model = models.fit_ridge(ready) if kind == "view" else models.fit_bucket_classifier(ready)
    store = models.ModelStore(spark, scratch_path(spark, "models"))
    store.save(features, {kind: model}, side["stats"], side["defaults"])
    return data, store


def requests(spark, sf) -> DataFrame:
    """One request per benchmark text, without author or time."""
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("request_id"), F.col("text").alias("title"),
        F.lit("未知").alias("category"))


def train_view_regressor(spark, sf):
    data, store = trained(spark, sf, "view")
    test = store.model("view").transform(store.features().transform(data.where("not is_train")))
    return models.regression_metrics(test)


def train_bucket_classifier(spark, sf):
    data, store = trained(spark, sf, "bucket")
    test = store.model("bucket").transform(store.features().transform(data.where("not is_train")))
    return models.classification_metrics(test, "bucket", "prediction")


def predict_view(spark, sf):
    _, store = trained(spark, sf, "view")
    asked = store.request_features(requests(spark, sf))
    return models.predict_view(store.features(), store.model("view"), asked).select(
        "request_id", "predicted_view", "bucket_id", "predicted_bucket", "explanations")


def predict_bucket(spark, sf):
    _, store = trained(spark, sf, "bucket")
    asked = store.request_features(requests(spark, sf))
    return models.predict_bucket(store.features(), store.model("bucket"), asked).select(
        "request_id", "bucket_id", "predicted_bucket", "probabilities")


def bucket_probability_sums(spark, sf):
    """The probabilities of all buckets of each request add up to one."""
    total = F.aggregate(F.map_values("probabilities"), F.lit(0.0), lambda s, p: s + p)
    return predict_bucket(spark, sf).select("request_id", N.rounded(total).alias("total"))


def model_roundtrip(spark, sf):
    """Rows scored by a reloaded model, and how far they are from those of the first load."""
    data, store = trained(spark, sf, "view")
    first = store.model("view").transform(store.features().transform(data))
    again = models.ModelStore(spark, scratch_path(spark, "models"))
    again.save(store.features(), {"view": store.model("view")},
               spark.read.parquet(f"{store.path}/author_stats"),
               spark.read.parquet(f"{store.path}/author_defaults"))
    both = again.model("view").setPredictionCol("reloaded").transform(first)
    return both.agg(F.count("reloaded").alias("n"), N.rounded(
        F.max(F.abs(F.col("prediction") - F.col("reloaded")))).alias("max_difference"))


def ridge_two_features(spark, sf):
    """Ridge on two counters: slopes and intercept, which have a closed form."""
    v = videos(spark, sf, "view_count", "like_count", "favorite_count").select(
        F.log1p("view_count").alias("label"), F.log1p("like_count").alias("a"),
        F.log1p("favorite_count").alias("b"))
    ready = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(v)
    model = models.fit_ridge(ready)
    a, b = (float(x) for x in model.coefficients)
    return v.agg(*[N.rounded(F.lit(x)).alias(name) for name, x in [
        ("slope_a", a), ("slope_b", b), ("intercept", float(model.intercept))]])


def importance_total(spark, sf):
    """Importances are shares: five features whose scores add up to one."""
    return feature_importance(spark, sf).agg(
        F.count("*").alias("n_features"), N.rounded(F.sum("score")).alias("total"))


def _author_mean(spark, sf):
    """A fixed prediction: the mean of the author."""
    v = videos(spark, sf, "video_id", "author_id", "view_count")
    means = v.groupBy("author_id").agg(F.avg("view_count").alias("mean"))
    return lookup_join(v, materialize(means, "author-means"), ["author_id"], "inner", salt_by=["video_id"])


def regression_metrics(spark, sf):
    rows = _author_mean(spark, sf).select(
        F.log1p("view_count").alias("label"), F.log1p("mean").alias("prediction"))
    path = scratch_path(spark, "metrics")
    models.regression_metrics(rows).write.json(path)
    saved = spark.read.schema(
        "r2 double, rmse_log double, mae_log double, mae_real double").json(path)
    return saved.select(*[N.rounded(F.col(c), 6 if c != "mae_real" else 2).alias(c)
                          for c in saved.columns])


def classification_metrics(spark, sf):
    rows = _author_mean(spark, sf).select(
        view_bucket(F.col("view_count")).alias("label"),
        view_bucket(F.col("mean")).alias("prediction"))
    m = models.classification_metrics(rows)
    return m.select(*[N.rounded(F.col(c)).alias(c) for c in m.columns])


def feature_importance(spark, sf):
    names = ["view_count", "like_count", "coin_count", "favorite_count", "share_count"]
    return models.feature_importance(videos(spark, sf, *names, "cluster_id"), names, "cluster_id")


QUERIES = {f.__name__: f for f in [
    train_view_regressor, train_bucket_classifier, predict_view, predict_bucket,
    bucket_probability_sums, model_roundtrip, ridge_two_features, regression_metrics,
    classification_metrics, feature_importance, importance_total,
]}


def _bucket(x: str) -> str:
    return f"CASE WHEN {x} < 100000 THEN 0 WHEN {x} < 500000 THEN 1 WHEN {x} < 2000000 THEN 2 ELSE 3 END"


ORACLES = {
    "bucket_probability_sums": "SELECT item_id AS request_id, 1.0::DOUBLE AS total FROM benchmark",
    "model_roundtrip": "SELECT count(*) AS n, 0.0::DOUBLE AS max_difference FROM documents",
    "importance_total": "SELECT CAST(5 AS BIGINT) AS n_features, 1.0::DOUBLE AS total",
    "ridge_two_features": V + """,
      v AS (SELECT ln(1.0::DOUBLE + view_count) AS y, ln(1.0::DOUBLE + like_count) AS a,
                   ln(1.0::DOUBLE + favorite_count) AS b FROM videos),
      s AS (SELECT var_pop(a) * count(*) + 1 AS aa, var_pop(b) * count(*) + 1 AS bb,
                   covar_pop(a, b) * count(*) AS ab, covar_pop(a, y) * count(*) AS ay,
                   covar_pop(b, y) * count(*) AS by_, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM v),
      k AS (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS ka,
                   (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS kb FROM s)
      SELECT round(ka, 6) AS slope_a, round(kb, 6) AS slope_b,
             round(my - ka * ma - kb * mb, 6) AS intercept FROM k""",
    "regression_metrics": V + """
      SELECT round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2,
             round(sqrt(avg((y - p) * (y - p))), 6) AS rmse_log,
             round(avg(abs(y - p)), 6) AS mae_log,
             round(avg(abs(exp(y) - exp(p))), 2) AS mae_real
      FROM (SELECT ln(1.0::DOUBLE + view_count) AS y, ln(1.0::DOUBLE + avg(view_count) OVER (
                PARTITION BY author_id)) AS p FROM videos)""",
    "classification_metrics": V + f""",
      c AS (SELECT {_bucket('view_count')} AS y, {_bucket('m')} AS p
            FROM (SELECT view_count, avg(view_count) OVER (PARTITION BY author_id) AS m FROM videos)),
      k AS (SELECT y AS c FROM c UNION SELECT p FROM c),
      per AS (SELECT k.c, (SELECT count(*) FROM c WHERE y = k.c) AS support,
                     (SELECT count(*) FROM c WHERE p = k.c) AS predicted,
                     (SELECT count(*) FROM c WHERE y = k.c AND p = k.c) AS tp FROM k)
      SELECT round(sum(tp) / sum(support), 6) AS accuracy,
             round(sum(coalesce(2.0 * tp / nullif(support + predicted, 0), 0) * support)
                   / sum(support), 6) AS f1_weighted FROM per""",
}
