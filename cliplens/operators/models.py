"""Popularity models: features, training, metrics and batch prediction."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    LogisticRegression, LogisticRegressionModel, RandomForestClassifier,
)
from pyspark.ml.feature import (
    CountVectorizerModel, ElementwiseProduct, Normalizer, OneHotEncoder, StandardScaler,
    StringIndexer, VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliplens.functions.numbers import finite_or_zero
from cliplens.functions.text import model_tokens, segment
from cliplens.functions.title import (
    BUCKET_NAMES, NUMERIC_FEATURES, bucket_name, explanations, time_features, title_features,
    view_bucket,
)
from cliplens.operators.authors import add_author_features
from cliplens.operators.tfidf import MODEL_TERMS, vocabulary
from cliplens.schema import ensure_columns


def model_features(rows: DataFrame, stats: DataFrame, defaults: DataFrame) -> DataFrame:
    """The 18 numeric features next to the input columns; missing values are 0."""
    rows = ensure_columns(rows, {"author_id": ("bigint", None), "publish_time": ("timestamp", None),
                                 "category": ("string", None)})
    made = rows.withColumns({**time_features(F.col("publish_time")),
                             **title_features(F.col("title"))})
    full = add_author_features(made, stats, defaults)
    return full.withColumns({c: finite_or_zero(F.col(c)) for c in NUMERIC_FEATURES})


def with_tokens(rows: DataFrame, tokenizer=segment) -> DataFrame:
    return rows.withColumn("tokens", model_tokens(F.col("title"), tokenizer))


def with_known_tokens(rows: DataFrame, features: PipelineModel) -> DataFrame:
    """``tokens`` in place of counted ``terms``: words of the vocabulary, each as often as it occurs.

    Other words have no weight in the features, so the vectors are those of all tokens.
    """
    words = next(s for s in features.stages if isinstance(s, CountVectorizerModel)).vocabulary
    known = F.filter("terms", lambda t: t["term"].isin(words))
    tokens = F.flatten(F.transform(known, lambda t: F.array_repeat(t["term"], t["tf"].cast("int"))))
    return rows.withColumn("tokens", tokens).drop("terms")


def fit_features(train: DataFrame, max_terms: int = MODEL_TERMS) -> PipelineModel:
    """Scaled numbers, one-hot category and TF-IDF of the title tokens, assembled.

    Scaling uses the population deviation and idf is smoothed by one, both as
    constant factors on top of the built-in stages. Vocabulary and idf come from
    one pass over the ``terms`` of ``train``, which are counted in each row.
    """
    vocab = vocabulary(train.select("terms"), max_terms).orderBy(
        F.desc("total"), "term").collect()  # at most max_terms
    n = train.count()
    numeric = Pipeline(stages=[
        VectorAssembler(inputCols=NUMERIC_FEATURES, outputCol="num_raw"),
        StandardScaler(withMean=True, inputCol="num_raw", outputCol="num_sample"),
        StringIndexer(inputCol="category", outputCol="cat_index", handleInvalid="keep"),
        OneHotEncoder(inputCol="cat_index", outputCol="cat_vec", dropLast=True),
    ]).fit(train.select(*NUMERIC_FEATURES, "category"))
    grow = math.sqrt(n / (n - 1)) if n > 1 else 1.0
    words = [r["term"] for r in vocab] or ["\0"]  # a vocabulary may not be empty
    idf = [r["idf"] for r in vocab] or [0.0]
    return PipelineModel(stages=[
        *numeric.stages,
        CountVectorizerModel.from_vocabulary(words, "tokens", "tf"),
        ElementwiseProduct(scalingVec=Vectors.dense([grow] * len(NUMERIC_FEATURES)),
                           inputCol="num_sample", outputCol="num"),
        ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="tf", outputCol="tfidf_raw"),
        Normalizer(p=2.0, inputCol="tfidf_raw", outputCol="tfidf"),
        VectorAssembler(inputCols=["num", "cat_vec", "tfidf"], outputCol="features"),
    ])


class ModelStore:
    """Everything a prediction needs, in one folder: features, models and author tables."""

    MODELS = {"view": LinearRegressionModel, "bucket": LogisticRegressionModel}

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save(self, features: PipelineModel, models: dict, stats: DataFrame, defaults: DataFrame) -> None:
        features.write().overwrite().save(f"{self.path}/features")
        for kind, model in models.items():
            model.write().overwrite().save(f"{self.path}/{kind}")
        stats.write.mode("overwrite").parquet(f"{self.path}/author_stats")
        defaults.write.mode("overwrite").parquet(f"{self.path}/author_defaults")

    def features(self) -> PipelineModel:
        return PipelineModel.load(f"{self.path}/features")

    def model(self, kind: str):
        return self.MODELS[kind].load(f"{self.path}/{kind}")

    def request_features(self, requests: DataFrame) -> DataFrame:
        """Numeric features of requests, with the authors known when the models were trained."""
        return model_features(requests, self.spark.read.parquet(f"{self.path}/author_stats"),
                              self.spark.read.parquet(f"{self.path}/author_defaults"))


def fit_ridge(train: DataFrame, alpha: float = 1.0, label: str = "label"):
    """Ridge by normal equations in one pass; the solver scales the penalty by the label."""
    s = train.agg(F.count("*").alias("n"), F.stddev_pop(label).alias("sd")).first()
    return LinearRegression(
        featuresCol="features", labelCol=label, elasticNetParam=0.0, standardization=False,
        solver="normal", regParam=alpha * (s["sd"] or 1.0) / s["n"],
    ).fit(train)


def fit_bucket_classifier(train: DataFrame, c: float = 1.0, max_iter: int = 1000,
                          label: str = "bucket"):
    n = train.count()
    return LogisticRegression(
        featuresCol="features", labelCol=label, family="multinomial", standardization=False,
        regParam=1.0 / (c * n), maxIter=max_iter, tol=1e-6,
    ).fit(train)


def regression_metrics(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """R2, RMSE and MAE on the log scale and MAE on the real scale, from one pass."""
    y, p = F.col(label), F.col(pred)
    n = F.count("*")
    sse = F.sum((y - p) * (y - p))
    sst = F.var_pop(y) * n
    return df.agg(
        (1 - F.try_divide(sse, sst)).alias("r2"),
        F.sqrt(sse / n).alias("rmse_log"),
        F.avg(F.abs(y - p)).alias("mae_log"),
        F.avg(F.abs(F.expm1(y) - F.expm1(p))).alias("mae_real"),
    )


def classification_metrics(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Accuracy and support-weighted F1 from the confusion counts."""
    confusion = df.groupBy(F.col(label).alias("y"), F.col(pred).alias("p")).agg(
        F.count("*").alias("n"))
    cells = confusion.select("n", F.explode(F.array(
        F.struct(F.col("y").alias("c"), F.lit(1).alias("is_true"), F.lit(0).alias("is_pred")),
        F.struct(F.col("p").alias("c"), F.lit(0).alias("is_true"), F.lit(1).alias("is_pred")),
    )).alias("e"), (F.col("y") == F.col("p")).alias("hit"))
    per_class = cells.groupBy("e.c").agg(
        F.sum(F.col("n") * F.col("e.is_true")).alias("support"),
        F.sum(F.col("n") * F.col("e.is_pred")).alias("predicted"),
        F.sum(F.when(F.col("hit"), F.col("n") * F.col("e.is_true")).otherwise(0)).alias("tp"),
    )
    f1 = F.coalesce(
        F.try_divide(2.0 * F.col("tp"), F.col("support") + F.col("predicted")), F.lit(0.0))
    return per_class.agg(
        F.try_divide(F.sum("tp").cast("double"), F.sum("support")).alias("accuracy"),
        F.try_divide(F.sum(f1 * F.col("support")), F.sum("support")).alias("f1_weighted"),
    )


def predict_view(features: PipelineModel, model, requests: DataFrame) -> DataFrame:
    """Predicted views, bucket and explanations for a table of requests with features."""
    scored = model.transform(features.transform(with_tokens(requests)))
    views = F.expm1("prediction")
    bucket = view_bucket(F.col("predicted_view"))
    return scored.withColumn("predicted_view", views).select(
        *requests.columns, "predicted_view", bucket.alias("bucket_id"),
        bucket_name(bucket).alias("predicted_bucket"),
        explanations(F.col("title_len"), F.col("question_cnt"), F.col("has_brackets"))
        .alias("explanations"),
    )


def predict_bucket(features: PipelineModel, model, requests: DataFrame) -> DataFrame:
    """Most likely bucket and a map from bucket name to probability."""
    scored = model.transform(features.transform(with_tokens(requests)))
    names = F.array(*[F.lit(n) for n in BUCKET_NAMES[:model.numClasses]])
    bucket = F.col("prediction").cast("bigint")
    return scored.select(
        *requests.columns, bucket.alias("bucket_id"),
        bucket_name(bucket).alias("predicted_bucket"),
        F.map_from_arrays(names, vector_to_array("probability")).alias("probabilities"),
    )


def feature_importance(df: DataFrame, features: list[str], target: str, n_trees: int = 50,
                       max_depth: int = 12, seed: int = 42, max_rows: int = 100_000) -> DataFrame:
    """(feature, score) of a random forest, highest first; rows without target dropped.

    The trees are grown on at most ``max_rows`` labelled rows, taken by a hash
    of their values, since all trees are held by the driver.
    """
    clean = df.select(target, *features).na.drop()
    n = clean.count()
    if n > max_rows:
        clean = clean.orderBy(F.xxhash64(*clean.columns, F.lit(seed))).limit(max_rows)
    index = StringIndexer(inputCol="_target", outputCol="_label")
    labelled = clean.withColumn("_target", F.col(target).cast("string"))
    ready = VectorAssembler(inputCols=features, outputCol="features").transform(
        index.fit(labelled).transform(labelled))
    forest = RandomForestClassifier(
        labelCol="_label", numTrees=n_trees, maxDepth=max_depth, maxBins=64,
        featureSubsetStrategy="sqrt", seed=seed).fit(ready.select("features", "_label"))
    scores = list(zip(features, (float(x) for x in forest.featureImportances.toArray())))
    return df.sparkSession.createDataFrame(scores, "feature string, score double").orderBy(
        F.col("score").desc(), "feature")
