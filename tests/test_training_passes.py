"""What training reads, moves and keeps of the texts."""

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cliplens.operators import authors, models
from cliplens.plans import models as plans
from cliplens.plans.inputs import publish_times, videos
from tests.conftest import SF


@pytest.fixture(scope="module")
def seen(spark):
    """The rows of the author statistics, and the plan and columns of the written features."""
    found, stats, write = {}, authors.author_stats, plans.materialize

    def recorded(df, name, **options):
        if name == "features":
            found["columns"] = df.columns
            found["plan"] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name, **options)

    def counted(rows):
        found["authors"] = rows.inputFiles()
        return stats(rows)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(plans, "materialize", recorded)
        patch.setattr(authors, "author_stats", counted)
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # orders as a large table
        try:
            found["data"], found["side"] = plans.prepared(spark, SF)
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    return found


def test_author_statistics_read_no_orders(seen):
    assert seen["authors"] and not [f for f in seen["authors"] if "orders" in f]


def test_texts_are_not_shuffled_to_large_orders(seen):
    assert "SortMergeJoin" not in seen["plan"] and "hashpartitioning" not in seen["plan"]


def test_counts_are_written_in_place_of_all_words(seen):
    assert "terms" in seen["columns"] and "tokens" not in seen["columns"]


def test_vectors_are_those_of_all_words_and_of_joined_times(spark, seen):
    features = models.fit_features(seen["data"].where("is_train"), max_terms=50)
    slim = features.transform(models.with_known_tokens(seen["data"], features))
    rows = videos(spark, SF, "video_id", "title", "category", "author_id", "publish_time")
    whole = features.transform(models.with_tokens(
        models.model_features(rows, seen["side"]["stats"], seen["side"]["defaults"])))

    def vectors(df):
        return {r["video_id"]: r["v"] for r in df.select(
            "video_id", vector_to_array("features").alias("v")).collect()}

    made, wanted = vectors(slim), vectors(whole)
    assert made == wanted and len(made) == rows.count() > 0
    assert any(any(v[-50:]) for v in made.values())


def test_times_are_those_of_documents_once_each(spark):
    times, all_rows = publish_times(spark, SF), videos(spark, SF, "video_id", "publish_time")
    wanted = {r["video_id"]: r["publish_time"] for r in all_rows.where("publish_time is not null").collect()}
    assert {r["video_id"]: r["publish_time"] for r in times.collect()} == wanted
    assert times.count() == len(wanted) > 0
    assert times.agg(F.max("video_id")).first()[0] <= all_rows.agg(F.max("video_id")).first()[0]
