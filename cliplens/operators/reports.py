"""Reports over clustered videos."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cliplens.operators.joins import fits_broadcast, lookup_join
from cliplens.operators.quantiles import grouped_quantiles
from cliplens.operators.ranking import numbered


def cluster_sizes(df: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    return df.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(F.count("*").alias("n"))


def cluster_summary(df: DataFrame, cluster: str) -> DataFrame:
    """Rows, clusters without noise, noise rows and their share; NULL is no cluster."""
    label = F.col(cluster)
    return df.agg(
        F.count("*").alias("total_videos"),
        F.countDistinct(F.when(label != -1, label)).alias("n_clusters"),
        F.count_if(label == -1).alias("n_noise"),
    ).withColumn("noise_ratio", F.try_divide(F.col("n_noise").cast("double"), F.col("total_videos")))


def topic_stats(df: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Videos, total and mean views per cluster, ranked by total views."""
    stats = df.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(
        F.count("*").alias("total_videos"),
        F.sum("view_count").alias("total_views"),
        F.avg("view_count").alias("average_views"),
    )
    return numbered(stats, [F.col("total_views").desc(), F.col(cluster)], "topic_rank")


def top_videos(df: DataFrame, k: int = 5, cluster: str = "cluster_id") -> DataFrame:
    """The ``k`` most viewed videos of each cluster."""
    w = Window.partitionBy(cluster).orderBy(F.col("view_count").desc(), F.col("video_id"))
    return (
        df.where(F.col(cluster).isNotNull())
        .withColumn("rank", F.row_number().over(w).cast("bigint"))
        .where(F.col("rank") <= k)
    )


def category_stats(df: DataFrame) -> DataFrame:
    rows = df.select("category", "view_count").where(F.col("category").isNotNull())
    means = rows.groupBy("category").agg(
        F.count("*").alias("n"), F.avg("view_count").alias("avg_view")
    )
    medians = grouped_quantiles(rows, ["category"], "view_count", {"median_view": 0.5})
    return means.join(medians, "category", "left")


def topic_report(videos: DataFrame, keywords: DataFrame, top_k_videos: int = 5) -> DataFrame:
    """One row per cluster: statistics, ordered key terms and ordered top videos."""
    stats = topic_stats(videos)
    terms = keywords.groupBy("cluster_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("_t")
    )
    # Ranks come first and titles follow by id, so texts are not shuffled for ranking.
    best = top_videos(videos.select("cluster_id", "video_id", "view_count"), top_k_videos)
    named = lookup_join(videos.select("video_id", "title"), best, ["video_id"], "inner")
    tops = named.groupBy("cluster_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "title", "view_count"))).alias("_v")
    )
    return (
        stats.join(terms, "cluster_id", "left").join(tops, "cluster_id", "left")
        .select(
            "cluster_id", "topic_rank", "total_videos", "total_views", "average_views",
            F.array_join(F.col("_t.term"), " ").alias("top_terms"),
            F.array_join(F.col("_v.title"), "\n").alias("top_titles"),
            F.array_join(F.col("_v.view_count"), " ").alias("top_video_views"),
        )
    )


def enrich_category(df: DataFrame, mapping: DataFrame, default: str = "未知") -> DataFrame:
    """``df``, usually the smaller side, with the category of each id."""
    names, rows = mapping.select("video_id", F.col("category").alias("_category")), df.drop("category")
    if fits_broadcast(rows):
        joined = names.join(F.broadcast(rows), "video_id", "right")
    else:
        joined = lookup_join(rows, names, ["video_id"])
    return joined.withColumn("category", F.coalesce("_category", F.lit(default))).drop("_category")


def popular(df: DataFrame, n: int = 20) -> DataFrame:
    """The most viewed rows over all."""
    return df.orderBy(F.col("view_count").desc(), F.col("video_id")).limit(n)
