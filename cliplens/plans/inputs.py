"""Views over the given tables that the registered queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENGAGEMENT = ["like_count", "coin_count", "favorite_count", "share_count", "comment_count"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def videos(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """One row per document; only the joins that the asked columns need are planned.

    The title is the whole text of the document.
    """
    wanted = list(columns) or [
        "video_id", "title", "author", "author_id", "category", "publish_time",
        "view_count", *ENGAGEMENT, "cluster_id",
    ]
    base = table(spark, sf, "documents").select(
        F.col("doc_id").alias("video_id"),
        F.col("text").alias("title"),
        F.col("source").alias("author"),
        F.substring(F.col("source"), F.lit(4), F.lit(18)).cast("bigint").alias("author_id"),
        F.col("lang").alias("category"),
        (F.col("n_chars") * 1000).cast("bigint").alias("view_count"),
    )
    if "publish_time" in wanted:
        orders = table(spark, sf, "orders").select(
            F.col("o_orderkey").alias("video_id"),
            F.col("o_orderdate").cast("timestamp").alias("publish_time"),
        )
        base = base.join(orders, "video_id", "left")
    if set(wanted) & set(ENGAGEMENT):
        lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("video_id")).agg(
            F.sum("l_quantity").cast("bigint").alias("like_count"),
            F.count("*").alias("coin_count"),
            F.countDistinct("l_partkey").alias("favorite_count"),
            F.max("l_linenumber").cast("bigint").alias("share_count"),
            F.max("l_quantity").cast("bigint").alias("comment_count"),
        )
        base = base.join(lines, "video_id", "left").fillna(0, ENGAGEMENT)
    if "cluster_id" in wanted:
        labels = table(spark, sf, "embeddings").select(
            F.col("vec_id").alias("video_id"), F.col("label").cast("bigint").alias("cluster_id")
        )
        base = base.join(labels, "video_id", "left")
    return base.select(*wanted)


def publish_times(spark: SparkSession, sf: str) -> DataFrame:
    """(video_id, publish_time) of the documents that have one; no text is read."""
    ids = table(spark, sf, "documents").select(F.col("doc_id").alias("video_id"))
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("video_id"),
        F.col("o_orderdate").cast("timestamp").alias("publish_time"),
    ).join(ids, "video_id", "left_semi")


VIDEOS_SQL = """
videos AS (
  SELECT d.doc_id AS video_id, d.text AS title, d.source AS author,
         CAST(substr(d.source, 4) AS BIGINT) AS author_id, d.lang AS category,
         CAST(o.o_orderdate AS TIMESTAMP) AS publish_time,
         CAST(d.n_chars * 1000 AS BIGINT) AS view_count,
         coalesce(l.like_count, 0) AS like_count, coalesce(l.coin_count, 0) AS coin_count,
         coalesce(l.favorite_count, 0) AS favorite_count,
         coalesce(l.share_count, 0) AS share_count,
         coalesce(l.comment_count, 0) AS comment_count,
         CAST(e.label AS BIGINT) AS cluster_id
  FROM documents d
  LEFT JOIN orders o ON o.o_orderkey = d.doc_id
  LEFT JOIN (SELECT l_orderkey,
                    CAST(sum(l_quantity) AS BIGINT) AS like_count,
                    CAST(count(*) AS BIGINT) AS coin_count,
                    CAST(count(DISTINCT l_partkey) AS BIGINT) AS favorite_count,
                    CAST(max(l_linenumber) AS BIGINT) AS share_count,
                    CAST(max(l_quantity) AS BIGINT) AS comment_count
             FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = d.doc_id
  LEFT JOIN embeddings e ON e.vec_id = d.doc_id)
"""


def decorate(df: DataFrame) -> DataFrame:
    """Put question marks, brackets, lexicon words and a NULL into the titles."""
    t, pick = F.col("title"), F.col("video_id") % 10
    cases = [
        F.concat(F.lit("【"), t, F.lit("】3天教程？")),
        F.concat(t, F.lit("！震惊！居然竟然 100%")),
        F.concat(F.lit("盘点 TOP10："), t),
        F.concat(F.lit("测评 ("), t, F.lit(") ??")),
        F.concat(F.lit("全网火爆 "), t, F.lit(" 😀 ٣")),
        F.lit("短"),
        F.lit(None).cast("string"),
    ]
    title = F.when(pick == 0, cases[0])
    for i, value in enumerate(cases[1:], start=1):
        title = title.when(pick == i, value)
    return df.withColumn("title", title.otherwise(t))


DECORATED_SQL = VIDEOS_SQL + """,
decorated AS (
  SELECT * REPLACE (CASE video_id % 10
    WHEN 0 THEN concat('【', title, '】3天教程？')
    WHEN 1 THEN concat(title, '！震惊！居然竟然 100%')
    WHEN 2 THEN concat('盘点 TOP10：', title)
    WHEN 3 THEN concat('测评 (', title, ') ??')
    WHEN 4 THEN concat('全网火爆 ', title, ' 😀 ٣')
    WHEN 5 THEN '短'
    WHEN 6 THEN NULL
    ELSE title END AS title) FROM videos)
"""


def with_ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n"
