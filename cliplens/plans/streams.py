"""Registered queries: incremental jobs over the event and video tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cliplens.plans.ingest import DELTA_SQL, FLAT, delta_videos
from cliplens.plans.inputs import VIDEOS_SQL, table, videos, with_ctes
from cliplens.session import scratch_path
from cliplens.streaming import jobs
from cliplens.streaming.takeback import TakeBackTotals

V = with_ctes(VIDEOS_SQL)


def _landed_events(spark, sf):
    """All events landed twice in part: clicks and errors arrive again in a second drop."""
    path = scratch_path(spark, "landed")
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(path)
    e.where(F.col("event_type").isin("click", "error")).write.mode("append").parquet(path)
    return jobs.read_stream(spark, path, e.schema)


def stream_dedup(spark, sf):
    """The delay is longer than the span of the data, so no first arrival is late."""
    out = scratch_path(spark, "dedup")
    stream = jobs.dedup_stream(_landed_events(spark, sf), ["event_id"], "ts", "60 days")
    jobs.run_append(stream, out, scratch_path(spark, "ck"), "parquet")
    return spark.read.parquet(out)


def stream_append(spark, sf):
    out = scratch_path(spark, "append")
    stream = _landed_events(spark, sf)
    jobs.run_append(stream, out, scratch_path(spark, "ck"))
    return spark.read.schema(stream.schema).options(**jobs.TIMESTAMPS).json(out)


def stream_upsert(spark, sf):
    """Changes arrive in several batches and the newest version of a row wins.

    The job is stopped and opened again between the drops, the table is
    compacted once, and the last drop brings old versions late.
    """
    landed, table_path, checkpoint = (scratch_path(spark, n) for n in ("videos", "upserts", "ck"))
    first = videos(spark, sf, *FLAT).withColumn("version", F.lit(0).cast("bigint"))
    delta = delta_videos(spark, sf).withColumn("version", F.lit(2).cast("bigint"))
    late = delta.withColumn("version", F.lit(1).cast("bigint")).withColumn("title", F.lit("old"))
    for drop, rows in enumerate([first, delta, late]):
        rows.write.mode("append").parquet(landed)
        store = jobs.VersionedTable(spark, table_path, "video_id", "version")
        jobs.run_batches(jobs.read_stream(spark, landed, first.schema, max_files=2),
                         store.write_batch, checkpoint)
        if drop == 1:
            store.compact()
    return jobs.VersionedTable(spark, table_path, "video_id", "version").read().drop("version")


def stream_refresh(spark, sf):
    """Topic totals kept up batch by batch."""
    path = scratch_path(spark, "videos")
    rows = videos(spark, sf, "video_id", "cluster_id", "view_count").where("cluster_id is not null")
    rows.write.parquet(path)
    totals = jobs.RunningTotals(spark, scratch_path(spark, "totals"), "cluster_id", "view_count")
    jobs.run_batches(jobs.read_stream(spark, path, rows.schema, max_files=1), totals.write_batch,
                     scratch_path(spark, "ck"))
    t = totals.read()
    return t.select("cluster_id", F.col("n").alias("total_videos"),
                    F.col("total").alias("total_views"),
                    (F.col("total") / F.col("n")).alias("average_views"))


def stream_take_back(spark, sf):
    """Topic totals under updates, moves and deletes.

    All items come first; then the labelled ones again, moved to the next topic
    with one more view, the toxic ones deleted; at last old versions of them,
    late. The job is opened again for each drop.
    """
    landed, table_path, checkpoint = (scratch_path(spark, n) for n in ("items", "take-back", "ck"))
    first = videos(spark, sf, "video_id", "cluster_id", "view_count").select(
        "*", F.lit(0).cast("bigint").alias("version"), F.lit(False).alias("deleted"))
    toxic = table(spark, sf, "labels").groupBy(F.col("doc_id").alias("video_id")).agg(
        F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    changed = first.join(toxic, "video_id").select(
        "video_id", (F.col("cluster_id") + 1).alias("cluster_id"),
        (F.col("view_count") + 1).alias("view_count"), F.lit(2).cast("bigint").alias("version"),
        (F.col("toxic") == 1).alias("deleted"))
    late = changed.withColumn("version", F.lit(1).cast("bigint")).withColumn("deleted", F.lit(False))
    for rows in (first, changed, late):
        rows.write.mode("append").parquet(landed)
        totals = TakeBackTotals(spark, table_path, "video_id", "version", "cluster_id", "view_count")
        jobs.run_batches(jobs.read_stream(spark, landed, first.schema), totals.write_batch, checkpoint)
        totals.vacuum()
    return totals.totals().select(
        "cluster_id", F.col("n").alias("total_videos"), F.col("total").alias("total_views"))


QUERIES = {f.__name__: f for f in [
    stream_dedup, stream_append, stream_upsert, stream_refresh, stream_take_back]}

_FLAT = ", ".join(FLAT)
ORACLES = {
    "stream_dedup": "SELECT event_id, ts, user_id, event_type, value, props FROM events",
    "stream_append": """SELECT event_id, ts, user_id, event_type, value, props FROM events
      UNION ALL SELECT event_id, ts, user_id, event_type, value, props FROM events
      WHERE event_type IN ('click', 'error')""",
    "stream_upsert": with_ctes(VIDEOS_SQL + "," + DELTA_SQL) + f"""
      SELECT {_FLAT} FROM videos WHERE video_id NOT IN (SELECT video_id FROM delta)
      UNION ALL SELECT {_FLAT} FROM delta""",
    "stream_refresh": V + """
      SELECT cluster_id, count(*) AS total_videos, CAST(sum(view_count) AS BIGINT) AS total_views,
             avg(view_count) AS average_views FROM videos WHERE cluster_id IS NOT NULL GROUP BY 1""",
    "stream_take_back": V + """
      , marked AS (SELECT doc_id, max(coalesce(toxic, 0)) AS toxic FROM labels GROUP BY 1)
      SELECT CASE WHEN m.doc_id IS NULL THEN cluster_id ELSE cluster_id + 1 END AS cluster_id,
             count(*) AS total_videos,
             CAST(sum(view_count + CASE WHEN m.doc_id IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS total_views
      FROM videos v LEFT JOIN marked m ON m.doc_id = v.video_id
      WHERE coalesce(m.toxic, 0) <> 1 GROUP BY 1""",
}
