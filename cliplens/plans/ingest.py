"""Registered queries: sources, sinks, cleaning, merging, task records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cliplens import schema as S
from cliplens.functions.title import cluster_label
from cliplens.operators import advice, clean, merge, reports, vectors
from cliplens.plans.inputs import (
    DECORATED_SQL, ENGAGEMENT, VIDEOS_SQL, decorate, table, videos, with_ctes,
)
from cliplens.session import materialize, scratch_path
from cliplens.sources import files

V = with_ctes(VIDEOS_SQL)
D = with_ctes(DECORATED_SQL)

FLAT = ["video_id", "title", "author", "author_id", "category", "view_count"]
FLAT_SCHEMA = T.StructType([
    T.StructField("video_id", T.LongType()), T.StructField("title", T.StringType()),
    T.StructField("author", T.StringType()), T.StructField("author_id", T.LongType()),
    T.StructField("category", T.StringType()), T.StructField("view_count", T.LongType()),
])


def src_json_array(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "array")
    items = videos(spark, sf, *FLAT).withColumn("tags", F.array("author", "category"))
    files.write_json_array(items, path, "video_id")
    full = T.StructType([*FLAT_SCHEMA.fields, T.StructField("tags", T.ArrayType(T.StringType()))])
    return files.read_json_array(spark, path, full).withColumn("tags", F.array_join("tags", ","))


def src_json_lines(spark, sf):
    path = scratch_path(spark, "lines")
    rows = videos(spark, sf, *FLAT)
    line = F.to_json(F.struct(*FLAT))
    rows.select(F.when(F.col("category") == "de", F.concat(F.lit("{broken "), "video_id"))
                .otherwise(line).alias("value")).write.text(path)
    return files.read_json_lines(spark, path, FLAT_SCHEMA).withColumnRenamed(
        "_corrupt_record", "corrupt")


def scan_videos(spark, sf):
    return videos(spark, sf)


def scan_videos_projected(spark, sf):
    return videos(spark, sf, "video_id", "title", "view_count", "like_count", "coin_count",
                  "favorite_count", "share_count", "category")


def csv_roundtrip(spark, sf):
    path = scratch_path(spark, "csv")
    rows = videos(spark, sf, "video_id", "title", "view_count", "cluster_id").withColumn(
        "cluster_label", cluster_label(F.coalesce("cluster_id", F.lit(-1))))
    files.write_csv(rows, path)
    return files.read_csv(spark, path, rows.schema)


def api_pages(spark, sf) -> DataFrame:
    """Videos packed into pages of 20 as the crawled service returns them."""
    v = videos(spark, sf, "video_id", "title", "author", "author_id", "publish_time",
               "category", "view_count", *ENGAGEMENT)
    tags = F.array(F.struct(F.col("author").alias("tag_name")), F.lit(None).cast("struct<tag_name:string>"),
                   F.struct(F.col("category").alias("tag_name")))
    item = F.struct(
        F.col("video_id").cast("string").alias("bvid"), "title", F.lit("").alias("desc"),
        F.struct(F.col("author").alias("name"), F.col("author_id").alias("mid")).alias("owner"),
        F.unix_timestamp("publish_time").alias("pubdate"),
        F.struct(F.col("view_count").alias("view"), F.col("like_count").alias("like"),
                 F.col("coin_count").alias("coin"), F.col("favorite_count").alias("favorite"),
                 F.col("share_count").alias("share"), F.col("comment_count").alias("reply")
                 ).alias("stat"),
        F.when(F.col("category") != "fr", F.struct(tags.alias("tags"))).alias("rcmd_reason"),
        F.col("category").alias("tname"),
    )
    keyed = v.select(F.floor(F.col("video_id") / 20).alias("page_no"), "video_id", "view_count",
                     item.alias("item"))
    packed = keyed.groupBy("page_no").agg(
        F.max("view_count").alias("top"),
        F.transform(F.array_sort(F.collect_list(F.struct("video_id", "item"))),
                    lambda e: e["item"]).alias("list"))
    failed = F.col("top") > 30_000_000
    body = F.to_json(F.struct(
        F.when(failed, -352).otherwise(0).alias("code"), F.lit("").alias("message"),
        F.struct("list").alias("data")))
    return packed.select("page_no", body.alias("body"))


def flatten_api_pages(spark, sf):
    return files.flatten_pages(api_pages(spark, sf)).withColumn(
        "tags", F.array_join("tags", ",")).withColumn("pos", F.col("pos").cast("bigint"))


def flatten_api_pages_capped(spark, sf):
    """A crawl that stops after half of the documents, and the pages it may ask for."""
    target = table(spark, sf, "documents").count() // 2
    items = files.flatten_pages(api_pages(spark, sf), target=target)
    return items.select("page_no", F.col("pos").cast("bigint").alias("pos"), "video_id",
                        F.lit(files.max_pages(target)).cast("bigint").alias("max_pages"))


def embedding_cache_misses(spark, sf):
    v = videos(spark, sf, "video_id", "title")
    known = table(spark, sf, "labels").select(F.col("doc_id").alias("video_id"), "toxic")
    cached = v.join(known, "video_id").select("video_id", F.when(
        F.col("toxic") == 1, F.md5(F.lit("stale"))).otherwise(F.md5("title")).alias("text_hash"))
    return vectors.cache_misses(v, cached)


def _vector_table(spark, sf):
    v = videos(spark, sf, "video_id", "title", "view_count", "category", "cluster_id")
    emb = table(spark, sf, "embeddings").select(F.col("vec_id").alias("video_id"), "embedding")
    path = scratch_path(spark, "vectors")
    files.full_refresh(vectors.vector_table(v, emb), path)
    return spark.read.parquet(path)


def vector_table(spark, sf):
    return _vector_table(spark, sf).select(
        "id", "document", F.size("embedding").cast("bigint").alias("dim"),
        "metadata.view_count", "metadata.category", "metadata.cluster_id")


def vector_table_count(spark, sf):
    return _vector_table(spark, sf).agg(F.count("*").alias("n"))


def full_refresh(spark, sf):
    path = scratch_path(spark, "refresh")
    files.full_refresh(videos(spark, sf, *FLAT), path)
    return spark.read.parquet(path)


def delta_videos(spark, sf) -> DataFrame:
    """Changed rows (those with a label) and new rows (crawled pages)."""
    v = videos(spark, sf, *FLAT)
    labelled = table(spark, sf, "labels").select(F.col("doc_id").alias("video_id"))
    changed = v.join(labelled, "video_id", "left_semi").withColumn(
        "view_count", F.col("view_count") + 1).withColumn("category", F.lit(None).cast("string"))
    new = table(spark, sf, "pages").select(
        (F.col("page_id") + 1_000_000_000).alias("video_id"), F.col("url").alias("title"),
        F.lit(None).cast("string").alias("author"), F.lit(None).cast("bigint").alias("author_id"),
        F.lit("page").alias("category"), F.length("html").cast("bigint").alias("view_count"))
    return changed.unionByName(new)


DELTA_SQL = """
delta AS (
  SELECT video_id, title, author, author_id, CAST(NULL AS VARCHAR) AS category,
         view_count + 1 AS view_count
  FROM videos WHERE video_id IN (SELECT doc_id FROM labels)
  UNION ALL
  SELECT page_id + 1000000000, url, NULL, NULL, 'page', CAST(length(html) AS BIGINT) FROM pages)
"""


def upsert_videos(spark, sf):
    return merge.upsert(videos(spark, sf, *FLAT), delta_videos(spark, sf))


def upsert_counts(spark, sf):
    return merge.upsert_counts(videos(spark, sf, "video_id"), delta_videos(spark, sf))


def insert_new_only(spark, sf):
    base = videos(spark, sf, *FLAT)
    return base.unionByName(merge.unseen(delta_videos(spark, sf), base))


def incremental_new_items(spark, sf):
    items = files.flatten_pages(api_pages(spark, sf)).select(
        F.col("video_id").cast("bigint").alias("video_id"), "title", "view_count")
    seen = table(spark, sf, "labels").select(F.col("doc_id").alias("video_id"))
    return merge.unseen(items, seen)


def eval_log(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("props").alias("input"), F.col("event_type").alias("tool_used"),
        F.concat(F.lit("用户 "), F.col("user_id").cast("string")).alias("output"),
        F.floor(F.col("value") * 100).alias("latency_ms"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("error"))


def eval_log_summary(spark, sf):
    path = scratch_path(spark, "evallog")
    log = eval_log(spark, sf)
    files.append_json_lines(log.where("error is null"), path)
    files.append_json_lines(log.where("error is not null"), path)
    return advice.eval_log_summary(spark.read.schema(S.EVAL_LOG).json(path))


def status_events(spark, sf) -> DataFrame:
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("task_id"), F.lit(0).cast("bigint").alias("event_id"),
        F.col("o_orderdate").cast("timestamp").alias("event_time"), F.lit("PENDING").alias("status"))
    flag = F.col("l_returnflag")
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").cast("bigint").alias("event_id"),
        F.col("l_shipdate").cast("timestamp").alias("event_time"),
        F.when(flag == "A", "SUCCESS").when(flag == "R", "FAILURE").otherwise("STARTED")
        .alias("status"))
    return orders.unionByName(lines)


STATUS_SQL = """
status_events AS (
  SELECT o_orderkey AS task_id, CAST(0 AS BIGINT) AS event_id,
         CAST(o_orderdate AS TIMESTAMP) AS event_time, 'PENDING' AS status FROM orders
  UNION ALL
  SELECT l_orderkey, CAST(l_linenumber AS BIGINT), CAST(l_shipdate AS TIMESTAMP),
         CASE l_returnflag WHEN 'A' THEN 'SUCCESS' WHEN 'R' THEN 'FAILURE' ELSE 'STARTED' END
  FROM lineitem),
latest AS (
  SELECT task_id, status, created_at,
         CASE WHEN status IN ('SUCCESS', 'FAILURE') THEN event_time END AS finished_at
  FROM (SELECT *, min(event_time) OVER (PARTITION BY task_id) AS created_at,
               row_number() OVER (PARTITION BY task_id
                 ORDER BY event_time DESC, event_id DESC, status DESC) AS rn
        FROM status_events) WHERE rn = 1)
"""


def task_latest_status(spark, sf):
    return advice.latest_status(status_events(spark, sf))


def task_status_resolve(spark, sf):
    records = advice.latest_status(status_events(spark, sf)).select("task_id", "status")
    state = F.col("o_orderstatus")
    queue = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("task_id"),
        F.when(state == "F", "SUCCESS").when(state == "O", "STARTED").otherwise("PENDING")
        .alias("status"))
    return advice.resolve_status(records, queue)


def raw_items(spark, sf) -> DataFrame:
    """Items as crawled, all text, with missing and malformed values and repeated ids."""
    v = videos(spark, sf, *FLAT, "like_count", "publish_time")
    kind = F.pmod(F.floor(F.col("view_count") / 1000), F.lit(7))
    text = {c: F.col(c).cast("string") for c in ["author_id", "like_count"]}
    return v.select(
        F.col("video_id").alias("seq"),
        F.when(kind == 0, None).when(kind == 5, F.col("video_id") - 1)
        .otherwise(F.col("video_id")).cast("string").alias("video_id"),
        F.when(kind == 1, "").otherwise(F.col("title")).alias("title"),
        F.lit(None).cast("string").alias("description"),
        F.when(kind == 2, None).otherwise(F.col("author")).alias("author"),
        F.when(kind == 6, "x").otherwise(text["author_id"]).alias("author_id"),
        F.unix_timestamp("publish_time").cast("string").alias("publish_time"),
        F.when(kind == 2, "0").when(kind == 3, "12.7").when(kind == 4, "abc")
        .otherwise(F.col("view_count").cast("string")).alias("view_count"),
        F.when(kind == 3, None).otherwise(text["like_count"]).alias("like_count"),
        *[F.lit("1").alias(c) for c in ["coin_count", "favorite_count", "share_count",
                                        "comment_count"]],
        F.when(kind == 4, "no list").otherwise(F.to_json(F.array("author", "category")))
        .alias("tags"),
        F.when(kind == 3, None).otherwise(F.col("category")).alias("category"),
    )


RAW_SQL = """
raw AS (
  SELECT video_id AS seq,
         CAST(CASE kind WHEN 0 THEN NULL WHEN 5 THEN video_id - 1 ELSE video_id END AS VARCHAR)
           AS video_id,
         CASE kind WHEN 1 THEN '' ELSE title END AS title,
         CASE kind WHEN 2 THEN NULL ELSE author END AS author,
         CASE kind WHEN 6 THEN 'x' ELSE CAST(author_id AS VARCHAR) END AS author_id,
         publish_time,
         CASE kind WHEN 2 THEN '0' WHEN 3 THEN '12.7' WHEN 4 THEN 'abc'
              ELSE CAST(view_count AS VARCHAR) END AS view_count,
         CASE kind WHEN 3 THEN NULL ELSE CAST(like_count AS VARCHAR) END AS like_count,
         CASE kind WHEN 4 THEN '' ELSE author || ',' || category END AS tags,
         CASE kind WHEN 3 THEN NULL ELSE category END AS category
  FROM (SELECT *, (view_count // 1000) % 7 AS kind FROM videos))
"""


def validate_items(spark, sf):
    return clean.validate_items(raw_items(spark, sf)).select(
        "seq", "video_id", "title", "view_count", "like_count", "reject_reason")


def dedup_first(spark, sf):
    valid = clean.validate_items(raw_items(spark, sf)).where("reject_reason is null")
    return clean.first_per_key(valid, ["video_id"], ["seq"]).select(
        "seq", "video_id", "title", "view_count")


def clean_videos(spark, sf):
    # Rows without an id count as one key, as the load step treats them.
    return clean.clean_items(raw_items(spark, sf), ["seq"]).select(
        "seq", "video_id", "title", "description", "author", "author_id", "publish_time",
        "view_count", "like_count", F.array_join("tags", ",").alias("tags"), "category")


def drop_null_target(spark, sf):
    v = videos(spark, sf, "video_id", "view_count", "like_count", "cluster_id")
    return v.na.drop(subset=["cluster_id"])


def lookup_by_id(spark, sf):
    ids = table(spark, sf, "labels").select(F.col("doc_id").alias("video_id"))
    return merge.get_by_ids(videos(spark, sf, *FLAT), ids)


def lookup_one(spark, sf):
    """The row of the largest id."""
    largest = table(spark, sf, "documents").agg(F.max("doc_id")).first()[0]
    return merge.get_by_id(videos(spark, sf, *FLAT), largest)


def distinct_categories(spark, sf):
    v = videos(spark, sf, "category")
    return v.distinct().where(F.col("category").isNotNull() & (F.col("category") != ""))


def min_rows_guard(spark, sf):
    """Clusters with at least 20 videos, for a table that has at least 20 rows itself."""
    v = videos(spark, sf, "video_id", "cluster_id")
    sizes = reports.cluster_sizes(v).where("n >= 20")
    return sizes if clean.has_rows(v) else sizes.limit(0)


def sample_n(spark, sf):
    return merge.sample_rows(videos(spark, sf, *FLAT), 20)


def train_test_split(spark, sf):
    return merge.split_train_test(videos(spark, sf, "video_id", "view_count"))


def validate_requests(spark, sf):
    d = decorate(videos(spark, sf, "video_id", "title", "category", "author_id", "publish_time"))
    body = F.to_json(F.struct(
        "title", F.when(F.col("category") != "de", F.col("category")).alias("category"),
        "author_id", F.unix_timestamp("publish_time").alias("publish_time")))
    return clean.validate_requests(d.select("video_id", body.alias("body")))


def enrich_category(spark, sf):
    """Categories looked up for labelled rows and for pages, which have none."""
    ids = delta_videos(spark, sf).select("video_id", "view_count", "category")
    return reports.enrich_category(ids, videos(spark, sf, "video_id", "category"))


def scan_limit(spark, sf):
    return videos(spark, sf, *FLAT).orderBy("video_id").limit(1000)


def row_count(spark, sf):
    return videos(spark, sf, "video_id").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in [
    src_json_array, src_json_lines, scan_videos, scan_videos_projected, csv_roundtrip,
    flatten_api_pages, flatten_api_pages_capped, upsert_counts, lookup_one,
    embedding_cache_misses, vector_table, vector_table_count, full_refresh,
    upsert_videos, insert_new_only, incremental_new_items, eval_log_summary, task_latest_status,
    task_status_resolve, validate_items, dedup_first, clean_videos, drop_null_target,
    lookup_by_id, distinct_categories, min_rows_guard, sample_n, train_test_split,
    validate_requests, enrich_category, scan_limit, row_count,
]}

_FLAT = ", ".join(FLAT)
_VALID_SQL = """
valid AS (
  SELECT seq, video_id, title,
         CASE WHEN regexp_full_match(view_count, '[+-]?[0-9]+') THEN CAST(view_count AS BIGINT)
              ELSE 0 END AS view_count,
         CASE WHEN regexp_full_match(like_count, '[+-]?[0-9]+') THEN CAST(like_count AS BIGINT)
              ELSE 0 END AS like_count,
         CASE WHEN video_id IS NULL OR video_id = '' THEN 'video_id'
              WHEN title IS NULL OR title = '' THEN 'title'
              WHEN view_count IS NULL OR view_count IN ('', '0') THEN 'view_count'
         END AS reject_reason
  FROM raw)
"""
_PAGES_SQL = """
paged AS (
  SELECT *, video_id // 20 AS page_no,
         max(view_count) OVER (PARTITION BY video_id // 20) AS top,
         row_number() OVER (PARTITION BY video_id // 20 ORDER BY video_id) - 1 AS pos
  FROM videos)
"""
_HASH = "CAST(('0x' || substr(md5(video_id || ':42'), 1, 7)) AS BIGINT)"

ORACLES = {
    "src_json_array": V + f"SELECT {_FLAT}, author || ',' || category AS tags FROM videos",
    "src_json_lines": V + """
      SELECT CASE WHEN ok THEN video_id END AS video_id, CASE WHEN ok THEN title END AS title,
             CASE WHEN ok THEN author END AS author, CASE WHEN ok THEN author_id END AS author_id,
             CASE WHEN ok THEN category END AS category,
             CASE WHEN ok THEN view_count END AS view_count,
             CASE WHEN NOT ok THEN '{broken ' || video_id END AS corrupt
      FROM (SELECT *, category <> 'de' AS ok FROM videos)""",
    "scan_videos": V + "SELECT * FROM videos",
    "scan_videos_projected": V + """SELECT video_id, title, view_count, like_count, coin_count,
      favorite_count, share_count, category FROM videos""",
    "csv_roundtrip": V + """SELECT video_id, title, view_count, cluster_id,
      coalesce('Cluster ' || cluster_id, 'Noise') AS cluster_label FROM videos""",
    "flatten_api_pages": with_ctes(VIDEOS_SQL + "," + _PAGES_SQL) + """
      SELECT page_no, CAST(pos AS BIGINT) AS pos, CAST(video_id AS VARCHAR) AS video_id, title,
             '' AS description, author, author_id,
             CAST(epoch(publish_time) AS BIGINT) AS publish_time, view_count, like_count,
             coin_count, favorite_count, share_count, comment_count,
             CASE WHEN category <> 'fr' THEN author || ',' || category ELSE '' END AS tags, category
      FROM paged WHERE top <= 30000000""",
    "flatten_api_pages_capped": with_ctes(VIDEOS_SQL + "," + _PAGES_SQL) + """,
      n AS (SELECT count(*) // 2 AS target FROM documents)
      SELECT page_no, CAST(pos AS BIGINT) AS pos, CAST(video_id AS VARCHAR) AS video_id,
             CAST(greatest(1, ceil(target / 20.0)) AS BIGINT) AS max_pages
      FROM (SELECT *, row_number() OVER (ORDER BY page_no, pos) AS rn FROM paged WHERE top <= 30000000), n
      WHERE rn <= target""",
    "upsert_counts": with_ctes(VIDEOS_SQL + "," + DELTA_SQL) + """
      SELECT count(*) FILTER (video_id NOT IN (SELECT doc_id FROM documents)) AS inserted,
             count(*) FILTER (video_id IN (SELECT doc_id FROM documents)) AS updated FROM delta""",
    "lookup_one": V + f"SELECT {_FLAT} FROM videos WHERE video_id = (SELECT max(doc_id) FROM documents)",
    "embedding_cache_misses": V + """
      SELECT video_id, md5(title) AS text_hash, title FROM videos
      WHERE video_id NOT IN (SELECT doc_id FROM labels WHERE toxic <> 1)""",
    "vector_table": V + """
      SELECT CAST(video_id AS VARCHAR) AS id, title AS document,
             CAST(len(e.embedding) AS BIGINT) AS dim, view_count, category,
             coalesce(cluster_id, -1) AS cluster_id
      FROM videos JOIN embeddings e ON e.vec_id = video_id""",
    "vector_table_count": V + """
      SELECT count(*) AS n FROM videos JOIN embeddings e ON e.vec_id = video_id""",
    "full_refresh": V + f"SELECT {_FLAT} FROM videos",
    "upsert_videos": with_ctes(VIDEOS_SQL + "," + DELTA_SQL) + f"""
      SELECT {_FLAT} FROM videos WHERE video_id NOT IN (SELECT video_id FROM delta)
      UNION ALL SELECT {_FLAT} FROM delta""",
    "insert_new_only": with_ctes(VIDEOS_SQL + "," + DELTA_SQL) + f"""
      SELECT {_FLAT} FROM videos UNION ALL
      SELECT {_FLAT} FROM delta WHERE video_id NOT IN (SELECT video_id FROM videos)""",
    "incremental_new_items": with_ctes(VIDEOS_SQL + "," + _PAGES_SQL) + """
      SELECT video_id, title, view_count FROM paged
      WHERE top <= 30000000 AND video_id NOT IN (SELECT doc_id FROM labels)""",
    "eval_log_summary": """
      SELECT event_type AS tool_used, count(*) AS calls,
             count(CASE WHEN event_type = 'error' THEN props END) AS errors,
             avg(ms) AS avg_latency, quantile_cont(ms, 0.5) AS p50_latency,
             quantile_cont(ms, 0.95) AS p95_latency
      FROM (SELECT *, floor(value * 100) AS ms FROM events) GROUP BY 1""",
    "task_latest_status": "WITH " + STATUS_SQL + "SELECT * FROM latest",
    "task_status_resolve": "WITH " + STATUS_SQL + """
      SELECT o_orderkey AS task_id,
             CASE WHEN l.status IN ('SUCCESS', 'FAILURE') THEN l.status
                  ELSE CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'STARTED'
                       ELSE 'PENDING' END END AS status
      FROM orders LEFT JOIN latest l ON l.task_id = o_orderkey""",
    "validate_items": with_ctes(VIDEOS_SQL + "," + RAW_SQL + "," + _VALID_SQL) +
        "SELECT * FROM valid",
    "dedup_first": with_ctes(VIDEOS_SQL + "," + RAW_SQL + "," + _VALID_SQL) + """
      SELECT seq, video_id, title, view_count
      FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY seq) AS rn
            FROM valid WHERE reject_reason IS NULL) WHERE rn = 1""",
    "clean_videos": with_ctes(VIDEOS_SQL + "," + RAW_SQL) + """
      SELECT seq, video_id, title, '' AS description, coalesce(author, 'Unknown') AS author,
             coalesce(CAST(trunc(TRY_CAST(author_id AS DOUBLE)) AS BIGINT), 0) AS author_id,
             publish_time,
             coalesce(CAST(trunc(TRY_CAST(view_count AS DOUBLE)) AS BIGINT), 0) AS view_count,
             coalesce(CAST(trunc(TRY_CAST(like_count AS DOUBLE)) AS BIGINT), 0) AS like_count,
             tags, coalesce(category, 'Uncategorized') AS category
      FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY seq) AS rn FROM raw)
      WHERE rn = 1""",
    "drop_null_target": V + """SELECT video_id, view_count, like_count, cluster_id FROM videos
      WHERE cluster_id IS NOT NULL""",
    "lookup_by_id": V + f"SELECT {_FLAT} FROM videos WHERE video_id IN (SELECT doc_id FROM labels)",
    "distinct_categories": V + """SELECT DISTINCT category FROM videos
      WHERE category IS NOT NULL AND category <> ''""",
    "min_rows_guard": V + """SELECT cluster_id, count(*) AS n FROM videos
      WHERE cluster_id IS NOT NULL AND (SELECT count(*) FROM videos) >= 20
      GROUP BY 1 HAVING count(*) >= 20""",
    "sample_n": V + f"SELECT {_FLAT} FROM videos ORDER BY md5(video_id || ':42'), video_id LIMIT 20",
    "train_test_split": V + f"SELECT video_id, view_count, {_HASH} % 1000 < 800 AS is_train FROM videos",
    "validate_requests": D + """
      SELECT video_id, title,
             CASE WHEN category <> 'de' THEN category ELSE '未知' END AS category, author_id,
             CAST(epoch(publish_time) AS BIGINT) AS publish_time,
             CASE WHEN title IS NULL THEN 'title: field required' END AS error FROM decorated""",
    "enrich_category": with_ctes(VIDEOS_SQL + "," + DELTA_SQL) + """
      SELECT d.video_id, d.view_count, coalesce(v.category, '未知') AS category
      FROM delta d LEFT JOIN videos v ON v.video_id = d.video_id""",
    "scan_limit": V + f"SELECT {_FLAT} FROM videos ORDER BY video_id LIMIT 1000",
    "row_count": V + "SELECT count(*) AS n FROM videos",
}
