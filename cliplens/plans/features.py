"""Registered queries: title, time and author features, profiles, reports, advice."""

from __future__ import annotations

from pyspark.sql import functions as F

from cliplens.functions import numbers as N
from cliplens.functions import title as TT
from cliplens.operators import advice, authors, models, profile, reports
from cliplens.plans.inputs import (
    DECORATED_SQL, ENGAGEMENT, VIDEOS_SQL, decorate, table, videos, with_ctes,
)
from cliplens.session import materialize

V = with_ctes(VIDEOS_SQL)
D = with_ctes(DECORATED_SQL)
METRICS = ["view_count", "like_count", "comment_count", "favorite_count"]


def title_features(spark, sf):
    d = decorate(videos(spark, sf, "video_id", "title"))
    return d.withColumns(TT.title_features(F.col("title"))).drop("title")


def _t(expr: str) -> str:
    return expr.replace("?T", "coalesce(title, '')")


def _any(words) -> str:
    return "CAST(" + " OR ".join(_t(f"contains(?T, '{w}')") for w in words) + " AS BIGINT)"


def _count(word: str) -> str:
    return _t(f"((length(?T) - length(replace(?T, '{word}', ''))) // {len(word)})")


TITLE_SQL = ",\n".join([
    _t("length(?T) AS title_len"),
    _t(r"len(regexp_extract_all(?T, '\p{Nd}')) AS digit_cnt"),
    f"{_count('?')} + {_count('？')} AS question_cnt",
    f"{_count('!')} + {_count('！')} AS exclam_cnt",
    f"{_any(TT.BRACKETS)} AS has_brackets",
    f"{_any('%')} AS has_percent",
    f"{_any(':：')} AS has_colon",
    f"{_any(TT.TUTORIAL_WORDS)} AS has_tutorial",
    f"{_any(TT.REVIEW_WORDS)} AS has_review",
    f"{_any(TT.LIST_WORDS)} AS has_list",
    f"{_any(TT.HOT_WORDS)} AS has_hot",
    " + ".join(_count(w) for w in TT.EMOTION_WORDS) + " AS emotion_cnt",
    " + ".join(f"CAST({_count(w)} > 0 AS BIGINT)" for w in TT.EMOTION_WORDS) + " AS emotion_hit_cnt",
])


def timed(spark, sf):
    """Publish times, a third of them missing in number form or broken in text form."""
    v = videos(spark, sf, "video_id", "publish_time", "view_count")
    kind = F.pmod(F.floor(F.col("view_count") / 1000), F.lit(3))
    epoch = F.unix_timestamp("publish_time").cast("double") + 0.5
    text = F.date_format("publish_time", "yyyy-MM-dd HH:mm:ss")
    return v.select(
        "video_id",
        F.when(kind == 0, None).when(kind == 1, F.lit("NaN").cast("double")).otherwise(epoch)
        .alias("epoch"),
        F.when(kind == 0, "invalid").when(kind == 1, None).otherwise(text).alias("text"))


def publish_time_features(spark, sf):
    rows = timed(spark, sf)
    number, text = TT.publish_time_of_epoch(F.col("epoch")), TT.publish_time_of_text(F.col("text"))
    of_text = {f"text_{k}": c for k, c in TT.time_features(text).items()}
    return rows.select("video_id", number.alias("dt"), text.alias("text_dt")).withColumns({
        **TT.time_features(F.col("dt")),
        **{f"text_{k}": c for k, c in TT.time_features(F.col("text_dt")).items()}})


TIMED_SQL = """
timed AS (
  SELECT video_id, CASE WHEN (view_count // 1000) % 3 = 2 THEN publish_time END AS dt FROM videos)
"""


def author_stats(spark, sf):
    return authors.author_stats(videos(spark, sf, "author_id", "view_count"))


def author_defaults(spark, sf):
    return authors.author_defaults(materialize(author_stats(spark, sf), "authors"))


def asking(spark, sf):
    """Requests: labelled rows with their author, crawled pages with unknown or bad ids."""
    v = videos(spark, sf, "video_id", "author_id")
    known = v.join(table(spark, sf, "labels").select(F.col("doc_id").alias("video_id")),
                   "video_id", "left_semi")
    pages = table(spark, sf, "pages").select(
        (F.col("page_id") + 1_000_000_000).alias("video_id"),
        F.when(F.length("html") > 2000, F.lit("none")).otherwise(
            F.concat(F.lit("9999"), F.col("page_id").cast("string"))).alias("author_id"))
    return known.withColumn("author_id", F.col("author_id").cast("string")).unionByName(pages)


def author_features(spark, sf):
    stats = materialize(author_stats(spark, sf), "authors")
    return authors.add_author_features(asking(spark, sf), stats, authors.author_defaults(stats))


STATS_SQL = """
stats AS (
  SELECT author_id, avg(view_count) AS author_mean_view, median(view_count) AS author_median_view,
         count(view_count) AS author_video_count
  FROM videos WHERE author_id IS NOT NULL GROUP BY author_id),
defaults AS (
  SELECT coalesce(avg(author_mean_view), 0) AS author_mean_view,
         coalesce(median(author_median_view), 0) AS author_median_view,
         coalesce(avg(author_video_count), 0) AS author_video_count FROM stats)
"""


def view_buckets(spark, sf):
    bucket = TT.view_bucket(F.col("view_count"))
    return videos(spark, sf, "video_id", "view_count").select(
        "video_id", bucket.alias("bucket_id"), TT.bucket_name(bucket).alias("bucket_name"))


def log_metrics(spark, sf):
    v = videos(spark, sf, "video_id", *METRICS)
    return v.select("video_id", *[N.rounded(F.log1p(m)).alias(f"log_{m}") for m in METRICS])


def cluster_labels(spark, sf):
    v = videos(spark, sf, "video_id", "cluster_id").fillna(-1, ["cluster_id"])
    return v.withColumn("cluster_label", TT.cluster_label(F.col("cluster_id")))


def model_features(spark, sf):
    v = decorate(videos(spark, sf, "video_id", "title", "category", "author_id",
                        "publish_time", "view_count"))
    stats = materialize(authors.author_stats(v), "authors")
    rows = models.model_features(v, stats, authors.author_defaults(stats))
    return rows.select("video_id", "category",
                       *[N.rounded(F.col(c), 4).alias(c) for c in TT.NUMERIC_FEATURES])


def table_profile(spark, sf):
    v = videos(spark, sf)
    return profile.table_profile(v).select("column_name", "non_null", "nulls")


NUMERIC = ["video_id", "author_id", "view_count", *ENGAGEMENT, "cluster_id"]


def describe_metrics(spark, sf):
    """All numeric columns of the videos."""
    d = profile.describe(videos(spark, sf, *NUMERIC), NUMERIC)
    return d.select("metric", "n", *[N.rounded(F.col(c), 4).alias(c) for c in
                                     ["mean", "std", "min", "p25", "p50", "p75", "max"]])


def metric_correlation(spark, sf):
    c = profile.correlations(videos(spark, sf, *METRICS), METRICS)
    return c.select("metric_a", "metric_b", N.rounded(F.col("r")).alias("r"))


def _with_logs(spark, sf):
    v = videos(spark, sf, *METRICS)
    return v.withColumns({f"log_{m}": F.log1p(m) for m in METRICS})


def metric_histogram(spark, sf):
    h = profile.histogram(_with_logs(spark, sf), METRICS + [f"log_{m}" for m in METRICS])
    return h.select("metric", "bin", N.rounded(F.col("bin_start")).alias("bin_start"), "n")


def metric_kde(spark, sf):
    k = profile.kde(_with_logs(spark, sf), METRICS + [f"log_{m}" for m in METRICS])
    return k.select("metric", "point", N.rounded(F.col("x")).alias("x"),
                    N.rounded(F.col("density"), 9).alias("density"))


CELLS_SQL = "cells AS (" + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM videos" for m in METRICS) + ")"
LOG_CELLS_SQL = CELLS_SQL[:-1] + " UNION ALL " + " UNION ALL ".join(
    f"SELECT 'log_{m}' AS metric, ln(1.0::DOUBLE + {m}) AS value FROM videos" for m in METRICS) + ")"


def cluster_sizes(spark, sf):
    return reports.cluster_sizes(videos(spark, sf, "cluster_id"))


def cluster_summary(spark, sf):
    """Label 0 plays the part of noise."""
    v = videos(spark, sf, "cluster_id").withColumn(
        "cluster_id", F.when(F.col("cluster_id") == 0, -1).otherwise(F.col("cluster_id")))
    return reports.cluster_summary(v, "cluster_id").withColumn(
        "noise_ratio", N.rounded(F.col("noise_ratio")))


def topic_stats(spark, sf):
    return reports.topic_stats(videos(spark, sf, "cluster_id", "view_count"))


def topic_top_videos(spark, sf):
    return reports.top_videos(videos(spark, sf, "video_id", "cluster_id", "view_count"))


def category_stats(spark, sf):
    return reports.category_stats(videos(spark, sf, "category", "view_count"))


def explain_rules(spark, sf):
    d = decorate(videos(spark, sf, "video_id", "title"))
    f = TT.title_features(F.col("title"))
    rules = TT.explanations(f["title_len"], f["question_cnt"], f["has_brackets"])
    return d.select("video_id", F.posexplode(rules).alias("pos", "e")).select(
        "video_id", (F.col("pos") + 1).cast("bigint").alias("rule_no"), "e.feature", "e.effect",
        "e.reason")


def replies(spark, sf):
    """Model replies about each title: fenced JSON, bare JSON, missing keys, plain text."""
    v = videos(spark, sf, "video_id", "title", "author", "category")
    full = F.to_json(F.struct(
        F.concat(F.lit("about "), "title").alias("diagnosis"),
        F.array("title", "author").alias("suggestions")))
    bare = F.to_json(F.struct(F.col("title").alias("diagnosis")))
    kind = F.col("category")
    reply = (F.when(kind == "en", F.concat(F.lit("```json\n"), full, F.lit("\n```\n")))
             .when(kind == "fr", bare).when(kind == "de", full)
             .otherwise(F.concat(F.lit("plain: "), "title", F.lit(" \n"))))
    return v.select("video_id", "title", reply.alias("reply"))


REPLY_SQL = r"""
parsed AS (
  SELECT video_id, title,
         CASE category WHEN 'en' THEN 'about ' || title WHEN 'fr' THEN title
              WHEN 'de' THEN 'about ' || title
              ELSE 'plain: ' || regexp_replace(title, '\s+$', '') END AS diagnosis,
         CASE WHEN category IN ('en', 'de') THEN [title, author]
              ELSE CAST([] AS VARCHAR[]) END AS suggestions
  FROM videos)
"""


def parse_reply(spark, sf):
    rows = replies(spark, sf)
    return rows.withColumns(advice.parse_reply(F.col("reply"))).select(
        "video_id", "diagnosis", F.size("suggestions").cast("bigint").alias("n_suggestions"),
        F.array_join("suggestions", "|").alias("suggestions"))


def title_advice_rules(spark, sf):
    rows = decorate(replies(spark, sf))
    parsed = rows.withColumns(advice.parse_reply(F.col("reply")))
    record = advice.advice_record(
        F.col("title"), {"suggestions": F.col("suggestions"), "diagnosis": F.col("diagnosis")},
        F.size("suggestions"))
    return parsed.select(
        "video_id", F.array_join(record["advice_list"], "|").alias("advice_list"),
        record["diagnosis"].alias("diagnosis"), record["summary"].alias("summary"))


def judge_score_avg(spark, sf):
    """Judge replies: quality from the labels; some without a score, some broken."""
    rows = table(spark, sf, "labels").join(
        table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    good = F.to_json(F.struct((F.col("quality") + 4).alias("score"), F.col("lang").alias("reason")))
    reply = (F.when(F.col("toxic") == 1, F.lit("score: 5")).when(
        F.col("lang") == "de", F.to_json(F.struct(F.col("lang").alias("reason"))))
        .otherwise(F.concat(F.lit("```json"), good, F.lit("```"))))
    judged = rows.withColumn("reply", reply).withColumns(advice.parse_judgement(F.col("reply")))
    return judged.groupBy("reason").agg(
        F.count("*").alias("n"), N.rounded(F.avg("score")).alias("avg_score"))


def last_k_turns(spark, sf):
    return advice.last_exchanges(table(spark, sf, "conversations"))


def intent_rules(spark, sf):
    """Intents of all turns; greetings and thanks are put in by turn number."""
    said = (F.when(F.col("turn") == 0, F.concat(F.lit("你好，谢谢 "), "text"))
            .when(F.col("turn") == 1, F.concat("text", F.lit(" 多谢")))
            .otherwise(F.col("text")))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", TT.intent(said).alias("intent"))


def last_step_tool(spark, sf):
    """Tool of the last agent step per user; users without a step have none."""
    e = table(spark, sf, "events")
    last = e.where(F.col("event_type") != "error").groupBy("user_id").agg(
        F.max(F.struct("ts", "event_id", F.col("event_type").alias("tool"))).alias("step"))
    users = e.select("user_id").distinct()
    steps = F.when(F.col("step").isNull(), F.array().cast(
        "array<struct<ts:timestamp_ntz,event_id:bigint,tool:string>>")).otherwise(F.array("step"))
    return users.join(last, "user_id", "left").select(
        "user_id", advice.last_tool(steps).alias("tool"))


def prompt_context(spark, sf):
    v = videos(spark, sf, "video_id", "title", "category", "view_count")
    d = decorate(v).withColumn("title", F.coalesce("title", F.lit("")))
    f = TT.title_features(F.col("title"))
    rules = TT.explanations(f["title_len"], f["question_cnt"], f["has_brackets"])
    similar = F.array(*[F.struct(F.col(c).alias("title"), "view_count")
                        for c in ["category", "title", "category", "title"]])
    return d.select(
        "video_id",
        advice.prompt_context(F.col("title"), F.col("category"), F.col("view_count"), rules,
                              similar).alias("context"),
        advice.prediction_text(F.col("view_count"), TT.bucket_name(
            TT.view_bucket(F.col("view_count"))), rules).alias("answer"))


QUERIES = {f.__name__: f for f in [
    title_features, publish_time_features, author_stats, author_defaults, author_features,
    view_buckets, log_metrics, cluster_labels, model_features, table_profile, describe_metrics,
    metric_correlation, metric_histogram, metric_kde, cluster_sizes, cluster_summary,
    topic_stats, topic_top_videos, category_stats, explain_rules, parse_reply,
    title_advice_rules, judge_score_avg, last_k_turns, intent_rules, last_step_tool,
    prompt_context,
]}

_BUCKET = """CASE WHEN view_count < 100000 THEN 0 WHEN view_count < 500000 THEN 1
  WHEN view_count < 2000000 THEN 2 ELSE 3 END"""
_BUCKET_NAME = """CASE WHEN view_count < 100000 THEN '0-10万' WHEN view_count < 500000 THEN '10-50万'
  WHEN view_count < 2000000 THEN '50-200万' ELSE '200万+' END"""
_RULES_SQL = """
feat AS (
  SELECT *, length(coalesce(title, '')) AS title_len,
         coalesce(contains(title, '?') OR contains(title, '？'), false) AS asks,
         """ + _any(TT.BRACKETS) + """ AS has_brackets FROM decorated),
rules AS (
  SELECT video_id, 0 AS o, '标题长度' AS feature,
         CASE WHEN title_len < 5 THEN '负向' WHEN title_len > 20 THEN '正向' ELSE '中性' END AS effect,
         CASE WHEN title_len < 5 THEN '标题过短，信息量不足'
              WHEN title_len > 20 THEN '标题包含丰富信息' ELSE '标题长度适中' END AS reason FROM feat
  UNION ALL
  SELECT video_id, 1, '疑问句式', '正向', '疑问句引发好奇心' FROM feat WHERE asks
  UNION ALL
  SELECT video_id, 2, '强调符号', '正向', '使用了【】等符号突出重点' FROM feat WHERE has_brackets = 1)
"""
_NUM = ", ".join(f"round(CAST({c} AS DOUBLE), 4) + 0.0 AS {c}" for c in TT.NUMERIC_FEATURES)

ORACLES = {
    "title_features": D + f"SELECT video_id, {TITLE_SQL} FROM decorated",
    "publish_time_features": with_ctes(VIDEOS_SQL + "," + TIMED_SQL) + """
      SELECT video_id, dt, dt AS text_dt, coalesce(hour(dt), -1) AS hour,
             coalesce(isodow(dt) - 1, -1) AS dow, coalesce(hour(dt), -1) AS text_hour,
             coalesce(isodow(dt) - 1, -1) AS text_dow FROM timed""",
    "author_stats": with_ctes(VIDEOS_SQL + "," + STATS_SQL) + "SELECT * FROM stats",
    "author_defaults": with_ctes(VIDEOS_SQL + "," + STATS_SQL) + "SELECT * FROM defaults",
    "author_features": with_ctes(VIDEOS_SQL + "," + STATS_SQL) + """,
      asking AS (
        SELECT video_id, CAST(author_id AS VARCHAR) AS author_id FROM videos
        WHERE video_id IN (SELECT doc_id FROM labels)
        UNION ALL
        SELECT page_id + 1000000000, CASE WHEN length(html) > 2000 THEN 'none'
               ELSE '9999' || page_id END FROM pages)
      SELECT a.video_id, a.author_id,
             coalesce(s.author_mean_view, d.author_mean_view) AS author_mean_view,
             coalesce(s.author_median_view, d.author_median_view) AS author_median_view,
             coalesce(CAST(s.author_video_count AS DOUBLE), d.author_video_count)
               AS author_video_count
      FROM asking a LEFT JOIN stats s ON s.author_id = TRY_CAST(a.author_id AS BIGINT),
           defaults d""",
    "view_buckets": V + f"""SELECT video_id, CAST({_BUCKET} AS BIGINT) AS bucket_id,
      {_BUCKET_NAME} AS bucket_name FROM videos""",
    "log_metrics": V + "SELECT video_id, " + ", ".join(
        f"round(ln(1.0::DOUBLE + {m}), 6) + 0.0 AS log_{m}" for m in METRICS) + " FROM videos",
    "cluster_labels": V + """SELECT video_id, coalesce(cluster_id, -1) AS cluster_id,
      coalesce('Cluster ' || cluster_id, 'Noise') AS cluster_label FROM videos""",
    "model_features": with_ctes(DECORATED_SQL + "," + STATS_SQL) + f""",
      feats AS (SELECT video_id, category, author_id, coalesce(hour(publish_time), -1) AS hour,
                coalesce(isodow(publish_time) - 1, -1) AS dow, {TITLE_SQL} FROM decorated)
      SELECT video_id, category, {_NUM}
      FROM (SELECT f.*, coalesce(s.author_mean_view, d.author_mean_view) AS author_mean_view,
                   coalesce(s.author_median_view, d.author_median_view) AS author_median_view,
                   coalesce(s.author_video_count, d.author_video_count) AS author_video_count
            FROM feats f LEFT JOIN stats s USING (author_id), defaults d)""",
    "table_profile": V + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) AS non_null, count(*) - count({c}) AS nulls "
        "FROM videos" for c in
        ["video_id", "title", "author", "author_id", "category", "publish_time", "view_count",
         "like_count", "coin_count", "favorite_count", "share_count", "comment_count",
         "cluster_id"]),
    "describe_metrics": with_ctes(VIDEOS_SQL + ", cells AS (" + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM videos" for m in NUMERIC) + ")") + """
      SELECT metric, count(value) AS n, round(avg(value), 4) AS mean,
             round(stddev_samp(value), 4) AS std, round(min(value), 4) AS min,
             round(quantile_cont(value, 0.25), 4) AS p25, round(median(value), 4) AS p50,
             round(quantile_cont(value, 0.75), 4) AS p75, round(max(value), 4) AS max
      FROM cells GROUP BY metric""",
    "metric_correlation": V + " UNION ALL ".join(
        f"SELECT '{a}' AS metric_a, '{b}' AS metric_b, round(corr({a}, {b}), 6) + 0.0 AS r FROM videos"
        for a in METRICS for b in METRICS),
    "metric_histogram": with_ctes(VIDEOS_SQL + "," + LOG_CELLS_SQL) + """,
      bounds AS (SELECT metric, min(value) AS lo, max(value) AS hi FROM cells GROUP BY metric),
      placed AS (SELECT metric, CASE WHEN hi = lo THEN 1
                   ELSE least(20, CAST(floor((value - lo) / (hi - lo) * 20) AS BIGINT) + 1) END AS bin
                 FROM cells JOIN bounds USING (metric)),
      filled AS (SELECT metric, bin, count(*) AS n FROM placed GROUP BY 1, 2)
      SELECT metric, bin, round(lo + (hi - lo) * (bin - 1) / 20, 6) + 0.0 AS bin_start,
             coalesce(n, 0) AS n
      FROM (SELECT *, unnest(range(1, 21)) AS bin FROM bounds) LEFT JOIN filled USING (metric, bin)""",
    "metric_kde": with_ctes(VIDEOS_SQL + "," + LOG_CELLS_SQL) + """,
      st AS (SELECT metric, count(*) AS n, min(value) AS lo, max(value) AS hi,
                    pow(count(*), -0.2) * stddev_samp(value) AS h FROM cells GROUP BY metric),
      grid AS (SELECT *, lo + (hi - lo) * point / 63 AS x
               FROM (SELECT *, unnest(range(0, 64)) AS point FROM st))
      SELECT metric, point, round(x, 6) + 0.0 AS x,
             round(sum(exp(-0.5 * ((x - value) / h) * ((x - value) / h)))
                   / (any_value(n) * any_value(h) * sqrt(2.0 * pi())), 9) + 0.0 AS density
      FROM grid JOIN cells USING (metric) GROUP BY metric, point, x""",
    "cluster_sizes": V + """SELECT cluster_id, count(*) AS n FROM videos
      WHERE cluster_id IS NOT NULL GROUP BY 1""",
    "cluster_summary": V + """
      SELECT count(*) AS total_videos, count(DISTINCT CASE WHEN cluster_id <> 0 THEN cluster_id END)
               AS n_clusters,
             count(CASE WHEN cluster_id = 0 THEN 1 END) AS n_noise,
             round(count(CASE WHEN cluster_id = 0 THEN 1 END) / count(*), 6) AS noise_ratio
      FROM videos""",
    "topic_stats": V + """
      SELECT *, row_number() OVER (ORDER BY total_views DESC, cluster_id) AS topic_rank
      FROM (SELECT cluster_id, count(*) AS total_videos, CAST(sum(view_count) AS BIGINT) AS total_views,
                   avg(view_count) AS average_views
            FROM videos WHERE cluster_id IS NOT NULL GROUP BY 1)""",
    "topic_top_videos": V + """
      SELECT * FROM (SELECT video_id, cluster_id, view_count, row_number() OVER (
          PARTITION BY cluster_id ORDER BY view_count DESC, video_id) AS rank
        FROM videos WHERE cluster_id IS NOT NULL) WHERE rank <= 5""",
    "category_stats": V + """SELECT category, count(*) AS n, avg(view_count) AS avg_view,
      median(view_count) AS median_view FROM videos WHERE category IS NOT NULL GROUP BY 1""",
    "explain_rules": with_ctes(DECORATED_SQL + "," + _RULES_SQL) + """
      SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY o) AS rule_no,
             feature, effect, reason FROM rules""",
    "parse_reply": with_ctes(VIDEOS_SQL + "," + REPLY_SQL) + """
      SELECT video_id, diagnosis, len(suggestions) AS n_suggestions,
             array_to_string(suggestions, '|') AS suggestions FROM parsed""",
    "title_advice_rules": with_ctes(DECORATED_SQL + "," + REPLY_SQL) + """
      SELECT video_id, diagnosis,
             CASE WHEN len(suggestions) > 0 THEN array_to_string(suggestions, '|') ELSE
               array_to_string(list_filter([
                 CASE WHEN length(coalesce(d.title, '')) < 10 THEN
                   '标题偏短，建议增加描述性词汇或悬念（如：''竟然...''，''这几点...''）' END,
                 CASE WHEN NOT regexp_matches(coalesce(d.title, ''), '[【】！？]') THEN
                   '建议使用【】突出重点，或使用？！增强语气' END], lambda x: x IS NOT NULL), '|')
             END AS advice_list,
             '为您找到 ' || len(suggestions) || ' 个相似热门标题，建议结合参考。' AS summary
      FROM decorated d JOIN parsed USING (video_id)""",
    "judge_score_avg": """
      SELECT reason, count(*) AS n, round(avg(score), 6) AS avg_score
      FROM (SELECT CASE WHEN toxic = 1 THEN 3.0 WHEN lang = 'de' THEN 3.0
                        ELSE quality + 4.0 END::DOUBLE AS score,
                   CASE WHEN toxic = 1 THEN 'JSON Parse Error' ELSE lang END AS reason
            FROM labels JOIN documents USING (doc_id)) GROUP BY 1""",
    "last_k_turns": """
      SELECT conv_id, turn, role, text FROM (
        SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (
                 PARTITION BY conv_id ORDER BY turn DESC) AS n_after,
               CASE WHEN role = 'user' THEN 1 ELSE 0 END AS is_user,
               sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS n_user
        FROM conversations)
      WHERE n_user < 5 OR n_after < 5 OR (n_after = 5 AND is_user = 1)""",
    "intent_rules": """SELECT conv_id, turn, CASE turn WHEN 0 THEN 'greeting' WHEN 1 THEN 'thanks'
      ELSE 'other' END AS intent FROM conversations""",
    "last_step_tool": """
      SELECT u.user_id, s.event_type AS tool FROM (SELECT DISTINCT user_id FROM events) u
      LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)
                   AS rn FROM events WHERE event_type <> 'error') s
        ON s.user_id = u.user_id AND s.rn = 1""",
    "prompt_context": with_ctes(DECORATED_SQL + "," + _RULES_SQL) + f""",
      lines AS (SELECT video_id, string_agg('- ' || feature || ': ' || effect || ' (' || reason || ')',
                  chr(10) ORDER BY o) AS l FROM rules GROUP BY 1),
      f AS (SELECT *, coalesce(title, '') AS t, ' (' || (view_count // 10000) || '万播放)' AS w,
                   format('{{:,}}', view_count) AS g FROM decorated JOIN lines USING (video_id))
      SELECT video_id,
             '- 标题：' || t || chr(10) || '- 分区：' || category || chr(10) ||
             '- 预测模型预估播放量：' || g || chr(10) || '- 预测模型特征分析：' || chr(10) || l ||
             chr(10) || '- ' || category || w || chr(10) || '- ' || t || w || chr(10) ||
             '- ' || category || w AS context,
             '预估播放量：' || g || ' 次' || chr(10) || '所属档位：' || {_BUCKET_NAME} ||
             chr(10) || chr(10) || '特征分析：' || chr(10) || l AS answer
      FROM f""",
}
