"""Fixed schemas at the boundaries, and defaults for optional columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COUNTERS = [
    "view_count", "like_count", "coin_count",
    "favorite_count", "share_count", "comment_count",
]

VIDEO = T.StructType([
    T.StructField("video_id", T.StringType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("description", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("author_id", T.LongType()),
    T.StructField("publish_time", T.TimestampType(), False),
    *[T.StructField(name, T.LongType()) for name in COUNTERS],
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("category", T.StringType()),
])

# Crawled items before cleaning: every scalar may be missing or malformed text.
RAW_ITEM = T.StructType([
    T.StructField(name, T.StringType())
    for name in ["video_id", "title", "description", "author", "author_id", "publish_time",
                 *COUNTERS, "tags", "category"]
])

PAGE = T.StructType([
    T.StructField("code", T.IntegerType()),
    T.StructField("message", T.StringType()),
    T.StructField("data", T.StructType([
        T.StructField("list", T.ArrayType(T.StructType([
            T.StructField("bvid", T.StringType()),
            T.StructField("title", T.StringType()),
            T.StructField("desc", T.StringType()),
            T.StructField("owner", T.StructType([
                T.StructField("name", T.StringType()),
                T.StructField("mid", T.LongType()),
            ])),
            T.StructField("pubdate", T.LongType()),
            T.StructField("stat", T.StructType([
                T.StructField(name, T.LongType())
                for name in ["view", "like", "coin", "favorite", "share", "reply"]
            ])),
            T.StructField("rcmd_reason", T.StructType([
                T.StructField("tags", T.ArrayType(T.StructType([
                    T.StructField("tag_name", T.StringType()),
                ]))),
            ])),
            T.StructField("tname", T.StringType()),
        ]))),
    ])),
])

REQUEST = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("author_id", T.LongType()),
    T.StructField("publish_time", T.LongType()),
])

EVAL_LOG = T.StructType([
    T.StructField("input", T.StringType()),
    T.StructField("tool_used", T.StringType()),
    T.StructField("output", T.StringType()),
    T.StructField("latency_ms", T.LongType()),
    T.StructField("error", T.StringType()),
])


def ensure_columns(df: DataFrame, defaults: dict[str, tuple[str, object]]) -> DataFrame:
    """Add each missing column as ``{name: (type, default)}`` says."""
    missing = {
        name: F.lit(default).cast(dtype)
        for name, (dtype, default) in defaults.items()
        if name not in df.columns
    }
    return df.withColumns(missing) if missing else df
