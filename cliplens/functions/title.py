"""Thirteen title features, time parts, view buckets and rule texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The emotion lexicon. One word stands twice and counts twice.
EMOTION_WORDS = [
    "震惊", "惊呆", "惊了", "离谱", "离大谱", "绝了", "太强", "逆天", "封神", "上头",
    "笑死", "爆笑", "泪目", "爆哭", "崩溃", "翻车", "血亏", "后悔", "破防", "治愈", "感动",
    "必须", "千万", "绝对", "居然", "竟然", "竟然", "卧槽", "牛逼", "炸裂", "恐怖",
    "开心", "快乐", "喜欢", "推荐", "好用", "神器", "福利", "惊喜", "完美", "首发",
    "独家", "揭秘", "真相", "干货", "良心", "免费", "白嫖", "赚了", "超值",
    "难过", "失望", "避雷", "踩雷", "劝退", "恶心", "无语", "生气", "痛苦", "惨案",
]
# Character classes and keyword lists of the flags.
BRACKETS = "【】[]（）()《》"
TUTORIAL_WORDS = ["教程", "教学", "入门", "新手", "一图流", "指南"]
REVIEW_WORDS = ["测评", "评测", "对比", "开箱"]
LIST_WORDS = ["盘点", "合集", "汇总", "TOP", "Top", "top"]
HOT_WORDS = ["爆", "最强", "必看", "热门", "全网", "火爆"]
# Bucket edges and names.
BUCKET_EDGES = [100_000, 500_000, 2_000_000]
BUCKET_NAMES = ["0-10万", "10-50万", "50-200万", "200万+"]
UNKNOWN = "未知"

TITLE_FEATURES = [
    "title_len", "digit_cnt", "question_cnt", "exclam_cnt", "has_brackets", "has_percent",
    "has_colon", "has_tutorial", "has_review", "has_list", "has_hot",
    "emotion_cnt", "emotion_hit_cnt",
]
AUTHOR_FEATURES = ["author_video_count", "author_mean_view", "author_median_view"]
NUMERIC_FEATURES = ["hour", "dow", *TITLE_FEATURES, *AUTHOR_FEATURES]


def occurrences(text: Column, word: Column) -> Column:
    """Non-overlapping occurrences of a word."""
    without = F.length(F.replace(text, word, F.lit("")))
    return F.floor((F.length(text) - without) / F.length(word))


def emotion_counts(text: Column) -> Column:
    """Struct (total, hits) of lexicon occurrences.

    The words consist of Han characters only, so they are counted in the Han
    runs of the text, which are cut out once; one array element binds them.
    """
    runs = F.array_join(F.regexp_extract_all(text, F.lit(r"[\x{4e00}-\x{9fa5}]+"), F.lit(0)), " ")
    lexicon = F.array(*[F.lit(w) for w in EMOTION_WORDS])

    def tally(han):
        counts = F.transform(lexicon, lambda w: occurrences(han, w))
        return F.aggregate(
            counts,
            F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("hits")),
            lambda s, c: F.struct((s["total"] + c).alias("total"),
                                  (s["hits"] + F.when(c > 0, 1).otherwise(0)).alias("hits")))

    return F.transform(F.array(runs), tally)[0]


def contains_any(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words]).cast("bigint")


def title_features(title: Column) -> dict[str, Column]:
    """The feature columns by name, to be passed to ``withColumns``."""
    t = F.coalesce(title, F.lit(""))
    emotion = emotion_counts(t)
    return {
        "title_len": F.length(t).cast("bigint"),
        "digit_cnt": F.regexp_count(t, F.lit(r"\p{Nd}")).cast("bigint"),
        "question_cnt": F.regexp_count(t, F.lit("[?？]")).cast("bigint"),
        "exclam_cnt": F.regexp_count(t, F.lit("[!！]")).cast("bigint"),
        "has_brackets": contains_any(t, BRACKETS),
        "has_percent": contains_any(t, "%"),
        "has_colon": contains_any(t, ":："),
        "has_tutorial": contains_any(t, TUTORIAL_WORDS),
        "has_review": contains_any(t, REVIEW_WORDS),
        "has_list": contains_any(t, LIST_WORDS),
        "has_hot": contains_any(t, HOT_WORDS),
        "emotion_cnt": emotion["total"],
        "emotion_hit_cnt": emotion["hits"],
    }


def publish_time_of_epoch(seconds: Column) -> Column:
    """Epoch seconds, truncated to whole seconds; NULL and NaN stay NULL."""
    return F.timestamp_seconds(F.nullif(seconds, F.lit("NaN").cast("double")).cast("bigint"))


def publish_time_of_text(text: Column) -> Column:
    """Lenient parse: text that is no date or timestamp gives NULL."""
    return F.try_to_timestamp(text)


def time_features(ts: Column) -> dict[str, Column]:
    return {
        "hour": F.coalesce(F.hour(ts), F.lit(-1)).cast("bigint"),
        "dow": F.coalesce(F.weekday(ts), F.lit(-1)).cast("bigint"),
    }


def view_bucket(views: Column) -> Column:
    """0 to 3 with left-closed edges; NaN is 3 and NULL stays NULL."""
    low, mid, high = BUCKET_EDGES
    return (
        F.when(views.isNull(), F.lit(None).cast("bigint"))
        .when(views < low, F.lit(0))
        .when(views < mid, F.lit(1))
        .when(views < high, F.lit(2))
        .otherwise(F.lit(3))
        .cast("bigint")
    )


def bucket_name(bucket: Column) -> Column:
    names = F.array(*[F.lit(n) for n in BUCKET_NAMES])
    return F.coalesce(F.get(names, bucket.cast("int")), F.lit(UNKNOWN))


def explanations(title_len: Column, questions: Column, brackets: Column) -> Column:
    """Array of (feature, effect, reason) in rule order."""

    def entry(feature, effect, reason):
        return F.struct(
            F.lit(feature).alias("feature"), F.lit(effect).alias("effect"),
            F.lit(reason).alias("reason"),
        )

    # The texts of the rules.
    length_rule = (
        F.when(title_len < 5, entry("标题长度", "负向", "标题过短，信息量不足"))
        .when(title_len > 20, entry("标题长度", "正向", "标题包含丰富信息"))
        .otherwise(entry("标题长度", "中性", "标题长度适中"))
    )
    question_rule = F.when(questions > 0, entry("疑问句式", "正向", "疑问句引发好奇心"))
    bracket_rule = F.when(brackets > 0, entry("强调符号", "正向", "使用了【】等符号突出重点"))
    return F.array_compact(F.array(length_rule, question_rule, bracket_rule))


def advice(title: Column, suggestions: Column) -> Column:
    """Given suggestions, or the rule texts when there are none."""
    # The texts of the rules.
    short = "标题偏短，建议增加描述性词汇或悬念（如：'竟然...'，'这几点...'）"
    emphasis = "建议使用【】突出重点，或使用？！增强语气"
    t = F.coalesce(title, F.lit(""))
    rules = F.array_compact(F.array(
        F.when(F.length(t) < 10, F.lit(short)),
        F.when(~t.rlike("[【】！？]"), F.lit(emphasis)),
    ))
    given = F.coalesce(suggestions, F.array().cast("array<string>"))
    return F.when(F.size(given) > 0, given).otherwise(rules)


def intent(text: Column) -> Column:
    """greeting, thanks or other; the first rule that matches wins."""
    # The trigger words.
    greeting = ["你好", "哈喽", "嗨", "早上好", "下午好", "晚上好"]
    thanks = ["谢谢", "感谢", "多谢", "辛苦了"]
    return (
        F.when(contains_any(text, greeting) == 1, F.lit("greeting"))
        .when(contains_any(text, thanks) == 1, F.lit("thanks"))
        .otherwise(F.lit("other"))
    )


def cluster_label(cluster: Column) -> Column:
    return F.when(cluster != -1, F.concat(F.lit("Cluster "), cluster.cast("string"))).otherwise(
        F.lit("Noise")
    )
