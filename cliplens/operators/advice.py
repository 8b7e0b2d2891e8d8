"""Replies, prompts, advice records, tasks, the eval log and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliplens.functions.title import advice
from cliplens.operators.joins import lookup_join
from cliplens.operators.quantiles import grouped_quantiles

TERMINAL = ["SUCCESS", "FAILURE"]


def strip_fences(text: Column) -> Column:
    """Reply text without code fences and outer whitespace."""
    bare = F.replace(F.replace(text, F.lit("```json"), F.lit("")), F.lit("```"), F.lit(""))
    return F.regexp_replace(bare, r"^\s+|\s+$", "")


def parse_reply(text: Column) -> dict[str, Column]:
    """``diagnosis`` and ``suggestions`` of a reply; text that is no JSON is the diagnosis."""
    body = strip_fences(text)
    is_json = F.try_parse_json(body).isNotNull()
    parsed = F.from_json(body, "diagnosis string, suggestions array<string>")
    return {
        "diagnosis": F.when(is_json, parsed["diagnosis"]).otherwise(body),
        "suggestions": F.when(is_json, F.coalesce(
            parsed["suggestions"], F.array().cast("array<string>")
        )).otherwise(F.array().cast("array<string>")),
    }


def parse_rewrites(text: Column, title: Column) -> Column:
    """The JSON list of a reply, or the title alone."""
    parsed = F.from_json(strip_fences(text), "array<string>")
    return F.coalesce(parsed, F.array(title))


def parse_judgement(text: Column) -> dict[str, Column]:
    """``score`` and ``reason`` of a judge reply; what is missing gets a default."""
    body = strip_fences(text)
    is_json = F.try_parse_json(body).isNotNull()
    parsed = F.from_json(body, "score double, reason string")
    # Default score and reasons.
    return {
        "score": F.when(is_json, F.coalesce(parsed["score"], F.lit(3.0))).otherwise(F.lit(3.0)),
        "reason": F.when(is_json, F.coalesce(parsed["reason"], F.lit("Parsed"))).otherwise(
            F.lit("JSON Parse Error")),
    }


def whole(number: Column) -> Column:
    """Digits in groups of three, the fraction cut off towards zero."""
    return F.format_number(F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)), 0)


def ten_thousands(views: Column) -> Column:
    """Whole ten-thousands, truncated."""
    return F.floor(views / 10000)


def similar_line(title: Column, views: Column) -> Column:
    return F.concat(F.lit("- "), title, F.lit(" ("), ten_thousands(views).cast("string"),
                    F.lit("万播放)"))


def explanation_lines(rules: Column) -> Column:
    return F.array_join(F.transform(rules, lambda e: F.concat(
        F.lit("- "), e["feature"], F.lit(": "), e["effect"], F.lit(" ("), e["reason"], F.lit(")")
    )), "\n")


def importance_lines(importance: Column) -> Column:
    """The first three of ordered (feature, score) pairs, four decimals each."""
    return F.array_join(F.transform(F.slice(importance, 1, 3), lambda e: F.concat(
        F.lit("- "), e["feature"], F.lit(": "), F.format_string("%.4f", e["score"]))), "\n")


def prompt_context(title: Column, category: Column, predicted: Column, rules: Column,
                   similar: Column, importance: Column | None = None) -> Column:
    """The data part of the advice prompt: first three similar titles, grouped digits."""
    shown = F.transform(F.slice(similar, 1, 3),
                        lambda s: similar_line(s["title"], s["view_count"]))
    # The field captions.
    return F.concat(
        F.lit("- 标题："), title, F.lit("\n- 分区："), category,
        F.lit("\n- 预测模型预估播放量："), whole(predicted),
        F.lit("\n- 预测模型特征分析：\n"), explanation_lines(rules),
        *([] if importance is None else [F.lit("\n"), importance_lines(importance)]),
        F.lit("\n"), F.array_join(shown, "\n"),
    )


def prediction_text(predicted: Column, bucket: Column, rules: Column) -> Column:
    # The captions of the answer.
    return F.concat(
        F.lit("预估播放量："), whole(predicted), F.lit(" 次\n所属档位："), bucket,
        F.lit("\n\n特征分析：\n"), explanation_lines(rules))


def advice_record(title: Column, reply: dict[str, Column], n_similar: Column) -> dict[str, Column]:
    # Default diagnosis and summary texts.
    return {
        "advice_list": advice(title, reply["suggestions"]),
        "diagnosis": F.coalesce(reply["diagnosis"], F.lit("智能体正在休息，仅提供基础建议。")),
        "summary": F.concat(F.lit("为您找到 "), n_similar.cast("string"),
                            F.lit(" 个相似热门标题，建议结合参考。")),
    }


SIMILAR = "array<struct<title:string,view_count:bigint>>"
RULES = "array<struct<feature:string,effect:string,reason:string>>"


def title_advice(requests: DataFrame, hits: DataFrame | None = None,
                 predictions: DataFrame | None = None, replies: DataFrame | None = None,
                 importance: list[tuple[str, float]] | None = None) -> DataFrame:
    """One advice record per request: similar titles, prompt, advice, diagnosis, summary.

    ``requests`` has (request_id, title, category), ``hits`` the few ranked rows
    of a hybrid search as (query_id, rank, title, view_count), ``predictions``
    (request_id, predicted_view, explanations) and ``replies`` (request_id,
    reply). A part that is missing, whole or for one request, leaves its
    defaults: no similar titles, 0 views without explanations, rule-based advice.
    """
    out = requests
    if hits is not None:
        similar = hits.groupBy(F.col("query_id").alias("request_id")).agg(F.array_sort(F.collect_list(
            F.struct("rank", "title", "view_count"))).alias("_hits"))
        out = out.join(similar, "request_id", "left").withColumn("similar_titles", F.transform(
            "_hits", lambda h: F.struct(h["title"], h["view_count"]))).drop("_hits")
    if predictions is not None:
        out = out.join(predictions.select("request_id", "predicted_view", "explanations"), "request_id", "left")
    if replies is not None:
        out = out.join(replies.select("request_id", "reply"), "request_id", "left")
    defaults = {"similar_titles": F.array().cast(SIMILAR), "predicted_view": F.lit(0.0),
                "explanations": F.array().cast(RULES), "reply": F.lit("{}")}
    out = out.withColumns({c: F.coalesce(c, d) if c in out.columns else d for c, d in defaults.items()})
    scores = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(float(s)).alias("score"))
                       for f, s in importance or []]).cast("array<struct<feature:string,score:double>>")
    record = advice_record(F.col("title"), parse_reply(F.col("reply")), F.size("similar_titles"))
    return out.select(
        "request_id", "similar_titles",
        prompt_context(F.col("title"), F.col("category"), F.col("predicted_view"),
                       F.col("explanations"), F.col("similar_titles"), scores).alias("prompt"),
        *[c.alias(name) for name, c in record.items()])


def latest_status(events: DataFrame) -> DataFrame:
    """Newest status per task; ``finished_at`` only for terminal ones."""
    last = events.groupBy("task_id").agg(
        F.max(F.struct("event_time", "event_id", "status")).alias("e"),
        F.min("event_time").alias("created_at"))
    return last.select(
        "task_id", "e.status", "created_at",
        F.when(F.col("e.status").isin(TERMINAL), F.col("e.event_time")).alias("finished_at"))


def resolve_status(records: DataFrame, queue: DataFrame) -> DataFrame:
    """The stored status if it is terminal, else the state of the queue."""
    both = queue.withColumnRenamed("status", "_queue").join(
        records.withColumnRenamed("status", "_db"), "task_id", "left")
    return both.withColumn("status", F.when(
        F.col("_db").isin(TERMINAL), F.col("_db")).otherwise(F.coalesce("_queue", F.lit("PENDING")))
    ).drop("_db", "_queue")


def eval_log_summary(log: DataFrame) -> DataFrame:
    """Calls, errors and latency per tool."""
    means = log.groupBy("tool_used").agg(
        F.count("*").alias("calls"), F.count("error").alias("errors"),
        F.avg("latency_ms").alias("avg_latency"))
    marks = grouped_quantiles(log.select("tool_used", "latency_ms"), ["tool_used"], "latency_ms",
                              {"p50_latency": 0.5, "p95_latency": 0.95})
    return means.join(marks, "tool_used", "left")


def last_exchanges(turns: DataFrame, k: int = 5) -> DataFrame:
    """The last ``k`` user turns of a conversation and everything after the first of them.

    The k-th last user turn is found first, with a rank that is cut off before
    the shuffle; the turns themselves are then filtered without a window.
    """
    newest = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    start = (
        turns.where("role = 'user'").select("conv_id", "turn")
        .withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= k)
        .groupBy("conv_id").agg(
            F.when(F.count("*") == k, F.min("turn")).alias("_from"))
    )
    # A conversation with fewer user turns is kept whole.
    kept = F.col("_from").isNull() | (F.col("turn") >= F.col("_from"))
    return lookup_join(turns, start, ["conv_id"], "left", salt_by=["turn"]).where(kept).drop("_from")


def last_tool(steps: Column) -> Column:
    """Tool of the last step, NULL for no steps."""
    return F.try_element_at(steps, F.lit(-1))["tool"]
