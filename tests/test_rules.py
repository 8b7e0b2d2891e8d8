"""Hand-written rows for cleaning, features and replies."""

from pyspark.sql import functions as F

from cliplens import schema as S
from cliplens import session
from cliplens.functions import text as X
from cliplens.functions import title as TT
from cliplens.operators import advice, authors, clean, merge, reports, tfidf
from cliplens.sources import files
from cliplens.streaming import jobs


def one(spark, value, expr, dtype="string"):
    row = spark.createDataFrame([(value,)], f"x {dtype}").select(expr(F.col("x")).alias("y"))
    return row.first()["y"]


def features(spark, title):
    df = spark.createDataFrame([(title,)], "title string")
    return df.select(*[c.alias(n) for n, c in TT.title_features(F.col("title")).items()]).first()


def test_title_features(spark):
    f = features(spark, "【Python教程】3天速成？")
    assert (f.title_len, f.digit_cnt, f.question_cnt, f.has_brackets, f.has_tutorial) == (15, 1, 1, 1, 1)
    f = features(spark, "居然竟然竟然 TOP 爆笑！100% a：b ٣")
    assert (f.emotion_cnt, f.emotion_hit_cnt) == (1 + 4 + 1, 4)
    assert (f.digit_cnt, f.exclam_cnt, f.has_percent, f.has_colon) == (4, 1, 1, 1)
    assert (f.has_list, f.has_hot, f.has_review) == (1, 1, 0)
    assert features(spark, None).title_len == 0


def test_publish_time(spark):
    ts = spark.createDataFrame([(1700000000.9,), (None,), (float("nan"),)], "x double").select(
        TT.publish_time_of_epoch(F.col("x")).alias("t")).select(
        *[c.alias(n) for n, c in TT.time_features(F.col("t")).items()]).collect()
    assert [tuple(r) for r in ts] == [(22, 1), (-1, -1), (-1, -1)]
    assert one(spark, "invalid", TT.publish_time_of_text) is None


def test_buckets(spark):
    values = [0.0, 99_999.0, 100_000.0, 500_000.0, 2_000_000.0, float("nan"), None]
    got = spark.createDataFrame([(v,) for v in values], "x double").select(
        TT.view_bucket(F.col("x")).alias("b")).collect()
    assert [r.b for r in got] == [0, 0, 1, 2, 3, 3, None]
    assert one(spark, 9, TT.bucket_name, "bigint") == "未知"


def test_two_number_repairs(spark):
    from cliplens.functions.numbers import crawl_number, load_number

    assert [one(spark, v, crawl_number) for v in ["12.7", "abc", None, "7"]] == [0, 0, 0, 7]
    assert [one(spark, v, load_number) for v in ["12.7", "abc", None, "7"]] == [12, 0, 0, 7]


def test_validation_reasons(spark):
    def row(**k):
        base = dict(video_id="a", title="t", view_count="5", like_count=None)
        return tuple({**base, **k}.get(f.name) for f in S.RAW_ITEM.fields)

    items = spark.createDataFrame(
        [row(), row(video_id=""), row(title=None), row(view_count="0"), row(view_count="abc")],
        S.RAW_ITEM)
    got = [(r.reject_reason, r.view_count, r.like_count) for r in clean.validate_items(items).collect()]
    assert got == [(None, 5, 0), ("video_id", 5, 0), ("title", 5, 0), ("view_count", 0, 0), (None, 0, 0)]


def test_segment(spark):
    assert one(spark, "3天速成 Été x2", X.segment) == ["3", "天速", "速成", "Été", "x2"]
    assert one(spark, None, X.retrieval_tokens) == []
    assert one(spark, "The 什么 a 爆款", X.retrieval_tokens) == ["the", "爆款"]
    assert one(spark, "A-b!!天 ", X.clean_for_embedding) == "A b  天"
    assert one(spark, "A-b!!天 ", X.clean_for_keywords) == "A b 天"


def test_keyword_hook_equals_default(spark):
    text = "Foo-bar ü9 天速成 été TOP10 x 什么 a_b"
    plain = one(spark, text, X.keyword_tokens)
    hooked = one(spark, text, lambda c: X.keyword_tokens(c, lambda t: X.segment(t)))
    assert plain == hooked == ["foo", "bar", "天速", "速成", "top10"]


def test_keywords_fall_back_for_small_clusters(spark):
    rows = [(1, 1, "apple pear"), (1, 2, "apple fig"), (2, 3, "kiwi kiwi lime")]
    rows += [(3, i, f"common word{i % 2}") for i in range(4, 10)]
    df = spark.createDataFrame(rows, "cluster_id bigint, video_id bigint, title string")
    got = tfidf.topic_keywords(df, X.keyword_words(F.col("title")), X.keyword_tokens(F.col("title")))
    terms = {c: [r.term for r in got.where(f"cluster_id = {c}").orderBy("rank").collect()] for c in (1, 2, 3)}
    assert terms == {1: ["apple", "fig", "pear"], 2: ["kiwi", "lime"], 3: ["word0", "word1"]}


def test_author_defaults_of_nothing(spark):
    none = authors.author_stats(spark.createDataFrame([("x", 1)], "author_id string, view_count bigint"))
    assert tuple(authors.author_defaults(none).first()) == (0.0, 0.0, 0.0)


def test_replies(spark):
    def reply(text):
        df = spark.createDataFrame([(text,)], "x string").withColumns(advice.parse_reply(F.col("x")))
        r = df.first()
        return r.diagnosis, r.suggestions

    assert reply('```json\n{"diagnosis": "d", "suggestions": ["a", "b"]}\n```') == ("d", ["a", "b"])
    assert reply("  plain \n") == ("plain", [])
    assert reply('{"suggestions": ["a"]}') == (None, ["a"])
    judged = spark.createDataFrame([('{"score": 5}',), ("oops",), ('{"reason": "r"}',)], "x string").withColumns(
        advice.parse_judgement(F.col("x"))).collect()
    assert [(r.score, r.reason) for r in judged] == [(5.0, "Parsed"), (3.0, "JSON Parse Error"), (3.0, "r")]


def test_advice_rules(spark):
    none = F.array().cast("array<string>")
    assert len(one(spark, "短标题", lambda c: TT.advice(c, none))) == 2
    assert one(spark, "【短】", lambda c: TT.advice(c, F.array(F.lit("x")))) == ["x"]


def test_memory_keeps_five_exchanges(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", "x") for t in range(14)]
    rows += [(2, 0, "system", "x"), (2, 1, "user", "x")]
    got = advice.last_exchanges(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))
    assert sorted((r.conv_id, r.turn) for r in got.collect()) == [(1, t) for t in range(4, 14)] + [(2, 0), (2, 1)]


def test_upsert_writes_nulls(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "video_id int, v string")
    delta = spark.createDataFrame([(2, None), (3, "c")], "video_id int, v string")
    assert sorted(tuple(r) for r in merge.upsert(base, delta).collect()) == [(1, "a"), (2, None), (3, "c")]
    assert tuple(merge.upsert_counts(base, delta).first()) == (1, 1)
    assert merge.get_by_id(base, 2).first().v == "b"


def test_pages_cap_and_bad_pages(spark):
    page = '{"code":0,"data":{"list":[{"bvid":"a","rcmd_reason":{"tags":[{"tag_name":"t"},null]}},{"bvid":"b"}]}}'
    pages = spark.createDataFrame(
        [(1, page), (2, '{"code":-352}'), (3, '{"code":0,"data":{"list":[]}}'), (4, "oops")],
        "page_no int, body string")
    rows = files.flatten_pages(pages).collect()
    assert [(r.video_id, r.tags) for r in rows] == [("a", ["t"]), ("b", [])]
    assert files.flatten_pages(pages, target=1).count() == 1
    assert files.max_pages(41) == 3 and files.max_pages(0) == 1


def test_cluster_summary_ignores_null(spark):
    df = spark.createDataFrame([(-1,), (0,), (0,), (2,), (None,)], "c int")
    assert tuple(reports.cluster_summary(df, "c").first()) == (5, 2, 1, 0.2)
    assert reports.cluster_summary(df.limit(0), "c").first().noise_ratio is None


def test_last_tool(spark):
    df = spark.sql("select array(struct('a' as tool), struct('b' as tool)) as x "
                   "union all select array() as x")
    assert {r.t for r in df.select(advice.last_tool(F.col("x")).alias("t")).collect()} == {"b", None}


def test_predictions_are_cut_not_rounded(spark):
    shown = lambda x: one(spark, x, advice.whole, "double")
    assert [shown(22025.6), shown(-1.9), shown(1234567.0)] == ["22,025", "-1", "1,234,567"]


def title_advice(spark, **parts):
    requests = spark.createDataFrame([(1, "短标题", "未知")], "request_id bigint, title string, category string")
    return advice.title_advice(requests, **parts).first()


def test_advice_with_all_parts(spark):
    hits = spark.createDataFrame([(1, 2, "乙", 30_000), (1, 1, "甲", 129_999)],
                                 "query_id bigint, rank bigint, title string, view_count bigint")
    predictions = spark.createDataFrame([(1, 22025.6, [("标题长度", "负向", "x")])],
                                        f"request_id bigint, predicted_view double, explanations {advice.RULES}")
    replies = spark.createDataFrame([(1, '{"diagnosis": "d", "suggestions": ["a"]}')],
                                    "request_id bigint, reply string")
    r = title_advice(spark, hits=hits, predictions=predictions, replies=replies,
                     importance=[("a", 0.5), ("b", 0.25), ("c", 0.2), ("d", 0.05)])
    assert [s.title for s in r.similar_titles] == ["甲", "乙"]
    assert r.advice_list == ["a"] and r.diagnosis == "d" and "2 个" in r.summary
    assert "22,025" in r.prompt and "- 甲 (12万播放)" in r.prompt
    assert "- a: 0.5000\n- b: 0.2500\n- c: 0.2000" in r.prompt and "- d:" not in r.prompt


def test_advice_without_search(spark):
    r = title_advice(spark)
    assert r.similar_titles == [] and "0 个" in r.summary


def test_advice_without_reply_falls_back_to_rules(spark):
    r = title_advice(spark)
    assert len(r.advice_list) == 2 and r.diagnosis == "智能体正在休息，仅提供基础建议。"


def test_advice_without_prediction_uses_defaults(spark):
    assert "预估播放量：0\n" in title_advice(spark).prompt


def test_csv_begins_with_a_mark_and_reads_back(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b\nc'), (2, ""), (3, None)], "id bigint, t string").coalesce(1)
    files.write_csv(df, f"{tmp_path}/csv")
    (part,) = (tmp_path / "csv").glob("part-*.csv")
    assert part.read_bytes().startswith(b"\xef\xbb\xbfid,t")
    assert sorted(map(tuple, files.read_csv(spark, f"{tmp_path}/csv", df.schema).collect())) == sorted(
        map(tuple, df.collect()))


def test_json_arrays_are_bounded_by_bytes(spark, tmp_path):
    df = spark.range(300).selectExpr("id", "repeat('x', 1000) AS t")
    files.write_json_array(df, f"{tmp_path}/json", "id", file_bytes=30_000)
    parts = list((tmp_path / "json").glob("part-*"))
    assert len(parts) > 6 and max(p.stat().st_size for p in parts) < 90_000
    assert files.read_json_array(spark, f"{tmp_path}/json", df.schema).count() == 300


def test_upsert_table_survives_a_restart(spark, tmp_path):
    def rows(*values):
        return spark.createDataFrame(list(values), "k bigint, version bigint, v string")

    def table():
        return jobs.VersionedTable(spark, f"{tmp_path}/t", "k", "version")

    table().write_batch(rows((1, 1, "a"), (2, 1, "b"), (1, 0, "older")), 0)
    table().write_batch(rows((2, 3, None), (3, 1, "c")), 1)
    table().compact()
    table().write_batch(rows((2, 2, "late"), (3, 1, "again"), (4, 1, "d")), 2)
    want = [(1, 1, "a"), (2, 3, None), (3, 1, "again"), (4, 1, "d")]
    assert sorted(map(tuple, table().read().collect())) == want
    table().write_batch(rows((2, 2, "late"), (3, 1, "again"), (4, 1, "d")), 2)  # a repeated batch
    table().compact()
    assert sorted(map(tuple, table().read().collect())) == want


def test_run_folder_goes_at_the_end(spark):
    saved = session.materialize(spark.range(3), "gone")
    path = saved.inputFiles()[0]
    run = spark.conf.get(session.RUN_KEY)
    spark.conf.set(session.RUN_KEY, f"{session.shared_dir(spark)}/run-of-this-test")
    own = session.scratch_path(spark, "x")
    spark.range(1).write.parquet(own)
    session.end_run(spark)
    assert not session.path_exists(spark, own) and session.path_exists(spark, path)
    spark.conf.set(session.RUN_KEY, run)
