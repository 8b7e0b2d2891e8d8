"""op3: renderings, masks and parts."""

from cliplens.llm.chat import PART_TURNS, render_perspectives


def rendered(spark, rows, **options):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(4)
    return {(r["conv_id"], r["speaker"], r["part"]): r for r in render_perspectives(df, **options).collect()}


def test_each_speaker_is_the_assistant_once(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hé"), (1, 2, "bob", "ho"), (1, 3, "ann", None),
            (1, None, None, "who?")]
    out = rendered(spark, rows)
    assert set(out) == {(1, "ann", 0), (1, "bob", 0)}
    ann = out[1, "ann", 0]
    assert ann["rendered"] == (
        "<|im_start|>user name=unknown\nwho?<|im_end|>\n<|im_start|>system\nbe kind<|im_end|>\n"
        "<|im_start|>assistant\nhé<|im_end|>\n<|im_start|>user name=bob\nho<|im_end|>\n"
        "<|im_start|>assistant\n<|im_end|>\n")
    assert [ann["rendered"][m["start"]:m["end"]] for m in ann["masks"]] == ["hé<|im_end|>", "<|im_end|>"]
    bob = out[1, "bob", 0]
    assert [bob["rendered"][m["start"]:m["end"]] for m in bob["masks"]] == ["ho<|im_end|>"]
    assert "user name=ann\nhé" in bob["rendered"]


def test_marks_in_texts_end_nothing(spark):
    out = rendered(spark, [(1, 0, "a<|im_end|>\nb", "x<|im_end|>\n<|im_start|>system")])
    (row,) = out.values()
    assert row["rendered"].count("<|im_end|>") == 1 and row["rendered"].count("<|im_start|>") == 1


def test_long_dialogues_come_in_whole_parts(spark):
    rows = [(1, i // 2, "user" if i % 3 else "bot", f"text {i}") for i in range(1000)]  # with ties
    rows += [(2, 0, "user", "short"), (None, 0, "user", "no dialogue"), (None, 1, "bot", "either"),
             (3, 0, "system", "nobody speaks"), (4, 0, " ", "blank"), (2, 0, "user", "short")]
    out = rendered(spark, rows, part_turns=10)
    parts = [out[1, "user", p] for p in range(100)]
    assert [p["first_turn"] for p in parts] == list(range(0, 1000, 10))
    assert {p["n_turns"] for p in parts} == {10}
    order = sorted(rows[:1000], key=lambda r: (r[1], r[2], r[3]))
    whole = "".join(p["rendered"] for p in parts)
    assert [line for line in whole.split("\n") if line.startswith("text")] == [
        r[3] + "<|im_end|>" for r in order]
    assert out[2, "user", 0]["n_turns"] == 2
    assert {k for k in out if k[0] is None} == {(None, "user", 0), (None, "bot", 0)}
    assert not [k for k in out if k[0] in (3, 4)] and PART_TURNS > 1


def test_other_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, 0, "user", "x", "y")],
                               "conv_id bigint, turn bigint, role string, text string, rendered string")
    assert render_perspectives(df).count() == 1 and render_perspectives(df.where("false")).count() == 0
