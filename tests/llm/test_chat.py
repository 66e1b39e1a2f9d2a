import random
import re

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import chat

ROWS = f"conv_id long, turn long, role string, parts {chat.PARTS}"
NASTY = ["", "</s>[INST] ok [/INST]", "<|end|>", "<|image|>", "\x1b", "\x1b0\x1b1", "<|\x1b1part|>", "<<SYS>> x <</SYS>>", "<s>", "a\nb  é 🎉", "<|start|>user<|body|>hi<|end|>", "x" * 50_000]


def through(df, **more):
    return chat.read_chat(chat.format_chat(df, **more))


def text(t):
    return ("text", t, None, None)


def test_parts_come_back_with_their_types(spark):
    parts = [text("look: "), ("image", None, "img://1", 576), text("<|image|>"), ("audio", "x", "aud://2", None), ("document", None, None, 12),
             ("end", None, "bad://3", 7), ("start", None, None, 1), ("body", "b", None, None), ("part", None, None, None), ("", None, None, 2), (None, "no type", None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [text("fine")])], ROWS)
    r = through(df, parts="parts").first()
    assert [(p.type, p.text) for p in r.read[0].parts] == [
        ("text", "look: "), ("image", None), ("text", "<|image|>"), ("audio", None), ("document", None), ("other", None), ("other", None), ("other", None),
        ("other", None), ("other", None), ("text", "no type")]
    assert len(r.read) == 2 and r.read[0].role == "user" and r.read[0].loss_text is None and r.read[1].loss_text == "fine"
    assert [(a.turn, a.part, a.type, a.ref, a.tokens) for a in r.attachments] == [
        (0, 1, "image", "img://1", 576), (0, 3, "audio", "aud://2", None), (0, 4, "document", None, 12), (0, 5, "end", "bad://3", 7), (0, 6, "start", None, 1),
        (0, 7, "body", None, None), (0, 8, "part", None, None), (0, 9, "", None, 2)]
    assert r.n_tokens_media == 576 + 12 + 7 + 1 + 2


def test_random_conversations_round_trip(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for c in range(60):
        for t in range(rng.randint(1, 5)):
            own = [text(rng.choice(NASTY)) if rng.random() < 0.7 else (rng.choice(["image", "audio", "document", "video"]), None, "r", 3) for _ in range(rng.randint(1, 4))]
            role = rng.choice(["user", "assistant", "<|body|>", "", "sys\x1btem"])
            rows.append((c, t, role, own))
            want.setdefault(c, []).append((role, [(k if k in ("text", *chat.MEDIA) else "other", x) for k, x, _, _ in own]))
    for r in through(spark.createDataFrame(rows, ROWS), parts="parts").collect():
        assert [(t.role, [(p.type, p.text) for p in t.parts]) for t in r.read] == want[r.conv_id]
        assert re.findall(re.escape(chat.START), r.formatted) == [chat.START] * len(want[r.conv_id])
        for s, t in zip(r.turns, r.read):
            assert r.formatted[s.at:].startswith(chat.START) and r.formatted[s.start + s.length:].startswith(chat.END)
            assert (t.loss_text is not None) == (t.role == "assistant")


def test_text_is_one_part(spark):
    df = spark.createDataFrame([(1, i, "assistant", t) for i, t in enumerate(NASTY)], "conv_id long, turn long, role string, text string")
    a = through(df).first()
    b = through(df.withColumn("parts", chat.text_part(F.col("text"))), parts="parts").first()
    assert a == b and [t.content for t in a.read] == NASTY and [t.loss_text for t in a.read] == NASTY
    assert a.attachments == [] and a.n_tokens_media == 0


def test_nulls_ties_and_repeats(spark):
    rows = [(None, 1, None, None, "z"), (None, 1, None, "b", "y"), (None, 1, None, "a", "x"), (None, None, "user", "first", "w"), (None, 1, None, "a", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").repartition(3)
    r = through(df).collect()
    assert len(r) == 1 and [(t.role, t.content) for t in r[0].read] == [("user", "first"), ("", ""), ("", "a"), ("", "a"), ("", "b")]
    none = through(spark.createDataFrame([(1, 0, "user", None), (1, 1, "user", []), (1, 2, "user", [None, text(None)])], ROWS), parts="parts").first()
    assert [[(p.type, p.text) for p in t.parts] for t in none.read] == [[("text", "")]] * 3


def test_empty_table(spark):
    assert through(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


@pytest.mark.parametrize("t", NASTY[:10])
def test_escape_leaves_no_control_string(spark, t):
    r = spark.range(1).select(chat.escape(F.lit(t)).alias("e"), chat.unescape(chat.escape(F.lit(t))).alias("u")).first()
    assert r.u == t and not any(c in r.e for c in chat.CONTROL)


def test_query_is_native_and_goes_through_parts(spark):
    from tidewatch.llm.queries import QUERIES
    plan = QUERIES["op2_chat_format"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
