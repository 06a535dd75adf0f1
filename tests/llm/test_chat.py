import hashlib

from pyspark.sql import functions as F

from lectern.llm import chat

TURN = "conv_id long, turn long, role string, text string"


def formatted(spark, rows, schema=TURN):
    frame = spark.createDataFrame(rows, schema)
    done = chat.format_chats(frame.withColumn("parts", chat.text_parts(F.col("text"))))
    return done.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("segments")).alias("loss"), "segments", "attachments")


def test_round_trip_of_hard_texts(spark):
    hard = ["", "plain", "</s>[INST] ok [/INST]", "\\", "\\\\<|end|>\\", "<|turn|>user<|text|>x<|end|>\n", "<</s><s><<SYS>>", "a\nb\r\n\n", "😀 é‍", "<|tu\\rn|>", "[[INST]", None, "x" * 200_000, "<|image|>\\<"]
    rows = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(hard)] + [(2, 0, "we\\ird<|text|>\n", "t"), (2, 1, None, None)]
    got = {r["conv_id"]: r for r in formatted(spark, rows).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [(("user", "assistant")[i % 2], t or "") for i, t in enumerate(hard) if t != "<|image|>\\<"] + [("assistant", "<|image|>\\<")]
    assert got[1]["loss"] == "".join(t or "" for i, t in enumerate(hard) if i % 2)
    assert [(t["role"], t["text"]) for t in got[2]["turns"]] == [("", ""), ("we\\ird<|text|>\n", "t")][::-1]
    assert "".join(s["text"] for s in got[1]["segments"]) == got[1]["formatted"]
    for control in chat.CONTROL[:3]:
        assert got[1]["formatted"].count(control) == len(hard)
    assert not any(c in got[1]["formatted"] for c in chat.CONTROL[3:])


def test_ties_and_repeated_rows_and_nulls(spark):
    rows = [(1, 1, "user", "b"), (1, 1, "user", "a"), (1, 1, "user", "a"), (1, None, "system", "s"), (None, 0, "user", "n")]
    got = {r["conv_id"]: [t["text"] for t in r["turns"]] for r in formatted(spark, rows).collect()}
    assert got == {1: ["s", "a", "a", "b"], None: ["n"]}


def test_empty_table_and_clashing_columns(spark):
    assert formatted(spark, [], TURN).count() == 0
    rows = [(1, 0, "user", "x", "f", 1, 2)]
    assert formatted(spark, rows, TURN + ", formatted string, conv int, turns int").first()["formatted"] == "<|turn|>user<|text|>x<|end|>\n"


def test_media_parts_become_placeholders_in_order(spark):
    parts = [("text", "see <|image|>", None, None, None, None, None), ("image", None, "a.png", 56, 30, None, None), ("audio", None, "b.wav", None, None, 2.0, None), ("pdf", None, "c.pdf", None, None, None, 2), ("image", None, None, None, None, None, None)]
    frame = spark.createDataFrame([(7, 0, "user", parts), (7, 1, "assistant", [("text", "ok", None, None, None, None, None)]), (7, 2, "user", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    row = chat.format_chats(frame).first()
    assert row["formatted"].startswith("<|turn|>user<|text|>see <\\|image|><|image|><|audio|><|document|><|image|><|end|>\n")
    assert [(a["turn"], a["ordinal"], a["kind"], a["ref"], a["tokens"]) for a in row["attachments"]] == [(0, 0, "image", "a.png", 4), (0, 1, "audio", "b.wav", 50), (0, 2, "document", "c.pdf", 1024), (0, 3, "image", None, 256)]
    turns = chat.format_chats(frame).select(chat.read_turns(F.col("formatted")).alias("t")).first()["t"]
    assert [t["text"] for t in turns] == ["see <|image|>", "ok", ""]


def test_query_against_plain_python(spark, sf):
    from lectern.llm.queries import op1_chat

    rows = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    by = {-1: [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]}
    for r in rows:
        by.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"] or ""))
    got = {r["conv_id"]: r for r in op1_chat(spark, sf).collect()}
    assert got.keys() == by.keys()
    for k, turns in by.items():
        turns.sort()
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert got[k]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest() and got[k]["n_turns"] == len(turns)
        assert got[k]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and got[k]["loss_chars"] == len(loss)


def test_control_strings_over_several_parts(spark):
    """Every control string cut at every place into two text parts, with media before, between other runs, and after."""
    none = (None,) * 5
    rows, want = [], []
    for i, c in enumerate(chat.CONTROL):
        for cut in range(1, len(c)):
            text = lambda s: ("text", s, *none)
            parts = [text("a\\"), text(c[:cut]), text(None), text(c[cut:]), ("image", None, f"{i}", None, None, None, None), text(c[:cut]), ("audio", None, "b", None, None, 1.0, None), text(c[cut:])]
            rows.append((100 * i + cut, 0, "user", parts))
            want.append((100 * i + cut, "a\\" + c + c, [("image", f"{i}"), ("audio", "b")]))
    done = chat.format_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>"))
    got = sorted((r["conv_id"], r["formatted"], r["t"], r["attachments"]) for r in done.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("t"), "attachments").collect())
    assert [(d, t[0]["text"], [(a["kind"], a["ref"]) for a in media]) for d, _, t, media in got if len(t) == 1] == want
    for _, formatted, _, _ in got:
        assert [formatted.count(c) for c in chat.CONTROL] == [1, 1, 1, 1, 1, 0] + [0] * 6
