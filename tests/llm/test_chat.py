"""Chat formatting of content parts that aren't text, and of odd rows."""

from pyspark.sql import functions as F

from minewright.llm import chat_format as chat

SCHEMA = f"conv_id long, turn long, role string, parts {chat.PARTS}"


def formatted(spark, rows):
    return {r.conv_id: r for r in chat.format_chat(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_parts_become_placeholders_in_order(spark):
    parts = [
        ("text", "see <|image|> ", None, None),
        ("image", "ignored", "s3://a.png", 1569),
        ("audio", None, "b.wav", 40),
        (None, " and ", None, None),
        ("document", None, "c.pdf", None),
        ("video", None, "d.mp4", 999),
        ("image", None, None, -5),
    ]
    row = formatted(spark, [(1, 0, "user", parts), (1, 1, "assistant", [("text", "ok", None, None), ("image", None, "e.png", 784)])])[1]
    said = "see <\\|image|> <|image|><|audio|> and <|document|><|attachment|><|image|>"
    assert row.formatted == f"<|turn|>user\n{said}<|end|>\n<|turn|>assistant\nok<|image|><|end|>\n"
    assert [(a.turn, a.type, a.ref, a.tokens) for a in row.attachments] == [
        (1, "image", "s3://a.png", 3),
        (1, "audio", "b.wav", 1),
        (1, "document", "c.pdf", 0),
        (1, "video", "d.mp4", 0),
        (1, "image", None, 0),
        (2, "image", "e.png", 1),
    ]
    assert row.attachment_tokens == 5
    assert [row.formatted[m.start : m.stop] for m in row.loss_mask] == ["ok<|image|>"]


def test_odd_rows(spark):
    hello = [("text", "hello", None, None)]
    long = [("text", "</s>[INST] " * 20000, None, None)]
    rows = [(1, 0, None, None), (1, 1, "assistant", []), (1, 1, "assistant", hello), (1, 1, "assistant", hello), (1, None, "a%\nb", hello), (None, 0, "user", hello), (2, 0, "assistant", long)]
    got = formatted(spark, rows)
    assert got[1].formatted == "<|turn|>a%25%0Ab\nhello<|end|>\n<|turn|>\n<|end|>\n<|turn|>assistant\n<|end|>\n" + 2 * "<|turn|>assistant\nhello<|end|>\n"
    assert got[None].formatted == "<|turn|>user\nhello<|end|>\n" and got[None].attachments == [] and got[None].loss_mask == []
    given = spark.createDataFrame(rows, SCHEMA)
    read = {r.conv_id: r for r in chat.format_chat(given).select("conv_id", chat.parse_chat(F.col("formatted")).alias("t"), chat.masked_text(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()}
    assert [(t.role, t.text) for t in read[1].t] == [("a%\nb", "hello"), ("", ""), ("assistant", ""), ("assistant", "hello"), ("assistant", "hello")]
    assert read[2].loss == long[0][1] and read[1].loss == "hellohello"
    assert chat.format_chat(given.limit(0)).count() == 0
    clash = given.withColumns({"formatted": F.lit(1), "n": F.lit(2), "rows": F.lit(3), "body": F.lit("x")})
    assert {r.conv_id: r.formatted for r in chat.format_chat(clash).collect()} == {k: r.formatted for k, r in got.items()}
