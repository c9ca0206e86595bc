"""Chat formatting of typed content parts, in DataFrame functions alone.

A visitor flattens each turn's parts in order: text is escaped and kept, and
each image, audio or document part becomes a placeholder, with its reference
and expanded token count recorded. A turn is written

    <|turn|>ROLE newline TEXT <|end|> newline        (without the blanks)

Control strings inside texts are broken up by a backslash behind their first
character: "<|" becomes "<\\|", "[INST]" becomes "[\\INST]". Where a text
already holds such a broken string it gets one backslash more, so removing one
gives back every text. In roles, "%" and newlines are written as %25 and %0A
besides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>"
# What follows the first character of a control string.
_TAILS = r"(\||/?s>|/?INST\])"
ESCAPE = (r"([<\[])(\\*)" + _TAILS, r"$1$2\\$3")
UNESCAPE = (r"([<\[])(\\*)\\" + _TAILS, "$1$2$3")
#: Units of a part's size for each token it expands to: pixels, milliseconds, bytes.
UNITS_PER_TOKEN = {"image": 784, "audio": 40, "document": 4}
PARTS = "array<struct<type:string,text:string,ref:string,size:bigint>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, *ESCAPE)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, *UNESCAPE)


def text_part(text: Column) -> Column:
    """A plain text as content parts."""
    return F.array(
        F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("size"))
    )


def visit(part: Column) -> Column:
    """What a part is written as: a text escaped, anything else a placeholder of its type."""
    kind = F.coalesce(part["type"], F.lit("text"))
    known = kind.isin(*UNITS_PER_TOKEN)
    holder = F.concat(F.lit("<|"), F.when(known, kind).otherwise("attachment"), F.lit("|>"))
    return F.when(kind == "text", escape(F.coalesce(part["text"], F.lit("")))).otherwise(holder)


def expanded(part: Column) -> Column:
    """Tokens that a placeholder stands for; 0 for unknown types and sizes."""
    tokens = F.lit(0).cast("bigint")
    for kind, units in UNITS_PER_TOKEN.items():
        tokens = F.when(part["type"] == kind, F.ceil(F.coalesce(part["size"], F.lit(0)) / units)).otherwise(tokens)
    return F.greatest(tokens, F.lit(0).cast("bigint"))


def format_chat(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Write each conversation of turns (conv_id, turn, role, parts) as one text.

    Returns conv_id; formatted; loss_mask, the code point ranges [start, stop)
    of the texts of loss_role in order; attachments (turn order, type, ref,
    tokens) in order; and attachment_tokens, their sum.

    Null roles, parts and texts are empty. Turns come in the order of turn
    (null first); equal turns by role, then text, and repeated rows all count.
    A null conv_id is a conversation of its own. Other columns are not read;
    an empty table gives no rows. One shuffle by conv_id; a conversation's
    own turns must fit a task, as its formatted text does.
    """
    role = F.coalesce("role", F.lit(""))
    header = escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))
    parts = F.coalesce("parts", F.array().cast(PARTS))
    body = F.concat_ws("", F.transform(parts, visit))
    flat = turns.select("conv_id", "turn", role.alias("role"), parts.alias("parts"), F.concat(F.lit(TURN), header, F.lit("\n")).alias("head"), body.alias("body"))
    flat = flat.withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    flat = flat.withColumn("n", F.row_number().over(order))
    before = F.coalesce(F.sum(F.length("piece").cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint"))
    start = before + F.length("head")
    extra = F.transform(
        F.filter("parts", lambda p: F.coalesce(p["type"], F.lit("text")) != "text"),
        lambda p: F.struct(F.col("n").alias("turn"), p["type"].alias("type"), p["ref"].alias("ref"), expanded(p).alias("tokens")),
    )
    flat = flat.select("conv_id", "n", "piece", (F.col("role") == loss_role).alias("learn"), start.alias("start"), (start + F.length("body")).alias("stop"), extra.alias("extra"))
    rows = flat.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", "piece", "learn", "start", "stop", "extra"))).alias("rows"))
    mask = F.transform(F.filter("rows", lambda r: r["learn"]), lambda r: F.struct(r["start"].alias("start"), r["stop"].alias("stop")))
    out = rows.select(
        "conv_id",
        F.concat_ws("", F.transform("rows", lambda r: r["piece"])).alias("formatted"),
        mask.alias("loss_mask"),
        F.flatten(F.transform("rows", lambda r: r["extra"])).alias("attachments"),
    )
    return out.withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda a, x: a + x["tokens"]))


def parse_chat(formatted: Column) -> Column:
    """The turns of a formatted text: array of (role, text), escapes undone."""
    pieces = F.split(formatted, r"<\|turn\|>")
    bodies = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.substring_index(p, END, 1))

    def turn(body: Column) -> Column:
        head = F.substring_index(body, "\n", 1)
        role = F.replace(F.replace(unescape(head), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))
        return F.struct(role.alias("role"), unescape(F.substr(body, F.length(head) + 2)).alias("text"))

    return F.transform(bodies, turn)


def masked_text(formatted: Column, mask: Column) -> Column:
    """The text under a loss mask, escapes undone."""
    return F.concat_ws("", F.transform(mask, lambda m: unescape(F.substr(formatted, (m["start"] + 1).cast("int"), (m["stop"] - m["start"]).cast("int")))))


def digest(chats: DataFrame) -> DataFrame:
    """The columns of the contract, read back from formatted texts."""
    read = chats.select("conv_id", "formatted", parse_chat(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -1: both of its turns consist of control strings."""
    return spark.sql(
        "select cast(c as bigint) conv_id, cast(t as bigint) turn, r role, '</s>[INST] ok [/INST]' text "
        "from values (-1, 0, 'user'), (-1, 1, 'assistant') as v(c, t, r)"
    )


ORACLE = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\2\\\3', 'g') as body from c)
select conv_id,
  count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, body)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, body) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(length(role) + length(body) + 17)::bigint as formatted_chars
from e group by conv_id
"""
