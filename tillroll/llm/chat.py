"""Chat formatting with typed content parts, in DataFrame operations only.

A message has a list of parts, each with a type, a text, a reference and a number of tokens. The
visitor goes through the parts in order: a text part gives its text, an image, audio or document part
gives as many placeholders as it takes tokens and is recorded with its reference. Texts that follow
each other are escaped together.

    <|turn|>role<|says|>text...<|end|>

Escaping puts one backslash behind the first character of whatever looks like a control string, with
any number of backslashes there already. That adds one backslash to each such place and nothing else,
so taking one away restores the text, also one that held escaped text before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import sha256

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
# control strings of this and other templates: <|...|>, <s>, </s>, [INST], [/INST]
CONTROL = r"(\||/?s>|/?INST\])"
PART = "struct<type:string,text:string,ref:string,n_tokens:int>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + CONTROL, "$1$2$3")


def text_part(text: Column) -> Column:
    """The parts of a message that is only a text; null is the empty text."""
    none = F.lit(None).cast("string")
    part = F.struct(
        F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), none.alias("ref"),
        F.lit(0).alias("n_tokens"),
    )
    return F.array(part.cast(PART))


def _marks(part: Column) -> Column:
    """The placeholders of a part, none if it takes no tokens; null for a text. An unknown type is text."""
    marks = F.lit(None).cast("string")
    for kind, mark in PLACEHOLDERS.items():
        shown = F.repeat(F.lit(mark), F.greatest(F.coalesce(part["n_tokens"], F.lit(1)), F.lit(0)))
        marks = F.when(part["type"] == kind, shown).otherwise(marks)
    return marks


def _visit(parts: Column) -> Column:
    """What the parts become in the text of their turn.

    A run of texts without placeholders between them is escaped as one text, so that parts can't make a
    control string together. Placeholders neither begin nor end with what such a string could go on with.
    """
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("run"))

    def step(acc: Column, part: Column) -> Column:
        marks = _marks(part)
        longer = F.concat(acc["run"], F.coalesce(part["text"], F.lit("")))
        closed = F.concat(acc["done"], escape(acc["run"]), marks)
        shown = F.coalesce(marks, F.lit("")) != ""
        done = F.when(shown, closed).otherwise(acc["done"])
        run = F.when(shown, F.lit("")).when(marks.isNull(), longer).otherwise(acc["run"])
        return F.struct(done.alias("done"), run.alias("run"))

    return F.aggregate(parts, start, step, lambda acc: F.concat(acc["done"], escape(acc["run"])))


def format_turns(messages: DataFrame) -> DataFrame:
    """Columns conv_id, turn, role, parts -> conv_id, turn, role, body and attachments."""
    attached = F.filter("parts", lambda p: F.coalesce(p["type"], F.lit("text")).isin(list(PLACEHOLDERS)))
    record = F.transform(
        attached,
        lambda p, i: F.struct(
            i.alias("nr"), p["type"].alias("type"), p["ref"].alias("ref"),
            F.greatest(F.coalesce(p["n_tokens"], F.lit(1)), F.lit(0)).alias("n_tokens"),
        ),
    )
    parts = F.coalesce("parts", F.array().cast(f"array<{PART}>"))
    return messages.withColumn("parts", parts).select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
        _visit(F.col("parts")).alias("body"),
        record.alias("attachments"),
    )


def format_chats(messages: DataFrame, trained: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, spans, attachments.

    `messages` has conv_id, turn, role and parts (or text, if it has no parts). Turns are in the order
    of turn, then role, then text; a null turn comes first, a repeated row is one more turn, a null
    role is the empty role, and rows without conv_id are one conversation. spans are the code points
    (from 0, length) of the texts of the role `trained`, which are under the loss mask. No rows give no
    conversation. Other columns don't matter.

    A conversation is one output row, so its turns meet in one task; rows of a hot conversation are as
    many as that row has to hold.
    """
    if "parts" not in messages.columns:
        messages = messages.withColumn("parts", text_part(F.col("text")))
    turns = format_turns(messages).withColumn("head", F.concat(F.lit(TURN), escape("role"), F.lit(SAYS)))
    row = F.struct("turn", "role", "body", "head", "attachments")
    # the lengths are counted before the shuffle, so that spans are sums over small numbers
    row = row.withField("n_head", F.char_length("head")).withField("n_body", F.char_length("body"))
    chats = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("t"))
    formatted = F.array_join(
        F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(END))), ""
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:int>>").alias("s"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["n_head"]
        span = F.array(F.struct(begin.alias("start"), x["n_body"].alias("length")))
        spans = F.when(x["role"] == trained, F.concat(acc["s"], span)).otherwise(acc["s"])
        return F.struct((begin + x["n_body"] + len(END)).alias("at"), spans.alias("s"))

    attachments = F.flatten(
        F.transform("t", lambda x, i: F.transform(
            x["attachments"],
            lambda a: F.struct(i.alias("turn_nr"), a["nr"].alias("nr"), a["type"].alias("type"),
                               a["ref"].alias("ref"), a["n_tokens"].alias("n_tokens")),
        ))
    )
    return chats.select(
        "conv_id", formatted.alias("formatted"),
        F.aggregate("t", start, step, lambda acc: acc["s"]).alias("spans"),
        attachments.alias("attachments"),
    )


def read_chats(chats: DataFrame) -> DataFrame:
    """conv_id, turns (array of role and text) and loss_text, read back from formatted and spans."""
    bodies = F.filter(F.split("formatted", r"<\|turn\|>", -1), lambda b, i: i > 0)
    parts = F.transform(bodies, lambda b: F.split(F.substring_index(b, END, 1), r"<\|says\|>", 2))
    turns = F.transform(
        parts, lambda p: F.struct(unescape(p[0]).alias("role"), unescape(p[1]).alias("text"))
    )
    masked = F.transform(
        "spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"]))
    )
    return chats.select(
        "conv_id", "formatted", turns.alias("turns"), F.array_join(masked, "").alias("loss_text")
    )


def chat_digests(read: DataFrame) -> DataFrame:
    """Counts and hashes of what was read back."""
    joined = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        sha256(joined).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        sha256(F.col("loss_text")).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
