"""Chat formatting by a grammar round trip, as DataFrame expressions only.

Grammar of a formatted conversation: turns one after another, each

    ### MARK ROLE : NEWLINE BODY </turn> NEWLINE

with a blank as MARK for a body that stands as it is and a backslash for an escaped one. The parser cuts at ``</turn>`` and the
first newline, so it is deterministic as long as no body and no role holds a control string. Escaping doubles
backslashes and puts one into each control string: ``</turn>`` becomes ``<\\/turn>`` and ``##`` becomes ``#\\#``.

Round trip: a conversation is rendered with plain bodies and parsed again. Where the recovered turns differ from the
source, or a text holds a control string that a reader could take for markup, the conflicting bodies are escaped and the
conversation is rendered and parsed again; where that is still not identical, every body is escaped. The result is read
back from the text alone: roles, texts, and the loss mask, which covers the bodies of assistant turns.

Edge cases: a null text or role is empty; turns are ordered by (turn, role, text), so repeated turns stand side by side and
ties are harmless; rows with a null conversation id form one conversation; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "</turn>\n"


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("</turn>"), F.lit("<\\/turn>")), F.lit("##"), F.lit("#\\#"))


def unescape(c: Column) -> Column:
    # doubled backslashes are set aside first, under a character that no escaped text holds next to a backslash
    parts = F.split(c, r"\\\\", -1)
    undo = F.transform(parts, lambda x: F.replace(F.replace(x, F.lit("<\\/turn>"), F.lit("</turn>")), F.lit("#\\#"), F.lit("##")))
    return F.array_join(undo, "\\")


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("\\n"))


def unescape_role(c: Column) -> Column:
    parts = F.split(c, r"\\\\", -1)
    undo = F.transform(parts, lambda x: F.replace(F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("<\\/turn>"), F.lit("</turn>")), F.lit("#\\#"), F.lit("##")))
    return F.array_join(undo, "\\")


def render(turns: Column, level: int) -> Column:
    """Formatted text of an array of (role, text). level 0: plain bodies; 1: bodies with control strings escaped; 2: all."""

    def one(t):
        hard = F.lit(level == 2) if level != 1 else t["text"].contains("</turn>") | t["text"].contains("###")
        role = escape_role(t["role"])
        return F.when(hard, F.concat(F.lit("###\\"), role, F.lit(":\n"), escape(t["text"]), F.lit(END))).otherwise(F.concat(F.lit("### "), role, F.lit(":\n"), t["text"], F.lit(END)))

    return F.array_join(F.transform(turns, one), "")


def _segments(text: Column) -> Column:
    """Turns as written, without their end mark; what follows the last mark is empty and dropped."""
    s = F.split(text, END, -1)
    return F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))


def parse(text: Column) -> Column:
    """Array of (role, text, start, n): start and n of the written body, in characters of the formatted text from 0."""

    def one(seg):
        head = F.substring_index(seg, "\n", 1)
        body = F.substring(seg, F.length(head) + 2, F.length(seg))
        hard = head.startswith("###\\")
        role = F.substring(head, F.lit(5), F.length(head) - 5)
        return F.struct(unescape_role(role).alias("role"), F.when(hard, unescape(body)).otherwise(body).alias("text"), hard.alias("hard"), F.length(head).alias("h"), F.length(body).alias("n"))

    return F.transform(_segments(text), one)


def _fit(name: str, level: int):
    """Whether the parsed text gives the source turns again."""
    back = F.transform(parse(F.col(name)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    plain = back.eqNullSafe(F.col("turns"))
    if level == 0:
        plain = plain & ~F.exists("turns", lambda t: t["text"].contains("</turn>") | t["text"].contains("###"))
    return plain


def format_chats(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) to (conv_id, formatted), one row per conversation."""
    t = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    c = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(t)).alias("t"))
    c = c.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))
    c = c.withColumn("plain", render(F.col("turns"), 0)).withColumn("ok", _fit("plain", 0))
    c = c.withColumn("some", F.when(~F.col("ok"), render(F.col("turns"), 1))).withColumn("ok1", F.when(~F.col("ok"), _fit("some", 1)))
    return c.select("conv_id", F.when(F.col("ok"), F.col("plain")).when(F.col("ok1"), F.col("some")).otherwise(render(F.col("turns"), 2)).alias("formatted"))


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, turns, loss, formatted): the turns recovered from ``formatted``, and the loss mask as an array of
    (start, n, hard) spans of written characters, which are the bodies of assistant turns."""
    c = chats.withColumn("p", parse(F.col("formatted")))
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,n:int,hard:boolean>>)").alias("spans"))

    def step(a, x):
        start = a["at"] + x["h"] + 1
        span = F.array(F.struct(start.alias("start"), x["n"].alias("n"), x["hard"].alias("hard")))
        return F.struct((start + x["n"] + len(END)).alias("at"), F.when(F.lower(x["role"]) == "assistant", F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    return c.select("conv_id", F.transform("p", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"), F.aggregate("p", zero, step)["spans"].alias("loss"), "formatted")


def digests(back: DataFrame) -> DataFrame:
    """The digest columns of the registered query, all derived from the formatted text."""
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")

    def text(s):
        written = F.substring(F.col("formatted"), s["start"] + 1, s["n"])
        return F.when(s["hard"], unescape(written)).otherwise(written)

    b = back.withColumn("loss_text", F.array_join(F.transform("loss", text), ""))
    return b.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
