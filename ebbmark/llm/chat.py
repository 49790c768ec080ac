"""Chat formatting over typed content parts, in DataFrame functions alone.

A turn's content is an array of parts of kind text, image, audio or document (PART). Flattening visits them in order: text
is escaped and copied, any other part leaves a placeholder `<|kind:t.p|>`, t being the turn's place in the conversation and
p the part's place in the turn (from 0), and an attachment record with the same place, its reference and the number of
tokens that it expands to. Attachments are numbered in order.

Template of a turn: `<|turn|>` role `<|says|>` content `<|end|>`. Every control string begins with `<|`. Escaping puts a
backslash behind every `<` of a text or role, and unescaping takes it away again. What stands behind a `<` of a text is so
always a backslash, whatever the next part begins with: no text holds a control string, and none grows over the boundary of
two parts.

Null or empty content gives an empty text, a null role an empty role, a part of null or unknown kind is a document. Turns
are in order of turn, null first; rows of one turn are in order of role, then content, and repeated rows all stay. Rows with
a null conversation id form one conversation. No rows give no rows. Other columns are ignored. A conversation is one row, so
it must fit a task's memory; all steps are linear in its text, whatever its number of parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: An image expands to a token for each square of so many pixels a side, audio and documents to so many for a second and a page; at least 1.
PIXELS, A_SECOND, A_PAGE = 28, 25, 600


def text_part(text: Column) -> Column:
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]))


def escape(text: Column) -> Column:
    return F.replace(text, F.lit("<"), F.lit("<\\"))


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit("<\\"), F.lit("<"))


def part_tokens(part: Column) -> Column:
    squares = F.ceil(F.coalesce(part["width"], F.lit(0)) / PIXELS) * F.ceil(F.coalesce(part["height"], F.lit(0)) / PIXELS)
    sound = F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * A_SECOND)
    pages = F.coalesce(part["pages"], F.lit(0)).cast("long") * A_PAGE
    return F.greatest(F.lit(1).cast("long"), F.when(part["kind"] == "image", squares).when(part["kind"] == "audio", sound).otherwise(pages).cast("long"))


def _kind(part: Column) -> Column:
    return F.when(part["kind"].isin("text", "image", "audio"), part["kind"]).otherwise(F.lit("document"))


def _shown(part: Column, turn: Column, place: Column) -> Column:
    """What a part leaves in the text."""
    placeholder = F.concat(F.lit("<|"), _kind(part), F.lit(":"), turn.cast("string"), F.lit("."), place.cast("string"), F.lit("|>"))
    return F.when(_kind(part) == "text", escape(F.coalesce(part["text"], F.lit("")))).otherwise(placeholder)


def _attachments(turn: Column, number: Column) -> Column:
    """Records of a turn's parts other than texts."""
    records = F.transform(turn["parts"], lambda p, k: F.struct(number.alias("turn"), k.alias("part"), _kind(p).alias("kind"), p["ref"].alias("ref"), part_tokens(p).alias("tokens")))
    return F.filter(records, lambda r: r["kind"] != "text")


def format_chats(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """One row per conversation: conv, n_turns, formatted, loss (array of start and length in characters: the content of each assistant turn), attachments (n, turn, part, kind, ref, tokens), attachment_tokens."""
    content = F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>"))
    turns = rows.select(F.col(conv).alias("conv"), F.struct(F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), content.alias("parts")).alias("t"))
    grouped = turns.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    flat = F.transform("turns", lambda t, k: F.struct(t["role"].alias("role"), escape(t["role"]).alias("head"), F.array_join(F.transform(t["parts"], lambda p, j: _shown(p, k, j)), "").alias("content")))
    done = grouped.withColumn("flat", flat)
    pieces = F.transform("flat", lambda t: F.concat(F.lit(TURN), t["head"], F.lit(SAYS), t["content"], F.lit(END)))
    # Where a turn's content starts: numbers alone are summed up from turn to turn.
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss"))

    def step(a: Column, t: Column) -> Column:
        start, length = a["at"] + F.length(t["head"]) + len(TURN + SAYS), F.length(t["content"])
        span = F.array(F.struct(start.alias("start"), length.alias("length")))
        return F.struct((start + length + len(END)).alias("at"), F.when(t["role"] == "assistant", F.concat(a["loss"], span)).otherwise(a["loss"]).alias("loss"))

    records = F.flatten(F.transform("turns", lambda t, k: _attachments(t, k)))
    attachments = F.transform(records, lambda r, n: F.struct(n.alias("n"), r["turn"].alias("turn"), r["part"].alias("part"), r["kind"].alias("kind"), r["ref"].alias("ref"), r["tokens"].alias("tokens")))
    out = done.select(
        F.col("conv").alias(conv), F.size("turns").cast("long").alias("n_turns"), F.array_join(pieces, "").alias("formatted"),
        F.aggregate("flat", begin, step, lambda a: a["loss"]).alias("loss"), attachments.alias("attachments"),
    )
    return out.withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))


def _parts(content: Column) -> Column:
    """(kind, text, place) of a content as it was written: place is t.p of an attachment, null for a text; texts that stood side by side are one."""
    mark = r"^<\|(image|audio|document):(\d+\.\d+)\|>"
    nothing = F.lit(None).cast("string")
    text = lambda x: F.struct(F.lit("text").alias("kind"), unescape(x).alias("text"), nothing.alias("place"))
    other = lambda x: F.struct(F.regexp_extract(x, mark, 1).alias("kind"), nothing.alias("text"), F.regexp_extract(x, mark, 2).alias("place"))
    split = F.transform(F.split(content, r"(?=<\|)", -1), lambda x: F.when(x.startswith("<|"), F.array(other(x), text(F.regexp_replace(x, mark, "")))).otherwise(F.array(text(x))))
    return F.filter(F.flatten(split), lambda p: (p["kind"] != "text") | (p["text"] != ""))


def read_chats(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """From format_chats' output alone: conv, turns (role, content: the texts as they were before, with placeholders; parts: kind, text, place), and spoken, the unescaped texts under the loss mask in order."""
    pieces = F.filter(F.split("formatted", r"<\|turn\|>", -1), lambda _, k: k > 0)
    body = lambda p: F.regexp_replace(p, r"<\|end\|>$", "")
    side = lambda p, k: F.element_at(F.split(body(p), r"<\|says\|>", 2), k)
    turns = F.transform(pieces, lambda p: F.struct(unescape(side(p, 1)).alias("role"), unescape(side(p, 2)).alias("content"), _parts(side(p, 2)).alias("parts")))
    spoken = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return formatted.select(conv, "formatted", turns.alias("turns"), spoken.alias("spoken"))
