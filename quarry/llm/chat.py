"""Chat formatting with typed content parts.

A turn's content is a list of parts: text, image, audio or document. A visitor over the parts flattens them, in
order, to one string: text is escaped, every other part becomes a numbered placeholder, and an attachment record
keeps its kind, reference, place and expanded token count. Turns are framed by control strings that no escaped
text can contain, so the formatted string can be parsed back to exactly the turns that went in.

Edge cases: null text is empty, a null role is the empty role; parts of an unknown kind or a null part are kept as
``unknown`` placeholders of no tokens; a conversation's rows are ordered by turn (nulls first), then role, then text,
so repeated rows and tied turns have a defined order; a null conv_id is a conversation of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Control strings of this template and of other common ones, none of which may appear in a text.
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
CONTROLS = ["<|", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]"]
# Tokens that one attachment expands to, by unit (tile, second, page).
PART_TOKENS = {"image": 256, "audio": 25, "document": 800}

PART_TYPE = "struct<kind:string,text:string,ref:string,units:int>"


def escape(text: Column) -> Column:
    """Ampersands first, then the first character of each control string; ``unescape`` undoes it exactly."""
    text = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for c in CONTROLS:
        text = F.replace(text, F.lit(c), F.lit(f"&#{ord(c[0])};{c[1:]}"))
    return text


def unescape(text: Column) -> Column:
    for code in dict.fromkeys(ord(c[0]) for c in CONTROLS):
        text = F.replace(text, F.lit(f"&#{code};"), F.lit(chr(code)))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def text_parts(text: Column) -> Column:
    """One text part: what a plain text column holds."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"),
                            F.lit(None).cast("string").alias("ref"), F.lit(0).alias("units")))


def _tokens(part: Column) -> Column:
    n = F.lit(0)
    for kind, each in PART_TOKENS.items():
        n = F.when(part["kind"] == kind, F.greatest(F.coalesce(part["units"], F.lit(1)), F.lit(1)) * each).otherwise(n)
    return n


def _visit(parts: Column) -> Column:
    """The parts of one turn, flattened: text escaped, other kinds as placeholders numbered inside the turn."""
    known = F.lit(list(PART_TOKENS))

    def one(part: Column, i: Column) -> Column:
        kind = F.when(F.array_contains(known, part["kind"]), part["kind"]).otherwise(F.lit("unknown"))
        place = F.concat(F.lit("<|"), kind, F.lit(":"), i.cast("string"), F.lit("|>"))
        return F.when(part["kind"] == "text", escape(F.coalesce(part["text"], F.lit("")))).otherwise(place)

    return F.array_join(F.transform(parts, one), "")


def _attachments(parts: Column, turn_no: Column) -> Column:
    found = F.transform(parts, lambda p, i: F.struct(
        turn_no.alias("turn_no"), i.alias("part_no"), p["kind"].alias("kind"), p["ref"].alias("ref"), _tokens(p).alias("tokens")))
    return F.filter(found, lambda a: ~a["kind"].eqNullSafe("text"))


def format_chats(turns: DataFrame, parts_col: str | None = None, trained_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """A row per conversation: conv_id, formatted, loss_spans (array of start, length in code points of the
    trained turns' bodies), attachments, attachment_tokens. turns: conv_id, turn, role and text, or an array of
    parts (``PART_TYPE``) in parts_col."""
    parts = F.coalesce(F.col(parts_col), F.array().cast(f"array<{PART_TYPE}>")) if parts_col else text_parts(F.col("text"))
    rows = turns.select("conv_id", F.col("turn").alias("t"), F.coalesce("role", F.lit("")).alias("r"), parts.alias("p"))
    # Tied turns are ordered by their text as it came in, not as it is escaped.
    raw = F.array_join(F.transform("p", lambda p: F.coalesce(p["text"], F.lit(""))), "")
    rows = rows.select("conv_id", F.struct("t", "r", raw.alias("raw"), _visit(F.col("p")).alias("body"), "p").alias("s"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("s")).alias("s"))
    # Each turn as (head, body, tail); then lengths give the places of the bodies.
    pieces = F.transform("s", lambda s: F.struct(
        F.concat(F.lit(TURN), escape(s["r"]), F.lit(BODY)).alias("head"), s["body"].alias("body"), s["r"].alias("r")))
    chats = chats.select("conv_id", "s", pieces.alias("x"))
    size = lambda x: F.length(x["head"]) + F.length(x["body"]) + len(END)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    folded = F.aggregate("x", start, lambda acc, x: F.struct(
        (acc["at"] + size(x)).alias("at"),
        F.when(x["r"].isin(*trained_roles), F.concat(acc["spans"], F.array(F.struct(
            (acc["at"] + F.length(x["head"])).alias("start"), F.length(x["body"]).alias("length")))))
        .otherwise(acc["spans"]).alias("spans")))
    attachments = F.flatten(F.transform("s", lambda s, i: _attachments(s["p"], i)))
    return chats.select(
        "conv_id",
        F.array_join(F.transform("x", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "").alias("formatted"),
        folded["spans"].alias("loss_spans"),
        attachments.alias("attachments"),
    ).withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def parse_chats(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted string; placeholders stay in the text."""
    turns = F.slice(F.split(formatted, r"<\|turn\|>"), 2, 1 << 30)

    def one(t: Column) -> Column:
        body = F.substring_index(t, BODY, -1)
        return F.struct(unescape(F.substring_index(t, BODY, 1)).alias("role"),
                        unescape(F.left(body, F.length(body) - len(END))).alias("text"))

    return F.transform(turns, one)


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")
