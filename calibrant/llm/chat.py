"""Chat formatting with typed content parts.

A message holds ordered parts (text, image, audio, document). A visitor, one SQL expression per part type,
turns each part into a placeholder or escaped text, records what is attached and counts the tokens that the
placeholder expands to. Everything is a DataFrame expression; a conversation's rows meet once, in the one
shuffle by its id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from calibrant.llm.common import filled, need

#: Part struct of the operator's input.
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


@dataclass(frozen=True)
class Template:
    """Marks of a turn. A control string inside a text gets a backslash after its first character; a
    backslash is doubled first, so that unescaping (drop each backslash, keep what follows) is exact."""

    turn: str = "<s>[INST] "
    body: str = " [/INST] "
    end: str = "</s>"
    control: str = r"(<|\[)(?=/?s>|/?INST\]|\|(?:image|audio|document)(?::\d+)?\|>)"
    patch: int = 28  # pixels of a side of an image patch; one token a patch
    audio_rate: float = 12.5  # tokens a second of sound
    page_tokens: int = 256  # tokens a page of a document


def escape(c: Column, t: Template) -> Column:
    doubled = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, t.control, "$1\\\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def visit(part: Column, t: Template) -> Column:
    """What one part becomes: struct(out, kind, ref, tokens); kind is null for text.

    Unknown types and null parts become empty text; negative or null sizes count as 0.
    """
    size = lambda name: F.greatest(F.coalesce(part[name].cast("double"), F.lit(0.0)), F.lit(0.0))
    kind = F.when(part["type"].isin("image", "audio", "document"), part["type"])
    tokens = (
        F.when(kind == "image", F.ceil(size("width") / t.patch) * F.ceil(size("height") / t.patch))
        .when(kind == "audio", F.ceil(size("seconds") * t.audio_rate))
        .when(kind == "document", F.ceil(size("pages")) * t.page_tokens)
    )
    text = F.when(part["type"] == "text", escape(filled(part["text"]), t)).otherwise("")
    return F.struct(
        F.when(kind.isNotNull(), F.concat(F.lit("<|"), kind, F.lit("|>"))).otherwise(text).alias("out"),
        kind.alias("kind"),
        F.when(kind.isNotNull(), part["ref"]).alias("ref"),
        tokens.cast("long").alias("tokens"),
    )


def format_chats(turns: DataFrame, template: Template = Template(), loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_spans (code point start and length of each
    text under the loss mask), attachments (ordinal, kind, ref, tokens), expanded_tokens.

    ``turns`` has conv_id, turn, role and either parts (``array<PART>``) or text. Null role, text or parts:
    empty. Rows are ordered by turn (null first), then role, then content, so repeated rows are repeated
    turns in a fixed place. A null conv_id is a conversation of its own. No rows: no rows. Other columns of
    the input are dropped. A conversation must fit in one string (2 GB).
    """
    t = template
    if "parts" in turns.columns:
        parts = F.coalesce(F.col("parts").cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>"))
        base = need(turns, "conv_id", "turn", "role", "parts").select("conv_id", "turn", filled("role").alias("role"), F.transform(parts, lambda p: visit(p, t)).alias("seen"))
    else:
        base = need(turns, "conv_id", "turn", "role", "text").select(
            "conv_id", "turn", filled("role").alias("role"),
            F.array(visit(F.struct(F.lit("text").alias("type"), F.col("text"), *[F.lit(None).cast(k).alias(n) for n, k in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]), t)).alias("seen"),
        )
    base = base.select(
        "conv_id", "turn", "role",
        F.concat(F.lit(t.turn), escape(F.col("role"), t), F.lit(t.body)).alias("head"),
        F.array_join(F.transform("seen", lambda p: p["out"]), "").alias("body"),
        F.transform(F.filter("seen", lambda p: p["kind"].isNotNull()), lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens"))).alias("attached"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    piece = F.concat("head", "body", F.lit(t.end))
    placed = base.select(
        "conv_id", piece.alias("piece"),
        F.coalesce(F.sum(F.char_length(piece)).over(before), F.lit(0)).alias("at"),
        F.char_length("head").alias("head_chars"), F.char_length("body").alias("body_chars"),
        (F.col("role") == loss_role).alias("learn"), "attached",
    )
    rows = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "piece", "head_chars", "body_chars", "learn", "attached"))).alias("r"))
    attached = F.flatten(F.transform("r", lambda x: x["attached"]))
    return rows.select(
        "conv_id",
        F.size("r").cast("long").alias("n_turns"),
        F.array_join(F.transform("r", lambda x: x["piece"]), "").alias("formatted"),
        F.transform(F.filter("r", lambda x: x["learn"]), lambda x: F.struct((x["at"] + x["head_chars"]).alias("start"), x["body_chars"].alias("length"))).alias("loss_spans"),
        F.transform(attached, lambda a, i: F.struct((i + 1).alias("ordinal"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))).alias("attachments"),
        F.aggregate(attached, F.lit(0).cast("long"), lambda s, a: s + a["tokens"]).alias("expanded_tokens"),
    )


def read_back(chats: DataFrame, template: Template = Template()) -> DataFrame:
    """Parse formatted conversations again: conv_id, turns (array of role and text, unescaped, placeholders
    kept), loss (all text under the mask, unescaped and joined), formatted."""
    t = template
    pieces = F.filter(F.split("formatted", f"\\Q{t.end}\\E"), lambda p: p != "")  # the end mark never occurs in escaped text
    turn = lambda p: F.struct(
        unescape(F.substring_index(F.substr(p, F.lit(len(t.turn) + 1)), t.body, 1)).alias("role"),
        unescape(F.substr(p, F.locate(t.body, p) + len(t.body))).alias("text"),
    )
    span = lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))
    return chats.select("conv_id", F.transform(pieces, turn).alias("turns"), F.array_join(F.transform("loss_spans", span), "").alias("loss"), "formatted")


def op3_chat(turns: DataFrame) -> DataFrame:
    """The contract's digest of what :func:`read_back` finds."""
    back = read_back(format_chats(turns))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
