"""Chat formatting [native].

A turn has a role and typed content parts. A visitor flattens the parts in order: texts are
escaped and kept, image, audio and document parts become placeholders whose references and
expanded token counts are recorded; the parts that a document holds follow its placeholder.
The template marks turns by control strings, all of which start with `<|`. Inside texts `\\`
is written `\\\\`, `<|` is written `<\\|`, and a `|` that begins a later part of a turn is
written `\\|`, so that no text, nor two texts side by side, can forge one; this is reversible.

A conversation is dealt by range over (conversation, turn), so that even one conversation with
a third of all rows is formatted by many tasks. The output has a row per conversation and
chunk of at most CHUNK turns: its text, the spans of the loss mask (code points from the
chunk's start), the attachments. A conversation's text is its chunks' texts in order. The mask
covers the texts of the trained role's turns, a span for each part, and no placeholder.

Defined results: null text or parts are empty, null role is the empty role, a null
conversation id is a conversation; rows that share a turn are ordered by role, then parts;
repeated rows are kept; an unknown or null part kind is shown as a placeholder of its own
name with 0 tokens; null sizes count 0 tokens; an empty table gives no rows; extra columns
are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
CHUNK = 256
PATCH = 14  # pixels of an image patch, one token each after merging 2 x 2 patches
AUDIO_RATE = 25  # tokens a second
PAGE_TOKENS = 256  # tokens a document page

LEAF = "kind string, text string, uri string, width int, height int, seconds double, pages int"
PART = f"struct<kind: string, text: string, uri: string, width: int, height: int, seconds: double, pages: int, inner: array<struct<{', '.join(x.replace(' ', ': ', 1) for x in LEAF.split(', '))}>>>"


def escape(text: Column) -> Column:
    t = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(t, F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_part(text: Column) -> Column:
    """A turn's parts when all it has is a text."""
    none = [F.lit(None).cast(t) for t in ("string", "int", "int", "double", "int")]
    names = ("uri", "width", "height", "seconds", "pages")
    inner = F.from_json(F.lit(None).cast("string"), f"array<{PART.replace(', inner: array<', '|').split('|')[0]}>>")
    return F.array(
        F.struct(F.lit("text").alias("kind"), text.alias("text"), *(c.alias(n) for c, n in zip(none, names, strict=True)), inner.alias("inner")).cast(PART)
    )


def _tokens(p: Column) -> Column:
    side = lambda n: F.ceil(F.coalesce(n, F.lit(0)) / (2 * PATCH))
    return (
        F.when(p["kind"] == "image", side(p["width"]) * side(p["height"]))
        .when(p["kind"] == "audio", F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * AUDIO_RATE))
        .when(p["kind"] == "document", F.coalesce(p["pages"], F.lit(0)) * PAGE_TOKENS)
        .otherwise(F.lit(0))
        .cast("long")
    )


def _flat(parts: Column) -> Column:
    """Parts and what they hold, in order, as one flat array of (kind, text, uri, tokens)."""
    leaf = lambda p: F.struct(p["kind"].alias("kind"), p["text"].alias("text"), p["uri"].alias("uri"), _tokens(p).alias("tokens"))
    none = F.array().cast("array<struct<kind: string, text: string, uri: string, tokens: bigint>>")
    return F.flatten(
        F.transform(F.filter(parts, lambda p: p.isNotNull()), lambda p: F.concat(
            F.array(leaf(p)), F.coalesce(F.transform(F.filter(p["inner"], lambda x: x.isNotNull()), leaf), none)
        ))
    )


def _shown(x: Column, i: Column) -> Column:
    """A part as it is written, and whether it is a text."""
    name = F.regexp_replace(F.coalesce(x["kind"], F.lit("none")), r"[^A-Za-z0-9_]", "_")
    text = escape(x["text"])
    text = F.when((i > 0) & text.startswith("|"), F.concat(F.lit("\\"), text)).otherwise(text)
    is_text = F.coalesce(x["kind"] == "text", F.lit(False))
    return F.struct(F.when(is_text, text).otherwise(F.concat(F.lit("<|at:"), name, F.lit("|>"))).alias("s"), is_text.alias("on"))


def format_chats(
    turns: DataFrame,
    *,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    parts_col: str = "parts",
    trained_role: str = "assistant",
    chunk: int = CHUNK,
) -> DataFrame:
    """(conv, piece, chunk, n_turns, text, loss_spans[start, length], attachments[turn, ordinal, kind, uri, tokens])."""
    flat = F.coalesce(_flat(F.col(parts_col)), F.array().cast("array<struct<kind: string, text: string, uri: string, tokens: bigint>>"))
    rows = turns.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.coalesce(role_col, F.lit("")).alias("role"),
        flat.alias("flat"),
    )
    rows = rows.select(
        "conv", "turn", "role",
        F.transform("flat", _shown).alias("body"),
        F.filter(F.transform("flat", lambda x, i: F.struct(i.alias("ordinal"), x["kind"].alias("kind"), x["uri"].alias("uri"), x["tokens"].alias("tokens"))),
                 lambda x: ~x["kind"].eqNullSafe("text")).alias("files"),
    )
    # Sorted within their range, turns are numbered where they are; each chunk is gathered by itself.
    order = ["conv", "turn", "role", "body"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order, "files").withColumn("at", F.monotonically_increasing_id())
    place = F.col("at").bitwiseAND((1 << 33) - 1)
    dealt = dealt.withColumn("piece", F.shiftright("at", 33).cast("int")).withColumn("chunk", F.floor(place / chunk).cast("int"))
    some = dealt.groupBy("conv", "piece", "chunk").agg(F.array_sort(F.collect_list(F.struct("at", "turn", "role", "body", "files"))).alias("t"))
    head = lambda t: F.concat(F.lit(TURN), escape(t["role"]), F.lit(BODY))
    on = lambda t, p: p["on"] & (t["role"] == trained_role)
    mark = lambda s, k: F.struct(s.alias("s"), k.alias("on"))
    said = lambda t: F.concat(
        F.array(mark(head(t), F.lit(False))), F.transform(t["body"], lambda p: mark(p["s"], on(t, p))), F.array(mark(F.lit(END), F.lit(False)))
    )
    some = some.withColumn("parts", F.flatten(F.transform("t", said)))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start: bigint, length: bigint>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        size = F.char_length(p["s"]).cast("long")
        spans = F.when(p["on"], F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("start"), size.alias("length"))))).otherwise(acc["spans"])
        return F.struct((acc["at"] + size).alias("at"), spans.alias("spans"))

    return some.select(
        "conv", "piece", "chunk",
        F.size("t").cast("long").alias("n_turns"),
        F.array_join(F.transform("parts", lambda p: p["s"]), "").alias("text"),
        F.aggregate("parts", start, step, lambda a: a["spans"]).alias("loss_spans"),
        F.flatten(F.transform("t", lambda t: F.transform(t["files"], lambda f: F.struct(
            t["turn"].alias("turn"), f["ordinal"].alias("ordinal"), f["kind"].alias("kind"), f["uri"].alias("uri"), f["tokens"].alias("tokens"))))).alias("attachments"),
    )


def read_back(chunks: DataFrame) -> DataFrame:
    """Parse the formatted chunks: (conv, piece, chunk, turns[role, text, parts], loss, chars).

    A turn's parts are its texts, unescaped, and placeholders (kind, text), in order; neighbouring
    texts are one. text is its texts and placeholders joined; loss is all text under the chunk's
    loss mask, unescaped and joined.
    """
    pieces = F.transform(
        F.filter(F.split("text", r"<\|end\|>"), lambda s: s != ""), lambda s: F.split(F.replace(s, F.lit(TURN), F.lit("")), r"<\|body\|>")
    )
    # A placeholder is a control string, which no escaped text holds.
    shown = lambda b: F.regexp_extract_all(b, F.lit(r"(?s)<\|at:\w*\|>|.+?(?=<\|at:|\z)"), F.lit(0))
    part = lambda s: F.when(
        s.startswith("<|at:"), F.struct(F.regexp_extract(s, r"^<\|at:(\w*)\|>$", 1).alias("kind"), F.lit(None).cast("string").alias("text"))
    ).otherwise(F.struct(F.lit("text").alias("kind"), unescape(s).alias("text")))
    return chunks.select(
        "conv", "piece", "chunk",
        F.transform(pieces, lambda p: F.struct(unescape(p[0]).alias("role"), unescape(p[1]).alias("text"), F.transform(shown(p[1]), part).alias("parts"))).alias("turns"),
        F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("text"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "").alias("loss"),
        F.char_length("text").cast("long").alias("chars"),
    )
