"""Chat formatting with typed content parts, in native expressions only.

A conversation becomes one string. Each turn is

    <|start|>role<|body|>content<|end|>

and content is its parts, joined by ``<|part|>``: a text part is its escaped text, an image, audio
or document part is a placeholder ``<|image|>``, ``<|audio|>``, ``<|document|>``, a part of any other
type the placeholder ``<|other|>``; type, reference and expanded token count are recorded in
``attachments``. A plain text column is one text part per turn. Control strings inside texts and roles are
escaped by ESC sequences, so no text can open or end a turn, and ``read_chat`` gives back exactly
what was formatted.

Defined cases: a null or empty text is the empty text; a null role is the empty role; turns are
ordered by (turn, role, text), nulls first, and repeated rows stay repeated; rows with a null
conversation key form one conversation; a part without a type is text, null parts are left out, and no
parts read back as one empty text; an unknown token count stays null and adds nothing to the total; an empty table gives an empty table; other columns are not looked at.
A conversation is one string, so it is also one row: that is the only thing held per group, and the
order of its turns comes from a sorted window that can spill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ESC = "\x1b"
START, BODY, PART, END = "<|start|>", "<|body|>", "<|part|>", "<|end|>"
# fixed values: strings with a meaning for this template or for common chat templates
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
MEDIA, OTHER = ("image", "audio", "document"), "other"
PARTS = "array<struct<type:string,text:string,ref:string,tokens:int>>"


def escape(text: Column) -> Column:
    """``text`` without control strings. ESC becomes ESC 0, and ESC 1 splits each control string
    after its first character; neither can arise from the other."""
    out = F.replace(F.coalesce(text, F.lit("")), F.lit(ESC), F.lit(ESC + "0"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + ESC + "1" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESC + "1"), F.lit("")), F.lit(ESC + "0"), F.lit(ESC))


def _kind(part: Column) -> Column:
    """Type of a part out of a closed set, so no type name can be a control string."""
    return F.when(F.coalesce(part["type"], F.lit("text")) == "text", F.lit("text")).when(part["type"].isin(*MEDIA), part["type"]).otherwise(F.lit(OTHER))


def visit(part: Column) -> Column:
    """One content part as it stands in the string."""
    kind = _kind(part)
    return F.when(kind == "text", escape(part["text"])).otherwise(F.concat(F.lit("<|"), kind, F.lit("|>")))


def _given(parts: Column) -> Column:
    return F.filter(F.coalesce(parts, F.array().cast(PARTS)), lambda p: p.isNotNull())


def flatten(parts: Column) -> Column:
    """Content of a turn: its parts in order."""
    return F.array_join(F.transform(_given(parts), visit), PART)


def attachments(parts: Column) -> Column:
    """Types, references and token counts of the parts that are not text, with their place among the parts."""
    placed = F.transform(_given(parts), lambda p, i: F.struct(
        i.alias("part"), F.coalesce(p["type"], F.lit("text")).alias("type"), p["ref"].alias("ref"), p["tokens"].alias("tokens")))
    return F.filter(placed, lambda p: p["type"] != "text")


def text_part(text: Column) -> Column:
    """A text as the only part of its turn."""
    return F.array(F.struct(F.lit("text").alias("type"), text.cast("string").alias("text"), F.lit(None).cast("string").alias("ref"),
                            F.lit(None).cast("int").alias("tokens")))


def format_chat(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str | None = "text",
                parts: str | None = None, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv, formatted, turns, attachments, n_tokens_media).

    ``parts`` names a column of type ``PARTS``; without it ``text`` is the only part. ``turns`` has,
    per turn, the code points of ``formatted`` where the turn and its content begin, the content's
    length, and whether the loss covers it."""
    content = F.col(parts).cast(PARTS) if parts else text_part(F.col(text))
    raw_role, body, found = F.coalesce(F.col(role), F.lit("")), flatten(content), attachments(content)
    head = F.concat(F.lit(START), escape(raw_role), F.lit(BODY))
    rows = df.select(F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), raw_role.alias("_role"), head.alias("_head"),
                     body.alias("_body"), (body if parts else F.coalesce(F.col(text), F.lit(""))).alias("_key"), found.alias("_found"), raw_role.isin(*loss_roles).alias("_loss"))
    size = F.char_length("_head") + F.char_length("_body") + F.lit(len(END))
    before = Window.partitionBy("_conv").orderBy("_turn", "_role", "_key").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"_at": F.coalesce(F.sum(size).over(before), F.lit(0)).cast("int"),
                             "_i": F.count(F.lit(1)).over(before).cast("int")})
    piece = F.struct("_at", F.concat("_head", "_body", F.lit(END)).alias("piece"),
                     F.struct(F.col("_at").alias("at"), (F.col("_at") + F.char_length("_head")).alias("start"),
                              F.char_length("_body").alias("length"), F.col("_loss").alias("loss")).alias("span"),
                     F.transform("_found", lambda p: p.withField("turn", F.col("_i"))).alias("found"))
    g = rows.groupBy("_conv").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    media = F.flatten(F.transform("p", lambda x: x["found"]))
    return g.select(F.col("_conv").alias(conv), F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("formatted"),
                    F.transform("p", lambda x: x["span"]).alias("turns"), media.alias("attachments"),
                    F.aggregate(media, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x["tokens"], F.lit(0))).alias("n_tokens_media"))


def read_chat(df: DataFrame, formatted: str = "formatted", turns: str = "turns") -> DataFrame:
    """Add ``read``: per turn role, content and loss text, all taken from the formatted string.

    ``content`` is unescaped; ``parts`` has (type, text) of each part, where the text of a placeholder is null; ``loss_text`` is what the
    turn's span of the loss mask covers, null where the mask leaves the turn out."""
    pieces = F.split(F.col(formatted), r"<\|end\|>")
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def told(part: Column) -> Column:
        placed = part.isin(*[f"<|{m}|>" for m in (*MEDIA, OTHER)])  # a text that says so is escaped here
        return F.struct(F.when(placed, F.regexp_replace(part, "[<|>]", "")).otherwise(F.lit("text")).alias("type"),
                        F.when(~placed, unescape(part)).alias("text"))

    def one(piece: Column, i: Column) -> Column:
        span = F.get(F.col(turns), i)
        halves = F.split(F.substring(piece, F.lit(len(START) + 1), F.char_length(piece)), r"<\|body\|>", 2)
        covered = F.substring(piece, span["start"] - span["at"] + 1, span["length"])
        content = F.get(halves, F.lit(1))
        return F.struct(unescape(F.get(halves, F.lit(0))).alias("role"), unescape(content).alias("content"),
                        F.transform(F.split(content, r"<\|part\|>"), told).alias("parts"),
                        F.when(span["loss"], unescape(covered)).alias("loss_text"))

    return df.withColumn("read", F.transform(pieces, one))
