"""Chat formatting: typed content parts, reversible escapes, loss mask.

A turn is ``START role SEP content END newline``.  Content is an ordered list of
typed parts; the visitor (one expression per part type) turns text into its
escaped form and image, audio and document parts into one placeholder each,
recording the attachment's reference, its place among the parts and the tokens
it expands to (units times ``TOKENS_PER_UNIT``).  A plain ``text`` column is one
text part.

Control strings inside texts and roles are broken by a backslash after their
first character and backslashes are doubled, so no text can open or close a
turn and ``unescape`` gives the text back.  The loss mask is the list of
character ranges of assistant contents.

All of it is DataFrame expressions: a running sum over the turns gives the
ranges, one shuffle by conversation serves the sum and the grouping.

Null text and role are empty, a null turn sorts first, turns with the same
number are ordered by role and text; repeated rows are repeated turns; a null
conversation id is a conversation; an empty table gives an empty result; extra
columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
#: fixed values: strings that chat templates use to mark turns
CONTROL = ["<|", "[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>"]
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512}
PARTS = "array<struct<type:string,text:string,ref:string,units:int>>"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_part(text: Column) -> Column:
    none = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), none.cast("string").alias("ref"),
                            none.cast("int").alias("units"))).cast(PARTS)


def visit(part: Column) -> Column:
    """The formatted form of one part; an unknown type is shown as a document."""
    out = F.lit("<|document|>")
    for kind in ("audio", "image"):
        out = F.when(part["type"] == kind, F.lit(f"<|{kind}|>")).otherwise(out)
    return F.when(part["type"] == "text", escape(F.coalesce(part["text"], F.lit("")))).otherwise(out)


def attachments(parts: Column) -> Column:
    cost = F.lit(TOKENS_PER_UNIT["document"])
    seen = F.transform(parts, lambda p, i: F.struct(
        p["type"].alias("type"), p["ref"].alias("ref"), i.alias("part"),
        (F.coalesce(p["units"], F.lit(1)) * F.when(p["type"] == "image", TOKENS_PER_UNIT["image"])
         .when(p["type"] == "audio", TOKENS_PER_UNIT["audio"]).otherwise(cost)).alias("tokens")))
    return F.filter(seen, lambda a: a["type"] != "text")


def format_conversations(turns: DataFrame, parts: str | None = None) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans [(start, end)),
    attachments [(turn, part, type, ref, tokens)], expanded_tokens."""
    content = F.coalesce(F.col(parts), F.array().cast(PARTS)) if parts else text_part(F.coalesce("text", F.lit("")))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), content.alias("parts"))
    rows = rows.select("conv_id", "turn", "role", "parts", F.array_join(F.transform("parts", visit), "").alias("body"))
    rows = rows.withColumn("head", F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP)))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(END)))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "body")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = (rows.withColumn("place", F.row_number().over(order))
            .withColumn("begin", F.sum(F.length("piece").cast("long")).over(upto) - F.length("piece") + F.length("head")))
    span = F.when(F.col("role") == "assistant",
                  F.struct(F.col("begin").alias("start"), (F.col("begin") + F.length("body")).alias("end")))
    own = F.transform(attachments(F.col("parts")), lambda a: F.struct(
        F.col("place").alias("turn"), a["part"].alias("part"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))
    grouped = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("place", "piece"))).alias("pieces"),
        F.sort_array(F.collect_list(span)).alias("loss_spans"),
        F.sort_array(F.flatten(F.collect_list(own))).alias("attachments"))
    return grouped.select("conv_id", F.array_join("pieces.piece", "").alias("formatted"), "loss_spans", "attachments",
                          F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"]).alias("expanded_tokens"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted text and its loss mask give back."""
    cut = formatted.select("conv_id", "formatted", "loss_spans",
                           F.slice(F.split("formatted", r"<\|im_start\|>"), 2, 1 << 30).alias("pieces"))
    split_at = r"<\|im_sep\|>"

    def turn(piece):
        head = F.split(piece, split_at)
        text = F.substring(head[1], F.lit(1), F.length(head[1]) - F.lit(len(END)))
        return F.concat(unescape(head[0]), F.lit("\n"), unescape(text), F.lit("\n"))

    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(
        F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    read = cut.select("conv_id", F.size("pieces").cast("long").alias("n_turns"),
                      F.array_join(F.transform("pieces", turn), "").alias("turns"), loss.alias("loss"),
                      F.length("formatted").cast("long").alias("formatted_chars"))
    return read.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


#: one more conversation whose texts are control strings
PROBE = "</s>[INST] ok [/INST]"


def with_probe(turns: DataFrame) -> DataFrame:
    probe = turns.sparkSession.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return turns.select("conv_id", "turn", "role", "text").unionByName(probe)


def conversation_digests(turns: DataFrame) -> DataFrame:
    return read_back(format_conversations(with_probe(turns)))


def _sql_escape(x: str) -> str:
    out = f"replace({x}, '\\', '\\\\')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


def oracle() -> str:
    fixed = len(START) + len(SEP) + len(END)
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'),
e AS (SELECT *, {_sql_escape('text')} AS body, {_sql_escape('role')} AS name FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, body)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, body), '')) AS loss_sha256,
  sum(length(body) + length(name) + {fixed})::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""
