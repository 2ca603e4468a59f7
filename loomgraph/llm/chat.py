"""Chat formatting by perspective rotation, in DataFrame functions alone.

For every participant of a conversation the dialogue is rendered once with that speaker as the assistant and all
others as named users; the loss mask (mask_start to mask_end, equal where
there is none) covers the assistant's words and their closing mark. A row is one rendered turn:
segments in order of `position` make the text of (conv_id, perspective), `char_start` is a segment's place in it.

Scale: a conversation is never gathered in one row or task. Places come from sums in three levels (rows of a part of a
turn, parts of a span of turns, spans of a conversation), so that a conversation of any length is spread; the join of
turns with participants has few rows on its right and can be split where a conversation is hot.

Marks are kept apart from words: within texts and names `<|` becomes `<\\|` (and `<\\|` becomes `<\\\\|`, so that it can be
undone), and within names a line end or carriage return is written as `\\n` or `\\r` and a backslash doubled. So no text opens
or closes a turn, in any perspective. The output has a row for each pair of a turn and a participant: that is its size.

Defined results: speakers named system stay system and have no perspective; a null role is the speaker "unknown"; null
texts render as empty; turns are ordered by number (null first), then by the MD5 of role and text; repeated rows are
rendered as often as they stand there; a conversation of system turns alone has no perspective and gives no rows; null
conv_ids are one conversation; columns other than conv_id, turn, role and text are ignored.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import table

SPAN = 256
SYSTEM, UNKNOWN = "system", "unknown"


def apart(c):
    """A text without the marks of turns."""
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def shown(c):
    """A speaker's name on the one line of a head."""
    for raw, written in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")):
        c = F.replace(c, F.lit(raw), F.lit(written))
    return apart(c)


def rotate(conversations: DataFrame) -> DataFrame:
    """conv_id, perspective, turn, position, role, name, segment, mask_start, mask_end (code points in the segment), char_start."""
    turns = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(UNKNOWN)).alias("speaker"), F.coalesce("text", F.lit("")).alias("text")
    )
    who = turns.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("of"), F.col("speaker").alias("perspective")).distinct()
    rows = turns.join(who, turns["conv_id"].eqNullSafe(who["of"])).drop("of")
    role = F.when(F.col("speaker") == SYSTEM, F.lit(SYSTEM)).when(F.col("speaker") == F.col("perspective"), F.lit("assistant")).otherwise(F.lit("user"))
    rows = rows.withColumn("role", role).withColumn("name", F.when(F.col("role") == "user", F.col("speaker")).otherwise(""))
    head = F.concat(F.lit("<|im_start|>"), "role", F.when(F.col("role") == "user", F.concat(F.lit(" name="), shown(F.col("name")))).otherwise(""), F.lit("\n"))
    rows = rows.withColumn("segment", F.concat(head, apart(F.col("text")), F.lit("<|im_end|>\n")))
    spoken, size = F.col("role") == "assistant", F.length("segment")
    rows = rows.withColumns({"n_chars": size.cast("long"), "mask_start": F.when(spoken, F.length(head)).otherwise(0).cast("long"), "mask_end": F.when(spoken, size - 1).otherwise(0).cast("long")})
    order = F.md5(F.concat_ws("\x1f", "speaker", "text").cast("binary"))
    rows = rows.withColumns({"order_": order, "part_": F.substring(order, 1, 2), "span_": F.coalesce(F.floor(F.col("turn") / SPAN), F.lit(-(1 << 62))), "turn_": F.coalesce("turn", F.lit(-(1 << 62))), "conv_": F.coalesce(F.col("conv_id").cast("string"), F.lit("\x00"))})
    return placed(rows).select("conv_id", "perspective", "turn", "position", "role", "name", "segment", "mask_start", "mask_end", "char_start")


def placed(rows: DataFrame) -> DataFrame:
    """rows with position and char_start, by sums in three levels."""
    top, span = ["conv_", "perspective"], ["conv_", "perspective", "span_"]
    part = [*span, "turn_", "part_"]

    def before(df: DataFrame, keys: list[str], order: list, tag: str, n, chars) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({f"n_{tag}": F.coalesce(F.sum(n).over(w), F.lit(0)), f"c_{tag}": F.coalesce(F.sum(chars).over(w), F.lit(0))})

    rows = before(rows, part, ["order_", "speaker", "text"], "row", F.lit(1).cast("long"), F.col("n_chars"))
    parts = rows.groupBy(*part).agg(F.count("*").alias("n"), F.sum("n_chars").alias("c"))
    spans = before(parts.groupBy(*span).agg(F.sum("n").alias("n"), F.sum("c").alias("c")), top, ["span_"], "span", F.col("n"), F.col("c")).drop("n", "c")
    parts = before(parts, span, ["turn_", "part_"], "part", F.col("n"), F.col("c")).drop("n", "c").join(spans, span)
    total = lambda k: F.col(f"{k}_row") + F.col(f"{k}_part") + F.col(f"{k}_span")
    return rows.join(parts, part).withColumns({"position": total("n"), "char_start": total("c")})


def op3_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of conversations from every perspective."""
    return rotate(table(spark, sf_dir, "conversations"))


SQL = r"""
WITH t AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
w AS (SELECT DISTINCT conv_id AS of, speaker AS perspective FROM t WHERE speaker <> 'system'),
r AS (SELECT *, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role FROM t JOIN w ON conv_id IS NOT DISTINCT FROM of),
s AS (SELECT *, CASE WHEN role = 'user' THEN speaker ELSE '' END AS name, '<|im_start|>' || role || CASE WHEN role = 'user' THEN ' name=' || regexp_replace(replace(replace(replace(speaker, '\', '\\'), chr(10), '\n'), chr(13), '\r'), '<(\\*)\|', '<\\\1|', 'g') ELSE '' END || chr(10) AS head FROM r),
x AS (SELECT *, head || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || '<|im_end|>' || chr(10) AS segment, md5(speaker || chr(31) || text) AS o FROM s)
SELECT conv_id, perspective, turn, row_number() OVER p - 1 AS position, role, name, segment,
  CASE WHEN role = 'assistant' THEN length(head) ELSE 0 END AS mask_start, CASE WHEN role = 'assistant' THEN length(segment) - 1 ELSE 0 END AS mask_end,
  CAST(coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, o, speaker, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start
FROM x WINDOW p AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, o, speaker, text)
"""
