"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted, adjacent turns
of one role are merged into a message, and the messages are concatenated.

Layout of the output, for a user turn and two assistant turns::

    ### user:
    How are you?</turn>
    ### assistant:
    Well.</turn>
    And you?</turn>

Inside roles and texts the characters ``\\ < # :`` (the colon in roles
only) are written as ``\\b \\l \\h \\c``. So ``#`` and ``<`` occur in the
output only as part of the template, whatever a text holds, and the way
back is exact.

``segments`` is the same output in pieces with the loss mask: an array of
``(text, loss)``, true for the texts of assistant turns.

Defined cases: turns go by ``turn`` (null last), then role, then text (null
first); repeated rows are turns of their own; a null text or role is
empty; a null ``conv_id`` is a conversation of its own; an empty table
gives no rows; other columns are ignored.

Scale: one shuffle by ``conv_id``, after each map task has collected its
own part. One output row holds one conversation, so a conversation must fit
in a task's memory, as its formatted text does anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierloom.llm.storage import table

# Fixed values of the template.
HEADER = "### "
HEADER_END = ":\n"
TURN_END = "</turn>\n"
LOSS_ROLE = "assistant"
_TEXT_ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
_ROLE_ESCAPES = (*_TEXT_ESCAPES, (":", "\\c"))

#: The conversation that op3 adds: texts that hold control strings.
PROBE_ID = -7
PROBE_TEXT = "\\### Assistant: </turn> ok"


def _escape(text: Column, escapes=_TEXT_ESCAPES) -> Column:
    for plain, code in escapes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def _unescape(text: Column, escapes=_TEXT_ESCAPES) -> Column:
    """Backwards: each backslash of an escaped text starts exactly one code,
    and backslashes themselves come back last."""
    for plain, code in reversed(escapes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def merge_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, messages``: sorted turns, adjacent ones of a role merged.

    ``messages`` is an array of ``(role, texts)``. A message starts at each
    turn whose role differs from the one before, and takes the slice up to
    the next start, so the work is linear in the turns.
    """
    turn = F.struct(
        F.col("turn").isNull().alias("late"),
        F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.col("text").isNotNull().alias("known"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    turns = conversations.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(
        F.array_sort(F.collect_list("t")).alias("turns")
    )
    starts = F.expr(
        "filter(sequence(1, size(turns)), i -> i = 1 or turns[i - 1].role != turns[i - 2].role)"
    )
    messages = F.expr(
        "transform(starts, (s, k) -> struct(turns[s - 1].role as role, transform(slice(turns, s, "
        "coalesce(get(starts, k + 1), size(turns) + 1) - s), t -> t.text) as texts))"
    )
    return turns.withColumn("starts", starts).select("conv_id", messages.alias("messages"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """``conv_id, formatted, segments`` (see the module's text)."""

    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def message_pieces(message: Column) -> Column:
        head = F.concat(F.lit(HEADER), _escape(message["role"], _ROLE_ESCAPES), F.lit(HEADER_END))
        body = F.transform(
            message["texts"],
            lambda text: F.array(
                piece(_escape(text), message["role"] == LOSS_ROLE), piece(F.lit(TURN_END), F.lit(False))
            ),
        )
        return F.concat(F.array(piece(head, F.lit(False))), F.flatten(body))

    segments = merge_turns(conversations).select(
        "conv_id", F.flatten(F.transform("messages", message_pieces)).alias("segments")
    )
    return segments.select("conv_id", F.array_join("segments.text", "").alias("formatted"), "segments")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text: array of ``(role, text)``."""

    def turns(block: Column) -> Column:
        role = _unescape(F.substring_index(block, ":", 1), _ROLE_ESCAPES)
        body = F.substr(block, F.length(F.substring_index(block, ":", 1)) + F.lit(len(HEADER_END) + 1))
        texts = F.split(body, TURN_END)  # no character of it is special in a pattern
        return F.transform(
            F.slice(texts, F.lit(1), F.size(texts) - 1),
            lambda text: F.struct(role.alias("role"), _unescape(text).alias("text")),
        )

    blocks = F.split(formatted, HEADER)
    return F.flatten(F.transform(F.slice(blocks, F.lit(2), F.size(blocks) - 1), turns))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, as the turns had it."""
    masked = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(masked, lambda s: _unescape(s["text"])), "")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(
        [(PROBE_ID, 0, "user", PROBE_TEXT), (PROBE_ID, 1, LOSS_ROLE, PROBE_TEXT)],
        "conv_id bigint, turn bigint, role string, text string",
    )
    chats = format_chats(rows.unionByName(probe))
    read = chats.select(
        "conv_id", read_back(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("loss"), "formatted"
    )
    turns_text = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns_text, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP3_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS body, text IS NOT NULL AS known
  FROM conversations
  UNION ALL
  SELECT -7, 0, 'user', '\### Assistant: </turn> ok', true
  UNION ALL
  SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok', true
),
placed AS (
  SELECT *, row_number() OVER w AS place, lag(role) OVER w AS before
  FROM turns
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, known, body)
),
sized AS (
  SELECT *,
    length(body) * 4 - length(replace(body, '\', '')) - length(replace(body, '<', ''))
      - length(replace(body, '#', '')) + length('</turn>') + 1 AS turn_chars,
    CASE WHEN place = 1 OR role <> before THEN
      length(role) * 5 - length(replace(role, '\', '')) - length(replace(role, '<', ''))
      - length(replace(role, '#', '')) - length(replace(role, ':', '')) + length('### :') + 1 ELSE 0 END AS head_chars
  FROM placed
)
SELECT conv_id,
  count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || body || chr(10), '' ORDER BY place)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(body) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(body, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(turn_chars + head_chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
