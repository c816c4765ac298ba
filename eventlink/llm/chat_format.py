"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted, adjacent turns of the same role become one block, and
blocks are concatenated::

    <s>role[INST]text[/INST][INST]text of the next turn of that role[/INST]</s><s>..

A control string inside a role or text gets a backslash after its bracket (``[INST]`` becomes ``[\\INST]``, ``[\\INST]``
becomes ``[\\\\INST]``), so no control string is left in it and taking one backslash off restores it.

Null roles and texts count as empty; a null conversation id is a conversation of its own. Turns with equal numbers are
ordered by role, then text, and equal rows all stay. Columns other than the four named ones are left out. An empty table
gives an empty table. A conversation is one row of the result, so it is held as one value; nothing else is gathered.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, TEXT_END, TURN_END = "<s>", "[INST]", "[/INST]", "</s>"
_TAIL = r"(/?(?:s>|INST\]))"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*){_TAIL}", r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*){_TAIL}", "$1$2$3")


def format_chat(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    loss_roles: Iterable[str] = ("assistant",),
) -> DataFrame:
    """Per conversation: ``segments`` (array of string ``piece`` and boolean ``loss``) and ``formatted``, their concatenation."""
    empty = F.lit("")
    named = turns.select(
        F.col(conversation).alias("conv"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role).cast("string"), empty).alias("role"),
            F.coalesce(F.col(text).cast("string"), empty).alias("text"),
        ).alias("t"),
    )
    sorted_turns = named.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    first = F.filter(
        F.sequence(F.lit(1), F.size("turns")),
        lambda i: (i == 1) | (F.get("turns", i - 1)["role"] != F.get("turns", i - 2)["role"]),
    )
    blocks = sorted_turns.select("conv", "turns", first.alias("first")).select(
        "conv",
        F.transform(
            "first",
            lambda start, k: F.slice(
                "turns", start, F.coalesce(F.get("first", k + 1), F.size("turns") + 1) - start
            ),
        ).alias("blocks"),
    )

    def piece(value: Column, loss: Column) -> Column:
        return F.struct(value.alias("piece"), loss.alias("loss"))

    no = F.lit(False)

    def segments(block: Column) -> Column:
        speaker = F.get(block, F.lit(0))["role"]
        bodies = F.transform(
            block,
            lambda t: F.array(
                piece(F.lit(TEXT), no), piece(escaped(t["text"]), speaker.isin(*loss_roles)), piece(F.lit(TEXT_END), no)
            ),
        )
        return F.concat(
            F.array(piece(F.concat(F.lit(TURN), escaped(speaker)), no)),
            F.flatten(bodies),
            F.array(piece(F.lit(TURN_END), no)),
        )

    return blocks.select("conv", F.flatten(F.transform("blocks", segments)).alias("segments")).select(
        F.col("conv").alias(conversation),
        "segments",
        F.array_join(F.transform("segments", lambda s: s["piece"]), "").alias("formatted"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, as an array of role and text."""
    blocks = F.filter(F.split(formatted, TURN_END), lambda b: b != "")

    def turns(block: Column) -> Column:
        parts = F.split(block, r"\[INST\]")
        speaker = unescaped(F.substring(F.get(parts, F.lit(0)), len(TURN) + 1, 2_147_483_647))
        bodies = F.slice(parts, F.lit(2), F.size(parts) - 1)
        return F.transform(
            bodies,
            lambda b: F.struct(
                speaker.alias("role"),
                unescaped(b.substr(F.lit(1), F.length(b) - len(TEXT_END))).alias("text"),
            ),
        )

    return F.flatten(F.transform(blocks, turns))


def digests(formatted: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """What the query returns, read back from the output of :func:`format_chat`."""
    read = formatted.select(
        conversation,
        "formatted",
        read_turns(F.col("formatted")).alias("turns"),
        F.array_join(
            F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["piece"])), ""
        ).alias("lost"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col(conversation),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("lost").cast("long").alias("loss_chars"),
        F.sha2("lost", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), placed AS (
    SELECT *, row_number() OVER w AS k, lag(role) OVER w AS before, lead(role) OVER w AS after,
        regexp_replace(role, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g') AS role_out,
        regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g') AS text_out
    FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), said AS (
    SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY k) AS turns,
        coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '') AS lost,
        sum(CASE WHEN before IS DISTINCT FROM role THEN 3 + length(role_out) ELSE 0 END + 6 + length(text_out) + 7
            + CASE WHEN after IS DISTINCT FROM role THEN 4 ELSE 0 END)::BIGINT AS formatted_chars
    FROM placed GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(lost) AS loss_chars, sha256(lost) AS loss_sha256,
    formatted_chars
FROM said
"""
