"""Chat formatting by relational expressions only.

The turn structs of a conversation are collected and sorted by turn; adjacent turns of one role are merged into a
block with array functions; blocks are rendered and concatenated. The template is

    <s>[role]text[+]text</s><s>[role]text</s>...

with one ``<s>[role]`` per block, ``[+]`` between merged turns and ``</s>`` after the block. Inside roles and texts
``\\``, ``[``, ``]`` and ``<`` are escaped as ``\\b``, ``\\o``, ``\\c`` and ``\\l``, so an escaped text holds none of the
characters control strings start with and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelode.llm._shared import table

#: Character, its escape. The backslash is escaped first and unescaped last.
ESCAPES = (("\\", "\\b"), ("[", "\\o"), ("]", "\\c"), ("<", "\\l"))
LOSS_ROLE = "assistant"


def escape(c: Column) -> Column:
    for raw, safe in ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def unescape(c: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        c = F.replace(c, F.lit(safe), F.lit(raw))
    return c


def format_chats(conversations: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted``, ``segments`` array of (piece, loss).

    ``segments`` concatenates to ``formatted``; ``loss`` marks pieces that count in the training loss (escaped texts of
    ``loss_role``, without the template around them). Null texts and roles are empty; a null ``conv_id`` is a
    conversation of its own; a null turn sorts first; rows that tie in turn are ordered by role, then text, and repeated
    rows stay. Other columns are ignored. An empty table gives no rows.
    """
    empty = F.lit("")
    turns = conversations.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce(F.col("role"), empty).alias("role"),
            F.coalesce(F.col("text"), empty).alias("text"),
        ).alias("t"),
    )
    collected = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    last = F.size("ts") - 1
    starts = F.filter(
        F.sequence(F.lit(0), last),
        lambda i: (i == 0) | (F.get(F.col("ts"), i)["role"] != F.get(F.col("ts"), i - 1)["role"]),
    )
    blocks = F.transform(
        F.col("starts"),
        lambda s, k: F.struct(
            F.get(F.col("ts"), s)["role"].alias("role"),
            F.transform(
                F.slice(F.col("ts"), s + 1, F.coalesce(F.get(F.col("starts"), k + 1), F.size("ts")) - s),
                lambda t: escape(t["text"]),
            ).alias("texts"),
        ),
    )
    plain = lambda c: F.struct(c.alias("piece"), F.lit(False).alias("loss"))
    segments = F.flatten(
        F.transform(
            F.col("blocks"),
            lambda b: F.concat(
                F.array(plain(F.concat(F.lit("<s>["), escape(b["role"]), F.lit("]")))),
                F.flatten(
                    F.transform(
                        b["texts"],
                        lambda t, i: F.array(
                            plain(F.when(i > 0, F.lit("[+]")).otherwise(empty)),
                            F.struct(t.alias("piece"), (b["role"] == loss_role).alias("loss")),
                        ),
                    )
                ),
                F.array(plain(F.lit("</s>"))),
            ),
        )
    )
    return (
        collected.withColumn("starts", starts)
        .withColumn("blocks", blocks)
        .withColumn("segments", segments)
        .select("conv_id", F.array_join(F.col("segments")["piece"], "").alias("formatted"), "segments")
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    blocks = F.filter(F.split(formatted, "</s>"), lambda b: b != "")

    def turns(b: Column) -> Column:
        head = F.substring_index(b, "]", 1)
        body = F.substr(b, F.char_length(head) + 2)
        role = unescape(F.substr(head, F.lit(5)))
        return F.transform(
            F.split(body, r"\[\+\]"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text"))
        )

    return F.flatten(F.transform(blocks, turns))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql(
        "SELECT -1L AS conv_id, t AS turn, r AS role, '</s>[INST] ok [/INST]' AS text "
        "FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)"
    )
    out = format_chats(conv.unionByName(probe))
    loss = F.array_join(
        F.transform(F.filter(F.col("segments"), lambda s: s["loss"]), lambda s: unescape(s["piece"])), ""
    )
    digest = F.array_join(
        F.transform(F.col("turns"), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return (
        out.withColumn("turns", read_back(F.col("formatted")))
        .withColumn("loss_text", loss)
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(digest, 256).alias("turns_sha256"),
            F.char_length("loss_text").cast("long").alias("loss_chars"),
            F.sha2("loss_text", 256).alias("loss_sha256"),
            F.char_length("formatted").cast("long").alias("formatted_chars"),
        )
    )


OP2_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), o AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS prev,
    length(text) + length(regexp_replace(text, '[^\[\]<\\]', '', 'g')) AS esc_text,
    length(role) + length(regexp_replace(role, '[^\[\]<\\]', '', 'g')) AS esc_role
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(esc_text + CASE WHEN prev IS NULL OR prev <> role THEN esc_role + 9 ELSE 3 END) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id
"""
