"""Operator 10: chat formatting by cumulative-snapshot collapse.

Chat front ends log the whole conversation after every turn, so one dialogue
arrives as many rows sets, each a prefix of the next. Every turn gets a
position-bound digest; the running XOR of the digests is a rolling hash of the
prefix that ends there. A conversation whose full hash is a proper prefix hash
of a longer one is dropped by an anti-join, equal conversations keep the
smallest id, and only the maximal ones are rendered.

Scale: digests are narrow (no text), so the prefix window and both hash
shuffles move some 60 bytes a turn. Equal conversations and equal prefixes
are pre-aggregated before the anti-join, so a first turn or a conversation
that a third of the log shares is one row there. Text is shuffled once, for
retained conversations only, to be put together by conversation: a rendered
conversation is one row, so its own turns meet in one task by definition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TURN_OPEN, TURN_MIDDLE, TURN_CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
UNKNOWN_ROLE = "unknown"


def _turns(conversations: DataFrame) -> DataFrame:
    """One row a turn: id, order within the conversation, 128 bits of digest."""
    turn_text = F.concat(
        F.coalesce(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role")), F.lit("-")),
        F.coalesce(F.concat(F.lit("="), F.col("text")), F.lit("-")))
    ordered = conversations.select(
        F.col("conv_id").alias("id"), F.col("turn").alias("t"), F.col("role").alias("r"),
        F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("m"),
        F.xxhash64(turn_text).alias("a"), F.xxhash64(F.lit(1), turn_text).alias("b"))
    by_turn = Window.partitionBy("id").orderBy("t", "r", "m", "a")
    return (ordered
            .withColumn("k", F.row_number().over(by_turn))
            .select("id", "k", F.xxhash64("k", "a", "b").alias("a"), F.xxhash64("b", "k", "a").alias("b")))


def prefix_hashes(conversations: DataFrame) -> DataFrame:
    """(id, k, ha, hb, n): rolling hash of the first k turns of n."""
    turns = _turns(conversations)
    upto = Window.partitionBy("id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("id")
    return turns.select("id", "k", F.bit_xor("a").over(upto).alias("ha"),
                        F.bit_xor("b").over(upto).alias("hb"), F.count(F.lit(1)).over(whole).alias("n"))


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """(id, n, n_equal): conversations that are no proper prefix of another one.

    Of equal conversations the smallest id stays; ``n_equal`` counts them.
    """
    prefixes = prefix_hashes(conversations)
    full = (prefixes.where(F.col("k") == F.col("n"))
            .groupBy("k", "ha", "hb")
            .agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n_equal")))
    proper = prefixes.where(F.col("k") < F.col("n")).select("k", "ha", "hb").distinct()
    return (full.join(proper, ["k", "ha", "hb"], "left_anti")
            .select("id", F.col("k").cast("long").alias("n"), "n_equal"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """Render every maximal conversation once: conv_id, n_turns, n_equal, text.

    Turns are taken by (turn, role, md5 of the text); a repeated row is a turn
    of its own. Rows without conv_id form one conversation whose id is null. A
    null role is rendered as ``unknown``, a null text as an empty turn; both
    differ from the empty string when conversations are compared. Other
    columns are ignored; an empty table gives an empty result.
    """
    kept = maximal_conversations(conversations)
    turns = conversations.select("conv_id", F.struct(
        F.col("turn").alias("t"), F.col("role").alias("r"),
        F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("m"), F.col("text").alias("x")).alias("turn"))
    lines = F.transform(F.sort_array(F.collect_list("turn")), lambda s: F.concat(
        F.lit(TURN_OPEN), F.coalesce(s["r"], F.lit(UNKNOWN_ROLE)), F.lit(TURN_MIDDLE),
        F.coalesce(s["x"], F.lit("")), F.lit(TURN_CLOSE)))
    rendered = (turns.join(kept, F.col("conv_id").eqNullSafe(F.col("id")), "left_semi")
                .groupBy("conv_id").agg(F.array_join(lines, "").alias("text")))
    return (rendered.join(kept, F.col("conv_id").eqNullSafe(F.col("id")))
            .select("conv_id", F.col("n").alias("n_turns"), "n_equal", "text"))


ORACLE = f"""
WITH t AS (
  SELECT conv_id, role, text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, md5(coalesce(text, ''))) AS k,
    concat(coalesce(concat(length(role), ':', role), '-'), coalesce(concat(length(text), '=', text), '-'), ';') AS enc
  FROM conversations),
c AS (
  SELECT conv_id, count(*) AS n, string_agg(enc, '' ORDER BY k) AS enc,
    string_agg(concat('{TURN_OPEN}', coalesce(role, '{UNKNOWN_ROLE}'), chr(10), coalesce(text, ''), '<|im_end|>', chr(10)), '' ORDER BY k) AS text
  FROM t GROUP BY conv_id),
f AS (SELECT min(conv_id) AS conv_id, n AS n_turns, enc, count(*) AS n_equal, min(text) AS text FROM c GROUP BY n, enc)
SELECT conv_id, n_turns, n_equal, text FROM f
WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.n > f.n_turns AND starts_with(c.enc, f.enc))
"""
