"""Logged chats: snapshots that begin longer ones are collapsed, the rest rendered; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.common import checkpointed, stored

#: Turns that are sorted together: a conversation of any length is worked on in blocks.
BLOCK = 256

# How turns are marked in the rendered text.
BEGIN, END = "<|im_start|>", "<|im_end|>"


def numbered(turns: DataFrame) -> DataFrame:
    """Turns with their place in the conversation: ``conv_id, pos (from 1), role, text``.

    Order: turn number (null first), then role and text.  Blocks of turn numbers are counted first, so
    that no window spans a whole conversation.
    """
    said = turns.select(
        "conv_id", F.col("turn").alias("_turn"),
        F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 40))).alias("_block"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    sizes = said.groupBy("conv_id", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(F.col("conv_id").alias("_conv"), F.col("_block").alias("_b"), F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("conv_id", "_block").orderBy("_turn", "role", "text"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_block") == F.col("_b"))
    return said.withColumn("_place", place).join(checkpointed(sizes), same).select(
        "conv_id", (F.col("_before") + F.col("_place")).alias("pos"), "role", "text"
    )


def _turn_hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("pos"), F.col("role"), F.col("text"))


def prefix_hashes(said: DataFrame) -> DataFrame:
    """``(conv_id, pos, h1, h2)``: 128 bits that stand for the first ``pos`` turns of a conversation.

    A turn's hash holds its place, so a running exclusive-or is a rolling hash of the prefix; it is
    carried from block to block.
    """
    hashed = said.select("conv_id", "pos", F.floor(F.col("pos") / BLOCK).alias("_block"), _turn_hash(1).alias("t1"), _turn_hash(2).alias("t2"))
    xor = lambda c: F.bit_xor(c)
    blocks = hashed.groupBy("conv_id", "_block").agg(xor("t1").alias("b1"), xor("t2").alias("b2"))
    earlier = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        F.col("conv_id").alias("_conv"), F.col("_block").alias("_b"),
        F.coalesce(xor("b1").over(earlier), F.lit(0)).alias("b1"), F.coalesce(xor("b2").over(earlier), F.lit(0)).alias("b2"),
    )
    upto = Window.partitionBy("conv_id", "_block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rolled = hashed.withColumns({"t1": xor("t1").over(upto), "t2": xor("t2").over(upto)})
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_block") == F.col("_b"))
    return rolled.join(checkpointed(blocks), same).select(
        "conv_id", "pos", F.col("t1").bitwiseXOR(F.col("b1")).alias("h1"), F.col("t2").bitwiseXOR(F.col("b2")).alias("h2")
    )


def maximal(said: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, n_copies)`` of the conversations that begin no longer one.

    A conversation goes if its turns are the first turns of a longer conversation; of equal ones the
    smallest conv_id stays (null last), and ``n_copies`` counts them.  Prefixes are reduced to distinct
    ones before the anti-join, so a beginning shared by very many conversations is one row.
    """
    hashes = stored(prefix_hashes(said))
    ends = hashes.groupBy("conv_id").agg(F.max(F.struct("pos", "h1", "h2")).alias("e")).select("conv_id", "e.*")
    first = F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id")).alias("first")
    whole = checkpointed(ends.groupBy("pos", "h1", "h2").agg(first, F.count(F.lit(1)).alias("n_copies")))
    longer = hashes.join(
        ends.select(F.col("conv_id").alias("_conv"), F.col("pos").alias("_last")),
        F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("pos") < F.col("_last")),
    )
    inner = checkpointed(longer.select("pos", "h1", "h2").distinct())
    kept = whole.join(inner, ["pos", "h1", "h2"], "left_anti")
    return kept.select(F.col("first.conv_id").alias("conv_id"), F.col("pos").alias("n_turns"), "n_copies")


def rendered_turn() -> Column:
    """One turn as text; marks that the turn itself contains are broken up, so that they can't end it."""
    plain = lambda c: F.replace(F.replace(F.col(c), F.lit(BEGIN), F.lit("<| im_start |>")), F.lit(END), F.lit("<| im_end |>"))
    return F.concat(F.lit(BEGIN), plain("role"), F.lit("\n"), plain("text"), F.lit(END), F.lit("\n"))


def collapse_and_render(turns: DataFrame) -> DataFrame:
    """``(conv_id, part, n_turns, n_copies, text)``: the maximal conversations, rendered.

    A conversation is a row; one of more than 256 turns is a row for each 256 turns (``part`` from 0), so
    that none is gathered whole, and the parts in order make up its text.  Null roles and texts count
    as empty; turns that share a number stand in order of role and text; rows with a null conv_id
    are one conversation; repeated rows are turns of their own.  An empty table gives no rows;
    other columns are ignored.
    """
    said = stored(numbered(turns))
    kept = checkpointed(maximal(said)).withColumnRenamed("conv_id", "_conv")
    part = F.floor((F.col("pos") - 1) / BLOCK).alias("part")
    rows = said.join(kept, F.col("conv_id").eqNullSafe(F.col("_conv"))).select(
        "conv_id", part, "n_turns", "n_copies", F.struct("pos", rendered_turn().alias("said")).alias("turn")
    )
    texts = F.array_join(F.transform(F.array_sort(F.collect_list("turn")), lambda t: t["said"]), "")
    return rows.groupBy("conv_id", "part", "n_turns", "n_copies").agg(texts.alias("text"))


COLLAPSE_SQL = f"""
    WITH said AS (
        SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
        FROM conversations
    ), lists AS (
        SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY pos) AS turns, count(*) AS n_turns FROM said GROUP BY conv_id
    ), beginnings AS (
        SELECT DISTINCT turns[1:k] AS turns FROM lists, unnest(range(1, n_turns)) AS t(k)
    ), kept AS (
        SELECT min(conv_id) AS conv_id, count(*) AS n_copies FROM lists
        WHERE NOT EXISTS (SELECT 1 FROM beginnings b WHERE b.turns = lists.turns) GROUP BY turns
    ), marked AS (
        SELECT conv_id, pos,
               '{BEGIN}' || replace(replace(role, '{BEGIN}', '<| im_start |>'), '{END}', '<| im_end |>') || chr(10)
               || replace(replace(text, '{BEGIN}', '<| im_start |>'), '{END}', '<| im_end |>') || '{END}' || chr(10) AS turn_text
        FROM said
    )
    SELECT m.conv_id, (pos - 1) // {BLOCK} AS part, max(n_turns) AS n_turns, max(n_copies) AS n_copies,
           string_agg(turn_text, '' ORDER BY pos) AS text
    FROM marked m JOIN kept k ON m.conv_id IS NOT DISTINCT FROM k.conv_id JOIN lists l ON m.conv_id IS NOT DISTINCT FROM l.conv_id
    GROUP BY m.conv_id, part
"""
